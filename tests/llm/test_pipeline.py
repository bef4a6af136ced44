"""The stages on a small table: decisions take effect, columns stay, and each stage keeps what it should."""

import random

import corpus_pipeline
import pytest
from voxelspark.llm import mixture
from voxelspark.llm.graph import cut


def test_stages(spark, tmp_path):
    rng = random.Random(9)
    word = lambda: "".join(rng.choice("abcdefghij") for _ in range(rng.randint(2, 8)))
    good = lambda: ". ".join(" ".join(word() for _ in range(15)) for _ in range(6))
    bad = lambda: " ".join(word().upper() + "!!" for _ in range(80))
    item = good()
    texts = [good() for _ in range(300)] + [bad() for _ in range(100)]
    texts[10] = texts[9] + " tail"
    texts[11] = texts[9]
    texts[20] = f"{texts[20]} {item} {texts[21]}"
    rows = [(i, t, "en", f"src{i % 4}", len(t)) for i, t in enumerate(texts)] + [(None, good(), None, None, 1), (401, None, "en", "src0", None)]
    sf = str(tmp_path)
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{sf}/documents.parquet")
    spark.createDataFrame([(i, int(i < 300)) for i in range(0, 400, 2)], "doc_id long, quality int").write.parquet(f"{sf}/labels.parquet")
    spark.createDataFrame([(1, item)], "item_id long, text string").write.parquet(f"{sf}/benchmark.parquet")
    docs, seen = spark.read.parquet(f"{sf}/documents.parquet"), []
    for _, stage in corpus_pipeline.STAGES[:-1]:
        out = cut(stage(spark, docs, sf))
        assert out.columns == docs.columns
        docs = out
        seen.append([r.doc_id for r in docs.collect()])
    quality, near, clean, mixed = seen
    assert sum(i is not None and 300 <= i < 400 for i in quality) <= 2 and sum(i is not None and i < 300 for i in quality) >= 297
    assert 9 in near and 10 not in near and 11 not in near and len(near) >= len(quality) - 3
    assert 20 not in clean and set(near) - set(clean) == {20}
    assert set(mixed) <= set(clean)
    final = corpus_pipeline.run(spark, sf).collect()
    assert sorted(str(r.doc_id) for r in final) == sorted(map(str, mixed))
    assert all(0 <= r.shard < 8 for r in final)


def test_mixing_stage_with_clashing_columns_and_repeated_ids(spark):
    rows = [(i % 7, f"word {i} " * (i % 5), "en", f"src{i % 3}", i, i, i) for i in range(40)] + [(None, None, None, None, 1, 2, 3)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, copies int, copy int, tokens int")
    for table in (docs, docs.limit(0)):
        out = corpus_pipeline.mixing_stage(spark, table, "")
        assert out.columns == docs.columns
        assert {tuple(r) for r in out.collect()} <= {tuple(r) for r in rows}
    assert out.count() == 0 and corpus_pipeline.mixing_stage(spark, docs, "").count() > 0
    assert corpus_pipeline.sharding_stage(spark, docs, "").count() == len(rows)


def test_weights_of_zero_are_refused(spark):
    docs = spark.createDataFrame([(1, "a b", "en")], "doc_id long, text string, lang string")
    with pytest.raises(ValueError, match="1 or more"):
        mixture.mix_sources(docs, {"lang": docs["lang"]}, {("en",): 0})


def test_mixing_keeps_columns_of_any_name(spark, docs, tmp_path):
    """Columns named like those that the stage works with come out as they went in."""
    names = ("_key", "_time", "_drawn_key", "_drawn_copies", "row", "key", "tokens", "domain", "copies", "col")
    wide = docs.drop(*names).selectExpr("*", *[f"concat('{n}', doc_id) AS `{n}`" for n in names])
    got = corpus_pipeline.mixing_stage(spark, wide, str(tmp_path))
    assert got.columns == wide.columns
    rows = got.collect()
    assert rows and all(r[n] == (None if r.doc_id is None else f"{n}{r.doc_id}") for r in rows for n in names)


def test_stages_of_an_empty_table(spark, docs, tmp_path):
    for name in ("labels", "benchmark"):
        spark.createDataFrame([], "doc_id long, quality int, toxic int, item_id long, text string").write.parquet(f"{tmp_path}/{name}.parquet")
    none = docs.limit(0)
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, none, str(tmp_path))
        assert out.columns == none.columns and out.count() == 0, name
