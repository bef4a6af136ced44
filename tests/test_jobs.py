"""The two jobs: growing input, repeated runs, failures, odd rows, the command line, and their queries' SQL."""

import contextlib
import io
import json
import math
import os
import re
import subprocess
import sys
from collections import defaultdict
from pathlib import Path

import duckdb
import pytest
from pyspark.sql import functions as F

from jobs import common, queries, text_colocalisation, track_frames

ROOT, SF = Path(__file__).resolve().parent.parent, Path("/root/testdata/sf0.001")
needs_tables = pytest.mark.skipif(not SF.exists(), reason="no test tables")


def _rows(df):
    return sorted(map(repr, df.select(*sorted(df.columns)).collect()))


@pytest.fixture
def events(spark, tmp_path):
    """A copy of the events in two parts: most of the first 40 days, and what is late of these together with all later days."""
    rows = spark.read.parquet(f"{SF}/events.parquet")
    early = (F.datediff("ts", F.lit("2024-01-01").cast("date")) < 40) & (F.pmod("event_id", F.lit(10)) > 0)
    for name, part in (("first", rows.where(early)), ("second", rows.where(~early)), ("all", rows)):
        part.coalesce(1).write.parquet(f"{tmp_path}/{name}")
    return tmp_path


@needs_tables
def test_frames_of_growing_input(spark, events, tmp_path):
    source, out, mark = f"{events}/events", f"{events}/out", f"{events}/mark"
    add = lambda name: spark.read.parquet(f"{events}/{name}").coalesce(1).write.mode("append").parquet(source)
    tables = lambda: {n: _rows(spark.read.parquet(f"{out}/{n}")) for n in ("labels", "tracks")}
    add("first")
    track_frames.run(spark, source, out, mark)
    before = tables()
    labels_file = sorted(Path(f"{out}/labels/t=5").glob("*.parquet"))
    add("second")
    track_frames.run(spark, source, out, mark)
    after = tables()
    assert before["tracks"] != after["tracks"] and labels_file
    track_frames.run(spark, source, out, mark)
    assert tables() == after
    track_frames.run(spark, f"{events}/all", f"{events}/whole", f"{events}/mark2")
    assert after == {n: _rows(spark.read.parquet(f"{events}/whole/{n}")) for n in after}
    # Voxels of a batch are kept once, however often it is run.
    n = spark.read.parquet(f"{out}/voxels").agg(F.sum("n")).head()[0]
    assert n == spark.read.parquet(f"{events}/all").count()
    track_frames.update(spark.read.parquet(f"{events}/second"), 1, out, common.settings(track_frames.CONFIG))
    assert tables() == after and spark.read.parquet(f"{out}/voxels").agg(F.sum("n")).head()[0] == n


@needs_tables
def test_frames_by_one_file_a_batch(spark, events):
    config = common.settings(track_frames.CONFIG, {"files_per_batch": 1})
    for name in ("second", "first"):
        spark.read.parquet(f"{events}/{name}").coalesce(1).write.mode("append").parquet(f"{events}/events")
    track_frames.run(spark, f"{events}/events", f"{events}/out", f"{events}/mark", config)
    assert spark.read.parquet(f"{events}/out/voxels").select("batch").distinct().count() == 2
    track_frames.run(spark, f"{events}/all", f"{events}/whole", f"{events}/mark2")
    assert _rows(spark.read.parquet(f"{events}/out/tracks")) == _rows(spark.read.parquet(f"{events}/whole/tracks"))


@needs_tables
def test_frames_without_events(spark, events):
    spark.read.parquet(f"{events}/all").limit(0).write.parquet(f"{events}/events")
    track_frames.run(spark, f"{events}/events", f"{events}/out", f"{events}/mark")
    assert not Path(f"{events}/out/tracks").exists()


TEXTS = [
    (1, "en", "One 2 three. Four 5. six seven eight nine 10 eleven twelve thirteen. x", 9), (2, "de", None, 9), (3, None, "", 9), (4, "de", "7", 9), (5, "de", "no mark here", 9), (6, "fr", "a. b! c?", 9),
    (7, "en", "1\t2\n3.é4 5 6 7 8 9.", 9), (7, "en", "0 b. c", 9), (None, "en", "1 2.", 9), (8, "en", "1 " * 4000 + "end.", 9),
]


def _expected(threshold):
    texts = defaultdict(list)
    for i, lang, text, _ in TEXTS:
        if i is not None:
            texts[i].append((lang or "und", re.findall(r"[^ \t-\r]+", text or "")))
    for i, rows in texts.items():
        own, other = {}, {}
        for _, words in rows:
            for x, w in enumerate(words):
                for hold, pattern in ((own, "[0-9]"), (other, "[.!?]$")):
                    if re.search(pattern, w):
                        hold[x] = max(hold.get(x, 0), len(w.encode()))
        near = sum(any(abs(x - y) <= threshold for y in other) for x in own)
        both = own.keys() & other.keys()
        share = lambda a, b: a / b if b else 0.0
        yield (
            i, len(own), len(other), len(both), len(own.keys() | other.keys()), near, share(sum(own[x] for x in both), sum(own.values())), share(sum(other[x] for x in both), sum(other.values())),
            share(2 * len(both), len(own) + len(other)), share(len(both), len(own.keys() | other.keys())), share(len(both), len(own)), share(near, len(own)), min(r[0] for r in rows),
        )


@pytest.mark.parametrize("threshold", [0.0, 3.0, 250.0])
def test_text_colocalisation(spark, tmp_path, threshold):
    spark.createDataFrame(TEXTS, "doc_id long, lang string, text string, t int").write.parquet(f"{tmp_path}/documents")
    config = common.settings(text_colocalisation.CONFIG, {"threshold": threshold})
    for _ in range(2):
        text_colocalisation.run(spark, f"{tmp_path}/documents", f"{tmp_path}/out", config)
        assert sorted(map(tuple, spark.read.parquet(f"{tmp_path}/out").collect())) == sorted(_expected(threshold))
    assert {p.name for p in Path(f"{tmp_path}/out").glob("lang=*")} == {"lang=en", "lang=de", "lang=fr", "lang=und"}


def test_texts_are_read_once_and_without_a_call_for_each(spark):
    config = common.settings(text_colocalisation.CONFIG)
    texts = spark.createDataFrame(TEXTS, "doc_id long, lang string, text string, t int")
    with contextlib.redirect_stdout(io.StringIO()) as plan:
        text_colocalisation.colocalisation(texts, config["source_pattern"], config["target_pattern"], config["threshold"]).explain()
    plan = plan.getvalue()
    assert plan.count("posexplode(") == 1 and "InArrow" not in plan and "InPandas" not in plan


def test_unknown_settings():
    with pytest.raises(ValueError, match="nonsense"):
        common.settings(text_colocalisation.CONFIG, {"nonsense": 1})


def test_command_line(spark, tmp_path):
    spark.createDataFrame(TEXTS, "doc_id long, lang string, text string, t int").write.parquet(f"{tmp_path}/documents")
    (tmp_path / "own.json").write_text(json.dumps(common.settings(text_colocalisation.CONFIG, {"threshold": 1.0})))
    env = os.environ | {"PYSPARK_SUBMIT_ARGS": "--master local[2] --conf spark.ui.enabled=false --conf spark.sql.shuffle.partitions=2 pyspark-shell"}
    command = [sys.executable, "-m", "jobs.text_colocalisation", f"{tmp_path}/documents", f"{tmp_path}/out", "--config", f"{tmp_path}/own.json"]
    done = subprocess.run(command, cwd=ROOT, env=env, capture_output=True, text=True, timeout=300)
    assert done.returncode == 0, done.stderr[-2000:]
    assert re.search(r"reading 10 documents", done.stderr) and re.search(r"wrote \S+: 8 documents", done.stderr)
    assert sorted(map(tuple, spark.read.parquet(f"{tmp_path}/out").collect())) == sorted(_expected(1.0))


@needs_tables
@pytest.mark.parametrize("name", sorted(queries.QUERIES))
def test_same_rows_as_sql(spark, name):
    con = duckdb.connect()
    for f in SF.glob("*.parquet"):
        con.sql(f"CREATE VIEW {f.stem} AS SELECT * FROM '{f}'")
    df, rel = queries.QUERIES[name](spark, str(SF)), con.sql(queries.ORACLE_SQL[name])
    columns = sorted(df.columns)
    assert columns == sorted(rel.columns)
    at = [rel.columns.index(c) for c in columns]
    plain = lambda v: "nan" if isinstance(v, float) and math.isnan(v) else repr(v)
    assert sorted(tuple(plain(r[c]) for c in columns) for r in df.collect()) == sorted(tuple(plain(r[i]) for i in at) for r in rel.fetchall())
