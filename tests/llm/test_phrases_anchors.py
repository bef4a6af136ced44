"""Collocations and block anchors against brute force and their SQL, with hot keys, long texts and odd rows."""

import hashlib
import random
import re
from collections import Counter, defaultdict
from pathlib import Path

import duckdb
import numpy as np
import pytest

from voxelspark.llm import anchors, packed, phrases, queries

SF = Path("/root/testdata/sf0.001")
LOWER = str.maketrans({chr(c): chr(c + 32) for c in range(65, 91)})


def expected_phrases(rows, support=10, covered=50, top=2000):
    """rows of (lang, text) by counting every phrase."""
    f, n = Counter(), Counter()
    for lang, text in rows:
        lang = "und" if lang is None else lang
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", (text or "").translate(LOWER)):
            words = re.findall(r"[^\x20\x09]+", piece)
            n[lang] += len(words)
            for k in (1, 2, 3):
                f.update((lang, *words[i : i + k]) for i in range(len(words) - k + 1))
    out = defaultdict(list)
    for (lang, *words), a in f.items():
        if len(words) < 2 or a < support:
            continue
        if len(words) == 2 and any(100 * b >= covered * a for (m, *longer), b in f.items() if m == lang and len(longer) == 3 and b >= support and words in (longer[:2], longer[1:])):
            continue
        cuts = [(1000000 * a * a // (f[(lang, *words[:k])] * f[(lang, *words[k:])]), k) for k in range(1, len(words))]
        score, k = min(cuts)
        out[lang].append((-score, -a, " ".join(words).encode(), a, f[(lang, *words[:k])], f[(lang, *words[k:])], n[lang], score))
    return sorted((lang, i, x[2].decode(), *x[3:]) for lang, found in out.items() for i, x in enumerate(sorted(found)[:top], 1))


def _some_text(rng, vocabulary, n):
    return "".join(rng.choice(vocabulary) + rng.choice([" ", " ", " ", " ", "\t", "  ", ", ", ". ", "\n", "\r\n", "!", "\x0b"]) for _ in range(n))


@pytest.mark.parametrize(("seed", "words"), [(1, "a b c"), (2, "A a é Ü d' \x00 .x 1-2   中 f g h"), (3, " ".join(map(str, range(60))))])
def test_phrases(spark, seed, words):
    rng = random.Random(seed)
    rows = [(rng.choice(["en", "de", None, "und", ""]), _some_text(rng, words.split(" "), rng.randint(0, 120))) for _ in range(60)]
    rows += [("en", None), (None, ""), ("en", "?!;:.,"), ("fr", "x x x x x x x x x x x x x"), *[rows[0]] * 3]
    df = spark.createDataFrame([(t, k, v, 1, 2) for k, v in rows for t in [0]], "doc_id long, lang string, text string, n long, key int").select("key", "lang", "n", "text").repartition(5)
    assert sorted(map(tuple, phrases.collocations(df).collect())) == expected_phrases(rows)
    assert sorted(map(tuple, phrases.collocations(df, support=3, covered=101, top=7).collect())) == expected_phrases(rows, 3, 101, 7)


def test_phrases_at_chosen_sizes(spark, monkeypatch):
    """However prefixes and texts are dealt out."""
    rows = [("en", _some_text(random.Random(k), list("abcdefgh"), 300)) for k in range(20)]
    shard = phrases.Shard(np.array([5, 7, 5, 5, 7], np.uint64), np.array([0, 1, 7, 8, 9]))
    monkeypatch.setattr(phrases, "_AT_ONCE", 1)
    found = {(int(a), int(b)): int(c) for x, y, n, _ in shard.extend(shard.maps) for a, b, c in zip(shard.words[x], shard.words[y], n)}
    assert found == {(5, 7): 2, (5, 5): 1}
    df = spark.createDataFrame(rows, "lang string, text string").repartition(13)
    assert sorted(map(tuple, phrases.collocations(df).collect())) == expected_phrases(rows)


def test_packs():
    rng = np.random.default_rng(0)
    a, b, c = rng.integers(0, 1 << 60, 1000).astype(np.uint64), rng.integers(0, 9, 1000).astype(np.uint16), np.arange(1000)
    bucket = packed.bucket_of(a << np.uint64(4), 7)
    batch = packed.spread(bucket, [a, b, c])
    got = packed.gather(iter([batch]), [np.uint64, np.uint16, np.int64])
    order = np.argsort(bucket, kind="stable")
    assert all((x == y[order]).all() for x, y in zip(got, (a, b, c))) and set(bucket) == set(range(7))
    assert packed.spread(np.empty(0, np.int64), [a[:0]]) is None


def expected_removals(rows, window=13):
    """rows of (doc_id, text)."""
    words = [re.findall(r"[^\x20\x09-\x0D]+", t or "") for _, t in rows]
    least = {}
    for (i, _), w in zip(rows, words):
        if i is not None:
            for k in range(len(w) - window + 1):
                key = tuple(w[k : k + window])
                least[key] = min(least.get(key, i), i)
    out = []
    for (i, _), w in zip(rows, words):
        gone = {k + j for k in range(len(w) - window + 1) if i is not None and least[tuple(w[k : k + window])] < i for j in range(window)}
        out.append((i, len(w), len(gone), [x for j, x in enumerate(w) if j not in gone], sorted(gone)))
    return out


def _passages(seed):
    rng = random.Random(seed)
    word = lambda: rng.choice(["Alpha", "alpha", "b", "cé", "\x00", "d,"]) + str(rng.randint(0, 30))
    shared = [[word() for _ in range(n)] for n in (12, 13, 14, 20, 27, 60)]
    rows = []
    for _ in range(80):
        parts = [w for _ in range(rng.randint(0, 4)) for w in (rng.choice(shared) if rng.random() < 0.5 else [word() for _ in range(rng.randint(1, 30))])]
        rows.append((rng.randint(-20, 200), rng.choice([" ", "\n", " \t "]).join(parts)))
    return [*rows, (1, None), (2, ""), (None, " ".join(shared[5])), (None, None), (3, "x " * 100), (4, "x " * 30), (5, "x " * 13), (6, "x " * 12), rows[0], rows[0]]


@pytest.mark.parametrize(("seed", "hot"), [(1, {}), (2, {"sample": 1, "share": 5000, "least": 2}), (3, {"sample": 2, "share": 1000, "least": 5}), (4, {})])
def test_removals(spark, seed, hot):
    rows = _passages(seed)
    df = spark.createDataFrame([(i, t, 1, "y") for i, t in rows], "doc_id long, text string, gone int, at string").repartition(3)
    want = expected_removals(rows)
    assert any(0 < w[2] < w[1] for w in want)
    digest = Counter((i, n, k, hashlib.sha256(" ".join(kept).encode()).hexdigest()) for i, n, k, kept, _ in want)
    assert Counter(map(tuple, anchors.remove_repeats(df, **hot).collect())) == digest
    assert Counter(map(tuple, anchors.remove_repeats(df, "text", **hot).collect())) == Counter((i, n, k, " ".join(kept)) for i, n, k, kept, _ in want)
    spans = defaultdict(set)
    for r in anchors.remove_repeats(df, "spans", **hot).collect():
        assert r.end_word - r.start_word >= 13
        spans[r.doc_id] |= set(range(r.start_word, r.end_word))
    merged = defaultdict(set)
    for i, *_, gone in want:
        merged[i] |= set(gone)
    assert {i: x for i, x in merged.items() if x} == spans


def test_removals_at_every_offset(spark):
    """A window is found however it lies to the blocks of the other document."""
    passage = [f"p{k}" for k in range(13)]
    rows = [(100 * a + b + 1, " ".join([*(f"u{a}x{b}x{k}" for k in range(a)), *passage, f"e{a}x{b}"])) for a in range(14) for b in (0, 50)]
    got = {r.doc_id: r.n_removed for r in anchors.remove_repeats(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == {i: 13 * (i > 1) for i, _ in rows}


def test_very_long_texts(spark):
    """Ten megabytes in one text, of which the second half repeats the first of another."""
    half = " ".join(f"w{k * 7919 % 1000003}" for k in range(600_000))
    rows = [(1, half + " " + "a b " * 5), (2, "start " + half), (3, "short text")]
    df = spark.createDataFrame([(i, t, "en") for i, t in rows], "doc_id long, text string, lang string")
    got = {r.doc_id: (r.n_words, r.n_removed) for r in anchors.remove_repeats(df).collect()}
    assert got == {1: (600_010, 0), 2: (600_001, 600_000), 3: (2, 0)}
    assert phrases.collocations(df, support=2, top=None).where("phrase LIKE 'w%'").groupBy("a").count().collect() == [(2, 600_000 - 2)]


@pytest.mark.skipif(not SF.exists(), reason="no test tables")
@pytest.mark.parametrize("name", sorted(queries.ORACLE_SQL))
def test_same_rows_as_sql(spark, name):
    con = duckdb.connect()
    for f in SF.glob("*.parquet"):
        con.sql(f"CREATE VIEW {f.stem} AS SELECT * FROM '{f}'")
    df, rel = queries.QUERIES[name](spark, str(SF)), con.sql(queries.ORACLE_SQL[name])
    assert sorted(df.columns) == sorted(rel.columns)
    at = [rel.columns.index(c) for c in df.columns]
    assert sorted(map(repr, map(tuple, df.collect()))) == sorted(repr(tuple(r[i] for i in at)) for r in rel.fetchall())
