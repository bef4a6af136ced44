"""Repeated passages by fixed-block anchors."""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import packed, tokens
from .graph import cut
from .scratch import Scratch, arrow_rows, tidy

#: Words of the shortest repeat.  Any such window holds a whole block at a multiple of BLOCK, since 2 * BLOCK - 1 is not above it.
WINDOW = 13
BLOCK = (WINDOW + 1) // 2
#: One of so many documents is looked at for sequences that are frequent enough to weigh on one bucket.
SAMPLE = 64
#: A sequence is frequent if it has more than one of so many words of the sample, and at least HOT_LEAST of its occurrences are there.
HOT_SHARE, HOT_LEAST = 100_000, 64

#: Seeds of the two 64-bit hashes that name a window.
_SECOND = np.uint64(0xA24BAED4963EE407)
_NONE = np.iinfo(np.int64).max


def _blocks(column: pa.Array) -> Iterator[tuple[int, int, tokens.Words]]:
    return tokens.text_blocks(column, lower=False)


def _starts(w: tokens.Words, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Word positions at which a sequence of so many words of one text begins, and its text."""
    n = np.diff(w.first)
    text = np.repeat(np.arange(len(n)), n)
    at = np.arange(max(0, len(w.hash) - size + 1))
    at = at[text[at] == text[at + size - 1]]
    return at, text[at]


def _windows(w: tokens.Words) -> tuple[np.ndarray, np.ndarray]:
    """Two hashes of the window at each position (those across texts mean nothing)."""
    return tokens.run_hash(w.hash, WINDOW), tokens.run_hash(tokens.mix(w.hash ^ _SECOND), WINDOW)


def _within(values: np.ndarray, ordered: np.ndarray) -> np.ndarray:
    if not len(ordered):
        return np.zeros(len(values), bool)
    return ordered[np.minimum(np.searchsorted(ordered, values), len(ordered) - 1)] == values


def _frequent(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """text to size, hash, n: occurrences of blocks (first hash) and windows (first hash) in a batch."""
    for batch in batches:
        for _, _, w in _blocks(batch.column(0)):
            for size, hashes in ((BLOCK, tokens.run_hash(w.hash, BLOCK)), (WINDOW, tokens.run_hash(w.hash, WINDOW))):
                key, n = np.unique(hashes[_starts(w, size)[0]], return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(key), size, np.int32)), pa.array(key.view(np.int64)), pa.array(n)], ["size", "hash", "n"])


def _probes(n: int, hot: np.ndarray) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """doc_id, text to packs of every rolling sequence of a block's length: 48 bits of its hash, document, position, and whether it is a block."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = batch.column(0).to_numpy()
            for start, _, w in _blocks(batch.column(1)):
                at, text = _starts(w, BLOCK)
                hashes = tokens.run_hash(w.hash, BLOCK)[at]
                cold = ~_within(hashes, hot)
                at, text, hashes = at[cold], text[cold], hashes[cold]
                pos = at - w.first[text]
                # The lowest bit of a position's double tells whether it is a block.
                mark = (pos * 2 + (pos % BLOCK == 0)).astype(np.uint32)
                low, high = hashes.astype(np.uint32), (hashes >> np.uint64(32)).astype(np.uint16)
                out = packed.spread(packed.bucket_of(hashes, n), [low, high, ids[start + text], mark])
                if out is not None:
                    yield out

    return run


def _by_document(kind: type, name: str) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Packs of documents and values to doc and the bytes of all its values."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        doc, values = packed.gather(batches, [np.int64, kind])
        order, begin = packed.groups([doc])
        doc, values = doc[order], values[order]
        ends = np.append(begin[1:], len(doc))
        for i in range(0, len(begin), 1000):
            own = slice(i, i + 1000)
            pieces = [values[s:e].tobytes() for s, e in zip(begin[own].tolist(), ends[own].tolist())]
            yield pa.RecordBatch.from_arrays([pa.array(doc[begin[own]]), pa.array(pieces, pa.binary())], ["doc_id", name])

    return run


def _to_documents(n: int, doc: np.ndarray, values: np.ndarray) -> Iterator[pa.RecordBatch]:
    """Packs of values by their document's bucket, in order of documents."""
    order = np.argsort(doc, kind="stable")
    doc, values = doc[order], values[order]
    out = packed.spread(packed.bucket_of(tokens.mix(doc.view(np.uint64)), n), [doc, values])
    if out is not None:
        yield out


def _hits(n: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """A bucket's probes to documents and positions whose sequence is a block of a smaller document, and blocks that a larger document holds."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        low, high, doc, mark = packed.gather(batches, [np.uint32, np.uint16, np.int64, np.uint32])
        if not len(low):
            return
        order, begin = packed.groups([high.astype(np.uint64) << np.uint64(32) | low])
        doc, mark = doc[order], mark[order]
        block = (mark & 1).astype(bool)
        size = np.diff(np.append(begin, len(doc)))
        least = np.repeat(np.minimum.reduceat(np.where(block, doc, _NONE), begin), size)
        most = np.repeat(np.maximum.reduceat(doc, begin), size)
        hit = (least < doc) | (block & (most > doc))
        yield from _to_documents(n, doc[hit], (mark[hit] >> 1).astype(np.int32))

    return run


def _reduced(a: np.ndarray, b: np.ndarray, doc: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Each window once, with its least document."""
    order, begin = packed.groups([a, b])
    return (a[order][begin], b[order][begin], np.minimum.reduceat(doc[order], begin)) if len(a) else (a, b, doc)


def _candidates(n: int, hot: np.ndarray, hot_windows: np.ndarray) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """doc_id, text, hits to packs of the windows around hits: both hashes and the document.

    Of a frequent window a task gives the least document only.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        often = [np.empty(0, kind) for kind in _WINDOW]
        for batch in batches:
            ids, lists = batch.column(0).to_numpy(), batch.column(2)
            for start, end, w in _blocks(batch.column(1)):
                hit = np.zeros(len(w.hash) + 1, bool)
                hit[: max(0, len(w.hash) - BLOCK + 1)] = _within(tokens.run_hash(w.hash, BLOCK), hot)
                for i in range(start, end):
                    at = np.frombuffer(lists[i].as_py() or b"", np.int32)
                    hit[w.first[i - start] + at[at < w.first[i - start + 1] - w.first[i - start]]] = True
                # A window holds the hits at its first WINDOW - BLOCK + 1 positions.
                total = np.concatenate([[0], np.cumsum(hit)])
                at, text = _starts(w, WINDOW)
                near = total[at + WINDOW - BLOCK + 1] > total[at]
                at, text = at[near], text[near]
                a, b = (h[at] for h in _windows(w))
                doc = ids[start + text]
                hold = _within(a, hot_windows)
                often = _reduced(*[np.concatenate([x, y[hold]]) for x, y in zip(often, (a, b, doc))])
                out = packed.spread(packed.bucket_of(a[~hold], n), [a[~hold], b[~hold], doc[~hold]])
                if out is not None:
                    yield out
        out = packed.spread(packed.bucket_of(often[0], n), often)
        if out is not None:
            yield out

    return run


_WINDOW = [np.uint64, np.uint64, np.int64]


def _repeats(n: int, hot_windows: np.ndarray) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """A bucket's windows to documents and the first hashes of windows that a smaller document has.

    Bucket n has the frequent windows, by both hashes, with their least document.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        a, b, doc = packed.gather(batches, _WINDOW)
        if not len(a):
            return
        hold = _within(a, hot_windows)
        often = _reduced(a[hold], b[hold], doc[hold])
        out = packed.spread(np.full(len(often[0]), n), often)
        if out is not None:
            yield out
        order, begin = packed.groups([a[~hold], b[~hold]])
        a, doc = a[~hold][order], doc[~hold][order]
        least = np.repeat(np.minimum.reduceat(doc, begin), np.diff(np.append(begin, len(doc)))) if len(a) else doc
        gone = doc > least
        yield from _to_documents(n, doc[gone], a[gone])

    return run


def _spans(w: tokens.Words, i: int, gone: np.ndarray, own: np.ndarray) -> np.ndarray:
    """Bounds of text i's maximal stretches of words to remove, as pairs of positions in the text."""
    begin, end = w.first[i], w.first[i + 1]
    if end - begin < WINDOW or not len(gone):
        return np.empty((0, 2), np.int64)
    at = np.flatnonzero(np.isin(own, gone))
    if not len(at):
        return np.empty((0, 2), np.int64)
    new = np.flatnonzero(np.concatenate([[True], at[1:] > at[:-1] + WINDOW]))
    return np.stack([at[new], at[np.append(new[1:], len(at)) - 1] + WINDOW], 1)


def _cleaned(hot: list[tuple[np.ndarray, np.ndarray, np.ndarray]], kind: str) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """doc_id, text, gone to a row for each text, or for each repeat.  hot: frequent windows (both hashes, ascending and distinct by the first, least document)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, lists = batch.column(0).to_pylist(), batch.column(2)
            raw, at = tokens.buffers(batch.column(1))
            for start, end in tokens.blocks(at):
                own = raw[at[start] : at[end]]
                w = tokens.words(own, at[start : end + 1] - at[start], lower=False)
                a, b = _windows(w)
                rows = []
                for i in range(end - start):
                    doc = ids[start + i]
                    size = max(0, int(w.first[i + 1] - w.first[i]) - WINDOW + 1)
                    inner = slice(w.first[i], w.first[i] + size)
                    gone = np.frombuffer(lists[start + i].as_py() or b"", np.uint64)
                    if doc is not None and size:
                        for fa, fb, fd in hot:
                            if len(fa):
                                k = np.minimum(np.searchsorted(fa, a[inner]), len(fa) - 1)
                                gone = np.concatenate([gone, a[inner][(fa[k] == a[inner]) & (fb[k] == b[inner]) & (fd[k] < doc)]])
                    spans = _spans(w, i, gone, a[inner])
                    if kind == "spans":
                        rows += [(doc, int(s), int(e)) for s, e in spans]
                        continue
                    keep = np.ones(w.first[i + 1] - w.first[i], bool)
                    for s, e in spans:
                        keep[s:e] = False
                    take = np.flatnonzero(keep) + w.first[i]
                    text = b" ".join(own[s:e].tobytes() for s, e in zip(w.begin[take].tolist(), w.close[take].tolist()))
                    rows.append((doc, len(keep), int(len(keep) - keep.sum()), text.decode() if kind == "text" else hashlib.sha256(text).hexdigest()))
                if rows:
                    names = ["doc_id", "start_word", "end_word"] if kind == "spans" else ["doc_id", "n_words", "n_removed", "kept"]
                    kinds = [pa.int64(), pa.int64(), pa.int64(), pa.large_string() if kind == "text" else pa.string()]
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), kinds)], names)

    return run


def remove_repeats(docs: DataFrame, kind: str = "digest", id_column: str = "doc_id", text_column: str = "text", sample: int = SAMPLE, share: int = HOT_SHARE, least: int = HOT_LEAST) -> DataFrame:
    """Words covered by a window of 13 words that also starts in a document with a smaller id.

    kind "digest": doc_id, n_words, n_removed, kept_sha256 for each row; "text": the kept words, joined by a blank, in place of the digest;
    "spans": doc_id, start_word, end_word (exclusive) of each maximal stretch that is removed.

    Words are runs other than blanks, unchanged.  Each document's blocks of 7 words at positions 0, 7, 14 ... are the reference; every rolling
    sequence of 7 words is probed against them, in buckets of hashes.  A window of 13 words holds a whole block wherever it lies, so each
    repeat has a hit on both sides.  Hits are extended to the windows around them, which are told apart by two 64-bit hashes, and each window
    is held against the least document that has it; windows that overlap or touch make a maximal repeat.  Texts are judged on the input.

    A sequence that is frequent in one of so many documents (sample, share, least: bounds on how many there are) isn't put into a bucket: blocks
    count as hits, windows are first reduced to the least document of each batch.  Which sequences these are changes no result.

    Null ids are neither judged nor held against others; null texts have no words.  Rows that repeat an id are judged alike, against smaller ids
    only; each has a row.  Texts below 13 words keep all.  A very long text is a block of its own, never cut.  Ids are cast to long; other
    columns are not looked at.  An empty table gives no rows.
    """
    spark = docs.sparkSession
    # An id that isn't a number is null, and so neither judged nor held against others.
    texts = docs.select(F.col(id_column).try_cast("long").alias("doc_id"), F.coalesce(F.col(text_column).cast("string"), F.lit("")).alias("text"))
    known = texts.where("doc_id is not null")
    n = packed.buckets(packed.estimated_words(texts, "text"), int(spark.conf.get("spark.sql.shuffle.partitions")))
    with Scratch(spark) as scratch, arrow_rows(spark, 500), tidy(spark):
        some = known.where(F.pmod(F.xxhash64("doc_id"), F.lit(sample)) == 0).select("text").mapInArrow(_frequent, "size int, hash long, n long")
        counts = scratch.table(some.groupBy("size", "hash").agg(F.sum("n").alias("n")))
        total = counts.where(f"size = {BLOCK}").agg(F.sum("n")).head()[0] or 0
        # At most `share` of either size.
        hot = counts.where(F.col("n") >= max(least, total // share)).toPandas()
        blocks, windows = (np.sort(hot["hash"][hot["size"] == size].to_numpy(np.int64).view(np.uint64)) for size in (BLOCK, WINDOW))
        probes = known.mapInArrow(_probes(n, blocks), packed.SCHEMA)
        hits = packed.exchange(packed.exchange(probes, n).mapInArrow(_hits(n), packed.SCHEMA), n).mapInArrow(_by_document(np.int32, "at"), "doc_id long, at binary")
        hits = scratch.table(hits)
        around = known.join(hits, "doc_id", "left").select("doc_id", "text", "at").mapInArrow(_candidates(n, blocks, windows), packed.SCHEMA)
        found = scratch.table(packed.exchange(around, n).mapInArrow(_repeats(n, windows), packed.SCHEMA))
        # As many rows as there are frequent windows, so at most `share`.
        packs = found.where(F.col("bucket") == n).toArrow().to_batches()
        a, b, least_doc = packed.gather(iter(packs), _WINDOW)
        order = np.lexsort((b, a))
        a, b, least_doc = a[order], b[order], least_doc[order]
        # Windows with the same first hash, if there ever are any, go into further look-ups.
        nth = np.arange(len(a)) - np.searchsorted(a, a)
        often = [tuple(x[nth == k] for x in (a, b, least_doc)) for k in range(int(nth.max(initial=-1)) + 1)]
        gone = scratch.table(packed.exchange(found.where(F.col("bucket") < n), n).mapInArrow(_by_document(np.uint64, "gone"), "doc_id long, gone binary"))
        whole = texts.join(gone, "doc_id", "left").select("doc_id", "text", "gone")
        schema = "doc_id long, start_word long, end_word long" if kind == "spans" else "doc_id long, n_words long, n_removed long, kept string"
        return cut(whole.mapInArrow(_cleaned(often, kind), schema).withColumnsRenamed({"kept": "text" if kind == "text" else "kept_sha256"}), batch=500)


#: The same rows in SQL; meant for tables with distinct ids.
ORACLE = f"""
WITH d AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^ \\t-\\r]+') AS w FROM documents),
g AS (SELECT doc_id, w, unnest(generate_series(1, len(w) - {WINDOW - 1})) AS i FROM d WHERE len(w) >= {WINDOW}),
k AS (SELECT doc_id, i, array_to_string(w[i:i + {WINDOW - 1}], ' ') AS s FROM g),
m AS (SELECT doc_id, i, min(doc_id) OVER (PARTITION BY s) < doc_id AS gone FROM k),
r AS (SELECT DISTINCT doc_id, unnest(generate_series(i, i + {WINDOW - 1})) AS i FROM m WHERE gone),
l AS (SELECT doc_id, list(i) AS gone FROM r GROUP BY doc_id),
e AS (SELECT d.doc_id, d.w, coalesce(l.gone, []) AS gone FROM d LEFT JOIN l USING (doc_id))
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(len(gone) AS BIGINT) AS n_removed,
    sha256(coalesce(array_to_string([x FOR x, i IN w IF NOT list_contains(gone, i)], ' '), '')) AS kept_sha256
FROM e"""
