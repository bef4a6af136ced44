"""Collocations by vertical position bitmaps."""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from . import packed, tokens
from .graph import cut
from .scratch import Scratch, arrow_rows, tidy

#: Occurrences that a candidate needs, words of the longest one, phrases reported of each language.
SUPPORT, LONGEST, TOP = 10, 3, 2000
#: A candidate goes if a longer one around it has so many percent of its occurrences.
COVERED = 50
#: Stands for a missing language.
UNKNOWN = "und"

#: Bytes that end a piece, and those that stand between words.
_ENDS = np.zeros(256, bool)
_ENDS[[*b".,;:!?", *range(0x0A, 0x0E)]] = True
_BETWEEN = _ENDS.copy()
_BETWEEN[[0x20, 0x09]] = True
#: Positions in a block of a bitmap, as a power of two; blocks without a set bit are left out.
_SHIFT = 3
#: Rows of prefixes that are extended at once.
_AT_ONCE = 50_000
#: Bits of the broadcast filters; with more words or pairs than fit they let more through, which changes no count.
FILTER_BITS = 1 << 26


@dataclass
class Bitmaps:
    """Bitmaps of several words or phrases: rows (name, block, bits), no two with the same name and block."""

    name: np.ndarray
    block: np.ndarray
    bits: np.ndarray

    def shifted(self) -> Bitmaps:
        """Each bit one position further on."""
        wide = self.bits.astype(np.uint32) << 1
        top = np.uint32(1 << (1 << _SHIFT))
        stay, over = (wide & (top - np.uint32(1))) != 0, (wide & top) != 0
        name, block = np.concatenate([self.name[stay], self.name[over]]), np.concatenate([self.block[stay], self.block[over] + 1])
        bits = np.concatenate([wide[stay] & (top - np.uint32(1)), np.ones(over.sum(), np.uint32)])
        return Bitmaps(*_united(name, block, bits))


def _united(name: np.ndarray, block: np.ndarray, bits: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Rows of one name and block made one, ordered by both."""
    order, begin = packed.groups([name, block])
    if not len(order):
        return name, block, bits.astype(np.uint8)
    return name[order][begin], block[order][begin], np.bitwise_or.reduceat(bits[order], begin).astype(np.uint8)


class Shard:
    """The words of some texts on one axis of positions, with a gap wherever a piece ends, and a bitmap for each word.

    word: key of each occurrence; position: its place on the axis.
    """

    def __init__(self, word: np.ndarray, position: np.ndarray):
        self.words, own = np.unique(word, return_inverse=True)
        block = position >> _SHIFT
        bits = np.uint32(1) << (position & ((1 << _SHIFT) - 1)).astype(np.uint32)
        self.maps = Bitmaps(*_united(own, block, bits))
        # The same rows by block, for the words that may follow.
        order = np.argsort(self.maps.block, kind="stable")
        self._name, self._bits = self.maps.name[order], self.maps.bits[order]
        last = int(self.maps.block.max()) + 2 if len(order) else 1
        self._at = np.searchsorted(self.maps.block[order], np.arange(last + 1))

    def extend(self, prefixes: Bitmaps) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, Bitmaps]]:
        """Prefixes (ordered by name), some at a time, to (prefix, word, count, bitmaps by number of the extension)."""
        start = 0
        while start < len(prefixes.name):
            end = min(start + _AT_ONCE, len(prefixes.name))
            # All rows of a prefix go together.
            end = int(np.searchsorted(prefixes.name, prefixes.name[end - 1], "right"))
            own = slice(start, end)
            moved = Bitmaps(prefixes.name[own], prefixes.block[own], prefixes.bits[own]).shifted()
            start = end
            low, n = self._at[moved.block], self._at[moved.block + 1] - self._at[moved.block]
            row = np.repeat(np.arange(len(n)), n)
            at = np.arange(len(row)) - np.repeat(np.cumsum(n) - n, n) + np.repeat(low, n)
            both = moved.bits[row] & self._bits[at]
            hit = np.flatnonzero(both)
            row, both, word = row[hit], both[hit], self._name[at[hit]]
            if not len(row):
                continue
            prefix = moved.name[row]
            order, begin = packed.groups([prefix * np.int64(len(self.words)) + word])
            bits = both[order]
            count = np.add.reduceat(np.bitwise_count(bits).astype(np.int64), begin)
            number = np.repeat(np.arange(len(begin)), np.diff(np.append(begin, len(order))))
            yield prefix[order][begin], word[order][begin], count, Bitmaps(number, moved.block[row][order], bits)


def _slots(keys: np.ndarray) -> np.ndarray:
    return (keys & np.uint64(FILTER_BITS - 1)).astype(np.int64)


def _pair(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return tokens.mix(a * np.uint64(0x9FB21C651E98DF25) + b)


def _within(keys: np.ndarray, filter_: np.ndarray) -> np.ndarray:
    at = _slots(keys)
    return (filter_[at >> 3] >> (at & 7).astype(np.uint8) & 1).astype(bool)


def _filter(df: DataFrame, slot: Column) -> np.ndarray:
    """A table of FILTER_BITS bits, one set for each slot; a row of it for each 4096 slots reaches the driver, 8 MB in all."""
    near = df.select(slot.alias("slot")).distinct().groupBy(F.expr("slot div 4096").cast("int").alias("row"))
    out = np.zeros(FILTER_BITS // 8, np.uint8)

    def folded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            packs = []
            for slots in batch.column(1):
                bits = np.zeros(4096, np.uint8)
                bits[np.asarray(slots.values)] = 1
                packs.append(np.packbits(bits, bitorder="little").tobytes())
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(packs, pa.binary())], ["row", "bits"])

    rows = near.agg(F.collect_list((F.col("slot") % 4096).cast("int")).alias("slots")).mapInArrow(folded, "row int, bits binary")
    for r in rows.toLocalIterator():
        out[r["row"] * 512 : (r["row"] + 1) * 512] = np.frombuffer(r["bits"], np.uint8)
    return out


def _language(column: pa.Array) -> np.ndarray:
    """A hash of each text's language."""
    raw, at = tokens.buffers(column)
    known: dict[bytes, int] = {}
    names = [raw[i:j].tobytes() for i, j in zip(at[:-1].tolist(), at[1:].tolist())]
    for name in set(names):
        known[name] = int.from_bytes(hashlib.blake2b(name, digest_size=8).digest(), "little")
    return np.array([known[name] for name in names], np.uint64)


def _occurrences(batch: pa.RecordBatch) -> Iterator[tuple[int, int, np.ndarray, tokens.Words, np.ndarray, np.ndarray]]:
    """lang, text to (start, end, bytes, words, key of each, position of each); keys tell words of different languages apart."""
    langs, (raw, at) = _language(batch.column(0)), tokens.buffers(batch.column(1))
    for start, end in tokens.blocks(at):
        own, bounds = raw[at[start] : at[end]], at[start : end + 1] - at[start]
        w = tokens.words(own, bounds, between=_BETWEEN)
        n = np.diff(w.first)
        keys = tokens.mix(w.hash ^ np.repeat(langs[start:end], n))
        ends = np.concatenate([[0], np.cumsum(_ENDS[own])])[w.begin] + np.repeat(np.arange(len(n)), n)
        gaps = np.zeros(len(ends), np.int64)
        gaps[1:] = np.cumsum(ends[1:] != ends[:-1])
        yield start, end, own, w, keys, np.arange(len(ends)) + gaps


def _vocabulary(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """lang, text to lang, word, key, n: words of a batch."""
    for batch in batches:
        langs = batch.column(0)
        for start, _, raw, w, keys, _ in _occurrences(batch):
            key, first, n = np.unique(keys, return_index=True, return_counts=True)
            text = np.searchsorted(w.first, first, "right") - 1
            low = tokens.lower(raw)
            words = [low[b:e].tobytes().decode() for b, e in zip(w.begin[first].tolist(), w.close[first].tolist())]
            yield pa.RecordBatch.from_arrays([langs.take(pa.array(start + text)).cast(pa.string()), pa.array(words, pa.string()), pa.array(key.view(np.int64)), pa.array(n)], ["lang", "word", "key", "n"])


def _counted(n: int, length: int, words: np.ndarray, pairs: np.ndarray | None) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """lang, text to packs of phrases of so many words with their counts in the shard: words' keys and n.

    words, pairs: filters of what can be part of a candidate at all.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for *_, keys, position in _occurrences(batch):
                keep = _within(keys, words)
                shard = Shard(keys[keep], position[keep])
                found: list[list[np.ndarray]] = []
                for a, b, count, maps in shard.extend(shard.maps):
                    ka, kb = shard.words[a], shard.words[b]
                    if length == 2:
                        found.append([ka, kb, count])
                        continue
                    may = _within(_pair(ka, kb), pairs)
                    rows = may[maps.name]
                    for ab, c, count3, _ in shard.extend(Bitmaps(maps.name[rows], maps.block[rows], maps.bits[rows])):
                        kc = shard.words[c]
                        ok = _within(_pair(kb[ab], kc), pairs)
                        found.append([ka[ab][ok], kb[ab][ok], kc[ok], count3[ok]])
                if not found:
                    continue
                *phrase, count = (np.concatenate(x) for x in zip(*found))
                # Within a pack phrases are ordered, so that their first planes compress.
                order = np.lexsort(tuple(reversed(phrase)))
                mixed = phrase[0]
                for k in phrase[1:]:
                    mixed = _pair(mixed, k)
                out = packed.spread(packed.bucket_of(mixed, n)[order], [*(k[order] for k in phrase), count[order].astype(np.uint32)])
                if out is not None:
                    yield out

    return run


def _summed(length: int, support: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """A bucket's packs to w1, w2, (w3,) a: phrases with enough occurrences over all shards."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        *phrase, count = packed.gather(batches, [np.uint64] * length + [np.uint32])
        if not len(count):
            return
        order, begin = packed.groups(phrase)
        total = np.add.reduceat(count[order].astype(np.int64), begin)
        take = np.flatnonzero(total >= support)
        at = order[begin[take]]
        names = [f"w{i + 1}" for i in range(length)] + ["a"]
        for i in range(0, len(take), 50_000):
            own = slice(i, i + 50_000)
            yield pa.RecordBatch.from_arrays([*(pa.array(k[at[own]].view(np.int64)) for k in phrase), pa.array(total[take[own]])], names)

    return run


def _score(a: str, left: str, right: str) -> Column:
    """floor(1000000 * a * a / (left * right)), exactly for counts below 10**15; no more than 1000000, since a is no more than either."""
    return F.expr(f"(CAST(1000000 AS DECIMAL(7)) * (CAST({a} AS DECIMAL(15)) * CAST({a} AS DECIMAL(15)))) div (CAST({left} AS DECIMAL(15)) * CAST({right} AS DECIMAL(15)))")


def collocations(docs: DataFrame, lang_column: str = "lang", text_column: str = "text", support: int = SUPPORT, covered: int = COVERED, top: int | None = TOP) -> DataFrame:
    """lang, rank, phrase, a, l, r, n, score: phrases of two or three words by how far their parts stick together.

    Texts are lower-cased (A-Z), taken apart at ``. , ; : ! ?`` and line ends into pieces and at blanks and tabs into words.  A shard, some megabytes
    of texts, lays its words out on an axis of positions with a gap between pieces.  Each word has a bitmap of its positions, of which only
    blocks with a set bit are kept.  A phrase is extended by shifting its bitmap by one and cutting it with those of the words that follow; set bits
    are occurrences, overlaps included.  Two-word phrases are extended to three words before the next prefixes are looked at.  Counts are summed
    over shards.

    Words and pairs with too few occurrences are part of no candidate and left out by filters of a fixed size.  A phrase is scored by its worst cut
    (the first of equals); one that a longer candidate covers (in so many percent of its occurrences, covered) goes.  Per language the first
    `top` remain (all if None), by score and occurrences descending, then by phrase.

    A null language is ``und``; null and empty texts have no words.  Repeated rows count as often as they occur.  Other columns are not looked at.  A
    very long text makes a shard of its own.  Words are named by 64-bit hashes of word and language; should two ever share one, this raises.  An empty table
    gives no rows.
    """
    spark = docs.sparkSession
    texts = docs.select(F.coalesce(F.col(lang_column).cast("string"), F.lit(UNKNOWN)).alias("lang"), F.coalesce(F.col(text_column).cast("string"), F.lit("")).alias("text"))
    least = int(spark.conf.get("spark.sql.shuffle.partitions"))
    with Scratch(spark) as scratch, arrow_rows(spark, 500), tidy(spark):
        seen = texts.mapInArrow(_vocabulary, "lang string, word string, key long, n long")
        words = scratch.table(seen.groupBy("key").agg(F.sum("n").alias("f"), F.min(F.struct("lang", "word")).alias("low"), F.max(F.struct("lang", "word")).alias("high")))
        if words.where("low <> high").head(1):
            raise ValueError("two words share a 64-bit hash")
        sizes = words.groupBy("low.lang").agg(F.sum("f").alias("n"))
        n = packed.buckets(words.agg(F.sum("f")).head()[0] or 0, least)
        frequent = words.where(F.col("f") >= support).select("key", "f", "low.lang", "low.word")
        filter_ = _filter(frequent, F.col("key").bitwiseAND(FILTER_BITS - 1))
        pairs = scratch.table(packed.exchange(texts.mapInArrow(_counted(n, 2, filter_, None), packed.SCHEMA), n).mapInArrow(_summed(2, support), "w1 long, w2 long, a long"))

        def slots(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                a, b = (batch.column(i).to_numpy().view(np.uint64) for i in (0, 1))
                yield pa.RecordBatch.from_arrays([pa.array(_slots(_pair(a, b)))], ["slot"])

        of_pairs = _filter(pairs.select("w1", "w2").mapInArrow(slots, "slot long"), F.col("slot"))
        triples = scratch.table(packed.exchange(texts.mapInArrow(_counted(n, 3, filter_, of_pairs), packed.SCHEMA), n).mapInArrow(_summed(3, support), "w1 long, w2 long, w3 long, a long"))
        word = lambda i: frequent.select(F.col("key").alias(f"w{i}"), F.col("f").alias(f"f{i}"), F.col("word").alias(f"s{i}"), F.col("lang").alias(f"lang{i}"))
        two = pairs.join(word(1), "w1").join(word(2), "w2")
        two = two.select("w1", "w2", F.col("lang1").alias("lang"), F.concat_ws(" ", "s1", "s2").alias("phrase"), "a", F.col("f1").alias("l"), F.col("f2").alias("r"))
        # Pairs that a candidate of three words covers.
        inside = triples.select("w1", "w2", F.col("a").alias("longer")).union(triples.select("w2", "w3", "a")).groupBy("w1", "w2").agg(F.max("longer").alias("longer"))
        two = two.join(inside, ["w1", "w2"], "left").where(f"longer IS NULL OR 100 * longer < {covered} * a").select("lang", "phrase", "a", "l", "r", _score("a", "l", "r").alias("score"))
        part = lambda i: pairs.select(F.col("w1").alias(f"w{i}"), F.col("w2").alias(f"w{i + 1}"), F.col("a").alias(f"p{i}"))
        three = triples.join(part(1), ["w1", "w2"]).join(part(2), ["w2", "w3"]).join(word(1), "w1").join(word(2), "w2").join(word(3), "w3")
        three = three.withColumn("c1", _score("a", "f1", "p2")).withColumn("c2", _score("a", "p1", "f3"))
        first = F.col("c1") <= F.col("c2")
        three = three.select(F.col("lang1").alias("lang"), F.concat_ws(" ", "s1", "s2", "s3").alias("phrase"), "a", F.when(first, F.col("f1")).otherwise(F.col("p1")).alias("l"), F.when(first, F.col("p2")).otherwise(F.col("f3")).alias("r"), F.least("c1", "c2").alias("score"))
        order = W.partitionBy("lang").orderBy(F.desc("score"), F.desc("a"), "phrase")
        ranked = two.unionByName(three).withColumn("rank", F.row_number().over(order))
        ranked = (ranked if top is None else ranked.where(F.col("rank") <= top)).withColumn("rank", F.col("rank").cast("long"))
        return cut(ranked.join(F.broadcast(sizes), "lang").select("lang", "rank", "phrase", "a", "l", "r", "n", "score"))


#: The same rows in SQL.
ORACLE = f"""
WITH p AS (SELECT lang, doc, unnest(range(len(ps))) AS piece, unnest(ps) AS s FROM (
    SELECT coalesce(lang, '{UNKNOWN}') AS lang, row_number() OVER () AS doc,
        regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\\n-\\r]') AS ps FROM documents)),
q AS (SELECT lang, doc, piece, regexp_extract_all(s, '[^ \\t]+') AS w FROM p),
u AS (SELECT lang, doc, piece, unnest(range(len(w))) AS i, unnest(w) AS w1 FROM q),
o AS (SELECT lang, w1, lead(w1) OVER x AS w2, lead(w1, 2) OVER x AS w3 FROM u WINDOW x AS (PARTITION BY doc, piece ORDER BY i)),
f1 AS (SELECT lang, w1, count(*) AS f FROM o GROUP BY ALL),
f2 AS (SELECT lang, w1, w2, count(*) AS f FROM o WHERE w2 IS NOT NULL GROUP BY ALL),
f3 AS (SELECT lang, w1, w2, w3, count(*) AS f FROM o WHERE w3 IS NOT NULL GROUP BY ALL HAVING count(*) >= {SUPPORT}),
n AS (SELECT lang, count(*) AS n FROM o GROUP BY lang),
c2 AS (SELECT c.lang, c.w1, c.w2, c.f AS a, a.f AS l, b.f AS r, 1000000::HUGEINT * c.f * c.f // (a.f::HUGEINT * b.f) AS score
    FROM f2 c JOIN f1 a ON a.lang = c.lang AND a.w1 = c.w1 JOIN f1 b ON b.lang = c.lang AND b.w1 = c.w2 WHERE c.f >= {SUPPORT}),
g AS (SELECT lang, w1, w2, max(f) AS f FROM (SELECT lang, w1, w2, f FROM f3 UNION ALL SELECT lang, w2, w3, f FROM f3) GROUP BY ALL),
s3 AS (SELECT c.lang, c.w1, c.w2, c.w3, c.f AS a, a.f AS l1, bc.f AS r1, ab.f AS l2, d.f AS r2, 1000000::HUGEINT * c.f * c.f // (a.f::HUGEINT * bc.f) AS k1,
    1000000::HUGEINT * c.f * c.f // (ab.f::HUGEINT * d.f) AS k2
    FROM f3 c JOIN f1 a ON a.lang = c.lang AND a.w1 = c.w1 JOIN f2 bc ON bc.lang = c.lang AND bc.w1 = c.w2 AND bc.w2 = c.w3
    JOIN f2 ab ON ab.lang = c.lang AND ab.w1 = c.w1 AND ab.w2 = c.w2 JOIN f1 d ON d.lang = c.lang AND d.w1 = c.w3),
a AS (SELECT c.lang, c.w1 || ' ' || c.w2 AS phrase, a, l, r, score FROM c2 c LEFT JOIN g ON g.lang = c.lang AND g.w1 = c.w1 AND g.w2 = c.w2 WHERE g.f IS NULL OR 100 * g.f < {COVERED} * a
    UNION ALL SELECT lang, w1 || ' ' || w2 || ' ' || w3, a, CASE WHEN k1 <= k2 THEN l1 ELSE l2 END, CASE WHEN k1 <= k2 THEN r1 ELSE r2 END, least(k1, k2) FROM s3),
k AS (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase COLLATE "binary") AS rank FROM a)
SELECT lang, rank, phrase, CAST(a AS BIGINT) AS a, CAST(l AS BIGINT) AS l, CAST(r AS BIGINT) AS r, CAST(n AS BIGINT) AS n, CAST(score AS BIGINT) AS score FROM k JOIN n USING (lang) WHERE rank <= {TOP}"""
