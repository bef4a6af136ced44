"""MinHash near-duplicate detection with sequential Bayesian verification."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import lru_cache
from math import comb

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import tokens
from .graph import components, cut, keep_ids, link_buckets, release

SHINGLE = 5
#: A link needs 100 * intersection >= PERCENT * union.
PERCENT = 75
#: Hash functions; of each minimum a byte is kept as signature, which differs for all but 1 of 256 unequal minima.
HASHES = 512
#: Bands and their rows: a pair at the threshold meets in one of them but for (1 - 0.75**6)**64 = 4e-6.
BANDS, ROWS = 64, 6
#: Signature values compared before the next pruning decision.
BATCH = 64
#: A candidate is pruned once its posterior probability of reaching the threshold is below this.
MISS = 1e-5


@lru_cache(maxsize=1)
def _family() -> tuple[np.ndarray, np.ndarray]:
    n = HASHES
    seeds = tokens.mix(np.arange(1, 2 * n + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))
    odd = (seeds >> np.uint64(32)).astype(np.uint32) | np.uint32(1)
    return odd[:n], odd[n:]


def signatures(values: np.ndarray, bound: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Signatures (texts x HASHES, uint8) and band keys (texts x BANDS) of the sets values[bound[i]:bound[i + 1]]."""
    p, q = _family()
    out = np.full((len(bound) - 1, len(p)), 0xFFFFFFFF, np.uint32)
    full = np.flatnonzero(np.diff(bound))
    if len(full):
        low, high = values.astype(np.uint32), (values >> np.uint64(32)).astype(np.uint32)
        starts, work, more = bound[full], np.empty_like(low), np.empty_like(low)
        for j in range(len(p)):
            np.multiply(low, p[j], out=work)
            np.multiply(high, q[j], out=more)
            work += more
            out[full, j] = np.minimum.reduceat(work, starts)
    keys = np.tile(np.arange(1, BANDS + 1, dtype=np.uint64), (len(out), 1))
    for j in range(ROWS):
        keys = tokens.mix(keys) + out[:, j : BANDS * ROWS : ROWS]
    return ((out * np.uint32(0x9E3779B1)) >> np.uint32(24)).astype(np.uint8), tokens.mix(keys)


def _binary(matrix: np.ndarray) -> pa.Array:
    """One binary value per row."""
    size = matrix.shape[1] * matrix.itemsize
    return pa.Array.from_buffers(pa.binary(), len(matrix), [None, pa.py_buffer(np.arange(0, size * len(matrix) + 1, size, dtype=np.int32)), pa.py_buffer(np.ascontiguousarray(matrix))])


def _describe(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """doc_id, text to doc_id, number of shingles, two set hashes, signature, band keys."""
    for batch in batches:
        ids = batch.column(0)
        for start, end, w in tokens.text_blocks(batch.column(1), 1 << 19):
            values, bound = tokens.distinct(*tokens.shingles(w, SHINGLE))
            n = np.diff(bound)
            sums = []
            for salt in (1, 2):
                total = np.zeros(len(values) + 1, np.uint64)
                np.cumsum(tokens.mix(values + np.uint64(salt)), out=total[1:])
                sums.append((total[bound[1:]] - total[bound[:-1]]).view(np.int64))
            sig, keys = signatures(values, bound)
            keys = pa.ListArray.from_arrays(np.arange(0, keys.size + 1, BANDS, dtype=np.int32), keys.ravel().view(np.int64))
            yield pa.RecordBatch.from_arrays([ids.slice(start, end - start), pa.array(n), pa.array(sums[0]), pa.array(sums[1]), _binary(sig), keys], ["doc_id", "n", "k1", "k2", "sig", "bands"])


@lru_cache(maxsize=8)
def fewest_matches(percent: int = PERCENT, miss: float = MISS) -> tuple[int, ...]:
    """For 64, 128, ... compared values: the fewest matches with which P(similarity >= threshold | matches) >= miss.

    With a uniform prior the posterior is Beta(m + 1, n - m + 1), whose upper tail at t is P(Binomial(n + 1, t) <= m).
    """
    t, out = percent / 100, []
    for n in range(BATCH, HASHES + 1, BATCH):
        tail = 0.0
        for m in range(n + 1):
            tail += comb(n + 1, m) * t**m * (1 - t) ** (n + 1 - m)
            if tail >= miss:
                break
        out.append(m)
    return tuple(out)


def _as_matrix(column: pa.Array) -> np.ndarray:
    raw, _ = tokens.buffers(column)
    return raw.reshape(len(column), HASHES)


def _prune(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """a, b, signatures of both, sizes of both, in either order: pairs that may reach the threshold."""
    need = fewest_matches()
    for batch in batches:
        x, y = _as_matrix(batch.column(2)), _as_matrix(batch.column(3))
        small, large = (f(batch.column(4).to_numpy(), batch.column(5).to_numpy()) for f in (np.minimum, np.maximum))
        left = np.flatnonzero(100 * small >= PERCENT * large)
        same = np.zeros(len(left), np.int64)
        for step, least in enumerate(need):
            part = slice(step * BATCH, (step + 1) * BATCH)
            same += (x[left, part] == y[left, part]).sum(1)
            alive = same >= least
            left, same = left[alive], same[alive]
        yield batch.select([0, 1]).take(pa.array(left))


def _confirm(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """a, b, text of a, text of b: pairs whose full shingle sets reach the threshold."""
    for batch in batches:
        good = np.zeros(batch.num_rows, bool)
        for start in range(0, batch.num_rows, 64):
            part = batch.slice(start, 64)
            sets = []
            for c in (2, 3):
                own: list[np.ndarray] = []
                for _, _, w in tokens.text_blocks(part.column(c)):
                    values, bound = tokens.distinct(*tokens.shingles(w, SHINGLE))
                    own += [values[bound[i] : bound[i + 1]] for i in range(len(bound) - 1)]
                sets.append(own)
            for i, (x, y) in enumerate(zip(*sets, strict=True)):
                both = len(np.intersect1d(x, y, assume_unique=True))
                good[start + i] = both and 100 * both >= PERCENT * (len(x) + len(y) - both)
        yield batch.select([0, 1]).filter(pa.array(good))


def _sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """doc_id, text to doc_id, hash: a row for each distinct shingle."""
    for batch in batches:
        ids = batch.column(0).to_numpy()
        for start, end, w in tokens.text_blocks(batch.column(1), 1 << 19):
            values, bound = tokens.distinct(*tokens.shingles(w, SHINGLE))
            yield pa.RecordBatch.from_arrays([pa.array(np.repeat(ids[start:end], np.diff(bound))), pa.array(values.view(np.int64))], ["id", "hash"])


#: Links (16 bytes each) up to which one task finds their components.
LOCAL_LINKS = 1_000_000


def _union(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """a, b to id, comp: the least id reachable; by hooking roots onto lesser ones and halving paths."""
    links = [np.stack([b.column(i).to_numpy() for i in (0, 1)]) for b in batches if b.num_rows]
    if not links:
        return
    ids, place = np.unique(np.concatenate(links, axis=1), return_inverse=True)
    a, b = place.reshape(2, -1)
    root = np.arange(len(ids))
    while True:
        x, y = root[a], root[b]
        if (x == y).all():
            break
        np.minimum.at(root, np.maximum(x, y), np.minimum(x, y))
        while (root != root[root]).any():
            root = root[root]
    for i in range(0, len(ids), 100_000):
        yield pa.RecordBatch.from_arrays([pa.array(ids[i : i + 100_000]), pa.array(ids[root[i : i + 100_000]])], ["id", "comp"])


def linked(links: DataFrame, most: int = LOCAL_LINKS) -> DataFrame:
    """(id, comp) of materialised links(a, b): up to so many links in one task, without the shuffles of rounds; beyond it distributed."""
    if links.count() > most:
        return components(links)
    return links.select("a", "b").coalesce(1).mapInArrow(_union, "id long, comp long")


#: Longs of a two-bit sketch, and the differing values beyond which a pair is pruned: at the threshold a value differs with probability
#: (1 - 0.75) * 3 / 4, and so many do with probability below MISS.
LONGS = HASHES // 32
_DIFFER = next(d for d in range(HASHES) if sum(comb(HASHES, k) * 0.1875**k * 0.8125 ** (HASHES - k) for k in range(d + 1, HASHES + 1)) < MISS)
_LOW = "6148914691236517205"  # every other bit


def _sketch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """id, n, sig to id, n, sig, the two lowest bits of the signature's bytes as longs."""
    names = ["id", "n", "sig", *[f"s{i}" for i in range(LONGS)]]
    for batch in batches:
        two = _as_matrix(batch.column(2)) & np.uint8(3)
        packed = (two[:, 0::4] | (two[:, 1::4] << 2) | (two[:, 2::4] << 4) | (two[:, 3::4] << 6)).view(np.int64)
        yield pa.RecordBatch.from_arrays([*batch.columns, *[pa.array(packed[:, i]) for i in range(LONGS)]], names)


def _possible(x: Callable[[str], Column], y: Callable[[str], Column]) -> Column:
    """What both sides alone say about a pair: sizes, shingles that others have too, and two-bit sketches."""
    shared, total = F.least(x("c"), y("c")), x("n") + y("n")
    differ = F.lit(0)
    for i in range(LONGS):
        bits = x(f"s{i}").bitwiseXOR(y(f"s{i}"))
        differ = differ + F.bit_count(bits.bitwiseOR(F.shiftrightunsigned(bits, 1)).bitwiseAND(F.expr(f"{_LOW}L")))
    return (100 * shared >= PERCENT * (total - shared)) & (differ <= _DIFFER)


def near_duplicates(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """Near-duplicate groups of whole texts: doc_id, n_shingles, component_id, kept; one row for each row of docs.

    Sets of distinct five-word shingles (shorter texts: the whole sequence) are linked when 100 * intersection >= 75 * union.
    Equal sets are collapsed first.  The rest are banded by MinHash, candidate pairs pass through a sequential Bayesian test on
    batches of 64 signature values (pruned at a posterior below 1e-5), and survivors are confirmed on full sets of 64-bit
    shingle hashes.  In large buckets, pairs are not even made where set sizes, shingles that no other candidate has, or
    two-bit sketches rule a link out.  component_id is the smallest id reachable over links, kept marks that document.

    Null and empty texts and texts without words: n_shingles 0, linked with nothing, kept.  A row with a null id: component_id
    null and kept.  Ids must be integers; an id that occurs in several rows gives several rows, each linked through its own
    text.  Other columns of docs are not looked at.
    """
    texts = docs.select(F.col(id_column).cast("long").alias("doc_id"), F.col(text_column).cast("string").alias("text"))
    seen = cut(texts.mapInArrow(_describe, "doc_id long, n long, k1 long, k2 long, sig binary, bands array<long>"))
    least = F.min(F.struct(F.col("doc_id").alias("id"), "sig", "bands")).alias("first")
    first = cut(seen.where("n > 0 and doc_id is not null").groupBy("k1", "k2", "n").agg(least).select("k1", "k2", "n", "first.*"), 10_000)
    classes, reps = first.select("k1", "k2", "n", "id"), first.select("id", "n", "sig")
    light = cut(seen.select("doc_id", "n", "k1", "k2"), 10_000)
    del seen
    release(docs.sparkSession)

    def verify(pairs: DataFrame, sifted: bool) -> DataFrame:
        own = lambda x: reps.select(F.col("id").alias(x), F.col("sig").alias(f"sig_{x}"), F.col("n").alias(f"n_{x}"))
        both = pairs.join(own("a"), "a").join(own("b"), "b").select("a", "b", "sig_a", "sig_b", "n_a", "n_b") if not sifted else None
        likely = cut(both.mapInArrow(_prune, "a long, b long") if both is not None else pairs)
        del both
        release(docs.sparkSession)
        involved = cut(likely.select(F.explode(F.array("a", "b")).alias("id")).distinct())
        some = cut(keep_ids(texts.where("doc_id is not null"), "doc_id", involved, "id", involved.count()))
        of = lambda x: some.select(F.col("doc_id").alias(x), F.col("text").alias(f"text_{x}"))
        # Two whole texts a row: small batches.
        return cut(likely.join(of("b"), "b").join(of("a"), "a").select("a", "b", "text_a", "text_b").mapInArrow(_confirm, "a long, b long"), 32)

    def sift(pairs: DataFrame) -> DataFrame:
        return pairs.select("a", "b", "ta.sig", F.col("tb.sig").alias("sig_b"), "ta.n", F.col("tb.n").alias("n_b")).mapInArrow(_prune, "a long, b long")

    def traits(ids: DataFrame) -> DataFrame:
        """n: set size; c: shingles that another of these ids has too; s0, ...: sketch; sig: signature."""
        some = keep_ids(texts.where("doc_id is not null"), "doc_id", ids, "id", ids.count())
        sets = some.mapInArrow(_sets, "id long, hash long")
        alone = sets.groupBy("hash").agg(F.min("id").alias("id"), F.max("id").alias("other")).where("id = other").groupBy("id").agg(F.count("*").alias("alone"))
        sketches = reps.join(ids, "id", "left_semi").mapInArrow(_sketch, "id long, n long, sig binary, " + ", ".join(f"s{i} long" for i in range(LONGS)))
        own = sketches.join(alone, "id", "left").withColumn("c", F.col("n") - F.coalesce("alone", F.lit(0)))
        # A set of which others have less than the threshold can't be linked.
        return own.where(100 * F.col("c") >= PERCENT * F.col("n")).select("id", (F.col("c") / F.col("n")).alias("rank"), F.struct("n", "c", *[f"s{i}" for i in range(LONGS)], "sig").alias("traits"))

    labels = link_buckets(first.select(F.explode("bands").alias("key"), "id"), verify, traits, _possible, sift, join=linked)
    found = light.join(classes, ["k1", "k2", "n"], "left")
    found = found.join(labels, "id", "left")
    component = F.when(F.col("n") == 0, F.col("doc_id")).otherwise(F.coalesce("comp", "id"))
    component = F.when(F.col("doc_id").isNotNull(), component)
    return found.select("doc_id", F.col("n").alias("n_shingles"), component.alias("component_id"), F.coalesce(F.col("doc_id") == component, F.lit(True)).alias("kept"))
