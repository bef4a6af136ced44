"""Language-model scores by logistic context mixing of hashed-context bit predictors."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import tokens
from .graph import cut
from .quality import held_out
from .scratch import Scratch

#: Bytes of context of the longest predictor, and of the longest whose counts every task has: 256**3 numbers at most.
ORDER, SHARED = 6, 2
#: Stands before and after each text; no byte of UTF-8.
EDGE = 0xFF
#: Prior of a bit count.
PRIOR = 0.1
BUCKETS = 33
#: Distinct grams of a cell: contexts are hashed into cells, whose number follows the distinct grams.
CELL, FEWEST_CELLS = 60_000, 32
#: Synchronised steps of the mixer's pass over all cells.
ROUNDS = 8
#: Curvature that a bit has at least, what is added for a weight's prior, and the largest change of a weight in a step.
CURVE, RIDGE, STEP = 0.02, 20.0, 0.1
#: Distinct grams (12 bytes each) up to which their costs are broadcast; beyond it they are joined by a shuffle.
BROADCAST_GRAMS = 8_000_000
#: Bytes of text in a chunk whose words are looked up together.
CHUNK = 16 << 20
#: Words in so many chunks are joined by a broadcast while they are few.
HOT_CHUNKS, BROADCAST_WORDS = 64, 1_000_000
#: The end of a text as a token.
END = np.uint64(0)
_CUT = 11.0
_GATES = (ORDER + 2) * 4 * 8
#: Totals of contexts from which a gate differs.
_STRONG = (2, 4, 16)
#: Sums over cells are integers, in units of this share of all training grams, so that no order of adding matters.
_UNIT = 2.0**40


def _packed(x: np.ndarray, n: int) -> np.ndarray:
    """x[i], ..., x[i + n - 1] as the bytes of one number, for each i; by doubling."""
    size = max(0, len(x) - n + 1)
    out, done, width = None, 0, 1
    while done < n:
        if n & width:
            # The parts are laid out from the last byte backwards.
            at = n - done - width
            part = x[at : at + size] << np.uint64(8 * done)
            out = part if out is None else out | part
            done += width
        if done < n:
            x = (x[:-width] << np.uint64(8 * width)) | x[width:]
            width *= 2
    return out


def grams(raw: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each byte and end of the lower-cased texts: the bytes of context before it and itself, as a number; bounds per text."""
    size = np.diff(at)
    place = at + (ORDER + 1) * np.arange(len(at))
    full = np.full(int(place[-1]), EDGE, np.uint8)
    # Each text comes after ORDER edges and is followed by its end.
    before, end = (place[:-1, None] + np.arange(ORDER)).ravel(), place[1:] - 1
    own = np.ones(len(full), bool)
    own[before] = own[end] = False
    full[own] = tokens._LOWER[raw]
    own[end] = True
    return _packed(full.astype(np.uint64), ORDER + 1)[own[ORDER:]], at + np.arange(len(at))


def bits(gram: np.ndarray) -> np.ndarray:
    return ((gram & np.uint64(0xFF)).astype(np.int64)[:, None] >> np.arange(7, -1, -1)) & 1


def _squash(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-x))


@dataclass(frozen=True)
class Mixer:
    """Weights per gate (longest context seen, its total, bit number) and order, and an adaptive probability map per bit node and bucket."""

    weights: np.ndarray
    refine: np.ndarray


def _prefix_counts(key: np.ndarray, n: np.ndarray) -> list[np.ndarray]:
    """For 0 to 8 leading bits of the last byte of sorted keys: the sum of n over the keys that agree up to there."""
    total, out = np.concatenate([[0], np.cumsum(n)]), []
    for b in range(9):
        prefix = key >> np.uint64(8 - b)
        bound = np.append(np.flatnonzero(np.concatenate([[True], prefix[1:] != prefix[:-1]])), len(key))
        out.append(np.repeat(np.diff(total[bound]), np.diff(bound)))
    return out


class Shared:
    """Counts of the contexts of up to SHARED bytes: for each order, sorted keys and the counts of their prefixes."""

    def __init__(self, key: np.ndarray, n: np.ndarray):
        self.key, self.count = [], []
        for k in range(SHARED + 1):
            own, place = np.unique(key & np.uint64((1 << 8 * (k + 1)) - 1), return_inverse=True)
            self.key.append(own)
            self.count.append(_prefix_counts(own, np.bincount(place, n, len(own)).astype(np.int64)))


def predictions(gram: np.ndarray, n: np.ndarray, shared: Shared, without: int) -> tuple[np.ndarray, np.ndarray]:
    """Log odds of a one (orders x 8 bits x grams) and totals of the predictors that code the last byte of each gram, high bit first.

    gram: sorted distinct grams; of a context with more than SHARED bytes, either all grams of the corpus are there or none.  n: their
    training counts.  without: occurrences of the gram itself that are taken out of the counts.
    """
    odds, totals = (np.empty((ORDER + 1, 8, len(gram)), np.float32) for _ in range(2))
    sign = np.where(bits(gram).T == 1, np.float32(1), np.float32(-1))
    for k in range(ORDER + 1):
        key = gram & np.uint64((1 << 8 * (k + 1)) - 1)
        if k <= SHARED:
            place, count = np.searchsorted(shared.key[k], key), shared.count[k]
        else:
            order = np.argsort(key, kind="stable")
            place, count = np.empty(len(gram), np.int64), _prefix_counts(key[order], n[order])
            place[order] = np.arange(len(gram))
        for b in range(8):
            miss, hit = (count[b] - count[b + 1]).astype(np.float32), (count[b + 1] - without).clip(0).astype(np.float32)
            prior = np.float32(PRIOR)
            odds[k, b] = np.log((hit + prior) / (miss + prior))[place] * sign[b]
            totals[k, b] = (hit + miss)[place]
    return odds, totals


def _gates(totals: np.ndarray) -> np.ndarray:
    """Weight set of each bit (8 x grams): its number, the longest context that has been seen, and how often."""
    longest, most = np.zeros(totals.shape[1:], np.int64), np.zeros(totals.shape[1:], np.float32)
    for k in range(ORDER + 1):
        seen = totals[k] > 0
        longest[seen] = k + 1
        most = np.where(seen, totals[k], most)
    return (longest * 4 + np.digitize(most, _STRONG)) * 8 + np.arange(8)[:, None]


def _mix(mixer: Mixer, odds: np.ndarray, gate: np.ndarray, node: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Mixed logit, bucket of the probability map, and the refined probability of a one."""
    logit = np.zeros(gate.shape)
    for k in range(ORDER + 1):
        logit += odds[k] * mixer.weights[:, k][gate]
    logit = logit.clip(-_CUT, _CUT)
    bucket = np.rint((logit + _CUT) * ((BUCKETS - 1) / (2 * _CUT))).astype(np.int64)
    p = _squash(logit)
    return logit, bucket, 0.5 * p + 0.5 * (mixer.refine[node, bucket] * (1 - 1e-5) + 5e-6)


def _nodes(gram: np.ndarray) -> np.ndarray:
    """The bits of the symbol before each bit (8 x grams), after a leading one."""
    return (((gram & np.uint64(0xFF)).astype(np.int64)[:, None] | 256) >> (8 - np.arange(8))).T


def costs(gram: np.ndarray, n: np.ndarray, shared: Shared, mixer: Mixer) -> np.ndarray:
    """log10 probability of the last byte of each gram after the bytes before it."""
    odds, totals = predictions(gram, n, shared, 0)
    p = _mix(mixer, odds, _gates(totals), _nodes(gram))[2]
    return np.log10(np.where(bits(gram).T == 1, p, 1 - p)).sum(0)


#: What a step gathers: gradients, upper triangle of curvatures, and the map's counts and ones.
_PAIRS = [(i, j) for i in range(ORDER + 1) for j in range(i + 1)]
_SIZES = (_GATES * (ORDER + 1), _GATES * len(_PAIRS), 256 * BUCKETS, 256 * BUCKETS)


def gathered(gram: np.ndarray, n: np.ndarray, shared: Shared, mixer: Mixer) -> np.ndarray:
    """Sums over the training grams of a cell, each predicted from the counts without itself."""
    odds, totals = predictions(gram, n, shared, 1)
    seen = n > 0
    gram, odds, totals, weight = gram[seen], odds[:, :, seen], totals[:, :, seen], np.tile(n[seen].astype(float), 8)
    gate, node = _gates(totals), _nodes(gram)
    logit, bucket, _ = _mix(mixer, odds, gate, node)
    p, bit = _squash(logit).ravel(), bits(gram).T.ravel()
    gate, x = gate.ravel(), odds.reshape(ORDER + 1, -1)
    error, curve = (bit - p) * weight, np.maximum(p * (1 - p), CURVE) * weight
    gradient = [np.bincount(gate, error * x[k], _GATES) for k in range(ORDER + 1)]
    curves = []
    for i in range(ORDER + 1):
        part = curve * x[i]
        curves += [np.bincount(gate, part * x[j], _GATES) for j in range(i + 1)]
    place = node.ravel() * BUCKETS + bucket.ravel()
    map_ = [np.bincount(place, w, 256 * BUCKETS) for w in (weight, weight * bit)]
    return np.concatenate([*gradient, *curves, *map_])


def _count_grams(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """text, weight to gram, n: how often a gram occurs in the texts of the partition, by their weights; 0 where it is in held-out ones only.

    Merged as it grows, so memory follows the distinct grams.
    """
    found: list[tuple[np.ndarray, np.ndarray]] = []
    size = 0

    def merged() -> tuple[np.ndarray, np.ndarray]:
        gram, n = (np.concatenate([x[i] for x in found]) for i in (0, 1))
        order = np.argsort(gram, kind="stable")
        gram, n = gram[order], n[order]
        first = np.flatnonzero(np.concatenate([[True], gram[1:] != gram[:-1]]))
        return gram[first], np.add.reduceat(n, first)

    def flushed() -> Iterator[pa.RecordBatch]:
        gram, n = merged()
        for i in range(0, len(gram), 100_000):
            yield pa.RecordBatch.from_arrays([pa.array(gram[i : i + 100_000].view(np.int64)), pa.array(n[i : i + 100_000])], ["gram", "n"])

    for batch in batches:
        (raw, at), weight = tokens.buffers(batch.column(0)), batch.column(1).to_numpy()
        for a, b in tokens.blocks(at, 1 << 20):
            key, bound = grams(raw[at[a] : at[b]], at[a : b + 1] - at[a])
            own = np.repeat(weight[a:b], np.diff(bound))
            for each in np.unique(weight[a:b]):
                gram, n = np.unique(key[own == each], return_counts=True)
                found.append((gram, n * each))
                size += len(gram)
            if size > 3_000_000:
                found = [merged()]
                size = len(found[0][0])
                if size > 1_500_000:
                    yield from flushed()
                    found, size = [], 0
    if found:
        yield from flushed()


def _pack(key: tuple, table: pa.Table) -> pa.Table:
    """The grams of a cell in order, and their counts, as two binary values."""
    gram, n = table.column("gram").to_numpy().view(np.uint64), table.column("n").to_numpy()
    order = np.argsort(gram)
    binary = lambda x: pa.array([np.ascontiguousarray(x[order]).tobytes()], pa.binary())
    return pa.table({"round": pa.array([key[1].as_py()], pa.int32()), "grams": binary(gram), "counts": binary(n)})


def _cells(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    for batch in batches:
        for gram, n in zip(batch.column(0), batch.column(1), strict=True):
            yield np.frombuffer(gram.as_buffer(), np.uint64), np.frombuffer(n.as_buffer(), np.int64)


@dataclass(frozen=True)
class Model:
    """packed: all grams by cells (round, grams, counts); what tasks need besides them; distinct: how many grams there are."""

    packed: DataFrame
    shared: Shared
    mixer: Mixer
    distinct: int


def train(texts: DataFrame, scratch: Scratch, rounds: int = ROUNDS) -> Model:
    """Counts of all contexts and the mixer, from the texts(text, weight) of weight above 0.

    Gram counts are summed over the whole corpus by a shuffle and stay distributed, by cells of contexts; nothing is hashed into a
    table of fixed size.  There is one mixer: in each of the rounds, all grams of a share of the cells are predicted with the
    weights reached so far, their gradients and curvatures are added up as integers, and the driver makes an online Newton
    step.  The result doesn't depend on how rows or cells are dealt out.  The driver gets sums of fixed size.
    """
    spark = texts.sparkSession
    found = scratch.table(texts.select("text", "weight").mapInArrow(_count_grams, "gram long, n long").groupBy("gram").agg(F.sum("n").alias("n")), batch=1000)
    distinct, total = found.agg(F.count("*"), F.coalesce(F.sum("n"), F.lit(0))).head()
    low = found.groupBy(F.col("gram").bitwiseAND((1 << 8 * (SHARED + 1)) - 1).alias("low")).agg(F.sum("n").alias("n")).toArrow()
    shared = Shared(low.column(0).to_numpy().view(np.uint64), low.column(1).to_numpy())
    cells = max(FEWEST_CELLS, -(-distinct // CELL))
    # The contexts of more than SHARED bytes that a gram takes part in are all in its cell.
    context = F.shiftright("gram", 8).bitwiseAND((1 << 8 * (SHARED + 1)) - 1)
    cell = F.pmod(F.xxhash64(context), F.lit(cells))
    dealt = found.select(cell.cast("int").alias("cell"), (cell % rounds).cast("int").alias("round"), "gram", "n")
    packed = scratch.table(dealt.groupBy("cell", "round").applyInArrow(_pack, "round int, grams binary, counts binary"), ["round"])
    told = spark.sparkContext.broadcast(shared)
    middle = _squash(np.linspace(-_CUT, _CUT, BUCKETS))
    mixer = Mixer(np.full((_GATES, ORDER + 1), 1.2 / (ORDER + 1)), np.tile(middle, (256, 1)))
    map_ = np.zeros((2, 256, BUCKETS))

    def step(now: Mixer) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            sums = np.zeros(sum(_SIZES), np.int64)
            for gram, n in _cells(batches):
                sums += np.rint(gathered(gram, n, told.value, now) * (_UNIT / total)).astype(np.int64)
            at = np.flatnonzero(sums)
            yield pa.RecordBatch.from_arrays([pa.array(at.astype(np.int32)), pa.array(sums[at])], ["at", "v"])

        return run

    curves = np.zeros((_GATES, ORDER + 1, ORDER + 1))
    for r in range(rounds if total else 0):
        sums = np.zeros(sum(_SIZES))
        got = packed.where(F.col("round") == r).select("grams", "counts").mapInArrow(step(mixer), "at int, v long").groupBy("at").agg(F.sum("v").alias("v")).toArrow()
        sums[got.column(0).to_numpy()] = got.column(1).to_numpy() * (total / _UNIT)
        gradient, curve, seen, ones = np.split(sums, np.cumsum(_SIZES)[:-1])
        for (i, j), c in zip(_PAIRS, curve.reshape(len(_PAIRS), _GATES), strict=True):
            curves[:, i, j] += c
            if i != j:
                curves[:, j, i] += c
        change = np.linalg.solve(curves + RIDGE * np.eye(ORDER + 1), gradient.reshape(ORDER + 1, _GATES).T[:, :, None])[:, :, 0]
        mixer = Mixer(mixer.weights + change.clip(-STEP, STEP), mixer.refine)
        map_ += np.stack([seen.reshape(256, BUCKETS), ones.reshape(256, BUCKETS)])
    told.unpersist()
    return Model(packed, shared, Mixer(mixer.weights, (map_[1] + 30 * middle) / (map_[0] + 30)), distinct)


def priced(model: Model) -> DataFrame:
    """gram, cost (log10, single precision) of every gram that occurs in a text."""
    told = model.packed.sparkSession.sparkContext.broadcast((model.shared, model.mixer))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for gram, n in _cells(batches):
            cost = costs(gram, n, *told.value).astype(np.float32)
            for i in range(0, len(gram), 100_000):
                yield pa.RecordBatch.from_arrays([pa.array(gram[i : i + 100_000].view(np.int64)), pa.array(cost[i : i + 100_000])], ["gram", "cost"])

    return model.packed.select("grams", "counts").mapInArrow(run, "gram long, cost float")


def _blocks(table: pa.Table) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Bytes and offsets of blocks of the texts of a chunk, in order."""
    for batch in table.to_batches():
        raw, at = tokens.buffers(batch.column(batch.schema.get_field_index("text")))
        for a, b in tokens.blocks(at, 1 << 20):
            yield raw[at[a] : at[b]], at[a : b + 1] - at[a]


def _chunk_words(key: tuple, table: pa.Table) -> pa.Table:
    """chunk, weight, text to chunk, word, n: distinct words of the chunk and how often they occur, by the weights of texts."""
    words, counts = [], []
    for batch in table.to_batches():
        weights = batch.column(batch.schema.get_field_index("weight")).to_numpy()
        for start, end, w in tokens.text_blocks(batch.column(batch.schema.get_field_index("text")), 1 << 20):
            own, place = np.unique(w.hash, return_inverse=True)
            times = np.bincount(place, np.repeat(weights[start:end], np.diff(w.first)), len(own)) if len(own) else np.empty(0)
            words += [own, np.array([END])]
            counts += [times.astype(np.int64), np.array([weights[start:end].sum()])]
    word, place = np.unique(np.concatenate(words), return_inverse=True)
    n = np.bincount(place, np.concatenate(counts), len(word)).astype(np.int64)
    return pa.table({"chunk": pa.array(np.full(len(word), key[0].as_py(), np.int64)), "word": pa.array(word.view(np.int64)), "n": pa.array(n)})


def _chunk_grams(key: tuple, table: pa.Table) -> pa.Table:
    """chunk, text to chunk, gram: the distinct grams of the chunk."""
    own = np.unique(np.concatenate([np.unique(grams(*x)[0]) for x in _blocks(table)]))
    return pa.table({"chunk": pa.array(np.full(len(own), key[0].as_py(), np.int64)), "gram": pa.array(own.view(np.int64))})


def _lookup(sorted_keys: np.ndarray, values: np.ndarray, keys: np.ndarray) -> np.ndarray:
    """values at keys, 0 where a key is absent."""
    if not len(sorted_keys):
        return np.zeros(len(keys), values.dtype)
    own, place = np.unique(keys, return_inverse=True)
    at = np.searchsorted(sorted_keys, own).clip(max=len(sorted_keys) - 1)
    return np.where(sorted_keys[at] == own, values[at], 0)[place]


class Prices:
    """Costs of grams by two tables of hashes.  Every gram asked for is known, so a slot that one gram alone falls into needs no comparison."""

    _ODD = (np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F))

    def __init__(self, gram: np.ndarray, cost: np.ndarray):
        """gram: sorted."""
        self.gram, self.cost, self.tables, self.shift = gram, cost, [], []
        left = np.arange(len(gram), dtype=np.int32)
        for odd in self._ODD:
            shift = np.uint64(64 - max(16, int(2 * len(left)).bit_length()))
            slot = ((gram[left] * odd) >> shift).view(np.int64)
            table = np.full(1 << int(64 - shift), np.nan, np.float32)
            alone = np.bincount(slot, minlength=1)[slot] == 1
            table[slot[alone]] = cost[left[alone]]
            left = left[~alone]
            self.tables.append(table)
            self.shift.append(shift)

    def at(self, key: np.ndarray) -> np.ndarray:
        out = self.tables[0].take(((key * self._ODD[0]) >> self.shift[0]).view(np.int64))
        miss = np.flatnonzero(out != out)
        own = key[miss]
        second = self.tables[1].take(((own * self._ODD[1]) >> self.shift[1]).view(np.int64))
        rest = np.flatnonzero(second != second)
        second[rest] = self.cost[np.searchsorted(self.gram, own[rest])]
        out[miss] = second
        return out


def _counted(words: DataFrame, counts: DataFrame) -> DataFrame:
    """chunk, word, c; a word of very many chunks is joined by a broadcast, so that no task gets all its rows."""
    hot = counts.where(F.col("chunks") >= HOT_CHUNKS).select("word", F.col("c").alias("hot"))
    few = hot.count()
    if not 0 < few <= BROADCAST_WORDS:
        return words.join(counts, "word").select("chunk", "word", "c")
    tried = words.join(F.broadcast(hot), "word", "left")
    cold = tried.where("hot is null").join(counts.where(F.col("chunks") < HOT_CHUNKS), "word").select("chunk", "word", "c")
    return tried.where("hot is not null").select("chunk", "word", F.col("hot").alias("c")).union(cold)


def score_documents(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text", parts: int = 7, broadcast_grams: int = BROADCAST_GRAMS) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score, bits_per_byte; one row for each row of docs.

    Learns from the rows whose crc32 of the id as text modulo 7 is not 2 and scores the whole text of every row.  The base is an add-one
    unigram model over words and an end.  The model codes the lower-cased bytes and an end mark bit by bit: predictors of order
    0 to 6 with the counts of their contexts, kept by context hashes; a gated logistic mix learnt online without the coded gram
    itself; an adaptive probability map.  Its parts are then fixed, so score is the log10 probability of the text under one
    distribution, whatever the partitions.

    Null and empty texts consist of the end alone.  A row with a null id is learnt from.  Repeated rows count and are scored each.  Without any training row, counts are 0 and the model is uniform.  Ids are cast to long.  A very long text is worked
    on as a block of its own.  Other columns of docs are not looked at; an empty table gives an empty result.
    """
    spark = docs.sparkSession
    texts = docs.select(F.col(id_column).cast("long").alias("doc_id"), F.coalesce(F.col(text_column).cast("string"), F.lit("")).alias("text"))
    # Rows without an id are told apart by nothing but their text; equal ones are worked on once.
    nameless = texts.where("doc_id is null").groupBy("doc_id", "text").agg(F.count("*").alias("times"))
    texts = texts.where("doc_id is not null").withColumn("times", F.lit(1).cast("long")).union(nameless)
    texts = texts.withColumn("weight", F.when(held_out(F.col("doc_id"), parts), F.lit(0)).otherwise(F.col("times")))
    chunks = max(1, -(-int(texts.agg(F.coalesce(F.sum(F.octet_length("text").cast("long")), F.lit(0))).head()[0]) // CHUNK))
    texts = texts.withColumn("chunk", F.pmod(F.xxhash64("doc_id", F.crc32("text")), F.lit(chunks)))
    with Scratch(spark) as scratch:
        model = train(texts, scratch)
        words = scratch.table(texts.select("chunk", "weight", "text").groupBy("chunk").applyInArrow(_chunk_words, "chunk long, word long, n long"))
        counts = scratch.table(words.groupBy("word").agg(F.sum("n").alias("c"), F.count("*").alias("chunks")).where("c > 0"))
        total, distinct = counts.agg(F.coalesce(F.sum("c"), F.lit(0)), F.count("*")).head()
        known = _counted(words, counts).select("chunk", F.lit(True).alias("is_word"), F.col("word").alias("key"), F.col("c").cast("double").alias("value"))
        prices, shared = priced(model), None
        if model.distinct <= broadcast_grams:
            rows = prices.toArrow()
            order = np.argsort(gram := rows.column(0).to_numpy().view(np.uint64))
            shared = spark.sparkContext.broadcast((gram[order], rows.column(1).to_numpy()[order]))
            del rows, gram, order
        else:
            own = texts.select("chunk", "text").groupBy("chunk").applyInArrow(_chunk_grams, "chunk long, gram long")
            known = known.union(own.join(prices, "gram").select("chunk", F.lit(False).alias("is_word"), F.col("gram").alias("key"), F.col("cost").cast("double").alias("value")))
        below = np.log10(float(total + distinct + 1))

        def score(key: tuple, own: pa.Table, found: pa.Table) -> pa.Table:
            key_, value, is_word = (found.column(c).to_numpy() for c in ("key", "value", "is_word"))
            key_ = key_.view(np.uint64)
            order = np.flatnonzero(is_word)
            order = order[np.argsort(key_[order])]
            known, c = key_[order], value[order]
            end = float(_lookup(known, c, np.array([END]))[0])
            if shared is None:
                order = np.flatnonzero(~is_word)
                order = order[np.argsort(key_[order])]
                price = Prices(key_[order], value[order].astype(np.float32))
            else:
                price = _prices(shared)
            columns: list[list[np.ndarray]] = [[] for _ in range(5)]
            for block, bound in _blocks(own):
                w = tokens.words(block, bound)
                times = _lookup(known, c, w.hash)
                sums = np.zeros((2, len(times) + 1))
                np.cumsum(np.log10(times + 1.0), out=sums[0, 1:])
                np.cumsum(times > 0, out=sums[1, 1:])
                base, hits = sums[:, w.first[1:]] - sums[:, w.first[:-1]]
                n = np.diff(w.first) + 1
                gram, place = grams(block, bound)
                cost = np.add.reduceat(price.at(gram), place[:-1], dtype=np.float64)
                for column_, x in zip(columns, (n, (hits + (end > 0)).astype(np.int64), base + np.log10(end + 1.0) - n * below, cost, np.diff(place)), strict=True):
                    column_.append(x)
            n, hits, base, cost, size = (np.concatenate(x) if x else np.empty(0) for x in columns)
            return pa.table({"doc_id": own.column("doc_id"), "times": own.column("times"), "n_tokens": n.astype(np.int64), "n_known": hits.astype(np.int64), "base_score": base.astype(float), "score": cost.astype(float), "bits_per_byte": -cost * np.log2(10) / np.maximum(size, 1)})

        scored = texts.select("chunk", "doc_id", "times", "text").groupBy("chunk").cogroup(known.groupBy("chunk")).applyInArrow(score, "doc_id long, times long, n_tokens long, n_known long, base_score double, score double, bits_per_byte double")
        scored = scored.withColumn("time", F.explode(F.sequence(F.lit(1), "times")))
        return cut(scored.select("doc_id", held_out(F.col("doc_id"), parts).alias("held_out"), "n_tokens", "n_known", F.lit(total).cast("long").alias("train_tokens"), "base_score", "score", "bits_per_byte"))


_made: list = [None, None]


def _prices(shared: Broadcast) -> Prices:
    """The tables of the broadcast costs, made once in a worker."""
    if _made[0] is not shared.value:
        _made[:] = [shared.value, Prices(*shared.value)]
    return _made[1]
