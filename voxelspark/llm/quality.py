"""Positive-unlabelled quality classifier: non-negative unbiased risk with an estimated class prior."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import tokens

#: Bounded samples that the model is fitted on; every row is scored.
POSITIVES, UNLABELLED = 6_000, 12_000
#: Score from which a document counts as good.
ACCEPT = 0.7
HASHED = 192
_DENSE = 14

#: Shape classes of bytes: letters and digits by kind, blanks, each ASCII sign by itself, all bytes of other scripts together.
_SHAPE = np.arange(256, dtype=np.int32)
_SHAPE[0x61:0x7B], _SHAPE[0x41:0x5B], _SHAPE[0x30:0x3A] = 0x61, 0x41, 0x30
_SHAPE[0x80:], _SHAPE[[0x09, 0x0B, 0x0C, 0x0D]] = 0x61, 0x20
_SLOT = {gap: (tokens.mix(np.arange(65536, dtype=np.uint64) + np.uint64(gap << 20)) % np.uint64(HASHED)).astype(np.int64) for gap in (1, 2)}
_KIND = np.full(256, 5)
_KIND[0x61:0x7B], _KIND[0x41:0x5B], _KIND[0x30:0x3A], _KIND[0x80:] = 0, 1, 2, 3
_KIND[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = 4
_KIND[[0x2C, 0x2E]] = 6


def _share(flags: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    total = np.zeros(len(flags) + 1)
    np.cumsum(flags, out=total[1:])
    return (total[end] - total[start]) / np.maximum(end - start, 1)


def features(column: pa.Array) -> np.ndarray:
    """One row of features per text, from the whole text; zeros and a constant for a text without bytes."""
    parts = []
    raw_all, at_all = tokens.buffers(column)
    for first, last in tokens.blocks(at_all, 1 << 20):
        raw, at = raw_all[at_all[first] : at_all[last]], at_all[first : last + 1] - at_all[first]
        w, n, size = tokens.words(raw, at), last - first, np.diff(at)
        doc = np.repeat(np.arange(n), size)
        kinds = np.bincount(doc * 7 + _KIND[raw], minlength=7 * n).reshape(n, 7) / np.maximum(size, 1)[:, None]
        # Pairs of shapes a byte and two bytes apart, within a text.
        shape = _SHAPE[raw]
        hashed = np.zeros(n * HASHED)
        for gap in (1, 2):
            inside = doc[gap:] == doc[:-gap]
            slot = _SLOT[gap][shape[gap:] * 256 + shape[:-gap]]
            hashed += np.bincount((doc[gap:] * HASHED + slot)[inside], minlength=n * HASHED)
        hashed = np.sqrt(hashed.reshape(n, HASHED) / np.maximum(size, 1)[:, None])
        start, end = w.first[:-1], w.first[1:]
        count = end - start
        again = np.zeros(len(w.hash), bool)
        again[1:] = w.hash[1:] == w.hash[:-1]
        again[start[count > 0]] = False
        _, bound = tokens.distinct(w.hash, w.first)
        _, pairs = tokens.distinct(*tokens.shingles(w, 3))
        rows = np.diff(pairs)
        dense = np.column_stack([
            kinds, np.log1p(size) / 10, np.log1p(count) / 10, size / np.maximum(count, 1) / 20,
            _share(again, start, end), np.diff(bound) / np.maximum(count, 1) ** 0.8, rows / np.maximum(count - 2, 1), size > 0,
        ])
        parts.append(np.hstack([dense, hashed]).astype(np.float32))
    return np.concatenate(parts) if parts else np.empty((0, _DENSE + HASHED), np.float32)


@dataclass(frozen=True)
class Model:
    """score = sigmoid(((x - mean) / scale) . weights + bias)."""

    mean: np.ndarray
    scale: np.ndarray
    weights: np.ndarray
    bias: float
    prior: float

    def score(self, x: np.ndarray) -> np.ndarray:
        z = ((x - self.mean) / self.scale).clip(-8, 8) @ self.weights + self.bias
        return 1 / (1 + np.exp(-z.clip(-40, 40)))


def _sigmoid(z: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-z.clip(-40, 40)))


def _descend(p: np.ndarray, u: np.ndarray, prior: float, steps: int, seed: int, ridge: float = 1e-4) -> tuple[np.ndarray, float]:
    """Minimise the non-negative unbiased risk (Kiryo et al. 2017) of a linear model with logistic loss by Adam on mini-batches.

    risk = prior * E_p[l(g)] + max(0, E_u[l(-g)] - prior * E_p[l(-g)]); where the second part is negative, its gradient is turned round.
    """
    rng, d = np.random.default_rng(seed), p.shape[1] + 1
    p, u = np.hstack([p, np.ones((len(p), 1))]), np.hstack([u, np.ones((len(u), 1))])
    w, m, v = np.zeros(d), np.zeros(d), np.zeros(d)
    for t in range(1, steps + 1):
        a, b = p[rng.integers(0, len(p), 512)], u[rng.integers(0, len(u), 1024)]
        ga, gb = a @ w, b @ w
        rest = np.logaddexp(0, gb).mean() - prior * np.logaddexp(0, ga).mean()
        grad_rest = (_sigmoid(gb) @ b) / len(b) - prior * (_sigmoid(ga) @ a) / len(a)
        grad = prior * (-_sigmoid(-ga) @ a) / len(a) + grad_rest if rest >= 0 else -grad_rest
        grad = grad + ridge * w
        m, v = 0.9 * m + 0.1 * grad, 0.999 * v + 0.001 * grad**2
        w -= 0.02 * (1 - 0.9 * t / steps) * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.999**t)) + 1e-8)
    return w[:-1], float(w[-1])


def estimate_prior(positive: np.ndarray, unlabelled: np.ndarray) -> float:
    """Share of positives in unlabelled scores: the ratio of upper tails at the threshold where its upper bound is least.

    Above a threshold that negatives hardly reach, the unlabelled tail is the prior times the positive tail.  A quarter of the margin
    for sampling error is added: the least of noisy ratios is too low, and a prior that is too low rejects clean documents.
    """
    cuts = np.quantile(positive, np.linspace(0.02, 0.9, 60))
    p, u = ((x[None, :] >= cuts[:, None]).mean(1) for x in (positive, unlabelled))
    margin = np.sqrt(np.log(20) / 2) * (1 / np.sqrt(len(positive)) + 1 / np.sqrt(len(unlabelled)))
    best = np.argmin((u + margin) / np.maximum(p, 1e-9))
    return float(np.clip((u[best] + margin / 4) / max(p[best], 1e-9), 0.05, 0.95))


def fit(p: np.ndarray, u: np.ndarray, steps: int = 1200, seed: int = 0) -> Model:
    """A model from features of trusted positives and of unlabelled texts.

    Without positives or without unlabelled texts there is nothing to tell apart: the score is then 1/2, or 1 without unlabelled texts.
    """
    d = _DENSE + HASHED
    if not len(p) or not len(u):
        return Model(np.zeros(d), np.ones(d), np.zeros(d), 40.0 if len(p) else 0.0, 1.0)
    mean, scale = u.mean(0), u.std(0) + 1e-2
    p, u = (((x - mean) / scale).clip(-8, 8) for x in (p, u))
    # The prior comes from scores of rows that their own model didn't see.
    seen = [[], []]
    for fold in (0, 1):
        own = [x[fold::2] if len(x) > 1 else x for x in (p, u)]
        w, b = _descend(*own, 0.5, steps // 2, seed + fold, 1e-2)
        for scores, x in zip(seen, (p, u), strict=True):
            scores.append((x[1 - fold :: 2] if len(x) > 1 else x) @ w + b)
    prior = estimate_prior(*map(np.concatenate, seen))
    w, b = _descend(p, u, prior, steps, seed + 2)
    return Model(mean, scale, w, b, prior)


def _matrix(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """flag, place, text to flag, place, features."""
    for batch in batches:
        x = features(batch.column(2))
        width = x.shape[1]
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.ListArray.from_arrays(np.arange(0, width * len(x) + 1, width, dtype=np.int32), x.ravel())], ["flag", "place", "x"])


def held_out(id_column: Column, parts: int = 4) -> Column:
    return F.coalesce(F.crc32(id_column.cast("string")) % parts == 2, F.lit(False))


def train(docs: DataFrame, positives: DataFrame, id_column: str = "doc_id", text_column: str = "text", most_positives: int = POSITIVES, most_unlabelled: int = UNLABELLED) -> Model:
    """Fit on the rows of docs named in positives (doc_id) and on others as unlabelled text.

    Held-out rows (crc32 of the id as text modulo 4 is 2) take no part.  Of each kind a bounded sample is used, those with the least hashes of
    their id, so it doesn't depend on how the data is split.
    """
    texts = docs.select(F.col(id_column).alias("doc_id"), F.col(text_column).cast("string").alias("text")).where(~held_out(F.col("doc_id")) & F.col("doc_id").isNotNull())
    good = positives.select(F.col("doc_id")).where("doc_id is not null").distinct().withColumn("good", F.lit(1))
    ids = texts.select("doc_id").distinct().join(good, "doc_id", "left").select("doc_id", F.coalesce("good", F.lit(0)).alias("flag"))
    order = F.xxhash64("doc_id", F.lit("sample"))
    # At most most_positives + most_unlabelled ids.
    chosen = ids.where("flag = 1").orderBy(order).limit(most_positives).union(ids.where("flag = 0").orderBy(order).limit(most_unlabelled)).cache()
    try:
        sample = texts.join(F.broadcast(chosen), "doc_id").select("flag", order.alias("place"), "text").mapInArrow(_matrix, "flag int, place long, x array<float>").toArrow()
    finally:
        chosen.unpersist()
    if not sample.num_rows:
        return fit(np.empty((0, 1)), np.empty((0, 1)))
    flag = sample.column(0).to_numpy()
    x = np.asarray(sample.column(2).combine_chunks().values).reshape(len(flag), -1)
    # Spark gives the rows in any order; sort them so that the model is the same each time.
    first = np.lexsort((x[:, 7], sample.column(1).to_numpy()))
    flag, x = flag[first], x[first]
    return fit(x[flag == 1], x[flag == 0])


def score_documents(docs: DataFrame, model: Model, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """doc_id, held_out, score, predicted; one row for each row of docs, from its whole text alone.

    Null and empty texts get the score of a text without bytes.  A null id isn't held out.  Other columns of docs are not looked at.
    """

    def scores(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(model.score(features(batch.column(1))).astype(np.float64))], ["doc_id", "score"])

    texts = docs.select(F.col(id_column).cast("long").alias("doc_id"), F.col(text_column).cast("string").alias("text"))
    out = texts.mapInArrow(scores, "doc_id long, score double")
    return out.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= ACCEPT).cast("int").alias("predicted"))


def accepted(docs: DataFrame, model: Model, text_column: str = "text") -> DataFrame:
    """The rows of docs whose whole text scores ACCEPT or more, with all their columns."""

    def keep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            good = model.score(features(batch.column(batch.schema.get_field_index(text_column)))) >= ACCEPT
            yield batch.filter(pa.array(good))

    return docs.mapInArrow(keep, docs.schema)


def classify(docs: DataFrame, labels: DataFrame, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """Train on labels (doc_id, quality) with quality 1 as trusted positives and score all of docs."""
    model = train(docs, labels.where("quality = 1").select("doc_id"), id_column, text_column)
    return score_documents(docs, model, id_column, text_column)
