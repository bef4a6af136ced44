"""Segmentation training against plain programs."""

import hashlib

import numpy as np
import pytest

from voxelspark.operators import masks, segment, training

SCHEMA = "class int, value double, n long"


def kmeans(values, k):
    distinct = np.unique(values)
    k = min(k, len(distinct))
    mu = np.array([distinct[(2 * i + 1) * len(distinct) // (2 * k)] for i in range(k)])
    for _ in range(300):
        near = np.abs(values[:, None] - mu).argmin(1)
        new = np.array([values[near == i].mean() if (near == i).any() else mu[i] for i in range(k)])
        moved, mu = np.abs(new - mu).max(), new
        if moved <= 1e-6:
            break
    return mu


def test_start_is_kmeans(spark):
    rng = np.random.default_rng(1)
    values = {0: np.concatenate([rng.normal(40, 4, 300), rng.normal(90, 5, 200)]).round(1), 1: np.repeat([150.0, 200.0], [70, 30])}
    rows = [(c, float(v), int((vs == v).sum())) for c, vs in values.items() for v in np.unique(vs)]
    for parts in (1, 6):
        got = training.start(spark.createDataFrame(rows, SCHEMA).repartition(parts), {0: 3, 1: 4})
        assert [p[3] for p in got if p[0] == 0] == pytest.approx(kmeans(values[0], 3))
        assert [p[2:] for p in got if p[0] == 1] == [(0.5, 150.0, 256.0), (0.5, 200.0, 256.0), (0.0, 200.0, 256.0), (0.0, 200.0, 256.0)]


def test_sample_sizes():
    assert training.sample_sizes({0: 900, 1: 100}, 100) == {0: 90, 1: 10}
    assert training.sample_sizes({0: 900, 1: 100}, 1000) == {0: 0, 1: 0}
    assert training.sample_sizes({0: 5, 1: 1000}, 900) == {0: 4, 1: 896}
    assert training.sample_sizes({0: 10**6, 1: 1}, 10) == {0: 9, 1: 0}
    assert training.sample_sizes({0: 50, 1: 70}, None, 60, 60) == {0: 0, 1: 60}
    assert training.sample_sizes({0: 50, 1: 70}) == {0: 0, 1: 0}


@pytest.mark.parametrize("draws", [{0: 500, 1: 40}, {1: 40}, {0: 70000}])
def test_draws(spark, draws):
    """Draw i takes the point at a hashed place; one value holds most points, so it spans several ranges of places."""
    rows = [(0, float(v), 1 + v % 3) for v in range(300)] + [(0, 400.0, 200_000), (0, 401.0, 5)] + [(1, float(v), 2) for v in range(50)]
    want = {}
    for c in (0, 1):
        own = [(v, n) for q, v, n in sorted(rows) if q == c]
        ends = np.cumsum([n for _, n in own])
        if not draws.get(c):
            want |= {(c, v): n for v, n in own}
            continue
        for i in range(draws[c]):
            place = int(hashlib.md5(f"9:{c}:{i}".encode()).hexdigest()[:15], 16) % int(ends[-1])
            v = own[int(np.searchsorted(ends, place, "right"))][0]
            want[(c, v)] = want.get((c, v), 0) + 1
    for parts in (1, 8):
        got = {(r["class"], r.value): r.n for r in training.draw(spark.createDataFrame(rows, SCHEMA).repartition(parts), draws, 9).collect()}
        assert got == want


def test_exchange():
    model = [(0, 0, 0.4, 20.0, 2.0), (0, 1, 0.6, 150.0, 3.0), (1, 0, 0.3, 100.0, 4.0), (1, 1, 0.7, 200.0, 5.0)]
    got = training.exchange(model, {0: 300, 1: 100})
    back, fore = 0.3 / 3, 0.6 * 3
    assert [p[3:] for p in got] == [(20.0, 2.0), (100.0, 4.0), (150.0, 3.0), (200.0, 5.0)]
    assert [p[2] for p in got] == pytest.approx([0.4 / (0.4 + back), back / (0.4 + back), fore / (fore + 0.7), 0.7 / (fore + 0.7)])
    assert training.exchange(got, {0: 300, 1: 100}) == got


def density(v, parts):
    return sum(pi * np.exp(-((v - mu) ** 2) / (2 * sg * sg)) / (sg * np.sqrt(2 * np.pi)) for pi, mu, sg in parts)


def plain(image, response, parts, beta1, beta2, outer):
    """The whole training on arrays."""
    v = (image - image.min()) * 255.0 / (image.max() - image.min())
    count = np.bincount(np.minimum((v * 256 / 255).astype(int), 255).ravel(), minlength=256).astype(float)
    low, total, bins = np.cumsum(count), count.sum(), np.arange(256)
    s = np.cumsum(count * bins)
    with np.errstate(all="ignore"):
        between = np.where((low > 0) & (low < total), low * (total - low) * (s / low - (s[-1] - s) / (total - low)) ** 2, -1)
    label = (v > (between.argmax() + 0.5) * 255 / 256).astype(int)
    model, last, deltas = None, None, []
    for _ in range(outer):
        points = {c: v[label == c] for c in (0, 1)}
        if model is None:
            model = {c: [(1 / len(m), x, 256.0) for x in m] for c in (0, 1) for m in [kmeans(points[c], parts[c])]}
        before = None
        for i in range(30):
            likelihood = sum(np.log(np.maximum(density(points[c], model[c]), 1e-300)).sum() for c in (0, 1))
            if i > 1 and abs(likelihood - before) < 1e-6 * abs(likelihood):
                break
            before = likelihood
            new = {}
            for c in (0, 1):
                d = np.array([density(points[c], [p]) for p in model[c]])
                r = d / d.sum(0)
                w, m = r.sum(1), (r * points[c]).sum(1) / r.sum(1)
                sg = np.sqrt(np.maximum((r * points[c] ** 2).sum(1) / w - m * m, 1e-12))
                new[c] = list(zip(w / w.sum(), m, sg))
            model = new
        flat = training.exchange([(c, k, *p) for c in (0, 1) for k, p in enumerate(model[c])], {c: len(points[c]) for c in (0, 1)})
        model = {c: [p[2:] for p in flat if p[0] == c] for c in (0, 1)}
        padded = np.pad(label, 1)
        pot = sum(beta1 * (2 * np.roll(padded, s, a)[1:-1, 1:-1] - 1) for a in (0, 1) for s in (1, -1))
        share = response / response.max()
        s1 = np.log(np.maximum(density(v, model[1]), 1e-15)) - beta2 * np.log(1 - share + 1e-15) + pot
        s0 = np.log(np.maximum(density(v, model[0]), 1e-15)) - beta2 * np.log(share + 1e-15) - pot
        label, score = (s1 > s0).astype(int), np.maximum(s1, s0).sum()
        if last is not None:
            deltas.append(abs((score - last) / score))
            if deltas[-1] < 1e-8:
                break
        last = score
    return label, flat, deltas


def test_training_equals_a_plain_program(spark):
    rng = np.random.default_rng(6)
    inside = np.zeros((14, 16), bool)
    inside[3:10, 5:12] = True
    image = np.where(inside, rng.normal(150, 25, inside.shape), rng.normal(80, 20, inside.shape)).round(2)
    response = np.where(inside, rng.uniform(0.3, 0.9, inside.shape), rng.uniform(0.1, 0.6, inside.shape)).round(3)
    rows = [(0, 0, y, x, float(image[y, x]), float(response[y, x])) for y in range(14) for x in range(16)]
    df = spark.createDataFrame(rows, "t int, z int, y int, x int, value double, response double")
    for parts, fore, back, outer in ((32, 2, 3, 3), (2, 1, 2, 50)):
        one = df.repartition(parts)
        label, model, deltas = plain(image, response, {0: back, 1: fore}, 0.4, 0.5, outer)
        got = segment.train(one.drop("response"), one.drop("value"), fore, back, 0.4, 0.5, outer=outer)
        assert {(r.y, r.x): r.label for r in got.labels.collect()} == {(y, x): int(label[y, x]) for y in range(14) for x in range(16)}
        assert len(got.deltas) == len(deltas) and got.converged == (deltas[-1] < 1e-8)
        for p, q in zip(got.model, model, strict=True):
            assert p == pytest.approx(q, rel=1e-6)
    sampled = segment.train(df.drop("response"), df.drop("value"), 1, 2, 0.4, 0.5, outer=3, most=150, seed=3)
    assert sum(r.label == label[r.y, r.x] for r in sampled.labels.collect()) >= 0.95 * label.size


def test_a_class_without_voxels_takes_the_upper_half(spark):
    """A prior so strong that all voxels become background; the next round is fitted to the values above the lower median."""
    values = [10.0, 10.0, 10.1, 10.2, 120.0, 201.0]
    df = spark.createDataFrame([(0, 0, 0, x, v, 1.0 if x == 5 else 1e-9) for x, v in enumerate(values)], "t int, z int, y int, x int, value double, response double")
    run = lambda n: segment.train(df.drop("response"), df.drop("value"), beta1=20.0, beta2=0.5, outer=n)
    assert {r.label for r in run(1).labels.collect()} == {0}
    fore = [p for p in run(2).model if p[0] == 1]
    assert len(fore) == 1 and fore[0][3] == pytest.approx(np.mean([(v - 10) * 255 / 191 for v in (10.2, 120.0, 201.0)]))


def test_strided_samples(spark):
    df = spark.createDataFrame([(t, 0, y, x, 100 * t + 10 * y + x) for t in range(3) for y in range(4) for x in range(9)], "t int, z int, y int, x int, value int")
    order = [r.value for r in df.orderBy("t", "z", "y", "x").collect()]
    for most in (1, 7, 50, 54, 107, 108, 500):
        step = -(-len(order) // most)
        for parts in (1, 6):
            assert sorted(r.value for r in masks.strided(df.repartition(parts), most).collect()) == order[::step][:most]
    assert masks.strided(df.limit(0), 5).count() == 0
    with pytest.raises(ValueError, match="at least one"):
        masks.strided(df, 0)
