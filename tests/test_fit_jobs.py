import math

import pytest

from voxelspark.operators import segment


def test_a_step_of_the_fit_is_one_job_of_one_stage(spark):
    points = [(c, float(v), 1 + v % 3) for c in (0, 1) for v in range(100 * c, 100 * c + 90)]
    df = spark.createDataFrame([*points, (None, 5.0, 1)], "class int, value double, n long").repartition(3)
    model = [(0, 0, 0.5, 10.0, 20.0), (0, 1, 0.5, 70.0, 20.0), (1, 0, 1.0, 150.0, 30.0)]
    context = spark.sparkContext
    context.setJobGroup("fit", "fit")
    try:
        got = segment.fit(df, model, 6, 0.0)
    finally:
        context.setLocalProperty("spark.jobGroup.id", None)
    tracker = context.statusTracker()
    jobs = [tracker.getJobInfo(j) for j in tracker.getJobIdsForGroup("fit")]
    # The blocks are made by two jobs or three.
    assert 6 <= len(jobs) <= 9 and sum(len(j.stageIds) == 1 for j in jobs) >= 6
    for _ in range(6):
        new = []
        for c, k, *_ in model:
            own = [p for p in model if p[0] == c]
            dens = lambda p, v: p[2] * math.exp(-((v - p[3]) ** 2) / (2 * p[4] ** 2)) / (p[4] * math.sqrt(2 * math.pi))
            rows = [(v, n * dens(next(p for p in own if p[1] == k), v) / sum(dens(p, v) for p in own)) for q, v, n in points if q == c]
            w, mu = sum(r for _, r in rows), sum(v * r for v, r in rows) / sum(r for _, r in rows)
            new.append((c, k, w / sum(n for q, _, n in points if q == c), mu, math.sqrt(sum(v * v * r for v, r in rows) / w - mu * mu)))
        model = new
    for a, b in zip(got, model, strict=True):
        assert a[:2] == b[:2] and a[2:] == pytest.approx(b[2:], rel=1e-9)
