"""The nearest other row against brute force, and how much of the work the bounds leave out."""

import numpy as np
import pytest

from skerry.operators import neighbours
from skerry.plans import models


@pytest.mark.parametrize(("block", "itself"), [(2048, True), (40, True), (40, False)])
def test_nearest_other(spark, monkeypatch, block, itself):
    monkeypatch.setattr(neighbours, "BLOCK", block)
    monkeypatch.setattr(neighbours, "ASKED", 300)
    rng = np.random.default_rng(2)
    x = np.concatenate([rng.normal(c, 0.2, (150, 3)) for c in (0, 3, 9)] + [np.ones((60, 3)), [[50.0, 0, 0]]])
    rows = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)] , "id long, v array<double>").repartition(5)
    seen = []
    least = neighbours._least
    monkeypatch.setattr(neighbours, "_least", lambda dims: (seen.append(dims), least(dims))[1])
    got = {r.query: (r.d, r.near) for r in neighbours.nearest_other(rows.withColumnRenamed("id", "query"), rows, itself, pivots=6).collect()}
    d = np.sqrt(((x[:, None] - x) ** 2).sum(axis=2))
    if itself:
        np.fill_diagonal(d, np.inf)
    assert len(got) == len(x) and len(seen) == 2
    for i in range(len(x)):
        assert got[i][0] == pytest.approx(d[i].min(), abs=1e-12) and got[i][1] == int(np.flatnonzero(d[i] <= d[i].min() + 1e-15)[0])


def test_few_and_no_rows(spark):
    one = spark.createDataFrame([(1, [1.0, 2.0])], "id long, v array<double>")
    assert neighbours.nearest_other(one.withColumnRenamed("id", "query"), one).count() == 0
    assert neighbours.nearest_other(one.withColumnRenamed("id", "query"), one.limit(0)).count() == 0
    assert neighbours.nearest_other(one.withColumnRenamed("id", "query"), one, itself=False).first().d == 0


def test_applicability_over_all_rows(spark):
    rows = models.rows_of(spark, "/root/testdata/sf0.001").select("fold", *models.FEATURES).toPandas().to_numpy()
    got = {r.test_fold: r for r in models.aoa_fraction(spark, "/root/testdata/sf0.001").collect()}
    train, test = rows[rows[:, 0] != 0, 1:], rows[rows[:, 0] == 0, 1:]
    mean, sd = train.mean(axis=0), train.std(axis=0)
    train, test = (train - mean) / sd, (test - mean) / sd

    def least(a, b, same):
        out = []
        for i in range(len(a)):
            d = np.sqrt(((b - a[i]) ** 2).sum(axis=1))
            if same:
                d[i] = np.inf
            out.append(d.min())
        return np.array(out)

    limit = np.quantile(least(train, train, True), 0.95)
    near = least(test, train, False)
    assert got[0].n == len(test) and got[0].limit == pytest.approx(limit, rel=1e-9) and got[0].inside == pytest.approx((near <= limit + 1e-12).mean(), abs=1e-3)


def test_few_boxes_are_within_reach(spark, monkeypatch):
    """Shells about pivots left most blocks within reach of rows in several dimensions: pairs of queries and blocks filled the disk."""
    monkeypatch.setattr(neighbours, "BLOCK", 32)
    rng = np.random.default_rng(4)
    x = np.column_stack([rng.integers(1, 40, 4000) / 10, rng.integers(0, 8, 4000) / 2, rng.normal(size=(4000, 3))])
    rows = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "id long, v array<double>").repartition(3)
    pairs = spark.sparkContext.accumulator(0)
    reached = neighbours._reached

    def counted(*a):
        run = reached(*a)

        def go(frames):
            for f in run(frames):
                pairs.add(len(f))
                yield f

        return go

    monkeypatch.setattr(neighbours, "_reached", counted)
    assert neighbours.nearest_other(rows.withColumnRenamed("id", "query"), rows).count() == 4000
    assert 0 < pairs.value < 4000 * 40  # of 127 other leaves
