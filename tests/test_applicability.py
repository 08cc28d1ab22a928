"""Equal rows are asked once, and row numbers of many partitions do not overflow the order of pivots."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from skerry.functions.numeric import hash_order
from skerry.operators import neighbours
from skerry.plans import models


def test_the_order_of_great_numbers(spark):
    numbers = [0, 5, -7, 2**35 + 3, 2**63 - 1, -(2**63)]
    got = spark.createDataFrame([(x,) for x in numbers], "x long").select("x", hash_order(F.col("x"), 17).alias("h")).collect()
    assert {r.x: r.h for r in got} == {x: (x * 2654435761 + 17 * 40503) % 2**32 for x in numbers}


@pytest.mark.parametrize("dims", [3, 40])
def test_gaps(dims):
    rng = np.random.default_rng(1)
    q, v = rng.normal(size=(7, dims)), rng.normal(size=(9, dims))
    v[3] = q[2]
    got = neighbours._gaps(q, v)
    assert np.allclose(got, np.sqrt(((q[:, None] - v) ** 2).sum(axis=2)), atol=1e-12) and got[2, 3] == 0


def test_equal_rows_are_asked_once(spark, monkeypatch):
    rng = np.random.default_rng(3)
    train = rng.integers(0, 6, (300, 2)).astype(float) * [1.0, 2.5]
    test = rng.integers(0, 9, (120, 2)).astype(float) * [1.0, 2.5]
    asked = []
    plain = neighbours.nearest_other
    monkeypatch.setattr(models, "nearest_other", lambda q, rows, **k: asked.append((q.count(), rows.count())) or plain(q, rows, **k))
    frame = lambda x: spark.createDataFrame([(*map(float, v),) for v in x], "a double, b double").repartition(3)
    got = sorted((r.a, r.b, r.near, r.limit, r.inside) for r in models.applicability(frame(train), frame(test), ["a", "b"]).collect())
    mean, sd = train.mean(axis=0), train.std(axis=0)
    x, y = (train - mean) / sd, (test - mean) / sd
    d = np.sqrt(((x[:, None] - x) ** 2).sum(axis=2))
    np.fill_diagonal(d, np.inf)
    limit = np.quantile(d.min(axis=1), 0.95)
    near = np.sqrt(((y[:, None] - x) ** 2).sum(axis=2)).min(axis=1)
    want = sorted((*map(float, v), n) for v, n in zip(test, near, strict=True))
    assert [g[:2] for g in got] == [w[:2] for w in want] and [g[2] for g in got] == pytest.approx([w[2] for w in want], abs=1e-9)
    assert all(g[3] == pytest.approx(limit, abs=1e-9) and g[4] == (g[2] <= g[3]) for g in got)
    single = np.unique(train, axis=0, return_counts=True)[1]
    assert asked[0] == (int((single == 1).sum()), len(single)) and asked[1][0] == len({tuple(v) for v in test} - {tuple(v) for v in train})
