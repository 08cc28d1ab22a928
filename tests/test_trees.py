"""Learners over all rows against plain versions; dealt values and Shapley values."""

import itertools
import math

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from skerry.operators import modelling, trees
from skerry.operators.trees import Bins, Model, Spec, Tree


@pytest.fixture(scope="module")
def table(spark):
    rng = np.random.default_rng(4)
    n = 300
    x = rng.integers(0, 6, (n, 3)).astype(float)
    y = ((x[:, 0] > 2) ^ (x[:, 1] > 3) | (rng.random(n) < 0.1)).astype(int)
    frame = pd.DataFrame({"task": "t", "label": y, "h": rng.integers(-(2**62), 2**62, n), "inner": rng.integers(0, 3, n), "a": x[:, 0], "b": x[:, 1], "c": x[:, 2]})
    return frame, spark.createDataFrame(frame, "task string, label int, h long, inner int, a double, b double, c double").repartition(5)


CUTS = Bins({c: [0.0, 1.0, 2.0, 3.0, 4.0] for c in "abc"}, dict.fromkeys("abc", 2.5), dict.fromkeys("abc", 1.7), {c: [1.0, 2.0, 3.0] for c in "abc"})


def exhaustive(x, target, weight, depth, min_leaf):
    """Greedy tree by trying every cut: the value of each row's leaf."""
    value = np.full(len(x), (weight * target).sum() / weight.sum())
    if depth == 0:
        return value
    best = (1e-9, None)
    total = (weight * target).sum() ** 2 / weight.sum()
    for f in range(x.shape[1]):
        for c in range(5):
            low = x[:, f] <= c
            if min(low.sum(), (~low).sum()) < min_leaf:
                continue
            gain = round(sum((weight[s] * target[s]).sum() ** 2 / weight[s].sum() for s in (low, ~low)) - total, 9)
            if gain > best[0]:
                best = (gain, low)
    if best[1] is None:
        return value
    for s in (best[1], ~best[1]):
        value[s] = exhaustive(x[s], target[s], weight[s], depth - 1, min_leaf)
    return value


@pytest.mark.parametrize("without", [None, 1])
@pytest.mark.parametrize("cells", [300, 12_000_000])
def test_a_tree_equals_the_exhaustive_one(monkeypatch, table, without, cells):
    monkeypatch.setattr(trees, "CELLS", cells)
    frame, rows = table
    settings = {"trees": 2, "depth": 3, "min_leaf": 4, "bootstrap": False, "features": 3}
    m = trees.fit(rows, {"m": Spec("t", tuple("abc"), "forest", settings, without)}, CUTS)["m"]
    own = frame if without is None else frame[frame.inner != without]
    x, y = own[list("abc")].to_numpy(), own["label"].to_numpy()
    weight = np.where(y == 1, len(y) / (2 * y.sum()), len(y) / (2 * (len(y) - y.sum())))
    assert np.allclose(m.predict(x), exhaustive(x, y, weight, 3, 4))


def test_boosting_equals_newton_steps_by_exhaustive_trees(table):
    frame, rows = table
    m = trees.fit(rows, {"m": Spec("t", tuple("abc"), "boosting", {"rounds": 3, "depth": 2, "rate": 0.5})}, CUTS)["m"]
    x, y = frame[list("abc")].to_numpy(), frame["label"].to_numpy()
    w = np.where(y == 1, (y == 0).sum() / y.sum(), 1.0)
    score = np.zeros(len(y))
    for _ in range(3):
        p = 1 / (1 + np.exp(-score))
        h = np.maximum(p * (1 - p), 1e-6)
        score += 0.5 * np.clip(exhaustive(x, (y - p) / h, w * h, 2, 1), -4, 4)
    assert np.allclose(m.predict(x), 1 / (1 + np.exp(-score)))
    assert np.allclose(m.cut_to({"rounds": 1, "depth": 2, "rate": 0.5}).predict(x), m.predict(x, 1))


def test_hinges_minimise_their_loss(table):
    frame, rows = table
    spec = Spec("t", tuple("abc"), "hinges", {"strength": 1.0, "l1_ratio": 0.5})
    m = trees.fit(rows, {"m": spec}, CUTS, hinge_steps=25)["m"]
    x, y = frame[list("abc")].to_numpy(), frame["label"].to_numpy()
    b = trees.basis(x, spec.columns, CUTS)
    w = np.where(y == 1, len(y) / (2 * y.sum()), len(y) / (2 * (len(y) - y.sum())))

    def loss(c):
        eta = b @ c
        return (w * (np.logaddexp(0, eta) - y * eta)).mean() + (0.5 * np.abs(c[1:]).sum() + 0.25 * (c[1:] ** 2).sum()) / len(y)

    best = loss(m.coef)
    rng = np.random.default_rng(1)
    assert all(best <= loss(m.coef + rng.normal(0, s, len(m.coef))) + 1e-7 for s in (1e-3, 1e-2, 0.1) for _ in range(40))


def test_forests_hang_on_keys_and_not_on_partitions(table):
    _, rows = table
    spec = {"m": Spec("t", tuple("abc"), "forest", {"trees": 4, "depth": 3, "min_leaf": 1})}
    x = np.array(list(itertools.product(range(6), repeat=3)), float)
    a, b = (trees.fit(rows.repartition(k), spec, CUTS)["m"].predict(x) for k in (1, 7))
    assert np.allclose(a, b)
    m = trees.fit(rows, spec, CUTS)["m"]
    assert (Model.from_json(m.to_json()).predict(x) == m.predict(x)).all()
    assert trees.fit(rows.where("label = 1"), spec, CUTS) == {}


def test_tree_shapley_equals_all_sets(table):
    frame, rows = table
    m = trees.fit(rows, {"m": Spec("t", tuple("abc"), "forest", {"trees": 3, "depth": 4, "min_leaf": 1})}, CUTS)["m"]
    x = frame[list("abc")].to_numpy()[:40]

    def expected(t: Tree, at: int, known) -> np.ndarray:
        f = t.feature[at]
        if f < 0:
            return np.full(len(x), t.value[at])
        low, high = expected(t, 2 * at + 1, known), expected(t, 2 * at + 2, known)
        share = t.weight[2 * at + 1] / t.weight[at]
        return np.where(x[:, f] <= t.cut[at], low, high) if f in known else share * low + (1 - share) * high

    for t in m.trees:
        worth = {s: expected(t, 0, s) for k in range(4) for s in itertools.combinations(range(3), k)}
        want = np.zeros(x.shape)
        for s, v in worth.items():
            for j in set(range(3)) - set(s):
                want[:, j] += math.factorial(len(s)) * math.factorial(2 - len(s)) / 6 * (worth[tuple(sorted((*s, j)))] - v)
        got = modelling.tree_shapley(t, x)
        assert np.allclose(got, want)
        assert np.allclose(got.sum(axis=1), t.value[t.place(x, 4)] - worth[()])


@pytest.mark.parametrize("parts", [1, 4, 64])
def test_dealt_values_are_permutations_whatever_the_partitions(spark, parts):
    rows = spark.createDataFrame([("p" if i < 70 else "q", str(i % 97), i % 2, float(i)) for i in range(110)], "task string, id string, label int, a double").repartition(parts)
    out = modelling.dealt_values(rows, ["a"], 3, 5).toPandas()
    for (task, _), part in out.groupby(["task", "draw"]):
        want = [float(i) for i in range(110) if (i < 70) == (task == "p")]
        assert sorted(part["a"]) == sorted(part["o_a"]) == want
    key = out[out.task == "p"].sort_values(["draw", "a"])[["draw", "a", "o_a"]].to_numpy()
    one = modelling.dealt_values(rows.repartition(2), ["a"], 3, 5).where("task = 'p'").orderBy("draw", "a").select(F.col("draw").cast("double"), "a", "o_a").toPandas().to_numpy()
    assert (key == one).all() and (key[:, 1] != key[:, 2]).mean() > 0.8
