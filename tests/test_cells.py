"""Rows of the same bins, and equal rows, are one row of work with all their draws."""

import numpy as np
import pandas as pd
import pytest

from skerry.operators import modelling, trees
from skerry.operators.trees import Bins, Spec

CUTS = Bins({c: [0.0, 1.0, 2.0] for c in "ab"}, dict.fromkeys("ab", 1.5), dict.fromkeys("ab", 1.0), {c: [1.0, 2.0] for c in "ab"})


@pytest.fixture(scope="module")
def frame():
    rng = np.random.default_rng(3)
    n = 2000
    x = rng.integers(0, 4, (n, 2)) - rng.integers(0, 2, (n, 2)) / 2
    return pd.DataFrame({"task": "t", "label": (x[:, 0] > 1).astype(int) ^ (rng.random(n) < 0.2), "h": rng.integers(-(2**62), 2**62, n), "inner": rng.integers(0, 3, n), "a": x[:, 0], "b": x[:, 1]})


def test_cells_hold_the_draws_of_their_rows(spark, frame):
    rows = spark.createDataFrame(frame, "task string, label int, h long, inner int, a double, b double").repartition(5)
    cells = trees.cells_of(rows, CUTS, [(42, 0), (42, 3)], ["a"]).collect()
    assert sum(r.n for r in cells) == len(frame) and len(cells) <= 2 * 3 * 16
    assert len({(r.label, r.inner, r.bin_0, r.bin_1) for r in cells}) == len(cells)
    for r in cells:
        own = frame[(frame.label == r.label) & (frame.inner == r.inner) & (CUTS.of("a", frame.a) == r.bin_0) & (CUTS.of("b", frame.b) == r.bin_1)]
        times = np.stack([trees.bootstrap_weights(own.h.to_numpy().view(np.uint64), 42, t) for t in (0, 3)])
        drawn = np.frombuffer(r.drawn, np.uint32).reshape(2, 2)
        assert r.n == len(own) and (drawn[0] == times.sum(axis=1)).all() and (drawn[1] == (times > 0).sum(axis=1)).all()


def test_copies_are_no_more_work(spark, frame):
    rows = spark.createDataFrame(frame, "task string, label int, h long, inner int, a double, b double")
    more = rows.union(rows).union(rows)
    assert trees.cells_of(more, CUTS).count() == trees.cells_of(rows, CUTS).count()
    assert trees.distinct_of(more, ["a", "b"]).count() == len(frame.drop_duplicates(["label", "inner", "a", "b"]))
    spec = {"m": Spec("t", ("a", "b"), "boosting", {"rounds": 2, "depth": 2, "rate": 0.5}, 1)}
    x = frame[["a", "b"]].to_numpy()
    assert np.allclose(*(trees.fit(r, spec, CUTS)["m"].predict(x) for r in (rows, more)))


def test_shapley_values_look_patterns_up(monkeypatch):
    """Many rows cost a leaf no more than its patterns, and get what each of them gets alone."""
    rng = np.random.default_rng(5)
    weight = np.zeros(15)
    weight[7:] = rng.integers(1, 9, 8)
    for i in range(6, -1, -1):
        weight[i] = weight[2 * i + 1] + weight[2 * i + 2]
    tree = trees.Tree(np.where(np.arange(15) < 7, rng.integers(0, 3, 15), -1), rng.random(15), rng.random(15), weight)
    x = rng.random((500, 3))
    alone = np.concatenate([modelling.tree_shapley(tree, one[None]) for one in x])
    seen = []
    plain = modelling._leaf_values
    monkeypatch.setattr(modelling, "_leaf_values", lambda one, zero: seen.extend(map(len, one)) or plain(one, zero))
    assert np.allclose(modelling.tree_shapley(tree, x), alone) and max(seen) <= 8
