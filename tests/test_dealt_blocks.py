"""Blocks of rows deal their values to each other as arrays: the same counts as by a join of rows and draws."""

import numpy as np
import pandas as pd
import pytest

from skerry.operators import modelling, trees
from test_scored_once import forest


@pytest.mark.parametrize("block", [64, 1 << 17])
def test_counts_as_by_rows(spark, monkeypatch, block):
    monkeypatch.setattr(modelling, "BLOCK", block)
    rng = np.random.default_rng(3)
    n = 700
    rows = spark.createDataFrame(pd.DataFrame({"task": rng.choice(["p", "q", "r"], n), "id": [f"r{i}" for i in range(n)], "label": rng.integers(0, 2, n).astype(np.int32), "a": rng.normal(size=n), "b": rng.integers(-2, 3, n) / 2, "c": rng.normal(size=n)})).repartition(3)
    models = {"p": forest(("c", "a", "b"), 1), "q": forest(("b",), 2, 2), "none": modelling.Model(modelling.Spec("t", ("a",), "hinges"))}  # one without rows
    groups = {"ab": ["a", "b"], "c": ["c"]}
    seen = []
    plain = modelling._dealt_by_rows
    monkeypatch.setattr(modelling, "_dealt_by_rows", lambda *a: seen.append(1))
    got, want = ({tuple(r)[:4]: tuple(r)[4:] for r in f(rows, models, ["a", "b", "c"], groups, 12, 5).collect()} for f in (modelling.dealt_scores, plain))
    assert got == want and {k[:3] for k in got} >= {("p", "ab", 12), ("p", "c", 1), ("q", "ab", 11), ("q", "", 0)} and not seen


def test_a_table_has_the_scores_of_its_forest():
    m = forest(("a", "b", "c"), 7, 5, 6)
    grid = trees.Grid.of(m, 1 << 20)
    x = np.random.default_rng(1).choice([-2.0, -1.0, -0.5, 0.0, 0.2, 0.5, 3.0, np.nan], (400, 3))
    assert (grid.table.ravel()[grid.codes(x)] == m.predict(x)).all() and trees.Grid.of(m, 10) is None
    codes = grid.codes(x)
    assert (grid.share(codes, [0, 2]) + grid.share(codes, [1]) == codes).all()


def test_shapley_values_of_a_place_are_worked_out_once(spark, monkeypatch):
    """Each row's values were worked out anew, a row a predictor at a time."""
    rng = np.random.default_rng(6)
    x = rng.choice([-2.0, -0.7, 0.3, 2.0], (5000, 2))
    rows = spark.createDataFrame(pd.DataFrame({"id": [f"r{i}" for i in range(5000)], "fold": np.arange(5000, dtype=np.int32) % 2, "a": x[:, 0], "b": x[:, 1]})).coalesce(1)
    m = forest(("b", "a"), 3)
    monkeypatch.setattr(modelling.trees, "HELD", 700)
    calls = spark.sparkContext.accumulator(0)
    plain = modelling.tree_shapley
    want = np.mean([plain(t, x[:, ::-1]) for t in m.trees], axis=0)[:, ::-1]

    def counted(tree, part):
        calls.add(len(part))
        return plain(tree, part)

    monkeypatch.setattr(modelling, "tree_shapley", counted)
    got = modelling.shapley_each(rows, ["a", "b"], {"m": m}, {0: "m", 1: "other"}, ["id"]).collect()
    assert len(got) == 5000
    for r in got:
        i = int(r.id[1:])
        assert (r.shap_a, r.value_b) == (None, None) if i % 2 else np.allclose([r.shap_a, r.shap_b, r.value_a, r.value_b], [*want[i], *x[i]])
    assert 0 < calls.value <= 16 * len(m.trees)
