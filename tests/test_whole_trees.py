"""Trees grow in one pass from the cells of their rows, as they do level by level; parts of rows are read once for the tasks that share them."""

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from skerry.operators import trees
from skerry.operators.trees import Spec

SPECS = {
    "f1": Spec("1", ("a", "b"), "forest", {"trees": 12, "depth": 4, "min_leaf": 1}, 2),
    "f5": Spec("1", ("a", "b"), "forest", {"trees": 12, "depth": 3, "min_leaf": 9}, 2),
    "b": Spec("0", ("b", "a"), "boosting", {"rounds": 4, "depth": 3, "rate": 0.3}),
    "h": Spec("2", ("a",), "hinges", {"strength": 0.1, "l1_ratio": 0.5}, 0),
}


@pytest.fixture(scope="module")
def rows(spark):
    rng = np.random.default_rng(12)
    n = 3000
    frame = pd.DataFrame({"fold": rng.integers(0, 3, n), "label": 0, "h": rng.integers(-(2**62), 2**62, n), "inner": rng.integers(0, 3, n), "a": rng.normal(size=n), "b": rng.integers(0, 9, n) / 3})
    frame["label"] = (frame.a + frame.b + rng.normal(size=n) > 1).astype(int)
    return spark.createDataFrame(frame, "fold int, label int, h long, inner int, a double, b double").repartition(4)


def test_whole_trees_are_those_of_levels_and_parts_those_of_rows(rows, monkeypatch):
    """Every level and round was a pass over all cells, and a row was read anew for each task that it trains for."""
    bins = trees.bins_of(rows, ["a", "b"])
    shares = {str(k): [str(t) for t in range(3) if t != k] for k in range(3)}
    passes = trees.Passes(rows.withColumn("task", F.col("fold").cast("string")), bins, ["a"], shares)
    seen = []
    plain = trees._grow_level
    monkeypatch.setattr(trees, "_grow_level", lambda *a, **k: seen.append(1) or plain(*a, **k))
    monkeypatch.setattr(trees, "SENT", 50)
    whole = trees.fit(passes.rows, SPECS, bins, passes=passes)
    assert not seen and passes.cells([])[1].groupBy().sum("n").first()[0] == rows.count()
    monkeypatch.setattr(trees, "LOCAL", 0)
    each = rows.withColumn("task", F.explode(F.array(*[F.lit(str(k)) for k in range(3)]))).where("task <> cast(fold AS string)")
    by_level = trees.fit(each, SPECS, bins)
    assert seen and whole.keys() == by_level.keys() == SPECS.keys()
    for n, m in whole.items():
        other = by_level[n]
        assert len(m.trees) == len(other.trees)
        for s, t in zip(m.trees, other.trees, strict=True):
            assert (s.feature == t.feature).all() and (s.cut == t.cut).all() and np.allclose(s.value, t.value) and np.allclose(s.weight, t.weight)
    assert np.allclose(whole["h"].coef, by_level["h"].coef, atol=1e-6)


def test_scores_of_fewer_trees_and_levels(rows):
    m = trees.fit(rows.withColumn("task", F.lit("1")), {"f1": SPECS["f1"]}, trees.bins_of(rows, ["a", "b"]))["f1"]
    x = np.random.default_rng(1).normal(size=(200, 2))
    settings = [{"trees": t, "depth": d} for t in (3, 12) for d in (1, 4)]
    assert all((a == m.predict(x, s["trees"], s["depth"])).all() or np.allclose(a, m.predict(x, s["trees"], s["depth"]), atol=1e-15) for a, s in zip(m.scores(x, settings), settings, strict=True))
