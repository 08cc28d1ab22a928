"""Rows are scored once for all models of their fold, equal rows as one, and figures come from stored counts."""

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from skerry.operators import modelling, ranking
from skerry.operators.trees import Bins, Model, Spec, Tree

BINS = Bins({c: [-1.0, 0.0, 1.0] for c in "ab"}, dict.fromkeys("ab", 0.1), dict.fromkeys("ab", 1.1), {c: [-0.5, 0.5] for c in "ab"})
TESTED = {0: ["x0", "y0"], 1: ["x1", "y1"]}


def forest(columns: tuple[str, ...], seed: int, depth: int = 3, n_trees: int = 4) -> Model:
    rng = np.random.default_rng(seed)
    n, out = 2 ** (depth + 1) - 1, []
    for _ in range(n_trees):
        weight = np.zeros(n)
        weight[n // 2 :] = rng.integers(1, 9, n - n // 2)
        for i in range(n // 2 - 1, -1, -1):
            weight[i] = weight[2 * i + 1] + weight[2 * i + 2]
        out.append(Tree(np.where(np.arange(n) < n // 2, rng.integers(0, len(columns), n), -1).astype(np.int32), rng.choice([-1.0, 0.0, 0.5], n), rng.random(n), weight))
    return Model(Spec("t", columns, "forest", {"trees": n_trees, "depth": depth}), out)


MODELS = {"x0": forest(("b", "a"), 1), "x1": forest(("a",), 2), "y0": Model(Spec("t", ("a", "b"), "hinges"), [], np.linspace(-1, 1, 7), BINS)}


@pytest.fixture(scope="module")
def rows(spark):
    rng = np.random.default_rng(9)
    frame = pd.DataFrame({"id": [f"r{i}" for i in range(900)], "fold": rng.integers(0, 2, 900).astype(np.int32), "label": rng.integers(0, 2, 900).astype(np.int32), "a": rng.integers(-4, 5, 900) / 2, "b": rng.normal(size=900).round(1)})
    return spark.createDataFrame(frame, "id string, fold int, label int, a double, b double").repartition(3)


def plainly(rows):
    names = F.explode(F.when(F.col("fold") == 0, F.array(*map(F.lit, TESTED[0]))).otherwise(F.array(*map(F.lit, TESTED[1]))))
    return modelling.predict(rows.withColumn("task", names), MODELS)


def test_counts_and_figures_are_those_of_scored_rows(rows):
    counts = modelling.counts_each(rows, ["a", "b"], MODELS, TESTED)
    want = {(r.task, r.score): (r.pos, r.neg) for r in ranking.score_counts(plainly(rows), ["task"]).collect()}
    assert {(r.task, r.score): (r.pos, r.neg) for r in counts.collect()} == want
    none = counts.select("task", F.lit(None).cast("double").alias("threshold")).distinct()
    got, every = (sorted(map(tuple, x.select(sorted(x.columns)).collect()), key=str) for x in (ranking.bundle_of(counts, ["task"], none, True), ranking.bundle(plainly(rows), ["task"], none, True)))
    assert got == every and len(got) == 3


def test_every_row_has_the_scores_of_its_fold(rows):
    got = modelling.predict_each(rows, ["a", "b"], MODELS, TESTED, ["id", "label"]).collect()
    want = {(r.id, r.task): r.suit for r in plainly(rows).collect()}
    assert {(r.id, TESTED[r.fold][i]): s for r in got for i, s in enumerate((r.suit_0, r.suit_1)) if s is not None} == want and len(got) == 900
