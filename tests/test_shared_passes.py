"""Fits over the same rows share their tables, hinges are solved together, and equal rows score alike."""

import numpy as np
import pandas as pd
import pytest

from skerry.operators import modelling, trees
from skerry.operators.trees import Model, Spec
from skerry.plans import design

GRIDS = {"forest": [{"trees": t, "depth": 2, "min_leaf": 1} for t in (2, 4)], "boosting": [{"rounds": r, "depth": 2, "rate": 0.3} for r in (1, 2)], "hinges": [{"strength": s, "l1_ratio": 0.5} for s in (0.1, 1.0)]}


@pytest.fixture(scope="module")
def rows(spark):
    rng = np.random.default_rng(8)
    n = 1500
    frame = pd.DataFrame({"task": rng.choice(["s", "t"], n), "label": 0, "h": rng.integers(-(2**62), 2**62, n), "inner": rng.integers(0, 3, n), "a": rng.normal(size=n), "b": rng.integers(0, 9, n) / 3})
    frame["label"] = (frame.a + frame.b + rng.normal(size=n) > 1).astype(int)
    return spark.createDataFrame(frame, "task string, label int, h long, inner int, a double, b double")


def one_by_one(gram, target, coef, lam, l1_ratio, sweeps=200):
    """The descent of a single model, coefficient by coefficient."""
    c = coef.copy()
    for _ in range(sweeps):
        before = c.copy()
        for j in range(len(c)):
            r = target[j] - gram[j] @ c + gram[j, j] * c[j]
            c[j] = r / max(gram[j, j], 1e-12) if j == 0 else np.sign(r) * max(abs(r) - lam * l1_ratio, 0.0) / (gram[j, j] + lam * (1 - l1_ratio) + 1e-12)
        if np.abs(c - before).max() < 1e-7:
            break
    return c


def test_models_solved_together_are_those_solved_alone():
    rng = np.random.default_rng(4)
    b = rng.normal(size=(12, 60, 7))
    gram, target, lam, ratio = np.einsum("mki,mkj->mij", b, b) / 60, rng.normal(size=(12, 7)), rng.choice([1e-3, 0.1, 0.5], 12), rng.choice([0.2, 0.5], 12)
    both = trees.descend(gram, target, np.zeros((12, 7)), lam, ratio)
    assert np.allclose(both, [one_by_one(*one) for one in zip(gram, target, np.zeros((12, 7)), lam, ratio, strict=True)], atol=1e-9)


def test_fits_of_the_same_rows_count_them_once(spark, rows, monkeypatch):
    """A choice and a fit after it made cells and equal rows anew for every fit and every count of scores."""
    made = []
    plain = trees.written
    monkeypatch.setattr(trees, "written", lambda df, name: made.append(name) or plain(df, name))
    bins = trees.bins_of(rows, ["a", "b"])
    tasks = {f"{t}{a}{len(c)}": Spec(t, c, a) for t in "st" for a in GRIDS for c in (("a", "b"), ("b",))}
    passes = trees.Passes(rows, bins, trees.near_of(tasks, bins))
    chosen = modelling.nested_choice(rows, tasks, GRIDS, bins, 3, passes=passes)
    final = {n: Spec(s.task, s.columns, s.algo, chosen[n][0]) for n, s in tasks.items()}
    shared = trees.fit(rows, final, bins, passes=passes)
    assert sorted(made) == ["cells", "cells", "values"]  # cells: of the draws of either seed
    alone = trees.fit(rows, final, bins)
    x = np.random.default_rng(1).normal(size=(300, 2))
    for n, m in alone.items():
        at = x[:, : len(m.spec.columns)]
        assert np.allclose(shared[n].predict(at), m.predict(at))


def test_equal_rows_of_a_task_follow_each_other(spark, rows):
    values = trees.distinct_of(rows.union(rows), ["a", "b"], ["b"])
    assert values.groupBy().sum("n").first()[0] == 2 * rows.count()
    seen = {}
    for part in values.rdd.glom().collect():
        keys = [(r.task, r.inner, r.label, r.b) for r in part]
        assert sum(k != keys[i - 1] for i, k in enumerate(keys) if i) + bool(keys) <= 2 * len(set(keys))
        for k in set(keys):
            seen[k] = seen.get(k, 0) + 1
    assert max(seen.values()) <= 4
    y, n, x = trees.runs(np.array([0, 0, 1, 1, 0]), np.array([2, 3, 1, 1, 1]), np.array([[1.0], [1.0], [1.0], [2.0], [1.0]]))
    assert y.tolist() == [0, 1, 1, 0] and n.tolist() == [5, 1, 1, 1] and x[:, 0].tolist() == [1, 1, 2, 1]


def test_equal_rows_score_alike_wherever_they_lie(rows):
    bins = trees.bins_of(rows, ["a", "b"])
    rng = np.random.default_rng(2)
    m = Model(Spec("t", ("a", "b"), "hinges"), [], rng.normal(size=21), bins)
    x = rng.normal(size=(997, 2))
    whole = m.predict(x)
    for size in (1, 2, 3, 5, 7, 11, 400):
        assert (np.concatenate([m.predict(x[a : a + size]) for a in range(0, len(x), size)]) == whole).all()


@pytest.mark.parametrize("radius", [3.0, 40.0, 500.0])
def test_rings_find_the_nearest_training_place(spark, monkeypatch, radius):
    """Places farther than ``FAR_KM`` from all stay without; what is near does not hang on the first radius."""
    monkeypatch.setattr(design.spatial, "first_radius", lambda *_: min(radius, design.FAR_KM))
    rng = np.random.default_rng(6)
    asked = pd.DataFrame({"rep": 0, "fold": rng.integers(0, 2, 60), "a_lon": rng.uniform(97, 106, 60), "a_lat": rng.uniform(5, 20, 60)})
    trained = pd.DataFrame({"rep": 0, "fold": rng.integers(0, 2, 25), "b_lon": rng.uniform(97, 101, 25), "b_lat": rng.uniform(5, 12, 25)})
    got = design._least_km(spark.createDataFrame(asked), spark.createDataFrame(trained)).toPandas()
    got = {(r.fold, r.a_lon, r.a_lat): r.km for r in got.itertuples()}
    rad = np.radians
    for r in asked.itertuples():
        own = trained[trained.fold == r.fold]
        h = np.sin(rad(own.b_lat - r.a_lat) / 2) ** 2 + np.cos(rad(r.a_lat)) * np.cos(rad(own.b_lat)) * np.sin(rad(own.b_lon - r.a_lon) / 2) ** 2
        km = (2 * 6371.0 * np.arcsin(np.sqrt(h))).min()
        key = (r.fold, r.a_lon, r.a_lat)
        assert (key not in got) if km > design.FAR_KM else abs(got[key] - km) < 1e-6
