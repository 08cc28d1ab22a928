"""Operators that SQL does not cover, against brute force, and published figures."""

import itertools
import math
import random

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from skerry.operators import modelling, ranking, resampling, spatial, trees
from skerry.plans import inference


def km(a, b):
    la, lb = math.radians(a[1]), math.radians(b[1])
    h = math.sin((lb - la) / 2) ** 2 + math.cos(la) * math.cos(lb) * math.sin(math.radians(b[0] - a[0]) / 2) ** 2
    return 2 * 6371 * math.asin(min(1, math.sqrt(h)))


def globe(n, seed):
    rng = random.Random(seed)
    places = [(rng.uniform(-180, 180), rng.choice([rng.uniform(-90, 90), rng.uniform(85, 90), rng.uniform(-90, -88)])) for _ in range(n)]
    return places + [(179.99, 10.0), (-179.99, 10.0), (180.0, 10.05), (-180.0, 10.1), (0.0, 90.0), (90.0, 90.0), (45.0, -90.0), (0.0, 0.0)]


def frame(spark, places, name):
    return spark.createDataFrame([(i, *p) for i, p in enumerate(places)], f"{name} long, lon double, lat double")


@pytest.mark.parametrize("reach", [30.0, 700.0, 6000.0, 20100.0])
def test_pairs_within_distance_anywhere(spark, reach):
    a, b = globe(60, 1), globe(60, 2)
    got = {(r.a_id, r.b_id) for r in spatial.within_distance(frame(spark, a, "a_id"), frame(spark, b, "b_id"), reach).collect()}
    assert got == {(i, j) for i, p in enumerate(a) for j, q in enumerate(b) if km(p, q) <= reach}


def test_nearest_anywhere(spark):
    a, b = globe(40, 3), globe(3, 4)[:5]
    got = {r.a_id: r.b_id for r in spatial.nearest(frame(spark, a, "a_id"), frame(spark, b, "b_id"), 200.0).collect()}
    assert got == {i: min(range(len(b)), key=lambda j: (round(km(p, b[j]), 9), j)) for i, p in enumerate(a)} or all(abs(km(a[i], b[j]) - min(km(a[i], q) for q in b)) < 1e-6 for i, j in got.items())
    assert len(got) == len(a)
    assert spatial.nearest(frame(spark, a, "a_id"), frame(spark, b, "b_id").limit(0), 5000.0).count() == 0


def test_running_totals_over_ranges(spark):
    rng = random.Random(5)
    rows = [(k, v, rng.randint(0, 9)) for k in ("a", None, "b") for v in rng.sample(range(1000), 200)]
    df = spark.createDataFrame(rows, "k string, v int, n int")
    for buckets in (1, 7, 64):
        got = {(r.k, r.v): r.below for r in ranking.running(df, ["k"], "v", {"below": "n"}, buckets).collect()}
        assert got == {(k, v): sum(m for q, w, m in rows if q == k and w < v) for k, v, _ in rows}


def test_thinning_equals_the_sequential_rule(spark):
    rng = random.Random(6)
    places = [(rng.uniform(0, 3), rng.uniform(0, 3)) for _ in range(80)]
    df = frame(spark, places, "occ_id")
    order = {(r.seed, r.occ_id): r.u for r in df.select("occ_id", F.explode(F.array(F.lit(1), F.lit(2))).alias("seed")).withColumn("u", resampling.uniform(0, "seed", "occ_id")).collect()}
    want = set()
    for seed in (1, 2):
        kept = []
        for i in sorted(range(len(places)), key=lambda i: (order[seed, i], i)):
            if all(km(places[i], places[j]) >= 50 for j in kept):
                kept.append(i)
        want |= {(seed, i) for i in kept}
    assert {tuple(r) for r in resampling.spatial_thin(df, 50.0, [1, 2]).collect()} == want


def test_calibration_line_by_newton_in_numpy(spark):
    rng = np.random.default_rng(7)
    p = rng.uniform(0, 1, 600)
    y = (rng.uniform(0, 1, 600) < 1 / (1 + np.exp(-(0.3 + 0.6 * np.log(p / (1 - p)))))).astype(int)
    x = np.column_stack([np.ones(600), np.log(np.clip(p, 1e-6, 1 - 1e-6) / (1 - np.clip(p, 1e-6, 1 - 1e-6)))])
    beta = np.zeros(2)
    for _ in range(30):
        q = 1 / (1 + np.exp(-x @ beta))
        beta = beta + np.linalg.solve((x * (q * (1 - q))[:, None]).T @ x, x.T @ (y - q))
    df = spark.createDataFrame([("g", float(a), int(b)) for a, b in zip(p, y, strict=True)], "k string, suit double, label int")
    r = resampling.calibration_line(df, ["k"]).first()
    assert abs(r.intercept - beta[0]) < 1e-6 and abs(r.slope - beta[1]) < 1e-6


def test_sign_flips_by_brute_force(spark):
    d = [3, -1, 4, 1, -5, 9, 2]
    rows = spark.createDataFrame([(1, i, v) for i, v in enumerate(d)] + [(2, i, v) for i, v in enumerate(d * 4)], "k int, id long, d long")
    got = {r.k: r for r in inference.sign_flip(rows, "k", "id", "d").collect()}
    hits = sum(abs(sum(s * v for s, v in zip(signs, d, strict=True))) >= abs(sum(d)) for signs in itertools.product((1, -1), repeat=len(d)))
    assert got[1].p == pytest.approx((hits + 1) / (2 ** len(d) + 1))
    sd = math.sqrt(sum(v * v for v in d * 4))
    assert got[2].n == 28 and abs(got[2].p - math.erfc(abs(sum(d * 4)) / sd / math.sqrt(2))) < 0.02


def test_published_figures(spark):
    """Step-down adjusted and rank-test p values as published."""
    three = spark.createDataFrame([("a", 1, 0.002), ("a", 2, 0.004), ("a", 3, 0.5)], "f string, t int, p double")
    assert [round(r.p_holm, 9) for r in inference.holm(three, "p", ["f"], "t").orderBy("t").collect()] == [0.006, 0.008, 0.5]
    tails = spark.createDataFrame([(18.0721, 2), (9.1341, 3), (1.9160, 3)], "h double, df int").select(F.round(inference.chi_square_tail(F.col("h"), F.col("df")), 4).alias("p"))
    assert [r.p for r in tails.collect()] == [0.0001, 0.0276, 0.5900]


def test_shapley_values_of_one_split():
    """One split on the first feature, a quarter of the weight below it (whole trees: test_trees)."""
    tree = trees.Tree(np.array([0, -1, -1]), np.zeros(3), np.array([2.5, 1.0, 3.0]), np.array([4.0, 1.0, 3.0]))
    assert np.allclose(modelling.tree_shapley(tree, np.array([[-1.0, 5.0], [1.0, 5.0]])), [[-1.5, 0], [0.5, 0]])


def test_learners_learn(spark):
    rng = np.random.default_rng(10)
    x = rng.normal(size=(600, 3))
    y = (x[:, 0] + 0.5 * x[:, 1] > 0).astype(int)
    frame = pd.DataFrame({"task": "t", "label": y[:400], "h": rng.integers(-(2**62), 2**62, 400), "inner": 0} | {c: x[:400, j] for j, c in enumerate("abc")})
    rows = spark.createDataFrame(frame, "task string, label int, h long, inner int, a double, b double, c double")
    settings = {"forest": {"trees": 20, "depth": 6, "min_leaf": 1}, "boosting": {"rounds": 15, "depth": 3, "rate": 0.3}, "hinges": {"strength": 1.0, "l1_ratio": 0.5}}
    models = trees.fit(rows, {a: trees.Spec("t", tuple("abc"), a, s) for a, s in settings.items()}, trees.bins_of(rows, list("abc")))
    for m in models.values():
        p = m.predict(x[400:])
        pos, neg = p[y[400:] == 1], p[y[400:] == 0]
        assert ((pos[:, None] > neg) + 0.5 * (pos[:, None] == neg)).mean() > 0.93


def test_every_row_is_scored(spark):
    """A task of one class has no model; all rows of the other are seen, scored and dealt anew."""
    of = [("a" if i % 2 else "b", i, int(i % 3 == 0) if i % 2 else 1, i, None, float(i % 3)) for i in range(4000)]
    rows = spark.createDataFrame(of, "task string, id long, label int, h long, inner int, x double")
    bins = trees.bins_of(rows, ["x"])
    models = trees.fit(rows, {t: trees.Spec(t, ("x",), "forest", {"trees": 3, "depth": 2, "min_leaf": 1}) for t in "ab"}, bins)
    assert list(models) == ["a"]
    scored = modelling.predict(rows, models)
    assert scored.count() == 2000
    assert ranking.auc(ranking.score_counts(scored, ["task"]), ["task"]).first().auc == 1.0
    dealt = modelling.dealt_scores(rows, models, ["x"], {"x": ["x"], "none": ["y"]}, 3, 1)
    auc = {(r.grp, r.draw): r for r in ranking.auc(dealt, ["grp", "draw"]).collect()}
    assert set(auc) == {("", 0), ("x", 1), ("x", 2), ("x", 3)} and auc["", 0].auc == 1.0
    assert all(r.n_pos + r.n_neg == 2000 and (k[0] == "" or 0.4 < r.auc < 0.6) for k, r in auc.items())
