"""Model queries over the smallest tables: whole coverage and what must hold whatever the data."""

import json

import pytest
from pyspark.sql import functions as F

from skerry.operators import trees
from skerry.plans import models
from skerry.plans.registry import QUERIES

SF = "/root/testdata/sf0.001"


def test_the_key_is_one(spark):
    for sf in (SF, "/root/testdata/sf0.01"):
        rows = models.rows_of(spark, sf)
        n, ids, hashes = rows.agg(F.count("*"), F.count_distinct("id"), F.count_distinct("h")).first()
        assert n == ids == hashes


def test_predictions_cover_every_row_of_every_configuration(spark):
    rows = models.rows_of(spark, SF).count()
    out = models.oof_predictions(spark, SF)
    n = out.groupBy("algo", "feat_set").agg(F.count("*").alias("n"), F.count_distinct("id").alias("d")).collect()
    assert len(n) == 12 and all(r.n == r.d == rows for r in n)
    assert out.where("suit < 0 OR suit > 1 OR suit IS NULL").count() == 0


def test_reconstruction_gives_the_reported_figures(spark):
    out = models.refit_selected(spark, SF).collect()
    assert len(out) == 3 and all(r.same for r in out)


def test_models_come_from_the_stored_table_alone(spark, monkeypatch):
    """Once stored for these files, nothing is fitted again, in whichever session."""
    before = {t: m.to_json() for t, m in models.fitted(spark, SF).items()}
    monkeypatch.setattr(trees, "fit", None)
    assert {t: m.to_json() for t, m in models.fitted(spark.newSession(), SF).items()} == before
    for r in models.specifications(spark, SF).collect():
        spec, m = json.loads(r.spec), trees.Model.from_json(r.model)
        assert (spec["algo"], tuple(spec["columns"]), spec["settings"], spec["seed"]) == (m.spec.algo, m.spec.columns, m.spec.settings, m.spec.seed)


def test_the_ensemble_covers_every_row(spark):
    out = models.full_refit_ensemble(spark, SF)
    n, ids, low, high = out.agg(F.count("*"), F.count_distinct("id"), F.min("support"), F.max("support")).first()
    assert n == ids == models.rows_of(spark, SF).count() and 0 <= low <= high <= 1
    s = models.ensemble_support(spark, SF).first()
    assert s.n == n and s.by_most + s.by_half + s.by_few == pytest.approx(1) and s.by_all <= s.by_most and s.by_none <= s.by_few


def test_shapley_values_of_every_row_sum_to_the_score(spark):
    shap = models.shap_long(spark, SF)
    sums = shap.groupBy("test_fold", "id").agg(F.sum("shap").alias("s"), F.count("*").alias("k"))
    scores = models.oof_predictions(spark, SF).where("algo = 'forest' AND feat_set = 'SAP'").select("test_fold", "id", "suit")
    both = scores.join(sums, ["test_fold", "id"]).withColumn("base", F.col("suit") - F.col("s"))
    spread = both.groupBy("test_fold").agg(F.max("base").alias("a"), F.min("base").alias("b"), F.count("*").alias("n")).collect()
    assert sum(r.n for r in spread) == models.rows_of(spark, SF).count() and all(abs(r.a - r.b) < 1e-9 for r in spread)


def test_effects_are_centred_and_groups_complete(spark):
    ale = models.ale_curve(spark, SF).groupBy("test_fold", "feature").agg(F.sum(F.col("ale") * F.greatest("n", F.lit(1))).alias("s")).collect()
    assert ale and all(abs(r.s) < 1e-6 for r in ale)
    assert models.permutation_importance(spark, SF).count() == 3 * len(models.FEATURES)


def test_importance_hangs_on_ids_and_seed_alone(spark):
    one = {(r.test_fold, r.feature): r.importance for r in models.permutation_importance(spark, SF).collect()}
    spark.conf.set("spark.sql.shuffle.partitions", "3")
    try:
        other = {(r.test_fold, r.feature): r.importance for r in models.permutation_importance(spark, SF).collect()}
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", "8")
    assert one.keys() == other.keys() and all(one[k] == pytest.approx(other[k], abs=1e-12) for k in one)


def test_settings_are_drawn_without_replacement():
    for algo in models.GRIDS:
        drawn = [json.dumps(c) for c in models.candidates(algo)]
        assert len(drawn) == len(set(drawn)) == models.CANDIDATES


@pytest.mark.parametrize("name", ["pa_two_step", "pa_uncertainty_zone"])
def test_background_keeps_its_distance(spark, name):
    out = QUERIES[name](spark, SF)
    near = models._near(spark, SF).select("cell_id", "km")
    assert out.count() > 0 and out.join(near, "cell_id").where("km < 10").count() == 0


def test_sweep_has_every_condition(spark):
    out = {(r.factor, r.level): r for r in models.sensitivity_sweep(spark, SF).collect()}
    assert {k for k in out} == {("thin_km", "5"), ("thin_km", "10"), ("thin_km", "20"), ("subset", "full"), ("subset", "two_sources"), ("mask", "half"), ("folds", "2"), ("folds", "3"), ("folds", "4")}
    assert out["subset", "full"].n_occ == out["folds", "3"].n_occ == 10
