"""Model queries: a table of tasks whose models are grown over all rows of their training folds, and figures over every row."""

from __future__ import annotations

import json

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from skerry.functions.numeric import hash_order, rounded
from skerry.operators import modelling, ranking, resampling, spatial, trees
from skerry.operators.neighbours import nearest_other
from skerry.operators.trees import Model, Spec
from skerry.plans.registry import registered
from skerry.plans.spatial import ANGLE, _blocks, _near
from skerry.plans.views import view
from skerry.sources.tables import fingerprint, parquet, stored, union_by_name, written

FEATURES = ["quantity", "price", "unit", "discount", "tax"]
#: Feature sets; one with fewer than three of its features in the table is left out.
FEATURE_SETS = {"S": FEATURES[:3], "SA": FEATURES[:4], "SP": [*FEATURES[:3], "tax"], "SAP": FEATURES}
GRIDS = {
    "forest": [{"trees": t, "depth": d, "min_leaf": m} for t in (10, 20) for d in (2, 4, 6) for m in (1, 5)],
    "boosting": [{"rounds": r, "depth": d, "rate": 0.3} for r in (2, 4, 6, 10) for d in (1, 2, 3)],
    "hinges": [{"strength": s, "l1_ratio": r} for s in (0.01, 0.1, 1.0, 10.0) for r in (0.0, 0.5, 1.0)],
}
CANDIDATES, FOLDS = 10, 3


def rows_of(spark, d) -> DataFrame:
    """Every line as id, fold, inner fold, label and the predictors, complete rows only.

    The id is all columns that identify a line (order and line number alone repeat), h a 64-bit hash of them for draws.
    """
    of = ["l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", F.round(F.col("l_extendedprice") * 100).cast("long")]
    return parquet(spark, d, "lineitem").select(
        F.concat_ws("-", *[F.col(c).cast("string") if isinstance(c, str) else c.cast("string") for c in of]).alias("id"), F.xxhash64(*of).alias("h"),
        (F.col("l_orderkey") % FOLDS).cast("int").alias("fold"), F.expr(f"CAST(l_orderkey div {FOLDS} % {FOLDS} AS INT)").alias("inner"), (F.col("l_returnflag") == "R").cast("int").alias("label"),
        F.col("l_quantity").alias("quantity"), (F.col("l_extendedprice") / 1000).alias("price"), (F.col("l_extendedprice") / F.col("l_quantity")).alias("unit"), (F.col("l_discount") * 100).alias("discount"), (F.col("l_tax") * 100).alias("tax"),
    ).dropna()


def task_table(spark, columns: list[str]) -> DataFrame:
    """task, algo, feat_set, test_fold: the cross product of algorithms, usable feature sets and outer folds."""
    sets = [f for f, members in FEATURE_SETS.items() if sum(c in columns for c in members) >= 3]
    return spark.createDataFrame([(json.dumps([a, f, k]), a, f, k) for a in GRIDS for f in sets for k in range(FOLDS)], "task string, algo string, feat_set string, test_fold int")


def candidates(algo: str, seed: int = 42) -> list[dict]:
    """``CANDIDATES`` settings of the grid, without replacement, in a seeded order."""
    order = np.random.default_rng(seed).permutation(len(GRIDS[algo]))[:CANDIDATES]
    return [GRIDS[algo][i] for i in order]


def _training(rows: DataFrame) -> DataFrame:
    """The rows of each outer fold's training side: ``task`` is the fold that tests."""
    folds = F.array(*[F.lit(k) for k in range(FOLDS)])
    return rows.withColumn("_k", F.explode(F.filter(folds, lambda k: k != F.col("fold")))).withColumn("task", F.col("_k").cast("string")).drop("_k")


def bins_of(spark, d) -> trees.Bins:
    """Bins over every row, each read once, as stored for these files: a later fit has the same."""
    made = lambda: spark.createDataFrame([(json.dumps(vars(trees.bins_of(rows_of(spark, d), FEATURES))),)], "bins string")
    return trees.Bins(**json.loads(stored(spark, "bins", fingerprint(spark, [f"{d}/lineitem.parquet"]), made).first().bins))


def _passes(spark, d, near: list[str]) -> trees.Passes:
    """Tables over the rows of each outer fold, read once, that train for the other folds."""
    shares = {str(k): [str(t) for t in range(FOLDS) if t != k] for k in range(FOLDS)}
    return trees.Passes(rows_of(spark, d).withColumn("task", F.col("fold").cast("string")), bins_of(spark, d), near, shares)


def _choose(spark, d) -> DataFrame:
    """task, spec, model: predictors by variance inflation, settings and threshold by inner folds, and the model fitted to all training rows."""
    rows, bins = _training(rows_of(spark, d)), bins_of(spark, d)  # rows are read again for each sum over them, not written
    corr = modelling.correlations(rows, ["task"], FEATURES)
    tasks = {}
    for r in task_table(spark, rows.columns).collect():  # as many as the design has
        columns = FEATURE_SETS[r.feat_set]
        if (str(r.test_fold),) in corr:
            at = [FEATURES.index(c) for c in columns]
            keep = modelling.variance_inflation(corr[str(r.test_fold),][np.ix_(at, at)])
            tasks[r.task] = Spec(str(r.test_fold), tuple(columns[i] for i in keep), r.algo)
    passes = _passes(spark, d, trees.near_of(tasks, bins))
    chosen = modelling.nested_choice(rows, tasks, {a: candidates(a) for a in GRIDS}, bins, FOLDS, passes=passes)
    final = {n: Spec(s.task, s.columns, s.algo, chosen[n][0]) for n, s in tasks.items()}
    return modelling.models_table(trees.fit(rows, final, bins, passes=passes), {n: {"threshold": chosen[n][1], "task": s.task} for n, s in tasks.items()}, spark)


def specifications(spark, d) -> DataFrame:
    """task, spec, model of all tasks, as stored for these files: fitted once, read by every later query and session."""
    return stored(spark, "models", fingerprint(spark, [f"{d}/lineitem.parquet"]), lambda: _choose(spark, d))


def fitted(spark, d) -> dict[str, Model]:
    """The models of all tasks (36)."""
    return {r.task: Model.from_json(r.model) for r in specifications(spark, d).collect()}


def held_out(spark, d, algos=tuple(GRIDS), feat_sets=tuple(FEATURE_SETS)) -> DataFrame:
    """Every row with each task that tests it."""
    rows = rows_of(spark, d)
    tasks = task_table(spark, rows.columns).where(F.col("algo").isin(*algos) & F.col("feat_set").isin(*feat_sets))
    return rows.join(F.broadcast(tasks), F.col("fold") == F.col("test_fold"))


def _tested(algos=tuple(GRIDS), feat_sets=tuple(FEATURE_SETS)) -> dict[int, list[str]]:
    """The tasks that test each fold, in the same order of algorithms and feature sets."""
    return {k: [json.dumps([a, f, k]) for a in algos for f in feat_sets] for k in range(FOLDS)}


def _task_columns(df: DataFrame) -> DataFrame:
    t = F.from_json("task", "array<string>")
    return df.withColumns({"algo": t[0], "feat_set": t[1], "test_fold": t[2].cast("int")})


_TASK = ["algo", "feat_set", "test_fold"]


@registered()
def oof_predictions(spark, d):
    """Out-of-fold predictions of every configuration for every row."""
    wide = modelling.predict_each(rows_of(spark, d), FEATURES, fitted(spark, d), _tested(), ["id", "label"])
    each = [F.struct(F.lit(a).alias("algo"), F.lit(f).alias("feat_set"), F.col(f"suit_{i}").alias("suit")) for i, (a, f) in enumerate((a, f) for a in GRIDS for f in FEATURE_SETS)]
    return wide.select("id", "label", F.col("fold").alias("test_fold"), F.inline(F.array(*each))).where("suit IS NOT NULL").select(*_TASK, "id", "label", "suit")


@registered()
def nested_cv(spark, d):
    """Every algorithm, feature set and outer fold: choice and threshold by inner folds, all metrics over every row of the outer one."""
    counts = _task_columns(modelling.counts_each(rows_of(spark, d), FEATURES, fitted(spark, d), _tested())).select(*_TASK, "score", "pos", "neg")
    spec = lambda path, kind="string": F.get_json_object("spec", f"$.{path}").cast(kind)
    columns = F.array_join(F.from_json(spec("columns"), "array<string>"), ",")
    chosen = _task_columns(specifications(spark, d)).select(*_TASK, spec("threshold", "double").alias("threshold"), columns.alias("selected"), spec("settings").alias("hp"))
    return ranking.bundle_of(counts, _TASK, chosen.select(*_TASK, "threshold"), fallback=True).join(chosen.drop("threshold"), _TASK)


def _selected(spark, d, feat_set: str = "SAP") -> DataFrame:
    """task, spec of the forests of one feature set."""
    return _task_columns(specifications(spark, d).select("task", "spec")).where((F.col("algo") == "forest") & (F.col("feat_set") == feat_set))


def refit(spark, d, specs: DataFrame, all_rows: bool = False) -> dict[str, Model]:
    """Models from stored specifications alone: task, predictors, settings and seed. With ``all_rows`` each sees every row."""
    out = {}
    for r in specs.select("task", "spec").collect():
        s = json.loads(r.spec)
        out[r.task] = Spec("all" if all_rows else s["task"], tuple(s["columns"]), s["algo"], s["settings"], None, s["seed"] + (17 * int(s["task"]) if all_rows else 0))
    passes = _passes(spark, d, trees.near_of(out, bins_of(spark, d)))
    if all_rows:
        passes.shares = {k: ["all"] for k in passes.shares}
    return trees.fit(passes.rows, out, passes.bins, passes=passes)


#: Cuts between whole numbers of the predictors that have few.
_STUMP_CUTS = {"quantity": [float(q) for q in range(1, 50)], "discount": [float(q) for q in range(10)], "tax": [float(q) for q in range(8)]}
_STUMP_ROWS = """rows AS (SELECT l_orderkey % 3 AS fold, CASE WHEN l_returnflag = 'R' THEN 1 ELSE 0 END AS y, l_quantity AS quantity, round(l_discount * 100) AS discount, round(l_tax * 100) AS tax FROM lineitem
  WHERE l_orderkey IS NOT NULL AND l_returnflag IS NOT NULL AND l_quantity IS NOT NULL AND l_discount IS NOT NULL AND l_tax IS NOT NULL)"""


@registered(f"""WITH {_STUMP_ROWS}, t AS (SELECT CAST(k AS INT) AS test_fold, rows.* FROM rows, range(3) f(k) WHERE fold <> k),
n AS (SELECT test_fold, count(*) AS n, sum(y) AS pos FROM t GROUP BY ALL),
w AS (SELECT t.*, CASE WHEN y = 1 THEN n / (2e0 * pos) ELSE n / (2e0 * (n - pos)) END AS w FROM t JOIN n USING (test_fold)),
c AS ({" UNION ALL ".join(f"SELECT test_fold, '{f}' AS feature, cut, {f} <= cut AS low, y, w FROM w, unnest({cuts}) u(cut)" for f, cuts in _STUMP_CUTS.items())}),
g AS (SELECT test_fold, feature, cut, sum(w) FILTER (low) AS lw, sum(w * y) FILTER (low) AS lg, sum(w) FILTER (NOT low) AS hw, sum(w * y) FILTER (NOT low) AS hg FROM c GROUP BY ALL),
b AS (SELECT *, row_number() OVER (PARTITION BY test_fold ORDER BY round(lg * lg / lw + hg * hg / hw - (lg + hg) * (lg + hg) / (lw + hw), 9) DESC, feature = 'tax', feature = 'discount', cut) AS r FROM g WHERE lw > 0 AND hw > 0)
SELECT test_fold, feature, cut, round(lg / lw, 9) AS low, round(hg / hw, 9) AS high FROM b WHERE r = 1""")
def tree_stumps(spark, d):
    """The first cut of a tree over all training rows of each fold: the predictor and cut of the greatest gain, and the shares on both sides."""
    at = lambda c: F.round(F.col(c)).alias(c)
    rows = written(_training(rows_of(spark, d)).select("task", "label", "h", "inner", "quantity", at("discount"), at("tax")), "stumps")
    bins = trees.Bins(_STUMP_CUTS, {}, {}, {})
    settings = {"trees": 1, "depth": 1, "min_leaf": 1, "bootstrap": False, "features": len(_STUMP_CUTS)}
    models = trees.fit(rows, {str(k): Spec(str(k), tuple(_STUMP_CUTS), "forest", settings) for k in range(FOLDS)}, bins)
    out = [(int(k), list(_STUMP_CUTS)[t.feature[0]], float(t.cut[0]), round(float(t.value[1]), 9), round(float(t.value[2]), 9)) for k, m in models.items() for t in m.trees if t.feature[0] >= 0]
    return spark.createDataFrame(out, "test_fold int, feature string, cut double, low double, high double")


_DRAWS = 5
_PRIMES = modelling.strides(_DRAWS, 42)


@registered(f"""WITH r AS (SELECT l_orderkey % 3 AS fold, CASE WHEN l_returnflag = 'R' THEN 1 ELSE 0 END AS label, l_quantity AS quantity,
  concat_ws('-', l_orderkey, l_linenumber, l_partkey, l_suppkey, CAST(round(l_extendedprice * 100) AS BIGINT)) AS id FROM lineitem WHERE l_orderkey IS NOT NULL AND l_returnflag IS NOT NULL AND l_quantity IS NOT NULL AND l_extendedprice IS NOT NULL AND l_linenumber IS NOT NULL AND l_partkey IS NOT NULL AND l_suppkey IS NOT NULL),
k AS (SELECT *, row_number() OVER (PARTITION BY fold ORDER BY CAST('0x' || substr(md5('42:' || id), 1, 12) AS BIGINT), id) - 1 AS nth, count(*) OVER (PARTITION BY fold) AS n FROM r),
e AS (SELECT k.*, draw, ({_PRIMES}[draw] * nth + draw) % n AS src FROM k, range(1, {_DRAWS + 1}) t(draw)),
v AS (SELECT e.fold, e.draw, e.label, o.quantity AS score FROM e JOIN k o ON o.fold = e.fold AND o.nth = e.src UNION ALL SELECT fold, 0, label, quantity FROM k),
c AS (SELECT fold, draw, score, sum(label) AS pos, count(*) - sum(label) AS neg FROM v GROUP BY ALL),
w AS (SELECT *, pos * (2 * coalesce(sum(neg) OVER (PARTITION BY fold, draw ORDER BY score ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) + neg) AS won FROM c)
SELECT CAST(fold AS INT) AS test_fold, CAST(draw AS INT) AS draw, round(CAST(sum(won) AS DOUBLE) / nullif(2e0 * sum(pos) * sum(neg), 0) + 1e-9, 6) AS auc FROM w GROUP BY ALL""")
def dealt_predictor_auc(spark, d):
    """AUC of one predictor alone in each fold: as it is (draw 0), and dealt anew over all rows of the fold."""
    rows = rows_of(spark, d).select(F.col("fold").cast("string").alias("task"), "id", "label", "quantity")
    auc = ranking.auc(modelling.dealt_counts(rows, "quantity", _DRAWS, 42), ["task", "draw"])
    return auc.select(F.col("task").cast("int").alias("test_fold"), "draw", rounded(F.col("auc")).alias("auc"))


@registered()
def refit_selected(spark, d):
    """The selected models fitted again from their stored specifications: AUC as reported and as reconstructed."""
    again = refit(spark, d, _selected(spark, d))
    auc = lambda models, name: ranking.auc(modelling.counts_each(rows_of(spark, d), FEATURES, models, _tested(("forest",), ("SAP",))), ["task"]).select("task", F.col("auc").alias(name))
    both = auc(fitted(spark, d), "reported_auc").join(auc(again, "reconstructed_auc"), "task")
    return _task_columns(both).select(*_TASK, "reported_auc", "reconstructed_auc", (F.abs(F.col("reported_auc") - F.col("reconstructed_auc")) < 1e-9).alias("same"))


@registered()
def full_refit_ensemble(spark, d):
    """Every selected specification fitted to all folds and every row scored by each: mean, deviation, the class at the median threshold, and support."""
    specs = _selected(spark, d)
    models = refit(spark, d, specs, all_rows=True)
    cut = specs.agg(F.percentile(F.get_json_object("spec", "$.threshold").cast("double"), F.lit(0.5)).alias("cut"))
    every = sorted(models)
    wide = modelling.predict_each(rows_of(spark, d), FEATURES, models, dict.fromkeys(range(FOLDS), every), ["id"]).crossJoin(F.broadcast(cut))
    suits = [F.col(f"suit_{i}") for i in range(len(every))]  # a row an id: every model has scored it there
    n = F.lit(float(len(every)))
    mean = sum(suits, F.lit(0.0)) / n
    spread = F.sqrt(sum(((s - F.col("mean")) * (s - F.col("mean")) for s in suits), F.lit(0.0)) / (n - 1)) if len(every) > 1 else F.lit(None).cast("double")
    support = sum(((s >= F.col("cut")).cast("double") for s in suits), F.lit(0.0)) / n
    out = wide.withColumn("mean", mean).withColumns({"sd": spread, "support": support})
    if not every:
        out = out.where("false")
    return out.select("id", "mean", "sd", (F.col("mean") >= F.col("cut")).cast("int").alias("above"), "support")


@registered()
def ensemble_support(spark, d):
    """Shares of rows that all models, four in five, and fewer than half support, with those between and the 99th percentile of the deviation."""
    s = full_refit_ensemble(spark, d)
    share = lambda c: F.avg(c.cast("double"))
    return s.agg(F.count("*").alias("n"), share(F.col("support") == 1).alias("by_all"), share(F.col("support") >= 0.8).alias("by_most"), share(F.col("support").between(0.5, 0.8) & (F.col("support") < 0.8)).alias("by_half"), share(F.col("support") < 0.5).alias("by_few"), share(F.col("support") == 0).alias("by_none"), share(F.col("above") == 1).alias("above"), F.percentile("sd", F.lit(0.99)).alias("sd_p99"))


def _decreases(spark, d, groups: dict[str, list[str]], draws: int, seed: int) -> DataFrame:
    """algo, feat_set, test_fold, grp, mean decrease of AUC; 0 for groups none of whose features was selected."""
    held = held_out(spark, d, ("forest",), ("SAP",)).select("task", "id", "label", *FEATURES)
    counts = modelling.dealt_scores(held, fitted(spark, d), FEATURES, groups, draws, seed)
    each = written(ranking.auc(counts, ["task", "grp", "draw"]), "dealt")
    base = each.where("draw = 0").select("task", F.col("auc").alias("base"))
    mean = each.where("draw > 0").join(base, "task").groupBy("task", "grp").agg(F.avg(F.col("base") - F.col("auc")).alias("importance"))
    every = base.select("task").crossJoin(F.broadcast(spark.createDataFrame([(g,) for g in groups], "grp string")))
    return _task_columns(every.join(mean, ["task", "grp"], "left")).select(*_TASK, "grp", F.coalesce("importance", F.lit(0.0)).alias("importance"))


@registered()
def permutation_importance(spark, d):
    """Loss of AUC over every held-out row when a predictor is dealt anew over its fold, mean of 30; 0 for predictors left out."""
    return _decreases(spark, d, {f: [f] for f in FEATURES}, 30, 42).withColumnRenamed("grp", "feature")


@registered()
def grouped_permutation(spark, d):
    """As ``permutation_importance``, with groups of predictors dealt anew together, 100 times."""
    return _decreases(spark, d, {"price": ["price", "unit", "quantity"], "terms": ["discount", "tax"]}, 100, 43)


@registered()
def shap_long(spark, d):
    """Shapley values of every held-out row under its fold's forest of the widest set, a row a predictor."""
    wide = modelling.shapley_each(rows_of(spark, d), FEATURES, fitted(spark, d), {k: n for k, (n,) in _tested(("forest",), ("SAP",)).items()}, ["id"])
    each = F.inline(F.array(*[F.struct(F.lit(c).alias("feature"), F.col(f"shap_{c}").alias("shap"), F.col(f"value_{c}").alias("value")) for c in FEATURES]))
    return wide.select(F.lit("forest").alias("algo"), F.lit("SAP").alias("feat_set"), F.col("fold").alias("test_fold"), "id", each).where("shap IS NOT NULL")


@registered()
def importance_summary(spark, d):
    """Predictors by mean loss of AUC: how often selected, the losses' and the mean absolute Shapley values' intervals over the
    models, the direction (rank correlation of value and Shapley value), and both scaled to their greatest."""
    picked = _task_columns(specifications(spark, d)).where("algo = 'forest'").select(F.explode(F.from_json(F.get_json_object("spec", "$.columns"), "array<string>")).alias("feature"))
    n_models = _task_columns(specifications(spark, d)).where("algo = 'forest'").agg(F.count("*").alias("m"))
    every = spark.createDataFrame([(f,) for f in FEATURES], "feature string")
    chosen = every.join(picked.groupBy("feature").agg(F.count("*").alias("k")), "feature", "left").crossJoin(F.broadcast(n_models)).select("feature", (F.coalesce("k", F.lit(0)) / F.col("m")).alias("selection_frequency"))
    nth = F.col("test_fold").cast("long")
    loss = resampling.mean_ci(permutation_importance(spark, d).withColumn("nth", nth), "feature", "importance", 2000, 5)
    shap = written(shap_long(spark, d).select("test_fold", "feature", "shap", "value"), "shap")
    by_model = shap.groupBy("test_fold", "feature").agg(F.avg(F.abs("shap")).alias("v")).withColumn("nth", F.row_number().over(Window.partitionBy("feature").orderBy("test_fold")).cast("long") - 1)
    size = resampling.mean_ci(by_model, "feature", "v", 2000, 6).withColumnsRenamed({"mean": "mean_abs_shap", "lo": "shap_lo", "hi": "shap_hi"})
    ranks = ranking.average_ranks(ranking.average_ranks(shap.select("feature", "shap", "value"), ["feature"], "value", "rv"), ["feature"], "shap", "rs")
    rho = ranks.groupBy("feature").agg(ranking.correlation("rv", "rs").alias("shap_direction_rho"))
    out = chosen.join(loss, "feature").join(size, "feature", "left").join(rho, "feature", "left").fillna(0.0, ["mean_abs_shap"])
    all_ = Window.partitionBy(F.lit(0))  # five rows
    scaled = lambda c: F.coalesce(F.try_divide(F.col(c), F.max(c).over(all_)), F.lit(0.0))
    return out.withColumns({"scaled_loss": scaled("mean"), "scaled_shap": scaled("mean_abs_shap")}).orderBy(F.desc("mean"), "feature").limit(6)


@registered()
def shap_swarm(spark, d):
    """What a beeswarm draws: Shapley values with their predictor's value scaled to its range, and the cell of a grid of
    100 by which points of like height are spread."""
    shap = written(shap_long(spark, d).select("feature", "shap", "value"), "shap")
    ends = shap.groupBy("feature").agg(F.min("value").alias("low"), F.max("value").alias("high"), F.min("shap").alias("s_low"), F.max("shap").alias("s_high"))
    both = shap.join(F.broadcast(ends), "feature")
    scaled = F.coalesce(F.try_divide(F.col("value") - F.col("low"), F.col("high") - F.col("low")), F.lit(0.5))
    cell = F.floor(F.coalesce(F.try_divide(F.col("shap") - F.col("s_low"), F.col("s_high") - F.col("s_low")), F.lit(0.0)) * 99).cast("int")
    return both.withColumns({"colour": scaled, "cell": cell}).groupBy("feature", "cell").agg(F.count("*").alias("n"), F.avg("shap").alias("shap"), F.avg("colour").alias("colour"))


@registered()
def ale_curve(spark, d):
    """Accumulated local effects over decile edges of every held-out row: mean finite differences, summed up and centred by weight."""
    models, held = fitted(spark, d), held_out(spark, d, ("forest",), ("SAP",))
    deciles = [i / 10 for i in range(11)]
    found = held.groupBy("task").agg(*[F.percentile(c, F.array(*[F.lit(q) for q in deciles])).alias(c) for c in FEATURES]).collect()
    edges = {(r.task, c): e for r in found for c in models[r.task].spec.columns if len(e := np.unique(r[c])) >= 4}

    def run(frames):
        for f in frames:
            for task, part in f.groupby("task"):
                m = models[task]
                x = part[list(m.spec.columns)].to_numpy(float)
                for j, c in enumerate(m.spec.columns):
                    if (task, c) not in edges:
                        continue
                    e = edges[task, c]
                    at = np.clip(np.searchsorted(e, x[:, j], side="right") - 1, 0, len(e) - 2)
                    low, high = x.copy(), x.copy()
                    low[:, j], high[:, j] = e[at], e[at + 1]
                    step = m.predict(high) - m.predict(low)
                    n = np.bincount(at, minlength=len(e) - 1)
                    yield pd.DataFrame({"task": task, "feature": c, "bin": np.arange(len(e) - 1), "x": (e[1:] + e[:-1]) / 2, "n": n, "step": np.bincount(at, step, len(e) - 1)})

    bins = held.mapInPandas(run, "task string, feature string, bin int, x double, n long, step double").groupBy("task", "feature", "bin").agg(F.first("x").alias("x"), F.sum("n").alias("n"), F.sum("step").alias("step"))
    upto = Window.partitionBy("task", "feature").orderBy("bin").rowsBetween(Window.unboundedPreceding, 0)
    curve = bins.withColumn("ale", F.sum(F.col("step") / F.greatest("n", F.lit(1))).over(upto))
    whole = Window.partitionBy("task", "feature")
    w = F.greatest("n", F.lit(1))
    return _task_columns(curve.withColumn("ale", F.col("ale") - F.sum(F.col("ale") * w).over(whole) / F.sum(w).over(whole))).select(*_TASK, "feature", "x", "ale", "n")


@registered()
def vif_select(spark, d):
    """Predictors kept by stepwise variance inflation; correlations over every row, in one pass."""
    rows = rows_of(spark, d)
    found = modelling.correlations(rows.withColumn("all", F.lit(0)), ["all"], FEATURES)
    keep = modelling.variance_inflation(found[0,]) if found else []
    return spark.createDataFrame([(f, i in keep) for i, f in enumerate(FEATURES)], "feature string, kept boolean")


def applicability(train: DataFrame, tested: DataFrame, features: list[str], share: float = 0.95, times: str | None = None) -> DataFrame:
    """The tested rows with near, limit, inside: the distance to the nearest training row, all predictors in the training
    side's deviations, and whether that is at most the ``share`` percentile of the training rows' own nearest distances.

    Rows hold the features; with ``times`` a row stands for so many. Equal rows are asked once: a training row with an equal
    one, and a tested row equal to a training row, are at 0.
    """
    n = F.lit(1) if times is None else F.col(times)
    held = train.groupBy(*features).agg(F.sum(n).alias("_n"))
    held = written(held.withColumn("_id", F.monotonically_increasing_id()), "training")
    weighed = lambda e: F.try_divide(F.sum(e * F.col("_n")), F.sum("_n"))
    mean = held.agg(*[weighed(F.col(c)) for c in features]).first()
    off = [F.col(c) - F.lit(m or 0.0) for c, m in zip(features, mean, strict=True)]
    scale = held.agg(*[F.sqrt(weighed(x * x)) for x in off]).first()
    v = F.array(*[x / F.lit(d or 1.0) for x, d in zip(off, scale, strict=True)]).alias("v")
    rows = held.select(F.col("_id").alias("id"), v)
    own = nearest_other(held.where("_n = 1").select(F.col("_id").alias("query"), v), rows).select(F.col("query").alias("_id"), "d")
    own = held.select("_id", "_n").join(own.hint("merge"), "_id", "left").withColumn("d", F.when(F.col("_n") > 1, 0.0).otherwise(F.col("d")))
    limit = own.agg(F.percentile("d", F.lit(share), F.col("_n")).alias("limit"))
    asked = written(tested.select(*features).distinct().join(held.select(*features).hint("merge"), features, "left_anti").withColumn("query", F.monotonically_increasing_id()), "tested")
    far = nearest_other(asked.select("query", v), rows, itself=False)
    far = asked.join(far.hint("merge"), "query").select(*features, F.col("d").alias("near")).unionByName(held.select(*features, F.lit(0.0).alias("near")))
    return tested.join(far.hint("merge"), features).crossJoin(F.broadcast(limit)).withColumn("inside", F.col("near") <= F.col("limit"))


@registered()
def aoa_fraction(spark, d):
    """Area of applicability by fold: share of every test row whose nearest training row is no farther than training rows are from each other (95th percentile); all rows on both sides."""
    rows = written(rows_of(spark, d).groupBy("fold", *FEATURES).agg(F.count("*").alias("n")), "rows")
    folds = []
    for k in range(FOLDS):
        a = applicability(rows.where(F.col("fold") != k), rows.where(F.col("fold") == k), FEATURES, times="n")
        inside = F.sum(F.when(F.col("inside"), F.col("n")).otherwise(0)) / F.sum("n")
        folds.append(a.groupBy(F.lit(k).alias("test_fold"), "limit").agg(inside.alias("inside"), F.sum("n").alias("n")))
    return union_by_name(folds)


PLACE = ["f1", "f2", "parity"]


def _places(spark, d) -> DataFrame:
    """Cells with their predictors and distance to the nearest presence."""
    return view(spark, d, "cells").withColumn("parity", (F.col("zone") % 2).cast("double")).join(_near(spark, d).select("cell_id", "km"), "cell_id").dropna()


def _presences(spark, d) -> DataFrame:
    """Presences with the predictors of their nearest cell."""
    cells = view(spark, d, "cells").withColumn("parity", (F.col("zone") % 2).cast("double"))
    near = spatial.nearest(view(spark, d, "occ").select(F.col("occ_id").alias("a_id"), "lon", "lat"), cells.select(F.col("cell_id").alias("b_id"), "lon", "lat"), 100.0)
    found = near.join(cells.select(F.col("cell_id").alias("b_id"), *PLACE), "b_id").select(F.col("a_id").alias("id"), *PLACE)
    return found.dropna()


def _forests(rows: DataFrame, n_trees: int, depth: int) -> dict[str, Model]:
    """A forest on the places of each task."""
    rows = written(rows.select("task", "label", F.xxhash64("id", "label").alias("h"), F.lit(None).cast("int").alias("inner"), *PLACE), "places")
    names = [r.task for r in rows.select("task").distinct().collect()]
    specs = {n: Spec(n, tuple(PLACE), "forest", {"trees": n_trees, "depth": depth, "min_leaf": 1}) for n in names}
    return trees.fit(rows, specs, trees.bins_of(rows, PLACE))


def _pilot(spark, d) -> DataFrame:
    """cell_id, km, score: a pilot forest's score of every cell (null without a model), from presences and at most 200 cells beyond 10 km."""
    cells = _places(spark, d)
    background = cells.where("km >= 10").orderBy(hash_order(F.col("cell_id"), 3), "cell_id").limit(200)
    train = _presences(spark, d).select("id", F.lit(1).alias("label"), *PLACE).unionByName(background.select(F.col("cell_id").alias("id"), F.lit(0).alias("label"), *PLACE))
    models = _forests(train.withColumn("task", F.lit("pilot")), 50, 6)
    rows = cells.select(F.lit("pilot").alias("task"), F.col("cell_id").alias("id"), F.lit(0).alias("label"), *PLACE)
    scored = modelling.predict(rows, models).select(F.col("id").alias("cell_id"), F.col("suit").alias("score"))
    return cells.select("cell_id", "km").join(scored, "cell_id", "left")


@registered()
def pa_two_step(spark, d):
    """Background beyond 10 km where a pilot model's score is in its lowest third (0.5 where it has none); all beyond 10 km if that is too little."""
    far = _pilot(spark, d).where("km >= 10").fillna(0.5, ["score"])
    cut = far.agg(F.percentile("score", F.lit(0.33)).alias("cut"))
    low = far.crossJoin(F.broadcast(cut)).withColumn("low", (F.col("score") <= F.col("cut")).cast("int"))
    have = low.agg(F.sum("low").alias("have"))
    use = low.crossJoin(F.broadcast(have)).where("low = 1 OR have < 100")
    return use.orderBy(hash_order(F.col("cell_id"), 4), "cell_id").limit(100).select("cell_id", "score")


@registered()
def pa_uncertainty_zone(spark, d):
    """Background beyond 10 km where the pilot is unsure (0.2 to 0.6; 0.4 where it has no score); all beyond 10 km if that is under half of what is asked."""
    far = _pilot(spark, d).where("km >= 10").fillna(0.4, ["score"]).withColumn("unsure", F.col("score").between(0.2, 0.6).cast("int"))
    have = far.agg(F.sum("unsure").alias("have"))
    use = far.crossJoin(F.broadcast(have)).where("unsure = 1 OR have < 50")
    return use.orderBy(hash_order(F.col("cell_id"), 5), "cell_id").limit(100).select("cell_id", "score")


def pseudo_absences(method: str, spark, d) -> DataFrame:
    """cell_id by the method's name; unknown names take the random one."""
    from skerry.plans.spatial import pa_random, pa_spatial_constrained

    chosen = {"random": pa_random, "spatial": pa_spatial_constrained, "two_step": pa_two_step, "uncertainty_zone": pa_uncertainty_zone}
    return chosen.get(method, pa_random)(spark, d).select("cell_id")


@registered()
def pa_dispatch(spark, d):
    """Background cells by each method, and by an unknown one."""
    return union_by_name([pseudo_absences(m, spark, d).select(F.lit(m).alias("method"), "cell_id") for m in ("random", "spatial", "two_step", "uncertainty_zone", "unheard_of")])


@registered()
def sensitivity_sweep(spark, d):
    """Mean and deviation of AUC over spatial folds when presences are thinned, masked, taken from one source, or dealt into other folds.

    A condition and fold is one forest, fitted on its training presences and background (at most 200 cells beyond 10 km in
    training blocks), and judged on every presence of the fold and every cell beyond 10 km in its block.
    """
    occ, places = view(spark, d, "occ"), _presences(spark, d)
    thinned = [resampling.spatial_thin(occ.select("occ_id", "lon", "lat"), float(km), [1]).select(F.col("occ_id").alias("id"), F.lit("thin_km").alias("factor"), F.lit(str(km)).alias("level"), F.lit(3).alias("k")) for km in (5, 10, 20)]
    named = lambda rows, factor, level, k=3: rows.select(F.col("occ_id").alias("id"), F.lit(factor).alias("factor"), F.lit(level).alias("level"), F.lit(k).alias("k"))
    conditions = [*thinned, named(occ, "subset", "full"), named(occ.where("occ_id % 3 > 0"), "subset", "two_sources"), named(occ.where("zone < 13"), "mask", "half"), *[named(occ, "folds", str(k), k) for k in (2, 3, 4)]]
    chosen = union_by_name(conditions)
    folds, blocks = [], []
    for k in (2, 3, 4):
        dealt = spatial.projection_folds(occ, k, ANGLE)
        folds.append(dealt.select(F.col("occ_id").alias("id"), F.lit(k).alias("k"), (F.col("fold") - 1).cast("int").alias("fold")))
        cells = spatial.cell_blocks(view(spark, d, "cells").select("cell_id", "lon", "lat"), spatial.fold_cuts(dealt), ANGLE)
        blocks.append(cells.select("cell_id", F.lit(k).alias("k"), F.col("block").cast("int").alias("fold")))
    presence = chosen.join(union_by_name(folds), ["id", "k"]).join(places, "id").withColumn("label", F.lit(1))
    far = _places(spark, d).where("km >= 10").select("cell_id", *PLACE)
    background = far.join(union_by_name(blocks), "cell_id").join(F.broadcast(chosen.select("factor", "level", "k").distinct()), "k").withColumn("label", F.lit(0)).withColumnRenamed("cell_id", "id")
    rows = written(presence.unionByName(background, allowMissingColumns=True).select("factor", "level", "k", "fold", F.col("id").cast("long").alias("id"), F.col("label").cast("int").alias("label"), *PLACE), "sweep")
    task = F.to_json(F.array(F.col("factor"), F.col("level"), F.col("test").cast("string")))
    tested = rows.withColumn("test", F.explode(F.sequence(F.lit(0), F.col("k") - 1))).withColumn("task", task)
    w = Window.partitionBy("task", "label").orderBy(hash_order(F.col("id"), 9), "id")
    train = tested.where("fold <> test").withColumn("n", F.row_number().over(w)).where("label = 1 OR n <= 200")
    models = _forests(train, 20, 6)
    auc = ranking.auc(ranking.score_counts(modelling.predict(tested.where("fold = test").select("task", "id", "label", *PLACE), models), ["task"]), ["task"])
    t = F.from_json("task", "array<string>")
    out = auc.select(t[0].alias("factor"), t[1].alias("level"), "auc", "n_pos").groupBy("factor", "level")
    return out.agg(rounded(F.avg("auc"), 4).alias("auc_mean"), rounded(F.stddev_samp("auc"), 4).alias("auc_sd"), F.count("auc").alias("n_folds"), F.sum("n_pos").alias("n_occ"))
