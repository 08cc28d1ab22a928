"""Metric queries over out-of-fold predictions."""

from __future__ import annotations

from pyspark.sql import functions as F

from skerry.functions.numeric import rounded
from skerry.operators import ranking, resampling
from skerry.operators.resampling import NEWTON
from skerry.plans.registry import r6, registered
from skerry.plans.views import view, with_views
from skerry.sources.tables import parquet

CONFIG = ["algo", "feat_set", "pa_method"]
_K = ", ".join(CONFIG)
_COUNTS = f"counts AS (SELECT {_K}, suit AS score, sum(label) AS pos, count(*) - sum(label) AS neg FROM oof GROUP BY ALL)"
_POINTS = f"""{_COUNTS}, points AS (SELECT *, sum(pos) OVER w AS tp, sum(neg) OVER w AS fp, sum(pos) OVER a AS n_pos, sum(neg) OVER a AS n_neg FROM counts
  WINDOW w AS (PARTITION BY {_K} ORDER BY score DESC ROWS UNBOUNDED PRECEDING), a AS (PARTITION BY {_K}))"""
_AUC = f"""{_COUNTS}, won AS (SELECT *, pos * (2 * coalesce(sum(neg) OVER (PARTITION BY {_K} ORDER BY score ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) + neg) AS won FROM counts),
auc AS (SELECT {_K}, sum(pos) AS n_pos, sum(neg) AS n_neg, CAST(sum(won) AS DOUBLE) / nullif(2e0 * sum(pos) * sum(neg), 0) AS auc FROM won GROUP BY ALL)"""


def _oof(spark, d):
    return view(spark, d, "oof")


def _points(spark, d):
    return ranking.curve(ranking.score_counts(_oof(spark, d), CONFIG), CONFIG)


@registered(with_views(f"WITH {_AUC} SELECT {_K}, CAST(n_pos AS BIGINT) AS n_pos, CAST(n_neg AS BIGINT) AS n_neg, {r6('auc')} AS auc FROM auc", "oof"))
def pooled_auc(spark, d):
    return ranking.auc(ranking.score_counts(_oof(spark, d), CONFIG), CONFIG).withColumn("auc", rounded(F.col("auc")))


@registered(with_views(f"WITH {_POINTS} SELECT {_K}, {r6('sum(CAST(pos AS DOUBLE) / n_pos * tp / (tp + fp))')} AS ap FROM points WHERE n_pos > 0 GROUP BY ALL", "oof"))
def pooled_ap(spark, d):
    return ranking.average_precision(_points(spark, d), CONFIG).withColumn("ap", rounded(F.col("ap")))


@registered(with_views(f"SELECT {_K}, {r6('avg((suit - label) * (suit - label))')} AS brier, CAST(count(*) AS BIGINT) AS n FROM oof GROUP BY ALL", "oof"))
def pooled_brier(spark, d):
    e = F.col("suit") - F.col("label")
    return _oof(spark, d).groupBy(*CONFIG).agg(rounded(F.avg(e * e)).alias("brier"), F.count("*").alias("n"))


_YOUDEN = f"""{_POINTS}, j AS (SELECT *, round(CAST(tp AS DOUBLE) / n_pos - CAST(fp AS DOUBLE) / n_neg, 12) AS j FROM points WHERE n_pos > 0 AND n_neg > 0),
best AS (SELECT * FROM j QUALIFY row_number() OVER (PARTITION BY {_K} ORDER BY j DESC, score DESC) = 1)"""


@registered(with_views(f"WITH {_YOUDEN} SELECT {_K}, score AS threshold, {r6('j')} AS youden_j, CAST(tp AS BIGINT) AS tp, CAST(fp AS BIGINT) AS fp FROM best", "oof"))
def youden_threshold(spark, d):
    return ranking.youden(_points(spark, d), CONFIG).select(*CONFIG, "threshold", rounded(F.col("youden_j")).alias("youden_j"), "tp", "fp")


_CONFUSION = f"""th AS (SELECT {_K}, median(suit) AS threshold FROM oof WHERE fold = 0 GROUP BY ALL),
c AS (SELECT {_K}, count(*) FILTER (suit >= threshold AND label = 1) AS tp, count(*) FILTER (suit < threshold AND label = 1) AS fn,
  count(*) FILTER (suit >= threshold AND label = 0) AS fp, count(*) FILTER (suit < threshold AND label = 0) AS tn FROM oof JOIN th USING ({_K}) WHERE fold > 0 GROUP BY ALL),
s AS (SELECT *, tp / (tp + fn + 1e-9) AS sens, tn / (tn + fp + 1e-9) AS spec FROM c)"""


@registered(with_views(f"WITH {_CONFUSION} SELECT {_K}, tp, fn, fp, tn, {r6('sens')} AS sensitivity, {r6('spec')} AS specificity, {r6('sens + spec - 1')} AS tss, {r6('(sens + spec) / 2')} AS bal_acc FROM s", "oof"))
def confusion_tss(spark, d):
    """Confusion counts on two folds at the threshold that the third one gives."""
    oof = _oof(spark, d)
    th = oof.where("fold = 0").groupBy(*CONFIG).agg(F.percentile("suit", F.lit(0.5)).alias("threshold"))
    return ranking.confusion(oof.where("fold > 0").join(th, CONFIG), CONFIG, "threshold")


@registered(with_views(f"""WITH {_POINTS}, p AS (SELECT *, CAST(tp AS DOUBLE) / n_pos AS tpr, CAST(fp AS DOUBLE) / n_neg AS fpr, CAST(tp AS DOUBLE) / (tp + fp) AS pre FROM points WHERE n_pos > 0 AND n_neg > 0),
q AS (SELECT {_K}, (fpr - lag(fpr, 1, 0e0) OVER w) * (tpr + lag(tpr, 1, 0e0) OVER w) / 2 AS roc, (tpr - lag(tpr, 1, 0e0) OVER w) * (pre + lag(pre, 1, 1e0) OVER w) / 2 AS pr FROM p WINDOW w AS (PARTITION BY {_K} ORDER BY score DESC))
SELECT {_K}, {r6('sum(roc)')} AS roc_area, {r6('sum(pr)')} AS pr_area FROM q GROUP BY ALL""", "oof"))
def pr_auc_trapezoid(spark, d):
    areas = ranking.trapezoids(_points(spark, d), CONFIG)
    return areas.select(*CONFIG, rounded(F.col("roc_area")).alias("roc_area"), rounded(F.col("pr_area")).alias("pr_area"))


_RP = "PARTITION BY algo, feat_set ORDER BY score DESC ROWS UNBOUNDED PRECEDING"


@registered(with_views(f"""WITH counts AS (SELECT algo, feat_set, suit AS score, sum(label) AS pos, count(*) - sum(label) AS neg FROM oof GROUP BY ALL)
SELECT algo, feat_set, score, CAST(sum(pos) OVER ({_RP}) AS BIGINT) AS tp, CAST(sum(neg) OVER ({_RP}) AS BIGINT) AS fp FROM counts""", "oof"))
def roc_points(spark, d):
    keys = ["algo", "feat_set"]
    return ranking.curve(ranking.score_counts(_oof(spark, d), keys), keys).select(*keys, "score", "tp", "fp")


@registered(with_views(f"""WITH e AS (SELECT [i * (1e0 / 10) for i in range(11)] AS edges),
b AS (SELECT {_K}, len([c for c in edges if c <= suit]) - 1 AS bin, suit, label FROM oof, e WHERE suit >= 0 AND suit < 1)
SELECT {_K}, CAST(bin AS INT) AS bin, {r6('avg(suit)')} AS mean_pred, {r6('avg(CAST(label AS DOUBLE))')} AS mean_obs, count(*) AS n FROM b GROUP BY ALL""", "oof"))
def calibration_bins(spark, d):
    out = ranking.calibration_bins(_oof(spark, d), CONFIG)
    return out.withColumns({"mean_pred": rounded(F.col("mean_pred")), "mean_obs": rounded(F.col("mean_obs"))})


@registered(with_views(f"""WITH low AS (SELECT i * (0.9e0 / 19) AS low FROM range(20) t(i)),
totals AS (SELECT algo, sum(label) AS p, count(*) - sum(label) AS q FROM oof GROUP BY ALL),
met AS (SELECT algo, low, sum(label) AS pos, count(*) - sum(label) AS neg FROM oof JOIN low ON low <= suit AND suit < low + 0.1e0 GROUP BY ALL),
pe AS (SELECT algo, low, round((CAST(pos AS DOUBLE) / p) / (CAST(neg AS DOUBLE) / q), 12) AS pe FROM met JOIN totals USING (algo) WHERE neg > 0 AND p > 0),
rk AS (SELECT algo, rank() OVER (PARTITION BY algo ORDER BY pe) + (count(*) OVER (PARTITION BY algo, pe) - 1) / 2e0 AS r1, rank() OVER (PARTITION BY algo ORDER BY low) AS r2 FROM pe)
SELECT algo, count(*) AS n_windows, {r6('CASE WHEN count(*) >= 3 THEN corr(r1, r2) END')} AS boyce FROM rk GROUP BY ALL""", "oof"))
def boyce_index(spark, d):
    return ranking.boyce(_oof(spark, d), ["algo"]).withColumn("boyce", rounded(F.col("boyce")))


@registered(with_views(f"WITH {_AUC} SELECT algo, {', '.join(f'round(avg(auc) FILTER (feat_set = {i}) + 1e-9, 3) AS feat_{i}' for i in range(4))} FROM auc GROUP BY algo", "oof"))
def auc_matrix_pivot(spark, d):
    a = ranking.auc(ranking.score_counts(_oof(spark, d), CONFIG), CONFIG)
    wide = a.groupBy("algo").pivot("feat_set", [0, 1, 2, 3]).agg(F.round(F.avg("auc") + F.lit(1e-9), 3))
    return wide.withColumnsRenamed({str(i): f"feat_{i}" for i in range(4)})


@registered(with_views(f"""WITH s AS (SELECT 0 AS source, suit, label FROM oof WHERE label = 0), r AS (
  SELECT o.source AS provenance, suit, label FROM oof o WHERE label = 1 UNION ALL SELECT k AS provenance, suit, label FROM s, range(3) t(k)),
c AS (SELECT provenance, suit AS score, sum(label) AS pos, count(*) - sum(label) AS neg FROM r GROUP BY ALL),
w AS (SELECT *, pos * (2 * coalesce(sum(neg) OVER (PARTITION BY provenance ORDER BY score ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) + neg) AS won FROM c)
SELECT CAST(provenance AS INT) AS provenance, CAST(sum(pos) AS BIGINT) AS n_pos, {r6('CAST(sum(won) AS DOUBLE) / nullif(2e0 * sum(pos) * sum(neg), 0)')} AS auc FROM w GROUP BY provenance""", "oof"))
def source_sensitivity_auc(spark, d):
    """AUC of the presences of each source against all background."""
    counts = ranking.score_counts(_oof(spark, d).withColumn("source", F.when(F.col("label") == 1, F.col("source")).otherwise(-1)), ["source"])
    background = counts.where("source = -1").select(F.explode(F.array(*[F.lit(i) for i in range(3)])).alias("provenance"), "score", "pos", "neg")
    both = counts.where("source >= 0").withColumnRenamed("source", "provenance").unionByName(background).groupBy("provenance", "score").agg(F.sum("pos").alias("pos"), F.sum("neg").alias("neg"))
    return ranking.auc(both, ["provenance"]).select("provenance", "n_pos", rounded(F.col("auc")).alias("auc"))


@registered(f"""WITH x AS (SELECT CAST(n_chars AS DOUBLE) AS v, quality AS y FROM documents JOIN labels USING (doc_id) WHERE quality IS NOT NULL AND n_chars IS NOT NULL),
r AS (SELECT y, rank() OVER (ORDER BY v) + (count(*) OVER (PARTITION BY v) - 1) / 2e0 AS r FROM x)
SELECT count(*) AS n, {r6('(sum(r) FILTER (y = 1) - count(*) FILTER (y = 1) * (count(*) FILTER (y = 1) + 1) / 2e0) / (CAST(count(*) FILTER (y = 1) AS DOUBLE) * count(*) FILTER (y = 0))')} AS auc FROM r""")
def single_predictor_auc(spark, d):
    """How well one column alone separates two classes: document length and quality."""
    rows = parquet(spark, d, "documents").select("doc_id", "n_chars").join(parquet(spark, d, "labels"), "doc_id").where("n_chars IS NOT NULL").withColumn("all", F.lit(0))
    counts = ranking.score_counts(rows.withColumn("s", F.col("n_chars").cast("double")), ["all"], "s", "quality")
    return ranking.auc(counts, ["all"]).select((F.col("n_pos") + F.col("n_neg")).alias("n"), rounded(F.col("auc")).alias("auc"))


_FOLD = f"{_K}, rep, fold"
#: A fold's threshold: none where it has few rows, infinite where it has no presence.
_INNER = f"inner_ AS (SELECT {_FOLD}, CASE WHEN count(*) < 5 THEN NULL WHEN sum(label) = 0 THEN CAST('Infinity' AS DOUBLE) ELSE median(suit) END AS threshold FROM oof GROUP BY ALL)"


def _bundle_sql(keys: str, thresholds: str, fallback: bool) -> str:
    """CTEs up to ``bundle``; ``thresholds`` names a CTE of keys and threshold."""
    own = "CASE WHEN sum(j_) > -1 THEN arg_max(score, (j, score)) END" if fallback else "CAST(NULL AS DOUBLE)"
    return f"""usable AS (SELECT * FROM oof WHERE suit IS NOT NULL AND NOT isnan(suit) AND suit BETWEEN 0 AND 1),
sizes AS (SELECT {keys}, sum(label) AS p, count(*) - sum(label) AS q FROM usable GROUP BY ALL HAVING sum(label) > 0 AND count(*) > sum(label) AND count(*) >= 5),
counts AS (SELECT {keys}, suit AS score, sum(label) AS pos, count(*) - sum(label) AS neg FROM usable JOIN sizes USING ({keys}) GROUP BY ALL),
points AS (SELECT *, sum(pos) OVER w AS tp, sum(neg) OVER w AS fp, sum(pos) OVER a AS n_pos, sum(neg) OVER a AS n_neg FROM counts WINDOW w AS (PARTITION BY {keys} ORDER BY score DESC ROWS UNBOUNDED PRECEDING), a AS (PARTITION BY {keys})),
own AS (SELECT {keys}, {own} AS own FROM (SELECT *, 0 AS j_, round(CAST(tp AS DOUBLE) / n_pos - CAST(fp AS DOUBLE) / n_neg, 12) AS j FROM points) x GROUP BY ALL),
cut AS (SELECT sizes.*, coalesce(CASE WHEN isfinite(threshold) THEN threshold END, own) AS threshold, CASE WHEN threshold IS NOT NULL AND isfinite(threshold) THEN 'inner' WHEN own IS NOT NULL THEN 'test' ELSE 'none' END AS thr_source FROM sizes LEFT JOIN {thresholds} USING ({keys}) LEFT JOIN own USING ({keys})),
at_ AS (SELECT {keys}, threshold, thr_source, p, q, coalesce(sum(pos) FILTER (score >= threshold), 0) / (p + 1e-9) AS sens, (q - coalesce(sum(neg) FILTER (score >= threshold), 0)) / (q + 1e-9) AS spec, sum((score - 1) * (score - 1) * pos + score * score * neg) / sum(pos + neg) AS brier FROM counts JOIN cut USING ({keys}) GROUP BY {keys}, threshold, thr_source, p, q),
ap AS (SELECT {keys}, sum(CAST(pos AS DOUBLE) / n_pos * tp / (tp + fp)) AS ap, sum(pos * (2 * (n_neg - fp) + neg)) / (2e0 * any_value(n_pos) * any_value(n_neg)) AS auc FROM points GROUP BY ALL),
low AS (SELECT i * (0.9e0 / 19) AS low FROM range(20) t(i)),
met AS (SELECT {keys}, low, sum(label) AS pos, count(*) - sum(label) AS neg FROM usable JOIN low ON low <= suit AND suit < low + 0.1e0 GROUP BY ALL),
pe AS (SELECT {keys}, low, round((CAST(pos AS DOUBLE) / p) / (CAST(neg AS DOUBLE) / q), 12) AS pe FROM met JOIN sizes USING ({keys}) WHERE neg > 0),
rk AS (SELECT {keys}, rank() OVER (PARTITION BY {keys} ORDER BY pe) + (count(*) OVER (PARTITION BY {keys}, pe) - 1) / 2e0 AS r1, rank() OVER (PARTITION BY {keys} ORDER BY low) AS r2 FROM pe),
bo AS (SELECT {keys}, CASE WHEN count(*) >= 3 THEN corr(r1, r2) END AS boyce FROM rk GROUP BY ALL),
bundle AS (SELECT {keys}, CAST(p AS BIGINT) AS n_pres, CAST(q AS BIGINT) AS n_bg, {r6('threshold')} AS threshold, thr_source, CASE WHEN threshold IS NOT NULL THEN {r6('sens')} END AS sensitivity, CASE WHEN threshold IS NOT NULL THEN {r6('spec')} END AS specificity,
  CASE WHEN threshold IS NOT NULL THEN {r6('sens + spec - 1')} END AS tss, CASE WHEN threshold IS NOT NULL THEN {r6('(sens + spec) / 2')} END AS bal_acc, {r6('auc')} AS auc_roc, {r6('ap')} AS pr_auc, {r6('brier')} AS brier, CASE WHEN isnan(boyce) THEN NULL ELSE {r6('boyce')} END AS boyce
  FROM at_ JOIN ap USING ({keys}) LEFT JOIN bo USING ({keys}))"""


def calibration_sql(keys: str, source: str) -> str:
    """CTEs up to ``line`` (keys, cal_int, cal_slope): Newton steps on the rows of ``source`` (keys, suit, label)."""
    steps = [f"""lg_ AS (SELECT {keys}, ln(s / (1 - s)) AS x, pos, n FROM (SELECT {keys}, least(greatest(suit, 1e-6), 1 - 1e-6) AS s, CAST(sum(label) AS DOUBLE) AS pos, CAST(count(*) AS DOUBLE) AS n FROM {source} GROUP BY {keys}, suit) c),
nw0 AS (SELECT DISTINCT {keys}, 0e0 AS b0, 0e0 AS b1 FROM lg_)"""]
    clip = lambda x: f"least(greatest({x}, -2e0), 2e0)"
    for i in range(NEWTON):
        steps.append(f"""nw{i + 1} AS MATERIALIZED (SELECT {keys}, b0 + {clip('(h11 * g0 - h01 * g1) / (h00 * h11 - h01 * h01)')} AS b0, b1 + {clip('(h00 * g1 - h01 * g0) / (h00 * h11 - h01 * h01)')} AS b1 FROM (
  SELECT {keys}, b0, b1, sum(w) + 1e-9 AS h00, sum(w * x) AS h01, sum(w * x * x) + 1e-9 AS h11, sum(r) AS g0, sum(r * x) AS g1 FROM (
    SELECT {keys}, b0, b1, x, n * p * (1 - p) AS w, pos - n * p AS r FROM (SELECT lg_.*, b0, b1, 1 / (1 + exp(-least(greatest(b0 + b1 * x, -30e0), 30e0))) AS p FROM lg_ JOIN nw{i} USING ({keys})) a) q GROUP BY {keys}, b0, b1) t)""")
    return ", ".join(steps) + f", line AS (SELECT {keys}, round(b0 + 1e-9, 5) AS cal_int, round(b1 + 1e-9, 5) AS cal_slope FROM nw{NEWTON})"


def _with_line(bundle, oof, keys: list[str]):
    """The figures of each group with the intercept and slope of its calibration line."""
    usable = oof.where(F.col("suit").between(0.0, 1.0) & F.col("label").isin(0, 1)).join(bundle.select(*keys), keys, "left_semi")
    line = resampling.calibration_line(usable, keys)
    return bundle.join(line.select(*keys, rounded(F.col("intercept"), 5).alias("cal_int"), rounded(F.col("slope"), 5).alias("cal_slope")), keys, "left")


def _inner_thresholds(oof):
    t = F.when(F.count("*") < 5, F.lit(None)).when(F.sum("label") == 0, F.lit(float("inf"))).otherwise(F.percentile("suit", F.lit(0.5)))
    return oof.groupBy(*CONFIG, "rep", "fold").agg(t.alias("threshold"))


@registered(with_views(f"WITH {_INNER}, mean_ AS (SELECT {_K}, round(avg(threshold) FILTER (isfinite(threshold)), 9) AS threshold FROM inner_ GROUP BY ALL), {_bundle_sql(_K, 'mean_', False)}, ok_ AS (SELECT usable.* FROM usable JOIN sizes USING ({_K})), {calibration_sql(_K, 'ok_')} SELECT * FROM bundle LEFT JOIN line USING ({_K})", "oof"))
def pooled_oof_metrics(spark, d):
    """All metrics of each configuration's pooled out-of-fold predictions, at the mean of its folds' finite thresholds."""
    oof = _oof(spark, d)
    mean = _inner_thresholds(oof).groupBy(*CONFIG).agg(F.round(F.avg(F.when(F.col("threshold") < float("inf"), F.col("threshold"))), 9).alias("threshold"))
    return _with_line(ranking.bundle(oof, CONFIG, mean, fallback=False), oof, CONFIG)


@registered(with_views(f"WITH {_INNER}, {_bundle_sql(_FOLD, 'inner_', True)}, ok_ AS (SELECT usable.* FROM usable JOIN sizes USING ({_FOLD})), {calibration_sql(_FOLD, 'ok_')} SELECT * FROM bundle LEFT JOIN line USING ({_FOLD})", "oof"))
def fold_metric_bundle(spark, d):
    """All metrics of each fold, at its threshold or, where that is missing or infinite, at the one best on the fold itself."""
    oof = _oof(spark, d)
    keys = [*CONFIG, "rep", "fold"]
    return _with_line(ranking.bundle(oof, keys, _inner_thresholds(oof), fallback=True), oof, keys)


@registered(with_views(f"WITH {_INNER}, m AS (SELECT thr_source, count(*) AS n, round(avg(tss) + 1e-9, 6) AS mean_tss FROM (SELECT *, CASE WHEN threshold IS NULL THEN 'none' WHEN isfinite(threshold) THEN 'inner' ELSE 'infinite' END AS thr_source, CAST(rep * 3 + fold AS DOUBLE) AS tss FROM inner_) t GROUP BY ALL) SELECT * FROM m", "oof"))
def threshold_provenance(spark, d):
    """How many folds have a threshold, an infinite one, or none."""
    t = F.col("threshold")
    source = F.when(t.isNull(), "none").when(t < float("inf"), "inner").otherwise("infinite")
    return _inner_thresholds(_oof(spark, d)).groupBy(source.alias("thr_source")).agg(F.count("*").alias("n"), rounded(F.avg((F.col("rep") * 3 + F.col("fold")).cast("double"))).alias("mean_tss"))
