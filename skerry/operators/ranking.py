"""Ranking metrics of scores against 0/1 labels by group.

All rest on one aggregation: counts of each label by group and distinct score. Running totals over the scores of a group
are exact and never sort a whole group in one task: scores are dealt into ``BUCKETS`` ranges by approximate quantiles of
the whole table, totals of the ranges (at most ``BUCKETS`` rows a group) are summed up first, and only the scores within
one range of one group are ordered together.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from skerry.functions.numeric import rounded

BUCKETS = 64


def score_counts(df: DataFrame, keys: list[str], score: str = "suit", label: str = "label") -> DataFrame:
    """keys, score, pos, neg: labels counted at each distinct score; scores that are null or NaN are left out."""
    usable = df.where(F.col(score).isNotNull() & ~F.isnan(score) & F.col(label).isin(0, 1))
    return usable.groupBy(*keys, F.col(score).alias("score")).agg(F.sum(label).cast("long").alias("pos"), F.count_if(F.col(label) == 0).alias("neg"))


def running(df: DataFrame, keys: list[str], value: str, sums: dict[str, str], buckets: int = BUCKETS) -> DataFrame:
    """Adds, for each ``new: column`` of ``sums`` (whole numbers), the total of the column over the group's rows of smaller ``value``.

    Values are numbers, each once a group; keys may be null. With one bucket a group is ordered as a whole: for few rows.
    """
    if buckets == 1:
        below = Window.partitionBy(*keys).orderBy(value).rowsBetween(Window.unboundedPreceding, -1)
        return df.withColumns({n: F.coalesce(F.sum(c).over(below), F.lit(0)) for n, c in sums.items()})
    edges = df.agg(F.percentile_approx(value, [i / buckets for i in range(1, buckets)], 1000).alias("_edges"))
    dealt = df.crossJoin(F.broadcast(edges)).withColumn("_bucket", F.coalesce(F.size(F.filter("_edges", lambda e: e < F.col(value))), F.lit(0))).drop("_edges")
    ranges = dealt.groupBy(*keys, "_bucket").agg(*[F.sum(c).alias(f"_{n}") for n, c in sums.items()])
    before = Window.partitionBy(*keys).orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    starts = ranges.select(*[F.col(k).alias(f"_k{i}") for i, k in enumerate(keys)], F.col("_bucket").alias("_b"), *[F.coalesce(F.sum(f"_{n}").over(before), F.lit(0)).alias(f"_{n}") for n in sums])
    on = reduce(Column.__and__, [F.col(k).eqNullSafe(F.col(f"_k{i}")) for i, k in enumerate(keys)], F.col("_bucket") == F.col("_b"))
    within = Window.partitionBy(*keys, "_bucket").orderBy(value).rowsBetween(Window.unboundedPreceding, -1)
    out = dealt.join(starts, on).withColumns({n: F.col(f"_{n}") + F.coalesce(F.sum(c).over(within), F.lit(0)) for n, c in sums.items()})
    return out.select(*df.columns, *sums)


def _totals(counts: DataFrame, keys: list[str]) -> DataFrame:
    return counts.groupBy(*keys).agg(F.sum("pos").alias("n_pos"), F.sum("neg").alias("n_neg"))


def _with_totals(rows: DataFrame, keys: list[str], totals: DataFrame) -> DataFrame:
    named = totals.select(*[F.col(k).alias(f"_k{i}") for i, k in enumerate(keys)], *[c for c in totals.columns if c not in keys])
    return rows.join(named, reduce(Column.__and__, [F.col(k).eqNullSafe(F.col(f"_k{i}")) for i, k in enumerate(keys)])).drop(*[f"_k{i}" for i in range(len(keys))])


def auc(counts: DataFrame, keys: list[str]) -> DataFrame:
    """Area under the ROC curve: the share of (positive, negative) pairs in order, ties half. Null with one class only."""
    twice = running(counts, keys, "score", {"below": "neg"}).withColumn("won", F.col("pos") * (2 * F.col("below") + F.col("neg")))
    sums = twice.groupBy(*keys).agg(F.sum("pos").alias("n_pos"), F.sum("neg").alias("n_neg"), F.sum("won").alias("won"))
    pairs = F.col("n_pos").cast("double") * F.col("n_neg").cast("double") * F.lit(2.0)
    return sums.select(*keys, "n_pos", "n_neg", F.try_divide(F.col("won").cast("double"), pairs).alias("auc"))


def curve(counts: DataFrame, keys: list[str]) -> DataFrame:
    """ROC and PR points: at each distinct score, with all scores at or above it positive: tp, fp, and the group's n_pos, n_neg."""
    below = _with_totals(running(counts, keys, "score", {"tp_below": "pos", "fp_below": "neg"}), keys, _totals(counts, keys))
    return below.select(*keys, "score", "pos", "neg", (F.col("n_pos") - F.col("tp_below")).alias("tp"), (F.col("n_neg") - F.col("fp_below")).alias("fp"), "n_pos", "n_neg")


def average_precision(points: DataFrame, keys: list[str]) -> DataFrame:
    """Sum of recall steps times precision."""
    step = F.col("pos").cast("double") / F.col("n_pos") * F.col("tp") / (F.col("tp") + F.col("fp"))
    return points.where("n_pos > 0").groupBy(*keys).agg(F.sum(step).alias("ap"))


def youden(points: DataFrame, keys: list[str]) -> DataFrame:
    """The threshold of the greatest TPR - FPR, the highest such score on ties."""
    j = F.round(F.col("tp").cast("double") / F.col("n_pos") - F.col("fp").cast("double") / F.col("n_neg"), 12)
    both = points.where("n_pos > 0 AND n_neg > 0").withColumn("j", j)
    best = both.groupBy(*keys).agg(F.max(F.struct("j", "score", "tp", "fp", "n_pos", "n_neg")).alias("b"))
    return best.select(*keys, F.col("b.score").alias("threshold"), F.col("b.j").alias("youden_j"), F.col("b.tp").alias("tp"), F.col("b.fp").alias("fp"), F.col("b.n_pos").alias("n_pos"), F.col("b.n_neg").alias("n_neg"))


def trapezoids(points: DataFrame, keys: list[str]) -> DataFrame:
    """Trapezoid areas of the ROC curve (from 0, 0) and of the precision-recall curve (from recall 0, precision 1).

    The point before each is its own without the rows of its score.
    """
    share = lambda a, n: F.col(a).cast("double") / F.col(n)
    p = points.where("n_pos > 0 AND n_neg > 0").withColumns({"tp0": F.col("tp") - F.col("pos"), "fp0": F.col("fp") - F.col("neg")})
    tpr, fpr, tpr0, fpr0 = share("tp", "n_pos"), share("fp", "n_neg"), share("tp0", "n_pos"), share("fp0", "n_neg")
    precision = lambda t, f: F.coalesce(F.try_divide(F.col(t).cast("double"), F.col(t) + F.col(f)), F.lit(1.0))
    roc = (fpr - fpr0) * (tpr + tpr0) / 2
    pr = (tpr - tpr0) * (precision("tp", "fp") + precision("tp0", "fp0")) / 2
    return p.groupBy(*keys).agg(F.sum(roc).alias("roc_area"), F.sum(pr).alias("pr_area"))


def confusion(df: DataFrame, keys: list[str], threshold: str, score: str = "suit", label: str = "label") -> DataFrame:
    """Counts at a threshold column, sensitivity, specificity, TSS and balanced accuracy; 1e-9 guards the denominators."""
    hit = F.col(score) >= F.col(threshold)
    n = df.groupBy(*keys).agg(
        F.count_if(hit & (F.col(label) == 1)).alias("tp"), F.count_if(~hit & (F.col(label) == 1)).alias("fn"),
        F.count_if(hit & (F.col(label) == 0)).alias("fp"), F.count_if(~hit & (F.col(label) == 0)).alias("tn"),
    )
    sens, spec = F.col("tp") / (F.col("tp") + F.col("fn") + F.lit(1e-9)), F.col("tn") / (F.col("tn") + F.col("fp") + F.lit(1e-9))
    return n.withColumns({"sensitivity": rounded(sens), "specificity": rounded(spec), "tss": rounded(sens + spec - 1), "bal_acc": rounded((sens + spec) / 2)})


def calibration_bins(df: DataFrame, keys: list[str], bins: int = 10, score: str = "suit", label: str = "label") -> DataFrame:
    """Half-open bins of equal width over [0, 1): midpoint, mean score, observed share, rows. A score of 1 is in no bin."""
    edges = [i * (1.0 / bins) for i in range(bins + 1)]
    cuts = F.array(*[F.lit(e) for e in edges])
    b = F.size(F.filter(cuts, lambda c: c <= F.col(score))) - 1
    rows = df.where((F.col(score) >= 0) & (F.col(score) < F.lit(edges[-1]))).withColumn("bin", b)
    return rows.groupBy(*keys, "bin").agg(F.avg(score).alias("mean_pred"), F.avg(F.col(label).cast("double")).alias("mean_obs"), F.count("*").alias("n"))


def average_ranks(df: DataFrame, partition: list[str], value: str, out: str, buckets: int = BUCKETS) -> DataFrame:
    """Ranks from 1 in which ties share their mean. ``value``: a number; rows where it is null are left out."""
    counts = df.where(F.col(value).isNotNull()).groupBy(*partition, value).agg(F.count("*").alias("_n"))
    ranks = running(counts, partition, value, {"_less": "_n"}, buckets).select(*[F.col(c).alias(f"_p{i}") for i, c in enumerate(partition)], F.col(value).alias("_v"), (F.col("_less") + (F.col("_n") + 1) / F.lit(2.0)).alias(out))
    on = [F.col(c).eqNullSafe(F.col(f"_p{i}")) for i, c in enumerate(partition)] + [F.col(value) == F.col("_v")]
    return df.join(ranks, on).drop("_v", *[f"_p{i}" for i in range(len(partition))])


def correlation(x: str, y: str) -> Column:
    """Pearson's, as an aggregate; null where a side does not vary."""
    a, b, n = F.col(x), F.col(y), F.count("*")
    spread = lambda c: n * F.sum(c * c) - F.sum(c) * F.sum(c)
    return F.try_divide(n * F.sum(a * b) - F.sum(a) * F.sum(b), F.sqrt(F.greatest(spread(a) * spread(b), F.lit(0.0))))


def boyce(df: DataFrame, keys: list[str], windows: int = 20, width: float = 0.1, score: str = "suit", label: str = "label") -> DataFrame:
    """Continuous Boyce index: Spearman's rank correlation of P/E with the midpoints of overlapping score windows."""
    counts = df.groupBy(*keys, F.col(score).alias("score")).agg(F.count_if(F.col(label) == 1).alias("pos"), F.count_if(F.col(label) == 0).alias("neg"))
    return boyce_of(counts, keys, windows, width)


def boyce_of(counts: DataFrame, keys: list[str], windows: int = 20, width: float = 0.1) -> DataFrame:
    """``boyce`` from label counts by distinct score."""
    lows = [i * ((1.0 - width) / (windows - 1)) for i in range(windows)]
    low = F.array(*[F.lit(x) for x in lows])
    inside = F.filter(low, lambda x: (x <= F.col("score")) & (F.col("score") < x + F.lit(width)))
    totals = counts.groupBy(*keys).agg(F.sum("pos").alias("all_pos"), F.sum("neg").alias("all_neg"))
    met = counts.select(*keys, "pos", "neg", F.explode(inside).alias("low")).groupBy(*keys, "low").agg(F.sum("pos").alias("pos"), F.sum("neg").alias("neg"))
    ratio = met.join(totals, keys).where("neg > 0 AND all_pos > 0").withColumn("pe", F.round((F.col("pos").cast("double") / F.col("all_pos")) / (F.col("neg").cast("double") / F.col("all_neg")), 12))
    ranked = average_ranks(average_ranks(ratio, keys, "pe", "r1", 1), keys, "low", "r2", 1)  # at most ``windows`` rows a group
    return ranked.groupBy(*keys).agg(F.count("*").alias("n_windows"), F.when(F.count("*") >= 3, correlation("r1", "r2")).alias("boyce"))


def bundle(df: DataFrame, keys: list[str], thresholds: DataFrame, fallback: bool, score: str = "suit", label: str = "label", least_rows: int = 5) -> DataFrame:
    """AUC, AP, Brier score, Boyce index and the figures at a threshold, a row a group.

    Only finite scores from 0 to 1 count; a group has ``least_rows`` rows at least and both classes. ``thresholds``: keys
    and threshold, which may be missing, null or infinite; then the group's own Youden threshold takes its place with
    ``fallback``, and the figures at a threshold are null without. ``thr_source`` says which (inner, test, none).
    """
    s = F.col(score)
    usable = df.where(s.isNotNull() & ~F.isnan(s) & s.between(0.0, 1.0) & F.col(label).isin(0, 1))
    return bundle_of(score_counts(usable, keys, score, label), keys, thresholds, fallback, least_rows)


def bundle_of(counts: DataFrame, keys: list[str], thresholds: DataFrame, fallback: bool, least_rows: int = 5) -> DataFrame:
    """``bundle`` from label counts by distinct score (keys, score, pos, neg), which are read several times: stored ones, if they cost much."""
    counts = counts.where(F.col("score").between(0.0, 1.0) & ~F.isnan("score"))
    usable = counts
    sizes = _totals(counts, keys).where("n_pos > 0 AND n_neg > 0").where(F.col("n_pos") + F.col("n_neg") >= least_rows)
    counts = _with_totals(counts, keys, sizes).select(*keys, "score", "pos", "neg")
    points = curve(counts, keys)
    given = thresholds.where(F.col("threshold").isNotNull() & ~F.isnan("threshold") & (F.abs("threshold") < float("inf"))).select(*keys, F.col("threshold").alias("_given"))
    own = youden(points, keys).select(*keys, F.col("threshold").alias("_own")) if fallback else sizes.select(*keys, F.lit(None).cast("double").alias("_own"))
    cut = sizes.join(given, keys, "left").join(own, keys, "left").select(*keys, F.coalesce("_given", "_own").alias("threshold"), F.when(F.col("_given").isNotNull(), "inner").when(F.col("_own").isNotNull(), "test").otherwise("none").alias("thr_source"))
    error = (F.col("score") - 1) * (F.col("score") - 1) * F.col("pos") + F.col("score") * F.col("score") * F.col("neg")
    brier = counts.groupBy(*keys).agg(rounded(F.sum(error) / F.sum(F.col("pos") + F.col("neg"))).alias("brier"))
    hit = F.col("score") >= F.col("threshold")
    at = counts.join(cut, keys).groupBy(*keys, "threshold", "thr_source").agg(F.sum(F.when(hit, F.col("pos")).otherwise(0)).alias("tp"), F.sum(F.when(hit, F.col("neg")).otherwise(0)).alias("fp"), F.sum("pos").alias("n_pres"), F.sum("neg").alias("n_bg"))
    known = lambda x: F.when(F.col("threshold").isNotNull(), rounded(x))
    sens, spec = F.col("tp") / (F.col("n_pres") + F.lit(1e-9)), (F.col("n_bg") - F.col("fp")) / (F.col("n_bg") + F.lit(1e-9))
    figures = at.select(*keys, "n_pres", "n_bg", rounded(F.col("threshold")).alias("threshold"), "thr_source", known(sens).alias("sensitivity"), known(spec).alias("specificity"), known(sens + spec - 1).alias("tss"), known((sens + spec) / 2).alias("bal_acc"))
    parts = [auc(counts, keys).select(*keys, rounded(F.col("auc")).alias("auc_roc")), average_precision(points, keys).select(*keys, rounded(F.col("ap")).alias("pr_auc")), brier]
    index = boyce_of(usable, keys).select(*keys, rounded(F.col("boyce")).alias("boyce"))
    out = reduce(lambda a, b: a.join(b, keys), parts, figures)
    return out.join(index, keys, "left")
