"""Queries whose draws are rows: bootstrap intervals, permutations, thinning and null baselines."""

from __future__ import annotations

from pyspark.sql import functions as F

from skerry.functions.numeric import rounded
from skerry.operators import resampling, spatial
from skerry.plans.metrics import CONFIG, calibration_sql
from skerry.plans.registry import r6, registered
from skerry.plans.spatial import _HAV
from skerry.plans.views import view, with_views
from skerry.sources.tables import written


def _u(*parts: str) -> str:
    return "CAST('0x' || substr(md5(" + " || ':' || ".join(parts) + "), 1, 8) AS BIGINT)"


@registered(with_views(f"""WITH c AS (SELECT algo, label AS kind, CAST(CASE WHEN label = 1 THEN occ_id ELSE rep * 100 + fold END AS BIGINT) AS cluster, suit AS score, count(*) AS n FROM oof GROUP BY ALL),
k AS (SELECT *, row_number() OVER (PARTITION BY algo, kind ORDER BY cluster) - 1 AS nth, count(*) OVER (PARTITION BY algo, kind) AS m FROM (SELECT DISTINCT algo, kind, cluster FROM c) x),
t AS (SELECT algo, kind, draw, {_u("'42'", "draw", "algo", "kind", "nth")} % m AS nth, count(*) AS times FROM k, range(1, 501) r(draw) GROUP BY ALL),
p AS (SELECT algo, draw, score, sum(CASE WHEN kind = 1 THEN n * times ELSE 0 END) AS pos, sum(CASE WHEN kind = 0 THEN n * times ELSE 0 END) AS neg FROM c JOIN k USING (algo, kind, cluster) JOIN t USING (algo, kind, nth) GROUP BY ALL
  UNION ALL SELECT algo, 0, score, sum(CASE WHEN kind = 1 THEN n ELSE 0 END), sum(CASE WHEN kind = 0 THEN n ELSE 0 END) FROM c GROUP BY ALL),
w AS (SELECT *, pos * (2 * coalesce(sum(neg) OVER (PARTITION BY algo, draw ORDER BY score ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) + neg) AS won FROM p),
a AS (SELECT algo, draw, CAST(sum(won) AS DOUBLE) / nullif(2e0 * sum(pos) * sum(neg), 0) AS auc FROM w GROUP BY ALL),
i AS (SELECT algo, quantile_cont(auc, 0.025) AS lo, quantile_cont(auc, 0.975) AS hi, count(*) AS draws FROM a WHERE draw > 0 AND auc IS NOT NULL GROUP BY ALL HAVING count(*) >= 10)
SELECT algo, {r6('auc')} AS auc, {r6('lo')} AS lo, {r6('hi')} AS hi, draws FROM a LEFT JOIN i USING (algo) WHERE draw = 0""", "oof"))
def clustered_bootstrap_ci(spark, d):
    """AUC of each algorithm with the interval of 500 draws of presences and of background partitions."""
    out = resampling.clustered_auc_ci(view(spark, d, "oof"), ["algo"])
    return out.select("algo", *[rounded(F.col(c)).alias(c) for c in ("auc", "lo", "hi")], "draws")


_FOLD_MEANS = "m AS (SELECT algo, rep * 3 + fold AS nth, CAST(floor(CAST(sum(response) AS DOUBLE) / count(*)) AS BIGINT) AS v FROM fold_metrics GROUP BY ALL)"


@registered(with_views(f"""WITH {_FOLD_MEANS}, n AS (SELECT algo, count(*) AS n, avg(v) AS mean FROM m GROUP BY ALL),
d AS (SELECT algo, draw, {_u("'42'", "draw", "algo", "nth")} % n AS nth FROM m JOIN n USING (algo), range(1, 2001) r(draw)),
b AS (SELECT algo, draw, avg(v) AS m FROM d JOIN m USING (algo, nth) GROUP BY ALL)
SELECT algo, round(any_value(mean), 4) AS mean, round(quantile_cont(m, 0.025), 4) AS lo, round(quantile_cont(m, 0.975), 4) AS hi FROM b JOIN n USING (algo) GROUP BY algo""", "fold_metrics"))
def bootstrap_mean_ci(spark, d):
    """Mean response over the partitions, with the interval of 2,000 draws."""
    mean = F.floor(F.sum("response").cast("double") / F.count("*"))
    m = view(spark, d, "fold_metrics").groupBy("algo", (F.col("rep") * 3 + F.col("fold")).cast("long").alias("nth")).agg(mean.alias("v"))
    return resampling.mean_ci(m, "algo", "v").select("algo", *[F.round(c, 4).alias(c) for c in ("mean", "lo", "hi")])


@registered(with_views(f"""WITH {_FOLD_MEANS.replace('SELECT algo, ', 'SELECT feat_set, ')}, d AS (SELECT a.feat_set AS contrast, a.nth, a.v - b.v AS v FROM m a JOIN m b USING (nth) WHERE b.feat_set = 0 AND a.feat_set > 0),
n AS (SELECT contrast, count(*) AS n, avg(v) AS mean FROM d GROUP BY ALL),
s AS (SELECT contrast, draw, {_u("'7'", "draw", "contrast", "nth")} % n AS nth FROM d JOIN n USING (contrast), range(1, 5001) r(draw)),
b AS (SELECT contrast, draw, avg(v) AS m FROM s JOIN d USING (contrast, nth) GROUP BY ALL)
SELECT contrast, round(any_value(mean), 4) AS mean, round(quantile_cont(m, 0.025), 4) AS lo, round(quantile_cont(m, 0.975), 4) AS hi FROM b JOIN n USING (contrast) GROUP BY contrast""", "fold_metrics"))
def contrast_ci(spark, d):
    """Feature sets against the base set by partition: mean difference and the interval of 5,000 draws."""
    mean = F.floor(F.sum("response").cast("double") / F.count("*"))
    m = view(spark, d, "fold_metrics").groupBy("feat_set", (F.col("rep") * 3 + F.col("fold")).cast("long").alias("nth")).agg(mean.alias("v"))
    base = m.where("feat_set = 0").select("nth", F.col("v").alias("base"))
    diffs = m.where("feat_set > 0").join(base, "nth").select(F.col("feat_set").alias("contrast"), "nth", (F.col("v") - F.col("base")).alias("v"))
    return resampling.mean_ci(diffs, "contrast", "v", 5000, 7).select("contrast", *[F.round(c, 4).alias(c) for c in ("mean", "lo", "hi")])


@registered(with_views(f"WITH {calibration_sql('algo', 'oof')} SELECT algo, cal_int AS intercept, cal_slope AS slope FROM line", "oof"))
def calibration_slope(spark, d):
    """Intercept and slope of the label's logistic regression on the score's logit."""
    line = resampling.calibration_line(view(spark, d, "oof"), ["algo"])
    return line.select("algo", *[rounded(F.col(c), 5).alias(c) for c in ("intercept", "slope")])


_K = ", ".join(CONFIG)


@registered(with_views(f"""WITH c AS (SELECT {_K}, label AS kind, CAST(CASE WHEN label = 1 THEN occ_id ELSE rep * 100 + fold END AS BIGINT) AS cluster, suit AS score, count(*) AS n FROM oof GROUP BY ALL),
k AS (SELECT *, row_number() OVER (PARTITION BY {_K}, kind ORDER BY cluster) - 1 AS nth, count(*) OVER (PARTITION BY {_K}, kind) AS m FROM (SELECT DISTINCT {_K}, kind, cluster FROM c) x),
t AS (SELECT {_K}, kind, draw, {_u("'42'", "draw", *CONFIG, "kind", "nth")} % m AS nth, count(*) AS times FROM k, range(1, 201) r(draw) GROUP BY ALL),
p AS (SELECT {_K}, draw, score, sum(CASE WHEN kind = 1 THEN n * times ELSE 0 END) AS pos, sum(CASE WHEN kind = 0 THEN n * times ELSE 0 END) AS neg FROM c JOIN k USING ({_K}, kind, cluster) JOIN t USING ({_K}, kind, nth) GROUP BY ALL
  UNION ALL SELECT {_K}, 0, score, sum(CASE WHEN kind = 1 THEN n ELSE 0 END), sum(CASE WHEN kind = 0 THEN n ELSE 0 END) FROM c GROUP BY ALL),
w AS (SELECT *, sum(pos) OVER d AS tp, sum(neg) OVER d AS fp, sum(pos) OVER a AS n_pos, sum(neg) OVER a AS n_neg FROM p WINDOW d AS (PARTITION BY {_K}, draw ORDER BY score DESC ROWS UNBOUNDED PRECEDING), a AS (PARTITION BY {_K}, draw)),
e AS (SELECT {_K}, draw, CAST(sum(pos * (2 * (n_neg - fp) + neg)) AS DOUBLE) / (2e0 * any_value(n_pos) * any_value(n_neg)) AS auc, sum(CAST(pos AS DOUBLE) / n_pos * tp / (tp + fp)) AS ap, sum((score - 1) * (score - 1) * pos + score * score * neg) / sum(pos + neg) AS brier FROM w WHERE n_pos > 0 AND n_neg > 0 GROUP BY ALL)
SELECT {_K}, count(*) FILTER (draw > 0) AS draws, {", ".join(f"{r6(f'max({m}) FILTER (draw = 0)')} AS {n}" for m, n in (('auc', 'auc_roc'), ('ap', 'pr_auc'), ('brier', 'brier')))},
  {", ".join(f"CASE WHEN count(*) FILTER (draw > 0) >= 10 THEN {r6(f'quantile_cont({m}, {q}) FILTER (draw > 0)')} END AS {n}_ci_{e}" for m, n in (('auc', 'auc_roc'), ('ap', 'pr_auc'), ('brier', 'brier')) for e, q in (('lo', 0.025), ('hi', 0.975)))} FROM e GROUP BY {_K}""", "oof"))
def pooled_metric_intervals(spark, d):
    """AUC, PR-AUC and Brier score of each configuration with the intervals of 200 draws of presences and of background partitions."""
    out = resampling.clustered_ci(view(spark, d, "oof"), CONFIG, 200)
    names = {"auc": "auc_roc", "ap": "pr_auc", "brier": "brier"}
    return out.select(*CONFIG, "draws", *[rounded(F.col(m)).alias(n) for m, n in names.items()], *[rounded(F.col(f"{m}_{e}")).alias(f"{n}_ci_{e}") for m, n in names.items() for e in ("lo", "hi")])


@registered(with_views(f"""WITH s AS (SELECT count(*) FILTER (value > 5000) AS n_pos, count(*) AS n FROM occ),
u AS (SELECT draw, i, n_pos, {_u("'42'", "draw", "i")} AS u FROM s, range(1, 5001) r(draw), unnest(range(1, n + 1)) x(i)),
k AS (SELECT draw, i, n_pos, row_number() OVER w AS rank, count(*) FILTER (i <= n_pos) OVER (PARTITION BY draw ORDER BY u, i ROWS UNBOUNDED PRECEDING) AS hits FROM u WINDOW w AS (PARTITION BY draw ORDER BY u, i)),
p AS (SELECT draw, avg(CAST(hits AS DOUBLE) / rank) AS ap FROM k WHERE i <= n_pos GROUP BY ALL)
SELECT count(*) AS draws, {r6('avg(ap)')} AS mean_ap, {r6('quantile_cont(ap, 0.975)')} AS high FROM p""", "occ"))
def random_pr_null(spark, d):
    """Average precision of 5,000 random orders of the presences, those of high value being the hits."""
    sizes = view(spark, d, "occ").agg(F.count_if(F.col("value") > 5000).alias("n_pos"), F.count("*").alias("n"))
    ap = resampling.random_precision(sizes)
    return ap.agg(F.count("*").alias("draws"), rounded(F.avg("ap")).alias("mean_ap"), rounded(F.percentile("ap", F.lit(0.975))).alias("high"))


@registered(with_views(f"""WITH c AS (SELECT occ_id, lon, lat, value - avg(value) OVER () AS z FROM occ),
l AS (SELECT a.occ_id AS a_id, b.occ_id AS b_id FROM c a JOIN c b ON a.occ_id <> b.occ_id WHERE {_HAV.format(a='a', b='b')} <= 100 AND {_HAV.format(a='a', b='b')} > 0),
k AS (SELECT occ_id, z, row_number() OVER (ORDER BY occ_id) AS nth FROM c),
s AS (SELECT draw, occ_id, row_number() OVER (PARTITION BY draw ORDER BY {_u("'42'", "draw", "occ_id")}, occ_id) AS nth FROM k, range(1, 10000) r(draw)),
dz AS (SELECT draw, s.occ_id, z FROM s JOIN k USING (nth) UNION ALL SELECT 0, occ_id, z FROM k),
i AS (SELECT a.draw, round((SELECT count(*) FROM c) * sum(a.z * b.z) / ((SELECT count(*) FROM l) * (SELECT sum(z * z) FROM c)), 9) AS morans FROM l JOIN dz a ON a.occ_id = a_id JOIN dz b ON b.occ_id = b_id AND a.draw = b.draw GROUP BY a.draw)
SELECT round((count(*) FILTER (abs(morans) >= (SELECT abs(morans) FROM i WHERE draw = 0)) + 1) / (count(*) + 1e0), 9) AS p, count(*) AS draws FROM i WHERE draw > 0""", "occ"))
def morans_perm_p(spark, d):
    """How often values dealt anew over the points, 9,999 times, are as far from independence; one added to both."""
    occ = view(spark, d, "occ")
    z = occ.crossJoin(F.broadcast(occ.agg(F.avg("value").alias("m")))).select("occ_id", "lon", "lat", (F.col("value") - F.col("m")).alias("z"))
    places = written(z.where("lon IS NOT NULL AND lat IS NOT NULL").select("lon", "lat").distinct().withColumn("place", F.monotonically_increasing_id()), "places")
    at = lambda side: places.select(F.col("place").alias(side), F.col("lon").alias(f"{side}_lon"), F.col("lat").alias(f"{side}_lat"))
    pairs = written(spatial.place_pairs(at("a"), at("b"), 100.0).where("a < b AND km > 0").select("a", "b"), "near")
    points = written(z.join(places, ["lon", "lat"], "left").select("occ_id", "place", "z"), "points")
    each = written(resampling.permuted_moran(points, pairs), "draws").withColumn("morans", F.abs(F.round("morans", 9)))
    seen = each.where("draw = 0").agg(F.max("morans").alias("seen"))
    return each.where("draw > 0").crossJoin(F.broadcast(seen)).agg(F.round((F.count_if(F.col("morans") >= F.col("seen")) + 1) / (F.count("*") + F.lit(1.0)), 9).alias("p"), F.count("*").alias("draws"))


@registered()
def spatial_thin(spark, d):
    """Presences thinned to 20 km in three seeded orders."""
    return resampling.spatial_thin(view(spark, d, "occ").select("occ_id", "lon", "lat"), 20.0, [1, 2, 3])


@registered()
def thinning_seed(spark, d):
    """Of five thinning orders the one that leaves the median number of presences, the smallest seed on ties."""
    left = resampling.spatial_thin(view(spark, d, "occ").select("occ_id", "lon", "lat"), 20.0, [1, 2, 3, 4, 5]).groupBy("seed").agg(F.count("*").alias("n"))
    middle = left.agg(F.percentile("n", F.lit(0.5)).alias("median"))
    return left.crossJoin(F.broadcast(middle)).agg(F.min_by("seed", F.struct(F.abs(F.col("n") - F.col("median")), F.col("seed"))).alias("seed"), F.first("median").alias("median"))
