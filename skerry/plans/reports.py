"""Relational report queries: aggregates, pivots, best rows, unions, text and JSON columns."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from skerry.functions.numeric import rounded
from skerry.plans.registry import r6, registered
from skerry.plans.views import view, with_views
from skerry.sources.tables import coerced, parquet, union_by_name

_RESP = "CAST(sum(response) AS DOUBLE) / count(*) / 100"


def _fm(spark, d):
    return view(spark, d, "fold_metrics")


def _mean_response():
    return F.sum("response").cast("double") / F.count("*") / F.lit(100.0)


@registered(with_views(f"""WITH long AS (SELECT algo, feat_set, 'response' AS metric, CAST(response AS DOUBLE) AS v FROM fold_metrics UNION ALL SELECT algo, feat_set, 'tss', CAST(tss AS DOUBLE) FROM fold_metrics)
SELECT algo, feat_set, metric, count(v) AS n, {r6('CAST(sum(CAST(v AS BIGINT)) AS DOUBLE) / count(v)')} AS mean, round(stddev_samp(v) + 1e-9, 3) AS sd FROM long GROUP BY ALL""", "fold_metrics"))
def metrics_mean_sd_long(spark, d):
    fm = _fm(spark, d).select("algo", "feat_set", F.col("response").cast("double").alias("response"), F.col("tss").cast("double").alias("tss"))
    long = fm.unpivot(["algo", "feat_set"], ["response", "tss"], "metric", "v")
    return long.groupBy("algo", "feat_set", "metric").agg(F.count("v").alias("n"), rounded(F.sum(F.col("v").cast("long")).cast("double") / F.count("v")).alias("mean"), F.round(F.stddev_samp("v") + F.lit(1e-9), 3).alias("sd"))


@registered(with_views(f"SELECT pa_method, count(*) AS n, {r6(_RESP)} AS mean, round(stddev_samp(CAST(response AS DOUBLE)) / 100 + 1e-9, 3) AS sd, CAST(max(response) AS BIGINT) AS top, count(*) FILTER (tss IS NULL) AS no_tss, count(DISTINCT tss) AS tss_values FROM fold_metrics GROUP BY ALL", "fold_metrics"))
def pa_method_summary(spark, d):
    sd = F.round(F.stddev_samp(F.col("response").cast("double")) / 100 + F.lit(1e-9), 3)
    return _fm(spark, d).groupBy("pa_method").agg(F.count("*").alias("n"), rounded(_mean_response()).alias("mean"), sd.alias("sd"), F.max("response").alias("top"), F.count_if(F.col("tss").isNull()).alias("no_tss"), F.count_distinct("tss").alias("tss_values"))


_BY = "algo, feat_set"
_CFG = f"cfg AS (SELECT algo, feat_set, pa_method, {_RESP} AS mean, max(tss) FILTER (pa_method <> 1) AS tss FROM fold_metrics GROUP BY ALL)"


def _configs(spark, d):
    """A row a configuration; one method has no tss."""
    return _fm(spark, d).groupBy("algo", "feat_set", "pa_method").agg(_mean_response().alias("mean"), F.max(F.when(F.col("pa_method") != 1, F.col("tss"))).alias("tss"))


@registered(with_views(f"WITH {_CFG} SELECT algo, feat_set, pa_method, {r6('mean')} AS mean, tss FROM cfg QUALIFY row_number() OVER (PARTITION BY {_BY} ORDER BY mean DESC, pa_method) = 1", "fold_metrics"))
def best_config_strict(spark, d):
    """The best row of each group, as it stands."""
    w = Window.partitionBy("algo", "feat_set").orderBy(F.desc("mean"), "pa_method")
    return _configs(spark, d).withColumn("_n", F.row_number().over(w)).where("_n = 1").select("algo", "feat_set", "pa_method", rounded(F.col("mean")).alias("mean"), "tss")


@registered(with_views(f"""WITH {_CFG}, o AS (SELECT *, row_number() OVER (PARTITION BY {_BY} ORDER BY mean DESC, pa_method) AS nth FROM cfg)
SELECT algo, feat_set, arg_min(pa_method, nth) AS pa_method, round(arg_min(mean, nth) + 1e-9, 6) AS mean, arg_min(tss, nth) FILTER (tss IS NOT NULL) AS tss FROM o GROUP BY ALL""", "fold_metrics"))
def best_config_first_valid(spark, d):
    """Each column's first value that is not null, in order of the metric; a row can mix configurations."""
    order = F.struct(-F.col("mean"), F.col("pa_method"))
    pick = lambda c: F.expr(f"min_by({c}, o) FILTER (WHERE {c} IS NOT NULL)")
    return _configs(spark, d).withColumn("o", order).groupBy("algo", "feat_set").agg(pick("pa_method").alias("pa_method"), rounded(pick("mean")).alias("mean"), pick("tss").alias("tss"))


@registered(with_views(f"WITH {_CFG} SELECT algo, feat_set, pa_method, {r6('mean')} AS mean FROM cfg ORDER BY mean DESC, algo, feat_set, pa_method LIMIT 1", "fold_metrics"))
def top_config(spark, d):
    return _configs(spark, d).orderBy(F.desc("mean"), "algo", "feat_set", "pa_method").limit(1).select("algo", "feat_set", "pa_method", rounded(F.col("mean")).alias("mean"))


_ZONAL = """SELECT n_name AS zone, count(*) AS cells, {m} AS mean, {p50} AS median, {p90} AS p90, {f} AS fraction
FROM customer JOIN nation ON c_nationkey = n_nationkey GROUP BY n_name ORDER BY mean DESC, zone LIMIT 15"""


@registered(_ZONAL.format(m=r6("CAST(sum(CAST(round(c_acctbal * 100) AS BIGINT)) AS DOUBLE) / count(*) / 100"), p50=r6("quantile_cont(c_acctbal, 0.5)"), p90=r6("quantile_cont(c_acctbal, 0.9)"), f=r6("CAST(count(*) FILTER (c_acctbal >= 5000) AS DOUBLE) / count(*)")))
def zonal_stats_top15(spark, d):
    cells = parquet(spark, d, "customer").join(parquet(spark, d, "nation"), F.col("c_nationkey") == F.col("n_nationkey"))
    mean = F.sum(F.round(F.col("c_acctbal") * 100).cast("long")).cast("double") / F.count("*") / F.lit(100.0)
    out = cells.groupBy(F.col("n_name").alias("zone")).agg(F.count("*").alias("cells"), rounded(mean).alias("mean"), rounded(F.percentile("c_acctbal", F.lit(0.5))).alias("median"), rounded(F.percentile("c_acctbal", F.lit(0.9))).alias("p90"), rounded(F.count_if(F.col("c_acctbal") >= 5000).cast("double") / F.count("*")).alias("fraction"))
    return out.orderBy(F.desc("mean"), "zone").limit(15)


@registered(f"""SELECT lang, count(*) AS n, min(n_chars) AS shortest, max(n_chars) AS longest, {r6('median(n_chars)')} AS median, count(DISTINCT source) AS sources FROM documents GROUP BY ALL""")
def provenance_summary(spark, d):
    """Counts and ranges by a key that may be null."""
    return parquet(spark, d, "documents").groupBy("lang").agg(F.count("*").alias("n"), F.min("n_chars").alias("shortest"), F.max("n_chars").alias("longest"), rounded(F.percentile("n_chars", F.lit(0.5))).alias("median"), F.count_distinct("source").alias("sources"))


_STEPS = [("positive", "o_totalprice > 0"), ("priced", "o_totalprice < 300000"), ("dated", "o_orderdate IS NOT NULL"), ("open", "o_orderstatus IN ('O', 'F')"), ("urgent", "o_orderpriority <> '5-LOW'")]
_FLAGS = ", ".join(f"min(CASE WHEN {c} THEN 1 ELSE 0 END) AS f{i}" for i, (_, c) in enumerate(_STEPS))


@registered("WITH c AS (SELECT " + ", ".join(f"count(*) FILTER ({' AND '.join(f'({c})' for _, c in _STEPS[:i]) or 'TRUE'}) AS n{i}" for i in range(len(_STEPS) + 1)) + " FROM orders) " + " UNION ALL ".join(f"SELECT {i + 1} AS step, '{n}' AS name, n{i} AS n_before, n{i + 1} AS n_after, n{i} - n{i + 1} AS removed FROM c" for i, (n, _) in enumerate(_STEPS)))
def qc_funnel(spark, d):
    """Staged filters, counted in one pass."""
    upto = [F.expr(" AND ".join(f"({c})" for _, c in _STEPS[:i]) or "TRUE") for i in range(len(_STEPS) + 1)]
    counts = parquet(spark, d, "orders").agg(*[F.count_if(c).alias(f"n{i}") for i, c in enumerate(upto)])
    rows = F.array(*[F.struct(F.lit(i + 1).alias("step"), F.lit(n).alias("name"), F.col(f"n{i}").alias("n_before"), F.col(f"n{i + 1}").alias("n_after"), (F.col(f"n{i}") - F.col(f"n{i + 1}")).alias("removed")) for i, (n, _) in enumerate(_STEPS)])
    return counts.select(F.inline(rows))


@registered("""WITH y AS (SELECT CASE WHEN o_orderkey % 9 = 0 THEN NULL ELSE year(o_orderdate) END AS y FROM orders)
SELECT count(*) FILTER (y <= 1996) AS strict, count(*) FILTER (y IS NULL OR y BETWEEN 1993 AND 1996) AS lenient FROM y""")
def year_filter_modes(spark, d):
    y = parquet(spark, d, "orders").select(F.when(F.col("o_orderkey") % 9 != 0, F.year("o_orderdate")).alias("y"))
    return y.agg(F.count_if(F.col("y") <= 1996).alias("strict"), F.count_if(F.col("y").isNull() | F.col("y").between(1993, 1996)).alias("lenient"))


@registered("SELECT o_orderpriority AS level, count(*) AS n FROM orders GROUP BY ALL")
def value_counts(spark, d):
    return parquet(spark, d, "orders").groupBy(F.col("o_orderpriority").alias("level")).agg(F.count("*").alias("n"))


@registered("SELECT CASE WHEN lower(lang) IN ('en', 'de') THEN 'main' ELSE 'other' END AS side, lower(source) AS source, count(*) AS n FROM documents WHERE lower(lang) IN ('en', 'de', 'fr', 'es') AND source IS NOT NULL GROUP BY ALL")
def case_insensitive_subset(spark, d):
    docs = parquet(spark, d, "documents").where(F.lower("lang").isin("en", "de", "fr", "es") & F.col("source").isNotNull())
    return docs.groupBy(F.when(F.lower("lang").isin("en", "de"), "main").otherwise("other").alias("side"), F.lower("source").alias("source")).agg(F.count("*").alias("n"))


@registered(with_views(f"""WITH m AS (SELECT algo, pa_method, {_RESP} AS mean, stddev_samp(CAST(response AS DOUBLE)) / 100 AS sd FROM fold_metrics GROUP BY ALL)
SELECT algo, max(CASE WHEN pa_method = 0 THEN t END) AS m0, max(CASE WHEN pa_method = 1 THEN t END) AS m1, max(CASE WHEN pa_method = 2 THEN t END) AS m2, max(CASE WHEN pa_method = 3 THEN t END) AS m3
FROM (SELECT algo, pa_method, printf('%d (%d)', CAST(floor(mean) AS BIGINT), CAST(floor(sd) AS BIGINT)) AS t FROM m) GROUP BY algo""", "fold_metrics"))
def formatted_pivot(spark, d):
    """A pivot of formatted text in a fixed order of columns."""
    m = _fm(spark, d).groupBy("algo", "pa_method").agg(_mean_response().alias("mean"), (F.stddev_samp(F.col("response").cast("double")) / 100).alias("sd"))
    text = m.withColumn("t", F.format_string("%d (%d)", F.floor("mean"), F.floor("sd")))
    return text.groupBy("algo").pivot("pa_method", [0, 1, 2, 3]).agg(F.first("t")).withColumnsRenamed({str(i): f"m{i}" for i in range(4)})


@registered(with_views(f"""WITH cube AS (SELECT pa_method, algo, feat_set, {_RESP} AS mean FROM fold_metrics GROUP BY ALL)
SELECT pa_method, algo, {', '.join(f'round(max(CASE WHEN feat_set = {i} THEN mean END) + 1e-9, 3) AS feat_{i}' for i in range(4))} FROM cube GROUP BY ALL""", "fold_metrics"))
def metric_cube(spark, d):
    wide = _fm(spark, d).groupBy("pa_method", "algo").pivot("feat_set", [0, 1, 2, 3]).agg(F.round(F.sum("response").cast("double") / F.count("response") / F.lit(100.0) + F.lit(1e-9), 3))
    return wide.withColumnsRenamed({str(i): f"feat_{i}" for i in range(4)})


@registered(with_views(f"SELECT * FROM (SELECT 'algo' AS factor, algo AS level, count(*) AS n, {r6(_RESP)} AS mean FROM fold_metrics GROUP BY ALL UNION ALL SELECT 'feat_set', feat_set, count(*), {r6(_RESP)} FROM fold_metrics GROUP BY ALL UNION ALL SELECT 'pa_method', pa_method, count(*), {r6(_RESP)} FROM fold_metrics GROUP BY ALL) t", "fold_metrics"))
def union_by_factor(spark, d):
    fm = _fm(spark, d)
    return union_by_name([fm.groupBy(F.lit(f).alias("factor"), F.col(f).alias("level")).agg(F.count("*").alias("n"), rounded(_mean_response()).alias("mean")) for f in ("algo", "feat_set", "pa_method")])


@registered("SELECT 'orders' AS part, count(*) AS n, CAST(NULL AS BIGINT) AS n_open FROM orders UNION ALL SELECT 'open', count(*), count(*) FILTER (o_orderstatus = 'O') FROM orders")
def union_missing_columns(spark, d):
    o = parquet(spark, d, "orders")
    return union_by_name([o.agg(F.count("*").alias("n")).withColumn("part", F.lit("orders")), o.agg(F.count("*").alias("n"), F.count_if(F.col("o_orderstatus") == "O").alias("n_open")).withColumn("part", F.lit("open"))])


@registered(with_views("WITH m AS (SELECT algo, feat_set, CAST(sum(response) AS BIGINT) // count(*) AS mean FROM fold_metrics GROUP BY ALL) SELECT algo, min(mean) AS low, max(mean) AS high, max(mean) - min(mean) AS span FROM m GROUP BY ALL", "fold_metrics"))
def tornado_range(spark, d):
    m = _fm(spark, d).groupBy("algo", "feat_set").agg(F.expr("sum(response) div count(*)").alias("mean"))
    return m.groupBy("algo").agg(F.min("mean").alias("low"), F.max("mean").alias("high"), (F.max("mean") - F.min("mean")).alias("span"))


_FIVE = [0.0, 0.25, 0.5, 0.75, 1.0]


@registered(with_views("SELECT pa_method, " + ", ".join(f"round(quantile_cont(CAST(response AS DOUBLE), {q}) + 1e-9, 3) AS q{int(q * 100)}" for q in _FIVE) + " FROM fold_metrics GROUP BY ALL", "fold_metrics"))
def boxplot_five_number(spark, d):
    q = F.percentile(F.col("response").cast("double"), F.array(*[F.lit(x) for x in _FIVE]))
    return _fm(spark, d).groupBy("pa_method").agg(q.alias("q")).select("pa_method", *[F.round(F.col("q")[i] + F.lit(1e-9), 3).alias(f"q{int(x * 100)}") for i, x in enumerate(_FIVE)])


@registered(f"""WITH p AS (SELECT l_partkey AS cell_id, l_linenumber AS model, l_quantity AS p FROM lineitem),
m AS (SELECT quantile_cont(l_quantity, 0.5) AS threshold FROM lineitem)
SELECT cell_id, count(*) AS n, {r6('CAST(sum(CAST(p AS BIGINT)) AS DOUBLE) / count(*)')} AS mean, {r6('stddev_samp(p)')} AS sd, {r6('stddev_pop(p)')} AS sd_pop,
CASE WHEN CAST(sum(CAST(p AS BIGINT)) AS DOUBLE) / count(*) >= any_value(threshold) THEN 1 ELSE 0 END AS above, {r6('CAST(count(*) FILTER (p >= threshold) AS DOUBLE) / count(*)')} AS support FROM p, m GROUP BY cell_id""")
def ensemble_mean_sd_binary(spark, d):
    """Mean, both deviations, the class at the median threshold and the share of supporting models of each cell."""
    rows = parquet(spark, d, "lineitem").select(F.col("l_partkey").alias("cell_id"), F.col("l_quantity").alias("p"))
    threshold = rows.agg(F.percentile("p", F.lit(0.5)).alias("threshold"))
    mean = F.sum(F.col("p").cast("long")).cast("double") / F.count("*")
    out = rows.crossJoin(F.broadcast(threshold)).groupBy("cell_id").agg(F.count("*").alias("n"), mean.alias("mean"), rounded(F.stddev_samp("p")).alias("sd"), rounded(F.stddev_pop("p")).alias("sd_pop"), F.max("threshold").alias("t"), rounded(F.count_if(F.col("p") >= F.col("threshold")).cast("double") / F.count("*")).alias("support"))
    return out.select("cell_id", "n", rounded(F.col("mean")).alias("mean"), "sd", "sd_pop", (F.col("mean") >= F.col("t")).cast("int").alias("above"), "support")


_GROUP = "CASE WHEN p_type LIKE 'A%' OR p_type LIKE 'E%' THEN 'A' WHEN p_type LIKE 'P%' THEN 'P' ELSE 'S' END"


@registered(f"SELECT {_GROUP} AS grp, count(*) AS n, CAST(sum(p_size) AS BIGINT) AS total, {r6('CAST(sum(p_size) AS DOUBLE) / count(*)')} AS mean FROM part GROUP BY ALL")
def factor_group_rollup(spark, d):
    """Factors grouped by the prefix of their names."""
    t = F.col("p_type")
    group = F.when(t.startswith("A") | t.startswith("E"), "A").when(t.startswith("P"), "P").otherwise("S")
    return parquet(spark, d, "part").groupBy(group.alias("grp")).agg(F.count("*").alias("n"), F.sum("p_size").alias("total"), rounded(F.sum("p_size").cast("double") / F.count("*")).alias("mean"))


@registered("""WITH j AS (SELECT event_id, event_type, printf('{"n_estimators": %d, "max_depth": %s, "max_features": "%s"}', 100 + event_id % 5, CASE WHEN event_id % 4 = 0 THEN 'null' ELSE CAST(event_id % 7 AS VARCHAR) END, event_type) AS hp FROM events)
SELECT CAST(hp::JSON->>'n_estimators' AS INT) AS n_estimators, CAST(hp::JSON->>'max_depth' AS INT) AS max_depth, hp::JSON->>'max_features' AS max_features, count(*) AS n FROM j GROUP BY ALL""")
def json_hp_parse(spark, d):
    """Settings kept as JSON text, with a null, read back as a struct."""
    e = parquet(spark, d, "events")
    hp = F.format_string('{"n_estimators": %d, "max_depth": %s, "max_features": "%s"}', 100 + F.col("event_id") % 5, F.when(F.col("event_id") % 4 == 0, F.lit("null")).otherwise((F.col("event_id") % 7).cast("string")), "event_type")
    parsed = e.select(F.from_json(hp, "n_estimators int, max_depth int, max_features string").alias("hp")).select("hp.*")
    return parsed.groupBy("n_estimators", "max_depth", "max_features").agg(F.count("*").alias("n"))


@registered(with_views("""WITH o AS (SELECT DISTINCT rep, feat_set, occ_id, (occ_id * 2654435761) % 4294967296 AS h FROM oof WHERE label = 1),
p AS (SELECT rep, feat_set, count(*) AS n, sum(h) AS s, bit_xor(h) AS x FROM o GROUP BY ALL)
SELECT feat_set, count(*) AS n, count(DISTINCT (n, s, x)) AS n_distinct FROM p GROUP BY ALL""", "oof"))
def partition_fingerprint(spark, d):
    """How many of the repetitions of a partition differ: by number, sum and exclusive or of hashes of their members."""
    h = F.pmod(F.col("occ_id") * F.lit(2654435761), F.lit(4294967296))
    members = view(spark, d, "oof").where("label = 1").select("rep", "feat_set", "occ_id", h.alias("h")).distinct()
    p = members.groupBy("rep", "feat_set").agg(F.count("*").alias("c"), F.sum("h").alias("s"), F.bit_xor("h").alias("x"))
    return p.groupBy("feat_set").agg(F.count("*").alias("n"), F.count_distinct("c", "s", "x").alias("n_distinct"))


@registered("""WITH want AS (SELECT c_custkey AS k, c_nationkey AS v FROM customer), have AS (SELECT c_custkey AS k, c_nationkey + CASE WHEN c_custkey % 50 = 0 THEN 1 ELSE 0 END AS v FROM customer WHERE c_custkey % 10 <> 3)
SELECT k, 'missing' AS state FROM want ANTI JOIN have USING (k) UNION ALL SELECT want.k, 'mismatch' FROM want JOIN have USING (k) WHERE want.v <> have.v""")
def manifest_anti_join(spark, d):
    """A manifest against what is there: missing, or other than expected."""
    want = parquet(spark, d, "customer").select(F.col("c_custkey").alias("k"), F.col("c_nationkey").alias("v"))
    have = want.where("k % 10 <> 3").select("k", (F.col("v") + F.when(F.col("k") % 50 == 0, 1).otherwise(0)).alias("found"))
    return want.join(have, "k", "left").where("found IS NULL OR found <> v").select("k", F.when(F.col("found").isNull(), "missing").otherwise("mismatch").alias("state"))


@registered("""SELECT claim, actual, expected, abs(actual - expected) <= tol AS ok FROM (
SELECT 'orders' AS claim, CAST(count(*) AS DOUBLE) AS actual, 1500e0 AS expected, 0.5e0 AS tol FROM orders UNION ALL
SELECT 'regions', CAST(count(*) AS DOUBLE), 5e0, 0.5e0 FROM region UNION ALL SELECT 'largest quantity', CAST(max(l_quantity) AS DOUBLE), 50e0, 5e-4 FROM lineitem) t""")
def claim_assertions(spark, d):
    """Numeric claims against what the tables say, within tolerances."""
    claims = [("orders", "orders", F.count("*"), 1500.0, 0.5), ("regions", "region", F.count("*"), 5.0, 0.5), ("largest quantity", "lineitem", F.max("l_quantity"), 50.0, 5e-4)]
    rows = [parquet(spark, d, t).agg(x.cast("double").alias("actual")).select(F.lit(n).alias("claim"), "actual", F.lit(e).alias("expected"), (F.abs(F.col("actual") - e) <= tol).alias("ok")) for n, t, x, e, tol in claims]
    return union_by_name(rows)


@registered("SELECT CAST(count(TRY_CAST(props AS DOUBLE)) AS BIGINT) AS numbers, count(TRY_CAST(event_type AS BIGINT)) AS whole, count(*) FILTER (contains(props, '{')) AS objects, count(*) AS n FROM events")
def coerce_and_scan(spark, d):
    """Coercing casts that give null, and a scan for a mark in text."""
    e = parquet(spark, d, "events")
    return e.agg(F.count(coerced("props")).alias("numbers"), F.count(coerced("event_type", "bigint")).alias("whole"), F.count_if(F.col("props").contains("{")).alias("objects"), F.count("*").alias("n"))


@registered(f"""SELECT l_linenumber AS feature, count(*) AS n, {r6('quantile_cont(l_extendedprice, 0.25)')} AS q25, {r6('quantile_cont(l_extendedprice, 0.5)')} AS q50, {r6('quantile_cont(l_extendedprice, 0.75)')} AS q75,
{r6('CAST(count(*) FILTER (l_extendedprice > t) AS DOUBLE) / count(*)')} AS above FROM lineitem, (SELECT quantile_cont(l_extendedprice, 0.75) AS t FROM lineitem WHERE l_returnflag = 'N') b GROUP BY ALL""")
def quantile_triplet_diag(spark, d):
    """Quartiles by group, and the share above the background's upper quartile."""
    rows = parquet(spark, d, "lineitem")
    t = rows.where("l_returnflag = 'N'").agg(F.percentile("l_extendedprice", F.lit(0.75)).alias("t"))
    q = lambda p: rounded(F.percentile("l_extendedprice", F.lit(p)))
    return rows.crossJoin(F.broadcast(t)).groupBy(F.col("l_linenumber").alias("feature")).agg(F.count("*").alias("n"), q(0.25).alias("q25"), q(0.5).alias("q50"), q(0.75).alias("q75"), rounded(F.count_if(F.col("l_extendedprice") > F.col("t")).cast("double") / F.count("*")).alias("above"))
