"""Small relational queries: keys, masks, labels, guards, deduplication, point look-ups and table data."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, Window
from pyspark.sql import functions as F

from skerry.functions.numeric import rounded
from skerry.functions.special import student_two_sided
from skerry.operators import ranking
from skerry.plans.registry import r6, registered
from skerry.plans.views import view, with_views
from skerry.sources.tables import masked_band, parquet, union_by_name


@registered(with_views("SELECT occ_id, row_number() OVER (ORDER BY occ_id) - 1 AS key, lon, lat FROM occ WHERE value > 0 AND lon IS NOT NULL AND lat IS NOT NULL", "occ"))
def surrogate_key(spark, d):
    """Rows numbered from 0 in the order of a stable key, after the filter; no single task numbers them."""
    rows = view(spark, d, "occ").dropna(subset=["lon", "lat"]).where("value > 0")
    return ranking.average_ranks(rows, [], "occ_id", "r").select("occ_id", (F.col("r").cast("long") - 1).alias("key"), "lon", "lat")


_BAND = "band AS (SELECT c_custkey AS cell_id, CASE WHEN c_custkey % 11 = 0 THEN -9999e0 WHEN c_custkey % 13 = 0 THEN -9999.5e0 WHEN c_custkey % 17 = 0 THEN -3e38 ELSE c_acctbal END AS v FROM customer)"


@registered(f"""WITH {_BAND} SELECT cell_id, CASE WHEN v < -1e30 OR abs(v + 9999) < 0.9999e0 THEN NULL ELSE v END AS relative,
CASE WHEN v = -9999 OR v < -1e30 THEN NULL ELSE v END AS exact, CASE WHEN abs(v + 9999) < 1e-3 OR v < 0 THEN NULL ELSE v END AS suitability FROM band""")
def raster_masks(spark, d):
    """One band under the three rules for missing cells: near nodata, exactly nodata, and near nodata or negative."""
    c = F.col("c_custkey")
    v = F.when(c % 11 == 0, -9999.0).when(c % 13 == 0, -9999.5).when(c % 17 == 0, -3e38).otherwise(F.col("c_acctbal"))
    band = parquet(spark, d, "customer").select(c.alias("cell_id"), *[v.alias(n) for n in ("relative", "exact", "suitability")])
    band = masked_band(masked_band(band, "relative", -9999.0), "exact", -9999.0, relative=False)
    return masked_band(band, "suitability", -9999.0, tolerance=1e-3, floor=0.0)


@registered(with_views(f"""WITH m AS (SELECT occ_id, avg(suit) AS suit FROM oof WHERE label = 1 GROUP BY ALL)
SELECT m.occ_id, {r6('suit')} AS suit_oof, {r6('1 - suit')} AS residual, lon, lat FROM m JOIN occ USING (occ_id)""", "oof", "occ"))
def presence_residuals(spark, d):
    """Mean prediction of each presence with its coordinates, and what it lacks to 1."""
    m = view(spark, d, "oof").where("label = 1").groupBy("occ_id").agg(F.avg("suit").alias("suit"))
    return m.join(view(spark, d, "occ").select("occ_id", "lon", "lat"), "occ_id").select("occ_id", rounded(F.col("suit")).alias("suit_oof"), rounded(1 - F.col("suit")).alias("residual"), "lon", "lat")


@registered(with_views("""WITH src AS (SELECT DISTINCT c_custkey AS occ_id, CASE WHEN c_custkey % 3 = 0 THEN 'Literature' ELSE 'Citizen science' END AS source FROM customer)
SELECT rep || '_' || fold AS cluster, coalesce(src.source, 'background') AS source, count(*) AS n, sum(label) AS n_pres FROM oof LEFT JOIN src USING (occ_id) GROUP BY ALL""", "oof").replace("sum(label)", "CAST(sum(label) AS BIGINT)"))
def oof_with_source(spark, d):
    """Predictions joined with their presences' source; background has none. Counted by composite partition key."""
    c = F.col("c_custkey")
    src = parquet(spark, d, "customer").select(c.alias("occ_id"), F.when(c % 3 == 0, "Literature").otherwise("Citizen science").alias("group")).distinct()
    rows = view(spark, d, "oof").join(src, "occ_id", "left")
    return rows.groupBy(F.concat_ws("_", "rep", "fold").alias("cluster"), F.coalesce("group", F.lit("background")).alias("source")).agg(F.count("*").alias("n"), F.sum("label").cast("long").alias("n_pres"))


@registered("SELECT p_partkey, p_name, p_size FROM part")
def columns_where_present(spark, d):
    """The columns asked for that the table has, in the order asked."""
    part = parquet(spark, d, "part")
    return part.select([c for c in ("p_partkey", "p_shade", "p_name", "p_age", "p_size") if c in part.columns])


_LABELS = {"AUTOMOBILE": "Cars", "BUILDING": "Buildings", "FURNITURE": "Furniture"}


@registered("SELECT coalesce(label, c_mktsegment) AS label, count(*) AS n FROM customer LEFT JOIN (VALUES " + ", ".join(f"('{k}', '{v}')" for k, v in _LABELS.items()) + ") t(k, label) ON k = c_mktsegment GROUP BY ALL")
def label_mapping(spark, d):
    """Names by a table of labels; without a label a name stays."""
    labels = spark.createDataFrame(list(_LABELS.items()), "k string, label string")
    rows = parquet(spark, d, "customer").join(F.broadcast(labels), F.col("c_mktsegment") == F.col("k"), "left")
    return rows.groupBy(F.coalesce("label", "c_mktsegment").alias("label")).agg(F.count("*").alias("n"))


@registered(with_views(f"""WITH c AS (SELECT algo, feat_set, pa_method, CAST(sum(response) AS DOUBLE) / count(*) AS mean FROM fold_metrics GROUP BY ALL), b AS (SELECT algo, feat_set, pa_method FROM c ORDER BY mean DESC, algo, feat_set, pa_method LIMIT 1)
SELECT rep, fold, count(*) AS n, {r6('CAST(sum(response) AS DOUBLE) / count(*) / 100')} AS mean FROM fold_metrics SEMI JOIN b USING (algo, feat_set, pa_method) GROUP BY ALL ORDER BY rep, fold""", "fold_metrics"))
def best_config_folds(spark, d):
    """The folds of the best configuration, by equality on its three keys, in order of repetition and fold."""
    fm, keys = view(spark, d, "fold_metrics"), ["algo", "feat_set", "pa_method"]
    mean = F.sum("response").cast("double") / F.count("*")
    best = fm.groupBy(*keys).agg(mean.alias("mean")).orderBy(F.desc("mean"), *keys).limit(1).select(*keys)
    return fm.join(F.broadcast(best), keys, "left_semi").groupBy("rep", "fold").agg(F.count("*").alias("n"), rounded(mean / F.lit(100.0)).alias("mean")).orderBy("rep", "fold")


@registered("SELECT count(*) AS n, count(*) FILTER (isfinite(x) AND isfinite(y)) AS finite FROM (SELECT CASE WHEN l_linenumber = 7 THEN CAST('NaN' AS DOUBLE) ELSE l_tax END AS x, CASE WHEN l_linenumber = 6 THEN CAST('Infinity' AS DOUBLE) ELSE l_discount END AS y FROM lineitem) t")
def finite_rows(spark, d):
    """Rows all of whose columns are finite numbers."""
    n = F.col("l_linenumber")
    rows = parquet(spark, d, "lineitem").select(F.when(n == 7, float("nan")).otherwise(F.col("l_tax")).alias("x"), F.when(n == 6, float("inf")).otherwise(F.col("l_discount")).alias("y"))
    good = reduce(Column.__and__, [F.col(c).isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf")) for c in rows.columns])
    return rows.agg(F.count("*").alias("n"), F.count_if(good).alias("finite"))


@registered("""SELECT event_type AS kind, count(*) AS n FROM (SELECT event_type, CASE WHEN event_id % 5 = 0 THEN NULL WHEN event_id % 7 = 0 THEN '' ELSE props END AS geometry FROM events) t
WHERE geometry IS NOT NULL AND geometry <> '' AND event_type IN ('click', 'view', 'purchase') GROUP BY ALL""")
def geometry_class_filter(spark, d):
    """Features with a geometry that is not empty, of the classes asked for."""
    e = parquet(spark, d, "events")
    geometry = F.when(F.col("event_id") % 5 == 0, None).when(F.col("event_id") % 7 == 0, "").otherwise(F.col("props"))
    kept = e.withColumn("geometry", geometry).where(F.col("geometry").isNotNull() & (F.col("geometry") != "") & F.col("event_type").isin("click", "view", "purchase"))
    return kept.groupBy(F.col("event_type").alias("kind")).agg(F.count("*").alias("n"))


@registered(with_views("""WITH n AS (SELECT rep, fold, count(DISTINCT occ_id) AS n FROM oof WHERE label = 1 GROUP BY ALL), a AS (SELECT rep, min(n) AS least, count(*) AS folds FROM n GROUP BY ALL)
SELECT rep, least, folds, CASE WHEN folds = 3 AND least >= 3 THEN 3 ELSE 2 END AS k_effective FROM a""", "oof"))
def fold_adequacy(spark, d):
    """Folds of each repetition: three, if each has three presences at least, else two."""
    n = view(spark, d, "oof").where("label = 1").groupBy("rep", "fold").agg(F.count_distinct("occ_id").alias("n"))
    return n.groupBy("rep").agg(F.min("n").alias("least"), F.count("*").alias("folds")).withColumn("k_effective", F.when((F.col("folds") == 3) & (F.col("least") >= 3), 3).otherwise(2))


@registered(with_views("SELECT count(DISTINCT rep * 3 + fold) AS folds, count(DISTINCT algo) AS algos, count(*) FILTER (response IS NULL) AS missing, count(DISTINCT rep * 3 + fold) = 15 AND count(*) FILTER (response IS NULL) = 0 AS ok FROM fold_metrics", "fold_metrics"))
def cardinality_guard(spark, d):
    """Fifteen partitions and no missing response."""
    part = F.count_distinct(F.col("rep") * 3 + F.col("fold"))
    n = view(spark, d, "fold_metrics").agg(part.alias("folds"), F.count_distinct("algo").alias("algos"), F.count_if(F.col("response").isNull()).alias("missing"))
    return n.withColumn("ok", (F.col("folds") == 15) & (F.col("missing") == 0))


#: Known centroids that records are wrongly given: longitude, latitude and degrees around them.
_TRAPS = [(100.0, 15.0, 0.05), (101.5, 12.5, 0.05)]
_TRAP_SQL = " OR ".join(f"(abs(lon - {x}) < {r} AND abs(lat - {y}) < {r})" for x, y, r in _TRAPS)
_QC = "rec AS (SELECT c_custkey AS id, c_nationkey AS species, 97e0 + (c_custkey * 7907 % 2003) / 200e0 AS lon, 5e0 + (c_custkey * 104723 % 1009) / 60e0 AS lat, CASE WHEN c_custkey % 4 = 0 THEN NULL ELSE (c_custkey % 80) * 100 END AS uncertainty, 1980 + c_custkey % 50 AS year FROM customer)"
_CELL = "CAST(floor((lon - 97e0) / 0.25e0) AS BIGINT), CAST(floor((lat - 5e0) / 0.25e0) AS BIGINT)"


@registered(f"""WITH {_QC}, s1 AS (SELECT * FROM rec WHERE species < 20), s2 AS (SELECT * FROM s1 WHERE lon BETWEEN -180 AND 180 AND lat BETWEEN -90 AND 90), s3 AS (SELECT * FROM s2 WHERE lon BETWEEN 97.5 AND 106 AND lat BETWEEN 5.5 AND 20.5),
s4 AS (SELECT * FROM s3 WHERE uncertainty IS NULL OR uncertainty <= 5000), s5 AS (SELECT * FROM s4 QUALIFY row_number() OVER (PARTITION BY species, lon, lat, year ORDER BY id) = 1),
s6 AS (SELECT * FROM s5 QUALIFY row_number() OVER (PARTITION BY species, CAST(round(lon * 10000) AS BIGINT), CAST(round(lat * 10000) AS BIGINT) ORDER BY id) = 1), s7 AS (SELECT * FROM s6 WHERE NOT ({_TRAP_SQL})), s8 AS (SELECT * FROM s7 WHERE year <= 2024),
s9 AS (SELECT * FROM s8 QUALIFY row_number() OVER (PARTITION BY {_CELL} ORDER BY id) = 1), n AS (SELECT 0 AS step, count(*) AS n FROM rec """ + " ".join(f"UNION ALL SELECT {i}, count(*) FROM s{i}" for i in range(1, 10)) + """)
SELECT step, lag(n) OVER (ORDER BY step) AS n_before, n AS n_after, lag(n) OVER (ORDER BY step) - n AS removed FROM n QUALIFY step > 0""")
def occurrence_qc(spark, d):
    """Nine cleaning steps with their counts: species, valid coordinates, box, uncertainty, exact and near duplicates, centroid traps, year, one record a cell."""
    c = F.col("c_custkey")
    rows = parquet(spark, d, "customer").select(
        c.alias("id"), F.col("c_nationkey").alias("species"), (F.lit(97.0) + (c * 7907 % 2003) / 200.0).alias("lon"), (F.lit(5.0) + (c * 104723 % 1009) / 60.0).alias("lat"),
        F.when(c % 4 != 0, (c % 80) * 100).alias("uncertainty"), (1980 + c % 50).alias("year"),
    )
    first = lambda df, *by: df.withColumn("_n", F.row_number().over(Window.partitionBy(*by).orderBy("id"))).where("_n = 1").drop("_n")
    near = lambda x: F.round(F.col(x) * 10000).cast("long")
    cell = lambda x, low: F.floor((F.col(x) - low) / 0.25)
    trap = reduce(Column.__or__, [(F.abs(F.col("lon") - x) < r) & (F.abs(F.col("lat") - y) < r) for x, y, r in _TRAPS])
    steps = [
        lambda t: t.where("species < 20"), lambda t: t.where("lon BETWEEN -180 AND 180 AND lat BETWEEN -90 AND 90"), lambda t: t.where("lon BETWEEN 97.5 AND 106 AND lat BETWEEN 5.5 AND 20.5"),
        lambda t: t.where("uncertainty IS NULL OR uncertainty <= 5000"), lambda t: first(t, "species", "lon", "lat", "year"), lambda t: first(t, "species", near("lon"), near("lat")),
        lambda t: t.where(~trap), lambda t: t.where("year <= 2024"), lambda t: first(t, cell("lon", 97.0), cell("lat", 5.0)),
    ]
    counts, now = [rows.agg(F.count("*").alias("n")).withColumn("step", F.lit(0))], rows
    for i, step in enumerate(steps, 1):
        now = step(now)
        counts.append(now.agg(F.count("*").alias("n")).withColumn("step", F.lit(i)))
    before = F.lag("n").over(Window.orderBy("step"))  # ten rows
    return union_by_name(counts).select("step", before.alias("n_before"), F.col("n").alias("n_after"), (before - F.col("n")).alias("removed")).where("step > 0")


@registered(with_views(f"""WITH m AS (SELECT algo, rep, fold, CAST(floor(CAST(sum(response) AS DOUBLE) / count(*)) AS BIGINT) AS v, count(*) FILTER (tss IS NULL) AS dropped FROM fold_metrics GROUP BY ALL)
SELECT algo, min(v) AS low, {r6('median(v)')} AS median, max(v) AS high, round(stddev_samp(v) + 1e-9, 3) AS sd, {r6('avg(dropped)')} AS dropped_mean, {r6('stddev_samp(dropped)')} AS dropped_sd, max(dropped) AS dropped_max FROM m GROUP BY ALL""", "fold_metrics"))
def fold_spread(spark, d):
    """Least, median, greatest and deviation of the fold means, and what the folds lost."""
    m = view(spark, d, "fold_metrics").groupBy("algo", "rep", "fold").agg(F.floor(F.sum("response").cast("double") / F.count("*")).alias("v"), F.count_if(F.col("tss").isNull()).alias("dropped"))
    return m.groupBy("algo").agg(F.min("v").alias("low"), rounded(F.percentile("v", F.lit(0.5))).alias("median"), F.max("v").alias("high"), F.round(F.stddev_samp("v") + F.lit(1e-9), 3).alias("sd"), rounded(F.avg("dropped")).alias("dropped_mean"), rounded(F.stddev_samp("dropped")).alias("dropped_sd"), F.max("dropped").alias("dropped_max"))


@registered(with_views("SELECT pa_method AS condition, count(*) AS n, round(avg(response), 4) AS mean, round(stddev_samp(CAST(response AS DOUBLE)), 2) AS sd, printf('%d +/- %d', CAST(floor(avg(response)) AS BIGINT), CAST(floor(stddev_samp(CAST(response AS DOUBLE))) AS BIGINT)) AS text FROM fold_metrics GROUP BY ALL", "fold_metrics"))
def condition_record(spark, d):
    """A record of mean and deviation for each condition, in figures and as text."""
    r = F.col("response").cast("double")
    m = view(spark, d, "fold_metrics").groupBy(F.col("pa_method").alias("condition")).agg(F.count("*").alias("n"), F.avg(r).alias("m"), F.stddev_samp(r).alias("s"))
    return m.select("condition", "n", F.round("m", 4).alias("mean"), F.round("s", 2).alias("sd"), F.format_string("%d +/- %d", F.floor("m"), F.floor("s")).alias("text"))


@registered(f"SELECT vec_id, CAST(i - 1 AS INT) AS position, {r6('CAST(embedding[i] AS DOUBLE)')} AS value FROM embeddings, range(1, 65) t(i) WHERE embedding IS NOT NULL AND i <= len(embedding)")
def matrix_to_long(spark, d):
    """Vectors as rows of position and value."""
    rows = parquet(spark, d, "embeddings").where("embedding IS NOT NULL").select("vec_id", F.posexplode("embedding").alias("position", "x"))
    return rows.select("vec_id", "position", rounded(F.col("x").cast("double")).alias("value"))


@registered(f"""WITH g AS (SELECT p_brand AS feature, CAST(sum(p_size) AS DOUBLE) / count(*) AS mean FROM part GROUP BY ALL), s AS (SELECT *, mean / max(mean) OVER () AS scaled FROM g ORDER BY mean DESC, feature LIMIT 6)
SELECT feature, {r6('mean')} AS mean, {r6('scaled')} AS scaled FROM s ORDER BY mean, feature DESC""")
def top_features(spark, d):
    """The six greatest by mean, scaled to the greatest and turned round for plotting."""
    g = parquet(spark, d, "part").groupBy(F.col("p_brand").alias("feature")).agg((F.sum("p_size").cast("double") / F.count("*")).alias("mean"))
    top = g.crossJoin(F.broadcast(g.agg(F.max("mean").alias("most")))).orderBy(F.desc("mean"), "feature").limit(6)
    return top.orderBy("mean", F.desc("feature")).select("feature", rounded(F.col("mean")).alias("mean"), rounded(F.col("mean") / F.col("most")).alias("scaled"))


@registered("SELECT l_linenumber AS feature, list_sort(list_distinct(list(e))) AS edges, len(list_distinct(list(e))) AS n FROM (SELECT l_linenumber, unnest(quantile_disc(l_discount, [0.0, 0.1, 0.2, 0.3, 0.4, 0.5, 0.6, 0.7, 0.8, 0.9, 1.0])) AS e FROM lineitem GROUP BY l_linenumber) t GROUP BY ALL".replace("edges, len", "edges, len").replace("quantile_disc", "quantile_cont"))
def unique_edges(spark, d):
    """Decile edges by group, each once."""
    q = F.percentile("l_discount", F.array(*[F.lit(i / 10) for i in range(11)]))
    e = parquet(spark, d, "lineitem").groupBy(F.col("l_linenumber").alias("feature")).agg(F.array_sort(F.array_distinct(q)).alias("edges"))
    return e.withColumn("n", F.size("edges").cast("long"))


@registered(with_views("SELECT 'presence' AS kind, count(DISTINCT occ_id) AS clusters FROM oof WHERE label = 1 UNION ALL SELECT 'background', count(DISTINCT rep || '_' || fold) FROM oof WHERE label = 0", "oof"))
def cluster_ids(spark, d):
    """Clusters that a bootstrap draws from: presences, and partitions of the background."""
    oof = view(spark, d, "oof")
    return union_by_name([oof.where("label = 1").agg(F.lit("presence").alias("kind"), F.count_distinct("occ_id").alias("clusters")), oof.where("label = 0").agg(F.lit("background").alias("kind"), F.count_distinct(F.concat_ws("_", "rep", "fold")).alias("clusters"))])


@registered(with_views("SELECT 1 AS label, count(*) AS n, round(avg(value), 6) AS mean FROM occ UNION ALL SELECT 0, count(*), round(avg(f1), 6) FROM cells", "occ", "cells"))
def stacked_labels(spark, d):
    """Two tables as one, with a label for where a row comes from."""
    rows = view(spark, d, "occ").select(F.col("value").alias("x"), F.lit(1).alias("label")).unionByName(view(spark, d, "cells").select(F.col("f1").alias("x"), F.lit(0).alias("label")))
    return rows.groupBy("label").agg(F.count("*").alias("n"), F.round(F.avg("x"), 6).alias("mean"))


@registered("SELECT c_mktsegment AS ratio_of, count(*) AS n_pres, least(count(*) * any_value(m), 400) AS n_background, m AS multiplier FROM customer, (VALUES (1), (3), (5), (10)) t(m) GROUP BY c_mktsegment, m")
def ratio_scaled_sizes(spark, d):
    """Background sizes as multiples of the training presences, as far as there is background."""
    n = parquet(spark, d, "customer").groupBy(F.col("c_mktsegment").alias("ratio_of")).agg(F.count("*").alias("n_pres"))
    return n.withColumn("multiplier", F.explode(F.array(*[F.lit(m) for m in (1, 3, 5, 10)]))).select("ratio_of", "n_pres", F.least(F.col("n_pres") * F.col("multiplier"), F.lit(400)).alias("n_background"), "multiplier")


@registered("""WITH g AS (SELECT t, depth, leaf FROM (VALUES (100), (200), (300)) a(t), (VALUES (3), (5), (10), (NULL)) b(depth), (VALUES (1), (2), (5)) c(leaf))
SELECT t AS trees, depth, leaf FROM g ORDER BY md5('42:' || t || ':' || coalesce(CAST(depth AS VARCHAR), 'none') || ':' || leaf) LIMIT 10""")
def sampled_settings(spark, d):
    """Ten settings of a grid, without replacement, in a seeded order."""
    grid = [(t, k, n) for t in (100, 200, 300) for k in (3, 5, 10, None) for n in (1, 2, 5)]
    rows = spark.createDataFrame(grid, "trees int, depth int, leaf int")
    return rows.orderBy(F.md5(F.concat_ws(":", F.lit("42"), "trees", F.coalesce(F.col("depth").cast("string"), F.lit("none")), "leaf"))).limit(10)


@registered("SELECT event_id, event_type FROM events ORDER BY (event_id * 2654435761 + 23 * 40503) % 4294967296, event_id LIMIT 300")
def uniform_subsample(spark, d):
    """Three hundred rows in a seeded order, without replacement."""
    from skerry.functions.numeric import hash_order

    return parquet(spark, d, "events").orderBy(hash_order(F.col("event_id"), 23), "event_id").limit(300).select("event_id", "event_type")


@registered(with_views("""WITH n AS (SELECT zone, count(*) AS n FROM occ GROUP BY ALL)
SELECT occ_id, CAST(CASE WHEN n < 6 THEN ((occ_id * 2654435761 + 5 * 40503) % 4294967296) % 3 ELSE row_number() OVER (PARTITION BY zone ORDER BY lon, occ_id) * 3 // (n + 1) END AS INT) AS fold FROM occ JOIN n USING (zone)""", "occ"))
def inner_folds(spark, d):
    """Inner folds within each block: balanced along an axis, or at random where a block has fewer than two presences a fold."""
    from skerry.functions.numeric import hash_order

    occ = view(spark, d, "occ")
    n = occ.groupBy("zone").agg(F.count("*").alias("n"))
    w = Window.partitionBy("zone").orderBy("lon", "occ_id")  # a training block
    along = F.expr("nth * 3 div (n + 1)")
    return occ.join(n, "zone").withColumn("nth", F.row_number().over(w)).select("occ_id", F.when(F.col("n") < 6, hash_order(F.col("occ_id"), 5) % 3).otherwise(along).cast("int").alias("fold"))


@registered("""SELECT lang, upper(substr(lang, 1, 1)) || lower(substr(lang, 2)) AS title, replace(source, 'source_', '') AS short, list_filter(string_split(source || ';;' || lang, ';'), lambda x: x <> '') AS parts, count(*) AS n FROM documents WHERE lang IS NOT NULL AND source IS NOT NULL GROUP BY ALL""")
def text_functions(spark, d):
    """Title case, prefixes taken off, and lists split with empty parts dropped."""
    rows = parquet(spark, d, "documents").where("lang IS NOT NULL AND source IS NOT NULL")
    parts = F.filter(F.split(F.concat("source", F.lit(";;"), "lang"), ";"), lambda x: x != "")
    return rows.groupBy("lang", F.initcap("lang").alias("title"), F.replace("source", F.lit("source_"), F.lit("")).alias("short"), parts.alias("parts")).agg(F.count("*").alias("n"))


@registered(f"""WITH x AS (SELECT count(*) AS n, corr(CAST(quality AS DOUBLE), ln(1e0 + n_chars)) AS r FROM documents JOIN labels USING (doc_id) WHERE quality IS NOT NULL AND n_chars IS NOT NULL)
SELECT n, {r6('r')} AS r, round(r * sqrt((n - 2) / (1 - r * r)), 4) AS t,
  round(1 - list_sum(list_transform(range(0, 4000), lambda k: exp(lgamma((n - 1) / 2e0 + k) - lgamma((n - 2) / 2e0) - lgamma(1.5e0 + k) + (0.5e0 + k) * ln(r * r) + (n - 2) / 2e0 * ln(1 - r * r)))), 9) AS p FROM x""")
def point_biserial_t(spark, d):
    """Correlation of a class with a logarithm, its t statistic with n - 2 degrees of freedom, and the two-sided p."""
    rows = parquet(spark, d, "documents").select("doc_id", "n_chars").join(parquet(spark, d, "labels"), "doc_id").where("quality IS NOT NULL AND n_chars IS NOT NULL")
    x = rows.agg(F.count("*").alias("n"), F.corr(F.col("quality").cast("double"), F.log(1 + F.col("n_chars").cast("double"))).alias("r"))
    t = F.col("r") * F.sqrt((F.col("n") - 2) / (1 - F.col("r") * F.col("r")))
    x = x.withColumn("t", t).withColumn("p", F.round(student_two_sided(F.col("t"), F.col("n") - 2), 9))
    return x.select("n", rounded(F.col("r")).alias("r"), F.round("t", 4).alias("t"), "p")


@registered(with_views("""WITH c AS (SELECT algo, feat_set, pa_method, CAST(floor(CAST(sum(response) AS DOUBLE) / count(*) / 100) AS BIGINT) AS mean, CAST(floor(CAST(min(response) AS DOUBLE) / 100) AS BIGINT) AS lo, CAST(floor(CAST(max(response) AS DOUBLE) / 100) AS BIGINT) AS hi FROM fold_metrics GROUP BY ALL)
SELECT algo, feat_set, pa_method, printf('%d (%d to %d)', mean, lo, hi) AS text FROM c QUALIFY row_number() OVER (PARTITION BY algo, feat_set ORDER BY mean DESC, pa_method) = 1""", "fold_metrics"))
def best_table(spark, d):
    """The best configuration of each pair of factors, with its interval as text."""
    whole = lambda x: F.floor(x / F.lit(100.0))
    c = view(spark, d, "fold_metrics").groupBy("algo", "feat_set", "pa_method").agg(whole(F.sum("response").cast("double") / F.count("*")).alias("mean"), whole(F.min("response").cast("double")).alias("lo"), whole(F.max("response").cast("double")).alias("hi"))
    w = Window.partitionBy("algo", "feat_set").orderBy(F.desc("mean"), "pa_method")
    return c.withColumn("nth", F.row_number().over(w)).where("nth = 1").select("algo", "feat_set", "pa_method", F.format_string("%d (%d to %d)", "mean", "lo", "hi").alias("text"))


@registered(with_views(f"""WITH a AS (SELECT 'algo' AS factor, CAST(algo AS VARCHAR) AS level, {r6('CAST(sum(response) AS DOUBLE) / count(*) / 100')} AS mean FROM fold_metrics GROUP BY ALL UNION ALL SELECT 'feat_set', CAST(feat_set AS VARCHAR), {r6('CAST(sum(response) AS DOUBLE) / count(*) / 100')} FROM fold_metrics GROUP BY ALL)
SELECT l.factor, l.level AS level_a, r.level AS level_b, round(l.mean - r.mean, 4) AS difference FROM a l JOIN a r USING (factor) WHERE l.level <> r.level""", "fold_metrics"))
def symmetric_lookup(spark, d):
    """Differences of level means, to be found under either order of the pair."""
    fm = view(spark, d, "fold_metrics")
    mean = rounded(F.sum("response").cast("double") / F.count("*") / F.lit(100.0)).alias("mean")
    a = union_by_name([fm.groupBy(F.lit(f).alias("factor"), F.col(f).cast("string").alias("level")).agg(mean) for f in ("algo", "feat_set")])
    left, right = a.select("factor", F.col("level").alias("level_a"), F.col("mean").alias("x")), a.select("factor", F.col("level").alias("level_b"), F.col("mean").alias("y"))
    return left.join(right, "factor").where("level_a <> level_b").select("factor", "level_a", "level_b", F.round(F.col("x") - F.col("y"), 4).alias("difference"))


@registered(f"SELECT p_brand AS model, {r6('quantile_cont(p_retailprice, 0.98)')} AS p98, {r6('quantile_cont(p_retailprice, 0.99)')} AS p99, count(*) FILTER (p_retailprice > 1000) AS above FROM part GROUP BY ALL")
def colour_caps(spark, d):
    """High percentiles that cap a colour scale."""
    q = lambda p: rounded(F.percentile("p_retailprice", F.lit(p)))
    return parquet(spark, d, "part").groupBy(F.col("p_brand").alias("model")).agg(q(0.98).alias("p98"), q(0.99).alias("p99"), F.count_if(F.col("p_retailprice") > 1000).alias("above"))
