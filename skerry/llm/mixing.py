"""Operator 2: mixing sources to target weights, by budgets that flow down a domain-language-source tree.

A leaf (domain, lang, source) can give ``max_epochs`` times its tokens; a node can give what its leaves can. The token
budget is shared among the domains by weight, each domain's share among its languages, each language's among its
sources. A child that cannot use its share takes all it has, and what is short goes to its siblings by weight, as
often as needed; only what a whole family cannot use goes to the family's own siblings, one level up. A leaf's budget
is then spent on whole epochs, each a seeded order of its documents, and on a prefix of one more: documents in that
order, the last one only for the tokens that are left.

Only DataFrame functions are used. A document's place in an epoch is the md5 of seed, epoch and doc_id. Token sums by the
first two digits of it (256 buckets a leaf) find the bucket where the prefix ends, sums by the next two the bucket in
that one; only what is in it is ordered, so no leaf, however large, is sorted in one task, and the documents themselves
are not shuffled. The table of leaves is broadcast where it has at most ``BROADCAST_LEAVES`` rows, and joined by
shuffle beyond.

A document counts its words (runs of other characters than space, tab and line ends) and one end token.

Defined results: null or empty texts count one token; null domain, lang or source count as empty names, null doc_id as
an empty id; a leaf without weight rows of its own has the weights that its rows carry; weights of 0 or less, or null,
give nothing while siblings can fill the budget, and nothing otherwise either; rows of equal place come by doc_id, tokens,
then text, and repeated rows each count; an empty table gives no rows. Added columns are ``mix_epoch`` (from 0),
``mix_tokens`` and ``mix_taken``; they replace input columns of these names, all others keep their names and values.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from skerry.llm.common import table, written

BROADCAST_LEAVES = 50_000
LEVELS = 2
_LEAF = ["_domain", "_lang", "_source"]


def word_tokens(text: str = "text") -> Column:
    return F.regexp_count(F.coalesce(F.col(text), F.lit("")), F.lit("[^ \\t\\n\\r]+")).cast("long") + 1


def _share(nodes: DataFrame, parent: list[str], name: str) -> DataFrame:
    """Adds ``budget`` to nodes with weight, cap (what they can give) and ``whole``, their parent's budget.

    In order of cap / weight, a node is full if its cap is at most its share of what the nodes before it leave; the
    others share the rest by weight.
    """
    exact = lambda c: F.col(c).cast("decimal(38,0)")
    family = Window.partitionBy(*parent)
    before = family.orderBy(F.col("cap") / F.col("weight"), name).rowsBetween(Window.unboundedPreceding, -1)
    ranked = nodes.withColumns({"_w": F.sum("weight").over(family), "_wb": F.coalesce(F.sum("weight").over(before), F.lit(0)), "_cb": F.coalesce(F.sum("cap").over(before), F.lit(0))})
    ranked = ranked.withColumn("_full", exact("cap") * (F.col("_w") - F.col("_wb")) <= (exact("whole") - F.col("_cb")) * F.col("weight"))
    full = lambda c: F.coalesce(F.sum(F.when(F.col("_full"), F.col(c))).over(family), F.lit(0))
    ranked = ranked.withColumns({"_fc": full("cap"), "_fw": full("weight")})
    rest = F.expr("CAST((CAST(whole - _fc AS DECIMAL(38,0)) * weight) div greatest(_w - _fw, 1) AS BIGINT)")
    return ranked.withColumn("budget", F.when(F.col("_full"), F.col("cap")).otherwise(rest)).drop("_w", "_wb", "_cb", "_full", "_fc", "_fw")


def leaf_budgets(leaves: DataFrame, budget: int | None, max_epochs: int) -> DataFrame:
    """Budgets of the leaves. ``leaves``: _domain, _lang, _source, w_domain, w_lang, w_source, supply. No budget: the supply."""
    leaves = leaves.where((F.col("w_domain") > 0) & (F.col("w_lang") > 0) & (F.col("w_source") > 0)).withColumn("cap", F.col("supply") * max_epochs)
    langs = leaves.groupBy("_domain", "_lang").agg(F.min("w_domain").alias("w_domain"), F.min("w_lang").alias("weight"), F.sum("cap").alias("cap"), F.sum("supply").alias("supply"))
    domains = langs.groupBy("_domain").agg(F.min("w_domain").alias("weight"), F.sum("cap").alias("cap"), F.sum("supply").alias("supply")).withColumn("_root", F.lit(0))
    whole = F.sum("supply").over(Window.partitionBy("_root")) if budget is None else F.lit(budget).cast("long")
    shared = _share(domains.withColumn("whole", whole), ["_root"], "_domain").select("_domain", F.col("budget").alias("whole"))
    shared = _share(langs.drop("supply").join(shared, "_domain"), ["_domain"], "_lang").select("_domain", "_lang", F.col("budget").alias("whole"))
    return _share(leaves.withColumn("weight", F.col("w_source")).join(shared, ["_domain", "_lang"]), ["_domain", "_lang"], "_source").select(*_LEAF, "supply", "budget")


def _mixed_rows(docs: DataFrame, domain: Column, weights: tuple[Column, Column, Column], tokens: Column, budget: int | None, max_epochs: int, seed: int) -> DataFrame:
    """``row`` (the columns of ``docs``), mix_epoch, mix_tokens and mix_taken of ``mix``."""
    spark = docs.sparkSession
    w = [x.cast("long").alias(n) for x, n in zip(weights, ("w_domain", "w_lang", "w_source"), strict=True)]
    leaf = [F.coalesce(x, F.lit("")).alias(n) for x, n in zip((domain, F.col("lang"), F.col("source")), _LEAF, strict=True)]
    named = docs.select(F.struct(*docs.columns).alias("row"), F.col("doc_id"), *leaf, tokens.alias("mix_tokens"))
    slim = written(docs.select("doc_id", *leaf, *w, tokens.alias("mix_tokens")), "slim")
    supply = slim.groupBy(*_LEAF).agg(F.sum("mix_tokens").alias("supply"), *[F.min(n).alias(n) for n in ("w_domain", "w_lang", "w_source")])
    leaves = written(leaf_budgets(written(supply, "supply"), budget, max_epochs), "leaves")
    few = F.broadcast if leaves.count() <= BROADCAST_LEAVES else lambda x: x
    place = F.md5(F.concat_ws(":", F.lit(str(seed)), F.col("_whole").cast("string"), F.coalesce(F.col("doc_id").cast("string"), F.lit(""))))
    # the prefix of the last epoch ends in the bucket _edge, before which the leaf has _before tokens
    plan = leaves.select(*_LEAF, F.expr("budget div supply").alias("_whole"), F.expr("budget % supply").alias("_rest"), F.lit("").alias("_edge"), F.lit(0).cast("long").alias("_before"))
    for level in range(LEVELS):
        rows = slim.join(few(plan), _LEAF).withColumn("_place", place).where(F.substring("_place", 1, 2 * level) == F.col("_edge"))
        sums = rows.groupBy(*_LEAF, F.substring("_place", 1, 2 * level + 2).alias("_bucket")).agg(F.sum("mix_tokens").alias("n"), *[F.first(c).alias(c) for c in ("_whole", "_rest", "_before")])
        upto = F.col("_before") + F.sum("n").over(Window.partitionBy(*_LEAF).orderBy("_bucket"))
        ends = sums.withColumn("_upto", upto).where(F.col("_upto") > F.col("_rest"))
        found = ends.groupBy(*_LEAF, "_whole", "_rest").agg(F.min(F.struct("_bucket", (F.col("_upto") - F.col("n")).alias("_before"))).alias("_end"))
        plan = written(found.select(*_LEAF, "_whole", "_rest", F.col("_end._bucket").alias("_edge"), "_end._before"), "plan")
    rows = named.join(few(plan), _LEAF).withColumn("_place", place)
    bucket = F.substring("_place", 1, 2 * LEVELS)
    epochs = F.expr("IF(_whole > 0, sequence(0, CAST(_whole - 1 AS INT)), CAST(array() AS ARRAY<INT>))")
    inside = F.when(bucket < F.col("_edge"), F.array(F.col("_whole").cast("int"))).otherwise(F.expr("CAST(array() AS ARRAY<INT>)"))
    out = ["row", "mix_epoch", "mix_tokens", "mix_taken"]
    whole = rows.withColumn("mix_epoch", F.explode(F.concat(epochs, inside))).withColumn("mix_taken", F.col("mix_tokens")).select(*out)
    last = [F.col("row.text")] if "text" in docs.columns else []
    order = Window.partitionBy(*_LEAF).orderBy("_place", "doc_id", "mix_tokens", *last).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    edge = rows.where(bucket == F.col("_edge")).withColumn("_left", F.col("_rest") - F.col("_before") - F.sum("mix_tokens").over(order) + F.col("mix_tokens"))
    edge = edge.where(F.col("_left") > 0).withColumn("mix_epoch", F.col("_whole").cast("int")).withColumn("mix_taken", F.least("mix_tokens", "_left")).select(*out)
    return whole.unionByName(edge)


def mix(docs: DataFrame, domain: Column, weights: tuple[Column, Column, Column], tokens: Column, budget: int | None = None, max_epochs: int = 4, seed: int = 42) -> DataFrame:
    """Rows of ``docs`` as the mixture takes them, one for each epoch.

    ``docs`` has doc_id, lang and source; ``domain``, ``weights`` (whole numbers for domain, language within it, source
    within that; the least of a node's rows counts) and ``tokens`` are expressions over it.
    """
    added = ["mix_epoch", "mix_tokens", "mix_taken"]
    kept = [F.col("row")[c].alias(c) for c in docs.columns if c.lower() not in added]
    return _mixed_rows(docs, domain, weights, tokens, budget, max_epochs, seed).select(*kept, *added)


#: The policy of the query and the pipeline, over documents' lang and source.
_NUMBER = "CAST(coalesce(nullif(regexp_extract(source, '([0-9]{1,6})$', 1), ''), '0') AS INT)"
DOMAIN = f"CASE {_NUMBER} % 4 WHEN 0 THEN 'web' WHEN 1 THEN 'books' WHEN 2 THEN 'news' ELSE 'code' END"
W_DOMAIN = f"CASE {_NUMBER} % 4 WHEN 0 THEN 4 WHEN 1 THEN 3 WHEN 2 THEN 2 ELSE 1 END"
W_LANG = "CASE lang WHEN 'en' THEN 5 WHEN 'de' THEN 2 WHEN 'fr' THEN 2 ELSE 1 END"
W_SOURCE = f"1 + {_NUMBER} % 3"


def _policy() -> tuple:
    """Domain and weights of the policy above."""
    return F.expr(DOMAIN), (F.expr(W_DOMAIN), F.expr(W_LANG), F.expr(W_SOURCE))


def policy_mix(docs: DataFrame, tokens: Column) -> DataFrame:
    """The mixture of the policy above: as many tokens as there are, at most four epochs of a source, seed 42."""
    return mix(docs, *_policy(), tokens)


def first_words(text: str, count: str) -> Column:
    """The text up to and with its ``count``-th word; columns by name."""
    pieces = F.split(F.col(text), "(?<=[ \\t\\n\\r])(?=[^ \\t\\n\\r])")  # a word and the white space after it
    lead = F.col(text).rlike("^[ \\t\\n\\r]").cast("int")
    return F.array_join(F.slice(pieces, F.lit(1), F.col(count).cast("int") + lead), "")


def mixed_documents(docs: DataFrame) -> DataFrame:
    """The mixture as documents, with the columns of ``docs``: a row an epoch, the last of a leaf's prefix cut to the words taken; n_chars follows the text."""
    mixed = _mixed_rows(docs, *_policy(), word_tokens(), None, 4, 42).select("row", F.col("row.text").alias("text"), "mix_tokens", "mix_taken")
    mixed = mixed.withColumn("text", F.when(F.col("mix_taken") < F.col("mix_tokens"), first_words("text", "mix_taken")).otherwise(F.col("text")))
    new = {"text": F.col("text")} | ({"n_chars": F.length("text").cast(docs.schema["n_chars"].dataType)} if "n_chars" in docs.columns else {})
    return mixed.select(*[new.get(c, F.col("row")[c]).alias(c) for c in docs.columns])


def op2_source_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "lang", "source", word_tokens().alias("words"))
    mixed = policy_mix(docs, F.col("words"))
    return mixed.select("doc_id", F.expr(DOMAIN).alias("domain"), "lang", "source", F.col("mix_epoch").alias("epoch"), F.col("mix_tokens").alias("n_tokens"), F.col("mix_taken").alias("taken"))


def _share_sql(name: str, nodes: str, parent: str, key: str) -> str:
    return f"""
{name}_a AS (SELECT *, sum(weight) OVER (PARTITION BY {parent}) AS w_, coalesce(sum(weight) OVER b, 0) AS wb_, coalesce(sum(cap) OVER b, 0) AS cb_ FROM {nodes}
  WINDOW b AS (PARTITION BY {parent} ORDER BY CAST(cap AS DOUBLE) / weight, {key} ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
{name}_b AS (SELECT *, CAST(cap AS HUGEINT) * (w_ - wb_) <= (CAST(whole AS HUGEINT) - cb_) * weight AS full_ FROM {name}_a),
{name}_c AS (SELECT *, coalesce(sum(cap) FILTER (WHERE full_) OVER (PARTITION BY {parent}), 0) AS fc_, coalesce(sum(weight) FILTER (WHERE full_) OVER (PARTITION BY {parent}), 0) AS fw_ FROM {name}_b),
{name} AS (SELECT * EXCLUDE (w_, wb_, cb_, full_, fc_, fw_), CASE WHEN full_ THEN cap ELSE CAST((CAST(whole - fc_ AS HUGEINT) * weight) // greatest(w_ - fw_, 1) AS BIGINT) END AS budget FROM {name}_c)"""


def mixing_sql(source: str, columns: str = "doc_id, lang, source") -> str:
    """CTEs that end in ``mixed``: ``columns`` of ``source`` (a table with doc_id, text, lang, source), epoch, n_tokens, taken."""
    return f"""
docs_ AS (SELECT *, coalesce({DOMAIN}, '') AS d_, coalesce(lang, '') AS l_, coalesce(source, '') AS s_, CAST(len(regexp_extract_all(coalesce(text, ''), '[^ \\t\\n\\r]+')) AS BIGINT) + 1 AS n_tokens FROM {source}),
leaf_ AS (SELECT d_, l_, s_, CAST(sum(n_tokens) AS BIGINT) AS supply, CAST(4 * sum(n_tokens) AS BIGINT) AS cap, min({W_DOMAIN}) AS wd_, min({W_LANG}) AS wl_, min({W_SOURCE}) AS weight FROM docs_ GROUP BY ALL),
lang_ AS (SELECT d_, l_, min(wd_) AS wd_, min(wl_) AS weight, CAST(sum(cap) AS BIGINT) AS cap, sum(supply) AS supply FROM leaf_ GROUP BY ALL),
domain_ AS (SELECT d_, min(wd_) AS weight, CAST(sum(cap) AS BIGINT) AS cap, CAST(sum(sum(supply)) OVER () AS BIGINT) AS whole, 0 AS root_ FROM lang_ GROUP BY d_),{_share_sql("domains_", "domain_", "root_", "d_")},
lang_in AS (SELECT lang_.*, domains_.budget AS whole FROM lang_ JOIN domains_ USING (d_)),{_share_sql("langs_", "lang_in", "d_", "l_")},
leaf_in AS (SELECT leaf_.*, langs_.budget AS whole FROM leaf_ JOIN langs_ USING (d_, l_)),{_share_sql("leaves_", "leaf_in", "d_, l_", "s_")},
placed_ AS (SELECT docs_.*, budget // supply AS full_, budget % supply AS rest_ FROM docs_ JOIN leaves_ USING (d_, l_, s_)),
ordered_ AS (SELECT *, sum(n_tokens) OVER (PARTITION BY d_, l_, s_ ORDER BY md5('42:' || CAST(full_ AS VARCHAR) || ':' || coalesce(CAST(doc_id AS VARCHAR), '')), doc_id, n_tokens, text ROWS UNBOUNDED PRECEDING) - n_tokens AS before_ FROM placed_),
mixed AS (
  SELECT {columns}, CAST(e AS INT) AS epoch, n_tokens, n_tokens AS taken FROM placed_, unnest(range(full_)) AS t(e)
  UNION ALL SELECT {columns}, CAST(full_ AS INT), n_tokens, CAST(least(n_tokens, rest_ - before_) AS BIGINT) FROM ordered_ WHERE before_ < rest_)"""


OP2_SQL = f"WITH {mixing_sql('documents')} SELECT doc_id, {DOMAIN} AS domain, lang, source, epoch, n_tokens, taken FROM mixed"
