"""Operator 12: documents dealt into shards of equal row counts, linked ones together, by balanced label propagation.

Links are keys that documents share (here: their whole text); documents with one set of links are interchangeable, so the
state of the propagation is a count for each profile (set of links) and shard, never a pair of documents. A document's
neighbours are all that share a link with it, itself left out: a link with n members in a shard gives n votes for it to
members elsewhere, and n - 1 to those in it.

1. Profiles are dealt over the shards evenly: the balanced start.
2. A round joins the state with the links. Each link names its homes: the shard with most members, and the next ones
   while its members exceed what the homes hold and have room for. Each profile's rows in shards that are no home of its
   links ask to go to one where they have more votes than at home, or to all homes of a large link, by their room. What asks to go from
   shard to shard, a small matrix, is cut down until no shard is above its quota after all moves. Where not all may
   go, whole classes go in a hashed order and one class in part. Rounds end when nothing moves, after ``ROUNDS`` at most.
3. Rows without links, and linked ones that a shard has beyond its quota, fill the shards up to their quotas exactly.

Rows are numbered within a profile, within the filling and within a shard by two levels: a hash deals rows into buckets,
counts of the buckets give each bucket's first number, and only rows of one bucket are ordered together. So a text that a
third of all rows hold is never one group. All is DataFrame joins and sums; the driver sees matrices of the shards.

Law: ``rows``; counts of two shards differ by one at most.

Defined results: a null text has no bytes (size 1, crc32 0) and is linked with empty ones; rows with a null or a repeated
doc_id are rows like others; repeated rows are copies; an empty table gives no rows; with more shards than rows some
shards are empty. Other columns do not enter, whatever their names. ``grown_shard`` is null under this law.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from skerry.llm.common import forget, table, text_or_empty, written

SHARDS, ROUNDS = 16, 8
#: Buckets of rows that are ordered together, more where a bucket of all rows would exceed ``BUCKET_ROWS``.
LEAST_BUCKETS, BUCKET_ROWS = 256, 1 << 20
#: Buckets of the order in which classes move.
_ORDER = 64


def quotas(rows: int, shards: int) -> np.ndarray:
    return rows // shards + (np.arange(shards) < rows % shards)


def _placed(rows: DataFrame, key: list[str], buckets: int) -> DataFrame:
    """``rows`` (row, any others) with ``nth``, gapless from 0 within the key."""
    dealt = rows.withColumn("_bucket", F.pmod(F.xxhash64("row"), F.lit(buckets)).cast("int"))
    counts = dealt.groupBy(*key, "_bucket").agg(F.count("*").alias("_n"))
    upto = Window.partitionBy(*key).orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    starts = counts.withColumn("_first", F.coalesce(F.sum("_n").over(upto), F.lit(0))).drop("_n")
    within = Window.partitionBy(*key, "_bucket").orderBy("row")
    return dealt.join(starts, [*key, "_bucket"]).withColumn("nth", F.col("_first") + F.row_number().over(within) - 1).drop("_bucket", "_first")


def allowed(wanted: np.ndarray, load: np.ndarray, quota: np.ndarray) -> np.ndarray:
    """The most of the moves ``wanted`` (from, to) that leaves no shard above its quota, or above what it has now.

    Arrivals are cut to the room that quota and departures leave; fewer departures elsewhere cut more, until nothing changes.
    """
    go, limit = wanted.astype(np.int64).copy(), np.maximum(quota, load)
    while True:
        arrive = go.sum(axis=0)
        over = arrive - np.maximum(limit - load + go.sum(axis=1), 0)
        if (over <= 0).all():
            return go
        for s in np.flatnonzero(over > 0):
            most = arrive[s] - over[s]
            keep, rest = np.divmod(go[:, s] * most, arrive[s])
            keep[np.argsort(-rest, kind="stable")[: most - keep.sum()]] += 1
            go[:, s] = keep


def _map(values, kind: str = "long") -> Column:
    return F.array(*[F.lit(int(v)).cast(kind) for v in values])


def start(profiles: DataFrame, shards: int) -> DataFrame:
    """profile, shard, n: each profile's rows dealt evenly from a hashed shard on. ``profiles``: profile, rows."""
    first = F.pmod(F.xxhash64("profile"), F.lit(shards)).cast("int")
    every = profiles.withColumn("shard", F.explode(F.sequence(F.lit(0), F.least(F.col("rows"), F.lit(shards)).cast("int") - 1)))
    n = F.expr(f"rows div {shards}") + (F.col("shard") < F.col("rows") % shards).cast("long")
    return every.select("profile", F.pmod(F.col("shard") + first, F.lit(shards)).alias("shard"), n.alias("n"))


def propagate(state: DataFrame, members: DataFrame, quota: np.ndarray, rounds: int = ROUNDS) -> DataFrame:
    """profile, shard, n after the moves. ``members``: profile, link."""
    shards = len(quota)
    load = np.zeros(shards, np.int64)
    for s, n in state.groupBy("shard").agg(F.sum("n")).collect():
        load[s] = n
    state = written(state, "state")
    for nth in range(rounds):
        tally = written(members.join(state, "profile").groupBy("link", "shard").agg(F.sum("n").alias("votes")), "tally")
        free = np.maximum(quota - load, quota // shards if nth % 2 == 0 else 0)
        room = F.element_at(_map(free), F.col("shard") + 1)
        whole = Window.partitionBy("link")  # a row a shard at most
        ranked = tally.withColumns({"all": F.sum("votes").over(whole), "room": F.col("votes") + room})
        best = whole.orderBy(F.desc(F.col("room") >= F.col("all")), F.desc("votes"), F.hash("link", "shard")).rowsBetween(Window.unboundedPreceding, -1)
        homes = ranked.where("room > 0").withColumn("before", F.coalesce(F.sum("room").over(best), F.lit(0))).where(F.col("before") < F.col("all"))
        homes = homes.withColumn("homes", F.count("*").over(whole)).select("link", F.col("shard").alias("to"), "votes", F.when(F.col("homes") == 1, F.col("votes")).otherwise(0).alias("weight"))
        asked = members.join(homes, "link").groupBy("profile", "to").agg(F.sum("votes").alias("votes"), F.sum("weight").alias("weight"))
        at_home = asked.select("profile", F.col("to").alias("shard"))
        away = state.join(at_home, ["profile", "shard"], "left_anti")
        turn = F.xxhash64("profile", "shard", "to", F.lit(nth))
        each = Window.partitionBy("profile", "shard")  # a row a shard at most
        order = each.orderBy(F.desc("weight"), turn)
        room = F.element_at(_map(free), F.col("to") + 1)
        best = away.join(asked, "profile").withColumns({"nth": F.row_number().over(order), "upto": F.sum(room).over(order.rowsBetween(Window.unboundedPreceding, 0)), "all": F.greatest(F.sum(room).over(each), F.lit(1)), "top": F.max("weight").over(each)})
        upto = lambda c: F.expr(f"CAST(floor(n * (({c}) / all)) AS BIGINT)")
        share = F.when(F.col("top") > 0, F.when(F.col("nth") == 1, F.col("n")).otherwise(0)).otherwise(upto("upto") - upto(f"upto - element_at(array({', '.join(f'{int(f)}L' for f in free)}), to + 1)"))
        best = best.withColumn("n", share).where("n > 0").select("profile", "shard", "n", "to", "votes")
        own = members.join(tally, "link").groupBy("profile", "shard").agg(F.sum(F.col("votes") - 1).alias("own"))
        moves = best.join(own, ["profile", "shard"]).where("votes > own")
        moves = written(moves.select("profile", "shard", "to", "n", F.pmod(F.xxhash64("profile", F.lit(nth)), F.lit(_ORDER)).cast("int").alias("_o")), "moves")
        sums = np.zeros((shards, shards, _ORDER), np.int64)
        for a, b, o, n in moves.groupBy("shard", "to", "_o").agg(F.sum("n")).collect():
            sums[a, b, o] = n
        go = allowed(sums.sum(axis=2), load, quota)
        if not go.any():
            forget(tally, moves)
            break
        upto = sums.cumsum(axis=2)
        edge = (upto <= go[:, :, None]).sum(axis=2)  # classes of this bucket go in part
        rest = go - np.where(edge > 0, np.take_along_axis(upto, np.maximum(edge - 1, 0)[:, :, None], axis=2)[:, :, 0], 0)
        pair = F.col("shard") * shards + F.col("to") + 1
        at, left = F.element_at(_map(edge.ravel(), "int"), pair), F.element_at(_map(rest.ravel()), pair)
        order = Window.partitionBy("shard", "to").orderBy("profile").rowsBetween(Window.unboundedPreceding, -1)
        on_edge = moves.where(F.col("_o") == at).withColumn("took", F.least("n", F.greatest(left - F.coalesce(F.sum("n").over(order), F.lit(0)), F.lit(0))))
        took = moves.where(F.col("_o") < at).withColumn("took", F.col("n")).unionByName(on_edge).where("took > 0")
        change = took.select("profile", F.explode(F.array(F.struct(F.col("shard"), (-F.col("took")).alias("n")), F.struct(F.col("to").alias("shard"), F.col("took").alias("n")))).alias("c")).select("profile", "c.shard", "c.n")
        then = written(state.unionByName(change).groupBy("profile", "shard").agg(F.sum("n").alias("n")).where("n > 0"), "state")
        load = load - go.sum(axis=1) + go.sum(axis=0)
        forget(tally, moves, state)
        state = then
    return state


def cut(state: DataFrame, members: DataFrame) -> int:
    """Linked pairs of rows in different shards, over all links, from counts."""
    tally = members.join(state, "profile").groupBy("link", "shard").agg(F.sum("n").alias("n"))
    pairs = tally.groupBy("link").agg(((F.sum("n") * F.sum("n") - F.sum(F.col("n") * F.col("n"))) / 2).alias("cut"))
    return int(pairs.agg(F.sum("cut")).first()[0] or 0)


def shard_linked(rows: DataFrame, shards: int = SHARDS, rounds: int = ROUNDS) -> DataFrame:
    """``rows`` (row, a number that none shares; links, an array of texts; any others) with ``shard`` and ``slot``."""
    rest = [c for c in rows.columns if c not in ("row", "links")]
    keyed = rows.withColumn("links", F.array_sort(F.array_distinct("links")))
    keyed = written(keyed.withColumn("profile", F.md5(F.to_json("links"))), "rows")
    kinds = written(keyed.groupBy("profile").agg(F.first("links").alias("links"), F.count("*").alias("rows")), "profiles")
    total = kinds.agg(F.sum("rows")).first()[0] or 0
    quota, buckets = quotas(total, shards), max(LEAST_BUCKETS, -(-total // BUCKET_ROWS))
    linked = kinds.select("profile", "rows", F.explode("links").alias("link"))
    shared = linked.groupBy("link").agg(F.sum("rows").alias("all")).where(F.col("all") > 1)
    members = written(linked.join(shared, "link").select("profile", "link"), "members")
    tied = kinds.join(members.select("profile").distinct(), "profile", "left_semi").select("profile", "rows")
    state = propagate(start(tied, shards), members, quota, rounds)
    load = np.zeros(shards, np.int64)
    for s, n in state.groupBy("shard").agg(F.sum("n")).collect():
        load[s] = n
    # a shard keeps the first of its rows by class up to its quota; the rest of them fill other shards
    if (load > quota).any():
        small = F.pmod(F.xxhash64("profile"), F.lit(_ORDER)).cast("int")
        sums = np.zeros((shards, _ORDER), np.int64)
        for s, o, n in state.groupBy("shard", small.alias("o")).agg(F.sum("n")).collect():
            sums[s, o] = n
        upto = sums.cumsum(axis=1)
        edge = (upto <= quota[:, None]).sum(axis=1)
        left = quota - np.where(edge > 0, np.take_along_axis(upto, np.maximum(edge - 1, 0)[:, None], axis=1)[:, 0], 0)
        at, room = F.element_at(_map(edge, "int"), F.col("shard") + 1), F.element_at(_map(left), F.col("shard") + 1)
        order = Window.partitionBy("shard", small == at).orderBy("profile").rowsBetween(Window.unboundedPreceding, -1)
        before = F.coalesce(F.sum("n").over(order), F.lit(0))
        kept = F.when(small < at, F.col("n")).when(small == at, F.least("n", F.greatest(room - before, F.lit(0)))).otherwise(0)
        state = written(state.withColumn("n", kept).where("n > 0"), "state")
        load = np.minimum(load, quota)
    upto = Window.partitionBy("profile").orderBy("shard").rowsBetween(Window.unboundedPreceding, 0)
    ends = state.withColumn("upto", F.sum("n").over(upto)).groupBy("profile").agg(F.sort_array(F.collect_list(F.struct("upto", "shard"))).alias("ends"))  # a row a shard at most
    some = keyed.select("row", "profile").join(ends, "profile")
    placed = _placed(some, ["profile"], buckets)
    own = F.filter("ends", lambda e: e["upto"] > F.col("nth"))
    placed = written(placed.select("row", F.get(own, F.lit(0))["shard"].alias("shard")), "placed")
    free = keyed.select("row", "profile").join(ends.select("profile"), "profile", "left_anti").select("row").unionByName(placed.where("shard IS NULL").select("row"))
    need = np.cumsum(quota - load)
    filled = _placed(free.withColumn("all", F.lit(0)), ["all"], buckets)
    filled = filled.select("row", F.size(F.filter(_map(need), lambda e: e <= F.col("nth"))).alias("shard"))
    where = placed.where("shard IS NOT NULL").select("row", F.col("shard").cast("int").alias("shard")).unionByName(filled)
    slots = _placed(where, ["shard"], buckets).withColumnRenamed("nth", "slot")
    out = keyed.select("row", F.struct(*rest).alias("_rest")).join(slots, "row")
    return out.select(*[F.col("_rest")[c].alias(c) for c in rest], "shard", F.col("slot").cast("long").alias("slot"))


def op12_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    text = text_or_empty()
    rows = docs.select(F.monotonically_increasing_id().alias("row"), F.col("doc_id").cast("long").alias("doc_id"), (F.octet_length(text) + F.lit(1)).cast("long").alias("size"), F.crc32(text.cast("binary")).alias("text_crc32"), F.array(F.sha2(text, 256)).alias("links"))
    out = shard_linked(rows, SHARDS)
    return out.select("doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))
