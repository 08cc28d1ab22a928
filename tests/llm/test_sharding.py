"""Operator 12: its law, its slots, and how few links it cuts."""

import zlib

import numpy as np
import pytest
from hypothesis import given
from hypothesis import strategies as st
from pyspark.sql import functions as F

from skerry.llm import sharding


@given(st.integers(2, 5), st.data())
def test_moves_never_break_a_quota(n, data):
    load = np.array(data.draw(st.lists(st.integers(0, 50), min_size=n, max_size=n)))
    wanted = np.array(data.draw(st.lists(st.integers(0, 30), min_size=n * n, max_size=n * n))).reshape(n, n)
    np.fill_diagonal(wanted, 0)
    for a in range(n):  # what asks to leave is there
        while wanted[a].sum() > load[a]:
            wanted[a] //= 2
    quota = sharding.quotas(int(load.sum()), n)
    go = sharding.allowed(wanted, load, quota)
    after = load - go.sum(axis=1) + go.sum(axis=0)
    assert (go >= 0).all() and (go <= wanted).all() and (after <= np.maximum(load, quota)).all()
    if (load - wanted.sum(axis=1) + wanted.sum(axis=0) <= quota).all():
        assert (go == wanted).all()


def check_law(out, shards, n):
    sizes = out.groupby("shard").size().reindex(range(shards), fill_value=0)
    assert len(out) == n and sizes.max() - sizes.min() <= 1
    for _, part in out.groupby("shard"):
        assert sorted(part["slot"]) == list(range(len(part)))


def test_copies_stay_together(spark, tmp_path):
    """A text that a third of all rows hold takes no more shards than it fills, smaller groups one."""
    texts = ["hot"] * 700 + [f"copy {i % 60}" for i in range(300)] + [f"own {i}" for i in range(1000)] + [None, "", None]
    spark.createDataFrame([(i, t, 1, 2) for i, t in enumerate(texts)], "doc_id long, text string, shard int, row int").repartition(4).write.parquet(str(tmp_path / "documents.parquet"))
    out = sharding.op12_sharding(spark, str(tmp_path)).toPandas()
    assert list(out.columns) == ["doc_id", "size", "text_crc32", "law", "shard", "slot", "grown_shard"]
    check_law(out, 16, len(texts))
    assert sorted(out["doc_id"]) == list(range(len(texts))) and set(out["law"]) == {"rows"} and out["grown_shard"].isna().all()
    by_id = out.set_index("doc_id")
    assert all(by_id["size"][i] == len((t or "").encode()) + 1 and by_id["text_crc32"][i] == zlib.crc32((t or "").encode()) for i, t in enumerate(texts))
    spread = {}
    for i, t in enumerate(texts):
        spread.setdefault(t or "", set()).add(by_id["shard"][i])
    assert len(spread["hot"]) <= -(-700 // (len(texts) // 16)) + 1
    assert sum(len(v) > 1 for k, v in spread.items() if k != "hot") <= 3


@pytest.mark.parametrize("rows", [0, 1, 5, 33])
def test_few_rows_nulls_and_repeats(spark, rows):
    df = spark.createDataFrame([(i, ["a"] if i % 2 else [], None, "x") for i in range(rows)], "row long, links array<string>, doc_id long, nth string")
    out = sharding.shard_linked(df, 4)
    assert out.columns == ["doc_id", "nth", "shard", "slot"]
    check_law(out.toPandas(), 4, rows)


def test_rows_of_several_links(spark):
    """Chains of links: two rows share a link with the next two; propagation cuts fewer linked pairs than the even start."""
    rows = spark.range(400).select(F.col("id").alias("row"), F.array(F.concat(F.lit("l"), F.expr("id div 2")), F.concat(F.lit("l"), F.expr("id div 2 + 1"))).alias("links"))
    keyed = rows.withColumn("profile", F.md5(F.to_json("links")))
    kinds = keyed.groupBy("profile").agg(F.first("links").alias("links"), F.count("*").alias("rows"))
    members = kinds.select("profile", F.explode("links").alias("link"))
    begin = sharding.start(kinds.select("profile", "rows"), 4)
    after = sharding.propagate(begin, members, sharding.quotas(400, 4))
    assert sharding.cut(after, members) < 0.8 * sharding.cut(begin, members)
    load = [r[1] for r in after.groupBy("shard").agg(F.sum("n")).collect()]
    assert sum(load) == 400
    check_law(sharding.shard_linked(rows, 4).withColumn("doc_id", F.lit(0)).toPandas(), 4, 400)
