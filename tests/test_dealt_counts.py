"""Counts by dealt value come from the rows of label 1 alone where a stride gives each value once, and from all rows elsewhere."""

from pyspark.sql import functions as F

from skerry.operators import modelling


def test_counts_as_from_all_rows(spark, monkeypatch):
    monkeypatch.setattr(modelling, "strides", lambda draws, seed: [2147483659, 5, 7][:draws])
    rows = spark.createDataFrame([("p" if i < 35 else "q", f"r{i}", int(i % 4 == 0), float(i % 6)) for i in range(83)], "task string, id string, label int, a double").repartition(4)
    wide = modelling.dealt_values(rows, ["a"], 3, 9).select("task", "draw", "label", F.col("o_a").alias("score")).unionByName(rows.select("task", F.lit(0).alias("draw"), "label", F.col("a").alias("score")))
    want = wide.groupBy("task", "draw", "score").agg(F.sum("label").alias("pos"), F.sum(1 - F.col("label")).alias("neg"))
    got = {(r.task, r.draw, r.score): (r.pos, r.neg) for r in modelling.dealt_counts(rows, "a", 3, 9).collect()}
    assert got == {(r.task, r.draw, r.score): (r.pos, r.neg) for r in want.collect()}  # 35 rows of task p: strides 5 and 7 repeat


def test_numbers_are_the_order_of_hashes(spark):
    rows = spark.createDataFrame([("t", f"{i}") for i in range(3000)], "task string, id string").repartition(5)
    got = modelling.numbered(rows, 3).withColumn("u", F.substring(F.md5(F.concat_ws(":", F.lit("3"), "id")), 1, 12)).orderBy("u", "id").collect()
    assert [r.nth for r in got] == list(range(3000)) and {r._all for r in got} == {3000}


def test_no_side_of_the_dealing_is_broadcast(spark, monkeypatch):
    """Stored rows, whose files are small, were broadcast by way of the driver's memory."""
    plans = []
    plain = modelling.written
    monkeypatch.setattr(modelling, "written", lambda df, name: (plans.append((name, df._jdf.queryExecution().executedPlan().toString())), plain(df, name))[1])
    rows = spark.range(4000).select(F.lit("t").alias("task"), F.col("id").cast("string").alias("id"), (F.col("id") % 3 == 0).cast("int").alias("label"), (F.col("id") % 7).cast("double").alias("a"))
    assert modelling.dealt_counts(rows, "a", 2, 9).count() == 21
    plan = dict(plans)["dealt"]
    assert "SortMergeJoin" in plan and "BroadcastHashJoin" not in plan
    wide = modelling.dealt_values(plain(rows, "rows"), ["a"], 2, 9)._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin" in wide
