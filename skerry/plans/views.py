"""The evaluation tables as views over the driver's tables, in whole-number arithmetic that any engine repeats."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from skerry.sources.tables import parquet

#: Each view's SELECT, which Spark and other engines read alike.
VIEWS = {
    # out-of-fold predictions
    "oof": """SELECT event_id, CASE WHEN event_type = 'purchase' THEN user_id ELSE -1 END AS occ_id,
  CASE WHEN event_type = 'purchase' THEN 1 ELSE 0 END AS label,
  least(CAST(value AS DOUBLE) / CAST(500 AS DOUBLE), CAST(1 AS DOUBLE)) AS suit,
  CAST(user_id % 3 AS INT) AS algo, CAST(event_id % 4 AS INT) AS feat_set,
  CAST(((event_id - event_id % 4) / 4) % 4 AS INT) AS pa_method,
  CAST(event_id % 5 AS INT) AS rep, CAST(((event_id - event_id % 5) / 5) % 3 AS INT) AS fold,
  CAST(user_id % 3 AS INT) AS source FROM events WHERE value IS NOT NULL AND value >= 0""",
    # metrics of folds: a response for each order; factors and partitions do not depend on each other
    "fold_metrics": """SELECT o_orderkey, CAST(o_custkey % 3 AS INT) AS algo, CAST(((o_custkey - o_custkey % 3) / 3) % 4 AS INT) AS feat_set,
  CAST(((o_orderkey - o_orderkey % 15) / 15) % 4 AS INT) AS pa_method, CAST(o_orderkey % 5 AS INT) AS rep,
  CAST(((o_orderkey - o_orderkey % 5) / 5) % 3 AS INT) AS fold,
  CAST(round(o_totalprice * 100) AS BIGINT) AS response, CASE WHEN o_orderkey % 7 = 0 THEN NULL ELSE CAST(o_custkey % 100 AS BIGINT) END AS tss FROM orders""",
    # presences
    "occ": """SELECT s_suppkey AS occ_id, 97.3e0 + CAST(s_suppkey * 7919 % 10007 AS DOUBLE) / 10007e0 * 8.4e0 AS lon,
  5.5e0 + CAST(s_suppkey * 104729 % 10007 AS DOUBLE) / 10007e0 * 15.1e0 AS lat, s_acctbal AS value, s_nationkey AS zone FROM supplier""",
    # grid cells
    "cells": """SELECT c_custkey AS cell_id, 97.3e0 + CAST(c_custkey * 7907 % 10009 AS DOUBLE) / 10009e0 * 8.4e0 AS lon,
  5.5e0 + CAST(c_custkey * 104723 % 10009 AS DOUBLE) / 10009e0 * 15.1e0 AS lat, c_acctbal AS f1, CAST(c_nationkey AS DOUBLE) AS f2, c_nationkey AS zone FROM customer""",
}


def view(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    source = VIEWS[name].rsplit("FROM ", 1)[1].split()[0]
    return spark.sql(VIEWS[name].replace(f"FROM {source}", "FROM {source}"), source=parquet(spark, sf_dir, source))


def with_views(sql: str, *names: str) -> str:
    """SQL with the views before it."""
    head = ", ".join(f"{n} AS ({VIEWS[n]})" for n in names)
    body = sql.strip()
    return f"WITH {head}, {body[5:]}" if body.upper().startswith("WITH ") else f"WITH {head} {body}"
