"""Operator 8: exact top-k by inner product, over an index of pivots and distances.

Vectors become whole numbers, floor(scale * x). Each is keyed by its nearest pivot and, around the pivot, by one of
``RINGS`` annuli of distance. For a query q and an annulus with distances [a, b] from pivot p and norms up to m, the
triangle inequality gives |q - x| >= max(0, a - |q - p|, |q - p| - b), and with |q - x|^2 = |q|^2 + |x|^2 - 2<q, x> an
upper bound of every inner product in the annulus.

A query first scans the annuli of highest bound until they hold k candidates; the k-th score found is a floor. Then it
scans, outward by falling bound, just those other annuli whose bound reaches the floor. All others cannot hold a
result, so the search is exact. Where all vectors have nearly one norm and no direction stands out, bounds reach nearly
every annulus; the scan is then one of matrix products, which is why both sides are packed.

Annuli in their order fill blocks of about ``BLOCK_ROWS`` vectors, a large annulus several; queries are dealt into parts
of at most about ``PART_QUERIES``. A block and a part are one record each, in the fewest bytes a number that hold all. A
block goes only to the parts that ask for an annulus in it, and each (block, part) is one group, so no group is
unbounded. Pivots are fitted on at most ``SAMPLE`` vectors; every vector is indexed. The directory of annuli has at most
``PIVOTS * RINGS`` rows, whatever the table's size.

Defined results: vectors that are null or hold a null or a non-finite component take no part, neither as queries nor as
candidates; shorter vectors count as filled up with zeros; rows with null vec_id take no part; candidates equal in score
rank by vec_id; repeated vec_ids are candidates of their own, but a query never meets a row of its own vec_id; a query id
that is repeated is searched once for each distinct vector (results rank together); without candidates a query gives
no rows; an empty table gives no rows. Other columns do not matter.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from skerry.llm.common import forget, table, written

PIVOTS, RINGS, SAMPLE = 24, 6, 4000
BLOCK_ROWS, PART_QUERIES = 1 << 15, 1 << 14
_TILE = (256, 8192)


def whole_vectors(rows: DataFrame, scale: int = 64) -> DataFrame:
    """vec_id and v, the vector as whole numbers; unusable rows are left out."""
    x = F.col("embedding")
    good = F.coalesce(F.forall(x, lambda e: e.isNotNull() & ~F.isnan(e) & (F.abs(e) < F.lit(float("inf")))), F.lit(False))
    v = F.transform(x, lambda e: F.floor(e.cast("double") * F.lit(float(scale))).cast("double"))
    return rows.where(good & F.col("vec_id").isNotNull()).select(F.col("vec_id").cast("long").alias("vec_id"), v.alias("v"))


def _matrix(lists: pa.Array, dims: int) -> np.ndarray:
    """Lists of numbers as rows, short ones filled up with zeros."""
    flat, size = lists.flatten().to_numpy(zero_copy_only=False), lists.value_lengths().to_numpy(zero_copy_only=False)
    if len(flat) == len(lists) * dims:
        return flat.reshape(-1, dims)
    out = np.zeros((len(lists), dims))
    out[np.arange(dims) < size[:, None]] = flat
    return out


def fit_pivots(sample: np.ndarray, count: int = PIVOTS, rounds: int = 8) -> np.ndarray:
    """Centres of the sample: spread-out starts, then means of the nearest rows."""
    if len(sample) <= count:
        return np.unique(sample, axis=0)
    at = [0]
    far = ((sample - sample[0]) ** 2).sum(axis=1)
    while len(at) < count and far.max() > 0:
        at.append(int(far.argmax()))
        far = np.minimum(far, ((sample - sample[at[-1]]) ** 2).sum(axis=1))
    centres = sample[at]
    for _ in range(rounds):
        near = (-2 * sample @ centres.T + (centres**2).sum(axis=1)).argmin(axis=1)
        centres = np.stack([sample[near == c].mean(axis=0) if (near == c).any() else centres[c] for c in range(len(centres))])
    return centres


def _distances(v: np.ndarray, pivots: np.ndarray) -> np.ndarray:
    return np.sqrt(np.maximum(((v[:, None, :] - pivots[None]) ** 2).sum(axis=2), 0)) if len(v) * len(pivots) <= 1 << 16 else np.concatenate([_distances(x, pivots) for x in np.array_split(v, 1 + len(v) * len(pivots) // (1 << 16))])


@dataclass(frozen=True)
class Directory:
    """The annuli: their pivots, counts, distances and norms, and the blocks that each fills (first and number)."""

    pivots: np.ndarray
    kind: str
    rings: np.ndarray
    owner: np.ndarray
    rows: np.ndarray
    low: np.ndarray
    high: np.ndarray
    norm2: np.ndarray
    first: np.ndarray
    blocks: np.ndarray


def _keys(pivots: np.ndarray, kind: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            v = _matrix(batch.column(1), pivots.shape[1])
            d = _distances(v, pivots)
            near = d.argmin(axis=1)
            packed = pa.array([x.tobytes() for x in v.astype(kind)], pa.binary())
            yield pa.RecordBatch.from_arrays([batch.column(0), packed, pa.array(near, pa.int32()), pa.array(d[np.arange(len(v)), near]), pa.array((v * v).sum(axis=1))], ["vec_id", "x", "pivot", "distance", "norm2"])

    return run


def _pack_block(rows: pa.Table) -> pa.Table:
    """A block's rows by vec_id, as one record."""
    rows = rows.sort_by("vec_id")
    ids, rings = rows.column("vec_id").to_numpy(), rows.column("ring").to_numpy()
    return pa.table({"block": rows.column("block").slice(0, 1), "ids": [ids.astype("<i8").tobytes()], "rings": [rings.astype("<i4").tobytes()], "x": [b"".join(rows.column("x").to_pylist())]})


def build_index(vectors: DataFrame, pivot_count: int = PIVOTS, rings: int = RINGS, block_rows: int = BLOCK_ROWS) -> tuple[DataFrame, Directory]:
    """(blocks: block, ids, rings, x; the directory of annuli)."""
    most = F.array_max(F.transform("v", lambda e: F.abs(e)))
    dims, top = vectors.agg(F.max(F.size("v")), F.max(most)).first()
    dims = dims or 0
    kind = next((k for k, limit in (("<i1", 127), ("<i2", 2**15 - 1), ("<i4", 2**31 - 1)) if (top or 0) <= limit), "<f8")
    sample = vectors.orderBy(F.xxhash64("vec_id"), "vec_id").limit(SAMPLE).toArrow()
    pivots = fit_pivots(_matrix(sample.column("v").combine_chunks(), dims), pivot_count) if sample.num_rows else np.zeros((1, dims))
    keyed = written(vectors.select("vec_id", "v").mapInArrow(_keys(pivots, kind), "vec_id long, x binary, pivot int, distance double, norm2 double"), "vectors")
    edges = [i / rings for i in range(1, rings)]
    cuts = keyed.groupBy("pivot").agg(F.percentile_approx("distance", edges, 1000).alias("cuts"))
    ringed = keyed.join(F.broadcast(cuts), "pivot").withColumn("ring", F.col("pivot") * rings + F.size(F.filter("cuts", lambda c: c < F.col("distance"))))
    found = ringed.groupBy("ring", "pivot").agg(F.count("*").alias("rows"), F.min("distance").alias("low"), F.max("distance").alias("high"), F.max("norm2").alias("norm2")).toPandas().sort_values("ring")
    # annuli in their order fill blocks; one of more rows than a block has blocks of its own
    first, blocks, at, held = [], [], 0, 0
    for n in found["rows"].tolist():
        if held and held + n > block_rows:
            at, held = at + 1, 0
        first.append(at)
        blocks.append(max(1, -(-n // block_rows)))
        at, held = (at + blocks[-1], 0) if n > block_rows else (at, held + n)
    directory = Directory(pivots, kind, found["ring"].to_numpy(), found["pivot"].to_numpy(), *(found[c].to_numpy(float) for c in ("rows", "low", "high", "norm2")), np.array(first, int), np.array(blocks, int))
    dealt = vectors.sparkSession.createDataFrame([(int(r), a, n) for r, a, n in zip(directory.rings, first, blocks, strict=True)], "ring int, first int, blocks int")
    placed = ringed.join(F.broadcast(dealt), "ring").select("vec_id", "x", "ring", (F.col("first") + F.pmod(F.xxhash64("vec_id", "x"), "blocks")).cast("int").alias("block"))
    out = written(placed.groupBy("block").applyInArrow(_pack_block, "block int, ids binary, rings binary, x binary"), "blocks")
    forget(keyed)
    return out, directory


def _pack_part(dims: int, kind: str):
    """A part's queries as one record."""

    def run(rows: pa.Table) -> pa.Table:
        v = _matrix(rows.column("v").combine_chunks(), dims)
        exact = v.astype(kind)
        x = exact if (exact == v).all() else v.astype("<f8")
        return pa.table({"part": rows.column("part").slice(0, 1), "queries": [rows.column("query_id").to_numpy().astype("<i8").tobytes()], "floors": [rows.column("floor").to_numpy().astype("<f8").tobytes()], "width": pa.array([x.itemsize], pa.int32()), "q": [x.tobytes()]})

    return run


def _numbers(data: bytes, kind: str, dims: int) -> np.ndarray:
    return np.frombuffer(data, kind).reshape(-1, dims) if dims else np.empty((0, 0))


def _plan(directory: Directory, k: int, first: bool):
    """Which annuli each query scans: those of highest bound that hold enough candidates, or the others that reach the floor.

    A row for each block that a part asks for: bits by query and annulus, in the directory's order.
    """
    d = directory
    last = d.first + d.blocks

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for r in batch.to_pylist():
                v = _numbers(r["q"], d.kind if r["width"] == np.dtype(d.kind).itemsize else "<f8", d.pivots.shape[1]).astype(float)
                far = _distances(v, d.pivots)[:, d.owner]
                gap = np.maximum(0, np.maximum(d.low - far, far - d.high))
                bound = ((v * v).sum(axis=1)[:, None] + d.norm2 - gap * gap) / 2
                bound += 1e-9 * np.abs(bound) + 1e-6  # rounding
                order = np.argsort(-bound, axis=1, kind="stable")
                held = np.cumsum(d.rows[order], axis=1) - d.rows[order]
                seen = np.zeros_like(bound, bool)
                np.put_along_axis(seen, order, held < k + 1, axis=1)  # one of them may be the query's own row
                take = seen if first else ~seen & (bound >= np.frombuffer(r["floors"], "<f8")[:, None])
                asked = take.any(axis=0)
                some = sorted({b for a, z in zip(d.first[asked].tolist(), last[asked].tolist(), strict=True) for b in range(a, z)})
                for b in some:
                    here = (d.first <= b) & (b < last)
                    bits = np.packbits(take & here).tobytes()
                    yield pa.RecordBatch.from_arrays([pa.array([r["part"]], pa.int32()), pa.array([b], pa.int32()), pa.array([bits], pa.binary())], ["part", "block", "asked"])

    return run


def best_of_block(ids: np.ndarray, rings: np.ndarray, x: np.ndarray, own: np.ndarray, floors: np.ndarray, q: np.ndarray, asked: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(query's index, row's index, score) of each query's k best rows in the annuli that it asks for, no score under its floor.

    ``ids`` ascend; ``rings`` and the second axis of ``asked`` count annuli alike.
    """
    most = float(np.abs(x).max(initial=0)) * float(np.abs(q).max(initial=0)) * max(1, x.shape[1])
    kind = np.float32 if most < 2**24 else np.float64 if most < 2**53 else np.int64
    x, q, low = x.astype(kind), q.astype(kind), np.finfo(kind).min if kind is not np.int64 else np.iinfo(kind).min
    out = []
    for a in range(0, len(q), _TILE[0]):
        mine, floor = asked[a : a + _TILE[0]], floors[a : a + _TILE[0]].astype(float)
        rows = np.flatnonzero(mine.any(axis=0)[rings])
        for b in range(0, len(rows), _TILE[1]):
            at = rows[b : b + _TILE[1]]
            s = q[a : a + _TILE[0]] @ x[at].T
            ok = mine[:, rings[at]] & (s >= floor[:, None]) & (ids[at] != own[a : a + _TILE[0], None])
            if ok.sum(axis=1).max(initial=0) > k:  # the k best of the tile, ties by id
                held = np.where(ok, s, low)
                kth = np.partition(held, s.shape[1] - k, axis=1)[:, s.shape[1] - k]
                over = (held > kth[:, None]).sum(axis=1)
                equal = ok & (held == kth[:, None])
                ok &= (held > kth[:, None]) | equal & (np.cumsum(equal, axis=1) <= (k - over)[:, None])
                full = kth > low
                floor[full] = np.maximum(floor[full], kth[full])  # later rows need as much
            i, j = np.nonzero(ok)
            out.append((i + a, at[j], s[i, j].astype(np.int64)))
    if not out:
        return np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0, np.int64)
    i, j, s = (np.concatenate(c) for c in zip(*out, strict=True))
    order = np.lexsort((j, -s, i))
    i, j, s = i[order], j[order], s[order]
    nth = np.arange(len(i)) - np.searchsorted(i, i)
    return i[nth < k], j[nth < k], s[nth < k]


def _scan(directory: Directory, k: int):
    dims, ring_at = directory.pivots.shape[1], {r: i for i, r in enumerate(directory.rings.tolist())}

    def run(block: pa.Table, part: pa.Table) -> pa.Table:
        found: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        for r in block.to_pylist():
            ids = np.frombuffer(r["ids"], "<i8")
            held, inverse = np.unique(np.frombuffer(r["rings"], "<i4"), return_inverse=True)
            x = _numbers(r["x"], directory.kind, dims)
            for p in part.to_pylist():
                own = np.frombuffer(p["queries"], "<i8")
                q = _numbers(p["q"], directory.kind if p["width"] == np.dtype(directory.kind).itemsize else "<f8", dims)
                n = len(directory.rings)
                asked = np.unpackbits(np.frombuffer(p["asked"], np.uint8), count=len(own) * n).reshape(-1, n).astype(bool)[:, [ring_at[h] for h in held.tolist()]]
                i, j, s = best_of_block(ids, inverse, x, own, np.frombuffer(p["floors"], "<f8"), q, asked, k)
                found.append((own[i], ids[j], s))
        cols = [np.concatenate(c) for c in zip(*found, strict=True)] if found else [np.empty(0, np.int64)] * 3
        return pa.table([pa.array(c, pa.int64()) for c in cols], names=["query_id", "vec_id", "score"])

    return run


def _answers(blocks: DataFrame, asked: DataFrame, directory: Directory, k: int, first: bool) -> DataFrame:
    """The k best of each block for the queries of ``asked`` (query_id, v, floor, part)."""
    packed = written(asked.groupBy("part").applyInArrow(_pack_part(directory.pivots.shape[1], directory.kind), "part int, queries binary, floors binary, width int, q binary"), "queries")
    plan = written(packed.mapInArrow(_plan(directory, k, first), "part int, block int, asked binary"), "plan")
    keys = plan.select(F.col("block").alias("block"), F.col("part").alias("part"))
    left = blocks.join(keys, "block").select(*blocks.columns, F.col("part").alias("part"))
    right = plan.join(packed, "part")
    return left.groupBy("block", "part").cogroup(right.groupBy("block", "part")).applyInArrow(_scan(directory, k), "query_id long, vec_id long, score long")


def _best(found: DataFrame, k: int) -> DataFrame:
    order: list[Column] = [F.desc("score"), F.asc("vec_id")]
    return found.withColumn("rank", F.row_number().over(Window.partitionBy("query_id").orderBy(*order))).where(F.col("rank") <= k)


def search(vectors: DataFrame, queries: DataFrame, k: int, block_rows: int = BLOCK_ROWS, part_queries: int = PART_QUERIES) -> DataFrame:
    """query_id, rank, vec_id, score of each query's ``k`` best candidates. Both frames: vec_id, v (of ``whole_vectors``)."""
    blocks, directory = build_index(vectors, block_rows=block_rows)
    shape = "query_id long, rank int, vec_id long, score long"
    if not len(directory.rings):
        return vectors.sparkSession.createDataFrame([], shape)
    asked = written(queries.select(F.col("vec_id").alias("query_id"), "v").distinct(), "asked")
    n_parts = max(1, -(-asked.count() // part_queries))  # a block is copied for each part that asks for it
    asked = asked.withColumn("part", F.pmod(F.xxhash64("query_id"), F.lit(n_parts)).cast("int"))
    near = written(_answers(blocks, asked.withColumn("floor", F.lit(float("-inf"))), directory, k, True), "near")
    floors = _best(near, k).groupBy("query_id").agg(F.when(F.count("*") >= k, F.min("score").cast("double")).alias("kth"))
    raised = asked.join(floors, "query_id", "left").withColumn("floor", F.coalesce("kth", F.lit(float("-inf")))).drop("kth")
    others = _answers(blocks, raised, directory, k, False)
    return _best(near.unionByName(others), k).select("query_id", F.col("rank").cast("int"), "vec_id", "score")


def op8_exact_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = written(whole_vectors(table(spark, sf_dir, "embeddings")), "whole")
    return search(vectors, vectors.where(F.col("vec_id") % 20 == 0), 20)


OP8_SQL = """
WITH w AS (
  SELECT vec_id, [CAST(floor(64 * CAST(x AS DOUBLE)) AS BIGINT) for x in embedding] AS v FROM embeddings
  WHERE embedding IS NOT NULL AND vec_id IS NOT NULL AND len([x for x in embedding if x IS NULL OR NOT isfinite(x)]) = 0),
s AS (
  SELECT q.vec_id AS query_id, c.vec_id, CAST(list_sum([a[1] * a[2] for a in list_zip(q.v, c.v)]) AS BIGINT) AS score
  FROM w q JOIN w c ON q.vec_id <> c.vec_id WHERE q.vec_id % 20 = 0),
r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM s)
SELECT query_id, CAST(rank AS INT) AS rank, vec_id, score FROM r WHERE rank <= 20"""
