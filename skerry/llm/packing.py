"""Operator 3: best-fit packing of documents into sequences by the sum-of-squares rule.

An item of size s goes to that open sequence (or a new one) after which the sum over residual gaps g of N(g)^2 is
smallest, N(g) being the number of open sequences with gap g; full sequences close. Items are dealt into groups of
about ``GROUP_ITEMS`` rows that are packed apart, largest first. Sequences that a group leaves with more than
``SLACK`` of their length free are dissolved, and their items are packed again over coarser groups, until one group is
left or the dissolved items stop getting fewer. So the waste does not grow with the number of groups, and no task ever
holds more than a group.

Defined results: a null text counts as empty (only the end id); an empty table gives no rows; rows with equal doc_id or
text are packed each by itself; items of more than ``capacity`` tokens do not occur, since documents are cut before.
Other columns of the input are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from skerry.llm import tokens
from skerry.llm.common import table, text_or_empty, written

CAPACITY = 4096
GROUP_ITEMS = 5000
SLACK = 0.05


def sum_of_squares(sizes: np.ndarray, capacity: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Each item's sequence (from 0) and offset in it, and each sequence's fill. Sizes are from 1 to ``capacity``."""
    count = np.zeros(capacity + 1, np.int64)  # open sequences by gap; count[capacity] and count[0] stay 0
    closed = np.int64(1) << 60
    price = np.full(capacity + 1, closed)  # 2 * count where there is one to take, else forbidding
    open_by_gap: list[list[int]] = [[] for _ in range(capacity + 1)]
    bins, offsets, fills = np.empty(len(sizes), np.int64), np.empty(len(sizes), np.int64), []
    for i, s in enumerate(sizes.tolist()):
        # a sequence of gap g becomes one of gap g - s: 2 (N(g-s) - N(g)) + 2, and 1 - 2 N(g) where it closes
        delta = 2 * count[: capacity - s] + price[s:capacity]
        if len(delta):
            delta[0] -= 1
        best = int(delta.argmin()) if len(delta) else -1
        fresh = 2 * int(count[capacity - s]) + 1 if s < capacity else 0
        if best >= 0 and delta[best] <= fresh:
            gap = best + s
            b = open_by_gap[gap].pop()
            count[gap] -= 1
            price[gap] = 2 - 2 * count[gap] if count[gap] else closed
        else:
            gap, b = capacity, len(fills)
            fills.append(0)
        bins[i], offsets[i] = b, fills[b]
        fills[b] += s
        if gap > s:
            left = gap - s
            open_by_gap[left].append(b)
            count[left] += 1
            price[left] = 2 - 2 * count[left]
    return bins, offsets, np.array(fills, np.int64)


def _pack_groups(size: str, capacity: int):
    def finish(held: list[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        group = pa.Table.from_batches(held).combine_chunks()
        bins, offsets, fills = sum_of_squares(group.column(size).to_numpy(), capacity)
        group = group.append_column("_bin", pa.array(bins, pa.int64())).append_column("_offset", pa.array(offsets, pa.int64())).append_column("_fill", pa.array(fills[bins] if len(fills) else bins, pa.int64()))
        yield from group.to_batches()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        current = None
        for batch in batches:
            groups = batch.column("_group").to_numpy()
            cuts = [0, *(np.flatnonzero(np.diff(groups)) + 1).tolist(), len(groups)]
            for a, b in zip(cuts, cuts[1:], strict=False):
                if a == b:
                    continue
                if held and groups[a] != current:
                    yield from finish(held)
                    held = []
                current = groups[a]
                held.append(batch.slice(a, b - a))
        if held:
            yield from finish(held)

    return run


def pack(items: DataFrame, size: str, capacity: int = CAPACITY, group_items: int = GROUP_ITEMS, slack: float = SLACK) -> DataFrame:
    """``items`` with sequence_id and offset. ``size`` names a column of whole numbers from 1 to ``capacity``.

    ``items`` should be a stored table: it is counted, then packed, in passes of its own.
    """
    columns = items.columns
    full = items.where(F.col(size) >= capacity).select("*", (-1 - F.monotonically_increasing_id()).alias("sequence_id"), F.lit(0).cast("long").alias("offset"))
    left, n = items.where(F.col(size) < capacity), None
    done, level = [full], 0
    while True:
        n, before = left.count(), n
        groups = max(1, -(-n // group_items))
        last = groups == 1 or (before is not None and n > before // 4)
        dealt = left.select("*", F.pmod(F.xxhash64(F.monotonically_increasing_id(), F.lit(level)), F.lit(groups)).alias("_group"))
        dealt = dealt.repartition(groups, "_group").sortWithinPartitions("_group", F.desc(size))
        schema = T.StructType([*dealt.schema.fields, *[T.StructField(c, T.LongType()) for c in ("_bin", "_offset", "_fill")]])
        packed = written(dealt.mapInArrow(_pack_groups(size, capacity), schema), "packed")
        kept = packed if last else packed.where(F.col("_fill") >= capacity * (1 - slack))
        number = F.lit(level).cast("long") * (1 << 58) + F.col("_group") * (1 << 24) + F.col("_bin")
        done.append(kept.select(*columns, number.alias("sequence_id"), F.col("_offset").alias("offset")))
        if last:
            break
        left, level = packed.where(F.col("_fill") < capacity * (1 - slack)).select(*columns), level + 1
    out = done[0]
    for d in done[1:]:
        out = out.unionByName(d)
    return out


def _pieces(name: str, path: str | None, end_id: int, capacity: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = tokens.encoder(name, path)
        for batch in batches:
            for a, b in tokens.batches(batch.column(1)):
                ids, count = tokens.with_end(*enc.encode(batch.column(1).slice(a, b - a)), end_id)
                n = -(-count // capacity)  # pieces
                of = np.repeat(np.arange(len(count)), n)
                piece = np.arange(len(of)) - np.repeat(np.cumsum(n) - n, n)
                start = capacity * piece
                length = np.minimum(capacity, count[of] - start)
                cols = [batch.column(0).slice(a, b - a).take(pa.array(of)), pa.array(piece, pa.int32()), pa.array(start), pa.array(length), tokens.binaries(ids.astype("<u4"), 4 * np.cumsum(length))]
                yield pa.RecordBatch.from_arrays(cols, ["doc_id", "piece", "start", "length", "ids"])
        enc.rest()

    return run


def token_pieces(docs: DataFrame, tokenizer: str, end_id: int, capacity: int = CAPACITY, tokenizer_path: str | None = None) -> DataFrame:
    """Each document's ids and the end id, cut where they exceed ``capacity``: doc_id, piece, start, length, ids (32-bit little-endian)."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_or_empty().alias("text"))
    return rows.mapInArrow(_pieces(tokenizer, tokenizer_path, end_id, capacity), "doc_id long, piece int, start long, length long, ids binary")


def sequences(packed: DataFrame) -> DataFrame:
    """The packed sequences themselves, from rows with ids: sequence_id, length, ids. One holds ``capacity`` ids at most."""
    parts = F.array_sort(F.collect_list(F.struct("offset", "ids")))
    return packed.groupBy("sequence_id").agg(F.sum("length").alias("length"), parts.alias("p")).select("sequence_id", "length", F.aggregate("p", F.lit(b""), lambda a, x: F.concat(a, x["ids"])).alias("ids"))


def packed_documents(docs: DataFrame) -> DataFrame:
    """Every piece of ``docs`` with its sequence and place there; pieces by their ids' crc32."""
    pieces = token_pieces(docs, "word_bpe_49k.json", end_id=1)
    return pack(written(pieces.select("doc_id", "piece", "start", "length", F.crc32("ids").alias("ids_crc32")), "pieces"), "length")


def op3_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packed_documents(table(spark, sf_dir, "documents"))
