"""Operator 9: token ids as binary shards whose document boundaries are Elias-Fano coded.

A store is a folder of Parquet files that carry opaque segments. A segment holds the concatenated ids of some
documents (2 bytes an id where the vocabulary allows, else 4), the Elias-Fano coded ends of these documents in it, and
their Elias-Fano coded doc_ids. Shards are ascending ranges of doc_id, segments ascend within a shard.

Defined results: a null text counts as empty (only the end id); null doc_ids come first, in their own places; rows with
equal doc_id follow each other by their texts' hash, then ids; an empty table gives an empty store. Other columns of
the input are ignored, whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from skerry.llm import elias_fano, tokens
from skerry.llm.common import forget, new_path, parts, table, text_or_empty, written

SEGMENT_IDS = 1 << 20
_SEGMENT = "shard int, segment int, ids_before long, n_docs int, n_null int, first_doc long, doc_gaps binary, ends binary, width int, ids binary, n_ids long"


def _encoded(name: str, path: str | None, end_id: int):
    """doc_id, h, n and the ids with the end id, ``width`` bytes each, in the order of the rows."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = tokens.encoder(name, path)
        width = id_width(enc, end_id)
        for batch in batches:
            for a, b in tokens.batches(batch.column(2)):
                part = batch.slice(a, b - a)
                ids, count = tokens.with_end(*enc.encode(part.column(2)), end_id)
                body = tokens.binaries(ids.astype(f"<u{width}"), width * np.cumsum(count))
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array(count), body], ["doc_id", "h", "n", "ids"])
        enc.rest()

    return run


def id_width(enc: tokens.WordEncoder, end_id: int) -> int:
    return 2 if max(enc.tokenizer.get_vocab_size(), end_id + 1) <= 1 << 16 else 4


def _segments(name: str, path: str | None, end_id: int, segment_ids: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        width = id_width(tokens.encoder(name, path), end_id)
        shard, segment, before, held = TaskContext.get().partitionId(), 0, 0, 0
        rows: list[pa.RecordBatch] = []

        def flush() -> pa.RecordBatch:
            nonlocal segment, before, held, rows
            whole = pa.Table.from_batches(rows)
            docs = whole.column(0)
            known = docs.drop_null().to_numpy()
            first = int(known[0]) if len(known) else 0
            ends = np.cumsum(whole.column(1).to_numpy())
            body = b"".join(x.as_buffer() for x in whole.column(2))
            row = [shard, segment, before, len(docs), docs.null_count, first, elias_fano.encode((known - first).astype(np.uint64)), elias_fano.encode(ends), width, body, held]
            segment, before, rows, held = segment + 1, before + held, [], 0
            types = [pa.int32(), pa.int32(), pa.int64(), pa.int32(), pa.int32(), pa.int64(), pa.binary(), pa.binary(), pa.int32(), pa.binary(), pa.int64()]
            names = [f.split()[0] for f in _SEGMENT.split(", ")]
            return pa.RecordBatch.from_arrays([pa.array([x], t) for x, t in zip(row, types, strict=True)], names)

        for batch in batches:
            size = np.cumsum(batch.column(1).to_numpy())
            at, done = 0, 0
            while at < len(size):  # a segment ends with the row that fills it
                stop = min(len(size), int(np.searchsorted(size, done + segment_ids - held)) + 1)
                rows.append(batch.slice(at, stop - at))
                held += int(size[stop - 1]) - done
                at, done = stop, int(size[stop - 1])
                if held >= segment_ids:
                    yield flush()
        if rows:
            yield flush()

    return run


def write_token_shards(docs: DataFrame, path: str, tokenizer: str, end_id: int, tokenizer_path: str | None = None, segment_ids: int = SEGMENT_IDS) -> None:
    """Encode ``docs`` (doc_id, text) in ascending doc_id order into a store at ``path``.

    Texts are encoded where they are read; what is sorted are ids, a table that is stored first, so that the sampling of
    ranges reads its first two columns only.
    """
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64(text_or_empty()).alias("h"), text_or_empty().alias("text"))
    encoded = written(rows.mapInArrow(_encoded(tokenizer, tokenizer_path, end_id), "doc_id long, h long, n long, ids binary"), "encoded")
    dealt = encoded.repartitionByRange(parts(docs.sparkSession), "doc_id", "h").sortWithinPartitions("doc_id", "h", "ids").select("doc_id", "n", "ids")
    dealt.mapInArrow(_segments(tokenizer, tokenizer_path, end_id, segment_ids), _SEGMENT).write.option("compression", "zstd").parquet(path)
    forget(encoded)


#: Documents whose ends are looked up together.
SLICE_DOCS = 1024


def _documents(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The documents of segments, a slice at a time: ends and doc_ids by select, ids by the ends, no table of offsets."""
    for batch in batches:
        for r in batch.to_pylist():
            ends, gaps = elias_fano.EliasFano(r["ends"]), elias_fano.EliasFano(r["doc_gaps"])
            nulls, w, done = r["n_null"], r["width"], 0
            for a in range(0, len(ends), SLICE_DOCS):
                b = min(len(ends), a + SLICE_DOCS)
                stop = ends.select_range(a, b)
                start = np.concatenate([[done], stop[:-1]])
                without = max(0, min(nulls, b) - a)
                known = gaps.select_range(max(a - nulls, 0), max(b - nulls, 0)) + r["first_doc"] if b > nulls else np.empty(0, np.int64)
                docs = pa.concat_arrays([pa.nulls(without, pa.int64()), pa.array(known, pa.int64())])
                ids = np.frombuffer(r["ids"], f"<u{w}", int(stop[-1]) - done, w * done).astype("<u4")
                yield pa.RecordBatch.from_arrays([docs, pa.array(start + (r["shard_start"] + r["ids_before"]), pa.int64()), pa.array(stop - start, pa.int64()), tokens.binaries(ids, 4 * (stop - done))], ["doc_id", "start", "n_tokens", "ids"])
                done = int(stop[-1])


def read_token_shards(spark: SparkSession, path: str) -> DataFrame:
    """Documents of a store: doc_id, start (ids of all documents before), n_tokens, ids (little-endian unsigned 32 bit).

    Where each shard starts comes from one total a shard; shards are as many as the writer's partitions.
    """
    segments = spark.read.schema(_SEGMENT).parquet(path)
    totals = segments.groupBy("shard").agg(F.sum("n_ids").alias("n"))
    before = Window.orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)
    starts = totals.select("shard", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("shard_start"))
    return segments.join(F.broadcast(starts), "shard").mapInArrow(_documents, "doc_id long, start long, n_tokens long, ids binary")


def read_document(segment: dict, i: int) -> np.ndarray:
    """Random access: the ids of the i-th document of a segment row, by two selects and no table of offsets."""
    ends = elias_fano.EliasFano(segment["ends"])
    a, b = ends.select(i - 1) if i else 0, ends.select(i)
    w = segment["width"]
    return np.frombuffer(segment["ids"][w * a : w * b], f"<u{w}")


def op9_token_store(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = new_path(spark, "tokens")
    write_token_shards(table(spark, sf_dir, "documents"), path, "byte_bpe_50k.json", end_id=2)
    return read_token_shards(spark, path).select("doc_id", "start", "n_tokens", F.crc32("ids").alias("ids_crc32"))
