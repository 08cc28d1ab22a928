"""Operator 5: payloads in media columns, as lossless WebP images, and features of the pixels read back.

A payload is cut into images of ``WIDTH`` columns and at most 2^14 rows; their files stand one after the other in the
media column. Reading gives one pixel array per payload.

Defined results: a null text counts as empty, and the empty text as 64 zero bytes; texts of any length are stored whole;
equal texts give equal bytes; an empty table gives no rows. Other columns do not matter.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from skerry.llm import webp
from skerry.llm.common import table, text_or_empty, written

WIDTH = 64
_LEVELS = np.arange(256)


def to_media(payload: bytes) -> bytes:
    """``payload``: a positive multiple of ``WIDTH`` bytes, a grey sample each."""
    rows = np.frombuffer(payload, np.uint8).reshape(-1, WIDTH)
    return b"".join(webp.encode_grey(rows[a : a + webp.MAX_SIDE]) for a in range(0, len(rows), webp.MAX_SIDE))


def images(media: bytes) -> Iterator[np.ndarray]:
    """The pixel arrays of the files in a media value."""
    at = 0
    while at < len(media):
        end = at + 8 + int.from_bytes(media[at + 4 : at + 8], "little")
        yield webp.decode(media[at:end])
        at = end


def _store(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        raw = [t.encode() for t in batch.column(1).to_pylist()]
        sizes = [len(r) for r in raw]
        for a in range(0, len(raw), 256):
            some = [to_media(r + bytes(-len(r) % WIDTH or (0 if r else WIDTH))) for r in raw[a : a + 256]]
            yield pa.RecordBatch.from_arrays([batch.column(0).slice(a, 256), pa.array(sizes[a : a + 256], pa.int64()), pa.array(some, pa.binary())], ["doc_id", "n_bytes", "media"])


def store_texts(docs: DataFrame) -> DataFrame:
    """doc_id, n_bytes, media: each text as UTF-8, filled up with zero bytes to a positive multiple of ``WIDTH``."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_or_empty().alias("text"))
    return rows.mapInArrow(_store, "doc_id long, n_bytes long, media binary")


def feature(pixels: np.ndarray) -> str:
    """Size, sum, sum of squares, sum of steps along rows, and counts of 16 shades, of grey samples."""
    counts = np.bincount(pixels.ravel(), minlength=256)
    shades, steps = counts.reshape(16, 16).sum(axis=1), np.abs(np.diff(pixels.astype(np.int16), axis=1)).sum(dtype=np.int64)
    return f"{pixels.shape[1]}x{pixels.shape[0]}:{counts @ _LEVELS}:{counts @ (_LEVELS * _LEVELS)}:{steps}:" + ",".join(map(str, shades.tolist()))


def _decode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        media = batch.column(2)
        for a in range(0, len(media), 256):
            pixels, features = [], []
            for m in media.slice(a, 256).to_pylist():
                grey = np.concatenate([(p >> 8 & 255).astype(np.uint8) for p in images(m)])
                pixels.append(grey.tobytes())
                features.append(feature(grey))
            yield pa.RecordBatch.from_arrays([c.slice(a, 256) for c in batch.columns] + [pa.array(pixels, pa.binary()), pa.array(features, pa.string())], [*batch.schema.names, "pixels", "feature"])


def read_media(stored: DataFrame) -> DataFrame:
    """``stored`` with pixels (grey samples in rows of ``WIDTH``) and feature."""
    return stored.select("doc_id", "n_bytes", "media").mapInArrow(_decode, "doc_id long, n_bytes long, media binary, pixels binary, feature string")


def op5_media_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    stored = written(store_texts(table(spark, sf_dir, "documents")), "media")
    size = F.length("pixels").cast("long")
    return read_media(stored).select(
        "doc_id", "n_bytes", size.alias("payload_bytes"), F.sha2("pixels", 256).alias("payload_sha256"), F.crc32(F.substring("pixels", -64, 64)).alias("tail_crc32"),
        F.length("media").cast("long").alias("media_bytes"), F.sha2("media", 256).alias("media_sha256"), "feature",
    )
