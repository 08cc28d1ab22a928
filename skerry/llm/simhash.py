"""Operator 7: near-duplicates by SimHash, with pigeonring filtering.

A text's fingerprint has 64 bits; a bit is set if it is set in over half of the hashes of its word shingles, repeats
included. Fingerprints link where at most 3 bits differ. Equal fingerprints are one node from the start.

Candidates: the 64 bits are a ring of 4 segments of 16. If two fingerprints differ in 3 bits at most, there is a
segment from which every chain of l consecutive segments differs in at most l * 3 / 4 bits: none in the first, 1 in two,
2 in three. So the first segment is equal, and of the second at least one half is: that makes 8 keys of 24 bits, one of
which two linked fingerprints share. Pairs that meet under a key must pass the longer chains before the full check.

A key's fingerprints are dealt into blocks of ``BLOCK`` and pairs of blocks, each pair one group; from a group goes
only a forest of its links, so no group's pairs are ever written out. Components come from ``components``.

Defined results: a null text counts as empty; texts without words have fingerprint zero and link like others; a text
of fewer words than a shingle is one shingle; null doc_ids are kept and do not count for component_id (null if there is
no other); repeated rows are kept; an empty table gives no rows. Other columns do not matter.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from skerry.llm.common import give_back, parts, table, text_or_empty, written
from skerry.llm.components import connected_components

WORDS, SEED, BITS, BLOCK = 3, 42, 3, 512
_ROWS = 1 << 18


def shingle_hashes(text: str, words: int = WORDS, seed: int = SEED) -> list[int]:
    """XXH64 of each shingle of the text with A-Z in lower case; words end at space, tab and line breaks of ASCII."""
    found = text.encode().lower().split()
    if not found:
        return []
    line = b" ".join(found)
    if len(found) <= words:
        return [xxhash.xxh64_intdigest(line, seed)]
    ends = np.cumsum([len(w) + 1 for w in found])
    starts = [0, *ends[:-words].tolist()]
    digest = xxhash.xxh64_intdigest
    return [digest(line[a:b], seed) for a, b in zip(starts, (ends[words - 1 :] - 1).tolist(), strict=True)]


def fingerprint_of(hashes: np.ndarray) -> int:
    """The bits that over half of the hashes have; 0 for none."""
    ones = np.zeros(64, np.int64)
    for a in range(0, len(hashes), _ROWS):
        part = hashes[a : a + _ROWS]
        ones += np.unpackbits(part.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * ones > len(hashes), bitorder="little").view("<u8")[0])


def fingerprints_of(texts: list[str], words: int = WORDS, seed: int = SEED) -> np.ndarray:
    return np.array([fingerprint_of(np.array(shingle_hashes(t, words, seed), "<u8")) for t in texts], np.uint64)


def _fingerprints(words: int, seed: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            fp = fingerprints_of(batch.column(1).to_pylist(), words, seed)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(fp.view(np.int64))], ["doc_id", "fp"])
        give_back()

    return run


def fingerprints(docs: DataFrame, words: int = WORDS, seed: int = SEED) -> DataFrame:
    """doc_id and fp (64 bits as a signed number), a row for each row of ``docs``."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_or_empty().alias("text"))
    return rows.mapInArrow(_fingerprints(words, seed), "doc_id long, fp long")


def _keys() -> Column:
    """The 8 keys: which segment comes first and which half of the next is equal (3 bits), the segment, the half."""
    fp, out = F.col("fp"), []
    for i in range(4):
        first = F.shiftrightunsigned(fp, 16 * i).bitwiseAND(F.lit(0xFFFF))
        for half in range(2):
            next_half = F.shiftrightunsigned(fp, (16 * (i + 1) + 8 * half) % 64).bitwiseAND(F.lit(0xFF))
            out.append(F.lit((2 * i + half) << 24) + first * 256 + next_half)
    return F.array(*out)


_CHAIN = [(np.uint64((1 << 32) - 1), 1), (np.uint64((1 << 48) - 1), 2), (np.uint64((1 << 64) - 1), BITS)]


def link_group(key: int, fps: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """A forest of the links among distinct fingerprints that share ``key``: two arrays of ends."""
    turn = np.uint64(16 * (key >> 25))
    ring = fps if not turn else fps >> turn | fps << (np.uint64(64) - turn)  # the first segment lowest
    i, j = np.triu_indices(len(ring), 1)
    for mask, budget in _CHAIN:
        near = np.bitwise_count((ring[i] ^ ring[j]) & mask) <= budget
        i, j = i[near], j[near]
    if len(i) <= 1:
        return fps[i], fps[j]
    near = np.zeros((len(ring), len(ring)), bool)
    near[i, j] = near[j, i] = True
    fresh = near.any(axis=1)
    a, b = [], []
    for start in np.flatnonzero(fresh).tolist():
        if not fresh[start]:
            continue
        fresh[start] = False
        todo = [start]
        while todo:
            n = todo.pop()
            new = np.flatnonzero(near[n] & fresh)
            fresh[new] = False
            a.append(np.full(len(new), n))
            b.append(new)
            todo += new.tolist()
    return fps[np.concatenate(a)], fps[np.concatenate(b)]


def _links(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Groups follow each other in sorted rows; one may go on in the next batch."""
    held_key, held = None, []

    def finish(out: list) -> None:
        fps = np.concatenate(held)
        if len(fps) > 1:
            a, b = link_group(held_key[0], fps.view(np.uint64))
            if len(a):
                out.append((a.view(np.int64), b.view(np.int64)))

    def emit(out: list) -> Iterator[pa.RecordBatch]:
        if out:
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(x)) for x in zip(*out, strict=True)], ["u", "v"])

    for batch in batches:
        if not batch.num_rows:
            continue
        key, low, high, fp = (batch.column(i).to_numpy() for i in range(4))
        cuts = np.flatnonzero((np.diff(key) != 0) | (np.diff(low) != 0) | (np.diff(high) != 0)) + 1
        out: list = []
        for a, b in zip([0, *cuts.tolist()], [*cuts.tolist(), len(key)], strict=True):
            group = (int(key[a]), int(low[a]), int(high[a]))
            if group != held_key:
                if held:
                    finish(out)
                held_key, held = group, []
            held.append(fp[a:b])
        yield from emit(out)
    if held:
        out = []
        finish(out)
        yield from emit(out)


def links(nodes: DataFrame, block: int = BLOCK) -> DataFrame:
    """u, v: edges that connect what links connect. ``nodes``: distinct fp, a stored table."""
    keyed = nodes.select("fp", F.explode(_keys()).alias("key"))
    shared = written(keyed.groupBy("key").agg(F.count("*").alias("n")).where("n > 1"), "keys")
    met = keyed.join(shared, "key").withColumn("blocks", F.ceil(F.col("n") / block).cast("int")).withColumn("own", F.pmod(F.xxhash64("fp"), "blocks").cast("int"))
    pairs = met.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))).select("key", F.least("own", "other").alias("low"), F.greatest("own", "other").alias("high"), "fp")
    pairs = pairs.repartition(parts(nodes.sparkSession), "key", "low", "high").sortWithinPartitions("key", "low", "high", "fp")
    return pairs.mapInArrow(_links, "u long, v long").distinct()


def near_duplicates(docs: DataFrame, words: int = WORDS, seed: int = SEED) -> DataFrame:
    """doc_id, fp and component_id (the smallest doc_id that links reach) of every row."""
    marked = written(fingerprints(docs, words, seed), "fingerprints")
    nodes = written(marked.groupBy("fp").agg(F.min("doc_id").alias("rep")), "nodes")
    found = connected_components(links(nodes)).withColumnsRenamed({"u": "fp", "v": "root"})
    rooted = written(nodes.join(found, "fp", "left").select("fp", "rep", F.coalesce("root", "fp").alias("root")), "rooted")
    least = written(rooted.groupBy("root").agg(F.min("rep").alias("component_id")), "least")
    classes = written(rooted.join(least, "root").select("fp", "component_id"), "classes")
    return marked.join(classes, "fp", "left").select("doc_id", "fp", "component_id")


def keep_least(docs: DataFrame, marks: DataFrame) -> DataFrame:
    """The rows of ``docs`` that ``marks`` (doc_id, component_id) has as their component's smallest, one a doc_id; rows without a doc_id all stay."""
    kept = marks.where(F.col("doc_id") == F.col("component_id")).select(F.col("doc_id").alias("id")).distinct()
    rows = docs.where(F.col("doc_id").isNotNull()).select(F.struct(*docs.columns).alias("row"), F.col("doc_id").cast("long").alias("id"))
    found = rows.join(kept, "id", "left_semi")
    first = found.withColumn("nth", F.row_number().over(Window.partitionBy("id").orderBy("row.text"))).where("nth = 1").select("row.*")
    return first.unionByName(docs.where(F.col("doc_id").isNull()))


def keep_one(docs: DataFrame, words: int = WORDS, seed: int = SEED) -> DataFrame:
    """Of each component the row with the smallest doc_id (of repeated rows one); rows without a doc_id all stay."""
    return keep_least(docs, near_duplicates(docs.where(F.col("doc_id").isNotNull()), words, seed))


def op7_simhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = near_duplicates(table(spark, sf_dir, "documents"))
    return out.select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")
