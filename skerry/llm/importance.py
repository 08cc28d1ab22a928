"""Operator 11: documents drawn by importance weights towards a target's distribution of hashed features.

Features are the runs of one and two words; each falls into one of ``BUCKETS`` buckets by its crc32. Feature counts of
all documents and of the target are summed by bucket, which gives each bucket a gain (a log ratio); the array of gains
goes with the scoring function, and a document's weight is the mean gain of its features. A Gumbel number from a hash of
seed and doc_id is added, so that the highest scores are a draw without replacement in proportion to the weights.

The draw is a distributed merge. Whole-number scores have few values (under 100,000 by their definition), so their counts
give the score at which the draw ends; rows below it can't be drawn. The others are sorted in their partitions, and each
partition's order is stored as a run. The runs are cut at common ranges of the order, and a task merges the cuts of one
range by a tournament tree, starts at the rank that the ranges before it leave, and stops at the draw's last rank; ranges
beyond that are not merged. A range holds about ``RANGE_ROWS`` rows however scores or ids repeat, since a row's place in
the runs breaks the last ties.

Defined results: a null text has no words; documents with fewer words than ``least_words`` have a weight and a score but
are not drawn; a null doc_id is hashed as empty text and comes after others on ties; repeated rows each count and are
drawn each for itself; an empty table gives no rows; an empty target, or one without words, gives gains by its zero
counts. Only doc_id and text are read, whatever other columns are called.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from skerry.llm.byte_words import crc32_of, slices, words
from skerry.llm.common import give_back, parts, table, text_or_empty, written
from skerry.llm.tournament import merged

BUCKETS, LEAST_WORDS, SEED, PERCENT = 10_000, 20, 7, 25
RANGE_ROWS = 1 << 15
_IN_WORD = np.zeros(256, bool)
for _a, _b in ((48, 58), (97, 123), (128, 256)):
    _IN_WORD[_a:_b] = True
_SPACE = np.frombuffer(b" ", np.uint8)


def features_of(texts: list[bytes], buckets: int = BUCKETS) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(words of each text, text of each feature, its bucket)."""
    data, start, end, text = words(texts, _IN_WORD, b"\0")
    one = crc32_of(data, start, end)
    pair = np.flatnonzero(text[1:] == text[:-1]) + 1
    spaced = crc32_of(_SPACE, np.zeros(len(pair), np.int64), np.ones(len(pair), np.int64), one[pair - 1])
    two = crc32_of(data, start[pair], end[pair], spaced)
    return np.bincount(text, minlength=len(texts)), np.concatenate([text, text[pair]]), np.concatenate([one, two]) % np.uint32(buckets)


def bucket_counts(docs: DataFrame, buckets: int = BUCKETS) -> np.ndarray:
    """Features of all texts by bucket: an array a task, summed by bucket; the driver sees ``buckets`` numbers."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = np.zeros(buckets, np.int64)
        for batch in batches:
            for _, texts in slices(batch, 0):
                counts += np.bincount(features_of(texts, buckets)[2], minlength=buckets)
        used = np.flatnonzero(counts)
        yield pa.RecordBatch.from_arrays([pa.array(used, pa.int32()), pa.array(counts[used])], ["bucket", "n"])
        give_back()

    out = np.zeros(buckets, np.int64)
    for b, n in docs.select(text_or_empty().alias("text")).mapInArrow(run, "bucket int, n long").groupBy("bucket").agg(F.sum("n")).collect():
        out[b] = n
    return out


def gains(raw: np.ndarray, target: np.ndarray) -> np.ndarray:
    """1000 times the log ratio of a bucket's share in the target and in all documents, one added to each count, floored."""
    b, s_all, t_all = len(raw), int(raw.sum()), int(target.sum())
    return np.array([math.floor(1000 * math.log(float(t + 1) * (s_all + b) / (float(s + 1) * (t_all + b)))) for s, t in zip(raw.tolist(), target.tolist(), strict=True)], np.int64)


def gumbel(doc_id: int | None, seed: int = SEED) -> int:
    h = int(hashlib.sha256(f"{seed}:{'' if doc_id is None else doc_id}".encode()).hexdigest()[:8], 16)
    return math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296)))


def _score(gain: np.ndarray, seed: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for piece, texts in slices(batch, 1):
                n_words, owner, bucket = features_of(texts, len(gain))
                n = np.bincount(owner, minlength=len(texts))
                total = np.bincount(owner, gain[bucket], minlength=len(texts)).astype(np.int64)  # whole numbers below 2 ** 53
                weight = total // np.maximum(n, 1)
                score = weight + np.array([gumbel(i, seed) for i in piece.column(0).to_pylist()], np.int64)
                yield pa.RecordBatch.from_arrays([piece.column(0), *[pa.array(x, pa.int64()) for x in (n, n_words, weight, score)]], ["doc_id", "n_features", "n_words", "weight", "score"])
        give_back()

    return run


_RUN_COLUMNS = ["doc_id", "n_features", "weight", "score"]
_DRAWN = "doc_id long, n_features long, weight long, score long, rank long"


def _merge(rows: pa.Table) -> pa.Table:
    """The cuts of one range, merged to its last rank; what is beyond has none."""
    run, pos = (rows.column(c).to_numpy() for c in ("run", "pos"))
    rows = rows.take(np.lexsort((pos, run)))
    quota = rows.column("quota")[0].as_py()
    cuts = np.flatnonzero(np.diff(rows.column("run").to_numpy())) + 1
    ids = rows.column("doc_id").to_pylist()
    keys = list(zip((-rows.column("score").to_numpy()).tolist(), [i is None for i in ids], [i or 0 for i in ids], rows.column("n_features").to_pylist(), strict=True))
    begin = [0, *cuts.tolist()]
    runs = [keys[a:b] for a, b in zip(begin, [*cuts.tolist(), len(keys)], strict=True)]
    order = [begin[r] + p for r, p in merged(runs, quota)]
    rank = np.full(len(keys), -1, np.int64)
    rank[order] = rows.column("before")[0].as_py() + 1 + np.arange(len(order))
    return pa.table([*[rows.column(c) for c in _RUN_COLUMNS], pa.array(rank, mask=rank < 0)], names=[*_RUN_COLUMNS, "rank"])


def importance_resample(docs: DataFrame, target: DataFrame, percent: int = PERCENT, least_words: int = LEAST_WORDS, seed: int = SEED, buckets: int = BUCKETS) -> DataFrame:
    """doc_id, n_features, weight, score and rank (null: not drawn) of every row of ``docs``; ``target`` has text."""
    spark = docs.sparkSession
    gain = gains(bucket_counts(docs, buckets), bucket_counts(target, buckets))
    slim = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_or_empty().alias("text"))
    scored = written(slim.mapInArrow(_score(gain, seed), "doc_id long, n_features long, n_words long, weight long, score long"), "scored")
    may = scored.where(F.col("n_words") >= least_words)
    counts = dict(may.groupBy("score").agg(F.count("*")).collect())
    draw = percent * sum(counts.values()) // 100
    no_rank = F.lit(None).cast("long").alias("rank")
    if not draw:
        return scored.select(*_RUN_COLUMNS, no_rank)
    values = sorted(counts, reverse=True)
    upto = np.cumsum([counts[v] for v in values])
    last = int(np.searchsorted(upto, draw))
    least, candidates = values[last], int(upto[last])
    order = [F.desc("score"), F.asc_nulls_last("doc_id"), F.asc("n_features")]
    runs = may.where(F.col("score") >= least).sortWithinPartitions(*order).select(*_RUN_COLUMNS, F.spark_partition_id().alias("run"), F.monotonically_increasing_id().alias("pos"))
    runs = written(runs, "runs")
    ranges = max(parts(spark), candidates // RANGE_ROWS + 1)
    dealt = written(runs.repartitionByRange(ranges, *order, "run", "pos").withColumn("_range", F.spark_partition_id()), "ranges")
    sizes = dealt.groupBy("_range").agg(F.count("*").alias("size"))
    before = F.coalesce(F.sum("size").over(Window.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))  # a row a range
    starts = sizes.withColumn("before", before).select("_range", "before", F.greatest(F.lit(draw) - F.col("before"), F.lit(0)).alias("quota"))
    with_quota = dealt.join(starts, "_range")
    drawn = with_quota.where("quota > 0").groupBy("_range").applyInArrow(_merge, _DRAWN)
    beyond = with_quota.where("quota = 0").select(*_RUN_COLUMNS, no_rank)
    rest = scored.where((F.col("n_words") < least_words) | (F.col("score") < least)).select(*_RUN_COLUMNS, no_rank)
    return drawn.unionByName(beyond).unionByName(rest)


def op11_importance_resampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    return importance_resample(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


_BYTES = "list_transform(range(1, CAST(octet_length(encode({0})) AS BIGINT) + 1), lambda i: CAST(('0x' || substr(hex(encode({0})), CAST(2 * i - 1 AS INT), 2)) AS BIGINT))"
_STEP = "xor(c >> 1, CASE WHEN c & 1 = 1 THEN 3988292384 ELSE 0 END)"


def _features_sql(name: str, source: str, key: str) -> str:
    return f"""{name}_w AS (SELECT {key}, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+') AS w FROM {source}),
{name}_f AS (SELECT {key}, len(w) AS n_words, unnest(list_concat(w, list_transform(range(1, greatest(len(w), 1)), lambda i: w[i] || ' ' || w[i + 1]))) AS feature FROM {name}_w)"""


OP11_SQL = f"""WITH RECURSIVE bits AS (SELECT i AS b, 0 AS k, i AS c FROM range(256) t(i) UNION ALL SELECT b, k + 1, {_STEP} FROM bits WHERE k < 8),
tab AS (SELECT list(c ORDER BY b) AS tab FROM bits WHERE k = 8),
{_features_sql('d', 'documents', 'doc_id')}, {_features_sql('q', 'benchmark', 'item_id')},
names AS (SELECT feature FROM d_f UNION SELECT feature FROM q_f),
hashed AS (SELECT feature, xor(list_reduce(list_prepend(CAST(4294967295 AS BIGINT), {_BYTES.format('feature')}), lambda c, x: xor(c >> 8, tab[CAST(xor(c, x) & 255 AS INT) + 1])), 4294967295) % 10000 AS bucket FROM names, tab),
s AS (SELECT bucket, count(*) AS s FROM d_f JOIN hashed USING (feature) GROUP BY ALL), t AS (SELECT bucket, count(*) AS t FROM q_f JOIN hashed USING (feature) GROUP BY ALL),
gain AS (SELECT bucket, floor(1000 * ln(CAST(coalesce(t, 0) + 1 AS DOUBLE) * ((SELECT count(*) FROM d_f) + 10000) / (CAST(coalesce(s, 0) + 1 AS DOUBLE) * ((SELECT count(*) FROM q_f) + 10000)))) AS gain FROM s FULL JOIN t USING (bucket)),
weights AS (SELECT doc_id, count(*) AS n_features, CAST(floor(sum(gain) / count(*)) AS BIGINT) AS weight FROM d_f JOIN hashed USING (feature) JOIN gain USING (bucket) GROUP BY ALL),
scored AS (SELECT doc_id, len(w) AS n_words, coalesce(n_features, 0) AS n_features, coalesce(weight, 0) AS weight, coalesce(weight, 0) + CAST(floor(-1000 * ln(-ln((CAST('0x' || substr(sha256('7:' || doc_id), 1, 8) AS BIGINT) + 0.5e0) / 4294967296e0))) AS BIGINT) AS score FROM d_w LEFT JOIN weights USING (doc_id)),
ranked AS (SELECT *, CASE WHEN n_words >= 20 THEN row_number() OVER (PARTITION BY n_words >= 20 ORDER BY score DESC, doc_id) END AS r FROM scored)
SELECT doc_id, CAST(n_features AS BIGINT) AS n_features, weight, score, CASE WHEN r <= (SELECT 25 * count(*) // 100 FROM scored WHERE n_words >= 20) THEN r END AS rank FROM ranked"""
