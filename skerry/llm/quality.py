"""Operator 6: a quality classifier by regularised quadratic discriminant analysis over document statistics.

Each text becomes ``FEATURES`` numbers (lengths, shares of characters, repetition), shares through a logit and counts
through a logarithm. Per class the mean and a covariance are fitted; the covariance is shrunk towards the pooled one
and towards a multiple of the identity. The inverse Cholesky factors are kept in the model, and the score comes from
the difference of the two log densities (Mahalanobis distance and log determinant) and the log prior ratio.

Fitting takes every labelled row given: moments are summed on the executors, and the driver sees 2 (p^2 + p + 1) sums.

Defined results: a null text counts as empty, and the empty text has statistics and so a score like any other; rows
with equal text get equal scores; labels other than 0 and 1 or null are ignored, and each label row counts once for
each row of its document; if a class has no row, all scores are 0.5; an empty table gives no rows. Other columns do
not enter, whatever their names.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from skerry.llm.common import give_back, table, text_or_empty, written

FEATURES = ["log_bytes", "log_words", "letters", "upper", "digits", "spaces", "stops", "symbols", "shouts", "high_bytes", "entropy", "log_word_length", "distinct_words", "top_word", "same_neighbour", "plain_words", "log_line_length", "distinct_lines", "distinct_pairs"]
TO_POOLED, TO_IDENTITY = 0.2, 0.02
_EPS = 1e-3

_CLASS = np.zeros((7, 256))
for _i in range(256):
    _c = chr(_i)
    if _i >= 128:
        _CLASS[6, _i] = 1
    elif _c.isalpha():
        _CLASS[0, _i] = 1
        _CLASS[1, _i] = _c.isupper()
    elif _c.isdigit():
        _CLASS[2, _i] = 1
    elif _c.isspace():
        _CLASS[3, _i] = 1
    elif _c in ".,;:":
        _CLASS[4, _i] = 1
    elif _c in "!?":
        _CLASS[5, _i] = 1
_SYMBOL = 1 - _CLASS[[0, 2, 3, 4, 5, 6]].sum(axis=0)


def _logit(x: float) -> float:
    return float(np.log((x + _EPS) / (1 - x + _EPS)))


def statistics(text: str) -> list[float]:
    """The document's numbers, in the order of ``FEATURES``."""
    raw = text.encode("utf-8", "surrogatepass")
    n = len(raw)
    hist = np.bincount(np.frombuffer(raw, np.uint8), minlength=256).astype(float)
    letters, upper, digits, spaces, stops, shouts, high = (_CLASS @ hist).tolist()
    symbols = float(_SYMBOL @ hist)
    p = hist[hist > 0] / max(n, 1)
    entropy = float(-(p * np.log2(p)).sum())
    words = text.split()
    w = len(words)
    counts = Counter(words)
    pairs = list(zip(words, words[1:], strict=False))
    lines = [x for x in text.split("\n") if x]
    of = lambda a, b: a / b if b else 0.0
    plain = sum(v for k, v in counts.items() if k[:-1].isalpha() and (k[-1].isalpha() or k[-1] in ".,") or k.isalpha())
    return [
        np.log1p(n), np.log1p(w), _logit(of(letters + high, n)), _logit(of(upper, letters)), _logit(of(digits, n)), _logit(of(spaces, n)),
        _logit(of(stops, n)), _logit(of(symbols, n)), _logit(of(shouts, n)), _logit(of(high, n)), entropy, np.log1p(of(n, w)),
        _logit(of(len(counts), w)), _logit(of(max(counts.values(), default=0), w)), _logit(of(sum(a == b for a, b in pairs), len(pairs))),
        _logit(of(plain, w)), np.log1p(of(n, len(lines))), _logit(of(len(set(lines)), len(lines))), _logit(of(len(set(pairs)), len(pairs))),
    ]


def _matrix(texts: pa.Array) -> np.ndarray:
    return np.array([statistics(t or "") for t in texts.to_pylist()], float).reshape(-1, len(FEATURES))


def _with_statistics(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        x = _matrix(batch.column(1))
        yield pa.RecordBatch.from_arrays([batch.column(0), *[pa.array(x[:, j]) for j in range(x.shape[1])]], ["doc_id", *FEATURES])


def features(docs: DataFrame) -> DataFrame:
    """doc_id and ``FEATURES``, a row for each row of ``docs``."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_or_empty().alias("text"))
    return rows.mapInArrow(_with_statistics, "doc_id long, " + ", ".join(f"{f} double" for f in FEATURES))


@dataclass(frozen=True)
class Model:
    """Means, inverse Cholesky factors and log determinants by class; ``log_prior`` is that of class 1 over class 0."""

    means: np.ndarray
    factors: np.ndarray
    log_dets: np.ndarray
    log_prior: float

    def score(self, x: np.ndarray) -> np.ndarray:
        if not len(self.means):
            return np.full(len(x), 0.5)
        dens = []
        for c in (0, 1):
            z = (x - self.means[c]) @ self.factors[c].T
            dens.append(-0.5 * ((z * z).sum(axis=1) + self.log_dets[c]))
        diff = dens[1] - dens[0] + self.log_prior
        return 1 / (1 + np.exp(-np.arcsinh(diff)))  # keeps far apart densities apart


def _moments(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    p = len(FEATURES)
    sums = np.zeros((2, 1 + p + p * p))
    for batch in batches:
        y = batch.column(0).to_numpy()
        x = np.column_stack([batch.column(1 + j).to_numpy() for j in range(p)])
        for c in (0, 1):
            own = x[y == c]
            sums[c] += np.concatenate([[len(own)], own.sum(axis=0), (own.T @ own).ravel()])
    k = sums.shape[1]
    yield pa.RecordBatch.from_arrays([pa.array(np.repeat([0, 1], k), pa.int32()), pa.array(np.tile(np.arange(k), 2), pa.int32()), pa.array(sums.ravel())], ["c", "i", "v"])


def fit(labelled: DataFrame, to_pooled: float = TO_POOLED, to_identity: float = TO_IDENTITY) -> Model:
    """``labelled``: quality (0 or 1) and ``FEATURES``."""
    p = len(FEATURES)
    rows = labelled.where(F.col("quality").isin(0, 1)).select(F.col("quality").cast("int"), *FEATURES)
    sums = np.zeros((2, 1 + p + p * p))
    for c, i, v in rows.mapInArrow(_moments, "c int, i int, v double").groupBy("c", "i").agg(F.sum("v")).collect():
        sums[c, i] = v
    n = sums[:, 0]
    if not n.all():
        return Model(np.empty((0, p)), np.empty((0, p, p)), np.empty(0), 0.0)
    means = sums[:, 1 : p + 1] / n[:, None]
    scatter = np.stack([sums[c, p + 1 :].reshape(p, p) - n[c] * np.outer(means[c], means[c]) for c in (0, 1)])
    pooled = scatter.sum(axis=0) / n.sum()
    scale = np.diag(np.maximum(np.diag(pooled), 1e-6))
    factors, dets = [], []
    for c in (0, 1):
        cov = (1 - to_pooled) * scatter[c] / n[c] + to_pooled * pooled
        cov = (1 - to_identity) * cov + to_identity * scale + 1e-6 * np.eye(p)
        low = np.linalg.cholesky(cov)
        factors.append(np.linalg.inv(low))
        dets.append(2 * np.log(np.diag(low)).sum())
    return Model(means, np.stack(factors), np.array(dets), float(np.log(n[1] / n[0])))


def _score_rows(model: Model):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = np.column_stack([batch.column(1 + j).to_numpy() for j in range(len(FEATURES))])
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(model.score(x))], ["doc_id", "score"])

    return run


def score(stats: DataFrame, model: Model) -> DataFrame:
    """doc_id and score (0 to 1; higher: class 1 likelier) of the rows of ``features``."""
    return stats.select("doc_id", *FEATURES).mapInArrow(_score_rows(model), "doc_id long, score double")


def _good(model: Model, text: int, threshold: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = _matrix(batch.column(text).cast(pa.string()))
            yield batch.filter(pa.array(model.score(x) >= threshold))
        give_back()

    return run


def held_out(doc_id="doc_id"):
    """Rows that no label is learnt from: crc32 of the id as text leaves 1 when divided by 3."""
    return F.coalesce(F.crc32(F.col(doc_id).cast("string").cast("binary")) % 3 == 1, F.lit(False))


def fit_on_table(stats: DataFrame, labels: DataFrame) -> Model:
    known = labels.select(F.col("doc_id").cast("long").alias("doc_id"), "quality").where(F.col("quality").isNotNull() & ~held_out())
    return fit(stats.join(known, "doc_id"))


#: Up to so many labelled ids are sent to all tasks.
BROADCAST_LABELS = 1_000_000


def keep_quality(docs: DataFrame, labels: DataFrame, threshold: float = 0.5) -> DataFrame:
    """The rows of ``docs``, all columns as they are, that a model fitted to their own labelled rows scores ``threshold`` or more.

    To fit, the labelled rows' texts are read, to judge, all; texts are neither stored nor shuffled. Where there are more
    labelled ids than ``BROADCAST_LABELS``, statistics of all texts are made and numbers alone meet the labels.
    """
    known = labels.select(F.col("doc_id").cast("long").alias("doc_id"), "quality").where(F.col("quality").isin(0, 1) & ~held_out())
    asked = docs.select("doc_id", "text")
    if known.count() <= BROADCAST_LABELS:
        asked = asked.join(F.broadcast(known.select("doc_id").distinct()), "doc_id", "left_semi")
    model = fit_on_table(features(asked), labels)
    return docs.mapInArrow(_good(model, docs.columns.index("text"), threshold), docs.schema)


def op6_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    stats = written(features(table(spark, sf_dir, "documents")), "statistics")
    model = fit_on_table(stats, table(spark, sf_dir, "labels"))
    return score(stats, model).select("doc_id", held_out().alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))
