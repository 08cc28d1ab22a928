"""Operator 11 against a plain version, the tournament tree, and checksums of ranges."""

import hashlib
import heapq
import math
import re
import zlib
from collections import Counter

import numpy as np
import pytest
from hypothesis import given
from hypothesis import strategies as st
from pyspark.sql import functions as F

from skerry.llm import importance
from skerry.llm.byte_words import crc32_of
from skerry.llm.tournament import merged


@given(st.lists(st.lists(st.integers(0, 9), max_size=8).map(sorted), max_size=9), st.one_of(st.none(), st.integers(0, 60)))
def test_runs_merge_in_order_and_stop(runs, stop):
    got = [runs[r][p] for r, p in merged(runs, stop)]
    assert got == list(heapq.merge(*runs))[:stop]
    places = list(merged(runs, stop))
    assert all(p == sum(r == q for q, _ in places[:i]) for i, (r, p) in enumerate(places))


@given(st.binary(max_size=400), st.data())
def test_checksums(raw, data):
    cuts = sorted(data.draw(st.lists(st.integers(0, len(raw)), min_size=2, max_size=9)))
    a, b = np.array(cuts[:-1], np.int64), np.array(cuts[1:], np.int64)
    joined = np.frombuffer(raw or b"\0", np.uint8)
    assert crc32_of(joined, a, b).tolist() == [zlib.crc32(raw[x:y]) for x, y in zip(cuts, cuts[1:], strict=False)]
    assert crc32_of(joined, a, b, np.full(len(a), 77)).tolist() == [zlib.crc32(raw[x:y], 77) for x, y in zip(cuts, cuts[1:], strict=False)]


def plain(docs, target, percent, least_words, seed, buckets):
    def features(text):
        w = re.findall(rb"[0-9a-z\x80-\xff]+", re.sub(rb"[A-Z]", lambda m: m[0].lower(), (text or "").encode()))
        return len(w), [zlib.crc32(x) % buckets for x in [*w, *(a + b" " + b for a, b in zip(w, w[1:], strict=False))]]

    raw, goal = Counter(), Counter()
    for _, t in docs:
        raw.update(features(t)[1])
    for t in target:
        goal.update(features(t)[1])
    s_all, t_all = sum(raw.values()), sum(goal.values())
    gain = [math.floor(1000 * math.log((goal[b] + 1) * (s_all + buckets) / ((raw[b] + 1) * (t_all + buckets)))) for b in range(buckets)]
    rows = []
    for i, t in docs:
        n, f = features(t)
        w = math.floor(sum(gain[b] for b in f) / len(f)) if f else 0
        h = int(hashlib.sha256(f"{seed}:{'' if i is None else i}".encode()).hexdigest()[:8], 16)
        rows.append((i, len(f), w, w + math.floor(-1000 * math.log(-math.log((h + 0.5) / 2**32))), n >= least_words))
    may = sorted((r for r in rows if r[4]), key=lambda r: (-r[3], r[0] is None, r[0] or 0, r[1]))
    ranks = {}
    for k, r in enumerate(may[: percent * len(may) // 100]):
        ranks.setdefault(r[:4], []).append(k + 1)
    out = []
    for r in rows:
        left = ranks.get(r[:4]) if r[4] else None
        out.append((*r[:4], left.pop(0) if left else None))
    return sorted(out, key=repr)


WORDS = "The quick brown FOX jumps over ünïcode fields 2024 again and again".split()


@pytest.mark.parametrize("range_rows", [2, 1 << 15])
def test_draw_against_plain_version(spark, monkeypatch, range_rows):
    monkeypatch.setattr(importance, "RANGE_ROWS", range_rows)
    rng = np.random.default_rng(3)
    docs = [(int(i), " ".join(rng.choice(WORDS, rng.integers(0, 14)))) for i in range(150)]
    docs += [(7, "one and the same text " * 3)] * 60 + [(None, "no id here but words"), (None, None), (3, ""), (4, None), (900, "x" * 3000 + " y")]
    target = ["quick brown fox", "fields of unicode", None]
    df = spark.createDataFrame([(*d, 1, 2) for d in docs], "doc_id long, text string, score int, _range int").repartition(5)
    goal = spark.createDataFrame([(t, 1) for t in target], "text string, doc_id int")
    for percent in (0, 25, 100):
        got = importance.importance_resample(df, goal, percent, 3, 7, 50)
        assert got.columns == ["doc_id", "n_features", "weight", "score", "rank"]
        assert sorted((tuple(r) for r in got.collect()), key=repr) == plain(docs, target, percent, 3, 7, 50)


def test_draw_of_empty_tables(spark):
    none = spark.createDataFrame([], "doc_id long, text string")
    some = spark.createDataFrame([(1, "a b c")], "doc_id long, text string")
    assert importance.importance_resample(none, some).count() == 0
    assert importance.importance_resample(some, none, 100, 1).select("rank").collect()[0][0] == 1
    assert importance.importance_resample(some, none).where(F.col("rank").isNotNull()).count() == 0
