"""Operator 13 against a plain version, and the perfect hash."""

import re
from collections import Counter

import numpy as np
import pytest
from hypothesis import given
from hypothesis import strategies as st

from skerry.llm import collocations
from skerry.llm.perfect_hash import PerfectHash


@given(st.sets(st.tuples(*[st.integers(0, 2**64 - 1)] * 3), max_size=300), st.sets(st.tuples(*[st.integers(0, 2**64 - 1)] * 3), max_size=50))
def test_slots_are_dense_and_strangers_are_known(stored, others):
    keys = np.array(sorted(stored), np.uint64).reshape(-1, 3)
    found = PerfectHash(keys)
    assert sorted(found.find(keys).tolist()) == list(range(len(keys)))
    assert (found.keys[found.find(keys)] == keys).all()
    assert (found.find(np.array(sorted(others - stored), np.uint64).reshape(-1, 3)) == -1).all()


def plain(docs, least, top, inside_percent):
    f, n = Counter(), Counter()
    for lang, text in docs:
        lang = "und" if lang is None else lang
        for piece in re.split("[.,;:!?\n\x0b\x0c\r]", re.sub("[A-Z]", lambda m: m[0].lower(), text or "")):
            w = re.findall("[^ \t]+", piece)
            n[lang] += len(w)
            f.update((lang, *w[i : i + k]) for k in (1, 2, 3) for i in range(len(w) - k + 1))
    c = {p: a for p, a in f.items() if len(p) > 2 and a >= least}
    rows = {}
    for p, a in c.items():
        if any(q[0] == p[0] and p[1:] in (q[1:3], q[2:4]) and 100 * b >= inside_percent * a for q, b in c.items() if len(q) == 4 and len(p) == 3):
            continue
        cuts = [(1000000 * a * a // (f[p[: k + 1]] * f[(p[0], *p[k + 1 :])]), k) for k in range(1, len(p) - 1)]
        score, k = min(cuts)
        rows.setdefault(p[0], []).append((-score, -a, " ".join(p[1:]).encode(), f[p[: k + 1]], f[(p[0], *p[k + 1 :])]))
    return sorted((lang, i + 1, ph.decode(), -a, left, right, n[lang], -s) for lang, r in rows.items() for i, (s, a, ph, left, right) in enumerate(sorted(r)[:top]))


@pytest.mark.parametrize("segment", [3, 1 << 16])
def test_phrases_against_plain_version(spark, monkeypatch, segment):
    monkeypatch.setattr(collocations, "SEGMENT", segment)
    monkeypatch.setattr(collocations, "_BATCH", 400)
    rng = np.random.default_rng(5)
    vocab = ["New", "york", "city", "hall", "ünï", "a", "b", "a", "x\x01y", "the", "THE"]
    docs = [(["en", "de", None, "und"][int(rng.integers(4))], " ".join(str(w) + str(rng.choice(["", "", "", ".", "\n", "\t", ","])) for w in rng.choice(vocab, rng.integers(0, 40)))) for _ in range(120)]
    docs += [("en", None), (None, None), ("en", ""), ("fr", "x" * 5000)] + [("en", "new york city hall")] * 90
    df = spark.createDataFrame([(i, t, g, 1, "z") for i, (g, t) in enumerate(docs)], "doc_id long, text string, lang string, h1 int, key string").repartition(4)
    for least, top in ((10, 2000), (3, 7)):
        got = collocations.collocations(df, least, top)
        assert got.columns == ["lang", "rank", "phrase", "a", "l", "r", "n", "score"]
        assert sorted(tuple(r) for r in got.collect()) == plain(docs, least, top, 50)


def test_no_rows_and_no_phrases(spark):
    none = spark.createDataFrame([], "text string, lang string")
    assert collocations.collocations(none).count() == 0
    assert collocations.collocations(spark.createDataFrame([("one two", "en")], "text string, lang string")).count() == 0
