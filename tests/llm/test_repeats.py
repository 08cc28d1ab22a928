import hashlib
import os
import uuid
from collections import defaultdict

import duckdb
import numpy as np
import pyarrow as pa
import pytest

from skerry.llm import repeats


def brute(rows, length=50):
    """(doc_id, n_bytes, n_removed, n_spans, kept) of (doc_id, text) rows; a null doc_id takes no part."""
    least = {}
    for doc, text in rows:
        raw = (text or "").encode()
        if doc is not None:
            for i in range(len(raw) - length + 1):
                w = raw[i : i + length]
                least[w] = min(doc, least.get(w, doc))
    out = []
    for doc, text in rows:
        raw = (text or "").encode()
        gone = bytearray(len(raw))
        if doc is not None:
            for i in range(len(raw) - length + 1):
                if least[raw[i : i + length]] < doc:
                    gone[i : i + length] = b"\1" * length
        spans = sum(1 for i in range(len(raw)) if gone[i] and not (i and gone[i - 1]))
        kept = bytes(b for b, g in zip(raw, gone, strict=True) if not g)
        out.append((doc, len(raw), sum(gone), spans, kept))
    return out


def digest(rows):
    return sorted(((d, n, r, s, hashlib.sha256(k).hexdigest()) for d, n, r, s, k in rows), key=repr)


def test_small_cases(spark):
    passage = "The quick brown fox jumps over the lazy dog while the band plays on and on. "
    texts = [
        (5, passage), (3, "x" + passage + "y"), (9, None), (4, ""), (7, "short"), (8, passage * 3), (8, passage + "tail"),
        (None, passage), (None, None), (10, "a" * 300), (11, "b" + "a" * 200 + "c" + passage[:49]), (12, "é" * 40 + passage), (13, "é" * 40 + "ü" + passage[1:51]),
        (14, "\0" * 120), (15, "\0" * 60 + "z"), (16, passage[10:60]), (16, passage[10:60]),
    ]
    df = spark.createDataFrame([(d, t, "web", 1) for d, t in texts], "doc_id long, text string, _row string, _group int")
    got = repeats.remove_repeats(df)
    assert got.columns == ["doc_id", "text", "_row", "_group", "repeat_kept", "repeat_spans", "repeat_bytes"]
    rows = got.collect()
    assert all(r["_row"] == "web" and r["_group"] == 1 for r in rows)
    have = [(r.doc_id, r.repeat_bytes, r.repeat_bytes - len(r.repeat_kept), len(r.repeat_spans), bytes(r.repeat_kept)) for r in rows]
    assert digest(have) == digest(brute(texts))
    null = [r for r in rows if r.doc_id == 9]
    assert null[0].text is None
    assert repeats.remove_repeats(df.limit(0)).count() == 0


@pytest.mark.parametrize("hot", [repeats.HOT, 3])
def test_table(spark, monkeypatch, hot):
    monkeypatch.setattr(repeats, "HOT", hot)
    monkeypatch.setattr(repeats, "SORT_BYTES", 20_000)
    path = "/root/testdata/sf0.001/documents.parquet"
    rows = duckdb.sql(f"select doc_id, text from '{path}'").fetchall()
    got = repeats.remove_repeats(spark.read.parquet(path).select("doc_id", "text")).collect()
    have = [(r.doc_id, r.repeat_bytes, r.repeat_bytes - len(r.repeat_kept), len(r.repeat_spans), bytes(r.repeat_kept)) for r in got]
    assert digest(have) == digest(brute(rows))


def test_hot_passage_speaks_once_a_group(spark, monkeypatch):
    """500 documents of one passage, each in words of its own: a group gives each of its windows once."""
    monkeypatch.setattr(repeats, "HOT", 3)
    passage = "licensed under terms that all of the documents repeat "
    texts = [(d, hashlib.sha256(b"a%d" % d).hexdigest() + passage + hashlib.sha256(b"b%d" % d).hexdigest()) for d in range(500)]
    whole = pa.table({"_group": pa.array([0] * 500, pa.int32()), "_row": list(range(500)), "_doc": [d for d, _ in texts], "_bytes": [t.encode() for _, t in texts]})
    n = len(repeats._group(whole)[4][0])
    chosen = pa.table({"_group": pa.array([0], pa.int32()), "kind": [bytes([1]) * n], "at": [(np.arange(n, dtype=np.uint32) | repeats._IS_HOT).tobytes()]})
    given = repeats._give_segments(50)(whole, chosen).to_pylist()
    said = [r["text"] for r in given if r["text"] is not None]
    assert len(said) == len(set(said)) and any(t in passage.encode() for t in said)
    df = spark.createDataFrame(texts, "doc_id long, text string")
    have = [(r.doc_id, r.repeat_bytes, r.repeat_bytes - len(r.repeat_kept), len(r.repeat_spans), bytes(r.repeat_kept)) for r in repeats.remove_repeats(df).collect()]
    assert digest(have) == digest(brute(texts))


def test_line_in_many_surroundings_meets_evenly(spark, monkeypatch, tmp_path):
    """One 60-byte line in 20,000 different surroundings: it goes from all but the first, and no task gets much more than another."""
    line = "all rights are reserved by those that hold rights, say these."[:60]
    texts = [(d, f"{hashlib.sha256(b'a%d' % d).hexdigest()}{line}{hashlib.sha256(b'b%d' % d).hexdigest()}") for d in range(20_000)]
    decide, folder = repeats._decide, str(tmp_path)

    def counted(length):
        run = decide(length)

        def count(batches):
            n = 0

            def seen():
                nonlocal n
                for b in batches:
                    n += b.num_rows
                    yield b

            yield from run(seen())
            open(f"{folder}/{uuid.uuid4().hex}-{n}", "w").close()

        return count

    monkeypatch.setattr(repeats, "_decide", counted)
    df = spark.createDataFrame(texts, "doc_id long, text string").repartition(8)
    got = {r.doc_id: r for r in repeats.remove_repeats(df).select("doc_id", "repeat_kept", "repeat_spans").collect()}
    assert len(got) == len(texts) and not got[0].repeat_spans
    for d, t in texts[1:]:
        (span,) = got[d].repeat_spans
        # the surroundings may share a character or two with an earlier document's
        assert span.start <= 64 and span.end >= 124 and span.end - span.start < 75
    sizes = sorted(int(f.rsplit("-")[-1]) for f in os.listdir(folder))
    assert sizes[-1] < 2 * sizes[len(sizes) // 2], sizes


@pytest.mark.parametrize("owner", [1, 100])
@pytest.mark.parametrize(("hot", "times"), [(400, 500), (3, 9)])
def test_key_that_is_hot_in_one_group_only(spark, monkeypatch, owner, hot, times):
    """A document of many like lines, and others that hold the line once: equal windows meet, whichever comes first."""
    monkeypatch.setattr(repeats, "HOT", hot)
    line = "2024-01-01 12:00:00 INFO worker started with the usual settings and nothing else to report"
    assert len(line) == 90
    noise = lambda k: hashlib.sha256(b"%d" % k).hexdigest()[:40]
    texts = [(owner, "".join(noise(k) + line for k in range(times)))] + [(10 + d, f"document {d} has {noise(9000 + d)} {line} {noise(9900 + d)} end") for d in range(6)]
    df = spark.createDataFrame(texts, "doc_id long, text string").repartition(4)
    have = [(r.doc_id, r.repeat_bytes, r.repeat_bytes - len(r.repeat_kept), len(r.repeat_spans), bytes(r.repeat_kept)) for r in repeats.remove_repeats(df).collect()]
    assert digest(have) == digest(brute(texts))


def test_random_lines_in_random_documents(spark, monkeypatch):
    """Lines over few letters dealt over documents of one and of hundreds of lines, with a low mark for hot keys."""
    monkeypatch.setattr(repeats, "HOT", 5)
    for seed in range(3):
        rng = np.random.default_rng(seed)
        lines = ["".join(rng.choice(list("ab "), rng.integers(20, 90))) for _ in range(25)]
        texts = [(int(d), "\n".join(lines[i] for i in rng.integers(0, 25, int(rng.choice([1, 2, 3, 60]))))) for d in rng.permutation(30)]
        df = spark.createDataFrame(texts, "doc_id long, text string").repartition(3)
        have = [(r.doc_id, r.repeat_bytes, r.repeat_bytes - len(r.repeat_kept), len(r.repeat_spans), bytes(r.repeat_kept)) for r in repeats.remove_repeats(df).collect()]
        assert digest(have) == digest(brute(texts)), seed
