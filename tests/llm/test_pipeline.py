"""Each stage against a brute-force version on its own input."""

import zlib
from collections import defaultdict

import corpus_pipeline
import duckdb
import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from skerry.llm import mixing, quality
from skerry.llm.common import written

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def stages(spark):
    """Name -> (rows before, rows after, both stored)."""
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    out = {}
    for name, stage in corpus_pipeline.STAGES:
        after = written(stage(spark, docs, SF), name.replace(" ", "-"))
        if name != corpus_pipeline.STAGES[-1][0]:
            assert after.columns == docs.columns
        out[name] = (docs, after)
        docs = after
    return out


def gaussian_scores(x, y, to_pooled=0.2, to_identity=0.02):
    """Log density differences by solving with the covariances themselves, in the order of x's rows."""
    known = {c: np.array([v for v, k in zip(x, y, strict=True) if k == c]) for c in (0, 1)}
    cov = {c: np.cov(v.T, bias=True) for c, v in known.items()}
    n = {c: len(v) for c, v in known.items()}
    pooled = (n[0] * cov[0] + n[1] * cov[1]) / (n[0] + n[1])
    out = []
    for v in x:
        dens = []
        for c in (0, 1):
            s = (1 - to_identity) * ((1 - to_pooled) * cov[c] + to_pooled * pooled) + to_identity * np.diag(np.maximum(np.diag(pooled), 1e-6)) + 1e-6 * np.eye(len(v))
            d = v - known[c].mean(axis=0)
            dens.append(-0.5 * (d @ np.linalg.solve(s, d) + np.linalg.slogdet(s)[1]) + np.log(n[c]))
        out.append(dens[1] - dens[0])
    return np.array(out)


def learnable(doc_id):
    return zlib.crc32(str(doc_id).encode()) % 3 != 1


def test_quality_scores_by_brute_force(spark):
    rows = duckdb.sql(f"select d.doc_id, d.text, l.quality from '{SF}/documents.parquet' d left join '{SF}/labels.parquet' l using (doc_id) order by doc_id").fetchall()
    x = [np.array(quality.statistics(t or "")) for _, t, _ in rows]
    y = [q if q in (0, 1) and learnable(d) else None for d, _, q in rows]
    want = gaussian_scores(x, y)
    got = {r.doc_id: r for r in quality.op6_quality_classifier(spark, SF).collect()}
    for (d, _, _), w in zip(rows, want, strict=True):
        assert got[d].held_out == (not learnable(d)) and got[d].predicted == int(got[d].score >= 0.5)
        assert got[d].score == pytest.approx(1 / (1 + np.exp(-np.arcsinh(w))), abs=1e-6)


def test_quality_stage_keeps_what_scores_well(spark, stages):
    before, after = stages["quality classifier"]
    scores = {r.doc_id: r.score for r in quality.op6_quality_classifier(spark, SF).collect()}
    assert sorted(r.doc_id for r in after.collect()) == sorted(r.doc_id for r in before.collect() if scores[r.doc_id] >= 0.5)


def test_repeats_stage_by_brute_force(stages):
    before, after = stages["suffix-array dedup"]
    rows = {r.doc_id: (r.text or "").encode() for r in before.collect()}
    least: dict[bytes, int] = {}
    for doc, raw in rows.items():
        for i in range(len(raw) - 49):
            w = raw[i : i + 50]
            least[w] = min(doc, least.get(w, doc))
    for r in after.collect():
        raw, gone = rows[r.doc_id], bytearray(len(rows[r.doc_id]))
        for i in range(len(raw) - 49):
            if least[raw[i : i + 50]] < r.doc_id:
                gone[i : i + 50] = b"\1" * 50
        kept = bytes(b for b, g in zip(raw, gone, strict=True) if not g)
        assert len(r.text) == r.n_chars
        # a character cut in two becomes U+FFFD
        assert r.text.encode().replace("�".encode(), b"") == kept.decode("utf-8", "ignore").encode()


def test_mixing_stage_by_sql(stages):
    before, after = stages["source mixing"]
    con = duckdb.connect()
    docs = before.toPandas()
    con.register("docs", docs)
    rows = con.execute(f"WITH {mixing.mixing_sql('docs', 'doc_id, text')} SELECT doc_id, text, n_tokens, taken FROM mixed").fetchall()
    want = []
    for doc, text, n, taken in rows:
        words = (text or "").split()
        assert taken <= n == len(words) + 1
        want.append((doc, " ".join(words[:taken])))
    got = sorted((r.doc_id, " ".join((r.text or "").split())) for r in after.collect())
    assert got == sorted(want)


def test_packing_stage_by_the_library(stages):
    before, after = stages["best-fit packing"]
    library = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    library.encode_special_tokens = True
    want = defaultdict(list)
    for r in before.collect():
        want[r.doc_id].append(len(library.encode(r.text or "", add_special_tokens=False).ids) + 1)
    got, fill = defaultdict(list), defaultdict(list)
    for r in after.collect():
        got[r.doc_id].append(r.length)
        fill[r.sequence_id].append((r.offset, r.length))
    assert {d: sum(v) for d, v in got.items()} == {d: sum(v) for d, v in want.items()}
    for places in fill.values():
        at = 0
        for offset, length in sorted(places):
            assert offset == at
            at += length
        assert at <= 4096
    total = sum(sum(v) for v in want.values())
    assert len(fill) <= 1.02 * total / 4096 + 1


def test_near_dedup_keeps_one_of_each_class(stages):
    before, after = stages["SimHash and minima near-dedup"]
    kept, all_ = [r.doc_id for r in after.collect()], [r.doc_id for r in before.collect()]
    assert len(kept) == len(set(kept)) <= len(set(all_)) and min(all_) in kept
