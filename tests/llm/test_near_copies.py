import itertools

import corpus_pipeline
import numpy as np


def shingles(text):
    words = text.split()
    return {" ".join(words[i : i + 5]) for i in range(max(1, len(words) - 4))} if words else set()


def test_near_dedup_stage_by_brute_force(spark):
    """Copies with 1 to 20 words changed: similarities from under 0.6 to 1."""
    rng = np.random.default_rng(3)
    rows, at = [], 0
    for _ in range(60):
        base = rng.integers(0, 50000, 200)
        for changes in (0, 0, *rng.integers(1, 20, 5).tolist()):
            words = base.copy()
            words[rng.choice(200, changes, replace=False)] = rng.integers(50000, 100000, changes)
            rows.append((at, " ".join(f"w{w}" for w in words)))
            at += 1
    rows += [(at, ""), (at + 1, " "), (at + 2, "one"), (at + 3, "ONE")]
    sets = [shingles(t.lower()) for _, t in rows]
    root = list(range(len(rows)))
    levels = []
    for i, j in itertools.combinations(range(len(rows)), 2):
        union = len(sets[i] | sets[j])
        s = len(sets[i] & sets[j]) / union if union else 1
        if s >= 0.8:
            levels.append(s)
            a, b = sorted((root[i], root[j]))
            root = [a if r == b else r for r in root]
    assert sum(s < 0.85 for s in levels) > 20
    df = spark.createDataFrame(rows, "doc_id long, text string")
    kept = corpus_pipeline.near_dedup(spark, df, "")
    assert sorted(r.doc_id for r in kept.collect()) == sorted(set(root))
