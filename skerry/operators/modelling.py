"""Models over rows: nested choice of settings, scores of every row, dealing values anew, and Shapley values.

A task is a text; rows carry the task that trains or tests them. Models are stored as rows of a table (JSON), so that a
later step, or another session, has them from the table alone. The models of all tasks (as many as the task table has
rows, which the caller states) go with the scoring function to the executors.
"""

from __future__ import annotations

import json
import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from skerry.operators import ranking, trees
from skerry.operators.trees import Bins, Model, Spec, Tree, fit
from skerry.sources.tables import union_by_name, written

#: Steps of a score where settings are compared and importance is measured; metrics that are reported use scores as they are.
SLOTS = 1024


def variance_inflation(corr: np.ndarray, limit: float = 10.0) -> list[int]:
    """Columns left when the one of the greatest variance inflation goes until none reaches the limit."""
    keep = list(range(len(corr)))
    while len(keep) > 1:
        inverse = np.diag(np.linalg.pinv(np.nan_to_num(corr[np.ix_(keep, keep)]) + 1e-10 * np.eye(len(keep))))
        v = 1 / (1 / np.maximum(inverse, 1) + 1e-8)
        if v.max() < limit:
            break
        keep.pop(int(v.argmax()))
    return keep


def correlations(rows: DataFrame, keys: list[str], features: list[str]) -> dict[tuple, np.ndarray]:
    """Pearson's correlations of all pairs of features by group, from one pass; not finite ones are 0."""
    pairs = [(i, j) for i in range(len(features)) for j in range(i + 1, len(features))]
    found = rows.groupBy(*keys).agg(F.count("*").alias("n"), *[F.corr(features[i], features[j]) for i, j in pairs]).collect()
    out = {}
    for r in found:
        c = np.eye(len(features))
        for (i, j), v in zip(pairs, list(r)[len(keys) + 1 :], strict=True):
            c[i, j] = c[j, i] = v if v is not None and math.isfinite(v) else 0.0
        out[tuple(r)[: len(keys)]] = c
    return out


def slot_counts(passes: trees.Passes, models: dict[str, Model], candidates: dict[str, list[dict]]) -> DataFrame:
    """name, nth, score (a slot), pos, neg: labels by score of each candidate's model on the inner fold that it left out.

    ``candidates``: for each model the settings (fewer trees or levels) that it answers for, with ``nth``. Trees score rows
    of the same bins at once, hinges equal rows.
    """
    bins = passes.bins
    features = list(bins.cuts)
    schema = "name string, nth int, score double, pos long, neg long"

    def add(kept: dict, names: list[str], y, n, x, b=None) -> None:
        for name in names:
            for (nth, _), score in zip(candidates[name], models[name].scores(x, [s for _, s in candidates[name]], b), strict=True):
                slot = np.rint(score * SLOTS).astype(np.int64)
                counts = kept.setdefault((name, nth), np.zeros((2, SLOTS + 1), np.int64))
                counts += np.stack([np.bincount(slot[y == k], n[y == k], minlength=SLOTS + 1) for k in (1, 0)]).astype(np.int64)

    def give(kept: dict) -> Iterator[pa.RecordBatch]:
        for (name, nth), c in kept.items():
            at = np.flatnonzero(c.sum(axis=0))
            yield pa.RecordBatch.from_pandas(pd.DataFrame({"name": name, "nth": np.full(len(at), nth, np.int32), "score": at / SLOTS, "pos": c[0, at], "neg": c[1, at]}), preserve_index=False)

    def alike(hinges: bool) -> dict[tuple, list[str]]:
        out: dict[tuple, list[str]] = {}
        for name, m in models.items():
            if (m.spec.algo == "hinges") == hinges:
                out.setdefault((m.spec.task, m.spec.without, m.spec.columns), []).append(name)
        return out

    trees_, hinges_ = alike(False), alike(True)

    def by_bins(parts) -> Iterator[pa.RecordBatch]:
        kept: dict[tuple, np.ndarray] = {}
        for task, c in parts:
            for (t, without, columns), names in trees_.items():
                if t == task and (c.inner == without).any():
                    own = trees.Cells(*[v[c.inner == without] for v in (c.y, c.inner, c.bins, c.n, c.drawn)]).of(None, [features.index(f) for f in columns])
                    add(kept, names, own.y, own.n, trees.values_of(bins, columns, own.bins))
        yield from give(kept)

    def by_values(parts) -> Iterator[pa.RecordBatch]:
        kept: dict[tuple, np.ndarray] = {}
        for task, inner, y, n, x in parts:
            for (t, without, columns), names in hinges_.items():
                if (t, without) == (task, inner):
                    own = trees.runs(y, n, x[:, [features.index(f) for f in columns]])
                    add(kept, names, *own, trees.basis(own[2], columns, bins))
        yield from give(kept)

    found = []
    if trees_:
        found.append(trees.per_cells(passes.cells([])[1], features, by_bins, schema, shares=passes.shares))
    if hinges_:
        found.append(trees.per_values(passes.values(), features, by_values, schema, passes.shares))
    out = union_by_name(found) if found else passes.rows.sparkSession.createDataFrame([], schema)
    return written(out.groupBy("name", "nth", "score").agg(F.sum("pos").alias("pos"), F.sum("neg").alias("neg")), "slots")


def nested_choice(rows: DataFrame, tasks: dict[str, Spec], grids: dict[str, list[dict]], bins: Bins, folds: int, seed: int = 42, passes: trees.Passes | None = None) -> dict[str, tuple[dict, float]]:
    """Settings and threshold of each task: the greatest mean AUC over inner folds, the first of equals, and the threshold of
    the greatest TPR - FPR over a second pass of all inner folds with another seed; 0.5 where there is none.

    Candidates that differ in trees or levels of a forest, or in rounds, are read off one model. ``tasks``: a spec without settings.
    """
    specs: dict[str, Spec] = {}
    answers: dict[str, list[tuple[int, dict]]] = {}
    for name, s in tasks.items():
        for nth, settings in enumerate(grids[s.algo]):
            largest = _grown(s.algo, settings, grids[s.algo])
            for k in range(folds):
                model = json.dumps([name, k, largest], sort_keys=True)
                specs[model] = Spec(s.task, s.columns, s.algo, largest, k, seed)
                answers.setdefault(model, []).append((nth, settings))
    passes = passes or trees.Passes(rows, bins, trees.near_of(specs, bins))
    grown = fit(rows, specs, bins, passes=passes)
    counts = slot_counts(passes, grown, answers)
    each = ranking.auc(counts, ["name", "nth"]).where("auc IS NOT NULL").collect()
    by: dict[tuple[str, int], list[float]] = {}
    for r in sorted(each, key=lambda r: r.name):
        by.setdefault((json.loads(r["name"])[0], r.nth), []).append(r.auc)
    chosen = {}
    for name, s in tasks.items():
        mean = [round(float(np.mean(by[name, i])), 9) if (name, i) in by else -1.0 for i in range(len(grids[s.algo]))]
        chosen[name] = grids[s.algo][int(np.argmax(mean))]
    again = {json.dumps([n, k]): Spec(s.task, s.columns, s.algo, chosen[n], k, seed + 10_000) for n, s in tasks.items() for k in range(folds)}
    second = fit(rows, {n: s for n, s in again.items() if s.algo == "forest"}, bins, passes=passes)
    for name, s in again.items():  # the others draw nothing: another seed gives the same model
        model = json.dumps([*json.loads(name), _grown(s.algo, s.settings, grids[s.algo])], sort_keys=True)
        if s.algo != "forest" and model in grown:
            second[name] = grown[model]
    pooled = slot_counts(passes, second, {n: [(0, s.settings)] for n, s in again.items()})
    pooled = pooled.groupBy(F.get_json_object("name", "$[0]").alias("name"), "score").agg(F.sum("pos").alias("pos"), F.sum("neg").alias("neg"))
    cuts = {r["name"]: r.threshold for r in ranking.youden(ranking.curve(pooled, ["name"]), ["name"]).collect()}
    return {n: (chosen[n], float(cuts.get(n, 0.5))) for n in tasks}


def _grown(algo: str, settings: dict, grid: list[dict]) -> dict:
    """The largest settings from whose model those of ``settings`` can be read."""
    if algo == "forest":
        like = [s for s in grid if s["min_leaf"] == settings["min_leaf"]]
        return {**settings, "trees": max(s["trees"] for s in like), "depth": max(s["depth"] for s in like)}
    if algo == "boosting":
        return {**settings, "rounds": max(s["rounds"] for s in grid if (s["depth"], s["rate"]) == (settings["depth"], settings["rate"]))}
    return settings


def predict(rows: DataFrame, models: dict[str, Model], extra: str = "") -> DataFrame:
    """task, id, label, the columns of ``extra`` (a schema) and suit of every row whose task has a model; ``rows`` has the features."""
    names = [c.split()[0] for c in extra.split(", ")] if extra else []

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            for task, part in f.groupby("task"):
                if task in models:
                    m = models[task]
                    yield part[["task", "id", "label", *names]].assign(suit=m.predict(part[list(m.spec.columns)].to_numpy(float)))

    return rows.mapInPandas(run, f"task string, id {dict(rows.dtypes)['id']}, label int, " + (extra + ", " if extra else "") + "suit double")


def _each_score(batch: pa.RecordBatch, at: int, features: list[str], models: dict[str, Model], tested: dict[int, list[str]]) -> np.ndarray:
    """(row, model): scores of the rows of a batch (fold at ``at``, features behind it) under the models that test their fold; NaN without one."""
    fold = batch.column(at).to_numpy()
    x = np.column_stack([batch.column(at + 1 + j).to_numpy() for j in range(len(features))])
    out = np.full((batch.num_rows, max(map(len, tested.values()), default=0)), np.nan)
    for k, names in tested.items():
        own = np.flatnonzero(fold == k)
        for i, name in enumerate(names):
            if name in models and len(own):
                out[own, i] = models[name].predict(x[np.ix_(own, [features.index(c) for c in models[name].spec.columns])])
    return out


def predict_each(rows: DataFrame, features: list[str], models: dict[str, Model], tested: dict[int, list[str]], keep: list[str]) -> DataFrame:
    """The columns ``keep``, fold and suit_0, suit_1 .. of every row, read once: its scores under the models that ``tested`` names for its fold; null without one."""
    n = max(map(len, tested.values()), default=0)
    names = [*keep, "fold", *[f"suit_{i}" for i in range(n)]]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                s = _each_score(batch, len(keep), features, models, tested)
                yield pa.RecordBatch.from_arrays([*batch.columns[: len(keep) + 1], *[pa.array(s[:, i], pa.float64(), from_pandas=True) for i in range(n)]], names)

    kinds = dict(rows.dtypes)
    schema = ", ".join([*[f"{c} {kinds[c]}" for c in [*keep, "fold"]], *[f"suit_{i} double" for i in range(n)]])
    return rows.select(*keep, "fold", *features).mapInArrow(run, schema)


def counts_each(rows: DataFrame, features: list[str], models: dict[str, Model], tested: dict[int, list[str]]) -> DataFrame:
    """task, score, pos, neg: labels by score of every row under each model that tests its fold. Equal rows are scored once."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for held in trees._held(batches, trees.HELD):
            batch = held.to_batches()[0]
            y, n, s = batch.column(0).to_numpy(), batch.column(1).to_numpy(), _each_score(batch, 2, features, models, tested)
            fold = batch.column(2).to_numpy()
            for k, names in tested.items():
                for i, name in enumerate(names):
                    use = (fold == k) & ~np.isnan(s[:, i])
                    score, kind = np.unique(s[use, i], return_inverse=True)
                    if len(score):
                        pos, neg = (np.bincount(kind, n[use] * (y[use] == v), len(score)).astype(np.int64) for v in (1, 0))
                        yield pa.RecordBatch.from_arrays([pa.DictionaryArray.from_arrays(np.zeros(len(score), np.int32), [name]).cast(pa.string()), pa.array(score), pa.array(pos), pa.array(neg)], ["task", "score", "pos", "neg"])

    equal = rows.where(F.col("label").isin(0, 1)).groupBy("label", "fold", *features).agg(F.count("*").alias("n")).select("label", "n", "fold", *features)
    found = equal.mapInArrow(run, "task string, score double, pos long, neg long")
    return written(found.groupBy("task", "score").agg(F.sum("pos").alias("pos"), F.sum("neg").alias("neg")), "scores")


#: Primes above any number of rows that a task may have: each makes i -> (prime * i + draw) mod n a permutation.
def strides(draws: int, seed: int) -> list[int]:
    """Different primes above 2 ** 31 for the draws of a seed, by trial division."""
    out: list[int] = []
    x = 2**31 + 1 + 2 * 100_003 * (seed % 1000)
    while len(out) < draws:
        if all(x % p for p in range(3, math.isqrt(x) + 1, 2)):
            out.append(x)
            x += 2 * 7919
        x += 2
    return out


def numbered(rows: DataFrame, seed: int) -> DataFrame:
    """Adds ``nth``, the number of a row within its task in the order of a hash of its id, and ``_all``, the task's rows.

    Hashes are spread evenly: rows go into 1,024 ranges of them, whose counts are summed first; one range of one task is ordered at a time.
    """
    u = F.conv(F.substring(F.md5(F.concat_ws(":", F.lit(str(seed)), F.col("id"))), 1, 12), 16, 10).cast("long")
    hashed = rows.withColumn("_u", u).withColumn("_b", F.shiftright("_u", 38))
    counts = hashed.groupBy("task", "_b").agg(F.count("*").alias("_n"))
    before = Window.partitionBy("task").orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)
    starts = counts.select("task", "_b", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_less"), F.sum("_n").over(Window.partitionBy("task")).alias("_all"))
    nth = F.row_number().over(Window.partitionBy("task", "_b").orderBy("_u", "id")) - 1
    return hashed.join(starts, ["task", "_b"]).withColumn("nth", F.col("_less") + nth).drop("_u", "_b", "_less")


def dealt_counts(rows: DataFrame, feature: str, draws: int, seed: int) -> DataFrame:
    """task, draw (0: as they are), score, pos, neg: labels by the value that a row gets in a draw of ``dealt_values``.

    A stride that shares no factor with the task's rows gives each value to one row: only the rows of label 1 then look
    theirs up, and the others are what is left of the value's rows. Neither side is broadcast: stored files are far smaller
    than their rows.
    """
    steps = strides(draws, seed)
    stored = written(numbered(rows, seed).select("task", "nth", "_all", "label", F.col(feature).alias("score")), "numbered")
    draw = F.explode(F.array(*[F.struct(F.lit(k).alias("draw"), F.lit(p).alias("step")) for k, p in enumerate(steps, 1)]))
    once = F.col("_all") % F.col("step") != 0
    asked = stored.withColumn("_d", draw).select("task", "nth", "_all", "label", "_d.*").where((F.col("label") == 1) | ~once)
    asked = asked.select("task", "draw", "label", once.alias("once"), ((F.col("step") * F.col("nth") + F.col("draw")) % F.col("_all")).alias("nth"))
    got = asked.join(stored.select("task", "nth", "score").hint("merge"), ["task", "nth"])
    counted = written(got.groupBy("task", "draw", "score").agg(F.count_if(F.col("label") == 1).alias("pos"), F.count_if(F.col("label") == 0).alias("neg")), "dealt")
    held = stored.groupBy("task", "_all", "score").agg(F.count_if(F.col("label") == 1).alias("pos"), F.count_if(F.col("label") == 0).alias("neg"))
    every = held.withColumn("_d", draw).where(F.col("_all") % F.col("_d.step") != 0).select("task", F.col("_d.draw").alias("draw"), "score", F.lit(0).cast("long").alias("pos"), F.lit(0).cast("long").alias("neg"), (F.col("pos") + F.col("neg")).alias("rest"))
    both = counted.withColumn("rest", F.lit(0).cast("long")).unionByName(every).groupBy("task", "draw", "score").agg(F.sum("pos").alias("pos"), F.sum("neg").alias("neg"), F.sum("rest").alias("rest"))
    dealt = both.select("task", "draw", "score", "pos", F.when(F.col("rest") > 0, F.col("rest") - F.col("pos")).otherwise(F.col("neg")).alias("neg"))
    return dealt.unionByName(held.select("task", F.lit(0).alias("draw"), "score", "pos", "neg")).where(F.col("score").isNotNull() & ~F.isnan("score"))


def dealt_values(rows: DataFrame, features: list[str], draws: int, seed: int) -> DataFrame:
    """task, id, label, draw, the features, and the features ``o_*`` of the row whose values it gets in each draw.

    Rows of a task are numbered by a hash of their id (``nth``, exactly and without ordering a task as a whole); in a draw
    row i gets the values of row (prime * i + draw) mod n. Results hang on ids and seed alone.
    """
    held = numbered(rows, seed)
    steps = F.array(*[F.lit(p) for p in strides(draws, seed)])
    each = held.withColumn("draw", F.explode(F.sequence(F.lit(1), F.lit(draws))))
    each = each.withColumn("_from", (F.element_at(steps, F.col("draw")) * F.col("nth") + F.col("draw")) % F.col("_all"))
    values = held.select(F.col("task").alias("_t"), F.col("nth").alias("_f"), *[F.col(c).alias(f"o_{c}") for c in features])
    return each.join(values.hint("merge"), (F.col("task") == F.col("_t")) & (F.col("_from") == F.col("_f"))).select("task", "id", "label", "draw", "nth", *features, *[f"o_{c}" for c in features])


def _dealt_by_rows(rows: DataFrame, models: dict[str, Model], features: list[str], groups: dict[str, list[str]], draws: int, seed: int) -> DataFrame:
    """``dealt_scores`` by a join of rows and draws, whatever the models and the rows of a task."""

    def counted(task, grp, draw, m, x, y):
        slot = np.rint(m.predict(x) * SLOTS).astype(np.int64)
        both = pd.DataFrame({"draw": draw, "score": slot, "pos": (y == 1).astype(np.int64), "neg": (y == 0).astype(np.int64)}).groupby(["draw", "score"], as_index=False).sum()
        return both.assign(task=task, grp=grp, score=both["score"] / SLOTS)[["task", "grp", "draw", "score", "pos", "neg"]]

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            for task, part in f.groupby("task"):
                if (m := models.get(task)) is None:
                    continue
                columns = list(m.spec.columns)
                x, other, y = part[columns].to_numpy(float), part[[f"o_{c}" for c in columns]].to_numpy(float), part["label"].to_numpy()
                first = part["draw"].to_numpy() == 1
                yield counted(task, "", np.zeros(int(first.sum()), int), m, x[first], y[first])
                for name, members in groups.items():
                    if at := [columns.index(c) for c in members if c in columns]:
                        z = x.copy()
                        z[:, at] = other[:, at]
                        yield counted(task, name, part["draw"].to_numpy(), m, z, y)

    out = dealt_values(rows, features, draws, seed).mapInPandas(run, "task string, grp string, draw int, score double, pos long, neg long")
    return out.groupBy("task", "grp", "draw", "score").agg(F.sum("pos").alias("pos"), F.sum("neg").alias("neg"))


#: Rows of a block of a task, draws that go through a task of Spark together, and places of a forest's table of scores.
BLOCK, CHUNK, GRID = 1 << 17, 10, 1 << 23


def dealt_scores(rows: DataFrame, models: dict[str, Model], features: list[str], groups: dict[str, list[str]], draws: int, seed: int) -> DataFrame:
    """task, grp, draw (0: as they are), score (a slot), pos, neg: labels by score when a group of features is dealt anew.

    Rows get values as in ``dealt_values``, without a row for each draw: a forest sees no more of a row than its place in a
    table of scores, and blocks of ``BLOCK`` rows send each other the places that they deal out, as arrays in bytes, in the
    order in which the other block's rows take them. Both know that order from the numbers alone.
    """
    held = written(numbered(rows.where(F.col("task").isin(*models)), seed).select("task", "nth", "_all", "label", *[F.col(f).cast("double") for f in features]), "numbered")
    sizes = held.groupBy("task").agg(F.first("_all").alias("n")).collect()
    models = {r.task: models[r.task] for r in sizes}  # of those that have rows
    grids = {n: trees.Grid.of(m, GRID) for n, m in models.items()}
    if any(g is None for g in grids.values()) or any(r.n >= 2**31 for r in sizes):
        return _dealt_by_rows(rows, models, features, groups, draws, seed)
    steps = strides(draws, seed)
    tables = {n: np.rint(g.table.ravel() * SLOTS).astype(np.int16) for n, g in grids.items()}
    members = {n: {k: at for k, of in groups.items() if (at := [m.spec.columns.index(c) for c in of if c in m.spec.columns])} for n, m in models.items()}
    width = {n: max(1, (int(g.table.size).bit_length() + 7) // 8) for n, g in grids.items()}
    chunks = [list(range(a, min(a + CHUNK, draws + 1))) for a in range(1, draws + 1, CHUNK)]

    def narrow(codes: np.ndarray, w: int) -> np.ndarray:
        return codes.astype("<u4").view(np.uint8).reshape(-1, 4)[:, :w]

    def wide(raw: bytes, w: int) -> np.ndarray:
        out = np.zeros((len(raw) // w, 4), np.uint8)
        out[:, :w] = np.frombuffer(raw, np.uint8).reshape(-1, w)
        return out.view("<u4").ravel().astype(np.int64)

    def send(table: pa.Table) -> pa.Table:
        task, block, n = table.column("task")[0].as_py(), table.column("block")[0].as_py(), table.column("_all")[0].as_py()
        nth, y = table.column("nth").to_numpy(), table.column("label").to_numpy()
        order = np.argsort(nth)
        x = np.column_stack([table.column(c).to_numpy() for c in models[task].spec.columns]).astype(float)[order]
        nth, y, codes = nth[order], np.where(np.isin(y, (0, 1)), y, 2)[order].astype(np.uint8), narrow(grids[task].codes(x), width[task])
        ends = np.arange(0, n + BLOCK, BLOCK)
        out = []
        for i, chunk in enumerate(chunks):
            out.append((block, i, -1, codes.tobytes() + y.tobytes()))
            parts: list[list[bytes]] = [[] for _ in ends[1:]]
            for draw in chunk:
                to = pow(steps[draw - 1], -1, n) * ((nth - draw) % n) % n if n > 1 else np.zeros(len(nth), np.int64)
                order = np.argsort(to)
                at, dealt = np.searchsorted(to[order], ends), codes[order]
                for k, part in enumerate(parts):
                    part.append(dealt[at[k] : at[k + 1]].tobytes())
            out += [(k, i, block, b"".join(part)) for k, part in enumerate(parts)]
        to, chunk, source, data = zip(*out, strict=True)
        return pa.table({"task": pa.array([task] * len(out), pa.string()), "n": pa.array([n] * len(out), pa.int64()), "block": pa.array(to, pa.int32()), "chunk": pa.array(chunk, pa.int32()), "source": pa.array(source, pa.int32()), "data": pa.array(data, pa.binary())})

    def take(table: pa.Table) -> pa.Table:
        task, n, block, chunk = (table.column(c)[0].as_py() for c in ("task", "n", "block", "chunk"))
        w, grid, slots = width[task], grids[task], tables[task]
        got = dict(zip(table.column("source").to_pylist(), table.column("data").to_pylist(), strict=True))
        own = got.pop(-1)
        m = len(own) // (w + 1)
        codes, y = wide(own[: m * w], w), np.frombuffer(own, np.uint8, m, m * w).astype(np.int64)
        used, out = dict.fromkeys(got, 0), []

        def count(grp: str, draw: int, places: np.ndarray) -> None:
            both = np.bincount(slots[places].astype(np.int64) * 3 + y, minlength=3 * SLOTS + 3).reshape(-1, 3)
            at = np.flatnonzero(both[:, :2].sum(axis=1))
            out.append((np.full(len(at), draw, np.int32), at / SLOTS, both[at, 1], both[at, 0], [grp] * len(at)))

        if chunk == 0:
            count("", 0, codes)
        rest = {grp: codes - grid.share(codes, at) for grp, at in members[task].items()}
        nth = np.arange(block * BLOCK, block * BLOCK + m)
        for draw in chunks[chunk]:
            source = (steps[draw - 1] % n * nth + draw) % n // BLOCK
            parts, each = [], np.bincount(source)
            for k in np.flatnonzero(each):
                size = int(each[k]) * w
                parts.append(got[int(k)][used[int(k)] : used[int(k)] + size])
                used[int(k)] += size
            dealt = np.empty(m, np.int64)
            dealt[np.argsort(source.astype(np.int32), kind="stable")] = wide(b"".join(parts), w)
            for grp, at in members[task].items():
                count(grp, draw, rest[grp] + grid.share(dealt, at))
        draw, score, pos, neg = (np.concatenate([o[i] for o in out]) if out else np.zeros(0) for i in range(4))
        grp = [g for o in out for g in o[4]]
        return pa.table({"task": pa.array([task] * len(grp), pa.string()), "grp": pa.array(grp, pa.string()), "draw": pa.array(draw, pa.int32()), "score": pa.array(score, pa.float64()), "pos": pa.array(pos, pa.int64()), "neg": pa.array(neg, pa.int64())})

    # each block is work of its own: as many tasks of Spark as that, not as few as its bytes ask for
    parts = max(1, min(sum(-(-r.n // BLOCK) for r in sizes), 16 * rows.sparkSession.sparkContext.defaultParallelism))
    blocks = held.withColumn("block", F.floor(F.col("nth") / BLOCK).cast("int")).repartition(parts, "task", "block")
    sent = blocks.groupBy("task", "block").applyInArrow(send, "task string, n long, block int, chunk int, source int, data binary")
    taken = sent.repartition(4 * parts, "task", "block", "chunk").groupBy("task", "block", "chunk").applyInArrow(take, "task string, grp string, draw int, score double, pos long, neg long")
    return written(taken.groupBy("task", "grp", "draw", "score").agg(F.sum("pos").alias("pos"), F.sum("neg").alias("neg")), "dealt")


def _leaves(tree: Tree) -> Iterator[tuple[float, list[tuple[int, float, bool, float]]]]:
    """Value and path of each leaf: (feature, cut, whether the path goes low, share of the weight that goes there)."""
    todo: list[tuple[int, list]] = [(0, [])]
    while todo:
        at, path = todo.pop()
        f = int(tree.feature[at])
        if f < 0:
            yield float(tree.value[at]), path
            continue
        for child, low in ((2 * at + 1, True), (2 * at + 2, False)):
            todo.append((child, [*path, (f, float(tree.cut[at]), low, float(tree.weight[child] / tree.weight[at]))]))


def tree_shapley(tree: Tree, x: np.ndarray) -> np.ndarray:
    """(rows, features): Shapley values of a tree's value, where absent features follow the weight of the branches.

    A leaf's value counts by the product over its features of 1 or 0 (present: the row goes that way, or not) and of the
    branches' shares (absent). The weights of all sets of m features are the coefficients of a product of m terms, so a
    leaf costs m squared steps a feature, not 2 ** m. What a leaf gives hangs on which of its features the row goes along
    with: where rows are more than such patterns, patterns are worked out once and rows look theirs up.
    """
    out, columns = np.zeros(x.shape[::-1]), np.ascontiguousarray(x.T)
    below: dict[tuple[int, float], np.ndarray] = {}
    for value, path in _leaves(tree):
        one: dict[int, np.ndarray] = {}
        zero: dict[int, float] = {}
        for f, cut, low, share in path:
            if (f, cut) not in below:
                below[f, cut] = columns[f] <= cut
            went = below[f, cut] if low else ~below[f, cut]
            one[f] = one[f] & went if f in one else went
            zero[f] = zero.get(f, 1.0) * share
        m = len(one)
        if 2**m >= len(x) or m > 8:
            for f, v in zip(one, _leaf_values(list(one.values()), list(zero.values())), strict=True):
                out[f] += value * v
            continue
        pattern = np.zeros(len(x), np.uint8)
        for i, went in enumerate(one.values()):
            pattern |= went.view(np.uint8) << np.uint8(i)
        bits = [(np.arange(2**m) >> i & 1).astype(bool) for i in range(m)]
        for f, v in zip(one, _leaf_values(bits, list(zero.values())), strict=True):
            out[f] += np.take(value * v, pattern)
    return out.T


def _leaf_values(one: list[np.ndarray], zero: list[float]) -> list[np.ndarray]:
    """For each feature of a leaf its Shapley value of a leaf of value 1. ``one``: whether rows go along with a feature; ``zero``: its share."""
    m = len(one)
    weight = [math.factorial(k) * math.factorial(m - 1 - k) / math.factorial(m) for k in range(m)]
    out = []
    for i in range(m):
        terms = [np.ones(len(one[i]))]  # by how many of the others are present
        for j in range(m):
            if j == i:
                continue
            on, off = one[j].astype(float), zero[j]
            terms = [(terms[k] * off if k < len(terms) else 0) + (terms[k - 1] * on if k else 0) for k in range(len(terms) + 1)]
        out.append((one[i] - zero[i]) * sum(w * t for w, t in zip(weight, terms, strict=True)))
    return out


#: Shapley values that a task of Spark keeps to look up.
KEPT = 4_000_000


def shapley_each(rows: DataFrame, features: list[str], models: dict[str, Model], tested: dict[int, str], keep: list[str]) -> DataFrame:
    """The columns ``keep``, fold, and for each feature shap_ and value_ of every row, read once; null without a model or the feature.

    Values hang on which cuts of the forest lie below a row's alone: a task of Spark works each such place out once.
    """
    used = {k: models[n] for k, n in tested.items() if n in models}
    names = [*keep, "fold", *[f"{p}_{c}" for c in features for p in ("shap", "value")]]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        grids = {k: trees.Grid.of(m, GRID) for k, m in used.items()}
        known = {k: (np.zeros(0, np.int64), np.zeros((0, len(m.spec.columns)))) for k, m in used.items()}

        def values(k: int, x: np.ndarray) -> np.ndarray:
            m, grid = used[k], grids[k]
            if grid is None:
                return np.mean([tree_shapley(t, x) for t in m.trees], axis=0)
            codes, first, kind = np.unique(grid.codes(x), return_index=True, return_inverse=True)
            held, got = known[k]
            at = np.searchsorted(held, codes)
            new = np.append(held, -1)[at] != codes
            found = np.empty((len(codes), x.shape[1]))
            found[~new] = got[at[~new]]
            if new.any():
                found[new] = np.mean([tree_shapley(t, x[first[new]]) for t in m.trees], axis=0)
                if got.size < KEPT:
                    held, got = np.append(held, codes[new]), np.concatenate([got, found[new]])
                    order = np.argsort(held)
                    known[k] = held[order], got[order]
            return found[kind]

        for batch in (b for held in trees._held(batches, trees.HELD) for b in held.to_batches()):
            fold = batch.column(len(keep)).to_numpy()
            x = np.column_stack([batch.column(len(keep) + 1 + j).to_numpy() for j in range(len(features))])
            out = np.full((batch.num_rows, 2 * len(features)), np.nan)
            for k, m in used.items():
                if len(own := np.flatnonzero(fold == k)):
                    at = np.array([features.index(c) for c in m.spec.columns])
                    part = x[np.ix_(own, at)]
                    out[np.ix_(own, 2 * at)], out[np.ix_(own, 2 * at + 1)] = values(k, part), part
            yield pa.RecordBatch.from_arrays([*batch.columns[: len(keep) + 1], *[pa.array(v, pa.float64(), from_pandas=True) for v in out.T]], names)

    kinds = dict(rows.dtypes)
    schema = ", ".join([*[f"{c} {kinds[c]}" for c in [*keep, "fold"]], *[f"{n} double" for n in names[len(keep) + 1 :]]])
    return rows.select(*keep, "fold", *features).mapInArrow(run, schema)


def models_table(models: dict[str, Model], more: dict[str, dict], spark) -> DataFrame:
    """task, spec, model: a row a model; ``spec`` (JSON) holds what a refit needs."""
    return spark.createDataFrame([(n, json.dumps({"algo": m.spec.algo, "columns": list(m.spec.columns), "settings": m.spec.settings, "seed": m.spec.seed, **more.get(n, {})}, sort_keys=True), m.to_json()) for n, m in models.items()], "task string, spec string, model string")
