"""Forests, boosted trees and hinge regressions grown over all rows of their tasks, many models in the same passes.

``rows``: task (a text), label (0 or 1), h (a 64-bit hash of the row's key), inner (an inner fold, or null) and features. A
``Spec`` names the task whose rows a model sees, leaving out one inner fold or none. Nothing is sampled: a pass sums, for
every node of every tree, the weights and targets by feature and bin (an array a tree and task of Spark, summed by tree),
and the best cut of each node comes back to the driver, a row a node. Bins are quantiles of each feature over all rows.
Draws are hashes of the row's key, so partitions do not change a model but for the last digits of its sums.

Trees see no more of a row than its bins, so rows of the same bins are summed first, with how often each tree draws them
(``cells_of``); hinges see values, so equal rows are counted first (``distinct_of``). Passes grow with what differs.
"""

from __future__ import annotations

import json
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field, replace

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from skerry.sources.tables import written

BINS = 32
#: Array cells of all histograms that a task of Spark holds at a time.
CELLS = 12_000_000
_POISSON = np.cumsum([np.exp(-1) / np.prod(np.arange(1, k + 1), initial=1.0) for k in range(9)])


@dataclass(frozen=True)
class Spec:
    """A model: its rows (task, without the inner fold ``without``), predictors, learner and settings."""

    task: str
    columns: tuple[str, ...]
    algo: str
    settings: dict = field(default_factory=dict)
    without: int | None = None
    seed: int = 42


@dataclass(frozen=True)
class Bins:
    """Quantile cuts, mean and deviation of each feature over all rows."""

    cuts: dict[str, list[float]]
    mean: dict[str, float]
    sd: dict[str, float]
    knots: dict[str, list[float]]

    def of(self, feature: str, x: np.ndarray) -> np.ndarray:
        """How many cuts lie below x: rows of bin b and less are those of at most cut b."""
        return np.searchsorted(self.cuts[feature], x, side="left").astype(np.uint8)


def bins_of(rows: DataFrame, features: list[str], bins: int = BINS) -> Bins:
    shares = [i / bins for i in range(1, bins)]
    tenths = [i / 10 for i in range(1, 10)]
    exprs = [e for f in features for e in (F.percentile_approx(f, shares + tenths, 10_000), F.avg(f), F.coalesce(F.stddev_pop(f), F.lit(0.0)))]
    got = list(rows.agg(*exprs).first())
    by = {f: got[3 * i : 3 * i + 3] for i, f in enumerate(features)}
    return Bins({f: sorted(set((v[0] or [])[: len(shares)])) for f, v in by.items()}, {f: v[1] or 0.0 for f, v in by.items()}, {f: v[2] or 1.0 for f, v in by.items()}, {f: (v[0] or [])[len(shares) :] for f, v in by.items()})


@dataclass
class Tree:
    """Nodes as a heap: children of i are 2 i + 1 and 2 i + 2. ``feature`` is -1 where a node has none; ``value`` is there for all."""

    feature: np.ndarray
    cut: np.ndarray
    value: np.ndarray
    weight: np.ndarray

    @classmethod
    def empty(cls, depth: int) -> Tree:
        n = 2 ** (depth + 1) - 1
        return cls(np.full(n, -1, np.int32), np.zeros(n), np.zeros(n), np.zeros(n))

    def place(self, x: np.ndarray, depth: int, at: np.ndarray | None = None) -> np.ndarray:
        """The node of each row after at most ``depth`` cuts, from the root or from the nodes ``at``."""
        at = np.zeros(len(x), np.int64) if at is None else at
        rows = np.arange(len(x))
        for _ in range(depth):
            f = self.feature[at]
            go = 2 * at + 1 + (x[rows, np.maximum(f, 0)] > self.cut[at])
            at = np.where(f >= 0, go, at)
        return at


@dataclass
class Model:
    """Of a ``Spec``; ``x`` below are the columns in the spec's order."""

    spec: Spec
    trees: list[Tree] = field(default_factory=list)
    coef: np.ndarray | None = None
    bins: Bins | None = None

    def predict(self, x: np.ndarray, trees: int | None = None, depth: int | None = None, b: np.ndarray | None = None) -> np.ndarray:
        """Scores from 0 to 1; with ``trees`` and ``depth`` those of the model that stops there. ``b``: the basis of x, if it is there."""
        s = self.spec.settings
        if self.spec.algo == "hinges":
            # summed row by row: a product of matrices gives equal rows other last digits by their place in a batch, which breaks ties
            return 1 / (1 + np.exp(-np.clip(((basis(x, self.spec.columns, self.bins) if b is None else b) * self.coef).sum(axis=1), -30, 30)))
        use = self.trees[: trees or len(self.trees)]
        found = [t.value[t.place(x, depth or s["depth"])] for t in use]
        if self.spec.algo == "forest":
            return np.mean(found, axis=0) if found else np.full(len(x), 0.5)
        return 1 / (1 + np.exp(-s["rate"] * np.sum(found, axis=0))) if found else np.full(len(x), 0.5)

    def scores(self, x: np.ndarray, candidates: list[dict], b: np.ndarray | None = None) -> list[np.ndarray]:
        """``predict`` for settings of fewer trees or levels; a tree is walked once for all of them."""
        if self.spec.algo == "hinges":
            return [self.predict(x, b=b)] * len(candidates)
        s = self.spec.settings
        of = [(c.get("trees", c.get("rounds")) or len(self.trees), c.get("depth") or s["depth"]) for c in candidates]
        depths = sorted({d for _, d in of})
        sums, out = {d: np.zeros(len(x)) for d in depths}, {}
        for nth, tree in enumerate(self.trees, 1):
            at, done = np.zeros(len(x), np.int64), 0
            for d in depths:
                at, done = tree.place(x, d - done, at), d
                sums[d] = sums[d] + tree.value[at]
                if (nth, d) in of:
                    out[nth, d] = sums[d] / nth if self.spec.algo == "forest" else 1 / (1 + np.exp(-s["rate"] * sums[d]))
        return [out[c] if c in out else self.predict(x, *c) for c in of]

    def cut_to(self, settings: dict) -> Model:
        """The model that a spec with fewer trees or levels would give."""
        n = settings.get("trees", settings.get("rounds"))
        return self if n is None else Model(replace(self.spec, settings=settings), self.trees[:n], self.coef, self.bins)

    def to_json(self) -> str:
        s = self.spec
        trees = [[t.feature.tolist(), t.cut.tolist(), t.value.tolist(), t.weight.tolist()] for t in self.trees]
        b = self.bins and [self.bins.cuts, self.bins.mean, self.bins.sd, self.bins.knots]
        return json.dumps({"spec": [s.task, s.columns, s.algo, s.settings, s.without, s.seed], "trees": trees, "coef": None if self.coef is None else self.coef.tolist(), "bins": b})

    @classmethod
    def from_json(cls, text: str) -> Model:
        d = json.loads(text)
        task, columns, *more = d["spec"]
        trees = [Tree(np.array(f, np.int32), *(np.array(x, float) for x in rest)) for f, *rest in d["trees"]]
        return cls(Spec(task, tuple(columns), *more), trees, None if d["coef"] is None else np.array(d["coef"]), d["bins"] and Bins(*d["bins"]))


@dataclass
class Grid:
    """The scores of a forest by which of its cuts lie below a row's values: ``table`` has an axis a predictor."""

    cuts: list[np.ndarray]
    table: np.ndarray

    @classmethod
    def of(cls, m: Model, most: int) -> Grid | None:
        """None for other learners, and where the table would have over ``most`` places."""
        cuts = [np.unique(np.concatenate([t.cut[t.feature == j] for t in m.trees])) if m.trees else np.zeros(0) for j in range(len(m.spec.columns))]
        shape = [len(c) + 1 for c in cuts]
        if m.spec.algo != "forest" or not m.trees or np.prod(shape, dtype=float) > most:
            return None
        table = np.zeros(shape)
        for t in m.trees:
            todo = [(0, [(0, n) for n in shape])]
            while todo:
                at, box = todo.pop()
                if (f := int(t.feature[at])) < 0:
                    table[tuple(slice(*ends) for ends in box)] += t.value[at]
                    continue
                cut = int(np.searchsorted(cuts[f], t.cut[at])) + 1
                (low, high), low_, high_ = box[f], list(box), list(box)
                low_[f], high_[f] = (low, min(high, cut)), (max(low, cut), high)
                todo += [(child, b) for child, b in ((2 * at + 1, low_), (2 * at + 2, high_)) if b[f][0] < b[f][1]]
        return cls(cuts, table / len(m.trees))

    def codes(self, x: np.ndarray) -> np.ndarray:
        """The place of each row in the flat table."""
        at = [np.where(np.isnan(v), 0, np.searchsorted(c, v, side="left")) for v, c in zip(x.T, self.cuts, strict=True)]
        return np.ravel_multi_index(at, self.table.shape)

    def share(self, codes: np.ndarray, at: list[int]) -> np.ndarray:
        """What the predictors ``at`` add to each place."""
        strides = np.cumprod([1, *self.table.shape[:0:-1]])[::-1]
        out = np.zeros(len(codes), np.int64)
        for j in at:
            out += codes // strides[j] % self.table.shape[j] * strides[j]
        return out


def _mix(h: np.ndarray, seed: int) -> np.ndarray:
    x = h ^ np.uint64((seed * 0x9E3779B97F4A7C15) % (1 << 64))
    for c in (0xBF58476D1CE4E5B9, 0x94D049BB133111EB):
        x = (x ^ x >> np.uint64(30)) * np.uint64(c)
    return x ^ x >> np.uint64(31)


def bootstrap_weights(h: np.ndarray, seed: int, tree: int) -> np.ndarray:
    """How often each row is drawn for a tree: Poisson of mean 1 by the row's hash."""
    u = (_mix(h, seed * 1000 + tree) >> np.uint64(11)).astype(float) / 2.0**53
    return np.searchsorted(_POISSON, u, side="right").astype(float)


def _chosen(spec: Spec, tree: int, node: int) -> np.ndarray:
    """Which predictors a node of a forest may cut: the square root of their number."""
    p = len(spec.columns)
    out = np.zeros(p, bool)
    out[np.random.default_rng([spec.seed, tree, node]).permutation(p)[: spec.settings.get("features") or max(1, int(np.sqrt(p)))]] = True
    return out


def numbered(columns: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """For rows of whole numbers from 0 (a column each): the place of a row of each kind, and the kind of each row."""
    key, size = np.zeros(len(columns[0]), np.int64), 1
    for c in columns:
        n = int(c.max(initial=0)) + 1
        if size * n >= 2**62:
            key = np.unique(key, return_inverse=True)[1]
            size = int(key.max(initial=0)) + 1
        key, size = key * n + c, size * n
    _, first, kind = np.unique(key, return_index=True, return_inverse=True)
    return first, kind


def summed(kind: np.ndarray, n: int, values: np.ndarray) -> np.ndarray:
    """Rows of ``values`` added up by kind."""
    order = np.argsort(kind, kind="stable")
    return np.add.reduceat(values[order], np.searchsorted(kind[order], np.arange(n)), axis=0) if n else values[:0]


@dataclass
class Cells:
    """Rows of one task that share a label, an inner fold and the bins of all features: ``drawn`` is (cell, 2, tree), draws and rows drawn."""

    y: np.ndarray
    inner: np.ndarray
    bins: np.ndarray
    n: np.ndarray
    drawn: np.ndarray

    def of(self, without: int | None, at: list[int]) -> Cells:
        """Those outside an inner fold, by the features ``at`` alone."""
        use = slice(None) if without is None else self.inner != without
        y, b = self.y[use], self.bins[use][:, at]
        first, kind = numbered([y, *b.T.astype(np.int64)])
        k = len(first)
        if k == len(y):
            return Cells(y[first], np.full(k, -1), b[first].astype(np.int64), self.n[use][first], self.drawn[use][first])
        return Cells(y[first], np.full(k, -1), b[first].astype(np.int64), summed(kind, k, self.n[use]), summed(kind, k, self.drawn[use]))


#: Cells that a task of Spark holds at a time.
HELD = 100_000


def packed(rows: np.ndarray) -> pa.Array:
    """Each row of a matrix as its bytes."""
    rows = np.ascontiguousarray(rows).reshape(len(rows), -1)
    ends = np.arange(len(rows) + 1, dtype=np.int32) * np.int32(rows.shape[1] * rows.itemsize)
    return pa.Array.from_buffers(pa.binary(), len(rows), [None, pa.py_buffer(ends), pa.py_buffer(rows.tobytes())])


def unpacked(column: pa.Array | pa.ChunkedArray, kind: type) -> np.ndarray:
    """The matrix of ``packed``; all rows have as many bytes."""
    if isinstance(column, pa.ChunkedArray):
        column = pa.concat_arrays(column.chunks) if column.num_chunks != 1 else column.chunk(0)
    n = len(column)
    ends = np.frombuffer(column.buffers()[1], np.int32, n + 1, 4 * column.offset) if n else np.zeros(1, np.int32)
    if ends[0] == ends[-1]:
        return np.zeros((n, 0), kind)
    return np.frombuffer(column.buffers()[2], np.uint8)[ends[0] : ends[-1]].copy().view(kind).reshape(n, -1)


def cells_of(rows: DataFrame, bins: Bins, draws: list[tuple[int, int]] = (), near: list[str] = ()) -> DataFrame:
    """task, label, inner, bin_0, bin_1 .. (of the features), n, drawn: rows of the same bins, counted.

    ``drawn`` is an array in bytes: for each (seed, tree) of ``draws`` how often the rows are drawn, and how many are. Cells
    that share the bins of the features ``near`` lie in one task, one after another. Rows go there as the bytes of their
    bins and their hash: what they are drawn is worked out where they meet, and only sums are stored.
    """
    features, draws = list(bins.cuts), list(draws)
    first = [*near, *[f for f in features if f not in near]]
    back = [first.index(f) for f in features]
    names = [f"bin_{j}" for j in range(len(features))]
    schema = "task string, label int, inner int, " + "".join(f"{c} smallint, " for c in names) + "n long, drawn binary"

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                b = np.column_stack([bins.of(f, batch.column(4 + j).to_numpy()) for j, f in enumerate(first)])
                yield pa.RecordBatch.from_arrays([*batch.columns[:4], packed(b)], ["task", "label", "inner", "h", "bins"])

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for held in _held(batches, HELD):
            task = held.column(0).chunk(0).dictionary_encode()
            y, inner, h = (held.column(c).to_numpy() for c in (1, 2, 3))
            b, t, h = unpacked(held.column(4), np.uint8), task.indices.to_numpy(), h.view(np.uint64)
            other = (t[1:] != t[:-1]) | (y[1:] != y[:-1]) | (inner[1:] != inner[:-1]) | (b[1:] != b[:-1]).any(axis=1)
            at = np.flatnonzero(np.append(True, other))
            drawn = np.zeros((len(at), 2, len(draws)), np.uint32)
            for i, (seed, tree) in enumerate(draws):
                times = bootstrap_weights(h, seed, tree)
                drawn[:, 0, i], drawn[:, 1, i] = np.add.reduceat(times, at), np.add.reduceat(times > 0, at, dtype=np.int64)
            b = b[at][:, back].astype(np.int16)
            part = [task.dictionary.take(pa.array(t[at])), pa.array(y[at], pa.int32()), pa.array(inner[at], pa.int32(), mask=inner[at] < 0), *[pa.array(b[:, j]) for j in range(len(names))]]
            yield pa.RecordBatch.from_arrays([*part, pa.array(np.diff(np.append(at, len(y))), pa.int64()), packed(drawn)], ["task", "label", "inner", *names, "n", "drawn"])

    inner = F.coalesce(F.col("inner"), F.lit(-1)).cast("int")
    parts = max(1, rows.sparkSession.sparkContext.defaultParallelism)
    placed = rows.select("task", F.col("label").cast("int"), inner.alias("inner"), "h", *[F.col(f).cast("double") for f in first]).mapInArrow(place, "task string, label int, inner int, h long, bins binary")
    # each cell's rows meet in one task, cells one after another
    dealt = placed.repartition(parts, "task", F.substring("bins", 1, len(near) or len(first))).sortWithinPartitions("task", "bins", "label", "inner")
    return written(dealt.mapInArrow(add, schema), "cells")


def _held(batches: Iterator[pa.RecordBatch], size: int) -> Iterator[pa.Table]:
    """Batches put together to tables of about ``size`` rows."""
    kept, n = [], 0
    for batch in batches:
        kept.append(batch)
        n += batch.num_rows
        if n >= size:
            yield pa.Table.from_batches(kept).combine_chunks()
            kept, n = [], 0
    if n:
        yield pa.Table.from_batches(kept).combine_chunks()


def _cells_from(held: pa.Table, p: int) -> list[np.ndarray]:
    """task, label, inner (-1: none), bins, n and draws of ``cells_of``."""
    inner = held.column(2).fill_null(-1).to_numpy()
    bins = np.column_stack([held.column(3 + j).to_numpy() for j in range(p)])
    drawn = unpacked(held.column(4 + p), np.uint32) if held.num_columns > 4 + p else np.zeros((held.num_rows, 0), np.uint32)
    return [held.column(0).to_numpy(), held.column(1).to_numpy(), inner, bins, held.column(3 + p).to_numpy(), drawn.reshape(held.num_rows, 2, drawn.shape[1] // 2)]


def per_cells(cells: DataFrame, features: list[str], run: Callable, schema: str, drawn: bool = False, shares: dict[str, list[str]] | None = None) -> DataFrame:
    """``run(parts)`` in each task, with parts (a task's name, its ``Cells``) of at most about ``HELD`` cells; ``shares``: see ``Passes``."""

    def go(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def parts():
            for held in _held(batches, HELD):
                task, *rest = _cells_from(held, len(features))
                for part in np.unique(task):
                    own = task == part
                    c = Cells(*[v[own] for v in rest])
                    for t in shares[part] if shares else [part]:
                        yield t, c

        yield from run(parts())

    columns = ["task", "label", "inner", *[f"bin_{j}" for j in range(len(features))], "n"]
    return cells.select(*columns, *(["drawn"] if drawn else [])).mapInArrow(go, schema)


def values_of(bins: Bins, columns: tuple[str, ...], b: np.ndarray) -> np.ndarray:
    """A value in each bin that lies on the same side of every cut as all others there: its upper cut, or infinity."""
    return np.column_stack([np.append(bins.cuts[c], np.inf)[b[:, j]] for j, c in enumerate(columns)])


def distinct_of(rows: DataFrame, features: list[str], near: list[str] = ()) -> DataFrame:
    """task, label, inner (-1: none), n and features: equal rows counted, those of a task and inner fold one after another.

    Rows that are equal but for features outside ``near`` mostly follow each other (they are dealt to four tasks at most).
    """
    inner = F.coalesce(F.col("inner"), F.lit(-1)).cast("int").alias("inner")
    counted = rows.select("task", F.col("label").cast("int"), inner, *[F.col(f).cast("double") for f in features]).groupBy("task", "label", "inner", *features).agg(F.count("*").alias("n"))
    dealt = counted.repartition(max(1, rows.sparkSession.sparkContext.defaultParallelism), "task", "inner", *near, F.pmod(F.xxhash64(*features), F.lit(4)))
    return written(dealt.sortWithinPartitions("task", "inner", "label", *near), "values")


def runs(y: np.ndarray, n: np.ndarray, x: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Equal rows (label and features) that follow each other, as one row with their count."""
    first = np.flatnonzero(np.append(True, (y[1:] != y[:-1]) | (x[1:] != x[:-1]).any(axis=1)))
    return (y, n, x) if len(first) == len(y) else (y[first], np.add.reduceat(n, first), x[first])


def per_values(values: DataFrame, features: list[str], run: Callable, schema: str, shares: dict[str, list[str]] | None = None) -> DataFrame:
    """``run(parts)`` in each task, with parts (a task's name, inner fold, labels, counts, features) of one task and inner fold; ``shares``: see ``Passes``."""

    def go(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def parts():
            for held in _held(batches, 20_000):
                coded = held.column(0).chunk(0).dictionary_encode()
                task, names = coded.indices.to_numpy(), coded.dictionary.to_pylist()
                y, inner, n = (held.column(c).to_numpy() for c in (1, 2, 3))
                x = np.column_stack([held.column(4 + j).to_numpy() for j in range(len(features))])
                first = np.flatnonzero(np.append(True, (task[1:] != task[:-1]) | (inner[1:] != inner[:-1])))
                for a, b in zip(first, np.append(first[1:], len(y)), strict=True):
                    for t in shares[names[task[a]]] if shares else [names[task[a]]]:
                        yield t, int(inner[a]), y[a:b], n[a:b], x[a:b]

        yield from run(parts())

    return values.select("task", "label", "inner", "n", *features).mapInArrow(go, schema)


def class_weights(rows: DataFrame, specs: dict[str, Spec], shares: dict[str, list[str]] | None = None) -> dict[str, tuple[float, float]]:
    """The weight of a row of each label: balanced for forests and hinges, that of presences raised for boosting. Models that see one label only are left out."""
    n: dict[tuple, int] = {}
    for r in rows.groupBy("task", "inner", "label").agg((F.sum("n") if "n" in rows.columns else F.count("*")).alias("n")).collect():
        for t in shares[r.task] if shares else [r.task]:
            n[t, r.inner, r.label] = n.get((t, r.inner, r.label), 0) + r.n
    out = {}
    for name, s in specs.items():
        count = [sum(v for (t, k, y), v in n.items() if t == s.task and y == label and (s.without is None or k != s.without)) for label in (0, 1)]
        if all(count):
            out[name] = (sum(count) / (2 * count[0]), sum(count) / (2 * count[1])) if s.algo != "boosting" else (1.0, count[0] / count[1])
    return out


def _cuts_of(s: Spec, tree: int, level: int, sums: np.ndarray) -> list[tuple]:
    """node, feature, cut, and weight and target of the node and of both sides, for each node of a level that has rows. ``sums``: (node, feature, bin, 3)."""
    total = sums[:, 0].sum(axis=1)
    low = sums.cumsum(axis=2)[:, :, :-1]
    high = total[:, None, None, :] - low
    ok = (low[..., 2] >= s.settings.get("min_leaf", 1)) & (high[..., 2] >= s.settings.get("min_leaf", 1)) & (low[..., 0] > 1e-12) & (high[..., 0] > 1e-12)
    with np.errstate(divide="ignore", invalid="ignore"):
        worth = low[..., 1] ** 2 / low[..., 0] + high[..., 1] ** 2 / high[..., 0] - (total[:, 1] ** 2 / total[:, 0])[:, None, None]
    worth = np.where(ok, np.round(worth, 9), -1.0)
    out = []
    for i in range(len(sums)):
        if total[i, 2] == 0:
            continue
        node = len(sums) - 1 + i
        w = worth[i] if s.algo != "forest" else np.where(_chosen(s, tree, node)[:, None], worth[i], -1.0)
        f, c = np.unravel_index(int(w.argmax()), w.shape) if w.size else (0, 0)
        good = w.size > 0 and w[f, c] > 1e-9
        a, b = (low[i, f, c], high[i, f, c]) if good else (total[i], total[i])
        out.append((node, int(f) if good else -1, int(c), *map(float, total[i, :2]), *map(float, a[:2]), *map(float, b[:2])))
    return out


def _best_cuts(specs: dict[str, Spec], cells: dict[str, int], level: int):
    def run(rows: pa.Table) -> pa.Table:
        name, tree = rows.column("name")[0].as_py(), rows.column("tree")[0].as_py()
        s = specs[name]
        sums = np.sum([np.frombuffer(b, float) for b in rows.column("sums").to_pylist()], axis=0).reshape(2**level, len(s.columns), cells[name], 3)
        out = [(name, tree, *cut) for cut in _cuts_of(s, tree, level, sums)]
        cols = list(zip(*out, strict=True)) if out else [[]] * 11
        kinds = [pa.string(), pa.int32(), pa.int32(), pa.int32(), pa.int32(), *[pa.float64()] * 6]
        return pa.table([pa.array(c, k) for c, k in zip(cols, kinds, strict=True)], names=["name", "tree", "node", "feature", "cut", "w", "g", "lw", "lg", "hw", "hg"])

    return run


_CUTS = "name string, tree int, node int, feature int, cut int, w double, g double, lw double, lg double, hw double, hg double"


def _grow_level(cells_: DataFrame, models: dict[str, Model], weights: dict, bins: Bins, level: int, trees: dict[str, range], draws: list[tuple[int, int]], shares: dict[str, list[str]] | None = None) -> None:
    """One more level for the trees named, all in as few passes as ``CELLS`` allows. ``cells_``: of ``cells_of``."""
    specs = {n: m.spec for n, m in models.items()}
    features = list(bins.cuts)
    cells = {n: max(len(bins.cuts[c]) for c in s.columns) + 1 for n, s in specs.items()}
    size = {n: 2**level * len(specs[n].columns) * cells[n] * 3 for n in trees}
    nth = {d: i for i, d in enumerate(draws)}
    todo = [(n, t) for n, r in trees.items() for t in r]
    while todo:
        now, held = [], 0
        while todo and (not now or held + size[todo[0][0]] <= CELLS):
            held += size[todo[0][0]]
            now.append(todo.pop(0))
        of: dict[str, list[int]] = {}
        for n, t in now:
            of.setdefault(n, []).append(t)
        alike: dict[tuple, list[str]] = {}
        for n in of:
            alike.setdefault((specs[n].task, specs[n].without, specs[n].columns), []).append(n)

        def add(kept, name, c, x, columns, drawn, of=of):
            s, m = specs[name], models[name]
            low, high = weights[name]
            ones = np.searchsorted(c.y, 1)  # cells are in order of their label
            w = np.where(c.y == 1, high, low)
            boosting = s.algo == "boosting"
            if boosting:
                score = s.settings["rate"] * np.sum([t.value[t.place(x, s.settings["depth"])] for t in m.trees[: of[name][0]]], axis=0) if of[name][0] else np.zeros(len(w))
                p = 1 / (1 + np.exp(-np.clip(score, -30, 30)))
            for t in of[name]:
                at = m.trees[t].place(x, level) - (2**level - 1)
                b, k = columns, c.n.astype(float)
                if boosting:
                    v = np.stack([w * k * np.maximum(p * (1 - p), 1e-6), w * k * (c.y - p)])
                elif s.settings.get("bootstrap", True):
                    v, k = drawn[0, nth[s.seed, t]], drawn[1, nth[s.seed, t]]
                else:
                    v = k
                many, cut = 2**level * cells[name], ones
                if (at < 0).any():  # leaves above are done
                    use = at >= 0
                    at, b, v, k, cut = at[use], b[:, use], v[..., use], k[use], int(use[:ones].sum())
                sums = kept.setdefault((name, t), np.zeros((2**level, len(s.columns), cells[name], 3)))
                at = at * cells[name]
                for j in range(len(s.columns)):
                    cell = at + b[j]
                    if boosting:
                        a, g = (np.bincount(cell, u, many) for u in v)
                    else:
                        g = high * np.bincount(cell[cut:], v[cut:], many)
                        a = low * np.bincount(cell[:cut], v[:cut], many) + g
                    for i, u in enumerate((a, g, np.bincount(cell, k, many))):
                        sums[:, j, :, i] += u.reshape(2**level, -1)

        def run(parts, alike=alike, add=add):
            kept = {}
            for task, c in parts:
                for (t, without, columns), names in alike.items():
                    if t == task and len((own := c.of(without, [features.index(f) for f in columns])).y):
                        x, b = values_of(bins, columns, own.bins), np.ascontiguousarray(own.bins.T)
                        counts = np.ascontiguousarray(own.drawn.transpose(1, 2, 0), float)
                        for name in names:
                            add(kept, name, own, x, b, counts)
            if kept:
                yield pa.RecordBatch.from_arrays([pa.array([n for n, _ in kept], pa.string()), pa.array([t for _, t in kept], pa.int32()), pa.array([v.tobytes() for v in kept.values()], pa.binary())], ["name", "tree", "sums"])

        sums = per_cells(cells_, features, run, "name string, tree int, sums binary", drawn=bool(draws), shares=shares)
        for r in sums.groupBy("name", "tree").applyInArrow(_best_cuts(specs, cells, level), _CUTS).collect():
            _set(models[r["name"]].trees[r.tree], tuple(r)[2:], specs[r["name"]], bins)


def _set(tree: Tree, found: tuple, spec: Spec, bins: Bins) -> None:
    """``found``: of ``_cuts_of``."""
    node, feature, cut, w, g, lw, lg, hw, hg = found
    value = (lambda g, w: float(np.clip(g / w, -4, 4))) if spec.algo == "boosting" else (lambda g, w: g / w)
    tree.value[node], tree.weight[node] = value(g, w), w
    if feature >= 0:
        tree.feature[node], tree.cut[node] = feature, bins.cuts[spec.columns[feature]][cut]
        for child, g, w in ((2 * node + 1, lg, lw), (2 * node + 2, hg, hw)):
            tree.value[child], tree.weight[child] = value(g, w), w


#: Different bins and labels up to which a task of Spark grows whole trees from all cells of their rows, and trees that share one.
LOCAL, TOGETHER = 1_000_000, 10


def _grown(spec: Spec, nth: int, depth: int, b: np.ndarray, v: tuple, bins: Bins, levels: dict) -> tuple[Tree, np.ndarray]:
    """A tree, and the node of each cell. ``b``: (feature, cell); ``v``: functions that sum the cells' weights, targets and rows by number.

    ``levels``: sums of a level by the cuts above it, which other settings of the same rows share.
    """
    tree = Tree.empty(depth)
    size = max(len(bins.cuts[x]) for x in spec.columns) + 1
    at, cells = np.zeros(b.shape[1], np.int64), np.arange(b.shape[1])
    for level in range(depth):
        first, many = 2**level - 1, (2**level + 1) * size
        key = (nth, level, tree.feature[:first].tobytes(), tree.cut[:first].tobytes())
        if key not in levels:
            sums = np.zeros((2**level, len(b), size, 3))
            on = np.maximum(at - first + 1, 0) * size  # cells of leaves above are summed apart
            for j in range(len(b)):
                cell = on + b[j]
                for i, u in enumerate(v(cell, many)):
                    sums[:, j, :, i] = u.reshape(-1, size)[1:]
            levels[key] = sums, at
        sums, at = levels[key]
        side = np.full((2, 2 ** (level + 1) - 1), -1)
        for found in _cuts_of(spec, nth, level, sums):
            _set(tree, found, spec, bins)
            side[:, found[0]] = found[1:3]
        f, cut = side[0][at], side[1][at]
        at = np.where(f >= 0, 2 * at + 1 + (b[np.maximum(f, 0), cells] > cut), at)
    return tree, at


#: Cells in a row of those that go to the tasks that grow trees.
SENT = 20_000


def _grow_whole(cells_: DataFrame, models: dict[str, Model], weights: dict, bins: Bins, draws: list[tuple[int, int]], shares: dict[str, list[str]] | None = None) -> None:
    """All trees of all models in one pass: the cells of the same rows and predictors meet in a task, which grows ``TOGETHER`` trees of forests, or the boosted models, level by level."""
    features, nth = list(bins.cuts), {d: i for i, d in enumerate(draws)}
    alike: dict[tuple, list[int]] = {}
    jobs: list[list[tuple[str, range]]] = []
    for boosting in (False, True):
        of: dict[tuple, list[str]] = {}
        for name, m in models.items():
            if (m.spec.algo == "boosting") == boosting:
                of.setdefault((m.spec.task, m.spec.without, m.spec.columns), []).append(name)
        for key, names in of.items():
            most = max(len(models[n].trees) for n in names)
            for a in range(0, most, most if boosting else TOGETHER):
                alike.setdefault(key, []).append(len(jobs))
                jobs.append([(n, range(a, min(len(models[n].trees), most if boosting else a + TOGETHER))) for n in names])
    drawn = [sorted({nth[models[n].spec.seed, t] for n, r in job for t in r if models[n].spec.algo == "forest" and models[n].spec.settings.get("bootstrap", True)}) for job in jobs]
    specs = {n: m.spec for n, m in models.items()}

    def deal(parts):
        for task, c in parts:
            for (t, without, columns), of in alike.items():
                if t == task and len((own := c.of(without, [features.index(f) for f in columns])).y):
                    for j in of:
                        for a in range(0, len(own.y), SENT):
                            part = slice(a, a + SENT)
                            d = own.drawn[part][:, :, drawn[j]]
                            yield pa.RecordBatch.from_arrays([pa.array([j], pa.int32()), *[pa.array([x.tobytes()], pa.binary()) for x in (own.y[part].astype(np.uint8), own.bins[part].astype(np.uint8), own.n[part].astype(np.int64), d.astype(np.min_scalar_type(d.max(initial=0))))]], ["job", "label", "bins", "n", "drawn"])

    def grow(table: pa.Table) -> pa.Table:
        j = table.column(0)[0].as_py()
        p, trees_ = len(specs[jobs[j][0][0]].columns), len(drawn[j])
        parts = []
        for y, b, n, d in zip(*[table.column(c).to_pylist() for c in range(1, 5)], strict=True):
            kind = np.dtype(f"u{len(d) // (len(y) * 2 * trees_)}") if trees_ else np.uint8
            parts.append([np.frombuffer(y, np.uint8).astype(np.int64), np.frombuffer(b, np.uint8).reshape(-1, p), np.frombuffer(n, np.int64), np.frombuffer(d, kind).reshape(-1, 2, trees_) if trees_ else np.zeros((len(y), 2, 0), np.uint8)])
        y, b, n, d = (np.concatenate(x) for x in zip(*parts, strict=True))
        c = Cells(y, np.full(len(y), -1), b, n, d).of(None, list(range(p)))
        columns, rows = np.ascontiguousarray(c.bins.T.astype(np.uint8)), c.n.astype(float)
        out = []

        def keep(name: str, nth: int, tree: Tree) -> None:
            out.append((name, nth, tree.feature, tree.cut, tree.value, tree.weight))

        for name, which in jobs[j]:
            s, (low, high) = specs[name], weights[name]
            if s.algo == "boosting":
                weight, score = np.where(c.y == 1, high, low) * rows, np.zeros(len(rows))
                for t in which:
                    e = 1 / (1 + np.exp(-np.clip(s.settings["rate"] * score, -30, 30)))
                    v = weight * np.maximum(e * (1 - e), 1e-6), weight * (c.y - e), rows
                    tree, at = _grown(s, t, s.settings["depth"], columns, lambda cell, many, v=v: [np.bincount(cell, u, many) for u in v], bins, {})
                    score = score + tree.value[at]
                    keep(name, t, tree)
        forests = [(n, r) for n, r in jobs[j] if specs[n].algo == "forest"]
        for t in sorted({t for _, r in forests for t in r}):
            levels: dict[tuple, dict] = {}
            for name in [n for n, r in forests if t in r]:
                s, (low, high) = specs[name], weights[name]
                drawn_ = s.settings.get("bootstrap", True)
                times, k = (c.drawn[:, i, drawn[j].index(nth[s.seed, t])].astype(float) for i in (0, 1)) if drawn_ else (rows, rows)
                use = np.flatnonzero(k)
                cut, times, k = int((c.y[use] == 0).sum()), times[use], k[use]  # cells are in order of their label

                def v(cell, many, cut=cut, times=times, k=k, low=low, high=high):
                    g = high * np.bincount(cell[cut:], times[cut:], many)
                    return low * np.bincount(cell[:cut], times[:cut], many) + g, g, np.bincount(cell, k, many)

                keep(name, t, _grown(s, t, s.settings["depth"], columns[:, use], v, bins, levels.setdefault((s.seed, drawn_), {}))[0])
        names, nths, *arrays = zip(*out, strict=True) if out else [[]] * 6
        return pa.table({"name": pa.array(names, pa.string()), "tree": pa.array(nths, pa.int32()), **{k: pa.array([v.tobytes() for v in vs], pa.binary()) for k, vs in zip(("feature", "cut", "value", "weight"), arrays, strict=True)}})

    dealt = per_cells(cells_, features, deal, "job int, label binary, bins binary, n binary, drawn binary", drawn=bool(draws), shares=shares)
    spark = cells_.sparkSession
    # many small jobs: as many tasks as jobs, so that the great ones do not wait for each other
    grown = dealt.repartition(max(1, min(len(jobs), 8 * spark.sparkContext.defaultParallelism)), "job").groupBy("job").applyInArrow(grow, "name string, tree int, feature binary, cut binary, value binary, weight binary")
    for r in grown.collect():
        models[r["name"]].trees[r.tree] = Tree(np.frombuffer(r.feature, np.int32).copy(), *(np.frombuffer(x, float).copy() for x in (r.cut, r.value, r.weight)))


def basis(x: np.ndarray, columns: tuple[str, ...], bins: Bins) -> np.ndarray:
    """A one, the standardised predictors, and hinges at their deciles."""
    z = np.column_stack([(x[:, j] - bins.mean[c]) / bins.sd[c] for j, c in enumerate(columns)])
    at = [(np.array(bins.knots[c]) - bins.mean[c]) / bins.sd[c] for c in columns]
    return np.column_stack([np.ones(len(x)), z, *[np.maximum(0, z[:, [j]] - k) for j, k in enumerate(at)]])


def descend(gram: np.ndarray, target: np.ndarray, coef: np.ndarray, lam: np.ndarray, l1_ratio: np.ndarray, sweeps: int = 200) -> np.ndarray:
    """Elastic-net coordinate descent on the sums of a weighted least-squares step, of several models (the first axis) at once.

    The first coefficient is free; a model stops where no coefficient moves.
    """
    out = coef.copy()
    on, c, rows, own = np.arange(len(coef)), coef.copy(), np.ascontiguousarray(gram.transpose(1, 0, 2)), gram.diagonal(axis1=1, axis2=2).T.copy()
    for _ in range(sweeps):
        before = c.copy()
        for j in range(c.shape[1]):
            r = target[:, j] - np.einsum("mk,mk->m", rows[j], c) + own[j] * c[:, j]
            c[:, j] = r / np.maximum(own[j], 1e-12) if j == 0 else np.sign(r) * np.maximum(np.abs(r) - lam * l1_ratio, 0.0) / (own[j] + lam * (1 - l1_ratio) + 1e-12)
        out[on] = c
        moved = np.abs(c - before).max(axis=1) >= 1e-7
        if not moved.any():
            break
        if not moved.all():
            on, c, target, lam, l1_ratio, rows, own = on[moved], c[moved], target[moved], lam[moved], l1_ratio[moved], rows[:, moved], own[:, moved]
    return out


#: Rows whose basis a pass of hinges works on at a time, and models that are solved in a task.
BLOCK, SOLVED = 4_000, 24


def _fit_hinges(values: DataFrame, models: dict[str, Model], weights: dict, bins: Bins, steps: int, shares: dict[str, list[str]] | None = None) -> None:
    """Reweighted least squares: a pass sums each model's weighted products of the basis, and the small systems are solved by model. ``values``: of ``distinct_of``.

    Models of the same rows and coefficients (as all are at first) share their sums.
    """
    specs = {n: m.spec for n, m in models.items()}
    features = list(bins.cuts)
    alike: dict[tuple, list[str]] = {}
    for name, m in models.items():
        m.bins, m.coef = bins, np.zeros(basis(np.zeros((0, len(m.spec.columns))), m.spec.columns, bins).shape[1])
        alike.setdefault((m.spec.task, m.spec.columns), []).append(name)
    # models of as many coefficients are solved together, about ``SOLVED`` in a task
    sized: dict[int, list[str]] = {}
    for name, m in models.items():
        sized.setdefault(len(m.coef), []).append(name)
    group = {name: f"{p}:{i // SOLVED}" for p, names in sized.items() for i, name in enumerate(names)}
    for _ in range(steps):
        equal: dict[tuple, list[str]] = {}
        for name, m in models.items():
            equal.setdefault((m.spec.task, m.spec.columns, m.spec.without, weights[name], m.coef.tobytes()), []).append(name)
        same = {names[0]: names for names in equal.values()}

        def run(parts, same=same):
            kept = {}
            for task, inner, y_, n_, x_ in parts:
                for (t, columns), names in alike.items():
                    use = [m for m in names if m in same and (specs[m].without is None or specs[m].without != inner)]
                    if t != task or not use:
                        continue
                    every = runs(y_, n_, x_[:, [features.index(c) for c in columns]])
                    coefs = np.stack([models[m].coef for m in use])
                    for a in range(0, len(every[0]), BLOCK):
                        y, n, x = (v[a : a + BLOCK] for v in every)
                        b = np.ascontiguousarray(basis(x, columns, bins).T)
                        for name, eta in zip(use, np.clip(coefs @ b, -8, 8), strict=True):
                            p = 1 / (1 + np.exp(-eta))
                            w = n * np.where(y == 1, weights[name][1], weights[name][0])
                            v = w * p * (1 - p)
                            root = b * np.sqrt(v)
                            if name not in kept:
                                kept[name] = np.zeros((len(b), len(b))), np.zeros(len(b)), np.zeros(1)
                            gram, target, rows = kept[name]
                            gram += root @ root.T
                            target += b @ (v * eta + w * (y - p))
                            rows += n.sum()
            if kept:
                found = [(name, np.append(np.column_stack(v[:2]).ravel(), v[2]).tobytes()) for first, v in kept.items() for name in same[first]]
                yield pa.RecordBatch.from_arrays([pa.array([group[name] for name, _ in found], pa.string()), pa.array([name for name, _ in found], pa.string()), pa.array([v for _, v in found], pa.binary())], ["part", "name", "sums"])

        def solve(parts: pa.Table) -> pa.Table:
            added: dict[str, np.ndarray] = {}
            for name, b in zip(parts.column("name").to_pylist(), parts.column("sums").to_pylist(), strict=True):
                added[name] = added.get(name, 0) + np.frombuffer(b, float)
            sums, coef = np.stack(list(added.values())), np.stack([models[name].coef for name in added])
            both = (sums[:, :-1] / sums[:, -1:]).reshape(*coef.shape, -1)
            strength, l1_ratio = (np.array([specs[name].settings[k] for name in added]) for k in ("strength", "l1_ratio"))
            coef = descend(both[..., :-1], both[..., -1], coef, 1 / (strength * sums[:, -1]), l1_ratio)
            return pa.table({"name": list(added), "coef": coef.tolist()})

        found = per_values(values, features, run, "part string, name string, sums binary", shares)
        for r in found.repartition(max(1, len(set(group.values()))), "part").groupBy("part").applyInArrow(solve, "name string, coef array<double>").collect():
            models[r.name].coef = np.array(r.coef)


def _grow_levels(cells: DataFrame, models: dict[str, Model], weights: dict, bins: Bins, draws: list[tuple[int, int]], shares: dict[str, list[str]] | None = None) -> None:
    """All trees level by level over all cells, which stay where they are."""
    forests = {n: m for n, m in models.items() if m.spec.algo == "forest"}
    for level in range(max((m.spec.settings["depth"] for m in forests.values()), default=0)):
        _grow_level(cells, forests, weights, bins, level, {n: range(len(m.trees)) for n, m in forests.items() if level < m.spec.settings["depth"]}, draws, shares)
    boosted = {n: m for n, m in models.items() if m.spec.algo == "boosting"}
    for nth in range(max((len(m.trees) for m in boosted.values()), default=0)):
        on = {n: m for n, m in boosted.items() if nth < len(m.trees)}
        for level in range(max(m.spec.settings["depth"] for m in on.values())):
            _grow_level(cells, on, weights, bins, level, {n: range(nth, nth + 1) for n, m in on.items() if level < m.spec.settings["depth"]}, [], shares)


def near_of(specs: dict[str, Spec], bins: Bins) -> list[str]:
    """The features that all models have."""
    sets = [set(s.columns) for s in specs.values()]
    return [f for f in bins.cuts if sets and all(f in s for s in sets)]


class Passes:
    """The tables that passes over ``rows`` read, made when first asked for: equal rows, and cells with the draws of each set of trees.

    With ``shares`` the rows' task is a part of the rows, each there once, that those tasks share.
    """

    def __init__(self, rows: DataFrame, bins: Bins, near: list[str], shares: dict[str, list[str]] | None = None):
        self.rows, self.bins, self.near, self.shares = rows, bins, near, shares
        self._values: DataFrame | None = None
        self._cells: list[tuple[list[tuple[int, int]], DataFrame]] = []
        self._kinds: int | None = None

    def values(self) -> DataFrame:
        if self._values is None:
            self._values = distinct_of(self.rows, list(self.bins.cuts), self.near)
        return self._values

    def cells(self, drawn: list[tuple[int, int]]) -> tuple[list[tuple[int, int]], DataFrame]:
        """Cells whose draws hold all of ``drawn``, and which draws they hold."""
        for held, cells in self._cells:
            if set(drawn) <= set(held):
                return held, cells
        self._cells.append((drawn, cells_of(self.rows, self.bins, drawn, self.near)))
        return self._cells[-1]

    def kinds(self) -> int:
        """How many bins and labels differ."""
        if self._kinds is None:
            self._kinds = self.cells([])[1].select("label", *[f"bin_{j}" for j in range(len(self.bins.cuts))]).distinct().count()
        return self._kinds


def fit(rows: DataFrame, specs: dict[str, Spec], bins: Bins, hinge_steps: int = 6, passes: Passes | None = None) -> dict[str, Model]:
    """A model for each spec whose rows have both labels. ``passes``: tables of these rows that other fits share."""
    passes = passes or Passes(rows, bins, near_of(specs, bins))
    drawn = sorted({(s.seed, t) for s in specs.values() if s.algo == "forest" and s.settings.get("bootstrap", True) for t in range(s.settings["trees"])})
    held, cells = passes.cells(drawn) if any(s.algo != "hinges" for s in specs.values()) else ([], None)
    values = passes.values() if any(s.algo == "hinges" for s in specs.values()) else None
    weights = class_weights(values if cells is None else cells, specs, passes.shares) if specs else {}
    out = {n: Model(s, [Tree.empty(s.settings["depth"]) for _ in range(s.settings.get("trees", s.settings.get("rounds", 0)))] if s.algo != "hinges" else []) for n, s in specs.items() if n in weights}
    grown = {n: m for n, m in out.items() if m.spec.algo != "hinges" and m.trees}
    if grown and passes.kinds() <= LOCAL:
        _grow_whole(cells, grown, weights, bins, held, passes.shares)
    elif grown:
        _grow_levels(cells, grown, weights, bins, held, passes.shares)
    if hinges := {n: m for n, m in out.items() if m.spec.algo == "hinges"}:
        _fit_hinges(values, hinges, weights, bins, hinge_steps, passes.shares)
    return out
