"""Near copies for operator 7's stage: texts whose sets of word shingles have a Jaccard similarity of at least ``least``.

A text's set holds the 64-bit hashes of its shingles; texts of equal sets are one node from the start. Candidates come
from SimHash fingerprints that pigeonring filtering links (``simhash.links``), and, since a SimHash of 64 bits differs in
about 10 bits at 0.8 and finds few such pairs, from ``BANDS`` keys of ``ROWS`` minima of the set each. A pair of
similarity s shares no key with probability (1 - s ** ROWS) ** BANDS: 3e-6 at 0.8, less above. What links is decided by
the two whole sets alone.

1. Nodes of linked fingerprints, and neighbours among the nodes of a key (in blocks of ``BLOCK``, and over the blocks'
   heads), are judged: about a pair a node and key, which joins most groups.
2. Keys that still hold nodes of several components go through all their pairs of blocks. A task compares the nodes'
   minima: pairs of one component, pairs whose sizes exclude the similarity and pairs that agree in fewer than ``AGREE``
   of the minima (at 0.8 a chance of about 1e-6) go no further, and a pair counts at the first key that it shares. In a
   first round each node gives the likeliest of its pairs; in a second one, over what is still apart, the nodes' whole
   sets go to the tasks, which judge all such pairs on the spot and give those that are similar.

Defined results: as for ``simhash``; texts without words are copies of each other only.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from skerry.llm import simhash
from skerry.llm.common import forget, give_back, parts, text_or_empty, written
from skerry.llm.components import connected_components
from skerry.llm.simhash import SEED, keep_least, shingle_hashes

LEAST, ROWS, BANDS, BLOCK = 0.8, 5, 32, 2048
#: Of the ROWS * BANDS minima; the share of equal ones estimates the similarity with a deviation of 0.03.
AGREE = 103 / 160  # 0 turns this estimate off: every pair of a key is judged
_PIECE = 1 << 11
_FACTORS, _TURNS = (np.random.default_rng(8).integers(0, 1 << 63, (ROWS * BANDS, 1), np.uint64) * np.uint64(2) + np.uint64(1) for _ in range(2))


def shingle_set(text: str, words: int, seed: int = SEED) -> np.ndarray:
    return np.unique(np.array(shingle_hashes(text, words, seed), "<u8"))


def minima(hashes: np.ndarray) -> np.ndarray:
    """The top 16 bits of the least value of a set under each permutation."""
    return (np.min([((hashes[a : a + _PIECE] ^ _TURNS) * _FACTORS).min(axis=1) for a in range(0, len(hashes), _PIECE)], axis=0) * _FACTORS[:, 0] >> np.uint64(48)).astype(np.uint16)


def _node(hashes: np.ndarray, seed: int) -> int:
    return xxhash.xxh64_intdigest(hashes.tobytes(), seed)


def _lists(arrays: list[np.ndarray]) -> pa.Array:
    ends = np.cumsum([0, *(len(a) for a in arrays)])
    return pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(np.concatenate(arrays).view(np.int64)))


_MARKED = "doc_id long, node long, size long, fp long, least binary"


def _mark(words: int, seed: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            node, size, fps, least = [], [], [], []
            for text in batch.column(1).to_pylist():
                all_ = np.array(shingle_hashes(text, words, seed), "<u8")
                hashes = np.unique(all_)
                node.append(_node(hashes, seed))
                size.append(len(hashes))
                fps.append(simhash.fingerprint_of(all_))
                least.append(minima(hashes).tobytes() if len(hashes) else None)
            if node:
                signed = lambda x: pa.array(np.array(x, np.uint64).view(np.int64))
                yield pa.RecordBatch.from_arrays([batch.column(0), signed(node), pa.array(size, pa.int64()), signed(fps), pa.array(least, pa.binary())], ["doc_id", "node", "size", "fp", "least"])
        give_back()

    return run


def _give_sets(words: int, seed: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a in range(0, batch.num_rows, 256):
                sets = [shingle_set(t, words, seed) for t in batch.column(0).slice(a, 256).to_pylist()]
                nodes = np.array([_node(s, seed) for s in sets], np.uint64).view(np.int64)
                yield pa.RecordBatch.from_arrays([pa.array(nodes), _lists(sets)], ["node", "hashes"])
        give_back()

    return run


def _sizes_allow(a: Column, b: Column, least: float) -> Column:
    return F.least(a, b) >= F.greatest(a, b) * F.lit(least - 1e-12)


def _similar(pairs: DataFrame, sets: DataFrame, least: float) -> DataFrame:
    """Those of the pairs (u, v) whose sets are as similar."""
    both = pairs.join(sets.select(F.col("node").alias("u"), F.col("hashes").alias("a")), "u").join(sets.select(F.col("node").alias("v"), F.col("hashes").alias("b")), "v")
    common = F.size(F.array_intersect("a", "b"))
    return both.where(common >= (F.size("a") + F.size("b") - common) * F.lit(least - 1e-12)).select("u", "v")


def _keys() -> Column:
    """A key for each band, in their order."""
    width = 2 * ROWS
    return F.array(*[F.xxhash64(F.lit(j), F.substring("least", width * j + 1, width)) for j in range(BANDS)])


def _chains(met: DataFrame, least: float) -> DataFrame:
    """Neighbours (u, v) in each block of a key's nodes, and neighbours among the blocks' heads."""
    before = lambda by: F.lag(F.struct("size", "node")).over(Window.partitionBy(*by).orderBy("size", "node"))
    heads = met.where("blocks > 1").groupBy("key", "own").agg(F.min(F.struct("size", "node")).alias("head")).select("key", "head.*")
    near = met.withColumn("last", before(["key", "own"])).select("size", "node", "last").unionByName(heads.withColumn("last", before(["key"])).select("size", "node", "last"))
    fit = near.where(F.col("last").isNotNull() & _sizes_allow(F.col("size"), F.col("last.size"), least))
    return fit.select(F.least("node", "last.node").alias("u"), F.greatest("node", "last.node").alias("v")).distinct()


def _linked_fingerprints(nodes: DataFrame, least: float) -> DataFrame:
    """Pairs (u, v) of nodes: each with the first of its fingerprint, and firsts of fingerprints that pigeonring filtering links."""
    firsts = written(nodes.groupBy("fp").agg(F.min(F.struct("node", "size")).alias("one")).select("fp", F.col("one.node").alias("node"), F.col("one.size").alias("size")), "firsts")
    first = lambda end: firsts.select(F.col("fp").alias(end), F.col("node").alias(f"{end}_node"), F.col("size").alias(f"{end}_size"))
    across = simhash.links(firsts.select("fp")).join(first("u"), "u").join(first("v"), "v")
    own = nodes.join(first("u").withColumnRenamed("u", "fp"), "fp").select("u_node", "u_size", F.col("node").alias("v_node"), F.col("size").alias("v_size")).where("u_node <> v_node")
    pairs = across.select(*own.columns).unionByName(own).where((F.col("u_size") > 0) & (F.col("v_size") > 0) & _sizes_allow(F.col("u_size"), F.col("v_size"), least))
    return pairs.select(F.least("u_node", "v_node").alias("u"), F.greatest("u_node", "v_node").alias("v")).distinct()


def candidate_pairs(band: int, own: np.ndarray, across: bool, size: np.ndarray, root: np.ndarray, least: np.ndarray, similarity: float, best: bool) -> tuple[np.ndarray, np.ndarray]:
    """Indices of pairs to judge among nodes that share the key of ``band``; with ``across`` only between two blocks.

    With ``best`` each node outside the largest component gives its likeliest pair, else all pairs count that may be as similar.
    """
    names, nth, counts = np.unique(root, return_inverse=True, return_counts=True)
    if len(names) < 2:
        return np.empty(0, np.int64), np.empty(0, np.int64)
    rows = np.flatnonzero(nth != counts.argmax())  # every pair across components has one of them
    need = int(np.ceil(AGREE * least.shape[1]))
    a, b = [], []
    for at in range(0, len(rows), 256):
        i = rows[at : at + 256]
        ok = (nth[i][:, None] != nth) & (np.minimum(size[i][:, None], size) >= np.maximum(size[i][:, None], size) * (similarity - 1e-12))
        if across:
            ok &= own[i][:, None] != own
        ok &= np.arange(len(nth)) != i[:, None]
        if not ok.any():
            continue
        agree = np.zeros(ok.shape, np.uint16)
        for j in range(least.shape[1]):
            agree += least[i, j][:, None] == least[:, j]
        ok &= agree >= need
        if best:
            top = np.where(ok, agree, 0).argmax(axis=1)
            use = ok[np.arange(len(i)), top]
            a.append(i[use])
            b.append(top[use])
            continue
        x, y = np.nonzero(ok)
        x = i[x]
        twice = (nth[x] != counts.argmax()) & (nth[y] != counts.argmax()) & (x > y)  # both ends are among the rows
        x, y = x[~twice], y[~twice]
        same = (least[x] == least[y]).reshape(len(x), BANDS, ROWS).all(axis=2)
        first = same.argmax(axis=1) >= band  # an earlier key gives it
        a.append(x[first])
        b.append(y[first])
    if not a:
        return np.empty(0, np.int64), np.empty(0, np.int64)
    return np.concatenate(a), np.concatenate(b)


def similar_pairs(i: np.ndarray, j: np.ndarray, sets: list[np.ndarray], similarity: float) -> np.ndarray:
    """Which of the pairs have sets (sorted, each number once) that are as similar."""
    out = np.zeros(len(i), bool)
    for n, (a, b) in enumerate(zip(i.tolist(), j.tolist(), strict=True)):
        x, y = (sets[a], sets[b]) if len(sets[a]) <= len(sets[b]) else (sets[b], sets[a])
        at = np.minimum(np.searchsorted(y, x), len(y) - 1)
        common = int((y[at] == x).sum())
        out[n] = common >= (len(x) + len(y) - common) * (similarity - 1e-12)
    return out


def _candidates(similarity: float, best: bool):
    """Groups (band, key, low, high) follow each other in sorted rows; one may go on in the next batch.

    With ``best`` pairs to judge come out, else, by the rows' own ``hashes``, those that are similar.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        current = None

        def finish() -> list[np.ndarray] | None:
            rows = pa.Table.from_batches(held)
            node, own, size, root = (rows.column(c).to_numpy() for c in ("node", "own", "size", "root"))
            least = np.frombuffer(b"".join(rows.column("least").to_pylist()), np.uint16).reshape(len(node), -1)
            i, j = candidate_pairs(current[0], own, current[2] != current[3], size, root, least, similarity, best)
            if not best and len(i):
                hashes = rows.column("hashes").combine_chunks()
                ends = hashes.offsets.to_numpy()
                sets = np.split(hashes.flatten().to_numpy().view(np.uint64), (ends - ends[0])[1:-1])
                use = similar_pairs(i, j, sets, similarity)
                i, j = i[use], j[use]
            return [np.minimum(node[i], node[j]), np.maximum(node[i], node[j])] if len(i) else None

        for batch in batches:
            out = []
            heads = [batch.column(c).to_numpy() for c in ("band", "key", "low", "high")]
            cuts = np.flatnonzero(np.any([np.diff(h) != 0 for h in heads], axis=0)) + 1
            for a, b in zip([0, *cuts.tolist()], [*cuts.tolist(), batch.num_rows], strict=True):
                if a == b:
                    continue
                group = tuple(int(h[a]) for h in heads)
                if group != current and held:
                    out.append(finish())
                    held = []
                current = group
                held.append(batch.slice(a, b - a))
            out = [x for x in out if x]
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(x)) for x in zip(*out, strict=True)], ["u", "v"])
        if held and (last := finish()):
            yield pa.RecordBatch.from_arrays([pa.array(x) for x in last], ["u", "v"])
        give_back()

    return run


def _across(met: DataFrame, nodes: DataFrame, found: DataFrame, least: float, sets: DataFrame | None) -> DataFrame:
    """Pairs (u, v) among nodes that share a key but no component of ``found`` (node, root): each node's likeliest to judge, or with ``sets`` all that are similar."""
    rooted = met.join(found, "node", "left").withColumn("root", F.coalesce("root", "node"))
    mixed = rooted.groupBy("key").agg(F.min("root").alias("first"), F.max("root").alias("last")).where("first < last").select("key")
    rest = rooted.join(mixed, "key").join(nodes.select("node", "least"), "node").withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    columns = ["node", "own", "size", "root", "least"]
    if sets is not None:
        rest, columns = rest.join(sets, "node"), [*columns, "hashes"]
    dealt = rest.select("band", "key", F.least("own", "other").alias("low"), F.greatest("own", "other").alias("high"), *columns)
    dealt = dealt.repartition(parts(met.sparkSession), "key", "low", "high").sortWithinPartitions("band", "key", "low", "high", "node")
    return dealt.mapInArrow(_candidates(least, sets is None), "u long, v long").distinct()


def near_copies(docs: DataFrame, words: int, least: float = LEAST, seed: int = SEED) -> DataFrame:
    """doc_id and component_id (the smallest doc_id that similar texts reach) of every row."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_or_empty().alias("text"))
    marked = written(rows.mapInArrow(_mark(words, seed), _MARKED), "marked")
    nodes = written(marked.groupBy("node").agg(F.min("doc_id").alias("rep"), *[F.first(c).alias(c) for c in ("size", "fp", "least")]), "nodes")
    keyed = nodes.where("least IS NOT NULL").select("node", "size", F.posexplode(_keys()).alias("band", "key"))
    shared = keyed.groupBy("key").agg(F.count("*").alias("n")).where("n > 1")
    blocks = F.ceil(F.col("n") / BLOCK).cast("int")
    met = written(keyed.join(shared, "key").withColumn("blocks", blocks).withColumn("own", F.pmod(F.xxhash64("node"), "blocks").cast("int")).drop("n"), "met")
    tried = written(_chains(met, least).unionByName(_linked_fingerprints(nodes, least)).distinct(), "tried")
    some = met.select("node").unionByName(tried.select(F.col("u").alias("node"))).unionByName(tried.select(F.col("v").alias("node"))).distinct()
    asked = nodes.join(some, "node", "left_semi").select(F.col("rep").alias("doc_id")).distinct()
    sets = written(rows.join(asked, "doc_id", "left_semi").select("text").mapInArrow(_give_sets(words, seed), "node long, hashes array<long>").dropDuplicates(["node"]), "sets")
    edges = written(_similar(tried, sets, least), "edges")
    rooted = lambda: written(connected_components(edges).withColumnsRenamed({"u": "node", "v": "root"}), "found")
    found = rooted()
    more = written(_across(met, nodes, found, least, None).join(tried, ["u", "v"], "left_anti"), "more")
    edges = written(edges.unionByName(_similar(more, sets, least)), "edges")
    forget(found, more)
    found = rooted()
    edges = written(edges.unionByName(_across(met, nodes, found, least, sets)).distinct(), "edges")
    forget(found)
    forget(met, sets, tried, shuffles=True)
    final = connected_components(edges).withColumnsRenamed({"u": "node", "v": "root"})
    rooted = written(nodes.select("node", "rep").join(final, "node", "left").select("node", "rep", F.coalesce("root", "node").alias("root")), "rooted")
    ids = rooted.groupBy("root").agg(F.min("rep").alias("component_id"))
    classes = written(rooted.join(ids, "root").select("node", "component_id"), "classes")
    return marked.select("doc_id", "node").join(classes, "node", "left").select("doc_id", "component_id")


def keep_one(docs: DataFrame, words: int, least: float = LEAST, seed: int = SEED) -> DataFrame:
    """Of each component the row with the smallest doc_id (of repeated rows one); rows without a doc_id all stay."""
    return keep_least(docs, near_copies(docs.where(F.col("doc_id").isNotNull()), words, least, seed))
