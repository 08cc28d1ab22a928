"""Operator 13: phrases whose words come together more often than apart, by language.

A word is known by a 64-bit hash of its language and bytes; the table of all words shows that no two share one (else
another seed is taken), so phrases are exact keys of up to three such numbers.

1. Words are counted. Those with ``least`` occurrences or more set bits in a bitmap of bounded size.
2. Apriori-safe candidates: pairs of frequent words, then runs of three whose two pairs are candidates. Tasks count them
   in their own texts (a byte each, which is enough to say whether a sum reaches ``least``), and the sums by key leave the
   candidates. A bitmap may let more through, never less.
3. Candidates of all lengths are dealt into segments of about ``SEGMENT`` keys. Over each segment's keys stands a minimal
   perfect hash. Tasks send each candidate of their texts with its count to its segment; in a slice of a segment the slot
   is looked up, the stored key is compared, and counts go into one array by slot; the arrays of the slices are summed.
4. A phrase's cuts ask the segments of their parts for the counts by slot.

A key comes once from each batch of texts however often it occurs, and asked keys are dealt over slices, so no word or
phrase makes a large group. Scores are exact in 38 digits, for phrases of under 10^16 occurrences.

Defined results: a null text counts as empty, a null lang as ``und``; doc_id does not enter; repeated rows count each;
an empty table gives no rows; texts are used whole. Other columns do not enter, whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from skerry.llm.byte_words import slices, words
from skerry.llm.common import forget, give_back, parts, table, text_or_empty, written
from skerry.llm.perfect_hash import PerfectHash, mixed

LEAST, TOP, INSIDE_PERCENT = 10, 2000, 50
SEGMENT = 1 << 16
#: Bits of a bitmap: at least 16 a key, between these.
LEAST_BITS, MOST_BITS = 1 << 20, 1 << 28
_BATCH = 8 << 20
_BREAK = np.zeros(256, bool)
_BREAK[list(b".,;:!?\n\x0b\x0c\r")] = True
_IN_WORD = ~_BREAK
_IN_WORD[[9, 32]] = False
_KEY = ["h1", "h2", "h3"]


def word_keys(names: list[bytes], langs: list[bytes], seed: int) -> np.ndarray:
    """A number above 0 for each word of a language."""
    return np.maximum(np.array([xxhash.xxh3_64_intdigest(b"%b\0%b" % (a, w), seed) for a, w in zip(langs, names, strict=True)], np.uint64), np.uint64(1))


class Words:
    """The words of some texts: ``of`` numbers the different ones of each language, ``key``, ``name`` and ``lang`` describe these."""

    def __init__(self, texts: list[bytes], langs: list[str], seed: int):
        data, start, end, text = words(texts, _IN_WORD, b"\n")
        piece = np.cumsum(_BREAK[data])[start]
        inside = pa.py_buffer(data[_IN_WORD[data]])
        ends = np.concatenate([[0], np.cumsum(end - start)]).astype(np.int64)
        coded = pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(start), [None, pa.py_buffer(ends), inside]).dictionary_encode()
        names = coded.dictionary.to_pylist()
        kinds, nth = np.unique(np.array(langs, object).astype(str), return_inverse=True) if langs else (np.array([], str), np.array([], np.int64))
        both, self.of, self.count = np.unique(coded.indices.to_numpy().astype(np.int64) * max(len(kinds), 1) + nth[text], return_inverse=True, return_counts=True)
        self.name = [names[i] for i in (both // max(len(kinds), 1)).tolist()]
        self.lang = [str(kinds[i]) for i in (both % max(len(kinds), 1)).tolist()]
        self.key = word_keys(self.name, [x.encode() for x in self.lang], seed)
        self.next = np.flatnonzero(piece[1:] == piece[:-1])  # words with a word after them in their piece

    def keys(self, *ids: np.ndarray) -> np.ndarray:
        out = np.zeros((len(ids[0]), 3), np.uint64)
        for j, x in enumerate(ids):
            out[:, j] = self.key[x]
        return out


class Bits:
    """A set of 64-bit numbers by their first bits: may hold more, never less."""

    def __init__(self, bits: np.ndarray):
        self.bits, self.shift = bits, np.uint64(64 - (8 * len(bits)).bit_length() + 1)

    def has(self, h: np.ndarray) -> np.ndarray:
        at = h >> self.shift
        return self.bits[(at >> np.uint64(3)).astype(np.int64)] >> (at & np.uint64(7)).astype(np.uint8) & 1 > 0


def bitmap(numbers: DataFrame, column: str, count: int) -> Bits:
    """Of a long column; the driver gets at most ``MOST_BITS`` bits."""
    size = min(max(1 << (16 * count).bit_length(), LEAST_BITS), MOST_BITS)
    out = np.zeros(size // 8, np.uint8)
    at = F.shiftrightunsigned(column, 64 - size.bit_length() + 1) + 1
    chunk = 32768 // 8
    for b, x in numbers.groupBy(F.bitmap_bucket_number(at)).agg(F.bitmap_construct_agg(F.bitmap_bit_position(at))).collect():
        out[(b - 1) * chunk : b * chunk] = np.frombuffer(x, np.uint8)
    return Bits(out)


def _pairs(w: Words, frequent: Bits) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Pairs of frequent words: (where they begin, which, first and second word of the different ones)."""
    good = frequent.has(w.key)
    at = w.next[good[w.of[w.next]] & good[w.of[w.next + 1]]]
    both, which = np.unique(w.of[at] * len(w.key) + w.of[at + 1], return_inverse=True)
    return at, which, both // max(len(w.key), 1), both % max(len(w.key), 1)


def _phrases(w: Words, frequent: Bits, pairs: Bits | None) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(keys, counts) of the pairs of frequent words, and with ``pairs`` of the runs of three instead."""
    at, which, a, b = _pairs(w, frequent)
    if pairs is None:
        yield w.keys(a, b), np.bincount(which, minlength=len(a))
        return
    good = pairs.has(mixed(w.keys(a, b)))[which]
    at, which = at[good], which[good]
    follows = np.flatnonzero(at[1:] == at[:-1] + 1)
    both, n = np.unique(which[follows] * len(w.key) + w.of[at[follows] + 2], return_counts=True)
    p, c = both // max(len(w.key), 1), both % max(len(w.key), 1)
    yield w.keys(a[p], b[p], c), n


def _batches(batches: Iterator[pa.RecordBatch], seed: int) -> Iterator[Words]:
    """``batches``: lang, text."""
    for batch in batches:
        for piece, texts in slices(batch, 1, _BATCH):
            yield Words(texts, piece.column(0).to_pylist(), seed)
    give_back()


def _count_words(seed: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for w in _batches(batches, seed):
            yield pa.RecordBatch.from_arrays([pa.array(w.lang, pa.string()), pa.array([x.decode("utf-8", "replace") for x in w.name], pa.string()), pa.array(w.key.view(np.int64)), pa.array(w.count)], ["lang", "word", "key", "n"])

    return run


def _dealt(part: np.ndarray, *columns: np.ndarray) -> tuple[np.ndarray, list[pa.Array]]:
    """Rows of numbers dealt by ``part``: the parts, and of each column a run of bytes for each part."""
    order = np.argsort(part, kind="stable")
    part = part[order]
    cuts = np.flatnonzero(np.diff(part, prepend=-1))
    blobs = [pa.array([x.tobytes() for x in np.split(c[order], cuts[1:])] if len(cuts) else [], pa.binary()) for c in columns]
    return part[cuts], blobs


def _send_candidates(seed: int, shares: int, frequent: Bits, pairs: Bits | None):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for w in _batches(batches, seed):
            for keys, n in _phrases(w, frequent, pairs):
                share, blobs = _dealt((mixed(keys) % np.uint64(shares)).astype(np.int64), keys, np.minimum(n, 255).astype(np.uint8))
                yield pa.RecordBatch.from_arrays([pa.array(share, pa.int32()), *blobs], ["share", "keys", "n"])

    return run


def _joined(rows: pa.Table, column: str, kind) -> np.ndarray:
    return np.frombuffer(b"".join(rows.column(column).to_pylist()), kind)


def _frequent(least: int):
    def run(rows: pa.Table) -> pa.Table:
        keys, n = _joined(rows, "keys", np.uint64).reshape(-1, 3), _joined(rows, "n", np.uint8).astype(np.int64)
        order = np.lexsort(keys.T)
        keys, n = keys[order], n[order]
        first = np.flatnonzero(np.concatenate([[True], (keys[1:] != keys[:-1]).any(axis=1)]))
        keys = keys[first[np.add.reduceat(n, first) >= least]]
        return pa.table([*[pa.array(keys[:, j].view(np.int64)) for j in range(3)], pa.array(mixed(keys).view(np.int64))], names=[*_KEY, "h"])

    return run


def _key_rows(rows: pa.Table | pa.RecordBatch) -> np.ndarray:
    return np.column_stack([rows.column(c).to_numpy().view(np.uint64) for c in _KEY])


def _with_mix(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(mixed(_key_rows(batch)).view(np.int64))], [*_KEY, "h"])


def _send_counts(seed: int, segments: int, spread: int, frequent: Bits, pairs: Bits, wanted: Bits):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part = TaskContext.get().partitionId()
        for w in _batches(batches, seed):
            found = [(w.keys(np.arange(len(w.key))), w.count), *_phrases(w, frequent, None), *_phrases(w, frequent, pairs)]
            keys, n = np.concatenate([k for k, _ in found]), np.concatenate([n for _, n in found]).astype(np.int64)
            h = mixed(keys)
            use = wanted.has(h)
            segment, blobs = _dealt((h[use] % np.uint64(segments)).astype(np.int64), keys[use], n[use])
            yield pa.RecordBatch.from_arrays([pa.array(segment, pa.int32()), pa.array(np.full(len(segment), part % spread), pa.int32()), *blobs], ["segment", "slice", "keys", "n"])

    return run


def _hash_of(stored: pa.Table) -> tuple[PerfectHash, np.ndarray]:
    """The perfect hash of a segment's keys, the same for any order of rows, and the row of each slot."""
    keys = _key_rows(stored)
    order = np.lexsort(keys.T)
    found = PerfectHash(keys[order])
    row = np.empty(len(keys), np.int64)
    row[found.find(keys)] = np.arange(len(keys))
    return found, row


def _count(sent: pa.Table, stored: pa.Table) -> pa.Table:
    """One array of counts by slot from all that a slice was sent."""
    found, _ = _hash_of(stored)
    counts = np.zeros(len(found.keys), np.int64)
    for keys, n in zip(sent.column("keys").to_pylist(), sent.column("n").to_pylist(), strict=True):
        slot = found.find(np.frombuffer(keys, np.uint64).reshape(-1, 3))
        there = slot >= 0
        counts += np.bincount(slot[there], np.frombuffer(n, np.int64)[there], len(counts)).astype(np.int64)
    return pa.table([(stored if stored.num_rows else sent).column("segment")[:1], pa.array([counts.tobytes()], pa.binary())], names=["segment", "counts"])


def _sum(arrays: pa.Table, stored: pa.Table) -> pa.Table:
    """The slices' arrays summed, a row a slot."""
    found, _ = _hash_of(stored)
    total = np.zeros(len(found.keys), np.int64)
    for x in arrays.column("counts").to_pylist():
        total += np.frombuffer(x, np.int64)
    segment = np.full(len(total), stored.column("segment")[0].as_py() if len(total) else 0)
    return pa.table([pa.array(segment, pa.int32()), *[pa.array(found.keys[:, j].view(np.int64)) for j in range(3)], pa.array(total)], names=["segment", *_KEY, "f"])


def _ask(segments: int, spread: int):
    """The parts of each phrase at each cut, sent to the parts' segments."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys = _key_rows(batch)
            three = np.flatnonzero(keys[:, 2])
            none = np.zeros(len(keys), np.uint64)
            cuts = [(1, 0, np.arange(len(keys)), [keys[:, 0], none, none]), (1, 1, np.arange(len(keys)), [keys[:, 1], keys[:, 2], none])]
            cuts += [(2, 0, three, [keys[three, 0], keys[three, 1], none[three]]), (2, 1, three, [keys[three, 2], none[three], none[three]])]
            for k, side, of, asked in cuts:
                asked = np.column_stack(asked)
                h, own = mixed(asked), (mixed(keys[of]) % np.uint64(spread)).astype(np.int32)
                cols = [pa.array((h % np.uint64(segments)).astype(np.int32)), pa.array(own), *[pa.array(asked[:, j].view(np.int64)) for j in range(3)], *[pa.array(keys[of, j].view(np.int64)) for j in range(3)], pa.array(np.full(len(of), 2 * k + side), pa.int32())]
                yield pa.RecordBatch.from_arrays(cols, ["segment", "slice", *_KEY, "p1", "p2", "p3", "part"])

    return run


def _answer(asked: pa.Table, stored: pa.Table) -> pa.Table:
    found, row = _hash_of(stored)
    by_slot = stored.column("f").to_numpy()[row]
    return pa.table([*[asked.column(c) for c in ("p1", "p2", "p3", "part")], pa.array(by_slot[found.find(_key_rows(asked))])], names=["p1", "p2", "p3", "part", "f"])


def _by_slice(df: DataFrame, spread: int) -> DataFrame:
    return df.withColumn("slice", F.explode(F.sequence(F.lit(0), F.lit(spread - 1))))


def _known_words(slim: DataFrame) -> tuple[DataFrame, int]:
    """lang, word, key, n of all words, with a seed under which no two share a key."""
    seed = 0
    while True:
        counted = slim.mapInArrow(_count_words(seed), "lang string, word string, key long, n long").groupBy("lang", "word", "key").agg(F.sum("n").alias("n"))
        known = written(counted, "words")
        if known.groupBy("key").agg(F.count("*").alias("n")).where("n > 1").isEmpty():
            return known, seed
        forget(known)
        seed += 1


def collocations(docs: DataFrame, least: int = LEAST, top: int = TOP, inside_percent: int = INSIDE_PERCENT) -> DataFrame:
    """lang, rank, phrase, a, l, r, n and score of each language's best phrases of two and three words."""
    spark = docs.sparkSession
    shares = parts(spark)
    slim = docs.select(F.coalesce(F.col("lang").cast("string"), F.lit("und")).alias("lang"), text_or_empty().alias("text"))
    known, seed = _known_words(slim)
    common = known.where(F.col("n") >= least)
    n_common = common.count()
    frequent = bitmap(common, "key", n_common)
    candidates = []
    for pairs in (False, True):
        before = bitmap(candidates[0], "h", candidates[0].count()) if pairs else None
        sent = slim.mapInArrow(_send_candidates(seed, shares, frequent, before), "share int, keys binary, n binary")
        candidates.append(written(sent.groupBy("share").applyInArrow(_frequent(least), "h1 long, h2 long, h3 long, h long"), "candidates"))
    ones = common.select(F.col("key").alias("h1"), F.lit(0).cast("long").alias("h2"), F.lit(0).cast("long").alias("h3")).mapInArrow(_with_mix, "h1 long, h2 long, h3 long, h long")
    every = reduce(DataFrame.unionByName, [ones, *candidates])
    total = n_common + sum(c.count() for c in candidates)
    segments = max(1, -(-total // SEGMENT))
    spread = max(1, -(-shares // segments))
    stored = written(every.withColumn("segment", F.expr(f"CAST(pmod(CAST(h AS DECIMAL(20, 0)) + IF(h < 0, 18446744073709551616BD, 0BD), {segments}) AS INT)")), "keys")
    # each task's candidates to their segments, arrays by slot, sums of the arrays
    sent = slim.mapInArrow(_send_counts(seed, segments, spread, frequent, before, bitmap(stored, "h", total)), "segment int, slice int, keys binary, n binary")
    keys = stored.select("segment", *_KEY)
    arrays = sent.groupBy("segment", "slice").cogroup(_by_slice(keys, spread).groupBy("segment", "slice")).applyInArrow(_count, "segment int, counts binary")
    counts = written(arrays.groupBy("segment").cogroup(keys.groupBy("segment")).applyInArrow(_sum, "segment int, h1 long, h2 long, h3 long, f long"), "counts")
    phrases = counts.where(F.col("h2") != 0)
    asked = phrases.select(*_KEY).mapInArrow(_ask(segments, spread), "segment int, slice int, h1 long, h2 long, h3 long, p1 long, p2 long, p3 long, part int")
    said = asked.groupBy("segment", "slice").cogroup(_by_slice(counts, spread).groupBy("segment", "slice")).applyInArrow(_answer, "p1 long, p2 long, p3 long, part int, f long")
    cut = said.groupBy("p1", "p2", "p3").agg(*[F.max(F.when(F.col("part") == i, F.col("f"))).alias(c) for i, c in ((2, "l1"), (3, "r1"), (4, "l2"), (5, "r2"))])
    own = phrases.select(*[F.col(h).alias(p) for h, p in zip(_KEY, ("p1", "p2", "p3"), strict=True)], F.col("f").alias("a"))
    scored = own.join(cut, ["p1", "p2", "p3"])
    score = lambda k: F.expr(f"CAST((1000000BD * CAST(a AS DECIMAL(16, 0)) * CAST(a AS DECIMAL(16, 0))) div (CAST(l{k} AS DECIMAL(19, 0)) * CAST(r{k} AS DECIMAL(19, 0))) AS BIGINT)")
    scored = scored.withColumns({"s1": score(1), "s2": score(2)}).withColumn("second", F.coalesce(F.col("s2") < F.col("s1"), F.lit(False)))
    pick = lambda a, b: F.when(F.col("second"), F.col(b)).otherwise(F.col(a))
    scored = scored.select("p1", "p2", "p3", "a", pick("l1", "l2").alias("l"), pick("r1", "r2").alias("r"), pick("s1", "s2").alias("score"))
    longer = own.where("p3 <> 0").select(F.explode(F.array(F.struct(F.col("p1"), F.col("p2")), F.struct(F.col("p2").alias("p1"), F.col("p3").alias("p2")))).alias("o"), "a")
    longer = longer.groupBy("o.p1", "o.p2").agg(F.max("a").alias("inside")).withColumn("p3", F.lit(0).cast("long"))
    kept = scored.join(longer, ["p1", "p2", "p3"], "left").where(F.col("inside").isNull() | (F.col("inside") * 100 < F.col("a") * inside_percent))
    word = lambda p, *more: common.select(F.col("key").alias(p), F.col("word").alias(f"w{p}"), *more)
    by_lang = Window.partitionBy("lang").orderBy(F.desc("score"), F.desc("a"))
    first = kept.join(word("p1", "lang"), "p1").withColumn("_rank", F.rank().over(by_lang)).where(F.col("_rank") <= top)
    named = first.join(word("p2"), "p2").join(word("p3"), "p3", "left").withColumn("phrase", F.concat_ws(" ", "wp1", "wp2", "wp3"))
    totals = known.groupBy("lang").agg(F.sum("n").alias("n"))
    order = Window.partitionBy("lang").orderBy(F.desc("score"), F.desc("a"), "phrase")
    ranked = named.withColumn("rank", F.row_number().over(order).cast("long")).where(F.col("rank") <= top)
    return ranked.join(totals, "lang").select("lang", "rank", "phrase", "a", "l", "r", "n", "score")


def op13_phrase_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return collocations(table(spark, sf_dir, "documents"))


OP13_SQL = """WITH piece AS (SELECT coalesce(lang, 'und') AS lang, unnest(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\\x0A-\\x0D]')) AS p FROM documents),
w AS (SELECT lang, regexp_extract_all(p, '[^\\x20\\x09]+') AS w FROM piece), n AS (SELECT lang, CAST(sum(len(w)) AS BIGINT) AS n FROM w GROUP BY ALL),
g AS (SELECT lang, unnest(flatten(list_transform(range(1, 4), lambda k: list_transform(range(1, greatest(len(w) - k + 2, 1)), lambda i: w[i:i + k - 1])))) AS v FROM w),
f AS MATERIALIZED (SELECT lang, array_to_string(v, ' ') AS phrase, lang || ' ' || array_to_string(v, ' ') AS id, any_value(v) AS v, count(*) AS f FROM g GROUP BY lang, phrase, id), c AS (SELECT lang, v, phrase, f AS a FROM f WHERE len(v) > 1 AND f >= 10),
part AS MATERIALIZED (SELECT lang, phrase, a, k, lang || ' ' || array_to_string(v[1:k], ' ') AS lp, lang || ' ' || array_to_string(v[k + 1:], ' ') AS rp FROM c, range(1, 3) t(k) WHERE k < len(v)),
cut AS (SELECT part.lang, part.phrase, a, k, x.f AS l, y.f AS r, CAST((CAST(1000000 AS HUGEINT) * a * a) // (CAST(x.f AS HUGEINT) * y.f) AS BIGINT) AS score FROM part JOIN f x ON x.id = lp JOIN f y ON y.id = rp),
best AS (SELECT * FROM cut QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, k) = 1),
inside AS (SELECT lang, phrase, max(a) AS b FROM (SELECT lang, array_to_string(v[1:2], ' ') AS phrase, a FROM c WHERE len(v) = 3 UNION ALL SELECT lang, array_to_string(v[2:3], ' '), a FROM c WHERE len(v) = 3) x GROUP BY ALL),
kept AS (SELECT lang, phrase, a, l, r, score FROM best LEFT JOIN inside USING (lang, phrase) WHERE b IS NULL OR 100 * b < 50 * a)
SELECT lang, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank, phrase, a, l, r, n, score FROM kept JOIN n USING (lang) QUALIFY rank <= 2000"""
