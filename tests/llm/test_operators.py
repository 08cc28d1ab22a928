import hashlib
import itertools

import duckdb
import numpy as np
import oracle
import pytest
import xxhash
from pyspark.sql import functions as F

from skerry.llm import chat, html_extract, media, mixing, packing, quality, queries, simhash, token_store, topk, webp

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(queries.oracle_sql()))
def test_matches_sql(spark, name):
    assert oracle.compare(spark, oracle.connect(SF), queries.queries()[name], queries.oracle_sql()[name], SF) == ""


def docs(spark, rows):
    return spark.createDataFrame([(*r, 7) for r in rows], "doc_id long, text string, lang string, source string, fp int")


EDGES = [(1, "alpha beta gamma delta", "en", "s_1"), (2, None, None, None), (3, "", "en", "s_1"), (None, "alpha beta gamma delta", "de", "s_2"), (1, "alpha beta gamma delta", "en", "s_1"), (5, "wörter " * 3000, "de", "s_2"), (6, "\n \t", "fr", "odd")]


def test_edges_do_not_crash(spark):
    df = docs(spark, EDGES)
    for rows in (df, df.limit(0)):
        n = rows.count()
        assert simhash.near_duplicates(rows).count() == n
        assert media.read_media(media.store_texts(rows)).count() == n
        assert quality.features(rows).count() == n
        assert packing.packed_documents(rows).agg(F.count_distinct("doc_id")).first()[0] == (5 if n else 0)
        assert mixing.mixed_documents(rows).columns == rows.columns
        assert quality.keep_quality(rows, spark.createDataFrame([], "doc_id long, quality int")).count() == n
        assert simhash.keep_one(rows).columns == rows.columns


def test_simhash_components_by_brute_force(spark):
    rows = duckdb.sql(f"select doc_id, text from '{SF}/documents.parquet'").fetchall()

    def fingerprint(text):
        words = (text or "").encode().lower().replace(b"\x0b", b" ").split()
        grams = [b" ".join(words[i : i + 3]) for i in range(max(1, len(words) - 2))] if words else []
        h = [xxhash.xxh64_intdigest(g, 42) for g in grams]
        return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h)) if h else 0

    fp = [fingerprint(t) for _, t in rows]
    parent = list(range(len(rows)))

    def find(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i, j in itertools.combinations(range(len(rows)), 2):
        if (fp[i] ^ fp[j]).bit_count() <= 3:
            a, b = sorted((find(i), find(j)), key=lambda k: rows[k][0])
            parent[b] = a
    want = sorted((d, f"{f:016x}", rows[find(i)][0]) for i, ((d, _), f) in enumerate(zip(rows, fp, strict=True)))
    assert sorted(tuple(r) for r in simhash.op7_simhash_near_dedup(spark, SF).collect()) == want


def test_packing_is_gapless(spark):
    rows = packing.op3_best_fit_packing(spark, SF).toPandas()
    assert rows.duplicated(["doc_id", "piece"]).sum() == 0
    total = 0
    for _, g in rows.sort_values("offset").groupby("sequence_id"):
        assert (g["offset"].to_numpy() == np.cumsum(g["length"]) - g["length"]).all()
        assert g["length"].sum() <= 4096
        total += 1
    assert total <= 1.02 * rows["length"].sum() / 4096 + 1


def test_store_equals_packing_free_encoding(spark):
    out = token_store.op9_token_store(spark, SF).orderBy("doc_id").toPandas()
    assert (out["start"].to_numpy() == np.cumsum(out["n_tokens"]) - out["n_tokens"]).all()
    assert len(out) == spark.read.parquet(f"{SF}/documents.parquet").count()


def test_media_round_trip(spark):
    texts = dict(duckdb.sql(f"select doc_id, text from '{SF}/documents.parquet'").fetchall())
    for r in media.op5_media_columns(spark, SF).collect():
        raw = (texts[r.doc_id] or "").encode()
        payload = raw + bytes(-len(raw) % 64 or (0 if raw else 64))
        assert (r.n_bytes, r.payload_bytes, r.payload_sha256) == (len(raw), len(payload), hashlib.sha256(payload).hexdigest())


@pytest.mark.parametrize("shades", [1, 2, 3, 5, 16, 17, 200, 256])
def test_webp_grey(shades):
    rng = np.random.default_rng(shades)
    for shape in ((1, 1), (3, 7), (64, 64)):
        x = rng.integers(0, shades, shape).astype(np.uint8)
        assert ((webp.decode(webp.encode_grey(x)) >> 8 & 255).astype(np.uint8) == x).all()


def test_classifier_separates_held_out_rows(spark):
    out = quality.op6_quality_classifier(spark, "/root/testdata/sf0.01").where("held_out")
    labels = spark.read.parquet("/root/testdata/sf0.01/labels.parquet").select("doc_id", "quality").where("quality IS NOT NULL")
    hits = out.join(labels, "doc_id").agg(F.avg((F.col("predicted") == F.col("quality")).cast("int"))).first()[0]
    assert hits >= 0.9


def test_html_blocks():
    tree = html_extract.train()
    page = "<html><head><title>t</title></head><body><nav><a href=x>Home</a></nav><article><h1>A &amp; B</h1><p>One  two\n<b>three</b> four five six seven eight nine ten.</p></article><footer>c 2020</footer><script>x()</script></body></html>"
    assert html_extract.main_text(page, tree) == "A & B\nOne two three four five six seven eight nine ten."
    assert html_extract.main_text(None, tree) == html_extract.main_text("", tree) == ""


def test_chat_reports_rewriting_templates():
    turns = [("user", "a"), ("assistant", "</s>[INST] b")]
    text, spans, bad = chat.locate(turns, chat.instruction_template)
    assert bad is None and chat.unescape(text[spans[1][2] : spans[1][3]]) == turns[1][1]
    assert chat.locate(turns, lambda t: f"{len(t)}:" + "".join(x for _, x in t))[2] == 0


def test_topk_small_and_ties(spark):
    rows = spark.createDataFrame([(i, [1.0, float(i % 3)]) for i in range(50)] + [(100, None), (101, [float("nan"), 1.0])], "vec_id long, embedding array<float>")
    v = topk.whole_vectors(rows)
    got = topk.search(v, v.where("vec_id % 20 = 0"), 5).orderBy("query_id", "rank").collect()
    assert [r.vec_id for r in got if r.query_id == 20] == [2, 5, 8, 11, 14]


def test_topk_block_cut_keeps_all_results(monkeypatch):
    """Tiles of more than k rows with the query's own row, repeated, ties, and rows under the floor."""
    monkeypatch.setattr(topk, "_TILE", (2, 25))
    rng = np.random.default_rng(4)
    x = np.concatenate([rng.integers(1, 30, 60), [500, 500]])[:, None]
    ids = np.concatenate([np.sort(rng.permutation(60)), [99, 99]])
    for floor in (float("-inf"), 100.0, 2500.0):
        i, j, s = topk.best_of_block(ids, np.arange(62) % 2, x, np.array([99, 3, 4]), np.full(3, floor), np.full((3, 1), 100), np.array([[1, 1], [1, 1], [1, 0]], bool), 20)
        for q, own, rings in ((0, 99, (0, 1)), (1, 3, (0, 1)), (2, 4, (0,))):
            want = sorted(((int(100 * v), int(d)) for n, (v, d) in enumerate(zip(x[:, 0], ids, strict=True)) if d != own and 100 * v >= floor and n % 2 in rings), key=lambda r: (-r[0], r[1]))[:20]
            assert list(zip(s[i == q].tolist(), ids[j[i == q]].tolist(), strict=True)) == want


def test_topk_many_blocks_and_parts(spark):
    """Small blocks and parts, ties, repeated and null ids, short vectors, large numbers, and the empty table."""
    rng = np.random.default_rng(9)
    rows = [(int(i % 250), [float(v) for v in rng.integers(-3, 3, 3 if i % 7 else 2)]) for i in range(300)] + [(None, [1.0, 1.0, 1.0]), (400, [1e6, 5.0, 5.0])]
    v = topk.whole_vectors(spark.createDataFrame(rows, "vec_id long, embedding array<double>"))
    got = topk.search(v, v.where("vec_id % 50 = 0"), 7, block_rows=20, part_queries=2).collect()
    held = [(i, np.array([*(64 * np.array(x)), 0.0])[:3]) for i, x in rows if i is not None]
    for q in range(0, 401, 50):
        own = {tuple(x) for i, x in held if i == q}
        want = sorted(((int(np.array(o) @ y), i) for o in own for i, y in held if i != q), key=lambda r: (-r[0], r[1]))[:7]
        assert sorted([(r.score, r.vec_id) for r in got if r.query_id == q], key=lambda r: (-r[0], r[1])) == want
    assert topk.search(v.limit(0), v, 3).count() == 0
    assert topk.search(v, v.limit(0), 3).count() == 0


def test_topk_cluster_of_near_copies(spark):
    """The query's best all lie in its own cluster, with a repeated vec_id."""
    rows = [(i, [10.0 + i / 64, 10.0]) for i in range(60)] + [(40, [10.5, 10.0])] + [(100 + i, [-10.0 - i, 3.0]) for i in range(200)]
    v = topk.whole_vectors(spark.createDataFrame(rows, "vec_id long, embedding array<double>"))
    got = topk.search(v, v.where("vec_id IN (0, 20, 59)"), 20)
    held = [(r.vec_id, np.array(r.v)) for r in v.collect()]
    for q, x in held:
        if q in (0, 20, 59):
            want = sorted(((int(x @ y), i) for i, y in held if i != q), key=lambda r: (-r[0], r[1]))[:20]
            assert [(r.score, r.vec_id) for r in got.where(F.col("query_id") == q).orderBy("rank").collect()] == want
