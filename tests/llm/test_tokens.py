import random
import zlib

import duckdb
import numpy as np
import pyarrow as pa
import pytest
from tokenizers import Tokenizer

import public_tokenizers
from skerry.llm import elias_fano, packing, token_store, tokens

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", ["byte_bpe_50k.json", "word_bpe_49k.json"])
def test_encoder_equals_the_library(name, monkeypatch):
    monkeypatch.setattr(tokens, "MEMO_WORDS", 50)
    plain = Tokenizer.from_file(public_tokenizers.path(name))
    plain.encode_special_tokens = True
    rng = random.Random(1)
    words = ["the", "The", "don't", "l'été", "co-op", "x1y2", "中文", "ß", "İstanbul", "<|endoftext|>", "a,b", "end.", "...", "\u00a0x", "é", "12345", "__", "퟿", "🙂", "long" * 50]
    texts = ["", " ", "\n", "a", " a", "a ", "a  b", "\n\na", "a\tb", "a\r\nb", "\x00", "a\u00a0b", "\u2028", "é  a\u00a0b"]
    texts += ["".join(rng.choice(words) + rng.choice([" ", " ", " ", "\n", "  ", ""]) for _ in range(rng.randint(1, 60))) for _ in range(300)]
    enc = tokens.WordEncoder(name)
    for part in (texts, texts[::-1]):
        ids, count = enc.encode(pa.array(part))
        got = [x.tolist() for x in np.split(ids, np.cumsum(count)[:-1])]
        assert got == [e.ids for e in plain.encode_batch(part, add_special_tokens=False)]
        enc.rest()


def crc(ids) -> int:
    return zlib.crc32(np.array(ids, "<u4").tobytes())


def plain_ids(name: str, end: int) -> dict[int, list[int]]:
    library = Tokenizer.from_file(public_tokenizers.path(name))
    library.encode_special_tokens = True
    rows = duckdb.sql(f"select doc_id, coalesce(text, '') from '{SF}/documents.parquet'").fetchall()
    return {d: [*library.encode(t, add_special_tokens=False).ids, end] for d, t in rows}


def test_store_equals_the_library(spark):
    """start, n_tokens and ids_crc32 of every document, against plain encoding."""
    at, want = 0, []
    for doc, ids in sorted(plain_ids("byte_bpe_50k.json", 2).items()):
        want.append((doc, at, len(ids), crc(ids)))
        at += len(ids)
    assert sorted(tuple(r) for r in token_store.op9_token_store(spark, SF).collect()) == want


def test_pieces_equal_the_library(spark):
    """piece, start, length and ids_crc32 of every document, against plain encoding."""
    want = sorted((d, k, a, len(ids[a : a + 4096]), crc(ids[a : a + 4096])) for d, ids in plain_ids("word_bpe_49k.json", 1).items() for k, a in enumerate(range(0, len(ids), 4096)))
    got = packing.op3_best_fit_packing(spark, SF).select("doc_id", "piece", "start", "length", "ids_crc32").collect()
    assert sorted(tuple(r) for r in got) == want


def test_store_edges(spark, tmp_path):
    """Nulls, empty and repeated rows, clashing columns, small segments, random access, and the empty table."""
    rows = [(5, "b b b", 1), (None, "null id", 2), (5, "b b b", 3), (5, "a", 4), (-3, None, 5), (7, "", 6), (None, None, 7), (9, "long " * 5000, 8)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, ids int")
    library = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    path = str(tmp_path / "store")
    token_store.write_token_shards(docs, path, "byte_bpe_50k.json", 2, segment_ids=4)
    got = token_store.read_token_shards(spark, path).orderBy("start").collect()
    assert sorted((r.doc_id is not None, r.doc_id or 0, r.n_tokens, crc(np.frombuffer(r.ids, "<u4"))) for r in got) == sorted(
        (d is not None, d or 0, len(ids), crc(ids)) for d, t, _ in rows for ids in [[*library.encode(t or "", add_special_tokens=False).ids, 2]]
    )
    assert [r.doc_id for r in got] == [None, None, -3, 5, 5, 5, 7, 9]
    assert [r.start for r in got] == np.cumsum([0, *(r.n_tokens for r in got)])[:-1].tolist()
    picked = []
    for s in spark.read.parquet(path).orderBy("shard", "segment").collect():
        picked += [token_store.read_document(s.asDict(), i).tolist() for i in range(s.n_docs)]
    assert picked == [np.frombuffer(r.ids, "<u4").tolist() for r in got]
    token_store.write_token_shards(docs.limit(0), path + "0", "byte_bpe_50k.json", 2)
    assert token_store.read_token_shards(spark, path + "0").count() == 0


@pytest.mark.parametrize("top", [0, 1, 5, 300, 1 << 40])
def test_elias_fano_select(top):
    v = np.sort(np.random.default_rng(top % 97).integers(0, top + 1, 1000)).astype(np.uint64)
    ef = elias_fano.EliasFano(elias_fano.encode(v))
    assert ef.all().tolist() == v.tolist() == [ef.select(i) for i in range(len(v))]
    assert len(elias_fano.EliasFano(elias_fano.encode(np.empty(0, np.uint64))).all()) == 0


def test_elias_fano_ranges():
    rng = np.random.default_rng(3)
    for top in (1, 300, 10**7):
        v = np.sort(rng.integers(0, top, 1500)).astype(np.uint64)
        ef = elias_fano.EliasFano(elias_fano.encode(v))
        for a, b in ((0, 0), (0, 1), (0, 1500), (255, 257), (256, 512), (700, 1499), (1499, 1500), (1500, 1500)):
            assert ef.select_range(a, b).tolist() == v[a:b].tolist()


def test_documents_are_read_by_select(spark, monkeypatch, tmp_path):
    """The reader never decodes all boundaries, whatever the slice."""
    docs = spark.createDataFrame([(None, f"none {i}") for i in range(5)] + [(i, "word " * (i % 7)) for i in range(40)], "doc_id long, text string")
    token_store.write_token_shards(docs, str(tmp_path / "s"), "byte_bpe_50k.json", 2)
    want = sorted(map(tuple, token_store.read_token_shards(spark, str(tmp_path / "s")).select("n_tokens", "ids").collect()))
    monkeypatch.setattr(elias_fano.EliasFano, "all", None)
    monkeypatch.setattr(token_store, "SLICE_DOCS", 3)
    segments = [r.asDict() | {"shard_start": 0} for r in spark.read.parquet(str(tmp_path / "s")).collect()]
    got = [r for s in segments for b in token_store._documents(iter([pa.RecordBatch.from_pylist([s])])) for r in b.to_pylist()]
    assert sorted((r["n_tokens"], r["ids"]) for r in got) == want and sum(r["doc_id"] is None for r in got) == 5
