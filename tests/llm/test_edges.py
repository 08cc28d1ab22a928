"""Every operator and the pipeline on nulls, empty and long texts, ties, repeats, empty tables and clashing column names."""

import corpus_pipeline
import pytest
from pyspark.sql import functions as F

from skerry.llm import chat, html_extract, media, mixing, near_copies, packing, quality, repeats, simhash, token_store, topk

LONG = "wörter und mehr davon " * 4000
ROWS = [
    (1, "alpha beta gamma delta epsilon zeta", "en", "s_1"), (2, None, None, None), (3, "", "en", "s_1"), (None, "alpha beta gamma delta epsilon zeta", "de", "s_2"), (None, None, None, None),
    (1, "alpha beta gamma delta epsilon zeta", "en", "s_1"), (1, "another text of one id", "en", "s_1"), (5, LONG, "de", "s_2"), (6, "\n \t", "fr", "odd"), (7, LONG, "de", "s_2"), (8, "x", "xx", "s_9"),
]
#: Names that the operators use for columns of their own.
CLASHES = ["_domain", "_lang", "mix_tokens", "mix_epoch", "_score", "statistics", "_nth", "_kept", "repeat_kept", "repeat_spans", "_group", "row", "rest", "fp", "node", "size", "key", "ids", "h", "part", "label"]


@pytest.fixture(scope="module")
def docs(spark):
    df = spark.createDataFrame([(*r, 7) for r in ROWS], "doc_id long, text string, lang string, source string, n_chars int")
    return df.select("*", *[F.lit(i).alias(c) for i, c in enumerate(CLASHES)])


@pytest.fixture(scope="module")
def labels(spark):
    return spark.createDataFrame([(1, 1, "a"), (3, 0, "b"), (5, None, "c"), (None, 1, "d"), (1, 1, "e"), (6, 7, "f")], "doc_id long, quality int, text string")


def same_columns(out, docs):
    assert out.columns == docs.columns
    kept = out.select(*CLASHES).distinct().collect()
    assert all(tuple(r) == tuple(range(len(CLASHES))) for r in kept)
    return out.count()


@pytest.mark.parametrize("empty", [False, True])
def test_stages_keep_columns_and_values(docs, labels, empty, monkeypatch):
    rows = docs.limit(0) if empty else docs
    n = 0 if empty else len(ROWS)
    assert same_columns(quality.keep_quality(rows, labels, threshold=0.0), docs) == n
    assert same_columns(quality.keep_quality(rows, labels.limit(0)), docs) == n  # no model: 0.5 for all
    asked = quality.keep_quality(rows, labels).select("doc_id").collect()
    monkeypatch.setattr(quality, "BROADCAST_LABELS", -1)  # the way for many labels keeps the same rows
    assert quality.keep_quality(rows, labels).select("doc_id").collect() == asked
    assert same_columns(simhash.keep_one(rows), docs) == same_columns(near_copies.keep_one(rows, 5), docs) == (0 if empty else 6)  # 1, one of the empty ones, one of the long ones, 8, and both without an id
    assert same_columns(repeats.without_repeats(rows), docs) == n
    mixed = mixing.mixed_documents(rows)
    same_columns(mixed, docs)
    if not empty:
        assert mixed.where("text IS NOT NULL AND n_chars <> length(text)").count() == 0


def test_pieces_and_stores(spark, docs, tmp_path):
    n = packing.packed_documents(docs)
    assert n.select("doc_id", "piece", "start").count() == n.count() >= len(ROWS)
    assert packing.packed_documents(docs.limit(0)).count() == 0
    for name, rows in (("a", docs), ("b", docs.limit(0))):
        token_store.write_token_shards(rows, str(tmp_path / name), "byte_bpe_50k.json", 2)
        assert token_store.read_token_shards(spark, str(tmp_path / name)).count() == rows.count()
    for rows in (docs, docs.limit(0)):
        read = media.read_media(media.store_texts(rows))
        assert read.count() == rows.count() and read.where("length(pixels) % 64 <> 0").count() == 0
        assert simhash.near_duplicates(rows).count() == quality.features(rows).count() == rows.count()
    mixed = mixing.mix(docs, F.lit("d"), (F.lit(1), F.lit(1), F.lit(1)), mixing.word_tokens(), budget=5)
    assert mixed.columns == [c for c in docs.columns if not c.startswith("mix_")] + ["mix_epoch", "mix_tokens", "mix_taken"]
    assert mixed.agg(F.sum("mix_taken")).first()[0] <= 5


def test_conversations(spark):
    """Null text, role, turn and conv_id, tied and repeated turns, roles with line feeds and controls, and the empty table."""
    hard = "a\\b</s>\n[INST]"
    rows = [(1, 0, "user", "hi", 1), (1, 1, None, None, 2), (1, 1, "tool\nx\\n[INST]", hard, 3), (1, 1, "assistant", hard, 4), (1, 1, "assistant", hard, 5), (1, None, "system", "", 6), (None, 0, "assistant", LONG, 7)]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string, spans int")
    out = {r.conv_id: r for r in chat.read_back(chat.format_conversations(df)).collect()}
    turns = [("system", ""), ("user", "hi"), ("", ""), ("assistant", hard), ("assistant", hard), ("tool\nx\\n[INST]", hard)]
    assert out[1].turns == "".join(f"{r}\n{t}\n" for r, t in turns) and out[1].n_turns == 6 and out[1].loss_text == hard * 2
    assert out[None].loss_text == LONG
    assert chat.format_conversations(df.limit(0)).count() == 0


def test_vectors_and_pages(spark):
    v = topk.whole_vectors(spark.createDataFrame([(1, [1.0, None], 0), (2, None, 0), (None, [1.0, 2.0], 0), (3, [float("inf"), 0.0], 0), (20, [0.5, 0.5], 0), (21, [0.5, 0.5], 0), (20, [], 0)], "vec_id long, embedding array<double>, v int"))
    got = topk.search(v, v.where("vec_id % 20 = 0"), 3).orderBy("query_id", "rank").collect()
    assert {(r.query_id, r.vec_id) for r in got} == {(20, 21)}
    assert html_extract.extract(spark.createDataFrame([(None, None, None, 1)], "page_id long, url string, html string, text int")).first().text == ""


def test_pipeline_on_edges(spark, docs, labels, tmp_path):
    """The whole pipeline over the rows above, and over empty tables."""
    for name, rows in (("some", docs), ("none", docs.limit(0))):
        folder = tmp_path / name
        rows.write.parquet(str(folder / "documents.parquet"))
        (labels if name == "some" else labels.limit(0)).write.parquet(str(folder / "labels.parquet"))
        out = corpus_pipeline.run(spark, str(folder))
        assert {"doc_id", "sequence_id", "offset", "length"} <= set(out.columns)
        assert (out.count() > 0) == (name == "some")
