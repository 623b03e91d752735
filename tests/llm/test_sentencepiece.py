"""SentencePiece encoding and decoding against the library."""

import hashlib
import random

import numpy as np
import pytest
import sentencepiece

from segrec.llm import queries, sentencepiece_bpe

PARTS = ["the", "ing", "window", "mine", "Ut", "e", " ", "  ", "\n", "\t", "\r\n", "漢", "字", "é", "ß", "𓀀", "▁", "aa", "<0x0A>", "<s>", "<unk>", "==", "01", "пос", "́", "\x00", "..."]


@pytest.fixture(scope="module")
def library():
    return sentencepiece.SentencePieceProcessor(model_file=sentencepiece_bpe.default_model())


def some_texts(n=1500):
    rng = random.Random(4)
    texts = ["".join(rng.choice(PARTS) for _ in range(rng.randint(0, 40))) for _ in range(n)]
    texts += [x * k for x in (" ", "a", "ing", "window", "=", "▁ ") for k in (1, 2, 3, 15, 16, 17, 33, 100)]
    return texts + ["", " ", "x" * 9000, " " * 9000 + "end", "".join(rng.choice("abcdefgh") for _ in range(20_000)), "字" * 7000]


def encoded(texts):
    known = sentencepiece_bpe.pieces(None)
    windows = [list(known.windows(("▁" + t.replace(" ", "▁")).encode())) if t else [] for t in texts]
    flat = iter(known.encode([w for x in windows for w in x]))
    return [[i for _ in x for i in next(flat).tolist()] for x in windows]


@pytest.mark.parametrize(("window", "long"), [(1 << 20, 4096), (50, 4096), (1 << 20, 4)])
def test_ids_are_the_library_s_in_any_window_and_by_heap(library, monkeypatch, window, long):
    monkeypatch.setattr(sentencepiece_bpe, "WINDOW", window)
    monkeypatch.setattr(sentencepiece_bpe, "LONG", long)
    texts = some_texts(400)
    assert encoded(texts) == [library.encode(t) for t in texts]


def test_any_ids_decode_as_the_library_does(library):
    rng, known = random.Random(2), sentencepiece_bpe.pieces(None)
    for _ in range(3000):
        ids = [rng.randrange(32_000) if rng.random() < 0.5 else rng.randrange(262) for _ in range(rng.randint(0, 12))]
        assert known.decode(np.array(ids, np.int32)).decode() == library.decode(ids)


def test_rows_with_nulls_repeats_and_clashing_columns(spark, library):
    texts = [*some_texts(200), None, "twice", "twice"]
    docs = [(None if k == 5 else k // 2, t, "other", 1) for k, t in enumerate(texts)]
    df = spark.createDataFrame(docs, "doc_id bigint, text string, id string, ids int").repartition(3)
    rows = sentencepiece_bpe.decode(sentencepiece_bpe.encode(df)).collect()
    want = sorted((str(i), library.encode(t or ""), library.decode(library.encode(t or ""))) for i, t, _, _ in docs)
    assert sorted((str(r["id"]), r["ids"], r["decoded"]) for r in rows) == want


def test_string_ids_null_ids_lists_and_empty_tables(spark):
    rows = sentencepiece_bpe.encode(spark.createDataFrame([("a", "x y")], "key string, body string"), "key", "body")
    assert rows.first()["id"] == "a"
    none = spark.createDataFrame([(1, None), (2, [])], "id bigint, ids array<int>")
    assert [r["decoded"] for r in sentencepiece_bpe.decode(none).collect()] == ["", ""]
    assert sentencepiece_bpe.decode(sentencepiece_bpe.encode(spark.createDataFrame([], "doc_id bigint, text string"))).count() == 0


def test_output_in_several_flushes_keeps_rows(spark, library, monkeypatch):
    known, texts = sentencepiece_bpe.pieces(None), some_texts(60)
    monkeypatch.setattr(sentencepiece_bpe, "FLUSH", 300)
    import pyarrow as pa

    batch = pa.RecordBatch.from_arrays([pa.array(range(len(texts))), pa.array([t.encode() for t in texts])], names=["id", "text"])
    found = list(sentencepiece_bpe._encode_batches(iter([batch]), None, pa.int64()))
    assert len(found) > 3 and [i for b in found for i in b.column(0).to_pylist()] == list(range(len(texts)))
    assert [i for b in found for i in b.column(1).to_pylist()] == [library.encode(t) for t in texts]
    assert known is sentencepiece_bpe.pieces(None)


def test_query_tells_the_library_s_digests(spark, sf, library):
    rows = {r["doc_id"]: r for r in queries.op13_sentencepiece(spark, sf).collect()}
    docs = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()
    assert len(rows) == len(docs)
    for doc_id, text in docs:
        ids = library.encode(text or "")
        want = hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256(library.decode(ids).encode()).hexdigest()
        assert (rows[doc_id]["n_tokens"], rows[doc_id]["ids_sha256"], rows[doc_id]["decoded_sha256"]) == (len(ids), *want)
