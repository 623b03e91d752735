"""Packing and mixing."""

import random
import zlib

import numpy as np
import pytest

from segrec.llm import mixing, packing

DOCS = "doc_id bigint, text string"


@pytest.fixture(scope="module")
def tokenizer():
    from tokenizers import Tokenizer

    return Tokenizer.from_file(packing.default_tokenizer())


ODD = [
    "It\u2019s <|endoftext|> \u00c0\u00c9 E\u0301 \ufb01 \u2167\u00b2 'S don'T\u0085a\u00a0b\x1cc \u0130I \u03a3\u0391\u03a3 \u00df x \u00adq a'llb'm9'd \u65e5\u672c\u8a9e \U0001f600\U0001f44d\U0001f3fd \x00\x01",
    "plain <|startoftext|>text<|endoftext|>",
    "Caf\u00e9 \u00bd\u00b9 \u00aa\u00ba\u00b5 1234 ,,,.. 'tis 'LL o'clock",
    "",
    "   \t\n",
]


def test_ids_are_those_of_the_library(spark, sf, tokenizer):
    texts = ODD + [r["text"] for r in spark.read.parquet(f"{sf}/documents.parquet").collect()]
    ids = packing.TextIds(None)
    for text in texts:
        assert np.frombuffer(ids.of(text.encode()), "<u4").tolist() == [*tokenizer.encode(text, add_special_tokens=False).ids, 0]


def test_kept_pieces_are_bounded(monkeypatch, tokenizer):
    monkeypatch.setattr(packing, "KEPT_PIECES", 3)
    ids = packing.TextIds(None)
    for text in ("a b c d e f g", ODD[0], "h i a"):
        assert np.frombuffer(ids.of(text.encode()), "<u4").tolist() == [*tokenizer.encode(text, add_special_tokens=False).ids, 0]
        assert len(ids) <= 3 and len(ids.chunks) <= 3


def test_pieces_and_sequences_are_a_round_trip(spark, tokenizer):
    docs = [(1, None), (2, ""), (3, "word " * 5000), (4, "Hello, world"), (None, "no id"), (5, "twice"), (5, "twice")]
    pieces = packing.token_pieces(spark.createDataFrame(docs, DOCS), capacity=128)
    packed = packing.pack(pieces, capacity=128, shard=8)
    rows = packed.collect()
    assert len(rows) == pieces.count()
    want = sorted(repr((i, [*tokenizer.encode(t or "", add_special_tokens=False).ids, 0])) for i, t in docs)
    whole = {}
    for r in sorted(rows, key=lambda r: r["piece"]):
        whole.setdefault(r["id"], []).append(r)
    assert all(r["length"] == len(r["ids"]) // 4 <= 128 for r in rows)
    long = np.concatenate([np.frombuffer(r["ids"], "<u4") for r in whole[3]]).tolist()
    assert repr((3, long)) in want and [r["start"] for r in whole[3]] == [128 * k for k in range(len(whole[3]))]
    bins = {}
    for r in rows:
        bins.setdefault(r["sequence_id"], []).append(r)
    for members in bins.values():
        members.sort(key=lambda r: r["offset"])
        ends = np.cumsum([r["length"] for r in members])
        assert ends[-1] <= 128 and [r["offset"] for r in members] == [0, *ends[:-1].tolist()]
    for r in packing.sequences(packed).collect():
        assert bytes(r["ids"]) == b"".join(bytes(m["ids"]) for m in bins[r["sequence_id"]])


def test_few_sequences_over_shards(spark):
    rng = np.random.default_rng(3)
    sizes = np.minimum(2048, rng.lognormal(6, 1.2, 3000).astype(int) + 1)
    df = spark.createDataFrame([(int(i), int(n), "x") for i, n in enumerate(sizes)], "doc_id bigint, length bigint, shard string")
    packed = packing.pack(df, shard=256)
    rows = packed.collect()
    assert packed.columns == [*df.columns, "sequence_id", "offset"] and len(rows) == 3000
    used = len({r["sequence_id"] for r in rows})
    assert used <= -(-int(sizes.sum()) // 2048) + 2


def test_exchange_empties_bins():
    bins, lengths = [[0, 1], [2, 3], [4]], [6, 3, 5, 4, 2]
    out = packing.exchange([list(b) for b in bins], lengths, 10)
    assert len(out) == 2 and all(sum(lengths[i] for i in b) == 10 for b in out)
    rng = np.random.default_rng(0)
    for _ in range(20):
        n = rng.integers(1, 60, 40)
        start = packing.best_fit(n, 64)
        end = packing.exchange([list(b) for b in start], n.tolist(), 64)
        assert sorted(i for b in end for i in b) == list(range(40)) and len(end) <= len(start)
        assert all(n[b].sum() <= 64 for b in end)


def fewest_bins(sizes, capacity):
    """The least number of bins, by trying every way."""
    best, order = len(sizes), sorted(sizes, reverse=True)

    def put(i, rooms):
        nonlocal best
        if len(rooms) >= best:
            return
        if i == len(order):
            best = len(rooms)
            return
        for room in {r for r in rooms if r >= order[i]}:
            put(i + 1, [*[r for k, r in enumerate(rooms) if k != rooms.index(room)], room - order[i]])
        put(i + 1, [*rooms, capacity - order[i]])

    put(0, [])
    return best


def test_exchange_comes_within_one_bin_of_the_optimum():
    rng, equal = np.random.default_rng(2), 0
    for _ in range(30):
        n = rng.integers(5, 40, 11)
        found = len(packing.exchange(packing.best_fit(n, 60), n.tolist(), 60))
        least = fewest_bins(n.tolist(), 60)
        assert least <= found <= least + 1
        equal += found == least
    assert equal >= 27


def test_query_uses_as_few_sequences_as_tokens_allow(spark):
    from segrec.llm.queries import op3_best_fit_packing

    rows = op3_best_fit_packing(spark, "/root/testdata/sf0.01").collect()
    fill = {}
    for r in rows:
        fill[r["sequence_id"]] = fill.get(r["sequence_id"], 0) + r["length"]
    assert max(fill.values()) <= 2048 and len(fill) == -(-sum(fill.values()) // 2048)


def test_columns_may_clash(spark):
    df = spark.createDataFrame([(k, 30 + k, "a", "b", "c", "d") for k in range(9)], "uid int, length int, row string, shard string, full string, key string")
    packed = packing.pack(df, capacity=100, shard=4)
    assert packed.columns == [*df.columns, "sequence_id", "offset"] and packed.count() == 9
    pieces = packing.token_pieces(df, "uid", "row")
    assert pieces.count() == 9


def test_packing_takes_empty_tables(spark):
    pieces = packing.token_pieces(spark.createDataFrame([], DOCS))
    assert packing.pack(pieces).count() == 0


def test_query_crc_is_that_of_the_ids(spark, sf, tokenizer):
    from segrec.llm.queries import op3_best_fit_packing

    texts = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    rows = op3_best_fit_packing(spark, sf).collect()
    pieces = {(r["doc_id"], r["piece"]): r for r in rows}
    assert len(pieces) == len(rows)
    for doc, text in texts.items():
        ids = np.array([*tokenizer.encode(text, add_special_tokens=False).ids, 0], "<u4")
        for k in range(-(-len(ids) // 2048)):
            part = ids[2048 * k : 2048 * (k + 1)]
            r = pieces.pop((doc, k))
            assert (r["start"], r["length"], r["ids_crc32"]) == (2048 * k, len(part), zlib.crc32(part.tobytes()))
    assert not pieces


# ---- mixing


def test_raking_meets_all_margins():
    tokens = np.random.default_rng(1).integers(50, 200, (4, 3, 2)).astype(float)
    targets = [np.array([0.2, 0.3, 0.25, 0.25]), np.array([0.3, 0.3, 0.4]), np.array([0.5, 0.5])]
    p = mixing.rake(tokens, targets, 0.3)
    kept = tokens * p
    assert p.max() <= 1 and abs(kept.sum() / tokens.sum() - 0.3) < 1e-6
    for axis, t in enumerate(targets):
        assert np.allclose(kept.sum(axis=tuple(a for a in range(3) if a != axis)) / kept.sum(), t, atol=1e-6)


def test_raking_bounds_probabilities_and_takes_empty_cells():
    tokens = np.array([[1000.0, 0.0], [10.0, 10.0]])
    p = mixing.rake(tokens, [np.array([0.5, 0.5]), np.array([0.5, 0.5])], 0.5)
    assert (p <= 1).all() and p[0, 1] == 0 and p[1, 1] == 1
    assert mixing.rake(np.zeros((0, 0, 0)), [np.zeros(0)] * 3, 0.5).size == 0


MIX = "doc_id bigint, text string, source string, lang string, topic string, tokens string"


def test_sample_follows_targets_and_keeps_columns(spark):
    docs = [(i, "a b c d e", "big" if i % 10 else "small", "en", "mine", None) for i in range(4000)]
    df = spark.createDataFrame(docs, MIX)
    kept = mixing.sample(df, targets={"source": {"big": 0.5, "small": 0.5}}, keep=0.15)
    rows = kept.collect()
    assert kept.columns == df.columns and {r["topic"] for r in rows} == {"mine"}
    share = sum(r["source"] == "small" for r in rows) / len(rows)
    assert abs(share - 0.5) < 0.06 and abs(len(rows) / 4000 - 0.15) < 0.03
    assert sorted(r["doc_id"] for r in rows) == sorted(r["doc_id"] for r in mixing.sample(df.repartition(7), targets={"source": {"big": 0.5, "small": 0.5}}, keep=0.15).collect())


def test_mixing_takes_nulls_and_empty_tables(spark):
    df = spark.createDataFrame([(1, None, None, None, None, None), (None, "x | y", "s", "fr", None, None), (2, "", "s", None, None, None)], MIX)
    rows = mixing.annotate(df).collect()
    assert len(rows) == 3 and all(0 <= r["probability"] <= 1 and r["kept"] is not None for r in rows)
    assert {r["topic"] for r in rows} == {"general", "tables"}
    assert mixing.annotate(df.limit(0)).count() == 0


def test_cells_raked_as_a_table_equal_those_of_the_driver(spark, monkeypatch):
    rng = np.random.default_rng(6)
    docs = [(i, "w " * int(rng.integers(1, 40)), f"s{rng.integers(0, 6)}", str(rng.choice(["en", "de", "fr"])), "t", None) for i in range(300)]
    df = spark.createDataFrame(docs, MIX)
    targets = {"source": {"s0": 0.5, "s1": 0.25, "gone": 0.25}}
    one = {r["__row"]["doc_id"]: r for r in mixing.annotate(df, targets, cycles=4, carry_text=False).collect()}
    monkeypatch.setattr(mixing, "CELLS", 0)
    two = {r["__row"]["doc_id"]: r for r in mixing.annotate(df, targets, cycles=4).collect()}
    assert one.keys() == two.keys()
    for i, r in one.items():
        assert r["probability"] == pytest.approx(two[i]["probability"]) and r["residual"] == pytest.approx(two[i]["residual"], rel=1e-3, abs=1e-9)


def test_query_meets_its_margins(spark):
    from segrec.llm.queries import op9_mixing

    rows = op9_mixing(spark, "/root/testdata/sf0.01").collect()
    assert len(rows) == spark.read.parquet("/root/testdata/sf0.01/documents.parquet").count()
    total = sum(r["tokens"] for r in rows) * mixing.KEEP
    present = {m: {} for m in mixing.MARGINS}
    for r in rows:
        for m in mixing.MARGINS:
            held = present[m].setdefault(r[m], [0.0, 0.0])
            held[0] += r["tokens"]
            held[1] += r["tokens"] * r["probability"]
    for m, values in present.items():
        goals = {v: n ** mixing.POWERS[m] for v, (n, _) in values.items() if n}
        for v, g in goals.items():
            assert values[v][1] == pytest.approx(g / sum(goals.values()) * total, rel=rows[0]["residual"] + 1e-6)


def test_given_topics_are_raked(spark):
    df = spark.createDataFrame([(i, "a b", "s", "en", "x" if i % 4 else None, None) for i in range(400)], MIX)
    rows = mixing.annotate(df, {"topic": {"x": 0.5, "unknown": 0.5}}, keep=0.4, topic_col="topic").collect()
    assert {(r["topic"], round(r["probability"], 6)) for r in rows} == {("x", round(0.2 / 0.75, 6)), ("unknown", 0.8)}


def test_rare_sources_share_a_cell(spark):
    df = spark.createDataFrame([(i, "t u v", f"s{i % 50}", "en", None, None) for i in range(500)], MIX)
    rows = mixing.annotate(df, sources=3).collect()
    assert len(rows) == 500 and len({r["probability"] for r in rows if r["__row"]["source"] not in ("s0", "s1", "s10")}) == 1


def test_tokens_and_topics_equal_patterns_on_every_text(spark):
    import re

    parts = ["LICENSE", "licence", "All Rights Reserved", "copyrightwarranty", " | ", " | | ", "a.b@http://c", "https://x", "HTTP://", "@", "1234", "12345 678", "{", "\t", "\n\n", "   ", "\u00a0", "\v\f\r", "\u0130", "\u212a", "w\u00f6rd"]
    rng = np.random.default_rng(5)
    texts = ["", " ", "\n", *parts] + ["".join(rng.choice(parts, rng.integers(1, 9))) for _ in range(400)]

    def topic(text):
        counts = [len(re.findall(p, text, re.A)) for p in (r"(?i)licen[cs]e|copyright|warranty|all rights reserved", r" \| ", r"[\w.]+@[\w.]+|https?://", r"\d{4,}")]
        return ("legal", "tables", "contact", "numbers")[counts.index(max(counts))] if max(counts) else "general"

    rows = mixing.annotate(spark.createDataFrame([(i, t, "s", "en", None, None) for i, t in enumerate(texts)], MIX)).collect()
    assert len(rows) == len(texts)
    for r in rows:
        text = r["__row"]["text"]
        assert (r["tokens"], r["topic"]) == (len(re.findall(r"\S+", text, re.A)), topic(text)), repr(text)


def test_packing_over_many_rounds_has_numbers_and_plans_of_bounded_size(spark, monkeypatch):
    rng = random.Random(9)
    rows = spark.createDataFrame([(k, rng.choice([3, 4, 5, 6, 7, 50])) for k in range(900)], "k int, length bigint")
    used = []
    for tables in (2, 1000):
        monkeypatch.setattr(packing, "TABLES", tables)
        packed = packing.pack(rows, capacity=100, shard=12)
        assert tables > 2 or packed._jdf.queryExecution().optimizedPlan().toString().count("Relation [") <= 4
        bins = {}
        for r in packed.collect():
            bins.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
        assert sum(map(len, bins.values())) == 900
        for pieces in bins.values():
            at = 0
            for offset, length in sorted(pieces):
                assert offset == at
                at += length
            assert at <= 100
        used.append(len(bins))
    assert used[0] == used[1]


def test_sequence_numbers_of_late_rounds_fit(spark):
    import pandas as pd

    base = 5000 * (10**6 << packing.SHARD_BITS)  # as after 5,000 rounds of a million shards
    told = packing._packer(10, base)((10**6 - 1,), pd.DataFrame({"uid": range(4), "length": [6, 4, 5, 3]}))
    assert told["sequence_id"].min() >= base and told["sequence_id"].nunique() == 2
