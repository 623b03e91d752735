"""Language ID and Order MinHash."""

import hashlib
import random
import zlib

import numpy as np
import pytest

from segrec.llm import langid, order_minhash

DOCS = "doc_id bigint, text string, lang string"
VOWELS = {"aa": "the house of stone and water near old town with green hills".split(), "bb": "der hund unter schwarzen baum mit zwei kleinen katzen über".split(), "cc": "une maison très belle avec jardin près de la rivière où".split()}


def text_in(lang, rng, n=40):
    return " ".join(rng.choice(VOWELS[lang]) + rng.choice(["", "", "s"]) for _ in range(n))


@pytest.fixture(scope="module")
def model():
    rng = random.Random(1)
    return langid.fit([(lang, text_in(lang, rng)) for lang in VOWELS for _ in range(30)])


def test_forward_backward_equals_enumeration():
    rng = np.random.default_rng(2)
    emit, trans = rng.normal(size=(9, 3)), rng.normal(size=(3, 3))
    # two sequences of 5 and 4 steps, step by step
    active = np.array([2, 2, 2, 2, 1])
    got = langid._forward_backward(emit, active, trans)[0]
    offsets = np.cumsum(active) - active
    for s, n in ((0, 5), (1, 4)):
        rows = [offsets[t] + s for t in range(n)]
        want = np.zeros((n, 3))
        for code in range(3**n):
            path = [code // 3**t % 3 for t in range(n)]
            score = sum(emit[rows[t], path[t]] for t in range(n)) + sum(trans[a, b] for a, b in zip(path[:-1], path[1:], strict=True))
            for t in range(n):
                want[t, path[t]] += np.exp(score)
        assert np.allclose(got[rows], want / want.sum(axis=1, keepdims=True))


def test_words_of_switched_text_are_labelled(model):
    rng = random.Random(3)
    words = langid.words_of(text_in("aa", rng, 12) + " " + text_in("bb", rng, 12))
    labels = langid.Labeller(model).marginals([words])[0].argmax(axis=1)
    assert (labels[:10] == 0).mean() > 0.85 and (labels[14:] == 1).mean() > 0.85


def test_batches_of_any_make_up_agree(model, monkeypatch):
    rng = random.Random(4)
    texts = [text_in(rng.choice(list(VOWELS)), rng, rng.randint(1, 90)) for _ in range(40)] + ["", "12 34", "x" * 5000]
    whole = langid.Labeller(model).label(texts)
    monkeypatch.setattr(langid, "BATCH_WORDS", 25)
    monkeypatch.setattr(langid, "KEPT_WORDS", 30)
    monkeypatch.setattr(langid, "FEATURE_WORDS", 7)
    parts = langid.Labeller(model).label(texts)
    assert whole[0] == parts[0] and np.allclose(whole[1], parts[1], atol=1e-5)


def test_held_out_accuracy_on_the_tables(spark, sf):
    from segrec.llm.queries import op8_language_id

    langs = {r["doc_id"]: r["lang"] for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    rows = op8_language_id(spark, sf).collect()
    assert len(rows) == len(langs)
    assert all(r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 4 == 2) and 0 <= r["score"] <= 1 for r in rows)
    proof = [r for r in rows if r["held_out"]]
    assert sum(r["lang_pred"] == langs[r["doc_id"]] for r in proof) / len(proof) > 0.93


def test_language_takes_nulls_clashing_columns_and_empty_tables(spark, model):
    rng = random.Random(5)
    df = spark.createDataFrame([(1, None, "aa"), (2, "123 !?", None), (3, text_in("cc", rng), "x"), (None, text_in("aa", rng), "y"), (3, "Ⅷ ² 4", "z")], DOCS)
    rows = langid.annotate(df, model, pred_col="pred").collect()
    assert sorted((str(r["doc_id"]), r["lang"], r["pred"]) for r in rows if r["lang"]) == [("1", "aa", "und"), ("3", "x", "cc"), ("3", "z", "und"), ("None", "y", "aa")]
    kept = langid.keep_identified(df, model)
    assert kept.columns == df.columns and sorted(r["lang"] for r in kept.collect()) == ["x", "y"]
    none = langid.train(df.limit(0))
    assert [r["pred"] for r in langid.annotate(df, none, pred_col="pred").collect()] == ["und"] * 5
    assert langid.annotate(df.limit(0), model, pred_col="pred").count() == 0


def test_texts_of_other_types_and_places_are_read(spark, model):
    rng = random.Random(6)
    text = [text_in(lang, rng, 60) for lang in VOWELS]
    rows = [(i, text[i % 3] if i % 5 else None) for i in range(3000)]  # more than one slice of a batch
    want = {i: "und" if i % 5 == 0 else list(VOWELS)[i % 3] for i in range(3000)}
    df = spark.createDataFrame(rows, "doc_id bigint, text string").coalesce(1)
    for made in (df, df.selectExpr("doc_id", "CAST(text AS binary) AS text"), df.selectExpr("text AS TEXT", "doc_id")):
        told = langid.annotate(made, model)
        assert told.columns == [*made.columns, "lang_pred", "score"]
        assert {r["doc_id"]: r["lang_pred"] for r in told.collect()} == want
        assert {r["doc_id"] for r in langid.keep_identified(made, model).collect()} == {i for i in want if i % 5}


def test_every_language_is_learned(spark):
    rng = np.random.default_rng(4)
    letters = "abcdefghijklmnopqrstuvwxyz"
    docs = []
    for k in range(110):  # each language writes with six letters of its own choice
        own = rng.choice(list(letters), 6, replace=False)
        docs += [(1000 * k + i, " ".join("".join(rng.choice(own, 5)) for _ in range(30)), f"l{k:03}") for i in range(6)]
    df = spark.createDataFrame(docs, "doc_id bigint, text string, lang string")
    learned = langid.train(df)
    assert learned.names == sorted({lang for _, _, lang in docs}) and learned.weights.size <= langid.WEIGHTS
    rows = langid.annotate(df, learned).collect()
    assert sum(r["lang"] == r["lang_pred"] for r in rows) > 0.8 * len(rows)
    assert langid.feature_rows(4) == langid.FEATURES and langid.feature_rows(1000) * 1000 <= langid.WEIGHTS


def test_training_never_sees_held_out_rows(spark):
    rows = [(i, "only held out words" if zlib.crc32(str(i).encode()) % 4 == 2 else "alpha beta gamma", "hh" if zlib.crc32(str(i).encode()) % 4 == 2 else "tt") for i in range(60)]
    assert langid.train(spark.createDataFrame(rows, DOCS)).names == ["tt"]


# ---- Order MinHash


def brute_signature(text, spark_hash):
    """Signature by the definition; ``spark_hash`` gives the engine's hash of its arguments."""
    words = text.strip(" ").split()
    words = words or [""]
    mask, stratum_bits = (1 << 28) - 1, 6
    unsigned = lambda x: x & (1 << 64) - 1
    if len(words) < 2:
        kmers = [spark_hash([words])]
    else:
        kmers = [spark_hash([("chain", words[i], words[i + 1])]) for i in range(len(words) - 1)]
    items, seen = [], {}
    for p, h in enumerate(kmers):
        name = unsigned(h) >> 28
        occurrence = seen.get(name, 0)
        seen[name] = occurrence + 1
        items.append((unsigned(spark_hash([("item", name, occurrence)])) & ~mask | p))
    strata = {}
    for x in items:
        strata.setdefault(x >> (64 - stratum_bits), []).append(x)
    out = {}
    for s, members in strata.items():
        # order of the engine: signed numbers
        members.sort(key=lambda x: x - (1 << 64) if x >> 63 else x)
        two = sorted(members[:2], key=lambda x: x & mask)
        out[s] = tuple(x >> 28 for x in two)
    return out


def test_signatures_select_in_text_order(spark):
    rng = random.Random(6)
    texts = [" ".join(rng.choice(["red", "blue", "green", "old", "new", "stone"]) for _ in range(rng.randint(1, 60))) for _ in range(15)] + ["", "one", " two words "]
    cache = {}

    def spark_hash(args):
        key = repr(args)
        if key not in cache:
            a = args[0]
            if isinstance(a, list):
                sql = "xxhash64(array(" + ", ".join(f"'{w}'" for w in a) + "))"
            elif a[0] == "chain":
                sql = f"xxhash64(xxhash64('{a[1]}'), '{a[2]}')"
            else:
                sql = f"xxhash64({a[1]}L, {a[2]})"
            cache[key] = spark.sql(f"SELECT {sql} AS h").first()["h"]
        return cache[key]

    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts[:4] + texts[-3:])], "id int, text string")
    for r in order_minhash.with_signatures(df, {"signature": "text"}).collect():
        want = brute_signature(r["text"], spark_hash)
        got = {e >> 25: e & (1 << 25) - 1 for e in r["signature"]}
        assert got.keys() == want.keys()
        for s, names in want.items():
            sql = f"xxhash64({names[0]}L, CAST({names[1] if len(names) > 1 else 'NULL'} AS BIGINT))"
            assert got[s] == spark.sql(f"SELECT {sql} AS h").first()["h"] & (1 << 25) - 1


def test_edited_texts_and_order(spark):
    docs = [(5, "abcdefgh"), (2, "12345678901"), (9, None), (7, "xy"), (None, "first of all"), (7, "zz"), (5, "abcdefgh"), (11, "äö\U0001f600ü")]
    rows = order_minhash.fingerprint_edits(spark.createDataFrame(docs, "doc_id bigint, text string")).collect()
    assert len(rows) == len(docs)
    h = {r["text"]: r["h"] for r in spark.createDataFrame([(t or "",) for _, t in docs], "text string").selectExpr("text", "xxhash64(text, 1) AS h").collect()}
    order = sorted({(i, t or "") for i, t in docs}, key=lambda d: (d[0] is not None, d[0] or 0, h[d[1]]))
    want = {}
    for k, (i, t) in enumerate(order):
        nxt, q = order[(k + 1) % len(order)][1], len(t) // 4
        want[i, len(t), hashlib.sha256((t[: len(t) - q] + nxt[:q]).encode()).hexdigest()] = docs.count((i, t or None)) or docs.count((i, t))
    got = {}
    for r in rows:
        got[r["id"], r["n_chars"], r["edited_sha256"]] = got.get((r["id"], r["n_chars"], r["edited_sha256"]), 0) + 1
    assert got == want


def test_likeness_follows_edits(spark, sf):
    from segrec.llm.queries import op7_order_minhash

    rows = op7_order_minhash(spark, sf).collect()
    texts = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    assert len(rows) == len(texts) and all(0 <= r["near_edited"] <= 1 and 0 <= r["near_next"] <= 1 for r in rows)
    long = [r for r in rows if r["n_chars"] > 300]
    assert np.mean([r["near_edited"] > r["near_next"] for r in long]) > 0.99
    by_text = {}
    for r in rows:
        by_text.setdefault(texts[r["doc_id"]], set()).add(r["fingerprint"])
    assert all(len(v) == 1 for v in by_text.values())


def test_order_matters_and_copies_agree(spark):
    words = [f"w{i}" for i in range(200)]
    a, b = " ".join(words), " ".join(words[100:] + words[:100])
    df = spark.createDataFrame([(1, a, a), (2, a, b), (3, a, " ".join(words[:150] + ["x"] * 50))], "id int, a string, b string")
    rows = order_minhash.with_signatures(df, {"s": "a", "t": "b"}).select("id", order_minhash.likeness(order_minhash.F.col("s"), order_minhash.F.col("t")).alias("x")).collect()
    near = {r["id"]: r["x"] for r in rows}
    assert near[1] == 1 and near[2] < 0.8 and 0.1 < near[3] < 0.9


def test_minhash_takes_empty_tables_and_a_single_document(spark):
    schema = "doc_id bigint, text string"
    assert order_minhash.fingerprint_edits(spark.createDataFrame([], schema)).count() == 0
    (r,) = order_minhash.fingerprint_edits(spark.createDataFrame([(1, "abcd" * 5)], schema)).collect()
    assert r["near_next"] == 1 and r["edited_sha256"] == hashlib.sha256(("abcd" * 3 + "abc" + "abcda").encode()).hexdigest()


def test_minhash_runs_no_python_on_executors(spark, sf):
    from segrec.llm.queries import op7_order_minhash

    plan = op7_order_minhash(spark, sf)._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan and "Pandas" not in plan
