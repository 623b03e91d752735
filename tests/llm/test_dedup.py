"""Exact, near and passage de-duplication against brute force."""

import hashlib
import random

import numpy as np
import pytest
import xxhash

from segrec.llm import exact_dedup, pfp_dedup, simhash

DOCS = "doc_id bigint, text string"


def some_documents(seed=1, n=60):
    rng = random.Random(seed)
    words = ["".join(rng.choice("abcdéß") for _ in range(rng.randint(1, 7))) for _ in range(60)]
    passages = [" ".join(rng.choice(words) for _ in range(30)) for _ in range(4)]
    docs = []
    for i in range(n):
        parts = [" ".join(rng.choice(words) for _ in range(rng.randint(0, 40)))]
        if rng.random() < 0.6:
            parts.insert(rng.randint(0, 1), rng.choice(passages))
        docs.append((i * 3 % 101, " ".join(parts)))
    docs += [(500, docs[3][1]), (501, docs[3][1]), (502, docs[4][1]), (None, docs[4][1]), (503, None), (504, ""), (505, "x"), (505, "x"), (506, "ab" * 3000)]
    return docs


# ---- exact


def test_exact_keeps_one_row_of_each_text(spark):
    docs = some_documents()
    rows = exact_dedup.decisions(spark.createDataFrame(docs, DOCS)).collect()
    assert len(rows) == len(docs)
    groups = {}
    for i, t in docs:
        groups.setdefault(t or "", []).append(i)
    kept = {}
    for r in rows:
        text = next(t or "" for i, t in docs if i == r["id"] and hashlib.sha256((t or "").encode()).digest() == bytes(r["sha"]))
        ids = groups[text]
        assert r["group_size"] == len(ids)
        assert r["keep_id"] == max((i for i in ids if i is not None), default=None)
        kept[text] = kept.get(text, 0) + r["kept"]
        assert not r["kept"] or r["id"] == r["keep_id"]
    assert set(kept.values()) == {1}


@pytest.mark.parametrize("capacity", [2, 8, 65536])
def test_exact_is_the_same_for_any_summary_size(spark, capacity):
    docs = [(i, f"t{i % 7}" if i % 2 else "hot") for i in range(200)]
    rows = exact_dedup.decisions(spark.createDataFrame(docs, DOCS), capacity=capacity).collect()
    kept = sorted(r["id"] for r in rows if r["kept"])
    last = {}
    for i, t in docs:
        last[t] = i
    assert kept == sorted(last.values()) and len(rows) == 200


def test_exact_summary_finds_every_frequent_digest(spark):
    docs = [(i, "hot" if i % 3 == 0 else f"t{i}") for i in range(600)]
    df = spark.createDataFrame(docs, DOCS).selectExpr("doc_id AS id", "unhex(sha2(text, 256)) AS sha")
    found = exact_dedup.heavy_digests(df, 16).collect()
    assert (max(r["n"] for r in found), max(r["top_id"] for r in found)) == (200, 597)


def test_exact_carries_clashing_columns_and_takes_empty_tables(spark):
    df = spark.createDataFrame([(1, "a", "s", 1), (2, "a", "t", 2), (3, None, None, None)], "doc_id bigint, text string, sha string, rank int")
    kept = exact_dedup.keep_one(df)
    assert kept.columns == df.columns and sorted(r["doc_id"] for r in kept.collect()) == [2, 3]
    assert exact_dedup.keep_one(df.limit(0)).count() == 0 and exact_dedup.decisions(df.limit(0)).count() == 0


# ---- SimHash


def brute_fingerprint(text):
    words = (text or "").encode().lower().split()
    shingles = [b" ".join(words[i : i + 3]) for i in range(max(1, len(words) - 2))] if words else []
    hashes = [xxhash.xxh64_intdigest(s, seed=42) for s in shingles]
    return sum(1 << b for b in range(64) if sum(h >> b & 1 for h in hashes) * 2 > len(hashes))


def brute_components(prints):
    parent = list(range(len(prints)))

    def find(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i in range(len(prints)):
        for j in range(i):
            if (prints[i] ^ prints[j]).bit_count() <= 3:
                parent[find(i)] = find(j)
    return [find(i) for i in range(len(prints))]


def test_fingerprints_equal_those_of_the_definition(spark):
    docs = [*some_documents(), (900, "ÄÖ A B c"), (901, " \t\n"), (902, "one"), (903, "one TWO"), (904, "w " * 70000)]
    rows = {(r["id"], r["fp"] & (1 << 64) - 1) for r in simhash.fingerprints(spark.createDataFrame(docs, DOCS)).collect()}
    assert rows == {(i, brute_fingerprint(t)) for i, t in docs}


def test_spark_hash_is_the_one_named(spark):
    value = spark.sql("SELECT xxhash64('a b c') AS h").first()["h"]
    assert value & (1 << 64) - 1 == xxhash.xxh64_intdigest(b"a b c", seed=42)


def test_links_find_all_pairs_within_three_bits(spark):
    rng = random.Random(2)
    prints = set()
    for _ in range(25):
        base = rng.getrandbits(64)
        prints |= {base} | {base ^ sum(1 << b for b in rng.sample(range(64), rng.randint(1, 5))) for _ in range(8)}
    signed = [p - (1 << 64) if p >> 63 else p for p in prints]
    found = {(r["a"], r["b"]) for r in simhash.links(spark.createDataFrame([(p,) for p in signed], "fp bigint")).collect()}
    assert found == {(a, b) for a in signed for b in signed if a < b and ((a ^ b) & (1 << 64) - 1).bit_count() <= 3}


def test_components_match_brute_force(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text")
    rows = docs.collect()
    roots = brute_components([brute_fingerprint(r["text"]) for r in rows])
    least = {}
    for r, root in zip(rows, roots, strict=True):
        least[root] = min(least.get(root, 1 << 60), r["doc_id"])
    want = {r["doc_id"]: least[root] for r, root in zip(rows, roots, strict=True)}
    assert {r["doc_id"]: r["component_id"] for r in simhash.components(docs).collect()} == want
    kept = {r["doc_id"] for r in simhash.keep_one(docs).collect()}
    assert kept == set(want.values())


def test_long_chains_become_one_component(spark):
    edges = [(i, i + 1) for i in range(200)] + [(1000, 1001)]
    rows = simhash.connected(spark.createDataFrame(edges, "a bigint, b bigint")).collect()
    assert {r["v"]: r["c"] for r in rows} == {**{i: 0 for i in range(201)}, 1000: 1000, 1001: 1000}


def test_simhash_takes_nulls_and_empty_tables(spark):
    df = spark.createDataFrame([(1, None, 5), (2, "", 6), (None, "", 7), (None, "q r s t", 8)], "doc_id bigint, text string, fp int")
    rows = simhash.components(df).collect()
    assert sorted(((r["doc_id"], r["component_id"]) for r in rows), key=repr) == [(1, 1), (2, 1), (None, 1), (None, None)]
    kept = simhash.keep_one(df)
    assert kept.columns == df.columns and sorted(r["fp"] for r in kept.collect()) == [5, 8]
    assert simhash.components(df.limit(0)).count() == 0 and simhash.keep_one(df.limit(0)).count() == 0


# ---- passages


def brute_passages(docs, length=50):
    out, first = [], {}
    texts = [((float("inf") if i is None else i), (t or "").encode()) for i, t in docs]
    for i, t in texts:
        for p in range(len(t) - length + 1):
            w = t[p : p + length]
            first[w] = min(first.get(w, float("inf")), i)
    for (i, t), (own, _) in zip(texts, docs, strict=True):
        gone = np.zeros(len(t) + 1, int)
        for p in range(len(t) - length + 1):
            if first[t[p : p + length]] < i:
                gone[p : p + length] = 1
        spans = int((np.diff(np.concatenate([[0], gone])) == 1).sum())
        kept = bytes(b for b, g in zip(t, gone, strict=False) if not g)
        out.append((own, len(t), int(gone[: len(t)].sum()), spans, hashlib.sha256(kept).hexdigest()))
    return sorted(out, key=repr)


@pytest.mark.parametrize("batch_bytes", [500, 4000, 1 << 22])
def test_passages_equal_brute_force_for_any_batching(spark, batch_bytes):
    docs = some_documents(3)
    rows = pfp_dedup.remove_repeats(spark.createDataFrame(docs, DOCS), batch_bytes=batch_bytes).collect()
    assert sorted(((r["id"], r["n_bytes"], r["n_removed"], r["n_spans"], r["kept_sha256"]) for r in rows), key=repr) == brute_passages(docs)


def test_passages_of_real_tables(spark, sf):
    df = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text")
    docs = [(r["doc_id"], r["text"]) for r in df.collect()]
    rows = pfp_dedup.remove_repeats(df, batch_bytes=50_000).collect()
    assert sorted(((r["id"], r["n_bytes"], r["n_removed"], r["n_spans"], r["kept_sha256"]) for r in rows), key=repr) == brute_passages(docs)


def test_passages_over_chunks_of_a_long_text(spark, monkeypatch):
    monkeypatch.setattr(pfp_dedup, "CHUNK", 700)
    rng = random.Random(5)
    long = "".join(rng.choice("abcdefgh") for _ in range(5000))
    docs = [(1, long), (2, long[600:2300] + "-" + long[2500:2560]), (3, "z" * 3000), (4, "z" * 49), (5, "z" * 51)]
    rows = pfp_dedup.remove_repeats(spark.createDataFrame(docs, DOCS)).collect()
    assert sorted(((r["id"], r["n_bytes"], r["n_removed"], r["n_spans"], r["kept_sha256"]) for r in rows), key=repr) == brute_passages(docs)


def test_passages_take_empty_tables_and_equal_ids(spark):
    empty = spark.createDataFrame([], DOCS)
    assert pfp_dedup.remove_repeats(empty).count() == 0
    twice = spark.createDataFrame([(7, "m" * 80), (7, "m" * 80)], DOCS)
    assert {r["n_removed"] for r in pfp_dedup.remove_repeats(twice).collect()} == {0}


def test_near_dedup_stage_finds_pairs_of_similarity_0_8(spark):
    import corpus_pipeline as pipeline

    rng = np.random.default_rng(8)
    docs, sets = [], {}
    for i in range(150):
        words = [f"w{x}" for x in rng.integers(0, 5000, 300)]
        other = list(words)
        for at in rng.choice(300, 1 + i % 12, replace=False):
            other[at] = "changed"
        docs += [(2 * i, " ".join(words)), (2 * i + 1, " ".join(other))]
    for i, t in docs:
        w = t.split()
        sets[i] = {tuple(w[k : k + 5]) for k in range(len(w) - 4)}
    near = {i for i in range(1, 300, 2) if len(sets[i] & sets[i - 1]) >= 0.8 * len(sets[i] | sets[i - 1])}
    df = spark.createDataFrame(docs + [(None, None), (None, None)], "doc_id bigint, text string")
    rows = [r["doc_id"] for r in pipeline.drop_near_copies(spark, df, "").collect()]
    gone = set(range(300)) - set(rows)
    assert gone <= near and len(gone) >= 0.97 * len(near) > 50 and len(rows) == 302 - len(gone)


def test_chains_keep_every_pair_within_the_budget():
    rng = np.random.default_rng(3)
    differs = rng.integers(0, 3, (2000, 8))
    found = simhash.chained(differs, 7)
    assert found[differs.sum(axis=1) <= 7].all() and not found.all()
    for row, told in zip(differs[:300], found[:300], strict=True):
        ring = [*row, *row]
        assert told == any(all(sum(ring[s : s + n]) * 8 <= n * 7 for n in range(1, 9)) for s in range(8))


def test_similar_sets_share_a_key():
    rng = np.random.default_rng(11)
    for n in [1, 2, 3, 4, 5, 9, 10, 50, 300] * 20:
        one = set(rng.integers(0, 1 << 60, n).tolist())
        two = set(list(one)[int(rng.integers(0, n // 4 + 1)) :]) | set(rng.integers(0, 1 << 60, int(rng.integers(0, n // 4 + 1))).tolist())
        keys = [set(simhash.near_keys(np.array(sorted(s), np.uint64)).tolist()) for s in (one, two)]
        if len(one & two) >= 0.8 * len(one | two):
            assert keys[0] & keys[1]


def test_groups_larger_than_meet_under_a_key_become_one(spark):
    rng = np.random.default_rng(5)
    base = [f"w{x}" for x in rng.integers(0, 5000, 400)]
    docs = []
    for i in range(300):  # near copies of one text, in a chain of edits: the ends are not similar to the start
        words = list(base)
        words[i] = f"changed{i}"
        docs.append((i, " ".join(words)))
    chain, words = [], [f"v{x}" for x in rng.integers(0, 5000, 400)]
    for i in range(40):
        words[10 * i : 10 * i + 6] = [f"x{i}"] * 6
        chain.append((1000 + i, " ".join(words)))
    other = [(2000 + i, " ".join(f"o{x}" for x in rng.integers(0, 5000, 100))) for i in range(20)]
    df = spark.createDataFrame(docs + chain + other + docs[:5], "doc_id bigint, text string")
    kept = sorted(r["doc_id"] for r in simhash.keep_one_similar(df).collect())
    assert kept == [0, 0, 1000, *range(2000, 2020)]  # the first row came twice
    assert simhash.keep_one_similar(df.limit(0)).count() == 0


@pytest.mark.parametrize("edges", [0, 1000])
def test_passages_by_large_and_by_text_ids(spark, monkeypatch, edges):
    monkeypatch.setattr(pfp_dedup, "EDGES", edges)
    shared = "a passage that three documents share, of more than fifty bytes, to the end of it"
    ids = [2**53, 2**53 + 1, 2**53 + 2, -5, None]
    df = spark.createDataFrame([(i, f"{k} {shared} {k}" if i != -5 else "other", "x") for k, i in enumerate(ids)], "doc_id bigint, text string, batch string")
    rows = {r["id"]: r["n_removed"] for r in pfp_dedup.remove_repeats(df, batch_bytes=100).collect()}
    n = len(shared.encode()) + 2
    assert rows == {2**53: 0, 2**53 + 1: n, 2**53 + 2: n, -5: 0, None: n}
    rows = {r["id"]: r["n_removed"] for r in pfp_dedup.remove_repeats(df.selectExpr("'d' || doc_id AS doc_id", "text"), batch_bytes=100).collect()}
    assert rows == {f"d{2**53}": 0, f"d{2**53 + 1}": n, f"d{2**53 + 2}": n, "d-5": 0, None: n}
    with pytest.raises(TypeError):
        pfp_dedup.remove_repeats(df.selectExpr("array(doc_id) AS doc_id", "text"))


def test_words_of_equal_bytes_and_their_windows(monkeypatch):
    monkeypatch.setattr(pfp_dedup, "SORTED", 64)
    rng = np.random.default_rng(3)
    base = rng.integers(0, 3, 200, np.uint8)  # zero bytes too
    rows = np.zeros((500, pfp_dedup.ROW), np.uint8)
    for row in rows:
        size, at = int(rng.integers(50, 77)), int(rng.integers(0, 120))
        row[:size], row[-1] = base[at : at + size], size
    owners = rng.integers(0, 40, 500)
    first, word = pfp_dedup.distinct_words(rows)
    assert (rows[first][word] == rows).all() and len(first) == len({r.tobytes() for r in rows})
    triggers = np.full(500, 9, np.uint64)
    least = {}
    windows = [[r[k : k + 50].tobytes() for k in range(r[-1] - 49)] for r in rows]
    for found, owner in zip(windows, owners, strict=True):
        for w in found:
            least[w] = min(least.get(w, 99), owner)
    want = [sum((least[w] < owner) << k for k, w in enumerate(found)) for found, owner in zip(windows, owners, strict=True)]
    assert pfp_dedup.repeats(triggers, rows, owners).tolist() == want
    monkeypatch.setattr(pfp_dedup, "_ODD", np.zeros(pfp_dedup.ROW // 8, np.uint64))  # all hashes are equal
    assert pfp_dedup.repeats(triggers, rows, owners).tolist() == want


@pytest.mark.parametrize("edges", [0, 1000])
def test_one_id_with_many_rows_spreads_over_batches(spark, monkeypatch, edges):
    monkeypatch.setattr(pfp_dedup, "EDGES", edges)
    passage = "a passage that all these rows share, of more than fifty bytes to its end"
    rows = [(5, f"{passage} {k} " + "y" * 40) for k in range(60)] + [(None, f"{passage} n{k}") for k in range(60)] + [(4, "short"), (9, passage)]
    df = spark.createDataFrame(rows, DOCS)
    batches, _ = pfp_dedup.in_batches(df, "doc_id", "text", 500)
    assert batches.select("batch", "sub").distinct().count() > 10
    got = sorted(((r["id"], r["n_bytes"], r["n_removed"], r["n_spans"], r["kept_sha256"]) for r in pfp_dedup.remove_repeats(df, batch_bytes=500).collect()), key=repr)
    assert got == brute_passages(rows)


def test_slot_levels_count_all_texts(spark):
    texts = ["a b c d e f", "a b c d e f", "a b c d e", "x", ""]
    df = spark.createDataFrame([(k, t.encode()) for k, t in enumerate(texts)], "v bigint, text binary").repartition(3)
    counts = {}
    for t in texts:
        for slot in simhash._slots(simhash._shingles(t.encode(), 5)).tolist():
            counts[slot] = counts.get(slot, 0) + 1
    levels = simhash.slot_levels(df, 5)
    assert {k: n.bit_length() - 1 for k, n in counts.items()} == {k: int(levels[k]) for k in counts}
    assert levels.sum() == sum(n.bit_length() - 1 for n in counts.values())
    assert simhash.slot_levels(df.limit(0), 5).sum() == 0


def test_no_similar_pair_is_lost_in_a_crowd(spark, monkeypatch):
    """unlike texts crowd all shingles of a pair, and a text that a link drops is the only one like another."""
    monkeypatch.setattr(simhash, "IDLE_ROUNDS", 0)  # one round
    monkeypatch.setattr(simhash, "BEFORE", 1)
    if hasattr(simhash, "PACK"):
        monkeypatch.setattr(simhash, "PACK", 16)  # several blocks a shingle
    rng = np.random.default_rng(12)
    passages = [[f"p{k}_{x}" for x in range(40)] for k in range(20)]
    mix = lambda: [list(passages[k]) for k in sorted(rng.choice(20, 6, replace=False))]
    docs, sets = [(i, " ".join(sum(mix(), []))) for i in range(150)], {}
    for i in range(12):  # 12 chains of three, each like the next; the middle one links the ends
        words = sum(mix(), [])
        for k in range(3):
            changed = list(words)
            changed[: 16 * k] = [f"d{i}_{x}" for x in range(16 * k)]
            docs.append((1000 + 3 * i + k, " ".join(changed)))
    docs = [docs[k] for k in rng.permutation(len(docs))]
    for i, t in docs:
        w = t.split()
        sets[i] = {tuple(w[k : k + 5]) for k in range(len(w) - 4)}
    root = {i: i for i in sets}
    find = lambda i: i if root[i] == i else find(root[i])
    for a in sorted(sets):
        for b in sorted(sets):
            if a < b and len(sets[a] & sets[b]) >= 0.8 * len(sets[a] | sets[b]):
                one, two = sorted((find(a), find(b)))
                root[two] = one
    df = spark.createDataFrame(docs, "doc_id bigint, text string")
    kept = sorted(r["doc_id"] for r in simhash.keep_one_similar(df).collect())
    assert kept == sorted(i for i in sets if find(i) == i) and len(kept) < len(sets) - 10


def test_keys_bound_what_can_be_similar_and_lose_no_pair():
    rng = np.random.default_rng(21)
    levels, dropped = rng.integers(0, 4, simhash.SLOTS).astype(np.uint8), 0
    for k in range(3000):
        n = int(rng.integers(1, 60))
        pool = rng.integers(0, 1 << 62, 2 * n + 2, np.uint64)
        other = int(rng.integers(0, n // 2 + 1))
        one, two = np.unique(pool[:n]), np.unique(pool[other : other + n + k % 3])
        ordered = [x[np.lexsort((x, levels[simhash._slots(x)]))] for x in (one, two)]
        keys = [simhash.near_keys(x) for x in ordered]
        both = len(np.intersect1d(one, two))
        told = simhash.may_be_similar(keys[0], len(one), keys[1], len(two), 0.8, levels)
        assert told or both < 0.8 * (len(one) + len(two) - both)
        dropped += not told
    assert dropped > 500


def test_texts_that_crowd_a_passage_are_read_in_batches_and_only_if_they_can_be_similar(spark, monkeypatch):
    """pipeline: pairs that share a crowded passage of two thirds of their words had all their texts read, 10,000 pairs a batch."""
    monkeypatch.setattr(simhash, "IDLE_ROUNDS", 0)
    rng = np.random.default_rng(4)
    passage, seen, real = [f"p{x}" for x in range(160)], [], simhash._alike
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(key)
    monkeypatch.setattr(simhash, "_alike", lambda texts, near, *a: seen.append((near.count(), int(spark.conf.get(key)))) or real(texts, near, *a))
    docs = [(i, " ".join([f"o{x}" for x in rng.integers(0, 10**6, 6)] + passage[:150] + [f"o{x}" for x in rng.integers(0, 10**6, 40)])) for i in range(120)]
    df = spark.createDataFrame(docs, "doc_id bigint, text string")
    assert simhash.keep_one_similar(df).count() == 120
    assert len(seen) == 1 or seen[-1][0] < 500, seen  # of 7,140 pairs
    assert all(n <= 1024 for _, n in seen) and spark.conf.get(key) == before
