"""Filter interaction audit and conversation trie against brute force and SQL."""

import glob
import hashlib
import itertools
import os
import random
import re
import zlib

import duckdb
import pytest

from segrec.llm import filter_audit, prefix_trie, queries

DOCS, LABELS = "doc_id bigint, text string, lang string", "doc_id bigint, quality int, toxic int"


def rows_of(df):
    return sorted((tuple(r) for r in df.collect()), key=repr)


@pytest.mark.parametrize("name", ["op11_filter_audit", "op12_prefix_trie"])
def test_query_equals_sql(spark, sf, name):
    con = duckdb.connect()
    for path in glob.glob(f"{sf}/*.parquet"):
        con.execute(f"CREATE VIEW {os.path.basename(path)[:-8]} AS SELECT * FROM read_parquet('{path}')")
    found = queries.QUERIES[name](spark, sf)
    wanted = con.execute(queries.ORACLE_SQL[name])
    assert sorted(x[0] for x in wanted.description) == sorted(found.columns)
    names = [x[0] for x in wanted.description]
    assert rows_of(found.select(*names)) == sorted(wanted.fetchall(), key=repr)


# ---- audit


def failing(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    fails = len(words) < 100, 100 * len(set(words)) < 80 * len(words), 100 * len(re.findall("[A-Z]", text)) > 10 * len(text), bool(re.search(r"[#$%&*|]", text))
    return {f for f, x in zip("ABCD", fails) if x}


def brute_audit(docs, labels):
    good, toxic = ({i for i, *x in labels if i is not None and x[k] == 1} for k in (0, 1))
    seen = []
    for i, text, part in docs:
        copy = {"E"} if any(j is not None and i is not None and j < i and (t or "") == (text or "") for j, t, _ in docs) else set()
        seen.append((part or "", failing(text or "") | copy, i in good, i in toxic))
    rows = []
    for part in {x[0] for x in seen}:
        here, first = [x for x in seen if x[0] == part], []
        for order in itertools.permutations("ABCDE"):
            for k, f in enumerate(order):
                gone = [x for x in here if x[1] & set(order[:k])]
                hit = [x for x in here if f in x[1] and not x[1] & set(order[:k])]
                first.append([part, "".join(order), k + 1, len(here) - len(gone) - len(hit), len(hit), sum(f in x[1] for x in gone), sum(x[1] == {f} for x in here), sum(x[2] for x in hit), sum(x[3] for x in hit)])
        for row in first:
            row.append(sum(r[4] for r in first if r[1][r[2] - 1] == row[1][row[2] - 1]))
        rows += [tuple(r) for r in first]
    return sorted(rows, key=repr)


def some_docs():
    rng = random.Random(3)
    texts = ["", None, "a b", "A B #", "ÉÉ éa", "x\x1cy", " ".join(f"w{k}" for k in range(100)), " ".join(f"W{k % 81}" for k in range(101)), "A " * 90 + "| " + "b " * 30, "\t\n", "long " * 50_000]
    docs = [(rng.randrange(20), rng.choice(texts), rng.choice(["en", "de", None, ""])) for _ in range(80)]
    return [*docs, docs[0], docs[0], (None, texts[2], "en"), (None, texts[2], "en"), (-5, texts[2], "fr")]


@pytest.mark.parametrize("order", ["up", "down"])
def test_audit_equals_brute_force(spark, order):
    docs = some_docs()[:: 1 if order == "up" else -1]
    labels = [(3, 1, 0), (3, 0, 1), (4, 0, 0), (5, None, 1), (6, 1, None), (None, 1, 1), (99, 1, 1)]
    found = filter_audit.audit(spark.createDataFrame(docs, DOCS).repartition(5), spark.createDataFrame(labels, LABELS))
    assert rows_of(found) == brute_audit(docs, labels)


def test_audit_of_empty_tables_other_columns_and_a_hot_text(spark):
    none = spark.createDataFrame([], LABELS)
    assert filter_audit.audit(spark.createDataFrame([], DOCS), none).count() == 0
    docs = [(k, "hot", "en") for k in range(3000)]
    df = spark.createDataFrame([(*d, "mask", 7, "digest") for d in docs], f"{DOCS}, part string, n int, id string")
    rows = [r for r in filter_audit.audit(df, none).collect() if r["filter_order"] == "EABCD"]
    assert [(r["kept"], r["removed"], r["redundant"]) for r in sorted(rows, key=lambda r: r["step"])][:2] == [(1, 2999, 0), (0, 1, 2999)]


@pytest.mark.parametrize("k", [0, 1, 2, 3, 4, 5, 6])
def test_plain_changes_visit_every_order_once(k):
    order, seen = list(range(k)), {tuple(range(k))}
    for at in filter_audit.plain_changes(k):
        order[at], order[at + 1] = order[at + 1], order[at]
        assert tuple(order) not in seen
        seen.add(tuple(order))
    assert seen == set(itertools.permutations(range(k)))


# ---- trie

TURNS = "conv_id bigint, turn bigint, role string, text string"


def brute_trie(rows):
    talks = {}
    for c, turn, role, text in rows:
        if c is not None:
            talks.setdefault(c, []).append((turn is not None, turn or 0, role or "", text or ""))
    for said in talks.values():
        said.sort()
    whole = {}
    for c, said in talks.items():
        h = zlib.crc32(str(c).encode()) % 4
        head = c - (abs(c) % 20 if c >= 0 else -(abs(c) % 20))
        whole[c] = tuple(x[2:] for x in talks.get(head, [])[:h] + said[h:])
    nodes = {}
    for c, said in whole.items():
        for d in range(len(said) + 1):
            nodes.setdefault(said[:d], []).append(c)
    found = []
    for path, members in nodes.items():
        inside = [p for p in nodes if p[: len(path)] == path]
        parents = {p[:-1] for p in nodes if p}
        ends = ",".join(str(c) for c in sorted(members) if whole[c] == path)
        saved = sum((len(nodes[p]) - 1) * len(re.findall(r"[^\x20\x09-\x0D]+", p[-1][1])) for p in inside if p)
        found.append((min(members), len(path), min(nodes[path[:-1]]) if path else None, len(members), sum(len(p) == len(path) + 1 for p in inside), sum(p not in parents for p in inside), saved, hashlib.sha256(ends.encode()).hexdigest()))
    return sorted(found, key=repr)


def some_turns(seed, convs=120, alphabet=3):
    rng = random.Random(seed)
    rows = []
    for c in rng.sample(range(-40, 200), convs):
        n = rng.choice([1, 1, 2, 3, 4, 5, 9])
        rows += [(c, k, rng.choice(["user", "assistant", None]), rng.choice(["a", "b c", "", None, "d  e\tf"][:alphabet])) for k in range(n)]
    rows += [(20, None, "user", "first"), (20, 0, "a", "tie"), (20, 0, "a", "tie"), (20, 0, "", "tie"), (None, 1, "user", "nobody"), (7, 3, None, None)]
    same = [(k, f"r{k % 2}", f"turn {k}") for k in range(30)]
    for c in (1000, 1001, 1002, 1003, 1017, 2000):
        rows += [(c, *t) for t in same[: 29 if c == 1003 else 30]]
    rows += [(c, k, "u", "hot") for c in range(3000, 3200) for k in range(5)]
    rng.shuffle(rows)
    return rows


@pytest.mark.parametrize(("seed", "bits"), [(1, 12), (3, 1)])
def test_trie_equals_brute_force(spark, monkeypatch, seed, bits):
    monkeypatch.setattr(prefix_trie, "BLOCK_BITS", bits)  # small blocks: every sum and join goes over several
    rows = some_turns(seed, alphabet=2 + seed)
    df = spark.createDataFrame([(*r, 1, "x", "y") for r in rows], f"{TURNS}, c int, key string, words string").repartition(7)
    assert rows_of(prefix_trie.conversation_trie(df)) == brute_trie(rows)


def test_trie_with_heavy_parents_and_a_long_conversation(spark, monkeypatch):
    rows = [(c, k, "u", "start" if k < 4 else f"{c} {k}") for c in range(300) for k in range(6)] + [(9000, k, "u", f"w {k}") for k in range(900)] + [(9001, k, "u", f"w {k}") for k in range(900)]
    monkeypatch.setattr(prefix_trie, "BLOCK_BITS", 4)
    wanted = brute_trie(rows[:1800])
    small = prefix_trie.conversation_trie(spark.createDataFrame(rows[:1800], TURNS))
    assert rows_of(small) == wanted
    found = prefix_trie.conversation_trie(spark.createDataFrame(rows, TURNS)).where("conv_id = 9000").orderBy("depth").collect()
    h = zlib.crc32(b"9000") % 4, zlib.crc32(b"9001") % 4
    assert [r["depth"] for r in found] == list(range(1, 901)) and h
    assert {r["n_convs"] for r in found} == {2} and found[0]["saved_tokens"] == 1800 and found[-1]["saved_tokens"] == 2
    assert found[-1]["ends_sha256"] == hashlib.sha256(b"9000,9001").hexdigest()


def test_children_of_heavy_parents_are_named(spark, monkeypatch):
    parents = spark.createDataFrame([(b"p", 1, 12_000), (b"q", 2, 3)], "key binary, conv_id bigint, n_children bigint")
    children = spark.range(12_000).selectExpr("X'70' AS parent", "id").unionByName(spark.range(3).selectExpr("X'71' AS parent", "id"))
    counts = {r["parent_conv_id"]: r["count"] for r in prefix_trie._named(children, parents).groupBy("parent_conv_id").count().collect()}
    assert counts == {1: 12_000, 2: 3}


def test_trie_of_empty_tables_and_turnless_conversations(spark):
    assert prefix_trie.conversation_trie(spark.createDataFrame([], TURNS)).count() == 0
    assert prefix_trie.conversation_trie(spark.createDataFrame([(None, 1, "u", "x")], TURNS)).count() == 0
    c = next(c for c in range(1, 20) if zlib.crc32(str(c).encode()) % 4 > 0)
    rows = [(c, 0, "u", "x")]
    assert rows_of(prefix_trie.conversation_trie(spark.createDataFrame(rows, TURNS))) == brute_trie(rows)
