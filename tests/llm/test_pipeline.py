"""The pipeline's stages against brute force on what each was given."""

import corpus_pipeline as pipeline
from segrec.llm import langid, mixing
from segrec.llm.common import materialise


def shingles(text):
    words = text.lower().split()
    return {tuple(words[k : k + 5]) for k in range(max(1, len(words) - 4))}


def similar(one, two):
    return len(one & two) >= 0.8 * len(one | two)


def test_stages_take_effect_and_keep_columns(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    extra = spark.createDataFrame([(10_000, "123 456", "en", "src0", 7), (10_001, None, None, None, None)], docs.schema)
    docs = materialise(docs.union(extra), "test")
    columns = docs.columns
    for name, stage in pipeline.STAGES[:-1]:
        before = docs.collect()
        docs = materialise(stage(spark, docs, sf), name)
        after = docs.collect()
        assert docs.columns == columns and set(after) <= set(before)
        ids = {r["doc_id"] for r in after}
        if name == "language_id":
            assert not ids & {10_000, 10_001} and len(after) >= len(before) - 4
        elif name == "exact_dedup":
            last = {}
            for r in sorted(before, key=lambda r: r["doc_id"]):
                last[r["text"]] = r["doc_id"]
            assert ids == set(last.values())
        elif name == "simhash_near_dedup":
            sets = {r["doc_id"]: shingles(r["text"]) for r in before}
            linked = {i: {j for j in sets if j != i and similar(sets[i], sets[j])} for i in sets}
            for i in sets.keys() - ids:  # what goes has a text that stays among those that links lead to
                met, todo = {i}, [i]
                while todo:
                    new = linked[todo.pop()] - met
                    met |= new
                    todo += new
                assert met & ids and i != min(met)
            assert not any(linked[i] & ids for i in ids)
        else:
            assert ids == {r["doc_id"] for r in mixing.sample(spark.createDataFrame(before, docs.schema)).collect()}
            assert 0.3 < len(after) / len(before) < 0.9
    pieces = pipeline.STAGES[-1][1](spark, docs, sf).collect()
    assert {r["doc_id"] for r in pieces} == ids
    fill = {}
    for r in pieces:
        fill[r["sequence_id"]] = fill.get(r["sequence_id"], 0) + r["length"]
    assert max(fill.values()) <= 2048


def test_run_gives_packed_pieces(spark, sf):
    rows = pipeline.run(spark, sf)
    assert rows.columns == ["doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"]
    assert rows.count() > 50


def test_language_stage_keeps_clean_short_texts(spark, sf):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    model = langid.train(docs)
    assert langid.keep_identified(docs, model).count() >= 0.998 * docs.count()
