"""Order MinHash fingerprints, with DataFrame functions only.

The k-mers of a text are its runs of ``K`` neighbouring words, numbered by occurrence: the second "of
the" is another item than the first. A hash deals the items to ``STRATA`` strata (one permutation for
all); in each stratum the two items of smallest hash are selected, put back in text order, and the
pair is hashed. A signature holds (stratum, pair hash) for every stratum with items. Two texts agree in
a stratum if they select the same items in the same order, so the likeness, agreeing strata over
strata that either fills, falls with moves and replacements alike: it follows edit distance.

All of a text's work is done in its own row: arrays are sorted, never shuffled.

Nulls: null text is empty. An empty text, or one of fewer than ``K`` words, has its whole word sequence
as its only item, so signatures are never empty and equal texts agree fully. Documents follow by
ascending id, a null id first; rows that tie on the id follow by a hash of their text; rows that tie on
both are one document for this order, and one row each in the result. An only document is followed by
itself. An empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from segrec.llm.common import materialise, text_or_empty

K = 2
STRATA_BITS = 6
#: Low bits of a packed item hold its word position, the others its hash.
POSITION_BITS = 28
_POSITION = (1 << POSITION_BITS) - 1
_PAIR = (1 << (31 - STRATA_BITS)) - 1


def _packed(hashed: Column, position: Column) -> Column:
    return hashed.bitwiseAND(F.lit(~_POSITION)).bitwiseOR(position.cast("bigint").bitwiseAND(F.lit(_POSITION)))


def _name(item: Column) -> Column:
    return F.shiftrightunsigned(item, POSITION_BITS)


def _stratum(item: Column) -> Column:
    return F.shiftrightunsigned(item, 64 - STRATA_BITS)


def with_signatures(df: DataFrame, texts: dict[str, str]) -> DataFrame:
    """``df`` with a signature (array of ints) for each text column: ``texts`` maps new names to those columns."""
    kept = [c for c in df.columns]

    def step(rows: DataFrame, make) -> DataFrame:
        return rows.select(*kept, *[make(name).alias(f"__{name}") for name in texts])

    def column(name: str) -> Column:
        return F.col(f"__{name}")

    def kmers(name: str) -> Column:
        words, n = column(name), F.size(column(name))
        runs = F.slice(words, 1, n - K + 1)
        for k in range(1, K):
            runs = F.zip_with(runs if k > 1 else F.transform(runs, lambda w: F.xxhash64(w)), F.slice(words, k + 1, n - K + 1), lambda h, w: F.xxhash64(h, w))
        return F.when(n < K, F.array(F.xxhash64(words))).otherwise(runs)

    def run_starts(name: str) -> Column:
        items = column(name)
        first = lambda i: (i == 0) | (_name(F.get(items, i)) != _name(F.get(items, i - 1)))
        return F.filter(F.sequence(F.lit(0), F.size(items) - 1), first)

    def numbered(name: str) -> Column:
        items, starts = column(name), F.col(f"__{name}_starts")
        size = lambda s, j: F.coalesce(F.get(starts, j + 1), F.size(items)) - s
        item = lambda x, occurrence: _packed(F.xxhash64(_name(x), occurrence), x)
        return F.sort_array(F.flatten(F.transform(starts, lambda s, j: F.transform(F.slice(items, s + 1, size(s, j)), item))))

    def signature(name: str) -> Column:
        items = column(name)

        def pair(x: Column, i: Column) -> Column:
            before, after = F.get(items, i - 1), F.get(items, i + 1)
            other = F.when(_stratum(after) == _stratum(x), after)
            swapped = other.bitwiseAND(F.lit(_POSITION)) < x.bitwiseAND(F.lit(_POSITION))
            hashed = F.when(swapped, F.xxhash64(_name(other), _name(x))).otherwise(F.xxhash64(_name(x), _name(other)))
            entry = F.shiftleft(_stratum(x), 31 - STRATA_BITS).bitwiseOR(hashed.bitwiseAND(F.lit(_PAIR))).cast("int")
            return F.when((i == 0) | (_stratum(before) != _stratum(x)), entry)

        return F.filter(F.transform(items, pair), lambda e: e.isNotNull())

    rows = df.select(*kept, *[F.split(F.trim(F.col(text)), r"\s+").alias(f"__{name}") for name, text in texts.items()])
    rows = step(rows, lambda name: F.sort_array(F.transform(kmers(name), lambda h, i: _packed(h, i))))
    rows = rows.select(*rows.columns, *[run_starts(name).alias(f"__{name}_starts") for name in texts])
    rows = step(step(rows, numbered), signature)
    return rows.withColumnsRenamed({f"__{name}": name for name in texts})


def likeness(a: Column, b: Column) -> Column:
    """Agreeing strata over the strata that either signature fills, 0 to 1."""
    strata = lambda s: F.transform(s, lambda e: F.shiftright(e, 31 - STRATA_BITS))
    return F.size(F.array_intersect(a, b)) / F.size(F.array_union(strata(a), strata(b)))


def as_text(signature: Column) -> Column:
    return F.array_join(F.transform(signature, lambda e: F.lpad(F.hex(e.cast("bigint")), 8, "0")), "")


def followers(documents: DataFrame) -> DataFrame:
    """Rows (id, h, n_chars, before_id, before_h, before_chars) of distinct documents (id, h, n_chars): the one before, the first's is the last."""
    parts = int(documents.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ranged = documents.repartitionByRange(parts, F.col("id").asc_nulls_first(), F.col("h")).withColumn("part", F.spark_partition_id())
    ranged = materialise(ranged, "order")
    me = F.struct("id", "h", "n_chars")
    # the last document of each part, as many rows as there are parts
    lasts = {r["part"]: r["me"] for r in ranged.groupBy("part").agg(F.max(me).alias("me")).collect()}
    before = [(p, *lasts[sorted(lasts)[k - 1]]) for k, p in enumerate(sorted(lasts))]
    kind = documents.schema["id"].dataType.simpleString()
    edge = documents.sparkSession.createDataFrame(before, f"part int, e_id {kind}, e_h bigint, e_chars bigint")
    order = Window.partitionBy("part").orderBy(F.col("id").asc_nulls_first(), "h")
    lagged = ranged.select("id", "h", "n_chars", "part", F.lag(me).over(order).alias("b")).join(F.broadcast(edge), "part")
    at = lambda name, other: F.when(F.col("b").isNull(), F.col(other)).otherwise(F.col(f"b.{name}"))
    return lagged.select("id", "h", "n_chars", at("id", "e_id").alias("before_id"), at("h", "e_h").alias("before_h"), at("n_chars", "e_chars").alias("before_chars"))


def fingerprint_edits(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Signatures of each text and of its edited text, whose last quarter is replaced by the start of the next document.

    Rows (id, n_chars, edited_sha256, signature, edited_signature, near_edited, near_next).
    """
    text = text_or_empty(text_col)
    docs = df.select(F.col(id_col).alias("id"), F.xxhash64(text, F.lit(1)).alias("h"), text.alias("text"))
    counts = docs.groupBy("id", "h", F.length("text").cast("bigint").alias("n_chars")).agg(F.count("*").cast("int").alias("copies"))
    counts = materialise(counts, "documents")
    order = materialise(followers(counts.select("id", "h", "n_chars")), "followers")

    def same(a: str, b: str) -> Column:
        return F.col(f"{a}_id").eqNullSafe(F.col(f"{b}_id")) & (F.col(f"{a}_h") == F.col(f"{b}_h"))

    texts = docs.select(F.col("id").alias("own_id"), F.col("h").alias("own_h"), "text")
    # each document sends its start to the document before it
    sent = texts.join(order.withColumnsRenamed({"id": "o_id", "h": "o_h"}), same("own", "o")).select(
        F.col("before_id").alias("to_id"), F.col("before_h").alias("to_h"), F.col("own_id").alias("next_id"), F.col("own_h").alias("next_h"), F.expr("substring(text, 1, int(before_chars div 4))").alias("head")
    )
    met = texts.join(sent.dropDuplicates(["to_id", "to_h"]), same("own", "to"))
    n = F.length("text")
    edited = F.concat(F.expr("substring(text, 1, length(text) - length(text) div 4)"), F.col("head"))
    rows = met.select("own_id", "own_h", "next_id", "next_h", n.cast("bigint").alias("n_chars"), "text", edited.alias("edited"))
    rows = with_signatures(rows, {"signature": "text", "edited_signature": "edited"})
    rows = rows.select("own_id", "own_h", "next_id", "next_h", "n_chars", F.sha2("edited", 256).alias("edited_sha256"), "signature", "edited_signature")
    rows = materialise(rows, "signatures")
    following = rows.select(F.col("own_id").alias("f_id"), F.col("own_h").alias("f_h"), F.col("signature").alias("next_signature")).dropDuplicates(["f_id", "f_h"])
    return rows.join(following, same("next", "f")).select(
        F.col("own_id").alias("id"),
        "n_chars",
        "edited_sha256",
        "signature",
        "edited_signature",
        likeness(F.col("signature"), F.col("edited_signature")).alias("near_edited"),
        likeness(F.col("signature"), F.col("next_signature")).alias("near_next"),
    )
