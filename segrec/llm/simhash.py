"""SimHash near-duplicates by pigeonring filtering.

Fingerprint: bit b of a text's 64-bit fingerprint is 1 if bit b is set in over half of the XXH64
hashes (seed 42) of its word 3-shingles. Two fingerprints link at 3 or fewer differing bits.

Search: a fingerprint is cut into four 16-bit segments on a ring. If two fingerprints differ in at
most 3 bits, then (pigeonring principle) some segment starts a chain whose first l segments differ
in at most l * 3/4 bits for every l: no bit in the first, at most 1 in the first two, 2 in three and
3 in four. Candidates share (start, first segment, second segment up to one flipped bit); the rest of
the chain is checked on their bits before the full Hamming distance.

Near copies by similarity (``keep_one_similar``): texts whose sets of word 5-shingles have a Jaccard
similarity of 0.8 or more link. Such pairs differ in about 15 % of a fingerprint's bits, too many for
any segment of it to be equal. So candidates share a shingle among the first fifth of each text's
shingles in one order for all texts (two sets that similar must): by how many texts hold a shingle's
hash slot, in powers of two over all texts, then by hash. Passages that very many texts share come last,
so they are keys only where a text has little else. A candidate has at least 0.8 times as many shingles
as the other, or the other than it; it must then have, on a SimHash of 512
bits, a chain of segments whose cumulative differences stay within the proportional budgets of
``WIDE_BITS`` differing bits, then at most ``WIDE_BITS`` in all; what is left is compared exactly. In a
round a text meets, under each shingle, the first text and the ``BEFORE`` before it, in one order for all
shingles: that links large groups of copies by a few pairs a text. Where a shingle has more texts, those
that stay after linking meet again under it, in orders by parts of a sketch of the texts (least hashes, so
that like texts lie close together), until no shingle has more or ``IDLE_ROUNDS`` rounds after the first
find no link. Last come the pairs that no round has compared: under each shingle that more texts had in the
first round, all its texts meet in blocks, those that links dropped as well, but for texts that links connect
already. Of two texts' first shingles so many must be equal that the rest of the one whose first shingles end
earlier in the order can make up what is missing; only pairs that reach this bound, which loses none, have
their texts read. So no order, drop or number of rounds decides what is linked; only texts that are not similar
and crowd a shingle cost the square of their number, as comparisons of bits inside a block.

Nulls: null text is the empty text, whose fingerprint is zero; it links like any other. A null id is
kept, and counts as a member without a number: a component's id is its smallest non-null id (null if
none has one). Repeated rows and ties give equal rows. An empty table gives an empty result. Other
columns of the input are ignored by ``components`` and carried by ``keep_one``.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import partial

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from segrec.llm.common import batches_of, materialise, passing, spread

SEED = 42
SHINGLE = 3
MAX_BITS = 3
SEGMENTS = 4
WIDTH = 64 // SEGMENTS
_HASH = partial(xxhash.xxh64_intdigest, seed=SEED)


def fingerprint(text: bytes, shingle: int = SHINGLE) -> int:
    """Fingerprint of one UTF-8 text as an unsigned 64-bit number."""
    words = text.lower().split()  # bytes: only A-Z are lowered, only \\x20 and \\x09-\\x0D split
    if not words:
        return 0
    n = len(words) - shingle + 1
    if n < 1:
        return _HASH(b" ".join(words))
    votes = np.zeros(64, np.int64)
    for at in range(0, n, 1 << 16):  # bounded memory for very long texts
        part = words[at : min(at + (1 << 16), n) + shingle - 1]
        rows = map(b" ".join, zip(*[part[i:] for i in range(shingle)]))
        hashes = np.fromiter(map(_HASH, rows), np.uint64)
        votes += np.unpackbits(hashes.astype(">u8").view(np.uint8).reshape(-1, 8), axis=1).sum(axis=0, dtype=np.int64)
    bits = (votes * 2 > n).astype(np.uint8)
    return int.from_bytes(np.packbits(bits).tobytes(), "big")


def _fingerprint_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        prints = np.fromiter((fingerprint(x.as_py()) for x in batch.column(1)), np.uint64, batch.num_rows)
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(prints.view(np.int64))], names=["id", "fp"])


def fingerprints(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row (id, fp) for each row of ``df``; fp holds the 64 bits as a signed long."""
    kind = df.schema[id_col].dataType.simpleString()
    rows = df.select(F.col(id_col).alias("id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).cast("binary").alias("text"))
    return rows.mapInArrow(_fingerprint_batches, f"id {kind}, fp bigint")


def _segment(start: int, n: int) -> F.Column:
    """Segment ``start + n`` of the ring as a number."""
    shift = 64 - WIDTH * ((start + n) % SEGMENTS + 1)
    return F.shiftrightunsigned(F.col("fp"), shift).bitwiseAND(F.lit((1 << WIDTH) - 1))


def _keys(start: int, flips: list[int]) -> list[F.Column]:
    head = F.lit(start << (2 * WIDTH)) + _segment(start, 0) * F.lit(1 << WIDTH)
    return [head + _segment(start, 1).bitwiseXOR(F.lit(flip)) for flip in flips]


def links(prints: DataFrame) -> DataFrame:
    """Pairs (a, b), a < b, of the distinct fingerprints in column ``fp`` that differ in 1 to 3 bits; each pair once or more."""
    flips = [0] + [1 << b for b in range(WIDTH)]
    asked = prints.select("fp", F.explode(F.array(*[k for s in range(SEGMENTS) for k in _keys(s, flips)])).alias("key"))
    held = prints.select(F.col("fp").alias("other"), F.explode(F.array(*[k for s in range(SEGMENTS) for k in _keys(s, [0])])).alias("key"))
    differs = F.col("fp").bitwiseXOR(F.col("other"))
    start = F.shiftrightunsigned(F.col("key"), 2 * WIDTH).cast("int")
    three = F.lit(0)  # bits of the chain's first three segments: all but the segment before its start
    for s in range(SEGMENTS):
        last = ((1 << WIDTH) - 1) << (64 - WIDTH * ((s + SEGMENTS - 1) % SEGMENTS + 1))
        mask = ~last & ((1 << 64) - 1)
        three = F.when(start == s, F.bit_count(differs.bitwiseAND(F.lit(mask - (1 << 64) if mask >> 63 else mask)))).otherwise(three)
    chained = (three <= MAX_BITS * 3 // SEGMENTS) & (F.bit_count(differs) <= MAX_BITS)
    return asked.join(held, "key").where((F.col("fp") < F.col("other")) & chained).select(F.col("fp").alias("a"), F.col("other").alias("b"))


def connected(edges: DataFrame) -> DataFrame:
    """Rows (v, c) for each vertex of the edges (a, b): c is the smallest vertex of its component.

    Alternates large-star and small-star steps, whose edge count never grows; each round is written to
    the shared folder. A vertex of high degree is only met by map-side minima and by joins that
    adaptive execution splits.
    """
    edges = materialise(edges.distinct(), "edges")
    before = None
    while True:
        both = edges.union(edges.select("b", "a"))
        least = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
        large = both.join(least, "a").where("b > a").select(F.col("m").alias("a"), "b").where("a < b").distinct()
        down = large.select(F.col("b").alias("u"), F.col("a").alias("v"))
        least = down.groupBy("u").agg(F.min("v").alias("m"))
        small = down.join(least, "u").select(F.col("m").alias("a"), F.col("v").alias("b")).union(least.select(F.col("m").alias("a"), F.col("u").alias("b")))
        edges = materialise(small.where("a < b").distinct(), "edges")
        after = edges.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if after == before:
            break
        before = after
    return edges.select(F.col("b").alias("v"), F.col("a").alias("c")).union(edges.select(F.col("a").alias("v"), F.col("a").alias("c")).distinct())


def components(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row (id_col, fp, component_id) for each row of ``df``: the smallest id that links lead to, its own included."""
    prints = materialise(fingerprints(df, id_col, text_col), "fingerprints")
    classes = materialise(prints.groupBy("fp").agg(F.min("id").alias("first")), "classes")
    roots = connected(links(spread(classes.select("fp")))).withColumnsRenamed({"v": "fp", "c": "root"})
    rooted = classes.join(roots, "fp", "left").withColumn("root", F.coalesce("root", "fp"))
    named = rooted.groupBy("root").agg(F.min("first").alias("component_id"))
    member = rooted.join(named, "root").select("fp", "component_id")
    return prints.join(member, "fp", "left").select(F.col("id").alias(id_col), "fp", "component_id")


def keep_one(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of ``df`` whose document comes first in its component: by id, null ids last, then by a hash of the text.

    Rows that tie on both are one document, and all of them stay.
    """
    me = F.struct(F.col(id_col).isNull().alias("none"), F.col(id_col).alias("id"), F.xxhash64(F.coalesce(F.col(text_col).cast("string"), F.lit(""))).alias("h"))
    members = components(df.select(me.alias("me"), F.col(text_col).alias("text")), "me", "text")
    first = members.where("me = component_id").select(F.col("me.id").alias("__id"), F.col("me.h").alias("__h")).distinct()
    same = F.col(id_col).eqNullSafe(F.col("__id")) & (F.xxhash64(F.coalesce(F.col(text_col).cast("string"), F.lit(""))) == F.col("__h"))
    return df.join(first, same, "left_semi")


# ---- near copies by similarity, on wide fingerprints

NEAR_SHINGLE = 5
SIMILAR = 0.8
WIDE, WIDE_SEGMENTS = 512, 32  # bits of a wide fingerprint, and its segments
#: At a similarity of 0.8 about 78 of the 512 bits differ, 96 for texts of four shingles, with a deviation of 9; 256 for others.
WIDE_BITS = 140
BEFORE = 4
IDLE_ROUNDS = 2
#: Parts of a text's sketch, each one round's order, and minima in a part, of a byte each.
SKETCHES, SKETCH_BYTES = 8, 8
#: Texts of a block where all texts of a shingle meet.
PACK = 4096
#: Rows of an Arrow batch with texts, and of one with two texts a row.
BATCH, PAIR_BATCH = 1024, 128
#: Most vertices that are broadcast.
BROADCAST = 1_000_000
#: Slots in which the texts that hold a shingle are counted.
SLOTS = 1 << 18


def _shingles(text: bytes, shingle: int) -> np.ndarray:
    """Distinct hashes of a text's word shingles; one of the whole text where it has fewer words."""
    words = text.lower().split()
    n = max(len(words) - shingle + 1, 1)
    parts = []
    for at in range(0, n, 1 << 16):  # bounded memory for very long texts
        part = words[at : min(at + (1 << 16), n) + shingle - 1]
        rows = map(b" ".join, zip(*[part[i:] for i in range(shingle)])) if len(part) >= shingle else [b" ".join(part)]
        parts.append(np.unique(np.fromiter(map(_HASH, rows), np.uint64)))
    return np.unique(np.concatenate(parts))


def wide_fingerprint(hashes: np.ndarray) -> bytes:
    """A SimHash of ``WIDE`` bits over a text's distinct shingles."""
    steps = np.arange(1, WIDE // 64 + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    votes = np.zeros(WIDE, np.int64)
    for at in range(0, len(hashes), 4096):
        with np.errstate(over="ignore"):
            h = hashes[at : at + 4096, None] + steps
            h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
            h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
            h ^= h >> np.uint64(31)
        votes += np.unpackbits(h.view(np.uint8), axis=1).sum(axis=0, dtype=np.uint16)
    return np.packbits(votes * 2 > len(hashes)).tobytes()


def near_keys(hashes: np.ndarray, similar: float = SIMILAR) -> np.ndarray:
    """The first of a text's distinct shingles, in an order for all texts: two sets of the similarity ``similar`` share one of them."""
    return hashes[: len(hashes) - math.ceil(similar * len(hashes) - 1e-9) + 1]


def sketch(hashes: np.ndarray) -> bytes:
    """A byte of the least hash in each of ``SKETCHES * SKETCH_BYTES`` strata of a text's distinct shingles."""
    with np.errstate(over="ignore"):
        h = hashes * np.uint64(0x9E3779B97F4A7C15)
    stratum = (h >> np.uint64(58)).astype(np.int64) % (SKETCHES * SKETCH_BYTES)
    least = np.full(SKETCHES * SKETCH_BYTES, np.iinfo(np.uint64).max)
    np.minimum.at(least, stratum, h << np.uint64(6))
    return (least >> np.uint64(6)).astype(np.uint8).tobytes()


def _slots(hashes: np.ndarray) -> np.ndarray:
    return (hashes & np.uint64(SLOTS - 1)).astype(np.int64)


def _slot_batches(batches: Iterator[pa.RecordBatch], shingle: int) -> Iterator[pa.RecordBatch]:
    counts = np.zeros(SLOTS, np.int64)
    for batch in batches:
        for text in batch.column(0):
            np.add.at(counts, _slots(_shingles(text.as_py(), shingle)), 1)
    used = np.flatnonzero(counts)
    yield pa.RecordBatch.from_arrays([pa.array(used), pa.array(counts[used])], names=["slot", "n"])


def slot_levels(texts: DataFrame, shingle: int) -> np.ndarray:
    """For each slot the power of two of the number of shingles that texts have in it: one row a slot for the driver."""
    counts = texts.select("text").mapInArrow(partial(_slot_batches, shingle=shingle), "slot bigint, n bigint").groupBy("slot").agg(F.sum("n").alias("n"))
    levels = np.zeros(SLOTS, np.uint8)
    for row in counts.select("slot", F.floor(F.log2("n")).alias("level")).collect():
        levels[row["slot"]] = row["level"]
    return levels


def _key_batches(batches: Iterator[pa.RecordBatch], shingle: int, similar: float, levels: np.ndarray) -> Iterator[pa.RecordBatch]:
    seen: set[int] = set()
    for batch in batches:
        for low in range(0, batch.num_rows, 1024):
            part = batch.slice(low, 1024)
            fresh, keys, wide, sizes, sketches = [], [], [], [], []
            for k, v in enumerate(part.column(0).to_pylist()):  # a task tells repeated rows once
                if v not in seen:
                    seen.add(v)
                    fresh.append(k)
                    hashes = _shingles(part.column(1)[k].as_py(), shingle)
                    ordered = hashes[np.lexsort((hashes, levels[_slots(hashes)]))]
                    keys.append(near_keys(ordered, similar).view(np.int64))
                    sizes.append(len(hashes))
                    wide.append(wide_fingerprint(hashes))
                    sketches.append(sketch(hashes))
            yield pa.RecordBatch.from_arrays([part.column(0).take(pa.array(fresh, pa.int64())), pa.array(keys, pa.list_(pa.int64())), pa.array(wide, pa.binary()), pa.array(sizes, pa.int64()), pa.array(sketches, pa.binary())], names=["v", "keys", "wide", "n", "sketch"])


def chained(differs: np.ndarray, most: int) -> np.ndarray:
    """Whether some chain of segments (columns: bits that differ in each) stays within its budgets at every length."""
    m = differs.shape[1]
    ring = np.concatenate([differs, differs], axis=1)
    alive, total = np.ones(differs.shape, bool), np.zeros(differs.shape, np.int64)
    for length in range(1, m + 1):
        total += ring[:, length - 1 : length - 1 + m]
        alive &= total * m <= length * most
    return alive.any(axis=1)


def _near_batches(batches: Iterator[pa.RecordBatch], most: int) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        one, two = (np.frombuffer(b"".join(batch.column(k).to_pylist()), np.uint8).reshape(-1, WIDE // 8) for k in (2, 3))
        differs = np.bitwise_count(one ^ two).reshape(len(one), WIDE_SEGMENTS, -1).sum(axis=2, dtype=np.int64)
        at = np.flatnonzero(chained(differs, most)) if len(differs) else np.empty(0, np.int64)
        at = at[differs[at].sum(axis=1) <= most]
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1)], names=["a", "b"]).take(pa.array(at))


def _similar_batches(batches: Iterator[pa.RecordBatch], shingle: int, similar: float) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        hold = []
        for x, y in zip(batch.column(2), batch.column(3), strict=True):
            one, two = _shingles(x.as_py(), shingle), _shingles(y.as_py(), shingle)
            both = len(np.intersect1d(one, two, assume_unique=True))
            hold.append(both >= similar * (len(one) + len(two) - both))
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1)], names=["a", "b"]).filter(pa.array(hold, pa.bool_()))


def _small(vertices: DataFrame) -> DataFrame:
    """A written table of vertices, to be broadcast while it has at most ``BROADCAST`` rows (8 bytes each); joined by shuffle beyond."""
    return F.broadcast(vertices) if vertices.count() <= BROADCAST else vertices


def _round(texts: DataFrame, asked: DataFrame, wide: DataFrame, compared: DataFrame | None, number: int, shingle: int, similar: float) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(links (a, b), pairs compared, rows (v, n, key) of keys that have more texts than meet) of one round over ``asked``, such rows.

    All keys have one order in a round, so texts that share many keys meet the same few others under each. The first
    round's is by a hash; later ones are by a part of the texts' sketches, so that under a key which many unlike texts
    share like ones lie close together. Pairs that an earlier round has ``compared`` aren't compared again.
    """
    me = F.struct("v", "n")
    order = F.xxhash64("v") if number == 0 else F.col("part")
    every = Window.partitionBy("key")
    under = every.orderBy(order, F.xxhash64("v", F.lit(number)), "v")
    met = asked.select("v", "n", "key", F.array_union(F.array(F.first(me).over(under)), F.collect_list(me).over(under.rowsBetween(-BEFORE, -1))).alias("others"), (F.count("*").over(every) > BEFORE + 1).alias("more"))
    met = materialise(met.where("more OR size(others) > 1 OR others[0].v != v"), "near_met")
    like = F.least("o.n", "n") >= F.greatest("o.n", "n") * similar - 1e-9
    pairs = met.select(F.explode("others").alias("o"), "v", "n").where((F.col("o.v") != F.col("v")) & like)
    pairs = pairs.select(F.least("o.v", "v").alias("a"), F.greatest("o.v", "v").alias("b")).distinct()
    sides = pairs.join(wide.select(F.col("v").alias("a"), F.col("wide").alias("x")), "a").join(wide.select(F.col("v").alias("b"), F.col("wide").alias("y")), "b").select("a", "b", "x", "y")
    near = sides.mapInArrow(partial(_near_batches, most=WIDE_BITS), "a bigint, b bigint")
    near = materialise(near if compared is None else near.join(compared, ["a", "b"], "left_anti"), "near_pairs", lasting=True)
    return _alike(texts, near, shingle, similar), near, met.where("more").drop("others", "more")


def _alike(texts: DataFrame, near: DataFrame, shingle: int, similar: float) -> DataFrame:
    """The pairs (a, b) of ``near`` whose texts are similar: compared exactly."""
    # written first, so that its size is known: while it is small, only the texts of pairs are shuffled
    needed = materialise(near.select(F.explode(F.array("a", "b")).alias("v")).distinct(), "near_needed")
    read = materialise(texts.join(_small(needed), "v", "left_semi").dropDuplicates(["v"]), "near_texts")
    one, two = read.select(F.col("v").alias("a"), F.col("text").alias("x")), read.select(F.col("v").alias("b"), F.col("text").alias("y"))
    sides = near.join(one, "a").join(two, "b").select("a", "b", "x", "y")
    with batches_of(texts.sparkSession, PAIR_BATCH):
        return materialise(sides.mapInArrow(partial(_similar_batches, shingle=shingle, similar=similar), "a bigint, b bigint"), "near_links", lasting=True)


def _apart(group: pa.Table, most: int, similar: float) -> pa.Table:
    """Pairs (a, b) of one block or of two that pass the bounds on sizes and differing bits, and that no link connects yet."""
    i, block = group["i"][0].as_py(), group["block"].to_numpy()
    v, n, c = (group[x].to_numpy() for x in ("v", "n", "c"))
    wide = np.frombuffer(b"".join(group["wide"].to_pylist()), np.uint64).reshape(-1, WIDE // 64)
    one, two = np.flatnonzero(block == i), np.flatnonzero(block == group["j"][0].as_py())
    found = [np.empty((0, 2), np.int64)]
    for low in range(0, len(one), 256):
        x, y = one[low : low + 256, None], two[None]
        near = (c[x] != c[y]) & (np.minimum(n[x], n[y]) >= np.maximum(n[x], n[y]) * similar - 1e-9)
        if near.any():
            bits = np.zeros(near.shape, np.int64)
            for k in range(wide.shape[1]):
                bits += np.bitwise_count(wide[x, k] ^ wide[y, k])
            row, col = np.nonzero(near & (bits <= most))
            found.append(np.stack([v[x[row, 0]], v[y[0, col]]], axis=1))
    pairs = np.unique(np.sort(np.concatenate(found), axis=1), axis=0)
    return pa.table({"a": pairs[:, 0], "b": pairs[:, 1]})


def _rest(crowd: DataFrame, wide: DataFrame, links: DataFrame, compared: DataFrame, similar: float) -> DataFrame:
    """All pairs (a, b) under the keys of ``crowd``, rows (v, n, key), that are neither ``compared`` nor connected by ``links``, by bits.

    A key is dealt to blocks of about ``PACK`` texts that meet two by two. Keys whose texts are all connected have no such
    pair, and of keys with the same texts one is enough.
    """
    member = materialise(connected(links).distinct(), "near_joined")
    rows = crowd.join(member, "v", "left").select("v", "n", "key", F.coalesce("c", "v").alias("c"))
    keys = rows.groupBy("key").agg(F.count("*").alias("texts"), F.min("c").alias("low"), F.max("c").alias("high"), F.bit_xor(F.xxhash64("v")).alias("x"), F.bit_xor(F.xxhash64("v", F.lit(1))).alias("y"))
    keys = keys.where("low < high").groupBy("texts", "x", "y").agg(F.min("key").alias("key")).select("key", F.ceil(F.col("texts") / PACK).cast("int").alias("blocks"))
    keys = materialise(keys, "near_crowded")
    dealt = rows.join(_small(keys), "key").withColumn("block", F.pmod(F.xxhash64("v"), F.col("blocks")).cast("int"))
    meets = dealt.join(wide, "v").withColumn("o", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    meets = meets.select("key", F.least("block", "o").alias("i"), F.greatest("block", "o").alias("j"), "block", "v", "n", "c", "wide")
    most = WIDE_BITS
    pairs = meets.groupBy("key", "i", "j").applyInArrow(lambda group: _apart(group, most, similar), "a bigint, b bigint").distinct()
    return pairs.join(compared, ["a", "b"], "left_anti")


def may_be_similar(one: np.ndarray, n_one: int, two: np.ndarray, n_two: int, similar: float, levels: np.ndarray) -> bool:
    """Whether texts of ``n_one`` and ``n_two`` shingles with these ``near_keys`` can be similar.

    Of the one whose keys end first in the order, every shingle up to there that the other has is a key of both.
    """
    both = len(np.intersect1d(one, two, assume_unique=True))
    ends = [(levels[_slots(keys[-1:])[0]], keys[-1]) for keys in (one, two)]
    most = both + (n_one - len(one) if ends[0] <= ends[1] else n_two - len(two))
    return most >= similar * (n_one + n_two - most) - 1e-9


def _bound_batches(batches: Iterator[pa.RecordBatch], similar: float, levels: np.ndarray) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        x, y = ([v.values.to_numpy().view(np.uint64) for v in batch.column(k)] for k in (2, 4))
        hold = [may_be_similar(a, n, b, m, similar, levels) for a, n, b, m in zip(x, batch.column(3).to_pylist(), y, batch.column(5).to_pylist(), strict=True)]
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1)], names=["a", "b"]).filter(pa.array(hold, pa.bool_()))


def _bounded(pairs: DataFrame, kept: DataFrame, similar: float, levels: np.ndarray) -> DataFrame:
    """The pairs (a, b) that can be similar by their keys, of ``kept`` (v, keys, n)."""
    pairs = materialise(pairs, "near_rest")
    needed = materialise(pairs.select(F.explode(F.array("a", "b")).alias("v")).distinct(), "near_needed")
    held = materialise(kept.select("v", "keys", "n").join(_small(needed), "v", "left_semi").dropDuplicates(["v"]), "near_bounds")
    one, two = (held.select(F.col("v").alias(v), F.col("keys").alias(k), F.col("n").alias(n)) for v, k, n in (("a", "x", "n"), ("b", "y", "m")))
    sides = pairs.join(one, "a").join(two, "b").select("a", "b", "x", "n", "y", "m")
    return materialise(sides.mapInArrow(partial(_bound_batches, similar=similar, levels=levels), "a bigint, b bigint"), "near_bounded")


def similar_links(texts: DataFrame, shingle: int = NEAR_SHINGLE, similar: float = SIMILAR) -> DataFrame:
    """Pairs (a, b), a < b, of the rows (v, text) whose shingle sets have at least the Jaccard similarity ``similar``.

    They connect all texts that similarity connects, without all pairs of a group: every candidate pair
    is compared exactly, and of texts that are linked already one goes on to further rounds. What no round
    compared and no link connects meets at the end.
    """
    levels = slot_levels(texts, shingle)
    kept = materialise(texts.mapInArrow(partial(_key_batches, shingle=shingle, similar=similar, levels=levels), "v bigint, keys array<bigint>, wide binary, n bigint, sketch binary"), "near_keys")
    wide, asked = kept.select("v", "wide"), kept.select("v", "n", F.explode("keys").alias("key"))
    links, compared, crowd, number, idle = None, None, None, 0, 0
    while True:
        with passing(texts.sparkSession):
            found, near, more = _round(texts, asked, wide, compared, number, shingle, similar)
            links = found if links is None else links.unionByName(found)
            compared = near if compared is None else compared.unionByName(near)
            idle = idle + 1 if number and found.isEmpty() else 0
            if not number:
                crowd = materialise(more, "near_crowd", lasting=True)
            if more.isEmpty() or idle == IDLE_ROUNDS:
                break
            gone = connected(found).where("v != c").select("v")
            part = F.substring("sketch", 1 + number % SKETCHES * SKETCH_BYTES, SKETCH_BYTES).alias("part")
            # keys under which all texts have met stay out of further rounds
            asked = materialise(more.join(gone, "v", "left_anti").join(kept.select("v", part), "v"), "near_more", lasting=True)
            number += 1
    if crowd.isEmpty():
        return links
    with passing(texts.sparkSession):
        near = _bounded(_rest(crowd, wide, links, compared, similar), kept, similar, levels)
        return links.unionByName(_alike(texts, near, shingle, similar))


def keep_one_similar(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = NEAR_SHINGLE, similar: float = SIMILAR) -> DataFrame:
    """The rows of ``df`` whose document comes first among those that similarity links: by id, null ids last, then by a hash of id and text.

    Rows that tie on id and text are one document, and all of them stay.
    """
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    vertex = F.xxhash64(F.col(id_col), text)
    docs = df.select(vertex.alias("v"), F.struct(F.col(id_col).isNull().alias("none"), F.col(id_col).alias("id"), vertex.alias("h")).alias("me"), text.cast("binary").alias("text"))
    with passing(df.sparkSession), batches_of(df.sparkSession, BATCH):
        member = materialise(connected(similar_links(docs.select("v", "text"), shingle, similar)).distinct(), "near_members")
        member = member.join(docs.select("v", "me").distinct(), "v")
        first = member.groupBy("c").agg(F.min("me").alias("first"))
        # written first, so that its size is known: while it is small, no text is shuffled
        gone = materialise(member.join(first, "c").where("me != first").select(F.col("v").alias("__gone")), "near_gone", lasting=True)
    return df.join(_small(gone), vertex == F.col("__gone"), "left_anti")
