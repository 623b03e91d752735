"""Removal of passages that repeat across documents, by prefix-free parsing.

A byte goes if a ``LENGTH``-byte string that covers it also starts in a document with a smaller id.

Parsing. A rolling hash of ``TRIGGER`` bytes is a trigger where it is the least of all that one
``LENGTH``-byte window holds, so every window has its trigger, equal windows have equal ones at equal
places, and texts fall into overlapping phrases: the stretch of all consecutive windows that share a
trigger, 50 to 76 bytes. Phrases of equal bytes are one dictionary word. Every window lies whole in one
word, so to depth ``LENGTH`` (a common prefix that long is all that counts) corpus order follows from two
suffix arrays: the dictionary's suffixes of at least ``LENGTH`` bytes, sorted by their bytes, and the
parse, whose places are sorted by word and, within a word, by document. Where equal suffixes of the first
meet, the occurrences of their words in the second merge, and all but the first document's repeat. Hashes
choose triggers and candidates only; what goes is equal in its bytes.

Distribution. Documents lie in batches of bounded size and ascending id, so that "a smaller id" is an
earlier batch, or a smaller id of the same batch. Each batch parses its texts, and two rounds ask hash
buckets: (1) is a phrase's trigger with the ``SIDE`` bytes before it, or after it, also in another batch?
Every window of the phrase holds one of the two, so windows of which neither is shared are done. (2) The
distinct words of what is left go to the bucket of their trigger, which sorts its part of the dictionary
and answers with a bit for each window. A batch sends a word once, whatever the number of its copies.
An id with more than a batch of text has batches of its own, which don't cover each other.

Nulls: null text is empty. Ids are whole numbers, texts or dates; a null id is larger than any other. Rows that tie on the id
(repeated rows too) don't cover each other. Texts shorter than ``LENGTH`` bytes stay whole. An empty
table gives an empty result. Other columns are ignored and may have any names.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import DateType, IntegralType, StringType

from segrec.llm.common import materialise

LENGTH = 50
TRIGGER = 24
#: A window holds this many bytes before its trigger, or after it.
SIDE = (LENGTH - TRIGGER) // 2
#: Most windows of a phrase, and bytes of a word's row: the word, zeros, its length.
WINDOWS = LENGTH - TRIGGER + 1
ROW = 80
#: Words that are sorted at a time.
SORTED = 40_000
BATCH_BYTES = 6 << 20
BUCKET_BYTES = 16 << 20
#: First ids of batches that tasks look batches up in; with more batches, rows are joined to theirs.
EDGES = 100_000
CHUNK = 1 << 20
_PLACE = (1 << 21) - 1
_BYTES = np.random.default_rng(5).integers(1, 1 << 63, 256, np.uint64) | np.uint64(1)


def _join(a: np.ndarray, b: np.ndarray, at: int) -> np.ndarray:
    """Hashes of the strings that start with those of ``a`` and go on, ``at`` bytes later, with those of ``b``."""
    n = min(len(a), len(b) - at)
    x = a[:n] * np.uint64(0x9E3779B97F4A7C15)
    x += b[at : at + n]
    x ^= x >> np.uint64(29)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    return x


def _hashes(data: np.ndarray, sizes: tuple[int, ...]) -> list[np.ndarray]:
    """Hashes of all substrings of the given sizes, by doubling."""
    powers = [_BYTES[data]]
    while 2 << (len(powers) - 1) <= max(sizes):
        powers.append(_join(powers[-1], powers[-1], 1 << (len(powers) - 1)))
    found = []
    for size in sizes:
        h, done = None, 0
        for k in reversed(range(len(powers))):
            if size >> k & 1:
                h = powers[k] if h is None else _join(h, powers[k], done)
                done += 1 << k
        found.append(h[: max(0, len(data) - size + 1)])
    return found


def _sliding_min(x: np.ndarray, width: int) -> np.ndarray:
    size = 1
    while 2 * size <= width:
        x, size = np.minimum(x[:-size], x[size:]), 2 * size
    rest = width - size
    return np.minimum(x[: len(x) - rest], x[rest:]) if rest else x


class Batch:
    """The phrases of a batch of texts: windows ``first`` to ``last`` of document ``doc`` share the trigger at ``place``."""

    def __init__(self, rows: pd.DataFrame) -> None:
        self.texts = rows["text"].tolist()
        known = rows["id"].notna().to_numpy() if len(rows) else np.empty(0, bool)
        self.rank = np.full(len(rows), len(rows), np.int64)  # no id is larger than any
        self.rank[known] = np.unique(rows["id"].to_numpy(object)[known].astype(str), return_inverse=True)[1]
        parts: list[tuple] = []
        at = 0
        pieces = [(d, s, min(len(t), s + CHUNK + LENGTH - 1)) for d, t in enumerate(self.texts) for s in range(0, max(1, len(t) - LENGTH + 1), CHUNK)]
        while at < len(pieces):
            chunk, held = [], 0
            while at < len(pieces) and (not chunk or held + pieces[at][2] - pieces[at][1] <= CHUNK // 2):
                chunk.append(pieces[at])
                held += pieces[at][2] - pieces[at][1]
                at += 1
            self._parse(chunk, parts)
        empty = [np.empty(0, np.uint64)] * 3 + [np.empty(0, np.int32)] * 4
        self.trigger, self.left, self.right, self.doc, self.first, self.last, self.place = (np.concatenate(x) for x in zip(*parts, strict=True)) if parts else empty

    def _parse(self, chunk: list[tuple[int, int, int]], parts: list[tuple]) -> None:
        data = np.frombuffer(b"".join(self.texts[d][s:e] for d, s, e in chunk), np.uint8)
        if len(data) < LENGTH:
            return
        sizes = np.array([e - s for _, s, e in chunk])
        ends = np.cumsum(sizes)
        with np.errstate(over="ignore"):
            short, side = _hashes(data, (TRIGGER, TRIGGER + SIDE))
            mark = short ^ (short >> np.uint64(32))
            mark = (mark * np.uint64(0xD6E8FEB86659FD93)) & ~np.uint64(_PLACE) | np.arange(len(mark), dtype=np.uint64)
            place = (_sliding_min(mark, WINDOWS) & np.uint64(_PLACE)).astype(np.int64)
            n = len(place)
            valid = (np.repeat(ends, sizes)[:n] - np.arange(n)) >= LENGTH
            new = np.empty(n, bool)
            new[0] = True
            new[1:] = (place[1:] != place[:-1]) | ~valid[:-1]
            change = new | ~valid
            first = np.flatnonzero(new & valid)
            last = np.flatnonzero(valid & np.append(change[1:], True))
            at = place[first]
            left, right = side[np.maximum(at - SIDE, 0)], ~side[np.minimum(at, len(side) - 1)]
        piece = np.searchsorted(ends, first, "right")
        docs = np.array([d for d, _, _ in chunk])[piece]
        shift = (np.array([s for _, s, _ in chunk]) - (ends - sizes))[piece]  # from place in the chunk to place in the text
        parts.append((short[at], left, right, *(x.astype(np.int32) for x in (docs, first + shift, last + shift, at + shift))))

    def words(self, doc: np.ndarray, first: np.ndarray, last: np.ndarray) -> np.ndarray:
        """A row of ``ROW`` bytes for each stretch of windows: its bytes, zeros, their number."""
        found = np.zeros((len(doc), ROW), np.uint8)
        size = last - first + LENGTH
        order = np.argsort(doc, kind="stable")
        owners, begins = np.unique(doc[order], return_index=True)
        cuts = np.append(begins, len(order))
        for owner, begin, end in zip(owners, cuts[:-1], cuts[1:], strict=True):
            data, at = np.frombuffer(self.texts[owner], np.uint8), order[begin:end]
            for low in range(0, len(at), SORTED):
                part = at[low : low + SORTED]
                places = first[part, None] + np.arange(LENGTH + WINDOWS - 1)
                inside = np.arange(LENGTH + WINDOWS - 1) < size[part, None]
                found[part, : LENGTH + WINDOWS - 1] = np.where(inside, data[np.minimum(places, len(data) - 1)], 0)
        found[:, -1] = size
        return found


def _least(values: np.ndarray, groups: np.ndarray, n: int) -> np.ndarray:
    least = np.full(n, np.iinfo(np.int64).max)
    np.minimum.at(least, groups, values)
    return least


_ODD = np.random.default_rng(6).integers(1, 1 << 63, ROW // 8, np.uint64) | np.uint64(1)


def distinct_words(words: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(index of one row for each distinct word, in an order of the words alone; number of each row's word), by bytes."""
    with np.errstate(over="ignore"):
        mixed = (words.view(np.uint64) * _ODD).view(np.uint64)
        mixed ^= mixed >> np.uint64(31)
        hashed = (mixed * _ODD[::-1]).sum(axis=1, dtype=np.uint64)
    _, first, inverse = np.unique(hashed, return_index=True, return_inverse=True)
    if not np.array_equal(words[first][inverse], words):  # unlike words of equal hashes
        _, first, inverse = np.unique(words.view(f"S{ROW}").ravel(), return_index=True, return_inverse=True)
    return first, inverse


def repeats(triggers: np.ndarray, words: np.ndarray, owners: np.ndarray) -> np.ndarray:
    """For each row of the parse (trigger, word, number of its owner in the order of documents) a bit for each window: whether it also starts in a smaller owner.

    The dictionary is sorted in parts by trigger, as equal windows have equal triggers.
    """
    found = np.zeros(len(words), np.uint32)
    parts = -(-len(words) // SORTED)
    part_of = (triggers.astype(np.uint64) * np.uint64(0x9E3779B9) >> np.uint64(16)) % np.uint64(max(1, parts))
    order = np.argsort(part_of, kind="stable")
    cuts = np.searchsorted(part_of[order], np.arange(parts + 1, dtype=np.uint64))
    for low, high in zip(cuts[:-1], cuts[1:], strict=True):
        at = order[low:high]
        if not len(at):
            continue
        first, word = distinct_words(words[at])
        dictionary = words[at[first]]
        # the parse in the order of words and documents: the first document of each word
        foremost = _least(owners[at], word, len(first))
        # the dictionary's suffix array, to the depth of a window
        whole = np.arange(WINDOWS) < dictionary[:, -1:].astype(np.int64) - LENGTH + 1
        suffix_word, suffix_at = np.nonzero(whole)
        suffixes = np.lib.stride_tricks.sliding_window_view(dictionary[:, : LENGTH + WINDOWS - 1], LENGTH, axis=1)[suffix_word, suffix_at]
        suffixes = np.ascontiguousarray(suffixes).view(f"S{LENGTH}").ravel()
        array = np.argsort(suffixes, kind="stable")
        ranked = suffixes[array]
        new = np.append(True, ranked[1:] != ranked[:-1]) if len(ranked) else np.empty(0, bool)
        # both arrays combined: of each run of equal suffixes, the first document of all its words
        run = np.cumsum(new) - 1
        least = np.minimum.reduceat(foremost[suffix_word[array]], np.flatnonzero(new))[run]
        before = np.full(whole.shape, np.iinfo(np.int64).max)
        before[suffix_word[array], suffix_at[array]] = least
        found[at] = ((owners[at, None] > before[word]) << np.arange(WINDOWS)).sum(axis=1).astype(np.uint32)
    return found


class Rounds:
    """What a batch asks in each round, and what follows from the answers so far."""

    def __init__(self, rows: pd.DataFrame, answers: dict[int, np.ndarray]) -> None:
        b = self.batch = Batch(rows)
        self.asked: dict[int, tuple[np.ndarray, ...]] = {}
        rank = b.rank[b.doc] if len(b.doc) else b.doc.astype(np.int64)
        with_left, with_right = b.place - SIDE >= b.first, b.place - SIDE < b.last
        ones, others = np.flatnonzero(with_left), np.flatnonzero(with_right)
        keys, group = np.unique(np.concatenate([b.left[ones], b.right[others]]), return_inverse=True)
        self.asked[1] = (keys,)
        if 1 not in answers:
            return
        key_rank = np.concatenate([rank[ones], rank[others]])
        several = _least(key_rank, group, len(keys)) != -_least(-key_rank, group, len(keys))

        def stretches(shared: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
            """(phrase, first window, last window) of the windows whose trigger with a side is shared."""
            hit = shared[group]
            left, right = np.zeros(len(rank), bool), np.zeros(len(rank), bool)
            left[ones], right[others] = hit[: len(ones)], hit[len(ones) :]
            of = np.flatnonzero(left | right)
            low = np.where(left[of], b.first[of], np.maximum(b.first[of], b.place[of] - SIDE + 1))
            high = np.where(right[of], b.last[of], np.minimum(b.last[of], b.place[of] - SIDE))
            return of, low, high

        self.of, self.low, high = stretches(answers[1])
        words = b.words(b.doc[self.of], self.low, high)
        first, self.word = distinct_words(words)
        order = np.argsort(b.trigger[self.of[first]], kind="stable")
        place = np.empty(len(order), np.int64)
        place[order] = np.arange(len(order))
        self.word = place[self.word]
        self.asked[2] = (b.trigger[self.of[first]][order], words[first][order])
        if 2 not in answers:
            return
        told = answers[2][self.word] if len(self.word) else np.empty(0, np.uint32)
        del words
        own, own_low, own_high = stretches(several)
        found = repeats(b.trigger[own], b.words(b.doc[own], own_low, own_high), rank[own])
        doc, begin, bits = np.concatenate([b.doc[self.of], b.doc[own]]), np.concatenate([self.low, own_low]), np.concatenate([told, found])
        some = np.flatnonzero(bits)
        at, window = np.nonzero(bits[some, None] >> np.arange(WINDOWS, dtype=np.uint32) & np.uint32(1))
        self.covered = doc[some[at]], begin[some[at]].astype(np.int64) + window

    def removed(self) -> list[np.ndarray]:
        """For each text, a mask of the bytes that go."""
        doc, begin = self.covered
        order = np.argsort(doc, kind="stable")
        cuts = np.searchsorted(doc[order], np.arange(len(self.batch.texts) + 1))
        masks = []
        for text, low, high in zip(self.batch.texts, cuts[:-1], cuts[1:], strict=True):
            change = np.zeros(len(text) + 1, np.int32)
            starts = begin[order[low:high]]
            np.add.at(change, starts, 1)
            np.add.at(change, starts + LENGTH, -1)
            masks.append(np.cumsum(change, dtype=np.int32)[:-1] > 0)
        return masks


def _answers(rows: pd.DataFrame, before: int) -> dict[int, np.ndarray]:
    """Answers to a batch by round, empty for a round below ``before`` in which it asked nothing."""
    found = {k: np.empty(0, bool if k == 1 else np.uint32) for k in range(1, before)}
    for number, part in rows.groupby("round") if len(rows) else ():
        part = part.sort_values("bucket")
        if number == 1:
            found[1] = np.concatenate([np.unpackbits(np.frombuffer(x, np.uint8), count=n).astype(bool) for x, n in zip(part["bits"], part["n"], strict=True)])
        else:
            found[2] = np.frombuffer(b"".join(part["bits"]), np.uint32)
    return found


def _asker(number: int, buckets: int) -> Callable[..., pd.DataFrame]:
    shift = np.uint64(64 - buckets.bit_length() + 1)

    def ask(key: tuple, rows: pd.DataFrame, told: pd.DataFrame) -> pd.DataFrame:
        keys = Rounds(rows, _answers(told, number)).asked[number]
        where = (keys[0] >> shift).astype(np.int64) if buckets > 1 else np.zeros(len(keys[0]), np.int64)
        cuts = np.searchsorted(where, np.arange(buckets + 1))
        used = np.flatnonzero(np.diff(cuts))
        small = keys[0].astype(np.uint32)  # low bits do: a false match only asks more
        return pd.DataFrame(
            {
                "bucket": used.astype(np.int32),
                "batch": np.full(len(used), int(key[0]), np.int64),
                "sub": np.full(len(used), int(key[1]), np.int64),
                "n": np.diff(cuts)[used].astype(np.int64),
                "keys": [small[cuts[k] : cuts[k + 1]].tobytes() for k in used],
                "words": [keys[1][cuts[k] : cuts[k + 1]].tobytes() if number == 2 else b"" for k in used],
            }
        )

    def first(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        return ask(key, rows, pd.DataFrame())

    return first if number == 1 else ask


_ASKED = "bucket int, batch bigint, sub bigint, n bigint, keys binary, words binary"
_TOLD = "batch bigint, sub bigint, bucket int, round int, n bigint, bits binary"


def _answerer(number: int) -> Callable[[pd.DataFrame], pd.DataFrame]:
    def answer(rows: pd.DataFrame) -> pd.DataFrame:
        keys = np.frombuffer(b"".join(rows["keys"]), np.uint32)
        cuts = np.concatenate([[0], np.cumsum(rows["n"])])
        if number == 1:
            _, group = np.unique(keys, return_inverse=True)
            several = np.bincount(group)[group] > 1
            bits = [np.packbits(several[a:b]).tobytes() for a, b in zip(cuts[:-1], cuts[1:], strict=True)]
        else:
            words = np.frombuffer(b"".join(rows["words"]), np.uint8).reshape(-1, ROW)
            found = repeats(keys, words, np.repeat(rows["batch"].to_numpy(), rows["n"]))
            bits = [found[a:b].tobytes() for a, b in zip(cuts[:-1], cuts[1:], strict=True)]
        return pd.DataFrame({"batch": rows["batch"].to_numpy(), "sub": rows["sub"].to_numpy(), "bucket": rows["bucket"].to_numpy(), "round": np.int32(number), "n": rows["n"].to_numpy(), "bits": bits})

    return answer


def _finish(key: tuple, rows: pd.DataFrame, told: pd.DataFrame) -> pd.DataFrame:
    rounds = Rounds(rows, _answers(told, 3))
    masks = rounds.removed()
    kept = [np.frombuffer(t, np.uint8)[~m].tobytes() for t, m in zip(rounds.batch.texts, masks, strict=True)]
    return pd.DataFrame(
        {
            "id": rows["id"],
            "n_bytes": [len(t) for t in rounds.batch.texts],
            "n_removed": [int(m.sum()) for m in masks],
            "n_spans": [int((m & ~np.concatenate([[False], m[:-1]])).sum()) for m in masks],
            "kept": kept,
            "kept_sha256": [hashlib.sha256(k).hexdigest() for k in kept],
        }
    )


def sortable(df: DataFrame, id_col: str) -> tuple[Column, Column]:
    """(the id as text in the ids' own order, the id again from a column ``id`` of such texts)."""
    kind = df.schema[id_col].dataType
    if isinstance(kind, IntegralType):
        shift = F.lit(str(1 << 63)).cast("decimal(20,0)")
        return F.lpad((F.col(id_col).cast("decimal(20,0)") + shift).cast("string"), 20, "0"), (F.col("id").cast("decimal(20,0)") - shift).cast(kind)
    if isinstance(kind, StringType | DateType):  # years have four digits
        return F.col(id_col).cast("string"), F.col("id").cast(kind)
    raise TypeError(f"ids must be whole numbers, texts or dates, not {kind.simpleString()}")


def in_batches(df: DataFrame, id_col: str, text_col: str, batch_bytes: int) -> tuple[DataFrame, int]:
    """Rows (batch, sub, id as sortable text, text as bytes), batches of about ``batch_bytes`` in ascending order of ids; bytes of all texts.

    Batches are cut by running sums of bytes in the order of ids, however the ids lie. An id with more than
    ``batch_bytes`` has a batch to itself, whose rows are dealt by their text over as many ``sub`` as it needs.
    """
    rows = df.select(sortable(df, id_col)[0].alias("id"), F.coalesce(F.col(text_col).cast("binary"), F.lit(b"")).alias("text"))
    sizes = rows.groupBy("id").agg(F.sum(F.octet_length("text") + 1).cast("bigint").alias("bytes"), F.sum(F.octet_length("text")).cast("bigint").alias("own"))
    parts = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    sizes = materialise(sizes.repartitionByRange(parts, F.col("id").asc_nulls_last()).withColumn("part", F.spark_partition_id()), "sizes")
    total = sizes.agg(F.sum("own")).first()[0] or 0
    without = sizes.where("id IS NULL").agg(F.sum("bytes")).first()[0] or 0
    before = F.sum("bytes").over(Window.partitionBy("part").orderBy("id").rowsBetween(Window.unboundedPreceding, -1))
    slot = 2 * F.floor(F.coalesce(before, F.lit(0)) / batch_bytes) + (F.col("bytes") > batch_bytes).cast("bigint")
    number = F.shiftleft(F.col("part").cast("bigint"), 40) + slot
    subs = F.when(F.col("bytes") > batch_bytes, F.ceil(F.col("bytes") / batch_bytes)).otherwise(1)
    cut = sizes.where("id IS NOT NULL").select("id", number.alias("batch"), subs.cast("bigint").alias("subs"))
    last, last_subs = (1 << 62) - 1, max(1, math.ceil(without / batch_bytes))  # of rows without an id
    edges = materialise(cut.groupBy("batch").agg(F.min("id").alias("edge"), F.max("subs").alias("subs")), "edges")
    dealt = F.pmod(F.xxhash64("text"), F.col("subs")).alias("sub")
    if edges.count() <= EDGES:
        held = sorted((r["edge"], r["batch"], r["subs"]) for r in edges.collect())
        starts = np.array([e for e, _, _ in held], object)
        numbers, counts = np.array([n for _, n, _ in held], np.int64), np.array([s for _, _, s in held], np.int64)

        @F.pandas_udf("batch bigint, subs bigint")
        def batch_of(ids: pd.Series) -> pd.DataFrame:
            known = ids.notna().to_numpy()
            found = pd.DataFrame({"batch": np.full(len(ids), last, np.int64), "subs": np.full(len(ids), last_subs, np.int64)})
            at = np.searchsorted(starts, ids.to_numpy(object)[known], "right") - 1
            found.loc[known, "batch"], found.loc[known, "subs"] = numbers[at], counts[at]
            return found

        return rows.select(batch_of("id").alias("b"), "id", "text").select("b.batch", F.col("b.subs").alias("subs"), "id", "text").select("batch", dealt, "id", "text"), total
    told = cut.withColumnRenamed("id", "of")
    placed = rows.join(told, F.col("id") == F.col("of"), "left").withColumns({"batch": F.coalesce("batch", F.lit(last)), "subs": F.coalesce("subs", F.lit(last_subs))})
    return placed.select("batch", dealt, "id", "text"), total


def remove_repeats(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", batch_bytes: int = BATCH_BYTES) -> DataFrame:
    """Rows (id, n_bytes, n_removed, n_spans, kept, kept_sha256): ``kept`` holds a text's remaining bytes."""
    docs, total = in_batches(df, id_col, text_col, batch_bytes)
    buckets = 1 << max(0, math.ceil(math.log2(max(1, total / BUCKET_BYTES))))
    batch = ["batch", "sub"]
    asked = docs.groupBy(batch).applyInPandas(_asker(1, buckets), _ASKED)
    told = asked.groupBy("bucket").applyInPandas(_answerer(1), _TOLD)
    asked = docs.groupBy(batch).cogroup(told.groupBy(batch)).applyInPandas(_asker(2, buckets), _ASKED)
    told = told.unionByName(asked.groupBy("bucket").applyInPandas(_answerer(2), _TOLD))
    schema = "id string, n_bytes bigint, n_removed bigint, n_spans bigint, kept binary, kept_sha256 string"
    return docs.groupBy(batch).cogroup(told.groupBy(batch)).applyInPandas(_finish, schema).withColumn("id", sortable(df, id_col)[1])
