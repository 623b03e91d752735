"""Best-fit packing of tokenised documents into fixed-length sequences, improved by local search.

``token_pieces`` tokenises whole texts (public ``word_bpe_49k`` vocabulary by default; its path is a
parameter), appends id 0 and cuts only documents longer than ``capacity``. ``pack`` deals the pieces
to shards of bounded size at random; a shard is packed best-fit decreasing, then bins that aren't full
exchange documents: moves, one-for-one, one-for-two, two-for-one and two-for-two swaps out of a less
filled bin into a fuller one, each of which raises the sum of squared fills, until no exchange does or
as many bins have run empty as can (the rest hold no more than they must). Then the pieces of bins that
have room meet again, over all shards and dealt anew: by turns those of bins far from full and of all
that aren't full, until the sequences are as few as their tokens allow or ``IDLE_ROUNDS`` rounds on end
save none. A round counts only if it saves a sequence.

The vocabulary drops white space and never joins across it, so ids of a text are those of its
white-space separated chunks; a task keeps the ids of the pieces that it has met.

Nulls: null text is the empty text (one piece: id 0). Null, repeated or tied ids are carried as they
are; every row is packed. An empty table gives an empty result. ``pack`` carries all columns.
"""

from __future__ import annotations

import json
import math
import re
import unicodedata
from array import array
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from segrec.llm.common import materialise, packed_row

CAPACITY = 2048
END = 0
#: Pieces of one shard, and pieces of text whose ids a task keeps at once.
SHARD = 2048
KEPT_PIECES = 250_000
FLUSH_BYTES = 8 << 20
IDLE_ROUNDS = 4
#: Bits of a shard's numbers of sequences, and tables that hold pieces before they become one.
SHARD_BITS = 20
TABLES = 8


def default_tokenizer() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


class TextIds(dict):
    """Ids of texts; as a dict, piece of text that the vocabulary's pattern cuts -> its ids.

    Ids are little-endian unsigned 32-bit numbers. Stretches of printable Latin-1 characters and ASCII
    white space are lower-cased and cut by the vocabulary's own pattern here, and each piece, met once
    per task, goes to the library's model; the library does all for other white-space separated chunks.
    """

    def __init__(self, tokenizer: str | None) -> None:
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(tokenizer or default_tokenizer())
        rules = json.loads(self.tokenizer.to_str())
        normal = [x["type"] for x in (rules["normalizer"] or {}).get("normalizers", ())]
        split, *rest = (rules["pre_tokenizer"] or {}).get("pretokenizers", [None])
        known = normal == ["NFC", "Replace", "Lowercase"] and split["type"] == "Split" and split["invert"] and [x["type"] for x in rest] == ["ByteLevel"]
        self.cut = None
        if known:  # the library's classes as far as Latin-1 goes
            latin = {kind: "".join(c for c in map(chr, range(256)) if unicodedata.category(c)[0] == kind) for kind in "LN"}
            pattern = split["pattern"]["Regex"].replace(r"\p{L}", latin["L"]).replace(r"\p{N}", latin["N"])
            self.cut = re.compile(pattern).findall
        self.plain = re.compile("[\t-\r -~\u00a1-\u00ac\u00ae-\u00ff]*").fullmatch
        self.added = tuple(x["content"] for x in rules["added_tokens"])
        shown = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or b >= 174]
        hidden = [b for b in range(256) if b not in shown]
        self.letters = {b: b for b in shown} | {b: 256 + k for k, b in enumerate(hidden)}
        self.chunks: dict[str, bytes] = {}

    def __missing__(self, piece: str) -> bytes:
        letters = piece if piece.isascii() else piece.encode().decode("latin-1").translate(self.letters)
        found = array("I", [x.id for x in self.tokenizer.model.tokenize(letters)]).tobytes()
        if len(self) >= KEPT_PIECES:
            self.clear()
        self[piece] = found
        return found

    def _chunk(self, chunk: str) -> bytes:
        found = self.chunks.get(chunk)
        if found is None:
            found = self._plain(chunk)
            if found is None:
                found = array("I", self.tokenizer.encode(chunk, add_special_tokens=False).ids).tobytes()
            if len(self.chunks) >= KEPT_PIECES:
                self.chunks.clear()
            self.chunks[chunk] = found
        return found

    def _plain(self, text: str) -> bytes | None:
        if self.cut and self.plain(text) and not any(x in text for x in self.added):
            return b"".join(map(self.__getitem__, self.cut(text.lower())))
        return None

    def of(self, text: bytes) -> bytes:
        """Ids of a text, the end's id last."""
        found = self._plain(text.decode("utf-8", "replace"))
        if found is None:
            found = b"".join([self._chunk(x.decode("utf-8", "replace")) for x in text.split()])
        return found + END.to_bytes(4, "little")


def _pieces(tokenizer: str | None, capacity: int):
    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, names = TextIds(tokenizer), ["id", "piece", "start", "length", "ids"]
        for batch in batches:
            for low in range(0, batch.num_rows, 512):
                part = batch.slice(low, 512)
                at, start, ids, held = [], [], [], 0
                for row, text in enumerate(part.column(1)):
                    coded = known.of(text.as_py())
                    for s in range(0, len(coded), 4 * capacity):
                        at.append(row)
                        start.append(s // 4)
                        ids.append(coded[s : s + 4 * capacity])
                    held += len(coded)
                    if held > FLUSH_BYTES or row == part.num_rows - 1:
                        begin = np.array(start, np.int64)
                        length = np.array([len(x) // 4 for x in ids], np.int64)
                        columns = [part.column(0).take(pa.array(at, pa.int64())), pa.array((begin // capacity).astype(np.int32)), pa.array(begin), pa.array(length), pa.array(ids, pa.binary())]
                        yield pa.RecordBatch.from_arrays(columns, names=names)
                        at, start, ids, held = [], [], [], 0

    return cut


def token_pieces(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", tokenizer: str | None = None, capacity: int = CAPACITY) -> DataFrame:
    """Rows (id, piece, start, length, ids): ids are little-endian unsigned 32-bit numbers in a binary."""
    rows = df.select(F.col(id_col).alias("id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).cast("binary").alias("text"))
    return rows.mapInArrow(_pieces(tokenizer, capacity), f"id {df.schema[id_col].dataType.simpleString()}, piece int, start bigint, length bigint, ids binary")


def best_fit(lengths: np.ndarray, capacity: int) -> list[list[int]]:
    """Bins of indices, longest first, each into the fullest bin that holds it."""
    bins: list[list[int]] = []
    free: list[list[int]] = [[] for _ in range(capacity + 1)]  # bins by room left
    some = 0  # bit r is set if a bin has room r
    for i in np.argsort(-lengths, kind="stable").tolist():
        size = int(lengths[i])
        fits = some >> size
        if fits:
            room = size + (fits & -fits).bit_length() - 1
            b = free[room].pop()
            if not free[room]:
                some &= ~(1 << room)
            bins[b].append(i)
        else:
            room, b = capacity, len(bins)
            bins.append([i])
        room -= size
        if room:
            free[room].append(b)
            some |= 1 << room
    return bins


def _picks(members: list[int], lengths: list[int]) -> dict[int, tuple[int, ...]]:
    """Sums of none, one or two members -> such members; equal lengths count once."""
    by_length: dict[int, list[int]] = {}
    for i in members:
        by_length.setdefault(lengths[i], []).append(i)
    sizes = sorted(by_length)
    found: dict[int, tuple[int, ...]] = {0: ()}
    for k, a in enumerate(sizes):
        for b in sizes[k:]:
            if a != b or len(by_length[a]) > 1:
                found.setdefault(a + b, (by_length[a][0], by_length[b][-1]))
    found.update({a: (by_length[a][0],) for a in sizes})
    return found


class _Bins:
    """Bins with their fills and the sums of members that they can give."""

    def __init__(self, bins: list[list[int]], lengths: list[int], capacity: int) -> None:
        self.bins, self.lengths, self.capacity = bins, lengths, capacity
        self.fill = [sum(lengths[i] for i in b) for b in bins]
        self.picks: dict[int, dict[int, tuple[int, ...]]] = {}
        self.sums: dict[int, np.ndarray] = {}

    def of(self, b: int) -> np.ndarray:
        if b not in self.sums:
            self.picks[b] = _picks(self.bins[b], self.lengths)
            self.sums[b] = np.array(sorted(self.picks[b]))
        return self.sums[b]

    def give(self, low: int) -> bool:
        """The exchange out of ``low`` that fills a fuller bin most, if there is one."""
        highs = [b for b in range(len(self.bins)) if b != low and self.fill[low] <= self.fill[b] < self.capacity and self.bins[b]]
        if not highs:
            return False
        out, backs = self.of(low), [self.of(b) for b in highs]
        sizes = [len(x) for x in backs]
        back = np.concatenate(backs)
        # for each sum that comes back, the largest that fits in its place
        gains = out[np.searchsorted(out, back + np.repeat([self.capacity - self.fill[b] for b in highs], sizes), "right") - 1] - back
        best = int(gains.argmax())
        gain = int(gains[best])
        if gain <= 0:
            return False
        high = highs[int(np.searchsorted(np.cumsum(sizes), best, "right"))]
        take, give = self.picks[high][int(back[best])], self.picks[low][int(back[best]) + gain]
        self.bins[low] = [i for i in self.bins[low] if i not in give] + list(take)
        self.bins[high] = [i for i in self.bins[high] if i not in take] + list(give)
        self.fill[high] += gain
        self.fill[low] -= gain
        for b in (low, high):
            self.sums.pop(b, None)
        return True


def exchange(bins: list[list[int]], lengths: list[int], capacity: int) -> list[list[int]]:
    """Empty the least filled bins by moves and swaps into fuller ones that aren't full.

    Each exchange raises the sum of squared fills; it ends when none does, or the bins are as few as
    their contents allow.
    """
    state = _Bins(bins, lengths, capacity)
    fewest = -(-sum(state.fill) // capacity)
    left, changed = sum(1 for b in bins if b), True
    while changed and left > fewest:
        changed = False
        for low in sorted((b for b in range(len(bins)) if bins[b] and state.fill[b] < capacity), key=state.fill.__getitem__):
            while bins[low] and state.give(low):
                changed = True
            if changed and not bins[low]:
                left -= 1
                break  # the emptiest of those that are left is next
    return [b for b in bins if b]


def _packer(capacity: int, base: int):
    """Packs a shard; its sequences are numbered from ``base`` and the shard's number on."""

    def pack_shard(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        lengths = rows["length"].to_numpy()
        bins = exchange(best_fit(lengths, capacity), lengths.tolist(), capacity)
        order = np.fromiter(chain.from_iterable(bins), np.int64)
        which = np.repeat(np.arange(len(bins)), [len(b) for b in bins])
        sizes = lengths[order]
        before = np.cumsum(sizes) - sizes
        start = before[np.r_[True, which[1:] != which[:-1]]]
        room = capacity - np.bincount(which, weights=sizes)[which].astype(np.int64)
        sequence = base + (int(key[0]) << SHARD_BITS) + which  # a shard has no more bins than pieces
        return pd.DataFrame({"uid": rows["uid"].to_numpy()[order], "length": sizes, "sequence_id": sequence, "offset": before - start[which], "room": room})

    return pack_shard


def pack(pieces: DataFrame, length_col: str = "length", capacity: int = CAPACITY, shard: int = SHARD) -> DataFrame:
    """The rows of ``pieces`` with sequence_id and offset; no sequence is longer than ``capacity``."""
    rows = pieces.select(packed_row(pieces).alias("row"), F.col(length_col).cast("bigint").alias("length"), F.monotonically_increasing_id().alias("uid"))
    rows = materialise(rows, "pieces")
    now, placed, number, idle, base, tables = None, rows.select("uid", "length"), 0, 0, 0, 1
    while True:
        # by turns: bins far from full, which few exchanges may empty, and all that aren't full
        open_bins = placed if now is None else placed.where(F.col("room") > (0 if number % 2 == 0 else capacity // 16))
        left, tokens, used = open_bins.agg(F.count("*"), F.coalesce(F.sum("length"), F.lit(0)), F.lit(0) if now is None else F.count(F.when(F.col("offset") == 0, 1))).first()
        if now is not None and used <= -(-tokens // capacity):  # no packing of these has fewer
            idle += 1
        else:
            shards = max(1, math.ceil(left / shard))
            dealt = open_bins.select("uid", "length", F.pmod(F.xxhash64("uid", F.lit(number)), F.lit(shards)).alias("shard"))
            dealt = dealt.repartition(min(shards, int(pieces.sparkSession.conf.get("spark.sql.shuffle.partitions"))), "shard")
            packed = dealt.groupBy("shard").applyInPandas(_packer(capacity, base), "uid bigint, length bigint, sequence_id bigint, offset bigint, room bigint")
            packed = materialise(packed, f"packed{number}")
            base += shards << SHARD_BITS  # each round has numbers of its own
            after = packed.agg(F.count(F.when(F.col("offset") == 0, 1))).first()[0]
            if now is None or after < used:
                closed = None if now is None else placed.where(F.col("room") <= (0 if number % 2 == 0 else capacity // 16))
                placed, tables = packed if closed is None else closed.unionByName(packed), tables + 1
                if tables > TABLES:  # a plan of bounded size, however many rounds save something
                    placed, tables = materialise(placed, "placed"), 1
                now, idle = True, 0
            else:
                idle += 1
        number += 1
        if idle == IDLE_ROUNDS:
            break
    return rows.join(placed.select("uid", "sequence_id", "offset"), "uid").select("row.*", "sequence_id", "offset")


def sequences(packed: DataFrame) -> DataFrame:
    """The packed sequences (sequence_id, ids): ids of the pieces in order, of bounded length."""
    parts = F.transform(F.sort_array(F.collect_list(F.struct("offset", "ids"))), lambda x: x["ids"])
    return packed.groupBy("sequence_id").agg(F.aggregate(parts, F.lit(b""), lambda a, x: F.concat(a, x)).alias("ids"))
