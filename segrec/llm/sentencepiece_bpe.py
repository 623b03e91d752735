"""SentencePiece byte-pair encoding and decoding by vectorised merge rounds.

``encode`` gives the ids that the sentencepiece library gives for a whole text (no begin or end ids, no
sampling), ``decode`` the text that its ``decode(ids)`` gives. The vocabulary is a BPE model without
user-defined symbols that leaves text as it is (identity normalisation, a space put in front, spaces
shown as ``\\u2581``); its path is a parameter, and other kinds of model raise.

Texts of about ``FLUSH`` bytes are encoded together. A text is cut wherever no piece of the vocabulary
holds the two characters in succession: no merge can cross such a place, so the parts between ("words")
are encoded apart, and each distinct word of a flush once. Their symbols lie in one flat array. A round
finds, for all words at once, the least rank among a word's neighbouring pairs (rank: the score of the
piece that the pair makes, best first, equal scores equal), merges it and drops the symbols merged away;
words without a pair leave, until none remains. Where no pair that the new piece can form ranks as well
as it, all pairs of the least rank merge at once, from the left and without overlap, as the library would
one after the other; else only the leftmost does. Words of more than ``LONG`` symbols take the same merges
from a heap, as rounds over them would cost the square of their length. Characters without a piece become
one id for each UTF-8 byte.

Nulls: null text is the empty text, which has no ids; null ids decode to the empty text. Null, repeated or
tied document ids are carried as they are, one row for each row. An empty table gives an empty result. Very
long texts are encoded in windows of about ``WINDOW`` bytes that end where no merge crosses; only a text's
own ids and text are held whole. Other columns of the input are ignored.
"""

from __future__ import annotations

import codecs
import heapq
from collections.abc import Iterator
from functools import lru_cache, partial

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from segrec.llm.common import text_or_empty

SPACE = "▁"
FLUSH = 4 << 20
WINDOW = 1 << 20
LONG = 4096
_NONE = np.iinfo(np.int32).max


def default_model() -> str:
    import public_tokenizers

    return public_tokenizers.path("piece_bpe_32k.model")


class Pieces:
    """A model's pieces as arrays: which pairs merge to what, and at what rank."""

    def __init__(self, path: str) -> None:
        from sentencepiece import SentencePieceProcessor

        model = SentencePieceProcessor(model_file=path)
        probe = " a  ﬁ éÅ\t\n　x "
        if model.normalize(probe) != SPACE + probe.replace(" ", SPACE) or not model.is_byte(model.piece_to_id("<0x0A>")):
            raise ValueError("only models with identity normalisation, a leading space and byte fallback are known")
        n = self.size = model.vocab_size()
        special = np.array([model.is_control(i) or model.is_unknown(i) or model.is_unused(i) or model.is_byte(i) for i in range(n)])
        names = [model.id_to_piece(i) for i in range(n)]
        normal = {names[i]: i for i in range(n) if not special[i]}
        order = np.unique([-model.get_score(i) for i in normal.values()], return_inverse=True)[1]
        rank = np.full(n, _NONE, np.int32)
        rank[list(normal.values())] = order
        pairs = [(normal[p[:k]], normal[p[k:]], i) for p, i in normal.items() for k in range(1, len(p)) if p[:k] in normal and p[k:] in normal]
        left, right, made = np.array(sorted(pairs), np.int64).reshape(-1, 3).T
        self.keys, self.made, self.rank = left * n + right, made.astype(np.int32), rank
        # ranks of pieces that go on to form a piece of the same or a better rank, so that rounds merge them one at a time
        self.careful = np.zeros(len(order) + 1, bool)
        for part in (left, right):
            self.careful[rank[part[rank[made] <= rank[part]]]] = True
        letters = sorted({c for p in normal if len(p) > 1 for c in p})
        self.letter = np.zeros(0x110000, np.int32)  # 0: in no piece of several characters
        self.letter[[ord(c) for c in letters]] = np.arange(1, len(letters) + 1)
        self.joins = np.zeros((len(letters) + 1, len(letters) + 1), bool)
        for p in normal:
            at = self.letter[[ord(c) for c in p]]
            self.joins[at[:-1], at[1:]] = True
        self.joins[0] = self.joins[:, 0] = False
        self.single = np.full(0x110000, -1, np.int32)
        for p, i in normal.items():
            if len(p) == 1:
                self.single[ord(p)] = i
        self.byte = np.array([model.piece_to_id(f"<0x{b:02X}>") for b in range(256)], np.int32)
        shown = [b"" if model.is_control(i) else b" \xe2\x81\x87 " if model.is_unknown(i) else names[i].replace(SPACE, " ").encode() for i in range(n)]
        for b, i in enumerate(self.byte):
            shown[i] = bytes([b])
        self.shown = np.frombuffer(b"".join(shown), np.uint8)
        self.ends = np.cumsum([len(x) for x in shown])
        self.starts = self.ends - [len(x) for x in shown]
        self.silent = np.array([not x for x in shown])
        self.spaced = np.array([x.startswith(SPACE) for x in names]) & ~special

    def pair(self, left: np.ndarray, right: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(rank, piece) of neighbouring symbols; rank ``_NONE`` where they don't merge. Negative symbols have no piece."""
        key = left.astype(np.int64) * self.size + right
        at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
        made = self.made[at]
        hit = (self.keys[at] == key) & (left >= 0) & (right >= 0)
        return np.where(hit, self.rank[made], _NONE), made

    def cuts(self, points: np.ndarray) -> np.ndarray:
        """Positions between code points that no piece spans: position k is before code point k."""
        letter = self.letter[points]
        return np.flatnonzero(~self.joins[letter[:-1], letter[1:]]) + 1

    # ---- merging

    def merge(self, points: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(symbols, symbols of each word) of the words that begin at ``starts`` in ``points``; a negative symbol is a code point, -1 - it."""
        lengths = np.diff(np.append(starts, len(points)))
        single = self.single[points]
        symbol = np.where(single < 0, -1 - points.astype(np.int64), single).astype(np.int32)
        word = np.repeat(np.arange(len(starts)), lengths)
        done_word, done_symbol = [], []
        for w in np.flatnonzero(lengths > LONG):
            merged = self._by_heap(symbol[starts[w] : starts[w] + lengths[w]])
            done_word.append(np.full(len(merged), w))
            done_symbol.append(merged)
        live = lengths[word] <= LONG
        symbol, word = symbol[live], word[live]
        if len(symbol):
            rank, made = self.pair(symbol, np.append(symbol[1:], np.int32(-1)))
            rank[:-1][word[:-1] != word[1:]] = _NONE
        while len(symbol):
            first = np.flatnonzero(np.append(True, word[1:] != word[:-1]))
            best = np.repeat(np.minimum.reduceat(rank, first), np.diff(np.append(first, len(word))))
            live = best != _NONE
            if not live.all():
                done_word.append(word[~live])
                done_symbol.append(symbol[~live])
                symbol, word, rank, made, best = symbol[live], word[live], rank[live], made[live], best[live]
                if not len(symbol):
                    break
            at = np.flatnonzero(rank == best)
            lone = np.append(True, word[at[1:]] != word[at[:-1]])  # the leftmost of its word
            run = np.maximum.accumulate(np.where(np.append(True, at[1:] != at[:-1] + 1), np.arange(len(at)), 0))
            at = at[np.where(self.careful[rank[at]], lone, (np.arange(len(at)) - run) % 2 == 0)]
            symbol[at] = made[at]
            keep = np.ones(len(symbol), bool)
            keep[at + 1] = False
            at = at - np.arange(len(at))  # their places once those merged away are gone
            symbol, word, rank, made = symbol[keep], word[keep], rank[keep], made[keep]
            touched = np.concatenate([at, at[at > 0] - 1])
            after = np.minimum(touched + 1, len(symbol) - 1)
            fresh, into = self.pair(symbol[touched], symbol[after])
            fresh[(after == touched) | (word[touched] != word[after])] = _NONE
            rank[touched], made[touched] = fresh, into
        word, symbol = np.concatenate(done_word), np.concatenate(done_symbol)
        return symbol[np.argsort(word, kind="stable")], np.bincount(word, minlength=len(starts))

    def _by_heap(self, symbols: np.ndarray) -> np.ndarray:
        """The merges of one long word, best rank first, then leftmost."""
        symbol, n = symbols.tolist(), len(symbols)
        before, after = list(range(-1, n - 1)), list(range(1, n + 1))
        rank, made = self.pair(symbols[:-1], symbols[1:])
        heap = [(r, k, symbol[k], symbol[k + 1], m) for k, (r, m) in enumerate(zip(rank.tolist(), made.tolist())) if r != _NONE]
        heapq.heapify(heap)
        known: dict[tuple[int, int], tuple[int, int]] = {}

        def push(k: int) -> None:
            pair = symbol[k], symbol[after[k]]
            if pair not in known:
                r, m = self.pair(np.array(pair[:1]), np.array(pair[1:]))
                known[pair] = int(r[0]), int(m[0])
            if known[pair][0] != _NONE:
                heapq.heappush(heap, (known[pair][0], k, *pair, known[pair][1]))

        while heap:
            _, k, x, y, m = heapq.heappop(heap)
            j = after[k]
            if symbol[k] != x or j >= n or symbol[j] != y:
                continue  # one of the two has merged with another
            symbol[k], symbol[j], after[k] = m, None, after[j]
            if after[k] < n:
                before[after[k]] = k
                push(k)
            if before[k] >= 0:
                push(before[k])
        return np.array([x for x in symbol if x is not None], np.int32)

    def ids(self, symbols: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Symbols as ids, those without a piece as the ids of their bytes; and the ids of each word."""
        lost = symbols < 0
        if not lost.any():
            return symbols, counts
        points = -1 - symbols[lost].astype(np.int64)
        data = np.frombuffer(points.astype("<u4").tobytes().decode("utf-32-le").encode(), np.uint8)
        size = np.ones(len(symbols), np.int64)
        size[lost] = 1 + (points >= 0x80) + (points >= 0x800) + (points >= 0x10000)
        ids, bare = np.repeat(symbols, size), np.repeat(lost, size)
        ids[bare] = self.byte[data]
        return ids, np.bincount(np.repeat(np.arange(len(counts)), counts), size, len(counts)).astype(np.int64)

    # ---- texts

    def windows(self, text: bytes) -> Iterator[bytes]:
        """Parts of a text, spaces shown, that no merge crosses."""
        at, size = 0, WINDOW
        while len(text) - at > size:
            end = at + size
            while text[end] & 0xC0 == 0x80:
                end -= 1
            part = text[at:end]
            found = self.cuts(_points(part))
            if len(found):
                part = part.decode()[: found[-1]].encode()
                yield part
                at, size = at + len(part), WINDOW
            else:
                size *= 2  # no place to cut: a longer window
        yield text[at:]

    def encode(self, parts: list[bytes]) -> list[np.ndarray]:
        """Ids of each of the windows ``parts``."""
        data = b"".join(parts)
        points = _points(data)
        ends = np.cumsum(1 + (points >= 0x80) + (points >= 0x800) + (points >= 0x10000))  # in bytes
        bounds = np.cumsum([0, *map(len, parts)])
        begins = np.union1d(np.append(0, ends[self.cuts(points) - 1]), bounds[:-1])
        offsets = np.append(begins, len(data)).astype(np.int32)
        words = pa.StringArray.from_buffers(len(begins), pa.py_buffer(offsets), pa.py_buffer(data)).dictionary_encode()
        distinct, which = words.dictionary, words.indices.to_numpy()
        sizes = np.diff(np.frombuffer(distinct.buffers()[1], np.int32)[: len(distinct) + 1])
        raw = np.frombuffer(distinct.buffers()[2], np.uint8)[: sizes.sum()]
        heads = np.cumsum(np.append(0, (raw & 0xC0) != 0x80))[np.cumsum(sizes) - sizes]
        ids, counts = self.ids(*self.merge(_points(raw.tobytes()), heads))
        first = np.cumsum(counts) - counts
        many = counts[which]
        total = np.append(0, np.cumsum(many))
        flat = ids[np.repeat(first[which] - total[:-1], many) + np.arange(total[-1])]
        edges = total[np.append(np.searchsorted(begins, bounds[:-1]), len(begins))]
        return [flat[a:b] for a, b in zip(edges[:-1], edges[1:])]

    def decode(self, ids: np.ndarray) -> bytes:
        """The text of ``ids`` in UTF-8; a byte that is in no character becomes U+FFFD."""
        heard = np.flatnonzero(~self.silent[ids]) if len(ids) else ids
        if not len(heard):
            return b""
        size = self.ends[ids] - self.starts[ids]
        total = np.cumsum(size)
        text = self.shown[np.repeat(self.starts[ids] - total + size, size) + np.arange(total[-1])].tobytes()
        text = text[1:] if self.spaced[ids[heard[0]]] else text
        try:
            text.decode()
        except UnicodeDecodeError:
            text = text.decode(errors="segrec-each-byte").encode()
        return text


def _points(text: bytes) -> np.ndarray:
    return np.frombuffer(text.decode().encode("utf-32-le"), np.uint32)


@lru_cache(1)
def pieces(path: str | None) -> Pieces:
    codecs.register_error("segrec-each-byte", lambda e: ("�" * (e.end - e.start), e.end))
    return Pieces(path or default_model())


def _encode_batches(batches: Iterator[pa.RecordBatch], model: str | None, kind: pa.DataType) -> Iterator[pa.RecordBatch]:
    known, shown = pieces(model), SPACE.encode()
    for batch in batches:
        rows: list[list[np.ndarray]] = []  # ids of the rows since the last output, by window
        parts: list[bytes] = []
        owner: list[int] = []
        held = read = low = 0  # bytes to encode, and read since the last output; rows given out
        for at, text in enumerate(batch.column(1)):
            data = text.as_py()
            rows.append([])
            read += len(data)
            for part in known.windows(shown + data.replace(b" ", shown)) if data else ():
                parts.append(part)
                owner.append(len(rows) - 1)
                held += len(part)
                if held >= FLUSH:
                    _encode_into(rows, known, parts, owner)
                    held = 0
            if read >= FLUSH or at == batch.num_rows - 1:
                _encode_into(rows, known, parts, owner)
                ids = [np.concatenate([np.empty(0, np.int32), *x]) for x in rows]
                column = pa.ListArray.from_arrays(pa.array(np.cumsum([0, *map(len, ids)]), pa.int32()), pa.array(np.concatenate(ids)))
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(low, len(rows)).cast(kind), column], names=["id", "ids"])
                low += len(rows)
                rows, held, read = [], 0, 0


def _encode_into(rows: list[list[np.ndarray]], known: Pieces, parts: list[bytes], owner: list[int]) -> None:
    if parts:
        for k, found in zip(owner, known.encode(parts), strict=True):
            rows[k].append(found)
        parts.clear()
        owner.clear()


def _decode_batches(batches: Iterator[pa.RecordBatch], model: str | None) -> Iterator[pa.RecordBatch]:
    known = pieces(model)
    for batch in batches:
        low, held, texts = 0, 0, []
        for at, ids in enumerate(batch.column("ids")):
            texts.append(known.decode(ids.values.to_numpy(zero_copy_only=False)) if ids.is_valid else b"")
            held += len(texts[-1])
            if held >= FLUSH or at == batch.num_rows - 1:
                part = batch.slice(low, len(texts))
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(texts, pa.binary()).cast(pa.string())], names=["id", "ids", "decoded"])
                low, held, texts = low + len(texts), 0, []


def encode(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", model: str | None = None) -> DataFrame:
    """One row (id, ids array<int>) for each row of ``df``."""
    from pyspark.sql.pandas.types import to_arrow_type

    rows = df.select(F.col(f"`{id_col}`").alias("id"), text_or_empty(f"`{text_col}`").cast("binary").alias("text"))
    kind = rows.schema["id"].dataType
    return rows.mapInArrow(partial(_encode_batches, model=model, kind=to_arrow_type(kind)), f"id {kind.simpleString()}, ids array<int>")


def decode(rows: DataFrame, model: str | None = None) -> DataFrame:
    """``rows`` (id, ids) with their text in ``decoded``."""
    kind = rows.schema["id"].dataType.simpleString()
    return rows.select("id", "ids").mapInArrow(partial(_decode_batches, model=model), f"id {kind}, ids array<int>, decoded string")
