"""Language ID of words and texts with a linear-chain conditional random field.

Each word (a run of letters, lower-cased) is labelled with a language. Its features are character
n-grams, affixes and membership in each language's lexicon; transitions between neighbouring words'
languages are learned. ``fit`` takes texts of known language and splices stretches of them, so that
the transitions see code-switched text, and maximises the penalised likelihood. ``annotate`` runs
forward-backward over all words of a whole text: the text's language has the largest sum of the words'
marginals, its score is that language's mean marginal.

Every language that a row to train on has is learned. The training sample is bounded: about
``per_language`` texts of each language and ``window`` characters of each text, at a place that a hash
gives. Features are hashed into a table of at most ``WEIGHTS`` weights, whatever the number of languages.
Prediction reads whole texts.

Nulls: a text that is null or has no letter gets ``und`` with score 0. Rows without a language are
never trained on. If no row can be trained on, all texts get ``und``. Repeated rows and ties give equal
rows; between equal sums the smaller name wins. Extra columns are carried and may have any names.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from segrec.llm.common import packed_row

UNDETERMINED = "und"
PER_LANGUAGE = 250
WINDOW = 3000
#: Rows of the feature table with few languages, and its weights with many: rows are halved beyond.
FEATURES = 1 << 17
WEIGHTS = 1 << 24
STEPS = 32
EPOCHS = 4
#: Words labelled at once, words whose emissions a task keeps, and words whose features are held at once.
BATCH_WORDS = 100_000
KEPT_WORDS = 250_000
FEATURE_WORDS = 10_000
#: Languages whose shares of the sample are broadcast; more are joined.
BROADCAST_LANGUAGES = 10_000
_WORD = re.compile(r"[^\W\d_]+")


def words_of(text: str) -> list[str]:
    return _WORD.findall(text.lower())


def _mix(*parts: np.ndarray | int) -> np.ndarray:
    h = np.uint64(0x9E3779B97F4A7C15)
    with np.errstate(over="ignore"):
        for p in parts:
            h = (h ^ np.asarray(p, np.uint64)) * np.uint64(0xFF51AFD7ED558CCD)
            h = h ^ (h >> np.uint64(29))
    return h


def feature_rows(languages: int) -> int:
    """Rows of the feature table for a number of languages."""
    rows = FEATURES
    while rows * languages > WEIGHTS and rows > 1024:
        rows //= 2
    return rows


def features(words: list[str], rows: int = FEATURES) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(feature numbers of all words, index where each word's begin, hash of each word)."""
    sizes = np.array([len(w) for w in words], np.int64) + 2
    chars = np.frombuffer("".join(f"\x02{w}\x03" for w in words).encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64)
    ends = np.cumsum(sizes)
    starts = ends - sizes
    owner = np.repeat(np.arange(len(words)), sizes)
    left = np.repeat(ends, sizes) - np.arange(len(chars))  # characters to the word's end, this one included
    found, owners = [], []
    pad = np.concatenate([chars, np.zeros(4, np.uint64)])
    n = len(chars)
    for size in (2, 3, 4):
        at = np.flatnonzero(left >= size)
        found.append(_mix(size, *[pad[at + k] for k in range(size)]))
        owners.append(owner[at])
    for size in (2, 3):  # affixes
        at = np.flatnonzero(sizes - 2 >= size)
        found.append(_mix(10 + size, *[pad[starts[at] + 1 + k] for k in range(size)]))
        found.append(_mix(20 + size, *[pad[ends[at] - 1 - size + k] for k in range(size)]))
        owners += [at, at]
    place = (np.arange(n) - np.repeat(starts, sizes)).astype(np.uint64)
    whole = np.add.reduceat(_mix(30, chars, place), starts) if n else np.empty(0, np.uint64)
    order = np.argsort(np.concatenate(owners), kind="stable")
    numbers = (np.concatenate(found)[order] % np.uint64(rows)).astype(np.int64)
    counts = np.bincount(np.concatenate(owners), minlength=len(words))
    return numbers, np.cumsum(counts) - counts, whole


@dataclass
class Model:
    names: list[str]
    weights: np.ndarray  # feature rows x languages
    lexicon: np.ndarray  # sorted hashes of words
    known: np.ndarray  # lexicon x languages: 1 if the word was met in the language
    lexical: np.ndarray  # languages x languages: weight of membership
    transitions: np.ndarray  # languages x languages

    def members(self, whole: np.ndarray) -> np.ndarray:
        if not len(self.lexicon):
            return np.zeros((len(whole), len(self.names)), np.float32)
        at = np.minimum(np.searchsorted(self.lexicon, whole), len(self.lexicon) - 1)
        return self.known[at] * (self.lexicon[at] == whole)[:, None]

    def emissions(self, words: list[str]) -> np.ndarray:
        numbers, begin, whole = features(words, len(self.weights))
        return np.add.reduceat(self.weights[numbers], begin, axis=0) + self.members(whole) @ self.lexical


def _forward_backward(emit: np.ndarray, active: np.ndarray, trans: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Marginals of sequences laid out step by step, longest first; ``active`` are the sequences at each step."""
    emit = np.exp(emit - emit.max(axis=1, keepdims=True))
    trans = np.exp(trans - trans.max()).astype(emit.dtype)
    offsets = np.concatenate([[0], np.cumsum(active)])
    ahead, behind = np.empty_like(emit), np.ones_like(emit)
    for t, n in enumerate(active):
        now = slice(offsets[t], offsets[t] + n)
        a = emit[now] if t == 0 else (ahead[offsets[t - 1] : offsets[t - 1] + n] @ trans) * emit[now]
        ahead[now] = a / a.sum(axis=1, keepdims=True)
    for t in range(len(active) - 2, -1, -1):
        n = active[t + 1]
        b = (emit[offsets[t + 1] : offsets[t + 1] + n] * behind[offsets[t + 1] : offsets[t + 1] + n]) @ trans.T
        behind[offsets[t] : offsets[t] + n] = b / b.sum(axis=1, keepdims=True)
    both = ahead * behind
    return both / both.sum(axis=1, keepdims=True), ahead, behind * emit, trans


def fit(texts: list[tuple[str, str]], seed: int = 7) -> Model:
    """Train on (language, text) pairs."""
    rng = np.random.default_rng(seed)
    names = sorted({name for name, _ in texts})
    own = {name: k for k, name in enumerate(names)}
    runs = [(own[name], words) for name, text in texts if (words := words_of(text))]
    vocabulary = sorted(set().union(*(w for _, w in runs)))
    number = {w: i for i, w in enumerate(vocabulary)}
    k = len(names)
    stream, labels = [], []  # spliced stretches of all texts, in random order
    pieces = []
    for label, words in runs:
        at = 0
        while at < len(words):
            size = int(rng.geometric(1 / 12))
            pieces.append((label, words[at : at + size]))
            at += size
    for i in rng.permutation(len(pieces)):
        label, words = pieces[i]
        stream += [number[w] for w in words]
        labels += [label] * len(words)
    usable = len(stream) // STEPS * STEPS
    if not usable:
        stream, labels = (stream * STEPS)[:STEPS], (labels * STEPS)[:STEPS]
        usable = len(stream) // STEPS * STEPS
    x, y = np.array(stream[:usable]).reshape(-1, STEPS), np.array(labels[:usable]).reshape(-1, STEPS)
    numbers, begin, whole = features(vocabulary, feature_rows(k))
    spans = np.append(begin, len(numbers))
    met = np.zeros((len(vocabulary), k), np.float32)
    np.add.at(met, (x.ravel(), y.ravel()), 1)
    order = np.argsort(whole)
    twice = met.sum(axis=1)[order] >= 2  # words met once say nothing about new texts
    model = Model(names, np.zeros((feature_rows(k), k), np.float32), whole[order][twice], (met[order][twice] > 0).astype(np.float32), np.zeros((k, k), np.float32), np.zeros((k, k), np.float32))
    seen = [np.full_like(p, 1e-3) for p in (model.weights, model.lexical, model.transitions)]
    members = model.members(whole)
    for _ in range(EPOCHS):
        for part in np.array_split(rng.permutation(len(x)), max(1, len(x) // 48)):
            words, gold = x[part].T.ravel(), y[part].T.ravel()  # step by step
            sizes = spans[words + 1] - spans[words]
            flat = np.repeat(spans[words] - np.cumsum(sizes) + sizes, sizes) + np.arange(sizes.sum())
            feats = numbers[flat]
            at = np.cumsum(sizes) - sizes
            emit = np.add.reduceat(model.weights[feats], at, axis=0) + members[words] @ model.lexical
            marginals, ahead, after, trans = _forward_backward(emit, np.full(STEPS, len(part)), model.transitions)
            error = -marginals
            error[np.arange(len(words)), gold] += 1
            b = len(part)
            pair = ahead[:-b, :, None] * trans * after[b:, None, :]
            pair /= pair.sum(axis=(1, 2), keepdims=True)
            moves = -pair.sum(axis=0)
            np.add.at(moves, (gold[:-b], gold[b:]), 1)
            rows, inverse = np.unique(feats, return_inverse=True)
            spread = np.repeat(error, sizes, axis=0)
            grad = np.stack([np.bincount(inverse, weights=spread[:, j], minlength=len(rows)) for j in range(k)], axis=1).astype(np.float32)
            grad = grad / b - 1e-4 * model.weights[rows]
            seen[0][rows] += grad**2
            model.weights[rows] += 0.2 * grad / np.sqrt(seen[0][rows])
            for p, s, g in ((model.lexical, seen[1], members[words].T @ error), (model.transitions, seen[2], moves)):
                g = g / b - 1e-3 * p
                s += g**2
                p += 0.2 * g / np.sqrt(s)
    return model


class Labeller:
    """Labels batches of texts; keeps the emissions of words that it has met."""

    def __init__(self, model: Model) -> None:
        self.model, self.number = model, {}
        self.emissions = np.empty((0, len(model.names)), np.float32)

    def _numbers(self, texts: list[list[str]]) -> np.ndarray:
        new = list(set().union(*texts) - self.number.keys())
        if len(self.number) + len(new) > KEPT_WORDS:
            self.number, self.emissions, new = {}, self.emissions[:0], list(set().union(*texts))
        if new:
            self.number.update(zip(new, range(len(self.number), len(self.number) + len(new)), strict=True))
            parts = [self.model.emissions(new[at : at + FEATURE_WORDS]) for at in range(0, len(new), FEATURE_WORDS)]
            self.emissions = np.concatenate([self.emissions, *parts])
        return np.array([self.number[w] for words in texts for w in words], np.int64)

    def marginals(self, texts: list[list[str]]) -> list[np.ndarray]:
        """For each text (none empty) its words x languages marginals."""
        flat = self._numbers(texts)
        sizes = np.array([len(w) for w in texts])
        rank = np.empty(len(sizes), np.int64)
        rank[np.argsort(-sizes, kind="stable")] = np.arange(len(sizes))
        active = len(sizes) - np.searchsorted(np.sort(sizes), np.arange(sizes.max()), "right")
        offsets = np.cumsum(active) - active
        step = np.arange(len(flat)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
        place = offsets[step] + np.repeat(rank, sizes)
        emit = np.empty((len(flat), len(self.model.names)), np.float32)
        emit[place] = self.emissions[flat]
        return np.split(_forward_backward(emit, active, self.model.transitions)[0][place], np.cumsum(sizes)[:-1])

    def label(self, texts: list[str]) -> tuple[list[str], list[float]]:
        names, scores = [UNDETERMINED] * len(texts), [0.0] * len(texts)
        split = {i: w for i, t in enumerate(texts) if (w := [x for x in words_of(t) if x.isalpha() or any(map(str.isalpha, x))])}
        order, at = sorted(split, key=lambda i: len(split[i])), 0
        while at < len(order) and self.model.names:
            took, total = at, 0
            while took < len(order) and (took == at or total + len(split[order[took]]) <= BATCH_WORDS):
                total += len(split[order[took]])
                took += 1
            part = order[at:took]
            for i, m in zip(part, self.marginals([split[i] for i in part]), strict=True):
                mean = m.mean(axis=0, dtype=np.float64)
                best = int(mean.argmax())
                names[i], scores[i] = self.model.names[best], min(1.0, float(mean[best]))
            at = took
        return names, scores


def _labelling(model, field: int | None):
    def label(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        labeller = Labeller(Model(*model.value))
        for batch in batches:
            for low in range(0, batch.num_rows, 1024):
                part = batch.slice(low, 1024)
                texts = part.column(1) if field is None else part.column(0).field(field).cast(pa.binary())
                names, scores = labeller.label([(x or b"").decode("utf-8", "replace") for x in texts.to_pylist()])
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(names), pa.array(scores)], names=["__row", "__lang", "__score"])

    return label


def held_out(id_col: str = "doc_id") -> Column:
    """True for the quarter of the ids that is never trained on."""
    return F.crc32(F.coalesce(F.col(id_col).cast("string"), F.lit("")).cast("binary")) % 4 == 2


def train(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", per_language: int = PER_LANGUAGE, window: int = WINDOW) -> Model:
    """Fit on a bounded sample of the rows that aren't held out."""
    rows = df.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("text"), F.col(lang_col).cast("string").alias("lang"))
    rows = rows.where(F.col("lang").isNotNull() & F.col("text").isNotNull() & ~held_out())
    counts = rows.groupBy("lang").count().orderBy("lang").collect()
    shares = df.sparkSession.createDataFrame([(r["lang"], min(1.0, per_language / r["count"])) for r in counts], "of string, share double")
    shares = F.broadcast(shares) if len(counts) <= BROADCAST_LANGUAGES else shares
    draw = F.pmod(F.xxhash64("doc_id", "text"), F.lit(1 << 30))
    start = F.pmod(F.xxhash64("text", F.lit(1)), F.greatest(F.lit(1), F.length("text") - window + 1)) + 1
    sample = rows.join(shares, F.col("lang") == F.col("of")).where(draw < F.col("share") * (1 << 30)).select("lang", F.substring("text", start.cast("int"), F.lit(window)).alias("text"))
    texts = [(r["lang"], r["text"]) for r in sample.limit(4 * per_language * max(1, len(counts))).collect()]
    texts.sort()
    texts = [t for t in texts if words_of(t[1])]
    if not texts:
        return Model([], *[np.zeros((0, 0), np.float32)] * 5)
    return fit(texts)


def _told(df: DataFrame, model: Model, text_col: str) -> DataFrame:
    """Rows (__row, __lang, __score); a text travels once, in its row, unless it must be cast first."""
    row = packed_row(df).alias("__row")
    if text_col in df.columns and df.schema[text_col].dataType == StringType():
        rows, field = df.select(row), df.columns.index(text_col)
    else:
        rows, field = df.select(row, F.col(f"`{text_col}`").cast("string").cast("binary").alias("__text")), None
    label = _labelling(df.sparkSession.sparkContext.broadcast(tuple(vars(model).values())), field)
    return rows.mapInArrow(label, f"__row {rows.schema['__row'].dataType.simpleString()}, __lang string, __score double")


def annotate(df: DataFrame, model: Model, text_col: str = "text", pred_col: str = "lang_pred", score_col: str = "score") -> DataFrame:
    """The rows of ``df`` with the predicted language and its score."""
    return _told(df, model, text_col).select("__row.*", F.col("__lang").alias(pred_col), F.col("__score").alias(score_col))


def keep_identified(df: DataFrame, model: Model, text_col: str = "text", least: float = 0.4) -> DataFrame:
    """The rows of ``df`` whose language is determined with a score of ``least`` or more, with its columns."""
    return _told(df, model, text_col).where((F.col("__lang") != UNDETERMINED) & (F.col("__score") >= least)).select("__row.*")
