"""Main text of web pages: a host-wide suffix array of page tokens, with markup as a further cue.

Markup cuts pages into blocks. Scripts and styles have no text; menus, headers, footers, sidebars,
notices, adverts, forms and reader comments are told by element and role, and by class and id where
every part of a class says so (``cookie-notice``, not ``related-work``); inline elements never go by
class. On a page with an ``article`` or ``main`` element only the blocks there can stay.

A host's pages, all blocks of them, are dealt to shards of bounded size. A shard concatenates its
pages' token streams and sorts their suffixes (prefix doubling over token ranks, to a depth of ``RUN``
tokens: a common prefix that long is all that counts). Runs that neighbours in that order share are
merged over the host's shards in two rounds: the least 4-gram of each run (its anchor) goes first, and
only runs whose anchor is on enough pages are sent themselves, with their page. A run on at least ``PAGES``
distinct pages, as many as a ``SHARE`` of all of the host's, is boilerplate, and blocks wholly covered by
such runs go from every page. A page of which such runs cover over ``COPY`` is a copy of other pages, not
boilerplate, and keeps its text. Copies of a page count once. A host with one shard sends nothing.

Nulls: null html is empty and gives an empty text. A null url, or one without ``://``, has the empty
host. Repeated rows and ties give equal rows. Pages of any length are read whole; markup that never
ends hides nothing but itself. An empty table gives an empty result. Extra columns are carried and may
have any names.
"""

from __future__ import annotations

import html
import math
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from segrec.llm.common import materialise, packed_row

RUN = 10
PAGES = 3
SHARE = 0.2
COPY = 0.75
ANCHOR = 4
SHARD_BYTES = 2 << 20
#: Hosts with more than one shard whose sizes are broadcast; beyond as many they are joined by a shuffle.
BROADCAST_HOSTS = 200_000

# Elements, roles and words of class and id attributes.
RAW = "script|style|noscript|template|iframe|svg|textarea|title|object|math|canvas|video|audio|select|option"
DROPPED = {"nav", "header", "footer", "aside", "form", "menu", "dialog", "button", "fieldset", "label"}
MAIN = {"article", "main"}
VOID = {"br", "img", "hr", "input", "meta", "link", "source", "wbr", "area", "base", "col", "embed", "param", "track"}
BLOCKS = {
    "address", "article", "blockquote", "body", "center", "dd", "details", "div", "dl", "dt", "figcaption", "figure",
    "h1", "h2", "h3", "h4", "h5", "h6", "head", "hr", "html", "li", "main", "ol", "p", "pre", "section", "summary", "table", "tbody", "tfoot", "thead", "tr", "ul",
}
SPACES = {"br", "td", "th", "img"}
ROLES = {"navigation", "banner", "contentinfo", "complementary", "search", "form", "dialog", "alert", "menu", "menubar", "toolbar"}
#: Parts of classes and ids that tell what isn't the article; those of PLAIN say nothing by themselves.
WORDS = {
    "ad", "ads", "advert", "advertisement", "adverts", "advertising", "adsbygoogle", "sponsor", "sponsored", "promo", "banner",
    "sidebar", "menu", "nav", "navbar", "navigation", "breadcrumb", "breadcrumbs", "header", "masthead", "footer", "cookie", "cookies", "consent",
    "gdpr", "notice", "notification", "alert", "popup", "modal", "overlay", "newsletter", "subscribe", "subscription", "signup", "login", "search", "share",
    "sharing", "social", "related", "recommended", "comment", "comments", "disqus", "reply", "replies", "respond", "widget", "toolbar", "pagination", "skip",
}
PLAIN = {
    "bar", "block", "body", "bottom", "box", "container", "content", "form", "group", "inner", "item", "items", "left", "links", "list", "main",
    "module", "outer", "page", "panel", "posts", "right", "section", "site", "slot", "text", "top", "unit", "wrap", "wrapper", "js", "the",
}
#: Of these words alone a paragraph or an article can be told; a paragraph called "search" is text.
INNER = {"comment", "comments", "reply", "replies", "ad", "ads", "advert", "advertisement", "promo", "related", "sponsored", "teaser", "cookie", "cookies", "newsletter"}
PARAGRAPHS = {"p", "h1", "h2", "h3", "h4", "h5", "h6", "blockquote", "pre", "figure", "figcaption", "td", "th", "tr", "tbody", "dd", "dt"}

_TOKEN = re.compile(
    r"<!--.*?(?:-->|\Z)"
    rf"|<(?P<raw>{RAW})\b(?:[^<>\"']++|\"[^\"]*+\"|'[^']*+')*+>"
    r"|<(?P<end>/?)(?P<name>[a-zA-Z][a-zA-Z0-9:-]*)(?P<rest>(?:[^<>\"']++|\"[^\"]*+\"|'[^']*+')*+)>"
    r"|</?[a-zA-Z][^<>]*(?:>|\Z)"
    r"|<[!?][^>]*>",
    re.S | re.I,
)
_ATTRIBUTE = re.compile(r"\b(class|id|role|style|hidden|itemprop)\b(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+)))?", re.I)
_SPACE = re.compile(r"\s+")
_PARTS = re.compile(r"[a-z]+")


def _told(names: str, words: set[str]) -> bool:
    """Whether a name of a class or id attribute has a part in ``words`` and none that says anything else."""
    for name in names.split():
        parts = _PARTS.findall(name)
        if any(x in words for x in parts) and all(x in words or x in WORDS or x in PLAIN for x in parts):
            return True
    return False


def _kind(name: str, rest: str, inside: list[str]) -> str:
    """drop, main or an empty text for a start tag within the main elements ``inside``."""
    dropped = name in DROPPED and not (name == "header" and "article" in inside)
    if not rest.strip():
        return "drop" if dropped else "main" if name in MAIN else ""
    role = prop = ""
    called = False
    for key, *value in _ATTRIBUTE.findall(rest):
        key, text = key.lower(), next((v for v in value if v), "").lower()
        if key in ("class", "id"):
            if name in BLOCKS and name not in ("html", "body"):
                called = called or _told(text, INNER if name in MAIN or name in PARAGRAPHS else WORDS)
        elif key == "role":
            role = text
        elif key == "itemprop":
            prop = text
        elif key == "hidden" or "display:none" in text.replace(" ", ""):
            return "drop"
    if dropped or called or role in ROLES:
        return "drop"
    return "main" if name in MAIN or role == "main" or prop == "articlebody" else ""


def blocks_of(page: str) -> tuple[list[str], list[bool]]:
    """All text blocks in order, and whether markup leaves each."""
    blocks: list[str] = []
    marks: list[int] = []  # 0: in an element that markup drops, 1: other, 2: in an article or main element
    parts: list[str] = []
    closed: dict[str, int] = {}  # where an element's last end tag is
    inside: list[str] = []  # open main elements
    skipped, depth, at = "", 0, 0

    def flush() -> None:
        text = _SPACE.sub(" ", html.unescape("".join(parts))).strip()
        parts.clear()
        if text:
            blocks.append(text)
            marks.append(0 if skipped else 2 if inside else 1)

    def ends(name: str) -> bool:
        if name not in closed:
            closed[name] = max((m.start() for m in re.finditer(rf"</{name}(?![a-z0-9:-])", page, re.I)), default=-1)
        return closed[name] >= at

    while token := _TOKEN.search(page, at):
        parts.append(page[at : token.start()])
        at = token.end()
        if token["raw"]:
            raw = token["raw"].lower()
            end = re.compile(rf"</{raw}\s*>", re.I).search(page, at) if ends(raw) else None
            at = end.end() if end else len(page)
            continue
        if not token["name"]:
            continue
        name = token["name"].lower()
        if skipped:
            if name in BLOCKS or name == skipped:
                flush()
            elif name in SPACES:
                parts.append(" ")
            if name == skipped:
                depth += -1 if token["end"] else 0 if token["rest"].endswith("/") else 1
                if depth == 0:
                    skipped = ""
            continue
        if token["end"]:
            if name in BLOCKS:
                flush()
            if inside and inside[-1] == name:
                inside.pop()
            elif name in SPACES:
                parts.append(" ")
            continue
        kind = "" if name in VOID else _kind(name, token["rest"], inside)
        if kind == "drop" and ends(name):  # an element that never ends hides nothing
            flush()
            skipped, depth = name, 1
            continue
        if name in BLOCKS or kind:
            flush()
        if kind == "main" or (inside and name == inside[-1]):
            inside.append(name)
        if name in SPACES:
            parts.append(" ")
    parts.append(page[at:])
    flush()
    best = max([1, *marks])
    return blocks, [m == best for m in marks]


_DEALT = ["row", "host", "shard", "shards", "buckets", "least"]


def _parsed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    import xxhash

    for batch in batches:
        for low in range(0, batch.num_rows, 256):
            part = batch.slice(low, 256)
            found = [blocks_of(x.as_py().decode("utf-8", "replace")) for x in part["html"]]
            texts = ["\n".join(b) for b, _ in found]  # white space within a block is single spaces
            kept = ["".join("1" if m else "0" for m in marks) for _, marks in found]
            pages = np.array([xxhash.xxh64_intdigest(t.encode("utf-8", "surrogatepass")) for t in texts], np.uint64).view(np.int64)
            told = {"blocks": pa.array(texts, pa.string()), "kept": pa.array(kept, pa.string()), "page": pa.array(pages)}
            yield pa.RecordBatch.from_arrays([*(part[c] for c in _DEALT), *told.values()], names=[*_DEALT, *told])


_NUMBERS: dict[str, int] = {}


def token_numbers(words: list[str]) -> np.ndarray:
    """A 64-bit hash of each token; a task keeps those of tokens that it has met."""
    import xxhash

    if len(_NUMBERS) > 1 << 20:
        _NUMBERS.clear()
    for w in set(words) - _NUMBERS.keys():
        _NUMBERS[w] = xxhash.xxh64_intdigest(w.encode("utf-8", "surrogatepass"))
    return np.fromiter(map(_NUMBERS.__getitem__, words), np.uint64, len(words))


def _grams(tokens: np.ndarray, size: int) -> np.ndarray:
    """A hash of each ``size`` neighbouring tokens, by doubling; as long as ``tokens``, the last ones wrap around."""
    h, have = tokens, 1
    with np.errstate(over="ignore"):
        while have < size:
            step = min(have, size - have)
            mixed = (h * np.uint64(0x9E3779B97F4A7C15)) ^ (np.roll(h, -step) + np.uint64(have))
            h = (mixed ^ (mixed >> np.uint64(31))) * np.uint64(0xD6E8FEB86659FD93)
            have += step
        return h ^ (h >> np.uint64(32))


def suffix_ranks(tokens: np.ndarray, run: int = RUN) -> np.ndarray:
    """Rank of each suffix in the order of its first ``run`` tokens, equal prefixes equal; the last ones wrap around."""
    rank, size = np.unique(tokens, return_inverse=True)[1].astype(np.int64), 1
    while size < run and len(rank):
        step = min(size, run - size)
        rank = np.unique(rank * (rank.max() + 1) + np.roll(rank, -step), return_inverse=True)[1].astype(np.int64)
        size += step
    return rank


class Shard:
    """The suffixes of a shard's distinct pages, and what it asks the host's other shards in each round."""

    def __init__(self, pages: list[int], texts: list[str], run: int = RUN) -> None:
        self.run = run
        self.at: dict[int, tuple[int, int]] = {}  # page -> its tokens
        streams, size = [], 0
        for page, text in zip(pages, texts, strict=True):
            if page not in self.at:
                words = text.split()
                self.at[page] = size, size + len(words)
                streams.append(words)
                size += len(words)
        tokens = token_numbers([w for s in streams for w in s])
        sizes = np.array([len(s) for s in streams], np.int64)
        owner = np.repeat(np.arange(len(sizes)), sizes)
        left = np.repeat(np.cumsum(sizes), sizes) - np.arange(size)
        self.names = np.array(list(self.at), np.int64)
        starts = np.flatnonzero(left >= run)  # a run doesn't cross pages
        rank = suffix_ranks(tokens, run)[starts]
        order = np.argsort(rank, kind="stable")  # the suffix array; pages ascend within equals
        self.starts, rank, self.owner = starts[order], rank[order], owner[starts[order]]
        new = np.ones(len(rank), bool)
        new[1:] = rank[1:] != rank[:-1]
        self.group = np.cumsum(new) - 1
        self.first = np.flatnonzero(new)
        fresh = new.copy()
        fresh[1:] |= self.owner[1:] != self.owner[:-1]
        self.pages = np.bincount(self.group[fresh], minlength=len(self.first))
        # a run is named by a hash, and anchored at its least 4-gram
        self.name = _grams(tokens, run)[self.starts[self.first]] if size else np.empty(0, np.uint64)
        anchors = _grams(tokens, ANCHOR) if size else np.empty(0, np.uint64)
        least = anchors
        for k in range(1, run - ANCHOR + 1):
            least = np.minimum(least, np.roll(anchors, -k))
        least = least[self.starts[self.first]] if size else least
        with np.errstate(over="ignore"):
            least = (least ^ (least >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
        self.anchors, self.anchor = np.unique(least, return_inverse=True)
        self.fresh = fresh

    def anchor_pages(self) -> np.ndarray:
        """Distinct pages with each anchor."""
        met = np.unique(self.anchor[self.group[self.fresh]] * len(self.names) + self.owner[self.fresh])
        return np.bincount(met // max(1, len(self.names)), minlength=len(self.anchors)).astype(np.uint32)

    def asked(self, often: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(group, name, page) for each run whose anchor is met often and each of its pages, by name."""
        at = np.flatnonzero(self.fresh & often[self.anchor][self.group])
        at = at[np.argsort(self.name[self.group[at]], kind="stable")]
        return self.group[at], self.name[self.group[at]], self.names[self.owner[at]]

    def covered(self, groups: np.ndarray) -> np.ndarray:
        """How many of the runs ``groups`` cover each token."""
        change = np.zeros(sum(b - a for a, b in self.at.values()) + 1, np.int64)
        marked = np.zeros(len(self.first), bool)
        marked[groups] = True
        starts = self.starts[marked[self.group]]
        np.add.at(change, starts, 1)
        np.add.at(change, starts + self.run, -1)
        return np.cumsum(change)[:-1]


_ASKED = "host string, shard int, shards int, buckets int, least bigint, bucket int, n int, keys binary, pages binary"
_TOLD = "host string, shard int, round int, bucket int, n int, bits binary"


def _arrow(schema: str) -> pa.Schema:
    kinds = {"string": pa.string(), "int": pa.int32(), "bigint": pa.int64(), "binary": pa.binary()}
    return pa.schema([(name, kinds[kind]) for name, kind in (x.split() for x in schema.split(", "))])


def _cuts(keys: np.ndarray, buckets: int) -> np.ndarray:
    """Where each bucket begins among ascending keys: a bucket is a range of keys."""
    bits = buckets.bit_length() - 1
    return np.searchsorted(keys >> np.uint64(64 - bits), np.arange(buckets + 1)) if bits else np.array([0, len(keys)])


def _bits(told: pa.Table | None, number: int) -> np.ndarray:
    """A shard's answers of a round in the order of its questions."""
    rows = sorted((r["bucket"], r["n"], r["bits"]) for r in (told.to_pylist() if told else ()) if r["round"] == number)
    return np.concatenate([np.unpackbits(np.frombuffer(b, np.uint8), count=n).astype(bool) for _, n, b in rows]) if rows else np.empty(0, bool)


def _asker(number: int):
    def ask(rows: pa.Table, told: pa.Table | None = None) -> pa.Table:
        empty = _arrow(_ASKED).empty_table()
        if not rows.num_rows or rows["shards"][0].as_py() == 1:
            return empty
        host, number_of, shards, buckets, least = (rows[c][0].as_py() for c in ("host", "shard", "shards", "buckets", "least"))
        shard = Shard(rows["page"].to_pylist(), rows["blocks"].to_pylist())
        if number == 1:
            keys, pages = shard.anchors, shard.anchor_pages()
            small = keys.astype(np.uint32)  # a false match only asks more
        else:
            _, keys, pages = shard.asked(_bits(told, 1))
            small = keys
        cuts = _cuts(keys, buckets)
        used = np.flatnonzero(np.diff(cuts)).tolist()
        columns = [[host] * len(used), [number_of] * len(used), [shards] * len(used), [buckets] * len(used), [least] * len(used), used, np.diff(cuts)[used].tolist(), [small[cuts[k] : cuts[k + 1]].tobytes() for k in used], [pages[cuts[k] : cuts[k + 1]].tobytes() for k in used]]
        return pa.Table.from_arrays([pa.array(c, f.type) for c, f in zip(columns, empty.schema, strict=True)], schema=empty.schema)

    def first(rows: pa.Table) -> pa.Table:
        return ask(rows)

    return first if number == 1 else ask


def _answerer(number: int):
    def answer(rows: pa.Table) -> pa.Table:
        rows = rows.sort_by("shard")
        sizes, least = rows["n"].to_numpy(), rows["least"][0].as_py()
        keys = np.concatenate([np.frombuffer(x, np.uint32 if number == 1 else np.uint64) for x in rows["keys"].to_pylist()])
        met = np.concatenate([np.frombuffer(x, np.uint32 if number == 1 else np.int64) for x in rows["pages"].to_pylist()])
        _, group = np.unique(keys, return_inverse=True)
        if number == 1:
            bits = (np.bincount(group, weights=met) >= least)[group]
        else:  # a page with copies in several shards counts once
            order = np.lexsort((met, group))
            fresh = np.ones(len(order), bool)
            fresh[1:] = (group[order][1:] != group[order][:-1]) | (met[order][1:] != met[order][:-1])
            bits = (np.bincount(group[order][fresh]) >= least)[group]
        cuts = np.concatenate([[0], np.cumsum(sizes)])
        parts = [np.packbits(bits[a:b]).tobytes() for a, b in zip(cuts[:-1], cuts[1:], strict=True)]
        n = rows.num_rows
        return pa.Table.from_arrays([rows["host"], rows["shard"], pa.array([number] * n, pa.int32()), rows["bucket"], rows["n"], pa.array(parts, pa.binary())], schema=_arrow(_TOLD))

    return answer


def unique_text(blocks: list[str], kept: list[bool], hit: np.ndarray) -> str:
    """The blocks that markup keeps but those wholly covered; all of them if over ``COPY`` of their tokens are."""
    sizes = np.array([b.count(" ") + 1 for b in blocks], np.int64)
    ends = np.cumsum(sizes)
    begins = ends - sizes
    within = np.concatenate([[0], np.cumsum(hit)])
    covered = within[ends] - within[begins]
    mine = np.array(kept, bool)
    copy = covered[mine].sum() > COPY * sizes[mine].sum()
    return "\n\n".join(b for b, k, c, n in zip(blocks, kept, covered, sizes, strict=True) if k and (copy or c < n))


def _finisher(least: int, share: float):
    def finish(rows: pa.Table, told: pa.Table) -> pa.Table:
        texts, pages, marks = (rows[c].to_pylist() for c in ("blocks", "page", "kept"))
        out: dict[tuple[int, str], str] = {}
        if rows.num_rows:
            shard = Shard(pages, texts)
            if rows["shards"][0].as_py() == 1:
                groups = np.flatnonzero(shard.pages >= max(least, math.ceil(rows.num_rows * share)))
            else:
                asked, _, _ = shard.asked(_bits(told, 1))
                groups = asked[_bits(told, 2)]
            hits = shard.covered(groups) > 0
            for page, text, kept in zip(pages, texts, marks, strict=True):
                if (page, kept) not in out:
                    begin, end = shard.at[page]
                    out[page, kept] = unique_text(text.split("\n"), [k == "1" for k in kept], hits[begin:end]) if text else ""
        return pa.Table.from_arrays([rows["row"], pa.array([out[x] for x in zip(pages, marks, strict=True)], pa.string())], names=["row", "main_text"])

    return finish


def extract(df: DataFrame, url_col: str = "url", html_col: str = "html", pages: int = PAGES, share: float = SHARE, shard_bytes: int = SHARD_BYTES) -> DataFrame:
    """Rows (row, main_text): the columns of ``df`` other than its html in the struct ``row``, and the main text, empty if there is none."""
    from segrec.llm.url_filter import host_and_path

    others = df.drop(html_col)
    host = F.coalesce(host_and_path(F.col(url_col).cast("string"))[0], F.lit(""))
    source = df.select(packed_row(others).alias("row"), host.alias("host"), F.coalesce(F.col(html_col).cast("string"), F.lit("")).cast("binary").alias("html"))
    row = source.schema["row"].dataType.simpleString()
    source = source.withColumn("uid", F.monotonically_increasing_id())
    # the hosts with more than one shard are few: at most one for each ``shard_bytes`` of the input
    sizes = source.groupBy("host").agg(F.sum(F.octet_length("html") + 64).alias("size"), F.count("*").alias("n")).where(F.col("size") > shard_bytes)
    many = F.ceil(F.col("size") / shard_bytes).cast("int")
    buckets = F.pow(F.lit(2.0), F.ceil(F.log2(many.cast("double")))).cast("int")
    large = sizes.select(F.col("host").alias("of"), many.alias("many"), buckets.alias("many_buckets"), F.greatest(F.lit(pages), F.ceil(F.col("n") * share)).cast("bigint").alias("enough"))
    large = materialise(large, "large_hosts")
    large = F.broadcast(large) if large.count() <= BROADCAST_HOSTS else large
    dealt = source.join(large, F.col("host") == F.col("of"), "left").select(
        "row",
        "host",
        # copies of a page are dealt apart, so that no shard holds all of them
        F.coalesce(F.pmod(F.xxhash64("uid"), F.col("many")), F.lit(0)).cast("int").alias("shard"),
        F.coalesce("many", F.lit(1)).alias("shards"),
        F.coalesce("many_buckets", F.lit(1)).alias("buckets"),
        F.coalesce("enough", F.lit(0)).cast("bigint").alias("least"),
        "html",
    )
    dealt = dealt.mapInArrow(_parsed, f"row {row}, host string, shard int, shards int, buckets int, least bigint, blocks string, kept string, page bigint")
    here = dealt.groupBy("host", "shard")
    told = here.applyInArrow(_asker(1), _ASKED).groupBy("host", "bucket").applyInArrow(_answerer(1), _TOLD)
    asked = here.cogroup(told.groupBy("host", "shard")).applyInArrow(_asker(2), _ASKED)
    told = told.unionByName(asked.groupBy("host", "bucket").applyInArrow(_answerer(2), _TOLD))
    return here.cogroup(told.groupBy("host", "shard")).applyInArrow(_finisher(pages, share), f"row {row}, main_text string")
