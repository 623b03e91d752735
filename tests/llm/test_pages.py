"""URL filter, WARC and HTML extraction."""

import gzip
import hashlib

import numpy as np
import pytest

from segrec.llm import html_extract, url_filter, warc
from segrec.llm.common import scratch_path

# ---- URLs

URLS = [
    ("http://Foo.Example.NET/en/1?x#y", "foo.example.net", "/en/1", "example.net/en/", "allow"),
    ("https://example.net/de/1", "example.net", "/de/1", "net/", "block"),
    ("https://notexample.net/en/1", "notexample.net", "/en/1", "net/", "block"),
    ("http://a.example.com/de/", "a.example.com", "/de/", "example.com/de/", "block"),
    ("http://a.org/fr/1", "a.org", "/fr/1", "org/fr/", "allow"),
    ("http://a.org/en/1", "a.org", "/en/1", None, None),
    ("http://x.net", "x.net", "", None, None),
    ("http://x.net:80/a", "x.net:80", "/a", None, None),
    ("nothing", "", "", None, None),
    ("a://b://c.net/x", "b:", "//c.net/x", None, None),
    ("http://\u00c4b.ORG?q=http://z.net/", "\u00c4b.org", "", None, None),
    (None, "", "", None, None),
]


def test_hosts_paths_and_rules(spark):
    df = spark.createDataFrame([(i, u[0], "clash") for i, u in enumerate(URLS)], "page_id bigint, url string, gram string")
    rows = {r["page_id"]: r for r in url_filter.judge(df).collect()}
    assert len(rows) == len(URLS)
    for i, (_, host, path, rule, verdict) in enumerate(URLS):
        r = rows[i]
        assert (r["host"], r["path"], r["rule"], r["gram"]) == (host, path, rule, "clash")
        assert r["verdict"] == verdict if verdict else r["verdict"] in ("allow", "block")


def test_model_tells_urls_like_accepted_from_urls_like_rejected(spark):
    rules = (("allow", "good.test", "/"), ("block", "bad.test", "/"))
    good = [f"http://good.test/library/article-{i}.html" for i in range(150)]
    bad = [f"http://bad.test/casino/win?bonus={i * 7}" for i in range(150)]
    new = ["http://other.test/library/article-999.html", "http://other.test/casino/win?bonus=3"] * 2
    df = spark.createDataFrame([(u,) for u in good + bad + new], "url string")
    rows = url_filter.judge(df, rules=rules).where("rule IS NULL").collect()
    assert len(rows) == 4 and {(r["url"], r["verdict"]) for r in rows} == {(new[0], "allow"), (new[1], "block")}


def brute_score(tree, url):
    """Interpolated ratio of the longest n-grams in the tree, by recursion."""
    import re

    text = "<" * (url_filter.ORDER - 1) + re.sub(r"[^a-z0./?=&#_%:\-]", "~", re.sub("[0-9]", "0", url.split("://", 1)[1].lower())) + ">"
    every = {k: sum(c[k] for g, c in tree.items() if len(g) == 1) for k in (0, 1)}

    def chance(gram, k):
        if len(gram) == 1:
            return (tree[gram][k] + 4.0) / (every[k] + 4.0 * 48)
        return (tree[gram][k] + 4.0 * chance(gram[1:], k)) / (tree[gram[:-1]][k] + 4.0)

    total = 0.0
    for i in range(len(text)):
        gram = next((text[i - n + 1 : i + 1] for n in range(url_filter.ORDER, 0, -1) if i - n + 1 >= 0 and text[i - n + 1 : i + 1] in tree), None)
        if gram:
            total += np.log(chance(gram, 0)) - np.log(chance(gram, 1))
    return total / len(text)


def test_scores_equal_brute_force(spark):
    labelled = [(f"http://a.test/{w}/{i}", "allow") for i, w in enumerate(["en", "fr", "news"] * 5)] + [(f"http://b.test/x{w}?{i}", "block") for i, w in enumerate(["shop", "en"] * 6)]
    train = spark.createDataFrame(labelled, "url string, verdict string")
    weights = url_filter._weights(train)
    counts = {}
    import re

    for url, verdict in labelled:
        text = "<" * (url_filter.ORDER - 1) + re.sub(r"[^a-z0./?=&#_%:\-]", "~", re.sub("[0-9]", "0", url.split("://", 1)[1].lower())) + ">"
        for n in range(1, url_filter.ORDER + 1):
            for i in range(len(text) - n + 1):
                counts.setdefault(text[i : i + n], [0, 0])[verdict == "block"] += 1
    assert weights.count() == len(counts)
    asked = spark.createDataFrame([("http://c.test/en/7",), ("http://a.test/zz?y",)], "url string")
    for r in url_filter._scores(asked, weights).collect():
        assert r["score"] == pytest.approx(brute_score(counts, r["url"]))


def test_weights_beyond_a_broadcast_are_met_by_a_shuffle(spark, monkeypatch):
    labelled = [(f"http://a.test/{i}/en", "allow") for i in range(9)] + [(f"http://b.test/x{i}", "block") for i in range(9)]
    weights = url_filter._weights(spark.createDataFrame(labelled, "url string, verdict string"))
    asked = spark.createDataFrame([("http://c.test/en/7",), ("u" * 5000 + "://" + "v/" * 20000,)], "url string")
    one = {r["url"]: r["score"] for r in url_filter._scores(asked, weights).collect()}
    monkeypatch.setattr(url_filter, "BROADCAST_GRAMS", 0)
    two = {r["url"]: r["score"] for r in url_filter._scores(asked, weights).collect()}
    assert one == pytest.approx(two) and len(one) == 2


def test_threshold_has_the_best_balanced_accuracy(spark):
    rng = np.random.default_rng(1)
    rows = [(float(rng.normal(0.4, 0.5)), "allow") for _ in range(200)] + [(float(rng.normal(-0.4, 0.5)), "block") for _ in range(120)]
    limit = url_filter._threshold(spark.createDataFrame(rows, "score double, verdict string"))

    def accuracy(t):
        return sum(x >= t for x, v in rows if v == "allow") / 200 + sum(x < t for x, v in rows if v == "block") / 120

    assert accuracy(limit) >= max(accuracy(k * url_filter.BIN) for k in range(-300, 300)) - 1e-9


def test_urls_without_labels_and_empty_tables(spark):
    df = spark.createDataFrame([("http://a.com/",), ("http://a.com/",)], "url string")
    assert [(r["verdict"], r["score"]) for r in url_filter.judge(df).collect()] == [("allow", None)] * 2
    assert url_filter.judge(df.limit(0)).count() == 0


def test_url_filter_runs_no_python_on_executors(spark, sf):
    from segrec.llm.queries import op4_url_filter

    plan = op4_url_filter(spark, sf)._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan and "Pandas" not in plan


# ---- WARC


def test_warc_round_trip(spark):
    big = "x\r\n\r\nWARC/1.1\r\n" * 4000 + "\u00e4"
    pages = [(1, "http://a/\n", "short"), (2, None, None), (3, "u", big), (4, "u", big), (5, "u", "y" * 1000), (6, "u", "y" * 1000), (7, "u", "z" * 999), (8, "u", "z" * 999), (None, "u", big), (9, "u", ""), (10, "u", "0\r\n\r\n")]
    path = scratch_path(spark, "warc-test")
    warc.write(spark.createDataFrame(pages, "page_id bigint, url string, html string"), path)
    rows = warc.read(spark, path).collect()
    assert len(rows) == len(pages) and all(r["error"] is None for r in rows)
    told = {r["page_id"]: r for r in rows}
    for i, _, page in pages:
        r, payload = told[None if i is None else str(i)], (page or "").encode()
        keeper = max((j for j, _, p in pages if p == page and j is not None), default=None)
        again = len(payload) >= 1000 and i != keeper
        assert (r["record_type"], r["refers_to"]) == (("revisit", str(keeper)) if again else ("response", None))
        assert (r["payload_bytes"], r["digest"]) == (len(payload), hashlib.sha1(payload).hexdigest())
        assert (r["payload"] is None) if again else bytes(r["payload"]) == payload


def test_archives_are_bounded_by_bytes_and_broken_ones_tell(spark, monkeypatch, tmp_path):
    import gzip

    monkeypatch.setattr(warc, "ARCHIVE_BYTES", 50_000)
    pages = [(k, "u", f"{k} " * 9000) for k in range(12)]
    path = str(tmp_path / "archives")
    warc.write(spark.createDataFrame(pages, "page_id bigint, url string, html string").coalesce(1), path)
    files = sorted((tmp_path / "archives").glob("part-*"))
    sizes = [len(gzip.decompress(f.read_bytes())) for f in files]
    assert len(files) > 3 and max(sizes) < 50_000 + 2 * warc.SEGMENT_BYTES
    assert all(next(warc.parse(gzip.decompress(f.read_bytes())))[0]["warc-type"] == "warcinfo" for f in files)
    files[1].unlink()  # segments are lost, some with the first of their record
    rows = warc.read(spark, path).collect()
    broken = [r for r in rows if r["error"]]
    assert broken and all(r["payload"] is None and r["payload_bytes"] is None for r in broken)
    assert all(bytes(r["payload"]).decode() == f"{r['page_id']} " * 9000 for r in rows if not r["error"])


def test_segments_are_verified():
    pd = pytest.importorskip("pandas")
    columns = ["record_id", "origin_id", "segment", "total", "page_id", "url", "record_type", "refers_to", "digest", "block", "error"]

    def row(segment, block, total=None):
        return ["r", "o", segment, total, "1", "u", "response", None, "d", block, None]

    whole = warc._joined(pd.DataFrame([row(3, b"c", 6), row(1, b"aaa"), row(2, b"bb")], columns=columns)).iloc[0]
    assert (whole["block"], whole["error"]) == (b"aaabbc", None)
    for bad in ([row(1, b"a"), row(3, b"c", 2)], [row(1, b"a"), row(2, b"b", 5)], [row(1, b"a"), row(2, b"b")], [row(1, b"a"), row(1, b"a"), row(2, b"b", 3)]):
        told = warc._joined(pd.DataFrame(bad, columns=columns)).iloc[0]
        assert told["block"] is None and told["error"]


def test_chunked_framing():
    assert warc.dechunk(b"3;x=1\r\nabc\r\nA\r\n0123456789\r\n0\r\n\r\n") == b"abc0123456789"
    for n in (0, 1, 4096, 10000):
        assert warc.dechunk(warc._chunked(b"q" * n, 4096)) == b"q" * n
    with pytest.raises(ValueError):
        warc.dechunk(b"5\r\nabc\r\n0\r\n\r\n")


def test_warc_of_an_empty_table(spark):
    path = scratch_path(spark, "warc-test")
    warc.write(spark.createDataFrame([], "page_id bigint, url string, html string"), path)
    assert warc.read(spark, path).count() == 0


# ---- HTML

PAGES = [
    ("<html><head><title>t</title></head><body><nav>menu</nav><article><h1>A &amp; B</h1><p>one<br>two <b>b</b>old<p>three &lt;x&gt;</article><footer>f</footer></body>", "A & B\n\none two bold\n\nthree <x>"),
    ("<div class='cookie-notice'>eat</div><main><header>h</header><p>keep</p><div id=comments><p>mine</p></div></main>", "keep"),
    ("<p>no article<div class=ad>buy</div><script>var a='<p>x</p>'</script><p>end<!-- <p>no</p> -->", "no article\n\nend"),
    ("<nav>never closed<p>text", "never closed\n\ntext"),
    ("<article><p>a<article class='comment'>c</article><p>b</article>", "a\n\nb"),
    ("", ""),
    (None, ""),
    ("plain   text\n here", "plain text here"),
    ("<article><p title='a>b'>q</p><form>f<input></form>r</article>", "q\n\nr"),
    ("<p>unfinished <a href='x", "unfinished"),
]


def test_markup(spark):
    df = spark.createDataFrame([(i, "http://h/", p, "clash") for i, (p, _) in enumerate(PAGES)], "page_id bigint, url string, html string, main_text string")
    rows = {r["row"]["page_id"]: r["main_text"] for r in html_extract.extract(df).collect()}
    assert rows == {i: want for i, (_, want) in enumerate(PAGES)}


def test_host_boilerplate_goes_and_copies_stay(spark):
    shared = "subscribe now to get all of the latest news and offers"
    own = [" ".join(f"word{i}x{k}" for k in range(20)) for i in range(6)]
    pages = [(i, "http://h.test/", f"<p>{own[i]}</p><p>{shared}</p>") for i in range(6)]
    pages += [(10, "http://h.test/", pages[0][2]), (11, "http://other.test/", f"<p>{shared}</p><p>{own[1]}</p>"), (12, "http://h.test/", f"<p>{shared}</p>")]
    rows = {r["row"]["page_id"]: r["main_text"] for r in html_extract.extract(spark.createDataFrame(pages, "page_id bigint, url string, html string")).collect()}
    assert all(rows[i] == own[i] for i in range(6)) and rows[10] == own[0]
    assert rows[11] == f"{shared}\n\n{own[1]}" and rows[12] == shared


def test_host_boilerplate_goes_from_article_pages(spark):
    shared = "subscribe now to get all of the latest news and offers"
    footer = "all rights are reserved by the makers of this site"
    own = [" ".join(f"word{i}x{k}" for k in range(20)) for i in range(5)]
    pages = [(i, "http://h.test/", f"<article><p>{own[i]}</p><p>{shared}</p></article><footer>{footer}</footer>") for i in range(4)]
    pages += [(4, "http://h.test/", f"<p>{own[4]}</p><p>{shared}</p><p>{footer}</p>"), (5, "http://other.test/", pages[0][2])]
    rows = {r["row"]["page_id"]: r["main_text"] for r in html_extract.extract(spark.createDataFrame(pages, "page_id bigint, url string, html string")).collect()}
    assert all(rows[i] == own[i] for i in range(5)) and rows[5] == f"{own[0]}\n\n{shared}"


def test_suffix_order_and_counts_equal_brute_force():
    rng = np.random.default_rng(4)
    tokens = rng.integers(0, 3, 200).astype(np.uint64)
    ranks, run = html_extract.suffix_ranks(tokens, 5), 5
    prefixes = [tuple(tokens[i : i + run]) for i in range(len(tokens) - run + 1)]
    assert ranks[: len(prefixes)].argsort(kind="stable").tolist() == sorted(range(len(prefixes)), key=lambda i: prefixes[i])
    assert all((ranks[i] == ranks[j]) == (prefixes[i] == prefixes[j]) for i in range(0, 196, 7) for j in range(196))
    texts = [" ".join(map(str, rng.integers(0, 3, n))) for n in (40, 3, 0, 25, 40)]
    shard = html_extract.Shard(list(range(5)), texts, 5)
    seen = {}
    for k, text in enumerate(texts):
        words = text.split()
        for i in range(len(words) - 4):
            seen.setdefault(tuple(words[i : i + 5]), set()).add(k)
    assert sorted(shard.pages.tolist()) == sorted(len(v) for v in seen.values()) and len(set(shard.name.tolist())) == len(seen)


def brute_extract(pages, share):
    """Main text of (host, html) pages by counting every run of every page."""
    parsed = [(host, *html_extract.blocks_of(page)) for host, page in pages]
    runs = {}
    for host, blocks, _ in parsed:
        words = " ".join(blocks).split()
        for i in range(len(words) - html_extract.RUN + 1):
            runs.setdefault((host, tuple(words[i : i + html_extract.RUN])), set()).add(tuple(blocks))
    for host, blocks, kept in parsed:
        words = " ".join(blocks).split()
        least = max(html_extract.PAGES, int(np.ceil(sum(h == host for h, _ in pages) * share)))
        hit = np.zeros(len(words), bool)
        for i in range(len(words) - html_extract.RUN + 1):
            if len(runs[host, tuple(words[i : i + html_extract.RUN])]) >= least:
                hit[i : i + html_extract.RUN] = True
        yield html_extract.unique_text(blocks, kept, hit) if blocks else ""


@pytest.mark.parametrize("shard_bytes", [300, 1 << 20])
def test_extraction_equals_brute_force(spark, shard_bytes):
    rng = np.random.default_rng(9)
    notes = [" ".join(f"n{k}w{i}" for i in range(int(rng.integers(6, 16)))) for k in range(4)]
    pages = []
    for i in range(60):
        own = [f"<p>{' '.join(f'o{rng.integers(0, 300)}' for _ in range(12))}</p>" for _ in range(4)]
        for k in rng.choice(4, 2, replace=False):
            own.insert(int(rng.integers(0, 5)), f"<p>{notes[k]}</p>")
        pages.append((f"h{rng.choice(3, p=[0.7, 0.2, 0.1])}", "<article>" + "".join(own) + "</article>" if i % 2 else "".join(own)))
    pages += pages[:5] + [("h0", "")] * 3
    df = spark.createDataFrame([(i, f"http://{h}/x", p) for i, (h, p) in enumerate(pages)], "page_id bigint, url string, html string")
    rows = {r["row"]["page_id"]: r["main_text"] for r in html_extract.extract(df, share=0.25, shard_bytes=shard_bytes).collect()}
    want = list(brute_extract(pages, 0.25))
    assert [rows[i] for i in range(len(pages))] == want
    assert sum(n in t for n in notes for t in want) < 60  # runs do go


def test_words_of_attributes_take_no_text_of_an_article(spark):
    pages = [
        ("<article><section class='related-work'><p>prior art</p></section><p>b</p></article>", "prior art\n\nb"),
        ("<main><p id='search'>how search works</p><p class='notice-period'>three months</p></main>", "how search works\n\nthree months"),
        ("<main><p>see <a class='social'>social</a> networks</p></main>", "see social networks"),
        ("<article><header><h1>Headline</h1></header><p>a</p></article>", "Headline\n\na"),
        ("<main><p>a</p><div class='cookie-notice-box'>c</div><p class='ad'>buy</p><ul id='comments-list'><li>x</ul></main>", "a"),
        ("\u0130" * 50 + "<nav>x</nav><p>t", "\u0130" * 50 + "\n\nt"),
    ]
    df = spark.createDataFrame([(i, None, p) for i, (p, _) in enumerate(pages)], "page_id bigint, url string, html string")
    rows = {r["row"]["page_id"]: r["main_text"] for r in html_extract.extract(df).collect()}
    assert rows == {i: want for i, (_, want) in enumerate(pages)}


def test_extraction_takes_empty_tables_and_long_pages(spark):
    df = spark.createDataFrame([(1, None, "<article>" + "<p>word" * 50000 + "</article>")], "page_id bigint, url string, html string")
    assert html_extract.extract(df).first()["main_text"] == "\n\n".join(["word"] * 50000)
    assert html_extract.extract(df.limit(0)).count() == 0


# ---- broken archives


def _told(spark, tmp_path, data):
    (tmp_path / "part-0.gz").write_bytes(data)
    return warc.read(spark, str(tmp_path)).collect()


def _plain(page, text, **headers):
    block = b"HTTP/1.1 200 OK\r\nContent-Length: %d" % len(text) + warc.END + text
    return warc._record("response", f"r{page}", block, X_Page_ID=page, **headers)


def test_malformed_records_have_an_error_and_the_others_are_read(spark, tmp_path):
    good = [_plain(k, b"text %d" % k) for k in range(3)]
    bad = [
        _plain(10, b"x").replace(b"Content-Length: ", b"Content-Long: ", 1),
        _plain(11, b"x").replace(b"Content-Length: ", b"Content-Length: many", 1),
        _plain(12, b"x").replace(b"WARC-Type: response\r\n", b""),
        _plain(13, b"x", WARC_Segment_Number="two"),
        _plain(14, b"x", WARC_Segment_Number=1, WARC_Segment_Total_Length="9" * 30),
        b"some bytes that are no record",
        _plain(16, b"x").replace(b"WARC-Record-ID: <urn:sha1:r16>\r\n", b""),
        warc._record("continuation", "c17", b"lost", X_Page_ID=17),
        _plain(18, b"x").replace(b"Content-Length: ", b"Content-Length: " + b"9" * 5000, 1),
        warc._record("response", "r19", b"HTTP/1.1 200 OK\r\nTransfer-Encoding: chunked" + warc.END + b"zz\r\n", X_Page_ID=19),
        warc._record("revisit", "r20", b"HTTP/1.1 200 OK" + warc.END, X_Page_ID=20),
    ]
    mixed = [x for pair in zip(bad, good * 4) for x in pair]
    rows = _told(spark, tmp_path, gzip.compress(warc.END.join(mixed) + warc.END))
    assert len(rows) == 2 * len(bad)
    fine = [r for r in rows if r["error"] is None]
    assert sorted(bytes(r["payload"]).decode() for r in fine) == sorted(f"text {k % 3}" for k in range(len(bad)))
    broken = [r for r in rows if r["error"] is not None]
    assert len(broken) == len(bad) and all(r["payload"] is None for r in broken)
    assert {r["page_id"] for r in broken} == {"10", "11", "12", "13", "14", None, "16", "17", "18", "19", "20"}


@pytest.mark.parametrize("cut", [0.3, 0.9])
def test_an_archive_that_is_cut_off_gives_what_can_be_read(spark, tmp_path, cut):
    import random

    rng = random.Random(1)
    data = gzip.compress(warc.END.join(_plain(k, bytes(rng.randrange(32, 127) for _ in range(2000))) for k in range(40)))
    rows = _told(spark, tmp_path, data[: int(len(data) * cut)])
    assert 40 * cut - 4 < sum(r["error"] is None for r in rows) < 40 and sum(r["error"] is not None for r in rows) <= 1
    assert all(len(r["payload"]) == 2000 for r in rows if r["error"] is None)


def test_members_of_their_own_and_files_that_are_no_archive(spark, tmp_path):
    rows = _told(spark, tmp_path, b"".join(gzip.compress(_plain(k, b"t") + warc.END) for k in range(5)))
    assert len(rows) == 5 and not any(r["error"] for r in rows)
    rows = _told(spark, tmp_path, b"\x1f\x8bnot gzip")
    assert len(rows) == 1 and "broken" in rows[0]["error"]
    assert _told(spark, tmp_path, b"") == []
