"""WARC round trip and main-text extraction."""

import hashlib
import random
import re
from collections import Counter

import pytest
from pyspark.sql import functions as F

from tablework.llm import warc, wrapper
from tablework.llm.common import scratch_path

SCHEMA = "page_id long, url string, html string, shard int, i long, kind int, host string, template string"


def pages(spark, data):
    return spark.createDataFrame([(*r, 1, 2, 3, "h", "t") for r in data], SCHEMA).repartition(3)


def archive_rows():
    big, small = "<p>" + "Ü" * 600 + "</p>", "<p>small</p>"
    data = [(i, f"http://h.example/{i}", big) for i in range(1, 9)] + [(i, f"http://h.example/{i}", small) for i in range(9, 13)]
    data += [(20, None, None), (21, "http://x/\r\nInjected: 1", ""), (22, "u", "x" * 200_000), (None, "n", big), (8, "http://h.example/8", big), (23, "u", "y" * 999), (24, "u", "y" * 999), (25, "u", "z" * 1000), (26, "u", "z" * 1000)]
    return data + [(100 + i, "u", f"page {i} " * 300) for i in range(40)]


def expected(data):
    top = {}
    for i, _, h in data:
        if i is not None:
            top[h or ""] = max(top.get(h or "", i), i)
    out = Counter()
    for i, _, h in data:
        raw = (h or "").encode()
        revisit = len(raw) >= 1000 and i is not None and i < top[h or ""]
        out[i, len(raw), hashlib.sha1(raw).hexdigest(), "revisit" if revisit else "response", top[h or ""] if revisit else None] += 1
    return out


@pytest.mark.parametrize("shard_bytes,roll_bytes", [(1 << 30, 1 << 30), (40_000, 2_000)])
def test_warc_round_trip(spark, shard_bytes, roll_bytes):
    data = archive_rows()
    folder = scratch_path(spark, "test-warc")
    manifest = warc.write_archives(pages(spark, data), folder, shard_bytes, roll_bytes)
    records = warc.read_archives(spark, folder).cache()
    assert Counter((r.page_id, r.payload_bytes, r.payload_digest, r.record_type, r.refers_to) for r in records.collect()) == expected(data)
    warc.verify(records, folder)
    html = {r.page_id: bytes(r.payload).decode() for r in records.where("record_type = 'response' and page_id is not null").collect()}
    assert all(html[i] == (h or "") for i, _, h in data if i in html)
    urls = {r.page_id: r.url for r in records.collect()}
    assert urls[20] is None and urls[21] == "http://x/%0D%0AInjected: 1"
    if roll_bytes < 10_000:
        assert manifest.count() > 3


def test_warc_files_do_not_depend_on_the_input_order(spark):
    data = archive_rows()
    manifests = []
    for rows in (data, data[::-1]):
        folder = scratch_path(spark, "test-warc")
        manifests.append(sorted(warc.write_archives(pages(spark, rows), folder, 40_000, 2_000).collect()))
    assert manifests[0] == manifests[1]


def test_warc_empty_table(spark):
    folder = scratch_path(spark, "test-warc")
    warc.write_archives(pages(spark, []), folder)
    assert warc.read_archives(spark, folder).count() == 0


# --- main text -----------------------------------------------------------


def article(k: int, body: str, skeleton: str = "article") -> str:
    open_, close = ("<article>", "</article>") if skeleton == "article" else ('<div class="x1"><div class="x2">', "</div></div>")
    return (
        f"<!DOCTYPE html><html><head><title>T{k}</title><style>p{{}}</style><script>var a='</p>';</script></head><body><!-- c --><header><h1>Site</h1></header>"
        f"<nav><ul><li><a href='/{k}'>menu {k}</a><li>more</ul></nav><div class='cookie-notice'>We use cookies {k}</div><div class=ad>buy {k}</div>{open_}{body}{close}"
        f"<aside>side {k}</aside><form><input name=q><button>go</button></form><div id='comments'><p>reader {k}</p></div><footer>&copy; {k}</footer></body></html>"
    )


BODY = "<h1>Title &amp; {k}</h1><p>First   para\ngraph {k}<br>same <b>bold</b>x<p>Second &lt;{k}&gt; <script>no()</script>end<div class='share-buttons'>share</div><ul><li>one {k}<li>two {k}</ul>"
TEXT = "Title & {k}\n\nFirst para graph {k} same boldx\n\nSecond <{k}> end\n\none {k}\n\ntwo {k}"


@pytest.mark.parametrize("skeleton", ["article", "plain"])
def test_wrapper_extracts_the_article(spark, skeleton):
    data = [(k, f"https://a.example/{k}", article(k, BODY.format(k=f"k{k}"), skeleton)) for k in range(9)]
    frame = pages(spark, data)
    got = {r.page_id: r for r in wrapper.extract(frame, wrapper.induce(frame)).collect()}
    for k in range(9):
        assert got[k].text == TEXT.format(k=f"k{k}")
        assert got[k].n_chars == len(got[k].text)


def test_wrapper_drops_constant_text_without_semantic_tags(spark):
    make = lambda k: f"<html><body><div class=top>Welcome to the site</div><div class=body><p>Story {k} " + "words " * 30 + f"{k}</p></div><div class=end>All rights reserved</div></body></html>"
    frame = pages(spark, [(k, f"https://b.example/{k}", make(k)) for k in range(8)])
    for r in wrapper.extract(frame, wrapper.induce(frame)).collect():
        assert r.text == f"Story {r.page_id} " + "words " * 30 + str(r.page_id)


def test_wrapper_awkward_pages(spark):
    long = "<article>" + "<p>para &eacute;</p>" * 20_000 + "</article>"
    data = [(1, None, None), (2, "https://c.example/1", ""), (3, "https://c.example/2", "<p>alone <b>unclosed"), (4, "x", long), (4, "x", long), (5, "https://d.example/", "plain < text > & no tags"), (None, "https://d.example/", "<main>m</main>tail")]
    frame = pages(spark, data)
    got = [(r.page_id, r.text) for r in wrapper.extract(frame, wrapper.induce(frame)).collect()]
    text = "\n\n".join(["para é"] * 20_000)
    assert Counter(got) == Counter([(1, ""), (2, ""), (3, "alone unclosed"), (4, text), (4, text), (5, got[[g[0] for g in got].index(5)][1]), (None, "m")])
    assert wrapper.extract(pages(spark, []), wrapper.induce(pages(spark, []))).count() == 0


FRAMES = {
    "wrap": ('<div class="content-sidebar-wrap"><article>', "</article><div class='sidebar'><p>side {k}</p></div></div>"),
    "site": ('<div class="site has-sidebar"><div id="search-share"><main>', "</main></div><div class='related'>more {k}</div></div>"),
    "article": ('<article class="post comments-open">', "</article><div id='comments'><p>reader {k}</p></div>"),
    "main": ('<main class="search-page">', "<div class='share'>tell {k}</div></main>"),
    "plain": ('<div class="no-sidebar"><div class="paywall-open">', "<div class='newsletter'>mail {k}</div></div></div>"),
    "list": ("<div class='x'>", "</div>"),
}


@pytest.mark.parametrize("n", [1, 9])
@pytest.mark.parametrize("kind", FRAMES)
def test_names_do_not_close_what_holds_the_content(spark, kind, n):
    paragraphs = ["Story {k} " + "words " * 20 + "a{k}", "Second {k} " + "words " * 20 + "b{k}"]
    body = "".join(f"<div class='notice'>{p}</div>" if kind == "list" else f"<p>{p}</p>" for p in paragraphs)
    open_, close = FRAMES[kind]
    make = lambda k: f"<html><body class='menu'><nav>go {k}</nav><div class='cookie-bar'>cookies {k}</div>{open_}{body}{close}<footer>f {k}</footer></body></html>".replace("{k}", str(k))
    frame = pages(spark, [(k, f"https://e.example/{k}", make(k)) for k in range(n)])
    for r in wrapper.extract(frame, wrapper.induce(frame)).collect():
        assert r.text == "\n\n".join(paragraphs).replace("{k}", str(r.page_id))


def ranked(spark, n, host, make):
    """``n`` pages of a host; ``make`` gets the rank of the page's hash."""
    hashed = spark.createDataFrame([(k, f"https://{host}/{k}") for k in range(n)], "page_id long, url string").withColumn("h", F.xxhash64("page_id", "url"))
    return [(r.page_id, r.url, make(at)) for at, r in enumerate(sorted(hashed.collect(), key=lambda r: (r.h, r.page_id)))]


def story(at: int, by: str) -> str:
    return f"<div class='top'><p>Welcome to us</p></div><div class='body'><div class='by'>{by}</div><p>Story {at} " + "words " * 30 + f"{at}</p></div><div class='end'>All rights</div>"


def test_template_comes_from_all_pages(spark):
    # a by-line that is equal in the first pages only; an error page comes first
    make = lambda at: "<html><body>" + (f"<table><tr><td>error {at}</td></tr></table>" if at == 0 else story(at, "By Ann" if at < 20 else f"By {at}")) + "</body></html>"
    data = ranked(spark, 60, "f.example", make)
    frame = pages(spark, data)
    got = {r.page_id: r.text for r in wrapper.extract(frame, wrapper.induce(frame)).collect()}
    for at, (k, _, _) in enumerate(data):
        if at:
            assert got[k] == f"By {'Ann' if at < 20 else at}\n\nStory {at} " + "words " * 30 + str(at)


def test_each_layout_has_its_own_template(spark):
    other = lambda at: f"<section class='lead'>Our events</section><section class='event'><p>Event {at} " + "dates " * 30 + f"{at}</p></section>"
    data = ranked(spark, 40, "g.example", lambda at: f"<html><body class='post-{at}'>" + (other(at) if at % 4 == 0 else story(at, f"By {at}")) + "</body></html>")
    frame = pages(spark, data)
    got = {r.page_id: r.text for r in wrapper.extract(frame, wrapper.induce(frame)).collect()}
    for at, (k, _, _) in enumerate(data):
        assert got[k] == (f"Event {at} " + "dates " * 30 + str(at) if at % 4 == 0 else f"By {at}\n\nStory {at} " + "words " * 30 + str(at))


def test_copies_of_a_page_make_nothing_constant(spark):
    data = ranked(spark, 30, "i.example", lambda at: "<html><body>" + story(max(at, 26), "By Ann") + "</body></html>")
    frame = pages(spark, data)
    got = {r.page_id: r.text for r in wrapper.extract(frame, wrapper.induce(frame)).collect()}
    for at, (k, _, _) in enumerate(data):
        assert f"Story {max(at, 26)} words" in got[k]


def test_wrapper_shuffled_join_gives_the_same(spark, monkeypatch):
    frame = pages(spark, [(k, f"https://a.example/{k % 3}", article(k, BODY.format(k=k))) for k in range(12)])
    templates = wrapper.induce(frame).cache()
    near = wrapper.extract(frame, templates).collect()
    monkeypatch.setattr(wrapper, "BROADCAST_BYTES", 0)
    assert sorted(near) == sorted(wrapper.extract(frame, templates).collect())


def test_tree_matching_is_maximal():
    a, b = (wrapper.parse(x) for x in ("<div><p>1</p><ul><li>x</ul><p>2</p></div>", "<div><p>1</p><p>2</p><ul><li>y<li>z</ul></div>"))
    score, pairs = wrapper.simple_tree_matching(a, b, wrapper.elements, wrapper.elements)
    assert score == len(pairs) == 5  # page, div, p, ul, li
    assert all(x.key == y.key for x, y in pairs)


def test_pages_of_the_test_tables(spark):
    sf = "/root/testdata/sf0.001"
    frame = spark.read.parquet(f"{sf}/pages.parquet")
    got = {r.page_id: r.text for r in wrapper.extract(frame, wrapper.induce(frame)).collect()}
    import html

    for r in frame.select("page_id", F.col("html")).collect():
        body = re.search(r"<article>(.*?)</article>", r.html, re.S).group(1)
        parts = [" ".join(html.unescape(re.sub(r"<[^>]+>", "", p.replace("<br>", " "))).split()) for p in re.split(r"</?(?:p|h1)>", body)]
        assert got[r.page_id] == "\n\n".join(p for p in parts if p)


def plain_matching(a, b, kids_a, kids_b):
    """The recurrence of simple tree matching, word for word."""
    if a.key != b.key:
        return 0
    x, y = kids_a(a), kids_b(b)
    rows = [[0] * (len(y) + 1) for _ in range(len(x) + 1)]
    for i in range(1, len(x) + 1):
        for j in range(1, len(y) + 1):
            rows[i][j] = max(rows[i - 1][j], rows[i][j - 1], rows[i - 1][j - 1] + plain_matching(x[i - 1], y[j - 1], kids_a, kids_b))
    return rows[-1][-1] + 1


def random_page(rng, depth=0):
    tags = ["div", "section", "b", "i", "em"]
    out, before = [], None
    for _ in range(rng.randint(1, 4) if depth else 4):
        tag = rng.choice([t for t in tags if t != before])  # no runs: then the alignment is the recurrence's
        before = tag
        out.append(f"<{tag}>{random_page(rng, depth + 1) if depth < 3 and rng.random() < 0.6 else 'x'}</{tag}>")
    return "".join(out)


def test_tree_matching_gives_the_pairs_of_the_recurrence():
    rng = random.Random(5)
    as_good = 0
    for _ in range(60):
        a, b = (wrapper.parse(random_page(rng)) for _ in range(2))
        size, pairs = wrapper.simple_tree_matching(a, b, wrapper.elements, wrapper.elements)
        best = plain_matching(a, b, wrapper.elements, wrapper.elements)
        assert size == len(pairs) <= best and all(x.key == y.key for x, y in pairs)
        assert len({id(x) for x, _ in pairs}) == len({id(y) for _, y in pairs}) == size
        as_good += size >= 0.9 * best
        assert wrapper.simple_tree_matching(a, a, wrapper.elements, wrapper.elements)[0] == plain_matching(a, a, wrapper.elements, wrapper.elements)
    assert as_good >= 54


def odd_pages():
    deep = "<font>" * 100_000 + "deep text"
    wide = "<ul>" + "".join(f"<li>item {i}</li>" for i in range(50_000)) + "</ul>"
    mixed = "<dl>" + "".join(f"<dt>t{i}<dd>d{i}" for i in range(20_000)) + "</dl>"
    table = "<table>" + "<tr><td>a<td>b" * 20_000 + "</table>"
    fonts = "<ul><li><ul>" + "<font>" * 3000 + "<li>x</li>" * 3000
    return [deep, wide, mixed, table, fonts, "<p>" * 30_000 + "end", "<div>" * 50_000 + "</div>" * 50_000 + "after"]


def test_deep_and_wide_pages_are_induced_and_extracted(spark):
    rows = []
    for kind, body in enumerate(odd_pages()):
        for k in range(2):
            rows.append((10 * kind + k, f"https://odd{kind}.example/{k}", f"<html><body><div class=top>Site menu</div><article><h1>Title {k}</h1>{body}"))
    pages = spark.createDataFrame(rows, "page_id long, url string, html string").repartition(4)
    got = {r.page_id: r.text for r in wrapper.extract(pages, wrapper.induce(pages)).collect()}
    assert len(got) == len(rows)
    assert got[0].split("\n\n") == ["Title 0", "deep text"]
    assert got[11].split("\n\n") == ["Title 1"] + [f"item {i}" for i in range(50_000)]
    assert got[21].count("\n\n") == 40_000 and got[31].split("\n\n")[1:] == ["a", "b"] * 20_000
    assert got[40].split("\n\n").count("x") == 3000 and got[50].endswith("end") and got[60].endswith("after")
