import time
from html.parser import HTMLParser

import pytest
from helpers import PLAIN_PAGE, SHARED_PAGE, TIDES_PAGE, fetch, fetches, html_page, tag

from crawlsight.functions.jsonld import _parse, _types
from crawlsight.operators.facts import page_facts, page_links, staged_pages
from crawlsight.operators.render import render_flags, render_worklist, with_rendered
from crawlsight.sources.fetches import normalize_fetches, pages_as_fetches

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def facts(spark):
    shell = '<html><body><div id="App"></div>' + "word " * 60 + "</body></html>"
    rows = [
        fetch("https://ex.com/tides", TIDES_PAGE, 0),
        fetch("https://ex.com/line", PLAIN_PAGE, 1),
        fetch("https://ex.com/shared", SHARED_PAGE, 2),
        fetch("https://ex.com/gone", "<h1>x</h1>", 3, 404),
        fetch("https://ex.com/empty", "", 4),
        fetch("https://ex.com/failed", None, 5, None, error="timeout"),
        fetch("https://ex.com/shell", shell, 6),
        fetch("https://ex.com/plain", shell.replace("App", "main"), 7),
        fetch("https://ex.com/probe", None, 8, 0, depth=-1, error="x"),
        fetch(
            "https://ex.com/mixed",
            "<title> <b>In</b> ner </title><meta name=description content=' '><meta name=description content='second'>"
            "<meta name=Googlebot content=none><picture><source srcset='p.webp 2x'><img src=q.png alt=' '></picture>"
            "<img src=q.png alt=again><img src='data:image/x'><h1> </h1><h1>a<!-- c -->b</h1><h2>one<h3>two</h3>"
            "<script type='application/ld+json'>{'bad'}</script><script type='application/LD+JSON'>{}</script>"
            "<link rel='Canonical' href=''><link rel=canonical href='mailto:x'>",
            9,
            redirect_chain=[("http://old/", 301), ("https://ex.com/mixed", 200)],
        ),
    ]
    return {r.url.rsplit("/", 1)[1]: r for r in page_facts(fetches(spark, rows)).collect()}


def test_head_of_a_whole_page(facts):
    page = facts["tides"]
    assert (page.title, page.title_source) == ("Harbour tides for the week of the regatta", "title")
    assert (page.meta_description, page.meta_description_source) == ("High water & low water", "description")
    assert (page.og_title, page.og_description, page.twitter_title, page.twitter_description) == ("Tides", "Water levels", "Tides today", None)
    assert (page.canonical, page.robots_meta, page.lang, page.has_viewport) == ("https://ex.com/tides", "max-snippet:20,follow", "en", True)
    assert page.has_json_ld and page.schema_types == ["Dataset", "Place"]


def test_body_of_a_whole_page(facts):
    page = facts["tides"]
    assert (page.h1, page.h2, page.h3, page.h4) == (["Tide ta ble"], ["Tables"], ["Springs"], [])
    assert [(i.src.rsplit("/", 1)[1], i.alt) for i in page.images] == [
        ("neap.avif", ""), ("spring.png", None), ("quay.png", "Quay"), ("fallback.png", None),
    ]
    assert page.internal_links == ["https://ex.com/berths"] and page.internal_link_occurrences == 2
    assert page.external_links == ["https://moon.example/phase"] and page.external_link_occurrences == 1
    assert page.image_count == 4 and page.seo_signals.images_missing_alt == 3
    assert page.seo_signals.h1_count == 1 and page.seo_signals.heading_count == 3
    assert page.content_length == len(TIDES_PAGE.encode()) and page.extraction_warnings == []
    # 8 in the title, 1 + 3 + 1 in headings, 6 in links; nothing from noscript
    assert page.word_count == 19


def test_pages_with_little(facts):
    line, shared = facts["line"], facts["shared"]
    assert line.title is None and line.meta_description is None and line.h1 == [] and line.lang is None
    assert (shared.title, shared.title_source) == ("Tides", "og:title")
    assert shared.extraction_warnings == ["title_fallback_og", "meta_description_fallback_og", "likely_js_shell"]


def one(spark, html):
    return page_facts(fetches(spark, [fetch("https://ex.com/p", html)])).first()


def test_unclosed_headings_end_at_a_block(spark):
    page = one(spark, "<h1>One<p>text</p><h2>Two <b>x</b></h2><h3><div>inner</div></h3><h2>Three<ul><li>a</ul><h4>Four</body>")
    assert (page.h1, page.h2, page.h3, page.h4) == (["One"], ["Two x", "Three"], ["inner"], ["Four"])


def test_only_children_of_a_picture_count(spark):
    page = one(spark, "<picture><span><source srcset=in.webp></span><source srcset=a.webp><br><source srcset=b.webp><img src=c.png alt=c></picture><source srcset=out.webp>")
    assert [i.src for i in page.images] == [f"https://ex.com/{n}" for n in ("c.png", "a.webp", "b.webp")]


def test_query_parameters_are_no_references(spark):
    page = one(spark, '<a href="/?a=1&copy=2&amp;lt=3">x</a><img src="/i?x=1&notit;&eacute;" alt="&copy;&#146;">')
    assert page.internal_links == ["https://ex.com/?a=1&copy=2&lt=3"]
    assert page.images[0].src == "https://ex.com/i?x=1&notit;é" and page.images[0].alt == "©’"


def test_large_pages_take_linear_time(spark):
    images = "".join(f"<img src=/{n % 4000}.png>" for n in range(5000))
    links = "".join(f"<a href=/{n % 4000}>x</a>" for n in range(5000))
    start = time.time()
    page = one(spark, html_page(body=[images, links]))
    assert page.image_count == 4000 and page.internal_link_occurrences == 5000 and len(page.internal_links) == 4000
    assert [i.src for i in page.images[:2]] == ["https://ex.com/0.png", "https://ex.com/1.png"]
    assert time.time() - start < 30


def test_broken_pages_keep_fetch_fields_only(facts):
    assert [(facts[k].is_broken, facts[k].error) for k in ("gone", "empty", "failed")] == [
        (True, "HTTP 404"), (True, "HTTP 200"), (True, "timeout"),
    ]
    assert facts["gone"].h1 == [] and facts["gone"].seo_signals is None and facts["gone"].word_count == 0
    assert "probe" not in facts


def test_shell(facts):
    assert facts["shell"].likely_js_shell and not facts["plain"].likely_js_shell


def test_odd_markup(facts):
    page = facts["mixed"]
    assert page.title == "Inner"
    assert page.meta_description is None
    assert page.robots_meta == "none"
    assert page.h1 == ["a b"] and page.h2 == ["one"] and page.h3 == ["two"]
    assert [(i.src, i.alt) for i in page.images] == [
        ("https://ex.com/q.png", " "), ("data:image/x", None), ("https://ex.com/p.webp", None),
    ]
    assert page.canonical == "mailto:x"
    assert not page.has_json_ld and page.extraction_warnings == ["json_ld_present_but_unparsed"]
    assert page.redirect_chain == ["http://old/", "https://ex.com/mixed"]


def test_json_ld_order_and_repair():
    (doc,) = _parse('{"x": {"@type": "C"}, /* n */ "@graph": [{"@type": ["B", null]},], "@type": "A", "@context": {"@type": "no"},}')
    assert _types(doc) == ["A", "B", "C"]
    assert _parse("{") is None and _parse("[" * 100_000) is None


class Outline(HTMLParser):
    def __init__(self):
        super().__init__()
        self.title, self.h1, self.hrefs, self.words, self.stack = "", "", [], [], []

    def handle_starttag(self, tag, attrs):
        self.stack.append(tag)
        if tag == "a":
            self.hrefs.append(dict(attrs).get("href"))

    def handle_endtag(self, tag):
        while tag in self.stack and self.stack.pop() != tag:
            pass

    def handle_data(self, data):
        if "title" in self.stack:
            self.title += data
        if "h1" in self.stack:
            self.h1 += data
        if not {"script", "style"} & set(self.stack[-1:]):
            self.words.append(data.strip())


def test_real_pages_agree_with_a_tree_walk(spark):
    pages = spark.read.parquet(f"{SF}/pages.parquet")
    got = {r.page_ord: r for r in page_facts(pages_as_fetches(pages)).collect()}
    for row in pages.collect():
        outline = Outline()
        outline.feed(row.html)
        outline.close()
        page = got[row.page_id]
        assert page.title == outline.title.strip() and page.h1 == [outline.h1.strip()]
        assert page.text_length == len(" ".join(w for w in outline.words if w))
        assert page.internal_link_occurrences == len(outline.hrefs)


def test_facts_do_not_depend_on_partitions(spark):
    pages = spark.read.parquet(f"{SF}/pages.parquet")
    one = page_facts(pages_as_fetches(pages.coalesce(1)))
    many = page_facts(pages_as_fetches(pages.repartition(7)))
    assert sorted(map(str, one.collect())) == sorted(map(str, many.collect()))


def test_page_links_keep_order_and_repeats(spark):
    rows = page_links(fetches(spark, [fetch("https://ex.com/tides", TIDES_PAGE)])).first()
    assert rows.links == ["https://moon.example/phase", "https://ex.com/berths", "https://ex.com/berths"]


def test_normalize_fetches(spark):
    raw = spark.createDataFrame(
        [
            ("a", "s", "https://ex.com/r", "https://EX.com/r2/", 200, "é", 9, None, 0, 1.0, False, 0, [("https://ex.com/r", 301)]),
            ("a", "s", "https://ex.com/f", "", 0, "x", 5, "boom", 0, 1.0, False, 1, []),
            ("a", "s", "https://ex.com/h", "https://ex.com/h", 200, "", 7, None, 0, 1.0, False, 2, None),
        ],
        "audit_id string, seed_url string, url string, final_url string, status_code int, html string, content_length long,"
        " error string, depth int, elapsed_ms double, js_rendered boolean, page_ord long, history array<struct<url:string,status_code:int>>",
    )
    a, b, c = normalize_fetches(raw).orderBy("page_ord").collect()
    assert a.final_url == "https://ex.com/r2" and a.content_length == 2
    assert [(h.url, h.status_code) for h in a.redirect_chain] == [("https://ex.com/r", 301), ("https://EX.com/r2/", 200)]
    assert b.final_url == b.url and b.status_code is None and b.html is None
    assert c.content_length == 7 and c.redirect_chain == []


def test_render_selection(spark):
    long_text = "word " * 60
    rows = [
        fetch("u/thin", "<p>short</p><h1>x</h1>", 0),
        fetch("u/fine", f"<h1>x</h1><p>{long_text}</p>", 1),
        fetch("u/root", f"<div id=root></div>{long_text}", 2),
        fetch("u/noscript", f"<h1>h</h1><noscript>{long_text}</noscript>", 3),
        fetch("u/gone", "", 4, 404),
        fetch("u/empty", None, 5),
        fetch("u/anchor", f"<div id=root></div><a href=x>y</a>{long_text}", 6),
    ]
    df = fetches(spark, rows)
    flags = {r.url: (r.thin, r.spa_shell, r.needs_render) for r in render_flags(df).collect()}
    assert flags == {
        "u/thin": (True, False, True), "u/fine": (False, False, False), "u/root": (False, True, True),
        "u/noscript": (True, False, True), "u/gone": (True, True, False), "u/empty": (True, True, True),
        "u/anchor": (False, False, False),
    }
    assert {r.url for r in render_worklist(df).collect()} == {"u/thin", "u/root", "u/noscript", "u/empty"}
    rendered = spark.createDataFrame([("a1", "u/thin", "<h1>new</h1>"), ("a1", "u/root", "")], "audit_id string, url string, html string")
    after = {r.url: r for r in with_rendered(df, rendered).collect()}
    assert after["u/thin"].html == "<h1>new</h1>" and after["u/thin"].js_rendered and after["u/thin"].content_length == 12
    assert not after["u/root"].js_rendered and len(after) == len(rows)


def test_facts_and_records_in_one_pass(spark):
    rows = [
        fetch("https://ex.com/tides", TIDES_PAGE, 0, redirect_chain=[("http://old/", 301)], elapsed_ms=2.5),
        fetch("https://ex.com/gone", "<h1>x</h1>", 1, 404, content_length=7),
        fetch("https://ex.com/failed", None, 2, None, error="timeout"),
        fetch("https://ex.com/probe", None, 3, 0, depth=-1, error="x"),
        fetch("https://ex.com/nowhere", "<h1>y</h1>", 4, depth=None),
    ]
    df = fetches(spark, rows)
    facts, records = staged_pages(df)
    assert facts.columns == page_facts(df).columns and records.columns == [c for c in df.columns if c != "html"]
    assert sorted(map(str, facts.collect())) == sorted(map(str, page_facts(df).collect()))
    assert sorted(map(str, records.collect())) == sorted(map(str, df.drop("html").collect()))
