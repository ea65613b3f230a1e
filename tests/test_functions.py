import html as stdlib_html
import random
import re
import time
from urllib.parse import quote, unquote, urldefrag, urljoin, urlparse, urlunparse

from crawlsight.functions import html as H
from crawlsight.functions import text as X
from crawlsight.functions import url as U
from crawlsight.operators import robots as RB

TEXTS = [
    "", " a ", "\t\n x y  　", "\x1c\x85 z\x1f", "plain", "a​b", "  ", "é À_9 ٣ x", "áb c",
]


def test_strip_and_words_match_the_stdlib(evaluate):
    assert evaluate(X.strip("x"), TEXTS) == [t.strip() for t in TEXTS]
    assert evaluate(X.word_count("x"), TEXTS) == [len(re.findall(r"\b\w+\b", t)) for t in TEXTS]
    assert evaluate(X.is_blank("x"), [None, "", "  ", "a"]) == [True, True, True, False]


def test_entities(evaluate):
    texts = [
        "a &amp; b", "&amp;lt;", "&lt;b&gt; &quot;q&quot; &apos;", "&eacute;&copy;&middot;&nbsp;x", "&#65;&#x42;&#x1F600;",
        "& &; &unknown; &&amp;", "no reference", "",
    ]
    assert evaluate(X.decode_entities("x"), texts) == [stdlib_html.unescape(t) for t in texts]
    assert evaluate(X.decode_entities("x"), ["&copy 1", "&#xD800;|&#1;|"]) == ["© 1", "\ufffd||"]


def test_entities_of_the_standard(evaluate):
    texts = [
        "&#000000038;&#x0000000027;", "&#146;&#150;&#128;&#x99;", "&check;&lpar;&NewLine;&NotEqualTilde;", "&copy2024 &ampx &notit; &notin;",
        "&#99999999999999999999;&#x110000;&#0;", "&#65&#x42 &#;&#x;", "&AMP;&LT&gt &Aacute&aacuteb",
    ]
    assert evaluate(X.decode_entities("x"), texts) == [stdlib_html.unescape(t) for t in texts]
    kept = ["?a=1&copy=2", "?a&copyright", "&copy", "&copy;=1", "&amp=1&amp;=2"]
    assert evaluate(X.decode_entities("x", attribute=True), kept) == ["?a=1&copy=2", "?a&copyright", "©", "©=1", "&amp=1&=2"]


def test_rounding_is_exact(evaluate):
    values = [0.25, 0.35, 0.45, 2.25, 2.75, 33.35, 99.95, 0.05, 0.15, 100.0, 0.0, 66.66666666666667]
    rng = random.Random(7)
    values += [rng.randrange(1, 5000) / rng.randrange(1, 400) for _ in range(500)]
    values += [n / 20 for n in range(400)]
    assert evaluate(X.round1("x"), values, "double") == [round(v, 1) for v in values]
    assert evaluate(X.signed1("x"), [10.0, -2.25, 0.0], "double") == [f"{v:+.1f}" for v in (10.0, -2.25, 0.0)]


def reference_normal(url):
    url, _ = urldefrag(url.strip())
    p = urlparse(url)
    path = p.path or "/"
    path = path if path == "/" else path.rstrip("/")
    return urlunparse((p.scheme.lower(), p.netloc.lower(), path, "", p.query, ""))


URLS = [
    "HTTP://Ex.COM", "https://ex.com/a/b/?q=1#f", "https://ex.com/a/;v=1", "https://ex.com/a;x/b;y?z", "http://u:P@ex.com:8080/A/",
    "http://ex.com//", "http://ex.com//?q", "https://ex.com?x=1", "https://ex.com/a b", " https://ex.com/a// ", "https://ex.com/?", "https://ex.com/%7Ea",
]
BASES = [
    "https://ex.com/", "https://ex.com", "https://ex.com/a/b/c?q=1", "http://ex.com/a/b/", "https://ex.com/a;p/b;q?r=1", "https://ex.com//x/y",
]
HREFS = [
    "/", "/about", "about", "./about", "../up", "../../../top", "..", ".", "a/./b/../c", "?q=2", "x?y=1#z", "//Other.com/p/", "http://Z.com/a/../b",
    "https://z.com", "/a//b", "a//b", "/a/../b/", "/.hidden", "/x/.", "/x/..", "g;x=1/../y", "ftp://f/x", "/é ü", "/a?b=/../c", "HTTPS://Q.com/W/", "/a.b/c.d", "sub/",
]


def test_normalize_url(evaluate):
    assert evaluate(U.normalize_url("x"), URLS) == [reference_normal(u) for u in URLS]
    assert evaluate(U.normalize_url("x"), ["ex.com/a", "", None, "mailto:a@b"]) == [None] * 4


def test_resolve_url(spark):
    pairs = [(b, h) for b in BASES for h in HREFS]
    df = spark.createDataFrame(pairs, "b string, h string").coalesce(1)
    got = df.selectExpr("h", f"{U.base_parts('b')} as base").selectExpr(f"{U.resolve_url('base', 'h')} as u")
    want = []
    for base, href in pairs:
        joined = urljoin(base, href)
        want.append(reference_normal(joined) if urlparse(joined).scheme in ("http", "https") else None)
    for pair, g, w in zip(pairs, [r.u for r in got.collect()], want):
        assert g == w, pair


def test_unresolvable_hrefs(spark):
    df = spark.createDataFrame([("https://ex.com/a", h) for h in ("", "mailto:x", "tel:1", "javascript:x", "data:x", "http:foo")], "b string, h string")
    rows = df.selectExpr("h", f"{U.base_parts('b')} as base").selectExpr(f"{U.resolve_url('base', 'h')} as u").collect()
    assert [r.u for r in rows] == [None] * 6


def test_hosts_and_skipped_hrefs(evaluate):
    assert evaluate(U.host("x"), ["HTTP://A.b:80/x", "https://u@c?d", "nothing"]) == ["a.b:80", "u@c", ""]
    assert evaluate(U.normal_host("x"), ["http://a.b:80/x/y", "https://c?d", "https://c"]) == ["a.b:80", "c", "c"]
    assert evaluate(U.same_host("x", "'https://www.a.b/'"), ["http://www.a.b/x", "http://a.b/"]) == [True, False]
    hrefs = ["/a", "", "#x", "MailTo:a", "blob:1", "sms:1", "jav", "data:1", "tel:2"]
    assert evaluate(U.is_page_href("x"), hrefs) == [True] + [False] * 5 + [True, False, False]
    assert evaluate(U.sitemap_url("x"), ["https://Ex.com/a/b"]) == ["https://Ex.com/sitemap.xml"]
    assert evaluate(U.robots_url("x"), ["https://ex.com:8/a"]) == ["https://ex.com:8/robots.txt"]


def test_percent_coding(evaluate):
    texts = ["/a b+c*~é%41", "100%", "/x%zz%20", "%E9", "plain/path?q=1&r=2"]
    assert evaluate(RB.unquote("x"), texts) == [unquote(t) for t in texts]
    assert evaluate(RB.quote("x"), texts) == [quote(t) for t in texts]


def test_attributes(evaluate):
    def attr(name, tags):
        return evaluate(f"get(transform({H.parsed_tags('array(x)')}, t -> {H.attr('t', name)}), 0)", tags)

    tags = [
        "<img src='a' ALT=\"x > y\" alt=z>", "<img data-alt=1 title='alt=no' >", "<img alt>", "<img alt=''/>", "<img alt = b&amp;c>", "<img x=\"1\"alt=2>",
    ]
    assert attr("alt", tags) == ["x > y", None, "", "", "b&c", "2"]


def test_hostile_pages_stay_linear(evaluate):
    n = 200_000
    pages = [
        "<!--" * n, "<h1>" * n, "<title>" * n, "<a " + "=" * n + ">", "<a b='" + "x" * n, "<a " + "x=1 " * n + ">", " " * n + "x" + " " * n,
        "<script>" * n, "<svg>" * n, "&" * n, "<" * n,
    ]
    start = time.time()
    sizes = evaluate(
        f"length({H.visible_text(H.dom('x'))}) + coalesce(size({H.headings(H.dom('x'))}), 0)"
        f" + size({H.fact_tags(H.dom('x'))}) + coalesce(length({H.title_text(H.dom('x'))}), 0)",
        pages,
    )
    assert len(sizes) == len(pages)
    assert time.time() - start < 60
