"""Periodic runs, template text and importance resampling against plain versions."""

import hashlib
import math
import random
import re
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from crawlsight.llm import periodic, resample, templates

# --- periodic runs ----------------------------------------------------------


def plain_runs(x, options):
    """Every stretch that agrees with itself one period on, if no smaller period does."""
    n, found = len(x), []
    for q in range(1, n):
        i = 0
        while i + q < n:
            j = i
            while j + q < n and x[j] == x[j + q]:
                j += 1
            length = j - i + q
            if j > i and length >= max(options.least_words, options.least_exponent * q):
                part = x[i : i + length]
                if not any(all(part[k] == part[k + r] for k in range(length - r)) for r in range(1, q)):
                    found.append((i, q, length))
            i = j + 1
    return sorted(found)


@pytest.mark.parametrize("options", [periodic.RunOptions(), periodic.RunOptions(2, 2), periodic.RunOptions(4, 3)])
def test_runs_equal_the_plain_search(options):
    dice = random.Random(5)
    for _ in range(700):
        n, k = dice.randint(0, 40), dice.choice([1, 2, 2, 3, 6])
        x = [str(dice.randrange(k)) for _ in range(n)]
        if n and dice.random() < 0.5:
            a, p = dice.randrange(n), dice.randint(1, 7)
            x = x[:a] + [x[min(a + i % p, n - 1)] for i in range(n - a)]
        assert periodic.runs(x, options) == plain_runs(x, options)


def test_common_extensions_equal_a_scan():
    dice = np.random.default_rng(3)
    for n in (1, 2, 7, 200):
        x = dice.integers(0, 3, n).tolist()
        lce = periodic.Lce(x)
        a, b = (g.ravel() for g in np.meshgrid(np.arange(n), np.arange(n)))
        a, b = a[a != b], b[a != b]

        def scan(i, j):
            k = 0
            while max(i, j) + k < n and x[i + k] == x[j + k]:
                k += 1
            return k

        assert lce(a, b).tolist() == [scan(i, j) for i, j in zip(a, b)]


def test_long_loops_are_linear():
    words = ["a", "b", "c"] * 40_000
    assert periodic.runs(words) == [(0, 3, 120_000)]
    assert periodic.collapsed(words, [(0, 3, 120_000)]) == ["a", "b", "c"]


def test_digest_of_odd_rows(odd, clashing, none, same):
    assert periodic.digest(none).count() == 0
    same(periodic.digest(odd), periodic.digest(clashing))
    got = {r.doc_id: r for r in periodic.digest(odd).collect()}
    empty = hashlib.sha256(b"").hexdigest()
    for doc in (2, 3, 4):
        assert (got[doc].n_runs, got[doc].start, got[doc].runs_sha256, got[doc].collapsed_sha256) == (0, None, empty, empty)
    assert got[11].collapsed_sha256 == hashlib.sha256(b"one").hexdigest()


def test_digest_equals_the_contract_word_by_word(spark):
    docs = [(i, " ".join(f"w{(k * 7 + i) % 23}" for k in range(i % 90))) for i in range(400)] + [(None, "a " * 30)]
    rows = {r.doc_id: r for r in periodic.digest(spark.createDataFrame(docs, "doc_id long, text string")).collect()}
    options, loops = periodic.RunOptions(), 0
    for doc, text in docs:
        w = text.split()
        h, n = zlib.crc32(str(doc).encode()), len(w)
        if doc is not None and h % 10 == 0 and n:
            g = h // 10
            a = g % n
            p = 1 + (n - a) // (3 + g % 8)
            w = [w[i] if i < a else w[a + (i - a) % p] for i in range(n)]
            loops += 1
        found = plain_runs(w, options)
        gone = {k for s, q, m in found for k in range(s + q, s + m)}
        r = rows[doc]
        assert r.n_runs == len(found)
        assert r.runs_sha256 == hashlib.sha256("".join(f"{s},{m},{q}\n" for s, q, m in found).encode()).hexdigest()
        assert r.collapsed_sha256 == hashlib.sha256(" ".join(x for k, x in enumerate(w) if k not in gone).encode()).hexdigest()
        if found:
            s, q, m = min(found, key=lambda f: (-f[2] / f[1], f[0], f[1]))
            assert (r.start, r.period, r.length, r.exponent_milli) == (s, q, m, 1000 * m // q)
    assert loops > 20


def test_rows_of_runs_and_collapsed_texts(spark):
    docs = spark.createDataFrame([(1, "x " + "a b " * 5 + "y"), (2, "no loop here")], "doc_id long, text string")
    assert [tuple(r) for r in periodic.find(docs).collect()] == [(1, 1, 2, 10)]
    assert sorted(tuple(r) for r in periodic.without_repeats(docs).collect()) == [(1, "x a b y"), (2, "no loop here")]


# --- template text ----------------------------------------------------------

LOREM = "amber birch cedar delta ember frost grove heath inlet jetty knoll larch mossy north ochre pines quartz ridge".split()


def prose(n, words):
    return " ".join(LOREM[(k * k + n * 7 + k * n) % 18] + str((k * 13 + n) % 50) for k in range(words))


def plain_page(n, words=40):
    """A page without any telling element: only what its pages share tells the text from the rest."""
    paragraphs = [prose(n * 10 + k, words) for k in range(1 + n % 4)]
    page = (
        f"<html><head><title>{prose(n, 3)}</title></head><body><div id=top><a href='/{n}'>Start</a> <a href=/x>All of it</a></div>"
        f"<div id=side>{prose(n + 900, 4)}</div><div id=mid><h1>Head {n}</h1><p>Please read this line first</p>"
        + "".join(f"<p>{p}" for p in paragraphs)
        + f"</div><div id=low>&copy; somebody {n}</div></body></html>"
    )
    return page, " ".join([f"Head {n}", *paragraphs])


def of_host(spark, pages, host="h.example"):
    return spark.createDataFrame([(n, f"http://{host}/{n}", p) for n, p in enumerate(pages)], "page_id long, url string, html string")


def texts(df):
    return {r.page_id: r.text for r in df.collect()}


def test_the_template_finds_text_that_no_element_names(spark):
    pages = [plain_page(n) for n in range(30)]
    got = texts(templates.extract(of_host(spark, [p for p, _ in pages])))
    # The line that every page repeats is the template's own.
    assert got == {n: t for n, (_, t) in enumerate(pages)}


def test_without_enough_pages_the_body_is_read(spark):
    pages = [plain_page(n) for n in range(2)]
    got = texts(templates.extract(of_host(spark, [p for p, _ in pages])))
    for n, (_, text) in enumerate(pages):
        assert text.split()[-1] in got[n] and "Please read this line first" in got[n]


def test_dealt_templates_give_the_same(spark, same):
    rows = of_host(spark, [plain_page(n)[0] for n in range(40)])
    for host in ("b.example", "c.example"):
        rows = rows.unionByName(of_host(spark, [plain_page(n + 50)[0].replace("mid", "core") for n in range(9)], host))
    rows = rows.unionByName(spark.createDataFrame([(99, None, "<p>alone"), (98, "http://d.example/", None)], rows.schema))
    same(templates.extract(rows), templates.extract(rows.repartition(7), templates.TemplateOptions(broadcast_tokens=0)))


def test_classes_that_change_order_or_cross_are_not_valid(spark):
    html = "<html><body><div><i>left</i><b>right</b></div><p>{}</p></body></html>"
    turned = "<html><body><div><b>right</b><i>left</i></div><p>{}</p></body></html>"
    pages = [(turned if n % 2 else html).format(prose(n, 20)) for n in range(12)]
    options = templates.TemplateOptions()
    rows = templates._pages(of_host(spark, pages))
    tokenized = templates._tokenized(rows, options).cache()
    found = templates.induce(tokenized, options).collect()
    assert len(found) == 1 and found[0].pages == 12 and found[0].invalid
    straight = templates._tokenized(templates._pages(of_host(spark, [html.format(prose(n, 20)) for n in range(12)])), options)
    assert not templates.induce(straight.cache(), options).collect()[0].invalid


def test_copies_of_an_article_are_no_template(spark):
    same_page = "<html><body><article><h1>One</h1><p>told again</p><p>" + prose(3, 30) + "</p></article></body></html>"
    others = [f"<html><body><article><h1>{prose(n, 2)}</h1><p>{prose(n, 25)}</p></article></body></html>" for n in range(10)]
    got = texts(templates.extract(of_host(spark, [same_page] * 8 + others)))
    assert all(got[n] == "One told again " + prose(3, 30) for n in range(8))


BESIDE = (
    "<header><a>Site</a></header><nav><ul><li>menu</ul></nav><div class='cookie-notice'>we use cookies</div>"
    "<aside>side</aside><div class=ad>buy</div><form>name <input></form><script>var t='</p>';</script><style>p{}</style><footer>end</footer>"
)


def test_one_page_by_its_elements(spark):
    body = "<article><h1>A &amp; B</h1><p>one<b>two</b> three<br>four<p>caf&eacute; &#8364; &lt;x&gt;</p><aside>no</aside><div class='share'>no</div></article>"
    talk = "<section id=comments><article class=comment>me too</article></section>"
    want = "A & B onetwo three four café € <x>"
    for page in (
        f"<!doctype html><html><body>{BESIDE}{body}{talk}</body></html>",
        f"<body>{BESIDE}{body}{talk}",
        f"{body}{talk}",
        f"<BODY>{BESIDE}{body.replace('article', 'main')}{talk}",
        f"<BODY>{BESIDE}{body.replace('article', 'div')}{talk}</BODY>",
    ):
        assert templates.main_text(page) == want, page
    assert templates.main_text("") == ""
    assert templates.main_text("<p>a <!-- no --> b</p><!-- open") == "a b"
    assert templates.main_text("1 < 2 and <b>") == "1 < 2 and"


def test_markup_that_is_not_closed_stays_linear():
    for piece in ("<p", "<a b=\"", "<!--", "<div class='x", "<script>", "</"):
        templates.main_text("<article>" + piece * 30_000)
    deep = templates.main_text("<article>" + "<b>x " * 3000)
    assert deep.count("x") == 3000


def test_extract_of_odd_rows(spark, none):
    rows = spark.createDataFrame(
        [(1, None, None), (2, "no host", "<p>x"), (2, "no host", "<p>x"), (None, "http://a/", ""), (3, "http://a/", "<article>" + "long text " * 50_000)],
        "page_id long, url string, html string",
    )
    got = templates.extract(rows.selectExpr("*", "1 as row", "2 as site", "3 as token", "4 as text", "5 as entries")).collect()
    assert sorted((r.page_id or 0, r.url or "", r.n_chars) for r in got) == [
        (0, "http://a/", 0), (1, "", 0), (2, "no host", 1), (2, "no host", 1), (3, "http://a/", 499_999),
    ]
    assert templates.extract(rows.limit(0)).count() == 0


# --- importance resampling --------------------------------------------------


def plain_resample(docs, target, options):
    def words(t):
        lowered = re.sub("[A-Z]", lambda m: m.group().lower(), t or "")
        return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", lowered)

    def features(t):
        w = words(t)
        return [" ".join(w[i : i + n]) for n in range(1, options.max_words + 1) for i in range(len(w) - n + 1)]

    def bucket(x):
        return zlib.crc32(x.encode()) % options.buckets

    s, t = [0] * options.buckets, [0] * options.buckets
    for _, text in docs:
        for f in features(text):
            s[bucket(f)] += 1
    for text in target:
        for f in features(text):
            t[bucket(f)] += 1
    total_s, total_t, n = sum(s), sum(t), options.buckets
    gain = [math.floor(1000 * math.log((b + 1) * (total_s + n) / ((a + 1) * (total_t + n)))) for a, b in zip(s, t)]
    out = []
    for doc, text in docs:
        weight = sum(gain[bucket(f)] for f in features(text))
        h = int(hashlib.sha256(f"{options.seed}:{'' if doc is None else doc}".encode()).hexdigest()[:8], 16)
        score = weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296)))
        out.append([doc, len(features(text)), weight, score, None, len(words(text))])
    may = sorted((r for r in out if r[5] >= options.least), key=lambda r: (-r[3], r[0] is None, r[0] or 0))
    for k, r in enumerate(may[: options.percent * len(may) // 100]):
        r[4] = k + 1
    return sorted((tuple(r[:5]) for r in out), key=repr)


def resampled(spark, docs, target, options=resample.ResampleOptions()):
    rows = resample.resample(
        spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame([(t,) for t in target], "text string"), options
    )
    return sorted((tuple(r) for r in rows.collect()), key=repr)


TARGET = ["amber birch Cedar delta", None, "frost grove " * 5]


def test_resampling_equals_the_plain_version(spark):
    docs = [(i, prose(i, i % 70)) for i in range(300)] + [(400, None), (401, "ÄÖ-Straße ABC " * 20), (None, prose(3, 50)), (403, "x " * 30_000)]
    for options in (resample.ResampleOptions(), resample.ResampleOptions(max_words=3, buckets=97, percent=40, least=5, cuts=2)):
        assert resampled(spark, docs, TARGET, options) == plain_resample(docs, TARGET, options)


@pytest.mark.parametrize("percent", [0, 1, 35, 50, 99, 100])
def test_cuts_among_ties(spark, percent):
    # One id for a third of the rows, ids that are NULL, equal scores: ties of every kind.
    docs = [(7, prose(1, 30))] * 40 + [(None, prose(2, 30))] * 40 + [(i, prose(4, 30)) for i in range(40)]
    options = resample.ResampleOptions(percent=percent)
    assert resampled(spark, docs, TARGET, options) == plain_resample(docs, TARGET, options)


def test_resampling_of_odd_rows(spark, odd, clashing, none, same):
    target = spark.createDataFrame([("one quick fox",)], "text string")
    same(resample.resample(odd, target), resample.resample(clashing, target))
    assert resample.resample(none, target).count() == 0
    assert resample.resample(odd, target.limit(0)).count() == odd.count()
    assert resample.selected(odd.filter("doc_id <> 6"), target, resample.ResampleOptions(percent=50)).columns == [*odd.columns, "_rank"]


def test_nth_finds_any_place(spark):
    dice = random.Random(2)
    values = sorted(dice.choice([-5, 0, 3, dice.randrange(-(10**12), 10**12)]) for _ in range(200))
    rows = spark.createDataFrame([(v,) for v in values], "v long")
    for n in (1, 2, 77, 199, 200):
        assert resample.nth(rows, F.col("v"), n, 5) == values[n - 1]
