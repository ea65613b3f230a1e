import json

import pytest
from helpers import fetch, fetches
from pyspark.sql import functions as F

from crawlsight.config import AuditOptions, Scoring
from crawlsight.operators import metrics as M
from crawlsight.operators.checks import (
    Check,
    CheckRegistry,
    Context,
    PageRule,
    duplicate_title_members,
    issue_urls,
    page_issues,
    run_checks,
)
from crawlsight.operators.facts import page_facts
from crawlsight.operators.score import score_audits, score_sites, with_score


def page(title="", desc="", extra="", body="<h1>x</h1><a href='/in'>l</a>"):
    head = f"<title>{title}</title>" + (f'<meta name="description" content="{desc}">' if desc else "")
    return f"<html><head>{head}{extra}</head><body>{body}</body></html>"


@pytest.fixture(scope="module")
def run(spark):
    def go(rows, options=None, registry=None, isolate=False):
        df = fetches(spark, rows).cache()
        ctx = Context(page_facts(df).cache(), df, options or AuditOptions())
        return ctx, run_checks(ctx, registry, isolate)

    return go


def codes(issues, url):
    rows = issues.filter(F.col("url") == url).orderBy("analyzer_ord", "phase", "page_ord", "item_ord").collect()
    return [r.code for r in rows if r.code not in ("missing_canonical", "missing_schema")]


def test_length_bounds(run):
    lengths = [(29, 69), (30, 70), (60, 160), (61, 161)]
    rows = [
        fetch(f"https://ex.com/{n}", page(str(n) * t, "d" * d), n) for n, (t, d) in enumerate(lengths)
    ]
    _, issues = run(rows)
    issues.cache()
    assert codes(issues, "https://ex.com/0") == ["title_too_short", "meta_description_too_short"]
    assert codes(issues, "https://ex.com/1") == [] and codes(issues, "https://ex.com/2") == []
    assert codes(issues, "https://ex.com/3") == ["title_too_long", "meta_description_too_long"]
    messages = {r.message for r in issues.collect()}
    assert "Title is short (29 chars; aim for 30-60)" in messages
    assert "Meta description is long (161 chars; aim for 70-160)" in messages


def test_all_problems_of_one_page(run):
    _, issues = run([fetch("https://ex.com/", "<html><body><p>some text</p><img src=/x.png></body></html>")])
    assert codes(issues, "https://ex.com/") == [
        "missing_title", "missing_meta_description", "missing_h1", "missing_image_alt", "no_internal_links",
    ]
    details = {r.code: json.loads(r.details) for r in issues.collect()}
    assert details["missing_title"] == {"og_title": None, "twitter_title": None, "title_source": None}
    assert details["missing_image_alt"] == {"src": "https://ex.com/x.png"}
    assert details["missing_h1"]["likely_js_shell"] is False


def test_shell_note_and_headings(run):
    rows = [
        fetch("https://ex.com/a", "<p>tiny</p>", 0),
        fetch("https://ex.com/b", "<p>tiny</p>", 1, js_rendered=True),
        fetch("https://ex.com/c", page("t", body="<h1>a</h1><h1>b</h1>" + "<h3>x</h3>" * 12), 2),
    ]
    _, issues = run(rows)
    got = {(r.url[-1], r.code): r for r in issues.collect()}
    assert "JS shell" in got["a", "missing_h1"].message and "JS shell" not in got["b", "missing_h1"].message
    assert got["c", "multiple_h1"].message == "Page has 2 H1 headings"
    assert len(json.loads(got["c", "skipped_heading_level"].details)["h3"]) == 10


def test_links_robots_size_sitemap_schema(run):
    size = 200
    rows = [
        fetch("https://ex.com/gone", None, 0, 404),
        fetch("https://ex.com/old", page("t", extra="<meta name=robots content='NoIndex , NOFOLLOW'>"), 1,
              final_url="https://ex.com/moved", redirect_chain=[("https://ex.com/old", 301), ("https://ex.com/moved", 200)]),
        fetch("https://ex.com/none", page("t", extra="<meta name=robots content=none><script type='application/ld+json'>{}</script>"), 2),
        fetch("https://far.example/x", None, 3, 0, depth=-1, error="HTTP 500"),
        fetch("https://far.example/ok", None, 4, 200, depth=-1),
        fetch("https://ex.com/size", page("t").ljust(size), 5),
        fetch("https://ex.com/less", page("t").ljust(size - 1), 6),
        fetch("https://two.com/sitemap.xml", page("t"), 0, seed="https://two.com/", audit="a2"),
    ]
    _, issues = run(rows, AuditOptions(page_size_threshold=size))
    got = {(r.url, r.code): r for r in issues.collect()}
    assert got["https://ex.com/gone", "broken_page"].message == "HTTP 404"
    assert got["https://ex.com/old", "redirect_chain"].message == "Redirect chain with 2 hops"
    assert {c for u, c in got if u.endswith("/moved")} >= {"robots_noindex", "robots_nofollow"}
    assert {c for u, c in got if u.endswith("/none")} & {"robots_noindex", "schema_untyped", "missing_schema"} == {"schema_untyped"}
    assert got["https://far.example/x", "broken_external_link"].details == '{"status_code":0}'
    assert not [k for k in got if k[0].endswith("/ok")]
    assert ("https://ex.com/size", "large_page") in got and ("https://ex.com/less", "large_page") not in got
    assert [u for u, c in got if c == "sitemap_not_checked"] == ["https://ex.com/sitemap.xml"]


def test_duplicate_titles(run):
    rows = [fetch(f"https://ex.com/{n}", page("Same Title" if n % 2 else "same title "), n) for n in range(5)]
    rows += [fetch("https://ex.com/x", page("Other"), 9), fetch("https://b.com/", page("Same title"), 0, seed="https://b.com/", audit="b")]
    ctx, issues = run(rows, AuditOptions())
    (dup,) = issues.filter("code = 'duplicate_title'").collect()
    assert dup.url == "https://ex.com/0" and dup.message == "Duplicate title found on 5 pages" and dup.phase == 1
    assert json.loads(dup.details) == {"title": "same title", "pages": 5}
    urls = issue_urls(ctx.facts).orderBy("page_ord").collect()
    assert [r.url for r in urls] == [f"https://ex.com/{n}" for n in range(5)] and {r.issue_page_ord for r in urls} == {0}
    assert duplicate_title_members(ctx.facts).count() == 5


def test_a_faulty_check_is_isolated(run):
    def boom(options):
        raise RuntimeError("no luck")

    at_run_time = PageRule("never", "info", "raise_error('late') is null", "'x'")
    registry = (
        CheckRegistry()
        .register(Check("broken", boom))
        .register(Check("unknown", lambda o: [PageRule("c", "info", "no_such_column > 1", "'x'")]))
        .register(Check("late", lambda o: [at_run_time]))
        .register(Check("own", lambda o: [PageRule("has_text", "info", "word_count > 0", "concat('words: ', word_count)")]))
    )
    _, issues = run([fetch("https://ex.com/", page("t"))], registry=registry, isolate=True)
    failed = {r.analyzer: r for r in issues.filter("code = 'analyzer_error'").collect()}
    assert set(failed) == {"broken", "unknown", "late"}
    assert failed["broken"].message == "Analyzer 'broken' failed: no luck" and failed["broken"].url is None
    assert failed["broken"].severity == "warning"
    assert issues.filter("code = 'has_text'").count() == 1 and issues.filter("code = 'missing_schema'").count() == 1
    assert registry.names()[:3] == ["title", "meta_description", "headings"] and len(registry.names()) == 14


def test_faulty_metrics_become_a_row_and_spare_the_others(run):
    bad = Check("bad", lambda o: [PageRule("seen", "info", "true", "'x'")], None, lambda o: {"n": "sum(no_such_column)"})
    fine = Check("fine", metrics=lambda o: {"pages": "count(*)"})
    ctx, issues = run([fetch("https://ex.com/", page("t"))], registry=CheckRegistry().register(bad).register(fine))
    (failed,) = issues.filter("code = 'analyzer_error'").collect()
    assert failed.analyzer == "bad" and issues.filter("code = 'seen'").isEmpty()
    metrics = {(r.analyzer, r.metric): r.value for r in M.check_metrics(ctx, CheckRegistry().register(bad).register(fine)).collect()}
    assert metrics["fine", "pages"] == 1 and metrics["title", "pages_with_title"] == 1 and ("bad", "n") not in metrics


def test_registry_of_metrics_only(run):
    registry = CheckRegistry([Check("fine", metrics=lambda o: {"pages": "count(*)"})])
    ctx, issues = run([fetch("https://ex.com/", page("t"))], registry=registry)
    assert issues.count() == 0 and M.check_metrics(ctx, registry).count() == 1


def test_own_checks_count_in_site_scores(run):
    def on_site(ctx):
        return ctx.fetches.select("audit_id", "seed_url").distinct().selectExpr(
            "audit_id", "seed_url", "0L as page_ord", "'slow' as code", "'critical' as severity", "'x' as message", "seed_url as url", "'{}' as details"
        )

    own = Check("own", lambda o: [PageRule("p", "warning", "true", "'x'")], on_site)
    registry = CheckRegistry().register(own)
    ctx, issues = run([fetch(f"https://ex.com/{n}", page("t"), n) for n in range(2)], registry=registry)
    slow = score_audits(ctx.fetches.select("audit_id", "seed_url").distinct(), issues).first()
    fast = score_sites(ctx.facts, ctx.fetches, registry=registry).first()
    assert (slow.critical, slow.warning, slow.info) == (fast.critical, fast.warning, fast.info)
    with pytest.raises(ValueError):
        score_sites(ctx.facts, ctx.fetches, registry=CheckRegistry([own]))


def test_page_issues_equal_the_page_phase(run):
    ctx, issues = run([fetch(f"https://ex.com/{n}", page("t"), n) for n in range(3)])
    alone = page_issues(ctx.facts, ctx.options)
    assert sorted(map(str, alone.collect())) == sorted(map(str, issues.filter("phase = 0").collect()))


def test_scores(run, spark):
    rows = [fetch(f"https://ex.com/{n}", page("same"), n) for n in range(4)]
    rows += [fetch(f"https://b.com/{n}", None, n, 500, seed="https://b.com/", audit="b") for n in range(20)]
    rows.append(fetch("https://far.example/", None, 9, 0, depth=-1, error="x"))
    ctx, issues = run(rows)
    spine = ctx.fetches.select("audit_id", "seed_url").distinct()
    slow = {r.audit_id: r for r in score_audits(spine, issues).collect()}
    fast = {r.audit_id: r for r in score_sites(ctx.facts, ctx.fetches).collect()}
    for a in slow:
        assert (slow[a].critical, slow[a].warning, slow[a].info, slow[a].score) == (
            fast[a].critical, fast[a].warning, fast[a].info, fast[a].score,
        )
    assert slow["b"].score == 0.0 and slow["b"].raw_penalty == 161
    # 4 short titles, 4 missing descriptions, 1 duplicate, 1 external link; 4 canonical, 4 schema, 1 sitemap
    assert (slow["a1"].warning, slow["a1"].info, slow["a1"].score) == (10, 9, 61.0)
    none = score_audits(spine, issues.filter("false")).collect()
    assert {r.score for r in none} == {100.0}
    counts = spark.sql("select 0L critical, 1L warning, 0L info")
    assert with_score(counts, Scoring(base=150, warning=10)).first().score == 100.0


def test_metrics_match_brute_force(run):
    images = "<img src=1><img src=2 alt=a><img src=3 alt=b>"
    rows = [
        fetch("https://ex.com/1", page("a" * 33, "b" * 71, body="<h1>x</h1>" + images + "<a href=/q>q</a>" * 2), 0),
        fetch("https://ex.com/2", page("a" * 33, "b" * 72, body="<h1>y</h1><h2>z</h2><a href=/q>q</a>"), 1),
        fetch("https://ex.com/3", page("c" * 35, "b" * 72, "<script type='application/ld+json'>{\"@type\":[\"A\",\"B\"]}</script>"), 2),
        fetch("https://ex.com/4", None, 3, 500),
    ]
    ctx, _ = run(rows)
    got = {(r.analyzer, r.metric): r.value for r in M.check_metrics(ctx).collect()}
    assert got["title", "avg_title_length"] == round((33 + 33 + 35) / 3, 1)
    assert got["meta_description", "avg_meta_description_length"] == round((71 + 72 + 72) / 3, 1)
    assert got["image_alt", "alt_coverage_pct"] == 66.7
    assert (got["title", "duplicates"], got["title", "missing"], got["title", "pages_with_title"]) == (1, 0, 3)
    assert (got["links", "broken"], got["links", "internal_link_occurrences"], got["links", "internal_links_unique"]) == (1, 4, 3)
    assert (got["schema", "pages_with_schema"], got["schema", "unique_schema_types"]) == (1, 2)
    assert (got["headings", "total_h1"], got["headings", "pages_with_h2"], got["page_size", "threshold"]) == (3, 1, 3145728)
    as_json = {r.analyzer: json.loads(r.metrics) for r in M.metrics_by_check(ctx).collect()}
    assert as_json["schema"]["unique_schema_types"] == 2
    assert {r.schema_type: r.pages for r in M.schema_types(ctx.facts).collect()} == {"A": 1, "B": 1}
    assert as_json["sitemap"] == {"sitemap_observed": False}
    totals = M.structured_totals(ctx.facts).first()
    assert (totals.pages_total, totals.pages_live, totals.pages_broken, totals.total_images) == (4, 3, 1, 3)
    assert M.page_summaries(ctx.facts).count() == 4 and len(M.page_summaries(ctx.facts).columns) == 34 + 3
    assert len(M.page_overview(ctx.facts).columns) == 24 + 3


def test_options_are_copied():
    base = AuditOptions()
    changed = base.overlay(max_pages=7, max_depth=None, save=True)
    assert (changed.max_pages, changed.max_depth, changed.persists) == (7, 3, True)
    assert base.max_pages == 50 and not base.persists and AuditOptions(compare=True).persists
