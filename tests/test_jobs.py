import glob
import json

import pytest
from helpers import TIDES_PAGE, fetch, fetches

from crawlsight.config import AuditOptions
from crawlsight.operators import diff as D
from crawlsight.operators import report as R
from crawlsight.operators import suggest as S
from crawlsight.plans import audit as A
from crawlsight.sources import sinks, store
from crawlsight.streaming import arrivals as ST

RUN = "2024-05-01 10:00:00"


def site(spark, run, title, broken=False):
    rows = [
        fetch("https://ex.com/", TIDES_PAGE, 0, audit=run),
        fetch("https://ex.com/b", f"<title>{title}</title><h1>x</h1>", 1, audit=run),
        fetch("https://ex.com/c", None, 2, 404 if broken else 200, audit=run),
    ]
    return fetches(spark, rows)


@pytest.fixture(scope="module")
def runs(spark):
    first = A.audit_sites(site(spark, "r1", "short"), RUN)
    second = A.audit_sites(site(spark, "r2", "longer", broken=True), "2024-05-02 10:00:00.5")
    A.compare_audits(second, first.audits, first.issues)
    return first, second


def text_of(lines):
    return "\n".join(r.line for r in lines.orderBy("audit_id", "section_ord", "item_ord").collect())


def test_audit_rows(runs):
    row = runs[0].audits.first()
    assert (row.pages, row.seed_url, row.severity.critical) == (3, "https://ex.com/", 1)
    assert row.score == 100 - 8 * row.severity.critical - 3 * row.severity.warning - row.severity.info
    assert len(row.analyzers_run) == 10 and str(row.created_at) == "2024-05-01 10:00:00"


def test_comparison(runs):
    diff = runs[1].diffs.first()
    assert diff.has_baseline and diff.score_delta == 0.0
    # the short title has another length and the broken page another text
    assert (diff.new_issues, diff.resolved_issues) == (2, 2)
    assert diff.summary == f"Score unchanged. New issues: 2. Resolved issues: 2. Unchanged: {diff.unchanged_issue_count}."
    text = text_of(A.change_report(runs[1]).withColumnRenamed("seed_url", "audit_id"))
    assert text.startswith("# SEO Audit Change Report\n\n**URL:** https://ex.com/\n**Current audit:** r2\n**Previous audit:** r1\n")
    assert "**Score delta:** +0.0\n\n## Summary\n" in text
    assert text.index("## New Issues") < text.index("chars; aim") < text.index("## Resolved Issues") < text.index("## Unchanged")
    summary = A.audit_summary(runs[1]).first()
    assert summary.compare.new_issues == 2 and summary.compare.has_baseline


def issue_rows(spark, rows):
    return spark.createDataFrame(rows, "seed_url string, code string, url string, message string, severity string")


def test_diff_keys(spark):
    old = issue_rows(spark, [("s", "a", None, "m", "info"), ("s", "b", "u", "m", "info"), ("s", "b", "u", "m", "info"), ("s", "gone", "u", "m", "info")])
    new = issue_rows(spark, [("s", "a", None, "m", "critical"), ("s", "b", "u", "m", "info"), ("s", "n", None, "m", "info"), ("s", "n", None, "m", "info")])
    assert [r.code for r in D.new_issues(new, old).collect()] == ["n", "n"]
    assert [r.code for r in D.resolved_issues(new, old).collect()] == ["gone"]
    counts = D.key_counts(new, old).first()
    assert (counts.new_issues, counts.resolved_issues, counts.unchanged_issue_count) == (2, 1, 2)
    assert D.new_issues(old, old).isEmpty() and D.resolved_issues(old, old).isEmpty()
    assert sorted(map(str, D.new_issues(new, old).collect())) == sorted(map(str, D.resolved_issues(old, new).collect()))


def test_scores_in_diffs(spark):
    audits = "audit_id string, seed_url string, score double"
    now = spark.createDataFrame([("a2", "s", 90.0), ("b2", "t", 70.5), ("c2", "u", 50.0)], audits)
    before = spark.createDataFrame([("a1", "s", 80.0), ("b1", "t", 80.75)], audits)
    none = issue_rows(spark, [])
    got = {r.url: r for r in D.compare(now, before, none, none).collect()}
    assert got["s"].summary.startswith("Score improved by 10.0. New issues: 0.")
    assert got["t"].summary.startswith("Score declined by 10.2.")
    assert not got["u"].has_baseline and got["u"].score_delta == 0.0 and got["u"].previous_audit_id is None
    assert got["u"].summary == "No previous audit found for this URL."


def test_markdown_report(runs):
    text = text_of(A.report(runs[1], metrics=True))
    headings = [x for x in text.split("\n") if x.startswith("#")]
    assert headings == [
        "# SEO Audit Report", "## Summary", "## Critical Issues", "## Warnings", "## Suggestions", "## Change Report",
        "## Page Overview", "## Structured SEO Metrics", "## Overall SEO Score",
    ]
    assert "**Created:** 2024-05-02T10:00:00.500000+00:00" in text
    assert "- [broken_page] HTTP 404 (`https://ex.com/c`)" in text
    assert "- `https://ex.com/c` — (no title) [broken]\n  - title_len=0, meta_len=0, h1=0," in text
    assert "schema=Dataset,Place" in text and "- Live pages: 2 / 3" in text
    assert "- Note: Score unchanged." in text and text.endswith("/ 100**\n")
    top = [x for x in text.split("\n") if x.startswith("- Top issue codes:")]
    assert len(top) == 1 and len(top[0].split(", ")) == 5


def test_json_report_is_one_document(runs, spark, tmp_path):
    doc = json.loads(text_of(A.report(runs[1], "json")))
    assert set(doc) == {
        "summary", "critical_issues", "warnings", "suggestions", "overall_seo_score", "optimization", "diff", "page_overview",
    }
    assert doc["summary"]["pages_analyzed"] == 3 and len(doc["page_overview"]) == 3
    assert doc["critical_issues"][0]["details"]["status_code"] == 404
    assert doc["diff"]["new_issues"] == 2 and doc["optimization"] is None
    assert len(doc["warnings"]) == doc["summary"]["warning_count"]
    whole = json.loads(text_of(A.report(runs[1], "json", full_audit=True)))
    assert len(whole["pages"]) == 3 and len(whole["issues"]) == whole["audit"]["issues"]
    assert len(whole["pages"][0]) == 38 and len(whole["analyzer_results"]) == 10
    change = json.loads(text_of(A.change_report(runs[1], "json")))
    assert len(change["new_issues"]) == 2 == len(change["resolved_issues"]) and change["previous_audit_id"] == "r1"
    sinks.write_text(A.report(runs[1]), str(tmp_path / "deep" / "report"), ["r2"])
    files = sorted(glob.glob(f"{tmp_path}/deep/report/audit=r2/*.txt"))
    assert "".join(open(f, encoding="utf-8").read() for f in files).rstrip("\n") == text_of(A.report(runs[1])).rstrip("\n")
    sinks.write_json(runs[1].diffs, str(tmp_path / "diff"))
    assert spark.read.json(str(tmp_path / "diff")).count() == 1


def test_long_lists_are_lines(spark):
    """2,000 pages of one title: the issue is short, its list complete in the document."""
    rows = [fetch(f"https://ex.com/{n}", "<title>Same</title><h1>x</h1>", n) for n in range(2000)]
    result = A.audit_sites(fetches(spark, rows), RUN)
    doc = json.loads(text_of(A.report(result, "json")))
    (dup,) = [i for i in doc["warnings"] if i["code"] == "duplicate_title"]
    assert dup["details"] == {"pages": 2000, "title": "same", "urls": [f"https://ex.com/{n}" for n in range(2000)]}
    whole = json.loads(text_of(A.report(result, "json", full_audit=True)))
    assert [i["details"] for i in whole["issues"] if i["code"] == "duplicate_title"] == [dup["details"]] and whole["schema_types"] == []


def test_records_without_an_address_are_rejected(spark):
    rows = [fetch("https://ex.com/", "<title>t</title>", 0), fetch(None, "<p>x</p>", 1), fetch("https://ex.com/b", "x", 2, audit=None), fetch("https://ex.com/c", "x", 3, seed=None)]
    result = A.audit_sites(fetches(spark, rows), RUN)
    assert [(r.audit_id, r.pages) for r in result.audits.collect()] == [("a1", 1)]
    reasons = {r.page_ord: r.reason for r in result.rejected.collect()}
    assert reasons == {1: "no usable address", 2: "no audit", 3: "no usable site address"}


def test_lines_of_many_audits(runs, spark, tmp_path):
    sinks.write_lines(A.report(runs[0]).unionByName(A.report(runs[1])), str(tmp_path / "lines"))
    again = spark.read.parquet(str(tmp_path / "lines"))
    assert text_of(again.filter("audit_id = 'r1'")) == text_of(A.report(runs[0]))


def test_report_formats_and_lookup(runs):
    with pytest.raises(NotImplementedError):
        A.report(runs[0], "PDF")
    with pytest.raises(ValueError):
        A.report(runs[0], "html")
    with pytest.raises(KeyError):
        A.report_by_id(runs[0], "nothing")
    assert A.report_by_id(runs[0], "r1").count() == A.report(runs[0]).count()


def test_top_codes_ties(spark):
    rows = [("a", "s", c, n, 0, 0, 0) for n, c in enumerate(["x", "y", "x", "z", "y", "p", "q", "r"])]
    issues = spark.createDataFrame(rows, "audit_id string, seed_url string, code string, analyzer_ord int, phase int, page_ord long, item_ord int")
    got = [r.code for r in R.top_codes(issues).orderBy("rank").collect()]
    assert got == ["x", "y", "z", "p", "q"]


def test_compact_view_and_bounds(runs, evaluate):
    result = runs[1]
    view = json.loads(R.compact_view(result.summary(), result.issues, result.totals(), result.metrics_json(), result.registry.names()).first().view)
    assert view["issues"] == len(view["top_issues"]) and view["top_issues"][0]["code"] == "title_too_short"
    assert {r["analyzer"]: r["issue_count"] for r in view["analyzer_results"]}["links"] >= 1
    assert [r["analyzer"] for r in view["analyzer_results"]] == result.registry.names()
    long = "x" * 12_001
    assert evaluate(R.bounded_text("x"), [long, "y" * 12_000]) == [long[:12_000] + "\n\n…[truncated]", "y" * 12_000]
    row = R.audit_rows(result.summary()).first()
    assert row.pages == 3 and row.issues == result.issues.count()


def test_store(runs, spark, tmp_path):
    first, second = runs
    root = str(tmp_path / "store")
    A.persist(first, root, "2024-05-01 11:00:00")
    assert not glob.glob(f"{root}/*")  # neither saving nor comparing was asked for
    for result, at in ((first, "2024-05-01 11:00:00"), (second, "2024-05-02 11:00:00")):
        result.options = AuditOptions(save=True)
        A.persist(result, root, at)
    audits = store.load(spark, f"{root}/audits", "HTTPS://EX.com/")
    assert {r.audit_id for r in audits.collect()} == {"r1", "r2"}
    saved = spark.read.parquet(f"{root}/issues")
    assert store.current_rows(saved, audits).count() == first.issues.count() + second.issues.count()
    A.persist(first, root, "2024-05-03 11:00:00")
    again, saved = store.load(spark, f"{root}/audits"), spark.read.parquet(f"{root}/issues")
    assert again.count() == 2 and store.current_rows(saved, again).count() == first.issues.count() + second.issues.count()
    assert store.load(spark, f"{root}/audits", "https://other.com").isEmpty()
    assert store.latest(audits).first().audit_id == "r2"
    assert [r.audit_id for r in store.history(audits, "https://ex.com", 1).collect()] == ["r2"]
    assert [r.audit_id for r in store.history(audits, "https://EX.com/").collect()] == ["r2", "r1"]
    assert {r.audit_id: r.previous_audit_id for r in store.previous(audits, audits).collect()} == {"r2": "r1", "r1": "r2"}
    assert {r.audit_id: r.previous_audit_id for r in store.previous_in_time(audits).collect()} == {"r2": "r1", "r1": None}
    listing = {r.audit_id: r for r in store.listing(audits, first.issues, first.facts).collect()}
    assert listing["r1"].pages == 3 and listing["r2"].issue_count == 0 and listing["r1"]["count"] == 2
    assert listing["r1"].created_at == "2024-05-01T10:00:00+00:00"
    assert store.get(audits, "r1").count() == 1
    assert store.get(store.load(spark, f"{root}/audits"), "r1", "https://EX.com").count() == 1
    assert store.delete(spark, f"{root}/audits", "r1")
    assert [r.audit_id for r in store.load(spark, f"{root}/audits").collect()] == ["r2"]
    assert not store.delete(spark, f"{root}/audits", "r1")


def test_last_save_wins(runs, spark, tmp_path):
    path = str(tmp_path / "audits")
    for score, at in ((1.0, "2024-01-02"), (2.0, "2024-01-03"), (3.0, "2024-01-01")):
        store.save(spark.sql(f"select 'x' audit_id, 'https://ex.com' seed_url, {score}D score, timestamp '{at}' saved_at"), path)
    (row,) = store.load(spark, path, "https://ex.com/").collect()
    assert row.score == 2.0 and row.seed_url == "https://ex.com/"


def test_suggestions(runs, spark):
    result = runs[0]
    reqs = A.suggestion_requests(result, S.parse_keywords(" seo, ,pages ")).orderBy("page_ord").collect()
    assert [r.url for r in reqs] == ["https://ex.com/", "https://ex.com/b"]
    payload = json.loads(reqs[0].payload)
    assert payload["target_keywords"] == ["seo", "pages"] and payload["current"]["h2"] == ["Tables"]
    assert payload["candidate_internal_urls"] == ["https://ex.com/", "https://ex.com/b"]
    assert payload["current"]["images"][1] == {"src": "https://ex.com/spring.png", "alt": None}
    assert len(payload["output_schema"]) == 9 and [m.role for m in reqs[0].messages] == ["system", "user"]
    assert json.loads(S.requests(result.facts, None).filter("page_ord = 0").first().payload)["candidate_internal_urls"] == ["https://ex.com/berths"]

    good = {
        "improved_title": "New", "improved_h1": None, "heading_suggestions": ["h"], "keyword_suggestions": ["k", "l"],
        "faq_suggestions": [{"question": "Q", "answer": "A"}, 3], "schema_suggestion": {"@type": "WebPage"},
        "internal_link_suggestions": [{"anchor_text": "t", "target_url": "u", "rationale": "r"}], "notes": None,
    }
    raw = [
        json.dumps(good), f"```json\n{json.dumps(good)}\n```", "no json", "[1]", '{"improved_title": 5}',
        '{"faq_suggestions": [{"question": "Q"}]}', '{"schema_suggestion": "text"}', None,
    ]
    rows = [("r1" if n < 7 else "r9", f"u{n}", n, r, None if r else "refused") for n, r in enumerate(raw)]
    answers = spark.createDataFrame(rows, "audit_id string, url string, page_ord long, raw string, error string")
    got = S.parse_answers(answers).orderBy("page_ord").collect()
    assert [r.status for r in got] == ["ok", "ok", "error", "error", "error", "error", "ok", "error"]
    assert got[1].improved_title == "New" and got[1].improved_h1 is None and got[1].notes == []
    assert [f.question for f in got[0].faq_suggestions] == ["Q"] and got[0].schema_suggestion == '{"@type":"WebPage"}'
    assert got[6].schema_suggestion == '{"raw":"text"}' and got[7].message == "refused"

    A.with_suggestions(result, answers)
    status = result.statuses.first()
    assert (status.status, status.message) == ("partial", "Optimization suggestions generated; 4 page(s) failed")
    text = text_of(A.report(result))
    assert "## AI Optimization Suggestions\n\n### u0\n\n- **Title:** New\n- **Keywords:** k, l\n- **Headings:**\n  - h\n- **FAQs:**\n  - Q: Q\n    A: A\n" in text
    doc = json.loads(text_of(A.report(result, "json")))
    assert [p["url"] for p in doc["optimization"]["pages"]] == ["u0", "u1", "u6"] and doc["optimization"]["status"] == "partial"
    assert doc["optimization"]["pages"][0]["schema_suggestion"] == {"@type": "WebPage"}
    assert "  - [t](u) — r\n- **Schema:** JSON-LD suggestion included in JSON report\n" in text
    assert "- Note: AI optimization status: partial" in text
    pages = S.page_status(result.facts, S.parse_answers(answers.withColumn("url", answers.url))).collect()
    assert [(p.url, p.status, p.message) for p in pages] == [("https://ex.com/c", "error", "HTTP 200")]
    empty = S.site_status(result.audits, S.parse_answers(answers.filter("false"))).first()
    assert (empty.status, empty.message) == ("error", "Optimization suggestions generated")


def test_fences(evaluate):
    texts = ['```json\n{"a":1}\n```', "```\n{}", ' {"a":1} ', '```{"lost":1}\n{"b":2}\n```\n', "```"]
    assert evaluate(S.strip_fence("x"), texts) == ['{"a":1}', "{}", '{"a":1}', '{"b":2}', ""]
    assert evaluate(f"array_join({S.keywords('x')}, '|')", ["a, b ,,c", " ", ""]) == ["a|b|c", "", ""]
    assert S.parse_keywords([" a ", ""]) == ["a"] and S.parse_keywords(None) == []


def test_stream_equals_batch(spark, tmp_path):
    df = site(spark, "r1", "short")
    df.write.parquet(str(tmp_path / "in"))
    rows = ST.issues_of_arrivals(ST.read_arrivals(spark, str(tmp_path / "in"), 1))
    query = ST.write_arrivals(rows, str(tmp_path / "out"), str(tmp_path / "ckpt"))
    query.awaitTermination(120)
    want = ST.issues_of_arrivals(df)
    assert sorted(map(str, spark.read.parquet(str(tmp_path / "out")).collect())) == sorted(map(str, want.collect()))


def test_job_names():
    assert {"audit_sites", "generate_report", "compare_audits", "list_history"} <= set(A.JOBS)
