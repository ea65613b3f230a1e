"""The registered queries: every operator over the given tables."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from crawlsight.config import AuditOptions
from crawlsight.functions import text as X
from crawlsight.functions import url as U
from crawlsight.operators import crawl as CR
from crawlsight.operators import diff as D
from crawlsight.operators import metrics as M
from crawlsight.operators import render as RE
from crawlsight.operators import report as R
from crawlsight.operators import robots as RB
from crawlsight.operators import score as SC
from crawlsight.operators import suggest as S
from crawlsight.operators.checks import (
    CheckRegistry,
    Context,
    default_checks,
    duplicate_title_members,
    issue_urls,
    run_checks,
)
from crawlsight.operators.facts import page_facts, staged_pages
from crawlsight.plans import audit as A
from crawlsight.session import stage, staging_dir
from crawlsight.sources import sinks, store
from crawlsight.sources.fetches import pages_as_fetches, rejects
from crawlsight.streaming import figures as FG
from crawlsight.streaming import frontier as FR
from workload import oracle as O
from workload import scenario as SN

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None, ctes: str | None = None):
    def register(fn: Query) -> Query:
        QUERIES[fn.__name__] = fn
        if sql is not None:
            ORACLES[fn.__name__] = O.select(ctes, sql) if ctes else sql
        return fn

    return register


def plain_facts(spark, d):
    return page_facts(SN.plain_fetches(spark, d))


def rich_fetches(spark, d):
    return SN.rich_pages(spark, d)


def rich_facts(spark, d):
    return page_facts(rich_fetches(spark, d))


def with_probes(fetches: DataFrame, facts: DataFrame) -> DataFrame:
    work = stage(CR.external_worklist(facts), "worklist")
    return fetches.unionByName(CR.broken_probes(work, SN.probes(work)).select(*fetches.columns))


def rich_audit(spark, d, run_ts="2024-02-01 00:00:00") -> A.AuditResult:
    facts, records = staged_pages(rich_fetches(spark, d))
    return A.audit_sites(with_probes(records, facts), run_ts, facts=facts)


def plain_audit(spark, d, run_ts="2024-01-01 00:00:00") -> A.AuditResult:
    return A.audit_sites(SN.plain_fetches(spark, d), run_ts)


# --- URLs ------------------------------------------------------------------


@query("SELECT p AS page_id, url FROM b", O.PAGES)
def url_normalize(spark, d):
    return SN.table(spark, d, "pages").selectExpr("page_id", f"{U.normalize_url('url')} as url")


@query(
    "SELECT regexp_extract(o, '//(.*)$', 1) AS host, count(*) AS pages, count(DISTINCT url) AS urls,"
    " min(o) || '/sitemap.xml' AS sitemap, min(o) || '/robots.txt' AS robots FROM b GROUP BY 1",
    O.PAGES,
)
def url_host_rollup(spark, d):
    rows = SN.table(spark, d, "pages").selectExpr(f"{U.normalize_url('url')} as url")
    return (
        rows.selectExpr("url", f"{U.host('url')} as host")
        .groupBy("host")
        .agg(
            F.count("*").alias("pages"),
            F.countDistinct("url").alias("urls"),
            F.min(F.expr(U.sitemap_url("url"))).alias("sitemap"),
            F.min(F.expr(U.robots_url("url"))).alias("robots"),
        )
    )


@query(
    "SELECT p AS page_id, CAST(generate_subscripts(links, 1) - 1 AS INT) AS pos, unnest(links) AS url FROM f",
    O.PAGES,
)
def link_resolve(spark, d):
    links = CR.page_links(SN.plain_fetches(spark, d))
    return links.selectExpr("page_ord as page_id", "posexplode_outer(links) as (pos, url)").filter(
        "url is not null"
    )


# --- page facts ------------------------------------------------------------


@query("SELECT p AS page_id, raw_title AS title, 'title' AS title_source FROM f", O.PAGES)
def title_facts(spark, d):
    return plain_facts(spark, d).selectExpr("page_ord as page_id", "title", "title_source")


@query(
    "SELECT p AS page_id, raw_h1 AS h1, CAST(0 AS INT) AS other_headings,"
    " regexp_extract(html, '<html lang=\"([^\"]*)\"', 1) AS lang, false AS has_viewport FROM f",
    O.PAGES,
)
def heading_facts(spark, d):
    return plain_facts(spark, d).selectExpr(
        "page_ord as page_id",
        "array_join(h1, '|') as h1",
        "size(h2) + size(h3) + size(h4) + size(h5) + size(h6) as other_headings",
        "lang",
        "has_viewport",
    )


@query(
    "SELECT p AS page_id, array_to_string(list_distinct_first, '|') AS internal_links,"
    " CAST(len(links) AS INT) AS internal_link_occurrences, CAST(0 AS INT) AS external_link_occurrences"
    " FROM (SELECT *, list_filter(links, lambda x, i: list_position(links, x) = i) AS list_distinct_first FROM f)",
    O.PAGES,
)
def link_counts(spark, d):
    return plain_facts(spark, d).selectExpr(
        "page_ord as page_id",
        "array_join(internal_links, '|') as internal_links",
        "internal_link_occurrences",
        "external_link_occurrences",
    )


@query(
    f"SELECT p AS page_id, CAST(len(regexp_extract_all(t, '[\\p{{L}}\\p{{N}}_]+')) AS INT) AS word_count,"
    f" CAST(length(t) AS INT) AS text_length FROM (SELECT p, {O.node_text(O.NO_SCRIPTS)} AS t FROM b)",
    O.PAGES,
)
def visible_words(spark, d):
    return plain_facts(spark, d).selectExpr("page_ord as page_id", "word_count", "text_length")


@query("SELECT p AS page_id, CAST(strlen(html) AS BIGINT) AS content_length FROM b", O.PAGES)
def content_bytes(spark, d):
    return plain_facts(spark, d).selectExpr("page_ord as page_id", "content_length")


@query(
    "SELECT p AS page_id, coalesce(status_code, -1) AS status_code, CASE WHEN p % 19 = 0 THEN 'timeout' END AS error, final_url,"
    " CAST(CASE WHEN redirected THEN 2 ELSE 0 END AS INT) AS hops,"
    " CASE WHEN redirected THEN 'http://old.example/' || p || '|' || final_url ELSE '' END AS chain,"
    " NOT live AS is_broken, CASE WHEN NOT live THEN err END AS page_error FROM r",
    O.RICH,
)
def fetch_records(spark, d):
    fetches = rich_fetches(spark, d)
    kept = fetches.selectExpr("page_ord as page_id", "error", "size(redirect_chain) as hops")
    return (
        page_facts(fetches)
        .selectExpr(
            "page_ord as page_id", "coalesce(status_code, -1) as status_code", "final_url", "is_broken",
            "error as page_error",
            "array_join(redirect_chain, '|') as chain",
        )
        .join(kept, "page_id")
        .select("page_id", "status_code", "error", "final_url", "hops", "chain", "is_broken", "page_error")
    )


@query(
    "SELECT p AS page_id, CASE WHEN live THEN title END AS title, CASE WHEN live THEN title_source END AS title_source,"
    " CASE WHEN live THEN description END AS meta_description,"
    " CASE WHEN live THEN description_source END AS meta_description_source,"
    " CASE WHEN live THEN og_title END AS og_title, CASE WHEN live THEN twitter_title END AS twitter_title,"
    " CASE WHEN live THEN og_description END AS og_description, live AND p % 2 = 0 AS has_viewport FROM r",
    O.RICH,
)
def meta_fallback(spark, d):
    return rich_facts(spark, d).selectExpr(
        "page_ord as page_id", "title", "title_source", "meta_description", "meta_description_source",
        "og_title", "twitter_title", "og_description", "has_viewport",
    )


@query("SELECT p AS page_id, CASE WHEN live THEN robots END AS robots_meta FROM r", O.RICH)
def robots_tokens(spark, d):
    return rich_facts(spark, d).selectExpr("page_ord as page_id", "robots_meta")


@query("SELECT p AS page_id, CASE WHEN live THEN canonical END AS canonical FROM r", O.RICH)
def canonical(spark, d):
    return rich_facts(spark, d).selectExpr("page_ord as page_id", "canonical")


@query(
    "SELECT p AS page_id, o || '/i/' || p || '-' || k || '.png' AS src, CASE WHEN k <= no_alt THEN NULL"
    " ELSE 'a' || k END AS alt, CAST(k - 1 AS INT) AS pos FROM (SELECT *, unnest(generate_series(1, images)) AS k"
    " FROM r WHERE live AND images > 0)",
    O.RICH,
)
def image_dedupe(spark, d):
    return (
        rich_facts(spark, d)
        .selectExpr("page_ord as page_id", "posexplode_outer(images) as (pos, i)")
        .filter("i is not null")
        .selectExpr("page_id", "i.src", "i.alt", "pos")
    )


@query(
    "SELECT p AS page_id, live AND has_json_ld AS has_json_ld,"
    " CASE WHEN live THEN array_to_string(types, '|') ELSE '' END AS schema_types FROM r",
    O.RICH,
)
def jsonld_types(spark, d):
    return rich_facts(spark, d).selectExpr(
        "page_ord as page_id", "has_json_ld", "array_join(schema_types, '|') as schema_types"
    )


@query(
    "SELECT page_id, unnest(['/i/' || page_id || '.png', '/w/' || page_id || '.webp', '/v/' || page_id % 2]) AS src,"
    " unnest(['seen', NULL, NULL]) AS alt, unnest([0, 1, 2]) AS pos FROM pages WHERE page_id % 3 = 0"
    " UNION ALL SELECT page_id, '/i/' || page_id || '.png', 'seen', 0 FROM pages WHERE page_id % 3 = 1"
)
def picture_images(spark, d):
    """Sources of picture elements among a page's images: direct children only, and none of other elements."""
    own = (
        """concat('<picture><source media="all" srcset="/w/', page_id, '.webp 1x, /w2.webp 2x"><div><source srcset="/inside.webp"></div>"""
        """<img src="/i/', page_id, '.png" alt=seen></picture><picture><SOURCE srcset="/v/', page_id % 2, '"></picture>')"""
    )
    other = """concat('<video><source srcset="/film.webp"></video><img alt=seen src="/i/', page_id, '.png">')"""
    rows = SN.pages(spark, d).selectExpr(
        "page_id", "url", f"concat('<body>', case page_id % 3 when 0 then {own} when 1 then {other} else '' end, '</body>') as html"
    )
    return (
        page_facts(pages_as_fetches(rows))
        .selectExpr("page_ord as page_id", "posexplode_outer(images) as (pos, i)")
        .filter("i is not null")
        .selectExpr("page_id", "regexp_replace(i.src, '^https?://[^/]+', '') as src", "i.alt", "pos")
    )


DOC_WORDS = (
    "WITH w AS (SELECT doc_id, CAST(len(regexp_extract_all(text, '[\\p{L}\\p{N}_]+')) AS INT) AS n,"
    f" CAST(length({O.strip('text')}) AS INT) AS t FROM documents) "
)


@query(
    DOC_WORDS + "SELECT doc_id AS page_id, n AS word_count, t AS text_length,"
    " n < 40 OR (n < 80 AND doc_id % 2 = 0) AS likely_js_shell,"
    " CASE WHEN n < 40 OR (n < 80 AND doc_id % 2 = 0) THEN 'likely_js_shell' ELSE '' END AS warnings FROM w"
)
def js_shell(spark, d):
    return page_facts(SN.document_fetches(spark, d)).selectExpr(
        "page_ord as page_id", "word_count", "text_length", "likely_js_shell",
        "array_join(extraction_warnings, '|') as warnings",
    )


@query(
    DOC_WORDS + "SELECT doc_id AS page_id, t < 200 AS thin, doc_id % 2 = 0 OR t < 120 AS spa_shell FROM w"
    " WHERE t < 200 OR doc_id % 2 = 0"
)
def render_worklist(spark, d):
    return RE.render_worklist(SN.document_fetches(spark, d)).selectExpr(
        "page_ord as page_id", "thin", "spa_shell"
    )


def rendered_documents(spark, d):
    """Documents as pages after a renderer answered for every third one, and for every sixth with nothing."""
    fetches = SN.document_fetches(spark, d)
    rendered = "concat('<html><title>Rendered ', page_ord, '</title><main>', repeat('word ', 90), '</main></html>')"
    answers = fetches.filter("page_ord % 3 = 0").selectExpr("audit_id", "url", f"if(page_ord % 6 = 3, '', {rendered}) as html")
    return RE.with_rendered(fetches, answers)


_RENDERED = (
    DOC_WORDS + ", x AS (SELECT w.*, source, text, (t < 200 OR doc_id % 2 = 0) AND doc_id % 6 = 0 AS rendered,"
    " CASE WHEN doc_id % 2 = 0 THEN '\"App\"' ELSE 'main' END AS root FROM w JOIN documents USING (doc_id)) "
)


@query(
    _RENDERED + "SELECT doc_id AS page_id, rendered AS js_rendered, CASE WHEN rendered THEN 'Rendered ' || doc_id END AS title,"
    " CASE WHEN rendered THEN length('<html><title>Rendered </title><main></main></html>') + length(CAST(doc_id AS VARCHAR)) + 450"
    " ELSE length('<html><body><div id=></div></body></html>') + length(root)"
    " + strlen(replace(replace(replace(text, '&', '&amp;'), '\"', '&quot;'), '<', '&lt;')) END AS content_length FROM x"
)
def rendered_pages(spark, d):
    """Pages with what a renderer returned for them."""
    return page_facts(rendered_documents(spark, d)).selectExpr("page_ord as page_id", "js_rendered", "title", "content_length")


@query(
    _RENDERED + "SELECT 'd:https://' || source || '.docs.example/' AS audit_id, count(*) FILTER (WHERE rendered) AS js_rendered_pages,"
    " count(*) FILTER (WHERE NOT rendered AND (n < 40 OR (n < 80 AND doc_id % 2 = 0))) AS js_shell_pages,"
    " CAST(sum(CASE WHEN rendered THEN 92 ELSE n END) AS BIGINT) AS total_word_count FROM x GROUP BY 1"
)
def rendering_totals(spark, d):
    """Rendered pages, pages that are still shells, and words of each site."""
    return M.structured_totals(page_facts(rendered_documents(spark, d))).select(
        "audit_id", "js_rendered_pages", "js_shell_pages", "total_word_count"
    )


@query(
    "SELECT p AS page_id, CAST(length(title) AS INT) AS title_length, CAST(length(description) AS INT) AS"
    " meta_description_length, CAST(h1 AS INT) AS h1_count, CAST(h2 AS INT) AS h2_count, CAST(h3 AS INT) AS h3_count,"
    " CAST(h4 AS INT) AS h4_count, 0 AS h5_count, 0 AS h6_count, CAST(h1 + h2 + h3 + h4 AS INT) AS heading_count,"
    " CAST(len(inside) AS INT) AS internal_link_occurrences, CAST(ext_n > 0 AS INT) AS unique_external_links,"
    " true AS has_lang, false AS js_rendered, false AS likely_js_shell,"
    " array_to_string(list_filter([CASE title_source WHEN 'og:title' THEN 'title_fallback_og' WHEN 'twitter:title' THEN 'title_fallback_twitter' END,"
    " CASE description_source WHEN 'og:description' THEN 'meta_description_fallback_og' WHEN 'twitter:description' THEN 'meta_description_fallback_twitter' END,"
    " CASE WHEN p % 8 = 3 THEN 'json_ld_present_but_unparsed' END], lambda w: w IS NOT NULL), '|') AS warnings,"
    " CAST(images AS INT) AS image_count, CAST(no_alt AS INT) AS images_missing_alt,"
    " CAST(len(list_distinct(inside)) AS INT) AS unique_internal_links, CAST(ext_n AS INT) AS external_link_occurrences,"
    " CAST(len(types) AS INT) AS schema_type_count, canonical IS NOT NULL AS has_canonical,"
    " robots IS NOT NULL AS has_robots_meta, p % 2 = 0 AS has_viewport FROM"
    " (SELECT * REPLACE (coalesce(title, '') AS title, coalesce(description, '') AS description) FROM r) WHERE live",
    O.RICH,
)
def seo_signals(spark, d):
    names = (
        "title_length", "meta_description_length", "h1_count", "heading_count", "image_count",
        "images_missing_alt", "unique_internal_links", "external_link_occurrences",
        "schema_type_count", "has_canonical", "has_robots_meta", "has_viewport",
        "h2_count", "h3_count", "h4_count", "h5_count", "h6_count", "internal_link_occurrences",
        "unique_external_links", "has_lang", "js_rendered", "likely_js_shell",
    )
    return rich_facts(spark, d).filter("not is_broken").selectExpr(
        "page_ord as page_id", *[f"seo_signals.{n}" for n in names], "array_join(extraction_warnings, '|') as warnings"
    )


# --- checks ----------------------------------------------------------------

ISSUE_FIELDS = ("audit_id", "code", "severity", "message", "url", "details", "page_ord")
_ONLY_KEYS = "SELECT audit_id, code, severity, message, url, page_ord FROM"


def one_check(spark, d, name, fields=ISSUE_FIELDS):
    fetches = rich_fetches(spark, d)
    facts = page_facts(fetches)
    check = [c for c in default_checks() if c.name == name]
    if check[0].site_issues:
        facts = stage(facts, "page_facts")
        fetches = with_probes(fetches, facts) if name == "links" else fetches
    return run_checks(Context(facts, fetches, AuditOptions()), CheckRegistry(check)).select(*fields)


@query(O.union(O.CHECKS["title"]), O.RICH)
def issues_title(spark, d):
    return one_check(spark, d, "title")


@query(O.union(O.CHECKS["meta_description"]), O.RICH)
def issues_meta(spark, d):
    return one_check(spark, d, "meta_description")


@query(f"{_ONLY_KEYS} ({O.union(O.CHECKS['headings'])})", O.RICH)
def issues_headings(spark, d):
    return one_check(spark, d, "headings", [f for f in ISSUE_FIELDS if f != "details"])


def with_words_checked(issues: DataFrame, facts: DataFrame) -> DataFrame:
    """Details with the word count taken out, and whether it is the page's own."""
    words = facts.selectExpr("audit_id as a", "page_ord as o", "word_count")
    counted = F.expr("get_json_object(details, '$.word_count')")
    return issues.join(words, F.expr("audit_id = a and page_ord = o")).select(
        "audit_id", "code", "page_ord",
        F.regexp_replace("details", '"word_count":[0-9]+', '"word_count":0').alias("details"),
        (counted.isNull() | (counted.cast("bigint") == F.col("word_count"))).alias("own_words"),
    )


@query(
    f"SELECT audit_id, code, page_ord, details, true AS own_words FROM ({O.union(O.heading_details())})", O.RICH
)
def heading_details(spark, d):
    facts = stage(rich_facts(spark, d), "page_facts")
    check = [c for c in default_checks() if c.name == "headings"]
    return with_words_checked(run_checks(Context(facts, rich_fetches(spark, d), AuditOptions()), CheckRegistry(check)), facts)


@query(
    f"SELECT audit_id, code, page_ord, details, true AS own_words FROM ({O.unlinked_details()})", O.RICH
)
def unlinked_details(spark, d):
    fetches = rich_fetches(spark, d)
    facts = stage(page_facts(fetches), "page_facts")
    check = [c for c in default_checks() if c.name == "links"]
    issues = run_checks(Context(facts, with_probes(fetches, facts), AuditOptions()), CheckRegistry(check))
    return with_words_checked(issues.filter("code = 'no_internal_links'"), facts)


@query(O.union(O.CHECKS["image_alt"]), O.RICH)
def issues_images(spark, d):
    return one_check(spark, d, "image_alt")


@query(O.union(O.CHECKS["links"]), O.RICH + "," + O.EXTERNAL)
def issues_links(spark, d):
    rows = one_check(spark, d, "links")
    return rows.withColumn(
        "details", F.expr("if(code = 'no_internal_links', '-', details)")
    )


@query(O.union(O.CHECKS["canonical"]), O.RICH)
def issues_canonical(spark, d):
    return one_check(spark, d, "canonical")


@query(O.union(O.CHECKS["robots"]), O.RICH)
def issues_robots(spark, d):
    return one_check(spark, d, "robots")


SIZE_LIMIT = 8000


@query(
    "SELECT 'a:' || seed AS audit_id, 'large_page' AS code, 'warning' AS severity,"
    " 'Page is large (' || strlen(html) || ' bytes)' AS message, url,"
    f" '{{\"content_length\":' || strlen(html) || ',\"threshold\":{SIZE_LIMIT}}}' AS details, p AS page_ord"
    f" FROM b WHERE strlen(html) >= {SIZE_LIMIT}",
    O.PAGES,
)
def issues_size(spark, d):
    fetches = SN.plain_fetches(spark, d)
    check = [c for c in default_checks() if c.name == "page_size"]
    options = AuditOptions().overlay(page_size_threshold=SIZE_LIMIT)
    return run_checks(Context(page_facts(fetches), fetches, options), CheckRegistry(check)).select(*ISSUE_FIELDS)


@query(O.union(O.CHECKS["schema"]), O.RICH)
def issues_schema(spark, d):
    return one_check(spark, d, "schema")


@query(O.union(O.CHECKS["sitemap"]), O.RICH)
def issues_sitemap(spark, d):
    fetches = SN.rich_pages(spark, d)
    check = [c for c in default_checks() if c.name == "sitemap"]
    return run_checks(Context(fetches, fetches, AuditOptions()), CheckRegistry(check)).select(*ISSUE_FIELDS)


@query(
    f"SELECT r.audit_id, g.k AS title_key, r.p AS page_ord, r.final_url, g.n FROM r JOIN ({O.duplicate_groups()}) g"
    " ON g.audit_id = r.audit_id AND g.k = lower(r.title) WHERE r.live",
    O.RICH,
)
def duplicate_titles(spark, d):
    facts = stage(rich_facts(spark, d).select("audit_id", "seed_url", "page_ord", "final_url", "title", "is_broken"), "titles")
    return duplicate_title_members(facts).select("audit_id", "title_key", "page_ord", "final_url", "n")


@query(
    f"SELECT r.audit_id, g.k AS title_key, g.p AS issue_page_ord, r.p AS page_ord, r.final_url AS url FROM r JOIN ({O.duplicate_groups()}) g"
    " ON g.audit_id = r.audit_id AND g.k = lower(r.title) WHERE r.live",
    O.RICH,
)
def issue_url_lists(spark, d):
    facts = stage(rich_facts(spark, d).select("audit_id", "seed_url", "page_ord", "final_url", "title", "is_broken"), "titles")
    return issue_urls(facts).drop("seed_url")


@query(
    "SELECT DISTINCT audit_id, 'analyzer_error' AS code, 'warning' AS severity,"
    " 'Analyzer ''unsound'' failed: ' AS message_start FROM r",
    O.RICH,
)
def issues_faulty_metrics(spark, d):
    """A check whose metric names no column: its own issues are left out, the error is a row."""
    from crawlsight.operators.checks import Check, PageRule

    fetches = SN.rich_pages(spark, d)
    ctx = Context(page_facts(fetches), fetches.drop("html"), AuditOptions())
    check = Check("unsound", lambda o: [PageRule("seen", "info", "true", "'x'")], None, lambda o: {"n": "sum(no_such_column)"})
    return run_checks(ctx, CheckRegistry([check])).selectExpr(
        "audit_id", "code", "severity", "left(message, 27) as message_start"
    )


@query(
    "SELECT DISTINCT audit_id, 'analyzer_error' AS code, 'warning' AS severity,"
    " 'Analyzer ''faulty'' failed: no such figure' AS message, CAST(NULL AS VARCHAR) AS url FROM r",
    O.RICH,
)
def issues_faulty_check(spark, d):
    from crawlsight.operators.checks import Check

    def faulty(options):
        raise ValueError("no such figure")

    fetches = SN.rich_pages(spark, d)
    ctx = Context(page_facts(fetches), fetches.drop("html"), AuditOptions())
    return run_checks(ctx, CheckRegistry([Check("faulty", faulty)])).select(
        "audit_id", "code", "severity", "message", "url"
    )


# --- scores and metrics ----------------------------------------------------


@query(
    "SELECT audit_id, analyzer, code, severity, count(*) AS n FROM issues GROUP BY ALL", O.ISSUES
)
def issue_counts(spark, d):
    return rich_audit(spark, d).issues.groupBy("audit_id", "analyzer", "code", "severity").agg(
        F.count("*").alias("n")
    )


_COUNTS = (
    "SELECT r.audit_id, r.seed AS seed_url, r.pages, coalesce(i.critical, 0) AS critical,"
    " coalesce(i.warning, 0) AS warning, coalesce(i.info, 0) AS info FROM"
    " (SELECT audit_id, seed, count(*) AS pages FROM r GROUP BY 1, 2) r LEFT JOIN (SELECT audit_id,"
    " count(*) FILTER (WHERE severity = 'critical') AS critical,"
    " count(*) FILTER (WHERE severity = 'warning') AS warning,"
    " count(*) FILTER (WHERE severity = 'info') AS info FROM issues GROUP BY 1) i USING (audit_id)"
)
_SCORED = (
    f"SELECT *, 8 * critical + 3 * warning + info AS raw_penalty,"
    f" CAST(greatest(0, least(100, 100 - 8 * critical - 3 * warning - info)) AS DOUBLE) AS score FROM ({_COUNTS})"
)


@query(f"SELECT audit_id, seed_url, critical, warning, info FROM ({_COUNTS})", O.ISSUES)
def severity_counts(spark, d):
    return SC.severity_counts(rich_audit(spark, d).issues).drop("issues")


@query(_SCORED, O.ISSUES)
def site_score(spark, d):
    facts = stage(rich_facts(spark, d), "page_facts")
    return SC.score_sites(facts, with_probes(rich_fetches(spark, d), facts).drop("html"))


@query(
    "SELECT audit_id, seed AS seed_url, pages, critical, warning, info,"
    " 8 * critical + 3 * warning + info AS raw_penalty,"
    " CAST(greatest(0, least(100, 100 - 8 * critical - 3 * warning - info)) AS DOUBLE) AS score FROM ("
    "SELECT q.audit_id, q.seed, q.pages, count(*) FILTER (WHERE severity = 'critical') AS critical,"
    " count(*) FILTER (WHERE severity = 'warning') AS warning, count(*) FILTER (WHERE severity = 'info') AS info"
    " FROM (SELECT audit_id, seed, count(*) AS pages FROM q GROUP BY 1, 2) q JOIN old USING (audit_id) GROUP BY 1, 2, 3)",
    O.PAGES + "," + O.PLAIN_ISSUES,
)
def page_scores(spark, d):
    """Flagship: the score of every site straight from its pages."""
    fetches = SN.plain_fetches(spark, d)
    return SC.score_sites(page_facts(fetches), SN.plain_fetches(spark, d).drop("html"))


_LIVE_SUM = "CAST(coalesce(sum({}) FILTER (WHERE live), 0) AS BIGINT)"


def _live_sum(x):
    return _LIVE_SUM.format(x)


@query(
    "SELECT audit_id, count(*) AS pages_total, count(*) FILTER (WHERE live) AS pages_live,"
    " count(*) FILTER (WHERE NOT live) AS pages_broken,"
    " count(*) FILTER (WHERE live AND title IS NOT NULL) AS coverage_titles,"
    " count(*) FILTER (WHERE live AND description IS NOT NULL) AS coverage_meta_descriptions,"
    " count(*) FILTER (WHERE live AND h1 > 0) AS coverage_h1,"
    " count(*) FILTER (WHERE live AND canonical IS NOT NULL) AS coverage_canonical,"
    " count(*) FILTER (WHERE live AND has_json_ld) AS coverage_schema,"
    f" {_live_sum('h1')} AS total_h1, {_live_sum('h2')} AS total_h2, {_live_sum('h3')} AS total_h3,"
    f" {_live_sum('images')} AS total_images,"
    f" {_live_sum('len(list_distinct(inside))')} AS total_internal_links_unique,"
    f" {_live_sum('CASE WHEN ext_n > 0 THEN 1 ELSE 0 END')} AS total_external_links_unique,"
    f" {_live_sum('len(inside)')} AS total_internal_link_occurrences,"
    f" {_live_sum('ext_n')} AS total_external_link_occurrences, CAST(0 AS BIGINT) AS js_shell_pages, CAST(0 AS BIGINT) AS js_rendered_pages FROM r GROUP BY 1",
    O.RICH,
)
def coverage_totals(spark, d):
    return M.structured_totals(rich_facts(spark, d)).drop(
        "seed_url", "total_word_count"
    )


def _long(name: str, metrics: dict[str, str]) -> str:
    return " UNION ALL ".join(
        f"SELECT audit_id, '{name}' AS analyzer, '{m}' AS metric, CAST({v} AS DOUBLE) AS value FROM r GROUP BY 1"
        for m, v in metrics.items()
    )


def _n(where: str) -> str:
    return f"count(*) FILTER (WHERE live AND {where})"


def _avg(x: str) -> str:
    return f"coalesce(round(sum(length({x})) FILTER (WHERE live AND {x} IS NOT NULL) * 1.0 / nullif({_n(x + ' IS NOT NULL')}, 0), 1), 0)"


_METRICS = " UNION ALL ".join(
    [
        _long("title", {
            "missing": _n("title IS NULL"), "too_short": _n("length(title) < 30"), "too_long": _n("length(title) > 60"),
            "fallback_titles": _n("title_source <> 'title'"), "pages_with_title": _n("title IS NOT NULL"),
        }),
        f"SELECT a.audit_id, 'title', 'duplicates', CAST(coalesce(n, 0) AS DOUBLE) FROM (SELECT DISTINCT audit_id FROM r) a"
        f" LEFT JOIN (SELECT audit_id, count(*) AS n FROM ({O.duplicate_groups()}) GROUP BY 1) USING (audit_id)",
        _long("meta_description", {
            "missing": _n("description IS NULL"), "too_short": _n("length(description) < 70"),
            "too_long": _n("length(description) > 160"), "fallback_descriptions": _n("description_source <> 'description'"),
            "pages_with_meta_description": _n("description IS NOT NULL"),
        }),
        _long("headings", {
            "missing_h1": _n("h1 = 0"), "multiple_h1": _n("h1 > 1"), "empty_h1_filtered": "0",
            "pages_with_h2": _n("h2 > 0"), "total_h1": _live_sum("h1"), "total_h2": _live_sum("h2"),
            "total_h3": _live_sum("h3"),
        }),
        _long("image_alt", {
            "missing_alt": _live_sum("no_alt"), "images_total": _live_sum("images"),
            "pages_with_images": _n("images > 0"), "pages_missing_alt": _n("no_alt > 0"),
        }),
        _long("links", {
            "broken_pages": "count(*) FILTER (WHERE NOT live)",
            "redirect_chains": "count(*) FILTER (WHERE redirected)",
            "internal_links_unique": _live_sum("len(list_distinct(inside))"),
            "external_links_unique": _live_sum("CASE WHEN ext_n > 0 THEN 1 ELSE 0 END"),
            "internal_link_occurrences": _live_sum("len(inside)"),
            "external_link_occurrences": _live_sum("ext_n"),
            "pages_without_internal_links": _n("len(inside) = 0"),
        }),
        "SELECT audit_id, 'links', m, CAST(coalesce(b.n, 0) + CASE WHEN m = 'broken' THEN c ELSE 0 END AS DOUBLE)"
        " FROM (SELECT audit_id, count(*) FILTER (WHERE NOT live) AS c,"
        " unnest(['broken', 'broken_external_links']) AS m FROM r GROUP BY 1)"
        " LEFT JOIN (SELECT audit_id, count(*) AS n FROM bad GROUP BY 1) b USING (audit_id)",
        _long("canonical", {"missing": _n("canonical IS NULL")}),
        _long("robots", {"noindex": _n("p % 5 = 0")}),
        _long("page_size", {"large_pages": "0", "threshold": "3145728"}),
        _long("sitemap", {"sitemap_observed": "CAST(bool_or(contains(final_url, 'sitemap.xml')) AS INT)"}),
        _long("schema", {
            "pages_missing_schema": _n("NOT has_json_ld"), "pages_with_schema": _n("has_json_ld"),
            "unique_schema_types": "2 * (CAST(coalesce(bool_or(live AND p % 8 = 0), false) AS INT)"
            " + CAST(coalesce(bool_or(live AND p % 8 = 2), false) AS INT))",
        }),
    ]
)


@query(_METRICS, O.RICH + "," + O.EXTERNAL)
def check_metrics(spark, d):
    """Rounded averages are rows of ``metric_averages``: SQL engines round ties differently."""
    result = rich_audit(spark, d)
    return result.metrics().filter(
        "metric not in ('avg_title_length', 'avg_meta_description_length', 'alt_coverage_pct')"
    ).select("audit_id", "analyzer", "metric", "value")


@query(
    "SELECT audit_id, t AS schema_type, count(*) AS pages FROM (SELECT audit_id, unnest(types) AS t FROM r WHERE live)"
    " GROUP BY 1, 2",
    O.RICH,
)
def schema_histogram(spark, d):
    return M.schema_types(rich_facts(spark, d)).select("audit_id", "schema_type", "pages")


@query(_METRICS, O.RICH + "," + O.EXTERNAL)
def metrics_by_check(spark, d):
    """The JSON objects taken apart again; rounded averages as in ``check_metrics``."""
    objects = rich_audit(spark, d).metrics_json()
    cells = objects.selectExpr("audit_id", "analyzer", "explode(from_json(metrics, 'map<string,string>')) as (metric, v)")
    return cells.filter(
        "metric not in ('avg_title_length', 'avg_meta_description_length', 'alt_coverage_pct')"
    ).selectExpr("audit_id", "analyzer", "metric", "case v when 'true' then 1D when 'false' then 0D else cast(v as double) end as value")


def _average(analyzer: str, metric: str, value: str) -> str:
    """One decimal by the exact binary value, ties to even, as formatting does it."""
    rounded = f"CAST(format('{{:.1f}}', CAST({value} AS DOUBLE)) AS DOUBLE)"
    return f"SELECT audit_id, '{analyzer}' AS analyzer, '{metric}' AS metric, {rounded} AS value, {rounded} AS json_value FROM r GROUP BY 1"


def _mean_length(x: str) -> str:
    return f"coalesce(sum(length({x})) FILTER (WHERE live AND {x} <> '') / nullif({_n(x + " <> ''")}, 0), 0)"


@query(
    " UNION ALL ".join([
        _average("title", "avg_title_length", _mean_length("title")),
        _average("meta_description", "avg_meta_description_length", _mean_length("description")),
        _average("image_alt", "alt_coverage_pct",
                 f"coalesce(100 * ({_live_sum('images')} - {_live_sum('no_alt')}) / nullif({_live_sum('images')}, 0), 100)"),
    ]),
    O.RICH,
)
def metric_averages(spark, d):
    """The rounded averages that ``check_metrics`` and ``metrics_by_check`` leave out, in long form and from the JSON objects."""
    result = rich_audit(spark, d)
    averages = "metric in ('avg_title_length', 'avg_meta_description_length', 'alt_coverage_pct')"
    cells = result.metrics_json().selectExpr("audit_id", "analyzer", "explode(from_json(metrics, 'map<string,string>')) as (metric, v)")
    cells = cells.filter(averages).selectExpr("audit_id", "analyzer", "metric", "cast(v as double) as json_value")
    long = result.metrics().filter(averages).select("audit_id", "analyzer", "metric", "value")
    return long.join(cells, ["audit_id", "analyzer", "metric"], "full")


_PAGE_FIGURES = (
    "CASE WHEN live THEN CAST(length(coalesce(title, '')) AS INT) ELSE 0 END AS title_length,"
    " CASE WHEN live THEN CAST(length(coalesce(description, '')) AS INT) ELSE 0 END AS meta_description_length,"
    " CAST(CASE WHEN live THEN h1 ELSE 0 END AS INT) AS h1_count, CAST(CASE WHEN live THEN images ELSE 0 END AS INT)"
    " AS image_count, CAST(CASE WHEN live THEN no_alt ELSE 0 END AS INT) AS images_missing_alt"
)


@query(
    f"SELECT p AS page_ord, final_url AS url, coalesce(status_code, -1) AS status_code, NOT live AS is_broken, {_PAGE_FIGURES},"
    " CAST(CASE WHEN live THEN len(list_distinct(inside)) ELSE 0 END AS INT) AS internal_links,"
    " CASE WHEN live THEN array_to_string(types, '|') ELSE '' END AS schema_types,"
    " CASE WHEN live THEN title END AS title, CASE WHEN live THEN title_source END AS title_source,"
    " CASE WHEN live THEN description END AS meta_description, CASE WHEN live THEN canonical END AS canonical,"
    " CAST(CASE WHEN live THEN h2 ELSE 0 END AS INT) AS h2_count, CAST(CASE WHEN live THEN h3 ELSE 0 END AS INT) AS h3_count,"
    " CAST(CASE WHEN live THEN len(inside) ELSE 0 END AS INT) AS internal_link_occurrences,"
    " CAST(CASE WHEN live AND ext_n > 0 THEN 1 ELSE 0 END AS INT) AS external_links,"
    " CAST(CASE WHEN live THEN ext_n ELSE 0 END AS INT) AS external_link_occurrences,"
    " live AND has_json_ld AS has_json_ld, false AS js_rendered FROM r",
    O.RICH,
)
def page_overview(spark, d):
    return M.page_overview(rich_facts(spark, d)).selectExpr(
        "title", "title_source", "meta_description", "canonical", "h2_count", "h3_count", "internal_link_occurrences",
        "external_links", "external_link_occurrences", "has_json_ld", "js_rendered", "page_ord", "url", "coalesce(status_code, -1) as status_code", "is_broken", "title_length",
        "meta_description_length", "h1_count", "image_count", "images_missing_alt", "internal_links",
        "array_join(schema_types, '|') as schema_types",
    )


@query(
    f"SELECT p AS page_ord, url, final_url, NOT live AS is_broken, {_PAGE_FIGURES}, coalesce(status_code, -1) AS status_code,"
    " CASE WHEN live THEN title END AS title, CASE WHEN live THEN title_source END AS title_source,"
    " CASE WHEN live THEN description END AS meta_description, CASE WHEN live THEN description_source END AS meta_description_source,"
    " CASE WHEN live THEN canonical END AS canonical, CASE WHEN live THEN robots END AS robots_meta,"
    " CAST(CASE WHEN live THEN h2 ELSE 0 END AS INT) AS h2_count, CAST(CASE WHEN live THEN h3 ELSE 0 END AS INT) AS h3_count,"
    " CAST(CASE WHEN live THEN len(list_distinct(inside)) ELSE 0 END AS INT) AS internal_links_unique,"
    " CAST(CASE WHEN live THEN len(inside) ELSE 0 END AS INT) AS internal_link_occurrences,"
    " CAST(CASE WHEN live AND ext_n > 0 THEN 1 ELSE 0 END AS INT) AS external_links_unique,"
    " CAST(CASE WHEN live THEN ext_n ELSE 0 END AS INT) AS external_link_occurrences,"
    " live AND has_json_ld AS has_json_ld, live AND p % 2 = 0 AS has_viewport, false AS js_rendered FROM r", O.RICH
)
def page_summaries(spark, d):
    return M.page_summaries(rich_facts(spark, d)).selectExpr(
        "coalesce(status_code, -1) as status_code", "title", "title_source", "meta_description", "meta_description_source", "canonical", "robots_meta",
        "h2_count", "h3_count", "internal_links_unique", "internal_link_occurrences", "external_links_unique",
        "external_link_occurrences", "has_json_ld", "has_viewport", "js_rendered", "page_ord", "url", "final_url", "is_broken", "title_length", "meta_description_length",
        "h1_count", "image_count", "images_missing_alt",
    )


@query(
    f"SELECT audit_id, seed_url, score, pages, critical + warning + info AS issues, critical, warning, info,"
    " 'title|meta_description|headings|image_alt|links|canonical|robots|page_size|sitemap|schema' AS analyzers"
    f" FROM ({_SCORED})",
    O.ISSUES,
)
def audit_rows(spark, d):
    return rich_audit(spark, d).audits.selectExpr(
        "audit_id", "seed_url", "score", "pages", "issues", "severity.*",
        "array_join(analyzers_run, '|') as analyzers",
    )


# --- figures kept while pages arrive -----------------------------------------


def kept_figures(spark, d) -> dict[str, DataFrame]:
    """The second crawl in four batches: one comes twice, and some are folded before the last."""
    root = f"{staging_dir(spark).rstrip('/')}/figures-{uuid.uuid4().hex}"
    fetches = rich_fetches(spark, d)
    work = stage(CR.external_worklist(page_facts(fetches)), "worklist")
    batches = [fetches.filter(f"page_ord % 3 = {k}") for k in range(3)] + [CR.broken_probes(work, SN.probes(work))]
    for number in (0, 1, 1, 2):
        FG.write_batch(batches[number], number, root)
    FG.fold(spark, root)
    for number in (1, 3):
        FG.write_batch(batches[number], number, root)
    return FG.current(spark, root)


@query(_SCORED, O.ISSUES)
def running_scores(spark, d):
    return FG.scores(kept_figures(spark, d))


@query(_METRICS, O.RICH + "," + O.EXTERNAL)
def running_metrics(spark, d):
    rows = FG.check_metrics(kept_figures(spark, d))
    return rows.filter("metric not in ('avg_title_length', 'avg_meta_description_length', 'alt_coverage_pct')").drop("seed_url")


# --- reports ---------------------------------------------------------------

_ORD = "analyzer_ord, phase, page_ord"


@query(
    "SELECT audit_id, code, n, rank FROM (SELECT *, row_number() OVER (PARTITION BY audit_id ORDER BY n DESC, first)"
    " AS rank FROM (SELECT audit_id, code, count(*) AS n, min((analyzer_ord, phase, page_ord, code_ord)) AS first FROM"
    " (SELECT *, CASE code WHEN 'title_too_short' THEN 1 WHEN 'title_too_long' THEN 1"
    " WHEN 'meta_description_too_short' THEN 1 WHEN 'meta_description_too_long' THEN 1"
    " WHEN 'skipped_heading_level' THEN 1 WHEN 'no_internal_links' THEN 0 WHEN 'redirect_chain' THEN 1"
    " WHEN 'robots_nofollow' THEN 1 ELSE 0 END AS code_ord FROM issues)"
    " GROUP BY 1, 2)) WHERE rank <= 5",
    O.ISSUES,
)
def top_codes(spark, d):
    return R.top_codes(rich_audit(spark, d).issues).selectExpr("audit_id", "code", "n", "rank")


_CODE_ORD = (
    "CASE WHEN code IN ('title_too_short', 'title_too_long', 'meta_description_too_short', 'meta_description_too_long',"
    " 'skipped_heading_level', 'redirect_chain', 'robots_nofollow') THEN 1 ELSE 0 END"
)


@query(
    "SELECT audit_id, code, message, url, rn FROM (SELECT *, row_number() OVER (PARTITION BY audit_id ORDER BY"
    f" {_ORD}, {_CODE_ORD}, details) AS rn FROM issues) WHERE rn <= 40",
    O.ISSUES,
)
def first_40_issues(spark, d):
    return R.first_issues(rich_audit(spark, d).issues).select("audit_id", "code", "message", "url", "rn")


@query(
    "SELECT audit_id, CASE severity WHEN 'critical' THEN 'critical_issues' WHEN 'warning' THEN 'warnings'"
    " ELSE 'suggestions' END AS section, count(*) AS n, min(message) AS first_message FROM issues GROUP BY 1, 2",
    O.ISSUES,
)
def report_sections(spark, d):
    return (
        R.severity_sections(rich_audit(spark, d).issues)
        .groupBy("audit_id", "section")
        .agg(F.count("*").alias("n"), F.min("message").alias("first_message"))
    )


_BULLET = "'- [' || code || '] ' || message || ' (`' || url || '`)'"
_REPORT_ISSUES = (
    f"SELECT audit_id, {_BULLET} AS line, count(*) AS n FROM issues GROUP BY 1, 2 UNION ALL"
    f" SELECT audit_id, '- None', CAST(critical = 0 AS INT) + CAST(warning = 0 AS INT) + CAST(info = 0 AS INT)"
    f" FROM ({_COUNTS}) WHERE critical = 0 OR warning = 0 OR info = 0 UNION ALL"
    f" SELECT audit_id, unnest(['- Critical issues: ' || critical, '- Warnings: ' || warning, '- Suggestions: ' || info,"
    " '- Pages analyzed: ' || pages, '**Pages analyzed:** ' || pages, '# SEO Audit Report', '## Warnings',"
    " '**Overall SEO Score:** ' || score || '/100', '**URL:** ' || seed_url, '**Audit ID:** ' || audit_id,"
    " '**Created:** 2024-02-01T00:00:00+00:00', '## Overall SEO Score', '**' || score || ' / 100**']), 1"
    f" FROM ({_SCORED}) UNION ALL"
    " SELECT audit_id, '- `' || final_url || '` — ' || CASE WHEN live THEN coalesce(title, '(no title)') ELSE '(no title)' END"
    " || ' [' || CASE WHEN live THEN '200' ELSE 'broken' END || ']', count(*) FROM r GROUP BY 1, 2"
)


@query(_REPORT_ISSUES, O.ISSUES)
def report_lines(spark, d):
    """Lines of all reports with their number; the frame lines checked are those with figures."""
    return report_bag(A.report(rich_audit(spark, d)))


def report_bag(lines: DataFrame) -> DataFrame:
    shown = (
        "line rlike '^- (\\\\[|None|Critical issues|Warnings:|Suggestions:|Pages analyzed|`)'"
        " or line rlike '^[*][*](Pages|Overall|URL|Audit|Created|[0-9])'"
        " or line in ('# SEO Audit Report', '## Warnings', '## Overall SEO Score')"
    )
    return lines.filter(shown).groupBy("audit_id", "line").agg(F.count("*").alias("n"))


@query()
def report_full(spark, d):
    """The complete markdown of every report in reading order, with metrics section and comparison."""
    before, now = plain_audit(spark, d), rich_audit(spark, d)
    A.compare_audits(now, before.audits, before.issues)
    return A.report(now, metrics=True)


@query()
def report_documents(spark, d):
    return A.report(rich_audit(spark, d), "json")


@query(
    "SELECT x.audit_id, s AS section_ord, CAST(n + CASE WHEN s = 3 THEN coalesce(extra, 0) ELSE 0 END AS BIGINT) AS lines,"
    " CAST(CASE WHEN s = 8 THEN 1 WHEN s = 3 THEN n - 1 + coalesce(more, 0) WHEN s % 2 = 1 THEN n - 1 ELSE 0 END AS BIGINT)"
    " AS continued FROM (SELECT audit_id, unnest([0, 1, 2, 3, 4, 5, 6, 8, 9, 10]) AS s,"
    f" unnest([2, critical, 1, warning, 1, info, 2, 2, pages, 1]) AS n FROM ({_SCORED})) x"
    # each duplicate title: its URLs and a closing line
    f" LEFT JOIN (SELECT audit_id, sum(n + 1) AS extra, sum(n - 1) AS more FROM ({O.duplicate_groups()}) GROUP BY 1) g"
    " ON g.audit_id = x.audit_id WHERE n > 0",
    O.ISSUES,
)
def report_document_parts(spark, d):
    """How many lines each part of the JSON documents has, and how many continue an array."""
    lines = A.report(rich_audit(spark, d), "json")
    return lines.groupBy("audit_id", "section_ord").agg(
        F.count("*").alias("lines"), F.expr("count_if(startswith(line, ',')) as continued")
    )


@query(
    "SELECT audit_id, 'Markdown' AS kind, CAST(sum(n) AS BIGINT) AS lines FROM (SELECT audit_id,"
    # frame, head bullets, top codes, three severity blocks, page block, closing
    " 15 + 1 + 9 + greatest(critical, 1) + greatest(warning, 1) + greatest(info, 1) + 3 + 2 * pages + 4 AS n"
    f" FROM ({_SCORED})) GROUP BY 1",
    O.ISSUES,
)
def report_line_counts(spark, d):
    lines = A.report(rich_audit(spark, d))
    return lines.groupBy("audit_id").agg(F.count("*").alias("lines")).selectExpr(
        "audit_id", "'Markdown' as kind", "lines"
    )


@query(
    f"SELECT audit_id, seed_url, CAST(score AS VARCHAR) AS score, CAST(pages AS VARCHAR) AS pages FROM ({_SCORED})",
    O.ISSUES,
)
def report_metadata(spark, d):
    return R.report_metadata(rich_audit(spark, d).summary())


@query(
    f"SELECT audit_id, score, pages, critical + warning + info AS issues,"
    f" least(40, critical + warning + info) AS listed FROM ({_SCORED})",
    O.ISSUES,
)
def compact_views(spark, d):
    result = rich_audit(spark, d)
    views = R.compact_view(result.summary(), result.issues, result.totals(), result.metrics_json(), result.registry.names())
    return views.selectExpr("audit_id", "parse_json(view) as v").selectExpr(
        "audit_id",
        "variant_get(v, '$.score', 'double') as score",
        "variant_get(v, '$.pages', 'bigint') as pages",
        "variant_get(v, '$.issues', 'bigint') as issues",
        "cast(size(variant_get(v, '$.top_issues', 'array<variant>')) as bigint) as listed",
    )


@query(
    "SELECT doc_id, CASE WHEN length(text) > 12000 THEN left(text, 12000) || chr(10) || chr(10) || '…[truncated]'"
    " ELSE text END AS content FROM documents"
)
def bounded_text(spark, d):
    return SN.table(spark, d, "documents").selectExpr("doc_id", f"{R.bounded_text('text')} as content")


# The markdown reports of the first crawl: every line in its place. p is the page, w its words.
_OLD_SCORED = (
    "SELECT audit_id, count_if(severity = 'critical') AS critical, count_if(severity = 'warning') AS warning,"
    " count_if(severity = 'info') AS info, CAST(greatest(0, least(100, 100 - sum(CASE severity WHEN 'critical' THEN 8"
    " WHEN 'warning' THEN 3 ELSE 1 END))) AS DOUBLE) AS score FROM old GROUP BY 1"
)
_OLD_PLACE = (
    "CASE WHEN code LIKE '%title%' THEN 0 WHEN code LIKE '%description' THEN 1 WHEN code = 'missing_canonical' THEN 5"
    " WHEN code = 'sitemap_not_checked' THEN 8 ELSE 9 END AS a, CASE WHEN code IN ('duplicate_title', 'sitemap_not_checked') THEN 1 ELSE 0 END AS ph"
)
REPORT_TEXT = f"""{O.PAGES},{O.PLAIN_ISSUES},
placed AS (SELECT *, {_OLD_PLACE} FROM old),
tops AS (SELECT audit_id, string_agg(code, ', ' ORDER BY n DESC, first) AS codes FROM (SELECT *, row_number() OVER
    (PARTITION BY audit_id ORDER BY n DESC, first) AS k FROM (SELECT audit_id, code, count(*) AS n, min((a, ph, page_ord)) AS first
    FROM placed GROUP BY 1, 2)) WHERE k <= 5 GROUP BY 1),
site AS (SELECT * FROM ({_OLD_SCORED}) JOIN (SELECT 'a:' || seed AS audit_id, seed, count(*) AS pages FROM b GROUP BY ALL) USING (audit_id)
    LEFT JOIN tops USING (audit_id)),
words AS (SELECT p, len(regexp_extract_all({O.node_text(O.NO_SCRIPTS)}, '[\\p{{L}}\\p{{N}}_]+')) AS w FROM b),
lines AS (
    SELECT audit_id, 0 AS s, 0 AS a, 0 AS ph, 0 AS pg, unnest(generate_series(0, 15)) AS n, unnest(['# SEO Audit Report', '', '**URL:** ' || seed,
        '**Audit ID:** ' || audit_id, '**Overall SEO Score:** ' || score || '/100', '**Pages analyzed:** ' || pages,
        '**Created:** 2024-01-01T00:00:00+00:00', '', '## Summary', '', '- Overall SEO Score: **' || score || '/100**', '- Pages analyzed: ' || pages,
        '- Critical issues: ' || critical, '- Warnings: ' || warning, '- Suggestions: ' || info, '- Top issue codes: ' || codes]) AS line FROM site
    UNION ALL SELECT audit_id, unnest([2, 2, 2, 4, 4, 4, 6, 6, 6]), 0, 0, 0, unnest([0, 1, 2, 0, 1, 2, 0, 1, 2]),
        unnest(['', '## Critical Issues', '', '', '## Warnings', '', '', '## Suggestions', '']) FROM site
    UNION ALL SELECT audit_id, s, 0, 0, 0, 3, '- None' FROM (SELECT audit_id, unnest([2, 4, 6]) AS s, unnest([critical, warning, info]) AS n FROM site) WHERE n = 0
    UNION ALL SELECT audit_id, CASE severity WHEN 'critical' THEN 3 WHEN 'warning' THEN 5 ELSE 7 END, a, ph, page_ord, 0, {_BULLET} FROM placed
    UNION ALL SELECT audit_id, unnest([11, 11, 13, 15, 15, 15, 15]), 0, 0, 0, unnest([0, 1, 0, 0, 1, 2, 3]),
        unnest(['## Page Overview', '', '', '## Overall SEO Score', '', '**' || score || ' / 100**', '']) FROM site
    UNION ALL SELECT audit_id, 12, 0, 0, p, unnest([0, 1]), unnest(['- `' || url || '` — ' || coalesce(title, '(no title)') || ' [200]',
        '  - title_len=' || length(coalesce(title, '')) || ', meta_len=0, h1=' || CASE WHEN raw_h1 = '' THEN 0 ELSE 1 END || ', h2=0, h3=0, images=0, missing_alt=0, internal_links='
        || len(list_distinct(links)) || ', words=' || w || ', schema=none']) FROM q JOIN words USING (p)),
report AS (SELECT *, row_number() OVER (PARTITION BY audit_id ORDER BY s, a, ph, pg, n) AS place FROM lines)"""


def placed_lines(lines: DataFrame) -> DataFrame:
    """audit_id, place in the report, line."""
    order = W.partitionBy("audit_id").orderBy("section_ord", "item_ord")
    return lines.select("audit_id", F.row_number().over(order).alias("place"), "line")


@query("SELECT audit_id, CAST(place AS INT) AS place, line FROM report", REPORT_TEXT)
def report_text(spark, d):
    """The whole markdown of every report, line by line."""
    return placed_lines(A.report(plain_audit(spark, d)))


REPORT_LIMIT = 1500


@query(
    "SELECT audit_id, CAST(unnest(generate_series(1, len(x))) AS INT) AS place, unnest(x) AS line FROM (SELECT audit_id,"
    f" string_split(CASE WHEN length(t) > {REPORT_LIMIT} THEN left(t, {REPORT_LIMIT}) || chr(10) || chr(10) || '…[truncated]' ELSE t END, chr(10)) AS x"
    " FROM (SELECT audit_id, string_agg(line, chr(10) ORDER BY place) AS t FROM report GROUP BY 1))",
    REPORT_TEXT,
)
def report_bounded(spark, d):
    """Reports cut after so many characters, within a line, and marked."""
    return placed_lines(R.bounded_lines(A.report(plain_audit(spark, d)), REPORT_LIMIT))


@query(
    f"SELECT audit_id, seed_url, score, pages, critical + warning + info AS issues, critical, warning, info FROM ({_SCORED})", O.ISSUES
)
def audit_summary_rows(spark, d):
    """The short rows that list the second crawl's audits."""
    result = rich_audit(spark, d)
    return R.audit_rows(R.report_summary(result.audits, result.issues, result.facts)).select("*", "severity.*").drop("severity")


@query("SELECT audit_id, CAST(place AS INT) AS place, line FROM report", REPORT_TEXT)
def report_files(spark, d):
    """The reports written as a table in reading order, and read back."""
    path = f"{staging_dir(spark).rstrip('/')}/lines-{uuid.uuid4().hex}"
    sinks.write_lines(A.report(plain_audit(spark, d)), path)
    return placed_lines(spark.read.parquet(path))


@query(
    "SELECT audit_id, line, count(*) AS n FROM report WHERE audit_id IN"
    " (SELECT min(audit_id) FROM report UNION SELECT max(audit_id) FROM report) GROUP BY 1, 2",
    REPORT_TEXT,
)
def report_text_files(spark, d):
    """The lines of two reports that were written as text files; their order in the files is tested apart."""
    path = f"{staging_dir(spark).rstrip('/')}/text-{uuid.uuid4().hex}"
    result = plain_audit(spark, d)
    sinks.write_text(A.report(result), path, sorted(set(result.audits.agg(F.min("audit_id"), F.max("audit_id")).first())))
    lines = spark.read.text(path).withColumnsRenamed({"audit": "audit_id", "value": "line"})
    return lines.groupBy("audit_id", "line").agg(F.count("*").alias("n"))


# --- history ---------------------------------------------------------------

EVENTS = (
    "e AS (SELECT CAST(event_id AS VARCHAR) AS audit_id, 'https://user' || user_id || '.example/' AS seed_url,"
    " ts, value AS score, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, CAST(event_id AS VARCHAR) DESC) AS rn"
    " FROM events)"
)


@query("SELECT audit_id, seed_url, score, rn FROM e WHERE rn <= 20", EVENTS)
def history_topn(spark, d):
    return store.history(SN.event_audits(spark, d)).select("audit_id", "seed_url", "score", "rn")


@query("SELECT audit_id, seed_url, score FROM e WHERE rn = 1", EVENTS)
def latest_audit(spark, d):
    return store.latest(SN.event_audits(spark, d)).select("audit_id", "seed_url", "score")


@query(
    "SELECT e.audit_id, e.seed_url, CASE WHEN e.rn = 1 THEN s.audit_id ELSE f.audit_id END AS previous_audit_id"
    " FROM e LEFT JOIN e f ON f.seed_url = e.seed_url AND f.rn = 1"
    " LEFT JOIN e s ON s.seed_url = e.seed_url AND s.rn = 2",
    EVENTS,
)
def previous_audit(spark, d):
    audits = SN.event_audits(spark, d)
    return store.previous(audits, audits)


@query(
    "SELECT e.audit_id, e.seed_url, p.audit_id AS previous_audit_id FROM e"
    " LEFT JOIN e p ON p.seed_url = e.seed_url AND p.rn = e.rn + 1",
    EVENTS,
)
def previous_in_time(spark, d):
    return store.previous_in_time(SN.event_audits(spark, d))


@query(
    "SELECT CAST(o_orderkey AS VARCHAR) AS audit_id, 'https://customer' || o_custkey || '.example/' AS seed_url,"
    " strftime(o_orderdate, '%Y-%m-%dT%H:%M:%S') || '+00:00' AS created_at, o_totalprice AS score,"
    " coalesce(n, 0) AS issue_count, coalesce(m, 0) AS pages, count(*) OVER (PARTITION BY o_custkey) AS count"
    " FROM orders LEFT JOIN (SELECT l_orderkey, count(*) AS n FROM lineitem GROUP BY 1) ON l_orderkey = o_orderkey"
    " LEFT JOIN (SELECT l_orderkey AS k, count(DISTINCT l_suppkey) AS m FROM lineitem GROUP BY 1) ON k = o_orderkey"
)
def history_listing(spark, d):
    """Orders as audits, their line items as issues, their suppliers as pages."""
    items = SN.table(spark, d, "lineitem").selectExpr("cast(l_orderkey as string) as audit_id", "l_suppkey")
    audits = SN.table(spark, d, "orders").selectExpr(
        "cast(o_orderkey as string) as audit_id",
        "concat('https://customer', o_custkey, '.example/') as seed_url",
        "cast(o_orderdate as timestamp) as created_at",
        "o_totalprice as score",
    )
    return store.listing(audits, items, items.distinct())


@query(
    "SELECT audit_id, seed_url, score FROM (SELECT CAST(user_id AS VARCHAR) AS audit_id,"
    " 'https://' || event_type || '.example/' AS seed_url, value AS score,"
    " row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS rn FROM events) WHERE rn = 1"
)
def audit_upsert(spark, d):
    """Repeated saves under one id: the last one wins."""
    saves = SN.table(spark, d, "events").selectExpr(
        "cast(user_id as string) as audit_id",
        "concat('https://', event_type, '.example/') as seed_url",
        "value as score",
        "struct(cast(ts as timestamp), event_id) as saved_at",
    )
    return store.latest_version(saves).select("audit_id", "seed_url", "score")


@query("SELECT audit_id, seed_url FROM e WHERE audit_id NOT IN (SELECT CAST(doc_id AS VARCHAR) FROM labels WHERE toxic = 1)", EVENTS)
def audit_delete(spark, d):
    ids = SN.table(spark, d, "labels").filter("toxic = 1").selectExpr("cast(doc_id as string) as audit_id")
    return store.without(SN.event_audits(spark, d), ids).select("audit_id", "seed_url")


# --- comparison ------------------------------------------------------------

BOTH = O.ISSUES + "," + O.PLAIN_ISSUES
_KEY = "n.code = o.code AND n.url IS NOT DISTINCT FROM o.url AND n.message = o.message AND substr(n.audit_id, 3) = substr(o.audit_id, 3)"


def compared(spark, d) -> A.AuditResult:
    before, now = plain_audit(spark, d), rich_audit(spark, d)
    return A.compare_audits(now, before.audits, before.issues)


@query(f"SELECT audit_id, code, url, message FROM issues n WHERE NOT EXISTS (SELECT 1 FROM old o WHERE {_KEY})", BOTH)
def diff_new(spark, d):
    return compared(spark, d).new_issues.select("audit_id", "code", "url", "message")


@query(f"SELECT audit_id, code, url, message FROM old o WHERE NOT EXISTS (SELECT 1 FROM issues n WHERE {_KEY})", BOTH)
def diff_resolved(spark, d):
    return compared(spark, d).resolved_issues.select("audit_id", "code", "url", "message")


_SAME = (
    "SELECT substr(audit_id, 3) AS url, count(*) AS unchanged FROM (SELECT DISTINCT n.audit_id, n.code, n.url, n.message"
    f" FROM issues n JOIN old o ON {_KEY}) GROUP BY 1"
)


@query(_SAME, BOTH)
def diff_unchanged(spark, d):
    return compared(spark, d).diffs.filter("unchanged_issue_count > 0").selectExpr(
        "url", "unchanged_issue_count as unchanged"
    )


def _score_of(source: str) -> str:
    return (
        "SELECT substr(audit_id, 3) AS url, CAST(greatest(0, least(100, 100 - sum(CASE severity WHEN 'critical' THEN 8"
        f" WHEN 'warning' THEN 3 ELSE 1 END))) AS DOUBLE) AS score FROM {source} GROUP BY 1"
    )


_DIFF = (
    "SELECT s.url, 'a:' || s.url AS previous_audit_id, 'b:' || s.url AS current_audit_id, p.score AS previous_score,"
    " c.score AS current_score, c.score - p.score AS score_delta, coalesce(a.n, 0) AS new_issues,"
    " coalesce(z.n, 0) AS resolved_issues, coalesce(u.unchanged, 0) AS unchanged_issue_count FROM"
    " (SELECT DISTINCT seed AS url FROM b) s"
    f" JOIN ({_score_of('issues')}) c USING (url) JOIN ({_score_of('old')}) p USING (url) LEFT JOIN ({_SAME}) u USING (url)"
    f" LEFT JOIN (SELECT substr(audit_id, 3) AS url, count(*) AS n FROM issues n WHERE NOT EXISTS (SELECT 1 FROM old o WHERE {_KEY}) GROUP BY 1) a USING (url)"
    f" LEFT JOIN (SELECT substr(audit_id, 3) AS url, count(*) AS n FROM old o WHERE NOT EXISTS (SELECT 1 FROM issues n WHERE {_KEY}) GROUP BY 1) z USING (url)"
)


@query(
    "SELECT *, true AS has_baseline, CASE WHEN score_delta > 0 THEN 'Score improved by ' || score_delta || '. '"
    " WHEN score_delta < 0 THEN 'Score declined by ' || -score_delta || '. ' ELSE 'Score unchanged. ' END ||"
    " 'New issues: ' || new_issues || '. Resolved issues: ' || resolved_issues || '. Unchanged: '"
    f" || unchanged_issue_count || '.' AS summary FROM ({_DIFF})",
    BOTH,
)
def diff_summary(spark, d):
    return compared(spark, d).diffs


@query(
    "SELECT DISTINCT seed AS url, false AS has_baseline, CAST(0 AS DOUBLE) AS score_delta, CAST(0 AS BIGINT) AS new_issues,"
    " 'No previous audit found for this URL.' AS summary FROM b",
    O.PAGES,
)
def diff_no_baseline(spark, d):
    now = plain_audit(spark, d)
    A.compare_audits(now, now.audits.filter("false"), now.issues.filter("false"))
    return now.diffs.select("url", "has_baseline", "score_delta", "new_issues", "summary")


@query(
    f"SELECT 'New' AS part, substr(n.audit_id, 3) AS seed_url, {_BULLET} AS line, count(*) AS n FROM issues n"
    f" WHERE NOT EXISTS (SELECT 1 FROM old o WHERE {_KEY}) GROUP BY 1, 2, 3 UNION ALL"
    f" SELECT 'Resolved', substr(o.audit_id, 3), {_BULLET}, count(*) FROM old o"
    f" WHERE NOT EXISTS (SELECT 1 FROM issues n WHERE {_KEY}) GROUP BY 1, 2, 3",
    BOTH,
)
def change_report_lines(spark, d):
    lines = A.change_report(compared(spark, d))
    return (
        lines.filter("startswith(line, '- [')")
        .selectExpr("if(section_ord = 1, 'New', 'Resolved') as part", "seed_url", "line")
        .groupBy("part", "seed_url", "line")
        .agg(F.count("*").alias("n"))
    )


def saved_runs(spark, d) -> tuple[str, A.AuditResult, A.AuditResult]:
    """A store that holds both crawls."""
    root = f"{staging_dir(spark).rstrip('/')}/store-{uuid.uuid4().hex}"
    runs = plain_audit(spark, d), rich_audit(spark, d)
    for result, at in zip(runs, ("2024-01-01 01:00:00", "2024-02-01 01:00:00")):
        result.options = AuditOptions(save=True)
        A.persist(result, root, at)
    return root, *runs


def diff_of(result: A.AuditResult, audits: DataFrame, issues: DataFrame, **more) -> DataFrame:
    return A.compare_audits(result, audits, issues, **more).diffs


@query(ORACLES["diff_summary"])
def diff_after_save(spark, d):
    """Compared with the store only after the run itself was saved there."""
    root, _, now = saved_runs(spark, d)
    return diff_of(now, store.load(spark, f"{root}/audits"), spark.read.parquet(f"{root}/issues"))


@query(ORACLES["diff_summary"])
def diff_given_baseline(spark, d):
    """The first crawl is named as baseline, though an audit in between is newer."""
    before, now = plain_audit(spark, d), rich_audit(spark, d)
    between = before.audits.selectExpr(
        "* except (audit_id, created_at, score)", "concat('m', audit_id) as audit_id", "timestamp '2024-01-15 00:00:00' as created_at", "1D as score"
    )
    given = now.audits.selectExpr("audit_id", "concat('a:', seed_url) as previous_audit_id")
    return diff_of(now, before.audits.unionByName(between), before.issues, baselines=given)


@query(ORACLES["previous_in_time"], None)
def baseline_as_of(spark, d):
    """What each audit is compared with if audits of any age are: all of them, against a history that holds them."""
    audits = SN.event_audits(spark, d)
    return store.baselines(audits, audits, as_of=True)


@query(
    "SELECT 'audits' AS part, 'a:' || seed AS audit_id, 1 AS n FROM (SELECT DISTINCT seed FROM b)"
    " UNION ALL SELECT 'audits', 'b:' || seed, 1 FROM (SELECT DISTINCT seed FROM b) WHERE length(seed) % 3 <> 0"
    " UNION ALL SELECT 'issues', audit_id, count(*) FROM old GROUP BY ALL"
    " UNION ALL SELECT 'issues', audit_id, count(*) FROM issues WHERE length(audit_id) % 3 <> 2 GROUP BY ALL"
    " UNION ALL SELECT 'page_facts', 'a:' || seed, count(*) FROM b GROUP BY ALL"
    " UNION ALL SELECT 'page_facts', 'b:' || seed, count(*) FROM b WHERE length(seed) % 3 <> 0 GROUP BY ALL",
    BOTH,
)
def store_deleted(spark, d):
    """What a store holds after some audits were deleted and their space was freed."""
    root, _, now = saved_runs(spark, d)
    path = f"{root}/audits"
    store.delete_all(spark, path, now.audits.filter("length(seed_url) % 3 = 0"))
    A.compact_store(spark, root)
    audits = store.load(spark, path)
    parts = [("audits", audits)] + [(n, store.belonging(spark, f"{root}/{n}", audits)) for n in ("issues", "page_facts")]
    counts = [rows.groupBy("audit_id").agg(F.count("*").alias("n")).select(F.lit(n).alias("part"), "audit_id", "n") for n, rows in parts]
    return counts[0].unionByName(counts[1]).unionByName(counts[2])


@query(f"SELECT * FROM ({_REPORT_ISSUES}) WHERE audit_id = (SELECT min(audit_id) FROM r)", O.ISSUES)
def stored_report_lines(spark, d):
    """The report of one stored audit, looked up by its id."""
    root, _, now = saved_runs(spark, d)
    first = now.audits.agg(F.min("audit_id")).first()[0]
    return report_bag(A.report_stored(spark, root, first))


# --- crawl -----------------------------------------------------------------

CRAWL_PAGES, CRAWL_DEPTH = 20, 4


@query(
    f"SELECT 'c:https://site' || p % 5 || '.example/' AS audit_id, 'https://site' || p % 5 || '.example/' || p // 5 AS url,"
    f" CAST(floor(log2(p // 5 + 1)) AS INT) AS depth, p // 5 AS page_ord,"
    f" p <= (SELECT max(page_id) FROM pages) AS fetched"
    f" FROM (SELECT unnest(generate_series(0, 5 * {CRAWL_PAGES} - 1)) AS p)"
    f" WHERE p // 5 < 2 ** ({CRAWL_DEPTH} + 1) - 1 AND"
    f" (p < 5 OR 5 * ((p // 5 - 1) // 2) + p % 5 <= (SELECT max(page_id) FROM pages))"
)
def bfs_levels(spark, d):
    """A limited breadth-first crawl of each site; the pages form a heap, so the queue order is known."""
    fetches = SN.linked_fetches(spark, d)
    options = AuditOptions().overlay(max_pages=CRAWL_PAGES, max_depth=CRAWL_DEPTH)
    return CR.frontier(SN.link_seeds(fetches), fetches, options).select(
        "audit_id", "url", "depth", "page_ord", "fetched"
    )


@query(
    "WITH RECURSIVE top AS (SELECT max(page_id) AS m FROM pages),"
    " x(p, depth) AS (SELECT page_id, 0 FROM pages WHERE page_id < 5 UNION ALL"
    " SELECT 5 * (2 * (p // 5) + k) + p % 5, depth + 1 FROM x, top, (SELECT unnest([1, 2]) AS k)"
    " WHERE p <= m AND depth < 30)"
    " SELECT 'c:https://site' || p % 5 || '.example/' AS audit_id, max(depth) AS levels,"
    " count(*) AS pages, count(*) FILTER (WHERE p <= m) AS fetched FROM x, top GROUP BY 1"
)
def bfs_whole(spark, d):
    """The same crawl without an effective page limit: every page of every site is reached."""
    fetches = SN.linked_fetches(spark, d)
    options = AuditOptions().overlay(max_pages=10**9, max_depth=30)
    rows = CR.frontier(SN.link_seeds(fetches), fetches, options)
    return rows.groupBy("audit_id").agg(
        F.max("depth").alias("levels"), F.count("*").alias("pages"), F.expr("count_if(fetched) as fetched")
    )


@query(
    f"SELECT 'c:https://site' || p % 5 || '.example/' AS audit_id, 'https://site' || p % 5 || '.example/' || p // 5 AS url,"
    f" CAST(floor(log2(p // 5 + 1)) AS INT) AS depth, p // 5 AS page_ord FROM (SELECT unnest(generate_series(0, 5 * {CRAWL_PAGES} - 1)) AS p)"
    f" WHERE p // 5 < 2 ** ({CRAWL_DEPTH} + 1) - 1 AND (p < 5 OR 5 * ((p // 5 - 1) // 2) + p % 5 <= (SELECT max(page_id) FROM pages))"
    " UNION ALL SELECT 'd:https://site' || page_id || '.example/', 'https://site' || page_id || '.example/0', 0, 0 FROM pages WHERE page_id < 5"
)
def bfs_two_audits(spark, d):
    """Two audits of the same addresses; in the second the pages have no links."""
    first = SN.linked_fetches(spark, d)
    second = first.selectExpr(
        "replace(audit_id, 'c:', 'd:') as audit_id", "* except (audit_id, html)", "replace(html, '<a ', '<b ') as html"
    )
    seeds = SN.link_seeds(first)
    seeds = seeds.unionByName(seeds.selectExpr("replace(audit_id, 'c:', 'd:') as audit_id", "seed_url"))
    options = AuditOptions().overlay(max_pages=CRAWL_PAGES, max_depth=CRAWL_DEPTH)
    return CR.frontier(seeds, first.unionByName(second), options).select("audit_id", "url", "depth", "page_ord")


@query(
    "WITH RECURSIVE top AS (SELECT max(page_id) AS m FROM pages),"
    " x(p, depth) AS (SELECT page_id, 0 FROM pages WHERE page_id < 5 UNION ALL"
    " SELECT 5 * (2 * (p // 5) + k) + p % 5, depth + 1 FROM x, top, (SELECT unnest([1, 2]) AS k)"
    f" WHERE p <= m AND depth < {CRAWL_DEPTH} AND NOT starts_with(CAST(p // 5 AS VARCHAR), '3')),"
    " n AS (SELECT *, row_number() OVER (PARTITION BY p % 5 ORDER BY depth, p) - 1 AS page_ord,"
    " starts_with(CAST(p // 5 AS VARCHAR), '3') AS blocked FROM x)"
    " SELECT 'c:https://site' || p % 5 || '.example/' AS audit_id, 'https://site' || p % 5 || '.example/' || p // 5 AS url, depth, page_ord,"
    " CASE WHEN blocked THEN 403 ELSE 200 END AS status_code, CASE WHEN blocked THEN 'Blocked by robots.txt' END AS error,"
    f" NOT blocked AS has_html FROM n, top WHERE page_ord < {CRAWL_PAGES} AND (blocked OR p <= m)"
)
def crawl_records(spark, d):
    """Records of a crawl whose robots rules block every path that begins with 3."""
    fetches = SN.linked_fetches(spark, d)
    files = fetches.select("seed_url").distinct().selectExpr(
        f"{U.host('seed_url')} as host", "200 as status_code", "cast(null as string) as error", "'User-agent: *\nDisallow: /3' as body"
    )
    rules = RB.rules_for_agent(RB.robots_rules(files), "crawlsight/0.1")
    options = AuditOptions().overlay(max_pages=CRAWL_PAGES, max_depth=CRAWL_DEPTH)
    rows = CR.frontier(SN.link_seeds(fetches), fetches, options, rules)
    return CR.crawl_records(rows, fetches).selectExpr(
        "audit_id", "url", "depth", "page_ord", "status_code", "error", "html is not null as has_html"
    )


@query(ORACLES["bfs_levels"])
def bfs_arrivals(spark, d):
    """The limited crawl again, its pages landing in three batches, the last ones first; one batch comes twice."""
    fetches = SN.linked_fetches(spark, d)
    options = AuditOptions().overlay(max_pages=CRAWL_PAGES, max_depth=CRAWL_DEPTH)
    root = f"{staging_dir(spark).rstrip('/')}/frontier-{uuid.uuid4().hex}"
    for batch, third in ((0, 2), (1, 1), (1, 1), (2, 0)):
        FR.write_batch(fetches.filter(f"page_ord % 3 = {third}"), SN.link_seeds(fetches), batch, root, options)
    return FR.frontier_so_far(spark, root, options).select("audit_id", "url", "depth", "page_ord", "fetched")


@query(
    "SELECT 'c:https://site' || k || '.example/' AS audit_id, 'https://site' || k || '.example/' || n AS url,"
    " CASE n WHEN 0 THEN 0 ELSE 1 END AS depth, n AS page_ord FROM (SELECT unnest(generate_series(0, 4)) AS k),"
    " (SELECT unnest([0, 1, 2]) AS n) WHERE k <= (SELECT max(page_id) FROM pages) AND CASE WHEN k % 2 = 0 THEN n > 0 ELSE n = 0 END"
)
def crawl_worklist(spark, d):
    """What to fetch next when the roots of every second site are answered."""
    fetches = SN.linked_fetches(spark, d)
    options = AuditOptions().overlay(max_pages=CRAWL_PAGES, max_depth=CRAWL_DEPTH)
    root = f"{staging_dir(spark).rstrip('/')}/frontier-{uuid.uuid4().hex}"
    FR.write_batch(fetches.filter("page_ord in (0, 2, 4)"), SN.link_seeds(fetches), 0, root, options)
    return FR.worklist(spark, root).select("audit_id", "url", "depth", "page_ord")


@query("SELECT 'no usable address' AS reason, count(*) AS records FROM pages WHERE page_id % 10 = 0 HAVING count(*) > 0")
def rejected_records(spark, d):
    """Every tenth page under an address without a scheme."""
    pages = SN.table(spark, d, "pages").selectExpr(
        "page_id", "if(page_id % 10 = 0, regexp_replace(url, '^[a-z]+://', ''), url) as url", "html"
    )
    return rejects(pages_as_fetches(pages)).groupBy("reason").agg(F.count("*").alias("records"))


@query(
    "SELECT p AS page_id, CASE length(h) % 3 WHEN 2 THEN true"
    " WHEN 0 THEN NOT (starts_with(path, '/fr/') AND NOT starts_with(path, '/fr/1'))"
    " ELSE NOT (starts_with(path, '/es/') OR starts_with(path, '/de/1')) END AS allowed"
    " FROM (SELECT p, regexp_extract(o, '//(.*)$', 1) AS h, substr(url, length(o) + 1) AS path FROM b)",
    O.PAGES,
)
def robots_gate(spark, d):
    rules = RB.rules_for_agent(RB.robots_rules(SN.robots_files(spark, d)), "crawlsight/0.1")
    urls = SN.plain_fetches(spark, d).selectExpr("page_ord as page_id", "url")
    return RB.gate(urls, rules).select("page_id", "allowed")


@query(
    "WITH rules AS (SELECT 200 * l.pos + n AS pos, '/' || l.lang || '/' || n AS prefix, n % 2 = 0 AS blocks"
    " FROM (VALUES (0, 'en'), (1, 'de'), (2, 'fr'), (3, 'es')) l(pos, lang), generate_series(0, 199) g(n)),"
    f"{O.PAGES} SELECT p AS page_id, NOT coalesce(arg_min(blocks, pos), false) AS allowed"
    " FROM (SELECT p, substr(url, length(o) + 1) AS path FROM b) LEFT JOIN rules ON starts_with(path, prefix) GROUP BY p"
)
def robots_many_rules(spark, d):
    """Files of 800 rules each: one for every number up to 199 in four languages, even ones forbidden."""
    rule = "concat(if(n % 2 = 0, 'Disallow', 'Allow'), ': /', l, '/', n)"
    rules = f"flatten(transform(array('en', 'de', 'fr', 'es'), l -> transform(sequence(0, 199), n -> {rule})))"
    files = SN.robots_files(spark, d).selectExpr("host", "200 as status_code", "error", f"concat_ws('\\n', 'User-agent: *', {rules}) as body")
    host_rules = RB.rules_for_agent(RB.robots_rules(files), "crawlsight/0.1")
    return RB.gate(SN.plain_fetches(spark, d).selectExpr("page_ord as page_id", "url"), host_rules).select("page_id", "allowed")


@query(
    "SELECT host, group_ord, is_default, agents, prefixes FROM (SELECT DISTINCT regexp_extract(o, '//(.*)$', 1) AS host FROM b)"
    " JOIN (VALUES (0, 1, false, 'crawlsight', '+/fr/1|-/fr/'), (0, 3, true, '*', '-/'),"
    " (1, 1, true, '*,other', '-/es/|-/de/1')) v(kind, group_ord, is_default, agents, prefixes)"
    " ON length(host) % 3 = kind",
    O.PAGES,
)
def robots_rules(spark, d):
    return RB.robots_rules(SN.robots_files(spark, d)).selectExpr(
        "host",
        "cast(group_ord as int) as group_ord",
        "is_default",
        "array_join(array_sort(agents), ',') as agents",
        "array_join(transform(rules, r -> concat(if(r.allow, '+', '-'), r.prefix)), '|') as prefixes",
    )


@query("SELECT audit_id, url, rank FROM work WHERE rank <= 100", O.RICH + "," + O.EXTERNAL)
def external_worklist(spark, d):
    return CR.external_worklist(rich_fetches(spark, d)).select("audit_id", "url", "rank")


@query(
    "SELECT audit_id, url, error, CAST(0 AS INT) AS status_code, CAST(-1 AS INT) AS depth FROM bad",
    O.RICH + "," + O.EXTERNAL,
)
def broken_probes(spark, d):
    work = stage(CR.external_worklist(rich_fetches(spark, d)), "worklist")
    return CR.broken_probes(work, SN.probes(work)).select(
        "audit_id", "url", "error", "status_code", "depth"
    )


@query(
    "SELECT r.audit_id, count(*) AS pages_crawled, count(*) FILTER (WHERE p % 19 = 0 OR p % 11 = 0) AS broken_count,"
    " count(*) FILTER (WHERE redirected) AS redirect_count, count(*) FILTER (WHERE p % 19 = 0) AS error_count,"
    " any_value(n) AS pages_discovered FROM r JOIN (SELECT audit_id, count(DISTINCT u) AS n FROM"
    " (SELECT audit_id, unnest(list_concat(inside, CASE WHEN ext IS NULL THEN [] ELSE [ext] END)) AS u FROM r"
    " WHERE p % 17 <> 0 AND p % 19 <> 0 UNION ALL SELECT audit_id, seed FROM r) GROUP BY 1) USING (audit_id) GROUP BY 1",
    O.RICH,
)
def crawl_stats(spark, d):
    return CR.crawl_stats(rich_fetches(spark, d)).drop("seed_url")


@query(
    "SELECT audit_id, p AS page_ord, url || ': timeout' AS line FROM r WHERE p % 19 = 0", O.RICH
)
def crawl_errors(spark, d):
    return CR.crawl_errors(SN.rich_pages(spark, d)).select("audit_id", "page_ord", "line")


# --- suggestions -----------------------------------------------------------


@query(
    "SELECT audit_id, p AS page_ord, final_url FROM (SELECT *, row_number() OVER (PARTITION BY audit_id ORDER BY p) AS rn"
    " FROM r WHERE live) WHERE rn <= 5",
    O.RICH,
)
def suggest_candidates(spark, d):
    return S.candidates(rich_facts(spark, d)).select("audit_id", "page_ord", "final_url")


@query(
    "SELECT audit_id, string_agg(final_url, '|' ORDER BY final_url) AS related FROM (SELECT *, row_number() OVER"
    " (PARTITION BY audit_id ORDER BY final_url) AS rn FROM (SELECT DISTINCT audit_id, final_url FROM r WHERE live))"
    " WHERE rn <= 40 GROUP BY 1",
    O.RICH,
)
def suggest_related(spark, d):
    return S.related_urls(rich_facts(spark, d)).selectExpr("audit_id", "array_join(related, '|') as related")


@query()
def suggest_requests(spark, d):
    facts = stage(rich_facts(spark, d), "page_facts")
    return S.requests(S.candidates(facts), S.related_urls(facts), S.parse_keywords("site audit, pages"))


@query(
    "SELECT audit_id, p AS page_ord, final_url AS url, title, description, robots, CAST(images AS INT) AS images,"
    " array_to_string(list_filter(inside, lambda x, i: list_position(inside, x) = i)[1:30], '|') AS internal_links,"
    " related AS candidates, 'site audit|pages' AS keywords FROM"
    " (SELECT *, row_number() OVER (PARTITION BY audit_id ORDER BY p) AS rn FROM r WHERE live)"
    " JOIN (SELECT audit_id, string_agg(final_url, '|' ORDER BY final_url) AS related FROM (SELECT *, row_number() OVER"
    " (PARTITION BY audit_id ORDER BY final_url) AS n FROM (SELECT DISTINCT audit_id, final_url FROM r WHERE live))"
    " WHERE n <= 40 GROUP BY 1) USING (audit_id) WHERE rn <= 5",
    O.RICH,
)
def suggest_request_facts(spark, d):
    """The facts inside the request payloads."""

    def value(path, kind="string"):
        return f"variant_get(v, '$.{path}', '{kind}')"

    return suggest_requests(spark, d).selectExpr(
        "audit_id", "page_ord", "url", "parse_json(payload) as v"
    ).selectExpr(
        "audit_id", "page_ord", "url",
        f"{value('current.title')} as title",
        f"{value('current.meta_description')} as description",
        f"{value('current.robots_meta')} as robots",
        f"size({value('current.images', 'array<variant>')}) as images",
        f"array_join({value('current.internal_links', 'array<string>')}, '|') as internal_links",
        f"array_join({value('candidate_internal_urls', 'array<string>')}, '|') as candidates",
        f"array_join({value('target_keywords', 'array<string>')}, '|') as keywords",
    )


_ANSWERED = (
    "SELECT 's:' || conv_id AS audit_id, 'https://chat.example/' || conv_id || '/' || turn AS url,"
    " CAST((conv_id + turn) % 4 AS INT) AS k, role, text FROM conversations"
)


@query(
    "SELECT audit_id, url, CASE WHEN k IN (0, 1) THEN text END AS improved_title, CASE WHEN k = 3 THEN role END AS improved_h1,"
    " CASE WHEN k IN (0, 1) THEN role || '|k' ELSE '' END AS keywords, CASE WHEN k = 3 THEN 'Q?=A' ELSE '' END AS faqs,"
    " CASE WHEN k = 3 THEN '{\"raw\":\"WebPage\"}' END AS schema_suggestion,"
    " CASE WHEN role = 'system' OR k = 2 THEN 'error' ELSE 'ok' END AS status,"
    " CASE WHEN role = 'system' THEN 'model refused' WHEN k = 2 THEN 'Answer is not valid JSON of the requested form'"
    f" ELSE 'Optimization suggestions generated' END AS message FROM ({_ANSWERED})"
)
def suggest_parse(spark, d):
    return S.parse_answers(SN.answers(spark, d)).selectExpr(
        "audit_id", "url", "improved_title", "improved_h1",
        "array_join(keyword_suggestions, '|') as keywords",
        "array_join(transform(faq_suggestions, x -> concat(x.question, '=', x.answer)), '|') as faqs",
        "schema_suggestion", "status", "message",
    )


def _quoted(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


@query(
    "SELECT audit_id, p AS page_ord, CAST(unnest([0, 1]) AS INT) AS place, unnest(['system', 'user']) AS role,"
    f" unnest([{_quoted(S.SYSTEM_TEXT)}, {_quoted(S.USER_HEAD + '{}' + S.USER_TAIL)}]) AS content"
    " FROM (SELECT *, row_number() OVER (PARTITION BY audit_id ORDER BY p) AS rn FROM r WHERE live) WHERE rn <= 5",
    O.RICH,
)
def suggest_messages(spark, d):
    """The messages around the payloads; ``suggest_request_facts`` compares these."""
    rows = suggest_requests(spark, d).selectExpr("audit_id", "page_ord", "payload", "posexplode(messages) as (place, m)")
    return rows.selectExpr("audit_id", "page_ord", "place", "m.role", "if(place = 1, replace(m.content, payload, '{}'), m.content) as content")


@query(
    "SELECT audit_id, final_url AS url, CASE WHEN NOT live OR length(final_url) % 3 = 1 THEN 'error' ELSE 'ok' END AS status,"
    " CASE WHEN p % 19 = 0 THEN 'timeout' WHEN NOT live THEN 'HTTP ' || CASE WHEN p % 11 = 0 THEN 404 ELSE 200 END WHEN length(final_url) % 3 = 1"
    " THEN 'Answer is not valid JSON of the requested form' ELSE 'Optimization suggestions generated' END AS message"
    " FROM r WHERE NOT live OR length(final_url) % 3 <> 2",
    O.RICH,
)
def suggest_page_status(spark, d):
    """Outcome of the pages: broken ones, and answers that are right, malformed or missing by the length of the address."""
    facts = stage(rich_facts(spark, d), "page_facts")
    raw = """if(length(final_url) % 3 = 0, '{"improved_h1":"x"}', '[oops') as raw"""
    answers = facts.select("audit_id", "final_url").distinct().filter("length(final_url) % 3 <> 2").selectExpr(
        "audit_id", "final_url as url", "0 as page_ord", raw, "cast(null as string) as error"
    )
    return S.page_status(facts, S.parse_answers(answers))


@query(
    "SELECT audit_id, CASE WHEN bad = 0 THEN 'ok' WHEN good > 0 THEN 'partial' ELSE 'error' END AS status,"
    " 'Optimization suggestions generated' || CASE WHEN bad > 0 THEN '; ' || bad || ' page(s) failed' ELSE '' END AS message"
    f" FROM (SELECT audit_id, count(*) FILTER (WHERE role <> 'system' AND k <> 2) AS good,"
    f" count(*) FILTER (WHERE role = 'system' OR k = 2) AS bad FROM ({_ANSWERED}) GROUP BY 1)"
)
def suggest_status(spark, d):
    answers = SN.answers(spark, d)
    audits = answers.selectExpr("audit_id", "audit_id as seed_url").distinct()
    return S.site_status(audits, S.parse_answers(answers)).select("audit_id", "status", "message")


@query(
    "SELECT doc_id, array_to_string(list_filter(list_transform(string_split(text, ','), lambda k:"
    f" {O.strip('k')}), lambda k: k <> ''), '|') AS keywords FROM documents"
)
def keyword_lists(spark, d):
    return SN.table(spark, d, "documents").selectExpr(
        "doc_id", f"array_join({S.keywords('text')}, '|') as keywords"
    )


@query(
    "SELECT CAST(event_id AS VARCHAR) AS audit_id, 'https://user' || user_id || '.example/' AS seed_url,"
    " CASE WHEN event_id % 7 = 0 THEN value + 1 ELSE value END AS score FROM events WHERE event_id <> 5"
)
def stored_audits(spark, d):
    """A store that is written, written again for every seventh audit, and rid of one audit."""
    path = f"{staging_dir(spark).rstrip('/')}/store-{uuid.uuid4().hex}"
    audits = SN.event_audits(spark, d).withColumn("saved_at", F.expr("timestamp '2024-01-01 00:00:00'"))
    store.save(audits, path)
    again = audits.filter("cast(audit_id as bigint) % 7 = 0")
    store.save(again.withColumn("score", F.col("score") + 1).withColumn("saved_at", F.expr("timestamp '2024-01-02 00:00:00'")), path)
    store.delete(spark, path, "5")
    return store.load(spark, path).select("audit_id", "seed_url", "score")


@query(
    "SELECT CAST(event_id AS VARCHAR) AS audit_id, 'https://user' || user_id || '.example/' AS seed_url, value AS score FROM events"
    " WHERE event_id = (SELECT max(event_id) FROM events)"
)
def stored_audit_by_id(spark, d):
    """One audit of a store, by the table of ids: its bucket alone is read."""
    path = f"{staging_dir(spark).rstrip('/')}/store-{uuid.uuid4().hex}"
    audits = SN.event_audits(spark, d).withColumn("saved_at", F.expr("timestamp '2024-01-01 00:00:00'"))
    store.save_audits(audits, path)
    wanted = SN.table(spark, d, "events").agg(F.max("event_id")).first()[0]
    return store.find(spark, path, str(wanted)).select("audit_id", "seed_url", "score")
