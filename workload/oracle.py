"""SQL twins of the registered queries, computed from the tables without the engine."""

from __future__ import annotations

WS = r"[\s\x0B\x1c-\x1f\x{85}\p{Z}]+"


def strip(x: str) -> str:
    return f"regexp_replace({x}, '^{WS}|{WS}$', '', 'g')"


def decode(x: str) -> str:
    """The references that occur in the pages; the ampersand last."""
    out = f"regexp_replace({x}, '&amp($|[^;a-zA-Z0-9])', '&amp;\\1', 'g')"
    for name, char in (("copy", "©"), ("middot", "·"), ("quot", '"'), ("amp", "&")):
        out = f"replace({out}, '&{name};', '{char}')"
    return out


def node_text(x: str) -> str:
    marked = decode(f"regexp_replace({x}, '<[^>]*(>|$)', chr(1), 'g')")
    runs = f"regexp_replace({marked}, '[\\s\\p{{Z}}]*\\x01[\\s\\p{{Z}}\\x01]*', chr(1), 'g')"
    return f"replace({strip(f'trim({runs}, chr(1))')}, chr(1), ' ')"


NO_SCRIPTS = (
    "regexp_replace(html, '(?s)<!--.*?-->|<script.*?</script>|<style.*?</style>', chr(1), 'g')"
)

# Pages with normalised address, origin and what a plain page holds.
PAGES = f"""
u AS (SELECT page_id AS p, html,
    lower(regexp_extract(url, '^[A-Za-z]+://[^/?#]*')) AS o,
    regexp_replace(regexp_extract(url, '^[A-Za-z]+://[^/?#]*([^?#]*)', 1), ';[^/]*$', '') AS path,
    regexp_extract(url, '\\?([^#]*)', 1) AS q FROM pages),
b AS (SELECT p, html, o, o || '/' AS seed,
    o || CASE WHEN path IN ('', '/') THEN '/' ELSE rtrim(path, '/') END
      || CASE WHEN q <> '' THEN '?' || q ELSE '' END AS url FROM u),
f AS (SELECT *,
    {strip(decode("regexp_extract(html, '<title>([^<]*)</title>', 1)"))} AS raw_title,
    {strip(decode("regexp_extract(html, '<h1>([^<]*)</h1>', 1)"))} AS raw_h1,
    list_transform(regexp_extract_all(html, '<a href="([^"]*)"', 1), lambda h:
      o || regexp_replace(CASE WHEN regexp_replace({decode("h")}, ';[^/]*$', '') IN ('', '/') THEN '/'
        ELSE rtrim(regexp_replace({decode("h")}, ';[^/]*$', ''), '/') END, '#.*$', '')) AS links
    FROM b)"""

# Expected facts of the second crawl.
RICH = f"""{PAGES},
r AS (SELECT f.*, 'b:' || seed AS audit_id,
    NOT (p % 19 = 0 OR p % 11 = 0 OR p % 17 = 0) AS live,
    CASE WHEN p % 19 = 0 THEN 'timeout' WHEN p % 11 = 0 THEN 'HTTP 404' ELSE 'HTTP 200' END AS err,
    CASE WHEN p % 19 = 0 THEN NULL WHEN p % 11 = 0 THEN 404 ELSE 200 END AS status_code,
    CASE WHEN p % 23 = 7 THEN o || '/sitemap.xml' ELSE url END AS final_url,
    CASE WHEN p % 18 = 4 THEN 'Open graph title of page ' || p
         WHEN p % 36 = 13 THEN 'Twitter title of page ' || p WHEN p % 9 = 4 THEN NULL
         WHEN p % 6 = 1 THEN 'Overview of ' || d.lang || ' pages' ELSE raw_title END AS title,
    CASE WHEN p % 18 = 4 THEN 'og:title' WHEN p % 36 = 13 THEN 'twitter:title'
         WHEN p % 9 = 4 THEN NULL ELSE 'title' END AS title_source,
    CASE WHEN p % 18 = 4 THEN 'Open graph title of page ' || p END AS og_title,
    CASE WHEN p % 36 = 13 THEN 'Twitter title of page ' || p END AS twitter_title,
    CASE WHEN p % 12 = 0 THEN 'Open graph description number ' || p
         WHEN p % 12 = 8 THEN 'Short ’n'' sweet, number ' || p WHEN p % 4 = 0 THEN NULL
         WHEN p % 3 = 0 THEN {strip("d.text")} ELSE repeat('d', CAST(60 + p % 120 AS INT)) END AS description,
    CASE WHEN p % 12 = 0 THEN 'og:description' WHEN p % 12 = 8 THEN 'twitter:description'
         WHEN p % 4 = 0 THEN NULL ELSE 'description' END AS description_source,
    CASE WHEN p % 12 = 0 THEN 'Open graph description number ' || p END AS og_description,
    CASE WHEN p % 13 = 5 THEN 0 ELSE 1 END + CASE WHEN p % 7 = 0 THEN 1 ELSE 0 END AS h1,
    CASE WHEN p % 6 IN (1, 2) THEN 1 ELSE 0 END AS h2,
    CASE p % 6 WHEN 2 THEN 1 WHEN 3 THEN 1 WHEN 5 THEN 2 ELSE 0 END AS h3,
    p % 4 AS images, (p % 4) // 2 AS no_alt,
    CASE WHEN p % 3 = 0 THEN o || '/c/' || p END AS canonical,
    CASE p % 5 WHEN 0 THEN 'NoIndex, nofollow' WHEN 1 THEN 'index' WHEN 2 THEN 'noarchive' END AS robots,
    CASE WHEN p % 14 = 3 THEN 1 ELSE 0 END AS h4,
    p % 8 IN (0, 1, 2) AS has_json_ld,
    CASE p % 8 WHEN 0 THEN ['Article', 'Person'] WHEN 2 THEN ['Product', 'Thing'] ELSE [] END AS types,
    CASE WHEN p % 10 = 9 THEN [] ELSE links END AS inside,
    CASE WHEN p % 9 > 0 THEN 'https://ext' || p % 5 || '.example.org/x' END AS ext,
    p % 9 AS ext_n, p % 13 = 0 AS redirected
    FROM f LEFT JOIN documents d ON d.doc_id = f.p)"""


# The texts of issues below are what comparisons expect.


def issue(code, severity, message, where, details="'{}'", url="final_url", source="r", order="p"):
    return (
        f"SELECT audit_id, '{code}' AS code, '{severity}' AS severity, {message} AS message,"
        f" {url} AS url, {details} AS details, {order} AS page_ord FROM {source} WHERE {where}"
    )


def obj(**fields) -> str:
    return "json_object(" + ", ".join(f"'{k}', {v}" for k, v in fields.items()) + ")::VARCHAR"


def title_issues(src="r") -> list[str]:
    n = "length(title)"
    sized = obj(title="title", length=n)
    bounds = "|| ' chars; aim for 30-60)'"
    live = "live AND coalesce(title, '')"
    return [
        issue("missing_title", "critical",
              "'Page is missing a title tag (no <title>, og:title, or twitter:title)'", f"{live} = ''",
              obj(og_title="og_title", twitter_title="twitter_title", title_source="title_source"), source=src),
        issue("title_from_fallback", "info",
              "'Title taken from ' || title_source || ' because <title> was empty'",
              "live AND title_source <> 'title'", obj(title="title", title_source="title_source"), source=src),
        issue("title_too_short", "warning", f"'Title is short (' || {n} {bounds}",
              f"{live} <> '' AND {n} < 30", sized, source=src),
        issue("title_too_long", "warning", f"'Title is long (' || {n} {bounds}", f"live AND {n} > 60", sized, source=src),
    ]


def duplicate_groups(src="r") -> str:
    return (
        "SELECT audit_id, lower(title) AS k, count(*) AS n, list(final_url ORDER BY p) AS urls, min(p) AS p"
        f" FROM {src} WHERE live AND coalesce(title, '') <> '' GROUP BY 1, 2 HAVING count(*) > 1"
    )


def duplicate_issue(src="r") -> str:
    return issue(
        "duplicate_title", "warning", "'Duplicate title found on ' || n || ' pages'", "true",
        "to_json({'title': k, 'pages': n})::VARCHAR", "urls[1]", f"({duplicate_groups(src)})",
    )


def description_issues() -> list[str]:
    n = "length(description)"
    sized = obj(meta_description="description", length=n)
    bounds = "|| ' chars; aim for 70-160)'"
    return [
        issue("missing_meta_description", "warning",
              "'Page is missing a meta description (no name=description, og:description, or twitter:description)'",
              "live AND coalesce(description, '') = ''",
              obj(og_description="og_description", twitter_description="NULL")),
        issue("meta_description_from_fallback", "info",
              "'Meta description taken from ' || description_source || ' because name=description was empty'",
              "live AND description_source <> 'description'",
              obj(meta_description="description", source="description_source")),
        issue("meta_description_too_short", "info", f"'Meta description is short (' || {n} {bounds}",
              f"live AND coalesce(description, '') <> '' AND {n} < 70", sized),
        issue("meta_description_too_long", "info", f"'Meta description is long (' || {n} {bounds}",
              f"live AND {n} > 160", sized),
    ]


# Word counts of the second crawl are checked on the plain pages; here they are left out of details.
def heading_issues() -> list[str]:
    return [
        issue("missing_h1", "critical", "'Page is missing an H1 heading'", "live AND h1 = 0"),
        issue("multiple_h1", "info", "'Page has ' || h1 || ' H1 headings'", "live AND h1 > 1"),
        issue("skipped_heading_level", "info",
              "'Page has H3 headings without any H2 (possible heading hierarchy skip)'",
              "live AND h1 > 0 AND h2 = 0 AND h3 > 0"),
    ]


# The same with all details but the word count, which is 0 here.
_NOT_RENDERED = "'word_count': 0, 'js_rendered': false, 'likely_js_shell': false"


def heading_details() -> list[str]:
    h1 = (
        "list_concat(CASE WHEN p % 13 = 5 OR coalesce(raw_h1, '') = '' THEN [] ELSE [raw_h1] END,"
        " CASE WHEN p % 7 = 0 THEN ['Extra head'] ELSE [] END)"
    )
    h3 = "CASE p % 6 WHEN 2 THEN ['Third'] WHEN 3 THEN ['Third & last'] WHEN 5 THEN ['Third', 'Other'] ELSE [] END"
    return [
        issue("missing_h1", "", "''", "live AND h1 = 0",
              f"to_json({{'h2_count': h2, 'h3_count': h3, {_NOT_RENDERED}}})::VARCHAR"),
        issue("multiple_h1", "", "''", "live AND h1 > 1", f"to_json({{'h1': {h1}}})::VARCHAR"),
        issue("skipped_heading_level", "", "''", "live AND h1 > 0 AND h2 = 0 AND h3 > 0",
              f"to_json({{'h1': {h1}, 'h3': {h3}}})::VARCHAR"),
    ]


def unlinked_details() -> str:
    order = "'word_count': 0, 'likely_js_shell': false, 'js_rendered': false"
    return issue("no_internal_links", "", "''", "live AND len(inside) = 0", f"to_json({{{order}}})::VARCHAR")


def image_issues() -> list[str]:
    source = "(SELECT r.*, unnest(generate_series(1, no_alt)) AS k FROM r WHERE no_alt > 0)"
    return [
        issue("missing_image_alt", "warning", "'Image is missing an alt attribute'", "live",
              obj(src="o || '/i/' || p || '-' || k || '.png'"), source=source)
    ]


# Off-host links of each audit in first-seen order; a page with a body counts, whatever its status.
EXTERNAL = """
ext AS (SELECT audit_id, seed, ext AS url, min(p) AS first_p FROM r
    WHERE ext IS NOT NULL AND p % 17 <> 0 AND p % 19 <> 0 GROUP BY 1, 2, 3),
work AS (SELECT *, row_number() OVER (PARTITION BY audit_id ORDER BY first_p) AS rank FROM ext),
bad AS (SELECT *, CASE WHEN contains(url, '//ext0.') THEN 'HTTP 404' ELSE 'dns failure' END AS error
    FROM work WHERE contains(url, '//ext0.') OR contains(url, '//ext1.'))"""


def link_issues() -> list[str]:
    return [
        issue("broken_page", "critical", "err", "NOT live",
              obj(status_code="status_code", requested_url="url")),
        issue("no_internal_links", "info", "'Page has no crawlable internal links'",
              "live AND len(inside) = 0", "'-'"),
        issue("redirect_chain", "warning", "'Redirect chain with 2 hops'", "redirected",
              "to_json({'chain': ['http://old.example/' || p, final_url_raw]})::VARCHAR", "url",
              "(SELECT *, final_url AS final_url_raw FROM r)"),
        issue("broken_external_link", "warning", "error", "true", "'{\"status_code\":0}'", "url", "bad", "rank"),
    ]


def canonical_issues(src="r") -> list[str]:
    return [issue("missing_canonical", "info", "'Page is missing a canonical link tag'",
                  "live AND canonical IS NULL", source=src)]


def robots_issues() -> list[str]:
    shown = obj(robots_meta="robots")
    return [
        issue("robots_noindex", "warning", "'Page has robots meta noindex'", "live AND p % 5 = 0", shown),
        issue("robots_nofollow", "info", "'Page has robots meta nofollow'", "live AND p % 5 = 0", shown),
    ]


def schema_issues() -> list[str]:
    warnings = (
        "to_json({'extraction_warnings': list_filter([CASE title_source WHEN 'og:title' THEN 'title_fallback_og'"
        " WHEN 'twitter:title' THEN 'title_fallback_twitter' END,"
        " CASE description_source WHEN 'og:description' THEN 'meta_description_fallback_og' WHEN 'twitter:description' THEN 'meta_description_fallback_twitter' END,"
        " CASE WHEN p % 8 = 3 THEN 'json_ld_present_but_unparsed' END], lambda w: w IS NOT NULL)})::VARCHAR"
    )
    return [
        issue("missing_schema", "info", "'Page has no JSON-LD structured data'",
              "live AND NOT has_json_ld", warnings),
        issue("schema_untyped", "info", "'JSON-LD found but no @type values were detected'",
              "live AND has_json_ld AND len(types) = 0"),
    ]


def sitemap_issue(src="r") -> str:
    url = "seed || 'sitemap.xml'"
    return issue(
        "sitemap_not_checked", "info",
        f"'Sitemap was not crawled in Phase 1; verify ' || {url} || ' manually or enable dedicated sitemap fetch later'",
        "NOT seen", url=url, order="0",
        source=f"(SELECT audit_id, seed, bool_or(contains(final_url, 'sitemap.xml')) AS seen FROM {src} GROUP BY 1, 2)",
    )


CHECKS = {
    "title": [*title_issues(), duplicate_issue()],
    "meta_description": description_issues(),
    "headings": heading_issues(),
    "image_alt": image_issues(),
    "links": link_issues(),
    "canonical": canonical_issues(),
    "robots": robots_issues(),
    "page_size": [],
    "sitemap": [sitemap_issue()],
    "schema": schema_issues(),
}


def union(parts) -> str:
    return " UNION ALL ".join(f"({p})" for p in parts)


def with_ord(sql: str, name: str, n: int) -> str:
    phase = "CASE WHEN code IN ('duplicate_title', 'broken_external_link', 'sitemap_not_checked') THEN 1 ELSE 0 END"
    return f"SELECT '{name}' AS analyzer, {n} AS analyzer_ord, {phase} AS phase, t.* FROM ({sql}) t"


def all_issues() -> str:
    return union(
        with_ord(union(parts), name, n) for n, (name, parts) in enumerate(CHECKS.items()) if parts
    )


# All issues of the second crawl.
ISSUES = f"{RICH},{EXTERNAL},\nissues AS ({all_issues()})"

# All issues of the first crawl: plain pages, every page live and without any added markup.
PLAIN_ISSUES = f"""
q AS (SELECT *, 'a:' || seed AS audit_id, true AS live, url AS final_url, nullif(raw_title, '') AS title,
    'title' AS title_source, NULL AS og_title, NULL AS twitter_title, NULL AS canonical FROM f),
old AS ({union([
    *title_issues('q'), duplicate_issue('q'), *canonical_issues('q'), sitemap_issue('q'),
    issue('missing_meta_description', 'warning',
          "'Page is missing a meta description (no name=description, og:description, or twitter:description)'",
          'true', source='q'),
    issue('missing_schema', 'info', "'Page has no JSON-LD structured data'", 'true', source='q'),
])})"""


def select(ctes: str, body: str) -> str:
    return f"WITH {ctes.strip()}\n{body}"
