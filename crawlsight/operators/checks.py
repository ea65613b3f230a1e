"""Checks. A check is a name, rules over one page, rules over a site and metrics.

Rules are data (SQL text over ``page_facts``), so the rules of all checks are
evaluated in a single pass: once as issue rows, once as plain counts for the score.

Codes, severities and message texts below are fixed values: comparisons between
audits and reports depend on their exact wording.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from crawlsight import config as C
from crawlsight.config import AuditOptions
from crawlsight.functions import text as X
from crawlsight.functions import url as U
from crawlsight.functions.sql import lit
from crawlsight.operators.facts import missing_alts
from crawlsight.sources.fetches import broken_probe_fetches

ISSUE = "struct<code:string,severity:string,message:string,url:string,details:string>"
LIVE = "not is_broken"
AUDIT = ("audit_id", "seed_url")


@dataclass(frozen=True)
class PageRule:
    """An issue for each page where ``when`` holds, or for each element of ``items``.

    All fields but code and severity are SQL text; in ``details`` an element is ``item``.
    """

    code: str
    severity: str
    when: str
    message: str
    details: dict[str, str] = field(default_factory=dict)
    url: str = "final_url"
    items: str | None = None

    def count(self) -> str:
        return f"if({self.when}, {X.size0(self.items) if self.items else 1}, 0)"

    def issues(self) -> str:
        """Array of issue structs of one page, empty if the rule does not apply."""
        details = ", ".join(f"'{k}', {v}" for k, v in self.details.items())
        text = f"to_json(named_struct({details}), map('ignoreNullFields', 'false'))" if details else "'{}'"
        issue = (
            f"named_struct('code', {lit(self.code)}, 'severity', {lit(self.severity)},"
            f" 'message', {self.message}, 'url', {self.url}, 'details', {text})"
        )
        rows = f"transform({self.items}, item -> {issue})" if self.items else f"array({issue})"
        return f"if({self.when}, {rows}, cast(array() as array<{ISSUE}>))"


@dataclass
class Context:
    """What site rules may read."""

    facts: DataFrame
    fetches: DataFrame
    options: AuditOptions


@dataclass(frozen=True)
class Check:
    """``site_issues`` returns rows of ``AUDIT``, page_ord and the fields of ``ISSUE``.

    ``metrics`` are aggregates over ``page_facts``, as SQL text.
    """

    name: str
    page_rules: Callable[[AuditOptions], list[PageRule]] = lambda options: []
    site_issues: Callable[[Context], DataFrame] | None = None
    metrics: Callable[[AuditOptions], dict[str, str]] = lambda options: {}


def _live(condition: str) -> str:
    return f"({LIVE} and {condition})"


def _count(condition: str) -> str:
    return f"count_if({_live(condition)})"


# --- title -----------------------------------------------------------------

TITLE = X.strip("coalesce(title, '')")
TITLE_KEY = f"if({_live(f'{TITLE} <> {lit(str())}')}, lower({TITLE}), null)"
_TITLE_LEN = f"length({TITLE})"
_TITLE_SHORT = f"{TITLE} <> '' and {_TITLE_LEN} < {C.TITLE_MIN}"
_TITLE_LONG = f"{_TITLE_LEN} > {C.TITLE_MAX}"
_TITLE_FALLBACK = f"{TITLE} <> '' and {X.filled('title_source')} and title_source <> 'title'"


def _between(what: str, length: str, low: int, high: int) -> str:
    return f"concat('{what} (', {length}, ' chars; aim for {low}-{high})')"


def _title_rules(options: AuditOptions) -> list[PageRule]:
    sized = {"title": TITLE, "length": _TITLE_LEN}
    return [
        PageRule(
            "missing_title", "critical", _live(f"{TITLE} = ''"),
            "'Page is missing a title tag (no <title>, og:title, or twitter:title)'",
            {"og_title": "og_title", "twitter_title": "twitter_title", "title_source": "title_source"},
        ),
        PageRule(
            "title_from_fallback", "info", _live(_TITLE_FALLBACK),
            "concat('Title taken from ', title_source, ' because <title> was empty')",
            {"title": TITLE, "title_source": "title_source"},
        ),
        PageRule(
            "title_too_short", "warning", _live(_TITLE_SHORT),
            _between("Title is short", _TITLE_LEN, C.TITLE_MIN, C.TITLE_MAX), sized,
        ),
        PageRule(
            "title_too_long", "warning", _live(_TITLE_LONG),
            _between("Title is long", _TITLE_LEN, C.TITLE_MIN, C.TITLE_MAX), sized,
        ),
    ]


def titled_pages(facts: DataFrame) -> DataFrame:
    return facts.selectExpr(*AUDIT, "page_ord", "final_url", f"{TITLE_KEY} as title_key").filter(
        "title_key is not null"
    )


def duplicate_title_groups(facts: DataFrame) -> DataFrame:
    """Titles on more than one page of an audit: how many pages, and the first one."""
    return (
        titled_pages(facts)
        .groupBy(*AUDIT, "title_key")
        .agg(F.count("*").alias("n"), F.min(F.struct("page_ord", "final_url")).alias("first"))
        .filter("n > 1")
        .selectExpr(*AUDIT, "title_key", "n", "first.page_ord as page_ord", "first.final_url as first_url")
    )


def duplicate_title_members(facts: DataFrame) -> DataFrame:
    """Every page of every duplicate title."""
    groups = duplicate_title_groups(facts).select(*AUDIT, "title_key", "n")
    return titled_pages(facts).join(groups, [*AUDIT, "title_key"])


def issue_urls(facts: DataFrame) -> DataFrame:
    """The URL lists of all ``duplicate_title`` issues, one row per URL.

    ``issue_page_ord`` is the place of the issue, ``page_ord`` that of the URL. A list is
    as long as the site has such pages, so it is a table and never one value.
    """
    groups = duplicate_title_groups(facts).selectExpr(*AUDIT, "title_key", "page_ord as issue_page_ord")
    return (
        titled_pages(facts)
        .join(groups, [*AUDIT, "title_key"])
        .selectExpr(*AUDIT, "title_key", "issue_page_ord", "page_ord", "final_url as url")
    )


def _duplicate_titles(ctx: Context) -> DataFrame:
    """One issue per group with title and page count; ``issue_urls`` lists its pages."""
    return duplicate_title_groups(ctx.facts).selectExpr(
        *AUDIT,
        "page_ord",
        "'duplicate_title' as code",
        "'warning' as severity",
        "concat('Duplicate title found on ', n, ' pages') as message",
        "first_url as url",
        "to_json(named_struct('title', title_key, 'pages', n)) as details",
    )


def _title_metrics(options: AuditOptions) -> dict[str, str]:
    return {
        "missing": _count(f"{TITLE} = ''"),
        "too_short": _count(_TITLE_SHORT),
        "too_long": _count(_TITLE_LONG),
        "fallback_titles": _count(_TITLE_FALLBACK),
        "pages_with_title": _count(f"{TITLE} <> ''"),
        "avg_title_length": _average(_live(f"{TITLE} <> ''"), _TITLE_LEN),
    }


def _average(condition: str, value: str) -> str:
    total, n = f"sum(if({condition}, {value}, 0))", f"count_if({condition})"
    return X.round1(f"coalesce(try_divide({total}, {n}), 0D)")


# --- meta description ------------------------------------------------------

_DESC = X.strip("coalesce(meta_description, '')")
_DESC_LEN = f"length({_DESC})"
_DESC_SHORT = f"{_DESC} <> '' and {_DESC_LEN} < {C.DESCRIPTION_MIN}"
_DESC_LONG = f"{_DESC_LEN} > {C.DESCRIPTION_MAX}"
_DESC_FALLBACK = (
    f"{_DESC} <> '' and {X.filled('meta_description_source')} and meta_description_source <> 'description'"
)


def _description_rules(options: AuditOptions) -> list[PageRule]:
    sized = {"meta_description": _DESC, "length": _DESC_LEN}
    bounds = (C.DESCRIPTION_MIN, C.DESCRIPTION_MAX)
    return [
        PageRule(
            "missing_meta_description", "warning", _live(f"{_DESC} = ''"),
            "'Page is missing a meta description (no name=description, og:description, or twitter:description)'",
            {"og_description": "og_description", "twitter_description": "twitter_description"},
        ),
        PageRule(
            "meta_description_from_fallback", "info", _live(_DESC_FALLBACK),
            "concat('Meta description taken from ', meta_description_source, ' because name=description was empty')",
            {"meta_description": _DESC, "source": "meta_description_source"},
        ),
        PageRule(
            "meta_description_too_short", "info", _live(_DESC_SHORT),
            _between("Meta description is short", _DESC_LEN, *bounds), sized,
        ),
        PageRule(
            "meta_description_too_long", "info", _live(_DESC_LONG),
            _between("Meta description is long", _DESC_LEN, *bounds), sized,
        ),
    ]


def _description_metrics(options: AuditOptions) -> dict[str, str]:
    return {
        "missing": _count(f"{_DESC} = ''"),
        "too_short": _count(_DESC_SHORT),
        "too_long": _count(_DESC_LONG),
        "fallback_descriptions": _count(_DESC_FALLBACK),
        "pages_with_meta_description": _count(f"{_DESC} <> ''"),
        "avg_meta_description_length": _average(_live(f"{_DESC} <> ''"), _DESC_LEN),
    }


#: What the two averages are made of besides the number of pages: lengths, as aggregates over page facts.
LENGTH_SUMS = {
    "title": f"coalesce(sum(if({_live(f'{TITLE} <> {lit(str())}')}, {_TITLE_LEN}, 0)), 0)",
    "meta_description": f"coalesce(sum(if({_live(f'{_DESC} <> {lit(str())}')}, {_DESC_LEN}, 0)), 0)",
}


# --- headings --------------------------------------------------------------


def _solid(column: str) -> str:
    return f"filter(transform({column}, h -> {X.strip('h')}), h -> h <> '')"


_H1, _H2, _H3 = (f"size({_solid(h)})" for h in ("h1", "h2", "h3"))
_SHELL_NOTE = " (page looks like a JS shell; enable Playwright for client-rendered content)"


def _heading_rules(options: AuditOptions) -> list[PageRule]:
    return [
        PageRule(
            "missing_h1", "critical", _live(f"{_H1} = 0"),
            f"concat('Page is missing an H1 heading', if(likely_js_shell and not js_rendered, {lit(_SHELL_NOTE)}, ''))",
            {
                "h2_count": _H2, "h3_count": _H3, "word_count": "word_count",
                "js_rendered": "js_rendered", "likely_js_shell": "likely_js_shell",
            },
        ),
        PageRule(
            "multiple_h1", "info", _live(f"{_H1} > 1"),
            f"concat('Page has ', {_H1}, ' H1 headings')", {"h1": _solid("h1")},
        ),
        PageRule(
            "skipped_heading_level", "info", _live(f"{_H1} > 0 and {_H2} = 0 and {_H3} > 0"),
            "'Page has H3 headings without any H2 (possible heading hierarchy skip)'",
            {"h1": _solid("h1"), "h3": f"slice({_solid('h3')}, 1, 10)"},
        ),
    ]


def _heading_metrics(options: AuditOptions) -> dict[str, str]:
    def total(value: str) -> str:
        return f"coalesce(sum(if({LIVE}, {value}, 0)), 0)"

    return {
        "missing_h1": _count(f"{_H1} = 0"),
        "multiple_h1": _count(f"{_H1} > 1"),
        "empty_h1_filtered": total(f"size(h1) - {_H1}"),
        "pages_with_h2": _count(f"{_H2} > 0"),
        "total_h1": total(_H1),
        "total_h2": total(_H2),
        "total_h3": total(_H3),
    }


# --- images ----------------------------------------------------------------

_NO_ALT = missing_alts("images")


def _image_rules(options: AuditOptions) -> list[PageRule]:
    return [
        PageRule(
            "missing_image_alt", "warning", LIVE, "'Image is missing an alt attribute'",
            {"src": "item.src"}, items=_NO_ALT,
        )
    ]


def _image_metrics(options: AuditOptions) -> dict[str, str]:
    missing = f"coalesce(sum(if({LIVE}, size({_NO_ALT}), 0)), 0)"
    total = f"coalesce(sum(if({LIVE}, size(images), 0)), 0)"
    return {
        "missing_alt": missing,
        "images_total": total,
        "pages_with_images": _count("size(images) > 0"),
        "pages_missing_alt": _count(f"size({_NO_ALT}) > 0"),
        "alt_coverage_pct": X.round1(f"coalesce(try_divide(100 * ({total} - {missing}), {total}), 100D)"),
    }


# --- links -----------------------------------------------------------------

_BROKEN_DEFAULT = "Broken page (HTTP error during crawl)"


def _link_rules(options: AuditOptions) -> list[PageRule]:
    return [
        PageRule(
            "broken_page", "critical", "is_broken",
            f"coalesce(nullif(error, ''), {lit(_BROKEN_DEFAULT)})",
            {"status_code": "status_code", "requested_url": "url"},
        ),
        PageRule(
            "no_internal_links", "info",
            _live("size(internal_links) = 0 and (likely_js_shell or word_count > 0)"),
            "'Page has no crawlable internal links'",
            {"word_count": "word_count", "likely_js_shell": "likely_js_shell", "js_rendered": "js_rendered"},
        ),
        PageRule(
            "redirect_chain", "warning", "size(redirect_chain) > 1",
            "concat('Redirect chain with ', size(redirect_chain), ' hops')",
            {"chain": "redirect_chain"}, url="url",
        ),
    ]


def _broken_external_links(ctx: Context) -> DataFrame:
    return broken_probe_fetches(ctx.fetches).selectExpr(
        *AUDIT,
        "page_ord",
        "'broken_external_link' as code",
        "'warning' as severity",
        "coalesce(nullif(error, ''), 'Broken external link') as message",
        "url",
        "to_json(named_struct('status_code', status_code), map('ignoreNullFields', 'false')) as details",
    )


def _link_metrics(options: AuditOptions) -> dict[str, str]:
    def total(value: str) -> str:
        return f"coalesce(sum({value}), 0)"

    return {
        "broken_pages": "count_if(is_broken)",
        "redirect_chains": "count_if(size(redirect_chain) > 1)",
        "internal_links_unique": total("size(internal_links)"),
        "external_links_unique": total("size(external_links)"),
        "internal_link_occurrences": total(
            "coalesce(nullif(internal_link_occurrences, 0), size(internal_links))"
        ),
        "external_link_occurrences": total(
            "coalesce(nullif(external_link_occurrences, 0), size(external_links))"
        ),
        "pages_without_internal_links": _count("size(internal_links) = 0"),
    }


# --- canonical, robots, page size ------------------------------------------


def _canonical_rules(options: AuditOptions) -> list[PageRule]:
    missing = _live(f"not {X.filled('canonical')}")
    return [PageRule("missing_canonical", "info", missing, "'Page is missing a canonical link tag'")]


def _canonical_metrics(options: AuditOptions) -> dict[str, str]:
    return {"missing": _count(f"not {X.filled('canonical')}")}


def _robots_has(token: str) -> str:
    tokens = f"transform(split(robots_meta, ','), t -> lower({X.strip('t')}))"
    return f"{X.filled('robots_meta')} and array_contains({tokens}, '{token}')"


def _robots_rules(options: AuditOptions) -> list[PageRule]:
    shown = {"robots_meta": "robots_meta"}
    return [
        PageRule("robots_noindex", "warning", _live(_robots_has("noindex")), "'Page has robots meta noindex'", shown),
        PageRule("robots_nofollow", "info", _live(_robots_has("nofollow")), "'Page has robots meta nofollow'", shown),
    ]


def _robots_metrics(options: AuditOptions) -> dict[str, str]:
    return {"noindex": _count(_robots_has("noindex"))}


def _size_rules(options: AuditOptions) -> list[PageRule]:
    limit = options.page_size_threshold
    return [
        PageRule(
            "large_page", "warning", _live(f"content_length >= {limit}"),
            "concat('Page is large (', content_length, ' bytes)')",
            {"content_length": "content_length", "threshold": str(limit)},
        )
    ]


def _size_metrics(options: AuditOptions) -> dict[str, str]:
    limit = options.page_size_threshold
    return {"large_pages": _count(f"content_length >= {limit}"), "threshold": f"max({limit})"}


# --- sitemap ---------------------------------------------------------------

SITEMAP_SEEN = "coalesce(contains(final_url, 'sitemap.xml'), false)"
_SITEMAP_TEXT = (
    "Sitemap was not crawled in Phase 1; verify ",
    " manually or enable dedicated sitemap fetch later",
)


def _sitemap_issues(ctx: Context) -> DataFrame:
    sites = ctx.fetches.groupBy(*AUDIT).agg(F.expr(f"bool_or({SITEMAP_SEEN}) as seen")).filter("not seen")
    return sites.selectExpr(*AUDIT, f"{U.sitemap_url('seed_url')} as sitemap").selectExpr(
        *AUDIT,
        "0L as page_ord",
        "'sitemap_not_checked' as code",
        "'info' as severity",
        f"concat({lit(_SITEMAP_TEXT[0])}, sitemap, {lit(_SITEMAP_TEXT[1])}) as message",
        "sitemap as url",
        "'{}' as details",
    )


# --- schema ----------------------------------------------------------------

_NO_SCHEMA = "not has_json_ld and size(schema_types) = 0"


def _schema_rules(options: AuditOptions) -> list[PageRule]:
    return [
        PageRule(
            "missing_schema", "info", _live(_NO_SCHEMA), "'Page has no JSON-LD structured data'",
            {"extraction_warnings": "extraction_warnings"},
        ),
        PageRule(
            "schema_untyped", "info", _live("has_json_ld and size(schema_types) = 0"),
            "'JSON-LD found but no @type values were detected'",
        ),
    ]


def _schema_metrics(options: AuditOptions) -> dict[str, str]:
    return {
        "pages_missing_schema": _count(_NO_SCHEMA),
        "pages_with_schema": _count(f"not ({_NO_SCHEMA})"),
    }


def default_checks() -> list[Check]:
    """The built-in checks in report order."""
    return [
        Check("title", _title_rules, _duplicate_titles, _title_metrics),
        Check("meta_description", _description_rules, None, _description_metrics),
        Check("headings", _heading_rules, None, _heading_metrics),
        Check("image_alt", _image_rules, None, _image_metrics),
        Check("links", _link_rules, _broken_external_links, _link_metrics),
        Check("canonical", _canonical_rules, None, _canonical_metrics),
        Check("robots", _robots_rules, None, _robots_metrics),
        Check("page_size", _size_rules, None, _size_metrics),
        Check("sitemap", site_issues=_sitemap_issues),
        Check("schema", _schema_rules, None, _schema_metrics),
    ]


class CheckRegistry:
    """Ordered checks; a user adds their own with ``register``."""

    def __init__(self, checks: list[Check] | None = None) -> None:
        self.checks = list(default_checks() if checks is None else checks)

    def register(self, check: Check) -> CheckRegistry:
        self.checks.append(check)
        return self

    def names(self) -> list[str]:
        return [c.name for c in self.checks]


def _page_issue_rows(facts: DataFrame, rules: list[tuple[int, str, PageRule]]) -> DataFrame:
    """All page rules as one array per page and one explode."""
    found = ", ".join(
        f"transform({rule.issues()}, r -> named_struct('analyzer', {lit(name)},"
        f" 'analyzer_ord', {ord_}, 'issue', r))"
        for ord_, name, rule in rules
    )
    return (
        facts.selectExpr(*AUDIT, "page_ord", f"posexplode_outer(concat({found})) as (item_ord, f)")
        .filter("f is not null")
        .selectExpr(
            *AUDIT, "f.analyzer", "f.analyzer_ord", "0 as phase", "page_ord", "item_ord", "f.issue.*"
        )
    )


def page_issues(
    facts: DataFrame, options: AuditOptions, registry: CheckRegistry | None = None
) -> DataFrame:
    """Issues of the page rules only; needs no other page, so it also runs on a stream."""
    checks = (registry or CheckRegistry()).checks
    return _page_issue_rows(
        facts,
        [(n, check.name, rule) for n, check in enumerate(checks) for rule in check.page_rules(options)],
    )


def _site_issue_rows(df: DataFrame, ord_: int, name: str) -> DataFrame:
    return df.selectExpr(
        *AUDIT, f"{lit(name)} as analyzer", f"{ord_} as analyzer_ord", "1 as phase", "page_ord",
        "0 as item_ord", "code", "severity", "message", "url", "details",
    )


def _failed(ctx: Context, ord_: int, name: str, exc: Exception) -> DataFrame:
    reason = str(exc).splitlines()[0] if str(exc) else type(exc).__name__
    rows = ctx.fetches.select(*AUDIT).distinct().selectExpr(
        *AUDIT,
        "0L as page_ord",
        "'analyzer_error' as code",
        "'warning' as severity",
        lit(f"Analyzer '{name}' failed: {reason}") + " as message",
        "cast(null as string) as url",
        "'{}' as details",
    )
    return _site_issue_rows(rows, ord_, name)


def run_checks(
    ctx: Context, registry: CheckRegistry | None = None, isolate: bool = False
) -> DataFrame:
    """The issues of all audits, one row each.

    A check whose rules do not fit the tables becomes one ``analyzer_error`` issue per
    audit and the others go on. With ``isolate`` each check also runs on its own
    first, so that a failure at run time is caught the same way.
    """
    registry = registry or CheckRegistry()
    fused: list[tuple[int, str, PageRule]] = []
    parts: list[DataFrame] = []
    for ord_, check in enumerate(registry.checks):
        try:
            rules = [(ord_, check.name, rule) for rule in check.page_rules(ctx.options)]
            alone = [_page_issue_rows(ctx.facts, rules)] if rules and (isolate or not _trusted(check)) else []
            site = (
                [_site_issue_rows(check.site_issues(ctx), ord_, check.name)]
                if check.site_issues
                else []
            )
            if not _trusted(check):
                metric_aggregates(ctx, check)
            if isolate:
                for part in alone + site:
                    part.write.format("noop").mode("overwrite").save()
        except Exception as exc:  # any fault of a plug-in becomes a row
            parts.append(_failed(ctx, ord_, check.name, exc))
            continue
        fused += rules
        parts += site
    if fused:
        parts.insert(0, _page_issue_rows(ctx.facts, fused))
    if not parts:  # checks of metrics only
        parts.append(_page_issue_rows(ctx.facts, [(0, "", PageRule("", "info", "false", "''"))]))
    issues = parts[0]
    for part in parts[1:]:
        issues = issues.unionByName(part)
    return issues


def metric_aggregates(ctx: Context, check: Check) -> dict[str, str]:
    """The metrics of a check; a fault in any of them is raised here, before they are fused."""
    metrics = check.metrics(ctx.options)
    if metrics and not _trusted(check):
        ctx.facts.groupBy(*AUDIT).agg(*(F.expr(sql) for sql in metrics.values()))
    return metrics


def sound_metrics(ctx: Context, registry: CheckRegistry) -> dict[str, dict[str, str]]:
    """Metrics by check; a faulty check has none, its ``analyzer_error`` issue tells why."""
    found = {}
    for check in registry.checks:
        try:
            found[check.name] = metric_aggregates(ctx, check)
        except Exception:  # the fault is a row of run_checks
            found[check.name] = {}
    return found


def _trusted(check: Check) -> bool:
    """Built-in rules need no trial analysis before they are fused."""
    return check in _BUILT_IN


_BUILT_IN = default_checks()
