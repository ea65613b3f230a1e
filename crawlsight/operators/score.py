"""Severity counts and scores, from issue rows or straight from fetch records."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from crawlsight.config import AuditOptions, Scoring
from crawlsight.operators.checks import AUDIT, SITEMAP_SEEN, TITLE_KEY, CheckRegistry, Context, default_checks
from crawlsight.schema import SEVERITIES
from crawlsight.sources.fetches import broken_probe_fetches


def penalty(scoring: Scoring) -> str:
    return f"({scoring.critical} * critical + {scoring.warning} * warning + {scoring.info} * info)"


def with_score(counts: DataFrame, scoring: Scoring) -> DataFrame:
    """Adds the clamped score and the penalty, which still tells large sites apart at 0."""
    raw = penalty(scoring)
    return counts.selectExpr(
        "*",
        f"cast({raw} as bigint) as raw_penalty",
        f"greatest(0D, least(100D, cast({scoring.base} - {raw} as double))) as score",
    )


def severity_counts(issues: DataFrame) -> DataFrame:
    """One row per audit that has issues; absent severities count 0."""
    return issues.groupBy(*AUDIT).agg(
        F.count("*").alias("issues"),
        *[F.expr(f"count_if(severity = '{s}')").alias(s) for s in SEVERITIES],
    )


def score_audits(audits: DataFrame, issues: DataFrame, scoring: Scoring | None = None) -> DataFrame:
    """Scores of all ``audits`` (rows of ``AUDIT``), those without issues too."""
    zero = {c: 0 for c in ("issues", *SEVERITIES)}
    counts = audits.join(severity_counts(issues), [*AUDIT], "left").fillna(zero)
    return with_score(counts, scoring or Scoring())


def score_sites(
    facts: DataFrame, fetches: DataFrame, options: AuditOptions | None = None, registry: CheckRegistry | None = None
) -> DataFrame:
    """The same scores without forming any issue row.

    Checks of ``registry`` beyond the built-in ones count too: their page rules with the
    others, the issues of their site rules as rows without a page. A registry that
    leaves out a built-in check, or one with faults, needs ``score_audits``.

    Pages are counted per title first, which finds the duplicate titles and
    spreads a huge site over many groups; a second aggregation sums the titles.
    Both combine before their shuffle.
    """
    options = options or AuditOptions()
    checks = (registry or CheckRegistry()).checks
    built_in = default_checks()
    if any(check not in checks for check in built_in):
        raise ValueError("score_sites needs all built-in checks; use score_audits")
    rules = [r for check in checks for r in check.page_rules(options)]
    per_page = [
        "cast(" + (" + ".join(r.count() for r in rules if r.severity == s) or "0") + f" as bigint) as {s}"
        for s in SEVERITIES
    ]
    pages = facts.selectExpr(
        *AUDIT, "1 as page", f"{TITLE_KEY} as title_key", f"{SITEMAP_SEEN} as seen", *per_page
    )
    probes = broken_probe_fetches(fetches).selectExpr(
        *AUDIT,
        "0 as page",
        "cast(null as string) as title_key",
        f"{SITEMAP_SEEN} as seen",
        "0L as critical",
        "1L as warning",
        "0L as info",
    )
    rows = pages.unionByName(probes)
    for check in checks:
        if check not in built_in and check.site_issues:
            more = check.site_issues(Context(facts, fetches, options)).selectExpr(
                *AUDIT,
                "0 as page",
                "cast(null as string) as title_key",
                "false as seen",
                *(f"if(severity = '{s}', 1L, 0L) as {s}" for s in SEVERITIES),
            )
            rows = rows.unionByName(more)
    titles = (
        rows
        .groupBy(*AUDIT, "title_key")
        .agg(
            F.sum("page").alias("pages"),
            F.bool_or("seen").alias("seen"),
            *[F.sum(s).alias(s) for s in SEVERITIES],
        )
    )
    counts = titles.groupBy(*AUDIT).agg(
        F.sum("pages").alias("pages"),
        F.sum("critical").alias("critical"),
        F.expr("sum(warning) + count_if(title_key is not null and pages > 1) as warning"),
        F.expr("sum(info) + if(bool_or(seen), 0, 1) as info"),
    )
    return with_score(counts, options.scoring)
