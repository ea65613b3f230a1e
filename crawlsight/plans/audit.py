"""Jobs: audit, report, comparison, suggestions and history over tables of many sites."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, replace

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from crawlsight.config import AuditOptions
from crawlsight.functions import url as U
from crawlsight.functions.sql import lit, strings
from crawlsight.operators import diff as D
from crawlsight.operators import metrics as M
from crawlsight.operators import report as R
from crawlsight.operators import suggest as S
from crawlsight.operators.checks import AUDIT, CheckRegistry, Context, run_checks
from crawlsight.operators.crawl import crawl_stats
from crawlsight.operators.facts import staged_pages
from crawlsight.operators.score import score_audits
from crawlsight.session import stage
from crawlsight.sources import store
from crawlsight.sources.fetches import USABLE, rejects


@dataclass
class AuditResult:
    """Tables of one audit run; all share audit_id and seed_url. ``fetches`` are its records without the page source."""

    options: AuditOptions
    registry: CheckRegistry
    fetches: DataFrame
    facts: DataFrame
    issues: DataFrame
    audits: DataFrame
    rejected: DataFrame | None = None
    diffs: DataFrame | None = None
    new_issues: DataFrame | None = None
    resolved_issues: DataFrame | None = None
    answers: DataFrame | None = None
    statuses: DataFrame | None = None

    @property
    def context(self) -> Context:
        return Context(self.facts, self.fetches, self.options)

    def totals(self) -> DataFrame:
        return M.structured_totals(self.facts)

    def metrics(self) -> DataFrame:
        return M.check_metrics(self.context, self.registry)

    def metrics_json(self) -> DataFrame:
        return M.metrics_by_check(self.context, self.registry)

    def summary(self) -> DataFrame:
        return R.report_summary(self.audits, self.issues, self.facts, self.statuses, self.diffs)


def audit_sites(
    fetches: DataFrame,
    run_ts: str,
    options: AuditOptions | None = None,
    registry: CheckRegistry | None = None,
    isolate: bool = False,
    facts: DataFrame | None = None,
) -> AuditResult:
    """Audits every site in ``fetches``. Staged page facts of them may be given, so no page is parsed again;
    the records need no page source then (``staged_pages`` gives both).

    Facts and issues are staged once because the aggregates, the report and the
    comparison all read them. Records that belong to no audit are in ``rejected``
    and nowhere else. ``run_ts`` is given by the caller, so a rerun of the
    same job gives the same rows.
    """
    options = options or AuditOptions()
    registry = registry or CheckRegistry()
    rejected = rejects(fetches)
    fetches = fetches.filter(USABLE)
    facts, narrow = staged_pages(fetches) if facts is None else (facts.filter(USABLE), fetches.drop("html"))
    issues = stage(run_checks(Context(facts, narrow, options), registry, isolate), "issues")
    names = strings(registry.names())
    spine = narrow.select(*AUDIT).distinct()
    pages = facts.groupBy(*AUDIT).agg(F.count("*").alias("pages"))
    audits = (
        score_audits(spine, issues, options.scoring)
        .join(pages, [*AUDIT], "left")
        .selectExpr(
            "audit_id",
            f"coalesce({U.normalize_url('seed_url')}, seed_url) as seed_url",
            f"timestamp {lit(run_ts)} as created_at",
            "score",
            "raw_penalty",
            "coalesce(pages, 0L) as pages",
            "issues",
            "struct(critical, warning, info) as severity",
            f"array({names}) as analyzers_run",
        )
    )
    return AuditResult(options, registry, narrow, facts, issues, audits, rejected)


def compare_audits(
    result: AuditResult,
    previous_audits: DataFrame,
    previous_issues: DataFrame,
    baselines: DataFrame | None = None,
    as_of: bool = False,
) -> AuditResult:
    """Adds the comparison of each audit with its baseline.

    That is the newest other audit of the site among ``previous_audits``, so it is the same before
    and after the run is saved; with ``as_of`` the newest one before the audit. ``baselines`` (audit_id,
    previous_audit_id) names them instead; audits that it leaves out have none. Stored issues
    count only if they belong to the current version of their audit.
    """
    if "saved_at" in previous_audits.columns and "saved_at" in previous_issues.columns:
        previous_issues = store.current_rows(previous_issues, previous_audits)
    if baselines is None:
        chosen = store.baselines(result.audits, previous_audits, as_of)
    else:
        chosen = result.audits.select("audit_id").join(baselines.select("audit_id", "previous_audit_id"), "audit_id", "left")
    pairs = stage(chosen.selectExpr("audit_id as current_audit_id", "previous_audit_id"), "baselines")
    rows = stage(D.changes(result.issues, previous_issues, pairs), "changes")
    result.diffs = D.diff_rows(result.audits, previous_audits, pairs, D.change_counts(rows))
    result.new_issues = rows.filter("side = 'new'").drop("side")
    result.resolved_issues = rows.filter("side = 'resolved'").drop("side")
    return result


def audit_summary(result: AuditResult) -> DataFrame:
    """Audit rows with the comparison and the suggestion status, where there are any."""
    rows = result.audits
    if result.diffs is not None:
        compare = D.compare_summary(result.diffs).selectExpr(
            "current_audit_id as audit_id",
            "struct(has_baseline, score_delta, new_issues, resolved_issues) as compare",
        )
        rows = rows.join(compare, "audit_id", "left")
    if result.statuses is not None:
        rows = rows.join(
            result.statuses.selectExpr("audit_id", "status as optimization_status"), "audit_id", "left"
        )
    return rows


#: Tables beside the audits of a store, and the part of a result they hold.
BESIDE = ("issues", "page_facts", "records", "diffs", "new_issues", "resolved_issues", "answers", "statuses")


def _parts(result: AuditResult) -> dict[str, DataFrame]:
    """What belongs to the audits of a run, each row under its audit and site."""
    parts = {"issues": result.issues, "page_facts": result.facts, "records": result.fetches}
    if result.diffs is not None:
        owner = ["current_audit_id as audit_id", "url as seed_url"]
        parts["diffs"] = result.diffs.selectExpr(*owner, "* except (url, current_audit_id)")
        for name, rows in (("new_issues", result.new_issues), ("resolved_issues", result.resolved_issues)):
            parts[name] = rows.selectExpr("current_audit_id as audit_id", "audit_id as issue_audit_id", "* except (audit_id, current_audit_id)")
    sites = result.audits.select("audit_id", "seed_url")
    for name, rows in (("answers", result.answers), ("statuses", result.statuses)):
        if rows is not None:
            parts[name] = rows.drop("seed_url").join(sites, "audit_id")
    return parts


def persist(result: AuditResult, root: str, saved_at: str) -> None:
    """Appends a run to the store, if its options ask for saving or comparing.

    The audits come last: until then readers see nothing of the run. They are staged, since the
    store, a comparison and a report read them several times.
    """
    if not result.options.persists:
        return
    result.audits = stage(result.audits, "audits")
    stamp = F.expr(f"timestamp {lit(saved_at)}")
    for name, rows in _parts(result).items():
        store.save(rows.withColumn("saved_at", stamp), f"{root}/{name}")
    store.save_audits(result.audits.withColumn("saved_at", stamp), f"{root}/audits")


def delete_audit(spark: SparkSession, root: str, audit_id: str) -> bool:
    """Removes an audit with all that belongs to it; tells if there was one."""
    return store.delete(spark, f"{root}/audits", audit_id)


def compact_store(spark: SparkSession, root: str, after: Callable[[str], None] = lambda step: None) -> list[int]:
    """Frees the space of deleted and replaced audits."""
    return store.compact(spark, f"{root}/audits", [f"{root}/{name}" for name in BESIDE], after)


def stored_result(
    spark: SparkSession, root: str, audit_id: str, options: AuditOptions | None = None, registry: CheckRegistry | None = None
) -> AuditResult:
    """One stored audit as its run left it; KeyError if there is none. Only its bucket is read of each table."""
    audits = store.find(spark, f"{root}/audits", audit_id)
    if audits.isEmpty():
        raise KeyError(f"Audit not found: {audit_id}")

    def part(name: str) -> DataFrame | None:
        path = f"{root}/{name}"
        if not store.exists(spark, path):
            return None
        return store.belonging(spark, path, audits).filter(F.col("audit_id") == audit_id).drop("saved_at", "seed_bucket")

    diffs = part("diffs")
    if diffs is not None and not diffs.isEmpty():
        diffs = diffs.selectExpr(
            "seed_url as url", "previous_audit_id", "audit_id as current_audit_id", "* except (seed_url, previous_audit_id, audit_id)"
        )
    else:
        diffs = None
    lists = [None, None]
    if diffs is not None:
        none = part("issues").filter("false").selectExpr("*", "'' as current_audit_id", "'' as previous_audit_id")
        names = {"audit_id": "current_audit_id", "issue_audit_id": "audit_id"}
        found = [part(n) for n in ("new_issues", "resolved_issues")]
        lists = [none if rows is None else rows.withColumnsRenamed(names) for rows in found]
    answers, statuses = part("answers"), part("statuses")
    if statuses is not None and statuses.isEmpty():
        answers = statuses = None
    return AuditResult(
        options or AuditOptions(),
        registry or CheckRegistry(),
        part("records"),
        part("page_facts"),
        part("issues"),
        audits.drop("saved_at", "seed_bucket"),
        None,
        diffs,
        *lists,
        answers,
        statuses,
    )


def suggestion_requests(result: AuditResult, target_keywords=()) -> DataFrame:
    pages = S.candidates(result.facts, result.options.suggestion_pages)
    keywords = target_keywords or result.options.target_keywords
    return S.requests(pages, S.related_urls(result.facts), keywords)


def with_suggestions(result: AuditResult, answers: DataFrame) -> AuditResult:
    """Adds parsed model answers ``(audit_id, url, page_ord, raw, error)``."""
    result.answers = S.parse_answers(answers)
    result.statuses = S.site_status(result.audits, result.answers)
    return result


def report(
    result: AuditResult, fmt: str = "markdown", metrics: bool = False, full_audit: bool = False
) -> DataFrame:
    """Report of every audit as lines, in markdown or as a JSON document.

    ``full_audit`` gives the whole audit instead of the report sections (JSON only).
    """
    fmt = R.check_format(fmt)
    good = result.answers.filter("status = 'ok'") if result.answers is not None else None
    if fmt == "json" and full_audit:
        return R.full_audit_lines(audit_summary(result), result.issues, result.facts, result.metrics_json())
    if fmt == "json":
        return R.document_lines(
            result.summary(), result.issues, result.facts, result.diffs, result.statuses, good
        )
    return R.report_lines(
        result.summary(),
        result.issues,
        result.facts,
        result.diffs,
        good,
        result.totals() if metrics else None,
    )


def report_by_id(result: AuditResult, audit_id: str, fmt: str = "markdown") -> DataFrame:
    """Report of one audit; KeyError if there is none."""
    R.check_format(fmt)
    mine = F.col("audit_id") == audit_id
    audits = result.audits.filter(mine)
    if audits.isEmpty():
        raise KeyError(f"Audit not found: {audit_id}")

    def only(df: DataFrame | None, column: str = "audit_id") -> DataFrame | None:
        return None if df is None else df.filter(F.col(column) == audit_id)

    one = replace(
        result,
        audits=audits,
        fetches=only(result.fetches),
        facts=only(result.facts),
        issues=only(result.issues),
        diffs=only(result.diffs, "current_audit_id"),
        answers=only(result.answers),
        statuses=only(result.statuses),
    )
    return report(one, fmt)


def report_stored(
    spark: SparkSession, root: str, audit_id: str, fmt: str = "markdown", metrics: bool = False, full_audit: bool = False
) -> DataFrame:
    """Report of one stored audit; KeyError if there is none."""
    R.check_format(fmt)
    return report(stored_result(spark, root, audit_id), fmt, metrics, full_audit)


def change_report(result: AuditResult, fmt: str = "markdown") -> DataFrame:
    if R.check_format(fmt) == "json":
        return R.diff_document_lines(result.diffs, result.new_issues, result.resolved_issues)
    return D.change_report_lines(result.diffs, result.new_issues, result.resolved_issues)


# Job names as a caller may ask for them.
JOBS = {
    "audit_sites": audit_sites,
    "crawl_stats": crawl_stats,
    "generate_report": report,
    "stored_report": report_stored,
    "suggestion_requests": suggestion_requests,
    "compare_audits": compare_audits,
    "list_history": store.history,
    "change_report": change_report,
}
