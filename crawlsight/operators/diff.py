"""Comparison of two audits of each site by issue key (code, url, message)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from crawlsight.functions.text import fixed1, signed1

KEY = ("code", "url", "message")


def _absent(rows: DataFrame, others: DataFrame) -> DataFrame:
    a, b = rows.alias("a"), others.select("seed_url", *KEY).alias("b")
    on = F.expr(" and ".join(["a.seed_url = b.seed_url"] + [f"a.{k} <=> b.{k}" for k in KEY]))
    return a.join(b, on, "left_anti")


def new_issues(current: DataFrame, previous: DataFrame) -> DataFrame:
    """Issues of the current audits whose key the previous audit of the site lacks; repeats stay."""
    return _absent(current, previous)


def resolved_issues(current: DataFrame, previous: DataFrame) -> DataFrame:
    return _absent(previous, current)


def key_counts(current: DataFrame, previous: DataFrame) -> DataFrame:
    """New, resolved and unchanged counts of each site in one aggregation, without a join.

    A key is counted on both sides at once; grouping is null-safe by itself.
    """
    sides = current.selectExpr("seed_url", *KEY, "1 as cur", "0 as prev").unionByName(
        previous.selectExpr("seed_url", *KEY, "0 as cur", "1 as prev")
    )
    keys = sides.groupBy("seed_url", *KEY).agg(F.sum("cur").alias("cur"), F.sum("prev").alias("prev"))
    return keys.groupBy("seed_url").agg(
        F.expr("coalesce(sum(if(prev = 0, cur, 0)), 0) as new_issues"),
        F.expr("coalesce(sum(if(cur = 0, prev, 0)), 0) as resolved_issues"),
        F.expr("count_if(cur > 0 and prev > 0) as unchanged_issue_count"),
    )


def changes(current: DataFrame, previous: DataFrame, pairs: DataFrame) -> DataFrame:
    """New, resolved and unchanged issues of many comparisons in one shuffle.

    ``pairs`` has current_audit_id and previous_audit_id (NULL: no baseline, no rows); an audit may
    be the baseline of several others. The issues of both sides are one table, tagged, and a window
    over each key tells which sides hold it. New and resolved issues keep their repeats; of an
    unchanged key one row stays. ``side`` says which; keys are compared NULL-safe.
    """
    pairs = pairs.filter("previous_audit_id is not null").select("current_audit_id", "previous_audit_id")
    fields = [c for c in current.columns if c not in ("saved_at", "seed_bucket")]
    sides = [
        rows.select(*fields).join(pairs, F.expr(f"audit_id = {of}")).withColumn("is_current", F.lit(is_current))
        for rows, of, is_current in ((current, "current_audit_id", True), (previous, "previous_audit_id", False))
    ]
    key = W.partitionBy("current_audit_id", *KEY).orderBy("is_current")
    whole = key.rowsBetween(W.unboundedPreceding, W.unboundedFollowing)
    rows = sides[0].unionByName(sides[1]).select(
        "*",
        F.max("is_current").over(whole).alias("now"),
        F.min("is_current").over(whole).alias("never_before"),
        F.row_number().over(key).alias("nth"),
    )
    side = "case when never_before then 'new' when not now then 'resolved' when nth = 1 then 'unchanged' end"
    return rows.withColumn("side", F.expr(side)).filter("side is not null").drop("is_current", "now", "never_before", "nth")


def change_counts(rows: DataFrame) -> DataFrame:
    """New, resolved and unchanged counts of each comparison in ``changes``."""
    return rows.groupBy("current_audit_id").agg(
        F.expr("count_if(side = 'new') as new_issues"),
        F.expr("count_if(side = 'resolved') as resolved_issues"),
        F.expr("count_if(side = 'unchanged') as unchanged_issue_count"),
    )


NO_BASELINE = "No previous audit found for this URL."


def compare(
    current_audits: DataFrame, previous_audits: DataFrame, current: DataFrame, previous: DataFrame
) -> DataFrame:
    """One diff row per current audit.

    ``previous_audits`` holds the chosen baseline of each site, ``previous`` its issues.
    Sites without a baseline keep zero counts and say so.
    """
    base = previous_audits.selectExpr("seed_url", "audit_id as previous_audit_id")
    with_base = current.join(base.select("seed_url"), "seed_url", "left_semi")
    pairs = current_audits.selectExpr("audit_id as current_audit_id", "seed_url").join(base, "seed_url", "left")
    counts = pairs.select("current_audit_id", "seed_url").join(key_counts(with_base, previous), "seed_url")
    return diff_rows(current_audits, previous_audits, pairs, counts.drop("seed_url"))


def diff_rows(current_audits: DataFrame, previous_audits: DataFrame, pairs: DataFrame, counts: DataFrame) -> DataFrame:
    """One diff row per current audit, from its baseline in ``pairs`` and its ``change_counts``.

    A baseline that is not among ``previous_audits`` counts as none.
    """
    base = previous_audits.selectExpr("audit_id as previous_audit_id", "score as previous_score")
    chosen = pairs.select("current_audit_id", "previous_audit_id").join(base, "previous_audit_id")
    rows = (
        current_audits.selectExpr("seed_url", "audit_id as current_audit_id", "score as current_score")
        .join(chosen, "current_audit_id", "left")
        .join(counts, "current_audit_id", "left")
        .selectExpr(
            "seed_url as url",
            "previous_audit_id",
            "current_audit_id",
            "previous_score",
            "current_score",
            "previous_audit_id is not null as has_baseline",
            "if(previous_audit_id is null, 0D, current_score - previous_score) as score_delta",
            *[
                f"coalesce({c}, 0) as {c}"
                for c in ("new_issues", "resolved_issues", "unchanged_issue_count")
            ],
        )
    )
    trend = (
        f"case when score_delta > 0 then concat('Score improved by ', {fixed1('score_delta')})"
        f" when score_delta < 0 then concat('Score declined by ', {fixed1('abs(score_delta)')})"
        " else 'Score unchanged' end"
    )
    return rows.selectExpr(
        "*",
        f"if(has_baseline, concat({trend}, '. New issues: ', new_issues, '. Resolved issues: ',"
        f" resolved_issues, '. Unchanged: ', unchanged_issue_count, '.'), '{NO_BASELINE}') as summary",
    )


def compare_summary(diffs: DataFrame) -> DataFrame:
    """The part of a diff shown in the audit summary."""
    return diffs.select(
        "current_audit_id", "url", "has_baseline", "score_delta", "new_issues", "resolved_issues"
    )


def _bullet(i: str) -> str:
    return (
        f"concat('- [', {i}.code, '] ', {i}.message,"
        f" if(coalesce({i}.url, '') = '', '', concat(' (`', {i}.url, '`)')))"
    )


def change_report_lines(diffs: DataFrame, new: DataFrame, resolved: DataFrame) -> DataFrame:
    """Change report of every diff as ordered lines; issue lists are never gathered."""
    head = [
        "'# SEO Audit Change Report'",
        "''",
        "concat('**URL:** ', url)",
        "concat('**Current audit:** ', current_audit_id)",
        "concat('**Previous audit:** ', coalesce(previous_audit_id, 'None'))",
        f"concat('**Current score:** ', {fixed1('current_score')}, '/100')",
        f"if(previous_score is null, null, concat('**Previous score:** ', {fixed1('previous_score')}, '/100'))",
        f"concat('**Score delta:** ', {signed1('score_delta')})",
        "''",
        "'## Summary'",
        "''",
        "if(summary = '', 'No changes summarized.', summary)",
        "''",
        "'## New Issues'",
        "''",
    ]
    none = "if({} = 0, '- None', null)"
    sections = {
        0: head,
        1: [none.format("new_issues")],
        2: ["''", "'## Resolved Issues'", "''"],
        3: [none.format("resolved_issues")],
        4: [
            "''",
            "'## Unchanged'",
            "''",
            "concat('- ', unchanged_issue_count, ' issue(s) still present')",
            "''",
        ],
    }
    cells = ", ".join(
        f"named_struct('section_ord', {s}, 'item_ord', struct(0, 0, 0L, {n}), 'line', {sql})"
        for s, lines in sections.items()
        for n, sql in enumerate(lines)
    )
    fixed = diffs.selectExpr("url as seed_url", f"inline(array({cells}))").filter("line is not null")
    order = "struct(i.analyzer_ord, i.phase, i.page_ord, i.item_ord) as item_ord"

    def listed(rows: DataFrame, section: int) -> DataFrame:
        return rows.alias("i").selectExpr(
            "i.seed_url", f"{section} as section_ord", order, f"{_bullet('i')} as line"
        )

    known = diffs.filter("has_baseline").selectExpr("url as seed_url")
    new = new.join(known, "seed_url", "left_semi")
    return fixed.union(listed(new, 1)).union(listed(resolved, 3))
