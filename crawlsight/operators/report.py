"""Reports as ordered line tables.

A report of a site with many issues is as long as the issues are, so a document is
never gathered in one row: each line knows its audit and place, and the text sink
sorts lines by range.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from crawlsight.functions import text as X
from crawlsight.functions.sql import lit, strings
from crawlsight.operators.checks import AUDIT, issue_urls
from crawlsight.operators.facts import HELPERS
from crawlsight.operators.metrics import page_overview, schema_types
from crawlsight.operators.score import severity_counts
from crawlsight.sources.store import iso

ISSUE_ORD = "struct(analyzer_ord, phase, page_ord, cast(item_ord as bigint) as item_ord)"
# Report limits and formats.
TOP_CODES = 5
FIRST_ISSUES = 40
TEXT_LIMIT = 12_000
TRUNCATED = "\n\n…[truncated]"
FORMATS = ("json", "markdown")
SECTIONS = (("critical", "Critical Issues"), ("warning", "Warnings"), ("info", "Suggestions"))


def check_format(fmt: str) -> str:
    """The format in lower case. PDF is known but not available."""
    fmt = fmt.lower()
    if fmt == "pdf":
        raise NotImplementedError("PDF reports are not available; use json or markdown")
    if fmt not in FORMATS:
        raise ValueError(f"Unsupported report format: {fmt}")
    return fmt


def severity_sections(issues: DataFrame) -> DataFrame:
    """Issues with the report section they belong to and their order in it."""
    names = " ".join(f"when '{s}' then '{name.lower().replace(' ', '_')}'" for s, name in SECTIONS)
    return issues.selectExpr("*", f"case severity {names} end as section", f"{ISSUE_ORD} as issue_ord")


def code_counts(issues: DataFrame) -> DataFrame:
    return issues.groupBy(*AUDIT, "code").agg(
        F.count("*").alias("n"), F.min(F.expr(ISSUE_ORD)).alias("first_ord")
    )


def top_codes(issues: DataFrame, k: int = TOP_CODES) -> DataFrame:
    """The most frequent codes of each audit; ties go to the code seen first."""
    order = W.partitionBy(*AUDIT).orderBy(F.desc("n"), "first_ord")
    ranked = code_counts(issues).withColumn("rank", F.row_number().over(order))
    return ranked.filter(F.col("rank") <= k).select(*AUDIT, "rank", "code", "n")


def first_issues(issues: DataFrame, k: int = FIRST_ISSUES) -> DataFrame:
    """The first issues of each audit in report order."""
    order = W.partitionBy("audit_id").orderBy("analyzer_ord", "phase", "page_ord", "item_ord")
    return issues.withColumn("rn", F.row_number().over(order)).filter(F.col("rn") <= k)


def report_summary(
    audits: DataFrame,
    issues: DataFrame,
    facts: DataFrame,
    statuses: DataFrame | None = None,
    diffs: DataFrame | None = None,
) -> DataFrame:
    """One row per audit: counts, top codes, notes on suggestions and comparison.

    ``audits`` has audit_id, seed_url, created_at and score.
    """
    counts = severity_counts(issues).drop("issues")
    pages = facts.groupBy(*AUDIT).agg(F.count("*").alias("pages_analyzed"))
    codes = (
        top_codes(issues)
        .groupBy(*AUDIT)
        .agg(F.expr("transform(array_sort(collect_list(struct(rank, code))), x -> x.code) as top_issue_codes"))
    )
    rows = (
        audits.select(*AUDIT, "created_at", "score")
        .join(pages, [*AUDIT], "left")
        .join(counts, [*AUDIT], "left")
        .join(codes, [*AUDIT], "left")
    )
    notes = []
    if statuses is not None:
        s = statuses.selectExpr("audit_id", "status as opt_status", "message as opt_message")
        rows = rows.join(s, "audit_id", "left")
        notes += ["concat('AI optimization status: ', opt_status)", "nullif(opt_message, '')"]
    if diffs is not None:
        d = diffs.selectExpr("current_audit_id as audit_id", "summary as diff_summary")
        rows = rows.join(d, "audit_id", "left")
        notes.append("if(diff_summary = '', 'Comparison completed.', diff_summary)")
    return rows.selectExpr(
        *AUDIT,
        "created_at",
        "coalesce(pages_analyzed, 0) as pages_analyzed",
        "score as overall_seo_score",
        "coalesce(critical, 0) as critical_count",
        "coalesce(warning, 0) as warning_count",
        "coalesce(info, 0) as suggestion_count",
        "coalesce(top_issue_codes, cast(array() as array<string>)) as top_issue_codes",
        f"array_compact(cast(array({', '.join(notes)}) as array<string>)) as notes",
    )


def report_metadata(summary: DataFrame) -> DataFrame:
    return summary.selectExpr(
        "audit_id",
        "seed_url",
        f"{X.fixed1('overall_seo_score')} as score",
        "cast(pages_analyzed as string) as pages",
    )


_PLACE = "struct(0 as analyzer_ord, 0 as phase, {} as page_ord, cast({} as bigint) as item_ord)"


def _fixed(df: DataFrame, sections: dict[int, list[str]], arrays: dict[int, str] | None = None) -> DataFrame:
    """Lines of all given sections in one pass over ``df``.

    ``sections`` holds lines as SQL text, in order, NULL ones are left out; ``arrays``
    holds sections whose lines are one SQL array.
    """
    cells = "array(" + ", ".join(
        f"named_struct('section_ord', {section}, 'n', {n}, 'line', {sql})"
        for section, lines in sections.items()
        for n, sql in enumerate(lines)
    ) + ")"
    for section, sql in (arrays or {}).items():
        more = f"transform({sql}, (x, i) -> named_struct('section_ord', {section}, 'n', i, 'line', x))"
        cells = f"concat({cells}, {more})"
    return (
        df.selectExpr("audit_id", f"inline({cells})")
        .filter("line is not null")
        .selectExpr("audit_id", "section_ord", f"{_PLACE.format('0L', 'n')} as item_ord", "line")
    )


def bullet(code: str = "code", message: str = "message", url: str = "url") -> str:
    return (
        f"concat('- [', {code}, '] ', {message},"
        f" if(coalesce({url}, '') = '', '', concat(' (`', {url}, '`)')))"
    )


# The wording of report lines below is what readers and comparisons expect.


def _frame(summary: DataFrame) -> DataFrame:
    """Every line that depends on the summary of an audit alone."""
    overall = X.fixed1("overall_seo_score")
    head = [
        "'# SEO Audit Report'",
        "''",
        "concat('**URL:** ', seed_url)",
        "concat('**Audit ID:** ', audit_id)",
        f"concat('**Overall SEO Score:** ', {overall}, '/100')",
        "concat('**Pages analyzed:** ', pages_analyzed)",
        f"concat('**Created:** ', {iso('created_at')})",
        "''",
        "'## Summary'",
        "''",
        f"concat('- Overall SEO Score: **', {overall}, '/100**')",
        "concat('- Pages analyzed: ', pages_analyzed)",
        "concat('- Critical issues: ', critical_count)",
        "concat('- Warnings: ', warning_count)",
        "concat('- Suggestions: ', suggestion_count)",
        "if(size(top_issue_codes) > 0, concat('- Top issue codes: ', array_join(top_issue_codes, ', ')), null)",
    ]
    counts = ("critical_count", "warning_count", "suggestion_count")
    headings = {
        2 + 2 * n: ["''", f"'## {name}'", "''", f"if({count} = 0, '- None', null)"]
        for n, ((_, name), count) in enumerate(zip(SECTIONS, counts))
    }
    paged = "if(pages_analyzed > 0, {}, null)"
    overview = {11: [paged.format("'## Page Overview'"), paged.format("''")], 13: [paged.format("''")]}
    closing = {15: ["'## Overall SEO Score'", "''", f"concat('**', {overall}, ' / 100**')", "''"]}
    notes = {1: "transform(notes, note -> concat('- Note: ', note))"}
    return _fixed(summary, {0: head, **headings, **overview, **closing}, notes)


def _issue_lines(issues: DataFrame) -> DataFrame:
    """Bullets of the three severities; one pass over the issues."""
    section = "case severity when 'critical' then 3 when 'warning' then 5 else 7 end"
    return issues.selectExpr(
        "audit_id", f"{section} as section_ord", f"{ISSUE_ORD} as item_ord", f"{bullet()} as line"
    )


def _diff_lines(diffs: DataFrame) -> DataFrame:
    rows = diffs.withColumnRenamed("current_audit_id", "audit_id")
    return _fixed(rows, {
        8: [
            "''",
            "'## Change Report'",
            "''",
            "concat('- Has baseline: ', if(has_baseline, 'True', 'False'))",
            f"concat('- Score delta: ', {X.signed1('score_delta')})",
            "concat('- New issues: ', new_issues)",
            "concat('- Resolved issues: ', resolved_issues)",
            "concat('- ', summary)",
            "''",
        ]
    })


def _suggestion_lines(suggestions: DataFrame) -> DataFrame:
    """Lines per suggested page; ``suggestions`` holds successful pages only."""

    def text(column: str, label: str) -> str:
        return f"if({X.filled(column)}, array(concat('- **{label}:** ', {column})), array())"

    def listed(column: str, label: str, line: str) -> str:
        return (
            f"if(size({column}) > 0, concat(array('- **{label}:**'),"
            f" flatten(transform({column}, x -> {line}))), array())"
        )

    parts = [
        "array(concat('### ', url), '')",
        text("improved_title", "Title"),
        text("improved_meta_description", "Meta description"),
        text("improved_h1", "H1"),
        "if(size(keyword_suggestions) > 0,"
        " array(concat('- **Keywords:** ', array_join(keyword_suggestions, ', '))), array())",
        listed("heading_suggestions", "Headings", "array(concat('  - ', x))"),
        listed(
            "faq_suggestions", "FAQs",
            "array(concat('  - Q: ', x.question), concat('    A: ', x.answer))",
        ),
        listed(
            "internal_link_suggestions", "Internal links",
            "array(concat('  - [', x.anchor_text, '](', x.target_url, ') — ', x.rationale))",
        ),
        "if(coalesce(schema_suggestion, '{}') <> '{}',"
        " array('- **Schema:** JSON-LD suggestion included in JSON report'), array())",
        listed("notes", "Notes", "array(concat('  - ', x))"),
        "array('')",
    ]
    body = suggestions.selectExpr(
        "audit_id", "page_ord", f"posexplode(concat({', '.join(parts)})) as (n, line)"
    ).selectExpr("audit_id", "10 as section_ord", f"{_PLACE.format('page_ord', 'n')} as item_ord", "line")
    title = _fixed(
        suggestions.select("audit_id").distinct(), {9: ["''", "'## AI Optimization Suggestions'", "''"]}
    )
    return title.union(body)


def _page_lines(facts: DataFrame) -> DataFrame:
    figures = ", ', ', ".join(
        f"'{label}=', {c}"
        for label, c in (
            ("title_len", "title_length"),
            ("meta_len", "meta_description_length"),
            ("h1", "h1_count"),
            ("h2", "h2_count"),
            ("h3", "h3_count"),
            ("images", "image_count"),
            ("missing_alt", "images_missing_alt"),
            ("internal_links", "internal_links"),
            ("words", "word_count"),
            ("schema", "if(size(schema_types) = 0, 'none', array_join(schema_types, ','))"),
        )
    )
    status = "if(is_broken, 'broken', coalesce(cast(status_code as string), 'None'))"
    first = f"concat('- `', url, '` — ', coalesce(nullif(title, ''), '(no title)'), ' [', {status}, ']')"
    return (
        page_overview(facts)
        .selectExpr("audit_id", "page_ord", f"posexplode(array({first}, concat('  - ', {figures}))) as (n, line)")
        .selectExpr("audit_id", "12 as section_ord", f"{_PLACE.format('page_ord', 'n')} as item_ord", "line")
    )


def _metric_lines(totals: DataFrame) -> DataFrame:
    return _fixed(totals, {
        14: [
            "'## Structured SEO Metrics'",
            "''",
            "concat('- Live pages: ', pages_live, ' / ', pages_total)",
            "concat('- Broken pages: ', pages_broken)",
            "concat('- Titles present: ', coverage_titles)",
            "concat('- Meta descriptions present: ', coverage_meta_descriptions)",
            "concat('- Pages with H1: ', coverage_h1)",
            "concat('- Pages with canonical: ', coverage_canonical)",
            "concat('- Pages with schema: ', coverage_schema)",
            "concat('- Total H1/H2/H3: ', total_h1, '/', total_h2, '/', total_h3)",
            "concat('- Images: ', total_images)",
            "concat('- Internal links (unique / occurrences): ', total_internal_links_unique, ' / ',"
            " total_internal_link_occurrences)",
            "concat('- Word count (all pages): ', total_word_count)",
            "concat('- JS shell pages / JS-rendered pages: ', js_shell_pages, ' / ', js_rendered_pages)",
        ]
    })


def report_lines(
    summary: DataFrame,
    issues: DataFrame,
    facts: DataFrame,
    diffs: DataFrame | None = None,
    suggestions: DataFrame | None = None,
    totals: DataFrame | None = None,
) -> DataFrame:
    """Markdown report of every audit. Give ``totals`` to insert the metrics section."""
    parts = [_frame(summary), _issue_lines(issues), _page_lines(facts)]
    if diffs is not None:
        parts.append(_diff_lines(diffs))
    if suggestions is not None:
        parts.append(_suggestion_lines(suggestions))
    if totals is not None:
        parts.append(_metric_lines(totals))
    lines = parts[0]
    for part in parts[1:]:
        lines = lines.union(part)
    return lines


def _json_items(rows: DataFrame, section: str, order: str, value: str) -> DataFrame:
    """One array element per line; all but the first of an audit's section start with a comma.

    The first place of each section is one aggregation over the same rows.
    """
    rows = rows.selectExpr("audit_id", f"{section} as section_ord", f"{order} as item_ord", f"{value} as v")
    first = rows.groupBy("audit_id", "section_ord").agg(F.min("item_ord").alias("first_ord"))
    return rows.join(first, ["audit_id", "section_ord"]).selectExpr(
        "audit_id", "section_ord", "item_ord", "concat(if(item_ord = first_ord, '', ','), v) as line"
    )


_KEEP = "map('ignoreNullFields', 'false')"
_ISSUE_JSON = (
    "to_json(named_struct('code', code, 'severity', severity, 'message', message, 'url', url,"
    f" 'details', parse_json(details)), {_KEEP})"
)


_LAST = 9223372036854775807


def _json_issues(issues: DataFrame, facts: DataFrame, section: str) -> DataFrame:
    """Issues as array elements. The list of a duplicate title follows its opening line, a line per URL."""
    opened = f"if(code = 'duplicate_title', concat(left({_ISSUE_JSON}, length({_ISSUE_JSON}) - 2), ',\"urls\":['), {_ISSUE_JSON})"
    lines = _json_items(issues, section, ISSUE_ORD, opened)
    groups = issues.filter("code = 'duplicate_title'").selectExpr(
        *AUDIT, "page_ord as issue_page_ord", "analyzer_ord", "phase", f"{section} as section_ord"
    )
    place = "struct(analyzer_ord, phase, issue_page_ord as page_ord, {} as item_ord)"
    urls = issue_urls(facts).join(groups, [*AUDIT, "issue_page_ord"])
    text = "to_json(array(url))"
    listed = urls.selectExpr(
        "audit_id",
        "section_ord",
        f"{place.format('page_ord + 2')} as item_ord",
        f"concat(if(page_ord = issue_page_ord, '', ','), substr({text}, 2, length({text}) - 2)) as line",
    )
    closed = groups.selectExpr("audit_id", "section_ord", f"{place.format(f'{_LAST}L')} as item_ord", "']}}' as line")
    return lines.unionByName(listed).unionByName(closed)


_PAGE_JSON = (
    "to_json(named_struct('url', url, 'improved_title', improved_title, 'improved_meta_description',"
    " improved_meta_description, 'improved_h1', improved_h1, 'heading_suggestions', heading_suggestions,"
    " 'keyword_suggestions', keyword_suggestions, 'faq_suggestions', faq_suggestions, 'schema_suggestion',"
    " parse_json(schema_suggestion), 'internal_link_suggestions', internal_link_suggestions,"
    f" 'notes', notes), {_KEEP})"
)


def full_audit_lines(audits: DataFrame, issues: DataFrame, facts: DataFrame, checks: DataFrame) -> DataFrame:
    """The whole audit as JSON text in lines: its row, pages, issues, metrics per check and schema types."""
    head = f"to_json(struct(* except (created_at), {iso('created_at')} as created_at), {_KEEP})"
    rows = audits.selectExpr("audit_id", f"{head} as head")
    lines = _fixed(
        rows,
        {
            0: ["concat('{\"audit\":', head, ',')", "'\"pages\":['"],
            2: ["'],\"issues\":['"],
            4: ["'],\"analyzer_results\":['"],
            6: ["'],\"schema_types\":['"],
            8: ["']}'"],
        },
    )
    fields = ", ".join(f"'{c}', {c}" for c in facts.columns if c not in (*AUDIT, "page_ord", "depth", *HELPERS))
    pages = _json_items(facts, "1", _PLACE.format("page_ord", "0"), f"to_json(named_struct({fields}), {_KEEP})")
    result = f"to_json(named_struct('analyzer', analyzer, 'metrics', parse_json(metrics)), {_KEEP})"
    results = _json_items(checks, "5", _PLACE.format("xxhash64(analyzer)", "0"), result)
    kind = f"to_json(named_struct('type', schema_type, 'pages', pages), {_KEEP})"
    kinds = _json_items(schema_types(facts), "7", _PLACE.format("-pages", "xxhash64(schema_type)"), kind)
    return lines.unionByName(pages).unionByName(_json_issues(issues, facts, "3")).unionByName(results).unionByName(kinds)


def document_lines(
    summary: DataFrame,
    issues: DataFrame,
    facts: DataFrame,
    diffs: DataFrame | None = None,
    statuses: DataFrame | None = None,
    suggestions: DataFrame | None = None,
) -> DataFrame:
    """The report document as JSON text in lines: joined in order they are one object per audit."""
    keep, rows = _KEEP, summary
    optimization, closed, diff = "'null'", "", "'null'"
    if statuses is not None:
        opt = f"to_json(struct(status, message), {keep})"
        if suggestions is not None:
            opt, closed = f"concat(rtrim('}}', {opt}), ',\"pages\":[')", "if(opt_json is null, '', ']}')"
        rows = rows.join(statuses.selectExpr("audit_id", f"{opt} as opt_json"), "audit_id", "left")
        optimization = "coalesce(opt_json, 'null')"
    if diffs is not None:
        d = diffs.selectExpr("current_audit_id as audit_id", f"to_json(struct(*), {keep}) as diff_json")
        rows, diff = rows.join(d, "audit_id", "left"), "coalesce(diff_json, 'null')"
    head = (
        "to_json(named_struct('seed_url', seed_url, 'audit_id', audit_id, 'created_at',"
        f" {iso('created_at')}, 'pages_analyzed', pages_analyzed, 'overall_seo_score', overall_seo_score,"
        " 'critical_count', critical_count, 'warning_count', warning_count, 'suggestion_count',"
        f" suggestion_count, 'top_issue_codes', top_issue_codes, 'notes', notes), {keep})"
    )
    frame = {
        0: [f"concat('{{\"summary\":', {head}, ',')", "'\"critical_issues\":['"],
        2: ["'],\"warnings\":['"],
        4: ["'],\"suggestions\":['"],
        6: ["concat('],\"overall_seo_score\":', overall_seo_score, ',')", f"concat('\"optimization\":', {optimization})"],
        8: [f"concat({closed or lit('')}, ',\"diff\":', {diff}, ',')", "'\"page_overview\":['"],
        10: ["']}'"],
    }
    section = "case severity when 'critical' then 1 when 'warning' then 3 else 5 end"
    page = page_overview(facts)
    fields = ", ".join(f"'{c}', {c}" for c in page.columns if c not in (*AUDIT, "page_ord"))
    lines = (
        _fixed(rows, frame)
        .unionByName(_json_issues(issues, facts, section))
        .unionByName(_json_items(page, "9", _PLACE.format("page_ord", "0"), f"to_json(named_struct({fields}), {keep})"))
    )
    if statuses is not None and suggestions is not None:
        lines = lines.unionByName(_json_items(suggestions, "7", _PLACE.format("page_ord", "0"), _PAGE_JSON))
    return lines


def diff_document_lines(diffs: DataFrame, new: DataFrame, resolved: DataFrame) -> DataFrame:
    """A comparison as JSON text in lines, with its new and resolved issues."""
    head = f"to_json(struct(* except (audit_id, new_issues, resolved_issues)), {_KEEP})"
    rows = diffs.selectExpr("*", "current_audit_id as audit_id").selectExpr("audit_id", f"{head} as head")

    def listed(issues: DataFrame, section: int) -> DataFrame:
        mine = issues.drop("audit_id").withColumnRenamed("current_audit_id", "audit_id")
        return _json_items(mine, str(section), ISSUE_ORD, _ISSUE_JSON)

    frame = {0: ["concat(rtrim('}', head), ',')", "'\"new_issues\":['"], 2: ["'],\"resolved_issues\":['"], 4: ["']}'"]}
    return _fixed(rows, frame).unionByName(listed(new, 1)).unionByName(listed(resolved, 3))


def compact_view(
    summary: DataFrame, issues: DataFrame, totals: DataFrame, checks: DataFrame, names: list[str]
) -> DataFrame:
    """Short JSON view of each audit: figures, issue counts per check and the first issues.

    ``checks`` is ``metrics_by_check``, ``names`` the check names in report order.
    """
    keep = _KEEP
    position = f"array_position(array({strings(names)}), analyzer)"
    first = (
        first_issues(issues)
        .groupBy("audit_id")
        .agg(
            F.expr(
                "transform(array_sort(collect_list(struct(rn, code, severity, message, url, details))),"
                " x -> named_struct('code', x.code, 'severity', x.severity, 'message', x.message,"
                " 'url', x.url, 'details', parse_json(x.details))) as top_issues"
            ),
        )
    )
    per_check = issues.groupBy("audit_id", "analyzer").agg(F.count("*").alias("issue_count"))
    names = per_check.select("audit_id", "analyzer").union(checks.select("audit_id", "analyzer")).distinct()
    results = (
        names.join(per_check, ["audit_id", "analyzer"], "left")
        .join(checks.select("audit_id", "analyzer", "metrics"), ["audit_id", "analyzer"], "left")
        .groupBy("audit_id")
        .agg(
            F.expr(
                f"transform(array_sort(collect_list(struct({position} as pos, analyzer, coalesce(issue_count, 0) as n,"
                " coalesce(metrics, '{}') as m))), x -> named_struct('analyzer', x.analyzer,"
                " 'metrics', parse_json(x.m), 'issue_count', x.n)) as analyzer_results"
            )
        )
    )
    figures = totals.selectExpr("audit_id", "struct(* except (audit_id, seed_url)) as seo_metrics")
    return (
        summary.join(figures, "audit_id", "left")
        .join(results, "audit_id", "left")
        .join(first, "audit_id", "left")
        .selectExpr(
            *AUDIT,
            "to_json(named_struct('audit_id', audit_id, 'seed_url', seed_url, 'score', overall_seo_score,"
            " 'pages', pages_analyzed, 'issues', critical_count + warning_count + suggestion_count,"
            " 'seo_metrics', seo_metrics, 'analyzer_results', analyzer_results, 'top_issues', top_issues),"
            f" {keep}) as view",
        )
    )


def bounded_text(content: str) -> str:
    """Report text cut to a fixed length with a marker."""
    return (
        f"if(length({content}) > {TEXT_LIMIT}, concat(left({content}, {TEXT_LIMIT}), {lit(TRUNCATED)}), {content})"
    )


#: Pages whose lines one task adds up.
_PAGES = 4096


def bounded_lines(lines: DataFrame, limit: int = TEXT_LIMIT) -> DataFrame:
    """Report lines cut so that a report, its lines joined by line ends, has at most ``limit`` characters.

    The marker follows as lines of its own. Where a line begins is a running total over the report,
    by chunks of pages: chunks that begin beyond the limit are dropped before their lines are
    ordered, and no report is gathered in one row or task.
    """
    chunk = f"struct(section_ord, item_ord.analyzer_ord, item_ord.phase, item_ord.page_ord div {_PAGES} as pages)"
    rows = lines.selectExpr("audit_id", "section_ord", "item_ord", "line", f"{chunk} as chunk", "length(line) + 1 as n")
    every = W.partitionBy("audit_id")
    earlier = every.orderBy("chunk").rowsBetween(W.unboundedPreceding, -1)
    chunks = (
        rows.groupBy("audit_id", "chunk")
        .agg(F.sum("n").alias("n"))
        .select("audit_id", "chunk", F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("before"), (F.sum("n").over(every) - 1).alias("total"))
        .filter(F.col("before") <= limit)
    )
    within = W.partitionBy("audit_id", "chunk").orderBy("item_ord").rowsBetween(W.unboundedPreceding, -1)
    begins = F.col("before") + F.coalesce(F.sum("n").over(within), F.lit(0))
    kept = (
        rows.join(chunks, ["audit_id", "chunk"])
        .withColumn("begins", begins)
        .filter(F.col("begins") <= limit)
        .selectExpr("audit_id", "section_ord", "item_ord", f"if(total > {limit}, left(line, cast({limit} - begins as int)), line) as line")
    )
    place = _PLACE.format("0L", "n")
    marker = f"posexplode(split({lit(TRUNCATED[1:])}, '\\n')) as (n, line)"
    marked = chunks.filter(f"before = 0 and total > {limit}").selectExpr("audit_id", marker)
    last = len(SECTIONS) * 100
    return kept.unionByName(marked.selectExpr("audit_id", f"{last} as section_ord", f"{place} as item_ord", "line"))


def audit_rows(summary: DataFrame) -> DataFrame:
    """Short listing row of each audit."""
    return summary.selectExpr(
        "audit_id",
        "seed_url",
        "overall_seo_score as score",
        "pages_analyzed as pages",
        "critical_count + warning_count + suggestion_count as issues",
        "struct(critical_count as critical, warning_count as warning, suggestion_count as info) as severity",
    )
