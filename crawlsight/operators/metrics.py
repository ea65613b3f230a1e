"""Metrics per check and structured totals per audit."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from crawlsight.functions import text as X
from crawlsight.functions.sql import lit
from crawlsight.operators.checks import (
    AUDIT,
    SITEMAP_SEEN,
    CheckRegistry,
    Context,
    duplicate_title_groups,
    sound_metrics,
)
from crawlsight.operators.facts import missing_alts
from crawlsight.sources.fetches import broken_probe_fetches

_SEP = "__"


def schema_types(facts: DataFrame) -> DataFrame:
    """Pages per structured-data type of each audit."""
    return (
        facts.selectExpr(*AUDIT, "explode_outer(schema_types) as schema_type")
        .filter("schema_type is not null")
        .groupBy(*AUDIT, "schema_type")
        .agg(F.count("*").alias("pages"))
    )


def wide_metrics(ctx: Context, registry: CheckRegistry | None = None) -> DataFrame:
    """One row per audit, a column ``check__metric`` for each metric.

    Page metrics are one aggregation; the few site metrics join it afterwards
    on one row per audit.
    """
    registry = registry or CheckRegistry()
    aggregates = [
        F.expr(sql).alias(f"{name}{_SEP}{metric}")
        for name, metrics in sound_metrics(ctx, registry).items()
        for metric, sql in metrics.items()
    ]
    wide = ctx.facts.groupBy(*AUDIT).agg(F.count("*").alias("pages"), *aggregates)
    names = registry.names()
    if "title" in names:
        groups = duplicate_title_groups(ctx.facts).groupBy(*AUDIT)
        wide = wide.join(groups.agg(F.count("*").alias("title__duplicates")), [*AUDIT], "left")
    if "links" in names:
        probes = broken_probe_fetches(ctx.fetches).groupBy(*AUDIT)
        wide = wide.join(
            probes.agg(F.count("*").alias("links__broken_external_links")), [*AUDIT], "left"
        ).selectExpr("*", "links__broken_pages + coalesce(links__broken_external_links, 0) as links__broken")
    if "sitemap" in names:
        seen = ctx.fetches.groupBy(*AUDIT).agg(
            F.expr(f"cast(bool_or({SITEMAP_SEEN}) as int) as sitemap__sitemap_observed")
        )
        wide = wide.join(seen, [*AUDIT], "left")
    if "schema" in names:
        types = schema_types(ctx.facts).groupBy(*AUDIT)
        wide = wide.join(types.agg(F.count("*").alias("schema__unique_schema_types")), [*AUDIT], "left")
    return wide.fillna(0)


def _metric_columns(wide: DataFrame) -> list[str]:
    return [c for c in wide.columns if _SEP in c]


def check_metrics(ctx: Context, registry: CheckRegistry | None = None) -> DataFrame:
    """Long form: one row per audit, check and metric; flags are 0 or 1."""
    return long_metrics(wide_metrics(ctx, registry))


def long_metrics(wide: DataFrame) -> DataFrame:
    cells = ", ".join(
        "named_struct('analyzer', {}, 'metric', {}, 'value', cast({} as double))".format(
            *(lit(part) for part in c.split(_SEP, 1)), c
        )
        for c in _metric_columns(wide)
    )
    return wide.selectExpr(*AUDIT, f"inline(array({cells}))")


def metrics_by_check(ctx: Context, registry: CheckRegistry | None = None) -> DataFrame:
    """One JSON object per audit and check; checks without metrics have no row.

    How many pages have each type is the table ``schema_types``, as long as a site has types.
    """
    wide = wide_metrics(ctx, registry)
    by_check: dict[str, list[str]] = {}
    for c in _metric_columns(wide):
        by_check.setdefault(c.split(_SEP, 1)[0], []).append(c)
    cells = []
    for name, columns in by_check.items():
        fields = [f"'{c.split(_SEP, 1)[1]}', {c}" for c in columns]
        if name == "sitemap":
            fields = ["'sitemap_observed', cast(sitemap__sitemap_observed as boolean)"]
        cells.append(
            f"named_struct('analyzer', {lit(name)}, 'metrics', to_json(named_struct({', '.join(fields)})))"
        )
    return wide.selectExpr(*AUDIT, f"inline(array({', '.join(cells)}))")


def structured_totals(facts: DataFrame) -> DataFrame:
    """Page counts, coverage, totals and rendering figures of each audit."""
    return facts.groupBy(*AUDIT).agg(*[F.expr(sql).alias(name) for name, sql in total_figures().items()])


def total_figures() -> dict[str, str]:
    """The structured totals by name, as aggregates over page facts; all are sums over pages."""

    def live(condition: str) -> str:
        return f"count_if(not is_broken and {condition})"

    def total(value: str) -> str:
        return f"coalesce(sum(if(is_broken, 0, {value})), 0)"

    return {
        "pages_total": "count(*)",
        "pages_live": "count_if(not is_broken)",
        "pages_broken": "count_if(is_broken)",
        "coverage_titles": live(X.filled("title")),
        "coverage_meta_descriptions": live(X.filled("meta_description")),
        "coverage_h1": live("size(h1) > 0"),
        "coverage_canonical": live(X.filled("canonical")),
        "coverage_schema": live("(has_json_ld or size(schema_types) > 0)"),
        "total_h1": total("size(h1)"),
        "total_h2": total("size(h2)"),
        "total_h3": total("size(h3)"),
        "total_images": total("coalesce(nullif(image_count, 0), size(images))"),
        "total_internal_links_unique": total("size(internal_links)"),
        "total_external_links_unique": total("size(external_links)"),
        "total_internal_link_occurrences": total("internal_link_occurrences"),
        "total_external_link_occurrences": total("external_link_occurrences"),
        "total_word_count": total("word_count"),
        "js_shell_pages": live("likely_js_shell"),
        "js_rendered_pages": live("js_rendered"),
    }


def _length(c: str) -> str:
    return f"coalesce(length({c}), 0) as {c}_length"


_MISSING_ALT = f"size({missing_alts('images')}) as images_missing_alt"
_IMAGES = "coalesce(nullif(image_count, 0), size(images)) as image_count"


def page_summaries(facts: DataFrame) -> DataFrame:
    """The figures of every page, broken pages included."""
    return facts.selectExpr(
        *AUDIT, "page_ord", "url", "final_url", "status_code", "is_broken", "title", "title_source",
        _length("title"), "meta_description", "meta_description_source", _length("meta_description"),
        "h1", "h2", "h3", "size(h1) as h1_count", "size(h2) as h2_count", "size(h3) as h3_count",
        _IMAGES, _MISSING_ALT, "canonical", "robots_meta",
        "size(internal_links) as internal_links_unique",
        "size(external_links) as external_links_unique",
        "internal_link_occurrences", "external_link_occurrences", "word_count", "text_length",
        "content_length", "has_json_ld", "schema_types", "lang", "has_viewport", "js_rendered",
        "extraction_warnings", "seo_signals",
    )


def page_overview(facts: DataFrame) -> DataFrame:
    """The shorter projection used in reports."""
    return facts.selectExpr(
        *AUDIT, "page_ord", "final_url as url", "status_code", "title", "title_source",
        _length("title"), "meta_description", _length("meta_description"), "is_broken", "h1",
        "size(h1) as h1_count", "size(h2) as h2_count", "size(h3) as h3_count", _IMAGES,
        _MISSING_ALT, "size(internal_links) as internal_links", "internal_link_occurrences",
        "size(external_links) as external_links", "external_link_occurrences", "word_count",
        "canonical", "has_json_ld", "schema_types", "js_rendered", "extraction_warnings",
    )
