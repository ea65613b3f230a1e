"""Suggestion requests and answers as batch tables. The model call happens outside Spark."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from crawlsight.config import SUGGESTION_PAGES
from crawlsight.functions import text as X
from crawlsight.functions.sql import NO_STRINGS, lit
from crawlsight.operators.checks import AUDIT

# Request limits, instruction texts and the requested answer schema.
MAX_INTERNAL = 30
MAX_EXTERNAL = 15
MAX_IMAGES = 20
MAX_CANDIDATES = 40
SYSTEM_TEXT = """You are an expert SEO content advisor.
You improve on-page SEO using ONLY the extracted page facts provided.
Do not invent crawl facts, products, claims, or links that are not supported by the input.
If information is missing, suggest conservative improvements and note assumptions in notes.
Return ONLY valid JSON matching the requested schema. No markdown fences."""
USER_HEAD = "Optimize this page for SEO. Use the facts below.\n\n"
USER_TAIL = (
    "\n\nRespond with a single JSON object containing exactly these keys: "
    "improved_title, improved_meta_description, improved_h1, heading_suggestions, "
    "keyword_suggestions, faq_suggestions, schema_suggestion, "
    "internal_link_suggestions, notes."
)
ANSWER_SCHEMA = """{
 "improved_title": "string|null (50-60 chars ideal)",
 "improved_meta_description": "string|null (140-160 chars ideal)",
 "improved_h1": "string|null",
 "heading_suggestions": ["string"],
 "keyword_suggestions": ["string"],
 "faq_suggestions": [{"question": "string", "answer": "string"}],
 "schema_suggestion": {"@context": "https://schema.org", "@type": "WebPage"},
 "internal_link_suggestions": [{"anchor_text": "string",
  "target_url": "string from candidate_internal_urls when possible", "rationale": "string"}],
 "notes": ["string"]
}"""
DONE = "Optimization suggestions generated"


def parse_keywords(text: str | list | None) -> list[str]:
    """Keywords of a job option: a list, or text with commas."""
    parts = text if isinstance(text, list) else str(text or "").split(",")
    return [str(p).strip() for p in parts if str(p).strip()]


def keywords(text: str) -> str:
    """The same for a column, as SQL text."""
    return f"filter(transform(split({text}, ','), k -> {X.strip('k')}), k -> k <> '')"


def candidates(facts: DataFrame, n: int = SUGGESTION_PAGES) -> DataFrame:
    """The first live pages of each audit in crawl order."""
    order = W.partitionBy("audit_id").orderBy("page_ord")
    live = facts.filter("not is_broken").withColumn("rn", F.row_number().over(order))
    return live.filter(F.col("rn") <= n).drop("rn")


def related_urls(facts: DataFrame) -> DataFrame:
    """The alphabetically first live addresses of each audit, as many as a request may list.

    Ranked before they are collected, so the array stays within the limit.
    """
    urls = facts.filter("not is_broken").select("audit_id", "final_url").distinct()
    order = W.partitionBy("audit_id").orderBy("final_url")
    return (
        urls.withColumn("rn", F.row_number().over(order))
        .filter(F.col("rn") <= MAX_CANDIDATES)
        .groupBy("audit_id")
        .agg(F.array_sort(F.collect_list("final_url")).alias("related"))
    )


def requests(pages: DataFrame, related: DataFrame | None, target_keywords=()) -> DataFrame:
    """Payload and messages for each page. Without ``related`` a page offers its own links."""
    words = "cast(array(" + ", ".join(lit(k) for k in target_keywords) + ") as array<string>)"
    rows = pages.select(
        *AUDIT, "page_ord", "final_url", "title", "meta_description", "h1", "h2", "canonical",
        "robots_meta", "internal_links", "external_links", "images", "has_json_ld", "schema_types",
    )
    own = f"slice(internal_links, 1, {MAX_CANDIDATES})"
    if related is not None:
        rows = rows.join(related, "audit_id", "left")
        own = f"if({X.size0('related')} > 0, related, {own})"
    current = (
        "named_struct('title', title, 'meta_description', meta_description, 'h1', h1, 'h2', h2,"
        " 'canonical', canonical, 'robots_meta', robots_meta,"
        f" 'internal_links', slice(internal_links, 1, {MAX_INTERNAL}),"
        f" 'external_links', slice(external_links, 1, {MAX_EXTERNAL}),"
        f" 'images', slice(images, 1, {MAX_IMAGES}), 'has_json_ld', has_json_ld,"
        " 'schema_types', schema_types)"
    )
    payload = (
        f"to_json(named_struct('url', final_url, 'current', {current}, 'target_keywords', {words},"
        f" 'candidate_internal_urls', {own}, 'output_schema', parse_json({lit(ANSWER_SCHEMA)})),"
        " map('ignoreNullFields', 'false'))"
    )
    return rows.selectExpr(*AUDIT, "page_ord", "final_url as url", f"{payload} as payload").selectExpr(
        "*",
        f"array(named_struct('role', 'system', 'content', {lit(SYSTEM_TEXT)}),"
        f" named_struct('role', 'user', 'content', concat({lit(USER_HEAD)}, payload, {lit(USER_TAIL)})))"
        " as messages",
    )


def strip_fence(raw: str) -> str:
    """Answer text without a surrounding code fence."""
    body = f"regexp_replace({X.strip(raw)}, '^```[^\\\\n]*+(?:\\\\n|$)', '')"
    inner = f"regexp_replace({body}, '(?:^|\\\\n)```[^\\\\n]*+$', '')"
    return f"if(startswith({X.strip(raw)}, '```'), {X.strip(inner)}, {X.strip(raw)})"


def _kind(path: str) -> str:
    return f"coalesce(schema_of_variant(try_variant_get(v, '$.{path}', 'variant')), 'VOID')"


_TEXTS = ("improved_title", "improved_meta_description", "improved_h1")
_LISTS = ("heading_suggestions", "keyword_suggestions", "notes")
_OBJECTS = {
    "faq_suggestions": ("question", "answer"),
    "internal_link_suggestions": ("anchor_text", "target_url", "rationale"),
}


def _items(path: str) -> str:
    return f"coalesce(try_variant_get(v, '$.{path}', 'array<variant>'), cast(array() as array<variant>))"


def _objects(path: str) -> str:
    return f"filter({_items(path)}, x -> startswith(schema_of_variant(x), 'OBJECT'))"


def _valid() -> str:
    rules = ["startswith(schema_of_variant(v), 'OBJECT')"]
    rules += [f"{_kind(p)} in ('VOID', 'STRING')" for p in _TEXTS]
    for p in (*_LISTS, *_OBJECTS):
        rules.append(f"({_kind(p)} = 'VOID' or startswith({_kind(p)}, 'ARRAY'))")
    rules += [f"forall({_items(p)}, x -> schema_of_variant(x) = 'STRING')" for p in _LISTS]
    for p, fields in _OBJECTS.items():
        typed = " and ".join(
            f"coalesce(schema_of_variant(try_variant_get(x, '$.{f}', 'variant')), '') = 'STRING'"
            for f in fields
        )
        rules.append(f"forall({_objects(p)}, x -> {typed})")
    return "coalesce(" + " and ".join(rules) + ", false)"


def parse_answers(answers: DataFrame) -> DataFrame:
    """Typed suggestions of each answer ``(audit_id, url, page_ord, raw, error)``.

    An answer that is no JSON object, or whose fields have other types than asked
    for, becomes an error row instead of stopping the batch.
    """
    parsed = answers.selectExpr("*", f"try_parse_json({strip_fence('raw')}) as v").selectExpr(
        "*", f"{_valid()} as valid"
    )

    def when_valid(sql: str, empty: str) -> str:
        return f"if(valid, {sql}, {empty})"

    columns = [
        f"{when_valid(f'''try_variant_get(v, '$.{p}', 'string')''', 'null')} as {p}" for p in _TEXTS
    ]
    columns += [
        f"{when_valid(f'''transform({_items(p)}, x -> cast(x as string))''', NO_STRINGS)} as {p}"
        for p in _LISTS
    ]
    for p, fields in _OBJECTS.items():
        struct = ", ".join(f"'{f}', try_variant_get(x, '$.{f}', 'string')" for f in fields)
        kind = "array<struct<" + ",".join(f"{f}:string" for f in fields) + ">>"
        columns.append(
            f"{when_valid(f'transform({_objects(p)}, x -> named_struct({struct}))', f'cast(array() as {kind})')} as {p}"
        )
    schema = "try_variant_get(v, '$.schema_suggestion', 'variant')"
    kind = _kind("schema_suggestion")
    columns.append(
        f"if(not valid or {kind} = 'VOID', null, if(startswith({kind}, 'OBJECT'), to_json({schema}),"
        f" to_json(named_struct('raw', {schema})))) as schema_suggestion"
    )
    return parsed.selectExpr(
        "audit_id",
        "url",
        "page_ord",
        *columns,
        f"if({X.filled('error')} or not valid, 'error', 'ok') as status",
        f"case when {X.filled('error')} then error when not valid then 'Answer is not valid JSON of the"
        f" requested form' else '{DONE}' end as message",
    )


def page_status(facts: DataFrame, parsed: DataFrame) -> DataFrame:
    """Outcome of each requested page: broken page or failed answer, else ok."""
    rows = parsed.select("audit_id", "url", "status", "message")
    pages = facts.selectExpr("audit_id", "final_url as url", "is_broken", "error")
    return (
        pages.join(rows, ["audit_id", "url"], "left")
        .filter("is_broken or status is not null")
        .selectExpr(
            "audit_id",
            "url",
            "if(is_broken, 'error', status) as status",
            "if(is_broken, coalesce(nullif(error, ''), 'Page could not be fetched'), message) as message",
        )
    )


def site_status(audits: DataFrame, parsed: DataFrame) -> DataFrame:
    """Outcome of each audit: ok, partial, or error if no page succeeded."""
    counts = parsed.groupBy("audit_id").agg(
        F.expr("count_if(status = 'ok') as done"), F.expr("count_if(status <> 'ok') as failed")
    )
    return (
        audits.select(*AUDIT)
        .join(counts, "audit_id", "left")
        .selectExpr(*AUDIT, "coalesce(done, 0) as done", "coalesce(failed, 0) as failed")
        .selectExpr(
            *AUDIT,
            "case when done > 0 and failed = 0 then 'ok' when done > 0 then 'partial' else 'error' end as status",
            f"concat('{DONE}', if(failed > 0, concat('; ', failed, ' page(s) failed'), '')) as message",
            "done as pages",
        )
    )
