"""Page facts: one projection chain from fetch records, no shuffle.

The chain is staged because the optimizer keeps a column that is used more than
once in its own projection; each pass over the page source then runs once.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from crawlsight.functions import html as H
from crawlsight.functions import text as X
from crawlsight.functions import url as U
from crawlsight.functions.jsonld import json_ld_types
from crawlsight.functions.sql import NO_STRINGS, lit
from crawlsight.schema import HOPS
from crawlsight.session import stage
from crawlsight.sources.fetches import BROKEN, page_fetches

KEYS = ("audit_id", "seed_url", "page_ord", "depth")
CARRIED = (
    *KEYS, "url", "final_url", "status_code", "content_length", "redirect_chain", "error",
    "js_rendered",
)
LEVELS = (1, 2, 3, 4, 5, 6)
NO_IMAGES = "cast(array() as array<struct<src:string,alt:string>>)"
LIVE = f"(not {BROKEN} and {X.filled('html')})"

PAGE_FIELDS = (
    "url", "final_url", "status_code", "title", "meta_description",
    "h1", "h2", "h3", "h4", "h5", "h6", "images", "canonical", "robots_meta",
    "internal_links", "external_links", "content_length", "redirect_chain", "is_broken", "error",
    "has_json_ld", "schema_types", "title_source", "meta_description_source",
    "og_title", "og_description", "twitter_title", "twitter_description", "lang", "has_viewport",
    "word_count", "text_length", "internal_link_occurrences", "external_link_occurrences",
    "image_count", "js_rendered", "extraction_warnings", "seo_signals",
)

# Beyond the page's fields: ``links`` are all its resolvable links in order, with repeats, of broken pages too.
HELPERS = ("likely_js_shell", "links")


def _named(columns: dict[str, str]) -> list[str]:
    return [f"{sql} as {name}" for name, sql in columns.items()]


def _meta(key: str, value: str) -> str:
    """Content of the first meta tag with that name or property; NULL if it is blank."""
    return X.blank_to_null(f"get(filter(metas, m -> lower(m.{key}) = '{value}'), 0).content")


def missing_alts(images: str) -> str:
    return f"filter({images}, i -> {X.is_blank('i.alt')})"


def _hrefs(tags: str = "tags") -> str:
    stripped = f"transform({H.of_kind(tags, 'a')}, t -> {X.strip(H.attr('t', 'href'))})"
    return f"filter({stripped}, h -> h is not null and {U.is_page_href('h')})"


def _links() -> str:
    resolved = f"transform(hrefs, h -> {U.resolve_url('base', 'h')})"
    return f"coalesce(filter({resolved}, u -> u is not null), {NO_STRINGS})"


def page_links(fetches: DataFrame) -> DataFrame:
    """Only what a crawl needs of each page: its resolvable links in order, with repeats."""
    kept = [c for c in fetches.columns if c != "html"]
    return (
        fetches.selectExpr(*kept, f"{H.dom(H.source_text('html'))} as dom")
        .selectExpr(*kept, f"{H.fact_tags('dom')} as tags", f"{U.base_parts('final_url')} as base")
        .selectExpr(*kept, f"{_hrefs()} as hrefs", "base")
        .selectExpr(*kept, f"{_links()} as links")
    )


def _tags(df: DataFrame, kept: tuple[str, ...] = ()) -> DataFrame:
    """Tags and texts. Of broken pages with a body only the tags are read, for their links."""
    carried = (*CARRIED, *kept)
    df = df.selectExpr(*carried, f"{LIVE} as live", f"if({X.filled('html')}, {H.source_text('html')}, null) as page")
    df = df.selectExpr("*", f"{H.dom('page')} as page_dom")
    df = df.selectExpr("*", "if(live, page, null) as src", "if(live, page_dom, null) as dom")
    df = df.selectExpr(
        *carried,
        "live",
        "dom",
        *_named(
            {
                "src_bytes": "cast(octet_length(src) as bigint)",
                "json_ld": H.json_ld_texts("src"),
                "title_text": H.title_text("dom"),
                "headings": H.headings("dom"),
                "all_tags": H.fact_tags("page_dom"),
                "visible_text": H.visible_text("dom"),
                "base": U.base_parts("final_url"),
                "seed_host": U.host("seed_url"),
            }
        ),
    )
    return df.selectExpr("*", "if(live, all_tags, null) as tags")


def _elements(df: DataFrame) -> DataFrame:
    meta = ", ".join(f"'{a}', {H.attr('t', a)}" for a in ("name", "property", "content"))
    address = ", ".join(
        [X.blank_to_null(H.attr("t", a)) for a in H.IMAGE_SOURCES]
        + [H.first_srcset_url(H.attr("t", "srcset"))]
    )
    images = f"transform({H.of_kind('tags', 'i')}, t -> named_struct('src', coalesce({address}), 'alt', {H.attr('t', 'alt')}))"
    links = f"transform({H.of_kind('tags', 'l')}, t -> named_struct('rel', {H.attr('t', 'rel')}, 'href', {X.strip(H.attr('t', 'href'))}))"
    html_tag = f"get({H.of_kind('tags', 'h')}, 0)"
    return df.selectExpr(
        "* except (tags, all_tags, headings)",
        *_named(
            {
                "source_sets": H.picture_sources("dom", "tags"),
                "metas": f"transform({H.of_kind('tags', 'm')}, t -> named_struct({meta}))",
                "hrefs": _hrefs("all_tags"),
                "img_tags": images,
                "canonical_href": f"get(filter({links}, l -> l.href <> '' and"
                f" array_contains({X.split_blank('lower(l.rel)')}, 'canonical')), 0).href",
                "own_lang": H.attr(html_tag, "lang"),
                "xml_lang": H.attr(html_tag, "xml:lang"),
            }
        ),
        *[f"coalesce({H.level('headings', n)}, {NO_STRINGS}) as h{n}" for n in LEVELS],
    )


def _values(df: DataFrame) -> DataFrame:
    src = f"coalesce({U.resolve_url('base', 'i.src')}, i.src)"
    images = (
        "filter(concat(img_tags, transform(source_sets, s ->"
        f" named_struct('src', {H.first_srcset_url('s')}, 'alt', cast(null as string)))), i -> i.src is not null)"
    )
    return df.selectExpr(
        "* except (metas, hrefs, img_tags, source_sets, own_lang, xml_lang, visible_text)",
        *_named(
            {
                "links": _links(),
                "all_images": f"transform({images}, i -> named_struct('src', {src}, 'alt', i.alt))",
                "og_title": _meta("property", "og:title"),
                "twitter_title": _meta("name", "twitter:title"),
                "own_description": _meta("name", "description"),
                "og_description": _meta("property", "og:description"),
                "twitter_description": _meta("name", "twitter:description"),
                "robots_meta": f"coalesce({_meta('name', 'robots')}, {_meta('name', 'googlebot')})",
                "has_viewport": "coalesce(exists(metas, m -> coalesce(lower(m.name), '') = 'viewport'), false)",
                "lang": X.blank_to_null("coalesce(nullif(own_lang, ''), xml_lang)"),
                "word_count": f"coalesce({X.word_count('visible_text')}, 0)",
                "text_length": "coalesce(length(visible_text), 0)",
            }
        ),
    )


def _unique_images(df: DataFrame) -> DataFrame:
    """``images``: those whose address was not seen earlier on the page.

    Sorted by address and place, the first of each address follows another one; sorted
    by place again, the page's order is back. Both arrays are columns of their own.
    """
    entries = "transform(all_images, (i, n) -> named_struct('src', i.src, 'n', n, 'alt', i.alt))"
    first = "filter(by_address, (e, k) -> k = 0 or e.src <> get(by_address, k - 1).src)"
    placed = f"array_sort(transform({first}, e -> named_struct('n', e.n, 'src', e.src, 'alt', e.alt)))"
    return df.selectExpr("* except (all_images)", f"array_sort({entries}) as by_address").selectExpr(
        "* except (by_address)",
        f"coalesce(transform({placed}, e -> named_struct('src', e.src, 'alt', e.alt)), {NO_IMAGES}) as images",
    )


def _decisions(df: DataFrame) -> DataFrame:
    internal = f"{U.normal_host('u')} = seed_host"
    # The page source ends here: rows that wait for the Python stage don't carry it.
    df = _unique_images(df).selectExpr(
        "* except (dom)", f"if(live and word_count between 40 and 79, {H.has_app_root('dom')}, false) as app_root"
    )
    df = df.withColumn("ld", F.when(F.size("json_ld") > 0, json_ld_types(F.col("json_ld"))))
    df = df.selectExpr(
        "* except (json_ld, ld, canonical_href, base)",
        *_named(
            {
                "inside": f"filter(links, u -> live and {internal})",
                "outside": f"filter(links, u -> live and not {internal})",
                "canonical": f"coalesce({U.resolve_url('base', 'canonical_href')}, canonical_href)",
                "title": "coalesce(title_text, og_title, twitter_title)",
                "title_source": "case when title_text is not null then 'title'"
                " when og_title is not null then 'og:title'"
                " when twitter_title is not null then 'twitter:title' end",
                "meta_description": "coalesce(own_description, og_description, twitter_description)",
                "meta_description_source": "case when own_description is not null then 'description'"
                " when og_description is not null then 'og:description'"
                " when twitter_description is not null then 'twitter:description' end",
                "has_json_ld": "coalesce(ld.parsed, false)",
                "schema_types": f"coalesce(ld.types, {NO_STRINGS})",
                "json_ld_scripts": X.size0("json_ld"),
            }
        ),
    )
    df = df.selectExpr(
        "* except (inside, outside)",
        f"coalesce(array_distinct(inside), {NO_STRINGS}) as internal_links",
        f"coalesce(array_distinct(outside), {NO_STRINGS}) as external_links",
        f"{X.size0('inside')} as internal_link_occurrences",
        f"{X.size0('outside')} as external_link_occurrences",
        "size(images) as image_count",
    )
    return df.selectExpr(
        "* except (app_root)",
        "case when not live or size(h1) + size(images) + size(internal_links) > 0 then false"
        " when word_count < 40 then true else app_root end as likely_js_shell",
    )


def _signals() -> str:
    signals = {
        "title_length": "coalesce(length(title), 0)",
        "meta_description_length": "coalesce(length(meta_description), 0)",
        **{f"h{n}_count": f"size(h{n})" for n in LEVELS},
        "heading_count": " + ".join(f"size(h{n})" for n in LEVELS),
        "image_count": "image_count",
        "images_missing_alt": f"size({missing_alts('images')})",
        "unique_internal_links": "size(internal_links)",
        "unique_external_links": "size(external_links)",
        "internal_link_occurrences": "internal_link_occurrences",
        "external_link_occurrences": "external_link_occurrences",
        "word_count": "word_count",
        "text_length": "text_length",
        "schema_type_count": "size(schema_types)",
        "has_canonical": X.filled("canonical"),
        "has_robots_meta": X.filled("robots_meta"),
        "has_viewport": "has_viewport",
        "has_lang": X.filled("lang"),
        "js_rendered": "js_rendered",
        "likely_js_shell": "likely_js_shell",
    }
    return "named_struct(" + ", ".join(f"'{k}', {v}" for k, v in signals.items()) + ")"


def _warnings() -> str:
    def flag(condition: str, name: str) -> str:
        return f"if({condition}, {lit(name)}, null)"

    return "array_compact(array(" + ", ".join(
        [
            flag("title_source = 'og:title'", "title_fallback_og"),
            flag("title_source = 'twitter:title'", "title_fallback_twitter"),
            flag("meta_description_source = 'og:description'", "meta_description_fallback_og"),
            flag("meta_description_source = 'twitter:description'", "meta_description_fallback_twitter"),
            flag("json_ld_scripts > 0 and not has_json_ld", "json_ld_present_but_unparsed"),
            flag("likely_js_shell", "likely_js_shell"),
        ]
    ) + "))"


def _final(df: DataFrame, kept: tuple[str, ...] = ()) -> DataFrame:
    computed = {
        "content_length": "if(live, greatest(coalesce(content_length, 0), src_bytes), coalesce(content_length, 0))",
        "redirect_chain": f"transform(coalesce(redirect_chain, cast(array() as {HOPS})), h -> h.url)",
        "is_broken": "not live",
        "error": f"case when live then null when {X.filled('error')} then error"
        " else concat('HTTP ', coalesce(cast(status_code as string), 'None')) end",
        "extraction_warnings": _warnings(),
        "seo_signals": f"if(live, {_signals()}, null)",
    }
    return df.selectExpr(
        *KEYS, *[f"{computed.get(f, f)} as {f}" for f in PAGE_FIELDS], *HELPERS, *kept
    )


def page_facts(fetches: DataFrame, *kept: str) -> DataFrame:
    """All facts of every page, and the columns ``kept`` of its record. Broken and empty pages keep their fetch fields only."""
    return _final(_decisions(_values(_elements(_tags(page_fetches(fetches), kept)))), kept)


def staged_pages(fetches: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Page facts, and the fetch records without the page source, from one pass over the pages.

    Records of pages are written beside their facts, so whoever reads them later does not build the
    page sources again; those of external probes are no pages and stay as they are.
    """
    fields = [c for c in fetches.columns if c != "html"]
    with_record = fetches.withColumn("record", F.struct(*fields))
    staged = stage(page_facts(with_record, "record"), "page_facts")
    others = fetches.filter("not coalesce(depth >= 0, false)").select(*fields)
    return staged.drop("record"), staged.select("record.*").unionByName(others)
