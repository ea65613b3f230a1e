"""Inputs of the registered queries, derived by Spark from the given tables.

``pages`` holds plain pages only, so a second crawl of the same pages adds the
markup they lack. What is added follows from the page id and the document of the
same number; the SQL twins compute the expected facts from those, without parsing.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from crawlsight.functions import url as U
from crawlsight.sources.fetches import normalize_fetches, pages_as_fetches


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "pages")


def plain_fetches(spark: SparkSession, sf_dir: str) -> DataFrame:
    """First crawl: the pages as they are."""
    return pages_as_fetches(pages(spark, sf_dir), "a")


def escaped(x: str) -> str:
    return f"replace(replace(replace({x}, '&', '&amp;'), '\"', '&quot;'), '<', '&lt;')"


_HEAD = """concat(
 case when p % 12 = 0 then concat('<meta property="og:description" content="Open graph description number ', p, '">')
      when p % 4 = 0 then ''
      when p % 3 = 0 then concat('<meta name="Description" content="', doc, '">')
      else concat('<meta content=''', repeat('d', cast(60 + p % 120 as int)), ''' name=description >') end,
 if(p % 3 = 0, concat('<link rel="alternate canonical" href="/c/', p, '/">'), ''),
 case p % 5 when 0 then '<meta name="robots" content="NoIndex, nofollow">'
            when 1 then '<META NAME="ROBOTS" CONTENT="index">'
            when 2 then '<meta name="GoogleBot" content="noarchive">' else '' end,
 if(p % 12 = 8, concat('<meta name="twitter:description" content="Short &#146;n&#x27; sweet, number ', p, '">'), ''),
 case p % 8 when 0 then '<script type="application/ld+json">{"@context":"https://schema.org","@type":"Article","author":{"@type":"Person"}}</script>'
            when 1 then '<script type="application/ld+json">{"name":"x"}</script>'
            when 2 then '<script type="application/ld+json">[{"@type":["Product","Thing",],/* c */}]</script>'
            when 3 then '<script type="application/ld+json">{broken</script>' else '' end,
 if(p % 2 = 0, '<meta name="viewport" content="width=device-width">', ''),
 if(p % 18 = 4, concat('<meta property="og:title" content="Open graph title of page ', p, '">'), ''),
 if(p % 36 = 13, concat('<meta name="twitter:title" content="Twitter title of page ', p, '">'), ''))"""

_BODY = """concat(
 array_join(transform(sequence(0, cast(p % 4 as int)), k -> if(k = 0, '', concat('<img src="/i/', p, '-', k, '.png"',
   if(k <= p % 4 div 2, '', concat(' alt="a', k, '"')), '>'))), ''),
 if(p % 4 = 3, concat('<img alt="again" src=/i/', p, '-1.png>'), ''),
 case p % 6 when 1 then '<h2>Second</h2>' when 2 then '<h2>Second</h2><h3>Third</h3>'
   when 3 then '<h3>Third &amp; last</h3>' when 4 then '<h2> &nbsp; </h2>' when 5 then '<h3>Third</h3><h3>Other</h3>' else '' end,
 if(p % 7 = 0, '<h1>Extra <b>head</b></h1>', ''),
 if(p % 14 = 3, '<h4>Open &check;<p>not part of it</p>', ''),
 repeat(concat('<a href="https://ext', p % 5, '.example.org/x/">out</a>'), cast(p % 9 as int)),
 '<a href="mailto:a@b.example">m</a><a href="#top">t</a>')"""


def rich_raw_fetches(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Second crawl of the same pages, as a fetcher would hand it over.

    Only descriptions of the third kind in ``_HEAD`` hold a document, so no other text goes to the join.
    """
    docs = table(spark, sf_dir, "documents").selectExpr(
        "doc_id as page_id", "if(doc_id % 3 = 0 and doc_id % 4 <> 0, text, null) as text", "lang"
    )
    rows = (
        pages(spark, sf_dir)
        .join(docs, "page_id", "left")
        .selectExpr(
            "page_id as p", f"{U.normalize_url('url')} as url", "html", "lang", f"{escaped('text')} as doc"
        )
        .selectExpr("*", f"{U.origin('url')} as o", f"{_HEAD} as head", f"{_BODY} as body")
        .selectExpr(
            "p", "url", "o", "head", "body",
            "case when p % 9 = 4 then regexp_replace(html, '<title>[^<]*</title>', '<title> </title>')"
            " when p % 6 = 1 then regexp_replace(html, '<title>[^<]*</title>',"
            " concat('<title>Overview of ', lang, ' pages</title>')) else html end as html",
        )
        .selectExpr(
            "p", "url", "o", "head", "body",
            "if(p % 13 = 5, regexp_replace(html, '(</?)h1>', '$1div>'), html) as html",
        )
        .selectExpr(
            "p", "url", "o", "head", "body",
            "if(p % 10 = 9, replace(html, '<a href=\"/', '<a data-href=\"/'), html) as html",
        )
    )
    return rows.selectExpr(
        "concat('b:', o, '/') as audit_id",
        "concat(o, '/') as seed_url",
        "url",
        "if(p % 23 = 7, concat(o, '/sitemap.xml'), url) as final_url",
        "case when p % 19 = 0 then 0 when p % 11 = 0 then 404 else 200 end as status_code",
        "if(p % 17 = 0, '', replace(replace(html, '</head>', concat(head, '</head>')),"
        " '</footer>', concat(body, '</footer>'))) as html",
        "0L as content_length",
        "if(p % 19 = 0, 'timeout', null) as error",
        "0 as depth",
        "0D as elapsed_ms",
        "false as js_rendered",
        "p as page_ord",
        "if(p % 13 = 0, array(named_struct('url', concat('http://old.example/', p), 'status_code', 301)),"
        " cast(array() as array<struct<url:string,status_code:int>>)) as history",
    )


def rich_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return normalize_fetches(rich_raw_fetches(spark, sf_dir))


def probes(worklist: DataFrame) -> DataFrame:
    """Probe answers of the linked hosts: the first is gone, the second unreachable."""
    return worklist.select("url").distinct().selectExpr(
        "url",
        "case when contains(url, '//ext0.') then 404 when contains(url, '//ext1.') then 0 else 200 end as status_code",
        "if(contains(url, '//ext1.'), 'dns failure', null) as error",
    )


def document_fetches(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as pages without headings, images and links; every second has an app root."""
    docs = table(spark, sf_dir, "documents")
    return pages_as_fetches(
        docs.selectExpr(
            "doc_id as page_id",
            "concat('https://', source, '.docs.example/', doc_id) as url",
            "concat('<html><body><div id=', if(doc_id % 2 = 0, '\"App\"', 'main'), '>', "
            f"{escaped('text')}, '</div></body></html>') as html",
        ),
        "d",
    )


SITES = 5


def linked_fetches(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The pages spread over a few sites, each page linking to two later ones (a heap),
    to its parent, to the root of another site, and twice to its first child. The pages' own
    links lead nowhere and are switched off."""
    url = "concat('https://site', {p} % 5, '.example/', {p} div 5)"
    kid = "(5 * (2 * (page_id div 5) + {n}) + page_id % 5)"
    link = "'<a href=\"/', {} div 5, '\">x</a>'"
    return (
        pages(spark, sf_dir)
        .selectExpr(
            "page_id",
            f"{url.format(p='page_id')} as url",
            "replace(replace(html, '<a href=', '<a data-href='), '</footer>', concat("
            + ", ".join(link.format(kid.format(n=n)) for n in (1, 2, 1))
            + ", '<a href=\"', greatest((page_id div 5 - 1) div 2, 0), '\">up</a>',"
            " '<a href=\"https://site', (page_id + 1) % 5, '.example/0\">other</a></footer>')) as html",
        )
        .transform(lambda df: pages_as_fetches(df, "c"))
    )


def link_seeds(fetches: DataFrame) -> DataFrame:
    """Each site starts at its root page."""
    return fetches.select("seed_url").distinct().selectExpr(
        "concat('c:', seed_url) as audit_id", "concat(seed_url, '0') as seed_url"
    )


def robots_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A robots.txt for every host of the pages, chosen by the length of its name."""
    named = "User-agent: crawlsight\\nAllow: /fr/1\\nDisallow: /fr/\\n\\nUser-agent: *\\nDisallow: /"
    default = "# all\\nUser-agent: other\\nUser-agent: *\\nDisallow: /es/ # no\\nDisallow: /de/%31\\n"
    return (
        table(spark, sf_dir, "pages")
        .selectExpr(f"{U.host('url')} as host")
        .distinct()
        .selectExpr(
            "host",
            "if(length(host) % 3 = 2, 404, 200) as status_code",
            "cast(null as string) as error",
            f"if(length(host) % 3 = 0, '{named}', '{default}') as body",
        )
    )


def event_audits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Audit history: every event is an audit of its user's site."""
    return table(spark, sf_dir, "events").selectExpr(
        "cast(event_id as string) as audit_id",
        "concat('https://user', user_id, '.example/') as seed_url",
        "cast(ts as timestamp) as created_at",
        "value as score",
    )


def answers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Model answers made of conversation texts: plain, fenced, malformed and mixed lists."""
    quoted = "to_json(named_struct('improved_title', text, 'keyword_suggestions', array(role, 'k'), 'notes', null), map('ignoreNullFields', 'false'))"
    mixed = (
        "concat('{\"faq_suggestions\":[1,{\"question\":\"Q?\",\"answer\":\"A\"},\"x\"],\"schema_suggestion\":\"WebPage\",',"
        " substr(to_json(named_struct('improved_h1', role)), 2))"
    )
    fence = "'```'"
    return table(spark, sf_dir, "conversations").selectExpr(
        "concat('s:', conv_id) as audit_id",
        "concat('https://chat.example/', conv_id, '/', turn) as url",
        "turn as page_ord",
        f"case (conv_id + turn) % 4 when 0 then {quoted}"
        f" when 1 then concat({fence}, 'json\\n', {quoted}, '\\n', {fence})"
        f" when 2 then concat('Answer: ', text) else {mixed} end as raw",
        "if(role = 'system', 'model refused', null) as error",
    )
