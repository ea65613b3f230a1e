"""Crawl logic over pages that are already fetched: frontier, budget, statistics, external links."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from crawlsight.config import AuditOptions
from crawlsight.functions import text as X
from crawlsight.functions import url as U
from crawlsight.functions.sql import lit
from crawlsight.operators.facts import page_links
from crawlsight.operators.robots import BLOCKED, gate
from crawlsight.schema import HOPS
from crawlsight.session import stage, stage_clustered
from crawlsight.sources.fetches import BROKEN

SITE = ("audit_id", "seed_url")
# Pages whose links one task numbers.
_CHUNK = 4096


def _with_links(pages: DataFrame) -> DataFrame:
    """Pages with their ``links``: page facts have them already, fetch records are parsed."""
    if "links" in pages.columns:
        return pages.filter("depth >= 0")
    return page_links(pages.filter(f"depth >= 0 and {X.filled('html')}"))


def link_edges(pages: DataFrame) -> DataFrame:
    """Every link of every page (fetch records or page facts) with its place, against the final address.

    The outer form of explode keeps the optimizer from testing the link list a
    second time in front of the page parsing.
    """
    return (
        _with_links(pages)
        .selectExpr("audit_id", "page_ord as src_ord", "url as src", "posexplode_outer(links) as (pos, dst)")
        .filter("dst is not null")
    )


def _numbered(df: DataFrame, order: str, lead: str, k: int) -> DataFrame:
    """The first ``k`` rows of each site with their rank in ``order``.

    ``lead`` is the page number that the order begins with. Rows are numbered by chunks
    of pages: within a chunk, and by the sizes of the chunks before. No task ever holds
    all rows of a site, whatever ``k`` is.
    """
    df = df.withColumn("chunk", F.expr(f"{lead} div {_CHUNK}"))
    earlier = W.partitionBy(*SITE).orderBy("chunk").rowsBetween(W.unboundedPreceding, -1)
    sizes = (
        df.groupBy(*SITE, "chunk")
        .agg(F.count("*").alias("n"))
        .withColumn("before", F.coalesce(F.sum("n").over(earlier), F.lit(0)))
        .filter(F.col("before") < k)
        .drop("n")
    )
    within = F.row_number().over(W.partitionBy(*SITE, "chunk").orderBy(order))
    return (
        df.withColumn("rn", within)
        .join(sizes, [*SITE, "chunk"])
        .withColumn("rank", F.expr("rn + before"))
        .drop("rn", "before", "chunk")
        .filter(F.col("rank") <= k)
    )


def _page_keys(shared: bool) -> list[str]:
    return ["url"] if shared else ["audit_id", "url"]


def _chosen(fetches: DataFrame, shared: bool) -> DataFrame:
    """The record of each page that a crawl sees: ``from_audit`` and ``from_ord`` by page key.

    Of several the last one counts, by audit and place.
    """
    last = fetches.filter("depth >= 0").groupBy(*_page_keys(shared)).agg(F.max(F.struct("audit_id", "page_ord")).alias("c"))
    return last.select(*_page_keys(shared), F.col("c.audit_id").alias("from_audit"), F.col("c.page_ord").alias("from_ord"))


def frontier(
    seeds: DataFrame,
    fetches: DataFrame,
    options: AuditOptions | None = None,
    host_rules: DataFrame | None = None,
    shared: bool = False,
) -> DataFrame:
    """Breadth-first crawl of every site over a table of fetched pages.

    Each audit sees its own pages. With ``shared`` the pages of all audits are one pool,
    where a URL stands for its last record. ``fetches`` are fetch records, or page facts of them, which
    saves parsing the pages again.

    Returns the records in crawl order: site, url, depth, page_ord, whether robots
    rules allow it and whether the page is in ``fetches``; pages allowed but not
    fetched are the worklist of the fetcher. A page is queued at its first sight,
    keyed by requested address. Each level is one join of the frontier with the
    link table, written to the staging folder, so at most ``max_depth`` rounds. The link table is
    clustered by linking page once, so a level moves its own pages only, never the links.

    The queue order of a level is the place of the linking page and the position of
    the link on it; a page linked several times keeps the first.
    """
    options = options or AuditOptions()
    known = stage(_chosen(fetches, shared), "known")
    of_chosen = F.expr("src_audit = from_audit and src = url and src_ord = from_ord")
    mine = known.select("url", "from_audit", "from_ord")
    found = link_edges(fetches).withColumnRenamed("audit_id", "src_audit").join(mine, of_chosen, "left_semi")
    edges = stage_clustered(found, "edges", ["src"] if shared else ["src_audit", "src"])
    level = seed_queue(seeds)
    seen = records = None
    for depth in range(options.max_depth + 1):
        done = stage(admitted(level.withColumn("depth", F.lit(depth)), records, options, host_rules), f"level-{depth}")
        records = done if records is None else records.unionByName(done)
        if depth == options.max_depth or done.isEmpty():
            break
        found = expanded(done, edges, options, shared)
        queued = level.select(*SITE, "url")
        seen = queued if seen is None else seen.unionByName(queued)
        level = stage(
            found.groupBy(*SITE, "url").agg(F.min("ord").alias("ord")).join(seen, [*SITE, "url"], "left_anti"),
            f"queue-{depth + 1}",
        )
    return records.join(known, _page_keys(shared), "left").selectExpr(
        *SITE, "url", "depth", "page_ord", "allowed", "from_ord is not null as fetched"
    )


def admitted(queue: DataFrame, records: DataFrame | None, options: AuditOptions, host_rules: DataFrame | None) -> DataFrame:
    """The rows of a queue that the page budget still admits after ``records``, with their place and the robots gate.

    ``queue`` has one depth per site and the place ``ord`` in it.
    """
    ranked = _numbered(queue, "ord", "ord.parent_ord", options.max_pages)
    if records is not None:
        used = records.groupBy(*SITE).agg(F.count("*").alias("used"))
        ranked = ranked.join(used, [*SITE], "left")
    else:
        ranked = ranked.withColumn("used", F.lit(0))
    ranked = ranked.filter(f"rank + coalesce(used, 0) <= {options.max_pages}").selectExpr(
        *SITE, "url", "depth", "cast(rank + coalesce(used, 0) - 1 as bigint) as page_ord"
    )
    if options.respect_robots and host_rules is not None:
        return gate(ranked, host_rules)
    return ranked.withColumn("allowed", F.lit(True))


def seed_queue(seeds: DataFrame) -> DataFrame:
    """The queue that a crawl begins with."""
    return seeds.selectExpr("audit_id", "seed_url", f"{U.normalize_url('seed_url')} as url", "struct(0L as parent_ord, 0 as pos) as ord")


def expanded(level: DataFrame, edges: DataFrame, options: AuditOptions, shared: bool = False) -> DataFrame:
    """The links of a level's pages with their place in the queue; ``edges`` is clustered by linking page."""
    linked = F.expr("url = src" if shared else "url = src and audit_id = src_audit")
    found = (
        level.filter("allowed")
        .join(edges, linked)
        .selectExpr(*SITE, "dst as url", "struct(page_ord as parent_ord, pos) as ord")
    )
    return found.filter(U.same_host("seed_url", "url")) if options.same_host_only else found


def crawl_records(frontier_rows: DataFrame, fetches: DataFrame, shared: bool = False) -> DataFrame:
    """Fetch records of a crawl, one per frontier row: blocked pages get their synthetic record.

    ``shared`` as in ``frontier``.
    """
    body = fetches.filter("depth >= 0").selectExpr(
        "audit_id as from_audit", "page_ord as from_ord", "url as from_url", "final_url", "status_code", "html",
        "content_length", "redirect_chain", "error", "elapsed_ms", "js_rendered",
    )
    rows = frontier_rows.filter("fetched or not allowed").join(_chosen(fetches, shared), _page_keys(shared), "left")
    rows = rows.join(
        body.withColumnsRenamed({"from_audit": "a", "from_ord": "o"}), F.expr("from_audit = a and from_ord = o and url = from_url"), "left"
    )

    def unless_blocked(column: str, blocked: str) -> str:
        return f"if(allowed, {column}, {blocked}) as {column}"

    return rows.selectExpr(
        *SITE,
        "url",
        unless_blocked("final_url", "url"),
        unless_blocked("status_code", "403"),
        unless_blocked("html", "null"),
        unless_blocked("content_length", "0L"),
        unless_blocked("redirect_chain", f"cast(array() as {HOPS})"),
        unless_blocked("error", lit(BLOCKED)),
        "depth",
        unless_blocked("elapsed_ms", "0D"),
        unless_blocked("js_rendered", "false"),
        "page_ord",
    )


def crawl_stats(
    records: DataFrame, options: AuditOptions | None = None, facts: DataFrame | None = None
) -> DataFrame:
    """Crawled, discovered, broken and redirected counts of each site.

    Discovered are the seed and every link of a page that was expanded, external
    links included. Error texts are rows of ``crawl_errors``.
    """
    options = options or AuditOptions()
    pages = records.filter("depth >= 0")
    counts = pages.groupBy(*SITE).agg(
        F.count("*").alias("pages_crawled"),
        F.expr(f"count_if({BROKEN}) as broken_count"),
        F.expr("count_if(size(redirect_chain) > 0) as redirect_count"),
        F.expr(f"count_if({_TRANSPORT_ERROR}) as error_count"),
    )
    expanded = (pages if facts is None else facts).filter(f"depth < {options.max_depth}")
    links = _with_links(expanded).selectExpr(*SITE, "explode_outer(links) as url").filter("url is not null")
    seeds = pages.selectExpr(*SITE, f"coalesce({U.normalize_url('seed_url')}, seed_url) as url")
    discovered = (
        links.union(seeds).distinct().groupBy(*SITE).agg(F.count("*").alias("pages_discovered"))
    )
    return counts.join(discovered, [*SITE])


_TRANSPORT_ERROR = f"({X.filled('error')} and error <> {lit(BLOCKED)})"


def crawl_errors(records: DataFrame) -> DataFrame:
    """``url: error`` lines in crawl order; HTTP statuses and robots blocks are no errors here."""
    return records.filter(f"depth >= 0 and {_TRANSPORT_ERROR}").selectExpr(
        *SITE, "page_ord", "concat(url, ': ', error) as line"
    )


def external_worklist(records: DataFrame, cap: int | None = None) -> DataFrame:
    """Distinct off-host links of each site in first-seen order, at most ``cap``.

    ``records`` are fetch records, or page facts of them.
    """
    cap = AuditOptions().max_external_checks if cap is None else cap
    links = (
        _with_links(records)
        .selectExpr(*SITE, "page_ord", "posexplode_outer(links) as (pos, url)")
        .filter("url is not null")
        .filter(f"not {U.same_host('seed_url', 'url')}")
    )
    first = links.groupBy(*SITE, "url").agg(F.min(F.struct("page_ord", "pos")).alias("first_ord"))
    return _numbered(first, "first_ord", "first_ord.page_ord", cap).selectExpr(*SITE, "url", "rank")


def broken_probes(worklist: DataFrame, probes: DataFrame) -> DataFrame:
    """Fetch records at depth -1 for the probed links that failed."""
    hit = worklist.join(probes, "url").filter(f"{X.filled('error')} or status_code >= 400")
    return hit.selectExpr(
        *SITE,
        "url",
        "url as final_url",
        "0 as status_code",
        "cast(null as string) as html",
        "0L as content_length",
        f"cast(array() as {HOPS}) as redirect_chain",
        f"if({X.filled('error')}, error, concat('HTTP ', status_code)) as error",
        "-1 as depth",
        "0D as elapsed_ms",
        "false as js_rendered",
        "cast(rank as bigint) as page_ord",
    )
