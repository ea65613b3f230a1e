"""Scores, metrics and totals of audits that are kept up to date while pages arrive.

Each batch of fetch records leaves three small tables of partial aggregates, which add up:

* ``figures``: a row per audit with counts and sums over the batch's pages and failed probes,
* ``titles``: a row per audit and title with how many live pages have it, and the first,
* ``types``: a row per audit and structured-data type with its pages.

Scores, metrics and totals are read from these tables alone; no page is read again. A batch
writes its own folder, whose last table completes it, so a batch that is repeated, or was cut
short, counts once. ``fold`` adds the batches up into one base, which remembers the last
batch it holds; a batch up to that one is not written again. Readers take the newest whole base
and the whole batches after it, so folding may stop anywhere.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from crawlsight.config import AuditOptions
from crawlsight.functions import text as X
from crawlsight.operators import metrics as M
from crawlsight.operators.checks import AUDIT, LENGTH_SUMS, SITEMAP_SEEN, CheckRegistry, titled_pages
from crawlsight.operators.facts import page_facts
from crawlsight.operators.score import with_score
from crawlsight.schema import SEVERITIES
from crawlsight.session import stage
from crawlsight.sources.fetches import USABLE, broken_probe_fetches

TABLES = ("figures", "titles", "types")
# Metrics that aren't sums over pages, from sums.
_RATIOS = {
    "title__avg_title_length": X.round1("coalesce(try_divide(sum_title, title__pages_with_title), 0D)"),
    "meta_description__avg_meta_description_length": X.round1(
        "coalesce(try_divide(sum_meta_description, meta_description__pages_with_meta_description), 0D)"
    ),
    "image_alt__alt_coverage_pct": X.round1(
        "coalesce(try_divide(100 * (image_alt__images_total - image_alt__missing_alt), image_alt__images_total), 100D)"
    ),
}
_CONSTANTS = ("page_size__threshold",)


def _metrics(options: AuditOptions) -> dict[str, str]:
    """The metrics of the built-in checks that are sums over pages, by column."""
    found = {f"{c.name}__{m}": sql for c in CheckRegistry().checks for m, sql in c.metrics(options).items()}
    return {name: sql for name, sql in found.items() if name not in _RATIOS}


def partials(fetches: DataFrame, facts: DataFrame, options: AuditOptions) -> dict[str, DataFrame]:
    """The three tables of one batch, from its fetch records and their page facts."""
    rules = [r for c in CheckRegistry().checks for r in c.page_rules(options)]
    severities = {s: " + ".join(r.count() for r in rules if r.severity == s) or "0" for s in SEVERITIES}
    sums = (
        {s: f"coalesce(sum(cast({sql} as bigint)), 0)" for s, sql in severities.items()}
        | _metrics(options)
        | {f"total__{k}": sql for k, sql in M.total_figures().items()}
        | {f"sum_{k}": sql for k, sql in LENGTH_SUMS.items()}
    )
    pages = facts.groupBy(*AUDIT).agg(F.count("*").alias("pages"), *(F.expr(sql).alias(k) for k, sql in sums.items()))
    probes = broken_probe_fetches(fetches).groupBy(*AUDIT).agg(F.count("*").alias("probes"))
    records = fetches.groupBy(*AUDIT).agg(F.expr(f"bool_or({SITEMAP_SEEN}) as seen"))
    figures = records.join(pages, [*AUDIT], "left").join(probes, [*AUDIT], "left").fillna(0)
    first = F.min(F.struct("page_ord", "final_url")).alias("first")
    return {
        "figures": figures,
        "titles": titled_pages(facts).groupBy(*AUDIT, "title_key").agg(F.count("*").alias("n"), first),
        "types": M.schema_types(facts),
    }


def added(tables: dict[str, DataFrame]) -> dict[str, DataFrame]:
    """Partial aggregates of several batches as those of one."""
    figures = tables["figures"]
    sums = [c for c in figures.columns if c not in (*AUDIT, "seen", *_CONSTANTS)]
    return {
        "figures": figures.groupBy(*AUDIT).agg(
            F.bool_or("seen").alias("seen"), *(F.max(c).alias(c) for c in _CONSTANTS), *(F.sum(c).alias(c) for c in sums)
        ),
        "titles": tables["titles"].groupBy(*AUDIT, "title_key").agg(F.sum("n").alias("n"), F.min("first").alias("first")),
        "types": tables["types"].groupBy(*AUDIT, "schema_type").agg(F.sum("pages").alias("pages")),
    }


def _folders(spark: SparkSession, root: str) -> tuple[int, list[str], list[str]]:
    """The last batch of the newest whole base, the whole folders to read, and all other folders."""
    place = spark._jvm.org.apache.hadoop.fs.Path(root)
    files = place.getFileSystem(spark._jsc.hadoopConfiguration())
    names = [f.getPath().getName() for f in files.listStatus(place)] if files.exists(place) else []

    def whole(name: str) -> bool:
        return files.exists(spark._jvm.org.apache.hadoop.fs.Path(f"{root}/{name}/{TABLES[-1]}/_SUCCESS"))

    numbers = {n: int(n.split("=")[1]) for n in names if n.startswith(("base=", "batch="))}
    base = max((k for n, k in numbers.items() if n.startswith("base=") and whole(n)), default=-1)
    read = [f"base={base}"] if base >= 0 else []
    read += [n for n in sorted(numbers, key=numbers.get) if n.startswith("batch=") and numbers[n] > base and whole(n)]
    return base, read, [n for n in numbers if n not in read and numbers[n] <= base]


def write_batch(fetches: DataFrame, batch_id: int, root: str, options: AuditOptions | None = None) -> bool:
    """Adds one batch of fetch records; tells if it was new. The same batch may come again."""
    spark = fetches.sparkSession
    if batch_id <= _folders(spark, root)[0]:
        return False
    usable = fetches.filter(USABLE)
    facts = stage(page_facts(usable), "arrived_facts")
    tables = partials(usable.drop("html"), facts, options or AuditOptions())
    for name in TABLES:
        tables[name].write.mode("overwrite").parquet(f"{root}/batch={batch_id}/{name}")
    return True


def current(spark: SparkSession, root: str) -> dict[str, DataFrame]:
    """The three tables over all batches so far."""
    _, read, _ = _folders(spark, root)
    if not read:
        raise FileNotFoundError(f"no batch in {root}")
    parts = [{t: spark.read.parquet(f"{root}/{n}/{t}") for t in TABLES} for n in read]
    return added({t: reduce(DataFrame.unionByName, [p[t] for p in parts]) for t in TABLES})


def fold(spark: SparkSession, root: str) -> int:
    """Adds all batches up into one base, then drops what went into it; the number of the last batch."""
    _, read, _ = _folders(spark, root)
    last = max((int(n.split("=")[1]) for n in read), default=-1)
    if len(read) > 1:
        tables = current(spark, root)
        for name in TABLES:
            tables[name].write.mode("overwrite").parquet(f"{root}/base={last}/{name}")
    _, _, old = _folders(spark, root)
    for name in old:
        place = spark._jvm.org.apache.hadoop.fs.Path(f"{root}/{name}")
        place.getFileSystem(spark._jsc.hadoopConfiguration()).delete(place, True)
    return last


def _with_titles(tables: dict[str, DataFrame]) -> DataFrame:
    doubled = tables["titles"].filter("n > 1").groupBy(*AUDIT).agg(F.count("*").alias("title__duplicates"))
    return tables["figures"].join(doubled, [*AUDIT], "left").fillna(0, ["title__duplicates"])


def scores(tables: dict[str, DataFrame], options: AuditOptions | None = None) -> DataFrame:
    """Counts, penalty and score of each audit, as ``score_sites`` gives them for all its pages."""
    counts = _with_titles(tables).selectExpr(
        *AUDIT, "pages", "critical", "warning + probes + title__duplicates as warning", "info + if(seen, 0, 1) as info"
    )
    return with_score(counts, (options or AuditOptions()).scoring)


def check_metrics(tables: dict[str, DataFrame]) -> DataFrame:
    """Metrics per check in long form, as ``metrics.check_metrics`` gives them for all pages."""
    types = tables["types"].groupBy(*AUDIT).agg(F.count("*").alias("schema__unique_schema_types"))
    rows = _with_titles(tables).join(types, [*AUDIT], "left").fillna(0, ["schema__unique_schema_types"])
    more = {
        "links__broken_external_links": "probes",
        "links__broken": "links__broken_pages + probes",
        "sitemap__sitemap_observed": "cast(seen as int)",
    }
    named = [c for c in rows.columns if "__" in c and not c.startswith("total__")]
    wide = rows.filter("pages > 0").selectExpr(*AUDIT, *named, *(f"{sql} as {c}" for c, sql in (_RATIOS | more).items()))
    return M.long_metrics(wide)


def totals(tables: dict[str, DataFrame]) -> DataFrame:
    """Structured totals of each audit, as ``metrics.structured_totals`` gives them for all pages."""
    rows = tables["figures"].filter("pages > 0")
    return rows.selectExpr(*AUDIT, *(f"total__{c} as {c}" for c in M.total_figures()))


def duplicate_titles(tables: dict[str, DataFrame]) -> DataFrame:
    """Titles of more than one page so far: how many pages, and the first one."""
    return tables["titles"].filter("n > 1").selectExpr(*AUDIT, "title_key", "n", "first.page_ord as page_ord", "first.final_url as first_url")


def keep_figures(
    arrivals: DataFrame, root: str, checkpoint: str, options: AuditOptions | None = None, fold_every: int = 50, available_now: bool = True
) -> StreamingQuery:
    """Adds every batch of a stream of fetch records, and folds now and then."""

    def each(batch: DataFrame, batch_id: int) -> None:
        write_batch(batch, batch_id, root, options)
        if batch_id % fold_every == fold_every - 1:
            fold(batch.sparkSession, root)

    writer = arrivals.writeStream.foreachBatch(each).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if available_now else writer).start()
