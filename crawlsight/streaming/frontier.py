"""The frontier of crawls whose pages land over time.

Each batch of fetch records makes one step in a folder of its own:

* ``pages``: the addresses that the batch answered first, ``links``: the links of these pages,
* ``records``: the frontier rows that became certain with it, in the form that ``crawl.frontier`` gives,
* ``expanded``: the levels of sites that were turned into the next ones.

A site's level is expanded when all its allowed pages are answered; only then are the places and the budget of
the next level certain. Sites advance on their own, so a slow one holds up no other. A batch may complete several
levels, if their pages came early. Steps are only added; a step's last table completes it, so a batch that is
repeated, or was cut short, counts once. Every page is parsed once, and a level reads the links of those steps
alone that brought its pages; addresses and places of all steps are read at each.

An address stands for the first batch that answers it, and for its last record there. Later answers change nothing.
"""

from __future__ import annotations

from functools import reduce
from typing import NamedTuple

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from crawlsight.config import AuditOptions
from crawlsight.operators import crawl as CR
from crawlsight.operators.crawl import SITE
from crawlsight.session import stage

PAGE = ["audit_id", "url"]
_SCHEMAS = {
    "pages": "audit_id string, url string, from_ord bigint, step bigint",
    "links": "src_audit string, src string, pos int, dst string",
    "expanded": "audit_id string, seed_url string, depth int",
    "records": "audit_id string, seed_url string, url string, depth int, page_ord bigint, allowed boolean",
}


class Advance(NamedTuple):
    records: DataFrame
    expanded: DataFrame


def _steps(spark: SparkSession, root: str) -> list[int]:
    """Numbers of the whole steps."""
    path = spark._jvm.org.apache.hadoop.fs.Path
    files = path(root).getFileSystem(spark._jsc.hadoopConfiguration())
    names = [f.getPath().getName() for f in files.listStatus(path(root))] if files.exists(path(root)) else []
    numbers = sorted(int(n.removeprefix("step=")) for n in names if n.startswith("step="))
    return [k for k in numbers if files.exists(path(f"{root}/step={k}/records/_SUCCESS"))]


def _read(spark: SparkSession, root: str, steps: list[int], table: str) -> DataFrame:
    if not steps:
        return spark.createDataFrame([], _SCHEMAS[table])
    return spark.read.schema(_SCHEMAS[table]).parquet(*(f"{root}/step={k}/{table}" for k in steps))


def _write(df: DataFrame, root: str, step: int, table: str) -> DataFrame:
    names = [f.name for f in df.sparkSession.createDataFrame([], _SCHEMAS[table]).schema]
    df.select(*names).write.mode("overwrite").parquet(f"{root}/step={step}/{table}")
    return _read(df.sparkSession, root, [step], table)


def _advanced(
    root: str, fresh: DataFrame, pages: DataFrame, before: Advance, options: AuditOptions, host_rules: DataFrame | None, wait: bool
) -> Advance:
    """Rows and levels that follow from the answered ``pages``; ``fresh`` are seeds that have no rows yet.

    With ``wait`` a level with an unanswered page stays as it is, else its answered pages are expanded.
    """
    spark = pages.sparkSession
    last = before.records.groupBy(*SITE).agg(F.max("depth").alias("depth"))
    opened = before.records.join(last, [*SITE, "depth"]).join(before.expanded, [*SITE, "depth"], "left_anti")
    queue = CR.seed_queue(fresh).withColumn("depth", F.lit(0))
    first = stage(CR.admitted(queue, None, options, host_rules), "frontier_seeds")
    records, levels = [first], [_read(spark, root, [], "expanded")]
    opened = opened.unionByName(first)
    # A round takes every ready site one level deeper.
    for n in range(options.max_depth):
        level = stage(
            opened.filter(F.col("depth") < options.max_depth).join(pages.select(*PAGE, "step"), PAGE, "left"), f"frontier_open-{n}"
        )
        ready = level.groupBy(*SITE, "depth").agg(F.expr("bool_and(not allowed or step is not null)").alias("whole"))
        ready = stage(ready.filter("whole" if wait else "true").drop("whole"), f"frontier_ready-{n}")
        if ready.isEmpty():
            break
        level = level.join(ready, [*SITE, "depth"], "left_semi")
        steps = sorted(r.step for r in level.filter("step is not null").select("step").distinct().collect())
        found = CR.expanded(level.filter("step is not null"), _read(spark, root, steps, "links"), options)
        known = reduce(DataFrame.unionByName, records, before.records)
        queue = (
            found.groupBy(*SITE, "url").agg(F.min("ord").alias("ord"))
            .join(known, [*SITE, "url"], "left_anti")
            .join(ready.withColumn("depth", F.expr("depth + 1")), [*SITE])
        )
        opened = stage(CR.admitted(queue, known, options, host_rules), f"frontier_level-{n}")
        records.append(opened)
        levels.append(ready)
    return Advance(reduce(DataFrame.unionByName, records), reduce(DataFrame.unionByName, levels))


def _fresh(seeds: DataFrame, records: DataFrame) -> DataFrame:
    return seeds.select(*SITE).distinct().join(records.select(*SITE).distinct(), [*SITE], "left_anti")


def write_batch(
    fetches: DataFrame, seeds: DataFrame, batch_id: int, root: str,
    options: AuditOptions | None = None, host_rules: DataFrame | None = None,
) -> bool:
    """Advances the frontier by one batch of fetch records; tells if it was new. The same batch may come again.

    ``seeds`` may gain rows from batch to batch, and a batch may be empty: that starts the crawls. Records without
    an address and probes (depth below 0) are left out.
    """
    options = options or AuditOptions()
    spark = fetches.sparkSession
    steps = _steps(spark, root)
    if steps and batch_id <= steps[-1]:
        return False
    earlier = _read(spark, root, steps, "pages")
    chosen = fetches.filter("depth >= 0 and url is not null").groupBy(*PAGE).agg(F.max("page_ord").alias("from_ord"))
    fresh_pages = chosen.join(earlier, PAGE, "left_anti").withColumn("step", F.lit(batch_id).cast("bigint"))
    answered = _write(fresh_pages, root, batch_id, "pages")
    of_chosen = F.expr("src_audit = audit_id and src = url and src_ord = from_ord")
    links = CR.link_edges(fetches).withColumnRenamed("audit_id", "src_audit").join(answered, of_chosen, "left_semi")
    _write(links, root, batch_id, "links")
    before = Advance(_read(spark, root, steps, "records"), _read(spark, root, steps, "expanded"))
    step = _advanced(root, _fresh(seeds, before.records), earlier.unionByName(answered), before, options, host_rules, True)
    _write(step.expanded, root, batch_id, "expanded")
    _write(step.records, root, batch_id, "records")
    return True


def worklist(spark: SparkSession, root: str) -> DataFrame:
    """Pages that the crawls are certain to visit, robots rules allow and no batch has answered: what to fetch next."""
    steps = _steps(spark, root)
    rows = _read(spark, root, steps, "records").filter("allowed").drop("allowed")
    return rows.join(_read(spark, root, steps, "pages"), PAGE, "left_anti").select(*SITE, "url", "depth", "page_ord")


def frontier_so_far(
    spark: SparkSession, root: str, options: AuditOptions | None = None, host_rules: DataFrame | None = None
) -> DataFrame:
    """What ``crawl.frontier`` gives for all pages so far: levels that still wait are expanded by their answered pages."""
    steps = _steps(spark, root)
    pages = _read(spark, root, steps, "pages")
    before = Advance(_read(spark, root, steps, "records"), _read(spark, root, steps, "expanded"))
    none = before.records.select(*SITE).limit(0)
    more = _advanced(root, none, pages, before, options or AuditOptions(), host_rules, False).records
    rows = before.records.unionByName(more).join(pages, PAGE, "left")
    return rows.selectExpr(*SITE, "url", "depth", "page_ord", "allowed", "step is not null as fetched")


def keep_frontier(
    arrivals: DataFrame, seeds: DataFrame, root: str, checkpoint: str,
    options: AuditOptions | None = None, host_rules: DataFrame | None = None, available_now: bool = True,
) -> StreamingQuery:
    """Advances the frontier by every batch of a stream of fetch records."""

    def each(batch: DataFrame, batch_id: int) -> None:
        write_batch(batch, seeds, batch_id, root, options, host_rules)

    writer = arrivals.writeStream.foreachBatch(each).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if available_now else writer).start()
