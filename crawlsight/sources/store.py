"""The audit store: Parquet tables of many audits, looked up by id or site.

Every save of an audit is a version, told by ``saved_at``; the newest version of an id wins.
Nothing that is stored is ever changed in place:

* What belongs to an audit (issues, page facts and so on) is written under the version before
  the audit's own row, which makes it visible. A save that stops half-way is not seen.
* A deletion adds the versions of an audit to a table of deleted versions beside the audits, which
  readers leave out. What belongs to these versions is no longer seen with them.
* ``compact`` writes what is current in a bucket as a new version, and only when that is
  visible removes the files that were there before. It may stop anywhere.
* A small table beside the audits tells the bucket of an id, so a lookup by id reads one bucket.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from crawlsight.functions import url as U
from crawlsight.functions.sql import lit

BUCKETS = 1024


def bucket(seed_url: str) -> str:
    """Partition of a site, so that a lookup reads one directory only."""
    return f"cast(pmod(xxhash64({seed_url}), {BUCKETS}) as int)"


def save(audits: DataFrame, path: str) -> None:
    """Appends audits, or rows that belong to them, under their normalised seed.

    Rebalancing brings a bucket together but splits one that a huge site makes too big.
    """
    rows = audits.withColumn(
        "seed_url", F.expr(f"coalesce({U.normalize_url('seed_url')}, seed_url)")
    ).withColumn("seed_bucket", F.expr(bucket("seed_url")))
    rows.hint("rebalance", "seed_bucket").write.mode("append").partitionBy("seed_bucket").parquet(path)


def _at(spark: SparkSession, path: str):
    """File system and path of a folder."""
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    return place.getFileSystem(spark._jsc.hadoopConfiguration()), place


def exists(spark: SparkSession, path: str) -> bool:
    """Whether a table holds any rows; a folder without data files has none."""
    files, place = _at(spark, path)
    if not files.exists(place):
        return False
    found = files.listFiles(place, True)
    while found.hasNext():
        if found.next().getPath().getName()[0] not in "_.":
            return True
    return False


def _ids(path: str) -> str:
    return f"{path.rstrip('/')}-ids"


def _deleted(path: str) -> str:
    return f"{path.rstrip('/')}-deleted"


def save_audits(audits: DataFrame, path: str) -> None:
    """Appends audits, and before that the buckets of their ids; save what belongs to them first."""
    rows = audits.selectExpr("audit_id", f"coalesce({U.normalize_url('seed_url')}, seed_url) as seed_url")
    rows.selectExpr("audit_id", f"{bucket('seed_url')} as seed_bucket", f"{bucket('audit_id')} as id_bucket").hint(
        "rebalance", "id_bucket"
    ).write.mode("append").partitionBy("id_bucket").parquet(_ids(path))
    save(audits, path)


def _kept(spark: SparkSession, path: str, rows: DataFrame) -> DataFrame:
    """Rows of an audits table without deleted versions."""
    if not exists(spark, _deleted(path)):
        return rows
    gone = spark.read.parquet(_deleted(path)).select("audit_id", "saved_at")
    return rows.join(gone, ["audit_id", "saved_at"], "left_anti")


def load(spark: SparkSession, path: str, seed_url: str | None = None) -> DataFrame:
    """Current audits, of one site if given: the last saved row of each id that is not deleted."""
    rows = spark.read.parquet(path)
    if seed_url is not None:
        rows = of_site(rows, seed_url)
    return latest_version(_kept(spark, path, rows))


def buckets_of(spark: SparkSession, path: str, audit_id: str) -> list[int]:
    """The buckets that may hold an audit: from the table of ids one folder is read, without it all buckets count."""
    if not exists(spark, _ids(path)):
        rows = spark.read.parquet(path).filter(F.col("audit_id") == audit_id)
    else:
        of_id = spark.range(1).selectExpr(f"{bucket(lit(audit_id))} as b").first().b
        rows = spark.read.parquet(_ids(path)).filter((F.col("id_bucket") == of_id) & (F.col("audit_id") == audit_id))
    return sorted(r.seed_bucket for r in rows.select("seed_bucket").distinct().collect())


def find(spark: SparkSession, path: str, audit_id: str) -> DataFrame:
    """The current row of one audit; only its bucket is read."""
    mine = F.col("seed_bucket").isin(buckets_of(spark, path, audit_id)) & (F.col("audit_id") == audit_id)
    return latest_version(_kept(spark, path, spark.read.parquet(path).filter(mine)))


def belonging(spark: SparkSession, path: str, audits: DataFrame) -> DataFrame:
    """Rows of a table beside the audits (issues, page facts) that belong to these current audits.

    If the audits are few, only their buckets are read.
    """
    rows = spark.read.parquet(path)
    few = [r.seed_bucket for r in audits.select("seed_bucket").distinct().limit(65).collect()]
    return current_rows(rows.filter(F.col("seed_bucket").isin(few)) if len(few) <= 64 else rows, audits)


def of_site(rows: DataFrame, seed_url: str) -> DataFrame:
    """Rows of one site; of stored rows only the site's bucket is read."""
    norm = f"coalesce({U.normalize_url(lit(seed_url))}, {lit(seed_url)})"
    key = rows.sparkSession.range(1).selectExpr(f"{norm} as s", f"{bucket(norm)} as b").first()
    if "seed_bucket" in rows.columns:
        rows = rows.filter(F.col("seed_bucket") == key.b)
    return rows.filter(F.col("seed_url") == key.s)


def latest_version(rows: DataFrame) -> DataFrame:
    """Latest-wins view over appended rows: only keys and times are aggregated.

    A row that was appended twice at one time, by a repeated job, counts once.
    """
    newest = rows.groupBy("audit_id").agg(F.max("saved_at").alias("saved_at"))
    return rows.join(newest, ["audit_id", "saved_at"], "left_semi").dropDuplicates(["audit_id"])


def current_rows(rows: DataFrame, audits: DataFrame) -> DataFrame:
    """Issues or page facts that were saved together with the current version of their audit."""
    return rows.join(audits.select("audit_id", "saved_at"), ["audit_id", "saved_at"], "left_semi")


def get(audits: DataFrame, audit_id: str, seed_url: str | None = None) -> DataFrame:
    """One audit; with its site, only the site's bucket is read."""
    rows = audits if seed_url is None else of_site(audits, seed_url)
    return rows.filter(F.col("audit_id") == audit_id)


def history(audits: DataFrame, url: str | None = None, limit: int = 20) -> DataFrame:
    """Newest audits first: of one site, or the newest ``limit`` of every site."""
    if url is None:
        order = W.partitionBy("seed_url").orderBy(F.desc("created_at"), F.desc("audit_id"))
        return (
            audits.withColumn("rn", F.row_number().over(order))
            .filter(F.col("rn") <= limit)
        )
    return of_site(audits, url).orderBy(F.desc("created_at"), F.desc("audit_id")).limit(limit)


def latest(audits: DataFrame) -> DataFrame:
    """The newest audit of every site. Only keys and times are aggregated; ids must be distinct."""
    newest = audits.groupBy("seed_url").agg(F.max(F.struct("created_at", "audit_id")).alias("k"))
    return audits.join(newest.select("seed_url", "k.audit_id"), ["seed_url", "audit_id"], "left_semi")


def previous(audits: DataFrame, current: DataFrame) -> DataFrame:
    """For each audit of ``current`` the newest audit of its site other than itself.

    Only the audit itself is left out, so the result may be newer. The two newest
    audits of a site are enough to answer this, which avoids pairing all audits.
    """
    order = W.partitionBy("seed_url").orderBy(F.desc("created_at"), F.desc("audit_id"))
    newest = (
        audits.select("seed_url", "audit_id", "created_at")
        .withColumn("rn", F.row_number().over(order))
        .filter(F.col("rn") <= 2)
        .selectExpr("seed_url", "audit_id as previous_audit_id", "rn")
    )
    return (
        current.select("audit_id", "seed_url")
        .join(newest, "seed_url", "left")
        .groupBy("audit_id", "seed_url")
        .agg(
            F.expr(
                "min_by(previous_audit_id, rn) filter (where previous_audit_id <> audit_id)"
                " as previous_audit_id"
            )
        )
    )


def previous_in_time(audits: DataFrame) -> DataFrame:
    """Bulk as-of form, unlike ``previous``: for each audit the one before it in time.

    Looks back within a day, and for the first audit of a day to the last of the
    day before, so the audits of one site are never sorted in a single task.
    """
    keys = ["seed_url", "day"]
    rows = audits.select("audit_id", "seed_url", "created_at", F.to_date("created_at").alias("day"))
    within = W.partitionBy(*keys).orderBy("created_at", "audit_id")
    last = rows.groupBy(*keys).agg(F.max_by("audit_id", F.struct("created_at", "audit_id")).alias("id"))
    days = last.withColumn("earlier", F.lag("id").over(W.partitionBy("seed_url").orderBy("day")))
    return (
        rows.withColumn("same_day", F.lag("audit_id").over(within))
        .join(days.drop("id"), keys)
        .select("audit_id", "seed_url", F.coalesce("same_day", "earlier").alias("previous_audit_id"))
    )


def baselines(current: DataFrame, history: DataFrame, as_of: bool = False) -> DataFrame:
    """audit_id, seed_url, previous_audit_id: what each audit of ``current`` is compared with.

    That is the newest audit of the site in ``history`` other than the audit itself, or NULL.
    With ``as_of`` it must also come before the audit in time, by ``created_at`` and id; then audits
    of any age can be compared in bulk. ``history`` may hold the current audits or not.
    """
    if not as_of:
        return previous(history, current)
    # Current and stored audits in one table. Within a day a window finds the two stored audits
    # before each current one, between days another finds those of the last two days that have
    # any: of two audits one at most is the current one itself.
    fields = ["seed_url", "created_at", "audit_id"]
    rows = current.select(*fields, F.lit(0).alias("stored")).unionByName(history.select(*fields, F.lit(1).alias("stored")))
    rows = rows.withColumn("day", F.to_date("created_at")).withColumn("id", F.when(F.col("stored") == 1, F.col("audit_id")))
    within = W.partitionBy("seed_url", "day").orderBy("created_at", "audit_id", "stored").rowsBetween(W.unboundedPreceding, -1)
    rows = rows.withColumn("before", F.last("id", ignorenulls=True).over(within))
    pair = F.when(F.col("stored") == 1, F.array_compact(F.array("id", "before")))
    rows = rows.withColumn("same_day", F.last(pair, ignorenulls=True).over(within))
    newest = W.partitionBy("seed_url", "day").orderBy(F.desc("created_at"), F.desc("audit_id"))
    two = (
        rows.filter("stored = 1")
        .select("seed_url", "day", "audit_id", F.row_number().over(newest).alias("rn"))
        .filter("rn <= 2")
        .groupBy("seed_url", "day")
        .agg(F.expr("transform(array_sort(collect_list(struct(rn, audit_id))), x -> x.audit_id)").alias("ids"))
    )
    days = rows.select("seed_url", "day").distinct().join(two, ["seed_url", "day"], "left")
    earlier = W.partitionBy("seed_url").orderBy("day").rowsBetween(W.unboundedPreceding, -1)
    days = days.withColumn("last_ids", F.last("ids", ignorenulls=True).over(earlier))
    both = F.when(F.col("ids").isNotNull(), F.concat("ids", F.coalesce("last_ids", F.array())))
    days = days.withColumn("earlier_days", F.last(both, ignorenulls=True).over(earlier))
    candidates = F.concat(F.coalesce("same_day", F.array()), F.coalesce("earlier_days", F.array()))
    return (
        rows.filter("stored = 0")
        .join(days.select("seed_url", "day", "earlier_days"), ["seed_url", "day"])
        .withColumn("c", candidates)
        .selectExpr("audit_id", "seed_url", "get(filter(c, x -> x <> audit_id), 0) as previous_audit_id")
    )


def without(audits: DataFrame, ids: DataFrame) -> DataFrame:
    """Audits that remain after deleting the given ids."""
    return audits.join(ids.select("audit_id"), "audit_id", "left_anti")


def delete(spark: SparkSession, path: str, audit_id: str) -> bool:
    """Removes one audit, and with it what belongs to it; tells if there was one."""
    mine = F.col("seed_bucket").isin(buckets_of(spark, path, audit_id)) & (F.col("audit_id") == audit_id)
    return _delete(spark, path, spark.read.parquet(path).filter(mine)) > 0


def delete_all(spark: SparkSession, path: str, ids: DataFrame) -> int:
    """Removes the audits with the given ids; tells how many there were."""
    return _delete(spark, path, spark.read.parquet(path).join(ids.select("audit_id"), "audit_id", "left_semi"))


def _delete(spark: SparkSession, path: str, rows: DataFrame) -> int:
    """Adds all versions to the deleted ones, so that no older version comes to light."""
    gone = _kept(spark, path, rows.select("audit_id", "saved_at", "seed_bucket")).distinct()
    n = gone.select("audit_id").distinct().count()
    if n:
        # All versions of an id are in one file: seen together or not at all.
        gone.repartition("audit_id").write.mode("append").parquet(_deleted(path))
    return n


def _files(spark: SparkSession, path: str, buckets: list[int] | None = None) -> list:
    """The files of a table, of some buckets if given."""
    folders = [path] if buckets is None else [f"{path}/seed_bucket={b}" for b in buckets]
    found = []
    for folder in folders:
        files, place = _at(spark, folder)
        if files.exists(place):
            found += [f.getPath() for f in files.listStatus(place) if f.isFile()]
    return found


def compact(spark: SparkSession, path: str, beside: list[str], after: Callable[[str], None] = lambda step: None) -> list[int]:
    """Removes what is no longer current from the audits at ``path`` and the tables ``beside`` it; the buckets it wrote.

    Buckets that hold deleted or replaced versions, or rows of a save that never ended, are written
    as new versions a microsecond later: first the tables beside, then the audits, whose rows
    make the new version visible. Only then the files from before go. Whatever step it stops
    after, readers see the same; the next run cleans up. No other job may save meanwhile.
    ``after`` is called with each step's name.
    """
    beside = [t for t in beside if exists(spark, t)]
    rows, live = spark.read.parquet(path), load(spark, path)
    versions = live.select("audit_id", "saved_at")
    held = [t.select("audit_id", "saved_at", "seed_bucket") for t in (rows, *map(spark.read.parquet, beside))]
    stale = {
        r.seed_bucket
        for t in held
        for r in t.join(versions, ["audit_id", "saved_at"], "left_anti").select("seed_bucket").distinct().collect()
    }
    buckets = sorted(stale)  # no more than BUCKETS
    if not buckets:
        return []
    old = {t: _files(spark, t, buckets) for t in (*beside, path)}
    old_deleted = _files(spark, _deleted(path)) if exists(spark, _deleted(path)) else []
    mine = F.col("seed_bucket").isin(buckets)
    later = F.expr("saved_at + interval 1 microsecond")
    for t in beside:
        save(current_rows(spark.read.parquet(t).filter(mine), versions).withColumn("saved_at", later), t)
        after(f"write {t}")
    save(live.filter(mine).withColumn("saved_at", later), path)
    after(f"write {path}")
    for t in (*beside, path):
        for file in old[t]:
            _at(spark, t)[0].delete(file, False)
        after(f"clear {t}")
    for file in old_deleted:
        _at(spark, path)[0].delete(file, False)
    after("clear deleted")
    return buckets


def listing(audits: DataFrame, issues: DataFrame, pages: DataFrame) -> DataFrame:
    """History entries: id, site, ISO time, score, issue and page counts, audits of the site.

    Stored issues and pages count only if they belong to the audits' version.
    """
    if "saved_at" in audits.columns:
        issues, pages = (current_rows(t, audits) if "saved_at" in t.columns else t for t in (issues, pages))
    n_issues = issues.groupBy("audit_id").agg(F.count("*").alias("issue_count"))
    n_pages = pages.groupBy("audit_id").agg(F.count("*").alias("pages"))
    total = audits.groupBy("seed_url").agg(F.count("*").alias("count"))
    return (
        audits.select("audit_id", "seed_url", "created_at", "score")
        .join(n_issues, "audit_id", "left")
        .join(n_pages, "audit_id", "left")
        .join(total, "seed_url")
        .selectExpr(
            "audit_id",
            "seed_url",
            f"{iso('created_at')} as created_at",
            "score",
            "coalesce(issue_count, 0) as issue_count",
            "coalesce(pages, 0) as pages",
            "count",
        )
    )


def iso(ts: str) -> str:
    """UTC time in ISO form, microseconds only if there are any."""
    micros = f"date_format({ts}, 'SSSSSS')"
    return (
        f"concat(date_format({ts}, \"yyyy-MM-dd'T'HH:mm:ss\"),"
        f" if({micros} = '000000', '', concat('.', {micros})), '+00:00')"
    )
