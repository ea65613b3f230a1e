"""Exact duplicates by skew-safe combining of whole contents.

Texts are equal when nothing but ASCII white space differs. Of equal texts the
row with the longest original text stays, then the smallest id (NULL ids last).

* NULL text counts as empty; all empty texts are one group.
* Repeated rows (same id, equal text) are members of one group and all get its
  ``keep_id``; ``kept_documents`` returns just one of them.
* An empty table gives no rows; further columns are ignored, or kept by
  ``kept_documents``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from crawlsight.llm.common import sql_pattern
from crawlsight.session import stage

#: Partitions whose local winners meet in one salted group.
SALTS = 16

_TWO64 = "18446744073709551616BD"
_TWO63 = "9223372036854775808BD"


def normalised(text: str) -> str:
    """SQL: the text without white space; single spaces go by the cheaper plain search."""
    return f"regexp_replace(replace(coalesce({text}, ''), ' ', ''), {sql_pattern(r'[\x20\x09-\x0D]+')}, '')"


def _contents(docs: DataFrame) -> DataFrame:
    """Content, digest and the rank of each row as one number: longer first, then smaller id."""
    rows = docs.select(
        F.expr(normalised("text")).alias("content"),
        F.expr(
            f"cast(length(coalesce(text, '')) as decimal(20,0)) * {_TWO64}"
            f" - coalesce(cast(doc_id as decimal(20,0)), {_TWO63})"
        ).alias("pick"),
    )
    return rows.select("content", "pick", _digest("content"))


def _digest(content: str):
    return F.unhex(F.sha2(F.col(content), 256)).alias("digest")


def groups(docs: DataFrame, salts: int = SALTS) -> DataFrame:
    """One row per distinct content: digest, fingerprint, keep_id, group_size.

    Three stages, each of which compares whole contents: within a partition (the
    partial aggregation), within salted digest groups, and among salt winners. A
    group of any size sends one row per partition to ``salts`` tasks, and ``salts``
    rows to the last one.
    """
    rows = _contents(docs).withColumn("salt", F.spark_partition_id() % salts)
    salted = rows.groupBy("salt", "digest", "content").agg(F.max("pick").alias("pick"), F.count("*").alias("n"))
    merged = salted.groupBy("digest", "content").agg(F.max("pick").alias("pick"), F.sum("n").alias("group_size"))
    length = f"floor((pick + {_TWO63}) / {_TWO64})"
    return merged.select(
        "digest",
        F.xxhash64("content").alias("fingerprint"),
        F.expr(f"cast(nullif(cast({length} as decimal(20,0)) * {_TWO64} - pick, {_TWO63}) as bigint)").alias("keep_id"),
        F.expr(f"cast({length} as bigint)").alias("keep_length"),
        "group_size",
    )


def dedup(docs: DataFrame, salts: int = SALTS) -> DataFrame:
    """Every row with its group: doc_id, keep_id, group_size, kept, text_sha256."""
    rows = docs.select("doc_id", F.expr(normalised("text")).alias("content"))
    rows = rows.select("doc_id", _digest("content"), F.xxhash64("content").alias("fingerprint"))
    return rows.join(groups(docs, salts), ["digest", "fingerprint"]).select(
        "doc_id",
        "keep_id",
        "group_size",
        F.expr("doc_id <=> keep_id").alias("kept"),
        F.lower(F.hex("digest")).alias("text_sha256"),
    )


def kept_documents(docs: DataFrame, salts: int = SALTS, broadcast_rows: int = 500_000) -> DataFrame:
    """The documents that stay, with all their columns, one row per group.

    The rows that go are known by id, digest and length. While their list is short (at
    most ``broadcast_rows``, about 60 MB) it goes to the documents, else both are shuffled.
    """
    key = [F.col("doc_id").alias("_id"), F.expr("cast(length(coalesce(text, '')) as bigint)").alias("_len"), F.expr(normalised("text")).alias("content")]
    mine = docs.select(*key).select("_id", "_len", _digest("content"), F.xxhash64("content").alias("fingerprint"))
    best = groups(docs, salts).select("digest", "fingerprint", "keep_id", "keep_length")
    keys = mine.join(best, ["digest", "fingerprint"]).groupBy(
        F.col("_id").alias("x_id"), F.col("_len").alias("x_len"), F.col("digest").alias("x_digest")
    ).agg(F.bool_and(F.expr("_id <=> keep_id and _len = keep_length")).alias("stays"), F.count("*").alias("n"))
    special = stage(keys.filter("not stays or n > 1"), "exact_gone")
    small = special.count() <= broadcast_rows
    rows = docs.select(F.struct("*").alias("row"), *key).select("row", "_id", "_len", _digest("content"))
    rows = rows.join(
        F.broadcast(special) if small else special, F.expr("_id <=> x_id and _len = x_len and digest = x_digest"), "left"
    )
    kept = rows.filter("stays is null").select("row.*")
    if special.filter("stays").isEmpty():
        return kept
    # Rows repeated with one id and text: one of them stays.
    once = Window.partitionBy("digest", "_id").orderBy("_len")
    again = rows.filter("stays").withColumn("_n", F.row_number().over(once)).filter("_n = 1").select("row.*")
    return kept.unionByName(again)
