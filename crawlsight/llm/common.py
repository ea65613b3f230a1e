"""What several training-data operators share: words, tables, running totals."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: White space of the text contracts, as a character class body for Java patterns.
SPACE = r"\x20\x09-\x0D"


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def sql_pattern(pattern: str) -> str:
    """``pattern`` as a SQL string literal."""
    return "'" + pattern.replace("\\", "\\\\").replace("'", "\\'") + "'"


def words(text: str) -> str:
    """SQL: the words of a text as an array; none for NULL or blank text."""
    return f"array_remove(split(coalesce({text}, ''), {sql_pattern('[' + SPACE + ']+')}), '')"


def n_words(text: str) -> str:
    """SQL: the number of words of a text."""
    return f"cast(regexp_count(coalesce({text}, ''), {sql_pattern('[^' + SPACE + ']+')}) as bigint)"


def remainder(doc_id: str, modulus: int) -> str:
    """SQL: crc32 of the id as text, modulo; -1 for a NULL id."""
    return f"coalesce(crc32(cast(cast({doc_id} as string) as binary)) % {modulus}, -1)"


def running(rows: DataFrame, by: list[str], bucket: str, order: list, sums: dict[str, str]) -> DataFrame:
    """Adds inclusive running totals over the order (``bucket``, ``order``) within ``by``.

    No group is sorted in one task: each bucket is summed by itself, and the totals
    of the buckets before it are added. ``by`` and ``bucket`` must not be NULL.
    ``sums`` maps new column names to the column that is summed.
    """
    keys = [*by, bucket]
    totals = rows.groupBy(*keys).agg(*(F.sum(v).alias(f"_{k}") for k, v in sums.items()))
    before = Window.partitionBy(*by).orderBy(bucket).rowsBetween(Window.unboundedPreceding, -1)
    offsets = totals.select(*keys, *(F.coalesce(F.sum(f"_{k}").over(before), F.lit(0)).alias(f"_{k}") for k in sums))
    inner = Window.partitionBy(*keys).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    summed = rows.select("*", *(F.sum(v).over(inner).alias(k) for k, v in sums.items()))
    joined = summed.join(offsets, keys)
    return joined.select(*rows.columns, *((F.col(k) + F.col(f"_{k}")).alias(k) for k in sums))
