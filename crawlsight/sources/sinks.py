"""Writing reports and tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

ORDER = ("audit_id", "section_ord", "item_ord")


def write_lines(lines: DataFrame, path: str) -> None:
    """Report lines of all audits as Parquet, sorted in reading order, under range partitions.

    Rows are audit, section_ord, item_ord and line: a handful of large files, however
    many audits there are.
    """
    lines.select(*ORDER, "line").repartitionByRange(*ORDER).sortWithinPartitions(*ORDER).write.mode("overwrite").parquet(path)


def write_text(lines: DataFrame, path: str, audit_ids: list[str]) -> None:
    """Reports of the given audits as text files under ``audit=<id>``, in reading order.

    Range partitioning splits a long report over many tasks; the file names of an
    audit sort like its lines. Each audit is a folder, so name the few that people read.
    """
    (
        lines.filter(F.col("audit_id").isin(audit_ids))
        .repartitionByRange(*ORDER)
        .sortWithinPartitions(*ORDER)
        .selectExpr("audit_id as audit", "line as value")
        .write.mode("overwrite")
        .partitionBy("audit")
        .text(path)
    )


def write_json(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").option("ignoreNullFields", "false").json(path)


def as_json(df: DataFrame) -> DataFrame:
    return df.select(F.expr("to_json(struct(*), map('ignoreNullFields', 'false')) as json"))
