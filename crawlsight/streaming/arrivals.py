"""Page facts and page issues over fetch records as they arrive.

Both are stateless per page, so the batch expressions serve a stream unchanged.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQuery

from crawlsight.config import AuditOptions
from crawlsight.operators.checks import CheckRegistry, page_issues
from crawlsight.operators.facts import page_facts
from crawlsight.schema import FETCHES


def read_arrivals(spark: SparkSession, path: str, files_per_trigger: int = 1000) -> DataFrame:
    return (
        spark.readStream.schema(FETCHES)
        .option("maxFilesPerTrigger", files_per_trigger)
        .parquet(path)
    )


def issues_of_arrivals(
    arrivals: DataFrame, options: AuditOptions | None = None, registry: CheckRegistry | None = None
) -> DataFrame:
    return page_issues(page_facts(arrivals), options or AuditOptions(), registry)


def write_arrivals(df: DataFrame, path: str, checkpoint: str, available_now: bool = True) -> StreamingQuery:
    """Appends to Parquet exactly once; stops at the end of the present input if asked to."""
    writer = df.writeStream.format("parquet").outputMode("append").option("checkpointLocation", checkpoint)
    writer = writer.trigger(availableNow=True) if available_now else writer
    return writer.start(path)
