"""Staging of tables that several later steps read."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession

_DIR = "spark.checkpoint.dir"


def staging_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: ``spark.checkpoint.dir``, or the context's checkpoint folder."""
    path = spark.conf.get(_DIR, None) or spark.sparkContext.getConf().get(_DIR) or spark.sparkContext.getCheckpointDir()
    if not path:
        raise RuntimeError(f"set {_DIR} to a folder that the driver and all executors share")
    return path


def stage(df: DataFrame, name: str, **options: str) -> DataFrame:
    """``df`` written once as Parquet and read back.

    Unlike a cache it survives lost executors, cuts the lineage, and lets each
    reader take only the columns it needs. ``options`` go to the writer; ``release``
    deletes what was staged.
    """
    spark = df.sparkSession
    path = f"{staging_dir(spark).rstrip('/')}/staged-{spark.sparkContext.applicationId}/{name}-{uuid.uuid4().hex}"
    df.write.options(**options).parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def stage_clustered(df: DataFrame, name: str, keys: list[str]) -> DataFrame:
    """``df`` staged once in buckets of ``keys``: later joins on all of them need no shuffle of this side.

    There are as many buckets as shuffle partitions. The table is known to this session only.
    """
    spark = df.sparkSession
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    own = f"{name}_{uuid.uuid4().hex}"
    path = f"{staging_dir(spark).rstrip('/')}/staged-{spark.sparkContext.applicationId}/{own}"
    df.repartition(n, *keys).write.bucketBy(n, *keys).option("path", path).saveAsTable(f"staged_{own}")
    return spark.table(f"staged_{own}")


def release(spark: SparkSession) -> None:
    """Deletes all tables this application staged; call it when no result that reads them is needed any more."""
    path = f"{staging_dir(spark).rstrip('/')}/staged-{spark.sparkContext.applicationId}"
    for table in spark.catalog.listTables():
        if table.name.startswith("staged_"):
            spark.sql(f"DROP TABLE {table.name}")
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark._jsc.hadoopConfiguration()).delete(target, True)
