"""Writes a table folder whose pages are repeated, so that timings show data and not planning.

usage: python tools/repeat_pages.py <table folder> <new folder> <times>

The other tables are links to the given ones. Copies get ids and addresses of their own.
"""

from __future__ import annotations

import os
import sys

from pyspark.sql import SparkSession
from pyspark.sql import functions as F


def main() -> None:
    source, target, times = sys.argv[1], sys.argv[2], int(sys.argv[3])
    os.makedirs(target)
    for name in os.listdir(source):
        if name != "pages.parquet":
            os.symlink(os.path.join(os.path.abspath(source), name), os.path.join(target, name))
    spark = SparkSession.builder.master("local[8]").config("spark.ui.enabled", "false").config("spark.driver.memory", "4g").getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    pages = spark.read.parquet(f"{source}/pages.parquet")
    n = pages.agg(F.max("page_id")).first()[0] + 1
    copies = pages.selectExpr("*", f"explode(sequence(0, {times} - 1)) as k").selectExpr(
        f"page_id + k * {n} as page_id", "regexp_replace(url, '(\\\\?|#|$)', concat('-', k, '$1')) as url", "html"
    )
    copies.repartition(16).write.parquet(f"{target}/pages.parquet")
    spark.stop()


if __name__ == "__main__":
    main()
