"""Table schemas."""

from __future__ import annotations

from pyspark.sql import types as T

HOP = T.StructType([T.StructField("url", T.StringType()), T.StructField("status_code", T.IntegerType())])

HOPS = "array<struct<url:string,status_code:int>>"

FETCHES = T.StructType(
    [
        T.StructField("audit_id", T.StringType()),
        T.StructField("seed_url", T.StringType()),
        T.StructField("url", T.StringType()),
        T.StructField("final_url", T.StringType()),
        T.StructField("status_code", T.IntegerType()),
        T.StructField("html", T.StringType()),
        T.StructField("content_length", T.LongType()),
        T.StructField("redirect_chain", T.ArrayType(HOP)),
        T.StructField("error", T.StringType()),
        T.StructField("depth", T.IntegerType()),
        T.StructField("elapsed_ms", T.DoubleType()),
        T.StructField("js_rendered", T.BooleanType()),
        T.StructField("page_ord", T.LongType()),
    ]
)

# What a fetcher hands over, before normalisation.
RAW_FETCHES = T.StructType(
    [f for f in FETCHES.fields if f.name != "redirect_chain"]
    + [T.StructField("history", T.ArrayType(HOP))]
)

ISSUE_COLUMNS = (
    "audit_id", "seed_url", "analyzer", "analyzer_ord", "phase", "page_ord", "item_ord",
    "code", "severity", "message", "url", "details",
)

AUDITS = T.StructType(
    [
        T.StructField("audit_id", T.StringType()),
        T.StructField("seed_url", T.StringType()),
        T.StructField("created_at", T.TimestampType()),
        T.StructField("score", T.DoubleType()),
        T.StructField("pages", T.LongType()),
        T.StructField("issues", T.LongType()),
        T.StructField("saved_at", T.TimestampType()),
    ]
)

PROBES = T.StructType(
    [
        T.StructField("url", T.StringType()),
        T.StructField("status_code", T.IntegerType()),
        T.StructField("error", T.StringType()),
    ]
)

ROBOTS_FILES = T.StructType(
    [
        T.StructField("host", T.StringType()),
        T.StructField("status_code", T.IntegerType()),
        T.StructField("error", T.StringType()),
        T.StructField("body", T.StringType()),
    ]
)

SEVERITIES = ("critical", "warning", "info")
