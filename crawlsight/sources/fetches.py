"""Fetch records: reading, normalising and filtering them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from crawlsight.functions import text as X
from crawlsight.functions import url as U
from crawlsight.functions.sql import lit
from crawlsight.schema import FETCHES, HOPS

# An error text, no status or a status from 400 on.
BROKEN = f"({X.filled('error')} or status_code is null or status_code >= 400)"

# A record that an audit can own: an address without a scheme has no normal form and so no site.
USABLE = "(audit_id is not null and seed_url is not null and url is not null)"


def rejects(fetches: DataFrame) -> DataFrame:
    """Records that no audit can own, with the reason; all others satisfy ``USABLE``."""
    reason = (
        "case when url is null then 'no usable address' when seed_url is null then 'no usable site address'"
        " else 'no audit' end as reason"
    )
    return fetches.filter(f"not {USABLE}").selectExpr("audit_id", "seed_url", "url", "page_ord", "depth", reason)


def read_fetches(spark: SparkSession, path: str, fmt: str = "parquet") -> DataFrame:
    return spark.read.schema(FETCHES).format(fmt).load(path)


def pages_as_fetches(pages: DataFrame, run: str = "a") -> DataFrame:
    """Plain ``(page_id, url, html)`` rows as successful fetches, one audit per origin.

    The page id is the crawl position, so no numbering within a site is needed.
    """
    return (
        pages.selectExpr("page_id", "html", f"{U.normalize_url('url')} as url")
        .selectExpr("*", f"concat({U.origin('url')}, '/') as seed_url")
        .selectExpr(
            f"concat({lit(run + ':')}, seed_url) as audit_id",
            "seed_url",
            "url",
            "url as final_url",
            "200 as status_code",
            "html",
            "cast(octet_length(html) as bigint) as content_length",
            f"cast(array() as {HOPS}) as redirect_chain",
            "cast(null as string) as error",
            "0 as depth",
            "0.0D as elapsed_ms",
            "false as js_rendered",
            "page_id as page_ord",
        )
    )


def redirect_chain(history: str, final_url: str, status: str) -> str:
    """Hops with the last response appended; empty if there was no hop."""
    last = f"array(named_struct('url', {final_url}, 'status_code', {status}))"
    return f"if({X.size0(history)} > 0, concat({history}, {last}), cast(array() as {HOPS}))"


def normalize_fetches(raw: DataFrame) -> DataFrame:
    """Fetcher output brought to the ``fetches`` schema."""
    final = f"if({X.filled('final_url')}, coalesce({U.normalize_url('final_url')}, final_url), url)"
    return raw.selectExpr(
        "audit_id",
        "seed_url",
        "url",
        f"{final} as final_url",
        "nullif(status_code, 0) as status_code",
        f"if({X.filled('error')}, null, html) as html",
        "cast(if(octet_length(coalesce(html, '')) > 0, octet_length(html),"
        " coalesce(content_length, 0)) as bigint) as content_length",
        f"{redirect_chain('history', 'final_url', 'status_code')} as redirect_chain",
        "error",
        "depth",
        "elapsed_ms",
        "js_rendered",
        "page_ord",
    )


def page_fetches(fetches: DataFrame) -> DataFrame:
    """Without the synthetic rows of external probes."""
    return fetches.filter("depth >= 0")


def broken_probe_fetches(fetches: DataFrame) -> DataFrame:
    return fetches.filter(f"depth = -1 and {BROKEN}")
