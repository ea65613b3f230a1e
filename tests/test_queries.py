"""Registered queries against their SQL twins on the smallest tables."""

import glob
import os

import duckdb
import pytest

import __spark_entry__ as entry

SF = "/root/testdata/sf0.001"
QUICK = (
    "url_normalize", "link_resolve", "title_facts", "visible_words", "page_scores", "issues_meta", "image_dedupe",
    "jsonld_types", "history_topn", "previous_audit", "audit_upsert", "robots_gate", "suggest_parse", "bfs_levels", "diff_summary",
    "crawl_records", "bfs_two_audits", "issue_url_lists", "rejected_records", "issues_faulty_metrics", "metrics_by_check", "stored_audits",
    "robots_many_rules", "picture_images", "rendered_pages", "suggest_messages", "suggest_page_status", "crawl_worklist",
    "heading_details", "unlinked_details",
)


@pytest.fixture(scope="module")
def db():
    con = duckdb.connect()
    for path in glob.glob(f"{SF}/*.parquet"):
        name = os.path.basename(path).removesuffix(".parquet")
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{path}'")
    return con


@pytest.mark.parametrize("name", QUICK)
def test_query_equals_sql(spark, db, name):
    got = entry.queries()[name](spark, SF)
    want = db.execute(entry.oracle_sql()[name])
    columns = sorted(d[0] for d in want.description)
    assert sorted(got.columns) == columns
    order = [d[0] for d in want.description]
    expected = [tuple(dict(zip(order, row))[c] for c in columns) for row in want.fetchall()]
    rows = [tuple(r) for r in got.select(*columns).collect()]
    assert sorted(rows, key=repr) == sorted(expected, key=repr)


def test_metric_averages_complete_the_metrics(spark, db):
    test_query_equals_sql(spark, db, "metric_averages")
    names = {r.metric for r in entry.queries()["metric_averages"](spark, SF).select("metric").distinct().collect()}
    assert names == {"avg_title_length", "avg_meta_description_length", "alt_coverage_pct"}


def test_registry_is_consistent():
    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_entry_has_rows(spark):
    assert entry.entry(spark).count() > 0
