"""A frontier that advances while pages land equals the one over all pages."""

import pytest
from helpers import fetch, fetches
from test_crawl import GRAPH, SEED

from crawlsight.config import AuditOptions
from crawlsight.operators import crawl as CR
from crawlsight.operators import robots as RB
from crawlsight.streaming import arrivals as ST
from crawlsight.streaming import frontier as FR

FIELDS = ("audit_id", "url", "depth", "page_ord", "allowed", "fetched")
OTHER = "https://two.com/"


def rows_of(graph, seed, audit):
    return [
        fetch(seed + path if path else seed, "".join(f"<a href='{t}'>x</a>" for t in targets) or "<p>x</p>", n, seed=seed, audit=audit)
        for n, (path, targets) in enumerate(graph.items())
    ]


def of(df):
    return sorted(map(tuple, df.select(*FIELDS).collect()))


@pytest.fixture(scope="module")
def crawl(spark):
    seeds = spark.createDataFrame([("a1", SEED), ("a2", OTHER)], "audit_id string, seed_url string")
    probe = fetch(SEED + "b", None, 99, 0, audit="a1", depth=-1, error="x")
    pages = [*rows_of(GRAPH, SEED, "a1"), *rows_of({"": ["/x", "/y"], "y": ["/x", "/z"], "x": []}, OTHER, "a2"), probe, fetch(None, "<p>lost", 98)]
    files = spark.createDataFrame([("ex.com", 200, None, "User-agent: *\nDisallow: /c\n")], "host string, status_code int, error string, body string")
    return seeds, pages, RB.rules_for_agent(RB.robots_rules(files), "crawlsight/0.1")


@pytest.mark.parametrize("max_pages, max_depth, robots", [(50, 5, True), (6, 3, False)])
def test_batches_in_any_order(spark, crawl, tmp_path, max_pages, max_depth, robots):
    seeds, pages, rules = crawl
    rules = rules if robots else None
    options = AuditOptions(max_pages=max_pages, max_depth=max_depth)
    root = str(tmp_path / "kept")
    cuts = [[], pages[7:], pages[:2], pages[2:7]]
    for n, part in enumerate(cuts):
        assert FR.write_batch(fetches(spark, part), seeds, n, root, options, rules)
        so_far = [r for p in cuts[: n + 1] for r in p]
        if n in (1, 3):
            assert of(FR.frontier_so_far(spark, root, options, rules)) == of(CR.frontier(seeds, fetches(spark, so_far), options, rules))
        if n == 0:
            assert sorted(r.url for r in FR.worklist(spark, root).collect()) == [SEED, OTHER]
    whole = CR.frontier(seeds, fetches(spark, pages), options, rules)
    left = {(r.audit_id, r.url) for r in whole.filter("allowed and not fetched").collect()}
    assert {(r.audit_id, r.url) for r in FR.worklist(spark, root).collect()} == left
    # A repeated batch, or another answer for a known page, changes nothing.
    before = of(FR.frontier_so_far(spark, root, options, rules))
    assert not FR.write_batch(fetches(spark, cuts[3]), seeds, 3, root, options, rules)
    assert FR.write_batch(fetches(spark, rows_of({"": ["/late"], "late": []}, SEED, "a1")[:1]), seeds, 4, root, options, rules)
    assert of(FR.frontier_so_far(spark, root, options, rules)) == before


def test_worklist_drives_a_crawl_to_its_end(spark, crawl, tmp_path):
    """A fetcher that answers the worklist, with a batch cut short on the way, visits what ``frontier`` visits."""
    seeds, pages, _ = crawl
    pages = [*pages, fetch(SEED + "missing", None, 50, None, error="timeout"), *(fetch(OTHER + p, None, 50, 404, seed=OTHER, audit="a2") for p in "z")]
    by_key = {(r[0], r[2]): r for r in pages if r[9] >= 0 and r[2]}
    root, asked = str(tmp_path / "kept"), set()
    work, n = [], 0
    while n == 0 or work:
        FR.write_batch(fetches(spark, [by_key[k] for k in work]), seeds, n, root)
        if n == 1:  # A later batch that stopped before its last table.
            FR._write(fetches(spark, pages[:1]).selectExpr("audit_id", "url", "page_ord as from_ord", "2L as step"), root, 2, "pages")
        found = {(r.audit_id, r.url) for r in FR.worklist(spark, root).collect()}
        work = sorted(k for k in found - asked if k in by_key)
        asked |= set(work)
        n += 1
        assert n < 8
    whole = CR.frontier(seeds, fetches(spark, pages))
    assert of(FR.frontier_so_far(spark, root)) == of(whole)
    assert asked == {(r.audit_id, r.url) for r in whole.filter("fetched").collect()}


def test_frontier_of_a_stream(spark, crawl, tmp_path):
    seeds, pages, _ = crawl
    fetches(spark, pages).repartition(2, "page_ord").write.parquet(str(tmp_path / "in"))
    arrivals = ST.read_arrivals(spark, str(tmp_path / "in"), 1)
    FR.keep_frontier(arrivals, seeds, str(tmp_path / "kept"), str(tmp_path / "ckpt")).awaitTermination(300)
    assert of(FR.frontier_so_far(spark, str(tmp_path / "kept"))) == of(CR.frontier(seeds, fetches(spark, pages)))
