import random
from collections import deque
from urllib.robotparser import RobotFileParser

import pytest
from helpers import fetch, fetches

from crawlsight.config import AuditOptions
from crawlsight.operators import crawl as CR
from crawlsight.operators import robots as RB

SEED = "https://ex.com/"


def linked(spark, graph, seed=SEED, audit="a1"):
    rows = []
    for n, (path, targets) in enumerate(graph.items()):
        html = "".join(f"<a href='{t}'>x</a>" for t in targets)
        rows.append(fetch(seed + path if path else seed, html or "<p>x</p>", n, seed=seed, audit=audit))
    return fetches(spark, rows)


def queue_crawl(graph, max_pages, max_depth, blocked=()):
    """Plain queue over the same graph."""
    seen, out, queue = {""}, [], deque([("", 0)])
    while queue and len(out) < max_pages:
        path, depth = queue.popleft()
        out.append((SEED + path if path else SEED, depth, path not in blocked, path in graph))
        if path in blocked or depth >= max_depth:
            continue
        for target in graph.get(path, []):
            key = target.lstrip("/")
            if target.startswith("/") and key not in seen:
                seen.add(key)
                queue.append((key, depth + 1))
    return out


GRAPH = {
    "": ["/b", "/a", "/b", "https://far.example/", "/c"],
    "a": ["/d", "/", "/a1"],
    "b": ["/e", "/d", "/missing"],
    "c": ["/f"],
    "d": ["/a", "/g"],
    "e": ["/g", "/h"],
    "f": [], "g": ["/i"], "h": [], "i": ["/j"], "j": [], "a1": [],
}


@pytest.mark.parametrize("max_pages, max_depth", [(50, 3), (5, 3), (50, 1), (1, 0), (2000, 9)])
def test_frontier_equals_a_queue(spark, max_pages, max_depth):
    seeds = spark.createDataFrame([("a1", SEED)], "audit_id string, seed_url string")
    options = AuditOptions(max_pages=max_pages, max_depth=max_depth)
    rows = CR.frontier(seeds, linked(spark, GRAPH), options).orderBy("page_ord").collect()
    assert [r.page_ord for r in rows] == list(range(len(rows)))
    assert [(r.url, r.depth, r.allowed, r.fetched) for r in rows] == queue_crawl(GRAPH, max_pages, max_depth)


def test_two_audits_of_one_site_stay_apart(spark):
    old = linked(spark, {"": ["/old"], "old": []})
    new = linked(spark, {"": ["/new", "/gone"], "new": []}, audit="a2")
    probe = fetches(spark, [fetch(SEED + "new", None, 9, 0, audit="a2", depth=-1, error="x")])
    pages = old.unionByName(new).unionByName(probe)
    seeds = spark.createDataFrame([("a1", SEED), ("a2", SEED)], "audit_id string, seed_url string")
    rows = CR.frontier(seeds, pages)
    assert {(r.audit_id, r.url, r.fetched) for r in rows.collect()} == {
        ("a1", SEED, True), ("a1", SEED + "old", True), ("a2", SEED, True), ("a2", SEED + "new", True), ("a2", SEED + "gone", False),
    }
    records = CR.crawl_records(rows, pages)
    assert sorted((r.audit_id, r.url, r.depth) for r in records.collect()) == [
        ("a1", SEED, 0), ("a1", SEED + "old", 1), ("a2", SEED, 0), ("a2", SEED + "new", 1),
    ]
    pooled = CR.frontier(seeds, pages, shared=True)
    assert {(r.audit_id, r.url) for r in pooled.filter("fetched").collect()} == {(a, SEED + p) for a in ("a1", "a2") for p in ("", "new")}
    assert CR.crawl_records(pooled, pages, shared=True).count() == 4


def test_frontier_with_robots_and_other_hosts(spark):
    seeds = spark.createDataFrame([("a1", SEED), ("a2", "https://two.com")], "audit_id string, seed_url string")
    pages = linked(spark, GRAPH).unionByName(linked(spark, {"": ["/x", "https://ex.com/a"], "x": []}, "https://two.com/", "a2"))
    files = spark.createDataFrame([("ex.com", 200, None, "User-agent: *\nDisallow: /b\n")], "host string, status_code int, error string, body string")
    rules = RB.rules_for_agent(RB.robots_rules(files), "crawlsight/0.1")
    rows = CR.frontier(seeds, pages, AuditOptions(), rules).cache()
    mine = rows.filter("audit_id = 'a1'").orderBy("page_ord").collect()
    assert [(r.url, r.depth, r.allowed, r.fetched) for r in mine] == queue_crawl(GRAPH, 50, 3, {"b"})
    assert {r.url for r in rows.filter("audit_id = 'a2'").collect()} == {"https://two.com/", "https://two.com/x"}
    records = CR.crawl_records(rows, pages)
    blocked = records.filter("url = 'https://ex.com/b'").first()
    assert (blocked.status_code, blocked.error, blocked.html) == (403, "Blocked by robots.txt", None)
    free = CR.frontier(seeds, pages, AuditOptions(same_host_only=False, respect_robots=False), rules, shared=True)
    assert free.filter("audit_id = 'a2' and url = 'https://ex.com/d'").count() == 1
    stats = {r.audit_id: r for r in CR.crawl_stats(records).collect()}
    assert stats["a1"].broken_count == 1 and stats["a1"].error_count == 0


def test_stats_and_errors(spark):
    rows = [
        fetch(SEED, "<a href=/a>1</a><a href=https://far.example/>2</a><a href=/a>3</a>", 0),
        fetch(SEED + "a", "<a href=/deep>x</a>", 1, depth=3),
        fetch(SEED + "gone", "<a href=/z>x</a>", 2, 404, depth=1),
        fetch(SEED + "err", None, 3, None, depth=1, error="timeout"),
        fetch(SEED + "moved", "x", 4, depth=1, redirect_chain=[("u", 301), ("v", 200)]),
        fetch("https://far.example/", None, 5, 0, depth=-1, error="HTTP 500"),
    ]
    df = fetches(spark, rows)
    stats = CR.crawl_stats(df).first()
    assert (stats.pages_crawled, stats.broken_count, stats.redirect_count, stats.error_count) == (5, 2, 1, 1)
    assert stats.pages_discovered == 4  # seed, /a, far.example, /z; the page at the depth limit is not expanded
    assert [r.line for r in CR.crawl_errors(df).collect()] == ["https://ex.com/err: timeout"]


def test_external_links_and_probes(spark):
    rows = [
        fetch(SEED, "<a href=https://x1/>1</a><a href=/in>i</a><a href=https://x2/>2</a><a href=https://x1/>1</a>", 0),
        fetch(SEED + "b", "<a href=https://x3/>3</a><a href=https://x2/>2</a>", 1, 404),
    ]
    df = fetches(spark, rows)
    work = CR.external_worklist(df)
    assert [r.url for r in work.orderBy("rank").collect()] == ["https://x1/", "https://x2/", "https://x3/"]
    assert [r.url for r in CR.external_worklist(df, 2).orderBy("rank").collect()] == ["https://x1/", "https://x2/"]
    probes = spark.createDataFrame(
        [("https://x1/", 200, None), ("https://x2/", 404, None), ("https://x3/", 0, "dns")], "url string, status_code int, error string"
    )
    bad = {r.url: r for r in CR.broken_probes(work, probes).collect()}
    assert {u: (r.error, r.status_code, r.depth) for u, r in bad.items()} == {
        "https://x2/": ("HTTP 404", 0, -1), "https://x3/": ("dns", 0, -1),
    }


FILES = {
    "one.com": "User-agent: *\nDisallow: /private\nAllow: /private/open\n",
    "two.com": "# x\nUser-agent: CrawlSight\nUser-agent: Other\nAllow: /a\nDisallow: /\n\nUser-agent: *\nDisallow:\n",
    "three.com": "Disallow: /early\nUser-agent: a\n\nUser-agent: *\nCrawl-delay: 3\n\nDisallow: /late\nUser-agent: *\nDisallow: /second",
    "four.com": "User-agent: sight\nDisallow: /caf%C3%A9 # note\nDisallow: /q?x=1\nSitemap: https://four.com/s.xml\nDisallow: /*.pdf\r\nDisallow: /tail?\n",
    "five.com": "",
    "six.com": "User-agent: *\nDisallow: /\nUser-agent: crawl\nDisallow: /only\n",
    "seven.com": "user-AGENT : *\n  disallow :  /sp ace \nnonsense\nrequest-rate: 1/5\n",
}
PATHS = [
    "", "/", "/private", "/private/open", "/a/b", "/b", "/early", "/late", "/second", "/caf%C3%A9", "/café/x", "/q?x=1&y", "/q", "/x.pdf",
    "/*.pdf", "/tail", "/only/x", "/sp%20ace", "/sp ace/x",
]


def test_robots_match_the_stdlib(spark):
    files = spark.createDataFrame([(h, 200, None, b) for h, b in FILES.items()], "host string, status_code int, error string, body string")
    urls = [f"https://{h}{p}" for h in FILES for p in PATHS]
    df = spark.createDataFrame([(u,) for u in urls], "url string")
    for agent in ("crawlsight/0.1 (+x)", "stranger"):
        rules = RB.rules_for_agent(RB.robots_rules(files), agent)
        got = {r.url: r.allowed for r in RB.gate(df, rules).collect()}
        for host, body in FILES.items():
            parser = RobotFileParser()
            parser.parse(body.splitlines())
            for path in PATHS:
                url = f"https://{host}{path}"
                assert got[url] == parser.can_fetch(agent, url), (agent, url)


@pytest.mark.parametrize("scan", [0, 3, 1000])
def test_looked_up_rules_equal_scanned_ones(spark, scan):
    """Random rules against the first one that fits, in plain Python."""
    rng = random.Random(7)

    def piece():
        return "/" + "".join(rng.choice("ab") for _ in range(rng.randrange(4)))

    rules = {f"h{n}.com": [(rng.random() < 0.5, "".join(piece() for _ in range(rng.randrange(4)))) for _ in range(n * n)] for n in range(8)}
    urls = [f"https://h{rng.randrange(9)}.com" + "".join(piece() for _ in range(rng.randrange(1, 5))) for _ in range(400)] + [None, "nothing"]
    df = spark.createDataFrame([(u, n) for n, u in enumerate(urls + urls[:50])], "url string, `rank of url` int")
    table = spark.createDataFrame(list(rules.items()), "host string, rules array<struct<allow:boolean,prefix:string>>")
    got = RB.gate(df, table, scan=scan)
    assert got.columns == ["url", "rank of url", "allowed"]
    rows = got.collect()
    assert len(rows) == len(urls) + 50
    for r in rows:
        host, _, path = (r.url or "").removeprefix("https://").partition("/")
        fits = [allow for allow, prefix in rules.get(host, []) if ("/" + path).startswith(prefix)]
        assert r.allowed == (fits[0] if fits else True), r


def test_a_host_with_many_rules_multiplies_urls_by_lengths_only(spark):
    rules = [(n % 2 == 0, f"/p{n:05d}") for n in range(20_000)]
    table = spark.createDataFrame([("big.com", rules)], "host string, rules array<struct<allow:boolean,prefix:string>>")
    df = spark.range(20_000).selectExpr("concat('https://big.com/p', lpad(id, 5, '0'), '/x') as url", "id")
    got = RB.gate(df, table)
    assert got.filter("allowed <> (id % 2 = 0)").count() == 0 and got.count() == 20_000
    plan = got._jdf.queryExecution().optimizedPlan().toString()
    assert "NestedLoop" not in plan and "Cartesian" not in plan


def test_unusable_robots_files_allow_all(spark):
    files = spark.createDataFrame(
        [("a.com", 404, None, "User-agent: *\nDisallow: /"), ("b.com", 200, "timeout", "User-agent: *\nDisallow: /")],
        "host string, status_code int, error string, body string",
    )
    rules = RB.rules_for_agent(RB.robots_rules(files), "x")
    df = spark.createDataFrame([(f"https://{h}.com/z",) for h in "abc"], "url string")
    assert [r.allowed for r in RB.gate(df, rules).collect()] == [True] * 3


def test_a_level_does_not_move_the_links(spark):
    """Without broadcasts a level's own rows are shuffled to the buckets of the links, which stay in place."""
    from crawlsight.config import AuditOptions
    from crawlsight.session import release, stage_clustered

    links = spark.range(5000).selectExpr("concat('a', id % 3) as src_audit", "id % 100 as src_ord", "concat('u', id % 100) as src", "0 as pos", "concat('u', id) as dst")
    edges = stage_clustered(links, "edges", ["src_audit", "src"])
    level = spark.range(90).selectExpr("concat('a', id % 3) as audit_id", "'u0' as seed_url", "concat('u', id) as url", "true as allowed", "id as page_ord")
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        found = CR.expanded(level, edges, AuditOptions(same_host_only=False))
        plan = found._jdf.queryExecution().executedPlan().toString()
        assert plan.count("Exchange hashpartitioning") == 1 and "Bucketed: true" in plan, plan
        assert found.count() == sum(1 for i in range(90) for j in range(5000) if j % 3 == i % 3 and j % 100 == i)
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
        release(spark)
    assert not [t for t in spark.catalog.listTables() if t.name.startswith("staged_")]
