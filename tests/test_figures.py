"""Figures kept while pages arrive equal those over all pages."""

import pytest
from helpers import SHARED_PAGE, TIDES_PAGE, fetch, fetches

from crawlsight.operators import metrics as M
from crawlsight.operators.checks import CheckRegistry, Context, duplicate_title_groups
from crawlsight.plans import audit as A
from crawlsight.streaming import arrivals as ST
from crawlsight.streaming import figures as FG


def crawl():
    rows = []
    for n in range(12):
        seed = f"https://s{n % 2}.com/"
        html = [TIDES_PAGE, SHARED_PAGE, f"<title>Page {n // 4}</title><img src=a.png>", None][n % 4]
        rows.append(fetch(f"{seed}{n}", html, n, seed=seed, audit=f"a{n % 2}"))
    gone = {"depth": -1, "error": "HTTP 404", "status_code": 0}
    return [*rows, fetch("https://far.org/", None, 0, seed="https://s0.com/", audit="a0", **gone), fetch(None, "<p>lost", 99)]


def of(df):
    columns = sorted(c for c in df.columns)
    return sorted(map(str, df.select(*columns).collect()))


@pytest.fixture(scope="module")
def whole(spark):
    rows = fetches(spark, crawl())
    return rows, A.audit_sites(rows, "2024-05-01 10:00:00")


def check(spark, root, whole):
    rows, result = whole
    tables = FG.current(spark, root)
    scores = FG.scores(tables)
    fields = ("audit_id", "seed_url", "pages", "score", "raw_penalty")
    assert of(scores.select(*fields)) == of(result.audits.select(*fields))
    ctx = Context(result.facts, result.fetches, result.options)
    assert of(FG.check_metrics(tables)) == of(M.check_metrics(ctx, CheckRegistry()))
    assert of(FG.totals(tables)) == of(result.totals())
    assert of(FG.duplicate_titles(tables)) == of(duplicate_title_groups(result.facts))


def test_batches_add_up_to_the_whole(spark, whole, tmp_path):
    root = str(tmp_path / "kept")
    rows = crawl()
    batches = [fetches(spark, part) for part in (rows[:5], rows[5:6], rows[6:])]
    with pytest.raises(FileNotFoundError):
        FG.current(spark, root)
    for k in (0, 1, 1):
        assert FG.write_batch(batches[k], k, root)
    # A batch that was cut short is not read, a base that was cut short neither.
    FG.partials(batches[2], A.page_facts(batches[2]), whole[1].options)["figures"].write.parquet(f"{root}/batch=2/figures")
    FG.current(spark, root)["figures"].write.parquet(f"{root}/base=1/figures")
    assert FG._folders(spark, root)[:2] == (-1, ["batch=0", "batch=1"])
    assert FG.fold(spark, root) == 1
    assert FG._folders(spark, root)[:2] == (1, ["base=1"])
    assert not FG.write_batch(batches[1], 1, root) and FG.write_batch(batches[2], 2, root)
    check(spark, root, whole)
    assert FG.fold(spark, root) == 2 and FG.fold(spark, root) == 2
    check(spark, root, whole)


def test_figures_of_a_stream(spark, whole, tmp_path):
    whole[0].repartition(3).write.parquet(str(tmp_path / "in"))
    arrivals = ST.read_arrivals(spark, str(tmp_path / "in"), 1)
    FG.keep_figures(arrivals, str(tmp_path / "kept"), str(tmp_path / "ckpt"), fold_every=2).awaitTermination(300)
    check(spark, str(tmp_path / "kept"), whole)
