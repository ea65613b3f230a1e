"""The store: versions, deletion, compaction, lookups by id, baselines."""

import datetime as dt
import random
import uuid

import pytest
from helpers import TIDES_PAGE, fetch, fetches
from pyspark.sql import functions as F

from crawlsight.config import AuditOptions
from crawlsight.operators import suggest as S
from crawlsight.plans import audit as A
from crawlsight.sources import store
from workload.queries import rich_audit

SITE, OTHER = "https://ex.com/", "https://other.com/"


def run_of(spark, run, title, at, seed=SITE, broken=False):
    rows = [
        fetch(seed, TIDES_PAGE, 0, audit=run, seed=seed),
        fetch(f"{seed}b", f"<title>{title}</title><h1>x</h1>", 1, audit=run, seed=seed),
        fetch(f"{seed}c", None, 2, 404 if broken else 200, audit=run, seed=seed),
    ]
    return A.audit_sites(fetches(spark, rows), at, AuditOptions(save=True))


@pytest.fixture(scope="module")
def runs(spark):
    return [
        run_of(spark, "r1", "short", "2024-05-01 10:00:00"),
        run_of(spark, "r2", "longer", "2024-05-02 10:00:00", broken=True),
        run_of(spark, "o1", "short", "2024-05-01 12:00:00", OTHER),
    ]


@pytest.fixture()
def root(runs, tmp_path):
    path = str(tmp_path / "store")
    for k, result in enumerate(runs):
        A.persist(result, path, f"2024-05-0{k + 1} 11:00:00")
    return path


def stored(spark, root):
    """Everything that readers see, without the versions."""
    audits = store.load(spark, f"{root}/audits")
    out = {"audits": audits}
    for name in ("issues", "page_facts", "records"):
        out[name] = store.belonging(spark, f"{root}/{name}", audits)
    return {k: sorted(map(str, v.drop("saved_at").select(*sorted(c for c in v.columns if c != "saved_at")).collect())) for k, v in out.items()}


def issues_of(spark, root):
    return spark.read.parquet(f"{root}/issues")


def diffs_of(result):
    return {r.current_audit_id: r for r in result.diffs.collect()}


# --- baselines --------------------------------------------------------------


def test_an_audit_is_not_its_own_baseline(spark, runs, root):
    first, second, _ = runs
    A.compare_audits(second, first.audits, first.issues)
    before = diffs_of(second)["r2"]
    A.compare_audits(second, store.load(spark, f"{root}/audits"), issues_of(spark, root))
    after = diffs_of(second)["r2"]
    assert before == after and after.previous_audit_id == "r1" and after.new_issues == 2
    assert second.new_issues.count() == 2 == second.resolved_issues.count()


def test_given_baselines(spark, runs, root):
    audits, issues = store.load(spark, f"{root}/audits"), issues_of(spark, root)
    both = spark.createDataFrame([("r2", "r2"), ("o1", "gone")], "audit_id string, previous_audit_id string")
    A.compare_audits(runs[1], audits, issues, both)
    same = diffs_of(runs[1])["r2"]
    assert (same.previous_audit_id, same.new_issues, same.resolved_issues) == ("r2", 0, 0)
    A.compare_audits(runs[2], audits, issues, both)
    assert not diffs_of(runs[2])["o1"].has_baseline
    A.compare_audits(runs[1], audits, issues, both.filter("false"))
    assert not diffs_of(runs[1])["r2"].has_baseline


def test_replaced_issues_do_not_count(spark, runs, root):
    first = runs[0]
    extra = first.issues.limit(1).withColumn("message", F.lit("stale"))
    store.save(extra.withColumn("saved_at", F.expr("timestamp '2024-04-01 00:00:00'")), f"{root}/issues")
    A.compare_audits(first, store.load(spark, f"{root}/audits"), issues_of(spark, root), spark.sql("select 'r1' audit_id, 'r1' previous_audit_id"))
    assert diffs_of(first)["r1"].resolved_issues == 0
    listing = store.listing(store.load(spark, f"{root}/audits"), issues_of(spark, root), spark.read.parquet(f"{root}/page_facts"))
    assert {r.audit_id: r.issue_count for r in listing.collect()}["r1"] == first.issues.count()


def test_one_baseline_for_several_audits(spark, runs):
    first, second, _ = runs
    audits = first.audits.unionByName(second.audits)
    both = A.AuditResult(AuditOptions(), first.registry, first.fetches, first.facts, first.issues.unionByName(second.issues), audits)
    pairs = spark.createDataFrame([("r1", "r1"), ("r2", "r1")], "audit_id string, previous_audit_id string")
    A.compare_audits(both, audits, both.issues, pairs)
    got = diffs_of(both)
    assert (got["r1"].new_issues, got["r1"].resolved_issues, got["r2"].new_issues, got["r2"].resolved_issues) == (0, 0, 2, 2)
    assert both.new_issues.filter("current_audit_id = 'r1'").isEmpty()


def test_comparison_takes_one_exchange_per_side(spark, runs, root):
    from crawlsight.operators import diff as D

    pairs = spark.createDataFrame([("r2", "r1")], "current_audit_id string, previous_audit_id string").hint("broadcast")
    plan = D.changes(runs[1].issues, runs[0].issues, pairs)._jdf.queryExecution().optimizedPlan().toString()
    physical = D.changes(runs[1].issues, runs[0].issues, pairs)._jdf.queryExecution().sparkPlan().toString()
    assert plan.count("Window") <= 2 and "SortMergeJoin" not in physical and physical.count("Union") == 1


@pytest.mark.parametrize("known", [True, False])
def test_baselines_as_of(spark, known):
    dice = random.Random(11)
    start = dt.datetime(2024, 1, 1)
    history = []
    for n in range(160):
        at = start + dt.timedelta(hours=dice.choice([0, 3, 9, 15, 15]), days=dice.choice([0, 0, 1, 4, 9]))
        history.append((f"h{n:03}", f"https://s{dice.randrange(6)}.com/", at))
    current = dice.sample(history, 60)
    if not known:  # an id that is stored under another time, and ids that are not stored
        current = [(i if k % 2 else f"c{i}", s, t + dt.timedelta(minutes=dice.choice([0, 1, 2000]))) for k, (i, s, t) in enumerate(current)]
    schema = "audit_id string, seed_url string, created_at timestamp"
    got = store.baselines(spark.createDataFrame(current, schema), spark.createDataFrame(history, schema), as_of=True)
    got = {r.audit_id: r.previous_audit_id for r in got.collect()}
    want = {}
    for i, s, t in current:
        earlier = [(u, j) for j, v, u in history if v == s and j != i and (u, j) < (t, i)]
        want[i] = max(earlier)[1] if earlier else None
    assert got == want


# --- deletion and compaction ------------------------------------------------


def test_deletion_takes_all_that_belongs_to_an_audit(spark, runs, root):
    before = stored(spark, root)
    A.persist(runs[0], root, "2024-05-09 11:00:00")  # a second version
    assert stored(spark, root) == before
    assert A.delete_audit(spark, root, "r1") and not A.delete_audit(spark, root, "r1")
    after = stored(spark, root)
    assert {k: len(v) for k, v in after.items()} == {k: sum("r1'" not in x for x in v) for k, v in before.items()}
    assert all("audit_id='r1'" not in x for v in after.values() for x in v)
    A.persist(runs[0], root, "2024-05-10 11:00:00")  # saved again
    assert stored(spark, root) == before
    ids = spark.createDataFrame([("r1",), ("o1",), ("none",)], "audit_id string")
    assert store.delete_all(spark, f"{root}/audits", ids) == 2
    assert [r.audit_id for r in store.load(spark, f"{root}/audits").collect()] == ["r2"]


def test_compaction_keeps_what_is_current(spark, runs, root):
    A.persist(runs[0], root, "2024-05-09 11:00:00")
    A.delete_audit(spark, root, "o1")
    before = stored(spark, root)
    assert len(A.compact_store(spark, root)) == 2
    assert stored(spark, root) == before
    assert spark.read.parquet(f"{root}/audits").count() == 2
    assert spark.read.parquet(f"{root}/issues").count() == len(before["issues"])
    assert A.compact_store(spark, root) == []


class Stop(Exception):
    pass


def test_compaction_may_stop_anywhere(spark, tmp_path):
    """Small tables: two versions of one audit, a deleted one and rows of a save that never ended."""

    def save(root, run, at, issues, audit=True):
        own = f"select '{run}' audit_id, 'https://{run[0]}.com/' seed_url, timestamp '2024-01-{at:02}' saved_at"
        store.save(spark.sql(f"{own}, explode(sequence(1, {issues})) n"), f"{root}/issues")
        if audit:
            store.save_audits(spark.sql(own), f"{root}/audits")

    def seen(root):
        audits = store.load(spark, f"{root}/audits")
        rows = store.belonging(spark, f"{root}/issues", audits).groupBy("audit_id").count()
        return sorted(r.audit_id for r in audits.collect()), sorted(map(tuple, rows.collect()))

    for k in range(5):
        root = str(tmp_path / f"s{k}")
        save(root, "r1", 1, 3)
        save(root, "r1", 2, 5)
        save(root, "o1", 1, 2)
        save(root, "p1", 1, 4)
        save(root, "p1", 3, 9, audit=False)
        store.delete(spark, f"{root}/audits", "o1")
        want, steps = (["p1", "r1"], [("p1", 4), ("r1", 5)]), []

        def after(step):
            steps.append(step)
            if len(steps) - 1 == k:
                raise Stop

        with pytest.raises(Stop):
            store.compact(spark, f"{root}/audits", [f"{root}/issues"], after)
        assert seen(root) == want, steps
        store.compact(spark, f"{root}/audits", [f"{root}/issues"])
        assert seen(root) == want, steps
        assert spark.read.parquet(f"{root}/audits").count() == 2 and spark.read.parquet(f"{root}/issues").count() == 9
        assert store.compact(spark, f"{root}/audits", [f"{root}/issues"]) == []
    assert steps[-1] == "clear deleted"


def test_a_save_that_stops_is_not_seen(spark, runs, root, monkeypatch):
    before = stored(spark, root)

    def fail(*_):
        raise Stop

    monkeypatch.setattr(store, "save_audits", fail)
    with pytest.raises(Stop):
        A.persist(runs[0], root, "2024-06-01 00:00:00")
    monkeypatch.undo()
    assert stored(spark, root) == before
    A.compact_store(spark, root)
    assert stored(spark, root) == before
    assert spark.read.parquet(f"{root}/issues").count() == len(before["issues"])


# --- stored audits ----------------------------------------------------------


def lines_of(df):
    return [tuple(r) for r in df.orderBy("audit_id", "section_ord", "item_ord", "line").collect()]


def test_reports_of_stored_audits(spark, tmp_path):
    root = str(tmp_path / "whole")
    first, second = run_of(spark, "r1", "short", "2024-05-01 10:00:00"), run_of(spark, "r2", "longer", "2024-05-02 10:00:00", broken=True)
    A.persist(first, root, "2024-05-01 11:00:00")
    A.compare_audits(second, store.load(spark, f"{root}/audits"), issues_of(spark, root))
    raw = [("r2", "u0", 0, '{"improved_title": "New"}', None), ("r2", "u1", 1, "no json", None)]
    A.with_suggestions(second, spark.createDataFrame(raw, "audit_id string, url string, page_ord long, raw string, error string"))
    A.persist(second, root, "2024-05-02 11:00:00")
    for result, run in ((first, "r1"), (second, "r2")):
        for args in (("markdown", True), ("json",), ("json", False, True)):
            got = lines_of(A.report_stored(spark, root, run, *args))
            assert got == lines_of(A.report(result, *args)), (run, args)
    back = A.stored_result(spark, root, "r2")
    assert lines_of(A.change_report(back, "json")) == lines_of(A.change_report(second, "json"))
    with pytest.raises(KeyError):
        A.report_stored(spark, root, "none")
    A.delete_audit(spark, root, "r2")
    with pytest.raises(KeyError):
        A.report_stored(spark, root, "r2")
    A.compact_store(spark, root)
    assert lines_of(A.report_stored(spark, root, "r1")) == lines_of(A.report(first))


def test_lookups_by_id_read_one_bucket(spark, root):
    found = store.find(spark, f"{root}/audits", "r2")
    assert found.first().audit_id == "r2" and store.find(spark, f"{root}/audits", uuid.uuid4().hex).isEmpty()
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(seed_bucket" in plan or "PartitionFilters: [(seed_bucket" in plan, plan
    issues = store.belonging(spark, f"{root}/issues", found)._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(seed_bucket" in issues or "PartitionFilters: [(seed_bucket" in issues, issues


def test_records_of_a_run_do_not_read_the_pages_again(spark):
    records = rich_audit(spark, "/root/testdata/sf0.001").fetches
    assert "html" not in records.columns
    assert records.inputFiles() and all("/staged-" in file for file in records.inputFiles())


def test_audits_of_a_saved_run_are_staged(spark, tmp_path):
    """Looking up an id, comparing and reporting after a save do not count the issues again."""
    result = run_of(spark, "s1", "short", "2024-05-01 10:00:00")
    want = result.audits.collect()
    A.persist(result, str(tmp_path / "store"), "2024-05-01 11:00:00")
    files = result.audits.inputFiles()
    assert files and all("/audits-" in file for file in files)
    assert result.audits.collect() == want
