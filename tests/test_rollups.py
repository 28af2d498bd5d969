"""Rollups of the store's segments: exact at every state, computed once a segment."""

import pytest
from test_store import HEADER, plan, store, upload  # noqa: F401 - a fixture

from ledgerline.operators import bi, cohorts, metrics, reports
from ledgerline.plans import jobs, rollups
from ledgerline.sources import files, tables


def rows(df):
    return sorted(map(str, df.collect()))


def check_equal(spark, root):
    """Every query answers from the rollups as it does from the fact."""
    star = tables.read_star(spark, root)
    fact, cells, clients = star.fact_transactions, rollups.cells(spark, root), rollups.client_months(spark, root)
    dims = {k: v for k, v in star.tables().items() if k.startswith("dim_")}
    for ask in (lambda f: metrics.kpis(f, star.fact_budgets), metrics.monthly_performance,
                lambda f: metrics.regional_profitability(f, star.dim_regions),
                lambda f: metrics.product_profitability(f, star.dim_products),
                lambda f: metrics.expenses_by_category(f, star.dim_expense_categories), reports.report_monthly_margin,
                lambda f: bi.measures(f, dims, by=["department", "quarter"], slicers={"region": ["N", "E"], "year": [2024]})):
        assert rows(ask(cells)) == rows(ask(fact))
    for ask in (cohorts.revenue_cohorts, cohorts.cohort_sizes, bi.net_revenue_retention):
        assert rows(ask(clients)) == rows(ask(fact))
    assert (cells.groupBy().sum("n_rows").first()[0] or 0) == fact.count()


def ingest(spark, root, path):
    assert jobs.ingest_file(spark, path, root, as_of="2025-12-31", submitted_at="2025-12-31 00:00:00")["status"] == "Accepted"


def test_each_segment_is_summed_once(spark, store, tmp_path, monkeypatch):  # noqa: F811
    check_equal(spark, store)  # nothing rolled up yet: all from the fact
    first = rollups.refresh(spark, store)
    assert list(first.rollups.values()) == [first.facts]
    check_equal(spark, store)
    ingest(spark, store, upload(tmp_path, "u.csv", 5, "New"))
    check_equal(spark, store)  # the new segment from the fact, the others from the rollup
    read = []
    plain = tables.segments

    def watched(spark, root, name, names):
        if name == tables.SEGMENTED:
            read.append(list(names))
        return plain(spark, root, name, names)

    monkeypatch.setattr(tables, "segments", watched)
    second = rollups.refresh(spark, store)
    new = [s for s in second.facts if s not in first.facts]
    assert len(new) == 1 and read and all(names == new for names in read)
    assert list(second.rollups.values()) == [first.facts, new] and set(first.rollups) < set(second.rollups)
    read.clear()
    cells = rollups.cells(spark, store)
    assert rollups.refresh(spark, store) == second and not read  # all covered: no fact row is read
    assert all("rollup_cells" in f for f in cells.inputFiles())
    monkeypatch.undo()
    check_equal(spark, store)


def test_many_rollups_become_one(spark, store, tmp_path):  # noqa: F811
    for i in range(3):
        rollups.refresh(spark, store, merge_over=2)
        ingest(spark, store, upload(tmp_path, f"u{i}.csv", i + 2, f"P{i % 2}"))
    at = rollups.refresh(spark, store, merge_over=2)
    assert len(at.rollups) <= 2 and sorted(s for names in at.rollups.values() for s in names) == sorted(at.facts)
    check_equal(spark, store)


def test_other_commits_come_between(spark, store, tmp_path, monkeypatch):  # noqa: F811
    """An upload committed while a refresh writes: the rollup stays valid for what it summed, and both are kept."""
    plain, done = tables.commit, []

    def late(spark, root, base, **changes):
        if "rollups" in changes and not done:
            done.append(1)
            ingest(spark, store, upload(tmp_path, "between.csv", 4, "Other"))
        return plain(spark, root, base, **changes)

    monkeypatch.setattr(tables, "commit", late)
    at = rollups.refresh(spark, store)
    assert done and len(at.facts) == 2 and list(at.rollups.values()) == [at.facts[:1]]
    assert rollups.uncovered(at) == at.facts[1:]
    check_equal(spark, store)


def test_two_refreshes_count_once(spark, store, monkeypatch):  # noqa: F811
    plain, done = tables.commit, []

    def late(spark, root, base, **changes):
        if not done:
            done.append(1)
            rollups.refresh(spark, store)
        return plain(spark, root, base, **changes)

    monkeypatch.setattr(tables, "commit", late)
    at = rollups.refresh(spark, store)
    assert list(at.rollups.values()) == [at.facts]
    check_equal(spark, store)


def test_a_new_load_drops_them(spark, store, tmp_path):  # noqa: F811
    old = rollups.refresh(spark, store)
    (tmp_path / "empty.csv").write_text(HEADER)
    (tmp_path / "b.csv").write_text("Month,Department,Region,Budgeted Revenue,Budgeted Expenses\n")
    jobs.init_load(spark, store, files.read_transactions(spark, str(tmp_path / "empty.csv")),
                   files.read_budgets(spark, str(tmp_path / "b.csv")), files.read_invoices(spark, None))
    assert tables.head(spark, store).rollups == {} and rollups.cells(spark, store).count() == 0
    rollups.refresh(spark, store)
    check_equal(spark, store)
    assert rollups.cells(spark, store, old).groupBy().sum("n_rows").first()[0] == 49  # plans of the old commit still read


def test_refresh_needs_a_store(spark, tmp_path):
    with pytest.raises(ValueError, match="load it first"):
        rollups.refresh(spark, str(tmp_path / "none"))


def test_months_reach_the_rollup_scan(spark, store):  # noqa: F811
    rollups.refresh(spark, store)
    got = rollups.cells(spark, store).where(tables.in_months("2024-01", "2024-03"))
    assert "period" in plan(got).split("PushedFilters:")[1].split("ReadSchema")[0]
