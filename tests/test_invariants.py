"""Cross-query invariants on the fixture star schema."""

import pytest

import __spark_entry__ as entry


@pytest.fixture(scope="module")
def q(spark, sf_dir):
    qs = entry.queries()
    return lambda name: qs[name](spark, sf_dir).collect()


def test_months_sum_to_kpi(q):
    k = q("kpis")[0]
    months = q("monthly_performance")
    assert sum(r["revenue"] for r in months) == pytest.approx(k["total_revenue"], rel=1e-12)


def test_contribution_and_shares_sum_to_100(q):
    assert sum(r["profit_contribution_pct"] for r in q("product_profitability")) == pytest.approx(100, abs=0.05)
    assert sum(r["expense_share_pct"] for r in q("expenses_by_category")) == pytest.approx(100, abs=0.05)


def test_retention_base_is_100(q):
    for r in q("revenue_cohorts"):
        if r["elapsed_months"] == 0:
            assert r["revenue_retention_pct"] == 100.0 and r["client_retention_pct"] == 100.0


def test_funnel_non_increasing_and_paths_agree(q):
    f = q("invoice_funnel")
    counts = [r["invoice_count"] for r in sorted(f, key=lambda r: r["stage"])]
    assert counts == sorted(counts, reverse=True)
    assert sorted(map(tuple, f)) == sorted(map(tuple, q("invoice_funnel_theta")))


def test_report_totals(q):
    rows = q("report_segment_region")
    total = [r for r in rows if r["region"] == "Total"][0]
    assert sum(r["revenue"] for r in rows if r["region"] != "Total") == pytest.approx(total["revenue"])


def test_upload_verdicts_cover_all_outcomes(q):
    by_status = {}
    for r in q("ingest_verdict"):
        by_status.setdefault(r["status"], []).append(r["batch_id"])
    assert sorted(by_status["Needs Review"]) == [10, 20]          # garbage amounts on those days
    assert sorted(by_status["Rejected"]) == [26, 27, 28, 29, 30]  # every row dated after as_of
    assert len(by_status["Accepted"]) == 23


def test_names_are_not_carried_through_the_sort(spark, sf_dir):
    """The numbered facts are sorted with their ids: neither names nor the order's columns are written again."""
    from ledgerline.operators import star
    from ledgerline.session import materialize
    from ledgerline.sources import fixtures

    raw = materialize(fixtures.raw_transactions(spark, sf_dir), "raw")
    dims = star.dimensions(raw, fixtures.raw_budgets(spark, sf_dir))
    facts = star.fact_transactions(raw, dims)
    files = [f for f in facts.inputFiles() if "ledgerline-sorted" in f]
    written = set(spark.read.parquet(*files).columns)
    assert written == set(facts.columns) - {"transaction_id"}


def test_upload_rows_are_joined_once(spark, sf_dir):
    """The numbering and the stream's files read the written upload rows."""
    from ledgerline.plans.context import Finance

    f = Finance.of(spark, sf_dir)
    assert "Join" not in f.upload_raw._jdf.queryExecution().optimizedPlan().toString()
    assert f.upload_raw is f.upload_raw and f.upload_raw.columns == f.raw_upload.columns
