"""§2.13 semantics on literal rows: null group keys, dim-driven vs fact-driven."""

import datetime as dt
from decimal import Decimal

from ledgerline.operators import metrics, reports

TX = ("transaction_id bigint, date date, revenue decimal(18,4), expenses decimal(18,4), dept_id int, "
      "region_id int, product_id int, category_id int, client_id string")
BUD = ("budget_id bigint, month string, dept_id int, region_id int, budgeted_revenue decimal(18,4), "
       "budgeted_expenses decimal(18,4)")
D = dt.date(2025, 1, 1)


def _d(x):
    return Decimal(str(x))


def test_null_keys_dropped_per_dimension_but_counted_in_kpis(spark):
    tx = spark.createDataFrame([(1, D, _d(100), _d(10), 1, 1, 1, 1, "a"),
                                (2, D, _d(50), _d(5), None, 1, 1, 1, "b")], TX)
    bud = spark.createDataFrame([(1, "2025-01", 1, 1, _d(80), _d(8))], BUD)
    dims = spark.createDataFrame([(1, "Sales"), (2, "HR")], "dept_id int, dept_name string")
    assert metrics.kpis(tx, bud).first()["total_revenue"] == 150.0
    rows = metrics.department_performance(tx, bud, dims).collect()
    assert [(r["department"], r["actual_revenue"]) for r in rows] == [("Sales", 100.0)]


def test_fact_driven_vs_dim_driven(spark):
    # dept 3 has facts but is not in the dimension; dept 2 (HR) has no facts at all
    tx = spark.createDataFrame([(1, D, _d(100), _d(10), 1, 1, 1, 1, "a"),
                                (2, D, _d(70), _d(7), 3, 1, 1, 1, "b")], TX)
    bud = spark.createDataFrame([(1, "2025-01", 1, 1, _d(80), _d(8))], BUD)
    dims = spark.createDataFrame([(1, "Sales"), (2, "HR")], "dept_id int, dept_name string")
    fact_driven = {r["department"]: r["actual_revenue"]
                   for r in metrics.department_performance(tx, bud, dims).collect()}
    assert fact_driven == {"Sales": 100.0, None: 70.0}           # seen in facts, name null if not in dim
    dim_driven = {r["department"]: r["actual_revenue"]
                  for r in reports.report_budget_vs_actual(tx, bud, dims).collect()}
    assert dim_driven == {"Sales": 100.0, "HR": 0.0, "Total": 100.0}  # exactly the dim's members + total


def test_growth_first_month_zero_and_zero_previous_null(spark):
    tx = spark.createDataFrame([(1, dt.date(2025, 1, 5), _d(0), _d(1), 1, 1, 1, 1, ""),
                                (2, dt.date(2025, 2, 5), _d(10), _d(1), 1, 1, 1, 1, ""),
                                (3, dt.date(2025, 3, 5), _d(15), _d(1), 1, 1, 1, 1, "")], TX)
    g = {r["month"]: r["rev_growth_pct"] for r in metrics.monthly_performance(tx).collect()}
    assert g == {"2025-01": 0.0, "2025-02": None, "2025-03": 50.0}


def test_measures_push_their_filter_and_sum_by_id_first(spark, sf_dir):
    from ledgerline.plans.catalog import queries

    plan = queries()["bi_core_measures_filtered"](spark, sf_dir)._jdf.queryExecution().executedPlan().toString()
    assert "GreaterThanOrEqual(date,1996-01-01)" in plan and "LessThanOrEqual(date,1996-12-31)" in plan
    assert "period" in plan.split("PartitionFilters:")[1].split("PushedFilters")[0]  # files of other months are not read
    top = queries()["product_profitability"](spark, sf_dir)._jdf.queryExecution().executedPlan().toString()
    assert "Window" not in top
