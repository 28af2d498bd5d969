"""Order of results, a member named like the total row, audited entries in the store."""

from pyspark.sql import functions as F

from ledgerline.operators import metrics, reports
from ledgerline.plans import catalog


def test_department_named_total(spark):
    tx = spark.sql("select date'2025-01-05' date, cast(10 as decimal(18,4)) revenue, cast(4 as decimal(18,4)) expenses, 1 dept_id"
                   " union all select date'2025-02-05', 20, 5, 2")
    bud = spark.sql("select 1 dept_id, cast(8 as decimal(18,4)) budgeted_revenue, cast(3 as decimal(18,4)) budgeted_expenses")
    dims = spark.createDataFrame([(1, "Total"), (2, "Sales")], "dept_id int, dept_name string")
    rows = reports.report_overview(reports.monthly_margin(tx), reports.budget_vs_actual(tx, bud, dims)).collect()
    assert [(r.metric, r.current_value, r.target_value) for r in rows] == [
        ("Total Sales Revenue", 30.0, 8.0), ("Operational Expenses", 9.0, 3.0), ("Net Operating Profit", 21.0, 5.0)]


def test_months_are_in_order(spark):
    tx = spark.sql("select add_months(date'2025-11-01', cast(-7 * id % 23 as int)) date, cast(id as decimal(18,4)) revenue,"
                   " cast(1 as decimal(18,4)) expenses from range(200)").repartition(7)
    months = [r.month for r in metrics.monthly_performance(tx).collect()]
    assert months == sorted(months) and len(months) == 23


def test_every_issue_is_stored(spark, sf_dir):
    qs = catalog.queries()
    stored = qs["ingestion_issues"](spark, sf_dir)
    found = qs["dq_issues"](spark, sf_dir)
    assert stored.count() == found.count()
    per_rule = found.groupBy("batch_id", "rule").count().agg(F.max("count")).first()[0]
    assert per_rule > 10  # more than a listing shows
