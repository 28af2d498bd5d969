"""Empty-input contract: named columns, zero rows; KPIs all zero."""

from ledgerline.operators import cohorts, funnel, metrics, reports

TX = ("transaction_id bigint, date date, revenue decimal(18,4), expenses decimal(18,4), dept_id int, "
      "region_id int, product_id int, category_id int, client_id string")
BUD = ("budget_id bigint, month string, dept_id int, region_id int, budgeted_revenue decimal(18,4), "
       "budgeted_expenses decimal(18,4)")
INV = "invoice_id string, client_id string, issue_date date, amount decimal(18,4), status string, status_num int"


def test_empty_facts(spark):
    tx, bud = spark.createDataFrame([], TX), spark.createDataFrame([], BUD)
    dims = spark.createDataFrame([(1, "Sales")], "dept_id int, dept_name string")
    k = metrics.kpis(tx, bud).collect()
    assert len(k) == 1 and all(v == 0.0 for v in k[0])
    assert metrics.monthly_performance(tx).count() == 0
    assert metrics.department_performance(tx, bud, dims).count() == 0
    assert cohorts.revenue_cohorts(tx).count() == 0
    assert reports.report_budget_vs_actual(tx, bud, dims).where("department = 'Sales'").first()["actual_revenue"] == 0
    none = spark.createDataFrame([], INV)
    assert funnel.invoice_funnel(none).count() == funnel.invoice_funnel_theta(none).count() == 0


def test_one_empty_input(spark):
    """Each input empty alone: no rows, as with all of them empty."""
    tx = spark.sql("select date'2025-01-05' date, cast(10 as decimal(18,4)) revenue, cast(4 as decimal(18,4)) expenses,"
                   " 1 dept_id, 1 region_id, 1 product_id, 1 category_id, 'C' client_id")
    bud = spark.sql("select 1 dept_id, cast(8 as decimal(18,4)) budgeted_revenue, cast(3 as decimal(18,4)) budgeted_expenses")
    depts = spark.createDataFrame([(1, "Sales")], "dept_id int, dept_name string")
    assert metrics.department_performance(tx, bud, depts).count() == 1
    for i in range(3):
        inputs = [tx, bud, depts]
        inputs[i] = inputs[i].limit(0)
        assert metrics.department_performance(*inputs).count() == 0
    for f, key, name in ((metrics.regional_profitability, "region_id", "region_name"),
                         (metrics.product_profitability, "product_id", "product_name"),
                         (metrics.expenses_by_category, "category_id", "category_name")):
        dim = spark.createDataFrame([(2, "other")], f"{key} int, {name} string")
        assert f(tx, dim).count() == 1  # not a member: a row without a name
        assert f(tx, dim.limit(0)).count() == 0 and f(tx.limit(0), dim).count() == 0


def test_results_are_in_order(spark, sf_dir):
    """Rows come in the order the original sorts them, not only as a set."""
    import __spark_entry__ as entry

    qs = entry.queries()
    for name, keys, falling in (("department_performance", ["actual_revenue"], True), ("regional_profitability", ["net_profit"], True),
                                ("product_profitability", ["net_profit"], True), ("expenses_by_category", ["expenses"], True),
                                ("monthly_performance", ["month"], False), ("revenue_cohorts", ["cohort_month", "elapsed_months"], False)):
        rows = [tuple(r[k] for k in keys) for r in qs[name](spark, sf_dir).collect()]
        assert len(rows) > 1 and rows == sorted(rows, reverse=falling), name
    for table, key, label in (("star_dim_departments", "dept_id", "dept_name"), ("star_dim_regions", "region_id", "region_name")):
        rows = sorted((r[key], r[label]) for r in qs[table](spark, sf_dir).collect())
        assert [n for _, n in rows] == sorted(n for _, n in rows) and [i for i, _ in rows] == list(range(1, len(rows) + 1))


def test_export_report(spark, tmp_path):
    from ledgerline.sources.tables import export_report

    df = spark.createDataFrame([("Total", 1.0)], "department string, revenue double")
    export_report(df, str(tmp_path / "r"))
    back = spark.read.option("header", True).csv(str(tmp_path / "r")).collect()
    assert back[0]["department"] == "Total"
