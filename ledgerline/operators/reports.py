"""Report tables (the spreadsheet reports, read as queries).

Each report aggregates the fact once by its key, then looks the key up from
the dimension side ("dimension-driven": exactly the dimension's members, in
its order, zero when a member has no facts) and adds the grand-total row
with ``rollup`` over the per-member rows -- a handful of rows.  Ratios use
the spreadsheet's ``IF(b=0, 0, a/b)`` (no sign test).
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.numeric import as_double, attach_scalar, dec_sum, frac
from .metrics import monthly_totals

TOTAL = "Total"


def _label(key: str) -> F.Column:
    """Member name, or the Total label on the rollup's grand-total row (g = 1)."""
    return F.when(F.col("g") == 1, F.lit(TOTAL)).otherwise(F.col(key))


def report_monthly_margin(fact_tx: DataFrame) -> DataFrame:
    """The monthly report, see ``monthly_margin``."""
    return monthly_margin(fact_tx).orderBy("g", "month").drop("g")


def monthly_margin(fact_tx: DataFrame) -> DataFrame:
    """Per month (ascending): revenue, expenses, net, margin, running revenue;
    plus the Total row (running total blank), which ``g`` = 1 marks."""
    m = monthly_totals(fact_tx)
    r = m.rollup("month").agg(dec_sum("revenue").alias("revenue"), dec_sum("expenses").alias("expenses"),
                              F.grouping("month").alias("g"))
    run = F.sum("revenue").over(Window.partitionBy("g").orderBy("month")
                                .rowsBetween(Window.unboundedPreceding, Window.currentRow))
    net = F.col("revenue") - F.col("expenses")
    return r.select(
        F.when(F.col("g") == 1, F.lit(TOTAL)).otherwise(F.col("month")).alias("month"),
        as_double("revenue").alias("revenue"),
        as_double("expenses").alias("expenses"),
        as_double(net).alias("net_profit"),
        frac(net, F.col("revenue"), positive_only=False).alias("profit_margin"),
        F.when(F.col("g") == 0, as_double(run)).alias("running_total_revenue"),
        "g",
    )


def _member_ids(dim: DataFrame, id_col: str, name_col: str) -> DataFrame:
    """Named members; a name listed twice resolves to its first id."""
    return (dim.where(F.col(name_col).isNotNull() & (F.col(name_col) != ""))
            .groupBy(name_col).agg(F.min(id_col).alias(id_col)))


def _dim_driven(dim: DataFrame, id_col: str, name_col: str, facts: list[tuple[DataFrame, dict[str, str]]]
                ) -> DataFrame:
    rows = _member_ids(dim, id_col, name_col)
    for fact, cols in facts:
        agg = (fact.where(F.col(id_col).isNotNull()).groupBy(id_col)
               .agg(*[dec_sum(src).alias(dst) for dst, src in cols.items()]))
        rows = rows.join(agg, id_col, "left")
    return rows.na.fill(0)


def report_budget_vs_actual(fact_tx: DataFrame, fact_budgets: DataFrame, dim_departments: DataFrame) -> DataFrame:
    """The budget report, see ``budget_vs_actual``."""
    return budget_vs_actual(fact_tx, fact_budgets, dim_departments).orderBy("g", "o").drop("g", "o")


def budget_vs_actual(fact_tx: DataFrame, fact_budgets: DataFrame, dim_departments: DataFrame) -> DataFrame:
    """Per department (order ``o``) and in total, which ``g`` = 1 marks: a member may itself be named Total."""
    per = _dim_driven(dim_departments, "dept_id", "dept_name", [
        (fact_tx, {"ar": "revenue", "ae": "expenses"}),
        (fact_budgets, {"br": "budgeted_revenue", "be": "budgeted_expenses"})])
    r = per.rollup("dept_name").agg(*[dec_sum(c).alias(c) for c in ("ar", "br", "ae", "be")],
                                     F.min("dept_id").alias("o"), F.grouping("dept_name").alias("g"))
    return r.select(
        _label("dept_name").alias("department"),
        as_double("ar").alias("actual_revenue"),
        as_double("br").alias("budget_revenue"),
        as_double(F.col("ar") - F.col("br")).alias("revenue_variance"),
        as_double("ae").alias("actual_expenses"),
        as_double("be").alias("budget_expenses"),
        as_double(F.col("be") - F.col("ae")).alias("expense_variance"),
        "g", "o",
    )


def _segment(fact_tx: DataFrame, dim: DataFrame, id_col: str, name_col: str, label: str) -> DataFrame:
    per = _dim_driven(dim, id_col, name_col, [(fact_tx, {"rev": "revenue", "exp": "expenses"})])
    r = per.rollup(name_col).agg(dec_sum("rev").alias("rev"), dec_sum("exp").alias("exp"),
                                 F.min(id_col).alias("o"), F.grouping(name_col).alias("g"))
    net = F.col("rev") - F.col("exp")
    return r.select(
        _label(name_col).alias(label),
        as_double("rev").alias("revenue"),
        as_double("exp").alias("expenses"),
        as_double(net).alias("net_profit"),
        frac(net, F.col("rev"), positive_only=False).alias("margin"),
        "g", "o",
    ).orderBy("g", "o").drop("g", "o")


def report_segment_region(fact_tx: DataFrame, dim_regions: DataFrame) -> DataFrame:
    return _segment(fact_tx, dim_regions, "region_id", "region_name", "region")


def report_segment_product(fact_tx: DataFrame, dim_products: DataFrame) -> DataFrame:
    return _segment(fact_tx, dim_products, "product_id", "product_name", "product_line")


def report_kpi_cards(monthly_margin: DataFrame) -> DataFrame:
    """The three cards read the grand-total row of the monthly report."""
    t = monthly_margin.where(F.col("g") == 1)
    return t.select(F.col("revenue").alias("total_revenue"), F.col("net_profit").alias("total_net_profit"),
                    F.col("profit_margin").alias("net_profit_margin"))


def report_overview(monthly_margin: DataFrame, budget_vs_actual: DataFrame) -> DataFrame:
    """Actual vs target for revenue (actual - budget), expenses (budget -
    actual) and net profit (actual - budgeted profit)."""
    m = monthly_margin.where(F.col("g") == 1).select("revenue", "expenses", "net_profit")
    b = budget_vs_actual.where(F.col("g") == 1).select("budget_revenue", "budget_expenses")
    one = attach_scalar(m, b)  # the two grand-total rows
    rows = F.array(
        F.struct(F.lit(1).alias("o"), F.lit("Total Sales Revenue").alias("metric"),
                 F.col("revenue").alias("current_value"), F.col("budget_revenue").alias("target_value"),
                 (F.col("revenue") - F.col("budget_revenue")).alias("variance")),
        F.struct(F.lit(2).alias("o"), F.lit("Operational Expenses").alias("metric"),
                 F.col("expenses").alias("current_value"), F.col("budget_expenses").alias("target_value"),
                 (F.col("budget_expenses") - F.col("expenses")).alias("variance")),
        F.struct(F.lit(3).alias("o"), F.lit("Net Operating Profit").alias("metric"),
                 F.col("net_profit").alias("current_value"),
                 (F.col("budget_revenue") - F.col("budget_expenses")).alias("target_value"),
                 (F.col("net_profit") - (F.col("budget_revenue") - F.col("budget_expenses"))).alias("variance")),
    )
    return (one.select(F.explode(rows).alias("r")).select("r.*").orderBy("o")
            .select("metric", F.round("current_value", 4).alias("current_value"),
                    F.round("target_value", 4).alias("target_value"), F.round("variance", 4).alias("variance")))
