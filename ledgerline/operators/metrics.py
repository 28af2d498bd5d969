"""Executive and profitability queries over the star schema.

Every query aggregates the fact first (partial + final hash aggregate, so
the shuffle carries one row per key per map task) and only then joins the
dimension for names.  Windows run over the months only; totals are one-row
aggregates attached to every row.  Null group keys are dropped, as the
original group-bys do.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.numeric import as_double, attach_scalar, dec_sum, money, pct, ratio


def kpis(fact_tx: DataFrame, fact_budgets: DataFrame) -> DataFrame:
    """Seven headline values (fractions, unrounded) in one row."""
    z = F.lit(None).cast("decimal(18,4)")
    both = (fact_tx.select(F.col("revenue").alias("r"), F.col("expenses").alias("e"), z.alias("b"))
            .unionByName(fact_budgets.select(z.alias("r"), z.alias("e"), F.col("budgeted_revenue").alias("b")))
            .agg(dec_sum("r").alias("rev"), dec_sum("e").alias("exp"), dec_sum("b").alias("brev")))  # one pass
    net = F.col("rev") - F.col("exp")
    var = F.col("rev") - F.col("brev")
    return both.select(
        as_double("rev").alias("total_revenue"),
        as_double("exp").alias("total_expenses"),
        as_double(net).alias("net_profit"),
        ratio(net, F.col("rev")).alias("profit_margin"),
        ratio(net, F.col("exp")).alias("roi"),
        as_double(var).alias("budget_variance"),
        ratio(var, F.col("brev")).alias("budget_variance_pct"),
    )


def monthly_totals(fact_tx: DataFrame) -> DataFrame:
    """Exact revenue / expenses per month (rows without a date are skipped)."""
    return (fact_tx.where(F.col("date").isNotNull())
            .groupBy(F.date_format("date", "yyyy-MM").alias("month"))
            .agg(dec_sum("revenue").alias("revenue"), dec_sum("expenses").alias("expenses")))


def monthly_performance(fact_tx: DataFrame) -> DataFrame:
    """Per month: revenue, expenses, net profit, running revenue, growth % on
    the previous *present* month (first month 0.0, zero previous -> NULL)."""
    m = monthly_totals(fact_tx)
    w = Window.orderBy("month")  # over months, not fact rows
    prev = F.lag("revenue").over(w)
    growth = F.when(prev.isNull(), F.lit(0.0)).otherwise(
        F.round(F.try_divide((F.col("revenue") - prev).cast("double"), prev.cast("double")) * 100.0, 2) + 0.0)
    return m.select(
        "month",
        as_double("revenue").alias("revenue"),
        as_double("expenses").alias("expenses"),
        money(F.col("revenue") - F.col("expenses")).alias("net_profit"),
        money(F.sum("revenue").over(w.rowsBetween(Window.unboundedPreceding, Window.currentRow)))
        .alias("running_total_revenue"),
        growth.alias("rev_growth_pct"),
    ).orderBy("month")


def _by_key(fact: DataFrame, key: str, cols: dict[str, str]) -> DataFrame:
    return (fact.where(F.col(key).isNotNull()).groupBy(key)
            .agg(*[dec_sum(src).alias(dst) for dst, src in cols.items()]))


def _if_any(df: DataFrame, *inputs: DataFrame) -> DataFrame:
    """``df``, or no rows where one of ``inputs`` is empty: a row of each is looked for, no more."""
    for other in inputs:
        some = other.select(F.lit(1).alias("_some")).limit(1)
        df = df.join(some, F.lit(True), "left_semi")
    return df


def department_performance(fact_tx: DataFrame, fact_budgets: DataFrame, dim_departments: DataFrame) -> DataFrame:
    """Actual vs budget per department; departments seen in either fact
    (full outer join of the two pre-aggregates), name null if not in the dim.
    No rows where an input is empty."""
    actuals = _by_key(fact_tx, "dept_id", {"actual_revenue": "revenue", "actual_expenses": "expenses"})
    budgets = _by_key(fact_budgets, "dept_id",
                      {"budget_revenue": "budgeted_revenue", "budget_expenses": "budgeted_expenses"})
    merged = _if_any(actuals.join(budgets, "dept_id", "full_outer").na.fill(0), fact_tx, fact_budgets, dim_departments)
    named = merged.join(dim_departments, "dept_id", "left")
    return named.select(
        F.col("dept_name").alias("department"),
        money("actual_revenue").alias("actual_revenue"),
        money("budget_revenue").alias("budget_revenue"),
        money(F.col("actual_revenue") - F.col("budget_revenue")).alias("revenue_variance"),
        money("actual_expenses").alias("actual_expenses"),
        money("budget_expenses").alias("budget_expenses"),
        money(F.col("budget_expenses") - F.col("actual_expenses")).alias("expense_variance"),
    ).orderBy(F.desc("actual_revenue"), "department")


def regional_profitability(fact_tx: DataFrame, dim_regions: DataFrame) -> DataFrame:
    """Revenue, expenses and profit by region; no rows where an input is empty."""
    agg = _if_any(_by_key(fact_tx, "region_id", {"revenue": "revenue", "expenses": "expenses"}), dim_regions)
    named = agg.join(dim_regions, "region_id", "left")
    net = F.col("revenue") - F.col("expenses")
    return named.select(
        F.col("region_name").alias("region"),
        money("revenue").alias("revenue"),
        money("expenses").alias("expenses"),
        money(net).alias("net_profit"),
        pct(net, F.col("revenue")).alias("profit_margin_pct"),
    ).orderBy(F.desc("net_profit"), "region")


def product_profitability(fact_tx: DataFrame, dim_products: DataFrame) -> DataFrame:
    """Adds each product's share of the total profit (total over products); no rows where an input is empty."""
    agg = _if_any(_by_key(fact_tx, "product_id", {"revenue": "revenue", "expenses": "expenses"}), dim_products)
    agg = agg.withColumn("net", F.col("revenue") - F.col("expenses"))
    named = attach_scalar(agg.join(dim_products, "product_id", "left"), agg.agg(F.sum("net").alias("total")))
    return named.select(
        F.col("product_name").alias("product_line"),
        money("revenue").alias("revenue"),
        money("expenses").alias("expenses"),
        money("net").alias("net_profit"),
        pct(F.col("net"), F.col("revenue")).alias("profit_margin_pct"),
        pct(F.col("net"), F.col("total"), positive_only=False).alias("profit_contribution_pct"),
    ).orderBy(F.desc("net_profit"), "product_line")


def expenses_by_category(fact_tx: DataFrame, dim_categories: DataFrame) -> DataFrame:
    """Expenses and their share by category; no rows where an input is empty."""
    agg = _if_any(_by_key(fact_tx, "category_id", {"expenses": "expenses"}), dim_categories)
    named = attach_scalar(agg.join(dim_categories, "category_id", "left"), agg.agg(F.sum("expenses").alias("total")))
    return named.select(
        F.col("category_name").alias("category"),
        money("expenses").alias("expenses"),
        pct(F.col("expenses"), F.col("total")).alias("expense_share_pct"),
    ).orderBy(F.desc("expenses"), "category")
