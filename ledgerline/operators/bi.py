"""The BI measure library: measures that work under any grouping.

A measure is an aggregate expression; ``measures(df, by=[...])`` evaluates
the same expressions under any ``groupBy`` (the "filter context").  Facts
are flattened through their dimension lookups only for the attributes a
grouping needs.  Time intelligence runs over a dense month series taken
from the calendar, so a month without facts is present (blank revenue) and
the previous month is the previous *calendar* month.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.cleaning import bi_date, bi_number
from ..functions.constants import BI_RENAMES
from ..functions.numeric import as_double, dec_sum, frac
from .cohorts import client_monthly_revenue, months_between_labels
from .star import DIMENSIONS

CALENDAR_ATTRS = {
    "year": lambda d: F.year(d),
    "quarter": lambda d: F.quarter(d),
    "month": lambda d: F.date_format(d, "yyyy-MM"),
    "month_no": lambda d: F.month(d),
}


def divide(a: Column, b: Column) -> Column:
    """DIVIDE(a, b, 0): zero-guarded, no sign test; fraction, 6 decimals."""
    return frac(a, b, positive_only=False)


def flat(fact_tx: DataFrame, dims: dict[str, DataFrame], attrs: Sequence[str] = ()) -> DataFrame:
    """Fact rows with the requested dimension / calendar attributes.  Calendar
    attributes are pure functions of the date, so they are computed, not joined."""
    out = fact_tx
    for table, id_col, name_col, raw_col in DIMENSIONS:
        if raw_col in attrs:
            dim = dims[table].select(F.col(id_col).alias("_k"), F.col(name_col).alias(raw_col))
            out = out.join(dim, out[id_col] == dim["_k"], "left").drop("_k")
    for a in attrs:
        if a in CALENDAR_ATTRS:
            out = out.withColumn(a, CALENDAR_ATTRS[a](F.col("date")))
    return out


#: Calendar attributes from the fact's partition, its month as yyyymm.
PERIOD_ATTRS = {
    "year": lambda p: F.floor(p / 100).cast("int"),
    "quarter": lambda p: F.ceil((p % 100) / 3).cast("int"),
    "month": lambda p: F.format_string("%04d-%02d", F.floor(p / 100).cast("int"), p % 100),
    "month_no": lambda p: p % 100,
}


def sliced(fact: DataFrame, dims: dict[str, DataFrame], slicers: dict[str, Sequence]) -> DataFrame:
    """The fact rows whose attributes are among the selected values, attribute by attribute.

    Calendar attributes filter the month partitions, so files of other months
    are not listed for reading.  Names are looked up in their dimension, no
    more ids than selected values, and the ids go to the scan, where the sorted
    files' statistics skip row groups; a value that is no member selects nothing.
    """
    for attr, values in slicers.items():
        if attr in PERIOD_ATTRS:
            fact = fact.where(PERIOD_ATTRS[attr](F.col("period")).isin(list(values)))
            continue
        table, id_col, name_col, _ = next(d for d in DIMENSIONS if d[3] == attr)
        ids = dims[table].where(F.col(name_col).isin(list(values))).select(id_col).collect()  # at most one for each value
        fact = fact.where(F.col(id_col).isin([r[0] for r in ids]))
    return fact


def measures(fact_tx: DataFrame, dims: dict[str, DataFrame], by: Sequence[str] = (),
             where: Column | None = None, slicers: dict[str, Sequence] | None = None) -> DataFrame:
    """Total Revenue, Total Expenses, Net Profit, Profit Margin %, ROI % under ``by``.

    ``where``: a condition on the fact's columns, ``slicers``: selected values of
    calendar and dimension attributes; both reach the fact's scan.
    The fact is summed by id first; names are looked up for the sums."""
    rows = fact_tx if where is None else fact_tx.where(where)
    rows = sliced(rows, dims, slicers or {})
    ids = [id_col for _, id_col, _, raw_col in DIMENSIONS if raw_col in by]
    times = [a for a in by if a in CALENDAR_ATTRS]
    sums = flat(rows, dims, times).groupBy(*ids, *times).agg(F.sum("revenue").alias("rev"), F.sum("expenses").alias("exp"))
    named = flat(sums, dims, [a for a in by if a not in CALENDAR_ATTRS])
    agg = named.groupBy(*by).agg(dec_sum("rev").alias("rev"), dec_sum("exp").alias("exp"))
    net = F.col("rev") - F.col("exp")
    return agg.select(*by, as_double("rev").alias("total_revenue"), as_double("exp").alias("total_expenses"),
                      as_double(net).alias("net_profit"), divide(net, F.col("rev")).alias("profit_margin"),
                      divide(net, F.col("exp")).alias("roi"))


def variance_measures(fact_tx: DataFrame, fact_budgets: DataFrame, dims: dict[str, DataFrame],
                      by: Sequence[str] = ("department",)) -> DataFrame:
    """Budget Revenue, Budget Expenses, Revenue Variance (+ %), Expense Variance
    under a grouping both facts share (department and/or region)."""
    a = flat(fact_tx, dims, by).groupBy(*by).agg(dec_sum("revenue").alias("rev"), dec_sum("expenses").alias("exp"))
    b = (flat(fact_budgets, dims, by).groupBy(*by)
         .agg(dec_sum("budgeted_revenue").alias("brev"), dec_sum("budgeted_expenses").alias("bexp")))
    b = b.select(*[F.col(k).alias(f"_b_{k}") for k in by], "brev", "bexp")
    cond = [F.col(k).eqNullSafe(F.col(f"_b_{k}")) for k in by]
    j = a.join(b, cond, "full_outer")
    keys = [F.coalesce(F.col(k), F.col(f"_b_{k}")).alias(k) for k in by]
    z = F.lit(0).cast("decimal(18,4)")
    rev, exp = F.coalesce("rev", z), F.coalesce("exp", z)
    brev, bexp = F.coalesce("brev", z), F.coalesce("bexp", z)
    return j.select(*keys, as_double(rev).alias("total_revenue"), as_double(brev).alias("budget_revenue"),
                    as_double(rev - brev).alias("revenue_variance"),
                    divide(rev - brev, brev).alias("revenue_variance_pct"),
                    as_double(bexp).alias("budget_expenses"), as_double(exp).alias("total_expenses"),
                    as_double(bexp - exp).alias("expense_variance"))


def _month_series(calendar: DataFrame, fact_tx: DataFrame) -> DataFrame:
    """Dense calendar months with their exact revenue (NULL = no facts)."""
    months = calendar.groupBy("month", "year").agg(F.min("date").alias("first_day"))
    rev = (fact_tx.where(F.col("date").isNotNull())
           .groupBy(F.date_format("date", "yyyy-MM").alias("month")).agg(F.sum("revenue").alias("revenue")))
    return months.join(rev, "month", "left")


def mom_growth(calendar: DataFrame, fact_tx: DataFrame) -> DataFrame:
    """Revenue MoM Growth %: DIVIDE(cur - prev, prev, 0) against the previous
    calendar month (a blank month counts as 0)."""
    s = _month_series(calendar, fact_tx)
    prev = F.lag("revenue").over(Window.orderBy("month"))  # over months
    cur0 = F.coalesce(F.col("revenue"), F.lit(0))
    return s.select(
        "month", as_double("revenue").alias("revenue"), as_double(prev).alias("prev_month_revenue"),
        divide(cur0 - F.coalesce(prev, F.lit(0)), F.coalesce(prev, F.lit(0))).alias("mom_growth"),
    )


def ytd_revenue(calendar: DataFrame, fact_tx: DataFrame) -> DataFrame:
    """YTD Revenue: running revenue that restarts each calendar year."""
    s = _month_series(calendar, fact_tx)
    w = Window.partitionBy("year").orderBy("month").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return s.select("year", "month", as_double("revenue").alias("revenue"),
                    as_double(F.sum("revenue").over(w)).alias("ytd_revenue"))


def net_revenue_retention(fact_tx: DataFrame) -> DataFrame:
    """Net Revenue Retention %: a cohort's revenue in a month over its revenue
    in its first month (fraction), for every later month (no 12-month cap)."""
    cm = client_monthly_revenue(fact_tx)
    with_cohort = cm.withColumn("cohort_month", F.min("trans_month").over(Window.partitionBy("client_id")))
    cells = (with_cohort.groupBy("cohort_month", F.col("trans_month").alias("month"))
             .agg(dec_sum("revenue").alias("rev")))
    base = F.max(F.when(F.col("month") == F.col("cohort_month"), F.col("rev"))).over(
        Window.partitionBy("cohort_month"))
    return cells.select(
        "cohort_month", "month",
        months_between_labels(F.col("month"), F.col("cohort_month")).alias("elapsed_months"),
        as_double("rev").alias("cohort_revenue"), as_double(base).alias("base_revenue"),
        divide(F.col("rev"), base).alias("net_revenue_retention"))


def star_flat(fact_tx: DataFrame, dims: dict[str, DataFrame]) -> DataFrame:
    """The model's relationships applied: one wide row per transaction."""
    attrs = ["department", "region", "product_line", "expense_category", "year", "quarter", "month"]
    f = flat(fact_tx, dims, attrs)
    return f.select("transaction_id", "date", "year", "quarter", "month", "revenue", "expenses", "department",
                    "region", "product_line", "expense_category", "client_id")


def clean_transactions(staging: DataFrame, date_col: str = "Date") -> DataFrame:
    """The BI cleaning script: rename money headers (missing ones tolerated;
    several sources for one target are coalesced in listed order), keep only
    digits / ``.`` / ``-`` in text amounts, type the date column."""
    targets: dict[str, list[str]] = {}
    for src, dst in BI_RENAMES:
        if src in staging.columns:
            targets.setdefault(dst, []).append(src)
    renamed_src = {s for v in targets.values() for s in v}
    keep = [c for c in staging.columns if c not in renamed_src and c != date_col]
    money = {}
    for dst in ("Revenue", "Expenses"):
        srcs = targets.get(dst, [])
        money[dst] = (F.coalesce(*[bi_number(F.col(s)) for s in srcs]) if srcs
                      else F.lit(None).cast("double"))
    date = bi_date(F.col(date_col)) if date_col in staging.columns else F.lit(None).cast("date")
    return staging.select(*keep, date.alias("Date"), money["Revenue"].alias("Revenue"),
                          money["Expenses"].alias("Expenses"))
