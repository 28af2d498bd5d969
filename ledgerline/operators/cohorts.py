"""Client revenue cohorts and retention matrices.

Plan shape: one partial+final aggregate to (client, month) -- a hot client
collapses map-side to one row per month -- then the cohort (first month) as a
window over those aggregated rows (at most one row per month per client),
then one aggregate to (cohort, elapsed).  Cohort size and base revenue are
the elapsed-0 cell of each cohort, read with a window over the tiny cohort
table, so no second pass over clients and no count-distinct shuffle.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.constants import COHORT_MONTHS
from ..functions.numeric import as_double, dec_sum, money, pct


def is_valid_revenue() -> F.Column:
    """Whether a row counts for cohorts: positive revenue, a client id, a date."""
    return ((F.col("revenue") > 0) & F.col("client_id").isNotNull() & (F.col("client_id") != "")
            & F.col("date").isNotNull())


def valid_revenue(fact_tx: DataFrame) -> DataFrame:
    """Rows that count for cohorts."""
    return (fact_tx.where(is_valid_revenue())
            .select("client_id", F.date_format("date", "yyyy-MM").alias("trans_month"), "revenue"))


def client_monthly_revenue(fact_tx: DataFrame) -> DataFrame:
    return (valid_revenue(fact_tx).groupBy("client_id", "trans_month")
            .agg(dec_sum("revenue").alias("revenue")))


def client_cohorts(fact_tx: DataFrame) -> DataFrame:
    """First purchase month per client."""
    return (client_monthly_revenue(fact_tx).groupBy("client_id")
            .agg(F.min("trans_month").alias("cohort_month")))


def months_between_labels(later: F.Column, earlier: F.Column) -> F.Column:
    """(year diff) * 12 + month diff of two ``yyyy-MM`` labels."""
    def y(c):
        return F.substring(c, 1, 4).cast("int")

    def m(c):
        return F.substring(c, 6, 2).cast("int")

    return ((y(later) - y(earlier)) * 12 + m(later) - m(earlier)).cast("int")


def cohort_cells(fact_tx: DataFrame) -> DataFrame:
    """(cohort_month, elapsed_months) -> exact revenue and active clients."""
    cm = client_monthly_revenue(fact_tx)
    with_cohort = cm.withColumn("cohort_month", F.min("trans_month").over(Window.partitionBy("client_id")))
    return (with_cohort
            .withColumn("elapsed_months", months_between_labels(F.col("trans_month"), F.col("cohort_month")))
            .groupBy("cohort_month", "elapsed_months")
            .agg(dec_sum("revenue").alias("cohort_revenue"), F.count(F.lit(1)).alias("active_clients")))


def cohort_sizes(fact_tx: DataFrame) -> DataFrame:
    return (cohort_cells(fact_tx).where(F.col("elapsed_months") == 0)
            .select("cohort_month", F.col("active_clients").alias("total_clients")))


def revenue_cohorts(fact_tx: DataFrame) -> DataFrame:
    """Retention per cohort and elapsed month 0..11, in percent."""
    cells = cohort_cells(fact_tx)
    w = Window.partitionBy("cohort_month")  # <= months rows per cohort
    base = cells.select(
        "*",
        F.max(F.when(F.col("elapsed_months") == 0, F.col("active_clients"))).over(w).alias("total_clients"),
        F.max(F.when(F.col("elapsed_months") == 0, F.col("cohort_revenue"))).over(w).alias("base_rev"),
    )
    kept = base.where((F.col("elapsed_months") >= 0) & (F.col("elapsed_months") < COHORT_MONTHS))
    return kept.select(
        "cohort_month",
        F.col("total_clients").cast("bigint").alias("total_clients"),
        money("base_rev").alias("base_rev"),
        "elapsed_months",
        money("cohort_revenue").alias("cohort_revenue"),
        F.col("active_clients").cast("bigint").alias("active_clients"),
        pct(F.col("cohort_revenue"), F.col("base_rev")).alias("revenue_retention_pct"),
        pct(F.col("active_clients"), F.col("total_clients")).alias("client_retention_pct"),
    ).orderBy("cohort_month", "elapsed_months")


def cohort_summary(cohorts: DataFrame) -> DataFrame:
    """Mean month-1 revenue retention, mean month-3 client retention (over
    cohorts, of the rounded percentages) and the number of cohorts."""
    return cohorts.agg(
        F.round(F.avg(F.when(F.col("elapsed_months") == 1, F.col("revenue_retention_pct"))), 4)
        .alias("avg_m1_revenue_retention"),
        F.round(F.avg(F.when(F.col("elapsed_months") == 3, F.col("client_retention_pct"))), 4)
        .alias("avg_m3_client_retention"),
        F.count_distinct("cohort_month").alias("active_cohorts"),
    )


def cohort_pivot(cohorts: DataFrame, value: str) -> DataFrame:
    """cohort_month x elapsed month matrix (columns m0..m11); explicit pivot
    values keep it to one aggregate with no distinct-values job."""
    wide = cohorts.groupBy("cohort_month").pivot("elapsed_months", list(range(COHORT_MONTHS))).agg(F.first(value))
    return wide.select("cohort_month", *[F.col(str(i)).alias(f"m{i}") for i in range(COHORT_MONTHS)])


def client_monthly_revenue_out(fact_tx: DataFrame) -> DataFrame:
    return client_monthly_revenue(fact_tx).select("client_id", "trans_month", as_double("revenue").alias("revenue"))
