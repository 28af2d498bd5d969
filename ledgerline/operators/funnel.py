"""Invoice collection funnel.

Invoices are first reduced to one row per status (partial + final
aggregate, a handful of rows whatever the invoice count); the stage logic
then runs on that tiny table, either as suffix sums over the stages or as a
broadcast theta join ``status_num >= stage``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.constants import FUNNEL_STAGES
from ..functions.numeric import attach_scalar, dec_sum, frac, money, pct


def stages(spark: SparkSession) -> DataFrame:
    """The five funnel stages (a fixed 5-row table)."""
    return spark.createDataFrame([(i, s) for i, s in enumerate(FUNNEL_STAGES, start=1)],
                                 "stage_num int, stage string")


def status_counts(fact_inv: DataFrame) -> DataFrame:
    return fact_inv.groupBy("status_num").agg(F.count(F.lit(1)).alias("n"), dec_sum("amount").alias("amt"))


def invoice_funnel(fact_inv: DataFrame) -> DataFrame:
    """Per stage k: invoices with status >= k, their amount, % of all invoices."""
    spark = fact_inv.sparkSession
    counts = status_counts(fact_inv)
    total = F.sum("n").over(Window.partitionBy())
    with_total = counts.withColumn("total", total)
    per_stage = F.broadcast(stages(spark)).join(
        with_total, F.col("stage_num") == F.col("status_num"), "left")
    suffix = Window.orderBy(F.desc("stage_num")).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    all_total = F.max("total").over(Window.partitionBy())
    out = per_stage.select(
        "stage_num", "stage",
        F.coalesce(F.sum(F.coalesce("n", F.lit(0))).over(suffix), F.lit(0)).alias("cnt"),
        F.sum(F.coalesce("amt", F.lit(0))).over(suffix).alias("amount"),
        F.coalesce(all_total, F.lit(0)).alias("all_invoices"),
    )
    return _shape(out)


def invoice_funnel_theta(fact_inv: DataFrame) -> DataFrame:
    """Same result through the theta join stages x status on status_num >= stage."""
    spark = fact_inv.sparkSession
    counts = status_counts(fact_inv)
    joined = F.broadcast(stages(spark)).join(counts, F.col("status_num") >= F.col("stage_num"), "left")
    per_stage = joined.groupBy("stage_num", "stage").agg(
        F.coalesce(F.sum("n"), F.lit(0)).alias("cnt"), dec_sum("amt").alias("amount"))
    totals = counts.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("all_invoices"))
    return _shape(attach_scalar(per_stage, totals))


def _shape(df: DataFrame) -> DataFrame:
    return df.select(
        "stage",
        F.col("cnt").cast("bigint").alias("invoice_count"),
        money("amount").alias("total_amount"),
        pct(F.col("cnt"), F.col("all_invoices")).alias("pct_conversion"),
        "stage_num", "all_invoices",
    ).where("all_invoices > 0").orderBy("stage_num").drop("stage_num", "all_invoices")  # no invoices, no rows


def collection_summary(fact_inv: DataFrame) -> DataFrame:
    """Created amount, settled amount, settled %, uncollected amount."""
    counts = status_counts(fact_inv)
    agg = counts.agg(
        F.coalesce(F.sum("n"), F.lit(0)).alias("all_n"),
        dec_sum(F.when(F.col("status_num") >= 1, F.col("amt"))).alias("created"),
        dec_sum(F.when(F.col("status_num") >= 5, F.col("amt"))).alias("settled"),
        F.coalesce(F.sum(F.when(F.col("status_num") >= 5, F.col("n"))), F.lit(0)).alias("settled_n"),
    )
    return agg.select(
        money("created").alias("total_created"),
        money("settled").alias("total_settled"),
        pct(F.col("settled_n"), F.col("all_n")).alias("collection_rate_pct"),
        money(F.col("created") - F.col("settled")).alias("uncollected"),
    )


def settlement_conversion(fact_inv: DataFrame) -> DataFrame:
    """BI measure: share of all invoices at or past each stage (fraction)."""
    spark = fact_inv.sparkSession
    counts = status_counts(fact_inv)
    joined = F.broadcast(stages(spark)).join(counts, F.col("status_num") >= F.col("stage_num"), "left")
    per_stage = joined.groupBy("stage_num", "stage").agg(F.coalesce(F.sum("n"), F.lit(0)).alias("at_stage"))
    totals = counts.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("total_invoices"))
    return attach_scalar(per_stage, totals).select(
        F.col("stage_num").alias("stage_order"), "stage",
        F.col("at_stage").cast("bigint").alias("invoices_at_stage"),
        F.col("total_invoices").cast("bigint").alias("total_invoices"),
        frac(F.col("at_stage"), F.col("total_invoices"), positive_only=False).alias("conversion_rate"),
    ).orderBy("stage_order")
