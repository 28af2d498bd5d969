"""The query library: name -> callable(spark, sf_dir) -> DataFrame."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from pyspark.sql import functions as F

from ..functions import headers
from ..operators import bi, cohorts, funnel, ingest, metrics, quality, reports
from ..operators.positions import range_count
from ..sources import fixtures
from .context import Finance

Query = Callable[[SparkSession, str], DataFrame]
_REGISTRY: dict[str, Query] = {}


def query(name: str):
    def deco(fn: Callable[[Finance], DataFrame]) -> Callable[[Finance], DataFrame]:
        _REGISTRY[name] = lambda spark, sf_dir: fn(Finance.of(spark, sf_dir))
        return fn
    return deco


def queries() -> dict[str, Query]:
    return dict(_REGISTRY)


# ----------------------------------------------------------------------------
# star schema
# ----------------------------------------------------------------------------

@query("star_dim_departments")
def _q_dim_departments(f: Finance) -> DataFrame:
    return f.dim_departments


@query("star_dim_regions")
def _q_dim_regions(f: Finance) -> DataFrame:
    return f.dim_regions


@query("star_dim_products")
def _q_dim_products(f: Finance) -> DataFrame:
    return f.dim_products


@query("star_dim_categories")
def _q_dim_categories(f: Finance) -> DataFrame:
    return f.dim_expense_categories


@query("star_fact_transactions")
def _q_fact_transactions(f: Finance) -> DataFrame:
    return f.fact_transactions.drop("period")


@query("star_fact_budgets")
def _q_fact_budgets(f: Finance) -> DataFrame:
    return f.fact_budgets


@query("star_fact_invoices")
def _q_fact_invoices(f: Finance) -> DataFrame:
    return f.fact_invoices


@query("dim_calendar")
def _q_dim_calendar(f: Finance) -> DataFrame:
    return f.dim_calendar


# ----------------------------------------------------------------------------
# executive metrics
# ----------------------------------------------------------------------------

@query("kpis")
def _q_kpis(f: Finance) -> DataFrame:
    return metrics.kpis(f.fact_transactions, f.fact_budgets)


@query("monthly_performance")
def _q_monthly(f: Finance) -> DataFrame:
    return metrics.monthly_performance(f.fact_transactions)


@query("department_performance")
def _q_departments(f: Finance) -> DataFrame:
    return metrics.department_performance(f.fact_transactions, f.fact_budgets, f.dim_departments)


@query("regional_profitability")
def _q_regions(f: Finance) -> DataFrame:
    return metrics.regional_profitability(f.fact_transactions, f.dim_regions)


@query("product_profitability")
def _q_products(f: Finance) -> DataFrame:
    return metrics.product_profitability(f.fact_transactions, f.dim_products)


@query("expenses_by_category")
def _q_categories(f: Finance) -> DataFrame:
    return metrics.expenses_by_category(f.fact_transactions, f.dim_expense_categories)


# ----------------------------------------------------------------------------
# cohorts
# ----------------------------------------------------------------------------

@query("client_cohorts")
def _q_client_cohorts(f: Finance) -> DataFrame:
    return cohorts.client_cohorts(f.fact_transactions)


@query("client_monthly_revenue")
def _q_client_monthly(f: Finance) -> DataFrame:
    return cohorts.client_monthly_revenue_out(f.fact_transactions)


@query("cohort_sizes")
def _q_cohort_sizes(f: Finance) -> DataFrame:
    return cohorts.cohort_sizes(f.fact_transactions)


@query("revenue_cohorts")
def _q_revenue_cohorts(f: Finance) -> DataFrame:
    return cohorts.revenue_cohorts(f.fact_transactions)


@query("cohort_summary")
def _q_cohort_summary(f: Finance) -> DataFrame:
    return cohorts.cohort_summary(cohorts.revenue_cohorts(f.fact_transactions))


@query("cohort_pivot_revenue")
def _q_pivot_revenue(f: Finance) -> DataFrame:
    return cohorts.cohort_pivot(cohorts.revenue_cohorts(f.fact_transactions), "revenue_retention_pct")


@query("cohort_pivot_clients")
def _q_pivot_clients(f: Finance) -> DataFrame:
    return cohorts.cohort_pivot(cohorts.revenue_cohorts(f.fact_transactions), "client_retention_pct")


# ----------------------------------------------------------------------------
# incremental aggregates: the star after the uploads were appended, answered from rollups of its segments
# ----------------------------------------------------------------------------

@query("rollup_kpis")
def _q_rollup_kpis(f: Finance) -> DataFrame:
    return metrics.kpis(f.rolled.fact_transactions, f.rolled.fact_budgets)


@query("rollup_monthly_performance")
def _q_rollup_monthly(f: Finance) -> DataFrame:
    return metrics.monthly_performance(f.rolled.fact_transactions)


@query("rollup_department_performance")
def _q_rollup_departments(f: Finance) -> DataFrame:
    return metrics.department_performance(f.rolled.fact_transactions, f.rolled.fact_budgets, f.rolled.dim_departments)


@query("rollup_regional_profitability")
def _q_rollup_regions(f: Finance) -> DataFrame:
    return metrics.regional_profitability(f.rolled.fact_transactions, f.rolled.dim_regions)


@query("rollup_product_profitability")
def _q_rollup_products(f: Finance) -> DataFrame:
    return metrics.product_profitability(f.rolled.fact_transactions, f.rolled.dim_products)


@query("rollup_expenses_by_category")
def _q_rollup_categories(f: Finance) -> DataFrame:
    return metrics.expenses_by_category(f.rolled.fact_transactions, f.rolled.dim_expense_categories)


@query("rollup_report_monthly_margin")
def _q_rollup_margin(f: Finance) -> DataFrame:
    return reports.report_monthly_margin(f.rolled.fact_transactions)


@query("rollup_cohort_sizes")
def _q_rollup_cohort_sizes(f: Finance) -> DataFrame:
    return cohorts.cohort_sizes(f.rolled_clients)


@query("rollup_revenue_cohorts")
def _q_rollup_cohorts(f: Finance) -> DataFrame:
    return cohorts.revenue_cohorts(f.rolled_clients)


# ----------------------------------------------------------------------------
# invoice funnel
# ----------------------------------------------------------------------------

@query("invoice_funnel")
def _q_funnel(f: Finance) -> DataFrame:
    return funnel.invoice_funnel(f.fact_invoices)


@query("invoice_funnel_theta")
def _q_funnel_theta(f: Finance) -> DataFrame:
    return funnel.invoice_funnel_theta(f.fact_invoices)


@query("collection_summary")
def _q_collection(f: Finance) -> DataFrame:
    return funnel.collection_summary(f.fact_invoices)


# ----------------------------------------------------------------------------
# ingestion: mapping, cleaning, audit, verdict, merge, log
# ----------------------------------------------------------------------------

@query("ingest_mapped")
def _q_ingest_mapped(f: Finance) -> DataFrame:
    return f.upload_mapped


@query("ingest_clean")
def _q_ingest_clean(f: Finance) -> DataFrame:
    return f.upload_clean


@query("ingest_mapping_report")
def _q_mapping_report(f: Finance) -> DataFrame:
    return headers.mapping_report(f.raw_upload.drop("event_id", "copy"), ["batch_id"], keep=["filename"])


@query("ingest_preview")
def _q_preview(f: Finance) -> DataFrame:
    return ingest.preview(f.upload_numbered)


@query("dq_issues")
def _q_dq_issues(f: Finance) -> DataFrame:
    return f.upload_issues


@query("dq_rule_counts")
def _q_dq_rule_counts(f: Finance) -> DataFrame:
    return quality.rule_counts(f.upload_issues)


@query("dq_failed_rows")
def _q_dq_failed(f: Finance) -> DataFrame:
    return quality.failed_rows(f.upload_clean, fixtures.UPLOAD_AS_OF)


@query("dq_duplicates")
def _q_dq_duplicates(f: Finance) -> DataFrame:
    return quality.duplicate_rows(f.upload_clean)


@query("dq_issue_summary")
def _q_dq_summary(f: Finance) -> DataFrame:
    return quality.issue_summary(f.upload_issues)


@query("ingest_verdict")
def _q_verdict(f: Finance) -> DataFrame:
    return f.upload_verdicts


@query("merge_dim_departments")
def _q_merge_departments(f: Finance) -> DataFrame:
    return f.extended_dims["dim_departments"]


@query("merge_dim_regions")
def _q_merge_regions(f: Finance) -> DataFrame:
    return f.extended_dims["dim_regions"]


@query("merge_dim_products")
def _q_merge_products(f: Finance) -> DataFrame:
    return f.extended_dims["dim_products"]


@query("merge_dim_categories")
def _q_merge_categories(f: Finance) -> DataFrame:
    return f.extended_dims["dim_expense_categories"]


@query("merge_transactions")
def _q_merge_transactions(f: Finance) -> DataFrame:
    return ingest.new_transactions(f.fact_transactions, f.upload_clean, f.merged_batches, f.extended_dims)


@query("ingestion_log_entry")
def _q_log_entry(f: Finance) -> DataFrame:
    seed = ingest.initial_log(f.fact_transactions, fixtures.UPLOAD_SUBMITTED_AT)
    log_max = seed.agg(F.coalesce(F.max("batch_id"), F.lit(0)).alias("log_max"))
    return ingest.log_entries(f.upload_verdicts, f.upload_issues, log_max, fixtures.UPLOAD_SUBMITTED_AT)


@query("ingestion_issues")
def _q_ingestion_issues(f: Finance) -> DataFrame:
    """Every issue entry of the audited uploads, written to a store and read back through its commit."""
    from ..session import scratch_path
    from ..sources import tables

    root = scratch_path(f.spark, "audit")
    seed = ingest.initial_log(f.fact_transactions, fixtures.UPLOAD_SUBMITTED_AT)
    log_max = seed.agg(F.coalesce(F.max("batch_id"), F.lit(0)).alias("log_max"))
    run = tables.new_run()
    tables.write_issues(ingest.stored_issues(f.upload_verdicts, f.upload_issues, log_max), root, run)
    tables.write_log(ingest.log_entries(f.upload_verdicts, f.upload_issues, log_max, fixtures.UPLOAD_SUBMITTED_AT), root, run)
    tables.commit(f.spark, root, None, audits=[run])
    return tables.read_table(f.spark, root, tables.ISSUES)


@query("ingestion_log_listing")
def _q_log_listing(f: Finance) -> DataFrame:
    """Seed row of the initial load plus one row per audited upload, renamed."""
    seed = ingest.initial_log(f.fact_transactions, fixtures.UPLOAD_SUBMITTED_AT)
    log_max = seed.agg(F.coalesce(F.max("batch_id"), F.lit(0)).alias("log_max"))
    entries = ingest.log_entries(f.upload_verdicts, f.upload_issues, log_max, fixtures.UPLOAD_SUBMITTED_AT)
    return ingest.log_listing(seed.unionByName(entries))


@query("integrity_audit")
def _q_integrity(f: Finance) -> DataFrame:
    return ingest.integrity_audit(f.fact_transactions, f.dim_departments, f.dim_regions)


# ----------------------------------------------------------------------------
# report tables
# ----------------------------------------------------------------------------

@query("report_monthly_margin")
def _q_report_monthly(f: Finance) -> DataFrame:
    return reports.report_monthly_margin(f.fact_transactions)


@query("report_budget_vs_actual")
def _q_report_bva(f: Finance) -> DataFrame:
    return reports.report_budget_vs_actual(f.fact_transactions, f.fact_budgets, f.dim_departments)


@query("report_segment_region")
def _q_report_region(f: Finance) -> DataFrame:
    return reports.report_segment_region(f.fact_transactions, f.dim_regions)


@query("report_segment_product")
def _q_report_product(f: Finance) -> DataFrame:
    return reports.report_segment_product(f.fact_transactions, f.dim_products)


@query("report_kpi_cards")
def _q_report_cards(f: Finance) -> DataFrame:
    return reports.report_kpi_cards(reports.monthly_margin(f.fact_transactions))


@query("report_overview")
def _q_report_overview(f: Finance) -> DataFrame:
    return reports.report_overview(
        reports.monthly_margin(f.fact_transactions),
        reports.budget_vs_actual(f.fact_transactions, f.fact_budgets, f.dim_departments))


# ----------------------------------------------------------------------------
# BI measures
# ----------------------------------------------------------------------------

def _dims(f: Finance) -> dict[str, DataFrame]:
    return {k: v for k, v in f.star.tables().items() if k.startswith("dim_")}


@query("bi_core_measures")
def _q_bi_core(f: Finance) -> DataFrame:
    return bi.measures(f.fact_transactions, _dims(f))


@query("bi_core_measures_by_region")
def _q_bi_core_region(f: Finance) -> DataFrame:
    return bi.measures(f.fact_transactions, _dims(f), by=["region"])


@query("bi_core_measures_by_month")
def _q_bi_core_month(f: Finance) -> DataFrame:
    return bi.measures(f.fact_transactions, _dims(f), by=["month"])


@query("bi_core_measures_by_department")
def _q_bi_core_department(f: Finance) -> DataFrame:
    return bi.measures(f.fact_transactions, _dims(f), by=["department"])


@query("bi_core_measures_by_product")
def _q_bi_core_product(f: Finance) -> DataFrame:
    return bi.measures(f.fact_transactions, _dims(f), by=["product_line"])


@query("bi_core_measures_filtered")
def _q_bi_core_filtered(f: Finance) -> DataFrame:
    """The measures by region over the dates of one year."""
    year = F.col("date").between(F.lit("1996-01-01").cast("date"), F.lit("1996-12-31").cast("date"))
    return bi.measures(f.fact_transactions, _dims(f), by=["region"], where=year, slicers={"year": [1996]})


@query("bi_core_measures_sliced")
def _q_bi_core_sliced(f: Finance) -> DataFrame:
    """The measures by product line for two regions and the second halves of two years."""
    return bi.measures(f.fact_transactions, _dims(f), by=["product_line"], slicers={
        "region": ["ASIA", "EUROPE"], "year": [1995, 1996], "quarter": [3, 4]})


@query("bi_variance_measures")
def _q_bi_variance(f: Finance) -> DataFrame:
    return bi.variance_measures(f.fact_transactions, f.fact_budgets, _dims(f), by=["department"])


@query("bi_mom_growth")
def _q_bi_mom(f: Finance) -> DataFrame:
    return bi.mom_growth(f.dim_calendar, f.fact_transactions)


@query("bi_ytd_revenue")
def _q_bi_ytd(f: Finance) -> DataFrame:
    return bi.ytd_revenue(f.dim_calendar, f.fact_transactions)


@query("bi_net_revenue_retention")
def _q_bi_nrr(f: Finance) -> DataFrame:
    return bi.net_revenue_retention(f.fact_transactions)


@query("bi_settlement_conversion")
def _q_bi_settlement(f: Finance) -> DataFrame:
    return funnel.settlement_conversion(f.fact_invoices)


@query("bi_star_flat")
def _q_bi_star_flat(f: Finance) -> DataFrame:
    return bi.star_flat(f.fact_transactions, _dims(f))


@query("bi_clean_transactions")
def _q_bi_clean(f: Finance) -> DataFrame:
    return bi.clean_transactions(f.raw_upload, date_col="transaction_date")


# ----------------------------------------------------------------------------
# streaming ingestion
# ----------------------------------------------------------------------------

def _streamed(f: Finance, folders: list[tuple[F.Column, list[str]]]) -> DataFrame:
    """The upload batches written as CSV files, one folder per upload, under the
    headers that ``folders`` gives the batches of a condition, announced and drained by the file
    stream into a copy of the stored star; the fact rows that the stream appended."""
    from ..session import scratch_path
    from ..sources import tables
    from ..streaming.ingest import start_file_ingest

    spark = f.spark
    base = scratch_path(spark, "stream")
    root, inbox, ready, ckpt = f"{base}/store", f"{base}/inbox", f"{base}/ready", f"{base}/checkpoint"
    loaded = tables.write_star(f.star, root, ingest.initial_log(f.fact_transactions, fixtures.UPLOAD_SUBMITTED_AT))
    n = max(int(spark.conf.get("spark.sql.shuffle.partitions")), range_count(f.upload_raw))
    order = ["filename", "event_id", "copy"]
    for which, headers in folders:
        (f.upload_raw.where(which).repartitionByRange(n, *order).sortWithinPartitions(*order)
         .select("filename", *[F.col(h.split("=")[0]).alias(h.split("=")[-1]) for h in headers])
         .write.partitionBy("filename").mode("append").option("header", True)
         .option("ignoreLeadingWhiteSpace", False).option("ignoreTrailingWhiteSpace", False).csv(inbox))
    (f.upload_raw.select(F.concat(F.lit(f"{inbox}/filename="), "filename").alias("value")).distinct()
     .coalesce(1).write.text(ready))  # a line for each upload
    q = start_file_ingest(spark, ready, root, ckpt, as_of=fixtures.UPLOAD_AS_OF, submitted_at=fixtures.UPLOAD_SUBMITTED_AT,
                          max_files_per_trigger=1, announced=True)
    q.awaitTermination()
    return tables.committed(spark, root, tables.SEGMENTED).where(~F.col("segment").isin(loaded.facts)).drop("segment", "period")


@query("stream_ingest")
def _q_stream_ingest(f: Finance) -> DataFrame:
    """All upload batches through the file stream (same rows as ``merge_transactions``)."""
    return _streamed(f, [(F.lit(True), list(fixtures.UPLOAD_HEADERS))])


@query("stream_ingest_headers")
def _q_stream_ingest_headers(f: Finance) -> DataFrame:
    """The same batches in three kinds of files: two further sets of header synonyms, in other orders of
    columns and with a column more; each file is mapped by its own header line."""
    more = ["customer=Customer ID", "type=Cost Type", "event_id=line", "segment=Product Line", "area=Zone",
            "division=Cost_Center", "spending=Total Costs", "sales=Income", "transaction_date=Date"]
    other = ["sales=REVENUE", "spending=expenses", "transaction_date=Txn_Date", "division=dept", "area=region",
             "segment=product", "type=category", "customer=client"]
    kind = F.col("batch_id") % 3
    return _streamed(f, [(kind == 0, list(fixtures.UPLOAD_HEADERS)), (kind == 1, more), (kind == 2, other)])
