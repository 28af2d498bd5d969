"""Batch ingestion: map -> clean -> audit -> verdict -> merge -> log.

Everything here is a pure DataFrame transform over *many* batches at once
(grouped by ``batch_id``); the writers in ``sources.tables`` and the stream
in ``streaming.ingest`` apply the results.  Row numbers inside a batch come
from the skew-safe position operator, never from a single-task window.
"""

from __future__ import annotations

import datetime as _dt
from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.cleaning import clean_numeric, clean_text, parse_date, strip
from ..functions.headers import CANONICAL, map_columns
from ..functions.numeric import MONEY, attach_scalar
from ..session import materialize
from . import quality
from .positions import with_row_positions
from .star import DIMENSIONS

META = ["batch_id", "filename", "row_num"]


def number_rows(raw: DataFrame, order_cols: Sequence[str]) -> DataFrame:
    """1-based row number inside each batch by ``order_cols`` (file order)."""
    return with_row_positions(raw, list(order_cols), ["batch_id"], out="row_num", keep_order=False)


def mapped(numbered_raw: DataFrame) -> DataFrame:
    return map_columns(numbered_raw, keep=META)


def clean(mapped_df: DataFrame) -> DataFrame:
    """Typed batch: DATE, two DOUBLE amounts (0.0 when missing or
    unparseable), five stripped text columns."""
    return mapped_df.select(
        *META,
        parse_date(F.col("date")).alias("date"),
        clean_numeric(F.col("revenue")).alias("revenue"),
        clean_numeric(F.col("expenses")).alias("expenses"),
        *[clean_text(F.col(c)).alias(c) for c in CANONICAL[3:]],
    )


def preview(numbered_raw: DataFrame, n: int = 5) -> DataFrame:
    """The first ``n`` raw rows of each batch (row numbers are already known)."""
    return numbered_raw.where(F.col("row_num") <= n)


def verdicts(clean_df: DataFrame, as_of: str | _dt.date) -> DataFrame:
    names = clean_df.groupBy("batch_id").agg(F.min("filename").alias("filename"))
    return quality.verdicts(clean_df, as_of).join(names, "batch_id", "inner")


def merged_batches(verdict_df: DataFrame) -> DataFrame:
    """Batches that merge (Accepted and Needs Review merge the whole batch)."""
    return verdict_df.where(F.col("success")).select("batch_id", "row_count")


def _name(c: str) -> F.Column:
    """Dimension member text: stripped, blank -> NULL (a blank is not a member)."""
    return F.nullif(strip(F.col(c)), F.lit(""))


def extended_dimensions(dims: dict[str, DataFrame], clean_df: DataFrame, merged: DataFrame) -> dict[str, DataFrame]:
    """(The materialized new members are returned under ``_added``: dim, id, name.)

    Existing members plus the new names of the merged batches, numbered
    ``len(existing) + 1 ...`` per dimension in order of first appearance
    (batch, row).  All four dimensions in one pass: each merged row emits its
    (dimension, name) pairs, one aggregate keeps the first position per name,
    one anti join drops known members, one numbering groups by dimension."""
    rows = clean_df.join(merged.select("batch_id"), "batch_id", "left_semi")
    pairs = rows.select(F.explode(F.array(*[
        F.struct(F.lit(raw).alias("dim"), _name(raw).alias("name"),
                 F.struct("batch_id", "row_num").alias("pos"))
        for _, _, _, raw in DIMENSIONS])).alias("p")).select("p.*").where(F.col("name").isNotNull())
    first = pairs.groupBy("dim", "name").agg(F.min("pos").alias("first"))
    existing = None
    for table, id_col, name_col, raw in DIMENSIONS:
        part = dims[table].select(F.lit(raw).alias("dim"), F.col(name_col).alias("name"))
        existing = part if existing is None else existing.unionByName(part)
    new = materialize(first.join(existing, ["dim", "name"], "left_anti").select(
        "dim", "name", F.col("first.batch_id").alias("fb"), F.col("first.row_num").alias("fr")), "new_names")
    numbered = with_row_positions(new, ["fb", "fr"], ["dim"], out="pos")
    sizes = existing.groupBy("dim").agg(F.count(F.lit(1)).alias("n_existing"))  # <= 4 rows
    added = numbered.join(sizes, "dim", "left").select(
        "dim", (F.coalesce(F.col("n_existing"), F.lit(0)) + F.col("pos")).cast("int").alias("id"), "name")
    added = materialize(added, "added_names")
    out = {"_added": added}
    for table, id_col, name_col, raw in DIMENSIONS:
        new_rows = added.where(F.col("dim") == raw).select(F.col("id").alias(id_col), F.col("name").alias(name_col))
        out[table] = dims[table].select(id_col, name_col).unionByName(new_rows)
    return out


def new_transactions(fact_tx: DataFrame, clean_df: DataFrame, merged: DataFrame,
                     dims: dict[str, DataFrame]) -> DataFrame:
    """Fact rows appended for the merged batches: ids continue after the
    current maximum, batch by batch, in row order (rows of the batches before
    plus the row's number in its own); names -> ids (left joins)."""
    start = fact_tx.agg(F.coalesce(F.max("transaction_id"), F.lit(0)).alias("max_id"))
    before = Window.orderBy("batch_id").rowsBetween(Window.unboundedPreceding, -1)  # one row per batch
    sizes = (clean_df.groupBy("batch_id").agg(F.max("row_num").alias("_n"))
             .join(merged.select("batch_id"), "batch_id", "left_semi")
             .select("batch_id", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_before")))
    rows = attach_scalar(clean_df.join(sizes, "batch_id"), start)
    out = rows.select(
        (F.col("max_id") + F.col("_before") + F.col("row_num")).cast("bigint").alias("transaction_id"),
        "date",
        F.col("revenue").cast(MONEY).alias("revenue"),
        F.col("expenses").cast(MONEY).alias("expenses"),
        *[_name(c).alias(c) for _, _, _, c in DIMENSIONS],
        F.coalesce(F.col("client_id"), F.lit("")).alias("client_id"),
        "batch_id",
    )
    for table, id_col, name_col, raw_col in DIMENSIONS:
        dim = dims[table]
        out = out.join(dim, out[raw_col] == dim[name_col], "left").drop(name_col, raw_col)
    return out.select("transaction_id", "date", "revenue", "expenses", "dept_id", "region_id", "product_id",
                      "category_id", "client_id", "batch_id")


def stored_issues(verdict_df: DataFrame, issues_df: DataFrame, log_max: DataFrame) -> DataFrame:
    """Every issue entry under the log id of its batch, as ``dq_issues`` is stored."""
    ids = attach_scalar(with_row_positions(verdict_df.select("batch_id"), ["batch_id"], out="pos"), log_max).select(
        "batch_id", (F.col("log_max") + F.col("pos")).cast("bigint").alias("log_id"))
    return issues_df.join(ids, "batch_id").select(
        F.col("log_id").alias("batch_id"), *[c for c in quality.ISSUE_COLUMNS if c != "batch_id"])


def unstorable(clean_df: DataFrame) -> DataFrame:
    """Batches (batch_id) with an amount that the fact can't hold."""
    too_large = [F.col(c).isNotNull() & F.col(c).try_cast(MONEY).isNull() for c in ("revenue", "expenses")]
    return clean_df.where(too_large[0] | too_large[1]).select("batch_id").distinct()


def log_entries(verdict_df: DataFrame, issues_df: DataFrame, log_max: DataFrame,
                submitted_at: str, failed: DataFrame | None = None) -> DataFrame:
    """One ingestion-log row per audited batch, ids after the current log
    maximum in batch order; health in percent (2 decimals).  Batches in
    ``failed`` (batch_id, db_error) were not written: Rejected, with the error."""
    ij = quality.issues_json(issues_df)
    rows = with_row_positions(verdict_df, ["batch_id"], out="pos").join(ij, "batch_id", "left")
    if failed is not None:
        bad = F.col("db_error").isNotNull()
        rows = rows.join(failed, "batch_id", "left").withColumns({
            "status": F.when(bad, F.lit("Rejected")).otherwise(F.col("status")),
            "issues_json": F.when(bad, F.to_json(F.create_map(F.lit("db_error"), F.array("db_error"))))
            .otherwise(F.col("issues_json")),
            "accepted_rows": F.when(bad, F.lit(0).cast("bigint")).otherwise(F.col("accepted_rows")),
            "rejected_rows": F.when(bad, F.col("row_count").cast("bigint")).otherwise(F.col("rejected_rows"))})
    return (attach_scalar(rows, log_max)
            .select(
                (F.col("log_max") + F.col("pos")).cast("bigint").alias("batch_id"),
                F.lit(submitted_at).cast("timestamp_ntz").alias("submitted_at"),
                "filename",
                F.col("row_count").cast("bigint").alias("row_count"),
                "status",
                (F.round(F.col("health_score") * 100.0, 2) + F.lit(0.0)).alias("health_score"),
                F.coalesce(F.col("issues_json"), F.lit("{}")).alias("issues_json"),
                "accepted_rows", "rejected_rows"))


def initial_log(fact_tx: DataFrame, submitted_at: str, filename: str = "transactions.csv") -> DataFrame:
    """The log row written by the initial load."""
    return fact_tx.agg(F.count(F.lit(1)).alias("n")).select(
        F.lit(1).cast("bigint").alias("batch_id"),
        F.lit(submitted_at).cast("timestamp_ntz").alias("submitted_at"),
        F.lit(filename).alias("filename"),
        F.col("n").alias("row_count"),
        F.lit("Accepted").alias("status"),
        F.lit(100.0).alias("health_score"),
        F.lit("[]").alias("issues_json"),
        F.col("n").alias("accepted_rows"),
        F.lit(0).cast("bigint").alias("rejected_rows"),
    )


def integrity_audit(fact_tx: DataFrame, dim_departments: DataFrame, dim_regions: DataFrame) -> DataFrame:
    """Table sizes and negative amounts stored in the fact."""
    f = fact_tx.agg(F.count(F.lit(1)).alias("total_transactions"),
                    F.count_if(F.col("revenue") < 0).alias("negative_revenue_rows"),
                    F.count_if(F.col("expenses") < 0).alias("negative_expense_rows"))
    d = dim_departments.agg(F.count(F.lit(1)).alias("total_departments"))
    r = dim_regions.agg(F.count(F.lit(1)).alias("total_regions"))
    return attach_scalar(attach_scalar(d, r), f)


# Business names of the log listing (projection only).
LOG_LISTING_NAMES = {
    "batch_id": "Batch ID", "submitted_at": "Timestamp", "filename": "Filename", "row_count": "Total Rows",
    "status": "Verdict Status", "health_score": "Health Score", "issues_json": "Issues",
    "accepted_rows": "Accepted Rows", "rejected_rows": "Rejected Rows",
}


def log_listing(log: DataFrame) -> DataFrame:
    """The ingestion log under its business column names."""
    return log.select(*[F.col(c).alias(n) for c, n in LOG_LISTING_NAMES.items()])
