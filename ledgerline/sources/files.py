"""Raw input files of the initial load (S1-S3).

Every file is read with an all-text schema and cast explicitly, so results
never depend on type inference; the reader's missing-value tokens are
normalised to NULL first.  The invoices file is optional: when absent the
load gets an empty table with the right schema.  An amount that is not a
number, or too large to store, stops the load; a missing or blank one is NULL.

``checked`` parts a file into the rows that can be stored and its rejects, so
that such rows are kept with their reasons and the others load.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructType
from pyspark.sql.utils import AnalysisException

from ..functions.cleaning import parse_date, strip
from ..functions.headers import null_tokens
from ..functions.numeric import MONEY
from ..session import materialize

# Header names of the raw files (fixed values).
TRANSACTION_HEADERS = ["Date", "Revenue", "Expenses", "Department", "Region", "Product Line",
                       "Expense Category", "Client ID"]
BUDGET_HEADERS = ["Month", "Department", "Region", "Budgeted Revenue", "Budgeted Expenses"]
INVOICE_HEADERS = ["Invoice ID", "Client ID", "Issue Date", "Amount", "Status"]


# File-order columns: (file, split start, position in split) order the rows.
FILE_ORDER = ["_src_file", "_src_block", "_src_pos"]


# A reject: its place in the file, the record as text and why it is not loaded.
REJECT_SCHEMA = "_src_file string, _src_block bigint, _src_pos bigint, record string, reason string"
# Holds a record with too few or too many fields, as it stands in the file.
_RAGGED = "_src_ragged"


def _text(spark: SparkSession, path: str) -> DataFrame:
    return _placed(spark.read.option("header", True).option("inferSchema", False).csv(path))


def _placed(df: DataFrame) -> DataFrame:
    return df.select(*[(F.col(c) if c == _RAGGED else null_tokens(F.col(f"`{c}`"))).alias(c) for c in df.columns],
                     F.col("_metadata.file_path").alias("_src_file"),
                     F.col("_metadata.file_block_start").alias("_src_block"),
                     F.monotonically_increasing_id().alias("_src_pos"))


def checked(spark: SparkSession, path: str, amounts: Sequence[str]) -> tuple[DataFrame, DataFrame]:
    """(rows, rejects) of a CSV file: each of its records is in one of the two.

    A reject has another number of fields than the header, or a text in a column
    of ``amounts`` that is not an amount that can be stored; ``reason`` names
    all that is wrong.  ``record`` is a ragged record as it stands in the file,
    and any other as CSV of its fields.  Columns of ``amounts`` that the file
    lacks are not looked at.  Rows are text under the file's headers, with their
    place in the file.  The file is parsed once, into a table that both read; a
    record is one line.
    """
    names = spark.read.option("header", True).option("inferSchema", False).csv(path).columns
    schema = StructType()
    for name in [*names, _RAGGED]:
        schema = schema.add(name, StringType())
    read = (spark.read.schema(schema).option("header", True).option("mode", "PERMISSIVE")
            .option("columnNameOfCorruptRecord", _RAGGED).csv(path))
    stored = materialize(_placed(read), "checked")
    fields = [F.col(f"`{c}`") for c in names]
    reasons = [F.when(F.col(_RAGGED).isNotNull(), F.lit("Wrong number of fields"))]
    for name in amounts:
        if name in names:
            text = _amount_text(F.col(f"`{name}`"))
            reasons.append(F.when(F.col(_RAGGED).isNull() & text.isNotNull() & text.try_cast(MONEY).isNull(),
                                  F.lit(f"{name} is not an amount that can be stored")))
    reason = F.concat_ws("; ", *reasons)
    rows = stored.where(reason == "").drop(_RAGGED)
    rejects = stored.where(reason != "").select(
        *FILE_ORDER, F.coalesce(_RAGGED, F.to_csv(F.struct(*fields))).alias("record"), reason.alias("reason"))
    return rows, rejects


def _col(df: DataFrame, name: str) -> F.Column:
    return F.col(f"`{name}`") if name in df.columns else F.lit(None).cast("string")


def _amount_text(c: F.Column) -> F.Column:
    return F.nullif(strip(c), F.lit(""))


def _money(c: F.Column) -> F.Column:
    text = _amount_text(c)
    value = text.try_cast(MONEY)
    refused = F.raise_error(F.concat(F.lit("Not an amount that can be stored: "), text)).cast(MONEY)
    return F.when(text.isNotNull() & value.isNull(), refused).otherwise(value)


def read_transactions(spark: SparkSession, path: str) -> DataFrame:
    """date, revenue, expenses, department, region, product_line, expense_category,
    client_id (NULL when the file has no client column)."""
    return _transactions(_text(spark, path))


def read_checked_transactions(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """The transactions that can be stored, and the rejects of the file."""
    rows, rejects = checked(spark, path, ["Revenue", "Expenses"])
    return _transactions(rows), rejects


def _transactions(t: DataFrame) -> DataFrame:
    return t.select(
        parse_date(_col(t, "Date")).alias("date"),
        _money(_col(t, "Revenue")).alias("revenue"),
        _money(_col(t, "Expenses")).alias("expenses"),
        _col(t, "Department").alias("department"),
        _col(t, "Region").alias("region"),
        _col(t, "Product Line").alias("product_line"),
        _col(t, "Expense Category").alias("expense_category"),
        _col(t, "Client ID").alias("client_id"),
        *FILE_ORDER,
    )


def read_budgets(spark: SparkSession, path: str) -> DataFrame:
    return _budgets(_text(spark, path))


def read_checked_budgets(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """The budgets that can be stored, and the rejects of the file."""
    rows, rejects = checked(spark, path, ["Budgeted Revenue", "Budgeted Expenses"])
    return _budgets(rows), rejects


def _budgets(t: DataFrame) -> DataFrame:
    return t.select(
        _col(t, "Month").alias("month"),
        _col(t, "Department").alias("department"),
        _col(t, "Region").alias("region"),
        _money(_col(t, "Budgeted Revenue")).alias("budgeted_revenue"),
        _money(_col(t, "Budgeted Expenses")).alias("budgeted_expenses"),
        *FILE_ORDER,
    )


INVOICE_SCHEMA = "invoice_id string, client_id string, issue_date date, amount decimal(18,4), status string"


def read_invoices(spark: SparkSession, path: str | None) -> DataFrame:
    """Optional file: a missing path gives an empty invoices table."""
    if path is None:
        return spark.createDataFrame([], INVOICE_SCHEMA)
    try:
        t = _text(spark, path)
    except AnalysisException as exc:
        if exc.getCondition() != "PATH_NOT_FOUND":
            raise
        return spark.createDataFrame([], INVOICE_SCHEMA)
    return _invoices(t)


def read_checked_invoices(spark: SparkSession, path: str | None) -> tuple[DataFrame, DataFrame]:
    """The invoices that can be stored, and the rejects of the file; a missing path has neither."""
    none = spark.createDataFrame([], INVOICE_SCHEMA), spark.createDataFrame([], REJECT_SCHEMA)
    if path is None:
        return none
    try:
        rows, rejects = checked(spark, path, ["Amount"])
    except AnalysisException as exc:
        if exc.getCondition() != "PATH_NOT_FOUND":
            raise
        return none
    return _invoices(rows), rejects


def _invoices(t: DataFrame) -> DataFrame:
    return t.select(
        _col(t, "Invoice ID").alias("invoice_id"),
        _col(t, "Client ID").alias("client_id"),
        parse_date(_col(t, "Issue Date")).alias("issue_date"),
        _money(_col(t, "Amount")).alias("amount"),
        _col(t, "Status").alias("status"),
    )
