"""Upload reader (S5): one uploaded file -> a raw batch of text columns.

Dispatch on the (case-sensitive) file suffix; CSV is read with every column
as text so results never depend on type inference.  Row order is file
order: (file path, split start, position inside the split) -- numbered with
the skew-safe position operator, not a single-task window.
"""

from __future__ import annotations

import os

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.ingest import number_rows
from ..session import materialize


class UploadRejected(Exception):
    """The file cannot be audited (unsupported, unreadable or empty); not logged."""


def read_upload(spark: SparkSession, path: str, filename: str | None = None, batch_id: int = 1,
                multi_line: bool = False) -> DataFrame:
    """``multi_line`` allows quoted newlines in CSV fields but makes each file
    one task (unsplittable); leave it off for large files."""
    name = filename or os.path.basename(path.rstrip("/"))
    try:
        if name.endswith(".csv"):
            df = (spark.read.option("header", True).option("inferSchema", False)
                  .option("multiLine", multi_line).csv(path))
        elif name.endswith(".json"):
            df = spark.read.json(path)
        elif name.endswith(".parquet"):
            df = spark.read.parquet(path)
        else:
            raise UploadRejected("Unsupported file format.")
    except UploadRejected:
        raise
    except Exception as exc:  # noqa: BLE001 - any reader failure rejects the file
        raise UploadRejected(f"Failed to read file: {exc}") from exc
    data_cols = list(df.columns)
    tagged = df.select(
        F.lit(batch_id).cast("int").alias("batch_id"),
        F.lit(name).alias("filename"),
        *[F.col(f"`{c}`").cast("string").alias(c) for c in data_cols],
        F.col("_metadata.file_path").alias("_u_file"),
        F.col("_metadata.file_block_start").alias("_u_block"),
        F.monotonically_increasing_id().alias("_u_pos"),
    )
    # written once: positions are fixed, later jobs read Parquet, not the upload
    return number_rows(materialize(tagged, "upload"), ["_u_file", "_u_block", "_u_pos"])
