"""Stored tables: the star schema and the ingestion log as Parquet folders, with a commit log.

Every run writes its rows into folders of its own (``<table>/segment=<run>``; a
dimension that gained members is a new folder beside the old one) and then
claims the next number in ``commits/``, where each file names all that is
visible from then on: the fact's and the log's segments, a folder for each
dimension, and the next free ids.  A number can be claimed once, so of two
writers that started from the same commit one is told to start again from the
other's (``CommitConflict``); what it had written stays invisible.  Readers open
the newest commit and see all of it or, before, all of the one before.

The fact is partitioned by month (``period``, yyyymm) inside its segments, and
sorted by region and department inside a file, so slicers skip files and row groups.

The claim is a hard link on a local folder and a rename that refuses an existing
target elsewhere: the store's file system must rename atomically.
"""

from __future__ import annotations

import json
import os
import uuid
from collections.abc import Sequence
from dataclasses import asdict, dataclass, field, replace

from py4j.protocol import Py4JJavaError
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.star import Star, period_of
from . import files

DIMENSION_TABLES = ("dim_departments", "dim_regions", "dim_products", "dim_expense_categories")
STAR_TABLES = ("fact_transactions", "fact_budgets", "fact_invoices", *DIMENSION_TABLES)
SEGMENTED = "fact_transactions"
#: Every issue of every audited upload.
ISSUES = "dq_issues"
LOG = "ingestion_log"
COMMITS = "commits"
REJECTS = "load_rejects"
#: Segments that a reader opens by name; more are joined.
NAMED_SEGMENTS = 1000
#: What log rows hold beyond the log's own columns: the epoch that wrote them and the upload they are of.
LOG_KEYS = ("commit_key", "upload_key", "was_read")

#: Given, so that a fact without rows, which has no files, can be read.
REJECT_SCHEMA = f"input string, {files.REJECT_SCHEMA}"
FACT_SCHEMA = ("transaction_id bigint, date date, revenue decimal(18,4), expenses decimal(18,4), dept_id int, region_id int, "
               "product_id int, category_id int, client_id string, segment string, period int")


class CommitConflict(Exception):
    """Another writer has committed since the commit this one started from."""


@dataclass(frozen=True)
class Commit:
    """What is visible at a version."""

    version: int = 0
    facts: list[str] = field(default_factory=list)
    audits: list[str] = field(default_factory=list)
    folders: dict[str, str] = field(default_factory=dict)
    next_transaction_id: int = 1
    next_log_id: int = 1
    #: Rollup folders, each with the fact's segments it stands for.
    rollups: dict[str, list[str]] = field(default_factory=dict)


def table_path(root: str, name: str) -> str:
    return f"{root.rstrip('/')}/{name}"


def new_run() -> str:
    """A name for a run's folders that no other run has."""
    return f"r{uuid.uuid4().hex[:16]}"


# --- commits ---------------------------------------------------------------------------------------------------

def _hadoop(spark: SparkSession, path: str):
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark._jsc.hadoopConfiguration()), at


def head(spark: SparkSession, root: str) -> Commit | None:
    """The newest commit; None where nothing was committed."""
    fs, folder = _hadoop(spark, table_path(root, COMMITS))
    if not fs.exists(folder):
        return None
    names = sorted(n for n in (s.getPath().getName() for s in fs.listStatus(folder)) if n.endswith(".json") and n[0] != ".")
    if not names:
        return None
    stream = fs.open(spark._jvm.org.apache.hadoop.fs.Path(folder, names[-1]))
    try:
        return Commit(**json.loads(spark._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")))
    finally:
        stream.close()


def commit(spark: SparkSession, root: str, base: Commit | None, **changes) -> Commit:
    """Make ``base`` with ``changes`` the newest commit, unless another followed ``base`` already (CommitConflict)."""
    base = base or Commit()
    new = replace(base, version=base.version + 1, **changes)
    folder = table_path(root, COMMITS)
    fs, path = _hadoop(spark, folder)
    fs.mkdirs(path)
    name = f"{new.version:012d}.json"
    draft = spark._jvm.org.apache.hadoop.fs.Path(path, f".{name}-{new_run()}")
    out = fs.create(draft, False)
    out.write(bytearray(json.dumps(asdict(new)).encode()))
    out.close()
    target = spark._jvm.org.apache.hadoop.fs.Path(path, name)
    try:
        if fs.getScheme() == "file":
            os.link(draft.toUri().getPath(), target.toUri().getPath())
        else:
            options = spark._sc._gateway.new_array(spark._jvm.org.apache.hadoop.fs.Options.Rename, 0)
            spark._jvm.org.apache.hadoop.fs.FileContext.getFileContext(
                fs.getUri(), spark._jsc.hadoopConfiguration()).rename(draft, target, options)
    except FileExistsError:
        raise CommitConflict(name) from None
    except Py4JJavaError as exc:
        if "FileAlreadyExists" not in str(exc.java_exception):
            raise
        raise CommitConflict(name) from None
    finally:
        fs.delete(draft, False)
    return new


# --- reading ---------------------------------------------------------------------------------------------------

def read_table(spark: SparkSession, root: str, name: str, at: Commit | None = None) -> DataFrame:
    """One stored table at a commit (default: the newest); a missing table raises AnalysisException.

    The fact comes with its ``period``."""
    if name in (SEGMENTED, ISSUES, LOG):
        return committed(spark, root, name, at).drop("segment", *(LOG_KEYS if name == LOG else ()))
    at = at or head(spark, root)
    folder = (at.folders if at else {}).get(name)
    return spark.read.parquet(table_path(root, f"{name}/{folder}" if folder else name))


def committed(spark: SparkSession, root: str, name: str, at: Commit | None = None) -> DataFrame:
    """A segmented table with its ``segment``, as far as the commit names its segments."""
    at = at or head(spark, root) or Commit()
    return segments(spark, root, name, at.facts if name == SEGMENTED else at.audits)


def segments(spark: SparkSession, root: str, name: str, names: Sequence[str]) -> DataFrame:
    """The rows of the segments ``names``, with their ``segment``."""
    base = table_path(root, name)
    reader = spark.read.option("basePath", base)
    if name == SEGMENTED:
        reader = reader.schema(FACT_SCHEMA)
    if 0 < len(names) <= NAMED_SEGMENTS:  # what no commit names is not even listed
        return reader.parquet(*[f"{base}/segment={n}" for n in names])
    return reader.parquet(base).join(spark.createDataFrame([(n,) for n in names], "segment string"), "segment", "left_semi")


def is_logged(spark: SparkSession, root: str, commit_key: str) -> bool:
    """Whether the run of ``commit_key`` is in the log."""
    return not committed(spark, root, LOG).where(F.col("commit_key") == commit_key).isEmpty()


def read_uploads(spark: SparkSession, root: str, keys: Sequence[str]) -> set[str]:
    """Which of the uploads ``keys`` (at most a micro-batch's) were read and audited before."""
    log = committed(spark, root, LOG).where(F.col("was_read") & F.col("upload_key").isin(list(keys)))
    return {r["upload_key"] for r in log.select("upload_key").distinct().collect()}


# --- writing: nothing is visible before its commit ---------------------------------------------------------------

def write_table(df: DataFrame, root: str, name: str, mode: str = "overwrite") -> None:
    df.write.mode(mode).parquet(table_path(root, name))


def write_segment(df: DataFrame, root: str, run: str) -> None:
    """A run's fact rows by month; a hot month is split over tasks, small ones share files."""
    (df.withColumn("period", period_of(F.col("date"))).hint("rebalance", "period")
     .sortWithinPartitions("period", "region_id", "dept_id").write.mode("overwrite").partitionBy("period")
     .parquet(f"{table_path(root, SEGMENTED)}/segment={run}"))


def write_issues(df: DataFrame, root: str, run: str) -> None:
    df.write.mode("overwrite").parquet(f"{table_path(root, ISSUES)}/segment={run}")


def write_log(rows: DataFrame, root: str, run: str, commit_key: str | None = None) -> None:
    """A run's log rows, one for each batch; ``upload_key`` and ``was_read`` are null where a row has none."""
    for name, kind in (("upload_key", "string"), ("was_read", "boolean")):
        if name not in rows.columns:
            rows = rows.withColumn(name, F.lit(None).cast(kind))
    rows = rows.withColumn("commit_key", F.lit(commit_key).cast("string"))
    rows.coalesce(1).write.mode("overwrite").parquet(f"{table_path(root, LOG)}/segment={run}")


def write_folder(df: DataFrame, root: str, name: str, run: str) -> str:
    """A new version of a small table; the folder's name for the commit."""
    df.write.mode("overwrite").parquet(table_path(root, f"{name}/v={run}"))
    return f"v={run}"


def write_star(star: Star, root: str, log_rows: DataFrame | None = None, run: str | None = None,
               rejects: DataFrame | None = None) -> Commit:
    """Initial load: all tables and, once they lie there, the commit that shows them instead of what was before."""
    spark = star.fact_transactions.sparkSession
    base, run = head(spark, root), run or new_run()
    tables = star.tables()
    folders = {name: write_folder(tables[name], root, name, run) for name in STAR_TABLES if name != SEGMENTED}
    if rejects is not None:
        folders[REJECTS] = write_folder(rejects, root, REJECTS, run)
    write_segment(tables[SEGMENTED].drop("period"), root, run)
    if log_rows is not None:
        write_log(log_rows, root, run)
    stored = spark.read.schema(FACT_SCHEMA).parquet(f"{table_path(root, SEGMENTED)}/segment={run}")
    last = stored.agg(F.max("transaction_id")).first()[0] or 0
    return commit(spark, root, base, facts=[run], audits=[run] if log_rows is not None else [], folders=folders,
                  next_transaction_id=last + 1, next_log_id=2 if log_rows is not None else 1, rollups={})


def read_star(spark: SparkSession, root: str) -> Star:
    at = head(spark, root)
    return Star(**{name: read_table(spark, root, name, at) for name in STAR_TABLES})


def read_rejects(spark: SparkSession, root: str) -> DataFrame:
    """What the initial load did not store (input, place in the file, record, reason); empty where it was not told apart."""
    at = head(spark, root)
    if at is None or REJECTS not in at.folders:
        return spark.createDataFrame([], REJECT_SCHEMA)
    return read_table(spark, root, REJECTS, at)


def export_report(report: DataFrame, path: str) -> None:
    """Download export of a report table: one CSV file with a header.  Reports
    are bounded by the dimension sizes (a handful of rows), so one task is fine."""
    report.coalesce(1).write.mode("overwrite").option("header", True).csv(path)


def in_months(first: str, last: str) -> Column:
    """The fact's rows of the months ``first`` to ``last`` (yyyy-MM), by its partitions."""
    lo, hi = (int(m[:4]) * 100 + int(m[5:7]) for m in (first, last))
    return F.col("period").between(lo, hi)
