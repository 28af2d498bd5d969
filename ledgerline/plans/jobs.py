"""Writing jobs: initial load and the per-file ingestion (audit gate + merge).

The transforms live in ``operators``; these functions only sequence them
and apply the writes.  The single driver-side action of an ingestion is the
one-row verdict (and the <= 9-row issue summary for the caller).
"""

from __future__ import annotations

import datetime as _dt
import json
from collections.abc import Sequence
from dataclasses import replace
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import ingest, quality
from ..operators import star as star_ops
from ..session import materialize
from ..sources import files, tables
from ..sources.uploads import UploadRejected, read_upload

#: Times a run is planned again because another writer committed first.
MAX_TRIES = 50


def init_load(spark: SparkSession, root: str, raw_tx: DataFrame, raw_budgets: DataFrame, raw_invoices: DataFrame,
              submitted_at: str | None = None, filename: str = "transactions.csv",
              rejects: DataFrame | None = None) -> star_ops.Star:
    """Build the star from the raw files and write it (replacing), with the seed log row and the files' ``rejects``."""
    submitted_at = submitted_at or _dt.datetime.now().strftime("%Y-%m-%d %H:%M:%S")
    star = star_ops.build_star(raw_tx, raw_budgets, raw_invoices)
    fact = materialize(star.fact_transactions, "facts")  # the load and its log row read the numbered rows once
    star = replace(star, fact_transactions=fact)
    tables.write_star(star, root, ingest.initial_log(fact, submitted_at, filename), rejects=rejects)
    return tables.read_star(spark, root)


def init_load_checked(spark: SparkSession, root: str, transactions: str, budgets: str, invoices: str | None = None,
                      submitted_at: str | None = None) -> star_ops.Star:
    """``init_load`` from the paths of the files: records that can't be stored become rejects, and the others load."""
    read = {"transactions": files.read_checked_transactions(spark, transactions),
            "budgets": files.read_checked_budgets(spark, budgets),
            "invoices": files.read_checked_invoices(spark, invoices)}
    rejects = [r.withColumn("input", F.lit(name)).select("input", *r.columns) for name, (_, r) in read.items()]
    return init_load(spark, root, *(rows for rows, _ in read.values()), submitted_at=submitted_at,
                     rejects=reduce(DataFrame.unionByName, rejects))


def audit_batch(clean_df: DataFrame, as_of) -> tuple[DataFrame, DataFrame]:
    return quality.issues(clean_df, as_of), ingest.verdicts(clean_df, as_of)


def apply_batches(spark: SparkSession, root: str, clean_df: DataFrame, as_of, submitted_at: str,
                  commit_key: str | None = None, upload_keys: Sequence[str] = (),
                  unread: Sequence[tuple[str, str, str]] = ()) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Audit, merge and log a set of cleaned batches (``batch_id`` 1..k, in
    arrival order): extended dimensions, one fact segment, the issues and one log
    row per batch, made visible together by one commit.  Where another writer
    commits first, all but the audit is done again on top of it, so ids stay
    disjoint and no batch is lost.  A batch that can't be stored is rejected alone.

    ``upload_keys``: the identity of each batch's upload, in order.  ``unread``:
    (filename, key, reason) of uploads that could not be read, logged as
    Rejected after the others.  Returns (log rows, verdicts, issues)."""
    issues_df, verdict_df = audit_batch(clean_df, as_of)
    issues_df = materialize(issues_df, "issues")  # read by the log JSON and the summary
    verdict_df = materialize(verdict_df, "verdicts")  # one row per batch
    passed = ingest.merged_batches(verdict_df)
    unstorable = materialize(passed.join(ingest.unstorable(clean_df), "batch_id", "left_semi").select(
        "batch_id", F.lit("Database write failure: an amount is too large to store").alias("db_error")), "failed")
    for _ in range(MAX_TRIES):
        base, run = tables.head(spark, root), tables.new_run()
        if base is None:
            raise ValueError(f"{root} holds no star schema: load it first")
        failed, added, folders, facts, merged_rows = unstorable, base.next_log_id - 1, dict(base.folders), list(base.facts), 0
        merged = passed.join(failed, "batch_id", "left_anti")
        if not merged.isEmpty():
            try:
                merged_rows = _write_merged(spark, root, base, run, clean_df, merged, folders)
                facts.append(run)
            except Exception as exc:  # noqa: BLE001 - a failed write rejects the merged batches; no commit names the segment
                folders = dict(base.folders)
                failed = failed.unionByName(merged.select(
                    "batch_id", F.lit(f"Database write failure: {exc}").alias("db_error")))
        log_max = spark.createDataFrame([(added,)], "log_max bigint")
        tables.write_issues(ingest.stored_issues(verdict_df, issues_df, log_max), root, run)
        log_rows = ingest.log_entries(verdict_df, issues_df, log_max, submitted_at, failed)
        log_rows = materialize(_with_uploads(log_rows, added, submitted_at, upload_keys, unread), "log")
        tables.write_log(log_rows, root, run, commit_key)
        try:
            tables.commit(spark, root, base, facts=facts, audits=[*base.audits, run], folders=folders,
                          next_transaction_id=base.next_transaction_id + merged_rows,
                          next_log_id=base.next_log_id + log_rows.count())
        except tables.CommitConflict:
            continue
        return log_rows.drop("upload_key", "was_read"), verdict_df, issues_df
    raise RuntimeError(f"{MAX_TRIES} commits of other writers came first")


def _write_merged(spark: SparkSession, root: str, base: tables.Commit, run: str, clean_df: DataFrame, merged: DataFrame,
                  folders: dict[str, str]) -> int:
    """Write the merged batches' facts and the dimensions that gained members (into ``folders``); the number of rows."""
    dims = {t: tables.read_table(spark, root, t, base) for t, _, _, _ in star_ops.DIMENSIONS}
    ext = ingest.extended_dimensions(dims, clean_df, merged)
    changed = {r["dim"] for r in ext.pop("_added").select("dim").distinct().collect()}  # <= 4 rows
    facts = materialize(ingest.new_transactions(
        spark.createDataFrame([(base.next_transaction_id - 1,)], "transaction_id bigint"), clean_df, merged, ext)
        .drop("batch_id"), "facts")
    for t, _, _, raw in star_ops.DIMENSIONS:
        if raw in changed:
            folders[t] = tables.write_folder(ext[t], root, t, run)
    tables.write_segment(facts, root, run)
    return facts.count()


def _with_uploads(log_rows: DataFrame, added: int, submitted_at: str, upload_keys: Sequence[str],
                  unread: Sequence[tuple[str, str, str]]) -> DataFrame:
    """The log rows with their uploads' keys, and a Rejected row for each upload that was not read."""
    spark = log_rows.sparkSession
    keys = spark.createDataFrame([(added + i, k) for i, k in enumerate(upload_keys, 1)], "batch_id bigint, upload_key string")
    log_rows = log_rows.join(keys, "batch_id", "left").withColumn("was_read", F.lit(True))
    first = added + len(upload_keys) + 1
    lost = spark.createDataFrame(
        [(first + i, name, json.dumps({"read_error": [reason]}), key) for i, (name, key, reason) in enumerate(unread)],
        "batch_id bigint, filename string, issues_json string, upload_key string")
    zero = F.lit(0).cast("bigint")
    return log_rows.unionByName(lost.select(
        "batch_id", F.lit(submitted_at).cast("timestamp_ntz").alias("submitted_at"), "filename", zero.alias("row_count"),
        F.lit("Rejected").alias("status"), F.lit(0.0).alias("health_score"), "issues_json", zero.alias("accepted_rows"),
        zero.alias("rejected_rows"), "upload_key", F.lit(False).alias("was_read")))


def ingest_file(spark: SparkSession, path: str, root: str, as_of: _dt.date | str | None = None,
                filename: str | None = None, submitted_at: str | None = None) -> dict:
    """Upload -> map -> clean -> audit -> verdict -> merge -> log."""
    as_of = as_of or _dt.date.today()
    submitted_at = submitted_at or _dt.datetime.now().strftime("%Y-%m-%d %H:%M:%S")
    try:
        raw = read_upload(spark, path, filename)
        if raw.isEmpty():
            return {"success": False, "msg": "The uploaded file is empty.", "status": "Rejected"}
    except UploadRejected as exc:
        return {"success": False, "msg": str(exc), "status": "Rejected"}
    clean_df = materialize(ingest.clean(ingest.mapped(raw)), "batch")
    log_rows, verdict_df, issues_df = apply_batches(spark, root, clean_df, as_of, submitted_at)
    logged, verdict = log_rows.first(), verdict_df.first()  # one batch, one row
    summary = {r["rule"]: {"severity": r["severity"], "count": r["issue_count"], "first_msg": r["first_msg"],
                           "affected": r["affected"]}
               for r in quality.issue_summary(issues_df).collect()}  # <= 9 rows
    return {"success": logged["accepted_rows"] > 0 or logged["status"] == "Needs Review",
            "status": logged["status"], "health_score": float(verdict["health_score"]),
            "row_count": int(verdict["row_count"]), "accepted_rows": int(logged["accepted_rows"]),
            "rejected_rows": int(logged["rejected_rows"]), "issues": summary,
            "batch_id": int(logged["batch_id"]), "filename": logged["filename"]}
