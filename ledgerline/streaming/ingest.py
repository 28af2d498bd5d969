"""Incremental ingestion as a file stream (T1).

``readStream`` over a folder names the uploads of a micro-batch, and
``foreachBatch`` runs the same multi-batch transforms as the batch job: every
upload is one batch (numbered by path), audited in parallel and merged in order.
An upload is a CSV file, or a folder of CSV files announced once it is complete;
the trigger's file limit counts uploads or announcements and never splits one.

The lines of all uploads are read once.  Each file is mapped by the header line
it carries, whatever its spelling and the order of its columns: a table with a
row for each distinct header line says at which place each canonical column
stands, so one plan serves any mix of headers.

An upload that is missing, unreadable or empty is logged as Rejected with the
reason and the others go on.  The log row of an upload carries its path: one
that was audited before is skipped, one that could not be read may be announced
again.  Replays are safe: log rows carry their epoch too, and nothing of an
epoch is visible before its commit.
"""

from __future__ import annotations

import csv
import datetime as _dt
import re
from collections.abc import Sequence
from dataclasses import dataclass

from py4j.protocol import Py4JError
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..functions.headers import CANONICAL, null_tokens, resolve_headers
from ..operators import ingest
from ..plans.jobs import apply_batches
from ..session import materialize
from ..sources import tables

#: Columns of the stream over files of which only the names are read.
_FILES = "path string, modificationTime timestamp, length bigint, content binary"
#: The reasons of the upload reader.
EMPTY, UNSUPPORTED = "The uploaded file is empty.", "Unsupported file format."


@dataclass(frozen=True)
class Upload:
    """``key``: the path in one spelling, the upload's identity; ``name``: its label in the log."""

    path: str
    key: str
    name: str
    is_folder: bool = False


def _one_spelling(path: str) -> str:
    """``file:///x`` and ``file:/x`` are one path."""
    return re.sub("^([a-zA-Z][a-zA-Z0-9+.-]*):/+", r"\1:/", path.rstrip("/"))


def _in_one_spelling(path: Column) -> Column:
    return F.regexp_replace(path, "^([a-zA-Z][a-zA-Z0-9+.-]*):/+", "$1:/")


def find_uploads(spark: SparkSession, paths: Sequence[str]) -> tuple[list[Upload], list[tuple[str, str, str]]]:
    """The uploads at ``paths`` by key, and (name, key, reason) of those that aren't there or are of no known format."""
    found, unread = {}, {}
    for path in paths:
        name = re.sub("^[^=]*=", "", path.rstrip("/").rsplit("/", 1)[-1])
        try:
            at = spark._jvm.org.apache.hadoop.fs.Path(path)
            fs = at.getFileSystem(spark._jsc.hadoopConfiguration())
            at = fs.makeQualified(at)
            key = _one_spelling(at.toUri().toString())
            upload = Upload(path, key, name, fs.exists(at) and fs.getFileStatus(at).isDirectory())
            if not fs.exists(at):
                unread[key] = (name, key, f"Failed to read file: {path} does not exist.")
            elif not upload.is_folder and not name.endswith(".csv"):
                unread[key] = (name, key, UNSUPPORTED)
            else:
                found[key] = upload
        except Py4JError as exc:  # no path at all, or of an unknown file system
            unread[path] = (name, path, f"Failed to read file: {str(exc).splitlines()[0]}")
    return [found[k] for k in sorted(found)], [unread[k] for k in sorted(unread)]


def _lines(spark: SparkSession, uploads: Sequence[Upload]) -> DataFrame:
    """The uploads' lines that are not blank, written once with their place: upload, file, split, position."""
    parts = []
    for folders in (False, True):
        paths = [u.path for u in uploads if u.is_folder == folders]
        if paths:
            file = _in_one_spelling(F.col("_metadata.file_path"))
            key = F.regexp_replace(file, "/[^/]*$", "") if folders else file
            parts.append(spark.read.text(paths).where(F.trim("value") != "").select(
                key.alias("_u_key"), file.alias("_u_file"), F.col("_metadata.file_block_start").alias("_u_block"),
                F.monotonically_increasing_id().alias("_u_pos"), F.col("value").alias("line")))
    return materialize(parts[0] if len(parts) == 1 else parts[0].unionByName(parts[1]), "upload_lines")


def read_lines(spark: SparkSession, uploads: Sequence[Upload]) -> tuple[list[DataFrame], list[tuple[Upload, str]]]:
    """The lines of all uploads that can be read, and the others with the reason: a failed read is halved until the
    uploads that fail stand alone."""
    if not uploads:
        return [], []
    try:
        return [_lines(spark, uploads)], []
    except Exception as exc:  # noqa: BLE001 - whatever the reader meets
        if len(uploads) == 1:
            return [], [(uploads[0], f"Failed to read file: {_reason(exc)}")]
    half = len(uploads) // 2
    (a, b), (c, d) = read_lines(spark, uploads[:half]), read_lines(spark, uploads[half:])
    return a + c, b + d


def _reason(exc: Exception) -> str:
    return next((line for line in str(exc).splitlines() if line.strip()), type(exc).__name__)[:500]


def header_names(line: str) -> list[str]:
    """The columns of a header line; an empty name is numbered, as are those that stand there twice."""
    names = next(csv.reader([line.lstrip("﻿")]), [])
    lower = [n.lower() for n in names]
    return [f"_c{i}" if not n else f"{n}{i}" if lower.count(n.lower()) > 1 else n for i, n in enumerate(names)]


def mapped_rows(lines: DataFrame) -> DataFrame:
    """The data rows of ``lines`` with the canonical columns as text, each file mapped by its first line."""
    spark = lines.sparkSession
    place = F.struct("_u_block", "_u_pos")
    headers = materialize(lines.groupBy("_u_file").agg(
        F.min_by("line", place).alias("header"), F.min(place).alias("first")), "headers")  # one row for each file
    kinds = []
    for row in headers.select("header").distinct().collect():  # the distinct spellings of a micro-batch
        names = header_names(row["header"])
        resolved = resolve_headers(names)
        kinds.append((row["header"], len(names), [names.index(resolved[c]) if resolved[c] is not None else -1 for c in CANONICAL]))
    width = max((k[1] for k in kinds), default=1)
    mapping = spark.createDataFrame([(h, places) for h, _, places in kinds], "header string, places array<int>")
    rows = (lines.join(headers.join(mapping, "header").select("_u_file", "first", "places"), "_u_file")
            .where(F.struct("_u_block", "_u_pos") != F.col("first")))
    parsed = F.from_csv("line", ", ".join(f"_c{i} string" for i in range(width)), {"mode": "PERMISSIVE"})
    told = rows.select("_u_key", "_u_file", "_u_block", "_u_pos", "places", parsed.alias("fields"))
    fields = F.array(*[F.col(f"fields._c{i}") for i in range(width)])
    return told.select("_u_key", "_u_file", "_u_block", "_u_pos", *[
        null_tokens(F.when(F.get("places", F.lit(i)) >= 0, F.get(fields, F.get("places", F.lit(i))))).alias(c)
        for i, c in enumerate(CANONICAL)])


def process_uploads(spark: SparkSession, paths: Sequence[str], root: str, as_of, submitted_at: str,
                    commit_key: str | None = None) -> None:
    """One micro-batch: uploads -> batches 1..k by path (the name is only a label), rows in file order."""
    uploads, unread = find_uploads(spark, paths)
    known = tables.read_uploads(spark, root, [u.key for u in uploads])
    uploads = [u for u in uploads if u.key not in known]
    parts, failed = read_lines(spark, uploads)
    unread += [(u.name, u.key, reason) for u, reason in failed]
    rows = None
    for lines in parts:
        own = mapped_rows(lines)
        rows = own if rows is None else rows.unionByName(own)
    filled: set[str] = set()
    if rows is not None:
        rows = materialize(rows, "micro_batch")
        filled = {r["_u_key"] for r in rows.select("_u_key").distinct().collect()}  # at most the uploads
    lost = {u.key for u, _ in failed}
    unread += [(u.name, u.key, EMPTY) for u in uploads if u.key not in filled and u.key not in lost]
    batches = [u for u in uploads if u.key in filled]
    if not batches and not unread:
        return
    numbers = spark.createDataFrame([(i, u.key, u.name) for i, u in enumerate(batches, 1)],
                                    "batch_id int, _u_key string, filename string")
    if rows is None:
        rows = spark.createDataFrame([], ", ".join(f"{c} string" for c in ("_u_key", "_u_file", *CANONICAL))
                                     + ", _u_block long, _u_pos long")
    raw = rows.join(numbers, "_u_key").select("batch_id", "filename", *CANONICAL, "_u_file", "_u_block", "_u_pos")
    numbered = ingest.number_rows(raw, ["_u_file", "_u_block", "_u_pos"])
    clean_df = materialize(ingest.clean(numbered), "batch")
    apply_batches(spark, root, clean_df, as_of, submitted_at, commit_key, [u.key for u in batches], unread)


def start_file_ingest(spark: SparkSession, input_dir: str, root: str, checkpoint_location: str,
                      as_of=None, submitted_at: str | None = None, max_files_per_trigger: int = 1000,
                      available_now: bool = True, announced: bool = False) -> StreamingQuery:
    """Start the stream; with ``available_now`` it drains the folder and stops.

    Each CSV file in ``input_dir`` is one upload.  With ``announced``, the
    folder holds text files instead, whose lines are the paths of upload
    files or folders; write one after the last file of its uploads.
    """
    as_of = as_of or _dt.date.today()
    src = spark.readStream.option("maxFilesPerTrigger", max_files_per_trigger)
    if announced:
        src = src.text(input_dir).select(F.trim("value").alias("path"))
    else:  # the files' names; their contents are not read here
        src = src.format("binaryFile").schema(_FILES).load(input_dir).select("path")

    def each(batch_df: DataFrame, epoch_id: int) -> None:
        key = f"{checkpoint_location.rstrip('/')}#{epoch_id}"
        paths = [r["path"] for r in batch_df.where("path <> ''").distinct().collect()]  # one for each upload
        if not paths or tables.is_logged(spark, root, key):
            return
        stamp = submitted_at or _dt.datetime.now().strftime("%Y-%m-%d %H:%M:%S")
        process_uploads(spark, paths, root, as_of, stamp, key)

    writer = (src.writeStream.foreachBatch(each).option("checkpointLocation", checkpoint_location))
    writer = writer.trigger(availableNow=True) if available_now else writer.trigger(processingTime="10 seconds")
    return writer.start()
