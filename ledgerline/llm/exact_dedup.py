"""Exact duplicates by a heavy-hitter split.

Every text becomes a digest.  A Misra-Gries summary of each partition, added
up, names the digests that may be frequent; the summaries are verified by
exact counts, and the verified winners (at most ``counters`` rows, so safe to
broadcast) settle their rows on the map side.  No digest that is left has more
than ``2 N / (counters + 1)`` rows, and those go through an ordinary shuffle.
"""

from __future__ import annotations

import hashlib
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerline.llm.common import materialize, narrow, remove_rows, row_hash, texts

COUNTERS = 1024


def _digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for part, values in texts(batches):
        # bytes.lower() maps A-Z and nothing else
        sha = [hashlib.sha256(t.encode().lower()).digest() for t in values]
        yield pa.RecordBatch.from_arrays(
            [part.column("doc_id"), part.column("text_hash"), pa.array(sha, pa.binary())],
            names=["doc_id", "text_hash", "digest"])


def misra_gries(counts: Counter, k: int) -> Counter:
    """Cut a summary back to ``k`` counters: take the (k+1)-th largest count from all, keep what stays positive."""
    if len(counts) <= k:
        return counts
    cut = sorted(counts.values(), reverse=True)[k]
    return Counter({d: c - cut for d, c in counts.items() if c > cut})


def _summaries(k: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts: Counter = Counter()
        for batch in batches:
            counts.update(batch.column("digest").to_pylist())
            counts = misra_gries(counts, k)
        yield pa.RecordBatch.from_arrays(
            [pa.array(list(counts), pa.binary()), pa.array(list(counts.values()), pa.int64())],
            names=["digest", "counter"])

    return run


def exact_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                     counters: int = COUNTERS) -> DataFrame:
    """One row per row of ``docs``: doc_id, text_hash, keep_id, keep_hash, group_size, kept, text_sha256.

    Texts are equal when identical after lower-casing A-Z.  The largest doc_id
    of a group stays.  A null text counts as empty; a null doc_id is smaller
    than any other; of rows that repeat the winning doc_id exactly one is kept.
    ``text_hash`` and ``keep_hash`` are of the text as it is, of the row and of
    the kept row.  An empty table gives no rows; further columns are ignored.
    """
    rows = narrow(docs, id_col, text_col, row_hash(text_col).alias("text_hash"))
    keyed = materialize(rows.mapInArrow(_digest, "doc_id long, text_hash long, digest binary")
                        .withColumn("row_no", F.monotonically_increasing_id()), "digests")
    total = keyed.count()

    best = F.max(F.struct("doc_id", "row_no", "text_hash")).alias("best")  # a null doc_id orders first
    size = F.count(F.lit(1)).alias("group_size")
    candidates = (keyed.select("digest").mapInArrow(_summaries(counters), "digest binary, counter long")
                  .groupBy("digest").agg(F.sum("counter").alias("counter"))
                  .orderBy(F.desc("counter"), "digest").limit(counters).select("digest"))
    winners = materialize(
        keyed.join(F.broadcast(candidates), "digest").groupBy("digest").agg(size, best)
        .where(F.col("group_size") >= max(2, total // (counters + 1))), "winners")

    heavy = keyed.join(F.broadcast(winners), "digest")
    light = keyed.join(F.broadcast(winners.select("digest")), "digest", "left_anti")
    light = light.join(light.groupBy("digest").agg(size, best), "digest")
    return heavy.unionByName(light).select(
        "doc_id", "text_hash", F.col("best.doc_id").alias("keep_id"), F.col("best.text_hash").alias("keep_hash"),
        "group_size", (F.col("row_no") == F.col("best.row_no")).alias("kept"),
        F.lower(F.hex("digest")).alias("text_sha256"))


def deduplicate(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                counters: int = COUNTERS) -> DataFrame:
    """The rows of ``docs`` that stay, with all their columns.

    Rows that repeat the kept row's id and text as they are differ in nothing
    that the rule looks at; ``remove_rows`` leaves one of them.
    """
    found = exact_duplicates(docs, id_col, text_col, counters)
    repeats = F.col("doc_id").eqNullSafe(F.col("keep_id")) & (F.col("text_hash") == F.col("keep_hash"))
    return remove_rows(docs, found.where(~repeats).select("doc_id", "text_hash").distinct(), id_col, text_col)
