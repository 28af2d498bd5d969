"""Helpers the operators share: narrow inputs, row removal, crc32 splits."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ledgerline.session import materialize, scratch_path  # noqa: F401  (re-exported)


def narrow(docs: DataFrame, id_col: str, text_col: str, *more: Column) -> DataFrame:
    """(doc_id, text) of ``docs`` under fixed names, whatever else the table holds; a null text is empty."""
    return docs.select(F.col(id_col).cast("long").alias("doc_id"),
                       F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"), *more)


def texts(batches: Iterator[pa.RecordBatch], size: int = 512) -> Iterator[tuple[pa.RecordBatch, list[str]]]:
    """Record batches in slices of ``size`` rows, so few texts at a time are Python objects."""
    for batch in batches:
        for i in range(0, batch.num_rows, size):
            part = batch.slice(i, size)
            yield part, [t or "" for t in part.column("text").to_pylist()]


def row_hash(text_col: str = "text") -> Column:
    """Tells apart rows that repeat a doc_id (with the id, the key of a row)."""
    return F.xxhash64(F.coalesce(F.col(text_col).cast("string"), F.lit("")))


def remove_rows(docs: DataFrame, dropped: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` without the rows keyed (doc_id, text_hash) in ``dropped``; of rows that repeat a key, one stays.

    One exchange on the key serves the anti join and the row number; AQE broadcasts ``dropped`` where it is small.
    """
    key, val = "__row_id", "__row_hash"
    keyed = docs.withColumn(key, F.coalesce(F.col(id_col).cast("long"), F.lit(-(2 ** 63)))).withColumn(
        val, row_hash(text_col))
    gone = dropped.select(F.coalesce("doc_id", F.lit(-(2 ** 63))).alias(key), F.col("text_hash").alias(val))
    rank = F.row_number().over(Window.partitionBy(key, val).orderBy(F.lit(1)))
    return (keyed.join(gone, [key, val], "left_anti").withColumn("__row_no", rank)
            .where(F.col("__row_no") == 1).select(*[F.col(f"`{c}`") for c in docs.columns]))


def held_out(id_col: str = "doc_id") -> Column:
    """crc32 of the id as text, mod 3, is 1: never trained on. A null id counts as the empty text."""
    return F.crc32(F.coalesce(F.col(id_col).cast("string"), F.lit("")).cast("binary")) % 3 == 1
