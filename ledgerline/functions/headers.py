"""Fuzzy header mapping of uploaded files to the eight canonical columns.

Runs on the driver over ``df.columns`` only (metadata, never data); the
result is a single ``select`` with aliases.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .constants import COLUMN_SYNONYMS, NULL_TOKENS

CANONICAL = list(COLUMN_SYNONYMS)


def normalise_header(h: str) -> str:
    """lower, strip, ``_`` -> space, then one pass of two spaces -> one."""
    return h.lower().strip().replace("_", " ").replace("  ", " ")


def resolve_headers(columns: Sequence[str]) -> dict[str, str | None]:
    """canonical column -> raw header (or None).

    1. headers are normalised; two raw headers with one normal form: last wins;
    2. per canonical column, in order: the first synonym present exactly;
    3. else the first header (file order) containing any synonym;
    4. a header claimed twice goes to the later canonical column.
    Synonyms are normalised like headers, so ``cost_center`` does map
    (an intended change: with raw synonyms it never could).
    """
    normal: dict[str, str] = {}
    for c in columns:
        normal[normalise_header(c)] = c
    claimed: dict[str, str] = {}  # raw header -> canonical
    for canonical, synonyms in COLUMN_SYNONYMS.items():
        syn = [normalise_header(s) for s in synonyms]
        hit = next((normal[s] for s in syn if s in normal), None)
        if hit is None:
            hit = next((raw for low, raw in normal.items() if any(s in low for s in syn)), None)
        if hit is not None:
            claimed[hit] = canonical
    resolved: dict[str, str | None] = {c: None for c in CANONICAL}
    for raw, canonical in claimed.items():
        resolved[canonical] = raw
    return resolved


def null_tokens(c: Column) -> Column:
    """Text the CSV reader of the original application reads as missing."""
    return F.when(c.isin(NULL_TOKENS), F.lit(None).cast("string")).otherwise(c)


def map_columns(raw: DataFrame, keep: Sequence[str] = ()) -> DataFrame:
    """``keep`` columns (batch id, row number, ...) followed by exactly the eight
    canonical columns as text; a canonical column with no source is NULL."""
    data_cols = [c for c in raw.columns if c not in keep]
    resolved = resolve_headers(data_cols)
    out = [F.col(k) for k in keep]
    for canonical, src in resolved.items():
        if src is None:
            out.append(F.lit(None).cast("string").alias(canonical))
        else:
            out.append(null_tokens(F.col(f"`{src}`").cast("string")).alias(canonical))
    return raw.select(*out)


def mapping_report(raw: DataFrame, group_cols: Sequence[str] = ("batch_id",), keep: Sequence[str] = ()) -> DataFrame:
    """Per group and canonical column: the source header, its non-null count and
    whether the column is usable (mapped and not all blank); one aggregate."""
    data_cols = [c for c in raw.columns if c not in keep and c not in group_cols]
    resolved = resolve_headers(data_cols)
    counts = raw.groupBy(*group_cols).agg(*[
        F.count(null_tokens(F.col(f"`{src}`").cast("string"))).alias(f"_n_{i}")
        for i, src in enumerate(resolved.values()) if src is not None])
    rows = []
    for i, (canonical, src) in enumerate(resolved.items()):
        n = F.col(f"_n_{i}") if src is not None else F.lit(0).cast("bigint")
        rows.append(F.struct(F.lit(canonical).alias("canonical"),
                             F.lit(src).cast("string").alias("source_column"),
                             n.alias("non_null_count")))
    return (counts.select(*group_cols, F.explode(F.array(*rows)).alias("m"))
            .select(*group_cols, "m.canonical", "m.source_column", "m.non_null_count")
            .withColumn("mapped", F.col("source_column").isNotNull() & (F.col("non_null_count") > 0)))
