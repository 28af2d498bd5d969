"""Incremental aggregates: rollups of the fact's segments, kept by the store's commits.

A segment never changes once it is committed, so its rollup is computed once.
``refresh`` sums the segments that no rollup covers, writes them into a folder
of its own and commits which segments the folder stands for.  ``cells`` and
``client_months`` read the rollups and add what is not covered yet from the
fact, at one commit: they are exact at any time, refreshed or not.  A new
initial load drops the rollups with the segments.

Many small rollups are summed into one, so a reader opens few folders.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession

from ..operators import rollups as ops
from ..sources import tables
from .jobs import MAX_TRIES

#: Rollups that are read side by side; one more and a refresh sums them into one.
MERGE_OVER = 16


@dataclass(frozen=True)
class Kind:
    """A rollup table: how a segment's rows are summed, and how its rollups are."""

    name: str
    schema: str
    of_fact: Callable[[DataFrame], DataFrame]
    merged: Callable[[DataFrame], DataFrame]
    order: tuple[str, ...]


CELLS = Kind("rollup_cells", ops.CELL_SCHEMA, ops.by_cell, ops.merged_cells, ops.CELL_KEYS)
CLIENT_MONTHS = Kind("rollup_client_months", ops.CLIENT_SCHEMA, ops.by_client_month, ops.merged_clients, ("client_id", "date"))
KINDS = (CELLS, CLIENT_MONTHS)


def standing(at: tables.Commit) -> dict[str, list[str]]:
    """The commit's rollups, each with the segments it stands for; without those of segments that are gone."""
    facts = set(at.facts)
    return {run: segments for run, segments in at.rollups.items() if facts.issuperset(segments)}


def uncovered(at: tables.Commit) -> list[str]:
    """The fact's segments that no rollup stands for."""
    covered = {s for segments in standing(at).values() for s in segments}
    return [s for s in at.facts if s not in covered]


def _stored(spark: SparkSession, root: str, kind: Kind, runs: list[str]) -> DataFrame:
    base = tables.table_path(root, kind.name)
    return spark.read.schema(kind.schema).parquet(*[f"{base}/run={r}" for r in runs])


def _rows(spark: SparkSession, root: str, kind: Kind, runs: list[str], segments: list[str]) -> DataFrame:
    """The rollups ``runs`` and the sums of the fact's ``segments``, not summed up with each other."""
    parts = [_stored(spark, root, kind, runs)] if runs else []
    if segments:
        parts.append(kind.of_fact(tables.segments(spark, root, tables.SEGMENTED, segments)))
    if not parts:
        return spark.createDataFrame([], kind.schema)
    return parts[0] if len(parts) == 1 else parts[0].unionByName(parts[1])


def refresh(spark: SparkSession, root: str, merge_over: int = MERGE_OVER) -> tables.Commit:
    """Cover every segment of the newest commit; only segments without a rollup are read.

    Where more than ``merge_over`` rollups would stand, they are summed into one
    (from the rollups, not the fact).  Commits that come between leave the written
    folder valid unless they covered or removed one of its segments."""
    for _ in range(MAX_TRIES):
        base = tables.head(spark, root)
        if base is None:
            raise ValueError(f"{root} holds no star schema: load it first")
        todo, old = uncovered(base), standing(base)
        merge = list(old) if len(old) + bool(todo) > merge_over else []
        if not todo and not merge:
            return base
        run = tables.new_run()
        for kind in KINDS:
            rows = _rows(spark, root, kind, merge, todo)
            rows = kind.merged(rows) if merge else rows
            rows.sortWithinPartitions(*kind.order).write.parquet(f"{tables.table_path(root, kind.name)}/run={run}")
        segments = [s for r in merge for s in old[r]] + todo
        for _ in range(MAX_TRIES):
            try:
                kept = {r: s for r, s in standing(base).items() if r not in merge}
                return tables.commit(spark, root, base, rollups={**kept, run: segments})
            except tables.CommitConflict:
                base = tables.head(spark, root)
                fresh, now = set(uncovered(base)), standing(base)
                if not (fresh.issuperset(todo) and all(now.get(r) == old[r] for r in merge)):
                    break  # another refresh or a load: what was written does not fit any more
    raise RuntimeError(f"{MAX_TRIES} commits of other writers came first")


def _read(spark: SparkSession, root: str, kind: Kind, at: tables.Commit | None) -> DataFrame:
    at = at or tables.head(spark, root) or tables.Commit()
    return _rows(spark, root, kind, list(standing(at)), uncovered(at))


def cells(spark: SparkSession, root: str, at: tables.Commit | None = None) -> DataFrame:
    """The fact at a commit (default: the newest) by month and ids; a cell may come once for each rollup."""
    return _read(spark, root, CELLS, at)


def client_months(spark: SparkSession, root: str, at: tables.Commit | None = None) -> DataFrame:
    """The revenue that counts for cohorts at a commit, by client and month; a pair may come once for each rollup."""
    return _read(spark, root, CLIENT_MONTHS, at)
