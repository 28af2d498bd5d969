"""Row positions (1-based) without a single-task window.

A ``row_number()`` over an unpartitioned (or hot-key) window sorts every row
in one task.  Instead the rows are globally sorted by Spark itself (range
partitioning + sort within partitions, so every task holds one key range)
and written as a table in the shared checkpoint folder.  In that table a
row's place is (part number of its file, Parquet row index), both fixed on
disk: the row counts per (file, group) -- at most ``files + groups`` rows --
are prefix-summed per group and added back.  Every task is bounded by the
range size whatever the group skew, and a task re-run after an executor
loss reads the same files.
"""

from __future__ import annotations

import re
from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..session import materialize, scratch_path


#: Bytes of (compressed) files in a key range: in memory, where a task sorts them, rows take several times as much.
RANGE_BYTES = 8 * 1024 * 1024
#: Fewer ranges than the session has cores only where each would hold less than this.
LEAST_BYTES = 512 * 1024


_DERIVED = re.compile(r"\b(Join|Aggregate|Generate|Window|Expand|Union)\b")


def stored(df: DataFrame) -> DataFrame:
    """``df``, written first unless it is a plain scan: an estimate of more than a scan may be far off."""
    return materialize(df, "unsorted") if _DERIVED.search(df._jdf.queryExecution().optimizedPlan().toString()) else df


def range_count(scan: DataFrame) -> int:
    """Key ranges sized by the data: one per ~8 MiB of the files that ``scan`` reads, and one for each core if they are worth it."""
    size = int(str(scan._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    cores = scan.sparkSession.sparkContext.defaultParallelism
    return max(size // RANGE_BYTES + 1, min(cores, size // LEAST_BYTES + 1))


def with_row_positions(df: DataFrame, order_cols: Sequence[str], group_cols: Sequence[str] = (),
                       out: str = "row_num", buckets: int | None = None, keep_order: bool = True) -> DataFrame:
    """Add ``out`` = position of the row inside its group, ordered by ``order_cols``.

    The order must be total, or ties must be rows that are otherwise
    identical.  ``buckets``: number of key ranges (default: ``range_count`` of
    the input, which is written first unless it is a plain scan).  Without
    ``keep_order`` the columns ``order_cols`` end with the sort.
    """
    spark = df.sparkSession
    if not buckets:
        df = stored(df)
        buckets = range_count(df)
    keys = [*group_cols, *order_cols]
    path = scratch_path(spark, "sorted")
    in_order = df.repartitionByRange(buckets, *keys).sortWithinPartitions(*keys)
    if not keep_order:
        in_order = in_order.drop(*order_cols)
    in_order.write.mode("overwrite").parquet(path)
    name = F.col("_metadata.file_name")
    tagged = spark.read.schema(in_order.schema).parquet(path).select(
        "*",
        F.regexp_extract(name, r"^part-(\d+)", 1).cast("long").alias("_lp_part"),
        F.regexp_extract(name, r"-c(\d+)\.", 1).cast("long").alias("_lp_chunk"),
        F.col("_metadata.row_index").alias("_lp_ri"),
    )
    counts = tagged.groupBy("_lp_part", "_lp_chunk", *group_cols).agg(
        F.count(F.lit(1)).alias("_lp_n"), F.min("_lp_ri").alias("_lp_first"))
    w = (Window.partitionBy(*group_cols) if group_cols else Window.partitionBy()).orderBy("_lp_part", "_lp_chunk")
    offsets = counts.select(
        F.col("_lp_part").alias("_lp_opart"), F.col("_lp_chunk").alias("_lp_ochunk"),
        *[F.col(g).alias(f"_lp_g{i}") for i, g in enumerate(group_cols)],
        F.coalesce(F.sum("_lp_n").over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("_lp_before"),
        "_lp_first",
    )
    cond = [F.col("_lp_part") == F.col("_lp_opart"), F.col("_lp_chunk") == F.col("_lp_ochunk")] + [
        F.col(g).eqNullSafe(F.col(f"_lp_g{i}")) for i, g in enumerate(group_cols)]
    # read back, so its true size (a row for each file and group) is known when the join is planned
    joined = tagged.join(materialize(offsets, "offsets"), cond, "inner")
    return (joined.withColumn(out, (F.col("_lp_before") + F.col("_lp_ri") - F.col("_lp_first") + 1).cast("bigint"))
            .drop("_lp_part", "_lp_chunk", "_lp_ri", "_lp_opart", "_lp_ochunk", "_lp_before", "_lp_first",
                  *[f"_lp_g{i}" for i in range(len(group_cols))]))


def smallest_k(df: DataFrame, group_cols: Sequence[str], order_col: str, k: int,
               salt_buckets: int = 64) -> DataFrame:
    """The ``k`` rows with the smallest ``order_col`` per group, exactly.

    Stage 1 keeps the k smallest per (group, salt) so a hot group is split over
    ``salt_buckets`` tasks; stage 2 ranks the <= k*salt_buckets survivors.
    """
    salted = df.withColumn("_sk_salt", F.pmod(F.xxhash64(F.col(order_col)), F.lit(salt_buckets)))
    w1 = Window.partitionBy(*group_cols, "_sk_salt").orderBy(order_col)
    stage1 = salted.withColumn("_sk_rn", F.row_number().over(w1)).where(F.col("_sk_rn") <= k)
    w2 = Window.partitionBy(*group_cols).orderBy(order_col)
    return (stage1.drop("_sk_rn", "_sk_salt")
            .withColumn("_sk_rn", F.row_number().over(w2))
            .where(F.col("_sk_rn") <= k).drop("_sk_rn"))
