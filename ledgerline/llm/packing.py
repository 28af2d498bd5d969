"""Packing documents into sequences as a cutting-stock problem.

A document's ids are cut into full sequences and a remainder.  The remainders'
lengths, rounded up to a grain, make a histogram; the least number of sequences
that holds it is a linear program over patterns (which lengths share a
sequence).  Its columns are generated: the duals price the lengths, a knapsack
dynamic program finds the pattern worth most, and it enters the basis until
none is worth more than a sequence.  The solution is rounded down, the few
remainders left are put together largest first, and the pieces of each length,
ranked over all partitions, take the patterns' places in order.

The driver sees the histogram (a count for each of 256 lengths) and the
patterns (at most a few for each length) and nothing that grows with the data.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ledgerline.llm.common import materialize, narrow, texts
from ledgerline.llm.tokens import encoder

LENGTH = 4096
#: The id that ends each document.
END = 2
#: Lengths are rounded up to this many ids in the linear program.
GRAIN = 16
#: The program ends within this share of its bound.
GAP = 1e-3

PIECE = ("part int, units int, place long, doc_id long, start long, length long, doc_tokens long, "
         "ids_crc32 long, ids binary")


def _cut(path: str, length: int, grain: int, end: int, keep_ids: bool, kept: int | None):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, last = TaskContext.get().partitionId(), np.array([end], "<u4").tobytes()
        places = np.zeros(length // grain + 1, "i8")  # pieces of each length so far
        for batch, values in texts(batches):
            rows = []
            for doc_id, data in zip(batch.column("doc_id").to_pylist(), encoder(path, kept).encode(values)):
                data += last
                n = len(data) // 4
                for a in range(0, n, length):
                    own = data[4 * a:4 * (a + length)]
                    units = -(-len(own) // (4 * grain))
                    rows.append((part, units, int(places[units]), doc_id, a, len(own) // 4, n, zlib.crc32(own),
                                 own if keep_ids else None))
                    places[units] += 1
            types = [pa.int32()] * 2 + [pa.int64()] * 6 + [pa.binary()]
            yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*rows), types)],
                                             names=[c.split()[0] for c in PIECE.split(", ")])

    return run


def pieces(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text", length: int = LENGTH,
           grain: int = GRAIN, end: int = END, keep_ids: bool = True, kept: int | None = None) -> DataFrame:
    """The documents cut at multiples of ``length``, as a written table: what ``assign`` takes.

    ``place`` numbers the pieces of one length in one partition.  A null or
    empty text is its end id alone; rows that repeat are cut each; an empty
    table has no pieces.  ``ids`` holds little-endian unsigned 32-bit ids, or null without
    ``keep_ids``.  ``grain`` must divide ``length``.  ``kept``: chunks whose ids a worker
    keeps (see ``tokens``); fewer take less memory and more time, for the same ids.
    """
    if length % grain:
        raise ValueError(f"{grain} does not divide {length}")
    return materialize(narrow(docs, id_col, text_col).mapInArrow(_cut(path, length, grain, end, keep_ids, kept), PIECE),
                       "pieces")


def knapsack(worth: np.ndarray, room: int) -> tuple[float, np.ndarray]:
    """The multiset of sizes 1, 2, ... that fits into ``room`` and is worth most; its worth and the number of each."""
    best, last = np.zeros(room + 1), np.zeros(room + 1, int)
    for c in range(1, room + 1):
        total = worth[:c] + best[c - 1::-1][:len(worth[:c])]
        i = int(total.argmax())
        best[c], last[c] = (total[i], i + 1) if total[i] > best[c - 1] else (best[c - 1], 0)
    found, c = np.zeros(len(worth), int), room
    while c > 0:
        if last[c]:
            found[last[c] - 1] += 1
        c -= last[c] or 1
    return best[room], found


def generate_columns(demand: np.ndarray, room: int, gap: float = GAP) -> tuple[np.ndarray, np.ndarray]:
    """Patterns (rows) and how often each is used, fractions included, for ``demand`` pieces of sizes 1, 2, ...

    Revised simplex from the patterns of one size each; Farley's bound ends it.
    """
    sizes = np.flatnonzero(demand) + 1
    m = len(sizes)
    fill = room // sizes
    basis, inverse = np.diag(fill).astype(float), np.diag(1.0 / fill)  # columns are patterns
    use = demand[sizes - 1] / fill
    worth = np.zeros(len(demand))
    for _ in range(50 * m):
        worth[sizes - 1] = inverse.sum(axis=0)
        value, full = knapsack(worth, room)
        if value <= 1 + 1e-9 or use.sum() * (1 - 1 / value) <= max(gap * use.sum(), 1e-6):
            break
        column = full[sizes - 1].astype(float)
        step = inverse @ column
        ratio = np.where(step > 1e-9, use / np.where(step > 1e-9, step, 1), np.inf)
        out = int(ratio.argmin())
        use = use - ratio[out] * step
        use[out] = ratio[out]
        use = np.maximum(use, 0)
        pivot = inverse[out] / step[out]
        inverse -= np.outer(step, pivot)
        inverse[out] = pivot
        basis[:, out] = column
    patterns = np.zeros((m, len(demand)), int)
    patterns[:, sizes - 1] = basis.T.round().astype(int)
    return patterns, use


def plan_patterns(demand: np.ndarray, room: int) -> list[tuple[np.ndarray, int]]:
    """Patterns and how often each is used so that each piece of ``demand`` has a place."""
    demand = demand.astype(int)
    if not demand.any():
        return []
    patterns, use = generate_columns(demand, room)
    out, left = [], demand.copy()
    for p, x in sorted(zip(patterns.tolist(), use), key=lambda q: -q[1]):
        p = np.array(p)
        n = min(int(x + 1e-6), *(left[p > 0] // p[p > 0]))
        if n > 0:
            out.append((p, n))
            left -= n * p
    while left.any():  # a few for each pattern: largest first, what is used often at once
        p, c = np.zeros(len(demand), int), room
        for s in np.flatnonzero(left)[::-1] + 1:
            p[s - 1] = min(left[s - 1], c // s)
            c -= p[s - 1] * s
        n = int((left[p > 0] // p[p > 0]).min())
        out.append((p, n))
        left -= n * p
    return out


def assign(cut: DataFrame, length: int = LENGTH, grain: int = GRAIN) -> DataFrame:
    """``pieces`` with their sequence and place in it: doc_id, start, length, ids_crc32, doc_tokens, ids, sequence_id, offset.

    Each sequence holds at most ``length`` ids without gaps from 0; what is
    left at its end is padding.
    """
    spark, room = cut.sparkSession, length // grain
    counts = materialize(cut.groupBy("part", "units").count(), "lengths")
    demand = np.zeros(room, int)
    for r in counts.groupBy("units").agg(F.sum("count").alias("n")).collect():  # at most ``room`` rows
        demand[r.units - 1] = r.n
    layout, taken, base = [], np.zeros(room, int), 0
    for p, n in plan_patterns(demand, room):
        for s in np.flatnonzero(p):
            layout.append((int(s) + 1, int(taken[s]), int(p[s]) * n, int(p[s]), base))
            taken[s] += p[s] * n
        base += n
    # a row for each size in a pattern: bounded by the sizes, not by the data
    layout = spark.createDataFrame(layout, "units int, first long, many long, each long, base long")

    before = Window.partitionBy("units").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    bases = counts.select("part", "units", F.coalesce(F.sum("count").over(before), F.lit(0).cast("long")).alias("before"))
    ranked = cut.join(bases, ["part", "units"]).withColumn("rank", F.col("before") + F.col("place")).drop("before")
    own = F.broadcast(layout.withColumnRenamed("units", "size"))
    placed = ranked.join(own, (F.col("units") == F.col("size")) & (F.col("rank") >= F.col("first"))
                         & (F.col("rank") < F.col("first") + F.col("many")))
    placed = placed.withColumn("sequence_id", (F.col("base") + F.expr("(rank - first) div each")).cast("long"))
    order = Window.partitionBy("sequence_id").orderBy(F.desc("units"), "rank")  # at most ``length`` rows
    start = F.sum("length").over(order.rowsBetween(Window.unboundedPreceding, -1))
    return placed.select("doc_id", "start", "length", "ids_crc32", "doc_tokens", "ids", "sequence_id",
                         F.coalesce(start, F.lit(0).cast("long")).alias("offset"))


def sequences(packed: DataFrame) -> DataFrame:
    """sequence_id and its ids (little-endian unsigned 32-bit), pieces joined in order; needs pieces with their ids."""
    own = F.array_sort(F.collect_list(F.struct("offset", "ids")))
    return packed.groupBy("sequence_id").agg(own.alias("own")).select(
        "sequence_id", F.aggregate("own", F.lit(b""), lambda a, x: F.concat(a, x["ids"])).alias("ids"))
