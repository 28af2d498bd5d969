"""Removes every byte that a repeated 200-byte string covers, over all documents.

The method dealt, external induced sorting of all suffixes, does not fit the
limits (README, "Suffix-array dedup").  What is kept of it is the recursion
over sample positions that the text itself chooses, from which the verdicts on
the other positions are induced; what takes the place of the queues is Spark's
external shuffle of the tuples.

1. Every 200-byte string names the least of its 64-byte grams; equal strings
   name the same one.  The starts that name one gram are an interval.  A gram
   that stands in one place only settles its starts: not repeated.
2. Equal intervals (their bytes and extent) settle their starts: repeated.  Of
   each such group one member goes on, as a source for the others.
3. What is left is cut into blocks of 16 starts, a block's strings share a core of
   185 bytes.  Cores that stand once, and equal blocks, settle their starts.
4. A string of what is left is its core's name with a few bytes on the left and
   on the right; those tuples are counted.

Each step is a count by key that adds up before its shuffle, and no key's rows
are gathered.  Grams, intervals, cores and tuples are named by hashes (64 bits
for a gram, which only proposes; 128 for what settles).
"""

from __future__ import annotations

import functools
import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerline.llm.common import materialize, narrow, row_hash, texts

LENGTH = 200
GRAM = 64
BLOCK = 16
#: Starts that are hashed at a time; longer texts go in such parts.
PART = 1 << 18
#: Keys of documents are broadcast up to this many (16 bytes each), beyond that shuffled.
BROADCAST_KEYS = 500_000

_CORE = LENGTH - BLOCK + 1
_ODD = 0x9E3779B97F4A7C15 | 1
_ANCHORED = ("doc_id long, text_hash long, n_bytes long, sha string, kh array<long>, uh array<long>, at array<int>, "
             "far array<short>, near array<short>")


@functools.cache
def _tables() -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """A random number for each byte; powers of an odd number mod 2**64 and of its inverse."""
    value = np.array([xxhash.xxh3_64_intdigest(bytes([i])) for i in range(256)], "u8")
    powers = []
    for x in (_ODD, pow(_ODD, -1, 1 << 64)):
        p = np.full(PART + LENGTH + 1, x, "u8")
        p[0] = 1
        powers.append(np.multiply.accumulate(p))
    return value, *powers


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    return x ^ (x >> np.uint64(32))


def anchors(data: bytes) -> tuple[np.ndarray, ...]:
    """The intervals of a text: hash of the gram and of the interval's bytes, the gram's place, distance of the
    first and of the last start from it."""
    value, power, inverse = _tables()
    out = []
    whole = np.frombuffer(data, "u1")
    for c in range(0, len(data) - LENGTH + 1, PART):
        b = whole[c:c + PART + LENGTH - 1]
        n = len(b)
        total = np.concatenate([np.zeros(1, "u8"), np.cumsum(value[b] * power[:n])])
        grams = _mix((total[GRAM:] - total[:-GRAM]) * inverse[:n - GRAM + 1])
        # the place in the low bits: of equal grams the first counts
        least = (grams & ~np.uint64((1 << 20) - 1)) | np.arange(len(grams), dtype="u8")
        size, reach = 1, LENGTH - GRAM + 1
        while 2 * size <= reach:
            least = np.minimum(least[:-size], least[size:])
            size *= 2
        if size < reach:
            least = np.minimum(least[:len(least) - reach + size], least[reach - size:])
        at = (least & np.uint64((1 << 20) - 1)).astype("i8")
        first = np.flatnonzero(np.concatenate([[True], at[1:] != at[:-1]]))
        last = np.concatenate([first[1:], [len(at)]]) - 1
        at = at[first]
        body = (total[last + LENGTH] - total[first]) * inverse[first]
        extent = ((at - first) * 256 + at - last).astype("u8")
        out.append((grams[at], _mix(body ^ _mix(extent + np.uint64(1))), at + c, at - first, at - last))
    if not out:
        return tuple(np.zeros(0, kind) for kind in ("u8", "u8", "i8", "i8", "i8"))
    return tuple(np.concatenate(x) for x in zip(*out))


def _anchored(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    names = [c.split()[0] for c in _ANCHORED.split(", ")]
    kinds = [pa.int64(), pa.int64(), pa.int32(), pa.int16(), pa.int16()]
    for part, values in texts(batches, 256):
        data = [t.encode() for t in values]
        found = list(zip(*(anchors(d) for d in data)))
        sizes = np.concatenate([[0], np.cumsum([len(x) for x in found[0]])]).astype("i4")
        lists = [pa.ListArray.from_arrays(pa.array(sizes), pa.array(np.concatenate(x).astype(k.to_pandas_dtype()), k))
                 for x, k in zip(found, kinds)]
        yield pa.RecordBatch.from_arrays(
            [part.column("doc_id"), part.column("text_hash"), pa.array([len(d) for d in data], pa.int64()),
             pa.array([hashlib.sha256(d).hexdigest() for d in data]), *lists], names=names)


def blocks(data: bytes, at: int, far: int, near: int) -> Iterator[tuple]:
    """Blocks of an interval: core's place, first and last start's distance before it, core's name, bytes beside it."""
    for j in range(near // BLOCK, far // BLOCK + 1):
        place = at - BLOCK * j
        least, most = max(near - BLOCK * j, 0), min(far - BLOCK * j, BLOCK - 1)
        core = data[place:place + _CORE]
        yield (place, least, most, xxhash.xxh3_128_digest(core), data[place - most:place],
               data[place + _CORE:place + _CORE + BLOCK - 1 - least])


def _blocked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    kinds = [pa.int64(), pa.bool_(), pa.int32(), pa.int16(), pa.int16(), pa.binary(), pa.binary(), pa.binary()]
    for part, values in texts(batches, 32):
        rows = []
        for rid, own, t in zip(part.column("rid").to_pylist(), part.column("own").to_pylist(), values):
            data = t.encode()
            rows += [(rid, x["open"], *b) for x in own for b in blocks(data, x["at"], x["far"], x["near"])]
        if rows:
            yield pa.RecordBatch.from_arrays([pa.array(x, k) for x, k in zip(zip(*rows), kinds)],
                                             names=["rid", "open", "place", "least", "most", "core", "l", "r"])


def uncovered(data: bytes, starts: list[tuple[int, int]]) -> tuple[int, int, bytes]:
    """Bytes removed, runs of them, and what stays, when the strings from ``starts`` (first, last) are covered."""
    out, end, runs, kept = 0, 0, 0, []
    for a, b in sorted(starts):
        if a > end or not runs:
            kept.append(data[end:a])
            runs += 1
            end = a
        if b + LENGTH > end:
            out += b + LENGTH - end
            end = b + LENGTH
    kept.append(data[end:])
    return out, runs, b"".join(kept)


def _removed(keep_text: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, values in texts(batches, 64):
            rows = []
            for rid, own, t in zip(part.column("rid").to_pylist(), part.column("own").to_pylist(), values):
                n, runs, kept = uncovered(t.encode(), [(x["first"], x["last"]) for x in own])
                rows.append((rid, n, runs, hashlib.sha256(kept).hexdigest(), kept if keep_text else None))
            kinds = [pa.int64()] * 3 + [pa.string(), pa.binary()]
            yield pa.RecordBatch.from_arrays([pa.array(x, k) for x, k in zip(zip(*rows), kinds)],
                                             names=["rid", "n_removed", "n_spans", "kept_sha", "kept"])

    return run


def remove_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", keep_text: bool = True) -> DataFrame:
    """One row per row of ``docs``: doc_id, n_bytes, n_removed, n_spans, kept_sha256, kept.

    ``kept`` holds the bytes that stay, of the documents that lose some (a cut
    may fall within a character), and null for the others or without
    ``keep_text``.  A null text is empty.  Texts under 200 bytes lose nothing;
    copies, and rows that repeat, lose all from 200 bytes on.  An empty table
    gives no rows; further columns are ignored.
    """
    rows = narrow(docs, id_col, text_col, row_hash(text_col).alias("text_hash"))
    rows = rows.withColumn("doc_id", F.coalesce("doc_id", F.lit(-(2 ** 63))))
    table = materialize(rows.mapInArrow(_anchored, _ANCHORED).withColumn("rid", F.monotonically_increasing_id()),
                        "anchors")

    # 1. grams in more than one place
    every = table.select("rid", F.explode(F.arrays_zip("kh", "uh", "at", "far", "near")).alias("x")).select("rid", "x.*")
    # written, so that both sides of the join are plain exchanges and a skewed one can be split
    often = materialize(every.groupBy("kh").count().where("count > 1").select("kh"), "often")
    shared = materialize(every.join(often, "kh"), "shared")
    # 2. equal intervals
    groups = materialize(shared.groupBy("kh", "uh").agg(
        F.count("*").alias("n"), F.min(F.struct("rid", "at", "far", "near")).alias("one")), "intervals")
    settled = shared.join(groups.where("n > 1").select("kh", "uh"), ["kh", "uh"], "left_semi").select(
        "rid", (F.col("at") - F.col("far")).alias("first"), (F.col("at") - F.col("near")).alias("last"))

    keys = table.join(shared.select("rid").distinct(), "rid", "left_semi").select("rid", "doc_id", "text_hash")
    keys = materialize(keys, "keys")
    if keys.count() <= BROADCAST_KEYS:
        keys = F.broadcast(keys)
    touched = materialize(rows.join(keys, ["doc_id", "text_hash"]).select("rid", "text").dropDuplicates(["rid"]), "touched")

    # 3. blocks of what differs under one gram
    several = materialize(groups.groupBy("kh").count().where("count > 1").select("kh"), "several")
    differ = groups.join(several, "kh", "left_semi").select("one.*", (F.col("n") == 1).alias("open"))
    own = differ.groupBy("rid").agg(F.collect_list(F.struct("at", "far", "near", "open")).alias("own"))
    cut = materialize(touched.join(own, "rid").mapInArrow(
        _blocked, "rid long, open boolean, place int, least short, most short, core binary, l binary, r binary"), "blocks")
    same = ["core", "l", "r", "least", "most"]
    units = materialize(cut.groupBy(*same).agg(
        F.count("*").alias("n"), F.min(F.struct("rid", "place", "open")).alias("one")), "units")
    whole = cut.where("open").join(units.where("n > 1").select(*same), same, "left_semi").select(
        "rid", (F.col("place") - F.col("most")).alias("first"), (F.col("place") - F.col("least")).alias("last"))

    # 4. strings of what differs beside one core
    several = materialize(units.groupBy("core").count().where("count > 1").select("core"), "cores")
    strings = (units.join(several, "core", "left_semi")
               .select("core", "l", "r", F.col("one.rid").alias("rid"), F.col("one.place").alias("place"),
                       (F.col("one.open") & (F.col("n") == 1)).alias("open"),
                       F.explode(F.sequence(F.col("least").cast("int"), F.col("most").cast("int"))).alias("t"))
               .withColumn("l", F.expr("substring(l, length(l) - t + 1, t)"))
               .withColumn("r", F.expr(f"substring(r, 1, {BLOCK - 1} - t)"))
               .select(F.xxhash64("core", "t", "l", "r").alias("k"), F.xxhash64("r", "l", "t", "core").alias("h"),
                       "t", "rid", "place", "open"))
    strings = materialize(strings, "strings")
    again = strings.groupBy("k", "h").count().where("count > 1").select("k", "h")
    single = (strings.where("open").join(again, ["k", "h"], "left_semi")
              .select("rid", (F.col("place") - F.col("t")).alias("first"), (F.col("place") - F.col("t")).alias("last")))

    starts = settled.unionByName(whole).unionByName(single).groupBy("rid").agg(
        F.collect_list(F.struct("first", "last")).alias("own"))  # bounded by a document's length
    lost = touched.join(starts, "rid").mapInArrow(
        _removed(keep_text), "rid long, n_removed long, n_spans long, kept_sha string, kept binary")
    none = F.lit(0).cast("long")
    return table.select("rid", "doc_id", "n_bytes", "sha").join(lost, "rid", "left").select(
        F.when(F.col("doc_id") != -(2 ** 63), F.col("doc_id")).alias("doc_id"), "n_bytes",
        F.coalesce("n_removed", none).alias("n_removed"), F.coalesce("n_spans", none).alias("n_spans"),
        F.coalesce("kept_sha", "sha").alias("kept_sha256"), "kept")
