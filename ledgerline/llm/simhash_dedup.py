"""Near duplicates by SimHash, found through deletion variants of fingerprint segments.

A fingerprint has 64 bits, one for each place where more than half of the
text's shingle hashes have a one.  Fingerprints link at two or fewer differing
bits.  Cut into two segments, one segment of a linked pair differs by at most
one bit, so the two share a variant of that segment with one bit taken out:
each fingerprint is indexed under its 2 * 32 one-wildcard variants, equal
variants meet the candidates (two of them as the least and the greatest of their
variant, more in a join) and a bit count verifies them.

A variant that more than ``CROWD`` fingerprints share is not paired up.  Its
members are indexed once more, whole, under themselves and their 64 one-bit
changes: two fingerprints differ by at most two bits exactly where they share
such a change, and all that share one link to the least of them, so the links
grow with the members and none is lost.

Texts of one fingerprint are one node; components are those of the links.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import repeat

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerline.llm.common import materialize, narrow
from ledgerline.llm.near_dedup import components

#: Words in a shingle, and the seed of its hash.
SHINGLE = 3
SEED = 42
#: Bits of a segment: a half of the fingerprint.
SEGMENT = 32
#: Most bits that differ in a link.
DIFFER = 2
#: Fingerprints of a variant that are compared pair by pair; more go the other way.
CROWD = 16

_LOWER = bytes(range(65)) + bytes(range(97, 123)) + bytes(range(91, 256))


def fingerprint(text: bytes) -> int:
    """Bits that are set in over half of the shingles' hashes, as an unsigned integer; 0 for a text without words."""
    words = text.translate(_LOWER).split()  # at the ASCII white space
    n = max(len(words) - SHINGLE + 1, 1 if words else 0)
    ones = np.zeros(64, "u8")
    for a in range(0, n, 1 << 16):
        own = words[a:min(n, a + (1 << 16)) + SHINGLE - 1]
        runs = zip(*(own[i:] for i in range(min(SHINGLE, len(own)))))
        h = np.fromiter(map(xxhash.xxh64_intdigest, map(b" ".join, runs), repeat(SEED)), "<u8")
        bits = np.unpackbits(h.view("u1"), bitorder="little").reshape(-1, 64)
        for i in range(0, len(bits), 255):  # as many as a byte counts
            ones += bits[i:i + 255].sum(axis=0, dtype="u1")
    return int(np.packbits(2 * ones > n, bitorder="little").view("<u8")[0])


def _fingerprints(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for i in range(0, batch.num_rows, 512):
            part = batch.slice(i, 512)
            found = [fingerprint(t) for t in part.column("text").cast(pa.binary()).to_pylist()]
            yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array(np.array(found, "u8").view("i8"))],
                                             names=["doc_id", "fp"])


def _variants() -> Column:
    """A key for each segment and bit of it: their numbers, and the segment with that bit cleared."""
    def one(i: int) -> Column:
        segment, bit = divmod(i, SEGMENT)
        own = F.shiftrightunsigned(F.col("fp"), segment * SEGMENT).bitwiseAND(F.lit((1 << SEGMENT) - 1 - (1 << bit)))
        return F.lit(i << SEGMENT).bitwiseOR(own)

    return F.array(*(one(i) for i in range(64)))


def _changes() -> Column:
    """The fingerprint and all that differ from it by one bit."""
    flips = [np.uint64(1 << i).astype("i8").item() for i in range(64)]
    return F.array(F.col("fp"), *(F.col("fp").bitwiseXOR(F.lit(x)) for x in flips))


def _linked(a: str, b: str) -> Column:
    return F.bit_count(F.col(a).bitwiseXOR(F.col(b))) <= DIFFER


def links(nodes: DataFrame) -> DataFrame:
    """(a, b): links of the distinct fingerprints ``fp`` whose components are those of all links."""
    variants = nodes.select(F.explode(_variants()).alias("key"), "fp")
    shared = materialize(variants.groupBy("key").agg(
        F.count("*").alias("n"), F.max("fp").alias("a"), F.min("fp").alias("b")).where("n > 1"), "variants")
    twos = shared.where("n = 2").where(_linked("a", "b")).select("a", "b")
    met = materialize(variants.join(shared.where("n > 2").select("key", "n"), "key"), "met")
    few = met.where(F.col("n") <= CROWD)
    pairs = (few.select("key", F.col("fp").alias("a")).join(few.select("key", F.col("fp").alias("b")), "key")
             .where("a > b").where(_linked("a", "b")).select("a", "b"))
    crowded = met.where(F.col("n") > CROWD).select("fp").distinct()
    changes = materialize(crowded.select(F.explode(_changes()).alias("key"), "fp"), "changes")
    least = changes.groupBy("key").agg(F.min("fp").alias("b"), F.count("*").alias("n")).where("n > 1")
    near = (changes.join(least.select("key", "b"), "key").where("fp > b").where(_linked("fp", "b"))
            .select(F.col("fp").alias("a"), "b"))
    return twos.unionByName(pairs).unionByName(near).distinct()


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of ``docs``: doc_id, fp (the fingerprint's bits as a long), component_id.

    ``component_id`` is the least doc_id of the component.  A null text is
    empty; texts without words have fingerprint zero and link like others.
    Rows that repeat an id stand for themselves, null ids are never the least,
    and a component of null ids only has a null component_id.  An empty table
    gives no rows.
    """
    rows = narrow(docs, id_col, text_col)
    told = materialize(rows.mapInArrow(_fingerprints, "doc_id long, fp long"), "fingerprints")
    nodes = materialize(told.groupBy("fp").agg(F.min("doc_id").alias("first")), "nodes")
    roots = components(links(nodes.select("fp")))
    rooted = nodes.join(roots.withColumnRenamed("node", "fp"), "fp", "left").select(
        "fp", "first", F.coalesce("root", "fp").alias("root"))
    least = rooted.groupBy("root").agg(F.min("first").alias("component_id"))
    named = materialize(rooted.join(least, "root").select("fp", "component_id"), "named")
    return told.join(named, "fp").select("doc_id", "fp", "component_id")


def deduplicate(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` whose id is the least of their component (rows without one all stay)."""
    found = near_duplicates(docs, id_col, text_col)
    gone = found.where("doc_id <> component_id or (doc_id is null and component_id is not null)")
    return docs.join(gone.select(F.col("doc_id").alias("__gone")).distinct(),
                     F.col(id_col).cast("long").eqNullSafe(F.col("__gone")), "left_anti")


def hexadecimal(fp: Column) -> Column:
    """16 lowercase digits."""
    return F.lpad(F.lower(F.hex(fp)), 16, "0")
