"""Token ids as flat binary files.

``write`` sorts the documents by id, encodes them and leaves, for each Spark
partition, ``part-N.ids`` (the ids, little-endian unsigned integers of 16 or 32
bits, nothing else) and ``part-N.idx`` (little-endian signed 64-bit ids of the
documents, then unsigned 64-bit offsets, one more than documents, in ids of
this file).  A manifest table has a row for each partition with its counts;
the base of a partition is the sum of the counts before it.  Files written
locally are memory-mapped, others are read through their own file system.

A task writes under names of its own attempt and the manifest names what the
attempt that counted has written, so tasks can run again.
"""

from __future__ import annotations

import posixpath
import uuid
import zlib
from collections.abc import Iterator
from urllib.parse import urlsplit

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ledgerline.llm.common import narrow, row_hash, scratch_path, texts
from ledgerline.llm.tokens import encoder

#: The id that ends each document.
END = 2
MANIFEST = "part int, name string, bits int, n_docs long, n_ids long"


def _open(folder: str) -> tuple[fs.FileSystem, str]:
    if not urlsplit(folder).scheme:
        folder = "file://" + folder
    elif folder.startswith("file:/") and not folder.startswith("file:///"):
        folder = "file://" + folder[len("file:"):]
    return fs.FileSystem.from_uri(folder)


def _write_part(folder: str, path: str, end: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part = TaskContext.get().partitionId()
        name = f"part-{part:06d}-{uuid.uuid4().hex[:8]}"
        store, base = _open(folder)
        bits = 16 if encoder(path).library.get_vocab_size() <= 1 << 16 else 32
        ids, sizes, last = [], [], np.array([end], f"<u{bits // 8}").tobytes()
        with store.open_output_stream(posixpath.join(base, name + ".ids")) as out:
            for batch, values in texts(batches):
                ids.append(batch.column("doc_id").to_numpy(zero_copy_only=False).astype("<i8"))
                for found in encoder(path).encode(values):
                    data = np.frombuffer(found, "<u4").astype(f"<u{bits // 8}").tobytes() + last
                    sizes.append(len(data) * 8 // bits)
                    out.write(data)
        offsets = np.concatenate([[0], np.cumsum(sizes)]).astype("<u8") if sizes else np.zeros(1, "<u8")
        with store.open_output_stream(posixpath.join(base, name + ".idx")) as out:
            out.write(b"".join(x.tobytes() for x in ids) + offsets.tobytes())
        yield pa.RecordBatch.from_arrays(
            [pa.array([part], pa.int32()), pa.array([name]), pa.array([bits], pa.int32()),
             pa.array([len(sizes)], pa.int64()), pa.array([int(offsets[-1])], pa.int64())],
            names=["part", "name", "bits", "n_docs", "n_ids"])

    return run


def write(docs: DataFrame, path: str, folder: str | None = None, id_col: str = "doc_id", text_col: str = "text",
          end: int = END) -> str:
    """Write every row's ids, each followed by ``end``, in ascending id order; the folder, which all nodes share.

    A null text is empty, so only its end id is written.  A null id sorts, and
    is stored, as the smallest; rows that repeat an id follow each other in the
    order of their texts' hashes.  An empty table gives files without ids.
    """
    spark = docs.sparkSession
    folder = folder or scratch_path(spark, "tokens")
    store, base = _open(folder)
    store.create_dir(base, recursive=True)
    rows = narrow(docs, id_col, text_col, row_hash(text_col).alias("text_hash")).withColumn(
        "doc_id", F.coalesce("doc_id", F.lit(-(2 ** 63))))
    ordered = rows.repartitionByRange("doc_id", "text_hash").sortWithinPartitions("doc_id", "text_hash")
    ordered.mapInArrow(_write_part(folder, path, end), MANIFEST).write.parquet(posixpath.join(folder, "manifest"))
    return folder


def manifest(spark: SparkSession, folder: str) -> DataFrame:
    """The partitions that hold documents, with ``base``: the ids in all partitions before (a row per partition)."""
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    return (spark.read.parquet(posixpath.join(folder, "manifest")).where("n_docs > 0")
            .withColumn("base", F.coalesce(F.sum("n_ids").over(before), F.lit(0).cast("long"))))


def _load(store: fs.FileSystem, name: str) -> np.ndarray:
    """Bytes of a file, mapped where it is local."""
    if isinstance(store, fs.LocalFileSystem):
        return np.memmap(name, "u1", "r")
    with store.open_input_file(name) as f:
        return np.frombuffer(f.read_buffer(), "u1")


def documents_of(store: fs.FileSystem, base: str, name: str, bits: int, n: int) -> Iterator[tuple[int, int, np.ndarray]]:
    """(doc_id, offset, ids) of each document in one partition's files."""
    index = _load(store, posixpath.join(base, name + ".idx"))
    ids = _load(store, posixpath.join(base, name + ".ids")).view(f"<u{bits // 8}")
    doc_ids, offsets = index[:8 * n].view("<i8"), index[8 * n:].view("<u8")
    for i in range(n):
        a, b = int(offsets[i]), int(offsets[i + 1])
        yield int(doc_ids[i]), a, ids[a:b]


def summarise(spark: SparkSession, folder: str) -> DataFrame:
    """From the files: doc_id, start (ids of all documents before), n_tokens, ids_crc32 (of unsigned 32-bit ids)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, base = _open(folder)
        for batch in batches:
            for row in batch.to_pylist():
                out = [(d, row["base"] + a, len(ids), zlib.crc32(ids.astype("<u4").tobytes()))
                       for d, a, ids in documents_of(store, base, row["name"], row["bits"], row["n_docs"])]
                yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in zip(*out)],
                                                 names=["doc_id", "start", "n_tokens", "ids_crc32"])

    parts = manifest(spark, folder)
    return (parts.repartition(spark.sparkContext.defaultParallelism * 4, "part")
            .mapInArrow(run, "doc_id long, start long, n_tokens long, ids_crc32 long")
            .withColumn("doc_id", F.when(F.col("doc_id") != -(2 ** 63), F.col("doc_id"))))
