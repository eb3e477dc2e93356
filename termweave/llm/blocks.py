"""Blocks of whole documents, and the buckets in which blocks ask about keys.

A block holds the documents of one task and some megabytes; it is written once below the shared folder
and is the unit that asks questions about the whole corpus: per bucket of keys it sends one row with its
own distinct keys, and gets one row back. A frequent key costs one entry for each block, however often
it occurs in it, and never meets all its occurrences in one task.
"""

from __future__ import annotations

import ctypes
import os
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from termweave.llm import textbytes as tb
from termweave.runtime import staging_path

#: Bytes of text in a block; only a single longer document goes beyond.
BLOCK_BYTES = 10 << 20

_COLUMNS = "block long, ids array<long>, offsets binary, packed binary, n_bytes long"


def import_in_tasks(spark: SparkSession) -> None:
    """Let Python workers import this library from where the driver has it.

    Where the executors do not see that folder, the library has to be installed or sent with --py-files.
    """
    environment = spark.sparkContext.environment
    root = os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
    known = [p for p in environment.get("PYTHONPATH", "").split(os.pathsep) if p]
    if root not in known:
        environment["PYTHONPATH"] = os.pathsep.join([root, *known])


def released(result=None):
    """Gives back to the system what Arrow and the C library hold unused, then returns the result.

    A worker lives on between tasks, beside the executor's heap.
    """
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # not in every C library
    if trim:
        trim(0)
    return result


def map_batches(df: DataFrame, function: Callable, schema: str) -> DataFrame:
    """``mapInArrow`` with this library at hand in the workers, and a release at the end of each task."""
    import_in_tasks(df.sparkSession)

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from function(batches)
        released()

    return df.mapInArrow(task, schema)


def renamed(docs: DataFrame) -> tuple[DataFrame, dict[str, str]]:
    """The table with neutral column names, and the name of each original column there."""
    names = {c: f"c{k}" for k, c in enumerate(docs.columns)}
    return docs.select(*[F.col(f"`{c}`").alias(n) for c, n in names.items()]), names


def restored(docs: DataFrame, names: dict[str, str]) -> DataFrame:
    return docs.select(*[F.col(n).alias(c) for c, n in names.items()])


def stored(df: DataFrame, name: str) -> DataFrame:
    """Write below the shared folder and read again: cuts the lineage, survives lost executors."""
    path = staging_path(df.sparkSession, name)
    df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.parquet(path)


def _pack(seq: int, ids: list, parts: list[bytes], sizes: list[np.ndarray], carried: list[pa.StructArray]) -> pa.RecordBatch:
    offsets = np.concatenate([[0], np.cumsum(np.concatenate(sizes))]).astype(np.int64)
    raw = b"".join(parts)
    packed = bytes(pa.compress(raw, codec="zstd", asbytes=True)) if raw else b""
    context = TaskContext.get()
    number = ((context.partitionId() if context else 0) << 24) | seq
    arrays = [pa.array([number], pa.int64()), pa.array([ids], pa.list_(pa.int64())), pa.array([offsets.tobytes()], pa.binary()), pa.array([packed], pa.binary()), pa.array([len(raw)], pa.int64())]
    names = ["block", "ids", "offsets", "packed", "n_bytes"]
    if carried:
        arrays.append(pa.ListArray.from_arrays(pa.array([0, len(ids)], pa.int32()), pa.concat_arrays(carried)))
        names.append("carried")
    return pa.RecordBatch.from_arrays(arrays, names=names)


def _to_blocks(batches: Iterator[pa.RecordBatch], size: int) -> Iterator[pa.RecordBatch]:
    seq, have, ids, parts, sizes, carried = 0, 0, [], [], [], []
    for batch in batches:
        extra = pa.StructArray.from_arrays(batch.columns[2:], batch.schema.names[2:]) if batch.num_columns > 2 else None
        data, offsets = tb.columns(batch.column(1))
        keys = batch.column(0).to_pylist()
        for i, j in tb.pieces(offsets, size):
            if have and have + offsets[j] - offsets[i] > size:
                yield _pack(seq, ids, parts, sizes, carried)
                seq, have, ids, parts, sizes, carried = seq + 1, 0, [], [], [], []
            ids += keys[i:j]
            parts.append(data[offsets[i] : offsets[j]].tobytes())
            sizes.append(np.diff(offsets[i : j + 1]))
            have += int(offsets[j] - offsets[i])
            if extra is not None:
                carried.append(extra.slice(i, j - i))
    if ids:
        yield _pack(seq, ids, parts, sizes, carried)


def blocks(documents: DataFrame, key: str = "doc_id", text: str = "text", carry: tuple[str, ...] = (), size: int = BLOCK_BYTES) -> DataFrame:
    """Documents as stored blocks (a null text is empty); every row of the input is in exactly one block.

    ``carry`` names columns that travel with the rows, as ``carried``.
    """
    rows = documents.select(F.col(key).cast("long").alias("_key"), F.col(text).cast("string").alias("_text"), *[F.col(c) for c in carry])
    fields = ", ".join(f"`{f.name}`: {f.dataType.simpleString()}" for f in rows.schema.fields[2:])
    schema = _COLUMNS + (f", carried array<struct<{fields}>>" if carry else "")
    return stored(map_batches(rows, lambda batches: _to_blocks(batches, size), schema), "blocks")


def opened(row: dict) -> tuple[list, np.ndarray, np.ndarray]:
    """Ids, bytes and offsets of a block."""
    offsets = np.frombuffer(row["offsets"], np.int64)
    raw = pa.decompress(row["packed"], decompressed_size=row["n_bytes"], codec="zstd", asbytes=True) if row["n_bytes"] else b""
    return row["ids"], np.frombuffer(raw, np.uint8), offsets


def each(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
    """Rows one at a time, so that a batch of blocks is not taken apart as a whole."""
    for batch in batches:
        for i in range(batch.num_rows):
            yield batch.slice(i, 1).to_pylist()[0]


def bucket_count(spark: SparkSession, table: DataFrame, of: str, each_bytes: int) -> int:
    """Enough buckets that each holds about ``each_bytes`` of what ``of`` sums up to."""
    total = table.agg(F.coalesce(F.sum(of), F.lit(0))).first()[0]
    return int(max(total // each_bytes + 1, int(spark.conf.get("spark.sql.shuffle.partitions"))))


def split_by_bucket(bucket: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """A stable order that groups by bucket, and the n + 1 borders in it."""
    order = np.argsort(bucket, kind="stable")
    return order, np.searchsorted(bucket[order], np.arange(n + 1))
