"""Session set-up, durable materialisation and distributed row numbering."""

from __future__ import annotations

import os
import uuid
from collections.abc import Sequence

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

# monotonically_increasing_id keeps the partition above bit 33 and the row within it below.
_ROW_BITS = 33


def build_session(app: str = "termweave", master: str | None = None, **conf: str) -> SparkSession:
    """A session with the settings the operators count on (adaptive plans, skew splitting, UTC)."""
    builder = (
        SparkSession.builder.appName(app)
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.adaptive.coalescePartitions.enabled", "true")
        .config("spark.cleaner.referenceTracking.cleanCheckpoints", "true")
    )
    if master:
        builder = builder.master(master)
    for key, value in conf.items():
        builder = builder.config(key.replace("__", "."), value)
    return builder.getOrCreate()


def shared_root(spark: SparkSession) -> str:
    """The folder for checkpoints and staged tables.

    The cluster names it in ``spark.checkpoint.dir``. Only a local session falls back to a
    folder in its warehouse: on a cluster that might be a local one, which executors cannot share.
    """
    configured = spark.conf.get("spark.checkpoint.dir", None)
    context = spark.sparkContext
    if configured:
        if context.getCheckpointDir() is None:
            context.setCheckpointDir(configured)
        return configured
    current = context.getCheckpointDir()
    if current:
        return current
    if not context.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
    context.setCheckpointDir(f"{spark.conf.get('spark.sql.warehouse.dir')}/termweave-checkpoints")
    return context.getCheckpointDir()


def import_in_tasks(spark: SparkSession) -> None:
    """Let Python workers import this library from where the driver has it.

    Where the executors do not see that folder, the library has to be installed or sent with --py-files.
    """
    environment = spark.sparkContext.environment
    root = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    known = [p for p in environment.get("PYTHONPATH", "").split(os.pathsep) if p]
    if root not in known:
        environment["PYTHONPATH"] = os.pathsep.join([root, *known])


def staging_path(spark: SparkSession, name: str) -> str:
    """A fresh path below the shared folder."""
    return f"{shared_root(spark)}/staging/{name}-{uuid.uuid4().hex}"


def materialise(df: DataFrame) -> DataFrame:
    """Compute once and cut the lineage; the copy survives the loss of executors."""
    shared_root(df.sparkSession)
    return df.checkpoint(eager=True)


def small_table(spark: SparkSession, rows: Sequence[tuple], schema: T.StructType | str) -> DataFrame:
    """A handful of fixed rows as a local relation: no job, known size, pruned when empty."""
    struct = T.StructType.fromDDL(schema) if isinstance(schema, str) else schema
    columns = list(zip(*rows)) if rows else [()] * len(struct)
    fields = to_arrow_schema(struct)
    arrays = [pa.array(values, field.type) for values, field in zip(columns, fields)]
    return spark.createDataFrame(pa.Table.from_arrays(arrays, schema=fields), struct)


def ranked(df: DataFrame, *order: Column, name: str = "position", start: int = 1) -> DataFrame:
    """Add consecutive numbers in the given order without gathering the rows in one task.

    A range-partitioned sort is materialised, so partition sizes are fixed; each row gets its
    partition's offset plus its place inside the partition. Only the sizes (one number per
    partition) pass through the driver. The order must be total.
    """
    slot = F.monotonically_increasing_id()
    sorted_rows = materialise(df.orderBy(*order))
    sizes = sorted_rows.groupBy(F.shiftright(slot, _ROW_BITS).alias("part")).count().collect()
    offsets, before = [], start
    for part, size in sorted(map(tuple, sizes)):
        offsets.append((part, before))
        before += size
    lookup = small_table(df.sparkSession, offsets, "_part long, _before long")
    row = F.col("_slot").bitwiseAND(F.lit((1 << _ROW_BITS) - 1))
    return (
        sorted_rows.withColumn("_slot", slot)
        .withColumn("_part", F.shiftright("_slot", _ROW_BITS))
        .join(F.broadcast(lookup), "_part")
        .withColumn(name, F.col("_before") + row)
        .drop("_part", "_slot", "_before")
    )
