"""Intermediate tables in the folder that driver and executors share."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession

_STORED: list[str] = []


def shared_dir(spark: SparkSession) -> str:
    """The folder of spark.checkpoint.dir, else the context's checkpoint folder, else on a local master one below the
    warehouse. A cluster without either is an error: a driver's local folder would lose rows there."""
    own = spark.conf.get("spark.checkpoint.dir", None)
    if own:
        return own.rstrip("/")
    context = spark.sparkContext
    known = context._jsc.sc().getCheckpointDir()
    if not known.isEmpty():
        return known.get().rstrip("/")
    if not context.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder that driver and executors share")
    return spark.conf.get("spark.sql.warehouse.dir").rstrip("/") + "/_checkpoints"


def stored(df: DataFrame, by: str | None = None, instead: DataFrame | None = None) -> DataFrame:
    """Write a table as Parquet in the shared folder and read it back: short lineage, columnar, on disk only.

    `by` names a column whose values get a folder each. `instead` is a stored table that nothing reads any more: it is deleted
    once the new one is complete.
    """
    path = f"{shared_dir(df.sparkSession)}/stored-{uuid.uuid4().hex}"
    (df.write.partitionBy(by) if by else df.write).parquet(path)
    _STORED.append(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out.stored_at = path
    if instead is not None:
        drop(instead)
    return out


def drop(table: DataFrame) -> None:
    """Deletes a stored table that nothing reads any more."""
    _STORED.remove(table.stored_at)
    _delete(table.sparkSession, table.stored_at)


def _delete(spark: SparkSession, name: str) -> None:
    path = spark._jvm.org.apache.hadoop.fs.Path(name)
    path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def drop_stored(spark: SparkSession) -> int:
    """Deletes all tables that this process has stored, once no result that reads them is needed; returns their number."""
    n = len(_STORED)
    while _STORED:
        _delete(spark, _STORED.pop())
    return n


def cut(df: DataFrame) -> DataFrame:
    """Write a table to the checkpoint folder and read it back, so that later steps survive lost executors."""
    context = df.sparkSession.sparkContext
    if context._jsc.sc().getCheckpointDir().isEmpty():
        context.setCheckpointDir(shared_dir(df.sparkSession))
    return df.checkpoint()
