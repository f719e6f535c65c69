"""Tables that later steps read more than once, in the folder that driver and executors share."""

from __future__ import annotations

import atexit
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_made: list[tuple[SparkSession, str]] = []


def folder(spark: SparkSession) -> str:
    """spark.checkpoint.dir; where it is unset, a local folder in local mode, else one in the warehouse."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if found:
        return found.rstrip("/")
    if spark.sparkContext.master.startswith("local"):
        return f"file://{tempfile.gettempdir()}/seqloom-shared"
    return spark.conf.get("spark.sql.warehouse.dir").rstrip("/") + "/_seqloom"


def scratch(spark: SparkSession, name: str) -> str:
    """A new path in the shared folder; what is written there goes by dropped(), or when the driver's process ends."""
    path = f"{folder(spark)}/{name}-{uuid.uuid4().hex}"
    if not _made:
        atexit.register(_drop)
    _made.append((spark, path))
    return path


def kept(df: DataFrame, name: str) -> DataFrame:
    """df written as Parquet and read back: cuts the lineage, outlives executors. Deleted when the driver's process ends."""
    path = scratch(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def dropped(spark: SparkSession, path: str) -> None:
    """Delete a folder wherever Spark can write."""
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(where, True)


def _drop() -> None:
    for spark, path in _made:
        try:
            dropped(spark, path)
        except Exception:  # noqa: BLE001  the session may be gone; the folder is then left to its owner
            continue


def spread(df: DataFrame) -> DataFrame:
    """df in as many partitions as there are cores, if a scan of few row groups gave fewer; larger inputs stay where they are."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if df.rdd.getNumPartitions() < cores else df
