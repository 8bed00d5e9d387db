"""Writers: snapshots swapped in whole, logs by month, exports by peer."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def append_log(events: DataFrame, root: str, ts: str = "ts") -> None:
    """Append events as JSON, one folder a month."""
    events.withColumn("month", F.date_format(F.col(ts).cast("timestamp"), "yyyy-MM")).write.mode("append").partitionBy("month").json(root)


def _pointers(spark: SparkSession, root: str) -> list[int]:
    """Numbers of the complete pointers below root, least first."""
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path
    at = path(f"{root}/pointers")
    fs = at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    names = [x.getPath().getName() for x in fs.listStatus(at)] if fs.exists(at) else []
    return sorted(int(n) for n in names if n.isdigit() and fs.exists(path(f"{root}/pointers/{n}/_SUCCESS")))


def write_snapshot(df: DataFrame, root: str) -> str:
    """Write a new version beside the old ones, then a new pointer to it.

    Nothing is overwritten: readers follow the last complete pointer, and see
    one version or the other whole.
    """
    spark, version = df.sparkSession, uuid.uuid4().hex
    df.write.parquet(f"{root}/versions/{version}")
    n = max(_pointers(spark, root), default=0) + 1
    spark.createDataFrame([(version,)], "version string").coalesce(1).write.parquet(f"{root}/pointers/{n}")
    return version


def has_snapshot(spark: SparkSession, root: str) -> bool:
    return bool(_pointers(spark, root))


def read_snapshot(spark: SparkSession, root: str) -> DataFrame:
    version = spark.read.parquet(f"{root}/pointers/{_pointers(spark, root)[-1]}").first().version
    return spark.read.parquet(f"{root}/versions/{version}")


def rebuild(build, root: str) -> str:
    """Build a table anew from nothing and swap it in; older versions stay until they are dropped."""
    return write_snapshot(build(), root)


def write_export(notes: DataFrame, root: str, peer_id: str) -> None:
    """Notes that a peer may read, in the folder of this peer."""
    notes.write.mode("overwrite").parquet(f"{root}/peer_id={peer_id}")


def write_tables(tables: dict[str, DataFrame], root: str, peer_id: str) -> None:
    """All tables of an export, each in a folder of its own for this peer."""
    for name, df in tables.items():
        df.write.mode("overwrite").parquet(f"{root}/{name}/peer_id={peer_id}")
