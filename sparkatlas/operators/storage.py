"""Tables that iterative operators write between rounds."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession


_OWN: dict[str, str] = {}


def shared_root(spark: SparkSession) -> str:
    """The session's spark.checkpoint.dir; where it is unset on one machine, as in tests, a folder of our own."""
    sc = spark.sparkContext
    root = sc.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        if not sc.master.startswith("local[") and sc.master != "local":
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        if sc.applicationId not in _OWN:
            _OWN[sc.applicationId] = tempfile.mkdtemp(prefix="sparkatlas-")
        root = _OWN[sc.applicationId]
    return root.rstrip("/")


def written(df: DataFrame, label: str) -> DataFrame:
    """Write df to the session's shared checkpoint folder and read it back.

    Cuts the lineage of loops and survives lost executors.
    """
    spark = df.sparkSession
    path = f"{shared_root(spark)}/sparkatlas/{label}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def complete(spark: SparkSession, path: str) -> bool:
    """Whether a table has been written there to its end."""
    done = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{path}/_SUCCESS")
    return done.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(done)


@contextmanager
def tidy(spark: SparkSession) -> Iterator[None]:
    """Within it, what an action has shuffled is deleted as the action ends, so that the rounds of a loop don't fill the disks."""
    name = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before = spark.conf.get(name)
    spark.conf.set(name, "true")
    try:
        yield
    finally:
        spark.conf.set(name, before)


#: Rows of a small table that is held in the plan itself at most.
HELD_ROWS = 1 << 13


def held(df: DataFrame, label: str) -> DataFrame:
    """df as a local table if it has few rows, else written: either way it is worked out once."""
    table = df.limit(HELD_ROWS + 1).toArrow()
    return df.sparkSession.createDataFrame(table, df.schema) if table.num_rows <= HELD_ROWS else written(df, label)


#: Rows that a task groups at most, keys permitting.
TASK_ROWS = 1 << 20


def dealt(df: DataFrame, *columns: str) -> DataFrame:
    """df dealt by columns to as many tasks as keep each one's rows bounded, however many rows there are.

    Shuffles of a fixed number of partitions give tasks that grow with the
    input; up to TASK_ROWS a partition, df stays as it is.
    """
    rows, parts = df.count(), int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return df.repartition(-(-rows // TASK_ROWS), *columns) if rows > parts * TASK_ROWS else df


def bucketed(df: DataFrame, column: str, label: str) -> tuple[DataFrame, str]:
    """df written in as many buckets of a column as shuffles have partitions, and the table's name, to be dropped after use.

    A join on the column reads it as it lies; only the other side moves.
    """
    spark = df.sparkSession
    name, n = f"sparkatlas_{label}_{uuid.uuid4().hex}", int(spark.conf.get("spark.sql.shuffle.partitions"))
    df.repartition(n, column).write.bucketBy(n, column).sortBy(column).option("path", f"{shared_root(spark)}/sparkatlas/{name}").saveAsTable(name)
    return spark.table(name), name
