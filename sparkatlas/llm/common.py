"""Shared storage and small column helpers of the training-data operators."""

from __future__ import annotations

import gc
import re
import tempfile
import uuid
from collections.abc import Sequence

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

WORD = r"[^\x20\x09-\x0D]+"
#: The folder of a table that stored() wrote.
OWN = re.compile(r"(.*/sparkatlas/[a-z-]+-[0-9a-f]{32})/")
GAP = r"[\x20\x09-\x0D]+"
_OWN_DIRS: dict[str, str] = {}


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: the session's spark.checkpoint.dir.

    Only where that is unset and everything runs on one machine, as in tests, a
    folder of our own is taken; a cluster without the setting is an error.
    """
    sc = spark.sparkContext
    conf = sc.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if not conf:
        if not sc.master.startswith("local[") and sc.master != "local":
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        if sc.applicationId not in _OWN_DIRS:
            _OWN_DIRS[sc.applicationId] = tempfile.mkdtemp(prefix="sparkatlas-")
        conf = _OWN_DIRS[sc.applicationId]
    return conf.rstrip("/")


def fresh_path(spark: SparkSession, label: str) -> str:
    return f"{shared_dir(spark)}/sparkatlas/{label}-{uuid.uuid4().hex}"


def stored(df: DataFrame, label: str, codec: str = "zstd", by: str | None = None) -> DataFrame:
    """Write to the shared folder (by: in folders of this column) and read back: cuts lineage, survives lost executors."""
    spark = df.sparkSession
    path = fresh_path(spark, label)
    writer = df.write.option("compression", codec)
    (writer.partitionBy(by) if by else writer).parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def discard(*tables: DataFrame) -> None:
    """Delete tables that stored() wrote, once nothing reads them any more."""
    for df in tables:
        for path in {m[1] for m in map(OWN.match, df.inputFiles()) if m}:
            sc = df.sparkSession.sparkContext
            at = sc._jvm.org.apache.hadoop.fs.Path(path)
            at.getFileSystem(sc._jsc.hadoopConfiguration()).delete(at, True)


def release(spark: SparkSession) -> None:
    """Let Spark drop the shuffle files of plans that are no longer referenced."""
    gc.collect()
    spark.sparkContext._jvm.System.gc()


def unused(df: DataFrame, name: str) -> str:
    """name, made longer until no column of df has it (in any case of letters)."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


#: Rows of a table of few narrow columns that is broadcast at most.
BROADCAST_ROWS = 1 << 17


def beside(small: DataFrame) -> DataFrame:
    """small, written, with the hint for joining it: broadcast if it has few rows, a shuffle otherwise.

    Either way a key that fills a partition of the other side can be split.
    """
    small = stored(small, "beside")
    return F.broadcast(small) if small.count() <= BROADCAST_ROWS else small.hint("shuffle_merge")


def text_of(column: str = "text") -> Column:
    return F.coalesce(F.col(column), F.lit(""))


def ascii_lower(column: Column) -> Column:
    """Lower-cases A-Z only, as the contracts say."""
    return F.translate(column, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def with_text(batch: pa.RecordBatch, names: Sequence[str], texts: list[str | None], keep: list[bool] | None = None) -> pa.RecordBatch:
    """The named columns of batch with other texts, and only the rows to keep."""
    columns = [pa.array(texts, pa.string()) if n == "text" else batch.column(batch.schema.get_field_index(n)) for n in names]
    out = pa.RecordBatch.from_arrays(columns, names=list(names))
    return out if keep is None else out.filter(pa.array(keep, pa.bool_()))
