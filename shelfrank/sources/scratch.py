"""Tables saved for a while in the folder that driver and executors share, and broadcasts bounded by bytes."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Estimated bytes up to which a table may be broadcast; beyond that it is joined by shuffle.
BROADCAST_BYTES = 16 << 20


def scratch_dir(spark: SparkSession) -> str:
    """The folder of ``spark.checkpoint.dir``.

    Where it is unset, a local session (as in tests) gets a temporary one; on a cluster that is an error, as executors
    would each write to their own disk.
    """
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        base = "file://" + tempfile.mkdtemp(prefix="spark-scratch-")
        spark.conf.set("spark.checkpoint.dir", base)
    return base.rstrip("/")


def scratch_path(spark: SparkSession, name: str) -> str:
    return f"{scratch_dir(spark)}/{name}-{uuid.uuid4().hex}"


def materialize(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` to the shared folder and read it again: cuts lineage, survives lost executors. See ``discard``."""
    path = scratch_path(df.sparkSession, name)
    df.write.option("compression", "zstd").parquet(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out._scratch_path = path
    return out


def discard(*tables: DataFrame) -> None:
    """Delete tables of ``materialize`` that nothing reads any more; what a lazy result reads stays."""
    for t in tables:
        path = t.sparkSession._jvm.org.apache.hadoop.fs.Path(t._scratch_path)
        path.getFileSystem(t.sparkSession._jsparkSession.sessionState().newHadoopConf()).delete(path, True)


def small(df: DataFrame, row_bytes: int, no_more_than: DataFrame | None = None) -> DataFrame:
    """``df`` with a broadcast hint if its rows, of about ``row_bytes`` each, stay within BROADCAST_BYTES.

    A cheaper table that has at least as many rows can be counted for it.
    """
    most = BROADCAST_BYTES // row_bytes
    counted = df if no_more_than is None else no_more_than
    return F.broadcast(df) if counted.limit(most + 1).count() <= most else df
