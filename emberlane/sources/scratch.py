"""Tables that several branches of a plan read, written once."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_folder(spark: SparkSession) -> str:
    """``spark.checkpoint.dir``; a temporary folder only where it is unset and the master is local."""
    root = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not root and not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    if not root:
        root = tempfile.mkdtemp(prefix="spark-emberlane-")
        spark.conf.set("spark.checkpoint.dir", root)
    return root.rstrip("/")


#: Paths of scratch tables that this process has written and not yet deleted.
_kept: list[str] = []


def kept(spark: SparkSession, path: str) -> str:
    """The path, noted for ``cleared``."""
    _kept.append(path)
    return path


def written(df: DataFrame) -> DataFrame:
    """The rows as a Parquet table in the shared folder, so that branches read
    it instead of making it again and lost executors cost a read."""
    path = kept(df.sparkSession, f"{shared_folder(df.sparkSession)}/emberlane-days-{uuid.uuid4().hex}")
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def cleared(spark: SparkSession) -> int:
    """Deletes the scratch tables of all queries before; their results must have
    been written or collected by then. Returns how many there were."""
    n = len(_kept)
    while _kept:
        place = spark._jvm.org.apache.hadoop.fs.Path(_kept.pop())
        place.getFileSystem(spark._jsc.hadoopConfiguration()).delete(place, True)
    return n
