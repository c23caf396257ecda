"""What the training-data operators share: scratch tables, words, Arrow maps."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable, Iterable, Iterator
from contextlib import contextmanager
from contextvars import ContextVar

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

#: Bytes of text that a task turns into Python objects at once.
SLICE_BYTES = 2 << 20


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def scratch(spark: SparkSession) -> str:
    """A new path below the folder that all executors share.

    ``spark.checkpoint.dir`` names it. Where it is unset, a session with a local
    master gets a temporary folder; on a cluster that would be a different disk
    for each executor, so it is an error there.
    """
    root = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not root and not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    if not root:
        root = tempfile.mkdtemp(prefix="spark-emberlane-")
        spark.conf.set("spark.checkpoint.dir", root)
    return f"{root.rstrip('/')}/emberlane-{uuid.uuid4().hex}"


_recorder: ContextVar[list[str] | None] = ContextVar("emberlane_scratch", default=None)


@contextmanager
def recorded() -> Iterator[list[str]]:
    """Lists the paths that ``stored`` writes meanwhile in this thread."""
    paths: list[str] = []
    token = _recorder.set(paths)
    try:
        yield paths
    finally:
        _recorder.reset(token)


def dropped(spark: SparkSession, paths: Iterable[str]) -> None:
    """Deletes scratch tables; whatever was made of them must have been written."""
    for path in paths:
        place = spark._jvm.org.apache.hadoop.fs.Path(path)
        place.getFileSystem(spark._jsc.hadoopConfiguration()).delete(place, True)


def folder(spark: SparkSession) -> str:
    """A scratch path for tables that rounds add with ``stored`` and ``gathered`` reads as one."""
    path = scratch(spark)
    if (paths := _recorder.get()) is not None:
        paths.append(path)
    return path


def stored(df: DataFrame, within: str | None = None) -> DataFrame:
    """The rows written as Parquet in the shared folder and read again.

    The plan that follows starts at these files, so the loss of an executor
    costs a read of them and not the work before. ``within`` is a ``folder`` that
    the table becomes a part of.
    """
    path = f"{within}/{uuid.uuid4().hex}" if within else folder(df.sparkSession)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def gathered(spark: SparkSession, within: str, schema: StructType) -> DataFrame:
    """All tables stored in a ``folder``, by one scan however many there are."""
    return spark.read.schema(schema).option("recursiveFileLookup", "true").parquet(within)


def quoted(names: Iterable[str]) -> list[str]:
    """Column names for ``select``, whatever characters they hold."""
    return [f"`{name.replace('`', '``')}`" for name in names]


def numbered(df: DataFrame, name: str) -> DataFrame:
    """The rows, stored, with a number of their own in column ``name``."""
    return stored(df.withColumn(name, F.monotonically_increasing_id()))


def words(text: str | None) -> list[bytes]:
    """A-Z lower-cased, split at ASCII white space, as UTF-8 bytes."""
    return text.encode("utf-8", "replace").lower().split() if text else []


def sliced(batch: pa.RecordBatch, size: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """Runs of rows with about ``size`` bytes of text or less; a longer text stands alone.

    They share the batch's memory, so a task holds Python objects for one run at a time.
    """
    lengths = np.zeros(batch.num_rows, np.int64)
    for column in batch.columns:
        if pa.types.is_string(column.type) or pa.types.is_binary(column.type):
            lengths += pc.fill_null(pc.binary_length(column), 0).to_numpy(zero_copy_only=False)
    part = np.cumsum(lengths) // size
    bounds = [0, *(np.flatnonzero(np.diff(part)) + 1).tolist(), batch.num_rows]
    for first, last in zip(bounds, bounds[1:]):
        yield batch.slice(first, last - first)


def map_rows(df: DataFrame, schema: str, each: Callable[[], Callable[..., dict]], *columns: str) -> DataFrame:
    """Arrow map over ``columns``; ``each()`` is called once a task and gives a
    function from lists of the columns' values to a dict of the output lists
    (or Arrow arrays). It gets a bounded run of rows at a time."""
    out = df.sparkSession.createDataFrame([], schema).schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark.sql.pandas.types import to_arrow_schema

        work, kinds = each(), to_arrow_schema(out)
        column = lambda made, kind: made.cast(kind) if isinstance(made, pa.Array) else pa.array(made, kind)
        for batch in batches:
            for rows in sliced(batch):
                made = work(*(rows.column(i).to_pylist() for i in range(len(columns))))
                yield pa.RecordBatch.from_arrays([column(made[f.name], f.type) for f in kinds], schema=kinds)

    return df.select(*(F.col(c) for c in columns)).mapInArrow(run, out)
