"""Long series in pieces: windows over (series, chunk of time) instead of whole series.

An operator that looks back needs little of what came before a chunk: the last
reading, a count, the last known value. That is aggregated for each chunk, carried
along a series over its chunks (a row each), and met again by (series, chunk), so
the largest task holds a chunk's rows and not a series' whole history. Series
columns may not be null.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Seconds of a chunk: 30 days, or 720 hourly rows and 8,640 of five minutes.
CHUNK_S = 30 * 86_400
CHUNK = "__chunk"


def chunked(rows: DataFrame, chunk_s: int = CHUNK_S) -> DataFrame:
    return rows.withColumn(CHUNK, F.floor(F.col("sec") / chunk_s).cast("long"))


def inside(by: list[str]) -> Window:
    """The window of a chunk's rows in order of time."""
    return Window.partitionBy(*by, CHUNK).orderBy("sec")


def along(by: list[str]) -> Window:
    """The window over a series' chunks, for tables with a row for each chunk."""
    return Window.partitionBy(*by).orderBy(CHUNK)


def carried(placed: DataFrame, by: list[str], summary: dict[str, Column], state: dict[str, Column]) -> DataFrame:
    """Adds to chunked rows the ``state`` of their chunk: columns over ``along`` of
    the chunks' aggregated ``summary``."""
    each = placed.groupBy(*by, CHUNK).agg(*(c.alias(n) for n, c in summary.items()))
    return placed.join(each.select(*by, CHUNK, *(c.alias(n) for n, c in state.items())), [*by, CHUNK])


def with_previous(rows: DataFrame, by: list[str], value: str = "value", chunk_s: int = CHUNK_S) -> DataFrame:
    """Adds ``__prev``, a struct of sec and value of the series' reading before
    (null for the first), and ``__chunk``."""
    reading = F.struct(F.col("sec").alias("sec"), F.col(value).alias("value"))
    placed = carried(chunked(rows, chunk_s), by, {"end": F.max_by(reading, "sec")}, {"__before": F.lag("end").over(along(by))})
    return placed.withColumn("__prev", F.coalesce(F.lag(reading).over(inside(by)), "__before")).drop("__before")
