"""Time alignment: grids with bounded filling, limited interpolation, nearest as-of."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .chunks import CHUNK, CHUNK_S, along, carried, chunked, inside


def on_grid(readings: DataFrame, by: list[str], step_s: int = 300, most: int = 24, chunk_s: int = CHUNK_S) -> DataFrame:
    """(by, sec, value, filled): means on a regular grid from each series' first
    to its last slot; up to ``most`` empty slots repeat the last value. Slots are
    made chunk by chunk, and a chunk starts with the last value before it."""
    chunk_s = max(1, chunk_s // step_s) * step_s  # a chunk holds whole slots
    slots = chunked(readings.groupBy(*by, (F.floor(F.col("sec") / step_s) * step_s).cast("long").alias("sec")).agg(F.avg("value").alias("value")), chunk_s)
    spans = slots.groupBy(*by).agg(F.min("sec").alias("a"), F.max("sec").alias("b"))
    pieces = spans.select(*by, "a", "b", F.explode(F.sequence(F.floor(F.col("a") / chunk_s).cast("long"), F.floor(F.col("b") / chunk_s).cast("long"))).alias(CHUNK))
    first, last = F.greatest("a", F.col(CHUNK) * chunk_s), F.least("b", (F.col(CHUNK) + 1) * chunk_s - step_s)
    spine = pieces.select(*by, CHUNK, F.explode(F.sequence(first, last, F.lit(step_s).cast("long"))).alias("sec"))
    met = spine.join(slots, [*by, CHUNK, "sec"], "left")
    known = F.when(F.col("value").isNotNull(), F.struct("sec", "value"))
    met = carried(met, by, {"end": F.max(known)}, {"__before": F.last("end", True).over(along(by).rowsBetween(Window.unboundedPreceding, -1))})
    near = F.coalesce(F.last(known, True).over(inside(by)), "__before")
    value = F.when(F.col("sec") - near["sec"] <= most * step_s, near["value"])
    return met.select(*by, "sec", value.alias("value"), F.col("value").isNull().alias("filled"))


def interpolated(rows: DataFrame, by: list[str], most: int, value: str = "value", chunk_s: int = CHUNK_S) -> DataFrame:
    """Fills nulls by position on the line to the next value, the first ``most``
    of each gap; a gap at the end repeats the last value, one at the beginning
    stays. Rows are numbered inside chunks; what a chunk needs besides is how many
    rows came before and the nearest values on both sides."""
    everything = (Window.unboundedPreceding, Window.unboundedFollowing)
    placed = chunked(rows, chunk_s).withColumn("__i", F.row_number().over(inside(by)).cast("long"))
    placed = placed.withColumn("__k", F.when(F.col(value).isNotNull(), F.struct(F.col("__i").alias("i"), F.col(value).alias("v"))))
    chain = along(by)
    count = F.coalesce(F.sum("n").over(chain.rowsBetween(everything[0], -1)), F.lit(0))
    shifted = lambda c: F.when(F.col(c).isNotNull(), F.struct((F.col(f"{c}.i") + count).alias("i"), F.col(f"{c}.v").alias("v")))
    each = placed.groupBy(*by, CHUNK).agg(F.count(F.lit(1)).alias("n"), F.min("__k").alias("first"), F.max("__k").alias("last"))
    each = each.select(*by, CHUNK, count.alias("__o"), shifted("first").alias("first"), shifted("last").alias("last"))
    state = each.select(
        *by, CHUNK, "__o", F.last("last", True).over(chain.rowsBetween(everything[0], -1)).alias("__l"), F.first("first", True).over(chain.rowsBetween(1, everything[1])).alias("__r")
    )
    met = placed.join(state, [*by, CHUNK]).withColumn("__i", F.col("__i") + F.col("__o"))
    met = met.withColumn("__k", F.when(F.col(value).isNotNull(), F.struct(F.col("__i").alias("i"), F.col(value).alias("v"))))
    order = inside(by)
    met = met.withColumns({"__l": F.coalesce(F.last("__k", True).over(order.rowsBetween(everything[0], 0)), "__l"), "__r": F.coalesce(F.first("__k", True).over(order.rowsBetween(0, everything[1])), "__r")})
    past = F.col("__i") - F.col("__l.i")
    line = F.col("__l.v") + F.coalesce((F.col("__r.v") - F.col("__l.v")) * past / (F.col("__r.i") - F.col("__l.i")), F.lit(0.0))
    filled = F.when(F.col(value).isNotNull(), F.col(value)).when(past <= most, line)
    return met.withColumn(value, filled).select(rows.columns)


def nearest(left: DataFrame, right: DataFrame, by: list[str], tolerance_s: int, value: str = "value") -> DataFrame:
    """Left rows with right_sec and right_value of the nearest right row within
    the tolerance; of two equally near ones the earlier. Left rows are unique by
    (by, sec). Both sides meet in buckets of the tolerance's length, so no row
    meets more of the other side than three buckets hold."""
    bucket = F.floor(F.col("sec") / max(1, tolerance_s))
    spread = left.withColumn("__b", F.explode(F.array(bucket - 1, bucket, bucket + 1)))
    far = right.select(*by, F.col("sec").alias("right_sec"), F.col(value).alias("right_value"), bucket.alias("__b"))
    met = spread.join(far, [*by, "__b"]).where(F.abs(F.col("sec") - F.col("right_sec")) <= tolerance_s)
    best = met.groupBy(*by, "sec").agg(F.min(F.struct(F.abs(F.col("sec") - F.col("right_sec")).alias("gap"), "right_sec", "right_value")).alias("m"))
    return left.join(best, [*by, "sec"], "left").select(*left.columns, F.col("m.right_sec").alias("right_sec"), F.col("m.right_value").alias("right_value"))


def bucket_mean(readings: DataFrame, by: list[str], step_s: int) -> DataFrame:
    return readings.groupBy(*by, (F.floor(F.col("sec") / step_s) * step_s).alias("sec")).agg(F.avg("value").alias("value"), F.count("value").alias("n"))
