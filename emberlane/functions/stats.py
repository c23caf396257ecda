"""Statistics as Column and aggregate builders."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def ols(y: str, x: str) -> list[Column]:
    """Aggregates slope, intercept, r2, n, sxx of y on x.

    A constant x gives slope 0 and the mean of y; a constant x or y gives r2 0.
    """
    ready = F.col(y).isNotNull() & F.col(x).isNotNull()
    yy, xx = F.when(ready, F.col(y)), F.when(ready, F.col(x))
    flat_x = F.min(xx) == F.max(xx)
    flat_y = F.min(yy) == F.max(yy)
    return [
        F.when(flat_x, 0.0).otherwise(F.regr_slope(yy, xx)).alias("slope"),
        F.when(flat_x, F.avg(yy)).otherwise(F.regr_intercept(yy, xx)).alias("intercept"),
        F.when(flat_x | flat_y, 0.0).otherwise(F.regr_r2(yy, xx)).alias("r2"),
        F.count(yy).alias("n"),
        F.regr_sxx(yy, xx).alias("sxx"),
        (F.max(xx) - F.min(xx)).alias("x_spread"),
    ]


def at_rank(values: str, rank: Column) -> Column:
    """Aggregate: the value of this rank (from 0) in ascending order.

    For groups of bounded size, such as one home's days or nights.
    """
    return F.element_at(F.sort_array(F.collect_list(values)), rank.cast("int") + 1)


def floor_percentile(values: str, p: float) -> Column:
    return at_rank(values, F.floor(F.lit(p) * (F.count(values) - 1)))


def lower_quartile(values: str) -> Column:
    return at_rank(values, F.floor(F.count(values) / 4))


def upper_quartile(values: str) -> Column:
    return at_rank(values, F.floor(F.count(values) * 3 / 4))


def lag1_autocorrelation(residuals: DataFrame, by: list[str], day: str, value: str, min_pairs: int = 10) -> DataFrame:
    """(by, r1, pairs): pairs are consecutive days only; the variance is over all
    residuals and the covariance over the pairs, both about the overall mean.
    Fewer than ``min_pairs`` give 0."""
    order = Window.partitionBy(*by).orderBy(day)
    mean = F.avg(value).over(Window.partitionBy(*by))
    paired = residuals.withColumns({"__p": F.lag(value).over(order), "__g": F.datediff(F.col(day), F.lag(day).over(order)), "__m": mean})
    product = F.when(F.col("__g") == 1, (F.col(value) - F.col("__m")) * (F.col("__p") - F.col("__m")))
    r = F.avg(product) / F.var_pop(value)
    return paired.groupBy(*by).agg(
        F.count(product).alias("pairs"),
        F.when((F.count(product) < min_pairs) | (F.var_pop(value) == 0), 0.0).otherwise(r).alias("r1"),
    )


def variance_inflation(r1: Column, most: float = 0.9) -> Column:
    r = F.greatest(F.lit(0.0), F.least(r1, F.lit(most)))
    return (1 + r) / (1 - r)


def trailing(df: DataFrame, by: list[str], day: str, value: str, days: int, min_days: int = 1, kind: str = "mean", shift: int = 0) -> Column:
    """Rolling column over the ``days`` calendar days that end ``shift`` days ago;
    null with fewer than ``min_days`` values. Kinds: mean, median, count."""
    number = F.datediff(F.col(day), F.lit("1970-01-01").cast("date"))
    frame = Window.partitionBy(*by).orderBy(number).rangeBetween(-(days - 1) - shift, -shift)
    if kind == "count":
        return F.count(value).over(frame)
    what = F.avg(value) if kind == "mean" else F.percentile(value, 0.5)  # median() takes no frame
    return F.when(F.count(value).over(frame) >= min_days, what.over(frame))


def change_pct(now: Column, before: Column) -> Column:
    """Change against ``before`` in percent of it; null where that is 0."""
    return F.try_divide(now - before, before) * 100
