"""Exact values at ranks of large groups, without a list or sort of a group.

A sketch of each group (combined before the shuffle) gives a bracket of values
around each rank; one pass counts what lies below the bracket and how often each
value inside it occurs, and the running count of those few values finds the rank.
Brackets that miss, as a sketch only promises so much, are widened and tried again.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..sources.scratch import written

#: Share of a group's rows by which a bracket's ends lie around the rank, and the sketch's accuracy.
MARGIN, ACCURACY = 0.002, 1000


#: A rank, from 0 in ascending order, of a group's count.
Rank = Callable[[Column], Column]


def floor_rank(p: float) -> Rank:
    """The rank of the percentile that rounds down."""
    return lambda n: F.floor(F.lit(p) * (n - 1))


def part_rank(numerator: int, denominator: int) -> Rank:
    return lambda n: F.floor(n * numerator / denominator)


def at_ranks(rows: DataFrame, by: list[str], value: str, ranks: dict[str, Rank]) -> DataFrame:
    """(by, n, one column for each of ``ranks``): the value at each rank of a
    group's ``n`` values that aren't null; a rank outside the group gives null. Groups without values have no row,
    and columns of ``by`` may not be null."""
    known = rows.select(*by, F.col(value).alias("__v")).where(F.col("__v").isNotNull())
    names = list(ranks)
    margin = MARGIN
    found, open_ = None, None
    while True:
        pending = known if open_ is None else known.join(open_, by, "left_semi")
        share = lambda k: (F.col(f"__k_{k}") + 0.5) / F.col("n")
        sketch = pending.groupBy(*by).agg(F.count("__v").alias("n"), F.percentile_approx("__v", [i / ACCURACY for i in range(ACCURACY + 1)], ACCURACY * 5).alias("__q"), F.min("__v").alias("__min"), F.max("__v").alias("__max"))
        sketch = sketch.withColumns({f"__k_{k}": rank(F.col("n")).cast("long") for k, rank in ranks.items()})
        at = lambda x: F.get("__q", F.greatest(F.lit(0), F.least(F.lit(ACCURACY), x)).cast("int"))
        ends = [
            F.struct(
                F.lit(k).alias("k"),
                F.when(share(k) - margin <= 0, F.col("__min")).otherwise(at(F.floor((share(k) - margin) * ACCURACY))).alias("lo"),
                F.when(share(k) + margin >= 1, F.col("__max")).otherwise(at(F.ceil((share(k) + margin) * ACCURACY))).alias("hi"),
            )
            for k in names
        ]
        brackets = written(sketch.select(*by, "n", *(f"__k_{k}" for k in names), F.array(*ends).alias("__e")))
        met = pending.join(brackets.select(*by, "__e"), by).select(
            *by, "__v", F.explode(F.filter("__e", lambda e: F.col("__v") <= e["hi"])).alias("e")
        )
        # below a bracket all values count as one; inside it each for itself
        inner = F.when(F.col("__v") >= F.col("e.lo"), F.col("__v"))
        counts = met.groupBy(*by, F.col("e.k").alias("k"), inner.alias("v")).agg(F.count(F.lit(1)).alias("c"))
        order = Window.partitionBy(*by, "k").orderBy(F.col("v").asc_nulls_first())
        upto = counts.withColumn("upto", F.sum("c").over(order)).where("v is not null").withColumn("begin", F.col("upto") - F.col("c"))
        met = upto.join(brackets.drop("__e"), by)
        rank = F.coalesce(*(F.when(F.col("k") == k, F.col(f"__k_{k}")) for k in names))
        hit = (F.col("begin") <= rank) & (rank < F.col("upto"))
        got = met.groupBy(*by).agg(*(F.max(F.when(hit & (F.col("k") == k), F.col("v"))).alias(k) for k in names))
        here = brackets.drop("__e").join(got, by, "left")
        missing = [F.col(k).isNull() & F.col(f"__k_{k}").between(0, F.col("n") - 1) for k in names]
        lost = missing[0]
        for m in missing[1:]:
            lost = lost | m
        here = written(here.withColumn("__lost", lost))
        done = here.where(~F.col("__lost")).select(*by, "n", *names)
        found = done if found is None else found.unionByName(done)
        if here.where("__lost").isEmpty():
            return found
        open_, margin = here.where("__lost").select(*by), min(1.0, margin * 8)


def interpolated(rows: DataFrame, by: list[str], value: str, shares: dict[str, float]) -> DataFrame:
    """(by, n, one column for each of ``shares``): percentiles on the line between
    the values at the two ranks around them."""
    place = lambda p: F.lit(p) * (F.col("n") - 1)
    ranks = {f"{k}__lo": floor_rank(p) for k, p in shares.items()} | {f"{k}__hi": lambda n, p=p: F.ceil(F.lit(p) * (n - 1)) for k, p in shares.items()}
    found = at_ranks(rows, by, value, ranks)
    line = lambda k, p: F.col(f"{k}__lo") + (F.col(f"{k}__hi") - F.col(f"{k}__lo")) * (place(p) - F.floor(place(p)))
    return found.select(*by, "n", *(line(k, p).alias(k) for k, p in shares.items()))
