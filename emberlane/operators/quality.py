"""Cache quality: upserts, cadence audits, offsets between meter sources."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .alignment import nearest
from .chunks import with_previous


def keep_last(rows: DataFrame, keys: list[str], order: Column) -> DataFrame:
    """One row for each key, the last by ``order``; combined before the shuffle."""
    others = [c for c in rows.columns if c not in keys]
    best = rows.groupBy(*keys).agg(F.max_by(F.struct(*others), order).alias("__r"))
    return best.select(*keys, *(F.col("__r")[c].alias(c) for c in others))


def upsert(existing: DataFrame, incoming: DataFrame, keys: list[str]) -> DataFrame:
    """The existing rows with incoming ones added; at equal keys the incoming stay."""
    both = existing.withColumn("__o", F.lit(0)).unionByName(incoming.withColumn("__o", F.lit(1)))
    return keep_last(both, keys, F.col("__o")).drop("__o")


def cadence(readings: DataFrame, by: list[str]) -> DataFrame:
    gaps = with_previous(readings.select(*by, "sec"), by, "sec").withColumn("gap", F.col("sec") - F.col("__prev.sec")).where("gap > 0")
    return gaps.groupBy(*by).agg(F.median("gap").alias("cadence_s"))


def audit(readings: DataFrame, by: list[str], max_step: float) -> DataFrame:
    """(by, rows, start, end, cadence_s, gaps, negative, over, mixed): gaps over
    1.5 cadences, falling and too large steps, and whether large rises and falls
    match, as they do where two meters' baselines take turns."""
    marked = with_previous(readings, by)
    marked = marked.withColumns({"gap": F.col("sec") - F.col("__prev.sec"), "step": F.col("value") - F.col("__prev.value")})
    marked = marked.join(cadence(readings, by), by, "left")
    up, down = F.when(F.col("step") > max_step, F.col("step")), F.when(F.col("step") < 0, -F.col("step"))
    out = marked.groupBy(*by).agg(
        F.count(F.lit(1)).alias("rows"), F.min("sec").alias("start"), F.max("sec").alias("end"), F.max("cadence_s").alias("cadence_s"),
        F.count_if(F.col("gap") > 1.5 * F.col("cadence_s")).alias("gaps"), F.count(down).alias("negative"), F.count(up).alias("over"), F.median(up).alias("__u"), F.median(down).alias("__d"),
    )
    alike = F.abs(F.col("__u") - F.col("__d")) <= F.greatest(F.lit(max_step), 0.1 * F.greatest("__u", "__d"))
    mixed = F.coalesce((F.col("negative") >= 2) & (F.col("over") >= 2) & alike, F.lit(False))
    return out.withColumn("mixed", mixed).drop("__u", "__d")


def baseline_offset(anchor: DataFrame, other: DataFrame, by: list[str], tolerance_s: int, min_pairs: int = 3) -> DataFrame:
    """(by, pairs, offset, mad, proven): median difference of ``other`` from the
    anchor at nearest stamps; proven if the differences agree."""
    pairs = nearest(other, anchor, by, tolerance_s).where("right_sec is not null").withColumn("diff", F.col("value") - F.col("right_value"))
    middle = pairs.groupBy(*by).agg(F.median("diff").alias("offset"), F.count("diff").alias("pairs"))
    joined = lambda a, b: a.join(b, by) if by else a.crossJoin(b)
    spread = joined(pairs, middle).groupBy(*by).agg(F.median(F.abs(F.col("diff") - F.col("offset"))).alias("mad"))
    limit = F.greatest(F.lit(0.25), F.least(F.lit(2.0), 0.001 * F.abs("offset")))
    return joined(middle, spread).withColumn("proven", (F.col("pairs") >= min_pairs) & (F.col("mad") <= limit))


def spans(cache: DataFrame, by: list[str]) -> DataFrame:
    """(by, source, rows, start, end, kind) of each source of a cache; the kind
    is null where rows have none."""
    kind = F.max("kind") if "kind" in cache.columns else F.lit(None).cast("string")
    found = cache.groupBy(*by, "source").agg(F.count(F.lit(1)).alias("rows"), F.min("sec").alias("start"), F.max("sec").alias("end"), kind.alias("kind"))
    return found


def anchors(found: DataFrame, by: list[str], first: str = "lts") -> DataFrame:
    """(by, anchor): the source named ``first``, else that of the widest span,
    then of most rows, then the least name."""
    order = F.struct(F.col("source") != first, F.col("start") - F.col("end"), -F.col("rows"), F.col("source"))
    return found.groupBy(*by).agg(F.min_by("source", order).alias("anchor"))


def overlap_tolerance(readings: DataFrame, by: list[str]) -> DataFrame:
    """(by, tolerance_s): half the cadence, 5 to 45 minutes; half an hour without one."""
    half = F.least(F.greatest(F.col("cadence_s") / 2, F.lit(300)), F.lit(2700))
    every = readings.select(*by).distinct().join(cadence(readings, by), by, "left")
    return every.select(*by, F.coalesce(half, F.lit(1800)).cast("long").alias("tolerance_s"))


def source_offsets(cache: DataFrame, by: list[str], chosen: DataFrame, min_pairs: int = 3) -> DataFrame:
    """(by, source, pairs, offset, mad, proven) of every source but the anchor,
    each against its home's anchor at nearest stamps."""
    rows = cache.join(chosen, by)
    anchor = rows.where("source = anchor").select(*by, "sec", "value")
    others = rows.where("source != anchor").select(*by, "source", "sec", "value")
    copies = others.select(*by, "source").distinct().join(anchor, by).select(*by, "source", "sec", "value")
    limits = overlap_tolerance(anchor, by)
    key = [*by, "source"]
    near = nearest(others, copies, key, 2700).where("right_sec is not null").join(limits, by)
    near = near.where(F.abs(F.col("sec") - F.col("right_sec")) <= F.col("tolerance_s")).withColumn("diff", F.col("value") - F.col("right_value"))
    middle = near.groupBy(*key).agg(F.median("diff").alias("offset"), F.count("diff").alias("pairs"))
    spread = near.join(middle.select(*key, "offset"), key).groupBy(*key).agg(F.median(F.abs(F.col("diff") - F.col("offset"))).alias("mad"))
    found = others.select(*key).distinct().join(middle, key, "left").join(spread, key, "left")
    limit = F.greatest(F.lit(0.25), F.least(F.lit(2.0), 0.001 * F.abs("offset")))
    proven = F.coalesce((F.col("pairs") >= min_pairs) & (F.col("mad") <= limit), F.lit(False))
    return found.select(*key, F.coalesce("pairs", F.lit(0)).alias("pairs"), "offset", "mad", proven.alias("proven"))


def merge_cumulative(cache: DataFrame, by: list[str]) -> tuple[DataFrame, DataFrame]:
    """(merged meter, decisions) of cache rows (by, source, sec, value).

    The anchor's rows stay as they are; sources whose offset from the anchor is
    proven are shifted by it and, by name, later ones win at equal stamps.
    Decisions (by, source, used, pairs, offset) tell of every source of every
    home, so rejected ones are listed by home.
    """
    chosen = anchors(spans(cache, by), by)
    offsets = source_offsets(cache, by, chosen)
    known = cache.select(*by, "source").distinct().join(chosen, by).join(offsets, [*by, "source"], "left")
    is_anchor = F.col("source") == F.col("anchor")
    used = is_anchor | F.coalesce("proven", F.lit(False))
    decisions = known.select(*by, "source", used.alias("used"), "pairs", F.when(is_anchor, 0.0).otherwise(F.col("offset")).alias("offset"), is_anchor.alias("anchor"))
    rows = cache.join(decisions.where("used"), [*by, "source"]).withColumn("value", F.col("value") - F.col("offset"))
    rank = F.when(F.col("anchor"), "").otherwise(F.concat(F.lit("1"), F.col("source")))
    merged = keep_last(rows.select(*by, "sec", "value", rank.alias("__rank")), [*by, "sec"], F.col("__rank")).drop("__rank")
    return merged, decisions


def merge_measurements(cache: DataFrame, by: list[str], last: str = "rest") -> DataFrame:
    """(by, sec, value): all sources, by name; ``last`` wins at equal stamps."""
    rank = F.struct(F.col("source") == last, F.col("source"))
    return keep_last(cache.select(*by, "sec", "value", rank.alias("__rank")), [*by, "sec"], F.col("__rank")).drop("__rank")


def load_policy(cache: DataFrame, by: list[str], first: str = "lts") -> DataFrame:
    """(by, policy, kinds, preferred): how a home's sources are combined.

    ``merge cumulative`` if all kinds that are told are cumulative; ``one source``
    if they conflict: that named ``first``, else that of most rows; otherwise
    ``merge measurements``.
    """
    found = spans(cache, by)
    order = F.struct(F.col("source") != first, -F.col("rows"), F.col("source"))
    told = found.groupBy(*by).agg(F.array_sort(F.collect_set("kind")).alias("kinds"), F.min_by("source", order).alias("best"))
    cumulative = F.array_contains("kinds", "cumulative")
    policy = F.when(cumulative & (F.size("kinds") == 1), "merge cumulative").when(cumulative, "one source").otherwise("merge measurements")
    return told.select(*by, policy.alias("policy"), "kinds", F.when(policy == "one source", F.col("best")).alias("preferred"))


def load(cache: DataFrame, by: list[str], source: str | None = None) -> DataFrame:
    """(by, sec, value) of a cache: of exactly ``source`` if given, else as
    ``load_policy`` says for each home."""
    if source is not None:
        return cache.where(F.col("source") == source).select(*by, "sec", "value")
    rows = cache.join(load_policy(cache, by), by)
    merged, _ = merge_cumulative(rows.where("policy = 'merge cumulative'").select(cache.columns), by)
    single = rows.where("policy = 'one source' and source = preferred").select(*by, "sec", "value")
    plain = merge_measurements(rows.where("policy = 'merge measurements'"), by)
    return merged.unionByName(single).unionByName(plain)


def repair(cache: DataFrame, by: list[str], max_step: float) -> tuple[DataFrame, DataFrame]:
    """(canonical rows, statuses) of cache rows (by, source, sec, value, seq):
    ordered by stamp with one finite value each, the last by ``seq``. Sources
    with mixed baselines are ``refused`` and not rewritten, as they can't be told
    apart without a clean copy; the others are ``rewritten``."""
    key = [*by, "source"]
    finite = cache.where(F.col("value").isNotNull() & ~F.isnan("value") & (F.abs("value") < float("inf")))
    clean = keep_last(finite, [*key, "sec"], F.col("seq")).drop("seq")
    marked = audit(clean, key, max_step).select(*key, "mixed", "rows")
    statuses = cache.select(*key).distinct().join(marked, key, "left")
    status = F.when(F.col("rows").isNull(), "missing").when(F.col("mixed"), "refused").otherwise("rewritten")
    statuses = statuses.select(*key, status.alias("status"), F.when(status == "rewritten", F.col("rows")).alias("rows"))
    return clean.join(statuses.where("status = 'rewritten'").select(*key), key, "left_semi"), statuses
