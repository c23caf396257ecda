"""Readers and writers of telemetry rows (series_id, source, sec, value)."""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.meters import epoch_seconds
from ..operators.quality import keep_last, upsert


def normalised(rows: DataFrame, stamp: str = "timestamp", value: str = "value") -> DataFrame:
    """(series_id, sec, value): ISO 8601 stamps of any offset (none: UTC), finite
    numbers, the last row of a stamp."""
    text = F.col(stamp).cast("string")
    zoned = F.when(text.rlike(r"(Z|[+-]\d\d:?\d\d)$"), text).otherwise(F.concat(text, F.lit("Z")))
    number = F.col(value).cast("string").try_cast("double")
    picked = rows.select("series_id", F.unix_timestamp(F.try_to_timestamp(zoned)).alias("sec"), number.alias("value"), F.monotonically_increasing_id().alias("seq"))
    finite = picked.where(F.col("sec").isNotNull() & F.col("value").isNotNull() & ~F.isnan("value") & (F.abs("value") < float("inf")))
    return keep_last(finite, ["series_id", "sec"], F.col("seq")).drop("seq")


def _absent(error: AnalysisException) -> bool:
    return error.getCondition() == "PATH_NOT_FOUND"


def read_csv_cache(spark: SparkSession, path: str, series_id: str) -> DataFrame | None:
    """The rows of one series' file, which has a stamp and a value column; None without it."""
    try:
        rows = spark.read.schema("timestamp string, value string").csv(path, header=True)
    except AnalysisException as error:
        if _absent(error):
            return None
        raise
    return normalised(rows.withColumn("series_id", F.lit(series_id)))


def read_sidecar(spark: SparkSession, path: str) -> dict:
    """The fields of a JSON file of cache metadata; none if it is absent or no JSON object."""
    try:
        rows = spark.read.option("mode", "PERMISSIVE").option("multiLine", True).json(path)
        first = rows.drop("_corrupt_record").first() if set(rows.columns) - {"_corrupt_record"} else None
    except AnalysisException as error:
        if _absent(error):
            return {}
        raise
    return {k: v for k, v in first.asDict(True).items() if v is not None} if first else {}


def read_chunks(spark: SparkSession, paths: list[str], key: list[str]) -> DataFrame:
    """Parquet slices of a fetch as one table. Slices overlap at their ends: of
    rows with one key that of the earliest slice stays (see also
    ``snapshots.land_slices``, which reads each slice once)."""
    parts = [spark.read.parquet(path).withColumn("__slice", F.lit(-k)) for k, path in enumerate(paths)]
    both = parts[0]
    for part in parts[1:]:
        both = both.unionByName(part, allowMissingColumns=True)
    return keep_last(both, key, F.col("__slice")).drop("__slice")


def wanted_ids(config: DataFrame) -> DataFrame:
    """(role, series_id) of configuration rows (role, series_ids array); empty
    ids and those left to fill in go."""
    rows = config.select("role", F.explode("series_ids").alias("series_id"))
    return rows.where("series_id is not null and series_id not in ('', 'FILL_ME_IN')").distinct()


def available_sources(cache: DataFrame) -> DataFrame:
    """(series_id, sources): the sources of each series, by name."""
    return cache.groupBy("series_id").agg(F.array_sort(F.collect_set("source")).alias("sources"))


def read_states(states: DataFrame) -> DataFrame:
    """History rows (entity_id, state, last_changed, last_updated); states that
    aren't numbers go, the first row of a stamp stays."""
    stamp = F.coalesce("last_changed", "last_updated")
    rows = states.select(F.col("entity_id").alias("series_id"), F.unix_timestamp(F.try_to_timestamp(stamp.cast("string"))).alias("sec"), F.col("state").try_cast("double").alias("value"), F.monotonically_increasing_id().alias("seq"))
    rows = rows.where("sec is not null and value is not null and not isnan(value)")
    return keep_last(rows, ["series_id", "sec"], -F.col("seq")).drop("seq")


def read_statistics(rows: DataFrame) -> DataFrame:
    """Statistics (series_id, start, mean, sum): a series whose first row has a
    sum is a meter, else a measurement."""
    rows = rows.withColumn("seq", F.monotonically_increasing_id())
    first = rows.groupBy("series_id").agg(F.min_by(F.col("sum").isNotNull(), "start").alias("meter"))
    typed = rows.join(first, "series_id").select("series_id", "seq", epoch_seconds(F.col("start")).alias("sec"), F.when(F.col("meter"), F.col("sum")).otherwise(F.col("mean")).alias("value"))
    known = typed.where("value is not null and not isnan(value)")
    return keep_last(known, ["series_id", "sec"], -F.col("seq")).drop("seq")  # the first row of a stamp


def cache_metadata(rows: DataFrame) -> DataFrame:
    return rows.groupBy("series_id", "source").agg(F.count(F.lit(1)).alias("rows"), F.min("sec").alias("start"), F.max("sec").alias("end"))


def save(incoming: DataFrame, path: str, kind: str | None = None) -> None:
    """Upserts into a Parquet cache partitioned by source; of rows with one
    series, source and stamp the last stays, by column ``seq`` or else in the
    order they arrive. ``kind`` (cumulative or measurement) is kept with the rows.

    The merged rows are written beside the cache first, then replace the
    partitions that changed, each as a whole. A run that fails in between leaves
    the copy beside; running it again changes nothing else.
    """
    spark = incoming.sparkSession
    if kind is not None:
        incoming = incoming.withColumn("kind", F.lit(kind))
    order = F.col("seq") if "seq" in incoming.columns else F.monotonically_increasing_id()
    incoming = keep_last(incoming.withColumn("__at", order), ["series_id", "source", "sec"], F.col("__at")).drop("__at", "seq")
    try:
        existing = spark.read.parquet(path)
    except AnalysisException as error:
        if not _absent(error):
            raise
        incoming.write.partitionBy("source").parquet(path)
        return
    for name in set(incoming.columns) - set(existing.columns):
        existing = existing.withColumn(name, F.lit(None).cast(incoming.schema[name].dataType))
    for name in set(existing.columns) - set(incoming.columns):
        incoming = incoming.withColumn(name, F.lit(None).cast(existing.schema[name].dataType))
    touched = existing.join(incoming.select("source").distinct(), "source", "left_semi").select(incoming.columns)
    merged = upsert(touched, incoming, ["series_id", "source", "sec"])
    beside = f"{path.rstrip('/')}__incoming"
    merged.write.mode("overwrite").partitionBy("source").parquet(beside)
    spark.read.parquet(beside).select(incoming.columns).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("source").parquet(path)
