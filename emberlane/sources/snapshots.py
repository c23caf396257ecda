"""Tables whose readers see whole versions only.

A table is a folder with data folders and a log of numbered manifests. A write
puts its rows into a new data folder, which no reader knows, and then commits by
renaming a manifest to the next number; a rename that finds the number taken
fails, so of two writers at once one has to begin again. Readers take the manifest
with the highest number and read the folders that it lists. A write that dies in
between leaves a folder that no manifest names; ``vacuum`` removes such folders
and those of old versions.
"""

from __future__ import annotations

import json
import time
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.quality import keep_last, upsert

LOG = "_versions"


class Conflict(RuntimeError):
    """Another writer has committed this version."""


def _store(spark: SparkSession, path: str):
    place = spark._jvm.org.apache.hadoop.fs.Path
    return place(path).getFileSystem(spark._jsc.hadoopConfiguration()), place


def versions(spark: SparkSession, path: str) -> list[int]:
    files, place = _store(spark, path)
    log = place(f"{path}/{LOG}")
    if not files.exists(log):
        return []
    names = [s.getPath().getName() for s in files.listStatus(log)]
    return sorted(int(n.removesuffix(".json")) for n in names if n.endswith(".json"))


def manifest(spark: SparkSession, path: str, version: int | None = None) -> dict:
    """The manifest of a version, or of the latest; an empty one where there is none."""
    known = versions(spark, path)
    if not known:
        return {"version": 0, "folders": [], "slices": []}
    files, place = _store(spark, path)
    stream = files.open(place(f"{path}/{LOG}/{(version or known[-1]):012d}.json"))
    try:
        text = spark._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
    finally:
        stream.close()
    return json.loads(text)


def read(spark: SparkSession, path: str, version: int | None = None) -> DataFrame | None:
    """The rows of a version, or of the latest; None where nothing was committed."""
    folders = manifest(spark, path, version)["folders"]
    return spark.read.option("mergeSchema", "true").parquet(*(f"{path}/{f}" for f in folders)) if folders else None


def stage(df: DataFrame, path: str, *partition_by: str) -> str:
    """Writes rows into a new data folder and returns its name; no reader sees it yet."""
    folder = f"data-{uuid.uuid4().hex}"
    df.write.partitionBy(*partition_by).parquet(f"{path.rstrip('/')}/{folder}")
    return folder


def commit(spark: SparkSession, path: str, base: dict, folders: list[str], slices: list[str] | None = None) -> int:
    """Makes ``folders`` the table, if nothing was committed after ``base``."""
    files, place = _store(spark, path)
    version = base["version"] + 1
    told = {"version": version, "folders": folders, "slices": base["slices"] if slices is None else slices, "time": int(time.time())}
    log = f"{path.rstrip('/')}/{LOG}"
    files.mkdirs(place(log))
    draft = place(f"{log}/.{uuid.uuid4().hex}")
    stream = files.create(draft, False)
    stream.write(bytearray(json.dumps(told).encode()))
    stream.close()
    target = place(f"{log}/{version:012d}.json")
    # FileContext's rename never replaces a file that is there
    context = spark._jvm.org.apache.hadoop.fs.FileContext.getFileContext(draft.toUri() if draft.toUri().getScheme() else files.getUri(), spark._jsc.hadoopConfiguration())
    none = spark.sparkContext._gateway.new_array(spark._jvm.org.apache.hadoop.fs.Options.Rename, 0)
    try:
        context.rename(files.makeQualified(draft), files.makeQualified(target), none)
    except Exception as error:
        files.delete(draft, False)
        if version in versions(spark, path):
            raise Conflict(f"version {version} of {path} is taken") from error
        raise
    return version


def save(incoming: DataFrame, path: str, keys: list[str], *partition_by: str, attempts: int = 3) -> int:
    """Upserts rows by ``keys`` (of equal ones the incoming stay, of those the last by
    column ``seq`` if there is one) and commits the merged table as a new version."""
    spark = incoming.sparkSession
    if "seq" in incoming.columns:
        incoming = keep_last(incoming, keys, F.col("seq")).drop("seq")
    for attempt in range(attempts):
        base = manifest(spark, path)
        existing = read(spark, path)
        merged = incoming if existing is None else _aligned(existing, incoming, keys)
        folder = stage(merged, path, *partition_by)
        try:
            return commit(spark, path, base, [folder])
        except Conflict:
            if attempt == attempts - 1:
                raise
    raise AssertionError


def _aligned(existing: DataFrame, incoming: DataFrame, keys: list[str]) -> DataFrame:
    names = list(dict.fromkeys([*existing.columns, *incoming.columns]))
    kinds = {f.name: f.dataType for df in (existing, incoming) for f in df.schema}
    whole = lambda df: df.select(*(F.col(n) if n in df.columns else F.lit(None).cast(kinds[n]).alias(n) for n in names))
    return upsert(whole(existing), whole(incoming), keys)


def land_slices(spark: SparkSession, path: str, slices: list[tuple[str, str]], keys: list[str]) -> list[str]:
    """Lands slices of a fetch, (name, Parquet path) in their order, each once.

    Slices that the manifest lists are not read again. Slices overlap at their
    ends: of rows with equal keys that of the earliest slice stays, so what is
    landed never changes, and new rows are those that no landed one has the keys
    of. Rows and the list of slices are committed together. Returns the names of
    the slices that were new.
    """
    base = manifest(spark, path)
    landed = set(base["slices"])
    new = [(name, place) for name, place in dict(reversed(slices)).items()][::-1]
    new = [(name, place) for name, place in new if name not in landed]
    if not new:
        return []
    both = None
    for k, (_, place) in enumerate(new):
        part = spark.read.parquet(place).withColumn("__slice", F.lit(-k))
        both = part if both is None else both.unionByName(part, allowMissingColumns=True)
    first = keep_last(both, keys, F.col("__slice")).drop("__slice")
    existing = read(spark, path)
    if existing is not None:
        first = first.join(existing.select(*keys), keys, "left_anti")
    folder = stage(first, path)
    commit(spark, path, base, [*base["folders"], folder], [*base["slices"], *(name for name, _ in new)])
    return [name for name, _ in new]


def vacuum(spark: SparkSession, path: str, keep: int = 2, older_than_s: int = 86_400) -> list[str]:
    """Deletes manifests before the last ``keep`` and data folders that none of the
    kept ones lists and that are older than ``older_than_s``, so that neither readers
    of a recent version nor writers at work lose anything."""
    files, place = _store(spark, path)
    known = versions(spark, path)
    used = {f for v in known[-keep:] for f in manifest(spark, path, v)["folders"]}
    gone = []
    for status in files.listStatus(place(path)):
        name = status.getPath().getName()
        if name.startswith("data-") and name not in used and time.time() - status.getModificationTime() / 1000 >= older_than_s:
            files.delete(status.getPath(), True)
            gone.append(name)
    for v in known[:-keep]:
        files.delete(place(f"{path}/{LOG}/{v:012d}.json"), False)
    return gone
