"""A corpus pipeline of the training-data operators.

Each stage reads what its predecessor kept and wrote. Texts that fail the
quality rules go, then all but one of each group of near-duplicates (five-word
shingles, similarity 0.8), then documents that hold benchmark passages; personal
data in the rest is replaced by its kind, and the texts are encoded, with the
decoded bytes' digest as proof that nothing was lost.

Rows are told apart by a number of their own and not by ``doc_id``, so rows
without an id are judged like others, and of repeated rows one stays. Columns
that documents have besides pass through, whatever their names.

A stage's result reads scratch tables, which are deleted when the next stage
begins in the same thread: it has to be written by then. ``run`` does so, and
deletes those of its last stage and what stages hand on as well.
"""

from __future__ import annotations

from contextvars import ContextVar

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from emberlane.llm import bpe, decontaminate, minhash, pii, quality
from emberlane.llm.common import dropped, numbered, quoted, read, recorded, scratch

_last: ContextVar[tuple[str, ...]] = ContextVar("pipeline_scratch", default=())
ROW = "__pipeline_row"


def _stage(work):
    def stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
        dropped(spark, _last.get())
        with recorded() as paths:
            out = work(spark, docs, sf_dir)
        _last.set(tuple(paths))
        return out

    return stage


@_stage
def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    judged = quality.verdicts(quality.measured(docs, F.struct(*quoted(docs.columns))))
    return judged.where("kept").select("__keep.*")


@_stage
def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    rows = numbered(docs, ROW)
    groups = minhash.near_duplicates(rows, id_column=ROW).select(ROW, "component_id")
    # the least id of a group stays; rows without an id come last
    order = F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", ROW)
    kept = rows.select("doc_id", ROW).join(groups, ROW).groupBy("component_id").agg(F.min(order).alias("first"))
    return rows.join(kept.select(F.col("first").getField(ROW).alias(ROW)), ROW, "left_semi").select(*quoted(docs.columns))


@_stage
def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    rows = numbered(docs, ROW)
    leaks = decontaminate.find_leaks(rows, read(spark, sf_dir, "benchmark"), id_column=ROW)
    return rows.join(leaks.where("contaminated").select(ROW), ROW, "left_anti").select(*quoted(docs.columns))


@_stage
def personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    clean = pii.redacted(numbered(docs, ROW), id_column=ROW)
    n_chars = F.length("text").cast(docs.schema["n_chars"].dataType)
    return clean.withColumn("n_chars", n_chars).select(*quoted(docs.columns))


@_stage
def encoding(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    path = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
    return bpe.round_trip(docs, path, public_tokenizers.PATTERN, with_ids=True)


STAGES = [
    ("quality rules", quality_rules),
    ("near-duplicates", near_dedup),
    ("decontamination", decontamination),
    ("personal data", personal_data),
    ("encoding", encoding),
]
#: The robust estimates and the merges aren't expressible in SQL; tests hold run() against a plain version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, before = read(spark, sf_dir, "documents"), []
    for _, stage in STAGES:
        path = scratch(spark)
        stage(spark, docs, sf_dir).write.parquet(path)
        dropped(spark, before)  # what the stage read, but for the documents themselves
        docs, before = spark.read.parquet(path), [path]
    dropped(spark, _last.get())
    _last.set(())
    return docs
