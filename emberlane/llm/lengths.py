"""Token counts: the exact histogram of encoded lengths and its suffix sums.

Documents are aggregated by encoded length before anything is summed up, so
only (length, documents) pairs meet in a shuffle. Suffix sums go over blocks of
``BLOCK`` neighbouring lengths: within a block by a window, between blocks by
the blocks' own totals, so that no task sorts all lengths.

Null and empty texts have length 0 and count as documents.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .bpe import codec_for, load_ranks
from .common import map_rows, stored

BLOCK = 1024


def encoded_lengths(docs: DataFrame, path: str, pattern: str, text_column: str = "text") -> DataFrame:
    """One row a document: n_tokens."""
    ranks = docs.sparkSession.sparkContext.broadcast(load_ranks(path))

    def each():
        codec = codec_for(ranks, pattern)
        return lambda text: {"n_tokens": codec.count(text)}

    return map_rows(docs, "n_tokens long", each, text_column)


def length_histogram(lengths: DataFrame, column: str = "n_tokens") -> DataFrame:
    """For each length that occurs, as a context limit L:

    n_docs of exactly this length; docs_at_least and tokens_at_least (length L
    or more); docs_over (longer than L: cut by the limit); total_tokens within
    documents no longer than L plus L of each longer one (truncated_total);
    lost_tokens; and quantile, the share of documents no longer than L.
    """
    counts = lengths.groupBy(F.col(column).alias("context_limit")).agg(F.count(F.lit(1)).alias("n_docs"))
    counts = counts.withColumns({"block": F.floor(F.col("context_limit") / BLOCK), "n_tokens": F.col("context_limit") * F.col("n_docs")})
    counts = stored(counts)  # read twice below; the texts are encoded once
    blocks = counts.groupBy("block").agg(F.sum("n_docs").alias("block_docs"), F.sum("n_tokens").alias("block_tokens"))
    above = Window.orderBy(F.desc("block")).rowsBetween(Window.unboundedPreceding, -1)
    every = Window.orderBy(F.desc("block")).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    blocks = blocks.select(
        "block",
        F.coalesce(F.sum("block_docs").over(above), F.lit(0)).alias("docs_above"),
        F.coalesce(F.sum("block_tokens").over(above), F.lit(0)).alias("tokens_above"),
        F.sum("block_docs").over(every).alias("all_docs"),
        F.sum("block_tokens").over(every).alias("all_tokens"),
    )
    within = Window.partitionBy("block").orderBy(F.desc("context_limit")).rowsBetween(Window.unboundedPreceding, 0)
    summed = counts.join(blocks, "block").withColumns(
        {
            "docs_at_least": F.sum("n_docs").over(within) + F.col("docs_above"),
            "tokens_at_least": F.sum("n_tokens").over(within) + F.col("tokens_above"),
        }
    )
    over = F.col("docs_at_least") - F.col("n_docs")
    kept = F.col("all_tokens") - F.col("tokens_at_least") + F.col("context_limit") * F.col("docs_at_least")
    return summed.select(
        "context_limit",
        "n_docs",
        "docs_at_least",
        "tokens_at_least",
        over.alias("docs_over"),
        kept.alias("truncated_total"),
        (F.col("all_tokens") - kept).alias("lost_tokens"),
        ((F.col("all_docs") - over) / F.col("all_docs")).alias("quantile"),
    )


def answer_limits(histogram: DataFrame, limits: list[int]) -> DataFrame:
    """Totals for any ``limits``, whether or not a document of that length
    exists: (context_limit, docs_at_least, truncated_total). Each is read from the
    smallest length at or above it, in one aggregate over the histogram; an empty
    histogram answers nothing."""
    asked = histogram.withColumn("asked", F.explode(F.array(*(F.lit(x).cast("long") for x in sorted(set(limits))))))
    above = F.col("context_limit") >= F.col("asked")
    first = F.min_by(F.when(above, F.struct("docs_at_least", "truncated_total", "context_limit")), F.when(above, F.col("context_limit")))
    found = asked.groupBy("asked").agg(first.alias("at"), F.max_by("truncated_total", "context_limit").alias("everything"))
    cut = F.col("at.truncated_total") - (F.col("at.context_limit") - F.col("asked")) * F.col("at.docs_at_least")
    return found.select(
        F.col("asked").alias("context_limit"),
        F.coalesce("at.docs_at_least", F.lit(0)).alias("docs_at_least"),
        F.coalesce(cut, "everything").alias("truncated_total"),
    )
