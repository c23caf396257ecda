"""Mixing sources to target weights, with DataFrame functions only.

Sizes are summed for each source, targets follow from the sources' weights, and
a document is emitted floor(rate) times, and once more if a hash of its id falls
below the rest of the rate.

Defined results: a null text has size 0; a null source is a source of its own
and comes last; a source of size 0 has target 0 and nothing is taken of it; an
empty table gives an empty table. The draw depends on the seed and ``doc_id``
(on the text where that is null), so equal rows draw alike and reruns agree.
Documents are judged by the named columns alone, so other columns may have any
name; ``emitted`` returns all of them.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import quoted, stored

WORD = r"[^\x20\x09-\x0D]+"
#: Weights of the sources in order, repeating; their share of all sizes; the most that is taken of a size.
WEIGHTS, SHARE, CAP = (5, 2, 1), 1.5, 2.0
#: Bytes of the table of targets up to which it is broadcast; beyond, both sides are shuffled by source and salt.
BROADCAST_BYTES = 8 << 20
SALTS = 64
#: Hexadecimal digits of the hash that a draw uses (52 bits).
DIGITS = 13


def size_of(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def draw(seed: int, doc_id: Column, text: Column) -> Column:
    """A number in [0, 1) of the id, or of the text where that is null."""
    key = F.concat(F.lit(f"{seed}:"), F.coalesce(doc_id.cast("string"), F.concat(F.lit(":"), F.md5(F.coalesce(text, F.lit(""))))))
    return F.conv(F.substring(F.md5(key), 1, DIGITS), 16, 10).cast("long") / float(16**DIGITS)


def _weighted(sums: DataFrame, weights: Sequence[int]) -> DataFrame:
    """Adds ``weight`` by the place of a source among all. Places are counted
    inside range partitions and shifted by the partitions before, so no task
    holds all sources."""
    parts = max(1, int(sums.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    order = F.col("source").asc_nulls_last()
    placed = stored(
        sums.repartitionByRange(parts, order).sortWithinPartitions(order)
        .withColumns({"part": F.spark_partition_id(), "at": F.monotonically_increasing_id().bitwiseAND((1 << 33) - 1)})
    )
    before = F.sum("n").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1))  # a row for each part
    offsets = placed.groupBy("part").agg(F.count(F.lit(1)).alias("n")).select("part", F.coalesce(before, F.lit(0)).alias("before"))
    nth = (F.col("at") + F.col("before")) % len(weights)
    return placed.join(F.broadcast(offsets), "part").select("source", "source_size", F.element_at(F.array(*map(F.lit, weights)), nth.cast("int") + 1).alias("weight"))


def targets(sums: DataFrame, weights: Sequence[int] = WEIGHTS, share: float = SHARE, cap: float = CAP) -> DataFrame:
    """(source, source_size, target) of (source, source_size).

    ``share`` times all sizes is split by weight; a target above ``cap`` times
    its source's size stops there, and what it leaves is shared by the others,
    until none is above. Each round sums one row; only the last row of sums
    reaches the driver.
    """
    rows = stored(_weighted(sums, weights))
    total = rows.agg(F.coalesce(F.sum("source_size"), F.lit(0))).first()[0]
    most = cap * F.col("source_size")
    level, capped = None, -1
    while True:
        above = F.lit(False) if level is None else F.col("weight") * level > most
        n, taken, weight = rows.agg(
            F.count_if(above), F.coalesce(F.sum(F.when(above, F.col("source_size"))), F.lit(0)), F.coalesce(F.sum(F.when(~above, F.col("weight"))), F.lit(0))
        ).first()
        if n == capped:
            break
        capped = n
        if not weight:
            return rows.select("source", "source_size", most.alias("target"))
        level = (share * total - cap * taken) / weight
    return rows.select("source", "source_size", F.when(above, most).otherwise(F.col("weight") * level).alias("target"))


def _met(docs: DataFrame, found: DataFrame, salt_by: Column) -> DataFrame:
    """Documents with their source's size and target. The table of targets is
    broadcast where its bytes are few; else the sources are met in salted copies,
    as one of them may hold a third of all documents."""
    bytes_ = found.agg(F.sum(F.coalesce(F.octet_length("source"), F.lit(0)) + 64)).first()[0] or 0
    renamed = found.withColumnsRenamed({"source": "__mix_s", "source_size": "__mix_ss", "target": "__mix_t"})
    if bytes_ <= BROADCAST_BYTES:
        return docs.join(F.broadcast(renamed), F.col("__mix_source").eqNullSafe(F.col("__mix_s")))
    salted = renamed.withColumn("__mix_k", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    return docs.withColumn("__mix_salt", F.pmod(F.xxhash64(salt_by), F.lit(SALTS)).cast("int")).join(
        salted.hint("merge"), F.col("__mix_source").eqNullSafe(F.col("__mix_s")) & (F.col("__mix_salt") == F.col("__mix_k"))
    )


def _allotted(docs: DataFrame, keep: Column | None, weights: Sequence[int], share: float, cap: float, seed: int) -> DataFrame:
    doc_id, text = F.col("doc_id"), F.col("text")
    picked = docs.select(
        doc_id.alias("__mix_id"), F.col("source").alias("__mix_source"), size_of(text).alias("__mix_size"), draw(seed, doc_id, text).alias("__mix_u"), *([keep.alias("__mix_row")] if keep is not None else [])
    )
    sized = stored(picked.drop("__mix_row"))  # words are counted once; the texts aren't copied
    sums = stored(sized.groupBy(F.col("__mix_source").alias("source")).agg(F.sum("__mix_size").alias("source_size")))
    found = stored(targets(sums, weights, share, cap))
    met = _met(sized if keep is None else picked, found, F.col("__mix_u"))
    rate = F.least(F.lit(cap), F.coalesce(F.try_divide("__mix_t", F.col("__mix_ss").cast("double")), F.lit(0.0)))
    whole = F.floor(rate)
    copies = whole + F.when(F.col("__mix_u") < rate - whole, 1).otherwise(0)
    return met.withColumn("__mix_copies", copies.cast("long"))


def allotted(docs: DataFrame, weights: Sequence[int] = WEIGHTS, share: float = SHARE, cap: float = CAP, seed: int = 11) -> DataFrame:
    """(doc_id, size, source_size, target, copies, taken), one row a document of
    (doc_id, text, source). ``taken`` is the words that the mix takes of it."""
    rows = _allotted(docs, None, weights, share, cap, seed)
    return rows.select(
        F.col("__mix_id").alias("doc_id"), F.col("__mix_size").alias("size"), F.col("__mix_ss").alias("source_size"), F.col("__mix_t").alias("target"),
        F.col("__mix_copies").alias("copies"), (F.col("__mix_copies") * F.col("__mix_size")).alias("taken"),
    )


def emitted(docs: DataFrame, weights: Sequence[int] = WEIGHTS, share: float = SHARE, cap: float = CAP, seed: int = 11) -> DataFrame:
    """The mix itself: the documents' rows with all their columns, as often as they are taken."""
    rows = _allotted(docs, F.struct(*quoted(docs.columns)), weights, share, cap, seed).where("__mix_copies > 0")
    return rows.select("__mix_row", F.explode(F.sequence(F.lit(1), F.col("__mix_copies").cast("int")))).select("__mix_row.*")
