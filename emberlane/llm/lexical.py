"""Ranked lexical search with bag deduplication.

Items (queries) are taken in blocks of bounded vocabulary. For a block, each
document shrinks to its bag: the counts of the block's terms in it, and m, which
stands for its length. Documents with equal bags and equal m score alike for
every item, so such a class is scored once; tasks keep the ten best classes for
each item, and the winners' members follow by ascending id.

Defined results: a document without terms (null, empty, marks only) is never
ranked and counts in no statistic; an item without terms, or whose terms no
document holds, has no rows. Rows with a null id count like others and come last
among equal scores; repeated rows are documents of their own, and repeated items
are ranked each for itself. Other columns are ignored, whatever their names.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from math import floor, log

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import map_rows, numbered, stored

TOP = 10
#: Bytes of item text in a block of items, about, with so many bytes besides for each item.
BLOCK_BYTES, ITEM_BYTES = 4 << 20, 256
#: Classes that a task scores at once.
RUN = 2048
_LAST = np.iinfo(np.int64).max
_TABLE = bytes(c + 32 if 65 <= c <= 90 else c if 48 <= c <= 57 or 97 <= c <= 122 or c >= 128 else 32 for c in range(256))


def terms(text: str | None) -> list[bytes]:
    """Maximal runs of ASCII letters, digits and everything beyond ASCII; A-Z lower-cased."""
    return text.encode("utf-8", "replace").translate(_TABLE).split() if text else []


def _item_blocks(items: DataFrame) -> tuple[DataFrame, int]:
    """Items with a ``block``, and the number of blocks. There are twice as many
    until none has more than twice the limit; an item is never split."""
    rows = numbered(items.select("item_id", F.coalesce("text", F.lit("")).alias("text")), "row")
    size = F.octet_length("text") + ITEM_BYTES
    total, longest = rows.agg(F.coalesce(F.sum(size), F.lit(0)), F.coalesce(F.max(size), F.lit(0))).first()
    limit, blocks = max(BLOCK_BYTES, longest), max(1, -(-total // BLOCK_BYTES))
    while True:
        block = F.pmod(F.xxhash64("row"), F.lit(blocks)).cast("int")
        largest = rows.groupBy(block.alias("block")).agg(F.sum(size).alias("size")).agg(F.max("size")).first()[0] or 0
        if largest <= 2 * limit:
            return rows.withColumn("block", block), blocks
        blocks *= 2


def _bags(docs: DataFrame, vocabulary) -> DataFrame:
    """(doc_id, n, bag): terms with repeats, and the block's terms among them as
    packed pairs (place, count) by place. Null for a bag without such terms."""

    def each():
        places = vocabulary.value

        def work(ids: list, texts: list) -> dict:
            sizes, bags = [], []
            for text in texts:
                found = terms(text)
                sizes.append(len(found))
                held = sorted((at, tf) for word, tf in Counter(found).items() if (at := places.get(word)) is not None)
                bags.append(np.array(held, "<i4").tobytes() if held else None)
            return {"doc_id": ids, "n": sizes, "bag": bags}

        return work

    id_type = docs.schema["doc_id"].dataType.simpleString()
    return map_rows(docs, f"doc_id {id_type}, n long, bag binary", each, "doc_id", "text")


def _document_counts(bags: DataFrame, size: int) -> np.ndarray:
    """For each term of the block, how many documents hold it: one packed row of counts a task."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = np.zeros(size, "<i8")
        for batch in batches:
            held = b"".join(b for b in batch.column(0).to_pylist() if b is not None)
            counts += np.bincount(np.frombuffer(held, "<i4")[::2], minlength=size)
        at = np.flatnonzero(counts)
        yield pa.RecordBatch.from_arrays([pa.array(at, pa.int32()), pa.array(counts[at], pa.int64())], names=["at", "df"])

    df = np.zeros(size, np.int64)
    for row in bags.select("bag").mapInArrow(run, "at int, df long").groupBy("at").agg(F.sum("df").alias("df")).collect():
        df[row.at] = row.df
    return df


def _best(classes: DataFrame, queries, top: int) -> DataFrame:
    """(item, class, score, first): for each item the ``top`` best classes of each task,
    equal scores by the least id of a class. ``queries`` holds term weights and,
    for each item, the places of its terms with their repeats."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        weights, items = queries.value
        best = [np.zeros((0, 3), np.int64) for _ in items]  # score, first, class

        def score(rows: list[tuple[int, int, int, bytes]]) -> None:
            m = np.array([r[2] for r in rows], np.int64)
            lengths = [len(r[3]) // 8 for r in rows]
            pairs = np.frombuffer(b"".join(r[3] for r in rows), "<i4").reshape(-1, 2).astype(np.int64)
            row = np.repeat(np.arange(len(rows)), lengths)
            worth = weights[pairs[:, 0]] * ((1_000_000_000 * pairs[:, 1]) // (1000 * pairs[:, 1] + 8 * m[row]))
            order = np.argsort(pairs[:, 0], kind="stable")
            row, worth = row[order], worth[order]
            starts = np.searchsorted(pairs[order, 0], np.arange(len(weights) + 1))
            ids = np.array([(r[1], r[0]) for r in rows], np.int64)
            for k, (places, repeats) in enumerate(items):
                total = np.zeros(len(rows), np.int64)
                for at, times in zip(places, repeats):
                    a, b = starts[at], starts[at + 1]
                    total[row[a:b]] += times * worth[a:b]  # a class holds a term once
                bar = best[k][-1, 0] if len(best[k]) == top else 1
                found = np.flatnonzero(total >= max(bar, 1))
                if len(found):
                    both = np.concatenate([best[k], np.column_stack([total[found], ids[found]])])
                    best[k] = both[np.lexsort((both[:, 2], both[:, 1], -both[:, 0]))[:top]]

        for batch in batches:
            rows = list(zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2).to_pylist(), batch.column(3).to_pylist()))
            for i in range(0, len(rows), RUN):
                score(rows[i : i + RUN])
        for k, rows in enumerate(best):
            if len(rows):
                made = [np.full(len(rows), k), rows[:, 2], rows[:, 0], rows[:, 1]]
                yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(made, (pa.int32(), pa.int64(), pa.int64(), pa.int64()))], names=["item", "class", "score", "first"])

    return classes.select("class", "first", "m", "bag").mapInArrow(run, "item int, class long, score long, first long")


def _block(docs: DataFrame, items: DataFrame, top: int) -> DataFrame:
    spark = docs.sparkSession
    listed = [(row.item_id, Counter(terms(row.text))) for row in items.collect()]  # a block of bounded text
    listed = [(item_id, held) for item_id, held in listed if held]
    places = {word: at for at, word in enumerate(sorted({w for _, held in listed for w in held}))}
    bags = stored(_bags(docs, spark.sparkContext.broadcast(places)))
    n_docs, n_terms = bags.agg(F.count_if(F.col("n") > 0), F.coalesce(F.sum("n"), F.lit(0))).first()
    df = _document_counts(bags, len(places))
    weights = np.array([floor(1000 * log((2 * n_docs + 2) / (2 * int(d) + 1))) for d in df], np.int64)
    queries = spark.sparkContext.broadcast((weights, [([places[w] for w in held], list(held.values())) for _, held in listed]))

    m = F.expr(f"25 + (75 * n * {n_docs}L) div {max(1, n_terms)}L")
    known = bags.where("bag is not null").select("doc_id", "n", "bag", m.alias("m")).withColumn("hash", F.xxhash64("m", "bag"))
    # the hash deals the rows; m and the whole bag in the key verify it
    number = F.coalesce(F.min("doc_id").cast("long"), F.lit(_LAST))
    classes = stored(known.groupBy("hash", "m", "bag").agg(number.alias("first")).withColumn("class", F.monotonically_increasing_id()))
    best = Window.partitionBy("item").orderBy(F.desc("score"), "first", "class")
    hits = stored(_best(classes, queries, top).withColumn("place", F.row_number().over(best)).where(F.col("place") <= top).select("item", "class", "score"))

    # the classes of the hits: at most ``top`` for each item of the block
    won = stored(classes.join(F.broadcast(hits.select("class").distinct()), "class", "left_semi"))
    near = known.join(F.broadcast(won.select("hash").distinct()), "hash", "left_semi")
    first = Window.partitionBy("hash", "m", "bag").orderBy(F.col("doc_id").asc_nulls_last())
    members = near.select("doc_id", "hash", "m", "bag").withColumn("nth", F.row_number().over(first)).where(F.col("nth") <= top)
    members = members.join(won, ["hash", "m", "bag"]).select("class", "doc_id", "nth")
    order = Window.partitionBy("item").orderBy(F.desc("score"), F.col("doc_id").asc_nulls_last(), "class", "nth")
    ranked = members.join(hits, "class").withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= top)
    names = spark.createDataFrame(
        [(k, item_id) for k, (item_id, _) in enumerate(listed)], spark.createDataFrame([], "item int").schema.add("item_id", items.schema["item_id"].dataType)
    )
    return ranked.join(F.broadcast(names), "item").select("item_id", "rank", "doc_id", "score")


def search(docs: DataFrame, items: DataFrame, top: int = TOP) -> DataFrame:
    """(item_id, rank, doc_id, score): the ``top`` best documents of
    (doc_id, text) for each item of (item_id, text), scores above 0 only."""
    rows, blocks = _item_blocks(items)
    out = None
    for block in range(blocks):
        part = stored(_block(docs, rows.where(F.col("block") == block), top))
        out = part if out is None else out.unionByName(part)
    return out
