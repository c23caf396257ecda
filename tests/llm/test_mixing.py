"""Mixing sources: targets against a plain version, draws, odd tables."""

import hashlib

import pytest
from pyspark.sql import functions as F

from emberlane.llm import mixing


def plain_targets(sizes: dict, weights=(5, 2, 1), share=1.5, cap=2.0) -> dict:
    """Water filling by rounds, over sources in order with None last."""
    order = sorted(sizes, key=lambda s: (s is None, (s or "").encode()))
    weight = {s: weights[k % len(weights)] for k, s in enumerate(order)}
    capped: set = set()
    while True:
        free = [s for s in order if s not in capped]
        if not free:
            return {s: cap * sizes[s] for s in order}
        level = (share * sum(sizes.values()) - cap * sum(sizes[s] for s in capped)) / sum(weight[s] for s in free)
        above = {s for s in free if weight[s] * level > cap * sizes[s]}
        if not above:
            return {s: cap * sizes[s] if s in capped else weight[s] * level for s in order}
        capped |= above


def table(spark, rows):
    return spark.createDataFrame(rows, "doc_id long, text string, source string")


ROWS = [(k, "w " * (1 + k * 7 % 23), "abcdefg"[k % 7] if k % 3 else "a") for k in range(700)] + [(None, "no id here", "b"), (701, None, "c"), (702, "", "empty"), (703, "one two", None), (704, "  \t ", "é")]


def test_targets_and_draws_equal_a_plain_version(spark):
    got = {r.doc_id: r for r in mixing.allotted(table(spark, ROWS)).collect()}
    sizes: dict = {}
    for _, text, source in ROWS:
        sizes[source] = sizes.get(source, 0) + len((text or "").split())
    want = plain_targets(sizes)
    for doc_id, text, source in ROWS:
        row = got[doc_id]
        assert (row.size, row.source_size) == (len((text or "").split()), sizes[source])
        assert row.target == pytest.approx(want[source], rel=1e-12)
        key = f"11:{doc_id}" if doc_id is not None else "11::" + hashlib.md5(text.encode()).hexdigest()
        u = int(hashlib.md5(key.encode()).hexdigest()[:13], 16) / 16**13
        rate = min(2.0, want[source] / sizes[source]) if sizes[source] else 0.0
        assert row.taken == row.size * (int(rate) + (u < rate - int(rate)))
        assert row.taken <= 2 * row.size
    assert sum(want.values()) == pytest.approx(1.5 * sum(sizes.values()))


def test_taken_words_come_near_the_targets_of_a_hot_source(spark):
    docs = spark.range(20000).select(F.col("id").alias("doc_id"), F.repeat(F.lit("x "), (F.col("id") % 9 + 1).cast("int")).alias("text"), F.when(F.col("id") % 3 == 0, "hot").otherwise(F.concat(F.lit("s"), (F.col("id") % 8).cast("string"))).alias("source"))
    found = mixing.allotted(docs).withColumn("s", F.col("source_size")).groupBy("source_size", "target").agg(F.sum("taken").alias("taken")).collect()
    assert len(found) >= 5
    assert all(abs(r.taken - r.target) <= 0.05 * r.target for r in found)


def test_salted_join_and_broadcast_agree(spark, monkeypatch):
    docs = table(spark, ROWS)
    want = sorted(map(tuple, mixing.allotted(docs).collect()), key=repr)
    monkeypatch.setattr(mixing, "BROADCAST_BYTES", -1)
    salted = mixing.allotted(docs)
    assert "SortMergeJoin" in salted._jdf.queryExecution().toString()
    assert sorted(map(tuple, salted.collect()), key=repr) == want


def test_emitted_rows_are_the_taken_ones_with_all_columns(spark):
    docs = table(spark, ROWS).selectExpr("*", "1 as size", "map('k', 2) as `a.b`", "'x' as __row", "3 as target", "4 as copies")
    out = mixing.emitted(docs)
    assert out.columns == docs.columns
    counts = {r.doc_id: r["count"] for r in out.groupBy("doc_id").count().collect()}
    copies = {r.doc_id: r.copies for r in mixing.allotted(docs).collect()}
    assert counts == {k: v for k, v in copies.items() if v}


def test_reruns_agree_and_repeated_rows_draw_alike(spark):
    docs = table(spark, ROWS + ROWS)
    first, again = (sorted(map(tuple, mixing.allotted(docs.repartition(n)).collect()), key=repr) for n in (1, 5))
    assert first == again
    assert first[::2] == first[1::2]


@pytest.mark.parametrize("rows", [[], [(1, None, None)], [(1, "", "a"), (2, " ", "b")]])
def test_tables_without_words(spark, rows):
    got = mixing.allotted(table(spark, rows)).collect()
    assert sorted((r.doc_id, r.size, r.source_size, r.target, r.taken) for r in got) == [(d, 0, 0, 0.0, 0) for d, _, _ in rows]


def test_all_sources_capped(spark):
    got = mixing.allotted(table(spark, [(1, "a b c", "x"), (2, "d", "y")]), share=5.0).collect()
    assert sorted((r.doc_id, r.target, r.taken) for r in got) == [(1, 6.0, 6), (2, 2.0, 2)]


def test_very_long_text(spark):
    [row] = mixing.allotted(table(spark, [(1, "word " * 300_000, "x")])).collect()
    assert (row.size, row.target) == (300_000, 450_000.0) and row.taken in (300_000, 600_000)
