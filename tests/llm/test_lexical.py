"""Ranked search against a plain version over all documents."""

import re
from collections import Counter
from math import floor, log

import pytest

from emberlane.llm import lexical

TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")


def split(text):
    return TERM.findall("".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or ""))


def plain(docs, items, top=10):
    held = [(d, Counter(split(t)), len(split(t))) for d, t in docs]
    held = [x for x in held if x[2]]
    n_docs, total = len(held), sum(n for *_, n in held)
    df = Counter(w for _, c, _ in held for w in c)
    out = []
    for item_id, text in items:
        scored = []
        for doc_id, c, n in held:
            m = 25 + (75 * n * n_docs) // total
            score = sum(floor(1000 * log((2 * n_docs + 2) / (2 * df[w] + 1))) * ((10**9 * c[w]) // (1000 * c[w] + 8 * m)) for w in split(text) if c[w])
            if score > 0:
                scored.append((-score, doc_id is None, doc_id or 0, doc_id))
        out += [(item_id, k + 1, s[3], -s[0]) for k, s in enumerate(sorted(scored)[:top])]
    return sorted(out, key=repr)


def found(spark, docs, items, **more):
    d = spark.createDataFrame(docs, "doc_id long, text string").repartition(3)
    i = spark.createDataFrame(items, "item_id long, text string")
    return sorted((tuple(r) for r in lexical.search(d, i, **more).collect()), key=repr)


WORDS = "alpha beta gamma delta straße Ünal x9 7 zeta eta theta iota kappa".split()
DOCS = [(k, " ".join(WORDS[(k * j) % len(WORDS)] + ("," if j % 3 else "") for j in range(1, 3 + k % 17))) for k in range(150)]
DOCS += [(200 + k, "Alpha BETA; gamma-delta 7") for k in range(40)]  # copies
DOCS += [(240 + k, "alpha beta gamma delta 7") for k in range(25)]  # other texts, the same bag
DOCS += [(None, "alpha beta gamma delta 7"), (300, None), (301, ""), (302, "--- !!"), (303, "nothing of it here"), (5, DOCS[5][1]), (304, "theta " * 50_000)]
ITEMS = [(1, "Alpha, beta? gamma!"), (2, "theta theta iota"), (3, "straße ünal Ünal X9"), (4, None), (5, ""), (6, "unheard of words"), (7, "7"), (1, "kappa zeta"), (None, "delta")]


def test_equals_a_plain_version(spark):
    got, want = found(spark, DOCS, ITEMS), plain(DOCS, ITEMS)
    assert got == want and len(want) > 40


def test_blocks_of_items_agree(spark, monkeypatch):
    want = found(spark, DOCS, ITEMS)
    monkeypatch.setattr(lexical, "BLOCK_BYTES", 600)
    assert found(spark, DOCS, ITEMS) == want


def test_small_runs_and_other_tops(spark, monkeypatch):
    monkeypatch.setattr(lexical, "RUN", 3)
    assert found(spark, DOCS, ITEMS, top=3) == plain(DOCS, ITEMS, 3)


@pytest.mark.parametrize("docs,items", [([], ITEMS), (DOCS, []), ([(1, None)], ITEMS), ([(1, "alpha")], [(1, None)])])
def test_empty_tables(spark, docs, items):
    assert found(spark, docs, items) == plain(docs, items)


def test_clashing_columns(spark):
    d = spark.createDataFrame(DOCS[:30], "doc_id long, text string").selectExpr("*", "1 as n", "map('a', 1) as bag", "2 as item_id", "3 as `a.b`", "4 as class")
    i = spark.createDataFrame(ITEMS[:3], "item_id long, text string").selectExpr("*", "9 as doc_id", "1 as block", "map('r', 1) as row")
    assert sorted((tuple(r) for r in lexical.search(d, i).collect()), key=repr) == plain(DOCS[:30], ITEMS[:3])


def test_a_class_is_scored_once(spark, monkeypatch):
    """All 40 copies and 26 texts with their bag make one class."""
    sizes = []
    best = lexical._best
    monkeypatch.setattr(lexical, "_best", lambda classes, *a: (sizes.append(classes.count()), best(classes, *a))[1])
    found(spark, [d for d in DOCS if d[0] is None or 200 <= d[0] < 300], ITEMS[:1])
    assert sizes == [1]
