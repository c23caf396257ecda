"""License scans: phrases, and an exact set-similarity join with templates.

Texts are cut into blocks of twice ``STEP`` words that begin every STEP words, so
that any run of up to STEP words lies whole in one of them. Longer templates have
blocks of their own, whose step is STEP doubled until it holds the template, and
meet those alone. A block meets a template if it holds at least ``threshold`` of the
template's distinct words. Only template words matter for that, so their
document frequencies over the whole corpus give one global order, rarest first.
A block that holds k of a template's n words holds one of the first n - k + 1 in
this order (the prefix); blocks without any template's prefix word are left out
where they are read. The others meet the prefix index in a hash join, pass the
length and position filters, and are verified on their full sets. The index has
at most a row for each template word and is broadcast only while it has at most
``BROADCAST_ROWS`` rows.

Null and empty texts have no words, no labels and score 0. Rows that share an
id share the method's labels. Every place of a phrase counts, also overlapping
ones.
"""

from __future__ import annotations

import re
from math import ceil

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import map_rows, stored

STEP = 24
BROADCAST_ROWS = 100_000
_WORD = re.compile(rb"[0-9a-z\x80-\xff]+")  # of UTF-8 text: [^\x00-\x2F\x3A-\x60\x7B-\x7F]+


def license_words(text: str | None) -> list[bytes]:
    return _WORD.findall(text.encode("utf-8", "replace").lower()) if text else []


def step_of(template: str) -> int:
    step, n = STEP, len(license_words(template))
    while step < n:
        step *= 2
    return step


def phrase_places(words: list[bytes], phrases: list[tuple[tuple[bytes, ...], str]]) -> list[tuple[int, str]]:
    """(start, label) of every place where a phrase's words stand consecutively."""
    found, have = [], None
    for phrase, label in phrases:
        have = have or set(words)
        if have.issuperset(phrase):
            at, size = -1, len(phrase)
            for _ in range(words.count(phrase[0])):
                at = words.index(phrase[0], at + 1)
                if tuple(words[at : at + size]) == phrase:
                    found.append((at, label))
    return found


def _frequencies(docs: DataFrame, vocabulary: frozenset[bytes], text_column: str) -> DataFrame:
    """(token, docs) of the template words, over all documents."""

    def each():
        return lambda text: {"tokens": [[x.decode() for x in vocabulary.intersection(license_words(t))] for t in text]}

    return map_rows(docs, "tokens array<string>", each, text_column).select(F.explode("tokens").alias("token")).groupBy("token").agg(F.count(F.lit(1)).alias("docs"))


def _index(docs: DataFrame, templates: list[tuple[str, str]], threshold: float, text_column: str) -> DataFrame:
    """(template, step, label, token, place, in_prefix, n, least): the templates' words in global order."""
    spark = docs.sparkSession
    sets = [(k, step_of(text), label, sorted({x.decode() for x in license_words(text)})) for k, (label, text) in enumerate(templates)]
    vocabulary = frozenset(x.encode() for *_, tokens in sets for x in tokens)
    rows = [(k, step, label, token, len(tokens), ceil(threshold * len(tokens) - 1e-9)) for k, step, label, tokens in sets for token in tokens]
    words = spark.createDataFrame(rows, "template int, step int, label string, token string, n int, least int")
    ordered = words.join(_frequencies(docs, vocabulary, text_column), "token", "left").withColumn("docs", F.coalesce("docs", F.lit(0)))
    place = F.row_number().over(Window.partitionBy("template").orderBy("docs", "token")) - 1
    return ordered.withColumn("place", place).withColumn("in_prefix", F.col("place") <= F.col("n") - F.col("least"))


def scan(docs: DataFrame, phrases: dict[str, str], templates: list[tuple[str, str]], threshold: float = 0.9, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """(id, n_words, n_base, first_word, last_word, base_labels, labels, score,
    n_blocks): phrase places, and labels of blocks that meet a template.
    ``phrases``: phrase to label; ``templates``: (label, text)."""
    index = stored(_index(docs, templates, threshold, text_column))
    heads = index.where("in_prefix").select("step", "token").distinct().collect()  # a few words of each template
    steps = sorted({step_of(text) for _, text in templates})
    prefixes = {step: frozenset(r.token.encode() for r in heads if r.step == step) for step in steps}
    vocabularies = {step: frozenset(x for _, text in templates if step_of(text) == step for x in license_words(text)) for step in steps}
    n_words = sum(map(len, vocabularies.values()))
    wanted = [(tuple(license_words(phrase)), label) for phrase, label in phrases.items()]

    def each():
        def one(text):
            words = license_words(text)
            places = phrase_places(words, wanted)
            blocks = []
            for step, prefix in prefixes.items():
                if prefix.isdisjoint(words):
                    continue
                for k in range(0, max(1, len(words) - step), step):
                    inside = vocabularies[step].intersection(words[k : k + 2 * step])
                    if not prefix.isdisjoint(inside):
                        blocks.append({"block": k, "step": step, "tokens": sorted(x.decode() for x in inside)})
            starts = [k for k, _ in places]
            return len(words), len(places), min(starts, default=None), max(starts, default=None), sorted({x for _, x in places}), blocks

        def work(key, text):
            n, base, first, last, labels, blocks = (list(x) for x in zip(*map(one, text))) if text else ([],) * 6
            return {id_column: key, "n_words": n, "n_base": base, "first_word": first, "last_word": last, "base": labels, "blocks": blocks}

        return work

    kind = docs.schema[id_column].dataType.simpleString()
    schema = f"`{id_column}` {kind}, n_words long, n_base long, first_word long, last_word long, base array<string>, blocks array<struct<block: int, step: int, tokens: array<string>>>"
    scanned = stored(map_rows(docs, schema, each, id_column, text_column))

    sets = index.groupBy("template", "step", "label", "n", "least").agg(F.sort_array(F.collect_list(F.struct("place", "token"))).alias("t"))
    sets = sets.withColumn("t", F.transform("t", lambda x: x["token"]))
    heads = index.where("in_prefix").select("template", "token", "place").join(sets, "template")
    if n_words * len(templates) <= BROADCAST_ROWS:
        heads = F.broadcast(heads)
    blocks = scanned.where(F.size("blocks") > 0).select(id_column, F.explode("blocks").alias("b")).select(id_column, "b.*")
    met = blocks.withColumn("token", F.explode("tokens")).join(heads, ["token", "step"]).where(F.size("tokens") >= F.col("least"))
    # words of the block that stand at or after the met one in the template: no more can be shared if it is the first
    shared = F.size(F.array_intersect("tokens", F.slice("t", F.col("place") + 1, F.col("n"))))
    met = met.where(F.col("n") - F.col("place") >= F.col("least")).withColumn("after", shared).where(F.col("after") + F.col("place") >= F.col("least"))
    verified = met.withColumn("k", F.size(F.array_intersect("tokens", "t"))).where(F.col("k") >= F.col("least"))
    by_doc = verified.groupBy(id_column).agg(F.collect_set("label").alias("met"), F.max(F.col("k") / F.col("n")).alias("best"), F.countDistinct("block", "step").alias("n_blocks"))
    met_key = by_doc.withColumnRenamed(id_column, "__id")
    joined = scanned.join(met_key, scanned[id_column].eqNullSafe(met_key["__id"]), "left")
    every = F.array_sort(F.array_union("base", F.coalesce("met", F.array().cast("array<string>"))))
    return joined.select(
        id_column, "n_words", "n_base", "first_word", "last_word",
        F.array_join("base", ",").alias("base_labels"),
        F.array_join(every, ",").alias("labels"),
        F.when(F.col("n_base") > 0, 1.0).otherwise(F.coalesce("best", F.lit(0.0))).alias("score"),
        F.coalesce("n_blocks", F.lit(0)).alias("n_blocks"),
    )
