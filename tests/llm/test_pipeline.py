"""run() against a plain version on a small corpus."""

import hashlib
import random
import re

import tiktoken

import corpus_pipeline
from emberlane.llm import bpe, queries
from .test_operators import LOREM, plain_components, plain_counts

ITEM = "every second autumn the ferry to the northern island leaves before dawn and returns with forty barrels of salt"


def texts():
    draw = random.Random(11)
    prose = lambda n: " ".join(draw.choice(LOREM) + str(draw.randrange(10, 99)) for _ in range(n))
    clean = [prose(70 + draw.randrange(60)) for _ in range(160)]
    near = clean[0].split()
    rows = list(clean)
    rows += [clean[0], " ".join(near[:30] + ["changed"] + near[31:]), clean[5].upper()]
    rows += [prose(20), None, "", "again and again " * 40]
    rows += ["\n".join(f"{w}%%% ***" for w in prose(90).split()) for _ in range(8)]
    rows += [f"{prose(60)} {ITEM} {prose(30)}", f"{prose(80)} {ITEM.upper()}"]
    rows += [f"{prose(60)} write to anna@mail.example.com or +1 (555) 123-4567 now", f"{prose(60)} from 10.0.0.7, card 4111 1111 1111 1111."]
    rows += [f'{prose(60)} token = "{hashlib.sha1(str(k).encode()).hexdigest()}" end' for k in range(4)]
    return dict(enumerate(rows))


def test_pipeline_equals_a_plain_version(spark, tmp_path):
    rows = texts()
    spark.createDataFrame([(i, t, "en", "s0", len(t or "")) for i, t in rows.items()], "doc_id long, text string, lang string, source string, n_chars long").write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([(1, ITEM), (2, "too short")], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))

    kept = {}
    for i, t in rows.items():
        n, chars, symbols, _, repeats = plain_counts(t)
        if n >= 50 and 2 * repeats <= n and symbols < 0.05 * chars:
            kept[i] = t
    components, _ = plain_components(kept, 5, 80)
    kept = {i: t for i, t in kept.items() if components[i] == i}
    kept = {i: t for i, t in kept.items() if ITEM not in t.lower()}
    clean = {}
    for i, t in kept.items():
        t = re.sub(r'(token = ")[0-9a-f]{40}', r"\1<SECRET>", t)
        t = t.replace("anna@mail.example.com", "<EMAIL>").replace("+1 (555) 123-4567", "<PHONE>").replace("10.0.0.7", "<IP>").replace("4111 1111 1111 1111", "<CARD>")
        clean[i] = t
    library = tiktoken.Encoding("own", pat_str=queries.PATTERN, mergeable_ranks=bpe.load_ranks(queries.VOCABULARY), special_tokens={})

    found = {r.doc_id: r for r in corpus_pipeline.run(spark, str(tmp_path)).collect()}
    assert set(found) == set(clean)
    for i, t in clean.items():
        assert found[i].ids == library.encode_ordinary(t) and found[i].exact
        assert found[i].decoded_sha256 == hashlib.sha256(t.encode()).hexdigest()


def test_stages_are_named_and_keep_the_columns():
    assert [name for name, _ in corpus_pipeline.STAGES] == ["quality rules", "near-duplicates", "decontamination", "personal data", "encoding"]


def test_pipeline_of_odd_rows(spark, tmp_path):
    """Rows without an id or that repeat, clashing column names, empty tables."""
    draw = random.Random(12)
    prose = lambda n: " ".join(draw.choice(LOREM) + str(draw.randrange(10, 99)) for _ in range(n))
    rows = [(i, prose(90)) for i in range(40)]
    twice = prose(90)
    rows += [(100, twice), (100, twice), (None, twice), (None, prose(90)), (None, f"{prose(60)} {ITEM} {prose(30)}"), (101, rows[0][1])]
    schema = "doc_id long, text string, lang string, source string, n_chars long, kept string, d2 string, n_words string, component_id long, contaminated string, spans string, `a.b` string"
    table = [(i, t, "en", "s0", len(t), "own", "own", "own", 7, "own", "own", "own") for i, t in rows]
    spark.createDataFrame(table, schema).write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([(1, ITEM)], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    docs = spark.read.parquet(str(tmp_path / "documents.parquet"))
    for name, stage in corpus_pipeline.STAGES[:-1]:
        path = str(tmp_path / name.replace(" ", "-"))
        stage(spark, docs, str(tmp_path)).write.parquet(path)
        docs = spark.read.parquet(path)
        assert docs.columns == [f.split()[0].strip("`") for f in schema.split(", ")]
    found = sorted(((r.doc_id is None, r.doc_id or 0) for r in docs.collect()))
    assert found == sorted([(False, i) for i in range(40)] + [(False, 100), (True, 0)])
    assert {tuple(r) for r in docs.select("kept", "d2", "n_words", "component_id").distinct().collect()} == {("own", "own", "own", 7)}
    assert corpus_pipeline.STAGES[-1][1](spark, docs, str(tmp_path)).count() == 42

    empty = tmp_path / "empty"
    spark.createDataFrame([], schema).write.parquet(str(empty / "documents.parquet"))
    spark.createDataFrame([], "item_id long, text string").write.parquet(str(empty / "benchmark.parquet"))
    assert corpus_pipeline.run(spark, str(empty)).count() == 0
