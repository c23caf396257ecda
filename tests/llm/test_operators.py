"""The ten operators against plain versions, on small tables with odd rows."""

import hashlib
import itertools
import json
import math
import random
import re
import time
import zlib
from collections import Counter

import numpy as np
import public_tokenizers
import pytest
import tiktoken
from pyspark.sql import functions as F

from emberlane.llm import bpe, chat, decontaminate, lengths, licenses, maxent, minhash, pii, quality, queries, urls
from emberlane.llm.components import connected_components

PATH, PATTERN = queries.VOCABULARY, queries.PATTERN
LOREM = "the quick brown fox jumps over a lazy dog while seven grey herons wade along the muddy shore of this lake".split()


def prose(seed, n):
    draw = random.Random(seed)
    return " ".join(draw.choice(LOREM) + str(draw.randrange(9)) * (draw.random() < 0.2) for _ in range(n))


def frame(spark, rows, schema="doc_id long, text string, lang string, source string, n_chars long"):
    return spark.createDataFrame(rows, schema)


@pytest.fixture(scope="module")
def corpus(spark):
    base = prose(1, 120)
    near = base.split()
    rows = [base, base, " ".join(near[:60] + ["other"] + near[61:]), " ".join(near[:20] + ["x", "y", "z"] * 12), None, "", "   \n\t", "word", "a b", "é" * 5000, prose(7, 30_000)]
    rows += [prose(k, 80) for k in range(20, 40)]
    rows += [" ".join(near[:k] + [f"new{k}"] + near[k + 1 :]) for k in range(5, 115, 5)]
    table = [(i, t, "en", f"s{i % 3}", len(t or "")) for i, t in enumerate(rows)]
    return frame(spark, table + [table[0], (None, base, None, None, None)]).withColumn("id", F.lit("clash")).withColumn("key", F.lit(1))


@pytest.fixture(scope="module")
def codec():
    return bpe.Codec(bpe.load_ranks(PATH), PATTERN)


@pytest.fixture(scope="module")
def library():
    return tiktoken.Encoding("own", pat_str=PATTERN, mergeable_ranks=bpe.load_ranks(PATH), special_tokens={})


def test_bpe_equals_the_library(codec, library):
    draw = random.Random(4)
    texts = ["", "a" * 3000, "ab" * 900, "<|endoftext|> it's we'll  \n\n x ", "".join(chr(draw.randrange(1, 0xD000)) for _ in range(2000))]
    texts += ["".join(draw.choice("aab cé'\n1😀") for _ in range(200)) for _ in range(100)]
    assert list(codec.encode(texts)) == [library.encode_ordinary(t) for t in texts]


def test_bpe_characters_assigned_later(codec, library):
    letters = [c for c in range(0x110000) if not 0xD800 <= c < 0xE000]
    ends = [c for r in (bpe.LATER_LETTERS + bpe.LATER_NUMBERS).split() for c in r.split("-")]
    near = sorted({int(c, 16) + k for c in ends for k in (-1, 0, 1)})
    texts = [f"a{chr(c)}b {chr(c)}1{chr(c)}." for c in near]
    texts += ["".join(f"a{chr(c)}b" for c in letters[k : k + 2048]) for k in range(0, len(letters), 2048)]
    assert list(codec.encode(texts)) == [library.encode_ordinary(t) for t in texts]


def test_bpe_long_texts_piecemeal(codec, library, monkeypatch):
    monkeypatch.setattr(bpe, "CHUNK_PIECES", 50)
    monkeypatch.setattr(bpe, "QUEUE_BYTES", 100)
    texts = [prose(3, 900), "", None, prose(4, 5), "x  \n " * 300, prose(6, 700)]
    assert list(codec.encode(texts)) == [library.encode_ordinary(t or "") for t in texts]
    assert codec.count(texts) == [len(library.encode_ordinary(t or "")) for t in texts]


def test_bpe_query_columns(spark, corpus, library):
    for row in bpe.round_trip(corpus, PATH, PATTERN).join(corpus.select("doc_id", "text"), "doc_id").collect():
        ids = library.encode_ordinary(row.text or "")
        assert row.n_tokens == len(ids) and row.exact
        assert row.ids_sha256 == hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest()
        assert row.decoded_sha256 == hashlib.sha256((row.text or "").encode()).hexdigest()


def test_bpe_encode_then_decode_tables(spark, corpus):
    back = bpe.decode(bpe.encode(corpus, PATH, PATTERN), PATH).where("doc_id is not null").distinct()
    want = {(r.doc_id, r.text or "") for r in corpus.where("doc_id is not null").collect()}
    assert {tuple(r) for r in back.collect()} == want


def test_length_histogram(spark, corpus, codec):
    sizes = codec.count([r.text for r in corpus.collect()])
    found = {r.context_limit: r for r in lengths.length_histogram(lengths.encoded_lengths(corpus, PATH, PATTERN)).collect()}
    assert set(found) == set(sizes)
    for limit, row in found.items():
        assert row.n_docs == sizes.count(limit)
        assert row.docs_at_least == sum(s >= limit for s in sizes) and row.tokens_at_least == sum(s for s in sizes if s >= limit)
        assert row.truncated_total == sum(min(s, limit) for s in sizes) and row.lost_tokens == sum(max(0, s - limit) for s in sizes)
        assert row["quantile"] == pytest.approx(sum(s <= limit for s in sizes) / len(sizes))
    told = lengths.answer_limits(lengths.length_histogram(lengths.encoded_lengths(corpus, PATH, PATTERN)), [0, 17, 10**7])
    assert {r.context_limit: r.truncated_total for r in told.collect()} == {k: sum(min(s, k) for s in sizes) for k in (0, 17, 10**7)}


def plain_components(texts, size, percent):
    """By all pairs: id to smallest reachable id."""
    sets = {}
    for i, t in texts.items():
        w = (t or "").encode().lower().split()
        sets[i] = set(zip(*(w[k:] for k in range(size)))) if len(w) >= size else {tuple(w)} if w else set()
    up = {i: i for i in texts}

    def top(i):
        return i if up[i] == i else top(up[i])

    for a, b in itertools.combinations(sorted(sets), 2):
        both = len(sets[a] & sets[b])
        if sets[a] and sets[b] and 100 * both >= percent * (len(sets[a]) + len(sets[b]) - both):
            x, y = top(a), top(b)
            up[max(x, y)] = min(x, y)
    return {i: top(i) for i in texts}, {i: len(s) for i, s in sets.items()}


@pytest.mark.parametrize("size", [2, 5])
def test_near_duplicates(corpus, size):
    texts = {r.doc_id: r.text for r in corpus.where("doc_id is not null").collect()}
    components, sizes = plain_components(texts, size, 80)
    rows = minhash.near_duplicates(corpus, size).collect()
    assert len(rows) == corpus.count()
    for r in rows:
        if r.doc_id is None:
            assert r.component_id is None and not r.kept
        else:
            assert (r.component_id, r.n_shingles, r.kept) == (components[r.doc_id], sizes[r.doc_id], components[r.doc_id] == r.doc_id)


def joined(pairs):
    """Least member of each set of ids that ``pairs`` tie together."""
    up: dict = {}

    def top(i):
        while up.get(i, i) != i:
            i = up[i]
        return i

    for a, b in pairs:
        x, y = top(a), top(b)
        up[max(x, y)] = min(x, y)
    return {i: top(i) for pair in pairs for i in pair}


def test_blocks_find_every_link_across(spark, monkeypatch):
    monkeypatch.setattr(minhash, "BLOCK", 7)
    monkeypatch.setattr(minhash, "BLOCKS_IN_TASK", 2)
    draw = random.Random(8)
    base = prose(5, 60).split()
    texts = {i: " ".join(w if draw.random() > 0.02 * (i % 6) else f"e{draw.randrange(400)}" for w in base) for i in range(60)}
    places = [("g", i, 0 if i % 3 else i) for i in texts] + [("other", i, i) for i in range(10, 20)]
    rows = spark.createDataFrame([({"g": 0, "other": 13}[g], i, c) for g, i, c in places], "around long, id long, component long")
    table = spark.createDataFrame(list(texts.items()), "id long, text string")
    found = [tuple(r) for r in minhash._across(rows, minhash.signatures(table, 2, "id", "text"), table, 2, 80).collect()]
    sets = {i: set(zip(t.lower().split(), t.lower().split()[1:])) for i, t in texts.items()}
    want = []
    for g in ("g", "other"):
        of = {i: c for h, i, c in places if h == g}
        for i, j in itertools.combinations(sorted(of), 2):
            both = len(sets[i] & sets[j])
            if of[i] != of[j] and 100 * both >= 80 * (len(sets[i]) + len(sets[j]) - both):
                want.append((i, j))
    assert set(found) <= set(want)
    same = [(c, i) for g, i, c in places if g == "g"]  # the components that are known already
    assert joined(found + same) == joined(want + same)


def test_one_bucket_of_near_copies_and_strangers(spark, monkeypatch):
    """A hot bucket: many near copies of one text beside many texts that share only a long passage."""
    draw = random.Random(9)
    base, passage = prose(61, 120).split(), prose(62, 120)
    texts = [" ".join(f"v{k}" if i == k % 120 else w for i, w in enumerate(base)) for k in range(300)]
    texts += [f"{passage} " + " ".join(f"u{k}x{draw.randrange(60)}" for _ in range(60)) for k in range(300)]
    emitted, whole = [], minhash._across
    monkeypatch.setattr(minhash, "_across", lambda *a: (emitted.append(whole(*a)), emitted[-1])[1])
    rows = minhash.near_duplicates(frame(spark, [(k, t, "en", "s", 0) for k, t in enumerate(texts)]), 5).collect()
    components, _ = plain_components(dict(enumerate(texts)), 5, 80)
    assert {r.doc_id: r.component_id for r in rows} == components
    assert emitted[0].count() < 600


def test_components_of_a_long_path(spark):
    edges = spark.createDataFrame([(k, k + 1) for k in range(200)] + [(500, 501), (7, 7)], "a long, b long")
    found = {r.id: r.component for r in connected_components(edges).collect()}
    assert found == {k: 0 for k in range(1, 201)} | {501: 500}


BASE = {"email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", "card": r"[0-9]([\x20-]?[0-9])+", "phone": r"\+[0-9][\x20().0-9-]+[0-9]"}


def plain_spans(text):
    def fits(kind, m):
        d = [int(c) for c in re.sub("[^0-9]", "", m)]
        if kind == "ip":
            return all(int(p) <= 255 for p in m.split("."))
        if kind == "card":
            return 16 <= len(d) <= 19 and sum(x if i % 2 == 0 else 2 * x - 9 * (x > 4) for i, x in enumerate(reversed(d))) % 10 == 0
        return kind == "email" or 8 <= len(d) <= 15

    return [f"{k}:{m.start()}:{m.end()}" for k, p in BASE.items() for m in re.finditer(p, text or "") if fits(k, m.group())]


def test_personal_data(spark):
    draw = random.Random(9)
    texts = ["".join(draw.choice('a1.@+-_% ()2é3😀:="45') for _ in range(150)) for _ in range(300)]
    texts += [None, "", "a" * 3000, "1" * 3000, "mail a@b.c_d@e.f, 4111 1111 1111 1111 and +1 (555) 123-4567 at 10.0.0.255 or 10.0.0.256", "+1 555 123 4567 " * 600]
    docs = frame(spark, [(i, t, "en", "s", 0) for i, t in enumerate(texts)]).withColumn("value", F.lit("clash"))
    for r in pii.report(docs).collect():
        want = plain_spans(texts[r.doc_id])
        assert r.spans == ",".join(want) and r.base_sha256 == hashlib.sha256(",".join(want).encode()).hexdigest()
        assert [r.n_email, r.n_ip, r.n_card, r.n_phone] == [sum(x.startswith(k) for x in want) for k in BASE]


def test_labels_find_unseen_secrets(spark):
    texts = [f'x token = "{hashlib.sha1(str(i).encode()).hexdigest()}" y' for i in range(8)] + ['x token = "QzX1-88-77bb" y', "the ratio: 123456789 y", None]
    docs = frame(spark, [(i, t, "en", "s", 0) for i, t in enumerate(texts)])
    found = {r.doc_id: r.spans for r in pii.report(docs).collect()}
    assert found[8] == "secret:11:23" and found[9] == "" and all(found[i] == "secret:11:51" for i in range(8))
    clean = {r.doc_id: r.text for r in pii.redacted(docs).collect()}
    assert clean[8] == 'x token = "<SECRET>" y' and clean[9] == texts[9] and clean[10] is None


def test_labels_keep_seeds_and_promote_other_labels(spark):
    hexa = lambda k: hashlib.md5(str(k).encode()).hexdigest()
    found = [f"QzX1-88-77b{k}" for k in range(3)]
    pairs = [("one =", hexa(k)) for k in range(3)] + [("lone =", hexa(9))] + [("mixed =", hexa(10))] + [("mixed =", f"ab-{k}12-345") for k in range(9)]
    pairs += [("token =", hexa(20 + k)) for k in range(30)] + [("token =", v) for v in found]
    pairs += [("second =", v) for v in found] + [("second =", "other-123456")]  # no seed of its own
    pairs += [("third =", "other-123456"), ("third =", "last-1234567")]
    rows = pii.score_values(spark.createDataFrame([([x.replace(" ", "")], v) for x, v in pairs], "patterns array<string>, value string")).collect()
    assert {r.value for r in rows} == {hexa(k) for k in (0, 1, 2, 9, 10, *range(20, 50))} | set(found) | {"other-123456"}
    assert all(r.score == 1.0 for r in rows if len(r.value) == 32)


def plain_scores(mentions, support=3, least=0.5):
    edges = {(p, v) for patterns, v in mentions for p in patterns}
    found = {v: 1.0 for _, v in mentions if re.fullmatch("[0-9a-f]{32,}", v) and re.search("[a-f]", v) and re.search("[0-9]", v)}
    while True:
        trust = {}
        for p in {p for p, _ in edges}:
            of = [v for q, v in edges if q == p]
            known = [found[v] for v in of if v in found]
            if len(known) >= support:
                trust[p] = sum(known) / (len(of) + 1)
        new = {}
        for p, v in edges:
            if v not in found and trust.get(p, 0) >= least:
                new[v] = max(new.get(v, 0), trust[p])
        if not new:
            return found
        found |= new


def test_scores_equal_a_plain_graph(spark):
    draw = random.Random(21)
    value = lambda k: hashlib.md5(str(k).encode()).hexdigest() if k % 3 == 0 else f"v-{k}"
    for dense in (2, 6):
        mentions = [([f"p{min(int(draw.expovariate(0.15)), 39)}" for _ in range(draw.randrange(1, dense))], value(draw.randrange(150))) for _ in range(400)]
        rows = pii.score_values(spark.createDataFrame(mentions, "patterns array<string>, value string")).collect()
        assert {r.value: pytest.approx(r.score) for r in rows} == plain_scores(mentions)


def test_contexts_find_unseen_identifiers(spark):
    draw = random.Random(22)
    hexa = lambda k: hashlib.md5(str(k).encode()).hexdigest()
    unseen = lambda: f"{draw.randrange(1000, 9999)}-{draw.choice('XYZ')}{draw.randrange(100, 999)}"
    texts, planted = [], set()

    def put(before, value, after):
        if not re.fullmatch("[0-9a-f]{32}", value):
            planted.add((len(texts), len(before), len(before) + len(value)))
        texts.append(before + value + after)

    for k in range(40):
        put(f"{prose(k, 8)} his member number ", hexa(k) if k % 3 else unseen(), f" {prose(k, 3)}")  # two words to the left
        put(f"{prose(k, 5)} under (", hexa(100 + k) if k % 3 else unseen(), f") archived {prose(k, 3)}")  # both sides
        put(f'{prose(k, 5)} session_key: "', hexa(200 + k) if k % 3 else unseen(), f'" {prose(k, 3)}')  # a label
    known = [texts[i][a:b] for i, a, b in sorted(planted) if "member number" in texts[i]]
    for k, value in enumerate(known):
        put("case-ref # ", value, f" {prose(k, 3)}")
    put("x case-ref # ", "77-not-seen-12", " end")  # a label without seeds, from values found
    clean = len(texts)
    texts += [f"see page number {draw.randrange(10_000, 99_999)} of {draw.randrange(1900, 2020)} under {draw.randrange(10_000, 99_999)} pages" for _ in range(60)]
    rows = {r.doc_id: r.spans for r in pii.report(frame(spark, [(i, t, "en", "s", 0) for i, t in enumerate(texts)])).collect()}
    found = {(i, *map(int, x.split(":")[1:])) for i, spans in rows.items() for x in spans.split(",") if x}
    assert len(found & planted) >= 0.95 * len(planted) and all(not rows[i] for i in range(clean, len(texts)))


def test_personal_data_repeated_and_long(spark):
    long = " ".join(f"{w} {k}@b.cd" if k % 50 == 0 else w for k, w in enumerate(prose(3, 60_000).split()))
    docs = frame(spark, [(1, long, "en", "s", 0), (1, long, "en", "s", 0), (2, "a@b.cd", None, None, None)])
    rows = [(r.doc_id, r.n_email, r.base_sha256) for r in pii.report(docs).collect()]
    assert sorted(r[:2] for r in rows) == [(1, 1200), (1, 1200), (2, 1)]
    assert rows.count(rows[[r[0] for r in rows].index(1)]) == 2
    assert next(r[2] for r in rows if r[0] == 1) == hashlib.sha256(",".join(plain_spans(long)).encode()).hexdigest()


def test_redaction_is_of_the_original_text(spark):
    key = hashlib.md5(b"x").hexdigest()
    texts = [f"é😀 key = {key} again {key}, a@b.c", "+4111 1111 1111 1111 and 4111 1111 1111 1111", "a@1.2.3.4 b", "plain", None, "", "10.0.0.5 4111111111111116"]
    docs = frame(spark, [(i, t, "en", "s", 0) for i, t in enumerate(texts)])
    clean = {r.doc_id: r.text for r in pii.redacted(docs).collect()}
    assert clean[0] == "é😀 key = <SECRET> again <SECRET>, <EMAIL>"
    spans = {r.doc_id: [x.split(":") for x in r.spans.split(",") if x] for r in pii.report(docs).collect()}
    assert clean[6] == "<IP>"  # the card begins with the address's last digit
    for i in (1, 2, 6):
        covered = {k for _, a, b in spans[i] for k in range(int(a), int(b))}
        left = re.sub("<[A-Z]+>", "\0", clean[i])
        assert left.replace("\0", "") == "".join(c for k, c in enumerate(texts[i]) if k not in covered)
    assert [clean[k] for k in (3, 4, 5)] == texts[3:6]


def test_chat_links_orders_and_checks(spark):
    calls = spark.createDataFrame(
        [(1, "a", 0, "add", '{"x": 1, "é": "\\n"}', []), (1, "b", 2, "add", '{"x": "no"}', ["a", "gone"]), (1, "c", 4, "add", "{", ["b"]), (1, "d", 5, "add", '{"x": 3}', ["e"]), (1, "e", 6, "add", '{"x": 3}', ["d"]), (1, "a", 9, "add", "{}", []), (2, "a", 0, "none", "{}", []), (3, None, 0, "add", "{}", [])],
        "conv_id long, call_id string, turn long, name string, arguments string, depends_on array<string>",
    )
    results = spark.createDataFrame([(1, "a", 1, "2"), (1, "b", 3, "3"), (1, "z", 7, "?"), (1, "c", 8, "4"), (1, "c", 9, "5"), (1, None, 9, "6")], "conv_id long, call_id string, turn long, content string")
    schema = {"add": {"type": "object", "required": ["x"], "properties": {"x": {"type": "integer"}}}}
    rows = {(r.conv_id, r.call_id, r.status): r for r in chat.link_calls(calls, results, schema).collect()}
    assert set(rows) == {(1, "a", "linked"), (1, "b", "invalid"), (1, "c", "invalid"), (1, "d", "cycle"), (1, "e", "cycle"), (1, "a", "repeated"), (1, "z", "orphan"), (2, "a", "unanswered"), (3, None, "unidentified"), (1, "c", "repeated"), (1, None, "orphan")}
    assert rows[1, "a", "linked"].line == '{"arguments":{"x":1,"é":"\\n"},"call_id":"a","level":0,"name":"add","result":"2"}'
    assert [rows[1, k, "invalid"].level for k in "bc"] == [1, 2] and rows[1, "b", "invalid"].problem == "$.x: not integer"
    assert rows[2, "a", "unanswered"].problem == "no such tool"
    assert all(json.loads(r.line) is not None for r in rows.values())
    assert chat.link_calls(calls.limit(0), results.limit(0), schema).count() == 0


def test_levels_of_random_graphs(spark):
    draw = random.Random(6)
    rows, want = [], {}
    for k in range(120):
        needs = draw.sample(range(k), min(k, draw.choice([0, 1, 1, 1, 2, 3]))) if k else []
        rows.append((1, f"n{k}", [f"n{x}" for x in needs] + ["gone"]))
        want[f"n{k}"] = 1 + max(want[f"n{x}"] for x in needs) if needs else 0
    rows += [(2, f"c{k}", [f"c{k - 1}"] if k else []) for k in range(300)]
    rows += [(3, "x", ["y"]), (3, "y", ["z"]), (3, "z", ["x"]), (3, "behind", ["x", "free"]), (3, "free", None)]
    found = {(r.conv_id, r.call_id): r.level for r in chat.levels(spark.createDataFrame(rows, "conv_id long, call_id string, depends_on array<string>")).collect()}
    assert found == {(1, k): v for k, v in want.items()} | {(2, f"c{k}"): k for k in range(300)} | {(3, "free"): 0}


def test_levels_plan_does_not_grow_with_rounds(spark):
    def plan(depth):
        rows = [(1, f"d{k}", [f"d{x}" for x in (k - 1, k - 2) if x >= 0]) for k in range(depth)]
        found = chat.levels(spark.createDataFrame(rows, "conv_id long, call_id string, depends_on array<string>"))
        assert {r.call_id: r.level for r in found.collect()} == {f"d{k}": k for k in range(depth)}
        return found._jdf.queryExecution().optimizedPlan().toString().count("Relation")

    assert plan(3) == plan(9)


def test_json_of_odd_arguments(spark):
    many = {"type": ["integer", "null"]}
    assert chat.schema_problem(None, many) is None and chat.schema_problem("x", many) == "$: not integer or null"
    assert chat.schema_problem(True, {"enum": [1]}) == "$: not in enum" and chat.schema_problem(1.0, {"enum": [1]}) is None
    assert chat.schema_problem(3, {"type": "tuple"}) == "$: the schema's type tuple is unknown"
    assert chat.schema_problem(2.0, {"type": "integer"}) is None and chat.schema_problem(True, {"type": "number"}) == "$: not number"
    calls = spark.createDataFrame([(1, "a", 0, "add", '"\\ud800"', []), (1, "b", 1, "add", '{"\\udfff": "\\ud83d\\ude00"}', None), (1, None, None, None, None, None)], "conv_id long, call_id string, turn long, name string, arguments string, depends_on array<string>")
    results = spark.createDataFrame([(1, "b", 2, "x" * 300_000)], "conv_id long, call_id string, turn long, content string")
    for extra in (calls, calls.withColumn("status", F.lit("clash")).withColumn("level", F.lit(1))):
        rows = {r.call_id: r for r in chat.link_calls(extra, results, {"add": {}}).collect()}
        assert json.loads(rows["a"].line)["arguments"] == "\ud800" and "\\ud800" in rows["a"].line
        assert "\\udfff" in rows["b"].line and "😀" in rows["b"].line and rows["b"].status == "linked" and rows[None].status == "unidentified"


def test_every_role_has_a_row(spark):
    turns = [(1, 0, "system", "be brief"), (1, 1, "user", "what is the answer to all of it"), (1, 2, "assistant", "42"), (1, None, "user", "when"), (1, None, "user", "where"), (2, 0, None, None), (2, 1, "tool", "x"), (1, 0, "system", "be brief")]
    table = spark.createDataFrame(turns, "conv_id long, turn long, role string, text string").withColumn("name", F.lit("clash"))
    calls, results, messages = chat.turns_as_calls(table)
    rows = [(r.conv_id, r.turn, r.name, r.status, r.line) for r in chat.link_calls(calls, results, queries.REPLY, messages).collect()]
    assert [r[3] for r in rows].count("message") == 4 and [r[3] for r in rows].count("unidentified") == 2
    assert (2, 0, None, "message", "{}") in rows and (2, 1, "tool", "message", '{"name":"tool","result":"x"}') in rows
    assert [r[3] for r in rows if r[1] == 1 and r[0] == 1] == ["linked"]
    empty = table.limit(0)
    assert chat.link_calls(*chat.turns_as_calls(empty)[:2], queries.REPLY, chat.turns_as_calls(empty)[2]).count() == 0


def test_templates_catch_other_numbers(spark):
    item = "A train leaves Leeds at 9 and covers 120 km in 2 hours before it meets another train from Leeds"
    bench = spark.createDataFrame([(1, item), (2, "one two"), (3, None), (4, "who was the first king of Spain")], "item_id long, text string")
    other = item.replace("Leeds", "Derby").replace("120 km", "90 miles").replace(" 9 ", " 7 ")
    texts = ["well. " + other + " indeed", other.replace("from Derby", "from Paris"), item.upper(), None, "", prose(3, 50), "he asked: Who was the first king of Spain?", "one two"]
    docs = frame(spark, [(i, t, "en", "s", 0) for i, t in enumerate(texts)]).withColumn("item_id", F.lit(5))
    rows = {r.doc_id: r for r in decontaminate.find_leaks(docs, bench).collect()}
    assert {i for i, r in rows.items() if r.contaminated} == {0, 2, 6, 7} and rows[0].item_ids == "1" and rows[6].item_ids == "4"
    assert rows[7].item_ids == "2"  # the whole text is an item
    assert rows[1].n_windows == 0  # one name of the item would stand for two
    assert decontaminate.find_leaks(docs, bench.limit(0)).where("contaminated").count() == 0


def test_leaks_with_clashes_many_values_and_unclear_starts(spark):
    story = "The farmer counted 5 grey geese near the old mill and 7 white ducks on the pond before the miller came back with two carts full of flour and asked what they would cost him"
    sums = "3 + 4 = 7 and 12 - 5 = 7 so 7 + 12 = 19 then 19 - 4 = 15"
    nouns = "Der Hund von Anna Berger jagt Katzen durch Garten und Haus"
    short = "Leeds has which old river"
    lines = "which of the towns\nLeeds or Derby\nhas the older bridge"
    bench = spark.createDataFrame(list(enumerate([story, sums, nouns, short, lines])), "item_id long, text string")
    texts = [story.replace("and 7 white", "and 5 white"), f"see {sums} there", None, f"er sagt dass {nouns}", f"he said that {short}", "Title\n" + short, short.replace("Leeds", "Derby"), lines.replace("\n", " "), "Heading\n- " + short, None]
    docs = frame(spark, [(i, t, "en", "s", 0) for i, t in enumerate(texts)])
    rows = {r.doc_id: r.item_ids for r in decontaminate.find_leaks(docs, bench).collect()}
    assert [rows[i] for i in (0, 1, 3, 4, 5, 7, 8)] == ["0", "1", "2", "3", "3", "4", "3"]
    assert not rows[6] and not rows[9]
    # two texts of one id don't contradict each other
    both = frame(spark, [(1, story, "en", "s", 0), (1, story.replace("5", "8").replace("7", "5"), "en", "s", 0)])
    assert {(r.n_windows, r.item_ids) for r in decontaminate.find_leaks(both, bench).collect()} == {(len(story.split()) - 7, "0")}


def plain_template(text):
    """(raw words, canonical words, values) by the docstring; clear sentence starts only."""
    raw, out, begins, before = [], [], False, ""
    for line in (text or "").splitlines():
        for w in line.split():
            core = re.sub(r"^[^\w$€£¥%°+-]+|[^\w%°$€£¥]+$", "", w)
            if not core:
                continue
            low = core.lower()
            number = low in decontaminate.NUMBER_WORDS or re.fullmatch(r"[-+$€£¥]?\d[\d.,:/]*(%|st|nd|rd|th|e[-+]?\d+)?", low)
            attached = re.fullmatch(r"[-+]?\d[\d.,]*([^\d.,].*)", low)
            if number or attached and attached.group(1) in decontaminate.UNITS:
                c = "<num>"
            elif before == "<num>" and low in decontaminate.UNITS:
                c = "<unit>"
            elif core[:1].isupper() and not core.isupper() and not begins:
                c = "<name>"
            else:
                c = low
            raw.append(low)
            out.append(c)
            before, begins = c, (w.rstrip("\"')]}»”’*_") or w)[-1] in ".!?:"
    return raw, out


def plain_leaks(docs, items, window=8, shortest=5):
    """{doc: {item: windows}} by comparing every window of each pair. Texts begin with a word in small letters."""
    found = {}
    for d, text in docs.items():
        raw_d, can_d = plain_template(text)
        for i, item in items.items():
            raw_i, can_i = plain_template(item)
            size = min(window, len(raw_i))
            if size < shortest:  # as they are; the shortest only as whole texts
                places = [b for b in range(len(raw_d) - size + 1) if raw_d[b : b + size] == raw_i] if size > 2 else [0] * (raw_d == raw_i)
                if size and places:
                    found.setdefault(d, {})[i] = len(places)
                continue
            lines = {}
            for a in range(len(raw_i) - size + 1):
                for b in range(len(raw_d) - size + 1):
                    x, y = can_i[a : a + size], can_d[b : b + size]
                    heavy = lambda t: sum(w[0] == "<" for w in t) > size / 2
                    if heavy(x) or heavy(y):
                        met = heavy(x) and heavy(y) and raw_i[a : a + size] == raw_d[b : b + size]
                        pairs = set()
                    else:
                        met = x == y
                        pairs = {(raw_i[a + k], raw_d[b + k]) for k in range(size) if x[k][0] == "<"}
                    if met:
                        lines.setdefault(b - a, []).append({"item_at": a, "size": size, "literal": heavy(x), "i": [p for p, _ in sorted(pairs)], "d": [q for _, q in sorted(pairs)]})
            n = sum(plain_agreeing(w, window) for w in lines.values())
            if n:
                found.setdefault(d, {})[i] = n
    return found


def plain_agreeing(met, window):
    pairs = [set(zip(w["i"], w["d"])) for w in met]
    function = lambda p: len(dict(p)) == len(p)
    if function(set().union(*pairs)):
        return len({w["item_at"] for w in met})
    kept = {w["item_at"] for w in met if w["literal"]}
    by_place = {w["item_at"]: k for k, w in enumerate(met)}
    for least, fits in ((13, lambda p: all(i == d for i, d in p)), (3 * window, function)):
        for first in by_place:
            last = first
            while last in by_place:
                held = set().union(*(pairs[by_place[k]] for k in range(first, last + 1)))
                if fits(held) and last + met[by_place[last]]["size"] - first >= least:
                    kept.update(range(first, last + 1))
                last += 1
    return len(kept)


def test_leaks_equal_a_plain_search(spark):
    draw = random.Random(31)
    words = ["the", "a", "train", "covers", "in", "of", "Leeds", "Derby", "Anna", "km", "m", "hours", "second", "kg", "5", "7", "12", "3.5kg", "two", "seven", "and", "to", "from", "sold", "cost", "$4"]
    item = lambda: "from " + " ".join(draw.choice(words) for _ in range(draw.randrange(3, 40)))
    items = {k: item() for k in range(25)}
    items |= {90: None, 91: "", 92: "from here on we go"}
    docs = {}
    for k in range(120):
        base = items[draw.randrange(25)].split()
        changed = [draw.choice(words) if draw.random() < draw.choice((0, 0.05, 0.2)) else w for w in base]
        swap = {"5": "12", "Leeds": "Anna", "7": "12", "km": "hours"} if k % 3 == 0 else {}
        docs[k] = "so " + " ".join([prose(k, 6)] + [swap.get(w, w) for w in changed] + [prose(k + 500, 6)])
    docs |= {900: None, 901: "", 902: prose(77, 40_000) + " " + items[3], 903: docs[0]}
    bench = spark.createDataFrame(list(items.items()), "item_id long, text string")
    table = frame(spark, [(i, t, "en", "s", 0) for i, t in docs.items()] + [(0, docs[0], "en", "s", 0)]).withColumn("hash", F.lit("clash")).withColumn("template", F.lit(1))
    rows = decontaminate.find_leaks(table, bench).collect()
    assert len(rows) == len(docs) + 1
    small = {d: t for d, t in docs.items() if d != 902}
    want = plain_leaks(small, items)
    for r in rows:
        if r.doc_id == 902:
            assert "3" in r.item_ids.split(",") and r.n_words > 40_000
            continue
        mine = want.get(r.doc_id, {})
        assert (r.n_windows, r.item_ids or "") == (sum(mine.values()), ",".join(map(str, sorted(mine)))), (docs[r.doc_id], mine)
    assert len(want) > 30


def test_leaks_of_other_parameters_are_found(spark):
    draw = random.Random(32)
    names, places = ["Anna", "Bodo", "Clara", "Dirk", "Emma", "Fritz"], ["Leeds", "Derby", "Paris", "Rome", "Oslo", "Cork"]
    item = lambda n: f"so when {draw.choice(names)} drives {n[0]} km from {draw.choice(places)} in {n[1]} hours and then rests for {n[2]} minutes how far is it from there to the harbour {prose(n[3], 12)}"
    items, docs = {}, {}
    for k in range(60):
        numbers = [draw.randrange(2, 99) for _ in range(3)] + [k]
        items[k] = item(numbers)
        again = item([draw.randrange(2, 99) for _ in range(3)] + [k])
        docs[k] = f"{prose(k + 900, 30)} {again} {prose(k + 990, 30)}"
    docs |= {1000 + k: prose(5000 + k, 90) for k in range(60)}
    bench = spark.createDataFrame(list(items.items()), "item_id long, text string")
    rows = {r.doc_id: r for r in decontaminate.find_leaks(frame(spark, [(i, t, "en", "s", 0) for i, t in docs.items()]), bench).collect()}
    assert sum(str(k) in (rows[k].item_ids or "").split(",") for k in range(60)) >= 0.9 * 60
    assert not any(rows[1000 + k].contaminated for k in range(60))


def test_words_of_many_texts_are_those_of_each():
    texts = ["", None, "...", "— 3 km “Who wrote”. One 5kg 12% ... $5 -", "", "Two. two TWO 3rd dollars 3", "km 5 miles", "dollars a b.", "Ab c", None]
    texts += [prose(k, 40).capitalize() + "." for k in range(5)]
    single, together = decontaminate.Canoniser(), decontaminate.Canoniser().words(*texts)
    for size in range(1, 10):
        for kind in ("windows", "short_windows"):
            places, forms, hashes = getattr(together, kind)(size)
            text = np.searchsorted(together.starts, places, "right") - 1
            found = sorted(zip(text.tolist(), (places - together.starts[text]).tolist(), forms.tolist(), hashes.tolist()))
            alone = [getattr(single.words(t), kind)(size) for t in texts]
            assert found == sorted((k, *w) for k, a in enumerate(alone) for w in zip(*(x.tolist() for x in a)))
    assert np.diff(together.starts).tolist() == [len(single.words(t).raw) for t in texts]


def test_cells_keep_the_moments_of_rows(spark):
    draw = np.random.default_rng(5)
    x = np.vstack([draw.normal(size=(300, 4)), np.zeros((50, 4))])
    table = spark.createDataFrame([("g", *map(float, r)) for r in x], "group string, x0 double, x1 double, x2 double, x3 double")
    found = quality.cells(table, ["group"], [1.0] * 4).toPandas()
    assert found.n.sum() == 350 and len(found) < 350
    for i, j in quality.PAIRS:
        assert found[f"q{i}{j}"].sum() == pytest.approx((x[:, i] * x[:, j]).sum())
        assert found[f"s{i}"].sum() == pytest.approx(x[:, i].sum())


def test_short_items_count_as_they_are(spark):
    items = spark.createDataFrame([(1, "Who wrote Hamlet?"), (2, "Compute 17 * 23 exactly"), (3, "Paris"), (4, "very well"), (5, "..."), (6, None)], "item_id long, text string")
    texts = ["Who wrote Hamlet?", "we ask: who wrote Hamlet, and when", "who wrote hamlets", "Compute 17 * 23 exactly", "Compute 18 * 23 exactly", "Paris", "paris.", "I love Paris", "Very well!", "that is very well", "", None, "..."]
    rows = decontaminate.find_leaks(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), items).collect()
    assert {r.doc_id: r.item_ids for r in rows if r.contaminated} == {0: "1", 1: "1", 3: "2", 5: "3", 6: "3", 8: "4"}


def test_both_sides_of_the_join_agree_on_short_and_long_items(spark, monkeypatch):
    items = spark.createDataFrame([(1, "Who wrote Hamlet?"), (2, "a long item of fourteen words that stands in a text from end to end")], "item_id long, text string")
    docs = spark.createDataFrame([(1, "so who wrote Hamlet then"), (2, "x a long item of fourteen words that stands in a text from end to end y"), (3, "neither of them")], "doc_id long, text string")
    want = sorted(map(tuple, decontaminate.find_leaks(docs, items).collect()))
    monkeypatch.setattr(decontaminate, "BROADCAST_WINDOWS", 0)
    assert sorted(map(tuple, decontaminate.find_leaks(docs, items).collect())) == want and [r[5] for r in want] == [True, True, False]


def test_pages_with_maps_and_dotted_names(spark):
    pages = spark.createDataFrame([(1, "http://bad.org/x"), (2, None), (3, None)], "page_id long, url string").selectExpr("*", "map('a', 1) as m", "2 as `a.b`")
    rows = urls.judge(pages, spark.createDataFrame([("bad.org/x",)], "canonical string"), []).collect()
    assert sorted((r.page_id, r.verdict, r["a.b"]) for r in rows) == [(1, "block", 2), (2, "allow", 2), (3, "allow", 2)]
    docs = spark.createDataFrame([(k, prose(k, 80)) for k in range(60)], "doc_id long, text string").selectExpr("*", "'en' as lang", "'s' as source", "7 as `a.b`")
    assert {r["a.b"] for r in quality.judge(docs, ["doc_id", "a.b"]).collect()} == {7}


def test_urls(spark):
    texts = ["http://WWW.Example.com/en/1", "https://m.example.com/en/2?x=1", "http://a.net/es/q#t", "http://net/fr", "http://bad.org/x/?utm_source=a", "http://www.bad.org/x.html#top", "http://good.org/x", None, "nothing", "http://", "http://com"]
    pages = spark.createDataFrame(list(enumerate(texts)), "page_id long, url string")
    listed = spark.createDataFrame([("bad.org/x",), (None,), ("bad.org/x",)], "canonical string")
    rows = {r.page_id: (r.host, r.path, r.rule, r.verdict) for r in urls.judge(pages, listed, queries.URL_RULES).collect()}
    assert rows[0] == ("www.example.com", "/en/1", "www.example.com/en/", "allow")
    assert rows[1] == ("m.example.com", "/en/2", "example.com/en/", "block")
    assert rows[2][2:] == ("net/es/", "block") and rows[3][2:] == (None, "allow")
    assert rows[4][3] == rows[5][3] == "block" and rows[6][3] == "allow"
    assert rows[7] == rows[8] == ("", "", None, "allow") and rows[9] == ("", "", None, "allow") and rows[10] == ("com", "", None, "allow")
    assert urls.judge(pages, listed.limit(0), queries.URL_RULES).where("in_list").count() == 0


def test_urls_clashing_columns_repeats_and_no_pages(spark):
    pages = spark.createDataFrame([(1, "http://bad.org/x", "own"), (1, "http://bad.org/x", "own"), (2, None, "own"), (3, "http://ok.org/" + "y" * 5000, None)], "page_id long, url string, host string")
    pages = pages.withColumns({c: F.lit("clash") for c in ("path", "rule", "verdict", "in_list", "block", "canonical")})
    listed = spark.createDataFrame([("bad.org/x",)], "canonical string")
    for at_most in (0, 1000):
        rows = sorted((r.page_id, r.host, r.verdict, r.in_list) for r in urls.judge(pages, listed, [], broadcast_blocks=at_most).collect())
        assert rows == [(1, "bad.org", "block", True), (1, "bad.org", "block", True), (2, "", "allow", False), (3, "ok.org", "allow", False)]
    assert urls.judge(pages.limit(0), listed, []).count() == 0


def test_bloom_filter_has_no_false_negatives(spark):
    listed = spark.range(3000).select(F.concat(F.lit("h"), "id").alias("canonical"))
    pages = spark.range(6000).select("id", F.concat(F.lit("http://h"), "id").alias("url"))
    judged = urls.judge(pages.withColumnRenamed("id", "page_id"), listed, [], bits_per_key=4, broadcast_blocks=0)
    assert judged.where("in_list").count() == 3000 and judged.count() == 6000


def plain_counts(text):
    w = [x for x in re.split(r"[\x20\x09-\x0D]+", text or "") if x]
    windows = Counter(zip(w, w[1:], w[2:]))
    hit = {k + j for k in range(len(w) - 2) if windows[w[k], w[k + 1], w[k + 2]] > 1 for j in range(3)}
    lines = [x for x in (text or "").split("\n") if x.strip(" \t\n\x0b\x0c\r")]
    return len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in text or ""), len(lines) - len(set(lines)), len(hit)


def test_quality_counts_and_outliers(spark, corpus):
    draw = random.Random(2)
    extra = [(1000 + i, prose(100 + i, 100 + draw.randrange(80)), "en", "s0", 0) for i in range(150)]
    extra += [(2000 + i, "\n".join(f"{w}%%% ***" for w in prose(500 + i, 90).split()), "en", "s0", 0) for i in range(6)]
    extra += [(3000, "a a a a b\na a a a b\n\n#", "en", "s0", 0)]
    docs = corpus.select("doc_id", "text", "lang", "source", "n_chars").unionByName(frame(spark, extra)).withColumn("d2", F.lit("clash"))
    texts = {r.doc_id: r.text for r in docs.collect()}
    for r in quality.judge(docs, ["doc_id"]).collect():
        want = plain_counts(texts[r.doc_id])
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == want
        assert r.base_failed == (want[0] < 50 or 2 * want[4] > want[0])
        if r.base_failed or (r.doc_id or 0) >= 2000:
            assert not r.kept
        elif (r.doc_id or 0) >= 1000:
            assert r.kept
    assert quality.judge(docs.limit(0), ["doc_id"]).count() == 0


def test_maxent_scores(spark, monkeypatch):
    monkeypatch.setattr(maxent, "VOCABULARY", 40)
    docs = frame(spark, [(i, t, "en", "s", 0) for i, t in enumerate([prose(k, 60) for k in range(60)] + [None, "", "unseen words only"])])
    rows = {r.doc_id: r for r in maxent.score(docs).collect()}
    tokens = {r.doc_id: (r.text or "").encode().lower().split() + [None] for r in docs.collect()}
    out = {i: zlib.crc32(str(i).encode()) % 5 == 1 for i in tokens}
    c = Counter(x for i, t in tokens.items() if not out[i] for x in t)
    n, v = sum(c.values()), len(c)
    for i, t in tokens.items():
        r = rows[i]
        assert (r.held_out, r.n_tokens, r.n_known, r.train_tokens) == (out[i], len(t), sum(c[x] > 0 for x in t), n)
        assert r.base_score == pytest.approx(sum(math.log10((c[x] + 0.5) / (n + 0.5 * (v + 1))) for x in t))
        assert r.score < 0
    held = [i for i in tokens if out[i] and i < 60]
    assert sum(rows[i].score for i in held) > 1.05 * sum(rows[i].base_score for i in held)


def plain_mcd(x, share, floors, starts=200):
    """Numpy: mean and covariance (with floors) of least determinant over random starts, to convergence."""
    draw = np.random.default_rng(5)
    h = math.ceil(share * len(x))
    best = None
    for _ in range(starts):
        near = draw.choice(len(x), 6, replace=False)
        for _ in range(50):
            m = x[near].mean(axis=0)
            c = (x[near] - m).T @ (x[near] - m) / len(near) * quality._consistency(share) + np.diag(np.square(floors))
            d = np.einsum("ij,jk,ik->i", x - m, np.linalg.inv(c), x - m)
            ahead = np.argsort(d, kind="stable")[:h]
            if set(ahead) == set(near):
                break
            near = ahead
        if best is None or np.linalg.slogdet(c)[1] < best[0]:
            best = np.linalg.slogdet(c)[1], m, c, d
    return best


def test_least_determinant_equals_a_plain_search(spark):
    draw = np.random.default_rng(3)
    mix = np.array([[1, 0, 0, 0], [0.8, 0.5, 0, 0], [0, 0.3, 1, 0], [-0.5, 0, 0.2, 0.7]])
    floors, rows, want = [0.01] * 4, [], {}
    for group, off in (("a", 3.0), ("b", -2.0), ("c", 0.0)):
        x = draw.normal(size=(400, 4)) @ mix.T + off
        x[:80] = draw.normal(size=(80, 4)) * 0.3 + off + np.array([6, -6, 6, 6])  # a fifth are outliers that sit together
        rows += [(group, *map(float, r)) for r in x]
        want[group] = plain_mcd(x, 0.75, floors), x
    table = spark.createDataFrame(rows, "group string, x0 double, x1 double, x2 double, x3 double")
    found = {r.group: r for r in quality.least_determinants(table, 0.75, floors).collect()}
    for group, ((logdet, m, c, d), x) in want.items():
        r = found[group]
        assert r.logdet == pytest.approx(logdet, abs=0.15)
        mean = np.array([r[f"m{i}"] for i in range(4)])
        cov = np.array([[r[f"c{max(i, j)}{min(i, j)}"] for j in range(4)] for i in range(4)]) + np.diag(np.square(floors))
        assert np.abs(mean - m).max() < 0.15
        ours = np.einsum("ij,jk,ik->i", x - mean, np.linalg.inv(cov), x - mean)
        assert ((ours > 30) == (d > 30)).mean() > 0.99 and (ours[:80] > 30).all() and (ours[80:] < 30).mean() > 0.99


def test_quality_ties_long_texts_and_small_groups(spark):
    draw = random.Random(12)
    rows = [(i, prose(7, 80), "en", "s", 0) for i in range(60)]  # all tie
    rows += [(100 + i, prose(i, 70), "fr" if i % 2 else None, f"alone{i}", 0) for i in range(12)]
    rows += [(200, "\n".join(" ".join(f"{draw.choice(LOREM)}{draw.randrange(10**6)}" for _ in range(10)) for _ in range(12_000)), "en", "s", 0)]
    rows += [(300, "\n".join(f"{w}%%% ***" for w in prose(1, 90).split()), "de", "only", 0)]
    docs = frame(spark, rows).withColumn("n_words", F.lit("clash")).withColumn("group", F.lit(1)).withColumn("kept", F.lit("clash"))
    judged = {r.doc_id: r for r in quality.judge(docs, docs.columns).collect()}
    long = judged.pop(200)
    assert (long.n_words, long.base_failed) == (120_000, False) and long.d2 is not None
    assert not judged.pop(300).kept and all(r.kept for r in judged.values()) and len(judged) == 72


def plain_maxent(texts, parts, top, total, distinct, rate=0.1):
    """score of each (id, words, in training), by loops over tokens; ``top``: (word, count) by falling counts."""
    n, v = total, distinct
    ids = {w: k for k, (w, _) in enumerate(top, 3)}
    mass = list(itertools.accumulate(math.sqrt(c) for _, c in top))
    bands = maxent.CLASSES - 2
    class_of = {0: 0, 1: 1} | {k: 2 + min(int(m * bands / mass[-1]), bands - 1) for k, m in enumerate(mass, 3)}
    whole, upto, part_of, sums = Counter(), Counter(), {0: 0, 1: 0}, Counter()
    for k, (_, c) in enumerate(top, 3):
        whole[class_of[k]] += math.sqrt(c)
    for k, (_, c) in enumerate(top, 3):
        upto[class_of[k]] += math.sqrt(c)
        part_of[k] = max(0, min(int(upto[class_of[k]] / whole[class_of[k]] * maxent.SUBS - 1e-9), maxent.SUBS - 1))
        sums[class_of[k], part_of[k]] += c + 0.5
    within = {k: math.log10((c + 0.5) / sums[class_of[k], part_of[k]]) for k, (_, c) in enumerate(top, 3)}

    def rows(back, last):
        flat = maxent.features(np.array([back, last, 0], np.int64))
        return [int(flat[k][2]) for k in range(4)]

    def places(words):
        flat = [2, 2] + [ids.get(w, 0) for w in words] + [1]
        return [(rows(flat[k - 2], flat[k - 1]), flat[k]) for k in range(2, len(flat))]

    weights, power = {}, {}
    row_of = lambda r: weights.setdefault(r, [0.0] * maxent.CLASSES)

    def softmax(at):
        z = [sum(x) for x in zip(*(row_of(r) for r in at))]
        e = [math.exp(x - max(z)) for x in z]
        return [x / sum(e) for x in e]

    inner, inner_row = {}, lambda r: inner.setdefault(r, [0.0] * maxent.SUBS)

    def inside(at, c):
        rows = maxent.part_features(np.array(at)[:, None], np.array([c]))[:, 0].tolist()
        z = [sum(x) if (c, j) in sums else -math.inf for j, x in enumerate(zip(*(inner_row(r) for r in rows)))]
        e = [math.exp(x - max(z)) for x in z]
        return rows, [x / sum(e) for x in e]

    for k in range(maxent.ROUNDS):
        power, inner_power = Counter(), Counter()
        met = [p for i, words, training in texts if training and parts[i] == k for p in places(words)]
        for first in range(0, len(met), maxent.BATCH):
            batch = met[first : first + maxent.BATCH]
            g = [[p - (c == class_of[word]) for c, p in enumerate(softmax(at))] for at, word in batch]
            bias = [sum(x) for x in zip(*g)]
            power[0] += sum(x * x for x in bias) / len(bias)
            weights[0] = [w - rate * x / math.sqrt(power[0] + 1) for w, x in zip(row_of(0), bias)]
            for f in (1, 2, 3):
                for (at, _), x in zip(batch, g):
                    power[at[f]] += sum(y * y for y in x) / len(x)
                for (at, _), x in zip(batch, g):
                    scale = rate / math.sqrt(power[at[f]] + 1)
                    weights[at[f]] = [w - scale * y for w, y in zip(row_of(at[f]), x)]
        words_only = [(at, word) for at, word in met if word > 2]
        for first in range(0, len(words_only), maxent.BATCH):
            batch = words_only[first : first + maxent.BATCH]
            told = [inside(at, class_of[word]) for at, word in batch]
            g = [[p - (j == part_of[word]) for j, p in enumerate(chance)] for (_, chance), (_, word) in zip(told, batch)]
            for f in range(4):
                for (rows_, _), x in zip(told, g):
                    inner_power[rows_[f]] += sum(y * y for y in x) / len(x)
                for (rows_, _), x in zip(told, g):
                    scale = rate / math.sqrt(inner_power[rows_[f]] + 1)
                    inner[rows_[f]] = [w - scale * y for w, y in zip(inner_row(rows_[f]), x)]
    rest_n, rest_v = n - sum(c for _, c in top) - sum(t for *_, t in texts), v - len(top) - 1
    count = Counter(w for _, words, training in texts if training for w in words)
    out = {}
    for i, words, _ in texts:
        score = 0.0
        for (at, word), raw in zip(places(words), [*words, None]):
            score += math.log10(softmax(at)[class_of[word]])
            if word > 2:
                score += within[word] + math.log10(inside(at, class_of[word])[1][part_of[word]])
            elif word == 0:
                score += math.log10((count[raw] + 0.5) / (rest_n + 0.5 * (rest_v + 1)))
        out[i] = score
    return out


def test_maxent_equals_plain_loops(spark, monkeypatch):
    monkeypatch.setattr(maxent, "VOCABULARY", 40)
    docs = frame(spark, [(i, t, "en", "s", 0) for i, t in enumerate([prose(k, 40) for k in range(40)] + [None, "", "unseen words only"])]).coalesce(1)
    rows = {r.doc_id: r for r in maxent.score(docs).collect()}
    parts = {r.doc_id: r.part for r in docs.select("doc_id", F.pmod(F.xxhash64(F.col("doc_id").cast("string"), F.lit("slice")), F.lit(maxent.ROUNDS)).alias("part")).collect()}
    texts = [(r.doc_id, (r.text or "").encode().lower().split(), zlib.crc32(str(r.doc_id).encode()) % 5 != 1) for r in docs.collect()]
    c = Counter(w for _, words, training in texts if training for w in words)
    cut = sorted(c.values(), reverse=True)[40]
    top = sorted(((w, k) for w, k in c.items() if k > cut), key=lambda x: (-x[1], x[0]))
    assert 0 < len(top) <= 40
    want = plain_maxent(texts, parts, top, sum(c.values()) + sum(t for *_, t in texts), len(c) + 1)
    for i, score in want.items():
        assert rows[i].score == pytest.approx(score, rel=1e-3)


def test_maxent_repeated_rows_and_long_texts(spark):
    long = prose(3, 150_000)
    docs = frame(spark, [(2, long, "en", "s", 0), (2, long, "en", "s", 0), (3, "a", None, None, None)]).withColumn("word", F.lit("clash")).withColumn("n", F.lit(1))
    rows = maxent.score(docs).collect()
    assert sorted((r.doc_id, r.n_tokens) for r in rows) == [(2, 150_001), (2, 150_001), (3, 2)]
    assert len({round(r.score, 6) for r in rows if r.doc_id == 2}) == 1


def test_maxent_is_a_distribution():
    top = [(b"a", 9), (b"b", 4), (b"c", 1)]
    known = maxent.Words(top, 20, 6, 3)
    sums = Counter()
    for word, k in known.ids.items():
        sums[known.classes[k], known.parts[k]] += 10 ** known.within[k]
    assert all(s == pytest.approx(1) for s in sums.values())
    assert {tuple(x) for x in np.argwhere(known.absent == 0)} == set(sums)
    classes = np.array([c for c, _ in sums])
    at = maxent.part_features(np.arange(4 * len(classes)).reshape(4, -1), classes)
    p = maxent.part_probabilities(np.random.default_rng(1).normal(size=(maxent.ROWS, maxent.SUBS)).astype(np.float32), at, known.absent[classes])
    assert np.allclose(p.sum(axis=1), 1) and (p[known.absent[classes] < 0] == 0).all()
    assert (known.n, known.v, known.rest_n, known.rest_v) == (23, 7, 6, 3)


def test_maxent_tells_thirty_bands_apart():
    known = maxent.Words([(b"w%d" % k, 5) for k in range(300)], 1500, 300, 3)
    assert len(set(known.classes[3:].tolist())) == 30


def least_cpu(*works, repeats=7):
    """Least CPU seconds of each of some functions, taken in turns."""
    least = [math.inf] * len(works)
    for _ in range(repeats):
        for k, work in enumerate(works):
            began = time.process_time()
            work()
            least[k] = min(least[k], time.process_time() - began)
    return least


def softmax_by_row(z):
    z -= z.max(axis=1, keepdims=True)
    np.exp(z, out=z)
    z /= z.sum(axis=1, keepdims=True)
    return z


def test_maxent_softmax_equals_a_plain_one_and_takes_less_time():
    draw = np.random.default_rng(4)
    weights = draw.normal(size=(maxent.ROWS, maxent.CLASSES)).astype(np.float32)
    at = np.concatenate([np.zeros((1, maxent.BATCH), np.int64), draw.integers(1, maxent.ROWS, (3, maxent.BATCH))])
    plain = lambda w: softmax_by_row(w[at[1]] + w[at[2]] + w[at[3]] + w[0])
    assert np.allclose(maxent.class_probabilities(weights, at), plain(weights), rtol=1e-4, atol=1e-9)
    ours, theirs = least_cpu(*[lambda f=f: [f() for _ in range(20)] for f in (lambda: maxent.class_probabilities(weights, at), lambda: plain(weights))])
    assert ours < 0.8 * theirs
    for shift in (-300, -60, 60, 300):  # beyond what float32 holds, of all rows or of one
        moved = weights.copy()
        moved[0] += shift
        assert np.allclose(maxent.class_probabilities(moved, at), plain(moved), rtol=1e-3, atol=1e-9)
        moved = weights.copy()
        moved[at[1, 0]] += shift
        assert np.allclose(maxent.class_probabilities(moved, at), plain(moved), rtol=1e-3, atol=1e-9)
    y = draw.integers(0, maxent.CLASSES, maxent.BATCH)
    for spread in (1, 400):
        z = (draw.normal(size=(maxent.BATCH, maxent.CLASSES)) * spread).astype(np.float32)
        wide = z.astype(np.float64)
        want = wide - wide.max(axis=1, keepdims=True)
        want = (want[np.arange(len(y)), y] - np.log(np.exp(want).sum(axis=1))) / math.log(10)
        assert np.allclose(maxent.log_chances(z, y), np.maximum(want, -30), rtol=1e-4, atol=1e-5)


def test_maxent_steps_equal_plain_ones_and_take_less_time():
    draw = np.random.default_rng(5)
    n = 3 * maxent.BATCH + 17
    at = np.concatenate([np.zeros((1, n), np.int64), 1 + (draw.random((3, n)) ** 3 * (maxent.ROWS - 1)).astype(np.int64)])
    y, rate = draw.integers(0, maxent.CLASSES, n), 0.1

    def plain(weights, power):
        cells, columns = weights.reshape(-1), np.arange(maxent.CLASSES)
        for k in range(0, n, maxent.BATCH):
            rows, target = at[:, k : k + maxent.BATCH], y[k : k + maxent.BATCH]
            g = softmax_by_row(weights[rows[1]] + weights[rows[2]] + weights[rows[3]] + weights[0])
            g[np.arange(len(target)), target] -= 1
            total = g.sum(axis=0)
            power[0] += (total * total).mean()
            weights[0] -= rate * total / np.sqrt(power[0] + 1)
            size = (g * g).mean(axis=1)
            for row in rows[1:]:
                np.add.at(power, row, size)
                step = g * (-rate / np.sqrt(power[row] + 1)).astype(np.float32)[:, None]
                np.add.at(cells, (row[:, None] * maxent.CLASSES + columns).reshape(-1), step.reshape(-1))

    empty = lambda: (np.zeros((maxent.ROWS, maxent.CLASSES), np.float32), np.zeros(maxent.ROWS, np.float32))
    (w, p), (own, own_power) = empty(), empty()
    plain(w, p)
    maxent.train(maxent.Steps(own, own_power, rate), at, y)
    assert np.allclose(own, w, atol=1e-5) and np.allclose(own_power, p, rtol=1e-4) and np.abs(w).max() > 0.1
    steps = maxent.Steps(*empty(), rate)
    ours, theirs = least_cpu(lambda: maxent.train(steps, at, y), lambda: plain(w, p))
    assert ours < 0.9 * theirs


def test_license_scan(spark):
    texts = ["Released under the MIT License.", "x " * 70 + "this work IS licensed, under: the gnu general public license version 3", "CC BY cc-by CC BY", None, "", "mit apache license license", "under the license", "é " * 50 + "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met"]
    docs = frame(spark, [(i, t, "en", "s", 0) for i, t in enumerate(texts)]).withColumn("token", F.lit("clash")).withColumn("label", F.lit(1))
    rows = {r.doc_id: r for r in licenses.scan(docs, queries.LICENSE_PHRASES, queries.LICENSE_TEMPLATES).collect()}
    assert (rows[0].n_words, rows[0].n_base, rows[0].first_word, rows[0].labels, rows[0].score) == (5, 1, 3, "mit", 1.0)
    assert (rows[1].first_word, rows[1].base_labels, rows[1].labels) == (76, "gpl", "gpl")
    assert (rows[2].n_base, rows[2].first_word, rows[2].last_word) == (3, 0, 4)
    assert all((rows[i].n_words, rows[i].n_base, rows[i].first_word, rows[i].labels, rows[i].score) == (0, 0, None, "", 0.0) for i in (3, 4))
    assert rows[5].labels == "apache" and rows[6].labels == "" and (rows[7].base_labels, rows[7].labels) == ("", "bsd")
    assert licenses.scan(docs.limit(0), queries.LICENSE_PHRASES, queries.LICENSE_TEMPLATES).count() == 0


def test_both_sides_of_the_license_join_agree(spark, corpus, monkeypatch):
    docs = frame(spark, [(k, f"{prose(k, 40)} {text} {prose(k + 50, 30)}", "en", "s", 0) for k, (_, text) in enumerate(queries.LICENSE_TEMPLATES)] + [(99, prose(9, 60), "en", "s", 0), (100, None, "en", "s", 0)])
    want = sorted(map(tuple, licenses.scan(docs, queries.LICENSE_PHRASES, queries.LICENSE_TEMPLATES).collect()))
    monkeypatch.setattr(licenses, "BROADCAST_ROWS", 0)
    assert sorted(map(tuple, licenses.scan(docs, queries.LICENSE_PHRASES, queries.LICENSE_TEMPLATES).collect())) == want and len(want) == len(queries.LICENSE_TEMPLATES) + 2


def test_license_templates_of_any_length(spark):
    draw = random.Random(3)
    notices = {n: " ".join(f"{draw.choice(LOREM)}{draw.randrange(60)}" for _ in range(n)) for n in (20, 60, 200)}
    texts = [f"{prose(k, 37 * k)} {text} {prose(k + 9, 50)}" for k, text in enumerate(notices.values(), 1)] + [notices[200][:300], prose(1, 500)]
    docs = frame(spark, [(i, t, "en", "s", 0) for i, t in enumerate(texts)])
    rows = {r.doc_id: r for r in licenses.scan(docs, {}, [(f"n{n}", text) for n, text in notices.items()]).collect()}
    assert [rows[i].labels for i in range(5)] == ["n20", "n60", "n200", "", ""] and all(rows[i].score >= 0.9 for i in range(3))


def test_empty_tables(spark, corpus):
    none = corpus.limit(0)
    assert minhash.near_duplicates(none).count() == 0
    assert bpe.round_trip(none, PATH, PATTERN).count() == 0
    assert lengths.length_histogram(lengths.encoded_lengths(none, PATH, PATTERN)).count() == 0
    assert pii.report(none).count() == 0
    assert maxent.score(none).count() == 0


def test_every_operator_is_registered():
    names = set(queries.__dict__)
    assert all(any(n.startswith(f"op{k}_") for n in names) for k in range(1, 14))
    assert public_tokenizers.PATTERN == PATTERN


def test_whole_notices_inside_texts(spark):
    whole = [(label, text) for label, text in queries.LICENSE_TEMPLATES if len(text.split()) > 30]
    texts = {k: f"{prose(k, 300)} {text} {prose(k + 50, 300)}" for k, (_, text) in enumerate(whole)}
    # a third holds too little of the notice
    texts |= {100 + k: f"{prose(k, 500)} " + " ".join(text.split()[: len(text.split()) // 3]) for k, (_, text) in enumerate(whole)}
    docs = frame(spark, [(k, t, "en", "s", 0) for k, t in texts.items()] * 2)
    rows = licenses.scan(docs, {}, whole).collect()
    assert len(rows) == 2 * len(texts)
    for r in rows:
        words, want = licenses.license_words(texts[r.doc_id]), set()
        for label, template in whole:
            step, tokens = licenses.step_of(template), set(licenses.license_words(template))
            for k in range(0, max(1, len(words) - step), step):
                if len(tokens.intersection(words[k : k + 2 * step])) >= 0.9 * len(tokens) - 1e-9:
                    want.add(label)
        assert set(r.labels.split(",")) - {""} == want
        assert r.doc_id >= 100 or whole[r.doc_id][0] in want
