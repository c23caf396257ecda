"""Near-duplicates: MinHash with banding, verified, as connected components.

1. Each text's set of word shingles gives ``BANDS * ROWS`` minima of
   multiply-add-shift hash functions (a universal family), a key for each band,
   and the low byte of every minimum as its signature. Texts with equal sets
   form a class; the smallest id stands for it, so copies are never paired.
2. Every band bucket with more than one class ties its classes to one of them,
   the hub, which a hash picks anew for each bucket. A row makes one edge for
   each band at most, however large its bucket is. Edges whose signatures are
   too far apart for the threshold are dropped.
3. The closest edge of every class is confirmed on the full sets; then that of
   every component to another one, ``CLOSEST`` times over; then all edges that
   still join different components. Edges within a component aren't needed.
4. Components come from alternating large-star and small-star, over the
   confirmed edges in the first turn and over pairs of components in the later
   ones, so that a large group costs its members once.
5. Buckets that still hold classes of different components make up the
   neighbourhood of their largest component. Classes outside it are compared
   with everything in its neighbourhood, a block of bounded size with a block:
   signatures first, then whole sets where those allow a link. A block pair
   yields one link for each two components it joins. The blocks of a
   neighbourhood are dealt to many tasks by a salt.

With 50 bands of 6 rows a pair at similarity 0.8 shares no bucket with
probability 2.5e-7, and the signature estimate lies under ``SLACK`` below the
threshold with less than 1e-6. Equal sets are told by a 128-bit digest of their
64-bit shingle hashes; all other links are confirmed on the words themselves.
The comparisons of step 5 grow with the square of a neighbourhood only as far as
its classes neither link nor fall into one component; they emit nothing then.

Texts without words link with nothing and stand alone; texts with fewer words
than a shingle have their whole sequence as one shingle. Null ids are returned
with a null component, not kept, and link with nothing. Repeated rows are one
document and are all returned alike.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import map_rows, stored, words
from .components import connected_components

BANDS, ROWS = 50, 6
SLACK = 0.12
KNOWN_WORDS = 250_000
CLOSEST = 2  # turns in which each component tries its closest edge alone
BLOCK, BLOCK_SHINGLES = 256, 65_536  # about so many documents or shingles are compared with as many at once
BLOCKS_IN_TASK = 8
_CHUNK = 256
_MIX = np.uint64(0x9E3779B97F4A7C15)  # 2^64 / golden ratio, odd


class Shingler:
    """64-bit hashes of word shingles; keeps hashes of up to KNOWN_WORDS words."""

    def __init__(self, size: int):
        self.size, self.known = size, {}

    def word_hashes(self, found: list[bytes]) -> np.ndarray:
        known = self.known
        if len(known) > KNOWN_WORDS:
            known.clear()
        for w in set(found).difference(known):
            known[w] = xxhash.xxh3_64_intdigest(w)
        return np.fromiter(map(known.__getitem__, found), np.uint64, len(found))

    def hashes(self, found: list[bytes]) -> np.ndarray:
        """Sorted distinct shingle hashes."""
        h = self.word_hashes(found)
        size = min(self.size, len(h))
        if not size:
            return h
        total = np.full(len(h) - size + 1, size, np.uint64)
        for i in range(size):
            total = (total ^ h[i : len(h) - size + 1 + i]) * _MIX
            total ^= total >> np.uint64(29)
        return np.unique(total)


class Minima:
    """Band keys and signature bytes of a set."""

    def __init__(self, seed: int = 1):
        draw = np.random.default_rng(seed)
        n = BANDS * ROWS
        self.a = draw.integers(1, 1 << 63, n, np.uint64)[:, None] * np.uint64(2) + np.uint64(1)
        self.b = draw.integers(0, 1 << 63, n, np.uint64)[:, None]
        self.room = np.empty((n, _CHUNK), np.uint64)
        self.band = np.arange(BANDS, dtype=np.uint64)

    def __call__(self, hashes: np.ndarray) -> tuple[np.ndarray, bytes]:
        least = None
        for k in range(0, len(hashes), _CHUNK):
            x = hashes[k : k + _CHUNK] >> np.uint64(32)
            room = self.room[:, : len(x)]
            np.multiply(self.a, x, out=room)
            np.add(room, self.b, out=room)
            low = room.min(axis=1)
            least = low if least is None else np.minimum(least, low)
        least >>= np.uint64(32)
        key = self.band
        for row in least.reshape(BANDS, ROWS).T:
            key = (key ^ row) * _MIX
            key = key ^ (key >> np.uint64(32))
        return key.view(np.int64), (least & np.uint64(255)).astype(np.uint8).tobytes()


def signatures(docs: DataFrame, shingle: int, id_column: str, text_column: str) -> DataFrame:
    """(id, n_shingles, set_id, bands, bits); the last three null without words."""

    def each():
        shingler, minima = Shingler(shingle), Minima()

        def one(text):
            hashes = shingler.hashes(words(text))
            if not len(hashes):
                return 0, None, None, None
            keys, bits = minima(hashes)
            return len(hashes), xxhash.xxh3_128_digest(hashes.tobytes()), keys, bits

        def work(key, text):
            n, sets, bands, bits = (list(x) for x in zip(*map(one, text))) if text else ([],) * 4
            return {"id": key, "n_shingles": n, "set_id": sets, "bands": bands, "bits": bits}

        return work

    kind = docs.schema[id_column].dataType.simpleString()
    return map_rows(docs, f"id {kind}, n_shingles long, set_id binary, bands array<long>, bits binary", each, id_column, text_column)


def _estimated(pairs: DataFrame, sets: DataFrame, least: float) -> DataFrame:
    """Pairs (a, b) with the estimate of their similarity, where it may reach ``least`` and the sizes allow it."""
    side = lambda c: sets.select(F.col("id").alias(c), F.col("bits").alias(f"bits_{c}"), F.col("n_shingles").alias(f"n_{c}"))
    met = pairs.join(side("a"), "a").join(side("b"), "b").where(F.least("n_a", "n_b") >= least * F.greatest("n_a", "n_b"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            x, y = (np.frombuffer(b"".join(batch.column(i).to_pylist()), np.uint8).reshape(batch.num_rows, -1) for i in (2, 3))
            equal = (x == y).mean(axis=1)
            estimate = (equal - 1 / 256) / (1 - 1 / 256)  # bytes agree by chance, too
            out = pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(estimate, pa.float64())], ["a", "b", "estimate"])
            yield out.filter(pa.array(estimate >= least - SLACK))

    kind = pairs.schema["a"].dataType.simpleString()
    return met.select("a", "b", "bits_a", "bits_b").mapInArrow(run, f"a {kind}, b {kind}, estimate double").distinct()


def _confirmed(pairs: DataFrame, texts: DataFrame, shingle: int, percent: int) -> DataFrame:
    """Pairs whose full shingle sets have 100 * intersection >= percent * union."""
    side = lambda c: texts.select(F.col("id").alias(c), F.col("text").alias(f"text_{c}"))

    def each():
        def shingles(text):
            w = words(text)
            return set(zip(*(w[i:] for i in range(shingle)))) if len(w) >= shingle else {tuple(w)}

        def linked(x, y):
            x, y = shingles(x), shingles(y)
            both = len(x & y)
            return 100 * both >= percent * (len(x) + len(y) - both)

        return lambda a, b, x, y: {"a": a, "b": b, "linked": [linked(*t) for t in zip(x, y)]}

    kind = pairs.schema["a"].dataType.simpleString()
    met = pairs.select("a", "b").join(side("a"), "a").join(side("b"), "b")
    return map_rows(met, f"a {kind}, b {kind}, linked boolean", each, "a", "b", "text_a", "text_b").where("linked").select("a", "b").distinct()


def _between(pairs: DataFrame, components: DataFrame | None) -> DataFrame:
    """Pairs whose ends lie in different components, with those as c_a and c_b."""
    if components is None:
        return pairs.withColumns({"c_a": F.col("a"), "c_b": F.col("b")})
    of = lambda c: components.select(F.col("id").alias(c), F.col("component").alias(f"c_{c}"))
    met = pairs.drop("c_a", "c_b").join(of("a"), "a", "left").join(of("b"), "b", "left")
    return met.withColumns({f"c_{c}": F.coalesce(f"c_{c}", c) for c in "ab"}).where("c_a != c_b")


def _closest(between: DataFrame) -> DataFrame:
    """(a, b): the best edge of every component."""
    ends = between.select(F.explode(F.array("c_a", "c_b")).alias("x"), F.struct("estimate", "a", "b").alias("e"))
    return ends.groupBy("x").agg(F.max("e").alias("e")).select("e.a", "e.b").distinct()


def _grown(components: DataFrame | None, links: DataFrame) -> DataFrame:
    """Components with these links added: whole components are tied, not their members."""
    if components is None:
        return connected_components(links)
    tied = connected_components(_between(links, components).select(F.col("c_a").alias("a"), F.col("c_b").alias("b")))
    moved = components.join(tied.select(F.col("id").alias("component"), F.col("component").alias("__to")), "component", "left")
    return stored(moved.select("id", F.coalesce("__to", "component").alias("component")).unionByName(tied))


def _blocks(places: DataFrame) -> DataFrame:
    """Adds ``block``: places are dealt to as many blocks as their number and shingles ask for."""
    sizes = places.groupBy("around").agg(F.count(F.lit(1)).alias("__n"), F.sum("n_shingles").alias("__s"))
    blocks = F.ceil(F.greatest(F.col("__n") / BLOCK, F.col("__s") / BLOCK_SHINGLES))
    return places.join(sizes, "around").withColumn("block", F.pmod(F.xxhash64("id"), blocks)).withColumn("blocks", blocks).drop("__n", "__s")


def _across(places: DataFrame, sets: DataFrame, texts: DataFrame, shingle: int, percent: int) -> DataFrame:
    """Linked pairs (a, b) of different components. ``places`` (around, id,
    component) names the ids of each neighbourhood; those outside the component
    that it is named for are compared with all of it. Only links leave a task."""
    least = percent / 100

    def each():
        shingler = Shingler(shingle)
        return lambda key, text: {"id": key, "h": [shingler.hashes(words(t)).tobytes() for t in text]}

    kind = texts.schema["id"].dataType.simpleString()
    near = texts.join(places.select("id").distinct(), "id", "left_semi").dropDuplicates(["id"])
    hashed = map_rows(near, f"id {kind}, h binary", each, "id", "text")
    hashed = stored(hashed.join(sets.select("id", "n_shingles", "bits").dropDuplicates(["id"]), "id"))
    sized = stored(places.join(hashed.select("id", "n_shingles"), "id"))
    packed = lambda blocks, name: blocks.join(hashed.select("id", "bits", "h"), "id").groupBy("around", "block").agg(F.max("blocks").alias("blocks"), F.collect_list(F.struct("id", "component", "bits", "h")).alias(name))
    inner = packed(_blocks(sized), "members")
    outer = packed(_blocks(sized.where("component != around")), "others")
    # a task takes some blocks of outsiders with one of the members, and members go to as many salts
    salts = lambda blocks: F.ceil(blocks / BLOCKS_IN_TASK)
    dealt = outer.select("around", "others", F.pmod("block", salts(F.col("blocks"))).alias("salt"))
    shares = outer.groupBy("around").agg(F.max("blocks").alias("outside"))
    copies = inner.join(shares, "around").select("around", "members", F.explode(F.sequence(F.lit(0).cast("long"), salts(F.col("outside")) - 1)).alias("salt"))

    def linked(ours: list[dict], theirs: list[dict]) -> list[tuple]:
        x, y = ([np.frombuffer(m["h"], np.uint64) for m in side] for side in (ours, theirs))
        n_x, n_y = (np.array([len(h) for h in side]) for side in (x, y))
        bits = np.frombuffer(b"".join(m["bits"] for m in theirs), np.uint8).reshape(len(theirs), -1)
        enough = bits.shape[1] * ((least - SLACK) * 255 / 256 + 1 / 256)
        joined: dict = {}

        def root(c):
            while c in joined:
                c = joined[c]
            return c

        found = []
        for i, m in enumerate(ours):
            able = 100 * np.minimum(n_x[i], n_y) >= percent * np.maximum(n_x[i], n_y)
            at = np.flatnonzero(able)
            at = at[(bits[at] == np.frombuffer(m["bits"], np.uint8)).sum(axis=1) >= enough]
            for j in at.tolist():
                one, two = root(m["component"]), root(theirs[j]["component"])
                if one == two:
                    continue
                both = len(np.intersect1d(x[i], y[j], assume_unique=True))
                if 100 * both >= percent * (n_x[i] + n_y[j] - both):
                    joined[one] = two
                    found.append(tuple(sorted((m["id"], theirs[j]["id"]))))
        return found

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            id_type = batch.column(0).type.value_type.field("id").type
            for k in range(batch.num_rows):
                found = linked(batch.column(0)[k].as_py(), batch.column(1)[k].as_py())
                yield pa.RecordBatch.from_arrays([pa.array([p[c] for p in found], id_type) for c in (0, 1)], ["a", "b"])

    return dealt.join(copies, ["around", "salt"]).select("others", "members").mapInArrow(run, f"a {kind}, b {kind}").distinct()


def near_duplicates(docs: DataFrame, shingle: int = 5, percent: int = 80, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """(id, n_shingles, component_id, kept) of every document. Documents link if
    100 * intersection >= percent * union of their shingle sets; component_id is
    the smallest id reachable, and its document is kept."""
    least = percent / 100
    sets = stored(signatures(docs, shingle, id_column, text_column))
    able = sets.where("id is not null and set_id is not null")
    classes = stored(able.groupBy("set_id").agg(F.min("id").alias("first")))
    stand = able.join(classes.select(F.col("first").alias("id")), "id", "left_semi")

    rows = stand.select("id", F.explode("bands").alias("key"))
    hubs = rows.groupBy("key").agg(F.min("id").alias("lo"), F.max("id").alias("hi"), F.min_by("id", F.xxhash64("id", "key")).alias("hub")).where("lo != hi")
    shared = stored(rows.join(hubs.select("key", "hub"), "key"))
    tested = stored(shared.where("id != hub").select(F.least("id", "hub").alias("a"), F.greatest("id", "hub").alias("b")).distinct())
    edges = stored(_estimated(tested, able.select("id", "bits", "n_shingles"), least))
    texts = stored(docs.select(F.col(id_column).alias("id"), F.col(text_column).alias("text")).join(shared.select("id").distinct(), "id", "left_semi"))

    parts = None
    for turn in range(CLOSEST + 2):
        edges = stored(_between(edges, parts))
        if turn and edges.isEmpty():
            break
        chosen = stored(_closest(edges)) if turn <= CLOSEST else edges
        parts = _grown(parts, stored(_confirmed(chosen, texts, shingle, percent)))
        edges = edges.join(chosen.select("a", "b"), ["a", "b"], "left_anti")

    held = shared.select("key", "id").join(parts, "id", "left").withColumn("component", F.coalesce("component", "id"))
    counts = held.groupBy("key", "component").agg(F.count(F.lit(1)).alias("n"))
    mixed = counts.groupBy("key").agg(F.max_by("component", F.struct("n", "component")).alias("main"), F.sum("n").alias("size"), F.count(F.lit(1)).alias("parts")).where("parts > 1 and size > 2")
    places = stored(held.join(mixed.select("key", F.col("main").alias("around")), "key").select("around", "id", "component").distinct())
    near = stored(_across(places, able, texts, shingle, percent))
    if not near.isEmpty():
        parts = _grown(parts, stored(_confirmed(near, texts, shingle, percent)))

    named = classes.join(parts.withColumnRenamed("id", "first"), "first", "left").select("set_id", F.coalesce("component", "first").alias("least"))
    out = sets.select("id", "n_shingles", "set_id").join(named, "set_id", "left")
    component = F.when(F.col("id").isNotNull(), F.coalesce("least", "id"))
    return out.select(F.col("id").alias(id_column), "n_shingles", component.alias("component_id"), F.coalesce(F.col("id") == component, F.lit(False)).alias("kept"))
