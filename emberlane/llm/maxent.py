"""Language-model scoring: a hashed maximum-entropy model with word classes.

p(word | text before) = p(class | features) * p(part | class, features) *
p(word | part). The classes of the ``vocabulary`` most frequent words come from
their frequencies (equal sums of square roots), and so do the ``SUBS`` parts of
each class; all other words share one class, and the end of a text has its own.
Features are the last word, the one before it (a skip feature) and both
together, and a bias: for the class softmax hashed to ``ROWS`` rows of a weight
matrix, for the softmax over a class's parts hashed with the class to as many rows
of another. Both are trained. Within a part only a bias for each word is used,
whose maximum-likelihood weights are counts; half a count is added to each, and
half for all words never seen.

Training takes every training text once, in ``rounds`` disjoint slices: each
task runs mini-batch gradient steps on its part of a slice from the broadcast
weights and returns its change of each block of rows; changes are averaged by
block in Spark, weighted by tokens, and the new weights broadcast.

The vocabulary is cut where words begin to tie: words as frequent as the first
one beyond ``vocabulary`` are all left out. Where the cut lies is read from a
histogram of counts, so only the vocabulary itself reaches the driver.

The order in which texts are met is part of stochastic gradient descent: the
same texts dealt to other tasks give slightly other weights, and so scores. The
base columns don't depend on it.

Counts of all words are kept in a table. Texts are scored in sparse batches
with the weights and the vocabulary, whose sizes are parameters; occurrences of
all other words, wherever they are many, meet their counts in a join.

The split of training and held-out texts is crc32(id as text) mod 5. Null ids
count as empty text there; null and empty texts are an end alone. Repeated rows
are scored each by itself.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from itertools import chain, repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import map_rows, sliced, stored, words

VOCABULARY = 200_000
CLASSES = 32
SUBS = 16
ROWS = 1 << 14
ROUNDS = 4
BATCH = 2048
TOKENS_AT_ONCE = 200_000
FLUSH = 300_000
BLOCK = 512
UNKNOWN, END, BEGIN = 0, 1, 2  # word ids; others follow


def held_out(key: Column) -> Column:
    return F.crc32(F.coalesce(key.cast("string"), F.lit("")).cast("binary")) % 5 == 1


def word_counts(texts: DataFrame, column: str) -> DataFrame:
    """(word binary, n): occurrences of every word, added up in tasks first; the
    null word has the number of texts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts: Counter = Counter()

        def rows():
            out = pa.RecordBatch.from_arrays([pa.array(list(counts), pa.binary()), pa.array(list(counts.values()), pa.int64())], ["word", "n"])
            counts.clear()
            return out

        texts = 0
        for batch in batches:
            texts += batch.num_rows
            for part in sliced(batch):
                for text in part.column(0).to_pylist():
                    counts.update(words(text))
                    if len(counts) > FLUSH:
                        yield rows()
        counts[None] = texts
        yield rows()

    return texts.select(column).mapInArrow(run, "word binary, n long").groupBy("word").agg(F.sum("n").alias("n"))


class Words:
    """Ids, classes, parts and within-part log10 probabilities of the vocabulary."""

    def __init__(self, top: list[tuple[bytes, int]], total: int, distinct: int, texts: int):
        self.ids = {w: k for k, (w, _) in enumerate(top, 3)}
        c = np.array([n for _, n in top], np.float64)
        mass = np.cumsum(np.sqrt(c))
        self.classes = np.zeros(len(top) + 3, np.int64)
        self.classes[END] = 1
        if len(top):
            self.classes[3:] = 2 + np.minimum((mass * (CLASSES - 2) / mass[-1]).astype(np.int64), CLASSES - 3)
        self.n, self.v = total + texts, distinct + (texts > 0)
        # parts of equal mass within each class; words are in order, so a class is a run of them
        self.parts = np.zeros(len(top) + 3, np.int64)
        mine = self.classes[3:]
        if len(top):
            totals = np.bincount(mine, np.sqrt(c), CLASSES)
            before = np.concatenate([[0.0], np.cumsum(totals)[:-1]])
            inside = (mass - before[mine]) / totals[mine]
            self.parts[3:] = np.clip((inside * SUBS - 1e-9).astype(np.int64), 0, SUBS - 1)
        cells = mine * SUBS + self.parts[3:]
        sums = np.bincount(cells, c + 0.5, CLASSES * SUBS)
        self.within = np.zeros(len(top) + 3)
        self.within[3:] = np.log10((c + 0.5) / sums[cells])
        self.absent = np.where(sums.reshape(CLASSES, SUBS) > 0, np.float32(0), np.float32(-1e30))
        self.base = np.zeros(len(top) + 3)
        floor = self.n + 0.5 * (self.v + 1)
        self.base[3:] = np.log10((c + 0.5) / floor)
        self.base[END] = np.log10((texts + 0.5) / floor)
        self.rest_n, self.rest_v = total - int(c.sum()), distinct - len(top)
        self.end_known = texts > 0

    def encode(self, texts: list[list[bytes]]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts, each after two BEGINs and with an END, and the ENDs' places."""
        sizes = np.fromiter(map(len, texts), np.int64, len(texts))
        ends = np.cumsum(sizes + 3) - 1
        flat = np.full(int(ends[-1]) + 1 if len(texts) else 0, BEGIN, np.int64)
        flat[ends] = END
        inside = np.ones(len(flat), bool)
        inside[ends] = False
        starts = ends - sizes - 2
        inside[starts] = inside[starts + 1] = False
        flat[inside] = np.fromiter(map(self.ids.get, chain.from_iterable(texts), repeat(UNKNOWN)), np.int64, int(sizes.sum()))
        return flat, ends


def features(flat: np.ndarray) -> np.ndarray:
    """Rows of the weight matrix for each place: bias, last word, the one before, both."""
    one, two = np.zeros_like(flat), np.zeros_like(flat)
    one[1:], two[2:] = flat[:-1], flat[:-2]
    mix = lambda x, salt: ((x * 0x9E3779B1 + salt) * 0x85EBCA6B >> 17) % (ROWS - 1) + 1
    return np.stack([np.zeros_like(flat), mix(one, 11), mix(two, 23), mix(one * 1_000_003 + two, 37)])


def part_features(at: np.ndarray, classes: np.ndarray) -> np.ndarray:
    """Rows of the parts' weights: a bias for each class, and the features with the class."""
    mixed = ((at[1:] * 0x9E3779B1 + classes * 0x7FEB352D + 101) * 0x85EBCA6B >> 17) % (ROWS - CLASSES) + CLASSES
    return np.concatenate([classes[None], mixed])


def exponentials(z: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """exp(z) and its sums by row. Only where float32 can't hold these, rows' maxima are taken off ``z`` first, in place."""
    with np.errstate(over="ignore"):
        e = np.exp(z)
    sums = np.einsum("ij->i", e)
    if not (sums > 1e-20).all() or not (sums < 1e20).all():
        z -= z.max(axis=1, keepdims=True)
        e = np.exp(z)
        sums = e.sum(axis=1)
    return e, sums


def log_chances(z: np.ndarray, y: np.ndarray) -> np.ndarray:
    """log10 of the softmax of each row of ``z`` at its column ``y``, -30 at least."""
    sums = exponentials(z)[1]
    return np.maximum((z[np.arange(len(y)), y] - np.log(sums)) * np.log10(np.e), -30)


def probabilities(z: np.ndarray) -> np.ndarray:
    e, sums = exponentials(z)
    e /= sums[:, None]
    return e


def part_logits(weights: np.ndarray, at: np.ndarray, absent: np.ndarray) -> np.ndarray:
    z = weights.take(at[0], 0)
    z += absent
    for row in at[1:]:
        z += weights.take(row, 0)
    return z


def part_probabilities(weights: np.ndarray, at: np.ndarray, absent: np.ndarray) -> np.ndarray:
    return probabilities(part_logits(weights, at, absent))


def class_logits(weights: np.ndarray, at: np.ndarray) -> np.ndarray:
    z = weights.take(at[1], 0)
    z += weights.take(at[2], 0)
    z += weights.take(at[3], 0)
    z += weights[0]
    return z


def class_probabilities(weights: np.ndarray, at: np.ndarray) -> np.ndarray:
    return probabilities(class_logits(weights, at))


class Steps:
    """Adds scaled gradients to rows of ``weights`` in place; ``power`` holds the rows' summed squared gradients."""

    def __init__(self, weights: np.ndarray, power: np.ndarray, rate: float):
        self.weights, self.power, self.rate = weights, power, rate
        # two neighbouring weights are one complex cell: the same sums by half as many additions
        self.cells = weights.reshape(-1).view(np.complex64)
        self.places = np.arange(len(self.cells)).reshape(len(weights), -1)

    def add(self, rows: np.ndarray, g: np.ndarray) -> None:
        size = np.einsum("ij,ij->i", g, g) / g.shape[1]
        for row in rows:
            np.add.at(self.power, row, size)
            step = g * (-self.rate / np.sqrt(self.power[row] + 1)).astype(np.float32)[:, None]
            np.add.at(self.cells, self.places.take(row, 0).reshape(-1), step.reshape(-1).view(np.complex64))


def train_parts(steps: Steps, at: np.ndarray, classes: np.ndarray, target: np.ndarray, absent: np.ndarray) -> None:
    """Mini-batch steps on the parts of words that have one."""
    for k in range(0, len(target), BATCH):
        rows, y = at[:, k : k + BATCH], target[k : k + BATCH]
        g = part_probabilities(steps.weights, rows, absent.take(classes[k : k + BATCH], 0))
        g[np.arange(len(y)), y] -= 1
        steps.add(rows, g)


def train(steps: Steps, at: np.ndarray, target: np.ndarray) -> None:
    """Mini-batch steps on the classes."""
    weights, power = steps.weights, steps.power
    for k in range(0, len(target), BATCH):
        rows, y = at[:, k : k + BATCH], target[k : k + BATCH]
        g = class_probabilities(weights, rows)
        g[np.arange(len(y)), y] -= 1
        total = g.sum(axis=0)  # of the bias
        power[0] += (total * total).mean()
        weights[0] -= steps.rate * total / np.sqrt(power[0] + 1)
        steps.add(rows[1:], g)


def _chunks(texts: list[str | None]) -> Iterator[tuple[int, list[list[bytes]]]]:
    """(first text, words of each) with about TOKENS_AT_ONCE words together."""
    first, held, size = 0, [], 0
    for k, text in enumerate(texts):
        held.append(words(text))
        size += len(held[-1])
        if size >= TOKENS_AT_ONCE or k == len(texts) - 1:
            yield first, held
            first, held, size = k + 1, [], 0


def _round(slice_: DataFrame, vocabulary, weights, column: str, rate: float) -> DataFrame:
    """(block, n, change binary): every task's change of each block of rows, times its tokens, summed."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, begun = vocabulary.value, weights.value
        own, n = [w.copy() for w in begun], 0
        steps = [Steps(w, np.zeros(ROWS, np.float32), rate) for w in own]
        for batch in (part for whole in batches for part in sliced(whole)):
            for _, held in _chunks(batch.column(0).to_pylist()):
                flat, _ = known.encode(held)
                real = flat != BEGIN
                ids = flat[real]
                at, classes = features(flat)[:, real], known.classes[ids]
                train(steps[0], at, classes)
                told = np.flatnonzero(classes > 1)
                within = part_features(at.take(told, 1), classes[told])
                train_parts(steps[1], within, classes[told], known.parts[ids[told]], known.absent)
                n += int(real.sum())
        if n:
            changes = [((a - b) * n).astype(np.float32) for a, b in zip(own, begun)]
            blocks = [c[b : b + BLOCK].tobytes() for c in changes for b in range(0, ROWS, BLOCK)]
            yield pa.RecordBatch.from_arrays([pa.array(range(len(blocks)), pa.int32()), pa.array([n] * len(blocks), pa.int64()), pa.array(blocks, pa.binary())], ["block", "n", "change"])

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[int, list] = {}
        for batch in batches:
            for block, n, change in zip(*(c.to_pylist() for c in batch.columns)):
                added = np.frombuffer(change, np.float32)
                held = sums.setdefault(block, [0, np.zeros(len(added), np.float64)])
                held[0] += n
                held[1] += added
        yield pa.RecordBatch.from_arrays([pa.array(list(sums), pa.int32()), pa.array([v[0] for v in sums.values()], pa.int64()), pa.array([v[1].astype(np.float32).tobytes() for v in sums.values()], pa.binary())], ["block", "n", "change"])

    schema = "block int, n long, change binary"
    tasks = slice_.select(column).mapInArrow(run, schema)
    # adding up goes block by block over the rows that arrive; nothing but a sum for each block is held
    return tasks.repartition("block").mapInArrow(add, schema)


def most_frequent(counts: DataFrame, most: int) -> list[tuple[bytes, int]]:
    """At most ``most`` words, in order of falling counts; words whose counts
    share a bin of the histogram stay or go together. Bins are single counts up
    to 1,024 and a 64th of a doubling beyond, so there are a few thousand."""
    level = F.when(F.col("n") < 1024, F.col("n")).otherwise(F.floor(F.log2("n") * 64) + 384)
    levels = counts.groupBy(level.alias("level")).agg(F.count(F.lit(1)).alias("words")).collect()
    least, held = 0, 0
    for row in sorted(levels, reverse=True):
        held += row.words
        if held > most:
            least = row.level + 1
            break
    top = counts.where(level >= least).collect()  # at most ``most`` rows
    return sorted(((bytes(r.word), r.n) for r in top), key=lambda x: (-x[1], x[0]))


def fit(docs: DataFrame, id_column: str, text_column: str, rounds: int = ROUNDS, rate: float = 0.1):
    """(counts table, broadcast vocabulary, broadcast weights of classes and parts)."""
    spark = docs.sparkSession
    training = docs.where(~held_out(F.col(id_column)))
    counted = stored(word_counts(training, text_column))
    counts = counted.where("word is not null")
    texts = counted.where("word is null").agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    total, distinct = counts.agg(F.coalesce(F.sum("n"), F.lit(0)), F.count(F.lit(1))).first()
    vocabulary = spark.sparkContext.broadcast(Words(most_frequent(counts, VOCABULARY), total, distinct, texts))
    weights = [np.zeros((ROWS, CLASSES), np.float32), np.zeros((ROWS, SUBS), np.float32)]
    part = F.pmod(F.xxhash64(F.col(id_column).cast("string"), F.lit("slice")), F.lit(rounds))
    for k in range(rounds):
        sent = spark.sparkContext.broadcast(weights)
        changes = _round(training.where(part == k), vocabulary, sent, text_column, rate).collect()  # one row a block: the weights' size
        weights = [w.copy() for w in weights]
        for row in changes:
            if row.n:
                of, block = divmod(row.block, ROWS // BLOCK)
                held = weights[of][block * BLOCK : (block + 1) * BLOCK]
                held += np.frombuffer(row.change, np.float32).reshape(held.shape) / row.n
    return counts, vocabulary, spark.sparkContext.broadcast(weights)


def score(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """(id, held_out, n_tokens, n_known, train_tokens, base_score, score):
    log10 probabilities by the smoothed unigram counts and by the model."""
    counts, vocabulary, weights = fit(docs, id_column, text_column)
    known = vocabulary.value

    def each():
        words_, w = vocabulary.value, weights.value

        def work(key, text):
            out, rare = {n: [] for n in ("n_tokens", "n_known", "base", "model")}, []
            for _, held in _chunks(text):
                flat, ends = words_.encode(held)
                real = flat != BEGIN
                ids = flat[real]
                at = features(flat)[:, real]
                classes = words_.classes[ids]
                model = words_.within[ids]
                for k in range(0, len(ids), BATCH):
                    some = slice(k, k + BATCH)
                    model[some] += log_chances(class_logits(w[0], at[:, some]), classes[some])
                told = np.flatnonzero(classes > 1)
                for k in range(0, len(told), BATCH):
                    some = told[k : k + BATCH]
                    z = part_logits(w[1], part_features(at[:, some], classes[some]), words_.absent.take(classes[some], 0))
                    model[some] += log_chances(z, words_.parts[ids[some]])
                sizes = np.diff(np.concatenate([[-1], ends])) - 2
                starts = np.cumsum(sizes) - sizes
                met = (ids > END) | (ids == END) & words_.end_known
                out["n_tokens"] += sizes.tolist()
                out["n_known"] += np.add.reduceat(met.astype(np.int64), starts).tolist()
                out["base"] += np.add.reduceat(words_.base[ids], starts).tolist()
                out["model"] += np.add.reduceat(model, starts).tolist()
                found = [Counter() for _ in held]
                places = np.flatnonzero(ids == UNKNOWN)
                of = np.searchsorted(starts, places, "right") - 1
                for k, place in zip(of.tolist(), (places - starts[of]).tolist()):
                    found[k][held[k][place]] += 1
                rare += found
            fields = [pa.array(list(chain.from_iterable(rare)), pa.binary()), pa.array(list(chain.from_iterable(x.values() for x in rare)), pa.int32())]
            lists = pa.ListArray.from_arrays(np.cumsum([0, *map(len, rare)], dtype=np.int32), pa.StructArray.from_arrays(fields, ["word", "n"]))
            return out | {"id": key, "rare": lists}

        return work

    kind = docs.schema[id_column].dataType.simpleString()
    schema = f"id {kind}, n_tokens long, n_known long, base double, model double, rare array<struct<word: binary, n: int>>"
    scored = stored(map_rows(docs, schema, each, id_column, text_column).withColumn("row", F.monotonically_increasing_id()))
    rare = scored.where(F.size("rare") > 0).select("row", F.inline("rare"))
    met = rare.join(counts.withColumnRenamed("n", "c"), "word", "left").withColumn("c", F.coalesce("c", F.lit(0)))
    over = lambda total: F.col("n") * F.log10((F.col("c") + 0.5) / F.lit(total))
    sums = met.groupBy("row").agg(
        F.sum(F.when(F.col("c") > 0, F.col("n")).otherwise(0)).alias("rare_known"),
        F.sum(over(known.n + 0.5 * (known.v + 1))).alias("rare_base"),
        F.sum(over(known.rest_n + 0.5 * (known.rest_v + 1))).alias("rare_model"),
    )
    zero = lambda c: F.coalesce(c, F.lit(0))
    return scored.drop("rare").join(sums, "row", "left").select(
        F.col("id").alias(id_column), held_out(F.col("id")).alias("held_out"), "n_tokens",
        (F.col("n_known") + zero("rare_known")).alias("n_known"), F.lit(known.n).cast("long").alias("train_tokens"),
        (F.col("base") + zero("rare_base")).alias("base_score"), (F.col("model") + zero("rare_model")).alias("score"),
    )
