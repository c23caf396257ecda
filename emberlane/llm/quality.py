"""Quality rules: counts over whole texts and robust multivariate outliers.

Everything here is DataFrame functions. Each text gives counts (words, symbols,
repeated lines and three-word windows) and from them a vector of transformed
statistics. The minimum-covariance-determinant estimate of its mean and
covariance is found for each language and source, each language and all texts:
concentration steps run from ``STARTS`` starts at once until no determinant
falls, and the start with the least determinant counts. Documents whose
squared Mahalanobis distance from their group's estimate is over ``cutoff`` are
rejected.

Vectors are added up once into cells of a group: boxes whose sides are
``1 / CELLS_A_FLOOR`` of the statistics' floors, with count, sums and sums of
products, so that moments stay exact. Steps work on cells, each as far away as its
mean. Languages and all texts get their cells from those of the sources. A step
adds up counts and moments by (group, start, bin of the distance), which
Spark combines before its shuffle, so that a source with a third of all
documents weighs no more than another; cells and rows meet their group's estimate
by a salt as well. The nearest ``share`` of a group are
whole bins; the bins are ``BINS_PER_E`` to a factor of e, so the share is met
from above to within one bin, and a group has at most some thousand bins. The
starts are the median and interquartile range of each statistic, the moments of
all rows, and those of the cells within one such range of the medians in every
statistic. Variances have a floor, so constant statistics don't make the
covariance singular and single exceptions to them aren't infinitely far.

A source's estimate is drawn to its language's as if ``prior`` documents more
came from there, and a language's to that of all texts likewise, so that every
group has its own estimate and small ones lean on the larger: no size decides
between two rules. Null languages and sources count as empty ones.

Null and empty texts have no words and fail the base rule. Repeated rows are
judged alike. Texts that fail the base rule take no part in the estimates.
"""

from __future__ import annotations

from math import exp, factorial

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import quoted, stored

SPACE = " \t\n\x0b\x0c\r"
SYMBOLS = "#*$%&|<>"
BINS_PER_E = 64
START_BINS = 200
#: name, and the smallest standard deviation that is told apart from a constant
STATISTICS = {"word_length": 0.1, "symbols": 0.04, "dup_lines": 0.15, "repeats": 0.15}
P = len(STATISTICS)
STARTS = 3
CELLS_A_FLOOR = 16
MOST_STEPS = 30
PAIRS = [(i, j) for i in range(P) for j in range(i + 1)]
KEYS = ["group", "start"]
#: Rows of a group meet its estimate in so many shares, wherever the estimates are too many to broadcast.
SALTS = 32


def text_counts(docs: DataFrame, text_column: str = "text") -> DataFrame:
    """Adds n_words, word_chars, n_symbols, n_lines, n_dup_lines, n_repeat_words.

    A three-word window is known by its 64-bit hash. Only texts in which a hash
    comes twice have their windows sorted; positions of those that repeat are
    then walked once.
    """
    text = F.coalesce(F.col(text_column), F.lit(""))
    split = docs.withColumns(
        {
            "__words": F.filter(F.split(text, r"[\x20\x09-\x0D]+"), lambda w: w != ""),
            "word_chars": F.length(F.translate(text, SPACE, "")).cast("long"),
            "n_symbols": (F.length(text) - F.length(F.translate(text, SYMBOLS, ""))).cast("long"),
            "__lines": F.filter(F.split(text, "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]")),
        }
    )
    words = F.col("__words")
    windows = F.when(F.size(words) >= 3, F.transform(F.sequence(F.lit(1), F.size(words) - 2), lambda i: F.xxhash64(F.element_at("__words", i), F.element_at("__words", i + 1), F.element_at("__words", i + 2))))
    hashed = split.withColumns(
        {
            "n_words": F.size(words).cast("long"),
            "__windows": windows,
            "n_lines": F.size("__lines").cast("long"),
            "n_dup_lines": (F.size("__lines") - F.size(F.array_distinct("__lines"))).cast("long"),
        }
    ).drop("__words", "__lines")
    repeats = F.size(F.array_distinct("__windows")) < F.size("__windows")
    ordered = hashed.withColumn("__sorted", F.when(repeats, F.sort_array(F.transform("__windows", lambda h, i: F.struct(h.alias("h"), i.alias("i")))))).drop("__windows")
    at = lambda k: F.get("__sorted", k)["h"]
    twice = F.filter("__sorted", lambda x, k: (x["h"] == at(k - 1)) | (x["h"] == at(k + 1)))
    places = ordered.withColumn("__places", F.sort_array(F.transform(twice, lambda x: x["i"]))).drop("__sorted")
    covered = F.aggregate(
        "__places",
        F.struct(F.lit(0).cast("long").alias("n"), F.lit(0).alias("upto")),
        lambda acc, i: F.struct((acc["n"] + i + 3 - F.greatest(acc["upto"], i)).alias("n"), (i + 3).alias("upto")),
        lambda acc: acc["n"],
    )
    return places.withColumn("n_repeat_words", F.coalesce(covered, F.lit(0).cast("long"))).drop("__places")


def statistics(counted: DataFrame) -> DataFrame:
    """Adds the transformed vector x0, x1, ...: the logarithm of the mean word
    length, and square roots of the shares of symbols, repeated lines and
    repeated words. None depends on the text's length as such."""
    share = lambda a, b: F.sqrt(F.coalesce(F.try_divide(F.col(a), F.col(b)), F.lit(0.0)))
    return counted.withColumns(
        {
            "x0": F.log(F.greatest(F.coalesce(F.try_divide(F.col("word_chars"), F.col("n_words")), F.lit(1.0)), F.lit(1.0))),
            "x1": share("n_symbols", "word_chars"),
            "x2": share("n_dup_lines", "n_lines"),
            "x3": share("n_repeat_words", "n_words"),
        }
    )


def _consistency(share: float) -> float:
    """What the covariance of the nearest ``share`` of P-variate normal rows is too small by."""
    tail = lambda k, x: exp(-x / 2) * sum((x / 2) ** i / factorial(i) for i in range(k // 2))
    low, high = 0.0, 100.0
    for _ in range(80):
        mid = (low + high) / 2
        low, high = (mid, high) if 1 - tail(P, mid) < share else (low, mid)
    return share / (1 - tail(P + 2, low))


def _nearest(binned: DataFrame, share: float) -> DataFrame:
    """Rows (group, start, bin, n, ...) of the lowest bins that hold ``share`` of each group."""
    by = Window.partitionBy(*KEYS).orderBy("bin")
    return (
        binned.withColumns({"__below": F.sum("n").over(by) - F.col("n"), "__all": F.sum("n").over(Window.partitionBy(*KEYS))})
        .where(F.col("__below") < F.col("__all") * share)
        .drop("__below", "__all")
    )


SUMS = ["n", *(f"s{i}" for i in range(P)), *(f"q{i}{j}" for i, j in PAIRS)]


def _sums() -> list[Column]:
    """Aggregates of cells: their counts, sums and sums of products."""
    return [F.sum(name).alias(name) for name in SUMS]


def cells(rows: DataFrame, keys: list[str], floors: list[float]) -> DataFrame:
    """(keys, k0.., n, s0.., q00..) of rows (keys, x0..): the boxes that hold rows."""
    box = [F.floor(F.col(f"x{i}") * (CELLS_A_FLOOR / floors[i])).alias(f"k{i}") for i in range(P)]
    return rows.groupBy(*keys, *box).agg(
        F.count(F.lit(1)).alias("n"),
        *(F.sum(f"x{i}").alias(f"s{i}") for i in range(P)),
        *(F.sum(F.col(f"x{i}") * F.col(f"x{j}")).alias(f"q{i}{j}") for i, j in PAIRS),
    )


def _centred(boxes: DataFrame) -> DataFrame:
    """Cells (group, k0.., sums), stored, with their means x0.. in place of their boxes."""
    return stored(boxes.select("group", *SUMS, *((F.col(f"s{i}") / F.col("n")).alias(f"x{i}") for i in range(P))))


def _moments(sums: DataFrame, keys: list[str], factor: float = 1.0) -> DataFrame:
    """(keys, m0.., c00..) of sums; the covariance times ``factor``."""
    mean = {f"m{i}": F.col(f"s{i}") / F.col("n") for i in range(P)}
    covariance = {f"c{i}{j}": (F.col(f"q{i}{j}") / F.col("n") - mean[f"m{i}"] * mean[f"m{j}"]) * factor for i, j in PAIRS}
    return sums.select(*keys, *(c.alias(n) for n, c in (mean | covariance).items()))


def _medians(rows: DataFrame) -> DataFrame:
    """Median over cells and robust variance of each statistic: (group, m0.., c00..)."""
    each = F.explode(F.array(*(F.struct(F.lit(k).alias("k"), F.floor(F.col(f"x{k}") * START_BINS).alias("bin")) for k in range(P))))
    bins = rows.select("group", "n", each.alias("b")).groupBy("group", "b.k", "b.bin").agg(F.sum("n").alias("n"))
    upto = F.sum("n").over(Window.partitionBy("group", "k").orderBy("bin")) / F.sum("n").over(Window.partitionBy("group", "k"))
    middle = (F.col("bin") + 0.5) / START_BINS
    quantile = lambda q: F.min(F.when(F.col("upto") >= q, middle))
    spread = bins.withColumn("upto", upto).groupBy("group", "k").agg(quantile(0.5).alias("m"), ((quantile(0.75) - quantile(0.25)) / 1.349).alias("s"))
    wide = spread.groupBy("group").agg(
        *(F.max(F.when(F.col("k") == k, F.col("m"))).alias(f"m{k}") for k in range(P)),
        *(F.max(F.when(F.col("k") == k, F.col("s") * F.col("s"))).alias(f"c{k}{k}") for k in range(P)),
    )
    return wide.withColumns({f"c{i}{j}": F.lit(0.0) for i in range(P) for j in range(i)})


def _starts(rows: DataFrame, floors: list[float]) -> DataFrame:
    """(group, start, m0.., c00..) of the starts that a group has rows for."""
    medians = stored(_medians(rows))
    everything = _moments(rows.groupBy("group").agg(*_sums()), ["group"])
    inside = F.lit(True)
    for i in range(P):
        inside = inside & (F.abs(F.col(f"x{i}") - F.col(f"m{i}")) <= F.sqrt(F.col(f"c{i}{i}")) * 1.349 + floors[i])
    core = _moments(_met(rows, medians, "inner").where(inside).groupBy("group").agg(*_sums()), ["group"])
    columns = ["group", *(f"m{i}" for i in range(P)), *(f"c{i}{j}" for i, j in PAIRS)]
    named = [df.select(F.lit(k).alias("start"), *columns) for k, df in enumerate((medians, everything, core))]
    return named[0].unionByName(named[1]).unionByName(named[2])


def _cholesky(estimate: DataFrame, floors: list[float]) -> DataFrame:
    """Adds l00.. and logdet: the covariance with its floors as a lower triangle."""
    for i in range(P):
        for j in range(i + 1):
            rest = F.col(f"c{i}{j}") + (floors[i] ** 2 if i == j else 0.0)
            for k in range(j):
                rest = rest - F.col(f"l{i}{k}") * F.col(f"l{j}{k}")
            estimate = estimate.withColumn(f"l{i}{j}", F.sqrt(F.greatest(rest, F.lit(floors[i] ** 2 / 4))) if i == j else rest / F.col(f"l{j}{j}"))
    return estimate.withColumn("logdet", sum(2 * F.log(f"l{i}{i}") for i in range(P)))


def _met(rows: DataFrame, estimates: DataFrame, how: str) -> DataFrame:
    """Rows with their group's estimates, in SALTS shares; ``how`` they are joined."""
    shares = estimates.withColumn("__salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    salted = rows.withColumn("__salt", F.pmod(F.monotonically_increasing_id(), F.lit(SALTS)).cast("int"))
    return salted.join(shares, ["group", "__salt"], how).drop("__salt")


def _distance(rows: DataFrame, triangles: DataFrame, how: str) -> DataFrame:
    """Adds d2, the squared Mahalanobis distance; where a group has no estimate it
    is null or, with ``how`` inner, its rows go. A group with several starts gives
    a row for each."""
    joined = _met(rows, triangles.drop(*(f"c{i}{j}" for i, j in PAIRS)), how)
    for i in range(P):
        rest = F.col(f"x{i}") - F.col(f"m{i}")
        for j in range(i):
            rest = rest - F.col(f"l{i}{j}") * F.col(f"__y{j}")
        joined = joined.withColumn(f"__y{i}", rest / F.col(f"l{i}{i}"))
    d2 = sum((F.col(f"__y{i}") * F.col(f"__y{i}") for i in range(1, P)), F.col("__y0") * F.col("__y0"))
    return joined.withColumn("d2", d2).drop(*(f"m{i}" for i in range(P)), *(f"l{i}{j}" for i, j in PAIRS), *(f"__y{i}" for i in range(P)))


def _concentrate(rows: DataFrame, triangles: DataFrame, share: float) -> DataFrame:
    """One step: mean and covariance of the nearest ``share`` of each group, for
    each start, with the determinant ``before`` it."""
    near = _distance(rows, triangles, "inner").withColumn("bin", F.floor(F.log1p("d2") * BINS_PER_E))
    total = _nearest(near.groupBy(*KEYS, "bin").agg(*_sums(), F.max("logdet").alias("before")), share).groupBy(*KEYS)
    return _moments(total.agg(*_sums(), F.max("before").alias("before")), [*KEYS, "before"], _consistency(share))


def least_determinants(rows: DataFrame, share: float, floors: list[float]) -> DataFrame:
    """(group, m0.., c00.., l00.., logdet) of rows (group, x0..), see ``_least``."""
    return _least(_centred(cells(rows, ["group"], floors)), share, floors)


def _least(rows: DataFrame, share: float, floors: list[float]) -> DataFrame:
    """(group, m0.., c00.., l00.., logdet) of cells (group, sums, x0..): the start whose
    concentration steps end at the least determinant. A start's steps end when
    its determinant falls no more, after MOST_STEPS at most; as the nearest cells
    are whole bins, a step may also raise it, and then isn't taken.

    A step's determinants are stored before they are compared: a filter on them
    would be pushed below the triangle and repeat all of its expressions."""
    starts = stored(_cholesky(_starts(rows, floors), floors))
    every = moving = stored(_cholesky(_concentrate(rows, starts, share), floors)).drop("before")
    for _ in range(MOST_STEPS):
        ahead = stored(_cholesky(_concentrate(rows, moving, share), floors))
        fallen = ahead.where(F.col("logdet") < F.col("before") - 1e-6).drop("before")
        if fallen.isEmpty():
            break
        every, moving = every.unionByName(fallen), fallen
    # a start's last step has its least determinant
    best = every.groupBy("group").agg(F.min_by(F.struct(*(c for c in every.columns if c not in KEYS)), F.struct("logdet", "start")).alias("e"))
    return best.select("group", "e.*")


def _drawn(estimate: DataFrame, above: DataFrame, keys: list[str], prior: float) -> DataFrame:
    """Estimates (keys, n, m0.., c00..) weighed with those of ``above`` as if
    ``prior`` documents came from there; the means' difference adds to the covariance."""
    moments = [*(f"m{i}" for i in range(P)), *(f"c{i}{j}" for i, j in PAIRS)]
    shared = [k for k in keys if k in above.columns]
    if shared:
        joined = estimate.join(above.select(*shared, *(F.col(c).alias(f"__{c}") for c in moments)), shared)
    else:
        whole = above.first()  # the one estimate of all texts; none without texts
        joined = estimate.withColumns({f"__{c}": F.lit(whole[c] if whole else 0.0) for c in moments})
    own, theirs = F.col("n") / (F.col("n") + prior), F.lit(prior) / (F.col("n") + prior)
    gap = lambda i: F.col(f"m{i}") - F.col(f"__m{i}")
    mean = [(own * F.col(f"m{i}") + theirs * F.col(f"__m{i}")).alias(f"m{i}") for i in range(P)]
    covariance = [(own * F.col(f"c{i}{j}") + theirs * F.col(f"__c{i}{j}") + own * theirs * gap(i) * gap(j)).alias(f"c{i}{j}") for i, j in PAIRS]
    return joined.select(*keys, "n", *mean, *covariance)


def group_estimates(rows: DataFrame, share: float, floors: list[float], prior: float) -> DataFrame:
    """(lang, source, m0.., l00.., logdet) of rows (lang, source, x0..)."""
    levels = [("lang", "source"), ("lang",), ()]
    name = lambda level: F.to_json(F.struct(F.lit(len(level)).alias("n"), *level))
    boxes = stored(cells(rows, ["lang", "source"], floors))
    grouped = boxes.withColumn("group", F.explode(F.array(*(name(level) for level in levels)))).groupBy("group", *(f"k{i}" for i in range(P))).agg(*_sums())
    found = stored(_least(_centred(grouped), share, floors))
    drawn = None
    for level in reversed(levels):
        sizes = boxes.groupBy(*level).agg(F.sum("n").alias("n"))
        own = sizes.withColumn("group", name(level)).join(found, "group").select(*level, "n", *(f"m{i}" for i in range(P)), *(f"c{i}{j}" for i, j in PAIRS))
        drawn = own if drawn is None else _drawn(own, drawn, list(level), prior)
    return _cholesky(drawn.drop("n"), floors)


def judge(docs: DataFrame, keep: list[str], text_column: str = "text", share: float = 0.75, cutoff: float = 30.0, prior: float = 50.0, floors: list[float] | None = None) -> DataFrame:
    """Columns ``keep`` of the documents with their counts, base_failed, d2 and
    kept; columns of ``keep`` that have one of these names go."""
    floors = floors or list(STATISTICS.values())
    counts = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]
    rows = measured(docs, F.struct(*quoted(keep)), text_column)
    mine = [c for c in keep if c not in (*counts, "base_failed", "kept", "d2")]
    judged = verdicts(rows, share, cutoff, prior, floors)
    return judged.select(*(F.col("__keep").getField(c).alias(c) for c in mine), *counts, "base_failed", "kept", "d2")


def measured(docs: DataFrame, keep: Column, text_column: str = "text") -> DataFrame:
    """(__keep, counts, x0.., base_failed, lang, source) of every document, stored."""
    empty = lambda c: F.coalesce(F.col(c), F.lit(""))
    picked = docs.select(keep.alias("__keep"), F.col(text_column).alias("__text"), empty("lang").alias("lang"), empty("source").alias("source"))
    failed = (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))
    vectors = statistics(text_counts(picked, "__text")).withColumn("base_failed", failed)
    return stored(vectors.drop("__text", "n_lines"))


def verdicts(rows: DataFrame, share: float = 0.75, cutoff: float = 30.0, prior: float = 50.0, floors: list[float] | None = None) -> DataFrame:
    """Adds d2 and kept to what ``measured`` gives."""
    floors = floors or list(STATISTICS.values())
    sound = rows.where(~F.col("base_failed")).select("lang", "source", *(f"x{i}" for i in range(P)))
    estimates = stored(group_estimates(sound, share, floors, prior).withColumn("group", F.struct("lang", "source")).drop("lang", "source"))
    judged = _distance(rows.withColumn("group", F.struct("lang", "source")), estimates, "left").drop("group", "logdet")
    return judged.withColumn("kept", ~F.col("base_failed") & F.coalesce(F.col("d2") <= cutoff, F.lit(True)))
