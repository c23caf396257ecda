"""Personal data: fixed patterns, and identifiers found by bootstrapped contexts.

Everything here is DataFrame functions.

Base spans are the leftmost non-overlapping matches of each kind's pattern that
pass its test. Their places come from the pieces between matches: a match ends
where the lengths of all pieces and matches up to it add up to. The patterns
are possessive and begin only where a longer match couldn't, which finds the
same spans and keeps long runs of one character class linear.

The method adds secrets by bootstrapped contexts. A candidate is a value with a
digit behind a label (``token =``, ``id:``), or a word with four digits or more,
that no base span overlaps. Its lexical patterns are the label, the word to its
left, the two words to its left, and the words on both sides. Values that look
like a seed (SEEDS) are found from the start, whatever stands around them. In
each round every pattern's confidence is the summed score of its distinct values
found so far over the number of all its values and one more; patterns with fewer
than ``support`` found values count nothing. A value's score is that of its best
pattern. Values at or above ``least`` are found, keep their score and speak for
their other patterns from the next round on, over the graph of distinct
(pattern, value) edges, until a round finds nothing. Base kinds are no seeds: their
tests decide them, and a number that fails its test isn't made one by context.

Null and empty texts have no spans. Repeated rows are judged each by itself.
Places are code points, the end exclusive.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import quoted, stored

#: Kinds in order, with the contract's patterns in linear form; fixed values.
BASE = {
    "email": r"(?:(?<![A-Za-z0-9._%+-])|\G)[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?:(?<![0-9])|\G)[0-9]++(?:\.[0-9]++){3}",
    "card": r"[0-9](?:[\x20-]?[0-9])++",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
#: A label, a separator and a value with a digit; or a word with four digits.
LABELLED = r"""(?<![\w-])[A-Za-z_][\w-]*+\x20?[:=#]\x20?["']?(?=[^\s"'<>,;0-9]*+[0-9])[^\s"'<>,;]++"""
CANDIDATE = LABELLED + r"|(?<![\w-])(?=(?:[A-Za-z_-]*+[0-9]){4})[\w-]++"
LABEL = r"""^[A-Za-z_][\w-]*+\x20?[:=#]\x20?["']?"""
#: A word of a context, and the characters of it that are looked at.
WORD, REACH = r"[\p{L}_][\p{L}\p{N}_-]*", 120
#: Looks of seed values of the kinds that the method adds.
SEEDS = {"secret": r"^(?=[0-9a-f]*[a-f])(?=[0-9a-f]*[0-9])[0-9a-f]{32,}$"}
CHUNK = 256


def _ip(m: Column) -> Column:
    parts = F.transform(F.split(m, r"\."), lambda p: F.regexp_replace(p, "^0+(?=.)", ""))
    return F.forall(parts, lambda p: F.when(F.length(p) <= 3, p.cast("int") <= 255).otherwise(False))


def _luhn(m: Column) -> Column:
    digits = F.regexp_replace(m, "[^0-9]", "")
    size = F.length(digits)
    def weight(i):
        d = F.substring(F.reverse(digits), i, F.lit(1)).cast("int")
        return F.when(i % 2 == 1, d).when(d > 4, 2 * d - 9).otherwise(2 * d)
    total = F.aggregate(F.transform(F.sequence(F.lit(1), size), weight), F.lit(0), lambda a, x: a + x)
    return F.when(size.between(16, 19), total % 10 == 0).otherwise(False)


def _phone(m: Column) -> Column:
    return F.length(F.regexp_replace(m, "[^0-9]", "")).between(8, 15)


TESTS = {"email": lambda m: F.lit(True), "ip": _ip, "card": _luhn, "phone": _phone}


def located(df: DataFrame, text: str, patterns: dict[str, str], guards: dict[str, Column] | None = None, contexts: tuple[str, ...] = ()) -> DataFrame:
    """Adds for each name array<struct<value, start, end>> of all matches, null
    where there is none; those in ``contexts`` have before and after as well,
    REACH characters of the text up to the neighbouring matches. Sums run by chunks of matches, so that many matches in
    one text don't cost the square of their number."""
    guards = guards or {}
    some = lambda n: F.size(f"{n}_m") > 0
    df = df.withColumns({f"{n}_m": F.when(guards.get(n, F.lit(True)), F.regexp_extract_all(F.col(text), F.lit(p), F.lit(0))) for n, p in patterns.items()})
    df = df.withColumns({f"{n}_g": F.when(some(n), F.split(F.col(text), p, -1)) for n, p in patterns.items()})
    df = df.withColumns({f"{n}_s": F.when(some(n), F.zip_with(F.col(f"{n}_m"), F.slice(f"{n}_g", F.lit(1), F.size(f"{n}_m")), lambda m, g: (F.length(m) + F.length(g)).cast("long"))) for n in patterns})
    zero = F.array(F.lit(0).cast("long"))
    grow = lambda acc, x: F.array_append(acc, F.element_at(acc, -1) + x)

    def by_chunk(n):
        """Sums within each chunk, after a zero."""
        last = F.floor((F.size(f"{n}_m") - 1) / CHUNK).cast("int")
        return F.transform(F.sequence(F.lit(0), last), lambda k: F.aggregate(F.slice(f"{n}_s", k * CHUNK + 1, F.lit(CHUNK)), zero, grow))

    df = df.withColumns({f"{n}_c": F.when(some(n), by_chunk(n)) for n in patterns})
    df = df.withColumns({f"{n}_o": F.aggregate(f"{n}_c", zero, lambda acc, c: grow(acc, F.element_at(c, -1))) for n in patterns})
    df = df.withColumns({f"{n}_e": F.flatten(F.zip_with(F.col(f"{n}_c"), F.slice(f"{n}_o", F.lit(1), F.size(f"{n}_c")), lambda c, o: F.transform(F.slice(c, 2, CHUNK), lambda x: x + o))) for n in patterns})

    def spans(n):
        def span(m, i):
            end = F.get(f"{n}_e", i)
            around = [F.right(F.get(f"{n}_g", i), F.lit(REACH)).alias("before"), F.left(F.get(f"{n}_g", i + 1), F.lit(REACH)).alias("after")]
            return F.struct(m.alias("value"), (end - F.length(m)).alias("start"), end.alias("end"), *(around if n in contexts else ()))

        return F.when(some(n), F.transform(f"{n}_m", span))

    df = df.withColumns({n: spans(n) for n in patterns})
    return df.drop(*(f"{n}_{x}" for n in patterns for x in "mgscoe"))


def base_spans(docs: DataFrame, text: str) -> DataFrame:
    """Adds email, ip, card, phone and candidate: arrays of (value, start, end)."""
    guards = {"email": F.col(text).contains("@"), "phone": F.col(text).contains("+"), "candidate": F.col(text).rlike("[0-9]")}
    found = located(docs, text, {**BASE, "candidate": CANDIDATE}, guards, ("candidate",))
    empty = F.array().cast("array<struct<value:string,start:bigint,end:bigint>>")

    def passing(n):
        return F.filter(n, lambda x: TESTS[n](x["value"]))

    return found.withColumns({n: F.coalesce(passing(n), empty) for n in BASE})


def _mentions(found: DataFrame) -> DataFrame:
    """Adds ``mentions``: (patterns, value, start, end) of the candidates that no base span overlaps."""
    def mention(x):
        head = F.regexp_extract(x["value"], LABEL, 0)
        value = F.substring(x["value"], F.length(head) + 1, F.length(x["value"]))
        label = F.regexp_replace(F.lower(head), r"""[\x20"']""", "")
        left = F.regexp_extract_all(F.lower(F.concat(x["before"], F.lit(" "), head)), F.lit(WORD), F.lit(0))
        one, two = F.get(left, F.size(left) - 1), F.get(left, F.size(left) - 2)
        right = F.nullif(F.regexp_extract(F.lower(x["after"]), WORD, 0), F.lit(""))
        patterns = F.array(
            F.when(label != "", F.concat(F.lit("label "), label)),
            F.concat(F.lit("left "), one),
            F.concat(F.lit("left "), two, F.lit(" "), one),
            F.concat(F.lit("both "), one, F.lit(" | "), right),
        )
        return F.struct(F.array_compact(patterns).alias("patterns"), value.alias("value"), (x["end"] - F.length(value)).alias("start"), x["end"].alias("end"))

    clear = lambda m: reduce(lambda a, n: a & ~F.exists(n, lambda b: (b["start"] < m["end"]) & (m["start"] < b["end"])), BASE, F.lit(True))
    return found.withColumn("__m", F.transform("candidate", mention)).withColumn("mentions", F.filter("__m", clear)).drop("candidate", "__m")


def score_values(mentions: DataFrame, support: int = 3, least: float = 0.5) -> DataFrame:
    """(value, kind, score) of values at or above ``least``. ``mentions`` has
    patterns (array) and value. Rounds go on until one finds no value that is
    new; every round weighs all patterns by the values found up to then."""
    kind = F.coalesce(*(F.when(F.col("value").rlike(p), k) for k, p in SEEDS.items()), F.lit(None).cast("string"))
    seeds = mentions.select("value").distinct().select("value", kind.alias("kind"), F.lit(1.0).alias("score"))
    found = stored(seeds.where("kind is not null"))
    n = found.count()
    if n:
        edges = stored(mentions.select("value", F.explode("patterns").alias("pattern")).distinct())
        totals = stored(edges.groupBy("pattern").agg(F.count(F.lit(1)).alias("values")).where(F.col("values") >= support))
    while n:
        trust = edges.join(found, "value").groupBy("pattern", "kind").agg(F.count(F.lit(1)).alias("n"), F.sum("score").alias("score")).where(F.col("n") >= support)
        trust = trust.join(totals, "pattern").select("pattern", "kind", (F.col("score") / (F.col("values") + 1)).alias("trust"))
        heard = edges.join(trust.where(F.col("trust") >= least), "pattern").groupBy("value", "kind").agg(F.max("trust").alias("score"))
        new = stored(heard.join(found, ["value", "kind"], "left_anti"))
        n = new.count()
        if n:
            found = stored(found.unionByName(new))
    best = found.groupBy("value").agg(F.max(F.struct("score", "kind")).alias("s"))
    return best.select("value", "s.kind", "s.score")


def _written(kind: str | Column, spans: Column) -> Column:
    name = F.lit(kind) if isinstance(kind, str) else kind
    return F.transform(spans, lambda s: F.concat_ws(":", name, s["start"].cast("string"), s["end"].cast("string")))


def scan(docs: DataFrame, keep: list[str], text_column: str = "text") -> DataFrame:
    """Columns ``keep`` with the base kinds' span arrays and ``added``:
    array<struct<kind, start, end, value>> in order of kind and start."""
    text = F.coalesce(F.col(text_column), F.lit(""))
    found = _mentions(base_spans(docs.select(F.struct(*keep).alias("__keep"), text.alias("__text")), "__text"))
    found = stored(found.drop("__text").withColumn("__row", F.monotonically_increasing_id()))
    mentions = found.where(F.size("mentions") > 0).select("__row", F.inline("mentions"))
    scored = score_values(mentions)
    added = mentions.join(scored, "value").groupBy("__row").agg(F.sort_array(F.collect_list(F.struct("kind", "start", "end", "value"))).alias("added"))
    none = F.array().cast("array<struct<kind:string,start:bigint,end:bigint,value:string>>")
    return found.join(added, "__row", "left").select("__keep.*", *BASE, F.coalesce("added", none).alias("added"))


def report(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """(id, n_email, n_ip, n_card, n_phone, base_sha256, spans, n_added)."""
    found = scan(docs, [id_column], text_column)
    base = F.flatten(F.array(*(_written(k, F.col(k)) for k in BASE)))
    extra = F.transform("added", lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string")))
    return found.select(
        id_column, *(F.size(k).cast("long").alias(f"n_{k}") for k in BASE),
        F.sha2(F.array_join(base, ",").cast("binary"), 256).alias("base_sha256"),
        F.array_join(F.concat(base, extra), ",").alias("spans"), F.size("added").cast("long").alias("n_added"),
    )


def _unions(spans: Column) -> Column:
    """Unions of overlapping spans (start, end, kind), in order; the first span names the kind."""
    none = F.array().cast("array<struct<start:bigint,end:bigint,kind:string>>")

    def put(acc, s):
        last = F.element_at(acc, -1)
        grown = F.struct(last["start"].alias("start"), F.greatest(last["end"], s["end"]).alias("end"), last["kind"].alias("kind"))
        apart = (F.size(acc) == 0) | (s["start"] >= F.get(acc, F.size(acc) - 1)["end"])
        return F.when(apart, F.array_append(acc, s)).otherwise(F.array_append(F.slice(acc, F.lit(1), F.size(acc) - 1), grown))

    return F.aggregate(F.sort_array(spans), none, put)


def redacted(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """The documents with every union of overlapping spans replaced by its kind
    in angle brackets.

    All places are those of the original text, so that no replacement makes or
    hides another. Added values are spans in all texts of their id; what is left
    between spans loses them as well where they stand without a label.
    """
    columns = docs.columns
    found = scan(docs, [id_column], text_column).where(F.size("added") > 0)
    values = found.select(F.col(id_column).alias("__of"), F.explode("added").alias("s")).groupBy("__of")
    values = stored(values.agg(F.sort_array(F.collect_set(F.struct("s.value", "s.kind"))).alias("__added")))
    rows = docs.select(F.struct(*quoted(columns)).alias("__keep"), F.col(id_column).alias("__id"), F.coalesce(F.col(text_column), F.lit("")).alias("__text"))
    rows = _mentions(base_spans(rows, "__text")).join(values, F.col("__id").eqNullSafe(F.col("__of")), "left")
    told = F.map_from_entries(F.coalesce("__added", F.array().cast("array<struct<value:string,kind:string>>")))
    # a value that isn't one of the id's has no kind
    mine = F.filter(F.transform("mentions", lambda m: F.struct(m["start"].alias("start"), m["end"].alias("end"), F.element_at("__told", m["value"]).alias("kind"))), lambda m: m["kind"].isNotNull())
    named = lambda k: F.transform(k, lambda s: F.struct(s["start"].alias("start"), s["end"].alias("end"), F.lit(k).alias("kind")))
    rows = rows.withColumn("__told", told).withColumn("__all", F.concat(*(named(k) for k in BASE), F.coalesce(mine, F.array().cast("array<struct<start:bigint,end:bigint,kind:string>>"))))
    some = F.size("__all") > 0
    rows = rows.withColumns({"__u": F.when(some, _unions(F.col("__all"))), "__c": F.when(some, F.split("__text", ""))})
    free = lambda t: F.aggregate("__added", t, lambda t, s: F.replace(t, s["value"], F.concat(F.lit("<"), F.upper(s["kind"]), F.lit(">"))))
    between = lambda begin, end: F.array_join(F.slice("__c", begin.cast("int") + 1, (end - begin).cast("int")), "")
    clean = lambda t: F.when(F.col("__added").isNotNull(), free(t)).otherwise(t)
    before = lambda s, k: between(F.when(k == 0, F.lit(0)).otherwise(F.get("__u", k - 1)["end"]), s["start"])
    pieces = F.transform("__u", lambda s, k: F.concat(clean(before(s, k)), F.lit("<"), F.upper(s["kind"]), F.lit(">")))
    rest = clean(between(F.element_at("__u", -1)["end"], F.size("__c").cast("long")))
    text = F.when(some, F.concat(F.array_join(pieces, ""), rest)).when(F.col("__added").isNotNull(), free(F.col("__text"))).otherwise(F.col(f"__keep.{text_column}"))
    rows = rows.withColumn("__t", text)
    return rows.select(*(F.col("__t").alias(c) if c == text_column else F.col("__keep").getField(c).alias(c) for c in columns))
