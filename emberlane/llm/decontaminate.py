"""Benchmark decontamination by template windows.

Words are stripped of outer punctuation and lower-cased (what is nothing but
punctuation is left out); numbers (in digits or words, also with a unit
attached), units right behind a number and names (words inside a sentence that
are capitalised but not in capitals throughout) become typed placeholders. Every
``window`` consecutive words are a template window, known by a 64-bit hash.
Windows of documents meet those of benchmark items in a hash join on it, and
the templates themselves are compared, so a hash collision doesn't count.
Windows of one item that lie on one diagonal are then checked for slots: equal
values of the item stand for equal values of the document; different ones may
stand for the same, as a variant may have two equal numbers.
A question with other numbers, names or units is caught, also if only part of
it is there; chance agreement of placeholders isn't. Where the whole diagonal
doesn't agree, its runs of windows count that are verbatim over ``VERBATIM``
words or agree over ``AGREEING`` windows' length.

Windows that are mostly placeholders are matched by their literal words instead.
A capitalised word at the beginning of a text or line or behind an opening quote
may begin a sentence or be a name: windows with such words come in both forms,
the second of which has to hold the same word.

Where the benchmark has at most ``BROADCAST_WINDOWS`` windows, their hashes are
broadcast as a bitmap that spares the join documents' other windows, and its
side of the join is broadcast as well; beyond that all windows are shuffled.

Items of fewer than ``window`` words have one window of all their words. With
fewer than ``shortest`` they say too little as templates and are matched as they
are, word for word: anywhere in a text, or, up to ``WHOLE`` words, where a text is
nothing else. Null and empty texts match nothing. Rows that share an id share their verdict.
"""

from __future__ import annotations

import re

import numpy as np
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import map_rows, stored

BROADCAST_WINDOWS = 200_000  # of at most some hundred bytes each
LITERALS = 0.5  # least share of words in a window that aren't placeholders, or it is matched literally
VERBATIM = 13  # words of a literal copy that count whatever stands around it
AGREEING = 3  # lengths of a window over which slots agree that count likewise
KNOWN_WORDS = 250_000
TOGETHER = 1 << 17  # characters of texts that are looked up at once
WHOLE = 2  # items of so many words count only where they are the whole text
#: Units of measure and currency.
UNITS = frozenset(
    "% $ € £ ¥ mm cm m km in ft yd mi mg g kg t oz lb lbs ml l s sec secs second seconds min mins minute minutes h hr hrs hour hours day days week weeks month months year years"
    " meter meters metre metres kilometer kilometers kilometre kilometres mile miles foot feet inch inches gram grams kilogram kilograms pound pounds liter liters litre litres"
    " dollar dollars euro euros cent cents usd eur gbp mph kmh km/h m/s degree degrees °c °f kwh w kw mw v hz percent".split()
)
#: Numbers in words ("one" is a pronoun as well and stays a word).
NUMBER_WORDS = frozenset(
    "zero two three four five six seven eight nine ten eleven twelve thirteen fourteen fifteen sixteen seventeen"
    " eighteen nineteen twenty thirty forty fifty sixty seventy eighty ninety hundred thousand million billion".split()
)
_NUMBER = re.compile(r"[-+$€£¥]?\d[\d.,:/]*(?:%|st|nd|rd|th|e[-+]?\d+)?$")
_ATTACHED = re.compile(r"[-+]?\d[\d.,]*([^\d.,].*)$")
_OUTER = re.compile(r"^[^\w$€£¥%°+-]+|[^\w%°$€£¥]+$")
_MIX = np.uint64(0x9E3779B97F4A7C15)
_NUM, _NAME, _UNIT = (xxhash.xxh3_64_intdigest(kind) | 1 for kind in ("<num>", "<name>", "<unit>"))
#: Flags of known words: ends a sentence, nothing but punctuation, may open a sentence, a number, a unit behind a number.
ENDS, EMPTY, OPENS, NUMBER, UNIT = 1, 2, 4, 8, 16
_BITMAP = 22
_CLOSING = "\"')]}»”’*_"
_SIGNS = "$€£¥%°+-"
#: Forms of a window: unclear words as beginnings of sentences, as names, and all words as they are.
BEGINS, NAMES, LITERAL = 0, 1, 2


def is_number(low: str) -> bool:
    if low.isalpha():
        return low in NUMBER_WORDS
    if _NUMBER.match(low):
        return True
    attached = _ATTACHED.match(low)
    return bool(attached) and attached.group(1) in UNITS


def canonical_word(raw: str, counted: bool = False) -> tuple[str, str]:
    """The word inside a sentence and at the beginning of one; ``counted`` if a
    number stands before it."""
    word = raw if raw.isalpha() else _OUTER.sub("", raw)
    low = word.lower()
    if is_number(low):
        return "<num>", "<num>"
    if counted and low in UNITS:
        return "<unit>", "<unit>"
    if word[:1].isupper() and not word.isupper():
        return "<name>", low
    return low, low


def literal_word(raw: str) -> str:
    return (raw if raw.isalpha() else _OUTER.sub("", raw)).lower()


def _known(w: str) -> tuple[int, int, int, int]:
    """What Canoniser keeps of a raw word: its hashes inside a sentence, at the
    beginning of one and as it is, and flags. Placeholders have odd hashes."""
    if w.isalpha():
        word, low, flags = w, w.lower(), 0
    else:
        word = _OUTER.sub("", w)
        low, flags = word.lower(), ENDS * ((w.rstrip(_CLOSING) or w)[-1] in ".!?:") | OPENS * (not w[0].isalnum() and w[0] not in _SIGNS)
    own = xxhash.xxh3_64_intdigest(low)
    if is_number(low):
        return _NUM, _NUM, own, flags | NUMBER
    if low in UNITS:
        flags |= UNIT
    even = own & ~1
    if word[:1].isupper() and not word.isupper():
        return _NAME, even, even, flags
    return even, even, even, flags | EMPTY * (not low)


class Canoniser:
    """Template words of texts as arrays; keeps up to KNOWN_WORDS raw words."""

    def __init__(self):
        self.clear()

    def clear(self):
        self.index: dict[str, int] = {}
        self.table = np.empty((KNOWN_WORDS // 4, 4), np.uint64)

    def words(self, *texts: str | None) -> Words:
        raw, lines, starts = [], [], [0]
        for text in texts:
            for line in text.splitlines() if text else ():
                lines.append(len(raw))
                raw += line.split()
            starts.append(len(raw))
        if len(self.index) > KNOWN_WORDS:
            self.clear()
        index = self.index
        new = set(raw).difference(index)
        if new:
            first = len(index)
            index.update(zip(new, range(first, first + len(new))))
            while first + len(new) > len(self.table):
                self.table = np.concatenate([self.table, np.empty_like(self.table)])
            self.table[first : first + len(new)] = np.array([_known(w) for w in new], np.uint64)
        at = self.table[np.fromiter(map(index.__getitem__, raw), np.int64, len(raw))]
        flags = at[:, 3].astype(np.uint8)
        empty = flags & EMPTY
        if empty.any():
            held = np.flatnonzero(empty == 0)
            raw, at, flags, lines = [raw[k] for k in held.tolist()], at[held], flags[held], np.searchsorted(held, lines)
            starts = np.searchsorted(held, starts)
        starts = np.asarray(starts, np.int64)
        opening = starts[starts < len(raw)]
        begins = np.zeros(len(raw), bool)
        begins[1:] = flags[:-1] & ENDS
        begins[opening] = False
        unclear = (flags & OPENS) != 0
        lines = np.asarray(lines, np.int64)
        unclear[lines[lines < len(raw)]] = True
        unclear &= ~begins
        first, second = np.where(begins | unclear, at[:, 1], at[:, 0]), np.where(begins, at[:, 1], at[:, 0])
        counted = np.zeros(len(raw), bool)
        counted[1:] = flags[:-1] & NUMBER
        counted[opening] = False
        units = counted & ((flags & UNIT) != 0)
        if units.any():
            first[units] = second[units] = _UNIT
        return Words(raw, starts, first, second, at[:, 2], begins, unclear, counted)


class Words:
    """Raw words of texts one behind another, where each starts (and the last ends),
    their hashes with unclear words in either form and as they are, which begin a
    sentence or may do so, and which follow a number."""

    def __init__(self, raw: list[str], starts: np.ndarray, first: np.ndarray, second: np.ndarray, literal: np.ndarray, begins: np.ndarray, unclear: np.ndarray, counted: np.ndarray):
        self.raw, self.starts, self.first, self.second, self.literal = raw, starts, first, second, literal
        self.begins, self.unclear, self.counted = begins, unclear, counted

    def _inside(self, n: int, size: int) -> np.ndarray:
        """Which of ``n`` places have a window within one text."""
        inside = np.ones(n, bool)
        for i in range(1, size):
            last = self.starts[1:-1] - i
            inside[last[(last >= 0) & (last < n)]] = False
        return inside

    def windows(self, size: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Places, forms and hashes of all windows, some in more than one form."""
        n = len(self.raw) - size + 1
        if n <= 0:
            return np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0, np.uint64)

        def light(hashes):
            held = np.concatenate([[0], np.cumsum(hashes & np.uint64(1), dtype=np.int64)])
            return held[size:] - held[:n] <= size * (1 - LITERALS)

        inside = self._inside(n, size)
        one = light(self.first) & inside
        heavy = ~one & inside
        differ = self.first != self.second
        found = [(np.flatnonzero(one), BEGINS)]
        if differ.any():
            held = np.concatenate([[0], np.cumsum(differ)])
            both, two = (held[size:] > held[:n]) & inside, light(self.second)
            found.append((np.flatnonzero(both & two), NAMES))
            heavy |= both & ~two
        found.append((np.flatnonzero(heavy), LITERAL))
        return self._hashed(found, size)

    def _hashed(self, found: list[tuple[np.ndarray, int]], size: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        n = len(self.raw) - size + 1
        places, forms, hashed = [], [], []
        for at, form in found:
            hashes = (self.first, self.second, self.literal)[form]
            most = 4 * len(at) > max(n, 0)  # slices of all are cheaper than picking these
            total = np.full(n if most else len(at), size + (form == LITERAL) * 1000, np.uint64)
            for i in range(size):
                total ^= hashes[i : i + n] if most else hashes[at + i]
                total *= _MIX
                total ^= total >> np.uint64(29)
            if most and len(at) < n:
                total = total[at]
            places.append(at), forms.append(np.full(len(at), form)), hashed.append(total)
        return np.concatenate(places), np.concatenate(forms), np.concatenate(hashed)

    def short_windows(self, size: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Like ``windows`` for items that are too short for templates: all windows
        as they are, or only that of the whole text up to ``WHOLE`` words."""
        n = max(len(self.raw) - size + 1, 0)
        at = np.flatnonzero(self._inside(n, size)) if size > WHOLE else self.starts[:-1][np.diff(self.starts) == size]
        return self._hashed([(at, LITERAL)], size)

    def template(self, first: int, size: int, form: int) -> tuple[list[str], list[str]]:
        """Canonical words of a window, and the values of its placeholders, after
        "=" where a value may as well be a word. Literal windows have none."""
        if form == LITERAL:
            return ["=", *map(literal_word, self.raw[first : first + size])], []
        words, slots = [], []
        for k in range(first, first + size):
            unclear = bool(self.unclear[k])
            word = canonical_word(self.raw[k], bool(self.counted[k]))[bool(self.begins[k]) or unclear and form == BEGINS]
            words.append(word)
            if word.startswith("<"):
                value = _OUTER.sub("", self.raw[k]).lower()
                slots.append("=" + value if word == "<name>" and unclear else value)
        return words, slots


def consistent(pairs: set) -> bool:
    """Whether every value of the item (first) stands for one value of the document."""
    return len({i for i, _ in pairs}) == len(pairs)


def agreeing(met: list[dict], window: int) -> int:
    """Number of an item's windows on a diagonal that count: all of them where
    their slots agree, or else those that are literal or in a run that is long
    enough. ``met``: item_at, size, literal, i and d (the slots) of each."""
    pairs = [set(zip(w["i"], w["d"])) for w in met]
    if consistent(set().union(*pairs)):
        return len({w["item_at"] for w in met})
    kept = {w["item_at"] for w in met if w["literal"]}
    order = sorted(range(len(met)), key=lambda k: met[k]["item_at"])
    for least, fits in (VERBATIM, lambda p: all(i == d for i, d in p)), (AGREEING * window, consistent):
        first = 0
        for last in range(len(order)):
            at = met[order[last]]["item_at"]
            if last and at > met[order[last - 1]]["item_at"] + 1:
                first = last
            while first <= last and not fits(set().union(*(pairs[k] for k in order[first : last + 1]))):
                first += 1
            if first <= last and at + met[order[last]]["size"] - met[order[first]]["item_at"] >= least:
                kept.update(met[k]["item_at"] for k in order[first : last + 1])
    return len(kept)


def _signed(found: tuple[np.ndarray, np.ndarray, np.ndarray]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    return found[0], found[1], found[2].view(np.int64)


def benchmark_windows(benchmark: DataFrame, window: int, shortest: int, id_column: str, text_column: str) -> DataFrame:
    """(item_id, item_at, size, literal, hash, template, item_slots)."""

    def each():
        canoniser = Canoniser()

        def one(text):
            found = canoniser.words(text)
            size = min(window, len(found.raw))
            out = []
            if not size:
                return out
            made = found.short_windows(size) if size < shortest else found.windows(size)
            for k, form, hashed in zip(*(x.tolist() for x in _signed(made))):
                words, slots = found.template(k, size, form)
                out.append({"item_at": k, "size": size, "literal": form == LITERAL, "hash": hashed, "template": " ".join(words), "item_slots": slots})
            return out

        return lambda key, text: {"item_id": key, "w": [one(t) for t in text]}

    kind = benchmark.schema[id_column].dataType.simpleString()
    inner = "array<struct<item_at: int, size: int, literal: boolean, hash: bigint, template: string, item_slots: array<string>>>"
    return map_rows(benchmark, f"item_id {kind}, w {inner}", each, id_column, text_column).select("item_id", F.inline("w"))


def find_leaks(docs: DataFrame, benchmark: DataFrame, window: int = 8, shortest: int = 5, id_column: str = "doc_id", text_column: str = "text", item_column: str = "item_id", item_text: str = "text") -> DataFrame:
    """(id, n_words, n_windows, n_items, item_ids, contaminated) of every
    document: windows and items that it shares with the benchmark."""
    wanted = stored(benchmark_windows(benchmark.select(item_column, item_text), window, shortest, item_column, item_text))
    sizes = [r.size for r in wanted.select("size").distinct().orderBy("size").collect()]  # at most ``window`` numbers
    n_windows = wanted.count()
    small = n_windows <= BROADCAST_WINDOWS
    bitmap = None
    if small:
        marks = np.zeros(1 << _BITMAP, bool)
        hashes = wanted.select("hash").toPandas()["hash"].to_numpy(np.int64).view(np.uint64)
        marks[hashes >> np.uint64(64 - _BITMAP)] = True
        bitmap = docs.sparkSession.sparkContext.broadcast(np.packbits(marks))

    def each():
        canoniser = Canoniser()
        marks = np.unpackbits(bitmap.value).astype(bool) if small else None

        def some(texts):
            held = canoniser.words(*texts)
            out = [[] for _ in texts]
            for size in sizes:
                found = held.short_windows(size) if size < shortest else held.windows(size)
                if small:
                    able = marks[found[2] >> np.uint64(64 - _BITMAP)]
                    found = tuple(x[able] for x in found)
                text = np.searchsorted(held.starts, found[0], "right") - 1
                for t, at, k, form, hashed in zip(text.tolist(), (found[0] - held.starts[text]).tolist(), *(x.tolist() for x in _signed(found))):
                    words, slots = held.template(k, size, form)
                    out[t].append({"doc_at": at, "hash": hashed, "template": " ".join(words), "doc_slots": slots})
            return np.diff(held.starts).tolist(), out

        def work(key, text):
            n, found, first, chars = [], [], 0, 0
            for last, t in enumerate(text, 1):
                chars += len(t or "")
                if chars >= TOGETHER or last == len(text):
                    for made, more in zip((n, found), some(text[first:last])):
                        made += more
                    first, chars = last, 0
            return {id_column: key, "n_words": n, "w": found}

        return work

    kind = docs.schema[id_column].dataType.simpleString()
    inner = "array<struct<doc_at: int, hash: bigint, template: string, doc_slots: array<string>>>"
    scanned = stored(map_rows(docs, f"`{id_column}` {kind}, n_words long, w {inner}", each, id_column, text_column))
    scanned = scanned.withColumn("__row", F.monotonically_increasing_id())
    met = scanned.select(F.col(id_column).alias("__id"), "__row", F.inline("w")).join(F.broadcast(wanted) if small else wanted, ["hash", "template"])
    bare = lambda x: F.regexp_replace(x, "^=", "")
    pairs = F.arrays_zip(F.col("item_slots").alias("i"), F.col("doc_slots").alias("d"))
    same = F.forall(pairs, lambda x: ~(x["i"].startswith("=") | x["d"].startswith("=")) | (bare(x["i"]) == bare(x["d"])))

    # windows on one diagonal of an item: no more than the item has
    line = ["__id", "__row", "item_id", (F.col("doc_at") - F.col("item_at")).alias("line")]
    each_window = F.struct("item_at", "size", "literal", F.transform("item_slots", bare).alias("i"), F.transform("doc_slots", bare).alias("d"))
    lines = met.where(same).groupBy(*line).agg(F.collect_set(each_window).alias("met")).select(F.struct("__id", "item_id", "line").alias("key"), "met")
    types = f"struct<__id: {kind}, item_id: {wanted.schema['item_id'].dataType.simpleString()}, line: int>"
    runs = map_rows(lines, f"key {types}, n long", lambda: lambda key, met: {"key": key, "n": [agreeing(m, window) for m in met]}, "key", "met").where("n > 0")
    runs = runs.groupBy("key").agg(F.max("n").alias("n")).select("key.*", "n")  # of rows that share their id
    by_doc = runs.groupBy("__id").agg(F.sum("n").alias("n_windows"), F.array_sort(F.collect_set("item_id")).alias("item_ids"))
    out = scanned.join(by_doc, F.col(id_column).eqNullSafe(F.col("__id")), "left")
    return out.select(
        id_column, "n_words", F.coalesce("n_windows", F.lit(0)).alias("n_windows"), F.coalesce(F.size("item_ids"), F.lit(0)).cast("long").alias("n_items"),
        F.array_join(F.transform("item_ids", lambda x: x.cast("string")), ",").alias("item_ids"), F.col("n_windows").isNotNull().alias("contaminated"),
    )
