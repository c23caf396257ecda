"""Byte-level BPE encoding and decoding with a bitmap rank queue.

A bucket for every merge rank holds the linked-list positions whose pair has
that rank, a two-level bitmap tells which buckets are filled, and
find-first-set on it gives the next rank. Entries whose pair has changed since
are skipped when they come up. No merge rescans its neighbours, so a pre-token
of n bytes takes O(n log n) and not O(n^2), and all new pre-tokens of some
texts share one queue.

The vocabulary is read on the driver from the path given and sent as a
broadcast; its size is that of the file. A task keeps the ids of pre-tokens it
has met in a table of at most ``CACHE`` entries that starts anew when full.

Null texts count as empty; empty texts have no ids.
"""

from __future__ import annotations

import base64
import hashlib
import re
from collections.abc import Iterator
from itertools import chain, islice

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame

from .common import map_rows

CACHE = 400_000
#: Pre-tokens that are looked up together; longer texts are split piecemeal.
CHUNK_PIECES = 100_000
#: Bytes of new pre-tokens that share one queue.
QUEUE_BYTES = 400_000
#: Longer pre-tokens are encoded each time, so that the cache stays small.
CACHED_CHARS = 64


def load_ranks(path: str) -> dict[bytes, int]:
    """Token bytes to rank, from a file of ``base64 rank`` lines."""
    with open(path, "rb") as lines:
        return {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, lines)}


def pair_ranks(ranks: dict[bytes, int]) -> dict[tuple[int, int], int | None]:
    """Rank of every pair of bytes."""
    return {(a, b): ranks.get(bytes((a, b))) for a in range(256) for b in range(256)}


def encode_pieces(pieces: list[bytes], ranks: dict[bytes, int], two: dict) -> list[tuple[int, ...]]:
    """Ids of each pre-token; one queue serves them all.

    ``buckets`` hold positions by rank, ``leaves`` have a bit for each filled
    bucket (256 ranks a word) and ``top`` a bit for each word that isn't empty.
    Pre-tokens don't touch, so taking the lowest rank of all of them keeps each
    one's own order. A bucket is emptied from the left; it is put back when a
    merge brings up a lower rank.
    """
    if not pieces:
        return []
    data = b"".join(pieces)
    n, get = len(data), ranks.get
    after = list(range(1, n + 1))
    before = list(range(-1, n))  # -1: begins a pre-token
    # rank of the pair that begins at a position; None: no such token, or merged away
    pair = list(map(two.__getitem__, zip(data, data[1:])))
    pair.append(None)
    end = 0
    for piece in pieces:
        before[end] = -1
        end += len(piece)
        pair[end - 1] = None
    before[n] = -1
    buckets: dict[int, list[int]] = {}
    for i, rank in enumerate(pair):
        if rank is not None:
            if rank in buckets:
                buckets[rank].append(i)
            else:
                buckets[rank] = [i]
    leaves: dict[int, int] = {}
    top = 0
    for rank in buckets:
        leaves[rank >> 8] = leaves.get(rank >> 8, 0) | 1 << (rank & 255)
        top |= 1 << (rank >> 8)
    while top:
        group = (top & -top).bit_length() - 1
        leaf = leaves[group]
        low = leaf & -leaf
        rank = group << 8 | low.bit_length() - 1
        bucket = buckets.pop(rank)
        leaves[group] = leaf = leaf ^ low
        if not leaf:
            top ^= 1 << group
        bucket.sort()
        for k, i in enumerate(bucket):
            if pair[i] != rank:
                continue  # stale
            gone = after[i]
            after[i] = end = after[gone]
            pair[gone] = pair[i] = None
            left, lowest = before[i], rank
            if before[end] >= 0:
                before[end] = i
                joined = get(data[i : after[end]])
                if joined is not None:
                    pair[i] = lowest = joined
                    if joined in buckets:
                        buckets[joined].append(i)
                    else:
                        buckets[joined] = [i]
                        group = joined >> 8
                        leaves[group] = leaves.get(group, 0) | 1 << (joined & 255)
                        top |= 1 << group
            if left >= 0:
                pair[left] = joined = get(data[left:end])
                if joined is not None:
                    if joined < lowest:
                        lowest = joined
                    if joined in buckets:
                        buckets[joined].append(left)
                    else:
                        buckets[joined] = [left]
                        group = joined >> 8
                        leaves[group] = leaves.get(group, 0) | 1 << (joined & 255)
                        top |= 1 << group
            if lowest < rank and k + 1 < len(bucket):
                buckets[rank] = bucket[k + 1 :]
                group = rank >> 8
                leaves[group] |= 1 << (rank & 255)
                top |= 1 << group
                break
    out, i, end = [], 0, 0
    for piece in pieces:
        end += len(piece)
        ids = []
        while i < end:
            j = after[i]
            ids.append(ranks[data[i:j]])
            i = j
        out.append(tuple(ids))
    return out


#: Code points (hexadecimal ranges) that the tokenizer library's
#: tables leave unassigned and ``regex`` calls letters or numbers.
LATER_LETTERS = """
558 58B-58C 88F C5C CDC 208F 209D-209F A7CE-A7CF A7D2 A7D4 A7DD A7E2 A7F1 AB6C-AB6D 107BB-107BF
10940-10959 10EC5-10EC7 10ED9-10EEE 11B0A 11DB0-11DDB 11DF1-11DF1 16EA0-16EB8 16EBB-16ED3
16FF2-16FF3 187F8-187FF 18CD6-18CDA 18D09-18D20 18D80-18DF2 18E00-19191 191A0-191D2 1B123-1B128
1B168 1D6A6 1DF1F-1DF24 1DF2B-1DF81 1DF90-1DF96 1DFCD-1DFFF 1E6C0-1E6DE 1E6E0-1E6E2 1E6E4-1E6E5
1E6E7-1E6ED 1E6F0-1E6F4 1E6FE-1E6FF 2B73A-2B73F 2B81E 2CEA2-2CEAD 323B0-33479 3D000-3FC3F
"""
LATER_NUMBERS = "11DE0-11DE9 1246F 12475-1247F 12550-12686 16FF4-16FF6"


def _ranges(text: str) -> str:
    """Hexadecimal ranges as the inside of a character class."""
    ends = (r.split("-") for r in text.split())
    return "".join("-".join(rf"\U{int(e, 16):08X}" for e in r) for r in ends)


def splitter(pattern: str):
    """Function from a text to the compiled form of ``pattern`` that suits it.

    Where the pattern only tells letters, numbers and space apart, texts without
    characters past U+024F go through the standard ``re``, which is faster, with
    those classes spelt out; the sets are the same. Texts with characters that
    were assigned after the library's tables get a form that leaves them out.
    """
    letters, numbers = _ranges(LATER_LETTERS), _ranges(LATER_NUMBERS)
    general = regex.compile(pattern)
    later = regex.compile(f"[{letters}{numbers}]").search
    older = pattern.replace(r"\p{L}", rf"[\p{{L}}--[{letters}]]").replace(r"\p{N}", rf"[\p{{N}}--[{numbers}]]")
    older = regex.compile(older, regex.V1)
    special = lambda text: older if later(text) else general
    plain = re.compile("[^\x00-\u024f]").search
    low = [chr(c) for c in range(0x250)]
    of = {k: "".join(re.escape(c) for c in low if regex.match(k, c)) for k in (r"\p{L}", r"\p{N}", r"\s")}
    # an alternative for letters begins with no character that an apostrophe's does, so it may come first
    parts = pattern.split("|")
    if " ?\\p{L}+" in parts and all(x.startswith("'") for x in parts[: parts.index(" ?\\p{L}+")]):
        parts.remove(" ?\\p{L}+")
        parts.insert(0, " ?\\p{L}+")
    spelt = "|".join(parts).replace(r"[^\s\p{L}\p{N}]", "[^" + "".join(of.values()) + "]").replace(r"\S", "[^" + of[r"\s"] + "]")
    for kind, characters in of.items():
        spelt = spelt.replace(kind, "[" + characters + "]")
    if re.search(r"\\[pPsSwWdDbB]", re.sub(r"\\\\", "", spelt)):
        return special
    fast = re.compile(spelt)
    return lambda text: special(text) if plain(text) else fast


class Codec:
    """Encoder and decoder of one Python worker."""

    def __init__(self, ranks: dict[bytes, int], pattern: str):
        self.ranks = ranks
        self.two = pair_ranks(ranks)
        self.form = splitter(pattern)
        self.known: dict[str, tuple[int, ...]] = {}
        self.bytes_of = [b""] * (max(ranks.values(), default=-1) + 1)
        for token, rank in ranks.items():
            self.bytes_of[rank] = token

    def _split(self, texts: list[str | None]) -> Iterator[tuple[list[str], bool]]:
        """(pre-tokens, whether the text ends with them) of every text in order."""
        for text in texts:
            if not text:
                yield [], True
            elif len(text) <= CHUNK_PIECES:
                yield self.form(text).findall(text), True
            else:
                found = (m.group() for m in self.form(text).finditer(text))
                part, ended = list(islice(found, CHUNK_PIECES)), False
                while not ended:
                    ahead = list(islice(found, CHUNK_PIECES))
                    ended = not ahead
                    yield part, ended
                    part = ahead

    def _learn(self, wanted: list[list[str]]) -> list[str]:
        """Puts the ids of all these pre-tokens into ``known``; returns the ones too long to stay."""
        known = self.known
        new = set(chain.from_iterable(wanted)).difference(known)
        if len(known) + len(new) > CACHE:
            known = self.known = {}
            new = set(chain.from_iterable(wanted))
        group, size = [], 0
        for x in new:
            raw = x.encode("utf-8", "replace")
            rank = self.ranks.get(raw)
            if rank is not None:  # a token as it stands needs no merge
                known[x] = (rank,)
                continue
            group.append((x, raw))
            size += len(raw)
            if size > QUEUE_BYTES:
                known.update(zip((g[0] for g in group), encode_pieces([g[1] for g in group], self.ranks, self.two)))
                group, size = [], 0
        known.update(zip((g[0] for g in group), encode_pieces([g[1] for g in group], self.ranks, self.two)))
        return [x for x in new if len(x) > CACHED_CHARS]

    def by_piece(self, texts: list[str | None]) -> Iterator[tuple[list[tuple[int, ...]], bool]]:
        """(ids of pre-tokens, whether the text ends with them) of every text in
        order; no more than about CHUNK_PIECES pre-tokens are held at a time."""
        held, size = [], 0

        def told():
            long = self._learn([found for found, _ in held])
            get = self.known.__getitem__
            for found, ended in held:
                yield list(map(get, found)), ended
            for x in long:
                del self.known[x]

        for part in self._split(texts):
            held.append(part)
            size += len(part[0])
            if size >= CHUNK_PIECES:
                yield from told()
                held, size = [], 0
        yield from told()

    def encode(self, texts: list[str | None]) -> Iterator[list[int]]:
        ids: list[int] = []
        for pieces, ended in self.by_piece(texts):
            ids += chain.from_iterable(pieces)
            if ended:
                yield ids
                ids = []

    def count(self, texts: list[str | None]) -> list[int]:
        out, n = [], 0
        for pieces, ended in self.by_piece(texts):
            n += sum(map(len, pieces))
            if ended:
                out.append(n)
                n = 0
        return out

    def decode(self, ids) -> bytes:
        return b"".join(map(self.bytes_of.__getitem__, ids))


_codecs: dict[tuple, Codec] = {}


def codec_for(vocabulary, pattern: str) -> Codec:
    """The codec of this Python worker; workers serve many tasks, so it is kept."""
    key = (vocabulary.id if hasattr(vocabulary, "id") else id(vocabulary), pattern)
    if key not in _codecs:
        _codecs.clear()
        _codecs[key] = Codec(vocabulary.value, pattern)
    return _codecs[key]


def encode(docs: DataFrame, path: str, pattern: str, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """(id, ids array<int>) of every text."""
    ranks = docs.sparkSession.sparkContext.broadcast(load_ranks(path))

    def each():
        codec = codec_for(ranks, pattern)
        return lambda key, text: {id_column: key, "ids": list(codec.encode(text))}

    kind = docs.schema[id_column].dataType.simpleString()
    return map_rows(docs, f"`{id_column}` {kind}, ids array<int>", each, id_column, text_column)


def decode(encoded: DataFrame, path: str, id_column: str = "doc_id", ids_column: str = "ids") -> DataFrame:
    """(id, text) of every id list; bytes that aren't UTF-8 become U+FFFD."""
    ranks = encoded.sparkSession.sparkContext.broadcast(load_ranks(path))

    def each():
        codec = codec_for(ranks, "")
        return lambda key, ids: {id_column: key, "text": [codec.decode(x or []).decode("utf-8", "replace") for x in ids]}

    kind = encoded.schema[id_column].dataType.simpleString()
    return map_rows(encoded, f"`{id_column}` {kind}, text string", each, id_column, ids_column)


def round_trip(docs: DataFrame, path: str, pattern: str, id_column: str = "doc_id", text_column: str = "text", with_ids: bool = False) -> DataFrame:
    """Encodes and decodes every text in one pass: (id, n_tokens, ids_sha256,
    decoded_sha256, n_bytes, exact), the digests over the decimal ids joined by
    commas and over the decoded bytes; ids as well if ``with_ids``.

    Long texts pass through piecemeal; only ids that are returned are kept, as
    32-bit integers."""
    ranks = docs.sparkSession.sparkContext.broadcast(load_ranks(path))
    told = ("n_tokens", "ids_sha256", "decoded_sha256", "n_bytes", "exact")

    def each():
        codec = codec_for(ranks, pattern)
        decimal = [str(i) for i in range(len(codec.bytes_of))]

        def work(key, text):
            out: dict = {n: [] for n in told}
            kept, offsets = [], [0]
            source = iter(text)

            def begin():
                return [0, hashlib.sha256(), hashlib.sha256(), 0, hashlib.sha256((next(source, None) or "").encode("utf-8", "replace"))]

            now = begin() if text else None
            for pieces, ended in codec.by_piece(text):
                ids = list(chain.from_iterable(pieces))
                back = codec.decode(ids)
                if now[0] and ids:
                    now[1].update(b",")
                now[0] += len(ids)
                now[1].update(",".join(map(decimal.__getitem__, ids)).encode())
                now[2].update(back)
                now[3] += len(back)
                if with_ids:
                    kept.append(np.fromiter(ids, np.int32, len(ids)))
                if ended:
                    row = (now[0], now[1].hexdigest(), now[2].hexdigest(), now[3], now[2].digest() == now[4].digest())
                    for name, value in zip(told, row):
                        out[name].append(value)
                    offsets.append(offsets[-1] + now[0])
                    now = begin()
            if with_ids:
                values = np.concatenate(kept) if kept else np.empty(0, np.int32)
                out["ids"] = pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(values))
            return out | {id_column: key}

        return work

    kind = docs.schema[id_column].dataType.simpleString()
    schema = f"`{id_column}` {kind}, n_tokens long, ids_sha256 string, decoded_sha256 string, n_bytes long, exact boolean" + ", ids array<int>" * with_ids
    return map_rows(docs, schema, each, id_column, text_column)
