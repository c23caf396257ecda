"""URL filters: host and path rules, and a blocked Bloom filter before an exact join.

Listed URLs are brought to a canonical form and set eight bits each in one
512-bit block of the filter, which is built by a grouped bit_or. A page whose
block lacks one of its bits isn't listed. The others, listed pages and a few
false positives, go to an exact join on the canonical URL, which settles them.
The filter has ``bits_per_key`` bits for each listed URL; it is broadcast while
it has at most ``broadcast_blocks`` blocks (72 bytes each) and is joined by
shuffle beyond that.

Columns of the pages that bear a name of the result (host, path, rule, verdict,
in_list) are replaced.

A null URL, or one without ``://``, has an empty host and path, no canonical
form and no rule, and is allowed. Repeated rows are judged row by row.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import stored

WORDS = 8


def lower_ascii(text: Column) -> Column:
    return F.translate(text, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def _after_scheme(url: Column) -> Column:
    at = F.locate("://", url)
    return F.when(at > 0, F.substring(url, at + 3, F.length(url)))


def host_of(url: Column) -> Column:
    """What stands between the first ``://`` and ``/ ? #``, A-Z lower-cased."""
    return lower_ascii(F.coalesce(F.regexp_extract(_after_scheme(url), r"^([^/?#]*)", 1), F.lit("")))


def path_of(url: Column) -> Column:
    """What follows the host, up to ``?`` or ``#``."""
    return F.coalesce(F.regexp_extract(_after_scheme(url), r"^[^/?#]*([^?#]*)", 1), F.lit(""))


def canonical_url(url: Column) -> Column:
    """Host without ``www.`` and default port, path without a final slash or
    ``.html``, and the query's parameters in order without tracking ones; null
    where there is no host."""
    host = F.regexp_replace(F.regexp_replace(host_of(url), r"^www\.", ""), r":(80|443)$", "")
    path = F.regexp_replace(F.regexp_replace(path_of(url), r"/+$", ""), r"\.html?$", "")
    query = F.regexp_extract(_after_scheme(url), r"^[^?#]*\?([^#]*)", 1)
    kept = F.array_sort(F.filter(F.split(query, "&"), lambda p: (p != "") & ~p.rlike(r"^(utm_[a-z]+|ref|fbclid|gclid)(=|$)")))
    return F.when(host != "", F.concat(host, path, F.when(F.size(kept) > 0, F.concat(F.lit("?"), F.array_join(kept, "&"))).otherwise("")))


def match_rules(pages: DataFrame, rules: list[tuple[str, str, str]], url_column: str = "url") -> DataFrame:
    """Adds host, path, rule and rule_verdict. ``rules``: (verdict, host, path);
    one fits its host and all subdomains where the page's path begins with its
    own; the longest host and path win. Rules are a short literal list."""
    pages = pages.withColumns({"host": host_of(F.col(url_column)), "path": path_of(F.col(url_column))})
    rule, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for kind, host, path in sorted(rules, key=lambda r: (len(r[1] + r[2]), r)):
        fits = ((F.col("host") == host) | F.col("host").endswith(f".{host}")) & F.col("path").startswith(path)
        rule, verdict = F.when(fits, host + path).otherwise(rule), F.when(fits, kind).otherwise(verdict)
    return pages.withColumns({"rule": rule, "rule_verdict": verdict})


def _bits(key: Column) -> list[Column]:
    """One bit for each word of the key's block."""
    places = (F.shiftrightunsigned(F.xxhash64(key, F.lit(i)), 58).cast("int") for i in range(WORDS))
    return [F.call_function("shiftleft", F.lit(1).cast("long"), place) for place in places]


def bloom_filter(listed: DataFrame, blocks: int, key: str = "canonical") -> DataFrame:
    """(block, w0..w7) of the distinct keys."""
    bits = listed.select(F.pmod(F.xxhash64(key), F.lit(blocks)).alias("block"), *(b.alias(f"w{i}") for i, b in enumerate(_bits(F.col(key)))))
    return bits.groupBy("block").agg(*(F.bit_or(f"w{i}").alias(f"w{i}") for i in range(WORDS)))


def judge(pages: DataFrame, listed: DataFrame, rules: list[tuple[str, str, str]], url_column: str = "url", bits_per_key: int = 16, broadcast_blocks: int = 1_000_000) -> DataFrame:
    """Pages with host, path, rule, verdict and in_list.

    ``listed`` has a column ``canonical``. The verdict is the rule's; without a
    rule, listed pages are blocked and others allowed.
    """
    pages = pages.drop("host", "path", "rule", "rule_verdict", "verdict", "in_list")
    listed = stored(listed.where(F.col("canonical").isNotNull()).select("canonical").distinct())
    blocks = max(1, -(-listed.count() * bits_per_key // (64 * WORDS)))
    table = bloom_filter(listed, blocks)
    if blocks <= broadcast_blocks:
        table = F.broadcast(table)
    table = table.select(F.col("block").alias("__block"), *(F.col(f"w{i}").alias(f"__w{i}") for i in range(WORDS)))
    nowhere = -1 - F.monotonically_increasing_id() % 4096  # pages without a key don't meet in one task
    judged = match_rules(pages, rules, url_column).withColumn("__key", canonical_url(F.col(url_column)))
    judged = judged.withColumn("__block", F.coalesce(F.pmod(F.xxhash64("__key"), F.lit(blocks)), nowhere))
    probed = judged.join(table, "__block", "left")
    every = F.lit(True)
    for i, bit in enumerate(_bits(F.col("__key"))):
        every = every & (F.col(f"__w{i}").bitwiseAND(bit) != 0)
    probed = probed.withColumn("__possible", F.coalesce(every & F.col("__key").isNotNull(), F.lit(False)))
    exact = listed.select(F.col("canonical").alias("__key"), F.lit(True).alias("in_list"))
    hits = probed.where("__possible").join(exact, "__key", "left").withColumn("in_list", F.coalesce("in_list", F.lit(False)))
    rest = probed.where(~F.col("__possible")).withColumn("in_list", F.lit(False))
    both = hits.unionByName(rest)
    verdict = F.coalesce("rule_verdict", F.when(F.col("in_list"), "block").otherwise("allow"))
    return both.withColumn("verdict", verdict).drop("rule_verdict", "__key", "__block", "__possible", *(f"__w{i}" for i in range(WORDS)))
