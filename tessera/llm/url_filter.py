"""URL filters: host and path rules, then a blocked Bloom filter before an exact join. DataFrame functions only.

Rows: one result row per input row. A null url, or one without ``://``, has an empty host and path; no rule fits it and it is never listed.
Repeated rows and ties give equal rows. Empty tables give empty results. Only the named columns of the input are read, so extra columns
(also with the names used here) do not matter.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import lower_ascii

#: (action, rule): host and path prefix; a rule fits its host and every subdomain.
RULES = [("block", "com/en/"), ("allow", "example.com/en/7"), ("allow", "net/de/"), ("block", "example.net/de/8"), ("block", "org/es/")]
#: Query parameters that never change a page.
TRACKING = ("utm_", "ref=", "fbclid=", "gclid=", "sessionid=")
#: A filter of at most this many bytes is broadcast; a larger one is joined by a shuffle.
BROADCAST_BYTES = 4 << 20
BITS_PER_KEY, BLOCK_BITS = 16, 256


def after_scheme(url: Column) -> Column:
    at = F.instr(url, "://")
    return F.when(at > 0, F.expr("substring(url, instr(url, '://') + 3)"))


def url_parts(df: DataFrame) -> DataFrame:
    """Adds host, path and canonical to a frame with a column url."""
    rest = df.withColumn("_rest", F.coalesce(after_scheme(F.col("url")), F.lit("")))
    rest = rest.withColumn("host", lower_ascii(F.regexp_extract("_rest", r"^([^/?#]*)", 1))).withColumn("path", F.regexp_extract("_rest", r"^[^/?#]*([^?#]*)", 1))
    query = F.regexp_extract("_rest", r"^[^?#]*\?([^#]*)", 1)
    kept = F.filter(F.split(query, "&"), lambda p: (p != "") & ~F.exists(F.array(*[F.lit(t) for t in TRACKING]), lambda t: F.startswith(p, t)))
    bare = F.regexp_replace(F.regexp_replace("host", r"^www\.", ""), r":(80|443)$", "")
    page = F.regexp_replace("path", r"/+$", "")
    return rest.withColumn("canonical", F.concat(bare, page, F.lit("?"), F.array_join(F.array_sort(kept), "&"))).drop("_rest")


def rule_of(rules: list[tuple[str, str]]) -> tuple[Column, Column]:
    """The longest fitting rule and its action, null if none fits."""
    text, action = F.lit(None).cast("string"), F.lit(None).cast("string")
    for act, rule in sorted(rules, key=lambda r: len(r[1])):
        host, slash, tail = rule.partition("/")
        fits = ((F.col("host") == host) | F.endswith("host", F.lit("." + host))) & F.startswith("path", F.lit(slash + tail))
        text, action = F.when(fits, rule).otherwise(text), F.when(fits, act).otherwise(action)
    return text, action


def bloom_words(key: str, blocks: int) -> dict[str, Column]:
    """The block of a key and one set bit in each of the block's four 64-bit words."""
    second = F.xxhash64(F.col(key), F.lit(7))
    words = {f"w{i}": F.call_function("shiftleft", F.lit(1).cast("long"), F.shiftrightunsigned(second, 6 * i).bitwiseAND(F.lit(63)).cast("int")) for i in range(4)}
    return {"block": F.pmod(F.xxhash64(F.col(key)), F.lit(blocks))} | words


def bloom_filter(listed: DataFrame, key: str, blocks: int) -> DataFrame:
    """One row per non-empty block: its four words. Partial bit_or runs before the shuffle."""
    return listed.select(*[c.alias(n) for n, c in bloom_words(key, blocks).items()]).groupBy("block").agg(*[F.bit_or(f"w{i}").alias(f"f{i}") for i in range(4)])


def filter_urls(pages: DataFrame, listed: DataFrame, id_col: str = "page_id", rules: list[tuple[str, str]] = RULES) -> DataFrame:
    """Judge each page: a fitting rule decides; else a page whose canonical URL is among `listed` (column url) is blocked.

    The blocked Bloom filter of the list passes possible hits to an exact hash join, which removes its false positives.
    """
    urls = url_parts(pages.select(F.col(id_col).alias(id_col), F.col("url").cast("string").alias("url")))
    text, action = rule_of(rules)
    urls = urls.withColumn("rule", text).withColumn("_action", action)
    keys = url_parts(listed.select(F.col("url").cast("string").alias("url"))).filter("host <> ''").select("canonical").distinct()
    blocks = max(1, -(-keys.count() * BITS_PER_KEY // BLOCK_BITS))
    blooms = bloom_filter(keys, "canonical", blocks)
    if blocks * (8 + BLOCK_BITS // 8) <= BROADCAST_BYTES:
        blooms = F.broadcast(blooms)
    probe = urls
    for name, c in bloom_words("canonical", blocks).items():
        probe = probe.withColumn(name, c)
    hit = F.lit(True)
    for i in range(4):
        hit = hit & (F.coalesce(F.col(f"f{i}"), F.lit(0)).bitwiseAND(F.col(f"w{i}")) != 0)
    probe = probe.join(blooms, "block", "left").withColumn("_maybe", hit & (F.col("host") != ""))
    exact = probe.filter("_maybe").join(keys.withColumn("_listed", F.lit(True)), "canonical", "left")
    out = exact.withColumn("listed", F.coalesce("_listed", F.lit(False))).drop("_listed").unionByName(probe.filter("not _maybe").withColumn("listed", F.lit(False)))
    verdict = F.coalesce("_action", F.when(F.col("listed"), "block").otherwise("allow"))
    return out.select(id_col, "host", "path", "rule", verdict.alias("verdict"), "canonical", "listed")
