"""URL rules looked up through a blocked Bloom filter.

Every page address has a few candidate rules: each suffix of its host at a label
boundary with each prefix of its path that is as long as some rule's path. A
blocked Bloom filter of the listed (canonical) rules drops nearly all
candidates that are not listed; the rest go to an exact hash join, which removes
the filter's false positives. The longest rule that is left wins.

The filter has ``blocks`` blocks of 256 bits; a key sets one bit in each of the
four words of its block. Its size is fixed by the parameter, whatever the number
of rules, so it may be broadcast: with more rules than it is made for only the
exact join gets more rows.

Canonical form: host is what follows the first ``://`` up to ``/``, ``?``, ``#``
or the end, with A-Z lower-cased; path is what follows up to ``?``, ``#`` or the
end. Null addresses and those without ``://`` have empty host and path.

Defined results: one row per input row; an address that fits no rule gets rule
null and verdict ``allow``; of rules of the same length the longer host wins, of
the same host and path the verdict ``block``; rules with a null or empty host or
null path fit nothing; with no rules everything is allowed; an empty table gives
no rows; other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

BLOCKS = 1 << 14
WORDS = 4


def canonical_host(url: Column) -> Column:
    host = F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1)
    return F.coalesce(F.translate(host, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"), F.lit(""))


def canonical_path(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def _hash(host: Column, path: Column) -> Column:
    return F.xxhash64(host, F.lit("\x00"), path)


def _block(key: Column, blocks: int) -> Column:
    return F.pmod(F.shiftrightunsigned(key, 24), F.lit(blocks))


def _bit(key: Column, word: int) -> Column:
    """One of 64 bits, chosen by six bits of the hash that are this word's own."""
    at = F.shiftrightunsigned(key, 6 * word).bitwiseAND(F.lit(63)).cast("int")
    return F.call_function("shiftleft", F.lit(1).cast("bigint"), at)


def bloom_blocks(keys: DataFrame, blocks: int = BLOCKS) -> DataFrame:
    """``bloom_block, w0 .. w3`` from the hashes ``k``: at most ``blocks`` rows."""
    words = [F.bit_or(_bit(F.col("k"), w)).alias(f"w{w}") for w in range(WORDS)]
    return keys.groupBy(_block(F.col("k"), blocks).alias("bloom_block")).agg(*words)


def in_bloom(rows: DataFrame, key: Column, keys: DataFrame, blocks: int = BLOCKS) -> DataFrame:
    """The rows whose hash ``key`` may be among the hashes ``k`` of ``keys``; none of those is missed."""
    bloom = F.broadcast(bloom_blocks(keys, blocks))
    held = [F.col(f"w{w}").bitwiseAND(_bit(key, w)) != 0 for w in range(WORDS)]
    passed = rows.join(bloom, _block(key, blocks) == F.col("bloom_block")).filter(held[0] & held[1] & held[2] & held[3])
    return passed.select(*[F.col(c) for c in rows.columns])


def bloom_flag(rows: DataFrame, key: Column, keys: DataFrame, blocks: int = BLOCKS) -> DataFrame:
    """``rows`` with ``likely``: whether the hash ``key`` may be among the hashes ``k`` of ``keys``."""
    bloom = F.broadcast(bloom_blocks(keys, blocks))
    held = [F.col(f"w{w}").bitwiseAND(_bit(key, w)) != 0 for w in range(WORDS)]
    looked_up = rows.join(bloom, _block(key, blocks) == F.col("bloom_block"), "left")
    likely = F.coalesce(held[0] & held[1] & held[2] & held[3], F.lit(False))
    return looked_up.select(*[F.col(c) for c in rows.columns], likely.alias("likely"))


def _host_suffixes(host: Column) -> Column:
    labels = F.split(host, r"\.")
    return F.transform(
        F.sequence(F.lit(1), F.size(labels)),
        lambda i: F.array_join(F.slice(labels, i, F.size(labels) - i + 1), "."),
    )


def listed_urls(urls: DataFrame, rules: DataFrame, blocks: int = BLOCKS) -> DataFrame:
    """``host, path, rule, verdict`` of the distinct ``host, path`` rows that fit a rule."""
    clean = rules.filter("host <> '' AND path IS NOT NULL").select("host", "path", "verdict")
    clean = clean.groupBy("host", "path").agg(F.max("verdict").alias("verdict"))
    # No more lengths than the longest listed path has characters.
    lengths = F.lit(sorted(clean.agg(F.collect_set(F.length("path"))).first()[0])).cast("array<int>")
    prefixes = F.transform(
        F.filter(lengths, lambda n: n <= F.length("path")), lambda n: F.substring(F.col("path"), F.lit(1), n)
    )
    candidates = (
        urls.select("host", "path")
        .distinct()
        .filter("host <> ''")
        .withColumn("rule_host", F.explode(_host_suffixes(F.col("host"))))
        .withColumn("rule_path", F.explode(prefixes))
        .withColumn("k", _hash(F.col("rule_host"), F.col("rule_path")))
    )
    keys = clean.select(_hash(F.col("host"), F.col("path")).alias("k"))
    possible = in_bloom(candidates, F.col("k"), keys, blocks).select("host", "path", "rule_host", "rule_path")
    listed = clean.toDF("rule_host", "rule_path", "verdict")
    rule = F.concat("rule_host", "rule_path")
    return (
        possible.join(listed, ["rule_host", "rule_path"])
        .groupBy("host", "path")
        .agg(F.max(F.struct(F.length(rule), F.length("rule_host"), rule.alias("rule"), "verdict")).alias("best"))
        .select("host", "path", "best.rule", "best.verdict")
    )


def judge_urls(pages: DataFrame, rules: DataFrame, blocks: int = BLOCKS) -> DataFrame:
    """``page_id, host, path, rule, verdict`` for every row of ``pages`` (``page_id, url``).

    ``rules`` has ``host, path, verdict``: a rule fits its host and all
    subdomains where the address's path starts with the rule's path.
    """
    parsed = pages.select(
        "page_id", canonical_host(F.col("url")).alias("host"), canonical_path(F.col("url")).alias("path")
    )
    return parsed.join(listed_urls(parsed, rules, blocks), ["host", "path"], "left").select(
        "page_id", "host", "path", "rule", F.coalesce("verdict", F.lit("allow")).alias("verdict")
    )
