"""URL filter: a blocked Bloom filter of listed canonical URLs, then an exact hash join of the possible hits.

A listed entry is a host and a path. It covers the host and all its subdomains wherever the URL's path starts with the
entry's path. Every URL is canonicalised to (host, path) and asked for each (host suffix, path prefix) it could be
listed under; suffix depths and prefix lengths are those that occur in the list, so no URL makes more keys than the list
has depths times lengths. Keys go through the filter; only possible hits reach the exact join.

Nulls, empty URLs and URLs without ``://`` have an empty host and path and match nothing. Repeated rows (a page or a
URL may hold a third of them) are counted before the join and given back afterwards. Extra columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Most blocks of the filter. A block is eight 64-bit words and a number, so the filter is never over 5 MB.
MAX_BLOCKS = 1 << 16
#: A list of up to this many entries goes to all executors; a longer one is joined by shuffling both sides.
BROADCAST_RULES = 50_000


def canonical(url: Column) -> tuple[Column, Column]:
    """Host (A-Z lower-cased) and path of a URL, by Spark expressions."""
    at = F.locate("://", F.coalesce(url, F.lit("")))
    rest = F.when(at > 0, F.substring(url, at + 3, F.length(url))).otherwise(F.lit(""))
    host = F.regexp_extract(rest, r"^([^/?#]*)", 1)
    path = F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1)
    return F.translate(host, UPPER, LOWER), path


def _key_hash(host: Column, path: Column) -> Column:
    return F.xxhash64(host, F.lit("\x00"), path)


def _mask(host: Column, path: Column, word: int) -> Column:
    """One bit of a block's word: six bits of a second hash for each word."""
    bit = F.shiftrightunsigned(F.xxhash64(path, F.lit("\x01"), host), 6 * word).bitwiseAND(F.lit(63))
    return F.call_function("shiftleft", F.lit(1).cast("long"), bit.cast("int"))


def bloom_blocks(rules: DataFrame, blocks: int) -> DataFrame:
    """The filter as a table of at most ``blocks`` rows: ``block`` and words ``w0`` to ``w7``."""
    host, path = F.col("rule_host"), F.col("rule_path")
    return (
        rules.select(F.pmod(_key_hash(host, path), F.lit(blocks)).alias("block"), *[_mask(host, path, i).alias(f"w{i}") for i in range(8)])
        .groupBy("block")
        .agg(*[F.bit_or(f"w{i}").alias(f"w{i}") for i in range(8)])
    )


def filter_urls(pages: DataFrame, rules: DataFrame, id_col: str = "page_id", url_col: str = "url", default: str = "allow", broadcast_rules: int = BROADCAST_RULES) -> DataFrame:
    """Judge each row of ``pages``: the id, ``host``, ``path``, ``rule`` (null if none) and ``verdict``.

    ``rules`` has ``rule_host``, ``rule_path``, ``verdict``; of fitting rules the longest (host and path together, then the
    longer host) wins. URLs that no rule fits get ``default``.
    """
    rules = rules.select("rule_host", "rule_path", "verdict").where("rule_host is not null and rule_path is not null").groupBy("rule_host", "rule_path").agg(F.max("verdict").alias("rule_verdict"))
    about = rules.agg(F.count(F.lit(1)).alias("n"), F.collect_set(F.size(F.split("rule_host", r"\."))).alias("depths"), F.collect_set(F.length("rule_path")).alias("lengths")).first()
    blocks = min(MAX_BLOCKS, max(16, 1 << (about["n"] // 24).bit_length()))
    depths, lengths = sorted(about["depths"]), sorted(about["lengths"])

    host, path = canonical(F.col(url_col))
    urls = pages.select(F.col(id_col).alias("id"), host.alias("host"), path.alias("path")).groupBy("id", "host", "path").agg(F.count(F.lit(1)).alias("copies"))
    parts = F.split("host", r"\.")
    suffixes = F.array(*[F.when(F.size(parts) >= d, F.array_join(F.slice(parts, -d, d), ".")) for d in depths]) if depths else F.array().cast("array<string>")
    prefixes = F.array(*[F.when(F.length("path") >= n, F.substring("path", 1, n)) for n in lengths]) if lengths else F.array().cast("array<string>")
    keys = F.flatten(F.transform(F.filter(suffixes, lambda s: s.isNotNull()), lambda s: F.transform(F.filter(prefixes, lambda p: p.isNotNull()), lambda p: F.struct(s.alias("rule_host"), p.alias("rule_path")))))
    asked = urls.select("*", F.explode_outer(F.when(F.col("host") != "", keys)).alias("k")).select("id", "host", "path", "copies", "k.rule_host", "k.rule_path")
    key = _key_hash(F.col("rule_host"), F.col("rule_path"))
    asked = asked.withColumn("block", F.pmod(key, F.lit(blocks)))

    bloom = F.broadcast(bloom_blocks(rules, blocks))  # at most MAX_BLOCKS rows
    passes = F.lit(True)
    for i in range(8):
        mask = _mask(F.col("rule_host"), F.col("rule_path"), i)
        passes = passes & (F.col(f"w{i}").bitwiseAND(mask) == mask)
    tested = asked.join(bloom, "block", "left").select("id", "host", "path", "copies", *[F.when(F.coalesce(passes, F.lit(False)), F.col(c)).alias(c) for c in ("rule_host", "rule_path")])

    if about["n"] <= broadcast_rules:
        judged = tested.join(F.broadcast(rules), ["rule_host", "rule_path"], "left")
    else:  # only possible hits are shuffled; the rest come back by the union
        found = tested.where("rule_host is not null").join(rules, ["rule_host", "rule_path"])
        judged = found.unionByName(urls, allowMissingColumns=True)
    rank = F.struct((F.length("rule_host") + F.length("rule_path")).alias("n"), F.length("rule_host").alias("h"), F.concat("rule_host", "rule_path").alias("rule"), F.col("rule_verdict").alias("verdict"))
    best = judged.groupBy("id", "host", "path").agg(F.max("copies").alias("copies"), F.max(F.when(F.col("rule_verdict").isNotNull(), rank)).alias("best"))
    return best.select(
        F.col("id").alias(id_col), "host", "path", F.col("best.rule").alias("rule"), F.coalesce("best.verdict", F.lit(default)).alias("verdict"), F.explode(F.sequence(F.lit(1).cast("long"), F.col("copies"))).alias("_copy")
    ).drop("_copy")
