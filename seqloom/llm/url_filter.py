"""URL filters: rules by host and path, and a list of whole URLs, behind one blocked Bloom filter and one exact join.

Rules (host, path, verdict) fit a host with all its subdomains and paths that start with theirs; the longest rule wins. A listed URL is
blocked in every form that has its canonical form: scheme, login, default port, "www.", final dots and slashes, fragment and
tracking parameters go, the other parameters are sorted.

Rules and listed URLs are keys of one table. A URL makes its canonical key and, for each shape of the rules (labels of the host, length of the
path), the key that a rule of that shape would have; there are as many as shapes, whatever the number of rules.
Keys are looked up in a Bloom filter of one block of eight 64-bit words each, a bit in every word. Spark builds the blocks by bit_or. Up to
MOST_BLOCKS blocks they are broadcast as one array and tasks test their keys with numpy; beyond, keys meet their blocks by a
join of distinct keys. Keys that pass go to an exact hash join with the table, which removes false positives; a key that many URLs have is
looked up by broadcast (fewer than 512 such can be). URLs without possible hits never move.

Defined results: a null url, or one without "://", has an empty host and path, no rule and no canonical form and is allowed; ports and logins
are part of the host column, and so no rule fits them; a URL without a path fits no rule with a path "/"; of equally long rules the one with the
longer host wins, and of the same rule said twice `block`; repeated rows each get their result; very long urls are taken
whole; empty tables give empty results; other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from seqloom.llm._common import hot_lookup, stored

#: The rules of the contract (host, path, verdict).
RULES = [("net", "/", "block"), ("example.net", "/en/", "allow"), ("example.com", "/de/", "block"), ("org", "/fr/", "allow")]
#: Parameters that don't change what a URL shows.
TRACKING = r"^(utm_|(ref|referrer|fbclid|gclid|msclkid|mc_cid|mc_eid|igshid|session_?id)\z)"
BITS_PER_KEY, WORDS = 16, 8
#: Blocks of 64 bytes that are broadcast: 64 MB.
MOST_BLOCKS = 1 << 20


def host_of(url: Column) -> Column:
    return F.translate(F.coalesce(F.regexp_extract(url, "://([^/?#]*)", 1), F.lit("")), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def path_of(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, "://[^/?#]*([^?#]*)", 1), F.lit(""))


def canonical(url: Column) -> Column:
    """The form that all ways to write a URL share; null where there is no host."""
    host = F.regexp_replace(F.regexp_replace(host_of(url), "^(?s:.*)@", ""), r"\.*(:(80|443)?)?\z", "")
    host = F.regexp_replace(host, r"^www\.", "")
    path = F.regexp_replace(path_of(url), r"/+\z", "")
    said = F.split(F.regexp_extract(url, r"://[^?#]*\?([^#]*)", 1), "&")
    kept = F.array_sort(F.filter(said, lambda x: (x != "") & ~F.substring_index(x, "=", 1).rlike(TRACKING)))
    return F.when(host != "", F.concat(host, path, F.when(F.size(kept) > 0, F.concat(F.lit("?"), F.array_join(kept, "&"))).otherwise("")))


def rule_table(spark: SparkSession, rules: Sequence[tuple[str, str, str]] = RULES) -> DataFrame:
    return spark.createDataFrame(list(rules), "host string, path string, verdict string")


def keys_of(rules: DataFrame, listed: DataFrame) -> DataFrame:
    """(key, rule, verdict, rank): one row for each rule and each listed canonical URL (url). rank orders the rules of a URL."""
    checked = F.when((F.col("host") != "") & F.col("verdict").isin("allow", "block"), F.col("host")).otherwise(F.raise_error(F.lit("a rule needs a host and the verdict allow or block")))
    said = F.concat("host", "path")
    own = rules.select(F.concat(F.lit("r "), said).alias("key"), said.alias("rule"), "verdict", F.struct(F.length(said).alias("length"), F.length(checked).alias("host")).alias("rank"))
    own = own.groupBy("key", "rule", "rank").agg(F.max("verdict").alias("verdict"))
    others = listed.filter("url is not null").select(F.concat(F.lit("u "), F.col("url")).alias("key")).distinct()
    rank = F.struct(F.lit(-1).alias("length"), F.lit(-1).alias("host"))
    return own.select("key", "rule", "verdict", "rank").unionByName(others.select("key", F.lit(None).cast("string").alias("rule"), F.lit("block").alias("verdict"), rank.alias("rank")))


def shapes_of(rules: DataFrame) -> list[tuple[int, int]]:
    """The distinct (labels of the host, length of the path) of the rules; rules have few, as hosts have few labels and path prefixes are short."""
    found = rules.select(F.size(F.split("host", r"\.")).alias("labels"), F.length("path").alias("length")).distinct()
    return sorted((r["labels"], r["length"]) for r in found.collect())


def _hashes(key: Column) -> tuple[Column, Column]:
    """What tells a key's block, and its bits."""
    return F.xxhash64(key), F.xxhash64(key, F.lit(1))


class BlockedBloom:
    """The blocks of a table's keys: (block, w0..w7), of n blocks in all; only blocks with a bit are rows."""

    def __init__(self, keys: DataFrame, n_keys: int, most_blocks: int = MOST_BLOCKS):
        self.n = max(1, -(-n_keys * BITS_PER_KEY // (64 * WORDS)))
        at, bits = _hashes(F.col("key"))
        each = keys.select(F.pmod(at, F.lit(self.n)).alias("block"), bits.alias("bits"))
        one = lambda k: F.call_function("shiftleft", F.lit(1).cast("bigint"), F.call_function("shiftrightunsigned", F.col("bits"), F.lit(6 * k)).bitwiseAND(F.lit(63)).cast("int"))
        self.blocks = stored(each.groupBy("block").agg(*[F.bit_or(one(k)).alias(f"w{k}") for k in range(WORDS)]), "bloom")
        self.small = self.n <= most_blocks

    def array(self) -> np.ndarray:
        """All blocks, for a broadcast; 64 bytes each, MOST_BLOCKS at most."""
        found = self.blocks.toArrow()
        out = np.zeros((self.n, WORDS), np.int64)
        out[found.column("block").to_numpy()] = np.stack([found.column(f"w{k}").to_numpy() for k in range(WORDS)], axis=1)
        return out

    def possible(self, keys: DataFrame, hint: str = "shuffle_hash") -> DataFrame:
        """The rows of keys (key, ...) whose bits are all set, by a join with the blocks."""
        at, bits = _hashes(F.col("key"))
        each = keys.withColumn("_block", F.pmod(at, F.lit(self.n))).withColumn("_bits", bits)
        met = each.join(self.blocks.withColumnRenamed("block", "_block").hint(hint), "_block")
        place = lambda k: F.call_function("shiftrightunsigned", F.col("_bits"), F.lit(6 * k)).bitwiseAND(F.lit(63)).cast("int")
        for k in range(WORDS):
            met = met.filter(F.call_function("shiftright", F.col(f"w{k}"), place(k)).bitwiseAND(F.lit(1).cast("bigint")) == 1)
        return met.select(*keys.columns)


def _tested(blocks):
    """(page_id, host, path, keys, hashes, bits) to (page_id, host, path, keys that may be in the table)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = blocks.value
        for b in batches:
            keys = b.column(3)
            at, bits = (b.column(k).flatten().to_numpy(zero_copy_only=False) for k in (4, 5))
            words = table[np.mod(at, len(table))]
            hit = np.ones(len(at), bool)
            for k in range(WORDS):
                hit &= (words[:, k] >> ((bits >> (6 * k)) & 63)) & 1 == 1
            ends = np.concatenate([[0], np.cumsum(keys.value_lengths().to_numpy(zero_copy_only=False))]).astype(np.int64)
            kept = np.concatenate([[0], np.cumsum(hit)])[ends]
            lists = pa.ListArray.from_arrays(pa.array(kept, pa.int32()), keys.flatten().filter(pa.array(hit)))
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), b.column(2), lists], ["page_id", "host", "path", "keys"])

    return run


def judge(pages: DataFrame, rules: DataFrame, listed: DataFrame, most_blocks: int = MOST_BLOCKS) -> DataFrame:
    """(page_id, host, path, rule, verdict) for every row of pages (page_id, url), by rules (host, path, verdict) and listed URLs (url, canonical)."""
    spark = pages.sparkSession
    table = stored(keys_of(rules, listed), "listed")
    bloom = BlockedBloom(table, table.count(), most_blocks)
    url, host, path = pages["url"].cast("string"), F.col("host"), F.col("path")
    urls = pages.select(pages["page_id"].cast("bigint").alias("page_id"), host_of(url).alias("host"), path_of(url).alias("path"), F.concat(F.lit("u "), canonical(url)).alias("own"))
    of_rules = [F.concat(F.lit("r "), F.substring_index("host", ".", -labels), F.left(path, F.lit(length))) for labels, length in shapes_of(rules)]
    keys = F.when(host != "", F.array_distinct(F.array_compact(F.array(F.col("own"), *of_rules)))).otherwise(F.array().cast("array<string>"))
    rows = urls.select("page_id", "host", "path", keys.alias("keys"))
    if bloom.small:
        at, bits = _hashes(F.col("x"))
        hashed = rows.select("*", F.transform("keys", lambda x: F.xxhash64(x)).alias("at"), F.transform("keys", lambda x: F.xxhash64(x, F.lit(1))).alias("bits"))
        rows = hashed.mapInArrow(_tested(spark.sparkContext.broadcast(bloom.array())), "page_id bigint, host string, path string, keys array<string>")
    rows = stored(rows.withColumn("uid", F.monotonically_increasing_id()), "urls")  # ids are fixed by what was written

    each = rows.select("uid", "page_id", "host", "path", F.explode("keys").alias("key"))
    asked = each.groupBy("key").agg(F.count(F.lit(1)).alias("n"))
    known = table.hint("shuffle_hash")
    exact = known if bloom.small else bloom.possible(asked).drop("n").join(known, "key").hint("shuffle_hash")
    answers = stored(asked.join(exact, "key", "left"), "answers")
    total = answers.agg(F.sum("n")).first()[0] or 0
    found = hot_lookup(each, answers, "key", "n", total)
    best = F.max(F.when(F.col("verdict").isNotNull(), F.struct("rank", "rule", "verdict")))
    told = found.groupBy("uid", "page_id", "host", "path").agg(best.alias("best"))
    out = lambda df, rule, verdict: df.select("page_id", "host", "path", rule.cast("string").alias("rule"), F.coalesce(verdict, F.lit("allow")).alias("verdict"))
    return out(told, F.col("best.rule"), F.col("best.verdict")).unionByName(out(rows.filter(F.size("keys") == 0), F.lit(None), F.lit(None).cast("string")))


def reserved(pages: DataFrame) -> DataFrame:
    """(url): the canonical URLs of pages whose html reserves all rights; a list of what is not to be used, under any form of its URL."""
    return pages.filter(F.lower(pages["html"].cast("string")).contains("all rights reserved")).select(canonical(pages["url"].cast("string")).alias("url"))
