"""A count table on disk that is looked up by key: packed keys, bucketed and sorted, so that a lookup never moves the table.

A context is a bigint: a leading 1, then two bits a letter, so contexts of up to 31 letters and those padded with start symbols have keys of their
own (the fewer letters, the smaller the key). The store keeps a row per context with an array of cells per group. Contexts asked for are
dealt like the store's buckets and each bucket is joined with its part; Spark reads the store where it lies.

A folder has the buckets' files and a table of what the store is (alphabet, lag, groups, buckets). Opening a folder without one raises.
"""

from __future__ import annotations

import hashlib
import math

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from seqloom.functions import symbols as S
from seqloom.operators import cells

#: Contexts to a bucket, about.
PER_BUCKET = 2_000_000
LONGEST = 31


def packed_key(kmer: Column, alphabet: str = "dna") -> Column:
    """The bigint of a context; null for one with other symbols than letters and leading starts, or with over 31 letters."""
    letters = S.ALPHABETS[alphabet]
    if len(letters) != 4:
        raise ValueError(f"keys take two bits a letter, and {alphabet} has {len(letters)}")
    body = F.regexp_replace(kmer, f"^\\{S.START}+", "")
    key = F.conv(F.concat(F.lit("1"), F.translate(body, letters, "0123")), 4, 10).cast("bigint")
    return F.when(body.rlike(f"^[{letters}]{{0,{LONGEST}}}$"), key)


def unpacked_key(key: Column, lag: int, alphabet: str = "dna") -> Column:
    """The context of a key, padded with starts to the lag."""
    digits = F.conv(key.cast("string"), 10, 4)
    return F.lpad(F.translate(F.substring(digits, 2, LONGEST + 1), "0123", S.ALPHABETS[alphabet]), lag, S.START)


class KmerStore:
    def __init__(self, spark: SparkSession, path: str, alphabet: str, lag: int, n_groups: int, buckets: int):
        self.spark, self.path, self.alphabet, self.lag, self.n_groups, self.buckets = spark, path, alphabet, lag, n_groups, buckets
        self.name = "kmers_" + hashlib.md5(path.encode()).hexdigest()
        schema = "key bigint, " + ", ".join(f"g{g} array<bigint>" for g in range(n_groups))
        spark.sql(f"CREATE TABLE IF NOT EXISTS {self.name} ({schema}) USING parquet CLUSTERED BY (key) SORTED BY (key) INTO {buckets} BUCKETS LOCATION '{path}/cells'")

    @classmethod
    def write(cls, table: DataFrame, path: str, lag: int, alphabet: str = "dna", n_rows: int | None = None) -> KmerStore:
        """Make the store of a count table in either form, one row per context, over what the folder had. The table may have the contexts' keys for them.
        n_rows: how many rows it has, at most. One shuffle."""
        spark, of = table.sparkSession, cells.groups(table)
        n_rows = table.count() if n_rows is None else n_rows
        buckets = max(2 ** min(14, max(0, math.ceil(math.log2(max(1, n_rows) / PER_BUCKET)))), int(spark.conf.get("spark.sql.shuffle.partitions")))
        unfit = F.raise_error(F.concat(F.lit("a context that has no key: "), F.col("kmer"))).cast("bigint")
        key = F.col("key") if "key" in table.columns else F.coalesce(packed_key(F.col("kmer"), alphabet), unfit)
        rows = table.select(key.alias("key"), *[cells.counts(table, g).alias(f"g{g}") for g in of])
        name = "kmers_" + hashlib.md5(path.encode()).hexdigest()
        spark.sql(f"DROP TABLE IF EXISTS {name}")
        # the description goes last: a folder whose cells are not whole has none
        rows.repartition(buckets, "key").write.mode("overwrite").format("parquet").bucketBy(buckets, "key").sortBy("key").option("path", f"{path}/cells").saveAsTable(name)
        spark.createDataFrame([(alphabet, lag, len(of), buckets)], "alphabet string, lag int, n_groups int, buckets int").coalesce(1).write.mode("overwrite").parquet(f"{path}/store")
        return cls(spark, path, alphabet, lag, len(of), buckets)

    @classmethod
    def open(cls, spark: SparkSession, path: str) -> KmerStore:
        try:
            said = spark.read.parquet(f"{path}/store").first()
        except AnalysisException as e:
            raise FileNotFoundError(f"{path} holds no k-mer store") from e
        return cls(spark, path, said["alphabet"], said["lag"], said["n_groups"], said["buckets"])

    def close(self) -> None:
        """Take the table out of the session's catalog; the files stay."""
        self.spark.sql(f"DROP TABLE IF EXISTS {self.name}")

    def rows(self) -> DataFrame:
        """(key, g0, g1, ...)"""
        return self.spark.table(self.name)

    def lookup(self, contexts: DataFrame) -> DataFrame:
        """(kmer, g0, g1, ...) of each distinct context asked for, zeros for those the store lacks. The store's side of the join is its scan alone."""
        asked = contexts.select("kmer").distinct().select("kmer", packed_key(F.col("kmer"), self.alphabet).alias("key")).repartition(self.buckets, "key")
        none = F.array_repeat(F.lit(0).cast("bigint"), cells.width(self.alphabet))
        found = asked.join(self.rows().hint("merge"), "key", "left")
        return found.select("kmer", *[F.coalesce(f"g{g}", none).alias(f"g{g}") for g in range(self.n_groups)])
