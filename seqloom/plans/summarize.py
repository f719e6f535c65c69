"""From a manifest of sequence files to count tables at every lag.

python -m seqloom.plans.summarize MANIFEST OUT_PREFIX -l 10 [-r] [-nf] [-pr] [-mf 0.1]

-pr writes the words of 1 to lag + 1 letters, and the prefixes and suffixes of 1 to lag, as a Parquet table PREFIX_parts by kind and length.
"""

from __future__ import annotations

import argparse

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from seqloom.functions import symbols as S
from seqloom.operators import counting
from seqloom.sources import files


def tables(reads: DataFrame, lag: int, reverse: bool = False) -> DataFrame:
    """(lag, kmer, g{group}_{letter}...) at each lag up to `lag`; reverse: of both strands. Counted once, then rolled up."""
    groups = reads.agg(F.max("grp")).first()[0]
    n_groups = 0 if groups is None else groups + 1
    every = counting.count_windows(counting.both_strands(reads) if reverse else reads, lag)
    long = counting.of_alphabet(counting.rolled_up(every, list(range(1, lag + 1))))
    return counting.wide(long, max(n_groups, 1), keys=("lag", "kmer"))


def parts(windows: DataFrame, lag: int) -> DataFrame:
    """(kind, len, grp, part, n) from windows (kmer, grp, nxt, n) of the longest lag: full, the words of 1 to lag + 1 letters; pre and suf, the starts and
    ends of 1 to lag letters. A word is the end of the window of its last letter, so all come from the one count."""
    w = windows.select("grp", "n", "nxt", F.regexp_replace("kmer", f"^\\{S.START}+", "").alias("body"))
    inner = w.filter(F.col("nxt") != S.STOP).select("grp", "n", F.concat("body", "nxt").alias("word"))
    sized = lambda rows, kind, size, part: rows.select(F.lit(kind).alias("kind"), size.alias("len"), "grp", part.alias("part"), "n")
    each = inner.withColumn("len", F.explode(F.sequence(F.lit(1), F.length("word"))))
    full = sized(each, "full", F.col("len"), F.right("word", F.col("len")))
    pre = sized(inner.filter(F.length("word") <= lag), "pre", F.length("word"), F.col("word"))
    ends = w.filter((F.col("nxt") == S.STOP) & (F.length("body") > 0)).withColumn("len", F.explode(F.sequence(F.lit(1), F.length("body"))))
    suf = sized(ends, "suf", F.col("len"), F.right("body", F.col("len")))
    return full.unionByName(pre).unionByName(suf).groupBy("kind", "len", "grp", "part").agg(F.sum("n").alias("n"))


def run(spark: SparkSession, manifest: str, prefix: str, lag: int, *, forward: bool = True, reverse: bool = False, file_gb: float = 0.1, all_parts: bool = False) -> None:
    reads = files.reads(spark, manifest)
    for name, both in ([(prefix, False)] if forward else []) + ([(prefix + "_rev", True)] if reverse else []):
        table = tables(reads, lag, both).cache()
        n_groups = (len(table.columns) - 2) // 5
        for x in range(1, lag + 1):
            own = table.filter(F.col("lag") == x).drop("lag")
            bins = files.bins_for(own.count() * (x + 2 + 8 * n_groups), 1, file_gb)
            files.write_dense(own, f"{name}_lag_{x}", n_groups, bins)
        table.unpersist()
        if all_parts:
            every = counting.count_windows(counting.both_strands(reads) if both else reads, lag)
            parts(every, lag).write.mode("overwrite").partitionBy("kind", "len").parquet(f"{name}_parts")


def main() -> None:
    p = argparse.ArgumentParser()
    p.add_argument("manifest")
    p.add_argument("prefix")
    p.add_argument("-l", type=int, default=10, help="longest lag")
    p.add_argument("-mf", type=float, default=0.1, help="GB to a file at most")
    p.add_argument("-nf", action="store_true", help="no forward tables")
    p.add_argument("-r", action="store_true", help="tables of both strands too")
    p.add_argument("-pr", action="store_true", help="words, prefixes and suffixes of all lengths too")
    a = p.parse_args()
    run(SparkSession.builder.getOrCreate(), a.manifest, a.prefix, a.l, forward=not a.nf, reverse=a.r, file_gb=a.mf, all_parts=a.pr)


if __name__ == "__main__":
    main()
