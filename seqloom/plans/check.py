"""Are two count tables the same? By digests first, so that only what differs is joined.

python -m seqloom.plans.check MANIFEST PREFIX -l 10 [-r] [-nf]

Counts the manifest's sequences anew and compares every lag with the files that summarize wrote under the prefix. Prints what differs; the exit code is
1 if anything does.

A table's digest is a row for each of RANGES ranges of its contexts' md5: the number of rows and a sum of hashes over them, exact and the same in any order. Tables are
compared range by range; rows of ranges that agree never meet. Two different ranges have the same sums once in some 2^64 times.
"""

from __future__ import annotations

import argparse
import sys

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from seqloom.operators import cells, counting
from seqloom.plans import summarize
from seqloom.sources import files

RANGES = 4096


def range_of(kmer: Column) -> Column:
    return F.substring(F.md5(kmer), 1, 3)


def digests(table: DataFrame) -> DataFrame:
    """(range, n, digest) of a table in either form."""
    row = F.xxhash64("kmer", *[cells.counts(table, g) for g in cells.groups(table)])
    return table.select(range_of(F.col("kmer")).alias("range"), row.alias("h")).groupBy("range").agg(F.count(F.lit(1)).alias("n"), F.sum(F.col("h").cast("decimal(20,0)")).alias("digest"))


def ranges_that_differ(left: DataFrame, right: DataFrame) -> DataFrame:
    """(range): RANGES rows at most."""
    l, r = digests(left).alias("l"), digests(right).alias("r")
    both = l.join(r, F.col("l.range") == F.col("r.range"), "full")
    return both.filter(~(F.col("l.n").eqNullSafe(F.col("r.n")) & F.col("l.digest").eqNullSafe(F.col("r.digest")))).select(F.coalesce("l.range", "r.range").alias("range"))


def difference(left: DataFrame, right: DataFrame) -> DataFrame:
    """(kmer, side, off) of two tables in the wide form, as counting.difference, joining rows of ranges that differ alone."""
    ranges = F.broadcast(ranges_that_differ(left, right))
    of = lambda t: t.withColumn("range", range_of(F.col("kmer"))).join(ranges, "range", "left_semi").drop("range")
    return counting.difference(of(left), of(right))


def run(spark: SparkSession, manifest: str, prefix: str, lag: int, *, forward: bool = True, reverse: bool = False) -> list[tuple[str, str, str, int]]:
    """(table, kmer, side, off) of contexts that differ, the first twenty of each table."""
    reads, out = files.reads(spark, manifest), []
    for name, both in ([(prefix, False)] if forward else []) + ([(prefix + "_rev", True)] if reverse else []):
        every = summarize.tables(reads, lag, both).cache()
        n_groups = (len(every.columns) - 2) // 5
        for x in range(1, lag + 1):
            own = every.filter(F.col("lag") == x).drop("lag")
            off = difference(own, files.read_dense(spark, f"{name}_lag_{x}", n_groups)).orderBy("kmer").limit(20).collect()
            out += [(f"{name}_lag_{x}", r["kmer"], {"left": "lacking", "right": "not counted", "both": "counts differ"}[r["side"]], r["off"]) for r in off]
        every.unpersist()
    return out


def main() -> None:
    p = argparse.ArgumentParser()
    p.add_argument("manifest")
    p.add_argument("prefix")
    p.add_argument("-l", type=int, default=10, help="longest lag")
    p.add_argument("-nf", action="store_true", help="no forward tables")
    p.add_argument("-r", action="store_true", help="tables of both strands too")
    a = p.parse_args()
    off = run(SparkSession.builder.getOrCreate(), a.manifest, a.prefix, a.l, forward=not a.nf, reverse=a.r)
    for said in off:
        print(*said, sep="\t")
    print("the tables differ" if off else "the tables are what the sequences give")
    sys.exit(1 if off else 0)


if __name__ == "__main__":
    main()
