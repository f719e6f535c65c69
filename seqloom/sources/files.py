"""Sequence files and count files.

FASTA and FASTQ are framed by Spark's text reader, so they may lie in any store that Spark reads, and large files are read in
splits: FASTA at lines that start with '>'; FASTQ, whose quality lines may start with '@', by the lines' numbers in their file.
"""

from __future__ import annotations

import configparser
import json
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from seqloom.operators import cells, counting
from seqloom.sources.shared import kept


def manifest(spark: SparkSession, path: str) -> DataFrame:
    """(path, grp, type) from a CSV file without a header."""
    return spark.read.csv(path, schema="path string, grp int, type string", ignoreLeadingWhiteSpace=True, ignoreTrailingWhiteSpace=True)


def fasta(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """(file, name, seq); a record's lines are joined."""
    text = spark.read.text(path, lineSep="\n>").select(F.input_file_name().alias("file"), F.regexp_replace("value", "^>", "").alias("value")).filter("trim(value) != ''")
    body = F.regexp_replace(F.substring(F.col("value"), F.length(F.substring_index("value", "\n", 1)) + 1, F.length("value")), r"\s", "")
    return text.select("file", F.trim(F.substring_index("value", "\n", 1), F.lit("\r")).alias("name"), body.alias("seq"))


def fastq(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """(file, name, seq). A record is four lines. Lines are counted per split of a file, the splits' counts added up, and names
    and sequences meet by the number of their record; quality lines never move."""
    src = spark.read.text(path)
    lines = src.select(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("split"), F.regexp_replace("value", "\r$", "").alias("value"))

    def numbered_in_split(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, n = None, 0
        for b in batches:
            at = np.zeros(b.num_rows, np.int64)
            files, splits = b.column(0).to_pylist(), b.column(1).to_pylist()
            for k, key in enumerate(zip(files, splits, strict=True)):
                held, n = (held, n + 1) if key == held else (key, 0)
                at[k] = n
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(at)], ["file", "split", "value", "at"])

    counts = lines.groupBy("file", "split").agg(F.count(F.lit(1)).alias("n"))
    before = F.sum("n").over(W.partitionBy("file").orderBy("split").rowsBetween(W.unboundedPreceding, -1))
    offsets = counts.select("file", "split", F.coalesce(before, F.lit(0)).alias("before"))
    each = lines.mapInArrow(numbered_in_split, "file string, split bigint, value string, at bigint").join(offsets, ["file", "split"])
    each = each.select("file", "value", (F.col("at") + F.col("before")).alias("line")).filter("line % 4 < 2")
    record = each.groupBy("file", F.floor(F.col("line") / 4).alias("k")).agg(F.max(F.when(F.col("line") % 4 == 0, F.col("value"))).alias("name"), F.max(F.when(F.col("line") % 4 == 1, F.col("value"))).alias("seq"))
    return record.filter("seq is not null").select("file", F.regexp_replace("name", "^@", "").alias("name"), "seq")


def reads(spark: SparkSession, manifest_path: str) -> DataFrame:
    """(grp, name, seq) of all files of a manifest."""
    listed = [tuple(r) for r in manifest(spark, manifest_path).collect()]
    out = None
    for grp, kind in sorted({(g, t) for _, g, t in listed}):
        files = [p for p, g, t in listed if (g, t) == (grp, kind)]
        part = {"fa": fasta, "fq": fastq}[kind](spark, files).select(F.lit(grp).alias("grp"), "name", "seq")
        out = part if out is None else out.unionByName(part)
    return out


def read_cells(spark: SparkSession, path: str, n_groups: int, alphabet: str = "dna", sparse: bool = False) -> DataFrame:
    """(kmer, g0, g1, ...) with an array of cells per group, of dense or sparse count files. Files of another alphabet or number of groups raise."""
    if sparse:
        src = spark.read.csv(path, sep=";", header=True, quote="", ignoreLeadingWhiteSpace=True, schema="kmer string, count_mat_indices string, count_mat_values string")
        return cells.unpacked_sparse(src, n_groups, alphabet)
    return cells.unpacked(spark.read.csv(path, sep="\t", quote="", schema="kmer string, counts string"), n_groups, alphabet)


def read_dense(spark: SparkSession, path: str, n_groups: int, alphabet: str = "dna") -> DataFrame:
    """The wide form of tab-separated (kmer, JSON matrix) files, raising where a matrix is not of the alphabet's width."""
    return _wide(read_cells(spark, path, n_groups, alphabet), n_groups, alphabet)


def read_sparse(spark: SparkSession, path: str, n_groups: int, alphabet: str = "dna") -> DataFrame:
    """The wide form of ';'-separated files with places and values, raising where a place is outside the alphabet's width."""
    return _wide(read_cells(spark, path, n_groups, alphabet, sparse=True), n_groups, alphabet)


def _wide(table: DataFrame, n_groups: int, alphabet: str) -> DataFrame:
    return table.select("kmer", *[F.col(f"g{g}")[i].alias(f"g{g}_{i}") for g in range(n_groups) for i in range(cells.width(alphabet))])


def discovered(folder: str, start: str = "") -> str:
    """The path of all files in a folder whose names start so, for any of the readers."""
    return f"{folder.rstrip('/')}/{start}*"


def read_dump(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """(kmer, n) of a k-mer counter's tab-separated dump."""
    return spark.read.csv(path, sep="\t", quote="", schema="kmer string, n bigint")


def dump_transitions(dump: DataFrame, group: int = 0) -> DataFrame:
    """(kmer, grp, nxt, n) from counted words: the last letter follows the others. Words with other letters are left out."""
    long = dump.select(F.expr("left(kmer, length(kmer) - 1)").alias("kmer"), F.lit(group).alias("grp"), F.right("kmer", F.lit(1)).alias("nxt"), "n")
    return counting.of_alphabet(long)


def load_table(spark: SparkSession, path: str) -> DataFrame:
    """A wide count table kept as Parquet; a path without one raises Spark's AnalysisException."""
    table = spark.read.parquet(path)
    if "kmer" not in table.columns:
        raise ValueError(f"{path} is no count table: it has no column kmer")
    return table


def write_dense(table: DataFrame, path: str, n_groups: int, bins: int = 1) -> None:
    """Tab-separated files of a table in either form, rows dealt to them by the md5 of the context, as shuffled as by chance but the same in every run."""
    by = F.pmod(F.conv(F.substring(F.md5("kmer"), 1, 8), 16, 10).cast("bigint"), F.lit(bins))
    every = cells.packed(table.select("kmer", *[cells.counts(table, g).alias(f"g{g}") for g in range(n_groups)]))
    every.repartition(bins, by).write.mode("overwrite").csv(path, sep="\t", quote="", escape="")


def write_fasta(seqs: DataFrame, path: str) -> None:
    """(seed_id, rep, seq) as records >seq{seed}_rep{rep}."""
    seqs.select(F.concat(F.lit(">seq"), "seed_id", F.lit("_rep"), "rep", F.lit("\n"), "seq").alias("value")).write.mode("overwrite").text(path)


def write_fastq(seqs: DataFrame, path: str) -> None:
    """(name, seq) as records of four lines, the quality the best there is."""
    seqs.select(F.concat(F.lit("@"), "name", F.lit("\n"), "seq", F.lit("\n+\n"), F.repeat(F.lit("I"), F.length("seq"))).alias("value")).write.mode("overwrite").text(path)


def bins_for(total_bytes: int, n_groups: int, file_gb: float) -> int:
    """How many files a count table is dealt to: a power of two that keeps each under file_gb."""
    bins = 1
    while total_bytes * n_groups > bins * file_gb * 1e9:
        bins *= 2
    return bins


def config(path: str) -> dict[str, dict[str, object]]:
    """An INI file; values that are JSON (numbers, lists, objects) are decoded, True and False too, others are strings."""
    found = configparser.ConfigParser()
    with open(path) as file:  # the driver's own file
        found.read_file(file)

    def value(said: str) -> object:
        try:
            return {"True": True, "False": False}[said] if said in ("True", "False") else json.loads(said)
        except ValueError:
            return said

    return {s: {k: value(v) for k, v in found[s].items()} for s in found.sections()}


def numbered(df: DataFrame, size: int, by: str = "kmer") -> DataFrame:
    """Adds `batch`: rows in the order of the md5 of their key, `size` to a batch.

    Rows are ranked within 4096 ranges of the md5 and the ranges' counts added up, so no task ranks all of them. They are written first, as they are read twice.
    """
    d = kept(df, "rows").withColumn("_m", F.md5(F.col(by))).withColumn("_r", F.substring("_m", 1, 3))
    before = d.groupBy("_r").agg(F.count(F.lit(1)).alias("_n")).withColumn("_before", F.sum("_n").over(W.orderBy("_r")) - F.col("_n"))
    ranked = d.withColumn("_k", F.row_number().over(W.partitionBy("_r").orderBy("_m", by)) - 1).join(F.broadcast(before), "_r")
    return ranked.withColumn("batch", F.floor((F.col("_k") + F.col("_before")) / size).cast("bigint")).drop("_m", "_r", "_n", "_before", "_k")
