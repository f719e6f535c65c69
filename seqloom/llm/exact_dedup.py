"""Exact dedup against a persistent digest index.

The index lies in a folder of its own, known by its path, and outlives the session. It has a table bucketed and sorted
by digest with a row for every digest ever added. A batch of documents is reduced to one row per digest (map-side first,
so that a group of copies of any size shuffles as a row per task); those that the index has are taken out by a
sort-merge anti-join, and the others are appended. What a batch brings of known digests goes to a second such table, so the
row that stays can still be told over all batches. Only digests, ids and lengths move, never texts.

``resolve`` and ``without_copies`` bring their rows to the index in BATCHES batches, dealt by a hash of the id. Without an
index of the caller's they use a new one and delete it afterwards.

Defined results: a null text counts as empty. Of equal texts the row with the most code points in
the original stays, then the smallest doc_id, a null doc_id after all others, then the least digest of the whole row. Rows that repeat
a doc_id and text all carry the same result; ``without_copies`` keeps one of them. An empty table
gives an empty result. Texts may have any length that a row may have. Columns besides doc_id and text may have any name and type.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from seqloom.llm._common import WHITE, drop_scratch, forget, hot_lookup, hot_ties, picked, row_tie, scratch_path, stored, text_of

BATCHES = 2


def digests(docs: DataFrame) -> DataFrame:
    """(doc_id, digest, n_chars, tie): SHA-256 of the text without white space, the code points of the original, a digest of the row."""
    text = text_of(docs)
    return docs.select(
        docs["doc_id"].cast("bigint").alias("doc_id"),
        F.unhex(F.sha2(F.regexp_replace(text, WHITE + "+", ""), 256)).alias("digest"),
        F.length(text).cast("bigint").alias("n_chars"),
        row_tie(docs).alias("tie"),
    )


class DigestIndex:
    """Two bucketed tables in a folder: `first` has a row per digest, from the batch that brought it; `again` a row per digest and later batch.

    Columns: digest, keep_id, keep_chars, keep_tie (of the row that stays of the batch), group_size (rows of the batch), batch.
    """

    SCHEMA = "digest binary, keep_id bigint, keep_chars bigint, keep_tie string, group_size bigint, batch string"

    def __init__(self, spark: SparkSession, path: str, buckets: int):
        self.spark, self.path, self.buckets = spark, path, buckets
        name = "digests_" + hashlib.md5(path.encode()).hexdigest()
        self.tables = {part: f"{name}_{part}" for part in ("first", "again")}
        for part, table in self.tables.items():
            spark.sql(f"CREATE TABLE IF NOT EXISTS {table} ({self.SCHEMA}) USING parquet CLUSTERED BY (digest) SORTED BY (digest) INTO {buckets} BUCKETS LOCATION '{path}/{part}'")

    @classmethod
    def open(cls, spark: SparkSession, path: str, n_rows: int = 0) -> DigestIndex:
        """The index in that folder; if there is none, a new one for about n_rows digests. The number of buckets holds for its lifetime."""
        try:
            buckets = spark.read.parquet(f"{path}/buckets").first()[0]
        except AnalysisException:
            # some 500,000 digests to a bucket, and no fewer buckets than tasks of a shuffle, or joins would shuffle the index too
            buckets = max(2 ** min(13, max(0, math.ceil(math.log2(max(1, n_rows) / 500_000)))), int(spark.conf.get("spark.sql.shuffle.partitions")))
            spark.createDataFrame([(buckets,)], "buckets int").coalesce(1).write.parquet(f"{path}/buckets")
        return cls(spark, path, buckets)

    def close(self) -> None:
        """Take the tables out of the session's catalog; the files stay."""
        for table in self.tables.values():
            self.spark.sql(f"DROP TABLE IF EXISTS {table}")

    def part(self, name: str) -> DataFrame:
        return self.spark.table(self.tables[name])

    def _append(self, rows: DataFrame, name: str) -> None:
        (
            rows.repartition(self.buckets, "digest").write.mode("append").format("parquet")
            .bucketBy(self.buckets, "digest").sortBy("digest").option("path", f"{self.path}/{name}").saveAsTable(self.tables[name])
        )

    def add(self, groups: DataFrame, batch: str) -> None:
        """Append the groups (see grouped) of a batch. Adding a batch twice, or again after a failure, changes nothing."""
        cols = ["digest", "keep_id", "keep_chars", "keep_tie", "group_size"]
        groups = groups.select(*cols, F.lit(batch).alias("batch"))
        known = self.part("first").hint("merge").select("digest", F.col("batch").alias("_of"))
        mine = self.part("again").filter(F.col("batch") == batch).hint("merge").select("digest")
        later = groups.join(known.filter(F.col("_of") != batch).select("digest"), "digest", "left_semi").join(mine, "digest", "left_anti")
        self._append(later, "again")
        self._append(groups.join(known.select("digest"), "digest", "left_anti"), "first")

    def groups(self) -> DataFrame:
        """(digest, keep_id, keep_tie, group_size) over all batches. Both tables are bucketed by digest, so this moves nothing."""
        return best_of(self.part("first").unionByName(self.part("again")))


def best_of(groups: DataFrame) -> DataFrame:
    """(digest, keep_id, keep_tie, group_size) of rows of the index: the best of each digest's."""
    best = F.min(F.struct(-F.col("keep_chars"), F.col("keep_id").isNull(), F.col("keep_id"), F.col("keep_tie")))
    return groups.groupBy("digest").agg(best.alias("best"), F.sum("group_size").alias("group_size")).select("digest", F.col("best.keep_id").alias("keep_id"), F.col("best.keep_tie").alias("keep_tie"), "group_size")


def grouped(rows: DataFrame) -> DataFrame:
    """One row per digest: the id, length and digest of the row that stays, and the number of rows."""
    best = F.min(F.struct(-F.col("n_chars"), F.col("doc_id").isNull(), F.col("doc_id"), F.col("tie")))
    return rows.groupBy("digest").agg(best.alias("best"), F.count(F.lit(1)).alias("group_size")).select(
        "digest", F.col("best.doc_id").alias("keep_id"), (-F.col("best.col1")).alias("keep_chars"), F.col("best.tie").alias("keep_tie"), "group_size"
    )


def batch_name(rows: DataFrame) -> str:
    """A name for rows (see digests) that the same rows have in any order and run: a sum over them, exact whatever the order."""
    each = F.xxhash64("doc_id", "digest", "tie")
    r = rows.agg(F.count(F.lit(1)).alias("n"), F.sum(each.cast("decimal(20,0)")).alias("a"), F.sum(F.xxhash64(each, F.lit(1)).cast("decimal(20,0)")).alias("b")).first()
    return hashlib.md5(f"{r['n']}|{r['a']}|{r['b']}".encode()).hexdigest()


def _brought(rows: DataFrame, index: DigestIndex, batches: int, name: str | None) -> list[str]:
    """Bring rows to the index; the names of the batches, which a rerun on the same rows, or under the same name, has again."""
    name = name or batch_name(rows)
    names = [f"{name}-{k}-of-{batches}" for k in range(batches)]
    for k, part in enumerate(names):
        index.add(grouped(rows.filter(F.pmod(F.xxhash64("doc_id"), F.lit(batches)) == k)), part)
    return names


@contextmanager
def _opened(spark: SparkSession, index: DigestIndex | None, n_rows: int) -> Iterator[DigestIndex]:
    """The caller's index, or a new one whose files and tables go at the end, failed or not."""
    if index is not None:
        yield index
        return
    path = scratch_path(spark, "index")
    own = DigestIndex.open(spark, path, n_rows)
    try:
        yield own
    finally:
        own.close()
        drop_scratch(path)


def resolve(docs: DataFrame, index: DigestIndex | None = None, batches: int = BATCHES, name: str | None = None) -> DataFrame:
    """(doc_id, keep_id, group_size, kept, text_sha256) for every row of docs, adding its digests to the index.

    With an index that has other batches, keep_id and group_size are over those too. name: of what is brought; the same rows, or another try
    under the same name, count once. Rows that come again on purpose need a name of their own.
    """
    spark = docs.sparkSession
    rows = stored(digests(docs), "digests")
    total = rows.count()
    with _opened(spark, index, total) as own:
        _brought(rows, own, batches, name)
        # hot keys are told by the rows of docs alone, whatever else the index holds
        mine = rows.groupBy("digest").agg(F.count(F.lit(1)).alias("n"))
        table = stored(mine.join(own.groups().hint("merge"), "digest"), "resolved")
    found = hot_lookup(rows, table, "digest", "n", total)
    return found.select("doc_id", "keep_id", "group_size", F.col("doc_id").eqNullSafe(F.col("keep_id")).alias("kept"), F.lower(F.hex("digest")).alias("text_sha256"))


def without_copies(docs: DataFrame, index: DigestIndex | None = None, batches: int = BATCHES, name: str | None = None) -> DataFrame:
    """docs with one row of each group of equal texts that no other batch of the index brought before, all columns as they were.

    What this batch brought counts by its name, whichever try brought it, so a rerun after a failure, or after the end, gives the same rows.
    The rows to keep are found from digests alone; then docs is joined with them on the digest of the whole row, a
    key that only true repeats of a row share, so that a large group of copies spreads evenly.
    """
    spark = docs.sparkSession
    rows = stored(digests(docs), "digests")
    total = rows.count()
    with _opened(spark, index, total) as own:
        names = _brought(rows, own, batches, name)
        new = own.part("first").filter(F.col("batch").isin(names)).select("digest")
        # of the rows of this batch alone: the best over all batches may be a row that docs doesn't have
        mine = own.part("first").unionByName(own.part("again")).filter(F.col("batch").isin(names))
        keep = stored(best_of(mine).join(new.hint("merge"), "digest", "left_semi").select(F.col("keep_tie").alias("k")), "keep")
    hot = hot_ties(rows.select(F.col("tie").alias("k")), total)
    forget(rows)
    return picked(docs, keep, hot).select("row.*")
