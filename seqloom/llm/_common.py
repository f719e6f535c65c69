"""Helpers that the corpus operators share: scratch tables, null handling, lookups that survive hot keys."""

from __future__ import annotations

import atexit
import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: A key is hot if it holds over one in HOT_SHARE rows; so fewer than HOT_SHARE keys can be hot.
HOT_SHARE = 512
WHITE = r"[\x20\x09-\x0D]"
WORD = r"[^\x20\x09-\x0D]+"

_made: dict[str, SparkSession] = {}


def shared_dir(spark: SparkSession) -> str:
    """The folder that all executors share: spark.checkpoint.dir; where it is unset, the warehouse, or a local folder in local mode."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if found:
        return found.rstrip("/")
    if spark.sparkContext.master.startswith("local[") or spark.sparkContext.master == "local":
        return f"file://{tempfile.gettempdir()}/seqloom-shared"
    return spark.conf.get("spark.sql.warehouse.dir").rstrip("/") + "/_seqloom"


def scratch_path(spark: SparkSession, name: str) -> str:
    """A new path in the shared folder. It lasts until drop_scratch() or the end of the driver's process."""
    if not _made:
        atexit.register(drop_scratch)
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    _made[path] = spark
    return path


def drop_scratch(*paths: str) -> None:
    """Delete scratch folders: those given, or all that this process made."""
    for path in paths or list(_made):
        spark = _made.pop(path, None)
        try:
            jvm = spark.sparkContext._jvm
            where = jvm.org.apache.hadoop.fs.Path(path)
            where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(where, True)
        except Exception:  # noqa: BLE001  the session may be gone at exit; the folder is then left to its owner
            continue


def stored(df: DataFrame, name: str) -> DataFrame:
    """Write df as Parquet in the shared folder and read it back: cuts the lineage, outlives executors, gives Spark the size."""
    path = scratch_path(df.sparkSession, name)
    df.write.parquet(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out._scratch = path
    return out


def forget(*frames: DataFrame) -> None:
    """Delete what stored() wrote for frames that nothing reads any more."""
    drop_scratch(*[f._scratch for f in frames])


def column(df: DataFrame, name: str) -> Column:
    """A column by its whole name, whatever characters it has."""
    return df["`" + name.replace("`", "``") + "`"]


def whole_row(docs: DataFrame) -> Column:
    return F.struct(*[column(docs, c) for c in docs.columns])


def text_of(df: DataFrame) -> Column:
    """The text as a string, '' for null."""
    return F.coalesce(df["text"].cast("string"), F.lit(""))


def row_tie(docs: DataFrame) -> Column:
    """A digest of the whole row: only rows that agree in every column share it."""
    rest = F.to_json(F.struct(*[column(docs, c) for c in docs.columns if c != "text"]))
    return F.md5(F.concat(F.md5(text_of(docs)), docs["text"].isNull().cast("string"), rest))


def hot_ties(ties: DataFrame, total: int) -> DataFrame:
    """(k) of the keys in ties (k, a row per row) that are hot; fewer than HOT_SHARE rows."""
    return stored(ties.groupBy("k").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") * HOT_SHARE > F.lit(total)).select("k"), "hot")


def picked(docs: DataFrame, keep: DataFrame, hot: DataFrame) -> DataFrame:
    """(row, k): one row of docs for each row_tie k in keep (k); hot: those that many rows share, from hot_ties.

    Texts move once. Rows that share a hot key are brought down to one in each task before they move.
    """
    packed = docs.select(whole_row(docs).alias("row"), row_tie(docs).alias("k"))
    if hot.isEmpty():
        return packed.join(keep, "k", "left_semi").dropDuplicates(["k"])
    cold = packed.join(F.broadcast(hot), "k", "left_anti").join(keep, "k", "left_semi").dropDuplicates(["k"])
    few = packed.join(F.broadcast(hot.join(keep, "k", "left_semi")), "k", "left_semi").dropDuplicates(["k"])
    return cold.unionByName(few)


def hot_lookup(rows: DataFrame, table: DataFrame, key: str, weight: str, total: int) -> DataFrame:
    """Inner join of rows with table, which has one row per key; weight: how many of the rows, `total` in all, hold that key.

    Hot keys are fewer than HOT_SHARE, so their part of table is broadcast and their rows never
    meet in one task; the others are joined by key, no key with over total / HOT_SHARE rows.
    """
    is_hot = F.col(weight) * HOT_SHARE > F.lit(total)
    hot = F.broadcast(table.filter(is_hot))
    left = rows.join(F.broadcast(table.filter(is_hot).select(key)), key, "left_anti").join(table.filter(~is_hot), key)
    return left.unionByName(rows.join(hot, key))
