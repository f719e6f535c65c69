"""Mixing sources to target weights by Sainte-Lague apportionment of equal-token blocks.

1. Sizes: words per document. Sources in code-point order weigh 5, 2, 1, repeating, and share
   epochs x all words; a target stops at max_repeat x its source's words and the excess is shared
   again by weight (closed form: sources sorted by cap / weight, prefix sums).
2. A source's documents are dealt to shards by a hash of the id, the text and, of rows that repeat these, their number, so no group is larger
   than about SHARD_DOCS rows whatever a source holds. Each shard's words, in the order of a seeded digest, form
   blocks of `block` words.
3. Sainte-Lague gives every source its number of blocks, and again every shard its part of its source's:
   with a divisor d the highest quotients v / (k + 1/2) over d are round(v / d) each, so the quotas are those
   at d = block, and the few seats by which the sum then differs go by the next or last quotients.
4. A shard takes its quota: whole rounds first, then a run of blocks from a seeded start, cyclic. As the
   documents are in a seeded order, the run is a random set of documents of which at most three are cut.

Defined results: a null text is empty (size 0, taken 0); the null source is a source, after all others;
rows that repeat a doc_id, wholly or with another text or source, are rows of their own. Very long texts are counted and cut whole. Other columns
may have any name and keep their values. An empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from seqloom.llm._common import WHITE, WORD, hot_ties, picked, row_tie, stored, text_of

WEIGHTS = (5, 2, 1)
#: Aim at so many documents to a shard.
SHARD_DOCS = 1024
SALT = 64


def seeded(seed: int, *cols: Column) -> Column:
    """A non-negative 52-bit integer from the md5 of the columns; the same on any engine."""
    said = F.concat_ws("|", F.lit(str(seed)), *[F.coalesce(c.cast("string"), F.lit("~")) for c in cols])
    return F.conv(F.substring(F.md5(said), 1, 13), 16, 10).cast("bigint")


def sizes(docs: DataFrame) -> DataFrame:
    """(doc_id, source, size, tie, k): tie tells texts of one doc_id apart, k whole rows."""
    text = text_of(docs)
    return docs.select(
        docs["doc_id"].cast("bigint").alias("doc_id"), docs["source"].cast("string").alias("source"),
        F.regexp_count(text, F.lit(WORD)).cast("bigint").alias("size"), F.md5(text).alias("tie"), row_tie(docs).alias("k"),
    )


def numbered(rows: DataFrame) -> DataFrame:
    """rows with `copy`, the number from 0 of each among those of its doc_id, source and text. Rows alike in all are counted
    in each task first, so that many of them are one row until their numbers are dealt out."""
    alike = rows.groupBy("doc_id", "source", "size", "tie", "k").agg(F.count(F.lit(1)).alias("m"))
    before = F.sum("m").over(W.partitionBy("doc_id", "source", "tie").orderBy("k").rowsBetween(W.unboundedPreceding, -1))
    placed = alike.withColumn("before", F.coalesce(before, F.lit(0).cast("bigint")))
    return placed.select("doc_id", "source", "size", "tie", "k", F.explode(F.sequence("before", F.col("before") + F.col("m") - 1)).alias("copy"))


def targets(per_source: DataFrame, epochs: float, max_repeat: int) -> DataFrame:
    """Adds `target` to one row per source (source, source_size, ...).

    The windows are over this table alone, which has a row per source.
    """
    pick = F.element_at(F.array(*[F.lit(w) for w in WEIGHTS]), (F.col("rank") % len(WEIGHTS) + 1).cast("int"))
    ranked = per_source.withColumn("rank", F.row_number().over(W.orderBy(F.col("source").asc_nulls_last())) - 1).withColumn("weight", pick)
    cap = F.col("source_size") * max_repeat
    by_fill = W.orderBy(F.col("source_size") / F.col("weight"), "rank")
    ranked = (
        ranked.withColumn("cap_before", F.coalesce(F.sum(cap).over(by_fill.rowsBetween(W.unboundedPreceding, -1)), F.lit(0)))
        .withColumn("weight_left", F.sum("weight").over(by_fill.rowsBetween(W.currentRow, W.unboundedFollowing)))
        .withColumn("words", F.sum("source_size").over(W.partitionBy()))
        .withColumn("level", (F.lit(epochs) * F.col("words") - F.col("cap_before")) / F.col("weight_left"))
        .withColumn("free", F.col("level") * F.col("weight") <= cap)
    )
    level = F.min(F.when(F.col("free"), F.struct("cap_before", "level"))).over(W.partitionBy())["level"]
    ranked = ranked.withColumn("final", level)
    capped = F.col("final").isNull() | (F.col("final") * F.col("weight") > cap)
    return ranked.select(
        *per_source.columns, "rank", F.when(capped, cap.cast("double")).otherwise(F.col("final") * F.col("weight")).alias("target")
    )


def apportioned(df: DataFrame, value: str, house: Column, divisor: Column, keys: list[str], order: list[str], out: str) -> DataFrame:
    """Adds `out`: Sainte-Lague seats for `value` within each group of `keys`, `house` seats in all.

    At `divisor` every row has round(value / divisor) seats; the difference to the house is at most half the
    number of rows, and is made up by the highest next quotients, or the lowest last ones.
    """
    group = W.partitionBy(*keys)
    base = F.floor(F.col(value) / divisor + 0.5).cast("bigint")
    df = df.withColumn("_base", base).withColumn("_need", (house - F.sum("_base").over(group)).cast("bigint"))
    up = F.row_number().over(group.orderBy((F.col(value) / (F.col("_base") + 0.5)).desc(), *order))
    down = F.row_number().over(group.orderBy(F.when(F.col("_base") > 0, F.col(value) / (F.col("_base") - 0.5)).asc_nulls_last(), *order))
    step = (up <= F.col("_need")).cast("bigint") - ((down <= -F.col("_need")) & (F.col("_base") > 0)).cast("bigint")
    return df.withColumn(out, F.col("_base") + step).drop("_base", "_need")


def plan(docs: DataFrame, *, seed: int = 0, block: int = 64, epochs: float = 1.5, max_repeat: int = 2) -> DataFrame:
    """For every row: doc_id, tie, k, source, size, source_size, target, and what the mix takes of it:
    `rounds` whole copies and the words [cut1_from, cut1_to) and [cut2_from, cut2_to); `taken` is their sum."""
    rows = stored(numbered(sizes(docs)), "sizes")
    per_source = rows.groupBy("source").agg(F.sum("size").alias("source_size"), F.count(F.lit(1)).alias("source_docs"))
    per_source = targets(per_source, epochs, max_repeat).withColumn("n_shards", F.ceil(F.col("source_docs") / SHARD_DOCS))
    house = F.floor(min(epochs, max_repeat) * F.sum("source_size").over(W.partitionBy()) / block + 0.5)
    per_source = stored(apportioned(per_source, "target", house, F.lit(block), [], ["rank"], "seats"), "sources")

    # Spark broadcasts the sources if their table is small, and else shuffles and splits hot ones
    keyed = per_source.select(F.col("source").alias("_source"), "rank", "source_size", "target", "seats", "n_shards")
    dealt = rows.join(keyed, rows["source"].eqNullSafe(keyed["_source"])).drop("_source")
    own = (F.col("doc_id"), F.col("tie"), F.col("copy"))
    dealt = dealt.withColumn("shard", F.pmod(seeded(seed, F.lit("shard"), *own), F.col("n_shards")))
    by_order = W.partitionBy("rank", "shard").orderBy(seeded(seed, F.lit("order"), *own), "doc_id", "tie", "copy", "k")
    dealt = dealt.withColumn("_end", F.sum("size").over(by_order.rowsBetween(W.unboundedPreceding, W.currentRow)))

    shards = rows.join(keyed, rows["source"].eqNullSafe(keyed["_source"])).withColumn(
        "shard", F.pmod(seeded(seed, F.lit("shard"), *own), F.col("n_shards"))
    )
    shards = shards.groupBy("rank", "shard", "seats", "source_size", "target").agg(F.sum("size").alias("shard_size"))
    part = F.col("target") * F.col("shard_size") / F.greatest(F.col("source_size"), F.lit(1))
    shards = apportioned(shards.withColumn("part", part), "part", F.col("seats"), F.lit(block), ["rank"], ["shard"], "quota")
    n_blocks = F.greatest(F.ceil(F.col("shard_size") / block), F.lit(1))
    # a last block may be short, so a quota can pass the cap by a seat; it then stops there
    quota = F.greatest(F.least(F.col("quota"), n_blocks * max_repeat), F.lit(0))
    shards = shards.select(
        "rank", "shard", F.floor(quota / n_blocks).alias("rounds"), (F.pmod(quota, n_blocks) * block).alias("run"),
        (F.pmod(seeded(seed, F.lit("start"), F.col("rank"), F.col("shard")), n_blocks) * block).alias("run_from"), (n_blocks * block).alias("ring"),
    )
    out = dealt.join(shards, ["rank", "shard"])

    start = F.col("_end") - F.col("size")
    run_to = F.col("run_from") + F.col("run")

    def overlap(lo: Column, hi: Column) -> tuple[Column, Column]:
        first = F.greatest(lo, start) - start
        return first, F.greatest(F.least(hi, F.col("_end")) - start, first)

    (a, b), (c, d) = overlap(F.col("run_from"), F.least(run_to, F.col("ring"))), overlap(F.lit(0).cast("bigint"), run_to - F.col("ring"))
    out = out.withColumn("cut1_from", a).withColumn("cut1_to", b).withColumn("cut2_from", c).withColumn("cut2_to", d)
    taken = F.col("rounds") * F.col("size") + F.col("cut1_to") - F.col("cut1_from") + F.col("cut2_to") - F.col("cut2_from")
    return out.select(
        "doc_id", "tie", "k", "source", "size", "source_size", "target", "rounds", "cut1_from", "cut1_to", "cut2_from", "cut2_to", taken.cast("bigint").alias("taken")
    )


def mixed(docs: DataFrame, **params) -> DataFrame:
    """The mix itself: docs with the columns as they were, a row for each whole copy and one for the words of a cut.

    Documents of which the mix takes nothing go. A cut document's text holds the words taken, joined by
    spaces, unless all of them are taken at once, which leaves the text as it is.
    """
    cut = F.col("cut1_to") - F.col("cut1_from") + F.col("cut2_to") - F.col("cut2_from")
    rows = plan(docs, **params).filter("taken > 0")
    chosen = stored(rows.select("k", "rounds", "size", "cut1_from", "cut1_to", "cut2_from", "cut2_to", cut.alias("cut")), "chosen")
    hot = hot_ties(chosen.select("k"), chosen.count())
    # rows alike in all columns share the key: the plan has a row for each, the documents one for all
    used = picked(docs, chosen.select("k"), hot)
    if not hot.isEmpty():  # their texts go to SALT places each, and the plan's rows are dealt to these
        used = used.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALT - 1))))
        chosen = chosen.withColumn("salt", F.monotonically_increasing_id() % SALT)
    used = used.join(chosen, [c for c in ("k", "salt") if c in used.columns])
    words = F.split(F.regexp_replace(F.col("row.text"), f"^{WHITE}+", ""), WHITE + "+")
    piece = lambda n: F.slice(words, (F.col(f"cut{n}_from") + 1).cast("int"), (F.col(f"cut{n}_to") - F.col(f"cut{n}_from")).cast("int"))
    cut_text = F.when(F.col("cut") == F.col("size"), F.col("row.text")).otherwise(F.array_join(F.concat(piece(1), piece(2)), " "))
    copies = F.array_repeat(F.col("row.text"), F.col("rounds").cast("int"))
    texts = F.concat(copies, F.when(F.col("cut") > 0, F.array(cut_text)).otherwise(F.array().cast("array<string>")))
    return used.select("row", F.explode(texts).alias("out")).select(
        *[(F.col("out") if c == "text" else F.col("row")[c]).alias(c) for c in docs.columns]
    )
