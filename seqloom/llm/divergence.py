"""Source divergence audit: how far the term distributions of a language's sources lie apart, and which terms set a source off.

A pair of sources is priced without the terms that neither has and without a dense row of terms for any: with p the price of a
term at its count and z that of a term that the source lacks,

    sum |p - q| = sum over g's terms |p - z_h| + sum over h's terms |z_g - q|        (one-sided, from histograms of counts)
                + sum over shared terms |p - q| - |p - z_h| - |z_g - q| + |z_g - z_h|  (a join of the postings)
                + (V - terms of g - terms of h) |z_g - z_h|                            (a constant)

A source's terms of one count share a price, so its histogram has few rows. Histograms meet the other sources by (language,
salt), so a language of many sources is many tasks; postings meet by (language, term), a row per source.

Words are counted in tasks, by language and source, and a task hands out a row per term, so that neither a hot source nor a
frequent term sends its occurrences anywhere. All prices are whole numbers, divided as decimals; sums are bigint.

Defined results: null text, lang and source are ''; every row is a document of its own, repeated ones too; a language without kept
terms has distances 0; a language's only source has no pair rows; equal values rank by the item's UTF-8 bytes; an empty table
gives an empty result; very long texts are cut between words as they are counted. Other columns are not read.
"""

from __future__ import annotations

from collections import Counter, defaultdict
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from seqloom.llm._common import stored, text_of

#: The least number of a language's documents for a term to be kept, the count added to each, the whole, and the ranks of `term` rows.
LEAST, ADDED, WHOLE, TOP = 30, 5, 1_000_000_000, 50
#: Tasks that a language's histogram rows are dealt to.
SALTS = 32
#: Groups that are looked up by broadcast, at some 100 bytes each; more are joined by key.
FEW = 200_000
#: Terms that a task holds, texts of a batch that it decodes at once, and bytes of a text whose words are counted at once.
HELD, TEXTS, SLICE = 200_000, 64, 1 << 20
_TERMS = bytes(c + 32 if 65 <= c <= 90 else c if c >= 128 or 97 <= c <= 122 else 32 for c in range(256))


def slices(text: bytes) -> Iterator[list[bytes]]:
    """The terms of a text, those of about SLICE bytes at a time."""
    clean = text.translate(_TERMS)
    at = 0
    while len(clean) - at > SLICE:
        end = clean.find(b" ", at + SLICE)
        if end < 0:
            break
        yield clean[at:end].split()
        at = end
    yield clean[at:].split()


def _counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(lang, source, term, n, d) of (lang, source, text as bytes): occurrences and texts of each term, partial sums."""
    counts, found = defaultdict(Counter), defaultdict(Counter)

    def flushed() -> pa.RecordBatch:
        cols = [[], [], [], [], []]
        for (lang, source), c in counts.items():
            docs = found[lang, source]
            cols[0] += [lang] * len(c)
            cols[1] += [source] * len(c)
            cols[2] += c.keys()
            cols[3] += c.values()
            cols[4] += map(docs.__getitem__, c)
        counts.clear()
        found.clear()
        kinds = [pa.string(), pa.string(), pa.binary(), pa.int64(), pa.int64()]
        arrays = [pa.array(c, t) for c, t in zip(cols, kinds, strict=True)]
        arrays[2] = arrays[2].cast(pa.string())
        return pa.RecordBatch.from_arrays(arrays, ["lang", "source", "term", "n", "d"])

    for b in batches:
        for at in range(0, b.num_rows, TEXTS):
            for row in zip(*(c.slice(at, TEXTS).to_pylist() for c in b.columns), strict=True):
                key, seen = row[:2], set()
                for terms in slices(row[2]):
                    counts[key].update(terms)
                    seen.update(terms)
                found[key].update(seen)
            if sum(map(len, counts.values())) > HELD:
                yield flushed()
    yield flushed()


def _price(n: Column | str, total: Column | str, v: Column | str) -> Column:
    """1 + floor(WHOLE (n + ADDED) / (total + ADDED v)), exactly."""
    n, total, v = (F.col(x) if isinstance(x, str) else x for x in (n, total, v))
    top = F.lit(WHOLE).cast("decimal(10,0)") * (n + ADDED).cast("decimal(19,0)")
    return (1 + F.call_function("div", top, (total + ADDED * v).cast("decimal(19,0)"))).cast("bigint")


def postings(docs: DataFrame, least: int = LEAST) -> DataFrame:
    """(lang, source, term, n, n_lang, leads) of the terms that `least` texts of their language have; leads: one row of each (lang, term).

    Partial counts are dealt once, by language and term; sums, the language's totals and the choice of terms need no further shuffle.
    """
    src = docs.select(*[F.coalesce(docs[c].cast("string"), F.lit("")).alias(c) for c in ("lang", "source")], text_of(docs).cast("binary").alias("text"))
    each = src.mapInArrow(_counts, "lang string, source string, term string, n bigint, d bigint")
    tasks = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    counts = each.repartition(tasks, "lang", "term").groupBy("lang", "source", "term").agg(F.sum("n").alias("n"), F.sum("d").alias("d"))
    whole = W.partitionBy("lang", "term")
    counts = counts.select("lang", "source", "term", "n", F.sum("d").over(whole).alias("d"), F.sum("n").over(whole).alias("n_lang"), (F.min("source").over(whole) == F.col("source")).alias("leads"))
    return counts.filter(F.col("d") >= least).drop("d")


def groups_of(docs: DataFrame, kept: DataFrame) -> DataFrame:
    """(lang, source, total, k, v, total_lang, z) of every (lang, source) that occurs: its occurrences and number of kept terms, those of the language, the price of a term it lacks."""
    names = docs.select(*[F.coalesce(docs[c].cast("string"), F.lit("")).alias(c) for c in ("lang", "source")]).distinct()
    own = kept.groupBy("lang", "source").agg(F.sum("n").alias("total"), F.count(F.lit(1)).alias("k"))
    langs = kept.groupBy("lang").agg(F.sum(F.col("leads").cast("bigint")).alias("v"), F.sum("n").alias("total_lang"))
    all_of = names.join(own, ["lang", "source"], "left").join(langs, "lang", "left").na.fill(0, ["total", "k", "v", "total_lang"])
    z = F.when(F.col("v") == 0, F.lit(0).cast("bigint")).otherwise(_price(F.lit(0).cast("bigint"), "total", F.greatest("v", F.lit(1))))
    return all_of.withColumn("z", z)


def top_terms(priced: DataFrame, top: int = TOP) -> DataFrame:
    """Of each group the terms whose price is most over their language's. Each task keeps its own top ranks before rows move."""
    over = priced.select("lang", "source", F.col("term").alias("item"), (F.col("p") - F.col("q")).alias("value")).filter("value > 0")
    place = F.row_number().over(W.partitionBy("lang", "source").orderBy(F.desc("value"), "item"))
    return over.withColumn("rank", place).filter(F.col("rank") <= top).select("lang", "source", F.lit("term").alias("part"), "item", "value", "rank")


def pair_distances(priced: DataFrame, groups: DataFrame) -> DataFrame:
    """(lang, a, b, value) of every two sources a < b of a language."""
    a, b = F.least("source", "other"), F.greatest("source", "other")
    bars = priced.groupBy("lang", "source", "p").agg(F.count(F.lit(1)).alias("m")).select("lang", "source", "p", "m", F.lit(0).cast("bigint").alias("v"))
    # what neither has: V from the side of the lesser name, less each side's own terms
    bars = bars.unionByName(groups.select("lang", "source", F.col("z").alias("p"), (-F.col("k")).alias("m"), "v"))
    salt = F.pmod(F.xxhash64("source", "p"), F.lit(SALTS))
    others = groups.select("lang", F.col("source").alias("other"), F.col("z").alias("zo"), F.explode(F.sequence(F.lit(0).cast("bigint"), F.lit(SALTS - 1).cast("bigint"))).alias("salt"))
    met = bars.withColumn("salt", salt).join(others, ["lang", "salt"]).filter("source != other")
    weight = F.col("m") + F.when(F.col("source") < F.col("other"), F.col("v")).otherwise(F.lit(0))
    one_sided = met.select("lang", a.alias("a"), b.alias("b"), (weight * F.abs(F.col("p") - F.col("zo"))).alias("value"))
    one_sided = one_sided.groupBy("lang", "a", "b").agg(F.sum("value").alias("value"))
    left = priced.select("lang", "term", F.col("source").alias("a"), F.col("p").alias("pa"), F.col("z").alias("za"))
    right = priced.select("lang", "term", F.col("source").alias("b"), F.col("p").alias("pb"), F.col("z").alias("zb"))
    both = left.join(right, ["lang", "term"]).filter("a < b")
    shared = both.groupBy("lang", "a", "b").agg(F.sum(F.expr("abs(pa - pb) - abs(pa - zb) - abs(za - pb) + abs(za - zb)")).alias("value"))
    return one_sided.unionByName(shared).groupBy("lang", "a", "b").agg(F.sum("value").alias("value"))


def pair_ranks(distances: DataFrame) -> DataFrame:
    sides = F.array(F.struct(F.col("a").alias("source"), F.col("b").alias("item")), F.struct(F.col("b").alias("source"), F.col("a").alias("item")))
    each = distances.select("lang", F.inline(sides), "value")
    place = F.row_number().over(W.partitionBy("lang", "source").orderBy(F.desc("value"), "item"))
    return each.select("lang", "source", F.lit("pair").alias("part"), "item", "value", place.alias("rank"))


def audit(docs: DataFrame, least: int = LEAST, top: int = TOP) -> DataFrame:
    """(lang, source, part, item, value, rank): `pair` rows for every other source of the language, `term` rows of the top ranks."""
    kept = stored(postings(docs, least), "postings")
    groups = stored(groups_of(docs, kept), "groups")
    known = F.broadcast(groups) if groups.count() <= FEW else groups
    rows = kept.join(known, ["lang", "source"])
    priced = stored(rows.select("lang", "source", "term", "z", _price("n", "total", "v").alias("p"), _price("n_lang", "total_lang", "v").alias("q")), "priced")
    return pair_ranks(pair_distances(priced, groups)).unionByName(top_terms(priced, top))
