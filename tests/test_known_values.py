"""Counts and scores whose values are known, on four short sequences."""

import pytest
from pyspark.sql import functions as F

from seqloom.operators import counting, scoring
from seqloom.plans import summarize

SEQS = ["TTTAT", "TTCTT", "TTTTT", "TTTTT"]
# fixed values: context -> counts of A, C, G, T, stop
COUNTS = {
    1: {"[": (0, 0, 0, 4, 0), "A": (0, 0, 0, 1, 0), "C": (0, 0, 0, 1, 0), "T": (1, 1, 0, 12, 4)},
    2: {"[[": (0, 0, 0, 4, 0), "[T": (0, 0, 0, 4, 0), "AT": (0, 0, 0, 0, 1), "CT": (0, 0, 0, 1, 0), "TA": (0, 0, 0, 1, 0), "TC": (0, 0, 0, 1, 0), "TT": (1, 1, 0, 7, 3)},
    3: {
        "[[[": (0, 0, 0, 4, 0), "[[T": (0, 0, 0, 4, 0), "[TT": (0, 1, 0, 3, 0), "CTT": (0, 0, 0, 0, 1), "TAT": (0, 0, 0, 0, 1),
        "TCT": (0, 0, 0, 1, 0), "TTA": (0, 0, 0, 1, 0), "TTC": (0, 0, 0, 1, 0), "TTT": (1, 0, 0, 4, 2),
    },
}


@pytest.fixture(scope="module")
def reads(spark):
    return spark.createDataFrame([(k, 0, s) for k, s in enumerate(SEQS)], "seq_id int, grp int, seq string")


def by_context(table):
    return {r["kmer"]: tuple(r[f"g0_{i}"] for i in range(5)) for r in table.collect()}


def test_counts_at_each_lag(reads):
    table = summarize.tables(reads, 3)
    for lag, wanted in COUNTS.items():
        assert by_context(table.filter(f"lag = {lag}")) == wanted
        assert by_context(counting.wide(counting.count_long(reads, lag), 1)) == wanted


def test_lookups(spark, reads):
    forward = counting.wide(counting.count_long(reads, 3), 1)
    both = counting.wide(counting.count_long(counting.both_strands(reads), 3), 1)
    asked = lambda *k: spark.createDataFrame([(x,) for x in k], "kmer string")
    assert by_context(counting.lookup(asked("TTT", "TTA", "[[T", "GGG"), forward)) == {"TTT": (1, 0, 0, 4, 2), "TTA": (0, 0, 0, 1, 0), "[[T": (0, 0, 0, 4, 0), "GGG": (0,) * 5}
    assert by_context(counting.lookup(asked("TTT", "[AT", "AAA"), both)) == {"TTT": (1, 0, 0, 4, 2), "[AT": (1, 0, 0, 0, 0), "AAA": (4, 0, 0, 0, 3)}


def test_variant_scores(spark, reads):
    table = counting.wide(counting.count_long(reads, 3), 1)
    variants = spark.createDataFrame([("A3T", "TTTAT"), ("T2C", "TTTAT")], "var_id string, seq string").withColumn("v", scoring.parsed(F.col("var_id"))).select("var_id", "seq", "v.*")
    found = {(r["var_id"], r["alpha"]): r["score"] for r in scoring.variant_scores(variants, table, 3, 0, [0.1]).collect()}
    assert found == {("A3T", 0.1): pytest.approx(0.0591049, abs=1e-6), ("T2C", 0.1): pytest.approx(-4.4231153, abs=1e-6)}


def test_unknown_letters_end_with_the_window(spark):
    """Windows with an unknown letter go, at each lag its own."""
    odd = spark.createDataFrame([(0, "AANCC")], "grp int, seq string")
    found = by_context(summarize.tables(odd, 2).filter("lag = 1"))
    assert found == {"[": (1, 0, 0, 0, 0), "A": (1, 0, 0, 0, 0), "C": (0, 1, 0, 0, 1)}
