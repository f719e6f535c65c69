"""Words counted over Arrow batches, and by super-k-mers, against plain Python."""

import random
from collections import Counter

import numpy as np
from pyspark.sql import functions as F

from seqloom.functions import numeric as N
from seqloom.functions import symbols as S
from seqloom.operators import counting as C
from seqloom.operators import scoring, superkmers

rnd = random.Random(3)
SEQS = [None, "", "A", "ACG", "ACGT" * 50, "é中N\U0001f600ACGTACGT", "A" * 300, *("".join(rnd.choice("ACGT") for _ in range(rnd.randrange(400))) for _ in range(40))]


def plain(rows, width):
    return Counter((g, s[i : i + width]) for g, s in rows if s is not None for i in range(len(s) - width + 1))


def test_words(spark, monkeypatch):
    """Of any width, with any symbols, in pieces that cut sequences; a null keep is a keep."""
    rows = [(None if k % 7 == 0 else k % 3, s) for k, s in enumerate(SEQS)]
    reads = spark.createDataFrame(rows, "grp int, seq string").repartition(3)
    for width in (1, 4, 12, 40):
        got = {(r["grp"], r["w"]): r["n"] for r in C.count_words(reads, F.col("seq"), width).collect()}
        assert got == plain(rows, width)
    for piece in (7, 1 << 22):
        symbols, ends, _ = C.flat_symbols(reads.coalesce(1).toArrow()["seq"].combine_chunks())
        n = sum(int(n.sum()) for _, _, n in C.counted_words(symbols, ends, np.zeros(len(ends), np.int64), 4, piece))
        assert n == sum(plain(rows, 4).values())


def test_super_kmers(spark):
    rows = [(k % 3, s) for k, s in enumerate(SEQS)]
    reads = spark.createDataFrame(rows, "grp int, seq string").repartition(3)
    for k, m in ((31, 11), (12, 7)):
        got = {(r["grp"], r["kmer"]): r["n"] for r in superkmers.counted(reads, k, 2, m).collect()}
        assert got == {w: n for w, n in plain(rows, k).items() if n >= 2}


def test_dna_by_bytes(spark):
    texts = spark.createDataFrame([(1, None), (2, ""), (3, "Zebra, été 中文! xyz_09@[`{")], "id int, text string")
    assert [tuple(r) for r in S.with_dna(texts, "text").collect()] == [tuple(r) for r in texts.select("id", S.mapped_dna(F.col("text"))).collect()]


def test_marginals_in_numpy(spark):
    rows = [(k, [rnd.random() * 3 + 0.01 for _ in range(10)], [rnd.randrange(0, 4) * k for _ in range(5)]) for k in range(20)]
    t = spark.createDataFrame(rows, "k int, concs array<double>, counts array<bigint>")
    want = t.select("k", *[N.dm_logprob_of(F.slice("concs", 5 * j + 1, 5), F.col("counts")) for j in range(2)]).orderBy("k").collect()
    assert np.allclose([tuple(r) for r in scoring.with_marginals(t, 5, 2).orderBy("k").collect()], [tuple(r) for r in want], atol=1e-9)
