"""Draws that are expressions of their key, and long sequences grown from successor tables and under fitted models."""

import time

import numpy as np
import pytest
from pyspark.sql import functions as F

from seqloom.functions import numeric as N
from seqloom.operators import cells, counting, sampling, training
from seqloom.plans import fit


@pytest.fixture(scope="module")
def table(spark):
    rng = np.random.default_rng(7)
    reads = spark.createDataFrame([(k % 3, "".join(rng.choice(list("ACGT"), 80, p=[0.4, 0.3, 0.2, 0.1]))) for k in range(40)], "grp int, seq string")
    return counting.wide(counting.count_long(counting.both_strands(reads), 4), 3).cache()


@pytest.mark.parametrize("shape", [0.02, 0.5, 1.0, 3.0, 500.0])
def test_gamma_draws(spark, shape):
    """Moments of the logarithm: mean digamma, variance trigamma; nothing but the key decides a draw."""
    n = 20_000
    draws = spark.range(n).select("id", N.log_gamma_draw(F.lit(shape), F.lit(3), F.col("id")).alias("x"))
    got = np.array([r["x"] for r in draws.orderBy("id").collect()])
    again = draws.repartition(7).orderBy(F.desc("id")).limit(50).collect()
    assert all(r["x"] == got[r["id"]] for r in again)
    step = 1e-3 * shape
    digamma = lambda x: float(training.digamma(np.array([x]))[0])
    mean, var = digamma(shape), (digamma(shape + step) - digamma(shape - step)) / (2 * step)
    assert got.mean() == pytest.approx(mean, abs=5 * (var / n) ** 0.5) and got.var() == pytest.approx(var, rel=0.15)
    if shape >= 0.5:
        assert np.exp(got).mean() == pytest.approx(shape, abs=6 * (shape / n) ** 0.5)


def test_dirichlet_draws(spark):
    conc = [0.1, 2.0, 5.0, 0.5, 1e-3]
    rows = spark.range(8000).select(N.log_dirichlet_draw(F.array(*[F.lit(c) for c in conc]), F.lit("k"), F.col("id")).alias("l")).collect()
    p = np.exp(np.array([r["l"] for r in rows]))
    assert np.allclose(p.sum(axis=1), 1) and np.allclose(p.mean(axis=0), np.array(conc) / sum(conc), atol=0.015)


def by_steps(seeds, table, lag, steps, alpha, best, seed=0):
    """A letter at a time, with the counts from a dict: what successor tables must give."""
    import hashlib

    counts = {r["kmer"]: [r[f"g0_{i}"] for i in range(4)] for r in table.collect()}
    u = lambda *k: (int(hashlib.md5("|".join(map(str, k)).encode()).hexdigest()[:13], 16) + 0.5) / 2**52
    out = {}
    for sid, s in seeds:
        tail, grown = ("[" * lag + s)[-lag:], ""
        for step in range(1, steps + 1):
            logp = np.log(alpha + np.array(counts.get(tail, [0] * 4)))
            v = [round(x + -np.log(-np.log(u(seed, sid, 0, "R", step, c))), 9) for x, c in zip(logp, "ACGT", strict=True)]
            x = "ACGT"[int(np.argmax(v))]
            tail, grown = (tail + x)[-lag:], grown + x
        out[sid] = s + grown
    return out


@pytest.mark.parametrize("whole", [sampling.WHOLE, 0])
def test_successors_serve_many_letters(spark, table, monkeypatch, whole):
    monkeypatch.setattr(sampling, "WHOLE", whole)
    rows = [(k, s) for k, s in enumerate(["A", "", "ACGT", "GGGGGGGG", "TTAC"])]
    seeds = spark.createDataFrame(rows, "seed_id int, seq string")
    got = {r["seed_id"]: r["seq"] for r in sampling.generated(seeds, table, 4, 0, right=37, best=True).collect()}
    assert got == by_steps(rows, table, 4, 37, 0.1, True)
    s = sampling.successors(table, 4, 0, 4)
    assert s.filter("length(inner) != 1").count() == 0 and s.count() == 5
    short = counting.wide(counting.rolled_up(counting.count_long(spark.createDataFrame([(0, "ACGTTACG")], "grp int, seq string"), 4), [1]), 1)
    assert {len(r["seq"]) for r in sampling.generated(seeds, short, 1, 0, left=3, right=9).collect()} == {len(x) + 12 for _, x in rows}


def test_500_letters_in_a_minute(spark, table):
    seeds = spark.createDataFrame([(k, "ACGT") for k in range(20)], "seed_id int, seq string")
    began = time.time()
    rows = sampling.generated(seeds, table, 4, 0, right=500, samples=2).collect()
    assert len(rows) == 40 and all(len(r["seq"]) == 504 for r in rows) and time.time() - began < 60
    assert len({r["seq"] for r in rows}) == 40


def test_a_fitted_reference_model_generates(spark, table):
    params, _ = training.train(table, "stop", 4, ref_group=2, steps=2, rate=0.1)
    model = fit.Trained("stop", 4, params, 2)
    seeds = spark.createDataFrame([(1, "ACGT"), (2, "TT")], "seed_id int, seq string")
    said = dict(left=3, right=6, predict=model.predict, h=model.h, ref_group=2)
    rows = sampling.generated(seeds, table, 4, 0, **said).collect()
    assert {r["seed_id"]: len(r["seq"]) for r in rows} == {1: 13, 2: 11} and all(set(r["seq"]) <= set("ACGT") for r in rows)
    again = sampling.generated(seeds, cells.of_wide(table), 4, 0, **said).collect()
    assert sorted(map(tuple, rows)) == sorted(map(tuple, again))


def test_proteins_grow_to_the_right(spark):
    reads = spark.createDataFrame([(0, "MKVLAAGIVMKVLLLP")], "grp int, seq string")
    table = cells.celled(counting.count_long(reads, 2, "prot"), 1, "prot")
    seeds = spark.createDataFrame([(1, "MK")], "seed_id int, seq string")
    seq = sampling.generated(seeds, table, 2, 0, right=4, best=True, alpha=1e-12, alphabet="prot").first()["seq"]
    assert seq[:4] == "MKVL" and len(seq) == 6
    with pytest.raises(ValueError, match="no reverse complement"):
        sampling.generated(seeds, table, 2, 0, left=1, alphabet="prot")
