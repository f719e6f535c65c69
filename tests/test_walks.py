"""Draws and walks in numpy are those of the expressions."""

import numpy as np
from pyspark.sql import functions as F

from seqloom.functions import numeric as N
from seqloom.operators import sampling


def test_draws_are_the_expressions(spark):
    t = spark.createDataFrame([(k, [0.1 + k, 0.01, 3.0, 0.5]) for k in range(30)], "k bigint, conc array<double>")
    want = [r["d"] for r in t.orderBy("k").select(N.log_dirichlet_draw(F.col("conc"), F.lit(5), F.col("k")).alias("d")).collect()]
    got = N.log_dirichlet_draws(np.array([[0.1 + k, 0.01, 3.0, 0.5] for k in range(30)]), [f"5|{k}" for k in range(30)])
    assert np.allclose(got, want, atol=1e-9)


def test_small_tables_walk_as_large_ones(spark, monkeypatch):
    table = spark.createDataFrame([(a + b, *[(ord(a) * j + ord(b)) % 7 for j in range(5)]) for a in "[ACGT" for b in "ACGT"], "kmer string, " + ", ".join(f"g0_{j} bigint" for j in range(5)))
    seeds = spark.createDataFrame([(k, "ACGTTG"[k % 4 :], k % 3, 3 + k % 4) for k in range(12)] + [(None, "AC", 2, 2)], "seed_id bigint, seq string, left int, right int")
    for best in (True, False):
        walked = sorted(map(str, sampling.generated(seeds, table, 2, 0, samples=2, best=best).collect()))
        with monkeypatch.context() as m:
            m.setattr(sampling, "WHOLE", 0)
            assert walked == sorted(map(str, sampling.generated(seeds, table, 2, 0, samples=2, best=best).collect()))
