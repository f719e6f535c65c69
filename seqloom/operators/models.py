"""Count models over wide tables: Dirichlet-multinomial and multinomial likelihoods, perplexity, accuracy, scans over concentrations.

Concentrations are f / h plus the counts conditioned on plus epsilon; without f they are a constant alpha (the plain Bayesian
Markov model, BMM). A model's sums are one aggregate over the table, for all parameter values at once.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from seqloom.functions import numeric as N

LETTERS = 5


def cells(group: int, n: int = LETTERS) -> list[Column]:
    return [F.col(f"g{group}_{i}") for i in range(n)]


def jukes_cantor(ref: list[Column], tau: float) -> list[Column]:
    """Letter probabilities of a mutated reference: its shares drawn to the uniform by exp(-tau); nothing on stop."""
    kept = [r + N.EPSILON for r in ref[:-1]]
    total = sum(kept[1:], kept[0])
    u, e = 1 / (len(ref) - 1), math.exp(-tau)
    return [u + e * (k / total - u) for k in kept] + [F.lit(0.0)]


def reference_ar(ref: list[Column], tau: float = 1 / 30, nu: float = 0.01, other: list[Column] | None = None) -> list[Column]:
    """Mixture of the mutated reference and another model, by default one that always stops."""
    other = other or [F.lit(0.0)] * (len(ref) - 1) + [F.lit(1.0)]
    return [(nu * g + p) / (nu + 1) for g, p in zip(other, jukes_cantor(ref, tau), strict=True)]


def linear_ar(kmer: Column, weights: list[list[list[float]]], alphabet: str = "ACGT[") -> list[Column]:
    """softmax of the sum over places j of the row weights[j][letter]; the rows are literals, so the model needs no join."""
    n = len(weights[0][0])
    rows = [F.array(*[F.array(*[F.lit(float(x)) for x in row]) for row in m]) for m in weights]
    picked = [F.element_at(r, F.instr(F.lit(alphabet), F.substring(kmer, j + 1, 1)).cast("int")) for j, r in enumerate(rows)]
    logits = [sum((p[i] for p in picked[1:]), picked[0][i]) for i in range(n)]
    return N.softmax(logits)


def bmm_loglik(table: DataFrame, groups: list[int], alphas: list[float], given: int | None = None) -> DataFrame:
    """(grp, alpha, loglik, total, correct): of each group under each alpha, conditioned on the counts of group `given` if there is one."""
    aggs, rows = [], []
    for g in groups:
        for k, a in enumerate(alphas):
            conc = [F.lit(a) + (c if given is not None else F.lit(0)) for c in cells(given or 0)]
            aggs += [F.sum(N.dm_logprob(conc, cells(g))).alias(f"ll_{g}_{k}"), F.sum(N.at_argmax(conc, cells(g))).alias(f"ok_{g}_{k}")]
            rows.append(F.struct(F.lit(g).alias("grp"), F.lit(a).alias("alpha"), F.col(f"ll_{g}_{k}").alias("loglik"), F.col(f"n_{g}").alias("total"), F.col(f"ok_{g}_{k}").alias("correct")))
        aggs.append(F.sum(sum(cells(g)[1:], cells(g)[0])).alias(f"n_{g}"))
    return table.agg(*aggs).select(F.inline(F.array(*rows)))


def evaluation(table: DataFrame, probs: list[Column], hs: list[float], test: int, train: int | None = None) -> DataFrame:
    """(model, h, loglik, total, correct, perplexity, accuracy) of the autoregressive model `probs` alone ("ar") and as
    the mean of a Dirichlet of scale 1/h ("dm"), on group test, conditioned on group train if given."""
    seen = cells(train) if train is not None else [F.lit(0)] * LETTERS
    t = cells(test)
    aggs = [F.sum(sum(t[1:], t[0])).alias("n"), F.sum(N.multinomial_logprob([p + N.EPSILON for p in probs], t)).alias("ll_ar"), F.sum(N.at_argmax(probs, t)).alias("ok_ar")]
    rows = [("ar", 0.0, "ll_ar", "ok_ar")]
    for k, h in enumerate(hs):
        conc = [p / h + c + N.EPSILON for p, c in zip(probs, seen, strict=True)]
        aggs += [F.sum(N.dm_logprob(conc, t)).alias(f"ll_{k}"), F.sum(N.at_argmax(conc, t)).alias(f"ok_{k}")]
        rows.append(("dm", h, f"ll_{k}", f"ok_{k}"))
    structs = [F.struct(F.lit(m).alias("model"), F.lit(h).alias("h"), F.col(ll).alias("loglik"), F.col("n").alias("total"), F.col(ok).alias("correct")) for m, h, ll, ok in rows]
    out = table.agg(*aggs).select(F.inline(F.array(*structs)))
    return out.withColumn("perplexity", F.exp(-F.col("loglik") / F.col("total"))).withColumn("accuracy", F.col("correct") / F.col("total"))


def posterior_mean(table: DataFrame, group: int, alphas: list[float]) -> DataFrame:
    """(kmer, alpha, nxt, logp): the log of the posterior mean of each letter's probability."""
    c = cells(group)
    total = sum(c[1:], c[0])
    rows = [F.struct(F.lit(a).alias("alpha"), F.lit(x).alias("nxt"), F.log((c[i] + a) / (total + LETTERS * a)).alias("logp")) for a in alphas for i, x in enumerate("ACGT]")]
    return table.select("kmer", F.inline(F.array(*rows)))
