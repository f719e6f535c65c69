"""Count tables with one array of cells per group, (kmer, g0, g1, ...), for any alphabet, and models over them.

The cells of a group are in the order of the alphabet's letters, the stop last. Likelihoods are higher-order functions over the arrays, so a
protein table's 21 letters take no more columns than DNA's five. Tables in the wide form (g{group}_{letter}) are taken too.
"""

from __future__ import annotations

import json
import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from seqloom.functions import numeric as N
from seqloom.functions import symbols as S


def width(alphabet: str) -> int:
    return len(S.letters(alphabet))


def counts(table: DataFrame, group: int) -> Column:
    """A group's cells as an array, from either form of table."""
    if f"g{group}" in table.columns:
        return F.col(f"g{group}")
    own = sorted((c for c in table.columns if c.startswith(f"g{group}_")), key=lambda c: int(c.rsplit("_", 1)[1]))
    if not own:
        raise ValueError(f"the table has no group {group}")
    return F.array(*[F.col(c) for c in own])


def groups(table: DataFrame) -> list[int]:
    return sorted({int(c[1:].split("_")[0]) for c in table.columns if c[:1] == "g" and c[1:].split("_")[0].isdigit()})


def celled(long: DataFrame, n_groups: int, alphabet: str = "dna", keys: tuple[str, ...] = ("kmer",)) -> DataFrame:
    """The arrays of long counts (kmer, grp, nxt, n). One aggregate, summed in each task first."""
    names = S.letters(alphabet)
    cell = lambda g, a: F.coalesce(F.sum(F.when((F.col("grp") == g) & (F.col("nxt") == a), F.col("n"))), F.lit(0)).cast("bigint")
    return long.groupBy(*keys).agg(*[F.array(*[cell(g, a) for a in names]).alias(f"g{g}") for g in range(n_groups)])


def of_wide(table: DataFrame) -> DataFrame:
    return table.select("kmer", *[counts(table, g).alias(f"g{g}") for g in groups(table)])


def to_long(table: DataFrame, alphabet: str = "dna") -> DataFrame:
    """(kmer, grp, nxt, n) of the cells that aren't 0."""
    names = F.array(*[F.lit(a) for a in S.letters(alphabet)])
    of = lambda g: F.transform(counts(table, g), lambda n, i: F.struct(F.lit(g).alias("grp"), F.element_at(names, i + 1).alias("nxt"), n.alias("n")))
    rows = [of(g) for g in groups(table)]
    return table.select("kmer", F.inline(F.concat(*rows))).filter("n != 0")


def packed(table: DataFrame) -> DataFrame:
    """(kmer, counts): the matrix as JSON text, a list of letters for each group."""
    return table.select("kmer", F.to_json(F.array(*[counts(table, g) for g in groups(table)])).alias("counts"))


def unpacked(table: DataFrame, n_groups: int, alphabet: str = "dna") -> DataFrame:
    """The arrays of (kmer, counts). A matrix of another size raises: it is of another alphabet, or of other groups."""
    n = width(alphabet)
    m = F.from_json("counts", "array<array<bigint>>")
    fits = (F.size(m) == n_groups) & F.forall(m, lambda row: F.size(row) == n)
    wrong = F.raise_error(F.format_string(f"counts of %s are not {n_groups} groups of {n} letters, as the alphabet {alphabet} asks", F.col("kmer")))
    rows = table.select("kmer", F.when(F.coalesce(fits, F.lit(False)), m).otherwise(wrong).alias("m"))
    return rows.select("kmer", *[F.col("m")[g].alias(f"g{g}") for g in range(n_groups)])


def unpacked_sparse(table: DataFrame, n_groups: int, alphabet: str = "dna") -> DataFrame:
    """The arrays of (kmer, count_mat_indices, count_mat_values); a place outside the groups and letters raises."""
    n = width(alphabet)
    t = table.select("kmer", F.from_json("count_mat_indices", "array<array<int>>").alias("at"), F.from_json("count_mat_values", "array<double>").alias("v"))
    fits = (F.size("at") == F.size("v")) & F.forall("at", lambda x: (F.size(x) == 2) & (x[0] >= 0) & (x[0] < n_groups) & (x[1] >= 0) & (x[1] < n))
    wrong = F.raise_error(F.format_string(f"a place of %s is outside {n_groups} groups of {n} letters, as the alphabet {alphabet} asks", F.col("kmer")))
    t = t.select("kmer", F.when(F.coalesce(fits, F.lit(False)), F.arrays_zip("at", "v")).otherwise(wrong).alias("z"))

    def cells(g: int) -> Column:
        at = lambda i: F.aggregate("z", F.lit(0.0), lambda a, x: a + F.when((x["at"][0] == g) & (x["at"][1] == i), x["v"]).otherwise(0.0)).cast("bigint")
        return F.transform(F.sequence(F.lit(0), F.lit(n - 1)), at)

    return t.select("kmer", *[cells(g).alias(f"g{g}") for g in range(n_groups)])


# models


def linear(kmer: Column, weights, alphabet: str = "dna") -> Column:
    """softmax of the sum over places of the row weights[place][letter], as an array. A context's symbols are the letters and the start."""
    symbols = "".join(S.ALPHABETS[alphabet]) + S.START
    at = lambda j: F.instr(F.lit(symbols), F.substring(kmer, j + 1, 1)).cast("int")
    rows = [F.element_at(F.from_json(F.lit(json.dumps([[float(x) for x in row] for row in m])), "array<array<double>>"), at(j)) for j, m in enumerate(weights)]
    logits = rows[0]
    for r in rows[1:]:
        logits = F.zip_with(logits, r, lambda a, b: a + b)
    return N.softmax_of(logits)


def jukes_cantor(ref: Column, n: int, tau: float) -> Column:
    """Probabilities of a mutated reference: its shares of the letters drawn to the uniform by exp(-tau); nothing on stop."""
    u, e = 1 / (n - 1), math.exp(-tau)
    body = F.transform(F.slice(ref, 1, n - 1), lambda x: x.cast("double") + N.EPSILON)
    shares = N.bound(body, lambda b: N.bound(N.total_of(b), lambda t: F.transform(b, lambda x: u + e * (x / t - u))))
    return F.concat(shares, F.array(F.lit(0.0)))


def bmm_loglik(table: DataFrame, of: Sequence[int], alphas: Sequence[float], given: int | None = None) -> DataFrame:
    """(grp, alpha, loglik, total, correct) of each group under each alpha, conditioned on the counts of group `given` if there is one."""
    aggs, rows = [], []
    prior = lambda seen, a: F.transform(seen, lambda x: (x if given is not None else F.lit(0)) + F.lit(float(a)))
    for g in of:
        n = counts(table, g)
        for k, a in enumerate(alphas):
            conc = prior(n if given is None else counts(table, given), a)
            aggs += [F.sum(N.dm_logprob_of(conc, n)).alias(f"ll_{g}_{k}"), F.sum(N.at_argmax_of(conc, n)).alias(f"ok_{g}_{k}")]
            rows.append(F.struct(F.lit(g).alias("grp"), F.lit(float(a)).alias("alpha"), F.col(f"ll_{g}_{k}").alias("loglik"), F.col(f"n_{g}").alias("total"), F.col(f"ok_{g}_{k}").alias("correct")))
        aggs.append(F.sum(F.aggregate(n, F.lit(0).cast("bigint"), lambda a, x: a + x)).alias(f"n_{g}"))
    return table.agg(*aggs).select(F.inline(F.array(*rows)))


def evaluation(table: DataFrame, probs: Column, hs: Sequence[float], test: int, train: int | None = None) -> DataFrame:
    """(model, h, loglik, total, correct, perplexity, accuracy) of the model with the array `probs` alone ("ar") and as the mean of a Dirichlet
    of scale 1/h ("dm"), on group test, conditioned on group train if given."""
    t = table.select(counts(table, test).alias("t"), (counts(table, train) if train is not None else F.transform(counts(table, test), lambda x: F.lit(0).cast("bigint"))).alias("seen"), probs.alias("f"))
    aggs = [F.sum(F.aggregate("t", F.lit(0).cast("bigint"), lambda a, x: a + x)).alias("n"), F.sum(N.multinomial_logprob_of(F.transform("f", lambda p: p + N.EPSILON), F.col("t"))).alias("ll_ar"), F.sum(N.at_argmax_of(F.col("f"), F.col("t"))).alias("ok_ar")]
    rows = [("ar", 0.0, "ll_ar", "ok_ar")]
    under = lambda h: F.zip_with("f", "seen", lambda p, c: p / F.lit(float(h)) + c + N.EPSILON)
    for k, h in enumerate(hs):
        conc = under(h)
        aggs += [F.sum(N.dm_logprob_of(conc, F.col("t"))).alias(f"ll_{k}"), F.sum(N.at_argmax_of(conc, F.col("t"))).alias(f"ok_{k}")]
        rows.append(("dm", float(h), f"ll_{k}", f"ok_{k}"))
    structs = [F.struct(F.lit(m).alias("model"), F.lit(h).alias("h"), F.col(ll).alias("loglik"), F.col("n").alias("total"), F.col(ok).alias("correct")) for m, h, ll, ok in rows]
    out = t.agg(*aggs).select(F.inline(F.array(*structs)))
    return out.withColumn("perplexity", F.exp(-F.col("loglik") / F.col("total"))).withColumn("accuracy", F.col("correct") / F.col("total"))
