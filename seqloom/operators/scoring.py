"""Scores of variants and whole sequences under count models: joins of their windows with the table of what was counted."""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from seqloom.functions import numeric as N
from seqloom.functions import symbols as S
from seqloom.operators.cells import counts as array_of
from seqloom.operators.cells import width
from seqloom.operators.counting import overlapping
from seqloom.operators.models import LETTERS, cells
from seqloom.operators.sampling import drawn
from seqloom.sources.shared import kept


def parsed(variant: Column) -> Column:
    """'AAG23CC' -> (ref AAG, pos 23, alt CC); the position counts from 0 and either side may be empty."""
    part = lambda k: F.regexp_extract(variant, "^([^0-9]*)([0-9]+)(.*)$", k)
    return F.struct(part(1).alias("ref"), part(2).cast("int").alias("pos"), part(3).alias("alt"))


def variant_windows(variants: DataFrame, lag: int) -> DataFrame:
    """(var_id, sgn, kmer, nxt) from (var_id, seq, ref, pos, alt): the windows that a variant takes away (-1) and brings (+1)."""
    ok = F.substring(F.col("seq"), F.col("pos") + 1, F.length("ref")) == F.col("ref")
    v = variants.select("var_id", "seq", "ref", "alt", F.when(ok, F.col("pos")).otherwise(F.raise_error(F.lit("the sequence differs from the variant's reference"))).alias("pos"))
    # only the letters around the change matter: lag before it, the changed ones, lag after it, stop included
    p = S.padded(F.col("seq"), lag)
    near = v.select("var_id", "ref", "alt", F.substring(p, F.col("pos") + 1, F.lit(lag)).alias("before"), F.substring(p, F.col("pos") + F.length("ref") + lag + 1, F.lit(lag)).alias("after"))
    side = lambda sgn, c: F.struct(F.lit(sgn).alias("sgn"), F.concat("before", c, "after").alias("p"))
    each = near.select("var_id", F.inline(F.array(side(-1, F.col("ref")), side(1, F.col("alt")))))
    each = each.select("var_id", "sgn", F.explode(overlapping(F.col("p"), lag + 1)).alias("w"))
    return each.select("var_id", "sgn", F.left("w", F.lit(lag)).alias("kmer"), F.right("w", F.lit(1)).alias("nxt"))


def logp(windows: DataFrame, table: DataFrame, group: int, alphas: list[float]) -> DataFrame:
    """Adds alpha and logp to windows (kmer, nxt): the posterior mean under the counts, the prior alone for contexts not seen."""
    c = cells(group)
    seen = table.select("kmer", F.array(*c).alias("_c"), sum(c[1:], c[0]).alias("_total"))
    joined = windows.join(seen, "kmer", "left")
    count = F.coalesce(F.element_at("_c", F.instr(F.lit("ACGT]"), F.col("nxt")).cast("int")), F.lit(0))
    rows = [F.struct(F.lit(a).alias("alpha"), F.log((count + a) / (F.coalesce("_total", F.lit(0)) + LETTERS * a)).alias("logp")) for a in alphas]
    return joined.select(*windows.columns, F.inline(F.array(*rows)))


def _summed(windows: DataFrame, table: DataFrame, group: int, alphas: list[float], key: str, n: str) -> DataFrame:
    """(key, alpha, score): sums of n times logp of windows (key, kmer, nxt, n). A row goes through the join and the aggregate once, whatever the number of alphas."""
    c = cells(group)
    logs = lambda i: [F.log((c[i] + a) / (sum(c[1:], c[0]) + LETTERS * a)).alias(f"_l{k}") for k, a in enumerate(alphas)]
    seen = table.select("kmer", F.inline(F.array(*[F.struct(F.lit(x).alias("nxt"), *logs(i)) for i, x in enumerate(S.letters("dna"))])))
    each = windows.join(seen, ["kmer", "nxt"], "left")
    sums = each.groupBy(key).agg(*[F.sum(F.col(n) * F.coalesce(f"_l{k}", F.lit(-math.log(LETTERS)))).alias(f"_s{k}") for k in range(len(alphas))])
    return sums.select(key, F.inline(F.array(*[F.struct(F.lit(a).alias("alpha"), F.col(f"_s{k}").alias("score")) for k, a in enumerate(alphas)])))


def variant_scores(variants: DataFrame, table: DataFrame, lag: int, group: int, alphas: list[float]) -> DataFrame:
    """(var_id, alpha, score): log probability of the mutant less that of the wild type."""
    each = variant_windows(variants, lag).groupBy("var_id", "kmer", "nxt").agg(F.sum("sgn").alias("sgn"))
    return _summed(each, table, group, alphas, "var_id", "sgn")


def sequence_scores(counted: DataFrame, table: DataFrame, group: int, alphas: list[float]) -> DataFrame:
    """(seq_id, alpha, score) of counted windows (seq_id, kmer, nxt, n)."""
    return _summed(counted, table, group, alphas, "seq_id", "n")


def _own(alphabet: str = "dna") -> list[Column]:
    """w0..: how often each letter follows, of a group of counted windows."""
    return [F.coalesce(F.sum(F.when(F.col("nxt") == x, F.col("n"))), F.lit(0)).alias(f"w{i}") for i, x in enumerate(S.letters(alphabet))]


def with_marginals(rows: DataFrame, n: int, models: int) -> DataFrame:
    """Rows whose last two columns are concs, `models` times n concentrations, and counts, n of them: in their place s0.., the Dirichlet-multinomial
    log likelihood under each model. In numpy over Arrow batches, as a likelihood takes a score of logarithms."""
    schema = ", ".join([*(f"`{c}` {t}" for c, t in rows.dtypes[:-2]), *(f"s{k} double" for k in range(models))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            conc = b.column(b.num_columns - 2).flatten().to_numpy().reshape(-1, models, n)
            own = b.column(b.num_columns - 1).flatten().to_numpy().reshape(-1, 1, n).astype(np.float64)
            ll = N.rising_of(conc, own).sum(axis=2) - N.rising_of(conc.sum(axis=2), own.sum(axis=2))
            yield pa.RecordBatch.from_arrays([*b.columns[:-2], *(pa.array(ll[:, k]) for k in range(models))], [*b.schema.names[:-2], *(f"s{k}" for k in range(models))])

    return rows.mapInArrow(run, schema)


def sequence_marginals(counted: DataFrame, table: DataFrame, group: int, alphas: list[float]) -> DataFrame:
    """(seq_id, alpha, score) of counted windows (seq_id, kmer, nxt, n): log marginal likelihood, a sequence's windows of one context sharing their distribution."""
    own = counted.groupBy("seq_id", "kmer").agg(*_own())
    joined = own.join(table.select("kmer", *[c.alias(f"t{i}") for i, c in enumerate(cells(group))]), "kmer", "left")
    conc = F.array(*[F.coalesce(f"t{i}", F.lit(0)) + F.lit(float(a)) for a in alphas for i in range(LETTERS)])
    lls = with_marginals(joined.select("seq_id", conc.alias("concs"), F.array(*[f"w{i}" for i in range(LETTERS)]).alias("counts")), LETTERS, len(alphas))
    out = lls.groupBy("seq_id").agg(*[F.sum(f"s{k}").alias(f"s{k}") for k in range(len(alphas))])
    return out.select("seq_id", F.inline(F.array(*[F.struct(F.lit(a).alias("alpha"), F.col(f"s{k}").alias("score")) for k, a in enumerate(alphas)])))


# scores under trained models: "ar" (an autoregressive model alone), "dm" (the mean of a Dirichlet of scale 1/h) and "bmm"


def concentrations(contexts: DataFrame, table: DataFrame, group: int, *, predict: Callable[[DataFrame], DataFrame] | None = None, hs: Sequence[float] = (), alphas: Sequence[float] = (), alone: bool = True, alphabet: str = "dna") -> DataFrame:
    """(kmer, model, param, conc array) for each distinct context: what its letters' probabilities are drawn from, given the counts of the group.

    predict adds the model's probabilities f0.. to (kmer, ...) rows; without it there are bmm rows alone. Contexts that the
    table lacks have the prior. alone: also rows of the autoregressive model without counts.
    """
    n = width(alphabet)
    seen = table.select("kmer", array_of(table, group).alias("_c"))
    rows = contexts.select("kmer").distinct().join(seen, "kmer", "left").withColumn("_c", F.coalesce("_c", F.array_repeat(F.lit(0).cast("bigint"), n)))
    models = [("bmm", float(a), [F.lit(float(a))] * n, True) for a in alphas]
    if predict is not None:
        rows = predict(rows)
        f = [F.col(f"f{i}") + N.EPSILON for i in range(n)]
        models = ([("ar", 0.0, f, False)] if alone else []) + [("dm", float(h), [x / float(h) for x in f], True) for h in hs] + models

    def struct(name: str, param: float, prior: list[Column], counted: bool) -> Column:
        conc = F.array(*[p + (F.col("_c")[i] if counted else F.lit(0)) for i, p in enumerate(prior)])
        return F.struct(F.lit(name).alias("model"), F.lit(param).alias("param"), conc.alias("conc"))

    return rows.select("kmer", F.inline(F.array(*[struct(*m) for m in models])))


def _by_context(conc: DataFrame, value: Column) -> tuple[DataFrame, list[tuple[str, float]]]:
    """(kmer, v0..): the value of each model at each context, and the models. So a window meets its context once, not once a model."""
    conc = kept(conc, "concentrations")
    models = [(r["model"], r["param"]) for r in conc.select("model", "param").distinct().orderBy("model", "param").collect()]
    cols = [F.first(F.when((F.col("model") == m) & (F.col("param") == p), value), ignorenulls=True).alias(f"v{k}") for k, (m, p) in enumerate(models)]
    return conc.groupBy("kmer").agg(*cols or [F.lit(0)]), models


def _named(sums: DataFrame, key: str, models: list[tuple[str, float]]) -> DataFrame:
    """(key, model, param, score) of sums (key, s0..)."""
    rows = [F.struct(F.lit(m).alias("model"), F.lit(p).alias("param"), F.col(f"s{k}").alias("score")) for k, (m, p) in enumerate(models)]
    none = F.array().cast("array<struct<model:string,param:double,score:double>>")
    return sums.select(key, F.inline(F.array(*rows) if rows else none))


def by_letter(rows: DataFrame, values: list[str], alphabet: str = "dna") -> DataFrame:
    """(kmer, nxt, values...) of rows whose values are arrays, a place per letter."""
    each = [F.struct(F.lit(x).alias("nxt"), *[F.col(v)[i].alias(v) for v in values]) for i, x in enumerate(S.letters(alphabet))]
    others = [c for c in rows.columns if c not in values]
    return rows.select(*others, F.inline(F.array(*each)))


def model_scores(counted: DataFrame, conc: DataFrame, key: str, alphabet: str = "dna") -> DataFrame:
    """(key, model, param, score) of windows (key, kmer, nxt, n): sums of n times the log of the posterior mean. n may be negative."""
    total = F.aggregate("conc", F.lit(0.0), lambda a, x: a + x)
    logs, models = _by_context(conc.withColumn("logp", F.transform("conc", lambda x: F.log(x / total))), F.col("logp"))
    each = counted.select(key, "kmer", "nxt", "n").join(by_letter(logs, [f"v{k}" for k in range(len(models))], alphabet), ["kmer", "nxt"])
    return _named(each.groupBy(key).agg(*[F.sum(F.col("n") * F.col(f"v{k}")).alias(f"s{k}") for k in range(len(models))] or [F.lit(0)]), key, models)


#: Contexts of a table of concentrations that tasks carry whole.
CARRIED = 4096


def carried_marginals(own: DataFrame, concs: DataFrame, key: str, n: int, models: int) -> DataFrame:
    """(key, s0..) of rows (key, kmer, w0..): with_marginals beside few contexts (kmer, v0..), which go to the tasks whole, so rows carry counts alone."""
    there = concs.collect()
    shared = own.sparkSession.sparkContext.broadcast(([r["kmer"] for r in there], np.array([[r[f"v{k}"] for k in range(models)] for r in there], np.float64).reshape(-1, models, n)))
    rows = own.select(key, "kmer", *[f"w{i}" for i in range(n)])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names, table = pa.array(shared.value[0], pa.string()), shared.value[1]
        for whole in batches:
            at = pc.index_in(whole.column(1), names)
            b, at = whole.filter(at.is_valid()), at.drop_null().to_numpy()
            own = np.stack([b.column(2 + i).to_numpy() for i in range(n)], axis=1).astype(np.float64)[:, None]
            ll = N.rising_of(table[at], own).sum(axis=2) - N.rising_of(table.sum(axis=2)[at], own.sum(axis=2))
            yield pa.RecordBatch.from_arrays([b.column(0), *(pa.array(ll[:, k]) for k in range(models))], [key, *(f"s{k}" for k in range(models))])

    return rows.mapInArrow(run, f"`{key}` {rows.dtypes[0][1]}, " + ", ".join(f"s{k} double" for k in range(models)))


def model_marginals(counted: DataFrame, conc: DataFrame, key: str, alphabet: str = "dna") -> DataFrame:
    """(key, model, param, score): log marginal likelihood of the windows (key, kmer, nxt, n), those of one context sharing their distribution.
    counted may also have a row per key and context, (key, kmer, w0..)."""
    concs, models = _by_context(conc.filter("model != 'ar'"), F.col("conc"))
    own = counted if "w0" in counted.columns else counted.groupBy(key, "kmer").agg(*_own(alphabet))
    n = width(alphabet)
    if models and concs.limit(CARRIED + 1).count() <= CARRIED:
        lls = carried_marginals(own, concs, key, n, len(models))
    else:
        own = own.join(concs, "kmer")
        lls = with_marginals(own.select(key, F.concat(*[f"v{k}" for k in range(len(models))]).cast("array<double>").alias("concs"), F.array(*[f"w{i}" for i in range(n)]).alias("counts")), n, len(models))
    return _named(lls.groupBy(key).agg(*[F.sum(f"s{k}").alias(f"s{k}") for k in range(len(models))] or [F.lit(0)]), key, models)


#: Samples of a model that are summed up side by side.
SAMPLES = 32


def model_samples(counted: DataFrame, conc: DataFrame, key: str, samples: int, seed: int = 0, alphabet: str = "dna") -> DataFrame:
    """(key, model, param, sample, score): scores under models drawn from the posterior; a context's draw is shared by all windows."""
    draws = drawn(conc.filter("model != 'ar'"), samples, seed)
    # a row per context, letter and SAMPLES samples, made once: windows meet it once, not once a sample
    at = lambda i: F.transform("logps", lambda p: p[i])
    letters = [F.struct(F.lit(x).alias("nxt"), at(i).alias("logp")) for i, x in enumerate(S.letters(alphabet))]
    parts = F.transform(F.sequence(F.lit(0), F.lit((samples - 1) // SAMPLES)), lambda b: F.struct(b.alias("b"), F.slice("logp", b * SAMPLES + 1, F.lit(SAMPLES)).alias("logp")))
    table = kept(draws.select("kmer", "model", "param", F.inline(F.array(*letters))).select("kmer", "nxt", "model", "param", F.inline(parts)), "draws")
    each = counted.select(key, "kmer", "nxt", "n").join(table, ["kmer", "nxt"])
    sums = each.groupBy(key, "model", "param", "b").agg(*[F.sum(F.col("n") * F.get("logp", F.lit(k))).alias(f"s{k}") for k in range(min(samples, SAMPLES))])
    out = sums.select(key, "model", "param", "b", F.posexplode(F.array(*[f"s{k}" for k in range(min(samples, SAMPLES))])).alias("k", "score"))
    return out.select(key, "model", "param", (F.col("b") * SAMPLES + F.col("k")).alias("sample"), "score").filter(F.col("sample") < samples)
