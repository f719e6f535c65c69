"""Numeric Column expressions that Spark lacks: log-gamma and its slope, log-beta, softmax, and reproducible random numbers and gamma draws."""

from __future__ import annotations

import hashlib
import math
from collections.abc import Callable

import numpy as np
from pyspark.sql import Column
from pyspark.sql import functions as F

EPSILON = 1e-7


def lgamma(x: Column) -> Column:
    """ln Gamma(x) for x > 0: Stirling's series at x + 10, less the logs of the ten factors that lie between."""
    z = x + 10.0
    w = 1.0 / (z * z)
    series = (1 / 12 + w * (-1 / 360 + w * (1 / 1260 + w * (-1 / 1680 + w * (1 / 1188))))) / z
    product = x
    for k in range(1, 10):
        product = product * (x + float(k))
    return (z - 0.5) * F.log(z) - z + 0.5 * math.log(2 * math.pi) + series - F.log(product)


def digamma(x: Column) -> Column:
    """The slope of lgamma for x > 0: its asymptotic series at x + 10, less the reciprocals that lie between."""
    z = x + 10.0
    w = 1.0 / (z * z)
    series = w * (1 / 12 - w * (1 / 120 - w * (1 / 252 - w * (1 / 240 - w / 132))))
    between = 1.0 / x
    for k in range(1, 10):
        between = between + 1.0 / (x + float(k))
    return F.log(z) - 0.5 / z - series - between


def lbeta(a: Column, b: Column) -> Column:
    """ln B(a, b)."""
    return lgamma(a) + lgamma(b) - lgamma(a + b)


def log_gamma_density(shape: Column, x: Column) -> Column:
    """The density at x of the logarithm of a gamma draw of that shape and scale 1."""
    return F.exp(shape * x - F.exp(x) - lgamma(shape))


def rising(c: Column, n: Column) -> Column:
    """ln Gamma(c + n) - ln Gamma(c); exactly 0 where n is 0."""
    return F.when(n == 0, F.lit(0.0)).otherwise(lgamma(c + n) - lgamma(c))


def lgamma_of(x: np.ndarray) -> np.ndarray:
    """lgamma of an array, by the same series."""
    z = x + 10.0
    w = 1.0 / (z * z)
    series = (1 / 12 + w * (-1 / 360 + w * (1 / 1260 + w * (-1 / 1680 + w * (1 / 1188))))) / z
    product = x.copy()
    for k in range(1, 10):
        product *= x + float(k)
    return (z - 0.5) * np.log(z) - z + 0.5 * math.log(2 * math.pi) + series - np.log(product)


def rising_of(c: np.ndarray, n: np.ndarray) -> np.ndarray:
    """rising of two arrays that fit each other."""
    c, n = np.broadcast_arrays(c, n)
    out, some = np.zeros(c.shape), n != 0
    out[some] = lgamma_of(c[some] + n[some]) - lgamma_of(c[some])
    return out


def dm_logprob(conc: list[Column], counts: list[Column]) -> Column:
    """Log probability of an ordered draw of `counts` letters under Dirichlet-multinomial concentrations."""
    total_c, total_n = sum(conc[1:], conc[0]), sum(counts[1:], counts[0])
    terms = [*((1.0, c, n) for c, n in zip(conc, counts, strict=True)), (-1.0, total_c, total_n)]
    # one lambda over the terms: written out for each, the code would pass what the JVM compiles
    rows = F.array(*[F.struct(F.lit(s).alias("s"), c.cast("double").alias("c"), n.cast("double").alias("n")) for s, c, n in terms])
    return F.aggregate(rows, F.lit(0.0), lambda a, x: a + x["s"] * rising(x["c"], x["n"]))


def dm_logprob_of(conc: Column, counts: Column) -> Column:
    """dm_logprob of two arrays of one length, for any number of letters."""
    pairs = F.zip_with(conc, counts, lambda c, n: F.struct(F.lit(1.0).alias("s"), c.cast("double").alias("c"), n.cast("double").alias("n")))
    rows = F.concat(pairs, F.array(F.struct(F.lit(-1.0).alias("s"), total_of(conc).alias("c"), total_of(counts).alias("n"))))
    return F.aggregate(rows, F.lit(0.0), lambda a, x: a + x["s"] * rising(x["c"], x["n"]))


def multinomial_logprob_of(probs: Column, counts: Column) -> Column:
    """multinomial_logprob of two arrays of one length."""
    parts = F.zip_with(probs, counts, lambda p, n: F.when(n == 0, F.lit(0.0)).otherwise(n * F.log(p)))
    return F.aggregate(parts, F.lit(0.0), lambda a, x: a + x)


def at_argmax_of(values: Column, counts: Column) -> Column:
    """The count at the place of the largest value, the first of equal ones."""
    return F.element_at(counts, F.array_position(values, F.array_max(values)).cast("int"))


def multinomial_logprob(probs: list[Column], counts: list[Column]) -> Column:
    """Log probability of an ordered draw; letters without counts don't matter."""
    parts = [F.when(n == 0, F.lit(0.0)).otherwise(n * F.log(p)) for p, n in zip(probs, counts, strict=True)]
    return sum(parts[1:], parts[0])


def bound(value: Column, use: Callable[[Column], Column]) -> Column:
    """use(value), with the value made once however often it is used; an expression that names it many times would repeat it."""
    return F.element_at(F.transform(F.array(value), use), 1)


def total_of(values: Column) -> Column:
    return F.aggregate(values, F.lit(0.0), lambda a, x: a + x.cast("double"))


def softmax_of(logits: Column) -> Column:
    """softmax of an array."""
    exps = bound(logits, lambda z: bound(F.array_max(z), lambda top: F.transform(z, lambda x: F.exp(x - top))))
    return bound(exps, lambda e: bound(total_of(e), lambda t: F.transform(e, lambda x: x / t)))


def softmax(logits: list[Column]) -> list[Column]:
    top = F.greatest(*logits)
    exps = [F.exp(x - top) for x in logits]
    total = sum(exps[1:], exps[0])
    return [e / total for e in exps]


def argmax(values: list[Column]) -> Column:
    """The place of the largest value, the first of equal ones."""
    return F.array_position(F.array(*values), F.greatest(*values)).cast("int") - 1


def at_argmax(values: list[Column], counts: list[Column]) -> Column:
    return F.element_at(F.array(*counts), argmax(values) + 1)


def xlogx(p: Column) -> Column:
    return F.when(p == 0, F.lit(0.0)).otherwise(p * F.log(p))


def uniform(*key: Column) -> Column:
    """A number in (0, 1) from the md5 of the key; the same on any engine and in any rerun."""
    said = F.concat_ws("|", *[k.cast("string") for k in key])
    return (F.conv(F.substring(F.md5(said), 1, 13), 16, 10).cast("double") + 0.5) / float(2**52)


def gumbel(*key: Column) -> Column:
    return -F.log(-F.log(uniform(*key)))


#: Tries of a gamma draw. Each is taken with over 95 %, so that all fail once in 10^20 draws or more; such a draw raises.
TRIES = 16


def log_gamma_draw(shape: Column, *key: Column) -> Column:
    """The logarithm of a gamma draw of that shape and scale 1, told by the key alone, for any shape above 0.

    Marsaglia and Tsang's squeeze at shape + 1, whose tries are numbered: try t takes the uniforms (key, t, 0..2) for a normal
    number and the test, and the first that passes is kept. u^(1/shape), in logs, brings the draw down to the shape, so tiny shapes don't underflow.
    """

    def tried(d: Column, t: Column) -> Column:
        x = F.sqrt(-2.0 * F.log(uniform(*key, t, F.lit(0)))) * F.cos(2 * math.pi * uniform(*key, t, F.lit(1)))
        u = F.log(uniform(*key, t, F.lit(2)))

        def passed(r: Column) -> Column:
            return F.when((r["v"] > 0) & (r["u"] < 0.5 * r["x"] * r["x"] + d - d * r["v"] + d * F.log(r["v"])), F.log(d * r["v"]))

        return bound(x, lambda n: bound(F.struct(n.alias("x"), u.alias("u"), F.pow(1.0 + n / F.sqrt(9.0 * d), F.lit(3)).alias("v")), passed))

    first = lambda d: F.aggregate(F.sequence(F.lit(0), F.lit(TRIES - 1)), F.lit(None).cast("double"), lambda a, t: F.when(a.isNotNull(), a).otherwise(tried(d, t)))
    drawn = F.coalesce(bound(shape.cast("double") + (1.0 - 1.0 / 3.0), first), F.raise_error(F.lit("no try of a gamma draw passed")).cast("double"))
    return drawn + F.log(uniform(*key, F.lit("low"))) / shape


def log_dirichlet_draw(conc: Column, *key: Column) -> Column:
    """The logarithms of a Dirichlet draw with the concentrations of an array, told by the key alone."""
    logs = F.transform(conc, lambda c, i: log_gamma_draw(c, *key, i))
    whole = lambda g, top: F.log(F.aggregate(g, F.lit(0.0), lambda t, x: t + F.exp(x - top))) + top
    return bound(logs, lambda g: bound(bound(F.array_max(g), lambda top: whole(g, top)), lambda total: F.transform(g, lambda x: x - total)))


# the same draws in numpy, for Arrow functions


def uniforms(keys: list[str]) -> np.ndarray:
    """uniform of each key, its parts joined by |."""
    md5 = hashlib.md5
    return (np.array([int.from_bytes(md5(k.encode()).digest()[:7]) >> 4 for k in keys], np.float64) + 0.5) / float(2**52)


def log_gamma_draws(shape: np.ndarray, keys: list[str]) -> np.ndarray:
    """log_gamma_draw of each shape and key."""
    d, out, open_ = shape + (1.0 - 1.0 / 3.0), np.full(len(shape), np.nan), np.arange(len(shape))
    for t in range(TRIES):
        if not len(open_):
            break
        u = [uniforms([f"{keys[i]}|{t}|{part}" for i in open_.tolist()]) for part in range(3)]
        x, own = np.sqrt(-2.0 * np.log(u[0])) * np.cos(2 * math.pi * u[1]), d[open_]
        v = (1.0 + x / np.sqrt(9.0 * own)) ** 3
        ok = v > 0
        ok[ok] = (np.log(u[2]) < 0.5 * x * x + own - own * v + own * np.log(np.where(ok, v, 1.0)))[ok]
        out[open_[ok]] = np.log(own[ok] * v[ok])
        open_ = open_[~ok]
    if len(open_):
        raise ValueError("no try of a gamma draw passed")
    return out + np.log(uniforms([f"{k}|low" for k in keys])) / shape


def log_dirichlet_draws(conc: np.ndarray, keys: list[str]) -> np.ndarray:
    """log_dirichlet_draw of each row of conc and its key."""
    logs = log_gamma_draws(conc.ravel(), [f"{k}|{i}" for k in keys for i in range(conc.shape[1])]).reshape(conc.shape)
    top = logs.max(axis=1, keepdims=True)
    return logs - (np.log(np.exp(logs - top).sum(axis=1, keepdims=True)) + top)
