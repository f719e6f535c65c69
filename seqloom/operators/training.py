"""Training of autoregressive models (linear, convolutional, reference) alone or as the mean of a Dirichlet, for any alphabet.

The table is written once, by batch, in the order of its contexts; a step reads the files of its batch and no others. The linear model's gradients are
sums by place and letter of expressions over the contexts, one Spark aggregate without Python; other models give a row of partial gradients per
partition from mapInPandas, added up in the partitions' order. The sums go to an optimizer in numpy on the driver.

With a state folder, the step, the parameters, what the optimizer holds and the losses are written every few steps, and a run that finds
such a state goes on from it: its parameters are those of a run that was not stopped. Sums of an aggregate depend on the order of its tasks in their last
bits, so reruns of the linear model agree to some 12 digits; the others agree wholly. Parameters are a dict of arrays and can be stored as a Parquet table.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from seqloom.functions import numeric as N
from seqloom.functions import symbols as S
from seqloom.operators import cells
from seqloom.sources.shared import dropped, scratch

EPSILON = 1e-7


def one_hot(kmers, alphabet: str = "dna") -> np.ndarray:
    """(rows, lag, letters and start); a symbol outside the alphabet has no place."""
    symbols = S.ALPHABETS[alphabet] + S.START
    eye, place = np.vstack([np.eye(len(symbols)), np.zeros(len(symbols))]), np.full(128, len(symbols))
    place[list(symbols.encode())] = np.arange(len(symbols))
    kmers = list(kmers)
    codes = np.frombuffer("".join(kmers).encode("ascii", "replace"), np.uint8).reshape(len(kmers), -1)
    return eye[place[codes]]


def softmax(z: np.ndarray) -> np.ndarray:
    e = np.exp(z - z.max(axis=1, keepdims=True))
    return e / e.sum(axis=1, keepdims=True)


def digamma(x: np.ndarray) -> np.ndarray:
    """By recurrence to x + 6 and its asymptotic series."""
    x, out = np.asarray(x, float).copy(), 0.0
    for _ in range(6):
        out = out - 1 / x
        x = x + 1
    w = 1 / (x * x)
    return out + np.log(x) - 0.5 / x - w * (1 / 12 - w * (1 / 120 - w * (1 / 252 - w * (1 / 240 - w / 132))))


def lgamma(x: np.ndarray) -> np.ndarray:
    x = np.asarray(x, float)
    z = x + 8
    w = 1 / (z * z)
    shift = np.log(x * (x + 1) * (x + 2) * (x + 3)) + np.log((x + 4) * (x + 5) * (x + 6) * (x + 7))
    return (z - 0.5) * np.log(z) - z + 0.9189385332046727 + (1 / 12 - w * (1 / 360 - w * (1 / 1260 - w / 1680))) / z - shift


class Linear:
    """softmax of the sum of a row of weights for each place and letter."""

    @staticmethod
    def start(lag: int, rng: np.random.Generator, letters: int = 5) -> dict[str, np.ndarray]:
        w = rng.normal(size=(lag, letters, letters))
        return {"w": 0.05 * w / np.sqrt((w * w).sum(axis=1, keepdims=True))}

    @staticmethod
    def forward(p, x):
        f = softmax(np.einsum("rjl,jlo->ro", x, p["w"]))
        return f, (x, f)

    @staticmethod
    def backward(p, held, df):
        x, f = held
        dz = f * (df - (f * df).sum(axis=1, keepdims=True))
        return {"w": np.einsum("rjl,ro->jlo", x, dz)}


def elu(x: np.ndarray) -> np.ndarray:
    return np.where(x > 0, x, np.expm1(np.minimum(x, 0)))


def elu_slope(x: np.ndarray) -> np.ndarray:
    return np.where(x > 0, 1, np.exp(np.minimum(x, 0)))


def normalized(x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Mean 0 and variance 1 over the last axis, and the spread that it was divided by."""
    spread = np.sqrt(x.var(axis=-1, keepdims=True) + 1e-5)
    return (x - x.mean(axis=-1, keepdims=True)) / spread, spread


def normalized_back(dn: np.ndarray, n: np.ndarray, spread: np.ndarray) -> np.ndarray:
    return (dn - dn.mean(axis=-1, keepdims=True) - n * (dn * n).mean(axis=-1, keepdims=True)) / spread


class Convolutional:
    """Filters over places, a hidden layer and an output layer. Both inner layers are normalised over their last axis, scaled, shifted and go through elu."""

    @staticmethod
    def start(lag, rng, filter_width: float = 8, num_filters: float = 30, kmer_layer1_width: int = 16, letters: int = 5):
        width, filters, hidden = min(int(filter_width), lag), int(num_filters), int(kmer_layer1_width)
        places = lag - width + 1
        unit = lambda size, axis: (x := rng.normal(size=size)) / np.sqrt((x * x).sum(axis=axis, keepdims=True))
        return {
            "c": unit((width, letters, filters), (0, 1)), "cs": np.ones((places, filters)), "cb": np.ones((places, filters)),
            "h": unit((places, filters, hidden), 0), "hs": np.ones(hidden), "hb": np.ones(hidden), "o": 0.05 * unit((hidden, letters), 0), "ob": np.zeros(letters),
        }

    @staticmethod
    def forward(p, x):
        width = p["c"].shape[0]
        spans = np.stack([x[:, j : j + width] for j in range(x.shape[1] - width + 1)], axis=1)
        n0, s0 = normalized(np.einsum("rjwl,wlf->rjf", spans, p["c"]))
        a = p["cs"] * n0 + p["cb"]
        n1, s1 = normalized(np.einsum("rjf,jfk->rk", elu(a), p["h"]))
        b = p["hs"] * n1 + p["hb"]
        f = softmax(elu(b) @ p["o"] + p["ob"])
        return f, (spans, n0, s0, a, n1, s1, b, f)

    @staticmethod
    def backward(p, held, df):
        spans, n0, s0, a, n1, s1, b, f = held
        dz = f * (df - (f * df).sum(axis=1, keepdims=True))
        db = (dz @ p["o"].T) * elu_slope(b)
        dh = normalized_back(db * p["hs"], n1, s1)
        da = np.einsum("rk,jfk->rjf", dh, p["h"]) * elu_slope(a)
        dc = normalized_back(da * p["cs"], n0, s0)
        return {
            "o": elu(b).T @ dz, "ob": dz.sum(axis=0), "hs": (db * n1).sum(axis=0), "hb": db.sum(axis=0), "h": np.einsum("rjf,rk->jfk", elu(a), dh),
            "cs": (da * n0).sum(axis=0), "cb": da.sum(axis=0), "c": np.einsum("rjwl,rjf->wlf", spans, dc),
        }


class Stop:
    """Always the stop letter; no parameters."""

    start = staticmethod(lambda lag, rng, letters=5: {})
    forward = staticmethod(lambda p, x: (np.tile(np.eye(x.shape[2])[-1], (len(x), 1)), None))
    backward = staticmethod(lambda p, held, df: {})


#: Models by name; others may be added.
MODELS: dict[str, type] = {"linear": Linear, "cnn": Convolutional, "stop": Stop}


class Optimizer:
    """A step for every parameter. What a kind holds of each is in slots, by name and parameter, so that a state can be written and read."""

    def __init__(self, rate: float):
        self.rate, self.t, self.slots = rate, 0, {}

    def held(self, name: str, key: str, start=0.0) -> np.ndarray | float:
        return self.slots.get((name, key), start)

    def mixed(self, name: str, key: str, share: float, new: np.ndarray) -> np.ndarray:
        """The running mean of a slot with the new value's share, kept there."""
        self.slots[name, key] = (1 - share) * self.held(name, key) + share * new
        return self.slots[name, key]

    def step(self, params: dict, grads: dict) -> None:
        self.t += 1
        for k, g in grads.items():
            params[k] = params[k] - self.change(k, g)

    def change(self, k: str, g: np.ndarray) -> np.ndarray:
        raise NotImplementedError


class SGD(Optimizer):
    def change(self, k, g):
        return self.rate * g


class Adam(Optimizer):
    def change(self, k, g):
        m, v = self.mixed("m", k, 0.1, g), self.mixed("v", k, 0.001, g * g)
        return self.rate * (m / (1 - 0.9**self.t)) / (np.sqrt(v / (1 - 0.999**self.t)) + 1e-7)


class Nadam(Optimizer):
    """Adam with Nesterov's look ahead, whose first decay warms up."""

    def change(self, k, g):
        u = [0.9 * (1 - 0.5 * 0.96 ** (0.004 * (self.t + i))) for i in (0, 1)]
        done = self.held("u", k, 1.0) * u[0]
        self.slots["u", k] = np.asarray(done)
        m, v = self.mixed("m", k, 0.1, g), self.mixed("v", k, 0.001, g * g)
        ahead = u[1] * m / (1 - done * u[1]) + (1 - u[0]) * g / (1 - done)
        return self.rate * ahead / (np.sqrt(v / (1 - 0.999**self.t)) + 1e-7)


class Adamax(Optimizer):
    def change(self, k, g):
        m = self.mixed("m", k, 0.1, g)
        self.slots["most", k] = np.maximum(0.999 * self.held("most", k), np.abs(g))
        return self.rate / (1 - 0.9**self.t) * m / (self.slots["most", k] + 1e-7)


class RMSprop(Optimizer):
    def change(self, k, g):
        return self.rate * g / np.sqrt(self.mixed("v", k, 0.1, g * g) + 1e-7)


class Adagrad(Optimizer):
    def change(self, k, g):
        self.slots["sum", k] = self.held("sum", k, 0.1) + g * g
        return self.rate * g / np.sqrt(self.slots["sum", k] + 1e-7)


class Adadelta(Optimizer):
    def change(self, k, g):
        v = self.mixed("v", k, 0.05, g * g)
        by = g * np.sqrt(self.held("moved", k) + 1e-7) / np.sqrt(v + 1e-7)
        self.mixed("moved", k, 0.05, by * by)
        return self.rate * by


OPTIMIZERS: dict[str, Callable] = {o.__name__: o for o in (SGD, Adam, Nadam, Adamax, RMSprop, Adagrad, Adadelta)}


def reference_mix(p: dict, ref: np.ndarray, g: np.ndarray) -> tuple[np.ndarray, tuple]:
    """(nu g + mutated reference) / (nu + 1)."""
    tau, nu = np.exp(p["log_tau"]), np.exp(p["log_nu"])
    r = ref[:, :-1] + EPSILON
    r = r / r.sum(axis=1, keepdims=True)
    e = np.exp(-tau)
    u = 1 / r.shape[1]
    jc = np.concatenate([u + e * (r - u), np.zeros((len(r), 1))], axis=1)
    return (nu * g + jc) / (nu + 1), (tau, nu, r, e, jc, g)


def loglik_and_grads(p: dict, model, kmers, counts: np.ndarray, ref: np.ndarray | None, alone: bool, alphabet: str = "dna") -> tuple[float, dict]:
    """The log likelihood of counts and its gradients; alone: of the autoregressive model without a Dirichlet."""
    g, held = model.forward(p, one_hot(kmers, alphabet))
    f, mix = (g, None) if ref is None else reference_mix(p, ref, g)
    if alone:
        ll, df, grads = float((counts * np.log(f + EPSILON)).sum()), counts / (f + EPSILON), {"log_h": np.zeros(1)}
    else:
        h = float(np.exp(p["log_h"][0]))
        c = f / h + EPSILON
        total, n = c.sum(axis=1, keepdims=True), counts.sum(axis=1, keepdims=True)
        ll = float((lgamma(c + counts) - lgamma(c)).sum() - (lgamma(total + n) - lgamma(total)).sum())
        dc = digamma(c + counts) - digamma(c) - digamma(total + n) + digamma(total)
        df, grads = dc / h, {"log_h": np.array([-(dc * f / h).sum()])}
    if mix is not None:
        tau, nu, r, e, jc, g = mix
        grads["log_tau"] = np.array([-(df[:, :-1] * (r - 1 / r.shape[1])).sum() * tau * e / (nu + 1)]).reshape(p["log_tau"].shape)
        grads["log_nu"] = np.array([(df * (g - jc)).sum() * nu / (nu + 1) ** 2]).reshape(p["log_nu"].shape)
        df = df * nu / (nu + 1)
    return ll, grads | model.backward(p, held, df)


def added(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """One row of sums of partial log likelihoods and gradients."""
    total = None
    for b in frames:
        for ll, rows, grad in zip(b["ll"], b["rows"], b["grad"], strict=True):
            total = (ll, rows, np.asarray(grad)) if total is None else (total[0] + ll, total[1] + rows, total[2] + grad)
    if total is not None:
        yield pd.DataFrame({"ll": [total[0]], "rows": [total[1]], "grad": [total[2]]})


def predicted(rows: DataFrame, params: dict, model: str, ref_group: int | None = None, alphabet: str = "dna") -> DataFrame:
    """Adds a trained model's letter probabilities f0.. to rows with kmer, and with the reference's counts if it has one."""
    make, names, columns = MODELS[model], [f"f{i}" for i in range(cells.width(alphabet))], rows.columns
    src = rows.withColumn("_ref", cells.counts(rows, ref_group).cast("array<double>")) if ref_group is not None else rows

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if b.num_rows:
                f, _ = make.forward(params, one_hot(b.column("kmer").to_pylist(), alphabet))
                if ref_group is not None:
                    f, _ = reference_mix(params, b.column("_ref").flatten().to_numpy(zero_copy_only=False).reshape(b.num_rows, -1), f)
                own = b.columns[:-1] if ref_group is not None else b.columns
                yield pa.RecordBatch.from_arrays([*own, *(pa.array(np.ascontiguousarray(c)) for c in f.T)], [*columns, *names])

    return src.mapInArrow(run, T.StructType([*rows.schema.fields, *(T.StructField(c, T.DoubleType()) for c in names)]))


def linear_rows(rows: DataFrame, p: dict, alone: bool, alphabet: str = "dna") -> DataFrame:
    """(place, letter, v) of rows (kmer, n array): sums of v by place and letter are the linear model's gradients, an entry per output letter.

    The row of place -1 has the log likelihood, the gradient of log h and the number of contexts.
    """
    letters = cells.width(alphabet)
    add = lambda a: F.aggregate(a, F.lit(0.0), lambda t, x: t + x)
    at = rows.select("kmer", "n", cells.linear(F.col("kmer"), p["w"].tolist(), alphabet).alias("f"))
    if alone:
        at = at.select("kmer", "f", F.zip_with("n", "f", lambda n, f: n / (f + EPSILON)).alias("df"), N.multinomial_logprob_of(F.transform("f", lambda f: f + EPSILON), F.col("n")).alias("ll"), F.lit(0.0).alias("gh"))
    else:
        h = float(np.exp(p["log_h"][0]))
        at = at.select("kmer", "n", "f", F.transform("f", lambda f: f / h + EPSILON).alias("c"))
        sums = at.select("*", add("c").alias("tc"), add("n").alias("tn"))
        slopes = sums.select("*", (N.digamma(F.col("tc") + F.col("tn")) - N.digamma(F.col("tc"))).alias("whole"), N.dm_logprob_of(F.col("c"), F.col("n")).alias("ll"))
        each = F.zip_with("c", "n", lambda c, n: F.when(n == 0, F.lit(0.0)).otherwise(N.digamma(c + n) - N.digamma(c)))
        slopes = slopes.select("kmer", "f", "ll", F.transform(F.zip_with(each, F.array_repeat("whole", letters), lambda x, w: x - w), lambda x: x / h).alias("df"))
        at = slopes.select("kmer", "f", "df", "ll", (-add(F.zip_with("df", "f", lambda d, f: d * f))).alias("gh"))
    mean = at.select("*", add(F.zip_with("f", "df", lambda f, d: f * d)).alias("mean"))
    dz = mean.select("kmer", "ll", "gh", F.zip_with("f", F.zip_with("df", F.array_repeat("mean", letters), lambda d, m: d - m), lambda f, d: f * d).alias("dz"))
    lag = len(p["w"])
    own = F.transform(F.sequence(F.lit(0), F.lit(lag - 1)), lambda j: F.struct(j.alias("place"), F.substring(F.col("kmer"), j + 1, F.lit(1)).alias("letter"), F.col("dz").alias("v")))
    whole = F.struct(F.lit(-1).alias("place"), F.lit("").alias("letter"), F.concat(F.array("ll", "gh", F.lit(1.0)), F.array_repeat(F.lit(0.0), letters - 3)).alias("v"))
    return dz.select(F.inline(F.concat(own, F.array(whole))))


def linear_gradients(rows: DataFrame, p: dict, alone: bool, alphabet: str = "dna") -> tuple[float, dict, int]:
    """(log likelihood, gradients, contexts) of the linear model: one aggregate, a row per place and letter for the driver."""
    letters = cells.width(alphabet)
    sums = linear_rows(rows, p, alone, alphabet).groupBy("place", "letter").agg(*[F.sum(F.col("v")[i]).alias(f"v{i}") for i in range(letters)])
    symbols, w, whole = S.ALPHABETS[alphabet] + S.START, np.zeros_like(p["w"]), [0.0, 0.0, 0.0]
    for r in sums.collect():
        v = [r[f"v{i}"] for i in range(letters)]
        if r["place"] < 0:
            whole = v
        else:
            w[r["place"], symbols.index(r["letter"])] = v
    return whole[0], {"w": w, "log_h": np.array([whole[1]])}, int(whole[2])


def laid_out(table: DataFrame, group: int, ref_group: int | None, batches: int) -> tuple[DataFrame, str]:
    """(kmer, n, r, part) written by batch, a folder each, in the order of the contexts; the frame and its path."""
    spark = table.sparkSession
    digest = F.conv(F.substring(F.md5("kmer"), 1, 8), 16, 10).cast("bigint")
    src = table.select("kmer", cells.counts(table, group).cast("array<double>").alias("n"), cells.counts(table, ref_group if ref_group is not None else group).cast("array<double>").alias("r"), F.pmod(digest, F.lit(batches)).cast("int").alias("part"))
    tasks = max(int(spark.conf.get("spark.sql.shuffle.partitions")), 1)
    files = -(-tasks // batches)  # of each batch
    path = scratch(spark, "batches")
    src.repartition(max(tasks, 1), "part", F.pmod(F.xxhash64("kmer"), F.lit(files))).sortWithinPartitions("part", "kmer").write.partitionBy("part").parquet(path)
    return spark.read.schema(src.schema).parquet(path), path


def numpy_gradients(rows: DataFrame, p: dict, make, reference: bool, alone: bool, alphabet: str) -> tuple[float, dict, int]:
    """The same of any model, by a row of partial sums per partition; many partitions are added up by fewer tasks first."""
    names, now = sorted(p), dict(p)

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total, n_rows, sums = 0.0, 0, {k: np.zeros_like(v) for k, v in now.items()}
        for b in frames:
            if len(b):
                ll, grads = loglik_and_grads(now, make, b["kmer"], np.stack(b["n"]), np.stack(b["r"]) if reference else None, alone, alphabet)
                total, n_rows = total + ll, n_rows + len(b)
                for k, g in grads.items():
                    sums[k] = sums[k] + g
        yield pd.DataFrame({"ll": [total], "rows": [n_rows], "grad": [np.concatenate([np.ravel(sums[k]) for k in names])]})

    n_parts = rows.rdd.getNumPartitions()
    sums = rows.mapInPandas(run, "ll double, rows bigint, grad array<double>")
    if n_parts > 64:
        sums = sums.coalesce(int(n_parts**0.5)).mapInPandas(added, sums.schema)
    got = sums.toPandas()
    flat, at, grads = np.sum(np.stack(got["grad"]), axis=0), 0, {}
    for k in names:
        grads[k] = flat[at : at + p[k].size].reshape(p[k].shape)
        at += p[k].size
    return float(got["ll"].sum()), grads, int(got["rows"].sum())


def train(
    table: DataFrame, model: str, lag: int, *, group: int = 0, ref_group: int | None = None, steps: int = 20, batches: int = 1, rate: float = 0.01, optimizer: str = "Adam", alone: bool = False,
    accumulate: int = 1, start: dict | None = None, seed: int = 0, kwargs: dict | None = None, alphabet: str = "dna", precision: int = 64, state: str | None = None, every: int = 50,
) -> tuple[dict, list[float]]:
    """The parameters and the loss at each step, for a table in either form.

    start: parameters to begin with; kwargs: of the model's start; precision: bits that parameters are rounded to after each step. state: a folder that
    gets the state every `every` steps and at the end; if it has one, the run goes on from there, up to `steps` in all.
    """
    if optimizer not in OPTIMIZERS:
        raise ValueError(f"there is no optimizer {optimizer}; there are {', '.join(OPTIMIZERS)}")
    spark, make, kind = table.sparkSession, MODELS[model], {32: np.float32, 64: np.float64}[precision]
    p = dict(start) if start else {"log_h": np.zeros(1)} | make.start(lag, np.random.default_rng(seed), letters=cells.width(alphabet), **(kwargs or {}))
    if ref_group is not None and "log_tau" not in p:
        p |= {"log_tau": np.log(np.array([1 / 30])), "log_nu": np.log(np.array([1 / 100]))}
    opt, losses, held, done = OPTIMIZERS[optimizer](rate), [], None, 0
    if state and (found := load_state(spark, state)):
        p, opt.slots, opt.t, held, losses, done = found
    if done >= steps:
        return p, losses
    src, path = laid_out(table, group, ref_group, batches)
    try:
        rows_all = src.count()
        for step in range(done, steps):
            own = src.filter(F.col("part") == step % batches)
            if make is Linear and ref_group is None:
                ll, grads, n_rows = linear_gradients(own, p, alone, alphabet)
            else:
                ll, grads, n_rows = numpy_gradients(own, p, make, ref_group is not None, alone, alphabet)
            scale = rows_all / max(n_rows, 1)
            losses.append(-scale * ll)
            held = {k: (held[k] if held else 0) - scale * grads[k] for k in p}
            if (step + 1) % accumulate == 0:
                opt.step(p, held)
                p, held = {k: np.asarray(v, kind).astype(float) for k, v in p.items()}, None
            if state and ((step + 1) % every == 0 or step + 1 == steps):
                save_state(spark, state, p, opt, held, losses, step + 1)
    finally:
        dropped(spark, path)
    return p, losses


def save_state(spark: SparkSession, path: str, params: dict, opt: Optimizer, held: dict | None, losses: list[float], done: int) -> None:
    """One file for the step: it is there whole or not at all. The step before stays until this one is written; earlier ones go."""
    rows = [("param", k, "", v) for k, v in params.items()] + [("slot", k, name, v) for (name, k), v in opt.slots.items()] + [("held", k, "", v) for k, v in (held or {}).items()]
    rows += [("loss", "", "", np.array(losses)), ("t", "", "", np.array([float(opt.t)]))]
    said = [(kind, k, name, [int(x) for x in np.shape(v)], [float(x) for x in np.ravel(v)]) for kind, k, name, v in rows]
    spark.createDataFrame(said, "kind string, name string, slot string, shape array<int>, values array<double>").coalesce(1).write.mode("overwrite").parquet(f"{path}/step={done}")
    for old in sorted({r["step"] for r in spark.read.parquet(path).select("step").distinct().collect()})[:-2]:
        dropped(spark, f"{path}/step={old}")


def load_state(spark: SparkSession, path: str):
    """(params, slots, t, held, losses, step) of the last whole state in a folder; None if there is none."""
    try:
        src = spark.read.parquet(path)
        last = src.agg(F.max("step")).first()[0]
    except AnalysisException:
        return None
    if last is None:
        return None
    by = {(r["kind"], r["name"], r["slot"]): np.array(r["values"]).reshape(r["shape"]) for r in src.filter(F.col("step") == last).collect()}
    of = lambda kind: {k: v for (x, k, _), v in by.items() if x == kind}
    slots = {(slot, k): v for (x, k, slot), v in by.items() if x == "slot"}
    return of("param"), slots, int(by["t", "", ""][0]), of("held") or None, list(map(float, by["loss", "", ""])), int(last)


def save(spark: SparkSession, params: dict, path: str) -> None:
    rows = [(k, [int(x) for x in v.shape], [float(x) for x in np.ravel(v)]) for k, v in params.items()]
    spark.createDataFrame(rows, "name string, shape array<int>, values array<double>").write.mode("overwrite").parquet(path)


def load(spark: SparkSession, path: str) -> dict:
    return {r["name"]: np.array(r["values"]).reshape(r["shape"]) for r in spark.read.parquet(path).collect()}
