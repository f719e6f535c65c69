"""Fit a model to a count table and evaluate it, from a configuration file.

python -m seqloom.plans.fit net|ref CONFIG.cfg

Sections and keys of the file (fixed values): general (out_folder, seed, precision), data (files_path, start_token, sparse, num_ds, alphabet, train_column, test_column,
reference_column), hyperp (lag), train (train, epochs, batch_size, optimizer_name, learning_rate, train_ar, accumulation_steps, restart, restart_path, state_steps),
test (test, train_test, van_reg), model (ar_func_name, af_kwargs). Values are JSON where they can be. The out folder gets the parameters, the
loss of each step and the results, each as a Parquet table, and the state of the run every state_steps steps (50); a run that was stopped, started again with
the same folder (a name with a star at its end), goes on from there.
"""

from __future__ import annotations

import argparse
import datetime
import hashlib
import json
from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from seqloom.functions import symbols
from seqloom.operators import cells, training
from seqloom.sources import files
from seqloom.sources.shared import dropped, kept

@dataclass
class Trained:
    """A trained model: what scores, evaluation and generation need of it."""

    name: str
    lag: int
    params: dict
    ref_group: int | None = None
    alphabet: str = "dna"

    @property
    def h(self) -> float:
        return float(np.exp(self.params["log_h"][0]))

    def predict(self, rows: DataFrame) -> DataFrame:
        return training.predicted(rows, self.params, self.name, self.ref_group, self.alphabet)


def batches_of(n_rows: int, batch_size: float) -> int:
    """Batches to an epoch; a batch size of 1 or less is a share of the rows."""
    size = max(1, int(n_rows * batch_size if batch_size <= 1 else batch_size))
    return max(1, -(-n_rows // size))


def steps_of(epochs: int | str, n_batches: int) -> int:
    """Steps in all; epochs with the suffix s are steps."""
    said = str(epochs)
    return int(said[:-1]) if said.endswith("s") else int(said) * n_batches


def alphabet_of(data: dict) -> str:
    name = str(data.get("alphabet", "dna"))
    if name not in symbols.ALPHABETS:
        raise ValueError(f"there is no alphabet {name}; there are {', '.join(symbols.ALPHABETS)}")
    return name


def read_table(spark: SparkSession, data: dict) -> DataFrame:
    path = files.discovered(data["files_path"], data.get("start_token", ""))
    return files.read_cells(spark, path, int(data["num_ds"]), alphabet_of(data), bool(data.get("sparse")))


def fit(table: DataFrame, cfg: dict, reference: bool, state: str | None = None) -> tuple[Trained, list[float]]:
    """The trained model and the loss of each step; without training the restarted parameters. state: a folder for the state of the run (see training.train)."""
    spark, train, data = table.sparkSession, cfg["train"], cfg["data"]
    lag, name, alphabet = int(cfg["hyperp"]["lag"]), cfg["model"]["ar_func_name"], alphabet_of(data)
    ref = int(data["reference_column"]) if reference else None
    start = training.load(spark, f"{train['restart_path']}/params") if train.get("restart") else None
    if not train.get("train", True):
        if start is None:
            raise ValueError("without training there must be parameters to restart from")
        return Trained(name, lag, start, ref, alphabet), []
    n_batches = batches_of(table.count(), float(train["batch_size"]))
    params, losses = training.train(
        table, name, lag, group=int(data["train_column"]), ref_group=ref, steps=steps_of(train["epochs"], n_batches), batches=n_batches, rate=float(train["learning_rate"]),
        optimizer=train["optimizer_name"], alone=bool(train["train_ar"]), accumulate=int(train.get("accumulation_steps", 1)), start=start, seed=int(cfg["general"].get("seed", 0)),
        kwargs=cfg["model"].get("af_kwargs") or {}, alphabet=alphabet, precision=int(cfg["general"].get("precision", 64)), state=state, every=int(train.get("state_steps", 50)),
    )
    return Trained(name, lag, params, ref, alphabet), losses


def metrics(table: DataFrame, model: Trained, test: int, given: int | None, alphas: list[float]) -> DataFrame:
    """(model, param, loglik, total, correct, perplexity, accuracy) of group `test`, conditioned on group `given` if there is one:
    the autoregressive model alone (ar), the mean of a Dirichlet (dm, param h) and the plain Bayesian Markov model (bmm, param alpha)."""
    probs = F.array(*[F.col(f"f{i}") for i in range(cells.width(model.alphabet))])
    own = cells.evaluation(model.predict(table), probs, [model.h], test, given).withColumnRenamed("h", "param")
    bmm = cells.bmm_loglik(table, [test], alphas, given)
    bmm = bmm.select(F.lit("bmm").alias("model"), F.col("alpha").alias("param"), "loglik", "total", "correct", F.exp(-F.col("loglik") / F.col("total")).alias("perplexity"), (F.col("correct") / F.col("total")).alias("accuracy"))
    return own.unionByName(bmm)


def fit_and_evaluate(table: DataFrame, cfg: dict, reference: bool = False, state: str | None = None) -> tuple[Trained, list[float], DataFrame]:
    """The model, its losses and the results (of, metric, model, param, value): of is heldout, train or model."""
    model, losses = fit(table, cfg, reference, state)
    data, test = cfg["data"], cfg["test"]
    alphas = [float(a) for a in test.get("van_reg", [0.1, 1.0, 10.0])]
    parts = []
    if test.get("test"):
        parts.append(metrics(table, model, int(data["test_column"]), int(data["train_column"]), alphas).withColumn("of", F.lit("heldout")))
    if test.get("train_test"):
        parts.append(metrics(table, model, int(data["train_column"]), None, alphas).withColumn("of", F.lit("train")))
    rows = [("model", "h", "dm", 0.0, model.h)]
    if reference:
        tau, nu = (float(np.exp(np.ravel(model.params[k])[0])) for k in ("log_tau", "log_nu"))
        rows += [("model", "error_rate", "ar", 0.0, 1 - float(np.exp(-tau))), ("model", "stop_rate", "ar", 0.0, (1 + nu) / nu)]
    out = table.sparkSession.createDataFrame(rows, "of string, metric string, model string, param double, value double")
    for p in parts:
        values = F.array(*[F.struct(F.lit(m).alias("metric"), F.col(m).alias("value")) for m in ("loglik", "perplexity", "accuracy")])
        out = out.unionByName(p.select("of", "model", "param", F.inline(values)))
    return model, losses, out


def run(spark: SparkSession, path: str, reference: bool) -> str:
    """Runs a configuration file; the folder with what it gave. A folder name with a star at its end is taken as it is, others get one for the time."""
    cfg = files.config(path)
    folder = str(cfg["general"]["out_folder"])
    folder = folder[:-1] if folder.endswith("*") else f"{folder}/logs/{datetime.datetime.now():%Y%m%d-%H%M%S}"
    table = kept(read_table(spark, cfg["data"]), "counts")
    state = f"{folder}/state-{hashlib.md5(json.dumps(cfg, sort_keys=True, default=str).encode()).hexdigest()}"  # of this very configuration
    model, losses, results = fit_and_evaluate(table, cfg, reference, state)
    training.save(spark, model.params, f"{folder}/params")
    spark.createDataFrame([(k, float(x)) for k, x in enumerate(losses)], "step int, loss double").write.mode("overwrite").parquet(f"{folder}/losses")
    results.write.mode("overwrite").parquet(f"{folder}/results")
    said = [(s, k, str(v)) for s, values in cfg.items() for k, v in values.items()] + [("results", "reference", str(reference))]
    spark.createDataFrame(said, "section string, name string, value string").write.mode("overwrite").parquet(f"{folder}/config")
    dropped(spark, state)  # the run is whole; another one begins anew
    return folder


def load(spark: SparkSession, folder: str) -> Trained:
    """The trained model in a folder that run() made."""
    said = {(r["section"], r["name"]): r["value"] for r in spark.read.parquet(f"{folder}/config").collect()}
    ref = int(said["data", "reference_column"]) if said["results", "reference"] == "True" else None
    return Trained(said["model", "ar_func_name"], int(said["hyperp", "lag"]), training.load(spark, f"{folder}/params"), ref, said.get(("data", "alphabet"), "dna"))


def main() -> None:
    p = argparse.ArgumentParser()
    p.add_argument("kind", choices=["net", "ref"], help="an autoregressive network alone, or mixed with a mutated reference")
    p.add_argument("config")
    a = p.parse_args()
    print(run(SparkSession.builder.getOrCreate(), a.config, a.kind == "ref"))


if __name__ == "__main__":
    main()
