"""Mini-batches that read only themselves, runs that go on where they were stopped, optimizers by name."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from seqloom.operators import counting, training
from seqloom.plans import fit
from seqloom.sources import files
from seqloom.sources.shared import dropped


@pytest.fixture(scope="module")
def table(spark):
    rng = np.random.default_rng(2)
    reads = spark.createDataFrame([(k % 3, "".join(rng.choice(list("ACGT"), 60, p=[0.5, 0.2, 0.2, 0.1]))) for k in range(30)], "grp int, seq string")
    return counting.wide(counting.count_long(reads, 3), 3).cache()


def scanned(df):
    """Rows that the scans of a frame's plan gave when it was collected."""
    rows = df.collect()

    def of(node):
        own = node.metrics().get("numOutputRows").get().value() if node.nodeName().startswith("Scan") else 0
        children = node.children()
        return own + sum(of(children.apply(k)) for k in range(children.size()))

    plan = df._jdf.queryExecution().executedPlan()
    return len(rows), of(plan)


def test_a_batch_reads_only_itself(spark, table):
    laid, path = training.laid_out(table, 0, 2, 5)
    n = table.count()
    each = [scanned(laid.filter(F.col("part") == k)) for k in range(5)]
    assert sum(a for a, _ in each) == n and all(a == b for a, b in each)  # an epoch reads each row once
    assert all(a > 0 for a, _ in each)
    kmers = [r["kmer"] for r in laid.filter("part = 1").collect()]
    assert len(set(kmers)) == len(kmers)
    dropped(spark, path)


@pytest.mark.parametrize(("name", "kwargs", "optimizer"), [("linear", {}, "Adam"), ("cnn", {"filter_width": 2, "num_filters": 4, "kmer_layer1_width": 3}, "Nadam"), ("stop", {}, "RMSprop")])
def test_stopped_runs_go_on(spark, table, tmp_path, monkeypatch, name, kwargs, optimizer):
    said = dict(ref_group=2 if name == "stop" else None, batches=3, rate=0.05, optimizer=optimizer, accumulate=2, kwargs=kwargs, seed=4)
    whole, losses = training.train(table, name, 3, steps=9, **said)
    write, state = training.save_state, str(tmp_path / "state")

    def failing(*a):
        if a[-1] >= 6:
            raise RuntimeError("killed")
        write(*a)

    monkeypatch.setattr(training, "save_state", failing)
    with pytest.raises(RuntimeError, match="killed"):  # after step 6; the state is that of step 3, between two accumulated steps
        training.train(table, name, 3, steps=9, state=state, every=3, **said)
    monkeypatch.setattr(training, "save_state", write)
    assert training.load_state(spark, state)[-1] == 3 and training.load_state(spark, state)[3] is not None
    again, more = training.train(table, name, 3, steps=9, state=state, every=3, **said)
    assert more == pytest.approx(losses, rel=1e-12) and len(more) == 9
    assert set(again) == set(whole) and all(np.allclose(again[k], whole[k], rtol=1e-10, atol=1e-12) for k in whole)
    assert training.train(table, name, 3, steps=9, state=state, **said)[1] == more  # nothing is left to do
    assert training.load_state(spark, str(tmp_path / "none")) is None


def test_a_stopped_run_of_a_file_goes_on(spark, table, tmp_path, monkeypatch):
    files.write_dense(table, str(tmp_path / "data" / "part"), 3)
    text = f"""
[general]
out_folder = {tmp_path}/{{out}}*
seed = 3
[data]
files_path = {tmp_path}/data
num_ds = 3
alphabet = dna
train_column = 0
test_column = 1
reference_column = 2
[hyperp]
lag = 3
[train]
epochs = 6
batch_size = 1
optimizer_name = Adam
learning_rate = 0.05
train_ar = False
state_steps = 2
[test]
test = True
[model]
ar_func_name = cnn
af_kwargs = {{{{"filter_width": 2, "num_filters": 4}}}}
"""
    results = {}
    for out in ("whole", "stopped"):
        (tmp_path / f"{out}.cfg").write_text(text.format(out=out))
    write, calls = training.save_state, []

    def failing(*a):
        write(*a)
        calls.append(a[-1])
        if a[-1] == 4:
            raise RuntimeError("killed")

    monkeypatch.setattr(training, "save_state", failing)
    with pytest.raises(RuntimeError, match="killed"):
        fit.run(spark, str(tmp_path / "stopped.cfg"), False)
    monkeypatch.setattr(training, "save_state", lambda *a: (calls.append(a[-1]), write(*a)))
    for out in ("stopped", "whole"):
        folder = fit.run(spark, str(tmp_path / f"{out}.cfg"), False)
        results[out] = [r["loss"] for r in spark.read.parquet(f"{folder}/losses").orderBy("step").collect()]
        assert not list((tmp_path / out).glob("state*"))  # a whole run leaves no state
    assert calls == [2, 4, 6, 2, 4, 6] and results["stopped"] == results["whole"] and len(results["whole"]) == 6


def test_accumulated_steps_are_one_step_of_the_whole(table):
    """Two half batches, accumulated at the same parameters, move them as one step on the sum of their gradients would."""
    one, _ = training.train(table, "linear", 3, steps=1, rate=0.1, optimizer="SGD", alone=True)
    start, _ = training.train(table, "linear", 3, steps=0)
    two, _ = training.train(table, "linear", 3, steps=2, batches=2, accumulate=2, rate=0.1, optimizer="SGD", alone=True)
    n = table.count()
    laid, _ = training.laid_out(table, 0, None, 2)
    moved = 0
    for k in range(2):
        own = laid.filter(F.col("part") == k)
        _, grads, rows = training.linear_gradients(own, start, True)
        moved = moved + 0.1 * n / rows * grads["w"]
    assert np.allclose(two["w"], start["w"] + moved)
    assert not np.allclose(one["w"], start["w"])


@pytest.mark.parametrize("optimizer", sorted(training.OPTIMIZERS))
def test_optimizers(table, optimizer):
    rate = {"SGD": 1e-4, "Adadelta": 5.0, "Adagrad": 0.1}.get(optimizer, 0.02)
    _, losses = training.train(table, "linear", 3, steps=6, rate=rate, optimizer=optimizer, alone=True)
    assert losses[-1] < losses[0]


def test_no_such_optimizer(table):
    with pytest.raises(ValueError, match="no optimizer"):
        training.train(table, "linear", 3, steps=1, optimizer="Guess")


def test_reruns_agree_whatever_the_partitions(table):
    for name, kwargs in (("cnn", {"filter_width": 2, "num_filters": 4}), ("stop", {})):
        runs = [training.train(t, name, 3, steps=3, ref_group=2 if name == "stop" else None, kwargs=kwargs) for t in (table, table.repartition(7))]
        assert runs[0][1] == runs[1][1] and all((runs[0][0][k] == runs[1][0][k]).all() for k in runs[0][0])
