"""Gradients against differences, whole runs from a configuration file, and scores and sequences under trained models."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from seqloom.functions import symbols as S
from seqloom.operators import counting, sampling, scoring, training
from seqloom.plans import fit
from seqloom.sources import files

SEQS = ["TTTAT", "TTCTT", "TTTTT", "TTTTT", "ACGTACGTAGCTA", "GGGATTC", "CATCATCATG", "ACCA"]


@pytest.fixture(scope="module")
def table(spark):
    reads = spark.createDataFrame([(k, k % 3, s) for k, s in enumerate(SEQS)], "seq_id int, grp int, seq string")
    out = counting.wide(counting.count_long(reads, 3), 3).cache()
    yield out
    out.unpersist()


@pytest.mark.parametrize("alone", [True, False])
@pytest.mark.parametrize("reference", [True, False])
@pytest.mark.parametrize(("name", "kwargs"), [("linear", {}), ("cnn", {"filter_width": 2, "num_filters": 4, "kmer_layer1_width": 3}), ("stop", {})])
def test_gradients(name, kwargs, reference, alone):
    rng = np.random.default_rng(5)
    make, kmers = training.MODELS[name], ["ACG", "[[T", "GGA", "TTT", "[AC"]
    counts, ref = rng.integers(0, 4, (5, 5)).astype(float), rng.integers(0, 4, (5, 5)).astype(float) if reference else None
    p = {"log_h": np.array([0.3])} | make.start(3, rng, **kwargs)
    p = {k: v + 0.1 * rng.normal(size=v.shape) for k, v in p.items()}
    if reference:
        p |= {"log_tau": np.array([-1.0]), "log_nu": np.array([-0.5])}
    elif name == "stop" and alone:
        return  # nothing to learn
    _, grads = training.loglik_and_grads(p, make, kmers, counts, ref, alone)
    assert set(grads) == set(p)
    for k, v in p.items():
        for at in list(np.ndindex(v.shape))[:12]:
            ends = []
            for step in (1e-5, -1e-5):
                q = {x: y.copy() for x, y in p.items()}
                q[k][at] += step
                ends.append(training.loglik_and_grads(q, make, kmers, counts, ref, alone)[0])
            assert grads[k][at] == pytest.approx((ends[0] - ends[1]) / 2e-5, rel=2e-3, abs=2e-4), (k, at)


def test_network_has_normalised_layers():
    p = training.Convolutional.start(10, np.random.default_rng(0))
    assert {k: v.shape for k, v in p.items()} == {"c": (8, 5, 30), "cs": (3, 30), "cb": (3, 30), "h": (3, 30, 16), "hs": (16,), "hb": (16,), "o": (16, 5), "ob": (5,)}
    _, held = training.Convolutional.forward(p, training.one_hot(["ACGTACGTAC", "[[[[ACGTTT"]))
    for n in (held[1], held[4]):
        assert np.allclose(n.mean(axis=-1), 0, atol=1e-9) and np.allclose(n.var(axis=-1), 1, atol=1e-2)


def test_sums_by_fewer_tasks_are_the_same(spark, table):
    few = training.train(table.coalesce(1), "linear", 3, steps=4, rate=0.1)
    many = training.train(table.repartition(70), "linear", 3, steps=4, rate=0.1)
    assert few[1] == pytest.approx(many[1]) and few[1][-1] < few[1][0]


@pytest.mark.parametrize(("size", "epochs", "want"), [(0.5, 3, (2, 6)), (25, "7s", (4, 7)), (1000, 2, (1, 2)), (1, 1, (1, 1))])
def test_batches_and_steps(size, epochs, want):
    n = fit.batches_of(100, size)
    assert (n, fit.steps_of(epochs, n)) == want


@pytest.mark.parametrize(("kind", "name"), [("net", "linear"), ("net", "cnn"), ("ref", "stop")])
def test_run_of_a_file(spark, table, tmp_path, kind, name):
    files.write_dense(table, str(tmp_path / "data" / "part"), 3)
    cfg = f"""
[general]
out_folder = {tmp_path}/out*
seed = 10
[data]
files_path = {tmp_path}/data
start_token = part
sparse = False
num_ds = 3
alphabet = dna
train_column = 0
test_column = 1
reference_column = 2
[hyperp]
lag = 3
[train]
train = True
epochs = 5
batch_size = 0.4
optimizer_name = Adam
learning_rate = 0.05
train_ar = False
accumulation_steps = 1
restart = False
[test]
test = True
train_test = True
van_reg = [0.1, 1.0, 10.0]
[model]
ar_func_name = {name}
af_kwargs = {{{'"num_filters": 5' if name == "cnn" else ""}}}
"""
    path = tmp_path / "run.cfg"
    path.write_text(cfg)
    folder = fit.run(spark, str(path), kind == "ref")
    got = {(r["of"], r["metric"], r["model"], r["param"] if r["model"] == "bmm" else 0.0): r["value"] for r in spark.read.parquet(f"{folder}/results").collect()}
    model = fit.load(spark, folder)
    rows = {r["kmer"]: r for r in model.predict(table).collect()}

    # by hand: each context's counts, the model's letters, and what they give
    def dm(conc, n):
        lg = lambda x: float(training.lgamma(np.array([x]))[0])
        return sum(lg(c + k) - lg(c) for c, k in zip(conc, n, strict=True) if k) + lg(sum(conc)) - lg(sum(conc) + sum(n)) if sum(n) else 0.0

    for of, grp, given in (("heldout", 1, 0), ("train", 0, None)):
        n = {k: [r[f"g{grp}_{i}"] for i in range(5)] for k, r in rows.items()}
        seen = {k: [r[f"g{given}_{i}"] if given is not None else 0 for i in range(5)] for k, r in rows.items()}
        f = {k: [r[f"f{i}"] for i in range(5)] for k, r in rows.items()}
        total = sum(map(sum, n.values()))
        ar = sum(x * np.log(p + 1e-7) for k in n for x, p in zip(n[k], f[k], strict=True) if x)
        assert got[of, "loglik", "ar", 0.0] == pytest.approx(ar) and got[of, "perplexity", "ar", 0.0] == pytest.approx(np.exp(-ar / total))
        ll = sum(dm([p / model.h + c + 1e-7 for p, c in zip(f[k], seen[k], strict=True)], n[k]) for k in n)
        assert got[of, "loglik", "dm", 0.0] == pytest.approx(ll, rel=1e-6)
        for a in (0.1, 1.0, 10.0):
            assert got[of, "loglik", "bmm", a] == pytest.approx(sum(dm([a + c for c in seen[k]], n[k]) for k in n), rel=1e-6)
        correct = sum(n[k][int(np.argmax(f[k]))] for k in n)
        assert got[of, "accuracy", "ar", 0.0] == pytest.approx(correct / total)
    assert got["model", "h", "dm", 0.0] == pytest.approx(model.h)
    if kind == "ref":
        tau, nu = np.exp(model.params["log_tau"][0]), np.exp(model.params["log_nu"][0])
        assert got["model", "error_rate", "ar", 0.0] == pytest.approx(1 - np.exp(-tau)) and got["model", "stop_rate", "ar", 0.0] == pytest.approx((1 + nu) / nu)
    # going on without training gives the same model
    again = files.config(str(path))
    again["train"] |= {"train": False, "restart": True, "restart_path": folder}
    assert fit.fit(table, again, kind == "ref")[0].h == model.h
    again["train"]["restart"] = False
    with pytest.raises(ValueError):
        fit.fit(table, again, kind == "ref")


def test_scores_under_a_trained_model(spark, table):
    """Each model's scores by hand: wild type TTTAT and its variants, a context's draws shared by its windows."""
    params, _ = training.train(table, "linear", 3, steps=3, rate=0.1)
    model = fit.Trained("linear", 3, params)
    wt = "TTTAT"
    variants = spark.createDataFrame([("A3T", wt), ("T2C", wt)], "var_id string, seq string").withColumn("v", scoring.parsed(F.col("var_id"))).select("var_id", "seq", "v.*")
    w = scoring.variant_windows(variants, 3).groupBy("var_id", "kmer", "nxt").agg(F.sum("sgn").alias("n"))
    conc = scoring.concentrations(w, table, 0, predict=model.predict, hs=[0.5, 2.0], alphas=[0.1])
    counts = {r["kmer"]: [r[f"g0_{i}"] for i in range(5)] for r in table.collect()}

    def logp(kmer, nxt, name, param):
        f = training.Linear.forward(params, training.one_hot([kmer]))[0][0] + 1e-7
        n = np.array(counts.get(kmer, [0] * 5), float)
        c = {"ar": f, "dm": f / param + n if name == "dm" else 0, "bmm": param + n}[name]
        return np.log(c / c.sum())["ACGT]".index(nxt)]

    def whole(seq, name, param):
        p = "[[[" + seq + "]"
        return sum(logp(p[k : k + 3], p[k + 3], name, param) for k in range(len(p) - 3))

    got = {(r["var_id"], r["model"], r["param"]): r["score"] for r in scoring.model_scores(w, conc, "var_id").collect()}
    assert len(got) == 2 * 4
    for (var, name, param), score in got.items():
        mutant = {"A3T": "TTTTT", "T2C": "TTCAT"}[var]
        assert score == pytest.approx(whole(mutant, name, param) - whole(wt, name, param), abs=1e-9)
    # the mean of many likelihoods under sampled models is the marginal likelihood
    seqs = spark.createDataFrame([(1, "TTTAT"), (2, "TTTTTTTT")], "seq_id int, seq string")
    own = counting.count_windows(seqs, 3, keep=("seq_id",))
    conc = scoring.concentrations(own, table, 0, predict=model.predict, hs=[0.5], alphas=[1.0], alone=False)
    exact = {(r["seq_id"], r["model"]): r["score"] for r in scoring.model_marginals(own, conc, "seq_id").collect()}
    drawn = scoring.model_samples(own, conc, "seq_id", 4000).groupBy("seq_id", "model").agg(F.avg(F.exp("score")).alias("p")).collect()
    for r in drawn:
        assert np.log(r["p"]) == pytest.approx(exact[r["seq_id"], r["model"]], abs=0.25)


def test_generated_on_both_sides(spark, table):
    params, _ = training.train(table, "linear", 3, steps=2, rate=0.1)
    seeds = spark.createDataFrame([(1, "ACGT", 12, 0), (2, "GGTTA", 0, 9), (3, "CATC", 5, 17)], "seed_id int, seq string, `left` int, `right` int")
    for kwargs in ({}, {"best": True}, {"predict": fit.Trained("linear", 3, params).predict, "h": 0.5}):
        rows = sampling.generated(seeds, table, 3, 0, samples=2, **kwargs).collect()
        assert len(rows) == 6
        for r in rows:
            seq, l, n = {1: ("ACGT", 12, 0), 2: ("GGTTA", 0, 9), 3: ("CATC", 5, 17)}[r["seed_id"]]
            assert len(r["seq"]) == l + len(seq) + n and r["seq"][l : l + len(seq)] == seq and set(r["seq"]) <= set("ACGT")
        again = sampling.generated(seeds, table.repartition(3), 3, 0, samples=2, **kwargs).collect()
        assert sorted(map(str, rows)) == sorted(map(str, again))
    assert sampling.generated(seeds, table, 3, 0, samples=1).collect()[0]["rep"] == 0
    # a certain next letter is taken on either side
    sure = counting.wide(counting.count_long(counting.both_strands(spark.createDataFrame([(0, "ACCA" * 200000)], "grp int, seq string").select("grp", F.col("seq"))), 3), 1)
    seq = sampling.generated(spark.createDataFrame([(1, "ACCA")], "seed_id int, seq string"), sure, 3, 0, left=4, right=4, best=True, alpha=1e-9).first()["seq"]
    assert seq[4:8] == "ACCA" and all(x in "ACCAACCAACCA" for x in (seq[:8], seq[4:]))


def test_long_sequences_in_blocks(spark, monkeypatch):
    """Windows of sequences around and over many blocks."""
    monkeypatch.setattr(counting, "BLOCK", 16)
    rng = np.random.default_rng(6)
    seqs = ["".join(rng.choice(list("ACGT"), n)) for n in (0, 1, 11, 12, 13, 14, 15, 16, 17, 31, 32, 33, 500)]
    reads = spark.createDataFrame([(k, 0, s) for k, s in enumerate(seqs)], "seq_id int, grp int, seq string")
    got = sorted((r["seq_id"], r["pos"], r["kmer"], r["nxt"]) for r in counting.windows(reads, 3, keep=("seq_id",)).collect())
    assert got == sorted((k, i + 1, p[i : i + 3], p[i + 3]) for k, s in enumerate(seqs) for p in ["[[[" + s + "]"] for i in range(len(p) - 3))
    assert sorted(r["kmer"] for r in counting.kmers(reads, 5).collect()) == sorted(s[i : i + 5] for s in seqs for i in range(len(s) - 4))


def test_fastq_in_splits(spark, tmp_path, monkeypatch):
    lines = [x for k in range(300) for x in (f"@r{k}", "ACGT"[k % 4] * (k % 7 + 1), "+", "@" * (k % 7 + 1))]
    (tmp_path / "a.fq").write_text("\n".join(lines) + "\n")
    (tmp_path / "b.fq").write_text("\r\n".join(lines[:8]) + "\r\n\r\n")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "512")
    try:
        found = files.fastq(spark, [str(tmp_path / "a.fq"), str(tmp_path / "b.fq")])
        assert spark.read.text(str(tmp_path / "a.fq")).rdd.getNumPartitions() > 3
        got = sorted((r["file"][-4:], r["name"], r["seq"]) for r in found.collect())
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
    assert got == sorted([("a.fq", f"r{k}", "ACGT"[k % 4] * (k % 7 + 1)) for k in range(300)] + [("b.fq", f"r{k}", "ACGT"[k % 4] * (k % 7 + 1)) for k in range(2)])


def test_small_readers(spark, table, tmp_path):
    (tmp_path / "dump.tsv").write_text("ACGT\t3\nTTTA\t1\nTTNA\t5\n")
    long = files.dump_transitions(files.read_dump(spark, str(tmp_path / "dump.tsv")))
    assert sorted(tuple(r) for r in long.select("kmer", "nxt", "n").collect()) == [("ACG", "T", 3), ("TTT", "A", 1)]
    table.write.parquet(str(tmp_path / "table"))
    assert files.load_table(spark, str(tmp_path / "table")).count() == table.count()
    with pytest.raises(Exception, match="PATH_NOT_FOUND|does not exist"):
        files.load_table(spark, str(tmp_path / "none"))
    asked = spark.createDataFrame([("TTT",), ("[[T",), ("GGG",)], "kmer string")
    got = {r["kmer"]: tuple(r[f"g0_{i}"] for i in range(5)) for r in counting.lookup(asked, table, ends=False).collect()}
    assert got["[[T"] == (0,) * 5 and got["TTT"][4] == 0 and sum(got["TTT"]) > 0
    assert not counting.none_found(counting.lookup(asked, table))
    with pytest.warns(UserWarning):
        assert counting.none_found(counting.lookup(asked.filter("kmer = 'CCC'"), table))
    short = spark.createDataFrame([(0, "AC")], "grp int, seq string")
    with pytest.raises(Exception, match="fewer than the lag"):
        counting.checked_length(short, 3).collect()
    assert files.discovered("/x/", "ab") == "/x/ab*" and S.START == "["
