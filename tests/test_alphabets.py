"""Tables of any alphabet: round trips, widths that don't fit, likelihoods by hand, and a run on proteins from a configuration file."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from seqloom.functions import numeric as N
from seqloom.functions import symbols as S
from seqloom.operators import cells, counting, models, training
from seqloom.plans import fit
from seqloom.sources import files

PROTEINS = ["MKVLAAGIV", "MKKLLPT", "GGSSGG", "MKVLAWWY", "", "MK", "MKVLXAAG"]


@pytest.fixture(scope="module")
def table(spark):
    reads = spark.createDataFrame([(k % 3, s) for k, s in enumerate(PROTEINS)], "grp int, seq string")
    return cells.celled(counting.count_long(reads, 2, "prot"), 3, "prot").cache()


def by_hand():
    out = {}
    for k, s in enumerate(PROTEINS):
        p = "[[" + s + "]"
        for i in range(len(p) - 2):
            w, x = p[i : i + 2], p[i + 2]
            if set(w + x) <= set(S.ALPHABETS["prot"] + "[]"):
                out.setdefault(w, np.zeros((3, 21), int))[k % 3, S.letters("prot").index(x)] += 1
    return out


def as_dict(df):
    return {r["kmer"]: np.array([r[f"g{g}"] for g in range(3)]) for r in df.collect()}


def test_cells(table):
    got, want = as_dict(table), by_hand()
    assert set(got) == set(want) and all((got[k] == want[k]).all() for k in want)
    long = {(r["kmer"], r["grp"], r["nxt"]): r["n"] for r in cells.to_long(table, "prot").collect()}
    assert long == {(k, g, S.letters("prot")[i]): m[g, i] for k, m in want.items() for g in range(3) for i in range(21) if m[g, i]}


def test_files_keep_all_letters_and_refuse_other_widths(spark, table, tmp_path):
    files.write_dense(table, str(tmp_path / "dense"), 3)
    back = files.read_cells(spark, str(tmp_path / "dense"), 3, "prot")
    assert {k: v.tolist() for k, v in as_dict(back).items()} == {k: v.tolist() for k, v in by_hand().items()}
    wide = files.read_dense(spark, str(tmp_path / "dense"), 3, "prot")
    assert len(wide.columns) == 1 + 3 * 21 and as_dict(cells.of_wide(wide)).keys() == by_hand().keys()
    for n, alphabet in ((3, "dna"), (2, "prot"), (4, "prot")):
        with pytest.raises(Exception, match="as the alphabet"):
            files.read_dense(spark, str(tmp_path / "dense"), n, alphabet).collect()
    sparse = counting.sparse(wide, 3, 21)
    sparse.coalesce(1).write.csv(str(tmp_path / "sparse"), sep=";", header=True, quote="", escape="")
    again = files.read_cells(spark, str(tmp_path / "sparse"), 3, "prot", sparse=True)
    assert {k: v.tolist() for k, v in as_dict(again).items()} == {k: v.tolist() for k, v in by_hand().items()}
    with pytest.raises(Exception, match="as the alphabet"):
        files.read_sparse(spark, str(tmp_path / "sparse"), 3).collect()
    broken = spark.createDataFrame([("AC", "[[1,2,3,4,5]]"), ("AG", "nonsense")], "kmer string, counts string")
    with pytest.raises(Exception, match="counts of AG"):
        cells.unpacked(broken, 1).collect()


def test_dna_as_arrays_equals_the_wide_form(spark):
    reads = spark.createDataFrame([(k % 3, s) for k, s in enumerate(["ACGTAC", "GGGT", "TTTACG", "ACGT", "CA"])], "grp int, seq string")
    long = counting.count_long(reads, 2)
    wide, arrays = counting.wide(long, 3), cells.celled(long, 3)
    for given in (None, 0):
        a, b = (sorted(map(tuple, f(t, [1, 2], [0.1, 2.0], given).collect())) for f, t in ((models.bmm_loglik, wide), (cells.bmm_loglik, arrays)))
        assert [x[3:] for x in a] == [x[3:] for x in b] and np.allclose([x[:3] for x in a], [x[:3] for x in b])
    w = [[[((3 * j + a + 2 * o) % 5) / 4 for o in range(5)] for a in range(5)] for j in range(2)]
    a = models.evaluation(wide, models.reference_ar(models.cells(2)), [0.5], 1, 0).collect()
    jc = cells.jukes_cantor(cells.counts(arrays, 2), 5, 1 / 30)
    b = cells.evaluation(arrays, F.transform(jc, lambda x, i: (x + 0.01 * (i == 4).cast("double")) / 1.01), [0.5], 1, 0).collect()
    assert [r["model"] for r in a] == [r["model"] for r in b] and np.allclose([list(r)[1:] for r in a], [list(r)[1:] for r in b])
    f = arrays.select(cells.linear(F.col("kmer"), w).alias("f"), *[p.alias(f"p{i}") for i, p in enumerate(models.linear_ar(F.col("kmer"), w))]).collect()
    assert all(np.allclose(r["f"], list(r)[1:]) for r in f)


@pytest.mark.parametrize("alone", [True, False])
@pytest.mark.parametrize("alphabet", ["dna", "prot"])
def test_gradient_as_an_aggregate(spark, alphabet, alone):
    rng, n = np.random.default_rng(3), cells.width(alphabet)
    symbols = S.ALPHABETS[alphabet] + S.START
    kmers = sorted({"".join(rng.choice(list(symbols), 3)) for _ in range(40)})
    counts = rng.integers(0, 4, (len(kmers), n)).astype(float)
    counts[0] = 0
    p = {"w": rng.normal(size=(3, n, n)), "log_h": np.array([0.4])}
    rows = spark.createDataFrame([(k, list(map(float, c))) for k, c in zip(kmers, counts, strict=True)], "kmer string, n array<double>")
    ll, grads, n_rows = training.linear_gradients(rows, p, alone, alphabet)
    want, slopes = training.loglik_and_grads(p, training.Linear, kmers, counts, None, alone, alphabet)
    assert ll == pytest.approx(want) and n_rows == len(kmers)
    assert np.allclose(grads["w"], slopes["w"]) and np.allclose(grads["log_h"], slopes["log_h"])


def test_functions(spark):
    xs = [0.03, 0.5, 1.0, 2.5, 40.0, 1e6]
    rows = spark.createDataFrame([(x,) for x in xs], "x double")
    got = rows.select(N.digamma(F.col("x")).alias("d"), N.lbeta(F.col("x"), F.col("x") + 1).alias("b"), N.log_gamma_density(F.col("x"), F.log("x")).alias("p"), N.softmax_of(F.array(F.col("x"), F.lit(1.0), F.lit(-3.0))).alias("s")).collect()
    for x, r in zip(xs, got, strict=True):
        step = 1e-4 * x
        assert r["d"] == pytest.approx((math.lgamma(x + step) - math.lgamma(x - step)) / (2 * step), rel=1e-4)
        assert r["b"] == pytest.approx(math.lgamma(x) + math.lgamma(x + 1) - math.lgamma(2 * x + 1), rel=1e-9, abs=1e-9)
        assert r["p"] == pytest.approx(math.exp(x * math.log(x) - x - math.lgamma(x)), rel=1e-6)
        e = np.exp(np.array([x, 1, -3]) - max(x, 1))
        assert np.allclose(r["s"], e / e.sum())


@pytest.mark.parametrize(("kind", "name"), [("net", "linear"), ("net", "cnn"), ("ref", "stop")])
def test_protein_run(spark, table, tmp_path, kind, name):
    files.write_dense(table, str(tmp_path / "data" / "part"), 3)
    cfg = f"""
[general]
out_folder = {tmp_path}/out*
seed = 1
precision = 32
[data]
files_path = {tmp_path}/data
start_token = part
sparse = False
num_ds = 3
alphabet = prot
train_column = 0
test_column = 1
reference_column = 2
[hyperp]
lag = 2
[train]
train = True
epochs = 4
batch_size = 1
optimizer_name = RMSprop
learning_rate = 0.02
train_ar = False
accumulation_steps = 1
restart = False
[test]
test = True
train_test = False
van_reg = [0.1]
[model]
ar_func_name = {name}
af_kwargs = {{{'"num_filters": 5, "filter_width": 1' if name == "cnn" else ""}}}
"""
    path = tmp_path / "run.cfg"
    path.write_text(cfg)
    folder = fit.run(spark, str(path), kind == "ref")
    model = fit.load(spark, folder)
    assert model.alphabet == "prot"
    if name == "linear":
        assert model.params["w"].shape == (2, 21, 21) and (model.params["w"] == model.params["w"].astype(np.float32)).all()
    got = {(r["metric"], r["model"]): r["value"] for r in spark.read.parquet(f"{folder}/results").collect()}
    hand, ll = by_hand(), 0.0
    f = {r["kmer"]: np.array([r[f"f{i}"] for i in range(21)]) for r in model.predict(table).collect()}
    assert all(v.sum() == pytest.approx(1) for v in f.values())
    bmm = 0.0
    for k, m in hand.items():
        c = f[k] / model.h + m[0] + 1e-7
        ll += sum(math.lgamma(x + n) - math.lgamma(x) for x, n in zip(c, m[1], strict=True)) - (math.lgamma(c.sum() + m[1].sum()) - math.lgamma(c.sum()))
        c = 0.1 + m[0]
        bmm += sum(math.lgamma(x + n) - math.lgamma(x) for x, n in zip(c, m[1], strict=True)) - (math.lgamma(c.sum() + m[1].sum()) - math.lgamma(c.sum()))
    assert got["loglik", "dm"] == pytest.approx(ll, rel=1e-6) and got["loglik", "bmm"] == pytest.approx(bmm, rel=1e-6)
    losses = [r["loss"] for r in spark.read.parquet(f"{folder}/losses").orderBy("step").collect()]
    assert len(losses) == 4 and losses[-1] < losses[0]
    wrong = files.config(str(path))
    wrong["data"]["alphabet"] = "dna"
    with pytest.raises(Exception, match="as the alphabet"):
        fit.read_table(spark, wrong["data"]).collect()
    wrong["data"]["alphabet"] = "klingon"
    with pytest.raises(ValueError, match="no alphabet"):
        fit.read_table(spark, wrong["data"])
