"""Sequence files, count files, summaries from a manifest and running counts, against plain versions."""

import itertools
import json
from collections import Counter

import pytest

from seqloom.operators import counting
from seqloom.plans import summarize
from seqloom.sources import files
from seqloom.streaming import counts

FASTA = {"a.fa": ">a one\nCAACT\nCTCAA\n>b\r\nGATTACA\r\n\n>c\nTT", "b.fa": ">d\nACGT\n"}
FASTQ = {"c.fq": "@e\nACGTT\n+\n@>FF+\n@f\nGGN\n+e\n@@@\n", "d.fq": "@g\r\nTTTT\r\n+\r\nFFFF\r\n"}
READS = {"a": "CAACTCTCAA", "b": "GATTACA", "c": "TT", "d": "ACGT", "e": "ACGTT", "f": "GGN", "g": "TTTT"}
GROUPS = {"a.fa": 0, "b.fa": 2, "c.fq": 1, "d.fq": 0}
OF = {"a": 0, "b": 0, "c": 0, "d": 2, "e": 1, "f": 1, "g": 0}


@pytest.fixture
def made(tmp_path):
    for name, text in (FASTA | FASTQ).items():
        (tmp_path / name).write_bytes(text.encode())
    (tmp_path / "list.csv").write_text("".join(f"{tmp_path}/{f}, {g}, {f[-2:]}\n" for f, g in GROUPS.items()))
    return tmp_path


def transitions(seqs, lag):
    """Counter of (kmer, grp, nxt) of (grp, seq), with windows of known letters alone."""
    out = Counter()
    for grp, seq in seqs:
        whole = "[" * lag + seq + "]"
        for k in range(lag, len(whole)):
            kmer, nxt = whole[k - lag : k], whole[k]
            if set(kmer) <= set("[ACGT") and nxt in "ACGT]":
                out[kmer, grp, nxt] += 1
    return out


def cells(table, n_groups):
    """The same Counter from a wide table."""
    return Counter({(r["kmer"], g, a): r[f"g{g}_{i}"] for r in table.collect() for g in range(n_groups) for i, a in enumerate("ACGT]") if r[f"g{g}_{i}"]})


def test_fasta(spark, made):
    found = {r["name"].split()[0]: r["seq"] for r in files.fasta(spark, [str(made / f) for f in FASTA]).collect()}
    assert found == {k: READS[k] for k in "abcd"}


def test_fastq(spark, made):
    found = {r["name"]: r["seq"] for r in files.fastq(spark, [str(made / f) for f in FASTQ]).collect()}
    assert found == {k: READS[k] for k in "efg"}


def test_reads_of_a_manifest(spark, made):
    found = {r["name"].split()[0]: (r["grp"], r["seq"]) for r in files.reads(spark, str(made / "list.csv")).collect()}
    assert found == {k: (OF[k], s) for k, s in READS.items()}


@pytest.mark.parametrize("bins", [1, 4])
def test_dense_and_sparse_files(spark, made, bins):
    table = counting.wide(counting.count_long(files.reads(spark, str(made / "list.csv")), 2), 3)
    wanted = transitions([(OF[k], s) for k, s in READS.items()], 2)
    assert cells(table, 3) == wanted
    files.write_dense(table, str(made / "dense"), 3, bins)
    lines = list(itertools.chain.from_iterable(p.read_text().splitlines() for p in (made / "dense").glob("*.csv")))
    assert len(lines) == table.count() and all(len(json.loads(x.split("\t")[1])) == 3 for x in lines)
    assert cells(files.read_dense(spark, str(made / "dense"), 3), 3) == wanted
    counting.sparse(table, 3).write.csv(str(made / "sparse"), sep=";", header=True, quote="", escape="")
    assert cells(files.read_sparse(spark, str(made / "sparse"), 3), 3) == wanted


def test_summarize(spark, made):
    summarize.run(spark, str(made / "list.csv"), str(made / "out"), 3, reverse=True)
    forward = [(OF[k], s) for k, s in READS.items()]
    back = [(g, s[::-1].translate(str.maketrans("ACGT", "TGCA"))) for g, s in forward]
    for lag in (1, 2, 3):
        assert cells(files.read_dense(spark, str(made / f"out_lag_{lag}"), 3), 3) == transitions(forward, lag)
        assert cells(files.read_dense(spark, str(made / f"out_rev_lag_{lag}"), 3), 3) == transitions(forward + back, lag)


def test_fasta_written_and_read(spark, tmp_path):
    rows = [(1, 0, "ACGT"), (2, 1, "")]
    files.write_fasta(spark.createDataFrame(rows, "seed_id int, rep int, seq string"), str(tmp_path / "seqs"))
    found = {r["name"]: r["seq"] for r in files.fasta(spark, str(tmp_path / "seqs")).collect()}
    assert found == {"seq1_rep0": "ACGT", "seq2_rep1": ""}


def test_batches(spark):
    df = files.numbered(spark.range(1000).selectExpr("cast(id AS string) AS kmer"), 64)
    assert sorted(Counter(r["batch"] for r in df.collect()).items()) == [(k, 64) for k in range(15)] + [(15, 40)]


def test_running_counts(spark, tmp_path):
    seqs = [(g, READS[k]) for k, g in OF.items() if k != "f"]
    src = tmp_path / "in"
    spark.createDataFrame(seqs[:3], "grp int, seq string").coalesce(1).write.parquet(str(src))
    spark.createDataFrame(seqs[3:], "grp int, seq string").coalesce(1).write.mode("append").parquet(str(src))
    stream = spark.readStream.schema("grp int, seq string").option("maxFilesPerTrigger", 1).parquet(str(src))
    query = (
        counts.running(stream, 2).writeStream.outputMode("complete").format("memory").queryName("running_counts")
        .option("checkpointLocation", str(tmp_path / "state")).trigger(availableNow=True).start()
    )
    query.awaitTermination(120)
    found = {(r["kmer"], r["grp"], r["nxt"]): r["n"] for r in spark.table("running_counts").collect()}
    assert found == dict(transitions(seqs, 2))
