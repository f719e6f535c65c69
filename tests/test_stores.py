"""The k-mer store, the data sources of sequences, counts on both strands from one, super-k-mers and the checker."""

import gzip
import subprocess
import sys
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from seqloom.functions import symbols as S
from seqloom.operators import cells, counting, scoring, superkmers
from seqloom.plans import check, summarize
from seqloom.sources import sequences, store

SEQS = ["TTTAT", "TTCTT", "TTTTT", "ACGTACGTAGCTA", "GGGATTC", "CATCATCATG", "A", "AC", "ACG", "CGT", "", "ACGT"]


@pytest.fixture(scope="module")
def reads(spark):
    return spark.createDataFrame([(k, k % 3, s) for k, s in enumerate(SEQS)], "seq_id int, grp int, seq string")


def leaves(node, above=()):
    """The way from the top of a plan to each of its leaves."""
    name = node.nodeName()
    if name == "AdaptiveSparkPlan":
        return leaves(node.executedPlan(), above)
    if "QueryStage" in name:
        return leaves(node.plan(), above)
    kids, way = node.children(), [*above, node.simpleString(1000)]
    return [way] if kids.size() == 0 else [p for k in range(kids.size()) for p in leaves(kids.apply(k), way)]


# store


def test_keys(spark):
    kmers = ["A", "T", "AAA", "[[[", "[[A", "[AA", "ACGTACGTACGTACGTACGTACGTACGTACG", "T" * 31, "A" * 31, "[" * 30 + "T"]
    rows = spark.createDataFrame([(k, len(k)) for k in kmers], "kmer string, lag int").withColumn("key", store.packed_key(F.col("kmer"))).collect()
    assert len({(r["lag"], r["key"]) for r in rows}) == len(kmers) and all(0 < r["key"] < 2**63 for r in rows)
    for r in rows:
        assert spark.range(1).select(store.unpacked_key(F.lit(r["key"]).cast("bigint"), r["lag"])).first()[0] == r["kmer"]
    odd = spark.createDataFrame([("ANA",), ("A[A",), ("A" * 32,), ("",), (None,)], "kmer string").select(store.packed_key(F.col("kmer")).alias("key")).collect()
    assert [r["key"] for r in odd] == [None, None, None, 1, None]
    with pytest.raises(ValueError, match="two bits"):
        store.packed_key(F.lit("MK"), "prot")


def test_store(spark, reads, tmp_path):
    table = cells.celled(counting.count_long(reads, 3), 3)
    path = f"file://{tmp_path}/store"
    with pytest.raises(FileNotFoundError):
        store.KmerStore.open(spark, path)
    store.KmerStore.write(table, path, 3).close()
    found = store.KmerStore.open(spark, path)  # as another session would
    assert (found.lag, found.n_groups, found.alphabet) == (3, 3, "dna")
    asked = spark.createDataFrame([("TTT",), ("TTT",), ("[[A",), ("GGG",), ("CCC",), ("NNN",), ("[[[",)], "kmer string")
    got = found.lookup(asked)
    want = {r["kmer"]: [r["g0"], r["g1"], r["g2"]] for r in table.collect()}
    rows = {r["kmer"]: [r["g0"], r["g1"], r["g2"]] for r in got.collect()}
    assert rows == {k: want.get(k, [[0] * 5] * 3) for k in ("TTT", "[[A", "GGG", "CCC", "NNN", "[[[")}
    # no exchange between the store's scan and the join
    paths = [p for p in leaves(got._jdf.queryExecution().executedPlan()) if "Bucketed: true" in p[-1]]
    assert len(paths) == 1 and not any("Exchange" in x for x in paths[0][[k for k, x in enumerate(paths[0]) if "Join" in x][-1] :])
    # scores by way of the store are those of the table
    w = counting.count_windows(reads, 3, keep=("seq_id",))
    a, b = (sorted(map(tuple, scoring.model_scores(w, scoring.concentrations(w, t, 0, alphas=[0.5]), "seq_id").collect())) for t in (table, found.lookup(w)))
    assert [x[:3] for x in a] == [x[:3] for x in b] and np.allclose([x[3] for x in a], [x[3] for x in b])
    # written anew, it has the new table alone
    store.KmerStore.write(table.filter("kmer = 'TTT'"), path, 3)
    assert store.KmerStore.open(spark, path).rows().count() == 1
    found.close()
    with pytest.raises(Exception, match="no key"):
        store.KmerStore.write(spark.createDataFrame([("ANA", [1, 0, 0, 0, 0])], "kmer string, g0 array<bigint>"), f"file://{tmp_path}/odd", 3)


# data sources


def records(spark, kind, path, split):
    sequences.register(spark)
    df = spark.read.format(f"seqloom.{kind}").option("splitBytes", split).load(str(path))
    assert "Exchange" not in df._jdf.queryExecution().executedPlan().toString()
    return [(r["name"], r["seq"]) for r in df.collect()]


@pytest.mark.parametrize("end", ["\n", "\r\n"])
def test_fastq_at_every_split(spark, tmp_path, end):
    """Quality lines that look like names, an empty read, and every place that a split can have."""
    want = [(f"r{k} of @all", "ACGT"[k % 4] * (k % 6)) for k in range(12)]
    text = "".join(f"@{n}{end}{s}{end}+{n if k % 2 else ''}{end}{'@+@+@+'[: len(s)]}{end}" for k, (n, s) in enumerate(want))
    (tmp_path / "a.fq").write_bytes(text.encode())
    data = text.encode()
    for split in range(1, len(data)):  # the records of each range, in the reader itself
        reader = sequences._Reader({"path": str(tmp_path / "a.fq"), "splitbytes": str(split)}, sequences.fastq_records)
        parts = reader.partitions()
        assert len(parts) == -(-len(data) // split)
        if split % 7 in (0, 3) or split < 12:
            got = [(n, s) for p in parts for b in reader.read(p) for n, s in zip(b.column(1).to_pylist(), b.column(2).to_pylist(), strict=True)]
            assert got == want, split
    assert sorted(records(spark, "fastq", tmp_path / "a.fq", 37)) == sorted(want)
    (tmp_path / "b.fq.gz").write_bytes(gzip.compress(data))
    (tmp_path / "_left.fq").write_bytes(b"out")
    (tmp_path / "empty.fq").write_bytes(b"")
    assert Counter(records(spark, "fastq", tmp_path, 50)) == Counter(want * 2)
    (tmp_path / "c.txt").write_text("@r\nAC\n+\n")
    with pytest.raises(Exception, match="no whole FASTQ record"):
        records(spark, "fastq", tmp_path / "c.txt", 1000)
    with pytest.raises(Exception, match="no file or folder"):
        records(spark, "fastq", tmp_path / "none", 1000)


def test_fasta_at_every_split(spark, tmp_path):
    want = [("one > two", "ACGTACGT"), ("", "TT"), ("empty", ""), ("spaced", "ACGT"), ("last", "G" * 40)]
    text = "; before\n>one > two\nACGT\nACGT\n>\nTT\n>empty\n>spaced\r\nAC GT \r\n\r\n>last\n" + "GGGG\n" * 10
    (tmp_path / "a.fa").write_text(text)
    for split in range(1, len(text)):
        reader = sequences._Reader({"path": str(tmp_path / "a.fa"), "splitbytes": str(split)}, sequences.fasta_records)
        got = [(n, s) for p in reader.partitions() for b in reader.read(p) for n, s in zip(b.column(1).to_pylist(), b.column(2).to_pylist(), strict=True)]
        assert got == want, split
    (tmp_path / "b.fa.gz").write_bytes(gzip.compress(text.encode()))
    assert Counter(records(spark, "fasta", f"{tmp_path}/a.fa,file://{tmp_path}/b.fa.gz", 20)) == Counter(want * 2)


# strands


@pytest.mark.parametrize("lag", [1, 2, 3, 6])
def test_strands_from_counts(reads, lag):
    mine = counting.strands_counts(counting.count_long(reads, lag), lag)
    both = counting.count_long(counting.both_strands(reads), lag)
    key = lambda df: {(r["kmer"], r["grp"], r["nxt"]): r["n"] for r in df.collect()}
    got, want = key(mine), key(both)
    got.pop(("[" * lag, 1, "]"), None)
    want.pop(("[" * lag, 1, "]"), None)  # an empty read has no strand
    assert got == want


# super-k-mers


def exchanged(df):
    """Bytes that a query's exchanges were given, once it has run."""
    df.write.format("noop").mode("overwrite").save()
    df.collect()
    plan = df._jdf.queryExecution().executedPlan()

    def of(node):
        name = node.nodeName()
        if name == "AdaptiveSparkPlan":
            return of(node.executedPlan())
        if "QueryStage" in name:
            return of(node.plan())
        own = node.metrics().get("dataSize").get().value() if name == "Exchange" else 0
        kids = node.children()
        return own + sum(of(kids.apply(k)) for k in range(kids.size()))

    return of(plan)


def test_super_kmers(spark):
    rng = np.random.default_rng(8)
    seqs = ["".join(rng.choice(list("ACGT"), 700)) for _ in range(40)] + ["A" * 5000, "ACGT" * 10, "A" * 31, "A" * 30, "", "ACGTN" * 20, "é中" * 30] + ["CATTAG" * 300] * 5
    reads = spark.createDataFrame([(k % 2, s) for k, s in enumerate(seqs)], "grp int, seq string").repartition(4)
    want = Counter((k % 2, s[i : i + 31]) for k, s in enumerate(seqs) for i in range(len(s) - 30))
    got = superkmers.counted(reads, 31)
    assert {(r["grp"], r["kmer"]): r["n"] for r in got.collect()} == dict(want)
    assert {(r["grp"], r["kmer"]): r["n"] for r in superkmers.counted(reads, 31, 3).collect()} == {k: n for k, n in want.items() if n >= 3}
    assert {(r["grp"], r["kmer"]): r["n"] for r in superkmers.counted(reads, 5).collect()} == Counter((k % 2, s[i : i + 5]) for k, s in enumerate(seqs) for i in range(len(s) - 4))
    parts = superkmers.super_kmers(reads, 31)
    assert parts.filter("part = repeat('A', 5000)").count() == 1  # one string for all its windows
    plain = counting.kmers(reads, 31).groupBy("grp", "kmer").agg(F.count(F.lit(1)).alias("n"))
    assert exchanged(superkmers.counted(reads, 31)) * 3 < exchanged(plain)


def test_a_hot_minimizer_is_split(spark):
    """Half of all windows share a minimizer, with different words around it: they are counted by word, not by minimizer."""
    rng = np.random.default_rng(9)
    seqs = ["".join(rng.choice(list("ACGT"), 15)) + "GATTACAGATTACA" + "".join(rng.choice(list("ACGT"), 15)) for _ in range(2000)]
    reads = spark.createDataFrame([(0, s) for s in seqs], "grp int, seq string")
    got = superkmers.counted(reads, 31)
    assert {r["kmer"]: r["n"] for r in got.collect()} == Counter(s[i : i + 31] for s in seqs for i in range(len(s) - 30))
    plan = got._jdf.queryExecution().toString()
    assert "Union" in plan and plan.count("BroadcastHashJoin") >= 2


# checker


def test_checker(spark, tmp_path):
    (tmp_path / "a.fa").write_text("".join(f">s{k}\n{s}\n" for k, s in enumerate(SEQS) if s))
    (tmp_path / "manifest.csv").write_text(f"{tmp_path}/a.fa, 0, fa\n")
    summarize.run(spark, str(tmp_path / "manifest.csv"), str(tmp_path / "t"), 3, reverse=True)
    assert check.run(spark, str(tmp_path / "manifest.csv"), str(tmp_path / "t"), 3, reverse=True) == []
    part = next((tmp_path / "t_rev_lag_2").glob("part-*"))
    lines = part.read_text().splitlines()
    kmer, counts = lines[0].split("\t")
    part.write_text("\n".join([kmer + "\t" + counts.replace(counts.split(",")[0], "[[77"), *lines[2:]]) + "\n")
    (part.parent / f".{part.name}.crc").unlink(missing_ok=True)
    off = check.run(spark, str(tmp_path / "manifest.csv"), str(tmp_path / "t"), 3, reverse=True)
    assert {x[0] for x in off} == {f"{tmp_path}/t_rev_lag_2"} and {(x[1], x[2]) for x in off} == {(kmer, "counts differ"), (lines[1].split("\t")[0], "lacking")}
    table = counting.wide(counting.count_long(spark.createDataFrame([(0, s) for s in SEQS], "grp int, seq string"), 3), 1)
    assert check.ranges_that_differ(table, table.repartition(3)).count() == 0
    assert check.ranges_that_differ(table, table.filter("kmer != 'TTT'")).count() == 1
    assert check.digests(cells.of_wide(table)).exceptAll(check.digests(table)).count() == 0
    run = subprocess.run([sys.executable, "-m", "seqloom.plans.check", str(tmp_path / "manifest.csv"), str(tmp_path / "t"), "-l", "2", "-r"], capture_output=True, text=True, timeout=300)
    assert run.returncode == 1 and "counts differ" in run.stdout and S.START


def test_words_prefixes_and_suffixes_of_all_lengths(spark, reads, tmp_path):
    got = {(r["kind"], r["len"], r["grp"], r["part"]): r["n"] for r in summarize.parts(counting.count_windows(reads, 3), 3).collect()}
    want = Counter()
    for k, s in enumerate(SEQS):
        want.update(("full", n, k % 3, s[i : i + n]) for n in range(1, 5) for i in range(len(s) - n + 1))
        want.update((kind, n, k % 3, part) for n in range(1, min(3, len(s)) + 1) for kind, part in (("pre", s[:n]), ("suf", s[-n:])))
    assert got == want
    (tmp_path / "a.fa").write_text("".join(f">s{k}\n{s}\n" for k, s in enumerate(SEQS) if s))
    (tmp_path / "manifest.csv").write_text(f"{tmp_path}/a.fa, 0, fa\n")
    summarize.run(spark, str(tmp_path / "manifest.csv"), str(tmp_path / "t"), 2, all_parts=True)
    back = spark.read.parquet(str(tmp_path / "t_parts"))
    assert {r["part"]: r["n"] for r in back.filter("kind = 'pre' and len = 1").collect()} == Counter(s[0] for s in SEQS if s)
