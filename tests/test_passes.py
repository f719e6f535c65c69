"""How often texts are read, and that fewer passes count the same."""

import pytest
from pyspark.sql import functions as F

from seqloom.functions import symbols as S
from seqloom.operators import counting as C
from seqloom.operators import scoring
from seqloom.sources import files

TEXTS = ["Abc dEf", "", None, "zé ü", "a", "12 !", "The quick brown fox jumps over the lazy dog" * 9, "ab", "ABCABC[]abc"]


@pytest.fixture
def texts(spark):
    return spark.createDataFrame([(k % 2 if k % 5 else None, t) for k, t in enumerate(TEXTS * 3)], "grp int, text string").repartition(3)


def rows(df):
    return sorted((tuple(r) for r in df.select("kmer", "grp", "nxt", "n").collect()), key=repr)


def passes(df):
    return df._jdf.queryExecution().executedPlan().toString().count("MapInArrow")


@pytest.mark.parametrize("lag", [1, 3, 5, 6])
def test_texts_are_counted_as_their_sequences(texts, lag):
    reads = S.with_dna(texts, "text").filter("seq != ''")
    assert rows(C.text_windows(texts, "text", lag)) == rows(C.count_long(reads, lag))
    assert rows(C.text_windows(texts, "text", lag, both=True)) == rows(C.count_long(C.both_strands(reads), lag))
    assert rows(C.from_parts(reads, lag, C.text_windows(texts, "text", lag, inner=True))) == rows(C.count_long(reads.filter(F.length("seq") >= lag), lag))


def test_windows_of_more_keys_and_symbols_than_are_held(spark, monkeypatch):
    monkeypatch.setattr(C, "SPAN", 7)
    monkeypatch.setattr(C, "KEYS", 2)
    texts = spark.createDataFrame([(k % 5, t) for k, t in enumerate(TEXTS * 2)], "grp int, text string").coalesce(1)
    assert rows(C.text_windows(texts, "text", 2)) == rows(C.count_long(S.with_dna(texts, "text").filter("seq != ''"), 2))


def test_strands_and_places_read_texts_once(texts):
    long = C.text_windows(texts, "text", 3)
    assert passes(C.strands_counts(long, 3)) == 0
    assert passes(C.text_windows(texts, "text", 3, both=True)) == 1
    assert passes(C.from_parts(S.with_dna(texts, "text"), 3, C.text_windows(texts, "text", 3, inner=True))) == 1
    assert passes(files.numbered(C.wide(long, 2), 2)) == 0


@pytest.mark.parametrize("lag", [1, 3, 4])
def test_contexts_of_texts_and_their_marginals(spark, monkeypatch, lag):
    """Counts by sequence, repeated ids included, and their scores with the contexts carried and with them joined."""
    texts = spark.createDataFrame([(k % 11 or None, t) for k, t in enumerate(TEXTS * 3)], "seq_id int, text string").repartition(3)
    w = C.count_windows(S.with_dna(texts, "text").filter("seq != ''"), lag, keep=("seq_id",))
    long = C.text_windows(texts.withColumn("grp", F.lit(0)), "text", lag)
    own = C.text_contexts(texts, "text", lag, "seq_id")
    said = lambda df: sorted((tuple(r) for r in df.select("seq_id", "kmer", *[f"w{i}" for i in range(5)]).collect()), key=repr)
    assert said(own) == said(w.groupBy("seq_id", "kmer").agg(*scoring._own()))
    conc = scoring.concentrations(w, C.wide(long, 1), 0, alphas=[0.5, 2.0])
    scores = lambda: {(r["seq_id"], r["param"]): r["score"] for r in scoring.model_marginals(own, conc, "seq_id").collect()}
    carried = scores()
    monkeypatch.setattr(scoring, "CARRIED", 0)
    assert carried == pytest.approx(scores()) and len(carried) > 10
