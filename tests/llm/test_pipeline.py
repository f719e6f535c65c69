"""The pipeline as a whole against plain Python, on odd cases, an empty table and the whole small table."""

import hashlib
import random
import re
from collections import Counter, defaultdict

import corpus_pipeline
import duckdb
import numpy as np
import pandas as pd
import public_tokenizers
import pytest

from seqloom.llm import toxicity
from seqloom.llm.oracle import ORACLE

SF = "/root/testdata/sf0.001"
SCHEMA = "doc_id bigint, text string, lang string, source string, n_chars bigint"


def words(text):
    return re.findall(r"[^\x20\x09-\x0D]+", text or "")


def without_copies(rows):
    """Of texts equal but for white space the longest row, then the smallest id."""
    best = {}
    for r in rows:
        key, rank = "".join(words(r[1])), (-len(r[1] or ""), r[0] is None, r[0] or 0)
        if key not in best or rank < best[key][0]:
            best[key] = (rank, r)
    return [r for _, r in best.values()]


def without_near_copies(rows):
    """One row, the one with the smallest id, of each component of texts with five-word similarity 0.8 or more."""
    sets = []
    for r in rows:
        w = words("".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in r[1] or ""))
        sets.append({tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))} if w else set())
    root = list(range(len(rows)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i in range(len(rows)):
        for j in range(i):
            both = len(sets[i] & sets[j])
            if 5 * both >= 4 * (len(sets[i]) + len(sets[j]) - both):
                root[find(i)] = find(j)
    best = {}
    for i, r in enumerate(rows):
        best[find(i)] = min(best.get(find(i), ((True, 0), None)), ((r[0] is None, r[0] or 0), i), key=lambda x: (x[1] is None, x[0]))
    return [rows[i] for _, i in best.values()]


def taken(rows):
    """How many words the mix takes of each (doc_id, text), by DuckDB."""
    duck = duckdb.connect()
    table = pd.DataFrame([(r[0], r[1], r[3]) for r in rows], columns=["doc_id", "text", "source"])
    table["doc_id"] = table["doc_id"].astype("Int64")
    for c in ("text", "source"):
        table[c] = table[c].astype(object).where(table[c].notna(), None)
    duck.register("given", table)
    duck.sql("CREATE TABLE documents AS SELECT doc_id::BIGINT AS doc_id, text::VARCHAR AS text, source::VARCHAR AS source FROM given")
    sql = ORACLE["op3_source_mixing"].replace("SELECT doc_id, size, source_size", "SELECT doc_id, tie, size, source_size")
    rel = duck.sql(sql)
    at = {c: k for k, c in enumerate(rel.columns)}
    return {(x[at["doc_id"]], x[at["tie"]]): x[at["taken"]] for x in rel.fetchall()}


def checked(spark, monkeypatch, docs, sf):
    """Runs the pipeline over docs; holds its rows against plain Python, and each stage against the one before."""
    kept = {}
    stored = corpus_pipeline.stored

    def seen(df, name):
        out = stored(df, name)
        kept[name] = [tuple(r) for r in out.collect()]
        assert out.columns == docs.columns
        return out

    monkeypatch.setattr(corpus_pipeline, "stored", seen)
    given = [tuple(r) for r in docs.collect()]
    reader = spark.read
    monkeypatch.setattr(type(reader), "parquet", lambda self, path, _was=type(reader).parquet: docs if str(path).endswith("documents.parquet") else _was(self, path))
    out = [r.asDict() for r in corpus_pipeline.run(spark, sf).collect()]
    monkeypatch.undo()
    model = toxicity.fit(docs, spark.read.parquet(f"{sf}/labels.parquet"))
    score = lambda text: 0.0 if model is None else model.score(text)
    want = [r for r in given if score(r[1]) < 0.5]
    assert Counter(kept["toxicity"]) == Counter(want)
    key = lambda rows: Counter((r[0], r[1] or "") for r in rows)
    want = without_copies(want)
    assert key(kept["exact_dedup"]) == key(want) and set(kept["exact_dedup"]) <= set(given)
    want = without_near_copies(want)
    assert key(kept["simhash_near_dedup"]) == key(want) and set(kept["simhash_near_dedup"]) <= set(given)
    # the mix: every row's words as often as the plan says, each text whole or a run of its words (cyclic ones in two)
    plan, by_text = taken(want), {(r[0], r[1] or ""): r for r in want}
    got = defaultdict(list)
    for r in kept["source_mixing"]:
        of = [t for (d, t), w in by_text.items() if d == r[0] and (w[2], w[3], w[4]) == (r[2], r[3], r[4]) and (t == r[1] or set(words(r[1])) <= set(words(t)))]
        assert of
        got[r[0], of[0] if r[1] not in of else r[1]].append(r[1])
    count = defaultdict(int)
    for (d, _), texts in got.items():
        count[d] += sum(len(words(t)) for t in texts)
    planned = defaultdict(int)
    for (d, t), _ in by_text.items():
        planned[d] += plan[d, hashlib.md5(t.encode()).hexdigest()]
    assert {k: v for k, v in planned.items() if v} == {k: v for k, v in count.items() if v}
    # packing: each document of the mix comes out whole, sequences have no gaps
    from tokenizers import Tokenizer

    encode = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json")).encode
    ids = [(r[0], [*encode(r[1] or "", add_special_tokens=False).ids, 2]) for r in kept["source_mixing"]]
    assert Counter(x for d, doc in ids for x in ((d, i) for i in doc)) == Counter((r["doc_id"], i) for r in out for i in np.frombuffer(r["ids"], "<u4").tolist())
    starts = Counter((r["doc_id"], r["start"]) for r in out)
    assert sum(n for (_, at), n in starts.items() if at == 0) == len(ids)
    for d, doc in ids:
        pieces = [r for r in out if r["doc_id"] == d and r["doc_tokens"] == len(doc)]
        assert all(any(np.frombuffer(r["ids"], "<u4").tolist() == other[r["start"] : r["start"] + r["length"]] for e, other in ids if e == d) for r in pieces)
    sequences = defaultdict(list)
    for r in out:
        sequences[r["sequence_id"]].append((r["offset"], r["length"]))
    for pieces in sequences.values():
        at = 0
        for offset, length in sorted(pieces):
            assert offset == at and length > 0
            at += length
        assert at <= 4096
    return kept, out


def test_small_table(spark, monkeypatch):
    kept, out = checked(spark, monkeypatch, spark.read.parquet(f"{SF}/documents.parquet"), SF)
    assert len(kept["toxicity"]) > len(kept["exact_dedup"]) > len(kept["simhash_near_dedup"]) > 0 and out


def test_odd_cases(spark, monkeypatch, docs):
    """Nulls in any column, empty and long texts, ties, repeated ids and rows; labels of the small table."""
    checked(spark, monkeypatch, docs.select("doc_id", "text", "lang", "source", "n_chars"), SF)


def test_no_documents(spark, monkeypatch, no_docs):
    kept, out = checked(spark, monkeypatch, no_docs, SF)
    assert out == [] and all(rows == [] for rows in kept.values())


def test_clashing_columns(spark, docs):
    """The stages keep further columns, whatever their names."""
    at = docs
    for _, stage in corpus_pipeline.STAGES[:-1]:
        at = stage(spark, at, SF)
        assert at.columns == docs.columns and at.count() > 0


@pytest.mark.parametrize("share", [3])
def test_a_third_are_copies(spark, share):
    """A third of the rows are one text, some of them true repeats of a row."""
    rnd = random.Random(2)
    rows = [(k % 200 if k % share == 0 else k, "the same text again and again in many rows of this table" if k % share == 0 else " ".join(f"w{rnd.randrange(3000)}" for _ in range(30)), "en", "a", k % 2) for k in range(1500)]
    table = spark.createDataFrame(rows, SCHEMA).repartition(6)
    left = corpus_pipeline.drop_copies(spark, table, SF)
    assert Counter(r["text"] for r in left.collect()) == Counter({r[1] for r in rows})
    mixed = corpus_pipeline.mix_sources(spark, table, SF).collect()
    assert sum(len(words(r["text"])) for r in mixed) == pytest.approx(1.5 * sum(len(words(r[1])) for r in rows), abs=200)


def test_ids_come_out(spark):
    docs = spark.createDataFrame([(1, "some words to pack", "en", "a", 18), (1, "other words under the same id", "en", "a", 29)], SCHEMA)
    rows = corpus_pipeline.pack_sequences(spark, docs, SF).collect()
    assert rows and all(len(r["ids"]) == 4 * r["length"] for r in rows)
