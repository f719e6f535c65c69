"""The pipeline's near-dedup stage: edited copies go, other texts stay."""

import random
from collections import Counter

import corpus_pipeline
import numpy as np

from seqloom.llm import near_copies

SCHEMA = "doc_id bigint, text string, lang string, source string, n_chars bigint"


def edited(words, places):
    return " ".join(f"new{k}" if k in places else w for k, w in enumerate(words))


def plain_shingles(text):
    w = (text or "").lower().split()
    return {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set()


def test_edited_copies_go(spark):
    """Of a hundred words two changed leave a similarity of 0.81, four of 0.65."""
    rnd = random.Random(5)
    rows, stay = [], []
    for k in range(30):
        words = [f"w{rnd.randint(0, 5000)}" for _ in range(100)]
        rows += [(10 * k, " ".join(words)), (10 * k + 1, edited(words, {20})), (10 * k + 2, edited(words, {40, 70})), (10 * k + 3, edited(words, {10, 30, 50, 80}))]
        stay += [10 * k, 10 * k + 3]
    docs = spark.createDataFrame([(d, t, "en", "a", 1) for d, t in rows], SCHEMA).repartition(4)
    kept = corpus_pipeline.drop_near_copies(spark, docs, "")
    assert kept.columns == docs.columns and sorted(r["doc_id"] for r in kept.collect()) == stay


def test_against_brute_force(spark, docs, sample):
    """A large bucket's links in chains and stars, odd rows and the small table, by all pairs of sets."""
    rnd = random.Random(6)
    words = [f"w{k}" for k in range(200)]
    chain = []
    for k in range(60):
        chain.append((k, " ".join(words), "en", "a", 1))
        words[rnd.randrange(200)] = f"c{k}"
    for table in (docs.select("doc_id", "text"), sample.select("doc_id", "text"), spark.createDataFrame(chain, SCHEMA).select("doc_id", "text"), docs.select("doc_id", "text").limit(0)):
        rows = sorted({(r["doc_id"], r["text"] or "") for r in table.collect()}, key=lambda r: (r[0] is None, r[0] or 0, r[1]))
        sets, root = [plain_shingles(t) for _, t in rows], list(range(len(rows)))

        def find(x, root=root):
            while root[x] != x:
                x = root[x]
            return x

        for i in range(len(rows)):
            for j in range(i):
                both = len(sets[i] & sets[j])
                if 5 * both >= 4 * (len(sets[i]) + len(sets[j]) - both):
                    root[find(i)] = find(j)
        groups = Counter(find(i) for i in range(len(rows)))
        kept = [(r["doc_id"], r["text"] or "") for r in corpus_pipeline.drop_near_copies(spark, table, "").collect()]
        assert Counter(find(rows.index(r)) for r in kept) == Counter(dict.fromkeys(groups, 1))


def test_shared_counts():
    """Members of few and of many sets, empty sets and long ones."""
    rng = np.random.default_rng(3)
    for n in (1, 2, 7, 60, 150):
        common = rng.integers(0, 1 << 60, 5000, dtype=np.uint64)
        sets = [np.unique(np.concatenate([rng.choice(common, int(rng.integers(0, 90))), common[: 40 * (k % 3 > 0)], rng.integers(0, 1 << 60, k, dtype=np.uint64)])) for k in range(n)]
        got = near_copies.shared_counts(sets)
        assert all(got[i, j] == len(np.intersect1d(sets[i], sets[j])) for i in range(n) for j in range(i + 1, n))


def test_group_around_one_text(spark, monkeypatch):
    """Many edits of one text that are unlike each other but near it, in a bucket of many chunks: one component, and no pairs between."""
    rnd = random.Random(8)
    monkeypatch.setattr(near_copies, "CHUNK", 16)
    base = [f"w{k}" for k in range(400)]
    rows = [(0, " ".join(base))] + [(k, edited(base, set(rnd.sample(range(5, 395), 7)))) for k in range(1, 120)]
    rows += [(1000 + k, edited(base, set(range(k % 5, 400, 9)))) for k in range(30)]  # alike in nothing
    docs = spark.createDataFrame([(d, t, "en", "a", 1) for d, t in rows], SCHEMA).repartition(3)
    sets = [plain_shingles(t) for _, t in rows]
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
    want = {min(rows[i][0] for i in range(len(rows)) if find(i) == r) for r in set(map(find, range(len(rows))))}
    assert {r["doc_id"] for r in corpus_pipeline.drop_near_copies(spark, docs, "").collect()} == want


def test_sets_that_share_a_node_name_stay_apart(spark):
    """Rows whose 64-bit names collide, as hashes may at scale, with different checks: each set keeps a node and a row of its own."""
    rows = [(1, "a", 7, 1, 3, [1, 2]), (2, "b", 7, 2, 4, [3, 4]), (3, "c", 7, 1, 3, [1, 2]), (4, "d", 8, 1, 5, [5, 6])]
    found = near_copies.nodes_of(spark.createDataFrame(rows, "doc_id bigint, tie string, node bigint, check bigint, size int, keys array<bigint>"))
    assert sorted((r["best"]["doc_id"], r["size"], r["keys"]) for r in found.collect()) == [(1, 3, [1, 2]), (2, 4, [3, 4]), (4, 5, [5, 6])]
    assert found.select("node").distinct().count() == 3 and set(found.columns) == {"node", "best", "size", "keys"}


def test_fingerprint_links_count(spark):
    """Texts whose fingerprints op2 links go, also where their sets of shingles differ: a long refrain with ends of their own."""
    refrain = "over and under " * 200
    rows = [(1, refrain + "first end of it all"), (2, refrain + "another way to close down"), (3, "some other text that is quite unlike the refrain")]
    docs = spark.createDataFrame([(d, t, "en", "a", 1) for d, t in rows], SCHEMA)
    a, b = (near_copies.fingerprint(t) for _, t in rows[:2])
    assert (a ^ b).bit_count() <= 2 and not near_copies.alike(*(near_copies.shingles(t) for _, t in rows[:2]))
    assert sorted(r["doc_id"] for r in corpus_pipeline.drop_near_copies(spark, docs, "").collect()) == [1, 3]
