"""Near copies: texts whose SimHash fingerprints are links of op2, and texts whose sets of five-word shingles have a Jaccard similarity of 0.8 or more.

Fingerprints and their links are those of simhash: texts whose fingerprints differ in 2 bits or fewer are near copies, whatever their sets say. What follows finds
the links by sets, which fingerprints so near miss; components are of both kinds of links together.

Texts with equal sets are one node; sets are told apart by 128 bits of hash. Candidates come from MinHash: BANDS keys, each of ROWS minima over the set, and
texts that share a key may be near copies. Of a pair at 0.8 the keys miss 3 in a million, of nearer pairs fewer;
64-bit fingerprints would need a radius of some 11 bits, at which nearly every two share a key. Each candidate pair is
checked by the sets themselves, so a link is never a guess.

First neighbours in the order of set size are checked, in each chunk of a bucket and between the chunks' first nodes, which
joins most of a group at little cost. Then the sets of each bucket that is not yet in one component come together, and a
task counts what every two of them share, in numpy: it gives a forest of links, never pairs. A large bucket is cut into
chunks, each two a task of their own, so memory is bounded and no pair is left out. Only ids, keys and the sets of candidates move, and the texts of those.

Defined results: words and case as in simhash.fingerprint; a text of under five words is one shingle, a wordless or null
text the empty set, which equals itself only. Of a component the row with the smallest (doc_id, digest of the whole row)
stays, a null doc_id after all others; of rows alike in all columns one. Very long texts are read whole, a task holds
one at a time. Other columns may have any name. An empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from seqloom.llm._common import forget, hot_lookup, hot_ties, picked, row_tie, stored, text_of
from seqloom.llm.simhash import _LOWER, SEED, fingerprint, links, stars

WIDTH, BANDS, ROWS = 5, 24, 4
#: Similarity from which two texts are near copies, as a fraction.
NEAR = (4, 5)
#: Nodes, and members of their sets, that make one chunk of a bucket.
CHUNK, MEMBERS = 1024, 1 << 21
#: A member of at most so many sets of a task is counted by pairs of sets.
FEW = 16
_RNG = np.random.default_rng(SEED)
_XOR = _RNG.integers(0, 1 << 63, BANDS * ROWS, dtype=np.uint64)[:, None] * np.uint64(2)
_MUL = _RNG.integers(0, 1 << 63, BANDS * ROWS, dtype=np.uint64)[:, None] * np.uint64(2) + np.uint64(1)


def shingles(text: str | None) -> np.ndarray:
    """The distinct XXH64 hashes of the text's five-word shingles, sorted."""
    words = (text or "").encode("utf-8", "surrogatepass").translate(_LOWER).split()
    if not words:
        return np.zeros(0, np.uint64)
    width = min(WIDTH, len(words))
    joined = b" ".join(words)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    starts = np.concatenate(([0], ends[:-1] + 1))[: len(words) - width + 1].tolist()
    digest = xxhash.xxh64_intdigest
    return np.unique(np.fromiter((digest(joined[a:b], SEED) for a, b in zip(starts, ends[width - 1 :].tolist(), strict=True)), np.uint64, len(starts)))


def band_keys(found: np.ndarray) -> np.ndarray:
    """BANDS signed 64-bit keys, no two bands alike."""
    least = np.full((BANDS * ROWS, 1), 0xFFFFFFFFFFFFFFFF, np.uint64)
    for at in range(0, len(found), 1024):
        least = np.minimum(least, ((found[None, at : at + 1024] ^ _XOR) * _MUL).min(axis=1, keepdims=True))
    raw = np.ascontiguousarray(least).tobytes()
    step = ROWS * 8
    return np.array([xxhash.xxh64_intdigest(raw[k * step : (k + 1) * step], k) for k in range(BANDS)], np.uint64).view(np.int64)


def alike(a: np.ndarray, b: np.ndarray) -> bool:
    """Whether two sorted sets have the similarity NEAR."""
    both = len(np.intersect1d(a, b, assume_unique=True))
    return both * NEAR[1] >= (len(a) + len(b) - both) * NEAR[0]


def keyed_rows(docs: DataFrame) -> DataFrame:
    """(doc_id, tie, fp, node, check, size, keys) for every row of docs; fp: the SimHash fingerprint; node and check: two hashes of the whole set, 128 bits in all."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            fps, nodes, checks, sizes, keys = [], [], [], [], []
            for x in b.column(2):
                fps.append(fingerprint(x.as_py()))
                found = shingles(x.as_py())
                both = xxhash.xxh3_128_intdigest(found.tobytes(), SEED)
                nodes.append(both & 0xFFFFFFFFFFFFFFFF)
                checks.append(both >> 64)
                sizes.append(len(found))
                keys.append(band_keys(found))
            flat = pa.array(np.concatenate(keys) if keys else np.zeros(0, np.int64))
            lists = pa.ListArray.from_arrays(pa.array(np.arange(len(keys) + 1) * BANDS, pa.int32()), flat)
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), *(pa.array(np.array(x, np.uint64).view(np.int64)) for x in (fps, nodes, checks)), pa.array(sizes, pa.int32()), lists], ["doc_id", "tie", "fp", "node", "check", "size", "keys"])

    keyed = docs.select(docs["doc_id"].cast("bigint").alias("doc_id"), row_tie(docs).alias("tie"), text_of(docs).alias("text"))
    return keyed.mapInArrow(run, "doc_id bigint, tie string, fp bigint, node bigint, check bigint, size int, keys array<bigint>")


def name_of(n: int) -> Column:
    """The 64-bit name of a set after n clashes."""
    return F.col("node") if n == 0 else F.xxhash64("node", "check", F.lit(n))


def nodes_of(rows: DataFrame) -> DataFrame:
    """(node, best, size, keys): as named_nodes."""
    return named_nodes(rows)[0]


def named_nodes(rows: DataFrame) -> tuple[DataFrame, int]:
    """(node, best, size, keys): a row per distinct set of rows (doc_id, tie, node, check, size, keys), best the row that stays of it; and the n of name_of.

    Sets are told apart by node and check, 128 bits. Where different sets share a node, all sets get other 64-bit names, until no two share one.
    """
    order, n = F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id", "tie"), 0
    while True:
        name = name_of(n)
        whole = F.struct("node", "check")
        each = rows.withColumn("whole", whole).groupBy(name.alias("node")).agg(
            F.min(order).alias("best"), F.first("size").alias("size"), F.first("keys").alias("keys"), F.min("whole").alias("lo"), F.max("whole").alias("hi")
        )
        found = stored(each, "nodes")
        if found.filter("lo != hi").isEmpty():
            return found.drop("lo", "hi"), n
        forget(found)
        n += 1


def _sizes_fit() -> Column:
    return F.least("su", "sv") * NEAR[1] >= F.greatest("su", "sv") * NEAR[0]


def shared_counts(sets: list[np.ndarray]) -> np.ndarray:
    """(n, n): above the diagonal, how many members two sorted sets share. Members of few sets are counted by pairs of these
    sets, those of many as bit planes of which two rows are and-ed and their bits counted."""
    n = len(sets)
    owner = np.repeat(np.arange(n), [len(s) for s in sets])
    flat = np.concatenate(sets)
    order = np.argsort(flat, kind="stable")  # owners of a member come in ascending order
    flat, owner = flat[order], owner[order]
    first = np.flatnonzero(np.concatenate(([True], flat[1:] != flat[:-1]))) if len(flat) else np.zeros(0, np.int64)
    times = np.diff(np.append(first, len(flat)))
    both = np.zeros(n * n, np.int64)
    for c in range(2, min(FEW, n) + 1):
        i, j = np.triu_indices(c, 1)
        own = first[times == c]
        step = max(1, (1 << 21) // len(i))
        for at in range(0, len(own), step):
            of = owner[own[at : at + step, None] + np.arange(c)]
            both += np.bincount((of[:, i] * n + of[:, j]).ravel(), minlength=n * n)
    both = both.reshape(n, n)
    wide = np.flatnonzero(times > FEW)
    for at in range(0, len(wide), 4096):
        own = wide[at : at + 4096]
        bits = np.zeros((n, -(-len(own) // 64) * 64), np.uint8)
        for k, m in enumerate(own):
            bits[owner[first[m] : first[m] + times[m]], k] = 1
        planes = np.packbits(bits, axis=1, bitorder="little").view(np.uint64)
        for i in range(n - 1):
            both[i, i + 1 :] += np.bitwise_count(planes[i + 1 :] & planes[i]).sum(axis=1, dtype=np.int64)
    return both


def spanning(nodes: np.ndarray, roots: np.ndarray, sets: list[np.ndarray]) -> list[tuple[int, int]]:
    """Links (u, v), u > v, that join what the links among the nodes join beyond the components, told by their roots, that are known."""
    label, out = roots.copy(), []

    def join(i: int, others: np.ndarray) -> None:
        for j in others:
            if label[j] != label[i]:
                out.append((max(nodes[i], nodes[j]), min(nodes[i], nodes[j])))
                label[label == label[j]] = label[i]

    if len(nodes) <= 6:
        for i in range(len(nodes)):
            join(i, [j for j in range(i + 1, len(nodes)) if label[j] != label[i] and alike(sets[i], sets[j])])
        return out
    size = np.array([len(s) for s in sets])
    both = shared_counts(sets)
    near = both * NEAR[1] >= (size[:, None] + size[None, :] - both) * NEAR[0]
    for i in range(len(nodes) - 1):
        at = i + 1 + np.flatnonzero(near[i, i + 1 :])
        if len(at):
            join(i, at[np.unique(label[at], return_index=True)[1]])
    return out


def _sets(docs: DataFrame, nodes: DataFrame, need: DataFrame) -> DataFrame:
    """(node, found): the set of each node in need (node), as bytes."""
    wanted = need.distinct().join(nodes, "node").select("node", F.col("best.tie").alias("k"))
    texts = docs.select(row_tie(docs).alias("k"), text_of(docs).alias("text"))

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([shingles(x.as_py()).tobytes() for x in b.column(1)], pa.binary())], ["node", "found"])

    found = texts.join(wanted, "k").select("node", "text").mapInArrow(read, "node bigint, found binary")
    return stored(found.dropDuplicates(["node"]), "shingles")


def _checked(found: DataFrame, pairs: DataFrame) -> DataFrame:
    """Those of the pairs (u, v) whose sets are alike."""

    def check(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            ok = [alike(np.frombuffer(x.as_py(), np.uint64), np.frombuffer(y.as_py(), np.uint64)) for x, y in zip(b.column(2), b.column(3), strict=True)]
            yield b.select(["u", "v"]).filter(pa.array(ok, pa.bool_()))

    both = pairs.select("u", "v").join(found.select(F.col("node").alias("u"), F.col("found").alias("a")), "u")
    both = both.join(found.select(F.col("node").alias("v"), F.col("found").alias("b")), "v").select("u", "v", "a", "b")
    return both.mapInArrow(check, "u bigint, v bigint")


def _within(left: DataFrame) -> DataFrame:
    """From (key, a, b, node, root, found), the members of a bucket's pair of chunks: links that join them. No pairs are made but in numpy."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held_key, held = None, []

        def close() -> Iterator[pa.RecordBatch]:
            if len(held) > 1:
                got = spanning(np.array([x[0] for x in held]), np.array([x[1] for x in held]), [x[2] for x in held])
                if got:
                    yield pa.RecordBatch.from_arrays([pa.array([int(x[k]) for x in got], pa.int64()) for k in (0, 1)], ["u", "v"])
            held.clear()

        for b in batches:
            for *key, node, root, found in zip(*(b.column(k).to_pylist() for k in range(6)), strict=True):
                if key != held_key:
                    yield from close()
                    held_key = key
                held.append((node, root, np.frombuffer(found, np.uint64)))
        yield from close()

    return left.repartition("key", "a", "b").sortWithinPartitions("key", "a", "b").mapInArrow(run, "u bigint, v bigint").distinct()


def _after(rows: DataFrame, *by: str) -> DataFrame:
    """rows with o and so: node and size of the one before in the order of size."""
    before = lambda c: F.lag(c).over(W.partitionBy(*by).orderBy("size", "node"))
    return rows.withColumn("o", before("node")).withColumn("so", before("size"))


def fingerprint_links(rows: DataFrame) -> DataFrame:
    """Edges (u, v), u > v, of the nodes that a component of fingerprints holds: each with the component's smallest."""
    fps = stored(rows.groupBy("fp").agg(F.count(F.lit(1)).alias("n")), "fps")
    star = stars(links(fps.select("fp")))
    rooted = stored(fps.join(star, "fp", "left").select("fp", "n", F.coalesce("root", "fp").alias("root")), "roots")
    of = hot_lookup(rows.select("fp", "node"), rooted, "fp", "n", rows.count()).select("node", "root").distinct()
    of = stored(of, "rooted")
    least = stored(of.groupBy("root").agg(F.min("node").alias("v"), F.count(F.lit(1)).alias("n")).filter("n > 1"), "least")
    return hot_lookup(of, least, "root", "n", of.count()).filter("node != v").select(F.col("node").alias("u"), "v")


def components(docs: DataFrame, rows: DataFrame) -> tuple[DataFrame, DataFrame]:
    """From keyed_rows: nodes (node, best), best the row that stays of it, and (fp, root) of the nodes that have a smaller one in their component."""
    nodes, n = named_nodes(rows)
    by_fp = stored(fingerprint_links(rows.select("fp", name_of(n).alias("node"))), "by_fingerprint")
    keyed = nodes.select("node", "size", F.explode("keys").alias("key"))
    full = stored(keyed.groupBy("key").agg(F.count(F.lit(1)).alias("n")).filter("n > 1"), "buckets")
    bucketed = stored(hot_lookup(keyed, full, "key", "n", nodes.count() * BANDS), "bucketed")

    # neighbours by size within each chunk of a bucket, then the chunks' first nodes
    part = F.pmod(F.xxhash64("node"), F.ceil(F.col("n") / CHUNK))
    chain = stored(_after(bucketed.withColumn("part", part), "key", "part"), "chain")
    heads = _after(chain.filter(F.col("o").isNull() & (F.col("n") > CHUNK)).drop("o", "so"), "key")
    ends = (F.greatest("node", "o").alias("u"), F.least("node", "o").alias("v"), F.col("size").alias("su"), F.col("so").alias("sv"))
    tried = chain.unionByName(heads).filter("o is not null").select(*ends)
    pairs = stored(tried.filter(_sizes_fit()).select("u", "v").distinct(), "pairs")
    found = _sets(docs, nodes, pairs.select(F.col("u").alias("node")).union(pairs.select(F.col("v").alias("node"))))
    edges = stored(_checked(found, pairs).unionByName(by_fp), "alike")
    forget(found, chain)
    star = stored(stars(edges), "stars")

    # buckets of three or more whose nodes are not in one component yet; those of two are settled
    met = bucketed.filter("n > 2").drop("n").join(star.withColumnRenamed("fp", "node"), "node", "left").withColumn("root", F.coalesce("root", "node"))
    met = stored(met, "met")
    open_ = met.groupBy("key").agg(F.count(F.lit(1)).alias("n"), F.sum("size").alias("members"), F.min("root").alias("lo"), F.max("root").alias("hi")).filter("lo < hi")
    n_chunks = F.ceil(F.greatest(F.col("n") / CHUNK, F.col("members") / MEMBERS)).cast("int")
    left = hot_lookup(met, stored(open_.select("key", "n", n_chunks.alias("chunks")), "chunks"), "key", "n", met.count())
    left = left.withColumn("c", F.pmod(F.xxhash64("node"), F.col("chunks")).cast("int"))
    left = left.withColumn("with", F.explode(F.sequence(F.lit(0), F.col("chunks") - 1)))
    left = stored(left.select("key", F.least("c", "with").alias("a"), F.greatest("c", "with").alias("b"), "node", "root"), "open")
    found = _sets(docs, nodes, left.select("node"))
    more = stored(_within(left.join(found, "node").select("key", "a", "b", "node", "root", "found")), "alike")
    forget(found)
    if more.isEmpty():
        return nodes, star
    return nodes, stored(stars(edges.unionByName(more)), "stars")


def without_near_copies(docs: DataFrame) -> DataFrame:
    """docs with one row of each component of near copies; all columns as they were."""
    rows = stored(keyed_rows(docs), "bands")
    nodes, star = components(docs, rows)
    placed = nodes.select("node", "best").join(star.withColumnRenamed("fp", "node"), "node", "left")
    keep = stored(placed.groupBy(F.coalesce("root", "node").alias("root")).agg(F.min("best").alias("best")).select(F.col("best.tie").alias("k")), "keep")
    return picked(docs, keep, hot_ties(rows.select(F.col("tie").alias("k")), rows.count())).select("row.*")
