"""SimHash near-dedup by bit-sliced comparison.

A document's fingerprint has bit b set if over half the XXH64 hashes of its word shingles have it. Equal
fingerprints are one node. Two fingerprints within the radius r agree on at least BLOCKS - r of
BLOCKS bit blocks, so they meet in a bucket of one of the tables that key on BLOCKS - r blocks. Within a bucket
the fingerprints are compared as bit planes: plane b holds bit b of all of them, 64 to a machine word; a
query's planes are xored in and added up by carry-save counters, many distances at a time, and a block of 64 lanes
is abandoned once every lane has passed the radius. A query looks at the lanes after its own, in the planes in which the
bucket's fingerprints differ.

No bucket gives out its pairs: it gives a forest that spans its links, so at most one edge per
fingerprint. A bucket with over LANES fingerprints is cut into chunks and each pair of chunks is
a task of its own, so memory is bounded and no pair is missed. Components come from alternating large-star and
small-star rounds over the edges, stored between rounds; hubs are looked up by broadcast (see hot_lookup).

Defined results: a null or wordless text has fingerprint zero and links like any other. A component's id
is the smallest doc_id in it, null only if all are. A very long text is hashed whole, 65,536 shingles at a time. Rows that repeat a doc_id or
text each get their result. Columns besides doc_id and text are not read and may have any name. An empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from seqloom.llm._common import forget, hot_lookup, stored

SEED = 42
#: Fingerprints compared as one block: 64 words of 64 lanes.
LANES = 4096
_LOWER = bytes(c + 32 if 65 <= c <= 90 else c for c in range(256))
#: Row v: the 8 bits of v, lowest first.
_BITS = np.unpackbits(np.arange(256, dtype=np.uint8)[:, None], axis=1, bitorder="little").astype(np.int64)


def fingerprint(text: str | None, width: int = 3, seed: int = SEED) -> int:
    """The 64-bit SimHash of a text; long texts are hashed 65,536 shingles at a time."""
    words = (text or "").encode("utf-8", "surrogatepass").translate(_LOWER).split()
    if not words:
        return 0
    width = min(width, len(words))
    joined = b" ".join(words)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    starts = np.concatenate(([0], ends[:-1] + 1))[: len(words) - width + 1].tolist()
    ends = ends[width - 1 :].tolist()
    digest, count = xxhash.xxh64_intdigest, np.zeros((8, 256), np.int64)
    for at in range(0, len(starts), 65536):
        h = np.fromiter((digest(joined[a:b], seed) for a, b in zip(starts[at : at + 65536], ends[at : at + 65536], strict=True)), np.uint64)
        by_byte = h.view(np.uint8).reshape(-1, 8)
        for k in range(8):
            count[k] += np.bincount(by_byte[:, k], minlength=256)
    ones = (count @ _BITS).reshape(64)
    return int(np.packbits(ones * 2 > len(starts), bitorder="little").view(np.uint64)[0])


def fingerprints(docs: DataFrame, width: int = 3, seed: int = SEED) -> DataFrame:
    """(doc_id, fp) with fp as a signed 64-bit integer."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            fps = np.array([fingerprint(x.as_py(), width, seed) for x in b.column(1)], dtype=np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(fps)], ["doc_id", "fp"])

    return docs.select(docs["doc_id"].cast("bigint").alias("doc_id"), docs["text"].cast("string").alias("text")).mapInArrow(run, "doc_id bigint, fp bigint")


def planes_of(fps: np.ndarray) -> np.ndarray:
    """(64, words): plane b has bit b of every fingerprint, 64 lanes to a word; the last word is padded with zeros."""
    lanes = -(-len(fps) // 64) * 64
    bits = np.zeros((lanes, 64), np.uint8)
    bits[: len(fps)] = np.unpackbits(fps.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
    return np.ascontiguousarray(np.packbits(bits.T, axis=1, bitorder="little")).view(np.uint64)


_FULL = np.uint64(0xFFFFFFFFFFFFFFFF)


def near(planes: np.ndarray, queries: np.ndarray, radius: int, skip: np.ndarray | None = None, order: np.ndarray | None = None) -> tuple[np.ndarray, int]:
    """(queries, words): lanes within the radius of each query but those in skip, and how many blocks were abandoned.

    A block is a query against a word of 64 lanes. Distances of all its lanes grow together in a vertical counter of few bits; a
    lane that overflows is out for good, and a block whose lanes are all out takes no part in the planes that are left.
    order: the planes to look at; those in which nothing differs may be left out.
    """
    n_words, n_bits = planes.shape[1], int(radius + 1).bit_length()
    out = np.full(len(queries) * n_words, _FULL)
    over = np.zeros(len(out), np.uint64) if skip is None else skip.ravel().copy()
    live = np.flatnonzero(over != _FULL)
    over, abandoned = over[live], 0
    query, word = np.divmod(live, n_words)
    counter = np.zeros((n_bits, len(live)), np.uint64)
    for step, b in enumerate(range(64) if order is None else order):
        carry = planes[b][word] ^ np.where((queries >> np.uint64(b)) & np.uint64(1), _FULL, np.uint64(0))[query]
        for k in range(n_bits):
            counter[k], carry = counter[k] ^ carry, counter[k] & carry
        over |= carry
        if step > radius and step % 4 == 3:
            over |= _above(counter, radius)
            stay = over != _FULL
            gone = len(stay) - int(stay.sum())
            if gone:
                abandoned += gone
                live, over, query, word, counter = live[stay], over[stay], query[stay], word[stay], counter[:, stay]
    out[live] = over | _above(counter, radius)
    return ~out.reshape(len(queries), n_words), abandoned


def _above(counter: np.ndarray, radius: int) -> np.ndarray:
    """Lanes whose counter is over the radius."""
    above, equal = np.zeros_like(counter[0]), np.full_like(counter[0], 0xFFFFFFFFFFFFFFFF)
    for k in reversed(range(len(counter))):
        if radius >> k & 1:
            equal &= counter[k]
        else:
            above |= equal & counter[k]
            equal &= ~counter[k]
    return above


def differing(fps: np.ndarray) -> np.ndarray:
    """The bits in which not all fingerprints agree: those of a bucket share the bits of its key."""
    spread = np.bitwise_or.reduce(fps) ^ np.bitwise_and.reduce(fps)
    return np.flatnonzero((spread >> np.arange(64, dtype=np.uint64)) & np.uint64(1))


def lanes_up_to(first: int, n_queries: int, n_words: int, n: int) -> np.ndarray:
    """(queries, words): for query k the lanes up to its own, first + k, and those past the last, n: only later ones are asked for."""
    lane = np.arange(n_words * 64)
    closed = (lane[None, :] <= (first + np.arange(n_queries))[:, None]) | (lane >= n)[None, :]
    return np.ascontiguousarray(np.packbits(closed, axis=1, bitorder="little")).view(np.uint64)


def forest(fps: np.ndarray, radius: int) -> np.ndarray:
    """(edges, 2): each fingerprint of a linked set with the set's smallest; fps are distinct."""
    n, label = len(fps), np.arange(len(fps))
    planes, order = planes_of(fps), differing(fps)
    for at in range(0, n, 256):
        asked = fps[at : at + 256]
        found, _ = near(planes, asked, radius, lanes_up_to(at, len(asked), planes.shape[1], n), order)
        for i in np.flatnonzero(found.any(axis=1)):
            lanes = np.flatnonzero(np.unpackbits(np.ascontiguousarray(found[i]).view(np.uint8), bitorder="little"))
            met = np.unique(label[np.append(lanes, at + i)])
            if len(met) > 1:
                label[np.isin(label, met)] = met[0]
    signed = fps.view(np.int64)
    roots = np.full(n, np.iinfo(np.int64).max)
    np.minimum.at(roots, label, signed)
    to = roots[label]
    moved = to != signed
    return np.stack([signed[moved], to[moved]], axis=1)


def small_forests(fps: np.ndarray, starts: np.ndarray, radius: int) -> np.ndarray:
    """Edges of many small buckets at once: the xors of their pairs are themselves sliced into bit planes. Of a bucket's links those go out that
    join what the ones before them had not joined, fewer than it has fingerprints."""
    left, right = [], []
    for a, b in zip(starts[:-1], starts[1:], strict=True):
        i, j = np.triu_indices(b - a, 1)
        left.append(i + a)
        right.append(j + a)
    i, j = np.concatenate(left), np.concatenate(right)
    out = []
    for at in range(0, len(i), 65536):
        x = fps[i[at : at + 65536]] ^ fps[j[at : at + 65536]]
        planes = planes_of(x)
        found, _ = near(planes, np.zeros(1, np.uint64), radius, lanes_up_to(-1, 1, planes.shape[1], len(x)))
        ok = np.flatnonzero(np.unpackbits(found[0].view(np.uint8), bitorder="little")[: len(x)])
        out.append(np.stack([i[at + ok], j[at + ok]], axis=1))
    label, kept = list(range(len(fps))), []

    def root(x: int) -> int:
        while label[x] != x:
            label[x] = label[label[x]]
            x = label[x]
        return x

    for a, b in np.concatenate(out).tolist():
        x, y = root(a), root(b)
        if x != y:
            label[max(x, y)] = min(x, y)
            kept.append((a, b))
    return fps[np.array(kept, np.int64).reshape(-1, 2)].view(np.int64)


def tables(radius: int) -> list[int]:
    """Bit masks of the tables: each keys on the blocks that two near fingerprints may share. radius + 2 blocks: any two agree on two at least."""
    n = radius + 2
    edges = [64 * k // n for k in range(n + 1)]
    masks = [sum(1 << b for b in range(edges[k], edges[k + 1])) for k in range(n)]
    return [sum(m) for m in combinations(masks, 2)]


def _signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def links(nodes: DataFrame, radius: int = 2) -> DataFrame:
    """Edges (u, v), u > v, that span the links among the distinct fingerprints `fp` of nodes."""
    masks = tables(radius)
    keyed = nodes.select("fp", F.posexplode(F.array(*[F.col("fp").bitwiseAND(F.lit(_signed(m)).cast("bigint")) for m in masks])).alias("t", "key"))
    keyed = keyed.select("fp", F.struct("t", "key").alias("bucket"))
    full = stored(keyed.groupBy("bucket").agg(F.count(F.lit(1)).alias("n")).filter("n > 1"), "buckets")
    # a bucket of very many fingerprints learns its size by broadcast, so it does not meet in one task before it is cut into chunks
    met = hot_lookup(keyed, full, "bucket", "n", nodes.count() * len(masks)).select("fp", "bucket.t", "bucket.key", "n")
    n_chunks = F.ceil(F.col("n") / (LANES // 2)).cast("int")
    met = met.withColumn("c", F.pmod(F.xxhash64("fp"), n_chunks).cast("int")).withColumn("o", F.explode(F.sequence(F.lit(0), n_chunks - 1)))
    met = met.select("fp", "t", "key", F.least("c", "o").alias("a"), F.greatest("c", "o").alias("b"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Buckets come sorted, each whole within the partition; small ones are gathered and compared together."""
        held_key, held, small, pairs = None, [], [], 0

        def flush(last: bool) -> Iterator[pa.RecordBatch]:
            nonlocal pairs
            if small and (last or pairs > 1 << 18):
                starts = np.cumsum([0, *map(len, small)])
                yield from emit(small_forests(np.concatenate(small), starts, radius))
                small.clear()
                pairs = 0

        def emit(edges: np.ndarray) -> Iterator[pa.RecordBatch]:
            if len(edges):
                yield pa.RecordBatch.from_arrays([pa.array(edges.max(axis=1)), pa.array(edges.min(axis=1))], ["u", "v"])

        def close() -> Iterator[pa.RecordBatch]:
            nonlocal pairs
            fps = np.unique(np.concatenate(held)).view(np.uint64) if held else np.zeros(0, np.uint64)
            held.clear()
            if len(fps) > 64:
                yield from emit(forest(fps, radius))
            elif len(fps) > 1:
                small.append(fps)
                pairs += len(fps) * (len(fps) - 1) // 2
                yield from flush(False)

        for batch in batches:
            if not batch.num_rows:
                continue
            cols = np.stack([batch.column(k).cast(pa.int64()).to_numpy() for k in (1, 2, 3, 4)])
            fps = batch.column(0).to_numpy()
            cuts = np.flatnonzero((cols[:, 1:] != cols[:, :-1]).any(axis=0)) + 1
            for a, b in zip([0, *cuts], [*cuts, len(fps)], strict=True):
                key = tuple(cols[:, a])
                if key != held_key:
                    yield from close()
                    held_key = key
                held.append(fps[a:b])
        yield from close()
        yield from flush(True)

    sorted_ = met.repartition("t", "key", "a", "b").sortWithinPartitions("t", "key", "a", "b")
    return sorted_.mapInArrow(run, "u bigint, v bigint").distinct()


def stars(edges: DataFrame) -> DataFrame:
    """(v, root) for every node v of the edges (u, v) but the roots: a component's root is its smallest node."""
    edges = stored(edges, "edges")
    said = None
    while True:
        count, total = edges.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if (count, total) == said or count == 0:
            return edges.select(F.col("u").alias("fp"), F.col("v").alias("root"))
        said = (count, total)
        # large star: every larger neighbour of u goes to the smallest of u and its neighbours
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = stored(both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"), F.count(F.lit(1)).alias("n")), "least")
        big = hot_lookup(both.filter("v > u"), least, "u", "n", 2 * count).select(F.col("v").alias("u"), F.col("m").alias("v"))
        big = stored(big.filter("u != v").distinct(), "large")
        # small star: u and its smaller neighbours go to the smallest of these
        n_big = big.count()
        lower = stored(big.groupBy("u").agg(F.min("v").alias("m"), F.count(F.lit(1)).alias("n")), "least")
        small = hot_lookup(big, lower, "u", "n", n_big).select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(lower.select("u", F.col("m").alias("v")))
        before, edges = edges, stored(small.filter("u != v").distinct(), "edges")
        forget(before, least, big, lower)


def components(docs: DataFrame, *, width: int = 3, radius: int = 2, seed: int = SEED) -> DataFrame:
    """(doc_id, fingerprint, component_id) for every row of docs."""
    rows = stored(fingerprints(docs, width, seed), "fingerprints")
    total = rows.count()
    nodes = stored(rows.groupBy("fp").agg(F.min("doc_id").alias("least_id"), F.count(F.lit(1)).alias("n")), "nodes")
    star = stars(links(nodes, radius))
    placed = stored(nodes.join(star, "fp", "left").withColumn("root", F.coalesce("root", "fp")), "placed")
    comp = stored(placed.groupBy("root").agg(F.min("least_id").alias("component_id"), F.count(F.lit(1)).alias("n_nodes")), "components")
    named = stored(hot_lookup(placed, comp, "root", "n_nodes", nodes.count()).select("fp", "n", "component_id"), "named")
    return hot_lookup(rows, named, "fp", "n", total).select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")
