"""Packing by non-negative least squares.

A task reads its documents in blocks of about BLOCK ids. Of a document longer than a window, whole windows are
sequences of their own; what is left, and every shorter document, is an item. Item lengths are counted in steps of
window / GRID. All combinations of up to DEPTH steps that fill a window exactly are the columns of a matrix, a row per
length; non-negative least squares finds how often to use each so that the histogram of items is met. The repeat counts
are rounded down and held to the stock, each use takes the longest items left of its lengths, and what is left is solved again
until no combination can be filled. The items that remain are packed
greedily: the largest that fits into each gap, then pieces cut to fill what is still open, then new windows one
after the other. What does not fill a window goes to the next block, and at the end of the task is
cut into sequences of powers of two, which need no padding. So no sequence is padded, and few documents are cut.

Documents never move between tasks, and a task holds one block, so memory doesn't grow with the input. A sequence's
id is the task's number and its own number there; reruns over the same input splits give the same sequences.

Defined results: a null text is empty and has the end id alone; rows that repeat a doc_id are documents of their own; an
empty table gives no pieces; a document of any length is packed whole; other columns are not read and may have any name.
"""

from __future__ import annotations

import bisect
import zlib
from collections import defaultdict
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame

from seqloom.llm._common import text_of
from seqloom.llm.wordcache import word_encoder

WINDOW, GRID, DEPTH, BLOCK = 4096, 64, 3, 1 << 22


@dataclass
class Item:
    """ids[start:start + len(ids)] of a document."""

    doc_id: int | None
    start: int
    ids: np.ndarray
    doc_tokens: int

    def cut(self, n: int) -> tuple[Item, Item]:
        return Item(self.doc_id, self.start, self.ids[:n], self.doc_tokens), Item(self.doc_id, self.start + n, self.ids[n:], self.doc_tokens)


@lru_cache(maxsize=4)
def combinations_of(grid: int, depth: int) -> np.ndarray:
    """(grid + 1, columns): how often each length in steps occurs in each combination of 1 to depth lengths that sums to grid."""
    found = []

    def extend(parts: tuple[int, ...], left: int) -> None:
        if not left:
            found.append(parts)
        elif len(parts) < depth:
            for x in range(min(left, parts[-1] if parts else grid), 0, -1):
                extend((*parts, x), left - x)

    extend((), grid)
    matrix = np.zeros((grid + 1, len(found)))
    for k, parts in enumerate(found):
        for x in parts:
            matrix[x, k] += 1
    return matrix


def nnls(a: np.ndarray, b: np.ndarray, steps: int = 300) -> np.ndarray:
    """x >= 0 that minimises |a x - b|, by active sets (Lawson and Hanson). After `steps` steps the best so far stands: packing stays
    right with any repeat counts, only less tight."""
    n = a.shape[1]
    ata, atb = a.T @ a, a.T @ b
    x, free = np.zeros(n), np.zeros(n, bool)
    gradient = atb.copy()
    for _ in range(steps):
        k = int(np.argmax(np.where(free, -np.inf, gradient)))
        if free[k] or gradient[k] <= 1e-8 * (1 + abs(atb).max()):
            break
        free[k] = True
        while True:
            idx = np.flatnonzero(free)
            z = np.linalg.lstsq(ata[np.ix_(idx, idx)], atb[idx], rcond=None)[0]
            bad = z <= 1e-10
            if not bad.any():
                x[:] = 0
                x[idx] = z
                break
            was = x[idx]
            step = np.min(was[bad] / np.maximum(was[bad] - z[bad], 1e-300))
            x[idx] = was + step * (z - was)
            drop = idx[bad & (x[idx] <= 1e-10)]
            drop = drop if len(drop) else idx[bad][:1]
            x[drop] = 0
            free[drop] = False
            if not free.any():
                break
        gradient = atb - ata @ x
    return x


def repeat_counts(stock: dict[int, int], grid: int, depth: int) -> list[tuple[list[int], int]]:
    """(lengths, times) of the combinations to use: least squares against the stock, rounded down, and never more than there is.

    Only combinations whose lengths are all there take part. A length counts by 1 / its stock, so that few of it are not asked for
    many times over; where rounding leaves nothing, the combination asked for most is used once.
    """
    columns = combinations_of(grid, depth)
    have = np.zeros(grid + 1)
    for k, n in stock.items():
        have[k] = n
    fits = np.flatnonzero((columns <= have[:, None]).all(axis=0))
    if not len(fits):
        return []
    rows = np.flatnonzero(have)
    weight = 1 / np.sqrt(have[rows])
    x = nnls(columns[np.ix_(rows, fits)] * weight[:, None], have[rows] * weight)
    out, left = [], have.copy()
    for k in np.argsort(-x, kind="stable"):
        need = columns[:, fits[k]]
        times = int(min(np.floor(x[k] + 1e-6) if out or x[k] >= 1 else 1, (left[need > 0] // need[need > 0]).min()))
        if times < 1:
            if out:
                break
            continue
        left -= need * times
        out.append(([int(z) for z in np.flatnonzero(need) for _ in range(int(need[z]))], times))
    return out


def pack(items: list[Item], window: int = WINDOW, grid: int = GRID, depth: int = DEPTH) -> tuple[list[list[Item]], list[Item]]:
    """Full sequences, and items (fewer than a window of ids in all) that are left. Every sequence has window ids."""
    done: list[list[Item]] = []
    short: list[Item] = []
    for x in items:
        while len(x.ids) >= window:
            head, x = x.cut(window)
            done.append([head])
        if len(x.ids):
            short.append(x)
    step = window // grid
    by: dict[int, list[Item]] = defaultdict(list)
    for x in sorted(short, key=lambda x: len(x.ids)):
        by[-(-len(x.ids) // step)].append(x)
    opened: list[list[Item]] = []
    while use := repeat_counts({k: len(xs) for k, xs in by.items()}, grid, depth):
        for lengths, times in use:
            opened += [[by[x].pop() for x in lengths] for _ in range(times)]
    pool = sorted((x for xs in by.values() for x in xs), key=lambda x: len(x.ids))
    fill = lambda seq: sum(len(x.ids) for x in seq)
    gaps = [window - fill(s) for s in opened]
    held, lacking = sum(len(x.ids) for x in pool), sum(gaps)
    # what is to fill the gaps must be there: the openest sequences are taken apart until it is
    for k in sorted(range(len(opened)), key=gaps.__getitem__, reverse=True):
        if held >= lacking:
            break
        held += window - gaps[k]
        lacking -= gaps[k]
        pool += opened[k]
        opened[k] = []
    pool.sort(key=lambda x: len(x.ids))
    sizes = [len(x.ids) for x in pool]
    cutting: Item | None = None

    def take(room: int) -> Item:
        """The largest item that fits, else a piece of the item being cut, which is the largest."""
        nonlocal cutting
        at = bisect.bisect_right(sizes, room) - 1
        if at >= 0:
            sizes.pop(at)
            return pool.pop(at)
        if cutting is None:
            sizes.pop()
            cutting = pool.pop()
        if len(cutting.ids) <= room:
            piece, cutting = cutting, None
            return piece
        piece, cutting = cutting.cut(room)
        return piece

    left = held
    for seq in opened:
        if not seq:
            continue
        room = window - fill(seq)
        while room:
            seq.append(piece := take(room))
            room -= len(piece.ids)
            left -= len(piece.ids)
        done.append(seq)
    while left >= window:
        seq, room = [], window
        while room:
            seq.append(piece := take(room))
            room -= len(piece.ids)
        left -= window
        done.append(seq)
    return done, pool + ([cutting] if cutting is not None else [])


def powers(items: list[Item]) -> list[list[Item]]:
    """The items in sequences whose lengths are falling powers of two."""
    left = sum(len(x.ids) for x in items)
    out, queue = [], items[::-1]
    while left:
        room, seq = 1 << (left.bit_length() - 1), []
        left -= room
        while room:
            x = queue.pop()
            if len(x.ids) > room:
                x, rest = x.cut(room)
                queue.append(rest)
            seq.append(x)
            room -= len(x.ids)
        out.append(seq)
    return out


_FIELDS = (("doc_id", pa.int64()), ("start", pa.int64()), ("length", pa.int64()), ("ids_crc32", pa.int64()), ("doc_tokens", pa.int64()), ("sequence_id", pa.int64()), ("offset", pa.int64()), ("ids", pa.binary()))


def packed(docs: DataFrame, vocabulary: str, *, spaced: bool = False, end_id: int = 2, window: int = WINDOW, with_ids: bool = True) -> DataFrame:
    """A row per piece: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset, ids (binary, unsigned 32-bit)."""
    fields = _FIELDS if with_ids else _FIELDS[:-1]

    def rows(sequences: list[list[Item]], first: int) -> Iterator[pa.RecordBatch]:
        out = []
        for number, seq in enumerate(sequences, first):
            at = 0
            for x in seq:
                raw = x.ids.astype("<u4").tobytes()
                out.append((x.doc_id, x.start, len(x.ids), zlib.crc32(raw), x.doc_tokens, number, at, raw)[: len(fields)])
                at += len(x.ids)
            if len(out) >= 4096:
                yield batch(out)
                out = []
        if out:
            yield batch(out)

    def batch(out: list[tuple]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, (_, t) in zip(zip(*out, strict=True), fields, strict=True)], schema=pa.schema(list(fields)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, number = word_encoder(vocabulary, spaced), TaskContext.get().partitionId() << 40
        end, block, size = np.array([end_id], "<u4"), [], 0
        for b in batches:
            for doc_id, raw in zip(b.column(0).to_pylist(), encoder.encode_many(b.column(1).to_pylist()), strict=True):
                ids = np.concatenate((raw, end))
                block.append(Item(doc_id, 0, ids, len(ids)))
                size += len(ids)
                if size >= BLOCK:
                    done, block = pack(block, window)
                    yield from rows(done, number)
                    number, size = number + len(done), sum(len(x.ids) for x in block)
        done, block = pack(block, window) if block else ([], [])
        yield from rows(done, number)
        yield from rows(powers(block), number + len(done))

    text = text_of(docs)
    keyed = docs.select(docs["doc_id"].cast("bigint").alias("doc_id"), text.alias("text"))
    return keyed.mapInArrow(run, ", ".join(f"{n} {'binary' if n == 'ids' else 'bigint'}" for n, _ in fields))
