"""Counts of long words by super-k-mers: neighbouring windows travel as one string.

A window's minimizer is the least hash of its words of M letters. Windows side by side that share it are sent as the one string they
lie in, some twelve windows to a string at 31 letters, to the task of that minimizer, which cuts the strings up again and counts, in numpy
and minimizer after minimizer, so it hands on finished counts alone. A word has one minimizer, so its counts meet there and nothing is shuffled twice. Minimizers of very many windows (fewer than 512 can be) are counted in each task first
and then by word, so no task takes a hot one whole. Sequences are taken in the blocks of counting.blocks, so a long one is many rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from seqloom.operators.counting import PIECE, blocks, count_words, counted_words, flat_symbols, words_at
from seqloom.sources.shared import kept

#: Letters of the words that minimizers are taken from.
M = 11
#: A minimizer is hot if it holds over one in HOT_SHARE windows.
HOT_SHARE = 512
_BASE = np.uint64(0x9E3779B97F4A7C15)


def minimizers(codes: np.ndarray, k: int, m: int) -> np.ndarray:
    """The minimizer of each of the windows of k symbols, symbols given as numbers."""
    n = len(codes) - m + 1
    h = np.zeros(n, np.uint64)
    for j in range(m):
        h = h * _BASE + codes[j : j + n].astype(np.uint64) + np.uint64(1)
    h ^= h >> np.uint64(29)
    h *= np.uint64(0xBF58476D1CE4E5B9)
    h ^= h >> np.uint64(32)
    # least of k - m + 1 hashes: of spans that double, and of two that overlap in the end
    width, span = k - m + 1, 1
    while 2 * span <= width:
        h = np.minimum(h[:-span], h[span:])
        span *= 2
    return h if span == width else np.minimum(h[: len(h) - (width - span)], h[width - span :])


def runs(symbols: np.ndarray, ends: np.ndarray, k: int, m: int = M) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(sequence, minimizer, start, end) of each run of windows that share one, in sequences laid end to end that end at `ends`."""
    if len(symbols) < k:
        return (np.zeros(0, np.int64),) * 4
    least = minimizers(symbols, k, min(m, k))
    own = np.repeat(np.arange(len(ends)), np.diff(ends, prepend=0))[: len(least)]
    inside = np.arange(k, len(least) + k) <= ends[own]
    new = np.concatenate([[True], (least[1:] != least[:-1]) | (own[1:] != own[:-1]) | ~inside[:-1]]) & inside
    begins = np.flatnonzero(new)
    # a run ends before the next one's first window, or with its sequence
    stop = np.minimum(np.append(begins[1:], len(symbols)) + k - 1, ends[own[begins]])
    return own[begins], least[begins].astype(np.int64), begins, stop


def super_kmers(reads: DataFrame, k: int, m: int = M) -> DataFrame:
    """(grp, minimizer, part): every window of k letters of (grp, seq) lies in one part."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for b in (whole.slice(at, 256) for at in range(0, whole.num_rows, 256)):
                symbols, ends, text = flat_symbols(b.column(1))
                own, least, begins, stop = runs(symbols, ends, k, m)
                yield pa.RecordBatch.from_arrays([b.column(0).take(pa.array(own)), pa.array(least), words_at(symbols, text, begins, stop)], ["grp", "minimizer", "part"])

    parts = blocks(reads, F.col("seq"), k, ("grp",)).select(F.col("grp").cast("int").alias("grp"), "part")
    return parts.mapInArrow(run, "grp int, minimizer bigint, part string")


def counted(reads: DataFrame, k: int, least: int = 1, m: int = M) -> DataFrame:
    """(grp, kmer, n) of the words of k letters that occur `least` times or more in their group."""
    parts = kept(super_kmers(reads, k, m), "superkmers")
    windows = F.length("part") - (k - 1)
    total = parts.agg(F.sum(windows)).first()[0] or 0
    hot = F.broadcast(kept(parts.groupBy("minimizer").agg(F.sum(windows).alias("w")).filter(F.col("w") * HOT_SHARE > total).select("minimizer"), "hot"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Rows come sorted by minimizer. They are gathered up to PIECE symbols and counted up to the last minimizer, whose rows wait for more of them."""
        held, size = [], 0

        def close(b: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
            symbols, ends, text = flat_symbols(b.column(2))
            for key, place, n in counted_words(symbols, ends, b.column(0).to_numpy(), k, max(len(symbols), 1)):
                ok = n >= least
                yield pa.RecordBatch.from_arrays([pa.array(key[ok].astype(np.int32)), words_at(symbols, text, place[ok], place[ok] + k), pa.array(n[ok])], ["grp", "kmer", "n"])

        def joined() -> pa.RecordBatch:
            return pa.Table.from_batches(held).combine_chunks().to_batches()[0]

        for b in batches:
            if not b.num_rows:
                continue
            held.append(b)
            size += b.column(2).nbytes
            if size > 2 * PIECE:
                whole = joined()
                of = whole.column(1).to_numpy()
                cut = int(np.searchsorted(of, of[-1]))
                if cut:
                    yield from close(whole.slice(0, cut))
                held, size = [pa.Table.from_batches([whole.slice(cut)]).combine_chunks().to_batches()[0]], 0 if cut else size // 2
        if held:
            yield from close(joined())

    tasks = int(reads.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    cold = parts.join(hot, "minimizer", "left_anti").repartition(tasks, "minimizer").sortWithinPartitions("minimizer").select("grp", "minimizer", "part").mapInArrow(run, "grp int, kmer string, n bigint")
    few = count_words(parts.join(hot, "minimizer", "left_semi"), F.col("part"), k).select("grp", F.col("w").alias("kmer"), "n").filter(F.col("n") >= least)
    return cold.unionByName(few)
