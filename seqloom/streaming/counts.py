"""Running transition counts of a stream of reads: counts add up, so each micro-batch updates them."""

from __future__ import annotations

from pyspark.sql import DataFrame

from seqloom.operators.counting import count_windows


def running(reads: DataFrame, lag: int) -> DataFrame:
    """(kmer, grp, nxt, n) of a streaming frame (grp, seq); write it in update or complete mode."""
    return count_windows(reads, lag)
