"""Token counts: batch encoding in Arrow functions that give back lengths only.

Rows are gathered to batches of about BATCH_BYTES, over the batches that Spark hands out, and texts over CHUNK
characters are cut before encoding, so neither many rows nor one long text sets what a worker holds.

A cut is safe for this kind of vocabulary if no piece has its word mark after another character, which is
verified when the model is loaded: then no merge crosses a space that follows another character. The space itself
goes, as the library puts the mark before every text it is given. A long text without a safe place stays whole.

Defined results: a null text has no bytes and no tokens; an empty table gives an empty result; repeated rows
each get their counts; other columns are not read.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import sentencepiece
from pyspark.sql import DataFrame

BATCH_BYTES = 1 << 20
CHUNK = 1 << 14
_CUT = re.compile(r"(?<=[^\s▁]) (?=[^\s▁])")


@lru_cache(maxsize=2)
def model(path: str) -> sentencepiece.SentencePieceProcessor:
    """The model; refuses one for which cuts at spaces could change the count."""
    sp = sentencepiece.SentencePieceProcessor(model_file=path)
    pieces = (sp.id_to_piece(k) for k in range(sp.get_piece_size()))
    if any("▁" in p.lstrip("▁") for p in pieces) or sp.encode("a a") != sp.encode("a") * 2:
        raise ValueError("texts can't be cut at spaces for this vocabulary")
    return sp


def chunks(text: str, size: int = CHUNK) -> list[str]:
    """The text in parts of about `size` characters, cut at single spaces between other characters."""
    out, at = [], 0
    while len(text) - at > size:
        cut = _CUT.search(text, at + size)
        if not cut:
            break
        out.append(text[at : cut.start()])
        at = cut.end()
    out.append(text[at:])
    return out


def lengths(texts: list[str], path: str) -> np.ndarray:
    """Tokens of each text, encoded together."""
    parts = [chunks(t) if len(t) > CHUNK else [t] for t in texts]
    n = np.fromiter(map(len, model(path).encode([c for p in parts for c in p], num_threads=1)), np.int64)
    return np.add.reduceat(n, np.cumsum([0, *map(len, parts[:-1])])) if texts else n


def counts(docs: DataFrame, path: str, limit: int = 4096) -> DataFrame:
    """(doc_id, n_bytes, n_tokens, over_limit) for every row of docs."""

    def encoded(held: list[tuple[pa.Array, pa.Array, np.ndarray]]) -> pa.RecordBatch:
        ids, texts, size = pa.concat_arrays([x[0] for x in held]), [t for x in held for t in x[1].to_pylist()], np.concatenate([x[2] for x in held])
        n = lengths(texts, path)
        return pa.RecordBatch.from_arrays([ids, pa.array(size), pa.array(n), pa.array(n > limit)], ["doc_id", "n_bytes", "n_tokens", "over_limit"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, total = [], 0
        for b in batches:
            texts = b.column(1).fill_null("")
            size = pc.binary_length(texts).to_numpy(zero_copy_only=False).astype(np.int64)
            cuts = np.flatnonzero(np.diff((np.cumsum(size) - size) // BATCH_BYTES)) + 1
            for lo, hi in zip([0, *cuts], [*cuts, len(size)], strict=True):
                if hi > lo:
                    held.append((b.column(0).slice(lo, hi - lo), texts.slice(lo, hi - lo), size[lo:hi]))
                    total += int(size[lo:hi].sum())
                if total >= BATCH_BYTES or len(held) > 64:
                    yield encoded(held)
                    held, total = [], 0
        if held:
            yield encoded(held)

    keyed = docs.select(docs["doc_id"].cast("bigint").alias("doc_id"), docs["text"].cast("string").alias("text"))
    return keyed.mapInArrow(run, "doc_id bigint, n_bytes bigint, n_tokens bigint, over_limit boolean")
