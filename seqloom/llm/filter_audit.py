"""Filter interaction audit: what each filter removes at each place of every order of the filters.

A document's failures are a bit mask. A table of 2^k masks by k! orders, made once, tells the step at which a document of
that mask is removed in that order; tasks look their documents up in it, add up removals by part, order, step and label
with np.bincount, and hand out one array per part. The arrays are then summed by part, salted first, so no task takes
more than a few arrays of a part at a time and none takes the rows of a hot part.

Masks: A to D are told from a text alone. E needs the least doc_id of each text: texts are told apart by SHA-256, the least id is a map-side
aggregate, and digests of very many copies are looked up by broadcast (fewer than 512 such can be). Only ids, parts, masks and digests move.

Defined results: a null text is empty and a null source is the part ''; a row without a doc_id has no label and takes no
part in E, neither failing nor making others fail; repeated rows count each, and rows of one doc_id and text don't fail
E by each other; repeated rows of labels count as 1 where any of them does; an empty table gives an empty result; very long texts are read
whole, one at a time. Other columns are not read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from itertools import permutations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from seqloom.llm._common import HOT_SHARE, stored, text_of

FILTERS = "ABCDE"
_CAPITALS, _SIGNS, _INNER = bytes(range(65, 91)), b"#$%&*|", bytes(range(0x80, 0xC0))
#: Labels of a document as one number: 1 for good, 2 for toxic, 3 for both.
LABELS = 4
#: Parts whose arrays a task holds at once, and parts that one bincount takes.
HELD, SLICE = 512, 32
#: Tasks that sum a part's arrays before the last one does.
SALTS = 16
_COLUMNS = ["kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley"]


def orders_of(filters: str) -> list[str]:
    return ["".join(p) for p in permutations(filters)]


def first_failures(filters: str = FILTERS) -> np.ndarray:
    """(2^k masks, k! orders): the step from 0 whose filter is the first that the mask fails, k if it fails none. Bit i of a mask is filter i."""
    k, orders = len(filters), orders_of(filters)
    bits = np.array([[filters.index(f) for f in o] for o in orders])
    failing = (np.arange(2**k)[:, None, None] >> bits) & 1
    return np.where(failing.any(axis=2), failing.argmax(axis=2), k)


def text_mask(text: bytes) -> int:
    """Bits 0 to 3: under 200 words; distinct words under half; capitals over 2 % of the code points; a sign of markup."""
    words = text.split()
    n, capitals = len(words), len(text) - len(text.translate(None, _CAPITALS))
    points = len(text.translate(None, _INNER))
    return (n < 200) | (100 * len(set(words)) < 50 * n) << 1 | (100 * capitals > 2 * points) << 2 | (len(text.translate(None, _SIGNS)) < len(text)) << 3


def _measured(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        masks, digests = np.zeros(b.num_rows, np.int32), []
        for k, x in enumerate(b.column(2)):
            text = x.as_py()
            masks[k] = text_mask(text)
            digests.append(hashlib.sha256(text).digest())
        yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(masks), pa.array(digests, pa.binary())], ["doc_id", "part", "mask", "digest"])


def masks(docs: DataFrame) -> DataFrame:
    """(doc_id, part, mask) of every row, all five filters."""
    src = docs.select(docs["doc_id"].cast("bigint").alias("doc_id"), F.coalesce(docs["source"].cast("string"), F.lit("")).alias("part"), text_of(docs).cast("binary").alias("text"))
    rows = stored(src.mapInArrow(_measured, "doc_id bigint, part string, mask int, digest binary"), "masks")
    copies = rows.groupBy("digest").agg(F.min("doc_id").alias("least"), F.count(F.lit(1)).alias("n")).filter("n > 1 and least is not null")
    copies = stored(copies, "copies")
    is_hot = F.col("n") * HOT_SHARE > F.lit(rows.count())
    hot = F.broadcast(copies.filter(is_hot).select("digest", "least"))  # fewer than HOT_SHARE rows
    fails = lambda least: F.when(F.col("doc_id") > F.col(least), F.lit(16)).otherwise(F.lit(0))
    out = ["doc_id", "part", (F.col("mask") + fails("least")).alias("mask")]
    few = rows.join(hot, "digest").select(*out)
    rest = rows.join(hot, "digest", "left_anti").join(copies.filter(~is_hot).select("digest", "least"), "digest", "left")
    return rest.select(*out).unionByName(few)


def labelled(rows: DataFrame, labels: DataFrame) -> DataFrame:
    """(part, mask, label, n) of rows (doc_id, part, mask): rows alike are counted before they meet the labels, so a repeated id is no hot key."""
    each = rows.groupBy("doc_id", "part", "mask").agg(F.count(F.lit(1)).alias("n"))
    one = lambda c: F.max(F.when(labels[c] == 1, F.lit(1)).otherwise(F.lit(0)))
    known = labels.groupBy(labels["doc_id"].cast("bigint").alias("doc_id")).agg((one("quality") + 2 * one("toxic")).alias("label"))
    return each.join(known, "doc_id", "left").select("part", "mask", F.coalesce("label", F.lit(0)).alias("label"), "n")


def _arrays(held: dict[str, np.ndarray]) -> pa.RecordBatch:
    width = len(next(iter(held.values())))
    cells = pa.ListArray.from_arrays(pa.array(np.arange(len(held) + 1) * width, pa.int32()), pa.array(np.concatenate(list(held.values()))))
    return pa.RecordBatch.from_arrays([pa.array(held, pa.string()), cells], ["part", "cells"])


def _partial(filters: str):
    """Of a task's rows (part, mask, label, n): an array per part, rows by mask and label, then removals by order, step and label."""
    first = first_failures(filters)
    n_masks, n_orders, steps = *first.shape, len(filters) + 1
    wide = n_orders * steps * LABELS

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[str, np.ndarray] = {}
        for b in batches:
            if not b.num_rows:
                continue
            coded = pc.dictionary_encode(b.column(0))
            names, codes = coded.dictionary.to_pylist(), coded.indices.to_numpy(zero_copy_only=False).astype(np.int64)
            mask, label, n = (b.column(k).to_numpy(zero_copy_only=False).astype(np.int64) for k in (1, 2, 3))
            alike, at = np.unique((codes * n_masks + mask) * LABELS + label, return_inverse=True)
            n = np.bincount(at, weights=n)
            part, mask, label = alike // (n_masks * LABELS), alike // LABELS % n_masks, alike % LABELS
            for begin in range(0, len(names), SLICE):
                lo, hi = np.searchsorted(part, [begin, begin + SLICE])
                p, m, x, w = part[lo:hi] - begin, mask[lo:hi], label[lo:hi], n[lo:hi]
                size = min(SLICE, len(names) - begin)
                rows = np.bincount((p * n_masks + m) * LABELS + x, weights=w, minlength=size * n_masks * LABELS).reshape(size, -1)
                cell = ((p[:, None] * n_orders + np.arange(n_orders)) * steps + first[m]) * LABELS + x[:, None]
                removed = np.bincount(cell.ravel(), weights=np.repeat(w, n_orders), minlength=size * wide).reshape(size, -1)
                for k, both in enumerate(np.concatenate([rows, removed], axis=1).astype(np.int64)):
                    name = names[begin + k]
                    held[name] = held[name] + both if name in held else both
                if len(held) > HELD:
                    yield _arrays(held)
                    held = {}
        if held:
            yield _arrays(held)

    return run


def _summed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The sum of the arrays of each run of rows of one part."""
    name, total = None, None
    for b in batches:
        cells = b.column(1).flatten().to_numpy(zero_copy_only=False).reshape(b.num_rows, -1) if b.num_rows else ()
        for part, row in zip(b.column(0).to_pylist(), cells, strict=True):
            if total is not None and part != name:
                yield _arrays({name: total})
                total = None
            name, total = part, row.copy() if total is None else total + row
    if total is not None:
        yield _arrays({name: total})


def _report(filters: str):
    """The rows of each part, from its summed array."""
    orders, k = orders_of(filters), len(filters)
    letters = np.array([[filters.index(f) for f in o] for o in orders])
    fails = (np.arange(2**k)[None, :] >> np.arange(k)[:, None]) & 1

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for part, x in zip(b.column(0).to_pylist(), b.column(1), strict=True):
                cells = x.values.to_numpy(zero_copy_only=False)
                rows = cells[: 2**k * LABELS].reshape(2**k, LABELS).sum(axis=1)
                lost = cells[2**k * LABELS :].reshape(len(orders), k + 1, LABELS)[:, :k]
                removed = lost.sum(axis=2)
                failing, alone = fails @ rows, rows[1 << np.arange(k)]
                shapley = np.array([removed[letters == f].sum() for f in range(k)])
                found = [rows.sum() - removed.cumsum(axis=1), removed, failing[letters] - removed, alone[letters], lost[:, :, [1, 3]].sum(axis=2), lost[:, :, [2, 3]].sum(axis=2), shapley[letters]]
                n = len(orders) * k
                head = [pa.array([part] * n, pa.string()), pa.array(np.repeat(orders, k).tolist(), pa.string()), pa.array(np.tile(np.arange(1, k + 1, dtype=np.int32), len(orders)))]
                yield pa.RecordBatch.from_arrays([*head, *(pa.array(f.ravel().astype(np.int64)) for f in found)], ["part", "filter_order", "step", *_COLUMNS])

    return run


def interactions(rows: DataFrame, filters: str = FILTERS) -> DataFrame:
    """(part, filter_order, step, kept, removed, redundant, unique_fails, good_lost, toxic_lost, shapley) of rows (part, mask, label, n), for up to six filters."""
    kind = "part string, cells array<bigint>"
    parts = rows.select("part", "mask", "label", "n").mapInArrow(_partial(filters), kind)
    tasks = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    salted = parts.withColumn("salt", F.pmod(F.xxhash64("cells"), F.lit(SALTS))).repartition(tasks, "part", "salt").sortWithinPartitions("part").select("part", "cells")
    whole = salted.mapInArrow(_summed, kind).repartition(tasks, "part").sortWithinPartitions("part").mapInArrow(_summed, kind)
    return whole.mapInArrow(_report(filters), "part string, filter_order string, step int, " + ", ".join(f"{c} bigint" for c in _COLUMNS))


def audit(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """interactions() of the five filters over docs, with the labels (doc_id, quality, toxic)."""
    return interactions(labelled(masks(docs), labels))
