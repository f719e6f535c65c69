"""Toxicity: a convolutional text classifier over hashed word embeddings, trained in numpy.

A word is the sum of the embeddings of its hashed units: the word and its first four, five and six bytes,
so that inflected forms share what their stems carry. Filters of one, two and three words run over the whole text, each
filter's largest value is kept, and a logistic layer scores these. As only sums and maxima are involved, the
filters are applied to the embedding table once, and scoring a text is gathers, shifted adds and maxima in numpy.

Training takes every labelled row, its text whole, but those whose crc32(doc_id as text) mod 5 is 0. Their units are written once, dealt by a hash
to shards of about SHARD rows. In each epoch a shard is a run of steps from the model of the epoch before, and the shards' models are averaged: dense
parameters by rows, a bucket's embedding over the shards that moved it. The driver holds models alone, whose size is fixed. A fifth of the rows,
told by the hash, sets, for each language, the logit at which the score is 0.5: where the cost of errors (see WRONG) in the language and, with the weight
of PRIOR rows, in all languages is least; logits are counted to 1 in GRID. The language is told from the text's function words; labels, lang, source and doc_id are not inputs.
train() does the same on the driver for units at hand, and training_rows() fetches a bounded number of them; the queries use neither.

Defined results: a null or empty text has no words and gets the score of no evidence; without labelled rows of
both kinds every score is 0; rows that repeat a doc_id each get their score and each train; conflicting labels of an id count as
the larger; very long texts are scored whole, slice by slice; other columns are not read and may have any name; an
empty table gives an empty result.
"""

from __future__ import annotations

import ctypes
import gc
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from seqloom.llm._common import forget, scratch_path, stored
from seqloom.llm.url_filter import BlockedBloom

#: Rows of a shard of the training, about; shards are trained side by side.
SHARD = 4096
#: Labelled ids that the filter of training_table() is made for at most: 16 MB of bits.
FILTERED = 1 << 23
#: Embeddings to a row of what shards hand on, and steps of a logit's unit in which thresholds are counted.
BLOCK, GRID = 1024, 1 << 12
#: Labelled rows that training_rows() fetches at most, and their words in all, about; fit() has no such bound.
SAMPLE, SAMPLE_WORDS = 8000, 1 << 22
#: Texts to a step of the training, and rows of a language's rarer label at which its own threshold counts as much as the one of all.
BATCH, PRIOR = 16, 20
#: Rejecting a share of the clean rows is as bad as passing this many times that share of the toxic ones.
WRONG = 3
BUCKETS, DIM, WIDTHS, FILTERS = 1 << 17, 8, (1, 2, 3), 4
EPOCHS, RATE, SEED = 4, 0.05, 7
#: A text is scored so many words at a time, with an overlap, so a long one needs no more memory.
SLICE = 1 << 16
#: Function words by which a text's language is told.
FUNCTION_WORDS = {
    "en": "the and of to in is that for with was are this from by have not",
    "de": "der die und den das von ist mit dem nicht auch sich des zu ein im",
    "fr": "le la les et des est une du dans que pour qui au pas sur avec",
    "es": "el los las y que por una con para del se no lo como más su",
}
_SLOTS = [(w, j) for w in WIDTHS for j in range(w)]
_N = len(WIDTHS) * FILTERS
_MUL = np.uint64(0x9E3779B97F4A7C15)
_ODD = 0x100000001B3
_INVERSE = pow(_ODD, -1, 1 << 64)
#: Which bytes belong to words: ASCII letters and digits, and all of a non-ASCII character.
_IN_WORD = np.array([c >= 128 or chr(c).isalnum() for c in range(256)])


@lru_cache(maxsize=1)
def _powers() -> tuple[np.ndarray, np.ndarray]:
    n = SLICE * 16 + 1
    up, down = np.full(n, _ODD, np.uint64), np.full(n, _INVERSE, np.uint64)
    up[0] = down[0] = 1
    return np.multiply.accumulate(up), np.multiply.accumulate(down)


def word_hashes(text: str | None) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """For each slice of the text: the words' 64-bit hashes, and (words, 4) buckets of their units.

    All in numpy over the bytes: a word's hash is a difference of running sums, its prefixes come by masks.
    """
    raw = np.frombuffer((text or "").lower().encode("utf-8", "surrogatepass"), np.uint8)
    up, down = _powers()
    size, at = len(up) - 1, 0
    while at < len(raw):
        part = raw[at : at + size]
        if at + size < len(raw):  # end at a word's end, if there is one
            gap = np.flatnonzero(~_IN_WORD[part])
            part = part[: gap[-1] + 1] if len(gap) else part
        at += len(part)
        inside = np.concatenate(([False], _IN_WORD[part], [False]))
        edge = np.flatnonzero(inside[1:] != inside[:-1])
        starts, ends = edge[::2], edge[1::2]
        if not len(starts):
            continue
        run = np.concatenate((np.zeros(1, np.uint64), np.cumsum((part.astype(np.uint64) + np.uint64(1)) * up[: len(part)])))
        whole = (run[ends] - run[starts]) * down[starts]
        padded = np.concatenate((part, np.zeros(8, np.uint8)))
        first = np.zeros(len(starts), np.uint64)
        units = [whole * _MUL]
        for k in range(6):
            first |= np.where(starts + k < ends, padded[starts + k], 0).astype(np.uint64) << np.uint64(8 * k)
            if k >= 3:
                units.append((first + np.uint64(k)) * _MUL)
        buckets = np.stack([(u >> np.uint64(64 - BUCKETS.bit_length() + 1)).astype(np.int64) for u in units], axis=1)
        yield whole, buckets


@lru_cache(maxsize=1)
def _function_hashes() -> tuple[list[str], np.ndarray, np.ndarray]:
    names = sorted(FUNCTION_WORDS)
    pairs = sorted((int(h), k) for k, n in enumerate(names) for h in next(word_hashes(FUNCTION_WORDS[n]))[0])
    return names, np.array([h for h, _ in pairs], np.uint64), np.array([k for _, k in pairs])


def votes(whole: np.ndarray) -> np.ndarray:
    """How many of the words are function words of each language."""
    names, hashes, owner = _function_hashes()
    at = np.minimum(np.searchsorted(hashes, whole), len(hashes) - 1)
    return np.bincount(owner[at[hashes[at] == whole]], minlength=len(names))


@dataclass
class Classifier:
    """tables: (slots, BUCKETS, FILTERS), the filters applied to the embeddings; bias, out: of the logistic layer; middle: the logit of 0.5 by language."""

    tables: np.ndarray
    filter_bias: np.ndarray
    out: np.ndarray
    bias: float
    middle: np.ndarray

    def logit(self, text: str | None) -> tuple[float, int]:
        """The raw logit, and the language told from the text."""
        best, said = np.full(_N, 0.0, np.float32), np.zeros(len(FUNCTION_WORDS), np.int64)
        tail = np.zeros((0, 4), np.int64)
        for whole, buckets in word_hashes(text):
            said += votes(whole)
            buckets = np.concatenate((tail, buckets))
            tail = buckets[-(max(WIDTHS) - 1) :]
            for _, part in slices(buckets):
                best = np.maximum(best, pooled(self.tables, self.filter_bias, part)[0])
        return float(best @ self.out + self.bias), int(said.argmax())

    def score(self, text: str | None) -> float:
        logit, lang = self.logit(text)
        return float(1 / (1 + np.exp(-np.clip(logit - self.middle[lang], -30, 30))))


def pooled(tables: np.ndarray, filter_bias: np.ndarray, buckets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Each filter's largest value over the words, at least 0, and where it is (-1: nowhere)."""
    best, where = np.zeros(_N, np.float32), np.full(_N, -1)
    slot = 0
    for k, w in enumerate(WIDTHS):
        n = len(buckets) - w + 1
        total = None
        for j in range(w):
            if n > 0:
                x = tables[slot].take(buckets[j : j + n].ravel(), axis=0).reshape(n, 4, FILTERS).sum(axis=1)
                total = x if total is None else total + x
            slot += 1
        if total is not None:
            own = slice(k * FILTERS, (k + 1) * FILTERS)
            at = total.argmax(axis=0)
            top = total[at, np.arange(FILTERS)] + filter_bias[own]
            best[own], where[own] = np.maximum(top, 0), np.where(top > 0, at, -1)
    return best, where


def slices(units: np.ndarray) -> Iterator[tuple[int, np.ndarray]]:
    """The units SLICE words at a time, with an overlap, and where each slice starts."""
    for lo in range(0, len(units), SLICE):
        yield lo, units[lo : lo + SLICE + max(WIDTHS) - 1]


def _first_units(units: list[np.ndarray], labels: np.ndarray) -> np.ndarray:
    have = np.zeros((2, BUCKETS))
    for u, y in zip(units, labels, strict=True):
        have[y, np.unique(u)] += 1
    return _log_odds(have, np.bincount(labels, minlength=2))


def _log_odds(have: np.ndarray, n: np.ndarray) -> np.ndarray:
    """Smoothed log odds of each bucket by how many documents of each label, n in all, have it; the start of the first dimension."""
    share = n / n.sum()
    return (np.log((have[1] / share[1] + 4) / (have[0] / share[0] + 4))).astype(np.float32)


def tops(emb: np.ndarray, w: np.ndarray, filter_bias: np.ndarray, units: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For texts whose units follow one another: each filter's largest value, at least 0, and at which word (-1: nowhere). In slices."""
    n_texts = len(ends)
    best, where = np.zeros((n_texts, _N), np.float32), np.full((n_texts, _N), -1)
    for lo, part in slices(units):
        x = emb[part].sum(axis=1)
        first, last = np.searchsorted(ends, [lo, min(lo + SLICE, len(units)) - 1], side="right")
        texts = np.arange(first, last + 1)
        texts = texts[ends[texts] > np.concatenate(([0], ends))[texts]]  # those with words
        from_ = np.maximum(np.concatenate(([0], ends))[texts] - lo, 0)
        for k, width in enumerate(WIDTHS):
            n = min(len(x) - width + 1, SLICE)
            if n <= 0:
                continue
            slot = sum(WIDTHS[:k])
            total = sum(x[j : j + n] @ w[slot + j] for j in range(width))
            # a span that runs over its text's end is none
            own = np.searchsorted(ends, lo + np.arange(n), side="right")
            total[lo + np.arange(n) + width > ends[own]] = -np.inf
            at = from_ < n
            top = np.maximum.reduceat(total, from_[at], axis=0)
            # its first place: reduceat again, over the places of those that reach it
            here = np.where(total == top[np.searchsorted(texts[at], own)], np.arange(n)[:, None], n)
            place = np.minimum.reduceat(here, from_[at], axis=0) + lo
            cols = slice(k * FILTERS, (k + 1) * FILTERS)
            top = top + filter_bias[cols]
            better = top > best[texts[at], cols]
            best[texts[at], cols] = np.where(better, top, best[texts[at], cols])
            where[texts[at], cols] = np.where(better, place, where[texts[at], cols])
    return best, where


@dataclass
class State:
    """What training moves: embeddings, filters, logistic layer and Adagrad's sums."""

    emb: np.ndarray
    seen_emb: np.ndarray
    w: np.ndarray
    filter_bias: np.ndarray
    out: np.ndarray
    bias: float
    seen: np.ndarray

    @classmethod
    def first(cls, first_units: np.ndarray) -> State:
        rng = np.random.default_rng(SEED)
        emb = rng.normal(0, 0.02, (BUCKETS, DIM)).astype(np.float32)
        emb[:, 0] = first_units
        w = rng.normal(0, 0.1, (len(_SLOTS), DIM, FILTERS)).astype(np.float32)
        for s, (width, _) in enumerate(_SLOTS):
            w[s, 0] = 1.0 / width / 2 + rng.normal(0, 0.02, FILTERS)
        return cls(emb, np.full(BUCKETS, 1e-3, np.float32), w, np.zeros(_N, np.float32), np.full(_N, 0.2, np.float32), -1.0, np.full(3, 1e-3))

    def copy(self) -> State:
        return State(self.emb.copy(), self.seen_emb.copy(), self.w.copy(), self.filter_bias.copy(), self.out.copy(), self.bias, self.seen.copy())

    def dense(self) -> np.ndarray:
        """All but the embeddings, in one array."""
        return np.concatenate([self.w.ravel(), self.filter_bias, self.out, [self.bias], self.seen]).astype(np.float64)

    def set_dense(self, x: np.ndarray) -> None:
        n = self.w.size
        self.w, self.filter_bias, self.out = x[:n].reshape(self.w.shape).astype(np.float32), x[n : n + _N].astype(np.float32), x[n + _N : n + 2 * _N].astype(np.float32)
        self.bias, self.seen = float(x[n + 2 * _N]), x[n + 2 * _N + 1 :].copy()

    def step(self, units: list[np.ndarray], labels: np.ndarray, weight: np.ndarray) -> np.ndarray:
        """One step of Adagrad over some texts, with one rate for each array and for each bucket. The buckets it moved."""
        together, ends = np.concatenate(units), np.cumsum([len(u) for u in units])
        best, where = tops(self.emb, self.w, self.filter_bias, together, ends)
        g = (1 / (1 + np.exp(-np.clip(best @ self.out + self.bias, -30, 30))) - labels) * weight
        g_best = g[:, None] * self.out[None, :] * (where >= 0)
        g_out, g_bias = g @ best, float(g.sum())
        self.seen[1] += float(g_out @ g_out)
        self.seen[2] += g_bias * g_bias
        self.out = (self.out - RATE * g_out / np.sqrt(self.seen[1] / _N)).astype(np.float32)
        self.bias -= RATE * g_bias / np.sqrt(self.seen[2])
        self.filter_bias -= RATE * 0.1 * g_best.sum(axis=0).astype(np.float32)
        g_w, touched, g_emb = np.zeros_like(self.w), [], []
        for k, width in enumerate(WIDTHS):
            for f in range(FILTERS):
                col = k * FILTERS + f
                texts = np.flatnonzero(where[:, col] >= 0)
                for j in range(width):
                    slot = sum(WIDTHS[:k]) + j
                    buckets = together[where[texts, col] + j]
                    g_w[slot, :, f] = g_best[texts, col] @ self.emb[buckets].sum(axis=1)
                    touched.append(buckets.ravel())
                    g_emb.append(np.repeat(g_best[texts, col][:, None] * self.w[slot][:, f], 4, axis=0))
        self.seen[0] += float((g_w * g_w).sum()) / self.w.size
        self.w -= ((RATE * 0.1 / np.sqrt(self.seen[0])) * g_w).astype(np.float32)
        which, back = np.unique(np.concatenate(touched), return_inverse=True)
        total = np.zeros((len(which), DIM), np.float32)
        np.add.at(total, back, np.concatenate(g_emb).astype(np.float32))
        self.seen_emb[which] += (total * total).sum(axis=1)
        self.emb[which] -= RATE * total / np.sqrt(self.seen_emb[which])[:, None]
        return which

    def classifier(self) -> Classifier:
        tables = np.einsum("bd,sdf->sbf", self.emb, self.w).astype(np.float32)
        return Classifier(np.ascontiguousarray(tables), self.filter_bias, self.out.astype(np.float32), self.bias, np.zeros(len(FUNCTION_WORDS)))


def label_weights(n: np.ndarray) -> np.ndarray:
    """What a row of each label weighs in training, of n rows by label."""
    return 0.5 / np.maximum(n / max(n.sum(), 1), 1e-6)


def set_thresholds(model: Classifier, langs: np.ndarray, labels: np.ndarray, logits: np.ndarray, n: np.ndarray) -> None:
    """Sets the logit of 0.5 by language from logits, n rows at each. A language counts as much as its rarer label has rows, all languages together as much as PRIOR rows."""
    of_label = lambda at: np.array([n[at & (labels == y)].sum() for y in (0, 1)])
    every = of_label(np.ones(len(n), bool))
    for lang in range(len(FUNCTION_WORDS)):
        of = langs == lang
        own = of_label(of)
        share = own.min() / (own.min() + PRIOR)
        weights = n * ((1 - share) / every[labels] + np.where(of, share / np.maximum(own[labels], 1), 0)) * np.where(labels == 1, 1, WRONG)
        model.middle[lang] = threshold(logits, labels, weights)


def raw_logit(model: Classifier, units: np.ndarray) -> float:
    best = np.max([np.zeros(_N, np.float32), *(pooled(model.tables, model.filter_bias, part)[0] for _, part in slices(units))], axis=0)
    return float(best @ model.out + model.bias)


def train(units: list[np.ndarray], langs: np.ndarray, labels: np.ndarray) -> Classifier | None:
    """units: (words, 4) buckets of each text. None if a label is missing. Steps are of BATCH texts each. All here, in one run."""
    if len(set(labels.tolist())) < 2:
        return None
    rng = np.random.default_rng(SEED)
    held = np.arange(len(labels)) % 5 == 0
    fit = np.flatnonzero(~held) if len(set(labels[held].tolist())) == 2 and len(set(labels[~held].tolist())) == 2 else np.arange(len(labels))
    state = State.first(_first_units([units[i] for i in fit], labels[fit]))
    weight = label_weights(np.bincount(labels[fit], minlength=2))[labels]
    for _ in range(EPOCHS):
        order = rng.permutation(fit)
        for at in range(0, len(order), BATCH):
            batch = order[at : at + BATCH]
            state.step([units[i] for i in batch], labels[batch], weight[batch])
    model = state.classifier()
    test = np.flatnonzero(held) if fit.size < len(labels) else np.arange(len(labels))
    set_thresholds(model, langs[test], labels[test], np.array([raw_logit(model, units[i]) for i in test]), np.ones(len(test)))
    return model


def threshold(logits: np.ndarray, labels: np.ndarray, weights: np.ndarray | None = None) -> float:
    """The middle of the gap between neighbouring logits at which the weight of errors is least; by default each label weighs the same."""
    if weights is None:
        weights = np.where(labels == 1, 1 / max((labels == 1).sum(), 1), 1 / max((labels == 0).sum(), 1))
    order = np.argsort(logits, kind="stable")
    z, y, v = logits[order], labels[order], weights[order]
    missed = np.concatenate(([0], np.cumsum(v * (y == 1))))
    clean = np.concatenate(([0], np.cumsum(v * (y == 0))))
    cost = missed + clean[-1] - clean
    cost[1:-1][z[1:] == z[:-1]] = np.inf
    best = np.flatnonzero(cost <= cost.min() + 1e-9)
    best = best[len(best) // 2]
    edges = np.concatenate(([z[0] - 1], z, [z[-1] + 1]))
    return float((edges[best] + edges[best + 1]) / 2)


def is_held_out(doc_id: Column) -> Column:
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit(""))) % 5 == 0


def training_rows(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE, words: int = SAMPLE_WORDS) -> tuple[list[np.ndarray], np.ndarray, np.ndarray]:
    """Units, languages and labels of at most `sample` labelled documents that are not held out, with about `words` words in all.

    The ids are chosen first, so what is broadcast is bounded by `sample`. Of rows that repeat a doc_id the one with the least units is
    taken, before anything moves to the driver. Of each label, texts are taken whole in the order of the ids' hash until half the words are reached.
    """
    one = labels.select(labels["doc_id"].cast("bigint").alias("doc_id"), labels["toxic"].cast("int").alias("toxic")).dropna()
    one = one.filter(~is_held_out(F.col("doc_id"))).groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    order = F.xxhash64("doc_id")
    half = sample // 2
    ids = one.filter("toxic = 1").orderBy(order, "doc_id").limit(half).unionByName(one.filter("toxic = 0").orderBy(order, "doc_id").limit(sample - half))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out = []
            for x in b.column(2):
                parts = list(word_hashes(x.as_py()))
                said = sum((votes(w) for w, _ in parts), np.zeros(len(FUNCTION_WORDS), np.int64))
                units = np.concatenate([u for _, u in parts]) if parts else np.zeros((0, 4), np.int64)
                out.append((int(said.argmax()), units.astype("<i4").tobytes()))
            if out:
                yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array([x[0] for x in out]), pa.array([x[1] for x in out], pa.binary())], ["doc_id", "toxic", "lang", "units"])

    keyed = docs.select(docs["doc_id"].cast("bigint").alias("doc_id"), docs["text"].cast("string").alias("text"))
    joined = keyed.join(F.broadcast(ids), "doc_id").select("doc_id", "toxic", "text")
    found = joined.mapInArrow(run, "doc_id bigint, toxic int, lang bigint, units binary")
    rows = stored(found.groupBy("doc_id", "toxic").agg(F.min(F.struct("units", "lang")).alias("u")).select("doc_id", "toxic", "u.*"), "units")
    # the running number of words, over at most `sample` rows
    before = F.sum(F.octet_length("units") / 16).over(W.partitionBy("toxic").orderBy(order, "doc_id").rowsBetween(W.unboundedPreceding, -1))
    sizes = rows.select("doc_id", F.coalesce(before, F.lit(0.0)).alias("before"), "toxic").filter(F.col("before") < words / 2)
    chosen = rows.join(F.broadcast(sizes.select("doc_id")), "doc_id").select("doc_id", "toxic", "lang", "units")
    got = sorted(((r["doc_id"], r["toxic"], r["lang"], np.frombuffer(r["units"], "<i4").reshape(-1, 4)) for r in chosen.toLocalIterator()), key=lambda r: r[0])
    forget(rows)
    return [r[3] for r in got], np.array([r[2] for r in got], np.int64), np.array([r[1] for r in got], np.int64)


def labelled(keyed: DataFrame, one: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(doc_id, text, toxic) of the rows (doc_id, text) that have a label in one (doc_id, toxic), and the filter's table, to be forgotten after use.

    A Bloom filter of the labelled ids is broadcast, so texts without a label do not move, whatever the number of labels; its size is that for FILTERED ids at
    most, and more ids let more rows through. What passes meets its label by an exact join.
    """
    bloom = BlockedBloom(one.select(F.col("doc_id").alias("key")), min(one.count(), FILTERED))
    passed = bloom.possible(keyed.withColumnRenamed("doc_id", "key"), "broadcast").withColumnRenamed("key", "doc_id")
    return passed.join(one.hint("merge"), "doc_id"), bloom.blocks


def training_table(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """(shard, toxic, held, lang, units): every row of docs with a label that is not held out, dealt to shards by a hash and in its order there."""
    one = labels.select(labels["doc_id"].cast("bigint").alias("doc_id"), labels["toxic"].cast("int").alias("toxic")).filter("toxic in (0, 1)").dropna()
    one = stored(one.filter(~is_held_out(F.col("doc_id"))).groupBy("doc_id").agg(F.max("toxic").alias("toxic")), "labels")
    keyed = docs.select(docs["doc_id"].cast("bigint").alias("doc_id"), docs["text"].cast("string").alias("text"))
    met, blocks = labelled(keyed, one)
    joined = met.select("toxic", "text", F.xxhash64("doc_id", "text").alias("h"))
    n_shards = max(1, -(-keyed.select("doc_id").join(one, "doc_id").count() // SHARD))
    # of a row the shard, the fold and the place in the shard come from parts of the hash that have nothing to do with one another
    rows = joined.select(F.pmod("h", F.lit(n_shards)).cast("int").alias("shard"), "toxic", (F.pmod(F.xxhash64("h", F.lit(5)), F.lit(5)) == 0).alias("held"), F.xxhash64("h", F.lit(7)).alias("o"), "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(0, whole.num_rows, BATCH * 16):
                b = whole.slice(at, BATCH * 16)
                langs, found = [], []
                for x in b.column(3):
                    parts = list(word_hashes(x.as_py()))
                    said = sum((votes(w) for w, _ in parts), np.zeros(len(FUNCTION_WORDS), np.int64))
                    langs.append(int(said.argmax()))
                    found.append(np.concatenate([u for _, u in parts]).astype("<i4").tobytes() if parts else b"")
                yield pa.RecordBatch.from_arrays([*b.columns[:3], pa.array(langs, pa.int32()), pa.array(found, pa.binary())], ["shard", "toxic", "held", "lang", "units"])

    dealt = rows.repartition(n_shards, "shard").sortWithinPartitions("shard", "o", "toxic").select("shard", "toxic", "held", "text")
    path = scratch_path(docs.sparkSession, "training")
    found = dealt.mapInArrow(run, "shard int, toxic int, held boolean, lang int, units binary")
    # a file or more to a shard, which its readers take whole: the shard's number is part of the path
    found.write.option("compression", "zstd").partitionBy("shard").parquet(path)
    forget(one, blocks)
    out = docs.sparkSession.read.schema(found.schema).parquet(path)
    out._scratch = path
    return out


def _units(x) -> np.ndarray:
    return np.frombuffer(x.as_py(), "<i4").reshape(-1, 4)


def _document_counts(rows: DataFrame) -> np.ndarray:
    """(2, BUCKETS): how many documents of each label have each bucket. Tasks sum up first."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        have = np.zeros((2, BUCKETS), np.int64)
        for b in batches:
            for y, u in zip(b.column(0).to_pylist(), b.column(1), strict=True):
                have[y, np.unique(_units(u))] += 1
        for y in (0, 1):
            at = np.flatnonzero(have[y])
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(at), y)), pa.array(at), pa.array(have[y, at])], ["toxic", "bucket", "n"])

    each = rows.select("toxic", "units").mapInArrow(run, "toxic bigint, bucket bigint, n bigint")
    got = each.groupBy("toxic", "bucket").agg(F.sum("n").alias("n")).toArrow()
    have = np.zeros((2, BUCKETS))
    have[got["toxic"].to_numpy(), got["bucket"].to_numpy()] = got["n"].to_numpy()
    return have


def _epoch(rows: DataFrame, state: State, weight: np.ndarray, epoch: int) -> State:
    """The mean of the models to which each shard brings the state in one pass over its rows."""
    spark = rows.sparkSession
    shared = spark.sparkContext.broadcast(state)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shard, own, moved, n = None, None, None, 0

        def close() -> Iterator[pa.RecordBatch]:
            if shard is None:
                return
            base = shared.value
            ids = np.flatnonzero(moved)
            cuts = np.searchsorted(ids, np.arange(0, BUCKETS + 1, BLOCK))
            values = np.concatenate([own.emb[ids] - base.emb[ids], (own.seen_emb[ids] - base.seen_emb[ids])[:, None]], axis=1).astype("<f4")
            parts = [(k, ids[a:b].astype("<i4").tobytes(), values[a:b].tobytes()) for k, (a, b) in enumerate(zip(cuts[:-1], cuts[1:], strict=True)) if b > a]
            parts.append((-1, b"", (own.dense() - base.dense()).astype("<f8").tobytes()))
            yield pa.RecordBatch.from_arrays(
                [pa.array([p[0] for p in parts], pa.int32()), pa.array([shard] * len(parts), pa.int32()), pa.array([n] * len(parts), pa.int64()), pa.array([p[1] for p in parts], pa.binary()), pa.array([p[2] for p in parts], pa.binary())],
                ["block", "shard", "n", "ids", "moves"],
            )

        for whole in batches:
            for b in (whole.slice(at, BATCH * 64) for at in range(0, whole.num_rows, BATCH * 64)):
                shards, labels = b.column(0).to_numpy(), b.column(1).to_numpy()
                cuts = [0, *(np.flatnonzero(shards[1:] != shards[:-1]) + 1), b.num_rows]
                for lo, hi in zip(cuts[:-1], cuts[1:], strict=True):
                    if shards[lo] != shard:
                        yield from close()
                        shard, own, moved, n = int(shards[lo]), shared.value.copy(), np.zeros(BUCKETS, bool), 0
                    order = lo + np.random.default_rng([SEED, epoch, n]).permutation(hi - lo)
                    for at in range(0, len(order), BATCH):
                        batch = order[at : at + BATCH]
                        moved[own.step([_units(b.column(2)[int(i)]) for i in batch], labels[batch], weight[labels[batch]])] = True
                    n += hi - lo
        yield from close()

    def mean(key: tuple, batch: pa.Table) -> pa.Table:
        """Of the shards' moves, in the order of the shards: dense ones by rows, a bucket's over those shards that moved it."""
        parts = sorted(zip(batch["shard"].to_pylist(), batch["n"].to_pylist(), batch["ids"].to_pylist(), batch["moves"].to_pylist(), strict=True))
        if key[0].as_py() < 0:
            total = sum(n * np.frombuffer(m, "<f8") for _, n, _, m in parts) / sum(n for _, n, _, _ in parts)
            return pa.table([pa.array([-1], pa.int32()), pa.array([total.astype("<f8").tobytes()], pa.binary())], ["block", "moves"])
        total, times = np.zeros((BLOCK, DIM + 1)), np.zeros(BLOCK)
        for _, _, ids, m in parts:
            at = np.frombuffer(ids, "<i4") % BLOCK
            total[at] += np.frombuffer(m, "<f4").reshape(-1, DIM + 1)
            times[at] += 1
        total /= np.maximum(times, 1)[:, None]
        return pa.table([pa.array([key[0].as_py()], pa.int32()), pa.array([total.astype("<f4").tobytes()], pa.binary())], ["block", "moves"])

    moves = rows.select("shard", "toxic", "units").mapInArrow(run, "block int, shard int, n bigint, ids binary, moves binary")
    got, out = moves.groupBy("block").applyInArrow(mean, "block int, moves binary").toArrow(), state.copy()
    for block, m in zip(got["block"].to_pylist(), got["moves"].to_pylist(), strict=True):
        if block < 0:
            out.set_dense(state.dense() + np.frombuffer(m, "<f8"))
            continue
        x, at = np.frombuffer(m, "<f4").reshape(-1, DIM + 1), slice(block * BLOCK, (block + 1) * BLOCK)
        out.emb[at] += x[:, :DIM]
        out.seen_emb[at] += x[:, DIM]
    shared.unpersist()
    return out


def _counted_logits(rows: DataFrame, model: Classifier) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Languages, labels, logits to 1 in GRID, and how many rows have them. Logits beyond 30 count as 30, so there are few."""
    shared = rows.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            z = np.array([raw_logit(shared.value, _units(u)) for u in b.column(2)], np.float64)
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(np.rint(np.clip(z, -30, 30) * GRID).astype(np.int64))], ["lang", "toxic", "z"])

    each = rows.select("lang", "toxic", "units").mapInArrow(run, "lang int, toxic int, z bigint")
    got = each.groupBy("lang", "toxic", "z").agg(F.count(F.lit(1)).alias("n")).orderBy("z", "toxic", "lang").toArrow()
    shared.unpersist()
    return got["lang"].to_numpy(), got["toxic"].to_numpy(), got["z"].to_numpy() / GRID, got["n"].to_numpy()


def fit(docs: DataFrame, labels: DataFrame) -> Classifier | None:
    """The classifier, learnt from every labelled row that is not held out; None if a label is missing. The driver sees counts and models alone."""
    rows = training_table(docs, labels)
    try:
        n = np.zeros((2, 2), np.int64)  # by held and label
        for r in rows.groupBy("held", "toxic").count().collect():
            n[int(r["held"]), r["toxic"]] = r["count"]
        if not n.sum(axis=0).all():
            return None
        parted = bool(n.all())
        fit_rows, test_rows = (rows.filter("not held"), rows.filter("held")) if parted else (rows, rows)
        n_fit = n[0] if parted else n.sum(axis=0)
        state, weight = State.first(_log_odds(_document_counts(fit_rows), n_fit)), label_weights(n_fit)
        for epoch in range(EPOCHS):
            state = _epoch(fit_rows, state, weight, epoch)
        model = state.classifier()
        set_thresholds(model, *_counted_logits(test_rows, model))
        return model
    finally:
        forget(rows)
        gc.collect()
        pa.default_memory_pool().release_unused()
        if (trim := getattr(ctypes.CDLL(None), "malloc_trim", None)) is not None:  # the C library keeps freed pages of many small arrays otherwise
            trim(0)


def scorer(spark, model: Classifier | None):
    """text -> score for use in Arrow functions; the model is broadcast once (its size is fixed by the parameters)."""
    shared = spark.sparkContext.broadcast(model)
    return lambda text: 0.0 if shared.value is None else shared.value.score(text)


def scores(docs: DataFrame, model: Classifier | None) -> DataFrame:
    """(doc_id, held_out, score, predicted) for every row of docs."""
    score = scorer(docs.sparkSession, model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            s = np.array([score(x.as_py()) for x in b.column(2)], np.float64)
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(s), pa.array((s >= 0.5).astype(np.int32))], ["doc_id", "held_out", "score", "predicted"])

    keyed = docs.select(docs["doc_id"].cast("bigint").alias("doc_id"), is_held_out(docs["doc_id"]).alias("held_out"), docs["text"].cast("string").alias("text"))
    return keyed.mapInArrow(run, "doc_id bigint, held_out boolean, score double, predicted int")


def without_toxic(docs: DataFrame, model: Classifier | None) -> DataFrame:
    """docs without the rows whose score is 0.5 or more; all columns as they were."""
    score = scorer(docs.sparkSession, model)
    place = docs.columns.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield b.filter(pa.array([score(x.as_py()) < 0.5 for x in b.column(place)], pa.bool_()))

    return docs.mapInArrow(run, docs.schema)
