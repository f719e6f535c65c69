"""Quality rules with robust multivariate outliers.

Statistics of every whole text come from one Arrow pass; base rules fail short and repetitive texts. The others are
judged by the minimum covariance determinant (MCD) of their language and source. From each of three starts (medians and
quartile ranges, mean and covariance of all rows, covariance of the rows' directions from the median) concentration steps take again and again the H share of
the group's rows that lie nearest by Mahalanobis distance and estimate mean and covariance anew, until the determinant no longer
falls; the start with the least one is the estimate, and a last step takes the rows within a chi-square
limit. A document is rejected if its transformed statistics lie where less than TAIL of a normal group would.

All steps are aggregates over a narrow stored table: a row per document enters, and a row of moments per group, start and distance bin
leaves each task, so a step is one pass and a group may hold any share of the rows. Nothing is sampled. A group's estimate is drawn towards that of its
language, and this towards that of all, each with the weight of PRIOR rows, whatever the group's size; the wider estimates are
the mixtures of their groups'.

A statistic of a short text is uncertain: its counts vary as Poisson's do. This variance, the text's own, is added to the
group's, so that one line said twice in a text of seven rejects nothing, whatever the group's spread. GUARD only
keeps the covariance of a group without any spread invertible.

Defined results: a null text has no words and fails the base rules; null languages and sources are groups of their
own; repeated rows each get their result; rows at the same distance are taken or left together; very long texts are read whole, one
at a time in a task; an empty table gives an empty result; other columns are not read.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from seqloom.llm._common import forget, stored

MIN_WORDS, MAX_REPEAT_PERCENT, WINDOW = 10, 20, 5
SYMBOLS = "#*$%&|<>"
#: Share of a group that the concentration steps keep.
H = 0.75
#: A step goes on if it lowers a determinant by more than this share.
FALL = 1e-3
#: Rows of a group at which its own estimate and that of its parent weigh the same.
PRIOR = 50
#: Tail of the chi-square distribution beyond which a document is rejected.
TAIL = 1e-3
#: Distances are cut at bins this fine.
BINS_PER_OCTAVE = 16
#: Transformed statistics.
FEATURES = ("log_words", "log_word_chars", "symbol_share", "dup_line_share", "repeat_share", "upper_share")
#: The least variance of a statistic in a group.
GUARD = 1e-6
_P = len(FEATURES)
_PAIRS = [(i, j) for i in range(_P) for j in range(i + 1)]


def repeated_words(words: list[bytes]) -> int:
    """Words in windows of five that the text has twice or more, the first one included.

    Windows get exact ids by pairing: of two words, of two such pairs, of these and the fifth word.
    """
    n = len(words) - WINDOW + 1
    if n < 2:
        return 0
    known: dict[bytes, int] = {}
    ids = np.fromiter((known.setdefault(w, len(known)) for w in words), np.int64, len(words))
    if len(known) == len(words):
        return 0
    key = np.unique(ids[:-1] * len(known) + ids[1:], return_inverse=True)[1].astype(np.int64)
    key = np.unique(key[:-2] * len(words) + key[2:], return_inverse=True)[1].astype(np.int64)
    _, key, times = np.unique(key[:n] * len(known) + ids[4:], return_inverse=True, return_counts=True)
    starts = np.flatnonzero(times[key] > 1)
    covered = np.zeros(len(words) + 1, np.int64)
    np.add.at(covered, starts, 1)
    np.add.at(covered, np.minimum(starts + WINDOW, len(words)), -1)
    return int((np.cumsum(covered[:-1]) > 0).sum())


def stats(text: str | None) -> tuple[int, int, int, int, int, int, int]:
    """n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, lines with a word, capital letters A-Z."""
    text = text or ""
    raw = text.encode("utf-8", "surrogatepass")
    words = raw.split()
    white = sum(text.count(c) for c in " \t\n\v\f\r")
    seen: set[bytes] = set()
    lines = 0
    for line in raw.split(b"\n"):
        if line.strip():
            lines += 1
            seen.add(line)
    upper = len(raw) - len(raw.translate(None, b"ABCDEFGHIJKLMNOPQRSTUVWXYZ"))
    return len(words), len(text) - white, sum(text.count(c) for c in SYMBOLS), lines - len(seen), repeated_words(words), lines, upper


_STATS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines", "n_upper")


def statistics(docs: DataFrame) -> DataFrame:
    """(doc_id, lang, source, the statistics) for every row of docs."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if b.num_rows:
                cols = np.array([stats(x.as_py()) for x in b.column(3)], np.int64).T
                yield pa.RecordBatch.from_arrays([*(b.column(k) for k in range(3)), *(pa.array(c) for c in cols)], ["doc_id", "lang", "source", *_STATS])

    keyed = docs.select(docs["doc_id"].cast("bigint").alias("doc_id"), *[docs[c].cast("string").alias(c) for c in ("lang", "source", "text")])
    return keyed.mapInArrow(run, "doc_id bigint, lang string, source string, " + ", ".join(f"{c} bigint" for c in _STATS))


def base_failed() -> Column:
    return (F.col("n_words") < MIN_WORDS) | (F.col("n_repeat_words") * 100 > F.col("n_words") * MAX_REPEAT_PERCENT)


def features() -> list[Column]:
    chars, words = F.greatest("word_chars", F.lit(1)), F.greatest("n_words", F.lit(1))
    return [
        F.log1p("n_words").alias("x0"),
        F.log(chars / words).alias("x1"),
        F.sqrt(F.col("n_symbols") / chars).alias("x2"),
        F.sqrt(F.col("n_dup_lines") / F.greatest("n_lines", F.lit(1))).alias("x3"),
        F.sqrt(F.col("n_repeat_words") / words).alias("x4"),
        F.sqrt(F.col("n_upper") / chars).alias("x5"),
    ]


#: The variance that Poisson counts give each of the features in a text of this length; words repeat two windows at a time at least.
_CHARS, _WORDS, _LINES = (f"greatest({c}, 1)" for c in ("word_chars", "n_words", "n_lines"))
NOISE = (f"1 / {_WORDS}", f"1 / {_CHARS}", f"0.25D / {_CHARS}", f"0.25D / {_LINES}", f"{0.5 * WINDOW}D / {_WORDS}", f"0.25D / {_CHARS}")


def chi2_quantile(p: float, k: int) -> float:
    """Wilson-Hilferty; p is the upper tail. The normal quantile comes by bisection of erfc."""
    lo, hi = -40.0, 40.0
    for _ in range(200):
        mid = (lo + hi) / 2
        lo, hi = (mid, hi) if 0.5 * math.erfc(mid / math.sqrt(2)) > p else (lo, mid)
    return k * (1 - 2 / (9 * k) + lo * math.sqrt(2 / (9 * k))) ** 3


def chi2_tail(x: float, k: int) -> float:
    """The upper tail of chi-square for even k, and by recurrence for odd k."""
    term, total = (math.exp(-x / 2), math.exp(-x / 2)) if k % 2 == 0 else (math.sqrt(2 * x / math.pi) * math.exp(-x / 2), math.erfc(math.sqrt(x / 2)))
    if k % 2:
        total += term if k > 1 else 0
        for m in range(5, k + 1, 2):
            term *= x / (m - 2)
            total += term
    else:
        for m in range(4, k + 1, 2):
            term *= x / (m - 2)
            total += term
    return total


_CELLS = [f"c{i}{j}" for i, j in _PAIRS]
_MEANS = [f"m{i}" for i in range(_P)]


def _scale(share: float) -> float:
    """What makes the covariance of the nearest `share` of normal rows that of all."""
    return 1.0 if share >= 1 else share / (1 - chi2_tail(chi2_quantile(1 - share, _P), _P + 2))


def _inverted(est: DataFrame, keys: list[str], more: tuple[str, ...] | list[str] = ()) -> DataFrame:
    """Adds to mean m0.. and covariance c00.. (a row per group) the variances v0.., the inverse p00.. and the log of the determinant."""
    schema = ", ".join([*(f"{k} string" for k in keys), *(f"{c} double" for c in [*_MEANS, *_CELLS, *(f"v{i}" for i in range(_P)), *(f"p{i}{j}" for i, j in _PAIRS), "logdet"]), "n double", *(f"{c} double" for c in more)])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if not b.num_rows:
                continue
            cov = np.zeros((b.num_rows, _P, _P))
            for i, j in _PAIRS:
                cov[:, i, j] = cov[:, j, i] = b.column(f"c{i}{j}").to_numpy(zero_copy_only=False)
            # the guard is added where a variance lacks it, which keeps the matrix positive definite
            for i in range(_P):
                cov[:, i, i] = np.maximum(cov[:, i, i], 0) + np.maximum(GUARD - cov[:, i, i], 1e-9)
            inv, logdet = np.linalg.inv(cov), np.linalg.slogdet(cov)[1]
            cols = [*(cov[:, i, i] for i in range(_P)), *(inv[:, i, j] for i, j in _PAIRS), logdet]
            old = [b.column(c) for c in [*keys, *_MEANS, *_CELLS]]
            yield pa.RecordBatch.from_arrays([*old, *(pa.array(np.ascontiguousarray(c)) for c in cols), b.column("n"), *(b.column(c) for c in more)], [x.split()[0] for x in schema.split(", ")])

    return est.select(*keys, *_MEANS, *_CELLS, F.col("n").cast("double").alias("n"), *more).mapInArrow(run, schema)


def _distance(own_noise: bool) -> Column:
    """The squared Mahalanobis distance of x0.. to m0.. under p00..; own_noise: each variance v0.. raised by the text's, the correlations as they are."""
    d = [f"(x{i} - m{i})" + (f" / sqrt(1 + {NOISE[i]} / v{i})" if own_noise else "") for i in range(_P)]
    return F.expr("greatest(" + " + ".join(f"{1 if i == j else 2} * ({d[i]}) * ({d[j]}) * p{i}{j}" for i, j in _PAIRS) + ", 0D)")


def _with(rows: DataFrame, table: DataFrame, more: list[str] | None = None) -> DataFrame:
    """Joins a row per group; null languages and sources are values. Spark broadcasts the groups if their table is small."""
    renamed = table.withColumnsRenamed({"lang": "_l", "source": "_s", **{c: f"_{c}" for c in more or []}})
    on = rows["lang"].eqNullSafe(renamed["_l"]) & rows["source"].eqNullSafe(renamed["_s"])
    for c in more or []:
        on = on & (rows[c] == renamed[f"_{c}"])
    return rows.join(renamed, on).drop("_l", "_s", *(f"_{c}" for c in more or []))


_PRODUCTS = [f"q{i}{j}" for i, j in _PAIRS]
_TOTALS = ["n", *(f"s{i}" for i in range(_P)), *_PRODUCTS]


def _exprs(said: list[str]) -> list[Column]:
    return [F.expr(x) for x in said]


def _sums() -> list[Column]:
    """Number, sums and sums of products of x0.. ."""
    return _exprs(["cast(count(1) AS double) AS n", *[f"sum(x{i}) AS s{i}" for i in range(_P)], *[f"sum(x{i} * x{j}) AS q{i}{j}" for i, j in _PAIRS]])


def _estimated(sums: DataFrame, keys: list[str], scale: float, more: tuple[str, ...] | list[str] = ()) -> DataFrame:
    """Mean and covariance of number, sums and sums of products."""
    return sums.selectExpr(*keys, "n", *[f"s{i} / n AS m{i}" for i in range(_P)], *[f"(q{i}{j} / n - s{i} / n * s{j} / n) * {scale}D AS c{i}{j}" for i, j in _PAIRS], *more)


def starts(rows: DataFrame) -> DataFrame:
    """(lang, source, start, n, m0.., c00..): three first estimates of each group."""
    by = ["lang", "source"]
    quart = rows.groupBy(*by).agg(*[F.percentile_approx(f"x{i}", [0.25, 0.5, 0.75], 1000).alias(f"q{i}") for i in range(_P)], F.count(F.lit(1)).cast("double").alias("n"))
    quart = stored(quart, "quartiles")
    spread = [f"greatest((q{i}[2] - q{i}[0]) / 1.349D, {GUARD**0.5}D)" for i in range(_P)]
    middle = [f"q{i}[1] AS m{i}" for i in range(_P)]
    first = quart.selectExpr(*by, "'quartiles' AS start", "n", *middle, *[(f"pow({spread[i]}, 2)" if i == j else "0D") + f" AS c{i}{j}" for i, j in _PAIRS])
    second = _estimated(rows.groupBy(*by).agg(*_sums()), by, 1.0).withColumn("start", F.lit("all"))
    centred = _with(rows, quart.selectExpr(*by, *middle, *[f"{z} AS z{i}" for i, z in enumerate(spread)]))
    centred = centred.selectExpr(*by, *_MEANS, *[f"z{i}" for i in range(_P)], *[f"(x{i} - m{i}) / z{i} AS u{i}" for i in range(_P)])
    length = "greatest(" + " + ".join(f"u{i} * u{i}" for i in range(_P)) + ", 1e-12D)"
    signs = centred.groupBy(*by).agg(*_exprs([
        "cast(count(1) AS double) AS n", *[f"first(m{i}) AS m{i}" for i in range(_P)], *[f"avg(u{i} * u{j} / {length}) * {_P} * first(z{i}) * first(z{j}) AS c{i}{j}" for i, j in _PAIRS],
    ]))
    third = signs.withColumn("start", F.lit("directions"))
    cols = [*by, "start", "n", *_MEANS, *_CELLS]
    return first.select(*cols).unionByName(second.select(*cols)).unionByName(third.select(*cols))


def raw_mcd(rows: DataFrame) -> DataFrame:
    """(lang, source, n, m0.., c00.., v0.., p00.., logdet): of each group the estimate with the least determinant over the starts."""
    keys = ["lang", "source", "start"]
    est = stored(_inverted(starts(rows), keys), "mcd").withColumn("logdet", F.lit(float("inf")))
    every_step: list[DataFrame] = []
    while True:
        # moments per distance bin: the H share is cut from rows of bins, so a step reads the documents' rows once
        near = _with(rows, est.drop("n")).withColumn("bin", F.floor(F.log2(_distance(False) + 1e-9) * BINS_PER_OCTAVE).cast("int"))
        per_bin = stored(near.groupBy(*keys, "bin").agg(F.first("logdet").alias("was"), *_sums()), "bins")
        upto = F.sum("n").over(W.partitionBy(*keys).orderBy("bin").rowsBetween(W.unboundedPreceding, -1))
        taken = per_bin.withColumn("before", F.coalesce(upto, F.lit(0.0))).withColumn("all", F.sum("n").over(W.partitionBy(*keys))).filter(F.col("before") < F.col("all") * H)
        sums = taken.groupBy(*keys).agg(*_exprs([*(f"sum({c}) AS {c}" for c in _TOTALS), "first(was) AS was"]))
        now = stored(_inverted(_estimated(sums, keys, _scale(H), ["was"]), keys, ["was"]), "mcd")
        forget(per_bin)
        every_step.append(now)
        # a start whose determinant no longer falls takes no part in further steps
        est = now.filter(F.col("logdet") < F.col("was") + math.log1p(-FALL)).drop("was")
        if est.isEmpty():
            break
    every = reduce(DataFrame.unionByName, every_step).drop("was")
    cols = [c for c in every.columns if c not in keys and c != "logdet"]
    return every.groupBy("lang", "source").agg(F.min(F.struct("logdet", "start", *cols)).alias("b")).select("lang", "source", "b.*").drop("start")


def drawn(est: DataFrame) -> DataFrame:
    """(lang, source, n, m0.., c00..) drawn towards the language's estimate, and this towards that of all."""

    def mixture(table: DataFrame, keys: list[str]) -> DataFrame:
        sums = table.groupBy(*keys).agg(*_exprs(["sum(n) AS n", *[f"sum(n * m{i}) AS s{i}" for i in range(_P)], *[f"sum(n * (c{i}{j} + m{i} * m{j})) AS q{i}{j}" for i, j in _PAIRS]]))
        return _estimated(sums, keys, 1.0)

    def towards(both: DataFrame, keys: list[str]) -> DataFrame:
        """From a table and its parent's columns beside it, with an underscore."""
        mean = [f"(n * m{i} + {PRIOR} * _m{i}) / (n + {PRIOR}) AS m{i}" for i in range(_P)]
        cov = [f"(n * c{i}{j} + {PRIOR} * _c{i}{j} + n * {PRIOR} / (n + {PRIOR}) * (m{i} - _m{i}) * (m{j} - _m{j})) / (n + {PRIOR}) AS c{i}{j}" for i, j in _PAIRS]
        return both.selectExpr(*keys, "n", *mean, *cov)

    est = stored(est.select("lang", "source", "n", *_MEANS, *_CELLS), "groups")
    langs = stored(mixture(est, ["lang"]), "langs")
    root = mixture(langs, []).first()  # one row
    langs = towards(langs.select("*", *[F.lit(root[c]).cast("double").alias(f"_{c}") for c in (*_MEANS, *_CELLS)]), ["lang"])
    parents = langs.select(*[F.col(c).alias(f"_{c}") for c in ("lang", *_MEANS, *_CELLS)])
    return towards(est.join(parents, est["lang"].eqNullSafe(parents["_lang"])), ["lang", "source"])


def mcd(rows: DataFrame) -> DataFrame:
    """The robust mean, covariance and its inverse of each group (lang, source) of rows x0.. with their statistics."""
    est = stored(_inverted(drawn(raw_mcd(rows)), ["lang", "source"]), "mcd")
    near = _with(rows, est.drop("n", "logdet")).filter(_distance(True) <= chi2_quantile(0.01, _P))
    sums = near.groupBy("lang", "source").agg(*_sums())
    # groups none of whose rows are within the limit keep the estimate that they have
    last = _estimated(sums, ["lang", "source"], _scale(0.99))
    kept = est.select("lang", "source", F.lit(0.0).alias("n"), *_MEANS, *_CELLS)
    both = last.unionByName(kept).groupBy("lang", "source").agg(F.max_by(F.struct("n", *_MEANS, *_CELLS), "n").alias("b")).select("lang", "source", "b.*")
    return stored(_inverted(drawn(both), ["lang", "source"]), "mcd")


def judge(docs: DataFrame) -> DataFrame:
    """(doc_id, n_words, the base statistics, base_failed, kept, distance) for every row of docs."""
    rows = statistics(docs).select("doc_id", "lang", "source", *_STATS, base_failed().alias("base_failed"), *features())
    rows = stored(rows, "stats")
    est = mcd(rows)
    out = _with(rows, est.drop("n", "logdet")).withColumn("distance", _distance(True))
    kept = ~F.col("base_failed") & (F.col("distance") <= chi2_quantile(TAIL, _P))
    return out.select("doc_id", *_STATS[:5], "base_failed", kept.alias("kept"), "distance")
