"""Draws from posteriors, and sequences generated from them.

A context's distribution is drawn once and then joined, so that its windows share it. Draws are expressions of the row's key (see numeric.log_gamma_draw),
so results don't depend on partitions, reruns or the engine.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from seqloom.functions import numeric as N
from seqloom.functions import symbols as S
from seqloom.operators import cells
from seqloom.sources.shared import kept


def drawn(conc: DataFrame, samples: int, seed: int = 0, by: Sequence[str] | None = None) -> DataFrame:
    """Replaces conc by logps: `samples` draws of each row's letter probabilities, told by the seed and the row's other columns, or those of `by`."""
    others = [c for c in conc.columns if c != "conc"]
    key = [F.lit(seed), *(F.col(c) for c in by or others)]
    draws = F.transform(F.sequence(F.lit(0), F.lit(samples - 1)), lambda s: N.log_dirichlet_draw(F.col("conc"), *key, s))
    return conc.select(*others, draws.alias("logps"))


def posterior_samples(table: DataFrame, group: int, alpha: float, samples: int, seed: int = 0) -> DataFrame:
    """(kmer, sample, logp array): draws of each context's letter probabilities."""
    src = table.select("kmer", F.transform(cells.counts(table, group), lambda c: c + F.lit(float(alpha))).alias("conc"))
    return drawn(src, samples, seed).select("kmer", F.posexplode("logps").alias("sample", "logp"))


#: Letters that one lookup serves, and lookups between tables that are stored, which cuts the lineage.
AHEAD, ROUNDS = 4, 4
#: Contexts of a table that one lookup carries whole, which then serves all letters; no more than a lookup of AHEAD letters may carry anyway.
WHOLE = AHEAD * 5 ** (AHEAD - 1)


def successors(table: DataFrame, lag: int, group: int, ahead: int) -> DataFrame:
    """(inner, counts): for each run of lag - ahead + 1 letters, the counts of every context that has it, by context.

    A context and what follows it within `ahead` letters all have the context's last lag - ahead + 1 letters, so one lookup of these serves `ahead`
    letters. A run has at most ahead * 5^(ahead - 1) contexts, whatever the table's size.
    """
    inner = lag - ahead + 1
    places = F.array_distinct(F.transform(F.sequence(F.lit(1), F.lit(ahead)), lambda i: F.substring(F.col("kmer"), i, F.lit(inner))))
    letters = F.slice(cells.counts(table, group), 1, F.size(cells.counts(table, group)) - 1)
    each = table.select(F.explode(places).alias("inner"), F.struct("kmer", letters.alias("c")).alias("e"))
    return each.groupBy("inner").agg(F.map_from_entries(F.collect_list("e")).alias("counts"))


def _letter(conc: Column, best: bool, seed: int, at: Sequence[Column], tail: Column, step: Column, names: Column) -> Column:
    """The next letter under concentrations: the largest log probability, of the mean or of a draw, plus Gumbel noise; the first of equal ones."""
    logp = F.transform(conc, lambda x: F.log(x)) if best else N.log_dirichlet_draw(conc, F.lit(seed), *at, tail, F.lit(0))
    noisy = F.transform(logp, lambda x, i: F.round(x + N.gumbel(F.lit(seed), *at, step, F.element_at(names, i + 1)), 9))
    return N.bound(noisy, lambda v: F.element_at(names, F.array_position(v, F.array_max(v)).cast("int")))


def _walked(at: DataFrame, table: dict[str, list[int]], lag: int, letters: str, best: bool, alpha: float, seed: int) -> DataFrame:
    """The state `at` (seed_id, seq, rep, side, tail, grown, todo) with all its letters grown, for a table of few contexts, which each task holds. In numpy, the rows of a batch step by step."""
    n, schema = len(letters), at.schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = [f.name for f in schema.fields]
        none = [0] * n
        for whole in batches:
            for b in (whole.slice(k, 1024) for k in range(0, whole.num_rows, 1024)):
                ids, reps, sides, tails, grown, todo = (b.column(names.index(c)).to_pylist() for c in ("seed_id", "rep", "side", "tail", "grown", "todo"))
                keys = ["|".join(str(x) for x in (seed, i, r, s) if x is not None) for i, r, s in zip(ids, reps, sides, strict=True)]
                live, step = [k for k, t in enumerate(todo) if (t or 0) > 0], 0
                while live:
                    step += 1
                    conc = np.array([table.get(tails[k], none) for k in live], np.float64) + alpha
                    logp = np.log(conc) if best else N.log_dirichlet_draws(conc, [f"{keys[k]}|{tails[k]}|0" for k in live])
                    noise = -np.log(-np.log(N.uniforms([f"{keys[k]}|{step}|{x}" for k in live for x in letters]))).reshape(-1, n)
                    for k, i in zip(live, np.round(logp + noise, 9).argmax(axis=1).tolist(), strict=True):
                        tails[k], grown[k] = (tails[k] + letters[i])[-lag:], grown[k] + letters[i]
                    live = [k for k in live if todo[k] > step]
                made = {"tail": pa.array(tails, pa.string()), "grown": pa.array(grown, pa.string())}
                yield pa.RecordBatch.from_arrays([made.get(c, b.column(j)) for j, c in enumerate(names)], names)

    return at.mapInArrow(run, schema)


def generated(
    seeds: DataFrame, table: DataFrame, lag: int, group: int, *, left: int = 0, right: int = 0, samples: int = 1, best: bool = False, alpha: float = 0.1,
    predict: Callable[[DataFrame], DataFrame] | None = None, h: float = 1.0, seed: int = 0, ref_group: int | None = None, alphabet: str = "dna",
) -> DataFrame:
    """(seed_id, rep, seq): each seed (seed_id, seq) grown on both sides, never stopping; the left side through the reverse complement.

    seeds may have columns `left` and `right` with lengths of their own. Counts, for the left side too, come from `table`, which should then
    hold both strands; nothing is collected but a table of at most WHOLE contexts. Without predict the prior is alpha (BMM), and a join with the successors of the contexts serves AHEAD letters.
    With predict it is f / h, and each letter takes a join and the model; ref_group: the group of the reference's counts, for a model that needs them.
    Every repeat of a seed walks, on each side, under one model drawn for it: a context's letters are told by (seed,
    repeat, side, context), so a context that comes again has the same ones. best takes the posterior mean instead. The
    letter is then drawn by Gumbel noise from md5. Alphabets without a complement grow to the right alone.
    """
    letters = S.ALPHABETS[alphabet]
    n, names, one_sided = len(letters), F.array(*[F.lit(x) for x in letters]), alphabet != "dna"
    if one_sided and (left or "left" in seeds.columns):
        raise ValueError(f"{alphabet} has no reverse complement, so nothing grows to the left")
    state = ["seed_id", "seq", "rep", "side", "tail", "grown", "todo"]

    def side(name: str, start: Column, size: int) -> Column:
        todo = F.col(name) if name in seeds.columns else F.lit(size)
        return F.struct(F.lit(name[0].upper()).alias("side"), start.alias("start"), todo.cast("int").alias("todo"))

    sides = F.array(*([] if one_sided else [side("left", S.reverse_complement(F.col("seq")), left)]), side("right", F.col("seq"), right))
    at = seeds.select("seed_id", "seq", F.explode(F.sequence(F.lit(0), F.lit(samples - 1))).alias("rep"), sides.alias("sides")).select("seed_id", "seq", "rep", F.inline("sides"))
    at = at.withColumn("tail", F.right(F.concat(F.lit(S.START * lag), "start"), F.lit(lag))).withColumn("grown", F.lit(""))
    at = kept(at.select(*state), "seeds")
    steps, key = at.agg(F.max("todo")).first()[0] or 0, [F.col(c) for c in ("seed_id", "rep", "side")]
    none = F.array_repeat(F.lit(0).cast("bigint"), n)
    if predict is None:
        table = kept(table, "counts")
        whole = table.count() <= WHOLE
        ahead = reach = min(AHEAD, lag + 1)
        if whole:  # bounded by WHOLE
            at = _walked(at, {r["kmer"]: list(r["c"])[:n] for r in table.select("kmer", cells.counts(table, group).alias("c")).collect()}, lag, "".join(letters), best, float(alpha), seed)
            steps = 0
        following = kept(successors(table, lag, group, ahead), "successors") if steps else None
        for k, begin in enumerate(range(0, steps, reach)):

            def grow(s: Column, step: Column) -> Column:
                conc = F.transform(F.coalesce(F.try_element_at("counts", s["tail"]), none), lambda c: c + F.lit(float(alpha)))
                letter = F.when(F.col("todo") >= step, _letter(conc, best, seed, key, s["tail"], step, names)).otherwise("")
                return N.bound(letter, lambda x: F.struct(F.right(F.concat(s["tail"], x), F.lit(lag)).alias("tail"), F.concat(s["grown"], x).alias("grown")))

            rows = at.withColumn("inner", F.right(F.col("tail"), F.lit(lag - ahead + 1))).join(following, "inner", "left")
            walked = F.aggregate(F.sequence(F.lit(begin + 1), F.lit(begin + reach)), F.struct("tail", "grown"), grow)
            at = rows.withColumn("w", walked).select(*state[:4], "w.tail", "w.grown", "todo")
            if (k + 1) % ROUNDS == 0 and begin + reach < steps:
                at = kept(at, "grown")
    else:
        own = [cells.counts(table, ref_group).alias(f"g{ref_group}")] if ref_group is not None else []
        counts = kept(table.select(F.col("kmer").alias("tail"), F.slice(cells.counts(table, group), 1, n).alias("_c"), *own), "counts")
        for step in range(1, steps + 1):
            rows = at.join(counts, "tail", "left").withColumn("_c", F.coalesce("_c", none))
            if own:
                rows = rows.withColumn(f"g{ref_group}", F.coalesce(f"g{ref_group}", F.array_repeat(F.lit(0).cast("bigint"), n + 1)))
            rows = predict(rows.withColumn("kmer", F.col("tail")))
            conc = F.array(*[(F.col(f"f{i}") + N.EPSILON) / h + F.col("_c")[i] for i in range(n)])
            rows = rows.withColumn("letter", F.when(F.col("todo") >= step, _letter(conc, best, seed, key, F.col("tail"), F.lit(step), names)).otherwise(""))
            at = rows.withColumn("tail", F.right(F.concat("tail", "letter"), F.lit(lag))).withColumn("grown", F.concat("grown", "letter")).select(*state)
            if step % (AHEAD * ROUNDS) == 0 and step < steps:
                at = kept(at, "grown")
    flank = lambda name: F.coalesce(F.max(F.when(F.col("side") == name, F.col("grown"))), F.lit(""))
    both = at.groupBy("seed_id", "rep", "seq").agg(flank("L").alias("l"), flank("R").alias("r"))
    return both.select("seed_id", "rep", F.concat(S.reverse_complement(F.col("l")), "seq", "r").alias("seq"))


def site_entropy(seqs: DataFrame) -> DataFrame:
    """(pos, entropy) of the letters at each position of (seq)."""
    each = seqs.select(F.posexplode(F.split("seq", "(?!^)")).alias("pos", "letter")).filter("letter != ''").groupBy("pos", "letter").agg(F.count(F.lit(1)).alias("n"))
    # sum over letters of -n/N ln(n/N) = ln N - sum(n ln n) / N
    return each.groupBy("pos").agg((F.log(F.sum("n")) - F.sum(F.col("n") * F.log("n")) / F.sum("n")).alias("entropy"))
