"""Mixing sources to target weights: budget fitting by exact token length.

Targets: sources in code-point order (null last) weigh 1, 2, 3, 1, 2, 3, ...; they share all tokens, no target
exceeds ``cap`` times its source, and what a capped source leaves is shared again by weight. A source is first
taken whole as often as its target allows. The budget that remains is filled by a subset of its documents:

1. Documents are counted by exact length; only the histogram goes on, a row for each length of a source.
2. Of each length a seeded systematic sample of the proportional number is taken: running over the lengths, fractions add
   up and start at a seeded place, so every length is as likely to gain by them, and the sum is off by few documents.
3. That difference is closed by bounded-knapsack dynamic programming, as a subset sum: a few documents drawn by the seed,
   taken and untaken ones, are decided anew so that the sum of their lengths is what is wanted.
4. As many documents of each length as the histogram says are taken, in the order of a seeded hash.

The seeded order is split into salts, so that a length which a third of all rows share is ranked in parts; only
the salt in which a length's quota ends needs ranks at all, and rows that are equal are numbered across tasks.

Null or empty text: size 0, taken 0. Null source: a source of its own. Null ids and repeated rows are rows like
others; which of several equal rows is taken does not show. Empty table: empty result. Columns other than id,
text and source are not looked at.
"""

from __future__ import annotations

import zlib

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from newsloom.llm.tables import node_of, stored
from newsloom.operators.windows import number_within

WORD = r"[^\x20\x09-\x0D]+"
WEIGHTS = (1, 2, 3)
SALTS = 64
# Tokens of the documents that the dynamic programme decides anew, and how many of either kind there are. A difference
# beyond these tokens (single documents are longer) is brought down by whole documents first.
EXACT_TOKENS, REDRAWN = 65_536, 64


def _subset(sizes: np.ndarray, budget: int) -> np.ndarray:
    """Which of the documents, in their order, sum up to the budget, or to the largest sum below it that is reached."""
    reached = np.zeros(budget + 1, dtype=bool)
    reached[0] = True
    by = np.full(budget + 1, -1, dtype=np.int64)  # the document that first reached a sum
    for i, size in enumerate(sizes.tolist()):
        if size > budget or reached[budget]:
            continue
        new = reached[: budget + 1 - size] & ~reached[size:]
        by[size:][new] = i
        reached[size:] |= new
    chosen = np.zeros(len(sizes), dtype=bool)
    total = int(np.flatnonzero(reached)[-1])
    while total:
        chosen[by[total]] = True
        total -= int(sizes[by[total]])
    return chosen


def _drawn(rng: np.random.Generator, counts: np.ndarray, n: int) -> np.ndarray:
    """Up to ``n`` different documents out of ``counts`` of each length, as indices of lengths, in random order."""
    ends = np.cumsum(counts)
    total = int(ends[-1]) if len(ends) else 0
    if total <= n:
        found = np.arange(total)
    else:
        found = np.unique(rng.integers(0, total, 2 * n))  # fewer than asked for only by chance
    return np.searchsorted(ends, rng.permutation(found)[:n], side="right")


def fit_budget(sizes: np.ndarray, counts: np.ndarray, budget: int, seed: int = 0, exact: int = EXACT_TOKENS) -> np.ndarray:
    """Documents to take of each (positive, distinct) size, so that their tokens come to ``budget``."""
    whole = int((sizes * counts).sum())
    if budget <= 0 or not whole:
        return np.zeros(len(sizes), dtype=np.int64)
    if budget >= whole:
        return counts.astype(np.int64)
    rng = np.random.default_rng(seed)
    # as whole numbers: the share of counts[:i] that goes in is floor(places[i] / whole)
    start, places, before = int(rng.integers(0, 1 << 62)) % whole, 0, 0
    taken = np.zeros(len(sizes), dtype=np.int64)
    for i, n in enumerate(counts.tolist()):
        places += n * budget
        taken[i] = (places + start) // whole - before
        before += taken[i]
    taken = np.minimum(taken, counts)
    rest = budget - int((sizes * taken).sum())
    for at in _drawn(rng, np.ones(len(sizes), dtype=np.int64), len(sizes)):
        if abs(rest) <= exact:
            break
        most = int(counts[at] - taken[at]) if rest > 0 else int(taken[at])
        more = min(most, abs(rest) // int(sizes[at])) * (1 if rest > 0 else -1)
        taken[at] += more
        rest -= more * int(sizes[at])
    if rest > exact:  # a document a little longer than the rest, for which short ones make room below
        near = np.flatnonzero((counts > taken) & (sizes > rest) & (sizes - rest <= exact))
        if len(near):
            taken[near[0]] += 1
            rest -= int(sizes[near[0]])
    # what is drawn of the documents taken is given back, as far as the table of sums stays small
    back = _drawn(rng, taken, REDRAWN)
    given = np.cumsum(sizes[back])
    back = back[(given <= exact) | (rest + given <= 0)]
    np.subtract.at(taken, back, 1)
    rest += int(sizes[back].sum())
    while rest < 0:  # the drawn ones were too few: those follow that fit best
        have = np.flatnonzero(taken)
        fits = have[sizes[have] <= -rest]
        at = int(fits[-1] if len(fits) else have[0])
        back_n = min(int(taken[at]), max(1, -rest // int(sizes[at])))
        taken[at] -= back_n
        rest += back_n * int(sizes[at])
    open_ = rng.permutation(np.concatenate([back, _drawn(rng, counts - taken, REDRAWN)]).astype(np.int64))
    left = counts - taken
    seen: dict[int, int] = {}
    usable = []
    for at in open_.tolist():  # a document drawn on both sides is one document
        seen[at] = seen.get(at, 0) + 1
        if seen[at] <= left[at]:
            usable.append(at)
    usable = np.array(usable, dtype=np.int64)
    np.add.at(taken, usable[_subset(sizes[usable], rest)], 1)
    return taken


def _fit(exact: int, seed: int):
    def group(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values("size", kind="stable")
        own = zlib.crc32(f"{seed}{rows['src'].iloc[0]}".encode("utf-8", "surrogatepass"))
        extra = fit_budget(
            rows["size"].to_numpy(np.int64), rows["n"].to_numpy(np.int64), int(rows["budget"].iloc[0]), own, exact
        )
        return rows[["src", "size"]].assign(extra=extra)

    return group


def source_targets(sized: DataFrame, cap: int) -> DataFrame:
    """``(src, source_size, target)`` of every source of ``(src, source, size)``."""
    sources = sized.groupBy("src").agg(F.first("source").alias("source"), F.sum("size").alias("source_size"))
    ranked = number_within(sources, [], [F.col("source").asc_nulls_last()], "rank")
    weight = F.element_at(F.array(*[F.lit(w) for w in WEIGHTS]), ((F.col("rank") - 1) % len(WEIGHTS) + 1).cast("int"))
    weighed = stored(ranked.select("src", "source_size", weight.alias("weight")), "sources")
    most = F.col("source_size") * cap
    level, count = 0.0, -1
    while True:  # each turn caps at least one source more, and two numbers come back
        capped = F.lit(level) * F.col("weight") > most
        row = weighed.agg(
            F.sum("source_size").alias("all"),
            F.sum(F.when(capped, most).otherwise(0)).alias("fixed"),
            F.sum(F.when(capped, 0).otherwise(F.col("weight"))).alias("weight"),
            F.sum(capped.cast("int")).alias("capped"),
        ).first()
        if row["all"] is None or row["capped"] == count or not row["weight"]:
            break
        count, level = row["capped"], (row["all"] - row["fixed"]) / row["weight"]
    target = F.least(F.lit(level) * F.col("weight"), most.cast("double"))
    return weighed.select("src", "source_size", target.alias("target"))


def mix_sources(
    docs: DataFrame, cap: int = 3, seed: int = 17, exact: int = EXACT_TOKENS, carry: bool = False
) -> DataFrame:
    """``(doc_id, size, source_size, target, taken, copies)``, one row per row of ``docs``.

    ``copies`` says how often the mix takes the document (at most ``cap`` times), ``taken`` how many tokens that
    is. With ``carry`` the whole row of ``docs`` comes along as a struct ``row``.
    """
    size = F.coalesce(F.regexp_count("text", F.lit(WORD)), F.lit(0)).cast("long")
    whole = [F.struct(*[docs[c] for c in docs.columns]).alias("row")] if carry else []
    rows = (
        docs.select("doc_id", "source", size.alias("size"), node_of("doc_id").alias("node"), *whole)
        .withColumn("src", F.when(F.col("source").isNull(), "-").otherwise(F.concat(F.lit("+"), "source")))
        .withColumn("turn", F.xxhash64(F.lit(seed), "node", "size"))
        .withColumn("salt", F.pmod(F.shiftright("turn", 32), F.lit(SALTS)).cast("int"))
        .withColumn("at", F.monotonically_increasing_id())  # sets equal rows apart
    )
    sized = stored(rows.drop("node"), "sized")
    targets = source_targets(sized, cap)
    base = F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(0)
    plans = targets.withColumn("base", base.cast("long")).withColumn(
        "budget", F.round(F.col("target") - F.col("base") * F.col("source_size")).cast("long")
    )
    counted = stored(sized.groupBy("src", "size", "salt").agg(F.count(F.lit(1)).alias("n")), "lengths")
    lengths = counted.where("size > 0").groupBy("src", "size").agg(F.sum("n").alias("n"))
    extra = (
        lengths.join(plans.select("src", "budget"), "src")
        .groupBy("src")
        .applyInPandas(_fit(exact, seed), "src string, size long, extra long")
    )
    earlier = Window.partitionBy("src", "size").orderBy("salt").rowsBetween(Window.unboundedPreceding, -1)
    quotas = (
        counted.withColumn("before", F.coalesce(F.sum("n").over(earlier), F.lit(0)))
        .join(extra, ["src", "size"], "left")
        .withColumn(
            "quota", F.greatest(F.lit(0), F.least("n", F.coalesce("extra", F.lit(0)) - F.col("before"))).cast("long")
        )
        .join(plans, "src")
        .select("src", "size", "salt", "n", "quota", "base", "source_size", "target")
    )
    quotas = stored(quotas, "quotas")
    keys = ["src", "size", "salt"]
    split = quotas.where("quota > 0 AND quota < n").select(*keys, "quota")
    numbered = number_within(sized.select(*keys, "turn", "at").join(split, keys), keys, [F.asc("turn"), F.asc("at")], "rank")
    last = numbered.where("rank = quota").select(*keys, F.col("turn").alias("last_turn"), F.col("at").alias("last_at"))
    inside = (F.col("turn") < F.col("last_turn")) | ((F.col("turn") == F.col("last_turn")) & (F.col("at") <= F.col("last_at")))
    once = (F.col("quota") == F.col("n")) | F.coalesce(inside, F.lit(False))
    columns = ["doc_id", "size", "source_size", "target", *(["row"] if carry else [])]
    # the one shuffle of whole rows
    mixed = sized.join(quotas.join(last, keys, "left"), keys).select(
        *columns, (F.col("base") + (once & (F.col("n") > 0)).cast("int")).alias("copies")
    )
    return mixed.select(
        *columns[:4],
        (F.col("size") * F.col("copies")).alias("taken"),
        F.col("copies").cast("int").alias("copies"),
        *columns[4:],
    )
