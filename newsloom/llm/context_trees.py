"""Scoring texts by context-tree weighting over bytes.

A text is the sequence of its words (A-Z in lower case), a space between two and an end mark after the last. Each
byte is eight binary decisions, made at the nodes 1..255 of a binary tree; each node has a context tree of its own
over the DEPTH bytes before. A context that was seen n0 and n1 times estimates by Krichevsky-Trofimov,
``(n1 + 1/2) / (n0 + n1 + 1)``. A context's weighted probability of what was learned is half its own estimate and
half the product of those of its longer contexts; the posterior weights that follow mix the estimates of all depths
along a text's context. A context that was never seen adds nothing: the mixture ends with the longest one seen.

Learning and scoring both grow with the corpus, and neither holds it: texts are dealt into batches of a bounded size;
a batch gives the counts of its words and grams, and gets back the entries it needs, by a join on words and grams.
Trees are weighted level by level, by sums over the longer contexts.

Null texts are empty texts: an end mark only. With nothing to learn from, all contexts are unseen, and every bit
counts 1/2. Null ids are kept; repeated rows count and come back as often as they came in. Columns other than id and
text are not looked at.
"""

from __future__ import annotations

import math
import struct

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from newsloom.llm.spans import PrefixHash, word_edges, words_of
from newsloom.llm.tables import gathered, held_out, node_of, small_batches, stored

DEPTH = 5
BATCH_BYTES = 96 << 20
END = b"\n"  # no word holds it
END_WORD = 10
PENDING = 1 << 22  # grams that are gathered before they are counted


def pack(data: bytes) -> bytes:
    """Compressed, for shuffles: the length and a frame."""
    return struct.pack("<Q", len(data)) + pa.Codec("zstd", compression_level=1).compress(data, asbytes=True)


def unpack(packed: bytes) -> bytes:
    (size,) = struct.unpack_from("<Q", packed)
    return pa.Codec("zstd").decompress(packed[8:], size, asbytes=True)


def _packed(batches):
    for batch in batches:
        packed = [pack(words_of(t.as_py())) for t in batch.column("text")]
        columns = [batch.column(n) for n in ("doc_id", "batch", "held_out")]
        yield pa.record_batch([*columns, pa.array(packed, pa.binary())], names=["doc_id", "batch", "held_out", "packed"])


def grams_of(joined: bytes, depth: int) -> np.ndarray:
    """For each byte of a text and its end mark: the ``depth`` bytes before and the byte, as one number."""
    data = np.frombuffer(END * depth + joined + END, dtype=np.uint8).astype(np.int64)
    n = len(data) - depth
    out = np.zeros(n, dtype=np.int64)
    for i in range(depth + 1):
        out = (out << 8) | data[i : i + n]
    return out


def word_keys(joined: bytes) -> np.ndarray:
    """A hash for each token; the end mark is one."""
    start, end = word_edges(joined)
    if not len(start):
        return np.array([END_WORD], dtype=np.int64)
    return np.append(PrefixHash(joined).spans(start, end).view(np.int64), END_WORD)


class Counter64:
    """Counts of numbers, compacted whenever many are waiting."""

    def __init__(self):
        self.keys, self.counts = np.zeros(0, dtype=np.int64), np.zeros(0, dtype=np.int64)
        self.raw: list[np.ndarray] = []
        self.waiting = 0

    def add(self, keys: np.ndarray) -> None:
        self.raw.append(keys)
        self.waiting += len(keys)
        if self.waiting > PENDING:
            self.compact()

    def compact(self) -> tuple[np.ndarray, np.ndarray]:
        if self.raw:
            new, n = np.unique(np.concatenate(self.raw), return_counts=True)
            self.keys, self.counts = merged(self.keys, self.counts, new, n)
            self.raw, self.waiting = [], 0
        return self.keys, self.counts


def merged(keys: np.ndarray, counts: np.ndarray, more: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The sums of two sorted tables of counts."""
    every, total = np.concatenate([keys, more]), np.concatenate([counts, n])
    order = np.argsort(every, kind="stable")
    every, total = every[order], total[order]
    first = np.flatnonzero(np.concatenate([[True], every[1:] != every[:-1]])) if len(every) else np.zeros(0, dtype=int)
    return every[first], np.add.reduceat(total, first) if len(first) else total


def _counts(depth: int):
    """Rows come sorted by batch; a batch's counts leave when it ends."""

    def made(batch: int, words: list[Counter64], grams: list[Counter64]):
        for gram, (learned, held) in ((False, words), (True, grams)):
            other, n = held.compact()
            keys, n = merged(*learned.compact(), other, 0 * n)
            for at in range(0, len(keys), 1 << 16):
                part = slice(at, at + (1 << 16))
                size = len(keys[part])
                yield pa.record_batch(
                    [pa.array(np.full(size, batch, dtype=np.int32)), pa.array(np.full(size, gram)),
                     pa.array(keys[part]), pa.array(n[part])],
                    names=["batch", "gram", "key", "n"],
                )

    def step(batches):
        now, words, grams = None, [Counter64(), Counter64()], [Counter64(), Counter64()]
        for rows in batches:
            for batch, held, packed in zip(
                rows.column("batch").to_pylist(), rows.column("held_out").to_pylist(), rows.column("packed"), strict=True
            ):
                if batch != now:
                    if now is not None:
                        yield from made(now, words, grams)
                    now, words, grams = batch, [Counter64(), Counter64()], [Counter64(), Counter64()]
                joined = unpack(packed.as_py())
                words[held].add(word_keys(joined))
                grams[held].add(grams_of(joined, depth))
        if now is not None:
            yield from made(now, words, grams)

    return step


def _log_gamma(x: Column) -> Column:
    """Stirling's series at x + 8, for x > 0; right to ten digits."""
    y = x + 8
    shift = F.log(x)
    for i in range(1, 8):
        shift = shift + F.log(x + i)
    series = 1 / (12 * y) - 1 / (360 * y * y * y) + 1 / (1260 * y * y * y * y * y)
    return (y - 0.5) * F.log(y) - y + 0.5 * math.log(2 * math.pi) + series - shift


def log_estimate(n0: Column, n1: Column) -> Column:
    """Log of the Krichevsky-Trofimov probability of a sequence with these counts."""
    value = _log_gamma(n0 + 0.5) + _log_gamma(n1 + 0.5) - math.log(math.pi) - _log_gamma(n0 + n1 + 1.0)
    return F.when(n0 + n1 == 0, 0.0).otherwise(value)


def _decisions(grams: DataFrame) -> DataFrame:
    """The eight (node, bit) of each gram; a node's key is its context's bytes and its place 1..255."""
    i = F.col("i")
    byte = F.col("key").bitwiseAND(F.lit(255))
    place = F.call_function("shiftleft", F.lit(1), i).cast("long") + F.call_function("shiftright", byte, 8 - i)
    bit = F.call_function("shiftright", byte, 7 - i).bitwiseAND(F.lit(1).cast("long"))
    context = F.shiftleft(F.shiftright("key", 8), 8)
    return grams.withColumn("i", F.explode(F.sequence(F.lit(0), F.lit(7)))).select(
        "key", "n", (context + place).alias("node"), bit.alias("bit")
    )


def _deepest(batches):
    """Counts at the binary nodes of the longest contexts; grams come sorted, a context in one partition.

    At each depth of the binary tree the grams of a node are neighbours.
    """
    held = None

    def counted(keys: np.ndarray, n: np.ndarray):
        nodes, zeros, ones = [], [], []
        for i in range(8):
            byte = keys & 255
            node = (keys >> 8 << 8) + (1 << i) + (byte >> (8 - i))
            bit = (byte >> (7 - i)) & 1
            first = np.flatnonzero(np.concatenate([[True], node[1:] != node[:-1]]))
            nodes.append(node[first])
            zeros.append(np.add.reduceat(n * (1 - bit), first))
            ones.append(np.add.reduceat(n * bit, first))
        return pa.record_batch(
            [pa.array(np.concatenate(x)) for x in (nodes, zeros, ones)], names=["node", "n0", "n1"]
        )

    for batch in gathered(batches, 1 << 16):
        keys, n = batch.column("key").to_numpy(), batch.column("n").to_numpy()
        if held is not None:
            keys, n = np.concatenate([held[0], keys]), np.concatenate([held[1], n])
        if not len(keys):
            continue
        whole = int(np.searchsorted(keys >> 8, keys[-1] >> 8))  # the last context may go on
        held = keys[whole:], n[whole:]
        if whole:
            yield counted(keys[:whole], n[:whole])
    if held is not None and len(held[0]):
        yield counted(*held)


def gram_scores(grams: DataFrame, depth: int) -> DataFrame:
    """``(key, value)``: log10 probability of each gram's last byte, from ``(key, n)`` with n times learned."""
    levels: list[DataFrame] = []
    context = F.shiftright("key", 8)
    level = (
        grams.repartition(context)
        .sortWithinPartitions("key")
        .mapInArrow(_deepest, "node long, n0 long, n1 long")
    )
    own = log_estimate(F.col("n0"), F.col("n1"))
    level = stored(level.withColumn("own", own).withColumn("mixed", F.col("own")), f"level{depth}")
    levels.append(level)
    for d in range(depth, 0, -1):
        shorter = F.col("node").bitwiseAND(F.lit((1 << (8 * d)) - 1))
        level = (
            levels[-1]
            .groupBy(shorter.alias("node"))
            .agg(F.sum("n0").alias("n0"), F.sum("n1").alias("n1"), F.sum("mixed").alias("longer"))
            .withColumn("own", own)
        )
        mixed = (
            F.greatest("own", "longer") + F.log1p(F.exp(-F.abs(F.col("own") - F.col("longer")))) - math.log(2)
        )
        levels.append(stored(level.withColumn("mixed", mixed).drop("longer"), f"level{d - 1}"))

    # From the shortest contexts on: what they have given, what weight is left, and the estimate if they are the last
    seen = F.col("n0") + F.col("n1") > 0
    estimate = (F.col("n1") + 0.5) / (F.col("n0") + F.col("n1") + 1.0)
    stop = F.exp(F.col("own") - F.col("mixed") - math.log(2))
    root = levels[-1]
    above = root.select(
        "node",
        F.when(seen, stop * estimate).otherwise(0.5).alias("given"),
        F.when(seen, 1 - stop).otherwise(0.0).alias("left"),
        F.when(seen, estimate).otherwise(0.5).alias("q"),
    )
    for d in range(1, depth + 1):
        level = levels[depth - d].withColumn("above", F.col("node").bitwiseAND(F.lit((1 << (8 * d)) - 1)))
        parent = above.select(
            F.col("node").alias("above"), F.col("given").alias("g"), F.col("left").alias("l"), F.col("q").alias("qa")
        )
        weight = F.lit(1.0) if d == depth else stop
        above = level.join(parent, "above").select(
            "node",
            F.when(seen, F.col("g") + F.col("l") * weight * estimate).otherwise(F.col("qa")).alias("given"),
            F.when(seen, F.col("l") * (1 - weight)).otherwise(0.0).alias("left"),
            F.when(seen, F.col("g") + F.col("l") * estimate).otherwise(F.col("qa")).alias("q"),
        )
        above = stored(above, f"mixed{d}")
    chance = F.when(F.col("bit") == 1, F.col("q")).otherwise(1 - F.col("q"))
    return _decisions(grams).join(above.select("node", "q"), "node").groupBy("key").agg(F.sum(F.log10(chance)).alias("value"))


def _score(depth: int, tokens: int, distinct: int):
    whole = math.log10(tokens + 1 * (distinct + 1))

    def batch(docs: pd.DataFrame, slices: pd.DataFrame) -> pd.DataFrame:
        tables = []
        for gram in (False, True):
            part = slices[slices["gram"] == gram]
            keys, values = part["key"].to_numpy(np.int64), part["value"].to_numpy(np.float64)
            order = np.argsort(keys, kind="stable")
            tables.append((keys[order], values[order]))
        out: dict[str, list] = {k: [] for k in ("n_tokens", "n_known", "base_score", "score")}

        def looked_up(found: np.ndarray, table):
            keys, n = np.unique(found, return_counts=True)
            at = np.searchsorted(table[0], keys)
            if len(keys) and (at.max() >= len(table[0]) or (table[0][at] != keys).any()):
                raise KeyError("a batch lacks entries of its own texts")
            return table[1][at], n

        for packed in docs["packed"]:
            joined = unpack(packed)
            times, n = looked_up(word_keys(joined), tables[0])
            values, m = looked_up(grams_of(joined, depth), tables[1])
            out["n_tokens"].append(int(n.sum()))
            out["n_known"].append(int(n[times > 0].sum()))
            out["base_score"].append(float((np.log10(times + 1) - whole) @ n))
            out["score"].append(float(values @ m))
        return docs[["doc_id", "held_out"]].assign(train_tokens=tokens, **out)

    return batch


def score_texts(docs: DataFrame, modulus: int = 7, depth: int = DEPTH, batch_bytes: int = BATCH_BYTES) -> DataFrame:
    """``(doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score)``, one row per row of ``docs``.

    Learns from the texts whose crc32(doc_id) does not leave 2 modulo ``modulus``. ``base_score`` is the log10
    probability by counts of whole words, with one added to each; ``score`` that of the weighted context trees.
    """
    size = docs.agg(F.sum(F.octet_length("text")).alias("n")).first()["n"] or 0
    batches = max(1, math.ceil(size / batch_bytes))
    placed = small_batches(
        docs.select(
            F.col("doc_id").cast("long").alias("doc_id"),
            F.pmod(F.xxhash64(F.lit("batch"), node_of("doc_id")), F.lit(batches)).cast("int").alias("batch"),
            held_out("doc_id", modulus).alias("held_out"),
            "text",
        )
    ).mapInArrow(_packed, "doc_id long, batch int, held_out boolean, packed binary")
    counted = stored(
        placed.repartition("batch")
        .sortWithinPartitions("batch")
        .mapInArrow(_counts(depth), "batch int, gram boolean, key long, n long"),
        "counts",
    )
    words = counted.where("NOT gram").groupBy("key").agg(F.sum("n").alias("n"))
    totals = words.where("n > 0").agg(F.sum("n").alias("tokens"), F.count(F.lit(1)).alias("distinct")).first()
    tokens, distinct = totals["tokens"] or 0, totals["distinct"]
    grams = stored(counted.where("gram").groupBy("key").agg(F.sum("n").alias("n")), "grams")
    values = words.select(F.lit(False).alias("gram"), "key", F.col("n").cast("double").alias("value")).unionByName(
        gram_scores(grams, depth).select(F.lit(True).alias("gram"), "key", "value")
    )
    slices = counted.select("batch", "gram", "key").join(values, ["gram", "key"])
    return (
        placed.groupBy("batch")
        .cogroup(slices.groupBy("batch"))
        .applyInPandas(
            _score(depth, tokens, distinct),
            "doc_id long, held_out boolean, train_tokens long, n_tokens long, n_known long, base_score double, "
            "score double",
        )
        .select("doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score")
    )
