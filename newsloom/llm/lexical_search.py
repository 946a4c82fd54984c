"""Exact ranked lexical search by two hierarchies: nodes of items against nodes of documents.

Every item asks for its ``k`` best documents. A score is a sum over the item's terms of weight times the document's impact
of the term, so both sides are sparse vectors of whole numbers, and the sum over coordinate maxima of two nodes bounds every
score between them. A pair of nodes whose bound is below the weakest k-th score that its items have so far is dropped whole.

1. Items are dealt into groups of about ``GROUP_TERMS`` different terms; all below runs once for each group, over all
   documents. A group's vocabulary, weights and item hierarchy (nodes of ``FAN`` items by their heaviest term, with the
   maxima of their weights) are bounded by that number and travel with the tasks.
2. One pass over the texts counts each document's terms and keeps those of the group's vocabulary; N, L and the documents
   of each term are added up from it.
3. Documents are dealt by range of their two heaviest terms and then their ids, so that alike ones stand together and no
   term is too frequent for a task. Batches of ``BATCH`` documents get a hierarchy with coordinate maxima at every level
   (``LEAF`` documents, then ``FAN`` nodes each) and are stored.
4. The ``PROBES`` batches of the highest bound for each item are searched first; the k-th score found there is a floor.
5. All batches are searched from their roots down with these floors. A node's bound is taken for the top nodes of the items
   first and further down only below those that pass; its children see the items that passed. Leaves are scored exactly.
   A task gives at most k documents an item. The best k of all are ranked.

Bounds equal to the k-th score are followed, so ties are whole; equal scores go by ascending id, null ids last. Scores are
64-bit integers. Null and empty texts have no terms: such documents count in nothing, such items have no rows. Every row of
either table is a document or item of its own, repeated rows and ids too. Without a document that scores above 0 an item has
no rows; empty tables give none. Other columns are not looked at.
"""

from __future__ import annotations

import math
from collections import Counter
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from newsloom.llm.tables import small_batches, stored

# Letters and digits of ASCII and all beyond it make terms; A-Z are lowered and the rest becomes a space.
TERM_BYTES = bytes(b if b >= 0x80 or chr(b).isalnum() else 32 for b in range(256)).lower()
GROUP_TERMS = 200_000
BATCH, LEAF, FAN, PROBES = 4096, 32, 8, 2
BATCHES_PER_TASK = 64


def terms_of(text: str | None) -> list[bytes]:
    """The terms of a text in order; bytes beyond ASCII are parts of letters in UTF-8."""
    return text.encode("utf-8", "surrogatepass").translate(TERM_BYTES).split() if text else []


@dataclass
class Level:
    """Sparse rows: row r has ``values[ptr[r]:ptr[r + 1]]`` at ``terms[...]``, in ascending order of terms."""

    ptr: np.ndarray
    terms: np.ndarray
    values: np.ndarray

    def __len__(self) -> int:
        return len(self.ptr) - 1

    def rows(self, which: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Positions of the entries of some rows, and where each row starts among them."""
        sizes = self.ptr[which + 1] - self.ptr[which]
        starts = np.cumsum(sizes) - sizes
        return np.repeat(self.ptr[which] - starts, sizes) + np.arange(sizes.sum()), starts

    def above(self, fan: int) -> Level:
        """Rows of coordinate maxima over every ``fan`` rows."""
        row = np.repeat(np.arange(len(self)) // fan, np.diff(self.ptr))
        order = np.lexsort((self.terms, row))
        row, terms, values = row[order], self.terms[order], self.values[order]
        first = np.flatnonzero(np.r_[True, (row[1:] != row[:-1]) | (terms[1:] != terms[:-1])])
        n = -(-len(self) // fan)
        ptr = np.r_[0, np.cumsum(np.bincount(row[first], minlength=n))]
        return Level(ptr, terms[first], np.maximum.reduceat(values, first))


def level_of(rows: list[tuple[np.ndarray, np.ndarray]]) -> Level:
    ptr = np.r_[0, np.cumsum([len(t) for t, _ in rows])].astype(np.int64)
    return Level(ptr, np.concatenate([t for t, _ in rows]), np.concatenate([v for _, v in rows]))


def hierarchy(level: Level, leaf: int, fan: int) -> list[Level]:
    """Levels from the rows themselves up to one root."""
    levels = [level]
    while len(levels[-1]) > 1:
        levels.append(levels[-1].above(leaf if len(levels) == 1 else fan))
    return levels


@dataclass
class Items:
    """The items of a group: a hierarchy over those with terms, and the rows they stand for."""

    rows: np.ndarray
    levels: list[Level]
    n_terms: int

    @classmethod
    def of(cls, vectors: list[tuple[int, np.ndarray, np.ndarray]], weights: np.ndarray) -> Items:
        """From ``(row, terms, how often)`` with ascending terms; rows by their heaviest term, so that alike ones meet."""
        weighted = [(row, t, n * weights[t]) for row, t, n in vectors if len(t)]
        weighted.sort(key=lambda x: (int(x[1][np.argmax(x[2])]), x[0]))
        rows = np.array([row for row, _, _ in weighted], dtype=np.int64)
        levels = hierarchy(level_of([(t, v) for _, t, v in weighted]), FAN, FAN) if weighted else []
        return cls(rows, levels, len(weights))


class Search:
    """The best ``k`` documents of each item, over the batches that a task sees."""

    def __init__(self, items: Items, k: int, floors: np.ndarray):
        self.items, self.k = items, k
        self.least = floors.copy()  # a document below it can't be among an item's k best
        self.weakest: list[np.ndarray] = []
        self.best: list[tuple] = [None] * len(items.rows)
        self.dense = np.zeros(items.n_terms, dtype=np.int64)
        self.place = np.zeros(items.n_terms, dtype=np.int64)
        self.scored = 0
        self._weaken()

    def _weaken(self) -> None:
        """The weakest k-th score below every node of the items."""
        self.weakest = [self.least]
        for _ in self.items.levels[1:]:
            low = self.weakest[-1]
            self.weakest.append(np.minimum.reduceat(low, np.arange(0, len(low), FAN)))

    def _alive(self, node: Level, which: int, items: np.ndarray) -> np.ndarray:
        """Those of ``items`` that some document below a node may still serve."""
        own = slice(node.ptr[which], node.ptr[which + 1])
        terms = node.terms[own]
        self.dense[terms] = node.values[own]
        try:
            for height in range(len(self.items.levels) - 1, -1, -1):
                level, above = self.items.levels[height], items // FAN**height
                nodes = np.unique(above) if height else items
                at, starts = level.rows(nodes)
                bound = np.add.reduceat(level.values[at] * self.dense[level.terms[at]], starts)
                passed = (bound >= self.weakest[height][nodes]) & (bound > 0)
                items = items[passed[np.searchsorted(nodes, above)]] if height else items[passed]
                if not len(items):
                    break
            return items
        finally:
            self.dense[terms] = 0

    def batch(self, ids: np.ndarray, missing: np.ndarray, levels: list[Level], items: np.ndarray | None = None) -> None:
        items = np.arange(len(self.items.rows)) if items is None else items
        waiting = [(len(levels) - 1, 0, items)]
        while waiting:
            height, which, items = waiting.pop()
            items = self._alive(levels[height], which, items)
            if not len(items):
                continue
            if height <= 1:
                span = LEAF if height else 1
                self._leaf(ids, missing, levels[0], which * span, min((which + 1) * span, len(levels[0])), items)
            else:
                fan = FAN
                last = min((which + 1) * fan, len(levels[height - 1]))
                waiting += [(height - 1, child, items) for child in range(last - 1, which * fan - 1, -1)]

    def _leaf(self, ids, missing, docs: Level, first: int, last: int, items: np.ndarray) -> None:
        own = slice(docs.ptr[first], docs.ptr[last])
        here = np.unique(docs.terms[own])
        self.place[here] = np.arange(1, len(here) + 1)
        table = np.zeros((last - first, len(here) + 1), dtype=np.int64)
        row = np.repeat(np.arange(last - first), np.diff(docs.ptr[first : last + 1]))
        table[row, self.place[docs.terms[own]]] = docs.values[own]
        level = self.items.levels[0]
        at, starts = level.rows(items)
        scores = np.add.reduceat(table[:, self.place[level.terms[at]]] * level.values[at], starts, axis=1)
        self.place[here] = 0
        self.scored += scores.size
        hits = (scores >= self.least[items]) & (scores > 0)
        changed = False
        for j in np.flatnonzero(hits.any(axis=0)):
            d, item = np.flatnonzero(hits[:, j]), items[j]
            found = (scores[d, j], missing[first + d], ids[first + d])
            if self.best[item] is not None:
                found = tuple(np.concatenate(x) for x in zip(self.best[item], found, strict=True))
            order = np.lexsort((found[2], found[1], -found[0]))[: self.k]
            self.best[item] = tuple(x[order] for x in found)
            if len(order) == self.k and (kth := self.best[item][0][-1]) > self.least[item]:
                self.least[item], changed = kth, True
        if changed:
            self._weaken()

    def found(self) -> pa.RecordBatch:
        held = [(i, b) for i, b in enumerate(self.best) if b is not None]
        joined = [np.concatenate([b[c] for _, b in held]) if held else np.zeros(0, dtype=np.int64) for c in range(3)]
        rows = np.repeat(self.items.rows[[i for i, _ in held]], [len(b[0]) for _, b in held]) if held else np.zeros(0)
        return pa.record_batch(
            [
                pa.array(rows.astype(np.int64)),
                pa.array(joined[2], pa.int64(), mask=joined[1].astype(bool)),
                pa.array(joined[0], pa.int64()),
            ],
            names=["item", "doc_id", "score"],
        )


def _count(vocabulary: list[bytes]):
    def step(batches):
        place = {t: i for i, t in enumerate(vocabulary)}
        for batch in batches:
            sizes, terms, times = [], [], []
            for text in batch.column("text").to_pylist():
                words = terms_of(text)
                found = sorted((place[w], n) for w, n in Counter(words).items() if w in place)
                sizes.append(len(words))
                terms.append(np.array([t for t, _ in found], dtype="<i4").tobytes())
                times.append(np.array([n for _, n in found], dtype="<i8").tobytes())
            columns = [batch.column("doc_id"), pa.array(sizes, pa.int64()), pa.array(terms), pa.array(times)]
            yield pa.record_batch([c.cast(pa.binary()) if c.type == pa.null() else c for c in columns],
                                  names=["doc_id", "n", "terms", "times"])

    return step


def _frequencies(batches):
    """Documents of each term; at -1 documents with terms, at -2 all their terms."""
    total, documents, length = np.zeros(0, dtype=np.int64), 0, 0
    for batch in batches:
        n = batch.column("n").to_numpy()
        documents, length = documents + int((n > 0).sum()), length + int(n.sum())
        found = np.bincount(np.frombuffer(b"".join(batch.column("terms").to_pylist()), dtype="<i4"), minlength=len(total))
        found[: len(total)] += total
        total = found
    seen = np.flatnonzero(total)
    yield pa.record_batch(
        [pa.array(np.r_[-1, -2, seen], pa.int64()), pa.array(np.r_[documents, length, total[seen]], pa.int64())],
        names=["term", "n"],
    )


def _impacts(weights: np.ndarray, documents: int, length: int):
    """Documents that hold a term of the vocabulary, with their impacts and two heaviest terms."""

    def step(batches):
        for batch in batches:
            kept, impacts, first, second = [], [], [], []
            rows = zip(batch.column("n").to_pylist(), batch.column("terms"), batch.column("times"), strict=True)
            for i, (n, terms, times) in enumerate(rows):
                t = np.frombuffer(terms.as_buffer(), dtype="<i4")
                if not len(t):
                    continue
                tf = np.frombuffer(times.as_buffer(), dtype="<i8")
                m = 25 + (75 * n * documents) // length
                impact = (1_000_000_000 * tf) // (1000 * tf + 8 * m)
                heavy = weights[t] * impact
                order = np.argsort(-heavy, kind="stable")[:2]
                kept.append(i)
                impacts.append(impact.astype("<i4").tobytes())
                first.append(int(t[order[0]]))
                second.append(int(t[order[-1]]))
            at = pa.array(kept, pa.int64())
            columns = [
                batch.column("doc_id").take(at), batch.column("terms").take(at), pa.array(impacts, pa.binary()),
                pa.array(first, pa.int32()), pa.array(second, pa.int32()),
            ]
            yield pa.record_batch(columns, names=["doc_id", "terms", "impacts", "first", "second"])

    return step


def _pack(level: Level) -> dict[str, bytes]:
    return {
        "ptr": level.ptr.astype("<i8").tobytes(),
        "terms": level.terms.astype("<i4").tobytes(),
        "peaks": level.values.astype("<i4").tobytes(),
    }


def _unpack(found: dict[str, bytes]) -> Level:
    return Level(
        np.frombuffer(found["ptr"], dtype="<i8"),
        np.frombuffer(found["terms"], dtype="<i4"),
        np.frombuffer(found["peaks"], dtype="<i4").astype(np.int64),
    )


LEVEL = pa.struct([("ptr", pa.binary()), ("terms", pa.binary()), ("peaks", pa.binary())])
TREE_COLUMNS = (
    "batch long, ids binary, missing binary, levels array<struct<ptr: binary, terms: binary, peaks: binary>>, "
    "root struct<ptr: binary, terms: binary, peaks: binary>"
)


def _trees(batches):
    """Batches of documents in the order they come, each with its hierarchy."""
    ids, missing, vectors, made = [], [], [], 0

    def batch():
        levels = hierarchy(level_of(vectors), LEAF, FAN)
        columns = [
            pa.array([(TaskContext.get().partitionId() << 32) + made], pa.int64()),
            pa.array([np.array(ids, dtype="<i8").tobytes()]),
            pa.array([np.array(missing, dtype=np.uint8).tobytes()]),
            pa.array([[_pack(level) for level in levels[:-1]]], pa.list_(LEVEL)),
            pa.array([_pack(levels[-1])], LEVEL),
        ]
        return pa.record_batch(columns, names=["batch", "ids", "missing", "levels", "root"])

    for got in batches:
        rows = zip(got.column("doc_id").to_pylist(), got.column("terms"), got.column("impacts"), strict=True)
        for number, terms, impacts in rows:
            ids.append(number or 0)
            missing.append(number is None)
            vectors.append(
                (np.frombuffer(terms.as_buffer(), dtype="<i4"), np.frombuffer(impacts.as_buffer(), dtype="<i4"))
            )
            if len(ids) == BATCH:
                yield batch()
                ids, missing, vectors, made = [], [], [], made + 1
    if ids:
        yield batch()


def _root_bounds(items: Items):
    """For each item the batches of the highest bound among those of a task."""

    def step(batches):
        dense, level, all_ = np.zeros(items.n_terms, dtype=np.int64), items.levels[0], np.arange(len(items.rows))
        at, starts = level.rows(all_)
        bounds = np.full((PROBES, len(all_)), -1, dtype=np.int64)
        numbers = np.zeros_like(bounds)
        for got in batches:
            for number, root in zip(got.column("batch").to_pylist(), got.column("root").to_pylist(), strict=True):
                root = _unpack(root)
                dense[root.terms] = root.values
                bound = np.add.reduceat(level.values[at] * dense[level.terms[at]], starts)
                dense[root.terms] = 0
                bounds, numbers = np.vstack([bounds, bound]), np.vstack([numbers, np.full(len(all_), number)])
                top = np.argsort(-bounds, axis=0, kind="stable")[:PROBES]
                bounds, numbers = np.take_along_axis(bounds, top, 0), np.take_along_axis(numbers, top, 0)
        for bound, number in zip(bounds, numbers, strict=True):
            seen = np.flatnonzero(bound > 0)
            yield pa.record_batch(
                [pa.array(seen, pa.int64()), pa.array(number[seen], pa.int64()), pa.array(bound[seen], pa.int64())],
                names=["item", "batch", "bound"],
            )

    return step


def _search(items: Items, k: int, floors: np.ndarray, only: dict[int, np.ndarray] | None = None):
    def step(batches):
        search = Search(items, k, floors)
        for got in batches:
            columns = [got.column(c) for c in ("batch", "ids", "missing", "levels", "root")]
            for i in range(got.num_rows):
                number, ids, missing, levels, root = (c[i].as_py() for c in columns)
                if only is not None and number not in only:
                    continue
                tree = [_unpack(level) for level in (*levels, root)]
                search.batch(
                    np.frombuffer(ids, dtype="<i8"), np.frombuffer(missing, dtype=np.uint8), tree,
                    None if only is None else only[number],
                )
        yield search.found()

    return step


FOUND = "item long, doc_id long, score long"


def _best(found: DataFrame, k: int) -> DataFrame:
    order = Window.partitionBy("item").orderBy(F.desc("score"), F.asc_nulls_last("doc_id"))
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def _group(docs: DataFrame, vectors: list[tuple[int, Counter]], k: int) -> DataFrame:
    """``(item, doc_id, score, rank)`` of one group of items."""
    spark = docs.sparkSession
    vocabulary = sorted({t for _, c in vectors for t in c})
    place = {t: i for i, t in enumerate(vocabulary)}
    counted = docs.mapInArrow(_count(vocabulary), "doc_id long, n long, terms binary, times binary")
    counted = stored(counted, "term-counts")

    seen = counted.select("n", "terms").mapInArrow(_frequencies, "term long, n long").groupBy("term").agg(F.sum("n").alias("n"))
    frequency = {r["term"]: r["n"] for r in seen.collect()}  # one row for each term of the group
    documents, length = frequency.get(-1, 0), frequency.get(-2, 0)
    if not documents:
        return spark.createDataFrame([], FOUND + ", rank int")
    weights = np.array(
        [math.floor(1000 * math.log((2 * documents + 2) / (2 * frequency.get(i, 0) + 1))) for i in range(len(vocabulary))],
        dtype=np.int64,
    )
    items = Items.of(
        [
            (row, np.array(sorted(place[t] for t in c), dtype=np.int64),
             np.array([n for _, n in sorted((place[t], n) for t, n in c.items())], dtype=np.int64))
            for row, c in vectors
        ],
        weights,
    )

    impacts = counted.mapInArrow(
        _impacts(weights, documents, length), "doc_id long, terms binary, impacts binary, first int, second int"
    )
    order = ["first", "second", "doc_id"]
    at_once = min(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-documents // BATCH))
    n = max(1, at_once, -(-documents // (BATCH * BATCHES_PER_TASK)))
    dealt = impacts.repartitionByRange(n, *order).sortWithinPartitions(*order)
    trees = stored(dealt.select("doc_id", "terms", "impacts").mapInArrow(_trees, TREE_COLUMNS), "document-trees")

    bounds = trees.select("batch", "root").mapInArrow(_root_bounds(items), "item long, batch long, bound long")
    by_bound = Window.partitionBy("item").orderBy(F.desc("bound"), "batch")
    probes = bounds.withColumn("r", F.row_number().over(by_bound)).where(F.col("r") <= PROBES).collect()
    only: dict[int, list[int]] = {}
    for p in probes:  # PROBES for each item of the group
        only.setdefault(p["batch"], []).append(p["item"])
    chosen = {b: np.array(sorted(i)) for b, i in only.items()}
    floors = np.zeros(len(items.rows), dtype=np.int64)
    probed = trees.join(spark.createDataFrame([(b,) for b in chosen], "batch long"), "batch", "left_semi")
    first = probed.mapInArrow(_search(items, k, floors, chosen), FOUND)
    kth = _best(first, k).where(F.col("rank") == k).select("item", "score").collect()
    at = {int(row): i for i, row in enumerate(items.rows)}
    for r in kth:
        floors[at[r["item"]]] = r["score"]
    return _best(trees.mapInArrow(_search(items, k, floors), FOUND), k)


def ranked_documents(items: DataFrame, docs: DataFrame, k: int = 10, group_terms: int = GROUP_TERMS) -> DataFrame:
    """``(item_id, rank, doc_id, score)``: the ``k`` best of ``docs`` (doc_id, text) for each of ``items``
    (item_id, text)."""
    spark = items.sparkSession
    small_batches(docs)
    slim = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text"))

    def vectors(batches):
        for batch in batches:
            found = [sorted(Counter(terms_of(t)).items()) for t in batch.column("text").to_pylist()]
            yield pa.record_batch(
                [
                    batch.column("item_id"),
                    pa.array([[t for t, _ in f] for f in found], pa.list_(pa.binary())),
                    pa.array([[n for _, n in f] for f in found], pa.list_(pa.int64())),
                ],
                names=["item_id", "terms", "times"],
            )

    rows = items.select(F.col("item_id").cast("long").alias("item_id"), "text").mapInArrow(
        vectors, "item_id long, terms array<binary>, times array<long>"
    )
    rows = stored(rows.withColumn("item", F.monotonically_increasing_id()), "item-terms")
    total = rows.agg(F.sum(F.size("terms"))).first()[0] or 0
    n_groups = max(1, -(-total // group_terms))
    dealt = rows.withColumn("part", F.pmod(F.xxhash64("item"), F.lit(n_groups)))
    ranked = spark.createDataFrame([], FOUND + ", rank int")
    for part in range(n_groups):
        own = dealt.where((F.col("part") == part) & (F.size("terms") > 0)).select("item", "terms", "times").collect()
        if own:
            held = [(r["item"], Counter({bytes(t): n for t, n in zip(r["terms"], r["times"], strict=True)})) for r in own]
            best = _group(slim, held, k)
            ranked = ranked.unionByName(stored(best, "ranked") if n_groups > 1 else best)
    named = rows.select("item", "item_id").join(ranked, "item")
    return named.select("item_id", F.col("rank").cast("int").alias("rank"), "doc_id", "score")
