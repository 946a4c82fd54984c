"""Near-duplicate vectors by a pivot-permutation index.

Pivots are reference points spread over a bounded sample. A vector is described by its NEAREST nearest pivots in
order. For every (label, pivot) an inverted list holds the vectors that name the pivot; two vectors are compared if
they share at least SHARED pivots, and verified by their cosine in double precision. A pair is looked at in the
list of its smallest shared pivot only. Lists longer than TILE are compared in tiles of a bounded size, one task's
worth each. What leaves a tile are sums of links and a spanning set of edges, never pairs.

Equal vectors of a label are one class with a number of copies, so copies never meet in pairs.

Null labels, and vectors that are null, empty, zero or hold null or non-finite components, link with nothing;
neither do vectors of different lengths. Null ids: a row is then known by its vector. Rows that share an id are judged
each by its own vector and count once each as links; repeated rows are copies of each other. Columns other than
vec_id, label and embedding are not looked at.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from newsloom.llm.tables import stored
from newsloom.operators.components import connected_components

# Vectors that pivots are chosen from, and the number of pivots: one for each PER_PIVOT classes, within bounds.
SAMPLE = 4096
PER_PIVOT = 32
PIVOTS = (64, 1024)
APART = 0.9  # pivots have a smaller cosine than this with one another
NEAREST = 8
SHARED = 3
TILE = 512


def spread_pivots(sample: np.ndarray, count: int) -> np.ndarray:
    """Up to ``count`` unit vectors of the sample, in order, no two of them alike."""
    chosen = np.zeros((0, sample.shape[1]))
    for row in sample:
        if not len(chosen) or (chosen @ row).max() < APART:
            chosen = np.vstack([chosen, row])
            if len(chosen) == count:
                break
    return chosen


def unit_rows(rows: np.ndarray) -> np.ndarray:
    scaled = rows / np.abs(rows).max(axis=1, keepdims=True)
    return scaled / np.linalg.norm(scaled, axis=1, keepdims=True)


def _describe(pivots: dict[int, np.ndarray]):
    """Adds the numbers of the nearest pivots, nearest first."""

    def step(batches):
        for batch in batches:
            tops = [None] * batch.num_rows
            vectors = batch.column("vector").to_pylist()
            by: dict[int, list[int]] = {}
            for i, v in enumerate(vectors):
                by.setdefault(len(v), []).append(i)
            for size, at in by.items():
                if size in pivots:
                    near = unit_rows(np.array([vectors[i] for i in at], dtype=np.float64)) @ pivots[size].T
                    order = np.argsort(-near, axis=1, kind="stable")[:, :NEAREST].astype(np.int32)
                else:  # a length that the sample does not hold: one list
                    order = np.zeros((len(at), 1), dtype=np.int32)
                for i, row in zip(at, order, strict=True):
                    tops[i] = row.tolist()
            yield pa.record_batch(
                [*batch.columns, pa.array(tops, pa.list_(pa.int32()))], names=[*batch.schema.names, "tops"]
            )

    return step


def _spanning(linked: np.ndarray) -> np.ndarray:
    """For each row of a symmetric matrix the least row of its component."""
    root = np.arange(len(linked))
    while True:
        least = np.where(linked, root[None, :], len(linked)).min(axis=1, initial=len(linked))
        new = np.minimum(root, least)
        new = new[new]
        if (new == root).all():
            return root
        root = new


def _tile_links(threshold: float, shared: int):
    def solve(rows):
        rep = np.array([r["rep"] for r in rows], dtype=np.int64)
        copies = np.array([r["copies"] for r in rows], dtype=np.int64)
        side = np.array([r["side"] for r in rows])
        tops = np.array([r["tops"] for r in rows], dtype=np.int64)
        vectors = np.array([r["vector"] for r in rows], dtype=np.float64)
        vectors /= np.abs(vectors).max(axis=1, keepdims=True)
        norm = np.linalg.norm(vectors, axis=1)
        cosine = (vectors @ vectors.T) / np.outer(norm, norm)
        both = rows[0]["both"]
        allowed = np.triu(np.ones(cosine.shape, dtype=bool), 1)
        if both:  # two tiles: only what lies across
            allowed &= side[:, None] != side[None, :]
        named = np.zeros((len(rows), int(tops.max()) + 1), dtype=np.float32)
        np.put_along_axis(named, tops, 1, axis=1)
        counts = named @ named.T
        need = min(shared, tops.shape[1])
        i, j = np.nonzero(allowed & (counts >= need) & (cosine >= threshold))
        # each pair in the list of its smallest shared pivot only
        same = tops[i][:, :, None] == tops[j][:, None, :]
        least = np.where(same.any(axis=2), tops[i], np.iinfo(np.int64).max).min(axis=1, initial=np.iinfo(np.int64).max)
        keep = least == rows[0]["pivot"]
        i, j = i[keep], j[keep]
        linked = np.zeros(cosine.shape, dtype=bool)
        linked[i, j] = linked[j, i] = True
        weight = linked @ copies
        root = rep[_spanning(linked)] if len(i) else rep
        at = np.flatnonzero(weight)
        return rep[at], weight[at], root[at]

    def step(batches):
        held: list[dict] = []

        def flush():
            out = solve(held) if len(held) > 1 else ([], [], [])
            return pa.record_batch([pa.array(x, pa.int64()) for x in out], names=["rep", "links", "root"])

        for batch in batches:
            for row in batch.to_pylist():
                if held and held[0]["tile"] != row["tile"]:
                    yield flush()
                    held = []
                held.append(row)
        if held:
            yield flush()

    return step


def vector_duplicates(vectors: DataFrame, threshold: float = 0.98, shared: int = SHARED, tile: int = TILE) -> DataFrame:
    """``(vec_id, n_links, component_id, kept)``, one row per row of ``vectors``."""
    vector = F.transform("embedding", lambda x: x.cast("double"))
    sound = (
        F.col("label").isNotNull()
        & (F.size("vector") > 0)
        & ~F.exists("vector", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
        & F.exists("vector", lambda x: x != 0)
    )
    rows = vectors.select("vec_id", "label", vector.alias("vector")).select(
        F.col("vec_id").cast("long").alias("vec_id"),
        "label",
        "vector",
        F.coalesce(F.col("vec_id").cast("long"), F.xxhash64(F.lit("no id"), "vector")).alias("node"),
        F.coalesce(sound, F.lit(False)).alias("sound"),
        F.xxhash64("label", "vector").alias("h1"),
        F.xxhash64("vector", "label", F.lit(1)).alias("h2"),
    )
    classes = stored(
        rows.where("sound").groupBy("h1", "h2", "label", "vector").agg(
            F.min("node").alias("rep"), F.count(F.lit(1)).alias("copies")
        ),
        "classes",
    )
    n = classes.count()
    count = min(max(math.ceil(n / PER_PIVOT), PIVOTS[0]), PIVOTS[1])
    sample = classes.select("vector").orderBy(F.xxhash64(F.lit("pivot"), "rep"), "rep").limit(SAMPLE).collect()
    pivots: dict[int, np.ndarray] = {}
    for size in sorted({len(r["vector"]) for r in sample}):
        of_size = np.array([r["vector"] for r in sample if len(r["vector"]) == size], dtype=np.float64)
        pivots[size] = spread_pivots(unit_rows(of_size), count)

    slim = classes.select("rep", "copies", F.col("label").cast("string").alias("label"), "vector")
    described = slim.mapInArrow(
        _describe(pivots), "rep long, copies long, label string, vector array<double>, tops array<int>"
    )
    described = stored(described.withColumn("size", F.size("vector")), "described")
    entries = described.select("rep", "copies", "label", "size", "tops", F.explode("tops").alias("pivot"))
    lists = entries.groupBy("label", "size", "pivot").agg(F.count(F.lit(1)).alias("members")).where("members > 1")
    parts = F.ceil(F.col("members") / tile).cast("int")
    posted = (
        described.select("rep", "copies", "label", "size", "vector", "tops", F.explode("tops").alias("pivot"))
        .join(lists.withColumn("parts", parts), ["label", "size", "pivot"])
        .withColumn("part", F.pmod(F.xxhash64("rep"), F.col("parts")).cast("int"))
        .withColumn("other", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
        .select(
            "rep",
            "copies",
            "vector",
            "tops",
            "pivot",
            F.col("part").alias("side"),
            (F.col("part") != F.col("other")).alias("both"),
            F.concat_ws(
                ":", "size", "pivot", F.least("part", "other"), F.greatest("part", "other"), "label"
            ).alias("tile"),
        )
    )
    # A tile of one part holds the pairs within it; of two, those across: so a row goes once into each.
    links = stored(
        posted.repartition("tile")
        .sortWithinPartitions("tile")
        .mapInArrow(_tile_links(threshold, shared), "rep long, links long, root long"),
        "links",
    )
    linked = links.groupBy("rep").agg(F.sum("links").alias("links"))
    edges = links.where("rep <> root").select(F.lit(0).alias("block"), F.col("rep").alias("a"), F.col("root").alias("b"))
    roots = connected_components(edges).select(F.col("loc").alias("rep"), "root")
    named = (
        classes.select("h1", "h2", "rep", "copies")
        .join(linked, "rep", "left")
        .join(roots, "rep", "left")
        .select("h1", "h2", "copies", F.coalesce("links", F.lit(0)).alias("links"), F.coalesce("root", "rep").alias("root"))
    )
    labelled = rows.where("sound").select("vec_id", "h1", "h2").join(named, ["h1", "h2"])
    least = labelled.groupBy("root").agg(F.min("vec_id").alias("component_id"))
    result = labelled.join(least, "root").select(
        "vec_id", (F.col("copies") - 1 + F.col("links")).alias("n_links"), "component_id"
    )
    alone = rows.where("NOT sound").select(
        "vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id")
    )
    return result.unionByName(alone).withColumn("kept", F.col("vec_id").eqNullSafe(F.col("component_id")))
