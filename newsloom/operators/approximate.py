"""Approximate neighbour search by multi-probe hashing, for vectors that no exact index can prune.

Every table has hyperplanes of random directions, each through the median of a sample's projections, so that buckets are
about equally full. A location's bucket says on which side of each plane it lies. A search looks into the bucket of its own
and then into those nearest to it: the planes closest to the location are crossed first, sets of planes in the order of the
distance that crossing them takes. What shares a bucket is compared in full, in tiles, so a crowded bucket is many tasks.

How many planes a block uses follows from its size, so buckets hold about ``bucket`` locations at any size; the work is
``tables * probes * bucket`` comparisons a location. Recall is a matter of the data: in high-dimensional noise the nearest
are hardly nearer than the rest, and small buckets miss most of them. So every block is tried first: ``TRIED`` of its
locations, picked by hash, are compared with all of it, and the block takes the most planes with which its buckets would have
shown ``RECALL`` of their neighbours. Clustered blocks keep buckets of ``bucket``; in noise they grow with the block, down to
no plane at all, which is the exact search. All locations are in the buckets, whatever was tried.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import product

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from newsloom.operators.windows import top_n
from newsloom.session import cut_lineage

TABLES, PROBES, BUCKET = 8, 6, 256
MOST_PLANES = 24
SAMPLE_ROWS = 4096  # vectors that reach the driver, picked by hash, for the medians of projections
CROSSED = 8  # planes nearest to a location that a probe may cross
TRIED, RECALL = 128, 0.95  # locations of a block that its planes are tried on, and the share of neighbours they are to show


def _matrix(vectors: pd.Series) -> np.ndarray:
    return np.vstack(vectors.to_numpy()).astype(np.float64)


def probe_order(gaps: np.ndarray, probes: int) -> np.ndarray:
    """The cheapest sets of planes to cross, as bit masks, for rows of distances to the planes.

    The first set is empty: the location's own bucket. A set costs the sum of the squared distances it crosses.
    """
    used = min(CROSSED, gaps.shape[1])
    near = np.argsort(gaps, axis=1, kind="stable")[:, :used]
    subsets = np.array(list(product((0, 1), repeat=used)), dtype=np.float64)
    cost = np.take_along_axis(gaps, near, axis=1) ** 2 @ subsets.T
    take = min(probes, len(subsets))
    best = np.argsort(cost, axis=1, kind="stable")[:, :take]
    return (subsets[best].astype(np.int64) << near[:, None, :]).sum(axis=2)


class Planes:
    """The hyperplanes of all tables."""

    def __init__(self, locs: DataFrame, tables: int, planes: int, seed: int):
        sample = locs.orderBy(F.xxhash64("loc", "block"), "block", "loc").limit(SAMPLE_ROWS).select("vector").toPandas()
        vectors = _matrix(sample["vector"])
        rng = np.random.default_rng(seed)
        directions = rng.standard_normal((tables, planes, vectors.shape[1]))
        self.directions = directions / np.linalg.norm(directions, axis=2, keepdims=True)
        self.offsets = np.median(np.einsum("nd,tpd->tpn", vectors, self.directions), axis=2)

    def sides(self, vectors: np.ndarray, table: int) -> np.ndarray:
        """Signed distances to the planes of one table."""
        return vectors @ self.directions[table].T - self.offsets[table]


def _buckets(planes: Planes, probes: int, members: bool):
    """Rows of locations once for each table (and probe), with their bucket."""

    def step(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for rows in batches:
            if not len(rows):
                continue
            vectors, used = _matrix(rows["vector"]), rows["planes"].to_numpy()
            for table in range(len(planes.directions)):
                signed = planes.sides(vectors, table)
                for count in np.unique(used):
                    own = np.flatnonzero(used == count)
                    side = signed[own, :count]
                    home = ((side > 0).astype(np.int64) << np.arange(count)).sum(axis=1)
                    if members or not count:
                        yield rows.iloc[own].assign(table=table, bucket=home)
                    else:
                        masks = probe_order(np.abs(side), probes)
                        at = np.repeat(own, masks.shape[1])
                        yield rows.iloc[at].assign(table=table, bucket=(home[:, None] ^ masks).ravel())

    return step


def _planes_that_show(planes: Planes, probes: int):
    """The most planes of a block, as rows ``(block, planes)``, that show enough of the neighbours found for its tried rows."""

    def step(rows: pd.DataFrame) -> pd.DataFrame:
        own, other = _matrix(rows["vector"]), _matrix(rows["other_vector"])
        tables = range(len(planes.directions))
        sides = [(planes.sides(own, t), planes.sides(other, t)) for t in tables]
        count = int(rows["planes"].iloc[0])
        while count > 0:
            bits = np.arange(count)
            shown = np.zeros(len(rows), dtype=bool)
            for mine, theirs in sides:
                differ = (((mine[:, :count] > 0) != (theirs[:, :count] > 0)).astype(np.int64) << bits).sum(axis=1)
                shown |= (probe_order(np.abs(mine[:, :count]), probes) == differ[:, None]).any(axis=1)
            if shown.mean() >= RECALL:
                break
            count -= 1
        return pd.DataFrame({"block": rows["block"].iloc[:1].to_numpy(), "planes": np.array([count], dtype=np.int32)})

    return step


def _tried(locs: DataFrame, sizes: DataFrame, planes: Planes, k: int, probes: int, step, result: str, compare_tiles) -> DataFrame:
    """``(block, planes)``: as many planes as ``sizes`` names, or fewer if these would show too few neighbours."""
    in_question = locs.join(sizes.where(F.col("planes") > 0), "block").select("block", "loc", "vector", "weight")
    some = top_n(in_question, ["block"], [F.xxhash64("loc", F.lit("tried")), F.asc("loc")], TRIED, "__r").drop("__r")
    some = cut_lineage(some.withColumn("radius", F.lit(float("inf"))))
    met = compare_tiles(in_question, some, ["block"], step, result)
    near = top_n(met, ["block", "loc"], [F.asc("distance"), F.asc("other")], k, "__r").select("block", "loc", "other")
    pairs = near.join(some.select("block", "loc", "vector"), ["block", "loc"]).join(
        locs.select("block", F.col("loc").alias("other"), F.col("vector").alias("other_vector")), ["block", "other"]
    )
    block = dict(locs.dtypes)["block"]
    found = pairs.join(sizes, "block").select("block", "vector", "other_vector", "planes").groupBy("block").applyInPandas(
        _planes_that_show(planes, probes), f"block {block}, planes int"
    )
    # Blocks that were not tried have no plane
    return sizes.select("block").join(found, "block", "left").select("block", F.coalesce("planes", F.lit(0)).alias("planes"))


def lsh_search(
    locs: DataFrame, k: int, step, result: str, compare_tiles, tables: int = TABLES, probes: int = PROBES,
    bucket: int = BUCKET, seed: int = 11,
) -> DataFrame:
    """``step(members, visitors)`` on every pair of tiles of locations that meet in a bucket, of ``(block, loc, vector,
    weight)``; ``compare_tiles`` deals them out. The same pair may come from several tables."""
    sizes = locs.groupBy("block").agg(F.count(F.lit(1)).alias("n"))
    wanted = F.greatest(F.lit(0), F.least(F.lit(MOST_PLANES), F.ceil(F.log2(F.col("n") / F.lit(float(bucket))))))
    sizes = sizes.select("block", wanted.cast("int").alias("planes"))
    most = sizes.agg(F.max("planes")).first()[0] or 0
    planes = Planes(locs, tables if most else 1, max(most, 1), seed)
    if most:
        sizes = cut_lineage(_tried(locs, sizes, planes, k, probes, step, result, compare_tiles))
    placed = locs.join(sizes, "block").select("block", "loc", "vector", "weight", "planes")
    types = dict(placed.dtypes)
    schema = ", ".join(f"{c} {types[c]}" for c in placed.columns) + ", table int, bucket long"
    members = placed.mapInPandas(_buckets(planes, probes, True), schema).drop("planes")
    visitors = placed.mapInPandas(_buckets(planes, probes, False), schema).drop("planes")
    visitors = cut_lineage(visitors.withColumn("radius", F.lit(float("inf"))))
    return compare_tiles(cut_lineage(members), visitors, ["block", "table", "bucket"], step, result)


def recall_of(found: DataFrame, exact: DataFrame, by: str, key: str = "id") -> DataFrame:
    """``(by, n, recall)``: the share of exact neighbours ``(by, key, neighbour)`` that were found, for each block."""
    hits = found.select(by, key, "neighbour").distinct().withColumn("__hit", F.lit(1))
    marked = exact.select(by, key, "neighbour").join(hits, [by, key, "neighbour"], "left")
    return marked.groupBy(by).agg(F.count(F.lit(1)).alias("n"), (F.count("__hit") / F.count(F.lit(1))).alias("recall"))
