"""Exact neighbour search over a two-level tree of bounding balls, and the tiles below it.

Copies of a vector are collapsed to one weighted location first. Locations go to the nearest of about sqrt(T) pivots (T: tiles
that the table fills), and within such a cell to the nearest of its own pivots, again about sqrt(T), so assigning n locations
takes n sqrt(T) distances. A ball of more than a tile is cut into shells by distance to its centre, so every tile is known by
its centre and the least and greatest distance to it.

A search compares tiles by these three first: balls of cells, then tiles of the cells that remain. By the triangle
inequality a tile can only hold something within reach of another if their shells come that close. What is left are pairs of
tiles. Neighbouring tiles of a block travel together, ``GROUPED`` full tiles in a group: a location is sent once to each
group that holds a tile of its pairs, so where nothing can be pruned (high-dimensional noise, many small balls) a block of n
locations ships 2 n^2 / (GROUPED * tile) rows however small its tiles are. One task step compares a group of members with one
of visitors, a few hundred rows at a time, and returns at most k neighbours per visitor, or one link per location of the pair.
Visitors of a tile are parted by how far they have to look, so that one lonely location does not make its whole tile look
far; how far is bounded by the k nearest of its own group. Nothing is
approximate, and no ball, however full, has to fit one task. Clusters far smaller than a tile share its shells and are not told
apart; a smaller ``tile`` prunes more and costs more tasks. ``approximate`` has the other way, chosen by ``method``.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from math import ceil, isqrt

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from newsloom.operators.approximate import lsh_search
from newsloom.operators.windows import number_within, top_n
from newsloom.session import cut_lineage

TILE = 2048  # rows of a tile
GROUPED = 4  # full tiles that travel together, as one side of a comparison
STRIPE = 256  # rows of one side that are compared at once
ASSIGNED = 8  # tiles of locations that one step gives to the balls of a cell


def locations(points: DataFrame, keep_ids: int = 0) -> DataFrame:
    """``(block, loc, vector, weight[, ids])`` of ``points(block, id, vector)``: one row per distinct vector.

    ``ids`` are the smallest ids of the location; no neighbour list ever needs more than k + 1 of them.
    """
    collapsed = points.groupBy("block", "vector").agg(F.min("id").alias("loc"), F.count(F.lit(1)).alias("weight"))
    if not keep_ids:
        return collapsed
    first = top_n(points.select("block", "vector", "id"), ["block", "vector"], [F.asc("id")], keep_ids, "__r")
    named = first.groupBy("block", "vector").agg(F.sort_array(F.collect_list("id")).alias("ids"))
    return collapsed.join(named, ["block", "vector"])


def _matrix(vectors: pd.Series) -> np.ndarray:
    return np.vstack(vectors.to_numpy()).astype(np.float64)


def _frame(columns: dict[str, list]) -> pd.DataFrame:
    """Plain object columns: the target schema decides the types, also of empty results."""
    return pd.DataFrame({name: pd.Series(values, dtype=object) for name, values in columns.items()})


def _squared(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """All squared distances between the rows of two tiles."""
    d = a @ (-2.0 * b).T
    d += (a * a).sum(1)[:, None]
    d += (b * b).sum(1)[None, :]
    return np.maximum(d, 0.0, out=d)


def _stripes(a: np.ndarray, b: np.ndarray) -> Iterator[tuple[int, np.ndarray]]:
    """``_squared`` for a few rows of ``a`` at a time, with the first row's number."""
    for at in range(0, len(a), STRIPE):
        yield at, _squared(a[at : at + STRIPE], b)


def _exact_pairs(a: np.ndarray, i: np.ndarray, b: np.ndarray, j: np.ndarray) -> np.ndarray:
    """``_exact`` of rows ``i`` of one side and ``j`` of the other, in bounded memory however many pairs there are."""
    out = np.empty(len(i))
    for at in range(0, len(i), 65_536):
        out[at : at + 65_536] = _exact(a[i[at : at + 65_536]], b[j[at : at + 65_536]])
    return out


def _exact(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Row-wise distances, without the cancellation of ``_squared``."""
    return np.sqrt(((a - b) ** 2).sum(1))


def _slack(a: np.ndarray, b: np.ndarray) -> float:
    """Bound on the rounding error of ``_squared``."""
    return 1e-12 * (float((a * a).sum(1).max(initial=0.0)) + float((b * b).sum(1).max(initial=0.0)) + 1.0)


def _to_nearest(vectors: np.ndarray, pivots: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The nearest pivot of each vector, the first of equally near ones, and the distance."""
    at = np.empty(len(vectors), dtype=np.int64)
    for i in range(0, len(vectors), 4096):
        at[i : i + 4096] = _squared(vectors[i : i + 4096], pivots).argmin(axis=1)
    return at, _exact(vectors, pivots[at])


class TileIndex:
    """Locations ``(block, loc, vector, weight)`` laid out in tiles, and the search over them."""

    def __init__(self, locs: DataFrame, tile: int = TILE):
        self.spark, self.tile = locs.sparkSession, tile
        n = locs.count()
        self.width = max(1, isqrt(max(0, ceil(n / tile) - 1)) + 1)  # pivots of either level
        self.pivots = self._choose_pivots(locs, self.width)
        types = dict(locs.dtypes)
        self.types = ", ".join(f"{c} {types[c]}" for c in ("block", "loc", "vector", "weight"))
        self.block_type, self.loc_type, self.vector_type = types["block"], types["loc"], types["vector"]
        in_cells = locs.select("block", "loc", "vector", "weight").mapInPandas(
            self._cells(self.pivots), f"{self.types}, cell int, away double"
        )
        self.single = n <= tile  # then blocks are compared whole
        self.members, self.centres = self._one_ball(in_cells) if self.single else self._tiles(cut_lineage(in_cells))
        far = self.members.agg(F.max("away").alias("away"), F.max("far").alias("far")).first()
        # well above the rounding error of a distance between vectors of this length
        longest = float(np.sqrt((self.pivots**2).sum(1)).max(initial=0.0))
        self.margin = 1e-6 * (1.0 + longest + (far["away"] or 0.0) + (far["far"] or 0.0))

    @staticmethod
    def _choose_pivots(locs: DataFrame, n: int) -> np.ndarray:
        """About the root of the number of tiles, picked by hash: the only vectors that reach the driver."""
        rows = locs.orderBy(F.xxhash64("loc", "block"), "block", "loc").limit(n).select("vector").toPandas()
        return _matrix(rows["vector"]) if len(rows) else np.zeros((1, 1))

    @staticmethod
    def _cells(pivots: np.ndarray):
        def step(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for rows in batches:
                if len(rows):
                    at, away = _to_nearest(_matrix(rows["vector"]), pivots)
                    yield rows.assign(cell=at.astype(np.int32), away=away)

        return step

    def _one_ball(self, in_cells: DataFrame) -> tuple[DataFrame, DataFrame]:
        """A table of one tile: the cell's pivot is the centre."""
        members = cut_lineage(
            in_cells.withColumn("ball", F.lit(0)).withColumn("tile", F.lit(0)).withColumn("far", F.col("away")).withColumn("grp", F.lit(0))
        )
        centres = self.spark.createDataFrame([(0, 0, self.pivots[0].tolist())], "cell int, ball int, centre array<double>")
        return members.withColumn("tile", F.concat_ws(":", "cell", "ball", "tile")), centres

    def _tiles(self, in_cells: DataFrame) -> tuple[DataFrame, DataFrame]:
        # One location in half a tile is a centre; a crowded cell takes the first of them by hash.
        drawn = in_cells.where(F.pmod(F.xxhash64("loc", "block", F.lit("centre")), F.lit(max(1, self.tile // 2))) == 0)
        drawn = top_n(drawn, ["cell"], [F.xxhash64("loc", "block"), F.asc("block"), F.asc("loc")], 4 * self.width, "ball")
        centres = drawn.select("cell", (F.col("ball") - 1).alias("ball"), F.col("vector").cast("array<double>").alias("centre"))
        whole = self.spark.createDataFrame(
            [(i, -1, p.tolist()) for i, p in enumerate(self.pivots)], "cell int, ball int, centre array<double>"
        )
        centres = cut_lineage(whole.unionByName(centres))
        parts = in_cells.groupBy("cell").agg(F.ceil(F.count(F.lit(1)) / (ASSIGNED * self.tile)).cast("int").alias("parts"))
        none = F.lit(None)
        pivot_side = centres.join(parts, "cell").select(
            none.cast(self.block_type).alias("block"), none.cast(self.loc_type).alias("loc"),
            F.col("centre").cast(self.vector_type).alias("vector"), none.cast("long").alias("weight"), "cell",
            none.cast("double").alias("away"), "ball", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("part"),
        )
        own_side = in_cells.join(parts, "cell").select(
            "block", "loc", "vector", "weight", "cell", "away", none.cast("int").alias("ball"),
            F.pmod(F.xxhash64("loc"), F.col("parts")).cast("int").alias("part"),
        )

        def assign(rows: pd.DataFrame) -> pd.DataFrame:
            is_pivot = rows["ball"].notna().to_numpy()
            pivots, own = rows[is_pivot].sort_values("ball"), rows[~is_pivot]
            if not len(own):
                return _frame({c: [] for c in ("block", "loc", "vector", "weight", "cell", "away", "ball", "far")})
            at, far = _to_nearest(_matrix(own["vector"]), _matrix(pivots["vector"]))
            found = own.assign(ball=pivots["ball"].to_numpy(dtype=np.int64)[at], far=far)
            return found[["block", "loc", "vector", "weight", "cell", "away", "ball", "far"]]

        balls = own_side.unionByName(pivot_side).groupBy("cell", "part").applyInPandas(
            assign, f"{self.types}, cell int, away double, ball int, far double"
        )
        placed = number_within(balls, ["block", "cell", "ball"], [F.asc("far"), F.asc("loc")], "__n")
        shell = F.floor((F.col("__n") - 1) / self.tile).cast("int")
        members = placed.withColumn("tile", F.concat_ws(":", "cell", "ball", shell)).drop("__n")
        self.groups = cut_lineage(self._grouped(members))
        return cut_lineage(members.join(self.groups, ["block", "tile"])), centres

    def _grouped(self, members: DataFrame) -> DataFrame:
        """``(block, tile, grp)``: tiles of a block in a row, in groups of about as many rows, ``GROUPED`` full tiles at most
        and the last one's rest."""
        sizes = members.groupBy("block", "cell", "ball", "tile").agg(F.count(F.lit(1)).alias("n"))
        whole = Window.partitionBy("block")
        before = whole.orderBy("cell", "ball", "tile").rowsBetween(Window.unboundedPreceding, -1)
        start, total = F.coalesce(F.sum("n").over(before), F.lit(0)), F.sum("n").over(whole)
        parts = F.ceil(total / (GROUPED * self.tile))
        return sizes.select("block", "tile", F.floor(start * parts / total).cast("int").alias("grp"))

    def _described(self, rows: DataFrame, *more: str | Column) -> DataFrame:
        """Tiles of some rows: their centre, and the least and greatest distance to it."""
        extra = [F.max("radius").alias("reach")] if "radius" in rows.columns else []
        found = rows.groupBy("block", "cell", "ball", "tile", *more).agg(
            F.min("far").alias("lo"), F.max("far").alias("hi"), F.count(F.lit(1)).alias("n"), F.sum("weight").alias("weight"),
            F.max("away").alias("away"), *extra,
        )
        return found.join(self.centres, ["cell", "ball"])

    def _cell_pairs(self, visiting: DataFrame, visited: DataFrame) -> DataFrame:
        """``(block, cell, other)``: cells whose balls come within reach of each other."""
        seen = visited.groupBy("block", "cell").agg(F.max("away").alias("away"))
        per_block = seen.groupBy("block").agg(F.collect_list(F.struct("cell", "away")).alias("others"))  # the root of the tiles
        own = visiting.groupBy("block", "cell").agg(F.max("away").alias("away"), F.max("reach").alias("reach"))
        pivots, margin = self.pivots, self.margin

        def near(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for rows in batches:
                for block, cell, away, reach, others in rows.itertuples(index=False):
                    at = np.array([o["cell"] for o in others])
                    far = np.array([o["away"] for o in others])
                    hit = at[_exact(pivots[at], pivots[cell][None, :]) - away - far <= reach + margin]
                    yield _frame({"block": [block] * len(hit), "cell": [cell] * len(hit), "other": hit.tolist()})

        return own.join(per_block, "block").select("block", "cell", "away", "reach", "others").mapInPandas(
            near, f"block {self.block_type}, cell int, other int"
        )

    def tile_pairs(self, visitors: DataFrame, members: DataFrame | None = None) -> DataFrame:
        """``(block, tile, span, other, v, m)``: pairs of tiles that may hold neighbours, with the rows of either side."""
        visiting = self._described(visitors.withColumn("span", _span(F.col("radius"))), "span")
        visited = self._described(self.members if members is None else members)
        visiting, visited = cut_lineage(visiting), cut_lineage(visited)
        cells = self._cell_pairs(visiting, visited)
        columns = ["centre", "tile", "lo", "hi", "n"]
        v_side = visiting.join(cells, ["block", "cell"]).select("block", "cell", "other", *columns, "span", "reach")
        m_side = visited.select("block", F.col("cell").alias("other"), *columns).join(cells, ["block", "other"]).select(
            "block", "cell", "other", *columns, F.lit(None).cast("int").alias("span"), F.lit(None).cast("double").alias("reach")
        )
        margin = self.margin

        def close(rows: pd.DataFrame) -> pd.DataFrame:
            is_visited = rows["span"].isna().to_numpy()
            m, v = rows[is_visited], rows[~is_visited]
            out: dict[str, list] = {c: [] for c in ("block", "tile", "span", "other", "v", "m")}
            if len(m) and len(v):
                centres = _matrix(m["centre"])
                lo, hi, names, n = (m[c].to_numpy() for c in ("lo", "hi", "tile", "n"))
                for row in v.itertuples(index=False):
                    apart = _exact(centres, np.asarray(row.centre, dtype=np.float64)[None, :])
                    least = np.maximum.reduce([apart - row.hi - hi, row.lo - apart - hi, lo - apart - row.hi])
                    hit = np.flatnonzero(least <= row.reach + margin)
                    for c, value in (("block", row.block), ("tile", row.tile), ("span", int(row.span)), ("v", row.n)):
                        out[c] += [value] * len(hit)
                    out["other"] += names[hit].tolist()
                    out["m"] += n[hit].tolist()
            return _frame(out)

        pairs = v_side.unionByName(m_side).groupBy("block", "cell", "other").applyInPandas(
            close, f"block {self.block_type}, tile string, span int, other string, v long, m long"
        )
        return cut_lineage(pairs)

    def search(self, visitors: DataFrame, step: Callable[[pd.DataFrame, pd.DataFrame], pd.DataFrame], result: str,
               members: DataFrame | None = None, mutual: bool = False) -> DataFrame:
        """Apply ``step(members, visitors)`` to every pair of groups with tiles that may hold neighbours.

        ``visitors``: rows of ``members`` with a ``radius``. ``mutual``: the members are the visitors, all of a block look
        equally far, and either order of a pair says the same, so that one of them is left out.
        """
        members = self.members if members is None else members
        sides = ["radius", "loc", "vector", "weight"]
        if self.single:
            rows = members.withColumn("radius", F.lit(0.0)).select("block", *sides, F.lit(True).alias("member"))
            rows = rows.unionByName(visitors.select("block", *sides, F.lit(False).alias("member")))
            return rows.groupBy("block").applyInPandas(_both(step), result)
        pairs = self.tile_pairs(visitors, members).select("block", "tile", "span", "other")
        met = pairs.join(self.groups.withColumnRenamed("grp", "from"), ["block", "tile"]).join(
            self.groups.select("block", F.col("tile").alias("other"), F.col("grp").alias("to")), ["block", "other"]
        )
        if mutual:
            met = met.where(F.col("from") <= F.col("to"))
        v_tiles = met.select("block", "tile", "span", "to").distinct()
        m_tiles = met.select("block", F.col("other").alias("tile"), "from").distinct()
        v_side = visitors.withColumn("span", _span(F.col("radius"))).join(v_tiles, ["block", "tile", "span"]).select(
            "block", F.col("grp").alias("from"), "to", *sides, F.lit(False).alias("member")
        )
        m_side = members.withColumn("radius", F.lit(0.0)).join(m_tiles, ["block", "tile"]).select(
            "block", "from", F.col("grp").alias("to"), *sides, F.lit(True).alias("member")
        )
        return m_side.unionByName(v_side).groupBy("block", "from", "to").applyInPandas(_both(step), result)


def _span(radius: Column) -> Column:
    """Visitors that look about equally far: by halves of powers of two; at any distance apart from others."""
    finite = F.greatest(F.lit(-100.0), F.floor(2 * F.log2(F.greatest(radius, F.lit(1e-15)))))
    return F.when(radius == float("inf"), 1000).otherwise(finite).cast("int")


def _both(step: Callable[[pd.DataFrame, pd.DataFrame], pd.DataFrame]) -> Callable[[pd.DataFrame], pd.DataFrame]:
    def compare(pair: pd.DataFrame) -> pd.DataFrame:
        is_member = pair["member"].to_numpy(dtype=bool)
        return step(pair[is_member], pair[~is_member])

    return compare


def compare_tiles(members: DataFrame, visitors: DataFrame, key: list[str], step, result: str, tile: int = TILE) -> DataFrame:
    """``step(members, visitors)`` on every pair of tiles of rows that share a key; both sides are dealt by hash."""
    sizes = (
        members.groupBy(*key).agg(F.count(F.lit(1)).alias("m"))
        .join(visitors.groupBy(*key).agg(F.count(F.lit(1)).alias("v")), key)
        .select(*key, F.ceil(F.col("m") / tile).cast("int").alias("m_tiles"), F.ceil(F.col("v") / tile).cast("int").alias("v_tiles"))
    )

    def side(rows: DataFrame, own: str, other: str, member: bool) -> DataFrame:
        radius = F.lit(0.0).alias("radius") if member else F.col("radius")
        return rows.join(sizes, key).select(
            *key, radius, "loc", "vector", "weight", F.lit(member).alias("member"),
            F.pmod(F.xxhash64("loc"), f"{own}_tiles").cast("int").alias(f"{own}_tile"),
            F.explode(F.sequence(F.lit(0), F.col(f"{other}_tiles") - 1)).alias(f"{other}_tile"),
        )

    rows = side(members, "m", "v", True).unionByName(side(visitors, "v", "m", False))
    return rows.groupBy(*key, "m_tile", "v_tile").applyInPandas(_both(step), result)


def _nearest_step(k: int):
    """Per visitor: its nearest member locations in one group, as far as their copies are needed for k neighbours."""

    def step(members: pd.DataFrame, visitors: pd.DataFrame) -> pd.DataFrame:
        if not len(members) or not len(visitors):
            return _frame({"block": [], "loc": [], "other": [], "weight": [], "distance": []})
        m, v = _matrix(members["vector"]), _matrix(visitors["vector"])
        slack, radius = _slack(v, m) + 1e-9, visitors["radius"].to_numpy(dtype=np.float64)
        names, at = np.unique(np.concatenate([members["loc"].to_numpy(), visitors["loc"].to_numpy()]), return_inverse=True)
        at_m, at_v = at[: len(m)], at[len(m) :]
        kept = []
        for start, d in _stripes(v, m):
            near = d <= (radius[start : start + len(d)] ** 2)[:, None] + slack
            crowded = np.flatnonzero(near.sum(1) > 4 * (k + 1))
            if len(crowded):
                some = d[crowded]
                near[crowded] &= some <= np.partition(some, k, axis=1)[:, k][:, None] + slack
            i, j = np.nonzero(near)
            i += start
            other = at_m[j] != at_v[i]
            i, j = i[other], j[other]
            exact = _exact_pairs(m, j, v, i)
            inside = exact <= radius[i] + 1e-9
            i, j, exact = i[inside], j[inside], exact[inside]
            order = np.lexsort((at_m[j], exact, i))
            i, j, exact = i[order], j[order], exact[order]
            first = np.arange(len(i)) - np.searchsorted(i, i) < k
            kept.append((i[first], j[first], exact[first]))
        i, j, exact = (np.concatenate(x) for x in zip(*kept, strict=True))
        return pd.DataFrame({
            "block": visitors["block"].to_numpy()[i], "loc": names[at_v[i]], "other": names[at_m[j]],
            "weight": members["weight"].to_numpy()[j], "distance": exact,
        })

    return step


def _pair_schema(locs: DataFrame) -> str:
    types = dict(locs.dtypes)
    return f"block {types['block']}, loc {types['loc']}, other {types['loc']}, weight long, distance double"


MEMBER = ["block", "loc", "vector", "weight", "cell", "away", "ball", "tile", "far", "grp"]


def _member_types(index: TileIndex) -> str:
    tile = dict(index.members.dtypes)["tile"]
    return f"{index.types}, cell int, away double, ball int, tile {tile}, far double, grp int"


def _bounds(index: TileIndex, k: int) -> DataFrame:
    """The members with an upper bound on the distance to their k-th neighbour, as ``radius``, from the rows of their own
    group; infinite where that holds too few points."""

    def bound(group: pd.DataFrame) -> pd.DataFrame:
        v, weights = _matrix(group["vector"]), group["weight"].to_numpy()
        radius, slack, used = np.empty(len(v)), _slack(v, v), min(k + 1, len(v))
        for at, d in _stripes(v, v):
            near = np.argpartition(d, used - 1, axis=1)[:, :used]  # every row has a weight of one at least
            rows = np.arange(len(d))[:, None]
            near = near[rows, np.argsort(d[rows, near], axis=1, kind="stable")]
            reached = np.cumsum(weights[near], axis=1) >= k + 1  # the point itself counts once
            first = near[rows[:, 0], reached.argmax(axis=1)]
            found = np.sqrt(d[rows[:, 0], first] + slack) + 1e-9
            radius[at : at + len(d)] = np.where(reached.any(axis=1), found, np.inf)
        return group.assign(radius=radius)

    bounded = index.members.select(*MEMBER).groupBy("block", "grp").applyInPandas(bound, f"{_member_types(index)}, radius double")
    return bounded if index.single else cut_lineage(bounded)


def _reach(index: TileIndex, k: int) -> DataFrame:
    """The members with an upper bound on the distance to their k-th neighbour, as ``radius``.

    The bound comes from the location's own group. Where that holds too few points, it is the distance to the far side of the
    fullest tile of its cell, or of its block; where these hold too few as well, the search looks at the whole block.
    """
    columns, types = MEMBER, _member_types(index)
    bounded = _bounds(index, k)
    if index.single:
        return bounded
    enough = index._described(index.members).where(F.col("weight") >= k + 1)
    full = F.max_by(F.struct("centre", "hi"), F.struct("weight", "tile"))
    by_cell = enough.groupBy("block", "cell").agg(full.alias("in_cell"))
    by_block = enough.groupBy("block").agg(full.alias("in_block"))
    lonely = bounded.where(F.col("radius") == float("inf")).join(by_cell, ["block", "cell"], "left").join(by_block, "block", "left")

    def through(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for rows in batches:
            out = rows[columns].copy()
            radius = []
            for vector, *tiles in zip(rows["vector"], rows["in_cell"], rows["in_block"], strict=True):
                v = np.asarray(vector, dtype=np.float64)[None, :]
                far = [_exact(np.asarray(t["centre"], dtype=np.float64)[None, :], v)[0] + t["hi"] + 1e-6 for t in tiles if t]
                radius.append(float(min(far, default=np.inf)))
            yield out.assign(radius=radius)

    helped = lonely.mapInPandas(through, f"{types}, radius double")
    return bounded.where(F.col("radius") < float("inf")).unionByName(helped)


def nearest_locations(index: TileIndex, visitors: DataFrame, k: int) -> DataFrame:
    """``(block, loc, other, weight, distance)``: the k nearest other locations of every visitor."""
    found = index.search(visitors, _nearest_step(k), _pair_schema(visitors))
    return top_n(found, ["block", "loc"], [F.asc("distance"), F.asc("other")], k, "__r").drop("__r")


def knn(points: DataFrame, k: int, block: str, key: str = "id", vector: str = "embedding",
        tile: int = TILE, method: str = "exact", **lsh: int) -> DataFrame:
    """``(block, id, neighbour, distance, rank)``: the k nearest other points of the same block, ties by id.

    ``method="lsh"`` looks only into likely buckets (``tables``, ``probes``, ``bucket``, ``seed`` of ``approximate``), and may
    miss some; distances and order of what it finds are exact.
    """
    if method not in ("exact", "lsh"):
        raise ValueError(f"unknown method {method}")
    # Written once: points find their locations by their vectors, which a model might not give twice
    prepared = cut_lineage(
        points.select(F.col(block).alias("block"), F.col(key).alias("id"), F.col(vector).alias("vector"))
    )
    locs = cut_lineage(locations(prepared, keep_ids=k + 1))
    if method == "lsh":
        met = lsh_search(locs, k, _nearest_step(k), _pair_schema(locs), compare_tiles, **lsh)
        pairs = top_n(met.distinct(), ["block", "loc"], [F.asc("distance"), F.asc("other")], k, "__r").drop("__r")
    else:
        index = TileIndex(locs, tile)
        pairs = nearest_locations(index, _reach(index, k), k)
    ids = locs.select("block", F.col("loc").alias("other"), "ids")
    others = pairs.join(ids, ["block", "other"]).select("block", "loc", "distance", F.explode("ids").alias("neighbour"))
    own = locs.select("block", "loc", F.lit(0.0).alias("distance"), F.explode("ids").alias("neighbour"))
    candidates = top_n(
        others.unionByName(own), ["block", "loc"], [F.asc("distance"), F.asc("neighbour")], k + 1, "__r"
    )
    lists = candidates.groupBy("block", "loc").agg(F.sort_array(F.collect_list(F.struct("distance", "neighbour"))).alias("near"))
    # Every point reads the list of its location and skips itself.
    homes = prepared.join(locs.select("block", "vector", "loc"), ["block", "vector"]).select("block", "loc", "id")
    mine = homes.join(lists, ["block", "loc"]).select(
        "block", "id", F.slice(F.filter("near", lambda x: x["neighbour"] != F.col("id")), 1, k).alias("near")
    )
    ranked = mine.select("block", "id", F.posexplode("near").alias("pos", "n"))
    return ranked.select(
        F.col("block").alias(block), F.col("id").alias(key), F.col("n.neighbour").alias("neighbour"),
        F.col("n.distance").alias("distance"), (F.col("pos") + 1).alias("rank"),
    )


def core_distances(index: TileIndex, locs: DataFrame, min_samples: int, radius: DataFrame | float | None) -> DataFrame:
    """``(block, loc, core_distance)``: distance to the ``min_samples``-th nearest other point, copies counted.

    With a radius, locations with too few points inside it have no row.
    """
    if radius is None:
        visitors = _reach(index, min_samples)
    elif isinstance(radius, DataFrame):
        visitors = index.members.join(radius, "block")
    else:
        visitors = index.members.withColumn("radius", F.lit(float(radius)))
    return _core_distances(index, locs, min_samples, visitors)


def core_locations(index: TileIndex, locs: DataFrame, min_samples: int, radius: float) -> DataFrame:
    """``(block, loc)`` of the locations with ``min_samples`` other points within a radius, copies counted.

    Most are known from the points of their own group; only the others are searched for.
    """
    bounded = cut_lineage(_bounds(index, min_samples)) if index.single else _bounds(index, min_samples)
    known = F.col("radius") <= radius
    unknown = bounded.where(~known).withColumn("radius", F.lit(float(radius)))
    searched = _core_distances(index, locs, min_samples, unknown).where(F.col("core_distance") <= radius)
    return bounded.where(known).select("block", "loc").unionByName(searched.select("block", "loc"))


def _core_distances(index: TileIndex, locs: DataFrame, min_samples: int, visitors: DataFrame) -> DataFrame:
    found = index.search(visitors, _nearest_step(min_samples), _pair_schema(locs))
    own = visitors.where(F.col("weight") > 1).select(
        "block", "loc", F.col("loc").alias("other"), (F.col("weight") - 1).alias("weight"), F.lit(0.0).alias("distance")
    )
    near = top_n(
        found.unionByName(own), ["block", "loc"], [F.asc("distance"), F.asc("other")], min_samples, "__r"
    ).groupBy("block", "loc").agg(F.sort_array(F.collect_list(F.struct("distance", "other", "weight"))).alias("near"))
    # Walk the list, at most min_samples long, until enough points are counted.
    walked = F.aggregate(
        "near",
        F.struct(F.lit(0).cast("long").alias("seen"), F.lit(None).cast("double").alias("at")),
        lambda acc, x: F.struct(
            (acc["seen"] + x["weight"]).alias("seen"),
            F.when((acc["seen"] < min_samples) & (acc["seen"] + x["weight"] >= min_samples), x["distance"])
            .otherwise(acc["at"]).alias("at"),
        ),
    )
    return near.select("block", "loc", walked["at"].alias("core_distance")).where(F.col("core_distance").isNotNull())


def _any_row(links: np.ndarray, rows: np.ndarray) -> np.ndarray:
    """Columns that one of the rows links to."""
    out = np.zeros(links.shape[1], dtype=bool)
    for at in range(0, len(rows), STRIPE):
        out |= links[rows[at : at + STRIPE]].any(axis=0)
    return out


def _forest_step(members: pd.DataFrame, visitors: pd.DataFrame) -> pd.DataFrame:
    """Links from every location of one pair of groups to the least location it reaches by steps within the radius."""
    if not len(members) or not len(visitors):
        return _frame({"block": [], "a": [], "b": []})
    m, v = _matrix(members["vector"]), _matrix(visitors["vector"])
    radius, slack = visitors["radius"].to_numpy(dtype=np.float64), _slack(v, m)
    links = np.empty((len(v), len(m)), dtype=bool)
    for start, d in _stripes(v, m):
        limit = (radius[start : start + len(d)] ** 2)[:, None]
        near = d <= np.maximum(limit - slack, 0.0)
        i, j = np.nonzero((d <= limit + slack) & ~near)
        near[i, j] = _exact_pairs(v, i + start, m, j) <= radius[i + start]
        links[start : start + len(d)] = near
    names, at = np.unique(
        np.concatenate([members["loc"].to_numpy(), visitors["loc"].to_numpy()]), return_inverse=True
    )
    at_m, at_v = at[: len(m)], at[len(m) :]
    # Breadth first from every visitor that is not reached yet: each row and column of links is read once.
    turned = np.ascontiguousarray(links.T)
    root_m, root_v = np.full(len(m), -1), np.full(len(v), -1)
    least = []
    for i in range(len(v)):
        if root_v[i] >= 0:
            continue
        root, front, low = len(least), np.array([i]), at_v[i]
        root_v[i] = root
        while len(front):
            across = np.flatnonzero(_any_row(links, front) & (root_m < 0))
            root_m[across] = root
            front = np.flatnonzero(_any_row(turned, across) & (root_v < 0))
            root_v[front] = root
            low = min(low, at_m[across].min(initial=low), at_v[front].min(initial=low))
        least.append(low)
    label = np.arange(len(names))
    label[at_v] = np.array(least)[root_v]
    reached = root_m >= 0
    label[at_m[reached]] = np.array(least)[root_m[reached]]
    linked = np.flatnonzero(label != np.arange(len(names)))
    block = members["block"].iloc[0]
    return _frame({"block": [block] * len(linked), "a": names[linked].tolist(), "b": names[label[linked]].tolist()})


def radius_forest(index: TileIndex, core: DataFrame) -> DataFrame:
    """``(block, a, b)``: links that connect the same locations as all pairs within the radius would.

    ``core``: rows of the index's members with a ``radius``, one for each block; both ends of a link are in it.
    """
    members = core.drop("radius")
    types = dict(core.dtypes)
    return index.search(
        core, _forest_step, f"block {types['block']}, a {types['loc']}, b {types['loc']}", members, mutual=True
    )
