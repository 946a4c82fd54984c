"""Neighbour search, components and clustering against brute force, with small tiles so that pruning is exercised."""

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from newsloom.operators.approximate import Planes, probe_order, recall_of
from newsloom.operators.components import connected_components
from newsloom.operators.neighbours import TileIndex, _reach, core_locations, knn, locations
from newsloom.plans.cluster import cluster_categories, density_cluster

DDL = "g string, id long, embedding array<double>"


def planted(copies=0):
    """Five tight groups of 40 and 30 far points; optionally many copies of one of them."""
    rng = np.random.default_rng(42)
    centres = rng.normal(size=(5, 64))
    centres /= np.linalg.norm(centres, axis=1, keepdims=True)
    points = [(k, centres[k] + 0.05 * rng.normal(size=64)) for k in range(5) for _ in range(40)]
    points += [(-1, 3 * rng.normal(size=64)) for _ in range(30)]
    points += [(0, points[0][1])] * copies
    return [t for t, _ in points], np.array([p for _, p in points])


def frame(spark, vectors, group="x"):
    return spark.createDataFrame([(group, i, v.tolist()) for i, v in enumerate(vectors)], DDL)


def distances(vectors):
    return np.sqrt(((vectors[:, None] - vectors[None]) ** 2).sum(-1))


def brute_clusters(vectors, eps, min_samples, min_size):
    d = distances(vectors)
    n = len(d)
    core = np.sort(d, axis=1)[:, min_samples] <= eps
    labels = list(range(n))

    def root(i):
        while labels[i] != i:
            i = labels[i]
        return i

    for i in range(n):
        for j in range(i):
            if core[i] and core[j] and d[i, j] <= eps:
                a, b = root(i), root(j)
                labels[max(a, b)] = min(a, b)
    found = [root(i) if core[i] else -1 for i in range(n)]
    big = sorted(r for r in set(found) - {-1} if found.count(r) >= min_size)
    return [big.index(r) if r in big else -1 for r in found]


def labels_of(df):
    return [r["cluster_id"] for r in df.orderBy("id").collect()]


@pytest.mark.parametrize("tile", [16, 2048])
def test_planted_clusters(spark, tile):
    truth, vectors = planted()
    found = labels_of(density_cluster(frame(spark, vectors), "g", eps=1.0, tile=tile))
    assert len(set(found) - {-1}) == 5
    assert found.count(-1) == 30
    assert all((t == -1) == (f == -1) for t, f in zip(truth, found, strict=True))
    assert found == brute_clusters(vectors, 1.0, 6, 15)


def test_a_third_are_copies(spark):
    truth, vectors = planted(copies=115)
    found = labels_of(density_cluster(frame(spark, vectors), "g", eps=1.0, tile=16))
    assert found == brute_clusters(vectors, 1.0, 6, 15)
    assert found.count(found[0]) == 155


def test_only_copies_make_a_cluster(spark):
    vectors = np.array([[1.0, 0.0]] * 20 + [[50.0, float(i * 10)] for i in range(10)])
    found = labels_of(density_cluster(frame(spark, vectors), "g", eps=0.5))
    assert found == [0] * 20 + [-1] * 10


def test_uneven_points_match_brute_force(spark):
    rng = np.random.default_rng(7)
    vectors = np.vstack([rng.normal(size=(150, 3)), rng.normal(size=(60, 3)) * 0.1 + 4, rng.uniform(-8, 8, size=(60, 3))])
    found = labels_of(density_cluster(frame(spark, vectors), "g", eps=0.6, min_cluster_size=8, tile=16))
    assert found == brute_clusters(vectors, 0.6, 6, 8)


def test_nearest_neighbours_with_copies_and_blocks(spark):
    rng = np.random.default_rng(3)
    base = rng.normal(size=(120, 4))
    vectors = np.vstack([base, np.repeat(base[:1], 60, axis=0)])
    df = frame(spark, vectors, "a").unionByName(frame(spark, base * 2, "b").withColumn("id", F.col("id") + 10_000))
    found = knn(df, 5, "g", tile=16).collect()
    got: dict = {}
    for r in found:
        got.setdefault(r["id"], []).append((r["rank"], r["neighbour"], r["distance"]))
    for offset, part in ((0, vectors), (10_000, base * 2)):
        d = distances(part)
        for i in range(len(part)):
            want = sorted((round(d[i, j], 9), j + offset) for j in range(len(part)) if j != i)[:5]
            have = [(round(x, 9), n) for _, n, x in sorted(got[i + offset])]
            assert have == want


def test_few_points_in_a_block(spark):
    df = frame(spark, np.eye(3))
    assert knn(df, 5, "g").count() == 6


@pytest.mark.parametrize("shape", ["chain", "star", "random"])
def test_components(spark, shape):
    n = 300
    rng = np.random.default_rng(5)
    edges = {
        "chain": [(i, i + 1) for i in range(n - 1)],
        "star": [(n, i) for i in range(n)],
        "random": [tuple(int(x) for x in rng.integers(0, n, 2)) for _ in range(180)],
    }[shape]
    df = spark.createDataFrame([("x", a, b) for a, b in edges], "block string, a long, b long")
    parent = {}

    def root(x):
        while parent.setdefault(x, x) != x:
            x = parent[x]
        return x

    for a, b in edges:
        lo, hi = sorted((root(a), root(b)))
        parent[hi] = lo
    linked = {x for a, b in edges if a != b for x in (a, b)}
    got = {r["loc"]: r["root"] for r in connected_components(df).collect()}
    assert got == {x: root(x) for x in linked}


def test_every_category_in_one_job(spark):
    _, vectors = planted()
    rows = [("big", i, v.tolist()) for i, v in enumerate(vectors)] + [("small", 900 + i, v.tolist()) for i, v in enumerate(vectors[:20])]
    articles = spark.createDataFrame(rows, "political_category string, id long, embedding array<double>")
    found = cluster_categories(articles, eps_quantile=0.85)
    sizes = {r["political_category"]: r["n"] for r in found.groupBy("political_category").agg(F.count(F.lit(1)).alias("n")).collect()}
    assert sizes == {"big": 230}  # the small category is below the floor
    per = found.where("cluster_id >= 0").groupBy("cluster_id").count().collect()
    assert per and all(r["count"] >= 15 for r in per)


def test_vectors_that_a_model_gives_only_once(spark):
    @F.pandas_udf("array<double>")
    def unstable(ids: pd.Series) -> pd.Series:
        rng = np.random.default_rng()
        return pd.Series([rng.normal(size=3).tolist() for _ in ids])

    points = spark.range(60).select("id", F.lit("c").alias("block"), unstable.asNondeterministic()("id").alias("embedding"))
    assert density_cluster(points, "block", eps=0.5).select("id").distinct().count() == 60
    assert knn(points, 2, "block").select("id").distinct().count() == 60


def spread(n, seed=1, centres=60):
    """Clusters of ten dimensions, ever more of them as there are more points."""
    rng = np.random.default_rng(seed)
    where = rng.normal(size=(centres, 10)) * 20
    return where[rng.integers(0, centres, n)] + rng.normal(size=(n, 10)) * 0.3


def looked(spark, n, tile=32):
    """Pairs of locations that a search for five neighbours compares."""
    points = frame(spark, spread(n, centres=n // 120)).select(F.col("g").alias("block"), "id", F.col("embedding").alias("vector"))
    index = TileIndex(locations(points), tile)
    pairs = index.tile_pairs(_reach(index, 5))
    return pairs.agg(F.sum(F.col("v") * F.col("m"))).first()[0]


def test_pairs_looked_at_grow_with_the_points_not_with_their_square(spark):
    few, many = looked(spark, 600), looked(spark, 2400)
    assert many < 8 * few  # sixteen-fold without pruning
    assert many < 2400 * 2400 / 8


def test_tiles_are_bounded_and_bound_their_rows(spark):
    vectors = np.vstack([spread(500), np.zeros((200, 10)) + np.linspace(0, 1e-3, 200)[:, None]])
    points = frame(spark, vectors).select(F.col("g").alias("block"), "id", F.col("embedding").alias("vector"))
    index = TileIndex(locations(points), 32)
    rows = index.members.join(index.centres, ["cell", "ball"]).toPandas()
    assert len(rows) == 700 and rows.groupby("tile").size().max() <= 32
    far = np.sqrt(((np.vstack(rows["vector"]) - np.vstack(rows["centre"])) ** 2).sum(1))
    assert np.allclose(far, rows["far"])


def test_neighbours_over_many_tiles(spark):
    """Clusters, a crowded place, lonely points and small blocks, against brute force."""
    rng = np.random.default_rng(9)
    vectors = np.vstack([spread(400, 2), rng.normal(size=(150, 10)) * 1e-3, rng.normal(size=(9, 10)) * 500])
    small = rng.normal(size=(4, 10))
    df = frame(spark, vectors, "a").unionByName(frame(spark, small, "b").withColumn("id", F.col("id") + 10_000))
    found = knn(df, 6, "g", tile=16).toPandas()
    for offset, part in ((0, vectors), (10_000, small)):
        d = distances(part)
        np.fill_diagonal(d, np.inf)
        want = np.sort(d, axis=1)[:, : min(6, len(part) - 1)]
        for i in range(len(part)):
            mine = found[found["id"] == i + offset].sort_values("rank")
            assert np.allclose(mine["distance"], want[i], atol=1e-9)


def test_hashing_finds_nine_in_ten(spark):
    vectors = np.vstack([spread(1500, 4), np.repeat(spread(1, 5), 40, axis=0)])
    df = frame(spark, vectors, "a").unionByName(frame(spark, spread(30, 6), "b").withColumn("id", F.col("id") + 10_000))
    exact = knn(df, 5, "g")
    near = knn(df, 5, "g", method="lsh", bucket=64)
    shares = {r["g"]: r["recall"] for r in recall_of(near, exact, "g").collect()}
    assert shares["a"] >= 0.9 and shares["b"] == 1.0
    wrong = near.join(exact.withColumnRenamed("distance", "sure"), ["g", "id", "neighbour"]).where("abs(distance - sure) > 1e-9")
    assert wrong.count() == 0
    with pytest.raises(ValueError):
        knn(df, 5, "g", method="guess")


def test_hashing_looks_into_few_buckets(spark):
    """With more points there are more planes: what a location is compared with stays about the same."""
    shares = []
    for n in (1000, 4000):
        df = frame(spark, spread(n, 3, centres=n // 25)).select(F.col("g").alias("block"), "id", F.col("embedding").alias("vector"))
        locs = locations(df)
        planes = Planes(locs, 1, int(np.ceil(np.log2(n / 64))), 11)
        sides = planes.sides(spread(n, 3, centres=n // 25), 0) > 0
        sizes = np.unique(sides, axis=0, return_counts=True)[1]
        shares.append((sizes**2).sum() / n)
    assert shares[1] < 2.5 * shares[0]


def test_probes_come_in_order_of_distance():
    gaps = np.array([[3.0, 1.0, 2.0]])
    assert probe_order(gaps, 6).tolist() == [[0, 0b010, 0b100, 0b110, 0b001, 0b011]]


def test_noise_is_sent_by_groups_not_by_tiles(spark):
    """Where no tile can be left out, a location is sent once to each group, however small its own tile is."""
    vectors = np.random.default_rng(8).normal(size=(640, 64))
    points = frame(spark, vectors).select(F.col("g").alias("block"), "id", F.col("embedding").alias("vector"))
    index = TileIndex(locations(points), 16)

    def step(members, visitors):
        return pd.DataFrame({"sent": [len(members) + len(visitors)], "pairs": [len(members) * len(visitors)]})

    sent, pairs = index.search(_reach(index, 5), step, "sent long, pairs long").agg(F.sum("sent"), F.sum("pairs")).first()
    assert sent <= 2 * 640 * (640 / (4 * 16) + 2)
    assert pairs == 640 * 640


def test_core_locations_are_those_with_enough_points_inside(spark):
    """Known from their own group or searched for, with copies, and at a radius that a distance meets exactly."""
    rng = np.random.default_rng(12)
    vectors = np.vstack([rng.normal(size=(200, 5)), np.repeat([[9.0] * 5], 7, axis=0), [[20.0, 0, 0, 0, float(i)] for i in range(9)]])
    points = frame(spark, vectors).select(F.col("g").alias("block"), "id", F.col("embedding").alias("vector"))
    locs = locations(points)
    index = TileIndex(locs, 16)
    for radius in (1.0, 1.5, 3.0):
        got = {r["loc"] for r in core_locations(index, locs, 6, radius).collect()}
        inside = (distances(vectors) <= radius).sum(1) - 1 >= 6
        assert got == {i for i in np.flatnonzero(inside) if not 200 < i < 207}


def test_hashing_finds_nine_in_ten_of_noise(spark):
    """Blocks of noise take fewer planes than their size asks for; a block of clusters beside them keeps its own."""
    rng = np.random.default_rng(14)
    noise = rng.normal(size=(2000, 64))
    noise /= np.linalg.norm(noise, axis=1, keepdims=True)
    clustered = np.pad(spread(1500, 4), ((0, 0), (0, 54)))
    df = frame(spark, noise, "a").unionByName(frame(spark, clustered, "b").withColumn("id", F.col("id") + 10_000))
    near = knn(df, 5, "g", method="lsh", bucket=16, tables=4)
    shares = {r["g"]: r["recall"] for r in recall_of(near, knn(df, 5, "g"), "g").collect()}
    assert shares["a"] >= 0.9 and shares["b"] >= 0.9
