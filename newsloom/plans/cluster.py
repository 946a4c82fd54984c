"""Density clustering of article vectors, all categories in one job."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from newsloom.functions import fixed_values as fv
from newsloom.operators.components import connected_components
from newsloom.operators.neighbours import TILE, TileIndex, core_distances, core_locations, locations, radius_forest
from newsloom.operators.tables import populous
from newsloom.operators.windows import number_within
from newsloom.plans.embed import reduce_dimensions
from newsloom.session import cut_lineage


def density_cluster(
    points: DataFrame,
    block: str,
    eps: float | None = None,
    eps_quantile: float = 0.5,
    min_samples: int = fv.MIN_SAMPLES,
    min_cluster_size: int = fv.MIN_CLUSTER_SIZE,
    key: str = "id",
    vector: str = "embedding",
    tile: int = TILE,
) -> DataFrame:
    """``(block, id, cluster_id)``; noise is -1.

    A point is core when its ``min_samples``-th neighbour lies within ``eps``; core points within ``eps``
    of each other share a cluster; smaller clusters than ``min_cluster_size`` are noise. Without ``eps``,
    each block takes the given quantile of its own core distances.
    """
    # Written once: points find their locations by their vectors, which a model might not give twice
    prepared = cut_lineage(
        points.select(F.col(block).alias("block"), F.col(key).alias("id"), F.col(vector).alias("vector"))
    )
    locs = cut_lineage(locations(prepared))
    index = TileIndex(locs, tile)
    if eps is None:
        distances = cut_lineage(core_distances(index, locs, min_samples, None))
        radius = distances.groupBy("block").agg(F.percentile_approx("core_distance", eps_quantile, 10_000).alias("radius"))
        core = distances.join(radius, "block").where(F.col("core_distance") <= F.col("radius"))
    else:
        core = core_locations(index, locs, min_samples, eps).withColumn("radius", F.lit(float(eps)))
    core = cut_lineage(
        index.members.join(core.select("block", "loc", "radius"), ["block", "loc"])
    )
    linked = connected_components(radius_forest(index, core))
    # A core location without a link is a cluster of its own copies.
    rooted = core.select("block", "loc", "weight").join(linked, ["block", "loc"], "left").select(
        "block", "loc", "weight", F.coalesce("root", "loc").alias("root")
    )
    sizes = rooted.groupBy("block", "root").agg(F.sum("weight").alias("size")).where(F.col("size") >= min_cluster_size)
    numbered = number_within(sizes.select("block", "root"), ["block"], [F.asc("root")], "__n")
    labels = rooted.join(numbered, ["block", "root"]).select("block", "loc", (F.col("__n") - 1).alias("cluster_id"))
    at_home = locs.join(labels, ["block", "loc"], "left").select(
        "block", "vector", F.coalesce("cluster_id", F.lit(-1).cast("long")).alias("cluster_id")
    )
    return prepared.join(at_home, ["block", "vector"]).select(
        F.col("block").alias(block), F.col("id").alias(key), "cluster_id"
    )


def cluster_categories(articles: DataFrame, reduce: bool = True, **settings) -> DataFrame:
    """``(political_category, id, cluster_id)`` of all categories with enough articles."""
    eligible = populous(articles.where(F.size("embedding") > 0), "political_category")
    if reduce:
        eligible = reduce_dimensions(eligible)
        settings.setdefault("vector", "reduced")
    return density_cluster(eligible, "political_category", **settings)
