"""Representative articles: the nearest to their group's mean vector."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from newsloom.functions import fixed_values as fv
from newsloom.functions.numbers import cosine, mean_vector
from newsloom.operators.windows import top_n


def centroids(articles: DataFrame, keys: Sequence[str], vector: str = "embedding") -> DataFrame:
    """``(keys, centroid)``: the plain mean of each group, summed on the map side."""
    return articles.where(F.size(vector) > 0).groupBy(*keys).agg(mean_vector(F.col(vector)).alias("centroid"))


def similarities(articles: DataFrame, keys: Sequence[str], vector: str = "embedding") -> DataFrame:
    """Articles that have a vector, with their similarity to the group's centroid."""
    means = centroids(articles, keys, vector)
    joined = articles.where(F.size(vector) > 0).join(means, list(keys))
    return joined.withColumn("similarity", cosine(F.col(vector), F.col("centroid"))).drop("centroid")


def representatives(
    articles: DataFrame, keys: Sequence[str], n: int = fv.REPRESENTATIVES, vector: str = "embedding"
) -> DataFrame:
    """The n most similar articles of each group with their rank; all of them where there are fewer.

    Of equally similar ones the earliest comes first, undated ones last.
    """
    order = [F.desc("similarity"), F.asc_nulls_last("published_at"), F.asc("id")]
    return top_n(similarities(articles, keys, vector), keys, order, n, "rank")


def with_bodies(chosen: DataFrame, articles: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Chosen articles with their ``content``: bodies join the few that were chosen, and none is ranked."""
    return chosen.join(articles.select(*keys, "id", "content"), [*keys, "id"])


def remaining(articles: DataFrame, chosen: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Articles that were not chosen."""
    return articles.join(chosen.select(*keys, "id"), [*keys, "id"], "left_anti")
