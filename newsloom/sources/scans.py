"""Pruned, pushed-down scans of the engine's tables. Each takes and returns a DataFrame."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from newsloom import schemas


def read_table(spark: SparkSession, path: str, table: str) -> DataFrame:
    return spark.read.schema(schemas.schema(table)).parquet(path)


def unprocessed(articles: DataFrame) -> DataFrame:
    return articles.where(~F.col("is_preprocessed")).select(
        "id", "title", "content", "media_id", "published_at", "is_preprocessed"
    )


def unprocessed_count(articles: DataFrame) -> DataFrame:
    return articles.where(~F.col("is_preprocessed")).agg(F.count(F.lit(1)).alias("n"))


def without_embedding(articles: DataFrame) -> DataFrame:
    return articles.where(F.col("is_preprocessed") & F.col("embedding").isNull()).select(
        "id", "title", "lead_paragraph", "content"
    )


def embedded(articles: DataFrame, category: str | None = None) -> DataFrame:
    """Articles with a vector; one category prunes partitions of a table laid out by category."""
    rows = articles.where(F.col("embedding").isNotNull())
    if category is not None:
        rows = rows.where(F.col("political_category") == category)
    return rows.select("id", "title", "media_id", "political_category", "embedding", "published_at")


def issue_articles(articles: DataFrame) -> DataFrame:
    """Articles of all issues with vector and body."""
    return articles.where(
        F.col("issue_id").isNotNull() & F.col("embedding").isNotNull() & F.col("content").isNotNull()
    ).select("issue_id", "id", "title", "content", "media_id", "embedding", "published_at")


def issue_titles(articles: DataFrame) -> DataFrame:
    return articles.where(F.col("issue_id").isNotNull()).select("issue_id", "id", "title", "published_at")


def issues_newest_first(issues: DataFrame) -> DataFrame:
    return issues.select(
        "id", "title", "issue_summary", "created_at", "source", "left_perspective", "right_perspective"
    ).orderBy(F.desc("created_at"), "id")


def outlet_biases(outlets: DataFrame) -> DataFrame:
    return outlets.select("id", "bias")


def outlet_named(outlets: DataFrame, name: str) -> DataFrame:
    return outlets.where(F.col("name") == name)


def stored_urls(articles: DataFrame) -> DataFrame:
    return articles.select("media_id", "url")
