"""Cleaning and classifying articles: one narrow stage over a pruned, filtered scan."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from newsloom.functions import fixed_values as fv
from newsloom.functions import text
from newsloom.operators.tables import split_bodies
from newsloom.sources.scans import unprocessed


def clean_articles(
    articles: DataFrame,
    rules: Mapping[str, Sequence[str]] = fv.CATEGORY_KEYWORDS,
    other: str = fv.OTHER_CATEGORY,
) -> DataFrame:
    """Cleaned title and body, lead and category of articles that have a body."""
    cleaned = articles.withColumns(
        {"title": text.clean_title_noise(F.col("title")), "content": text.clean_noise(F.col("content"))}
    ).withColumn("lead_paragraph", text.lead_sentence(F.col("content")))
    best = text.classify_by_keywords(F.col("title"), F.col("lead_paragraph"), rules, other)
    return cleaned.withColumn("political_category", best["category"])


def preprocess_in_place(
    articles: DataFrame,
    now: Column,
    rules: Mapping[str, Sequence[str]] = fv.CATEGORY_KEYWORDS,
    other: str = fv.OTHER_CATEGORY,
) -> DataFrame:
    """The whole table with pending rows cleaned, as one narrow pass: no join, no shuffle.

    The way to rewrite a partition. Rows preprocessed before, and rows without a body, stay as they are.
    """
    pending = ~F.coalesce("is_preprocessed", F.lit(False)) & ~text.is_blank(F.col("content"))
    title = F.when(pending, text.clean_title_noise(F.col("title")))
    content = F.when(pending, text.clean_noise(F.col("content")))
    staged = articles.withColumns({"__pending": pending, "__title": title, "__content": content})
    staged = staged.withColumn("__lead", F.when(F.col("__pending"), text.lead_sentence(F.col("__content"))))
    best = text.classify_by_keywords(F.col("__title"), F.col("__lead"), rules, other)
    new = {
        "title": F.col("__title"),
        "content": F.col("__content"),
        "lead_paragraph": F.col("__lead"),
        "political_category": F.when(F.col("__pending"), best["category"]),
        "is_preprocessed": F.when(F.col("__pending"), True),
        "preprocessed_at": F.when(F.col("__pending"), now),
    }
    return staged.select(*[F.coalesce(new[c], F.col(c)).alias(c) if c in new else F.col(c) for c in articles.columns])


def preprocess(
    articles: DataFrame,
    rules: Mapping[str, Sequence[str]] = fv.CATEGORY_KEYWORDS,
    other: str = fv.OTHER_CATEGORY,
) -> tuple[DataFrame, DataFrame]:
    """``(cleaned, rejected)`` of the articles not preprocessed yet."""
    accepted, rejected = split_bodies(unprocessed(articles))
    cleaned = clean_articles(accepted, rules, other).select(
        "id", "title", "content", "lead_paragraph", "political_category"
    )
    return cleaned, rejected.select("id", "reason")
