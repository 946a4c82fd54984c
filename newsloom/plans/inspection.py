"""Table summary, article statistics, samples and data-quality report."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from newsloom.functions import fixed_values as fv
from newsloom.functions.text import is_blank, truncate
from newsloom.operators import aggregates
from newsloom.operators.tables import union_all

NEWEST_BY = {"articles": "published_at"}
VIOLATIONS = {  # rule name -> column that must be filled
    "missing_title": "title",
    "missing_url": "url",
    "missing_media_id": "media_id",
    "missing_published_at": "published_at",
}


def table_summary(tables: dict[str, DataFrame]) -> DataFrame:
    """Row count and latest date of every table."""
    return union_all(
        *[aggregates.table_profile(df, name, NEWEST_BY.get(name, "created_at")) for name, df in tables.items()]
    )


def article_statistics(articles: DataFrame, outlets: DataFrame, as_of: Column) -> DataFrame:
    """``(section, item, value)``: totals, and article counts per outlet, from one pass over the articles."""
    per_media = aggregates.article_totals_per_outlet(articles, as_of)
    items = ["total", "recent", "preprocessed", "not_preprocessed"]
    totals = per_media.agg(*[F.coalesce(F.sum(i), F.lit(0)).alias(i) for i in items])
    long = totals.select(
        F.inline(F.array(*[F.struct(F.lit("totals").alias("section"), F.lit(i).alias("item"), F.col(i).alias("value"))
                           for i in items]))
    )
    per_outlet = outlets.join(per_media, outlets["id"] == per_media["media_id"], "left").select(
        F.lit("outlet").alias("section"), outlets["name"].alias("item"), F.coalesce("total", F.lit(0)).alias("value")
    )
    return union_all(long, per_outlet)


def outlets_by_articles(articles: DataFrame, outlets: DataFrame) -> DataFrame:
    return aggregates.articles_per_outlet(articles, outlets).orderBy(F.desc("n_articles"), "name")


def sample_rows(df: DataFrame, n: int = 5, newest_by: str | None = None, key: str = "id") -> DataFrame:
    """A few rows as shortened texts: the newest, or the first by key."""
    rows = aggregates.latest(df, newest_by, n, key) if newest_by else df.orderBy(key).limit(n)
    return rows.select(
        *[truncate(F.coalesce(F.col(c).cast("string"), F.lit("None")), fv.CELL_TEXT).alias(c) for c in rows.columns]
    )


def quality_violations(articles: DataFrame) -> DataFrame:
    """``(id, rule)``: one row per violated rule."""
    marks = F.array(
        *[F.when(is_blank(F.col(c).cast("string")), F.lit(rule)) for rule, c in VIOLATIONS.items()]
    )
    return articles.select("id", F.explode(F.filter(marks, lambda m: m.isNotNull())).alias("rule"))


def first_violations(articles: DataFrame, n: int = 10) -> DataFrame:
    return quality_violations(articles).orderBy("id", "rule").limit(n)


def full_inspection(tables: dict[str, DataFrame], as_of: Column) -> dict[str, DataFrame]:
    """All parts of the inspection, each still lazy."""
    articles, outlets = tables["articles"], tables["media_outlets"]
    return {
        "table_summary": table_summary(tables),
        "article_statistics": article_statistics(articles, outlets, as_of),
        "quality_totals": aggregates.quality_totals(articles),
        "violations": first_violations(articles),
        "newest_articles": sample_rows(articles, 3, "published_at"),
        "outlets": sample_rows(outlets, 5),
    }
