"""JSON story feed: nested story documents to flat article rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from newsloom.functions.dates import parse_instant
from newsloom.functions.text import absolute_url, is_blank, py_strip
from newsloom.sources.feed_state import FeedState, read_pages
from newsloom.sources.site_rules import SITE_RULES

STORY_DDL = (
    "_id string, canonical_url string, headlines struct<basic:string>, last_updated_date string, "
    "credits struct<by:array<struct<name:string>>>, "
    "taxonomy struct<primary_section:struct<name:string>,tags:array<struct<text:string>>>, "
    "description struct<basic:string>"
)
FEED_DDL = "content_elements array<struct<_id:string>>"
BASE_URL = SITE_RULES["chosun"]["base_url"]


def read_feed_ids(spark: SparkSession, path: str) -> DataFrame:
    """Story ids of landed feed pages."""
    feed = spark.read.schema(FEED_DDL).option("multiLine", True).json(path)
    return feed.select(F.explode("content_elements._id").alias("story_id")).where(~is_blank(F.col("story_id")))


def read_stories(spark: SparkSession, path: str) -> DataFrame:
    """Landed story documents, one JSON document per line, under the fixed schema."""
    return spark.read.schema(STORY_DDL).json(path)


def feed_stories(spark: SparkSession, feed_path: str, stories_path: str) -> DataFrame:
    """Article rows of the stories that the feed's pages list, once each however often they are listed."""
    ids = read_feed_ids(spark, feed_path).distinct()
    return flatten_stories(read_stories(spark, stories_path)).join(ids, "story_id", "left_semi").dropDuplicates(["story_id"])


def unread_stories(spark: SparkSession, feed_path: str, stories_path: str, state: FeedState, run: str) -> DataFrame:
    """Article rows of the stories listed by pages that no earlier run has read; ``state.record`` them when they are stored.

    The run id makes a repeated run read the same pages again. A story that an earlier page listed as well comes again: the
    feed moves on between runs, and what is stored already is dropped by its address.
    """
    pages = state.unread(read_pages(spark, feed_path), run)
    ids = pages.select(F.explode("content_elements._id").alias("story_id")).where(~is_blank(F.col("story_id"))).distinct()
    return flatten_stories(read_stories(spark, stories_path)).join(ids, "story_id", "left_semi").dropDuplicates(["story_id"])


def parse_stories(docs: DataFrame, json_column: str) -> DataFrame:
    """Stories kept as JSON text in a column."""
    keys = [c for c in docs.columns if c != json_column]
    return docs.select(*keys, F.from_json(json_column, STORY_DDL).alias("s")).select(*keys, "s.*")


def flatten_stories(stories: DataFrame, base: Column | None = None) -> DataFrame:
    """Article rows; stories without headline or address are dropped."""
    base = F.lit(BASE_URL) if base is None else base
    title, url = F.col("headlines.basic"), F.col("canonical_url")
    tags = F.transform(F.coalesce("taxonomy.tags", F.array().cast("array<struct<text:string>>")), lambda t: t["text"])
    return stories.where(~is_blank(title) & ~is_blank(url)).select(
        F.col("_id").alias("story_id"),
        py_strip(title).alias("title"),
        F.when(F.startswith(url, F.lit("/")), absolute_url(url, base)).otherwise(url).alias("url"),
        parse_instant(F.col("last_updated_date")).alias("published_at"),
        F.coalesce(F.get("credits.by", F.lit(0))["name"], F.lit("")).alias("author"),
        F.coalesce("taxonomy.primary_section.name", F.lit("")).alias("section"),
        F.filter(tags, lambda t: ~is_blank(t)).alias("tags"),
        F.coalesce("description.basic", F.lit("")).alias("description"),
    )
