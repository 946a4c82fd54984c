"""What has been read of paged feeds: ranges of offsets, merged, with the gaps between them.

A page lists the stories ``offset`` to ``offset + size`` of its feed. Every run writes the ranges it has read under its own
id, so a run that is repeated replaces what it wrote, and two runs never touch each other's files. Reading the state merges
ranges that overlap or touch. Pages inside a merged range are known and are not parsed again; a range that no page
covered, between 0 and the last offset read, is missing and is returned as a row to be fetched.

Merging takes two steps, within chunks of offsets and then over what is left of each chunk, so a feed of many pages
is merged by many tasks. Pages without feed, offset or size, or with a size below 1, cover nothing.
"""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

PAGES_DDL = "feed string, offset long, size long, content_elements array<struct<_id:string>>"
RANGES_DDL = "feed string, first long, last long"
CHUNK = 100_000  # offsets


def read_pages(spark: SparkSession, path: str) -> DataFrame:
    """Landed feed pages, one JSON document per line, each with the feed, offset and size that it was asked for by."""
    return spark.read.schema(PAGES_DDL).json(path)


def page_ranges(pages: DataFrame) -> DataFrame:
    """``(feed, first, last)`` that pages cover, ``last`` exclusive."""
    usable = F.col("feed").isNotNull() & (F.col("offset") >= 0) & (F.col("size") > 0)
    return pages.where(usable).select("feed", F.col("offset").alias("first"), (F.col("offset") + F.col("size")).alias("last"))


def _joined(ranges: DataFrame, keys: list[str]) -> DataFrame:
    """Ranges of a key merged where they overlap or touch."""
    order = Window.partitionBy(*keys).orderBy("first", "last")
    reached = F.max("last").over(order.rowsBetween(Window.unboundedPreceding, -1))
    starts = F.when(reached.isNull() | (F.col("first") > reached), 1).otherwise(0)
    numbered = ranges.withColumn("__starts", starts).withColumn("__island", F.sum("__starts").over(order))
    return numbered.groupBy(*keys, "__island").agg(F.min("first").alias("first"), F.max("last").alias("last")).drop("__island")


def merged_ranges(ranges: DataFrame) -> DataFrame:
    """``(feed, first, last)`` without overlaps, in any number of pages."""
    chunked = ranges.withColumn("__chunk", F.floor(F.col("first") / CHUNK))
    return _joined(_joined(chunked, ["feed", "__chunk"]), ["feed"]).select("feed", "first", "last")


def missing_ranges(ranges: DataFrame, start: Column | None = None) -> DataFrame:
    """``(feed, first, last)`` that lie between merged ranges, or before the first of a feed (from ``start``, 0)."""
    merged = merged_ranges(ranges)
    before = F.coalesce(
        F.lag("last").over(Window.partitionBy("feed").orderBy("first")), F.lit(0).cast("long") if start is None else start
    )
    gaps = merged.select("feed", before.alias("first"), F.col("first").alias("last"))
    return gaps.where(F.col("first") < F.col("last"))


def unread_pages(pages: DataFrame, ranges: DataFrame) -> DataFrame:
    """Pages that no merged range covers whole, and those whose own range is unknown."""
    merged = merged_ranges(ranges)
    chunks = F.sequence(F.floor(F.col("first") / CHUNK), F.floor((F.col("last") - 1) / CHUNK))
    spread = merged.select(
        F.col("feed").alias("__feed"), F.col("first").alias("__first"), F.col("last").alias("__last"),
        F.explode(chunks).alias("__chunk"),
    )
    inside = (
        (F.col("feed") == F.col("__feed")) & (F.floor(F.col("offset") / CHUNK) == F.col("__chunk"))
        & (F.col("size") > 0) & (F.col("offset") >= F.col("__first")) & (F.col("offset") + F.col("size") <= F.col("__last"))
    )
    return pages.join(spread, inside, "left_anti")


class FeedState:
    """The ranges that the runs of a feed reader have written to ``path``."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")

    def ranges(self, but: str | None = None) -> DataFrame:
        """What all runs, or all but one, have read."""
        schema = f"{RANGES_DDL}, run string"
        try:
            found = self.spark.read.schema(schema).parquet(self.path)
        except AnalysisException as e:
            if e.getCondition() != "PATH_NOT_FOUND":
                raise
            found = self.spark.createDataFrame([], schema)
        return (found if but is None else found.where(F.col("run") != but)).select("feed", "first", "last")

    def unread(self, pages: DataFrame, run: str) -> DataFrame:
        """Pages that earlier runs have not read; a run that is repeated reads its own again."""
        return unread_pages(pages, self.ranges(but=run))

    def record(self, pages: DataFrame, run: str) -> None:
        """Writes down what a run has read, once its stories are stored."""
        merged_ranges(page_ranges(pages)).write.mode("overwrite").parquet(f"{self.path}/run={run}")

    def missing(self) -> DataFrame:
        return missing_ranges(self.ranges())
