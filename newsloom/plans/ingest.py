"""From extracted pages to new article rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from newsloom.functions import fixed_values as fv
from newsloom.functions.text import is_blank, py_strip
from newsloom.operators.tables import filled, long_enough, not_stored, skipped
from newsloom.operators.windows import keep_first

OUTCOME_STORED, OUTCOME_DUPLICATE, OUTCOME_SHORT = "inserted", "skipped_duplicate", "too_short"


def article_record(rows: DataFrame, now: Column) -> DataFrame:
    """Normalised article rows: fixed columns, defaults filled, rows without title or URL dropped."""
    usable = rows.where(filled(F.col("title"), F.col("url")))
    return usable.select(
        py_strip(F.col("title")).alias("title"),
        "url",
        F.coalesce("content", F.lit("")).alias("content"),
        F.coalesce("published_at", now).alias("published_at"),
        now.alias("created_at"),
        "media_id",
        F.lit(False).alias("is_preprocessed"),
    )


def tag_outcomes(incoming: DataFrame, stored: DataFrame, keys: tuple[str, ...] = ("media_id", "url")) -> DataFrame:
    """Incoming rows with what the save step does to them.

    Stored keys are counted first, so the join never multiplies incoming rows; ``n_stored`` is how many stored rows have
    the row's key.
    """
    known = stored.groupBy(*keys).agg(F.count(F.lit(1)).alias("n_stored"))
    marked = incoming.join(known, list(keys), "left").withColumn("n_stored", F.coalesce("n_stored", F.lit(0)))
    outcome = (
        F.when(F.col("n_stored") > 0, OUTCOME_DUPLICATE)
        .when(~long_enough(F.col("content")), OUTCOME_SHORT)
        .otherwise(OUTCOME_STORED)
    )
    return marked.withColumn("outcome", outcome)


def save_counters(tagged: DataFrame, per_match: bool = False) -> DataFrame:
    """Rows of each outcome; ``per_match`` counts a duplicate once for every stored row that has its key."""
    n = F.sum(F.greatest("n_stored", F.lit(1))) if per_match else F.count(F.lit(1))
    return tagged.groupBy("outcome").agg(n.alias("n"))


def new_articles(incoming: DataFrame, stored: DataFrame, now: Column) -> DataFrame:
    """Rows to append: long enough, not editorially skipped, not stored yet."""
    unwanted = (F.coalesce("media_id", F.lit("")) == fv.SKIP_RULE_SOURCE) & skipped(F.col("title"), F.col("content"))
    wanted = incoming.where(long_enough(F.col("content")) & ~unwanted)
    return article_record(not_stored(wanted, stored), now)


def unique_items(items: DataFrame) -> DataFrame:
    """Listed articles once per URL, from the earliest page and position."""
    return keep_first(items.where(~is_blank(F.col("url"))), ["url"], [F.asc("page_id"), F.asc("pos")])


def first_accepted(items: DataFrame, n: int = fv.TARGET_ARTICLES) -> DataFrame:
    """The first n items in page order that no skip rule hits."""
    accepted = items.where(~skipped(F.col("title"), F.col("content")))
    return accepted.orderBy("page_id", "pos").limit(n)
