"""Incremental ingest: new landed rows only, known URLs dropped, cleaned and appended."""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Mapping, Sequence

from pyspark import StorageLevel
from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from newsloom import schemas
from newsloom.functions import fixed_values as fv
from newsloom.operators.windows import keep_first
from newsloom.plans.ingest import new_articles
from newsloom.plans.preprocess import clean_articles
from newsloom.sources.keyed_table import ConcurrentMerge, KeyedTable
from newsloom.sources.pages import extract_articles
from newsloom.sources.site_rules import SITE_RULES

# Buckets of the known addresses, and how often a merge into them is tried when another one comes first.
KEY_SLOTS, MERGE_TURNS = 256, 5
ARTICLES_DDL = (
    "title string, url string, content string, published_at timestamp, created_at timestamp, media_id string, "
    "is_preprocessed boolean, lead_paragraph string, political_category string"
)


def landed_pages(spark: SparkSession, path: str, files_per_trigger: int = 1_000) -> DataFrame:
    """Stream of landed pages."""
    reader = spark.readStream.schema(schemas.schema("pages_raw")).option("maxFilesPerTrigger", files_per_trigger)
    return reader.parquet(path)


def page_rows(pages: DataFrame, as_of: Column, rules: Mapping[str, dict] = SITE_RULES) -> DataFrame:
    """Rows to ingest from article pages: the page's title and extracted body."""
    extracted = extract_articles(pages.where(F.col("page_kind") == "article"), as_of, rules)
    return extracted.select(
        F.col("page_title").alias("title"), "url", "content", F.col("source").alias("media_id"), "published_at", "fetched_at"
    )


class KnownPages:
    """The ``(media_id, url)`` of everything ingested, in hash buckets beside the articles.

    A batch reads the buckets that its own addresses fall into, and of these the keys only, so what it costs follows the
    batch and not the history. With the key goes the batch that brought it: a batch that is replayed after a failure does
    not find its own rows.
    """

    def __init__(self, spark: SparkSession, articles_path: str, slots: int = KEY_SLOTS):
        self.spark, self.articles_path = spark, articles_path
        self.table = KeyedTable(spark, f"{articles_path.rstrip('/')}_keys")
        if not self.table.exists():  # at the first batch: what other ways have brought is taken in once
            before = self._articles().select("media_id", "url", "run", "batch_id")
            KeyedTable.create(before, self.table.path, ["media_id", "url"], slots)

    def _articles(self) -> DataFrame:
        schema = f"{ARTICLES_DDL}, run string, batch_id long"
        try:
            return self.spark.read.schema(schema).parquet(self.articles_path)
        except AnalysisException as e:
            if e.getCondition() != "PATH_NOT_FOUND":
                raise
            return self.spark.createDataFrame([], schema)

    def among(self, rows: DataFrame, run: str, batch_id: int) -> DataFrame:
        """Those addresses of ``rows`` that another run, or an earlier batch of this one, has brought."""
        other = (F.col("run") != run) | (F.col("batch_id") < batch_id)
        return self.table.stored_keys(rows, other)

    def add(self, rows: DataFrame, run: str, batch_id: int) -> None:
        keys = rows.select("media_id", "url", F.lit(run).alias("run"), F.lit(batch_id).cast("long").alias("batch_id"))
        keys = keys.where(F.col("media_id").isNotNull() & F.col("url").isNotNull())
        for turn in range(MERGE_TURNS):
            try:
                self.table.upsert(keys)
                return
            except ConcurrentMerge:  # another stream of the same table came first
                if turn == MERGE_TURNS - 1:
                    raise


def first_of_batch(rows: DataFrame) -> DataFrame:
    """One row per ``(media_id, url)``: what was fetched first; rows without either key all stay."""
    keyed = F.col("media_id").isNotNull() & F.col("url").isNotNull()
    rest = [F.col(c).asc() for c in ("fetched_at", "title", "content")]
    return keep_first(rows.where(keyed), ["media_id", "url"], rest).unionByName(rows.where(~keyed))


def start_ingest(
    rows: DataFrame,
    articles_path: str,
    checkpoint: str,
    now: Column,
    rules: Mapping[str, Sequence[str]] = fv.CATEGORY_KEYWORDS,
    other: str = fv.OTHER_CATEGORY,
    stored: Callable[[], DataFrame] | None = None,
    key_slots: int = KEY_SLOTS,
) -> StreamingQuery:
    """Run over everything that has landed, then stop.

    Known addresses are looked up in ``KnownPages``.

    ``rows``: streaming ``(title, url, content, media_id, published_at, fetched_at)``. Repeats within
    a batch and those of stored articles are dropped by ``(media_id, url)``, as the batch path does; a page is
    taken however late it comes. Every batch of a checkpoint owns one partition and overwrites it, so a batch replayed after a failure leaves no
    duplicates; when a checkpoint is lost, start with a new path.
    ``stored`` gives further ``(media_id, url)`` rows that count as known. ``key_slots`` is how many buckets known addresses
    have if this is the table's first batch.
    """
    run = hashlib.sha256(checkpoint.encode()).hexdigest()[:16]

    def append(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        pages = KnownPages(spark, articles_path, key_slots)
        batch = batch.persist(StorageLevel.MEMORY_AND_DISK)  # looked up first, then written
        try:
            known = pages.among(batch, run, batch_id)
            if stored is not None:
                known = known.unionByName(stored().select("media_id", "url"))
            fresh = new_articles(first_of_batch(batch), known, now)
            cleaned = clean_articles(fresh, rules, other).withColumn("is_preprocessed", F.lit(True))
            names = [c.split()[0] for c in ARTICLES_DDL.split(", ")]
            target = f"{articles_path}/run={run}/batch_id={batch_id}"
            cleaned.select(*names).write.mode("overwrite").parquet(target)
            pages.add(spark.read.schema(ARTICLES_DDL).parquet(target), run, batch_id)
        finally:
            batch.unpersist()

    return (
        rows.writeStream.foreachBatch(append)
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start()
    )


def read_ingested(spark: SparkSession, articles_path: str) -> DataFrame:
    return spark.read.schema(f"{ARTICLES_DDL}, run string, batch_id long").parquet(articles_path)
