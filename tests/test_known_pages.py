"""Streams that look addresses up in hash buckets."""

from pyspark.sql import functions as F

from newsloom.session import scratch_path
from newsloom.sources.keyed_table import SLOT
from newsloom.streaming import ingest
from newsloom.streaming.ingest import KnownPages, read_ingested, start_ingest

ROWS = "title string, url string, content string, media_id string, published_at timestamp, fetched_at timestamp"
BODY = "국회는 오늘 본회의를 열어 예산안을 표결에 부쳤다."


def land(spark, folder, *pages):
    rows = [(f"t {url} {hour}", url, BODY, outlet, None, hour) for outlet, url, hour in pages]
    df = spark.createDataFrame(rows, "title string, url string, content string, media_id string, published_at timestamp, h int")
    df = df.withColumn("fetched_at", F.timestamp_seconds(F.lit(1_700_000_000) + F.col("h") * 3600)).drop("h")
    df.coalesce(1).write.mode("append").parquet(folder)


def run(spark, landed, target, marks):
    stream = spark.readStream.schema(ROWS).option("maxFilesPerTrigger", 1).parquet(landed)
    start_ingest(stream, target, marks, F.lit("2025-09-05").cast("timestamp")).awaitTermination()
    return sorted((r["media_id"], r["url"], r["title"]) for r in read_ingested(spark, target).collect())


def test_several_batches_late_pages_and_one_address_under_two_outlets(spark):
    landed, target, marks = (scratch_path(spark, n) for n in ("landed", "articles", "marks"))
    land(spark, landed, ("a", "u1", 5), ("a", "u2", 5))
    assert [r[:2] for r in run(spark, landed, target, marks)] == [("a", "u1"), ("a", "u2")]
    land(spark, landed, ("b", "u1", 6), ("a", "u1", 6))
    land(spark, landed, ("a", "u3", 1), ("a", "u2", 1), ("a", "u3", 2))  # late, and fetched before
    found = run(spark, landed, target, marks)
    assert [r[:2] for r in found] == [("a", "u1"), ("a", "u2"), ("a", "u3"), ("b", "u1")]
    assert ("a", "u2", "t u2 5") in found and ("a", "u3", "t u3 1") in found
    keys = KnownPages(spark, target).table.rows()
    assert sorted((r["media_id"], r["url"]) for r in keys.collect()) == [r[:2] for r in found]


def test_a_replayed_batch_gives_the_same_rows(spark, monkeypatch):
    """It fails after its rows were written and before the stream has noted it, once before and once after the keys."""
    for before in (True, False):
        landed, target, marks = (scratch_path(spark, n) for n in ("landed", "articles", "marks"))
        land(spark, landed, ("a", "u1", 1), ("a", "u2", 1))
        add = KnownPages.add

        def dies(self, rows, run_id, batch_id, add=add, before=before):
            if not before:
                add(self, rows, run_id, batch_id)
            raise OSError("lost")

        with monkeypatch.context() as m:
            m.setattr(KnownPages, "add", dies)
            try:
                run(spark, landed, target, marks)
                raise AssertionError("the stream went on")
            except AssertionError:
                raise
            except Exception as e:
                assert "lost" in str(e)
        assert [r[:2] for r in run(spark, landed, target, marks)] == [("a", "u1"), ("a", "u2")]


def test_rows_without_a_key_are_all_kept(spark):
    landed, target, marks = (scratch_path(spark, n) for n in ("landed", "articles", "marks"))
    land(spark, landed, (None, "u1", 1), (None, "u1", 1))
    assert len(run(spark, landed, target, marks)) == 2


def test_articles_from_before_the_index_are_known(spark, monkeypatch):
    landed, target = scratch_path(spark, "landed"), scratch_path(spark, "articles")
    land(spark, landed, ("a", "u1", 1))
    run(spark, landed, target, scratch_path(spark, "marks"))
    keys = KnownPages(spark, target).table
    keys.folder.delete("manifests")
    assert run(spark, landed, target, scratch_path(spark, "marks")) == [("a", "u1", "t u1 1")]


def test_a_batch_reads_its_own_buckets_only(spark, monkeypatch):
    monkeypatch.setattr(ingest, "KEY_SLOTS", 64)
    target = scratch_path(spark, "articles")
    pages = KnownPages(spark, target, slots=64)
    many = spark.range(3000).select(F.lit("a").alias("media_id"), F.concat(F.lit("u"), "id").alias("url"))
    pages.add(many, "r", 0)
    batch = spark.createDataFrame([("a", "u7"), ("a", "new")], "media_id string, url string")
    found = pages.among(batch, "other", 0)
    assert [r["url"] for r in found.collect()] == ["u7"]
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters" in plan and SLOT in plan
    read = pages.table.rows(slots=pages.table._touched(pages.table.state(), batch)).select(F.input_file_name()).distinct()
    assert 0 < read.count() <= 2 < pages.table.rows().select(F.input_file_name()).distinct().count() / 16
