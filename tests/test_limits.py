"""What must not be lost: late pages, rows without keys, parts that failed, titles beyond any number."""

from collections import Counter
from datetime import datetime
from random import Random

import pytest
from pyspark.sql import functions as F

from newsloom.operators.tables import upsert
from newsloom.plans import content, refine
from newsloom.plans.ingest import new_articles
from newsloom.streaming.ingest import first_of_batch, read_ingested, start_ingest



def now():
    return F.lit("2025-01-01 00:00:00").cast("timestamp")


ROWS = "title string, url string, content string, media_id string, published_at timestamp, fetched_at timestamp"


def page(n, day, media="m", url=None):
    body = f"body of page {n} that is long enough to be kept"
    return (f"title {n}", url or f"u{n}", body, media, None, datetime(2024, 1, day))


def test_late_pages_and_addresses_of_two_outlets(spark, tmp_path):
    landed, target, checkpoint = (str(tmp_path / x) for x in ("landed", "articles", "checkpoint"))
    runs = [
        [page(1, 31), page(2, 31)],
        [page(3, 30), page(1, 31)],  # one address again
        [page(4, 2), page(5, 2, "other", "u1")],  # a month late; an address under a second outlet
        [page(6, 30), page(6, 1, url="u6"), page(2, 1)],
    ]
    every = []
    for rows in runs:
        every += rows
        spark.createDataFrame(rows, ROWS).write.mode("append").parquet(landed)
        start_ingest(spark.readStream.schema(ROWS).parquet(landed), target, checkpoint, now()).awaitTermination()
    found = sorted((r["media_id"], r["url"]) for r in read_ingested(spark, target).collect())
    assert found == [("m", "u1"), ("m", "u2"), ("m", "u3"), ("m", "u4"), ("m", "u6"), ("other", "u1")]
    batch = new_articles(first_of_batch(spark.createDataFrame(every, ROWS)), spark.createDataFrame([], ROWS), now())
    assert sorted((r["media_id"], r["url"]) for r in batch.collect()) == found


def test_the_first_fetched_copy_is_kept_and_rows_without_keys_stay(spark):
    rows = [page(1, 9, url="u"), page(2, 3, url="u"), page(3, 5, url="u"), (None, None, "x", None, None, None)] * 2
    found = first_of_batch(spark.createDataFrame(rows, ROWS)).collect()
    assert sorted(str(r["title"]) for r in found) == ["None", "None", "title 2"]


def test_upsert_keeps_rows_without_key_and_newer_stored_rows(spark):
    schema = "id string, version int, body string"
    stored = spark.createDataFrame([("a", 5, "old"), ("b", 1, "old"), (None, 1, "x"), ("c", 1, "old")], schema)
    incoming = spark.createDataFrame([("a", 4, "new"), ("b", 2, "m"), ("b", 3, "n"), (None, 1, "y"), ("d", 1, "new")], schema)
    found = sorted((str(r["id"]), r["body"]) for r in upsert(stored, incoming, "id", "version").collect())
    assert found == [("None", "x"), ("None", "y"), ("a", "old"), ("b", "n"), ("c", "old"), ("d", "new")]


def test_stored_rows_are_not_shuffled_for_a_small_batch(spark):
    stored = spark.range(100_000).select("id", F.lit(1).alias("version"), F.lit("body").alias("body"))
    incoming = spark.range(5, 6).select("id", F.lit(2).alias("version"), F.lit("new").alias("body"))
    plan = upsert(stored, incoming, "id", "version")._jdf.queryExecution().executedPlan().toString()
    assert "LeftAnti" in plan and "SortMergeJoin" not in plan


def test_patterns_come_from_all_titles(spark):
    rows = [("c", 1, str(i), "alpha beta" if i < 50 else "gamma delta", datetime(2024, 1, 1)) for i in range(500)]
    members = spark.createDataFrame(rows, "category string, cluster_id int, id string, title string, published_at timestamp")
    events = refine.frequent_word_patterns(members, "[a-z]+").first()["events"]
    assert [e["title"] for e in events] == ["delta", "gamma", "alpha", "beta"]


MEMBERS = "category string, cluster_id int, id string, title string, media_id string, published_at timestamp"


def members_of(spark, titles):
    rows = [(c, k, str(i), t, "m", datetime(2024, 1, 1)) for i, (c, k, t) in enumerate(titles)]
    return spark.createDataFrame(rows, MEMBERS)


def expected_patterns(titles):
    found = {}
    for key in {(c, k) for c, k, _ in titles}:
        sets = [set((t or "").split()) for c, k, t in titles if (c, k) == key]
        counts = Counter(w for s in sets for w in s)
        seeds = sorted(counts, key=lambda w: (-counts[w], w))[:6]
        near = {s: Counter(w for x in sets if s in x for w in x if w != s) for s in seeds}
        found[key] = [[s, *sorted(near[s], key=lambda w: (-near[s][w], w))[:3]] for s in seeds]
    return found


@pytest.mark.parametrize("leaders", [1, 8, 64])
def test_companions_are_the_same_however_many_words_are_tried_first(spark, leaders):
    r = Random(5)
    titles = [("a", 1, " ".join(r.choices("abcdefghijklmnopqrstuvwxyz", k=r.randint(0, 5)))) for _ in range(400)]
    titles += [("a", 2, f"{'x' if i % 2 else 'y'} {i % 40} p{i % 40}") for i in range(300)]  # companions are rare words
    titles += [("b", 1, "one"), ("b", 1, "one two"), ("b", 1, None), ("b", 2, "lonely")]
    patterns = refine.frequent_word_patterns(members_of(spark, titles), "[a-z0-9]+", leaders)
    found = {(p["category"], p["cluster_id"]): [list(e["keywords"]) for e in p["events"]] for p in patterns.collect()}
    assert found == expected_patterns(titles)


def test_members_are_not_dealt_by_cluster_event_or_category(spark):
    titles = [("a", 1, f"the and {w}") for w in "abcdefgh" * 5] + [("a", 1, f"other {i}") for i in range(30)]
    members = members_of(spark, titles)
    assigned = refine.assign_events(members, refine.event_patterns(members, word_pattern="[a-z]+"))
    shaped = refine.shape_groups(assigned)
    rules = [{"pattern_id": "p", "keywords": ["ot", "he"], "title": "merged title"}]
    merged = refine.merge_singletons(refine.add_headlines(shaped, "[a-z]+", []), rules)
    for step in (assigned, shaped, merged):
        shown = step._jdf.queryExecution().executedPlan().toString()
        assert "SortMergeJoin" not in shown and "Exchange hashpartitioning" not in shown
    assert len({r["id"] for r in merged.collect()}) == merged.count() == 70


def test_a_failed_part_gives_the_fallback_and_a_count(spark):
    answers = spark.createDataFrame(
        [("i", "left", 0, "a"), ("i", "left", 1, None), ("i", "left", 2, "c"), ("i", "right", 0, "d"), ("i", "right", 1, "e")],
        "issue_id string, bias string, part int, answer string",
    )
    found = {r["bias"]: r for r in content._fold(answers, lambda prompts: ["merged"] * len(prompts)).collect()}
    assert (found["left"]["answer"], found["left"]["failed_parts"]) == (None, 1)
    assert (found["right"]["answer"], found["right"]["failed_parts"]) == ("merged", 0)


def test_landed_files_follow_the_splits_of_the_table(spark):
    """A table of many splits lands in as many files of an hour, so that no task or file takes half of it."""
    from pathlib import Path

    from __spark_entry__ import queries

    folder = Path(spark.conf.get("spark.checkpoint.dir"))
    before = set(folder.glob("landed-*"))
    spark.conf.set("spark.sql.files.maxPartitionBytes", "20k")
    try:
        splits = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").rdd.getNumPartitions()
        queries()["str1_incremental_ingest"](spark, "/root/testdata/sf0.001")
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
    (landed,) = set(folder.glob("landed-*")) - before
    assert splits > 4
    assert len(list(landed.glob("part-*.parquet"))) == 2 * splits
