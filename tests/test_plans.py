"""Shape of physical plans: pushed filters, pruned columns, group limits, no cross joins."""

import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry
from newsloom.catalog.base import Tables
from newsloom.operators import aggregates, windows
from newsloom.sources import scans

SF_DIR = "/root/testdata/sf0.001"
# These start jobs while they are built; their parts are checked by the other queries and tests.
EAGER = {
    "str1_incremental_ingest", "clu2_nearest_neighbours", "clu3_density_clusters", "clu5_all_categories", "join8_most_similar",
}


def plan(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


def formatted(df) -> str:
    return df._sc._jvm.PythonSQLUtils.explainString(df._jdf.queryExecution(), "formatted")


@pytest.mark.parametrize("name", sorted(set(entry.ENTRIES) - EAGER))
def test_no_cross_joins_or_row_udfs(spark, name):
    shown = plan(entry.ENTRIES[name].run(spark, SF_DIR))
    for bad in ("CartesianProduct", "BroadcastNestedLoopJoin", "BatchEvalPython"):
        assert bad not in shown


def test_scan_pushes_filter_and_prunes_columns(spark):
    shown = formatted(scans.unprocessed_count(Tables(spark, SF_DIR).articles()))
    assert "LessThan(n_chars,1000)" in shown
    assert "ReadSchema: struct<n_chars:bigint>" in shown


def test_top_n_limits_groups_before_the_shuffle(spark):
    df = spark.read.parquet(f"{SF_DIR}/events.parquet")
    shown = plan(windows.top_n(df, ["event_type"], [F.desc("value"), F.asc("event_id")], 3))
    assert "WindowGroupLimit" in shown
    assert shown.index("Final") < shown.index("Exchange") < shown.index("Partial")


def test_report_reads_two_columns_of_articles(spark):
    t = Tables(spark, SF_DIR)
    from newsloom.operators.aggregates import issue_stats

    shown = formatted(issue_stats(t.articles(), t.outlets()))
    assert "text" not in shown.split("ReadSchema")[1].split("\n")[0]


def test_bodies_join_after_the_ranking(spark):
    from newsloom.operators.generate import pack_context

    rows = spark.range(10).select(
        F.lit("i").alias("issue_id"), F.lit("left").alias("bias"), F.col("id").cast("string").alias("id"), F.lit("t").alias("title"),
        F.concat(F.lit("body "), "id").alias("content"), F.array(F.rand(1), F.rand(2)).alias("embedding"),
        F.lit("2024-01-01").cast("timestamp").alias("published_at"),
    )
    optimised = pack_context(rows, ["issue_id", "bias"])._jdf.queryExecution().optimizedPlan().toString()
    ranking = [line for line in optimised.splitlines() if "Window [" in line]
    assert ranking and not any("content" in line for line in ranking)


def test_words_are_hashed_not_sorted(spark):
    titles = spark.range(500).select(
        F.lit("g").alias("g"), F.timestamp_seconds("id").alias("published_at"), F.col("id").cast("string").alias("id"),
        F.concat(F.lit("word w"), F.col("id") % 7).alias("title"),
    )
    counts = aggregates.word_counts(titles, ["g"], "[a-z0-9]+")
    shown = plan(counts)
    assert "SortAggregate" not in shown and "HashAggregate" in shown
    top = aggregates.top_words(counts, ["g"], 3).orderBy("word_rank").collect()
    assert [(r["word"], r["n"]) for r in top] == [("word", 500), ("w0", 72), ("w1", 72)]
