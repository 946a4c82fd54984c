"""Properties of operators: skew, wholeness, idempotence, failure handling."""

import hashlib
import re

import pytest
from pyspark.sql import functions as F

from newsloom import schemas
from newsloom.functions import text
from newsloom.operators import generate, tables, windows
from newsloom.plans import content, ingest, report
from newsloom.session import scratch_path
from newsloom.sources import sinks
from newsloom.streaming.ingest import read_ingested, start_ingest

SF_DIR = "/root/testdata/sf0.001"


def digest_model():
    """A local function, so that workers receive it by value."""
    return lambda prompts: [hashlib.md5(p.encode()).hexdigest() for p in prompts]


def test_cleaned_text_has_single_inner_spaces(spark):
    docs = spark.read.parquet(f"{SF_DIR}/documents.parquet")
    cleaned = docs.select(text.clean_noise(F.col("text")).alias("c"))
    assert cleaned.where(F.col("c").rlike(r"\s{2}|^\s|\s$")).count() == 0


def test_numbering_a_hot_group(spark):
    rows = spark.range(20_000).select(
        F.when(F.col("id") % 3 == 0, "hot").otherwise(F.concat(F.lit("k"), F.col("id") % 50)).alias("k"),
        F.pmod(F.xxhash64("id"), F.lit(500)).alias("v"),
        "id",
    )
    numbered = windows.number_within(rows, ["k"], [F.desc("v"), F.asc("id")], "n")
    from pyspark.sql import Window

    want = rows.withColumn("n", F.row_number().over(Window.partitionBy("k").orderBy(F.desc("v"), "id")).cast("long"))
    assert numbered.exceptAll(want).count() == 0
    assert numbered.count() == 20_000


def test_numbering_keeps_null_keys(spark):
    rows = spark.createDataFrame([(None, 1), (None, 2), ("a", 3)], "k string, id long")
    got = windows.number_within(rows, ["k"], [F.asc("id")], "n").collect()
    assert sorted((r["id"], r["n"]) for r in got) == [(1, 1), (2, 2), (3, 1)]


def test_append_after_anti_join_keeps_urls_unique(spark):
    pages = spark.read.parquet(f"{SF_DIR}/pages.parquet").select(
        F.lit("m").alias("media_id"), "url", F.col("html").alias("content"), F.lit("제목").alias("title"),
        F.lit(None).cast("timestamp").alias("published_at"),
    )
    stored = pages.where(F.col("url").rlike("/en/"))
    fresh = ingest.new_articles(pages, stored, F.lit("2025-01-01").cast("timestamp"))
    both = stored.select("url").unionByName(fresh.select("url"))
    assert both.count() == both.distinct().count() == pages.select("url").distinct().count()


def test_skip_rules_apply_to_their_site_only(spark):
    rows = spark.createDataFrame(
        [("sisain", "u1", "t", "■ 방송 안내 문장이 스무 자를 넘도록 길게 이어집니다"),
         ("khan", "u2", "t", "■ 방송 안내 문장이 스무 자를 넘도록 길게 이어집니다"),
         ("khan", "u3", "t", "짧다"), ("khan", "u4", "", "제목 없는 본문이 스무 자를 넘도록 길게 이어집니다")],
        "media_id string, url string, title string, content string",
    ).withColumn("published_at", F.lit(None).cast("timestamp"))
    none = rows.where("false")
    assert [r["url"] for r in ingest.new_articles(rows, none, F.current_timestamp()).collect()] == ["u2"]


def test_outcomes_with_repeated_stored_urls(spark):
    new = spark.createDataFrame([("m", "u", "x" * 30), ("m", "v", "x")], "media_id string, url string, content string")
    stored = spark.createDataFrame([("m", "u"), ("m", "u")], "media_id string, url string")
    got = {r["outcome"]: r["n"] for r in ingest.save_counters(ingest.tag_outcomes(new, stored)).collect()}
    assert got == {"skipped_duplicate": 1, "too_short": 1}


def test_save_counters_next_to_sql_with_repeated_addresses(spark, tmp_path):
    """Addresses that are stored twice, pages without html, and pages of nothing but white space."""
    import duckdb

    from __spark_entry__ import oracle_sql, queries

    again, plain = "https://a.example.com/1?x=1", "https://a.example.com/2"
    pages = [(1, again, "x" * 30_000), (2, again, "x"), (3, plain, None), (4, plain, " " * 25_000), (5, plain, "x"), (6, None, "x")]
    spark.createDataFrame(pages, "page_id long, url string, html string").write.parquet(f"{tmp_path}/pages.parquet")
    got = {r["outcome"]: r["n"] for r in queries()["agg16_save_counters"](spark, str(tmp_path)).collect()}
    con = duckdb.connect()
    con.execute(f"CREATE VIEW pages AS SELECT * FROM '{tmp_path}/pages.parquet/*.parquet'")
    assert got == dict(con.execute(oracle_sql()["agg16_save_counters"]).fetchall())
    assert got == {"skipped_duplicate": 4, "inserted": 2, "too_short": 2}


def test_shares_add_up(spark):
    from newsloom.catalog.base import Tables

    t = Tables(spark, SF_DIR)
    for r in report.issue_report(t.issues(), t.articles(), t.outlets()).collect():
        assert r["total"] == r["left"] + r["center"] + r["right"] + r["other"]
        shares = r["left_pct"] + r["center_pct"] + r["right_pct"]
        assert shares == pytest.approx(100 - 100 * r["other"] / r["total"])


def test_issue_without_articles_has_zeros(spark):
    issues = spark.createDataFrame([("a", "t")], "id string, title string").withColumns(
        {c: F.lit(None).cast("string") for c in ("issue_summary", "left_perspective", "right_perspective")}
    ).withColumn("created_at", F.lit("2025-09-05").cast("timestamp"))
    articles = spark.createDataFrame([], "issue_id string, media_id string")
    outlets = spark.createDataFrame([("m", "left")], "id string, bias string")
    row = report.issue_report(issues, articles, outlets).first()
    assert (row["total"], row["left_pct"], row["left_label"]) == (0, None, None)
    card = report.report_cards(report.issue_report(issues, articles, outlets)).first()
    assert card["count_line"] == "0개 기사 ∙ 2025년 09월 05일"
    assert not card["has_perspectives"]


def test_save_gate(spark):
    wanted = spark.range(10)
    assert sinks.require_saved(wanted, wanted) == 1.0
    with pytest.raises(RuntimeError):
        sinks.require_saved(wanted, wanted.where("id < 8"))


def test_failing_model_falls_back_per_text(spark):
    def model(prompts):
        if any("bad" in p for p in prompts):
            raise ValueError("refused")
        return [p.upper() for p in prompts]

    df = spark.createDataFrame([("good",), ("bad one",), (None,)], "p string").withColumn("f", F.lit("fallback"))
    got = {r["p"]: r["a"] for r in generate.generate(df, "p", model, "f", "a").collect()}
    assert got == {"good": "GOOD", "bad one": "fallback", None: "fallback"}


def _issue_articles(spark, n):
    return spark.range(n).select(
        F.lit("i").alias("issue_id"), F.col("id").cast("string").alias("id"),
        F.concat(F.lit("제목 "), "id").alias("title"), F.concat(F.lit("본문 "), "id").alias("content"),
        F.lit("m").alias("media_id"), F.array(F.sin("id"), F.cos("id")).alias("embedding"),
        F.timestamp_seconds(F.col("id")).alias("published_at"),
    )


@pytest.mark.parametrize("n", [2, 5, 6, 100])
def test_context_parts_hold_every_article(spark, n):
    rows = _issue_articles(spark, n)
    parts = generate.pack_context(rows, ["issue_id"], titles_per_part=7).orderBy("part").collect()
    whole = "".join(p["text"] for p in parts)
    assert all(f"제목 {i}\n" in whole for i in range(n))
    assert len(re.findall(r"기사 \d+:", whole)) == (n if n <= 5 else 3)
    assert len(parts) == (1 if n <= 5 else -(-(n - 3) // 7))
    assert all(p["n_articles"] == n for p in parts)


def test_perspectives_fold_many_parts(spark):
    outlets = spark.createDataFrame([("m", "left")], "id string, bias string")
    issues = spark.createDataFrame([("i",), ("j",)], "id string")
    rows = _issue_articles(spark, 60)
    one = content.issue_perspectives(issues, rows, outlets, digest_model()).orderBy("id").collect()
    many = content.issue_perspectives(issues, rows, outlets, digest_model(), titles_per_part=2).orderBy("id").collect()
    for got in (one, many):
        assert len(got[0]["left_perspective"]) == 32
        assert got[0]["right_perspective"] == "우파 성향 기사가 부족하여 관점 분석이 제한됩니다."
        assert got[1]["left_perspective"] == "좌파 성향 기사가 부족하여 관점 분석이 제한됩니다."
    assert one[0]["left_perspective"] != many[0]["left_perspective"]


def test_perspectives_without_a_model(spark):
    outlets = spark.createDataFrame([("m", "right")], "id string, bias string")
    issues = spark.createDataFrame([("i",)], "id string")
    row = content.issue_perspectives(issues, _issue_articles(spark, 4), outlets).first()
    assert row["right_perspective"] == "보수 성향 언론사들의 관점 분석 중 오류가 발생했습니다."


def test_long_answers_are_cut(spark):
    titled = content.issue_titles(_issue_articles(spark, 3), lambda ps: ["'" + "가" * 40 + "'"] * len(ps)).first()
    assert titled["title"] == "가" * 28 + ".."
    summed = content.issue_summaries(_issue_articles(spark, 3), lambda ps: ["가" * 400] * len(ps)).first()
    assert summed["issue_summary"] == "가" * 297 + "..."


def test_upsert_keeps_the_latest(spark):
    old = spark.createDataFrame([("u", 1, "a"), ("v", 5, "b")], "url string, ts long, title string")
    new = spark.createDataFrame([("u", 2, "c"), ("v", 4, "d")], "url string, ts long, title string")
    got = {r["url"]: r["title"] for r in tables.upsert(old, new, "url", "ts").collect()}
    assert got == {"u": "c", "v": "b"}


def test_keyed_update_leaves_other_rows(spark):
    table = spark.createDataFrame([("1", "a", None), ("2", "b", "x")], "id string, title string, lead string")
    new = spark.createDataFrame([("1", "A", "L")], "id string, title string, lead string")
    got = {r["id"]: (r["title"], r["lead"]) for r in tables.keyed_update(table, new).collect()}
    assert got == {"1": ("A", "L"), "2": ("b", "x")}


def test_conform(spark):
    row = schemas.conform(spark.createDataFrame([("1", "t")], "id string, title string"), "articles")
    assert row.schema.fieldNames() == schemas.schema("articles").fieldNames()
    with pytest.raises(ValueError, match="unknown"):
        schemas.conform(spark.createDataFrame([("1",)], "nope string"), "articles")


def test_stream_is_incremental_and_replays_safely(spark):
    landing, target, marks = (scratch_path(spark, n) for n in ("landing", "articles", "marks"))
    ddl = "title string, url string, content string, media_id string, published_at timestamp, fetched_at timestamp"

    def land(*urls):
        rows = [(f"제목 {u}", u, "국회는 5일 본회의를 열었다. " * 3, "m") for u in urls]
        spark.createDataFrame(rows, "title string, url string, content string, media_id string").withColumns(
            {"published_at": F.lit(None).cast("timestamp"), "fetched_at": F.lit("2025-09-05").cast("timestamp")}
        ).write.mode("append").parquet(landing)

    def run(checkpoint):
        rows = spark.readStream.schema(ddl).parquet(landing)
        start_ingest(rows, target, checkpoint, F.lit("2025-09-05").cast("timestamp")).awaitTermination()
        return sorted(r["url"] for r in read_ingested(spark, target).collect())

    land("a", "b", "a")
    assert run(marks) == ["a", "b"]
    land("b", "c")
    assert run(marks) == ["a", "b", "c"]
    assert run(marks) == ["a", "b", "c"]
    # A lost stream state starts over from the first batch; batches rewrite their own partition.
    assert run(scratch_path(spark, "marks")) == ["a", "b", "c"]
    row = read_ingested(spark, target).where("url = 'a'").first()
    assert (row["political_category"], row["lead_paragraph"]) == ("국회/정당", "국회는 5일 본회의를 열었다.")
