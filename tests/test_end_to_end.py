"""Sources with files, partition pruning, and the whole way from articles to the report."""

import json
from pathlib import Path

import numpy as np
from pyspark.sql import functions as F

from newsloom.operators.aggregates import category_totals
from newsloom.plans.embed import embed_articles
from newsloom.plans.issues import build_issues, category_results, write_texts
from newsloom.plans.preprocess import preprocess
from newsloom.plans.report import issue_report, report_cards
from newsloom.session import scratch_path
from newsloom.sources import pages, scans, sinks, story_feed
from newsloom.streaming.ingest import landed_pages, page_rows, read_ingested, start_ingest


def test_story_files(spark):
    folder = Path(scratch_path(spark, "stories").removeprefix("file:"))
    (folder / "feed").mkdir(parents=True)
    (folder / "docs").mkdir()
    (folder / "feed" / "0.json").write_text(json.dumps({"content_elements": [{"_id": "A"}, {"_id": None}, {"_id": "B"}]}))
    docs = [
        {"_id": "A", "canonical_url": "/politics/a", "headlines": {"basic": " 제목 "}, "last_updated_date": "2025-09-05T01:02:03.12Z",
         "credits": {"by": [{"name": "홍길동"}, {"name": "b"}]}, "taxonomy": {"tags": [{"text": "x"}, {"text": ""}, {}]}},
        {"_id": "B", "canonical_url": "https://else/b", "headlines": {"basic": "둘"}},
        {"_id": "C", "canonical_url": "/c", "headlines": {}},
    ]
    (folder / "docs" / "0.json").write_text("\n".join(json.dumps(d, ensure_ascii=False) for d in docs))
    assert sorted(r["story_id"] for r in story_feed.read_feed_ids(spark, str(folder / "feed")).collect()) == ["A", "B"]
    rows = {r["story_id"]: r for r in story_feed.flatten_stories(story_feed.read_stories(spark, str(folder / "docs"))).collect()}
    assert sorted(rows) == ["A", "B"]
    a, b = rows["A"], rows["B"]
    assert (a["title"], a["url"], a["author"], a["tags"]) == ("제목", "https://www.chosun.com/politics/a", "홍길동", ["x"])
    assert a["published_at"].microsecond == 120000
    assert (b["url"], b["author"], b["tags"], b["published_at"]) == ("https://else/b", "", [], None)


def test_category_scan_prunes_partitions(spark):
    path = scratch_path(spark, "articles")
    rows = spark.createDataFrame([("1", "선거", [1.0]), ("2", "행정부", [2.0])], "id string, political_category string, embedding array<float>")
    sinks.append(rows, path, "articles", by="political_category")
    scan = scans.embedded(scans.read_table(spark, path, "articles"), "선거")
    assert [r["id"] for r in scan.collect()] == ["1"]
    shown = scan._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(political_category" in shown


def test_landed_pages_to_stored_articles(spark):
    landing, target = scratch_path(spark, "landing"), scratch_path(spark, "articles")
    html = ("<html><head><title>국회 본회의 개최</title></head><body><div id='articleBody'><p class='content_text'>국회는 5일 본회의를 "
            "열었다. 이어 표결했다.</p></div></body></html>")
    spark.createDataFrame(
        [("1", "khan", "u1", html, "article"), ("2", "khan", "u2", "<p>없음</p>", "article"), ("3", "khan", "u3", html, "list")],
        "page_id string, source string, url string, html string, page_kind string",
    ).withColumn("fetched_at", F.lit("2025-09-05").cast("timestamp")).write.parquet(landing)
    as_of = F.lit("2025-09-05T06:00:00Z").cast("timestamp")
    assert pages.read_pages(spark, landing).count() == 3
    rows = page_rows(landed_pages(spark, landing), as_of)
    start_ingest(rows, target, scratch_path(spark, "marks"), as_of).awaitTermination()
    (row,) = read_ingested(spark, target).collect()
    assert (row["url"], row["title"], row["political_category"]) == ("u1", "국회 본회의 개최", "국회/정당")
    assert row["content"] == "국회는 5일 본회의를 열었다. 이어 표결했다."


def test_articles_to_report(spark):
    """Two planted events in one category become issues with texts and a report."""
    rng = np.random.default_rng(1)
    subjects = {0: "국회 예산안 처리 합의", 1: "국회 특검법 표결 충돌"}
    biases = ["left", "right", "center", "center-left"]
    rows = [
        (f"a{e}{i:03}", f"{subjects[e]} {i}", f"국회는 {subjects[e]} 소식을 전했다. 이어진 본문 {i}.", f"m{i % 4}", False,
         (np.eye(8)[e] + 0.02 * rng.normal(size=8)).tolist())
        for e in subjects for i in range(30)
    ]
    raw = spark.createDataFrame(rows, "id string, title string, content string, media_id string, is_preprocessed boolean, embedding array<double>")
    raw = raw.withColumn("published_at", F.lit("2025-09-05").cast("timestamp"))
    cleaned, rejected = preprocess(raw)
    assert rejected.count() == 0
    articles = cleaned.join(raw.select("id", "media_id", "published_at", "embedding"), "id")
    assert embed_articles(articles).where(F.size("embedding") == 256).count() == 60
    outlets = spark.createDataFrame([(f"m{i}", b) for i, b in enumerate(biases)], "id string, bias string")
    now = F.lit("2025-09-06").cast("timestamp")

    built = build_issues(articles, outlets, "r1", now, reduce=False, eps=0.3)
    issues = built.issues.collect()
    assert {r["category"] for r in issues} == {"국회/정당"}
    assert sorted(r["source"] for r in issues) == [30, 30]
    assert built.members.count() == 60
    again = build_issues(articles, outlets, "r1", now, reduce=False, eps=0.3)
    assert {r["id"] for r in again.issues.collect()} == {r["id"] for r in issues}

    linked = sinks.apply_issue_ids(articles.withColumn("issue_id", F.lit(None).cast("string")), built.members)
    texts = write_texts(built.issues, linked, outlets, summary_model=lambda ps: ["요약문"] * len(ps),
                        perspective_model=lambda ps: ["관점" if "left" in p else None for p in ps])
    full = report_cards(issue_report(texts, linked, outlets)).collect()
    assert len(full) == 2
    for card in full:
        assert card["count_line"] == "30개 기사 ∙ 2025년 09월 06일"
        assert card["summary"] == "요약문"
        assert card["left_text"] == "관점"
        assert card["right_text"] == "보수 성향 언론사들의 관점 분석 중 오류가 발생했습니다."
        assert card["title"].startswith("국회 ")
    totals = category_totals(category_results(built)).first()
    assert (totals["issues"], totals["articles"], totals["categories"]) == (2, 60, "국회/정당")
