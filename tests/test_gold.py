"""Hand-made Korean rows with their expected values."""

from datetime import date

import pytest
from pyspark.sql import functions as F

from newsloom.functions import dates, numbers, rules, text
from newsloom.functions import fixed_values as fv
from newsloom.operators.aggregates import keyword_classes, word_counts
from newsloom.plans import content

AS_OF = "2025-09-05T06:00:00Z"


def value(spark, column):
    return spark.range(1).select(column.alias("v")).first()["v"]


def as_of():
    return F.lit(AS_OF).cast("timestamp")


def iso(column):
    return F.date_format(column, "yyyy-MM-dd'T'HH:mm:ss'Z'")


@pytest.mark.parametrize(
    ("raw", "clean"),
    [
        ("(서울=통신) 홍길동 기자 = 국회는 5일 본회의를 열었다. 이어 표결했다.", "국회는 5일 본회의를 열었다. 이어 표결했다."),
        ("[단독] 대통령실 &quot;예산안&quot; <b>발표</b>…여야 공방", "대통령실 예산안 발표여야 공방"),
        ("A(b(c)d)e [x]y", "Ad)e y"),
        ("　넓은\xa0빈칸\x1c과 줄\n바꿈　", "넓은 빈칸 과 줄 바꿈"),
        ("", ""),
        (None, ""),
    ],
)
def test_clean_noise(spark, raw, clean):
    assert value(spark, text.clean_noise(F.lit(raw).cast("string"))) == clean


@pytest.mark.parametrize(
    ("raw", "clean"),
    [("◆홍 특파원: ■ 여야 합의", "홍 특파원: 여야 합의"), ("김 기자= 국회 소식", "국회 소식"), ("▶국회①", "국회")],
)
def test_clean_title(spark, raw, clean):
    assert value(spark, text.clean_title_noise(F.lit(raw))) == clean


@pytest.mark.parametrize(
    ("body", "lead"),
    [
        ("국회는 5일 본회의를 열었다. 이어 표결했다.", "국회는 5일 본회의를 열었다."),
        (".앞에 점이 있는 본문", ".앞에 점이 있는 본문"),
        ("마침표 없는 본문", "마침표 없는 본문."),
        ("." + "가" * 150, "." + "가" * 99),
        ("", ""),
    ],
)
def test_lead(spark, body, lead):
    assert value(spark, text.lead_sentence(F.lit(body))) == lead


@pytest.mark.parametrize(
    ("title", "lead", "category", "score"),
    [
        ("국회 본회의 개최", "국회는 5일 본회의를 열었다.", "국회/정당", 3.0),
        ("지방선거 공천 확정", "후보가 발표됐다.", "선거", 7.0),
        ("국회와 정부", "합의했다.", "국회/정당", 2.0),
        ("가을 축제", "시장에서 열렸다.", "지역정치", 1.0),
        ("오늘의 날씨", "맑겠다.", "기타", 1.0),
    ],
)
def test_classification(spark, title, lead, category, score):
    best = value(spark, text.classify_by_keywords(F.lit(title), F.lit(lead)))
    assert (best["category"], best["score"]) == (category, score)


@pytest.mark.parametrize(
    ("written", "instant"),
    [
        ("2025-09-05 15:33", "2025-09-05T06:33:00Z"),
        ("2025.09.05 13:47", "2025-09-05T04:47:00Z"),
        ("2025.09.05 13:47:51", "2025-09-05T04:47:51Z"),
        ("2025-09-05T01:17:00+09:00", "2025-09-04T16:17:00Z"),
        ("2025-09-05T01:17:00Z", "2025-09-05T01:17:00Z"),
        ("2025-09-05T01:17:00", "2025-09-04T16:17:00Z"),
        ("2025-13-05 01:17", None),
        ("어제", None),
    ],
)
def test_parse_instant(spark, written, instant):
    assert value(spark, iso(dates.parse_instant(F.lit(written)))) == instant


@pytest.mark.parametrize(
    ("written", "instant"),
    [
        ("26분 전", "2025-09-05T05:34:00Z"),
        ("2시간 전", "2025-09-05T04:00:00Z"),
        ("1일 전", "2025-09-04T06:00:00Z"),
        ("3주 전", "2025-08-15T06:00:00Z"),
        ("기사입력 25.09.05 13:47", "2025-09-05T04:47:00Z"),
        ("최종 업데이트 09/05 13:47", "2025-09-05T04:47:00Z"),
        ("등록 2025.09.05 13:47:51", "2025-09-05T04:47:51Z"),
        ("송고시간 2025-09-05 13:47 댓글", "2025-09-05T04:47:00Z"),
        ("방금", AS_OF),
    ],
)
def test_resolve_published(spark, written, instant):
    resolved = value(spark, dates.resolve_published(F.array(F.lit(written)), as_of()))
    assert resolved["date_defaulted"] == (instant == AS_OF)
    assert value(spark, iso(dates.resolve_published(F.array(F.lit(written)), as_of())["published_at"])) == instant


def test_published_and_updated(spark):
    texts = F.array(F.lit("2025-09-05 13:00 수정"), F.lit("2025-09-05 12:00 게재"), F.lit("2025-09-05 11:00 입력"))
    both = dates.published_and_updated(texts)
    assert value(spark, iso(both["published_at"])) == "2025-09-05T03:00:00Z"
    assert value(spark, iso(both["updated_at"])) == "2025-09-05T04:00:00Z"


def test_date_pieces_and_display(spark):
    assert value(spark, dates.dotted_date(F.lit("입력 2025.09.05 13:47"))) == date(2025, 9, 5)
    assert value(spark, dates.year_and_month_day(F.lit("2025"), F.lit("9.5"))) == date(2025, 9, 5)
    assert value(spark, dates.display_date(F.lit("2025-09-05"))) == "2025년 09월 05일"
    assert value(spark, dates.display_date(F.lit("곧 공개될 예정입니다"))) == "곧 공개될 예정입니"
    assert value(spark, dates.home_time(dates.parse_instant(F.lit("2025-09-05T01:17:00Z")))) == "2025-09-05T10:17:00+09:00"


@pytest.mark.parametrize(
    ("left", "center", "right", "labels"),
    [(1, 6, 1, (None, "75%", None)), (1, 1, 2, ("25%", "25%", "50%")), (5, 3, 0, ("62%", "38%", None))],
)
def test_share_labels(spark, left, center, right, labels):
    total = left + center + right
    shares = [numbers.percent(F.lit(n), F.lit(total)) for n in (left, center, right)]
    assert tuple(value(spark, numbers.percent_label(s)) for s in shares) == labels


def test_share_of_nothing(spark):
    assert value(spark, numbers.percent(F.lit(0), F.lit(0))) is None


@pytest.mark.parametrize(("n", "kind", "quality"), [(19, "event_1", 0), (20, "event_1", 20), (25, "merged", 30)])
def test_quality_score(spark, n, kind, quality):
    assert value(spark, numbers.quality_score(F.lit(n), F.lit(kind))) == quality


@pytest.mark.parametrize(
    ("title", "headline"),
    [
        ("대통령실, 대책 논의 착수", "대통령실 입장 발표"),
        ("규제 합리화 (종합)", "규제합리화 추진"),
        ('"인용문" 짧은 제목', "짧은 제목"),
        ("가나다라마바사아자차카타파하거너더러머버서", "가나다라마바사아자차카타파하거너더러.."),
        ("(괄호뿐)", "정치 이슈"),
        (None, "정치 이슈"),
    ],
)
def test_single_title_headline(spark, title, headline):
    assert value(spark, text.single_title_headline(F.lit(title).cast("string"))) == headline


@pytest.mark.parametrize(
    ("words", "headline"), [(["국회", "예산"], "국회 예산"), (["국회"], "국회 이슈"), ([], "정치 현안")]
)
def test_group_headline(spark, words, headline):
    column = F.array(*[F.lit(w) for w in words]).cast("array<string>")
    assert value(spark, text.group_headline(column)) == headline


@pytest.mark.parametrize(
    ("word", "kind"),
    [("홍길동", "person"), ("국무총리", "person"), ("국방부처", None), ("기획재정부", "position"), ("채용의혹", "event"),
     ("강력규탄", "reaction"), ("수용", "person"), ("대법원장", "person")],
)
def test_word_classes(spark, word, kind):
    assert value(spark, text.classify_word(F.lit(word))) == kind


def test_keyword_classes_and_template_title(spark):
    titles = spark.createDataFrame(
        [("i", "1", "홍길동 채용의혹 강력규탄"), ("i", "2", "홍길동 채용의혹"), ("i", "3", "강력규탄 단독어절일뿐")],
        "issue_id string, id string, title string",
    ).withColumn("published_at", F.lit(None).cast("timestamp"))
    row = keyword_classes(word_counts(titles, ["issue_id"]), ["issue_id"]).first()
    assert (row["person"], row["event"], row["reaction"]) == (["홍길동"], ["채용의혹"], ["강력규탄"])
    assert content.issue_titles(titles).first()["title"] == "홍길동 채용의혹…강력규탄"


@pytest.mark.parametrize(
    ("answer", "n"),
    [
        ('```json\n{"events": [{"event_id": "a", "title": "b", "keywords": ["c"]}]}\n``` 끝', 1),
        ('설명 ```\n{"events": []}\n```', 0),
        ('{"events": [{"event_id": "a"}, {"event_id": "b"}]}', 2),
        ("모르겠습니다", None),
    ],
)
def test_fenced_events(spark, answer, n):
    events = value(spark, text.parse_events(F.lit(answer)))
    assert (None if events is None else len(events)) == n


def test_wire_text(spark):
    raw = "[서울=뉴시스] 홍길동 기자 = 본문이다. [뉴시스] ◎공감언론 뉴시스 hong@newsis.com"
    assert value(spark, text.clean_wire(F.lit(raw))) == "[서울=뉴시스] 본문이다."


def test_small_text_functions(spark):
    assert value(spark, text.drop_reporter_tail(F.lit("국회가 열렸다…홍길동 기자"))) == "국회가 열렸다"
    assert value(spark, text.byline_author(F.lit("홍길동 기자"))) == "홍길동"
    assert value(spark, text.mailto_address(F.lit("mailto:a@b.kr"))) == "a@b.kr"
    assert value(spark, text.background_image(F.lit("background-image: url('/x.jpg')"))) == "/x.jpg"
    assert value(spark, text.real_image(F.lit("https://s/img/1X1.png"))) is None
    assert value(spark, text.strip_quotes(F.lit("\"'요약'\""))) == "요약"
    assert value(spark, text.absolute_url(F.lit("/a/1"), F.lit("https://x.kr"))) == "https://x.kr/a/1"
    assert value(spark, text.absolute_url(F.lit("http://x.kr/a"), F.lit(""), force_https=True)) == "https://x.kr/a"
    kept = text.drop_contained(F.array(F.lit("가나다라"), F.lit("나다"), F.lit("마바")))
    assert value(spark, kept) == ["가나다라", "마바"]
    numbered = F.array(
        *[F.struct(F.lit(i).alias("pos"), F.lit(n).alias("number"), F.lit(t).alias("text"))
          for i, (n, t) in enumerate([("2", "b"), ("x", "d"), ("1", "a"), ("10", "c")])]
    )
    assert value(spark, text.order_by_number(numbered)) == ["a", "b", "c", "d"]


def test_keyword_join_counts_each_keyword_once(spark):
    texts = spark.createDataFrame([("1", "국회 국회 의원"), ("2", "날씨")], "id string, t string")
    table = rules.rule_table(spark, fv.CATEGORY_KEYWORDS)
    rows = rules.match_keywords(texts, "id", "t", table).collect()
    assert [(r["id"], r["category"], r["hits"]) for r in rows] == [("1", "국회/정당", 2)]
