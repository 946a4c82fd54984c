"""Site rules on small hand-made pages."""

import pytest
from pyspark.sql import functions as F

from newsloom.sources import pages

AS_OF = "2025-09-05T06:00:00Z"
META = '<meta property="article:published_time" content="2025-09-05T10:00:00+09:00">'

BODIES = {
    "khan": (
        '<div id="articleBody"><div class="art_photo"><p class="content_text">사진 설명이 들어 있는 문단</p></div>'
        '<p class="content_text">첫 번째 <b>문단</b>의 본문은 열 자를 넘는다.</p><p>다른 종류의 문단이라서 빠진다.</p>'
        '<p class="content_text">짧다</p><p class="content_text">홍길동 기자 hong@khan.kr 연락처</p></div>',
        "첫 번째문단의 본문은 열 자를 넘는다.",
    ),
    "joongang": (
        '<div id="article_body"><p data-divno="2">두 번째 문단이다.</p><p data-divno="1">첫 번째 문단이다.</p>'
        '<p data-divno="x">마지막 문단이다.</p><div class="ab_photo"><p data-divno="0">사진 문단이다.</p></div></div>',
        "첫 번째 문단이다. 두 번째 문단이다. 마지막 문단이다.",
    ),
    "donga": (
        '<section class="news_view"><h2 class="sub_tit">제목</h2><div class="a1">광고 광고 광고 광고 광고 광고 광고 광고</div>'
        "<div><div>나눔 상자 안에 있는 본문은 쉰 자를 넘어야 하므로 조금 길게 씁니다. 그래서 이렇게 이어서 씁니다. 이제 넘었습니다.</div></div></section>",
        "나눔 상자 안에 있는 본문은 쉰 자를 넘어야 하므로 조금 길게 씁니다. 그래서 이렇게 이어서 씁니다. 이제 넘었습니다.",
    ),
    "naeil": (
        '<div class="article-view"><p>본문 첫 문단입니다.</p><p>저작권 안내 문단입니다.</p><p>본문 둘째 문단입니다.</p>'
        "<p>정치부 소속의 홍길동 기자 드림입니다</p></div>",
        "본문 첫 문단입니다.\n\n본문 둘째 문단입니다.",
    ),
    "munhwa": (
        '<div id="article-body"><p class="text-l">국회가 오늘 본회의를 열었다.…홍길동 기자</p><figure><p class="text-l">사진 설명은 빠지는 문단</p></figure></div>',
        "국회가 오늘 본회의를 열었다.",
    ),
    "pressian": (
        '<div class="section"><div class="article_body" itemprop="articleBody"><p>본문은 열 자를 넘는 문단이다.</p>'
        '<div class="article_ad"><p>광고 문단은 들어가지 않는다.</p></div></div></div>',
        "본문은 열 자를 넘는 문단이다.",
    ),
    "hankyung": (
        '<div class="article-body" id="articletxt" itemprop="articleBody"><figure><img src="/p.jpg" alt="사진">'
        "<figcaption>설명</figcaption></figure>첫 블록의 본문은 열 자를 넘는다.\n\n둘째 블록의 본문도 열 자를 넘는다.\n\n"
        "홍길동 기자 hong@hankyung.com</div>",
        "첫 블록의 본문은 열 자를 넘는다.\n\n둘째 블록의 본문도 열 자를 넘는다.",
    ),
    "segye": (
        '<article class="viewBox2"><em class="precis">요약</em><p>본문 문단입니다.</p><p>ⓒ 세계 무단전재 금지</p>'
        "<p>세종=홍길동 기자</p></article>",
        "본문 문단입니다.",
    ),
    "sisain": (
        '<article id="article-view-content-div" class="article-veiw-body" itemprop="articleBody"><h2>소제목</h2>'
        '<p>링크 <a href="/1">글자</a>가 있는 본문 문단이다.</p><p>같은 <a href="/1">링크</a>와 <a href="/2">다른 링크</a> 문단</p></article>',
        "링크글자가 있는 본문 문단이다.\n\n같은링크와다른 링크문단",
    ),
    "ohmynews": (
        '<div class="at_contents" itemprop="articleBody">첫 줄<br>둘째 줄<div class="ad_box">광고</div><b>셋째 줄</b></div>',
        "첫 줄\n둘째 줄\n셋째 줄",
    ),
    "newsis": (
        '<article><div class="summury">요약</div>[서울=뉴시스] 홍길동 기자 = 본문이다.<br>이어진다.<p class="photojournal">사진</p>'
        "◎공감언론 뉴시스 hong@newsis.com</article>",
        "[서울=뉴시스] 본문이다. 이어진다.",
    ),
    "yonhap": (
        '<div class="story-news article"><aside><p>옆 글</p></aside><p>본문 <b>첫</b> 문단.</p><p>[사진 제공]</p>'
        "<p>제보는 카카오톡 okjebo</p><p>hong@yna.co.kr</p><p>저작권자(c) 통신</p></div>",
        "본문 첫 문단.",
    ),
    "hani": (
        '<div class="article-text"><p class="text">본문 <b>첫</b> 문단 &amp; 끝.</p><p class="text">홍길동 기자 hong@hani.co.kr</p></div>',
        "본문 첫 문단 & 끝.",
    ),
    "chosun": (
        '<main><p>메인에 있는 글</p></main><section class="article-body"><p>스무 자를 넘는 본문 문단만 남으므로 길게 적는다.</p><p>짧은 글</p></section>',
        "스무 자를 넘는 본문 문단만 남으므로 길게 적는다.",
    ),
}


@pytest.fixture(scope="module")
def extracted(spark):
    rows = [(name, name, f"<html><head><title>제목</title>{META}</head><body>{body}</body></html>")
            for name, (body, _) in BODIES.items()]
    landed = spark.createDataFrame(rows, "page_id string, source string, html string")
    found = pages.extract_articles(landed, F.lit(AS_OF).cast("timestamp"))
    shown = found.withColumn("published", F.date_format("published_at", "yyyy-MM-dd'T'HH:mm:ss"))
    return {r["source"]: r for r in shown.collect()}


@pytest.mark.parametrize("site", sorted(BODIES))
def test_body(extracted, site):
    assert extracted[site]["container_found"]
    assert extracted[site]["content"] == BODIES[site][1]


def test_dates_and_title(extracted):
    assert extracted["khan"]["published"] == "2025-09-05T01:00:00"
    assert not extracted["khan"]["date_defaulted"]
    assert extracted["yonhap"]["date_defaulted"]  # that site's date is elsewhere
    assert extracted["khan"]["page_title"] == "제목"


def test_rich_fields(extracted):
    assert extracted["sisain"]["headings"] == ["소제목"]
    assert [link["href"] for link in extracted["sisain"]["links"]] == ["/1", "/2"]
    assert extracted["hankyung"]["lead_image"]["src"] == "/p.jpg"
    assert extracted["hankyung"]["lead_image"]["caption"] == "설명"


def test_tail_bylines(extracted):
    assert extracted["naeil"]["byline"] == "정치부 소속의 홍길동 기자 드림입니다"
    assert extracted["hankyung"]["email"] == "hong@hankyung.com"


LISTS = {
    "khan": '<ul id="recentList"><li><article><a href="/article/1">열 자가 넘는 기사 제목입니다</a><p class="desc">요약</p>'
            '<p class="date">26분 전</p><img src="/i.png" alt="그림"></article></li><li><article><a href="/article/2">짧은 제목</a>'
            "</article></li></ul>",
    "hankyung": '<div class="allnews-wrap"><div class="allnews-panel"><ul class="allnews-list">'
                + '<li data-aid="7"><h2 class="news-tit"><a href="/article/2025">열 자가 넘는 &amp; 기사 제목입니다</a></h2>'
                  '<p class="txt-date">2025.09.05 13:47</p></li>' * 2
                + "</ul></div></div>",
    "donga": '<div class="divide_area"><section class="sub_news_sec"><ul class="row_list">'
             + "".join(
                 f'<li><article class="news_card"><div class="news_body"><h4 class="tit"><a href="/news/article/{i}" '
                 f'data-ep_button_category="{c}" data-ep_button_name="열 자가 넘는 기사 제목 {i}">x</a></h4></div></article></li>'
                 for i, c in enumerate(["정치"] * 12 + ["사회"]))
             + "</ul></section></div>",
    "segye": '<ul><li><a href="http://www.segye.com/newsView/1"><strong class="tit">열 자가 넘는 기사 제목입니다</strong></a>'
             '<small class="date">2025-09-05 13:47:00</small></li><li><a href="/other/2">열 자가 넘지만 다른 종류</a></li></ul>',
    "pressian": '<div class="arl_022"><ul class="list"><li><div class="thumb"><div class="arl_img" style="background-image:url(\'/t.jpg\')">'
                '</div></div><p class="title"><a href="/pages/articles/99">열 자가 넘는 기사 제목입니다</a></p>'
                '<div class="byline"><span class="name">홍길동 기자</span><span class="date">2025.09.05 13:47:51</span></div></li></ul></div>',
}


@pytest.fixture(scope="module")
def listed(spark):
    rows = [(name, name, f"<html><body>{body}</body></html>") for name, body in LISTS.items()]
    landed = spark.createDataFrame(rows, "page_id string, source string, html string")
    rows = pages.accepted_items(pages.list_items(landed)).orderBy("source", "pos").collect()
    found: dict = {}
    for r in rows:
        found.setdefault(r["source"], []).append(r)
    return found


def test_list_fields(listed):
    (khan,) = listed["khan"]
    assert (khan["url"], khan["date_text"], khan["description"], khan["image_alt"]) == (
        "https://www.khan.co.kr/article/1", "26분 전", "요약", "그림",
    )
    (pressian,) = listed["pressian"]
    assert (pressian["article_id"], pressian["author"], pressian["image_url"]) == ("99", "홍길동", "/t.jpg")


def test_list_rules(listed):
    assert len(listed["hankyung"]) == 1  # same article number twice
    assert listed["hankyung"][0]["title"] == "열 자가 넘는 & 기사 제목입니다"
    assert len(listed["donga"]) == 10  # page cap, wrong section left out
    (segye,) = listed["segye"]
    assert segye["url"] == "https://www.segye.com/newsView/1"


def _article(spark, source, body):
    landed = spark.createDataFrame([("p", source, f"<html><body>{body}</body></html>")], "page_id string, source string, html string")
    return pages.extract_articles(landed, F.lit(AS_OF).cast("timestamp")).first()


def test_captions_stay_with_their_figure(spark):
    found = _article(
        spark, "plain",
        '<article><figure data-idxno="7"><img src="a.jpg"><img src="b.jpg"></figure><h2>two</h2><h3>three</h3>'
        '<figure data-idxno="8"><img src="c.jpg"><figcaption>third</figcaption></figure><img src="d.jpg"></article>',
    )
    assert [(i["src"], i["caption"], i["idxno"]) for i in found["images"]] == [
        ("a.jpg", "", "7"), ("b.jpg", "", "7"), ("c.jpg", "third", "8"),
    ]
    assert [(h["level"], h["text"]) for h in found["outline"]] == [(2, "two"), (3, "three")]


@pytest.mark.parametrize(
    ("texts", "published", "updated"),
    [
        (["입력 2025-09-05 10:00", "수정 2025-09-06 12:00"], "2025-09-05 01:00", "2025-09-06 03:00"),
        (["수정 2025-09-06 12:00", "게재 2025-09-05 10:00"], "2025-09-05 01:00", "2025-09-06 03:00"),
        (["2025-09-07 09:00", "2025-09-01 09:00"], "2025-09-07 00:00", None),
        (["수정 2025-09-06 12:00"], "2025-09-06 03:00", "2025-09-06 03:00"),
    ],
)
def test_updates_are_no_publication(spark, texts, published, updated):
    from newsloom.functions import dates

    as_of = F.lit(AS_OF).cast("timestamp")
    row = spark.range(1).select(
        *[
            F.date_format(dates.resolve_published(F.array(*map(F.lit, texts)), as_of)[c], "yyyy-MM-dd HH:mm").alias(c)
            for c in ("published_at", "updated_at")
        ]
    ).first()
    assert (row["published_at"], row["updated_at"]) == (published, updated)
