"""Text, date, number and JSON functions over whole tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from newsloom.catalog.base import (
    SQL_ARTICLES, SQL_SPACE, Tables, query, sql_clean, sql_clean_title, sql_lead, sql_replace, sql_strip,
)
from newsloom.functions import dates, numbers, rules, text
from newsloom.functions import fixed_values as fv
from newsloom.plans.preprocess import preprocess, preprocess_in_place
from newsloom.session import scratch_path
from newsloom.sources.feed_state import FeedState, merged_ranges
from newsloom.sources.pages import extract_articles
from newsloom.sources.story_feed import feed_stories, flatten_stories, parse_stories

# Keyword rules over the invented words of the test documents, as the Korean ones match nothing there.
TEST_RULES = {
    "speech": ["the ", "that", "this"],
    "union": ["and ", "with", "und "],
    "origin": ["from", "of the", "von "],
    "romance": ["les ", "que", "para", "des "],
    "german": ["nicht", "sch", "ein"],
    "shapes": ["tion", "ment", "heit", "ción"],
}
TEST_OTHER = "other"


def sql_scores(title: str, lead: str) -> str:
    parts = []
    for name, words in TEST_RULES.items():
        terms = " + ".join(
            f"(CASE WHEN contains(lower({title}), '{w}') THEN 2.0 ELSE 0.0 END)"
            f" + (CASE WHEN contains(lower({lead}), '{w}') THEN 1.0 ELSE 0.0 END)"
            for w in words
        )
        parts.append(f"CAST({terms} AS DOUBLE) AS s_{name}")
    return ", ".join(parts)


SQL_BEST = "greatest(" + ", ".join(f"s_{n}" for n in TEST_RULES) + ")"
SQL_CATEGORY = (
    f"CASE WHEN {SQL_BEST} < 1.0 THEN '{TEST_OTHER}' "
    + " ".join(f"WHEN s_{n} = {SQL_BEST} THEN '{n}'" for n in TEST_RULES)
    + " END"
)
SQL_CLEANED = f"""{SQL_ARTICLES},
 step AS (SELECT id, media_id, is_preprocessed, {sql_clean_title('title')} AS title, {sql_clean('content')} AS content
          FROM articles WHERE content <> ''),
 leads AS (SELECT *, {sql_lead('content')} AS lead FROM step),
 scored AS (SELECT *, {sql_scores('title', 'lead')} FROM leads)"""


@query("txt1_clean_noise", f"SELECT doc_id, md5({sql_clean('text')}) AS cleaned_md5, "
       f"CAST(length({sql_clean('text')}) AS BIGINT) AS n FROM documents")
def _(t: Tables):
    cleaned = t.raw("documents").select("doc_id", text.clean_noise(F.col("text")).alias("c"))
    return cleaned.select("doc_id", F.md5("c").alias("cleaned_md5"), F.length("c").cast("long").alias("n"))


@query("txt2_clean_title", f"WITH {SQL_ARTICLES} SELECT id, {sql_clean_title('title')} AS title FROM articles")
def _(t: Tables):
    return t.articles().select("id", text.clean_title_noise(F.col("title")).alias("title"))


@query("txt3_lead_sentence", f"SELECT doc_id, {sql_lead('text')} AS lead FROM documents")
def _(t: Tables):
    return t.raw("documents").select("doc_id", text.lead_sentence(F.col("text")).alias("lead"))


@query("txt4_classify", f"WITH {SQL_CLEANED} SELECT id, {SQL_CATEGORY} AS category, "
       f"greatest({SQL_BEST}, 1.0) AS score FROM scored")
def _(t: Tables):
    leads = (
        t.articles()
        .where("content <> ''")
        .select("id", text.clean_title_noise(F.col("title")).alias("title"), text.clean_noise(F.col("content")).alias("c"))
        .select("id", "title", text.lead_sentence(F.col("c")).alias("lead"))
    )
    best = text.classify_by_keywords(F.col("title"), F.col("lead"), TEST_RULES, TEST_OTHER)
    return leads.withColumn("b", best).select("id", F.col("b.category"), F.col("b.score"))


@query("txt5_preprocess", f"WITH {SQL_CLEANED} SELECT id, title, md5(content) AS content_md5, lead AS lead_paragraph, "
       f"{SQL_CATEGORY} AS political_category FROM scored WHERE NOT is_preprocessed")
def _(t: Tables):
    cleaned, _rejected = preprocess(t.articles().withColumn("published_at", F.lit(None)), TEST_RULES, TEST_OTHER)
    return cleaned.select(
        "id", "title", F.md5("content").alias("content_md5"), "lead_paragraph", "political_category"
    )


@query("snk4_preprocess_in_place", f"""WITH {SQL_CLEANED} SELECT a.id, CASE WHEN s.id IS NULL THEN a.title ELSE s.title END AS title,
 md5(CASE WHEN s.id IS NULL THEN a.content ELSE s.content END) AS content_md5, s.lead AS lead_paragraph,
 CASE WHEN s.id IS NOT NULL THEN {SQL_CATEGORY} END AS political_category, a.content <> '' OR a.is_preprocessed AS is_preprocessed
 FROM articles a LEFT JOIN (SELECT * FROM scored WHERE NOT is_preprocessed) s ON s.id = a.id""")
def _(t: Tables):
    stored = t.articles().withColumns(
        {c: F.lit(None).cast("string") for c in ("lead_paragraph", "political_category")}
    ).withColumn("preprocessed_at", F.lit(None).cast("timestamp"))
    table = preprocess_in_place(stored, F.lit("2024-01-25").cast("timestamp"), TEST_RULES, TEST_OTHER)
    return table.select(
        "id", "title", F.md5("content").alias("content_md5"), "lead_paragraph", "political_category", "is_preprocessed"
    )


@query("flt8_rejected_bodies", "SELECT CAST(item_id AS VARCHAR) AS id, '본문 없음' AS reason FROM benchmark b "
       "WHERE coalesce(split_part(b.text, chr(10), 2), '') = ''")
def _(t: Tables):
    items = t.raw("benchmark").select(
        F.col("item_id").cast("string").alias("id"),
        F.substring_index("text", "\n", 1).alias("title"),
        F.try_element_at(F.split("text", "\n"), F.lit(2)).alias("content"),
        F.lit(False).alias("is_preprocessed"),
        F.lit(None).alias("media_id"),
        F.lit(None).alias("published_at"),
    )
    return preprocess(items)[1]


@query("txt6_embedding_input", "SELECT conv_id, turn, CASE WHEN " + sql_strip("split_part(text, '.', 2)") +
       " <> '' THEN split_part(text, '.', 2) ELSE role END AS input FROM conversations")
def _(t: Tables):
    second = F.coalesce(F.try_element_at(F.split("text", r"\."), F.lit(2)), F.lit(""))
    return t.raw("conversations").select(
        "conv_id", "turn", text.embedding_input(second, F.col("role")).alias("input")
    )


@query("txt7_truncate", """SELECT doc_id,
 CASE WHEN length(text) > 20 THEN substring(text, 1, 18) || '..' ELSE text END AS short_title,
 CASE WHEN length(text) > 30 THEN substring(text, 1, 28) || '..' ELSE text END AS issue_title,
 CASE WHEN length(text) > 300 THEN substring(text, 1, 297) || '...' ELSE text END AS long_text FROM documents""")
def _(t: Tables):
    body = F.col("text")
    return t.raw("documents").select(
        "doc_id",
        text.truncate(body, fv.SHORT_TITLE).alias("short_title"),
        text.truncate(body, fv.ISSUE_TITLE).alias("issue_title"),
        text.truncate(body, fv.LONG_TEXT).alias("long_text"),
    )


@query("txt8_strip_quotes", """SELECT conv_id, turn, trim('"' || role || '''"', '"''') AS answer,
 trim(trim('"''' || role || '''"', '"'), '''') AS card FROM conversations""")
def _(t: Tables):
    quoted = F.concat(F.lit('"'), "role", F.lit("'\""))
    both = F.concat(F.lit("\"'"), "role", F.lit("'\""))
    return t.raw("conversations").select(
        "conv_id", "turn", text.strip_quotes(quoted).alias("answer"), text.report_text(both).alias("card")
    )


@query("txt9_single_title_headline", f"""WITH {SQL_ARTICLES}, bare AS (SELECT id,
 {sql_strip(sql_replace('title', [('".*?"', ''), (r'\([^)]*\)', ''), (SQL_SPACE + '+', ' ')]))} AS s FROM articles)
 SELECT id, CASE WHEN contains(s, 'the') AND contains(s, 'and') THEN 'the and' WHEN s = '' THEN '정치 이슈'
 WHEN length(s) > 20 THEN substring(s, 1, 18) || '..' ELSE s END AS headline FROM bare""")
def _(t: Tables):
    canned = [{"any_of": [["the", "and"]], "headline": "the and"}]
    return t.articles().select("id", text.single_title_headline(F.col("title"), canned).alias("headline"))


@query("txt15_strip_markup", r"""SELECT page_id, md5(""" + sql_strip(sql_replace(
    "html", [(r"(?i)<br\s*/?>", "\n"), ("<[^>]+>", ""), (SQL_SPACE + "+", " ")])) + """) AS text_md5 FROM pages""")
def _(t: Tables):
    return t.raw("pages").select("page_id", F.md5(text.strip_markup(F.col("html"))).alias("text_md5"))


@query("txt16_wire_boilerplate", "SELECT doc_id, md5(" + sql_strip(sql_replace("text", [
    (r"[가-힣]+" + SQL_SPACE + "*기자" + SQL_SPACE + "*=?" + SQL_SPACE + "*", ""),
    (r"[a-zA-Z0-9._%+-]+@[a-zA-Z0-9.-]+\.[a-zA-Z]{2,}", ""), (r"\[뉴시스\]", ""),
    ("◎공감언론" + SQL_SPACE + "*뉴시스.*", ""), (r"\*재판매.*", ""), (r"photo@newsis\.com.*", ""),
    (r"\n" + SQL_SPACE + r"*\n", "\n"), (SQL_SPACE + "+", " ")])) + ") AS cleaned_md5, "
    r"length(regexp_extract_all(text, '[a-zA-Z0-9._%+-]+@[a-zA-Z0-9.-]+\.[a-zA-Z]{2,}')) AS emails FROM documents")
def _(t: Tables):
    emails = F.size(F.regexp_extract_all("text", F.lit(fv.EMAIL_PATTERN), F.lit(0))).cast("long")
    return t.raw("documents").select(
        "doc_id", F.md5(text.clean_wire(F.col("text"))).alias("cleaned_md5"), emails.alias("emails")
    )


@query("txt17_reporter_tail", """SELECT conv_id, turn, '홍길동 기자가 말했다: ' || text || CASE turn % 3 WHEN 0 THEN '' ELSE ' ' END AS body
 FROM conversations""")
def _(t: Tables):
    # The word stands inside every text and stays there; three kinds of tails go.
    tail = F.when(F.col("turn") % 3 == 0, "…홍길동 기자 ").when(F.col("turn") % 3 == 1, " 홍길동 기자").otherwise(" 기자 홍길동")
    tailed = F.concat(F.lit("홍길동 기자가 말했다: "), "text", tail)
    return t.raw("conversations").select("conv_id", "turn", text.drop_reporter_tail(tailed).alias("body"))


@query("txt21_image_urls", """SELECT page_id, CASE WHEN contains(url, '/fr/') THEN NULL ELSE url END AS image_url FROM pages""")
def _(t: Tables):
    src = F.when(F.contains("url", F.lit("/fr/")), F.concat("url", F.lit("#1X1.png"))).otherwise(F.col("url"))
    style = F.concat(F.lit("width:9px; background-image: url('"), src, F.lit("')"))
    found = text.real_image(text.background_image(style))
    return t.raw("pages").select("page_id", found.alias("image_url"))


@query("srt4_numbered_paragraphs", """SELECT conv_id, turn, string_agg(w, ' ' ORDER BY CASE WHEN length(w) > 6 THEN 999
 ELSE length(w) END, pos) AS ordered FROM (SELECT conv_id, turn, unnest(string_split(text, ' ')) AS w,
 generate_subscripts(string_split(text, ' '), 1) AS pos FROM conversations) GROUP BY 1, 2""")
def _(t: Tables):
    numbered = F.transform(
        F.split("text", " "),
        lambda w, i: F.struct(
            i.alias("pos"),
            F.when(F.length(w) > 6, "last").otherwise(F.length(w).cast("string")).alias("number"),
            w.alias("text"),
        ),
    )
    ordered = F.array_join(text.order_by_number(numbered), " ")
    return t.raw("conversations").select("conv_id", "turn", ordered.alias("ordered"))


@query("txt18_absolute_url", r"""SELECT page_id, regexp_replace(url, '^http://', 'https://') AS https_url,
 'https://example.com' || regexp_extract(url, '^https?://[^/]+(/[^?#]*)', 1) AS rebased,
 regexp_extract(url, '^https?://([^/:?#]+)', 1) AS host FROM pages""")
def _(t: Tables):
    path = F.regexp_extract("url", r"^https?://[^/]+(/[^?#]*)", 1)
    base = F.lit("https://example.com")
    return t.raw("pages").select(
        "page_id",
        text.absolute_url(F.col("url"), base, force_https=True).alias("https_url"),
        text.absolute_url(path, base).alias("rebased"),
        F.parse_url("url", F.lit("HOST")).alias("host"),
    )


@query("txt19_article_id", r"""SELECT page_id,
 nullif(regexp_extract(regexp_replace(url, '[?#].*$', ''), '/(\d+)/?$', 1), '') AS article_id FROM pages""")
def _(t: Tables):
    plain = F.regexp_replace("url", "[?#].*$", "")
    return t.raw("pages").select("page_id", text.article_id(plain, text.ARTICLE_ID_PATTERNS["sisain"]).alias("article_id"))


@query("txt20_byline_email", r"""SELECT doc_id, nullif(regexp_extract(text,
 '([a-zA-Z0-9._%+-]+@[a-zA-Z0-9.-]+\.[a-zA-Z]{2,})', 1), '') AS email FROM documents""")
def _(t: Tables):
    return t.raw("documents").select("doc_id", text.byline_email(F.col("text")).alias("email"))


@query("txt22_first_filled", f"SELECT doc_id, coalesce(nullif({sql_strip('split_part(text, chr(10), 4)')}, ''), "
       f"nullif({sql_strip('split_part(text, chr(10), 2)')}, ''), nullif({sql_strip('lang')}, '')) AS title FROM documents")
def _(t: Tables):
    lines = F.split("text", "\n")
    return t.raw("documents").select(
        "doc_id",
        text.first_filled(
            F.try_element_at(lines, F.lit(4)), F.try_element_at(lines, F.lit(2)), F.col("lang")
        ).alias("title"),
    )


@query("txt23_cell_display", """SELECT event_id, CASE WHEN length(props || event_type || props) > 30
 THEN substring(props || event_type || props, 1, 27) || '...' ELSE props || event_type || props END AS cell FROM events""")
def _(t: Tables):
    cell = F.concat("props", "event_type", "props")
    return t.raw("events").select("event_id", text.truncate(cell, fv.CELL_TEXT).alias("cell"))


SQL_KEYWORD_HITS = " UNION ALL ".join(
    f"SELECT doc_id, '{name}' AS category, {pos} AS position, "
    + " + ".join(f"(CASE WHEN contains(lower(text), '{w}') THEN 1 ELSE 0 END)" for w in words)
    + " AS hits FROM documents"
    for pos, (name, words) in enumerate(TEST_RULES.items())
)


@query("join6_keyword_rules", f"SELECT * FROM ({SQL_KEYWORD_HITS}) WHERE hits > 0")
def _(t: Tables):
    return rules.match_keywords(t.raw("documents"), "doc_id", "text", rules.rule_table(t.spark, TEST_RULES))


@query("arr1_keep_paragraphs", """SELECT doc_id, array_to_string(list_filter(string_split(text, chr(10)),
 lambda p: length(p) > 10 AND NOT regexp_matches(p, '(?:@)|(?:^The )')), chr(10) || chr(10)) AS body FROM documents""")
def _(t: Tables):
    kept = text.keep_paragraphs(F.split("text", "\n"), 10, ["@", "^The "])
    return t.raw("documents").select("doc_id", F.array_join(kept, "\n\n").alias("body"))


@query("arr2_drop_contained", """WITH RECURSIVE lines AS (SELECT conv_id, turn, pos, piece FROM (
   SELECT conv_id, turn, unnest(string_split(text, ' ')) AS piece, generate_subscripts(string_split(text, ' '), 1) AS pos
   FROM conversations)),
 dropped AS (SELECT DISTINCT a.conv_id, a.turn, a.pos FROM lines a JOIN lines b
   ON a.conv_id = b.conv_id AND a.turn = b.turn AND b.pos < a.pos AND contains(b.piece, a.piece))
 SELECT l.conv_id, l.turn, string_agg(l.piece, ' ' ORDER BY l.pos) AS kept FROM lines l
 LEFT JOIN dropped d ON l.conv_id = d.conv_id AND l.turn = d.turn AND l.pos = d.pos
 WHERE d.pos IS NULL GROUP BY 1, 2""")
def _(t: Tables):
    kept = text.drop_contained(F.split("text", " "))
    return t.raw("conversations").select("conv_id", "turn", F.array_join(kept, " ").alias("kept"))


# --- dates ----------------------------------------------------------------------------------

SQL_DATE_TEXTS = """SELECT event_id, CAST(epoch(date_trunc('minute', ts)) AS BIGINT) AS dotted,
 CAST(epoch(date_trunc('second', ts)) AS BIGINT) AS dashed, CAST(epoch_us(ts) AS BIGINT) AS iso FROM events"""


@query("dat1_parse_formats", SQL_DATE_TEXTS)
def _(t: Tables):
    ts = F.col("ts").cast("timestamp")
    seoul = F.from_utc_timestamp(ts, "Asia/Seoul")
    written = t.raw("events").select(
        "event_id",
        F.date_format(seoul, "yyyy.MM.dd HH:mm").alias("a"),
        F.date_format(seoul, "yyyy-MM-dd HH:mm:ss").alias("b"),
        F.date_format(ts, "yyyy-MM-dd'T'HH:mm:ss.SSSSSS'Z'").alias("c"),
    )
    return written.select(
        "event_id",
        F.unix_seconds(dates.parse_instant(F.col("a"))).alias("dotted"),
        F.unix_seconds(dates.parse_instant(F.col("b"))).alias("dashed"),
        F.unix_micros(dates.parse_instant(F.col("c"))).alias("iso"),
    )


@query("dat2_loose_formats", """SELECT event_id, CAST(epoch(date_trunc('minute', ts)) AS BIGINT) AS short_year,
 CAST(epoch(date_trunc('minute', ts)) AS BIGINT) AS no_year FROM events""")
def _(t: Tables):
    as_of = F.lit("2024-06-01T00:00:00Z").cast("timestamp")
    seoul = F.from_utc_timestamp(F.col("ts").cast("timestamp"), "Asia/Seoul")
    written = t.raw("events").select(
        "event_id",
        F.concat(F.lit("최종 업데이트 "), F.date_format(seoul, "yy.MM.dd HH:mm")).alias("a"),
        F.date_format(seoul, "MM/dd HH:mm").alias("b"),
    )
    return written.select(
        "event_id",
        F.unix_seconds(dates.parse_loose_instant(F.col("a"), as_of)).alias("short_year"),
        F.unix_seconds(dates.parse_loose_instant(F.col("b"), as_of)).alias("no_year"),
    )


@query("dat3_relative_time", """SELECT event_id, CAST(epoch(date_trunc('second', ts)) AS BIGINT) - 60 * CAST(value AS BIGINT)
 AS minutes_ago, CAST(epoch(date_trunc('second', ts)) AS BIGINT) - 3600 * CAST(value AS BIGINT) AS hours_ago,
 CAST(epoch(date_trunc('second', ts)) AS BIGINT) - 86400 * CAST(value AS BIGINT) AS days_ago,
 CAST(epoch(date_trunc('second', ts)) AS BIGINT) - 604800 * CAST(value AS BIGINT) AS weeks_ago
 FROM (SELECT event_id, ts, floor(value) AS value FROM events)""")
def _(t: Tables):
    as_of, n = F.col("ts").cast("timestamp"), F.floor("value").cast("string")

    def ago(word: str):
        return F.unix_seconds(dates.parse_relative(F.concat(n, F.lit(f"{word} 전")), as_of))

    return t.raw("events").select(
        "event_id", ago("분").alias("minutes_ago"), ago("시간").alias("hours_ago"), ago("일").alias("days_ago"),
        ago("주").alias("weeks_ago"),
    )


@query("dat4_home_and_utc", """SELECT event_id, strftime(ts + INTERVAL 9 HOUR, '%Y-%m-%dT%H:%M:%S') || '+09:00' AS kst,
 strftime(ts, '%Y-%m-%dT%H:%M:%S') AS utc FROM events""")
def _(t: Tables):
    iso = F.date_format(F.col("ts").cast("timestamp"), "yyyy-MM-dd'T'HH:mm:ss'Z'")
    parsed = t.raw("events").select("event_id", dates.parse_instant(iso).alias("at"))
    return parsed.select(
        "event_id", dates.home_time(F.col("at")).alias("kst"), F.date_format("at", "yyyy-MM-dd'T'HH:mm:ss").alias("utc")
    )


@query("dat5_published_and_updated", """SELECT event_id, CAST(epoch(date_trunc('minute', ts)) AS BIGINT) AS published,
 CAST(epoch(date_trunc('minute', ts)) AS BIGINT) + 60 * CAST(floor(value) AS BIGINT) AS updated FROM events""")
def _(t: Tables):
    seoul = F.from_utc_timestamp(F.col("ts").cast("timestamp"), "Asia/Seoul")
    later = seoul + F.make_interval(mins=F.floor("value").cast("int"))
    texts = F.array(
        F.concat(F.date_format(later, "yyyy-MM-dd HH:mm"), F.lit(" 수정")),
        F.concat(F.date_format(seoul, "yyyy-MM-dd HH:mm"), F.lit(" 게재")),
        F.lit("2001-01-01 00:00 입력"),
    )
    found = t.raw("events").select("event_id", dates.published_and_updated(texts).alias("d"))
    return found.select(
        "event_id",
        F.unix_seconds("d.published_at").alias("published"),
        F.unix_seconds("d.updated_at").alias("updated"),
    )


@query("dat6_date_ladder", """SELECT event_id, CAST(epoch(date_trunc('second', ts)) AS BIGINT) AS published,
 value <= 5 AS defaulted FROM events""")
def _(t: Tables):
    ts = F.date_trunc("second", F.col("ts").cast("timestamp"))
    written = F.when(F.col("value") > 5, F.date_format(ts, "yyyy-MM-dd'T'HH:mm:ss'Z'")).otherwise(F.lit("soon"))
    resolved = dates.resolve_published(F.array(F.lit("no date"), written), ts)
    found = t.raw("events").select("event_id", resolved.alias("d"))
    return found.select(
        "event_id", F.unix_seconds("d.published_at").alias("published"), F.col("d.date_defaulted").alias("defaulted")
    )


@query("dat7_date_pieces", """SELECT event_id, strftime(ts, '%Y-%m-%d') AS day,
 CAST(epoch(date_trunc('second', ts)) AS BIGINT) - 32400 AS instant, strftime(ts, '%Y-%m-%d') AS card_day FROM events""")
def _(t: Tables):
    ts = F.col("ts").cast("timestamp")
    written = F.concat(F.col("event_type"), F.lit(" "), F.date_format(ts, "yyyy.MM.dd HH:mm:ss"), F.lit(" |"))
    card = dates.year_and_month_day(F.date_format(ts, "yyyy"), F.date_format(ts, "MM.dd"))
    return t.raw("events").select(
        "event_id",
        dates.dotted_date(written).cast("string").alias("day"),
        F.unix_seconds(dates.dotted_instant(written)).alias("instant"),
        card.cast("string").alias("card_day"),
    )


@query("dat8_fraction_digits", """SELECT event_id, CAST(epoch_us(date_trunc('millisecond', ts)) AS BIGINT) AS micros FROM events""")
def _(t: Tables):
    iso = F.date_format(F.col("ts").cast("timestamp"), "yyyy-MM-dd'T'HH:mm:ss.SSS'Z'")
    return t.raw("events").select("event_id", F.unix_micros(dates.parse_instant(iso)).alias("micros"))


@query("dat9_display_date", """SELECT event_id, strftime(ts, '%Y년 %m월 %d일') AS shown,
 substring(event_type || '-' || props, 1, 10) AS kept FROM events""")
def _(t: Tables):
    iso = F.date_format(F.col("ts").cast("timestamp"), "yyyy-MM-dd'T'HH:mm:ss")
    return t.raw("events").select(
        "event_id",
        dates.display_date(iso).alias("shown"),
        dates.display_date(F.concat("event_type", F.lit("-"), "props")).alias("kept"),
    )


# --- numbers and JSON -----------------------------------------------------------------------

@query("mth1_shares_and_labels", """SELECT user_id, round(n_left * 100.0 / total, 6) AS left_pct,
 CASE WHEN n_left * 100.0 / total > 15 THEN CAST(CAST(round_even(n_left * 100.0 / total, 0) AS INT) AS VARCHAR) || '%' END
 AS left_label FROM (SELECT user_id, count(*) AS total, count(*) FILTER (event_type = 'view') AS n_left
 FROM events GROUP BY user_id)""")
def _(t: Tables):
    counts = t.raw("events").groupBy("user_id").agg(
        F.count(F.lit(1)).alias("total"), F.count_if(F.col("event_type") == "view").alias("n_left")
    )
    share = counts.withColumn("share", numbers.percent(F.col("n_left"), F.col("total")))
    return share.select(
        "user_id", F.round("share", 6).alias("left_pct"), numbers.percent_label(F.col("share")).alias("left_label")
    )


@query("mth3_quality_score", """SELECT user_id, n, kind, CAST(CASE WHEN n < 20 THEN 0 WHEN kind = 'purchase' THEN n + 10
 WHEN kind = 'merged' THEN n + 5 ELSE n END AS BIGINT) AS quality FROM (SELECT user_id,
 CASE event_type WHEN 'click' THEN 'merged' ELSE event_type END AS kind, count(*) AS n FROM events GROUP BY 1, 2)""")
def _(t: Tables):
    kind = F.when(F.col("event_type") == "click", "merged").otherwise(F.col("event_type"))
    counts = t.raw("events").groupBy("user_id", kind.alias("kind")).agg(F.count(F.lit(1)).alias("n"))
    return counts.withColumn("quality", numbers.quality_score(F.col("n"), F.col("kind"), ["purchase"]))


@query("jsn1_story_documents", """SELECT CAST(doc_id AS VARCHAR) AS story_id,
 regexp_replace(split_part(text, chr(10), 1), '^ +| +$', '', 'g') AS title,
 'https://www.chosun.com/politics/' || doc_id AS url, source AS author, lang AS section, lang || ',' || source AS tags
 FROM documents WHERE split_part(text, chr(10), 1) <> ''""")
def _(t: Tables):
    tag = lambda c: F.struct(F.col(c).alias("text")) if c else F.struct(F.lit("").alias("text"))
    story = F.struct(
        F.col("doc_id").cast("string").alias("_id"),
        F.concat(F.lit("/politics/"), "doc_id").alias("canonical_url"),
        F.struct(F.substring_index("text", "\n", 1).alias("basic")).alias("headlines"),
        F.struct(F.array(F.struct(F.col("source").alias("name"))).alias("by")).alias("credits"),
        F.struct(
            F.struct(F.col("lang").alias("name")).alias("primary_section"),
            F.array(tag("lang"), tag(None), tag("source")).alias("tags"),
        ).alias("taxonomy"),
    )
    docs = t.raw("documents").select(F.to_json(story).alias("json"))
    flat = flatten_stories(parse_stories(docs, "json"))
    return flat.select("story_id", "title", "url", "author", "section", F.array_join("tags", ",").alias("tags"))


# Every document as a page of its source's feed, from its number on, as many stories long as it has thousands of letters.
SQL_RANGES = """ranges AS (SELECT source AS feed, doc_id AS first, doc_id + 1 + n_chars // 1000 AS last FROM documents),
 started AS (SELECT *, coalesce(first > max(last) OVER (PARTITION BY feed ORDER BY first, last
   ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), true) AS starts FROM ranges),
 numbered AS (SELECT *, sum(starts::INT) OVER (PARTITION BY feed ORDER BY first, last) AS island FROM started),
 merged AS (SELECT feed, min(first) AS first, max(last) AS last FROM numbered GROUP BY feed, island)"""


def _feed_pages(t: Tables):
    size = (F.lit(1) + F.floor(F.col("n_chars") / 1000)).alias("size")
    return t.raw("documents").select(F.col("source").alias("feed"), F.col("doc_id").alias("offset"), size)


def _feed_state(t: Tables):
    """Read in three runs, of which the second comes twice."""
    state = FeedState(t.spark, scratch_path(t.spark, "feed-state"))
    pages = _feed_pages(t).withColumn("turn", F.pmod(F.hash("offset"), F.lit(3)))
    for turn in (0, 1, 1, 2):
        state.record(pages.where(F.col("turn") == turn), f"r{turn}")
    return state


@query("src3_read_ranges", f"WITH {SQL_RANGES} SELECT feed, first, last FROM merged")
def _(t: Tables):
    return merged_ranges(_feed_state(t).ranges())


@query("src3_missing_ranges", f"""WITH {SQL_RANGES}, gaps AS (SELECT feed,
 coalesce(lag(last) OVER (PARTITION BY feed ORDER BY first), 0) AS first, first AS last FROM merged)
 SELECT feed, first, last FROM gaps WHERE first < last""")
def _(t: Tables):
    return _feed_state(t).missing()


@query("src3_story_feed", """SELECT CAST(doc_id AS VARCHAR) AS story_id,
 regexp_replace(split_part(text, chr(10), 1), '^ +| +$', '', 'g') AS title,
 'https://www.chosun.com/politics/' || doc_id AS url, source AS author
 FROM documents WHERE split_part(text, chr(10), 1) <> ''""")
def _(t: Tables):
    # Feed pages and story documents land as files; the feed lists all stories, some twice.
    docs = t.raw("documents")
    folder = scratch_path(t.spark, "feed")
    story = F.struct(
        F.col("doc_id").cast("string").alias("_id"),
        F.concat(F.lit("/politics/"), "doc_id").alias("canonical_url"),
        F.struct(F.substring_index("text", "\n", 1).alias("basic")).alias("headlines"),
        F.struct(F.array(F.struct(F.col("source").alias("name"))).alias("by")).alias("credits"),
    )
    docs.select(F.to_json(story)).write.text(f"{folder}/stories")
    page = F.floor(F.col("doc_id") / 500)
    twice = F.when(F.col("doc_id") % 2 == 0, F.array(F.format_string("a%d", page), F.format_string("b%d", page)))
    listed = docs.select(
        "doc_id", F.explode(F.coalesce(twice, F.array(F.format_string("a%d", page)))).alias("page")
    )
    element = F.struct(F.col("doc_id").cast("string").alias("_id"))
    elements = F.struct(F.collect_list(element).alias("content_elements"))
    feed = listed.groupBy("page").agg(F.to_json(elements).alias("value"))
    feed.repartition("page").write.partitionBy("page").text(f"{folder}/pages")
    return feed_stories(t.spark, f"{folder}/pages/*/*", f"{folder}/stories").select("story_id", "title", "url", "author")


@query("jsn2_vector_json", """SELECT vec_id, CAST(length(embedding) AS INT) AS n,
 round(list_sum(list_transform(embedding, lambda x: CAST(x AS DOUBLE) * x)), 5) AS squares FROM embeddings""")
def _(t: Tables):
    parsed = t.raw("embeddings").select("vec_id", numbers.vector_from_json(F.to_json("embedding")).alias("v"))
    return parsed.where(numbers.valid_vector(F.col("v"))).select(
        "vec_id", F.size("v").alias("n"), F.round(numbers.dot(F.col("v"), F.col("v")), 5).alias("squares")
    )


@query("flt9_valid_vectors", "SELECT event_id FROM events WHERE CAST(json_extract(props, '$.k') AS INT) > 50")
def _(t: Tables):
    # A number list where k is large, else text that is no list of numbers.
    k = F.get_json_object("props", "$.k").cast("int")
    written = t.raw("events").select("event_id", F.when(k > 50, F.concat(F.lit("["), k, F.lit(", 0.5]"))).otherwise(F.col("props")).alias("j"))
    return written.where(numbers.valid_vector(numbers.vector_from_json(F.col("j")))).select("event_id")


@query("jsn3_structured_dates", """SELECT page_id, CAST(epoch(make_timestamp(2024, 5, page_id % 20 + 1, 1, 0, 0)) AS BIGINT)
 AS published FROM pages""")
def _(t: Tables):
    iso = F.format_string("2024-05-%02dT10:00:00+09:00", F.col("page_id") % 20 + 1)
    key = F.when(F.col("page_id") % 2 == 0, "datePublished").otherwise("dateModified")
    script = F.format_string('<head><script type="application/ld+json">{"@type": "NewsArticle", "%s": "%s"}</script>', key, iso)
    landed = t.raw("pages").withColumn("source", F.lit("plain")).withColumn("html", F.replace("html", F.lit("<head>"), script))
    found = extract_articles(landed, F.lit("2024-06-01T00:00:00Z").cast("timestamp"))
    return found.select("page_id", F.unix_seconds("published_at").alias("published"))


@query("txt14_fenced_events", """SELECT event_id, event_type AS title, event_type || '|' || user_id AS keywords FROM events""")
def _(t: Tables):
    event = F.struct(
        F.col("event_id").cast("string").alias("event_id"),
        F.col("event_type").alias("title"),
        F.array("event_type", F.col("user_id").cast("string")).alias("keywords"),
    )
    payload = F.to_json(F.struct(F.array(event).alias("events")))
    answer = (
        F.when(F.col("event_type") == "view", F.concat(F.lit("Sure:\n```json\n"), payload, F.lit("\n```\nDone")))
        .when(F.col("event_type") == "click", F.concat(F.lit("```\n"), payload, F.lit("\n```")))
        .otherwise(payload)
    )
    parsed = t.raw("events").select(text.parse_events(answer).alias("events")).select(F.inline("events"))
    return parsed.select(
        F.col("event_id").cast("long").alias("event_id"), "title", F.array_join("keywords", "|").alias("keywords")
    )
