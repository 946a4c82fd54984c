"""Page extraction and the incremental stream."""

from __future__ import annotations

from pyspark.sql import functions as F

from newsloom.catalog.base import SQL_ARTICLES, SQL_SPACE, Tables, query, sql_clean, sql_clean_title, sql_lead, sql_strip
from newsloom.catalog.text_queries import SQL_CATEGORY, TEST_OTHER, TEST_RULES, sql_scores
from newsloom.session import scratch_path
from newsloom.sources import pages
from newsloom.streaming.ingest import read_ingested, start_ingest

AS_OF = "2024-06-01T00:00:00Z"


def _landed(t: Tables):
    return t.raw("pages").withColumn("source", F.lit("plain"))


def _as_of():
    return F.lit(AS_OF).cast("timestamp")


def sql_nodes(x: str, join: str) -> str:
    """Text nodes of a piece of markup: entities decoded, each stripped, blanks dropped, joined."""
    plain = "regexp_replace(replace(n, '&quot;', '\"'), '&amp;?', '&', 'g')"
    return (
        f"array_to_string(list_filter(list_transform(string_split_regex({x}, '<[^>]*>'), lambda n: {sql_strip(plain)}), "
        f"lambda n: n <> ''), '{join}')"
    )


SQL_PAGES = f"""art AS (SELECT page_id, html, regexp_extract(html, '(?s)<article>(.*?)</article>', 1) AS a,
   regexp_extract(html, '(?s)<nav>(.*?)</nav>', 1) AS nav FROM pages),
 paras AS (SELECT page_id, html, a, list_transform(string_split(a, '<p>')[2:],
   lambda p: {sql_nodes("split_part(p, '</p>', 1)", " ")}) AS ps FROM art),
 bodies AS (SELECT *, {sql_strip(f"array_to_string(list_filter(list_transform(ps, lambda p: regexp_replace(p, '{SQL_SPACE}+', ' ', 'g')), lambda p: length(p) > 10), chr(10) || chr(10))")} AS content FROM paras),
 found AS (SELECT page_id, unnest(regexp_extract_all(nav, '<li><a href="([^"]*)">([^<]*)</a>', 1)) AS href,
   unnest(regexp_extract_all(nav, '<li><a href="([^"]*)">([^<]*)</a>', 2)) AS label,
   generate_subscripts(regexp_extract_all(nav, '<li><a href="([^"]*)">([^<]*)</a>', 1), 1) - 1 AS pos FROM art),
 items AS (SELECT page_id, pos, {sql_nodes('label', '')} AS title, {sql_nodes('href', '')} AS link FROM found)"""


@query("ext1_list_items", f"""WITH {SQL_PAGES} SELECT page_id, CAST(pos AS INT) AS pos, title,
 CASE WHEN starts_with(link, '/') OR regexp_matches(link, '^https?://') THEN link ELSE '/' || link END AS url,
 row_number() OVER (PARTITION BY page_id ORDER BY pos) AS item_rank FROM items WHERE title <> '' AND link <> ''""")
def _(t: Tables):
    items = pages.accepted_items(pages.list_items(_landed(t)))
    return items.select("page_id", "pos", "title", "url", F.col("item_rank").cast("long").alias("item_rank"))


@query("win4_items_per_page", f"WITH {SQL_PAGES} SELECT page_id, least(count(*), 3) AS n FROM items WHERE title <> '' "
       "AND link <> '' GROUP BY page_id")
def _(t: Tables):
    first = pages.first_per_page(pages.list_items(_landed(t)), F.lit(3))
    return first.groupBy("page_id").agg(F.count(F.lit(1)).alias("n"))


@query("ext2_article_bodies", f"""WITH {SQL_PAGES} SELECT page_id, true AS container_found, md5(content) AS content_md5,
 {sql_nodes("regexp_extract(html, '(?s)<title>(.*?)</title>', 1)", '')} AS page_title FROM bodies""")
def _(t: Tables):
    found = pages.extract_articles(_landed(t), _as_of())
    return found.select("page_id", "container_found", F.md5("content").alias("content_md5"), "page_title")


@query("ext3_paragraph_rules", f"""WITH {SQL_PAGES} SELECT page_id, CAST(length(ps) AS INT) AS n_paragraphs,
 CAST(length(content) AS INT) AS n_chars FROM bodies""")
def _(t: Tables):
    found = pages.with_body(pages.article_candidates(_landed(t)))
    return found.select("page_id", F.size("paragraphs").alias("n_paragraphs"), F.length("content").alias("n_chars"))


def _dated_pages(t: Tables):
    """Pages with a date written into each in one of three layouts, or none; some are followed by an older date."""
    day = F.lpad((F.col("page_id") % 20 + 1).cast("string"), 2, "0")
    meta = F.format_string('<head><meta property="article:published_time" content="2024-05-%sT10:00:00+09:00">', day)
    time = F.format_string('<article><time datetime="2024-05-%s 10:00"></time>', day)
    older = F.concat(time, F.lit('<time datetime="2023-01-01 00:00"></time>'))
    kind = F.col("page_id") % 4
    return _landed(t).withColumn(
        "html",
        F.when(kind == 0, F.replace("html", F.lit("<head>"), meta))
        .when(kind == 1, F.replace("html", F.lit("<article>"), time))
        .when(kind == 2, F.replace("html", F.lit("<article>"), older))
        .otherwise(F.col("html")),
    )


@query("ext4_published_dates", """SELECT page_id, page_id % 4 = 3 AS date_defaulted, CASE WHEN page_id % 4 = 3 THEN 1717200000
 ELSE CAST(epoch(make_timestamp(2024, 5, page_id % 20 + 1, 1, 0, 0)) AS BIGINT) END AS published FROM pages""")
def _(t: Tables):
    found = pages.extract_articles(_dated_pages(t), _as_of())
    return found.select("page_id", F.unix_seconds("published_at").alias("published"), "date_defaulted")


@query("ext5_rich_fields", f"""WITH {SQL_PAGES} SELECT page_id,
 {sql_nodes("regexp_extract(a, '(?s)<h1>(.*?)</h1>', 1)", '')} AS headings, '1' AS levels,
 CAST(length(regexp_extract_all(a, '<a href')) AS INT) AS n_links, '/a.jpg:|/b.jpg:second ' || page_id AS images
 FROM art""")
def _(t: Tables):
    # Two figures, of which only the second has a caption.
    figures = F.format_string(
        '<article><figure><img src="/a.jpg"></figure><figure><img src="/b.jpg"><figcaption>second %d</figcaption></figure>',
        F.col("page_id"),
    )
    landed = _landed(t).withColumn("html", F.replace("html", F.lit("<article>"), figures))
    found = pages.extract_articles(landed, _as_of())
    shown = F.transform("images", lambda i: F.concat(i["src"], F.lit(":"), i["caption"]))
    return found.select(
        "page_id", F.array_join("headings", " | ").alias("headings"),
        F.array_join(F.transform("outline", lambda h: h["level"].cast("string")), "").alias("levels"),
        F.size("links").alias("n_links"), F.array_join(shown, "|").alias("images"),
    )


SQL_STREAM = f"""WITH {SQL_ARTICLES}, fresh AS (SELECT *, {sql_strip('title')} AS t FROM articles
   WHERE issue_id <> 'de' AND title <> '' AND length({sql_strip('content')}) >= 20),
 step AS (SELECT url, {sql_clean_title('t')} AS title, {sql_clean('content')} AS content FROM fresh),
 leads AS (SELECT *, {sql_lead('content')} AS lead FROM step), scored AS (SELECT *, {sql_scores('title', 'lead')} FROM leads)
 SELECT url, title, md5(content) AS content_md5, lead AS lead_paragraph, {SQL_CATEGORY} AS political_category FROM scored"""


@query("str1_incremental_ingest", SQL_STREAM)
def _(t: Tables):
    # Every page lands twice, in files of different hours, which come in by halves of an hour: one of them is kept.
    # There are as many files as the table has splits, so a file, and what writes it, stays small.
    raw = t.raw("documents")
    landed = scratch_path(t.spark, "landed")
    files = max(2, raw.rdd.getNumPartitions())
    for hour in (0, 1):
        raw.withColumn("hour", F.lit(hour)).repartition(files, "doc_id").write.mode("append").parquet(landed)
    schema = t.spark.read.parquet(landed).schema
    stream = t.spark.readStream.schema(schema).option("maxFilesPerTrigger", -(-files // 2)).parquet(landed)
    rows = stream.select(
        F.substring_index("text", "\n", 1).alias("title"),
        F.concat(F.lit("https://"), "source", F.lit(".example.com/article/"), "doc_id").alias("url"),
        F.col("text").alias("content"),
        F.col("source").alias("media_id"),
        F.lit(None).cast("timestamp").alias("published_at"),
        F.timestamp_seconds(F.lit(1_700_000_000) + F.col("hour") * 3600 - F.col("doc_id")).alias("fetched_at"),
    )
    target = scratch_path(t.spark, "ingested")
    run = start_ingest(
        rows, target, scratch_path(t.spark, "stream"), _as_of(), TEST_RULES, TEST_OTHER,
        stored=lambda: t.articles().where("issue_id = 'de'"), key_slots=8,
    )
    run.awaitTermination()
    return read_ingested(t.spark, target).select(
        "url", "title", F.md5("content").alias("content_md5"), "lead_paragraph", "political_category"
    )
