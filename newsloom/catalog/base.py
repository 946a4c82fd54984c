"""Registry of queries over the driver tables, each with its equivalent DuckDB statement where there is one."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from newsloom.session import configure

Run = Callable[[SparkSession, str], DataFrame]


@dataclass(frozen=True)
class Entry:
    run: Run
    sql: str | None


ENTRIES: dict[str, Entry] = {}


def query(name: str, sql: str | None = None):
    """Register a query under ``name``."""

    def register(fn: Callable[[Tables], DataFrame]):
        if name in ENTRIES:
            raise ValueError(f"query {name} registered twice")
        ENTRIES[name] = Entry(lambda spark, sf_dir: fn(Tables(configure(spark), sf_dir)), sql)
        return fn

    return register


class Tables:
    """The driver tables, and the engine's tables derived from them."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark, self.sf_dir = spark, sf_dir

    def raw(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.sf_dir}/{name}.parquet")

    def articles(self) -> DataFrame:
        """Documents as articles, without a publication time."""
        doc = self.raw("documents")
        return doc.select(
            F.col("doc_id").cast("string").alias("id"),
            F.substring_index("text", "\n", 1).alias("title"),
            F.concat(F.lit("https://"), "source", F.lit(".example.com/article/"), "doc_id").alias("url"),
            F.col("text").alias("content"),
            F.col("source").alias("media_id"),
            F.col("lang").alias("issue_id"),
            (F.col("n_chars") >= 1000).alias("is_preprocessed"),
        )

    def event_times(self) -> DataFrame:
        return self.raw("events").select(
            F.col("event_id").cast("string").alias("id"), F.col("ts").cast("timestamp").alias("published_at")
        )

    def dated_articles(self) -> DataFrame:
        """Documents as articles; the event of the same number gives the publication time."""
        return self.articles().join(self.event_times(), "id", "left")

    def outlets(self) -> DataFrame:
        number = F.regexp_extract("source", r"(\d+)$", 1).cast("int")
        biases = F.array(*[F.lit(b) for b in ("left", "center", "right", "center-left")])
        return (
            self.raw("documents")
            .select("source")
            .distinct()
            .select(
                F.col("source").alias("id"),
                F.concat(F.lit("Outlet "), number).alias("name"),
                F.get(biases, number % 4).alias("bias"),
                F.lit("").alias("website"),
                F.lit(None).cast("timestamp").alias("created_at"),
            )
        )

    def issues(self) -> DataFrame:
        """One issue per language."""
        return (
            self.dated_articles()
            .groupBy("issue_id")
            .agg(
                F.max("published_at").alias("created_at"),
                F.min("title").alias("issue_summary"),
                F.concat(F.lit("'"), F.max("title"), F.lit("'")).alias("left_perspective"),
                F.count(F.lit(1)).alias("source"),
            )
            .select(
                F.col("issue_id").alias("id"),
                F.concat(F.lit('"Coverage in '), "issue_id", F.lit('"')).alias("title"),
                "issue_summary",
                "created_at",
                F.col("source").cast("int").alias("source"),
                "left_perspective",
                F.lit("").alias("right_perspective"),
            )
        )

    def vectors(self) -> DataFrame:
        """Embeddings as articles: the label is the category; the event of the same number gives the time."""
        return self.raw("embeddings").select(
            F.col("vec_id").cast("string").alias("id"), "embedding", F.col("label").alias("category")
        )

    def documents_with_vectors(self) -> DataFrame:
        """Articles that have a vector of the same number."""
        return self.dated_articles().join(self.vectors().select("id", "embedding"), "id")


# --- SQL fragments --------------------------------------------------------------------------

SQL_SPACE = (
    r"[\s\x{0b}\x{1c}-\x{1f}\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]"
)


def sql_strip(x: str) -> str:
    return f"regexp_replace({x}, '^{SQL_SPACE}+|{SQL_SPACE}+$', '', 'g')"


def sql_replace(x: str, rules: list[tuple[str, str]]) -> str:
    for pattern, replacement in rules:
        x = f"regexp_replace({x}, '{pattern}', '{replacement}', 'g')"
    return x


# The noise patterns of ``functions/fixed_values.py`` as DuckDB writes them.
SQL_NOISE = [
    (r"\([^)]*\)", ""),
    (r"[가-힣]{2,4}" + SQL_SPACE + "*기자" + SQL_SPACE + "*=", ""),
    (r"\[[^\]]*\]", ""),
    (r"[◇【】…]", ""),
    (r"<[^>]*>", ""),
    (r"&[a-zA-Z0-9#]+;", ""),
    (SQL_SPACE + "+", " "),
]
SQL_TITLE_NOISE = [
    (r"\[(속보|단독|기획|특집|인터뷰|분석|해설|논평|사설|칼럼|기고|오피니언|포토|영상|동영상|인포그래픽)\]", ""),
    (r"^[가-힣]{1,2}" + SQL_SPACE + "*(기자|특파원)" + SQL_SPACE + "*[:=]?", ""),
    (r"[◆◇▲△●○■□★☆▶◀◁▷①②③④⑤⑥⑦⑧⑨⑩]+", ""),
    (r"^\[.*?\]", ""),
    (r"^\(.*?\)", ""),
    (r"^<.*?>", ""),
    (SQL_SPACE + "+", " "),
]


def sql_clean(x: str) -> str:
    return sql_strip(sql_replace(f"coalesce({x}, '')", SQL_NOISE))


def sql_clean_title(x: str) -> str:
    return sql_strip(sql_replace(sql_clean(x), SQL_TITLE_NOISE))


def sql_lead(x: str) -> str:
    first = sql_strip(f"split_part({x}, '.', 1)")
    return f"CASE WHEN {first} <> '' THEN {first} || '.' ELSE substring({sql_strip(x)}, 1, 100) END"


SQL_ARTICLES = """articles AS (
  SELECT CAST(d.doc_id AS VARCHAR) AS id, split_part(d.text, chr(10), 1) AS title,
         'https://' || d.source || '.example.com/article/' || d.doc_id AS url, d.text AS content,
         d.source AS media_id, d.lang AS issue_id, d.n_chars >= 1000 AS is_preprocessed, e.ts AS published_at
  FROM documents d LEFT JOIN events e ON e.event_id = d.doc_id)"""
SQL_OUTLETS = """outlets AS (
  SELECT DISTINCT source AS id, 'Outlet ' || CAST(substring(source, 4) AS INT) AS name,
         CASE CAST(substring(source, 4) AS INT) % 4 WHEN 0 THEN 'left' WHEN 1 THEN 'center'
              WHEN 2 THEN 'right' ELSE 'center-left' END AS bias, '' AS website
  FROM documents)"""
SQL_ISSUES = """issues AS (
  SELECT issue_id AS id, '"Coverage in ' || issue_id || '"' AS title, min(title) AS issue_summary,
         max(published_at) AS created_at, CAST(count(*) AS INT) AS source,
         '''' || max(title) || '''' AS left_perspective, '' AS right_perspective
  FROM articles GROUP BY issue_id)"""
SQL_BASE = f"WITH {SQL_ARTICLES}, {SQL_OUTLETS}, {SQL_ISSUES}"
