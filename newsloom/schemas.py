"""Fixed schemas of the engine's tables and the check applied on entry."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

DDL = {
    "pages_raw": "page_id string, source string, url string, html string, page_kind string, fetched_at timestamp",
    "articles": (
        "id string, title string, url string, content string, media_id string, published_at timestamp, "
        "created_at timestamp, is_preprocessed boolean, preprocessed_at timestamp, lead_paragraph string, "
        "political_category string, embedding array<float>, issue_id string"
    ),
    "media_outlets": "id string, name string, bias string, website string, created_at timestamp",
    "issues": (
        "id string, title string, category string, source int, left_source int, center_source int, "
        "right_source int, created_at timestamp, issue_summary string, left_perspective string, "
        "right_perspective string"
    ),
    "issue_articles": "issue_id string, article_id string",
    "crawl_runs": (
        "crawler_name string, status string, start_time timestamp, end_time timestamp, "
        "articles_collected long, error_message string"
    ),
}


def schema(table: str) -> T.StructType:
    return T.StructType.fromDDL(DDL[table])


def conform(df: DataFrame, table: str) -> DataFrame:
    """Bring ``df`` to the fixed schema of ``table``: absent columns become null, extra ones are refused."""
    wanted = schema(table)
    extra = set(df.columns) - set(wanted.fieldNames())
    if extra:
        raise ValueError(f"{table}: unknown columns {sorted(extra)}")
    return df.select(
        *[
            (F.col(f.name) if f.name in df.columns else F.lit(None)).cast(f.dataType).alias(f.name)
            for f in wanted.fields
        ]
    )
