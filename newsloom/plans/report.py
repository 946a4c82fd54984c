"""The bias report: issues, their coverage by leaning, and the text fields of report cards."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from newsloom.functions import dates, numbers, text
from newsloom.functions import fixed_values as fv
from newsloom.operators.aggregates import issue_stats

STATS = ["total", *fv.BIAS_BUCKETS, "other"]


def issue_report(issues: DataFrame, articles: DataFrame, outlets: DataFrame) -> DataFrame:
    """Every issue with its counts and shares, most covered first. One aggregation for all issues."""
    stats = issue_stats(articles, outlets)
    joined = issues.join(stats, issues["id"] == stats["issue_id"], "left").select(
        *[issues[c] for c in issues.columns], *[F.coalesce(stats[c], F.lit(0)).alias(c) for c in STATS]
    )
    shares = {f"{b}_pct": numbers.percent(F.col(b), F.col("total")) for b in fv.BIAS_BUCKETS}
    labels = {f"{b}_label": numbers.percent_label(F.col(f"{b}_pct")) for b in fv.BIAS_BUCKETS}
    return joined.withColumns(shares).withColumns(labels).orderBy(F.desc("total"), F.desc("created_at"), "id")


def report_cards(report: DataFrame) -> DataFrame:
    """Card texts of every issue in report order."""
    created = F.date_format("created_at", "yyyy-MM-dd")
    left, right = text.report_text(F.col("left_perspective")), text.report_text(F.col("right_perspective"))
    return report.select(
        "id",
        F.format_string(fv.CARD_COUNT_LINE, F.col("total"), dates.display_date(created)).alias("count_line"),
        text.report_text(F.col("title")).alias("title"),
        text.report_text(F.col("issue_summary")).alias("summary"),
        left.alias("left_text"),
        right.alias("right_text"),
        ((left != "") | (right != "")).alias("has_perspectives"),
        (left != "").alias("has_left"),
        (right != "").alias("has_right"),
        *[f"{b}_label" for b in fv.BIAS_BUCKETS],
    )
