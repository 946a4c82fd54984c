"""End to end: from embedded articles to issues, their members, their texts and the report."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from newsloom.functions import fixed_values as fv
from newsloom.operators.aggregates import clustered_members
from newsloom.operators.generate import TextModel
from newsloom.operators.tables import keyed_update
from newsloom.plans import content, refine
from newsloom.plans.cluster import cluster_categories
from newsloom.session import cut_lineage
from newsloom.sources import scans, sinks


@dataclass(frozen=True)
class Issues:
    issues: DataFrame
    members: DataFrame  # (issue_id, article_id)


def build_issues(
    articles: DataFrame,
    outlets: DataFrame,
    run_id: str,
    created_at: Column,
    pattern_model: TextModel | None = None,
    word_pattern: str = fv.HANGUL_WORD,
    bonus_event_types: tuple[str, ...] = (),
    **clustering,
) -> Issues:
    """The best groups of every category as issues, all categories in one job."""
    embedded = scans.embedded(articles)
    labels = cut_lineage(cluster_categories(embedded, **clustering))
    facts = embedded.select("id", "title", "media_id", "published_at")
    members = (
        clustered_members(labels)
        .withColumnRenamed("political_category", "category")
        .join(facts, "id")
        .select("category", "cluster_id", "id", "title", "media_id", "published_at")
    )
    patterns = refine.event_patterns(members, pattern_model, word_pattern)
    groups = refine.refine_groups(members, patterns, word_pattern, numbered=False)
    top = cut_lineage(refine.rank_groups(groups, outlets, bonus_event_types))
    issues = sinks.issue_rows(top, run_id, created_at)
    return Issues(issues.drop("group_key"), sinks.issue_bridge(issues, groups))


def category_results(built: Issues) -> DataFrame:
    """``(category, success, issues, articles)`` of the categories that gave issues."""
    sizes = built.members.groupBy("issue_id").agg(F.count(F.lit(1)).alias("n"))
    joined = built.issues.join(sizes, built.issues["id"] == sizes["issue_id"])
    return joined.groupBy("category").agg(
        F.lit(True).alias("success"), F.count(F.lit(1)).alias("issues"), F.sum("n").alias("articles")
    )


def write_texts(
    issues: DataFrame,
    articles: DataFrame,
    outlets: DataFrame,
    title_model: TextModel | None = None,
    summary_model: TextModel | None = None,
    perspective_model: TextModel | None = None,
    word_pattern: str = fv.HANGUL_WORD,
) -> DataFrame:
    """Issues with title, summary and perspectives written; ``articles`` carry their ``issue_id``.

    Answers are materialised once, so reading the result again asks no model again.
    """
    columns = ("issue_summary", "left_perspective", "right_perspective")
    blank = issues.withColumns({c: F.lit(None).cast("string") for c in columns if c not in issues.columns})
    titled = keyed_update(blank, cut_lineage(content.issue_titles(articles, title_model, word_pattern)))
    summed = keyed_update(titled, cut_lineage(content.issue_summaries(articles, summary_model)))
    return keyed_update(
        summed, cut_lineage(content.issue_perspectives(issues, articles, outlets, perspective_model))
    )
