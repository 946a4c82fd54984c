"""Keyword rules as expressions and as joins."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from newsloom.functions import fixed_values as fv
from newsloom.functions.text import count_keywords, let

def rule_table(spark: SparkSession, rules: Mapping[str, Sequence[str]]) -> DataFrame:
    """``(category, position, keyword)`` of a rule mapping."""
    rows = [(name, pos, word) for pos, (name, words) in enumerate(rules.items()) for word in words]
    return spark.createDataFrame(rows, "category string, position int, keyword string")


def match_keywords(texts: DataFrame, key: str, text: str, rules: DataFrame) -> DataFrame:
    """``(key, category, position, hits)``: how many keywords of each category occur in each text.

    The rules travel inside one row as an array, so every text is scanned once in a narrow stage and
    no pair of text and keyword is ever a row. A rule table is a hand-written dictionary; it has to fit a row.
    """
    grouped = rules.groupBy("category", "position").agg(F.sort_array(F.collect_list("keyword")).alias("keywords"))
    packed = grouped.agg(
        F.sort_array(F.collect_list(F.struct("position", "category", "keywords"))).alias("rules")
    )
    hits = F.transform(
        F.col("rules"),
        lambda r: F.struct(
            r["category"].alias("category"),
            r["position"].alias("position"),
            F.size(F.filter(r["keywords"], lambda k: F.contains(F.col("__text"), k))).alias("hits"),
        ),
    )
    return (
        texts.select(key, F.lower(text).alias("__text"), packed.scalar().alias("rules"))
        .select(key, F.inline(F.filter(hits, lambda h: h["hits"] > 0)))
    )


def first_pattern(text: Column, patterns: Sequence[Mapping], field: str, floor: int = fv.MIN_EVENT_KEYWORDS) -> Column:
    """``field`` of the first pattern with at least ``floor`` keywords in the text, else null."""

    def first(t: Column) -> Column:
        return F.coalesce(*[F.when(count_keywords(t, p["keywords"]) >= floor, F.lit(p[field])) for p in patterns])

    return let(text, first)
