"""Counting operators. All are partial-then-final hash aggregations."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from newsloom.functions import fixed_values as fv
from newsloom.functions.text import classify_word, is_blank
from newsloom.operators.tables import with_bias
from newsloom.operators.windows import number_within, top_n


def bias_counts(total: str = "total") -> list[Column]:
    """Total and the three buckets; leanings without a bucket count in the total and in ``other``."""
    bias = F.col("bias")
    return [
        F.count(F.lit(1)).alias(total),
        *[F.count_if(bias == b).alias(b) for b in fv.BIAS_BUCKETS],
        F.count_if(bias.isNull() | ~bias.isin(*fv.BIAS_BUCKETS)).alias("other"),
    ]


def issue_stats(articles: DataFrame, outlets: DataFrame) -> DataFrame:
    """Per issue: articles with a known outlet, by leaning."""
    tagged = with_bias(articles.where(F.col("issue_id").isNotNull()).select("issue_id", "media_id"), outlets)
    return tagged.groupBy("issue_id").agg(*bias_counts())


def group_bias_counts(members: DataFrame, outlets: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Per group: all members, by leaning; members without a known outlet count in the total."""
    return with_bias(members.select(*keys, "media_id"), outlets, "left").groupBy(*keys).agg(*bias_counts())


def articles_per_outlet(articles: DataFrame, outlets: DataFrame) -> DataFrame:
    """Article count of every outlet, zero included. Counts first, so the join sees one row per outlet."""
    counts = articles.groupBy("media_id").agg(F.count(F.lit(1)).alias("n"))
    return outlets.join(counts, outlets["id"] == counts["media_id"], "left").select(
        outlets["id"].alias("media_id"), outlets["name"], F.coalesce("n", F.lit(0)).alias("n_articles")
    )


def _total_columns(as_of: Column) -> list[Column]:
    in_window = F.col("published_at") >= as_of - F.make_interval(days=F.lit(fv.RECENT_DAYS))
    return [
        F.count(F.lit(1)).alias("total"),
        F.count_if(in_window).alias("recent"),
        F.count_if(F.col("is_preprocessed")).alias("preprocessed"),
        (F.count(F.lit(1)) - F.count_if(F.col("is_preprocessed"))).alias("not_preprocessed"),
    ]


def article_totals(articles: DataFrame, as_of: Column) -> DataFrame:
    return articles.agg(*_total_columns(as_of))


def article_totals_per_outlet(articles: DataFrame, as_of: Column) -> DataFrame:
    """The same totals by ``media_id``, from which both the grand totals and the outlet counts follow."""
    return articles.groupBy("media_id").agg(*_total_columns(as_of))


def table_profile(df: DataFrame, name: str, ts: str) -> DataFrame:
    """One row: row count and date of the latest row."""
    return df.agg(F.count(F.lit(1)).alias("n_rows"), F.date_format(F.max(ts), "yyyy-MM-dd").alias("latest")).select(
        F.lit(name).alias("table_name"), "n_rows", "latest"
    )


REQUIRED_FIELDS = ["title", "url", "media_id", "published_at"]


def missing_counts(articles: DataFrame, fields: Sequence[str] = tuple(REQUIRED_FIELDS)) -> DataFrame:
    return articles.agg(
        F.count(F.lit(1)).alias("total"),
        *[F.count_if(is_blank(F.col(f).cast("string"))).alias(f"missing_{f}") for f in fields],
    )


def duplicate_urls(articles: DataFrame) -> DataFrame:
    """URLs stored more than once, with their count."""
    filled = articles.where(~is_blank(F.col("url")))
    return filled.groupBy("url").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > 1)


def quality_totals(articles: DataFrame) -> DataFrame:
    """One row: rows, missing-field hits, duplicate URLs, and the issue total.

    One pass over the table: counts per URL carry the field counts of their rows along.
    """
    hits = sum((is_blank(F.col(f).cast("string")).cast("long") for f in REQUIRED_FIELDS[1:]),
               is_blank(F.col(REQUIRED_FIELDS[0])).cast("long"))
    per_url = articles.groupBy("url").agg(F.count(F.lit(1)).alias("n"), F.sum(hits).alias("hits"))
    repeated = (F.col("n") > 1) & ~is_blank(F.col("url"))
    totals = per_url.agg(
        F.coalesce(F.sum("n"), F.lit(0)).alias("total"),
        F.coalesce(F.sum("hits"), F.lit(0)).alias("missing_hits"),
        F.count_if(repeated).alias("duplicate_urls"),
    )
    return totals.withColumn("issue_total", F.col("missing_hits") + (F.col("duplicate_urls") > 0).cast("long"))


def cluster_stats(labels: DataFrame, keys: Sequence[str] = ("category",)) -> DataFrame:
    """Per block: clusters, noise points, points. Sizes are counted first, so the second step is small."""
    sizes = cluster_sizes(labels, keys)
    noise = F.col("cluster_id") == -1
    return sizes.groupBy(*keys).agg(
        F.count_if(~noise).alias("clusters"),
        F.coalesce(F.sum(F.when(noise, F.col("size"))), F.lit(0)).alias("noise"),
        F.sum("size").alias("points"),
    )


def cluster_sizes(labels: DataFrame, keys: Sequence[str] = ("category",)) -> DataFrame:
    return labels.groupBy(*keys, "cluster_id").agg(F.count(F.lit(1)).alias("size"))


def clustered_members(labels: DataFrame) -> DataFrame:
    """Members of real clusters, flat."""
    return labels.where(F.col("cluster_id") != -1)


def crawl_summary(runs: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    success = F.count_if(F.col("status") == "success")
    total = F.count(F.lit(1))
    return runs.groupBy(*keys).agg(
        total.alias("runs"),
        success.alias("succeeded"),
        (total - success).alias("failed"),
        F.coalesce(F.sum("articles_collected"), F.lit(0)).alias("articles"),
        F.coalesce(F.try_divide(success * F.lit(100.0), total), F.lit(0.0)).alias("success_pct"),
    )


def category_totals(results: DataFrame) -> DataFrame:
    """Totals over ``(category, success, issues, articles)``; the category list is a rule list, hence short."""
    return results.agg(
        F.sum("issues").alias("issues"),
        F.sum("articles").alias("articles"),
        F.count_if("success").alias("succeeded"),
        F.concat_ws(", ", F.sort_array(F.collect_set(F.when(F.col("success"), F.col("category"))))).alias("categories"),
    )


ORDER = "__order"
POSITIONS = 20  # bits for a word's place in its title


def in_order(titles: DataFrame) -> DataFrame:
    """Titles with their number by time and id, so that what came first is the least of whole numbers."""
    return number_within(titles, [], [F.asc_nulls_first("published_at"), F.asc_nulls_first("id")], ORDER)


def word_counts(titles: DataFrame, keys: Sequence[str], pattern: str = fv.HANGUL_WORD) -> DataFrame:
    """``(keys, word, n, first)`` over ``titles(keys, published_at, id, title)``.

    ``first`` orders equal counts by first occurrence, as a running counter would. Titles are sorted once, and the words of
    all of them are only hashed.
    """
    ordered = titles if ORDER in titles.columns else in_order(titles.select(*keys, "published_at", "id", "title"))
    found = F.regexp_extract_all(F.coalesce("title", F.lit("")), F.lit(f"({pattern})"), F.lit(1))
    words = ordered.select(*keys, ORDER, F.posexplode(found).alias("pos", "word"))
    place = F.shiftleft(F.col(ORDER), POSITIONS) + F.col("pos")
    return words.groupBy(*keys, "word").agg(F.count(F.lit(1)).alias("n"), F.min(place).alias("first"))


def word_origins(counts: DataFrame, ordered: DataFrame) -> DataFrame:
    """``counts`` with the time and id of the title where each word came first; ``ordered`` is what they were counted on."""
    where = ordered.select(F.col(ORDER), F.col("published_at").alias("first_at"), F.col("id").alias("first_id"))
    return counts.withColumn(ORDER, F.shiftright("first", POSITIONS)).join(where, ORDER).drop(ORDER)


def top_words(counts: DataFrame, keys: Sequence[str], n: int, at_least: int = fv.MIN_WORD_COUNT) -> DataFrame:
    """The n most frequent words of each group that occur often enough, with rank.

    The rank is taken before the floor, which is the same: counts fall with rank.
    """
    ranked = top_n(counts, keys, [F.desc("n"), F.asc("first")], n, "word_rank")
    return ranked.where(F.col("n") >= at_least)


def classed_words(counts: DataFrame, keys: Sequence[str]) -> DataFrame:
    """``(keys, word_class, word, class_rank)`` of the most frequent words."""
    top = top_words(counts, keys, fv.CLASSED_WORDS).withColumn("word_class", classify_word(F.col("word")))
    classed = top.where(F.col("word_class").isNotNull())
    return top_n(classed, [*keys, "word_class"], [F.asc("word_rank")], fv.CLASSED_WORDS, "class_rank")


def keyword_classes(counts: DataFrame, keys: Sequence[str]) -> DataFrame:
    """One row per group with a word list per class (at most 20 words in all)."""
    classed = classed_words(counts, keys)
    lists = [
        F.transform(
            F.array_sort(F.collect_list(F.when(F.col("word_class") == c, F.struct("class_rank", "word")))),
            lambda w: w["word"],
        ).alias(c)
        for c in fv.WORD_CLASSES
    ]
    return classed.groupBy(*keys).agg(*lists)


def latest(df: DataFrame, ts: str, n: int, key: str = "id") -> DataFrame:
    """The n newest rows."""
    return df.orderBy(F.desc(ts), F.asc(key)).limit(n)


