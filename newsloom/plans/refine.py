"""From clusters to events, merged groups and the best groups of each category. Members stay flat rows."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from newsloom.functions import fixed_values as fv
from newsloom.functions import text
from newsloom.functions.numbers import quality_score
from newsloom.functions.rules import first_pattern
from newsloom.operators.aggregates import bias_counts, top_words, word_counts
from newsloom.operators.generate import TextModel, generate, title_lists
from newsloom.operators.tables import union_all, with_bias
from newsloom.operators.windows import number_within, top_n
from newsloom.session import written

CLUSTER = ["category", "cluster_id"]
SEEDS, COMPANIONS = 6, 3
LEADERS = 64  # words of a cluster that are tried as companions first
PATTERN_PROMPT = (
    "Name 3 to 6 distinct political events in these %d headlines, each with a title of about 20 characters and "
    "3 or 4 keywords.\n\n%s\n\nAnswer as JSON: "
    '{"events": [{"event_id": "...", "title": "...", "keywords": ["..."], "description": "..."}]}'
)


# --- event patterns -------------------------------------------------------------------------

def _own_seeds() -> Column:
    """The positions of the ``seeds`` that stand in ``words``."""
    return F.transform(F.filter("seeds", lambda s: F.array_contains("words", s["word"])), lambda s: s["event_pos"])


def _together(pairs: DataFrame, seeds: DataFrame) -> DataFrame:
    """``(category, cluster_id, event_pos, word, n)`` over rows of a word and the seeds ``own`` of its title."""
    counts = pairs.groupBy(*CLUSTER, "own", "word").agg(F.count(F.lit(1)).alias("n"))
    return (
        counts.select(*CLUSTER, F.explode("own").alias("event_pos"), "word", "n")
        .join(seeds.select(*CLUSTER, "event_pos", F.col("word").alias("seed")), [*CLUSTER, "event_pos"])
        .where(F.col("word") != F.col("seed"))
        .groupBy(*CLUSTER, "event_pos", "word")
        .agg(F.sum("n").alias("n"))
    )


def frequent_word_patterns(
    members: DataFrame, word_pattern: str = fv.HANGUL_WORD, leaders: int = LEADERS
) -> DataFrame:
    """``(category, cluster_id, events)`` without a model.

    Seeds are the six words found in most of a cluster's titles; each brings the three words that share
    most titles with it. Titles are split into words once and are not dealt by cluster: a title meets its cluster's
    seeds as one short list, and only counts are shuffled.

    A word shares no more titles with a seed than hold it. So the cluster's ``leaders`` most frequent words are tried
    first, and then every word that is in at least as many titles as the third of them shares with a seed.
    """
    found = F.array_distinct(F.regexp_extract_all(F.coalesce("title", F.lit("")), F.lit(f"({word_pattern})"), F.lit(1)))
    titles = written(members.select(*CLUSTER, found.alias("words")), "title-words")
    words = titles.select(*CLUSTER, F.explode("words").alias("word"))
    counts = written(words.groupBy(*CLUSTER, "word").agg(F.count(F.lit(1)).alias("n")), "word-counts")
    order = [F.desc("n"), F.asc("word")]
    first = written(top_n(counts, CLUSTER, order, max(leaders, SEEDS), "event_pos"), "leaders")
    seeds = first.where(F.col("event_pos") <= SEEDS).drop("n")
    seed = F.when(F.col("event_pos") <= SEEDS, F.struct("event_pos", "word"))
    lists = first.groupBy(*CLUSTER).agg(F.collect_list(seed).alias("seeds"), F.collect_list("word").alias("leaders"))
    met = titles.join(written(lists, "leader-lists"), CLUSTER).select(*CLUSTER, "words", "leaders", _own_seeds().alias("own"))
    led = met.select(*CLUSTER, "own", F.explode(F.array_intersect("words", "leaders")).alias("word"))
    early = written(_together(led, seeds), "together")

    third = top_n(early, [*CLUSTER, "event_pos"], order, COMPANIONS, "r").where(F.col("r") == COMPANIONS)
    floors = (
        seeds.select(*CLUSTER, "event_pos")
        .join(third.select(*CLUSTER, "event_pos", F.col("n").alias("third")), [*CLUSTER, "event_pos"], "left")
        .groupBy(*CLUSTER)
        .agg(F.min(F.coalesce("third", F.lit(1))).alias("floor"))
    )
    others = (
        counts.join(written(floors, "floors"), CLUSTER)
        .where(F.col("n") >= F.col("floor"))
        .join(first, [*CLUSTER, "word"], "left_anti")
        .select(*CLUSTER, "word")
    )
    rest = met.select(*CLUSTER, "own", F.explode("words").alias("word")).join(written(others, "others"), [*CLUSTER, "word"])
    together = union_all(early, _together(rest, seeds))
    near = top_n(together, [*CLUSTER, "event_pos"], order, COMPANIONS, "r")
    companions = near.groupBy(*CLUSTER, "event_pos").agg(
        F.transform(F.array_sort(F.collect_list(F.struct("r", "word"))), lambda w: w["word"]).alias("companions")
    )
    events = seeds.join(companions, [*CLUSTER, "event_pos"], "left").select(
        *CLUSTER,
        F.struct(
            F.col("event_pos").cast("int").alias("event_pos"),
            F.concat(F.lit("event_"), "event_pos").alias("event_id"),
            F.col("word").alias("title"),
            F.concat(F.array("word"), F.coalesce("companions", F.array().cast("array<string>"))).alias("keywords"),
        ).alias("event"),
    )
    return events.groupBy(*CLUSTER).agg(F.array_sort(F.collect_list("event")).alias("events"))


def model_patterns(members: DataFrame, model: TextModel, titles: int = fv.PATTERN_TITLES) -> DataFrame:
    """``(category, cluster_id, events)`` from a model that is shown the first ``titles`` titles of each cluster.

    Clusters without a usable answer have no row.
    """
    lists = title_lists(members, CLUSTER, titles)
    prompts = lists.withColumn("prompt", F.format_string(PATTERN_PROMPT, F.col("n_titles"), F.col("titles_text")))
    answered = generate(prompts, "prompt", model).withColumn("raw", text.parse_events(F.col("answer")))
    events = F.transform(
        "raw",
        lambda e, i: F.struct(
            (i + 1).cast("int").alias("event_pos"),
            F.coalesce(e["event_id"], F.concat(F.lit("event_"), i)).alias("event_id"),
            F.coalesce(e["title"], F.lit(fv.DEFAULT_HEADLINE)).alias("title"),
            F.coalesce(e["keywords"], F.array().cast("array<string>")).alias("keywords"),
        ),
    )
    return answered.where(F.col("raw").isNotNull()).select(*CLUSTER, events.alias("events"))


def event_patterns(members: DataFrame, model: TextModel | None = None, word_pattern: str = fv.HANGUL_WORD) -> DataFrame:
    patterns = model_patterns(members, model) if model else frequent_word_patterns(members, word_pattern)
    return written(patterns, "patterns")  # one short row per cluster, read by every later step


# --- assignment and shaping -----------------------------------------------------------------

def best_event(title: Column, events: Column) -> Column:
    """The event with most keywords in the title, two at least; the earlier event wins a tie."""

    def best(low: Column) -> Column:
        scored = F.transform(
            events,
            lambda e: F.struct(
                F.size(F.filter(e["keywords"], lambda k: F.contains(low, F.lower(k)))).alias("score"),
                (-e["event_pos"]).alias("precedence"),
                e["event_id"].alias("event_id"),
                e["title"].alias("title"),
            ),
        )
        return F.array_max(F.filter(scored, lambda s: s["score"] >= fv.MIN_EVENT_KEYWORDS))

    return text.let(F.lower(F.coalesce(title, F.lit(""))), best)


def assign_events(members: DataFrame, patterns: DataFrame) -> DataFrame:
    """Members with ``event_pos, event_id, event_title, score`` (null when unmatched) and ``has_patterns``.

    Patterns are one short row per cluster: members stay where they are while Catalyst broadcasts these, and beyond that
    the adaptive join splits big clusters.
    """
    joined = members.join(patterns, CLUSTER, "left").withColumn("__e", best_event(F.col("title"), F.col("events")))
    return joined.select(
        *members.columns,
        F.col("events").isNotNull().alias("has_patterns"),
        (-F.col("__e.precedence")).alias("event_pos"),
        F.col("__e.event_id").alias("event_id"),
        F.col("__e.title").alias("event_title"),
        F.col("__e.score").alias("score"),
    )


def shape_groups(assigned: DataFrame, numbered: bool = True) -> DataFrame:
    """Members with ``group_id, event_type``: events of three or more stay, all others become singletons.

    Singletons are numbered in their cluster by time and id, over as many tasks as it takes; callers that
    read no labels of singletons leave the numbers out, and a singleton then has its article's id.
    """
    rows = written(assigned, "assigned")
    matched = rows.where(F.col("event_pos").isNotNull())
    counts = written(matched.groupBy(*CLUSTER, "event_pos").agg(F.count(F.lit(1)).alias("event_size")), "event-sizes")
    # Most rows have no event: they stay out of the join, where they would all be one key
    sized = union_all(matched.join(counts, [*CLUSTER, "event_pos"]), rows.where(F.col("event_pos").isNull()))
    stem = (
        F.when(~F.col("has_patterns"), "fallback")
        .when(F.col("event_pos").isNull(), "noise")
        .when(F.col("event_size") < fv.MIN_GROUP_ARTICLES, F.concat(F.lit("small_"), "event_id"))
    )
    kind = (
        F.when(F.col("stem").isNull(), F.col("event_id"))
        .when(F.startswith("stem", F.lit("small_")), "small_group")
        .otherwise(F.col("stem"))
    )
    marked = sized.withColumn("stem", stem).withColumn("event_type", kind).drop("event_size")
    kept = marked.where(F.col("stem").isNull()).withColumn("group_id", F.col("event_id"))
    single = marked.where(F.col("stem").isNotNull()).withColumn("event_title", F.lit(None).cast("string"))
    if numbered:
        order = [F.asc("published_at"), F.asc("id")]
        single = number_within(single, [*CLUSTER, "stem"], order, "n")
        alone = single.withColumn("group_id", F.concat("stem", F.lit("_"), F.col("n") - 1)).drop("n")
    else:
        alone = single.withColumn("group_id", F.concat("stem", F.lit("_"), "id"))
    return union_all(kept, alone).withColumn("single", F.col("stem").isNotNull()).drop("stem")


def add_headlines(
    groups: DataFrame, word_pattern: str = fv.HANGUL_WORD, headline_rules: Sequence[Mapping] | None = None
) -> DataFrame:
    """Members with ``group_title``: the event's title, a shortened title, or the two most frequent words."""
    named = ~text.is_blank(F.col("event_title"))
    key = [*CLUSTER, "group_id"]
    # Singletons and events with a title stay out of the join: they may be nearly all rows
    nameless = groups.where(~F.col("single") & ~named)
    words = top_words(word_counts(nameless.select(*key, "published_at", "id", "title"), key, word_pattern), key, 2)
    top = words.groupBy(*key).agg(
        F.transform(F.array_sort(F.collect_list(F.struct("word_rank", "word"))), lambda w: w["word"]).alias("top")
    )
    headline = (
        F.when(named, F.col("event_title"))
        .when(F.col("single"), text.single_title_headline(F.col("title"), headline_rules))
        .otherwise(text.group_headline(F.coalesce("top", F.array().cast("array<string>"))))
    )
    joined = union_all(nameless.join(written(top, "top-words"), key, "left"), groups.where(F.col("single") | named))
    return joined.withColumn("group_title", headline).drop("top")


def merge_singletons(groups: DataFrame, merge_rules: Sequence[Mapping] | None = None) -> DataFrame:
    """Singletons of a category whose headlines meet the same rule become one group, three at least."""
    merge_rules = text.load_rules("merge_rules") if merge_rules is None else merge_rules
    low = F.lower("group_title")
    pattern = F.when(F.col("single"), first_pattern(low, merge_rules, "pattern_id"))
    title = F.coalesce(*[F.when(F.col("pattern") == r["pattern_id"], F.lit(r["title"])) for r in merge_rules])
    marked = written(groups.withColumn("pattern", pattern), "titled")
    counts = marked.where(F.col("pattern").isNotNull()).groupBy("category", "pattern").agg(F.count(F.lit(1)).alias("hits"))
    hits = written(counts.where(F.col("hits") >= fv.MIN_GROUP_ARTICLES), "hits")
    # Nearly every row has no pattern: such rows stay out of the join, where a category would be one key
    met = marked.where(F.col("pattern").isNotNull()).join(hits, ["category", "pattern"], "left")
    joined = union_all(met, marked.where(F.col("pattern").isNull()))
    merged = F.col("hits").isNotNull()
    return joined.select(
        "category",
        F.when(~merged, F.col("cluster_id")).alias("cluster_id"),
        F.when(merged, F.concat(F.lit("merged_"), "pattern")).otherwise(F.col("group_id")).alias("group_id"),
        F.when(merged, "merged").otherwise(F.col("event_type")).alias("event_type"),
        F.when(merged, title).otherwise(F.col("group_title")).alias("group_title"),
        (F.col("single") & ~merged).alias("single"),
        F.when(~merged, F.col("event_pos")).alias("event_pos"),
        "id", "title", "media_id", "published_at",
    ).withColumn("group_key", F.concat_ws(":", "cluster_id", "group_id"))


def refine_groups(
    members: DataFrame,
    patterns: DataFrame,
    word_pattern: str = fv.HANGUL_WORD,
    headline_rules: Sequence[Mapping] | None = None,
    merge_rules: Sequence[Mapping] | None = None,
    numbered: bool = True,
) -> DataFrame:
    """All members with their final group; ``numbered`` as for ``shape_groups``."""
    shaped = shape_groups(assign_events(members, patterns), numbered)
    return merge_singletons(add_headlines(shaped, word_pattern, headline_rules), merge_rules)


def rank_groups(
    groups: DataFrame, outlets: DataFrame, bonus_event_types: Sequence[str] = (), n: int = fv.TOP_GROUPS
) -> DataFrame:
    """The n best groups of each category with bias counts and quality.

    A singleton can never reach the quality floor, so singletons are left out before anything is shuffled.
    """
    tagged = with_bias(groups.where(~F.col("single")), outlets, "left")
    counted = tagged.groupBy("category", "group_key").agg(
        *bias_counts(),
        F.first("group_title").alias("title"),
        F.first("event_type").alias("event_type"),
        F.first("group_id").alias("group_id"),
        F.min("cluster_id").alias("cluster_id"),
        F.min("event_pos").alias("event_pos"),
    )
    scored = counted.withColumn("quality", quality_score(F.col("total"), F.col("event_type"), bonus_event_types))
    order = [F.desc("quality"), F.asc_nulls_last("cluster_id"), F.asc_nulls_last("event_pos"), F.asc("group_key")]
    return top_n(scored.where(F.col("quality") > 0), ["category"], order, n)
