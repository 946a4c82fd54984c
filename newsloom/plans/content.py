"""Titles, summaries and left/right perspectives of issues, for all issues at once."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from newsloom.functions import fixed_values as fv
from newsloom.functions import text
from newsloom.operators.aggregates import keyword_classes, word_counts
from newsloom.operators.generate import (
    PieceModel,
    TextModel,
    article_blocks,
    generate,
    generate_from_pieces,
    pack_context,
    title_lists,
)
from newsloom.operators.representatives import representatives, with_bodies
from newsloom.operators.tables import with_bias
from newsloom.session import cut_lineage

SIDES = ["left", "right"]
FOLD = 20
PIECE_TITLES = 100  # titles of a piece, for models that read a prompt in pieces
TITLE_PROMPT = "Write one headline of at most 30 characters for these stories.\n\n%s\n\nKeywords:\n%s\nHeadline only:"
SUMMARY_PROMPT = "Summarise the issue behind these stories evenly and neutrally in about 300 characters.\n\n%s\nSummary only:"
PERSPECTIVE_PROMPT = (
    "Describe in about 300 characters how these %s outlets frame the issue: problem, cause, emphasis, key words, remedy."
    "\n\n%s\nPerspective only:"
)
FOLD_PROMPT = "Merge these partial descriptions of one view into one of about 300 characters.\n\n%s\nResult only:"


def answer_text(answer: Column, rule: tuple[int, int, str]) -> Column:
    """A model answer stripped, unquoted and cut to length."""
    return text.truncate(text.strip_quotes(text.py_strip(answer)), rule)


# --- titles ---------------------------------------------------------------------------------

def title_prompts(articles: DataFrame, word_pattern: str = fv.HANGUL_WORD) -> DataFrame:
    """``(issue_id, prompt, fallback)`` of every issue that has articles."""
    key = ["issue_id"]
    titles = articles.where(F.col("issue_id").isNotNull()).select("issue_id", "published_at", "id", "title")
    filled = titles.where(~text.is_blank(F.col("title")))
    classes = keyword_classes(word_counts(filled, key, word_pattern), key)
    lists = title_lists(filled, key, fv.PROMPT_TITLES)
    joined = titles.select("issue_id").distinct().join(lists, key, "left").join(classes, key, "left")

    def words(name: str) -> Column:
        return F.coalesce(F.col(name), F.array().cast("array<string>"))

    block = F.format_string(fv.KEYWORD_BLOCK, *[F.array_join(F.slice(words(c), 1, 3), ", ") for c in fv.WORD_CLASSES])
    fallback = text.template_title(*[F.get(words(c), F.lit(0)) for c in ("person", "event", "reaction")])
    has_titles = F.col("titles_text").isNotNull()
    return joined.select(
        "issue_id",
        F.when(has_titles, F.format_string(TITLE_PROMPT, F.col("titles_text"), block)).alias("prompt"),
        F.when(has_titles, fallback).otherwise(F.lit(fv.DEFAULT_HEADLINE)).alias("fallback"),
    )


def issue_titles(articles: DataFrame, model: TextModel | None = None, word_pattern: str = fv.HANGUL_WORD) -> DataFrame:
    """``(id, title)`` of every issue that has articles."""
    prompts = title_prompts(articles, word_pattern)
    answered = generate(prompts, "prompt", model)
    title = F.coalesce(answer_text(F.col("answer"), fv.ISSUE_TITLE), F.col("fallback"))
    return answered.select(F.col("issue_id").alias("id"), title.alias("title"))


# --- summaries ------------------------------------------------------------------------------

def summary_prompts(articles: DataFrame) -> DataFrame:
    """``(issue_id, prompt, fallback)`` from the representatives of every issue."""
    usable = articles.where(F.col("issue_id").isNotNull() & F.col("content").isNotNull()).select(
        "issue_id", "id", "title", "content", "embedding", "published_at"
    )
    chosen = with_bodies(representatives(usable.drop("content"), ["issue_id"]), usable, ["issue_id"])
    blocks = article_blocks(chosen, ["issue_id"], titled=False)
    titled = chosen.groupBy("issue_id").agg(F.count_if(~text.is_blank(F.col("title"))).alias("n_titled"))
    fallback = F.when(F.col("n_titled") > 0, F.format_string(fv.FALLBACK_SUMMARY, F.col("n_blocks"))).otherwise(
        F.lit(fv.NO_TITLES_SUMMARY)
    )
    return blocks.join(titled, "issue_id").select(
        "issue_id", F.format_string(SUMMARY_PROMPT, F.col("blocks_text")).alias("prompt"), fallback.alias("fallback")
    )


def issue_summaries(articles: DataFrame, model: TextModel | None = None) -> DataFrame:
    """``(id, issue_summary)`` of every issue with usable articles."""
    answered = generate(summary_prompts(articles), "prompt", model)
    summary = F.coalesce(answer_text(F.col("answer"), fv.LONG_TEXT), F.col("fallback"))
    return answered.select(F.col("issue_id").alias("id"), summary.alias("issue_summary"))


# --- perspectives ---------------------------------------------------------------------------

def perspective_contexts(articles: DataFrame, outlets: DataFrame, titles_per_part: int | None = None) -> DataFrame:
    """``(issue_id, bias, n_articles, part, text)`` for the left and the right side of every issue."""
    usable = articles.where(F.col("issue_id").isNotNull() & F.col("content").isNotNull())
    tagged = with_bias(usable, outlets.where(F.col("bias").isin(*SIDES)))
    rows = tagged.select("issue_id", "bias", "id", "title", "content", "embedding", "published_at")
    size = {"titles_per_part": titles_per_part} if titles_per_part else {}
    return pack_context(rows, ["issue_id", "bias"], **size)


def _fold(answers: DataFrame, model: TextModel) -> DataFrame:
    """Merge the answers to the parts of a context, twenty at a time, until one is left per side.

    A part without an answer, or a merge without one, leaves its side without an answer: what is left would
    describe a part of the side only. ``failed_parts`` counts them.
    """
    current = cut_lineage(answers.withColumn("failed_parts", F.col("answer").isNull().cast("long")))
    while (current.agg(F.max("part")).first()[0] or 0) > 0:
        gathered = current.groupBy("issue_id", "bias", F.floor(F.col("part") / FOLD).cast("int").alias("up")).agg(
            F.array_sort(F.collect_list(F.struct("part", "answer"))).alias("some"),
            F.sum("failed_parts").alias("failed"),
        )
        listed = F.array_join(F.transform("some", lambda s: s["answer"]), "\n\n")
        prompts = gathered.select(
            "issue_id", "bias", F.col("up").alias("part"), "failed",
            F.when((F.size("some") > 1) & (F.col("failed") == 0), F.format_string(FOLD_PROMPT, listed)).alias("prompt"),
            F.when(F.size("some") == 1, F.get("some", F.lit(0))["answer"]).alias("only"),
        )
        told = generate(prompts, "prompt", model).withColumn("answer", F.coalesce("only", "answer"))
        lost = F.when((F.col("failed") == 0) & F.col("answer").isNull(), 1).otherwise(F.col("failed"))
        current = cut_lineage(told.select("issue_id", "bias", "part", "answer", lost.alias("failed_parts")))
    return current.select("issue_id", "bias", F.when(F.col("failed_parts") == 0, F.col("answer")).alias("answer"), "failed_parts")


def _whole_answers(contexts: DataFrame, reader: PieceModel) -> DataFrame:
    """One answer per side to its whole prompt, whatever its length: the reader gets it in pieces, in order."""
    opening, middle, closing = PERSPECTIVE_PROMPT.split("%s")
    start = F.when(F.col("part") == 0, F.concat(F.lit(opening), "bias", F.lit(middle))).otherwise(F.lit(""))
    pieces = contexts.select("issue_id", "bias", "part", F.concat(start, "text").alias("piece"))
    last = contexts.groupBy("issue_id", "bias").agg((F.max("part") + 1).alias("part")).withColumn("piece", F.lit(closing))
    answers = generate_from_pieces(pieces.unionByName(last), ["issue_id", "bias"], "part", "piece", reader)
    return answers.withColumn("failed_parts", F.col("answer").isNull().cast("long"))


def issue_perspectives(
    issues: DataFrame, articles: DataFrame, outlets: DataFrame, model: TextModel | None = None,
    titles_per_part: int | None = None, reader: PieceModel | None = None,
) -> DataFrame:
    """``(id, left_perspective, right_perspective, left_failed_parts, right_failed_parts)`` of every issue.

    Sides with few articles get a set text; sides of which a part failed get the fallback text, and a count.
    A ``model`` answers the parts of a long context, and its answers are merged; a ``reader`` takes any context as one prompt.
    """
    if reader is not None:
        titles_per_part = titles_per_part or PIECE_TITLES
    contexts = perspective_contexts(articles, outlets, titles_per_part)
    enough = contexts.where(F.col("n_articles") >= fv.MIN_PERSPECTIVE_ARTICLES)
    if reader is not None:
        answers = _whole_answers(cut_lineage(enough), reader)
    elif model is None:
        answers = enough.select("issue_id", "bias").distinct().withColumn("answer", F.lit(None).cast("string"))
        answers = answers.withColumn("failed_parts", F.lit(0).cast("long"))
    else:
        prompts = enough.withColumn("prompt", F.format_string(PERSPECTIVE_PROMPT, F.col("bias"), F.col("text")))
        answers = _fold(generate(prompts, "prompt", model).select("issue_id", "bias", "part", "answer"), model)
    failed = F.when(F.col("bias") == "left", fv.FALLBACK_PERSPECTIVE["left"]).otherwise(fv.FALLBACK_PERSPECTIVE["right"])
    texts = answers.select(
        "issue_id", "bias", "failed_parts",
        F.coalesce(answer_text(F.col("answer"), fv.LONG_TEXT), failed).alias("perspective"),
    )
    sides = texts.groupBy("issue_id").agg(
        *[F.max(F.when(F.col("bias") == s, F.col("perspective"))).alias(f"{s}_perspective") for s in SIDES],
        *[F.max(F.when(F.col("bias") == s, F.col("failed_parts"))).alias(f"{s}_failed_parts") for s in SIDES],
    )
    return issues.select("id").join(sides, F.col("id") == F.col("issue_id"), "left").select(
        "id",
        *[F.coalesce(f"{s}_perspective", F.lit(fv.TOO_FEW_PERSPECTIVE[s])).alias(f"{s}_perspective") for s in SIDES],
        *[F.coalesce(f"{s}_failed_parts", F.lit(0)).alias(f"{s}_failed_parts") for s in SIDES],
    )
