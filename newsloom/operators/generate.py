"""Model inputs and batch generation with a pluggable model."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence
from itertools import groupby

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from newsloom.functions import fixed_values as fv
from newsloom.operators.representatives import remaining, representatives, with_bodies
from newsloom.operators.tables import union_all
from newsloom.operators.windows import number_within, top_n

TextModel = Callable[[list[str]], list[str | None]]
PieceModel = Callable[[Iterator[str]], str | None]  # reads one prompt piece by piece
BATCH = 16
TITLES_PER_PART = 2_000


def generate(df: DataFrame, prompt: str, model: TextModel | None, fallback: str | None = None, answer: str = "answer",
             batch_size: int = BATCH) -> DataFrame:
    """``df`` with the model's answer; a failed or missing answer gives the fallback.

    Null prompts are not sent, and no plan sends a prompt twice. A failing batch is retried text by text, so one bad text spoils no other.
    """
    spare = F.col(fallback) if fallback else F.lit(None).cast("string")
    if model is None:
        return df.withColumn(answer, spare)

    def ask(texts: list[str]) -> list[str | None]:
        try:
            return list(model(texts))
        except Exception:  # noqa: BLE001 - whatever the model raises means "no answer"
            return [None] if len(texts) == 1 else [ask([t])[0] for t in texts]

    @F.pandas_udf("string")
    def answers(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for texts in batches:
            out: list[str | None] = [None] * len(texts)
            sent = [i for i, t in enumerate(texts) if t is not None]
            for at in range(0, len(sent), batch_size):
                some = sent[at : at + batch_size]
                for i, text in zip(some, ask([texts.iloc[i] for i in some]), strict=True):
                    out[i] = text
            yield pd.Series(out, index=texts.index, dtype=object)

    return df.withColumn(answer, F.coalesce(answers.asNondeterministic()(F.col(prompt)), spare))


def generate_from_pieces(pieces: DataFrame, keys: Sequence[str], order: str, piece: str, model: PieceModel) -> DataFrame:
    """``(keys, answer)``: a model's answer to the prompt that the pieces of each group make up, joined in their order.

    The answer to a whole prompt needs one reader of all of it, so a group's pieces pass through one task, but one by one:
    the task holds a batch of pieces and never a prompt. A model that fails gives a null answer.
    """
    keys = list(keys)
    n = len(keys)

    def read(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        rows = (row for batch in batches for row in batch.itertuples(index=False, name=None))
        for key, group in groupby(rows, key=lambda row: row[:n]):
            try:
                answer = model(row[n] for row in group)
            except Exception:  # noqa: BLE001 - whatever the model raises means "no answer"
                answer = None
            yield pd.DataFrame([(*key, answer)], columns=[*keys, "answer"], dtype=object)

    types = dict(pieces.dtypes)
    placed = pieces.repartition(*keys).sortWithinPartitions(*keys, order).select(*keys, piece)
    return placed.mapInPandas(read, ", ".join([*[f"{k} {types[k]}" for k in keys], "answer string"]))


def numbered_lines(rows: Column) -> Column:
    """``1. title`` lines of an ``array<struct<rank, title>>``."""
    lines = F.transform(F.array_sort(rows), lambda r: F.concat(r["rank"].cast("string"), F.lit(". "), r["title"]))
    return F.array_join(lines, "\n")


def title_lists(titles: DataFrame, keys: Sequence[str], n: int) -> DataFrame:
    """``(keys, titles_text, n_titles)``: the first n filled titles of each group as a numbered list."""
    filled = titles.where(F.coalesce("title", F.lit("")) != "").select(*keys, "published_at", "id", "title")
    first = top_n(filled, keys, [F.asc("published_at"), F.asc("id")], n)
    return first.groupBy(*keys).agg(
        numbered_lines(F.collect_list(F.struct("rank", "title"))).alias("titles_text"),
        F.count(F.lit(1)).alias("n_titles"),
    )


def article_blocks(chosen: DataFrame, keys: Sequence[str], titled: bool) -> DataFrame:
    """``(keys, blocks_text, n_blocks)``: bodies of a few ranked articles, the first 1000 characters of each."""
    body = F.substring(F.coalesce("content", F.lit("")), 1, fv.CONTEXT_CHARS)
    text = (
        F.format_string(fv.TITLED_ARTICLE_BLOCK, F.col("rank"), F.col("title"), body)
        if titled
        else F.format_string(fv.ARTICLE_BLOCK, F.col("rank"), body)
    )
    ranked = chosen.select(*keys, "rank", text.alias("text"))
    blocks = F.transform(F.array_sort(F.collect_list(F.struct("rank", "text"))), lambda b: b["text"])
    return ranked.groupBy(*keys).agg(F.array_join(blocks, "").alias("blocks_text"), F.count(F.lit(1)).alias("n_blocks"))


def pack_context(articles: DataFrame, keys: Sequence[str], titles_per_part: int = TITLES_PER_PART) -> DataFrame:
    """``(keys, n_articles, part, text)``: the context of each group, whole, in parts of bounded size.

    Up to five articles: all bodies. More: three representatives, then every other title, numbered.
    The parts of a group joined in order are its context; groups of ordinary size have one part.
    """
    keys = list(keys)
    slim = articles.drop("content")
    counts = slim.groupBy(*keys).agg(F.count(F.lit(1)).alias("n_articles"))
    small = counts.where(F.col("n_articles") <= fv.FULL_CONTEXT_ARTICLES)
    large = counts.where(F.col("n_articles") > fv.FULL_CONTEXT_ARTICLES)

    order = [F.asc("published_at"), F.asc("id")]
    few = top_n(slim.join(small, keys, "left_semi"), keys, order, fv.FULL_CONTEXT_ARTICLES)
    whole = article_blocks(with_bodies(few, articles, keys), keys, titled=True).select(*keys, F.lit(0).alias("part"), F.col("blocks_text").alias("text"))

    many = slim.join(large, keys, "left_semi")
    chosen = representatives(many, keys)
    head = article_blocks(with_bodies(chosen, articles, keys), keys, titled=True).select(*keys, F.col("blocks_text").alias("head"))
    others = remaining(many.select(*keys, "id", "title", "published_at"), chosen, keys)
    numbered = number_within(others, keys, order, "rank")
    sliced = numbered.withColumn("part", F.floor((F.col("rank") - 1) / titles_per_part).cast("int"))
    lines = sliced.groupBy(*keys, "part").agg(numbered_lines(F.collect_list(F.struct("rank", "title"))).alias("lines"))
    opening = F.concat(F.lit(fv.REPRESENTATIVE_HEADER), F.coalesce("head", F.lit("")), F.lit(fv.OTHER_TITLES_HEADER))
    parts = lines.join(head, keys, "left").select(
        *keys, "part", F.concat(F.when(F.col("part") == 0, opening).otherwise(F.lit("")), "lines", F.lit("\n")).alias("text")
    )
    return union_all(whole, parts).join(counts, keys)
