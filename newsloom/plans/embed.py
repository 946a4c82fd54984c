"""Embedding of article leads: a pluggable batch model, or hashed TF-IDF when there is none."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.ml import Pipeline
from pyspark.ml.feature import IDF, PCA, HashingTF, Normalizer, RegexTokenizer
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from newsloom.functions import fixed_values as fv
from newsloom.functions.text import embedding_input

BatchModel = Callable[[list[str]], list[list[float]]]


def embed_with(df: DataFrame, text_column: str, model: BatchModel, batch_size: int = fv.EMBEDDING_BATCH) -> DataFrame:
    """``df`` with ``embedding`` from ``model``, which is given at most ``batch_size`` texts at a time."""

    @F.pandas_udf("array<float>")
    def score(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for texts in batches:
            vectors: list[list[float]] = []
            for at in range(0, len(texts), batch_size):
                vectors.extend(model(texts.iloc[at : at + batch_size].tolist()))
            yield pd.Series(vectors, index=texts.index)

    # Never evaluated twice: a model call is dear.
    return df.withColumn("embedding", score.asNondeterministic()(F.col(text_column)))


def embed_hashed(df: DataFrame, text_column: str, dimensions: int = 256) -> DataFrame:
    """``df`` with a deterministic unit vector: hashed term counts weighted by inverse document frequency."""
    words = RegexTokenizer(inputCol="__text", outputCol="__words", pattern=r"[\p{L}\p{N}_]{2,}", gaps=False)
    counts = HashingTF(inputCol="__words", outputCol="__tf", numFeatures=dimensions)
    weights = IDF(inputCol="__tf", outputCol="__tfidf")
    unit = Normalizer(inputCol="__tfidf", outputCol="__unit")
    prepared = df.withColumn("__text", F.coalesce(text_column, F.lit("")))
    fitted = Pipeline(stages=[words, counts, weights, unit]).fit(prepared.select("__text"))
    scored = fitted.transform(prepared)
    return scored.select(*df.columns, vector_to_array("__unit", "float32").alias("embedding"))


def embed_articles(articles: DataFrame, model: BatchModel | None = None) -> DataFrame:
    """``(id, embedding)`` of articles, from the lead or else the title."""
    inputs = articles.select("id", embedding_input(F.col("lead_paragraph"), F.col("title")).alias("text"))
    scored = embed_with(inputs, "text", model) if model else embed_hashed(inputs, "text")
    return scored.select("id", "embedding")


def reduce_dimensions(df: DataFrame, column: str = "embedding", k: int = fv.REDUCED_DIMENSIONS) -> DataFrame:
    """``df`` with ``reduced``: unit vectors projected on their first k principal components."""
    prepared = df.withColumn("__vector", array_to_vector(F.col(column)))
    unit = Normalizer(inputCol="__vector", outputCol="__unit").transform(prepared)
    projected = PCA(k=k, inputCol="__unit", outputCol="__reduced").fit(unit.select("__unit")).transform(unit)
    return projected.select(*df.columns, vector_to_array("__reduced").alias("reduced"))
