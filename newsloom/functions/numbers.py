"""Numeric functions: shares, rates, quality scores, vector arithmetic, JSON vectors."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.stat import Summarizer
from pyspark.sql import Column
from pyspark.sql import functions as F

from newsloom.functions import fixed_values as fv


def percent(part: Column, total: Column) -> Column:
    """Share in percent; null for an empty total."""
    return F.try_divide(part * F.lit(100.0), total)


def percent_label(share: Column) -> Column:
    """Rounded half to even, shown above the floor only."""
    rounded = F.bround(share, 0).cast("int").cast("string")
    return F.when(share > fv.LABEL_FLOOR_PCT, F.concat(rounded, F.lit("%")))


def quality_score(
    articles: Column, event_type: Column, bonus_event_types: Sequence[str] = ()
) -> Column:
    listed = event_type.isin(*bonus_event_types) if bonus_event_types else F.lit(False)
    bonus = F.when(listed, fv.EVENT_BONUS).when(event_type == "merged", fv.MERGED_BONUS).otherwise(0)
    return F.when(articles < fv.MIN_QUALITY_ARTICLES, F.lit(0).cast("long")).otherwise((articles + bonus).cast("long"))


def dot(a: Column, b: Column) -> Column:
    products = F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double"))
    return F.aggregate(products, F.lit(0.0), lambda total, x: total + x)


def norm(a: Column) -> Column:
    return F.sqrt(F.aggregate(a, F.lit(0.0), lambda total, x: total + x.cast("double") * x.cast("double")))


def cosine(a: Column, b: Column) -> Column:
    """Cosine similarity; 0 for a zero vector."""
    return F.coalesce(F.try_divide(dot(a, b), norm(a) * norm(b)), F.lit(0.0))


def mean_vector(embedding: Column) -> Column:
    """Aggregate: element-wise mean, kept as a partial sum on the map side."""
    return vector_to_array(Summarizer.mean(array_to_vector(embedding)))


def vector_from_json(text: Column) -> Column:
    """Vector of a JSON list; null when the text is no list of numbers."""
    return F.from_json(text, "array<double>", {"mode": "PERMISSIVE"})


def valid_vector(vector: Column) -> Column:
    return F.coalesce(F.size(vector) > 0, F.lit(False))
