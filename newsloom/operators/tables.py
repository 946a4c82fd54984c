"""Joins, set operations and keyed rewrites of article tables."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from newsloom.functions import fixed_values as fv
from newsloom.functions.text import is_blank, py_strip
from newsloom.operators.windows import keep_first


# --- filters --------------------------------------------------------------------------------

def recent(df: DataFrame, ts: str, as_of: Column, days: int = fv.RECENT_DAYS) -> DataFrame:
    return df.where(F.col(ts) >= as_of - F.make_interval(days=F.lit(days)))


def long_enough(content: Column, floor: int = fv.MIN_BODY_CHARS) -> Column:
    return F.length(py_strip(F.coalesce(content, F.lit("")))) >= floor


def title_long_enough(title: Column, floor: int = fv.MIN_TITLE_CHARS) -> Column:
    return F.length(title) > floor


def filled(*columns: Column) -> Column:
    return reduce(lambda a, b: a & b, [~is_blank(c) for c in columns])


def skipped(title: Column, content: Column) -> Column:
    """Editorial skip rules: broadcasts, house notices, one column series."""
    starts = [F.startswith(F.coalesce(content, F.lit("")), F.lit(p)) for p in fv.SKIP_BODY_PREFIXES]
    ends = [F.endswith(F.coalesce(title, F.lit("")), F.lit(s)) for s in fv.SKIP_TITLE_SUFFIXES]
    return reduce(lambda a, b: a | b, starts + ends)


LINK_RULES = {  # Fixed values: what a listed link must look like, per site.
    "donga": {"contains": ["/news/", "/article/"], "section": "정치"},
    "segye": {"contains": ["newsView"]},
    "munhwa": {"starts": ["/article/"]},
}


def link_allowed(source: Column, href: Column, section: Column | None = None) -> Column:
    """Whether a listed link belongs to the wanted section; sites without a rule accept every link."""
    allowed = F.lit(True)
    for name, rule in LINK_RULES.items():
        tests = [F.contains(href, F.lit(t)) for t in rule.get("contains", [])]
        tests += [F.startswith(href, F.lit(t)) for t in rule.get("starts", [])]
        if "section" in rule and section is not None:
            tests.append(F.coalesce(section == rule["section"], F.lit(False)))
        allowed = F.when(source == name, reduce(lambda a, b: a & b, tests)).otherwise(allowed)
    return allowed


def split_bodies(df: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Rows with a body, and rejected rows with the reason."""
    missing = is_blank(F.col("content"))
    return df.where(~missing), df.where(missing).withColumn("reason", F.lit(fv.NO_BODY_REASON))


def populous(df: DataFrame, key: str, floor: int = fv.MIN_CATEGORY_ARTICLES) -> DataFrame:
    """Rows of groups with at least ``floor`` rows; counts are partial on the map side, groups stay spread."""
    big = df.groupBy(key).agg(F.count(F.lit(1)).alias("__n")).where(F.col("__n") >= floor).select(key)
    return df.join(big, key, "left_semi")


# --- joins ----------------------------------------------------------------------------------

def not_stored(new: DataFrame, stored: DataFrame, keys: Sequence[str] = ("media_id", "url")) -> DataFrame:
    """Rows whose key is not stored yet. Null keys always count as new."""
    return new.join(stored.select(*keys), list(keys), "left_anti")


def with_bias(articles: DataFrame, outlets: DataFrame, how: str = "inner") -> DataFrame:
    """Articles with their outlet's bias. The outlet table is broadcast by Catalyst while its size allows it."""
    dim = outlets.select(F.col("id").alias("__outlet"), "bias")
    return articles.join(dim, F.col("media_id") == F.col("__outlet"), how).drop("__outlet")


def articles_of_bias(articles: DataFrame, outlets: DataFrame, bias: str) -> DataFrame:
    return with_bias(articles.where(F.col("content").isNotNull()), outlets.where(F.col("bias") == bias))


# --- set operations -------------------------------------------------------------------------

def union_all(*dfs: DataFrame) -> DataFrame:
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), dfs)


# --- keyed rewrites -------------------------------------------------------------------------

def keyed_update(table: DataFrame, updates: DataFrame, key: str = "id") -> DataFrame:
    """``table`` with the non-null columns of ``updates`` written over the rows of the same key."""
    changed = [c for c in updates.columns if c != key]
    new = updates.select(F.col(key).alias("__key"), *[F.col(c).alias(f"__new_{c}") for c in changed])
    joined = table.join(new, F.col(key) == F.col("__key"), "left")
    return joined.select(
        *[
            F.coalesce(F.col(f"__new_{c}"), F.col(c)).alias(c) if c in changed else F.col(c)
            for c in table.columns
        ]
    )


def changed_rows(table: DataFrame, updates: DataFrame, column: str, key: str = "id") -> DataFrame:
    """Rows of ``updates`` whose value differs from the stored one: ``(key, old, new)``."""
    old = table.select(key, F.col(column).alias("old_value"))
    new = updates.select(key, F.col(column).alias("new_value"))
    return old.join(new, key).where(~F.col("old_value").eqNullSafe(F.col("new_value")))


def saved_ratio(requested: DataFrame, saved: DataFrame, key: str = "id") -> DataFrame:
    """One row ``(requested, saved, ratio, passed)``."""
    marks = requested.select(key).join(saved.select(key, F.lit(1).alias("__saved")), key, "left")
    counts = marks.agg(F.count(F.lit(1)).alias("requested"), F.count("__saved").alias("saved"))
    ratio = F.coalesce(F.try_divide(F.col("saved").cast("double"), F.col("requested")), F.lit(0.0))
    return counts.withColumn("ratio", ratio).withColumn("passed", F.col("ratio") >= fv.SAVE_SUCCESS_FLOOR)


def upsert(stored: DataFrame, incoming: DataFrame, key: str, version: str) -> DataFrame:
    """``stored``, a row per key, with the newer versions of ``incoming``; rows without a key are all kept.

    Of equal versions the one with the greater other columns, in alphabetical order, wins. Only stored rows whose
    key comes in are compared: the incoming side is reduced to a row per key, and while it is small Catalyst
    broadcasts it, so that stored rows stay where they are.
    """
    columns = list(dict.fromkeys([*stored.columns, *incoming.columns]))
    order = [F.desc(version), *[F.desc(c) for c in sorted(columns) if c not in (key, version)]]
    keyed = F.col(key).isNotNull()
    latest = keep_first(union_all(stored.limit(0), incoming.where(keyed)), [key], order)
    touched = stored.join(latest.select(key), key, "left_semi")
    newest = keep_first(union_all(touched, latest), [key], order)
    kept = stored.join(latest.select(key), key, "left_anti")  # rows without a key match nothing
    return union_all(kept, newest, incoming.where(~keyed)).select(*columns)
