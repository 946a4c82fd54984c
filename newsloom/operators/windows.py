"""Top-n per group and exact numbering within groups, neither of which needs a group in one task."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from newsloom.session import cut_lineage, written


def top_n(df: DataFrame, keys: Sequence[str], order: Sequence[Column], n: int, rank: str = "rank") -> DataFrame:
    """First ``n`` rows of every group, with their rank.

    ``row_number() <= n`` makes Catalyst place a group limit before the shuffle, so at most ``n`` rows
    per group leave each map task however large the group is.
    """
    spec = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn(rank, F.row_number().over(spec)).where(F.col(rank) <= n)


def keep_first(df: DataFrame, keys: Sequence[str], order: Sequence[Column]) -> DataFrame:
    """One row per key: the first in the given order."""
    return top_n(df, keys, order, 1, "__first").drop("__first")


def number_within(df: DataFrame, keys: Sequence[str], order: Sequence[Column], name: str) -> DataFrame:
    """Exact ``row_number`` within each group, for groups of any size.

    Rows are range-partitioned by (keys, order), so a big group spreads over many tasks; a row's number
    is its offset in its partition plus the group's count in earlier partitions. Offsets are one row per group and
    partition; while they are few Catalyst broadcasts them, and the rows are not shuffled again.
    """
    sort = [F.col(k).asc() for k in keys] + list(order)
    placed = cut_lineage(
        df.repartitionByRange(*sort).sortWithinPartitions(*sort).withColumn("__at", F.monotonically_increasing_id())
    )
    part = F.shiftright(F.col("__at"), 33)
    runs = placed.groupBy(*keys, part.alias("__part")).agg(
        F.min("__at").alias("__start"), F.count(F.lit(1)).alias("__n")
    )
    earlier = Window.partitionBy(*keys).orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)
    before = runs.select(
        *[F.col(k).alias(f"__k{i}") for i, k in enumerate(keys)],
        "__part",
        "__start",
        F.coalesce(F.sum("__n").over(earlier), F.lit(0)).alias("__before"),
    )
    offsets = written(before, "offsets")
    same_run = F.col("__part") == part
    for i, k in enumerate(keys):
        same_run = same_run & F.col(k).eqNullSafe(F.col(f"__k{i}"))
    numbered = placed.join(offsets, same_run).withColumn(name, F.col("__at") - F.col("__start") + F.col("__before") + 1)
    return numbered.select(*df.columns, name)
