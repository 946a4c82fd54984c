"""Writers. Appends are plain; keyed rewrites stage and then replace the partitions they touch."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from newsloom import schemas
from newsloom.functions import fixed_values as fv
from newsloom.operators.tables import changed_rows, keyed_update, saved_ratio
from newsloom.operators.windows import keep_first
from newsloom.session import cut_lineage
from newsloom.sources.keyed_table import KeyedTable


def new_outlets(batch: DataFrame, outlets: DataFrame, bias: str = fv.DEFAULT_BIAS) -> DataFrame:
    """Rows to append for outlets named in a batch but unknown so far."""
    seen = batch.select(F.col("media_name").alias("name")).where(F.col("name").isNotNull()).distinct()
    fresh = seen.join(outlets.select("name"), "name", "left_anti")
    return fresh.select(
        F.sha2(F.col("name"), 256).alias("id"), "name", F.lit(bias).alias("bias"), F.lit("").alias("website")
    )


def append(df: DataFrame, path: str, table: str | None = None, by: str | None = None) -> None:
    rows = schemas.conform(df, table) if table else df
    writer = rows.write.mode("append")
    (writer.partitionBy(by) if by else writer).parquet(path)


def _partition_is(by: str, values: list) -> Column:
    known = F.col(by).isin([v for v in values if v is not None])
    return known | F.col(by).isNull() if None in values else known


def rewrite_rows(path: str, updates: DataFrame, by: str, key: str = "id", schema: str | None = None) -> None:
    """Writes the non-null columns of ``updates`` over the stored rows of the same key.

    Partitions that hold such a key, and those that a row moves to, are read and written again; a partition that all rows
    leave is deleted. Of a key that comes several times the row with the greater other columns counts. New contents are
    staged first, so nothing reads the path while it is written. Spark swaps in each partition as a whole, but one after
    another: readers may see some new and some old ones meanwhile, and a run that was cut off is repeated, which keeps one row
    of every key that it writes. ``KeyedTable`` publishes all of a merge at once.
    """
    spark = updates.sparkSession
    table = (spark.read.schema(schema) if schema else spark.read).parquet(path)
    rest = [F.desc(c) for c in sorted(updates.columns) if c != key]
    updates = cut_lineage(keep_first(updates.where(F.col(key).isNotNull()), [key], rest))
    hit = table.select(key, by).join(updates.select(key, *([F.col(by).alias("__to")] if by in updates.columns else [])), key)
    ends = [F.col(by), F.coalesce("__to", by)] if by in updates.columns else [F.col(by)]
    # one row for each partition
    touched = [r["v"] for r in hit.select(F.explode(F.array(*ends)).alias("v")).distinct().collect()]
    if not touched:
        return
    old = table.where(_partition_is(by, touched))
    others = old.join(updates.select(key), key, "left_anti").select(*table.columns)
    changed = keyed_update(old.join(updates.select(key), key, "left_semi").select(*table.columns), updates, key)
    changed = keep_first(changed, [key], [F.desc(c) for c, kind in changed.dtypes if c != key and not kind.startswith("map")])
    staged = cut_lineage(others.unionByName(changed))
    writer = staged.write.mode("overwrite").option("partitionOverwriteMode", "dynamic")
    writer.partitionBy(by).parquet(path)
    filled = {r[by] for r in staged.select(by).distinct().collect()}
    names = spark.sparkContext._jvm.org.apache.spark.sql.catalyst.catalog.ExternalCatalogUtils
    root = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    files = root.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    for value in set(touched) - filled:
        name = names.getPartitionPathString(by, None if value is None else str(value))
        files.delete(spark.sparkContext._jvm.org.apache.hadoop.fs.Path(root, name), True)


def apply_preprocessed(articles: DataFrame, cleaned: DataFrame, now: Column) -> DataFrame:
    """Stored articles with cleaned columns, flag and time written over."""
    updates = cleaned.select(
        "id", "title", "content", "lead_paragraph", "political_category",
        F.lit(True).alias("is_preprocessed"), now.alias("preprocessed_at"),
    )
    return keyed_update(articles, updates)


def apply_embeddings(articles: DataFrame, embeddings: DataFrame) -> DataFrame:
    return keyed_update(articles, embeddings.select("id", "embedding"))


def write_embeddings(articles: KeyedTable, embeddings: DataFrame) -> float:
    """Writes vectors over stored articles and reads back which are there; raises below the floor of saved rows."""
    articles.update(embeddings.select("id", "embedding"))
    saved = articles.rows().where(F.col("embedding").isNotNull())
    return require_saved(embeddings, saved.join(embeddings.select("id").distinct(), "id", "left_semi"))


def write_issue_ids(articles: KeyedTable, bridge: DataFrame) -> None:
    """Writes the issue of each member article; other articles keep theirs."""
    articles.update(bridge.select(F.col("article_id").alias("id"), "issue_id"))


def write_titles(issues: KeyedTable, titles: DataFrame) -> None:
    """Writes titles that differ from the stored ones; where none does, nothing is written."""
    changed = changed_titles(issues.rows(), titles).select("id", F.col("new_value").alias("title"))
    if not changed.isEmpty():
        issues.update(changed)


def require_saved(requested: DataFrame, saved: DataFrame, key: str = "id") -> float:
    """Share of requested rows that were saved; raises below the floor."""
    row = saved_ratio(requested, saved, key).first()
    if not row["passed"]:
        raise RuntimeError(f"only {row['saved']} of {row['requested']} rows saved")
    return row["ratio"]


def issue_rows(groups: DataFrame, run_id: str, created_at: Column) -> DataFrame:
    """Issues of the chosen groups; ids follow from content, so a rerun writes the same ids."""
    issue_id = F.sha2(F.concat_ws(":", "category", "group_key", F.lit(run_id)), 256)
    return groups.select(
        issue_id.alias("id"),
        "title",
        "category",
        F.col("total").cast("int").alias("source"),
        F.col("left").cast("int").alias("left_source"),
        F.col("center").cast("int").alias("center_source"),
        F.col("right").cast("int").alias("right_source"),
        created_at.alias("created_at"),
        "group_key",
    )


def issue_bridge(issues: DataFrame, members: DataFrame) -> DataFrame:
    """``(issue_id, article_id)`` of the chosen groups."""
    chosen = issues.select(F.col("id").alias("issue_id"), "category", "group_key")
    return members.join(chosen, ["category", "group_key"]).select("issue_id", F.col("id").alias("article_id"))


def apply_issue_ids(articles: DataFrame, bridge: DataFrame) -> DataFrame:
    return keyed_update(articles, bridge.select(F.col("article_id").alias("id"), "issue_id"))


def changed_titles(issues: DataFrame, titles: DataFrame) -> DataFrame:
    return changed_rows(issues, titles, "title")


def write_report(cards: DataFrame, path: str) -> None:
    cards.write.mode("overwrite").parquet(path)
