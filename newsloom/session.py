"""Session set-up, the shared scratch folder, and cutting lineage."""

from __future__ import annotations

import tempfile
import uuid

from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession

# Pages and prompts are wide rows: small Arrow batches keep the Python workers' memory flat.
ARROW_ROWS_PER_BATCH = "512"


def configure(spark: SparkSession) -> SparkSession:
    """Runtime settings every operator here relies on."""
    spark.conf.set("spark.sql.session.timeZone", "UTC")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", ARROW_ROWS_PER_BATCH)
    return spark


def build_session(app: str = "newsloom", master: str | None = None, **settings: str) -> SparkSession:
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    defaults = {
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.session.timeZone": "UTC",
        "spark.cleaner.referenceTracking.cleanCheckpoints": "true",
    }
    for key, value in {**defaults, **settings}.items():
        builder = builder.config(key, value)
    return configure(builder.getOrCreate())


def _is_local(spark: SparkSession) -> bool:
    return spark.sparkContext.master.startswith("local")


def shared_folder(spark: SparkSession) -> str:
    """The folder all executors can reach, as named by the cluster.

    Only a local session may fall back to a temporary folder of its own.
    """
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named
    if not _is_local(spark):
        raise RuntimeError("set spark.checkpoint.dir to a folder that every executor can reach")
    fallback = tempfile.mkdtemp(prefix="spark-")
    spark.conf.set("spark.checkpoint.dir", fallback)
    return fallback


def scratch_path(spark: SparkSession, name: str) -> str:
    """A fresh path under the shared folder."""
    return f"{shared_folder(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"


def shared_files(folder: str) -> tuple[fs.FileSystem, str]:
    """The file system and path of a folder in the shared folder, for tasks that write files of their own.

    Hadoop has names of its own for some stores' schemes.
    """
    scheme, mark, rest = folder.partition("://")
    known = {"s3a": "s3", "s3n": "s3"}
    return fs.FileSystem.from_uri(f"{known.get(scheme, scheme)}{mark}{rest}" if mark else folder)


def cut_lineage(df: DataFrame) -> DataFrame:
    """Materialise ``df`` on the shared folder, so that lost executors do not replay its history."""
    spark = df.sparkSession
    context = spark.sparkContext
    if context.getCheckpointDir() is None:
        context.setCheckpointDir(shared_folder(spark))
    return df.checkpoint(eager=True)


def written(df: DataFrame, name: str) -> DataFrame:
    """``df`` written to the shared folder and read back: its readers take the columns they need.

    Catalyst knows the size of such a table. A small one is broadcast, so that rows that meet it stay where they are;
    of a large one the adaptive join can split the keys that have most rows.
    """
    path = scratch_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
