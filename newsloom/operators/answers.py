"""Model results kept by content: what was asked once is not asked again.

A ledger is a folder of results under a digest of the model's name and the input. Inputs are looked up first; of those that
are left, equal ones are one question. Questions are dealt into tasks of a bounded number, and every task writes its results
to a file of its own as it goes, under a temporary name and then moved, named by its first question and how many there are;
a task that is run again after a lost executor finds what its earlier attempt has finished and asks only the rest. So equal
inputs, repeated runs and lost tasks cost no second call, but for the batch that was under way when the task was lost.

Null inputs are not asked and have no result. A result that is null (the model failed) is not kept, so the next run asks
again. A model that is not the same under the same name is the caller's mistake: name its version.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator, Sequence

import pyarrow as pa
import pyarrow.parquet as pq
from pyarrow import fs
from pyspark import TaskContext
from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import DataType, _parse_datatype_string
from pyspark.sql.pandas.types import to_arrow_type

from newsloom.session import cut_lineage, shared_files

Model = Callable[[list[str]], Sequence]
QUESTIONS = 2_000  # of a task
BATCH = 50  # inputs that a model is given at once


class Ledger:
    """Results of the model ``name`` of the type ``result``, in ``folder``, which all executors reach."""

    def __init__(self, spark: SparkSession, folder: str, name: str, result: str = "string"):
        self.spark, self.folder, self.name, self.result = spark, folder.rstrip("/"), name, result
        self.kind: DataType = _parse_datatype_string(result)

    def _digest(self, text: str):
        return F.sha2(F.concat(F.lit(f"{self.name}\x00"), F.col(text)), 256)

    def results(self) -> DataFrame:
        """``(digest, result)`` of everything asked so far."""
        schema = f"digest string, result {self.result}"
        try:
            found = self.spark.read.schema(schema).parquet(f"{self.folder}/results")
        except AnalysisException as e:
            if e.getCondition() != "PATH_NOT_FOUND":
                raise
            return self.spark.createDataFrame([], schema)
        # a lost task may have been at work beside the one that took its place
        return found.dropDuplicates(["digest"])

    def ask(self, inputs: DataFrame, text: str, model: Model, batch_size: int = BATCH, questions: int = QUESTIONS) -> None:
        """Asks the model what the ledger does not know of ``inputs[text]``."""
        wanted = inputs.where(F.col(text).isNotNull()).select(self._digest(text).alias("digest"), F.col(text).alias("text"))
        unknown = wanted.dropDuplicates(["digest"]).join(self.results().select("digest"), "digest", "left_anti")
        unknown = cut_lineage(unknown)
        n = unknown.count()
        if not n:
            return
        parts = -(-n // questions)
        dealt = unknown.withColumn("part", F.pmod(F.xxhash64("digest"), F.lit(parts)))
        dealt = dealt.repartition(parts, "part").sortWithinPartitions("part", "digest")
        asked = dealt.select("digest", "text").mapInArrow(
            _asker(f"{self.folder}/results", model, self.kind, batch_size), "asked long"
        )
        asked.agg(F.sum("asked")).collect()

    def answered(self, inputs: DataFrame, text: str, model: Model | None, column: str, batch_size: int = BATCH) -> DataFrame:
        """``inputs`` with ``column``: the model's result for ``text``, asked only where it isn't known."""
        if model is not None:
            self.ask(inputs, text, model, batch_size)
        known = self.results().select(F.col("digest").alias("__digest"), F.col("result").alias(column))
        marked = inputs.withColumn("__digest", self._digest(text))
        return marked.join(known, "__digest", "left").drop("__digest")


def _asker(folder: str, model: Model, kind: DataType, batch_size: int):
    def ask(texts: list[str]) -> list:
        """A batch that fails is asked text by text, so that one bad text spoils no other."""
        try:
            found = list(model(texts))
            if len(found) != len(texts):
                raise ValueError("the model gave another number of results than it got texts")
            return found
        except Exception:  # noqa: BLE001 - whatever the model raises means "no result"
            return [None] if len(texts) == 1 else [ask([t])[0] for t in texts]

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        system, base = shared_files(folder)
        system.create_dir(base, recursive=True)
        arrow = to_arrow_type(kind)
        schema = pa.schema([("digest", pa.string()), ("result", arrow)])
        asked, held = 0, []

        def finish(rows: list[tuple[str, str]]) -> int:
            # the same questions have the same file, whichever attempt comes to them
            name = hashlib.sha256("".join(d for d, _ in rows).encode()).hexdigest()[:32]
            path = f"{base}/{name}.parquet"
            if system.get_file_info(path).type != fs.FileType.NotFound:
                return 0
            results = ask([t for _, t in rows])
            kept = [(d, r) for (d, _), r in zip(rows, results, strict=True) if r is not None]
            if kept:
                table = pa.table([pa.array([d for d, _ in kept]), pa.array([r for _, r in kept], arrow)], schema=schema)
                temporary = f"{base}/_{name}-{TaskContext.get().taskAttemptId()}"
                with system.open_output_stream(temporary) as sink:
                    pq.write_table(table, sink)
                system.move(temporary, path)
            return len(rows)

        for batch in batches:
            for digest, text in zip(batch.column("digest").to_pylist(), batch.column("text").to_pylist(), strict=True):
                held.append((digest, text))
                if len(held) == batch_size:
                    asked += finish(held)
                    held = []
        if held:
            asked += finish(held)
        yield pa.record_batch([pa.array([asked], pa.int64())], names=["asked"])

    return task
