"""The stages of ``corpus_pipeline``: each is written as Parquet and read again by the next.

1. language: documents whose language cannot be told go.
2. near_duplicates: of each group of near-duplicates (5-word shingles, similarity 0.8 and more) one stays, and of
   repeated rows one.
3. repeats: passages that stand elsewhere are cut out; a document of which nothing is left goes.
4. decontaminate: documents that hold a benchmark item (0.8 of its 5-word shingles and more) go.
5. mixture: sources are mixed to their weights; ``copies`` says how often a document is taken.

Every stage returns the columns of documents, whatever they are, the last with the mixture's columns after them.
Rows without id are known by their text; rows that share an id are judged each by its own text, but for the benchmark items
that one of them holds. Empty tables stay empty.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from newsloom.llm.decontaminate import contaminated
from newsloom.llm.language import fit, identify
from newsloom.llm.mixing import mix_sources
from newsloom.llm.near_duplicates import near_duplicates, superfluous
from newsloom.llm.suffix_dedup import without_repeats
from newsloom.llm.tables import node_of, stored, unused
from newsloom.session import configure

# A language is rejected below this probability.
SURE = 0.5
# A passage has more than 50 words, however short they are (101 bytes at least), or this many bytes, as texts without
# spaces and of long words have. Shorter grams than those of the operator's default keep anchors apart.
REPEAT_WORDS, REPEAT_BYTES, REPEAT_GRAM = 51, 200, 40


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with letters, of a language that the model is sure of."""
    model = fit(docs.select("doc_id", "text", "lang"))
    said, score = unused(docs, "lang_pred"), unused(docs, "score")
    found = identify(docs, model, docs.columns, (said, score))
    return found.where((F.col(said) != "und") & (F.col(score) >= SURE)).select(*docs.columns)


def _without(docs: DataFrame, nodes: DataFrame) -> DataFrame:
    """The rows of ``docs`` that none of the nodes stands for."""
    node = unused(docs, "node")
    marked = docs.withColumn(node, node_of("doc_id"))
    return marked.join(nodes.withColumnRenamed("node", node), node, "left_anti").select(*docs.columns)


def near_duplicate_groups(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group (that of the smallest id), and all documents without words.

    A row is known by its id and a hash of its text, so other texts of an id that loses a copy stay. Of repeated rows (same
    id, or none, and same text) one stays; which one follows from the other columns. Repeated rows are counted by hashes,
    and only those that have some are looked at as texts.
    """
    groups = near_duplicates(docs, words=5, percent=80)
    gone = stored(superfluous(groups), "gone")
    worded = F.coalesce(F.col("text").rlike(r"[^\x20\x09-\x0D]"), F.lit(False))
    node, th = unused(docs, "node"), unused(docs, "th")
    keys = [node, th]

    def keyed(found: DataFrame) -> DataFrame:
        return found.select(F.col("node").alias(node), F.col("th").alias(th))

    marked = docs.withColumns({node: node_of("doc_id"), th: F.xxhash64("text")})
    twice = marked.where(worded).groupBy(*keys).agg(F.count(F.lit(1)).alias("n")).where("n > 1").select(*keys)
    twice = stored(twice.join(keyed(gone), keys, "left_anti"), "twice")
    row = F.struct(*docs.columns)
    one_each = (
        marked.where(worded).join(twice, keys, "left_semi").select(F.col(node).alias("node"), "text", row.alias("row"))
        .groupBy("node", "text").agg(F.min_by("row", F.to_json("row")).alias("row"))
        .select(*[F.col("row").getField(c).alias(c) for c in docs.columns])
    )
    out = marked.join(twice.unionByName(keyed(gone)), keys, "left_anti").select(*docs.columns)
    return out.unionByName(one_each)


def repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without passages that stand elsewhere, as long as something is left."""
    short = without_repeats(docs, min_bytes=REPEAT_BYTES, words=REPEAT_WORDS, gram=REPEAT_GRAM)
    length = F.length("text").cast(docs.schema["n_chars"].dataType)
    cut = short.withColumn("n_chars", F.when(F.col("text").isNull(), F.col("n_chars")).otherwise(length))
    return cut.where(F.coalesce(F.col("text").rlike(r"[^\x20\x09-\x0D]"), F.lit(False))).select(*docs.columns)


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no benchmark item."""
    benchmark = spark.read.parquet(f"{sf_dir}/benchmark.parquet")
    found = stored(contaminated(docs, benchmark, words=5, threshold=0.8).select("node").distinct(), "contaminated")
    return _without(docs, found)


def mixture(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the mix takes, with what it takes of them; names that documents have are led by ``mix_``."""
    mixed = mix_sources(docs, carry=True).where("copies > 0")
    more = ["size", "source_size", "target", "taken", "copies"]
    named = [F.col(c).alias(f"mix_{c}" if c in docs.columns else c) for c in more]
    return mixed.select(*[F.col("row").getField(c).alias(c) for c in docs.columns], *named)


STAGES = [
    ("language", language),
    ("near_duplicates", near_duplicate_groups),
    ("repeats", repeats),
    ("decontaminate", decontaminate),
    ("mixture", mixture),
]

# Languages, suffixes and the knapsack are beyond SQL; tests compare with a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``."""
    docs = configure(spark).read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir), f"stage-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
