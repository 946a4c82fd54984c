"""Benchmark decontamination: size-partitioned MinHash containment search with DataFrame functions only.

Documents are partitioned by the size of their shingle set; partition i holds sets of up to 4^i shingles. Within
a partition every set is sketched by one-permutation MinHash with 2 * 4^i bins: the leading bits of a shingle's
hash are its bin, and each bin keeps its least hash. The number of bins follows the size of the partition, so a
shingle of a long document is the least of its bin as often as one of a short document, with probability 0.79
at least. An item is sketched once for each partition. Equal bins make a candidate: an item of which m shingles are
shared is missed with probability 0.21^m at most, 4e-6 from SURE_SHARED = 8 on. Items that may share fewer at the
threshold (up to 12 words, at 0.8 of 5-word shingles) are not sketched: each of their shingles is looked up among all
shingles of the documents, so that none is missed. Candidates are verified on the exact shingles, as text.

Null or empty texts contain nothing and are contained in nothing. A text of fewer words than a shingle is one
shingle. Rows that share an id are one document, of which any may hold an item; rows and items without id are known
by their text. Items that share an id are one item with the shingles of all. Columns other than ids and texts are not looked at.
"""

from __future__ import annotations

import string

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from newsloom.llm.tables import node_of, stored

SPACE = r"[\x20\x09-\x0D]+"
PARTITIONS = 16  # the last holds sets of up to 4^15 shingles and more
# Items that need fewer shared shingles than this are looked up by every shingle.
SURE_SHARED = 8
# Rows of the items' sketches that are broadcast (about 40 bytes each); more are joined by a shuffle.
BROADCAST_ROWS = 1_000_000


def words_column(text: Column) -> Column:
    """The words of a text, A-Z in lower case; no words for null."""
    lower = F.translate(text, string.ascii_uppercase, string.ascii_lowercase)
    return F.filter(F.split(F.coalesce(lower, F.lit("")), SPACE), lambda w: w != "")


def _starts(words: Column, size: int) -> Column:
    return F.when(F.size(words) > 0, F.sequence(F.lit(0), F.greatest(F.size(words) - size, F.lit(0)))).otherwise(
        F.array().cast("array<int>")
    )


def shingle_texts(words: Column, size: int) -> Column:
    """The distinct runs of ``size`` words."""
    return F.array_distinct(F.transform(_starts(words, size), lambda i: F.array_join(F.slice(words, i + 1, size), " ")))


def shingle_hashes(hashed: Column, size: int) -> Column:
    """Sorted distinct hashes of the runs of ``size`` hashed words."""
    run = lambda i: F.xxhash64(*[F.get(hashed, i + k) for k in range(size)])
    return F.sort_array(F.array_distinct(F.transform(_starts(hashed, size), run)))


def _sketch(hashes: Column, part: Column) -> Column:
    """The least hash of each bin; bins are leading bits, so a sorted array holds them one after the other."""
    shift = F.lit(63) - 2 * part
    bin_of = lambda x: F.call_function("shiftright", x, shift)
    first = lambda x, i: (i == 0) | (bin_of(x) != bin_of(F.get(hashes, i - 1)))
    return F.filter(hashes, first)


def _part(size: Column) -> Column:
    """i for sets of more than 4^(i-1) and up to 4^i shingles."""
    return F.least(F.ceil(F.log2(F.greatest(size, F.lit(1)).cast("double")) / 2), F.lit(PARTITIONS - 1)).cast("int")


def _guarded(df: DataFrame, rows: int, limit: int) -> DataFrame:
    return F.broadcast(df) if rows <= limit else df


def contaminated(
    docs: DataFrame, benchmark: DataFrame, words: int = 5, threshold: float = 0.8, limit: int = BROADCAST_ROWS
) -> DataFrame:
    """``(doc_id, node, item_id, shared, item_shingles)``: the items of which a document holds enough shingles.

    ``shared / item_shingles >= threshold``; one row for each document and item.
    """
    item_words = benchmark.select(
        "item_id", node_of("item_id").alias("item"), words_column(F.col("text")).alias("w")
    ).where(F.size("w") > 0)
    items = stored(
        item_words.select("item_id", "item", F.explode(shingle_texts(F.col("w"), words)).alias("shingle"))
        .groupBy("item_id", "item")
        .agg(F.collect_set("shingle").alias("shingles")),
        "items",
    )
    hashed_item = F.sort_array(
        F.array_distinct(
            F.transform(
                "shingles",
                lambda s: F.xxhash64(
                    *[F.get(F.transform(F.split(s, " "), lambda w: F.xxhash64(w)), F.lit(k)) for k in range(words)]
                ),
            )
        )
    )
    hashed = items.select("item", hashed_item.alias("h"), (F.ceil(F.lit(threshold) * F.size("shingles"))).alias("need"))
    few = hashed.where(F.col("need") < SURE_SHARED).select("item", F.explode("h").alias("least"))
    direct = few.select("item", F.col("least").bitwiseXOR(F.lit(PARTITIONS).cast("long")).alias("key"))
    entries = (
        hashed.where(F.col("need") >= SURE_SHARED)
        .select("item", "h", F.explode(F.sequence(F.lit(0), F.lit(PARTITIONS - 1))).alias("part"))
        .where(F.pow(F.lit(4.0), F.col("part")) >= F.lit(threshold) * F.size("h"))
        .select("item", "part", F.explode(_sketch(F.col("h"), F.col("part"))).alias("least"))
        .select("item", F.col("least").bitwiseXOR(F.col("part").cast("long")).alias("key"))
    )
    direct = stored(direct.distinct(), "direct")
    looked_up = direct.count()
    entries = stored(entries.unionByName(direct).distinct(), "entries")
    held = entries.count()

    source = docs.select("doc_id", node_of("doc_id").alias("node"), "text")
    # The filter comes first and the explode is an outer one: Spark would push a test of the arrays below the
    # projections that make them, and so make them twice.
    hashes = (
        source.where(F.col("text").rlike(r"[^\x20\x09-\x0D]")).select(
            "node", F.transform(words_column(F.col("text")), lambda w: F.xxhash64(w)).alias("w")
        )
        .select("node", shingle_hashes(F.col("w"), words).alias("h"))
        .select("node", "h", _part(F.size("h")).alias("part"))
    )
    keys = F.transform(_sketch(F.col("h"), F.col("part")), lambda x: x.bitwiseXOR(F.col("part").cast("long")))
    if looked_up:
        # a number that no partition has keeps these keys apart
        keys = F.concat(keys, F.transform("h", lambda x: x.bitwiseXOR(F.lit(PARTITIONS).cast("long"))))
    sketched = hashes.select("node", F.explode_outer(keys).alias("key"))
    candidates = stored(
        sketched.join(_guarded(entries, held, limit), "key").select("node", "item").distinct(), "candidates"
    )
    pairs = candidates.groupBy("node").agg(F.collect_set("item").alias("items"))
    found = (
        # by a shuffle at any size: how many documents are candidates has no bound
        source.join(pairs.hint("merge"), "node")
        # the words are a column of their own, or every shingle would split its text again
        .select("doc_id", "node", "items", words_column(F.col("text")).alias("w"))
        .select("doc_id", "node", "items", shingle_texts(F.col("w"), words).alias("own"))
        .select("doc_id", "node", "own", F.explode("items").alias("item"))
        .join(_guarded(items, held, limit), "item")
        .select(
            "doc_id",
            "node",
            "item",
            "item_id",
            F.size(F.array_intersect("shingles", "own")).cast("long").alias("shared"),
            F.size("shingles").cast("long").alias("item_shingles"),
        )
        .where(F.col("shared") >= F.lit(threshold) * F.col("item_shingles"))
    )
    best = found.groupBy("doc_id", "node", "item", "item_id").agg(
        F.max("shared").alias("shared"), F.max("item_shingles").alias("item_shingles")
    )
    return best.select("doc_id", "node", "item_id", "shared", "item_shingles")
