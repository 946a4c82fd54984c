"""Near-duplicate documents by fast similarity sketching, banding and exact verification.

Sketch: coordinate values come from rounds. In each of the first T rounds every shingle is thrown into one
hashed bin of the T bins, with a value that starts with the number of the round; in round T + i all shingles go
to bin i. A bin keeps the least value. So each coordinate is filled after 2 T rounds at the latest, most sets
fill all of them in the first few, and the number of equal coordinates of two sketches is as concentrated
about T times the Jaccard similarity as sampling without replacement allows. The work is |set| + T log T.

Equal shingle sets become one class first, so copies never meet in pairs. Classes whose sketches agree on a
whole band share a bucket. In a bucket everyone is compared with the member that has most
neighbours, and what is linked becomes one component.
What is left are pairs of different components, found by an index of rare shingles: ordered by how many candidates hold
them, two sets of n and m shingles that are similar enough share one of their first n - ceil(t n) + 1 and m - ceil(t m) + 1,
and where they first do, as many must be left behind it as the similarity asks for. So a large group of copies that differ
in a few places meets by what they share beyond the common text, not pair by pair. Of a shingle's holders those of its
largest component don't meet each other. Links are confirmed on the full shingle sets.

Null ids: a row without id stands by its text. Null or wordless text: no shingles, no links. Rows that share an id are
judged each by its own text; repeated rows come back as often as they came in. Columns other than the id and the text are
not looked at.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from newsloom.llm.spans import mix, shingles, words_of
from newsloom.llm.tables import discard, node_of, small_batches, stored
from newsloom.operators.components import connected_components

# At similarity 0.8 a pair agrees on a whole band of five with probability 0.33; that none of 30 bands does has
# probability 7e-6.
BAND_ROWS = 5
BANDS = 30
# Parts of a component whose members meet its smallest id.
SALTS = 16
EMPTY = np.uint64(0xFFFFFFFFFFFFFFFF)


def _thrown(values: np.ndarray, turns: np.ndarray) -> np.ndarray:
    """A row for each round: the hashes of all values."""
    return mix(values[None, :] + (turns[:, None] + np.uint64(1)) * np.uint64(0x9E3779B97F4A7C15))


def sketch(values: np.ndarray, size: int) -> np.ndarray:
    """``size`` coordinates of a set of 64-bit hashes; equal coordinates count towards similarity."""
    bins = np.full(size, EMPTY, dtype=np.uint64)
    if not len(values):
        return bins
    chunk = max(1, 4096 // len(values))
    for first in range(0, size, chunk):
        turns = np.arange(first, min(first + chunk, size), dtype=np.uint64)
        thrown = _thrown(values, turns)
        place = (mix(thrown) % np.uint64(size)).astype(np.int64)
        # the round leads the value, so that what an earlier round placed is never replaced
        np.minimum.at(bins, place, (thrown >> np.uint64(12)) | (turns << np.uint64(52))[:, None])
        if (bins != EMPTY).all():
            return bins
    for first in range(0, len(left := np.flatnonzero(bins == EMPTY)), chunk):
        here = left[first : first + chunk]
        turns = (here + size).astype(np.uint64)
        bins[here] = (_thrown(values, turns).min(axis=1) >> np.uint64(12)) | (turns << np.uint64(52))
    return bins


def band_hashes(bins: np.ndarray, rows: int) -> np.ndarray:
    """One hash per band, the number of the band included."""
    bands = bins.reshape(-1, rows)
    out = np.arange(1, len(bands) + 1, dtype=np.uint64)
    for i in range(rows):
        out = mix(out * np.uint64(0x100000001B3) + bands[:, i])
    return out


def _sketches(words: int, bands: int, rows: int):
    def step(batches):
        for batch in batches:
            count, key, band = [], [], []
            for text in batch.column("text"):
                found = shingles(words_of(text.as_py()), words)
                count.append(len(found))
                key.append(hashlib.blake2b(found.tobytes(), digest_size=16).digest())
                # values of 52 bits below the round: 2 * size rounds fit into the 12 bits above
                band.append(band_hashes(sketch(found, bands * rows), rows).view(np.int64) if len(found) else None)
            yield pa.record_batch(
                [
                    batch.column("doc_id"),
                    batch.column("node"),
                    batch.column("th"),
                    pa.array(count, pa.int64()),
                    pa.array(key, pa.binary()),
                    pa.array(band, pa.list_(pa.int64())),
                ],
                names=["doc_id", "node", "th", "n_shingles", "set_key", "bands"],
            )

    return step


def _confirm(words: int, percent: int):
    def step(batches):
        last, known = None, None
        for batch in batches:
            a, b = batch.column("a").to_pylist(), batch.column("b").to_pylist()
            left, right, keep = batch.column("text_a"), batch.column("text_b"), []
            for i in range(len(a)):
                if last is None or last[0] != a[i] or last[1] != left[i]:
                    last, known = (a[i], left[i]), shingles(words_of(left[i].as_py()), words)
                other = shingles(words_of(right[i].as_py()), words)
                shared = len(np.intersect1d(known, other, assume_unique=True))
                keep.append(100 * shared >= percent * (len(known) + len(other) - shared))
            mask = pa.array(keep, pa.bool_())
            yield batch.select(["a", "b"]).filter(mask)

    return step


def _shingle_rows(words: int):
    def step(batches):
        for batch in batches:
            for node, text in zip(batch.column("node").to_pylist(), batch.column("text"), strict=True):
                found = shingles(words_of(text.as_py()), words).view(np.int64)
                yield pa.record_batch(
                    [pa.array(np.full(len(found), node)), pa.array(found)], names=["node", "shingle"]
                )

    return step


def _links(pairs: DataFrame, texts: DataFrame, words: int, percent: int) -> DataFrame:
    """The pairs (a, b) whose full shingle sets are similar enough."""
    right = texts.select(F.col("node").alias("b"), F.col("text").alias("text_b"))
    left = texts.select(F.col("node").alias("a"), F.col("text").alias("text_a"))
    return stored(
        pairs.join(right, "b").join(left, "a").mapInArrow(_confirm(words, percent), "a long, b long").distinct(), "links"
    )


def _roots(edges: DataFrame) -> DataFrame:
    return connected_components(edges.select(F.lit(0).alias("block"), "a", "b")).select(F.col("loc").alias("node"), "root")


def _rare_shingles(texts: DataFrame, words: int, percent: int) -> DataFrame:
    """``(node, shingle, n, at)``: of each text's ``n`` shingles, rarest first, those of which similar texts share one."""
    rows = stored(texts.mapInArrow(_shingle_rows(words), "node long, shingle long"), "shingles")
    times = rows.groupBy("shingle").agg(F.count(F.lit(1)).alias("times")).where("times > 1")
    own = Window.partitionBy("node")
    # shingles of a single text come first and are no one's partner: they are counted, not sorted
    sizes = rows.groupBy("node").agg(F.count(F.lit(1)).alias("n"))
    common = rows.join(times, "shingle").join(sizes, "node")
    alone = F.col("n") - F.count(F.lit(1)).over(own)
    placed = common.withColumn("at", alone + F.row_number().over(own.orderBy("times", "shingle")) - 1)
    return placed.where(F.col("at") <= F.col("n") - F.ceil(percent * F.col("n") / 100)).select("node", "shingle", "n", "at")


def _across(entries: DataFrame, percent: int) -> DataFrame:
    """Pairs (a, b) of different components that may be similar enough, from ``(node, shingle, n, at, root)``."""
    sizes = entries.groupBy("shingle", "root").agg(F.count(F.lit(1)).alias("n"))
    mixed = (
        sizes.groupBy("shingle")
        .agg(F.max(F.struct("n", "root")).alias("most"), F.count(F.lit(1)).alias("parts"))
        .where("parts > 1")
        .select("shingle", F.col("most.root").alias("main"))
    )
    sides = stored(entries.join(mixed, "shingle"), "sides")
    minor = sides.where("root <> main").select(
        "shingle", F.col("node").alias("x"), F.col("root").alias("of"), F.col("n").alias("nx"), F.col("at").alias("ax")
    )
    most = F.least(F.col("nx") - F.col("ax"), F.col("n") - F.col("at"))
    enough = 100 * most >= percent * (F.col("nx") + F.col("n") - most)
    other = (F.col("root") != F.col("of")) & ((F.col("root") == F.col("main")) | (F.col("x") < F.col("node")))
    pairs = minor.join(sides, "shingle").where(other & enough)
    return pairs.select(F.least("x", "node").alias("a"), F.greatest("x", "node").alias("b")).distinct()


def _joined_up(shared: DataFrame, texts: DataFrame, words: int, percent: int) -> DataFrame:
    """``(node, root)`` of all linked nodes."""
    # the member that shares most buckets with others is the likeliest to be like the rest
    known = shared.groupBy("node").agg(F.sum("size").alias("known"))
    leaders = shared.join(known, "node").groupBy("bucket").agg(F.max_by("node", "known").alias("leader"))
    star = shared.join(leaders, "bucket").where("node <> leader").select(
        F.least("leader", "node").alias("a"), F.greatest("leader", "node").alias("b")
    )
    roots = _roots(_links(star.distinct(), texts, words, percent))
    placed = shared.join(roots, "node", "left").select("bucket", "node", F.coalesce("root", "node").alias("root"))
    parts = placed.groupBy("bucket").agg(F.min("root").alias("first"), F.max("root").alias("last"))
    left = placed.join(parts.where("first < last").select("bucket"), "bucket").select("node", "root").distinct()
    left = stored(left, "left")
    entries = _rare_shingles(texts.join(left.select("node"), "node"), words, percent).join(left, "node")
    last = _links(_across(entries, percent), texts, words, percent)
    return _roots(roots.select(F.col("node").alias("a"), F.col("root").alias("b")).unionByName(last))


def near_duplicates(
    docs: DataFrame,
    words: int = 5,
    percent: int = 80,
    bands: int = BANDS,
    band_rows: int = BAND_ROWS,
) -> DataFrame:
    """``(doc_id, n_shingles, component_id, kept, node, th, component)``, one row per row of ``docs``.

    Documents are linked whose shingle sets have ``100 * intersection >= percent * union``; the component's id
    is its smallest doc_id (null if none of its rows has one), and kept says that the row has that id. ``node`` and ``th``
    stand for the row's id and text; ``component`` is equal for linked rows, and null for rows without words.
    """
    texts = docs.select("doc_id", node_of("doc_id").alias("node"), F.xxhash64("text").alias("th"), "text")
    source = small_batches(texts)
    sketches = source.mapInArrow(
        _sketches(words, bands, band_rows),
        "doc_id long, node long, th long, n_shingles long, set_key binary, bands array<long>",
    )
    sketches = stored(sketches.withColumn("row", F.monotonically_increasing_id()), "sketches")
    filled = sketches.where("n_shingles > 0")
    # a class is known by the number of its first row, and that row's sketch and text stand for it
    classes = stored(filled.groupBy("set_key").agg(F.min("row").alias("class"), F.min("doc_id").alias("least_id")), "classes")
    firsts = filled.join(classes.select(F.col("class").alias("row")), "row")
    entries = firsts.select(F.col("row").alias("node"), F.explode("bands").alias("bucket"))
    buckets = entries.groupBy("bucket").agg(F.count(F.lit(1)).alias("size")).where("size > 1")
    shared = stored(entries.join(buckets, "bucket"), "buckets")
    near = firsts.join(shared.select(F.col("node").alias("row")).distinct(), "row").select("row", "node", "th")
    texts = source.select("node", "th", "text").join(near, ["node", "th"]).select(F.col("row").alias("node"), "text")
    texts = stored(texts.dropDuplicates(["node"]), "texts")

    roots = _joined_up(shared, texts, words, percent)
    discard(texts, shared)
    named = classes.join(roots.withColumnRenamed("node", "class"), "class", "left")
    least = named.where("root IS NOT NULL").groupBy("root").agg(F.min("least_id").alias("component_id"))
    # a component of many classes is split over salts
    least = least.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    named = named.withColumn("salt", F.pmod(F.xxhash64("class"), F.lit(SALTS)).cast("int")).join(least, ["root", "salt"], "left")
    named = named.select(
        "set_key", F.coalesce("root", "class").alias("component"),
        F.when(F.col("root").isNull(), F.col("least_id")).otherwise(F.col("component_id")).alias("component_id"),
    )
    result = filled.select("doc_id", "node", "th", "n_shingles", "set_key").join(named, "set_key").drop("set_key")
    alone = sketches.where("n_shingles = 0").select(
        "doc_id", "node", "th", "n_shingles", F.lit(None).cast("long").alias("component"),
        F.col("doc_id").alias("component_id"),
    )
    kept = F.col("doc_id").eqNullSafe(F.col("component_id")).alias("kept")
    return result.unionByName(alone).select("doc_id", "n_shingles", "component_id", kept, "node", "th", "component")


def superfluous(found: DataFrame) -> DataFrame:
    """``(node, th)`` of the rows of ``near_duplicates`` of whose component another row stays: that of its smallest id,
    or of its smallest node where none has an id, and of that id's texts the one of the smallest hash."""
    worded = stored(found.where("component IS NOT NULL").select("component", "doc_id", "node", "th").distinct(), "worded")
    ids = worded.groupBy("component").agg(
        F.coalesce(F.min("doc_id"), F.min("node")).alias("stays"), F.count(F.lit(1)).alias("n")
    ).where("n > 1")
    least = worded.join(ids, "component").where("node = stays").groupBy("component", "stays").agg(F.min("th").alias("text"))
    least = least.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    salted = worded.withColumn("salt", F.pmod(F.xxhash64("node", "th"), F.lit(SALTS)).cast("int"))
    return salted.join(least, ["component", "salt"]).where("node <> stays OR th <> text").select("node", "th").distinct()
