import numpy as np
import pytest
from pyspark.sql import functions as F

from newsloom.llm.near_duplicates import (
    BAND_ROWS, BANDS, EMPTY, _across, _rare_shingles, near_duplicates, sketch, superfluous,
)
from newsloom.llm.spans import mix
from newsloom.llm.tables import node_of

from .cases import documents, frame, shingles


def brute(rows, words, percent):
    sets = [shingles(r[1], words) for r in rows]
    root = list(range(len(rows)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i in range(len(rows)):
        for j in range(i):
            both = len(sets[i] & sets[j])
            if both and 100 * both >= percent * len(sets[i] | sets[j]):
                root[find(i)] = find(j)
    least = {}
    for i, r in enumerate(rows):
        if r[0] is not None:
            least[find(i)] = min(least.get(find(i), r[0]), r[0])
    out = []
    for i, r in enumerate(rows):
        component = least.get(find(i)) if sets[i] else r[0]
        out.append((r[0], len(sets[i]), component, r[0] == component))
    return sorted(out, key=str)


@pytest.mark.parametrize("words", [4, 5])
def test_against_brute_force(spark, words):
    found = near_duplicates(frame(spark), words=words).select("doc_id", "n_shingles", "component_id", "kept")
    assert sorted((tuple(r) for r in found.collect()), key=str) == brute(documents(), words, 80)


def test_graded_copies_of_one_text(spark):
    """Copies that are like the base but not like each other: all links go through it."""
    rng = np.random.default_rng(3)
    base = [f"w{i}" for i in range(120)]
    rows = [(1000, " ".join(base))]
    for i in range(60):
        text = list(base)
        for at in rng.choice(len(base), 1 + i % 7, replace=False):
            text[at] = f"x{i}_{at}"
        rows.append((i, " ".join(text)))
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    found = near_duplicates(docs, words=4).select("doc_id", "n_shingles", "component_id", "kept")
    assert sorted((tuple(r) for r in found.collect()), key=str) == brute(rows, 4, 80)


def test_empty_table(spark):
    assert near_duplicates(frame(spark, [])).collect() == []


def mutated(rng, base, n, words=4):
    """A copy with ``n`` words replaced by words of a small pool, so that changes recur among copies."""
    text = list(base)
    for at in rng.choice(len(base), n, replace=False):
        text[at] = f"x{rng.integers(0, 6)}"
    return " ".join(text)


def test_a_large_group_of_far_copies(spark):
    """Copies that are mostly less than similar enough: many components in the same buckets, few links among them."""
    rng = np.random.default_rng(6)
    base = [f"w{i}" for i in range(90)]
    rows = [(i, mutated(rng, base, int(rng.integers(1, 9)))) for i in range(160)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    found = near_duplicates(docs, words=4).select("doc_id", "n_shingles", "component_id", "kept")
    assert sorted((tuple(r) for r in found.collect()), key=str) == brute(rows, 4, 80)


def test_rare_shingles_lose_no_pair(spark):
    """Of random sets every similar pair is among the candidates, and far fewer than all pairs are."""
    rng = np.random.default_rng(7)
    base = [f"w{i}" for i in range(60)]
    texts = {i: mutated(rng, base, int(rng.integers(0, 8))) for i in range(70)}
    df = spark.createDataFrame(list(texts.items()), "node long, text string")
    roots = df.select("node", F.col("node").alias("root"))
    pairs = _across(_rare_shingles(df, 4, 80).join(roots, "node"), 80).collect()
    sets = {i: shingles(t, 4) for i, t in texts.items()}
    similar = {
        (i, j) for i in sets for j in sets
        if i < j and 100 * len(sets[i] & sets[j]) >= 80 * len(sets[i] | sets[j])
    }
    assert similar <= {(r["a"], r["b"]) for r in pairs}
    assert len(pairs) < 70 * 69 / 4


def stays(spark, rows):
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    found = near_duplicates(docs)
    gone = {(r["node"], r["th"]) for r in superfluous(found).collect()}
    rows = docs.select("doc_id", "text", node_of("doc_id").alias("node"), F.xxhash64("text").alias("th")).collect()
    return sorted(((r["doc_id"], r["text"]) for r in rows if (r["node"], r["th"]) not in gone), key=str)


def test_one_is_chosen_of_a_group_without_ids(spark):
    text = "a b c d e f g h i j k l m n o p q r s t"
    assert len(stays(spark, [(None, text), (None, text + " u")])) == 1


def test_texts_of_a_shared_id_are_judged_by_themselves(spark):
    """Id 60 has a copy of document 3, and a text of its own that document 90 copies: one of each stays."""
    a, b = (" ".join(f"{c}{i}" for i in range(40)) for c in "ab")
    assert stays(spark, [(3, a), (60, a), (60, b), (90, b)]) == [(3, a), (60, b)]
    assert stays(spark, [(60, a), (60, a + " z"), (70, b)])[1:] == [(70, b)]


def test_sketch_fills_and_estimates():
    rng = np.random.default_rng(1)
    size = BANDS * BAND_ROWS
    for n in (1, 2, 7, 1000):
        assert (sketch(mix(np.arange(n, dtype=np.uint64)), size) != EMPTY).all()
    a = mix(rng.integers(0, 1 << 62, 900).astype(np.uint64))
    b = np.concatenate([a[:800], mix(rng.integers(0, 1 << 62, 100).astype(np.uint64))])
    alike = (sketch(a, 4096) == sketch(b, 4096)).mean()
    assert abs(alike - 0.8) < 0.03
