import math
import random
import re
from collections import Counter

import numpy as np
import pytest

from newsloom.llm import lexical_search
from newsloom.llm.lexical_search import Items, Search, hierarchy, level_of, ranked_documents, terms_of

from .cases import documents, frame, sentence

TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def plain_terms(text):
    return TERM.findall(text.translate(LOWER)) if text else []


def brute(items, docs, k):
    bags = [(i, Counter(plain_terms(t))) for i, t in docs]
    counted = [(i, c, sum(c.values())) for i, c in bags if c]
    n_docs, length = len(counted), sum(n for _, _, n in counted)
    df = Counter(t for _, c, _ in counted for t in c)
    out = []
    for item, text in items:
        scores = []
        for i, c, n in counted:
            m = 25 + (75 * n * n_docs) // length
            score = 0
            for t, times in Counter(plain_terms(text)).items():
                w = math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[t] + 1)))
                score += times * w * ((1_000_000_000 * c[t]) // (1000 * c[t] + 8 * m))
            if score > 0:
                scores.append((-score, i is None, i or 0, i))
        out += [(item, r + 1, i, -s) for r, (s, _, _, i) in enumerate(sorted(scores)[:k])]
    return sorted(out, key=str)


def items_of(seed=9):
    rng = random.Random(seed)
    rows = documents()
    items = [(i, " ".join(t.split()[3:15])) for i, (_, t, *_) in enumerate(rows[:6])]
    return items + [
        (20, sentence(rng, "en", 8)), (21, None), (22, ""), (23, "no such words, qqq"), (24, "The the THE water"),
        (25, "one"), (None, "東京 都 ünïcödé"), (26, "12345-678!"), (27, rows[0][1]), (27, rows[0][1]),
    ]


def ranked(spark, items, docs, **how):
    table = spark.createDataFrame([(*i, 5, "x") for i in items], "item_id long, text string, rank int, terms string")
    found = ranked_documents(table, docs, **how)
    return sorted((tuple(r) for r in found.select("item_id", "rank", "doc_id", "score").collect()), key=str)


@pytest.mark.parametrize("sizes", [(4096, 32, 8), (8, 2, 2)])
def test_against_brute_force(spark, monkeypatch, sizes):
    """Odd rows of both tables, with a hierarchy of one leaf and with many levels and batches."""
    for name, size in zip(("BATCH", "LEAF", "FAN"), sizes, strict=True):
        monkeypatch.setattr(lexical_search, name, size)
    docs = [(r[0], r[1]) for r in documents()]
    assert ranked(spark, items_of(), frame(spark), k=4) == brute(items_of(), docs, 4)


def test_groups_of_items_give_the_same_rows(spark):
    whole = ranked(spark, items_of(), frame(spark), k=3)
    assert ranked(spark, items_of(), frame(spark), k=3, group_terms=30) == whole


def test_ties_go_by_id(spark):
    docs = spark.createDataFrame([(i, "same words here") for i in (7, 3, 9, 1)] + [(0, "others")], "doc_id long, text string")
    assert [r[2] for r in ranked(spark, [(1, "same words")], docs, k=3)] == [1, 3, 7]


def test_empty_tables(spark):
    assert ranked(spark, [], frame(spark)) == []
    assert ranked(spark, items_of(), frame(spark, [])) == []


def test_terms():
    text = "A-b_C 9é\tDÉ\x7fz 東京,都 x y"
    assert [t.decode() for t in terms_of(text)] == plain_terms(text)


def test_bounds_prune_most_pairs():
    """Documents of fifty topics, items of three of them: most leaves are never scored."""
    rng = np.random.default_rng(2)

    def vector(topic):
        terms = np.unique(rng.integers(topic * 40, topic * 40 + 40, 12))
        return terms, rng.integers(1, 100, len(terms))

    docs = [vector(i // 64) for i in range(3200)]
    items = Items.of([(i, *vector(t)) for i, t in enumerate((3, 3, 20, 41))], np.ones(2000, dtype=np.int64))
    search = Search(items, 10, np.zeros(4, dtype=np.int64))
    search.batch(np.arange(3200), np.zeros(3200, dtype=np.uint8), hierarchy(level_of(docs), 32, 8))
    assert search.scored < 3200 * 4 / 10
    for i, best in enumerate(search.best):
        row = int(np.flatnonzero(items.rows == items.rows[i])[0])
        terms = items.levels[0].terms[items.levels[0].ptr[row] : items.levels[0].ptr[row + 1]]
        weights = dict(zip(terms, items.levels[0].values[items.levels[0].ptr[row] :], strict=False))
        scores = sorted((-sum(weights.get(t, 0) * v for t, v in zip(*d, strict=True)), j) for j, d in enumerate(docs))
        assert [(-s, j) for s, j in scores[:10] if s < 0] == list(zip(best[0], best[2], strict=True))
