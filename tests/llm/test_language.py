import itertools
import math

import numpy as np
import pytest

from newsloom.llm.language import Lattice, piece_keys, predicted_languages, stretches, words_in

from .cases import documents, frame


def paths(word, pieces):
    """All segmentations; a letter that no piece holds is a piece."""
    if not word:
        return [[]]
    out = []
    for k in range(1, len(word) + 1):
        head = word[:k]
        if head in pieces or (k == 1 and head not in pieces):
            out += [[head, *rest] for rest in paths(word[k:], pieces)]
    return out


def test_forward_and_expected_counts_over_all_segmentations():
    pieces = sorted(["a", "b", "ab", "aba", "▁", "▁a", "ba"])
    keys = piece_keys(pieces)
    rng = np.random.default_rng(0)
    chance = np.append(rng.random(len(keys) + 1), 0.0)
    order = {p: int(np.searchsorted(keys, piece_keys([p])[0])) for p in pieces}
    number = lambda p: order.get(p, len(keys))
    strings = ["▁abab", "▁", "ba", "▁xay", "abababa"]
    lattice = Lattice(strings, keys, 10)
    logs = lattice.log_chances(chance[None, :])[:, 0]
    weight = np.array([2.0, 1, 1, 3, 1])
    counts = np.zeros(len(chance))
    for s, log, w in zip(strings, logs, weight, strict=True):
        each = [(p, math.prod(chance[number(x)] for x in p)) for p in paths(s, set(pieces))]
        whole = sum(c for _, c in each)
        assert log == pytest.approx(math.log(whole))
        for p, c in each:
            for x in p:
                counts[number(x)] += w * c / whole
    assert lattice.expected(chance, weight)[:-1] == pytest.approx(counts[:-1])


def test_long_words_are_scored_in_stretches():
    parts = stretches("ab" * 5000)
    assert "".join(parts) == "▁" + "ab" * 5000 and max(map(len, parts)) <= 32


def test_held_out_accuracy_and_odd_rows(spark):
    rows = documents() + [(1000 + i, *documents(seed=100 + i)[i % 30][1:]) for i in range(120)]
    found = predicted_languages(frame(spark, rows)).collect()
    assert len(found) == len(rows)
    lang = {r[0]: r[2] for r in rows}
    plain = [r for r in found if r["doc_id"] is not None and r["doc_id"] >= 1000]
    right = [r["lang_pred"] == lang[r["doc_id"]] for r in plain if r["held_out"]]
    assert len(right) > 15 and np.mean(right) > 0.95
    by = {r["doc_id"]: r for r in found}
    for i in (50, 51, 52, 56, 61):
        assert (by[i]["lang_pred"], by[i]["score"]) == ("und", 0.0)
    assert all(0 <= r["score"] <= 1 for r in found)


def test_empty_table_and_nothing_to_learn(spark):
    assert predicted_languages(frame(spark, [])).collect() == []
    rows = [(1, "some words", None, None, 1, *[None] * 8)]
    assert [r["lang_pred"] for r in predicted_languages(frame(spark, rows)).collect()] == ["und"]


def test_words_are_runs_of_letters():
    assert words_in("Ab1cd, ÉÈ_x²") == ["ab", "cd", "éè", "x"]
    assert list(itertools.chain(*map(words_in, (None, "", "12 _")))) == []
