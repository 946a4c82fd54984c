import hashlib
import random
from collections import Counter

import numpy as np
import pytest

from newsloom.llm.suffix_dedup import Extensions, anchors, joined_spans, removal_digests, without_repeats

from .cases import documents, frame


def brute(rows, size):
    data = [(r[0], (r[1] or "").encode()) for r in rows]
    seen = Counter(b[i : i + size] for _, b in data for i in range(len(b) - size + 1))
    out = []
    for key, b in data:
        spans = joined_spans([(i, i + size) for i in range(len(b) - size + 1) if seen[b[i : i + size]] > 1])
        kept, at = b"", 0
        for start, end in spans:
            kept, at = kept + b[at:start], end
        kept += b[at:]
        out.append((key, len(b), len(b) - len(kept), len(spans), hashlib.sha256(kept).hexdigest()))
    return sorted(out, key=str)


@pytest.mark.parametrize(("size", "block"), [(400, 4096), (100, 4096), (100, 2)])
def test_against_brute_force(spark, size, block):
    """The small block sends almost every gram the way of frequent ones."""
    found = removal_digests(frame(spark), size, block=block)
    assert sorted((tuple(r) for r in found.collect()), key=str) == brute(documents(), size)


def test_empty_table(spark):
    assert removal_digests(frame(spark, [])).collect() == []


def test_texts_keep_whole_characters_and_columns(spark):
    rows = documents()
    found = without_repeats(frame(spark), 100)
    assert found.columns == frame(spark).columns
    kept = found.collect()
    assert len(kept) == len(rows)
    for r in kept:
        if r["text"] is not None:
            r["text"].encode()
            assert r["node"] == 7 and r["spans"] == "x"


def test_suffix_order_and_reach():
    rng = random.Random(2)
    parts = [bytes(rng.choice(b"ab") for _ in range(rng.randint(0, 40))) for _ in range(60)]
    extensions = Extensions(parts)
    assert [parts[i] for i in extensions.order()] == sorted(parts)
    for i, reach in enumerate(extensions.reach()):
        longest = max(
            next((n for n, (a, b) in enumerate(zip(parts[i], parts[j], strict=False)) if a != b),
                 min(len(parts[i]), len(parts[j])))
            for j in range(len(parts)) if j != i
        )
        assert reach == longest


def test_equal_strings_own_equal_anchors():
    rng = np.random.default_rng(4)
    inner = bytes(rng.integers(97, 110, 300, dtype=np.uint8))
    a = bytes(rng.integers(97, 110, 777, dtype=np.uint8)) + inner
    b = inner + bytes(rng.integers(97, 110, 500, dtype=np.uint8))
    size = 200

    def owners(data):
        p, lo, hi, gram, _ = anchors(data, size, 32)
        return {s: (q - s, g) for q, first, last, g in zip(p, lo, hi, gram, strict=True) for s in range(first, last + 1)}

    left, right = owners(a), owners(b)
    assert sorted(left) == list(range(len(a) - size + 1))
    for s in range(len(inner) - size + 1):
        assert left[777 + s] == right[s]


def brute_words(rows, size, words):
    """Strings of ``size`` bytes, or of ``words`` words if those are shorter, that occur twice."""

    def ends(b):
        out = []
        for s in range(len(b)):
            e, n = s, 0
            while n < words and e < len(b):
                while e < len(b) and b[e : e + 1].isspace():
                    e += 1
                n += e < len(b)
                while e < len(b) and not b[e : e + 1].isspace():
                    e += 1
            stop = min(e, s + size) if n == words else s + size
            if stop <= len(b):
                out.append((s, stop))
        return out

    data = [(key, text.encode()) for key, text in rows]
    seen = Counter(b[s:e] for _, b in data for s, e in ends(b))
    kept = {}
    for key, b in data:
        at, out = 0, b""
        for s, e in joined_spans([(s, e) for s, e in ends(b) if seen[b[s:e]] > 1]):
            out, at = out + b[at:s], e
        kept[key] = (out + b[at:]).decode()
    return kept


@pytest.mark.parametrize("block", [4096, 1])
def test_passages_of_short_words(spark, block):
    """Over 50 words in fewer than 200 bytes are a passage; 50 words of that length are none."""
    rng = random.Random(6)

    def said(n, length=1):
        return " ".join("".join(rng.choice("abcdefghij") for _ in range(rng.randint(1, length))) for _ in range(n))

    short, fifty, changed, twin = said(51), said(50), said(70, 2), said(51)
    rows = [
        (1, f"{said(60, 9)} {short} {said(90, 9)}"), (2, f"{said(200, 9)}\n{short}"), (3, short),
        (4, f"{said(60, 9)} {fifty} {said(60, 9)}"), (5, f"{said(40, 9)} {fifty}"),
        (6, f"{changed} {said(80, 3)}"), (7, f"{said(40, 4)} {changed[:-1]}?"), (8, changed[1:] + "x"),
        (9, f"{said(30, 9)} {twin} {said(30)} {twin}"), (10, "x" * 450), (11, "y" * 150), (12, "z " * 90),
    ]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    found = {r["doc_id"]: r["text"] for r in without_repeats(docs, 200, words=51, gram=40, block=block).collect()}
    assert found == brute_words(rows, 200, 51)
    assert found[3] == "" and short not in found[1] + found[2] and twin not in found[9]
    assert fifty in found[4] and fifty in found[5]
