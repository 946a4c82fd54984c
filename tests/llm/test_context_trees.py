import math
import zlib
from collections import Counter, defaultdict

import pytest

from newsloom.llm.context_trees import gram_scores, grams_of, log_estimate, score_texts

from .cases import documents, frame


def tokens(text):
    return (text.encode().lower().split() if text else []) + [b"\n"]


def stream(text):
    return b" ".join(text.encode().lower().split()) if text else b""


def held(doc):
    return zlib.crc32(("" if doc is None else str(doc)).encode()) % 7 == 2


class Tree:
    """Context-tree weighting as the textbook has it: one node at a time."""

    def __init__(self, texts, depth):
        self.depth, self.counts = depth, defaultdict(lambda: [0, 0])
        for t in texts:
            data = b"\n" * depth + t + b"\n"
            for i in range(depth, len(data)):
                for place, bit in self.bits(data[i]):
                    for d in range(depth + 1):
                        self.counts[data[i - d : i], place][bit] += 1
        self.weighted = {}

    @staticmethod
    def bits(byte):
        return [((1 << i) | (byte >> (8 - i)), (byte >> (7 - i)) & 1) for i in range(8)]

    @staticmethod
    def own(n0, n1):
        return (
            math.lgamma(n0 + 0.5) + math.lgamma(n1 + 0.5) - math.log(math.pi) - math.lgamma(n0 + n1 + 1)
            if n0 + n1 else 0.0
        )

    def log_weighted(self, context, place):
        key = context, place
        if key not in self.weighted:
            own = self.own(*self.counts[key])
            if len(context) == self.depth:
                self.weighted[key] = own
            else:
                longer = sum(self.log_weighted(bytes([b]) + context, place) for b in self.before(context, place))
                top = max(own, longer)
                self.weighted[key] = top + math.log(math.exp(own - top) + math.exp(longer - top)) - math.log(2)
        return self.weighted[key]

    def before(self, context, place):
        return {c[0] for c, p in list(self.counts) if p == place and len(c) == len(context) + 1 and c[1:] == context}

    def chance(self, context, place):
        value, left = None, 1.0
        total = 0.0
        for d in range(self.depth + 1):
            c = context[len(context) - d :]
            if (c, place) not in self.counts:
                break
            n0, n1 = self.counts[c, place]
            estimate = (n1 + 0.5) / (n0 + n1 + 1)
            value = total + left * estimate
            stop = 1.0 if d == self.depth else math.exp(self.own(n0, n1) - math.log(2) - self.log_weighted(c, place))
            total += left * stop * estimate
            left *= 1 - stop
        return 0.5 if value is None else value

    def score(self, text):
        data, out = b"\n" * self.depth + text + b"\n", 0.0
        for i in range(self.depth, len(data)):
            for place, bit in self.bits(data[i]):
                p = self.chance(data[i - self.depth : i], place)
                out += math.log10(p if bit else 1 - p)
        return out


def test_scores_against_the_textbook(spark):
    texts = ["abab abba", "abab", "ba", None, "", "abc abd", "zz é", "abab abba"]
    rows = [(i, t) for i, t in enumerate(texts)]
    tree = Tree([stream(t) for i, t in rows if not held(i)], 2)
    found = {r["doc_id"]: r for r in score_texts(spark.createDataFrame(rows, "doc_id long, text string"), depth=2).collect()}
    assert any(held(i) for i, _ in rows)
    for i, t in rows:
        assert found[i]["score"] == pytest.approx(tree.score(stream(t)), rel=1e-9)


def test_base_scores_and_counts(spark):
    rows = documents()
    count = Counter(w for r in rows if not held(r[0]) for w in tokens(r[1]))
    whole = math.log10(sum(count.values()) + len(count) + 1)
    want = sorted(
        (
            str(r[0]), held(r[0]), len(tokens(r[1])), sum(count[w] > 0 for w in tokens(r[1])), sum(count.values()),
            round(sum(math.log10(count[w] + 1) - whole for w in tokens(r[1])), 5),
        )
        for r in rows
    )
    # several batches
    found = score_texts(frame(spark), depth=3, batch_bytes=4000).collect()
    assert want == sorted(
        (str(r["doc_id"]), r["held_out"], r["n_tokens"], r["n_known"], r["train_tokens"], round(r["base_score"], 5))
        for r in found
    )
    assert all(r["score"] < 0 for r in found)


def test_batches_do_not_matter(spark):
    one, many = (
        sorted((str(r["doc_id"]), round(r["score"], 7)) for r in score_texts(frame(spark), depth=2, batch_bytes=b).collect())
        for b in (1 << 30, 3000)
    )
    assert one == many


def test_empty_table_and_nothing_to_learn(spark):
    assert score_texts(frame(spark, [])).collect() == []
    doc = next(i for i in range(100) if held(i))
    row = score_texts(spark.createDataFrame([(doc, "ab")], "doc_id long, text string")).first()
    assert row["train_tokens"] == 0 and row["n_known"] == 0 and row["base_score"] == 0
    assert row["score"] == pytest.approx(-3 * 8 * math.log10(2))


def test_bytes_after_a_context_sum_to_one(spark):
    grams = {int(g): 1 for g in grams_of(b"hello there hello", 2)}
    context = next(iter(grams)) >> 8
    rows = [(context << 8 | b, grams.get(context << 8 | b, 0)) for b in range(256)]
    rows += [(g, n) for g, n in grams.items() if g >> 8 != context]
    found = gram_scores(spark.createDataFrame(rows, "key long, n long"), 2).collect()
    assert sum(10 ** r["value"] for r in found if r["key"] >> 8 == context) == pytest.approx(1)


def test_estimate_is_exact(spark):
    rows = [(a, b) for a in (0, 1, 3, 1000) for b in (0, 1, 2, 500_000)]
    df = spark.createDataFrame(rows, "a long, b long")
    for a, b, value in df.select("a", "b", log_estimate(df.a, df.b)).collect():
        assert value == pytest.approx(Tree.own(a, b), abs=1e-7)
