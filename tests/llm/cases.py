"""Rows with every odd case, shared by the tests of this folder."""

import random

# Columns beyond those of documents, with names that the operators use themselves.
SCHEMA = (
    "doc_id long, text string, lang string, source string, n_chars long, node long, size long, spans string, "
    "batch int, score double, row string, kept boolean, __th long"
)
WORDS = {
    "en": "the of and to in that was for with this thing water under house river stone light".split(),
    "de": "der die und das nicht auf mit sich eine wasser haus fluss stein licht gestern heute".split(),
    "fr": "le la les des une dans que qui pour avec eau maison fleuve pierre lumiere hier".split(),
}


def sentence(rng: random.Random, lang: str, n: int) -> str:
    return " ".join(
        rng.choice(WORDS[lang]) if rng.random() < 0.5 else "".join(rng.choice(WORDS[lang]) for _ in range(2))
        for _ in range(n)
    )


def documents(seed: int = 5) -> list[tuple]:
    """About sixty rows: plain ones, copies, near copies, passages, and the odd cases."""
    rng = random.Random(seed)
    texts: list[tuple[int | None, str | None, str | None, str | None]] = []
    for i in range(30):
        lang = ("en", "de", "fr")[i % 3]
        texts.append((i, sentence(rng, lang, rng.randint(30, 160)), lang, f"s{i % 4}"))
    base = texts[0][1]
    words = texts[3][1].split()
    passage = sentence(rng, "en", 80)
    texts += [
        (40, base, "en", "s0"),
        (41, base, "en", "s9"),
        (42, base.upper(), "en", None),
        (43, " ".join(words[:-2] + ["other", "end"]), "en", "s1"),
        (44, " ".join(["new"] + words), "en", "s1"),
        (45, sentence(rng, "en", 40) + " " + passage + " " + sentence(rng, "en", 40), "en", "s2"),
        (46, sentence(rng, "en", 60) + "\n" + passage + "\n" + sentence(rng, "en", 20), "en", "s2"),
        (47, passage[30:], "en", "s3"),
        (50, None, "en", "s0"),
        (51, "", "de", "s1"),
        (52, " \t\n\x0b\x0c\r ", None, "s1"),
        (53, "one", "en", "s2"),
        (54, "one", "en", "s2"),
        (55, "two words", None, None),
        (56, "12345 678 !!! ---", "en", "s0"),
        (57, "ünïcödé wörds ñandú 東京 都 " * 30, "de", "s5"),
        (58, "ab" * 3000, "en", "s5"),
        (59, sentence(rng, "en", 6000), "en", "s6"),
        (60, sentence(rng, "de", 50), "de", "s0"),
        (60, sentence(rng, "de", 50), "de", "s0"),
        (None, sentence(rng, "fr", 70), "fr", "s0"),
        (None, base, "en", "s0"),
        (None, None, None, None),
        (61, "\U0001f600 " * 120, "en", "s7"),
    ]
    texts.append(texts[5])  # a repeated row
    return [
        (i, t, lang, source, None if t is None else len(t), 7, 1, "x", 2, 0.5, "y", True, 3)
        for i, t, lang, source in texts
    ]


def frame(spark, rows=None):
    return spark.createDataFrame(documents() if rows is None else rows, SCHEMA)


def shingles(text: str | None, size: int) -> frozenset:
    words = text.encode().lower().split() if text else []
    if not words:
        return frozenset()
    return frozenset(tuple(words[i : i + size]) for i in range(max(1, len(words) - size + 1)))
