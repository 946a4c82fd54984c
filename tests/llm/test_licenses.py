import random
import re

from newsloom.llm.licenses import TEMPLATES, Scanner, bands_for, scan_licenses
from newsloom.llm.spans import words_of

from .cases import documents, frame

PLAIN = {
    "apache-2.0": r"licensed under the apache license, version 2\.0\.",
    "mit": r"(released|licensed) under the mit license\.",
    "gpl-3.0": r"this work is licensed under the gnu general public license, version 3\.",
    "cc-by-nc-4.0": r"licensed under cc by-nc 4\.0\.",
}


def test_every_notice_is_found_anywhere_in_a_long_text():
    scanner = Scanner(TEMPLATES, 5, 0.8)
    filler = ["filler%d" % i for i in range(3000)]
    for name, texts in TEMPLATES.items():
        for n, text in enumerate(texts):
            for at in (0, 1, 17, 1500 + n, 3000):
                said = " ".join(filler[:at] + [text.upper()] + filler[at:])
                found = scanner.scan([words_of(said), b"", words_of("nothing here")])
                assert found[0][name][0] == 1.0 and found[1:] == [{}, {}]


def test_changed_notices_above_and_below_the_threshold():
    scanner = Scanner(TEMPLATES, 5, 0.8)
    words = TEMPLATES["mit"][2].split()
    near, far = list(words), list(words)
    near[30] = "changed"
    far[10] = far[25] = far[40] = far[55] = "changed"
    filler = " ".join(f"f{i}" for i in range(500))
    found = scanner.scan([words_of(f"{filler} {' '.join(w)} {filler}") for w in (near, far)])
    assert 0.8 <= found[0]["mit"][0] < 1
    assert "mit" not in found[1]


def brute(text, templates, size=5, threshold=0.8):
    """Every window of two blocks against every template, by sets of word tuples."""

    def runs(t):
        words = (t or "").encode().lower().split()
        return [tuple(words[i : i + size]) for i in range(max(len(words) - size + 1, 1))] if words else []

    own, best = runs(text), {}
    for name, texts in templates.items():
        for template in texts:
            wanted = set(runs(template))
            block = 1 << (len(wanted) - 1).bit_length()
            for at in range(0, len(own), block):
                share = len(wanted & set(own[at : at + (1 if block == 1 else 2 * block)])) / len(wanted)
                if share >= threshold and (-share, at) < best.get(name, (0, 0)):
                    best[name] = (-share, at)
    return {name: (-share, at) for name, (share, at) in best.items()}


def test_query_against_brute_force(spark):
    """Notices of all lengths, whole, changed, cut and doubled, anywhere in texts of words that notices use as well."""
    rng = random.Random(12)
    words = sorted({w for texts in TEMPLATES.values() for t in texts for w in t.split()})
    notices = [t for texts in TEMPLATES.values() for t in texts]

    def changed(t):
        kept = t.split()
        for _ in range(rng.choice([0, 0, 1, 2, 4])):
            kept[rng.randrange(len(kept))] = rng.choice(words)
        return " ".join(kept[rng.choice([0, 0, 0, 2]) :])

    rows = [(1, None), (2, ""), (3, notices[0]), (4, " ".join(notices)), (4, " ".join(notices))]
    for i in range(150):
        parts = [" ".join(rng.choice(words) for _ in range(rng.randint(0, 120)))]
        for _ in range(rng.randint(0, 3)):
            parts += [changed(rng.choice(notices)), " ".join(rng.choice(words) for _ in range(rng.randint(0, 60)))]
        rows.append((10 + i, " ".join(parts)))
    found = scan_licenses(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    want = [(i, name, *where) for i, t in rows for name, where in brute(t, TEMPLATES).items()]
    assert len(want) > 100
    assert sorted(tuple(r) for r in found) == sorted(want)


def test_rows_and_odd_cases(spark):
    rows = documents()
    rows += [(100 + i, f"{rows[i][1]}\n{t[0]}", "en", "s", 1, *rows[0][5:]) for i, t in enumerate(TEMPLATES.values())]
    found = scan_licenses(frame(spark, rows)).collect()
    assert {(r["doc_id"], r["license"]) for r in found} == {(100 + i, n) for i, n in enumerate(TEMPLATES)}
    for r in found:
        text = " ".join(next(x[1] for x in rows if x[0] == r["doc_id"]).lower().split())
        assert r["license"] not in PLAIN or re.search(PLAIN[r["license"]], text)


def test_empty_table(spark):
    assert scan_licenses(frame(spark, [])).collect() == []


def test_bands_leave_few_misses():
    for block, size in ((1, 1), (2, 2), (8, 5), (64, 40)):
        n = bands_for(block, size, 0.8, 1e-5)
        held = -(-4 * size // 5)
        alike = held / ((block if block == 1 else 2 * block) + size - held)
        assert (1 - alike) ** n <= 1e-5
