import pytest

from newsloom.llm import decontaminate as module
from newsloom.llm.decontaminate import contaminated

from .cases import documents, frame, shingles


def items(rows):
    long = next(r[1] for r in rows if r[0] == 59).split()
    other = next(r[1] for r in rows if r[0] == 4).split()
    return [
        (1, " ".join(long[1000:1040])),
        (2, " ".join(long[5900:5930] + ["changed"] * 2).upper()),
        (3, " ".join(other[3:20])),
        (4, "nothing of this stands in any of the documents at all"),
        (5, "one"),
        (6, None),
        (7, ""),
        (8, " ".join(long[10:30] + ["something", "else"] * 10)),
        (None, " ".join(other[5:25])),
        (9, "two words"),
    ]


def brute(rows, wanted):
    out = set()
    for doc, text, *_ in rows:
        have = shingles(text, 5)
        for item, said in wanted:
            want = shingles(said, 5)
            if want and len(have & want) >= 0.8 * len(want):
                out.add((doc, item, len(have & want), len(want)))
    return out


@pytest.mark.parametrize("limit", [module.BROADCAST_ROWS, 0])
def test_against_brute_force(spark, limit):
    """Without broadcasts too."""
    rows = documents()
    benchmark = spark.createDataFrame([(*x, "c") for x in items(rows)], "item_id long, text string, doc_id string")
    found = contaminated(frame(spark), benchmark, limit=limit).select("doc_id", "item_id", "shared", "item_shingles")
    assert {tuple(r) for r in found.collect()} == brute(rows, items(rows))


def test_empty_tables(spark):
    benchmark = spark.createDataFrame(items(documents()), "item_id long, text string")
    assert contaminated(frame(spark, []), benchmark).collect() == []
    assert contaminated(frame(spark), benchmark.limit(0)).collect() == []


def test_no_python_on_the_main_path(spark):
    benchmark = spark.createDataFrame(items(documents()), "item_id long, text string")
    plan = contaminated(frame(spark), benchmark)._jdf.queryExecution().toString()
    assert not any(x in plan for x in ("Python", "Pandas", "MapInArrow", "ArrowEval"))


@pytest.mark.parametrize("limit", [module.BROADCAST_ROWS, 0])
def test_short_items_in_long_documents(spark, limit):
    """Items of 5 to 12 words, some of them changed at the end, each in a document of thousands of words."""
    words = [f"w{i}" for i in range(9000)]
    docs = [(1, " ".join(words), None), (2, " ".join(words[4500:]), None)]
    wanted = [(100 * n + k, " ".join(words[700 * k + 60 * n :][:n])) for n in range(5, 13) for k in range(12)]
    wanted += [(5000 + n, " ".join(words[8000 + 20 * n :][: n - 1] + ["changed"])) for n in range(5, 13)]
    benchmark = spark.createDataFrame(wanted, "item_id long, text string")
    frame_of = spark.createDataFrame(docs, "doc_id long, text string, lang string")
    found = contaminated(frame_of, benchmark, limit=limit).select("doc_id", "item_id", "shared", "item_shingles")
    assert {tuple(r) for r in found.collect()} == brute(docs, wanted)
