"""Each stage of the pipeline against a plain version of it, on what the stage before has kept."""

import random
from collections import Counter

import regex

from newsloom.llm import pipeline
from newsloom.llm.suffix_dedup import joined_spans

from .cases import SCHEMA, documents, sentence, shingles
from .test_mixing import targets


def tables(spark, folder, rows):
    import random

    rng = random.Random(77)
    item = sentence(rng, "en", 30)
    holder = sentence(rng, "en", 50) + " " + item + " " + sentence(rng, "en", 50)
    more = [(500, holder, "en", "s0", len(holder), *rows[0][5:])] if rows else []
    spark.createDataFrame(rows + more, SCHEMA).write.parquet(f"{folder}/documents.parquet")
    items = [(1, item), (2, "an item that no document holds anywhere in its text"), (3, None)]
    spark.createDataFrame(items, "item_id long, text string").write.parquet(f"{folder}/benchmark.parquet")
    return items


def near(rows):
    sets = [shingles(r["text"], 5) for r in rows]
    root = list(range(len(rows)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i in range(len(rows)):
        for j in range(i):
            both = len(sets[i] & sets[j])
            if both and 100 * both >= 80 * len(sets[i] | sets[j]):
                root[find(i)] = find(j)
    return [find(i) for i in range(len(rows))]


def cut(rows, size):
    data = [(r["text"] or "").encode() for r in rows]
    seen: dict = {}
    for b in data:
        for i in range(len(b) - size + 1):
            seen[b[i : i + size]] = seen.get(b[i : i + size], 0) + 1
    out = []
    for b in data:
        spans = joined_spans([(i, i + size) for i in range(len(b) - size + 1) if seen[b[i : i + size]] > 1])
        text, at = b"", 0
        for start, end in spans:
            while start < end and b[start] & 0xC0 == 0x80:
                start += 1
            while end > start and end < len(b) and b[end] & 0xC0 == 0x80:
                end -= 1
            text, at = text + b[at:start], end
        text = (text + b[at:]).decode()
        if text.encode().split():
            out.append(text)
    return out


def test_stages_against_plain_versions(spark, tmp_path):
    folder = str(tmp_path)
    items = tables(spark, folder, documents())
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    seen = {}
    for name, stage in pipeline.STAGES:
        before = docs.collect()
        out = f"{folder}/{name}"
        stage(spark, docs, folder).write.parquet(out)
        columns, docs = docs.columns, spark.read.parquet(out)
        seen[name] = before, docs.collect()
        assert docs.columns[: len(columns)] == columns

    before, after = seen["language"]
    letters = [r for r in before if r["text"] and regex.search(r"\p{L}", r["text"])]
    assert {str(r["text"]) for r in after} <= {str(r["text"]) for r in letters}
    plain = [r for r in letters if r["doc_id"] is not None and r["doc_id"] < 50]
    assert {r["doc_id"] for r in plain} <= {r["doc_id"] for r in after}

    before, after = seen["near_duplicates"]
    groups = near(before)
    assert len({(r["doc_id"], r["text"]) for r in after}) == len(set(groups))
    for g in set(groups):
        ids = [before[i]["doc_id"] for i in range(len(before)) if groups[i] == g]
        known = [i for i in ids if i is not None]
        assert not known or min(known) in {r["doc_id"] for r in after}

    before, after = seen["repeats"]
    assert sorted(r["text"] for r in after) == sorted(cut(before, pipeline.REPEAT_BYTES))
    assert all(r["n_chars"] == len(r["text"]) for r in after)

    before, after = seen["decontaminate"]
    wanted = [shingles(t, 5) for _, t in items if t]
    clean = [r for r in before if not any(len(w & shingles(r["text"], 5)) >= 0.8 * len(w) for w in wanted)]
    assert sorted(map(str, after)) == sorted(map(str, clean))
    assert 500 in {r["doc_id"] for r in before} and 500 not in {r["doc_id"] for r in after}

    before, after = seen["mixture"]
    sizes: dict = {}
    for r in before:
        sizes[r["source"]] = sizes.get(r["source"], 0) + len(r["text"].encode().split())
    want = targets(sizes, 3)
    for r in after:
        assert r["target"] == want[r["source"]] or abs(r["target"] - want[r["source"]]) < 1e-6
        assert 1 <= r["copies"] <= 3 and r["mix_size"] * r["copies"] == r["taken"]


def test_run_gives_the_rows_of_the_stages(spark, tmp_path):
    tables(spark, str(tmp_path), documents(seed=9)[:12])
    docs = spark.read.parquet(f"{tmp_path}/documents.parquet")
    for n, (_, stage) in enumerate(pipeline.STAGES):
        stage(spark, docs, str(tmp_path)).write.parquet(f"{tmp_path}/{n}")
        docs = spark.read.parquet(f"{tmp_path}/{n}")
    assert sorted(map(str, pipeline.run(spark, str(tmp_path)).collect())) == sorted(map(str, docs.collect()))


def test_empty_tables(spark, tmp_path):
    tables(spark, str(tmp_path), [])
    assert pipeline.run(spark, str(tmp_path)).collect() == []


def test_passages_of_more_than_fifty_short_words_are_cut(spark, tmp_path):
    rng = random.Random(4)
    short = " ".join(rng.choice("abcdefghij") for _ in range(51))
    rows = documents(seed=3)[:4]
    rows = [(r[0], f"{r[1]} {short}", *r[2:]) for r in rows]
    tables(spark, str(tmp_path), rows)
    docs = spark.read.parquet(f"{tmp_path}/documents.parquet").where("doc_id <> 500")
    for r in pipeline.repeats(spark, docs, str(tmp_path)).collect():
        assert short not in r["text"] and r["n_chars"] == len(r["text"])


def test_every_group_of_texts_keeps_one(spark, tmp_path):
    """Ids that have two texts, of which one is a copy of another document's."""
    rng = random.Random(8)
    a, b = sentence(rng, "en", 60), sentence(rng, "en", 60)
    more = documents()[0][2:]
    rows = [(3, a, *more), (60, a, *more), (60, b, *more), (90, b, *more), (90, b, *more)]
    docs = spark.createDataFrame(rows, SCHEMA)
    kept = pipeline.near_duplicate_groups(spark, docs, str(tmp_path)).collect()
    assert sorted((r["doc_id"], r["text"]) for r in kept) == [(3, a), (60, b)]


def test_one_of_repeated_rows_stays(spark, tmp_path):
    """Copies with ids, without ids, and with other columns; long ones would be cut out of one another."""
    plain = documents(seed=3)[:6]
    other = plain[5][0], sentence(random.Random(1), "de", 60), *plain[5][2:]
    null = None, sentence(random.Random(2), "en", 90), *plain[0][2:]
    also = *plain[3][:3], "s8", *plain[3][4:]
    blank = 99, " ", *plain[0][2:]
    rows = plain + plain[2:4] * 3 + [also, other, other, null, null, null, blank, blank]
    folder = str(tmp_path)
    tables(spark, folder, rows)
    docs = spark.read.parquet(f"{folder}/documents.parquet").where("doc_id IS NULL OR doc_id <> 500")
    kept = pipeline.near_duplicate_groups(spark, docs, folder).collect()
    wanted = [(r[0], r[1]) for r in [*plain, other, null, blank, blank]]
    assert Counter((r["doc_id"], r["text"]) for r in kept) == Counter(wanted)
    pipeline.near_duplicate_groups(spark, docs, folder).write.parquet(f"{folder}/near")
    left = pipeline.repeats(spark, spark.read.parquet(f"{folder}/near"), folder).collect()
    assert Counter((r["doc_id"], r["text"]) for r in left) == Counter((i, t) for i, t in wanted if t.strip())
