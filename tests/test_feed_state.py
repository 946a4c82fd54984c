import json
import random

import pytest
from pyspark.sql import functions as F

from newsloom.session import scratch_path
from newsloom.sources import feed_state
from newsloom.sources.feed_state import FeedState, merged_ranges, missing_ranges, page_ranges, read_pages, unread_pages
from newsloom.sources.story_feed import unread_stories

RANGES = "feed string, first long, last long"


def rows(df):
    return sorted(tuple(r) for r in df.collect())


def plain(ranges):
    """Merged ranges and gaps by marking every offset."""
    merged, gaps = [], []
    for feed in {f for f, _, _ in ranges}:
        own = sorted((a, b) for f, a, b in ranges if f == feed)
        islands = []
        for a, b in own:
            if islands and a <= islands[-1][1]:
                islands[-1][1] = max(b, islands[-1][1])
            else:
                islands.append([a, b])
        merged += [(feed, a, b) for a, b in islands]
        at = 0
        for a, b in islands:
            if at < a:
                gaps.append((feed, at, a))
            at = b
    return sorted(merged), sorted(gaps)


@pytest.mark.parametrize("chunk", [100_000, 7])
def test_random_ranges_against_plain_merging(spark, monkeypatch, chunk):
    monkeypatch.setattr(feed_state, "CHUNK", chunk)
    rng = random.Random(chunk)
    ranges = [(rng.choice("ab"), a, a + rng.randint(1, 12)) for a in (rng.randint(0, 300) for _ in range(60))]
    merged, gaps = plain(ranges)
    df = spark.createDataFrame(ranges, RANGES)
    assert rows(merged_ranges(df)) == merged
    assert rows(missing_ranges(df)) == gaps
    pages = [("a", i, rng.randint(1, 9)) for i in range(0, 320, 3)] + [("c", 1, 2), (None, 1, 2), ("a", 5, 0)]
    unread = unread_pages(spark.createDataFrame(pages, "feed string, offset long, size long"), df)
    known = [(f, a, b) for f, a, b in merged]
    want = [p for p in pages if p[0] is None or p[2] < 1 or not any(p[0] == f and a <= p[1] and p[1] + p[2] <= b for f, a, b in known)]
    assert sorted(map(str, (tuple(r) for r in unread.collect()))) == sorted(map(str, want))


def test_odd_pages_cover_nothing(spark):
    pages = spark.createDataFrame(
        [("a", 0, 5), ("a", None, 5), (None, 0, 5), ("a", 9, 0), ("a", -3, 2), ("a", 7, None)], "feed string, offset long, size long"
    )
    assert rows(page_ranges(pages)) == [("a", 0, 5)]
    empty = spark.createDataFrame([], RANGES)
    assert rows(merged_ranges(empty)) == rows(missing_ranges(empty)) == []


def land(folder, name, feed, offset, ids):
    import os

    os.makedirs(f"{folder}/pages", exist_ok=True)
    page = {"feed": feed, "offset": offset, "size": 3, "content_elements": [{"_id": i} for i in ids]}
    with open(f"{folder}/pages/{name}.json", "w") as f:
        f.write(json.dumps(page) + "\n")


def test_runs_with_overlap_gap_and_repeat(spark, tmp_path):
    folder = str(tmp_path)
    state = FeedState(spark, scratch_path(spark, "state"))
    with open(f"{folder}/stories.json", "w") as f:
        for i in range(12):
            f.write(json.dumps({"_id": f"s{i}", "canonical_url": f"/p/{i}", "headlines": {"basic": f"Story {i}"}}) + "\n")

    def read(run):
        found = sorted(r["story_id"] for r in unread_stories(spark, f"{folder}/pages", f"{folder}/stories.json", state, run).collect())
        state.record(state.unread(read_pages(spark, f"{folder}/pages"), run), run)
        return found

    land(folder, "p0", "x", 0, ["s0", "s1", "s2"])
    land(folder, "p1", "x", 2, ["s2", "s3", None])  # overlaps
    assert read("r1") == ["s0", "s1", "s2", "s3"]
    assert read("r1") == ["s0", "s1", "s2", "s3"]  # the run is repeated as a whole
    land(folder, "p2", "x", 8, ["s8", "s9", "s10"])
    assert read("r2") == ["s10", "s8", "s9"]  # pages of the first run are not read again
    assert rows(state.missing()) == [("x", 5, 8)]
    land(folder, "p3", "x", 5, ["s5", "s6", "s7"])
    assert read("r3") == ["s5", "s6", "s7"]
    assert rows(state.missing()) == []
    assert rows(merged_ranges(state.ranges())) == [("x", 0, 11)]
    assert state.ranges().where(F.col("feed").isNull()).count() == 0
