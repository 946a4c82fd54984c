import numpy as np
import pytest

from newsloom.llm.mixing import fit_budget, mix_sources

from .cases import documents, frame


def targets(sizes: dict, cap: int) -> dict:
    order = sorted((s for s in sizes if s is not None), key=lambda s: [ord(c) for c in s]) + [None] * (None in sizes)
    weight = {s: i % 3 + 1 for i, s in enumerate(order)}
    total, fixed = sum(sizes.values()), {}
    while True:
        free = [s for s in order if s not in fixed]
        level = (total - sum(fixed.values())) / sum(weight[s] for s in free) if free else 0
        over = [s for s in free if level * weight[s] > cap * sizes[s]]
        if not over:
            return fixed | {s: level * weight[s] for s in free}
        fixed |= {s: cap * sizes[s] for s in over}


@pytest.mark.parametrize("carry", [False, True])
def test_targets_and_what_is_taken(spark, carry):
    rows = documents()
    found = mix_sources(frame(spark), carry=carry).collect()
    assert len(found) == len(rows)
    size = lambda t: len(t.encode().split()) if t else 0
    assert sorted((str(r["doc_id"]), r["size"]) for r in found) == sorted((str(r[0]), size(r[1])) for r in rows)
    sizes: dict = {}
    for r in rows:
        sizes[r[3]] = sizes.get(r[3], 0) + size(r[1])
    want = targets(sizes, 3)
    source = {(r[0], size(r[1])): r[3] for r in rows}
    taken = dict.fromkeys(sizes, 0)
    for r in found:
        s = source[r["doc_id"], r["size"]]
        assert r["source_size"] == sizes[s]
        assert r["target"] == pytest.approx(want[s])
        assert r["taken"] == r["size"] * r["copies"] and 0 <= r["copies"] <= 3
        taken[s] += r["taken"]
        if carry:
            assert r["row"]["size"] == 1 and r["row"]["source"] == s
    for s in sizes:
        smallest = min((size(r[1]) for r in rows if r[3] == s and size(r[1])), default=0)
        assert abs(taken[s] - want[s]) <= max(smallest, 1) or len([r for r in rows if r[3] == s]) < 4


def test_reruns_agree(spark):
    once, again = (sorted(map(str, mix_sources(frame(spark)).collect())) for _ in range(2))
    assert once == again


def test_empty_table(spark):
    assert mix_sources(frame(spark, [])).collect() == []


def test_budget_is_met_as_well_as_any_subset_does():
    rng = np.random.default_rng(0)
    for turn in range(60):
        sizes = np.unique(rng.integers(1, 60, 8))
        counts = rng.integers(0, 5, len(sizes))
        whole = int((sizes * counts).sum())
        budget = int(rng.integers(0, whole + 1))
        reachable = {0}
        for s, n in zip(sizes, counts, strict=True):
            reachable = {x + k * int(s) for x in reachable for k in range(int(n) + 1)}
        taken = fit_budget(sizes, counts, budget, seed=turn, exact=10 if turn % 2 else 10_000)
        assert (taken >= 0).all() and (taken <= counts).all()
        got = int((sizes * taken).sum())
        assert got in reachable and got <= budget
        if turn % 2 == 0:
            assert got == max(x for x in reachable if x <= budget)


def test_every_length_gives_its_share():
    """Almost every length is that of one document, as in real sources: no quartile is preferred."""
    rng = np.random.default_rng(1)
    sizes, counts = np.unique(rng.lognormal(5.5, 1.0, 6000).astype(np.int64) + 1, return_counts=True)
    whole = int((sizes * counts).sum())
    for share in (0.05, 0.13, 0.5, 0.9):
        budget = int(share * whole)
        taken = fit_budget(sizes, counts, budget, seed=3)
        assert int((sizes * taken).sum()) == budget
        place = np.cumsum(counts) / counts.sum()
        for q in range(4):
            own = (place > q / 4) & (place <= (q + 1) / 4)
            assert abs(taken[own].sum() / counts[own].sum() - share) < 0.04


def test_one_long_document_among_short_ones():
    sizes, counts = np.array([1, 5, 3_000_000]), np.array([50, 40, 2])
    for budget in (100, 2_999_000, 3_000_120, 6_000_100):
        got = int((sizes * fit_budget(sizes, counts, budget)).sum())
        assert got <= budget and budget - got <= max(0, budget % 3_000_000 - 250) + (budget < 3_000_000) * budget


def test_another_seed_takes_other_documents(spark):
    taken = []
    for seed in (17, 99):
        found = mix_sources(frame(spark, documents(seed=4)), seed=seed).collect()
        taken.append({(r["doc_id"], r["copies"]) for r in found})
    assert taken[0] != taken[1]
    a, b = (fit_budget(np.arange(1, 400), np.ones(399, dtype=np.int64), 20_000, seed=s) for s in (1, 2))
    assert (a != b).sum() > 100 and (np.arange(1, 400) * a).sum() == (np.arange(1, 400) * b).sum() == 20_000


def test_many_equal_rows_are_taken_in_part(spark):
    """A source of one text many times over, with and without ids: as many copies as the target asks for."""
    rows = [(1, "a b c d", "en", "s0")] * 300 + [(None, "a b c d", "en", "s0")] * 300
    rows += [(i, f"w{i} x y z", "en", "s1") for i in range(900)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")
    found = mix_sources(docs).collect()
    assert len(found) == 1500
    for size, target in ((2400, 2000), (3600, 4000)):
        own = [r for r in found if r["source_size"] == size]
        assert sum(r["taken"] for r in own) == target
