import numpy as np
import pytest

from newsloom.llm.whitening import leading_pairs, whitened

COLUMNS = "vec_id long, embedding array<float>, label int, x string, n string"


def expected(rows, components=16):
    """By numpy, on all usable rows of ``rows``."""
    x = np.array([[np.floor(64 * float(c)) + 1_000_000 for c in v] for _, v in rows], dtype=np.int64)
    fit = np.unique(x, axis=0)
    n, s = len(fit), fit.sum(axis=0)
    centred = (n * fit - s) / n
    values, vectors = np.linalg.eigh(centred.T @ centred / n)
    values, vectors = values[::-1], vectors[:, ::-1]
    k = min(components, int((values > 1e-13 * values.sum()).sum()))
    z = ((n * x - s) / n) @ vectors[:, :k] / np.sqrt(values[:k])
    return n, ((n * x - s) ** 2).sum(axis=1), z, values[:k] / values.sum()


def check(found, rows, components=16):
    n, deviation, z, shares = expected(rows, components)
    by_id = {}
    for r in found:
        by_id.setdefault(r["vec_id"], {})[r["component"]] = r
    for (vec_id, _), far, want in zip(rows, deviation, z, strict=True):
        got = by_id[vec_id]
        assert sorted(got) == list(range(1, z.shape[1] + 1))
        assert {r["n"] for r in got.values()} == {n} and {r["deviation"] for r in got.values()} == {far}
        for c, r in got.items():
            assert abs(abs(r["whitened"]) - abs(want[c - 1])) < 1e-7
            assert abs(r["explained"] - shares[c - 1]) < 1e-9 and r["identity_error"] < 1e-9


def vectors(n=300, d=24, seed=4):
    rng = np.random.default_rng(seed)
    scale = np.linspace(0.2, 3, d)
    return [(i, [float(c) for c in rng.standard_normal(d) * scale]) for i in range(n)]


def test_against_numpy_with_odd_rows(spark):
    rows = vectors()
    rows.append((900, rows[5][1]))  # a copy counts once in the fit and is whitened as well
    odd = [
        (901, None), (902, []), (903, [float("nan")] * 24), (904, [None] + [0.5] * 23), (905, [float("inf")] * 24),
        (906, [1.0] * 3), (907, [1e30] * 24),
    ]
    table = spark.createDataFrame([(*r, 1, "y", None) for r in rows + odd], COLUMNS)
    found = whitened(table).collect()
    assert {r["vec_id"] for r in found} == {i for i, _ in rows}
    check(found, rows)


def test_fewer_dimensions_than_components(spark):
    rows = [(i, [*v, v[0], 1.0]) for i, v in vectors(60, 5)]  # seven entries, five directions
    found = whitened(spark.createDataFrame([(*r, 1, "y", None) for r in rows], COLUMNS)).collect()
    assert max(r["component"] for r in found) == 5
    check(found, rows)


@pytest.mark.parametrize("rows", [[], [(1, [0.5, 1.0])], [(1, [0.5, 1.0]), (2, [0.5, 1.0])], [(1, None)]])
def test_nothing_to_whiten(spark, rows):
    table = spark.createDataFrame([(*r, 1, "y", None) for r in rows], COLUMNS)
    assert whitened(table).collect() == []


def test_deviations_beyond_a_long_are_null(spark):
    rows = [(i, [float(1 << 40) * (i % 3), float(i)]) for i in range(9)]
    found = whitened(spark.createDataFrame([(*r, 1, "y", None) for r in rows], COLUMNS)).collect()
    assert {r["deviation"] for r in found if r["vec_id"] == 0} == {None}


@pytest.mark.parametrize("spectrum", ["flat", "steep", "pairs"])
def test_eigenpairs_of_a_large_operator(spectrum):
    """Far more dimensions than the search space has, by products only."""
    rng = np.random.default_rng(8)
    d = 400
    q = np.linalg.qr(rng.standard_normal((d, d)))[0]
    e = {"flat": np.linspace(1.2, 0.8, d), "steep": 2.0 ** -np.arange(d), "pairs": np.repeat(np.linspace(2, 1, d // 2), 2)}[spectrum]
    a = (q * e) @ q.T
    calls = []

    def product(p):
        calls.append(p.shape[1])
        return a @ p

    values, u = leading_pairs(product, d, 16)
    assert np.abs(values - e[:16]).max() < 1e-12 * e[0]
    assert np.linalg.norm(a @ u - u * values, axis=0).max() < 1e-11 * e[0]
    assert np.abs(u.T @ u - np.eye(16)).max() < 1e-12
    assert len(calls) < d  # fewer passes over the data than dimensions
