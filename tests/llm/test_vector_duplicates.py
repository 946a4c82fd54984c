import numpy as np
import pytest

from newsloom.llm.vector_duplicates import vector_duplicates

SCHEMA = "vec_id long, embedding array<float>, label int, rep long, tops string"


def vectors(seed=0, n=400, dims=24):
    rng = np.random.default_rng(seed)
    rows = [(i, rng.normal(size=dims).astype("float32").tolist(), i % 3) for i in range(n)]
    base = np.array(rows[0][1])
    for i in range(120):  # a dense group, links and near misses
        rows.append((1000 + i, (base + rng.normal(size=dims) * 0.02 * (1 + i % 9)).astype("float32").tolist(), 0))
    rows += [(2000 + i, rows[7][1], 1) for i in range(30)]  # copies
    rows += [(2100, [2 * x for x in rows[7][1]], 1), (2101, rows[7][1], 2), (2102, rows[7][1], None)]
    rows += [
        (3000, None, 0), (3001, [], 0), (3002, [0.0] * dims, 0), (3003, [float("nan")] + [1.0] * (dims - 1), 0),
        (3004, [float("inf")] + [1.0] * (dims - 1), 0), (3005, [None] + [1.0] * (dims - 1), 0), (3006, [1.0, 2.0], 0),
        (3007, [1.0, 2.0], 0), (None, rows[8][1], 2), (None, None, None), (3008, [1e30] * dims, 2), (3009, [1e30] * dims, 2),
    ]
    rows.append(rows[8])
    return [(i, v, label, 9, "x") for i, v, label in rows]


def brute(rows, threshold=0.98):
    sound = []
    for _, v, label, *_ in rows:
        good = v is not None and label is not None and len(v) and None not in v and np.isfinite(v).all() and np.any(v)
        sound.append(np.array(v, dtype="float32").astype(float) / max(map(abs, v)) if good else None)
    links = [[] for _ in rows]
    for i in range(len(rows)):
        for j in range(i):
            a, b = sound[i], sound[j]
            if a is not None and b is not None and rows[i][2] == rows[j][2] and len(a) == len(b):
                if a @ b / (np.linalg.norm(a) * np.linalg.norm(b)) >= threshold:
                    links[i].append(j)
                    links[j].append(i)
    root = list(range(len(rows)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i, others in enumerate(links):
        for j in others:
            root[find(i)] = find(j)
    out = []
    for i, r in enumerate(rows):
        ids = [s[0] for k, s in enumerate(rows) if find(k) == find(i) and s[0] is not None]
        least = min(ids, default=None)
        out.append((r[0], len(links[i]), least, r[0] == least))
    return sorted(out, key=str)


@pytest.mark.parametrize("tile", [512, 16])
def test_against_brute_force(spark, tile):
    rows = vectors()
    found = sorted(
        (tuple(r) for r in vector_duplicates(spark.createDataFrame(rows, SCHEMA), tile=tile).collect()), key=str
    )
    want = brute(rows)
    have, all_of = sum(r[1] for r in found), sum(r[1] for r in want)
    assert have >= 0.99 * all_of
    by_id = {str(w[0]): w for w in want if w[0] is not None}
    for r in found:  # none below the threshold
        if r[0] is not None:
            assert r[1] <= by_id[str(r[0])][1]
    if have == all_of:
        assert found == want


def test_empty_table(spark):
    assert vector_duplicates(spark.createDataFrame([], SCHEMA)).collect() == []
