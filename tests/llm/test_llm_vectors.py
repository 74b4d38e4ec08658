"""Near-duplicate vectors against all pairs."""

import math

import numpy as np
import pytest

from tessera.llm import vectors

SCHEMA = "vec_id long, embedding array<double>, label int"


def brute(rows, least=0.98):
    def can(v, label):
        return label is not None and v is not None and all(x is not None and math.isfinite(x) for x in v) and any(v)

    n = len(rows)
    links = [set() for _ in rows]
    for i in range(n):
        for j in range(i):
            (_, v, a), (_, w, b) = rows[i], rows[j]
            if can(v, a) and can(w, b) and a == b and len(v) == len(w):
                x, y = (np.array(u) / max(map(abs, u)) for u in (v, w))
                if x @ y / math.sqrt(x @ x) / math.sqrt(y @ y) >= least:
                    links[i].add(j)
                    links[j].add(i)
    comp = list(range(n))
    while (new := [min(comp[k] for k in {i, *links[i]}) for i in range(n)]) != comp:
        comp = new
    out = []
    for i, (key, _, _) in enumerate(rows):
        c = min((rows[j][0] for j in range(n) if comp[j] == comp[i] and rows[j][0] is not None), default=None)
        out.append((key, len(links[i]), c, key == c))
    return sorted(out, key=repr)


def near(rng, x, cos):
    z = rng.normal(size=len(x))
    z -= z @ x * x / (x @ x)
    return cos * x / np.linalg.norm(x) + math.sqrt(1 - cos * cos) * z / np.linalg.norm(z)


def found(spark, rows, **more):
    return sorted((tuple(r) for r in vectors.near_duplicate_vectors(spark.createDataFrame(rows, SCHEMA), **more).collect()), key=repr)


@pytest.fixture(scope="module")
def rows():
    rng, out = np.random.default_rng(11), []
    for b in range(40):  # chains and groups on both sides of the bound
        x = rng.normal(size=64)
        out.append((x, b % 3))
        for cos in (0.999, 0.9801, 0.9799, 0.97, 0.985, 0.99):
            x = near(rng, x, cos) * float(rng.choice([1e-200, 1.0, 3.0, 1e200]))
            x = x / (1 if abs(np.abs(x).max()) < 1e150 and np.abs(x).max() > 1e-150 else np.abs(x).max())
            out.append((x, b % 3 if cos != 0.97 else 7))
    x = rng.normal(size=64)
    out += [(near(rng, x, 0.992), 5) for _ in range(150)] + [(x, 5)] * 20 + [(-x, 5)] * 3 + [(2 * x, 5), (x * 1e300 / np.abs(x).max(), 5), (x, 6)]
    out += [(rng.normal(size=3) if k % 2 else [1.0, 0.01 * k, 0.0], 1) for k in range(30)] + [([2.0], 1), ([5.0], 1), ([-1.0], 1)]
    odd = [None, [], [0.0] * 64, [float("nan")] * 64, [float("inf"), 1.0], [None, 1.0], [1.0, 0.0], [1.0, -0.0]]
    ids = rng.permutation(len(out) + 2 * len(odd) + 4)
    out = [(int(i), v if v is None else [x if x is None else float(x) for x in v], label) for i, (v, label) in zip(ids, [*out, *[(v, 1) for v in odd * 2], *[(x, None)] * 2], strict=False)]
    return [*out, (None, [float(v) for v in x], 5), (None, [9.0, 1.0, 5.0, 5.0], 2), out[0], out[0]]


def test_links_and_components_against_all_pairs(spark, rows):
    want = brute(rows)
    assert sum(r[1] for r in want) > 10_000
    assert found(spark, rows) == want


def test_buckets_of_many_blocks(spark, rows, monkeypatch):
    monkeypatch.setattr(vectors, "BLOCK", 7)
    assert found(spark, rows) == brute(rows)


def test_another_bound(spark, rows):
    some = rows[:200]
    assert found(spark, some, least=0.9) == brute(some, 0.9)


def test_extra_columns_and_no_rows(spark):
    df = spark.createDataFrame([(1, [1.0, 2.0], 0), (2, [2.0, 4.0], 0)], SCHEMA).selectExpr("*", "1 as node", "2 as size", "3 as dim", "4 as name")
    assert sorted(map(tuple, vectors.near_duplicate_vectors(df).collect())) == [(1, 1, 1, True), (2, 1, 1, False)]
    assert vectors.near_duplicate_vectors(spark.createDataFrame([], SCHEMA)).count() == 0


def test_planned_hashes_find_pairs_at_the_bound():
    rng = np.random.default_rng(5)
    for dim, n in ((16, 10), (64, 10**5), (100, 10**8)):
        h = vectors.planned(dim, n, 0.98, 0.0005)
        x = rng.normal(size=(3000, dim))
        y = np.array([near(rng, v, 0.98) for v in x])
        assert vectors.meet(h.codes(vectors.unit(x)), h.codes(vectors.unit(y))).any(-1).any(-1).mean() > 0.997
        assert (2 * h.d) ** h.k >= n
