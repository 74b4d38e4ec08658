"""Hard negatives against all scores."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from tessera.llm import negatives

SCHEMA = "vec_id long, embedding array<double>, label int"


def brute(rows, every=50, k=5, most=3, low=50, high=95):
    by = {}
    for i, v, label in rows:
        if i is not None and label is not None and v is not None and all(x is not None and math.isfinite(x) for x in v):
            row = (label, [math.floor(x * 256) for x in v])
            by[i] = min(by.get(i, row), row)
    out = []
    for a, (label, q) in by.items():
        if a % every:
            continue
        score = {i: sum(x * y for x, y in zip(q, r, strict=True)) for i, (_, r) in by.items() if i != a and len(r) == len(q)}
        first = lambda ids, n: sorted(ids, key=lambda i: (-score[i], i))[:n]
        for p in first([i for i in score if by[i][0] == label], k):
            found = first([i for i in score if by[i][0] != label and low * score[p] <= 100 * score[i] <= high * score[p]], most)
            out += [(a, p, rank, n, score[p], score[n]) for rank, n in enumerate(found, 1)]
    return sorted(out)


def mined(df, every=50, **more):
    return sorted(map(tuple, negatives.mine_hard_negatives(df, F.col("vec_id") % every == 0, **more).collect()))


@pytest.fixture(scope="module")
def rows():
    rng, out = np.random.default_rng(4), []
    for i in range(900):
        n = 3 if i % 9 == 0 else 16
        v = rng.normal(size=n) * (rng.choice([0.01, 1, 40]) if i % 5 else 0)  # zeros tie with each other
        out.append((i, [float(x) for x in np.round(v, 1 if i % 2 else 6)], int(rng.integers(-1, 3))))
    out += [(1000 + i, out[i % 7][1], i % 3) for i in range(200)]  # copies under other ids
    odd = [None, [], [float("nan")] * 16, [float("inf")] * 16, [None] * 16, [0.5] * 16, [-0.5] * 16]
    out += [(2000 + 25 * i, v, i % 2) for i, v in enumerate(odd * 4)] + [(None, [0.5] * 16, 1), (2500, [0.5] * 16, None)]
    return [*out, *out[:30], (50, [9.0] * 16, 2), (50, [9.0] * 16, -1), (57, [9.0] * 16, 1)]


@pytest.mark.parametrize("every", [50, 10])
def test_against_all_scores(spark, rows, every):
    want = brute(rows, every)
    assert len(want) > 100 and len({r[0] for r in want}) > 10
    assert mined(spark.createDataFrame(rows, SCHEMA).repartition(5), every) == want


def test_batches_of_anchors(spark, rows, monkeypatch):
    monkeypatch.setattr(negatives, "ANCHORS", 9)
    assert mined(spark.createDataFrame(rows, SCHEMA)) == brute(rows)


def test_other_windows(spark, rows):
    assert mined(spark.createDataFrame(rows, SCHEMA), 25, k=2, most=6, low=10, high=100) == brute(rows, 25, 2, 6, 10, 100)


def test_odd_tables(spark):
    assert mined(spark.createDataFrame([], SCHEMA)) == []
    df = spark.createDataFrame([(0, [1.0], 0), (1, [2.0], 0), (2, [1.5], 1), (3, [1.9], 1), (4, [1.0], None)], SCHEMA).selectExpr("*", "1 as id", "'x' as q", "2 as anchor", "3 as dim")
    assert mined(df) == [(0, 1, 1, 3, 131072, 124416), (0, 1, 2, 2, 131072, 98304)]
    with pytest.raises(ValueError):
        mined(spark.createDataFrame([(0, [1e300], 0)], SCHEMA))


def test_bounds_pass_most_rows_over():
    """Few rows of a large part are scored exactly."""
    rng = np.random.default_rng(1)
    q = np.floor(256 * (x := rng.normal(size=(4000, 64))) / np.linalg.norm(x, axis=1, keepdims=True)).astype(np.int64)
    cells = negatives.Cells([sorted(np.quantile(q[:, d], np.arange(1, 256) / 256).astype(int)) for d in range(64)], q.min(0).tolist(), q.max(0).tolist())
    c = cells.of(q)
    low, high = cells.low[np.arange(64), c], cells.high[np.arange(64), c]
    assert (low <= q).all() and (q <= high).all()
    up, down = np.maximum(q[:50], 0), np.maximum(-q[:50], 0)
    least, most, score = up @ low.T - down @ high.T, up @ high.T - down @ low.T, q[:50] @ q.T
    assert (least <= score).all() and (score <= most).all()
    assert (most >= np.sort(least, 1)[:, -5:-4]).mean() < 0.01
