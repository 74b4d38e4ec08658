"""Exact nearest rows against SQL and brute force."""

import duckdb
import numpy as np

from tessera.operators.learning import nearest_neighbours
from tessera.operators.nearest import nearest
from tessera.plans import registry


def test_odd_vectors_and_copies_as_in_sql(spark, tmp_path):
    rng = np.random.default_rng(5)
    rows = [(i, [float(x) for x in rng.normal(size=6).astype(np.float32)], int(rng.integers(10)) if i % 17 else None) for i in range(700)]
    for i in range(0, 700, 9):  # copies, so that keys decide
        rows[i] = (i, rows[3][1], rows[i][2])
    odd = [None, [], [1.0], [None] * 6, [1.0, None, 2.0, None, 0.0, 0.5], [float("nan")] * 6, [float("inf")] + [0.0] * 5, [3e19] * 6, [0.1] * 8]
    for i, x in enumerate(odd * 2):
        rows[i * 20 if i < len(odd) else i * 11] = (i * 20 if i < len(odd) else i * 11, x, i % 10)
    spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int").coalesce(3).write.parquet(f"{tmp_path}/embeddings.parquet")
    con = duckdb.connect()
    con.execute(f"create view embeddings as select * from '{tmp_path}/embeddings.parquet/*.parquet'")
    want = sorted(con.execute(registry.SQL["nearest_neighbours"]).fetchall())
    assert len(want) == 35 and sorted(map(tuple, registry.QUERIES["nearest_neighbours"](spark, str(tmp_path)).collect())) == want


def test_blocks_of_queries_and_own_keys(spark):
    rng = np.random.default_rng(6)
    x = rng.integers(0, 4, (1500, 5)).astype(float)  # many equal distances
    df = spark.createDataFrame([(i, r.tolist(), float(i % 3)) for i, r in enumerate(x)], "key long, x array<double>, y double").repartition(5)
    d = ((x[:, None] - x) ** 2).sum(2)
    for other in (True, False):
        got = {}
        for r in nearest(df.where("key % 7 = 0"), df, 4, other=other, block=50).collect():
            got.setdefault(r.q, set()).add(r.key)
        assert got == {i: {j for _, j in sorted((d[i, j], j) for j in range(1500) if not other or i != j)[:4]} for i in range(0, 1500, 7)}


def test_no_queries_and_few_rows(spark):
    df = spark.createDataFrame([(1, [0.0], 1), (2, [1.0], 0), (None, [1.0], 0)], "id long, embedding array<float>, y int")
    assert nearest_neighbours(df.where("id > 5"), df, "id").count() == 0
    assert sorted(map(tuple, nearest_neighbours(df, df, "id").collect())) == [(1, 0.0), (2, 1.0)]
