"""Scorers by name, keyed scores, and row groups of shards."""

import math

import numpy as np
import pyarrow as pa
import pyarrow.parquet as pq
import pytest

from tessera.operators import scoring
from tessera.operators.ingest import SourceSpec
from tessera.operators.sampling import spread
from tessera.sources import shards

KIND = "id long, v array<double>"


def p(*xs, w=(1.0, -2.0), bias=0.5, scale=3.0):
    return 1 / (1 + math.exp(-scale * (sum(a * b for a, b in zip(w, xs, strict=True)) + bias)))


def test_unreadable_rows_are_null(spark):
    rows = [(1, [0.5, 0.25]), (2, None), (3, []), (4, [1.0]), (5, [1.0, None]), (6, [float("nan"), 1.0]), (7, [float("inf"), 1.0]), (8, [1e6, 0.0]), (9, [0.5, 0.25])]
    got = {r.id: r.p_fake for r in scoring.score(spark.createDataFrame(rows, KIND).repartition(3), "linear", key="id", vector="v", size=2, weights=[1.0, -2.0], bias=0.5, scale=3.0).collect()}
    assert {k for k, v in got.items() if v is None} == {2, 3, 4, 5, 6, 7}
    assert got[1] == got[9] == pytest.approx(p(0.5, 0.25)) and got[8] == 1
    with pytest.raises(ValueError):
        scoring.score(spark.createDataFrame(rows, KIND), "none", key="id", vector="v", size=2)


def test_views_and_centroids(spark):
    df = spark.createDataFrame([(1, [1.0, 0.0, 0.5, 2.0])], KIND)
    parts = [{"weights": [1.0, -2.0], "bias": 0.5, "scale": 3.0}, {"weights": [0.1, 0.2]}]
    got = scoring.score(df, "views", key="id", vector="v", size=4, base="linear", views=[(0, 2), (2, 4)], params=parts).first().p_fake
    assert got == pytest.approx((p(1.0, 0.0) + p(0.5, 2.0, w=(0.1, 0.2), bias=0, scale=1)) / 2)
    assert scoring.score(df, "centroids", key="id", vector="v", size=4, real=[0.0] * 4, fake=[1.0, 0.0, 0.5, 2.0]).first().p_fake == pytest.approx(1 / (1 + math.exp(-5.25)))


def test_scores_by_key_and_their_cache(spark, tmp_path):
    df = spark.createDataFrame([(i, [float(i), 1.0] if i % 4 else None) for i in range(20)], KIND)
    calls = {"weights": [0.1, 0.0], "key": "id", "vector": "v", "size": 2}
    first = scoring.cached_scores(df.where("id < 10"), str(tmp_path), "a", "linear", **calls)
    want = {i: None if i % 4 == 0 else round(p(i, 1, w=(0.1, 0), bias=0, scale=1), 6) for i in range(20)}
    assert {r.id: r.p_fake for r in first.collect()} == {i: want[i] for i in range(10)}
    again = scoring.cached_scores(df, str(tmp_path), "a", "linear", **calls | {"weights": [0.1, 0.0]})
    assert {r.id: r.p_fake for r in again.collect()} == want
    assert spark.read.json(f"{tmp_path}/tag=a").count() == 15
    changed = scoring.cached_scores(df, str(tmp_path), "a", "linear", **calls | {"weights": [9.0, 0.0]})  # nothing left to score
    assert {r.id: r.p_fake for r in changed.collect()} == want
    scores = spark.createDataFrame([(1, 0.1, 1), (1, 0.9, 0), (2, None, 0), (99, 0.5, 0)], "id long, p_fake double, at int")
    rows = spark.createDataFrame([(1, "a"), (1, "a"), (2, "a"), (3, "b"), (None, "b")], "id long, tier string")
    joined = scoring.with_scores(rows, scores, "id", order="at")
    assert sorted(((r.id or 0, r.p_fake or 0) for r in joined.collect())) == [(0, 0), (1, 0.1), (1, 0.1), (2, 0), (3, 0)]
    assert sorted(map(tuple, scoring.unscored(joined, "tier").collect())) == [("a", 3, 1), ("b", 2, 2)]


@pytest.fixture(scope="module")
def files(tmp_path_factory):
    top = tmp_path_factory.mktemp("shards")
    for s in range(30):
        n = 40 + s
        pq.write_table(pa.table({"id": np.arange(n) + 1000 * s, "kind": [f"k{i % 3}" for i in range(n)], "body": [b"x" * 10] * n}), top / f"s{s:02}.parquet", row_group_size=16)
    (top / "_SUCCESS").write_text("")
    return top


def taken(files, most, quota):
    """Rows of the chosen row groups in turns, one after another."""
    chosen = sorted(files.glob("*.parquet"))
    chosen = [chosen[i] for i in spread(len(chosen), most)]
    groups = [pq.ParquetFile(f) for f in chosen]
    ids = []
    for g in range(max(f.num_row_groups for f in groups)):
        for f in groups:
            if g < f.num_row_groups:
                ids += f.read_row_group(g, columns=["id"]).column("id").to_pylist()
    return sorted(ids[:quota])


@pytest.mark.parametrize("most,quota", [(12, None), (12, 200), (12, 7), (1, 20), (100, None), (5, 10**6)])
def test_row_groups_in_turns(spark, files, most, quota):
    got = shards.read_row_groups(spark, str(files), ["id"], max_shards=most, quota=quota)
    assert got.columns == ["id"]
    assert sorted(r.id for r in got.collect()) == taken(files, most, quota)


def test_row_groups_are_partitions(spark, files):
    assert shards.read_row_groups(spark, f"file://{files}", max_shards=2, quota=40).rdd.getNumPartitions() == 3
    assert shards.read_row_groups(spark, f"file://{files}", max_shards=2).columns == ["id", "kind", "body"]


@pytest.mark.parametrize("name", ["row_groups", "parquet"])
def test_fetchers_read_what_a_spec_needs(spark, files, name):
    spec = SourceSpec("web", where={"kind": ["k1", "k2"]}, label_column="kind", label_map={"k1": "real", "k2": "fake"}, extra_fields=["absent"])
    got = shards.fetch(spark, name, spec, str(files / "s03.parquet"), also=["id"])
    assert sorted((r.id, r.label, r.source_key) for r in got.collect()) == [(3000 + i, "real" if i % 3 == 1 else "fake", "web") for i in range(43) if i % 3]
    assert "body" not in got.columns
    with pytest.raises(ValueError):
        shards.fetch(spark, "ftp", spec, str(files))


def test_shards_of_other_columns(spark, tmp_path):
    pq.write_table(pa.table({"id": pa.array([1, 2], pa.int32()), "a": ["x", None]}), tmp_path / "1.parquet")
    pq.write_table(pa.table({"b": [0.5], "id": pa.array([3], pa.int64())}), tmp_path / "2.parquet")
    spark.dataSource.register(shards.RowGroups)
    got = spark.read.format("row_groups").schema("a string, id long, b double").load(str(tmp_path))
    assert sorted(map(tuple, got.collect()), key=lambda r: r[1]) == [("x", 1, None), (None, 2, None), (None, 3, 0.5)]
    empty = tmp_path / "none"
    empty.mkdir()
    assert spark.read.format("row_groups").schema("id long").load(str(empty)).count() == 0
