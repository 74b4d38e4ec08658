"""Manifest readers and writers on files."""

import json

import pytest
from pyspark.sql import DataFrameWriter
from pyspark.sql import functions as F

from tessera.plans import registry, serving
from tessera.sources import manifests as M


def jsonl(path, rows):
    path.write_text("\n".join(x if isinstance(x, str) else json.dumps(x) for x in rows))
    return str(path)


def test_manifest_rows_skip_what_is_not_there(spark, tmp_path):
    path = jsonl(tmp_path / "m.jsonl", [{"path": "a.png", "split": "train", "label": "real"}, "", "{broken", {"path": "b.png", "split": "val", "label": "fake", "source_key": "s", "generator": "g"}, {"path": "c.png", "split": "val", "label": "fake"}])
    files = spark.createDataFrame([("a.png",), ("b.png",)], "path string")
    got = {r.path: (r.source_key, r.generator, r.group) for r in M.manifest_rows(spark, path, "web", files).collect()}
    assert got == {"a.png": ("web/unknown", "?", "web/unknown"), "b.png": ("s", "g", "s")}
    assert [r.path for r in M.manifest_rows(spark, path, "web", split="val", group="generator").orderBy("path").collect()] == ["b.png", "c.png"]


def test_trees_and_listings(spark, tmp_path):
    for name in ("real/a.png", "fake/b.jpg", "fake/c.txt", "fake/deep/d.png"):
        (tmp_path / name).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / name).write_bytes(b"12345")
    tree = M.read_tree(spark, str(tmp_path))
    assert {(r.name, r.label) for r in tree.collect()} == {("a.png", "real"), ("b.jpg", "fake")}
    assert M.read_tree(spark, str(tmp_path), recursive=True).count() == 3
    s = M.folder_size(M.read_tree(spark, str(tmp_path), recursive=True), ["*.jpg"]).first()
    assert (s.files, s.bytes, s.ignored) == (2, 10, 1)
    assert M.split_or_all(tree, "real").count() == 1 and M.split_or_all(tree, "holdout").count() == 2
    assert [r.name for r in M.listed(tree, r"\.(png|jpg)$", 1).collect()] == ["a.png"]
    with pytest.raises(ValueError):
        M.listed(tree, "nothing")
    assert M.either(tree.limit(0), tree).count() == 2
    with pytest.raises(ValueError):
        M.either(tree.limit(0), tree.limit(0))


def test_a_leaking_manifest_is_not_written(spark, tmp_path):
    kind = "path string, split string, label string, sha256 string"
    good = spark.createDataFrame([("b", "val", "real", "1"), ("a", "train", "fake", "2"), ("c", "train", "real", "")], kind)
    M.write_guarded(good, str(tmp_path / "out"))
    lines = [json.loads(x)["path"] for f in sorted((tmp_path / "out").glob("part-*")) for x in f.read_text().splitlines()]
    assert lines == ["a", "c", "b"]
    for bad in (("d", "train", "real", "1"), ("d", "val", "fake", "1")):
        with pytest.raises(ValueError):
            M.write_guarded(good.union(spark.createDataFrame([bad], kind)), str(tmp_path / "bad"))
    assert not (tmp_path / "bad").exists()


def test_stamps_reports_and_metrics(spark, tmp_path):
    df = spark.createDataFrame([("x", None, None), ("y", "jpeg", "old"), ("z", "", "first")], "sha256 string, encoding string, source_sha256 string")
    assert [tuple(r) for r in M.stamped(df, "q95").select("encoding", "source_sha256").collect()] == [("q95", "x"), ("jpeg", "old"), ("q95", "first")]
    M.write_report(df.withColumnRenamed("encoding", "preview"), str(tmp_path / "csv"))
    assert spark.read.option("header", True).csv(str(tmp_path / "csv")).columns == ["sha256", "source_sha256"]
    (tmp_path / "m.json").write_text(json.dumps({"auc": 0.5, "by": {"a": 1}}, indent=1))
    assert M.read_metrics(spark, str(tmp_path / "m.json")).first().by.a == 1


def test_shards_are_written_without_a_sort(spark, monkeypatch, tmp_path):
    # a sort by shard holds all lines of a task at once
    rows = spark.range(3000).selectExpr("id as l_orderkey", "case id % 3 when 0 then 'R' when 1 then 'A' else 'N' end as l_returnflag", "cast(id % 50 as double) as l_quantity")
    rows.write.mode("overwrite").parquet(f"{tmp_path}/lineitem.parquet")
    plans, write = [], DataFrameWriter.parquet
    monkeypatch.setattr(DataFrameWriter, "parquet", lambda self, path, **kw: plans.append((self._df, self._jwrite)) or write(self, path, **kw))
    got = {r.l_returnflag: (r.n, r.quantity) for r in registry.QUERIES["row_group_scan"](spark, str(tmp_path)).collect()}
    want = {f: [i for i in range(3000) if i % 30 in serving.CHOSEN and i % 3 == m] for m, f in enumerate("RAN")}
    assert got == {f: (len(x), float(sum(i % 50 for i in x))) for f, x in want.items() if x}
    lines = plans[0][0]
    per_task = {(r.t, r.s) for r in lines.select(F.spark_partition_id().alias("t"), (F.col("l_orderkey") % 30).alias("s")).distinct().collect()}
    assert len(per_task) == 30 == len({t for t, _ in per_task})
