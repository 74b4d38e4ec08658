"""Streams that stop, start again and see late duplicates."""

import shutil

from tessera.streaming import resumable

KIND = "sha256 string, ts long, path string"


def arrive(spark, folder, rows):
    spark.createDataFrame(rows, KIND).coalesce(1).write.mode("append").parquet(str(folder))


def run(spark, tmp_path, **more):
    s = resumable.arrivals(spark, str(tmp_path / "in"), spark.createDataFrame([], KIND).schema, per_batch=1)
    resumable.append_new(s, ["sha256"], str(tmp_path / "store"), str(tmp_path / "state"), order="ts", buckets=5, **more)
    return sorted(((r.sha256 or "", r.ts, r.path) for r in spark.read.parquet(str(tmp_path / "store")).collect()))


def test_duplicates_days_apart_and_a_lost_checkpoint(spark, tmp_path):
    arrive(spark, tmp_path / "in", [("a", 5, "late"), ("a", 2, "first"), ("b", 3, "b"), (None, 1, "none")])
    want = [("", 1, "none"), ("a", 2, "first"), ("b", 3, "b")]
    assert run(spark, tmp_path) == want
    assert run(spark, tmp_path) == want  # nothing new
    arrive(spark, tmp_path / "in", [("b", 10**9, "again"), ("c", 10**9, "c"), (None, 10**9, "again")])
    arrive(spark, tmp_path / "in", [("a", 0, "earlier, but it came later"), ("c", 2, "again")])
    want += [("c", 10**9, "c")]
    assert run(spark, tmp_path) == want
    shutil.rmtree(tmp_path / "state")  # all batches run again
    assert run(spark, tmp_path) == want


def test_a_batch_that_was_written_by_half(spark, tmp_path):
    rows = [(f"k{i}", i, "x") for i in range(40)]
    arrive(spark, tmp_path / "in", rows)
    run(spark, tmp_path)
    shutil.rmtree(tmp_path / "store" / "bucket=2")  # as if the writer had been lost before this folder
    shutil.rmtree(tmp_path / "state")
    assert run(spark, tmp_path) == sorted(rows)


def test_first_arrivals_for_ever(spark, tmp_path):
    out, state = str(tmp_path / "out"), str(tmp_path / "state")
    for rows in ([("a", 1, "x"), ("a", 2, "y")], [("a", 10**12, "z"), ("b", 1, "x")]):
        arrive(spark, tmp_path / "in", rows)
        s = resumable.arrivals(spark, str(tmp_path / "in"), spark.createDataFrame([], KIND).schema)
        resumable.run_available(resumable.first_arrivals(s.select("sha256"), ["sha256"]), out, state)
    assert sorted(r.sha256 for r in spark.read.parquet(out).collect()) == ["a", "b"]
