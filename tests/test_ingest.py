"""Specs, provenance, containers, sources and streams."""

import struct

from pyspark.sql import functions as F

from tessera.functions import binary, provenance
from tessera.operators.ingest import SourceSpec
from tessera.operators.learning import model_zoo
from tessera.schemas import MANIFEST
from tessera.sources import manifests
from tessera.streaming import resumable

SPEC = SourceSpec("s", where={"label": ["REAL", "FULL"]}, where_not={"site": ["bad"]}, label_column="label", label_map={"REAL": "real", "FULL": "fake"}, generator_column="model", generator_map={"A": "gen-a", "B": "gen-b"}, holdout_when={"model": ["B"], "site": ["held"]}, extra_fields=("site",))


def test_spec_filters_maps_and_quarantines(spark):
    df = spark.createDataFrame([("REAL", "A", "x"), ("TAMPERED", "A", "x"), ("FULL", "A", "bad"), ("FULL", "B", None), ("FULL", "new", "x"), ("FULL", "A", "held")], "label string, model string, site string")
    got = {(r.label, r.generator, r.source_key, (r.extras or {}).get("site")) for r in SPEC.apply(df).collect()}
    assert got == {("real", "gen-a", "s", "x"), ("fake", "gen-b", "s_holdout", None), ("fake", "gen-a", "s_holdout", "held")}
    assert [tuple(r) for r in SPEC.unmapped(df).collect()] == [("model", "new", 1)]


def test_absent_columns_fail_allowlists_and_pass_denylists(spark):
    df = spark.createDataFrame([("REAL",)], "label string")
    assert df.where(SourceSpec("s", where={"no": ["x"]}).matches(df)).count() == 0
    assert df.where(SourceSpec("s", where_not={"no": ["x"]}).matches(df)).count() == 1


def test_class_numbers_by_name(spark):
    df = spark.createDataFrame([(0,), (1,), (7,), (None,)], "k int")
    spec = SourceSpec("s", class_names={"k": ["cat", "dog"]})
    assert [r[0] for r in df.select(spec.value(df, "k")).collect()] == ["cat", "dog", "7", ""]


def test_terms_match_inside_words_and_override_the_verdict(spark):
    df = spark.createDataFrame([("linseed oil", 0.1), ("holiday", 0.1), (None, 0.7)], "text string, p double")
    a = provenance.attribution(provenance.rules(df))
    assert [r[0].label for r in a.select(provenance.consensus(F.col("p"), F.col("provider"), F.col("confidence"))).collect()] == ["FAKE", "REAL", "FAKE"]


def test_containers():
    chunk = lambda n, b: struct.pack(">I", len(b)) + n + b + b"\0\0\0\0"
    png = b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", b"\0" * 13) + chunk(b"IEND", b"") + b"xyz"
    assert binary.container_of(png) == {"kind": "png", "chunks": ["IHDR", "IEND"], "trailing_bytes": 3}
    jpeg = b"\xff\xd8\xff\xe1\x00\x04ab\xff\xda\x00\x02data\xff\xd9tail"
    assert binary.container_of(jpeg) == {"kind": "jpeg", "chunks": ["APP1"], "trailing_bytes": 4}
    body = b"WEBP" + b"VP8 " + struct.pack("<I", 3) + b"abc\0"
    assert binary.container_of(b"RIFF" + struct.pack("<I", len(body)) + body + b"q") == {"kind": "webp", "chunks": ["VP8 "], "trailing_bytes": 1}
    assert [binary.container_of(x)["kind"] for x in (None, b"", b"\x89PNG\r\n\x1a\n\0\0")] == ["unknown", "unknown", "png"]
    assert binary.cbor_strings(b"\xa1\x65agent\x67ChatGPT") == ["agent", "ChatGPT"] and binary.cbor_strings(b"\x78") == []


def test_manifests_round_trip(spark, tmp_path):
    p = tmp_path / "m.jsonl"
    p.write_text('{"path": "a", "split": "train", "label": "real"}\nnot json\n\n{"path": "b", "split": "val", "label": "fake", "generator": "g"}\n')
    m = manifests.standard(manifests.read_jsonl(spark, str(p)).where("path is not null"), "corpus")
    assert {(r.path, r.group, r.generator) for r in m.collect()} == {("a", "corpus/unknown", "?"), ("b", "corpus/unknown", "g")}
    assert set(MANIFEST.fieldNames()) <= set(m.columns)
    manifests.append_jsonl(m.select("path"), str(tmp_path / "out"))
    manifests.append_jsonl(m.select("path"), str(tmp_path / "out"))
    assert spark.read.json(str(tmp_path / "out")).count() == 4
    manifests.write_split(m, str(tmp_path / "parts"))
    assert spark.read.parquet(str(tmp_path / "parts")).where("split = 'val'").count() == 1
    for d in ("real", "fake", "other"):
        (tmp_path / "tree" / d).mkdir(parents=True)
        (tmp_path / "tree" / d / "x.png").write_bytes(b"1")
        (tmp_path / "tree" / d / "x.txt").write_bytes(b"1")
    assert {(r.label, r.name) for r in manifests.read_tree(spark, str(tmp_path / "tree")).collect()} == {("real", "x.png"), ("fake", "x.png")}


def test_quota_and_dedup_streams(spark, tmp_path):
    src = str(tmp_path / "in")
    df = spark.createDataFrame([(i % 5, "ab"[i % 2], i) for i in range(20)], "id int, k string, n int").withColumn("ts", F.timestamp_seconds(F.col("n")))
    df.coalesce(1).write.parquet(src)
    run = lambda s, name: (resumable.run_available(s, str(tmp_path / name), str(tmp_path / f"{name}-state")), spark.read.parquet(str(tmp_path / name)))[1]
    assert run(resumable.deduplicated(resumable.arrivals(spark, src, df.schema), ["id"], "ts", "1 hour"), "d").count() == 5
    q = run(resumable.within_quota(resumable.arrivals(spark, src, df.schema), "k", "n", 3), "q")
    assert {(r.k, r["count"]) for r in q.groupBy("k").count().collect()} == {("a", 3), ("b", 3)}


def test_model_zoo_has_its_kinds():
    assert set(model_zoo()) == {"logistic", "tree", "forest", "linear_svm", "rbf_svm", "nearest", "gaussian_nb"}
