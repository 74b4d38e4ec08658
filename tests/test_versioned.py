"""Rewriting sinks: interrupted, rerun, read meanwhile."""

import pytest
from pyspark.sql import functions as F

from tessera.sources.versioned import FeatureCache, Versioned, normalise, purge

KIND = "path string, split string, label string, source_key string, sha256 string, encoding string, source_sha256 string"
ROWS = [
    ("a", "train", "real", "web", "1", None, None), ("b", "train", "real", "cam", "2", "q95", "0"), ("c", "train", "fake", "gen", "3", "q95", "9"), ("d", "holdout", "fake", "gen_holdout", "4", "", "8"),
    ("e", "val", "real", "cam", "5", "q95", None), ("f", None, "real", "cam", "6", "q95", None), ("g", "odd/ =%", "real", "cam", "7", "q95", None),
]


def rows(df):
    return sorted((tuple(r) for r in df.collect()), key=repr)


@pytest.fixture
def manifest(spark, tmp_path):
    m = Versioned(spark, str(tmp_path / "m"))
    with pytest.raises(ValueError):
        m.read()
    m.replace(spark.createDataFrame(ROWS, KIND))
    assert rows(m.read()) == sorted(ROWS, key=repr)
    return m


def folders(m, version=None):
    return m.pointer(version or m.latest())["parts"]


def test_purge_touches_only_its_parts(manifest):
    before = manifest.read()
    gone = purge(manifest, ["gen"])
    assert sorted(map(tuple, gone.collect())) == [("gen", 1), ("gen_holdout", 1)]
    assert rows(manifest.read()) == sorted((r for r in ROWS if not r[3].startswith("gen")), key=repr)
    assert rows(before) == rows(manifest.read(1)) == sorted(ROWS, key=repr)  # a reader of the old version sees all of it
    old, new = folders(manifest, 1), folders(manifest)
    assert new == {k: v for k, v in old.items() if "fake" not in k}
    assert purge(manifest, ["none"]).count() == 0 and manifest.latest() == 2


def test_normalise(manifest):
    assert normalise(manifest, "q90") == 2
    want = [(*r[:5], r[5] or "q90", r[6] or (r[4] if not r[5] else None)) for r in ROWS]
    assert rows(manifest.read()) == sorted(want, key=repr)
    assert folders(manifest)['["val", "real"]'] == folders(manifest, 1)['["val", "real"]']
    assert normalise(manifest, "other") == 2  # nothing left to stamp


def test_an_interrupted_write_is_not_seen(manifest, monkeypatch):
    def lost(*_):
        raise OSError("lost")

    with monkeypatch.context() as m:
        m.setattr(manifest, "swap", lost)
        with pytest.raises(OSError):
            normalise(manifest, "q90")
    assert rows(manifest.read()) == sorted(ROWS, key=repr)
    manifest.files.create(f"{manifest.root}/versions/00000002.json", '{"schema": "')  # a pointer without its end
    assert manifest.latest() == 1 and normalise(manifest, "q90") == 3
    assert manifest.read().where("encoding = 'q90'").count() == 2
    kept = rows(manifest.read())
    assert len(manifest.vacuum()) == 1  # of the write that was lost; the first version's folder still holds parts
    assert rows(manifest.read()) == kept and manifest.pointers() == [3]


def test_the_later_of_two_writers_fails(manifest, spark):
    other = Versioned(spark, manifest.root)

    def meanwhile(df):
        purge(other, ["web"])
        return df

    with pytest.raises(RuntimeError):
        manifest.rewrite(F.col("source_key") == "gen", meanwhile)
    assert manifest.read().count() == len(ROWS) - 1
    with pytest.raises(ValueError):
        manifest.rewrite(F.col("source_key") == "gen", lambda df: df.withColumn("split", F.lit("val")).withColumn("label", F.lit("real")))
    with pytest.raises(ValueError):
        manifest.rewrite(F.col("source_key") == "gen", lambda df: df.drop("path"))


def test_feature_cache(spark, tmp_path):
    df = spark.createDataFrame([(i, "train" if i % 3 else "val", [float(i), 1.0] if i % 5 else None) for i in range(30)], "id int, split string, v array<double>")
    cache, calls = FeatureCache(spark, str(tmp_path / "c")), []

    def view(name, f):
        def make(part):
            calls.append(name)
            return f(F.col("v"))

        return make

    views = {"whole": view("whole", lambda v: v), "first": view("first", lambda v: F.slice(v, 1, 1))}
    assert cache.extract(df, views, key="id") == [("train", "whole"), ("train", "first"), ("val", "whole"), ("val", "first")]
    got = {r.id: (r.whole, r["first"]) for r in cache.load("train", ["whole", "first"]).collect()}
    assert got == {i: ([float(i), 1.0], [float(i)]) for i in range(30) if i % 3 and i % 5}
    calls.clear()
    assert cache.extract(df, views, key="id") == [] and calls == []
    cache.files.delete(cache.folder("val", "whole", cache.files.text(f"{cache.root}/split=val/index/whole")) + "/_SUCCESS")  # as a writer that was lost leaves it
    assert cache.extract(df, views, key="id") == [("val", "whole")]
    assert cache.extract(df.where("id <> 1"), views, key="id") == [("train", "whole"), ("train", "first")]
    assert cache.load("train").count() == 15 and cache.load("val", ["first"]).columns == ["id", "first"]
    for split, names in (("test", None), ("val", ["none"])):
        with pytest.raises(ValueError):
            cache.load(split, names)
