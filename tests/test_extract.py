"""Extractions, quotas and links against plain Python; image headers against hand-made files."""

import hashlib
import struct
from collections import Counter

import pytest
from pyspark.sql import functions as F

from tessera.functions import binary
from tessera.operators import extract as X
from tessera.sources import manifests as M


@pytest.fixture(scope="module")
def rows(spark):
    data = [(i, "fake" if i % 3 else "real", 100 + i % 400, 500 - i % 300, i % 11 == 0 if i % 2 else None) for i in range(900)]
    return spark.createDataFrame(data, "k long, label string, width int, height int, nsfw boolean"), data


def md5(k, seed=42):
    return hashlib.md5(f"{seed}:{k}".encode()).hexdigest()


@pytest.mark.parametrize("seed", [None, 42])
@pytest.mark.parametrize("fill", [{}, {"train": 37, "val": 5, "test": 8}])
def test_extractions(rows, seed, fill):
    df, data = rows
    spec = X.Extraction(target=50, min_edge=200, seed=seed, fill=fill, flag="nsfw")
    want = {}
    for label in ("real", "fake"):
        ok = [k for k, y, w, h, bad in data if y == label and min(w, h) >= 200 and not bad]
        for place, k in enumerate(sorted(ok, key=(lambda k: (md5(k), k)) if seed else None)[:50]):
            cut = (37, 42, 50) if fill else (40, 45, 50)
            want[k] = next(s for s, c in zip(X.SPLITS, cut, strict=True) if place < c)
    assert {r.k: r.split for r in spec.apply(df, "k").collect()} == want


def test_sampled_carved_and_merged_splits(rows):
    df, data = rows
    tree = df.select("k", F.upper("label").alias("label"), F.when(F.col("k") % 5 == 0, "test").otherwise("train").alias("split"))
    out = X.carved(tree, "k").collect()
    assert Counter((r.label, r.split) for r in out) == {("real", "train"): 216, ("real", "val"): 24, ("real", "test"): 60, ("fake", "train"): 432, ("fake", "val"): 48, ("fake", "test"): 120}
    assert {r.k for r in out if r.split == "val" and r.label == "real"} == set(sorted((k for k, y, *_ in data if y == "real" and k % 5), key=lambda k: (md5(k), k))[:24])
    again = X.resampled(tree, "k", {"train": 100, "val": 30}).collect()
    assert Counter((r.label, r.split) for r in again) == {(y, s): n for y in ("REAL", "FAKE") for s, n in (("train", 100), ("val", 30), ("test", 60 if y == "REAL" else 120))}
    assert len({r.k for r in again}) == len(again)
    both = X.merged(tree.where("k < 10"), tree.where("k >= 10"), "k", {"train": 40}).collect()
    assert Counter(r.split for r in both if r.k >= 10) == {"train": 80, "test": 178} and sum(r.k < 10 for r in both) == 10


def test_preferred_sides(spark):
    body = lambda k: bytearray(f"image {k}".encode())
    pairs = [(i, "maker" if i % 2 else "other", body(i % 6), 500, 300, "maker" if i % 3 == 0 else "x", body(100 + i), 390 if i == 12 else 800, 100) for i in range(20)] + [(50, "maker", None, 900, 900, "x", body(1), 900, 900)]
    df = spark.createDataFrame(pairs, "id int, model1 string, content1 binary, width1 int, height1 int, model2 string, content2 binary, width2 int, height2 int")
    sha = lambda b: hashlib.sha256(bytes(b)).hexdigest()
    seen = spark.createDataFrame([(sha(body(100)),)], "sha256 string")
    guard = spark.createDataFrame([(sha(body(3))[:16] + "0" * 48,)], "prefix string")
    got = [(r.id, bytes(r.content)) for r in X.preferred_side(df, "maker", guard, seen, "id", quota=6, had=1).collect()]
    assert got == [(1, bytes(body(1))), (5, bytes(body(5))), (6, bytes(body(106))), (18, bytes(body(118)))]
    assert X.preferred_side(df, "maker", guard, seen, "id", quota=3, had=1).count() == 2 and X.preferred_side(df, "maker", guard, seen, "id", quota=1, had=5).count() == 0


def test_quotas_count_what_is_there(spark, rows):
    df, _ = rows
    shaped = df.withColumn("shape", F.when(F.col("k") % 4 == 0, "square").when(F.col("k") % 4 == 1, "portrait").when(F.col("k") % 4 == 2, "landscape").otherwise("?"))
    had = spark.createDataFrame([("real", "square")] * 7 + [("fake", "portrait")] * 50, "label string, shape string")
    out = X.shape_quota(shaped, "label", "shape", ["k"], 50, {"square": 0.4, "portrait": 0.4, "landscape": 0.2}, had)
    assert {(r.label, r["shape"]): r["count"] for r in out.groupBy("label", "shape").count().collect()} == {("real", "square"): 13, ("real", "portrait"): 20, ("real", "landscape"): 10, ("fake", "square"): 20, ("fake", "landscape"): 10}
    sources = spark.createDataFrame([("a", 10), ("b", 3), ("c", 7)], "key string, target long")
    manifest = spark.createDataFrame([("a",)] * 4 + [("a_holdout",)] * 2 + [("b",)] * 3, "source_key string")
    plan = {r.key: (r.have, r.todo, r.budget) for r in X.collection_plan(sources, manifest).collect()}
    assert plan == {"a": (6, 4, 38), "b": (3, 0, 0), "c": (0, 7, 42)}


def test_links_rows_and_columns(spark):
    df = spark.createDataFrame([("z/b.PNG", "validation", "real"), ("z/a.jpg", "validation", "real"), ("y/c.webp", "train", "fake"), ("q/d.png", "extra", "fake")], "path string, split string, label string")
    out = X.links(df, F.concat(F.split("path", "/")[0], F.lit("_"), F.col("source_split")), "path", splits={"train": "train", "validation": "val"}).collect()
    assert {(r.path, r.link) for r in out} == {("z/a.jpg", "val/real/z_validation_000000.jpg"), ("z/b.PNG", "val/real/z_validation_000001.png"), ("y/c.webp", "train/fake/y_train_000000.webp")}
    both = X.adapted(df.withColumn("v", F.array(F.lit(1.0))), df.limit(1).withColumns({"v": F.array(F.lit(2.0)), "more": F.lit(1)}))
    assert both.columns == ["path", "split", "label", "v"] and both.count() == 5
    assert X.available(df, ["label", "none", "path"]) == ["path", "label"]
    part, balance = X.training_rows(df, "validation", 1)
    assert [r.path for r in part.collect()] == ["z/a.jpg"] and balance == {"real": 1}
    with pytest.raises(ValueError):
        X.training_rows(df, "holdout")
    assert [tuple(r) for r in X.forced(df.union(spark.createDataFrame([("/abs/e.png", "val", "fake")], df.schema)), "fake", "train", "/root/").orderBy("path").collect()] == [("/abs/e.png", "train", "fake"), ("/root/q/d.png", "train", "fake"), ("/root/y/c.webp", "train", "fake")]


def test_view_boxes(spark):
    df = spark.createDataFrame([(300, 400), (279, 900), (1001, 281)], "w int, h int")
    box = lambda a: [tuple(r.b) for r in df.select(X.view_box(F.col("w"), F.col("h"), a).alias("b")).collect()]
    assert box(None) == [(0, 50, 300, 350, False), (0, 310, 279, 589, False), (360, 0, 641, 281, False)]
    want = []
    for w, h in ((300, 400), (279, 900), (1001, 281)):
        x, y = round((w - 224) * 0.5), round((h - 224) * 1.0)
        want.append((x, y, x + 224, y + 224, True) if min(w, h) >= 280 else (0, 0, w, h, False))
    assert box((0.5, 1.0)) == want


def png(w, h):
    return b"\x89PNG\r\n\x1a\n" + struct.pack(">I", 13) + b"IHDR" + struct.pack(">II", w, h) + b"\x08\x02\0\0\0" + b"\0" * 4


def test_image_headers():
    jpeg = b"\xff\xd8\xff\xe0\0\x04ab\xff\xc4\0\x03q\xff\xc2\0\x0b\x08" + struct.pack(">HH", 480, 640) + b"\x03\x01\x11\0\xff\xda"
    riff = lambda body: b"RIFF\0\0\0\0WEBP" + body
    extended = riff(b"VP8X\x0a\0\0\0\0\0\0\0" + (799).to_bytes(3, "little") + (599).to_bytes(3, "little"))
    lossless = riff(b"VP8L\x20\0\0\0\x2f" + (99 | 49 << 14).to_bytes(4, "little") + b"\0" * 8)
    lossy = riff(b"VP8 \x20\0\0\0\0\0\0\x9d\x01\x2a" + struct.pack("<HH", 33, 44))
    got = [binary.image_size(x) for x in (png(7, 9), jpeg, extended, lossless, lossy, b"GIF89a" + struct.pack("<HH", 5, 6), b"\xff\xd8", b"text", b"", None, riff(b"VP8"))]
    assert got == [("png", 7, 9), ("jpeg", 640, 480), ("webp", 800, 600), ("webp", 100, 50), ("webp", 33, 44), ("gif", 5, 6), None, None, None, None, None]


def test_scans_of_several_trees(spark, tmp_path):
    roots = []
    for r in "ab":
        roots.append(str(tmp_path / r))
        for label in ("real", "fake"):
            folder = tmp_path / r / "train" / label
            folder.mkdir(parents=True)
            for i in range(9):
                (folder / f"{i}.png").write_bytes(png(10 + i, 20) if i != 4 else b"broken")
            (folder / "notes.txt").write_text("x")
    files = M.scanned(spark, roots)
    assert files.count() == 36 and files.where("width is null").count() == 4
    assert {(r.root[-1], r.label): r.n for r in M.tree_counts(files).collect()} == {(r, y): 9 for r in "ab" for y in ("real", "fake")}
    some = M.scanned(spark, roots, per_class=3).collect()
    assert sorted(r.name for r in some if r.root == roots[0] and r.label == "real") == ["0.png", "3.png", "6.png"] and {r.width for r in some} == {10, 13, 16}
    with pytest.raises(ValueError):
        M.scanned(spark, [str(tmp_path / "a" / "train")], suffixes=("gif",))
