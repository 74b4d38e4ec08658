"""Scenarios of manifest algebra on small hand-made tables."""

from pyspark.sql import functions as F

from tessera.operators import manifest, tiers

ROWS = "path string, split string, label string, sha256 string, seq int"


def kept(spark, rows):
    return {r.path for r in manifest.dedup_keep_best(spark.createDataFrame(rows, ROWS)).collect()}


def test_val_beats_train_and_holdout_beats_all(spark):
    assert kept(spark, [("a", "train", "real", "x", 0), ("b", "val", "real", "x", 1)]) == {"b"}
    assert kept(spark, [("a", "train", "real", "x", 0), ("b", "val", "real", "x", 1), ("c", "test", "real", "x", 2), ("d", "holdout", "real", "x", 3)]) == {"d"}


def test_first_row_wins_ties_and_empty_hashes_never_merge(spark):
    assert kept(spark, [("b", "train", "real", "x", 1), ("a", "train", "real", "x", 0)]) == {"a"}
    assert kept(spark, [("a", "train", "real", "", 0), ("b", "train", "real", None, 1), ("c", "train", "real", "", 2)]) == {"a", "b", "c"}


def test_drop_histogram(spark):
    df = spark.createDataFrame([("a", "train", "real", "x", 0), ("b", "val", "real", "x", 1), ("c", "train", "real", "y", 2), ("d", "train", "real", "y", 3)], ROWS)
    assert {tuple(r) for r in manifest.drop_histogram(df).collect()} == {("train (dup of val)", 1), ("train (dup of train)", 1)}


def test_conflicts_and_leaks(spark):
    df = spark.createDataFrame([("a", "train", "real", "x", 0), ("b", "test", "fake", "x", 1), ("c", "test", "fake", "y", 2), ("d", "train", "real", "", 3), ("e", "test", "real", "", 4)], ROWS)
    assert [r.labels for r in manifest.conflicting_labels(df).collect()] == ["fake,real"]
    assert {r.path for r in manifest.leaks(df).collect()} == {"b"}


def test_verification_finds_what_is_wrong(spark):
    rows = [("a", "train", "real", "x", 0), ("b", "test", "fake", "x", 1), ("c", "nowhere", "real", "z", 2), ("d", "train", None, "w", 3)]
    df = spark.createDataFrame(rows, ROWS).withColumns({"source": F.lit("s"), "generator": F.lit("g"), "corpus": F.lit("k")})
    got = {r.check: (r.n, r.ok) for r in manifest.verify_checks(df, {"k": 4, "other": 1}).collect()}
    assert got["invalid_split"] == (1, False) and got["invalid_label"] == (1, False) and got["missing_value"] == (1, False) and got["missing_column"] == (0, True)
    assert got["duplicate_groups"] == (1, False) and got["label_conflicts"] == (1, False) and got["leaks"] == (1, False)
    assert got["corpus:k"] == (4, True) and got["corpus:other"] == (0, False)


def tier_rows(spark, rows):
    return tiers.build_tiers(spark.createDataFrame(rows, "split string, label string, source_key string, generator string"))


BASE = [("train", "fake", "gen_a_clean", "gen-a"), ("train", "real", "cam_a", "camera/a"), ("val", "fake", "multi", "gen-b")]


def test_tiers_separate_and_share_negatives(spark):
    t = tier_rows(spark, [*BASE, ("holdout", "fake", "gen_a_wild", "gen-a"), ("holdout", "fake", "multi", "gen-z"), ("holdout", "real", "cam_b", "camera/b"), ("test", "real", "cam_a", "camera/a")])
    got = {(r.tier, r.label, r.source_key) for r in t.collect()}
    assert got == {("T1_indist", "real", "cam_a"), ("T2_xsource", "fake", "gen_a_wild"), ("T2_xsource", "real", "cam_b"), ("T3_xgen", "fake", "multi"), ("T3_xgen", "real", "cam_b")}
    assert {r.shared for r in tiers.tier_sources(t).where("tier = 'T3_xgen'").collect()} == {"multi"}


def test_a_row_new_on_neither_axis_is_a_leak_and_in_no_tier(spark):
    rows = [*BASE, ("holdout", "fake", "gen_a_clean", "gen-a"), ("holdout", "real", "cam_b", "camera/b")]
    assert tier_rows(spark, rows).count() == 0
    assert tiers.tier_leaks(spark.createDataFrame(rows, "split string, label string, source_key string, generator string")).count() == 1
