"""Exact ranks, stopping points, folds and aliases against plain Python."""

import random

import pytest
from pyspark.sql import functions as F

from tessera.operators import audits, joins, learning, metrics, sampling


def test_scores_that_differ_late_are_told_apart(spark):
    df = spark.createDataFrame([(1, 0.12345642), (0, 0.12345641), (1, 1.5), (0, -2.0)], "y int, p double")
    assert metrics.roc_auc(df).first().auc == 1.0
    assert metrics.threshold_at_fpr(df).first().threshold == 0.12345642


def test_rank_auc_gives_ties_to_the_negatives(spark):
    rng = random.Random(4)
    rows = [(rng.random() < 0.4, rng.randrange(12) / 7) for _ in range(300)]
    got = metrics.rank_auc(spark.createDataFrame([(int(y), p) for y, p in rows], "y int, p double")).first().auc
    order = sorted(range(len(rows)), key=lambda i: (rows[i][1], not rows[i][0]))  # stable, positives first
    ranks = {i: r for r, i in enumerate(order, 1)}
    pos = [i for i, (y, _) in enumerate(rows) if y]
    assert got == pytest.approx((sum(ranks[i] for i in pos) - len(pos) * (len(pos) + 1) / 2) / (len(pos) * (len(rows) - len(pos))))


def test_running_sums_over_many_distinct_scores(spark):
    rng = random.Random(1)
    rows = [("ab"[rng.random() < 0.3], int(rng.random() < 0.5), rng.random()) for _ in range(3000)]
    got = {r.g: r.auc for r in metrics.roc_auc(spark.createDataFrame(rows, "g string, y int, p double"), ["g"]).collect()}
    for g in "ab":
        pos, neg = ([p for h, y, p in rows if h == g and y == c] for c in (1, 0))
        assert got[g] == pytest.approx(sum(a > b for a in pos for b in neg) / len(pos) / len(neg))


def test_early_stopping_counts_epochs_without_a_real_fall(spark):
    rows = [("a", i, x) for i, x in enumerate([1.0, 0.5, 0.5, 0.5, 0.5, 0.1])] + [("b", i, x) for i, x in enumerate([1.0, 0.95])] + [("c", 0, 2.0)]
    df = spark.createDataFrame(rows, "run string, epoch int, loss double")
    got = {r.run: (r.best, r.waited, r.stopped) for r in audits.early_stopping(df, "run", "epoch", "loss", patience=3, min_delta=1e-4).collect()}
    assert got == {"a": (0.5, 3, 4), "b": (0.95, 0, None), "c": (2.0, 0, None)}
    assert audits.early_stopping(df, "run", "epoch", "loss", patience=1, min_delta=0.1).where("run = 'b'").first().stopped == 1


def test_folds_are_stratified_and_metrics_are_per_fold(spark):
    df = spark.createDataFrame([(i, int(i % 3 == 0)) for i in range(60)], "k long, y int")
    sizes = learning.folds(df, "k").groupBy("y", "fold").count().collect()
    assert {(r.y, r["count"]) for r in sizes} == {(0, 8), (1, 4)} and {r.fold for r in sizes} == set(range(5))
    scored = spark.createDataFrame([("m", 0, 1, 1.0, 0.9), ("m", 0, 0, 0.0, 0.1), ("m", 1, 1, 0.0, 0.2), ("m", 1, 0, 0.0, 0.4)], "model string, fold int, y int, hit double, p double")
    r = learning.fold_metrics(scored).first()
    assert (r.accuracy, r.accuracy_deviation, r.f1, r.auc) == (75.0, 25.0, 50.0, 50.0)


def test_cross_validation_separates_what_is_separable(spark):
    rng = random.Random(2)
    rows = [(i, i % 2, [rng.gauss(3.0 * (i % 2), 1.0), rng.gauss(0, 1)]) for i in range(80)]
    df = spark.createDataFrame(rows, "k long, y int, v array<double>")
    df = df.select("k", "y", learning.array_to_vector("v").alias("features"))
    zoo = learning.model_zoo(dims=2)
    out = {r["model"]: r for r in learning.cross_validate(df, {k: zoo[k] for k in ("logistic", "tree")}, "k", 3).collect()}
    assert set(out) == {"logistic", "tree"} and all(r.accuracy > 80 and r.auc > 75 for r in out.values())


def test_heads_and_fusion_order_what_is_ordered(spark):
    rng = random.Random(3)
    rows = [(i, i % 2, [rng.gauss(2.0 * (i % 2), 1.0)]) for i in range(120)]
    df = spark.createDataFrame(rows, "k long, y int, v array<double>").select("k", "y", learning.array_to_vector("v").alias("features"))
    c, model, platt = learning.fit_head(df.where("k < 60"), df.where("k >= 60 and k < 90"), (0.1, 1.0))
    p = learning.calibrated(model, platt, df.where("k >= 90"))
    assert c in (0.1, 1.0) and metrics.roc_auc(p).first().auc > 0.8
    views = p.select("k", "y", F.explode(F.array(F.struct(F.lit("a").alias("view"), "p"), F.struct(F.lit("b").alias("view"), (F.col("p") * 0.5).alias("p")))).alias("x")).select("k", "y", "x.*")
    assert metrics.roc_auc(learning.fuse(views.where("k < 110"), views, "k", ["a", "b"])).first().auc > 0.8


def test_every_copy_knows_its_group(spark):
    rows = [(i, "x") for i in range(150)] + [(200, "y"), (201, None), (202, None)]
    out = {r.name: (r.n_same, r.first) for r in joins.aliases(spark.createDataFrame(rows, "name long, fp string"), fingerprint="fp", name="name").collect()}
    assert out[149] == (150, 0) and out[200] == (1, 200) and out[202] == (2, 201) and len(out) == len(rows)


def test_slices_of_a_class(spark):
    df = spark.createDataFrame([("a", i) for i in range(7)] + [("b", 10)], "label string, k long")
    assert {r.k for r in sampling.adaptation_slice(df, "label", "k", 3).where("adapt").collect()} == {0, 1, 2, 10}
    assert [tuple(r) for r in sampling.short_classes(df, "label", 3).collect()] == [("b", 1)]
