"""Kernel and nearest classifiers, fused heads, the probe."""

import math
import random

import pytest
from pyspark.ml.functions import array_to_vector
from pyspark.sql import functions as F

from tessera.operators import learning, metrics


def ring(n, seed):
    """A disc inside a ring, which no line divides."""
    rng, rows = random.Random(seed), []
    for i in range(n):
        r, a = rng.gauss(0.6 if i % 2 else 2.2, 0.2), rng.uniform(0, 2 * math.pi)
        rows.append((i, i % 2, [r * math.cos(a), r * math.sin(a)]))
    return rows


@pytest.fixture(scope="module")
def rings(spark):
    return spark.createDataFrame(ring(400, 1), "k long, y int, v array<double>").select("k", "y", array_to_vector("v").alias("features"))


def test_kernel_and_nearest_tell_what_a_line_cannot(rings):
    zoo = learning.model_zoo(dims=2, key="k")
    assert set(zoo) == {"logistic", "tree", "forest", "linear_svm", "rbf_svm", "nearest", "gaussian_nb"}
    out = {r["model"]: r for r in learning.cross_validate(rings, {m: zoo[m] for m in ("linear_svm", "rbf_svm", "nearest")}, "k", 3).collect()}
    assert out["linear_svm"].accuracy < 70
    assert all(out[m].accuracy > 97 and out[m].auc > 98 for m in ("rbf_svm", "nearest"))


def test_random_waves_approach_the_kernel(spark):
    rows = [(i, [random.Random(i).gauss(0, 1) for _ in range(4)]) for i in range(30)]
    df = spark.createDataFrame(rows, "i int, v array<double>").select("i", array_to_vector("v").alias("x")).repartition(3)
    z = {r.i: r.z.toArray() for r in learning.RandomFourier("x", "z", size=8192, gamma=0.3).transform(df).collect()}
    off = [abs(float(z[i] @ z[j]) - math.exp(-0.3 * sum((a - b) ** 2 for a, b in zip(rows[i][1], rows[j][1], strict=True)))) for i in range(30) for j in range(30)]
    assert max(off) < 0.06


@pytest.mark.parametrize("block", [7, 10_000])
def test_nearest_rows_against_all_distances(spark, block):
    rng = random.Random(6)
    rows = [(i, rng.randrange(2), [float(rng.randrange(4)) for _ in range(3)]) for i in range(60)]
    df = spark.createDataFrame(rows, "k long, y int, v array<double>").select("k", "y", array_to_vector("v").alias("f"))
    model = learning.NearestClassifier("f", "y", "k", k=5, block=block).fit(df.where("k < 40"))
    got = {r.k: (r.rawPrediction[1], r.prediction) for r in model.transform(df.where("k >= 40")).collect()}
    for k, _, v in rows[40:]:
        d = sorted((sum((a - b) ** 2 for a, b in zip(v, w, strict=True)), y) for _, y, w in rows[:40])
        least, most = (sum(sorted((y for e, y in d if e == d[4][0]), reverse=r)[: 5 - sum(e < d[4][0] for e, _ in d)]) + sum(y for e, y in d if e < d[4][0]) for r in (False, True))
        assert least <= round(got[k][0] * 5) <= most and got[k][1] == float(got[k][0] > 0.5)
    with pytest.raises(ValueError):
        learning.NearestClassifier("f", "y", "k").fit(df.limit(0)).transform(df)


@pytest.fixture(scope="module")
def views(spark):
    """View a tells the classes of ordinary rows, and wrongly those of a new source; view b tells both."""
    rng, rows = random.Random(9), []
    for i in range(600):
        y, new = i % 2, i % 5 == 0
        rows.append((i, y, new, [rng.gauss((-2 if new else 2) * (y - 0.5), 0.7), rng.gauss(0, 1)], [rng.gauss(2 * (y - 0.5), 0.8)]))
    return spark.createDataFrame(rows, "k long, y int, new boolean, a array<double>, b array<double>")


def test_a_fusion_learns_from_adaptation_rows(spark, views, tmp_path):
    train, val = views.where("not new and k < 400"), views.where("not new and k >= 400")
    adapt, left = views.where("new and k < 300"), views.where("new and k >= 300")
    plain, fused = learning.fit_bundle(train, val, ["a", "b"], grid=(0.1, 1.0)), learning.fit_bundle(train, val, ["a", "b"], adaptation=adapt, grid=(0.1, 1.0))
    auc = lambda b: metrics.roc_auc(b.serve(left).select("y", F.col("p_fake").alias("p"))).first().auc
    assert plain.fusion is None and auc(fused) > 0.85 and auc(fused) > auc(plain) + 0.1
    r = plain.serve(left).first()
    assert r.p_fake == pytest.approx((r.p_a + r.p_b) / 2)
    assert set(fused.thresholds) == {"a", "b", "mean", "served"}
    assert val.count() * 0.05 / 2 >= fused.serve(val).where((F.col("y") == 0) & (F.col("p_fake") >= fused.thresholds["served"])).count()
    fused.save(spark, str(tmp_path / "b"))
    again = learning.Bundle.load(spark, str(tmp_path / "b"))
    assert again == fused
    with pytest.raises(ValueError):
        again.serve(left, ["b", "a"])
    with pytest.raises(ValueError):
        again.serve(left, ["c"])
    assert plain.serve(left, ["b"]).columns[-2:] == ["p_b", "p_fake"]


def test_the_probe_finds_the_statistic_that_tells(spark):
    rng = random.Random(3)
    rows = [(i, int(i % 3 == 0), rng.gauss(i % 3 == 0, 0.2) * 50, rng.gauss(0, 1), rng.gauss(0, 1) if i % 10 else None) for i in range(400)]
    df = spark.createDataFrame(rows, "k long, y int, told double, noise double, holes double")
    r = learning.shortcut_probe(df, "k", ["noise", "told", "holes"], top=2).first()
    assert r.n == 360 and r.balanced_accuracy > 0.95 and r.auc > 0.98 and len(r.top) == 2 and r.top[0].name == "told" and r.top[0].weight > 0
    r = learning.shortcut_probe(df.select("k", "y", "noise"), "k", ["noise"]).first()
    assert abs(r.auc - 0.5) < 0.15 and len(r.top) == 1
