"""Thresholds, ROC and samples against brute force."""

import random

from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tessera.operators import metrics, reports, sampling

SLOW = settings(max_examples=6, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
POINTS = st.lists(st.tuples(st.integers(0, 1), st.integers(0, 20)), min_size=1, max_size=40)


def frame(spark, pairs):
    return spark.createDataFrame([(y, p / 20.0) for y, p in pairs], "y int, p double")


@SLOW
@given(POINTS)
def test_auc_counts_ties_half(spark, pairs):
    got = metrics.roc_auc(frame(spark, pairs)).first().auc
    pos, neg = [p for y, p in pairs if y], [p for y, p in pairs if not y]
    want = sum((a > b) + (a == b) / 2 for a in pos for b in neg) / (len(pos) * len(neg)) if pos and neg else None
    assert got is None if want is None else abs(got - want) < 1e-12


def corner_threshold(pairs, percent=5):
    ps = sorted({p for _, p in pairs}, reverse=True)
    n1, n0 = sum(y for y, _ in pairs), sum(1 - y for y, _ in pairs)
    if not n1 or not n0:
        return None
    at = [(p, sum(y for y, q in pairs if q >= p), sum(1 - y for y, q in pairs if q >= p)) for p in ps]
    keep = [a for i, a in enumerate(at) if len(at) <= 2 or i in (0, len(at) - 1) or any(at[i + 1][k] - 2 * a[k] + at[i - 1][k] for k in (1, 2))]
    return min((a[0] / 20 for a in keep if 100 * a[2] <= percent * n0), default=None)


@SLOW
@given(POINTS)
def test_threshold_is_the_lowest_corner_within_the_rate(spark, pairs):
    assert metrics.threshold_at_fpr(frame(spark, pairs)).first()[0] == corner_threshold(pairs)


def test_unreachable_threshold_is_null(spark):
    assert metrics.threshold_at_fpr(frame(spark, [(0, 18)] * 4 + [(1, 2)] * 2)).first()[0] is None


def test_six_rows_by_hand(spark):
    df = spark.createDataFrame([(1, 0.9), (1, 0.8), (1, 0.3), (0, 0.1), (0, 0.2), (0, 0.6)], "y int, p double")
    r = reports.overall_metrics(df).first()
    assert (r.accuracy, r.recall, r.precision, r.auc) == (round(4 / 6, 6), round(2 / 3, 6), round(2 / 3, 6), round(8 / 9, 6))


def test_group_without_fakes_has_no_fake_metrics(spark):
    df = spark.createDataFrame([("cam", 0, 0.1), ("cam", 0, 0.9), ("gen", 1, 0.8)], "g string, y int, p double")
    rows = {r.g: r for r in reports.group_metrics(df, "g").collect()}
    assert rows["cam"].fake_recall is None and rows["cam"].fake_precision is None and rows["cam"].real_acc == 0.5 and rows["gen"].real_acc is None


def test_best_threshold_keeps_the_largest_of_equals(spark):
    df = spark.createDataFrame([(1, 0.9), (0, 0.1)], "y int, p double")
    r = metrics.best_threshold(df).first()
    assert (r.threshold, r.balanced) == (0.9, 1.0)


def test_decision_arithmetic(spark):
    one = lambda c: spark.range(1).select(c).first()[0]
    shift = lambda p, t: one(metrics.odds_shift(F.lit(p), t))
    assert abs(shift(0.4, 0.4) - 0.5) < 1e-9 and shift(0.7, 0.4) > 0.5 > shift(0.2, 0.4) and shift(0.85, 0.90) < 0.5 < shift(0.99, 0.90)
    review = lambda p, s: one(metrics.needs_review(F.lit(p), F.lit(s)))
    assert [review(*x) for x in ((0.50, 0.01), (0.95, 0.01), (0.03, 0.01), (0.08, 0.01), (0.95, 0.30))] == [True, False, False, True, True]


def test_stride_and_places_match_plain_python(spark):
    rows = [(i, "ab"[i % 3 == 0], f"{random.Random(i).randrange(16**6):06x}") for i in range(500)]
    df = spark.createDataFrame(rows, "i int, g string, h string")
    got = {r.i for r in sampling.stride_sample(df, ["g"], ["h", "i"], 7, bucket=F.substring("h", 1, 1)).collect()}
    want = set()
    for g in "ab":
        s = sorted((h, i) for i, k, h in rows if k == g)
        step = max(1, len(s) // 7)
        want |= {s[j][1] for j in range(0, len(s), step) if j // step < 7}
    assert got == want


def test_ordinal_splits(spark):
    at = lambda f, i, t: spark.range(1).select(f(F.lit(i), t)).first()[0]
    assert [at(sampling.ordinal_split, i, 100) for i in (0, 80, 90)] == ["train", "val", "test"]
    assert [at(sampling.ordinal_split_parts, i, 20000) for i in (15999, 16000, 18000)] == ["train", "val", "test"]
    assert sampling.roll_forward([10, 1, 10], 12) == [4, 1, 7] and sampling.spread(10, 3) == [0, 4, 9]


def test_terciles_are_not_ntile(spark):
    df = spark.createDataFrame([(i, "real") for i in range(7)], "x int, label string")
    assert [r["count"] for r in sampling.terciles(df, "label", "x", "x").groupBy("tercile").count().orderBy("tercile").collect()] == [2, 2, 3]


def test_values_seen_first_at_one_place_are_ranked_by_value(spark):
    rows = [(None if v == 0 else f"v{v:02}", at) for v in range(30) for at in (5, 7)]
    random.Random(3).shuffle(rows)
    for parts in (1, 7):
        got = reports.most_common(spark.createDataFrame(rows, "v string, at int").repartition(parts), "v", "at")
        assert [r.v for r in sorted(got.collect(), key=lambda r: r["rank"])] == [None, *[f"v{v:02}" for v in range(1, 30)]]
