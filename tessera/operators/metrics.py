"""ROC, thresholds and decisions over scores.

Everything ordered starts from `histogram`: counts by distinct score, made by an ordinary aggregate and written once, so
that the input is read once. Sums along the order of scores are made inside BUCKETS ranges between the least and the
largest score and offset by the ranges before, so a group with as many distinct scores as rows is not sorted in one task.
"""

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import written


def ratio(a: Column, b: Column) -> Column:
    return F.try_divide(a.cast("double"), b.cast("double"))


BUCKETS = 4096
#: Thresholds that are held against all groups at once.
MOST_GROUPS = 1000


def histogram(df: DataFrame, groups: Sequence[str] = (), *, y="y", p="p") -> DataFrame:
    """groups, p, n1, n0: positives and negatives at each distinct score."""
    return df.where(F.col(p).isNotNull()).groupBy(*groups, F.col(p).alias("p")).agg(F.count_if(F.col(y) == 1).alias("n1"), F.count_if(F.col(y) == 0).alias("n0"))


def _over(groups: Sequence[str]):
    return Window.partitionBy(*groups) if groups else Window.partitionBy(F.lit(0))


def running(h: DataFrame, groups: Sequence[str] = ()) -> DataFrame:
    """h (p, n1, n0 and more) with tp and fp, the sums of n1 and n0 over scores of p and more, t1 and t0, those of the
    group, and of the next lower score of h: next1, next0 (null at the last one); is_top at the first."""
    ends = h.agg(F.min("p").cast("double").alias("_least"), F.max("p").cast("double").alias("_most"))  # one row
    at = F.coalesce(F.try_divide(F.col("p") - F.col("_least"), F.col("_most") - F.col("_least")), F.lit(0.0))
    b = h.crossJoin(F.broadcast(ends)).withColumn("_b", F.floor(at * BUCKETS)).drop("_least", "_most")
    down, every = _over(groups).orderBy(F.desc("_b")), _over(groups)
    sums = b.groupBy(*groups, "_b").agg(F.sum("n1").alias("s1"), F.sum("n0").alias("s0"), F.max_by(F.struct("n1", "n0"), "p").alias("head"))
    sums = sums.select(*[F.col(g).alias(f"_{g}") for g in groups], F.col("_b").alias("_c"), (F.sum("s1").over(down) - F.col("s1")).alias("above1"), (F.sum("s0").over(down) - F.col("s0")).alias("above0"), F.sum("s1").over(every).alias("t1"), F.sum("s0").over(every).alias("t0"), F.lead("head").over(down).alias("below"), (F.row_number().over(down) == 1).alias("top"))
    inside = Window.partitionBy(*groups, "_b").orderBy(F.desc("p"))
    upto = inside.rangeBetween(Window.unboundedPreceding, Window.currentRow)
    local = b.withColumns({"tp": F.sum("n1").over(upto), "fp": F.sum("n0").over(upto), "next1": F.lead("n1").over(inside), "next0": F.lead("n0").over(inside), "is_top": F.row_number().over(inside) == 1})
    on = F.col("_b") == F.col("_c")
    for g in groups:
        on = on & F.col(g).eqNullSafe(F.col(f"_{g}"))
    out = local.join(sums, on)
    return out.select(*h.columns, (F.col("tp") + F.col("above1")).alias("tp"), (F.col("fp") + F.col("above0")).alias("fp"), "t1", "t0", F.coalesce("next1", "below.n1").alias("next1"), F.coalesce("next0", "below.n0").alias("next0"), (F.col("is_top") & F.col("top")).alias("is_top"))


def roc_auc(df: DataFrame, groups: Sequence[str] = (), **cols) -> DataFrame:
    """groups, n1, n0, auc with ties counted half; null for a single class. Sums are of integers, so exact."""
    return auc_of(written(histogram(df, groups, **cols)), groups)


def auc_of(h: DataFrame, groups: Sequence[str] = ()) -> DataFrame:
    """roc_auc of a histogram."""
    h = running(h, groups)
    u = h.withColumn("u2", F.col("n1").cast("decimal(38,0)") * (2 * (F.col("t0") - F.col("fp")) + F.col("n0")))
    g = u.groupBy(*groups).agg(F.sum("n1").alias("n1"), F.sum("n0").alias("n0"), F.sum("u2").cast("double").alias("u2"))
    return g.withColumn("auc", ratio(F.col("u2"), F.col("n1").cast("double") * F.col("n0") * 2)).drop("u2")


def rank_auc(df: DataFrame, groups: Sequence[str] = (), **cols) -> DataFrame:
    """groups, n1, n0, auc by plain ranks of a stable order that has the positives of a score before its negatives: ties
    are not averaged, a positive beats the negatives below it only; null for a single class."""
    h = running(written(histogram(df, groups, **cols)), groups)
    u = h.groupBy(*groups).agg(F.sum("n1").alias("n1"), F.sum("n0").alias("n0"), F.sum(F.col("n1").cast("decimal(38,0)") * (F.col("t0") - F.col("fp"))).cast("double").alias("u"))
    return u.withColumn("auc", ratio(F.col("u"), F.col("n1").cast("double") * F.col("n0"))).drop("u")


def roc_curve(df: DataFrame, groups: Sequence[str] = (), **cols) -> DataFrame:
    """groups, p, tp, fp, n1, n0 at the corners: the first and last score and those where a step changes direction."""
    return corners_of(written(histogram(df, groups, **cols)), groups)


def corners_of(h: DataFrame, groups: Sequence[str] = ()) -> DataFrame:
    """roc_curve of a histogram."""
    c = running(h, groups)
    bend = F.col("is_top") | F.col("next1").isNull() | (F.col("next1") != F.col("n1")) | (F.col("next0") != F.col("n0"))
    return c.where(bend).select(*groups, "p", "tp", "fp", F.col("t1").alias("_n1"), F.col("t0").alias("_n0")).withColumnsRenamed({"_n1": "n1", "_n0": "n0"})


def threshold_at_fpr(df: DataFrame, groups: Sequence[str] = (), percent: int = 5, **cols) -> DataFrame:
    """groups, threshold: the lowest corner with FPR within `percent`; null for a single class or if none is."""
    return threshold_of(written(histogram(df, groups, **cols)), groups, percent)


def threshold_of(h: DataFrame, groups: Sequence[str] = (), percent: int = 5) -> DataFrame:
    """threshold_at_fpr of a histogram."""
    ok = (F.col("n1") > 0) & (F.col("n0") > 0) & (100 * F.col("fp") <= percent * F.col("n0"))
    return corners_of(h, groups).groupBy(*groups).agg(F.min(F.when(ok, F.col("p"))).alias("threshold"))


def percentile_threshold(df: DataFrame, groups: Sequence[str] = (), fpr: float = 0.05, *, y="y", p="p") -> DataFrame:
    """groups, threshold, recall: the interpolated (1 - fpr) percentile of negatives; 0.5 and 0 if a class is empty.

    The percentile is exact and Spark keeps one count for each distinct score.
    """
    g = [F.col(c).alias(f"_{c}") for c in groups]
    t = df.groupBy(*g).agg(F.percentile(F.when(F.col(y) == 0, F.col(p)), 1 - fpr).alias("t"), F.count_if(F.col(y) == 1).alias("_n1"))
    t = t.withColumn("threshold", F.when(F.col("_n1") > 0, F.col("t")))
    on = [F.col(c).eqNullSafe(F.col(f"_{c}")) for c in groups] or None
    j = df.join(t, on) if on else df.crossJoin(F.broadcast(t))  # a row without groups
    r = j.groupBy(*groups, "threshold").agg(F.avg(F.when(F.col(y) == 1, (F.col(p) >= F.col("threshold")).cast("double"))).alias("recall"))
    return r.select(*groups, F.coalesce("threshold", F.lit(0.5)).alias("threshold"), F.when(F.col("threshold").isNull(), 0.0).otherwise(F.col("recall")).alias("recall"))


def operating_point(threshold: Column, *, y="y", p="p") -> dict[str, Column]:
    """real_acc, fake_recall, fpr and balanced as aggregates; null where a class is empty."""
    hit = F.col(p) >= threshold
    real, fake = F.avg(F.when(F.col(y) == 0, (~hit).cast("double"))), F.avg(F.when(F.col(y) == 1, hit.cast("double")))
    return {"real_acc": real, "fake_recall": fake, "fpr": 1 - real, "balanced": (real + fake) / 2}


def at_threshold(df: DataFrame, threshold: float, groups: Sequence[str] = (), *, digits: int = 6, **cols) -> DataFrame:
    return df.groupBy(*groups).agg(*[F.round(v, digits).alias(k) for k, v in operating_point(F.lit(threshold), **cols).items()])


def best_threshold(df: DataFrame, groups: Sequence[str] = (), **cols) -> DataFrame:
    """groups, threshold, balanced: the best over scores rounded to 3 decimals and 0.05, 0.06 .. 0.95; of equals the largest."""
    h = written(histogram(df, groups, **cols)).select(*groups, "p", "n1", "n0", F.lit(False).alias("ask"))
    fixed = F.explode(F.transform(F.sequence(F.lit(5), F.lit(95)), lambda i: F.round(i / F.lit(100.0), 3)))
    keys = h.select(*groups).distinct() if groups else df.sparkSession.range(1).select()
    grid = h.select(*groups, F.round("p", 3).alias("p")).union(keys.select(*groups, fixed.alias("p"))).distinct()
    both = h.union(grid.select(*groups, "p", F.lit(0), F.lit(0), F.lit(True)))
    c = running(both, groups).where("ask")
    bal = (F.coalesce(ratio(F.col("tp"), F.col("t1")), F.lit(0.0)) + F.coalesce(ratio(F.col("t0") - F.col("fp"), F.col("t0")), F.lit(0.0))) / 2
    return c.withColumn("b", F.round(bal, 9)).groupBy(*groups).agg(F.max(F.struct("b", "p")).alias("m")).select(*groups, F.col("m.p").alias("threshold"), F.col("m.b").alias("balanced"))


def applied_elsewhere(df: DataFrame, group: str, percent: int = 5, *, y="y", p="p") -> DataFrame:
    """fitted_on, group and the operating point there of the threshold fitted on each other group: one row a pair of
    groups, from the groups' score histograms (not from their rows). The board's groups are few: at most MOST_GROUPS."""
    h = written(histogram(df, [group], y=y, p=p))
    t = written(threshold_of(h, [group], percent).where("threshold is not null").select(F.col(group).alias("fitted_on"), "threshold"))
    if t.count() > MOST_GROUPS:
        raise ValueError(f"more than {MOST_GROUPS} groups")
    j = h.join(F.broadcast(t), F.col(group) != F.col("fitted_on"))  # at most MOST_GROUPS rows
    hit = F.col("p") >= F.col("threshold")
    n = lambda c, ok: F.sum(F.when(ok, F.col(c)).otherwise(0))
    return j.groupBy("fitted_on", group, "threshold").agg(F.round(ratio(n("n0", ~hit), F.sum("n0")), 6).alias("real_acc"), F.round(ratio(n("n1", hit), F.sum("n1")), 6).alias("fake_recall"))


def clipped(p: Column, eps: float = 1e-6) -> Column:
    return F.least(F.greatest(p, F.lit(eps)), F.lit(1 - eps))


def logit(p: Column) -> Column:
    return F.ln(p / (1 - p))


def odds_shift(p: Column, threshold: Column | float) -> Column:
    """The probability moved so that the threshold becomes 0.5."""
    t = F.lit(threshold) if isinstance(threshold, float) else threshold
    return 1 / (1 + F.exp(logit(clipped(t)) - logit(clipped(p))))


def needs_review(p: Column, spread: Column) -> Column:
    return ((p > 0.05) & (p < 0.90)) | (spread >= 0.22)


def abstains(p: Column, low: float = 0.30, high: float = 0.97) -> Column:
    return (p > low) & (p < high)


def weighted_views(df: DataFrame, keys: Sequence[str], *, p="p", w="w") -> DataFrame:
    """keys, p: the weighted mean over the views present, their plain mean where weights do not sum above 0."""
    s = F.sum(F.when(F.col(p).isNotNull(), F.col(w)))
    return df.groupBy(*keys).agg(F.when(s > 0, ratio(F.sum(F.col(w) * F.col(p)), s)).otherwise(F.avg(p)).alias("p"))


def probe_verdict(balanced: Column) -> Column:
    return F.when(balanced < 0.58, "ok").when(balanced < 0.68, "weak").when(balanced < 0.85, "strong").otherwise("severe")


def checkpoint_key(hard_loss: Column, union_acc: Column) -> Column:
    """The loss plus 0.05 for each point of accuracy lacking to 96.5; the least is kept, the first of equals."""
    return hard_loss + 0.05 * F.greatest(F.lit(0.0), 96.5 - union_acc)
