"""Group reports, panels, boards and class weights."""

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import written
from .metrics import auc_of, percentile_threshold, ratio, roc_auc, threshold_of


def tier_board(df: DataFrame, tier="tier", served: float = 0.5, percent: int = 5) -> DataFrame:
    """For each tier n, n_real, n_fake, auc, the served operating point, the threshold at the target FPR and the point
    there; rows without a score count in n, n_real and n_fake only. All of it from one histogram, which is written once."""
    p, y = F.col("p"), F.col("y")
    counts = written(df.groupBy(tier, "p").agg(F.count("*").alias("n"), F.count_if(y == 1).alias("n1"), F.count_if(y == 0).alias("n0")))
    h = counts.where("p is not null").drop("n")
    thr = threshold_of(h, [tier], percent).select(F.col(tier).alias("_t"), "threshold")
    some = lambda c, ok: F.sum(F.when(ok & p.isNotNull(), F.col(c)).otherwise(0))
    of = lambda c, ok: ratio(some(c, ok), some(c, F.lit(True)))
    mean = lambda c: ratio(F.sum(F.col(c) * p), some(c, F.lit(True)))
    by = counts.join(thr, F.col(tier).eqNullSafe(F.col("_t")), "left").groupBy(tier, "threshold")
    out = by.agg(
        F.sum("n").alias("n"), F.sum("n0").alias("n_real"), F.sum("n1").alias("n_fake"), mean("n0").alias("mean_p_real"), mean("n1").alias("mean_p_fake"),
        of("n0", p < served).alias("real_acc"), of("n1", p >= served).alias("fake_recall"), of("n1", p >= F.col("threshold")).alias("oracle_recall"),
    )
    out = out.withColumns({"fpr": 1 - F.col("real_acc"), "balanced": (F.col("real_acc") + F.col("fake_recall")) / 2, "oracle_recall": F.when(F.col("threshold").isNotNull(), F.col("oracle_recall"))})
    auc = auc_of(h, [tier]).select(F.col(tier).alias("_t"), "auc")
    out = out.join(auc, F.col(tier).eqNullSafe(F.col("_t")), "left").drop("_t").withColumnRenamed("threshold", "oracle_threshold")
    digits = ["auc", "mean_p_real", "mean_p_fake", "real_acc", "fake_recall", "fpr", "balanced", "oracle_recall"]
    return out.withColumns({c: F.round(c, 6) for c in digits}).withColumn("reachable", F.col("oracle_threshold").isNotNull()).withColumn("fpr_resolution", F.round(1 / F.greatest("n_real", F.lit(1)), 6))


def group_metrics(df: DataFrame, group: str, threshold: float = 0.5) -> DataFrame:
    """Per group n, n_real, n_fake, accuracy, real_acc (only with reals), fake_recall and fake_precision (only with fakes)."""
    hit, y = F.col("p") >= threshold, F.col("y") == 1
    tp, fp = F.count_if(hit & y), F.count_if(hit & ~y)
    return df.groupBy(group).agg(
        F.count("*").alias("n"), F.count_if(~y).alias("n_real"), F.count_if(y).alias("n_fake"),
        F.round(F.avg((hit == y).cast("double")), 6).alias("accuracy"),
        F.round(F.avg(F.when(~y, (~hit).cast("double"))), 6).alias("real_acc"),
        F.round(F.avg(F.when(y, hit.cast("double"))), 6).alias("fake_recall"),
        F.round(F.when(F.count_if(y) > 0, ratio(tp, tp + fp)), 6).alias("fake_precision"),
    )


def overall_metrics(df: DataFrame, groups: Sequence[str] = (), threshold: float = 0.5) -> DataFrame:
    hit, y = F.col("p") >= threshold, F.col("y") == 1
    tp, fp, fn = F.count_if(hit & y), F.count_if(hit & ~y), F.count_if(~hit & y)
    real, fake = F.avg(F.when(~y, (~hit).cast("double"))), F.avg(F.when(y, hit.cast("double")))
    m = df.groupBy(*groups).agg(F.count("*").alias("n"), *[F.round(v, 6).alias(k) for k, v in {
        "accuracy": F.avg((hit == y).cast("double")), "balanced": (real + fake) / 2, "precision": ratio(tp, tp + fp), "recall": fake, "f1": ratio(2 * tp, 2 * tp + fp + fn),
        "mean_p_real": F.avg(F.when(~y, F.col("p"))), "mean_p_fake": F.avg(F.when(y, F.col("p")))}.items()])
    a = roc_auc(df, groups).select(*groups, F.round("auc", 6).alias("auc"))
    return m.join(a, list(groups)) if groups else m.crossJoin(F.broadcast(a))  # one row each


def rollup_summary(df: DataFrame, group: str, threshold: float = 0.5) -> DataFrame:
    """level, grp, y, n, accuracy for (group, class), class and all, in one pass of grouping sets; balanced is the mean of
    the classes' rounded accuracies."""
    ok = (F.col("p") >= threshold) == (F.col("y") == 1)
    g = df.groupingSets([[group, "y"], ["y"], []], group, "y").agg(F.count("*").alias("n"), F.round(F.avg(ok.cast("double")), 4).alias("accuracy"), F.round(F.avg("p"), 6).alias("mean_p"), F.grouping_id().alias("gid"))
    level = F.when(F.col("gid") == 0, "group").when(F.col("gid") == 2, "class").otherwise("all")
    out = g.select(level.alias("level"), F.col(group).alias("grp"), "y", "n", "accuracy", "mean_p")
    bal = out.where("level = 'class'").agg(F.round(F.avg("accuracy"), 4).alias("balanced"))
    return out.crossJoin(F.broadcast(bal)).withColumn("balanced", F.when(F.col("level") == "all", F.col("balanced")))


def range_bin(value: Column, edges: Sequence[int | None]) -> Column:
    """The half-open range [lo, hi) of a value as 'lo-hi', the last one as 'lo+'."""
    out = F.lit(None).cast("string")
    for lo, hi in reversed(list(zip(edges, edges[1:], strict=False))):
        inside = (value >= lo) & (F.lit(True) if hi is None else value < hi)
        out = F.when(inside, f"{lo}+" if hi is None else f"{lo}-{hi}").otherwise(out)
    return out


def panel(df: DataFrame, key: Column, *, label="label", share: float = 0.02, skew: float = 0.20) -> DataFrame:
    """bin, n_real, n_fake, share of all rows, fake share and the LEAK flag of bins that tell the class."""
    g = df.groupBy(key.alias("bin")).agg(F.count_if(F.col(label) == "real").alias("n_real"), F.count_if(F.col(label) == "fake").alias("n_fake"), F.count("*").alias("n"))
    total = g.agg(F.sum("n").alias("total"))
    g = g.crossJoin(F.broadcast(total)).withColumns({"share": ratio(F.col("n"), F.col("total")), "fake_share": ratio(F.col("n_fake"), F.col("n"))})
    flag = (F.col("share") >= share) & (F.abs(F.col("fake_share") - 0.5) > skew)
    return g.select("bin", "n_real", "n_fake", F.round("share", 6).alias("share"), F.round("fake_share", 6).alias("fake_share"), flag.alias("leak"))


def share_gap(df: DataFrame, value: str, *, label="label") -> DataFrame:
    """value, real_share, fake_share, gap in points and its verdict (OK below 20, WATCH below 45, else SHORTCUT RISK)."""
    g = df.groupBy(value).agg(F.count_if(F.col(label) == "real").alias("r"), F.count_if(F.col(label) == "fake").alias("f"))
    t = g.agg(F.sum("r").alias("tr"), F.sum("f").alias("tf"))
    s = g.crossJoin(F.broadcast(t)).withColumns({"real_share": 100 * ratio(F.col("r"), F.col("tr")), "fake_share": 100 * ratio(F.col("f"), F.col("tf"))})
    gap = F.round(F.abs(F.col("real_share") - F.col("fake_share")), 6)
    return s.select(value, F.round("real_share", 6).alias("real_share"), F.round("fake_share", 6).alias("fake_share"), gap.alias("gap"), F.when(gap < 20, "OK").when(gap < 45, "WATCH").otherwise("SHORTCUT RISK").alias("verdict"))


def crosstab(df: DataFrame, rows: str, cols: str, values: Sequence[str]) -> DataFrame:
    """Counts of rows by the given column values, with totals of each line and a line of totals."""
    g = df.groupingSets([[rows], []], rows).agg(*[F.count_if(F.col(cols) == v).alias(v) for v in values], F.count("*").alias("total"), F.grouping_id().alias("g"))
    return g.select(F.when(F.col("g") == 1, "total").otherwise(F.col(rows)).alias(rows), *values, "total")


def edge_summary(df: DataFrame, group: str, value: str) -> DataFrame:
    """min, upper median and max of a value for each group: the upper median is the element n div 2 of the order.

    Counted over distinct values, not over rows.
    """
    h = df.where(F.col(value).isNotNull()).groupBy(group, value).agg(F.count("*").alias("n"))
    w = Window.partitionBy(group)
    c = h.withColumns({"upto": F.sum("n").over(w.orderBy(value)), "total": F.sum("n").over(w)})
    return c.groupBy(group).agg(F.min(value).alias("least"), F.min(F.when(F.col("upto") > F.floor(F.col("total") / 2), F.col(value))).alias("upper_median"), F.max(value).alias("most"), F.sum("n").alias("n"))


def class_weights(df: DataFrame, label: str) -> DataFrame:
    """label, n, balanced weight N / (2 max(n, 1)) and normalised inverse weight."""
    g = df.groupBy(F.col(label).alias("label")).agg(F.count("*").alias("n"))
    t = g.agg(F.sum("n").alias("total"), F.sum(1 / (F.col("n") + F.lit(1e-8))).alias("inverse"))
    j = g.crossJoin(F.broadcast(t))
    return j.select("label", "n", F.round(F.col("total") / (2 * F.greatest("n", F.lit(1))), 6).alias("weight"), F.round(1 / (F.col("n") + F.lit(1e-8)) / F.col("inverse"), 6).alias("share"))


def leaderboard(df: DataFrame, by: str, key: str) -> DataFrame:
    """Ranked entries; the table has a row for each model."""
    return df.withColumn("rank", F.row_number().over(Window.orderBy(F.desc(by), key)))


def view_spread(df: DataFrame, key: str, p="p") -> DataFrame:
    return df.groupBy(key).agg(F.min(p).alias("least"), F.max(p).alias("most"), F.round(F.stddev_pop(p), 6).alias("spread"), F.round(F.avg(p), 9).alias("mean"))


def agreement(votes: Column, verdict: Column) -> Column:
    """How many votes of a map equal the verdict."""
    return F.size(F.filter(F.map_values(votes), lambda v: v == verdict))


def fingerprint(df: DataFrame, name: str, content: str) -> DataFrame:
    """An order-independent digest of named blocks: of how many there are and of the sums of their digests' parts, which
    each task adds up by itself."""
    h = F.sha2(F.concat_ws("\0", F.col(name).cast("string"), F.sha2(F.col(content).cast("string"), 256)), 256)
    return df.select(h.alias("h")).agg(digest_of("h").alias("digest"))


def digest_of(h: str) -> Column:
    """As an aggregate: a digest of the number of hex digests of a column and of the sums of their parts of 15 digits."""
    parts = [F.sum(F.conv(F.substring(h, i, 15), 16, 10).cast("decimal(38,0)")).cast("string") for i in (1, 16, 31, 46)]
    return F.sha2(F.concat_ws("-", F.count(h).cast("string"), *parts), 256)


def misses(df: DataFrame, group: str, key: str, most: int = 20, threshold: float = 0.5) -> DataFrame:
    """Rows on the wrong side of the threshold: of each group and class the first `most` by key, with how many there are."""
    wrong = df.where((F.col("p") >= threshold) != (F.col("y") == 1))
    n = wrong.groupBy(F.col(group).alias("_g"), F.col("y").alias("_y")).agg(F.count("*").alias("n_missed"))
    first = wrong.withColumn("_r", F.row_number().over(Window.partitionBy(group, "y").orderBy(key))).where(F.col("_r") <= most)
    return first.join(n, F.col(group).eqNullSafe(F.col("_g")) & (F.col("y") == F.col("_y"))).select(group, "y", key, "p", "n_missed")


def corpus_report(df: DataFrame, panels: dict[str, Column], *, label="label") -> DataFrame:
    """panel, label, value, n, mean_megapixels and rank (by count, then value) of a corpus by class and several keys, and
    of the classes themselves (panel 'class'); one pass, a row counts once in each panel."""
    keys = F.array(*[F.struct(F.lit(k).alias("panel"), c.cast("string").alias("value")) for k, c in {"class": F.lit(""), **panels}.items()])
    mega = F.col("width").cast("double") * F.col("height") / 1e6
    g = df.select(label, mega.alias("mega"), F.inline(keys)).groupBy("panel", label, "value").agg(F.count("*").alias("n"), F.round(F.avg("mega"), 6).alias("mean_megapixels"))
    return g.withColumn("rank", F.row_number().over(Window.partitionBy("panel", label).orderBy(F.desc("n"), "value")))


def group_report(df: DataFrame, group: str, order: str, threshold: float = 0.5) -> DataFrame:
    """Each group under the class of its first row by `order`: y, n, mean_p, and the share of its rows that the threshold
    puts to that class; classes and then groups give the order of the report."""
    g = df.groupBy(F.coalesce(F.col(group), F.lit("?")).alias(group)).agg(F.min_by("y", order).alias("y"), F.count("*").alias("n"), F.round(F.avg("p"), 6).alias("mean_p"), F.avg((F.col("p") >= threshold).cast("double")).alias("hit"))
    return g.select(group, "y", "n", "mean_p", F.round(F.when(F.col("y") == 1, F.col("hit")).otherwise(1 - F.col("hit")), 6).alias("right")).orderBy("y", group)


def epoch_metrics(df: DataFrame, epochs: Sequence[str], fpr: float = 0.05) -> DataFrame:
    """For each epoch n, the mean loss, accuracy at 0.5, auc, and the threshold that keeps the false positive rate with the
    recall there."""
    ok = (F.col("p") >= 0.5) == (F.col("y") == 1)
    base = df.groupBy(*epochs).agg(F.count("*").alias("n"), F.round(F.avg("loss"), 6).alias("loss"), F.round(F.avg(ok.cast("double")), 6).alias("accuracy"))
    auc = roc_auc(df, epochs).select(*epochs, F.round("auc", 6).alias("auc"))
    at = percentile_threshold(df, epochs, fpr).select(*epochs, F.round("threshold", 6).alias("threshold"), F.round("recall", 6).alias("recall"))
    return base.join(auc, list(epochs)).join(at, list(epochs))


def most_common(df: DataFrame, value: str, order: str, most: int = 0) -> DataFrame:
    """value, n and rank of values by their count, those of one count in the order in which they were seen first, those
    seen first at the same place by value, so that reruns agree; null is a value like others. With `most` only so many."""
    g, by = df.groupBy(value).agg(F.count("*").alias("n"), F.min(order).alias("_first")), [F.desc("n"), F.col("_first"), F.col(value)]
    top = g.orderBy(*by).limit(most) if most else g
    return top.withColumn("rank", F.row_number().over(Window.orderBy(*by))).drop("_first")  # a row for each value
