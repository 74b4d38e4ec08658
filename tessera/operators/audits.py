"""Audit reports over scores, training runs and corpora: flags, variants, choices, stopping points, quotas, schema checks."""

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .metrics import rank_auc, ratio, roc_auc
from .reports import digest_of
from .sampling import cap_per_group


def baseline_flags(df: DataFrame, group: str, threshold: float = 0.5) -> DataFrame:
    """group, y, n, accuracy, mean_p and flag: MISSED for positives found in under a quarter, FALSE ALARMS for negatives
    left alone in under a half. Ordered by y, then group, by whoever shows it."""
    right = (F.col("p") >= threshold) == (F.col("y") == 1)
    g = df.groupBy(group, "y").agg(F.count("*").alias("n"), F.avg(right.cast("double")).alias("a"), F.round(F.avg("p"), 6).alias("mean_p"))
    flag = F.when((F.col("y") == 1) & (F.col("a") < 0.25), "MISSED").when((F.col("y") == 0) & (F.col("a") < 0.5), "FALSE ALARMS").otherwise("")
    return g.select(group, "y", "n", F.round("a", 6).alias("accuracy"), "mean_p", flag.alias("flag"))


def variant_report(df: DataFrame, group: str, variant: str, threshold: float = 0.5) -> DataFrame:
    """group, variant, n, mean_p, accuracy, and the variant's balanced accuracy over all groups."""
    right = (F.col("p") >= threshold) == (F.col("y") == 1)
    g = df.groupBy(group, variant).agg(F.count("*").alias("n"), F.round(F.avg("p"), 6).alias("mean_p"), F.round(F.avg(right.cast("double")), 6).alias("accuracy"))
    each = lambda y: F.avg(F.when(F.col("y") == y, right.cast("double")))
    b = df.groupBy(variant).agg(F.round((each(0) + each(1)) / 2, 6).alias("balanced"))
    return g.join(b, variant)


def percent_scores(df: DataFrame, groups: Sequence[str], threshold: float = 0.5) -> DataFrame:
    """groups, n, accuracy, real and fake accuracy in percent of 2 decimals, f1 and auc with 4."""
    hit, y = F.col("p") >= threshold, F.col("y") == 1
    tp, wrong = F.count_if(hit & y), F.count_if(hit != y)
    of = lambda c: F.round(100 * F.avg(c), 2)
    m = df.groupBy(*groups).agg(F.count("*").alias("n"), of((hit == y).cast("double")).alias("accuracy"), F.round(ratio(2 * tp, 2 * tp + wrong), 4).alias("f1"), of(F.when(~y, (~hit).cast("double"))).alias("real_accuracy"), of(F.when(y, hit.cast("double"))).alias("fake_accuracy"))
    return m.join(roc_auc(df, groups).select(*groups, F.round("auc", 4).alias("auc")), list(groups))


def by_prefix(df: DataFrame, name: str, prefixes: Sequence[str]) -> DataFrame:
    """percent_scores for each file name prefix; rows without one of them are left out."""
    tier = F.regexp_extract(F.col(name), "(?:^|/)(" + "|".join(prefixes) + ")[^/]*$", 1)
    return percent_scores(df.withColumn("tier", F.rtrim(F.translate(tier, "_", " "))).where("tier <> ''"), ["tier"])


def choose_strategy(df: DataFrame, strategy: str, order: str) -> DataFrame:
    """percent_scores of each strategy, and `best`, the first in order of those with the highest AUC."""
    auc = roc_auc(df, [strategy, order])
    best = auc.agg(F.max_by(strategy, F.struct("auc", -F.col(order))).alias("_best"))
    s = percent_scores(df, [strategy]).crossJoin(F.broadcast(best))  # one row
    return s.withColumn("best", F.col(strategy) == F.col("_best")).drop("_best")


def feature_auc(df: DataFrame, features: Sequence[str], positive: Column) -> DataFrame:
    """feature, n1, n0, auc by plain ranks of each numeric column."""
    rows = df.select(positive.cast("int").alias("y"), F.explode(F.array(*[F.struct(F.lit(f).alias("feature"), F.col(f).cast("double").alias("p")) for f in features])).alias("x"))
    return rank_auc(rows.select("y", "x.feature", "x.p"), ["feature"])


def early_stopping(epochs: DataFrame, run: str, epoch: str, loss: str, *, patience: int = 4, min_delta: float = 1e-4) -> DataFrame:
    """run, best (the last loss that fell by more than min_delta below the best before), stopped (the epoch at which
    `patience` epochs in a row had brought none, null if never) and waited. A run has a row for each epoch, in one list."""
    steps = epochs.groupBy(run).agg(F.array_sort(F.collect_list(F.struct(F.col(epoch).alias("e"), F.col(loss).cast("double").alias("l")))).alias("steps"))
    start = F.struct(F.lit(float("inf")).alias("best"), F.lit(0).alias("waited"), F.lit(None).cast("long").alias("stopped"))

    def step(s, x):
        better = x["l"] < s["best"] - min_delta
        waited = F.when(better, 0).otherwise(s["waited"] + 1)
        now = F.struct(F.when(better, x["l"]).otherwise(s["best"]).alias("best"), waited.alias("waited"), F.when(waited >= patience, x["e"].cast("long")).alias("stopped"))
        return F.when(s["stopped"].isNotNull(), s).otherwise(now)

    s = steps.select(run, F.aggregate("steps", start, step).alias("s"))
    return s.select(run, "s.best", "s.waited", "s.stopped")


def first_best(epochs: DataFrame, run: str, epoch: str, value: str) -> DataFrame:
    """run, epoch, value: the first epoch of the highest value."""
    return epochs.groupBy(run).agg(F.max_by(F.struct(epoch, value), F.struct(value, -F.col(epoch))).alias("_m")).select(run, "_m.*")


def roll_forward(categories: DataFrame, group: str, order: str, supply: str, target: int) -> DataFrame:
    """group, order, take: every category in order is asked for its even part of what is still lacking, and gives at most
    its supply. A group's categories are one short list."""
    rows = categories.groupBy(group).agg(F.array_sort(F.collect_list(F.struct(F.col(order).alias("o"), F.col(supply).cast("long").alias("n")))).alias("c"))
    empty = F.array().cast("array<bigint>")

    def step(taken, x):
        got = F.aggregate(taken, F.lit(0).cast("long"), lambda a, b: a + b)
        ask = F.ceil((target - got) / (F.size("c") - F.size(taken))).cast("long")
        return F.concat(taken, F.array(F.least(x["n"], ask)))

    taken = rows.withColumn("t", F.aggregate("c", empty, step))
    return taken.select(group, F.posexplode("t").alias("i", "take"), "c").select(group, F.get(F.col("c"), F.col("i"))["o"].alias(order), "take")


def target_quota(rows: DataFrame, configs: DataFrame, splits: DataFrame, order: str, limit: int) -> DataFrame:
    """Rows of each target (config and split, every pair of them) in order, at most max(1, limit div targets) of each."""
    targets = configs.select("config").distinct().crossJoin(F.broadcast(splits.select("split").distinct()))  # names of both
    n = targets.count()
    return cap_per_group(rows.join(targets, ["config", "split"], "left_semi"), ["config", "split"], [order], max(1, limit // max(1, n)))


def balanced_tiers(df: DataFrame, tier: str, label: str, order: str, quotas: dict[str, int], balanced: Sequence[str] = ()) -> DataFrame:
    """The first rows of each (tier, label) up to the tier's quota; in balanced tiers each class gives as many as the
    least class of the tier has."""
    quota = F.create_map(*[F.lit(x) for kv in quotas.items() for x in kv])
    n = df.groupBy(tier, label).agg(F.count("*").alias("_n")).groupBy(F.col(tier).alias("_t")).agg(F.min("_n").alias("_least"))
    ranked = df.withColumn("_r", F.row_number().over(Window.partitionBy(tier, label).orderBy(order))).where(F.col("_r") <= max(quotas.values()))
    k = F.when(F.col(tier).isin(*balanced), F.least(F.col("_least"), F.try_element_at(quota, F.col(tier)))).otherwise(F.try_element_at(quota, F.col(tier)))
    return ranked.join(n, F.col(tier) == F.col("_t")).where(F.col("_r") <= F.coalesce(k, F.lit(0))).drop("_r", "_t", "_least")


def scheme_delta(df: DataFrame, tag: str, scheme: str, value: str, served: str) -> DataFrame:
    """tag, best scheme, its value and how far it is above the served one's; the first name of equals."""
    g = df.groupBy(tag).agg(F.max(F.struct(F.col(value), F.col(scheme))).alias("_any"), F.max(F.when(F.col(scheme) == served, F.col(value))).alias("served"), F.max(value).alias("best_value"))
    names = df.join(g.select(tag, "best_value"), tag).where(F.col(value) == F.col("best_value")).groupBy(tag).agg(F.min(scheme).alias("best"))
    return g.join(names, tag).select(tag, "best", "best_value", F.round(F.col("best_value") - F.col("served"), 6).alias("delta"))


def class_probability(classes: Column, probabilities: Column, wanted) -> Column:
    """The probability of a class by an estimator's class order, 0 where it has no such class."""
    return F.coalesce(F.try_element_at(F.map_from_arrays(classes, probabilities), F.lit(wanted)), F.lit(0.0))


def training_rows(df: DataFrame, split: str, order: str, limit: int = 0) -> DataFrame:
    """The rows of a split in order, the first `limit` of them if that is not 0."""
    rows = df.where(F.col("split") == split)
    return rows.orderBy(order).limit(limit) if limit else rows


def missing_fields(present: Column, required: Sequence[str]) -> Column:
    return F.array_sort(F.array_except(F.array(*[F.lit(x) for x in required]), present))


def manifest_identity(lines: DataFrame, *, line="value", order: str) -> DataFrame:
    """rows (non-empty lines) and a digest of the digests of lines with their numbers: one row. Two manifests agree in it if
    they have the same lines in the same places."""
    h = lines.select(F.sha2(F.concat_ws("\0", F.col(order).cast("string"), line), 256).alias("h"), F.trim(line).alias("t"))
    return h.agg(F.count_if(F.col("t") != "").alias("rows"), digest_of("h").alias("digest"))
