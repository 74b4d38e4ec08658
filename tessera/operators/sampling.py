"""Splits, caps, quotas and samples: deterministic, by hash or by an explicit order, never by arrival.

Ranks run inside the given groups. Where a group can hold most rows and only its first k matter, the rank is filtered
at once, which Spark plans as a group limit before the shuffle; where a place in a whole group is needed, places are
counted in hash buckets and offset by the buckets before.
"""

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

PRIORITY = {"holdout": 0, "test": 1, "val": 2, "train": 3}


def hash_split(sha: Column, train: float = 0.8, val: float = 0.9) -> Column:
    """Split by the first 8 hex digits of a content hash."""
    f = F.conv(F.substring(sha, 1, 8), 16, 10).cast("double") / F.lit(4294967295.0)
    return F.when(f < train, "train").when(f < val, "val").otherwise("test")


def ordinal_split(index: Column, target: Column | int) -> Column:
    """By place in a target: below int(.8 t) train, below int(.9 t) val, else test."""
    t = F.lit(target) if isinstance(target, int) else target
    return F.when(index < F.floor(t * 0.8), "train").when(index < F.floor(t * 0.9), "val").otherwise("test")


def ordinal_split_parts(index: Column, target: Column | int) -> Column:
    """As ordinal_split, but val ends at int(.8 t) + int(.1 t)."""
    t = F.lit(target) if isinstance(target, int) else target
    return F.when(index < F.floor(t * 0.8), "train").when(index < F.floor(t * 0.8) + F.floor(t * 0.1), "val").otherwise("test")


def placed(df: DataFrame, order: Sequence[str], groups: Sequence[str] = (), *, bucket: Column | None = None, start: int = 0) -> DataFrame:
    """Add `place`, the row's number in its group's order, and `group_size`.

    `bucket` must not decrease along the order (a prefix of a hash, a range): ranks are counted inside buckets and
    offset by the sizes of the buckets before, so no group is sorted in one task.
    """
    b = df.withColumn("_b", bucket if bucket is not None else F.lit(0))
    sizes = b.groupBy(*groups, "_b").agg(F.count("*").alias("_n"))
    over = Window.partitionBy(*groups) if groups else Window.partitionBy(F.lit(0))
    base = sizes.select(*groups, "_b", (F.sum("_n").over(over.orderBy("_b")) - F.col("_n")).alias("_base"), F.sum("_n").over(over).alias("group_size"))
    local = b.withColumn("_r", F.row_number().over(Window.partitionBy(*groups, "_b").orderBy(*order)))
    keys = [F.col(f"l.{g}").eqNullSafe(F.col(f"r.{g}")) for g in [*groups, "_b"]]
    cond = keys[0]
    for k in keys[1:]:
        cond = cond & k
    out = local.alias("l").join(base.alias("r"), cond)
    return out.select(*[F.col(f"l.{c}") for c in df.columns], (F.col("l._r") + F.col("r._base") - 1 + start).alias("place"), F.col("r.group_size"))


def hash_order_split(df: DataFrame, key: str, seed: int = 42) -> DataFrame:
    """An exact 80/10/10 split in the order of a salted hash of the key; split sizes are those of a seeded shuffle."""
    h = F.md5(F.concat_ws(":", F.lit(str(seed)), F.col(key).cast("string")).cast("binary"))
    p = placed(df.withColumn("_h", h), ["_h", key], bucket=F.substring("_h", 1, 3))
    return p.withColumn("split", ordinal_split(F.col("place"), F.col("group_size"))).drop("_h", "place", "group_size")


def cap_per_group(df: DataFrame, groups: Sequence[str], order: Sequence, k: int) -> DataFrame:
    """The first k rows of each group; 0 means all."""
    if not k:
        return df
    return df.withColumn("_r", F.row_number().over(Window.partitionBy(*groups).orderBy(*order))).where(F.col("_r") <= k).drop("_r")


def stride_sample(df: DataFrame, groups: Sequence[str], order: Sequence[str], k: int, *, bucket: Column | None = None) -> DataFrame:
    """k rows of each group, spread evenly: every max(1, n div k)-th in order."""
    step = F.greatest(F.lit(1), F.floor(F.col("group_size") / k))
    p = placed(df, order, groups, bucket=bucket)
    return p.where((F.pmod("place", step) == 0) & (F.floor(F.col("place") / step) < k)).drop("place", "group_size")


def stratified_holdout(df: DataFrame, groups: Sequence[str], key: str, fraction: float, *, seed: int = 42) -> DataFrame:
    """Add `held`: of n rows max(6, int(n f)) if n >= 20, else max(2, n div 5), by hash order."""
    n = F.col("group_size")
    want = F.when(n >= 20, F.greatest(F.lit(6), F.floor(n * fraction))).otherwise(F.greatest(F.lit(2), F.floor(n / 5)))
    h = F.md5(F.concat_ws(":", F.lit(str(seed)), F.col(key).cast("string")).cast("binary"))
    p = placed(df.withColumn("_h", h), ["_h", key], groups, bucket=F.substring("_h", 1, 3))
    return p.withColumn("held", F.col("place") < want).drop("_h", "place", "group_size")


def adaptation_slice(df: DataFrame, label: str, order: str, k: int) -> DataFrame:
    """Add `adapt`, true for the first k of each class by `order`, a unique column: those up to the k-th value of it."""
    cut = cap_per_group(df.select(label, order), [label], [order], k).groupBy(F.col(label).alias("_label")).agg(F.max(order).alias("_cut"))
    marked = df.join(cut, F.col(label).eqNullSafe(F.col("_label")), "left")
    return marked.withColumn("adapt", F.coalesce(F.col(order) <= F.col("_cut"), F.col(order).isNull())).drop("_label", "_cut")


def short_classes(df: DataFrame, label: str, k: int) -> DataFrame:
    """label, n of the classes that have fewer than k rows, for which a slice of k is refused."""
    return df.groupBy(label).agg(F.count("*").alias("n")).where(F.col("n") < k)


def range_bucket(df: DataFrame, column: str, n: int = 64) -> Column:
    """A bucket that grows with the column, by its approximate quantiles over all rows."""
    edges = df.agg(F.percentile_approx(column, [i / n for i in range(1, n)], 1000)).first()[0] or []
    return F.size(F.filter(F.array(*[F.lit(e) for e in sorted(set(edges))]), lambda e: e < F.col(column))) if edges else F.lit(0)


def terciles(df: DataFrame, label: str, feature: str, key: str, least: int = 6) -> DataFrame:
    """Add `tercile` with cuts at n div 3 and 2 n div 3 (not ntile); classes of fewer than `least` rows go."""
    p = placed(df, [feature, key], [label], bucket=F.when(F.col(feature).isNull(), -1).otherwise(range_bucket(df, feature))).where(F.col("group_size") >= least)
    n = F.col("group_size")
    return p.withColumn("tercile", F.when(F.col("place") < F.floor(n / 3), 0).when(F.col("place") < F.floor(n * 2 / 3), 1).otherwise(2)).drop("place", "group_size")


def quota_per_key(df: DataFrame, keys: Sequence[str], order: Sequence[str], target: int, had: DataFrame | None = None) -> DataFrame:
    """Rows in order until each key's target is met, counting those it `had` (keys, n) already."""
    r = df.withColumn("_r", F.row_number().over(Window.partitionBy(*keys).orderBy(*order)))
    if had is None:
        return r.where(F.col("_r") <= target).drop("_r")
    return r.where(F.col("_r") <= target).join(had, list(keys), "left").where(F.col("_r") + F.coalesce("n", F.lit(0)) <= target).drop("_r", "n")


def share_quota(df: DataFrame, label: str, shape: str, order: Sequence[str], total: int, shares: dict[str, float]) -> DataFrame:
    """Per class, at most int(total * share) rows of each shape."""
    limit = F.create_map(*[F.lit(x) for k, v in shares.items() for x in (k, int(total * v))])
    r = F.row_number().over(Window.partitionBy(label, shape).orderBy(*order))
    most = max(int(total * v) for v in shares.values())  # a fixed bound first, by which ranks are cut before the shuffle
    return df.withColumn("_r", r).where(F.col("_r") <= most).where(F.col("_r") <= F.coalesce(F.try_element_at(limit, F.col(shape)), F.lit(0))).drop("_r")


def roll_forward(supply: Sequence[int], target: int) -> list[int]:
    """How many each category gives when every one is asked for its part of what is still lacking."""
    got, out = 0, []
    for i, n in enumerate(supply):
        take = min(n, -(-(target - got) // (len(supply) - i)))
        out.append(take)
        got += take
    return out


def spread(total: int, n: int) -> list[int]:
    """n places spread evenly over range(total), both ends included."""
    return sorted({round(i * (total - 1) / (n - 1)) for i in range(n)}) if 1 < n < total else list(range(min(n, total)))


def replay_mix(df: DataFrame, bucket: str, key: str, heads: dict[str, int], seed: int = 42) -> DataFrame:
    """A fixed number of rows of each bucket in hash order, all of the buckets not named."""
    h = F.md5(F.concat_ws(":", F.lit(str(seed)), F.col(key).cast("string")).cast("binary"))
    named, limit = F.col(bucket).isin(*heads), F.create_map(*[F.lit(x) for kv in heads.items() for x in kv])
    ranked = df.where(named).withColumn("_r", F.row_number().over(Window.partitionBy(bucket).orderBy(h, key))).where(F.col("_r") <= max(heads.values()))
    return df.where(~F.coalesce(named, F.lit(False))).union(ranked.where(F.col("_r") <= limit[F.col(bucket)]).drop("_r"))
