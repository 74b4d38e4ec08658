"""Manifest algebra: union, dedup by content, leaks, conflicts, verification."""

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..schemas import LABELS, REQUIRED, SPLITS
from .sampling import PRIORITY


def priority(split: Column) -> Column:
    return F.coalesce(F.try_element_at(F.create_map(*[F.lit(x) for kv in PRIORITY.items() for x in kv]), split), F.lit(9))


def content_key(sha: str, path: str) -> Column:
    """The hash, or a key of its own for a row without one."""
    return F.coalesce(F.nullif(F.col(sha), F.lit("")), F.concat(F.lit("NO_SHA:"), F.col(path).cast("string")))


def union_manifests(parts: Sequence[DataFrame], missing: str = "?") -> DataFrame:
    """All rows by column name; missing provenance reads '?'."""
    u = reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), parts)
    return u.withColumns({c: F.coalesce(c, F.lit(missing)) for c, t in u.dtypes if t == "string"})


def dedup_keep_best(df: DataFrame, *, sha="sha256", path="path", split="split", order="seq") -> DataFrame:
    """One row for each content: of the least split priority, then the first. A least-struct aggregate, so copies are
    combined before the shuffle however many there are."""
    best = F.min_by(F.struct(*df.columns), F.struct(priority(F.col(split)), F.col(order)))
    return df.withColumn("_k", content_key(sha, path)).groupBy("_k").agg(best.alias("r")).select("r.*")


def drop_histogram(df: DataFrame, *, sha="sha256", path="path", split="split", order="seq") -> DataFrame:
    """How many rows dedup drops, by '<split> (dup of <best>)'."""
    k = df.select(content_key(sha, path).alias("_k"), split, order)
    per = k.groupBy("_k", split).agg(F.count("*").alias("n"))
    best = k.groupBy("_k").agg(F.min_by(split, F.struct(priority(F.col(split)), F.col(order))).alias("best"))
    lost = per.join(best, "_k").withColumn("n", F.col("n") - (F.col(split) == F.col("best")).cast("int"))
    return lost.where("n > 0").groupBy(F.concat(split, F.lit(" (dup of "), "best", F.lit(")")).alias("dropped")).agg(F.sum("n").alias("n"))


def duplicate_groups(df: DataFrame, *, sha="sha256", path="path", paths: int = 10) -> DataFrame:
    """Hashes that occur more than once, with their splits, labels and first paths. Sets have a value for each split or
    label at most; paths are counted off by rank before they are collected."""
    have = [c for c in ("split", "label") if c in df.columns]
    agg = df.where(F.col(sha).isNotNull() & (F.col(sha) != "")).groupBy(sha).agg(F.count("*").alias("n"), *[F.array_join(F.array_sort(F.collect_set(c)), ",").alias(f"{c}s") for c in have]).where("n > 1")
    first = df.withColumn("_r", F.row_number().over(Window.partitionBy(sha).orderBy(path))).where(F.col("_r") <= paths)
    listed = first.groupBy(sha).agg(F.array_join(F.transform(F.array_sort(F.collect_list(path)), lambda x: x.cast("string")), ",").alias("paths"))
    return agg.join(listed, sha)


def conflicting_labels(df: DataFrame, *, sha="sha256", label="label") -> DataFrame:
    """Hashes with more than one label."""
    g = df.where(F.col(sha) != "").groupBy(sha).agg(F.array_join(F.array_sort(F.collect_set(label)), ",").alias("labels"), F.countDistinct(label).alias("n_labels"), F.count("*").alias("n"))
    return g.where("n_labels > 1")


def leaks(df: DataFrame, *, sha="sha256", split="split") -> DataFrame:
    """Rows outside train whose content is in train."""
    train = df.where(F.col(split) == "train").select(sha).where(F.col(sha) != "").distinct()
    return df.where(F.col(split) != "train").join(train, sha, "left_semi")


def verify_counts(df: DataFrame) -> DataFrame:
    """Rows by split, label, split and label, corpus: one pass of grouping sets. kind, key, n."""
    g = df.groupingSets([["split"], ["label"], ["split", "label"], ["corpus"]], "split", "label", "corpus").agg(F.count("*").alias("n"), F.grouping_id().alias("gid"))
    kind = F.when(F.col("gid") == 3, "split").when(F.col("gid") == 5, "label").when(F.col("gid") == 1, "split/label").otherwise("corpus")
    key = F.when(F.col("gid") == 1, F.concat_ws("/", "split", "label")).otherwise(F.coalesce("split", "label", "corpus"))
    return g.select(kind.alias("kind"), key.alias("key"), "n")


def verify_checks(df: DataFrame, least: dict[str, int] | None = None, full: bool = False) -> DataFrame:
    """check, n, ok: invalid splits and labels, missing fields, duplicate contents, leaks, conflicts, class ratio."""
    bad = lambda c: F.count_if(c)
    have = set(df.columns)
    one = df.agg(
        F.count("*").alias("rows"),
        bad(~F.coalesce(F.col("split").isin(*SPLITS), F.lit(False))).alias("invalid_split"),
        bad(~F.coalesce(F.col("label").isin(*LABELS), F.lit(False))).alias("invalid_label"),
        bad(reduce(lambda a, b: a | b, [F.col(c).isNull() | (F.col(c).cast("string") == "") for c in REQUIRED if c in have])).alias("missing_value"),
        F.lit(len(set(REQUIRED) - have)).cast("long").alias("missing_column"),
        bad(F.col("label") == "real").alias("real"), bad(F.col("label") == "fake").alias("fake"),
        *[bad(F.col("corpus") == k).alias(f"corpus:{k}") for k in least or {}],
    )
    groups = df.where(F.col("sha256") != "").groupBy("sha256").agg(F.count("*").alias("n"), F.countDistinct("label").alias("l"), F.count_if(F.col("split") == "train").alias("t")).agg(
        F.count_if(F.col("n") > 1).alias("duplicate_groups"), F.count_if(F.col("l") > 1).alias("label_conflicts"), F.sum(F.when((F.col("t") > 0), F.col("n") - F.col("t")).otherwise(0)).alias("leaks"))
    r = one.crossJoin(groups)  # one row each
    ratio = F.greatest("real", "fake") > 2 * F.least("real", "fake")
    items = [("invalid_split", F.col("invalid_split"), None), ("invalid_label", F.col("invalid_label"), None), ("missing_value", F.col("missing_value"), None), ("missing_column", F.col("missing_column"), None), ("duplicate_groups", F.col("duplicate_groups"), None), ("label_conflicts", F.col("label_conflicts"), None), ("leaks", F.coalesce("leaks", F.lit(0)), None), ("class_ratio", ratio.cast("long"), None)]
    items += [(f"corpus:{k}", F.col(f"`corpus:{k}`"), F.col(f"`corpus:{k}`") >= v) for k, v in (least or {}).items()]
    rows = F.array(*[F.struct(F.lit(k).alias("check"), F.coalesce(v, F.lit(0)).cast("long").alias("n"), F.coalesce(F.lit(None).cast("boolean") if ok is None else ok, v == 0, F.lit(True)).alias("ok")) for k, v, ok in items])
    return r.select(F.inline(rows))


def upsert(index: DataFrame, entry: DataFrame, key: Sequence[str]) -> DataFrame:
    """The index with rows of the same key replaced."""
    return index.join(entry.select(*key).distinct(), list(key), "left_anti").unionByName(entry, allowMissingColumns=True)


def purge(df: DataFrame, source: str, keys: Sequence[str], suffix: str = "_holdout") -> DataFrame:
    """Rows of none of the sources, bare or quarantined."""
    return df.where(~F.coalesce(F.col(source).isin(*keys, *[k + suffix for k in keys]), F.lit(False)))


def with_content_state(df: DataFrame, cache: DataFrame, *, path="path") -> DataFrame:
    """Join a hash cache and say whether its hash holds: the same size and time, or the cache lacks them."""
    c = cache.select(F.col(path).alias("_p"), F.col("sha256").alias("cached"), F.col("size").alias("_s"), F.col("mtime").alias("_m"))
    j = df.join(c, F.col(path) == F.col("_p"), "left")
    fresh = F.col("cached").isNotNull() & (F.col("_s").isNull() | (F.col("_s") == F.col("size"))) & (F.col("_m").isNull() | (F.col("_m") == F.col("mtime")))
    return j.withColumns({"stale": ~F.coalesce(fresh, F.lit(False)), "sha256": F.when(F.coalesce(fresh, F.lit(False)), F.col("cached"))}).drop("_p", "_s", "_m", "cached")
