"""The joins of corpus building: semi, anti, prefix guards, lookups, small crosses."""

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def present(df: DataFrame, listing: DataFrame, on: str) -> DataFrame:
    """Rows whose name is listed."""
    return df.join(listing.select(on).distinct(), on, "left_semi")


def unseen(df: DataFrame, stored: DataFrame, *, key="sha256", order="seq") -> DataFrame:
    """Rows of content not stored yet, the first of each content. The first is found by a least-struct aggregate, which
    combines copies before the shuffle."""
    first = df.groupBy(key).agg(F.min_by(F.struct(*[c for c in df.columns if c != key]), order).alias("_r"))
    return first.join(stored.select(key).distinct(), key, "left_anti").select(key, "_r.*").select(*df.columns)


def prefix_guard(df: DataFrame, guard: DataFrame, *, key="sha256", prefix="prefix", n: int = 16) -> DataFrame:
    """Rows whose first n hex digits no guard has: an equality join on the prefix."""
    g = guard.select(F.substring(prefix, 1, n).alias("_g")).distinct()
    return df.join(g, F.substring(key, 1, n) == F.col("_g"), "left_anti")


def lookup(df: DataFrame, cache: DataFrame, on: Sequence[str]) -> DataFrame:
    """Rows with a cached value; those without go (count them with lookup_misses)."""
    return df.join(cache, list(on))


def lookup_misses(df: DataFrame, cache: DataFrame, on: Sequence[str]) -> DataFrame:
    return df.join(cache.select(*on).distinct(), list(on), "left_anti").agg(F.count("*").alias("dropped"))


def with_variants(df: DataFrame, name: str, variants: Sequence[str]) -> DataFrame:
    """Each row once for each variant: an explode, no join."""
    return df.withColumn(name, F.explode(F.array(*[F.lit(v) for v in variants])))


def with_seen(*frames: tuple[DataFrame, str]) -> DataFrame:
    """Distinct values of several columns of several tables, as `seen`."""
    out = None
    for df, c in frames:
        part = df.select(F.col(c).alias("seen")).where("seen is not null")
        out = part if out is None else out.union(part)
    return out.distinct()


def aliases(df: DataFrame, *, fingerprint: str, name: str) -> DataFrame:
    """fingerprint, name, n_same, first: for each name how many share its fingerprint and the first of them. All names of
    a fingerprint are its rows, whatever their number; no list is gathered."""
    n = df.groupBy(F.col(fingerprint).alias("_f")).agg(F.count("*").alias("n_same"), F.min(name).alias("first"))
    return df.select(fingerprint, name).join(n, F.col(fingerprint).eqNullSafe(F.col("_f"))).drop("_f")
