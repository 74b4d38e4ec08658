"""Held-out evaluation tiers from a manifest's own fields."""

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

FITTED = ("train", "val")
ORDER = ("T1_indist", "T2_xsource", "T3_xgen", "T4_wild")


def _flagged(m: DataFrame, source: str, generator: str) -> DataFrame:
    fitted = m.where(F.col("split").isin(*FITTED))
    sources = fitted.select(F.col(source).alias("_s")).distinct().withColumn("_fs", F.lit(True))
    gens = fitted.where("label = 'fake'").select(F.col(generator).alias("_g")).distinct().withColumn("_fg", F.lit(True))
    j = m.join(sources, F.col(source) == F.col("_s"), "left").join(gens, F.col(generator) == F.col("_g"), "left")
    return j.withColumns({"fitted_source": F.coalesce("_fs", F.lit(False)), "fitted_generator": F.coalesce("_fg", F.lit(False))}).drop("_s", "_g", "_fs", "_fg")


def build_tiers(m: DataFrame, wild: DataFrame | None = None, *, source="source_key", generator="generator") -> DataFrame:
    """The manifest's rows with `tier`; a negative is in several tiers.

    T1: the test split. T2: held-out fakes of a fitted generator from an unseen source. T3: held-out fakes of an unseen
    generator, wherever from. T2 and T3 share the held-out reals of unseen sources and exist only with both classes.
    """
    f = _flagged(m, source, generator)
    outside = ~F.col("split").isin(*FITTED, "test")
    fake, real = outside & (F.col("label") == "fake"), outside & (F.col("label") == "real") & ~F.col("fitted_source")
    tiers = F.array_compact(F.array(
        F.when(F.col("split") == "test", "T1_indist"),
        F.when(fake & F.col("fitted_generator") & ~F.col("fitted_source") | real, "T2_xsource"),
        F.when(fake & ~F.col("fitted_generator") | real, "T3_xgen")))
    rows = f.withColumn("tier", F.explode(tiers))
    whole = rows.groupBy("tier").agg(F.count_if(F.col("label") == "fake").alias("_f"), F.count_if(F.col("label") == "real").alias("_r")).where("tier = 'T1_indist' or _f > 0 and _r > 0")
    rows = rows.join(F.broadcast(whole.select("tier")), "tier")  # three rows
    return rows if wild is None else rows.unionByName(wild.withColumn("tier", F.lit("T4_wild")), allowMissingColumns=True)


def tier_leaks(m: DataFrame, *, source="source_key", generator="generator") -> DataFrame:
    """Held-out fakes that are new neither in source nor in generator: they are in no tier and are to be mended."""
    return _flagged(m, source, generator).where(~F.col("split").isin(*FITTED, "test") & (F.col("label") == "fake") & F.col("fitted_source") & F.col("fitted_generator"))


def tier_sources(tiers: DataFrame, *, source="source_key", generator="generator", most: int | None = None) -> DataFrame:
    """tier, negatives, fakes' generators, and sources of T3 fakes that training shares: sorted distinct names, the first `most` of them if it
    is given."""
    first = lambda names: names if most is None else F.slice(names, 1, most)
    lst = lambda c: F.array_join(first(F.array_sort(F.collect_set(c))), ", ")
    return tiers.groupBy("tier").agg(
        lst(F.when(F.col("label") == "real", F.col(source))).alias("negatives"),
        lst(F.when(F.col("label") == "fake", F.col(generator))).alias("generators"),
        lst(F.when((F.col("label") == "fake") & F.col("fitted_source"), F.col(source))).alias("shared"),
    )
