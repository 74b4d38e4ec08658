"""Scorers by name, applied in Arrow batches, and scores joined to rows by key.

A scorer is a factory of functions from a matrix (a row for each input) to scores; a Python worker makes its function
once. A row that can't be read, because its vector is null, of another length or holds a null, NaN or infinite component,
has the score null, and so has one whose score is no number. Nothing is matched by order: scores carry the key.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

Predict = Callable[[np.ndarray], np.ndarray]
SCORERS: dict[str, Callable[..., Predict]] = {}


def scorer(name: str):
    """Register a factory under a name; its keyword arguments are the scorer's parameters."""

    def add(f: Callable[..., Predict]):
        SCORERS[name] = f
        return f

    return add


def logistic(margin: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(margin, -700, 700)))


@scorer("linear")
def linear(weights: Sequence[float], bias: float = 0.0, scale: float = 1.0) -> Predict:
    """The logistic of scale * (weights . x + bias)."""
    w = np.array(weights, dtype=np.float64)
    return lambda x: logistic(scale * (x @ w + bias))


@scorer("centroids")
def centroids(real: Sequence[float], fake: Sequence[float], scale: float = 1.0) -> Predict:
    """The logistic of how much nearer a row is to the second centroid, by squared distance."""
    r, f = np.array(real, dtype=np.float64), np.array(fake, dtype=np.float64)
    return lambda x: logistic(scale * (((x - r) ** 2).sum(1) - ((x - f) ** 2).sum(1)))


@scorer("views")
def over_views(base: str, views: Sequence[tuple[int, int]], params: Sequence[dict]) -> Predict:
    """The mean of a scorer over slices [from, to) of the vector, each with its own parameters."""
    parts = [(a, b, SCORERS[base](**p)) for (a, b), p in zip(views, params, strict=True)]
    return lambda x: np.mean([f(x[:, a:b]) for a, b, f in parts], axis=0)


def readable(column: pa.Array, size: int) -> tuple[np.ndarray, np.ndarray]:
    """The places of the rows that can be read, and their matrix."""
    lengths = column.value_lengths().fill_null(-1).to_numpy()
    at = np.flatnonzero(lengths == size)
    x = column.take(pa.array(at)).flatten().cast(pa.float64()).to_numpy(zero_copy_only=False).reshape(len(at), size)
    good = np.isfinite(x).all(1)
    return at[good], x[good]


def p_of(name: str, vector: Column | str, size: int, **params) -> Column:
    """The score of a vector of `size` components by the scorer of a name."""
    if name not in SCORERS:
        raise ValueError(f"no scorer {name}; there are {', '.join(sorted(SCORERS))}")
    make = SCORERS[name]

    def run(it: Iterator[pa.Array]) -> Iterator[pa.Array]:
        predict = make(**params)
        for a in it:
            at, x = readable(a, size)
            out = np.full(len(a), np.nan)
            if len(at):
                out[at] = predict(x)
            yield pa.array(out, pa.float64(), mask=~np.isfinite(out))

    return F.arrow_udf(run, "double")(vector)


def score(rows: DataFrame, name: str, *, key: str, vector: str, size: int, out: str = "p_fake", **params) -> DataFrame:
    """key and score of each row, null where the row can't be read."""
    return rows.select(key, p_of(name, vector, size, **params).alias(out))


def with_scores(rows: DataFrame, scores: DataFrame, key: str, *, p: str = "p_fake", order: str | None = None) -> DataFrame:
    """All rows with their score, null without one. Of several scores of a key the last by `order` counts, or else the
    largest; a key that several rows share gives each of them its score."""
    last = scores.groupBy(F.col(key).alias("_k")).agg((F.max_by(p, order) if order else F.max(p)).alias("_p"))
    return rows.drop(p).join(last, F.col(key) == F.col("_k"), "left").withColumnRenamed("_p", p).drop("_k")


def unscored(rows: DataFrame, by: str, p: str = "p_fake") -> DataFrame:
    """by, n and how many rows have no score, which later steps leave out."""
    return rows.groupBy(by).agg(F.count("*").alias("n"), F.count_if(F.col(p).isNull()).alias("unscored"))


def cached_scores(rows: DataFrame, cache: str, tag: str, name: str, *, key: str, vector: str, size: int, **params) -> DataFrame:
    """Scores of the rows from the cache of a tag, a folder of JSON lines; rows that it lacks are scored and appended, with
    6 decimals. Unreadable rows are not written, so they are tried again. Returns key and p_fake of these rows."""
    spark = rows.sparkSession
    kind = rows.select(key).withColumn("p_fake", F.lit(0.0)).schema
    folder = f"{cache}/tag={tag}"
    spark.createDataFrame([], kind).write.mode("append").json(folder)  # there from the first time on
    have = spark.read.schema(kind).json(folder).where(F.col("p_fake").isNotNull())
    missing = rows.join(have.select(key).distinct(), key, "left_anti")
    new = score(missing, name, key=key, vector=vector, size=size, **params).where("p_fake is not null")
    new.select(key, F.round("p_fake", 6).alias("p_fake")).write.mode("append").json(folder)
    return with_scores(rows.select(key), spark.read.schema(kind).json(folder), key)
