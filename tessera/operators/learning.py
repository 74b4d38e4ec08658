"""Heads on embeddings with pyspark.ml: logistic heads by view, calibration, ensembles, fusion, cross-validation."""

from __future__ import annotations

import json
from collections.abc import Iterator, Sequence
from dataclasses import asdict, dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.ml import Estimator, Model, Pipeline, Transformer
from pyspark.ml.classification import DecisionTreeClassifier, LinearSVC, LogisticRegression, NaiveBayes, RandomForestClassifier
from pyspark.ml.feature import PCA, StandardScaler, VectorAssembler
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..session import written
from .metrics import ratio, roc_auc, threshold_at_fpr
from .nearest import nearest
from .sampling import placed

GRID = (0.01, 0.1, 1.0, 10.0, 100.0)


def with_weights(df: DataFrame, y="y") -> DataFrame:
    """Add w = N / (2 n_class)."""
    n = df.groupBy(y).agg(F.count("*").alias("_n"))
    total = n.agg(F.sum("_n").alias("_t"))
    return df.join(F.broadcast(n.crossJoin(total)), y).withColumn("w", F.col("_t") / (2 * F.col("_n"))).drop("_n", "_t")  # two rows


def fit_logistic(train: DataFrame, c: float, features="features", y="y"):
    """A logistic curve with balanced weights; the penalty is that of an inverse strength c on the sum of losses."""
    t = with_weights(train, y)
    total = t.agg(F.sum("w")).first()[0]
    return LogisticRegression(featuresCol=features, labelCol=y, weightCol="w", regParam=1 / (c * total), standardization=False, maxIter=50).fit(t)


def margins(model, df: DataFrame, out="margin") -> DataFrame:
    """The linear margin as a column of built-ins over the features."""
    w = F.array(*[F.lit(float(x)) for x in model.coefficients])
    dot = F.aggregate(F.zip_with(vector_to_array("features"), w, lambda a, b: a * b), F.lit(float(model.intercept)), lambda s, z: s + z)
    return df.withColumn(out, dot)


def fit_head(train: DataFrame, val: DataFrame, grid: Sequence[float] = GRID):
    """c, model and calibrator (a, b): the first c of best balanced accuracy on val, then a logistic curve on its margins there."""
    best, train, val = None, written(train), written(val)
    for c in grid:  # a handful of values; each fit and score is a Spark job
        m = fit_logistic(train, c)
        s = margins(m, val)
        hit = F.col("margin") >= 0
        acc = s.agg((F.avg(F.when(F.col("y") == 1, hit.cast("double"))) + F.avg(F.when(F.col("y") == 0, (~hit).cast("double")))) / 2).first()[0] or 0.0
        if best is None or acc > best[0] + 1e-12:
            best = (acc, c, m)
    v = margins(best[2], val).select("y", array_to_vector(F.array("margin")).alias("features"))
    n = v.count()
    cal = LogisticRegression(labelCol="y", regParam=1.0 / n, standardization=False).fit(v)
    return best[1], best[2], (float(cal.coefficients[0]), float(cal.intercept))


def calibrated(model, platt: tuple[float, float], df: DataFrame, out="p") -> DataFrame:
    return margins(model, df).withColumn(out, 1 / (1 + F.exp(-(F.col("margin") * platt[0] + platt[1])))).drop("margin")


def views(df: DataFrame, embedding="embedding", n: int = 4) -> list[DataFrame]:
    """n slices of an embedding as feature tables."""
    size = F.floor(F.size(embedding) / n).cast("int")
    return [df.withColumn("features", array_to_vector(F.transform(F.slice(embedding, size * i + 1, size), lambda x: x.cast("double")))) for i in range(n)]


def ensemble(df: DataFrame, key: str, exclude: Sequence[str] = ()) -> DataFrame:
    """Mean of the calibrated p of the views (key, view, p) that are left; an error if none is."""
    left = df.where(~F.col("view").isin(*exclude)) if exclude else df
    if exclude and left.isEmpty():
        raise ValueError("no view left")
    return left.groupBy(key).agg(F.avg("p").alias("p"))


def fuse(train: DataFrame, df: DataFrame, key: str, names: Sequence[str], c: float = 0.01) -> DataFrame:
    """A logistic curve on the views' p, fitted on the adaptation rows only."""
    wide = lambda x: VectorAssembler(inputCols=list(names), outputCol="features").transform(x.groupBy(key, "y").pivot("view", list(names)).agg(F.first("p")))
    m = fit_logistic(wide(train), c)
    return margins(m, wide(df)).withColumn("p", 1 / (1 + F.exp(-F.col("margin")))).select(key, "y", "p")


class RandomFourier(Transformer):
    """Cosines of random projections: inner products of its outputs approach the kernel exp(-gamma |x - y|^2), so a linear
    machine after it is a kernel machine. gamma: that of 1 over the number of features, without one, as for scaled ones."""

    def __init__(self, inputCol: str, outputCol: str, size: int = 512, gamma: float | None = None, seed: int = 42):
        super().__init__()
        self.inputCol, self.outputCol, self.size, self.gamma, self.seed = inputCol, outputCol, size, gamma, seed

    def _transform(self, dataset: DataFrame) -> DataFrame:
        size, gamma, seed = self.size, self.gamma, self.seed

        def run(it: Iterator[pa.Array]) -> Iterator[pa.Array]:
            w = None
            for a in it:
                if not len(a):
                    yield pa.array([], pa.list_(pa.float64()))
                    continue
                x = a.flatten().to_numpy(zero_copy_only=False).reshape(len(a), -1)
                if w is None:
                    rng = np.random.default_rng([seed, x.shape[1]])
                    w, shift = rng.normal(size=(x.shape[1], size)) * np.sqrt(2 * (gamma or 1 / x.shape[1])), rng.uniform(0, 2 * np.pi, size)
                z = np.sqrt(2 / size) * np.cos(x @ w + shift)
                yield pa.ListArray.from_arrays(np.arange(0, z.size + 1, size, dtype=np.int32), z.ravel())

        return dataset.withColumn(self.outputCol, array_to_vector(F.arrow_udf(run, "array<double>")(vector_to_array(self.inputCol))))


class NearestClassifier(Estimator):
    """The k nearest training rows by Euclidean distance vote; of equal distances the rows of smaller key count first."""

    def __init__(self, featuresCol: str, labelCol: str, key: str, k: int = 7, block: int = 8192):
        super().__init__()
        self.featuresCol, self.labelCol, self.key, self.k, self.block = featuresCol, labelCol, key, k, block

    def _fit(self, dataset: DataFrame) -> NearestModel:
        return NearestModel(self, written(dataset.select(F.col(self.key).alias("key"), F.col(self.labelCol).cast("double").alias("y"), vector_to_array(self.featuresCol).alias("x"))))


class NearestModel(Model):
    """Rows to classify are met in blocks of about `block`, each sent to all tasks of the training rows (see nearest)."""

    def __init__(self, of: NearestClassifier, train: DataFrame):
        super().__init__()
        self.of, self.train = of, train

    def _transform(self, dataset: DataFrame) -> DataFrame:
        if self.train.isEmpty():
            raise ValueError("no training rows")
        rows = written(dataset.withColumn("_row", F.monotonically_increasing_id()))
        asked = rows.select(F.col("_row").alias("key"), vector_to_array(self.of.featuresCol).alias("x"))
        votes = nearest(asked, self.train, self.of.k, block=self.of.block).groupBy(F.col("q").alias("_row")).agg(F.avg("y").alias("_p"))
        raw = array_to_vector(F.array(1 - F.col("_p"), F.col("_p")))
        return rows.join(votes, "_row").withColumns({"rawPrediction": raw, "prediction": (F.col("_p") > 0.5).cast("double")}).drop("_row", "_p")


def model_zoo(dims: int = 16, key: str = "vec_id") -> dict[str, Pipeline]:
    """Classifiers on scaled features, some after their principal components; `key` names a row for the nearest ones."""
    scaled = lambda *est: Pipeline(stages=[StandardScaler(inputCol="features", outputCol="scaled", withMean=True), *est])
    reduced = lambda *est: Pipeline(stages=[StandardScaler(inputCol="features", outputCol="z", withMean=True), PCA(k=dims, inputCol="z", outputCol="scaled"), *est])
    common = {"featuresCol": "scaled", "labelCol": "y"}
    return {
        "logistic": scaled(LogisticRegression(maxIter=100, **common)),
        "tree": scaled(DecisionTreeClassifier(maxDepth=8, seed=42, **common)),
        "forest": reduced(RandomForestClassifier(numTrees=50, maxDepth=8, seed=42, **common)),
        "linear_svm": reduced(LinearSVC(maxIter=50, **common)),
        "rbf_svm": reduced(RandomFourier("scaled", "waves", size=256), LinearSVC(maxIter=50, regParam=1e-4, featuresCol="waves", labelCol="y")),
        "nearest": reduced(NearestClassifier(key=key, **common)),
        "gaussian_nb": reduced(NaiveBayes(modelType="gaussian", **common)),
    }


def linear_p(x: Column, weights: Sequence[float], bias: float, a: float = 1.0, b: float = 0.0) -> Column:
    """The logistic of a * (weights . x + bias) + b, of an array x."""
    dot = F.aggregate(F.zip_with(x, F.array(*[F.lit(float(w)) for w in weights]), lambda u, v: u * v), F.lit(float(bias)), lambda s, z: s + z)
    return 1 / (1 + F.exp(-(F.lit(float(a)) * dot + F.lit(float(b)))))


@dataclass
class Bundle:
    """Calibrated heads of views in their order, a fusion of them if there is one, and thresholds. Each view is a column of
    arrays of its name. heads: by view, c, weights, bias, a, b; fusion: weights, bias, views."""

    views: list[str]
    heads: dict[str, dict]
    fusion: dict | None = None
    thresholds: dict[str, float | None] = field(default_factory=dict)

    def view_scores(self, df: DataFrame) -> DataFrame:
        """Add p_<view> of each view."""
        return df.withColumns({f"p_{v}": linear_p(F.col(v), **{k: self.heads[v][k] for k in ("weights", "bias", "a", "b")}) for v in self.views})

    def serve(self, df: DataFrame, views: Sequence[str] | None = None, out: str = "p_fake") -> DataFrame:
        """Add p_<view> and the score: by the fusion, which wants its views in its order, else the mean of the views."""
        views = list(views or self.views)
        if unknown := [v for v in views if v not in self.heads]:
            raise ValueError(f"no heads for {unknown}")
        if self.fusion and views != self.fusion["views"]:
            raise ValueError(f"the fusion asks for the views {self.fusion['views']}, not {views}")
        some = Bundle(views, self.heads).view_scores(df)
        ps = F.array(*[F.col(f"p_{v}") for v in views])
        mean = F.aggregate(ps, F.lit(0.0), lambda s, x: s + x) / len(views)
        return some.withColumn(out, linear_p(ps, self.fusion["weights"], self.fusion["bias"]) if self.fusion else mean)

    def save(self, spark: SparkSession, path: str) -> None:
        spark.createDataFrame([(json.dumps(asdict(self)),)], "value string").coalesce(1).write.mode("overwrite").text(path)

    @staticmethod
    def load(spark: SparkSession, path: str) -> Bundle:
        return Bundle(**json.loads(spark.read.text(path, wholetext=True).first().value))


def fit_bundle(train: DataFrame, val: DataFrame, views: Sequence[str], *, adaptation: DataFrame | None = None, c: float = 0.01, percent: int = 5, grid: Sequence[float] = GRID) -> Bundle:
    """Heads of the views (columns of arrays, with y), each with the strength and calibration that val chooses. With
    adaptation rows, the heads learn from them too, and a fusion of the views' scores learns from them alone. Thresholds:
    of each view, of the mean and of the served score, at the target false positive rate on val."""
    of = lambda df, v: df.select("y", array_to_vector(v).alias("features"))
    both = train.select("y", *views)
    both = both.unionByName(adaptation.select("y", *views)) if adaptation is not None else both
    heads = {}
    for v in views:  # a handful
        strength, model, (a, b) = fit_head(of(both, v), of(val, v), grid)
        heads[v] = {"c": strength, "weights": [float(x) for x in model.coefficients], "bias": float(model.intercept), "a": a, "b": b}
    bundle = Bundle(list(views), heads)
    wide = lambda df: bundle.view_scores(df).select("y", F.array(*[f"p_{v}" for v in views]).alias("ps"))
    if adaptation is not None:
        m = fit_logistic(wide(adaptation).select("y", array_to_vector("ps").alias("features")), c)
        bundle.fusion = {"weights": [float(x) for x in m.coefficients], "bias": float(m.intercept), "views": list(views)}
    served = written(bundle.serve(val))
    mean = F.aggregate(F.array(*[f"p_{v}" for v in views]), F.lit(0.0), lambda s, x: s + x) / len(views)
    for name, p in {**{v: F.col(f"p_{v}") for v in views}, "mean": mean, "served": F.col("p_fake")}.items():
        bundle.thresholds[name] = threshold_at_fpr(served.select("y", p.alias("p")), percent=percent).first().threshold
    return bundle


def shortcut_probe(df: DataFrame, key: str, names: Sequence[str], y: str = "y", top: int = 5) -> DataFrame:
    """How well low-level statistics alone tell the classes: a logistic curve on scaled columns, fitted on one half of
    each class in hash order and scored on the other. One row: n, balanced accuracy, auc, and the `top` weights of the
    largest size as an array of (name, weight). Rows with a null statistic are left out."""
    kept = written(df.select(key, F.col(y).alias("y"), *names).dropna(subset=["y", *names]))
    halves = written(VectorAssembler(inputCols=list(names), outputCol="raw").transform(folds(kept, key, k=2)))
    train, test = halves.where("fold = 0"), halves.where("fold = 1")
    n = train.count()
    scaler = StandardScaler(inputCol="raw", outputCol="features", withMean=True).fit(train)
    model = LogisticRegression(labelCol="y", regParam=1 / max(n, 1), standardization=False, maxIter=200).fit(scaler.transform(train))
    s = written(model.transform(scaler.transform(test)).select("y", vector_to_array("probability")[1].alias("p")))
    hit = F.col("p") >= 0.5
    balanced = (F.avg(F.when(F.col("y") == 1, hit.cast("double"))) + F.avg(F.when(F.col("y") == 0, (~hit).cast("double")))) / 2
    weights = sorted(((c, float(w)) for c, w in zip(names, model.coefficients, strict=True)), key=lambda cw: -abs(cw[1]))[:top]
    told = F.array(*[F.struct(F.lit(c).alias("name"), F.round(F.lit(w), 3).alias("weight")) for c, w in weights])
    r = s.agg(balanced.alias("b")).first()  # one number
    return roc_auc(s).select(F.lit(kept.count()).alias("n"), F.round(F.lit(r.b), 4).alias("balanced_accuracy"), F.round("auc", 4).alias("auc"), told.alias("top"))


def folds(df: DataFrame, key: str, y: str = "y", k: int = 5) -> DataFrame:
    """Add `fold`, stratified by class in hash order."""
    h = F.md5(F.col(key).cast("string").cast("binary"))
    p = placed(df.select(key, y).withColumn("_h", h), ["_h", key], [y], bucket=F.substring("_h", 1, 3))
    return df.join(p.select(key, (F.col("place") % k).alias("fold")), key)


def cross_validate(df: DataFrame, pipelines: dict[str, Pipeline], key: str, k: int = 5) -> DataFrame:
    """model, and the mean and deviation over the folds of accuracy, f1 and auc, all in percent."""
    f = written(folds(df, key, k=k))
    out = None
    for name, pipe in pipelines.items():
        for i in range(k):  # models times folds, each a Spark job
            s = pipe.fit(f.where(F.col("fold") != i)).transform(f.where(F.col("fold") == i))
            raw = vector_to_array("rawPrediction")
            part = s.select(F.lit(name).alias("model"), F.lit(i).alias("fold"), "y", F.col("prediction").alias("hit"), (raw[1] - raw[0]).alias("p"))
            out = part if out is None else out.union(part)
    return fold_metrics(out)


def fold_metrics(scored: DataFrame) -> DataFrame:
    """From model, fold, y, hit (the prediction) and p (any score): the metrics of each fold, and their mean and deviation."""
    hit, y = F.col("hit") == 1, F.col("y") == 1
    tp, fp, fn = F.count_if(hit & y), F.count_if(hit & ~y), F.count_if(~hit & y)
    by = scored.groupBy("model", "fold").agg(F.avg((hit == y).cast("double")).alias("accuracy"), F.coalesce(ratio(2 * tp, 2 * tp + fp + fn), F.lit(0.0)).alias("f1"))
    each = by.join(roc_auc(scored, ["model", "fold"]).select("model", "fold", "auc"), ["model", "fold"])
    return each.groupBy("model").agg(*[x for c in ("accuracy", "f1", "auc") for x in (F.round(100 * F.avg(c), 6).alias(c), F.round(100 * F.stddev_pop(c), 6).alias(f"{c}_deviation"))])


def nearest_neighbours(queries: DataFrame, base: DataFrame, key: str, k: int = 5) -> DataFrame:
    """key and the mean label of the k nearest others (squared distance): a stated query set, in blocks, against all rows."""
    of = lambda df, *more: df.select(F.col(key).alias("key"), F.col("embedding").alias("x"), *more)
    return nearest(of(queries), of(base, "y"), k, other=True).groupBy(F.col("q").alias(key)).agg(F.avg("y").alias("p"))
