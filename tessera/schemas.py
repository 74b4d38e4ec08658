"""Explicit schemas of manifests and scores: nothing is inferred, an all-null column keeps its type."""

from pyspark.sql import types as T

MANIFEST = T.StructType([T.StructField(n, T.StringType()) for n in ("path", "split", "label", "source_key", "generator", "architecture", "sha256", "corpus", "rendition", "license")] + [T.StructField(n, T.IntegerType()) for n in ("width", "height", "short_edge", "long_edge")] + [T.StructField("aspect", T.DoubleType()), T.StructField("extras", T.MapType(T.StringType(), T.StringType()))])
CORPUS_CSV = T.StructType([T.StructField(n, T.StringType()) for n in ("path", "label", "architecture", "source", "sha256")] + [T.StructField(n, T.IntegerType()) for n in ("width", "height")])
SCORES = T.StructType([T.StructField(n, T.StringType()) for n in ("tier", "path", "label", "group", "generator")] + [T.StructField("p_fake", T.DoubleType())])
SPLITS = ("train", "val", "test", "holdout")
LABELS = ("real", "fake")
REQUIRED = ("path", "split", "label", "source", "generator", "sha256", "corpus")
