"""Manifest readers and writers. Schemas are explicit; bad lines go where they can be seen or dropped on request."""

import re
from collections.abc import Callable, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType

from ..functions.binary import image_header
from ..operators.manifest import conflicting_labels, leaks
from ..operators.sampling import stride_sample
from ..schemas import CORPUS_CSV, MANIFEST, SCORES, SPLITS
from ..session import written

#: Readers by name; a source is a function (spark, path) -> DataFrame.
READERS: dict[str, Callable[[SparkSession, str], DataFrame]] = {}


def reader(name: str):
    def add(f):
        READERS[name] = f
        return f

    return add


@reader("jsonl")
def read_jsonl(spark: SparkSession, path: str, schema: StructType = MANIFEST, tolerant: bool = True) -> DataFrame:
    """A JSONL manifest; malformed lines are dropped, or kept in _corrupt_record."""
    if tolerant:
        return spark.read.schema(schema).option("mode", "DROPMALFORMED").json(path)
    return spark.read.schema(StructType([*schema, StructField("_corrupt_record", StringType())])).json(path)


@reader("csv")
def read_csv(spark: SparkSession, path: str, schema: StructType = CORPUS_CSV) -> DataFrame:
    """A CSV manifest with a header; the split is the path's first part, rows of no known split go."""
    d = spark.read.schema(schema).option("header", True).csv(path)
    return d.withColumn("split", F.split("path", "/")[0]).where(F.col("split").isin(*SPLITS))


@reader("scores")
def read_scores(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(SCORES).json(path)


@reader("tree")
def read_tree(spark: SparkSession, path: str, suffixes: Sequence[str] = ("png", "jpg", "jpeg", "webp"), recursive: bool = False, content: bool = False) -> DataFrame:
    """Files of <root>/real and <root>/fake in order of their paths, with label, name, size and time; contents only on request."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", recursive).load(path if recursive else f"{path}/*")
    ok = F.lower(F.regexp_extract("path", r"\.([A-Za-z0-9]+)$", 1)).isin(*suffixes)
    out = files.withColumn("label", F.regexp_extract("path", r"/(real|fake)/", 1)).where(ok & (F.col("label") != "")).withColumn("name", F.element_at(F.split("path", "/"), -1))
    return (out if content else out.drop("content")).orderBy("path")


def scanned(spark: SparkSession, roots: Sequence[str], suffixes: Sequence[str] = ("png", "jpg", "jpeg", "webp"), per_class: int = 0) -> DataFrame:
    """Files of several trees, with root, label, name, length and what their headers say (format, width, height, null where
    they can't be read); with per_class only so many of each root and class, spread evenly over their names."""
    trees = [read_tree(spark, r, suffixes, recursive=True).withColumn("root", F.lit(r)) for r in roots]
    files = either(*trees)
    if per_class:
        files = stride_sample(files, ["root", "label"], ["path"], per_class)
    content = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(list(roots)).select("path", image_header(F.col("content")).alias("h"))
    return files.join(content, "path", "left").select("root", "label", "path", "name", "length", "h.format", "h.width", "h.height")


def tree_counts(files: DataFrame) -> DataFrame:
    """root, label, n and bytes of scanned files."""
    return files.groupBy("root", "label").agg(F.count("*").alias("n"), F.sum("length").alias("bytes"))


@reader("images")
def read_nested_images(spark: SparkSession, path: str) -> DataFrame:
    """bytes and format of parquet shards with nested images: only those columns are read."""
    return spark.read.parquet(path).select(F.col("image.bytes").alias("content"), "format")


def standard(df: DataFrame, corpus: str, group: str = "source_key") -> DataFrame:
    """Defaults of a manifest: source_key '<corpus>/unknown', generator '?', and `group` from the chosen column."""
    d = df.withColumns({"source_key": F.coalesce("source_key", F.lit(f"{corpus}/unknown")), "generator": F.coalesce("generator", F.lit("?")), "corpus": F.lit(corpus)})
    return d.withColumn("group", F.col(group))


def evidence(df: DataFrame, listing: DataFrame, limit: int) -> DataFrame:
    """Confirmed and downloaded rows that are listed, surest first, then by id."""
    rank = F.when(F.col("confidence") == "high", 0).when(F.col("confidence") == "medium", 1).when(F.col("confidence") == "low", 2).otherwise(3)
    ok = df.where((F.col("classification") == "confirmed") & (F.col("download_success") == "True"))
    return ok.join(listing.select("name").distinct(), "name", "left_semi").orderBy(rank, "id").limit(limit)


def last_score(df: DataFrame, keys: Sequence[str], order: str) -> DataFrame:
    """Of repeated scores the last."""
    return df.groupBy(*keys).agg(F.max_by("p_fake", order).alias("p_fake"))


def append_jsonl(df: DataFrame, path: str) -> None:
    df.write.mode("append").json(path)


def write_split(df: DataFrame, path: str, by: Sequence[str] = ("split", "label")) -> None:
    """Files by split and label, so later scans read only their parts."""
    df.write.mode("overwrite").partitionBy(*by).parquet(path)


def write_sorted(df: DataFrame, path: str, order: Sequence[str] = ("split", "label", "path")) -> None:
    """A manifest in order over several files: their names follow the order."""
    df.orderBy(*order).write.mode("overwrite").json(path)


def manifest_rows(spark: SparkSession, path: str, corpus: str, listing: DataFrame | None = None, split: str | None = None, group: str = "source_key") -> DataFrame:
    """A corpus' JSONL manifest with its defaults: rows of one split if named, of files that the listing (path) has."""
    rows = standard(read_jsonl(spark, path), corpus, group).where("path is not null")
    rows = rows.where(F.col("split") == split) if split else rows
    return rows.join(listing.select("path").distinct(), "path", "left_semi") if listing is not None else rows


def listed(listing: DataFrame, pattern: str, limit: int = 0) -> DataFrame:
    """Names that match a pattern, in order, the first `limit` of them if that is not 0; an error if none does."""
    rows = listing.where(F.col("name").rlike(pattern)).orderBy("name")
    if rows.isEmpty():
        raise ValueError(f"nothing matches {pattern}")
    return rows.limit(limit) if limit else rows


def either(*sources: DataFrame) -> DataFrame:
    """All rows of some sources, of which some may be empty; an error if all are."""
    out = sources[0]
    for s in sources[1:]:
        out = out.unionByName(s)
    if out.isEmpty():
        raise ValueError("no source has a row")
    return out


def split_or_all(tree: DataFrame, split: str) -> DataFrame:
    """Rows of a tree whose path has the split as a folder, or the whole tree if none has."""
    of_split = tree.where(F.col("path").rlike(f"/{split}/"))
    return tree if of_split.isEmpty() else of_split


def folder_size(files: DataFrame, ignore: Sequence[str]) -> DataFrame:
    """files, bytes and ignored of a listing (name, length): one row. Patterns are globs over names."""
    glob = lambda g: "^" + "".join({"*": ".*", "?": "."}.get(c, re.escape(c)) for c in g) + "$"
    off = F.coalesce(F.col("name").rlike("|".join(map(glob, ignore))), F.lit(False)) if ignore else F.lit(False)
    return files.agg(F.count_if(~off).alias("files"), F.coalesce(F.sum(F.when(~off, F.col("length"))), F.lit(0)).alias("bytes"), F.count_if(off).alias("ignored"))


def read_metrics(spark: SparkSession, path: str) -> DataFrame:
    """Metrics files of one JSON value each."""
    return spark.read.option("multiLine", True).json(path)


def write_guarded(df: DataFrame, path: str, order: Sequence[str] = ("split", "label", "path")) -> None:
    """write_sorted, refused while content has two labels or stands in train and elsewhere."""
    df = written(df)  # what is checked is what is written
    conflicts, leaked = conflicting_labels(df).count(), leaks(df).count()
    if conflicts or leaked:
        raise ValueError(f"{conflicts} contents with conflicting labels, {leaked} rows leaked from train")
    write_sorted(df, path, order)


def write_report(df: DataFrame, path: str, without: Sequence[str] = ("preview",)) -> None:
    """A table as CSV with a header, without columns that are only for show."""
    df.drop(*without).write.mode("overwrite").option("header", True).csv(path)


def stamped(df: DataFrame, stamp: str) -> DataFrame:
    """Rows without an encoding stamp get it, and keep the hash that they had as source_sha256, the first one for ever."""
    bare = F.coalesce(F.col("encoding"), F.lit("")) == ""
    return df.withColumns({"source_sha256": F.coalesce("source_sha256", F.when(bare, F.col("sha256"))), "encoding": F.when(bare, stamp).otherwise(F.col("encoding"))})
