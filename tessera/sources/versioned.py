"""Manifests that are rewritten in place, and a cache of feature vectors; both as folders of Parquet.

A manifest's rows lie in parts by some columns. A change reads and writes only the parts that hold rows it concerns, to
new folders; then a pointer, a small file with the number of the version, names the folder of every part. Pointers are
only ever added, and a name can be taken once, so of two writers that began with one version the later one fails. A
reader that has a version keeps seeing its files; a write that is lost halfway leaves folders that no pointer names,
which `vacuum` deletes.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from .manifests import stamped

END = "complete"


class Files:
    """What this module asks of Hadoop's file systems."""

    def __init__(self, spark: SparkSession, path: str):
        self.jvm = spark._jvm
        self.fs = self.path(path).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())

    def path(self, name: str):
        return self.jvm.org.apache.hadoop.fs.Path(name)

    def names(self, folder: str) -> list[str]:
        return sorted(s.getPath().getName() for s in self.fs.listStatus(self.path(folder))) if self.exists(folder) else []

    def exists(self, name: str) -> bool:
        return self.fs.exists(self.path(name))

    def create(self, name: str, text: str) -> None:
        """A new file; an error if there is one of this name."""
        out = self.fs.create(self.path(name), False)
        out.write(bytearray(text.encode()))
        out.close()

    def text(self, name: str) -> str:
        stream = self.fs.open(self.path(name))
        try:
            return bytes(self.jvm.org.apache.commons.io.IOUtils.toByteArray(stream)).decode()
        finally:
            stream.close()

    def delete(self, name: str) -> None:
        self.fs.delete(self.path(name), True)


class Versioned:
    """A manifest in parts by the columns `by`, of which there are few values."""

    def __init__(self, spark: SparkSession, path: str, by: Sequence[str] = ("split", "label")):
        self.spark, self.root, self.by, self.files = spark, path.rstrip("/"), list(by), Files(spark, path)

    def pointers(self) -> list[int]:
        """Versions whose pointers were written to their end."""
        return [int(n.split(".")[0]) for n in self.files.names(f"{self.root}/versions") if n.endswith(".json") and self.pointer(int(n.split(".")[0]))]

    def pointer(self, version: int) -> dict | None:
        body, _, end = self.files.text(f"{self.root}/versions/{version:08}.json").rpartition("\n")
        return json.loads(body) if end == END else None

    def latest(self) -> int:
        return max(self.pointers(), default=0)

    def swap(self, version: int, schema: StructType, parts: dict[str, str]) -> int:
        names = [n for n in self.files.names(f"{self.root}/versions") if n.endswith(".json")]
        taken = [int(n.split(".")[0]) for n in names]
        if any(n > version and self.pointer(n) for n in taken):
            raise RuntimeError(f"version {version} is no longer the latest")
        new = max([version, *taken]) + 1  # past pointers that were never finished
        self.files.create(f"{self.root}/versions/{new:08}.json", json.dumps({"schema": schema.json(), "parts": parts}) + "\n" + END)
        return new

    def part(self, row) -> str:
        """The name of a part: its values as JSON."""
        return json.dumps([row[c] for c in self.by], default=str)

    def write_parts(self, df: DataFrame) -> dict[str, str]:
        """Folders of the parts of some rows, written."""
        folder = f"{self.root}/data/{uuid.uuid4().hex}"
        name = F.sha2(F.to_json(F.struct(*self.by), {"ignoreNullFields": "false"}), 256)
        df.withColumn("_part", name).write.partitionBy("_part").parquet(folder)
        back = self.spark.read.schema(df.withColumn("_part", name).schema).parquet(folder)
        return {self.part(r): f"{folder}/_part={r['_part']}" for r in back.select(*self.by, "_part").distinct().collect()}  # one row for each part

    def read(self, version: int | None = None) -> DataFrame:
        """The rows of a version, the latest without one."""
        p = self.pointer(self.latest() if version is None else version) if self.pointers() else None
        if p is None:
            raise ValueError(f"no manifest at {self.root}")
        schema = StructType.fromJson(json.loads(p["schema"]))
        return self.load(schema, list(p["parts"].values()))

    def load(self, schema: StructType, folders: list[str]) -> DataFrame:
        return self.spark.read.schema(schema).parquet(*folders) if folders else self.spark.createDataFrame([], schema)

    def replace(self, df: DataFrame) -> int:
        """The first version, or one that shares nothing with those before."""
        return self.swap(self.latest(), df.schema, self.write_parts(df))

    def rewrite(self, concerned: Column, change: Callable[[DataFrame], DataFrame]) -> int:
        """A version in which `change` was applied to the whole of each part that holds a concerned row; other parts keep
        their folders. The version that there is, if no row is concerned. The change keeps the columns."""
        version = self.latest()
        p = self.pointer(version) if version else None
        if p is None:
            raise ValueError(f"no manifest at {self.root}")
        schema = StructType.fromJson(json.loads(p["schema"]))
        touched = [self.part(r) for r in self.load(schema, list(p["parts"].values())).where(concerned).select(*self.by).distinct().collect()]
        if not touched:
            return version
        new = change(self.load(schema, [p["parts"][t] for t in touched]))
        if new.schema.names != schema.names:
            raise ValueError("the change does not keep the columns")
        written = self.write_parts(new)
        kept = {k: v for k, v in p["parts"].items() if k not in touched}
        if clash := written.keys() & kept.keys():
            raise ValueError(f"the change moved rows to other parts: {sorted(clash)}")
        return self.swap(version, schema, kept | written)

    def vacuum(self, keep: int = 1) -> list[str]:
        """Delete the folders that none of the last `keep` versions names; returns their names."""
        versions = self.pointers()[-keep:]
        named = {f.split("/data/")[1].split("/")[0] for v in versions for f in self.pointer(v)["parts"].values()}
        gone = [n for n in self.files.names(f"{self.root}/data") if n not in named]
        for n in gone:
            self.files.delete(f"{self.root}/data/{n}")
        for v in self.pointers()[:-keep]:
            self.files.delete(f"{self.root}/versions/{v:08}.json")
        return gone


def purge(manifest: Versioned, keys: Sequence[str], suffixes: Sequence[str] = ("_holdout",)) -> DataFrame:
    """Delete the rows of some sources, under their key with a holdout suffix too; source_key and how many of it went."""
    doomed = F.coalesce(F.col("source_key").isin(*[k + s for k in keys for s in ("", *suffixes)]), F.lit(False))
    before = manifest.read()
    manifest.rewrite(doomed, lambda rows: rows.where(~doomed))
    return before.where(doomed).groupBy("source_key").agg(F.count("*").alias("removed"))


def normalise(manifest: Versioned, stamp: str) -> int:
    """Stamp the rows without an encoding; those that have one, and parts of only such rows, stay as they are."""
    names = manifest.read().columns
    return manifest.rewrite(F.coalesce(F.col("encoding"), F.lit("")) == "", lambda rows: stamped(rows, stamp).select(*names))


class FeatureCache:
    """Vectors by split and view, each a folder of its own, with the rows that they belong to."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.root, self.files = spark, path.rstrip("/"), Files(spark, path)

    def folder(self, split: str, view: str, digest: str) -> str:
        return f"{self.root}/split={split}/view={view}/{digest}"

    def complete(self, split: str, view: str, digest: str) -> bool:
        return self.files.exists(f"{self.folder(split, view, digest)}/_SUCCESS")

    def extract(self, rows: DataFrame, views: dict[str, Callable[[DataFrame], Column]], *, key: str, split: str = "split", version: str = "1") -> list[tuple[str, str]]:
        """Fill the cache with the vectors that each view makes of the rows, null where a row can't be read. A part is
        complete when all its rows were written; complete parts of the same keys are left alone, and a part whose keys or
        `version` changed is written anew. Returns the parts that were written."""
        digest = F.concat_ws("-", F.lit(version), F.count("*"), F.hex(F.sum(F.xxhash64(key).cast("decimal(38,0)")).cast("string")))
        done = []
        for r in rows.groupBy(split).agg(digest.alias("digest")).orderBy(split).collect():  # one row for each split
            for name, make in views.items():
                if self.complete(r[split], name, r.digest):
                    continue
                part = rows.where(F.col(split).eqNullSafe(r[split]))
                part.select(F.col(key), make(part).alias("vector")).write.mode("overwrite").parquet(self.folder(r[split], name, r.digest))
                index = f"{self.root}/split={r[split]}/index/{name}"
                self.files.delete(index)
                self.files.create(index, r.digest)
                done.append((r[split], name))
        return done

    def load(self, split: str, views: Sequence[str] | None = None) -> DataFrame:
        """key and a column of vectors for each view of a split; rows that any of them can't read are left out. An error
        for a split that was never filled, and for views that it lacks."""
        there = self.files.names(f"{self.root}/split={split}/index")
        if not there:
            raise ValueError(f"no features of split {split}")
        wanted = list(views) if views else there
        if missing := [v for v in wanted if v not in there]:
            raise ValueError(f"no views {missing} of split {split}; there are {there}")
        parts = [self.spark.read.parquet(self.folder(split, v, self.files.text(f"{self.root}/split={split}/index/{v}"))) for v in wanted]
        (key,) = [c for c in parts[0].columns if c != "vector"]
        named = [p.where("vector is not null").withColumnRenamed("vector", v) for p, v in zip(parts, wanted, strict=True)]
        return reduce(lambda a, b: a.join(b, key), named)
