"""Row groups of evenly spread Parquet shards as a Python data source, and fetchers by name.

The source `row_groups` plans on the footers alone: of all shards, in order of their names, at most `max_shards` are
chosen, spread evenly; their row groups are dealt in turns, the first of each shard, then the second of each, until the
quota is met. Each such row group is a partition, read by its own task, of the last one only as many rows as are lacking.
Only the columns of the given schema are read, in its types; one that a shard lacks is null there. Paths are those that Arrow's file systems open (local, hdfs, s3 ...).
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import pyarrow as pa
import pyarrow.parquet as pq
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition
from pyspark.sql.pandas.types import from_arrow_schema, to_arrow_schema
from pyspark.sql.types import StructType

from ..operators.ingest import SourceSpec
from ..operators.sampling import spread


def shards(path: str) -> tuple[fs.FileSystem, list[str]]:
    """The Parquet files under a path, by name; those whose name begins with _ or . are not data."""
    system, root = fs.FileSystem.from_uri(path) if "://" in path else (fs.LocalFileSystem(), path)
    info = system.get_file_info(root)
    if info.type == fs.FileType.File:
        return system, [root]
    found = system.get_file_info(fs.FileSelector(root, recursive=True))
    return system, sorted(f.path for f in found if f.type == fs.FileType.File and f.path.endswith(".parquet") and not f.base_name.startswith(("_", ".")))


@dataclass
class RowGroup(InputPartition):
    shard: str
    group: int
    rows: int

    def __post_init__(self):
        super().__init__((self.shard, self.group))


def dealt(sizes: list[list[int]], quota: int | None) -> list[tuple[int, int, int]]:
    """shard, row group, rows to take: row groups in turns over the shards until the quota is met."""
    out, left = [], quota
    for group in range(max(map(len, sizes), default=0)):
        for shard, groups in enumerate(sizes):
            if group < len(groups) and left != 0:
                rows = groups[group] if left is None else min(left, groups[group])
                left = left if left is None else left - rows
                out.append((shard, group, rows))
    return out


class RowGroupReader(DataSourceReader):
    def __init__(self, path: str, kind: pa.Schema, most: int, quota: int | None):
        self.path, self.kind, self.most, self.quota = path, kind, most, quota

    def partitions(self) -> list[RowGroup]:
        system, files = shards(self.path)
        chosen = [files[i] for i in spread(len(files), self.most)]
        footers = [pq.read_metadata(f, filesystem=system) for f in chosen]
        sizes = [[m.row_group(g).num_rows for g in range(m.num_row_groups)] for m in footers]
        return [RowGroup(chosen[s], g, n) for s, g, n in dealt(sizes, self.quota)] or [RowGroup("", 0, 0)]

    def read(self, part: RowGroup) -> Iterator[pa.RecordBatch]:
        if not part.rows:
            return
        system = fs.FileSystem.from_uri(self.path)[0] if "://" in self.path else fs.LocalFileSystem()
        left = part.rows
        with pq.ParquetFile(part.shard, filesystem=system) as file:
            there = [c for c in self.kind.names if c in file.schema_arrow.names]
            for batch in file.iter_batches(batch_size=8192, row_groups=[part.group], columns=there):
                batch = batch.slice(0, left)
                left -= batch.num_rows
                yield pa.RecordBatch.from_arrays([batch.column(f.name).cast(f.type) if f.name in there else pa.nulls(batch.num_rows, f.type) for f in self.kind], schema=self.kind)
                if not left:
                    return


class RowGroups(DataSource):
    """Options: path, max_shards (12), quota (all). Give a schema to read only its columns; without one all are read."""

    @classmethod
    def name(cls) -> str:
        return "row_groups"

    def schema(self) -> StructType:
        system, files = shards(self.options["path"])
        if not files:
            raise ValueError(f"no Parquet file under {self.options['path']}")
        return from_arrow_schema(pq.read_schema(files[0], filesystem=system))

    def reader(self, schema: StructType) -> RowGroupReader:
        quota = self.options.get("quota")
        return RowGroupReader(self.options["path"], to_arrow_schema(schema), int(self.options.get("max_shards", 12)), int(quota) if quota else None)


def read_row_groups(spark: SparkSession, path: str, columns: list[str] | None = None, *, max_shards: int = 12, quota: int | None = None) -> DataFrame:
    """Rows of the row groups that the source chooses; of the wanted columns those that the first shard has."""
    spark.dataSource.register(RowGroups)
    options = {"max_shards": str(max_shards)} | ({"quota": str(quota)} if quota else {})
    r = spark.read.format("row_groups").options(**options)
    if columns is None:
        return r.load(path)
    system, files = shards(path)
    whole = from_arrow_schema(pq.read_schema(files[0], filesystem=system)) if files else StructType()
    return r.schema(StructType([f for f in whole if f.name in columns])).load(path)


#: Fetchers by name: functions (spark, path, columns, quota) -> DataFrame.
FETCHERS: dict[str, Callable[[SparkSession, str, list[str] | None, int | None], DataFrame]] = {}


def fetcher(name: str):
    def add(f):
        FETCHERS[name] = f
        return f

    return add


@fetcher("row_groups")
def fetch_row_groups(spark, path, columns, quota):
    return read_row_groups(spark, path, columns, quota=quota)


@fetcher("parquet")
def fetch_parquet(spark, path, columns, quota):
    rows = spark.read.parquet(path)
    rows = rows.select(*[c for c in rows.columns if c in columns]) if columns else rows
    return rows.limit(quota) if quota else rows


@fetcher("json")
def fetch_json(spark, path, columns, quota):
    rows = spark.read.json(path)
    rows = rows.select(*[c for c in rows.columns if c in columns]) if columns else rows
    return rows.limit(quota) if quota else rows


def fetch(spark: SparkSession, name: str, spec: SourceSpec, path: str, *, also: list[str] = (), quota: int | None = None) -> DataFrame:
    """A source read by the fetcher of a name, only the columns that its spec needs and those wanted `also` as far as they
    are there, and mapped by the spec. The quota counts rows before the spec's filters."""
    if name not in FETCHERS:
        raise ValueError(f"no fetcher {name}; there are {', '.join(sorted(FETCHERS))}")
    return spec.apply(FETCHERS[name](spark, path, sorted({*spec.columns(), *also}), quota))
