"""What several operators share: the shared folder, materialised cuts, word rules, Arrow passes."""

from __future__ import annotations

import gc
import re
import tempfile
import uuid
from collections.abc import Callable, Iterable, Iterator
from contextlib import contextmanager
from contextvars import ContextVar

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: A word is a run of bytes other than space, tab, LF, VT, FF and CR.
WORD = r"[^\x20\x09-\x0D]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder of spark.checkpoint.dir. Only a session on this machine alone gets one of its own where none is named."""
    named = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.sparkContext.getCheckpointDir()
    if not named and not re.match(r"local(\[|$)", spark.sparkContext.master):
        raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
    if not spark.sparkContext.getCheckpointDir():
        spark.sparkContext.setCheckpointDir(named or f"{tempfile.gettempdir()}/checkpoints/tessera")
    return (named or spark.sparkContext.getCheckpointDir()).rstrip("/")


#: Names of what is written while `noted` is open in this thread.
_NOTED: ContextVar[tuple[list[str], ...]] = ContextVar("noted", default=())


@contextmanager
def noted() -> Iterator[list[str]]:
    """The folders and tables that this thread writes meanwhile, in order; other threads have lists of their own."""
    names: list[str] = []
    token = _NOTED.set((*_NOTED.get(), names))
    try:
        yield names
    finally:
        _NOTED.reset(token)


def note(name: str) -> None:
    for names in _NOTED.get():
        names.append(name)


def materialise(df: DataFrame, parts: int | None = None) -> DataFrame:
    """Write df to the shared folder as Parquet and read it back: lineage ends in files that every executor sees."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/tessera-{uuid.uuid4().hex}"
    (df.coalesce(parts) if parts else df).write.option("compression", "zstd").parquet(path)
    note(path)
    return spark.read.schema(df.schema).parquet(path)


def bucketed(df: DataFrame, column: str) -> DataFrame:
    """Write df as a table in the warehouse, bucketed by a column, and read it back: joins by it shuffle nothing of df."""
    spark, name = df.sparkSession, f"tessera_{uuid.uuid4().hex}"
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    df.repartition(parts, column).write.bucketBy(parts, column).sortBy(column).option("compression", "zstd").saveAsTable(name)
    note(name)
    return spark.table(name)


def discard(spark: SparkSession, names: list[str]) -> None:
    """Delete what materialise and bucketed have written under these names."""
    for name in names:
        if "/" in name:
            path = spark._jvm.org.apache.hadoop.fs.Path(name)
            path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)
        else:
            spark.sql(f"DROP TABLE IF EXISTS {name}")


def release(spark: SparkSession) -> None:
    """Let Spark delete the shuffle files that nothing needs any more; else they stay until the driver's heap fills up."""
    gc.collect()
    spark._jvm.System.gc()


def free_names(df: DataFrame, *names: str) -> list[str]:
    """The names, lengthened until no column of df has them."""
    taken, out = {c.lower() for c in df.columns}, []
    for name in names:
        while name.lower() in taken:
            name += "_"
        taken.add(name.lower())
        out.append(name)
    return out


def ascii_lower(c: Column | str) -> Column:
    """Lower-case A-Z only."""
    return F.translate(c, UPPER, LOWER)


def crc_mod(key: str, m: int) -> Column:
    """crc32 of the key's decimal text, modulo m."""
    return F.crc32(F.col(key).cast("string").cast("binary")) % m


def words(text: str | None) -> list[bytes]:
    """UTF-8 words with A-Z lower-cased; bytes.lower and bytes.split know exactly the ASCII rules used here."""
    return text.encode("utf-8", "surrogatepass").lower().split() if text else []


def arrow_rows(f: Callable[[Iterator[pa.RecordBatch]], Iterable[dict[str, list]]], schema: pa.Schema) -> Callable:
    """For mapInArrow: f yields columns as lists, this makes batches of them."""

    def run(batches):
        for cols in f(batches):
            yield pa.RecordBatch.from_arrays([pa.array(cols[x.name], x.type) for x in schema], schema=schema)

    return run


def slices(batch: pa.RecordBatch, column: str, most: int = 4_000_000) -> Iterator[pa.RecordBatch]:
    """Cuts of a batch with about `most` bytes of text each, so a task never holds many long texts decoded."""
    sizes = [len(x) if x is not None else 0 for x in batch.column(batch.schema.names.index(column)).to_pylist()]
    start = held = 0
    for i, n in enumerate(sizes):
        if i > start and held + n > most:
            yield batch.slice(start, i - start)
            start, held = i, 0
        held += n
    if start < len(sizes):
        yield batch.slice(start)


def bounded_sample(df: DataFrame, group: str, key: str, most: int, most_groups: int = 1000) -> DataFrame:
    """At most `most` rows of each group, those with the least key hashes. Counts of the groups first narrow the hash
    range, before the shuffle, so that about 1.5 * most rows of a group meet in one task. An error beyond most_groups."""
    n = df.groupBy(group).agg(F.count("*").alias("n")).limit(most_groups + 1).collect()
    if len(n) > most_groups:
        raise ValueError(f"more than {most_groups} values of {group}")
    if not n:
        return df
    share = F.shiftrightunsigned(F.xxhash64(key), 11) / F.lit(float(1 << 53))
    counts = F.create_map(*[F.lit(x) for r in n for x in (r[group], float(r.n))])
    near = df.withColumn("_u", share).where(F.col("_u") * counts[F.col(group)] < 1.5 * most + 50)
    order = Window.partitionBy(group).orderBy("_u", key)
    return near.withColumn("_rn", F.row_number().over(order)).where(F.col("_rn") <= most).drop("_u", "_rn")
