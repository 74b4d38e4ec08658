"""Resumable ingest as Structured Streaming: append with dedup by content, quotas by key, bounded batches."""

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout
from pyspark.sql.types import IntegerType, StructField, StructType


def arrivals(spark: SparkSession, path: str, schema: StructType, per_batch: int = 100, form: str = "parquet", glob: str | None = None) -> DataFrame:
    r = spark.readStream.schema(schema).option("maxFilesPerTrigger", per_batch)
    return (r.option("pathGlobFilter", glob) if glob else r).format(form).load(path)


def deduplicated(stream: DataFrame, keys: list[str], ts: str, delay: str) -> DataFrame:
    """The first arrival of each key; state is kept for the watermark's delay, not for ever."""
    return stream.withWatermark(ts, delay).dropDuplicatesWithinWatermark(keys)


def first_arrivals(stream: DataFrame, keys: list[str]) -> DataFrame:
    """The first arrival of each key, for ever: state holds every key, so run it on the RocksDB state store."""
    return stream.dropDuplicates(keys)


def append_new(stream: DataFrame, keys: list[str], store: str, checkpoint: str, *, order: str | None = None, buckets: int = 64) -> None:
    """Append what has arrived to a store that holds each key once, however far apart its arrivals are, then stop.

    What was stored is the state: a batch is held against the keys in the store's buckets, so a key is known after a
    restart, without the checkpoint too, and a batch that ran before it could be marked as done adds nothing when it runs
    again. Of a key's rows in one batch the first by `order` is kept (any, without it); null keys equal each other. The
    store is Parquet in folders by a key's bucket; only the key columns are read back, and of the folders those that the
    batch's keys fall into are joined.
    """
    bucket = F.pmod(F.xxhash64(*keys), F.lit(buckets)).cast("int")
    schema = StructType([*stream.schema, StructField("bucket", IntegerType())])

    def put(batch: DataFrame, _: int) -> None:
        rows = batch.withColumn("bucket", bucket)
        if order:
            first = rows.groupBy("bucket", *keys).agg(F.min_by(F.struct(*batch.columns), order).alias("_row"))
            rows = first.select("_row.*", "bucket")
        else:
            rows = rows.dropDuplicates(keys)
        held = batch.sparkSession.read.schema(schema).parquet(store).select("bucket", *keys).alias("held")
        same = F.col("new.bucket") == F.col("held.bucket")
        for k in keys:
            same = same & F.col(f"new.{k}").eqNullSafe(F.col(f"held.{k}"))
        rows.alias("new").join(held, same, "left_anti").repartition("bucket").write.mode("append").partitionBy("bucket").parquet(store)

    stream.sparkSession.createDataFrame([], schema).write.mode("append").parquet(store)  # the folder is there from the first batch on
    stream.writeStream.foreachBatch(put).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()


def windowed_counts(stream: DataFrame, ts: str, key: str, width: str, delay: str) -> DataFrame:
    return stream.withWatermark(ts, delay).groupBy(F.window(ts, width), key).agg(F.count("*").alias("n"))


def within_quota(stream: DataFrame, key: str, order: str, quota: int) -> DataFrame:
    """Rows of each key until its quota is met over all batches; the state is one number a key."""

    def take(_, parts: Iterator[pd.DataFrame], state: GroupState):
        n = state.get[0] if state.exists else 0
        for p in parts:
            part = p.sort_values(order).head(max(0, quota - n))
            n += len(part)
            yield part
        state.update((n,))

    return stream.groupBy(key).applyInPandasWithState(take, stream.schema, "n long", "append", GroupStateTimeout.NoTimeout)


def run_available(stream: DataFrame, path: str, checkpoint: str) -> None:
    """Everything there is now, then stop; a restart resumes from the checkpoint."""
    stream.writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint).outputMode("append").trigger(availableNow=True).start().awaitTermination()
