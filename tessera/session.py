"""A session with the settings that the library assumes."""

import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def session(app: str = "tessera", **conf: str) -> SparkSession:
    base = {"spark.sql.session.timeZone": "UTC", "spark.sql.adaptive.enabled": "true", "spark.sql.adaptive.skewJoin.enabled": "true", "spark.sql.ansi.enabled": "true"}
    return SparkSession.builder.appName(app).config(map=base | conf).getOrCreate()


def shared_folder(spark: SparkSession) -> str:
    """The folder of spark.checkpoint.dir; only a session on this machine alone may do without one."""
    named = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not named and not re.match(r"local(\[|$)", spark.sparkContext.master):
        raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
    return (named or f"{tempfile.gettempdir()}/checkpoints/tessera").rstrip("/")


def written(df: DataFrame) -> DataFrame:
    """df written to the shared folder and read back: what is read several times is computed once, and survives executors."""
    path = f"{shared_folder(df.sparkSession)}/written-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
