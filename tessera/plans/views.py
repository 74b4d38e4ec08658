"""Stand-in views over the star schema: a manifest of documents, scores of embeddings; and the same in SQL."""

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.sampling import hash_split

HOLDOUT_SOURCES, HOLDOUT_LANG = ("src18", "src19"), "de"


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents as manifest rows: path, sha256, source, generator, n_chars, split."""
    d = read(spark, sf_dir, "documents").select("doc_id", F.sha2(F.col("text"), 256).alias("sha256"), "source", F.col("lang").alias("generator"), "n_chars")
    return d.withColumn("split", hash_split(F.col("sha256")))


def manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Labelled documents with quarantined sources and one language held out."""
    held = F.col("source").isin(*HOLDOUT_SOURCES) | (F.col("generator") == HOLDOUT_LANG)
    m = documents(spark, sf_dir).join(read(spark, sf_dir, "labels"), "doc_id")
    return m.select(
        "doc_id", "sha256", "source", "generator", "n_chars", "toxic",
        F.when(F.col("quality") == 1, "real").otherwise("fake").alias("label"),
        F.when(held, F.concat("source", F.lit("_holdout"))).otherwise(F.col("source")).alias("source_key"),
        F.when(held, "holdout").otherwise(F.col("split")).alias("split"),
        held.alias("holdout"),
    )


def scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """vec_id, y, grp, tier, margin, p: the logistic of a centroid margin, rounded so that no summation order shows."""
    e = read(spark, sf_dir, "embeddings").select("vec_id", "embedding", "label", (F.col("label") >= 5).cast("int").alias("y"))
    x = e.select("y", F.posexplode("embedding").alias("i", "v")).select("y", "i", F.col("v").cast("double").alias("v"))
    w = x.groupBy("i").agg(F.round(F.avg(F.when(F.col("y") == 1, F.col("v"))) - F.avg(F.when(F.col("y") == 0, F.col("v"))), 6).alias("w"))
    weights = w.agg(F.transform(F.array_sort(F.collect_list(F.struct("i", "w"))), lambda s: s["w"]).alias("w"))  # one row of as many numbers as an embedding has
    dot = F.aggregate(F.zip_with("embedding", "w", lambda a, b: a.cast("double") * b), F.lit(0.0), lambda s, z: s + z)
    s = e.crossJoin(F.broadcast(weights)).withColumn("margin", F.round(dot, 9))
    p = F.round(1 / (1 + F.exp(-8 * F.col("margin"))), 10)
    return s.select("vec_id", "y", F.col("label").alias("grp"), (F.col("label") % 4).alias("tier"), "margin", p.alias("p"))


SQL_DOCS = """docs as (select doc_id, sha256(text) as sha256, source, lang as generator, n_chars, text from documents),
frac as (select *, ('0x' || substr(sha256, 1, 8))::bigint::double / 4294967295.0::double as f from docs),
dm as (select * exclude (f), case when f < 0.8 then 'train' when f < 0.9 then 'val' else 'test' end as split from frac)"""

SQL_MANIFEST = SQL_DOCS + """,
held as (select dm.*, toxic, quality, (source in ('src18', 'src19') or generator = 'de') as holdout from dm join labels using (doc_id)),
m as (select doc_id, sha256, source, generator, n_chars, toxic, holdout, case when quality = 1 then 'real' else 'fake' end as label,
  case when holdout then source || '_holdout' else source end as source_key, case when holdout then 'holdout' else split end as split from held)"""

SQL_SCORES = """e as (select vec_id, embedding, label, (label >= 5)::int as y from embeddings),
x as (select vec_id, y, unnest(embedding)::double as v, generate_subscripts(embedding, 1) as i from e),
w as (select i, round(avg(v) filter (y = 1) - avg(v) filter (y = 0), 6) as w from x group by i),
mg as (select vec_id, round(sum(v * w), 9) as margin from x join w using (i) group by vec_id),
s as (select vec_id, y, label as grp, label % 4 as tier, margin, round(1 / (1 + exp(-8 * margin)), 10) as p from e join mg using (vec_id))"""
