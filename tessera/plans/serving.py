"""Queries over scorers, row groups and served heads."""

import uuid

from pyspark.sql import functions as F

from ..functions import grids
from ..operators import learning, metrics, scoring
from ..operators.ingest import SourceSpec
from ..operators.sampling import spread
from ..session import shared_folder
from ..sources import shards, versioned
from .pixels import of_grid, pictures
from .views import SQL_MANIFEST, manifest as manifest_v, read

Q: dict = {}
S: dict = {}


def query(sql: str | None = None):
    def add(f):
        Q[f.__name__] = f
        if sql:
            S[f.__name__] = sql
        return f

    return add


#: Weights of a linear scorer by a rule, so that SQL can state them too.
WEIGHTS = [((37 * i) % 11 - 5) / 10 for i in range(64)]
SQL_P = """x as (select vec_id, label, case when vec_id % 13 = 0 then null when vec_id % 17 = 0 then embedding[1:60] else embedding end as v from embeddings),
sc as (select vec_id, label, case when len(v) = 64 then round(1 / (1 + exp(-2 * (list_sum(list_transform(v, lambda c, i: c::double * (((37 * (i - 1)) % 11 - 5) / 10.0::double))) + 0.25))), 6) end as p_fake from x)"""


def spoilt(spark, d):
    """Embeddings of which some are missing and some cut short."""
    i, e = F.col("vec_id"), F.col("embedding")
    return read(spark, d, "embeddings").withColumn("embedding", F.when(i % 13 == 0, None).when(i % 17 == 0, F.slice(e, 1, 60)).otherwise(e))


@query(f"with {SQL_P} select vec_id, p_fake from sc")
def scorer_registry(spark, d):
    """A scorer by name; rows that it can't read have no score."""
    s = scoring.score(spoilt(spark, d), "linear", key="vec_id", vector="embedding", size=64, weights=WEIGHTS, bias=0.25, scale=2.0)
    return s.select("vec_id", F.round("p_fake", 6).alias("p_fake"))


@query(f"with {SQL_P} select label, count(*) as n, count(*) filter (p_fake is null) as unscored from sc group by label")
def unscored_rows(spark, d):
    """Scores that come back in another order, joined by key; how many rows of each label have none."""
    rows = spoilt(spark, d)
    s = scoring.score(rows.orderBy(F.desc("vec_id")), "linear", key="vec_id", vector="embedding", size=64, weights=WEIGHTS, bias=0.25, scale=2.0)
    return scoring.unscored(scoring.with_scores(rows, s.where("p_fake is not null"), "vec_id"), "label")


@query(f"with {SQL_P} select vec_id, p_fake from sc")
def score_cache(spark, d):
    """Scores of which half stand in a cache when the rest is asked for."""
    rows, top = spoilt(spark, d), f"{shared_folder(spark)}/scores-{uuid.uuid4().hex}"
    calls = {"key": "vec_id", "vector": "embedding", "size": 64, "weights": WEIGHTS, "bias": 0.25, "scale": 2.0}
    scoring.cached_scores(rows.where("vec_id % 2 = 0"), top, "linear", "linear", **calls)
    return scoring.cached_scores(rows, top, "linear", "linear", **calls)


#: Lines by order number modulo 30 are shards, of which 12 evenly spread ones are read.
CHOSEN = spread(30, 12)


@query(f"select l_returnflag, count(*) as n, sum(l_quantity) as quantity from lineitem where l_orderkey % 30 in ({', '.join(map(str, CHOSEN))}) group by l_returnflag")
def row_group_scan(spark, d):
    """Lines written as 30 shards, then read by row groups of 12 evenly spread ones, two columns of them."""
    top = f"{shared_folder(spark)}/shards-{uuid.uuid4().hex}"
    lines = read(spark, d, "lineitem").repartitionById(30, (F.col("l_orderkey") % 30).cast("int"))  # a task writes its shard as it comes, without a sort
    lines.write.option("parquet.block.size", 1 << 16).parquet(top)
    return shards.read_row_groups(spark, top, ["l_returnflag", "l_quantity"]).groupBy("l_returnflag").agg(F.count("*").alias("n"), F.sum("l_quantity").alias("quantity"))


@query("select case l_returnflag when 'R' then 'fake' else 'real' end as label, case when l_linestatus = 'O' then 'lines_holdout' else 'lines' end as source_key, count(*) as n from lineitem where l_returnflag in ('R', 'A') group by all")
def fetched_source(spark, d):
    """A source by its fetcher's name: only the columns of its spec are read, then mapped."""
    spec = SourceSpec("lines", label_column="l_returnflag", label_map={"R": "fake", "A": "real"}, holdout_when={"l_linestatus": ["O"]})
    return shards.fetch(spark, "parquet", spec, f"{d}/lineitem.parquet").groupBy("label", "source_key").agg(F.count("*").alias("n"))


def stored(spark, d):
    """The manifest of documents as a versioned one; a third of its rows are stamped already."""
    third = F.when(F.col("doc_id") % 3 == 0, "q95")
    m = manifest_v(spark, d).select("doc_id", "sha256", "split", "label", "source_key", third.alias("encoding"), F.lit(None).cast("string").alias("source_sha256"))
    out = versioned.Versioned(spark, f"{shared_folder(spark)}/manifest-{uuid.uuid4().hex}")
    out.replace(m)
    return out


@query(f"with {SQL_MANIFEST} select doc_id, split, label, source_key from m where source_key not in ('src1', 'src1_holdout', 'src18', 'src18_holdout')")
def purged_manifest(spark, d):
    """Two sources deleted in place: parts that hold none of their rows keep their files."""
    m = stored(spark, d)
    versioned.purge(m, ["src1", "src18"])
    return m.read().select("doc_id", "split", "label", "source_key")


@query(f"with {SQL_MANIFEST} select split, label, case when doc_id % 3 = 0 then 'q95' else 'q90' end as encoding, count(*) as n, count(*) filter (doc_id % 3 <> 0) as with_source from m where split <> 'val' group by all")
def normalised_manifest(spark, d):
    """Rows without a stamp get one in place and keep the hash that they had; then a split is deleted."""
    m = stored(spark, d)
    versioned.normalise(m, "q90")
    m.rewrite(F.col("split") == "val", lambda rows: rows.where("split <> 'val'"))
    return m.read().groupBy("split", "label", "encoding").agg(F.count("*").alias("n"), F.count_if(F.col("source_sha256") == F.col("sha256")).alias("with_source"))


@query("""with x as (select vec_id, case when vec_id % 4 = 0 then 'val' else 'train' end as split, list_transform(embedding, lambda c: c::double) as e from embeddings where vec_id % 13 <> 0)
select vec_id, round(list_sum(e[1:32]), 6) as first, round(list_sum(e[33:64]), 6) as second from x where split = 'train'""")
def cached_features(spark, d):
    """Two views of the embeddings from a cache that was filled in two runs; rows that can't be read are left out."""
    i = F.col("vec_id")
    rows = read(spark, d, "embeddings").select("vec_id", F.when(i % 4 == 0, "val").otherwise("train").alias("split"), F.when(i % 13 != 0, F.transform("embedding", lambda x: x.cast("double"))).alias("e"))
    cache = versioned.FeatureCache(spark, f"{shared_folder(spark)}/features-{uuid.uuid4().hex}")
    half = lambda at: lambda part: F.slice("e", at, 32)
    cache.extract(rows.where("split = 'val'"), {"first": half(1), "second": half(33)}, key="vec_id")
    cache.extract(rows, {"first": half(1), "second": half(33)}, key="vec_id")
    total = lambda c: F.round(F.aggregate(c, F.lit(0.0), lambda s, x: s + x), 6).alias(c)
    return cache.load("train").select("vec_id", total("first"), total("second"))


@query()
def fused_heads(spark, d):
    """Heads of four views with a fusion that learned from adaptation rows alone, saved, loaded and served on the rest."""
    e = read(spark, d, "embeddings").select("vec_id", (F.col("label") >= 5).cast("int").alias("y"), F.pmod(F.xxhash64("vec_id"), F.lit(10)).alias("part"), "embedding")
    names = ["v0", "v1", "v2", "v3"]
    e = e.select("vec_id", "y", "part", *[F.transform(F.slice("embedding", 16 * i + 1, 16), lambda x: x.cast("double")).alias(v) for i, v in enumerate(names)])
    bundle = learning.fit_bundle(e.where("part < 5"), e.where("part in (5, 6)"), names, adaptation=e.where("part = 7"), grid=(0.01, 1.0))
    path = f"{shared_folder(spark)}/bundle-{uuid.uuid4().hex}"
    bundle.save(spark, path)
    served = learning.Bundle.load(spark, path).serve(e.where("part > 7"), names)
    return served.select("vec_id", "y", F.round("p_fake", 6).alias("p"), (F.col("p_fake") >= F.lit(bundle.thresholds["served"])).alias("flagged"))


@query()
def shortcut_probe(spark, d):
    """How well ten low-level statistics of their bytes tell the documents' quality, which they should not."""
    p = pictures(spark, d).select("doc_id", of_grid(grids.measures).alias("s")).select("doc_id", "s.*").join(read(spark, d, "labels").select("doc_id", "quality"), "doc_id")
    r = learning.shortcut_probe(p, "doc_id", grids.LOW_LEVEL, y="quality")
    return r.select("n", "balanced_accuracy", "auc", F.array_join(F.transform("top", lambda t: F.concat(t["name"], F.lit(" "), t["weight"].cast("string"))), ", ").alias("top"), metrics.probe_verdict(F.col("balanced_accuracy")).alias("verdict"))
