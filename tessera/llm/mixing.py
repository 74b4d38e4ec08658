"""Mixing sources to target weights with a low-discrepancy schedule (DataFrame functions only).

Each source is a stream of words: its documents in the order of md5(key), repeated up to `cap` times, cut into blocks
of `block` words. Slot k of the schedule takes the van der Corput point of k; the source whose share of [0, 1) holds
the point gets the slot. The r-th slot of a source takes block r of its stream.

Defined cases: a null text has size 0 and is never taken; a null source is a source of its own, last in order; a null
key sorts first in its source; rows equal in key, size and text are interchangeable; an empty table gives an empty
result; a corpus without words has targets of 0. Other columns of the input are ignored, whatever their names.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .shared import WORD, materialise, read

BITS = 48  #: of a van der Corput point
CELLS = 12  #: bits of a point by which points meet the shares of the sources
CHUNK = 16  #: bits of a slot number that are ranked together


def sized(docs: DataFrame, key: str, text: str, source: str) -> DataFrame:
    """One narrow row a document: the key, its source, its words and its place in the shuffled order."""
    return docs.select(
        F.col(key).alias("doc_id"),
        F.col(source).alias("source"),
        F.coalesce(F.regexp_count(F.col(text), F.lit(WORD)), F.lit(0)).cast("long").alias("size"),
        F.coalesce(F.md5(F.col(key).cast("string").cast("binary")), F.lit("")).alias("h"),
        F.coalesce(F.md5(F.col(text).cast("binary")), F.lit("")).alias("th"),
    )


def source_targets(sizes: DataFrame, weights=(5, 2, 1), share: float = 1.5, cap: int = 2) -> DataFrame:
    """A row for each source: idx, source, source_size, target and the edges lo, hi of its share of [0, 2^BITS).

    Weights repeat over the sources in code point order. A target stops at cap times its source; what is over goes to
    the others by weight. Sorted by cap / weight the stopped sources come first, so running sums find the level.
    """
    by_name, by_ratio = Window.orderBy(F.col("source").asc_nulls_last()), Window.orderBy("ratio", "idx")
    before = lambda w: w.rowsBetween(Window.unboundedPreceding, -1)
    s = sizes.groupBy("source").agg(F.sum("size").alias("source_size")).withColumn("idx", F.row_number().over(by_name))
    s = s.withColumn("weight", F.element_at(F.array(*[F.lit(w) for w in weights]), ((F.col("idx") - 1) % len(weights) + 1).cast("int")))
    s = s.withColumn("most", F.col("source_size") * cap).withColumn("ratio", F.col("most") / F.col("weight"))
    every = Window.orderBy(F.lit(0)).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    s = s.withColumn("goal", F.sum("source_size").over(every) * F.lit(share))
    s = s.withColumn("level", (F.col("goal") - F.coalesce(F.sum("most").over(before(by_ratio)), F.lit(0))) / (F.sum("weight").over(every) - F.coalesce(F.sum("weight").over(before(by_ratio)), F.lit(0))))
    s = s.withColumn("free", F.when(F.col("most") > F.col("weight") * F.col("level"), F.col("ratio")))
    s = s.withColumn("level", F.min(F.when(F.col("free").isNotNull(), F.struct("free", "idx", "level"))).over(every)["level"])
    s = s.withColumn("target", F.least(F.col("most").cast("double"), F.coalesce(F.col("weight") * F.col("level"), F.lit(0.0))))
    s = s.withColumn("quota", F.floor("target"))
    total, upto = F.greatest(F.sum("quota").over(every), F.lit(1)), F.sum("quota").over(Window.orderBy("idx"))
    edge = lambda c: F.floor(c / total * F.lit(float(1 << BITS))).cast("long")
    return s.select("idx", "source", "source_size", "target", "quota", edge(upto - F.col("quota")).alias("lo"), edge(upto).alias("hi"))


def schedule(spark: SparkSession, sources: DataFrame, block: int) -> DataFrame:
    """The slots: slot, idx (of the source) and rank (of the slot among its source's), as many as the quotas need.

    Points meet the shares by their first CELLS bits, an equality join over evenly filled cells. Ranks are counted in
    chunks of slots and offset by the chunks before. Slots beyond a quota go; those that a quota still lacks (at most
    about as many as a point has bits) follow at the end.
    """
    need = sources.select("idx", "lo", "hi", F.ceil(F.col("quota") / block).alias("need")).where("need > 0")
    n = need.agg(F.sum("need")).first()[0] or 0
    slots = spark.range(n).select(F.col("id").alias("slot"), F.conv(F.rpad(F.reverse(F.bin("id")), BITS, "0"), 2, 10).cast("long").alias("x"))
    down = F.lit(1 << (BITS - CELLS))
    cells = need.where("hi > lo").withColumn("cell", F.explode(F.sequence(F.floor(F.col("lo") / down), F.floor((F.col("hi") - 1) / down))))
    hit = slots.withColumn("cell", F.floor(F.col("x") / down)).join(cells, "cell").where("x >= lo and x < hi").select("slot", "idx", "need", F.shiftright("slot", CHUNK).alias("chunk"))
    local = hit.withColumn("r", F.row_number().over(Window.partitionBy("idx", "chunk").orderBy("slot")) - 1)
    counts = hit.groupBy("idx", "chunk").agg(F.count("*").alias("n"))
    base = counts.select("idx", "chunk", (F.sum("n").over(Window.partitionBy("idx").orderBy("chunk")) - F.col("n")).alias("base"))
    ranked = local.join(base, ["idx", "chunk"]).select("slot", "idx", (F.col("base") + F.col("r")).alias("rank"), "need").where("rank < need")
    have = counts.groupBy("idx").agg(F.sum("n").alias("have"))
    lack = need.join(have, "idx", "left").withColumn("have", F.coalesce("have", F.lit(0))).where("have < need")
    tail = lack.select((F.lit(n) + F.col("idx")).alias("slot"), "idx", F.explode(F.sequence(F.col("have"), F.col("need") - 1)).alias("rank"))
    return ranked.select("slot", "idx", "rank").union(tail)


def streams(sizes: DataFrame, sources: DataFrame) -> DataFrame:
    """Where each document starts in its source's stream: sums inside 4096 buckets of the order, then of the buckets."""
    placed = sizes.join(sources.select("idx", F.col("source").alias("s"), "source_size", "target", "quota"), sizes.source.eqNullSafe(F.col("s"))).drop("s").withColumn("bucket", F.substring("h", 1, 3))
    order = Window.partitionBy("idx", "bucket").orderBy("h", "doc_id", "size", "th")
    local = placed.withColumn("row", F.row_number().over(order)).withColumn("start", F.sum("size").over(order.rowsBetween(Window.unboundedPreceding, 0)) - F.col("size"))
    sums = placed.groupBy("idx", "bucket").agg(F.sum("size").alias("n"))
    base = sums.select("idx", "bucket", (F.sum("n").over(Window.partitionBy("idx").orderBy("bucket")) - F.col("n")).alias("base"))
    return local.join(base, ["idx", "bucket"]).withColumn("start", F.col("start") + F.col("base")).drop("base")


def mix_sources(docs: DataFrame, *, key="doc_id", text="text", source="source", weights=(5, 2, 1), share=1.5, cap=2, block=256) -> DataFrame:
    """For each document doc_id, size, source_size, target (its source's), taken, the words that the mix takes of it, and
    first_slot and last_slot, where its words stand in the schedule (null where none is taken)."""
    sizes = materialise(sized(docs, key, text, source))
    sources = materialise(source_targets(sizes, weights, share, cap), 1)
    slots = schedule(docs.sparkSession, sources, block)
    rows = streams(sizes, sources)
    passes = F.array(*[F.struct((F.col("start") + F.col("source_size") * i).alias("a"), F.least(F.col("start") + F.col("source_size") * i + F.col("size"), F.col("quota")).alias("b")) for i in range(cap)])
    spans = rows.withColumn("span", F.explode_outer(F.filter(passes, lambda p: p["b"] > p["a"])))
    spans = spans.withColumn("rank", F.explode_outer(F.when(F.col("span").isNotNull(), F.sequence(F.floor(F.col("span.a") / block), F.floor((F.col("span.b") - 1) / block)))))
    part = F.least(F.col("span.b"), (F.col("rank") + 1) * block) - F.greatest(F.col("span.a"), F.col("rank") * block)
    taken = spans.join(slots, ["idx", "rank"], "left").groupBy("idx", "bucket", "row", "doc_id", "size", "source_size", "target").agg(F.sum(F.when(F.col("slot").isNotNull(), part).otherwise(0)).alias("taken"), F.min("slot").alias("first_slot"), F.max("slot").alias("last_slot"))
    return taken.select("doc_id", "size", "source_size", "target", F.coalesce("taken", F.lit(0)).alias("taken"), "first_slot", "last_slot")


def op7_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix_sources(read(spark, sf_dir, "documents"))


OP7_SQL = r"""
with d as (
  select doc_id, source, coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0)::bigint as size,
         coalesce(md5(doc_id::varchar), '') as h, coalesce(md5(text), '') as th from documents),
s as (select source, sum(size)::bigint as source_size, row_number() over (order by source nulls last) as idx from d group by source),
w as (select *, [5, 2, 1][((idx - 1) % 3 + 1)::int] as weight, 2 * source_size as most from s),
l as (select *, most / weight as ratio, sum(source_size) over () * 1.5::double as goal from w),
m as (select *, (goal - coalesce(sum(most) over (order by ratio, idx rows between unbounded preceding and 1 preceding), 0)::double)
                / nullif(sum(weight) over () - coalesce(sum(weight) over (order by ratio, idx rows between unbounded preceding and 1 preceding), 0), 0) as level from l),
f as (select level from m where most > weight * level order by ratio, idx limit 1),
t as (select idx, source, source_size, least(most::double, coalesce(weight * (select level from f), 0.0)) as target, floor(least(most::double, coalesce(weight * (select level from f), 0.0)))::bigint as quota from m),
p as (select row_number() over () as id, d.doc_id, d.size, t.idx, t.source_size, t.target, t.quota,
             sum(d.size) over (partition by d.source order by d.h, d.doc_id, d.size, d.th rows unbounded preceding)::bigint - d.size as a
      from d join t on d.source is not distinct from t.source),
n as (select idx, ceil(quota / 256)::bigint as need, floor((sum(quota) over (order by idx) - quota)::double / greatest(sum(quota) over (), 1) * 281474976710656)::bigint as lo,
             floor(sum(quota) over (order by idx)::double / greatest(sum(quota) over (), 1) * 281474976710656)::bigint as hi from t),
k as (select unnest(range(0, coalesce((select sum(need) from n), 0)::bigint)) as slot),
v as (select slot, list_sum([((slot >> b) & 1) << (47 - b) for b in range(0, 48)])::bigint as x from k),
r as (select slot, idx, need, row_number() over (partition by idx order by slot) - 1 as rank from v join n on x >= lo and x < hi),
c as (select n.idx, n.need, count(r.slot) as have from n left join r using (idx) group by all),
e as (select slot, idx, rank from r where rank < need union all
      select (select sum(need) from n)::bigint + idx, idx, unnest(range(have, need)) as rank from c where have < need),
g as (select id, idx, a + i * source_size as a, least(a + i * source_size + size, quota) as b from p, (select unnest([0, 1]) as i)),
w2 as (select id, min(slot) as first_slot, max(slot) as last_slot, sum(least(b, (rank + 1) * 256) - greatest(a, rank * 256))::bigint as taken
       from g join e on e.idx = g.idx and b > a and rank between a // 256 and (b - 1) // 256 group by id)
select doc_id, size, source_size, target, coalesce(taken, 0)::bigint as taken, first_slot, last_slot from p left join w2 using (id)
"""
