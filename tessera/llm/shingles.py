"""Near-duplicate texts by an exact set-similarity join over word shingles.

A text is the set of its shingles of `size` words, as 64-bit hashes. Texts whose sets have a Jaccard similarity of 0.8
or more link, and groups are the components of the links. Texts of equal sets form a class; only classes are joined.
SimHash fingerprints of a radius that can be searched lose a part of these links (README): `simhash.first_of_groups` links
by both.

1. Shingles are counted in hash buckets, and each set is put in the order of these counts, rarest first. Two linked sets
   share a shingle among the n - ceil(0.8 n) + 1 rarest of each, whatever the order, so only these prefixes are joined;
   shingles of a single class go at once. Passages that many texts share come last in the order.
2. Stars: each class is held against the least class of each shingle of its prefix. That links most of a large group
   without pairing it up.
3. Pairs: classes that share a shingle and aren't in one component yet, all of them.

How many shingles two prefixes share bounds what the sets can share; a pair that can reach 0.8 is compared on the whole
sets. The documents are dealt out once, by key and text, to a bucketed table, from which both rounds of comparisons and
the result take the texts without another shuffle of them.

Defined cases: null texts, empty ones and those of blanks only have an empty set and form one group; fewer words
than a shingle form one shingle; an empty table gives an empty result.
"""

from __future__ import annotations

from typing import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .components import connected_components
from .shared import bucketed, free_names, materialise, words

BUCKETS = 1 << 16
SEED = 42


def shingles(text: str | None, size: int) -> np.ndarray:
    """The distinct shingle hashes, sorted."""
    ws = words(text)
    if not ws:
        return np.empty(0, dtype=np.int64)
    joined = map(b" ".join, zip(*(ws[i:] for i in range(size)), strict=False)) if len(ws) >= size else [b" ".join(ws)]
    return np.unique(np.fromiter((xxhash.xxh64_intdigest(x, SEED) for x in joined), dtype=np.uint64, count=max(1, len(ws) - size + 1)).view(np.int64))


def rarity(docs: DataFrame, text: str, size: int) -> np.ndarray:
    """How many shingles fall to each bucket."""

    def run(batches):
        total, held, n = np.zeros(BUCKETS, dtype=np.int64), [], 0
        for b in batches:
            for x in b.column(0):
                held.append(shingles(x.as_py(), size) & (BUCKETS - 1))
                n += len(held[-1])
                if n > 1_000_000:
                    total += np.bincount(np.concatenate(held), minlength=BUCKETS)
                    held, n = [], 0
        if held:
            total += np.bincount(np.concatenate(held), minlength=BUCKETS)
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(total[at])], names=["b", "n"])

    counts = np.zeros(BUCKETS, dtype=np.int64)
    for r in docs.select(text).mapInArrow(run, "b long, n long").groupBy("b").agg(F.sum("n").alias("n")).collect():  # BUCKETS rows at most
        counts[r.b] = r.n
    return counts


def prefixed(text: Column, size: int, counts: np.ndarray) -> Column:
    """sh (hash of the set), n (its size) and prefix (its rarest shingles, rarest first) of a text."""
    kind = pa.struct([("sh", pa.int64()), ("n", pa.int32()), ("prefix", pa.list_(pa.int64()))])

    def one(x: str | None) -> dict:
        s = shingles(x, size)
        order = np.lexsort((s, counts[s & (BUCKETS - 1)]))
        return {"sh": int(np.uint64(xxhash.xxh64_intdigest(s.tobytes(), SEED)).view(np.int64)), "n": len(s), "prefix": s[order[: len(s) - (4 * len(s) + 4) // 5 + 1]]}

    def run(it: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for a in it:
            yield pa.array([one(x.as_py()) for x in a], kind)

    return F.arrow_udf(run, "struct<sh: long, n: int, prefix: array<long>>")(text)


def whole(text: Column, size: int) -> Column:
    def run(it: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for a in it:
            yield pa.array([shingles(x.as_py(), size) for x in a], pa.list_(pa.int64()))

    return F.arrow_udf(run, "array<long>")(text)


def probed(n: Column) -> Column:
    """How many of n shingles are in the prefix: n - ceil(0.8 n) + 1."""
    return n - F.floor((n * 4 + 4) / 5).cast("int") + 1


def similar_length(n: Column, m: Column) -> Column:
    return F.least(n, m) * 5 >= F.greatest(n, m) * 4


def enough(common: Column, n: Column, m: Column) -> Column:
    """Jaccard >= 4/5 for sets of n and m."""
    return common * 9 >= (n + m) * 4


def promising(rows: DataFrame) -> DataFrame:
    """Pairs (a, b) of rows (a, n, b, m), one for each common shingle of the prefixes, whose sets can be alike: beyond
    the prefix that ends first in the order of shingles, what its set has left can be common at most."""
    pairs = rows.groupBy("a", "n", "b", "m").agg(F.count("*").alias("c"))
    beyond = F.greatest(F.col("n") - probed(F.col("n")), F.col("m") - probed(F.col("m")))
    return pairs.where(enough(F.col("c") + beyond, F.col("n"), F.col("m"))).select("a", "b")


def alike(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """The pairs (columns a, b) of a similarity of 0.8 or more."""
    one, two = (sets.select(F.col("sh").alias(x), F.col("w").alias(f"{x}w")).hint("merge") for x in "ab")
    both = pairs.join(one, "a").join(two, "b")
    return both.where(enough(F.size(F.array_intersect("aw", "bw")), F.size("aw"), F.size("bw"))).select("a", "b")


def place(key: str, text: str) -> Column:
    """A hash of key and text: rows that agree in it are the same document; copies under other keys lie apart."""
    return F.xxhash64(F.coalesce(F.col(key).cast("string"), F.lit("")), F.col(key).isNull(), text)


def sets_of(docs: DataFrame, marked: DataFrame, classes: DataFrame, place: str, text: str, size: int) -> DataFrame:
    """sh and w (the whole set) of the classes, from one document of each; docs is bucketed by place."""
    one = marked.join(classes, "sh", "left_semi").groupBy("sh").agg(F.min("at").alias("at"))
    texts = docs.select(F.col(place).alias("at"), F.col(text).alias("text")).join(one.hint("merge"), "at")
    return texts.dropDuplicates(["at"]).select("sh", whole(F.col("text"), size).alias("w"))


def groups(docs: DataFrame, place: str, *, key="doc_id", text="text", size: int = 5, also: Column | None = None) -> tuple[DataFrame, DataFrame]:
    """Each document as doc_id, at (its place), sh (class) and what is wanted `also`, and the components (node, component)
    of linked classes."""
    counts = rarity(docs, text, size)
    rows = docs.select(F.col(key).alias("doc_id"), F.col(place).alias("at"), prefixed(F.col(text), size, counts).alias("s"), (F.lit(None) if also is None else also).alias("also"))
    marked = materialise(rows.select("doc_id", "at", "s.sh", "s.n", "s.prefix", "also"))
    t = Window.partitionBy("t")
    prefixes = marked.groupBy("sh", "n").agg(F.any_value("prefix").alias("prefix")).select("sh", "n", F.posexplode("prefix").alias("k", "t"))
    ends = prefixes.select("t", "sh", "n", "k", F.min(F.struct("sh", "n")).over(t).alias("head"), F.max("sh").over(t).alias("last"))
    shared = materialise(ends.where("head.sh <> last").drop("last"))
    star = shared.where((F.col("sh") != F.col("head.sh")) & similar_length(F.col("n"), F.col("head.n")))
    star = promising(star.select(F.col("head.sh").alias("a"), F.col("head.n").alias("n"), F.col("sh").alias("b"), F.col("n").alias("m")))
    compared = lambda pairs: materialise(alike(pairs, sets_of(docs, marked, pairs.select(F.explode(F.array("a", "b")).alias("sh")).distinct(), place, text, size)))
    links = compared(materialise(star))
    comps = connected_components(links)
    now = shared.join(comps, shared.sh == comps.node, "left").select("t", "sh", "n", "k", F.coalesce("component", "sh").alias("comp"))
    mixed = materialise(now.withColumns({"lo": F.min("comp").over(t), "hi": F.max("comp").over(t)}).where("lo <> hi").drop("lo", "hi"))
    l, r = mixed.alias("l"), mixed.alias("r")
    # before a common shingle no more can be common than come before it in either order, and after it likewise
    most = F.least("l.k", "r.k") + F.least(F.col("l.n") - F.col("l.k"), F.col("r.n") - F.col("r.k"))
    new = (F.col("l.t") == F.col("r.t")) & (F.col("l.sh") < F.col("r.sh")) & (F.col("l.comp") != F.col("r.comp")) & similar_length(F.col("l.n"), F.col("r.n")) & enough(most, F.col("l.n"), F.col("r.n"))
    more = compared(materialise(promising(l.join(r, new).select(F.col("l.sh").alias("a"), F.col("l.n").alias("n"), F.col("r.sh").alias("b"), F.col("r.n").alias("m")))))
    return marked.select("doc_id", "at", "sh", "also"), connected_components(links.union(more))


def firsts(table: DataFrame, at: str, marked: DataFrame, comps: DataFrame, key: str) -> DataFrame:
    """The rows of the table, bucketed by `at`, that come first in the component of their class."""
    least = marked.groupBy("sh").agg(F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "at")).alias("first"))
    of_group = least.join(comps, least.sh == comps.node, "left").groupBy(F.coalesce("component", "sh")).agg(F.min("first").alias("first"))
    k, mine = free_names(table, "_key", "_mine")
    first = materialise(of_group.select(F.col("first.at").alias(mine), F.col("first.doc_id").alias(k)))
    same = (F.col(at) == F.col(mine)) & F.col(key).eqNullSafe(F.col(k))
    return table.join(first.hint("merge"), same, "left_semi").dropDuplicates([at, key])


def keep_first(docs: DataFrame, *, key="doc_id", text="text", size: int = 5) -> DataFrame:
    """The documents without those that have an earlier near duplicate: of each group one row stays, with the least key
    and then the least hash, null keys last; all columns kept."""
    (at,) = free_names(docs, "_at")
    table = bucketed(docs.withColumn(at, place(key, text)), at)
    marked, comps = groups(table, at, key=key, text=text, size=size)
    return firsts(table, at, marked, comps, key).select(*docs.columns)
