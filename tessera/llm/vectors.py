"""Near-duplicate vectors by cross-polytope hashing.

Vectors of equal labels link at a cosine of `least` (0.98) or more, in double precision. Equal vectors of a label form a
class, named by 128 bits of hash; only classes are hashed and compared, with the number of their members.

1. A unit vector, padded to a power of two, is turned by three rounds of random signs and a fast Hadamard transform; its
   hash is the axis that it is nearest to, with its sign: one of 2d values. A table joins k such hashes.
2. Multiprobe: a class stands in its own bucket of each table and asks in `probes` further ones, those that replace one
   hash by the next nearest axis where that costs least.
3. Buckets that hold one class, or only asking ones, are dropped while rows are narrow. The rest is joined with the
   vectors and compared by sorted Arrow batches. A bucket of many classes is dealt to pairs of blocks of `BLOCK` classes.
4. Each candidate pair is verified, and counted in the first table and bucket only by which it can be found, which its
   two hashes tell: no pair leaves a task, but counts and one edge a class, whatever a group's size.

k follows the number of classes of a label, so that buckets hold about one; the number of tables follows from how often
pairs at exactly the least cosine meet, measured on random pairs for this d, k and number of probes, so that a pair at the
least cosine is missed with a probability of `miss` or less, at every size, and closer pairs less often.

Defined cases: a null label, a null or empty or zero vector, and one with a null, NaN or infinite component link with
nothing; vectors of different length don't link; repeated rows are vectors of their own that link with each other; a null
vec_id is ignored when a component is named, unless it has no other; rows without links are their own component; an
empty table gives an empty result. Extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from math import ceil, log

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .components import connected_components
from .shared import materialise, read

BLOCK = 4096
#: Pairs that are held at once in a task, and groups so small that their pairs are made together.
PAIRS, SMALL = 1 << 18, 64
#: Cosines from matrix products this near to the bound are computed again, one by one.
NEAR = 1e-9


def unit(x: np.ndarray) -> np.ndarray:
    """Rows of length 1; scaled first, so that squares neither overflow nor vanish."""
    x = x / np.abs(x).max(1, keepdims=True)
    return x / np.sqrt((x * x).sum(1, keepdims=True))


def cosine(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    x, y = x / np.abs(x).max(1, keepdims=True), y / np.abs(y).max(1, keepdims=True)
    return (x * y).sum(1) / (np.sqrt((x * x).sum(1)) * np.sqrt((y * y).sum(1)))


def hadamard(x: np.ndarray) -> np.ndarray:
    n, d = x.shape
    h = 1
    while h < d:
        a, b = x.reshape(n, -1, 2, h)[:, :, 0], x.reshape(n, -1, 2, h)[:, :, 1]
        x = np.stack((a + b, a - b), axis=2).reshape(n, d)
        h *= 2
    return x / np.sqrt(d)


class Hashes:
    """Tables of k cross-polytope hashes each, with further probes."""

    def __init__(self, dim: int, k: int, tables: int, probes: int, seed: int = 42):
        self.dim, self.k, self.tables, self.probes = dim, k, tables, probes
        self.d = 1 << max(3, (dim - 1).bit_length())
        self.signs = np.random.default_rng([seed, dim]).choice([-1.0, 1.0], size=(tables, k, 3, self.d))

    def codes(self, units: np.ndarray) -> np.ndarray:
        """For each vector and table its own bucket, then those that it asks in."""
        n = len(units)
        x, out = np.zeros((n, self.d)), np.empty((n, self.tables, 1 + self.probes), dtype=np.int64)
        x[:, : self.dim] = units
        for t in range(self.tables):
            base, cost, move = np.zeros(n, dtype=np.int64), [], []
            for j in range(self.k):
                y = x
                for s in self.signs[t, j]:
                    y = hadamard(y * s)
                near = np.argsort(-np.abs(y), axis=1, kind="stable")[:, : 1 + self.probes]
                at = np.take_along_axis(y, near, 1)
                axis = (2 * near + (at < 0)) * (2 * self.d) ** j
                base += axis[:, 0]
                cost.append(np.abs(at[:, :1]) - np.abs(at[:, 1:]))
                move.append(axis[:, 1:] - axis[:, :1])
            cheap = np.argsort(np.concatenate(cost, 1), axis=1, kind="stable")[:, : self.probes]
            out[:, t, 0] = base
            out[:, t, 1:] = base[:, None] + np.take_along_axis(np.concatenate(move, 1), cheap, 1)
        return out


def meet(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """By table, whether one of two vectors asks or stands where the other stands, as two arrays: at x's, at y's bucket."""
    return np.stack(((x[..., :1] == y).any(-1), (y[..., :1] == x).any(-1)), -1)


def planned(dim: int, n: int, least: float, miss: float, sample: int = 2048) -> Hashes:
    """Hashes for n vectors: k so that there are as many buckets as vectors; probes and tables of the fewest rows with
    which pairs at the least cosine are missed with probability `miss`, by the rate measured on random pairs."""
    d = 1 << max(3, (dim - 1).bit_length())
    k = min(max(1, ceil(log(max(n, 2)) / log(2 * d))), int(60 / log(2 * d, 2)))
    rng = np.random.default_rng(7)
    x = rng.normal(size=(sample, max(dim, 2)))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    z = rng.normal(size=x.shape)
    z -= (z * x).sum(1, keepdims=True) * x
    y = least * x + np.sqrt(max(0.0, 1 - least * least)) * z / np.linalg.norm(z, axis=1, keepdims=True)
    best = None
    for probes in (1, 2, 3):
        h = Hashes(max(dim, 2), k, 4, probes)
        rate = float(np.clip(meet(h.codes(x), h.codes(y)).any(-1).mean(), 1 / sample, 1 - 1 / sample))
        tables = max(1, ceil(log(miss) / log(1 - rate)))
        if best is None or tables * (1 + probes) < best[0]:
            best = (tables * (1 + probes), tables, probes)
    return Hashes(dim, k, best[1], best[2])


def vectors(column: pa.Array, dim: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(-1, dim)


def standing(hashes: dict[int, Hashes]):
    """For mapInArrow: (node, label, dim, embedding) becomes (label, dim, node, t, code, probe) for every bucket of a class."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            dims = b.column("dim").to_numpy()
            for dim in np.unique(dims):
                part, h = b.filter(pa.array(dims == dim)), hashes[int(dim)]
                codes = h.codes(unit(vectors(part.column("embedding"), int(dim))))
                each = h.tables * (1 + h.probes)
                keys = part.select(["label", "dim", "node"]).take(pa.array(np.repeat(np.arange(len(codes)), each)))
                t = np.tile(np.repeat(np.arange(h.tables, dtype=np.int32), 1 + h.probes), len(codes))
                probe = np.tile(np.arange(1 + h.probes) > 0, len(codes) * h.tables)
                yield pa.RecordBatch.from_arrays([*keys.columns, pa.array(t), pa.array(codes.ravel()), pa.array(probe)], names=["label", "dim", "node", "t", "code", "probe"])

    return run


def whole_groups(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[pa.Table, np.ndarray]]:
    """Tables of whole groups of rows sorted by (bucket, b1, b2), with the number of each row's group."""
    held: list[pa.RecordBatch] = []
    for b in batches:
        if not b.num_rows:
            continue
        new = changes(b)
        if held and (new.size or key_of(held[-1], -1) != key_of(b, 0)):
            cut = 0 if key_of(held[-1], -1) != key_of(b, 0) else int(new[0])
            done = pa.Table.from_batches([*held, b.slice(0, cut)])
            yield done, numbered(done)
            held = []
            b = b.slice(cut)
            new = new[new > cut] - cut
        if not held and new.size:
            done = pa.Table.from_batches([b.slice(0, int(new[-1]))])
            yield done, numbered(done)
            b = b.slice(int(new[-1]))
        held.append(b)
    if held:
        done = pa.Table.from_batches(held)
        yield done, numbered(done)


GROUP = ["bucket", "b1", "b2"]


def changes(rows) -> np.ndarray:
    """Places of rows that begin another group than the row before."""
    keys = [rows.column(c).to_numpy() for c in GROUP]
    return np.flatnonzero(np.any([k[1:] != k[:-1] for k in keys], axis=0)) + 1


def key_of(rows: pa.RecordBatch, at: int) -> tuple:
    at %= rows.num_rows
    return tuple(rows.column(c)[at].as_py() for c in GROUP)


def numbered(rows: pa.Table) -> np.ndarray:
    out = np.zeros(rows.num_rows, dtype=np.int64)
    out[changes(rows)] = 1
    return out.cumsum()


def candidate_pairs(units: np.ndarray, group: np.ndarray, least: float) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Pairs i < j of rows of one group with a cosine of about `least` or more, a bounded number at a time."""
    starts = np.flatnonzero(np.diff(group, prepend=-1))
    sizes = np.diff(starts, append=len(group))
    small = np.flatnonzero(np.repeat(sizes <= SMALL, sizes))
    held = group[small]
    for apart in range(1, SMALL):
        at = np.flatnonzero(held[apart:] == held[:-apart])
        if not at.size:
            break
        for k in range(0, len(at), PAIRS // 8):
            i, j = small[at[k : k + PAIRS // 8]], small[at[k : k + PAIRS // 8] + apart]
            near = np.einsum("ij,ij->i", units[i], units[j]) >= least - NEAR
            yield i[near], j[near]
    for start, size in zip(starts[sizes > SMALL], sizes[sizes > SMALL], strict=True):
        rows = max(1, PAIRS // size)
        for at in range(start, start + size, rows):
            i, j = np.nonzero(units[at : min(at + rows, start + size)] @ units[at : start + size].T >= least - NEAR)
            yield i[i < j] + at, j[i < j] + at


def unite(root: np.ndarray, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """Roots after the rows i and j are joined; a root is the least row of its tree."""
    while True:
        a, b = root[i], root[j]
        if (a == b).all():
            return root
        np.minimum.at(root, np.maximum(a, b), np.minimum(a, b))
        while (root[root] != root).any():
            root = root[root]


def linked(hashes: dict[int, Hashes], least: float):
    """For mapInArrow: sorted members of buckets become (node, links, root): how many vectors a class links with by pairs
    that count here, and a class that it is connected with."""

    def counted(h: Hashes, x: np.ndarray, group: np.ndarray, at: dict[str, np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
        units, links, root, codes = unit(x), np.zeros(len(x), dtype=np.int64), np.arange(len(x)), {}
        for i, j in candidate_pairs(units, group, least):
            one = at["b1"][i] == at["b2"][i]
            keep = (one | (at["block"][i] != at["block"][j])) & ~(at["probe"][i] & at["probe"][j])
            i, j = i[keep], j[keep]
            c = np.einsum("ij,ij->i", units[i], units[j])
            edge = np.flatnonzero(np.abs(c - least) <= NEAR)
            c[edge] = cosine(x[i[edge]], x[j[edge]])
            i, j = i[c >= least], j[c >= least]
            if not i.size:
                continue
            rows, place = np.unique(np.concatenate((i, j)), return_inverse=True)
            mine = h.codes(units[rows])
            a, b = mine[place[: len(i)]], mine[place[len(i) :]]
            met, t = meet(a, b), at["t"][i]
            earlier = (met.any(-1) & (np.arange(h.tables) < t[:, None])).any(-1)
            n = np.arange(len(i))
            here = np.where(met[n, t], np.stack((a[n, t, 0], b[n, t, 0]), -1), np.iinfo(np.int64).max).min(-1)
            first = ~earlier & (here == at["code"][i])
            i, j = i[first], j[first]
            links += np.bincount(i, at["size"][j], len(x)).astype(np.int64) + np.bincount(j, at["size"][i], len(x)).astype(np.int64)
            root = unite(root, i, j)
        return links, root

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows, group in whole_groups(batches):
            dims = rows.column("dim").to_numpy()
            for dim in np.unique(dims):
                mine = np.flatnonzero(dims == dim)
                part = rows.take(pa.array(mine)).combine_chunks()
                at = {c: part.column(c).to_numpy() for c in ("node", "size", "t", "code", "probe", "block", "b1", "b2")}
                links, root = counted(hashes[int(dim)], vectors(part.column("embedding").combine_chunks(), int(dim)), group[mine], at)
                some = np.flatnonzero(links)
                yield pa.RecordBatch.from_arrays([pa.array(at["node"][some]), pa.array(links[some]), pa.array(at["node"][root[some]])], names=["node", "links", "root"])

    return run


def usable(v: Column) -> Column:
    """Whether a vector can link: not null, not zero, all components finite numbers."""
    bad = F.exists(v, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    return F.coalesce(~bad & F.exists(v, lambda x: x != 0), F.lit(False))


def link_classes(classes: DataFrame, hashes: dict[int, Hashes], least: float) -> DataFrame:
    """node, links, root of the classes (node, label, dim, size, embedding) that link, from each bucket that finds a pair first."""
    label = classes.schema["label"].dataType
    kind = label.simpleString()
    where = ["label", "dim", "t", "code"]
    rows = materialise(classes.select("node", "label", "dim", "embedding").mapInArrow(standing(hashes), f"label {kind}, dim int, node long, t int, code long, probe boolean"))
    full = rows.groupBy(*where).agg(F.count("*").alias("n"), F.count_if(~F.col("probe")).alias("own")).where("n > 1 and own > 0")
    buckets = materialise(full.select(*where, "n", F.monotonically_increasing_id().alias("bucket")))
    members = rows.join(buckets, where).drop("label", "dim").join(classes.select("node", "dim", "size", "embedding"), "node")
    blocks = F.ceil(F.col("n") / F.lit(BLOCK)).cast("int")
    dealt = members.withColumn("block", F.pmod(F.xxhash64("node"), blocks).cast("int")).select("*", F.explode(F.sequence(F.lit(0), blocks - 1)).alias("other"))
    dealt = dealt.withColumns({"b1": F.least("block", "other"), "b2": F.greatest("block", "other")}).drop("other", "n")
    return dealt.repartition(*GROUP).sortWithinPartitions(*GROUP, "node").mapInArrow(linked(hashes, least), "node long, links long, root long")


def near_duplicate_vectors(table: DataFrame, *, key="vec_id", vector="embedding", label="label", least: float = 0.98, miss: float = 0.0005) -> DataFrame:
    """vec_id, n_links, component_id, kept for every row."""
    if not 0 < least <= 1:
        raise ValueError("the least cosine is above 0 and at most 1")
    v = F.col(vector)
    rows = table.select(F.col(key).alias("vec_id"), F.col(label).alias("label"), v.alias("embedding"), F.when(usable(v) & F.col(label).isNotNull(), F.struct(F.xxhash64(v).alias("h"), F.xxhash64(F.lit(1), v).alias("g"))).alias("name"))
    same = ["label", "name"]
    classes = rows.where("name is not null").groupBy(*same).agg(F.min("vec_id").alias("first"), F.count("*").alias("size"), F.first("embedding").alias("embedding"))
    classes = materialise(classes.select(*same, "first", "size", "embedding", F.size("embedding").alias("dim"), F.monotonically_increasing_id().alias("node")))
    # one row for each length of vectors
    sizes = classes.groupBy("label", "dim").agg(F.count("*").alias("n")).groupBy("dim").agg(F.max("n").alias("n")).collect()
    found = materialise(link_classes(classes, {r.dim: planned(r.dim, r.n, least, miss) for r in sizes}, least))
    links = found.groupBy("node").agg(F.sum("links").alias("links"))
    comps = connected_components(found.select(F.col("node").alias("a"), F.col("root").alias("b"))).withColumnRenamed("component", "comp")
    named = classes.drop("embedding").join(links, "node", "left").join(comps, "node", "left").withColumn("comp", F.coalesce("comp", "node"))
    least_of = named.groupBy("comp").agg(F.min("first").alias("component_id"))
    known = named.join(least_of, "comp").select(*same, (F.coalesce("links", F.lit(0)) + F.col("size") - 1).alias("n_links"), "component_id")
    out = rows.select("vec_id", *same).join(known, same, "left")
    component = F.when(F.col("n_links").isNull(), F.col("vec_id")).otherwise(F.col("component_id"))
    return out.select("vec_id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), component.alias("component_id"), F.col("vec_id").eqNullSafe(component).alias("kept"))


def op12_near_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicate_vectors(read(spark, sf_dir, "embeddings"))


OP12_SQL = """
with recursive v as (select vec_id, label, embedding::double[] as x from embeddings where label is not null and embedding is not null and len(list_filter(embedding, lambda c: c is null or not isfinite(c))) = 0 and len(list_filter(embedding, lambda c: c <> 0)) > 0),
p as materialized (select a.vec_id as a, b.vec_id as b from v a join v b on a.label = b.label and a.vec_id <> b.vec_id and len(a.x) = len(b.x) where list_cosine_similarity(a.x, b.x) >= 0.98),
r as (select vec_id as a, vec_id as b from v union select r.a, p.b from r join p on r.b = p.a),
c as (select a, min(b) as component_id from r group by a),
n as (select a, count(*) as n_links from p group by a)
select vec_id, coalesce(n_links, 0)::bigint as n_links, coalesce(component_id, vec_id) as component_id, vec_id = coalesce(component_id, vec_id) as kept
from embeddings left join c on c.a = vec_id left join n on n.a = vec_id
"""
