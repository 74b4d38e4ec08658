"""Hard negatives by a vector-approximation file.

A vector is read as integers, floor(scale * x); a score is the integer inner product with an anchor. The approximation
file holds, for each row, the cell of each dimension in one byte: 256 cells, whose borders are quantiles over all rows;
the least and largest value of a cell bound a component. The bounds of a row are looked up by cell, and the bounds of its
score follow: positive components of the anchor take the upper ends, negative ones the lower ends. Two scans follow:

1. Positives: rows whose upper bound reaches the k-th best lower bound or exact score so far are scored exactly.
2. Negatives: each positive gives a window of scores. Rows that may lie in it, by their bounds, and whose upper bound
   reaches the k-th best of those that surely do, are scored exactly.

Bounds only pass rows over, so results are exact. Anchors are taken in batches of `ANCHORS`, which every task of a scan
gets whole; a task holds its best rows of each anchor and emits no others. Scans are as many as batches of anchors.

Defined cases: rows with a null key, a null label, a null vector or a null, NaN or infinite component take no part; of
rows that share a key the one of the least (label, integers) counts; vectors of another length than the anchor's are
not scored for it; an anchor without positives gives no rows, and a positive whose window holds nothing gives none;
scores beyond a long raise an error before anything is scored; an empty table gives an empty result; extra columns are
ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce
from math import ceil

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .shared import materialise, read

CELLS = 256
#: Anchors of one scan; pairs whose bounds, and components of pairs whose exact scores, are held at once in a task.
ANCHORS, PAIRS, EXACT = 8192, 1 << 20, 1 << 22


class Cells:
    """Borders of each dimension's cells, and the least and largest value of each cell."""

    def __init__(self, quantiles: list[list[int]], least: list[int], largest: list[int]):
        self.borders = [np.unique(np.array(q, dtype=np.int64)) for q in quantiles]
        self.low, self.high = (np.zeros((len(quantiles), CELLS), dtype=np.float64) for _ in range(2))
        for d, b in enumerate(self.borders):
            self.low[d, : len(b) + 1] = [least[d], *b]
            self.high[d, : len(b) + 1] = [*(b - 1), largest[d]]

    def of(self, q: np.ndarray) -> np.ndarray:
        return np.stack([np.searchsorted(b, q[:, d], side="right") for d, b in enumerate(self.borders)], 1).astype(np.uint8) if q.shape[1] else np.zeros(q.shape, np.uint8)


def integers(column: pa.Array, n: int, dim: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.int64).reshape(n, dim)


def by_dim(batch: pa.RecordBatch) -> Iterator[tuple[int, pa.RecordBatch]]:
    dims = batch.column("dim").to_numpy()
    for dim in np.unique(dims):
        yield int(dim), batch.filter(pa.array(dims == dim))


def approximated(cells: dict[int, Cells]):
    """For mapInArrow: rows with their cells, a byte for each dimension."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for dim, b in by_dim(batch):
                c = cells[dim].of(integers(b.column("q"), b.num_rows, dim))
                yield pa.RecordBatch.from_arrays([*b.columns, pa.array([r.tobytes() for r in c], pa.binary())], names=[*b.schema.names, "cells"])

    return run


def approximation_file(rows: DataFrame) -> tuple[DataFrame, dict[int, Cells]]:
    """The rows (id, label, q, dim) with their cells, written, and the cells of each length of vectors."""
    at = [i / CELLS for i in range(1, CELLS)]
    ends = rows.select("dim", F.posexplode("q").alias("d", "v")).groupBy("dim", "d").agg(F.min("v").alias("least"), F.max("v").alias("largest"), F.percentile_approx("v", at, 10_000).alias("quantiles"))
    by: dict[int, list] = {r.dim: [] for r in rows.select("dim").distinct().collect()}
    for r in ends.orderBy("dim", "d").collect():  # one row for each dimension
        by[r.dim].append(r)
    for dim, rs in by.items():
        if sum(max(abs(r.least), abs(r.largest)) ** 2 for r in rs) >= 1 << 63:
            raise ValueError(f"scores of vectors of {dim} components do not fit a long")
    cells = {dim: Cells([r.quantiles for r in rs], [r.least for r in rs], [r.largest for r in rs]) for dim, rs in by.items()}
    return materialise(rows.mapInArrow(approximated(cells), "id long, label long, q array<long>, dim int, cells binary")), cells


def best(group: np.ndarray, score: np.ndarray, ident: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Indices of the first k of each group, higher scores first, then smaller ids; and the place of each in its group."""
    order = np.lexsort((ident, -score, group))
    g = group[order]
    place = np.arange(len(g)) - np.searchsorted(g, g)
    return order[place < k], place[place < k]


class Best:
    """The first k of each of n groups so far, and from which score on a row may still enter."""

    def __init__(self, n: int, k: int):
        self.k, self.bar = k, np.full(n, -np.inf)
        self.group, self.score, self.ident = (np.zeros(0, dtype=np.int64) for _ in range(3))

    def raised(self, group: np.ndarray, lower: np.ndarray) -> np.ndarray:
        """The bar of each group, after lower bounds of different rows that surely belong to them."""
        keep, place = best(group, lower, group, self.k)
        last = keep[place == self.k - 1]
        bar = self.bar.copy()
        np.maximum.at(bar, group[last], lower[last])
        return bar

    def add(self, group: np.ndarray, score: np.ndarray, ident: np.ndarray) -> None:
        g, s, i = np.concatenate((self.group, group)), np.concatenate((self.score, score)), np.concatenate((self.ident, ident))
        keep, place = best(g, s, i, self.k)
        self.group, self.score, self.ident = g[keep], s[keep], i[keep]
        last = place == self.k - 1
        self.bar[self.group[last]] = self.score[last]


class Anchors:
    """Anchors of one length: ids, labels and integers."""

    def __init__(self, rows: list, dim: int):
        self.ids, self.labels = np.array([r.id for r in rows], dtype=np.int64), np.array([r.label for r in rows], dtype=np.int64)
        self.q = np.array([r.q for r in rows], dtype=np.int64).reshape(len(rows), dim)
        self.up, self.down = np.maximum(self.q, 0).astype(np.float64), np.maximum(-self.q, 0).astype(np.float64)


class Chunk:
    """Rows of one length with the ends of their cells, looked up."""

    def __init__(self, b: pa.RecordBatch, cells: Cells, dim: int):
        self.ids, self.labels, self.q = b.column("id").to_numpy(), b.column("label").to_numpy(), integers(b.column("q"), b.num_rows, dim)
        c = np.frombuffer(b"".join(b.column("cells").to_pylist()), dtype=np.uint8).reshape(b.num_rows, dim)
        d = np.arange(dim)
        self.low, self.high = cells.low[d, c], cells.high[d, c]
        #: doubles may round beyond 2^53; bounds give way by more than that
        self.slack = np.maximum(np.abs(self.low), np.abs(self.high)).max(initial=0) * 2.0**-44

    def bounds(self, a: Anchors, of: slice) -> tuple[np.ndarray, np.ndarray]:
        """Lower and upper bounds of the scores of all rows with some anchors."""
        up, down = a.up[of], a.down[of]
        give = ((up + down).sum(1) * self.slack)[:, None]
        return up @ self.low.T - down @ self.high.T - give, up @ self.high.T - down @ self.low.T + give

    def exact(self, a: Anchors, i: np.ndarray, j: np.ndarray) -> np.ndarray:
        out, step = np.empty(len(i), dtype=np.int64), max(1, EXACT // max(1, self.q.shape[1]))
        for k in range(0, len(i), step):
            out[k : k + step] = np.einsum("ij,ij->i", a.q[i[k : k + step]], self.q[j[k : k + step]])
        return out


def chunks(batches: Iterator[pa.RecordBatch], cells: dict[int, Cells], anchors: dict[int, Anchors]) -> Iterator[tuple[int, Chunk, slice]]:
    """Chunks of rows with slices of the anchors of the same length, as many pairs as may be held."""
    for batch in batches:
        for dim, b in by_dim(batch):
            if dim in anchors:
                for at in range(0, b.num_rows, 4096):
                    chunk = Chunk(b.slice(at, 4096), cells[dim], dim)
                    for i in range(0, len(anchors[dim].ids), PAIRS // 4096):
                        yield dim, chunk, slice(i, i + PAIRS // 4096)


def positives(cells: dict[int, Cells], sent, k: int):
    """For mapInArrow: anchor, id, score of the best k rows of an anchor's label in this part of the file."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        anchors = sent.value
        state = {dim: Best(len(a.ids), k) for dim, a in anchors.items()}
        for dim, c, of in chunks(batches, cells, anchors):
            a, s = anchors[dim], state[dim]
            low, high = c.bounds(a, of)
            own = (a.labels[of, None] == c.labels) & (a.ids[of, None] != c.ids)
            low[~own] = -np.inf
            if low.shape[1] >= k:
                s.bar[of] = np.maximum(s.bar[of], np.partition(low, -k, axis=1)[:, -k])
            i, j = np.nonzero(own & (high >= s.bar[of, None]))
            i += of.start
            s.add(i, c.exact(a, i, j), c.ids[j])
        for dim, s in state.items():
            yield pa.RecordBatch.from_arrays([pa.array(anchors[dim].ids[s.group]), pa.array(s.ident), pa.array(s.score)], names=["anchor", "id", "score"])

    return run


class Windows:
    """Windows of scores of the anchors of one length: those of anchor i are from `first[i]` up to `first[i + 1]`."""

    def __init__(self, a: Anchors, found: list, low: int, high: int):
        place = {int(x): i for i, x in enumerate(a.ids)}
        rows = sorted((place[r.anchor], r.place, r.id, r.score, -(-low * r.score // 100), high * r.score // 100) for r in found if r.anchor in place)
        rows = [r for r in rows if r[4] <= r[5]]
        self.anchor, _, self.positive, self.score, self.low, self.high = (np.array([r[c] for r in rows], dtype=np.int64) for c in range(6))
        self.first = np.searchsorted(self.anchor, np.arange(len(a.ids) + 1))

    def reach(self, bar: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
        """For each anchor the least score that still matters to any of its windows, and the largest."""
        least, most = np.full(n, np.inf), np.full(n, -np.inf)
        np.minimum.at(least, self.anchor, np.maximum(bar, self.low))
        np.maximum.at(most, self.anchor, self.high)
        return least, most


def negatives(cells: dict[int, Cells], sent, k: int):
    """For mapInArrow: the best k rows of other labels in each window, in this part of the file."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        anchors, windows = sent.value
        state = {dim: Best(len(w.anchor), k) for dim, w in windows.items()}
        for dim, c, of in chunks(batches, cells, anchors):
            a, w, s = anchors[dim], windows[dim], state[dim]
            low, high = c.bounds(a, of)
            least, most = w.reach(s.bar, len(a.ids))
            i, j = np.nonzero((a.labels[of, None] != c.labels) & (high >= least[of, None]) & (low <= most[of, None]))
            l, h = low[i, j], high[i, j]
            i += of.start
            n = w.first[i + 1] - w.first[i]  # each pair with each window of its anchor
            pair = np.repeat(np.arange(len(i)), n)
            g = w.first[i][pair] + np.arange(len(pair)) - np.repeat(n.cumsum() - n, n)
            may = (h[pair] >= np.maximum(w.low[g], s.bar[g])) & (l[pair] <= w.high[g])
            pair, g = pair[may], g[may]
            sure = (l[pair] >= w.low[g]) & (h[pair] <= w.high[g])
            bar = s.raised(g[sure], l[pair[sure]])
            may = h[pair] >= bar[g]
            pair, g = pair[may], g[may]
            every, back = np.unique(pair, return_inverse=True)
            score = c.exact(a, i[every], j[every])[back]
            in_it = (score >= w.low[g]) & (score <= w.high[g])
            s.add(g[in_it], score[in_it], c.ids[j[pair[in_it]]])
        for dim, s in state.items():
            w = windows[dim]
            cols = (anchors[dim].ids[w.anchor[s.group]], w.positive[s.group], w.score[s.group], s.ident, s.score)
            yield pa.RecordBatch.from_arrays([pa.array(x) for x in cols], names=["anchor_id", "positive_id", "positive_score", "negative_id", "negative_score"])

    return run


def first_of(rows: DataFrame, group: list[str], score: str, ident: str, k: int, out: str) -> DataFrame:
    order = Window.partitionBy(*group).orderBy(F.desc(score), ident)
    return rows.withColumn(out, F.row_number().over(order)).where(F.col(out) <= k)


def anchor_batches(anchors: DataFrame) -> Iterator[dict[int, Anchors]]:
    """The anchors, at most ANCHORS at a time, by length."""
    n = anchors.count()
    dealt = materialise(anchors.repartition(max(1, ceil(n / ANCHORS))).withColumn("at", F.monotonically_increasing_id()))
    batch = (F.shiftright("at", 33) * F.lit(1 << 33) + F.col("at").bitwiseAND(F.lit((1 << 33) - 1)) / F.lit(ANCHORS)).cast("long")
    for b in sorted(r.b for r in dealt.select(batch.alias("b")).distinct().collect()) or [0]:
        rows = dealt.where(batch == b).collect()
        yield {dim: Anchors([r for r in rows if r.dim == dim], dim) for dim in {r.dim for r in rows}}


def mine_hard_negatives(table: DataFrame, anchor: Column, *, key="vec_id", vector="embedding", label: Column | None = None, scale: int = 256, k: int = 5, most: int = 3, low: int = 50, high: int = 95) -> DataFrame:
    """anchor_id, positive_id, rank, negative_id, positive_score, negative_score: for each anchor (rows that meet a
    condition) and each of its k best rows of the same label, the best `most` rows of other labels that score from
    `low` to `high` per cent of it. Keys and labels are integers."""
    spark, v = table.sparkSession, F.col(vector)
    whole = F.exists(v, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    q = F.transform(v, lambda x: F.floor(x.cast("double") * scale))
    rows = table.select(F.col(key).cast("long").alias("id"), (F.col("label") if label is None else label).cast("long").alias("label"), anchor.alias("anchor"), F.when(~whole, q).alias("q")).where("id is not null and label is not null and q is not null")
    rows = rows.groupBy("id").agg(F.min(F.struct("label", "q", "anchor")).alias("r")).select("id", "r.*", F.size("r.q").alias("dim"))
    rows = materialise(rows)
    chosen = rows.where("anchor").drop("anchor")
    file, cells = approximation_file(rows.drop("anchor"))
    parts = []
    for anchors in anchor_batches(chosen):
        sent = spark.sparkContext.broadcast(anchors)
        top = file.mapInArrow(positives(cells, sent, k), "anchor long, id long, score long")
        found = first_of(top, ["anchor"], "score", "id", k, "place").collect()  # at most k rows an anchor of the batch
        windows = {dim: Windows(a, found, low, high) for dim, a in anchors.items()}
        both = spark.sparkContext.broadcast((anchors, windows))
        rest = file.mapInArrow(negatives(cells, both, most), "anchor_id long, positive_id long, positive_score long, negative_id long, negative_score long")
        parts.append(materialise(first_of(rest, ["anchor_id", "positive_id"], "negative_score", "negative_id", most, "rank")))
        sent.destroy()
        both.destroy()
    return reduce(DataFrame.unionAll, parts).select("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score")


def op13_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label").cast("long") + 1) % 10).otherwise(F.col("label").cast("long"))
    return mine_hard_negatives(read(spark, sf_dir, "embeddings"), F.col("vec_id") % 50 == 0, label=label)


OP13_SQL = """
with v as (select vec_id, case when vec_id % 7 = 0 then (label::bigint + 1) % 10 else label end as label, list_transform(embedding, lambda x: floor(256 * x::double)) as q from embeddings
    where vec_id is not null and label is not null and embedding is not null and len(list_filter(embedding, lambda c: c is null or not isfinite(c))) = 0),
s as (select a.vec_id as a, a.label as al, b.vec_id as b, b.label as bl, coalesce(list_inner_product(a.q, b.q), 0)::bigint as score from v a join v b on a.vec_id % 50 = 0 and a.vec_id <> b.vec_id and len(a.q) = len(b.q)),
p as (select a, b, score from s where al = bl qualify row_number() over (partition by a order by score desc, b) <= 5)
select p.a as anchor_id, p.b as positive_id, (row_number() over (partition by p.a, p.b order by n.score desc, n.b))::int as rank, n.b as negative_id, p.score as positive_score, n.score as negative_score
from p join s n on n.a = p.a and n.al <> n.bl and 50 * p.score <= 100 * n.score and 100 * n.score <= 95 * p.score
qualify rank <= 3
"""
