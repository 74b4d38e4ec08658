"""SimHash near-duplicates by the generalised pigeonhole principle.

A 64-bit fingerprint has a bit where over half of the shingle hashes have it. Distinct fingerprints within `bits`
differing bits link. If parts of the 64 bits have thresholds t with sum(t + 1) = bits + 1, two linked fingerprints
differ in at most t bits of some part. Correlated bits are grouped into the same part; the number of parts and the
thresholds come from dynamic programming on estimated probes and candidates, from bit counts over all fingerprints.
Each fingerprint probes every part with its value and the values within t bits of it; hits are verified by bit count.
Only distinct fingerprints are joined, so copies cost nothing; dense groups are joined by stars before any pairs are made.

Defined cases: a null or empty text, or one of blanks only, has fingerprint 0, linked like any other; fewer words than
a shingle form one shingle; equal texts share a fingerprint; a null key is ignored when a component is named (null if
all its keys are null); an empty table gives an empty result. Extra columns are ignored by the query and kept by
`add_fingerprint`.
"""

from itertools import combinations
from typing import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .components import connected_components
from .shared import bucketed, free_names, materialise, read, words
from .shingles import firsts, groups, keep_first, place  # noqa: F401 - keep_first: the documents without near duplicates by sets alone

BATCH = 16_384
#: A candidate costs as much as so many probes: candidates grow with the square of the input.
CANDIDATE = 20


def fingerprint(text: str | None, size: int, seed: int = 42) -> int:
    ws = words(text)
    if not ws:
        return 0
    n = max(1, len(ws) - size + 1)
    ones = np.zeros(64, dtype=np.int64)
    for at in range(0, n, BATCH):
        stop = min(n, at + BATCH)
        part = ws[at : stop + size - 1]
        joined = map(b" ".join, zip(*(part[i:] for i in range(size)), strict=False)) if len(ws) >= size else [b" ".join(ws)]
        h = np.fromiter((xxhash.xxh64_intdigest(x, seed) for x in joined), dtype="<u8", count=stop - at)
        ones += np.unpackbits(h.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
    return int((1 << np.flatnonzero(ones * 2 > n).astype(object)).sum()) if (ones * 2 > n).any() else 0


def add_fingerprint(docs: DataFrame, *, text="text", size: int = 3, out="fp") -> DataFrame:
    """Add the fingerprint as a signed long; a column named as `out` is replaced."""

    def run(it: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for a in it:
            yield pa.array(np.array([fingerprint(x.as_py(), size) for x in a], dtype=np.uint64).view(np.int64), pa.int64())

    return docs.withColumn(out, F.arrow_udf(run, "long")(text))


def bit_counts(fps: DataFrame, col="fp") -> tuple[int, np.ndarray]:
    """The number of fingerprints and how many have bits i and j, from sums that each batch makes of itself."""

    def run(batches):
        total, n = np.zeros((64, 64), dtype=np.int64), 0
        for b in batches:
            m = np.unpackbits(b.column(0).to_numpy(zero_copy_only=False).astype("<i8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").astype(np.float32)
            total += (m.T @ m).astype(np.int64)
            n += len(m)
        i, j = np.indices((64, 64))
        yield pa.RecordBatch.from_arrays([pa.array([*i.ravel(), 64]), pa.array([*j.ravel(), 64]), pa.array([*total.ravel(), n])], names=["i", "j", "n"])

    both, n = np.zeros((64, 64)), 0
    for r in fps.select(col).mapInArrow(run, "i long, j long, n long").groupBy("i", "j").agg(F.sum("n").alias("n")).collect():  # 4097 rows
        if r.i == 64:
            n = r.n
        else:
            both[r.i, r.j] = r.n
    return n, both


def correlated_parts(n: int, both: np.ndarray, m: int) -> list[list[int]]:
    """m parts of about equal width; each grows by the free bit that correlates most with it."""
    p = np.diag(both) / max(n, 1)
    sd = np.sqrt(np.clip(p * (1 - p), 1e-9, None))
    c = np.abs((both / max(n, 1) - np.outer(p, p)) / np.outer(sd, sd))
    free, parts = set(range(64)), []
    for k in range(m):
        width = (64 - sum(map(len, parts))) // (m - k)
        part = [min(free, key=lambda i: (-c[i, list(free)].sum(), i))]
        free.discard(part[0])
        while len(part) < width:
            best = min(free, key=lambda i: (-c[i, part].sum(), i))
            part.append(best)
            free.discard(best)
        parts.append(sorted(part))
    return parts


def estimated_cost(n: int, agree: np.ndarray, part: list[int], t: int) -> float:
    """Probes and candidates of one part with threshold t; bits of two fingerprints agree independently."""
    if t < 0:
        return 0.0
    differ = np.zeros(t + 1)
    differ[0] = 1
    for i in part:
        differ = differ * agree[i] + np.concatenate([[0], differ[:-1]]) * (1 - agree[i])
    probes = sum(len(list(combinations(range(len(part)), k))) for k in range(t + 1))
    return n * probes + CANDIDATE * n * n / 2 * differ.sum()


def allocate(n: int, both: np.ndarray, bits: int) -> list[tuple[list[int], int]]:
    """Parts and their thresholds, of least estimated cost over all numbers of parts up to bits + 1."""
    p = np.diag(both) / max(n, 1)
    agree, best = p * p + (1 - p) ** 2, None
    for m in range(1, bits + 2):
        parts = correlated_parts(n, both, m)
        table = {0: (0.0, [])}  # by sum(t + 1): cost and thresholds of the parts so far
        for part in parts:
            costs = [estimated_cost(n, agree, part, t) for t in range(-1, min(bits, 2) + 1)]
            table = {s: min(((c + costs[t + 1], ts + [t]) for u, (c, ts) in table.items() for t in range(-1, len(costs) - 1) if u + t + 1 == s), default=None) for s in range(bits + 2)}
            table = {s: v for s, v in table.items() if v}
        if bits + 1 in table and (best is None or table[bits + 1][0] < best[0]):
            best = (table[bits + 1][0], [(q, t) for q, t in zip(parts, table[bits + 1][1], strict=True) if t >= 0])
    return best[1]


def signed(mask: int) -> int:
    return mask - (1 << 64) if mask >> 63 else mask


def probes_and_index(fps: DataFrame, bits: int) -> tuple[DataFrame, DataFrame, list]:
    """Rows (a, part, value) of all probes and (b, part, value) of the index, and the plan of parts and thresholds."""
    n, both = bit_counts(fps)
    plan = allocate(n, both, bits)
    index, probe = [], []
    for k, (part, t) in enumerate(plan):
        value = F.col("fp").bitwiseAND(F.lit(signed(sum(1 << i for i in part))))
        flips = [signed(sum(1 << i for i in c)) for r in range(t + 1) for c in combinations(part, r)]
        index.append(F.struct(F.lit(k).alias("part"), value.alias("value")))
        probe += [F.struct(F.lit(k).alias("part"), value.bitwiseXOR(F.lit(f)).alias("value")) for f in flips]
    kept = [c for c in fps.columns if c != "fp"]
    left = fps.select(F.col("fp").alias("a"), *[F.col(c).alias(f"a_{c}") for c in kept], F.inline(F.array(*probe)))
    return left, fps.select(F.col("fp").alias("b"), *[F.col(c).alias(f"b_{c}") for c in kept], F.inline(F.array(*index))), plan


def link_fingerprints(fps: DataFrame, bits: int = 3) -> DataFrame:
    """Pairs a < b of distinct fingerprints (column fp) that differ in at most `bits` bits, each once; where fps has a
    column comp, only pairs of different ones."""
    left, right, plan = probes_and_index(fps, bits)
    x = F.col("a").bitwiseXOR(F.col("b"))
    near = (F.col("a") < F.col("b")) & (F.bit_count(x) <= bits) & F.col("part").eqNullSafe(first_part(plan, x))
    if "comp" in fps.columns:
        near = near & (F.col("a_comp") != F.col("b_comp"))
    return left.join(right, ["part", "value"]).where(near).select("a", "b")


def fingerprint_components(fps: DataFrame, bits: int = 3) -> DataFrame:
    """node, component of the distinct fingerprints that link. Each is first held against the least fingerprint of every
    value that it probes, which joins most of a dense group by one pair for each member; then only pairs that this left
    in different components are looked for, all of them."""
    left, right, _ = probes_and_index(fps, bits)
    heads = right.groupBy("part", "value").agg(F.min("b").alias("b"))
    near = (F.col("a") != F.col("b")) & (F.bit_count(F.col("a").bitwiseXOR(F.col("b"))) <= bits)
    star = materialise(left.join(heads, ["part", "value"]).where(near).select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct())
    comps = connected_components(star)
    named = materialise(fps.join(comps, fps.fp == comps.node, "left").select("fp", F.coalesce("component", "fp").alias("comp")))
    return connected_components(star.union(link_fingerprints(named, bits)))


def first_part(plan: list[tuple[list[int], int]], x: Column) -> Column:
    """The first part by which a pair with difference x is found; a pair is taken from that part only."""
    within = [(k, F.bit_count(x.bitwiseAND(F.lit(signed(sum(1 << i for i in part))))) <= t) for k, (part, t) in enumerate(plan)]
    return F.coalesce(*[F.when(c, F.lit(k)) for k, c in within])


def near_duplicates(docs: DataFrame, *, key="doc_id", text="text", size: int = 3, bits: int = 3) -> DataFrame:
    """doc_id, th (hash of the text), fp, fingerprint (hex), component_id for each document."""
    marked = materialise(add_fingerprint(docs.select(F.col(key).alias("doc_id"), F.col(text).alias("text")), size=size).select("doc_id", "fp", F.xxhash64("text").alias("th")))
    classes = materialise(marked.groupBy("fp").agg(F.min("doc_id").alias("first")))
    comps = fingerprint_components(classes.select("fp"), bits)
    named = classes.join(comps, classes.fp == comps.node, "left").select("fp", "first", F.coalesce("component", "fp").alias("comp"))
    least = named.groupBy("comp").agg(F.min("first").alias("component_id"))
    by_fp = named.join(least, "comp").select("fp", "component_id")
    return marked.join(by_fp, "fp").select("doc_id", "th", "fp", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def first_of_groups(docs: DataFrame, *, key="doc_id", text="text", size: int = 3, bits: int = 3, set_size: int = 5) -> DataFrame:
    """The documents without those that have an earlier near duplicate, all columns kept. Fingerprints within `bits` link,
    as in near_duplicates, and so do sets of `set_size`-word shingles at a similarity of 0.8, of which fingerprints miss
    a part; a group is a component of both kinds of links, and of it the row with the least key stays, null keys last."""
    at, fp = free_names(docs, "_at", "_fp")
    table = bucketed(add_fingerprint(docs, text=text, size=size, out=fp).withColumn(at, place(key, text)), at)
    marked, by_sets = groups(table, at, key=key, text=text, size=set_size, also=F.col(fp))
    by_bits = fingerprint_components(materialise(marked.select(F.col("also").alias("fp")).distinct()), bits)
    of_bits = marked.join(by_bits, marked.also == by_bits.node, "left").select("sh", F.coalesce("component", "also").alias("group")).distinct()
    heads = of_bits.groupBy("group").agg(F.min("sh").alias("a"))
    links = of_bits.join(heads, "group").select("a", F.col("sh").alias("b"))
    comps = connected_components(links.union(by_sets.select(F.col("component").alias("a"), F.col("node").alias("b"))))
    return firsts(table, at, marked, comps, key).select(*docs.columns)


def op3_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(read(spark, sf_dir, "documents")).select("doc_id", "fingerprint", "component_id")
