r"""Filter interaction audit by subset-zeta transforms.

Each document fails some of up to `MOST` filters; its failures are a bit mask. Masks are counted by part, whole and by
label, in one pass; 2^k counters a part are all that later steps read. A zeta transform (k rounds of additions over the
subset lattice) turns the counters into the number of documents whose mask lies within any set, so the survivors of a
filter set are read at its complement. A step of an order is the difference of two neighbouring sets, whatever came
before within them; a Shapley sum weighs the 2^(k-1) differences of a filter by the orders that pass through them. Nothing
is filtered again for an order, and no order reads the documents.

Filter E of the query asks for the whole table. Its documents are narrowed to (digest, doc_id, part, mask, labels)
rows, counted and written once; the least doc_id of a digest comes from an aggregate, and a document is original if its
(digest, doc_id) is that pair, so a text with very many copies meets in no task.

Defined cases: a null text is empty (it fails A, has no distinct word to lack and no characters to count, and equals
other empty texts); a null part is the empty string, with which an empty part is counted; a null doc_id is neither
smaller nor larger than any, so it neither fails E nor makes another fail, and has no labels; equal doc_ids are not
smaller than each other; repeated rows count as often as they occur; a document is good or toxic if any of its rows in
labels says so; a filter that is null doesn't fail; no documents give no rows. Extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Sequence
from itertools import permutations
from math import factorial

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .shared import UPPER, WORD, materialise, read

#: Orders grow as the factorial, counters as the power of 2.
MOST = 8


def zeta_round(counts: str, bit: int) -> Column:
    """Counters by mask, with those of the mask without the bit added to each mask that has it."""
    return F.transform(counts, lambda x, m: x + F.when(m.bitwiseAND(F.lit(bit)) != 0, F.get(F.col(counts), m - bit)).otherwise(0)).alias(counts)


def lattice(masks: DataFrame, k: int, sums: Sequence[str]) -> DataFrame:
    """part and, for each count column of the rows (part, mask, counts), the array of its sums over subsets of each mask."""
    by_mask = masks.groupBy("part").agg(*[F.array(*[F.coalesce(F.sum(F.when(F.col("mask") == m, F.col(c))), F.lit(0).cast("long")) for m in range(1 << k)]).alias(c) for c in sums])
    for i in range(k):
        by_mask = by_mask.select("part", *[zeta_round(c, 1 << i) for c in sums])
    return by_mask


def steps_of(within: DataFrame, names: str, labels: Sequence[str]) -> DataFrame:
    """part, filter_order, step and the counts of each step of every order, from sums over subsets (columns all and labels)."""
    k, full = len(names), (1 << len(names)) - 1
    orders = F.explode(F.array(*[F.lit("".join(p)) for p in permutations(names)]))
    rows = within.select("*", orders.alias("filter_order")).select("*", F.explode(F.sequence(F.lit(1), F.lit(k))).alias("step"))
    bit = lambda at: F.call_function("shiftleft", F.lit(1), F.call_function("locate", F.substring("filter_order", at, F.lit(1)), F.lit(names)) - 1)
    before = F.aggregate(F.sequence(F.lit(1), F.lit(k)), F.lit(0), lambda acc, i: acc + F.when(i < F.col("step"), bit(i)).otherwise(0))
    rows = rows.select("*", before.alias("before"), bit(F.col("step")).alias("bit"))
    left = lambda c, s: F.get(c, F.lit(full) - s)  # noqa: E731  survivors of a set of filters
    lost = lambda c, s, f: left(c, s) - left(c, s + f)
    removed = lost("all", F.col("before"), F.col("bit"))
    weight = [factorial(bin(s).count("1")) * factorial(k - 1 - bin(s).count("1")) if bin(s).count("1") < k else 0 for s in range(full + 1)]
    through = F.aggregate(F.sequence(F.lit(0), F.lit(full)), F.lit(0).cast("long"), lambda acc, s: acc + F.when(s.bitwiseAND(F.col("bit")) != 0, F.lit(0)).otherwise(F.get(F.array(*map(F.lit, weight)), s) * lost("all", s, F.col("bit"))))
    alone = left("all", F.lit(full) - F.col("bit")) - left("all", F.lit(full))  # whose mask is within the filter alone, less those that fail none
    return rows.select(
        "part", "filter_order", F.col("step").cast("int").alias("step"), left("all", F.col("before") + F.col("bit")).alias("kept"), removed.alias("removed"), (lost("all", F.lit(0), F.col("bit")) - removed).alias("redundant"),
        alone.alias("unique_fails"), *[lost(c, F.col("before"), F.col("bit")).alias(f"{c}_lost") for c in labels], through.alias("shapley"),
    )


def audit_masks(masks: DataFrame, names: str, labels: Sequence[str] = ()) -> DataFrame:
    """The audit of rows (part, mask, all, labels): how many documents of a part fail just the filters of a mask (bit i
    for names[i], one letter each), whole and by label."""
    if not 1 <= len(set(names)) == len(names) <= MOST:
        raise ValueError(f"one to {MOST} filters of different letters")
    return steps_of(lattice(masks, len(names), ["all", *labels]), names, labels)


def mask_of(failures: Sequence[Column]) -> Column:
    return sum((F.when(f, F.lit(1 << i)).otherwise(0) for i, f in enumerate(failures)), F.lit(0))


def audit_filters(docs: DataFrame, failures: dict[str, Column], *, part: Column, labels: dict[str, Column] | None = None) -> DataFrame:
    """The audit of filters given as failure conditions of a row, by part; labels are conditions of a row too."""
    labels = labels or {}
    rows = docs.select(F.coalesce(part.cast("string"), F.lit("")).alias("part"), mask_of(list(failures.values())).alias("mask"), *[F.coalesce(c, F.lit(False)).alias(n) for n, c in labels.items()])
    masks = rows.groupBy("part", "mask").agg(F.count("*").alias("all"), *[F.count_if(F.col(n)).alias(n) for n in labels])
    return audit_masks(masks, "".join(failures), list(labels))


def text_failures(text: Column) -> list[Column]:
    """Conditions A to D of a text: few words, repeated words, capitals, marks."""
    blank = text
    for x in "\t\n\x0b\x0c\r":  # replacing bytes is far cheaper than splitting at a pattern
        blank = F.replace(blank, F.lit(x), F.lit(" "))
    words = F.array_remove(F.split(blank, " "), "")
    n = F.size(words)
    # a text of fewer than 50 words may still repeat them, so no condition stands in for another
    return [n < 50, F.size(F.array_distinct(words)) * 100 < n * 65, F.regexp_count(text, F.lit("[A-Z]")) * 100 > F.char_length(text) * 5, text.rlike(r"[#$%&*|]")]


def audit_texts(docs: DataFrame, labels: DataFrame, *, key="doc_id", text="text", part="source") -> DataFrame:
    """The audit of filters A to D on texts and E, an equal text with a smaller key, by part, with label columns quality and toxic."""
    body = F.coalesce(F.col(text), F.lit(""))
    narrow = docs.select(F.col(key).alias("doc_id"), F.coalesce(F.col(part).cast("string"), F.lit("")).alias("part"), mask_of(text_failures(body)).alias("mask"), F.unhex(F.sha2(body, 256)).alias("digest"))
    marks = labels.groupBy("doc_id").agg(F.max(F.col("quality") == 1).alias("good"), F.max(F.col("toxic") == 1).alias("toxic"))
    rows = narrow.join(marks, "doc_id", "left").groupBy("digest", "doc_id", "part", "mask", "good", "toxic").agg(F.count("*").alias("n"))
    rows = materialise(rows)
    first = rows.where("doc_id is not null").groupBy("digest").agg(F.min("doc_id").alias("doc_id")).withColumn("original", F.lit(True))
    marked = rows.join(first, ["digest", "doc_id"], "left")  # by both: copies of one text are dealt by their ids
    copy = F.col("original").isNull() & F.col("doc_id").isNotNull()
    n = lambda c: F.sum(F.when(c, F.col("n")).otherwise(0))
    masks = marked.groupBy("part", (F.col("mask") + F.when(copy, 16).otherwise(0)).alias("mask")).agg(F.sum("n").alias("all"), n(F.col("good")).alias("good"), n(F.col("toxic")).alias("toxic"))
    return audit_masks(masks, "ABCDE", ["good", "toxic"])


def op11_filter_interactions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return audit_texts(read(spark, sf_dir, "documents"), read(spark, sf_dir, "labels"))


OP11_SQL = r"""
with t as (select doc_id, coalesce(source, '') as part, coalesce(text, '') as x, list_filter(regexp_split_to_array(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda w: w <> '') as w from documents),
l as (select doc_id, max((coalesce(quality, 0) = 1)::int) as good, max((coalesce(toxic, 0) = 1)::int) as toxic from labels group by doc_id),
f as (select part, x, t.doc_id, coalesce(good, 0) as good, coalesce(toxic, 0) as toxic, len(w) < 50 as a, 100 * len(list_distinct(w)) < 65 * len(w) as b,
    100 * len(regexp_extract_all(x, '[A-Z]')) > 5 * length(x) as c, regexp_matches(x, '[#$%&*|]') as d, coalesce(t.doc_id > min(t.doc_id) over (partition by x), false) as e
    from t left join l on l.doc_id = t.doc_id),
m as (select part, (a::int + 2 * b::int + 4 * c::int + 8 * d::int + 16 * e::int) as mask, count(*) as n, sum(good) as good, sum(toxic) as toxic from f group by all),
i as (select unnest(['A', 'B', 'C', 'D', 'E']) as f),
o as (select a.f || b.f || c.f || d.f || e.f as filter_order from i a, i b, i c, i d, i e where len(list_distinct([a.f, b.f, c.f, d.f, e.f])) = 5),
s as (select filter_order, step, 1 << (ascii(filter_order[step]) - 65) as bit, coalesce(list_sum(list_transform(range(1, step), lambda k: 1 << (ascii(filter_order[k]) - 65))), 0)::bigint as earlier from o, (select unnest([1, 2, 3, 4, 5]) as step)),
r as (select part, filter_order, step, bit, sum(case when mask & (earlier | bit) = 0 then n else 0 end) as kept, sum(case when mask & earlier = 0 and mask & bit <> 0 then n else 0 end) as removed,
    sum(case when mask & earlier <> 0 and mask & bit <> 0 then n else 0 end) as redundant, sum(case when mask = bit then n else 0 end) as unique_fails,
    sum(case when mask & earlier = 0 and mask & bit <> 0 then good else 0 end) as good_lost, sum(case when mask & earlier = 0 and mask & bit <> 0 then toxic else 0 end) as toxic_lost from m, s group by all)
select part, filter_order, step::int as step, kept::bigint as kept, removed::bigint as removed, redundant::bigint as redundant, unique_fails::bigint as unique_fails, good_lost::bigint as good_lost, toxic_lost::bigint as toxic_lost,
    (sum(removed) over (partition by part, bit))::bigint as shapley from r
"""
