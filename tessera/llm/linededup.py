r"""Line dedup by an exact set-similarity join (DataFrame functions only).

A line is the set of its lower-cased words; lines without words are left alone, and those of fewer than `least` words
too (1, which is none, in the query and in the pipeline). A line goes if an earlier line, in the order of (key, text
hash, position), has a Jaccard similarity of 0.8 or more. Lines that are equal but for case form a class, named by a
64-bit hash; only classes are joined, so copies of a line make no pairs. Hashes of words (32 bits, one for each different
word) only lead to candidates: words that share a hash make more of them, none is lost, and every pair that removes a
line is compared by the words of the lines themselves.

1. A class holds its first line, its hashed words and their parity bits, in a table bucketed by class. Words of a line
   are told apart by 64 bits there. They are counted in 2^17 hash buckets over all classes; a word's rarity is the
   logarithm of its bucket's count, in quarters.
2. Heads: each class is compared with the likelier of the first classes that share its least and its greatest word
   hash. Most members of large groups of near copies are settled here, by one comparison each.
3. Prefix join: classes share a word among the n - ceil(0.8 n) + 1 rarest of their words; pairs pass the positional,
   length and parity filters, at least one side is not settled yet, and the rest is verified on the lines.

Defined cases: a null text has no lines and stays null; an empty text has one empty line; a null key sorts first; rows
that agree in key and text are one document that occurs twice, and share all decisions; an empty table gives an empty
result. Extra columns are kept by `remove_repeated_lines` and `with_removed`, whose own column takes a longer name where
they have its name; they are ignored by the query.
"""

from __future__ import annotations

import uuid
from functools import reduce
from operator import or_

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .shared import free_names, materialise, read, release

BUCKETS = 1 << 17
BLANKS = "\t\x0b\x0c\r"
MANY = 0x7FFF  # sizes are held at this beside the parity, which only lets more pairs through
FREE = 0xFFFF  # bits of parity.y that hold no cells
NARROW = 72  # sets of so many words and fewer are told apart by x alone, and their y is 0


def split_words(line: Column) -> Column:
    """The words of a lower-cased line, repeats and empty strings included."""
    plain = line
    for blank in BLANKS:  # replacing bytes is far cheaper than splitting at a pattern, and looking for them than replacing
        plain = F.replace(plain, F.lit(blank), F.lit(" "))
    blanks = reduce(or_, (F.contains(line, F.lit(blank)) for blank in BLANKS))
    return F.split(F.when(blanks, plain).otherwise(line), " ")


def words_of(line: Column) -> Column:
    """The words of a lower-cased line, repeats included."""
    return F.array_remove(split_words(line), "")


def hashes_of(line: Column) -> Column:
    """A hash of 32 bits for each different word of a lower-cased line. Words are told apart by 64 bits, since numbers
    are made distinct far faster than strings."""
    wide = F.array_remove(F.array_distinct(F.transform(split_words(line), lambda x: F.xxhash64(x))), F.xxhash64(F.lit("")))
    return F.transform(wide, lambda x: F.hash(x))


def parity(w: Column) -> Column:
    """Two numbers: x has for each of 64 cells the parity of the number of words that fall to it, y in its upper 48 bits
    that of the words of a cell whose next bit is set. `differing` makes 112 cells of them: two sets differ in at least
    as many words as these."""
    flips = lambda one: F.aggregate(w, F.lit(0).cast("long"), lambda acc, v: acc.bitwiseXOR(F.call_function("shiftleft", one(v), v)))
    return F.struct(flips(lambda v: F.lit(1).cast("long")).alias("x"), flips(lambda v: F.shiftright(v, 6).bitwiseAND(F.lit(1)).cast("long")).bitwiseAND(F.lit(~FREE).cast("long")).alias("y"))


def lines_of(docs: DataFrame, key: str, text: str, least: int) -> DataFrame:
    """c (class), doc_id, th (hash of the text), pos, line (lower-cased) for each line that is long enough for `least` words."""
    hashed = docs.select(F.col(key).alias("doc_id"), F.xxhash64(F.col(text)).alias("th"), F.split(F.col(text), "\n").alias("lines"))  # once a text
    rows = hashed.select("doc_id", "th", F.posexplode("lines").alias("pos", "line"))
    rows = rows.where(F.octet_length("line") >= 2 * least - 1)
    return rows.select("doc_id", "th", "pos", F.lower("line").alias("line")).withColumn("c", F.xxhash64("line"))


def rarity(classes: DataFrame) -> Column:
    """Four times log2 of the count of a word's bucket over all classes, as a table of BUCKETS small numbers."""
    counts = classes.select(F.explode("w").alias("w")).groupBy(F.col("w").bitwiseAND(F.lit(BUCKETS - 1)).alias("b")).agg(F.count("*").alias("n"))
    table = [0] * BUCKETS
    for b, rank in counts.select("b", F.floor(F.log2("n") * 4).cast("int")).collect():  # BUCKETS rows at most
        table[b] = rank
    return F.split(F.lit(",".join(map(str, table))), ",").cast("array<bigint>")  # folded to one constant array


def rarest(words: Column, table: Column, most: Column) -> Column:
    """The `most` rarest words, rarest first, hashes breaking ties; the low 32 bits of each number are the word's hash."""
    rank = lambda w: F.get(table, w.bitwiseAND(F.lit(BUCKETS - 1)))
    # numbers that cannot be null are sorted as such, not as objects
    return F.slice(F.sort_array(F.transform(words, lambda w: F.coalesce(F.shiftleft(rank(w), 33) + w, F.lit(0).cast("long")))), F.lit(1), most)


def enough(common: Column, n: Column, m: Column) -> Column:
    """Jaccard >= 4/5 for sets of n and m words."""
    return common * 9 >= (n + m) * 4


def differing(b: Column, d: Column) -> Column:
    y = b["y"].bitwiseXOR(d["y"])
    return F.bit_count(b["x"].bitwiseXOR(d["x"]).bitwiseXOR(y)) + F.bit_count(y)


def packed(b: Column, n: Column, open: Column) -> list[Column]:
    """Columns x and y: the parity, with the set's size and whether it is open (0 or 1) in the free bits of y."""
    return [b["x"].alias("x"), b["y"].bitwiseOR(F.shiftleft(F.least(n, F.lit(MANY)), 1) + open).alias("y")]


def size_of(y: Column) -> Column:
    return F.shiftright(y.bitwiseAND(F.lit(FREE).cast("long")), 1)


def apart(x: Column, y: Column, u: Column, v: Column) -> Column:
    """`differing` on packed columns: by x alone, which has all words, if one set is narrow."""
    d = F.when(F.least(size_of(y), size_of(v)) > NARROW, y.bitwiseXOR(v).bitwiseAND(F.lit(~FREE).cast("long"))).otherwise(F.lit(0).cast("long"))
    return F.bit_count(x.bitwiseXOR(u).bitwiseXOR(d)) + F.bit_count(d)


def may_match(x: Column, y: Column, u: Column, v: Column) -> Column:
    """Length filter and parity filter on packed columns: sets within Jaccard 4/5 differ in at most (n + m) / 9 words."""
    n, m = size_of(y), size_of(v)
    return (F.least(n, m) * 5 >= F.greatest(n, m) * 4) & (apart(x, y, u, v) * 9 <= n + m)


class Classes:
    """The classes of all lines, in a table bucketed by class: c, o (first line), line (lower-cased), w (a hash for each
    different word), n (their number), b (parity, y 0 up to NARROW words), lo and hi (least and greatest of w); those of fewer than `least` words
    are not read; drop() removes it."""

    def __init__(self, lines: DataFrame, least: int):
        self.spark, self.least, self.name = lines.sparkSession, least, f"tessera_classes_{uuid.uuid4().hex}"
        parts = int(self.spark.conf.get("spark.sql.shuffle.partitions"))
        first = lines.groupBy("c").agg(F.min(F.struct("doc_id", "th", "pos", "line")).alias("o"))
        hashed = first.select("c", F.struct("o.doc_id", "o.th", "o.pos").alias("o"), "o.line", hashes_of(F.col("o.line")).alias("w"))
        cells = parity(F.col("w"))
        b = F.struct(cells["x"].alias("x"), F.when(F.size("w") > NARROW, cells["y"]).otherwise(F.lit(0).cast("long")).alias("y"))
        out = hashed.withColumns({"n": F.size("w"), "b": b, "lo": F.array_min("w"), "hi": F.array_max("w")}).write.bucketBy(parts, "c").sortBy("c").option("compression", "zstd")
        # lines and classes are all different: no dictionary holds them, one of words does
        out.options(**{"parquet.compression.codec.zstd.level": 1, "parquet.dictionary.page.size": 4 << 20, "parquet.enable.dictionary#line": "false", "parquet.enable.dictionary#c": "false"}).saveAsTable(self.name)

    @property
    def rows(self) -> DataFrame:
        return self.spark.table(self.name).where(F.col("n") >= self.least)

    def drop(self) -> None:
        self.spark.sql(f"DROP TABLE IF EXISTS {self.name}")

    def verified(self, pairs: DataFrame) -> DataFrame:
        """The classes that have an earlier similar one among the pairs (columns a, b, distinct), by the words of both lines."""
        one = self.rows.select(F.col("c").alias("a"), F.col("o").alias("ao"), F.col("line").alias("al"), F.col("n").alias("an"))
        two = self.rows.select(F.col("c").alias("b"), F.col("o").alias("bo"), F.col("line").alias("bl"), F.col("n").alias("bn"))
        common = F.size(F.array_intersect(words_of(F.col("al")), words_of(F.col("bl"))))  # an intersection has no repeats
        # pairs are narrow and few beside lines, which stream past them unsorted; the second join can spill, since one head
        # may have very many pairs and these hold lines
        near = two.join(one.join(pairs.hint("shuffle_hash"), "a").hint("merge"), "b").where(enough(common, F.col("an"), F.col("bn")))
        return near.select(F.when(F.col("ao") > F.col("bo"), F.col("a")).otherwise(F.col("b")).alias("c")).distinct()


def head_pairs(classes: DataFrame) -> DataFrame:
    """For each class the likeliest of two earlier ones: classes of the least key with its least or its greatest word hash."""
    narrow = classes.select("c", F.col("o.doc_id").alias("d"), *packed(F.col("b"), F.col("n"), F.lit(0)), F.explode(F.array("lo", "hi")).alias("s"))
    # numbers alone, so that they are aggregated by hash; all take the same row, since they see the same ones in turn
    heads = narrow.groupBy("s").agg(*[F.min_by(k, "d").alias(f"h{k}") for k in ("c", "x", "y")])
    both = [F.col(k) for k in ("x", "y", "hx", "hy")]
    pairs = narrow.select("c", "x", "y", "s").join(heads, "s").where((F.col("c") != F.col("hc")) & may_match(*both))
    return pairs.groupBy(F.col("c").alias("a")).agg(F.min_by("hc", apart(*both)).alias("b"))


def prefix_pairs(classes: DataFrame, settled: DataFrame, table: Column) -> DataFrame:
    """Pairs of classes that pass the prefix, positional, length and parity filters, one of them not settled."""
    marked = classes.join(settled.select("c", F.lit(0).alias("open")), "c", "left").withColumn("open", F.coalesce("open", F.lit(1)))
    n = F.col("n")
    prefix = rarest(F.col("w"), table, n - F.floor((n * 4 + 4) / 5).cast("int") + 1)
    word = F.shiftright(F.shiftleft("t", 32), 32).cast("int").alias("t")
    rows = marked.select("c", *packed(F.col("b"), n, F.col("open")), F.posexplode(prefix).alias("k", "t")).select(word, "c", "x", "y", "k")
    l, r = rows.alias("l"), rows.alias("r")
    either = F.col("l.y").bitwiseOR(F.col("r.y")).bitwiseAND(F.lit(1)) == 1
    # the cheap conditions first: they settle most pairs
    n, m = size_of(F.col("l.y")), size_of(F.col("r.y"))
    position = (F.greatest(n, m) == MANY) | (F.least(n - F.col("l.k"), m - F.col("r.k")) * 9 >= (n + m) * 4)
    near = either & position & may_match(*map(F.col, ("l.x", "l.y", "r.x", "r.y")))
    return l.join(r, (F.col("l.t") == F.col("r.t")) & (F.col("l.c") < F.col("r.c")) & near).select(F.col("l.c").alias("a"), F.col("r.c").alias("b")).distinct()


def repeated_lines(docs: DataFrame, *, key="doc_id", text="text", least: int = 1) -> DataFrame:
    """doc_id, th, removed (sorted positions of the lines that go) for each document that loses any."""
    lines = lines_of(docs, key, text, least)
    classes = Classes(lines, least)
    try:
        release(classes.spark)  # the lines
        settled = materialise(classes.verified(head_pairs(classes.rows)))
        table = rarity(classes.rows)
        release(classes.spark)  # heads and counts
        late = materialise(settled.union(classes.verified(prefix_pairs(classes.rows, settled, table))).distinct())
        release(classes.spark)  # prefixes
        first = materialise(classes.rows.select("c", "o").join(late.select("c", F.lit(1).alias("late")), "c", "left"))
    finally:
        classes.drop()
    mine = lines.select("c", F.struct("doc_id", "th", "pos").alias("mine"))
    gone = mine.join(first, "c").where(F.col("late").isNotNull() | (F.col("mine") != F.col("o"))).select("mine.*")
    return gone.groupBy("doc_id", "th").agg(F.array_sort(F.collect_set("pos")).alias("removed"))


def with_removed(docs: DataFrame, *, key="doc_id", text="text", least: int = 1, out="removed") -> DataFrame:
    """The documents with a column (`out`, lengthened if they have it) of the sorted positions of lines that go, null where none does."""
    out, k, th, mine = free_names(docs, out, "_id", "_th", "_mine")
    gone = materialise(repeated_lines(docs, key=key, text=text, least=least)).withColumnsRenamed({"doc_id": k, "th": th, "removed": out})
    rows = docs.withColumn(mine, F.xxhash64(F.col(text)))
    same = (F.col(mine) == F.col(th)) & F.col(key).eqNullSafe(F.col(k))
    return rows.join(gone.hint("merge"), same, "left").drop(k, th, mine)  # the same join at every size


def remove_repeated_lines(docs: DataFrame, *, key="doc_id", text="text", least: int = 1) -> DataFrame:
    """The documents with the lines that repeat an earlier one removed from their text."""
    (gone,) = free_names(docs, "_removed")
    kept = F.array_join(F.filter(F.split(F.col(text), "\n"), lambda x, i: ~F.array_contains(F.col(gone), i)), "\n")
    out = with_removed(docs, key=key, text=text, least=least, out=gone)
    return out.withColumn(text, F.when(F.col(gone).isNotNull(), kept).otherwise(F.col(text))).drop(gone)


def op10_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents").select("doc_id", "text")
    narrow = docs.select("doc_id", F.xxhash64("text").alias("th"), F.coalesce(F.octet_length("text") - F.octet_length(F.replace("text", F.lit("\n"), F.lit(""))) + 1, F.lit(0)).alias("n_lines"))
    gone = repeated_lines(docs).withColumnsRenamed({"doc_id": "_id", "th": "_th"})
    out = narrow.join(gone, F.col("doc_id").eqNullSafe(F.col("_id")) & (F.col("th") == F.col("_th")), "left")
    return out.select("doc_id", F.col("n_lines").cast("long"), F.coalesce(F.size("removed"), F.lit(0)).cast("long").alias("n_removed"), F.coalesce(F.array_join(F.transform("removed", lambda x: x.cast("string")), ","), F.lit("")).alias("removed"))


OP10_SQL = r"""
with l as (select doc_id, unnest(str_split(text, chr(10))) as line, generate_subscripts(str_split(text, chr(10)), 1) - 1 as pos from documents),
t as (select doc_id, pos, list_sort(list_distinct(list_filter(regexp_split_to_array(lower(line), '[\x20\x09-\x0D]+'), lambda x: x <> ''))) as w from l),
s as (select w, len(w) as n, min((doc_id, pos)) as o, row_number() over () as c from t where len(w) >= 1 group by w),
d as (select x, count(*) as df from (select unnest(w) as x from s) group by x),
p as (select c, n, o, x, row_number() over (partition by c order by df, x) as k from (select c, n, o, unnest(w) as x from s) join d using (x)),
q as (select * from p where k <= n - ceil(n * 4 / 5.0) + 1),
pairs as (select distinct a.c as a, b.c as b from q a join q b on a.x = b.x and a.o < b.o and least(a.n, b.n) * 5 >= greatest(a.n, b.n) * 4),
late as (select distinct b from pairs join s x on x.c = a join s y on y.c = b where len(list_intersect(x.w, y.w)) * 9 >= (x.n + y.n) * 4),
gone as (select t.doc_id, t.pos from t join s on t.w = s.w left join late on late.b = s.c where late.b is not null or (t.doc_id, t.pos) <> s.o),
g as (select doc_id, count(*) as n_removed, string_agg(pos::varchar, ',' order by pos) as removed from gone group by doc_id)
select d.doc_id, coalesce(len(str_split(d.text, chr(10))), 0)::bigint as n_lines, coalesce(n_removed, 0)::bigint as n_removed, coalesce(removed, '') as removed
from documents d left join g using (doc_id)
"""
