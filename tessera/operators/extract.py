"""Corpora made from public datasets: which rows of a source are taken, to what split they go, and where they are linked.

An extraction is a filter, an order and targets. Only the first rows of each class matter, so ranks are cut to the target
before anything is shuffled; where a place in a whole class is needed, `sampling.placed` counts it in buckets.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .joins import prefix_guard
from .sampling import ordinal_split, placed

SPLITS = ("train", "val", "test")


def seeded(key: str, seed: int) -> Column:
    """A salted hash of a key, in whose order rows are shuffled."""
    return F.md5(F.concat_ws(":", F.lit(str(seed)), F.col(key).cast("string")).cast("binary"))


@dataclass
class Extraction:
    """What to take of a source: rows whose shorter side is `min_edge` or more (if it has sides) and that are not flagged,
    up to `target` of each class, in the order of the columns `order`, or shuffled by a seed. Splits: 80/10/10 by place in
    the target, or, with `fill`, as many as it says for train, then val, then test; a class is filled on its own."""

    target: int
    min_edge: int = 0
    order: Sequence[str] = ()
    seed: int | None = None
    fill: Mapping[str, int] = field(default_factory=dict)
    flag: str | None = None

    def usable(self, df: DataFrame) -> DataFrame:
        out = df.where(F.least("width", "height") >= self.min_edge) if self.min_edge else df
        return out.where(~F.coalesce(F.col(self.flag).cast("boolean"), F.lit(False))) if self.flag else out

    def split_of(self, place: Column) -> Column:
        if not self.fill:
            return ordinal_split(place, self.target)
        upto, out = 0, None
        for name in SPLITS:
            upto += self.fill.get(name, 0)
            out = F.when(place < upto, name) if out is None else out.when(place < upto, name)
        return out

    def apply(self, df: DataFrame, key: str, label: str = "label") -> DataFrame:
        """The rows that are taken, with their split (in place of a column of that name)."""
        most = sum(self.fill.values()) if self.fill else self.target
        by = [*([seeded(key, self.seed)] if self.seed is not None else []), *self.order, key]
        ranked = self.usable(df).withColumn("_place", F.row_number().over(Window.partitionBy(label).orderBy(*by)) - 1).where(F.col("_place") < most)
        return ranked.withColumn("split", self.split_of(F.col("_place"))).drop("_place")


def resampled(df: DataFrame, key: str, sizes: Mapping[str, int], *, of: str = "train", label: str = "label", seed: int = 42) -> DataFrame:
    """The rows of one split dealt anew in shuffled order, `sizes` of each class to each split and the rest left out; rows
    of the test split are kept as they are, those of others go."""
    tests, upto = [], 0
    for name, n in sizes.items():
        upto += n
        tests.append((upto, name))
    split = reduce(lambda rest, x: F.when(F.col("_place") < x[0], x[1]).otherwise(rest), reversed(tests), F.lit(None).cast("string"))
    ranked = df.where(F.col("split") == of).withColumn("_place", F.row_number().over(Window.partitionBy(label).orderBy(seeded(key, seed), key)) - 1).where(F.col("_place") < upto)
    return ranked.withColumn("split", split).drop("_place").select(*df.columns).unionByName(df.where(F.col("split") == "test"))


def carved(df: DataFrame, key: str, share: float = 0.1, *, label: str = "label", seed: int = 42) -> DataFrame:
    """Labels in small letters; of the train split int(share * n) of each class, first in shuffled order, become val."""
    low = df.withColumn(label, F.lower(label))
    h = low.withColumn("_h", seeded(key, seed))
    p = placed(h.where("split = 'train'"), ["_h", key], [label], bucket=F.substring("_h", 1, 3))
    dealt = p.withColumn("split", F.when(F.col("place") < F.floor(F.col("group_size") * share), "val").otherwise("train"))
    return dealt.select(*df.columns).unionByName(low.where("split <> 'train' or split is null"))


def merged(main: DataFrame, other: DataFrame, key: str, caps: Mapping[str, int], *, label: str = "label", seed: int = 42) -> DataFrame:
    """All of one tree and, of the other, the first rows of each split and class in shuffled order, as many as the split's
    cap says; splits without a cap are taken whole."""
    most, named = max(caps.values(), default=0), F.col("split").isin(*caps)
    limit = F.create_map(*[F.lit(x) for kv in caps.items() for x in kv]) if caps else None
    whole = other.where(~F.coalesce(named, F.lit(False)))
    if limit is None:
        return main.unionByName(whole)
    ranked = other.where(named).withColumn("_r", F.row_number().over(Window.partitionBy("split", label).orderBy(seeded(key, seed), key))).where(F.col("_r") <= most)
    return main.unionByName(whole).unionByName(ranked.where(F.col("_r") <= limit[F.col("split")]).select(*other.columns))


def preferred_side(pairs: DataFrame, model: str, guard: DataFrame, seen: DataFrame, key: str, *, min_edge: int = 400, quota: int = 500, had: int = 0) -> DataFrame:
    """key, content, sha256, width, height of preference pairs (model1, content1, width1, height1 and 2) in which a model
    took part: its own side, the first if both are its. Contents that are empty, seen (sha256), guarded (by the first 16
    digits) or smaller than `min_edge` on their longer side go; one row of each content, up to the quota less those had."""
    side = lambda k: F.struct(*[F.col(f"{c}{k}").alias(c) for c in ("content", "width", "height")])
    mine = pairs.select(key, F.when(F.col("model1") == model, side(1)).when(F.col("model2") == model, side(2)).alias("s")).where("s is not null").select(key, "s.*")
    rows = mine.where((F.octet_length("content") > 0) & (F.greatest("width", "height") >= min_edge)).withColumn("sha256", F.sha2("content", 256))
    new = prefix_guard(rows.join(seen.select("sha256").distinct(), "sha256", "left_anti"), guard)
    first = new.groupBy("sha256").agg(F.min_by(F.struct(key, "content", "width", "height"), key).alias("r")).select("r.*", "sha256")
    return first.orderBy(key).limit(max(0, quota - had)).select(key, "content", "sha256", "width", "height")


def shape_quota(df: DataFrame, label: str, shape: str, order: Sequence[str], per_class: int, shares: Mapping[str, float], had: DataFrame | None = None) -> DataFrame:
    """Rows in order until each class has round(per_class * share) of each shape, 1 at least, counting those that are there
    already (had: label, shape and more columns, a row for each); shapes without a share go."""
    caps = {k: max(1, round(per_class * v)) for k, v in shares.items()}
    cap = F.create_map(*[F.lit(x) for kv in caps.items() for x in kv])
    r = df.where(F.col(shape).isin(*caps)).withColumn("_r", F.row_number().over(Window.partitionBy(label, shape).orderBy(*order))).where(F.col("_r") <= max(caps.values()))
    filled = F.lit(0)
    if had is not None:
        n = had.groupBy(F.col(label).alias("_l"), F.col(shape).alias("_s")).agg(F.count("*").alias("_n"))
        r = r.join(n, F.col(label).eqNullSafe(F.col("_l")) & F.col(shape).eqNullSafe(F.col("_s")), "left")
        filled = F.coalesce("_n", F.lit(0))
    return r.where(F.col("_r") + filled <= cap[F.col(shape)]).select(*df.columns)


def collection_plan(sources: DataFrame, manifest: DataFrame, *, overfetch: float = 1.5, suffix: str = "_holdout") -> DataFrame:
    """key, target, have, todo and budget of each source (key, target): what the manifest's source_key has under the key
    and under its holdout name, what is lacking, and how many rows to ask for: int(todo * overfetch) + 32, none if todo is 0."""
    n = manifest.groupBy(F.regexp_replace("source_key", f"{suffix}$", "").alias("key")).agg(F.count("*").alias("n"))
    todo = F.greatest(F.lit(0), F.col("target") - F.col("have"))
    out = sources.join(n, "key", "left").withColumn("have", F.coalesce("n", F.lit(0))).withColumn("todo", todo)
    return out.select("key", "target", "have", "todo", F.when(F.col("todo") > 0, F.floor(F.col("todo") * overfetch) + 32).otherwise(0).cast("long").alias("budget"))


def links(df: DataFrame, name: Column, order: str, *, splits: Mapping[str, str] | None = None, groups: Sequence[str] = ("split", "label")) -> DataFrame:
    """Add `link`, where a file would be linked to: split/label/<name>_<number in 6 digits>.<suffix in small letters>, numbered
    from 0 in each group and name by `order`; `splits` renames splits first, rows of others go."""
    if splits:
        named = F.create_map(*[F.lit(x) for kv in splits.items() for x in kv])
        df = df.withColumn("source_split", F.col("split")).withColumn("split", F.try_element_at(named, F.col("split"))).where("split is not null")
    rows = df.withColumn("_name", name)
    numbered = placed(rows, [order], [*groups, "_name"])
    suffix = F.lower(F.regexp_extract("path", r"(\.[^./]+)$", 1))
    link = F.concat("split", F.lit("/"), "label", F.lit("/"), F.col("_name"), F.lit("_"), F.lpad(F.col("place").cast("string"), 6, "0"), suffix)
    return numbered.withColumn("link", link).drop("_name", "place", "group_size")


def adapted(train: DataFrame, adaptation: DataFrame) -> DataFrame:
    """Training rows and adaptation rows, one below the other, with the columns that both have, in train's order."""
    both = [c for c in train.columns if c in adaptation.columns]
    return train.select(*both).unionByName(adaptation.select(*both))


def available(df: DataFrame, wanted: Sequence[str]) -> list[str]:
    """The wanted columns that a table has, in its order."""
    return [c for c in df.columns if c in set(wanted)]


def training_rows(manifest: DataFrame, split: str, limit: int = 0, order: str = "path") -> tuple[DataFrame, dict[str, int]]:
    """Rows of a split, the first `limit` in order if that is not 0, and how many each label has; an error if there are none."""
    rows = manifest.where(F.col("split") == split)
    rows = rows.orderBy(order).limit(limit) if limit else rows
    balance = {r.label: r.n for r in rows.groupBy("label").agg(F.count("*").alias("n")).collect()}  # a row for each label
    if not balance:
        raise ValueError(f"no rows of split {split}")
    return rows, balance


def forced(rows: DataFrame, label: str, split: str, root: str) -> DataFrame:
    """Rows of one label, all put to one split, whose paths are under the root unless they are absolute."""
    path = F.when(F.col("path").startswith("/"), F.col("path")).otherwise(F.concat(F.lit(root.rstrip("/") + "/"), F.col("path")))
    return rows.where(F.col("label") == label).withColumns({"split": F.lit(split), "path": path})


def view_box(width: Column, height: Column, anchor: tuple[float, float] | None, *, size: int = 224, least: int = 280) -> Column:
    """The box that a view is cut from, as a struct left, top, right, bottom, native: without an anchor the middle square,
    scaled; with one `size` native pixels at that share of what is over, or the whole, scaled, of an image under `least`."""
    short = F.least(width, height)
    box = lambda left, top, right, bottom, native: F.struct(*[c.cast("int").alias(n) for n, c in (("left", left), ("top", top), ("right", right), ("bottom", bottom))], F.lit(native).alias("native"))
    if anchor is None:
        left, top = F.floor((width - short) / 2), F.floor((height - short) / 2)
        return box(left, top, left + short, top + short, False)
    x, y = (F.bround((side - size) * a) for side, a in ((width, anchor[0]), (height, anchor[1])))
    return F.when(short < least, box(F.lit(0), F.lit(0), width, height, False)).otherwise(box(x, y, x + size, y + size, True))
