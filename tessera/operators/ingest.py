"""Ingest specs compiled to Column expressions: value resolution, filters, label and generator maps, quarantine."""

from collections.abc import Mapping, Sequence
from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def class_name(value: Column, names: Sequence[str]) -> Column:
    """A class number as its name; out of range as its digits; null as ''."""
    known = F.try_element_at(F.array(*[F.lit(n) for n in names]), (value + 1).cast("int"))
    return F.when(value.isNull(), "").when((value >= 0) & (value < len(names)), known).otherwise(value.cast("string"))


@dataclass
class SourceSpec:
    """What to take of a source and what to call it. Columns that the source lacks compare as null."""

    key: str
    where: Mapping[str, Sequence[str]] = field(default_factory=dict)
    where_not: Mapping[str, Sequence[str]] = field(default_factory=dict)
    label_column: str | None = None
    label_map: Mapping[str, str] = field(default_factory=dict)
    generator_column: str | None = None
    generator_map: Mapping[str, str] = field(default_factory=dict)
    rendition_column: str | None = None
    rendition_map: Mapping[str, str] = field(default_factory=dict)
    holdout_when: Mapping[str, Sequence[str]] = field(default_factory=dict)
    class_names: Mapping[str, Sequence[str]] = field(default_factory=dict)
    extra_fields: Sequence[str] = ()
    holdout_suffix: str = "_holdout"

    def columns(self) -> list[str]:
        """What the spec reads, for pruning a source with no static schema."""
        named = [c for c in (self.label_column, self.generator_column, self.rendition_column) if c]
        return sorted({*self.where, *self.where_not, *self.holdout_when, *self.extra_fields, *named})

    def value(self, df: DataFrame, column: str) -> Column:
        if column not in df.columns:
            return F.lit(None).cast("string")
        if column in self.class_names:
            return class_name(F.col(column), self.class_names[column])
        return F.coalesce(F.col(column).cast("string"), F.lit(""))

    def matches(self, df: DataFrame) -> Column:
        """Allowlists first, then denylists; an absent column fails the former and passes the latter."""
        tests = [F.coalesce(self.value(df, c).isin(*v), F.lit(False)) for c, v in self.where.items()]
        tests += [~F.coalesce(self.value(df, c).isin(*v), F.lit(False)) for c, v in self.where_not.items()]
        return reduce(lambda a, b: a & b, tests, F.lit(True))

    def mapped(self, df: DataFrame, column: str | None, mapping: Mapping[str, str]) -> Column | None:
        if not column:
            return None
        m = F.create_map(*[F.lit(x) for kv in mapping.items() for x in kv])
        return F.try_element_at(m, self.value(df, column))

    def apply(self, df: DataFrame) -> DataFrame:
        """Rows that match and whose mapped values are all known, with label, generator, rendition, holdout, extras and source_key."""
        out = df.where(self.matches(df))
        maps = {"label": (self.label_column, self.label_map), "generator": (self.generator_column, self.generator_map), "rendition": (self.rendition_column, self.rendition_map)}
        new = {k: v for k, (c, m) in maps.items() if (v := self.mapped(df, c, m)) is not None}
        for v in new.values():
            out = out.where(v.isNotNull())
        held = reduce(lambda a, b: a | b, [F.coalesce(self.value(df, c).isin(*v), F.lit(False)) for c, v in self.holdout_when.items()], F.lit(False))
        extras = F.array_compact(F.array(*[F.when(self.value(df, c) != "", F.struct(F.lit(c).alias("k"), self.value(df, c).alias("v"))) for c in self.extra_fields])) if self.extra_fields else None
        new |= {"holdout": held, "source_key": F.when(held, self.key + self.holdout_suffix).otherwise(self.key)}
        if extras is not None:
            new["extras"] = F.map_from_entries(extras)
        return out.withColumns(new)

    def unmapped(self, df: DataFrame) -> DataFrame:
        """column, value, n of values that no map knows: what apply() drops, told once each."""
        parts = []
        for c, m in ((self.label_column, self.label_map), (self.generator_column, self.generator_map), (self.rendition_column, self.rendition_map)):
            if c:
                v = self.value(df, c)
                parts.append(df.where(self.matches(df) & self.mapped(df, c, m).isNull()).groupBy(F.lit(c).alias("column"), v.alias("value")).agg(F.count("*").alias("n")))
        return reduce(DataFrame.union, parts)


def first_usable(*candidates: Column) -> Column:
    """The first candidate that is neither null nor empty."""
    return F.coalesce(*[F.when(F.octet_length(c) > 0, c) for c in candidates])


def label_polarity(value: Column, source: Column, zero_is_real: Sequence[str]) -> Column:
    """0 is real in the named sources, 1 is real in all others."""
    return F.when(F.when(source.isin(*zero_is_real), value == 0).otherwise(value == 1), "real").otherwise("fake")


def minimum_edge(source: Column, low: Sequence[str]) -> Column:
    return F.when(source.isin(*low), 32).otherwise(512)


#: Spellings of architectures and the names they go by.
ARCHITECTURES = {"gan": "gan", "latdiff": "latent_diffusion", "latent diffusion": "latent_diffusion", "pixdiff": "pixel_diffusion", "pixel diffusion": "pixel_diffusion", "commercial": "commercial"}


def architecture(value: Column, label: Column, default: str | None = None) -> Column:
    """The known name of an architecture; real images are 'real'; others the default (null)."""
    m = F.create_map(*[F.lit(x) for kv in ARCHITECTURES.items() for x in kv])
    return F.when(label == "real", "real").otherwise(F.coalesce(F.try_element_at(m, F.lower(F.trim(value))), F.lit(default)))


def within_resolution(width: Column, height: Column, low: int | None = None, high: int | None = None) -> Column:
    side = F.least(width, height)
    return (side >= low if low is not None else F.lit(True)) & (side <= high if high is not None else F.lit(True))


def family(generator: Column, keys: Sequence[str], label: Column) -> Column:
    """real, modern (a key occurs in the generator's name) or legacy."""
    return F.when(label == "real", "real").when(reduce(lambda a, b: a | b, [F.contains(F.lower(generator), F.lit(k)) for k in keys]), "modern").otherwise("legacy")
