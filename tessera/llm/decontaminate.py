"""Benchmark decontamination by pigeonhole edit matching.

Texts are lower-cased and their blanks folded to single spaces. An item of n characters has an error budget of
floor(rate * n) edits and is split into one piece more than that; a text within the budget contains a piece exactly.
One Aho-Corasick pass over a whole text finds all pieces of a block of items; around each hit Myers' bit-parallel
algorithm gives the least edit distance of the item to any stretch of the text. Items come in blocks of at most
`block_chars` characters, one block after the other, each against all documents.

Defined cases: null or empty texts match nothing; null items and those without characters after folding are skipped; an
item too short for an edit must stand exactly and not inside a longer word, where its script sets words apart; items
with a null id are found under it; repeated items match under each id; repeated documents give a row each; empty tables
give no rows. Extra columns are ignored by `find_items` and kept by `decontaminate`. Ids of items are integers or strings.
"""

from collections import defaultdict
from typing import Iterator

import ahocorasick
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from .shared import free_names, read


def fold(text: str | None) -> str:
    return " ".join(text.lower().split()) if text else ""


def split_pieces(item: str, parts: int) -> list[tuple[int, str]]:
    """Offsets and texts of `parts` pieces whose lengths differ by one at most."""
    cuts = [len(item) * i // parts for i in range(parts + 1)]
    return [(a, item[a:b]) for a, b in zip(cuts, cuts[1:], strict=False)]


def char_masks(item: str) -> dict[str, int]:
    masks: dict[str, int] = defaultdict(int)
    for i, c in enumerate(item):
        masks[c] |= 1 << i
    return dict(masks)


def myers(masks: dict[str, int], m: int, text: str) -> tuple[int, int]:
    """Least edit distance of an item of m characters to a stretch of text, and the end of the first such stretch."""
    full, high = (1 << m) - 1, 1 << (m - 1)
    pv, mv, score, best, end = full, 0, m, m, 0
    for i, c in enumerate(text, 1):
        eq = masks.get(c, 0)
        xv = eq | mv
        xh = (((eq & pv) + pv) ^ pv) | eq
        ph = mv | (full & ~(xh | pv))
        mh = pv & xh
        if ph & high:
            score += 1
        elif mh & high:
            score -= 1
            if score < best:
                best, end = score, i
        ph, mh = (ph << 1) & full, (mh << 1) & full
        pv, mv = mh | (full & ~(xv | ph)), ph & xv
    return best, end


def in_word(text: str, at: int) -> bool:
    """Whether a word of a script with blanks goes on from text[at - 1] to text[at]. Thai, Lao, Burmese, Khmer, kana and Han have none."""
    if not 0 < at < len(text):
        return False
    bare = lambda c: "\u0e00" <= c <= "\u0eff" or "\u1000" <= c <= "\u109f" or "\u1780" <= c <= "\u17ff" or "\u2e80" <= c <= "\u9fff" or "\uf900" <= c <= "\ufaff" or c >= "\U00020000"
    return all(c.isalnum() and not bare(c) for c in text[at - 1 : at + 1])


class Matcher:
    """Items of one block, ready to search texts."""

    def __init__(self, items: list[tuple[int, str]], rate: float):
        self.items = [(i, t, int(len(t) * rate), char_masks(t)) for i, t in items]
        pieces = defaultdict(list)
        for k, (_, t, budget, _) in enumerate(self.items):
            for at, p in split_pieces(t, budget + 1):
                pieces[p].append((k, at))
        self.machine = ahocorasick.Automaton()
        for p, where in pieces.items():
            self.machine.add_word(p, (len(p), where))
        if pieces:
            self.machine.make_automaton()
        self.any = bool(pieces)

    def search(self, text: str) -> list[tuple[int, int, int, int]]:
        """item_id, distance, start and stop (in the folded text) of each item within its budget, its best stretch."""
        if not self.any or not text:
            return []
        spans = defaultdict(list)
        for end, (n, where) in self.machine.iter(text):
            for k, at in where:
                spans[k].append(end - n + 1 - at)
        out = []
        for k, starts in spans.items():
            item, t, budget, masks = self.items[k]
            best = (budget + 1, 0, 0)
            if not budget:  # hits are the whole item
                at = next((a for a in sorted(starts) if not in_word(text, a) and not in_word(text, a + len(t))), None)
                if at is not None:
                    out.append((item, 0, at, at + len(t)))
                continue
            for a, b in self._windows(sorted(starts), len(t), budget):
                a = max(0, a)
                part = text[a:b]
                at = part.find(t)
                d, end = (0, at + len(t)) if at >= 0 else myers(masks, len(t), part)
                if d < best[0]:
                    best = (d, max(0, a + end - len(t)), a + end)
            if best[0] <= budget:
                out.append((item, *best))
        return sorted(out, key=lambda h: (h[0] is not None, h[0] or type(h[0] or 0)(), h[1:]))

    @staticmethod
    def _windows(starts: list[int], n: int, budget: int) -> Iterator[tuple[int, int]]:
        """Stretches around hits; hits whose stretches overlap by more than half share one."""
        a = b = None
        for s in starts:
            if a is not None and s <= b + budget:
                b = s
            else:
                if a is not None:
                    yield a - budget, b + n + budget
                a = b = s
        if a is not None:
            yield a - budget, b + n + budget


def is_text(items: DataFrame, key: str) -> bool:
    return isinstance(items.schema[key].dataType, StringType)


def item_blocks(items: DataFrame, *, key="item_id", text="text", block_chars: int = 2_000_000) -> Iterator[list[tuple]]:
    """Folded items, a bounded block at a time."""
    k = F.col(key) if is_text(items, key) else F.col(key).cast("long")
    rows = items.select(k.alias("k"), F.col(text).alias("t")).where("t is not null")
    total = rows.agg(F.sum(F.char_length("t"))).first()[0] or 0
    n = total // block_chars + 1
    for i in range(n):
        block = rows.where(F.pmod(F.xxhash64("k", "t"), F.lit(n)) == i).collect()
        yield sorted(((r.k, t) for r in block if (t := fold(r.t))), key=lambda x: (x[0] is not None, x[0] or type(x[0] or 0)(), x[1]))


def add_hits(docs: DataFrame, block: list[tuple], rate: float, *, text="text", out="hits", text_ids: bool = False) -> DataFrame:
    names = ("item_id", "distance", "start", "stop")
    kind = pa.list_(pa.struct([("item_id", pa.string() if text_ids else pa.int64()), *((x, pa.int32()) for x in names[1:])]))

    def run(it: Iterator[pa.Array]) -> Iterator[pa.Array]:
        m = Matcher(block, rate)
        for a in it:
            yield pa.array([[dict(zip(names, h, strict=True)) for h in m.search(fold(x.as_py()))] for x in a], kind)

    return docs.withColumn(out, F.arrow_udf(run, f"array<struct<item_id: {'string' if text_ids else 'long'}, distance: int, start: int, stop: int>>")(text))


def find_items(docs: DataFrame, items: DataFrame, *, key="doc_id", text="text", rate: float = 0.08) -> DataFrame:
    """doc_id, item_id, distance, start, stop for each document and item within its budget; an item without id has the id null."""
    found = None
    for block in item_blocks(items):
        rows = docs.select(F.col(key).alias("doc_id"), F.col(text).alias("text"))
        hits = add_hits(rows, block, rate, text_ids=is_text(items, "item_id")).select("doc_id", F.inline("hits"))
        found = hits if found is None else found.union(hits)
    return found


def decontaminate(docs: DataFrame, items: DataFrame, *, text="text", rate: float = 0.08) -> DataFrame:
    """The documents in which no item is found, all columns kept."""
    (hits,) = free_names(docs, "_hits")
    for block in item_blocks(items):
        docs = add_hits(docs, block, rate, text=text, out=hits, text_ids=is_text(items, "item_id")).where(F.size(hits) == 0).drop(hits)
    return docs


def op8_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return find_items(read(spark, sf_dir, "documents"), read(spark, sf_dir, "benchmark"))
