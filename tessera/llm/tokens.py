"""Exact token counts of byte-level BPE at every prefix of a text, by dynamic programming.

A text is split into pieces by the vocabulary's rule; merges never cross a piece. Inside a piece the count at byte i comes
from the only token t that can end the encoding of the first i bytes: t ends there, and (last token before t, t) stays
two tokens when encoded together; then count[i] = count[i - len(t)] + 1. `PrefixTable` holds the counts at all piece
boundaries, and those inside a piece as they are asked for; the count of a text is its last entry, and truncation and
budget questions are answered from the table without encoding the text again. The last entries of pieces are remembered
by each worker. Texts with characters on which pattern engines may differ (outside Latin letters and common signs) are
split by the library's own splitter.

Defined cases: a null or empty text has 0 bytes and 0 tokens; special strings count as the library's default counts
them (one token, no merge across them; a prefix that ends inside one has it as plain text); a file with a normalizer,
another splitter or another model is refused; an empty table gives an empty result; nulls elsewhere and extra columns do
not matter, but a column named as `out` is replaced.
"""

import json
import os
from bisect import bisect_right
from functools import lru_cache
from itertools import accumulate
from typing import Iterator

import ahocorasick
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .shared import read

PATTERN = regex.compile(r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+""")
#: Characters whose class every engine agrees on.
PLAIN = regex.compile(r"[\t-\r\x20-\x7e\xa1-\xac\xae-ɏ‐-―‘-‟•…€™]*")
#: A boundary for certain: one space between two other characters.
CUT = regex.compile(r"(?<=\S) (?=\S)")
BLANKS = regex.compile(r"[\t-\r\x20\x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]*")
PART, KNOWN, SHORT = 1_000_000, 1_200_000, 64  #: characters split at once; pieces remembered, of so many characters at most


def byte_letters() -> dict[int, str]:
    """The letters that stand for bytes in byte-level vocabularies: printable Latin-1 stands for itself, others follow from U+0100."""
    own = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in own]
    return {b: chr(b) for b in own} | {b: chr(256 + i) for i, b in enumerate(rest)}


class Totals(dict):
    """Token counts of whole pieces: the last entries of their prefix counts."""

    def __init__(self, counter):
        super().__init__()
        self.counter = counter

    def __missing__(self, piece: str) -> int:
        n = 1 if piece in self.counter.special else self.counter.prefix_counts(piece.encode("utf-8", "surrogatepass"))[-1]
        if len(self) >= KNOWN:
            self.clear()
        if len(piece) <= SHORT:
            self[piece] = n
        return n


class TokenCounter:
    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.library = Tokenizer.from_file(path)
        spec = json.loads(self.library.to_str())
        rule, model = spec["pre_tokenizer"] or {}, spec["model"]
        if spec["normalizer"] or (rule.get("type"), rule.get("add_prefix_space"), rule.get("use_regex", True)) != ("ByteLevel", False, True):
            raise ValueError(f"{path}: not split as plain byte-level BPE is")
        if model["type"] != "BPE" or model["dropout"] or model["continuing_subword_prefix"] or model["end_of_word_suffix"] or model.get("ignore_merges"):
            raise ValueError(f"{path}: not plain byte-level BPE")
        if any(t["lstrip"] or t["rstrip"] or t["single_word"] or t["normalized"] for t in spec["added_tokens"]):
            raise ValueError(f"{path}: special strings that take their surroundings along")
        back = {c: b for b, c in byte_letters().items()}
        self.special = {t["content"] for t in spec["added_tokens"]}
        self.split = regex.compile("(" + "|".join(map(regex.escape, sorted(self.special, key=len, reverse=True))) + ")") if self.special else None
        merges = [m if isinstance(m, list) else m.split(" ") for m in model["merges"]]
        to_bytes = lambda s: bytes(back[c] for c in s)
        self.ranks = {(to_bytes(a), to_bytes(b)): i for i, (a, b) in enumerate(merges)}
        vocab = {to_bytes(t) for t in model["vocab"] if all(c in back for c in t)}
        self.longest = max(map(len, vocab))
        self.ends = ahocorasick.Automaton()  # finds the tokens that end at each byte
        for t in vocab:
            self.ends.add_word(t.decode("latin-1"), t)
        self.ends.make_automaton()
        self.totals = Totals(self)
        self.apart = lru_cache(200_000)(self._apart)

    def _apart(self, a: bytes, b: bytes) -> bool:
        """Whether a then b, encoded together, stay these two tokens."""
        parts = [bytes([x]) for x in a + b]
        while len(parts) > 1:
            rank, i = min((self.ranks.get(p, 1 << 60), i) for i, p in enumerate(zip(parts, parts[1:], strict=False)))
            if rank == 1 << 60:
                break
            parts[i : i + 2] = [parts[i] + parts[i + 1]]
        return parts == [a, b]

    def prefix_counts(self, piece: bytes) -> list[int]:
        """Token counts of all byte prefixes of one piece."""
        count, last = [0] * (len(piece) + 1), [b""] * (len(piece) + 1)
        for end, t in self.ends.iter(piece.decode("latin-1")):
            i = end + 1
            if not count[i] and (i == len(t) or self.apart(last[i - len(t)], t)):
                count[i], last[i] = count[i - len(t)] + 1, t
        return count

    def _plain_pieces(self, text: str) -> Iterator[list[str]]:
        at, plain = 0, PLAIN.fullmatch(text)
        while at < len(text):
            far = len(text) - at > PART and CUT.search(text, at + PART)
            stop = far.start() if far else len(text)
            yield PATTERN.findall(text, at, stop) if plain else [text[at + i : at + j] for _, (i, j) in self.library.pre_tokenizer.pre_tokenize_str(text[at:stop])]
            at = stop

    def pieces(self, text: str) -> Iterator[list[str]]:
        """Lists of pieces, of about PART characters at a time; a special string is a piece of its own."""
        if self.split is None or not any(s in text for s in self.special):
            yield from self._plain_pieces(text)
            return
        for part in self.split.split(text):
            if part in self.special:
                yield [part]
            elif part:
                yield from self._plain_pieces(part)

    def count(self, text: str | None) -> int:
        return sum(sum(map(self.totals.__getitem__, p)) for p in self.pieces(text or ""))


class PrefixTable:
    """Exact token counts of all prefixes of a text, as the library counts each prefix by itself.

    With `keep`, boundaries are held only as far as answers for budgets up to it need them.
    """

    def __init__(self, counter: TokenCounter, text: str, keep: int | None = None):
        self.counter, self.text, self.total = counter, text, 0
        self.pieces, self.ends, self.sums = [], [], []
        for part in counter.pieces(text):
            counts = list(map(counter.totals.__getitem__, part))
            if keep is None or self.total <= keep:
                self.pieces += part
                self.ends += list(accumulate(map(len, part), initial=self.ends[-1] if self.ends else 0))[1:]
                self.sums += list(accumulate(counts, initial=self.total))[1:]
            self.total += sum(counts)

    def count(self, chars: int) -> int:
        """Tokens of text[:chars]. Only the last pieces before the cut can differ from the whole text's."""
        k = bisect_right(self.ends, chars)
        if k and k < len(self.pieces) and self.pieces[k] in self.counter.special and self.pieces[k - 1] not in self.counter.special:
            k -= 1  # what stands before a special string may join its first signs
        while k and (BLANKS.fullmatch(self.pieces[k - 1]) or k < len(self.pieces) and self.pieces[k - 1] == "'"):
            k -= 1
        start = self.ends[k - 1] if k else 0
        return (self.sums[k - 1] if k else 0) + self.counter.count(self.text[start:chars])

    def longest(self, budget: int) -> int:
        """Characters of the longest prefix with at most `budget` tokens."""
        if self.total <= budget:
            return len(self.text)
        k = bisect_right(self.sums, budget)
        start, left = (self.ends[k - 1] if k else 0), budget - (self.sums[k - 1] if k else 0)
        piece = self.pieces[k]
        if piece in self.counter.special:
            if inside := next((i for i in range(len(piece) - 1, 0, -1) if self.count(start + i) <= budget), 0):
                return start + inside
        elif not BLANKS.fullmatch(piece):
            # a prefix of so many bytes has more than `left` tokens for certain
            data = piece[: self.counter.longest * (left + 1)]
            inside, at, fits = self.counter.prefix_counts(data.encode("utf-8", "surrogatepass")), 0, []
            for i, c in enumerate(data, 1):
                at += len(c.encode("utf-8", "surrogatepass"))
                if inside[at] <= left and i < len(piece):
                    fits.append(start + i)
            if best := next((i for i in reversed(fits) if not BLANKS.fullmatch(self.text[start:i]) and self.count(i) <= budget), 0):
                return best
        # a prefix that ends in blanks has the whole run of them as its last piece, however the text goes on
        a = k
        while a and BLANKS.fullmatch(self.pieces[a - 1]):
            a -= 1
        begin, base = (self.ends[a - 1] if a else 0), (self.sums[a - 1] if a else 0)
        run = BLANKS.match(self.text, begin)[0]
        inside, at, best = self.counter.prefix_counts(run.encode()), 0, begin
        for i, c in enumerate(run, 1):
            at += len(c.encode())
            if base + inside[at] <= budget:
                best = begin + i
        return best


_COUNTERS: dict[str, TokenCounter] = {}


def token_counts(docs: DataFrame, *, path: str, text="text", limit: int = 1024, out="tokens") -> DataFrame:
    """Add a struct column: n_bytes, n_tokens, over_limit and cut_bytes, the bytes of the longest prefix within the limit."""

    def run(it: Iterator[pa.Array]) -> Iterator[pa.Array]:
        c = _COUNTERS.get(path) or _COUNTERS.setdefault(path, TokenCounter(path))
        for a in it:
            n_bytes, n_tokens, cut = [], [], []
            for x in a:
                t = x.as_py() or ""
                table = PrefixTable(c, t, limit)
                size = len(t.encode("utf-8", "surrogatepass"))
                n_bytes.append(size)
                n_tokens.append(table.total)
                cut.append(size if table.total <= limit else len(t[: table.longest(limit)].encode("utf-8", "surrogatepass")))
            yield pa.StructArray.from_arrays([pa.array(n_bytes, pa.int64()), pa.array(n_tokens, pa.int64()), pa.array([n > limit for n in n_tokens], pa.bool_()), pa.array(cut, pa.int64())], names=["n_bytes", "n_tokens", "over_limit", "cut_bytes"])

    return docs.withColumn(out, F.arrow_udf(run, "n_bytes long, n_tokens long, over_limit boolean, cut_bytes long")(text))


def op6_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    docs = read(spark, sf_dir, "documents").select("doc_id", "text")
    out = token_counts(docs, path=public_tokenizers.path("byte_bpe_50k.json"))
    return out.select("doc_id", "tokens.n_bytes", "tokens.n_tokens", "tokens.over_limit", "tokens.cut_bytes")
