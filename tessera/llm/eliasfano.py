"""Elias-Fano sequences and a two-level n-gram trie on them, in memory-mapped arrays."""

from __future__ import annotations

import numpy as np

#: In a byte, the place of its k-th one (low bits first), 8 if it has none.
SELECT = np.full((256, 8), 8, dtype=np.uint8)
for _b in range(256):
    for _k, _i in enumerate(i for i in range(8) if _b >> i & 1):
        SELECT[_b, _k] = _i
ONES = np.array([bin(b).count("1") for b in range(256)], dtype=np.uint8)


#: Bytes of the unary part between two entries of its directories, and selects that are answered at once.
SAMPLE, AT_ONCE = 32, 1 << 15


class EliasFano:
    """A non-decreasing sequence of n numbers: `low` bits of each packed, high parts in unary, with the numbers of ones and
    of zeros before every SAMPLE bytes. All four arrays are what the files hold, so a loaded sequence stays on disk but for
    the pages that are read."""

    def __init__(self, n: int, low_bits: int, low: np.ndarray, high: np.ndarray, ones: np.ndarray, zeros: np.ndarray):
        self.n, self.l, self.low, self.high, self.ones, self.zeros = n, low_bits, low, high, ones, zeros

    @classmethod
    def build(cls, values: np.ndarray) -> EliasFano:
        v = np.asarray(values, dtype=np.uint64)
        n, top = len(v), int(v[-1]) if len(v) else 0
        bits = max(0, (top // max(n, 1)).bit_length() - 1)
        low = (v & np.uint64((1 << bits) - 1))[:, None] >> np.arange(bits, dtype=np.uint64)[None, :] & np.uint64(1)
        packed = np.packbits(low.astype(np.uint8).ravel(), bitorder="little")
        words = np.zeros(len(packed) // 8 + 2, dtype=np.uint64)
        words.view(np.uint8)[: len(packed)] = packed
        unary = np.zeros((top >> bits) + n + 2, dtype=np.uint8)
        unary[(v >> np.uint64(bits)).astype(np.int64) + np.arange(n)] = 1
        high = np.packbits(unary, bitorder="little")
        high = np.concatenate([high, np.zeros(-len(high) % SAMPLE, dtype=np.uint8)])  # whole stretches; zeros after the last one belong to no number
        ones = np.concatenate([[0], np.cumsum(ONES[high].reshape(-1, SAMPLE).sum(1, dtype=np.int64))])
        return cls(n, bits, words, high, ones, 8 * SAMPLE * np.arange(len(ones)) - ones)

    def _low(self, i: np.ndarray) -> np.ndarray:
        if not self.l:
            return np.zeros(len(i), dtype=np.uint64)
        at = i * self.l
        word, off = at >> 6, (at & 63).astype(np.uint64)
        first = self.low[word] >> off
        rest = np.where(off > 0, self.low[word + 1] << (np.uint64(64) - np.maximum(off, np.uint64(1))), np.uint64(0))
        return (first | rest) & np.uint64((1 << self.l) - 1)

    def _select(self, k: np.ndarray, zeros: bool) -> np.ndarray:
        """The place of the k-th one or zero: its stretch by the directory, its byte by counting within the stretch."""
        sums, out = self.zeros if zeros else self.ones, np.empty(len(k), dtype=np.int64)
        stretches = self.high.reshape(-1, SAMPLE)
        for at in range(0, len(k), AT_ONCE):
            part = k[at : at + AT_ONCE]
            stretch = np.searchsorted(sums, part, side="right") - 1
            body = stretches[stretch]
            body = ~body if zeros else body
            upto = ONES[body].cumsum(1, dtype=np.int64)
            left = part - sums[stretch]
            byte = (upto <= left[:, None]).sum(1)
            row = np.arange(len(part))
            before = np.where(byte > 0, upto[row, np.maximum(byte - 1, 0)], 0)
            out[at : at + AT_ONCE] = 8 * (SAMPLE * stretch + byte) + SELECT[body[row, byte], left - before]
        return out

    def get(self, i: np.ndarray) -> np.ndarray:
        i = np.asarray(i, dtype=np.int64)
        high = (self._select(i, False) - i).astype(np.uint64)
        return (high << np.uint64(self.l)) | self._low(i)

    def find(self, x: np.ndarray, start: np.ndarray, stop: np.ndarray) -> np.ndarray:
        """Places of the numbers x among [start, stop), -1 where they are not: the zeros of the unary part bound the
        stretch of equal high parts, low parts are searched inside it."""
        x = np.asarray(x, dtype=np.uint64)
        h = (x >> np.uint64(self.l)).astype(np.int64)
        ok = h < self.zeros[-1] - 1
        h = np.where(ok, h, 0)
        a = np.where(h > 0, self._select(np.maximum(h - 1, 0), True) - np.maximum(h - 1, 0), 0)
        lo, hi = np.maximum(a, start), np.minimum(self._select(h, True) - h, stop)
        want, end = x & np.uint64((1 << self.l) - 1), hi.copy()
        open_ = np.flatnonzero(ok & (lo < hi))
        while len(open_):
            mid = (lo[open_] + hi[open_]) >> 1
            less = self._low(mid) < want[open_]
            lo[open_] = np.where(less, mid + 1, lo[open_])
            hi[open_] = np.where(less, hi[open_], mid)
            open_ = open_[lo[open_] < hi[open_]]
        out = np.full(len(x), -1, dtype=np.int64)
        hit = np.flatnonzero(ok & (lo < end))
        hit = hit[self._low(lo[hit]) == want[hit]]
        out[hit] = lo[hit]
        return out

    def save(self, path: str) -> None:
        np.save(f"{path}.low.npy", self.low)
        np.save(f"{path}.high.npy", self.high)
        np.save(f"{path}.ones.npy", self.ones)
        np.save(f"{path}.zeros.npy", self.zeros)
        np.save(f"{path}.meta.npy", np.array([self.n, self.l]))

    @classmethod
    def load(cls, path: str) -> EliasFano:
        n, bits = np.load(f"{path}.meta.npy")
        return cls(int(n), int(bits), *(np.load(f"{path}.{x}.npy", mmap_mode="r") for x in ("low", "high", "ones", "zeros")))


#: A probability's code is 1 + its log10 in steps from FLOOR to 0; code 0 means unseen.
FLOOR, STEPS = -12.0, 65534


def quantise(log10p: np.ndarray) -> np.ndarray:
    return (1 + np.rint((np.clip(log10p, FLOOR, 0) - FLOOR) / -FLOOR * STEPS)).astype(np.uint16)


def probabilities(codes: np.ndarray) -> np.ndarray:
    return np.where(codes > 0, 10 ** (FLOOR - (codes.astype(np.float64) - 1) / STEPS * FLOOR), 0.0)


class BigramTrie:
    """Contexts, pointers to their successors, and successors made monotone by adding the last number of the context before."""

    def __init__(self, contexts: EliasFano, pointers: EliasFano, successors: EliasFano, codes: np.ndarray):
        self.contexts, self.pointers, self.successors, self.codes = contexts, pointers, successors, codes

    @classmethod
    def build(cls, ctx: np.ndarray, word: np.ndarray, log10p: np.ndarray) -> BigramTrie:
        """From distinct pairs sorted by context, then word."""
        heads = np.flatnonzero(np.concatenate([[True], ctx[1:] != ctx[:-1]])) if len(ctx) else np.array([], dtype=np.int64)
        stops = np.append(heads[1:], len(ctx)) if len(ctx) else heads
        last = word[stops - 1].astype(np.uint64) + np.uint64(1) if len(ctx) else np.array([], dtype=np.uint64)
        base = np.concatenate([[np.uint64(0)], np.cumsum(last)[:-1]]).astype(np.uint64) if len(ctx) else last
        monotone = word.astype(np.uint64) + np.repeat(base, stops - heads)
        return cls(EliasFano.build(ctx[heads]), EliasFano.build(np.append(heads, len(ctx))), EliasFano.build(monotone), quantise(log10p))

    def codes_of(self, ctx: np.ndarray, word: np.ndarray) -> np.ndarray:
        """Codes of pairs, 0 where the trie lacks them."""
        out = np.zeros(len(ctx), dtype=np.uint16)
        if not self.contexts.n or not len(ctx):
            return out
        uniq, inverse = np.unique(ctx, return_inverse=True)
        c = self.contexts.find(uniq, np.zeros(len(uniq), dtype=np.int64), np.full(len(uniq), self.contexts.n))
        known = c >= 0
        at = np.where(known, c, 0)
        b, e = self.pointers.get(at).astype(np.int64), self.pointers.get(at + 1).astype(np.int64)
        # a context's numbers start after the last of the context before, plus one
        base = np.where(b > 0, self.successors.get(np.maximum(b - 1, 0)) + np.uint64(1), np.uint64(0))
        top = self.successors.get(np.maximum(e - 1, 0)) - base
        fits = known[inverse] & (word <= top[inverse])
        q = np.flatnonzero(fits)
        i = inverse[q]
        found = self.successors.find(base[i] + word[q].astype(np.uint64), b[i], e[i])
        out[q[found >= 0]] = self.codes[found[found >= 0]]
        return out

    def successors_of(self, ctx: np.ndarray) -> np.ndarray:
        """How many distinct successors each context has: the distance of its pointers."""
        out = np.zeros(len(ctx), dtype=np.int64)
        if self.contexts.n and len(ctx):
            c = self.contexts.find(ctx, np.zeros(len(ctx), dtype=np.int64), np.full(len(ctx), self.contexts.n))
            at = c[c >= 0]
            out[c >= 0] = (self.pointers.get(at + 1) - self.pointers.get(at)).astype(np.int64)
        return out

    def save(self, folder: str) -> None:
        for name in ("contexts", "pointers", "successors"):
            getattr(self, name).save(f"{folder}/{name}")
        np.save(f"{folder}/codes.npy", self.codes)

    @classmethod
    def load(cls, folder: str) -> BigramTrie:
        return cls(*(EliasFano.load(f"{folder}/{x}") for x in ("contexts", "pointers", "successors")), np.load(f"{folder}/codes.npy", mmap_mode="r"))
