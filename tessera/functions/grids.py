"""Statistics of pixel grids in Arrow batches: hashes, bit planes, spectra, colours, edges.

A grid is a column of bytes, row by row, with a height, a width and a number of channels (1, 3, or 4 with the last one
alpha). Grids of one shape in a batch are computed as one stack, a bounded number of pixels at a time. A grid that is
null, empty or of another size than its shape says has null for all its statistics.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Pixels that a task holds as numbers at once.
PIXELS = 1 << 21
Statistic = Callable[[np.ndarray], dict[str, np.ndarray]]


def stacks(content: pa.Array, height: pa.Array, width: pa.Array, channels: pa.Array) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """The places of grids of one shape, and their bytes as an array (grid, row, column, channel)."""
    by: dict[tuple[int, int, int], list[int]] = {}
    bodies = content.to_pylist()
    for i, (b, *shape) in enumerate(zip(bodies, height.to_pylist(), width.to_pylist(), channels.to_pylist(), strict=True)):
        if b and None not in shape and min(shape) > 0 and len(b) == shape[0] * shape[1] * shape[2]:
            by.setdefault(tuple(shape), []).append(i)
    for shape, places in by.items():
        step = max(1, PIXELS // (shape[0] * shape[1]))
        for k in range(0, len(places), step):
            part = places[k : k + step]
            yield np.array(part), np.frombuffer(b"".join(bodies[i] for i in part), np.uint8).reshape(len(part), *shape)


def statistic(f: Statistic, kind: str, types: dict[str, pa.DataType]):
    """A function from the columns of a grid to a struct of what f finds."""

    def run(it: Iterator[tuple[pa.Array, ...]]) -> Iterator[pa.Array]:
        for columns in it:
            out: dict[str, list] = {k: [None] * len(columns[0]) for k in types}
            for places, x in stacks(*columns):
                for k, v in f(x).items():
                    for i, y in zip(places, v.tolist(), strict=True):
                        out[k][i] = y
            yield pa.StructArray.from_arrays([pa.array(out[k], t) for k, t in types.items()], fields=[pa.field(k, t) for k, t in types.items()])

    return lambda content, height, width, channels: F.arrow_udf(run, kind)(content, height, width, channels)


def doubles(f: Statistic, *names: str):
    return statistic(f, ", ".join(f"{n} double" for n in names), dict.fromkeys(names, pa.float64()))


def colours(x: np.ndarray) -> np.ndarray:
    """Three colour channels of a stack; a grey one three times."""
    return x[..., :3] if x.shape[-1] >= 3 else np.repeat(x[..., :1], 3, axis=-1)


def grey(x: np.ndarray) -> np.ndarray:
    """Luma, rounded."""
    return x[..., 0].astype(np.float64) if x.shape[-1] < 3 else np.floor(x[..., :3] @ np.array([0.299, 0.587, 0.114]) + 0.5)


def shares(size: int, cells: int) -> np.ndarray:
    """How much of each of `size` pixels falls to each of the cells that divide their row evenly; rows sum to 1."""
    edges = np.linspace(0, size, cells + 1)
    at = np.arange(size)
    part = np.minimum(edges[1:, None], at + 1) - np.maximum(edges[:-1, None], at)
    return np.clip(part, 0, None) * cells / size


def difference_hash(x: np.ndarray) -> dict[str, np.ndarray]:
    """64 bits: whether each cell of 8 rows of 9 is lighter than the one before, by averages over areas."""
    g = np.round(shares(x.shape[1], 8) @ grey(x) @ shares(x.shape[2], 9).T, 6)
    bits = (g[:, :, 1:] > g[:, :, :-1]).reshape(len(g), 64)
    return {"dhash64": np.array([f"{int.from_bytes(np.packbits(b).tobytes(), 'big'):016x}" for b in bits])}


def entropy(p: np.ndarray) -> np.ndarray:
    """Of a bit that is 1 with probability p."""
    q = np.clip(p, 1e-300, 1), np.clip(1 - p, 1e-300, 1)
    return np.where((p <= 0) | (p >= 1), 0.0, -(p * np.log2(q[0]) + (1 - p) * np.log2(q[1])))


def haar_share(g: np.ndarray) -> np.ndarray:
    """The diagonal's share of the variance of one Haar step's details; 0 for grids under 64 by 64 and flat ones."""
    h, w = g.shape[1] // 2 * 2, g.shape[2] // 2 * 2
    if min(h, w) < 64:
        return np.zeros(len(g))
    a, b, c, d = (g[:, i:h:2, j:w:2] for i in (0, 1) for j in (0, 1))
    diagonal, across, down = ((s / 4).var(axis=(1, 2)) for s in (a - b - c + d, a - b + c - d, a + b - c - d))
    total = diagonal + across + down
    return np.where(total > 1e-4, diagonal / np.maximum(total, 1e-12), 0.0)


def hidden_traces(x: np.ndarray) -> dict[str, np.ndarray]:
    """Traces of hidden payloads: entropy and transitions of the lowest bits, the diagonal's share of Haar details, colour
    under full transparency, and a score from 0 to 85 that stays under 46 without such colour."""
    n, h, w, _ = x.shape
    c = colours(x)
    flat = c.reshape(n, h * w, 3)
    if h * w > 1_000_000:  # every so many pixels of a large grid
        flat = flat[:, :: h * w // 1_000_000]
    lsb = entropy((flat & 1).mean(axis=1)).mean(axis=1)
    bits = c[:, :: max(1, h // 700), :: max(1, w // 700)] & 1
    turns = [(bits[:, :, 1:] != bits[:, :, :-1]).mean(axis=(1, 2, 3))] if bits.shape[2] > 1 else []
    turns += [(bits[:, 1:] != bits[:, :-1]).mean(axis=(1, 2, 3))] if bits.shape[1] > 1 else []
    rate = np.mean(turns, axis=0) if turns else np.zeros(n)
    share = haar_share(grey(x))
    clear = x[..., 3] == 0 if x.shape[-1] == 4 else np.zeros((n, h, w), bool)
    hidden = (clear & (c != 0).any(-1)).sum(axis=(1, 2)) / np.maximum(clear.sum(axis=(1, 2)), 1)
    score = np.minimum(45.0, np.maximum(0, lsb - 0.985) * 900 + np.maximum(0, 0.018 - np.abs(rate - 0.5)) * 700 + np.where(share > 0.34, 15.0, 0.0))
    score = np.where(hidden > 0.05, np.maximum(score, np.minimum(85.0, 55.0 + hidden * 30)), score)
    return {"lsb_entropy": np.round(lsb, 4), "transition_rate": np.round(rate, 4), "diagonal_share": np.round(share, 4), "hidden_share": np.round(hidden, 4), "score": np.round(score, 1)}


def distances(h: int, w: int) -> np.ndarray:
    """How far each place of a centred spectrum is from its middle."""
    y, x = np.ogrid[:h, :w]
    return np.sqrt((x - w // 2) ** 2 + (y - h // 2) ** 2)


def spectral(x: np.ndarray) -> dict[str, np.ndarray]:
    """The outer ring of the log spectrum against the inner disc, the ring's peak over its mean, and their score, 0 to 100."""
    n, h, w, _ = x.shape
    mag = np.log(np.abs(np.fft.fftshift(np.fft.fft2(grey(x)), axes=(1, 2))) + 1e-8)
    r, most = distances(h, w), min(h, w) / 2
    ring, disc = mag[:, (r >= 0.6 * most) & (r <= 0.95 * most)], mag[:, r < 0.25 * most]
    outer = ring.mean(1) if ring.shape[1] else np.zeros(n)
    inner = disc.mean(1) if disc.shape[1] else np.ones(n)
    ratio = outer / (inner + 1e-8)
    peak = ring.max(1) - outer if ring.shape[1] else np.zeros(n)
    return {"hf_ratio": np.round(ratio, 4), "peak_factor": np.round(peak, 2), "spectral_score": np.round(np.clip((ratio - 0.65) * 250 + peak * 5, 0, 100), 2)}


def shrunk(x: np.ndarray, most: int) -> np.ndarray:
    """A stack whose longer side has at most `most` pixels, by averages over areas."""
    h, w = x.shape[1:3]
    if max(h, w) <= most:
        return x.astype(np.float64)
    rows, cols = (shares(s, max(1, round(s * most / max(h, w)))) for s in (h, w))
    return np.einsum("ah,nhwc,bw->nabc", rows, x.astype(np.float64), cols, optimize=True)


def neighbourhood(g: np.ndarray) -> np.ndarray:
    """Means over 3 by 3 pixels, edges repeated."""
    p = np.pad(g, ((0, 0), (1, 1), (1, 1)), mode="edge")
    return sum(p[:, i : i + g.shape[1], j : j + g.shape[2]] for i in range(3) for j in range(3)) / 9


def spikes(v: np.ndarray) -> np.ndarray:
    """The share of entries over four times their median; 0 for fewer than 8."""
    return (v > 4 * (np.median(v, axis=1, keepdims=True) + 1e-6)).mean(1) if v.shape[1] >= 8 else np.zeros(len(v))


def genre(x: np.ndarray, most: int = 512) -> dict[str, np.ndarray]:
    """What tells photographs from graphics: flat neighbourhoods of the middle (native pixels), and of the whole, shrunk:
    different colours in 5 bits, lines along the axes, saturation."""
    n, h, w, _ = x.shape
    c = colours(x)
    side = min(256, h, w)
    top, left = (h - side) // 2, (w - side) // 2
    g = c[:, top : top + side, left : left + side].mean(-1)
    flat = np.sqrt(np.maximum(neighbourhood(g * g) - neighbourhood(g) ** 2, 0)) < 0.8
    s = shrunk(c, most)
    q = (s / 8).astype(np.int64) @ np.array([1024, 32, 1])
    q = np.sort(q.reshape(n, -1), axis=1)
    tone = s.mean(-1)
    edges = spikes(np.abs(np.diff(tone, axis=2)).mean(1)) + spikes(np.abs(np.diff(tone, axis=1)).mean(2))
    high, low = s.max(-1), s.min(-1)
    sat = np.where(high > 0, (high - low) / np.maximum(high, 1e-6), 0).mean(axis=(1, 2))
    return {"flat_frac": flat.mean(axis=(1, 2)), "uniq_colors": (1 + (np.diff(q, axis=1) > 0).sum(1)) / q.shape[1], "axis_edges": edges / 2, "sat_mean": sat}


LOW_LEVEL = ("mean_lum", "std_lum", "hp_std", "hf_ratio", "blockiness", "chroma_std", "sat_mean", "grad_mean", "clip_low", "clip_high")


def low_level(x: np.ndarray) -> dict[str, np.ndarray]:
    """Ten statistics without meaning, by which a class may be told all the same."""
    rgb = colours(x) / 255
    lum = rgb.mean(-1)
    blur = lum
    for axis in (1, 2):
        p = np.pad(blur, [(1, 1) if a == axis else (0, 0) for a in range(3)], mode="edge")
        size = lum.shape[axis]
        low, mid, high = (p.take(range(k, k + size), axis) for k in range(3))
        blur = low / 4 + mid / 2 + high / 4
    spectrum = np.abs(np.fft.fftshift(np.fft.fft2(lum - lum.mean(axis=(1, 2), keepdims=True)), axes=(1, 2)))
    far = distances(*lum.shape[1:]) / (min(lum.shape[1:]) / 2) > 0.75
    steps = np.abs(np.diff(lum, axis=2))
    grid = steps[:, :, 7::8].mean(axis=(1, 2)) if steps.shape[2] > 8 else np.zeros(len(x))
    slopes = np.hypot(*(np.gradient(lum, axis=a) if lum.shape[a] > 1 else np.zeros_like(lum) for a in (1, 2)))
    whole = lambda v: v.mean(axis=(1, 2))
    found = (
        whole(lum), lum.std(axis=(1, 2)), (lum - blur).std(axis=(1, 2)), spectrum[:, far].sum(1) / np.maximum(spectrum.sum(axis=(1, 2)), 1e-9), grid / np.maximum(whole(steps) if steps.shape[2] else 0.0, 1e-9),
        rgb.std(axis=(1, 2)).mean(-1), whole(rgb.max(-1) - rgb.min(-1)), whole(slopes), whole(lum < 0.02), whole(lum > 0.98),
    )
    return dict(zip(LOW_LEVEL, found, strict=True))


fingerprint = statistic(difference_hash, "dhash64 string", {"dhash64": pa.string()})
traces = doubles(hidden_traces, "lsb_entropy", "transition_rate", "diagonal_share", "hidden_share", "score")
spectrum = doubles(spectral, "hf_ratio", "peak_factor", "spectral_score")
genre_of = doubles(genre, "flat_frac", "uniq_colors", "axis_edges", "sat_mean")
measures = doubles(low_level, *LOW_LEVEL)

GRID = ("content", "height", "width", "channels")


def summed(rows: DataFrame, by: str, f: Callable[[np.ndarray], np.ndarray], cut: Callable[[np.ndarray], np.ndarray] | None = None) -> DataFrame:
    """by, i, total and n: element-wise sums over the grids of a group of what f makes of each stack, (grid, i). Each
    batch adds up its own grids first, so what is shuffled is one row for each element, group and batch."""
    kind = rows.schema[by].dataType

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            keys = b.column(by)
            codes = keys.dictionary_encode()
            code = codes.indices.fill_null(len(codes.dictionary)).to_numpy()
            sums: dict[int, tuple[np.ndarray, int]] = {}
            for places, x in stacks(*(b.column(c) for c in GRID)):
                made = f(x)
                for g in np.unique(code[places]):
                    part = made[code[places] == g]
                    old, n = sums.get(int(g), (0, 0))
                    old = np.zeros(part.shape[1]) if n == 0 else old
                    size = max(len(old), part.shape[1])
                    total = np.zeros(size)
                    total[: len(old)] += old
                    total[: part.shape[1]] += part.sum(0)
                    sums[int(g)] = (total, n + len(part))
            for g, (total, n) in sums.items():
                key = pa.nulls(len(total), keys.type) if g == len(codes.dictionary) else pa.array([codes.dictionary[g].as_py()] * len(total), keys.type)
                yield pa.RecordBatch.from_arrays([key, pa.array(np.arange(len(total), dtype=np.int32)), pa.array(total), pa.array([n] * len(total), pa.int64())], names=[by, "i", "total", "n"])

    parts = rows.select(by, *GRID).mapInArrow(run, f"`{by}` {kind.simpleString()}, i int, total double, n long")
    return parts.groupBy(by, "i").agg(F.sum("total").alias("total"), F.sum("n").alias("n"))


def histograms(rows: DataFrame, by: str) -> DataFrame:
    """by, channel, bin, n: how many pixels of a group have each value from 0 to 255, for each channel; values that none
    has count 0."""

    def counted(x: np.ndarray) -> np.ndarray:
        n, _, _, c = x.shape
        at = (np.arange(n * c).reshape(n, 1, 1, c) * 256 + x).ravel()
        return np.bincount(at, minlength=n * c * 256).reshape(n, c * 256)

    s = summed(rows, by, counted)
    return s.select(by, F.floor(F.col("i") / 256).cast("int").alias("channel"), (F.col("i") % 256).alias("bin"), F.col("total").cast("long").alias("n"))


def mean_spectrum(rows: DataFrame, by: str) -> DataFrame:
    """by, i, magnitude: the mean over a group's grids, which share one shape, of the centred log spectrum, row by row."""
    made = lambda x: np.log(np.abs(np.fft.fftshift(np.fft.fft2(grey(x)), axes=(1, 2))) + 1e-8).reshape(len(x), -1)
    return summed(rows, by, made).select(by, "i", (F.col("total") / F.col("n")).alias("magnitude"))


def text_grid(text: Column, height: int, width: int, channels: int) -> dict[str, Column]:
    """Columns of a grid whose pixels are the bytes of a text, repeated as often as they are needed; null without any."""
    size = height * width * channels
    body = F.encode(text, "UTF-8")
    times = F.ceil(F.lit(size) / F.octet_length(body)).cast("int")
    content = F.when(F.octet_length(body) > 0, F.substring(F.encode(F.repeat(text, times), "UTF-8"), 1, size))
    return {"content": content, "height": F.lit(height), "width": F.lit(width), "channels": F.lit(channels)}
