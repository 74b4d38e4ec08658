"""Pixel statistics against plain loops and a direct transform."""

import cmath
import math
from statistics import mean, median, pstdev, pvariance

import numpy as np
import pytest
from pyspark.sql import functions as F

from tessera.functions import grids

KIND = "id int, grp string, content binary, height int, width int, channels int"
SHAPES = [(6, 9, 3), (8, 8, 1), (1, 12, 3), (12, 1, 3), (10, 11, 4), (1, 1, 3), (17, 20, 3)]


@pytest.fixture(scope="module")
def images():
    rng, out = np.random.default_rng(8), []
    for k in range(28):
        h, w, c = SHAPES[k % len(SHAPES)]
        x = rng.integers(0, 256, (h, w, c)) if k % 3 else np.cumsum(rng.integers(0, 3, (h, w, c)), axis=1) * 3 % 256
        out.append(x // 128 * 255 if k % 5 == 0 else x)
    return [x.astype(int).tolist() for x in out]


@pytest.fixture(scope="module")
def rows(spark, images):
    data = [(i, f"g{i % 2}" if i % 7 else None, bytearray(v for r in x for p in r for v in p), len(x), len(x[0]), len(x[0][0])) for i, x in enumerate(images)]
    data += [(900, "g0", None, 2, 2, 1), (901, "g0", bytearray(b"abc"), 2, 2, 1), (902, "g0", bytearray(b""), 0, 0, 1), (903, "g0", bytearray(b"abcd"), None, 2, 1)]
    return spark.createDataFrame(data, KIND).repartition(3).cache()


def found(rows, f):
    return {r.id: r.s.asDict() for r in rows.select("id", f(*map(F.col, grids.GRID)).alias("s")).collect()}


def rgb(x):
    return [[p[:3] if len(p) >= 3 else [p[0]] * 3 for p in r] for r in x]


def luma(x):
    return [[math.floor(0.299 * p[0] + 0.587 * p[1] + 0.114 * p[2] + 0.5) if len(p) >= 3 else p[0] for p in r] for r in x]


def dft(g):
    """Centred magnitudes, by the definition."""
    h, w = len(g), len(g[0])
    out = [[abs(sum(g[y][x] * cmath.exp(-2j * cmath.pi * (u * y / h + v * x / w)) for y in range(h) for x in range(w))) for v in range(w)] for u in range(h)]
    return [[out[(u - h // 2) % h][(v - w // 2) % w] for v in range(w)] for u in range(h)]


def rings(h, w):
    return {(u, v): math.hypot(v - w // 2, u - h // 2) for u in range(h) for v in range(w)}


def close(got, want, by=1e-6):
    assert got.keys() == want.keys()
    for k, v in want.items():
        assert got[k] == pytest.approx(v, abs=by, rel=1e-6), k


def test_unreadable_grids_have_null(rows):
    for f in (grids.fingerprint, grids.traces, grids.spectrum, grids.genre_of, grids.measures):
        got = found(rows, f)
        assert all(v is None for i in range(900, 904) for v in got[i].values()) and all(v is not None for i in range(28) for v in got[i].values())


def test_difference_hash(rows, images):
    got = found(rows, grids.fingerprint)
    for i, x in enumerate(images):
        g, h, w = luma(x), len(x), len(x[0])

        def cell(r, c, g=g, h=h, w=w):  # the average over a fraction of the grid
            total = 0.0
            for y in range(h):
                for z in range(w):
                    a = max(0, min((r + 1) * h / 8, y + 1) - max(r * h / 8, y)) * max(0, min((c + 1) * w / 9, z + 1) - max(c * w / 9, z))
                    total += a * g[y][z]
            return round(total * 72 / h / w, 6)

        bits = "".join("1" if cell(r, c + 1) > cell(r, c) else "0" for r in range(8) for c in range(8))
        assert got[i]["dhash64"] == f"{int(bits, 2):016x}"


def test_hidden_traces(rows, images):
    got = found(rows, grids.traces)
    for i, x in enumerate(images):
        c, h, w = rgb(x), len(x), len(x[0])
        e = []
        for k in range(3):
            p = mean(c[y][z][k] & 1 for y in range(h) for z in range(w))
            e.append(0 if p in (0, 1) else -(p * math.log2(p) + (1 - p) * math.log2(1 - p)))
        turns = []
        if w > 1:
            turns.append(mean((c[y][z][k] ^ c[y][z - 1][k]) & 1 for y in range(h) for z in range(1, w) for k in range(3)))
        if h > 1:
            turns.append(mean((c[y][z][k] ^ c[y - 1][z][k]) & 1 for y in range(1, h) for z in range(w) for k in range(3)))
        clear = [p for r in x for p in r if len(p) == 4 and p[3] == 0]
        hidden = mean(any(p[:3]) for p in clear) if clear else 0.0
        lsb, rate = mean(e), mean(turns) if turns else 0.0
        score = min(45, max(0, lsb - 0.985) * 900 + max(0, 0.018 - abs(rate - 0.5)) * 700)
        score = max(score, min(85, 55 + 30 * hidden)) if hidden > 0.05 else score
        close(got[i], {"lsb_entropy": round(lsb, 4), "transition_rate": round(rate, 4), "diagonal_share": 0.0, "hidden_share": round(hidden, 4), "score": round(score, 1)}, 1.1e-1)


def test_haar_details_against_a_hand_version():
    rng = np.random.default_rng(2)
    g = rng.integers(0, 256, (2, 67, 66)).astype(float)
    g[1] = np.arange(66)  # only differences across
    want = []
    for x in g.tolist():
        d = {"diagonal": [], "across": [], "down": []}
        for y in range(0, 66, 2):
            for z in range(0, 66, 2):
                a, b, c, e = x[y][z], x[y][z + 1], x[y + 1][z], x[y + 1][z + 1]
                d["diagonal"].append((a - b - c + e) / 4)
                d["across"].append((a - b + c - e) / 4)
                d["down"].append((a + b - c - e) / 4)
        v = {k: pvariance(s) for k, s in d.items()}
        total = sum(v.values())
        want.append(v["diagonal"] / total if total > 1e-4 else 0.0)
    assert grids.haar_share(g) == pytest.approx(want) and grids.haar_share(g[:, :63]).tolist() == [0, 0]


def test_spectral_score_against_a_direct_transform(rows, images):
    got = found(rows, grids.spectrum)
    for i, x in enumerate(images):
        h, w = len(x), len(x[0])
        m, r, most = dft(luma(x)), rings(h, w), min(h, w) / 2
        ring = [math.log(m[u][v] + 1e-8) for (u, v), d in r.items() if 0.6 * most <= d <= 0.95 * most]
        disc = [math.log(m[u][v] + 1e-8) for (u, v), d in r.items() if d < 0.25 * most]
        if min([*ring, *disc, 0]) < -8:  # a coefficient that is zero but for rounding
            continue
        outer, inner = mean(ring) if ring else 0.0, mean(disc) if disc else 1.0
        ratio, peak = outer / (inner + 1e-8), max(ring) - outer if ring else 0.0
        close(got[i], {"hf_ratio": ratio, "peak_factor": peak, "spectral_score": min(100, max(0, (ratio - 0.65) * 250 + peak * 5))}, 6e-3)


def test_genre(rows, images):
    got = found(rows, grids.genre_of)
    for i, x in enumerate(images):
        c, h, w = rgb(x), len(x), len(x[0])
        s = min(h, w)
        crop = [[mean(c[y][z]) for z in range((w - s) // 2, (w - s) // 2 + s)] for y in range((h - s) // 2, (h - s) // 2 + s)]
        around = lambda y, z, crop=crop, s=s: [crop[min(max(y + a, 0), s - 1)][min(max(z + b, 0), s - 1)] for a in (-1, 0, 1) for b in (-1, 0, 1)]
        deviations = [pstdev(around(y, z)) for y in range(s) for z in range(s)]
        if any(abs(d - 0.8) < 1e-6 for d in deviations):
            continue
        tone = [[mean(p) for p in r] for r in c]
        spike = lambda v: mean(a > 4 * (median(v) + 1e-6) for a in v) if len(v) >= 8 else 0.0
        gx = [mean(abs(tone[y][z + 1] - tone[y][z]) for y in range(h)) for z in range(w - 1)]
        gy = [mean(abs(tone[y + 1][z] - tone[y][z]) for z in range(w)) for y in range(h - 1)]
        want = {
            "flat_frac": mean(d < 0.8 for d in deviations), "uniq_colors": len({tuple(v // 8 for v in p) for r in c for p in r}) / (h * w), "axis_edges": (spike(gx) + spike(gy)) / 2,
            "sat_mean": mean((max(p) - min(p)) / max(p) if max(p) else 0 for r in c for p in r),
        }
        close(got[i], want)


def test_low_level(rows, images):
    got = found(rows, grids.measures)
    for i, x in enumerate(images):
        c, h, w = [[[v / 255 for v in p] for p in r] for r in rgb(x)], len(x), len(x[0])
        lum = [[mean(p) for p in r] for r in c]
        at = lambda g, y, z, h=h, w=w: g[min(max(y, 0), h - 1)][min(max(z, 0), w - 1)]
        rows_ = [[at(lum, y - 1, z) / 4 + lum[y][z] / 2 + at(lum, y + 1, z) / 4 for z in range(w)] for y in range(h)]
        blur = [[at(rows_, y, z - 1) / 4 + rows_[y][z] / 2 + at(rows_, y, z + 1) / 4 for z in range(w)] for y in range(h)]
        middle = mean(v for r in lum for v in r)
        m, far = dft([[v - middle for v in r] for r in lum]), rings(h, w)
        all_m = sum(map(sum, m))
        steps = [[abs(r[z + 1] - r[z]) for z in range(w - 1)] for r in lum]
        grid = [r[z] for r in steps for z in range(7, w - 1, 8)] if w - 1 > 8 else []
        every = [v for r in steps for v in r]

        def slope(g, k):
            n = len(g)
            return 0.0 if n < 2 else g[1] - g[0] if k == 0 else g[-1] - g[-2] if k == n - 1 else (g[k + 1] - g[k - 1]) / 2

        grad = [math.hypot(slope([lum[a][z] for a in range(h)], y), slope(lum[y], z)) for y in range(h) for z in range(w)]
        flat = [v for r in lum for v in r]
        want = {
            "mean_lum": middle, "std_lum": pstdev(flat), "hp_std": pstdev([lum[y][z] - blur[y][z] for y in range(h) for z in range(w)]), "hf_ratio": sum(m[u][v] for (u, v), d in far.items() if d / (min(h, w) / 2) > 0.75) / max(all_m, 1e-9),
            "blockiness": (mean(grid) if grid else 0.0) / max(mean(every) if every else 0.0, 1e-9), "chroma_std": mean(pstdev([p[k] for r in c for p in r]) for k in range(3)), "sat_mean": mean(max(p) - min(p) for r in c for p in r), "grad_mean": mean(grad),
            "clip_low": mean(v < 0.02 for v in flat), "clip_high": mean(v > 0.98 for v in flat),
        }
        if all_m < 1e-6:  # flat: nothing but rounding
            got[i]["hf_ratio"] = want["hf_ratio"] = 0
        close(got[i], want)


def test_histograms_and_mean_spectra(rows, images):
    want = {}
    for i, x in enumerate(images):
        for k in range(len(x[0][0])):
            for r in x:
                for p in r:
                    key = (f"g{i % 2}" if i % 7 else None, k, p[k])
                    want[key] = want.get(key, 0) + 1
    got = {(r.grp, r.channel, r.bin): r.n for r in grids.histograms(rows, "grp").collect()}
    assert {k: n for k, n in got.items() if n} == want and len(got) == 3 * 4 * 256 - 256 * sum((g, 3, 0) not in got for g in ("g0", "g1", None))
    some = rows.where("id in (1, 8, 15)")
    mags = [dft(luma(images[i])) for i in (1, 8, 15)]
    by = {r.i: r.magnitude for r in grids.mean_spectrum(some.withColumn("grp", F.lit("a")), "grp").collect()}
    for at in range(64):
        values = [m[at // 8][at % 8] for m in mags]
        if min(values) > 1e-6:
            assert by[at] == pytest.approx(mean(math.log(v + 1e-8) for v in values), abs=1e-6)


def test_large_grids_shrink_by_areas():
    x = np.arange(2 * 6 * 4 * 3).reshape(2, 6, 4, 3).astype(np.uint8)
    assert grids.shrunk(x, 3).shape == (2, 3, 2, 3)
    assert grids.shrunk(x, 3)[0, 0, 0].tolist() == x[0, :2, :2].mean(axis=(0, 1)).tolist() and grids.shrunk(x, 6) is not x
