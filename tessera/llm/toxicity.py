"""Toxicity by compression distance: two zstandard dictionaries, windows of several words, calibrated thresholds.

Training takes a bounded sample of labelled documents (`per_class` of each class, by the hash of the key; of a document
of over `most_words` words, evenly spread runs of words up to that number). Segments are word starts of 4 to 11 bytes
and pairs of neighbouring words. Those that stand in many more toxic than ordinary documents, beyond what chance gives
among so many candidates, are chosen greedily until each toxic document has several; with the commonest words of toxic
texts that go on from them they are what the toxic dictionary adds. Both dictionaries share ordinary text; the ordinary
one adds the same words without their toxic starts, so that only these make a difference.

A window is `WINDOW` words, each window half over the next; its gain is the bytes that the toxic dictionary saves
against the ordinary one. A document's features are the numbers of its windows with gains from 2 to 7 bytes; a logistic
curve, fitted on features from dictionaries of the other folds and weighted by the classes' true sizes, turns them into
a score. Counting, choosing and cross-fitting read the sample with Spark; the driver gets counts and features.

Defined cases: a null or empty text has no words and scores as such; a null key is not held out and is never learned
from; null labels are ignored; equal texts of a class count once; a word of over 40 bytes counts as pieces of 40; without
labels of both classes every score is the smoothed share of toxic labels; an empty table gives an empty result. A column
named as `out` is replaced; other extra columns stay with `score_toxicity` and are ignored by the query.
"""

import hashlib
from collections import Counter, defaultdict
from dataclasses import dataclass, field
from math import log
from typing import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .shared import bounded_sample, crc_mod, materialise, read

PUNCTUATION = bytes.maketrans(b'.,;:!?"()[]|', b" " * 12)
#: Each window stands between these. zstandard starts no match in the last 8 bytes, and stores small blocks that do not
#: shrink as they are: the tail keeps the one away from the words, the carrier, which both dictionaries end with, the other.
CARRIER, TAIL = b"0123456789ABCDEFGHIJ", b"}{~^][><"
WINDOW, STEP, PIECE = 4, 2, 40
LEVEL, SHARED_BYTES, GOING_ON = 6, 8192, 150
GAINS = (2, 3, 4, 5, 7)
FOLDS = 5


def words_of(text: str | None) -> list[bytes]:
    ws = text.encode("utf-8", "surrogatepass").lower().translate(PUNCTUATION).split() if text else []
    return ws if max(map(len, ws), default=0) <= PIECE else [w[i : i + PIECE] for w in ws for i in range(0, len(w), PIECE)]


def segments(ws: list[bytes]) -> set[bytes]:
    """Starts of words, the space before included, of 4 to 11 bytes, and pairs of neighbouring words."""
    out = {u[:n] for w in set(ws) for u in (b" " + w + b" ",) for n in range(4, min(11, len(u)) + 1)}
    out.update(b" " + a + b" " + b + b" " for a, b in set(zip(ws, ws[1:], strict=False)))
    return out


def llr(a: np.ndarray, b: np.ndarray, n: int, m: int) -> np.ndarray:
    """Log-likelihood ratio of a of n against b of m, 0 where the first share is not the larger."""
    part = lambda k, n, p: k * np.log(np.clip(p, 1e-12, 1)) + (n - k) * np.log(np.clip(1 - p, 1e-12, 1))
    e = (a + b) / (n + m)
    return np.where(a * m > b * n, 2 * (part(a, n, a / n) + part(b, m, b / m) - part(a, n, e) - part(b, m, e)), 0)


def choose_segments(names: list[bytes], has: np.ndarray, b: np.ndarray, m: int, least: float, cover: int = 5) -> list[bytes]:
    """Greedy cover: each time the segment that tells most about toxic documents (rows of has) which still lack some of
    `cover`, the longest of equals; b is how many of m ordinary documents have it. Chosen ones do not overlap."""
    need, out, free, length = np.full(len(has), cover), [], np.ones(len(names), dtype=bool), np.array([len(s) for s in names])
    while free.any() and (left := need > 0).any():
        gain = has[left].sum(0)
        value = np.where(free & (gain >= 2), llr(gain, b, int(left.sum()), m), 0)
        if value.max() < least:
            break
        top = max(np.flatnonzero(value >= value.max() - 1e-9), key=lambda i: (length[i], names[i]))
        out.append(names[top])
        need[has[:, top]] -= 1
        free &= np.array([names[top] not in s and s not in names[top] for s in names])
    return out


@dataclass
class ToxicityModel:
    toxic: bytes = b""
    ordinary: bytes = b""
    weights: list[float] = field(default_factory=lambda: [0.0] * (len(GAINS) + 2))
    _made: tuple | None = None

    def __getstate__(self):
        return (self.toxic, self.ordinary, self.weights)

    def __setstate__(self, state):
        self.toxic, self.ordinary, self.weights = state
        self._made = None

    @staticmethod
    def _compressor(content: bytes):
        d = zstandard.ZstdCompressionDict(content, dict_type=zstandard.DICT_TYPE_RAWCONTENT)
        d.precompute_compress(level=LEVEL)
        return zstandard.ZstdCompressor(level=LEVEL, dict_data=d, write_content_size=False, write_checksum=False, write_dict_id=False)

    def windows(self, ws: list[bytes], at_once: int = 8192) -> Iterator[list[bytes]]:
        """The windows of some words between carrier and tail, some at a time."""
        text, n = b" " + b" ".join(ws) + b" ", len(ws)
        spaces = np.zeros(n + 1, dtype=np.int64)  # before each word, and the last
        np.cumsum(np.fromiter(map(len, ws), np.int64, n) + 1, out=spaces[1:])
        first = np.arange(0, max(1, n - WINDOW + STEP) if n else 0, STEP)
        starts, stops = spaces[first].tolist(), (spaces[np.minimum(first + WINDOW, n)] + 1).tolist()
        for at in range(0, len(starts), at_once):
            yield [CARRIER + text[i:j] + TAIL for i, j in zip(starts[at : at + at_once], stops[at : at + at_once], strict=True)]

    def gains(self, windows: list[bytes]) -> np.ndarray:
        """The bytes that the toxic dictionary saves against the ordinary one, for each window."""
        if self._made is None:
            self._made = tuple(self._compressor(x) for x in (self.ordinary, self.toxic))
        ordinary, toxic = (np.fromiter(map(len, c.multi_compress_to_buffer(windows, threads=0)), np.int64, len(windows)) for c in self._made)
        return ordinary - toxic

    def counts(self, texts: list[list[bytes]], at_once: int = 16_384) -> np.ndarray:
        """How many windows of each text have each gain of GAINS or more; windows of several texts are compressed together."""
        out, held, owner = np.zeros((len(texts), len(GAINS)), dtype=np.int64), [], []

        def add() -> None:
            g, of = self.gains(held), np.repeat(*map(np.array, zip(*owner, strict=True)))
            for k, t in enumerate(GAINS):
                out[:, k] += np.bincount(of[g >= t], minlength=len(texts))
            held.clear()
            owner.clear()

        for i, ws in enumerate(texts) if self.toxic else ():
            for part in self.windows(ws):
                held += part
                owner.append((i, len(part)))
                if len(held) >= at_once:
                    add()
        if held:
            add()
        return out

    def features(self, texts: list[list[bytes]]) -> np.ndarray:
        """A row of numbers for each text."""
        if not self.toxic:
            return np.repeat([[1.0] + [0.0] * (len(GAINS) + 1)], len(texts), axis=0)
        n = np.array([len(ws) for ws in texts])
        return np.column_stack([np.ones(len(texts)), np.log1p(self.counts(texts)), np.log1p(n) * 0.1])


def dictionaries(chosen: list[bytes], going_on: Counter, ordinary: list[bytes]) -> ToxicityModel:
    """The model of some segments, of words that go on from them and of pieces of ordinary text; no weights yet."""
    if not chosen:
        return ToxicityModel()
    starts = tuple(sorted(chosen, key=len, reverse=True))
    more = [w for w, _ in sorted(going_on.items(), key=lambda x: (x[1], x[0]))[-GOING_ON:]]
    rest = b" ".join(next(w[len(s) :] for s in starts if w.startswith(s)) for w in more) + b" "
    kept = [w for p in ordinary for w in p.split() if not (b" " + w + b" ").startswith(starts)]
    shared = b" ".join(kept)[: 4 * SHARED_BYTES]
    toxic = b"".join(more) + b" ".join(s.strip() for s in reversed(chosen)) + b" "
    filler = (rest + shared[SHARED_BYTES:])[: len(toxic)].ljust(len(toxic))
    shared = shared[:SHARED_BYTES] + b" "
    return ToxicityModel(shared + toxic + CARRIER, shared + filler + CARRIER)


def logistic(x: np.ndarray, y: np.ndarray, w: np.ndarray, ridge: float = 1.0) -> np.ndarray:
    """Newton steps for a weighted logistic curve; the intercept is not held back."""
    beta, keep = np.zeros(x.shape[1]), ridge * np.diag([1e-6] + [1.0] * (x.shape[1] - 1))
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(x @ beta, -30, 30)))
        step = np.linalg.solve((x.T * (w * p * (1 - p) + 1e-9)) @ x + keep, x.T @ (w * (y - p)) - keep @ beta)
        beta += step
        if np.abs(step).max() < 1e-8:
            break
    return beta


def training_words(text: str | None, most_words: int) -> list[bytes]:
    """The words, or `most_words` of them in evenly spread runs of 64."""
    ws = words_of(text)
    if len(ws) <= most_words:
        return ws
    runs = max(1, most_words // 64)
    return [w for i in range(runs) for w in ws[i * len(ws) // runs :][:64]]


def training_sample(docs: DataFrame, chosen: DataFrame, key: str, text: str, most_words: int) -> DataFrame:
    """y, fold and t (words, one space between) of the chosen documents; equal texts of a class once."""

    def cut(it: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for a in it:
            yield pa.array([b" ".join(training_words(x.as_py(), most_words)) for x in a], pa.binary())

    rows = docs.select(F.col(key).alias("k"), F.col(text).alias("t")).join(F.broadcast(chosen), "k")  # at most per_class keys of a class
    rows = rows.select("y", F.arrow_udf(cut, "binary")("t").alias("t")).dropDuplicates(["y", "t"])
    # equal texts share a fold; the sample is small, so it is dealt out over all cores again
    return materialise(rows.withColumn("fold", F.pmod(F.xxhash64("t"), F.lit(FOLDS)).cast("int")).repartition(int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")), F.xxhash64("t")))


def count_segments(sample: DataFrame, totals: dict[tuple[int, int], int]) -> tuple[list[bytes], dict, float]:
    """Segments that can matter, how many documents of each (class, fold) have them, and the least ratio that counts."""

    def listed(it: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for a in it:
            yield pa.array([list(segments(x.as_py().split())) for x in a], pa.list_(pa.binary()))

    n, m = (sum(v for (y, _), v in totals.items() if y == c) for c in (1, 0))
    found = sample.where("y = 1").select(F.explode(F.arrow_udf(listed, "array<binary>")("t")).alias("s")).groupBy("s").agg(F.count("*").alias("n"))
    every = found.count()
    least = 2 * log(every + 1) + 2
    ks = np.arange(1, n + 1)
    enough = ks[llr(ks, np.zeros(n), n, max(m, 1)) >= least * (FOLDS - 1) / FOLDS]  # fewer cannot reach it, not even without ordinary ones
    names = sorted(bytes(r.s) for r in found.where(F.col("n") >= int(enough[0])).collect()) if len(enough) else []
    return names, count_in(sample, names), least


def indexed(names: list[bytes]):
    """For a column of words: the indexes of the segments that a text has."""
    at = {s: i for i, s in enumerate(names)}

    def run(it: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for a in it:
            yield pa.array([[at[s] for s in segments(x.as_py().split()) if s in at] for x in a], pa.list_(pa.int32()))

    return F.arrow_udf(run, "array<int>")


def count_in(sample: DataFrame, names: list[bytes]) -> dict[tuple[int, int], np.ndarray]:
    """By (class, fold), how many documents have each segment."""
    out = defaultdict(lambda: np.zeros(len(names), dtype=np.int64))
    for r in sample.select("y", "fold", F.explode(indexed(names)("t")).alias("i")).groupBy("y", "fold", "i").agg(F.count("*").alias("n")).collect():
        out[r.y, r.fold][r.i] = r.n
    return out


def learn(sample: DataFrame, total: dict[int, int]) -> ToxicityModel:
    """From the sample (y, fold, t); total is the number of labels of each class."""
    totals = {(r.y, r.fold): r.n for r in sample.groupBy("y", "fold").agg(F.count("*").alias("n")).collect()}
    names, counts, least = count_segments(sample, totals)
    folds = [*range(FOLDS), None]  # without one of them, or of all
    size = lambda y, f: sum(v for (c, g), v in totals.items() if c == y and g != f)
    of = lambda y, f: sum((v for (c, g), v in counts.items() if c == y and g != f), np.zeros(len(names), dtype=np.int64))
    may = np.zeros(len(names), dtype=bool)
    for f in folds:
        a, b, n, m = of(1, f), of(0, f), size(1, f), size(0, f)
        may |= (llr(a, b, max(n, 1), max(m, 1)) >= least) & (a * m >= 5 * b * n)
    kept = [s for s, ok in zip(names, may, strict=True) if ok]
    ordinary = {f: of(0, f)[may] for f in folds}
    docs = sample.where("y = 1").select("fold", indexed(kept)("t").alias("i")).collect()  # at most per_class rows
    has, fold = np.zeros((len(docs), len(kept)), dtype=bool), np.array([r.fold for r in docs])
    for k, r in enumerate(docs):
        has[k, r.i] = True
    chosen = {f: choose_segments(kept, has[fold != f] if f is not None else has, ordinary[f], size(0, f), least) if kept else [] for f in folds}
    models = make_models(sample, chosen)

    def crossed(batches):
        for b in batches:
            fold = b.column(1).to_numpy()
            for f in np.unique(fold):
                part = b.filter(pa.array(fold == f))
                x = models[int(f)].features([t.split() for t in part.column(2).to_pylist()])
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(x.tolist(), pa.list_(pa.float64()))], names=["y", "x"])

    rows = sample.select("y", "fold", "t").mapInArrow(crossed, "y int, x array<double>").collect()  # at most 2 * per_class rows of 7 numbers
    ys = np.array([r.y for r in rows])
    share = np.where(ys == 1, total[1] / max(1, (ys == 1).sum()), total[0] / max(1, (ys == 0).sum()))
    model = models[None]
    model.weights = logistic(np.array([r.x for r in rows]), ys, share * len(ys) / share.sum()).tolist()
    return model


def make_models(sample: DataFrame, chosen: dict) -> dict:
    """Dictionaries for each choice of segments, from the documents of the other folds."""
    starts = tuple(sorted({s for c in chosen.values() for s in c}))

    def going(it: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for a in it:
            yield pa.array([[u for w in set(x.as_py().split()) for u in (b" " + w + b" ",) if u.startswith(starts)] for x in a], pa.list_(pa.binary()))

    on = defaultdict(Counter)
    if starts:  # words that occur once tell nothing and are left where they are
        rows = sample.where("y = 1").select("fold", F.explode(F.arrow_udf(going, "array<binary>")("t")).alias("w")).groupBy("w", "fold").agg(F.count("*").alias("n"))
        words = rows.groupBy("w").agg(F.sum("n").alias("n"), F.collect_list(F.struct("fold", "n")).alias("by")).where("n > 1")
        for r in words.orderBy(F.desc("n"), "w").limit(GOING_ON * (FOLDS + 1) * 4).collect():
            for x in r.by:
                on[x.fold][bytes(r.w)] += x.n

    def piece(it: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for a in it:
            yield pa.array([b" ".join(x.as_py().split()[:64][-8:]) for x in a], pa.binary())

    # ordinary text for the dictionaries: eight words of each of the first documents in hash order
    some = sample.where("y = 0").orderBy(F.xxhash64("t"), "t").limit(1200).select("fold", F.arrow_udf(piece, "binary")("t").alias("p")).collect()
    out = {}
    for f, c in chosen.items():
        mine = tuple(c)
        words = sum((n for g, n in on.items() if g != f), Counter())
        out[f] = dictionaries(c, Counter({w: n for w, n in words.items() if w.startswith(mine)}) if mine else Counter(), [bytes(r.p) for r in some if r.fold != f])
    return out


def train_toxicity(docs: DataFrame, labels: DataFrame, *, key="doc_id", text="text", label="toxic", per_class: int = 3000, most_words: int = 4000, train=None) -> ToxicityModel:
    """Learn from at most per_class documents of a class; `train` is a condition on the labels' key."""
    seen = labels.select(F.col(key).alias("k"), F.col(label).cast("int").alias("y")).where("k is not null and y in (0, 1)")
    seen = seen.where(crc_mod("k", 3) != 1 if train is None else train)
    total = {r.y: r.n for r in seen.groupBy("y").agg(F.count("*").alias("n")).collect()}
    p = (total.get(1, 0) + 1) / (sum(total.values()) + 2)
    plain = ToxicityModel(weights=[log(p / (1 - p))] + [0.0] * (len(GAINS) + 1))
    if not (total.get(0) and total.get(1)):
        return plain
    sample = training_sample(docs, bounded_sample(seen, "y", "k", per_class), key, text, most_words)
    if sample.select("y").distinct().count() < 2:  # labels without documents
        return plain
    return learn(sample, total)


#: In a worker: the model at hand, and features of texts that it has seen, by their digests, at most REMEMBERED.
_MODELS: dict = {}
REMEMBERED = 1 << 16


def remembered_features(model: ToxicityModel, seen: dict[bytes, np.ndarray], texts: list[str | None]) -> np.ndarray:
    """Features of texts; copies of one text are computed once, while it is remembered."""
    names = [hashlib.blake2b((t or "").encode("utf-8", "surrogatepass"), digest_size=16).digest() for t in texts]
    new = {k: t for k, t in zip(names, texts, strict=True) if k not in seen}
    found = dict(zip(new, model.features([words_of(t) for t in new.values()]), strict=True)) if new else {}
    out = np.array([found[k] if k in found else seen[k] for k in names])
    if len(seen) + len(found) > REMEMBERED:
        seen.clear()
    seen.update(found)
    return out


def score_toxicity(docs: DataFrame, model: ToxicityModel, *, text="text", out="toxicity") -> DataFrame:
    """Add a struct column: score (0 to 1) and hits, the number of windows with a gain of 3 bytes or more."""

    def score(it: Iterator[pa.Array]) -> Iterator[pa.Array]:
        name = hash((model.toxic, model.ordinary))
        if name not in _MODELS:
            _MODELS.clear()
        m, seen = _MODELS.setdefault(name, (model, {}))
        w = np.array(model.weights)
        for a in it:
            parts = [remembered_features(m, seen, a.slice(i, 64).to_pylist()) for i in range(0, len(a), 64)]
            f = np.concatenate(parts) if parts else np.zeros((0, len(w)))
            yield pa.StructArray.from_arrays([pa.array(1 / (1 + np.exp(-np.clip(f @ w, -30, 30)))), pa.array(np.rint(np.expm1(f[:, 2])).astype("int32"))], names=["score", "hits"])

    return docs.withColumn(out, F.arrow_udf(score, "score double, hits int")(text))


def op9_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents").select("doc_id", "text")
    model = train_toxicity(docs, read(spark, sf_dir, "labels"))
    held = F.coalesce(crc_mod("doc_id", 3) == 1, F.lit(False)).alias("held_out")
    score = F.col("toxicity.score")
    return score_toxicity(docs, model).select("doc_id", held, score.alias("score"), F.when(score >= 0.7, 1).otherwise(0).alias("predicted"), F.col("toxicity.hits").alias("hits"))
