"""Language identification by compression: per-language raw-content zstandard dictionaries, the smallest total wins.

A dictionary holds whole pieces of at most `per_lang` sampled documents of its language (by the hash of the key), dealt
out evenly over them up to `dict_bytes`. A text is cut into chunks of `CHUNK` bytes at spaces; each is compressed on its
own against every dictionary, so long texts keep using it. The language with the least total wins, the first in code
point order among equals. The score is the share of the winner when totals are weighed by exp(-saved bytes); a margin
to the second of under `margin` (relative) marks the text as rejected.

Defined cases: a null text or one without a letter is `und`, with score 0 and not rejected; without any learnable row
every text is `und`; null languages are never learned; a null key is not held out; of learnable rows that agree in key
and language one counts, the one with the least text; an empty table gives an empty result. A column named as `out` is
replaced, other extra columns are kept.
"""

from math import exp
from typing import Iterator

import pyarrow as pa
import regex
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .shared import bounded_sample, crc_mod, read

CHUNK, LEVEL = 2048, 3
#: Each chunk stands between these. zstandard starts no match in the last 8 bytes, and stores small blocks that do not
#: shrink as they are: without them a text of a few words has the same size in every language.
CARRIER, TAIL = b"0123456789ABCDEFGHIJ", b"}{~^][><"
LETTER = regex.compile(r"\p{L}")


def chunks(data: bytes, size: int = CHUNK) -> Iterator[bytes]:
    at = 0
    while len(data) - at > size:
        cut = data.rfind(b" ", at + 1, at + size) + 1 or at + size
        yield data[at:cut]
        at = cut
    if at < len(data):
        yield data[at:]


def content(texts: list[bytes], most: int) -> bytes:
    """Pieces of all texts in turn, a piece from each, until `most` bytes are there."""
    pieces, out, held, at = [list(chunks(t, 512)) for t in texts], [], 0, 0
    while held < most and any(at < len(p) for p in pieces):
        for p in pieces:
            if at < len(p) and held < most:
                out.append(p[at])
                held += len(p[at])
        at += 1
    return b"\n".join(reversed(out))[-most:]


def train_languages(docs: DataFrame, *, key="doc_id", text="text", lang="lang", per_lang: int = 200, max_langs: int = 500, dict_bytes: int = 65536, train=None) -> dict[str, bytes]:
    """Dictionaries by language, from per_lang documents each; more than max_langs languages are an error. So at most
    per_lang * max_langs pieces of dict_bytes come to the driver."""
    seen = docs.select(F.col(key).alias("k"), F.col(lang).alias("l")).where("k is not null and l is not null")
    seen = seen.where(crc_mod("k", 4) != 2 if train is None else train)
    chosen = bounded_sample(seen.distinct(), "l", "k", per_lang, max_langs)
    full = docs.select(F.col(key).alias("k"), F.col(lang).alias("l"), F.col(text).alias("t")).where("t is not null")

    def piece(it: Iterator[pa.Array]) -> Iterator[pa.Array]:
        """Up to dict_bytes of a text, in pieces spread over all of it."""
        for a in it:
            out = []
            for x in a:
                data = x.as_py().encode("utf-8", "surrogatepass").lower()
                step = max(1, -(-len(data) // dict_bytes))
                out.append(b"".join(data[i : i + 512] for i in range(0, len(data), 512 * step)))
            yield pa.array(out, pa.binary())

    one = full.join(F.broadcast(chosen), ["k", "l"]).groupBy("l", "k").agg(F.min("t").alias("t"))
    by: dict[str, list[bytes]] = {}
    for r in sorted(one.select("k", "l", F.arrow_udf(piece, "binary")("t").alias("t")).collect(), key=lambda r: (r.l, r.k)):
        by.setdefault(r.l, []).append(bytes(r.t))
    return {k: content(v, dict_bytes) for k, v in sorted(by.items())}


def identify(docs: DataFrame, dicts: dict[str, bytes], *, text="text", out="language", margin: float = 0.01) -> DataFrame:
    """Add a struct column: lang, score, margin (relative, to the second) and rejected."""
    names = sorted(dicts)

    def classify(it: Iterator[pa.Array]) -> Iterator[pa.Array]:
        made = []
        for k in names:
            d = zstandard.ZstdCompressionDict(dicts[k] + CARRIER, dict_type=zstandard.DICT_TYPE_RAWCONTENT)
            d.precompute_compress(level=LEVEL)
            made.append(zstandard.ZstdCompressor(level=LEVEL, dict_data=d, write_content_size=False, write_checksum=False, write_dict_id=False))
        for a in it:
            rows = []
            for x in a:
                t = x.as_py()
                if not made or not t or not LETTER.search(t):
                    rows.append(("und", 0.0, 0.0, False))
                    continue
                sizes = [0] * len(made)
                for c in chunks(t.encode("utf-8", "surrogatepass").lower()):
                    for i, m in enumerate(made):
                        sizes[i] += len(m.compress(CARRIER + c + TAIL))
                best = min(range(len(made)), key=lambda i: sizes[i])
                gap = min((sizes[i] - sizes[best] for i in range(len(made)) if i != best), default=sizes[best]) / max(1, sizes[best])
                score = 1 / sum(exp(-min(60.0, (s - sizes[best]) * 0.25)) for s in sizes)
                rows.append((names[best], score, gap, gap < margin))
            lang, score, gap, rejected = zip(*rows, strict=True) if rows else ((), (), (), ())
            yield pa.StructArray.from_arrays([pa.array(lang, pa.string()), pa.array(score, pa.float64()), pa.array(gap, pa.float64()), pa.array(rejected, pa.bool_())], names=["lang", "score", "margin", "rejected"])

    return docs.withColumn(out, F.arrow_udf(classify, "lang string, score double, margin double, rejected boolean")(text))


def op5_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    dicts = train_languages(docs)
    held = F.coalesce(crc_mod("doc_id", 4) == 2, F.lit(False)).alias("held_out")
    out = identify(docs.select("doc_id", "text"), dicts)
    return out.select("doc_id", held, F.col("language.lang").alias("lang_pred"), F.col("language.score").alias("score"), F.col("language.margin").alias("margin"), F.col("language.rejected").alias("rejected"))
