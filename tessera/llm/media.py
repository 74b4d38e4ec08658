"""Interleaved documents: ordered text and media references from HTML, payloads joined by digest.

`parse_interleaved` turns a page into a sequence of structs (position, kind, text, ref, caption): texts between tags
in document order, and for each media element its reference, with the caption of its figure or its alt text beside it.
`store_media` keeps payloads as 8-bit mono PCM WAV files keyed by the payload's SHA-256; `read_media` reads them back
and computes features; `resolve_media` joins both by digest, once for each digest however many references there are.

Defined cases: a null page or text counts as empty; an empty page gives no items; references without a payload stay,
with nulls; repeated payloads are stored under one digest and resolve for every reference; unclosed tags end with their
parent or the page. Extra columns are kept by parse_interleaved, but for one named as `out`, which is replaced; the query
ignores them.
"""

import hashlib
import io
import struct
import wave
import zlib
from html.parser import HTMLParser
from typing import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .shared import free_names, materialise, read

UNIT, RATE = 64, 8000
ITEMS = "array<struct<position int, kind string, text string, ref string, caption string>>"
MEDIA = {"img", "video", "audio", "source", "embed"}
SILENT = {"script", "style", "template", "noscript"}
BLOCK = {"p", "div", "h1", "h2", "h3", "h4", "h5", "h6", "li", "ul", "ol", "td", "th", "tr", "table", "article", "section", "figure", "blockquote", "pre", "br", "header", "footer", "nav", "body"}


class Interleaver(HTMLParser):
    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.items: list[list] = []
        self.words: list[str] = []
        self.quiet, self.caption, self.figure = 0, None, None

    def flush(self):
        text = " ".join("".join(self.words).split())
        self.words = []
        if text:
            self.items.append(["text", text, None, None])

    def handle_starttag(self, tag, attrs):
        if tag in SILENT:
            self.quiet += 1
        elif tag in MEDIA and not self.quiet and (ref := dict(attrs).get("src")):
            self.flush()
            self.items.append(["media", None, ref, dict(attrs).get("alt")])
        elif tag == "figcaption":
            self.flush()
            self.caption = []
        elif tag in BLOCK:
            self.flush()
            if tag == "figure":
                self.figure = len(self.items)

    def handle_endtag(self, tag):
        if tag in SILENT:
            self.quiet = max(0, self.quiet - 1)
        elif tag == "figcaption" and self.caption is not None:
            self.end_caption()
        elif tag in BLOCK:
            self.flush()
            if tag == "figure":
                self.end_caption()
                self.figure = None

    def end_caption(self):
        if self.caption is None:
            return
        text, self.caption = " ".join("".join(self.caption).split()), None
        owned = [x for x in self.items[self.figure or 0 :] if x[0] == "media"] if self.figure is not None else []
        for x in owned:
            x[3] = text
        if not owned and text:
            self.items.append(["text", text, None, None])

    def handle_data(self, data):
        if not self.quiet:
            (self.words if self.caption is None else self.caption).append(data)


def interleave(html: str | None) -> list[tuple]:
    p = Interleaver()
    p.feed(html or "")
    p.close()
    p.end_caption()
    p.flush()
    return [(i, *x) for i, x in enumerate(p.items)]


def sequences(pages: pa.Array, most: int = 1 << 20) -> pa.Array:
    """The items of pages, parsed in cuts of about `most` bytes, so that few pages are held as Python objects at a time."""
    kinds = (pa.int32(), pa.string(), pa.string(), pa.string(), pa.string())
    names, at, out = ("position", "kind", "text", "ref", "caption"), 0, []
    ends = np.cumsum(pc.fill_null(pc.binary_length(pages), 0).to_numpy(zero_copy_only=False))
    while at < len(pages) or not out:
        upto = max(at + 1, int(np.searchsorted(ends, (ends[at - 1] if at else 0) + most))) if len(pages) else 0
        found = [interleave(h.as_py()) for h in pages[at:upto]]
        cols = list(zip(*(x for items in found for x in items), strict=True)) or [()] * 5
        items = pa.StructArray.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds, strict=True)], names=names)
        out.append(pa.ListArray.from_arrays(np.cumsum([0, *map(len, found)], dtype=np.int32), items))
        at = max(upto, 1)
    return pa.concat_arrays(out)


def parse_interleaved(pages: DataFrame, *, html="html", out="items") -> DataFrame:
    """Add the page's sequence of items."""

    def run(it: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for a in it:
            yield sequences(a)

    return pages.withColumn(out, F.arrow_udf(run, ITEMS)(html))


def encode_wav(payload: bytes) -> bytes:
    f = io.BytesIO()
    with wave.open(f, "wb") as w:
        w.setnchannels(1)
        w.setsampwidth(1)
        w.setframerate(RATE)
        w.writeframes(payload)
    return f.getvalue()


def decode_wav(media: bytes) -> bytes:
    with wave.open(io.BytesIO(media), "rb") as w:
        return w.readframes(w.getnframes())


def padded(text: str | None) -> tuple[int, bytes]:
    b = (text or "").encode("utf-8", "surrogatepass")
    return len(b), b + bytes(-len(b) % UNIT if b else UNIT)


def payload_column(text: str) -> F.Column:
    """The padded payload as an expression: UTF-8 and zero bytes up to a positive multiple of UNIT."""
    b = F.coalesce(F.encode(F.col(text), "UTF-8"), F.lit(b""))
    n = F.octet_length(b)
    pad = F.when(n == 0, UNIT).otherwise((-n) % UNIT + F.when((-n) % UNIT < 0, UNIT).otherwise(0))
    return F.concat(b, F.substring(F.lit(bytes(UNIT)), F.lit(1), pad))


def store_media(payloads: DataFrame, *, payload="payload") -> DataFrame:
    """digest, media: each payload as a WAV file in the shared folder. A digest may be there from several partitions."""

    def run(it: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for a in it:
            yield pa.array([encode_wav(x.as_py()) for x in a], pa.binary())

    rows = payloads.select(F.sha2(payload, 256).alias("digest"), F.arrow_udf(run, "binary")(payload).alias("media"))
    return materialise(rows)


def features(samples: bytes) -> str:
    x = np.frombuffer(samples, dtype=np.uint8).astype(np.int64)
    d = x - 128
    crossings = int(np.count_nonzero((d[1:] < 0) != (d[:-1] < 0)))
    return f"wav8k1;n={len(x)};sum={int(x.sum())};energy={int((d * d).sum())};peak={int(np.abs(d).max())};crossings={crossings}"


def read_media(store: DataFrame) -> DataFrame:
    """Narrow rows, one for each digest: what the stored bytes hold."""

    def run(it: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for a in it:
            rows = []
            for x in a:
                media = x.as_py()
                samples = decode_wav(media)
                rows.append((len(samples), hashlib.sha256(samples).hexdigest(), zlib.crc32(samples[-UNIT:]), len(media), hashlib.sha256(media).hexdigest(), features(samples)))
            cols = list(zip(*rows, strict=True)) if rows else [()] * 6
            kinds = (pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string())
            yield pa.StructArray.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds, strict=True)], names=["payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature"])

    kind = "payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string"
    return store.select("digest", F.arrow_udf(run, kind)("media").alias("m")).select("digest", "m.*").dropDuplicates(["digest"])


def resolve_media(items: DataFrame, media: DataFrame, *, ref="ref") -> DataFrame:
    """Join rows with a reference sha256:<digest> to what was read; texts and unknown references keep nulls. A column of
    media whose name the items have takes a longer one."""
    named = media.toDF(*free_names(items, *media.columns))
    digest = named.columns[media.columns.index("digest")]
    wanted = F.regexp_extract(F.coalesce(ref, F.lit("")), "^sha256:([0-9a-f]{64})$", 1)
    return items.join(named, wanted == F.col(digest), "left")


def interleaved_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The whole pages as interleaved sequences: a row for each item in its place. The pages here refer to no payload."""
    return parse_interleaved(read(spark, sf_dir, "pages")).select("page_id", F.explode("items").alias("i")).select("page_id", "i.*")


def op1_interleaved_media(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each document becomes a page with its payload as the figure; the page is parsed and its reference resolved."""
    docs = read(spark, sf_dir, "documents").select("doc_id", F.octet_length(F.encode(F.coalesce("text", F.lit("")), "UTF-8")).cast("long").alias("n_bytes"), payload_column("text").alias("payload"))
    media = read_media(store_media(docs))
    page = F.concat(F.lit("<article><h1>document</h1><figure><img src='sha256:"), F.sha2("payload", 256), F.lit("'><figcaption>payload of "), F.col("n_bytes").cast("string"), F.lit(" bytes</figcaption></figure></article>"))
    pages = docs.select("doc_id", "n_bytes", page.alias("html"))
    items = parse_interleaved(pages).select("doc_id", "n_bytes", F.explode("items").alias("i")).select("doc_id", "n_bytes", "i.*").where("kind = 'media'")
    return resolve_media(items, media).select("doc_id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature", "position", "caption")
