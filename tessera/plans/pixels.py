"""Queries over pixel grids, whose pixels are the bytes of documents."""

from pyspark.sql import functions as F

from ..functions import grids
from ..operators import joins
from .views import read

Q: dict = {}
S: dict = {}


def query(sql: str | None = None):
    def add(f):
        Q[f.__name__] = f
        if sql:
            S[f.__name__] = sql
        return f

    return add


def pictures(spark, d, height: int = 12, width: int = 12, channels: int = 3):
    x = read(spark, d, "documents")
    return x.select("doc_id", "lang", *[c.alias(k) for k, c in grids.text_grid(F.col("text"), height, width, channels).items()])


def of_grid(f):
    return f(*map(F.col, grids.GRID))


def sql_pixels(height: int, width: int, channels: int) -> str:
    """px: doc_id, lang, y, x, c and v of each pixel."""
    size = height * width * channels
    return f"""b as (select doc_id, lang, hex(encode(repeat(text, ceil({size} / strlen(text)::double)::int))) as h from documents where strlen(text) > 0),
px as (select doc_id, lang, i // {width * channels} as y, (i // {channels}) % {width} as x, i % {channels} as c, ('0x' || substr(h, 2 * i + 1, 2))::int as v from (select *, unnest(range({size})) as i from b))"""


SQL_HASH = f"""{sql_pixels(16, 18, 1)}, ce as (select doc_id, y // 2 as r, x // 2 as k, sum(v) as s from px group by all),
bi as (select doc_id, r * 8 + k - 1 as i, (s > lag(s) over (partition by doc_id, r order by k))::int as bit from ce qualify k > 0),
ni as (select doc_id, i // 4 as n, sum(bit << (3 - i % 4)::int)::int as v from bi group by all),
ha as (select doc_id, string_agg(substr('0123456789abcdef', v + 1, 1), '' order by n) as dhash64 from ni group by doc_id)"""


@query(f"with {SQL_HASH} select doc_id, dhash64 from documents left join ha using (doc_id)")
def grid_hashes(spark, d):
    """The difference hash of 16 by 18 grey pixels."""
    return pictures(spark, d, 16, 18, 1).select("doc_id", of_grid(grids.fingerprint).alias("s")).select("doc_id", "s.dhash64")


@query(f"with {SQL_HASH}, h as (select doc_id, dhash64 from documents left join ha using (doc_id)) select doc_id, count(*) over (partition by dhash64) as n_same, min(doc_id) over (partition by dhash64) as first from h")
def hash_aliases(spark, d):
    """How many pictures share a hash, and the first of them."""
    h = grid_hashes(spark, d).withColumnRenamed("doc_id", "name")
    return joins.aliases(h, fingerprint="dhash64", name="name").select(F.col("name").alias("doc_id"), "n_same", "first")


@query(f"""with {sql_pixels(12, 12, 3)}, p as (select doc_id, c, avg(v & 1) as p from px group by all), e as (select doc_id, avg(case when p in (0, 1) then 0 else -(p * log2(p) + (1 - p) * log2(1 - p)) end) as e from p group by doc_id),
t as (select a.doc_id, avg(((a.v & 1) <> (r.v & 1))::int) filter (r.x = a.x + 1) as across, avg(((a.v & 1) <> (r.v & 1))::int) filter (r.y = a.y + 1) as down from px a join px r on a.doc_id = r.doc_id and a.c = r.c and ((r.x = a.x + 1 and r.y = a.y) or (r.y = a.y + 1 and r.x = a.x)) group by a.doc_id)
select doc_id, round(e, 4) as lsb_entropy, round((across + down) / 2, 4) as transition_rate, 0.0::double as diagonal_share, round(least(45, greatest(0, e - 0.985) * 900 + greatest(0, 0.018 - abs((across + down) / 2 - 0.5)) * 700), 1) as score from documents left join e using (doc_id) left join t using (doc_id)""")
def hidden_traces(spark, d):
    """Lowest bits: their entropy, how often neighbours differ, and the score."""
    s = pictures(spark, d).select("doc_id", of_grid(grids.traces).alias("s"))
    return s.select("doc_id", "s.lsb_entropy", "s.transition_rate", "s.diagonal_share", "s.score")


@query(f"""with {sql_pixels(12, 12, 3)}, n as (select lang, c, v, count(*) as n from px group by all), g as (select distinct lang from px)
select g.lang, cc::int as channel, bb::int as bin, coalesce(n.n, 0)::bigint as n from g, range(3) c(cc), range(256) b(bb) left join n on n.lang is not distinct from g.lang and n.c = cc and n.v = bb""")
def channel_histograms(spark, d):
    """Pixels of each value by language and channel."""
    return grids.histograms(pictures(spark, d), "lang")


@query(f"""with {sql_pixels(12, 12, 3)}, l as (select doc_id, y, x, avg(v / 255.0::double) as lum, (max(v) - min(v)) / 255.0::double as sat from px group by all),
c as (select doc_id, avg(s) as chroma_std from (select doc_id, c, stddev_pop(v / 255.0::double) as s from px group by all) group by doc_id),
m as (select doc_id, avg(lum) as mean_lum, stddev_pop(lum) as std_lum, avg(sat) as sat_mean, avg((lum < 0.02)::int) as clip_low, avg((lum > 0.98)::int) as clip_high from l group by doc_id),
st as (select doc_id, x, abs(lead(lum) over (partition by doc_id, y order by x) - lum) as d from l), bl as (select doc_id, avg(d) filter (x % 8 = 7) / greatest(avg(d), 1e-9) as blockiness from st group by doc_id)
select doc_id, round(mean_lum, 6) as mean_lum, round(std_lum, 6) as std_lum, round(chroma_std, 6) as chroma_std, round(sat_mean, 6) as sat_mean, clip_low, clip_high, round(blockiness, 6) as blockiness from documents left join m using (doc_id) left join c using (doc_id) left join bl using (doc_id)""")
def pixel_measures(spark, d):
    """Low-level statistics of each picture."""
    s = pictures(spark, d).select("doc_id", of_grid(grids.measures).alias("s"))
    return s.select("doc_id", *[F.round(f"s.{c}", 6).alias(c) for c in ("mean_lum", "std_lum", "chroma_std", "sat_mean", "clip_low", "clip_high", "blockiness")])


@query(f"""with {sql_pixels(12, 12, 3)}, p as (select doc_id, y, x, max(v) as hi, min(v) as lo, sum(case c when 0 then (v // 8) * 1024 when 1 then (v // 8) * 32 else v // 8 end) as q, avg(v) as tone from px group by all),
s as (select doc_id, avg(case when hi > 0 then (hi - lo) / hi::double else 0 end) as sat_mean, count(distinct q) / 144.0::double as uniq_colors from p group by doc_id),
gx as (select doc_id, x, avg(d) as v from (select doc_id, x, abs(lead(tone) over (partition by doc_id, y order by x) - tone) as d from p) where d is not null group by all),
gy as (select doc_id, y, avg(d) as v from (select doc_id, y, abs(lead(tone) over (partition by doc_id, x order by y) - tone) as d from p) where d is not null group by all),
sx as (select doc_id, avg((gx.v > 4 * (m + 1e-6))::int) as s from gx join (select doc_id, median(v) as m from gx group by 1) using (doc_id) group by 1), sy as (select doc_id, avg((gy.v > 4 * (m + 1e-6))::int) as s from gy join (select doc_id, median(v) as m from gy group by 1) using (doc_id) group by 1)
select doc_id, round(sat_mean, 6) as sat_mean, round(uniq_colors, 6) as uniq_colors, round((sx.s + sy.s) / 2, 6) as axis_edges from documents left join s using (doc_id) left join sx using (doc_id) left join sy using (doc_id)""")
def genre_measures(spark, d):
    """Colours, saturation and lines along the axes of each picture."""
    s = pictures(spark, d).select("doc_id", of_grid(grids.genre_of).alias("s"))
    return s.select("doc_id", *[F.round(f"s.{c}", 6).alias(c) for c in ("sat_mean", "uniq_colors", "axis_edges")])


@query()
def spectral_scores(spark, d):
    """The spectrum of 64 by 64 grey pixels: ring against disc, peak, score; and the diagonal's share of Haar details."""
    p = pictures(spark, d, 64, 64, 1)
    s = p.select("doc_id", of_grid(grids.spectrum).alias("s"), of_grid(grids.traces).alias("t"))
    return s.select("doc_id", "s.*", "t.diagonal_share")


@query()
def mean_spectra(spark, d):
    """The mean log spectrum of each language's pictures."""
    return grids.mean_spectrum(pictures(spark, d, 16, 16, 1), "lang").select("lang", "i", F.round("magnitude", 6).alias("magnitude"))
