"""Queries over texts and containers: terms, rules, attribution, verdicts, JSON, streams and learned heads."""

import uuid

from pyspark.sql import functions as F

from ..functions import binary, provenance, text as T
from ..operators import learning
from ..session import shared_folder
from ..streaming import resumable
from .views import SQL_SCORES, read, scores

Q: dict = {}
S: dict = {}


def query(sql: str | None = None):
    def add(f):
        Q[f.__name__] = f
        if sql:
            S[f.__name__] = sql
        return f

    return add


def sql_terms(col: str, terms) -> str:
    return f"list_filter([{', '.join(repr(t) for t in sorted(set(terms)))}], lambda t: contains(lower(coalesce({col}, '')), t))"


@query(f"select doc_id, array_to_string({sql_terms('text', provenance.AI_TERMS)}, '|') as ai, array_to_string({sql_terms('text', provenance.EDITOR_TERMS)}, '|') as editor from documents")
def term_match(spark, d):
    x = read(spark, d, "documents")
    return x.select("doc_id", F.array_join(T.terms_in(F.col("text"), provenance.AI_TERMS), "|").alias("ai"), F.array_join(T.terms_in(F.col("text"), provenance.EDITOR_TERMS), "|").alias("editor"))


#: Metadata texts made of pieces that events choose, so that rules of every kind meet rows alone and together.
TEXT = """(case event_id % 7 when 0 then 'Software: Photoshop ' when 1 then 'steps: 20 ' when 2 then 'Flux of ' || event_type || ' ' when 3 then 'Midjourney v6 ' when 4 then 'linseed oil ' else '' end
|| case event_id % 11 when 0 then '<x:xmpmeta><a:Credit>Made with ' || event_type || ' Google AI</a:Credit></x:xmpmeta>' when 1 then '<x:xmpmeta><a:Credit>' || event_type || '</a:Credit><b:DigitalSourceType>cv/trainedAlgorithmicMedia</b:DigitalSourceType><c:CreatorTool>DALL-E of ' || event_type || '</c:CreatorTool></x:xmpmeta>'
when 2 then '<x:xmpmeta><b:DigitalSourceType>compositeWithTrainedAlgorithmicMedia</b:DigitalSourceType><s:Source>DeepMind</s:Source></x:xmpmeta>' when 3 then '<x:xmpmeta><a:Credit>' || event_type || '</a:Credit><s:Software>Adobe ' || event_type || '</s:Software></x:xmpmeta>' when 4 then '<x:xmpmeta><s:Source>Imagen</s:Source>' else '' end
|| case event_id % 5 when 0 then 'c2pa jumbf "claim_generator": "' || event_type || '_maker/1", "softwareAgent": "Agent ' || event_type || '" "action": "c2pa.' || event_type || '" ' when 1 then 'C2PA claimGenerator=OpenAI/' || event_type || ' ' when 2 then 'Content Credentials by catx ' else '' end
|| case event_id % 13 when 0 then 'SynthID ' when 1 then 'made by OpenAI, prompt ' when 2 then 'Imagen 3 ' when 3 then 'google ' when 4 then 'software_agent: gpt-image-1' when 5 then 'urn:trainedAlgorithmicMedia' else '' end)"""


def metadata(spark, d):
    return read(spark, d, "events").select("event_id", F.expr(TEXT).alias("text"), F.round(F.pmod(F.col("event_id") * 37, F.lit(101)) / 100.0, 2).alias("p_fake"))


def sql_any(col: str, *terms: str) -> str:
    return "(" + " or ".join(f"contains({col}, '{t}')" for t in terms) + ")"


OPENAI = ("openai", "chatgpt", "dall-e", "dalle", "dall·e", "gpt-image")
#: The same rules in SQL, read from the texts: XMP fields x_*, claims c_*, then hits and the attribution.
SQL_META = rf"""t as (select event_id, {TEXT} as x, round((event_id * 37 % 101) / 100.0::double, 2) as p_fake from events),
pk as (select *, lower(x) as l, case when contains(x, '<x:xmpmeta') and contains(x, '</x:xmpmeta>') then x else '' end as pk from t),
xf as (select *, nullif(trim(regexp_extract(pk, '<[a-z]+:Credit>([^<]*)<', 1)), '') as x_credit, nullif(trim(regexp_extract(pk, '<[a-z]+:Source>([^<]*)<', 1)), '') as x_source, nullif(trim(regexp_extract(pk, '<[a-z]+:DigitalSourceType>([^<]*)<', 1)), '') as x_kind,
  coalesce(nullif(trim(regexp_extract(pk, '<[a-z]+:Software>([^<]*)<', 1)), ''), nullif(trim(regexp_extract(pk, '<[a-z]+:CreatorTool>([^<]*)<', 1)), '')) as x_software, nullif(trim(regexp_extract(pk, '<[a-z]+:CreatorTool>([^<]*)<', 1)), '') as x_creator,
  {sql_any("l", "c2pa", "contentauth", "content credentials")} as m_c2pa, {sql_any("l", "jumb", "jumd", "c2ma", "c2cs", "c2as", "catx")} as m_jumbf from pk),
cl as (select *, case when m_c2pa or m_jumbf then coalesce(nullif(regexp_extract(x, '(?i)claim_?generator["'']?\s*[:=]?\s*["'']?([^"'',}}\s]+)', 1), ''), case when contains(l, 'c2pa') or contains(l, 'jumb') then case when contains(l, 'openai') then 'OpenAI' when contains(l, 'google') then 'Google' end end) end as c_claimer,
  case when m_c2pa or m_jumbf then coalesce(nullif(trim(regexp_extract(x, '(?i)software_?agent["'']?\s*[:=]?\s*["'']?([^"'',}}
]+)', 1)), ''), case {" ".join(f"when contains(l, '{k}') then '{v}'" for k, v in provenance.AGENTS)} end) end as c_agent,
  case when m_c2pa or m_jumbf then nullif(regexp_extract(x, '(?i)action["'']?\s*[:=]?\s*["'']?([^"'',}}\s]+)', 1), '') end as c_action, case when (m_c2pa or m_jumbf) and contains(l, 'trainedalgorithmicmedia') then 'trainedAlgorithmicMedia' end as c_kind from xf),
cr as (select *, coalesce(lower(c_claimer), '') as lc, coalesce(lower(c_agent), '') as la, c_kind is not null or {sql_any("coalesce(lower(c_agent), '')", *provenance.AI_AGENTS)} or {sql_any("coalesce(lower(c_claimer), '')", *provenance.AI_CLAIMERS)} as c_ai, lower(concat_ws(chr(10), x, c_claimer, c_agent)) as corpus,
  coalesce(lower(x_credit), '') as xc, contains(coalesce(lower(x_kind), lower(c_kind), ''), 'trainedalgorithmicmedia') as made, {sql_terms("x", provenance.AI_TERMS)} as ai, {sql_terms("x", provenance.EDITOR_TERMS)} as editor, {sql_terms("x", provenance.WATERMARK_TERMS)} as marks from cl),
g as (select *, greatest(case when contains(corpus, 'synthid') then 0.98 end, case when made and ({sql_any("xc", "google", "deepmind")} or {sql_any("lower(concat_ws(' ', x_software, x_source, x_creator))", "google", "deepmind", "gemini", "imagen")}) then 0.99 when {sql_any("xc", "google", "deepmind")} then 0.95 end,
  case when {sql_any("lc", "google", "deepmind", "imagen", "gemini")} or {sql_any("la", "gemini", "imagen", "google")} then 0.99 end)::double as g1, greatest(case when {sql_any("lc || ' ' || la", *OPENAI)} then 0.99 when c_ai and {sql_any("corpus", *OPENAI)} then 0.97 end, case when {sql_any("coalesce(lower(x_software), '')", *OPENAI)} then 0.99 end)::double as o1 from cr),
h as (select *, coalesce(g1, case when {sql_any("corpus", "gemini", "imagen 2", "imagen 3", "google imagen", "deepmind imagen")} then 0.9::double end) as g, coalesce(o1, case when contains(corpus, 'openai') and {sql_any("corpus", "dall-e", "dall·e", "prompt", "generation", "gpt-image")} then 0.92::double end) as o from g),
a as (select *, case when g is not null then 'Google Gemini' when o is not null then 'OpenAI ChatGPT' when len(ai) > 0 then case when list_has_any(ai, ['stable diffusion', 'automatic1111', 'comfyui', 'flux']) then 'Stable Diffusion' when list_contains(ai, 'midjourney') then 'Midjourney' when list_contains(ai, 'firefly') then 'Adobe Firefly' else 'AI Generator' end
  when c_ai then coalesce(c_claimer, 'AI Certified') else 'None' end as provider, coalesce(g, o, case when len(ai) > 0 then 0.95::double when c_ai then 0.98::double end, 0.0::double) as confidence from h)"""


@query(f"with {SQL_META} select event_id, provider, confidence from a")
def rule_attribution(spark, d):
    return provenance.attribution(provenance.rules(metadata(spark, d))).select("event_id", "provider", "confidence")


@query(f"with {SQL_META} select provider, confidence, count(*) as n from a group by all")
def attribution_counts(spark, d):
    return provenance.attribution(provenance.rules(metadata(spark, d))).groupBy("provider", "confidence").agg(F.count("*").alias("n"))


@query(f"with {SQL_META} select event_id, case when (confidence >= 0.85 and provider <> 'None') or p_fake >= 0.5 then 'FAKE' else 'REAL' end as label, case when confidence >= 0.85 and provider <> 'None' then greatest(p_fake, confidence) else p_fake end as p, confidence >= 0.85 and provider <> 'None' as overridden from a")
def consensus_override(spark, d):
    a = provenance.attribution(provenance.rules(metadata(spark, d)))
    return a.select("event_id", provenance.consensus(F.col("p_fake"), F.col("provider"), F.col("confidence")).alias("c")).select("event_id", "c.*")


@query(f"with {SQL_META} select event_id, case when g is not null or o is not null or len(ai) > 0 then 'strong evidence found' when len(editor) > 0 or len(marks) > 0 then 'heuristic indicators found' else 'no provenance indicator found' end as summary from a")
def provenance_signals(spark, d):
    return provenance.signals(provenance.rules(metadata(spark, d))).select("event_id", "summary")


@query(f"with {SQL_META} select event_id, x_credit as credit, x_software as software, x_source as source, x_kind as digital_source_type from xf")
def xmp_fields(spark, d):
    x = metadata(spark, d).select("event_id", provenance.xmp_fields(provenance.xmp_packet(F.col("text"))).alias("x"))
    return x.select("event_id", "x.credit", "x.software", "x.source", "x.digital_source_type")


@query("""with m as (select event_id, round((event_id * 37 % 101) / 100.0::double, 2) as p from events) select event_id, case when p >= 0.5 then 'FAKE' else 'REAL' end as label, round(case when p >= 0.5 then p else 1 - p end * 100, 2) as confidence, round((1 - p) * 100, 2) as real_pct, round(p * 100, 2) as fake_pct from m""")
def verdict_records(spark, d):
    return metadata(spark, d).select("event_id", provenance.verdict(F.col("p_fake")).alias("v")).select("event_id", "v.*")


@query("""with e as (select event_id, event_id % 2 = 0 as fake, (event_id % 100)::double as conf, (event_id * 13 % 1000)::double as lap, (event_id % 60)::double as sat, (event_id % 100) / 100.0 as sym, (event_id % 90) / 100.0 as hf, event_id % 7 = 0 as att from events),
c as (select event_id, case when fake then list_filter([case when att then 'provenance' end, case when conf > 90 and not att then 'very confident' end, case when lap < 300 then 'smooth texture' end, case when lap > 800 then 'hyper-detailed texture' end, case when sat < 30 then 'uniform saturation' end, case when sym > 0.85 then 'high symmetry' end, case when hf > 0.72 then 'much high frequency' end, case when hf < 0.58 then 'little high frequency' end], lambda x: x is not null)
else list_filter([case when att then 'provenance' end, 'natural texture', 'consistent lighting', case when conf > 90 then 'very confident' end, 'camera noise'], lambda x: x is not null) end as l from e)
select event_id, array_to_string((case when len(l) = 0 then ['pattern inconsistencies'] else l end)[1:4], '; ') as says from c""")
def explanations(spark, d):
    i = F.col("event_id")
    x = provenance.explanations(F.when(i % 2 == 0, "FAKE").otherwise("REAL"), (i % 100).cast("double"), i % 7 == 0, (i * 13 % 1000).cast("double"), (i % 60).cast("double"), (i % 100) / 100.0, (i % 90) / 100.0)
    return read(spark, d, "events").select("event_id", F.array_join(x, "; ").alias("says"))


@query("""select event_id, case when event_id % 7 = 0 then case event_id % 4 when 0 then 'Google Gemini (Imagen 2)' when 1 then 'ChatGPT (DALL-E 3)' when 2 then 'Midjourney' else 'AI Generator (imagen 2)' end when event_id % 2000 >= 1024 then case when (event_id % 90) / 100.0 > 0.72 then 'SDXL (Stable Diffusion XL)' when event_id * 13 % 1000 > 700 then 'Midjourney v6' else 'SDXL / FLUX' end when event_id * 13 % 1000 > 800 and event_id % 150 > 100 then 'Midjourney' when (event_id % 100) / 100.0 > 0.96 and event_id * 13 % 1000 > 500 then 'FLUX.1'
when event_id % 150 > 80 and event_id * 13 % 1000 < 600 then 'Stable Diffusion 1.5/2.1' when event_id * 13 % 1000 < 300 then 'DALL-E 3' else 'Stable Diffusion / Midjourney' end as generator from events""")
def likely_generator(spark, d):
    i = F.col("event_id")
    who = F.element_at(F.array(*[F.lit(x) for x in ("Google Gemini", "OpenAI ChatGPT", "Midjourney", "AI Generator")]), (i % 4 + 1).cast("int"))
    provider = F.when(i % 7 == 0, who).otherwise("None")
    g = provenance.likely_generator(provider, F.when(i % 7 == 0, 0.9).otherwise(0.0), F.lit("imagen 2"), long_edge=F.greatest(i % 2000, F.lit(100)), high_freq=(i % 90) / 100.0, ratio=(i % 100) / 100.0, texture=i * 13 % 1000, saturation=i % 150)
    return read(spark, d, "events").select("event_id", g.alias("generator"))


@query(f"with {SQL_META} select event_id, c_claimer as claim_generator, c_agent as software_agent, c_action as action, c_kind as digital_source_type, m_c2pa as c2pa_marker, m_jumbf as jumbf_marker, c_ai as is_ai_generated from cr where m_c2pa or m_jumbf")
def content_credentials(spark, d):
    """Credentials read from texts."""
    c = metadata(spark, d).select("event_id", provenance.credentials(F.col("text")).alias("c")).where("c is not null")
    return c.select("event_id", "c.claim_generator", "c.software_agent", "c.action", "c.digital_source_type", "c.c2pa_marker", "c.jumbf_marker", "c.is_ai_generated")


def head(kind: int, n):
    """The head of a CBOR item of a major type, as short as its argument allows."""
    at = lambda low, width: F.concat(F.unhex(F.hex(F.lit(kind * 32 + low))), F.unhex(F.lpad(F.hex(n), 2 * width, "0")))
    return F.when(n < 24, F.unhex(F.hex(n + kind * 32))).when(n < 256, at(24, 1)).when(n < 65536, at(25, 2)).otherwise(at(26, 4))


def cbor_text(value):
    body = F.encode(value, "UTF-8")
    return F.concat(head(3, F.octet_length(body)), body)


def box(kind: str, body):
    return F.concat(F.unhex(F.lpad(F.hex(F.octet_length(body) + 8), 8, "0")), F.lit(kind.encode()), body)


def credential_files(spark, d):
    """Documents as files: a map of claims (one is a number, one a whole text) in CBOR, in boxes, in a PNG chunk."""
    x = read(spark, d, "documents").withColumn("text", F.coalesce("text", F.lit("")))
    claims = [("title", cbor_text(F.col("text"))), ("claim_generator", cbor_text(F.concat(F.coalesce("source", F.lit("")), F.lit("/"), F.coalesce("lang", F.lit("")))))]
    action = F.when(F.col("doc_id") % 3 == 0, head(0, F.col("doc_id"))).otherwise(cbor_text(F.concat(F.lit("c2pa."), F.coalesce("lang", F.lit("")))))
    agent = F.when(F.col("doc_id") % 4 == 0, cbor_text(F.substring("text", 1, 60))).otherwise(F.concat(F.lit(b"\x82\xf5"), cbor_text(F.lit("in a list"))))
    items = F.concat(F.lit(b"\xa4"), *[part for k, v in [*claims, ("action", action), ("softwareAgent", agent)] for part in (cbor_text(F.lit(k)), v)])
    store = box("jumb", F.concat(box("jumd", F.lit(b"c2pa")), box("cbor", items)))
    chunk = lambda name, body: F.concat(F.unhex(F.lpad(F.hex(F.octet_length(body)), 8, "0")), F.lit(name), body, F.lit(b"\0\0\0\0"))
    text_chunk = F.when(F.col("doc_id") % 2 == 0, chunk(b"tEXt", F.encode(F.coalesce("source", F.lit("")), "UTF-8"))).otherwise(F.lit(b""))
    png = F.concat(F.lit(b"\x89PNG\r\n\x1a\n"), chunk(b"IHDR", F.lit(b"\0" * 13)), text_chunk, chunk(b"caBX", store), chunk(b"IEND", F.lit(b"")), F.encode(F.substring("text", 1, 5), "UTF-8"))
    return x.select("doc_id", png.alias("content"))


@query("""with x as (select doc_id, coalesce(source, '') || '/' || coalesce(lang, '') as claimer, case when doc_id % 3 <> 0 then 'c2pa.' || coalesce(lang, '') end as action, case when doc_id % 4 = 0 then nullif(substr(coalesce(text, ''), 1, 60), '') end as agent from documents)
select doc_id, claimer as claim_generator, action, agent as software_agent from x""")
def credential_bytes(spark, d):
    """Claims read from the bytes of files: a number or a list is no claim."""
    c = credential_files(spark, d).select("doc_id", binary.claims(F.col("content")).alias("c"))
    return c.select("doc_id", *[F.try_element_at("c", F.lit(k)).alias(n) for k, n in (("claim_generator", "claim_generator"), ("action", "action"), ("softwareAgent", "software_agent"))])


@query("""select event_id, (case when event_id % 2 = 0 then 3 else 19 end)::int as field_count, 'Exposure Time,Make' as camera_fields, event_id % 2 = 0 as gps, case when event_id % 6 = 3 then 'midjourney' else '' end as ai_terms,
case when event_id % 2 = 0 then 'Exposure Time,GPSInfo,Make' when event_id % 3 = 0 then 'Exposure Time,Make,note' else 'Exposure Time,Make' end as shown from events""")
def metadata_summaries(spark, d):
    i, pair = F.col("event_id"), lambda k, v: F.struct(F.lit(k).alias("k"), v.alias("v"))
    base = [pair("Make", F.col("event_type")), pair("Exposure Time", F.lit("1/60"))]
    many = [pair(f"x{n:02}", F.lit("y")) for n in range(16)] + [pair("note", F.when(i % 3 == 0, "made in Midjourney").otherwise("plain"))]
    few = [pair("GPSInfo", F.when(i % 3 == 0, "midjourney").otherwise("12.5"))]
    fields = F.map_from_entries(F.when(i % 2 == 0, F.array(*base, *few)).otherwise(F.array(*base, *many)))
    c = read(spark, d, "events").select("event_id", provenance.metadata_summary(fields).alias("c"))
    return c.select("event_id", "c.field_count", F.array_join("c.camera_fields", ",").alias("camera_fields"), "c.gps", F.array_join("c.ai_terms", ",").alias("ai_terms"), F.array_join(F.map_keys("c.fields"), ",").alias("shown"))


@query("select event_id, substr(coalesce(nullif(trim(json_extract_string(props, '$.name')), ''), props, ''), 1, 20) as flat from events")
def json_flatten(spark, d):
    return read(spark, d, "events").select("event_id", T.flat_text(F.col("props"), 20).alias("flat"))


@query("select page_id, case when length(trim(html)) > 80 then substr(trim(html), 1, 80) || '…' else trim(html) end as safe, substr(sha1(html), 1, 10) as digest from pages")
def safe_texts(spark, d):
    return read(spark, d, "pages").select("page_id", T.safe_text(F.col("html"), 80).alias("safe"), F.substring(F.sha1(F.encode("html", "UTF-8")), 1, 10).alias("digest"))


@query("""select l_orderkey, l_linenumber, case when l_quantity / 50 <= 0 or l_quantity / 50 >= 1 then 0 else round(-(l_quantity / 50 * log2(l_quantity / 50) + (1 - l_quantity / 50) * log2(1 - l_quantity / 50)), 6) end as entropy from lineitem""")
def entropies(spark, d):
    return read(spark, d, "lineitem").select("l_orderkey", "l_linenumber", F.round(T.binary_entropy(F.col("l_quantity") / 50), 6).alias("entropy"))


@query("""with b as (select p_partkey, p_size * 10 as x, p_size * 7 as y from part) select p_partkey, case when (y + 10) / 400.0::double < 1/3.0::double then 'top' when (y + 10) / 400.0::double > 2/3.0::double then 'bottom' else 'middle' end || '-' || case when (x + 10) / 500.0::double < 1/3.0::double then 'left' when (x + 10) / 500.0::double > 2/3.0::double then 'right' else 'center' end as region from b""")
def region_names(spark, d):
    p = F.col("p_size")
    return read(spark, d, "part").select("p_partkey", T.region_name(p * 10, p * 7, F.lit(20), F.lit(20), F.lit(500), F.lit(400)).alias("region"))


@query("""with h as (select doc_id, ('0x' || substr(sha256(text), 1, 8))::bigint as n, ('0x' || substr(sha256(text), 9, 8))::bigint as k from documents) select doc_id, [768, 1024, 1280, 1600][(n % 4 + 1)::int] as edge, [72, 80, 88, 94][(k % 4 + 1)::int] as quality from h""")
def hashed_choices(spark, d):
    x = read(spark, d, "documents").select("doc_id", F.sha2(F.col("text"), 256).alias("h"))
    return x.select("doc_id", T.hashed_choice(F.col("h"), [768, 1024, 1280, 1600]).alias("edge"), T.hashed_choice(F.col("h"), [72, 80, 88, 94], 9).alias("quality"))


@query("""with b as (select doc_id, n_chars % 1000 + 1 as w, n_chars % 777 + 1 as h from documents where n_chars is not null), c as (select *, unnest([0, 1, 2, 3, 4]) as i from b where least(w, h) >= 280)
select doc_id, case i when 1 then w - 224 when 3 then w - 224 when 4 then (w - 224) // 2 else 0 end as x, case i when 2 then h - 224 when 3 then h - 224 when 4 then (h - 224) // 2 else 0 end as y from c""")
def native_crops(spark, d):
    x = read(spark, d, "documents").where("n_chars is not null").select("doc_id", (F.col("n_chars") % 1000 + 1).alias("w"), (F.col("n_chars") % 777 + 1).alias("h"))
    return x.select("doc_id", F.inline(T.crop_boxes(F.col("w"), F.col("h"))))


@query("""select 'png' as kind, case when doc_id % 2 = 0 then 'IHDR,tEXt,caBX,IEND' else 'IHDR,caBX,IEND' end as chunks, strlen(substr(coalesce(text, ''), 1, 5))::int as trailing_bytes, count(*) as n from documents group by all""")
def container_chunks(spark, d):
    """The chunks of documents as PNG files, and what stands after their end."""
    c = credential_files(spark, d).select(binary.container(F.col("content")).alias("c"))
    return c.groupBy("c.kind", F.array_join("c.chunks", ",").alias("chunks"), "c.trailing_bytes").agg(F.count("*").alias("n"))


@query("""select event_id, props as value, (2 + event_id % 30)::int as n_texts, coalesce(event_type, '') || chr(10) || (event_id % 30)::varchar as last from events where props is not null""")
def cbor_values(spark, d):
    """Events as CBOR arrays of texts: the one behind a name, how many there are, and the last."""
    n = (F.col("event_id") % 30).cast("int")
    text = lambda i: cbor_text(F.concat(F.coalesce("event_type", F.lit("")), F.lit("\n"), i.cast("string")))
    more = F.aggregate(F.sequence(F.lit(1), F.lit(30)), F.lit(b""), lambda acc, i: F.when(i <= n, F.concat(acc, text(i))).otherwise(acc))
    content = F.concat(head(4, n + 2), cbor_text(F.lit("props")), cbor_text(F.col("props")), more)
    e = read(spark, d, "events").where("props is not null").select("event_id", "event_type", "props", content.alias("b"))
    texts = binary.cbor_text(F.col("b"))
    got = e.select("event_id", binary.cbor_value(F.col("b"), "props").alias("value"), texts.alias("texts"), F.col("event_type"))
    return got.select("event_id", "value", F.size("texts").alias("n_texts"), F.when(F.size("texts") > 2, F.element_at("texts", -1)).otherwise(F.concat(F.coalesce("event_type", F.lit("")), F.lit("\n0"))).alias("last"))


@query("select distinct event_id, user_id, event_type from events")
def resumable_append(spark, d):
    """Events as a stream: deduplicated by id within an hour, appended until nothing is left, then read."""
    schema = spark.read.parquet(f"{d}/events.parquet").schema
    top = f"{shared_folder(spark)}/stream-{uuid.uuid4().hex}"
    s = resumable.deduplicated(resumable.arrivals(spark, d, schema, glob="events.parquet").withColumn("ts", F.col("ts").cast("timestamp")), ["event_id"], "ts", "1 hour")
    resumable.run_available(s.select("event_id", "user_id", "event_type"), f"{top}/out", f"{top}/state")
    return spark.read.schema("event_id long, user_id long, event_type string").parquet(f"{top}/out")


@query("select distinct user_id, event_type from events")
def exact_append(spark, d):
    """Pairs of user and type, each stored once: the earlier half of the events arrives in files of some hours each, the
    stream stops, the rest arrives days after its duplicates, and the stream starts again."""
    top = f"{shared_folder(spark)}/stream-{uuid.uuid4().hex}"
    e = read(spark, d, "events").select("user_id", "event_type", F.col("ts").cast("timestamp").alias("ts"))
    half = e.agg(F.expr("timestamp_micros((unix_micros(min(ts)) + unix_micros(max(ts))) div 2)").alias("t")).first().t
    for part in (F.coalesce(F.col("ts") < half, F.lit(True)), F.col("ts") >= half):
        e.where(part).repartitionByRange(4, "ts").write.mode("append").parquet(f"{top}/arrivals")
        s = resumable.arrivals(spark, f"{top}/arrivals", e.schema, per_batch=3)
        resumable.append_new(s, ["user_id", "event_type"], f"{top}/store", f"{top}/state", order="ts", buckets=8)
    return spark.read.parquet(f"{top}/store").select("user_id", "event_type")


@query("with f as (select user_id, event_type, min(ts) as ts from events group by all) select event_type, count(*) as pairs from f group by all")
def first_arrival_counts(spark, d):
    """Pairs of user and type in a stream, each counted once for ever, by type."""
    top = f"{shared_folder(spark)}/stream-{uuid.uuid4().hex}"
    s = resumable.arrivals(spark, d, read(spark, d, "events").schema, glob="events.parquet").select("user_id", "event_type")
    resumable.run_available(resumable.first_arrivals(s, ["user_id", "event_type"]), f"{top}/out", f"{top}/state")
    return spark.read.schema("user_id long, event_type string").parquet(f"{top}/out").groupBy("event_type").agg(F.count("*").alias("pairs"))


@query()
def logistic_heads(spark, d):
    """Calibrated heads on four views of the embeddings, their mean on the rows held out."""
    e = read(spark, d, "embeddings").withColumn("y", (F.col("label") >= 5).cast("int"))
    part = F.pmod(F.xxhash64("vec_id"), F.lit(10))
    out = None
    for i, v in enumerate(learning.views(e)):
        v = v.select("vec_id", "y", "features", part.alias("part"))
        _, model, platt = learning.fit_head(v.where("part < 6"), v.where("part in (6, 7)"))
        p = learning.calibrated(model, platt, v.where("part > 7")).select("vec_id", "y", F.lit(i).alias("view"), "p")
        out = p if out is None else out.union(p)
    return out.groupBy("vec_id", "y").agg(F.round(F.avg("p"), 6).alias("p"))


@query()
def cross_validation(spark, d):
    e = read(spark, d, "embeddings").withColumn("y", (F.col("label") >= 5).cast("int"))
    f = learning.views(e, n=1)[0].select("vec_id", "y", "features")
    return learning.cross_validate(f, learning.model_zoo(), "vec_id")


@query(f"""with {SQL_SCORES}, q as (select vec_id, embedding from embeddings where vec_id % 20 = 0), dd as (select q.vec_id as q, e2.vec_id as b, (e2.label >= 5)::int as y, list_sum(list_transform(list_zip(q.embedding, e2.embedding), lambda z: ((z[1] - z[2]) * (z[1] - z[2]))::double)) as dist from q join embeddings e2 on e2.vec_id <> q.vec_id),
r as (select *, row_number() over (partition by q order by dist, b) as r from dd) select q as vec_id, round(avg(y), 6) as p from r where r <= 5 group by q""")
def nearest_neighbours(spark, d):
    """The stated query set, every 20th vector, against all."""
    e = read(spark, d, "embeddings").withColumn("y", (F.col("label") >= 5).cast("int")).select("vec_id", "embedding", "y")
    return learning.nearest_neighbours(e.where("vec_id % 20 = 0"), e, "vec_id").select("vec_id", F.round("p", 6).alias("p"))
