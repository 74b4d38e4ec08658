"""Queries over files that Spark derives from the tables (lines, CSV, nested images, scores) and over extractions."""

import uuid

from pyspark.sql import functions as F

from ..functions import binary, text as T
from ..operators import audits, extract, manifest, reports, sampling, tiers
from ..session import shared_folder, written
from ..sources import manifests as M
from ..streaming import resumable
from .provenance import credential_files
from .views import SQL_DOCS, SQL_MANIFEST, SQL_SCORES, documents, manifest as manifest_v, read, scores

Q: dict = {}
S: dict = {}


def query(sql: str | None = None):
    def add(f):
        Q[f.__name__] = f
        if sql:
            S[f.__name__] = sql
        return f

    return add


def folder(spark, name: str) -> str:
    return f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"


def lines(spark, d) -> str:
    """The manifest as JSON lines, of which some are blank and some broken."""
    m = manifest_v(spark, d).withColumn("path", F.concat(F.lit("web/"), F.col("doc_id").cast("string"), F.lit(".png")))
    key = F.when(F.col("doc_id") % 4 != 0, F.col("source_key"))
    line = F.to_json(F.struct("path", "split", "label", key.alias("source_key"), "sha256", F.col("n_chars").cast("int").alias("width")))
    top = folder(spark, "lines")
    m.select(F.when(F.col("doc_id") % 10 == 3, F.substring(line, 1, 25)).when(F.col("doc_id") % 10 == 7, "").otherwise(line).alias("value")).write.text(top)
    return top


KEPT = "m where doc_id % 10 not in (3, 7)"


@query(f"with {SQL_MANIFEST} select 'web/' || doc_id || '.png' as path, label, case when doc_id % 4 = 0 then 'web/unknown' else source_key end as \"group\", n_chars::int as width from {KEPT} and split = 'train' and doc_id % 3 <> 0")
def manifest_lines(spark, d):
    """Lines of one split whose files are listed, with defaults; blank and broken lines are skipped."""
    listing = read(spark, d, "documents").where("doc_id % 3 <> 0").select(F.concat(F.lit("web/"), F.col("doc_id").cast("string"), F.lit(".png")).alias("path"))
    return M.manifest_rows(spark, lines(spark, d), "web", listing, "train").select("path", "label", "group", "width")


@query(f"with {SQL_MANIFEST} select count(*) filter (doc_id % 10 not in (3, 7)) as good, count(*) filter (doc_id % 10 = 3) as broken from m")
def broken_lines(spark, d):
    """Lines that are and are not JSON, none of them dropped."""
    x = written(M.read_jsonl(spark, lines(spark, d), tolerant=False))
    return x.agg(F.count_if(F.col("_corrupt_record").isNull()).alias("good"), F.count_if(F.col("_corrupt_record").isNotNull()).alias("broken"))


@query(f"with {SQL_MANIFEST} select label, split, count(*) as n, sum(n_chars)::bigint as width from m where doc_id % 5 <> 0 and split <> 'val' group by all")
def csv_manifest(spark, d):
    """A CSV manifest whose splits are its paths' first parts; rows of other folders are not its own."""
    m, top = manifest_v(spark, d).where("split <> 'val'"), folder(spark, "csv")
    path = F.concat(F.when(F.col("doc_id") % 5 == 0, "elsewhere").otherwise(F.col("split")), F.lit("/"), F.col("label"), F.lit("/"), F.col("doc_id").cast("string"), F.lit(".png"))
    m.select(path.alias("path"), "label", F.lit("latdiff").alias("architecture"), "source", "sha256", F.col("n_chars").cast("int").alias("width"), F.lit(1).alias("height")).write.option("header", True).csv(top)
    return M.read_csv(spark, top).groupBy("label", "split").agg(F.count("*").alias("n"), F.sum("width").alias("width"))


@query("""with e as (select doc_id, 'f' || doc_id % 300 as name, case doc_id % 3 when 0 then 'confirmed' else 'disputed' end as classification, case when doc_id % 5 = 0 then 'False' else 'True' end as download_success, case doc_id % 4 when 0 then 'high' when 1 then 'medium' when 2 then 'low' else 'odd' end as confidence from documents)
select doc_id as id, confidence from e where classification = 'confirmed' and download_success = 'True' and name in (select 'f' || doc_id from documents where doc_id % 7 <> 0 and doc_id < 300) order by case confidence when 'high' then 0 when 'medium' then 1 when 'low' then 2 else 3 end, doc_id limit 60""")
def evidence_rows(spark, d):
    """The surest 60 rows of evidence whose files are listed."""
    i = F.col("doc_id")
    listing = read(spark, d, "documents").where("doc_id % 7 <> 0 and doc_id < 300").select(F.concat(F.lit("f"), i.cast("string")).alias("name"))
    pick = lambda *xs: F.element_at(F.array(*map(F.lit, xs)), (i % len(xs) + 1).cast("int"))
    e = read(spark, d, "documents").select(i.alias("id"), F.concat(F.lit("f"), (i % 300).cast("string")).alias("name"), pick("confirmed", "disputed", "disputed").alias("classification"), F.when(i % 5 == 0, "False").otherwise("True").alias("download_success"), pick("high", "medium", "low", "odd").alias("confidence"))
    return M.evidence(e, listing, 60).select("id", "confidence")


@query("select lang as format, count(*) as n, sum(strlen(text))::bigint as bytes from documents group by lang")
def nested_images(spark, d):
    """Bytes and format of nested images in Parquet: their paths are not read."""
    top = folder(spark, "nested")
    read(spark, d, "documents").select(F.struct(F.encode("text", "UTF-8").alias("bytes"), F.col("source").alias("path")).alias("image"), F.col("lang").alias("format")).write.parquet(top)
    return M.read_nested_images(spark, top).groupBy("format").agg(F.count("*").alias("n"), F.sum(F.octet_length("content")).alias("bytes"))


@query("""select doc_id, 'png' as format, (doc_id % 5000 + 1)::int as width, (n_chars % 70000 + 1)::int as height from documents where doc_id % 9 <> 0 and n_chars is not null
union all select doc_id, null, null, null from documents where doc_id % 9 = 0 or n_chars is null""")
def image_headers(spark, d):
    """Sizes by the first bytes of files; of files that are no images nothing."""
    number = lambda c: F.unhex(F.lpad(F.hex(c), 8, "0"))
    png = F.concat(F.lit(b"\x89PNG\r\n\x1a\n\0\0\0\x0dIHDR"), number(F.col("doc_id") % 5000 + 1), number(F.col("n_chars") % 70000 + 1), F.lit(b"\x08\x02\0\0\0"))
    x = read(spark, d, "documents").select("doc_id", binary.image_header(F.when(F.col("doc_id") % 9 != 0, png).otherwise(F.encode("text", "UTF-8"))).alias("h"))
    return x.select("doc_id", "h.format", "h.width", "h.height")


@query(f"with {SQL_SCORES}, r as (select *, row_number() over (partition by vec_id % 40, tier order by vec_id desc) as k from s) select 't' || tier as tier, 'p' || vec_id % 40 as path, round(p, 6) as p_fake from r where k = 1")
def score_lines(spark, d):
    """Scores appended as JSON lines by tier, read back; of repeated ones the last."""
    top = folder(spark, "scores")
    s = scores(spark, d).select(F.concat(F.lit("t"), F.col("tier").cast("string")).alias("tier"), F.concat(F.lit("p"), (F.col("vec_id") % 40).cast("string")).alias("path"), F.lit("fake").alias("label"), F.lit("g").alias("group"), F.lpad(F.col("vec_id").cast("string"), 9, "0").alias("generator"), F.round("p", 6).alias("p_fake"))
    for part in ("generator % 2 = 0", "generator % 2 = 1"):
        M.append_jsonl(s.where(part), top)
    return M.last_score(M.read_scores(spark, top), ["tier", "path"], "generator")


SIZED = "d as (select doc_id, lang as label, n_chars % 900 + 100 as width, n_chars % 700 + 100 as height, doc_id % 17 = 0 as flagged, md5('42:' || doc_id) as h from documents where n_chars is not null)"


def sized(spark, d):
    x = read(spark, d, "documents").where("n_chars is not null")
    return x.select("doc_id", F.col("lang").alias("label"), (F.col("n_chars") % 900 + 100).alias("width"), (F.col("n_chars") % 700 + 100).alias("height"), (F.col("doc_id") % 17 == 0).alias("flagged"))


@query(f"with {SIZED}, r as (select *, row_number() over (partition by label order by doc_id) - 1 as k from d where least(width, height) >= 200 and not flagged) select doc_id, label, case when k < 80 then 'train' when k < 90 then 'val' else 'test' end as split from r where k < 100")
def extracted_splits(spark, d):
    """The first hundred large unflagged rows of each class, 80/10/10 by their place."""
    return extract.Extraction(target=100, min_edge=200, flag="flagged").apply(sized(spark, d), "doc_id").select("doc_id", "label", "split")


@query(f"with {SIZED}, r as (select *, row_number() over (partition by label order by h, doc_id) - 1 as k from d where least(width, height) >= 400) select doc_id, label, case when k < 30 then 'train' when k < 34 then 'val' else 'test' end as split from r where k < 44")
def filled_splits(spark, d):
    """Large rows in shuffled order fill train, then val, then test of each class."""
    return extract.Extraction(target=44, min_edge=400, seed=42, fill={"train": 30, "val": 4, "test": 10}).apply(sized(spark, d), "doc_id").select("doc_id", "label", "split")


@query(f"with {SQL_MANIFEST}, r as (select *, row_number() over (partition by label order by md5('42:' || doc_id), doc_id) - 1 as k from m where split = 'train') select doc_id, label, case when k < 60 then 'train' else 'val' end as split from r where k < 75 union all select doc_id, label, split from m where split = 'test'")
def resampled_splits(spark, d):
    """A train split dealt anew by size; the test split is kept."""
    return extract.resampled(manifest_v(spark, d).select("doc_id", "label", "split"), "doc_id", {"train": 60, "val": 15})


@query(f"with {SQL_MANIFEST}, r as (select *, row_number() over (partition by label order by md5('42:' || doc_id), doc_id) - 1 as k, count(*) over (partition by label) as n from m where split = 'train') select doc_id, label, case when k < n // 10 then 'val' else 'train' end as split from r union all select doc_id, label, split from m where split <> 'train'")
def carved_splits(spark, d):
    """A tenth of each class of the train split becomes val; labels were capitals."""
    return extract.carved(manifest_v(spark, d).select("doc_id", F.upper("label").alias("label"), "split"), "doc_id")


@query(f"with {SQL_MANIFEST}, r as (select *, row_number() over (partition by split, label order by md5('42:' || doc_id), doc_id) as k from m where doc_id % 2 = 1) select doc_id, label, split from m where doc_id % 2 = 0 union all select doc_id, label, split from r where k <= case split when 'train' then 40 when 'test' then 8 else k end")
def merged_trees(spark, d):
    """Two trees in one; of the second at most so many rows of a split and class."""
    m = manifest_v(spark, d).select("doc_id", "label", "split")
    return extract.merged(m.where("doc_id % 2 = 0"), m.where("doc_id % 2 = 1"), "doc_id", {"train": 40, "test": 8})


@query("""with p as (select doc_id, case when lang = 'de' then text when source = 'src3' then text || 'x' end as c, case when lang = 'de' then n_chars else doc_id end as w from documents), s as (select doc_id, c, sha256(c) as sha256 from p where c is not null and c <> '' and greatest(w, 300) >= 400),
k as (select min(doc_id) as doc_id, sha256 from s where sha256 not in (select sha256(text) from documents where doc_id % 6 = 0) and substr(sha256, 1, 16) not in (select substr(sha256(text), 1, 16) from documents where doc_id % 8 = 1) group by sha256) select doc_id, sha256 from k order by doc_id limit 90""")
def preference_pairs(spark, d):
    """The side of a model in pairs, without contents that are seen or guarded, up to a quota."""
    x = read(spark, d, "documents")
    body = F.encode("text", "UTF-8")
    pairs = x.select("doc_id", F.col("lang").alias("model1"), body.alias("content1"), F.col("n_chars").alias("width1"), F.lit(300).alias("height1"), F.when(F.col("source") == "src3", "de").alias("model2"), F.concat(body, F.lit(b"x")).alias("content2"), F.col("doc_id").alias("width2"), F.lit(300).alias("height2"))
    sha = F.sha2(F.col("text"), 256)
    return extract.preferred_side(pairs, "de", x.where("doc_id % 8 = 1").select(sha.alias("prefix")), x.where("doc_id % 6 = 0").select(sha.alias("sha256")), "doc_id", quota=100, had=10).select("doc_id", "sha256")


SHAPE = "case when doc_id % 5 < 2 then 'square' when doc_id % 5 < 4 then 'landscape' else 'portrait' end"


@query(f"""with {SQL_MANIFEST}, x as (select *, {SHAPE} as shape from m), h as (select label, shape, count(*) as n from x where split = 'test' group by all), r as (select *, row_number() over (partition by label, shape order by doc_id) as k from x where split = 'train'),
c(shape, cap) as (values ('square', 40), ('landscape', 40), ('portrait', 20)) select doc_id, label, shape from r join c using (shape) left join h using (label, shape) where k + coalesce(n, 0) <= cap""")
def seeded_shape_quota(spark, d):
    """Quotas by shape that count what is there already."""
    x = manifest_v(spark, d).withColumn("shape", F.expr(SHAPE))
    return extract.shape_quota(x.where("split = 'train'"), "label", "shape", ["doc_id"], 100, {"square": 0.4, "landscape": 0.4, "portrait": 0.2}, x.where("split = 'test'")).select("doc_id", "label", "shape")


@query(f"""with {SQL_MANIFEST}, s as (select distinct source as key, 25 as target from documents), n as (select replace(source_key, '_holdout', '') as key, count(*) as n from m group by 1)
select key, target::bigint as target, coalesce(n, 0) as have, greatest(0, target - coalesce(n, 0)) as todo, case when target > coalesce(n, 0) then floor((target - coalesce(n, 0)) * 1.5)::bigint + 32 else 0 end as budget from s left join n using (key)""")
def collection_plan(spark, d):
    """What each source still lacks, held-out rows counted, and how many rows to ask it for."""
    sources = read(spark, d, "documents").select(F.col("source").alias("key"), F.lit(25).cast("long").alias("target")).distinct()
    return extract.collection_plan(sources, manifest_v(spark, d))


@query(f"""with {SQL_MANIFEST}, x as (select doc_id, generator, label, split as source_split, case split when 'train' then 'train' when 'holdout' then 'val' end as split from m)
select doc_id, split || '/' || label || '/' || generator || '_' || source_split || '_' || lpad((row_number() over (partition by split, label, generator, source_split order by source_split || '/' || lpad(doc_id::varchar, 9, '0') || '.PNG') - 1)::varchar, 6, '0') || '.png' as link from x where split is not null""")
def linked_files(spark, d):
    """Where files are linked to when splits get other names."""
    m = manifest_v(spark, d).withColumn("path", F.concat("split", F.lit("/"), F.lpad(F.col("doc_id").cast("string"), 9, "0"), F.lit(".PNG")))
    return extract.links(m, F.concat("generator", F.lit("_"), F.col("source_split")), "path", splits={"train": "train", "holdout": "val"}).select("doc_id", "link")


@query("""with b as (select doc_id, (n_chars % 900 + 100)::int as w, (n_chars % 700 + 100)::int as h from documents where n_chars is not null)
select doc_id, case when least(w, h) < 280 then 0 else w - 224 end as "left", 0 as top, w as "right", case when least(w, h) < 280 then h else 224 end as bottom, least(w, h) >= 280 as native from b""")
def view_boxes(spark, d):
    """The upper right view of each size, native where it is large enough."""
    return sized(spark, d).select("doc_id", extract.view_box(F.col("width"), F.col("height"), (1.0, 0.0)).alias("b")).select("doc_id", "b.*")


@query("""select doc_id, case when n >= 1073741824 then printf('%.2f GB', n / 1073741824.0::double) when n >= 1048576 then printf('%.2f MB', n / 1048576.0::double) when n >= 1024 then n // 1024 || ' KB' else n || ' B' end as size, coalesce(printf('%.1f%%', s * 100), '—') as share
from (select doc_id, (n_chars % 1000) * (case doc_id % 3 when 0 then 1 when 1 then 1031 else 700001 end) as n, case when doc_id % 4 <> 0 then (doc_id % 800) / 800.0::double end as s from documents where n_chars is not null)""")
def formatted(spark, d):
    """Bytes in units, shares in per cent, a dash for none."""
    i = F.col("doc_id")
    n = (F.col("n_chars") % 1000) * F.element_at(F.array(F.lit(1), F.lit(1031), F.lit(700001)), (i % 3 + 1).cast("int"))
    x = read(spark, d, "documents").where("n_chars is not null")
    return x.select("doc_id", T.format_bytes(n).alias("size"), T.percent(F.when(i % 4 != 0, (i % 800) / 800.0)).alias("share"))


@query(f"with {SQL_SCORES}, ms as (select * from s where (p >= 0.5) <> (y = 1)), r as (select *, row_number() over (partition by tier, y order by vec_id) as k, count(*) over (partition by tier, y) as n_missed from ms) select tier, y, vec_id, p, n_missed from r where k <= 7")
def missed_rows(spark, d):
    """The first misses of each tier and class, and how many there are."""
    return reports.misses(scores(spark, d), "tier", "vec_id", 7)


@query(f"""with {SQL_MANIFEST}, x as (select label, n_chars * 500 / 1e6::double as mega, unnest([{{'panel': 'class', 'value': ''}}, {{'panel': 'language', 'value': generator}}, {{'panel': 'shape', 'value': {SHAPE}}}]) as p from m),
g as (select p.panel as panel, label, p.value as value, count(*) as n, round(avg(mega), 6) as mean_megapixels from x group by all) select *, row_number() over (partition by panel, label order by n desc, value) as rank from g""")
def corpus_report(spark, d):
    """Counts and mean sizes by class, language and shape."""
    m = manifest_v(spark, d).withColumns({"width": F.col("n_chars"), "height": F.lit(500)})
    return reports.corpus_report(m, {"language": F.col("generator"), "shape": F.expr(SHAPE)})


@query(f"with {SQL_SCORES}, g as (select (grp % 7)::varchar as grp, min_by(y, vec_id) as y, count(*) as n, round(avg(p), 6) as mean_p, avg((p >= 0.5)::int::double) as hit from s group by 1) select grp, y, n, mean_p, round(case when y = 1 then hit else 1 - hit end, 6) as \"right\" from g")
def group_report(spark, d):
    """Groups under the class of their first row."""
    return reports.group_report(scores(spark, d).withColumn("grp", (F.col("grp") % 7).cast("string")), "grp", "vec_id")


@query("select source, count(*) as n, row_number() over (order by count(*) desc, min(doc_id * 7919 % 10007)) as rank from documents group by source")
def most_common_first(spark, d):
    """Sources by their count, of equal ones the one seen first."""
    return reports.most_common(read(spark, d, "documents").withColumn("at", F.col("doc_id") * 7919 % 10007), "source", "at")


@query(f"""with {SQL_SCORES}, ep as (select vec_id % 5 as epoch, y, p, -ln(case when y = 1 then p else 1 - p end) as loss from s), t as (select epoch, quantile_cont(p, 0.95) filter (y = 0) as t from ep group by 1),
b as (select epoch, count(*) as n, round(avg(loss), 6) as loss, round(avg(((p >= 0.5) = (y = 1))::int::double), 6) as accuracy, round(any_value(t), 6) as threshold, round(avg((p >= t)::int::double) filter (y = 1), 6) as recall from ep join t using (epoch) group by epoch),
u as (select a.epoch, round(avg(case when a.p > b.p then 1 when a.p = b.p then 0.5 else 0 end), 6) as auc from ep a join ep b on a.epoch = b.epoch and a.y = 1 and b.y = 0 group by 1)
select epoch, n, loss, accuracy, auc, threshold, recall from b join u using (epoch)""")
def epoch_metrics(spark, d):
    """Loss, accuracy, AUC, threshold and recall of each epoch."""
    s = scores(spark, d).withColumns({"epoch": F.col("vec_id") % 5, "loss": -F.ln(F.when(F.col("y") == 1, F.col("p")).otherwise(1 - F.col("p")))})
    return reports.epoch_metrics(s, ["epoch"])


def sql_digest(h: str) -> str:
    return "sha256(concat_ws('-', count(h)::varchar, " + ", ".join(f"sum(('0x' || substr(h, {i}, 15))::bigint)::varchar" for i in (1, 16, 31, 46)) + f")) {h}"


@query(f"select count(*) filter (trim(t) <> '') as rows, {sql_digest('as digest')} from (select sha256(doc_id || chr(0) || coalesce(text, '')) as h, coalesce(text, '') as t from documents)")
def manifest_identity(spark, d):
    """The digest of lines in their places, and how many are not empty."""
    x = read(spark, d, "documents").select("doc_id", F.coalesce("text", F.lit("")).alias("value"))
    return audits.manifest_identity(x, order="doc_id")


@query(f"select {sql_digest('as digest')} from (select sha256(concat_ws(chr(0), doc_id::varchar, sha256(text))) as h from documents)")
def content_fingerprint(spark, d):
    """A digest of all documents, in whatever order they are."""
    return reports.fingerprint(read(spark, d, "documents"), "doc_id", "text")


@query("select event_type, least(150, count(*)) as n from events group by event_type")
def stream_quota(spark, d):
    """Rows of each type until its quota is met, over all batches of a stream."""
    top = folder(spark, "quota")
    read(spark, d, "events").select("event_id", "event_type").repartition(6).write.parquet(f"{top}/in")
    s = resumable.arrivals(spark, f"{top}/in", read(spark, d, "events").select("event_id", "event_type").schema, per_batch=2)
    resumable.run_available(resumable.within_quota(s, "event_type", "event_id", 150), f"{top}/out", f"{top}/state")
    return spark.read.schema(s.schema).parquet(f"{top}/out").groupBy("event_type").agg(F.count("*").alias("n"))


@query(f"with {SQL_MANIFEST} select split, label, case when doc_id % 2 = 0 then '/abs/' || doc_id else '/root/' || doc_id end as path from (select doc_id, 'train' as split, label from m where label = 'fake')")
def forced_rows(spark, d):
    """One class of a source, all of it to the train split, paths made absolute."""
    m = manifest_v(spark, d).select("split", "label", F.when(F.col("doc_id") % 2 == 0, F.concat(F.lit("/abs/"), F.col("doc_id").cast("string"))).otherwise(F.col("doc_id").cast("string")).alias("path"))
    return extract.forced(m, "fake", "train", "/root")


@query(f"with {SQL_MANIFEST}, a as (select label, min(doc_id) as doc_id from m where split = 'holdout' group by 1) select doc_id, label from m where split = 'train' union all select doc_id, label from a")
def adapted_rows(spark, d):
    """Training rows and an adaptation slice, one below the other."""
    m = manifest_v(spark, d)
    held = sampling.adaptation_slice(m.where("split = 'holdout'"), "label", "doc_id", 1).where("adapt")
    return extract.adapted(m.where("split = 'train'").select("doc_id", "label"), held)


@query(f"with {SQL_MANIFEST}, r as (select * from m where split = 'train' order by doc_id limit 120) select label, count(*) as n from r group by label")
def class_balance(spark, d):
    """How many of the first training rows each class has."""
    _, balance = extract.training_rows(manifest_v(spark, d), "train", 120, "doc_id")
    return spark.createDataFrame(sorted(balance.items()), "label string, n long")


@query(f"with {SQL_DOCS} select case when split = 'train' then 'train' else 'rest' end as part, count(*) as files, sum(n)::bigint as bytes from (select split, strlen(coalesce(docs.text, '')) as n from docs join dm using (doc_id)) group by 1")
def stored_contents(spark, d):
    """Contents stored verbatim by split and label, and what a listing of the folders says of them."""
    top = folder(spark, "stored")
    x = documents(spark, d).join(read(spark, d, "documents").select("doc_id", "text"), "doc_id")
    M.write_split(x.select("split", F.lit("all").alias("label"), F.encode(F.coalesce("text", F.lit("")), "UTF-8").alias("content")), top)
    part = F.when(F.col("split") == "train", "train").otherwise("rest")
    return spark.read.parquet(top).groupBy(part.alias("part")).agg(F.count("*").alias("files"), F.sum(F.octet_length("content")).alias("bytes"))


@query("select case when doc_id % 2 = 0 then 4 else 3 end as chunks, count(*) as n, count(distinct source || '/' || lang) as claimers from documents group by 1")
def credential_chunks(spark, d):
    """Files with credentials by how many chunks they have, and how many claim generators these name."""
    c = credential_files(spark, d).select(F.size(binary.container(F.col("content"))["chunks"]).alias("chunks"), F.try_element_at(binary.claims(F.col("content")), F.lit("claim_generator")).alias("c"))
    return c.groupBy("chunks").agg(F.count("*").alias("n"), F.countDistinct("c").alias("claimers"))


@query(f"with {SQL_MANIFEST} select substr(sha256, 1, 2) as sha256, string_agg(distinct label, ',' order by label) as labels, count(distinct label) as n_labels, count(*) as n from m group by 1 having count(distinct label) > 1")
def conflicting_prefixes(spark, d):
    """Contents told apart by two digits only, so that many have both labels."""
    return manifest.conflicting_labels(manifest_v(spark, d).withColumn("sha256", F.substring("sha256", 1, 2)))


@query(f"""with {SQL_MANIFEST}, x as (select doc_id, split, label, case when holdout and doc_id % 4 <> 1 then source else source_key end as source_key, case when holdout then 'en' else generator end as generator from m), f as (select * from x where split in ('train', 'val'))
select doc_id, source_key, generator from x where split not in ('train', 'val', 'test') and label = 'fake' and source_key in (select source_key from f) and generator in (select generator from f where label = 'fake')""")
def leaking_tiers(spark, d):
    """Held-out fakes that lost their quarantine name and carry a trained generator's: in no tier, to be mended."""
    i = F.col("doc_id")
    m = manifest_v(spark, d).withColumns({"source_key": F.when(F.col("holdout") & (i % 4 != 1), F.col("source")).otherwise(F.col("source_key")), "generator": F.when(F.col("holdout"), "en").otherwise(F.col("generator"))})
    return tiers.tier_leaks(m).select("doc_id", "source_key", "generator")
