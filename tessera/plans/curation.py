"""Queries over manifests: splits, dedup, checks, filters, joins and samples, each with its SQL."""

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as T
from ..operators import ingest, joins, manifest, sampling
from .views import SQL_DOCS, SQL_MANIFEST, documents, manifest as manifest_v, read

Q: dict = {}
S: dict = {}


def query(sql: str | None = None):
    def add(f):
        Q[f.__name__] = f
        if sql:
            S[f.__name__] = sql
        return f

    return add


SEQ = "doc_id"


@query(f"with {SQL_DOCS} select split, count(*) as n, count(distinct sha256) as n_distinct from dm group by split")
def hash_split_counts(spark: SparkSession, d: str) -> DataFrame:
    return documents(spark, d).groupBy("split").agg(F.count("*").alias("n"), F.countDistinct("sha256").alias("n_distinct"))


PRIO = "case split when 'holdout' then 0 when 'test' then 1 when 'val' then 2 when 'train' then 3 else 9 end"


@query(f"with {SQL_MANIFEST} select doc_id, sha256, split, label, source_key from (select *, row_number() over (partition by sha256 order by {PRIO}, doc_id) as r from m) where r = 1")
def dedup_keep_best(spark, d):
    m = manifest_v(spark, d).select("doc_id", "sha256", "split", "label", "source_key")
    return manifest.dedup_keep_best(m, path="doc_id", order=SEQ)


@query(f"with {SQL_MANIFEST}, b as (select *, first_value(split) over (partition by sha256 order by {PRIO}, doc_id) as best, row_number() over (partition by sha256 order by {PRIO}, doc_id) as r from m) select split || ' (dup of ' || best || ')' as dropped, count(*) as n from b where r > 1 group by 1")
def dedup_drop_histogram(spark, d):
    return manifest.drop_histogram(manifest_v(spark, d), path="doc_id", order=SEQ)


@query(f"with {SQL_MANIFEST} select sha256, string_agg(distinct label, ',' order by label) as labels, count(distinct label) as n_labels, count(*) as n from m group by sha256 having count(distinct label) > 1")
def conflicting_labels(spark, d):
    return manifest.conflicting_labels(manifest_v(spark, d))


@query(f"""with {SQL_DOCS}, g as (select *, row_number() over (partition by sha256 order by doc_id) as r from dm)
select sha256, count(*) as n, string_agg(distinct split, ',' order by split) as splits, string_agg(doc_id::varchar, ',' order by doc_id) filter (r <= 10) as paths from g group by sha256 having count(*) > 1""")
def duplicate_groups(spark, d):
    return manifest.duplicate_groups(documents(spark, d), path="doc_id")


@query(f"with {SQL_MANIFEST} select doc_id, split, sha256 from m where split <> 'train' and sha256 in (select sha256 from m where split = 'train')")
def leak_check(spark, d):
    return manifest.leaks(manifest_v(spark, d)).select("doc_id", "split", "sha256")


@query(f"with {SQL_DOCS}, n as (select * from dm where split <> 'train') select min(doc_id) as doc_id, sha256 from n where sha256 not in (select sha256 from dm where split = 'train' and sha256 is not null) group by sha256")
def seen_anti_join(spark, d):
    m = documents(spark, d)
    return joins.unseen(m.where("split <> 'train'").select("doc_id", "sha256"), m.where("split = 'train'"), order="doc_id")


@query(f"with {SQL_DOCS} select doc_id, sha256 from dm where substr(sha256, 1, 16) not in (select substr(sha256(text), 1, 16) from documents where doc_id % 7 = 0 and text is not null)")
def prefix_guard_anti(spark, d):
    m = documents(spark, d)
    guard = m.where("doc_id % 7 = 0").select(F.col("sha256").alias("prefix"))
    return joins.prefix_guard(m.select("doc_id", "sha256"), guard)


@query(f"with {SQL_DOCS} select doc_id, source from dm where doc_id in (select doc_id from labels)")
def listing_semi_join(spark, d):
    return joins.present(documents(spark, d).select("doc_id", "source"), read(spark, d, "labels"), "doc_id")


@query("""select source as corpus, count(*) as n, count(*) filter (path is not null) as n_path, sum((generator = '?')::int) as n_unknown from (
select 'documents' as source, doc_id::varchar as path, coalesce(lang, '?') as generator from documents union all select 'pages', url, '?' from pages
union all select 'conversations', conv_id || '/' || turn, coalesce(role, '?') from conversations union all select 'benchmark', item_id::varchar, '?' from benchmark) group by 1""")
def union_manifest(spark, d):
    parts = [
        read(spark, d, "documents").select(F.lit("documents").alias("corpus"), F.col("doc_id").cast("string").alias("path"), F.col("lang").alias("generator")),
        read(spark, d, "pages").select(F.lit("pages").alias("corpus"), F.col("url").alias("path")),
        read(spark, d, "conversations").select(F.lit("conversations").alias("corpus"), F.concat_ws("/", "conv_id", "turn").alias("path"), F.col("role").alias("generator")),
        read(spark, d, "benchmark").select(F.lit("benchmark").alias("corpus"), F.col("item_id").cast("string").alias("path")),
    ]
    u = manifest.union_manifests(parts)
    return u.groupBy("corpus").agg(F.count("*").alias("n"), F.count("path").alias("n_path"), F.count_if(F.col("generator") == "?").alias("n_unknown"))


SPEC = ingest.SourceSpec(
    key="corpus", where={"lang": ["en", "fr", "de"]}, where_not={"source": ["src3", "src4"], "no_such_column": ["x"]}, label_column="quality", label_map={"1": "real", "0": "fake"},
    generator_column="lang", generator_map={"en": "gen-a", "fr": "gen-b"}, holdout_when={"source": ["src18", "src19"]}, extra_fields=("toxic",),
)


def _labelled(spark, d):
    return read(spark, d, "documents").join(read(spark, d, "labels"), "doc_id")


@query("select doc_id, lang, source from documents join labels using (doc_id) where lang in ('en', 'fr', 'de') and coalesce(source, '') not in ('src3', 'src4')")
def where_filters(spark, d):
    x = _labelled(spark, d)
    return x.where(SPEC.matches(x)).select("doc_id", "lang", "source")


@query("""select doc_id, case quality when 1 then 'real' else 'fake' end as label, case lang when 'en' then 'gen-a' else 'gen-b' end as generator, coalesce(source, '') in ('src18', 'src19') as holdout,
case when source in ('src18', 'src19') then 'corpus_holdout' else 'corpus' end as source_key, toxic::varchar as extra_toxic
from documents join labels using (doc_id) where lang in ('en', 'fr') and coalesce(source, '') not in ('src3', 'src4') and quality in (0, 1)""")
def label_map_overrides(spark, d):
    out = SPEC.apply(_labelled(spark, d))
    return out.select("doc_id", "label", "generator", "holdout", "source_key", F.col("extras")["toxic"].alias("extra_toxic"))


@query("select 'lang' as \"column\", lang as value, count(*) as n from documents join labels using (doc_id) where lang = 'de' and coalesce(source, '') not in ('src3', 'src4') group by lang")
def unmapped_values(spark, d):
    return SPEC.unmapped(_labelled(spark, d))


@query(f"with {SQL_MANIFEST} select source_key, split, count(*) as n from m where holdout group by all")
def holdout_quarantine(spark, d):
    return manifest_v(spark, d).where("holdout").groupBy("source_key", "split").agg(F.count("*").alias("n"))


@query("select label, case label when 0 then 'zero' when 1 then 'one' when 2 then 'two' else label::varchar end as name, count(*) as n from embeddings group by all")
def class_label_names(spark, d):
    e = read(spark, d, "embeddings")
    return e.groupBy("label", ingest.class_name(F.col("label"), ["zero", "one", "two"]).alias("name")).agg(F.count("*").alias("n"))


@query("select case when case when source in ('src0', 'src1') then quality = 0 else quality = 1 end then 'real' else 'fake' end as label, case when source in ('src0', 'src2') then 32 else 512 end as edge, count(*) as n from documents join labels using (doc_id) group by all")
def polarity_and_edges(spark, d):
    x = _labelled(spark, d)
    return x.groupBy(ingest.label_polarity(F.col("quality"), F.col("source"), ["src0", "src1"]).alias("label"), ingest.minimum_edge(F.col("source"), ["src0", "src2"]).alias("edge")).agg(F.count("*").alias("n"))


@query("""select case when p_brand = 'Brand#1' then 'real' else coalesce(case lower(trim(p_type)) when 'commercial' then 'commercial' end, 'other') end as architecture, count(*) as n from part group by 1""")
def architecture_alias(spark, d):
    p = read(spark, d, "part")
    label = F.when(F.col("p_brand") == "Brand#1", "real").otherwise("fake")
    return p.groupBy(ingest.architecture(F.col("p_type"), label, "other").alias("architecture")).agg(F.count("*").alias("n"))


W, H = "(n_chars % 1000 + 1)", "(n_chars % 777 + 1)"


@query(f"""select doc_id, {W} as width, {H} as height, round({W}::double / {H}, 4) as aspect, greatest({W}, {H}) as long_edge,
case when {W}::double / {H} between 0.95 and 1.05 then 'square' when {W}::double / {H} > 1.05 then 'landscape' else 'portrait' end as orientation,
case when least({W}, {H}) <= 64 then 'low' when least({W}, {H}) <= 320 then 'medium' else 'high' end as tier, least({W}, {H}) between 100 and 500 as kept from documents""")
def derived_dimensions(spark, d):
    w, h = F.col("n_chars") % 1000 + 1, F.col("n_chars") % 777 + 1
    x = read(spark, d, "documents").select("doc_id", w.alias("width"), h.alias("height"))
    w, h = F.col("width"), F.col("height")
    return x.withColumns({"aspect": F.round(w.cast("double") / h, 4), "long_edge": F.greatest(w, h), "orientation": T.orientation(w, h), "tier": T.resolution_tier(w, h), "kept": ingest.within_resolution(w, h, 100, 500)})


@query("select case when quality = 1 then 'real' when lang in ('en', 'fr') then 'modern' else 'legacy' end as family, count(*) as n from documents join labels using (doc_id) group by 1")
def generator_family(spark, d):
    label = F.when(F.col("quality") == 1, "real").otherwise("fake")
    return _labelled(spark, d).groupBy(ingest.family(F.col("lang"), ["en", "fr"], label).alias("family")).agg(F.count("*").alias("n"))


@query("select page_id, regexp_replace(url, '[^\\p{L}\\p{N}._-]', '_', 'g') as name from pages")
def safe_names(spark, d):
    return read(spark, d, "pages").select("page_id", T.safe_name(F.col("url")).alias("name"))


@query("select coalesce(nullif(html, ''), url) as content, page_id from pages")
def first_usable_column(spark, d):
    return read(spark, d, "pages").select(F.decode(ingest.first_usable(F.encode("html", "UTF-8"), F.encode("url", "UTF-8")), "UTF-8").alias("content"), "page_id")


@query(f"with {SQL_MANIFEST} select doc_id, source_key, label from (select *, row_number() over (partition by source_key, label order by sha256, doc_id) as r from m) where r <= 5")
def cap_per_group(spark, d):
    return sampling.cap_per_group(manifest_v(spark, d), ["source_key", "label"], ["sha256", "doc_id"], 5).select("doc_id", "source_key", "label")


@query(f"""with {SQL_DOCS}, r as (select doc_id, source, row_number() over (partition by source order by sha256, doc_id) - 1 as i, count(*) over (partition by source) as n from dm)
select doc_id, source from r where i % greatest(1, n // 20) = 0 and i // greatest(1, n // 20) < 20""")
def stride_sample(spark, d):
    return sampling.stride_sample(documents(spark, d).select("doc_id", "source", "sha256"), ["source"], ["sha256", "doc_id"], 20, bucket=F.substring("sha256", 1, 3)).select("doc_id", "source")


@query("""with r as (select lang, row_number() over (partition by lang order by md5(doc_id::varchar), doc_id) - 1 as i, count(*) over (partition by lang) as n from documents)
select lang, case when i < floor(n * 0.8) then 'train' when i < floor(n * 0.9) then 'val' else 'test' end as split, case when i < floor(n * 0.8) then 'train' when i < floor(n * 0.8) + floor(n * 0.1) then 'val' else 'test' end as split_parts, count(*) as n from r group by all""")
def ordinal_split(spark, d):
    x = read(spark, d, "documents").select("doc_id", "lang", F.md5(F.col("doc_id").cast("string").cast("binary")).alias("h"))
    p = sampling.placed(x, ["h", "doc_id"], ["lang"], bucket=F.substring("h", 1, 3))
    return p.groupBy("lang", sampling.ordinal_split(F.col("place"), F.col("group_size")).alias("split"), sampling.ordinal_split_parts(F.col("place"), F.col("group_size")).alias("split_parts")).agg(F.count("*").alias("n"))


@query("""with r as (select doc_id, row_number() over (order by md5('42:' || doc_id), doc_id) - 1 as i, count(*) over () as n from documents)
select doc_id, case when i < floor(n * 0.8) then 'train' when i < floor(n * 0.9) then 'val' else 'test' end as split from r""")
def seeded_shuffle_split(spark, d):
    return sampling.hash_order_split(read(spark, d, "documents").select("doc_id"), "doc_id")


@query(f"""with {SQL_MANIFEST}, r as (select *, row_number() over (partition by label, generator order by md5('42:' || doc_id), doc_id) - 1 as i, count(*) over (partition by label, generator) as n from m)
select doc_id, label, generator, i < case when n >= 20 then greatest(6, floor(n * 0.2)) else greatest(2, n // 5) end as held from r""")
def stratified_holdout(spark, d):
    return sampling.stratified_holdout(manifest_v(spark, d).select("doc_id", "label", "generator"), ["label", "generator"], "doc_id", 0.2)


@query(f"with {SQL_MANIFEST} select doc_id, label, row_number() over (partition by label order by doc_id) <= 10 as adapt from m where split = 'holdout'")
def adaptation_slice(spark, d):
    return sampling.adaptation_slice(manifest_v(spark, d).where("split = 'holdout'").select("doc_id", "label"), "label", "doc_id", 10)


@query(f"""with {SQL_MANIFEST}, r as (select *, row_number() over (partition by label order by n_chars, doc_id) - 1 as i, count(*) over (partition by label) as n from m)
select label, case when i < n // 3 then 0 when i < 2 * n // 3 then 1 else 2 end as tercile, count(*) as n, min(n_chars) as lo, max(n_chars) as hi from r where n >= 6 group by all""")
def terciles_by_class(spark, d):
    t = sampling.terciles(manifest_v(spark, d), "label", "n_chars", "doc_id")
    return t.groupBy("label", "tercile").agg(F.count("*").alias("n"), F.min("n_chars").alias("lo"), F.max("n_chars").alias("hi"))


@query(f"""with {SQL_DOCS}, had as (select source, generator, count(*) as n from dm where split = 'test' group by all), r as (select *, row_number() over (partition by source, generator order by doc_id) as r from dm where split = 'train')
select doc_id, r.source, r.generator from r left join had using (source, generator) where r + coalesce(n, 0) <= 8""")
def quota_per_key(spark, d):
    m = documents(spark, d)
    had = m.where("split = 'test'").groupBy("source", "generator").agg(F.count("*").alias("n"))
    return sampling.quota_per_key(m.where("split = 'train'").select("doc_id", "source", "generator"), ["source", "generator"], ["doc_id"], 8, had)


@query("""with x as (select doc_id, lang, case when n_chars % 3 = 0 then 'landscape' when n_chars % 3 = 1 then 'portrait' else 'square' end as shape from documents), r as (select *, row_number() over (partition by lang, shape order by doc_id) as r from x)
select doc_id, lang, shape from r where r <= case shape when 'landscape' then 24 when 'portrait' then 24 else 12 end""")
def shape_quota(spark, d):
    k = F.col("n_chars") % 3
    x = read(spark, d, "documents").select("doc_id", "lang", F.when(k == 0, "landscape").when(k == 1, "portrait").otherwise("square").alias("shape"))
    return sampling.share_quota(x, "lang", "shape", ["doc_id"], 60, {"landscape": 0.40, "portrait": 0.40, "square": 0.20})


@query("""with r as (select doc_id, lang, row_number() over (partition by lang order by md5('42:' || doc_id), doc_id) as r from documents) select doc_id, lang from r where r <= case lang when 'de' then 20 when 'fr' then 30 when 'es' then 5 else 2147483647 end""")
def replay_mix(spark, d):
    return sampling.replay_mix(read(spark, d, "documents").select("doc_id", "lang"), "lang", "doc_id", {"de": 20, "fr": 30, "es": 5})


@query(f"""with {SQL_MANIFEST}, c as (select *, generator as corpus from m), g as (select split, label, corpus, count(*) as n, grouping(split) as gs, grouping(label) as gl, grouping(corpus) as gc from c group by grouping sets ((split), (label), (split, label), (corpus)))
select case when gs = 0 and gl = 0 then 'split/label' when gs = 0 then 'split' when gl = 0 then 'label' else 'corpus' end as kind, case when gs = 0 and gl = 0 then split || '/' || label else coalesce(split, label, corpus) end as key, n from g""")
def verify_counts(spark, d):
    return manifest.verify_counts(manifest_v(spark, d).withColumn("corpus", F.col("generator")))


@query(f"""with {SQL_MANIFEST}, c as (select *, generator as corpus from m),
g as (select sha256, count(*) as n, count(distinct label) as l, count(*) filter (split = 'train') as t from c group by sha256),
a as (select count(*) filter (split not in ('train', 'val', 'test', 'holdout')) as invalid_split, count(*) filter (label not in ('real', 'fake')) as invalid_label,
  count(*) filter (split is null or label is null or source is null or generator is null or sha256 is null or source = '' or generator = '') as missing_value, 1 as missing_column,
  (greatest(count(*) filter (label = 'real'), count(*) filter (label = 'fake')) > 2 * least(count(*) filter (label = 'real'), count(*) filter (label = 'fake')))::int as class_ratio, count(*) filter (corpus = 'en') as en from c),
b as (select count(*) filter (n > 1) as duplicate_groups, count(*) filter (l > 1) as label_conflicts, coalesce(sum(case when t > 0 then n - t else 0 end), 0) as leaks from g)
select * from (select unnest([{{'check': 'invalid_split', 'n': invalid_split, 'ok': invalid_split = 0}}, {{'check': 'invalid_label', 'n': invalid_label, 'ok': invalid_label = 0}}, {{'check': 'missing_value', 'n': missing_value, 'ok': missing_value = 0}}, {{'check': 'missing_column', 'n': missing_column, 'ok': missing_column = 0}},
 {{'check': 'duplicate_groups', 'n': duplicate_groups, 'ok': duplicate_groups = 0}}, {{'check': 'label_conflicts', 'n': label_conflicts, 'ok': label_conflicts = 0}}, {{'check': 'leaks', 'n': leaks, 'ok': leaks = 0}}, {{'check': 'class_ratio', 'n': class_ratio, 'ok': class_ratio = 0}}, {{'check': 'corpus:en', 'n': en, 'ok': en >= 100}}], recursive := true) from a, b)""")
def verify_checks(spark, d):
    return manifest.verify_checks(manifest_v(spark, d).withColumn("corpus", F.col("generator")), {"en": 100})


@query(f"with {SQL_DOCS} select source, count(*) as n from dm where coalesce(source not in ('src1', 'src18', 'src1_holdout', 'src18_holdout'), true) group by source")
def purge_source(spark, d):
    return manifest.purge(documents(spark, d), "source", ["src1", "src18"]).groupBy("source").agg(F.count("*").alias("n"))


@query("select c_custkey, c_name, case when c_custkey % 5 = 0 then 'new' else c_mktsegment end as segment from customer")
def upsert_index(spark, d):
    c = read(spark, d, "customer").select("c_custkey", "c_name", F.col("c_mktsegment").alias("segment"))
    return manifest.upsert(c, c.where("c_custkey % 5 = 0").withColumn("segment", F.lit("new")), ["c_custkey"])


@query(f"""with {SQL_DOCS} select doc_id as path, case when doc_id % 3 = 0 then null when doc_id % 3 = 1 and doc_id % 2 = 0 then null else sha256 end as sha256, doc_id % 3 = 0 or (doc_id % 3 = 1 and doc_id % 2 = 0) as stale from dm where sha256 is not null""")
def hash_cache_lookup(spark, d):
    m = documents(spark, d).where("sha256 is not null")
    now = m.select(F.col("doc_id").alias("path"), F.col("n_chars").alias("size"), F.lit(10).alias("mtime"))
    third = F.col("doc_id") % 3
    cache = m.where(third != 0).select(F.col("doc_id").alias("path"), "sha256", F.when(third == 1, F.col("n_chars")).alias("size"), F.when(third == 1, 10 + (F.col("doc_id") % 2 == 0).cast("int")).alias("mtime"))
    return manifest.with_content_state(now, cache).select("path", "sha256", "stale")


@query("select doc_id, variant from documents, (values ('as-is'), ('q95'), ('q88'), ('q75')) v(variant)")
def row_variants(spark, d):
    return joins.with_variants(read(spark, d, "documents").select("doc_id"), "variant", ["as-is", "q95", "q88", "q75"])


@query("select distinct seen from (select sha256(text) as seen from documents where text is not null union all select sha256(html) from pages where html is not null)")
def seen_hashes(spark, d):
    return joins.with_seen((read(spark, d, "documents").select(F.sha2(F.col("text"), 256).alias("h")), "h"), (read(spark, d, "pages").select(F.sha2(F.col("html"), 256).alias("h")), "h"))


@query("with f as (select doc_id, sha256(text) as fp from documents where text is not null) select doc_id, fp, count(*) over (partition by fp) as n_same, min(doc_id) over (partition by fp) as first from f")
def alias_groups(spark, d):
    x = read(spark, d, "documents").where("text is not null").select("doc_id", F.sha2(F.col("text"), 256).alias("fp"))
    return joins.aliases(x, fingerprint="fp", name="doc_id")


@query("select source, lang, count(*) as n, count(distinct sha256(text)) as n_seen from documents group by all")
def resume_state(spark, d):
    return read(spark, d, "documents").groupBy("source", "lang").agg(F.count("*").alias("n"), F.countDistinct(F.sha2(F.col("text"), 256)).alias("n_seen"))


@query("""with e as (select event_id, user_id, event_type, value, row_number() over (partition by user_id, event_type order by ts desc, event_id desc) as r from events) select user_id, event_type, value as p_fake from e where r = 1""")
def last_score_wins(spark, d):
    from ..sources.manifests import last_score

    e = read(spark, d, "events").withColumn("at", F.struct("ts", "event_id")).withColumnRenamed("value", "p_fake")
    return last_score(e, ["user_id", "event_type"], "at")


@query(f"with {SQL_DOCS} select 'a' as k, array_to_string(list_sort(list_distinct(list(distinct source))), ',') as sources, count(distinct generator) as n from dm")
def distinct_lists(spark, d):
    return documents(spark, d).agg(F.array_join(F.array_sort(F.collect_set("source")), ",").alias("sources"), F.countDistinct("generator").alias("n")).withColumn("k", F.lit("a"))
