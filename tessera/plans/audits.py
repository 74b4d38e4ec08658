"""Queries of the audit reports, each with its SQL."""

from pyspark.sql import functions as F

from ..operators import audits, metrics, sampling
from .evaluation import SQL_H, SQL_VIEWS, view_scores
from .views import SQL_MANIFEST, SQL_SCORES, manifest as manifest_v, read, scores

Q: dict = {}
S: dict = {}


def query(sql: str | None = None):
    def add(f):
        Q[f.__name__] = f
        if sql:
            S[f.__name__] = sql
        return f

    return add


@query(f"""with {SQL_H}, u as (select tier, n1, n0, n1 * coalesce(sum(n0) over (partition by tier order by p rows between unbounded preceding and 1 preceding), 0) as u from h)
select tier, sum(n1)::bigint as n1, sum(n0)::bigint as n0, sum(u)::double / nullif(sum(n1)::double * sum(n0), 0) as auc from u group by tier""")
def rank_auc(spark, d):
    return metrics.rank_auc(scores(spark, d), ["tier"])


@query(f"""with {SQL_SCORES}, g as (select grp, y, count(*) as n, avg(((p >= 0.51) = (y = 1))::int::double) as a, round(avg(p), 6) as mean_p from s group by grp, y)
select grp, y, n, round(a, 6) as accuracy, mean_p, case when y = 1 and a < 0.25 then 'MISSED' when y = 0 and a < 0.5 then 'FALSE ALARMS' else '' end as flag from g""")
def baseline_flags(spark, d):
    return audits.baseline_flags(scores(spark, d), "grp", 0.51)


VIEW_Y = "(label >= 5)::int"


def labelled_views(spark, d):
    y = read(spark, d, "embeddings").select("vec_id", (F.col("label") >= 5).cast("int").alias("y"), (F.col("label") % 5).alias("grp"))
    return view_scores(spark, d).join(y, "vec_id")


SQL_LV = SQL_VIEWS + f", lv as (select v.vec_id, v.view, v.p, {VIEW_Y} as y, label % 5 as grp from v join embeddings using (vec_id))"


@query(f"""with {SQL_LV}, b as (select view, round((avg((p < 0.5)::int::double) filter (y = 0) + avg((p >= 0.5)::int::double) filter (y = 1)) / 2, 6) as balanced from lv group by view)
select view, grp, count(*) as n, round(avg(p), 6) as mean_p, round(avg(((p >= 0.5) = (y = 1))::int::double), 6) as accuracy, any_value(balanced) as balanced from lv join b using (view) group by view, grp""")
def variant_report(spark, d):
    return audits.variant_report(labelled_views(spark, d), "grp", "view")


PERCENT = """count(*) as n, round(100 * avg(((p >= 0.5) = (y = 1))::int::double), 2) as accuracy, round(2.0::double * count(*) filter (p >= 0.5 and y = 1) / nullif(2 * count(*) filter (p >= 0.5 and y = 1) + count(*) filter ((p >= 0.5) <> (y = 1)), 0), 4) as f1,
round(100 * avg((p < 0.5)::int::double) filter (y = 0), 2) as real_accuracy, round(100 * avg((p >= 0.5)::int::double) filter (y = 1), 2) as fake_accuracy"""


def auc_sql(frm: str, by: str) -> str:
    return f"""ha as (select {by}, p, count(*) filter (y = 1) as n1, count(*) filter (y = 0) as n0 from {frm} group by {by}, p), ua as (select *, n1 * (2 * coalesce(sum(n0) over (partition by {by} order by p rows between unbounded preceding and 1 preceding), 0) + n0) as u2 from ha),
au as (select {by}, sum(u2)::double / nullif(2 * sum(n1)::double * sum(n0), 0) as auc from ua group by {by})"""


@query(f"""with {SQL_SCORES}, t as (select case vec_id % 4 when 0 then 'highres' when 1 then 'medres256' when 2 then 'lowres32' end as tier, y, p from s where vec_id % 4 < 3), {auc_sql('t', 'tier')}
select t.tier, {PERCENT}, round(any_value(auc), 4) as auc from t join au using (tier) group by t.tier""")
def tiers_by_prefix(spark, d):
    prefix = F.element_at(F.array(*[F.lit(x) for x in ("highres_", "medres256_", "lowres32_", "other_")]), (F.col("vec_id") % 4 + 1).cast("int"))
    s = scores(spark, d).withColumn("path", F.concat(F.lit("test/x_y/"), prefix, F.col("vec_id").cast("string"), F.lit(".png")))
    return audits.by_prefix(s, "path", ["highres_", "medres256_", "lowres32_"])


STRATEGIES = {"single": (0,), "flip": (0, 1), "five": (2, 3), "all": (0, 1, 2, 3)}
SQL_ST = SQL_LV + ", st(strategy, place, view) as (values " + ", ".join(f"('{k}', {i}, {v})" for i, (k, vs) in enumerate(STRATEGIES.items()) for v in vs) + "), sp as (select strategy, place, vec_id, y, round(avg(p), 9) as p from lv join st using (view) group by all)"


@query(f"""with {SQL_ST}, {auc_sql('sp', 'strategy')} select sp.strategy, {PERCENT}, round(any_value(auc), 4) as auc, sp.strategy = (select strategy from au join (select distinct strategy, place from sp) using (strategy) order by auc desc, place limit 1) as best
from sp join au using (strategy) group by sp.strategy""")
def strategy_choice(spark, d):
    pairs = F.explode(F.array(*[F.struct(F.lit(k).alias("strategy"), F.lit(i).alias("place"), F.lit(v).alias("_v")) for i, (k, vs) in enumerate(STRATEGIES.items()) for v in vs]))
    v = labelled_views(spark, d).withColumn("s", pairs).where("view = s._v")
    sp = v.groupBy("s.strategy", "s.place", "vec_id", "y").agg(F.round(F.avg("p"), 9).alias("p"))
    return audits.choose_strategy(sp, "strategy", "place")


@query("""with j as (select toxic as y, d.* from documents d join labels using (doc_id)), f as (select y, 'n_chars' as feature, n_chars::double as p from j union all select y, 'words', len(regexp_extract_all(text, '[^ ]+'))::double from j union all select y, 'lines', (len(text) - len(replace(text, chr(10), '')))::double from j),
h as (select feature, p, count(*) filter (y = 1) as n1, count(*) filter (y = 0) as n0 from f where p is not null group by 1, 2), u as (select *, n1 * coalesce(sum(n0) over (partition by feature order by p rows between unbounded preceding and 1 preceding), 0) as u from h)
select feature, sum(n1)::bigint as n1, sum(n0)::bigint as n0, sum(u)::double / nullif(sum(n1)::double * sum(n0), 0) as auc from u group by feature""")
def feature_auc(spark, d):
    j = read(spark, d, "documents").join(read(spark, d, "labels"), "doc_id")
    j = j.select("toxic", "n_chars", F.regexp_count("text", F.lit("[^ ]+")).alias("words"), F.regexp_count("text", F.lit("\n")).alias("lines"))
    return audits.feature_auc(j, ["n_chars", "words", "lines"], F.col("toxic") == 1)


def runs(spark, d):
    return read(spark, d, "orders").select(F.col("o_custkey").alias("run"), F.col("o_orderkey").alias("epoch"), (F.col("o_totalprice") / 1000).alias("loss"))


@query("""with recursive r as (select o_custkey as run, o_orderkey as epoch, o_totalprice / 1000 as loss, row_number() over (partition by o_custkey order by o_orderkey) as i from orders),
s as (select run, i, loss as best, 0 as waited, null::bigint as stopped from r where i = 1
 union all select r.run, r.i, case when loss < best - 0.5 then loss else best end, case when loss < best - 0.5 then 0 else waited + 1 end, case when not (loss < best - 0.5) and waited + 1 >= 3 then epoch end from s join r on r.run = s.run and r.i = s.i + 1 where stopped is null)
select run, arg_max(best, i) as best, arg_max(waited, i)::int as waited, max(stopped) as stopped from s group by run""")
def early_stopping(spark, d):
    return audits.early_stopping(runs(spark, d), "run", "epoch", "loss", patience=3, min_delta=0.5)


@query("select o_custkey as run, arg_max(o_orderkey, (floor(o_totalprice / 10000), -o_orderkey)) as epoch, max(floor(o_totalprice / 10000))::bigint as value from orders group by 1")
def first_best_epoch(spark, d):
    r = runs(spark, d).select("run", "epoch", F.floor(F.col("loss") / 10).alias("value"))
    return audits.first_best(r, "run", "epoch", "value")


@query("""with recursive c as (select lang, source, count(*) as n, row_number() over (partition by lang order by source) - 1 as i, count(*) over (partition by lang) as m from documents where lang is not null and source is not null group by 1, 2),
t as (select lang, source, i, m, least(n, ceil(30 / m::double))::bigint as take, least(n, ceil(30 / m::double))::bigint as got from c where i = 0
 union all select c.lang, c.source, c.i, c.m, least(n, ceil((30 - got) / (c.m - c.i)::double))::bigint, got + least(n, ceil((30 - got) / (c.m - c.i)::double))::bigint from t join c on c.lang = t.lang and c.i = t.i + 1)
select lang, source, take from t""")
def quota_roll_forward(spark, d):
    c = read(spark, d, "documents").where("lang is not null and source is not null").groupBy("lang", "source").agg(F.count("*").alias("n"))
    return audits.roll_forward(c, "lang", "source", "n", 30)


SQL_CS = SQL_MANIFEST + ", cs as (select source as config, split, doc_id from m)"


@query(f"""with {SQL_CS}, g as (select count(*) as n from (select distinct config from cs), (select distinct split from cs where split <> 'holdout')),
r as (select *, row_number() over (partition by config, split order by doc_id) as r from cs where split <> 'holdout') select config, split, doc_id from r, g where r <= greatest(1, 100 // n)""")
def config_split_quota(spark, d):
    m = manifest_v(spark, d).select(F.col("source").alias("config"), "split", "doc_id")
    return audits.target_quota(m, m.select("config"), m.where("split <> 'holdout'").select("split"), "doc_id", 100)


SQL_RT = SQL_MANIFEST + ", rt as (select doc_id, label, case when n_chars <= 500 then 'low' when n_chars <= 2000 then 'mid' else 'high' end as tier from m)"


@query(f"""with {SQL_RT}, n as (select tier, min(n) as least from (select tier, label, count(*) as n from rt group by all) group by tier), r as (select *, row_number() over (partition by tier, label order by doc_id) as r from rt)
select r.tier, label, doc_id from r join n using (tier) where r <= case tier when 'high' then least(least, 40) when 'mid' then 25 else 10 end""")
def balanced_tiers(spark, d):
    tier = F.when(F.col("n_chars") <= 500, "low").when(F.col("n_chars") <= 2000, "mid").otherwise("high")
    m = manifest_v(spark, d).select("doc_id", "label", tier.alias("tier"))
    return audits.balanced_tiers(m, "tier", "label", "doc_id", {"high": 40, "mid": 25, "low": 10}, ["high"]).select("tier", "label", "doc_id")


@query(f"""with {SQL_LV}, a as (select grp, view::varchar as scheme, round(avg(((p >= 0.5) = (y = 1))::int::double), 6) as acc from lv group by all), b as (select grp, max(acc) as best_value, max(acc) filter (scheme = '0') as served from a group by grp)
select b.grp, min(scheme) as best, best_value, round(best_value - served, 6) as delta from b join a on a.grp = b.grp and acc = best_value group by b.grp, best_value, served""")
def scheme_delta(spark, d):
    a = labelled_views(spark, d).groupBy("grp", F.col("view").cast("string").alias("scheme")).agg(F.round(F.avg(((F.col("p") >= 0.5) == (F.col("y") == 1)).cast("double")), 6).alias("acc"))
    return audits.scheme_delta(a, "grp", "scheme", "acc", "0")


@query(f"with {SQL_SCORES} select vec_id, case when vec_id % 3 = 0 then 0.0 when vec_id % 3 = 1 then p else round(1 - p, 10) end as p_fake from s")
def class_probability(spark, d):
    # estimators whose classes are (cat, dog), (fake, real) and (real, fake)
    s = scores(spark, d).withColumn("q", F.round(1 - F.col("p"), 10))
    names = F.when(F.col("vec_id") % 3 == 0, F.array(F.lit("cat"), F.lit("dog"))).when(F.col("vec_id") % 3 == 1, F.array(F.lit("fake"), F.lit("real"))).otherwise(F.array(F.lit("real"), F.lit("fake")))
    return s.select("vec_id", audits.class_probability(names, F.array("p", "q"), "fake").alias("p_fake"))


@query(f"with {SQL_MANIFEST} select doc_id, split, label from m where split = 'train' order by doc_id limit 50")
def training_head(spark, d):
    return audits.training_rows(manifest_v(spark, d), "train", "doc_id", 50).select("doc_id", "split", "label")


@query(f"with {SQL_MANIFEST} select doc_id, row_number() over (order by split, sha256, doc_id) - 1 as place from m where split in ('train', 'val')")
def extraction_order(spark, d):
    m = manifest_v(spark, d).where("split in ('train', 'val')").select("doc_id", "split", "sha256")
    p = sampling.placed(m, ["split", "sha256", "doc_id"], bucket=F.concat("split", F.substring("sha256", 1, 2)))
    return p.select("doc_id", "place")


@query("select event_id, array_to_string(list_sort(list_filter(['k', 'seed', 'step'], lambda x: not list_contains(json_keys(props), x))), ',') as missing from events")
def missing_fields(spark, d):
    return read(spark, d, "events").select("event_id", F.array_join(audits.missing_fields(F.json_object_keys("props"), ["k", "seed", "step"]), ",").alias("missing"))
