"""Queries over scores: operating points, ROC, thresholds, boards, panels and reports, each with its SQL."""

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import joins, metrics, reports, tiers
from ..session import written
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


POINT = "round({r}, 6) as real_acc, round({f}, 6) as fake_recall, round(1 - {r}, 6) as fpr, round(({r} + {f}) / 2, 6) as balanced"


def point(thr: str) -> str:
    return POINT.format(r=f"avg((p < {thr})::int::double) filter (y = 0)", f=f"avg((p >= {thr})::int::double) filter (y = 1)")


@query(f"with {SQL_SCORES} select tier, {point('0.5')} from s group by tier")
def at_threshold(spark: SparkSession, d: str) -> DataFrame:
    return metrics.at_threshold(scores(spark, d), 0.5, ["tier"])


SQL_H = SQL_SCORES + ", h as (select tier, p, count(*) filter (y = 1) as n1, count(*) filter (y = 0) as n0 from s group by tier, p)"
SQL_AUC = SQL_H + """, u as (select *, n1 * (2 * coalesce(sum(n0) over (partition by tier order by p rows between unbounded preceding and 1 preceding), 0) + n0) as u2 from h),
auc as (select tier, sum(n1)::bigint as n1, sum(n0)::bigint as n0, sum(u2)::double / nullif(2 * sum(n1)::double * sum(n0), 0) as auc from u group by tier)"""


@query(f"with {SQL_AUC} select * from auc")
def roc_auc(spark, d):
    return metrics.roc_auc(scores(spark, d), ["tier"])


SQL_ROC = SQL_H + """, c as (select tier, p, (sum(n1) over w)::bigint as tp, (sum(n0) over w)::bigint as fp, (sum(n1) over (partition by tier))::bigint as n1, (sum(n0) over (partition by tier))::bigint as n0, count(*) over (partition by tier) as m from h window w as (partition by tier order by p desc rows unbounded preceding)),
b as (select *, lead(tp) over v - 2 * tp + lag(tp) over v as bt, lead(fp) over v - 2 * fp + lag(fp) over v as bf from c window v as (partition by tier order by p desc)),
roc as (select tier, p, tp, fp, n1, n0 from b where m <= 2 or bt is null or bt <> 0 or bf <> 0)"""


@query(f"with {SQL_ROC} select * from roc")
def roc_curve(spark, d):
    return metrics.roc_curve(scores(spark, d), ["tier"])


SQL_THR = SQL_ROC + ", thr as (select tier, min(p) filter (n1 > 0 and n0 > 0 and 100 * fp <= 5 * n0) as threshold from roc group by tier)"


@query(f"with {SQL_THR} select * from thr")
def threshold_at_fpr(spark, d):
    return metrics.threshold_at_fpr(scores(spark, d), ["tier"])


@query(f"""with {SQL_SCORES}, t as (select tier, quantile_cont(p, 0.95) filter (y = 0) as t, count(*) filter (y = 1) as n1 from s group by tier), j as (select s.*, case when n1 > 0 then t end as threshold from s join t using (tier))
select tier, round(coalesce(threshold, 0.5), 9) as threshold, round(case when threshold is null then 0 else avg((p >= threshold)::int::double) filter (y = 1) end, 6) as recall from j group by tier, threshold""")
def percentile_threshold(spark, d):
    t = metrics.percentile_threshold(scores(spark, d), ["tier"])
    return t.select("tier", F.round("threshold", 9).alias("threshold"), F.round("recall", 6).alias("recall"))


@query(f"""with {SQL_SCORES}, g as (select distinct tier, round(p, 3) as t from s union select distinct tier, round(i / 100.0, 3)::double from s, range(5, 96) r(i)),
b as (select g.tier, t, round((coalesce(avg((p >= t)::int::double) filter (y = 1), 0) + coalesce(avg((p < t)::int::double) filter (y = 0), 0)) / 2, 9) as balanced from g join s on g.tier = s.tier group by all),
r as (select *, row_number() over (partition by tier order by balanced desc, t desc) as r from b) select tier, t as threshold, balanced from r where r = 1""")
def best_threshold(spark, d):
    return metrics.best_threshold(scores(spark, d), ["tier"])


@query(f"""with {SQL_THR} select thr.tier as fitted_on, s.tier, thr.threshold, round(avg((p < threshold)::int::double) filter (y = 0), 6) as real_acc, round(avg((p >= threshold)::int::double) filter (y = 1), 6) as fake_recall
from thr join s on thr.tier <> s.tier where threshold is not null group by all""")
def applied_threshold(spark, d):
    return metrics.applied_elsewhere(scores(spark, d), "tier")


@query(f"with {SQL_SCORES} select vec_id, round(1 / (1 + exp(ln(0.55 / 0.45) - ln(p / (1 - p)))), 6) as shifted from s")
def odds_shift(spark, d):
    return scores(spark, d).select("vec_id", F.round(metrics.odds_shift(F.col("p"), 0.55), 6).alias("shifted"))


@query(f"with {SQL_SCORES} select vec_id, (p > 0.05 and p < 0.90) or abs(margin) >= 0.22 as review, p > 0.30 and p < 0.97 as abstain from s")
def abstain_flags(spark, d):
    return scores(spark, d).select("vec_id", metrics.needs_review(F.col("p"), F.abs("margin")).alias("review"), metrics.abstains(F.col("p")).alias("abstain"))


@query(f"""with {SQL_SCORES} select grp, count(*) as n, count(*) filter (y = 0) as n_real, count(*) filter (y = 1) as n_fake, round(avg(((p >= 0.5) = (y = 1))::int::double), 6) as accuracy, round(avg((p < 0.5)::int::double) filter (y = 0), 6) as real_acc,
round(avg((p >= 0.5)::int::double) filter (y = 1), 6) as fake_recall, case when count(*) filter (y = 1) > 0 then round(count(*) filter (p >= 0.5 and y = 1)::double / nullif(count(*) filter (p >= 0.5), 0), 6) end as fake_precision from s group by grp""")
def group_metrics(spark, d):
    return reports.group_metrics(scores(spark, d), "grp")


OVERALL = """count(*) as n, round(avg(((p >= 0.5) = (y = 1))::int::double), 6) as accuracy, round((avg((p < 0.5)::int::double) filter (y = 0) + avg((p >= 0.5)::int::double) filter (y = 1)) / 2, 6) as balanced,
round(count(*) filter (p >= 0.5 and y = 1)::double / nullif(count(*) filter (p >= 0.5), 0), 6) as precision, round(avg((p >= 0.5)::int::double) filter (y = 1), 6) as recall,
round(2.0::double * count(*) filter (p >= 0.5 and y = 1) / nullif(2 * count(*) filter (p >= 0.5 and y = 1) + count(*) filter (p >= 0.5 and y = 0) + count(*) filter (p < 0.5 and y = 1), 0), 6) as f1,
round(avg(p) filter (y = 0), 6) as mean_p_real, round(avg(p) filter (y = 1), 6) as mean_p_fake"""


@query(f"with {SQL_AUC}, o as (select tier, {OVERALL} from s group by tier) select o.*, round(auc.auc, 6) as auc from o join auc using (tier)")
def overall_metrics(spark, d):
    return reports.overall_metrics(scores(spark, d), ["tier"])


@query(f"""with {SQL_SCORES}, g as (select grp, y, count(*) as n, round(avg(((p >= 0.5) = (y = 1))::int::double), 4) as accuracy, round(avg(p), 6) as mean_p, grouping(grp) as gg, grouping(y) as gy from s group by grouping sets ((grp, y), (y), ()))
select case when gg = 0 then 'group' when gy = 0 then 'class' else 'all' end as level, grp, y, n, accuracy, mean_p, case when gy = 1 then (select round(avg(accuracy), 4) from g where gg = 1 and gy = 0) end as balanced from g""")
def rollup_summary(spark, d):
    return reports.rollup_summary(scores(spark, d), "grp")


SQL_BOARD = SQL_AUC.replace(SQL_H, SQL_THR) + f""", base as (select tier, count(*) as n, count(*) filter (y = 0) as n_real, count(*) filter (y = 1) as n_fake, round(avg(p) filter (y = 0), 6) as mean_p_real, round(avg(p) filter (y = 1), 6) as mean_p_fake, {point('0.5')} from s group by tier),
there as (select s.tier, any_value(threshold) as oracle_threshold, round(avg((p >= threshold)::int::double) filter (y = 1), 6) as oracle_recall from s join thr using (tier) group by s.tier)
select base.*, round(auc.auc, 6) as auc, oracle_threshold, oracle_recall, oracle_threshold is not null as reachable, round(1.0::double / greatest(n_real, 1), 6) as fpr_resolution from base join auc using (tier) join there using (tier)"""


@query(f"with {SQL_BOARD}")
def score_board(spark, d):
    return reports.tier_board(scores(spark, d))


SQL_TIERS = SQL_MANIFEST + """, fs as (select distinct source_key from m where split in ('train', 'val')), fg as (select distinct generator from m where split in ('train', 'val') and label = 'fake'),
fl as (select m.*, source_key in (select source_key from fs) as kn_s, generator in (select generator from fg) as kn_g from m),
tr as (select *, 'T1_indist' as tier from fl where split = 'test' union all
 select *, 'T2_xsource' from fl where split = 'holdout' and ((label = 'fake' and kn_g and not kn_s) or (label = 'real' and not kn_s)) union all
 select *, 'T3_xgen' from fl where split = 'holdout' and ((label = 'fake' and not kn_g) or (label = 'real' and not kn_s))),
tiers as (select * from tr where tier = 'T1_indist' or tier in (select tier from tr group by tier having count(*) filter (label = 'fake') > 0 and count(*) filter (label = 'real') > 0))"""


@query(f"with {SQL_TIERS} select tier, label, count(*) as n from tiers group by all")
def tier_assignment(spark, d):
    return tiers.build_tiers(manifest_v(spark, d)).groupBy("tier", "label").agg(F.count("*").alias("n"))


@query(f"with {SQL_TIERS} select doc_id, source_key, generator from fl where split = 'holdout' and label = 'fake' and kn_s and kn_g")
def tier_leaks(spark, d):
    return tiers.tier_leaks(manifest_v(spark, d)).select("doc_id", "source_key", "generator")


@query(f"with {SQL_TIERS} select tier, coalesce(string_agg(distinct source_key, ', ' order by source_key) filter (label = 'real'), '') as negatives, coalesce(string_agg(distinct generator, ', ' order by generator) filter (label = 'fake'), '') as generators, coalesce(string_agg(distinct source_key, ', ' order by source_key) filter (label = 'fake' and kn_s), '') as shared from tiers group by tier")
def tier_sources(spark, d):
    return tiers.tier_sources(tiers.build_tiers(manifest_v(spark, d)))


DOC_P = "round(1 / (1 + exp(-(((doc_id * 7919) % 1009) / 1009.0::double - 0.5 + case when label = 'fake' then 0.25 else 0 end) * 4)), 6)"
SQL_TIER_BOARD = SQL_BOARD.replace(SQL_SCORES, SQL_TIERS + f", s as (select tier, (label = 'fake')::int as y, {DOC_P} as p from tiers)")


@query(f"with {SQL_TIER_BOARD}")
def tier_board(spark, d):
    """The flagship: held-out tiers of the manifest with a deterministic score, and all that is reported of a tier."""
    narrow = manifest_v(spark, d).select("doc_id", "source_key", "generator", "label", "split")
    t = tiers.build_tiers(written(narrow))  # asked for by each tier's condition: hashed and joined once
    x = (F.col("doc_id") * 7919 % 1009) / F.lit(1009.0) - 0.5 + F.when(F.col("label") == "fake", 0.25).otherwise(0)
    return reports.tier_board(t.select("tier", (F.col("label") == "fake").cast("int").alias("y"), F.round(1 / (1 + F.exp(-x * 4)), 6).alias("p")))


@query(f"""with {SQL_SCORES}, c as (select vec_id, p from s where vec_id % 3 <> 0) select tier, count(*) as n, round(sum(c.p), 4) as total, (select count(*) from s where vec_id % 3 = 0) as dropped from s join c using (vec_id) group by tier""")
def score_cache_lookup(spark, d):
    s = scores(spark, d)
    cache = s.where("vec_id % 3 <> 0").select("vec_id", F.col("p").alias("cached"))
    hit = joins.lookup(s, cache, ["vec_id"]).groupBy("tier").agg(F.count("*").alias("n"), F.round(F.sum("cached"), 4).alias("total"))
    return hit.crossJoin(F.broadcast(joins.lookup_misses(s, cache, ["vec_id"])))


BINS = [0, 500, 1000, 2000, 4000, 8000, None]


@query(f"""with {SQL_MANIFEST}, g as (select case when n_chars < 0 then null when n_chars < 500 then '0-500' when n_chars < 1000 then '500-1000' when n_chars < 2000 then '1000-2000' when n_chars < 4000 then '2000-4000' when n_chars < 8000 then '4000-8000' else '8000+' end as bin,
count(*) filter (label = 'real') as n_real, count(*) filter (label = 'fake') as n_fake, count(*) as n from m group by 1)
select bin, n_real, n_fake, round(n::double / sum(n) over (), 6) as share, round(n_fake::double / n, 6) as fake_share, n::double / sum(n) over () >= 0.02 and abs(n_fake::double / n - 0.5) > 0.2 as leak from g""")
def corpus_panel(spark, d):
    return reports.panel(manifest_v(spark, d), reports.range_bin(F.col("n_chars"), BINS))


@query(f"""with {SQL_MANIFEST}, g as (select generator, count(*) filter (label = 'real') as r, count(*) filter (label = 'fake') as f from m group by 1), x as (select generator, 100 * r::double / nullif(sum(r) over (), 0) as rs, 100 * f::double / nullif(sum(f) over (), 0) as fs from g)
select generator, round(rs, 6) as real_share, round(fs, 6) as fake_share, round(abs(rs - fs), 6) as gap, case when round(abs(rs - fs), 6) < 20 then 'OK' when round(abs(rs - fs), 6) < 45 then 'WATCH' else 'SHORTCUT RISK' end as verdict from x""")
def share_gap(spark, d):
    return reports.share_gap(manifest_v(spark, d), "generator")


@query(f"""with {SQL_MANIFEST} select case when grouping(split) = 1 then 'total' else split end as split, count(*) filter (label = 'real') as real, count(*) filter (label = 'fake') as fake, count(*) as total from m group by grouping sets ((split), ())""")
def split_label_crosstab(spark, d):
    return reports.crosstab(manifest_v(spark, d), "split", "label", ["real", "fake"])


@query("""with r as (select lang, n_chars, row_number() over (partition by lang order by n_chars) - 1 as i, count(*) over (partition by lang) as n from documents) select lang, min(n_chars) as least, max(n_chars) filter (i = n // 2) as upper_median, max(n_chars) as most, count(*) as n from r group by lang""")
def edge_summary(spark, d):
    return reports.edge_summary(read(spark, d, "documents"), "lang", "n_chars")


@query("with g as (select quality as label, count(*) as n from labels group by 1) select label, n, round(sum(n) over () / (2.0::double * greatest(n, 1)), 6) as weight, round(1 / (n + 1e-8::double) / sum(1 / (n + 1e-8::double)) over (), 6) as share from g")
def class_weights(spark, d):
    return reports.class_weights(read(spark, d, "labels"), "quality")


@query(f"with {SQL_SCORES}, o as (select tier, {OVERALL} from s group by tier) select tier, f1, accuracy, row_number() over (order by f1 desc, tier) as rank from o")
def leaderboard(spark, d):
    return reports.leaderboard(reports.overall_metrics(scores(spark, d), ["tier"]).select("tier", "f1", "accuracy"), "f1", "tier")


SQL_VIEWS = """e as (select vec_id, unnest(embedding)::double as v, generate_subscripts(embedding, 1) - 1 as i from embeddings), v as (select vec_id, i // 16 as view, round(1 / (1 + exp(-round(sum(v), 9))), 6) as p from e group by all)"""


def view_scores(spark, d):
    e = read(spark, d, "embeddings")
    total = lambda i: F.round(F.aggregate(F.slice("embedding", 16 * i + 1, 16), F.lit(0.0), lambda s, x: s + x.cast("double")), 9)
    return e.select("vec_id", F.posexplode(F.array(*[F.round(1 / (1 + F.exp(-total(i))), 6) for i in range(4)])).alias("view", "p"))


@query(f"with {SQL_VIEWS} select vec_id, round(avg(p), 9) as p from v where view <> 3 group by 1")
def view_ensemble(spark, d):
    from ..operators.learning import ensemble

    return ensemble(view_scores(spark, d), "vec_id", [3]).select("vec_id", F.round("p", 9).alias("p"))


@query(f"with {SQL_VIEWS} select vec_id, min(p) as least, max(p) as most, round(stddev_pop(p), 6) as spread, round(avg(p), 9) as mean from v group by 1")
def view_spread(spark, d):
    return reports.view_spread(view_scores(spark, d), "vec_id")


# Weights of frame, flip, five and native views by scheme.
SCHEMES = {"current (served)": (1, 1, 5, 5), "frame_only": (1, 1, 5, 0), "native_only": (0, 0, 0, 1), "native_75": (1, 1, 1, 9), "native_60": (1, 1, 2, 6), "no_fivecrop": (1, 1, 0, 5), "equal_per_group": (1, 1, 1, 1)}
SQL_W = ", ".join(f"('{k}', {i}, {w})" for k, ws in SCHEMES.items() for i, w in enumerate(ws))


@query(f"with {SQL_VIEWS}, w(scheme, view, w) as (values {SQL_W}) select scheme, vec_id, round(case when sum(w) > 0 then sum(w * p) / sum(w) else avg(p) end, 9) as p from v join w using (view) group by all")
def scheme_weighting(spark, d):
    pairs = F.explode(F.array(*[F.struct(F.lit(k).alias("scheme"), F.array(*[F.lit(float(x)) for x in ws]).alias("ws")) for k, ws in SCHEMES.items()]))
    v = view_scores(spark, d).withColumn("s", pairs).select("vec_id", "p", "s.scheme", F.get("s.ws", F.col("view")).alias("w"))
    return metrics.weighted_views(v, ["scheme", "vec_id"]).select("scheme", "vec_id", F.round("p", 9).alias("p"))


@query(f"with {SQL_SCORES} select grp, case when round(avg(((p >= 0.5) = (y = 1))::int::double), 6) < 0.58 then 'ok' when round(avg(((p >= 0.5) = (y = 1))::int::double), 6) < 0.68 then 'weak' when round(avg(((p >= 0.5) = (y = 1))::int::double), 6) < 0.85 then 'strong' else 'severe' end as verdict from s group by grp")
def probe_verdict(spark, d):
    return reports.group_metrics(scores(spark, d), "grp").select("grp", metrics.probe_verdict(F.col("accuracy")).alias("verdict"))


@query("""select o_orderpriority as run, min_by(o_orderkey, (k, o_orderkey)) as step from (select *, round(o_totalprice / 1000.0 + 0.05 * greatest(0, 96.5 - o_custkey % 100), 6) as k from orders) group by 1""")
def checkpoint_selection(spark, d):
    o = read(spark, d, "orders").withColumn("k", F.round(metrics.checkpoint_key(F.col("o_totalprice") / 1000.0, F.col("o_custkey") % 100), 6))
    return o.groupBy(F.col("o_orderpriority").alias("run")).agg(F.min_by("o_orderkey", F.struct("k", "o_orderkey")).alias("step"))


@query(f"with {SQL_SCORES}, r as (select vec_id, abs(margin) as w, tier from s), q as (select *, row_number() over (partition by tier order by w desc, vec_id) as r from r) select tier, vec_id, w from q where r <= 5")
def top_by_weight(spark, d):
    from ..operators.sampling import cap_per_group

    s = scores(spark, d).select("tier", "vec_id", F.abs("margin").alias("w"))
    return cap_per_group(s, ["tier"], [F.desc("w"), "vec_id"], 5)


@query("select source, count(*) as n, row_number() over (order by count(*) desc, source) as rank from documents group by source")
def most_common(spark, d):
    return reports.leaderboard(read(spark, d, "documents").groupBy("source").agg(F.count("*").alias("n")), "n", "source")


@query("select round(avg(n_chars), 6) as mean, quantile_cont(n_chars, 0.5)::double as median, lang from documents group by lang")
def feature_medians(spark, d):
    return read(spark, d, "documents").groupBy("lang").agg(F.round(F.avg("n_chars"), 6).alias("mean"), F.percentile("n_chars", 0.5).alias("median"))


@query(f"with {SQL_SCORES} select vec_id, (p >= 0.5)::int + (margin >= 0.01)::int + (grp % 2)::int as votes_fake, case when p >= 0.5 then (p >= 0.5)::int + (margin >= 0.01)::int + (grp % 2)::int else 3 - ((p >= 0.5)::int + (margin >= 0.01)::int + (grp % 2)::int) end as agree from s")
def advisory_votes(spark, d):
    label = lambda c: F.when(c, "FAKE").otherwise("REAL")
    votes = F.create_map(F.lit("a"), label(F.col("p") >= 0.5), F.lit("b"), label(F.col("margin") >= 0.01), F.lit("c"), label(F.col("grp") % 2 == 1))
    return scores(spark, d).select("vec_id", reports.agreement(votes, F.lit("FAKE")).alias("votes_fake"), reports.agreement(votes, label(F.col("p") >= 0.5)).alias("agree"))
