"""Queries on contrast detection, splits, gold scoring, gates and further selections."""

from __future__ import annotations

from pyspark.sql import functions as F

from assayloom.functions.columns import sex_label
from assayloom.operators import audits as A
from assayloom.operators import designs as D
from assayloom.operators import evaluation as E
from assayloom.operators import genesets as G
from assayloom.operators import results as R
from assayloom.operators import selection as L
from assayloom.operators import sets as S
from assayloom.plans.registry import query

LABELS = "select * from {sample_attr} where attr in ('condition', 'title')"
DETECT = r"""
v as (select study_id, attr, value, count(*) as n, min(ord) as ord, min(sample_id) as first from {sample_attr} where regexp_matches(attr, 'characteristics|title|source|treatment|group|condition|phenotype|time') group by all),
r as (select v.*, case when regexp_matches(lower(value), 'control|building') and (not regexp_matches(lower(value), 'treated|house|auto') or regexp_matches(lower(value), '\b(pre|baseline|basal|sedentary|untrained|sham|control|vehicle|naive|wildtype|wild-type)\b')) then 'control'
  when regexp_matches(lower(value), 'treated|house|auto') and not regexp_matches(lower(value), 'control|building') then 'treatment' end as role from v join (select study_id, attr from v group by all having count(*) between 2 and 8) using (study_id, attr)),
c as (select study_id, attr, value as control, n as n_control from (select * from r where role = 'control' qualify row_number() over (partition by study_id, attr order by first, value) = 1) where n >= 2),
j as (select r.study_id, attr, ord, value as treatment, n as n_treatment, control, n_control from r join c using (study_id, attr) where role = 'treatment' and n >= 2),
s as (select study_id, attr, count(*) as k, min(ord) as ord, 1 + case when regexp_matches(attr, 'treatment|condition|time') then 1 else 0 end + case when min(least(n_control, n_treatment)) >= 3 then 1 else 0 end as score from j group by study_id, attr),
b as (select study_id, attr, score from s qualify row_number() over (partition by study_id order by score desc, k desc, ord, attr) = 1)"""
WORDS = (["treated", "house", "auto"], ["control", "building"])


@query("ds_02_contrast_detection", f"with {DETECT} select study_id, attr, control, treatment, n_control, n_treatment, score from j join b using (study_id, attr)")
def ds_02(t):
    return D.detect_contrasts(t.sample_attr, *WORDS)


@query("ds_03_confidence_gate", f"with {DETECT}, m as (select study_id, count(distinct attr) as n_columns from j group by study_id) select study_id, n_columns, min(least(n_control, n_treatment)) as least, n_columns = 1 and min(least(n_control, n_treatment)) >= 3 as confident from j join b using (study_id, attr) join m using (study_id) group by study_id, n_columns")
def ds_03(t):
    return D.confident(D.detect_contrasts(t.sample_attr, *WORDS), D.detect_contrasts(t.sample_attr, *WORDS, every=True))


@query("ds_12_design_rank", "with s as (select * from {sample}) select study_id, count(*) as n_samples, 1 + (count(distinct condition) - 1) + (count(distinct subject) - 1) as n_columns, 1 + (count(distinct condition) - 1) + (count(distinct subject) - 1) as rank, count(*) - (count(distinct condition) + count(distinct subject) - 1) as residual_df from s group by study_id")
def ds_12(t):
    return D.design_rank(t.sample, ["condition", "subject"])


@query("ds_15_sex_split", """
with x as (select study_id, sample_id, max(case when attr = 'treatment' then value end) as condition, max(case when attr = 'sex' then case when lower(value) in ('f', 'female') then 'female' when lower(value) in ('m', 'male') then 'male' end end) as sex from {sample_attr} where study_id like 'CU%' group by all),
c as (select study_id, sex, condition, count(*) as n from x where sex is not null group by all) select study_id, sex, count(*) as n_arms, min(n) as least, count(*) >= 2 and min(n) >= 3 as analyzable from c group by study_id, sex""")
def ds_15(t):
    w = t.sample_attr.where("study_id like 'CU%'").groupBy("study_id", "sample_id").pivot("attr", ["treatment", "sex"]).agg(F.first("value"))
    return D.sex_split(w.select("study_id", F.col("treatment").alias("condition"), sex_label(F.col("sex")).alias("sex")))


@query("ds_16_suitability", """
with c as (select study_id, 'replicates' as "check", case when min(n) >= 3 then 'pass' else 'fail' end as status from (select study_id, condition, count(*) as n from {sample} group by all) group by study_id union all select study_id, 'levels', case when count(distinct batch) >= 6 then 'pass' else 'fail' end from {sample} group by study_id)
select study_id, count(*) as n_checks, count(case when status = 'fail' then 1 end) as n_failed, coalesce(array_to_string(list_sort(list("check") filter (status = 'fail')), ';'), '') as failed, case when count(case when status = 'fail' then 1 end) > 0 then 'fail' else 'pass' end as verdict from c group by study_id""")
def ds_16(t):
    a = t.sample.groupBy("study_id", "condition").agg(F.count(F.lit(1)).alias("n")).groupBy("study_id").agg(F.lit("replicates").alias("check"), F.when(F.min("n") >= 3, "pass").otherwise("fail").alias("status"))
    b = t.sample.groupBy("study_id").agg(F.lit("levels").alias("check"), F.when(F.countDistinct("batch") >= 6, "pass").otherwise("fail").alias("status"))
    return D.suitability(a.union(b))


@query("ds_17_study_split", r"""
with n as (select study_id, value, count(*) as n, try_cast(nullif(regexp_extract(value, '(\d+(?:\.\d+)?)', 1), '') as double) as number from {sample_attr} where attr = 'age' and value <> 'n/a' group by study_id, value),
o as (select *, row_number() over (partition by study_id order by number nulls last, value) as place from n)
select x.study_id, x.study_id || '__' || regexp_replace(lower(x.value), '[^a-z0-9]+', '_', 'g') as control_study, x.study_id || '__' || regexp_replace(lower(y.value), '[^a-z0-9]+', '_', 'g') as treatment_study, x.value as control, y.value as treatment, least(x.n, y.n) as least_n, x.n + y.n as both_arms_n from o x join o y on x.study_id = y.study_id and x.place < y.place""")
def ds_17(t):
    return D.split_study(t.sample_attr, "age")


#: Ages with a baseline: the order of levels, with how many samples they have.
AGES = r"""
with v as (select study_id, case when value like '6 %' then 'baseline ' || value else value end as value from {sample_attr} where attr = 'age' and value <> 'n/a'),
n as (select study_id, value, count(*) as n, try_cast(nullif(regexp_extract(value, '(\d+(?:\.\d+)?)', 1), '') as double) as number, starts_with(value, 'baseline') as base from v group by all),
o as (select *, row_number() over (partition by study_id order by base desc, number nulls last, value) as place from n),
j as (select x.study_id, x.study_id || '__' || regexp_replace(lower(x.value), '[^a-z0-9]+', '_', 'g') as control_study, x.study_id || '__' || regexp_replace(lower(y.value), '[^a-z0-9]+', '_', 'g') as treatment_study, x.value as control, y.value as treatment, least(x.n, y.n) as least_n, x.n + y.n as both_arms_n, x.base as cb, y.base as tb, x.place as cp, y.place as tp from o x join o y on x.study_id = y.study_id and x.place < y.place)"""


def aged(t):
    return t.sample_attr.withColumn("value", F.when((F.col("attr") == "age") & F.col("value").startswith("6 "), F.concat(F.lit("baseline "), "value")).otherwise(F.col("value")))


@query("ds_17b_split_by_baseline", AGES + " select * exclude (cb, tb, cp, tp) from j where cb and not tb")
def ds_17b(t):
    return D.split_study(aged(t), "age", "baseline")


@query("ds_17c_split_adjacent", AGES + " select * exclude (cb, tb, cp, tp) from j where (cb and cp = 1) or cp + 1 = tp qualify row_number() over (partition by study_id order by (cb and cp = 1) desc, tp) <= 4")
def ds_17c(t):
    return D.split_study(aged(t), "age", "baseline+adjacent", 4)


@query("ev_02_set_run_stability", """
with g as (select study_id as run_id, set_id, nes, fdr_q < 0.6 as sig from {gsea})
select a.run_id as run_a, b.run_id as run_b, count(*) as n_common, round(corr(a.nes, b.nes), 6) as r, count(case when a.sig and b.sig then 1 end) as sig_both, count(case when a.sig or b.sig then 1 end) as sig_any from g a join g b using (set_id) where a.run_id < b.run_id group by all""")
def ev_02(t):
    return E.set_run_stability(t.gsea.withColumnRenamed("study_id", "run_id"), 0.6)


@query("ev_04_stability_gate", """
with d as (select * from {run_deg} where run_id <> 'runR' or feature_id <> 'F7'), p as (select a.run_id as x, b.run_id as y, corr(a.log2fc, b.log2fc) as r, count(case when a.padj < 0.3 and b.padj < 0.3 then 1 end) / count(case when a.padj < 0.3 or b.padj < 0.3 then 1 end) as j from d a join d b using (feature_id) where a.run_id < b.run_id group by all),
n as (select count(distinct run_id) as n_runs, (select min(k) from (select feature_id, count(distinct run_id) as k from d group by feature_id)) as fewest from d)
select count(*) as n_pairs, any_value(n_runs) as n_runs, any_value(n_runs >= 3 and fewest = n_runs) as complete, round(min(r), 6) as least_r, round(min(j), 6) as least_jaccard, any_value(n_runs >= 3 and fewest = n_runs) and min(r) >= 0.99 and min(j) >= 0.95 as stable from p, n""")
def ev_04(t):
    """One run lacks a feature."""
    return E.stability_gate(t.run_deg.where("run_id <> 'runR' or feature_id <> 'F7'"), 0.3)


@query("ev_08_contrast_gold", """
with g as (select study_id, sample_id, case when condition = 'treated' then 'exercise' else 'rest' end as role from {sample} where ord % 10 <> 0),
c as (select study_id, 'control' as control, 'treated' as treatment, 'right' as contrast from (select distinct study_id from {sample}) union all select study_id, 'treated', 'control', 'turned' from (select distinct study_id from {sample}) union all select study_id, 'control', 'placebo', 'lost' from (select distinct study_id from {sample})),
n as (select c.study_id, contrast, count(case when s.condition = treatment and role = 'exercise' then 1 end) as te, count(case when s.condition = treatment and role = 'rest' then 1 end) as tr, count(case when s.condition = control and role = 'exercise' then 1 end) as ce, count(case when s.condition = control and role = 'rest' then 1 end) as cr from c join {sample} s using (study_id) left join g using (study_id, sample_id) group by all)
select *, case when te + tr = 0 or ce + cr = 0 then 'unscorable' when te > tr and cr > ce then 'correct' when tr > te and ce > cr then 'reversed' else 'mixed' end as verdict from n""")
def ev_08(t):
    g = t.sample.where("ord % 10 <> 0").select("study_id", "sample_id", F.when(F.col("condition") == "treated", "exercise").otherwise("rest").alias("role"))
    named = lambda c, x, n: F.struct(F.lit(c).alias("control"), F.lit(x).alias("treatment"), F.lit(n).alias("contrast"))
    c = t.sample.select("study_id").distinct().select("study_id", F.inline(F.array(named("control", "treated", "right"), named("treated", "control", "turned"), named("control", "placebo", "lost"))))
    return S.gold_verdicts(c, t.sample.select("study_id", "sample_id", "condition"), g)


@query("ev_09_decision_routing", "select case_id, stage, seq, case when decision_status = 'blocked' and confidence = 'high' then 'refuse' when decision_status = 'blocked' then 'override' when confidence = 'high' then 'confident' else 'confirm' end as route from {decision}")
def ev_09(t):
    return E.route_decisions(t.decision)


@query("ev_16_production_gate", "with o as (select case_id, count(*) as n, count(case when decision_status = 'blocked' then 1 end) as b from {decision} group by case_id) select case_id, n >= 2 as enough_records, b = 0 as unblocked, array_to_string(list_filter([case when n < 2 then 'enough_records' end, case when b > 0 then 'unblocked' end], lambda x: x is not null), ',') as blocking from o")
def ev_16(t):
    return E.production_gate(t.decision)


@query("agg_09_result_sanity", "with s as (select study_id, min(n) as arm from (select study_id, condition, count(*) as n from {sample} group by all) group by study_id), d as (select study_id, method, round(count(case when padj < 0.9 then 1 end) / count(padj), 6) as share from {deg} group by all) select study_id, method, share, arm, array_to_string(list_filter([case when share > 0.5 then 'most features significant' end, case when arm < 3 then 'small arm' end], lambda x: x is not null), ';') as flags from d join s using (study_id)")
def agg_09(t):
    return E.result_sanity(t.deg, t.sample, 0.9)


GOLD = ("o_orderpriority", "o_orderstatus", "o_clerk")


@query("agg_18_gold_sample_dedupe", "with " + ", ".join(f"{c} as (select o_custkey, string_agg({c}, ';' order by k) as {c} from (select o_custkey, {c}, min(o_orderkey) as k from o group by all) group by o_custkey)" for c in GOLD).replace("o_orderpriority as (", "o as (select o_custkey, o_orderkey, o_orderpriority, o_orderstatus, 'clerk' || o_orderkey % 4 as o_clerk from orders), o_orderpriority as (", 1) + ", n as (select o_custkey, count(*) as n, count(distinct o_orderstatus) > 1 or count(distinct o_orderpriority) > 1 as conflict from o group by o_custkey) select o_custkey as sample_id, o_orderpriority, o_orderstatus, o_clerk, n, conflict from n join o_orderpriority using (o_custkey) join o_orderstatus using (o_custkey) join o_clerk using (o_custkey)")
def agg_18(t):
    o = t.orders.select(F.col("o_custkey").alias("sample_id"), "o_orderkey", "o_orderpriority", "o_orderstatus", F.concat(F.lit("clerk"), F.col("o_orderkey") % 4).alias("o_clerk"))
    return E.gold_dedupe(o, "sample_id", "o_orderkey", ["o_orderstatus", "o_orderpriority"])


@query("agg_19_series_summary", "select study_id, count(case when condition = 'control' then 1 end) as n_rest, count(case when condition = 'treated' then 1 end) as n_exercise, count(distinct batch) as n_strata, case when count(distinct subject) < count(*) then 'paired' else 'independent' end as design from {sample} group by study_id")
def agg_19(t):
    return E.series_summary(t.sample, "control", "treated", "batch")


@query("agg_26_dataset_labels", "with n as (select study_id, count(distinct attr) as k, count(distinct sample_id) as s from {sample_attr} group by study_id) select study_id, case when k >= 6 then 'complex_metadata;' else '' end || case when s > 200 then 'large' else 'routine' end as labels from n")
def agg_26(t):
    return E.dataset_labels(t.sample_attr)


@query("win_10_triage_order", "select source as batch, doc_id, row_number() over (partition by source order by contains(text, 'token') desc, n_chars > 2000 desc, doc_id) as place from documents")
def win_10(t):
    d = t.documents.select(F.col("source").alias("batch"), "doc_id", F.contains("text", F.lit("token")).alias("a"), (F.col("n_chars") > 2000).alias("b"))
    return L.triage(d, [F.col("a"), F.col("b")], "doc_id").select("batch", "doc_id", "place")


@query("win_13_head_and_random", """
with r as (select c_mktsegment, c_custkey, row_number() over (partition by c_mktsegment order by c_custkey) <= 5 as is_head from customer),
d as (select *, row_number() over (partition by c_mktsegment, is_head order by md5('42|' || c_custkey), c_custkey) as draw from r)
select c_mktsegment, c_custkey, is_head from d where is_head or draw <= 5""")
def win_13(t):
    return L.head_and_random(t.customer.select("c_mktsegment", "c_custkey"), "c_mktsegment", "c_custkey", 5, 5)


@query("win_13b_pick_per_stratum", "select c_mktsegment, c_nationkey, c_custkey, c_acctbal from customer qualify row_number() over (partition by c_mktsegment, c_nationkey order by c_acctbal > 5000 desc, md5('42|' || c_custkey), c_custkey) = 1")
def win_13b(t):
    return L.pick_per_stratum(t.customer.select("c_mktsegment", "c_nationkey", "c_custkey", "c_acctbal"), ["c_mktsegment", "c_nationkey"], F.col("c_acctbal") > 5000, "c_custkey")


@query("win_14_quota_selection", """
with a as (select c_custkey, 'rich' as category from customer where c_acctbal > 9000 order by c_custkey limit 10), b as (select c_custkey, 'poor' as category from customer where c_acctbal < 500 and c_custkey not in (select c_custkey from a) order by c_custkey limit 10),
c as (select c_custkey, 'machinery' as category from customer where c_mktsegment = 'MACHINERY' and c_custkey not in (select c_custkey from a union all select c_custkey from b) order by c_custkey limit 10), x as (select * from a union all select * from b union all select * from c),
f as (select c_custkey, 'fill' as category from customer where c_custkey not in (select c_custkey from x) order by c_custkey limit 40)
select c_custkey, category from (select *, 0 as o from x union all select *, 1 as o from f) order by o, c_custkey limit 40""")
def win_14(t):
    return L.quota_select(t.customer, [("rich", F.col("c_acctbal") > 9000, 10), ("poor", F.col("c_acctbal") < 500, 10), ("machinery", F.col("c_mktsegment") == "MACHINERY", 10)], "c_custkey", 40)


@query("typ_05_bounded_preview", "with p as (select l_returnflag as study_id, l_discount as value from lineitem where l_discount <> 0 qualify row_number() over (partition by l_returnflag order by l_orderkey, l_linenumber, l_partkey, l_suppkey) <= 80) select study_id, count(*) as n, round(avg(case when value < 0 then 1.0 else 0 end), 6) as negative, round(avg(case when value between 0 and 1 then 1.0 else 0 end), 6) as in_unit, round(avg(case when value = round(value) then 1.0 else 0 end), 6) as whole from p group by study_id")
def typ_05(t):
    p = R.first_n(t.lineitem.where("l_discount <> 0"), ["l_returnflag"], 80, "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey")
    v, share = F.col("l_discount"), lambda c: F.round(F.avg(c.cast("double")), 6)
    return p.groupBy(F.col("l_returnflag").alias("study_id")).agg(F.count(F.lit(1)).alias("n"), share(v < 0).alias("negative"), share(v.between(0, 1)).alias("in_unit"), share(v == F.rint(v)).alias("whole"))


TYPES = "(values ('expression profiling by high throughput sequencing', 'rnaseq'), ('expression profiling by array', 'microarray'), ('methylation profiling', 'methylation'))"


@query("typ_13_series_type", """
with r as (select p_partkey, ['Expression profiling by high throughput sequencing', 'Expression profiling by array; Methylation profiling', 'Other', ''][1 + p_partkey % 4] as gds, case when p_partkey % 8 = 0 then 'single-cell RNA' else 'bulk' end as text from part)
select p_partkey, case when gds = '' then 'unknown' when gds = 'Other' then 'other' when p_partkey % 4 = 0 then case when contains(text, 'single-cell') then 'scrnaseq' else 'rnaseq' end else 'microarray+methylation' end as kind from r""")
def typ_13(t):
    from assayloom.operators.matrix import series_type

    k = F.col("p_partkey")
    gds = F.element_at(F.array(*map(F.lit, ("Expression profiling by high throughput sequencing", "Expression profiling by array; Methylation profiling", "Other", ""))), (k % 4 + 1).cast("int"))
    return t.part.select("p_partkey", series_type(gds, F.when(k % 8 == 0, "single-cell RNA").otherwise("bulk")).alias("kind"))


@query("gs_10_chain_view", "select 'In ' || g.study_id || ', ' || set_id || case when nes >= 0 then ' goes up' else ' goes down' end || ' (' || n || ' samples)' as line from {gsea} g join (select study_id, count(*) as n from {sample} group by study_id) s using (study_id) where fdr_q < 0.6")
def gs_10(t):
    return G.chain_view(t.gsea, t.sample, 0.6)


@query("au_04_trust_rules", "select claim_id, evidence_id, 'untrusted evidence cannot support' as message from {link} where relation = 'supports' and evidence_id % 4 = 3")
def au_04(t):
    trust = t.link.select("evidence_id").distinct().withColumn("trusted", F.col("evidence_id") % 4 != 3)
    return A.untrusted_support(t.link, trust)


@query("au_13_artifact_check", "with e as (select p_partkey as path, md5(p_name) as digest from part where p_partkey % 7 <> 2), a as (select p_partkey as path, md5(case when p_partkey % 11 = 0 then 'x' else p_name end) as digest from part where p_partkey % 9 <> 4) select coalesce(e.path, a.path) as path, case when a.path is null then 'missing' when e.path is null then 'unexpected' else 'digest mismatch' end as message from e full join a on e.path = a.path where e.digest is distinct from a.digest")
def au_13(t):
    e = t.part.where("p_partkey % 7 <> 2").select(F.col("p_partkey").alias("path"), F.md5("p_name").alias("e"))
    a = t.part.where("p_partkey % 9 <> 4").select(F.col("p_partkey").alias("path"), F.md5(F.when(F.col("p_partkey") % 11 == 0, "x").otherwise(F.col("p_name"))).alias("a"))
    return A.artifact_check(e.withColumnRenamed("e", "digest"), a.withColumnRenamed("a", "digest"))
