"""Queries on result tables: ranks, models, gene sets."""

from __future__ import annotations

from pyspark.sql import functions as F

from assayloom.functions.columns import r6
from assayloom.operators import genesets as G
from assayloom.operators import matrix as M
from assayloom.operators import results as R
from assayloom.operators import stats as S
from assayloom.plans.matrix_queries import MAPPING, mapping
from assayloom.plans.registry import query

BH = """
select study_id, contrast_id, method, feature_id, pvalue, round(min(raw) over (partition by study_id, contrast_id, method order by pvalue, feature_id rows between current row and unbounded following), 6) as q
from (select *, least(1.0, pvalue * count(pvalue) over (partition by study_id, contrast_id, method) / row_number() over (partition by study_id, contrast_id, method order by pvalue, feature_id)) as raw from {deg})"""


@query("win_01_benjamini_hochberg", BH)
def win_01(t):
    return R.adjusted(t.deg).select("study_id", "contrast_id", "method", "feature_id", "pvalue", r6("q").alias("q"))


@query("win_02_average_rank", "select study_id, sample_id, feature_id, rank() over (partition by study_id, sample_id order by value) + (count(*) over (partition by study_id, sample_id, value) - 1) / 2 as avg_rank from {measure}")
def win_02(t):
    return R.average_rank(t.measure, ["study_id", "sample_id"], "value").drop("value")


@query("win_03_top_deg", "select study_id, contrast_id, method, feature_id, padj, row_number() over (partition by study_id, contrast_id, method order by coalesce(padj, 1), pvalue, feature_id) as place from {deg} qualify place <= 50")
def win_03(t):
    return R.top_deg(t.deg, 50).select("study_id", "contrast_id", "method", "feature_id", "padj", "place")


@query("win_04_top_sets", "select study_id, contrast_id, set_id, nes, row_number() over (partition by study_id, contrast_id order by fdr_q, abs(nes) desc, set_id) as place from {gsea} qualify place <= 20")
def win_04(t):
    return R.first_n(t.gsea, ["study_id", "contrast_id"], 20, "fdr_q", F.desc(F.abs("nes")), "set_id").select("study_id", "contrast_id", "set_id", "nes", "place")


@query("win_05_strongest_per_symbol", f"select study_id, method, gene, feature_id, stat from {{deg}} join ({MAPPING}) on feature_id = transcript where gene <> '' qualify row_number() over (partition by study_id, method, gene order by abs(stat) desc, feature_id) = 1")
def win_05(t):
    return R.strongest(t.deg, mapping(t)).select("study_id", "method", "gene", "feature_id", "stat")


@query("win_06_most_significant_per_symbol", f"select study_id, method, gene, feature_id, padj from {{deg}} join ({MAPPING}) on feature_id = transcript where gene <> '' qualify row_number() over (partition by study_id, method, gene order by padj nulls last, feature_id) = 1")
def win_06(t):
    return R.most_significant(t.deg, mapping(t)).select("study_id", "method", "gene", "feature_id", "padj")


@query("win_07_gene_rows", f"""
with h as (select d.*, gene from {{deg}} d join ({MAPPING}) on feature_id = transcript where gene <> '' and padj < 0.6 qualify row_number() over (partition by study_id, contrast_id, method order by padj, abs(log2fc) desc, feature_id) <= 250),
o as (select * from h qualify row_number() over (partition by study_id, contrast_id, gene order by padj, abs(log2fc) desc, method, feature_id) = 1)
select study_id, contrast_id, gene, method, log2fc, padj, study_id || '_gene' || row_number() over (partition by study_id order by contrast_id, gene) as gene_id from o""")
def win_07(t):
    return R.gene_rows(t.deg, mapping(t), 0.6)


@query("win_08_top_pathway", "select study_id, arg_min(set_id, (fdr_q, set_id)) as top_set from {gsea} group by study_id")
def win_08(t):
    return G.top_set(t.gsea)


@query("win_09_round_robin", """
with r as (select c_mktsegment as source, c_custkey as id, row_number() over (partition by c_mktsegment order by c_acctbal desc, c_custkey) as place from customer where c_mktsegment <> 'MACHINERY' or c_custkey % 40 = 0),
k as (select r.*, coalesce(cap, 0) as cap from r left join (values ('AUTOMOBILE', 60), ('BUILDING', 50), ('MACHINERY', 60), ('HOUSEHOLD', 30)) v(source, cap) using (source)),
u as (select *, (row_number() over (order by place, source))::bigint as i from k where place <= cap), o as (select *, (row_number() over (order by place, source))::bigint as i from k where place > cap),
p as (select source, id, place, false as beyond, i as position from u union all select source, id, place, true, i + (select count(*) from u) from o)
select source, id, place, beyond, position from p where position <= 200""")
def win_09(t):
    """One source is short, one has no share."""
    from assayloom.operators.selection import interleave

    c = t.customer.where("c_mktsegment <> 'MACHINERY' or c_custkey % 40 = 0").select(F.col("c_mktsegment").alias("source"), F.col("c_custkey").alias("id"), "c_acctbal")
    out = interleave(c, [F.desc("c_acctbal"), F.col("id")], 200, {"AUTOMOBILE": 0.3, "BUILDING": 0.25, "MACHINERY": 0.3, "HOUSEHOLD": 0.15})
    return out.select("source", "id", "place", "beyond", "position")


@query("win_12_stratified_subsets", """
with r as (select study_id, condition, run::int as run, sample_id from {sample}, range(1, 4) t(run)),
k as (select *, row_number() over (partition by study_id, condition, run order by md5('42|' || run || '|' || study_id || '|' || sample_id), sample_id) as nth, count(*) over (partition by study_id, condition, run) as n from r)
select study_id, condition, run, sample_id from k where nth <= greatest(2, floor(n * 0.8))""")
def win_12(t):
    return R.stratified_subsets(t.sample)


@query("win_15_list_preview", "select set_id, array_to_string(list_slice(list_sort(list(gene)), 1, 10), ';') || case when count(*) > 10 then ' (+' || (count(*) - 10) || ' more)' else '' end as preview from {gene_set} group by collection, set_id")
def win_15(t):
    from assayloom.operators.selection import preview

    return t.gene_set.groupBy("collection", "set_id").agg(F.array_sort(F.collect_list("gene")).alias("g")).select("set_id", preview(F.col("g"), 10).alias("preview"))


@query("win_16_merge_ranges", """
with r as (select l_orderkey as k, l_partkey as s, l_partkey + (l_quantity * 10)::bigint as e from lineitem),
n as (select *, case when max(e) over (partition by k order by s, e rows between unbounded preceding and 1 preceding) >= s then 0 else 1 end as new from r),
i as (select *, sum(new) over (partition by k order by s, e rows between unbounded preceding and current row) as island from n)
select k, min(s) as "start", max(e) as "end", count(*) as n from i group by k, island""")
def win_16(t):
    r = t.lineitem.select(F.col("l_orderkey").alias("k"), F.col("l_partkey").alias("start"), (F.col("l_partkey") + (F.col("l_quantity") * 10).cast("long")).alias("end"))
    return R.merge_ranges(r, ["k"])


@query("jn_06_feature_gene_map", f"select study_id, method, count(gene) as n_mapped, count(*) - count(gene) as n_unmapped, count(distinct gene) as n_genes from {{deg}} left join (select * from ({MAPPING}) where gene <> '') on feature_id = transcript group by all")
def jn_06(t):
    return R.map_report(t.deg, mapping(t))


@query("jn_09_methods_side_by_side", """
select study_id, contrast_id, feature_id, max(case when method = 'log_cpm' then log2fc end) as log_cpm_log2fc, max(case when method = 'log_cpm' then padj end) as log_cpm_padj,
  max(case when method = 'log_raw' then log2fc end) as log_raw_log2fc, max(case when method = 'log_raw' then padj end) as log_raw_padj from {deg} group by all""")
def jn_09(t):
    return R.side_by_side(t.deg, ["log_cpm", "log_raw"])


@query("st_21_method_concordance", "select study_id, contrast_id, a.method as method_a, b.method as method_b, count(*) as n, round(corr(a.log2fc, b.log2fc), 6) as r from {deg} a join {deg} b using (study_id, contrast_id, feature_id) where a.method < b.method group by all having count(*) >= 10")
def st_21(t):
    return R.concordance_of_methods(t.deg).withColumn("r", r6("r"))


@query("st_01_sample_pearson", "with f as (select * from {measure}) select a.study_id, a.sample_id as sample_a, b.sample_id as sample_b, round(corr(a.value, b.value), 6) as r from f a join f b on a.study_id = b.study_id and a.feature_id = b.feature_id and a.sample_id < b.sample_id group by all")
def st_01(t):
    return S.sample_corr(t.measure).withColumn("r", r6("r"))


@query("st_01b_lowest_pair", "with f as (select * from {measure}), c as (select a.study_id, a.sample_id as sample_a, b.sample_id as sample_b, round(corr(a.value, b.value), 6) as r from f a join f b on a.study_id = b.study_id and a.feature_id = b.feature_id and a.sample_id < b.sample_id group by all) select * from c qualify row_number() over (partition by study_id order by r, sample_a, sample_b) = 1")
def st_01b(t):
    return S.lowest_pair(S.sample_corr(t.measure, lowest=True).withColumn("r", r6("r")))


@query("st_02_sample_spearman", """
with f as (select * from {measure}), k as (select *, rank() over (partition by study_id, sample_id order by value) + (count(*) over (partition by study_id, sample_id, value) - 1) / 2 as x from f)
select a.study_id, a.sample_id as sample_a, b.sample_id as sample_b, round(corr(a.x, b.x), 6) as r from k a join k b on a.study_id = b.study_id and a.feature_id = b.feature_id and a.sample_id < b.sample_id group by all""")
def st_02(t):
    return S.sample_corr(t.measure, "spearman").withColumn("r", r6("r"))


@query("st_03_pca")
def st_03(t):
    return S.pca(M.log_cpm(t.measure), 2, "log_cpm")


TWO_GROUP = """
with y as (select m.study_id, feature_id, condition, log2(value * 1e6 / sum(value) over (partition by m.study_id, m.sample_id) + 1) as y from {measure} m join {sample} s on m.study_id = s.study_id and m.sample_id = s.sample_id),
g as (select study_id, feature_id, avg(y) as base_mean, count(*) - 2 as df, count(case when condition = 'control' then 1 end) as n1, count(case when condition = 'treated' then 1 end) as n2,
  avg(case when condition = 'treated' then y end) - avg(case when condition = 'control' then y end) as log2fc, var_samp(case when condition = 'control' then y end) as v1, var_samp(case when condition = 'treated' then y end) as v2 from y group by all),
f as (select *, ((n1 - 1) * v1 + (n2 - 1) * v2) / df as s2 from g where df > 0)
select study_id, feature_id, round(base_mean, 6) as base_mean, round(log2fc, 6) as log2fc, round(s2, 6) as s2, round(log2fc / sqrt(s2 * (1.0 / n1 + 1.0 / n2)), 6) as t from f"""


@query("st_06a_two_group_ordinary", TWO_GROUP)
def st_06a(t):
    return S.two_group(M.log_cpm(t.measure), t.sample, "control", "treated", "log_cpm").select("study_id", "feature_id", *(r6(c).alias(c) for c in ("base_mean", "log2fc", "s2", "t")))


@query("st_06_moderated_test")
def st_06(t):
    return R.adjusted(S.moderated_two_group(M.log_cpm(t.measure), t.sample, "control", "treated", "log_cpm"))


PAIRED = """
with y as (select m.study_id, feature_id, subject, condition, value from {measure} m join {sample} s on m.study_id = s.study_id and m.sample_id = s.sample_id),
d as (select b.study_id, b.feature_id, b.subject, a.value - b.value as change from y b join y a on a.study_id = b.study_id and a.feature_id = b.feature_id and a.subject = b.subject and b.condition = 'control' and a.condition = 'treated')"""


@query("st_07_paired_block_model", PAIRED + " select study_id, feature_id, 'treated' as contrast_id, round(avg(change), 5) as log2fc, round(avg(change) / sqrt(var_samp(change) / count(*)), 5) as t from d group by all having var_samp(change) > 0")
def st_07(t):
    """With subjects as blocks the treatment effect equals the mean of the paired differences, and its t the paired t."""
    f = S.linear_model(t.measure, t.sample, ["subject", "condition"], {"treated": {"condition=treated": 1.0}})
    return f.where("not isnan(t)").select("study_id", "feature_id", "contrast_id", r6("log2fc", 5).alias("log2fc"), r6("t", 5).alias("t"))


@query("st_08_named_contrasts", """
with y as (select m.study_id, feature_id, batch, value from {measure} m join {sample} s on m.study_id = s.study_id and m.sample_id = s.sample_id),
b as (select study_id, min(batch) as base from {sample} group by study_id)
select y.study_id, feature_id, 'mean_of_base' as contrast_id, round(avg(value), 6) as log2fc from y join b using (study_id) where batch = base group by all
union all select study_id, feature_id, 'EUROPE_vs_ASIA', round(avg(case when batch = 'EUROPE' then value end) - avg(case when batch = 'ASIA' then value end), 6) from y group by all
having count(case when batch = 'EUROPE' then 1 end) > 0 and count(case when batch = 'ASIA' then 1 end) > 0 and min(batch) = 'AFRICA'""")
def st_08(t):
    f = S.linear_model(t.measure, t.sample, ["batch"], {"mean_of_base": {"intercept": 1.0}, "EUROPE_vs_ASIA": {"batch=EUROPE": 1.0, "batch=ASIA": -1.0}})
    return f.select("study_id", "feature_id", "contrast_id", r6("log2fc").alias("log2fc"))


CHANGES = """
select s.study_id, feature_id, subject, sum(case condition when 'treated' then value when 'control' then -value end) as change
from {measure} m join {sample} s on m.study_id = s.study_id and m.sample_id = s.sample_id where condition in ('control', 'treated') group by all having count(distinct condition) = 2"""


@query("st_10_paired_change", CHANGES)
def st_10(t):
    return S.paired_change(t.measure, t.sample, "control", "treated").select("study_id", "feature_id", "subject", "change")


@query("st_10b_change_between_groups", """
with c as (select study_id, subject from {sample} group by all having count(case when condition = 'control' then 1 end) = 1 and count(case when condition = 'treated' then 1 end) = 1),
p as (select a.study_id, a.subject, a.batch as grp, a.sample_id as after_id, b.sample_id as before_id from {sample} a join {sample} b using (study_id, subject) join c using (study_id, subject) where a.condition = 'treated' and b.condition = 'control' and a.batch in ('ASIA', 'EUROPE')),
e as (select study_id from p group by study_id having count(*) >= 4),
d as (select p.study_id, x.feature_id, grp, x.value - y.value as v from p join e using (study_id) join {measure} x on x.study_id = p.study_id and x.sample_id = after_id join {measure} y on y.study_id = p.study_id and y.sample_id = before_id and y.feature_id = x.feature_id),
g as (select study_id, feature_id, count(*) - 2 as df, count(case when grp = 'ASIA' then 1 end) as n1, count(case when grp = 'EUROPE' then 1 end) as n2, avg(case when grp = 'ASIA' then v end) as m1, avg(case when grp = 'EUROPE' then v end) as m2, coalesce(var_samp(case when grp = 'ASIA' then v end), 0) as v1, coalesce(var_samp(case when grp = 'EUROPE' then v end), 0) as v2 from d group by all),
f as (select *, ((n1 - 1) * v1 + (n2 - 1) * v2) / df as s2 from g where n1 > 0 and n2 > 0 and df > 0)
select study_id, feature_id, df::double as df, round(m2 - m1, 6) as log2fc, round(s2, 6) as s2, case when s2 > 0 then round((m2 - m1) / sqrt(s2 * (1.0 / n1 + 1.0 / n2)), 6) end as t from f""")
def st_10b(t):
    out = S.change_between_groups(t.measure, t.sample, "control", "treated", "batch", "ASIA", "EUROPE")
    return out.select("study_id", "feature_id", "df", *(r6(c).alias(c) for c in ("log2fc", "s2", "t")))


@query("st_10c_subject_pairs", """
select *, case when n_baseline = 0 then 'missing_baseline' when n_follow_up = 0 then 'missing_followup' when n_baseline > 1 or n_follow_up > 1 then 'duplicate_samples' end as reason
from (select study_id, subject, count(case when condition = 'control' then 1 end) as n_baseline, count(case when condition = 'treated' then 1 end) as n_follow_up from (select study_id, condition, case when ord % 11 = 0 then 'P1' else subject end as subject from {sample}) group by all)""")
def st_10c(t):
    return S.subject_pairs(t.sample.withColumn("subject", F.when(F.col("ord") % 11 == 0, "P1").otherwise(F.col("subject"))), "control", "treated")


SIZE = """
with p as (select *, ln(value) as l from {measure} qualify min(value) over (partition by study_id, feature_id) > 0),
d as (select *, l - avg(l) over (partition by study_id, feature_id) as d from p)
select study_id, sample_id, exp(quantile_cont(d, 0.5)) as size_factor from d group by all"""
#: Counts of a few big samples, with every part as a feature.
BIG = "select 'B' || (s_nationkey % 2) as study_id, 'F' || l_partkey as feature_id, 'N' || s_nationkey as sample_id, sum(l_quantity)::bigint as value from lineitem join supplier on l_suppkey = s_suppkey group by all"


def big_cells(t):
    names = (F.concat(F.lit("B"), F.col("s_nationkey") % 2).alias("study_id"), F.concat(F.lit("F"), F.col("l_partkey")).alias("feature_id"), F.concat(F.lit("N"), F.col("s_nationkey")).alias("sample_id"))
    return t.lineitem.join(t.supplier, F.col("l_suppkey") == F.col("s_suppkey")).select(*names, "l_quantity")


def big(t):
    # dealt by feature, so that counts are added up and a feature's samples come together in one shuffle
    return big_cells(t).repartition("study_id", "feature_id").groupBy("study_id", "feature_id", "sample_id").agg(F.sum("l_quantity").cast("long").alias("value"))


@query("st_11_size_factors", "select study_id, sample_id, round(size_factor, 6) as size_factor from (" + SIZE.replace("{measure}", f"({BIG})") + ")")
def st_11(t):
    return S.size_factors(big(t)).withColumn("size_factor", r6("size_factor"))


@query("st_12_tmm_factors", f"""
with m as ({BIG}), lib as (select study_id, sample_id, sum(value) as lib from m group by all),
q as (select study_id, sample_id, quantile_cont(value / lib, 0.75) as q from m join lib using (study_id, sample_id) group by all),
ref as (select study_id, sample_id as ref from (select *, abs(q - avg(q) over (partition by study_id)) as off from q) qualify row_number() over (partition by study_id order by off, sample_id) = 1),
r as (select m.study_id, feature_id, value as rv, lib as rl from m join lib using (study_id, sample_id) join ref on m.study_id = ref.study_id and m.sample_id = ref),
p as (select m.study_id, m.sample_id, feature_id, log2((value / lib) / (rv / rl)) as mv, log2((value / lib) * (rv / rl)) / 2 as av, (lib - value) / lib / value + (rl - rv) / rl / rv as v from m join lib using (study_id, sample_id) join r using (study_id, feature_id) where value > 0 and rv > 0),
k as (select *, rank() over (partition by study_id, sample_id order by mv) + (count(*) over (partition by study_id, sample_id, mv) - 1) / 2 as rm, rank() over (partition by study_id, sample_id order by av) + (count(*) over (partition by study_id, sample_id, av) - 1) / 2 as ra, count(*) over (partition by study_id, sample_id) as n from p),
f as (select study_id, sample_id, sum(mv / v) / sum(1 / v) as lf from k where rm between floor(n * 0.3) + 1 and n - floor(n * 0.3) and ra between floor(n * 0.05) + 1 and n - floor(n * 0.05) and v > 0 group by all)
select study_id, sample_id, round(pow(2, coalesce(lf, 0) - avg(coalesce(lf, 0)) over (partition by study_id)), 6) as tmm_factor from lib left join f using (study_id, sample_id)""")
def st_12(t):
    return S.tmm(big(t)).withColumn("tmm_factor", r6("tmm_factor"))


@query("st_13a_moment_dispersion", "with m as (" + BIG + "), f as (" + SIZE.replace("{measure}", f"({BIG})") + """),
q as (select m.study_id, feature_id, value / size_factor as q, size_factor from m join f using (study_id, sample_id)),
s as (select study_id, feature_id, avg(q) as base_mean, var_samp(q) as base_var, avg(1 / size_factor) as xi from q group by all having avg(q) > 0)
select study_id, feature_id, round(base_mean, 6) as base_mean, round(base_var, 5) as base_var, round(greatest(1e-8, (base_var - xi * base_mean) / (base_mean * base_mean)), 6) as dispersion from s""")
def st_13a(t):
    m = big(t)
    return S.dispersions(m, S.size_factors(m)).select("study_id", "feature_id", r6("base_mean").alias("base_mean"), r6("base_var", 5).alias("base_var"), r6("dispersion").alias("dispersion"))


@query("st_04_infer_sex", """
with c as (select study_id, sample_id, feature_id, log2(value * 1e6 / sum(value) over (partition by study_id, sample_id) + 1) as y from {measure}),
s as (select study_id, sample_id, avg(case when feature_id in ('F1', 'F2', 'F3') then y end) - avg(case when feature_id = 'F4' then y end) as gap from c group by all)
select study_id, sample_id, round(gap, 6) as gap, case when gap > 1 then 'male' when gap < -1 then 'female' else 'ambiguous' end as sex, case when abs(gap) > 2 then 'high' when abs(gap) > 1 then 'medium' else 'low' end as confidence from s""")
def st_04(t):
    return S.infer_sex(M.log_cpm(t.measure), ["F1", "F2", "F3"], "F4").withColumn("gap", r6("gap"))


@query("gs_01_significant_list", "select study_id, method, feature_id, log2fc from {deg} where padj < 0.6 and log2fc >= 0.02")
def gs_01(t):
    return G.significant(t.deg, 0.6, 0.02, "up").select("study_id", "method", "feature_id", "log2fc")


ORA = """
with l as (select distinct study_id || ':' || method as list_id, feature_id as gene from {deg} where padj < 0.6), n as (select list_id, count(*) as n from l group by all),
z as (select collection, set_id, count(distinct gene) as m from {gene_set} group by all),
h as (select list_id, collection, set_id, count(*) as k, array_to_string(list_sort(list(gene)), ';') as genes from l join {gene_set} using (gene) group by all),
j as (select * from h join z using (collection, set_id) join n using (list_id)),
p as (select list_id, collection, set_id, k, m, n, genes, least(1.0, list_sum(list_transform(range(k, least(n, m) + 1), lambda i: case when n - i <= 200 - m then
  exp(lgamma(m + 1) - lgamma(i + 1) - lgamma(m - i + 1) + lgamma(200 - m + 1) - lgamma(n - i + 1) - lgamma(200 - m - n + i + 1) - lgamma(201) + lgamma(n + 1) + lgamma(200 - n + 1)) else 0 end))) as p from j),
r as (select *, least(1.0, p * count(*) over (partition by list_id, collection) / row_number() over (partition by list_id, collection order by p)) as raw from p)
select list_id, collection, set_id, k, m, n, genes, round(p, 6) as p, round(min(raw) over (partition by list_id, collection order by p rows between current row and unbounded following), 6) as q from r"""


@query("gs_02_over_representation", ORA)
def gs_02(t):
    lists = G.significant(t.deg, 0.6).select(F.concat_ws(":", "study_id", "method").alias("list_id"), F.col("feature_id").alias("gene"))
    return G.ora(lists, t.gene_set, 200).withColumns({"p": r6("p"), "q": r6("q")})


@query("gs_03_ranking", "select study_id, contrast_id, method, feature_id as gene, stat as score, row_number() over (partition by study_id, contrast_id, method order by stat desc, feature_id) as rank, count(*) over (partition by study_id, contrast_id, method) as n from {deg} where stat is not null qualify n >= 100")
def gs_03(t):
    return G.ranking(t.deg).withColumn("rank", F.col("rank").cast("long"))


ES = """
with r as (select study_id, contrast_id, method, feature_id as gene, stat as score, row_number() over (partition by study_id, contrast_id, method order by stat desc, feature_id) as rank, count(*) over (partition by study_id, contrast_id, method) as n from {deg} where stat is not null),
h as (select r.*, collection, set_id, abs(score) as w, sum(abs(score)) over (partition by study_id, contrast_id, method, collection, set_id order by rank) as cum, row_number() over (partition by study_id, contrast_id, method, collection, set_id order by rank) as j,
  sum(abs(score)) over (partition by study_id, contrast_id, method, collection, set_id) as total, count(*) over (partition by study_id, contrast_id, method, collection, set_id) as size from r join {gene_set} using (gene)),
x as (select *, round(cum / total - (rank - j) / (n - size), 12) as top, round((cum - w) / total - (rank - j) / (n - size), 12) as low from h where size between 15 and 500 and total > 0 and n > size),
s as (select study_id, contrast_id, method, collection, set_id, size, max(top) as top, min(low) as low from x group by all)
select study_id, contrast_id, method, collection, set_id, size, round(case when top >= -low then top else low end, 6) as es from s"""


@query("gs_04_enrichment_score", ES)
def gs_04(t):
    return G.enrichment_score(G.ranking(t.deg), t.gene_set).select("study_id", "contrast_id", "method", "collection", "set_id", "size", r6("es").alias("es"))


@query("gs_05_preranked_gsea")
def gs_05(t):
    return G.gsea(G.ranking(t.deg), t.gene_set)


@query("gs_06_top_terms", """
with s as (select *, case when nes >= 0 then 'up' else 'down' end as side, count(case when fdr_q < 0.6 then 1 end) over (partition by study_id, contrast_id) as n_sig from {gsea})
select study_id, contrast_id, side, row_number() over (partition by study_id, contrast_id, side order by abs(nes) desc, set_id) as place, set_id, nes, fdr_q, n_sig from s qualify place <= 10""")
def gs_06(t):
    return G.top_terms(t.gsea, 10, 0.6)


@query("gs_07_library_overlap", "with l as (select distinct collection, gene from {gene_set}) select study_id, collection, count(*) as n_shared, (select count(*) from l l2 where l2.collection = l.collection) as n_library, round(count(*) / (select count(*) from l l2 where l2.collection = l.collection), 6) as share from (select distinct study_id, feature_id as gene from {deg}) join l using (gene) group by study_id, collection")
def gs_07(t):
    return G.library_overlap(t.deg.withColumnRenamed("feature_id", "gene"), t.gene_set)


@query("gs_08_enrichment_rows", "select study_id, contrast_id, 'path_' || lower(set_id) as pathway_id, nes, fdr_q, case when nes >= 0 then 'up' else 'down' end as direction, study_id || '_enr' || row_number() over (partition by study_id order by contrast_id, fdr_q, lower(set_id)) as enrichment_id from {gsea} where fdr_q < 0.6")
def gs_08(t):
    return G.enrichment_tables(t.gsea, t.gene_set.groupBy("set_id").agg(F.countDistinct("gene").alias("n_members")), 0.6)[1]


@query("gs_08b_pathway_rows", "select 'path_' || lower(set_id) as pathway_id, set_id, (select count(distinct gene) from {gene_set} g where g.set_id = x.set_id) as n_members from (select distinct set_id from {gsea} where fdr_q < 0.6) x")
def gs_08b(t):
    return G.enrichment_tables(t.gsea, t.gene_set.groupBy("set_id").agg(F.countDistinct("gene").alias("n_members")), 0.6)[0]


@query("gs_09_mechanism_chain", """
with e as (select study_id, contrast_id, set_id, nes, fdr_q from {gsea} where fdr_q < 0.8), f as (select distinct study_id, entity as gene from {finding} where entity_type in ('gene', 'protein') and entity not like '% %'),
h as (select study_id, contrast_id, set_id, count(distinct gene) as n, array_to_string(list_sort(list(distinct gene)), ';') as reported_genes from e join {gene_set} using (set_id) join f using (study_id, gene) group by all)
select e.*, coalesce(n, 0) as n_reported, reported_genes, case when coalesce(n, 0) > 0 then 'genes_reported' else 'data_only' end as support from e left join h using (study_id, contrast_id, set_id)""")
def gs_09(t):
    f = t.finding.where("entity_type in ('gene', 'protein') and entity not like '% %'").withColumnRenamed("entity", "symbol")
    return G.mechanism_chain(t.gsea, t.gene_set, f, 0.8)


@query("gs_11_pathway_consistency", "select 'path_' || lower(set_id) as pathway_id, count(distinct case when nes >= 0 then study_id end) as up, count(distinct case when nes < 0 then study_id end) as down from {gsea} where fdr_q < 0.6 group by 1")
def gs_11(t):
    return G.pathway_consistency(G.enrichment_tables(t.gsea, t.gene_set.groupBy("set_id").agg(F.countDistinct("gene").alias("n_members")), 0.6)[1])
