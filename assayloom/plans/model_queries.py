"""Queries on count models and composed tests."""

from __future__ import annotations

from pyspark.sql import functions as F

from assayloom.functions.columns import r6
from assayloom.operators import counts as N
from assayloom.operators import matrix as M
from assayloom.operators import results as R
from assayloom.operators import rollup as U
from assayloom.operators import stats as S
from assayloom.plans.registry import query
from assayloom.plans.result_queries import big, big_cells

TREATED = "condition=treated"


def big_samples(t):
    return big_cells(t).select("study_id", "sample_id").distinct().withColumn("condition", F.when(F.substring("sample_id", 2, 9).cast("int") % 4 < 2, "control").otherwise("treated"))


@query("st_13_negative_binomial_wald")
def st_13(t):
    return N.nb_wald(big(t), big_samples(t), ["condition"], TREATED)


@query("st_15_independent_filtering", """
with d as (select study_id, contrast_id, method, feature_id, base_mean, pvalue from {deg}), r as (select *, percent_rank() over (partition by study_id, contrast_id, method order by base_mean) as q from d),
z as (select r.*, cut from r, range(0, 20) t(cut) where q >= cut / 20 * 0.95),
w as (select *, least(1.0, pvalue * count(pvalue) over (partition by study_id, contrast_id, method, cut) / row_number() over (partition by study_id, contrast_id, method, cut order by pvalue nulls last, feature_id)) as raw from z),
a as (select *, min(raw) over (partition by study_id, contrast_id, method, cut order by pvalue nulls last, feature_id rows between current row and unbounded following) as padj from w),
n as (select study_id, contrast_id, method, cut, count(case when padj < 0.5 then 1 end) as n from a group by all),
c as (select * from n qualify row_number() over (partition by study_id, contrast_id, method order by n desc, cut) = 1)
select d.*, round(k.padj, 6) as padj from d left join (select a.* from a join c using (study_id, contrast_id, method, cut)) k using (study_id, contrast_id, method, feature_id)""")
def st_15(t):
    d = N.independent_filter(t.deg.select("study_id", "contrast_id", "method", "feature_id", "base_mean", "pvalue"), 0.5)
    return d.withColumn("padj", r6("padj"))


@query("st_16_quasi_likelihood")
def st_16(t):
    return R.adjusted(N.ql_test(big(t), big_samples(t), ["condition"], TREATED))


@query("st_17_precision_weights")
def st_17(t):
    return R.adjusted(N.voom_test(big(t), big_samples(t), ["condition"], TREATED))


@query("st_18_methylation_test", """
with v as (select 'EMB' as study_id, vec_id, label, unnest(embedding)::double as value, generate_subscripts(embedding, 1) - 1 as pos from embeddings),
b as (select vec_id, label, pos, least(greatest((value + 1) / 2, 0.001), 0.999) as b from v where label in (0, 1)), m as (select pos, label, log2((b + 0.001) / (1 - b + 0.001)) as m from b),
k as (select pos from m group by pos having stddev_samp(m) > 0.02),
g as (select pos, count(case when label = 0 then 1 end) as n1, count(case when label = 1 then 1 end) as n2, avg(case when label = 0 then m end) as m1, avg(case when label = 1 then m end) as m2, var_samp(case when label = 0 then m end) as v1, var_samp(case when label = 1 then m end) as v2 from m semi join k using (pos) group by pos)
select 'D' || pos as feature_id, round(m2 - m1, 6) as log2fc, round((m2 - m1) / sqrt(((n1 - 1) * v1 + (n2 - 1) * v2) / (n1 + n2 - 2) * (1.0 / n1 + 1.0 / n2)), 6) as t from g""")
def st_18(t):
    v = t.embeddings.where("label in (0, 1)").select(F.lit("EMB").alias("study_id"), F.concat(F.lit("V"), "vec_id").alias("sample_id"), F.col("label").cast("string").alias("condition"), F.posexplode("embedding").alias("pos", "value"))
    m = v.select("study_id", F.concat(F.lit("D"), "pos").alias("feature_id"), "sample_id", ((F.col("value").cast("double") + 1) / 2).alias("value"))
    out = S.two_group(M.drop_invariant(M.beta_to_m(m)), v.select("study_id", "sample_id", "condition").distinct(), "0", "1")
    return out.select("feature_id", r6("log2fc").alias("log2fc"), r6("t").alias("t"))


@query("st_19_proteomics_test")
def st_19(t):
    p = U.peptide_to_protein(t.peptide, min_peptides=2).select(F.lit("PR").alias("study_id"), F.col("protein").alias("feature_id"), "sample_id", F.col("value").cast("double").alias("value"))
    s = p.select("study_id", "sample_id").distinct().withColumn("condition", F.when(F.substring("sample_id", 2, 9).cast("int") % 2 == 0, "control").otherwise("treated"))
    return R.adjusted(S.moderated_two_group(M.centre(M.log_if_linear(M.drop_missing(p))), s, "control", "treated"))


@query("st_20_celltype_test")
def st_20(t):
    pb = U.pseudobulk(t.cell_count, t.cell_meta).select(F.col("celltype").alias("study_id"), F.col("gene").alias("feature_id"), F.col("pb_id").alias("sample_id"), "value", "condition")
    s = pb.select("study_id", "sample_id", "condition").distinct()
    return R.adjusted(S.moderated_two_group(M.log_cpm(pb.drop("condition")), s, "F", "O", "log_cpm"))


@query("st_22_subset_stability")
def st_22(t):
    # a row a sample with its runs, so that values meet their arms and runs at once, by the key that they are shuffled by
    drawn = R.stratified_subsets(t.sample).groupBy("study_id", "sample_id", "condition").agg(F.collect_list("run").alias("runs"))
    m = M.log_cpm(t.measure).join(drawn, ["study_id", "sample_id"]).withColumn("run", F.explode("runs"))
    return R.adjusted(S.moderated_two_group(m.withColumn("study_id", F.concat_ws(":", "study_id", "run")), None, "control", "treated", "log_cpm"))


JOINT = "select m.study_id, feature_id, batch, condition, value from {measure} m join {sample} s on m.study_id = s.study_id and m.sample_id = s.sample_id where batch in ('ASIA', 'EUROPE')"


@query("st_09_joint_cell_means", f"with y as ({JOINT}), c as (select study_id, feature_id, batch || '_' || condition as cell, avg(value) as m from y group by all), p as (select study_id, feature_id, max(case when cell = 'ASIA_treated' then m end) as a1, max(case when cell = 'ASIA_control' then m end) as a0, max(case when cell = 'EUROPE_treated' then m end) as e1, max(case when cell = 'EUROPE_control' then m end) as e0 from c group by all) select study_id, feature_id, 'interaction' as contrast_id, round((e1 - e0) - (a1 - a0), 6) as log2fc from p where a0 is not null and a1 is not null and e0 is not null and e1 is not null")
def st_09(t):
    """One fit of all cells; the interaction is a vector over them, with the first cell as the intercept."""
    s = t.sample.where("batch in ('ASIA', 'EUROPE')").withColumn("cell", F.concat_ws("_", "batch", "condition"))
    parts = {"cell=EUROPE_treated": 1.0, "cell=EUROPE_control": -1.0, "cell=ASIA_treated": -1.0}
    m = t.measure.join(s.select("study_id", "sample_id"), ["study_id", "sample_id"], "left_semi")
    return S.linear_model(m, s, ["cell"], {"interaction": parts}).select("study_id", "feature_id", "contrast_id", r6("log2fc").alias("log2fc"))
