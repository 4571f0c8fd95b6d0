"""Queries on measures: typing, gates, transforms, roll-ups."""

from __future__ import annotations

from pyspark.sql import functions as F

from assayloom.functions.columns import r6, sex_label, subject_and_time, value_and_unit
from assayloom.operators import matrix as M
from assayloom.operators import rollup as R
from assayloom.plans.registry import query

PROFILE = """
select study_id, count(distinct feature_id) as n_features, count(distinct sample_id) as n_samples, count(value) as n_values, count(*) - count(value) as n_missing,
  min(value)::double as min_value, max(value)::double as max_value, quantile_cont(value::double, 0.5) as median,
  avg(case when abs(value - round(value)) <= 1e-8 then 1.0 when value is not null then 0.0 end) as integer_fraction, count(case when value < 0 then 1 end) as n_negative
from {m} group by study_id"""
GAPS = PROFILE.replace("{m}", "{measure_gaps}")
#: All vectors as one study with a feature for each component.
VECTORS = "select 'EMB' as study_id, vec_id, unnest(embedding)::double as value, generate_subscripts(embedding, 1) - 1 as pos from embeddings"


def vectors(t):
    return t.embeddings.select(F.lit("EMB").alias("study_id"), F.concat(F.lit("V"), F.col("vec_id")).alias("sample_id"), F.posexplode("embedding").alias("pos", "value")).select(
        "study_id", F.concat(F.lit("D"), F.col("pos")).alias("feature_id"), "sample_id", F.col("value").cast("double").alias("value")
    )


@query("typ_01_matrix_profile", GAPS)
def typ_01(t):
    return M.profile(t.measure_gaps)


@query("typ_02_type_candidates", "select study_id, 'raw_counts' || case when max_value <= 1 then ';proportion' else '' end || case when max_value <= 50 then ';log_scale' else '' end as candidates from (" + PROFILE.replace("{m}", "{measure}") + ") where min_value >= 0 and integer_fraction >= 0.99 union all select 'EMB', 'signed_log_scale'")
def typ_02(t):
    return M.type_candidates(M.profile(t.measure).unionByName(M.profile(vectors(t))))


@query("typ_03_heuristic_type", f"""
with v as (select study_id, value::double as value from {{measure}} union all select study_id, value from ({VECTORS})),
s as (select study_id, min(value) as low, max(value) as high, max(case when abs(value - round(value)) > 1e-8 then 1 else 0 end) = 1 as has_decimals from v where value <> 0 group by study_id)
select *, case when low < 0 then 'log' when not has_decimals and high > 100 then 'raw_counts' when has_decimals and high < 30 then 'log' else 'fpkm_tpm' end as kind from s""")
def typ_03(t):
    return M.classify(t.measure.withColumn("value", F.col("value").cast("double")).unionByName(vectors(t)))


@query("typ_06_beta_detector", """
with v as (select 'disc' as study_id, l_discount as value from lineitem union all select 'qty', l_quantity from lineitem union all select 'price', l_extendedprice from lineitem),
s as (select study_id, min(value) as low, max(value) as high from v group by study_id)
select study_id, low >= 0 and high <= 1 as is_beta, low >= 0 and high > 1 and high <= 100 as is_percent from s""")
def typ_06(t):
    pick = lambda name, col: t.lineitem.select(F.lit(name).alias("study_id"), F.col(col).alias("value"))
    return M.looks_like_beta(pick("disc", "l_discount").union(pick("qty", "l_quantity")).union(pick("price", "l_extendedprice")))


@query("typ_07_method_gate", f"""
with p as ({PROFILE.replace("{m}", "{measure}")} union all select 'GAP' || study_id, * exclude (study_id) from ({GAPS})),
r as (
  select study_id, m.method, case when m.method = 'limma' then case when integer_fraction >= 0.99 and max_value > 100 then 'raw counts' when max_value > 50 then 'linear scale' end
    else case when n_values <> n_features * n_samples then 'incomplete' when min_value < 0 then 'negative values' when integer_fraction < 0.99 then 'not integer counts' end end as reason
  from p, (values ('deseq2'), ('edger'), ('limma-voom'), ('limma')) m(method))
select study_id, method, reason is null as allowed, coalesce(reason, '') as reason from r""")
def typ_07(t):
    gaps = M.profile(t.measure_gaps).withColumn("study_id", F.concat(F.lit("GAP"), F.col("study_id")))
    return M.method_gate(M.profile(t.measure).unionByName(gaps))


ID_CASE = "case " + " ".join(f"when regexp_matches(feature_id, '{p}') then '{n}'" for n, p in M.ID_PATTERNS) + " else 'other' end"
IDS = """
select 'symbols' as study_id, 'F' || p_partkey as feature_id from part union all select 'entrez', p_partkey::varchar from part
union all select 'ensembl', 'ENSG' || lpad(p_partkey::varchar, 11, '0') from part union all select 'mixed', case when p_partkey % 3 = 0 then 'cg' || p_partkey when p_partkey % 3 = 1 then 'ILMN_' || p_partkey else p_name end from part"""


@query("typ_09_feature_id_type", f"""
with n as (select study_id, {ID_CASE} as kind, count(*) as n from ({IDS}) group by all),
s as (select study_id, sum(n) as n_ids, max(struct_pack(n := n, kind := kind)) as top from n group by study_id)
select study_id, n_ids::bigint as n_ids, top.kind as dominant, round(top.n / n_ids, 4) as fraction, top.kind in ('gene_symbol', 'ensembl_gene') and round(top.n / n_ids, 4) >= 0.8 as gene_set_ready from s""")
def typ_09(t):
    k = F.col("p_partkey").cast("string")
    named = lambda study, feature: F.struct(F.lit(study).alias("study_id"), feature.alias("feature_id"))
    rows = F.array(
        named("symbols", F.concat(F.lit("F"), k)),
        named("entrez", k),
        named("ensembl", F.concat(F.lit("ENSG"), F.lpad(k, 11, "0"))),
        named("mixed", F.when(F.col("p_partkey") % 3 == 0, F.concat(F.lit("cg"), k)).when(F.col("p_partkey") % 3 == 1, F.concat(F.lit("ILMN_"), k)).otherwise(F.col("p_name"))),
    )
    return M.feature_id_type(t.part.select(F.inline(rows)))


def kept(condition: str, view: str = "{measure}") -> str:
    return f"select m.* from {view} m semi join (select study_id, feature_id from {view} group by all having {condition}) k using (study_id, feature_id)"


@query("prj_01_low_expression_filter", kept("count(case when value >= 30 then 1 end) >= 5"))
def prj_01(t):
    return M.filter_low(t.measure, 30, 5)


@query("prj_02_log_cpm", "select study_id, feature_id, sample_id, value, round(value * 1e6 / sum(value) over w, 6) as cpm, round(log2(value * 1e6 / sum(value) over w + 1), 6) as log_cpm from {measure} window w as (partition by study_id, sample_id)")
def prj_02(t):
    return M.log_cpm(t.measure).withColumns({"cpm": r6("cpm"), "log_cpm": r6("log_cpm")})


@query("prj_03_log2_plus", "select study_id, feature_id, sample_id, round(log2(value + 1), 6) as value from {measure} where study_id in (select study_id from {measure} group by study_id having min(value) >= 0 and max(value) > 50)")
def prj_03(t):
    return M.log2p(t.measure).withColumn("value", r6("value"))


DISCOUNTS = "select l_returnflag as study_id, l_orderkey::varchar || '_' || l_linenumber as feature_id, l_linestatus as sample_id, {v} as value from lineitem"


@query("prj_04_beta_to_m", f"""
with v as ({DISCOUNTS.format(v="case when l_returnflag = 'A' then l_discount * 100 else l_discount end")}),
b as (select * exclude value, least(greatest(case when max(value) over (partition by study_id) > 1.5 then value / 100 else value end, 0.001), 0.999) as b from v)
select study_id, feature_id, sample_id, round(log2((b + 0.001) / (1 - b + 0.001)), 6) as value from b""")
def prj_04(t):
    d = F.when(F.col("l_returnflag") == "A", F.col("l_discount") * 100).otherwise(F.col("l_discount"))
    v = t.lineitem.select(F.col("l_returnflag").alias("study_id"), F.concat_ws("_", "l_orderkey", "l_linenumber").alias("feature_id"), F.col("l_linestatus").alias("sample_id"), d.alias("value"))
    return M.beta_to_m(v).withColumn("value", r6("value"))


@query("prj_05_invariant_filter", kept("stddev_samp(value) > 60"))
def prj_05(t):
    return M.drop_invariant(t.measure, 60)


@query("prj_06_round_counts", "select study_id, feature_id, sample_id, round_even(value * 1.25, 0)::bigint as value from {measure}")
def prj_06(t):
    return M.round_counts(t.measure.withColumn("value", F.col("value") * F.lit(1.25)))


@query("prj_07_usable_features", kept("count(value) >= greatest(3, count(*) / 2) and var_samp(value) > 0", "{measure_gaps}"))
def prj_07(t):
    return M.usable(t.measure_gaps)


@query("prj_08_drop_zero", kept("max(abs(value)) > 0"))
def prj_08(t):
    return M.drop_zero(t.measure)


@query("prj_09_median_centring", "select study_id, feature_id, sample_id, round(value - quantile_cont(value, 0.5) over (partition by study_id, sample_id), 6) as value from {measure_gaps}")
def prj_09(t):
    return M.centre(t.measure_gaps).withColumn("value", r6("value"))


@query("prj_10_missingness_filter", kept("avg(case when value is null then 1.0 else 0 end) <= 0.25", "{measure_gaps}"))
def prj_10(t):
    return M.drop_missing(t.measure_gaps, 0.25)


@query("prj_11_low_tail_imputation", "select study_id, sample_id, count(*) as n, count(*) - count(value) as n_imputed, round(sum(value), 6) as observed_sum from {measure_gaps} group by all")
def prj_11(t):
    return M.minprob(t.measure_gaps).groupBy("study_id", "sample_id").agg(F.count("value").alias("n"), F.count_if("imputed").alias("n_imputed"), F.round(F.sum(F.when(~F.col("imputed"), F.col("value"))), 6).alias("observed_sum"))


@query("prj_12_log_if_linear", "select study_id, feature_id, sample_id, round(case when max(value) over (partition by study_id) >= 50 then log2(greatest(value, 0) + 1) else value end, 6) as value from {measure_gaps} where value is not null")
def prj_12(t):
    return M.log_if_linear(t.measure_gaps.where("value is not null")).withColumn("value", r6("value"))


@query("prj_14_subject_and_time", """
with n as (select sample_id, case when ord % 4 = 0 then 'q' || (1 + ord % 3) || '_' || subject when ord % 4 = 1 then subject else condition || '_rep_' || ord end as name from {sample})
select sample_id, name, case when regexp_matches(name, '^(q[12])_(.+)$') then regexp_extract(name, '^(q[12])_(.+)$', 2) when contains(name, '_') then regexp_extract(name, '^(.*)_([^_]*)$', 1) end as subject, case when regexp_matches(name, '^(q[12])_(.+)$') then regexp_extract(name, '^(q[12])_(.+)$', 1) when contains(name, '_') then regexp_extract(name, '^(.*)_([^_]*)$', 2) end as time from n""")
def prj_14(t):
    o = F.col("ord")
    name = F.when(o % 4 == 0, F.concat(F.lit("q"), 1 + o % 3, F.lit("_"), "subject")).when(o % 4 == 1, F.col("subject")).otherwise(F.concat("condition", F.lit("_rep_"), o))
    subject, time = subject_and_time(F.col("name"))
    return t.sample.select("sample_id", name.alias("name")).select("sample_id", "name", subject.alias("subject"), time.alias("time"))


ARMS = r"(select study_id, arm, count(*) as n from (select study_id, trim(regexp_replace(trim(value), '(?i)[\s_-]*(?:rep(?:licate)?[\s_-]*)?\d+$', ''), ' _-') as arm from {sample_attr} where attr = 'title') group by all)"


@query("prj_15_replicate_suffix", f"select * from {ARMS}")
def prj_15(t):
    return R.arms(t.sample_attr)


@query("prj_15b_arm_balance", f"select study_id, count(*) as n_arms, min(n) as least, max(n) as most, count(*) >= 2 and min(n) >= 2 and max(n) <= 2 * min(n) as balanced from {ARMS} group by study_id")
def prj_15b(t):
    return R.arm_balance(R.arms(t.sample_attr))


@query("prj_16_value_and_unit", r"""
select study_id, sample_id, case when value = 'n/a' then null else split_part(value, ' ', 1) end as number, case when value = 'n/a' then null else split_part(value, ' ', 2) end as unit from {sample_attr} where attr = 'age'""")
def prj_16(t):
    number, unit = value_and_unit(F.col("value"))
    return t.sample_attr.where("attr = 'age'").select("study_id", "sample_id", number.alias("number"), unit.alias("unit"))


@query("prj_17_sex_labels", "select study_id, case when lower(value) in ('f', 'female') then 'female' when lower(value) in ('m', 'male') then 'male' end as sex, count(*) as n from {sample_attr} where attr = 'sex' group by all")
def prj_17(t):
    return t.sample_attr.where("attr = 'sex'").groupBy("study_id", sex_label(F.col("value")).alias("sex")).agg(F.count(F.lit(1)).alias("n"))


@query("agg_01_sample_qc", """
with s as (select study_id, sample_id, sum(value)::bigint as library_size, count(case when value >= 1 then 1 end) as detected, quantile_cont(value, 0.5) as median, max(value) as max, round(100.0 * count(case when value >= 1 then 1 end) / count(*), 6) as pct_detected from {measure} group by all)
select *, library_size < 0.5 * quantile_cont(library_size, 0.5) over (partition by study_id) as low_library from s""")
def agg_01(t):
    return R.sample_qc(t.measure).withColumn("pct_detected", r6("pct_detected"))


PB = "select celltype, sample_id, condition, count(*) as n_cells from {cell_meta} group by all"


@query("agg_02_pseudobulk", f"""
with g as (select *, max(condition) over w <> min(condition) over w as several from ({PB}) window w as (partition by sample_id))
select celltype, sample_id, condition, gene, sum(value)::bigint as value, n_cells, case when several then sample_id || '__' || condition else sample_id end as pb_id
from {{cell_count}} join {{cell_meta}} using (cell_id) join g using (celltype, sample_id, condition) where n_cells >= 10 group by all""")
def agg_02(t):
    return R.pseudobulk(t.cell_count, t.cell_meta)


@query("agg_03_pseudobulk_eligibility", f"""
with g as (select * from ({PB}) where n_cells >= 10), a as (select celltype, condition, count(*) as p from g group by all),
d as (select celltype, count(case when c >= 2 then 1 end) as complete_donors from (select celltype, sample_id, count(distinct condition) as c from g group by all) group by all)
select celltype, count(*) as n_arms, min(p) as least_profiles, any_value(complete_donors) as complete_donors, count(*) >= 2 and min(p) >= 2 as eligible from a join d using (celltype) group by celltype""")
def agg_03(t):
    return R.eligible(t.cell_meta)


MAPPING = "select distinct concat('F', cast(p_partkey % 200 as varchar)) as transcript, case when p_partkey % 200 % 9 = 0 then '' else concat('G', cast(p_partkey % 200 % 40 as varchar)) end as gene from part"


def mapping(t):
    k = F.col("p_partkey") % 200
    return t.part.select(F.concat(F.lit("F"), k).alias("transcript"), F.when(k % 9 == 0, "").otherwise(F.concat(F.lit("G"), k % 40)).alias("gene")).distinct()


@query("agg_04_transcript_to_gene", f"select study_id, gene, sample_id, sum(value)::bigint as value from {{measure}} join ({MAPPING}) on feature_id = transcript where gene <> '' group by all")
def agg_04(t):
    return R.tx_to_gene(t.measure, mapping(t))


PROTEIN = """
with ids as (select peptide, sample_id, value, list_distinct(list_filter(string_split(protein_ids, ';'), lambda x: x <> '' and not regexp_matches(x, '^(DECOY_|REV_|CON__|CONTAM_)'))) as ids from {{peptide}}),
flat as (select peptide, sample_id, value, unnest(ids) as protein from ids {where}),
n as (select protein, count(distinct peptide) as n_peptides from flat group by all having count(distinct peptide) >= 2)"""


@query("agg_05_peptide_to_protein", PROTEIN.format(where="where len(ids) = 1") + "select protein, sample_id, sum(value)::bigint as value, n_peptides from flat join n using (protein) group by all")
def agg_05(t):
    return R.peptide_to_protein(t.peptide, min_peptides=2)


@query("agg_05b_peptide_top_three", PROTEIN.format(where="") + """
select protein, sample_id, round(avg(value), 6) as value, n_peptides from (select *, row_number() over (partition by protein, sample_id order by value desc, peptide) as pos from flat) join n using (protein) where pos <= 3 group by all""")
def agg_05b(t):
    return R.peptide_to_protein(t.peptide, how="top", shared="explode", min_peptides=2).withColumn("value", r6("value"))


@query("agg_06_max_mean_collapse", """
with m as (select study_id, 'G' || (substr(feature_id, 2)::int % 40) as feature_id, feature_id as row_id, avg(value) as mean from {measure} group by 1, 2, 3)
select study_id, feature_id, row_id, round(mean, 6) as mean from m qualify row_number() over (partition by study_id, feature_id order by mean desc, row_id) = 1""")
def agg_06(t):
    rows = t.measure.select("study_id", F.concat(F.lit("G"), F.substring("feature_id", 2, 9).cast("int") % 40).alias("feature_id"), F.col("feature_id").alias("row_id"), "value")
    return R.max_mean(rows).withColumn("mean", r6("mean"))


@query("agg_07_collapse_to_gene", f"""
select study_id, method, gene, feature_id, stat from (
  select d.*, gene, row_number() over (partition by study_id, method, gene order by abs(stat) desc, feature_id) as pos from {{deg}} d join ({MAPPING}) on feature_id = transcript where gene <> '') where pos = 1""")
def agg_07(t):
    from assayloom.operators.results import collapse_genes

    return collapse_genes(t.deg, mapping(t)).select("study_id", "method", "gene", "feature_id", "stat")


@query("agg_08_threshold_summary", "select study_id, contrast_id, method, count(padj) as n_tested, count(case when padj < 0.3 and abs(log2fc) >= 0.05 then 1 end) as n_sig, count(case when padj < 0.3 and log2fc >= 0.05 then 1 end) as n_up, count(case when padj < 0.3 and log2fc <= -0.05 then 1 end) as n_down from {deg} group by all")
def agg_08(t):
    return R.apply_threshold(t.deg, limit=0.3, effect=0.05)


@query("agg_10_method_consensus", """
with h as (select study_id, contrast_id, feature_id, count(case when padj < 0.5 then 1 end) as hits, count(distinct method) as methods from {deg} group by all)
select study_id, contrast_id, max(methods) as n_methods, count(case when hits >= 1 then 1 end) as any, count(case when hits >= 2 then 1 end) as two_or_more, count(case when hits = methods then 1 end) as "all" from h group by all""")
def agg_10(t):
    return R.consensus(t.deg, 0.5)


@query("agg_11_level_counts", "select study_id, attr, value, count(*) as n from {sample_attr} group by all")
def agg_11(t):
    return R.level_counts(t.sample_attr)


@query("agg_12_attribute_shape", "select study_id, attr, count(distinct value) as levels, count(value) as n, case when count(distinct value) <= 1 then 'constant' when count(distinct value) = count(value) then 'identifier' when count(distinct value) <= 12 then 'grouping' else 'other' end as shape from {sample_attr} group by study_id, attr")
def agg_12(t):
    return R.attribute_shape(t.sample_attr)


@query("agg_13_even_values", """
with d as (select distinct study_id, attr, value from {sample_attr}), r as (select *, row_number() over (partition by study_id, attr order by value) - 1 as pos, count(*) over (partition by study_id, attr) as n from d)
select study_id, attr, value from r where n <= 6 or pos = 0 or (pos * 5) // greatest(n - 1, 1) <> ((pos - 1) * 5) // greatest(n - 1, 1)""")
def agg_13(t):
    return R.even_values(t.sample_attr)


@query("agg_14_study_summary", "select study_id, count(distinct method) as n_methods, count(*) as n_rows, count(case when padj < 0.5 then 1 end) as n_sig, bool_or(padj < 0.1) as any_strong, array_to_string(list_sort(list(distinct method)), ';') as methods from {deg} group by study_id")
def agg_14(t):
    from assayloom.operators.results import study_summary

    return study_summary(t.deg, 0.5, 0.1)


@query("agg_15_stage_ledger", "select coalesce(stage, 'TOTAL') as stage, round(sum(wall_s), 2) as wall_s, sum(n_calls)::bigint as calls, sum(in_tok)::bigint as in_tok, sum(out_tok)::bigint as out_tok, round((sum(in_tok) * 0.25 + sum(out_tok) * 2.0) / 1e6, 4) as usd from {usage} group by rollup(stage)")
def agg_15(t):
    return R.stage_ledger(t.usage).withColumn("calls", F.col("calls").cast("long"))


@query("agg_16_usage_shares", "select run_id, stage, sum(in_tok + out_tok)::bigint as tokens, round(sum(in_tok + out_tok) / sum(sum(in_tok + out_tok)) over (partition by run_id), 6) as share from {usage} group by run_id, stage")
def agg_16(t):
    return R.usage_shares(t.usage)


@query("agg_22_wilson_interval", """
with s as (select stage, count(*) as n, count(case when execution_status = 'completed' then 1 end) as passed from {decision} group by stage),
w as (select *, passed / n as p, 1.96 as z from s)
select stage, n, passed, round(greatest(0, (p + z * z / (2 * n) - z * sqrt(p * (1 - p) / n + z * z / (4.0 * n * n))) / (1 + z * z / n)), 6) as low, round(least(1, (p + z * z / (2 * n) + z * sqrt(p * (1 - p) / n + z * z / (4.0 * n * n))) / (1 + z * z / n)), 6) as high from w""")
def agg_22(t):
    return R.pass_rates(t.decision, "stage", F.col("execution_status") == "completed")


@query("agg_23_study_context", "select study_id, attr, arg_min(value, sample_id) as first_value from {sample_attr} where lower(trim(value)) not in ('', 'nan', 'none', 'na', 'n/a', 'null', 'missing', 'not applicable', 'unknown', '--') group by all")
def agg_23(t):
    return R.first_values(t.sample_attr)


@query("agg_24_descriptor", "select study_id, attr, array_to_string(list_sort(list(distinct value)), '; ') as descriptor from {sample_attr} where value is not null group by all")
def agg_24(t):
    return R.descriptor(t.sample_attr)


@query("agg_27_grouping_columns", "select study_id, attr, count(distinct value) as n_levels, array_to_string(list_sort(list(distinct value)), ';') as levels from {sample_attr} group by study_id, attr having count(distinct value) between 2 and 10")
def agg_27(t):
    return R.grouping_columns(t.sample_attr)
