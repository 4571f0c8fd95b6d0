"""Queries on data needs, labelling, screening and nested extractions."""

from __future__ import annotations

from pyspark.sql import functions as F

from assayloom.operators import audits as A
from assayloom.operators import catalogue as C
from assayloom.operators import designs as D
from assayloom.operators import matrix as M
from assayloom.plans.registry import query
from assayloom.plans.study_queries import SCORES


@query("typ_04_value_sniff", "with s as (select l_returnflag as file, avg(case when abs(v - round(v)) <= 0.01 then 1.0 else 0 end) as whole, min(v) as low, bool_or(l_returnflag = 'A') as est from (select l_returnflag, case when l_returnflag = 'N' then l_quantity else l_extendedprice end as v from lineitem) group by 1), k as (select *, case when whole >= 0.99 and low >= 0 then 'raw_counts' when whole >= 0.5 then 'mostly_integer' else 'decimal' end as kind from s) select file, round(whole, 6) as whole, kind, case when kind = 'raw_counts' then 'as_expected' when est then 'estimated' else 'unexplained' end as verdict from k")
def typ_04(t):
    v = t.lineitem.select(F.col("l_returnflag").alias("file"), F.when(F.col("l_returnflag") == "N", F.col("l_quantity")).otherwise(F.col("l_extendedprice")).alias("value"))
    return M.sniff(v, F.col("file") == "A")


@query("typ_10_required_data", "select p_partkey, case p_partkey % 4 when 0 then 'raw counts;sample sheet' when 1 then 'beta matrix;probe annotation' when 2 then 'matrix;barcodes;features' end as files from part")
def typ_10(t):
    kinds = F.element_at(F.array(*map(F.lit, ("Raw count matrix", "DNA methylation array", "single-cell RNA counts", "images"))), (F.col("p_partkey") % 4 + 1).cast("int"))
    return t.part.select("p_partkey", M.required_data(kinds).alias("files"))


#: Methods, modifications and texts of projects, from the words of the parts.
PROJECTS = """
select p_partkey, case when p_size % 5 = 0 then 'TMT 10plex' when p_size % 5 = 1 then 'Label-free quantification' when p_size % 5 = 2 then p_brand end as methods, case when p_partkey % 6 = 0 then 'iTRAQ4plex; Oxidation' when p_partkey % 6 = 1 then 'Label:13C(6); Phospho' when p_partkey % 6 < 4 then 'Oxidation' end as ptms,
  p_name || case when p_size % 9 = 0 then ' by dimethyl labelling' when p_size % 9 = 1 then ' with DIA' else '' end as said from part"""


def projects(t):
    k, n = F.col("p_partkey") % 6, F.col("p_size")
    methods = F.when(n % 5 == 0, "TMT 10plex").when(n % 5 == 1, "Label-free quantification").when(n % 5 == 2, F.col("p_brand"))
    ptms = F.when(k == 0, "iTRAQ4plex; Oxidation").when(k == 1, "Label:13C(6); Phospho").when(k < 4, "Oxidation")
    return t.part.select("p_partkey", methods.alias("methods"), ptms.alias("ptms"), F.concat("p_name", F.when(n % 9 == 0, " by dimethyl labelling").when(n % 9 == 1, " with DIA").otherwise("")).alias("said"))


def labelling_sql() -> str:
    named = lambda c: "case " + " ".join(f"when regexp_matches({c}, '{p}') then '{n}'" for n, p in M.REAGENTS) + " end"
    kind = lambda c: f"case when {named(c)} is not null then 'labelled' when regexp_matches({c}, '(?i)label[- ]free|\\blfq\\b|\\bdia\\b') then 'label_free' end"
    texts = ("methods", "ptms", "said")
    return f"select p_partkey, coalesce({', '.join(kind(c) for c in texts)}, 'unknown') as labelling, coalesce({', '.join(named(c) for c in texts)}) as reagent from ({PROJECTS})"


@query("typ_12_labelling", labelling_sql())
def typ_12(t):
    texts = [F.col(c) for c in ("methods", "ptms", "said")]
    return projects(t).select("p_partkey", M.labelling(*texts).alias("labelling"), M.reagent(*texts).alias("reagent"))


@query("ds_13_multifactor_plan", "select study_id, count(*) as n, '' as dropped, count(distinct condition) + count(distinct batch) - 1 as rank, count(distinct condition) + count(distinct batch) - 1 as n_columns, count(*) - (count(distinct condition) + count(distinct batch) - 1) as residual_df, true as valid from {sample} group by study_id")
def ds_13(t):
    return D.multifactor_plan(t.sample, ["condition", "batch"])


@query("ds_18_series_screen", "with d as (select o_custkey as paper_id, case when o_orderstatus not in ('F', 'O') then 0 when o_totalprice <= 50000 then 1 when o_orderpriority not like '1%' then 2 else 3 end as depth from orders), p as (select paper_id, count(*) as n_series, count(case when depth = 3 then 1 end) as n_analyzable, max(depth) as depth from d group by paper_id) select paper_id, n_series, n_analyzable, ['species', 'size', 'raw_data', 'analyzable'][depth + 1] as reason from p")
def ds_18(t):
    layers = [("species", F.col("o_orderstatus").isin("F", "O")), ("size", F.col("o_totalprice") > 50000), ("raw_data", F.col("o_orderpriority").startswith("1"))]
    return D.series_screen(t.orders.withColumnRenamed("o_custkey", "paper_id"), layers)


@query("ds_19_header_groups", SCORES + ", d as (select study_id, attr from c where score >= 1 qualify row_number() over (partition by study_id order by score desc, levels desc, ord, attr) = 1), z as (select study_id, attr, value, count(*) as n from {sample_attr} join d using (study_id, attr) group by all), x as (select study_id, array_to_string(list_sort(list(distinct s)), ';') as sexes from (select study_id, case when lower(value) in ('f', 'female') then 'female' when lower(value) in ('m', 'male') then 'male' end as s from {sample_attr} where attr = 'sex') where s is not null group by study_id) select z.study_id, attr, min(n) as smallest, count(*) as n_groups, coalesce(any_value(sexes), '') as sexes from z left join x using (study_id) group by z.study_id, attr")
def ds_19(t):
    return D.header_groups(t.sample_attr)


@query("ev_17_provider_stability", "with r as (select l_returnflag as provider, l_suppkey as key, max(l_linestatus) || max(l_linenumber) as value from lineitem group by all) select a.provider as provider_a, b.provider as provider_b, count(*) as n_common, count(case when a.value = b.value then 1 end) as n_same, round(count(case when a.value = b.value then 1 end) / count(*), 6) as agreement from r a join r b using (key) where a.provider < b.provider group by all")
def ev_17(t):
    r = t.lineitem.groupBy(F.col("l_returnflag").alias("provider"), F.col("l_suppkey").alias("key")).agg(F.concat(F.max("l_linestatus"), F.max("l_linenumber")).alias("value"))
    return A.provider_stability(r)


@query("cat_03_flattened_subjects", """
with g as (select 'N' || s_nationkey as study_id, lower(s_nationkey % 2 || s_suppkey % 3) as key from supplier group by all), i as (select study_id, key, study_id || '_grp' || row_number() over (partition by study_id order by key) as group_id from g),
s as (select 'N' || c_nationkey as study_id, lower(c_name) as who, c_name as name, c_nationkey % 2 || c_custkey % 4 as key from customer)
select s.study_id, s.study_id || '_sub' || row_number() over (partition by s.study_id order by who) as subject_id, name, coalesce(group_id, '0') as group_id from s left join i on i.study_id = s.study_id and i.key = s.key where s.study_id in (select study_id from g)""")
def cat_03(t):
    g = t.supplier.groupBy(F.concat(F.lit("N"), "s_nationkey").alias("study_id")).agg(F.collect_list(F.struct(F.concat(F.lit(" "), F.col("s_nationkey") % 2, F.col("s_suppkey") % 3).alias("label"), F.lit(1).alias("n"))).alias("groups"))
    s = t.customer.groupBy(F.concat(F.lit("N"), "c_nationkey").alias("study_id")).agg(F.collect_list(F.struct(F.col("c_name").alias("name"), F.concat(F.col("c_nationkey") % 2, F.col("c_custkey") % 4).alias("group"))).alias("subjects"))
    return C.flatten_extraction(g.join(s, "study_id"))[2]


@query("cat_05_exercise_rows", "select 'O' || o_custkey as study_id, 'O' || o_custkey || '_ex' || row_number() over (partition by o_custkey order by o_orderkey) as exercise_id, o_orderpriority as material, o_orderkey || ' min' as parameters from orders where o_orderpriority like '1-%' or o_orderstatus = 'P'")
def cat_05(t):
    kind = F.when(F.col("o_orderstatus") == "P", "treadmill running").otherwise("diet")
    i = t.orders.select(F.concat(F.lit("O"), "o_custkey").alias("study_id"), F.col("o_orderkey").alias("ord"), F.col("o_orderpriority").alias("material"), kind.alias("kind"), F.col("o_orderkey").alias("dose"), F.lit("min").alias("unit"))
    return C.exercise_rows(i, "^1-|running|swim|training")
