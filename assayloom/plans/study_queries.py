"""Queries on alignment, sets and study design."""

from __future__ import annotations

from pyspark.sql import functions as F

from assayloom.operators import designs as D
from assayloom.operators import joins as J
from assayloom.operators import lattice as L
from assayloom.operators import sets as S
from assayloom.plans.matrix_queries import mapping
from assayloom.plans.registry import query
from assayloom.plans.result_queries import R

#: Matrix columns named as samples, one in nine renamed.
COLUMNS = "select distinct study_id, case when ord % 9 = 4 then 'X' || sample_id else sample_id end as sample_id from {sample}"


def columns(t):
    return t.sample.select("study_id", F.when(F.col("ord") % 9 == 4, F.concat(F.lit("X"), "sample_id")).otherwise(F.col("sample_id")).alias("sample_id")).distinct()


@query("jn_01_exact_alignment", f"""
with c as ({COLUMNS}), j as (select coalesce(c.study_id, s.study_id) as study_id, c.sample_id as a, s.sample_id as b from c full join {{sample}} s on c.study_id = s.study_id and c.sample_id = s.sample_id)
select study_id, count(case when a is not null and b is not null then 1 end) as n_matched, count(case when b is null then 1 end) as n_matrix_only, count(case when a is null then 1 end) as n_meta_only,
  round(count(case when a is not null and b is not null then 1 end) / count(a), 6) as coverage from j group by study_id""")
def jn_01(t):
    return J.align(columns(t), t.sample.select("study_id", F.col("sample_id").alias("key")), "key")


@query("jn_02_alignment_keys", f"""
with c as ({COLUMNS}), a as (select study_id, attr, value from {{sample_attr}} union select study_id, 'name', sample_id from {{sample}} union select study_id, 'renamed', 'X' || sample_id from {{sample}}),
n as (select study_id, count(*) as n_columns from c group by study_id)
select a.study_id, attr, count(*) as n_matched, any_value(n_columns) as n_columns, round(count(*) / any_value(n_columns), 6) as share from a join c on a.study_id = c.study_id and a.value = c.sample_id join n on n.study_id = a.study_id group by all""")
def jn_02(t):
    names = t.sample.select("study_id", F.lit("name").alias("attr"), F.col("sample_id").alias("value"))
    renamed = t.sample.select("study_id", F.lit("renamed"), F.concat(F.lit("X"), "sample_id"))
    return J.alignment_keys(columns(t), t.sample_attr.select("study_id", "attr", "value").union(names).union(renamed))


@query("jn_03_contained_keys", f"""
with c as ({COLUMNS}), a as (select study_id, sample_id as row_id, 'title' as attr, unnest(list_distinct(regexp_split_to_array(lower('sample ' || sample_id || ' of ' || subject), '[^a-z0-9]+'))) as token from {{sample}})
select a.study_id, attr, row_id, min(c.sample_id) as matrix_column from a join c on a.study_id = c.study_id and a.token = lower(c.sample_id) group by all having count(distinct c.sample_id) = 1""")
def jn_03(t):
    title = F.concat_ws(" ", F.lit("sample"), "sample_id", F.lit("of"), "subject")
    return J.contained_keys(columns(t), t.sample.select("study_id", "sample_id", F.lit("title").alias("attr"), title.alias("value")))


@query("jn_05_restricted_metadata", f"""
with c as ({COLUMNS}), j as (select s.study_id, c.sample_id as there from (select distinct study_id, sample_id from {{sample_attr}}) s left join c on c.study_id = s.study_id and c.sample_id = s.sample_id)
select study_id, count(there) as n_kept, count(*) as n_meta, case when count(there) = 0 then 'no_overlap' when count(there) < count(*) then 'subset' else 'complete' end as verdict from j group by study_id""")
def jn_05(t):
    return J.restrict(t.sample_attr, columns(t))


@query("jn_08_marker_lookup", "select distinct study_id, s.symbol, feature_id from {measure} join (values ('f1'), ('F20'), ('f199'), ('zz')) s(symbol) on lower(feature_id) = lower(s.symbol)")
def jn_08(t):
    return J.marker_rows(t.measure, ["f1", "F20", "f199", "zz"])


CANDIDATES = "(entity_type in ('gene', 'protein') and entity not like '% %')"
BEST = f"""
f as (select *, {CANDIDATES} as checkable from {{finding}}),
h as (select finding_id, f.study_id, d.feature_id as our_symbol, d.log2fc, d.padj, contrast_id, method from f join {{deg}} d on f.study_id = d.study_id and f.entity = d.feature_id where checkable
  qualify row_number() over (partition by f.study_id, finding_id order by coalesce(padj, 1), contrast_id, method) = 1)"""


@query("jn_12_findings_with_results", f"with {BEST} select f.study_id, f.finding_id, our_symbol, contrast_id, method, log2fc, padj from f left join h using (study_id, finding_id)")
def jn_12(t):
    return J.match_findings(t.finding, t.deg).select("study_id", "finding_id", "our_symbol", "contrast_id", "method", "log2fc", "padj")


@query("ev_10_agreement_verdicts", f"""
with {BEST}, j as (select f.*, our_symbol, log2fc, padj, coalesce(padj < 0.6, false) as sig, case when log2fc > 0 then 'up' else 'down' end as ours from f left join h using (study_id, finding_id))
select study_id, finding_id, entity, direction, our_symbol, log2fc, padj, case when not checkable then 'not_checkable' when our_symbol is null then 'not_in_results'
  when direction in ('up', 'down') then case when sig and ours = direction then 'confirmed' when sig then 'contradicted' when ours = direction then 'direction_only' else 'not_detected' end
  when direction = 'unchanged' then case when sig then 'contradicted' else 'confirmed' end else case when sig then 'confirmed_change' else 'not_detected' end end as verdict from j""")
def ev_10(t):
    return J.agreement(t.finding, t.deg, 0.6)


@query("jn_10_enrichment_chain", """
with z as (select set_id, count(distinct gene) as n_members from {gene_set} group by set_id), a as (select study_id, condition, count(*) as n from {sample} group by all)
select g.study_id, contrast_id, set_id, nes, fdr_q, n_members, c.n as n_control, x.n as n_treated from {gsea} g join z using (set_id) join a c on c.study_id = g.study_id and c.condition = 'control' join a x on x.study_id = g.study_id and x.condition = 'treated' where fdr_q < 0.8""")
def jn_10(t):
    z = t.gene_set.groupBy("set_id").agg(F.countDistinct("gene").alias("n_members"))
    return J.chain(t.gsea, z, t.sample.groupBy("study_id", "condition").agg(F.count(F.lit(1)).alias("n")), 0.8).select("study_id", "contrast_id", "set_id", "nes", "fdr_q", "n_members", "n_control", "n_treated")


@query("jn_14_uncovered_claims", "select study_id, entity, finding_id from {finding} f where entity_type in ('gene', 'protein') and not exists (select 1 from {deg} d where d.study_id = f.study_id and d.feature_id = f.entity and padj < 0.6)")
def jn_14(t):
    return J.uncovered(t.finding, t.deg, 0.6).select("study_id", "entity", "finding_id")


@query("jn_15_last_write_wins", "select user_id, event_type, arg_max(value, event_id) as value from events group by all")
def jn_15(t):
    return J.latest(t.events, ["user_id", "event_type"], "event_id", "value")


@query("jn_13_best_phenotype", """
with g as (select study_id, contrast_id, feature_id as gene_id from {deg} where method = 'log_cpm' and padj < 0.6), p as (select study_id, finding_id, entity as phenotype, comparison from {finding} where entity_type = 'phenotype')
select study_id, gene_id, phenotype, finding_id from g left join p using (study_id) qualify row_number() over (partition by study_id, gene_id order by coalesce(comparison = contrast_id, false) desc, finding_id) = 1""")
def jn_13(t):
    g = t.deg.where("method = 'log_cpm' and padj < 0.6").select("study_id", "contrast_id", F.col("feature_id").alias("gene_id"))
    return J.best_phenotype(g, t.finding)


OVERLAP = """
with d as (select distinct {o} as o, {i} as i from {v} {w}), n as (select o, count(*) as n from d group by o)
select a.o as {o}_a, b.o as {o}_b, count(*) as shared, any_value(na.n) as n_a, any_value(nb.n) as n_b, round(count(*) / (any_value(na.n) + any_value(nb.n) - count(*)), 6) as jaccard
from d a join d b on a.i = b.i and a.o < b.o join n na on na.o = a.o join n nb on nb.o = b.o group by a.o, b.o"""


@query("set_01_jaccard", OVERLAP.replace("{o}", "set_id").replace("{i}", "gene").replace("{v}", "{gene_set}").replace("{w}", "where collection = 'type'"))
def set_01(t):
    return S.pairwise_overlap(t.gene_set.where("collection = 'type'"), "set_id", "gene")


@query("set_02_pairwise_overlap", OVERLAP.replace("{o}", "run_id").replace("{i}", "feature_id").replace("{v}", "{run_deg}").replace("{w}", "where padj < 0.5"))
def set_02(t):
    return S.pairwise_overlap(t.run_deg.where("padj < 0.5"), "run_id", "feature_id")


@query("set_03_multi_key_dedupe", """
with recursive r as (select c_custkey as id, case when c_custkey % 3 = 0 then null else 'd' || (c_custkey * 7 % 400) end as doi, case when c_custkey % 5 < 2 then 'p' || (c_custkey * 11 % 350) end as pmid,
  case when c_custkey % 3 = 1 then null else 'On  the ' || (c_custkey * 13 % 300) || case when c_custkey % 2 = 0 then ', part.' else '. PART' end end as title, case when c_custkey % 4 = 0 then null else c_name end as note from customer),
n as (select *, nullif(left(regexp_replace(lower(title), '[^\\p{L}\\p{N}_]+', '', 'g'), 80), '') as tkey, row_number() over (order by id) as i from r),
k as (select *, list_filter(['doi:' || doi, 'pmid:' || pmid, 'title:' || tkey], lambda x: x is not null) as keys from n),
s as (select 0::bigint as i, map([]::varchar[], []::bigint[]) as kept, null::bigint as id, null::bigint as root
  union all select i, case when owner is null then map_concat(kept, map(keys, list_transform(keys, lambda x: id))) else kept end, id, coalesce(owner, id)
  from (select k.i, s.kept, k.id, k.keys, list_filter(list_transform(k.keys, lambda x: s.kept[x]), lambda x: x is not null)[1] as owner from s join k on k.i = s.i + 1)),
g as (select s.root, n.* from s join n using (id))
select root as id, arg_min(doi, id) filter (doi is not null) as doi, arg_min(pmid, id) filter (pmid is not null) as pmid, arg_min(tkey, id) filter (tkey is not null) as title, arg_min(note, id) filter (note is not null) as note, count(*) as n_merged from g group by root""")
def set_03(t):
    k = F.col("c_custkey")
    title = F.concat(F.lit("On  the "), k * 13 % 300, F.when(k % 2 == 0, ", part.").otherwise(". PART"))
    r = t.customer.select(
        k.alias("id"), F.when(k % 3 != 0, F.concat(F.lit("d"), k * 7 % 400)).alias("doi"), F.when(k % 5 < 2, F.concat(F.lit("p"), k * 11 % 350)).alias("pmid"), F.when(k % 3 != 1, S.title_key(title)).alias("title"), F.when(k % 4 != 0, F.col("c_name")).alias("note")
    )
    return S.dedupe_multi_key(r, ["doi", "pmid", "title"], ["note"], "id")


@query("set_04_cross_batch_union", """
with c as (select n_nationkey as series from nation join region on n_regionkey = r_regionkey where r_name = 'AFRICA'),
b as (select c_nationkey as series, c_custkey as id from customer union all select s_nationkey, s_suppkey from supplier)
select series, min(id) as first_id, count(*) as n from b where series not in (select series from c) group by series""")
def set_04(t):
    """Customers and suppliers are two batches; the nations of one region were counted before."""
    counted = t.nation.join(t.region.where("r_name = 'AFRICA'"), F.col("n_regionkey") == F.col("r_regionkey")).select(F.col("n_nationkey").alias("series"))
    batches = [t.customer.select(F.col("c_nationkey").alias("series"), F.col("c_custkey").alias("id")), t.supplier.select(F.col("s_nationkey").alias("series"), F.col("s_suppkey").alias("id"))]
    return S.union_minus(batches, counted, "series", "id")


@query("set_05_shared_claims", "with c as (select distinct l_suppkey as owner, l_partkey as resource from lineitem), n as (select resource, count(*) as n_owners from c group by resource) select owner, resource, n_owners, case when n_owners > 1 then 'shared' else 'own' end as verdict from c join n using (resource)")
def set_05(t):
    return S.shared_claims(t.lineitem.select(F.col("l_suppkey").alias("owner"), F.col("l_partkey").alias("resource")).distinct())


@query("set_06_set_stability", "with n as (select l_suppkey as key, l_partkey as item, count(distinct l_returnflag) as r from lineitem group by all) select key, count(case when r = 3 then 1 end) as n_all, count(*) as n_any, count(case when r = 1 then 1 end) as n_single from n group by key")
def set_06(t):
    return S.set_stability(t.lineitem.select(F.col("l_suppkey").alias("key"), F.col("l_partkey").alias("item"), F.col("l_returnflag").alias("run_id")), 3)


TOKENS = "select distinct key, text, unnest(list_filter(regexp_split_to_array(lower(text), '[^a-z0-9]+'), lambda x: x <> '')) as token from ({})"
GOT = "select conv_id as key, text from conversations where role = 'assistant'"
GOLD = "select conv_id as key, text from conversations where role = 'user'"


@query("set_07_token_recall", f"""
with g as ({TOKENS.format(GOLD)}), c as ({TOKENS.format(GOT)}), n as (select key, text, count(*) as n from g group by all),
h as (select g.key, g.text, c.text as got, count(*) as k from g join c on g.key = c.key and g.token = c.token group by all), b as (select key, text, max(k) as k from h group by all)
select key, text as gold, round(coalesce(k, 0) / n, 6) as share, round(coalesce(k, 0) / n, 6) >= 0.3 as found from n left join b using (key, text)""")
def set_07(t):
    turns = lambda role: t.conversations.where(F.col("role") == role).select(F.col("conv_id").alias("key"), "text")
    return S.token_recall(turns("assistant"), turns("user"), 0.3)


@query("set_08_rouge_l")
def set_08(t):
    return S.rouge_stability(t.conversations, "conv_id", "turn", "text")


STABILITY = """
r as (select *, row_number() over (partition by run_id order by coalesce(padj, 1), abs(log2fc) desc, feature_id) <= 50 as top, padj < 0.05 as sig from {run_deg}), n as (select run_id, count(case when top then 1 end) as nt, count(case when sig then 1 end) as ns from r group by run_id),
p as (select a.run_id as run_id_a, b.run_id as run_id_b, count(*) as n_common, round(corr(a.log2fc, b.log2fc), 6) as pearson, round(avg(case when a.log2fc <> 0 and b.log2fc <> 0 then case when sign(a.log2fc) = sign(b.log2fc) then 1.0 else 0 end end), 6) as direction,
  count(case when a.top and b.top then 1 end) as t, count(case when a.sig and b.sig then 1 end) as s from r a join r b on a.feature_id = b.feature_id and a.run_id < b.run_id group by all),
x as (select run_id_a, run_id_b, n_common, pearson, direction, round(t / (na.nt + nb.nt - t), 6) as top_jaccard, case when na.ns + nb.ns = 0 then 1.0 else round(s / (na.ns + nb.ns - s), 6) end as sig_jaccard from p join n na on na.run_id = run_id_a join n nb on nb.run_id = run_id_b)"""


@query("ev_01_run_stability", f"with {STABILITY} select * from x")
def ev_01(t):
    return S.run_stability(t.run_deg)


@query("ev_03_stability_verdict", f"""
with {STABILITY}, s as (select count(*) as n_pairs, round((avg(pearson) + avg(direction) + avg(top_jaccard) + avg(sig_jaccard)) / 4, 6) as score from x)
select *, case when score >= 0.8 then 'stable' when score >= 0.55 then 'moderate' else 'unstable' end as verdict from s""")
def ev_03(t):
    return S.stability_verdict(S.run_stability(t.run_deg))


@query("ev_05_concordance", """
with j as (select a.log2fc as x, a.padj as p, b.log2fc as y, b.padj as q from {run_deg} a join {run_deg} b using (feature_id) where a.run_id = 'runA' and b.run_id = 'runN'),
k as (select *, rank() over (order by x) + (count(*) over (partition by x) - 1) / 2 as rx, rank() over (order by y) + (count(*) over (partition by y) - 1) / 2 as ry from j)
select count(*) as n, round(corr(x, y), 6) as pearson, round(corr(rx, ry), 6) as spearman, round(avg(case when x <> 0 and y <> 0 then case when sign(x) = sign(y) then 1.0 else 0 end end), 6) as sign_agreement, count(case when q < 0.3 then 1 end) as n_reference, count(case when p < 0.3 then 1 end) as n_own,
  round(count(case when q < 0.3 and p < 0.3 then 1 end) / count(case when q < 0.3 or p < 0.3 then 1 end), 6) as jaccard, round(count(case when q < 0.3 and p < 0.3 and sign(x) = sign(y) then 1 end) / count(case when q < 0.3 then 1 end), 6) as recovery, case when count(case when q < 0.3 then 1 end) > 2 then round(corr(x, y) filter (q < 0.3), 6) end as pearson_found from k""")
def ev_05(t):
    run = lambda r: t.run_deg.where(F.col("run_id") == r)
    return S.concordance(run("runA"), run("runN"), 0.3)


@query("ev_11_output_identity", """
with r as (select l_returnflag, sha256(array_to_string(list_transform([l_orderkey::varchar, l_linenumber::varchar, l_partkey::varchar], lambda x: coalesce(strlen(x) || ':' || x, '~')), '|')) as d from lineitem),
s as (select l_returnflag, count(*) as n, sum(('0x' || substring(d, 1, 16))::ubigint::hugeint) as a, sum(('0x' || substring(d, 17, 16))::ubigint::hugeint) as b, sum(('0x' || substring(d, 33, 16))::ubigint::hugeint) as c, sum(('0x' || substring(d, 49, 16))::ubigint::hugeint) as e from r group by all)
select l_returnflag, n, sha256(a || ',' || b || ',' || c || ',' || e) as digest from s""")
def ev_11(t):
    return S.output_hash(t.lineitem, "l_returnflag", ["l_orderkey", "l_linenumber", "l_partkey"])


@query("ev_12_row_count_stability", "select case when l_linenumber <= 3 then 'head' else 'tail' end as tbl, count(case when l_returnflag = 'A' then 1 end) as a, count(case when l_returnflag = 'N' then 1 end) as n, count(case when l_returnflag = 'R' then 1 end) as r from lineitem group by 1")
def ev_12(t):
    return S.row_counts(t.lineitem.withColumn("tbl", F.when(F.col("l_linenumber") <= 3, "head").otherwise("tail")), "tbl", "l_returnflag", ["A", "N", "R"])


@query("ev_13_field_stability", """
with r as (select l_returnflag as run_id, l_suppkey as key, max(l_linestatus) as status, max(case when l_returnflag = 'A' then 'Yes' else 'yes' end) as flag, max(l_linenumber)::varchar as line from lineitem group by all),
f as (select run_id, key, 'status' as field, status as value from r union all select run_id, key, 'flag', flag from r union all select run_id, key, 'line', line from r),
k as (select field, key, count(distinct value) as v, count(distinct lower(value)) as f from f group by all having count(distinct run_id) = 3)
select field, count(*) as n, count(case when v = 1 then 1 end) as same, count(case when v > 1 and f = 1 then 1 end) as case_only from k group by field""")
def ev_13(t):
    r = t.lineitem.groupBy(F.col("l_returnflag").alias("run_id"), F.col("l_suppkey").alias("key")).agg(F.max("l_linestatus").alias("status"), F.max(F.when(F.col("l_returnflag") == "A", "Yes").otherwise("yes")).alias("flag"), F.max("l_linenumber").cast("string").alias("line"))
    return S.field_stability(r, 3, ["status", "flag", "line"])


SCORES = "with n as (select study_id, count(distinct sample_id) as n from {sample_attr} group by all), v as (select study_id, attr, value, count(*) as size, min(ord) as ord from {sample_attr} where trim(value) <> '' group by all), s as (select study_id, attr, count(*) as levels, min(size) as least, max(size) as most, min(ord) as ord from v group by all), c as (select *, 1 + case when regexp_matches(attr, '" + "|".join(D.DESIGN) + "') then 2 else 0 end - case when regexp_matches(attr, '" + "|".join(D.DESCRIPTOR) + "') and not regexp_matches(attr, '" + "|".join(D.DESIGN) + "') then 1 else 0 end + case when least >= 2 and most / least <= 4 then 1 else 0 end - case when regexp_matches(attr, '" + "|".join(D.USUAL) + "') then 0 else 2 end as score from s join n using (study_id) where levels >= 2 and levels < n and levels <= greatest(2, floor(n * 0.8)))"


@query("ds_01_design_column", SCORES + " select study_id, attr, score, levels from c where score >= 1 qualify row_number() over (partition by study_id order by score desc, levels desc, ord, attr) = 1")
def ds_01(t):
    return D.pick_design(t.sample_attr)


@query("ds_04_two_arm_validation", f"""
with c as ({COLUMNS}), j as (select s.study_id, condition, c.sample_id as there from {{sample}} s left join c on c.study_id = s.study_id and c.sample_id = s.sample_id),
k as (select study_id, count(case when condition = 'control' then 1 end) as n_control, count(case when condition = 'treated' then 1 end) as n_treated, count(case when condition = 'control' then there end) as aligned_control, count(case when condition = 'treated' then there end) as aligned_treated from j group by study_id),
r as (select *, case when least(aligned_control, aligned_treated) < 2 then 'too few replicates' when aligned_control < 0.95 * n_control or aligned_treated < 0.95 * n_treated then 'arm not aligned' else '' end as reason from k) select *, reason = '' as valid from r""")
def ds_04(t):
    return D.two_arm(t.sample.select("study_id", "sample_id", "condition"), columns(t), "control", "treated", share=0.95)


@query("ds_05_grouping_check", """
with f as (select study_id, count(*) as n, count(case when lower(trim(value)) in ('', 'nan', 'none', 'na', 'n/a', 'null', 'missing', 'not applicable', 'unknown', '--') then 1 end) as n_blank, count(distinct case when lower(trim(value)) not in ('', 'nan', 'none', 'na', 'n/a', 'null', 'missing', 'not applicable', 'unknown', '--') then value end) as levels from {sample_attr} where attr = 'age' group by study_id),
j as (select study_id, n, coalesce(n_blank, 0) as n_blank, coalesce(levels, 0) as levels from (select distinct study_id from {sample_attr}) left join f using (study_id))
select study_id, n_blank, levels, case when n is null or n_blank > 0 or levels < 2 then 'fail' else 'pass' end as status, case when n is null then 'not in metadata' when n_blank > 0 then 'blank values' when levels < 2 then 'one level only' else '' end as problem from j""")
def ds_05(t):
    return D.check_grouping(t.sample_attr, "age")


@query("ds_06_level_order", r"""
with v as (select distinct study_id, value from {sample_attr} where attr in ('age') and value <> 'n/a' union select distinct study_id, value from {sample_attr} where attr = 'condition'),
n as (select study_id, value, try_cast(nullif(regexp_extract(value, '(\d+(?:\.\d+)?)', 1), '') as double) as number, regexp_matches(lower(value), 'control|baseline|sham|vehicle|untreated|sedentary|pre$') as is_control from v)
select *, row_number() over (partition by study_id order by is_control desc, number nulls last, value) as place from n""")
def ds_06(t):
    return D.level_order(t.sample_attr, "age").union(D.level_order(t.sample_attr, "condition"))


#: Four factors at most: the arm, the batch without a reference, a time with more than six levels, and a stratum.
DESIGNED = "select study_id, condition, batch, (ord * 7 % 8) || 'h' as hour, case when ord % 3 = 0 then 'f' else 'm' end as sex from {sample}"


def designed(t):
    o = F.col("ord")
    return t.sample.select("study_id", "condition", "batch", F.concat(o * 7 % 8, F.lit("h")).alias("hour"), F.when(o % 3 == 0, "f").otherwise("m").alias("sex"))


def lattice_sql() -> str:
    """Common tables down to ``c``, the comparisons of DESIGNED in strata of sex."""
    factors = ("condition", "batch", "hour")
    out = [f"s as ({DESIGNED})", "cells as (select study_id, sex, condition, batch, hour, count(*) as n from s group by all)"]
    for f in factors:
        out.append(f"v{f} as (select study_id, sex, {f} as level, count(*) over w as k, count(*) over w = count(distinct try_cast(nullif(regexp_extract({f}, '-?[0-9]+([.][0-9]+)?'), '') as double)) over w as timed, try_cast(nullif(regexp_extract({f}, '-?[0-9]+([.][0-9]+)?'), '') as double) as num, regexp_matches(trim({f}), '{L.REFERENCE}') as reads from (select distinct study_id, sex, {f} from s) window w as (partition by study_id, sex))")
        out.append(f"o{f} as (select study_id, sex, level, k, timed, row_number() over (partition by study_id, sex order by case when timed then num end nulls last, level) as place, case when sum(reads::int) over w = 1 then max(case when reads then level end) over w end as named from v{f} window w as (partition by study_id, sex))")
        out.append(f"l{f} as (select *, coalesce(named, case when timed then max(case when place = 1 then level end) over (partition by study_id, sex) end) as ref, lag(level) over (partition by study_id, sex order by place) as prior from o{f})")
        out.append(f"""p{f} as (select a.study_id, a.sex, case when b.level is not distinct from a.ref then a.level else b.level end as test, case when b.level is not distinct from a.ref then b.level else a.level end as reference from l{f} a join l{f} b using (study_id, sex) where a.place < b.place and a.k <= 6
union all select study_id, sex, level, ref from l{f} where k > 6 and level <> ref union all select study_id, sex, level, prior from l{f} where k > 6 and timed and prior <> ref)""")
    name = lambda f, where: f"trim(regexp_replace('{f}_' || test || '_vs_' || reference || {where}, '[^A-Za-z0-9._-]+', '_', 'g'), '_')"
    every = []
    for f in factors:
        g, h = (x for x in factors if x != f)
        cell = lambda k, level, f=f, g=g, h=h: f"left join cells {k} on {k}.study_id = p.study_id and {k}.sex = p.sex and {k}.{f} = {level} and {k}.{g} = x.level and {k}.{h} = y.level"
        every.append(f"select study_id, 'simple' as kind, '{f}' as factor, test, reference, within[2:] as within, {name(f, 'within')} as name, n1 || ',' || n2 as sizes, least(n1, n2) as least_cell from (select p.study_id, test, reference, '_sex-' || p.sex || '_{g}-' || x.level || '_{h}-' || y.level as within, coalesce(a.n, 0) as n1, coalesce(b.n, 0) as n2 from p{f} p join l{g} x on x.study_id = p.study_id and x.sex = p.sex join l{h} y on y.study_id = p.study_id and y.sex = p.sex {cell('a', 'test')} {cell('b', 'reference')})")
    for f, g, h in (("condition", "batch", "hour"), ("condition", "hour", "batch"), ("batch", "hour", "condition")):
        cell = lambda k, u, v, f=f, g=g, h=h: f"left join cells {k} on {k}.study_id = p.study_id and {k}.sex = p.sex and {k}.{f} = {u} and {k}.{g} = {v} and {k}.{h} = y.level"
        every.append(f"select study_id, 'interaction', '{f}:{g}', test, reference, within[2:], {name(f'{f}:{g}', 'within')}, concat_ws(',', a, b, c, d), least(a, b, c, d) from (select p.study_id, p.level || ':' || q.level as test, p.named || ':' || q.named as reference, '_sex-' || p.sex || '_{h}-' || y.level as within, coalesce(ca.n, 0) as a, coalesce(cb.n, 0) as b, coalesce(cc.n, 0) as c, coalesce(cd.n, 0) as d from l{f} p join l{g} q using (study_id, sex) join l{h} y using (study_id, sex) {cell('ca', 'p.level', 'q.level')} {cell('cb', 'p.named', 'q.level')} {cell('cc', 'p.level', 'q.named')} {cell('cd', 'p.named', 'q.named')} where p.level <> p.named and q.level <> q.named)")
    out.append("c as (select *, least_cell >= 3 as analyzable from (" + " union all ".join(every) + "))")
    return ", ".join(out)


@query("ds_07_comparisons", f"with {lattice_sql()} select * from c where kind = 'simple'")
def ds_07(t):
    return L.lattice(designed(t), ["condition", "batch", "hour"], ["sex"]).where("kind = 'simple'")


@query("ds_07b_interactions", f"with {lattice_sql()} select * from c where kind = 'interaction'")
def ds_07b(t):
    return L.lattice(designed(t), ["condition", "batch", "hour"], ["sex"]).where("kind = 'interaction'")


@query("ds_08_planned_sizes", "with s as (select study_id, condition, count(*) as n from {sample} group by all), p as (select study_id, unnest(['Control', 'treated ', 'placebo']) as planned from (select distinct study_id from {sample})) select p.study_id, planned, coalesce(n, 0) as n, case when n is null then 'unknown' when n >= 3 then 'enough' else 'too_small' end as verdict from p left join s on s.study_id = p.study_id and s.condition = lower(trim(p.planned))")
def ds_08(t):
    planned = t.sample.select("study_id").distinct().select("study_id", F.explode(F.array(*map(F.lit, ("Control", "treated ", "placebo")))).alias("planned"))
    return D.planned_sizes(t.sample, planned)


CONFOUND = """
p as (select study_id, sample_id, value as p from {sample_attr} where attr = 'condition'), j as (select a.study_id, attr, value, p from {sample_attr} a join p using (study_id, sample_id) where attr <> 'condition'),
b as (select study_id, attr, count(distinct value) as levels, count(*) as n from j group by all), v as (select study_id, attr, max(c) as mp from (select study_id, attr, value, count(distinct p) as c from j group by all) group by all), q as (select study_id, attr, max(c) as mv from (select study_id, attr, p, count(distinct value) as c from j group by all) group by all),
r as (select study_id, attr, levels, case when levels <= 1 then 'constant' when levels = n then 'identifier' when mp = 1 and mv = 1 then 'complete' when mp = 1 then 'nested_in_primary' when mv = 1 then 'primary_nested_in_it' else 'crossed' end as relation from b join v using (study_id, attr) join q using (study_id, attr))"""


@query("ds_09_confounding", f"with {CONFOUND} select * from r")
def ds_09(t):
    return D.confounding(t.sample_attr, "condition")


@query("ds_10_pairing", "with c as (select study_id, subject, count(distinct condition) as k, count(*) as n from {sample} group by all), r as (select study_id, count(case when k = 2 and n = 2 then 1 end) as complete, count(case when k < 2 then 1 end) as incomplete, count(case when n > k then 1 end) as duplicated from c group by study_id) select *, complete > 0 and incomplete = 0 and duplicated = 0 as paired from r")
def ds_10(t):
    return D.pairing(t.sample, ["control", "treated"])


@query("ds_11_complete_pairs", "select m.* from {measure} m join {sample} s on m.study_id = s.study_id and m.sample_id = s.sample_id where s.ord % 9 <> 4 and exists (select 1 from {sample} o where o.subject = s.subject and o.ord <> s.ord and o.ord % 9 <> 4)")
def ds_11(t):
    return D.complete_pairs(t.measure, t.sample.where("ord % 9 <> 4"), ["control", "treated"])


@query("ds_14_covariance_decisions", f"""
with {CONFOUND}, s as (select study_id, min(k) >= 2 as within from (select a.study_id, b.value, count(distinct a.value) as k from {{sample_attr}} a join {{sample_attr}} b on a.study_id = b.study_id and a.sample_id = b.sample_id and a.attr = 'condition' and b.attr = 'subject' group by all) group by study_id)
select study_id, attr, relation, case when attr = 'subject' and within then 'block' when attr = 'subject' then 'between_subjects' when relation in ('constant', 'identifier') then 'omit' when relation = 'complete' then 'stop' when relation in ('nested_in_primary', 'primary_nested_in_it') then 'check' else 'candidate' end as decision from r join s using (study_id)""")
def ds_14(t):
    return D.covariance_decisions(t.sample_attr, "condition", "subject")


@query("ds_20_pairing_signal", """
with p as (select study_id, sample_id, value as p from {sample_attr} where attr = 'condition'), v as (select a.study_id, attr, value, count(distinct p) as arms, count(*) as n from {sample_attr} a join p using (study_id, sample_id) where attr <> 'condition' group by all)
select study_id, attr, count(case when arms >= 2 then 1 end) as n_recurring from v group by all having count(case when arms >= 2 then 1 end) >= 2 and max(n) <= 4""")
def ds_20(t):
    return D.pairing_signal(t.sample_attr, "condition")


@query("ds_21_strata_scan", "select study_id, attr, count(distinct value) as levels from {sample_attr} where regexp_matches(attr, 'time|dose|age|day|week') group by all having count(distinct value) >= 2")
def ds_21(t):
    return D.strata_scan(t.sample_attr)


@query("jn_07_mapping_share", "with g as (select distinct feature_id from {deg}) select count(*) as n_features, count(case when regexp_matches(feature_id, '^[A-Za-z][A-Za-z0-9.-]*$') then 1 end) as n_symbol_like from g")
def jn_07(t):
    g = t.deg.select("feature_id").distinct()
    return g.agg(F.count(F.lit(1)).alias("n_features"), F.count_if(F.col("feature_id").rlike("^[A-Za-z][A-Za-z0-9.-]*$")).alias("n_symbol_like"))


@query("jn_07_id_bridge", """
with n as (select s_suppkey as k, 'G' || s_suppkey as sym, 'ENSG' || lpad(s_suppkey::varchar, 11, '0') as ens, s_suppkey % 3 <> 0 as known from supplier)
select 'SYM' as study_id, feature_id, upper(feature_id) as symbol from (select distinct feature_id from {deg})
union all select 'ENS', ens || '.2', sym from n where known union all select 'BRIDGED', k::varchar, sym from n where known
union all select 'NAMED', p_partkey::varchar, upper(replace(p_brand, '#', '-') || '.' || p_size) from part""")
def jn_07b(t):
    k = F.col("s_suppkey").cast("string")
    ens = F.concat(F.lit("ENSG"), F.lpad(k, 11, "0"))
    part, p = F.col("p_partkey").cast("string"), t.part
    ids = t.deg.select(F.lit("SYM").alias("study_id"), "feature_id")
    ids = ids.union(t.supplier.select(F.lit("ENS"), F.concat(ens, F.lit(".2")))).union(t.supplier.select(F.lit("BRIDGED"), k)).union(p.select(F.lit("NAMED"), part))
    cell = lambda study, key, column, place, value: (F.lit(study).alias("study_id"), key.alias("feature_id"), F.lit(column).alias("column"), F.lit(place).alias("place"), value.alias("value"))
    notes = t.supplier.select(*cell("BRIDGED", k, "label", 1, F.col("s_name"))).union(t.supplier.select(*cell("BRIDGED", k, "gene", 2, F.concat(ens, F.lit(".7")))))
    notes = notes.union(p.select(*cell("NAMED", part, "type", 1, F.split_part("p_type", F.lit(" "), F.lit(1))))).union(p.select(*cell("NAMED", part, "annot_gene_name", 2, F.concat(F.translate("p_brand", "#", "-"), F.lit("."), F.col("p_size")))))
    genes = t.supplier.where("s_suppkey % 3 <> 0").select(ens.alias("ensembl"), F.concat(F.lit("g"), k).alias("symbol"))
    return J.id_bridge(ids, notes, genes)
