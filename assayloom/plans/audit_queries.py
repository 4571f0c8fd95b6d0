"""Queries on audits, scores and the catalogue."""

from __future__ import annotations

from pyspark.sql import functions as F

from assayloom.functions.tables import once
from assayloom.operators import audits as A
from assayloom.operators import catalogue as C
from assayloom.operators import evaluation as E
from assayloom.operators import joins as J
from assayloom.plans.matrix_queries import MAPPING, mapping
from assayloom.plans.registry import query
from assayloom.plans.result_queries import R
from assayloom.plans.study_queries import BEST
from assayloom.plans.text_queries import FOUND, X, blocks


@query("au_01_schema_conformance", """
with r as (select case when c_custkey % 10 = 0 then 'mystery' when c_custkey % 2 = 0 then 'study' else 'sample' end as "table", c_custkey as row_id, case c_custkey % 3 when 0 then ['id', 'title'] when 1 then ['id', 'study_id', 'label'] else ['id', 'title', 'note'] end as keys from customer),
k as (select * from (values ('study', ['id', 'title']), ('sample', ['id', 'study_id', 'label'])) k("table", known)),
j as (select r.*, known, list_sort(list_filter(known, lambda x: not list_contains(keys, x))) as missing, list_sort(list_filter(keys, lambda x: not list_contains(known, x))) as extra from r left join k on r."table" = k."table")
select "table", row_id, case when known is null then 'unknown table' when len(missing) > 0 then 'missing ' || array_to_string(missing, ',') else 'unknown ' || array_to_string(extra, ',') end as message from j where known is null or len(missing) > 0 or len(extra) > 0""")
def au_01(t):
    k = F.col("c_custkey")
    keys = lambda *n: F.array(*map(F.lit, n))
    rows = t.customer.select(F.when(k % 10 == 0, "mystery").when(k % 2 == 0, "study").otherwise("sample").alias("table"), k.alias("row_id"), F.when(k % 3 == 0, keys("id", "title")).when(k % 3 == 1, keys("id", "study_id", "label")).otherwise(keys("id", "title", "note")).alias("keys"))
    return A.schema_errors(rows, t.spark.createDataFrame([("study", ["id", "title"]), ("sample", ["id", "study_id", "label"])], "table string, keys array<string>"))


@query("au_02_foreign_keys", """
select 'lineitem.part' as rule, l_partkey::varchar as key, count(*) as n_rows from lineitem where l_partkey not in (select p_partkey from part where p_partkey % 10 <> 3) group by l_partkey
union all select 'orders.customer', o_custkey::varchar, count(*) from orders where o_custkey not in (select c_custkey from customer where c_custkey % 11 <> 5) and o_custkey <> 5 group by o_custkey""")
def au_02(t):
    a = A.fk_errors(t.lineitem, "l_partkey", t.part.where("p_partkey % 10 <> 3"), "p_partkey", "lineitem.part")
    return a.union(A.fk_errors(t.orders, "o_custkey", t.customer.where("c_custkey % 11 <> 5"), "c_custkey", "orders.customer", optional=True, sentinels=("5",)))


@query("au_03_evidence_references", "select 'duplicate evidence' as rule, evidence_id::varchar as key, count(*) as n_rows from {link} group by evidence_id having count(*) > 1 union all select 'dangling claim', claim_id::varchar, count(*) from {link} where claim_id not in (select claim_id from {claim} where importance = 'secondary') group by claim_id")
def au_03(t):
    return A.duplicate_ids(t.link, "evidence_id", "duplicate evidence").union(A.fk_errors(t.link, "claim_id", t.claim.where("importance = 'secondary'"), "claim_id", "dangling claim"))


@query("au_05_card_audit", """
with n as (select claim_id, count(*) as n, count(case when relation = 'supports' then 1 end) as supports, count(case when relation = 'contradicts' then 1 end) as contradicts, count(case when relation = 'context' then 1 end) as context from {link} group by claim_id)
select importance, count(*) as n_claims, count(*) - count(n) as n_uncovered, coalesce(sum(supports), 0)::bigint as supports, coalesce(sum(contradicts), 0)::bigint as contradicts, coalesce(sum(context), 0)::bigint as context,
  case when importance = 'primary' and count(*) > count(n) then 'primary_claims_unmapped' else '' end as blocking from {claim} left join n using (claim_id) group by importance""")
def au_05(t):
    return A.card_audit(t.claim, t.link)


@query("au_06_record_rules", "select case_id, stage, seq, 'confidence must be high, medium, or low' as violation from {decision} where confidence not in ('high', 'medium', 'low') union all select case_id, stage, seq, 'blocked decision cannot have completed execution' from {decision} where decision_status = 'blocked' and execution_status = 'completed'")
def au_06(t):
    return A.record_rules(t.decision)


@query("au_07_case_rules", """
with c as (select case_id, count(case when decision_status = 'blocked' then 1 end) as b, count(case when execution_status = 'completed' then 1 end) as c, count(case when stage = 'user' and decision_status <> 'blocked' then 1 end) as u, count(case when stage = 'assistant' and decision_status <> 'blocked' then 1 end) as a from {decision} group by case_id)
select case_id, 'completed although gates are blocked' as violation from c where b > 0 and c > 0 union all select case_id, 'completed without user' from c where c > 0 and u = 0 union all select case_id, 'completed without assistant' from c where c > 0 and a = 0""")
def au_07(t):
    return A.case_rules(t.decision, ("user", "assistant"))


WORDS = "['raw counts', 'estimated counts (RSEM)', 'log2 RMA', 'FPKM linear', 'beta values', 'beta and M-value', 'unknown', 'protein', 'TPM']"
METHODS = "['DESeq2, paired', 'limma, deviation from DESeq2', 'limma-voom', 'edgeR', 'none', 'wilcoxon', '', 'not_run']"


@query("au_08_vocabulary", f"""
with r as (select p_partkey, {WORDS}[1 + p_partkey % 9] as m, {METHODS}[1 + p_partkey % 8] as d from part)
select p_partkey, case when m = 'unknown' then 'ambiguous' when contains(m, 'estimated') then 'estimated_counts' when m = 'beta values' then 'methylation_beta' when m in ('log2 RMA', 'beta and M-value') then 'log_scale' when m in ('FPKM linear', 'TPM') then 'linear_normalized' when m = 'raw counts' then 'raw_counts' else 'other' end as matrix,
  case when d in ('', 'none', 'not_run') then 'none' when d = 'wilcoxon' then 'other' when starts_with(d, 'limma,') then 'log_linear' else 'count' end as method from r""")
def au_08(t):
    pick = lambda text, n: F.element_at(F.array(*(F.lit(x.strip("' ")) for x in text[2:-2].split("', '"))), (F.col("p_partkey") % n + 1).cast("int"))
    return t.part.select("p_partkey", A.matrix_family(pick(WORDS, 9)).alias("matrix"), A.method_family(pick(METHODS, 8)).alias("method"))


@query("au_08b_confidence", "select confidence, case confidence when 'high' then 0.9 when 'medium' then 0.7 when 'low' then 0.4 else try_cast(confidence as double) end::double as value, count(*) as n from {decision} group by 1, 2")
def au_08b(t):
    return t.decision.groupBy("confidence", A.confidence_value(F.col("confidence")).alias("value")).agg(F.count(F.lit(1)).alias("n"))


@query("au_10_foreign_accessions", f"with {FOUND}, o as (select paper_id, accession from a union select doc_id, 'GSE99' || doc_id from documents where doc_id % 9 = 0), known as (select distinct paper_id, accession from a) select paper_id, accession from o where not exists (select 1 from known k where k.paper_id = o.paper_id and k.accession = o.accession)")
def au_10(t):
    own = once(X.accessions(blocks(t)).select("paper_id", "accession").distinct())
    return X.foreign_accessions(own.union(t.documents.where("doc_id % 9 = 0").select(F.col("doc_id"), F.concat(F.lit("GSE99"), "doc_id"))), own)


@query("au_11_recount", "with e as (select study_id, method, count(case when padj < 0.5 then 1 end) + case when method = 'log_raw' then 1 else 0 end as expected from {deg} group by study_id, method), a as (select study_id, method, count(case when padj < 0.5 then 1 end) as actual from {deg} group by all) select * from e join a using (study_id, method) where expected <> actual")
def au_11(t):
    a = t.deg.groupBy("study_id", "method").agg(F.count_if(F.col("padj") < 0.5).alias("n"))
    return A.recount(a.withColumn("n", F.col("n") + F.when(F.col("method") == "log_raw", 1).otherwise(0)), a, ["study_id", "method"], "n")


@query("au_12_paper_vs_own", "with p as (select study_id, count(case when direction = 'up' then 1 end) as up, count(case when direction = 'down' then 1 end) as down from {finding} group by study_id), o as (select study_id, count(case when padj < 0.6 and log2fc > 0 then 1 end) as own_up, count(case when padj < 0.6 and log2fc < 0 then 1 end) as own_down from {deg} where method = 'log_cpm' group by study_id) select * from p left join o using (study_id)")
def au_12(t):
    return A.said_and_own_counts(t.finding, t.deg.where("method = 'log_cpm'"), 0.6)


@query("ev_14_link_scores", """
with p as (select claim_id, evidence_id, case when claim_id % 10 = 0 then 'supports' else relation end as p from {link} where claim_id % 7 <> 2), j as (select relation as g, p from {link} full join p using (claim_id, evidence_id))
select count(g) as n_gold, count(p) as n_predicted, count(case when g = p then 1 end) as n_right, count(case when p = 'supports' and g is distinct from 'supports' then 1 end) as false_support, round(count(case when g = p then 1 end) / count(g), 6) as accuracy from j""")
def ev_14(t):
    p = t.link.where("claim_id % 7 <> 2").withColumn("relation", F.when(F.col("claim_id") % 10 == 0, "supports").otherwise(F.col("relation")))
    return A.link_scores(t.link, p)


@query("ev_15_gate_score", """
with c as (select case_id as key, 'not_blocked' as "check", decision_status <> 'blocked' as passed from {decision} where seq = 0 union all select case_id, 'completed', execution_status = 'completed' from {decision} where seq = 0 union all select case_id, 'confident', confidence = 'high' from {decision} where seq = 0)
select key, round(sum(case when passed then case "check" when 'completed' then 3.0 else 1 end else 0 end) / sum(case "check" when 'completed' then 3.0 else 1 end), 6) as score, coalesce(array_to_string(list_sort(list("check") filter (not passed)), ','), '') as blocking from c group by key""")
def ev_15(t):
    d = t.decision.where("seq = 0")
    one = lambda name, ok: d.select(F.col("case_id").alias("key"), F.lit(name).alias("check"), ok.alias("passed"))
    c = one("not_blocked", F.col("decision_status") != "blocked").union(one("completed", F.col("execution_status") == "completed")).union(one("confident", F.col("confidence") == "high"))
    return A.gate_score(c, {"completed": 3.0}).withColumn("blocking", F.coalesce("blocking", F.lit("")))


@query("ev_18_rerun_comparison", "with a as (select l_suppkey, count(*) as first from lineitem where l_returnflag = 'A' group by 1), b as (select l_suppkey, count(*) as second from lineitem where l_returnflag = 'N' and l_suppkey % 10 <> 0 group by 1) select coalesce(a.l_suppkey, b.l_suppkey) as l_suppkey, first, second, first is not distinct from second as same from a full join b on a.l_suppkey = b.l_suppkey")
def ev_18(t):
    n = lambda cond: t.lineitem.where(cond).groupBy("l_suppkey").agg(F.count(F.lit(1)).alias("n"))
    return A.rerun_diff(n("l_returnflag = 'A'"), n("l_returnflag = 'N' and l_suppkey % 10 <> 0"), "l_suppkey", "n")


@query("ev_20_table_fill", "select 'measure' as \"table\", count(*) as n_rows, count(*) * 4 as n_cells, count(study_id) + count(feature_id) + count(sample_id) + count(value) as n_filled from {measure_gaps}")
def ev_20(t):
    return A.table_fill(t.measure_gaps, "measure", ["study_id", "feature_id", "sample_id", "value"])


@query("ev_06_planted_recovery", "with d as (select * from {deg} where method = 'log_cpm'), j as (select d.*, substr(feature_id, 2)::int % 5 = 0 as planted from d) select study_id, count(case when planted then 1 end) as n_planted, count(case when planted and padj < 0.6 then 1 end) as n_found, round(count(case when planted and padj < 0.6 then 1 end) / count(case when planted then 1 end), 6) as sensitivity, round(count(case when not planted and padj < 0.6 then 1 end) / count(case when not planted then 1 end), 6) as false_rate from j group by study_id")
def ev_06(t):
    return E.planted_recovery(t.deg.where("method = 'log_cpm'"), F.substring("feature_id", 2, 9).cast("int") % 5 == 0, F.col("padj") < 0.6)


@query("agg_17_verdict_histogram", "with r as (select decision_status as verdict, unnest(string_split(stage || '+' || execution_status, '+')) as kind from {decision}) select kind, verdict, count(*) as n from r group by all")
def agg_17(t):
    return A.verdict_histogram(t.decision.select("decision_status", F.concat_ws("+", "stage", "execution_status").alias("kinds")), "decision_status", "kinds")


SCORED = "select stage as method, execution_status as class, case decision_status when 'decided' then 'correct' when 'confirmed' then 'reversed' else 'refused' end as verdict from {decision}"


@query("agg_20_method_scorecard", f"with s as ({SCORED}) select method, coalesce(class, 'all') as class, count(*) as n, count(case when verdict = 'correct' then 1 end) as correct, round(count(case when verdict = 'correct' then 1 end) / count(*), 6) as accuracy, round(count(case when verdict = 'reversed' then 1 end) / count(*), 6) as wrong_rate, round(count(case when verdict = 'refused' then 1 end) / count(*), 6) as refusal_rate from s group by grouping sets ((method, class), (method))")
def agg_20(t):
    v = F.when(F.col("decision_status") == "decided", "correct").when(F.col("decision_status") == "confirmed", "reversed").otherwise("refused")
    return A.scorecard(t.decision.select(F.col("stage").alias("method"), F.col("execution_status").alias("class"), v.alias("verdict")))


@query("agg_21_arm_summary", "with c as (select event_type as arm, (user_id % 4)::varchar as verdict, value > 5 as resolved, (event_id % 300)::double as tokens from events), v as (select arm, verdict, count(*) as c from c group by all), m as (select arm, arg_max(verdict, (c, verdict)) as modal from v group by arm) select arm, count(*) as n, round(avg(case when resolved then 1.0 else 0 end), 6) as resolved_rate, round(avg(tokens), 4) as mean_tokens, any_value(modal) as modal from c join m using (arm) group by arm")
def agg_21(t):
    c = t.events.select(F.col("event_type").alias("arm"), (F.col("user_id") % 4).cast("string").alias("verdict"), (F.col("value") > 5).alias("resolved"), (F.col("event_id") % 300).cast("double").alias("tokens"))
    return A.arm_summary(c)


@query("cat_01_attribute_roles", """
select * from (values ('ST0', 'group', 'condition'), ('ST1', 'group', 'condition'), ('ST0', 'subject', 'subject'), ('ST1', 'subject', 'subject'), ('ST0', 'organism', 'organism'), ('ST1', 'organism', 'organism'), ('ST0', 'title', 'title'), ('ST1', 'title', 'title')) v(study_id, role, attr) where study_id in (select study_id from {sample_attr})
union all select distinct study_id, 'group', attr from {sample_attr} where attr = 'treatment' union all select distinct study_id, attr, attr from {sample_attr} where attr in ('age', 'sex')""")
def cat_01(t):
    return C.roles(t.sample_attr)


GROUPS = "select study_id, study_id || '_grp' || row_number() over (partition by study_id order by value) as group_id, value as label, count(*) as n_samples, 'condition' as label_source from {sample_attr} where attr = 'condition' group by study_id, value"


@query("cat_02_group_rows", GROUPS)
def cat_02(t):
    return C.groups(t.sample_attr, "condition")


@query("cat_02b_sample_rows", f"with g as ({GROUPS}) select s.study_id, s.study_id || '_samp' || row_number() over (partition by s.study_id order by sample_id) as sample_key, sample_id, group_id, s.study_id || '_sub' || dense_rank() over (partition by s.study_id order by subject) as subject_id from {{sample}} s join g on g.study_id = s.study_id and g.label = s.condition")
def cat_02b(t):
    return C.samples(t.sample_attr.where("attr in ('condition', 'subject')"), "condition", "subject")


@query("jn_11_group_resolution", f"with g as ({GROUPS}), a as (select distinct study_id, ' ' || upper(condition) as arm from {{sample}} union all select distinct study_id, 'placebo' from {{sample}}) select a.study_id, arm, group_id from a left join g on g.study_id = a.study_id and lower(trim(arm)) = label")
def jn_11(t):
    a = t.sample.select("study_id", F.concat(F.lit(" "), F.upper("condition")).alias("arm")).distinct().union(t.sample.select("study_id", F.lit("placebo")).distinct())
    return C.resolve_groups(a, C.groups(t.sample_attr, "condition"), "arm")


@query("cat_04_sourced_fields", "select s_suppkey as id, s_name as name, 'supplier' as name_source, s_acctbal::varchar as balance, 'account' as balance_source from supplier")
def cat_04(t):
    s = lambda c, src: F.struct(F.col(c).cast("string").alias("value"), F.lit(src).alias("source"))
    return C.flatten_sourced(t.supplier.select(F.col("s_suppkey").alias("id"), s("s_name", "supplier").alias("name"), s("s_acctbal", "account").alias("balance")))


@query("cat_07_finding_rows", "with f as (select * from {finding} where entity_type in ('gene', 'protein') and not contains(entity, ' ') qualify row_number() over (partition by study_id, entity order by finding_id) = 1) select study_id, study_id || '_gene' || row_number() over (partition by study_id order by entity) as gene_id, entity as symbol, direction, source as symbol_source from f")
def cat_07(t):
    return C.finding_rows(t.finding)


@query("cat_09_reconciliation", f"""
with {BEST}, j as (select f.*, our_symbol, log2fc, coalesce(padj < 0.6, false) as sig, case when log2fc > 0 then 'up' else 'down' end as ours from f left join h using (study_id, finding_id)),
v as (select study_id, case when not checkable then 'not_checkable' when our_symbol is null then 'not_in_results' when direction in ('up', 'down') then case when sig and ours = direction then 'confirmed' when sig then 'contradicted' when ours = direction then 'direction_only' else 'not_detected' end when direction = 'unchanged' then case when sig then 'contradicted' else 'confirmed' end else case when sig then 'confirmed_change' else 'not_detected' end end as verdict from j),
n as (select study_id, verdict, count(*) as n from v group by all) select study_id, array_to_string(list_sort(list(verdict || '=' || n)), ';') as breakdown, sum(n)::bigint as n_findings, coalesce(sum(case when verdict = 'contradicted' then n end), 0)::bigint as n_disagree from n group by study_id""")
def cat_09(t):
    return C.reconciliation(J.agreement(t.finding, t.deg, 0.6))


@query("cat_11_manifest", "with s as (select distinct study_id from {sample}) select study_id, coalesce((select count(*) from {sample} x where x.study_id = s.study_id), 0) as samples, coalesce((select count(*) from {deg} x where x.study_id = s.study_id), 0) as results, coalesce((select count(*) from {finding} x where x.study_id = s.study_id), 0) as findings from s")
def cat_11(t):
    return C.manifest(t.sample.select("study_id").distinct(), {"samples": t.sample, "results": t.deg, "findings": t.finding})


KG = f"""
d as (select distinct study_id, gene as object, case when log2fc > 0 then 'upregulates' else 'downregulates' end as predicate, 'data' as origin from {{deg}} join ({MAPPING}) on feature_id = transcript where gene <> '' and method = 'log_cpm' and padj < 0.6),
c as (select distinct study_id, entity as object, case direction when 'up' then 'upregulates' when 'down' then 'downregulates' else 'changes' end as predicate, 'text' as origin from {{finding}} f where entity_type in ('gene', 'protein') and not exists (select 1 from d where d.study_id = f.study_id and d.object = f.entity))"""


@query("cat_12_kg_edges", f"with {KG} select e.*, context, best_set from (select * from d union all select * from c) e left join (select study_id, array_to_string(list_sort(list(distinct batch)), ';') as context from {{sample}} group by study_id) using (study_id) left join (select study_id, arg_min(set_id, (fdr_q, set_id)) as best_set from {{gsea}} group by study_id) using (study_id)")
def cat_12(t):
    g = R.mapped(t.deg.where("method = 'log_cpm' and padj < 0.6"), mapping(t))
    context = t.sample.groupBy("study_id").agg(F.array_join(F.array_sort(F.collect_set("batch")), ";").alias("context"))
    return C.kg_edges(g, context, t.gsea.groupBy("study_id").agg(F.min_by("set_id", F.struct("fdr_q", "set_id")).alias("best_set")), t.finding)


@query("cat_13_study_of_child", f"with g as ({GROUPS}) select group_id, study_id as study from g")
def cat_13(t):
    return C.groups(t.sample_attr, "condition").select("group_id", C.study_of(F.col("group_id")).alias("study"))


@query("src_05_count_column", r"""
with v as (select l_returnflag as file, 'length' as col, l_extendedprice as value from lineitem union all select l_returnflag, 'read_count', l_quantity from lineitem union all select l_returnflag, 'tpm', l_discount from lineitem),
s as (select file, col, case col when 'read_count' then 4 when 'length' then -3 when 'tpm' then -3 end + case when min(value) >= 0 and avg(case when round(value) = value then 1.0 else 0 end) >= 0.95 then 1 else 0 end as score from v group by file, col)
select file, col as count_column, score, 'medium' as confidence from s qualify row_number() over (partition by file order by score desc, col desc) = 1""")
def src_05(t):
    from assayloom.sources.files import choose_count_column

    pick = lambda name, c: t.lineitem.select(F.col("l_returnflag").alias("file"), F.lit(name).alias("col"), F.col(c).alias("value"))
    return choose_count_column(pick("length", "l_extendedprice").union(pick("read_count", "l_quantity")).union(pick("tpm", "l_discount")))


@query("src_06_strand_choice", "with s as (select l_returnflag as study_id, sum(case when l_linestatus = 'F' then l_quantity * 4 else 0 end) as f, sum(case when l_linestatus = 'O' then l_quantity else 0 end) as r from lineitem group by 1) select study_id, round(greatest(f, r) / least(f, r), 4) as ratio, case when greatest(f, r) / least(f, r) >= 3 then case when f > r then 'forward' else 'reverse' end when greatest(f, r) / least(f, r) < 1.5 then 'unstranded' else 'ambiguous' end as strand from s")
def src_06(t):
    from assayloom.sources.files import choose_strand

    f = F.when(F.col("l_linestatus") == "F", F.col("l_quantity") * 4).otherwise(0.0)
    return choose_strand(t.lineitem.select(F.col("l_returnflag").alias("study_id"), f.alias("forward"), F.when(F.col("l_linestatus") == "O", F.col("l_quantity")).otherwise(0.0).alias("reverse")))


FILES = "select p_partkey % 50 as series, case p_partkey % 8 when 0 then 'x_raw_counts.csv.gz' when 1 then 'x_fpkm.txt' when 2 then 'GSE1_RAW.tar' when 3 then 'deg_results.csv' when 4 then 'matrix.tsv' when 5 then 'filelist.txt' when 6 then 'notes.pdf' else 'x_normcounts.xlsx' end as name from part where p_partkey % 50 < 40 or p_partkey % 8 in (1, 3, 5, 6)"


@query("src_10_file_classes", f"""
with f as ({FILES}), c as (select series, count(case when name = 'x_raw_counts.csv.gz' then 1 end) as raw, count(case when name = 'GSE1_RAW.tar' then 1 end) as tar, count(case when name in ('x_fpkm.txt', 'x_normcounts.xlsx') then 1 end) as norm, count(case when name = 'matrix.tsv' then 1 end) as other, count(case when name = 'deg_results.csv' then 1 end) as de from f where name <> 'filelist.txt' group by series)
select *, case when raw > 0 then 'raw_counts' when tar > 0 then 'raw_tar' when norm > 0 then 'normalized_only' when other > 0 then 'unlabelled_matrix' when de > 0 then 'de_tables_only' else 'none' end as status from c""")
def src_10(t):
    from assayloom.sources.files import classify_files

    k, names = F.col("p_partkey"), ["x_raw_counts.csv.gz", "x_fpkm.txt", "GSE1_RAW.tar", "deg_results.csv", "matrix.tsv", "filelist.txt", "notes.pdf", "x_normcounts.xlsx"]
    f = t.part.where((k % 50 < 40) | (k % 8).isin(1, 3, 5, 6)).select((k % 50).alias("series"), F.element_at(F.array(*map(F.lit, names)), (k % 8 + 1).cast("int")).alias("name"))
    return classify_files(f)


@query("src_14_table_counts", "select 'part' as \"table\", count(*) as n from part union all select 'orders', count(*) from orders union all select 'events', count(*) from events")
def src_14(t):
    from assayloom.sources.files import table_counts

    return table_counts({"part": t.part, "orders": t.orders, "events": t.events})
