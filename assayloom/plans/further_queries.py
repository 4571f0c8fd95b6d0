"""Queries on own accessions, cascades, sex checks, catalogue rows and derived columns."""

from __future__ import annotations

from pyspark.sql import functions as F

from assayloom.functions.tables import once
from assayloom.operators import alignment as A
from assayloom.operators import catalogue as C
from assayloom.operators import evaluation as E
from assayloom.operators import joins as J
from assayloom.operators import matrix as M
from assayloom.operators import selection as L
from assayloom.operators import stats as S
from assayloom.operators import texts as X
from assayloom.plans.registry import query
from assayloom.plans.study_queries import COLUMNS, columns
from assayloom.plans.text_queries import BLOCKS, CITED, DOCS, FOUND, OWN, blocks, docs


@query("txt_03_chosen_series", f"""
with {FOUND}, g as (select *, instr(text, accession) as i from a where repo = 'geo'), w as (select paper_id, accession, substring(text, greatest(1, i - 170), 340) as t from g),
s as (select paper_id, accession, sum(len(regexp_extract_all(t, '{OWN}')))::bigint as own, sum(len(regexp_extract_all(t, '{CITED}')))::bigint as cited from w group by all),
z as (select *, count(*) over (partition by paper_id) as n, row_number() over (partition by paper_id order by own - cited desc, accession) as pos from s) select paper_id, accession, own, cited from z where pos = 1 and (own > cited or (n = 1 and cited = 0))""")
def txt_03(t):
    return X.choose_own(blocks(t))


@query("txt_04_relevance_gate", f"select paper_id, case when contains(lower(text), 'deposited') then 'deposited' when contains(lower(text), 'downloaded') then 'downloaded' when contains(lower(text), 'see ') then 'see ' end as phrase from ({DOCS})")
def txt_04(t):
    return X.relevance(docs(t), ["deposited", "downloaded", "see "])


@query("txt_05_design_evidence", f"""
with b as ({BLOCKS}), h as (select paper_id, ord, block_id, unnest(regexp_extract_all(text, '\\b[Tt]h\\w+')) as hit, generate_subscripts(regexp_extract_all(text, '\\b[Tt]h\\w+'), 1) as k from b where section_class in ('methods', 'abstract'))
select paper_id, block_id, hit, row_number() over (partition by paper_id order by ord, k) as place from h qualify place <= 4""")
def txt_05(t):
    return X.design_evidence(blocks(t), r"\b[Tt]h\w+", ["methods", "abstract"])


#: Studies for each level: suppliers by name, and customers whose columns stand in their texts, share tokens with them, or neither.
ALIGNED = f"""
c as (select * from ({COLUMNS}) union all select case when c_custkey % 3 = 0 then 'IN' when c_custkey % 3 = 1 then 'TOK' else 'NO' end || c_nationkey % 4,
  case when c_custkey % 3 = 0 then c_custkey % 97 || 'B' when c_custkey % 3 = 1 then lower(c_mktsegment) || '_' || c_nationkey || '_' || c_custkey % 50 else 'Q' || c_custkey end from customer),
r as (select study_id, sample_id, value from {{sample_attr}} where study_id like 'ST%' union all select case when c_custkey % 3 = 0 then 'IN' when c_custkey % 3 = 1 then 'TOK' else 'NO' end || c_nationkey % 4, 'R' || c_custkey,
  case when c_custkey % 3 = 0 then 'biopsy ' || c_custkey % 89 || 'b left' when c_custkey % 3 = 1 then 'lane ' || c_custkey % 45 || ' ' || c_nationkey || ' of ' || c_mktsegment else 'nothing' end from customer)"""


def aligned(t):
    k = F.col("c_custkey")
    kind = lambda *x: F.when(k % 3 == 0, x[0]).when(k % 3 == 1, x[1]).otherwise(x[2])
    study = F.concat(kind("IN", "TOK", "NO"), F.col("c_nationkey") % 4).alias("study_id")
    name = kind(F.concat(k % 97, F.lit("B")), F.concat(F.lower("c_mktsegment"), F.lit("_"), "c_nationkey", F.lit("_"), k % 50), F.concat(F.lit("Q"), k))
    said = kind(F.concat(F.lit("biopsy "), k % 89, F.lit("b left")), F.concat(F.lit("lane "), k % 45, F.lit(" "), "c_nationkey", F.lit(" of "), "c_mktsegment"), F.lit("nothing"))
    c = columns(t).unionByName(t.customer.select(study, name.alias("sample_id")))
    return c, t.sample_attr.where("study_id like 'ST%'").select("study_id", "sample_id", "value").unionByName(t.customer.select(study, F.concat(F.lit("R"), k).alias("sample_id"), said.alias("value")))


@query("jn_04_alignment_cascade", f"""
with recursive {ALIGNED}, m as (select distinct study_id, sample_id as col from c), w as (select study_id, sample_id as row, lower(array_to_string(list(value order by value), ' ')) as text from r group by all),
x as (select study_id, col from m join (select study_id, row as col from w) using (study_id, col)), n as (select study_id, greatest(1, ceil(least(count(distinct m.col), count(distinct w.row)) * 0.5)) as need from m join w using (study_id) group by study_id),
f as (select m.* from m anti join x using (study_id, col)), g as (select w.* from w anti join (select study_id, col as row from x) using (study_id, row)),
ft as (select *, list_distinct(list_transform(regexp_extract_all(col, '[A-Za-z][A-Za-z0-9]+|[0-9]+'), lambda v: lower(v))) as a from f), gt as (select *, list_distinct(regexp_extract_all(text, '[a-z][a-z0-9]+|[0-9]+')) as b from g),
e as (select study_id, 2 as level, row, col, 0 as score from f join g using (study_id) where contains(text, lower(col)) union all select study_id, 3, row, col, len(list_intersect(a, b)) from ft join gt using (study_id) where len(list_intersect(a, b)) >= 3),
q as (select study_id, level, row, list(col order by score desc, col) as wants, row_number() over (partition by study_id, level order by row) as i from e group by study_id, level, row),
s as (select study_id, level, 0::bigint as i, null::varchar as row, null::varchar as col, []::varchar[] as used from (select distinct study_id, level from q)
  union all select study_id, level, i, row, got, case when got is null then used else list_append(used, got) end from (select q.study_id, q.level, q.i, q.row, s.used, list_filter(q.wants, lambda v: not list_contains(s.used, v))[1] as got from s join q on q.study_id = s.study_id and q.level = s.level and q.i = s.i + 1)),
p as (select study_id, 1 as level, col as row, col from x union all select study_id, l, col, col from x, (values (2), (3)) v(l) union all select study_id, level, row, col from s where col is not null),
k as (select study_id, min(level) as level from (select study_id, level, count(*) as n from p group by all) join n using (study_id) where n >= need group by study_id)
select p.study_id, p.col as matrix_column, p.row as sample_id, p.level from p join k using (study_id, level)""")
def jn_04(t):
    return A.align_cascade(*aligned(t))


@query("st_05_sex_triage", """
with c as (select study_id, sample_id, feature_id, log2(value * 1e6 / sum(value) over (partition by study_id, sample_id) + 1) as y from {measure}),
s as (select study_id, sample_id, avg(case when feature_id in ('F1', 'F2', 'F3') then y end) - avg(case when feature_id = 'F4' then y end) as gap from c group by all),
k as (select study_id, sample_id, case when gap > 1 then 'male' when gap < -1 then 'female' else 'ambiguous' end as inferred, abs(gap) > 2 as high from s),
j as (select k.*, case when ord % 3 = 0 then 'male' when ord % 3 = 1 then 'female' end as recorded from k join {sample} using (study_id, sample_id))
select study_id, sample_id, inferred, recorded, case when recorded is null then 'not_recorded' when inferred <> 'ambiguous' and recorded <> inferred and high then 'mismatch' when inferred <> 'ambiguous' and recorded <> inferred then 'check' else 'agrees' end as status, coalesce(recorded, case when inferred <> 'ambiguous' then inferred end) as resolved from j""")
def st_05(t):
    said = t.sample.select("study_id", "sample_id", F.when(F.col("ord") % 3 == 0, "male").when(F.col("ord") % 3 == 1, "female").alias("sex"))
    return J.sex_triage(S.infer_sex(M.log_cpm(t.measure), ["F1", "F2", "F3"], "F4"), said)


@query("cat_06_scaffold_rows", "select distinct study_id, study_id || '_exp1' as id, 'scaffold' as source from {sample_attr} where study_id not in (select study_id from {sample})")
def cat_06(t):
    return C.scaffold(t.sample_attr, t.sample, "exp")


@query("cat_08_result_rows", "select study_id, study_id || '_ana' || row_number() over (partition by study_id order by contrast_id, method) as analysis_id, contrast_id, method, count(*) as n_features from {deg} group by study_id, contrast_id, method")
def cat_08(t):
    return C.result_rows(t.deg)


@query("cat_10_split_rows", "select n_nationkey as study_id, n_regionkey as parent_id, coalesce(case when n_nationkey % 2 = 0 then n_name end, r_name) as title from nation left join region on n_regionkey = r_regionkey")
def cat_10(t):
    c = t.nation.select(F.col("n_nationkey").alias("study_id"), F.col("n_regionkey").alias("parent_id"), F.when(F.col("n_nationkey") % 2 == 0, F.col("n_name")).alias("title"))
    return C.inherit(c, t.region.select(F.col("r_regionkey").alias("study_id"), F.col("r_name").alias("title")), ["title"])


@query("prj_13_derived_columns", """
select study_id, sample_id, 'arm' as attr, condition || '_' || batch as value from {sample} union all select study_id, sample_id, 'number', regexp_extract(sample_id, '^S(\\d+)$', 1) from {sample} union all select study_id, sample_id, 'treated', case condition when 'treated' then 'yes' when 'control' then 'no' end from {sample}""")
def prj_13(t):
    derived, _ = E.derive_columns(t.sample, {"treated": "condition"}, {"number": ("sample_id", r"^S(\d+)$")}, {"arm": ["condition", "batch"]}, {"treated": {"treated": "yes", "control": "no"}})
    return derived.unpivot(["study_id", "sample_id"], ["arm", "number", "treated"], "attr", "value")


@query("typ_08_metadata_rejection", "with c as (select study_id, attr from {sample_attr} union all select study_id, feature_id from {measure}) select study_id, count(distinct attr) as n_columns, count(distinct case when attr in ('age', 'sex', 'condition', 'treatment', 'title', 'organism', 'batch', 'subject') then attr end) as n_metadata, count(distinct case when attr in ('age', 'sex', 'condition', 'treatment', 'title', 'organism', 'batch', 'subject') then attr end) * 2 >= count(distinct attr) as rejected from c group by study_id")
def typ_08(t):
    return E.metadata_rejection(t.sample_attr.select("study_id", "attr").union(t.measure.select("study_id", "feature_id")))


@query("typ_11_assay_label", "select p_partkey, case when p_partkey % 3 = 0 then 'RNA-Seq' when contains(lower(p_name), 'ring') or p_partkey % 3 = 1 then 'microarray gene expression profiling' else 'high-throughput sequencing' end as assay from part")
def typ_11(t):
    k = F.col("p_partkey") % 3
    text = F.concat(F.when(k == 1, "Affymetrix GeneChip").otherwise(""), F.when(F.lower("p_name").contains("ring"), " hybridization").otherwise(""))
    return t.part.select("p_partkey", E.assay_label(F.when(k == 0, "RNA-Seq"), text).alias("assay"))


@query("ev_07_arm_comparison", "with a as (select feature_id, log2fc, padj < 0.3 as sig from {run_deg} where run_id = 'runA'), b as (select feature_id, log2fc, padj < 0.3 as sig from {run_deg} where run_id = 'runR') select count(*) as n_common, count(case when abs(a.log2fc - b.log2fc) < 0.5 then 1 end) as n_close, count(case when a.sig and b.sig then 1 end) as sig_both, count(case when a.sig <> b.sig then 1 end) as sig_one from a join b using (feature_id)")
def ev_07(t):
    return E.arm_comparison(t.run_deg.where("run_id = 'runA'"), t.run_deg.where("run_id = 'runR'"), 0.3, 0.5)


#: Orders as tables of two parses: one as it is, one with other marks, lost lines, and parts of two orders in one table.
TABLES = """
a as (select o % 40 as paper_id, 'T' || lpad(o::varchar, 8, '0') as table_id, '| part | amount |' || chr(10) || '|---|---|' || chr(10) || string_agg('| ' || p || ' | ' || q || ' |', chr(10) order by ln) as text from l group by o),
b as (select paper_id, table_id, string_agg(row, chr(10) order by o, ln) as text from (select o % 40 as paper_id, 'X' || lpad((o - o % 80)::varchar, 8, '0') || case when o % 3 = 0 then 'a' else 'b' end as table_id, o, ln, '|**' || p || '**|' || case when q < 10 then '−' else '' end || q || '|' as row from l where ln % 5 <> 4) group by all)""".replace("\\u2212", "−")


def order_tables(t):
    o, q, paper = F.col("l_orderkey"), F.col("l_quantity").cast("long").alias("q"), (F.col("l_orderkey") % 40).alias("paper_id")
    p = F.col("l_partkey").cast("string")
    rows = lambda x: F.array_join(F.transform(F.sort_array(F.collect_list(x)), lambda r: r["row"]), "\n")
    # dealt by table, so that lines become texts and texts are told apart by the same shuffle
    dealt = lambda df: df.repartition("paper_id", "table_id")
    a = dealt(t.lineitem.select(paper, F.concat(F.lit("T"), F.lpad(o.cast("string"), 8, "0")).alias("table_id"), F.col("l_linenumber").alias("ln"), "l_partkey", q)).withColumn("row", F.concat(F.lit("| "), p, F.lit(" | "), "q", F.lit(" |")))
    a = a.groupBy("paper_id", "table_id").agg(F.concat(F.lit("| part | amount |\n|---|---|\n"), rows(F.struct("ln", "row"))).alias("text"))
    name = F.concat(F.lit("X"), F.lpad((o - o % 80).cast("string"), 8, "0"), F.when(o % 3 == 0, "a").otherwise("b"))
    b = dealt(t.lineitem.where("l_linenumber % 5 <> 4").select(paper, name.alias("table_id"), o.alias("o"), F.col("l_linenumber").alias("ln"), "l_partkey", q))
    b = b.withColumn("row", F.concat(F.lit("|**"), p, F.lit("**|"), F.when(F.col("q") < 10, "−").otherwise(""), "q", F.lit("|"))).groupBy("paper_id", "table_id")
    return a, b.agg(rows(F.struct("o", "ln", "row")).alias("text"))


@query("ev_19_table_match", rf"""
with l as (select l_orderkey as o, l_linenumber as ln, l_partkey as p, l_quantity::bigint as q from lineitem), {TABLES},
c as (select 'a' as s, paper_id, table_id, unnest(string_split(text, chr(10))) as line from a union all select 'b', paper_id, table_id, unnest(string_split(text, chr(10))) from b),
e as (select s, paper_id, table_id, unnest(string_split(regexp_replace(line, '^\|+|\|+$', '', 'g'), '|')) as raw from c where starts_with(line, '|') and not regexp_matches(line, '^\|[-:\s|]+$')),
f as (select s, paper_id, table_id, regexp_replace(replace(regexp_replace(lower(raw), '[*_`]', '', 'g'), '{chr(0x2212)}', '-'), '\s+', '', 'g') as cell from e), g as (select s, paper_id, table_id, cell, count(*) as n from f where cell not in ('', '-') group by all),
z as (select paper_id, table_id, sum(n)::bigint as n_cells from g where s = 'a' group by all), h as (select x.paper_id, x.table_id, y.table_id as match_id, sum(x.n) as k from g x join g y on x.paper_id = y.paper_id and x.cell = y.cell where x.s = 'a' and y.s = 'b' group by all),
m as (select * from h qualify row_number() over (partition by paper_id, table_id order by k desc, match_id) = 1)
select paper_id, table_id, n_cells, match_id, round(coalesce(k, 0) / n_cells, 6) as share from z left join m using (paper_id, table_id)""")
def ev_19_tables(t):
    return E.table_match(*order_tables(t))


@query("ev_19_accession_classes", f"""
with {FOUND}, x as (select distinct paper_id, accession, section_class from a where repo = 'geo'), y as (select distinct paper_id, accession, case when ord % 5 = 2 then 'other' else section_class end as section_class from a where repo = 'geo' and ord % 7 <> 3),
p as (select paper_id, accession, list_sort(list(section_class)) as a from x group by all), q as (select paper_id, accession, list_sort(list(section_class)) as b from y group by all)
select paper_id, accession, coalesce(array_to_string(a, ','), '') as first_classes, coalesce(array_to_string(b, ','), '') as second_classes, b is not null as found, case when a is not null then coalesce(list_has_any(a, b), false) end as same_class from p full join q using (paper_id, accession)""")
def ev_19_accessions(t):
    a = once(X.accessions(blocks(t)).where("repo = 'geo'").select("paper_id", "ord", "accession", "section_class"))
    return E.accession_comparison(a, a.where("ord % 7 <> 3").withColumn("section_class", F.when(F.col("ord") % 5 == 2, "other").otherwise(F.col("section_class"))))


@query("ev_19_parse_comparison", f"""
with a as (select paper_id, section_class, count(*) as n from ({BLOCKS}) group by all), b as (select paper_id, section_class, count(*) as n from ({BLOCKS}) where ord % 7 <> 3 group by all)
select coalesce(a.paper_id, b.paper_id) as paper_id, coalesce(a.section_class, b.section_class) as section_class, coalesce(a.n, 0) as n_first, coalesce(b.n, 0) as n_second, coalesce(a.n, 0) = coalesce(b.n, 0) as same from a full join b on a.paper_id = b.paper_id and a.section_class = b.section_class""")
def ev_19(t):
    return E.parse_comparison(blocks(t), blocks(t).where("ord % 7 <> 3"))


@query("src_09_matrix_choice", "with f as (select p_partkey % 50 as study_id, p_name || '_' || p_partkey as name, p_size as size, p_type as kind from part where p_name not like '%ring%'), r as (select *, row_number() over (partition by study_id order by size desc, name) as pos from f) select study_id, name, size, kind from r where pos <= 3 qualify row_number() over (partition by study_id order by kind = 'STANDARD' desc, pos) = 1")
def src_09(t):
    f = t.part.where(~F.col("p_name").contains("ring")).select((F.col("p_partkey") % 50).alias("study_id"), F.concat_ws("_", "p_name", "p_partkey").alias("name"), F.col("p_size").alias("size"), F.col("p_type").alias("kind"))
    return L.pick_matrix(f, F.col("kind") == "STANDARD")


@query("src_01_unpivoted_matrix", "select study_id, feature_id, condition as sample_id, sum(value)::double as value from {measure} join {sample} using (study_id, sample_id) group by all")
def src_01(t):
    wide = t.measure.join(t.sample.select("study_id", "sample_id", "condition"), ["study_id", "sample_id"]).groupBy("study_id", "feature_id").pivot("condition", ["control", "treated"]).sum("value")
    return wide.unpivot(["study_id", "feature_id"], ["control", "treated"], "sample_id", "value").withColumn("value", F.col("value").try_cast("double"))
