"""Views that shape the given tables into studies, measures, results and texts.

Each is one SQL text that Spark and DuckDB both run; ``{name}`` stands for a table or another view.
"""

from __future__ import annotations

import re
from functools import cache

from pyspark.sql import DataFrame, SparkSession

from assayloom import attach

TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents", "embeddings", "pages", "benchmark", "labels", "conversations")

VIEWS = {
    "sample": """
select concat('ST', cast(cast(floor(s_suppkey / 2) as bigint) % 2 as string)) as study_id, concat('S', cast(s_suppkey as string)) as sample_id,
  case when s_suppkey % 2 = 0 then 'control' else 'treated' end as condition, concat('P', cast(cast(floor(s_suppkey / 2) as bigint) as string)) as subject,
  r_name as batch, n_name as site, s_suppkey as ord
from {supplier} join {nation} on s_nationkey = n_nationkey join {region} on n_regionkey = r_regionkey""",
    "cell_sum": "select l_partkey % 200 as f, l_suppkey as s, sum(l_quantity) as v from {lineitem} group by l_partkey % 200, l_suppkey",
    "feature": "select distinct l_partkey % 200 as f from {lineitem}",
    "measure": """
select s.study_id, concat('F', cast(f.f as string)) as feature_id, s.sample_id, cast(coalesce(c.v, 0) as bigint) as value
from {sample} s cross join {feature} f left join {cell_sum} c on c.f = f.f and c.s = s.ord""",
    "measure_gaps": """
select s.study_id, concat('F', cast(c.f as string)) as feature_id, s.sample_id, cast(c.v as double) as value from {cell_sum} c join {sample} s on c.s = s.ord
union all
select s.study_id, concat('F', cast(f.f as string)) as feature_id, s.sample_id, cast(null as double) as value
from {sample} s cross join {feature} f left join {cell_sum} c on c.f = f.f and c.s = s.ord where c.f is null""",
    "cell_meta": """
select o_orderkey as cell_id, concat('D', cast(o_custkey % 8 as string)) as sample_id, o_orderpriority as celltype, o_orderstatus as condition
from {orders} where o_orderstatus in ('F', 'O')""",
    "cell_count": "select l_orderkey as cell_id, concat('G', cast(l_partkey % 200 as string)) as gene, cast(sum(l_quantity) as bigint) as value from {lineitem} group by l_orderkey, l_partkey % 200",
    "peptide": """
select concat('PEP', cast(p_partkey as string)) as peptide,
  concat(case when p_partkey % 25 = 0 then 'CON__' else '' end, p_brand, case when p_partkey % 10 = 0 then concat(';', p_type) else '' end) as protein_ids,
  concat('S', cast(l_suppkey % 10 as string)) as sample_id, cast(sum(l_quantity) as bigint) as value
from {part} join {lineitem} on p_partkey = l_partkey group by p_partkey, p_brand, p_type, l_suppkey % 10""",
    "sample_attr": """
select study_id, sample_id, 'condition' as attr, 1 as ord, condition as value from {sample}
union all select study_id, sample_id, 'subject' as attr, 2 as ord, subject as value from {sample}
union all select study_id, sample_id, 'batch' as attr, 3 as ord, batch as value from {sample}
union all select study_id, sample_id, 'site' as attr, 4 as ord, site as value from {sample}
union all select study_id, sample_id, 'organism' as attr, 5 as ord, 'species' as value from {sample}
union all select study_id, sample_id, 'title' as attr, 6 as ord, concat(condition, '_rep', cast(ord as string)) as value from {sample}
union all select concat('CU', cast(c_custkey % 5 as string)) as study_id, concat('C', cast(c_custkey as string)) as sample_id, 'treatment' as attr, 1 as ord, c_mktsegment as value from {customer}
union all select concat('CU', cast(c_custkey % 5 as string)) as study_id, concat('C', cast(c_custkey as string)) as sample_id, 'age' as attr, 2 as ord,
  case when c_custkey % 11 = 0 then 'n/a' else concat(cast(c_custkey % 4 + 6 as string), ' weeks') end as value from {customer}
union all select concat('CU', cast(c_custkey % 5 as string)) as study_id, concat('C', cast(c_custkey as string)) as sample_id, 'sex' as attr, 3 as ord,
  case c_custkey % 4 when 0 then 'Male' when 1 then 'female' when 2 then 'M' else 'unknown' end as value from {customer}""",
    "gene_set": """
select 'brand' as collection, p_brand as set_id, concat('F', cast(p_partkey % 200 as string)) as gene from {part} where p_partkey % 7 < 2 group by p_brand, p_partkey % 200
union all select 'type' as collection, p_type as set_id, concat('F', cast(p_partkey % 200 as string)) as gene from {part} where p_partkey % 5 = 0 group by p_type, p_partkey % 200""",
    "arm": """
select study_id, 'log_cpm' as method, feature_id, sample_id, log2(value * 1000000.0 / sum(value) over (partition by study_id, sample_id) + 1) as y from {measure}
union all select study_id, 'log_raw' as method, feature_id, sample_id, log2(value + 1.0) as y from {measure}""",
    "deg_raw": """
select a.study_id, a.method, a.feature_id, avg(y) as base_mean,
  avg(case when condition = 'treated' then y end) - avg(case when condition = 'control' then y end) as log2fc,
  ((count(case when condition = 'treated' then 1 end) - 1) * var_samp(case when condition = 'treated' then y end)
    + (count(case when condition = 'control' then 1 end) - 1) * var_samp(case when condition = 'control' then y end)) / (count(*) - 2)
    * (1.0 / count(case when condition = 'treated' then 1 end) + 1.0 / count(case when condition = 'control' then 1 end)) as se2
from {arm} a join {sample} s on a.study_id = s.study_id and a.sample_id = s.sample_id group by a.study_id, a.method, a.feature_id""",
    "deg": """
select study_id, 'treated_vs_control' as contrast_id, method, feature_id, round(base_mean, 6) as base_mean, round(log2fc, 6) as log2fc, round(log2fc / sqrt(se2), 6) as stat,
  round(exp(-abs(log2fc / sqrt(se2))), 9) as pvalue, round(least(1.0, 1.7 * exp(-abs(log2fc / sqrt(se2)))), 9) as padj
from {deg_raw} where se2 > 0""",
    "run_deg": """
select run_id, feature_id, round(log2((a + 1.0) / (b + 1.0)), 6) as log2fc, round((1.0 + (a * 7 + b * 3) % 97) / 100.0, 4) as padj
from (select concat('run', l_returnflag) as run_id, concat('F', cast(l_partkey % 200 as string)) as feature_id,
  cast(sum(case when l_suppkey % 2 = 1 then l_quantity else 0 end) as bigint) as a, cast(sum(case when l_suppkey % 2 = 0 then l_quantity else 0 end) as bigint) as b
  from {lineitem} group by l_returnflag, l_partkey % 200) t""",
    "gsea": """
select d.study_id, d.contrast_id, g.set_id, round(cast(sum(cast(round(d.stat * 1000000) as bigint)) as double) / count(*) / 1000000 + 1e-9, 5) as nes, round(exp(-abs(cast(sum(cast(round(d.stat * 1000000) as bigint)) as double) / count(*) / 1000000) * 2), 5) as fdr_q, count(*) as n_genes
from {deg} d join {gene_set} g on d.feature_id = g.gene where d.method = 'log_cpm' group by d.study_id, d.contrast_id, g.set_id""",
    "finding": """
select concat('ST', cast(l.doc_id % 2 as string)) as study_id, l.doc_id as finding_id,
  case when l.doc_id % 13 = 0 then concat('F', cast(l.doc_id % 200 as string), ' protein') else concat('F', cast(l.doc_id * 7 % 230 as string)) end as entity,
  case l.doc_id % 5 when 0 then 'protein' when 4 then 'pathway' when 3 then 'phenotype' else 'gene' end as entity_type,
  case when quality = 1 and toxic = 0 then 'up' when quality = 0 then 'down' when toxic = 1 then 'changed' else 'unchanged' end as direction,
  case l.doc_id % 3 when 0 then 'treated_vs_control' else 'other' end as comparison, concat('doc', cast(l.doc_id as string)) as source
from {labels} l""",
    "quote": "select d.doc_id as paper_id, b.item_id as quote_id, b.text as quote from {documents} d join {benchmark} b on d.doc_id % 40 = b.item_id % 40",
    "usage": """
select concat('run', cast(user_id % 20 as string)) as run_id, event_type as stage, value as wall_s, 1 as n_calls, 100 + event_id % 900 as in_tok, event_id % 300 as out_tok from {events}""",
    "decision": """
select conv_id as case_id, role as stage, turn as seq, case when length(text) % 3 = 0 then 'blocked' when length(text) % 3 = 1 then 'decided' else 'confirmed' end as decision_status,
  case when length(text) % 5 = 0 then 'failed' when length(text) % 7 = 0 then 'not_run' else 'completed' end as execution_status, case when length(text) % 11 = 0 then 'high' when length(text) % 2 = 0 then '0.7' else 'low' end as confidence
from {conversations}""",
    "claim": "select doc_id as claim_id, case when doc_id % 3 = 0 then 'primary' else 'secondary' end as importance from {labels}",
    "link": """
select claim_id, evidence_id, case when (claim_id + evidence_id) % 3 = 0 then 'supports' when (claim_id + evidence_id) % 3 = 1 then 'contradicts' else 'context' end as relation
from (select doc_id as claim_id, doc_id % 17 as evidence_id from {labels} where doc_id % 4 <> 1 union all select doc_id as claim_id, 20 + doc_id % 5 as evidence_id from {labels} where doc_id % 2 = 0) t""",
}
NAME = re.compile(r"\{([a-z_]\w*)\}")


@cache
def needs(name: str) -> tuple[str, ...]:
    """The views below a view, each after what it reads."""
    out: list[str] = []
    for x in NAME.findall(VIEWS[name]):
        if x in VIEWS:
            out += [y for y in (*needs(x), x) if y not in out]
    return tuple(out)


class Tables:
    """Tables and views as attributes; a view is planned when first asked for."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark, self.sf_dir, self.known = attach(spark), sf_dir, {}

    def __getattr__(self, name: str) -> DataFrame:
        if name in TABLES:
            df = self.spark.read.parquet(f"{self.sf_dir}/{name}.parquet")
        elif name in VIEWS:
            df = self.spark.sql(VIEWS[name], **{x: getattr(self, x) for x in dict.fromkeys(NAME.findall(VIEWS[name]))})
        else:
            raise AttributeError(name)
        self.known[name] = df
        setattr(self, name, df)
        return df


def with_views(sql: str) -> str:
    """``sql`` for DuckDB, with the views it names in braces defined before it."""
    names: list[str] = []
    for x in NAME.findall(sql):
        if x in VIEWS:
            names += [y for y in (*needs(x), x) if y not in names]
    plain = NAME.sub(r"\1", sql)
    if not names:
        return plain
    return "with " + ",\n".join(f"{x} as materialized ({NAME.sub(r'\1', VIEWS[x])})" for x in names) + f"\nselect * from (\n{plain}\n)"
