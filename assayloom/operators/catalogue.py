"""Catalogue tables with stable ids, provenance and foreign keys, and the edge table of the knowledge graph."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from assayloom.operators.results import first_by

#: Roles of attributes, by exact name and then by what a name contains, in order.
ROLES = (("sex", ("sex", "gender")), ("age", ("age",)), ("group", ("treatment", "condition", "group", "arm")), ("subject", ("subject", "individual", "donor", "patient")), ("organism", ("organism", "species")), ("title", ("title",)))


def roles(a: DataFrame) -> DataFrame:
    """The attribute that plays each role in each study: an exact name first, then a name that contains it."""
    d = a.groupBy("study_id", "attr").agg(F.min("ord").alias("ord"))
    rows = []
    for k, (role, names) in enumerate(ROLES):
        for j, name in enumerate(names):
            for exact in (True, False):
                hit = (F.lower("attr") == name) if exact else F.lower("attr").contains(name)
                rows.append(F.when(hit, F.struct(F.lit(role).alias("role"), F.lit(k * 100 + j + (0 if exact else 50)).alias("priority"))))
    flat = d.select("study_id", "attr", "ord", F.inline(F.array_compact(F.array(*rows))))
    return first_by(flat, ["study_id", "role"], "priority", "ord", "attr").select("study_id", "role", "attr")


def groups(a: DataFrame, attr: str) -> DataFrame:
    """One row for each level of an attribute with an id that follows the order of levels."""
    n = a.where((F.col("attr") == attr) & F.col("value").isNotNull()).groupBy("study_id", F.col("value").alias("label")).agg(F.count(F.lit(1)).alias("n_samples"))
    at = F.row_number().over(Window.partitionBy("study_id").orderBy("label"))
    return n.select("study_id", F.format_string("%s_grp%d", "study_id", at).alias("group_id"), "label", "n_samples", F.lit(attr).alias("label_source"))


def samples(a: DataFrame, group_attr: str, subject_attr: str) -> DataFrame:
    """Samples with ids and the keys of their group and subject."""
    wide = a.where(F.col("attr").isin(group_attr, subject_attr)).groupBy("study_id", "sample_id").pivot("attr", [group_attr, subject_attr]).agg(F.first("value"))
    at = F.row_number().over(Window.partitionBy("study_id").orderBy("sample_id"))
    sub = F.dense_rank().over(Window.partitionBy("study_id").orderBy(subject_attr))
    g = groups(a, group_attr).select("study_id", F.col("label").alias(group_attr), "group_id")
    rows = wide.select("*", F.format_string("%s_samp%d", "study_id", at).alias("sample_key"), F.when(F.col(subject_attr).isNotNull(), F.format_string("%s_sub%d", "study_id", sub)).alias("subject_id"))
    return rows.join(g, ["study_id", group_attr], "left").select("study_id", "sample_key", "sample_id", "group_id", "subject_id")


def resolve_groups(analysis: DataFrame, g: DataFrame, label: str) -> DataFrame:
    """The group id of a label, NULL where none matches."""
    key = g.select("study_id", F.lower(F.trim("label")).alias("__key"), "group_id")
    return analysis.withColumn("__key", F.lower(F.trim(label))).join(key, ["study_id", "__key"], "left").drop("__key")


def flatten_sourced(rows: DataFrame) -> DataFrame:
    """Structs {value, source} as two columns each, after the plain columns."""
    out: list[Column] = []
    for f in rows.schema:
        names = getattr(f.dataType, "names", None)
        out += [F.col(f"{f.name}.value").alias(f.name), F.col(f"{f.name}.source").alias(f"{f.name}_source")] if names and set(names) == {"value", "source"} else [F.col(f.name)]
    return rows.select(*out)


def finding_rows(f: DataFrame) -> DataFrame:
    """One gene row for each entity and study, numbered by entity."""
    genes = f.where(F.col("entity_type").isin("gene", "protein") & ~F.col("entity").contains(" "))
    once = first_by(genes, ["study_id", "entity"], "finding_id")
    at = F.row_number().over(Window.partitionBy("study_id").orderBy("entity"))
    return once.select("study_id", F.format_string("%s_gene%d", "study_id", at).alias("gene_id"), F.col("entity").alias("symbol"), "direction", F.col("source").alias("symbol_source"))


def study_of(c: Column) -> Column:
    """The study in the id of one of its rows."""
    return F.regexp_extract(c, r"^(.*?)_(exp|grp|samp|gene|enr|sub)\d+$", 1)


def reconciliation(agreement: DataFrame) -> DataFrame:
    """One row a study: verdicts with their numbers, and the disagreements."""
    v = agreement.groupBy("study_id", "verdict").agg(F.count(F.lit(1)).alias("n"))
    said = F.array_join(F.array_sort(F.collect_list(F.format_string("%s=%d", "verdict", "n"))), ";")
    return v.groupBy("study_id").agg(said.alias("breakdown"), F.sum("n").alias("n_findings"), F.coalesce(F.sum(F.when(F.col("verdict") == "contradicted", F.col("n"))), F.lit(0)).alias("n_disagree"))


def manifest(studies: DataFrame, counts: dict[str, DataFrame]) -> DataFrame:
    """One row a study with its number of rows in each table."""
    out = studies
    for name, t in counts.items():
        out = out.join(t.groupBy("study_id").agg(F.count(F.lit(1)).alias(name)), "study_id", "left").withColumn(name, F.coalesce(name, F.lit(0)))
    return out


def kg_edges(genes: DataFrame, contexts: DataFrame, best_set: DataFrame, findings: DataFrame) -> DataFrame:
    """Edges study -> gene with direction, context and the study's best set; claims of the text alone come after, marked so."""
    word = lambda d: F.when(d == "up", "upregulates").when(d == "down", "downregulates").otherwise("changes")
    data = genes.select("study_id", F.col("gene").alias("object"), word(F.when(F.col("log2fc") > 0, "up").otherwise("down")).alias("predicate"), F.lit("data").alias("origin"))
    claims = findings.where(F.col("entity_type").isin("gene", "protein")).select("study_id", F.col("entity").alias("object"), word(F.col("direction")).alias("predicate")).distinct()
    only = claims.join(data.select("study_id", "object"), ["study_id", "object"], "left_anti").withColumn("origin", F.lit("text"))
    return data.distinct().unionByName(only).join(contexts, "study_id", "left").join(best_set, "study_id", "left")


def result_rows(d: DataFrame) -> DataFrame:
    """Analysis rows of the results there are: one a study, contrast and method, numbered."""
    n = d.groupBy("study_id", "contrast_id", "method").agg(F.count(F.lit(1)).alias("n_features"))
    at = F.row_number().over(Window.partitionBy("study_id").orderBy("contrast_id", "method"))
    return n.select("study_id", F.format_string("%s_ana%d", "study_id", at).alias("analysis_id"), "contrast_id", "method", "n_features")


def inherit(children: DataFrame, parents: DataFrame, fields: list[str]) -> DataFrame:
    """Rows of split studies with the fields they lack taken from their parent."""
    p = parents.select(F.col("study_id").alias("parent_id"), *(F.col(f).alias(f"__{f}") for f in fields))
    return children.join(p, "parent_id", "left").select(*(F.coalesce(c, f"__{c}").alias(c) if c in fields else F.col(c) for c in children.columns))


def scaffold(needed: DataFrame, there: DataFrame, prefix: str) -> DataFrame:
    """Rows for studies that have none in a table yet."""
    return needed.select("study_id").distinct().join(there.select("study_id").distinct(), "study_id", "left_anti").select("study_id", F.concat("study_id", F.lit(f"_{prefix}1")).alias("id"), F.lit("scaffold").alias("source"))


def flatten_extraction(papers: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Study, group and subject rows of nested extractions (study_id, groups array<struct<label, n>>, subjects array<struct<name, group>>).

    Groups and subjects are one for each label without regard to case and spaces, numbered by label; subjects point to their group or to 0.
    """
    norm = lambda c: F.lower(F.trim(c))
    g = papers.select("study_id", F.inline("groups")).withColumn("key", norm(F.col("label")))
    g = first_by(g, ["study_id", "key"], F.desc("n"), "label")
    g = g.withColumn("group_id", F.format_string("%s_grp%d", "study_id", F.row_number().over(Window.partitionBy("study_id").orderBy("key"))))
    s = papers.select("study_id", F.inline("subjects")).withColumn("who", norm(F.col("name"))).withColumn("key", norm(F.col("group")))
    s = first_by(s, ["study_id", "who"], "key", "name").join(g.select("study_id", "key", "group_id"), ["study_id", "key"], "left")
    s = s.withColumn("subject_id", F.format_string("%s_sub%d", "study_id", F.row_number().over(Window.partitionBy("study_id").orderBy("who"))))
    studies = papers.groupBy("study_id").agg(F.count(F.lit(1)).alias("n_extractions"))
    return studies, g.select("study_id", "group_id", "label", "n"), s.select("study_id", "subject_id", "name", F.coalesce("group_id", F.lit("0")).alias("group_id"))


def exercise_rows(interventions: DataFrame, terms: str) -> DataFrame:
    """Interventions (study_id, ord, material, kind, dose, unit) whose material or kind is an exercise, numbered, with their parameters joined."""
    hit = F.lower(F.concat_ws(" ", "material", "kind")).rlike(terms)
    at = F.row_number().over(Window.partitionBy("study_id").orderBy("ord"))
    return interventions.where(hit).select("study_id", F.format_string("%s_ex%d", "study_id", at).alias("exercise_id"), "material", F.concat_ws(" ", F.col("dose").cast("string"), "unit").alias("parameters"))
