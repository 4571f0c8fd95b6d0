"""Alignment and matching joins."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from assayloom.operators.results import first_by


def align(columns: DataFrame, samples: DataFrame, key: str) -> DataFrame:
    """Coverage by study of an exact join of matrix columns (study_id, sample_id) with one key column; keys that repeat don't match."""
    unique = samples.where(F.col(key).isNotNull()).groupBy("study_id", key).agg(F.count(F.lit(1)).alias("c")).where("c = 1").select("study_id", F.col(key).alias("sample_id"))
    m = columns.select("study_id", "sample_id").distinct()
    both = m.withColumn("in_matrix", F.lit(1)).join(unique.withColumn("in_meta", F.lit(1)), ["study_id", "sample_id"], "full_outer")
    hit = F.col("in_matrix").isNotNull() & F.col("in_meta").isNotNull()
    return both.groupBy("study_id").agg(
        F.count_if(hit).alias("n_matched"),
        F.count_if(F.col("in_meta").isNull()).alias("n_matrix_only"),
        F.count_if(F.col("in_matrix").isNull()).alias("n_meta_only"),
        F.round(F.count_if(hit) / F.greatest(F.lit(1), F.count("in_matrix")), 6).alias("coverage"),
    )


def alignment_keys(columns: DataFrame, attrs: DataFrame) -> DataFrame:
    """For every attribute how many of a study's matrix columns its values name."""
    m = columns.select("study_id", F.col("sample_id").alias("value")).distinct()
    n = m.groupBy("study_id").agg(F.count(F.lit(1)).alias("n_columns"))
    hits = attrs.select("study_id", "attr", "value").distinct().join(m, ["study_id", "value"]).groupBy("study_id", "attr").agg(F.count(F.lit(1)).alias("n_matched"))
    return hits.join(n, "study_id").withColumn("share", F.round(F.col("n_matched") / F.col("n_columns"), 6))


def contained_keys(columns: DataFrame, attrs: DataFrame) -> DataFrame:
    """Attribute values that hold exactly one sample name as a whole token."""
    m = columns.select("study_id", F.lower("sample_id").alias("token"), "sample_id").distinct()
    tokens = attrs.select("study_id", "attr", F.col("sample_id").alias("row_id"), F.explode(F.array_distinct(F.split(F.lower("value"), "[^a-z0-9]+"))).alias("token"))
    hits = tokens.join(m, ["study_id", "token"]).groupBy("study_id", "attr", "row_id").agg(F.countDistinct("sample_id").alias("c"), F.min("sample_id").alias("matrix_column"))
    return hits.where("c = 1").drop("c")


def restrict(attrs: DataFrame, columns: DataFrame) -> DataFrame:
    """Samples of each study kept by its matrix, with a verdict."""
    m = columns.select("study_id", "sample_id", F.lit(1).alias("there")).distinct()
    s = attrs.select("study_id", "sample_id").distinct().join(m, ["study_id", "sample_id"], "left")
    c = s.groupBy("study_id").agg(F.count("there").alias("n_kept"), F.count(F.lit(1)).alias("n_meta"))
    return c.withColumn("verdict", F.when(F.col("n_kept") == 0, "no_overlap").when(F.col("n_kept") < F.col("n_meta"), "subset").otherwise("complete"))


def marker_rows(m: DataFrame, symbols: list[str]) -> DataFrame:
    """Rows of the first feature that equals a symbol without regard to case."""
    wanted = m.sparkSession.createDataFrame([(s, s.lower()) for s in symbols], "symbol string, low string")
    hits = m.select("study_id", "feature_id").distinct().withColumn("low", F.lower("feature_id")).join(wanted, "low")
    return first_by(hits, ["study_id", "symbol"], "feature_id").select("study_id", "symbol", "feature_id")


def symbol_candidates(entity):
    """Symbols that an entity's name may stand for: the name and, after a species prefix of one small letter, the rest; none for several words."""
    text = F.trim(entity)
    return F.when(text.rlike(r"\s") | (text == ""), F.array().cast("array<string>")).otherwise(F.array_distinct(F.array(text, F.regexp_replace(text, r"^[hmr](?=[A-Z])", ""))))


def match_findings(findings: DataFrame, d: DataFrame) -> DataFrame:
    """The most significant result over all contrasts for any candidate symbol of each finding; NULL where there is none."""
    gene = F.lower(F.trim("entity_type")).isin("gene", "protein")
    f = findings.withColumn("candidates", F.when(gene, symbol_candidates(F.col("entity"))).otherwise(F.array().cast("array<string>")))
    flat = f.select("study_id", "finding_id", F.explode("candidates").alias("feature_id"))
    hits = flat.join(d.select("study_id", "contrast_id", "method", "feature_id", "log2fc", "padj"), ["study_id", "feature_id"])
    best = first_by(hits, ["study_id", "finding_id"], F.coalesce("padj", F.lit(1.0)), "contrast_id", "method", "feature_id")
    return f.join(best.withColumnRenamed("feature_id", "our_symbol"), ["study_id", "finding_id"], "left")


def agreement(findings: DataFrame, d: DataFrame, alpha: float = 0.05) -> DataFrame:
    """Verdict of each finding against the results."""
    m = match_findings(findings, d)
    said, sig = F.lower(F.trim("direction")), F.coalesce(F.col("padj") < alpha, F.lit(False))
    ours = F.when(F.col("log2fc") > 0, "up").otherwise("down")
    directed = F.when(sig & (ours == said), "confirmed").when(sig, "contradicted").when(ours == said, "direction_only").otherwise("not_detected")
    verdict = (
        F.when(F.size("candidates") == 0, "not_checkable")
        .when(F.col("our_symbol").isNull(), "not_in_results")
        .when(said.isin("up", "down"), directed)
        .when(said == "unchanged", F.when(sig, "contradicted").otherwise("confirmed"))
        .otherwise(F.when(sig, "confirmed_change").otherwise("not_detected"))
    )
    return m.select("study_id", "finding_id", "entity", "direction", "our_symbol", "log2fc", "padj", verdict.alias("verdict"))


def uncovered(findings: DataFrame, d: DataFrame, alpha: float) -> DataFrame:
    """Findings on genes that no significant result of the study covers."""
    covered = d.where(F.col("padj") < alpha).select("study_id", F.col("feature_id").alias("entity")).distinct()
    return findings.where(F.col("entity_type").isin("gene", "protein")).join(covered, ["study_id", "entity"], "left_anti")


def chain(g: DataFrame, sizes: DataFrame, arms: DataFrame, limit: float) -> DataFrame:
    """Significant sets with their size and both arms of the study's contrast, one row each."""
    c, x = (arms.where(F.col("condition") == v).select("study_id", F.col("n").alias(f"n_{v}")) for v in ("control", "treated"))
    return g.where(F.col("fdr_q") < limit).join(sizes, "set_id").join(c, "study_id").join(x, "study_id")


def latest(log: DataFrame, keys: list[str], at: str, *values: str) -> DataFrame:
    """The last row written for each key."""
    return log.groupBy(*keys).agg(*(F.max_by(v, at).alias(v) for v in values))


def best_phenotype(genes: DataFrame, findings: DataFrame) -> DataFrame:
    """A phenotype finding for each gene row: of the same comparison first, else the first of the study."""
    p = findings.where("entity_type = 'phenotype'").select("study_id", "finding_id", F.col("entity").alias("phenotype"), "comparison")
    j = genes.join(p, "study_id", "left").withColumn("same", F.coalesce((F.col("comparison") == F.col("contrast_id")).cast("int"), F.lit(0)))
    return first_by(j, ["study_id", "gene_id"], F.desc("same"), "finding_id").select("study_id", "gene_id", "phenotype", "finding_id")


def sex_triage(calls: DataFrame, said: DataFrame) -> DataFrame:
    """Inferred against recorded sex: only a confident difference is a mismatch; the resolved sex is the recorded one, else the inferred."""
    j = calls.select("study_id", "sample_id", F.col("sex").alias("inferred"), "confidence").join(said.select("study_id", "sample_id", F.col("sex").alias("recorded")), ["study_id", "sample_id"], "left")
    differs = F.col("recorded").isNotNull() & (F.col("inferred") != "ambiguous") & (F.col("recorded") != F.col("inferred"))
    status = F.when(F.col("recorded").isNull(), "not_recorded").when(differs & (F.col("confidence") == "high"), "mismatch").when(differs, "check").otherwise("agrees")
    return j.select("study_id", "sample_id", "inferred", "recorded", status.alias("status"), F.coalesce("recorded", F.when(F.col("inferred") != "ambiguous", F.col("inferred"))).alias("resolved"))


#: Ensembl gene ids, gene symbols, and parts of the names of columns that hold symbols.
ENSEMBL, SYMBOL, SYMBOL_COLUMNS = r"(?i)^ENS[A-Z]*G\d{6,}", r"^[A-Za-z][A-Za-z0-9._-]*$", r"(?i)gene_name|symbol|genename"


def id_bridge(ids: DataFrame, notes: DataFrame, genes: DataFrame) -> DataFrame:
    """The gene symbol, in capitals, of each feature id (study_id, feature_id); ids without one give no row.

    A study without Ensembl ids and plain numbers has symbols already. Where more than half are Ensembl ids, ``genes`` (ensembl, symbol;
    ids without version) names them. Else the annotations of the count table, ``notes`` (study_id, feature_id, column, place, value),
    name them: by the first column of which more than 0.7 look like symbols, columns named so before others, else through the first
    column of which more than half are Ensembl ids. All rows of a study decide, not the first ones. An id with several annotations takes
    the smallest. NULL ids and values don't count.
    """
    ensembl = lambda c: c.rlike(ENSEMBL)
    stem = lambda c: F.split_part(c, F.lit("."), F.lit(1))
    ids = ids.where(F.col("feature_id").isNotNull()).select("study_id", "feature_id").distinct()
    e, number = ensembl(F.col("feature_id")), F.col("feature_id").rlike(r"^\d+$")
    kind = F.when(F.count_if(e | number) == 0, "symbol").when(F.count_if(e) > 0.5 * F.count(F.lit(1)), "ensembl").otherwise("notes")
    kinds = ids.groupBy("study_id").agg(kind.alias("kind"))
    known = ids.join(kinds, "study_id")
    named = genes.where(F.col("symbol").isNotNull()).groupBy("ensembl").agg(F.upper(F.min("symbol")).alias("symbol"))
    v = F.col("value")
    cells = notes.where(v.isNotNull()).join(kinds.where("kind = 'notes'").select("study_id"), "study_id")
    rates = cells.groupBy("study_id", "column").agg(F.min("place").alias("place"), F.avg((v.rlike(SYMBOL) & ~ensembl(v)).cast("int")).alias("symbols"), F.avg(ensembl(v).cast("int")).alias("ensembls"))
    order = F.struct(F.when(F.col("symbols") > 0.7, 0).otherwise(1).alias("a"), F.when((F.col("symbols") > 0.7) & F.col("column").rlike(SYMBOL_COLUMNS), 0).otherwise(1).alias("b"), "place", "column")
    chosen = rates.where("symbols > 0.7 or ensembls > 0.5").groupBy("study_id").agg(F.min_by(F.struct("column", (F.col("symbols") > 0.7).alias("direct")), order).alias("c")).select("study_id", "c.*")
    told = cells.join(chosen, ["study_id", "column"]).groupBy("study_id", "feature_id", "direct").agg(F.min("value").alias("value"))
    told = known.where("kind = 'notes'").join(told, ["study_id", "feature_id"])
    through = known.where("kind = 'ensembl'").select("study_id", "feature_id", stem(F.col("feature_id")).alias("ensembl")).union(told.where(~F.col("direct") & ensembl(v)).select("study_id", "feature_id", stem(v).alias("ensembl")))
    out = known.where("kind = 'symbol'").select("study_id", "feature_id", F.upper("feature_id").alias("symbol"))
    out = out.union(told.where("direct").select("study_id", "feature_id", F.upper("value").alias("symbol")))
    return out.union(through.join(named, "ensembl").select("study_id", "feature_id", "symbol"))
