"""Aggregations: sample quality, pseudobulk, roll-ups to genes and proteins, summaries."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from assayloom.functions.columns import arm_of


def sample_qc(m: DataFrame, detection: float = 1) -> DataFrame:
    """Library size, detected features, median, maximum; a library under half of the study's median is flagged."""
    s = m.groupBy("study_id", "sample_id").agg(
        F.sum("value").alias("library_size"),
        F.count_if(F.col("value") >= detection).alias("detected"),
        F.percentile("value", F.lit(0.5)).alias("median"),
        F.max("value").alias("max"),
        (100.0 * F.count_if(F.col("value") >= detection) / F.count(F.lit(1))).alias("pct_detected"),
    )
    middle = F.percentile("library_size", F.lit(0.5)).over(Window.partitionBy("study_id"))
    return s.withColumn("low_library", F.col("library_size") < 0.5 * middle)


def pseudobulk(counts: DataFrame, cells: DataFrame, min_cells: int = 10) -> DataFrame:
    """Summed counts of each (cell type, sample, condition) with enough cells; the condition is in the name only where a sample has several."""
    groups = cells.groupBy("celltype", "sample_id", "condition").agg(F.count(F.lit(1)).alias("n_cells"))
    several = F.max("condition").over(Window.partitionBy("sample_id")) != F.min("condition").over(Window.partitionBy("sample_id"))
    name = F.when(several, F.concat_ws("__", "sample_id", "condition")).otherwise(F.col("sample_id"))
    kept = groups.withColumn("pb_id", name).where(F.col("n_cells") >= min_cells)
    return counts.join(cells, "cell_id").groupBy("celltype", "sample_id", "condition", "gene").agg(F.sum("value").alias("value")).join(kept, ["celltype", "sample_id", "condition"])


def dropped_groups(cells: DataFrame, min_cells: int = 10) -> DataFrame:
    return cells.groupBy("celltype", "sample_id", "condition").agg(F.count(F.lit(1)).alias("n_cells")).where(F.col("n_cells") < min_cells)


def eligible(cells: DataFrame, min_cells: int = 10, min_samples: int = 2) -> DataFrame:
    """Cell types with at least ``min_samples`` profiles in each of at least two conditions, and their complete donors."""
    groups = cells.groupBy("celltype", "sample_id", "condition").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= min_cells)
    arms = groups.groupBy("celltype", "condition").agg(F.count(F.lit(1)).alias("profiles"))
    per = arms.groupBy("celltype").agg(F.count(F.lit(1)).alias("n_arms"), F.min("profiles").alias("least"))
    donors = groups.groupBy("celltype", "sample_id").agg(F.countDistinct("condition").alias("c")).groupBy("celltype").agg(F.count_if(F.col("c") >= 2).alias("complete_donors"))
    return per.join(donors, "celltype").select("celltype", "n_arms", F.col("least").alias("least_profiles"), "complete_donors", ((F.col("n_arms") >= 2) & (F.col("least") >= min_samples)).alias("eligible"))


def tx_to_gene(m: DataFrame, mapping: DataFrame, how: str = "sum") -> DataFrame:
    """Values of transcripts gathered by gene; blank genes are dropped."""
    named = mapping.where("gene is not null and trim(gene) <> ''")
    return m.join(named, m["feature_id"] == named["transcript"]).groupBy("study_id", "gene", "sample_id").agg({"sum": F.sum, "mean": F.avg, "max": F.max}[how]("value").alias("value"))


def peptide_to_protein(p: DataFrame, how: str = "sum", shared: str = "exclude", min_peptides: int = 1, top_n: int = 3, scale: str = "linear") -> DataFrame:
    """Peptide values gathered by protein: groups split at ; or |, decoys and contaminants out, shared peptides excluded or exploded."""
    if how == "sum" and scale == "log2":
        raise ValueError("values on a log2 scale can't be summed")
    ids = F.array_distinct(F.filter(F.transform(F.split("protein_ids", "[;|]"), lambda x: F.trim(x)), lambda x: (x != "") & ~x.rlike("^(DECOY_|REV_|CON__|CONTAM_)")))
    rows = p.withColumn("ids", ids).where(F.size("ids") > 0)
    if shared == "exclude":
        rows = rows.where(F.size("ids") == 1)
    flat = rows.select("peptide", "sample_id", "value", F.explode("ids").alias("protein"))
    enough = flat.groupBy("protein").agg(F.countDistinct("peptide").alias("n_peptides")).where(F.col("n_peptides") >= min_peptides)
    if how == "top":
        w = Window.partitionBy("protein", "sample_id").orderBy(F.desc("value"), "peptide")
        flat, how = flat.withColumn("at", F.row_number().over(w)).where(F.col("at") <= top_n), "mean"
    agg = {"sum": F.sum("value"), "mean": F.avg("value"), "median": F.percentile("value", F.lit(0.5))}[how]
    return flat.groupBy("protein", "sample_id").agg(agg.alias("value")).join(enough, "protein")


def max_mean(rows: DataFrame, source: str = "row_id") -> DataFrame:
    """Of the source rows of a feature, the one with the highest mean; ties go to the first source."""
    means = rows.groupBy("study_id", "feature_id", source).agg(F.avg("value").alias("mean"))
    w = Window.partitionBy("study_id", "feature_id").orderBy(F.desc("mean"), source)
    return means.withColumn("at", F.row_number().over(w)).where("at = 1").drop("at")


def apply_threshold(d: DataFrame, metric: str = "padj", limit: float = 0.05, inclusive: bool = False, effect: float = 0.0) -> DataFrame:
    """Counts of tested and significant rows, up and down, for each contrast and method."""
    m = F.col(metric)
    hit = ((m <= limit) if inclusive else (m < limit)) & (F.abs("log2fc") >= effect)
    return d.groupBy("study_id", "contrast_id", "method").agg(
        F.count(m).alias("n_tested"), F.count_if(hit).alias("n_sig"), F.count_if(hit & (F.col("log2fc") > 0)).alias("n_up"), F.count_if(hit & (F.col("log2fc") < 0)).alias("n_down")
    )


def consensus(d: DataFrame, alpha: float = 0.05) -> DataFrame:
    """In how many methods each feature is significant, counted by contrast."""
    hits = d.groupBy("study_id", "contrast_id", "feature_id").agg(F.count_if(F.col("padj") < alpha).alias("hits"), F.countDistinct("method").alias("methods"))
    return hits.groupBy("study_id", "contrast_id").agg(
        F.max("methods").alias("n_methods"), F.count_if(F.col("hits") >= 1).alias("any"), F.count_if(F.col("hits") >= 2).alias("two_or_more"), F.count_if(F.col("hits") == F.col("methods")).alias("all")
    )


def level_counts(a: DataFrame) -> DataFrame:
    return a.groupBy("study_id", "attr", "value").agg(F.count(F.lit(1)).alias("n"))


def attribute_shape(a: DataFrame, most: int = 12) -> DataFrame:
    """constant, identifier, grouping or other, for each attribute of each study."""
    s = a.groupBy("study_id", "attr").agg(F.countDistinct("value").alias("levels"), F.count("value").alias("n"))
    kind = F.when(F.col("levels") <= 1, "constant").when(F.col("levels") == F.col("n"), "identifier").when(F.col("levels") <= most, "grouping").otherwise("other")
    return s.withColumn("shape", kind)


def even_values(a: DataFrame, k: int = 6) -> DataFrame:
    """``k`` values spread over the whole order of an attribute's distinct values."""
    d = a.select("study_id", "attr", "value").distinct()
    w = Window.partitionBy("study_id", "attr")
    r = d.withColumn("at", F.row_number().over(w.orderBy("value")) - 1).withColumn("n", F.count(F.lit(1)).over(w))
    step = F.floor(F.col("at") * (k - 1) / F.greatest(F.col("n") - 1, F.lit(1)))
    before = F.floor((F.col("at") - 1) * (k - 1) / F.greatest(F.col("n") - 1, F.lit(1)))
    return r.where((F.col("n") <= k) | (F.col("at") == 0) | (step != before)).select("study_id", "attr", "value")


def stage_ledger(usage: DataFrame, in_price: float = 0.25, out_price: float = 2.0) -> DataFrame:
    """Wall time, calls, tokens and cost by stage, with a TOTAL row."""
    cost = F.round((F.sum("in_tok") * in_price + F.sum("out_tok") * out_price) / 1e6, 4)
    return usage.rollup("stage").agg(F.round(F.sum("wall_s"), 2).alias("wall_s"), F.sum("n_calls").alias("calls"), F.sum("in_tok").alias("in_tok"), F.sum("out_tok").alias("out_tok"), cost.alias("usd")).withColumn(
        "stage", F.coalesce("stage", F.lit("TOTAL"))
    )


def usage_shares(usage: DataFrame) -> DataFrame:
    tokens = F.col("in_tok") + F.col("out_tok")
    s = usage.groupBy("run_id", "stage").agg(F.sum(tokens).alias("tokens"))
    return s.withColumn("share", F.round(F.col("tokens") / F.sum("tokens").over(Window.partitionBy("run_id")), 6))


def wilson(passed: Column, n: Column, z: float = 1.96) -> tuple[Column, Column]:
    """Score interval of a rate."""
    p = passed / n
    mid, half, down = p + z * z / (2 * n), z * F.sqrt(p * (1 - p) / n + z * z / (4 * n * n)), 1 + z * z / n
    return F.greatest(F.lit(0.0), (mid - half) / down), F.least(F.lit(1.0), (mid + half) / down)


def pass_rates(df: DataFrame, key: str, passed: Column) -> DataFrame:
    s = df.groupBy(key).agg(F.count(F.lit(1)).alias("n"), F.count_if(passed).alias("passed"))
    low, high = wilson(F.col("passed"), F.col("n"))
    return s.select(key, "n", "passed", F.round(low, 6).alias("low"), F.round(high, 6).alias("high"))


def grouping_columns(a: DataFrame, most: int = 10) -> DataFrame:
    """Attributes with 2 to ``most`` levels and their values."""
    return (
        a.where("value is not null").groupBy("study_id", "attr").agg(F.array_sort(F.collect_set("value")).alias("v")).where(F.size("v").between(2, most)).select("study_id", "attr", F.size("v").cast("long").alias("n_levels"), F.array_join("v", ";").alias("levels"))
    )


def descriptor(a: DataFrame) -> DataFrame:
    """Distinct sorted values of each attribute, joined."""
    return a.where("value is not null").groupBy("study_id", "attr").agg(F.array_join(F.array_sort(F.collect_set("value")), "; ").alias("descriptor"))


def first_values(a: DataFrame) -> DataFrame:
    """The first value that isn't blank, in the order of samples, of each attribute of each study."""
    from assayloom.functions.columns import is_blank

    return a.where(~is_blank("value")).groupBy("study_id", "attr").agg(F.min_by("value", "sample_id").alias("first_value"))


def arms(a: DataFrame, attr: str = "title") -> DataFrame:
    """Arms of each study by the titles of its samples without replicate numbers."""
    return a.where(F.col("attr") == attr).groupBy("study_id", arm_of(F.col("value")).alias("arm")).agg(F.count(F.lit(1)).alias("n"))


def arm_balance(arms: DataFrame, least: int = 2, most: float = 2.0) -> DataFrame:
    """Whether the arms of a study are two or more, large enough and not too unlike in size."""
    g = arms.groupBy("study_id").agg(F.count(F.lit(1)).alias("n_arms"), F.min("n").alias("least"), F.max("n").alias("most"))
    return g.withColumn("balanced", (F.col("n_arms") >= 2) & (F.col("least") >= least) & (F.col("most") <= F.col("least") * most))
