"""Result tables: ranking, multiple testing, selections, joins of results."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from assayloom.functions.columns import bh

KEYS = ("study_id", "contrast_id", "method")


def first_by(df: DataFrame, keys: list[str], *order: Column | str) -> DataFrame:
    """The first row of each group; orders should end in a key, so that there are no ties."""
    w = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn("__at", F.row_number().over(w)).where("__at = 1").drop("__at")


def first_n(df: DataFrame, keys: list[str], n: int, *order: Column | str) -> DataFrame:
    w = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn("place", F.row_number().over(w).cast("long")).where(F.col("place") <= n)


def adjusted(d: DataFrame, p: str = "pvalue") -> DataFrame:
    """Benjamini-Hochberg q: the reverse cumulative minimum of p * m / rank within each contrast and method."""
    raw = d.withColumn("raw", bh(F.col(p), *KEYS))
    # a running minimum from the largest p down, ties together; a frame that ends at the last row would be gone through again for each row
    w = Window.partitionBy(*KEYS).orderBy(F.col(p).desc_nulls_first()).rangeBetween(Window.unboundedPreceding, Window.currentRow)
    return raw.withColumn("q", F.when(F.col(p).isNotNull(), F.min("raw").over(w))).drop("raw")


def average_rank(df: DataFrame, keys: list[str], by: str) -> DataFrame:
    """Ranks from 1, ties at their mean."""
    w = Window.partitionBy(*keys)
    return df.withColumn("avg_rank", F.rank().over(w.orderBy(by)) + (F.count(F.lit(1)).over(Window.partitionBy(*keys, by)) - 1) / 2)


def top_deg(d: DataFrame, n: int = 50) -> DataFrame:
    return first_n(d, list(KEYS), n, F.coalesce("padj", F.lit(1.0)), "pvalue", "feature_id")


def strongest(d: DataFrame, mapping: DataFrame, metric: str = "stat") -> DataFrame:
    """The row with the largest absolute metric of each mapped symbol."""
    return first_by(mapped(d, mapping), ["study_id", "method", "gene"], F.desc(F.abs(metric)), "feature_id")


def most_significant(d: DataFrame, mapping: DataFrame) -> DataFrame:
    return first_by(mapped(d, mapping), ["study_id", "method", "gene"], F.col("padj").asc_nulls_last(), "feature_id")


def mapped(d: DataFrame, mapping: DataFrame) -> DataFrame:
    """Rows whose feature has a gene; '', nan, NA and --- count as none."""
    named = mapping.where(~F.trim("gene").isin("", "nan", "NA", "---") & F.col("gene").isNotNull())
    return d.join(named, d["feature_id"] == named["transcript"]).drop("transcript")


def map_report(d: DataFrame, mapping: DataFrame) -> DataFrame:
    named = mapping.where(~F.trim("gene").isin("", "nan", "NA", "---"))
    j = d.join(named, d["feature_id"] == named["transcript"], "left")
    return j.groupBy("study_id", "method").agg(F.count("gene").alias("n_mapped"), F.count_if(F.col("gene").isNull()).alias("n_unmapped"), F.countDistinct("gene").alias("n_genes"))


collapse_genes = strongest


def study_summary(d: DataFrame, alpha: float, strong: float) -> DataFrame:
    return d.groupBy("study_id").agg(
        F.countDistinct("method").alias("n_methods"), F.count(F.lit(1)).alias("n_rows"), F.count_if(F.col("padj") < alpha).alias("n_sig"), F.bool_or(F.col("padj") < strong).alias("any_strong"), F.array_join(F.array_sort(F.collect_set("method")), ";").alias("methods")
    )


def gene_rows(d: DataFrame, mapping: DataFrame, alpha: float = 0.05, most: int = 250) -> DataFrame:
    """Significant genes of each result, best first, one row for each symbol and contrast, numbered by study."""
    hits = first_n(mapped(d, mapping).where(F.col("padj") < alpha), list(KEYS), most, "padj", F.desc(F.abs("log2fc")), "feature_id")
    once = first_by(hits, ["study_id", "contrast_id", "gene"], "padj", F.desc(F.abs("log2fc")), "method", "feature_id")
    at = F.row_number().over(Window.partitionBy("study_id").orderBy("contrast_id", "gene"))
    return once.select("study_id", "contrast_id", "gene", "method", "log2fc", "padj", F.format_string("%s_gene%d", "study_id", at).alias("gene_id"))


def side_by_side(d: DataFrame, methods: list[str]) -> DataFrame:
    return d.groupBy("study_id", "contrast_id", "feature_id").pivot("method", methods).agg(F.first("log2fc").alias("log2fc"), F.first("padj").alias("padj"))


def concordance_of_methods(d: DataFrame, least: int = 10) -> DataFrame:
    a, b = (d.select("study_id", "contrast_id", "feature_id", F.col("method").alias(f"method_{x}"), F.col("log2fc").alias(f"fc_{x}")) for x in "ab")
    j = a.join(b, ["study_id", "contrast_id", "feature_id"]).where("method_a < method_b")
    return j.groupBy("study_id", "contrast_id", "method_a", "method_b").agg(F.count(F.lit(1)).alias("n"), F.corr("fc_a", "fc_b").alias("r")).where(F.col("n") >= least)


def merge_ranges(ranges: DataFrame, keys: list[str]) -> DataFrame:
    """Overlapping or touching (start, end) ranges of a key as one, by gaps and islands.

    An island is told at its last row, by running values in one order: one shuffle, one sort and no hash table of islands.
    """
    w = Window.partitionBy(*keys).orderBy("start", "end")
    upto, c = w.rowsBetween(Window.unboundedPreceding, 0), F.col
    before = F.max("end").over(w.rowsBetween(Window.unboundedPreceding, -1))
    rows = ranges.select(*keys, "start", "end", before.alias("before"), F.lag("start").over(w).alias("last"), F.row_number().over(w).alias("at"))
    new = F.coalesce(c("before").isNull() | (c("start") > c("before")), F.lit(False))
    rows = rows.select(*keys, "start", "end", "last", "at", new.alias("new"))
    # the first start of an island that isn't null, its first place, and whether the next row opens another
    begin, first = F.last(F.when(c("new") | c("last").isNull(), c("start")), ignorenulls=True).over(upto), F.last(F.when(c("new"), c("at")), ignorenulls=True).over(upto)
    rows = rows.select(*keys, "start", "end", "at", begin.alias("begin"), first.alias("first"), F.lead("new", 1, True).over(w).alias("closes"))
    # firsts never decrease, so the largest pair has the largest end of this island
    most = F.max(F.struct("first", "end")).over(upto)
    done = rows.select(*keys, "begin", "at", "first", "closes", most["end"].alias("end")).where("closes")
    return done.select(*keys, c("begin").alias("start"), "end", (c("at") - c("first") + 1).cast("long").alias("n"))


def stratified_subsets(s: DataFrame, runs: int = 3, fraction: float = 0.8, least: int = 2, seed: int = 42) -> DataFrame:
    """Per study and arm max(least, floor(fraction * n)) samples, drawn by a hash for each run."""
    rows = s.select("*", F.explode(F.sequence(F.lit(1), F.lit(runs))).alias("run"))
    w = Window.partitionBy("study_id", "condition", "run")
    at = F.row_number().over(w.orderBy(F.md5(F.concat_ws("|", F.lit(seed), "run", "study_id", "sample_id")), "sample_id"))
    n = F.count(F.lit(1)).over(w)
    return rows.withColumn("at", at).withColumn("n", n).where(F.col("at") <= F.greatest(F.lit(least), F.floor(F.col("n") * fraction))).select("study_id", "condition", "run", "sample_id")
