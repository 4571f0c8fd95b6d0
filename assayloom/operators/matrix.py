"""Typing, gates and value transforms of long-form measures (study_id, feature_id, sample_id, value)."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from assayloom.functions.tables import once

INTEGER, LOG_MAX, RAW_MAX = 0.99, 50.0, 100.0
#: Kinds of identifiers, first match wins.
ID_PATTERNS = (
    ("ensembl_gene", r"^ENS[A-Z]*G\d{11}(\.\d+)?$"),
    ("ensembl_transcript", r"^ENS[A-Z]*T\d{11}(\.\d+)?$"),
    ("ensembl_protein", r"^ENS[A-Z]*P\d{11}(\.\d+)?$"),
    ("refseq", r"^[NX][MRP]_\d+(\.\d+)?$"),
    ("affy_probe", r"(?i)^[\w.-]*_(s_|x_|a_|i_|f_|r_|g_)?at$|(?i)^\d+_st$"),
    ("illumina_probe", r"^ILMN_\d+$"),
    ("agilent_probe", r"^A_\d+_P\d+$"),
    ("cpg_probe", r"(?i)^(cg|ch\.)\d+"),
    ("genomic_region", r"(?i)^(chr)?[\dXYMT]{1,2}[:_-]\d+"),
    ("uniprot", r"^([OPQ]\d[A-Z\d]{3}\d|[A-NR-Z]\d([A-Z][A-Z\d]{2}\d){1,2})(-\d+)?([;|].*)?$"),
    ("entrez", r"^\d+$"),
    ("gene_symbol", r"^[A-Za-z][A-Za-z0-9.\-]{0,19}$"),
)


def profile(m: DataFrame) -> DataFrame:
    """One row a study: size, range, median, share of integers (absolute tolerance 1e-8), negatives and missing values.

    Values are counted before they are summed up, apart from the names: a median beside distinct counts would sort every row three times.
    """
    v = F.when(~F.isnan(F.col("value").cast("double")), F.col("value").cast("double"))
    m = once(m.select("study_id", "feature_id", "sample_id", v.alias("v")))
    names = m.groupBy("study_id").agg(F.countDistinct("feature_id").alias("n_features"), F.countDistinct("sample_id").alias("n_samples"))
    v, n, there = F.col("v"), F.col("n"), F.when(F.col("v").isNotNull(), F.col("n")).otherwise(0)
    values = m.groupBy("study_id", "v").agg(F.count(F.lit(1)).alias("n")).groupBy(F.col("study_id").alias("study")).agg(
        F.sum(there).alias("n_values"),
        F.sum(n - there).alias("n_missing"),
        F.min(v).alias("min_value"),
        F.max(v).alias("max_value"),
        F.percentile(v, F.lit(0.5), n).alias("median"),
        (F.sum(F.when(F.abs(v - F.rint(v)) <= 1e-8, n).when(v.isNotNull(), 0)) / F.sum(F.when(v.isNotNull(), n))).alias("integer_fraction"),
        F.sum(F.when(v < 0, n).when(v.isNotNull(), 0)).alias("n_negative"),
    )
    return names.join(values, F.col("study_id").eqNullSafe(F.col("study"))).drop("study")


def type_candidates(p: DataFrame) -> DataFrame:
    """Types that fit a profile, in fixed order; nothing is chosen."""
    low, high, whole = F.col("min_value"), F.col("max_value"), F.col("integer_fraction")
    small = F.col("n_negative") / F.col("n_values")
    logs = F.when(high <= LOG_MAX, F.when((low >= 0) | ((small < 0.01) & (F.col("median") > 1)), "log_scale").otherwise("signed_log_scale"))
    found = F.array(
        F.when((low >= 0) & (whole >= INTEGER), "raw_counts"), F.when((low >= 0) & (high <= 1), "proportion"), F.when((whole < INTEGER) & (low >= 0) & (high > LOG_MAX), "linear_normalized"), logs
    )
    return p.select("study_id", F.array_join(F.array_compact(found), ";").alias("candidates"))


def method_gate(p: DataFrame, methods=("deseq2", "edger", "limma-voom", "limma")) -> DataFrame:
    """Whether each method may take each study's matrix, and why not: the first reason."""
    counts = (
        F.when(F.col("n_values") != F.col("n_features") * F.col("n_samples"), "incomplete")
        .when(F.col("min_value") < 0, "negative values")
        .when(F.col("integer_fraction") < INTEGER, "not integer counts")
    )
    plain = F.when((F.col("integer_fraction") >= INTEGER) & (F.col("max_value") > RAW_MAX), "raw counts").when(F.col("max_value") > LOG_MAX, "linear scale")
    rows = p.select("*", F.explode(F.array(*map(F.lit, methods))).alias("method"))
    reason = F.when(F.col("method") == "limma", plain).otherwise(counts)
    return rows.select("study_id", "method", reason.isNull().alias("allowed"), F.coalesce(reason, F.lit("")).alias("reason"))


def classify(m: DataFrame) -> DataFrame:
    """Type of each study from its non-zero values: negatives mean logs; no decimals and a maximum over 100 raw counts; decimals below 30 logs."""
    v = F.when(F.col("value") != 0, F.col("value").cast("double"))
    s = m.groupBy("study_id").agg(F.min(v).alias("low"), F.max(v).alias("high"), F.max((F.abs(v - F.rint(v)) > 1e-8).cast("int")).alias("decimals"))
    kind = (
        F.when(F.col("high").isNull(), "unknown")
        .when(F.col("low") < 0, "log")
        .when((F.col("decimals") == 0) & (F.col("high") > RAW_MAX), "raw_counts")
        .when((F.col("decimals") == 1) & (F.col("high") < 30), "log")
        .otherwise("fpkm_tpm")
    )
    return s.select("study_id", "low", "high", (F.col("decimals") == 1).alias("has_decimals"), kind.alias("kind"))


def looks_like_beta(m: DataFrame) -> DataFrame:
    """Whether all values lie in [0, 1], or in [0, 100] as percentages."""
    v = F.col("value").cast("double")
    s = m.where("value is not null").groupBy("study_id").agg(F.min(v).alias("low"), F.max(v).alias("high"))
    return s.select("study_id", ((F.col("low") >= 0) & (F.col("high") <= 1)).alias("is_beta"), ((F.col("low") >= 0) & (F.col("high") > 1) & (F.col("high") <= 100)).alias("is_percent"))


def feature_id_type(ids: DataFrame) -> DataFrame:
    """Dominant kind of the ids (study_id, feature_id), its share, and whether gene sets can take them."""
    kind = F.lit(None).cast("string")
    for name, pattern in reversed(ID_PATTERNS):
        kind = F.when(F.col("feature_id").rlike(pattern), name).otherwise(kind)
    n = ids.select("study_id", F.coalesce(kind, F.lit("other")).alias("kind")).groupBy("study_id", "kind").count()
    top = n.groupBy("study_id").agg(F.sum("count").alias("n_ids"), F.max(F.struct(F.col("count"), F.col("kind"))).alias("top"))
    share = F.round(F.col("top.count") / F.col("n_ids"), 4)
    return top.select("study_id", "n_ids", F.col("top.kind").alias("dominant"), share.alias("fraction"), (F.col("top.kind").isin("gene_symbol", "ensembl_gene") & (share >= 0.8)).alias("gene_set_ready"))


def kept_features(m: DataFrame, keep: Column) -> DataFrame:
    """``m`` restricted to features for which the aggregate condition ``keep`` holds."""
    return m.join(m.groupBy("study_id", "feature_id").agg(keep.alias("keep")).where("keep").drop("keep"), ["study_id", "feature_id"], "left_semi")


def filter_low(m: DataFrame, min_count: float = 10, min_samples: int = 3) -> DataFrame:
    return kept_features(m, F.count_if(F.col("value") >= min_count) >= min_samples)


def drop_zero(m: DataFrame) -> DataFrame:
    return kept_features(m, F.max(F.abs("value")) > 0)


def drop_missing(m: DataFrame, most: float = 0.5) -> DataFrame:
    return kept_features(m, F.avg(F.col("value").isNull().cast("double")) <= most)


def usable(m: DataFrame) -> DataFrame:
    """Features with values in at least max(3, half of the samples) and some variance."""
    return kept_features(m, (F.count("value") >= F.greatest(F.lit(3.0), F.count(F.lit(1)) / 2)) & (F.var_samp("value") > 0))


def drop_invariant(m: DataFrame, least: float = 0.02) -> DataFrame:
    return kept_features(m, F.stddev_samp("value") > least)


def log_cpm(m: DataFrame, prior: float = 1.0) -> DataFrame:
    """Adds cpm and log_cpm; a sample without counts has 0."""
    size = m.groupBy("study_id", "sample_id").agg(F.sum("value").alias("__size"))  # a row a sample, so the matrix itself isn't sorted
    cpm = F.when(F.col("__size") > 0, F.col("value") * 1e6 / F.col("__size")).otherwise(0.0)
    j = m.join(size, ["study_id", "sample_id"], "left").withColumn("cpm", cpm)
    return j.select(*m.columns, "cpm", F.log2(F.col("cpm") + prior).alias("log_cpm"))


def log2p(m: DataFrame, c: float = 1.0) -> DataFrame:
    """log2(value + c) of studies on a linear scale (no negatives, maximum over 50); others give no rows."""
    ok = m.groupBy("study_id").agg(((F.min("value") >= 0) & (F.max("value") > LOG_MAX)).alias("ok")).where("ok")
    return m.join(ok.select("study_id"), "study_id", "left_semi").withColumn("value", F.log2(F.col("value") + c))


def with_highest(m: DataFrame) -> DataFrame:
    """Adds ``__high``, the highest value of a study; a row a study is joined, so no task holds a study's rows."""
    high = m.groupBy("study_id").agg(F.max("value").alias("__high")).withColumnRenamed("study_id", "__study")
    return m.join(high, m["study_id"].eqNullSafe(high["__study"]), "left").drop("__study")


def beta_to_m(m: DataFrame, eps: float = 1e-3) -> DataFrame:
    """M-values; a study with a maximum over 1.5 is taken as percentages."""
    b = F.least(F.greatest(F.when(F.col("__high") > 1.5, F.col("value") / 100).otherwise(F.col("value")), F.lit(eps)), F.lit(1 - eps))
    return with_highest(m).withColumn("value", F.log2((b + eps) / (1 - b + eps))).drop("__high")


def round_counts(m: DataFrame) -> DataFrame:
    """Half-even rounding; studies with negative values give no rows."""
    ok = m.groupBy("study_id").agg((F.min("value") >= 0).alias("ok")).where("ok")
    return m.join(ok.select("study_id"), "study_id", "left_semi").withColumn("value", F.bround("value", 0).cast("long"))


def centre(m: DataFrame) -> DataFrame:
    return m.withColumn("value", F.col("value") - F.percentile("value", F.lit(0.5)).over(Window.partitionBy("study_id", "sample_id")))


def log_if_linear(m: DataFrame, limit: float = LOG_MAX) -> DataFrame:
    return with_highest(m).withColumn("value", F.when(F.col("__high") >= limit, F.log2(F.greatest("value", F.lit(0.0)) + 1)).otherwise(F.col("value"))).drop("__high")


def minprob(m: DataFrame, shift: float = 1.8, scale: float = 0.3, seed: int = 42) -> DataFrame:
    """Missing values drawn from N(mean - shift * sd, (scale * sd)^2) of their sample, seeded by sample and feature (Box-Muller)."""
    s = m.groupBy("study_id", "sample_id").agg(F.avg("value").alias("mu"), F.stddev_samp("value").alias("sd"))
    u = [(F.pmod(F.xxhash64(F.lit(seed), F.lit(k), "study_id", "sample_id", "feature_id"), F.lit(1 << 52)) + 0.5) / float(1 << 52) for k in (0, 1)]
    z = F.sqrt(-2 * F.log(u[0])) * F.cos(2 * F.pi() * u[1])
    drawn = F.col("mu") - shift * F.col("sd") + scale * F.col("sd") * z
    return m.join(s, ["study_id", "sample_id"]).select("study_id", "feature_id", "sample_id", F.coalesce("value", drawn).alias("value"), F.col("value").isNull().alias("imputed"))


#: Phrases of series types and what they stand for.
SERIES_TYPES = (
    ("expression profiling by high throughput sequencing", "rnaseq"),
    ("expression profiling by array", "microarray"),
    ("methylation profiling", "methylation"),
    ("non-coding rna profiling by high throughput sequencing", "ncrna_seq"),
    ("non-coding rna profiling by array", "ncrna_array"),
    ("genome binding/occupancy", "chromatin"),
    ("genome variation", "genome_variation"),
    ("protein profiling", "proteomics"),
)


def series_type(kind: Column, text: Column) -> Column:
    """Data types of a series joined by +; sequencing of single cells by the words of its text."""
    low = F.lower(F.coalesce(kind, F.lit("")))
    single = F.coalesce(text, F.lit("")).rlike(r"(?i)single[- ]?(cell|nucle(us|i))|scRNA|snRNA|10x genomics|chromium|drop-?seq")
    found = F.array_compact(F.array(*(F.when(low.contains(p), F.when(single, "scrnaseq").otherwise("rnaseq") if k == "rnaseq" else F.lit(k)) for p, k in SERIES_TYPES)))
    return F.when(F.size(found) > 0, F.array_join(F.array_distinct(found), "+")).otherwise(F.when(low == "", "unknown").otherwise("other"))


#: Words of data types in order, and the files they need.
REQUIRED = (("single-cell", "matrix;barcodes;features"), ("methylation", "beta matrix;probe annotation"), ("proteomics", "abundance matrix;sample sheet"), ("microarray", "log matrix;platform annotation"), ("count", "raw counts;sample sheet"))


def required_data(kind: Column) -> Column:
    """The files of the first word of the list that a data type holds."""
    out: Column = F.lit(None).cast("string")
    for word, files in reversed(REQUIRED):
        out = F.when(F.lower(kind).contains(word), files).otherwise(out)
    return out


#: Isotope labels by name, in order.
REAGENTS = (("TMT", r"(?i)\btmt|tandem mass tag"), ("iTRAQ", r"(?i)itraq"), ("SILAC", r"(?i)silac|label:13c"), ("dimethyl", r"(?i)dimethyl"))


def reagent(*texts: Column) -> Column:
    """The isotope label that the first text with any names; NULL without."""
    of = lambda c: reduce(lambda out, r: F.when(c.rlike(r[1]), r[0]).otherwise(out), reversed(REAGENTS), F.lit(None).cast("string"))
    return F.coalesce(*(of(F.coalesce(c, F.lit(""))) for c in texts))


def labelling(*texts: Column) -> Column:
    """labelled or label_free by the first text that says so: quantification methods, then modifications, then the project's text."""
    free = r"(?i)label[- ]free|\blfq\b|\bdia\b"
    return F.coalesce(*(F.when(reagent(c).isNotNull(), "labelled").when(F.coalesce(c, F.lit("")).rlike(free), "label_free") for c in texts), F.lit("unknown"))


def sniff(m: DataFrame, estimated: Column) -> DataFrame:
    """What values of a file say of it (file, value, note): raw counts, mostly integer or decimal, and how that agrees with the notes."""
    near = (F.abs(F.col("value") - F.rint("value")) <= 0.01).cast("double")
    s = m.groupBy("file").agg(F.avg(near).alias("whole"), F.min("value").alias("low"), F.bool_or(estimated).alias("estimated"))
    kind = F.when((F.col("whole") >= INTEGER) & (F.col("low") >= 0), "raw_counts").when(F.col("whole") >= 0.5, "mostly_integer").otherwise("decimal")
    s = s.withColumn("kind", kind)
    return s.select("file", F.round("whole", 6).alias("whole"), "kind", F.when(F.col("kind") == "raw_counts", "as_expected").when(F.col("estimated"), "estimated").otherwise("unexplained").alias("verdict"))
