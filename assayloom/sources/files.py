"""File scans and sinks: each scan reads all files of all studies in one job and gives long tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: Words in names of columns and files.
COUNT_WORDS = ("count", "counts", "read", "reads", "featurecount", "raw")
OTHER_WORDS = ("length", "start", "end", "strand", "fpkm", "tpm", "rpkm", "coverage", "score")
RAW_NAME = r"(?i)(raw[._ -]?counts?|read[._ -]?counts?|counts?[._ -]?(matrix|table)|featurecounts?|htseq|gene[._ -]?counts?|(?<![a-z])counts?(?![a-z])|expected[._ -]?count|umi[._ -]?counts?|allcounts?|coun?t?table|(?<![a-z])raw(?![a-z]))"
NORMAL_NAME = r"(?i)(fpkm|rpkm|tpm|cpm|(?<![a-z])tmm(?![a-z])|normali[sz]ed|norm(?:[._-]|counts?|expr|data)|vst|rlog|log2|abundance)"
DE_NAME = r"(?i)((?<![a-z])(degs?|dges?)(?![a-z])|diff[._ -]?expr|differential|(?<![a-z])de[._ -](summary|results?|tables?|genes?)|log2?fc|fold[._ -]?change)"
TABLE_NAME = r"(?i)\.(csv|tsv|txt|xlsx?|tab)(\.gz)?$"


def lines_of(spark: SparkSession, paths: str | list[str]) -> DataFrame:
    """(file, n, line): the lines of text files with their place, whole files at once by their own reader."""
    raw = spark.read.text(paths, wholetext=True).select(F.col("_metadata.file_name").alias("file"), "value")
    return raw.select("file", F.posexplode(F.split("value", r"\r?\n")).alias("n", "line"))


def read_matrix(spark: SparkSession, paths: str | list[str], study: str = "file") -> DataFrame:
    """Delimited matrices to (study_id, feature_id, sample_id, value): the delimiter with the most fields in the header, the first column as
    feature, columns without any number dropped as annotation."""
    lines = lines_of(spark, paths).where(F.trim("line") != "")
    head = lines.where("n = 0").select("file", F.col("line").alias("header"))
    count = lambda d: F.size(F.split("header", d))
    sep = F.when((count("\t") >= count(",")) & (count("\t") >= count(";")), "\t").when(count(",") >= count(";"), ",").otherwise(";")
    head = head.withColumn("sep", sep)
    cells = lines.where("n > 0").join(head, "file")
    split = lambda c: F.expr(f"split({c}, sep)")
    flat = cells.select("file", "n", split("line")[0].alias("feature_id"), F.posexplode(F.arrays_zip(split("header").alias("h"), split("line").alias("v"))).alias("at", "c")).where("at > 0")
    named = flat.select("file", "n", F.regexp_replace("feature_id", '^"|"$', "").alias("feature_id"), F.regexp_replace(F.col("c.h"), '^"|"$', "").alias("sample_id"), F.col("c.v").try_cast("double").alias("value"))
    numeric = named.groupBy("file", "sample_id").agg(F.count("value").alias("k")).where("k > 0")
    return named.join(numeric, ["file", "sample_id"], "left_semi").select(F.col("file").alias("study_id"), "feature_id", "sample_id", "value")


def tagged_table_problems(spark: SparkSession, paths: str | list[str]) -> DataFrame:
    """(file, problem): tagged tables that can't be read as a matrix: without protein rows, or with identifications only (no abundance columns)."""
    lines = lines_of(spark, paths)
    tag = F.split_part("line", F.lit("\t"), F.lit(1))
    n = lines.groupBy("file").agg(F.count_if(tag == "PRT").alias("rows"), F.count_if((tag == "PRH") & F.col("line").rlike(r"\tprotein_abundance_assay\[\d+\]")).alias("heads"))
    return n.select("file", F.when(F.col("rows") == 0, "no protein rows").when(F.col("heads") == 0, "identifications only").alias("problem")).where("problem is not null")


def read_tagged_table(spark: SparkSession, paths: str | list[str]) -> DataFrame:
    """mzTab protein rows: the PRH header of each file gives the columns, PRT rows are padded or cut to it, null is NULL, decoys go.

    Files without protein rows or with identifications only give no rows; ``tagged_table_problems`` names them.
    """
    lines = lines_of(spark, paths).withColumn("f", F.split("line", "\t"))
    head = lines.where(F.col("f")[0] == "PRH").select("file", F.col("f").alias("h")).where(F.exists("h", lambda c: c.rlike(r"^protein_abundance_assay\[\d+\]$")))
    cells = lines.where(F.col("f")[0] == "PRT").join(head, "file").select("file", "n", F.col("f")[1].alias("protein"), F.posexplode("h").alias("at", "name"), "f")
    cell = cells.withColumn("v", F.when(F.col("at") < F.size("f"), F.element_at("f", F.col("at") + 1))).withColumn("v", F.when(F.col("v") != "null", F.col("v")))
    decoy = cell.where(F.col("name").rlike("(?i)decoy") & (F.col("v") == "1")).select("file", "n").distinct()
    kept = cell.where(~F.col("protein").startswith("DECOY_")).join(decoy, ["file", "n"], "left_anti").where(F.col("name").rlike(r"^protein_abundance_assay\[\d+\]$"))
    return kept.select(F.col("file").alias("study_id"), F.col("protein").alias("feature_id"), F.regexp_extract("name", r"\[(\d+)\]", 1).alias("sample_id"), F.col("v").try_cast("double").alias("value"))


def sample_counts(lines: DataFrame) -> DataFrame:
    """(study_id, file, gene, value) of per-sample count files (file, n, line; study_id if there are several studies).

    Comments and __ summary rows are out, of a repeated gene the first counts.
    """
    lines = lines if "study_id" in lines.columns else lines.withColumn("study_id", F.lit(""))
    rows = lines.where(~F.col("line").startswith("#") & ~F.col("line").startswith("__") & (F.trim("line") != "")).select("study_id", "file", "n", F.split("line", r"\s+").alias("f")).where(F.size("f") >= 2)
    v = rows.select("study_id", "file", "n", F.col("f")[0].alias("gene"), F.element_at("f", -1).try_cast("double").alias("value")).where("value is not null")
    return v.groupBy("study_id", "file", "gene").agg(F.min_by("value", "n").alias("value"))


def merge_sample_files(lines: DataFrame) -> DataFrame:
    """The matrix of per-sample count files, with 0 where a sample lacks a gene that another one of its study has.

    A gene is one row with its samples; the study's list of samples is joined to it and tells the zeros.
    """
    v = sample_counts(lines)
    genes = v.groupBy("study_id", "gene").agg(F.map_from_entries(F.collect_list(F.struct("file", "value"))).alias("y"))
    files = v.groupBy("study_id").agg(F.array_sort(F.collect_set("file")).alias("files"))
    each = genes.join(files, "study_id").select("study_id", "gene", "y", F.explode("files").alias("file"))
    out = each.select("study_id", F.col("file").alias("sample_id"), F.col("gene").alias("feature_id"), F.coalesce(F.try_element_at("y", "file"), F.lit(0.0)).alias("value"))
    return out if "study_id" in lines.columns else out.drop("study_id")


def shared_ids(lines: DataFrame, least: float = 0.5) -> DataFrame:
    """(study_id, n_samples, n_union, n_shared, share, warning): ids that all samples of a study have, of those that any has."""
    v = sample_counts(lines)
    n = v.groupBy("study_id", "gene").agg(F.count(F.lit(1)).alias("k")).join(v.groupBy("study_id").agg(F.countDistinct("file").alias("n_samples")), "study_id")
    s = n.groupBy("study_id", "n_samples").agg(F.count(F.lit(1)).alias("n_union"), F.count_if(F.col("k") == F.col("n_samples")).alias("n_shared"))
    s = s.withColumn("share", F.round(F.col("n_shared") / F.col("n_union"), 6))
    return s.withColumn("warning", F.when(F.col("share") < least, "samples share few ids"))


def choose_count_column(cells: DataFrame) -> DataFrame:
    """The count column of each file from (file, col, value): words in its name, and whether its values are counts; a tie or no score is ambiguous."""
    low = F.lower("col")
    words = sum((F.when(low.contains(w), 2).otherwise(0) for w in COUNT_WORDS), F.lit(0)) - sum((F.when(low.contains(w), 3).otherwise(0) for w in OTHER_WORDS), F.lit(0))
    s = cells.where("value is not null").groupBy("file", "col").agg(F.min("value").alias("low"), F.avg((F.rint("value") == F.col("value")).cast("double")).alias("whole"))
    s = s.withColumn("score", words + F.when((F.col("low") >= 0) & (F.col("whole") >= 0.95), 1).otherwise(0))
    w = Window.partitionBy("file")
    r = s.withColumn("place", F.row_number().over(w.orderBy(F.desc("score"), F.desc("col")))).withColumn("n", F.count(F.lit(1)).over(w)).withColumn("next", F.lead("score").over(w.orderBy(F.desc("score"), F.desc("col")))).where("place = 1")
    sure, torn = F.col("n") == 1, (F.col("score") <= 0) | (F.col("score") == F.col("next"))
    return r.select("file", F.when(sure | ~torn, F.col("col")).alias("count_column"), "score", F.when(sure, "high").when(torn, "ambiguous").otherwise("medium").alias("confidence"))


def choose_strand(cells: DataFrame, stranded: float = 3.0, unstranded: float = 1.5) -> DataFrame:
    """The strand column for all libraries of a study from forward and reverse totals."""
    s = cells.groupBy("study_id").agg(F.sum("forward").alias("f"), F.sum("reverse").alias("r"))
    ratio = F.when(F.least("f", "r") > 0, F.greatest("f", "r") / F.least("f", "r")).otherwise(float("inf"))
    strand = F.when(ratio >= stranded, F.when(F.col("f") > F.col("r"), "forward").otherwise("reverse")).when(ratio < unstranded, "unstranded").otherwise("ambiguous")
    return s.select("study_id", F.round(ratio, 4).alias("ratio"), strand.alias("strand"))


def classify_files(files: DataFrame) -> DataFrame:
    """What the files of each series (series, name) offer; the best kind names the status."""
    name = F.col("name")
    table = name.rlike(TABLE_NAME)
    de = table & name.rlike(DE_NAME)
    norm = table & name.rlike(NORMAL_NAME) & ~de
    raw = table & name.rlike(RAW_NAME) & ~name.rlike(NORMAL_NAME) & ~de
    tar = F.lower(name).endswith("_raw.tar")
    c = files.where(F.lower(name) != "filelist.txt").groupBy("series").agg(
        F.count_if(raw).alias("raw"), F.count_if(tar).alias("tar"), F.count_if(norm).alias("norm"), F.count_if(table & ~raw & ~norm & ~de).alias("other"), F.count_if(de).alias("de")
    )
    status = F.lit("none")
    for col, said in reversed((("raw", "raw_counts"), ("tar", "raw_tar"), ("norm", "normalized_only"), ("other", "unlabelled_matrix"), ("de", "de_tables_only"))):
        status = F.when(F.col(col) > 0, said).otherwise(status)
    return c.withColumn("status", status)


def read_triples(spark: SparkSession, folder: str) -> DataFrame:
    """A coordinate matrix with its feature and barcode lists, as (cell_id, gene, value)."""
    entries = lines_of(spark, f"{folder}/matrix.mtx").where(~F.col("line").startswith("%") & (F.trim("line") != ""))
    first = entries.agg(F.min("n").alias("first"))
    body = entries.join(F.broadcast(first), F.col("n") > F.col("first")).select(F.split(F.trim("line"), r"\s+").alias("f"))
    cells = body.select(F.col("f")[0].cast("long").alias("i"), F.col("f")[1].cast("long").alias("j"), F.col("f")[2].cast("double").alias("value"))
    name = lambda file, at, out, part: lines_of(spark, f"{folder}/{file}").where(F.trim("line") != "").select((F.col("n") + 1).cast("long").alias(at), F.element_at(F.split("line", "\t"), part).alias(out))
    return cells.join(name("features.tsv", "i", "gene", 1), "i").join(name("barcodes.tsv", "j", "cell_id", 1), "j").select("cell_id", "gene", "value")


def read_series_header(spark: SparkSession, paths: str | list[str]) -> DataFrame:
    """``!Sample_`` lines up to the table marker, as (study_id, sample_no, attr, ord, value); characteristics are named by their label."""
    lines = lines_of(spark, paths)
    stop = lines.where(F.col("line").startswith("!series_matrix_table_begin")).groupBy("file").agg(F.min("n").alias("stop"))
    rows = lines.where(F.col("line").startswith("!Sample_")).join(stop, "file", "left").where("stop is null or n < stop")
    flat = rows.select("file", "n", F.split("line", "\t").alias("f")).select("file", "n", F.regexp_replace(F.col("f")[0], "^!Sample_", "").alias("key"), F.posexplode(F.slice("f", 2, F.size("f") - 1)).alias("sample_no", "value"))
    text = F.regexp_replace("value", '^"|"$', "")
    label = F.when(F.col("key").startswith("characteristics") & F.contains(text, F.lit(": ")), F.substring_index(text, ": ", 1)).otherwise(F.col("key"))
    value = F.when(F.col("key").startswith("characteristics") & F.contains(text, F.lit(": ")), F.regexp_replace(text, "^.*?: ", "")).otherwise(text)
    return flat.select(F.col("file").alias("study_id"), "sample_no", label.alias("attr"), F.col("n").alias("ord"), value.alias("value"))


def append_tables(tables: dict[str, DataFrame], path: str, columns: dict[str, list[str]]) -> None:
    """One Parquet table an entity with its columns in fixed order, split by study."""
    for name, df in tables.items():
        df.select(*columns[name]).write.mode("append").partitionBy("study_id").parquet(f"{path}/{name}")


def write_results(d: DataFrame, path: str) -> None:
    """Results by study, contrast and method, with names that are safe in paths."""
    safe = F.regexp_replace("contrast_id", r"[^A-Za-z0-9._-]+", "_")
    d.withColumn("contrast_id", safe).write.mode("overwrite").partitionBy("study_id", "contrast_id", "method").parquet(path)


def artifact_index(spark: SparkSession, path: str) -> DataFrame:
    """Path, size and SHA-256 of files."""
    return spark.read.format("binaryFile").option("recursiveFileLookup", True).load(path).select("path", F.col("length").alias("n_bytes"), F.sha2("content", 256).alias("sha256"))


def table_counts(tables: dict[str, DataFrame]) -> DataFrame:
    out = None
    for name, df in tables.items():
        one = df.agg(F.lit(name).alias("table"), F.count(F.lit(1)).alias("n"))
        out = one if out is None else out.union(one)
    return out
