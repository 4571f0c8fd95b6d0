"""Scans of one delimited table, read in splits by Spark's own reader, with quoted fields."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Names of the protein column, the first pattern that fits any column wins.
PROTEIN = (r"protein[._\s-]?group", r"protein[._\s-]?accession", r"majority[._\s-]?protein", r"protein[._\s-]?id\b", r"^accession$", r"^uniprot", r"^entry$")
#: Names of columns that hold scores, statistics or properties of a protein and no sample.
SCORES = (
    r"\b[qpe][._\s-]?value\b",
    r"\bpep[._\s-]?value\b",
    r"\bpvalue\b|\bqvalue\b|\bevalue\b",
    r"\bc[._\s-]?score\b",
    r"\bscore\b",
    r"\bcoverage\b",
    r"\b(?:num(?:ber)?|n)[._\s-]?(?:of[._\s-])?(?:psm|peptide|protein|spec|ms2)",
    r"\bms[/_.\s-]?ms[._\s-]?count\b",
    r"\b(?:unique|distinct|razor)[._\s-]?peptide",
    r"\bsequence[._\s-]?length\b",
    r"\bmol[._\s-]?weight\b|\bmolecular[._\s-]?weight\b|\bmw\b",
    r"\bpep\b",
)


def read_delimited(spark: SparkSession, path: str) -> tuple[list[str], DataFrame]:
    """The names of a table's columns, and its rows as strings c0, c1, ...; the delimiter is the one with the most fields in the header."""
    first = spark.read.text(path).where(F.trim("value") != "").limit(1).collect()
    if not first:
        raise ValueError(f"{path} is empty")
    sep = max("\t,;", key=first[0]["value"].count)
    raw = spark.read.csv(path, sep=sep, header=True, quote='"', escape='"')
    return raw.columns, raw.toDF(*(f"c{i}" for i in range(len(raw.columns))))


def numeric_columns(rows: DataFrame) -> list[int]:
    """The columns with any number: one aggregation over the table."""
    found = rows.agg(*(F.count(F.col(c).try_cast("double")).alias(c) for c in rows.columns)).first()
    return [i for i, c in enumerate(rows.columns) if found[c]]


def long_form(rows: DataFrame, names: list[str], feature: int, samples: list[int]) -> DataFrame:
    cells = F.array(*(F.struct(F.lit(names[i]).alias("sample_id"), F.col(f"c{i}").try_cast("double").alias("value")) for i in samples))
    return rows.where(F.col(f"c{feature}").isNotNull()).select(F.col(f"c{feature}").alias("feature_id"), F.explode(cells).alias("c")).select("feature_id", "c.sample_id", "c.value")


def scan_matrix(spark: SparkSession, path: str, least: int = 2) -> DataFrame:
    """(feature_id, sample_id, value) of a matrix: features in its first column, every other column with a number is a sample.

    A table with fewer than ``least`` of these is no matrix and is refused.
    """
    names, rows = read_delimited(spark, path)
    samples = [i for i in numeric_columns(rows) if i]
    if len(samples) < least:
        raise ValueError(f"{path} has {len(samples)} numeric columns beside the first")
    return long_form(rows, names, 0, samples)


def column_roles(names: list[str]) -> tuple[int, list[int]]:
    """The place of the protein column (the first if no name fits) and of the columns named like scores."""
    import re

    fits = lambda patterns, name: any(re.search(p, name, re.IGNORECASE) for p in patterns)
    feature = next((i for p in PROTEIN for i, n in enumerate(names) if fits([p], n)), 0)
    return feature, [i for i, n in enumerate(names) if fits(SCORES, n)]


def scan_quant(spark: SparkSession, path: str) -> DataFrame:
    """(feature_id, sample_id, value) of a protein quantification: an mzTab file by its tags, others by the names of their columns."""
    if ".mztab" in path.lower().removesuffix(".gz"):
        from assayloom.sources.files import read_tagged_table

        return read_tagged_table(spark, path).select("feature_id", "sample_id", "value")
    names, rows = read_delimited(spark, path)
    feature, scores = column_roles(names)
    samples = [i for i in numeric_columns(rows) if i != feature and i not in scores]
    if not samples:
        raise ValueError(f"{path} has no numeric column that could be a sample")
    return long_form(rows, names, feature, samples)
