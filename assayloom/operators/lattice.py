"""Comparisons of a categorical design: pairs of levels of each factor inside every combination of the others, and 2x2 interactions.

Sizes come from one count by all factors; levels, their order and their references are windows over it. Combinations are
products of levels, so cells without samples are there with size 0. A factor with more than ``most_levels`` levels is never
paired with itself: its levels meet its reference and, where they carry times, their neighbours.

Rows with a null factor or stratum don't count. A study without a second level of a factor has no comparison of it.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce
from itertools import combinations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from assayloom.functions.tables import once

#: How names of reference levels begin.
REFERENCE = (
    r"(?i)^(ctrl|control|con|sed|sedentary|untrained|vehicle|veh|pbs|saline|wt|wild[- ]?type|baseline|base|pre|pre[- ]?(training|exercise|intervention)?|rest|resting|sham|placebo|pla|chow|normal|"
    r"day ?0|0 ?h|t0|week ?0|before|naive|non[- ]?exercise|no exercise|inactive|cage)\b"
)
NUMBER = r"-?\d+(\.\d+)?"


def levels_of(cells: DataFrame, keys: list[str], factor: str, reference: str | None) -> DataFrame:
    """(keys, level, place, n_levels, timed, named, ref): the levels of a factor in order.

    ``named`` is the reference that is given or reads as one, if only one does; ``ref`` also takes the first in time.
    """
    v = cells.select(*keys, F.col(factor).alias("level")).distinct()
    v = v.withColumn("number", F.expr(f"try_cast(nullif(regexp_extract(level, '{NUMBER.replace(chr(92), chr(92) * 2)}', 0), '') as double)"))
    w = Window.partitionBy(*keys)
    n, known = F.count(F.lit(1)).over(w), F.size(F.collect_set("number").over(w))
    v = v.withColumn("n_levels", n).withColumn("timed", n == known)
    order = w.orderBy(F.when(F.col("timed"), F.col("number")).asc_nulls_last(), "level")
    v = v.withColumn("place", F.row_number().over(order))
    if reference is None:
        reads = F.trim("level").rlike(REFERENCE)
        named = F.when(F.count_if(reads).over(w) == 1, F.max(F.when(reads, F.col("level"))).over(w))
    else:
        named = F.max(F.when(F.col("level") == reference, F.col("level"))).over(w)
    v = v.withColumn("named", named)
    return v.withColumn("ref", F.coalesce("named", F.when(F.col("timed"), F.max(F.when(F.col("place") == 1, F.col("level"))).over(w)))).drop("number")


def pairs_of(levels: DataFrame, keys: list[str], most_levels: int) -> DataFrame:
    """(keys, test, reference) of a factor's ``levels``."""
    few = levels.where(F.col("n_levels") <= most_levels)
    a, b = few.select(*keys, "ref", F.col("level").alias("a"), F.col("place").alias("pa")), few.select(*keys, F.col("level").alias("b"), F.col("place").alias("pb"))
    j = a.join(b, keys).where("pa < pb")
    turned = F.coalesce(F.col("b") == F.col("ref"), F.lit(False))
    every = j.select(*keys, F.when(turned, F.col("a")).otherwise(F.col("b")).alias("test"), F.when(turned, F.col("b")).otherwise(F.col("a")).alias("reference"))
    many = levels.where(F.col("n_levels") > most_levels)
    to_ref = many.where(F.col("level") != F.col("ref")).select(*keys, F.col("level").alias("test"), F.col("ref").alias("reference"))
    before = F.lag("level").over(Window.partitionBy(*keys).orderBy("place"))
    next_to = many.where("timed").withColumn("before", before).where(F.col("before") != F.col("ref")).select(*keys, F.col("level").alias("test"), F.col("before").alias("reference"))
    return every.unionByName(to_ref).unionByName(next_to)


def lattice(s: DataFrame, factors: Sequence[str], strata: Sequence[str] = (), references: dict[str, str] | None = None, least: int = 3, most_levels: int = 6) -> DataFrame:
    """(study_id, kind, factor, test, reference, within, name, sizes, least_cell, analyzable): every comparison of the samples ``s``.

    ``simple``: two levels of a factor within a combination of the others. ``interaction``: the difference of two differences between a
    level and the reference of two factors that both have one. ``sizes`` are those of the cells, joined; all must have ``least``
    samples to be analysed. ``strata`` repeat everything within each combination of their values that occurs.
    """
    factors, strata, keys = list(factors), list(strata), ["study_id", *strata]
    used = [F.col(c).cast("string").alias(c) for c in [*strata, *factors]]
    cells = once(s.select("study_id", *used).dropna().groupBy(*keys, *factors).agg(F.count(F.lit(1)).alias("n")))
    levels = {f: once(levels_of(cells, keys, f, (references or {}).get(f))) for f in factors}

    def crossed(base: DataFrame, others: list[str]) -> DataFrame:
        return reduce(lambda d, g: d.join(levels[g].select(*keys, F.col("level").alias(g)), keys), others, base)

    def size(d: DataFrame, at: dict[str, Column], name: str) -> DataFrame:
        spot = d.withColumns({f"__{f}": at.get(f, F.col(f)) for f in factors})
        return spot.join(cells.select(*keys, *(F.col(f).alias(f"__{f}") for f in factors), F.col("n").alias(name)), [*keys, *(f"__{f}" for f in factors)], "left").fillna(0, [name]).drop(*(f"__{f}" for f in factors))

    def said(d: DataFrame, kind: str, factor: str, test: Column, reference: Column, others: list[str], sizes: list[str]) -> DataFrame:
        where = [F.concat(F.lit(f"_{c}-"), F.col(c)) for c in [*strata, *others]]
        within = F.concat(F.lit(""), *where)
        name = F.regexp_replace(F.concat(F.lit(f"{factor}_"), test, F.lit("_vs_"), reference, within), "[^A-Za-z0-9._-]+", "_")
        low = F.array_min(F.array(*sizes))
        return d.select("study_id", F.lit(kind).alias("kind"), F.lit(factor).alias("factor"), test.alias("test"), reference.alias("reference"), F.ltrim(within, F.lit("_")).alias("within"), F.trim(name, F.lit("_")).alias("name"), F.concat_ws(",", *(F.col(c).cast("string") for c in sizes)).alias("sizes"), low.alias("least_cell"), (low >= least).alias("analyzable"))

    out = []
    for f in factors:
        others = [g for g in factors if g != f]
        d = crossed(pairs_of(levels[f], keys, most_levels), others)
        d = size(size(d, {f: F.col("test")}, "n1"), {f: F.col("reference")}, "n2")
        out.append(said(d, "simple", f, F.col("test"), F.col("reference"), others, ["n1", "n2"]))
    for f, g in combinations(factors, 2):
        rest = [h for h in factors if h not in (f, g)]
        a, b = (levels[x].where(F.col("level") != F.col("named")).select(*keys, F.col("level").alias(f"{k}1"), F.col("named").alias(f"{k}0")) for k, x in (("a", f), ("b", g)))
        d = crossed(a.join(b, keys), rest)
        sizes = [f"n{i}{k}" for k in (1, 0) for i in (1, 0)]
        for i, k in ((1, 1), (0, 1), (1, 0), (0, 0)):
            d = size(d, {f: F.col(f"a{i}"), g: F.col(f"b{k}")}, f"n{i}{k}")
        out.append(said(d, "interaction", f"{f}:{g}", F.concat_ws(":", "a1", "b1"), F.concat_ws(":", "a0", "b0"), rest, sizes))
    return reduce(DataFrame.unionByName, out)
