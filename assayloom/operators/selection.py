"""Selections: interleaving, previews, quotas."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def interleave(lists: DataFrame, order: list[Column], most: int, shares: dict[str, float] | None = None) -> DataFrame:
    """Ranked lists of sources one after another by place, ``most`` rows in all.

    With ``shares`` a source gets at most that share of ``most``; room that a short source leaves goes to the rows beyond the caps, in
    the same order of merging, behind all others. A source without a share has none. Of each source only the first ``most`` can
    matter, so that many a task leave it, and the order of all sorts a bounded list.
    """
    place = F.row_number().over(Window.partitionBy("source").orderBy(*order))
    ranked = lists.withColumn("place", place.cast("long")).where(F.col("place") <= most)
    cap = F.lit(most)
    if shares is not None:
        cap = F.lit(0)
        for source, share in shares.items():
            cap = F.when(F.col("source") == source, round(most * share)).otherwise(cap)
    ranked = ranked.withColumn("beyond", F.col("place") > cap)
    first = ranked.orderBy("beyond", "place", "source").limit(most)
    return first.withColumn("position", F.row_number().over(Window.orderBy("beyond", "place", "source")).cast("long"))


def preview(items: Column, most: int = 60) -> Column:
    """The first items joined, and how many are left out."""
    more = F.size(items) - most
    return F.concat(F.array_join(F.slice(items, 1, most), ";"), F.when(more > 0, F.concat(F.lit(" (+"), more.cast("string"), F.lit(" more)"))).otherwise(""))


def triage(rows: DataFrame, flags: list[Column], key: str) -> DataFrame:
    """Rows of each batch in the order of flags, first to last, with a stable index."""
    w = Window.partitionBy("batch").orderBy(*(F.desc(f) for f in flags), key)
    return rows.withColumn("place", F.row_number().over(w).cast("long"))


def head_and_random(rows: DataFrame, group: str, order: str, head: int, picks: int, seed: int = 42) -> DataFrame:
    """The first ``head`` rows of each group and ``picks`` of the rest, drawn by a hash."""
    first = F.row_number().over(Window.partitionBy(group).orderBy(order))
    r = rows.withColumn("is_head", first <= head)
    draw = F.row_number().over(Window.partitionBy(group, "is_head").orderBy(F.md5(F.concat_ws("|", F.lit(seed), order)), order))
    return r.withColumn("draw", draw).where(F.col("is_head") | (F.col("draw") <= picks)).drop("draw")


def pick_per_stratum(rows: DataFrame, strata: list[str], rich: Column, key: str, seed: int = 42) -> DataFrame:
    """One row of each stratum: of the rich ones, where there are any, the first in the order of a hash.

    Only the best row of each task and stratum is shuffled.
    """
    order = F.struct((~rich).alias("poor"), F.md5(F.concat_ws("|", F.lit(seed), key)).alias("draw"), F.col(key).alias("key"))
    others = [c for c in rows.columns if c not in strata]
    best = rows.groupBy(*strata).agg(F.min_by(F.struct(*others), order).alias("r"))
    return best.select(*strata, "r.*").select(*rows.columns)


def quota_select(rows: DataFrame, quotas: list[tuple[str, Column, int]], key: str, total: int) -> DataFrame:
    """For each category in turn its first rows not taken yet, then others up to ``total``; categories are few, each is one pass."""
    taken = None
    for name, test, n in quotas:
        free = rows.where(test) if taken is None else rows.where(test).join(taken.select(key), key, "left_anti")
        got = free.orderBy(key).limit(n).select(key).withColumn("category", F.lit(name))
        taken = got if taken is None else taken.union(got)
    rest = rows.join(taken.select(key), key, "left_anti").orderBy(key).limit(total).select(key).withColumn("category", F.lit("fill"))
    need = taken.withColumn("o", F.lit(0)).union(rest.withColumn("o", F.lit(1))).orderBy("o", key).limit(total)
    return need.select(key, "category")


def pick_matrix(files: DataFrame, preferred: Column, top: int = 3) -> DataFrame:
    """Of the largest files of each study the first preferred one, else the largest."""
    size = F.row_number().over(Window.partitionBy("study_id").orderBy(F.desc("size"), "name"))
    r = files.withColumn("place", size).where(F.col("place") <= top).withColumn("good", preferred)
    at = F.row_number().over(Window.partitionBy("study_id").orderBy(F.desc("good"), "place"))
    return r.withColumn("at", at).where("at = 1").drop("at", "place", "good")
