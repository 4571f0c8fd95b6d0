"""Merkle dataset manifest: a tree of digests a group, a tree over the groups, and a proof for every row by pointer jumping.

A leaf is the digest of a row's fields, each with its length. The leaves of a group lie by id; FAN_OUT consecutive nodes become the
digest of their concatenation, level by level, until one is left, the subroot. The subroots, in the order of the groups, likewise
give the root. Texts are hashed where they are read and never shuffled.

* Places: rows are dealt by range of (group, id, leaf), numbered inside their partition, and a table with a row for each partition and
  group holds how many precede. No window spans a group.
* Levels: a node's children are an array of FAN_OUT at most; each level has an eighth of the rows of the one below.
* Proofs: every node above the leaves' runs starts with a pointer to its parent and the one segment (what stands left and right of it
  there). A round joins the table with itself: pointer to pointer, segments put together, so the distance doubles and the root of a tree
  of 16 levels is reached in four rounds. What nodes point at after a round lies 2^round levels up and has that many powers of
  eight fewer rows, so a target is either shared by few nodes or belongs to a table of a few rows, which Spark broadcasts by
  its size. The runs at the bottom then take the path of their node, and each leaf adds its own siblings.

Edge cases: null fields are "-" in a leaf; groups that are null come first; null ids come first in their group; rows that repeat an
id lie by their leaf, and equal rows are leaves of their own; a group of one row has that leaf as subroot, and a table of one
group that group's subroot as root; no siblings at all give the hash of the empty string; an empty table gives no rows. Columns that aren't fields play no part.
"""

from __future__ import annotations

import string
from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from assayloom.llm._shared import table, written
from assayloom.llm.fixed_sql import crc32_sql

FAN_OUT = 8
FIELDS = ("doc_id", "source", "lang", "n_chars", "text")
#: Levels that can't be passed: 8^20 rows.
MOST_LEVELS = 20
ID = ("tree", "level", "idx")
STEP = "array<struct<left:string,right:string>>"


def sized(value: Column) -> Column:
    """``-`` for null, else the UTF-8 byte count, a colon and the value."""
    v = value.cast("string")
    return F.when(v.isNull(), F.lit("-")).otherwise(F.concat(F.octet_length(v).cast("string"), F.lit(":"), v))


def digest(*parts: Column) -> Column:
    return F.sha2(F.concat(*parts), 256)


def leaf(fields: Sequence[Column]) -> Column:
    return digest(*(sized(f) for f in fields))


def levels_above(n: Column, fan_out: int) -> Column:
    """Levels of a tree over ``n`` leaves: 0 for one leaf."""
    return reduce(lambda a, k: a + (n > F.lit(fan_out**k)).cast("int"), range(MOST_LEVELS), F.lit(0))


def numbered(rows: DataFrame, key: str, order: Sequence[str], what: str) -> tuple[DataFrame, DataFrame]:
    """``rows`` with ``part`` and ``mid``, and (key, part, first, before, n): no = before + mid - first, from 0, within ``key``, by ``order``.

    ``rows`` are written tables, as their order is sampled first. ``key`` has no nulls.
    """
    placed = rows.repartitionByRange(key, *order).sortWithinPartitions(key, *order)
    placed = written(placed.withColumn("part", F.spark_partition_id()).withColumn("mid", F.monotonically_increasing_id()), what)
    runs = placed.groupBy(key, "part").agg(F.min("mid").alias("first"), F.count(F.lit(1)).alias("n"))
    w = Window.partitionBy(key).orderBy("part")
    return placed, runs.withColumn("before", F.sum("n").over(w.rowsBetween(Window.unboundedPreceding, Window.currentRow)) - F.col("n"))


def parents(nodes: DataFrame, level: int, fan_out: int) -> DataFrame:
    """The nodes one level above ``nodes`` (tree, level, idx, height, digest), with their children's digests as ``kids``."""
    up = nodes.where("height >= {0}".format(level)).groupBy("tree", F.floor(F.col("idx") / fan_out).alias("idx"))
    up = up.agg(F.max("height").alias("height"), F.array_sort(F.collect_list(F.struct("idx", "digest"))).alias("kids"))
    kids = F.col("kids.digest")
    return up.select("tree", F.lit(level).alias("level"), "idx", "height", F.sha2(F.array_join(kids, ""), 256).alias("digest"), kids.alias("kids"))


def node_id(at: str | None = None) -> list[Column]:
    """Columns of ID: a subroot is known as a leaf of the tree over the groups, whose number is -1."""
    c = lambda n: F.col(n)
    sub = (c("tree") >= 0) & (c("level") == c("height"))
    parts = (F.when(sub, F.lit(-1)).otherwise(c("tree")), F.when(sub, F.lit(0)).otherwise(c("level")), F.when(sub, c("tree")).otherwise(c("idx")))
    return [p.cast("long").alias(f"{at}_{n}" if at else n) for p, n in zip(parts, ID, strict=True)]


def steps_up(above: DataFrame, fan_out: int) -> DataFrame:
    """(tree, level, idx, to_tree, to_level, to_idx, steps): a row for each child of the nodes ``above``, with the one segment towards its parent."""
    kid = above.select("tree", "level", "height", *node_id("to"), (F.col("idx") * fan_out).alias("base"), "kids", F.posexplode("kids").alias("pos", "own"))
    left, right = F.array_join(F.slice("kids", F.lit(1), F.col("pos")), ""), F.array_join(F.slice("kids", F.col("pos") + 2, F.lit(fan_out)), "")
    return kid.select("tree", (F.col("level") - 1).cast("long").alias("level"), (F.col("base") + F.col("pos")).cast("long").alias("idx"), *(f"to_{n}" for n in ID), F.array(F.struct(left.alias("left"), right.alias("right"))).alias("steps"))


def jumped(edges: DataFrame, root: tuple[int, int, int], rounds: int) -> DataFrame:
    """Every pointer of ``edges`` brought to ``root``, with all segments on the way, in ``rounds`` self-joins."""
    there = reduce(lambda a, b: a & b, (F.col(f"to_{n}") == F.lit(v) for n, v in zip(ID, root, strict=True)))
    paths = written(edges, "paths")
    for _ in range(rounds):
        on = paths.select(*(F.col(n).alias(f"to_{n}") for n in ID), *(F.col(f"to_{n}").alias(f"next_{n}") for n in ID), F.col("steps").alias("more"))
        hop = paths.where(~there).join(on, [f"to_{n}" for n in ID])
        hop = hop.select(*ID, *(F.col(f"next_{n}").alias(f"to_{n}") for n in ID), F.concat("steps", "more").alias("steps"))
        paths = written(paths.where(there).unionByName(hop), "paths")
    return paths.select(*ID, "steps")


def manifest(rows: DataFrame, group: str, order: Sequence[str], leaf_col: str, carry: Sequence[str] = (), fan_out: int = FAN_OUT) -> DataFrame:
    """A row for each of ``rows``: the columns ``carry``, leaf, own (left and right siblings in its run), steps above it, alone, subroot and root.

    ``rows`` hold digests, not texts. ``alone`` tells that the leaf is its group's subroot.
    """
    spark = rows.sparkSession
    slim = rows.select(F.coalesce(F.concat(F.lit("="), F.col(group).cast("string")), F.lit("-")).alias("_key"), *(F.col(c).alias(f"_o{i}") for i, c in enumerate(order)), F.col(leaf_col).alias("_leaf"), *(F.col(c).alias(f"_c{i}") for i, c in enumerate(carry)))
    placed, parts = numbered(written(slim, "leaves"), "_key", [*(f"_o{i}" for i in range(len(order))), "_leaf"], "placed")
    groups, group_parts = numbered(written(parts.groupBy("_key").agg(F.sum("n").alias("total")).withColumn("_all", F.lit(0)), "groups"), "_all", ["_key"], "groups-placed")
    groups = groups.join(group_parts, ["_all", "part"]).select("_key", (F.col("before") + F.col("mid") - F.col("first")).alias("tree"), levels_above(F.col("total"), fan_out).alias("height"))
    groups = written(groups, "groups-numbered")
    most, n_groups = groups.agg(F.max("height"), F.count(F.lit(1))).first()
    kinds = ", ".join([f"`{c}` {rows.schema[c].dataType.simpleString()}" for c in carry] + [f"leaf string, left string, right string, steps {STEP}, alone boolean, subroot string, root string"])
    if not n_groups:
        return spark.createDataFrame([], kinds)

    # runs of leaves: nodes of level 1, or the leaf itself where a group has one
    parts = parts.join(groups, "_key").select("_key", "part", "first", "before", "tree", "height")
    spots = placed.join(parts, ["_key", "part"]).withColumn("no", F.col("before") + F.col("mid") - F.col("first"))
    runs = spots.groupBy("tree", F.floor(F.col("no") / fan_out).alias("idx")).agg(F.max("height").alias("height"), F.array_sort(F.collect_list(F.struct("no", "_leaf", *(f"_c{i}" for i in range(len(carry)))))).alias("of"))
    joint = F.array_join(F.col("of._leaf"), "")
    runs = written(runs.select("tree", F.least("height", F.lit(1)).alias("level"), "idx", "height", F.when(F.col("height") == 0, joint).otherwise(F.sha2(joint, 256)).alias("digest"), "of"), "runs")

    slim = ["tree", "level", "idx", "height", "digest"]
    levels, at = [], runs
    for level in range(2, most + 1):
        at = written(parents(at.select(*slim), level, fan_out), "level")
        levels.append(at)
    tops = reduce(DataFrame.unionByName, [x.select(*slim) for x in [runs, *levels]]).where("level = height")
    tops = written(tops.select("tree", "digest"), "subroots")
    high, n = 0, n_groups
    while n > 1:
        high, n = high + 1, -(-n // fan_out)
    at = tops.select(F.lit(-1).cast("long").alias("tree"), F.lit(0).alias("level"), F.col("tree").alias("idx"), F.lit(high).alias("height"), "digest")
    for level in range(1, high + 1):
        at = written(parents(at.select(*slim), level, fan_out), "level")
        levels.append(at)
    root = at.first()["digest"]

    if levels:
        edges = reduce(DataFrame.unionByName, [steps_up(x, fan_out) for x in levels])
        paths = jumped(edges, (-1, high, 0), max(0, most - 1 + high - 1).bit_length())
        runs = runs.select("*", *node_id("at")).join(paths.select(*(F.col(n).alias(f"at_{n}") for n in ID), "steps"), [f"at_{n}" for n in ID], "left")
    else:
        runs = runs.withColumn("steps", F.lit(None).cast(STEP))
    runs = runs.join(tops.select("tree", F.col("digest").alias("subroot")), "tree")
    each = runs.select("height", "subroot", "steps", F.col("of._leaf").alias("all"), F.posexplode("of").alias("pos", "one"))
    return each.select(
        *(F.col(f"one._c{i}").alias(c) for i, c in enumerate(carry)),
        F.col("one._leaf").alias("leaf"),
        F.array_join(F.slice("all", F.lit(1), F.col("pos")), "").alias("left"),
        F.array_join(F.slice("all", F.col("pos") + 2, F.lit(fan_out)), "").alias("right"),
        F.coalesce("steps", F.array().cast(STEP)).alias("steps"),
        (F.col("height") == 0).alias("alone"),
        "subroot",
        F.lit(root).alias("root"),
    )


def proof_digest() -> Column:
    """The digest of all siblings of a row of ``manifest``, level by level."""
    return digest(F.col("left"), F.col("right"), F.array_join(F.transform("steps", lambda s: F.concat(s["left"], s["right"])), ""))


def folded(found: Column) -> Column:
    """The root that the digest ``found`` gives with the siblings of a row of ``manifest``."""
    start = F.when(F.col("alone"), found).otherwise(digest(F.col("left"), found, F.col("right")))
    return F.aggregate("steps", start, lambda acc, s: F.sha2(F.concat(s["left"], acc, s["right"]), 256))


def op12_dataset_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    spoilt = F.translate("text", string.ascii_uppercase, string.ascii_lowercase)
    struck = F.crc32(F.col("doc_id").cast("string")) % 3 == 0
    leaves = docs.select("doc_id", "lang", leaf([F.col(f) for f in FIELDS]).alias("leaf"), F.when(struck, leaf([*(F.col(f) for f in FIELDS[:-1]), spoilt])).alias("found"))
    out = manifest(leaves, "lang", ["doc_id"], "leaf", ["doc_id", "found"])
    out = out.select("doc_id", "leaf", "subroot", "root", proof_digest().alias("proof_sha256"), folded(F.coalesce("found", "leaf")).alias("folded_root"))
    return out.withColumn("verified", F.col("folded_root") == F.col("root"))


def oracle(levels: int = 7, top_levels: int = 3) -> str:
    """DuckDB SQL of the query, for up to 8^levels rows a language and 8^top_levels languages."""
    field = lambda c: f"case when {c} is null then '-' else strlen({c}::varchar)::varchar || ':' || {c}::varchar end"
    of = lambda text: "sha256(" + " || ".join([*(field(c) for c in FIELDS[:-1]), field(text)]) + ")"
    low = f"translate(text, '{string.ascii_uppercase}', '{string.ascii_lowercase}')"
    out = [
        f"l as (select doc_id, lang, {of('text')} as leaf, case when {crc32_sql('doc_id::varchar')} % 3 = 0 then {of(low)} end as found from documents)",
        "x as (select *, row_number() over (partition by lang order by doc_id nulls first, leaf) - 1 as i from l)",
        "a0 as (select lang as g, i, leaf as d from x)",
    ]

    def climb(a: str, n: int) -> None:
        for k in range(1, n + 1):
            w = "partition by g, i // 8 order by i rows between"
            out.append(f"{a}s{k} as (select g, i, count(*) over (partition by g) as n, coalesce(string_agg(d, '') over ({w} unbounded preceding and 1 preceding), '') as l, coalesce(string_agg(d, '') over ({w} 1 following and unbounded following), '') as r from {a}{k - 1})")
            out.append(f"{a}{k} as (select g, i // 8 as i, case when max(n) > 1 then sha256(string_agg(d, '' order by i)) else min(d) end as d from (select *, count(*) over (partition by g) as n from {a}{k - 1}) group by g, i // 8)")

    climb("a", levels)
    out.append(f"b0 as (select 0 as g, row_number() over (order by g nulls first) - 1 as i, d, g as lang from a{levels})")
    climb("b", top_levels)
    out.append("p0 as (select x.doc_id, x.leaf, coalesce(x.found, x.leaf) as f, '' as proof, x.lang, x.i, b.i as j, b.d as subroot from x join b0 b on x.lang is not distinct from b.lang)")
    at = 0
    for a, place, on, n in (("a", "i", "s.g is not distinct from p.lang", levels), ("b", "j", "true", top_levels)):
        for k in range(1, n + 1):
            other = "j" if place == "i" else "i"
            out.append(f"p{at + 1} as (select doc_id, leaf, case when s.n > 1 then sha256(s.l || f || s.r) else f end as f, proof || s.l || s.r as proof, lang, p.{place} // 8 as {place}, p.{other}, subroot from p{at} p join {a}s{k} s on {on} and s.i = p.{place})")
            at += 1
    return f"with {', '.join(out)} select doc_id, leaf, subroot, d as root, sha256(proof) as proof_sha256, f as folded_root, f = d as verified from p{at}, b{top_levels}"
