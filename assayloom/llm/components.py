"""Connected components of a link table, by contraction.

Each round every node points to the neighbour (or itself) with the smallest hash, links are rewritten to the nodes pointed
to, and loops and repeats go. A hash of node and round is as good as a random order, so a constant share of the nodes
disappears each round, long chains included. The round goes into the hash as a string: numbers become part of the code that Spark
compiles, strings don't, so all rounds share theirs and executors don't gather compiled classes. Rounds are written to the shared folder; the pointers are joined back
from the last round to the first. Hubs never meet in one task: minima are combined before the shuffle, and joins start
from written tables on both sides, so adaptive execution splits skewed keys.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from assayloom.llm._shared import written


def components(links: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(node, component) for every node of ``links`` (two columns of longs); component is the smallest node reachable.

    Links with a null end and loops are ignored; repeated links do no harm; an empty table gives an empty table.
    """
    now = written(links.select(F.col(a).alias("a"), F.col(b).alias("b")).where("a <> b"), "links")
    rounds: list[DataFrame] = []
    while not now.isEmpty():
        k = len(rounds)
        both = now.select(F.col("a").alias("node"), F.col("b").alias("other")).union(now.select("b", "a"))
        first = both.groupBy("node").agg(F.min(F.struct(F.xxhash64("other", F.lit(f"{k}")).alias("h"), "other")).alias("m"))
        own = F.struct(F.xxhash64("node", F.lit(f"{k}")).alias("h"), F.col("node").alias("other"))
        to = written(first.select("node", F.least("m", own)["other"].alias("to")), "pointers")
        rounds.append(to)
        left = now.join(to.select(F.col("node").alias("a"), F.col("to").alias("x")), "a").select("x", "b")
        moved = left.join(to.select(F.col("node").alias("b"), F.col("to").alias("y")), "b").where("x <> y")
        now = written(moved.select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")).distinct(), "links")
    if not rounds:
        return now.select(F.col("a").alias("node"), F.col("b").alias("component"))
    label = rounds[-1]
    for to in reversed(rounds[:-1]):
        up = label.select(F.col("node").alias("to"), F.col("to").alias("up"))
        label = to.join(up, "to", "left").select("node", F.coalesce("up", "to").alias("to"))
    if len(rounds) > 1:
        label = written(label, "labels")
    least = written(label.groupBy("to").agg(F.min(F.least("node", "to")).alias("component")), "least")
    return label.join(least, "to").select("node", "component")
