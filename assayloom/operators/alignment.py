"""Matrix columns to metadata rows where names differ: exact names, names inside texts, shared tokens; one to one, all studies at once.

A level has candidates, found by index: a name can only stand in a text that holds the name's rarest n-gram; a name and a text that share
``tokens`` tokens share one outside each side's ``tokens`` - 1 most frequent ones. Each candidate is verified whole.

Who gets whom is the greedy order of the rows: the first row takes its best column, the next one its best of what is left, and so on. That is
settled without going row by row: every row asks for its best column; a column refuses all rows behind the first that asks;
who is refused asks for the next. Rows are ranked alike by all columns, so the outcome is the greedy one, whatever the order of
asking. A round is two windows over the candidates that are left, and a round without refusals ends it.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from assayloom.functions.tables import once

#: Fixed value: what counts as a token.
TOKEN = "[A-Za-z][A-Za-z0-9]+|[0-9]+"
GRAM = 3
LEVELS = ("exact", "substring", "token_overlap")


def tokens_of(text: Column) -> Column:
    return F.array_distinct(F.transform(F.regexp_extract_all(text, F.lit(TOKEN), F.lit(0)), F.lower))


def grams_of(text: Column, n: Column) -> Column:
    """Distinct n-grams of ``text``; none where it is shorter."""
    every = F.transform(F.sequence(F.lit(1), F.greatest(F.length(text) - n + 1, F.lit(1))), lambda i: F.substring(text, i, n))
    return F.when(F.length(text) >= n, F.array_distinct(every)).otherwise(F.array().cast("array<string>"))


def inside(names: DataFrame, texts: DataFrame) -> DataFrame:
    """(study_id, col, row): names (study_id, col, low) that stand in texts (study_id, row, text). A name shorter than GRAM is its own gram."""
    names = names.where(F.length("low") > 0)
    own = names.select("study_id", "col", "low", F.explode(grams_of(F.col("low"), F.least(F.length("low"), F.lit(GRAM)))).alias("gram"))
    sizes = F.array(*map(F.lit, range(1, GRAM + 1)))
    held = texts.select("study_id", "row", F.explode(F.array_distinct(F.flatten(F.transform(sizes, lambda n: grams_of(F.col("text"), n))))).alias("gram"))
    held = once(held.join(own.select("study_id", "gram").distinct(), ["study_id", "gram"]))
    often = held.groupBy("study_id", "gram").agg(F.count(F.lit(1)).alias("n"))
    # a gram that no text holds leaves its name without candidates
    rarest = own.join(often, ["study_id", "gram"], "left").groupBy("study_id", "col", "low").agg(F.min_by("gram", F.struct(F.coalesce("n", F.lit(0)), F.col("gram"))).alias("gram"))
    pairs = rarest.join(held, ["study_id", "gram"]).select("study_id", "col", "low", "row")
    return pairs.join(texts, ["study_id", "row"]).where(F.contains("text", "low")).select("study_id", "col", "row")


def sharing(left: DataFrame, right: DataFrame, tokens: int) -> DataFrame:
    """(study_id, col, row, score): names and texts with ``tokens`` tokens or more in common. Frequent tokens pair nobody by themselves."""
    a = left.select("study_id", "col", tokens_of(F.col("col")).alias("a")).where(F.size("a") >= tokens)
    b = right.select("study_id", "row", tokens_of(F.col("text")).alias("b")).where(F.size("b") >= tokens)
    often = b.select("study_id", F.explode("b").alias("token")).groupBy("study_id", "token").agg(F.count(F.lit(1)).alias("n"))

    def rare(side: DataFrame, key: str, words: str) -> DataFrame:
        """Rows by each of their rare tokens, with all tokens and the rare ones."""
        each = side.select("study_id", key, words, F.explode(words).alias("token")).join(often, ["study_id", "token"], "left")
        ranked = each.groupBy("study_id", key).agg(F.first(words).alias(words), F.sort_array(F.collect_list(F.struct((-F.coalesce("n", F.lit(0))).alias("n"), "token"))).alias("l"))
        kept = F.slice(F.col("l")["token"], F.lit(tokens), F.size("l"))
        return ranked.select("study_id", key, words, kept.alias(f"rare_{words}")).select("*", F.explode(f"rare_{words}").alias("token"))

    # a pair counts at the first rare token that both have, so pairs needn't be told apart and nothing is held but the sides of the join
    meet = rare(a, "col", "a").join(rare(b, "row", "b"), ["study_id", "token"])
    once_each = meet.where(F.col("token") == F.array_min(F.array_intersect("rare_a", "rare_b")))
    return once_each.select("study_id", "col", "row", F.size(F.array_intersect("a", "b")).alias("score")).where(F.col("score") >= tokens)


def assigned(edges: DataFrame, keys: list[str], rounds: int = 10_000) -> DataFrame:
    """The pairs of ``edges`` (keys, row, col, score) that the greedy order of rows gives: each its best column that no row before it took.

    A row's best is the highest score, then the first column by name. ``rounds`` only guards against an endless loop.
    """
    edges = once(edges.select(*keys, "row", "col", "score"))
    n = edges.count()
    best = Window.partitionBy(*keys, "row").orderBy(F.desc("score"), "col")
    for _ in range(rounds):
        asks = edges.withColumn("place", F.row_number().over(best))
        first = F.min(F.when(F.col("place") == 1, F.col("row"))).over(Window.partitionBy(*keys, "col"))
        left = once(asks.withColumn("first", first).where(F.col("first").isNull() | (F.col("row") <= F.col("first"))).select(*keys, "row", "col", "score"))
        m, n = n, left.count()
        edges = left
        if m == n:
            break
    return edges.withColumn("place", F.row_number().over(best)).where("place = 1").select(*keys, "row", "col")


def align_cascade(columns: DataFrame, attrs: DataFrame, share: float = 0.5, tokens: int = 3) -> DataFrame:
    """(study_id, matrix_column, sample_id, level): the first level of each study that pairs at least ``share`` of its smaller side.

    Level 1 are equal names. Levels 2 (the name, in lower case, stands in the row's values) and 3 (shared tokens) keep the equal names
    and pair what is left. Rows come in the order of their ids, columns in the order of their names. A study that no level pairs has
    no rows; null names and values count for nothing.
    """
    m = once(columns.where(F.col("sample_id").isNotNull()).select("study_id", F.col("sample_id").alias("col")).distinct())
    rows = attrs.where(F.col("sample_id").isNotNull()).groupBy("study_id", F.col("sample_id").alias("row"))
    rows = once(rows.agg(F.lower(F.concat_ws(" ", F.sort_array(F.collect_list("value")))).alias("text")))
    exact = once(m.join(rows.select("study_id", F.col("row").alias("col")), ["study_id", "col"]))
    left = m.join(exact, ["study_id", "col"], "left_anti").withColumn("low", F.lower("col"))
    open_rows = rows.join(exact.withColumnRenamed("col", "row"), ["study_id", "row"], "left_anti")
    size = m.groupBy("study_id").agg(F.count(F.lit(1)).alias("nm")).join(rows.groupBy("study_id").agg(F.count(F.lit(1)).alias("nr")), "study_id")
    need = size.select("study_id", F.greatest(F.lit(1), F.ceil(F.least("nm", "nr") * share)).alias("need"))
    done = exact.groupBy("study_id").agg(F.count(F.lit(1)).alias("k")).join(need, "study_id").where("k >= need").select("study_id")
    waiting = once(need.join(done, "study_id", "left_anti"))
    left, open_rows = (once(x.join(waiting.select("study_id"), "study_id")) for x in (left, open_rows))
    edges = inside(left, open_rows).select("study_id", F.lit(2).alias("level"), "row", "col", F.lit(0).alias("score"))
    edges = edges.unionByName(sharing(left, open_rows, tokens).select("study_id", F.lit(3).alias("level"), "row", "col", F.col("score").cast("int").alias("score")))
    pairs = assigned(edges, ["study_id", "level"])
    kept = waiting.select("study_id", F.explode(F.array(F.lit(2), F.lit(3))).alias("level")).join(exact, "study_id").select("study_id", "level", F.col("col").alias("row"), "col")
    pairs = once(pairs.unionByName(kept))
    enough = pairs.groupBy("study_id", "level").agg(F.count(F.lit(1)).alias("k")).join(waiting, "study_id").where("k >= need").groupBy("study_id").agg(F.min("level").alias("level"))
    first = exact.join(done, "study_id").select("study_id", "col", F.col("col").alias("row"), F.lit(1).alias("level"))
    later = pairs.join(enough, ["study_id", "level"]).select("study_id", "col", "row", "level")
    return first.unionByName(later).select("study_id", F.col("col").alias("matrix_column"), F.col("row").alias("sample_id"), "level")
