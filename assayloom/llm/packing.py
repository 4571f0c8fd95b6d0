"""Packing: optimal length buckets.

The histogram of token lengths is global and small: every length up to EXACT has its own bin, longer ones STEPS bins an octave.
Dynamic programming over it chooses the bucket boundaries that minimise padding exactly, a boundary being the longest length in
its last bin. Batches of at most ``budget`` padded tokens form inside each bucket. Numbering is distributed: rows are counted in
small shards by a hash, offsets are prefix sums over the counts, in two steps, and each shard numbers its own rows, so every
batch but the last of a bucket is full and no task sees a whole bucket.

Edge cases: a null text has length 0 and goes to the first bucket; a document longer than the budget is a batch of its own;
rows that repeat an id are packed each; an empty table gives no rows. Other columns are ignored.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from assayloom.llm._shared import table, written
from assayloom.llm.token_counts import token_counts

BUCKETS, BUDGET, EXACT, STEPS, SHARD_ROWS, RUN = 16, 65_536, 4_096, 256, 2_048, 1_024


def length_bin(n: Column) -> Column:
    return F.when(n <= EXACT, n).otherwise(F.lit(EXACT) + F.ceil(F.log2(n / EXACT) * STEPS)).cast("long")


def boundaries(hist: list[tuple[int, int, int]], buckets: int = BUCKETS) -> list[int]:
    """The upper lengths of at most ``buckets`` buckets with the least padding.

    ``hist``: (longest length, documents, tokens) of each bin, in the order of lengths.
    """
    if not hist:
        return []
    top, docs, tokens = (np.array(x, dtype=np.float64) for x in zip(*hist, strict=True))
    c, s = np.concatenate([[0], np.cumsum(docs)]), np.concatenate([[0], np.cumsum(tokens)])
    n, k = len(top), min(buckets, len(top))
    best = np.full(n + 1, np.inf)
    best[0] = 0
    choice = np.zeros((k, n + 1), dtype=np.int64)
    for b in range(k):
        after = np.full(n + 1, np.inf)
        after[0] = 0
        for j in range(1, n + 1):
            cost = best[:j] + (c[j] - c[:j]) * top[j - 1] - (s[j] - s[:j])
            choice[b, j] = i = int(np.argmin(cost))
            after[j] = cost[i]
        best = after
    cuts, j = [], n
    for b in range(k - 1, -1, -1):
        if j == 0:
            break
        cuts.append(int(top[j - 1]))
        j = choice[b, j]
    return cuts[::-1]


def pack(lengths: DataFrame, id_col: str = "doc_id", len_col: str = "n_tokens", buckets: int = BUCKETS, budget: int = BUDGET) -> DataFrame:
    """Bucket, batch and slot of every row of ``lengths``, which should be a written table: it is read three times."""
    n = F.col(len_col)
    hist = lengths.groupBy(length_bin(n).alias("bin")).agg(F.max(n).alias("top"), F.count(F.lit(1)).alias("docs"), F.sum(n).alias("tokens")).collect()
    tops = boundaries([(r["top"], r["docs"], r["tokens"]) for r in sorted(hist, key=lambda r: r["bin"])], buckets)
    shards = max(1, -(-sum(r["docs"] for r in hist) // SHARD_ROWS))
    bounds = F.array(*(F.lit(t).cast("long") for t in tops)) if tops else F.array().cast("array<bigint>")
    bucket = F.size(F.filter(bounds, lambda b: b < n))
    # null ids of one length can't be told apart, so any of them may go to any shard
    draw = F.when(F.col(id_col).isNull(), F.xxhash64(F.monotonically_increasing_id())).otherwise(F.xxhash64(id_col, len_col))
    rows = written(lengths.select(F.col(id_col), n.alias("n_tokens"), bucket.alias("bucket"), F.pmod(draw, F.lit(shards)).alias("shard")), "rows")
    counts = written(rows.groupBy("bucket", "shard").count().withColumn("run", F.floor(F.col("shard") / RUN)), "counts")
    # prefix sums in two steps, within runs of shards and over the runs of a bucket
    sums = counts.groupBy("bucket", "run").agg(F.sum("count").alias("n"))
    first = sums.select("bucket", "run", F.coalesce(F.sum("n").over(Window.partitionBy("bucket").orderBy("run").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("first"))
    within = F.coalesce(F.sum("count").over(Window.partitionBy("bucket", "run").orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    offsets = counts.withColumn("within", within).join(first, ["bucket", "run"]).select("bucket", "shard", (F.col("first") + F.col("within")).alias("offset"))
    own = F.row_number().over(Window.partitionBy("bucket", "shard").orderBy("n_tokens", id_col)) - 1
    placed = rows.withColumn("own", own).join(offsets, ["bucket", "shard"]).withColumn("place", F.col("offset") + F.col("own"))
    size = F.element_at(bounds, F.col("bucket") + 1)
    room = F.greatest(F.lit(1), F.floor(F.lit(budget) / F.greatest(size, F.lit(1)))).cast("long")
    return placed.select(
        id_col, "n_tokens", "bucket", size.alias("bucket_len"), F.floor(F.col("place") / room).cast("long").alias("batch"), (F.col("place") % room).cast("long").alias("slot"), (size - F.col("n_tokens")).alias("padding")
    )


def packed(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``pack`` for documents, with lengths counted by the tokenizer at ``path``."""
    return pack(written(token_counts(docs, path, id_col=id_col, text_col=text_col).select(id_col, "n_tokens"), "lengths"), id_col)


def op7_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return packed(table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"))
