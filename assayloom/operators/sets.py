"""Set operations, stability of repeated runs, evaluation against a reference."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from assayloom.functions.tables import once
from assayloom.operators.results import average_rank


def jaccard(shared: Column, a: Column, b: Column) -> Column:
    """Of two set sizes and what they share; two empty sets are alike."""
    return F.when(a + b == 0, 1.0).otherwise(shared / (a + b - shared))


def pairwise_overlap(items: DataFrame, owner: str, item: str) -> DataFrame:
    """Shared items and Jaccard of all pairs of owners that share any."""
    d = items.select(owner, item).distinct()
    n = d.groupBy(owner).agg(F.count(F.lit(1)).alias("n"))
    a, b = (d.select(F.col(owner).alias(f"{owner}_{x}"), item) for x in "ab")
    s = a.join(b, item).where(F.col(f"{owner}_a") < F.col(f"{owner}_b")).groupBy(f"{owner}_a", f"{owner}_b").agg(F.count(F.lit(1)).alias("shared"))
    for x in "ab":
        s = s.join(n.select(F.col(owner).alias(f"{owner}_{x}"), F.col("n").alias(f"n_{x}")), f"{owner}_{x}")
    return s.withColumn("jaccard", F.round(jaccard(F.col("shared"), F.col("n_a"), F.col("n_b")), 6))


def run_stability(runs: DataFrame, top: int = 50, alpha: float = 0.05) -> DataFrame:
    """Pairs of runs: common features, correlation, direction agreement, Jaccard of the top and of the significant sets."""
    w = Window.partitionBy("run_id").orderBy(F.coalesce("padj", F.lit(1.0)), F.desc(F.abs("log2fc")), "feature_id")
    r = runs.withColumn("in_top", F.row_number().over(w) <= top).withColumn("sig", F.coalesce(F.col("padj") < alpha, F.lit(False)))
    a, b = (r.select("feature_id", *(F.col(c).alias(f"{c}_{x}") for c in ("run_id", "log2fc", "in_top", "sig"))) for x in "ab")
    totals = r.groupBy("run_id").agg(F.count_if("in_top").alias("n_top"), F.count_if("sig").alias("n_sig"))
    moved = (F.col("log2fc_a") != 0) & (F.col("log2fc_b") != 0)
    p = (
        a.join(b, "feature_id")
        .where("run_id_a < run_id_b")
        .groupBy("run_id_a", "run_id_b")
        .agg(
            F.count(F.lit(1)).alias("n_common"),
            F.corr("log2fc_a", "log2fc_b").alias("pearson"),
            F.avg(F.when(moved, (F.signum("log2fc_a") == F.signum("log2fc_b")).cast("double"))).alias("direction"),
            F.count_if(F.col("in_top_a") & F.col("in_top_b")).alias("top_both"),
            F.count_if(F.col("sig_a") & F.col("sig_b")).alias("sig_both"),
        )
    )
    for x in "ab":
        p = p.join(totals.select(F.col("run_id").alias(f"run_id_{x}"), F.col("n_top").alias(f"top_{x}"), F.col("n_sig").alias(f"sig_{x}")), f"run_id_{x}")
    return p.select(
        "run_id_a", "run_id_b", "n_common", F.round("pearson", 6).alias("pearson"), F.round("direction", 6).alias("direction"), F.round(jaccard(F.col("top_both"), F.col("top_a"), F.col("top_b")), 6).alias("top_jaccard"), F.round(jaccard(F.col("sig_both"), F.col("sig_a"), F.col("sig_b")), 6).alias("sig_jaccard")
    )


def stability_verdict(pairs: DataFrame, stable: float = 0.80, moderate: float = 0.55) -> DataFrame:
    scores = [F.avg(c) for c in ("pearson", "direction", "top_jaccard", "sig_jaccard")]
    mean = F.expr("aggregate(array_compact(s), 0D, (a, x) -> a + x) / size(array_compact(s))")
    one = pairs.agg(F.array(*scores).alias("s"), F.count(F.lit(1)).alias("n_pairs")).select("n_pairs", F.round(mean, 6).alias("score"))
    return one.withColumn("verdict", F.when(F.col("score") >= stable, "stable").when(F.col("score") >= moderate, "moderate").otherwise("unstable"))


def concordance(d: DataFrame, ref: DataFrame, alpha: float = 0.05) -> DataFrame:
    """Agreement with a reference result over common features; one row.

    Pearson and Spearman correlation of effects (ranks of ties are averaged), agreement of signs where neither is zero, overlap of
    significant features, how much of what the reference finds is found with the same sign, and the correlation on what it finds
    (NULL for two features or fewer). A feature that the reference repeats counts by its most significant row. What is ranked is a
    row a common feature.
    """
    best = ref.groupBy("feature_id").agg(F.min_by(F.struct(F.col("log2fc").alias("y"), F.col("padj").alias("q")), F.struct("padj", "log2fc")).alias("r")).select("feature_id", "r.y", "r.q")
    j = d.select("feature_id", F.col("log2fc").alias("x"), F.col("padj").alias("p")).join(best, "feature_id").where("x is not null and y is not null")
    j = average_rank(average_rank(j.withColumn("k", F.lit(1)), ["k"], "x").withColumnRenamed("avg_rank", "rx"), ["k"], "y").withColumnRenamed("avg_rank", "ry")
    same, found, own = F.signum("x") == F.signum("y"), F.coalesce(F.col("q") < alpha, F.lit(False)), F.coalesce(F.col("p") < alpha, F.lit(False))
    r = lambda c: F.round(c, 6)
    return j.agg(
        F.count(F.lit(1)).alias("n"),
        r(F.corr("x", "y")).alias("pearson"),
        r(F.corr("rx", "ry")).alias("spearman"),
        r(F.avg(F.when((F.col("x") != 0) & (F.col("y") != 0), same.cast("double")))).alias("sign_agreement"),
        F.count_if(found).alias("n_reference"),
        F.count_if(own).alias("n_own"),
        r(F.try_divide(F.count_if(found & own), F.count_if(found | own))).alias("jaccard"),
        r(F.try_divide(F.count_if(found & own & same), F.count_if(found))).alias("recovery"),
        r(F.when(F.count_if(found) > 2, F.corr(F.when(found, F.col("x")), F.when(found, F.col("y"))))).alias("pearson_found"),
    )


def row_counts(rows: DataFrame, table: str, run: str, runs: list[str]) -> DataFrame:
    """Rows of each table in each run, a column a run, 0 where a run has none."""
    p = rows.groupBy(table).pivot(run, runs).count()
    return p.select(table, *(F.coalesce(F.col(f"`{r}`"), F.lit(0)).alias(r.lower()) for r in runs))


def set_stability(items: DataFrame, runs: int) -> DataFrame:
    """Items of a key in all runs, in any, and in one only."""
    n = items.groupBy("key", "item").agg(F.countDistinct("run_id").alias("r"))
    return n.groupBy("key").agg(F.count_if(F.col("r") == runs).alias("n_all"), F.count(F.lit(1)).alias("n_any"), F.count_if(F.col("r") == 1).alias("n_single"))


def shared_claims(claims: DataFrame) -> DataFrame:
    """A resource claimed by several owners turns the verdict of each."""
    n = claims.groupBy("resource").agg(F.countDistinct("owner").alias("n_owners"))
    return claims.join(n, "resource").select("owner", "resource", "n_owners").withColumn("verdict", F.when(F.col("n_owners") > 1, "shared").otherwise("own"))


def kept_rows(keys: DataFrame, order: str) -> DataFrame:
    """(``order``, key): rows of ``keys`` that are kept, with their keys. Going by ``order``, a row is kept if no row kept before it has one of its keys.

    Settled in rounds: a row that is the first at all its keys is kept, and all others that have a key of it are out. What is out no
    longer stands in the way, so each round has new firsts, until none is left.
    """
    open_rows, kept = once(keys), None
    while not open_rows.isEmpty():
        first = open_rows.withColumn("first", F.min(order).over(Window.partitionBy("key")))
        mine = first.groupBy(order).agg(F.bool_and(F.col("first") == F.col(order)).alias("all")).where("all").select(order)
        new = once(open_rows.join(mine, order, "left_semi"))
        kept = new if kept is None else once(kept.unionByName(new))
        out = open_rows.join(new.select("key").distinct(), "key", "left_semi").select(order).distinct()
        open_rows = once(open_rows.join(out, order, "left_anti"))
    return keys.limit(0) if kept is None else kept


def dedupe_multi_key(df: DataFrame, keys: list[str], fill: list[str], order: str) -> DataFrame:
    """One row for each identity, in the order of ``order``: a row with a key of a kept row before it is a duplicate of that row, else it is kept.

    A duplicate's own keys aren't registered, so two rows that only a duplicate connects both stay. With keys of several kept rows it
    belongs to the one of its first key, in the order of ``keys``. Missing fields are filled from the duplicates, the
    first one first. Null keys are none; ``order`` is unique.
    """
    given = df.select(order, F.explode(F.array_compact(F.array(*(F.when(F.col(k).isNotNull(), F.struct(F.lit(i).alias("place"), F.concat(F.lit(f"{k}:"), F.col(k).cast("string")).alias("key"))) for i, k in enumerate(keys))))).alias("k"))
    given = once(given.select(order, "k.place", "k.key"))
    kept = kept_rows(given.select(order, "key"), order).select(F.col(order).alias("owner"), "key")
    owners = given.join(kept, "key").where(F.col("owner") <= F.col(order)).groupBy(order).agg(F.min_by("owner", "place").alias("root"))
    rows = df.join(owners, order, "left").withColumn("root", F.coalesce("root", order))
    first = [F.min_by(c, F.when(F.col(c).isNotNull(), F.col(order))).alias(c) for c in [*keys, *fill]]
    return rows.groupBy("root").agg(*first, F.count(F.lit(1)).alias("n_merged")).withColumnRenamed("root", order)


def title_key(title: Column, size: int = 80) -> Column:
    """A title's letters and digits in lower case, the first ``size``; NULL where there are none."""
    return F.nullif(F.substring(F.regexp_replace(F.lower(title), r"[^\p{L}\p{N}_]+", ""), 1, size), F.lit(""))


def token_recall(got: DataFrame, gold: DataFrame, least: float = 0.6) -> DataFrame:
    """Best share of a gold item's tokens in any candidate of its key, and whether that counts as found.

    A token's row names its text by a digest; texts themselves are joined once, to the result.
    """
    words = F.array_distinct(F.filter(F.split(F.lower("text"), "[^a-z0-9]+"), lambda x: x != ""))
    items = lambda df: df.select("key", "text").distinct().select("key", "text", F.unhex(F.md5(F.col("text").cast("binary"))).alias("id"), words.alias("w"))
    tokens = lambda df, name: df.select("key", F.col("id").alias(name), F.explode("w").alias("token"))
    size = items(gold).where(F.size("w") > 0)
    hit = tokens(items(gold), "id").join(tokens(items(got), "got"), ["key", "token"]).groupBy("key", "id", "got").agg(F.count(F.lit(1)).alias("k"))
    best = hit.groupBy("key", "id").agg(F.max("k").alias("k"))
    share = F.round(F.coalesce(F.col("k"), F.lit(0)) / F.col("n"), 6)
    texts = size.select("key", "id", F.col("text").alias("gold"), F.size("w").alias("n"))
    return texts.join(best, ["key", "id"], "left").select("key", "gold", share.alias("share"), (share >= least).alias("found"))


def field_stability(rows: DataFrame, runs: int, fields: list[str]) -> DataFrame:
    """Share of keys with the same value of a field in all runs; a difference in case only is counted apart."""
    flat = rows.select("run_id", "key", F.explode(F.map_from_arrays(F.array(*map(F.lit, fields)), F.array(*(F.col(f).cast("string") for f in fields)))).alias("field", "value"))
    k = flat.groupBy("field", "key").agg(F.countDistinct(F.coalesce("value", F.lit("\0"))).alias("v"), F.countDistinct(F.lower(F.coalesce("value", F.lit("\0")))).alias("f"), F.countDistinct("run_id").alias("r")).where(F.col("r") == runs)
    return k.groupBy("field").agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("v") == 1).alias("same"), F.count_if((F.col("v") > 1) & (F.col("f") == 1)).alias("case_only"))


def output_hash(rows: DataFrame, key: str, columns: list[str]) -> DataFrame:
    """One digest for each key that depends on the rows and how often each is there, not on their order.

    Row digests are added up, word by word of 64 bits as exact decimals, so a key is a few partial sums, whatever its rows. Two outputs
    with the same digest and count have the same rows but for a chance of about 2^-256.
    """
    text = F.concat_ws("|", *(F.coalesce(F.concat(F.octet_length(F.col(c).cast("string")).cast("string"), F.lit(":"), F.col(c).cast("string")), F.lit("~")) for c in columns))
    d = rows.select(key, F.sha2(text, 256).alias("d"))
    word = lambda i: F.conv(F.substring("d", 16 * i + 1, 16), 16, 10).cast("decimal(28,0)")
    sums = d.groupBy(key).agg(F.count(F.lit(1)).alias("n"), *(F.sum(word(i)).alias(f"w{i}") for i in range(4)))
    return sums.select(key, "n", F.sha2(F.concat_ws(",", *(F.col(f"w{i}").cast("string") for i in range(4))), 256).alias("digest"))


def union_minus(batches: list[DataFrame], counted: DataFrame, key: str, order: str) -> DataFrame:
    """Rows of all batches by ``key``, but for the keys already counted: the first in ``order`` and how many there are."""
    new = batches[0].select(key, order)
    for b in batches[1:]:
        new = new.union(b.select(key, order))
    return new.join(counted.select(key).distinct(), key, "left_anti").groupBy(key).agg(F.min(order).alias(f"first_{order}"), F.count(F.lit(1)).alias("n"))


def lcs(x: list, y: list) -> int:
    """Length of the longest common subsequence; a row of the table is the bits of one number."""
    places: dict = {}
    for j, q in enumerate(y):
        places[q] = places.get(q, 0) | 1 << j
    row, full = 0, (1 << len(y)) - 1
    for p in x:
        more = row | places.get(p, 0)
        row = (more & ~(more - ((row << 1) | 1))) & full
    return row.bit_count()


def rouge_l(pairs: DataFrame, a: str, b: str) -> DataFrame:
    """F1 of the longest common subsequence of words, in Arrow batches."""
    import pandas as pd

    def f1(x, y):
        out = []
        for p, q in zip(x, y, strict=True):
            p, q = (p or "").lower().split(), (q or "").lower().split()
            n = lcs(p, q)
            out.append(1.0 if not p and not q else 2 * n / (len(p) + len(q)) if n else 0.0)
        return pd.Series(out)

    return pairs.withColumn("rouge_l", F.pandas_udf(f1, "double", F.PandasUDFType.SCALAR)(a, b))


def rouge_stability(values: DataFrame, key: str, run: str, text: str, least: float = 0.9) -> DataFrame:
    """ROUGE-L of all pairs of a key's runs: number, mean, minimum, and the pairs below ``least`` (as ``run|run``, in order)."""
    x, y = (values.select(key, F.col(run).alias(f"run_{k}"), F.col(text).alias(f"text_{k}")) for k in "xy")
    scored = rouge_l(x.join(y, key).where("run_x < run_y"), "text_x", "text_y")
    low = F.when(F.col("rouge_l") < least, F.struct("run_x", "run_y"))
    pairs = F.transform(F.array_sort(F.collect_list(low)), lambda p: F.concat_ws("|", p["run_x"].cast("string"), p["run_y"].cast("string")))
    return scored.groupBy(key).agg(F.count(F.lit(1)).alias("n_pairs"), F.round(F.avg("rouge_l"), 6).alias("mean"), F.round(F.min("rouge_l"), 6).alias("least"), F.array_join(pairs, ",").alias("below"))


def gold_verdicts(contrasts: DataFrame, samples: DataFrame, gold: DataFrame) -> DataFrame:
    """Whether the arms of a contrast hold the samples that the gold roles (exercise, rest) put there."""
    j = contrasts.join(samples, "study_id").join(gold, ["study_id", "sample_id"], "left")
    n = lambda arm, role: F.count_if((F.col("condition") == F.col(arm)) & (F.col("role") == role))
    c = j.groupBy("study_id", "contrast").agg(n("treatment", "exercise").alias("te"), n("treatment", "rest").alias("tr"), n("control", "exercise").alias("ce"), n("control", "rest").alias("cr"))
    te, tr, ce, cr = map(F.col, ("te", "tr", "ce", "cr"))
    verdict = F.when((te + tr == 0) | (ce + cr == 0), "unscorable").when((te > tr) & (cr > ce), "correct").when((tr > te) & (ce > cr), "reversed").otherwise("mixed")
    return c.withColumn("verdict", verdict)
