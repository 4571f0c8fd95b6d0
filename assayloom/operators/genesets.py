"""Gene-set operators: over-representation, preranked enrichment, chains."""

from __future__ import annotations

import zlib

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from assayloom.functions.columns import bh
from assayloom.operators.results import first_by


def significant(d: DataFrame, alpha: float = 0.05, effect: float = 0.0, direction: str = "all") -> DataFrame:
    x = F.col("log2fc")
    side = {"all": F.abs(x) >= effect, "up": x >= effect, "down": x <= -effect}[direction]
    return d.where((F.col("padj") < alpha) & side)


def log_factorials(spark, n: int) -> DataFrame:
    """(k, lf) for k from 0 to n by a running sum of logarithms."""
    w = Window.orderBy("k").rowsBetween(Window.unboundedPreceding, 0)
    return spark.range(n + 1).select(F.col("id").alias("k"), F.when(F.col("id") > 0, F.log(F.col("id").cast("double"))).otherwise(0.0).alias("ln")).select("k", F.sum("ln").over(w).alias("lf"))


def ora(lists: DataFrame, sets: DataFrame, universe: int) -> DataFrame:
    """Overlap of each gene list (list_id, gene) with each set and the hypergeometric upper tail, adjusted within list and collection."""
    n = lists.groupBy("list_id").agg(F.countDistinct("gene").alias("n"))
    size = sets.groupBy("collection", "set_id").agg(F.countDistinct("gene").alias("m"))
    hits = lists.distinct().join(sets, "gene").groupBy("list_id", "collection", "set_id").agg(F.count(F.lit(1)).alias("k"), F.array_join(F.array_sort(F.collect_set("gene")), ";").alias("genes"))
    j = hits.join(size, ["collection", "set_id"]).join(n, "list_id")
    # the table of log factorials has universe + 1 entries and goes along as one array
    lf = log_factorials(lists.sparkSession, universe).agg(F.transform(F.sort_array(F.collect_list(F.struct("k", "lf"))), lambda x: x["lf"]).alias("lf"))
    j = j.join(F.broadcast(lf.withColumn("one", F.lit(1))), F.lit(1) == F.col("one"))
    tail = f"""aggregate(transform(sequence(k, least(n, m)), i -> case when n - i <= {universe} - m then
      exp(lf[int(m)] - lf[int(i)] - lf[int(m - i)] + lf[int({universe} - m)] - lf[int(n - i)] - lf[int({universe} - m - n + i)] - lf[{universe}] + lf[int(n)] + lf[int({universe} - n)]) else 0D end), 0D, (a, x) -> a + x)"""
    out = j.select("list_id", "collection", "set_id", "k", "m", "n", F.least(F.lit(1.0), F.expr(tail)).alias("p"), "genes")
    raw = out.withColumn("raw", bh(F.col("p"), "list_id", "collection"))
    w = Window.partitionBy("list_id", "collection").orderBy("p").rowsBetween(Window.currentRow, Window.unboundedFollowing)
    return raw.withColumn("q", F.min("raw").over(w)).drop("raw")


def ranking(d: DataFrame, metric: str = "stat", least: int = 100) -> DataFrame:
    """Genes of each result from the highest metric down, for results with enough genes; ties by name."""
    keys = ["study_id", "contrast_id", "method"]
    best = first_by(d.where(F.col(metric).isNotNull()), [*keys, "feature_id"], F.desc(F.abs(metric)))
    w = Window.partitionBy(*keys)
    out = best.select(*keys, F.col("feature_id").alias("gene"), F.col(metric).alias("score"), F.row_number().over(w.orderBy(F.desc(metric), "feature_id")).alias("rank"), F.count(F.lit(1)).over(w).alias("n"))
    return out.where(F.col("n") >= least)


#: Permutations that one task draws at a time.
BLOCK = 50


def enrichment_score(ranked: DataFrame, sets: DataFrame, least: int = 15, most: int = 500, weight: float = 1.0) -> DataFrame:
    """Weighted running-sum score of each set; only its hits are kept, misses follow from the ranks.

    Before and after each hit the sum can peak; of the two extremes the larger counts, a tie the positive.
    """
    keys = ["study_id", "contrast_id", "method"]
    hits = ranked.join(sets, "gene").withColumn("w", F.pow(F.abs("score"), F.lit(weight)))
    part = Window.partitionBy(*keys, "collection", "set_id")
    run = part.orderBy("rank").rowsBetween(Window.unboundedPreceding, 0)
    h = hits.select(*keys, "collection", "set_id", "gene", "rank", "n", "w", F.sum("w").over(run).alias("cum"), F.row_number().over(part.orderBy("rank")).alias("j"), F.sum("w").over(part).alias("total"), F.count(F.lit(1)).over(part).alias("size"))
    h = h.where(F.col("size").between(least, most) & (F.col("total") > 0) & (F.col("n") > F.col("size")))
    miss = (F.col("rank") - F.col("j")) / (F.col("n") - F.col("size"))
    h = h.withColumn("top", F.round(F.col("cum") / F.col("total") - miss, 12)).withColumn("low", F.round((F.col("cum") - F.col("w")) / F.col("total") - miss, 12))
    s = h.groupBy(*keys, "collection", "set_id", "size").agg(F.max("top").alias("top"), F.min("low").alias("low"), F.max_by("rank", F.struct("top", -F.col("rank"))).alias("top_at"), F.min_by("rank", F.struct("low", "rank")).alias("low_at"))
    up = F.col("top") >= -F.col("low")
    es = s.select(*keys, "collection", "set_id", "size", F.when(up, F.col("top")).otherwise(F.col("low")).alias("es"), F.when(up, F.col("top_at")).otherwise(F.col("low_at")).alias("peak"))
    lead = h.join(es.select(*keys, "collection", "set_id", "es", "peak"), [*keys, "collection", "set_id"]).where(((F.col("es") >= 0) & (F.col("rank") <= F.col("peak"))) | ((F.col("es") < 0) & (F.col("rank") >= F.col("peak"))))
    genes = lead.groupBy(*keys, "collection", "set_id").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("rank", "gene"))), lambda x: x["gene"]), ";").alias("lead_genes"))
    return es.join(genes, [*keys, "collection", "set_id"])


def gsea(ranked: DataFrame, sets: DataFrame, permutations: int = 1000, seed: int = 42, least: int = 15, most: int = 500) -> DataFrame:
    """Normalised score, nominal p and FDR q against gene permutations, seeded by the result's keys and so the same on any cluster.

    A permutation gives genes random ranks and keeps the scores at their ranks. The null of a set depends on its size alone, and the first k
    genes of a permutation are a random set of size k, so the same permutations serve all sizes of a result; they are drawn in blocks of
    BLOCK, each in one row of an Arrow batch. The nulls of a result's sets, which a library bounds, are pooled in one task.
    """
    keys = ["study_id", "contrast_id", "method"]
    observed = enrichment_score(ranked, sets, least, most)
    sizes = observed.groupBy(*keys).agg(F.array_sort(F.collect_set("size")).alias("sizes"))
    scores = ranked.groupBy(*keys).agg(F.transform(F.sort_array(F.collect_list(F.struct("rank", "score"))), lambda x: x["score"]).alias("scores"))
    blocks = sizes.join(scores, keys).withColumn("block", F.explode(F.sequence(F.lit(0), F.lit(-(-permutations // BLOCK) - 1))))

    def null(batches):
        for t in batches:
            out = []
            for r in t.itertuples(index=False):
                w, n, largest = np.abs(np.asarray(r.scores, dtype=float)), len(r.scores), int(max(r.sizes))
                rng = np.random.default_rng([seed, n, int(r.block), zlib.crc32(f"{r.study_id}|{r.contrast_id}|{r.method}".encode())])
                drawn = rng.permuted(np.tile(np.arange(n), (min(BLOCK, permutations - r.block * BLOCK), 1)), axis=1)[:, :largest]
                for size in map(int, r.sizes):
                    at = np.sort(drawn[:, :size], axis=1)
                    hit = w[at]
                    cum = np.cumsum(hit, axis=1)
                    total = np.maximum(cum[:, -1:], 1e-300)
                    miss = (at + 1 - np.arange(1, size + 1)) / max(n - size, 1)
                    top, low = (cum / total - miss).max(axis=1), ((cum - hit) / total - miss).min(axis=1)
                    out.append((r.study_id, r.contrast_id, r.method, size, r.block, np.where(top >= -low, top, low).tolist()))
            yield pd.DataFrame(out, columns=[*keys, "size", "block", "part"])

    parts = blocks.mapInPandas(null, "study_id string, contrast_id string, method string, size long, block int, part array<double>")
    nulls = parts.groupBy(*keys, "size").agg(F.flatten(F.transform(F.array_sort(F.collect_list(F.struct("block", "part"))), lambda x: x["part"])).alias("null"))
    result = [*keys, "collection", "set_id", "size", "es", "nes", "nom_p", "fdr_q", "lead_genes"]

    def judged(t: pd.DataFrame) -> pd.DataFrame:
        nes, p, pool = np.full(len(t), np.nan), np.full(len(t), np.nan), {True: [], False: []}
        for i, (es, drawn) in enumerate(zip(t["es"], t["null"], strict=True)):
            drawn = np.asarray(drawn)
            same = drawn[(drawn >= 0) == (es >= 0)]
            mean = abs(same.mean()) if len(same) else 0.0
            if mean > 0:
                nes[i], p[i] = es / mean, (np.abs(same) >= abs(es)).mean()
                pool[bool(es >= 0)].append(np.abs(same) / mean)
        q = np.full(len(t), np.nan)
        for side in (True, False):
            at = np.flatnonzero(~np.isnan(nes) & ((nes >= 0) == side))
            if len(at):
                drawn, real = np.sort(np.concatenate(pool[side])), np.sort(np.abs(nes[at]))
                above = lambda x, v: (len(x) - np.searchsorted(x, v)) / len(x)
                q[at] = np.minimum(1.0, above(drawn, np.abs(nes[at])) / above(real, np.abs(nes[at])))
        return t.assign(nes=nes, nom_p=p, fdr_q=q)[result]

    out = observed.join(nulls, [*keys, "size"]).groupBy(*keys).applyInPandas(judged, "study_id string, contrast_id string, method string, collection string, set_id string, size long, es double, nes double, nom_p double, fdr_q double, lead_genes string")
    known = lambda c: F.when(~F.isnan(c), F.col(c)).alias(c)
    return out.select(*(known(c) if c in ("nes", "nom_p", "fdr_q") else c for c in result))


def top_terms(g: DataFrame, n: int = 10, limit: float = 0.25) -> DataFrame:
    """The strongest terms up and down of each result, and how many are significant."""
    side = F.when(F.col("nes") >= 0, "up").otherwise("down")
    w = Window.partitionBy("study_id", "contrast_id", "side").orderBy(F.desc(F.abs("nes")), "set_id")
    counted = g.withColumn("side", side).withColumn("n_sig", F.count_if(F.col("fdr_q") < limit).over(Window.partitionBy("study_id", "contrast_id")))
    return counted.withColumn("place", F.row_number().over(w).cast("long")).where(F.col("place") <= n).select("study_id", "contrast_id", "side", "place", "set_id", "nes", "fdr_q", "n_sig")


def library_overlap(ranked_genes: DataFrame, sets: DataFrame) -> DataFrame:
    """How many genes of each collection a study knows."""
    known = ranked_genes.select("study_id", "gene").distinct()
    lib = sets.select("collection", "gene").distinct()
    size = lib.groupBy("collection").agg(F.count(F.lit(1)).alias("n_library"))
    return known.join(lib, "gene").groupBy("study_id", "collection").agg(F.count(F.lit(1)).alias("n_shared")).join(size, "collection").withColumn("share", F.round(F.col("n_shared") / F.col("n_library"), 6))


def enrichment_tables(g: DataFrame, sizes: DataFrame, limit: float = 0.25) -> tuple[DataFrame, DataFrame]:
    """Pathway rows (shared over studies) and enrichment rows of results under the limit."""
    e = g.where(F.col("fdr_q") < limit)
    pathway = e.select("set_id").distinct().join(sizes, "set_id", "left").select(F.concat(F.lit("path_"), F.lower("set_id")).alias("pathway_id"), "set_id", "n_members")
    rows = e.select("study_id", "contrast_id", F.concat(F.lit("path_"), F.lower("set_id")).alias("pathway_id"), "nes", "fdr_q", F.when(F.col("nes") >= 0, "up").otherwise("down").alias("direction"))
    at = F.row_number().over(Window.partitionBy("study_id").orderBy("contrast_id", "fdr_q", "pathway_id"))
    return pathway, rows.withColumn("enrichment_id", F.format_string("%s_enr%d", "study_id", at))


def pathway_consistency(rows: DataFrame) -> DataFrame:
    """In how many studies each pathway goes up or down."""
    return rows.groupBy("pathway_id").agg(F.countDistinct(F.when(F.col("direction") == "up", F.col("study_id"))).alias("up"), F.countDistinct(F.when(F.col("direction") == "down", F.col("study_id"))).alias("down"))


def mechanism_chain(g: DataFrame, sets: DataFrame, findings: DataFrame, limit: float = 0.25) -> DataFrame:
    """Significant sets of a study with the member genes that its findings report."""
    e = g.where(F.col("fdr_q") < limit).select("study_id", "contrast_id", "set_id", "nes", "fdr_q")
    reported = findings.select("study_id", F.col("symbol").alias("gene"), "source").distinct()
    hit = e.join(sets, "set_id").join(reported, ["study_id", "gene"]).groupBy("study_id", "contrast_id", "set_id").agg(F.countDistinct("gene").alias("n_reported"), F.array_join(F.array_sort(F.collect_set("gene")), ";").alias("reported_genes"))
    return e.join(hit, ["study_id", "contrast_id", "set_id"], "left").withColumn("n_reported", F.coalesce("n_reported", F.lit(0))).withColumn("support", F.when(F.col("n_reported") > 0, "genes_reported").otherwise("data_only"))


def top_set(g: DataFrame) -> DataFrame:
    """The set of each study with the least FDR; a tie goes by name."""
    return g.groupBy("study_id").agg(F.min_by("set_id", F.struct("fdr_q", "set_id")).alias("top_set"))


def chain_view(g: DataFrame, samples: DataFrame, alpha: float) -> DataFrame:
    """A readable line for each significant set of a study."""
    n = samples.groupBy("study_id").agg(F.count(F.lit(1)).alias("n"))
    way = F.when(F.col("nes") >= 0, "goes up").otherwise("goes down")
    return g.where(F.col("fdr_q") < alpha).join(n, "study_id").select(F.format_string("In %s, %s %s (%d samples)", "study_id", "set_id", way, "n").alias("line"))
