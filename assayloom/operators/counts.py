"""Count models: the negative-binomial Wald test with its shrunken effects; quasi-likelihood and precision weights are in modules of their own.

Features are packed, joined with a row of samples a study and fitted in Arrow batches, all features of a batch at once. Trends and
prior widths are aggregates over features between two passes; nothing is collected.
"""

from __future__ import annotations

import math
from functools import cache

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from assayloom.functions.tables import once, stored
from assayloom.operators.negbin import GRID, best, by_study, designs, fit_means, information, inverted, lgamma, numbers, packed_rows, profile, with_columns
from assayloom.operators.precision import voom_test
from assayloom.operators.quasi import ql_test
from assayloom.operators.stats import beta_tail, gathered, gathered_size_factors, trigamma

__all__ = ["independent_filter", "lgamma", "nb_wald", "ql_test", "shrink", "voom_test"]
FLOOR = 0.25


def gene_dispersion(y: np.ndarray, x: np.ndarray, size: np.ndarray) -> np.ndarray:
    """The dispersion of each row on its own: top of its profile at means that are fitted with it."""
    start = np.full(len(y), 0.1)
    for _ in range(2):
        _, mu, _ = fit_means(y, x, np.log(size), start)
        start = best(profile(y, mu, x))
    return start


def genewise(features: DataFrame, terms: list[str]) -> DataFrame:
    """``features`` with base mean, gene-wise dispersion and residual degrees of freedom, without what is their study's."""

    def run(batches):
        for _, rows, y, _, x, size in by_study(batches, terms):
            yield with_columns(rows, ["study_id", "feature_id", "y"], {"base_mean": (y / size).mean(axis=1), "dispersion": gene_dispersion(y, x, size), "df": float(x.shape[0] - x.shape[1])})

    return features.mapInArrow(run, "study_id string, feature_id string, y array<double>, base_mean double, dispersion double, df double")


#: Fixed values of the published trend: least dispersion that counts, ratios to the trend that count, coefficients to begin with.
USED, RATIOS, BEGIN = 1e-6, (1e-4, 15.0), (0.1, 1.0)
#: Standard deviations of log dispersions above the trend at which a feature keeps its own.
OUTLYING = 2.0


def trends(g: DataFrame, rounds: int = 30, near: float = 1e-12) -> DataFrame:
    """(study_id, a0, a1, spread, sd): dispersion a0 + a1 / mean, the spread and the standard deviation of logs around it.

    A gamma regression with identity link: each round adds up weighted normal equations by study, over the features whose
    ratio to the last trend is within RATIOS, and solves them in two columns; all studies go on until none changes. A study whose
    coefficients turn negative or don't settle takes the mean dispersion as a flat trend. ``g`` is a written table.
    """
    use = g.where(f"dispersion > {USED} and base_mean > 0").select("study_id", F.col("base_mean").alias("m"), F.col("dispersion").alias("a"), "df")
    state = once(use.groupBy("study_id").agg(F.lit(BEGIN[0]).alias("a0"), F.lit(BEGIN[1]).alias("a1"), F.lit(float("inf")).alias("change")))
    fit, ratio = F.col("a0") + F.col("a1") / F.col("m"), F.col("a") / (F.col("a0") + F.col("a1") / F.col("m"))
    w = F.when((ratio > RATIOS[0]) & (ratio < RATIOS[1]), 1 / (fit * fit))
    x = 1 / F.col("m")
    c = F.col
    for _ in range(rounds):
        sums = use.join(state, "study_id").where("a0 > 0 and a1 > 0").groupBy("study_id").agg(F.max("a0").alias("b0"), F.max("a1").alias("b1"), F.sum(w).alias("s"), F.sum(w * x).alias("sx"), F.sum(w * x * x).alias("sxx"), F.sum(w * c("a")).alias("sa"), F.sum(w * x * c("a")).alias("sxa"))
        det = c("s") * c("sxx") - c("sx") * c("sx")
        a0, a1 = F.try_divide(c("sxx") * c("sa") - c("sx") * c("sxa"), det), F.try_divide(c("s") * c("sxa") - c("sx") * c("sa"), det)
        solved = sums.select("study_id", "b0", "b1", F.coalesce(a0, F.lit(-1.0)).alias("a0"), F.coalesce(a1, F.lit(-1.0)).alias("a1"))
        moved = F.when((c("a0") > 0) & (c("a1") > 0), F.pow(F.log(c("a0") / c("b0")), 2) + F.pow(F.log(c("a1") / c("b1")), 2)).otherwise(0.0)
        new = solved.select("study_id", "a0", "a1", moved.alias("change"))
        failed = state.where("a0 <= 0 or a1 <= 0").select("study_id", "a0", "a1", F.lit(0.0).alias("change"))
        state = once(new.unionByName(failed))
        if (state.agg(F.max("change")).first()[0] or 0.0) < near:
            break
    flat = use.groupBy("study_id").agg(F.avg("a").alias("mean"))
    good = (c("a0") > 0) & (c("a1") > 0) & (c("change") < near)
    line = state.join(flat, "study_id").select("study_id", F.when(good, c("a0")).otherwise(c("mean")).alias("a0"), F.when(good, c("a1")).otherwise(0.0).alias("a1"))
    r = use.join(line, "study_id").withColumn("r", F.log("a") - F.log(fit))

    def chance(df: pd.Series) -> pd.Series:
        return pd.Series(trigamma(df.to_numpy() / 2))

    mid = r.groupBy("study_id").agg(F.percentile("r", F.lit(0.5)).alias("mid"))
    mad = r.join(mid, "study_id").groupBy("study_id", "a0", "a1").agg((1.4826 * F.percentile(F.abs(c("r") - c("mid")), F.lit(0.5))).alias("sd"), F.first("df").alias("df"))
    noise = F.pandas_udf(chance, "double")("df")
    return mad.select("study_id", "a0", "a1", F.greatest(F.lit(FLOOR), c("sd") * c("sd") - noise).alias("spread"), "sd")


#: Fixed values of the published outlier rule: share trimmed at each end and scale of a trimmed variance, for up to 3, 23 and more samples.
TRIM, SCALE = (1 / 3, 1 / 4, 1 / 8), (2.04, 1.86, 1.51)
REPLACED, FILTERED = 7, 3


def trimmed(v: np.ndarray, share: float) -> np.ndarray:
    """Row means without the share of lowest and highest values."""
    cut = int(v.shape[1] * share)
    return np.sort(v, axis=1)[:, cut : v.shape[1] - cut].mean(axis=1)


def cooks(y: np.ndarray, mu: np.ndarray, x: np.ndarray, alpha: np.ndarray, size: np.ndarray, cells: np.ndarray) -> np.ndarray:
    """Cook's distance of each count; the variance has a dispersion by trimmed moments within cells, so that an outlier doesn't hide itself."""
    q, n = y / size, np.bincount(cells)
    v = np.zeros(len(y))
    for cell in np.flatnonzero(n >= FILTERED):
        part, k = q[:, cells == cell], int(np.searchsorted([3, 23], n[cell]))
        v = np.maximum(v, SCALE[k] * trimmed((part - trimmed(part, TRIM[k])[:, None]) ** 2, TRIM[k]))
    if n.max() < FILTERED:
        v = SCALE[2] * trimmed((q - trimmed(q, TRIM[2])[:, None]) ** 2, TRIM[2])
    mean = q.mean(axis=1)
    robust = np.maximum(0.04, (v - mean) / np.maximum(mean, 1e-8) ** 2)[:, None]
    w = mu / (1 + alpha[:, None] * mu)
    inverse = inverted(information(w, x))
    h = np.clip(w * (inverse.reshape(len(w), -1) @ (x[:, :, None] * x[:, None, :]).reshape(len(x), -1).T), 0, 1 - 1e-9)
    return (y - mu) ** 2 / (mu + robust * mu * mu) / x.shape[1] * h / (1 - h) ** 2


@cache
def f_quantile(p: float, a: int, b: int) -> float:
    """The p-quantile of Fisher's F by halving."""
    low, high = 0.0, 1.0
    for _ in range(80):
        x = (low + high) / 2
        low, high = (x, high) if beta_tail(np.array(a / 2), np.array(b / 2), np.array(x)) < p else (low, x)
    return b * x / (a * (1 - x))


def nb_wald(m: DataFrame, s: DataFrame, terms: list[str], coefficient: str, method: str = "nb_wald") -> DataFrame:
    """Dispersions shrunken to the trend, Wald statistic and normal p-value of a coefficient (``term=level``), its shrunken effect beside it.

    A feature whose own dispersion is far above the trend (OUTLYING) keeps it.

    The shrunken effect has a heavy-tailed prior (Cauchy) whose scale is the spread of the estimates in its study; statistic and p-value
    stay those of the plain estimate. Counts beyond the 0.99 quantile of Cook's distance are replaced by the feature's trimmed mean and
    the feature is fitted again where a cell of the design has seven samples or more; in cells of three to six its p-value is NULL.
    """
    rows = stored(gathered(m))
    lists = once(designs(s, terms, gathered_size_factors(rows), "size_factor"))
    features = stored(genewise(packed_rows(rows, lists), terms))

    def fit(y, x, size, own, a0, a1, spread, sd):
        mean = (y / size).mean(axis=1)
        line = a0 + a1 / np.maximum(mean, 1e-8)
        _, mu, _ = fit_means(y, x, np.log(size), line)
        alpha = best(profile(y, mu, x) - (np.log(GRID)[None, :] - np.log(line)[:, None]) ** 2 / (2 * spread))
        alpha = np.where(np.log(own) > np.log(line) + OUTLYING * sd, own, alpha)
        return mean, alpha, *fit_means(y, x, np.log(size), alpha)

    def run(batches):
        for _, rows, y, names, x, size in by_study(batches, terms):
            if coefficient not in names:
                continue
            k, trend = names.index(coefficient), [rows.column(c)[0].as_py() for c in ("a0", "a1", "spread", "sd")]
            own = numbers(rows, "dispersion")
            mean, alpha, beta, mu, inverse = fit(y, x, size, own, *trend)
            cells = np.unique(x, axis=0, return_inverse=True)[1].ravel()
            n = np.bincount(cells)[cells]
            far = cooks(y, mu, x, alpha, size, cells) > f_quantile(0.99, x.shape[1], len(x) - x.shape[1])
            again = np.flatnonzero((far & (n >= REPLACED)).any(axis=1))
            if len(again):
                usual = np.floor(trimmed(y[again] / size, 0.2)[:, None] * size)
                mended = np.where(far[again] & (n >= REPLACED), usual, y[again])
                _, alpha[again], beta[again], _, inverse[again] = fit(mended, x, size, gene_dispersion(mended, x, size), *trend)
            se = np.sqrt(inverse[:, k, k])
            z = beta[:, k] / se
            p = np.array([math.erfc(abs(v) / math.sqrt(2)) for v in z])
            p[(far & (n >= FILTERED) & (n < REPLACED)).any(axis=1)] = np.nan
            yield with_columns(rows, ["study_id", "feature_id"], {"base_mean": mean, "log2fc": beta[:, k] / math.log(2), "lfc_se": se / math.log(2), "stat": z, "pvalue": p, "dispersion": alpha})

    form = "study_id string, feature_id string, base_mean double, log2fc double, lfc_se double, stat double, pvalue double, dispersion double"
    known = lists.drop("__order").join(trends(features), "study_id")
    out = stored(features.select("study_id", "feature_id", "y", "dispersion").join(F.broadcast(known), "study_id").mapInArrow(run, form))
    named = out.select("study_id", F.lit(coefficient).alias("contrast_id"), F.lit(method).alias("method"), "feature_id", "base_mean", "log2fc", "lfc_se", "stat", F.when(~F.isnan("pvalue"), F.col("pvalue")).alias("pvalue"), "dispersion")
    return shrink(named)


def shrink(d: DataFrame) -> DataFrame:
    """Adds log2fc_shrunk: the mode of a normal likelihood under a Cauchy prior, by fixed-point steps that stay in the row."""
    scale = d.groupBy("study_id", "contrast_id").agg(F.greatest(F.lit(1e-3), F.sqrt(F.greatest(F.lit(0.0), F.percentile(F.pow(F.col("log2fc"), 2) - F.pow(F.col("lfc_se"), 2), F.lit(0.75))))).alias("scale"))
    j = d.join(scale, ["study_id", "contrast_id"])
    b = F.expr("aggregate(sequence(1, 30), log2fc, (b, i) -> log2fc / (1 + 2 * lfc_se * lfc_se / (scale * scale + b * b)))")
    return j.withColumn("log2fc_shrunk", b).drop("scale")


def independent_filter(d: DataFrame, alpha: float = 0.05, cuts: int = 20) -> DataFrame:
    """padj at the base-mean cut, of ``cuts`` quantiles, with the most rejections; features below it have NULL."""
    keys = ["study_id", "contrast_id", "method"]
    rank = F.percent_rank().over(Window.partitionBy(*keys).orderBy("base_mean"))
    at = d.withColumn("__q", rank).select("*", F.explode(F.sequence(F.lit(0), F.lit(cuts - 1))).alias("cut")).where(F.col("__q") >= F.col("cut") / cuts * 0.95)
    w = Window.partitionBy(*keys, "cut").orderBy(F.col("pvalue").asc_nulls_last(), "feature_id")
    raw = at.withColumn("raw", F.least(F.lit(1.0), F.col("pvalue") * F.count("pvalue").over(Window.partitionBy(*keys, "cut")) / F.row_number().over(w)))
    q = raw.withColumn("padj", F.when(F.col("pvalue").isNotNull(), F.min("raw").over(w.rowsBetween(0, Window.unboundedFollowing))))
    chosen = q.groupBy(*keys, "cut").agg(F.count_if(F.col("padj") < alpha).alias("n")).groupBy(*keys).agg(F.min_by("cut", F.struct(-F.col("n"), F.col("cut"))).alias("cut"))
    kept = q.join(chosen, [*keys, "cut"], "left_semi").select(*keys, "feature_id", "padj")
    return d.join(kept, [*keys, "feature_id"], "left")
