"""Quasi-likelihood F tests of counts, with dispersions by weighted likelihood.

Each feature has a curve: the adjusted profile likelihood of its dispersion on a fixed grid, its means fitted anew at every point.
Curves are arrays, so everything that features share is a sum of arrays by key, with partial sums before the shuffle:

* common: the top of the sum of a study's curves;
* local: features are put into CLASSES classes of abundance by quantiles of their study; a class's curve is the mean curve of the
  classes around it, over the published share of features, (10 / n)^0.23. A study's task sees a row a class, whatever the number of features;
* tagwise: the top of a feature's own curve plus ``prior_df`` / df times the local one.

The F test takes the deviance at one dispersion of the study (``dispersion`` = common, trended or tagwise), over the residual degrees of freedom, and
squeezes it to a prior that follows abundance: a regression of the log quasi-dispersion on a natural cubic spline in abundance,
from sums of products by study. Sizes are library sizes times TMM factors.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from assayloom.functions.tables import once, stored
from assayloom.operators.negbin import by_study, designs, fit_means, likelihoods, numbers, packed_rows, with_columns
from assayloom.operators.stats import digamma, gathered, gathered_tmm, t_two_sided, trigamma, trigamma_inverse

#: Log dispersions of the curves, half a doubling apart from 2^-13 to 2^4.
STEP = math.log(2) / 2
CURVE = np.arange(-26, 9) * STEP
CLASSES, PRIOR_DF, LEAST_TOTAL = 100, 10.0, 5
#: Share of the features of a study that make a neighbourhood: (10 / n)^0.23 where there are more than ten.
SPAN_N, SPAN_POWER = 10.0, 0.23
KNOTS = (0.0, 1 / 3, 2 / 3, 1.0)


def effective_sizes(m: DataFrame) -> DataFrame:
    """Library sizes times TMM factors (study_id, sample_id, size)."""
    return gathered_sizes(stored(gathered(m)))


def gathered_sizes(rows: DataFrame) -> DataFrame:
    return gathered_tmm(rows).select("study_id", "sample_id", (F.col("lib") * F.col("tmm_factor")).alias("size"))


def abundance(y: np.ndarray, size: np.ndarray, prior: float = 2.0) -> np.ndarray:
    """log2 of the mean counts a million, each sample with ``prior`` counts in proportion to its size."""
    extra = prior * size / size.mean()
    return np.log2(((y + extra) / (size + 2 * extra)).mean(axis=1) * 1e6)


def curves(y: np.ndarray, x: np.ndarray, size: np.ndarray) -> np.ndarray:
    """The curve of each row over CURVE: adjusted profile likelihoods at means fitted there; a point starts from the coefficients of the one before."""

    def fitted():
        beta = None
        for log_a in CURVE:
            a = math.exp(log_a)
            beta, mu, _ = fit_means(y, x, np.log(size), np.full(len(y), a), rounds=25 if beta is None else 6, start=beta)
            yield a, mu

    return np.stack(list(likelihoods(y, x, fitted())), axis=1)


def top(curve: np.ndarray) -> np.ndarray:
    """The dispersion at the top of each curve, between points by a parabola; ends of the grid stay."""
    at = curve.argmax(axis=1)
    inner = np.clip(at, 1, len(CURVE) - 2)
    a, b, c = (np.take_along_axis(curve, (inner + d)[:, None], 1)[:, 0] for d in (-1, 0, 1))
    down = a - 2 * b + c
    move = np.where((at == inner) & (down < 0), 0.5 * (a - c) / np.where(down < 0, down, -1.0), 0.0)
    return np.exp(CURVE[at] + np.clip(move, -1, 1) * STEP)


PROFILED = "study_id string, feature_id string, y array<double>, abundance double, total double, df double, curve array<double>"


def profiled(features: DataFrame, terms: list[str]) -> DataFrame:
    """``features`` with abundance, total, df and curve, without what is their study's."""

    def run(batches):
        for _, rows, y, _, x, size in by_study(batches, terms):
            yield with_columns(rows, ["study_id", "feature_id", "y"], {"abundance": abundance(y, size), "total": y.sum(axis=1), "df": float(x.shape[0] - x.shape[1]), "curve": curves(y, x, size)})

    return features.mapInArrow(run, PROFILED)


def neighbourhoods(p: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(study_id, cuts), and a row a class of abundance (study_id, class, local, common, trended): the mean curve around it and its top, and the common dispersion."""
    cuts = once(p.groupBy("study_id").agg(F.percentile_approx("abundance", F.array(*(F.lit(k / CLASSES) for k in range(1, CLASSES))), F.lit(100_000)).alias("cuts")))
    kept = F.col("total") >= LEAST_TOTAL
    sums = [F.sum(F.when(kept, F.col("curve")[k])).alias(f"_{k}") for k in range(len(CURVE))]
    by_class = classed(p, cuts).groupBy("study_id", "class").agg(F.count_if(kept).alias("n"), *sums)

    def around(t: pd.DataFrame) -> pd.DataFrame:
        s, n = np.zeros((CLASSES, len(CURVE))), np.zeros(CLASSES)
        s[t["class"]], n[t["class"]] = t[[f"_{k}" for k in range(len(CURVE))]].fillna(0.0).to_numpy(), t["n"]
        total = n.sum()
        if not total:
            return pd.DataFrame({c: [] for c in ("study_id", "class", "local", "common", "trended")})
        share = (SPAN_N / total) ** SPAN_POWER if total > SPAN_N else 1.0
        middle = np.cumsum(n) - n / 2
        near = np.abs(middle[:, None] - middle[None, :]) <= max(share * total / 2, 0.5)
        near |= np.eye(CLASSES, dtype=bool)
        count = near @ n
        # a class with nothing around takes the mean of all
        local = np.where(count[:, None] > 0, (near @ s) / np.maximum(count, 1)[:, None], s.sum(axis=0) / total)
        return pd.DataFrame({"study_id": t["study_id"].iloc[0], "class": np.arange(CLASSES, dtype=np.int32), "local": local.tolist(), "common": float(top(s.sum(axis=0)[None, :])[0]), "trended": top(local)})

    return cuts, by_class.groupBy("study_id").applyInPandas(around, "study_id string, class int, local array<double>, common double, trended double")


def classed(p: DataFrame, cuts: DataFrame) -> DataFrame:
    """``p`` with its class of abundance: how many cuts of its study are below it."""
    return p.join(F.broadcast(cuts), "study_id").withColumn("class", F.size(F.filter("cuts", lambda c: c < F.col("abundance")))).drop("cuts")


def tagwise(p: DataFrame, prior_df: float = PRIOR_DF) -> DataFrame:
    """``p`` (with curves) plus the columns common, trended and tagwise. Features meet the curve of their class, not all of their study's."""
    cuts, shared = neighbourhoods(p)
    own = F.zip_with("curve", "local", lambda a, b: a + b * prior_df / F.col("df"))

    def peak(v: pd.Series) -> pd.Series:
        return pd.Series(top(np.stack(v.to_list())) if len(v) else [], dtype=float)

    j = classed(p, cuts).join(F.broadcast(once(shared)), ["study_id", "class"])
    return j.withColumn("tagwise", F.pandas_udf(peak, "double")(own)).drop("class", "local", "curve")


def deviance(y: np.ndarray, mu: np.ndarray, a: np.ndarray) -> np.ndarray:
    """Negative-binomial deviance of each row; Poisson where ``a`` is 0."""
    a = a[:, None]
    safe = np.maximum(a, 1e-12)
    with np.errstate(divide="ignore", invalid="ignore"):
        part = np.where(y > 0, y * np.log(y / mu), 0.0)
    rest = np.where(a > 0, (y + 1 / safe) * np.log((1 + safe * y) / (1 + safe * mu)), y - mu)
    return np.maximum(2 * (part - rest).sum(axis=1), 0)


def spare(y: np.ndarray, mu: np.ndarray, x: np.ndarray) -> np.ndarray:
    """Residual degrees of freedom without counts of zero that are fitted as zero: they can't vary."""
    idle = (y == 0) & (mu < 1e-4)
    out = np.full(len(y), float(x.shape[0] - x.shape[1]))
    patterns, which = np.unique(idle, axis=0, return_inverse=True)
    for k, gone in enumerate(patterns):
        if gone.any():
            left = x[~gone]
            out[which.ravel() == k] = len(left) - (np.linalg.matrix_rank(left) if len(left) else 0)
    return out


def spline(u: Column, knots: Column) -> list[Column]:
    """Natural cubic spline with four knots: 1, u and two bends, straight beyond the ends."""
    low, high = F.element_at(knots, 1), F.element_at(knots, -1)
    width = F.when(high > low, high - low).otherwise(F.lit(1.0))
    z, k = (u - low) / width, [(F.element_at(knots, i + 1) - low) / width for i in range(len(KNOTS))]
    cube = lambda v: F.pow(F.greatest(v, F.lit(0.0)), 3)
    bend = lambda i: F.when(k[-1] > k[i], (cube(z - k[i]) - cube(z - k[-1])) / (k[-1] - k[i])).otherwise(0.0)
    return [F.lit(1.0), z, *(bend(i) - bend(len(KNOTS) - 2) for i in range(len(KNOTS) - 2))]


def trended_prior(fits: DataFrame) -> DataFrame:
    """``fits`` (study_id, abundance, s2, df, shift, tri) with d0 and s02: a prior variance that follows abundance.

    The expected log of a scaled chi-square variance is ``shift`` off its log, its variance is ``tri``; both are computed where the fit is.
    """
    fits = stored(fits)
    use = F.col("df") > 0
    shape = fits.where(use).groupBy("study_id").agg(F.percentile_approx("abundance", F.array(*map(F.lit, KNOTS)), F.lit(100_000)).alias("knots"), F.percentile_approx("s2", 0.5, F.lit(100_000)).alias("mid"), F.sum("df").alias("pooled"))
    j = fits.join(F.broadcast(once(shape)), "study_id", "left")
    basis = spline(F.col("abundance"), F.col("knots"))
    z = F.log(F.greatest(F.col("s2"), F.col("mid") * 1e-5, F.lit(1e-300))) - F.col("shift")
    b = j.withColumns({**{f"b{i}": v for i, v in enumerate(basis)}, "z": z})
    size = len(basis)
    products = [F.sum(F.col(f"b{i}") * F.col(f"b{k}")).alias(f"x{i}{k}") for i in range(size) for k in range(i, size)]
    sums = b.where(use).groupBy("study_id").agg(F.count(F.lit(1)).alias("n"), F.sum(F.col("z") * F.col("z")).alias("zz"), F.avg("tri").alias("tri"), *(F.sum(F.col(f"b{i}") * F.col("z")).alias(f"y{i}") for i in range(size)), *products)

    def solve(t: pd.DataFrame) -> pd.DataFrame:
        r = t.iloc[0]
        x = np.array([[r[f"x{min(i, k)}{max(i, k)}"] for k in range(size)] for i in range(size)])
        y = np.array([r[f"y{i}"] for i in range(size)])
        inverse = np.linalg.pinv(x, rcond=1e-10, hermitian=True)
        coef, rank = inverse @ y, int(np.linalg.matrix_rank(x, tol=1e-10 * np.linalg.norm(x, 2), hermitian=True))
        rest = max(r["zz"] - y @ coef, 0.0)
        v = rest / max(r["n"] - rank, 1) - r["tri"]
        d0 = 2 * trigamma_inverse(v) if v > 0 else math.inf
        level = float(digamma(np.array(d0 / 2))) - math.log(d0 / 2) if v > 0 else 0.0
        return pd.DataFrame({"study_id": [r["study_id"]], "d0": [d0], "level": [level], "coef": [coef.tolist()]})

    solved = sums.groupBy("study_id").applyInPandas(solve, "study_id string, d0 double, level double, coef array<double>")
    fitted = sum((F.col(f"b{i}") * F.col("coef")[i] for i in range(size)), F.col("level"))
    return b.join(F.broadcast(solved), "study_id").withColumn("s02", F.exp(fitted)).drop("knots", "mid", "z", "coef", "level", *(f"b{i}" for i in range(size)))


def ql_test(m: DataFrame, s: DataFrame, terms: list[str], coefficient: str, dispersion: str = "common", prior_df: float = PRIOR_DF) -> DataFrame:
    """Quasi-likelihood F test of a coefficient (``term=level``); stat is the signed root of F.

    A p-value isn't less than the one of a Poisson likelihood-ratio test where the squeezed quasi-dispersion is below 1.
    """
    if dispersion not in ("common", "trended", "tagwise"):
        raise ValueError("dispersion is common, trended or tagwise")
    counts = stored(gathered(m))
    lists = once(designs(s, terms, gathered_sizes(counts), "size"))
    p = stored(profiled(packed_rows(counts, lists), terms))
    kept = ["abundance", "common", "trended", "tagwise"]

    def run(batches):
        for study, rows, y, names, x, size in by_study(batches, terms):
            if coefficient not in names:
                continue
            k, a, less = names.index(coefficient), numbers(rows, dispersion), np.delete(x, names.index(coefficient), axis=1)
            beta, mu, _ = fit_means(y, x, np.log(size), a)
            _, mu0, _ = fit_means(y, less, np.log(size), a)
            none = np.zeros(len(y))
            _, pmu, _ = fit_means(y, x, np.log(size), none)
            _, pmu0, _ = fit_means(y, less, np.log(size), none)
            df, full = spare(y, mu, x), deviance(y, mu, a)
            half = np.maximum(df, 1e-9) / 2
            yield with_columns(rows, ["study_id", "feature_id"], {
                "base_mean": (y / (size / size.mean())).mean(axis=1), "log2fc": beta[:, k] / math.log(2),
                "lr": np.maximum(deviance(y, mu0, a) - full, 0), "poisson": np.maximum(deviance(y, pmu0, none) - deviance(y, pmu, none), 0),
                "s2": np.where(df > 0, full / np.maximum(df, 1e-9), 0.0), "df": df, "shift": np.where(df > 0, digamma(half) - np.log(half), 0.0), "tri": np.where(df > 0, trigamma(half), 0.0), **{c: numbers(rows, c) for c in kept},
            })

    form = "study_id string, feature_id string, base_mean double, log2fc double, lr double, poisson double, s2 double, df double, shift double, tri double, " + ", ".join(f"{c} double" for c in kept)
    fits = trended_prior(tagwise(p, prior_df).join(F.broadcast(lists.drop("__order")), "study_id").mapInArrow(run, form))
    inf = F.col("d0") == float("inf")
    post = F.when(inf, F.col("s02")).otherwise((F.col("d0") * F.col("s02") + F.col("df") * F.col("s2")) / (F.col("d0") + F.col("df")))
    total = F.least(F.when(inf, F.col("pooled")).otherwise(F.col("d0") + F.col("df")), F.col("pooled"))

    def tail(f: pd.Series, df: pd.Series, poisson: pd.Series, squeezed: pd.Series) -> pd.Series:
        p = t_two_sided(np.sqrt(f.to_numpy(float)), df.to_numpy(float))
        bound = t_two_sided(np.sqrt(poisson.to_numpy(float)), np.full(len(f), np.inf))
        return pd.Series(np.where(squeezed.to_numpy(float) < 1, np.maximum(p, bound), p))

    out = fits.withColumn("s2_post", post).withColumn("df_total", total.cast("double")).withColumn("f", F.col("lr") / F.col("s2_post"))
    out = out.withColumn("pvalue", F.pandas_udf(tail, "double")("f", "df_total", "poisson", "s2_post"))
    return out.select("study_id", F.lit(coefficient).alias("contrast_id"), F.lit("ql").alias("method"), "feature_id", "base_mean", "log2fc", (F.signum("log2fc") * F.sqrt("f")).alias("stat"), "pvalue", "common", "trended", "tagwise", "s2", "s02", "d0", "df_total")
