"""Precision weights for log counts, and the local regression that they follow."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from assayloom.functions.tables import once, stored
from assayloom.operators.negbin import by_study, designs, inverted, packed_rows, with_columns
from assayloom.operators.stats import gathered, log_odds, moderated

#: Share of the points that a local line is fitted to, rounds of reweighting, and points a study.
SPAN, ROUNDS, POINTS = 0.5, 3, 2000


def local_lines(x: np.ndarray, y: np.ndarray, robust: np.ndarray, at: np.ndarray, k: int) -> np.ndarray:
    """Values at ``x[at]`` of lines through the ``k`` nearest points, with tricube weights of the distance times ``robust``."""
    out = np.empty(len(at))
    for n, i in enumerate(at):
        lo = max(0, i - k + 1)
        # the window of k neighbours whose farther end is nearest
        starts = np.arange(lo, min(i, len(x) - k) + 1)
        reach = np.maximum(x[i] - x[starts], x[starts + k - 1] - x[i])
        h = reach.min()
        a, b = np.searchsorted(x, x[i] - h, side="left"), np.searchsorted(x, x[i] + h, side="right")
        d = np.abs(x[a:b] - x[i])
        w = np.where(d < 0.999 * h, np.where(d > 0.001 * h, (1 - (d / h if h else d) ** 3) ** 3, 1.0), 0.0) * robust[a:b]
        if h == 0:
            w = robust[a:b].copy()
        total = w.sum()
        if total <= 0:
            out[n] = y[i]
            continue
        w = w / total
        mean = w @ x[a:b]
        spread = w @ (x[a:b] - mean) ** 2
        slope = (w * (x[a:b] - mean)) @ y[a:b] / spread if math.sqrt(max(spread, 0)) > 0.001 * (x[-1] - x[0]) else 0.0
        out[n] = w @ y[a:b] + slope * (x[i] - mean)
    return out


def lowess(x: np.ndarray, y: np.ndarray, span: float = SPAN, rounds: int = ROUNDS, apart: float = 0.0) -> np.ndarray:
    """Robust local regression of ``y`` on the rising ``x``, at its points."""
    at, fit = lowess_knots(x, y, span, rounds, apart)
    return np.interp(x, x[at], fit) if len(at) else fit


def lowess_knots(x: np.ndarray, y: np.ndarray, span: float = SPAN, rounds: int = ROUNDS, apart: float = 0.0) -> tuple[np.ndarray, np.ndarray]:
    """Places of the points that lines are fitted at, and their values.

    Lines are fitted at points more than ``apart`` from the last one and joined straight between them; after each of ``rounds`` rounds the
    bisquare of residuals over six median residuals weights the points anew.
    """
    n = len(x)
    if n < 3 or x[-1] == x[0]:
        return np.arange(n)[:1], np.full(min(n, 1), y.mean() if n else 0.0)
    k = max(2, min(n, int(span * n + 1e-9)))
    at = [0]
    for i in range(1, n):
        if x[i] - x[at[-1]] > apart:
            # the last point within reach, as lines between fitted points must not leave gaps
            at.append(i - 1 if i - 1 > at[-1] and x[i - 1] > x[at[-1]] and apart else i)
    at = np.unique([*at, n - 1])
    robust = np.ones(n)
    for r in range(rounds + 1):
        fit = local_lines(x, y, robust, at, k)
        rest = np.abs(y - np.interp(x, x[at], fit))
        scale = 6 * np.median(rest)
        if r == rounds or scale <= 1e-7 * rest.mean():
            break
        u = rest / scale
        robust = np.where(u < 0.001, 1.0, np.where(u < 0.999, (1 - u * u) ** 2, 0.0))
    return at, fit


def pseudo_inverse(info: np.ndarray) -> np.ndarray:
    """Pseudo-inverses of many small matrices; two columns that are far from equal, the usual case, by their formula."""
    if info.shape[1] != 2:
        return np.linalg.pinv(info)
    det, most = info[:, 0, 0] * info[:, 1, 1] - info[:, 0, 1] * info[:, 1, 0], info[:, 0, 0] * info[:, 1, 1]
    sound = det > 1e-8 * most
    out = np.empty_like(info)
    out[sound] = inverted(info[sound])
    out[~sound] = np.linalg.pinv(info[~sound])
    return out


def voom_test(m: DataFrame, s: DataFrame, terms: list[str], coefficient: str, points: int = POINTS) -> DataFrame:
    """log2 CPM with offsets, a trend of the root of residual deviations on mean log counts, its -4th power as weights, a weighted moderated fit.

    The trend is a robust local regression over ``points`` classes of equal size at most a study; with fewer features each is a point.
    """
    counts = stored(gathered(m))
    each = counts.select("study_id", F.explode(F.arrays_zip("samples", "values")).alias("p")).groupBy("study_id", F.col("p.samples").alias("sample_id")).agg(F.sum("p.values").alias("lib"))
    features = packed_rows(counts, once(designs(s, terms, each, "lib")))

    def logs(y, lib):
        return np.log2((y + 0.5) / (lib + 1) * 1e6)

    def first(batches):
        for _, rows, y, _, x, lib in by_study(batches, terms):
            v = logs(y, lib)
            rest = v - v @ np.linalg.pinv(x).T @ x.T
            sd = np.sqrt((rest**2).sum(axis=1) / (x.shape[0] - x.shape[1]))
            yield with_columns(rows, ["study_id", "feature_id"], {"mean": v.mean(axis=1) + np.mean(np.log2(lib + 1)) - math.log2(1e6), "root": np.sqrt(sd)})

    spread = features.mapInArrow(first, "study_id string, feature_id string, mean double, root double")
    w = Window.partitionBy("study_id").orderBy("mean", "feature_id")
    classes = spread.withColumn("bin", F.ntile(points).over(w)).groupBy("study_id", "bin").agg(F.avg("mean").alias("mean"), F.avg("root").alias("root"))

    def trend(t: pd.DataFrame) -> pd.DataFrame:
        t = t.sort_values(["mean", "bin"])
        x = t["mean"].to_numpy(float)
        # a line is straight between the points it is fitted at, so these, about a hundred, go to each feature
        at, line = lowess_knots(x, t["root"].to_numpy(float), SPAN, ROUNDS, 0.01 * (x[-1] - x[0]))
        return pd.DataFrame({"study_id": [t["study_id"].iloc[0]], "mean": [x[at].tolist()], "root": [line.tolist()]})

    line = classes.groupBy("study_id").applyInPandas(trend, "study_id string, mean array<double>, root array<double>")

    def second(batches):
        for _, rows, y, names, x, lib in by_study(batches, terms):
            if coefficient not in names:
                continue
            k = names.index(coefficient)
            v = logs(y, lib)
            fitted = v @ np.linalg.pinv(x).T @ x.T + np.log2(lib + 1) - math.log2(1e6)
            knots = (np.asarray(rows.column(c)[0].as_py(), dtype=float) for c in ("mean", "root"))
            weight = np.maximum(np.interp(fitted, *knots), 1e-6) ** -4
            inverse = pseudo_inverse(np.einsum("gn,np,nq->gpq", weight, x, x))
            beta = np.einsum("gpq,gq->gp", inverse, (weight * v) @ x)
            df = float(x.shape[0] - x.shape[1])
            s2 = (weight * (v - beta @ x.T) ** 2).sum(axis=1) / df
            yield with_columns(rows, ["study_id", "feature_id"], {"base_mean": v.mean(axis=1), "log2fc": beta[:, k], "s2": s2, "df": df, "u": inverse[:, k, k]})

    fits = features.join(F.broadcast(once(line)), "study_id").mapInArrow(second, "study_id string, feature_id string, base_mean double, log2fc double, s2 double, df double, u double")
    out = log_odds(moderated(stored(fits)))
    return out.select("study_id", F.lit(coefficient).alias("contrast_id"), F.lit("voom").alias("method"), "feature_id", "base_mean", "log2fc", "lfc_se", "stat", "pvalue", "b")
