"""What the count models share: log-linear fits of many features at once, profiles of the dispersion, and features packed with their design.

A feature is one row with its counts in the order of its study's samples; the order is settled on Spark, so a batch becomes a matrix in one step.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from assayloom.operators.stats import design, gathered, term_columns

GRID = np.exp(np.linspace(math.log(1e-8), math.log(20.0), 60))
RIDGE, FLOOR = 1e-6, 0.25


def lgamma(x: np.ndarray) -> np.ndarray:
    """Stirling's series after shifting the argument above 8."""
    x = np.asarray(x, dtype=float)
    low = x < 8
    shift, y = np.zeros_like(x), x.copy()
    if low.any():
        z = x[low]
        # lgamma(z) = lgamma(z + 8) - log(z (z + 1) ... (z + 7)); the logarithm of z alone, as it may be tiny
        shift[low] = np.log(z) + np.log(np.prod([z + k for k in range(1, 8)], axis=0))
        y[low] = z + 8
    inv = 1 / y
    return (y - 0.5) * np.log(y) - y + 0.5 * math.log(2 * math.pi) + inv * (1 / 12 - inv**2 * (1 / 360 - inv**2 / 1260)) - shift


def information(w: np.ndarray, x: np.ndarray) -> np.ndarray:
    """x' diag(w) x + RIDGE of each row of ``w``, by one product with the columns' products."""
    p = x.shape[1]
    return (w @ (x[:, :, None] * x[:, None, :]).reshape(len(x), p * p)).reshape(len(w), p, p) + RIDGE * np.eye(p)


def solved(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Solutions of many small systems; two unknowns, the usual case, by their formula."""
    if a.shape[1] != 2:
        return np.linalg.solve(a, b[:, :, None])[:, :, 0]
    det = a[:, 0, 0] * a[:, 1, 1] - a[:, 0, 1] * a[:, 1, 0]
    return np.stack([a[:, 1, 1] * b[:, 0] - a[:, 0, 1] * b[:, 1], a[:, 0, 0] * b[:, 1] - a[:, 1, 0] * b[:, 0]], axis=1) / det[:, None]


def inverted(a: np.ndarray) -> np.ndarray:
    if a.shape[1] != 2:
        return np.linalg.inv(a)
    det = a[:, 0, 0] * a[:, 1, 1] - a[:, 0, 1] * a[:, 1, 0]
    return np.stack([a[:, 1, 1], -a[:, 0, 1], -a[:, 1, 0], a[:, 0, 0]], axis=1).reshape(-1, 2, 2) / det[:, None, None]


def log_det(a: np.ndarray) -> np.ndarray:
    return np.linalg.slogdet(a)[1] if a.shape[1] != 2 else np.log(np.abs(a[:, 0, 0] * a[:, 1, 1] - a[:, 0, 1] * a[:, 1, 0]))


#: A row whose log means move by less in a round is fitted.
SETTLED = 1e-9


def fit_means(y: np.ndarray, x: np.ndarray, log_size: np.ndarray, alpha: np.ndarray, rounds: int = 25, start: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Coefficients, means and inverse information of log-linear models of all rows of y, by weighted least squares.

    A step moves no log mean by more than 2, so that a far count doesn't throw the fit beyond what the rounds can mend. Rows that don't
    move any more leave the rounds. ``start`` are coefficients to begin with.
    """
    beta = np.log((y + 0.5) / np.exp(log_size)) @ np.linalg.pinv(x).T if start is None else start.copy()
    live, now, counts, a = np.arange(len(y)), beta, y, alpha[:, None]
    for _ in range(rounds):
        eta = np.clip(now @ x.T + log_size, -30, 30)
        mu = np.exp(eta)
        w = mu / (1 + a * mu)
        step = solved(information(w, x), (w * (eta - log_size + (counts - mu) / mu)) @ x) - now
        far = np.abs(step @ x.T).max(axis=1)
        now = now + step * np.minimum(1, 2 / np.maximum(far, 1e-12))[:, None]
        beta[live] = now
        moving = far >= SETTLED
        if not moving.any():
            break
        if moving.mean() < 0.8:
            live, now, counts, a = live[moving], now[moving], counts[moving], a[moving]
    mu = np.exp(np.clip(beta @ x.T + log_size, -30, 30))
    return beta, mu, inverted(information(mu / (1 + alpha[:, None] * mu), x))


def likelihoods(y: np.ndarray, x: np.ndarray, each):
    """Adjusted profile likelihood of each row at each of (dispersion, means); a count that many share is looked up once a dispersion."""
    values, at = np.unique(y, return_inverse=True)
    at = at.reshape(y.shape)
    for a, mu in each:
        r, am = 1 / a, a * mu
        more = np.log1p(am)
        ll = (lgamma(values + r) - lgamma(np.array(r)))[at] + y * np.log(am) - (y + r) * more
        yield ll.sum(axis=1) - 0.5 * log_det(information(mu / (1 + am), x))


def profile(y: np.ndarray, mu: np.ndarray, x: np.ndarray) -> np.ndarray:
    """Adjusted profile likelihood (rows, GRID) of the dispersion at fixed means."""
    return np.stack(list(likelihoods(y, x, ((a, mu) for a in GRID))), axis=1)


def best(curve: np.ndarray) -> np.ndarray:
    """The dispersion at the top of each curve, between grid points by a parabola in log dispersion."""
    at = np.clip(curve.argmax(axis=1), 1, len(GRID) - 2)
    a, b, c = (np.take_along_axis(curve, (at + d)[:, None], 1)[:, 0] for d in (-1, 0, 1))
    down = a - 2 * b + c
    move = np.where(down < 0, np.clip(0.5 * (a - c) / np.where(down < 0, down, -1.0), -1, 1), 0.0)
    step = math.log(GRID[1] / GRID[0])
    return np.exp(np.log(GRID[at]) + move * step)


def designs(s: DataFrame, terms: list[str], sizes: DataFrame, size: str) -> DataFrame:
    """A row a study: its samples in order, their sizes and the values of their terms, to be joined with packed features."""
    used = term_columns(terms)
    known = s.select("study_id", "sample_id", *used).dropna().join(sizes.select("study_id", "sample_id", F.col(size).cast("double").alias("__size")), ["study_id", "sample_id"])
    lists = known.groupBy("study_id").agg(F.array_sort(F.collect_list(F.struct("sample_id", "__size", *used))).alias("__s"))
    return lists.select("study_id", F.col("__s.sample_id").alias("__order"), F.col("__s.__size").alias("__size"), *(F.col("__s").getField(c).alias(f"__t{i}") for i, c in enumerate(used)))


def packed(m: DataFrame, lists: DataFrame) -> DataFrame:
    """A row a feature with a positive count: its counts ``y`` in sample order, zero where it lacks one, and the sizes and terms of its study."""
    return packed_rows(gathered(m), lists)


def packed_rows(rows: DataFrame, lists: DataFrame) -> DataFrame:
    """``packed`` of rows of ``gathered``. The row of samples a study is broadcast, so features stay where they are."""
    j = rows.where(F.exists("values", lambda v: v > 0)).join(F.broadcast(lists), "study_id")
    at = lambda s: F.nullif(F.array_position("samples", s), F.lit(0).cast("long")).cast("int")
    # features that have every sample need no lookup
    y = F.when(F.col("samples") == F.col("__order"), F.col("values")).otherwise(F.transform("__order", lambda s: F.try_element_at("values", at(s))))
    return j.withColumn("y", F.transform(y, lambda v: F.coalesce(v, F.lit(0.0)))).drop("samples", "values", "__order")


#: Features that are fitted at once: their matrices stay in a processor's cache.
TOGETHER = 2048


def by_study(batches, terms: list[str]):
    """(study, rows, y in sample order, names, design, sizes) of each batch; ``rows`` are Arrow's, sizes and terms are those of a study's first row."""
    for whole in batches:
        for at in range(0, whole.num_rows, TOGETHER):
            t = whole.slice(at, TOGETHER)
            for study in pc.unique(t.column("study_id")).to_pylist():
                rows = t.filter(pc.equal(t.column("study_id"), study))
                first = rows.slice(0, 1)
                samples = pd.DataFrame({c: first.column(f"__t{i}")[0].as_py() for i, c in enumerate(term_columns(terms))})
                names, x = design(samples, terms)
                if len(x) > np.linalg.matrix_rank(x):
                    y = rows.column("y").flatten().to_numpy().reshape(rows.num_rows, -1)
                    yield study, rows, y, names, x, np.asarray(first.column("__size")[0].as_py(), dtype=float)


def numbers(rows: pa.RecordBatch, name: str) -> np.ndarray:
    return rows.column(name).to_numpy(zero_copy_only=False).astype(float)


def with_columns(rows: pa.RecordBatch, kept: list[str], new: dict) -> pa.RecordBatch:
    """The columns ``kept`` of ``rows`` and ``new`` ones: arrays of numbers, or matrices as lists; a single value stands for all rows."""

    def column(v):
        if np.ndim(v) == 2:
            return pa.ListArray.from_arrays(pa.array(np.arange(len(v) + 1, dtype=np.int32) * v.shape[1]), pa.array(np.ascontiguousarray(v).ravel()))
        return pa.array(v) if np.ndim(v) else pa.repeat(pa.scalar(v), rows.num_rows)

    return pa.RecordBatch.from_arrays([*(rows.column(c) for c in kept), *map(column, new.values())], [*kept, *new])
