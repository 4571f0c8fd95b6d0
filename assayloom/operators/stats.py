"""Statistical models over all studies at once.

The sample table of a study is small, the feature axis is not: designs become weights that are joined to the measures, and a fit is a
sum. Tail probabilities are computed in Arrow batches; prior parameters are two aggregates and a scalar solve for each study.
"""

from __future__ import annotations

import itertools
import math
import re

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from assayloom.functions.tables import once, stored
from assayloom.operators.results import average_rank


def digamma(x: np.ndarray) -> np.ndarray:
    x = np.asarray(x, dtype=float).copy()
    out = np.zeros_like(x)
    for _ in range(8):
        small = x < 8
        out -= np.where(small, 1 / x, 0)
        x = np.where(small, x + 1, x)
    y = 1 / (x * x)
    return out + np.log(x) - 0.5 / x - y * (1 / 12 - y * (1 / 120 - y * (1 / 252 - y * (1 / 240 - y / 132))))


def trigamma(x: np.ndarray) -> np.ndarray:
    x = np.asarray(x, dtype=float).copy()
    out = np.zeros_like(x)
    for _ in range(8):
        small = x < 8
        out += np.where(small, 1 / (x * x), 0)
        x = np.where(small, x + 1, x)
    y = 1 / (x * x)
    return out + 1 / x + y / 2 + y / x * (1 / 6 - y * (1 / 30 - y * (1 / 42 - y / 30)))


def trigamma_inverse(v: float) -> float:
    """x with trigamma(x) = v, by Newton on 1 / trigamma."""
    if v > 1e7:
        return 1 / math.sqrt(v)
    if v < 1e-6:
        return 1 / v
    x = 0.5 + 1 / v
    for _ in range(60):
        t = float(trigamma(np.array(x)))
        h = 1e-5 * x
        slope = float(trigamma(np.array(x + h)) - trigamma(np.array(x - h))) / (2 * h)
        step = t * (1 - t / v) / slope
        x += step
        if abs(step) < 1e-10 * x:
            break
    return x


LOG_GAMMA = np.vectorize(math.lgamma, otypes=[float])


def beta_tail(a: np.ndarray, b: np.ndarray, x: np.ndarray) -> np.ndarray:
    """Regularised incomplete beta function by its continued fraction (Lentz)."""
    a, b, x = (np.array(v, dtype=float) for v in np.broadcast_arrays(a, b, x))
    flip = x > (a + 1) / (a + b + 2)
    a2, b2, x2 = np.where(flip, b, a), np.where(flip, a, b), np.clip(np.where(flip, 1 - x, x), 0, 1)
    with np.errstate(divide="ignore", invalid="ignore"):
        front = np.exp(LOG_GAMMA(a2 + b2) - LOG_GAMMA(a2) - LOG_GAMMA(b2) + a2 * np.log(x2) + b2 * np.log1p(-x2)) / a2
    tiny = 1e-300
    c, d = np.ones_like(x2), 1 - (a2 + b2) * x2 / (a2 + 1)
    d = 1 / np.where(np.abs(d) < tiny, tiny, d)
    f = d.copy()
    for m in range(1, 300):
        for num in (m * (b2 - m) * x2 / ((a2 + 2 * m - 1) * (a2 + 2 * m)), -(a2 + m) * (a2 + b2 + m) * x2 / ((a2 + 2 * m) * (a2 + 2 * m + 1))):
            d = 1 + num * d
            d = 1 / np.where(np.abs(d) < tiny, tiny, d)
            c = 1 + num / c
            c = np.where(np.abs(c) < tiny, tiny, c)
            f = f * d * c
        if not np.any(np.abs(d * c - 1) >= 1e-14):  # NaN never settles
            break
    out = np.where(x2 <= 0, 0.0, front * f)
    return np.where(flip, 1 - out, out)


def t_two_sided(t: np.ndarray, df: np.ndarray) -> np.ndarray:
    t, df = np.asarray(t, dtype=float), np.asarray(df, dtype=float)
    normal = np.vectorize(lambda z: math.erfc(abs(z) / math.sqrt(2)), otypes=[float])
    big = ~np.isfinite(df) | (df > 1e8)
    safe = np.where(big, 1.0, df)
    return np.where(big, normal(t), beta_tail(safe / 2, 0.5, safe / (safe + t * t)))


def t_pvalue(t: Column | str, df: Column | str) -> Column:
    """Two-sided tail of Student's t; NULL for NULL; an infinite df is the normal distribution."""

    def tail(t: pd.Series, df: pd.Series) -> pd.Series:
        known = t.notna() & df.notna()
        out = pd.Series(np.nan, index=t.index)
        if known.any():
            out[known] = t_two_sided(t[known].to_numpy(), df[known].to_numpy())
        return out

    p = F.pandas_udf(tail, "double")(t, df)
    return F.when(~F.isnan(p), p)


def two_group(m: DataFrame, s: DataFrame | None, control: str, treatment: str, value: str = "value") -> DataFrame:
    """Means, log fold change, pooled variance, ordinary t for each feature with values in both arms and at least one spare degree of freedom.

    Without ``s`` the rows of ``m`` have their condition already.
    """
    y, arm = F.col(value), F.col("condition")
    j = m.where(arm.isin(control, treatment)) if s is None else m.join(s.where(arm.isin(control, treatment)).select("study_id", "sample_id", "condition"), ["study_id", "sample_id"])
    one, two = F.when(arm == control, y), F.when(arm == treatment, y)
    g = j.groupBy("study_id", "feature_id").agg(
        F.avg(y).alias("base_mean"), F.count(one).alias("n1"), F.count(two).alias("n2"), F.avg(one).alias("m1"), F.avg(two).alias("m2"), F.coalesce(F.var_samp(one), F.lit(0.0)).alias("v1"), F.coalesce(F.var_samp(two), F.lit(0.0)).alias("v2")
    )
    df = F.col("n1") + F.col("n2") - 2
    s2 = ((F.col("n1") - 1) * F.col("v1") + (F.col("n2") - 1) * F.col("v2")) / df
    u = 1 / F.col("n1") + 1 / F.col("n2")
    fc = F.col("m2") - F.col("m1")
    out = g.where((F.col("n1") > 0) & (F.col("n2") > 0) & (df > 0)).select("study_id", "feature_id", "base_mean", fc.alias("log2fc"), s2.alias("s2"), df.cast("double").alias("df"), u.alias("u"))
    return out.withColumn("t", F.when(F.col("s2") > 0, F.col("log2fc") / F.sqrt(F.col("s2") * F.col("u"))))


def priors(fits: DataFrame) -> DataFrame:
    """(study_id, d0, s02, pooled): the prior of each study from its log variances, and its degrees of freedom in all.

    Features are summed by (study, df) first; what a study's task sees is a row for each distinct df.
    """
    log = F.when(F.col("s2") > 0, F.log("s2"))
    sums = fits.groupBy("study_id", "df").agg(F.count(log).alias("n"), F.sum(log).alias("x"), F.sum(log * log).alias("xx"), F.sum("df").alias("pooled"))

    def prior(t: pd.DataFrame) -> pd.DataFrame:
        pooled, t = t["pooled"].sum(), t[t["n"] > 0]
        if t.empty:
            return pd.DataFrame({"study_id": [], "d0": [], "s02": [], "pooled": []})
        n, half = t["n"].to_numpy(float), t["df"].to_numpy(float) / 2
        shift, tri = digamma(half) - np.log(half), trigamma(half)
        mean = ((t["x"] - n * shift).sum()) / n.sum()
        spread = (t["xx"] - 2 * (shift + mean) * t["x"] + n * (shift + mean) ** 2).sum() / max(n.sum() - 1, 1)
        v = spread - (n * tri).sum() / n.sum()
        d0 = 2 * trigamma_inverse(v) if v > 0 else math.inf
        s02 = math.exp(mean + float(digamma(np.array(d0 / 2))) - math.log(d0 / 2)) if v > 0 else math.exp(mean)
        return pd.DataFrame({"study_id": [t["study_id"].iloc[0]], "d0": [d0], "s02": [s02], "pooled": [pooled]})

    return sums.groupBy("study_id").applyInPandas(prior, "study_id string, d0 double, s02 double, pooled double")


def moderated(fits: DataFrame) -> DataFrame:
    """Adds the prior, moderated variance, t, p-value and standard error to fits (log2fc, s2, df, u). Priors are a row a study."""
    j = fits.join(priors(fits), "study_id")
    inf = F.col("d0") == float("inf")
    post = F.when(inf, F.col("s02")).otherwise((F.col("d0") * F.col("s02") + F.col("df") * F.col("s2")) / (F.col("d0") + F.col("df")))
    total = F.least(F.when(inf, F.col("pooled")).otherwise(F.col("d0") + F.col("df")), F.col("pooled"))
    t = F.col("log2fc") / F.sqrt(F.col("s2_post") * F.col("u"))
    out = j.withColumn("s2_post", post).withColumn("df_total", total).withColumn("stat", t)
    return out.withColumn("pvalue", t_pvalue("stat", "df_total")).withColumn("lfc_se", F.abs(F.col("log2fc") / F.col("stat"))).drop("pooled")


def t_critical(p: np.ndarray, df: np.ndarray) -> np.ndarray:
    """|t| whose two-sided tail is ``p``, by halving on a log scale."""
    p, df = np.broadcast_arrays(np.asarray(p, dtype=float), np.asarray(df, dtype=float))
    low, high = np.full(p.shape, -30.0), np.full(p.shape, 60.0)
    for _ in range(90):
        mid = (low + high) / 2
        above = t_two_sided(np.exp(mid), df) > p
        low, high = np.where(above, mid, low), np.where(above, high, mid)
    return np.exp((low + high) / 2)


#: Share of features taken to be changed, and limits of the standard deviation of their changes, in prior deviations.
CHANGED, CHANGE_LIMITS = 0.01, (0.1, 4.0)


def log_odds(fits: DataFrame, keys: tuple[str, ...] = ("study_id",), changed: float = CHANGED) -> DataFrame:
    """Adds ``b``, the log odds that a feature is changed, to moderated fits (stat, u, df_total, d0, s02).

    The variance of true changes matches the largest t statistics, half the changed share of a study's features, to their quantiles under
    a mixture. Only these few come together in a study's task; a bound from a sketch of quantiles leaves the rest out before they are
    ranked. Statistics with fewer degrees of freedom than the most of their study count as the ones with the same tail there. NULL
    where stat is.
    """
    keys = list(keys)

    def alike(t: pd.Series, df: pd.Series, most: pd.Series) -> pd.Series:
        out = t.abs().to_numpy(float)
        low = (df < most).to_numpy() & t.notna().to_numpy()
        out[low] = t_critical(t_two_sided(out[low], df[low].to_numpy()), most[low].to_numpy())
        return pd.Series(out)

    most = fits.where(F.col("stat").isNotNull()).groupBy(*keys).agg(F.count(F.lit(1)).alias("n"), F.max("df_total").alias("most"))
    j = fits.where(F.col("stat").isNotNull()).join(most, keys).select(*keys, "feature_id", "u", "s02", "n", "most", F.pandas_udf(alike, "double")("stat", "df_total", "most").alias("t"))
    j = once(j)
    cut = j.groupBy(*keys).agg(F.percentile_approx("t", 1 - changed, F.lit(100_000)).alias("cut"))
    rank = F.row_number().over(Window.partitionBy(*keys).orderBy(F.desc("t"), "feature_id"))
    high = j.join(cut, keys).where("t >= cut").withColumn("rank", rank).where(F.col("rank") <= F.ceil(F.col("n") * (changed / 2)))

    def scale(t: pd.DataFrame) -> pd.DataFrame:
        n, most, s02 = float(t["n"].iloc[0]), float(t["most"].iloc[0]), float(t["s02"].iloc[0])
        x, own = t["t"].to_numpy(float), 0.0
        p = max(len(t) / n, changed)
        null = t_two_sided(x, np.full(len(x), most))
        wanted = ((t["rank"].to_numpy(float) - 0.5) / n - (1 - p) * null) / p
        more = wanted > null
        v = np.zeros(len(t))
        if more.any():
            v[more] = t["u"].to_numpy(float)[more] * ((x[more] / t_critical(wanted[more], np.full(int(more.sum()), most))) ** 2 - 1)
        own = float(np.clip(v, *(k * k / s02 for k in CHANGE_LIMITS)).mean())
        return pd.DataFrame({**{k: [t[k].iloc[0]] for k in keys}, "v0": [own]})

    kinds = ", ".join(f"`{k}` {fits.schema[k].dataType.simpleString()}" for k in keys)
    scales = high.groupBy(*keys).applyInPandas(scale, f"{kinds}, v0 double")
    r, t2, df = (F.col("u") + F.col("v0")) / F.col("u"), F.col("stat") * F.col("stat"), F.col("df_total")
    kernel = F.when(F.col("d0") > 1e6, t2 * (1 - 1 / r) / 2).otherwise((1 + df) / 2 * F.log((t2 + df) / (t2 / r + df)))
    return fits.join(scales, keys, "left").withColumn("b", F.lit(math.log(changed / (1 - changed))) - F.log(r) / 2 + kernel).drop("v0")


def moderated_two_group(m: DataFrame, s: DataFrame | None, control: str, treatment: str, value: str = "value", contrast: str | None = None, method: str = "limma") -> DataFrame:
    # a row a feature, read for the priors, for their sums and for itself; the matrix is gone through once
    fit = log_odds(moderated(once(two_group(m, s, control, treatment, value))))
    return fit.select("study_id", F.lit(contrast or f"{treatment}_vs_{control}").alias("contrast_id"), F.lit(method).alias("method"), "feature_id", "base_mean", "log2fc", "lfc_se", "stat", "pvalue", "b", "s2", "t", "df", "df_total")


def term_columns(terms: list[str]) -> list[str]:
    """The columns that terms name, once each."""
    return list(dict.fromkeys(re.sub(r"^C\((.*)\)$", r"\1", part) for term in terms for part in term.split(":")))


def design(samples: pd.DataFrame, terms: list[str]) -> tuple[list[str], np.ndarray]:
    """Names and columns of an intercept and the terms: numbers as they are, other values in treatment coding (``term=level``).

    ``C(term)`` takes the numbers of a column as levels; ``a:b`` is the product of the columns of a and b, an interaction.
    """

    def columns(part: str) -> list[tuple[str, np.ndarray]]:
        name = term_columns([part])[0]
        if name == part and pd.api.types.is_numeric_dtype(samples[name]) and not pd.api.types.is_bool_dtype(samples[name]):
            return [(name, samples[name].to_numpy(float))]
        values = samples[name].astype(str)
        return [(f"{name}={level}", (values == level).to_numpy(float)) for level in sorted(values.unique())[1:]]

    names, cols = ["intercept"], [np.ones(len(samples))]
    for term in terms:
        for parts in itertools.product(*map(columns, term.split(":"))):
            names.append(":".join(n for n, _ in parts))
            cols.append(np.prod([c for _, c in parts], axis=0))
    return names, np.column_stack(cols)


#: Levels from which a factor is taken out of a linear model, and most columns of the other terms then.
LARGE, NARROW = 64, 12


def linear_model(m: DataFrame, s: DataFrame, terms: list[str], contrasts: dict[str, dict[str, float]], value: str = "value", large: int = LARGE) -> DataFrame:
    """Estimate, residual variance, degrees of freedom and t of each contrast for every feature; ``terms`` as in ``design``.

    A feature is a row of cells: the samples with the same terms count by number, mean and squares, so its size is that of the design, not of the
    study. A factor of ``large`` levels or more that no contrast asks for is taken out first (``within_levels``). Samples without a value of a term
    don't count. A contrast that the samples with values can't estimate gives no row.
    """
    used, kind = term_columns(terms), dict(s.dtypes)
    m, known = m.where(~F.isnan(F.col(value).cast("double")) & F.col(value).isNotNull()), s.select("study_id", "sample_id", *used).dropna()
    asked = {part.split("=")[0] for parts in contrasts.values() for name in parts for part in name.split(":")}
    if terms == used and "intercept" not in asked and all(kind[t] == "string" for t in terms) and not asked.issuperset(terms):
        found = known.agg(*(F.approx_count_distinct(t).alias(t) for t in terms)).first().asDict()
        most = max((t for t in terms if t not in asked), key=lambda t: found[t])
        rest = [t for t in terms if t != most]
        if found[most] >= large and sum(found[t] for t in rest) <= NARROW:
            return within_levels(m, known, most, rest, contrasts, value)
    y = F.col(value).cast("double")
    cells = m.join(known, ["study_id", "sample_id"]).groupBy("study_id", "feature_id", *used).agg(F.count(F.lit(1)).cast("double").alias("__n"), F.avg(y).alias("__m"), F.var_pop(y).alias("__v"))
    packed = cells.groupBy("study_id", "feature_id").agg(F.sort_array(F.collect_list(F.struct(*used, "__n", "__m", "__v"))).alias("__c"))
    packed = packed.select("study_id", "feature_id", *(F.col("__c").getField(c).alias(c2) for c, c2 in (*((c, f"__t{i}") for i, c in enumerate(used)), ("__n", "__n"), ("__m", "__m"), ("__v", "__v"))))

    def fit(batches):
        for t in batches:
            out = []
            designed = t[["study_id", "__n", *(f"__t{i}" for i in range(len(used)))]].apply(lambda r: (r.iloc[0], *(tuple(v) for v in r.iloc[1:])), axis=1) if len(t) else []
            for (study, n, *values), rows in t.groupby(pd.Series(list(designed), index=t.index), sort=False) if len(t) else ():
                samples, n = pd.DataFrame({c: list(v) for c, v in zip(used, values, strict=True)}), np.array(n)
                names, x = design(samples, terms) if used else (["intercept"], np.ones((len(n), 1)))
                df = int(n.sum()) - int(np.linalg.matrix_rank(x))
                if df <= 0:
                    continue
                root = np.sqrt(n)
                inv = np.linalg.pinv(x * root[:, None]) * root
                mean = np.stack(rows["__m"].to_list())
                beta = mean @ inv.T
                rest = mean - beta @ x.T
                s2 = ((rest * rest + np.stack(rows["__v"].to_list())) @ n) / df
                for name, parts in contrasts.items():
                    c = np.array([parts.get(k, 0.0) for k in names])
                    if any(p not in names for p in parts) or not np.allclose(c @ inv @ x, c, atol=1e-8):
                        continue
                    w = c @ inv
                    u = float((w * w / n).sum())
                    with np.errstate(divide="ignore", invalid="ignore"):
                        tt = np.where(s2 > 1e-14, (beta @ c) / np.sqrt(s2 * u), np.nan)
                    out.append(pd.DataFrame({"study_id": study, "contrast_id": name, "feature_id": rows["feature_id"].to_numpy(), "base_mean": mean @ n / n.sum(), "log2fc": beta @ c, "s2": s2, "df": float(df), "u": u, "t": tt}))
            yield pd.concat(out)[FITTED] if out else pd.DataFrame({c: [] for c in FITTED})

    return packed.mapInPandas(fit, FITTED_FORM)


FITTED = ["study_id", "contrast_id", "feature_id", "base_mean", "log2fc", "s2", "df", "u", "t"]
FITTED_FORM = "study_id string, contrast_id string, feature_id string, base_mean double, log2fc double, s2 double, df double, u double, t double"


def within_levels(m: DataFrame, s: DataFrame, factor: str, terms: list[str], contrasts: dict[str, dict[str, float]], value: str) -> DataFrame:
    """``linear_model`` with ``factor`` and the factors ``terms``, from sums within the levels of ``factor``.

    Estimates of other terms are those of values and columns less their means in each level, so a feature is a few sums of products,
    whatever the levels. There are few other columns, one for each level of a term.
    """
    columns = [(t, r[0]) for t in terms for r in s.select(t).distinct().orderBy(t).collect()]
    size = range(len(columns))
    y = F.col(value).cast("double")
    j = m.join(s, ["study_id", "sample_id"]).select("study_id", "feature_id", factor, y.alias("__y"), *((F.col(t) == level).cast("double").alias(f"__z{i}") for i, (t, level) in enumerate(columns)))
    n = F.count(F.lit(1))
    pairs = [(i, k) for i in size for k in range(i, len(columns))]
    level = j.groupBy("study_id", "feature_id", factor).agg(
        n.alias("n"), F.sum("__y").alias("y"), (F.var_pop("__y") * n).alias("yy"), *(F.sum(f"__z{i}").alias(f"z{i}") for i in size), *((F.covar_pop(f"__z{i}", "__y") * n).alias(f"y{i}") for i in size), *((F.covar_pop(f"__z{i}", f"__z{k}") * n).alias(f"x{i}_{k}") for i, k in pairs)
    )
    summed = ["n", "y", "yy", *(f"z{i}" for i in size), *(f"y{i}" for i in size), *(f"x{i}_{k}" for i, k in pairs)]
    sums = level.groupBy("study_id", "feature_id").agg(F.count(F.lit(1)).alias("levels"), *(F.sum(c).cast("double").alias(c) for c in summed))

    def fit(batches):
        for t in batches:
            out = []
            for r in t.to_dict("records"):
                there = {c: [i for i in size if columns[i][0] == c and r[f"z{i}"] > 0] for c in terms}
                kept = [i for c in terms for i in there[c][1:]]  # the first level is the base
                names = [f"{columns[i][0]}={columns[i][1]}" for i in kept]
                x = np.array([[r[f"x{min(i, k)}_{max(i, k)}"] for k in kept] for i in kept]).reshape(len(kept), -1)
                inv = np.linalg.pinv(x, rcond=1e-10, hermitian=True) if kept else x
                df = r["n"] - r["levels"] - (np.linalg.matrix_rank(x, tol=1e-10 * max(np.abs(x).max(), 1.0), hermitian=True) if kept else 0)
                if df <= 0:
                    continue
                xy = np.array([r[f"y{i}"] for i in kept])
                beta = inv @ xy
                s2 = max(r["yy"] - float(beta @ xy), 0.0) / df
                for name, parts in contrasts.items():
                    c = np.array([parts.get(k, 0.0) for k in names])
                    if any(p not in names for p in parts) or not np.allclose(c @ inv @ x, c, atol=1e-8):
                        continue
                    u = float(c @ inv @ c)
                    out.append((r["study_id"], name, r["feature_id"], r["y"] / r["n"], float(c @ beta), s2, float(df), u, float(c @ beta) / math.sqrt(s2 * u) if s2 > 1e-14 and u > 0 else math.nan))
            yield pd.DataFrame(out, columns=FITTED)

    return sums.mapInPandas(fit, FITTED_FORM)


def paired_change(m: DataFrame, s: DataFrame, baseline: str, follow_up: str) -> DataFrame:
    """Follow-up minus baseline of each complete subject."""
    arms = m.join(s.select("study_id", "sample_id", "subject", "condition"), ["study_id", "sample_id"])
    a = arms.where(F.col("condition") == baseline).select("study_id", "subject", "feature_id", F.col("value").alias("before"))
    b = arms.where(F.col("condition") == follow_up).select("study_id", "subject", "feature_id", F.col("value").alias("after"))
    return a.join(b, ["study_id", "subject", "feature_id"]).withColumn("change", F.col("after") - F.col("before"))


def subject_pairs(s: DataFrame, baseline: str, follow_up: str, time: str = "condition") -> DataFrame:
    """(study_id, subject, n_baseline, n_follow_up, reason): which subjects are complete (reason NULL), and why the others aren't.

    Complete is one baseline and one follow-up sample; what is missing or repeated is said, never guessed.
    """
    n = lambda level: F.count_if(F.col(time) == level)
    g = s.where(F.col("subject").isNotNull()).groupBy("study_id", "subject").agg(n(baseline).alias("n_baseline"), n(follow_up).alias("n_follow_up"))
    reason = F.when(F.col("n_baseline") == 0, "missing_baseline").when(F.col("n_follow_up") == 0, "missing_followup").when((F.col("n_baseline") > 1) | (F.col("n_follow_up") > 1), "duplicate_samples")
    return g.withColumn("reason", reason)


def change_between_groups(m: DataFrame, s: DataFrame, baseline: str, follow_up: str, group: str, control: str, treatment: str, time: str = "condition", least: int = 4, value: str = "value") -> DataFrame:
    """The change of each complete subject, compared between two groups of subjects by a moderated test: does one group change more?

    A subject's group is that of its follow-up sample. Studies with fewer than ``least`` complete subjects of the two groups have no rows.
    """
    whole = subject_pairs(s, baseline, follow_up, time).where("reason is null").select("study_id", "subject")
    known = s.join(whole, ["study_id", "subject"])
    later = known.where((F.col(time) == follow_up) & F.col(group).isin(control, treatment)).select("study_id", "subject", F.col(group).alias("condition"), F.col("sample_id").alias("after_id"))
    both = later.join(known.where(F.col(time) == baseline).select("study_id", "subject", F.col("sample_id").alias("before_id")), ["study_id", "subject"])
    enough = both.groupBy("study_id").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= least).select("study_id")
    both = once(both.join(enough, "study_id"))
    side = lambda which: m.select("study_id", "feature_id", F.col("sample_id").alias(f"{which}_id"), F.col(value).cast("double").alias(which))
    change = both.join(side("after"), ["study_id", "after_id"]).join(side("before"), ["study_id", "before_id", "feature_id"])
    change = change.select("study_id", "feature_id", F.col("subject").alias("sample_id"), (F.col("after") - F.col("before")).alias("value")).where("value is not null")
    return moderated_two_group(change, both.select("study_id", F.col("subject").alias("sample_id"), "condition"), control, treatment, method="paired_change")


#: Samples of a matrix of products, tiles of a study, least samples of a tile, values of a tile that are held, features of one product, pairs of a batch.
TILE, TILES, LEAST_TILE, HELD, BLOCK, PAIRS = 2048, 8, 64, 1 << 23, 1024, 1 << 18
HELD_BLOCK = 64
#: How far from the lowest correlation a pair may be to be told: more than rounding moves it.
NEAR = 1e-5


def sample_corr(m: DataFrame, method: str = "pearson", tile: int = TILE, block: int = BLOCK, held: int = HELD, lowest: bool = False) -> DataFrame:
    """Correlation of all pairs of samples of a study over the features that both have; with ``lowest`` at least the pairs within NEAR of the lowest.

    Samples are cut into tiles, TILES a study, since values go to as many tasks as there are tiles. A feature's values for a tile are one row, so
    rows meet once for each pair of tiles, not of samples. A pair of tiles comes to one task, which gives the pairs with their names: pairs are
    never shuffled. Tiles of no more than ``tile`` samples stream by while their products are added up, whatever the features. Larger ones, of
    ``held`` values at most, are held, and their products made ``tile`` by ``tile``.
    """
    v = m.where(F.col("value").isNotNull()).withColumn("v", F.col("value").cast("double"))
    if method == "spearman":
        v = average_rank(v, ["study_id", "sample_id"], "v").withColumn("v", F.col("avg_rank"))
    v = stored(v.select("study_id", "feature_id", "sample_id", "v"))
    means = v.groupBy("study_id", "sample_id").agg(F.avg("v").alias("mean"))
    place = F.row_number().over(Window.partitionBy("study_id").orderBy("sample_id")) - 1
    features = v.groupBy("study_id").agg(F.approx_count_distinct("feature_id").alias("features"))
    most = F.greatest(F.lit(tile), F.floor(F.lit(held) / F.col("features")))
    width = F.least(most, F.greatest(F.lit(min(tile, LEAST_TILE)), F.ceil(F.count(F.lit(1)).over(Window.partitionBy("study_id")) / TILES)))
    placed = means.join(F.broadcast(features), "study_id").select("study_id", "sample_id", "mean", place.alias("at"), width.alias("width")).withColumn("tile", F.floor(F.col("at") / F.col("width")).cast("int")).withColumn("at", (F.col("at") % F.col("width")).cast("int"))
    placed = once(placed)
    c = v.join(placed.select("study_id", "sample_id", "tile", "at"), ["study_id", "sample_id"])
    tiles = c.groupBy("study_id", "feature_id", "tile").agg(F.sort_array(F.collect_list(F.struct(F.col("at").alias("i"), "v"))).alias("p"))
    # places aren't written where they are 0, 1, 2 and so on
    tiles = tiles.select("study_id", "feature_id", "tile", F.struct(F.when(F.element_at("p.i", -1) + 1 != F.size("p"), F.col("p.i")).alias("i"), F.col("p.v").alias("v")).alias("p"))
    heads = placed.groupBy("study_id", "tile").agg(F.array_sort(F.collect_list(F.struct("at", "sample_id", "mean"))).alias("p"))
    form = {"i": "array<int>", "v": "array<double>", "name": f"array<{m.schema['sample_id'].dataType.simpleString()}>", "mean": "array<double>"}

    def met(df: DataFrame, keys: list[str], fields: dict[str, str]) -> DataFrame:
        x, y = (df.select(*keys, F.col("tile").alias(f"tile_{k}"), *(F.col(f"p.{at}").alias(f"{name}_{k}") for name, at in fields.items())) for k in "xy")
        rows = x.join(y, keys).where("tile_x <= tile_y")
        part = lambda name, k: F.col(f"{name}_{k}") if name in fields else F.lit(None).cast(form[name]).alias(f"{name}_{k}")
        return rows.select("study_id", "tile_x", "tile_y", F.lit("i" in fields).alias("data"), *(part(name, k) for k in "xy" for name in form))

    # a pair of tiles begins with its row of names and means
    rows = met(heads, ["study_id"], {"name": "sample_id", "mean": "mean"}).unionByName(met(tiles, ["study_id", "feature_id"], {"i": "i", "v": "v"}))
    keys = ["study_id", "tile_x", "tile_y"]
    kind = {k: m.schema[k].dataType.simpleString() for k in ("study_id", "sample_id")}
    ordered = rows.repartition(*keys).sortWithinPartitions(*keys, "data")
    return ordered.mapInArrow(lambda batches: tile_pairs(batches, block, tile, lowest), f"study_id {kind['study_id']}, sample_a {kind['sample_id']}, sample_b {kind['sample_id']}, r double")


class TileSums:
    """Sums of products of two tiles. Where no value is missing, squares and counts are those of a sample, not of a pair."""

    def __init__(self, sizes: tuple[int, int], same: bool):
        self.same, self.n, self.squares = same, 0, [np.zeros(k) for k in sizes]
        self.xy, self.pairwise = np.zeros(sizes), None

    def add(self, x: np.ndarray, y: np.ndarray) -> None:
        """Rows of features, less the means of samples, NaN where a value is missing."""
        if np.isnan(x).any() or np.isnan(y).any():
            hx, hy = (~np.isnan(x)).astype(float), (~np.isnan(y)).astype(float)
            x, y = np.nan_to_num(x), np.nan_to_num(y)
            more = (hx.T @ hy, (x * x).T @ hy, hx.T @ (y * y))
            self.pairwise = more if self.pairwise is None else tuple(a + b for a, b in zip(self.pairwise, more, strict=True))
        else:
            self.n += len(x)
            self.squares = [s + (z * z).sum(axis=0) for s, z in zip(self.squares, (x, y), strict=True)]
        self.xy += x.T @ y

    def correlations(self, lowest: bool = False):
        """(i, j, r) of the pairs with a common feature, a batch of rows at a time; r is NaN without variance."""
        step = max(1, PAIRS // max(1, self.xy.shape[1]))
        for a in range(0, len(self.xy), step):
            at = slice(a, a + step)
            n, xx, yy = self.n, self.squares[0][at, None], self.squares[1][None, :]
            if self.pairwise is not None:
                n, xx, yy = n + self.pairwise[0][at], xx + self.pairwise[1][at], yy + self.pairwise[2][at]
            with np.errstate(divide="ignore", invalid="ignore"):
                r = self.xy[at] / np.sqrt(xx * yy)
            there = np.broadcast_to(n > 0, r.shape)
            if self.same:
                there = there & (np.arange(a, a + len(r))[:, None] < np.arange(r.shape[1])[None, :])
            if lowest:
                unknown = there & np.isnan(r)
                first = np.flatnonzero(unknown)[:1]  # of pairs without variance the first by name
                there = there & (r <= np.min(r, where=there & ~unknown, initial=np.inf) + NEAR)
                there.ravel()[first] = True
            i, j = np.nonzero(there)
            yield i + a, j, r[i, j]


class TilePair:
    """The rows of a pair of tiles: added up as they come if the tiles are small, else held until all are there."""

    def __init__(self, head: dict, block: int, tile: int):
        self.names = [head["name_x"], head["name_y"]]
        self.means = [np.array(head["mean_x"]), np.array(head["mean_y"])]
        self.same, self.tile, self.filled, self.rows, self.kept = head["tile_x"] == head["tile_y"], tile, 0, None, ([], [])
        sizes = tuple(map(len, self.means))
        self.sums = TileSums(sizes, self.same) if max(sizes) <= tile else None
        self.block = block if self.sums else min(block, HELD_BLOCK)

    def add(self, x: tuple[np.ndarray | None, np.ndarray], y: tuple[np.ndarray | None, np.ndarray]) -> None:
        if self.rows is None:
            self.rows = [np.full((self.block, len(m)), np.nan) for m in self.means]
        for rows, mean, (i, v) in zip(self.rows, self.means, (x, y), strict=True):
            i = slice(len(v)) if i is None else i
            rows[self.filled] = np.nan
            rows[self.filled, i] = v - mean[i]
        self.filled += 1
        if self.filled == self.block:
            self.flush()

    def flush(self) -> None:
        if not self.filled:
            return
        if self.sums:
            self.sums.add(*(r[: self.filled] for r in self.rows))
        else:
            for kept, r in zip(self.kept, self.rows, strict=True):
                kept.append(r[: self.filled].copy() if self.filled < self.block else r)
            self.rows = None
        self.filled = 0

    def correlations(self, lowest: bool):
        self.flush()
        if self.sums:
            yield from self.sums.correlations(lowest)
            return
        whole = []
        for side in self.kept:
            whole.append(np.concatenate(side) if side else np.zeros((0, len(self.means[len(whole)]))))
            side.clear()
        for a in range(0, len(self.means[0]), self.tile):
            for b in range(a if self.same else 0, len(self.means[1]), self.tile):
                x, y = slice(a, a + self.tile), slice(b, b + self.tile)
                sums = TileSums((len(self.means[0][x]), len(self.means[1][y])), self.same and a == b)
                for low in range(0, len(whole[0]), BLOCK):
                    sums.add(whole[0][low : low + BLOCK, x], whole[1][low : low + BLOCK, y])
                for i, j, r in sums.correlations(lowest):
                    yield i + a, j + b, r


def tile_pairs(batches, block: int, tile: int = TILE, lowest: bool = False):
    """Batches of pairs with their correlation, from rows of pairs of tiles that come in order, each pair's names and means first."""
    key, sums, study = None, None, None

    def told():
        if sums is not None:
            named = [pa.array(names, k) for names, k in zip(sums.names, kinds, strict=True)]
            for i, j, r in sums.correlations(lowest):
                yield pa.RecordBatch.from_arrays([pa.repeat(study, len(r)), named[0].take(pa.array(i)), named[1].take(pa.array(j)), pa.array(r, mask=np.isnan(r))], ["study_id", "sample_a", "sample_b", "r"])

    kinds = None
    for t in batches:
        kinds = [t.schema.field(f"name_{k}").type.value_type for k in "xy"]
        columns = {c: t.column(c) for c in t.schema.names}
        for row in range(t.num_rows):
            now = tuple(columns[c][row] for c in ("study_id", "tile_x", "tile_y"))
            if now != key:
                yield from told()
                key, study = now, now[0]
                sums = TilePair({"tile_x": now[1], "tile_y": now[2], **{c: columns[c][row].as_py() for c in ("name_x", "name_y", "mean_x", "mean_y")}}, block, tile)
            else:
                side = lambda k: (columns[f"i_{k}"][row].values, columns[f"v_{k}"][row].values.to_numpy())
                sums.add(*((i if i is None else i.to_numpy(), v) for i, v in map(side, "xy")))
    yield from told()


def lowest_pair(corr: DataFrame) -> DataFrame:
    """The pair with the lowest correlation of each study, the first by name of equal ones; pairs without one come last."""
    return corr.groupBy("study_id").agg(F.min(F.struct(F.col("r").isNull().alias("none"), "r", "sample_a", "sample_b")).alias("m")).select("study_id", "m.sample_a", "m.sample_b", "m.r")


def pca(m: DataFrame, n: int = 2, value: str = "value") -> DataFrame:
    """Scores and explained variance of the samples of each study, features centred and not scaled.

    Only features with a value for every sample of their study count; samples without any value aren't there. Products are summed over the
    longer side of a study's matrix, so the one eigenproblem a study is that of its shorter side: of features where they are fewer than
    samples, else of samples. Matrices are made of as many rows as they have, so they hold no more than the values do.
    """
    v = m.select("study_id", "feature_id", "sample_id", F.col(value).cast("double").alias("v")).where(F.col("v").isNotNull() & ~F.isnan("v"))
    size = v.select("study_id", "sample_id").distinct().groupBy("study_id").agg(F.count(F.lit(1)).alias("n"))
    once_each = v.groupBy("study_id", "feature_id", "sample_id").agg(F.count(F.lit(1)).alias("k"), F.sum("v").alias("s"))
    means = once_each.groupBy("study_id", "feature_id").agg(F.count(F.lit(1)).alias("there"), F.max("k").alias("k"), (F.sum("s") / F.count(F.lit(1))).alias("mean")).join(size, "study_id").where("k = 1 and there = n")
    means = once(means.withColumn("d", F.count(F.lit(1)).over(Window.partitionBy("study_id"))).select("study_id", "feature_id", "mean", "n", "d"))
    c = v.join(means, ["study_id", "feature_id"]).withColumn("c", F.col("v") - F.col("mean"))
    by_feature = (F.col("d") >= n) & (F.col("d") < F.col("n"))

    def packed(rows: DataFrame, row: str, column: str) -> DataFrame:
        p = rows.groupBy("study_id", row).agg(F.sort_array(F.collect_list(F.struct(column, "c"))).alias("p"), F.first("n").alias("n"), F.first("d").alias("d"))
        short, long = F.least("n", "d"), F.greatest("n", "d")
        return p.select("study_id", row, F.floor(F.pmod(F.xxhash64(row), F.greatest(F.lit(1), F.floor(long / short)))).alias("block"), F.col(f"p.{column}").alias("names"), F.col("p.c").alias("c"))

    def gram(pdf: pd.DataFrame) -> pd.DataFrame:
        x = np.stack(pdf["c"].to_list())
        return pd.DataFrame({"study_id": [pdf["study_id"].iloc[0]], "block": [int(pdf["block"].iloc[0])], "names": [pdf["names"].iloc[0]], "g": [(x.T @ x).ravel()]})

    def added(pdf: pd.DataFrame) -> pd.DataFrame:
        return pd.DataFrame({"study_id": [pdf["study_id"].iloc[0]], "block": [int(pdf["block"].iloc[0])], "names": [pdf["names"].iloc[0]], "g": [np.sum(np.stack(pdf["g"].to_list()), axis=0)]})

    def products(p: DataFrame) -> DataFrame:
        form = "study_id string, block bigint, names array<string>, g array<double>"
        blocks = p.groupBy("study_id", "block").applyInPandas(gram, form)
        for _ in range(3):  # matrices are added eight at a time
            blocks = blocks.withColumn("block", F.floor(F.col("block") / 8)).groupBy("study_id", "block").applyInPandas(added, form)
        return blocks

    def eigen(pdf: pd.DataFrame) -> tuple[list, np.ndarray, np.ndarray]:
        names = list(pdf["names"].iloc[0])
        values, vectors = np.linalg.eigh(np.sum(np.stack(pdf["g"].to_list()), axis=0).reshape(len(names), -1))
        return names, values[::-1], vectors[:, ::-1]

    def of_samples(pdf: pd.DataFrame) -> pd.DataFrame:
        names, values, vectors = eigen(pdf)
        return pd.concat([pd.DataFrame({"study_id": pdf["study_id"].iloc[0], "component": i + 1, "sample_id": names, "score": vectors[:, i] * math.sqrt(max(values[i], 0)), "ratio": max(values[i], 0) / max(values.clip(0).sum(), 1e-300)}) for i in range(min(n, len(names)))])

    def of_features(pdf: pd.DataFrame) -> pd.DataFrame:
        _, values, vectors = eigen(pdf)
        return pd.DataFrame([(pdf["study_id"].iloc[0], i + 1, vectors[:, i].tolist(), max(values[i], 0) / max(values.clip(0).sum(), 1e-300)) for i in range(n)], columns=["study_id", "component", "vector", "ratio"])

    form = "study_id string, component int, sample_id string, score double, ratio double"
    whole = products(packed(c.where(~by_feature), "feature_id", "sample_id")).groupBy("study_id").applyInPandas(of_samples, form)
    rows = packed(c.where(by_feature), "sample_id", "feature_id")
    axes = products(rows).groupBy("study_id").applyInPandas(of_features, "study_id string, component int, vector array<double>, ratio double")
    score = F.aggregate(F.zip_with("c", "vector", lambda a, b: a * b), F.lit(0.0), lambda a, b: a + b)
    scores = whole.unionByName(rows.join(axes, "study_id").select("study_id", "component", "sample_id", score.alias("score"), "ratio"))
    # the largest score of a component is positive
    side = scores.groupBy("study_id", "component").agg(F.max_by("score", F.abs("score")).alias("side"))
    return scores.join(side, ["study_id", "component"]).select("study_id", "component", "sample_id", F.when(F.col("side") < 0, -F.col("score")).otherwise(F.col("score")).alias("score"), "ratio")


def gathered(m: DataFrame) -> DataFrame:
    """A row a feature: its samples in order and their values, as two arrays."""
    rows = m.groupBy("study_id", "feature_id").agg(F.sort_array(F.collect_list(F.struct("sample_id", F.col("value").cast("double").alias("v")))).alias("p"))
    return rows.select("study_id", "feature_id", F.col("p.sample_id").alias("samples"), F.col("p.v").alias("values"))


def size_factors(m: DataFrame) -> DataFrame:
    """Median over features with all counts positive of exp(ln count - mean ln count)."""
    return gathered_size_factors(gathered(m))


def gathered_size_factors(rows: DataFrame) -> DataFrame:
    """``size_factors`` of rows of ``gathered``: what a feature's samples share is told within its row."""
    logs = rows.where(F.array_min("values") > 0).select("study_id", "samples", F.transform("values", lambda v: F.log(v)).alias("ln"))
    known = F.filter("ln", lambda v: v.isNotNull())
    mean = F.aggregate(known, F.lit(0.0), lambda a, v: a + v) / F.size(known)
    each = logs.select("study_id", mean.alias("mean"), F.explode(F.arrays_zip("samples", "ln")).alias("p")).select("study_id", F.col("p.samples").alias("sample_id"), (F.col("p.ln") - F.col("mean")).alias("d"))
    return each.groupBy("study_id", "sample_id").agg(F.exp(F.percentile("d", F.lit(0.5))).alias("size_factor"))


def dispersions(m: DataFrame, factors: DataFrame) -> DataFrame:
    """Base mean, variance and method-of-moments dispersion of counts scaled by size factors."""
    j = m.join(factors, ["study_id", "sample_id"]).withColumn("q", F.col("value") / F.col("size_factor"))
    xi = F.avg(1 / F.col("size_factor"))
    s = j.groupBy("study_id", "feature_id").agg(F.avg("q").alias("base_mean"), F.var_samp("q").alias("base_var"), xi.alias("xi"))
    return s.where("base_mean > 0").select("study_id", "feature_id", "base_mean", "base_var", F.greatest(F.lit(1e-8), (F.col("base_var") - F.col("xi") * F.col("base_mean")) / F.col("base_mean") ** 2).alias("dispersion"))


def tmm(m: DataFrame, trim_m: float = 0.3, trim_a: float = 0.05) -> DataFrame:
    """Trimmed means of M values against the sample whose upper quartile is nearest the mean one; factors have geometric mean 1."""
    return gathered_tmm(stored(gathered(m)), trim_m, trim_a).drop("lib")


def gathered_tmm(rows: DataFrame, trim_m: float = 0.3, trim_a: float = 0.05) -> DataFrame:
    """(study_id, sample_id, lib, tmm_factor) of a written table of ``gathered``.

    A feature's row holds the reference's count too, so rows don't meet. A sample's features with equal counts there and in the reference
    have equal M and A values: they are one row with a number, and ranks are sums of numbers.
    """
    keys, n = ["study_id", "sample_id"], F.col("n")
    each = rows.select("study_id", F.explode(F.arrays_zip("samples", "values")).alias("p")).select("study_id", F.col("p.samples").alias("sample_id"), F.col("p.values").alias("value"))
    counts = each.groupBy(*keys, "value").agg(F.count(F.lit(1)).alias("n"))
    lib = once(each.groupBy(*keys).agg(F.sum("value").alias("lib")))
    q = counts.join(F.broadcast(lib), keys).groupBy(*keys).agg(F.percentile(F.col("value") / F.col("lib"), F.lit(0.75), n).alias("q"))
    off = F.abs(F.col("q") - F.avg("q").over(Window.partitionBy("study_id")))
    ref = q.withColumn("off", off).groupBy("study_id").agg(F.min_by("sample_id", F.struct("off", "sample_id")).alias("ref"))
    ref = ref.join(lib.select("study_id", F.col("sample_id").alias("ref"), F.col("lib").alias("rl")), ["study_id", "ref"])
    r = rows.join(F.broadcast(ref), "study_id").withColumn("rv", F.try_element_at("values", F.nullif(F.array_position("samples", F.col("ref")), F.lit(0).cast("long")).cast("int"))).where("rv > 0")
    pairs = r.select("study_id", "rv", "rl", F.explode(F.arrays_zip("samples", "values")).alias("p")).select("study_id", F.col("p.samples").alias("sample_id"), F.col("p.values").alias("value"), "rv", "rl").where("value > 0")
    p = pairs.groupBy(*keys, "value", "rv", "rl").agg(F.count(F.lit(1)).alias("n")).join(F.broadcast(lib), keys)
    x, y = F.col("value") / F.col("lib"), F.col("rv") / F.col("rl")
    p = p.select(*keys, "n", F.log2(x / y).alias("mv"), (F.log2(x * y) / 2).alias("av"), ((F.col("lib") - F.col("value")) / F.col("lib") / F.col("value") + (F.col("rl") - F.col("rv")) / F.col("rl") / F.col("rv")).alias("var"))
    # the mean rank of ties, from how many are no larger and how many are equal
    rank = lambda c: F.sum(n).over(Window.partitionBy(*keys).orderBy(c)) - (F.sum(n).over(Window.partitionBy(*keys, c)) - 1) / 2
    ranked = p.withColumn("rm", rank("mv")).withColumn("ra", rank("av")).withColumn("all", F.sum(n).over(Window.partitionBy(*keys)))
    inside = lambda rank, trim: (rank >= F.floor(F.col("all") * trim) + 1) & (rank <= F.col("all") - F.floor(F.col("all") * trim))
    f = ranked.where(inside(F.col("rm"), trim_m) & inside(F.col("ra"), trim_a) & (F.col("var") > 0)).groupBy(*keys).agg((F.sum(n * F.col("mv") / F.col("var")) / F.sum(n / F.col("var"))).alias("lf"))
    every = lib.join(f, keys, "left").withColumn("lf", F.coalesce("lf", F.lit(0.0)))
    return every.select(*keys, "lib", F.pow(F.lit(2.0), F.col("lf") - F.avg("lf").over(Window.partitionBy("study_id"))).alias("tmm_factor"))


def infer_sex(cpm: DataFrame, y_genes: list[str], x_gene: str, margin: float = 1.0) -> DataFrame:
    """Sex of each sample from log CPM: the mean of Y markers minus the X marker, called beyond the margin."""
    f = F.col("feature_id")
    s = cpm.where(f.isin(*y_genes, x_gene)).groupBy("study_id", "sample_id").agg(F.avg(F.when(f.isin(*y_genes), F.col("log_cpm"))).alias("y_mean"), F.avg(F.when(f == x_gene, F.col("log_cpm"))).alias("x_value"))
    gap = F.col("y_mean") - F.col("x_value")
    call: Column = F.when(gap > margin, "male").when(gap < -margin, "female").otherwise("ambiguous")
    return s.select("study_id", "sample_id", gap.alias("gap"), call.alias("sex"), F.when(F.abs(gap) > 2 * margin, "high").when(F.abs(gap) > margin, "medium").otherwise("low").alias("confidence"))
