"""Count models against plain numpy, on features of many levels of abundance."""

import math

import numpy as np
import pytest

from assayloom.operators import counts as N
from assayloom.operators import negbin as B
from assayloom.operators import precision as P
from assayloom.operators import quasi as Q
from assayloom.operators import results as R
from assayloom.operators import stats as S


def table(spark, y, study="st", treated=None):
    n = y.shape[1]
    treated = treated or [j >= n // 2 for j in range(n)]
    rows = [(study, f"f{i:05}", f"s{j:03}", int(v)) for i, r in enumerate(y) for j, v in enumerate(r)]
    m = spark.createDataFrame(rows, "study_id string, feature_id string, sample_id string, value long")
    return m, spark.createDataFrame([(study, f"s{j:03}", "b" if t else "a") for j, t in enumerate(treated)], "study_id string, sample_id string, condition string")


def draw(seed, features, samples, fold=None, asymptote=0.05, extra=3.0):
    """Counts with dispersion asymptote + extra / mean."""
    rng = np.random.default_rng(seed)
    mean = np.exp(rng.uniform(math.log(3), math.log(3000), features))
    size = rng.uniform(0.6, 1.6, samples)
    alpha = (asymptote + extra / mean)[:, None] * np.ones(samples)
    mu = mean[:, None] * size
    if fold is not None:
        mu[:, samples // 2 :] *= fold[:, None]
    return rng.poisson(rng.gamma(1 / alpha, alpha * mu))


def lg(x):
    return np.vectorize(math.lgamma)(x)


def apl(y, x, size, a):
    """One feature, one dispersion, by plain Newton steps to the end."""
    beta = np.linalg.lstsq(x, np.log((y + 0.5) / size), rcond=None)[0]
    for _ in range(60):
        mu = np.exp(x @ beta) * size
        w = mu / (1 + a * mu)
        beta = beta + np.clip(np.linalg.solve((x.T * w) @ x + 1e-6 * np.eye(x.shape[1]), x.T @ (w * (y - mu) / mu) - 1e-6 * beta), -2, 2)
    mu = np.exp(x @ beta) * size
    ll = (lg(y + 1 / a) - math.lgamma(1 / a) + y * np.log(a * mu / (1 + a * mu)) - np.log1p(a * mu) / a).sum()
    return ll - 0.5 * np.linalg.slogdet((x.T * (mu / (1 + a * mu))) @ x + 1e-6 * np.eye(x.shape[1]))[1]


def peak(curve):
    k = int(np.argmax(curve))
    if k in (0, len(curve) - 1):
        return math.exp(Q.CURVE[k])
    a, b, c = curve[k - 1 : k + 2]
    return math.exp(Q.CURVE[k] + 0.5 * (a - c) / (a - 2 * b + c) * Q.STEP)


def test_tagwise_dispersions_equal_numpy(spark):
    y = draw(1, 60, 8)
    y[7] = [0, 0, 0, 1, 0, 0, 0, 0]  # below the least total: no part in what features share
    m, s = table(spark, y)
    eff = {r["sample_id"]: r["size"] for r in Q.effective_sizes(m).collect()}
    lib, factor = y.sum(axis=0), {r["sample_id"]: r["tmm_factor"] for r in S.tmm(m).collect()}
    assert all(abs(eff[f"s{j:03}"] - lib[j] * factor[f"s{j:03}"]) < 1e-6 for j in range(8))
    size, x = np.array([eff[f"s{j:03}"] for j in range(8)]), np.column_stack([np.ones(8), np.arange(8) >= 4]).astype(float)
    curve = np.array([[apl(r, x, size, math.exp(a)) for a in Q.CURVE] for r in y])
    extra = 2 * size / size.mean()
    level = np.log2(((y + extra) / (size + 2 * extra)).mean(axis=1) * 1e6)
    cuts = np.quantile(level, [k / 100 for k in range(1, 100)], method="inverted_cdf")
    group = (cuts[None, :] < level[:, None]).sum(axis=1)
    n = np.bincount(group[y.sum(axis=1) >= 5], minlength=100)
    kept = y.sum(axis=1) >= 5
    middle = np.cumsum(n) - n / 2
    width = (10 / kept.sum()) ** 0.23 * kept.sum() / 2
    expected = []
    for i in range(60):
        near = kept & ((np.abs(middle[group] - middle[group[i]]) <= width) | (group == group[i]))
        expected.append(peak(curve[i] + 10 / 6 * curve[near].mean(axis=0)))
    got = {r["feature_id"]: r for r in N.ql_test(m, s, ["condition"], "condition=b").collect()}
    assert abs(math.log(got["f00000"]["common"] / peak(curve[kept].sum(axis=0)))) < 1e-6
    assert max(abs(math.log(got[f"f{i:05}"]["tagwise"] / e)) for i, e in enumerate(expected)) < 1e-6


def test_quasi_prior_follows_abundance_as_in_numpy(spark):
    rng = np.random.default_rng(3)
    n = 500
    level = rng.uniform(0, 12, n)
    df = np.where(np.arange(n) % 10 == 0, 5.0, 6.0)
    s2 = np.exp(1.5 - 0.2 * level) * rng.f(6, 9, n)
    df[3] = 0
    shift, tri = S.digamma(np.maximum(df, 1) / 2) - np.log(np.maximum(df, 1) / 2), S.trigamma(np.maximum(df, 1) / 2)
    rows = [("st", f"f{i}", *map(float, v)) for i, v in enumerate(zip(level, s2, df, shift, tri, strict=True))]
    out = {r["feature_id"]: r for r in Q.trended_prior(spark.createDataFrame(rows, "study_id string, feature_id string, abundance double, s2 double, df double, shift double, tri double")).collect()}
    use = df > 0
    knots = np.quantile(level[use], [0, 1 / 3, 2 / 3, 1], method="inverted_cdf")
    z = (level - knots[0]) / (knots[3] - knots[0])
    k = (knots - knots[0]) / (knots[3] - knots[0])
    bend = lambda i: (np.maximum(z - k[i], 0) ** 3 - np.maximum(z - k[3], 0) ** 3) / (k[3] - k[i])
    b = np.column_stack([np.ones(n), z, bend(0) - bend(2), bend(1) - bend(2)])
    e = np.log(np.maximum(s2, 1e-5 * np.quantile(s2[use], 0.5, method="inverted_cdf"))) - shift
    coef = np.linalg.lstsq(b[use], e[use], rcond=None)[0]
    v = ((e - b @ coef)[use] ** 2).sum() / (use.sum() - 4) - tri[use].mean()
    d0 = 2 * S.trigamma_inverse(v)
    s02 = np.exp(b @ coef + float(S.digamma(np.array(d0 / 2))) - math.log(d0 / 2))
    assert abs(out["f0"]["d0"] / d0 - 1) < 1e-6 and 5 < d0 < 16
    assert max(abs(out[f"f{i}"]["s02"] / s02[i] - 1) for i in range(n)) < 1e-6
    assert out["f0"]["pooled"] == df.sum()


@pytest.mark.parametrize("dispersion", ["common", "trended"])
def test_quasi_likelihood_finds_planted_effects_and_keeps_its_level(spark, dispersion):
    fold = np.ones(1500)
    fold[:100] = np.where(np.arange(100) % 2, 4.0, 0.25)
    y = draw(5, 1500, 10, fold)
    m, s = table(spark, y)
    out = R.adjusted(N.ql_test(m, s, ["condition"], "condition=b", dispersion)).toPandas().set_index("feature_id").sort_index()
    null = out.iloc[100:]
    assert 0.02 <= (null["pvalue"] < 0.05).mean() <= 0.08
    strong = y[:100].mean(axis=1) > 20
    assert (out["q"].iloc[:100][strong] < 0.05).mean() >= 0.8
    assert (np.sign(out["log2fc"].iloc[:100][strong]) == np.where(fold[:100][strong] > 1, 1, -1)).all()
    # dispersions fall with abundance, and so do the tagwise ones
    low, high = y.mean(axis=1) < 10, y.mean(axis=1) > 1000
    assert out["tagwise"][low].median() > 3 * out["tagwise"][high].median()


def test_groups_of_zeros_and_features_without_spare_counts(spark):
    y = draw(6, 200, 6)
    y[0] = [0, 0, 0, 50, 60, 70]
    y[1] = [0, 0, 0, 0, 0, 9]
    m, s = table(spark, y)
    out = {r["feature_id"]: r for r in N.ql_test(m, s, ["condition"], "condition=b").collect()}
    assert len(out) == 200 and all(r["pvalue"] is not None and 0 <= r["pvalue"] <= 1 for r in out.values())
    assert out["f00000"]["log2fc"] > 5 and out["f00000"]["pvalue"] < 0.01
    with pytest.raises(ValueError):
        N.ql_test(m, s, ["condition"], "condition=b", "none")
    assert N.ql_test(m.where("value < 0"), s, ["condition"], "condition=b").collect() == []


def test_features_that_lack_samples_count_as_zero_there(spark):
    y = draw(8, 40, 6)
    m, s = table(spark, y)
    gone = m.where("value > 4")
    zero = m.selectExpr("study_id", "feature_id", "sample_id", "case when value > 4 then value else 0 end as value")
    of = lambda t: {r["feature_id"]: r["stat"] for r in N.nb_wald(t, s, ["condition"], "condition=b").collect()}
    sizes = S.size_factors(zero)
    lists = B.designs(s, ["condition"], sizes, "size_factor")
    one, two = ({r["feature_id"]: list(r["y"]) for r in B.packed(t, lists).collect()} for t in (gone, zero))
    assert one == two and any(0.0 in v for v in one.values())
    assert of(zero).keys() >= {"f00000"}


def test_dispersion_trend_equals_a_numpy_gamma_regression(spark):
    rng = np.random.default_rng(4)
    rows, want = [], {}
    for study, a0, a1 in (("x", 0.05, 3.0), ("y", 0.4, 0.7), ("flat", 0.2, 0.0)):
        m = np.exp(rng.uniform(1, 8, 600))
        a = (a0 + a1 / m) * rng.gamma(4, 1 / 4, 600)
        a[:5], a[5:8] = a[:5] * 400, 1e-8
        if study == "flat":
            a = a * np.log(m)  # rises with the mean: no trend of this form
        rows += [(study, float(u), float(v), 6.0) for u, v in zip(m, a, strict=True)]
        use = a > 1e-6
        c = np.array([0.1, 1.0])
        for _ in range(200):
            fit = c[0] + c[1] / m
            good = use & (a / fit > 1e-4) & (a / fit < 15)
            x, w = np.column_stack([np.ones(600), 1 / m])[good], 1 / fit[good] ** 2
            c = np.linalg.solve((x.T * w) @ x, (x.T * w) @ a[good])
            if (c <= 0).any():
                c = np.array([a[use].mean(), 0.0])
                break
        r = np.log(a[use]) - np.log(c[0] + c[1] / m[use])
        want[study] = (*c, 1.4826 * np.median(np.abs(r - np.median(r))))
    g = spark.createDataFrame(rows, "study_id string, base_mean double, dispersion double, df double")
    got = {r["study_id"]: r for r in N.trends(g).collect()}
    for study, (a0, a1, sd) in want.items():
        assert abs(got[study]["a0"] / a0 - 1) < 1e-6 and abs(got[study]["a1"] - a1) < 1e-6 * max(a1, 1) and abs(got[study]["sd"] - sd) < 1e-9
    assert got["flat"]["a1"] == 0 and abs(math.log(got["x"]["a1"] / 3.0)) < 0.3
    assert got["x"]["spread"] == max(0.25, got["x"]["sd"] ** 2 - float(S.trigamma(np.array(3.0))))


def test_a_feature_far_above_the_trend_keeps_its_dispersion(spark):
    y = draw(9, 400, 12, asymptote=0.02, extra=1.0)
    rng = np.random.default_rng(2)
    y[0] = rng.poisson(rng.gamma(1 / 3.0, 3.0 * 300.0, 12))
    m, s = table(spark, y)
    out = {r["feature_id"]: r["dispersion"] for r in N.nb_wald(m, s, ["condition"], "condition=b").collect()}
    x = np.column_stack([np.ones(12), np.arange(12) >= 6]).astype(float)
    size = {r["sample_id"]: r["size_factor"] for r in S.size_factors(m).collect()}
    own = N.gene_dispersion(y[:1].astype(float), x, np.array([size[f"s{j:03}"] for j in range(12)]))[0]
    assert abs(math.log(out["f00000"] / own)) < 1e-6 and own > 0.8
    assert np.median(list(out.values())) < 0.1


def plain_lowess(x, y, span, rounds):
    n, k = len(x), max(2, int(span * len(x) + 1e-9))
    robust, fit = np.ones(n), y
    for r in range(rounds + 1):
        out = []
        for i in range(n):
            d = np.abs(x - x[i])
            h = np.sort(d)[k - 1]
            w = np.where(d < 0.999 * h, np.where(d > 0.001 * h, (1 - (d / h) ** 3) ** 3, 1), 0) * robust
            b = np.polyfit(x, y, 1, w=np.sqrt(w))
            out.append(np.polyval(b, x[i]))
        fit = np.array(out)
        rest = np.abs(y - fit)
        u = rest / (6 * np.median(rest))
        robust = np.where(u < 0.001, 1, np.where(u < 0.999, (1 - u * u) ** 2, 0))
    return fit


def test_local_regression_equals_plain_numpy():
    rng = np.random.default_rng(7)
    x = np.sort(rng.uniform(0, 10, 120))
    y = np.sin(x / 2) + 0.1 * rng.standard_normal(120)
    y[::17] += 4  # outliers
    assert np.abs(P.lowess(x, y) - plain_lowess(x, y, 0.5, 3)).max() < 1e-8
    assert np.abs(P.lowess(x, y, apart=0.1) - P.lowess(x, y)).max() < 0.02
    assert np.abs(P.lowess(x, 2 * x + 1) - (2 * x + 1)).max() < 1e-9
    assert np.allclose(P.lowess(np.ones(5), np.arange(5.0)), 2.0) and len(P.lowess(np.array([]), np.array([]))) == 0


def test_precision_weights_keep_their_level(spark):
    """Library sizes are not scaled here, so planted effects would shift the others; the level is that of tables without any."""
    m, s = table(spark, draw(11, 1200, 10, extra=1.0))
    out = N.voom_test(m, s, ["condition"], "condition=b")
    assert 0.03 <= out.selectExpr("avg(cast(pvalue < 0.05 as int))").first()[0] <= 0.07


def test_log_odds_equal_numpy(spark):
    rng = np.random.default_rng(12)
    n = 800
    effect = np.where(np.arange(n) < 40, rng.normal(0, 3, n), 0.0)
    rows, df = [], np.where(np.arange(n) % 7 == 0, 9.0, 12.0)
    u = np.where(np.arange(n) % 7 == 0, 0.4, 0.3)
    t = effect + rng.standard_t(8, n)
    for i in range(n):
        rows.append(("st", f"f{i}", float(t[i]) if i != 700 else None, float(u[i]), float(df[i]), 4.0, 0.5))
    got = {r["feature_id"]: r["b"] for r in S.log_odds(spark.createDataFrame(rows, "study_id string, feature_id string, stat double, u double, df_total double, d0 double, s02 double")).collect()}
    there = np.arange(n) != 700
    same = np.abs(t).copy()
    low = there & (df < 12)
    same[low] = S.t_critical(S.t_two_sided(same[low], df[low]), np.full(low.sum(), 12.0))
    order = np.argsort(-np.where(there, same, -1))[: math.ceil(799 * 0.005)]
    null = S.t_two_sided(same[order], np.full(len(order), 12.0))
    p = max(len(order) / 799, 0.01)
    wanted = ((np.arange(len(order)) + 0.5) / 799 - (1 - p) * null) / p
    v = np.zeros(len(order))
    for k in range(len(order)):
        if wanted[k] > null[k]:
            v[k] = u[order[k]] * ((same[order[k]] / S.t_critical(wanted[k], 12.0)) ** 2 - 1)
    v0 = np.clip(v, 0.01 / 0.5, 16 / 0.5).mean()
    r = (u + v0) / u
    b = math.log(0.01 / 0.99) - np.log(r) / 2 + (1 + df) / 2 * np.log((t**2 + df) / (t**2 / r + df))
    assert got["f700"] is None and max(abs(got[f"f{i}"] - b[i]) for i in range(n) if i != 700) < 1e-6
    assert np.median([got[f"f{i}"] for i in range(40)]) > np.median([got[f"f{i}"] for i in range(41, 699)])


def test_critical_values():
    assert np.allclose(S.t_critical(np.array([0.05, 0.05, 0.01]), np.array([10.0, math.inf, 1.0])), [2.228139, 1.959964, 63.656741], rtol=1e-6)
    assert np.allclose(S.t_two_sided(S.t_critical(np.array([0.3, 1e-12]), np.array([4.0, 50.0])), np.array([4.0, 50.0])), [0.3, 1e-12], rtol=1e-6)


def test_a_row_a_study_is_joined_by_parts(spark):
    """Features of one study came together in one task where its trend was joined, and so did their fits."""
    from pyspark.sql import functions as F

    from assayloom.functions.tables import with_study

    f = spark.range(500).select(F.lit("s").alias("study_id"), F.concat(F.lit("f"), "id").alias("feature_id"))
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", -1)
    try:
        j = with_study(f, spark.createDataFrame([("s", 2.0)], "study_id string, a double"))
        assert j.columns == ["study_id", "feature_id", "a"] and j.count() == j.distinct().count() == 500
        plan = j._jdf.queryExecution().executedPlan().toString()
        shuffles = [x for x in plan.splitlines() if "hashpartitioning(" in x]
        assert len(shuffles) == 2 and all("__part#" in x.split("hashpartitioning(")[1] for x in shuffles)
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


def test_features_meet_the_curve_of_their_class_where_they_are(spark):
    """Features were shuffled with their curves to meet all curves of their study, 28 kB a feature."""
    rng = np.random.default_rng(7)
    rows = [("s", f"f{i}", float(a), 50.0, 4.0, (-rng.random() * (Q.CURVE + a) ** 2).tolist()) for i, a in enumerate(rng.random(300))]
    p = spark.createDataFrame(rows, "study_id string, feature_id string, abundance double, total double, df double, curve array<double>")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", -1)
    try:
        out = Q.tagwise(p)
        assert out.count() == 300 and "hashpartitioning" not in out._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


def test_trimmed_means_with_ties_equal_numpy(spark):
    rng = np.random.default_rng(12)
    y = rng.poisson(3, (400, 5)).astype(int)
    rows = [("s", f"f{i}", f"n{k}", int(v)) for i, r in enumerate(y) for k, v in enumerate(r) if v or i % 3]
    got = {r["sample_id"]: r["tmm_factor"] for r in S.tmm(spark.createDataFrame(rows, "study_id string, feature_id string, sample_id string, value long")).collect()}
    there = np.zeros_like(y, dtype=bool)
    for _, f, n, _ in rows:
        there[int(f[1:]), int(n[1:])] = True
    lib = y.sum(axis=0)
    q = np.array([np.percentile(y[there[:, k], k] / lib[k], 75) for k in range(5)])
    ref = int(np.abs(q - q.mean()).argmin())
    rank = lambda v: np.array([(v < x).sum() + ((v == x).sum() + 1) / 2 for x in v])
    log_f = []
    for k in range(5):
        both = (y[:, k] > 0) & (y[:, ref] > 0)
        a, b = y[both, k], y[both, ref]
        x, z = a / lib[k], b / lib[ref]
        mv, av, var, n = np.log2(x / z), np.log2(x * z) / 2, (lib[k] - a) / lib[k] / a + (lib[ref] - b) / lib[ref] / b, len(a)
        keep = np.ones(n, bool)
        for v, trim in ((mv, 0.3), (av, 0.05)):
            keep &= (rank(v) >= math.floor(n * trim) + 1) & (rank(v) <= n - math.floor(n * trim))
        log_f.append((mv[keep] / var[keep]).sum() / (1 / var[keep]).sum() if keep.any() else 0.0)
    assert np.allclose([got[f"n{k}"] for k in range(5)], 2 ** (np.array(log_f) - np.mean(log_f)), rtol=1e-9)


def test_adjusted_values_take_one_running_minimum(spark):
    """The frame to the last row was gone through again for each row, so the time grew with the square of a study's features."""
    rng = np.random.default_rng(5)
    p = [None, float("1"), *np.round(rng.random(300) ** 3, 2).tolist()]
    d = R.adjusted(spark.createDataFrame([("s", "c", "m", f"f{i}", v) for i, v in enumerate(p)], "study_id string, contrast_id string, method string, feature_id string, pvalue double"))
    known = np.array(p[1:])
    want = {v: min(1.0, min(u * len(known) / (known <= u).sum() for u in known if u >= v)) for v in set(known)}
    got = {r["feature_id"]: r["q"] for r in d.collect()}
    assert got["f0"] is None and all(math.isclose(got[f"f{i}"], want[v], rel_tol=1e-12) for i, v in enumerate(p) if v is not None)
    assert "currentrow$(), unboundedfollowing" not in d._jdf.queryExecution().executedPlan().toString().lower()


def test_the_line_of_precision_weights_is_its_knots(spark):
    """All points of a study's line went to Python with each of its features."""
    rng = np.random.default_rng(6)
    x = np.sort(rng.random(3000))
    y = 0.3 + np.exp(-3 * x) + rng.normal(0, 0.05, 3000)
    at, line = P.lowess_knots(x, y, apart=0.01)
    assert len(at) < 110 and np.abs(np.interp(x, x[at], line) - P.lowess(x, y, apart=0.01)).max() == 0


def test_fits_of_several_columns_and_lone_rows_equal_plain_rounds():
    """Rows leave the rounds once they don't move; systems of two unknowns are solved by their formula."""
    rng = np.random.default_rng(9)
    y = rng.negative_binomial(2, 0.05, (300, 9)).astype(float)
    y[0] = 0
    y[1, :4] = 0
    for x in (np.ones((9, 1)), np.column_stack([np.ones(9), np.arange(9) > 4]).astype(float), np.column_stack([np.ones(9), np.arange(9) > 4, np.arange(9) % 2]).astype(float)):
        size, alpha = np.log(rng.uniform(0.5, 2, 9)), np.full(300, 0.4)
        beta = np.log((y + 0.5) / np.exp(size)) @ np.linalg.pinv(x).T
        for _ in range(25):
            eta = np.clip(beta @ x.T + size, -30, 30)
            mu = np.exp(eta)
            w = mu / (1 + alpha[:, None] * mu)
            step = np.linalg.solve(np.einsum("gn,np,nq->gpq", w, x, x) + B.RIDGE * np.eye(x.shape[1]), np.einsum("gn,np->gp", w * (eta - size + (y - mu) / mu), x)[:, :, None])[:, :, 0] - beta
            beta = beta + step * np.minimum(1, 2 / np.maximum(np.abs(step @ x.T).max(axis=1), 1e-12))[:, None]
        got, mu, inverse = B.fit_means(y, x, size, alpha)
        assert np.abs(got - beta).max() < 1e-6 and np.allclose(inverse, np.linalg.inv(np.einsum("gn,np,nq->gpq", mu / (1 + alpha[:, None] * mu), x, x) + B.RIDGE * np.eye(x.shape[1])), rtol=1e-5)


def test_features_are_fitted_where_they_are_packed(spark):
    """The samples of a study were joined by study, so that all its features were fitted in one task."""
    import re

    m, s = table(spark, draw(3, 30, 6))
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", -1)
    try:
        out = B.packed(m, B.designs(s, ["condition"], m.groupBy("study_id", "sample_id").agg({"value": "sum"}).withColumnRenamed("sum(value)", "lib"), "lib"))
        assert out.count() == 30
        features = out._jdf.queryExecution().optimizedPlan().toString()
        assert re.search(r"Join Inner, .*rightHint=\(strategy=broadcast\)", features)
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
