"""Composed tests against numpy, on one group each, and components with gaps."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from assayloom.operators import matrix as M
from assayloom.operators import results as R
from assayloom.operators import rollup as U
from assayloom.operators import stats as S
from assayloom.plans.queries import QUERIES
from assayloom.plans.views import Tables

DATA = "/root/testdata/sf0.01"


def moderated(y, treated):
    """log2fc, t, moderated t of each feature of ``y``: {feature: {sample: value}}."""
    fits = {}
    for f, v in y.items():
        a, b = ([x for s, x in v.items() if treated[s] == k and x is not None] for k in (False, True))
        df = len(a) + len(b) - 2
        if a and b and df > 0:
            s2 = (np.var(a) * len(a) + np.var(b) * len(b)) / df
            fits[f] = np.mean(b) - np.mean(a), s2, df, 1 / len(a) + 1 / len(b)
    use = [(s2, df) for _, s2, df, _ in fits.values() if s2 > 0]
    s2, df = np.array([u[0] for u in use]), np.array([float(u[1]) for u in use])
    e = np.log(s2) - S.digamma(df / 2) + np.log(df / 2)
    v = e.var(ddof=1) - S.trigamma(df / 2).mean()
    d0 = 2 * S.trigamma_inverse(v) if v > 0 else math.inf
    s02 = math.exp(e.mean() + (float(S.digamma(np.array(d0 / 2))) - math.log(d0 / 2) if v > 0 else 0))
    out = {}
    for f, (fc, s2, df, u) in fits.items():
        post = s02 if math.isinf(d0) else (d0 * s02 + df * s2) / (d0 + df)
        out[f] = fc, fc / math.sqrt(s2 * u) if s2 > 0 else None, fc / math.sqrt(post * u)
    return out


def values(df):
    y = {}
    for r in df.collect():
        y.setdefault(r["feature_id"], {})[r["sample_id"]] = r["v"]
    return y


def same(rows, want):
    got = {r["feature_id"]: r for r in rows}
    assert got.keys() == want.keys() and len(got) > 10
    for f, (fc, t, stat) in want.items():
        assert abs(got[f]["log2fc"] - fc) < 1e-8 and (got[f]["t"] is None) == (t is None) and (t is None or abs(got[f]["t"] - t) < 1e-6)
        assert abs(got[f]["stat"] - stat) < 1e-6 * max(1, abs(stat)) and 0 <= got[f]["pvalue"] <= got[f]["q"] <= 1


def test_subsets(spark):
    t = Tables(spark, DATA)
    out = QUERIES["st_22_subset_stability"](spark, DATA)
    key = out.agg(F.min("study_id")).first()[0]
    study, run = key.split(":")
    sub = {r["sample_id"]: r["condition"] == "treated" for r in R.stratified_subsets(t.sample).where(f"study_id = '{study}' and run = {run}").collect()}
    y = values(M.log_cpm(t.measure).where(f"study_id = '{study}'").select("feature_id", "sample_id", F.col("log_cpm").alias("v")).where(F.col("sample_id").isin(list(sub))))
    same(out.where(f"study_id = '{key}'").collect(), moderated(y, sub))


def test_cell_types(spark):
    t = Tables(spark, DATA)
    pb = U.pseudobulk(t.cell_count, t.cell_meta)
    kind = pb.agg(F.min("celltype")).first()[0]
    pb = pb.where(F.col("celltype") == kind)
    arm = {r["pb_id"]: r["condition"] == "O" for r in pb.select("pb_id", "condition").distinct().collect()}
    lib = {r["pb_id"]: r["n"] for r in pb.groupBy("pb_id").agg(F.sum("value").alias("n")).collect()}
    y = {}
    for r in pb.collect():
        y.setdefault(r["gene"], {})[r["pb_id"]] = math.log2(r["value"] * 1e6 / lib[r["pb_id"]] + 1)
    same(QUERIES["st_20_celltype_test"](spark, DATA).where(F.col("study_id") == kind).collect(), moderated(y, arm))


def test_proteins(spark):
    t = Tables(spark, DATA)
    p = U.peptide_to_protein(t.peptide, min_peptides=2).select(F.lit("PR").alias("study_id"), F.col("protein").alias("feature_id"), "sample_id", F.col("value").cast("double").alias("value"))
    p = M.centre(M.log_if_linear(M.drop_missing(p)))
    y = values(p.select("feature_id", "sample_id", F.col("value").alias("v")))
    samples = {s for v in y.values() for s in v}
    same(QUERIES["st_19_proteomics_test"](spark, DATA).collect(), moderated(y, {s: int(s[1:]) % 2 == 1 for s in samples}))


def test_shrunken_effects_equal_a_search_for_the_mode(spark):
    from assayloom.operators.counts import shrink

    rng = np.random.default_rng(1)
    rows = [("s", "c", f"f{i}", float(rng.normal(0, 2)), float(rng.uniform(0.1, 1.5))) for i in range(60)]
    got = {r["feature_id"]: r["log2fc_shrunk"] for r in shrink(spark.createDataFrame(rows, "study_id string, contrast_id string, feature_id string, log2fc double, lfc_se double")).collect()}
    b, se = np.array([r[3] for r in rows]), np.array([r[4] for r in rows])
    scale = max(1e-3, math.sqrt(max(0.0, np.quantile(b**2 - se**2, 0.75))))
    grid = np.linspace(-8, 8, 400_001)
    for r in rows:
        top = grid[np.argmin((r[3] - grid) ** 2 / (2 * r[4] ** 2) + np.log(scale**2 + grid**2))]
        assert abs(got[r[2]] - top) < 1e-3


@pytest.mark.parametrize("gap", ["none", "missing", "null", "nan"])
def test_components_of_features_without_gaps(spark, gap):
    rng = np.random.default_rng(2)
    x = rng.normal(size=(40, 6))
    rows = [("s", f"f{i:02}", f"n{j}", float(v)) for i, r in enumerate(x) for j, v in enumerate(r)]
    if gap == "missing":
        rows.remove(("s", "f03", "n2", float(x[3, 2])))
    elif gap != "none":
        rows = [(*r[:3], None if gap == "null" else float("nan")) if r[1:3] == ("f03", "n2") else r for r in rows]
    if gap != "none":
        x = np.delete(x, 3, axis=0)
    out = S.pca(spark.createDataFrame(rows, "study_id string, feature_id string, sample_id string, value double"), 3).collect()
    c = x - x.mean(axis=1, keepdims=True)
    u, d, v = np.linalg.svd(c.T, full_matrices=False)
    for k in range(3):
        score = u[:, k] * d[k]
        score = score if score[np.argmax(np.abs(score))] >= 0 else -score
        got = {r["sample_id"]: r["score"] for r in out if r["component"] == k + 1}
        assert np.allclose([got[f"n{j}"] for j in range(6)], score, atol=1e-9)


def test_components_without_whole_features(spark):
    kind = "study_id string, feature_id string, sample_id string, value double"
    assert S.pca(spark.createDataFrame([("s", "f", "a", 1.0), ("s", "g", "b", 1.0), ("s", "h", "a", None)], kind)).collect() == []
    assert S.pca(spark.createDataFrame([], kind)).collect() == []


def test_permutation_nulls(spark):
    """Sets drawn at random have evenly spread p-values; a set of the top genes stands out; the null of a size is what plain draws give."""
    from assayloom.operators import genesets as G

    rng = np.random.default_rng(5)
    n = 400
    score = np.sort(rng.normal(size=n))[::-1]
    ranked = spark.createDataFrame([("s", "c", "m", f"g{i}", float(x), i + 1, n) for i, x in enumerate(score)], "study_id string, contrast_id string, method string, gene string, score double, rank long, n long")
    drawn = {f"r{k}": rng.choice(n, 15 + k % 6, replace=False) for k in range(120)} | {"top": np.arange(20)}
    sets = spark.createDataFrame([("lib", k, f"g{i}") for k, v in drawn.items() for i in v], "collection string, set_id string, gene string")
    out = {r["set_id"]: r for r in G.gsea(ranked, sets, permutations=400).collect()}
    assert len(out) == 121 and out["top"]["nom_p"] < 0.01 and out["top"]["fdr_q"] < 0.05 and out["top"]["nes"] > 2
    p = np.array([r["nom_p"] for k, r in out.items() if k != "top"])
    assert 0.4 < p.mean() < 0.6 and 0.0 <= (p < 0.05).mean() < 0.13

    def es(at):
        at = np.sort(at)
        w = np.abs(score[at])
        miss = (at - np.arange(len(at))) / (n - len(at))
        top, low = (np.cumsum(w) / w.sum() - miss).max(), ((np.cumsum(w) - w) / w.sum() - miss).min()
        return top if top >= -low else low

    null = np.array([es(rng.choice(n, 17, replace=False)) for _ in range(4000)])
    some = [r for k, r in out.items() if k != "top" and r["size"] == 17]
    for r in some:
        same = null[(null >= 0) == (r["es"] >= 0)]
        assert abs(r["nes"] / (r["es"] / abs(same.mean())) - 1) < 0.08
    assert some and [tuple(r) for r in G.gsea(ranked.repartition(5), sets, permutations=400).where("set_id = 'r3'").collect()] == [tuple(out["r3"])]


def test_rank_of_two_large_factors_numbers_and_nested_terms(spark):
    """Against numpy's rank of the whole design: nested, crossed and split factors, a number and a null level."""
    from assayloom.operators.designs import design_rank

    rng = np.random.default_rng(5)
    rows = [("a", f"s{i}", f"P{i // 2}", "ct"[i % 2], float(i % 5), f"b{i // 4}") for i in range(40)]
    rows += [("b", f"s{i}", f"P{i // 4}", "ct"[i % 2] if i < 20 else None, float(rng.normal()), f"b{i // 20}") for i in range(41)]
    s = spark.createDataFrame(rows, "study_id string, sample_id string, subject string, condition string, age double, batch string")
    frame = s.toPandas()
    for terms in (["condition", "subject"], ["subject", "batch", "condition"], ["age", "subject", "condition"], ["age"], ["batch"]):
        got = {r["study_id"]: r for r in design_rank(s, terms).collect()}
        for study, t in frame.groupby("study_id"):
            names, x = S.design(t, terms)
            rank = int(np.linalg.matrix_rank(x))
            r = got[study]
            assert (r["n_samples"], r["n_columns"], r["rank"], r["residual_df"]) == (len(t), len(names), rank, len(t) - rank), (study, terms)


def test_design_rank_takes_many_levels(spark):
    """4,000 subjects in pairs: a dense design would be 8,000 by 4,001 numbers in one task (256 MB)."""
    from assayloom.operators.designs import design_rank

    s = spark.range(8000).selectExpr("'a' as study_id", "concat('s', id) as sample_id", "concat('P', cast(floor(id / 2) as int)) as subject", "if(id % 2 = 0, 'c', 't') as condition")
    r = design_rank(s, ["condition", "subject"]).first()
    assert (r["n_columns"], r["rank"], r["residual_df"]) == (4001, 4001, 3999)


def test_pairs_of_samples_are_not_shuffled(spark):
    """Pairs leave the task that makes them; with gaps and more than one tile they equal plain sums."""
    rng = np.random.default_rng(3)
    y = rng.normal(size=(23, 11))
    y[rng.random(y.shape) < 0.2] = np.nan
    rows = [("s", f"f{i:02d}", f"q{j:02d}", None if np.isnan(y[i, j]) else float(y[i, j])) for i in range(23) for j in range(11)]
    df = S.sample_corr(spark.createDataFrame(rows, "study_id string, feature_id string, sample_id string, value double"), tile=4, block=8)
    plan = df._jdf.queryExecution().optimizedPlan().toString()
    assert plan.startswith("MapInArrow")
    got = {(r["sample_a"], r["sample_b"]): r["r"] for r in df.collect()}
    c = y - np.nanmean(y, axis=0)
    want = {}
    for i in range(11):
        for j in range(i + 1, 11):
            there = ~np.isnan(c[:, i]) & ~np.isnan(c[:, j])
            want[f"q{i:02d}", f"q{j:02d}"] = float((c[there, i] * c[there, j]).sum() / np.sqrt((c[there, i] ** 2).sum() * (c[there, j] ** 2).sum()))
    assert got.keys() == want.keys() and all(abs(got[k] - want[k]) < 1e-12 for k in want)


def test_a_factor_taken_out_gives_the_fit_of_the_whole_design(spark):
    """Subjects taken out, with gaps, NaN, a study without one arm and two more terms, against least squares on the whole design."""
    rng = np.random.default_rng(8)
    samples = [(st, f"s{i:02d}", f"P{i // 3}", "cte"[i % 3] if st == "a" else "c", "xy"[(i * 7 // 4) % 2]) for st in "ab" for i in range(30)]
    s = spark.createDataFrame(samples, "study_id string, sample_id string, subject string, condition string, batch string")
    y = {(r[0], f"f{k}", r[1]): (float("nan") if rng.random() < 0.1 else float(rng.normal())) for r in samples for k in range(4)}
    m = spark.createDataFrame([(*k, None if np.isnan(v) and i % 2 else v) for i, (k, v) in enumerate(y.items())], "study_id string, feature_id string, sample_id string, value double")
    asked = {"t": {"condition=t": 1.0}, "et": {"condition=t": -1.0, "condition=e": 1.0}, "b": {"batch=y": 1.0}}
    for contrasts in (asked, {"t": asked["t"]}):
        for large in (2, 10**9):
            got = {(r["study_id"], r["feature_id"], r["contrast_id"]): r for r in S.linear_model(m, s, ["subject", "condition", "batch"], contrasts, large=large).collect()}
            want = {}
            for st in "ab":
                for k in range(4):
                    rows = [r for r in samples if r[0] == st and not np.isnan(y[st, f"f{k}", r[1]])]
                    import pandas as pd

                    names, x = S.design(pd.DataFrame(rows, columns=["study_id", "sample_id", "subject", "condition", "batch"]), ["subject", "condition", "batch"])
                    v = np.array([y[st, f"f{k}", r[1]] for r in rows])
                    inv, df = np.linalg.pinv(x), len(v) - np.linalg.matrix_rank(x)
                    beta = inv @ v
                    s2 = ((v - x @ beta) ** 2).sum() / df
                    for name, parts in contrasts.items():
                        c = np.array([parts.get(n, 0.0) for n in names])
                        if all(p in names for p in parts) and np.allclose(c @ inv @ x, c, atol=1e-8):
                            want[st, f"f{k}", name] = (v.mean(), c @ beta, s2, df, (c @ inv) @ (c @ inv))
            assert got.keys() == want.keys()
            for k, w in want.items():
                assert np.allclose([got[k][c] for c in ("base_mean", "log2fc", "s2", "df", "u")], w, rtol=1e-8, atol=1e-10), (k, large)


def test_components_by_the_shorter_side_equal_numpy(spark):
    """A wide and a long study at once: many samples of few features were a square of the samples for each of 64 blocks."""
    rng = np.random.default_rng(6)
    data = {"wide": rng.normal(size=(40, 7)), "long": rng.normal(size=(5, 90)), "one": rng.normal(size=(1, 6))}
    rows = [(k, f"f{i:02d}", f"s{j:02d}", float(x[i, j])) for k, x in data.items() for i in range(x.shape[0]) for j in range(x.shape[1])]
    df = S.pca(spark.createDataFrame(rows, "study_id string, feature_id string, sample_id string, value double"), 2)
    got = {(r["study_id"], r["component"], r["sample_id"]): r for r in df.collect()}
    assert len(got) == 2 * (7 + 90 + 6)
    for k, x in data.items():
        c = x - x.mean(axis=1, keepdims=True)
        _, d, v = np.linalg.svd(c, full_matrices=False)
        for i in range(min(2, len(d))):
            w = v[i] * d[i]
            w = w if w[np.argmax(np.abs(w))] > 0 else -w
            assert np.allclose([got[k, i + 1, f"s{j:02d}"]["score"] for j in range(x.shape[1])], w, atol=1e-8)
            assert abs(got[k, i + 1, "s00"]["ratio"] - d[i] ** 2 / (d**2).sum()) < 1e-9


def test_two_group_fits_are_made_once(spark):
    """Priors, their sums and the fits themselves read kept fits, not the matrix again; arms may stand in the matrix."""
    m = spark.range(400).select(F.lit("s").alias("study_id"), F.concat(F.lit("F"), F.col("id") % 40).alias("feature_id"), F.concat(F.lit("S"), (F.col("id") / 40).cast("int")).alias("sample_id"), (F.hash("id") % 100 / 10.0).alias("value"))
    s = m.select("study_id", "sample_id").distinct().withColumn("condition", F.when(F.substring("sample_id", 2, 9).cast("int") < 5, "a").otherwise("b"))
    out = S.moderated_two_group(m, s, "a", "b")
    assert "Range (" not in out._jdf.queryExecution().optimizedPlan().toString()
    held = S.moderated_two_group(m.join(s, ["study_id", "sample_id"]), None, "a", "b")
    near = lambda x: {r["feature_id"]: [round(v, 9) for v in (r["base_mean"], r["log2fc"], r["stat"], r["pvalue"])] for r in x.collect()}
    assert near(out) == near(held) and out.count() == 40


def test_wide_tiles_are_held_and_equal_small_ones(spark):
    """Values went to as many tasks as a study has tiles of a fixed width, and all pairs left their tasks where only the lowest was asked for."""
    rng = np.random.default_rng(8)
    y = np.round(rng.normal(size=(30, 90)), 1)
    rows = [(st, f"f{i:02d}", f"q{j:02d}", float(y[i, j])) for st in "st" for i in range(30) for j in range(90) if st == "s" or rng.random() < 0.9]
    rows += [("s", f"f{i:02d}", "zero", 1.0) for i in range(30)]
    m = spark.createDataFrame(rows, "study_id string, feature_id string, sample_id string, value double")
    of = lambda df: {(r["study_id"], r["sample_a"], r["sample_b"]): r["r"] for r in df.collect()}
    plain, wide = of(S.sample_corr(m, held=1)), of(S.sample_corr(m, tile=5, block=7, held=1 << 20))
    assert plain.keys() == wide.keys() and len(plain) == 91 * 90 // 2 + 90 * 89 // 2
    assert all((plain[k] is None) == (wide[k] is None) and (plain[k] is None or abs(plain[k] - wide[k]) < 1e-9) for k in plain)
    few = S.sample_corr(m, tile=5, block=7, held=1 << 20, lowest=True)
    assert few.count() < len(plain) / 5
    got = {r["study_id"]: (r["sample_a"], r["sample_b"]) for r in S.lowest_pair(few).collect()}
    assert got == {st: min((r, a, b) for (s, a, b), r in plain.items() if s == st and r is not None)[1:] for st in "st"}
