"""Hand-made cases, and statistics against numpy."""

import math

import numpy as np
import pytest

from assayloom.operators import genesets as G
from assayloom.operators import joins as J
from assayloom.operators import matrix as M
from assayloom.operators import results as R
from assayloom.operators import rollup as U
from assayloom.operators import stats as S
from assayloom.sources import files as X


def test_t_tails_against_known_values():
    got = S.t_two_sided(np.array([2.0, 0.0, 12.706205, 1.959964, 2.0]), np.array([10.0, 5.0, 1.0, math.inf, 1e12]))
    assert np.allclose(got, [0.0733880, 1.0, 0.05, 0.05, 0.0455003], atol=1e-6)


def test_digamma_family():
    assert abs(float(S.digamma(np.array(1.0))) + 0.5772156649) < 1e-9
    assert abs(float(S.trigamma(np.array(1.0))) - math.pi**2 / 6) < 1e-9
    for x in (0.2, 1.0, 7.5, 300.0):
        assert abs(S.trigamma_inverse(float(S.trigamma(np.array(x)))) / x - 1) < 1e-6


def planted(spark, seed=3, features=300, per_arm=6):
    rng = np.random.default_rng(seed)
    rows, samples = [], [(f"s{j}", "case" if j >= per_arm else "control") for j in range(2 * per_arm)]
    for i in range(features):
        sd = math.sqrt(0.2 * 8 / rng.chisquare(8))
        shift = 2.0 * (1 if i % 2 else -1) if i < 30 else 0.0
        rows += [("st", f"f{i}", s, float(8 + sd * rng.standard_normal() + shift * (c == "case"))) for s, c in samples]
    m = spark.createDataFrame(rows, "study_id string, feature_id string, sample_id string, value double")
    return m, spark.createDataFrame([("st", s, c) for s, c in samples], "study_id string, sample_id string, condition string")


def test_planted_effects_are_recovered(spark):
    m, s = planted(spark)
    out = R.adjusted(S.moderated_two_group(m, s, "control", "case")).toPandas().set_index("feature_id")
    hit = out["q"] < 0.05
    true = [f"f{i}" for i in range(30)]
    assert hit[true].mean() >= 0.9 and hit.drop(true).mean() <= 0.03
    assert all((out.loc[f, "log2fc"] > 0) == (int(f[1:]) % 2 == 1) for f in true)
    assert out["df_total"].iloc[0] > 10


def test_linear_model_equals_numpy_with_missing_values(spark):
    m, s = planted(spark, features=20)
    m = m.where("not (feature_id = 'f3' and sample_id = 's1')")
    out = {r["feature_id"]: r for r in S.linear_model(m, s, ["condition"], {"c": {"condition=control": 1.0}, "none": {"condition=zz": 1.0}}).collect()}
    values = {(r["feature_id"], r["sample_id"]): r["value"] for r in m.collect()}
    arm = {r["sample_id"]: r["condition"] for r in s.collect()}
    for f in ("f0", "f3"):
        a, b = ([values[f, x] for x in arm if arm[x] == c and (f, x) in values] for c in ("control", "case"))
        s2 = (np.var(a) * len(a) + np.var(b) * len(b)) / (len(a) + len(b) - 2)
        t = (np.mean(a) - np.mean(b)) / math.sqrt(s2 * (1 / len(a) + 1 / len(b)))
        assert abs(out[f]["log2fc"] - (np.mean(a) - np.mean(b))) < 1e-9 and abs(out[f]["t"] - t) < 1e-9
        assert out[f]["df"] == len(a) + len(b) - 2


def test_pca_equals_numpy(spark):
    m, _ = planted(spark, features=40)
    out = S.pca(m, 2).toPandas()
    x = m.toPandas().pivot(index="sample_id", columns="feature_id", values="value")
    x = x - x.mean()
    values = np.linalg.svd(x.to_numpy(), compute_uv=False) ** 2
    first = out[out["component"] == 1].set_index("sample_id")
    assert abs(first["ratio"].iloc[0] - values[0] / values.sum()) < 1e-9
    u, d, _ = np.linalg.svd(x.to_numpy(), full_matrices=False)
    assert np.allclose(np.abs(first.loc[x.index, "score"]), np.abs(u[:, 0] * d[0]))


def test_enrichment_score_equals_running_sum(spark):
    rng = np.random.default_rng(1)
    genes = [f"g{i}" for i in range(200)]
    score = np.sort(rng.standard_normal(200))[::-1]
    ranked = spark.createDataFrame([("s", "c", "m", g, float(v), i + 1, 200) for i, (g, v) in enumerate(zip(genes, score, strict=True))], "study_id string, contrast_id string, method string, gene string, score double, rank int, n int")
    sets = {f"set{k}": rng.choice(200, 20, replace=False) for k in range(10)}
    frame = spark.createDataFrame([("x", k, genes[i]) for k, v in sets.items() for i in v], "collection string, set_id string, gene string")
    got = {r["set_id"]: r["es"] for r in G.enrichment_score(ranked, frame).collect()}
    for k, v in sets.items():
        inside = np.zeros(200, bool)
        inside[v] = True
        w = np.where(inside, np.abs(score), 0)
        run = np.cumsum(w / w.sum() - (~inside) / 180)
        es = run.max() if run.max() >= -run.min() else run.min()
        assert abs(got[k] - es) < 1e-9
    full = G.gsea(ranked, frame, 100).toPandas()
    assert full["nom_p"].between(0, 1).all() and full["fdr_q"].between(0, 1).all() and (np.sign(full["nes"]) == np.sign(full["es"])).all()


def test_verdicts_in_order(spark):
    d = spark.createDataFrame([("s", "c", "m", g, fc, p) for g, fc, p in (("A", 2.0, 0.01), ("B", -1.0, 0.3), ("C", 1.0, 0.02), ("D", 0.5, 0.6))], "study_id string, contrast_id string, method string, feature_id string, log2fc double, padj double")
    cases = [("A", "gene", "up", "confirmed"), ("A", "gene", "down", "contradicted"), ("B", "gene", "down", "direction_only"), ("D", "protein", "down", "not_detected"), ("C", "gene", "unchanged", "contradicted"), ("D", "gene", "unchanged", "confirmed"), ("Z", "gene", "up", "not_in_results"), ("x", "pathway", "up", "not_checkable"), ("two words", "gene", "up", "not_checkable"), ("A", "gene", "changed", "confirmed_change"), ("mA", "gene", "up", "confirmed")]
    f = spark.createDataFrame([("s", i, e, k, w, "c", "q") for i, (e, k, w, _) in enumerate(cases)], "study_id string, finding_id long, entity string, entity_type string, direction string, comparison string, source string")
    got = {r["finding_id"]: r["verdict"] for r in J.agreement(f, d).collect()}
    assert got == {i: c[3] for i, c in enumerate(cases)}


def test_peptides(spark):
    rows = [("a", "P1", "S1", 10.0), ("b", "P1", "S1", 20.0), ("c", "P2;P3", "S1", 100.0), ("d", "P2", "S1", 12.0), ("e", "DECOY_P4", "S1", 9.0)]
    p = spark.createDataFrame(rows, "peptide string, protein_ids string, sample_id string, value double")
    assert {r["protein"]: r["value"] for r in U.peptide_to_protein(p).collect()} == {"P1": 30, "P2": 12}
    assert {r["protein"]: r["value"] for r in U.peptide_to_protein(p, shared="explode").collect()} == {"P1": 30, "P2": 112, "P3": 100}
    with pytest.raises(ValueError):
        U.peptide_to_protein(p, scale="log2")


def test_same_result_with_other_partitions(spark):
    m, s = planted(spark, features=50)
    a = sorted(map(tuple, M.minprob(m.replace(8.0, None)).collect()))
    spark.conf.set("spark.sql.shuffle.partitions", "7")
    try:
        assert sorted(map(tuple, M.minprob(m.replace(8.0, None).repartition(5)).collect())) == a
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", "4")


def test_file_scans(spark, tmp_path):
    (tmp_path / "one.csv").write_text('gene,note,S1,S2\nA,x,1,2.5\nB,y,,4\n')
    (tmp_path / "two.tsv").write_text("id\tT1\tT2\nA\t7\t8\n")
    got = {(r["study_id"], r["feature_id"], r["sample_id"]): r["value"] for r in X.read_matrix(spark, [str(tmp_path / "one.csv"), str(tmp_path / "two.tsv")]).collect()}
    assert got == {("one.csv", "A", "S1"): 1, ("one.csv", "A", "S2"): 2.5, ("one.csv", "B", "S1"): None, ("one.csv", "B", "S2"): 4, ("two.tsv", "A", "T1"): 7, ("two.tsv", "A", "T2"): 8}
    (tmp_path / "p.mztab").write_text("MTD\tx\nPRH\taccession\topt_decoy\tprotein_abundance_assay[1]\tprotein_abundance_assay[2]\nPRT\tP1\t0\t5\tnull\nPRT\tP2\t1\t6\t7\nPRT\tDECOY_P3\t0\t1\t1\nPRT\tP4\t0\t2\n")
    assert {(r["feature_id"], r["sample_id"]): r["value"] for r in X.read_tagged_table(spark, str(tmp_path / "p.mztab")).collect()} == {("P1", "1"): 5, ("P1", "2"): None, ("P4", "1"): 2, ("P4", "2"): None}
    (tmp_path / "c").mkdir()
    (tmp_path / "c/a.txt").write_text("# head\nG1 5\nG1 9\nG2 1\n__no_feature 3\n")
    (tmp_path / "c/b.txt").write_text("G2 4\nG3 2\n")
    counts = X.merge_sample_files(X.lines_of(spark, str(tmp_path / "c")))
    assert {(r["sample_id"], r["feature_id"]): r["value"] for r in counts.collect()} == {("a.txt", "G1"): 5, ("a.txt", "G2"): 1, ("a.txt", "G3"): 0, ("b.txt", "G1"): 0, ("b.txt", "G2"): 4, ("b.txt", "G3"): 2}
    assert [tuple(r) for r in X.shared_ids(X.lines_of(spark, str(tmp_path / "c"))).collect()] == [("", 2, 3, 1, 0.333333, "samples share few ids")]
    both = X.lines_of(spark, str(tmp_path / "c")).selectExpr("file", "n", "line", "substring(file, 1, 1) as study_id")
    assert {(r["study_id"], r["sample_id"], r["feature_id"], r["value"]) for r in X.merge_sample_files(both).collect()} == {("a", "a.txt", "G1", 5), ("a", "a.txt", "G2", 1), ("b", "b.txt", "G2", 4), ("b", "b.txt", "G3", 2)}
    assert [r["warning"] for r in X.shared_ids(both).collect()] == [None, None]
    (tmp_path / "ids.mztab").write_text("PRH\taccession\tscore\nPRT\tP1\t3\n")
    (tmp_path / "none.mztab").write_text("MTD\tx\n")
    tagged = [str(tmp_path / f"{x}.mztab") for x in ("p", "ids", "none")]
    assert sorted(map(tuple, X.tagged_table_problems(spark, tagged).collect())) == [("ids.mztab", "identifications only"), ("none.mztab", "no protein rows")]
    assert {r["study_id"] for r in X.read_tagged_table(spark, tagged).collect()} == {"p.mztab"}
    (tmp_path / "t").mkdir()
    (tmp_path / "t/matrix.mtx").write_text("%%MatrixMarket\n2 2 2\n1 1 3\n2 2 4\n")
    (tmp_path / "t/features.tsv").write_text("G1\tx\nG2\ty\n")
    (tmp_path / "t/barcodes.tsv").write_text("c1\nc2\n")
    assert sorted(map(tuple, X.read_triples(spark, str(tmp_path / "t")).collect())) == [("c1", "G1", 3.0), ("c2", "G2", 4.0)]
    (tmp_path / "s.txt").write_text('!Series_title\tx\n!Sample_title\t"a"\t"b"\n!Sample_characteristics_ch1\t"sex: male"\t"sex: female"\n!series_matrix_table_begin\n!Sample_late\t1\t2\n')
    assert {(r["sample_no"], r["attr"]): r["value"] for r in X.read_series_header(spark, str(tmp_path / "s.txt")).collect()} == {(0, "title"): "a", (1, "title"): "b", (0, "sex"): "male", (1, "sex"): "female"}
    index = X.artifact_index(spark, str(tmp_path / "c")).collect()
    assert len(index) == 2 and all(len(r["sha256"]) == 64 for r in index)


def counts(spark, seed=5, features=250, per_arm=6):
    rng = np.random.default_rng(seed)
    samples = [(f"s{j}", "case" if j >= per_arm else "control") for j in range(2 * per_arm)]
    size, rows = rng.uniform(0.6, 1.6, 2 * per_arm), []
    for i in range(features):
        mean, alpha = rng.uniform(30, 500), 0.08
        shift = 4.0 ** (1 if i % 2 else -1) if i < 25 else 1.0
        for (s, c), f in zip(samples, size, strict=True):
            mu = mean * f * (shift if c == "case" else 1.0)
            rows.append(("st", f"f{i}", s, int(rng.poisson(rng.gamma(1 / alpha, alpha * mu)))))
    return spark.createDataFrame(rows, "study_id string, feature_id string, sample_id string, value long"), spark.createDataFrame([("st", s, c) for s, c in samples], "study_id string, sample_id string, condition string")


@pytest.mark.parametrize("test", ["nb_wald", "ql_test", "voom_test"])
def test_count_models_recover_planted_effects(spark, test):
    from assayloom.operators import counts as N

    m, s = counts(spark)
    # the treated arm is coded against the first level by name
    out = R.adjusted(getattr(N, test)(m, s, ["condition"], "condition=control")).toPandas().set_index("feature_id")
    hit, true = out["q"] < 0.05, [f"f{i}" for i in range(25)]
    assert hit[true].mean() >= 0.9 and hit.drop(true).mean() <= 0.05
    assert all((out.loc[f, "log2fc"] < 0) == (int(f[1:]) % 2 == 1) for f in true)
    if test == "nb_wald":
        assert 0.04 < out["dispersion"].median() < 0.16
        assert (out["log2fc_shrunk"].abs() <= out["log2fc"].abs() + 1e-12).all()


def test_an_outlying_count_is_replaced_or_leaves_no_p_value(spark):
    from assayloom.operators import counts as N

    rng = np.random.default_rng(11)
    for per_arm in (8, 4):
        arms = ["a"] * per_arm + ["b"] * per_arm
        y = rng.negative_binomial(10, 10 / (10 + 100.0), size=(120, 2 * per_arm))
        y[0, per_arm] = 60_000
        rows = [("st", f"f{i}", f"s{j:02}", int(v)) for i, r in enumerate(y) for j, v in enumerate(r)]
        m = spark.createDataFrame(rows, "study_id string, feature_id string, sample_id string, value long")
        s = spark.createDataFrame([("st", f"s{j:02}", a) for j, a in enumerate(arms)], "study_id string, sample_id string, condition string")
        out = {r["feature_id"]: r for r in N.nb_wald(m, s, ["condition"], "condition=b").collect()}
        assert len(out) == 120 and sum(r["pvalue"] is None for r in out.values()) <= 3
        if per_arm == 8:
            assert abs(out["f0"]["log2fc"]) < 1 and out["f0"]["pvalue"] > 0.01
        else:
            assert out["f0"]["pvalue"] is None and out["f0"]["log2fc"] > 3


def test_f_quantiles():
    from assayloom.operators.counts import f_quantile

    assert abs(f_quantile(0.99, 2, 10) - 7.5594) < 1e-3 and abs(f_quantile(0.95, 1, 1) - 161.4476) < 1e-2


def test_a_sample_table_of_many_studies_stays_on_spark(spark):
    """Two studies with other samples and sizes give each what it gives alone."""
    from assayloom.operators import counts as N

    m, s = counts(spark)
    low = m.where("sample_id not in ('s0', 's11')")
    two = m.unionByName(low.selectExpr("'other' as study_id", "feature_id", "sample_id", "value"))
    s2 = s.unionByName(s.selectExpr("'other' as study_id", "sample_id", "condition"))
    alone = {r["feature_id"]: r["stat"] for r in N.ql_test(low, s, ["condition"], "condition=control").collect()}
    both = {r["feature_id"]: r["stat"] for r in N.ql_test(two, s2, ["condition"], "condition=control").where("study_id = 'other'").collect()}
    assert alone.keys() == both.keys() and all(abs(alone[k] - both[k]) < 1e-9 for k in alone)


def test_lgamma():
    from assayloom.operators.counts import lgamma

    x = np.array([0.01, 0.5, 1.0, 3.3, 50.0, 1e6])
    assert np.allclose(lgamma(x), [math.lgamma(v) for v in x], rtol=1e-10)


def test_numbers_and_interactions_in_the_linear_model(spark):
    rng = np.random.default_rng(8)
    n = 24
    age, arm, batch = rng.normal(50, 10, n), np.arange(n) % 2, np.arange(n) % 3
    rows, y = [], {}
    for f in range(5):
        y[f] = 3 + 0.1 * age + 2 * arm + 0.2 * age * arm + 0.5 * batch + rng.normal(0, 0.3, n)
        rows += [("st", f"f{f}", f"s{j:02d}", float(y[f][j])) for j in range(n)]
    m = spark.createDataFrame(rows, "study_id string, feature_id string, sample_id string, value double")
    samples = [("st", f"s{j:02d}", float(age[j]), "case" if arm[j] else "a", int(batch[j])) for j in range(n)] + [("st", "s99", None, "a", 1), ("other", "s00", 1.0, "a", 1)]
    s = spark.createDataFrame(samples, "study_id string, sample_id string, age double, arm string, batch int")
    names = ["intercept", "age", "arm=case", "batch=1", "batch=2", "age:arm=case"]
    out = S.linear_model(m, s, ["age", "arm", "C(batch)", "age:arm"], {k: {k: 1.0} for k in names}).collect()
    x = np.column_stack([np.ones(n), age, arm, batch == 1, batch == 2, age * arm])
    inv = np.linalg.inv(x.T @ x)
    assert len(out) == 30
    for r in out:
        v, k = y[int(r["feature_id"][1:])], names.index(r["contrast_id"])
        beta = inv @ x.T @ v
        s2 = ((v - x @ beta) ** 2).sum() / (n - 6)
        assert np.allclose([r["log2fc"], r["s2"], r["df"], r["t"]], [beta[k], s2, n - 6, beta[k] / math.sqrt(s2 * inv[k, k])], rtol=1e-6)


def test_sample_correlation_in_tiles_equals_pandas(spark):
    rng = np.random.default_rng(9)
    rows = [("st", f"f{i}", f"s{j:02d}", float(rng.normal() + i * (j % 3)) if rng.random() > 0.1 else None) for i in range(30) for j in range(11)]
    m = spark.createDataFrame(rows, "study_id string, feature_id string, sample_id string, value double")
    got = {(r["sample_a"], r["sample_b"]): r["r"] for r in S.sample_corr(m, tile=4, block=8).collect()}
    whole = {}
    for _, f, s, v in rows:
        if v is not None:
            whole.setdefault(s, {})[f] = v
    names = sorted(whole)
    assert set(got) == {(a, b) for a in names for b in names if a < b}
    for (a, b), r in got.items():
        ma, mb = (np.mean(list(whole[k].values())) for k in (a, b))
        both = [f for f in whole[a] if f in whole[b]]
        x, y = np.array([whole[a][f] - ma for f in both]), np.array([whole[b][f] - mb for f in both])
        assert abs(r - (x @ y) / math.sqrt((x @ x) * (y @ y))) < 1e-9


def test_longest_common_subsequences_and_cores_equal_brute_force(spark):
    import random

    from assayloom.operators import sets, texts

    rng = random.Random(2)

    def table(x, y):
        t = [[0] * (len(y) + 1) for _ in range(len(x) + 1)]
        for i, p in enumerate(x):
            for j, q in enumerate(y):
                t[i + 1][j + 1] = t[i][j] + 1 if p == q else max(t[i][j + 1], t[i + 1][j])
        return t[-1][-1]

    for _ in range(300):
        x, y = ([rng.choice("abcd") for _ in range(rng.randint(0, 90))] for _ in range(2))
        assert sets.lcs(x, y) == table(x, y)
    for _ in range(200):
        words = [rng.choice(["ab", "cde", "f", "gh"]) for _ in range(rng.randint(1, 30))]
        body = " ".join(rng.choice(["ab", "cde", "f", "gh"]) for _ in range(60))
        runs = [" ".join(words[i:j]) for i in range(len(words)) for j in range(i + 2, len(words) + 1)]
        fits = [r for r in runs if len(r) >= 8 and r in body]
        assert texts.longest_core(words, body, 8) == (max(fits, key=len) if fits else None)
    whole = "A quote of more than twelve words that stands in its paper from the very first word to the last one"
    quotes = spark.createDataFrame([(1, 1, whole), (1, 2, "nothing of it"), (1, 3, None), (2, 1, whole)], "paper_id long, quote_id long, quote string")
    docs = spark.createDataFrame([(1, "Before. " + whole + " After."), (2, None)], "paper_id long, text string")
    assert [tuple(r) for r in texts.snap_quotes(quotes, docs).collect()] == [(1, 1, whole.lower())]


def test_rouge_of_all_pairs_of_runs(spark):
    from assayloom.operators import sets

    rows = [("k", 0, "a b c d"), ("k", 1, "a b c e"), ("k", 2, "a b c d"), ("z", 0, "x")]
    got = [tuple(r) for r in sets.rouge_stability(spark.createDataFrame(rows, "key string, run int, text string"), "key", "run", "text").collect()]
    assert got == [("k", 3, round((0.75 + 1 + 0.75) / 3, 6), 0.75, "0|1,1|2")]


def test_scans_of_quoted_and_mixed_tables(spark, tmp_path):
    from assayloom.sources import tables as T

    (tmp_path / "m.csv").write_text('gene,"note, long",S.1,S2\n"A, or ""a""",x,1,2.5\nB,"y,z",,4\n')
    assert sorted(map(tuple, T.scan_matrix(spark, str(tmp_path / "m.csv")).collect()), key=str) == [('A, or "a"', "S.1", 1.0), ('A, or "a"', "S2", 2.5), ("B", "S.1", None), ("B", "S2", 4.0)]
    (tmp_path / "one.tsv").write_text("gene\tS1\tnote\nA\t1\tx\n")
    with pytest.raises(ValueError):
        T.scan_matrix(spark, str(tmp_path / "one.tsv"))
    (tmp_path / "q.tsv").write_text("PG.Pvalue\tPG.Qvalue\tPG.ProteinGroups\tPG.Cscore\tMol weight [kDa]\tUnique peptides\tGenes\ts1.raw.Quantity\ts2.raw.Quantity\n0.1\t0.2\tP1;P2\t7\t33\t4\tG1\t10\t\n0.3\t0.1\tP3\t8\t12\t1\tG2\t5\tNaN?\n0.3\t0.1\tP4\t8\t12\t1\tG2\t5\t6\n")
    got = {(r["feature_id"], r["sample_id"]): r["value"] for r in T.scan_quant(spark, str(tmp_path / "q.tsv")).collect()}
    assert {k[1] for k in got} == {"s1.raw.Quantity", "s2.raw.Quantity"} and got["P1;P2", "s1.raw.Quantity"] == 10 and got["P3", "s2.raw.Quantity"] is None and got["P4", "s2.raw.Quantity"] == 6
    assert T.column_roles(["x", "Entry", "Majority protein IDs", "PEP", "Peptide 1"]) == (2, [3]) and T.column_roles(["a", "b"])[0] == 0
    (tmp_path / "p.mztab").write_text("PRH\taccession\tprotein_abundance_assay[1]\nPRT\tP1\t5\n")
    assert [tuple(r) for r in T.scan_quant(spark, str(tmp_path / "p.mztab")).collect()] == [("P1", "1", 5.0)]


def test_derived_columns_and_their_errors(spark):
    from assayloom.operators import evaluation as E

    s = spark.createDataFrame([("st", "a", "x_1", "lo"), ("st", "b", "x_2", "hi"), ("st", "c", "y", None)], "study_id string, sample_id string, title string, `dose level` string")
    out, errors = E.derive_columns(s, {"dose": "dose level"}, {"n": ("title", r"x_(\d)")}, {"both": ["dose", "n"]}, {"dose": {"lo": "low", "hi": "high"}, "both": {"low_1": "first"}})
    assert {r["sample_id"]: (r["dose"], r["n"], r["both"]) for r in out.collect()} == {"a": ("low", "1", "first"), "b": ("high", "2", None), "c": (None, None, None)}
    assert sorted((r["sample_id"], r["column"], r["value"], r["reason"]) for r in errors.collect()) == [("b", "both", "high_2", "not mapped"), ("c", "both", "", "not mapped"), ("c", "dose", None, "not mapped"), ("c", "n", "y", "no match")]
    for bad in ({"aliases": {"a b": "title"}}, {"aliases": {"x": "none"}}, {"combine": {"x": ["none"]}}):
        with pytest.raises(ValueError):
            E.derive_columns(s, **bad)


def test_shared_words_pair_beside_frequent_ones(spark):
    """Frequent words pair nobody by themselves, but no pair with three shared words is lost."""
    from assayloom.operators.alignment import align_cascade

    cols = [("st", "control_rep_a1_x1"), ("st", "control_rep_b2_x2"), ("st", "control_rep")]
    rows = [("st", "r1", "t", "control rep x1 a1"), ("st", "r2", "t", "rep control b2"), ("st", "r3", "t", "control rep other")]
    m = spark.createDataFrame(cols, "study_id string, sample_id string")
    attrs = spark.createDataFrame(rows, "study_id string, sample_id string, attr string, value string")
    got = {(r["matrix_column"], r["sample_id"], r["level"]) for r in align_cascade(m, attrs).collect()}
    assert got == {("control_rep_a1_x1", "r1", 3), ("control_rep_b2_x2", "r2", 3)}


def test_segments_are_packed_greedily(spark):
    import re

    from assayloom.operators import texts as T

    def packed(text, size):
        out = []
        for s in re.split(r"(?<=[.!?])\s+(?=[A-Z(\[])", " ".join(text.split())):
            if out and len(out[-1]) + len(s) > size:
                out.append(s)
            elif s:
                out = [*out[:-1], f"{out[-1]} {s}"] if out else [s]
        return out

    rng = np.random.default_rng(4)
    texts = ["", "   \n", "one", "A" * 90 + ". B.", *(" ".join("".join(rng.choice(list("abAB.!( \n"), rng.integers(1, 9))) for _ in range(60)) for _ in range(20))]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)] + [(99, None)], "paper_id long, text string")
    got = {}
    for r in sorted(T.segments(df, 40).collect(), key=lambda r: (r["paper_id"], r["block"])):
        got.setdefault(r["paper_id"], []).append(r["text"])
    assert got == {i: p for i, t in enumerate(texts) if (p := packed(t, 40))}


def test_words_around_lists_of_accessions(spark):
    from assayloom.operators import texts as T

    said = [
        ("Data were deposited at GSE11111, GSE22222 and GSE33333.", {"GSE11111": "own", "GSE22222": "own", "GSE33333": "own"}),
        ("We deposited GSE44444. Reads downloaded from GSE55555 (SRP7).", {"GSE44444": "own", "GSE55555": "cited"}),
        ("Were deposited in GSE66666 (Nolt et al. 2024).", {"GSE66666": "cited"}),
        ("The cohort [12] (GSE77777) is large.", {"GSE77777": "cited"}),
    ]
    blocks = spark.createDataFrame([(i, 0, "b", "methods", t) for i, (t, _) in enumerate(said)], "paper_id int, ord int, block_id string, section_class string, text string")
    got = {(r["paper_id"], r["accession"]): r["kind"] for r in T.mention_class(blocks).collect() if r["repo"] == "geo"}
    assert got == {(i, a): k for i, (_, kinds) in enumerate(said) for a, k in kinds.items()}


def test_id_bridge_without_annotations_or_names(spark):
    ids = spark.createDataFrame([("a", "1"), ("a", "2"), ("b", "TP53"), ("b", None), ("c", "ENSG00000000001.3")], "study_id string, feature_id string")
    notes = spark.createDataFrame([], "study_id string, feature_id string, column string, place int, value string")
    genes = spark.createDataFrame([("ENSG00000000001", "abc"), ("ENSG00000000001", "abd"), ("ENSG00000000002", None)], "ensembl string, symbol string")
    assert {tuple(r) for r in J.id_bridge(ids, notes, genes).collect()} == {("b", "TP53", "TP53"), ("c", "ENSG00000000001.3", "ABC")}
