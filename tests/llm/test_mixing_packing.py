import itertools
import random

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from assayloom.llm import mixing as M
from assayloom.llm import packing as P
from assayloom.llm._shared import written


def labelled(spark, words, n=400):
    rng, rows, labels = random.Random(1), [], []
    for i in range(n):
        text, kind = words(i, rng.randint(40, 200)), i % 8
        if kind == 1:
            text = " ".join(w + rng.choice(["###", "$$$", "&&&"]) for w in text.split())
        if kind == 2:
            at = text.split()
            for _ in range(3):
                at.insert(rng.randrange(len(at)), rng.choice(["schlimm", "mies", "übel"]))
            text = " ".join(at)
        rows.append((i, text, "x", "y"))
        labels.append((i, int(kind != 1), int(kind == 2)))
    return spark.createDataFrame(rows, "doc_id long, text string, rate string, p0 string"), spark.createDataFrame(labels, "doc_id long, quality int, toxic int")


def test_held_out_accuracy(spark, words):
    docs, labels = labelled(spark, words, 600)
    model = M.fitted(docs, labels.where("doc_id < 400"))
    truth = {r["doc_id"]: r["d"] for r in labels.select("doc_id", M.domain_of().alias("d")).collect()}
    rows = M.memberships(docs.where("doc_id >= 400"), model).collect()
    right = sum(int(np.argmax([r["p0"], r["p1"], r["p2"]])) == truth[r["doc_id"]] for r in rows)
    assert right / len(rows) >= 0.9


def test_expected_totals_meet_the_targets_and_rates_are_nonnegative(spark, words):
    docs, labels = labelled(spark, words)
    out = M.mixing(docs, labels).collect()
    p = np.array([[r[f"p_{d}"] for d in M.DOMAINS] for r in out])
    n, rate = np.array([r["n_tokens"] for r in out]), np.array([r["rate"] for r in out])
    got, before = (n * rate) @ p, n @ p
    goal = np.array(M.WEIGHTS) / M.WEIGHTS[0] * before[0]
    assert rate.min() >= 0 and np.allclose(got, goal, rtol=1e-3, atol=1e-3 * goal.sum())
    good = rate[p[:, 0] > 0.98]
    assert abs(good.mean() - 1) < 0.05
    copies = np.array([r["copies"] for r in out])
    assert (np.abs(copies - rate) < 1).all()


def dirichlet(spark, alpha, n=300):
    rng = np.random.default_rng(2)
    p, n = rng.dirichlet(alpha, n), rng.integers(1, 500, n)
    rows = [(i, int(n[i]), *map(float, p[i])) for i in range(len(n))]
    return p, n, spark.createDataFrame(rows, "doc_id long, n_tokens long, p0 double, p1 double, p2 double")


def test_rates_are_the_nearest_to_one_that_meet_the_targets(spark):
    p, n, members = dirichlet(spark, [0.3, 0.3, 0.3])
    y, goal, now = M.fit_rates(members, (0.8, 0.15, 0.05), 0.0)
    r = np.array([x[0] for x in members.orderBy("doc_id").select(M.rate(y)).collect()])
    assert r.min() >= 0 and r.max() <= M.MOST and np.allclose((n * r) @ p, now) and np.allclose(now, goal, rtol=1e-4)
    # plain projected gradient on the rates themselves, with what was reached as targets
    slow, whole = np.ones(300), np.linalg.inv((p * n[:, None]).T @ p)
    seen = np.zeros(3)
    for _ in range(60_000):
        seen += whole @ (now - (n * slow) @ p) / 2
        slow = np.clip(1 + p @ seen, 0, M.MOST)
    assert np.allclose(slow, r, atol=1e-3)
    others = np.random.default_rng(3).normal(0, 0.01, (200, 300))  # no feasible neighbour is nearer to 1
    null = others - (others * n) @ p @ np.linalg.inv((p * n[:, None]).T @ (p * n[:, None])) @ (p * n[:, None]).T
    for d in null:
        z = r + d
        if z.min() >= 0 and z.max() <= M.MOST:
            assert n @ (z - 1) ** 2 >= n @ (r - 1) ** 2 - 1e-6


def test_unreachable_targets_keep_the_corpus(spark):
    p, n, members = dirichlet(spark, [30, 1, 1])
    y, goal, now = M.fit_rates(members, (0.98, 0.01, 0.01))
    r = np.clip(1 + p @ y, 0, M.MOST)
    assert abs(now - goal).max() > 0.005 * goal.sum() and np.allclose((n * r) @ p, now)
    before = n @ p
    assert now[2] / now.sum() < before[2] / before.sum() and (n * np.minimum(r, 1)) @ p[:, 0] >= M.LEAST_KEPT * before[0]


@pytest.mark.parametrize("sf", ["sf0.001", "sf0.01"])
def test_rates_of_what_reaches_the_stage(spark, sf):
    """No document is repeated much, and most distinct ones stay."""
    data = f"/root/testdata/{sf}"
    stages = dict(corpus_pipeline.STAGES)
    docs = written(stages["near_duplicates"](spark, stages["quality"](spark, spark.read.parquet(f"{data}/documents.parquet"), data), data), "test")
    out = M.mixed(docs, spark.read.parquet(f"{data}/labels.parquet")).groupBy("doc_id").count().agg(F.count(F.lit(1)), F.max("count")).first()
    assert out[0] >= 0.6 * docs.count() and out[1] <= 3


def test_mixed_keeps_columns_and_repeats_by_copies(spark, words):
    docs, labels = labelled(spark, words, 200)
    copies = {r["doc_id"]: r["copies"] for r in M.mixing(docs, labels).collect()}
    out = M.mixed(docs, labels)
    assert out.columns == docs.columns
    counts = {r["doc_id"]: r["count"] for r in out.groupBy("doc_id").count().collect()}
    assert counts == {k: v for k, v in copies.items() if v}


def test_odd_rows_and_no_labels(spark, odd_docs, no_docs):
    labels = spark.createDataFrame([(3, 1, None), (3, 0, 0), (None, 1, 1), (4, None, None)], "doc_id long, quality int, toxic int")
    assert M.mixing(odd_docs, labels).count() == 11
    none = labels.where("doc_id > 99")
    out = M.mixing(odd_docs, none).collect()
    assert all(r["rate"] == 1 and r["copies"] == 1 for r in out)
    assert M.mixing(no_docs, labels).count() == 0 and M.mixed(no_docs, none).count() == 0


def padding(lengths, cuts):
    return sum(min(c for c in cuts if c >= n) - n for n in lengths)


def test_boundaries_are_optimal():
    rng = random.Random(4)
    for _ in range(20):
        lengths = [rng.randint(0, 40) for _ in range(30)]
        values = sorted(set(lengths))
        hist = [(v, lengths.count(v), v * lengths.count(v)) for v in values]
        cuts = P.boundaries(hist, 3)
        best = min(padding(lengths, [*c, values[-1]]) for c in itertools.combinations(values[:-1], min(2, len(values) - 1)))
        assert len(cuts) <= 3 and padding(lengths, cuts) == best
    assert P.boundaries([], 4) == []


def test_batches_are_full_within_the_budget_and_hold_every_row(spark, monkeypatch):
    monkeypatch.setattr(P, "SHARD_ROWS", 50)
    rng = random.Random(5)
    rows = [(i, rng.choice([3, 8, 20, 70, 5000]) + rng.randint(0, 2)) for i in range(900)] + [(0, 3)] * 40 + [(None, 7)]
    lengths = spark.createDataFrame(rows, "doc_id long, n_tokens long")
    out = P.pack(lengths, buckets=5, budget=400).collect()
    assert sorted(str((r["doc_id"], r["n_tokens"])) for r in out) == sorted(str(r) for r in rows)
    batches = {}
    for r in out:
        batches.setdefault((r["bucket"], r["batch"]), []).append(r)
    for (b, k), rs in batches.items():
        size = rs[0]["bucket_len"]
        room = max(1, 400 // size)
        assert all(r["padding"] == size - r["n_tokens"] >= 0 for r in rs)
        assert sorted(r["slot"] for r in rs) == list(range(len(rs)))
        assert len(rs) == room or (b, k + 1) not in batches and len(rs) <= room
    assert P.pack(lengths.where("n_tokens < 0")).count() == 0


def test_long_lengths_share_bins_but_not_beyond_their_width(spark):
    n = [(v,) for v in (0, 1, 4096, 4097, 4100, 10**6, 10**6 + 1, 10**9)]
    got = [r[0] for r in spark.createDataFrame(n, "n long").select(P.length_bin(F.col("n"))).collect()]
    assert got == sorted(got) and got[2] == 4096 and got[5] == got[6] < got[7]


def test_packing_odd_rows(odd_docs, no_docs):
    path = public_tokenizers.path("word_bpe_49k.json")
    assert P.packed(odd_docs, path).count() == 11 and P.packed(no_docs, path).count() == 0
