"""Sample alignment against the greedy order, row by row."""

import math
import random
import re

import pytest

from assayloom.operators import alignment as A

M, R = "study_id string, sample_id string", "study_id string, sample_id string, attr string, value string"


def words(s):
    return {t.lower() for t in re.findall(A.TOKEN, s)}


def greedy(cols, rows, share=0.5, tokens=3):
    """{column: (row, level)} of one study, going through the rows in order."""
    cols, texts = sorted(set(cols)), {r: " ".join(sorted(v)).lower() for r, v in sorted(rows.items())}
    need = max(1, math.ceil(min(len(cols), len(texts)) * share)) if cols and texts else math.inf
    exact = {c: c for c in cols if c in texts}
    if len(exact) >= need:
        return {c: (c, 1) for c in exact}
    for level in (2, 3):
        got = dict(exact)
        for r, text in texts.items():
            if r in exact:
                continue
            free = [c for c in cols if c not in got]
            score = (lambda c, t=text: int(c.lower() in t)) if level == 2 else (lambda c, t=text: len(words(c) & words(t)) if len(words(c) & words(t)) >= tokens else 0)
            best = min(((-score(c), c) for c in free if score(c)), default=None)
            if best:
                got[best[1]] = r
        if len(got) >= need:
            return {c: (r, level) for c, r in got.items()}
    return {}


def found(spark, studies):
    m = spark.createDataFrame([(s, c) for s, (cols, _) in studies.items() for c in cols], M)
    r = spark.createDataFrame([(s, row, f"a{i}", v) for s, (_, rows) in studies.items() for row, values in rows.items() for i, v in enumerate(values)], R)
    out = {s: {} for s in studies}
    for x in A.align_cascade(m, r).collect():
        assert x["matrix_column"] not in out[x["study_id"]]
        out[x["study_id"]][x["matrix_column"]] = (x["sample_id"], x["level"])
    return out


def test_every_level_equals_the_greedy_order(spark):
    rng = random.Random(6)
    parts = ["liver", "Mouse", "ctl", "d7", "rep1", "rep2", "A1", "b", "12", "7", "x9"]
    studies = {}
    for k in range(40):
        join = rng.choice(["_", "-", ""])
        n = rng.randint(1, 14)
        cols = [join.join(rng.choices(parts, k=rng.randint(1, 5))) for _ in range(n)]
        rows = {f"R{i:02}": [" ".join(rng.choices(parts, k=rng.randint(0, 6))), rng.choice(cols) if rng.random() < 0.4 else "none"] for i in range(rng.randint(1, 14))}
        if k % 3 == 1:
            cols = ["_".join(rng.choices(parts, k=5)) for _ in range(n)]
            rows = {f"R{i:02}": [" ".join(rng.choices(parts, k=9))] for i in range(n)}
        if k % 4 == 0:
            rows |= {c: ["same"] for c in cols[: n // 2 + k % 3]}
        studies[f"st{k}"] = cols, rows
    got = found(spark, studies)
    for s, (cols, rows) in studies.items():
        assert got[s] == greedy(cols, rows), (s, cols, rows)
    assert {level for g in got.values() for _, level in g.values()} == {1, 2, 3} and any(not g for g in got.values())


def test_a_row_whose_best_column_is_taken_gets_the_next(spark):
    """All rows prefer the same columns, so pairs settle one after another."""
    cols = [f"a b1 c1 {'d1' if i % 2 else 'd2'} e{i}x" for i in range(12)]
    rows = {f"r{i:02}": ["b1 c1 d1 d2 " + " ".join(f"e{j}x" for j in range(12) if j % 3 == 0)] for i in range(12)}
    got = found(spark, {"s": (cols, rows)})["s"]
    assert len(got) == 12 and got == greedy(cols, rows)


def test_names_inside_texts_need_no_borders(spark):
    cols, rows = ["B1", "b", "1", "ÉX"], {"r1": ["zb12"], "r2": ["xx", "a b"], "r3": ["21"], "r4": ["éxé"]}
    assert found(spark, {"s": (cols, rows)})["s"] == greedy(cols, rows)


def test_nothing_to_align(spark):
    m, r = spark.createDataFrame([("s", None), ("t", "a")], M), spark.createDataFrame([("s", "x", "k", None), ("t", None, "k", "a"), ("u", "a", "k", "a")], R)
    assert A.align_cascade(m, r).collect() == [] and A.align_cascade(m.limit(0), r.limit(0)).collect() == []


@pytest.mark.parametrize("seed", range(3))
def test_assignment_alone(spark, seed):
    rng = random.Random(seed)
    edges = [(f"r{rng.randrange(30):02}", f"c{rng.randrange(20):02}", rng.randrange(3)) for _ in range(200)]
    edges = list({(a, b): (a, b, c) for a, b, c in edges}.values())
    got = {(x["row"], x["col"]) for x in A.assigned(spark.createDataFrame([("s", *e) for e in edges], "k string, row string, col string, score int"), ["k"]).collect()}
    taken, want = set(), set()
    for r in sorted({e[0] for e in edges}):
        free = min(((-s, c) for a, c, s in edges if a == r and c not in taken), default=None)
        if free:
            taken.add(free[1])
            want.add((r, free[1]))
    assert got == want


def test_shared_tokens_hold_no_pairs(spark):
    """Pairs that meet at several rare tokens come out once, and no task gathers pairs to tell them apart."""
    names = [("s", f"a{i % 7}_b{i % 5}_c{i % 3}_{i % 4}") for i in range(60)] + [("s", "x y"), ("t", "a1_b1_c1")]
    texts = [("s", f"r{i}", f"a{i % 7} b{i % 5} c{i % 3} {i % 6} of of") for i in range(80)] + [("s", "q", "a1 b1"), ("u", "r", "a1 b1 c1")]
    left, right = spark.createDataFrame(sorted(set(names)), "study_id string, col string"), spark.createDataFrame(texts, "study_id string, row string, text string")
    out = A.sharing(left, right, 3)
    want = sorted((s, c, r, n) for s, c in set(names) for u, r, t in texts if s == u and (n := len(words(c) & words(t))) >= 3)
    assert sorted(map(tuple, out.collect())) == want and len(want) > 100
    assert not re.search(r"Aggregate \[study_id#\d+, col#\d+, row#\d+\]", out._jdf.queryExecution().optimizedPlan().toString())
