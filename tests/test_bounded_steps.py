"""Steps that must not do their work twice, or hold more than they need."""

import random

from assayloom.operators import results as R
from assayloom.operators import texts as X
from assayloom.plans.queries import QUERIES

DATA = "/root/testdata/sf0.001"


def optimized(df):
    return df._jdf.queryExecution().optimizedPlan().toString()


def test_few_patterns_of_a_paper_need_no_marks(spark, monkeypatch):
    rng = random.Random(2)
    word = lambda: "".join(rng.choices("abcde", k=5))
    texts = {(p, f"B{b}"): " ".join(word() for _ in range(40)) for p in range(6) for b in range(4)}
    blocks = spark.createDataFrame([(*k, v) for k, v in texts.items()], "paper_id long, block_id string, text string")
    cut = [(p, kind, t[10:90]) for (p, b), t in texts.items() for kind in ("header", "title") if rng.random() < 0.6]
    patterns = spark.createDataFrame([*cut, (0, "title", "nowhere " * 9), (9, "title", "of no paper " * 9), (1, "title", None)], "paper_id long, kind string, text string")
    monkeypatch.setattr(X, "FEW", 0, raising=False)
    by_marks = sorted(map(tuple, X.leaks(blocks, patterns).collect()))
    assert len(by_marks) >= 15
    monkeypatch.undo()

    def never(*_):
        raise AssertionError("marks of few patterns")

    monkeypatch.setattr(X, "marked", never)
    assert sorted(map(tuple, X.leaks(blocks, patterns).collect())) == by_marks


def test_blocks_are_made_once_for_both_sides_of_au_10(spark):
    assert "Window" not in optimized(QUERIES["au_10_foreign_accessions"](spark, DATA))


def test_blocks_are_made_once_for_both_parses_of_ev_19(spark):
    assert "Window" not in optimized(QUERIES["ev_19_accession_classes"](spark, DATA))


def test_merged_ranges_of_odd_rows_hold_no_table_of_islands(spark):
    rng = random.Random(5)
    starts = [rng.randrange(60) for _ in range(500)]
    rows = [(rng.randrange(40), None if rng.random() < 0.05 else s, None if rng.random() < 0.05 else s + rng.randrange(-3, 9)) for s in starts]
    expected = []
    for k in sorted({r[0] for r in rows}):
        top, islands = None, []
        for s, e in sorted(((s, e) for x, s, e in rows if x == k), key=lambda r: tuple((v is not None, v or 0) for v in r)):
            if top is None or (s is not None and s > top):
                islands.append([])
            islands[-1].append((s, e))
            top = e if top is None else top if e is None else max(top, e)
        least = lambda v, f: f(v) if (v := [x for x in v if x is not None]) else None
        expected += [(k, least([s for s, _ in i], min), least([e for _, e in i], max), len(i)) for i in islands]
    got = R.merge_ranges(spark.createDataFrame(rows, "k long, start long, end long"), ["k"])
    order = lambda r: tuple((v is not None, v or 0) for v in r)
    assert sorted(map(tuple, got.select("k", "start", "end", "n").collect()), key=order) == sorted(expected, key=order)
    assert "Aggregate" not in optimized(got)


def test_median_of_a_profile_is_apart_from_its_distinct_counts(spark):
    from assayloom.operators.matrix import profile

    rows = [("A", "f1", "s1", 1.0), ("A", "f1", "s2", 3.0), ("A", "f2", "s1", -2.5), ("A", "f2", "s2", None), ("A", "f3", "s1", float("nan")), ("A", "f3", "s2", 3.0), (None, "f1", "s1", 2.0), ("B", "f1", "s1", None)]
    df = profile(spark.createDataFrame(rows, "study_id string, feature_id string, sample_id string, value double"))
    got = {r["study_id"]: tuple(r)[1:] for r in df.collect()}
    assert got == {"A": (3, 2, 4, 2, -2.5, 3.0, 2.0, 0.75, 1), None: (1, 1, 1, 0, 2.0, 2.0, 2.0, 1.0, 0), "B": (1, 1, 0, 1, None, None, None, None, None)}
    assert all("gid" not in x for x in optimized(df).splitlines() if "percentile(" in x)
