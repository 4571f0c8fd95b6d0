"""Identities, interleaving, comparison lattices, table matches and leaks against plain Python."""

import itertools
import random
import re

import pytest

from assayloom.operators import evaluation as E
from assayloom.operators import lattice as L
from assayloom.operators import selection as C
from assayloom.operators import sets as S
from assayloom.operators import texts as X


def sequential(rows, keys):
    """{id: root} row by row; only kept rows register keys."""
    owner, root = {}, {}
    for r in sorted(rows, key=lambda r: r["id"]):
        mine = [(k, r[k]) for k in keys if r[k] is not None]
        root[r["id"]] = next((owner[k] for k in mine if k in owner), r["id"])
        if root[r["id"]] == r["id"]:
            owner.update(dict.fromkeys(mine, r["id"]))
    return root


@pytest.mark.parametrize("seed", range(4))
def test_identities_equal_going_row_by_row(spark, seed):
    rng = random.Random(seed)
    n = 60
    rows = [{"id": i, "doi": rng.choice([None, f"d{rng.randrange(25)}"]), "pmid": rng.choice([None, f"p{rng.randrange(25)}"]), "title": rng.choice([None, f"t{rng.randrange(25)}"]), "note": rng.choice([None, f"n{i}"])} for i in range(n)]
    if seed == 3:  # a chain, each row tied to the next
        rows = [{"id": i, "doi": f"d{i // 2}", "pmid": f"p{(i + 1) // 2}", "title": None, "note": None} for i in range(25)]
    root = sequential(rows, ("doi", "pmid", "title"))
    want = {}
    for r in rows:
        group = [x for x in rows if root[x["id"]] == root[r["id"]]]
        want[root[r["id"]]] = (*(next((x[c] for x in group if x[c] is not None), None) for c in ("doi", "pmid", "title", "note")), len(group))
    got = S.dedupe_multi_key(spark.createDataFrame(rows, "id long, doi string, pmid string, title string, note string"), ["doi", "pmid", "title"], ["note"], "id").collect()
    assert {r["id"]: (r["doi"], r["pmid"], r["title"], r["note"], r["n_merged"]) for r in got} == want


def test_two_rows_that_only_a_duplicate_connects_both_stay(spark):
    rows = spark.createDataFrame([(1, "d1", None), (2, "d1", "t2"), (3, None, "t2"), (4, None, None)], "id long, doi string, title string")
    assert {(r["id"], r["n_merged"]) for r in S.dedupe_multi_key(rows, ["doi", "title"], [], "id").collect()} == {(1, 2), (3, 1), (4, 1)}
    assert S.dedupe_multi_key(rows.limit(0), ["doi", "title"], [], "id").collect() == []


def test_digests_ignore_order_and_see_every_change(spark):
    a = spark.createDataFrame([("k", 1, "x"), ("k", 2, None), ("k", 2, None), ("j", 1, "x")], "key string, a int, b string")
    of = lambda df: {r["key"]: (r["n"], r["digest"]) for r in S.output_hash(df, "key", ["a", "b"]).collect()}
    assert of(a) == of(a.orderBy("b").repartition(3)) and of(a)["k"] != of(a.dropDuplicates())["k"]
    assert of(a.replace("x", "y"))["k"] != of(a)["k"] and of(a.fillna("~"))["k"] != of(a)["k"]


def test_room_of_short_sources_goes_to_the_others(spark):
    rows = [("a", i, i) for i in range(30)] + [("b", 100 + i, i) for i in range(2)] + [("c", 200 + i, i) for i in range(30)]
    df = spark.createDataFrame(rows, "source string, id int, rank int")
    for shares, most in (({"a": 0.5, "b": 0.3, "c": 0.2}, 20), ({"a": 0.1}, 10), (None, 15), ({"a": 1.0, "c": 1.0}, 12), ({"b": 1.0}, 100)):
        lists = {s: [r[1] for r in rows if r[0] == s] for s in "abc"}
        merged = [(s, lists[s][i]) for i in range(30) for s in "abc" if i < len(lists[s])]
        used, kept, over = dict.fromkeys("abc", 0), [], []
        for s, i in merged:
            if shares is not None and used[s] >= round(most * shares.get(s, 0)):
                over.append(i)
            else:
                used[s] += 1
                kept.append(i)
        want = (kept + over[: max(0, most - len(kept))])[:most]
        got = [r["id"] for r in C.interleave(df, [X.F.col("rank")], most, shares).orderBy("position").collect()]
        assert got == want


def plain_lattice(rows, factors, strata, references, least, most):
    out = []
    for stratum in sorted({tuple(r[s] for s in strata) for r in rows}):
        sub = [r for r in rows if tuple(r[s] for s in strata) == stratum]
        size = lambda cell, sub=sub: sum(all(r[k] == v for k, v in cell.items()) for r in sub)
        levels, named, timed = {}, {}, {}
        for f in factors:
            lv = sorted({r[f] for r in sub})
            nums = [re.search(L.NUMBER, x) for x in lv]
            numbers = [float(m[0]) for m in nums if m]
            timed[f] = len(set(numbers)) == len(lv)
            levels[f] = [x for _, x in sorted(zip(numbers, lv, strict=True))] if timed[f] else lv
            hits = [x for x in lv if re.search(L.REFERENCE, x.strip())]
            named[f] = (references[f] if references[f] in lv else None) if f in references else (hits[0] if len(hits) == 1 else None)
        add = lambda kind, f, test, ref, rest, combo, cells, s=stratum, size=size: out.append((kind, f, test, ref, "_".join(f"{k}-{v}" for k, v in [*zip(strata, s, strict=True), *zip(rest, combo, strict=True)]), ",".join(str(size(c)) for c in cells), all(size(c) >= least for c in cells)))
        for f in factors:
            lv, ref = levels[f], named[f] or (levels[f][0] if timed[f] else None)
            if len(lv) <= most:
                pairs = [(a, b) if b == ref else (b, a) for a, b in itertools.combinations(lv, 2)]
            else:
                pairs = [(x, ref) for x in lv if ref and x != ref] + ([(b, a) for a, b in itertools.pairwise(lv) if a != ref] if timed[f] else [])
            rest = [g for g in factors if g != f]
            for combo in itertools.product(*(levels[g] for g in rest)):
                w = dict(zip(rest, combo, strict=True))
                for t, r in pairs:
                    add("simple", f, t, r, rest, combo, [{**w, f: t}, {**w, f: r}])
        for f, g in itertools.combinations(factors, 2):
            rest = [h for h in factors if h not in (f, g)]
            if not (named[f] and named[g]):
                continue
            for combo in itertools.product(*(levels[h] for h in rest)):
                w = dict(zip(rest, combo, strict=True))
                for a in levels[f]:
                    for b in levels[g]:
                        if a != named[f] and b != named[g]:
                            add("interaction", f"{f}:{g}", f"{a}:{b}", f"{named[f]}:{named[g]}", rest, combo, [{**w, f: x, g: y} for y in (b, named[g]) for x in (a, named[f])])
    return sorted(out)


def test_lattice_equals_going_through_all_combinations(spark):
    rng = random.Random(3)
    rows = [{"study_id": "s", "arm": rng.choice(["control", "drug A", "drug-B"]), "time": f"{rng.choice([0, 1, 2, 4, 8, 12, 24, 48])} h", "site": rng.choice("xyz"), "sex": rng.choice("fm")} for _ in range(150)]
    kind = "study_id string, arm string, time string, site string, sex string"
    for factors, strata, references in ((["arm", "time", "site"], ["sex"], {"site": "y"}), (["arm", "site"], [], {}), (["site"], ["sex", "arm"], {"site": "nowhere"}), (["arm", "time", "site", "sex"], [], {"time": "8 h", "sex": "m"})):
        got = sorted(tuple(r) for r in L.lattice(spark.createDataFrame(rows, kind), factors, strata, references).select("kind", "factor", "test", "reference", "within", "sizes", "analyzable").collect())
        assert got == plain_lattice(rows, factors, strata, references, 3, 6)


def test_lattice_of_odd_designs(spark):
    s = spark.createDataFrame([("s", "a", None), ("s", "a", "x"), ("t", "a", "x")], "study_id string, f string, g string")
    assert L.lattice(s, ["f", "g"]).collect() == [] and L.lattice(s.limit(0), ["f", "g"]).collect() == []


def test_tables_meet_by_their_cells(spark):
    k = "paper_id long, table_id string, text string"
    a = spark.createDataFrame([(1, "A", "**Table 1** x\n\n| a | B |\n|---|:-:|\n| 1 | −2 |\n| 1 | - |"), (1, "B", "| q |"), (1, "C", "no cells"), (2, "A", "| a |")], k)
    b = spark.createDataFrame([(1, "P", "|1|*b*|\n|--|--|\n|9|-2|"), (1, "Q", "| 1 | b |"), (1, "R", "| b | 1 | -2 |"), (2, "Z", None)], k)
    got = {(r["paper_id"], r["table_id"]): (r["n_cells"], r["match_id"], r["share"]) for r in E.table_match(a, b).collect()}
    assert got == {(1, "A"): (5, "P", 0.8), (1, "B"): (1, None, 0.0), (2, "A"): (1, None, 0.0)}


def test_leaks_equal_searching_each_pattern_in_each_block(spark):
    rng = random.Random(8)
    word = lambda: "".join(rng.choice("abc é") for _ in range(rng.randint(1, 6)))
    blocks = [(p, f"B{i}", " ".join(word() for _ in range(rng.randint(0, 80)))) for p in range(4) for i in range(12)] + [(0, "long", "the " * 20_000 + "needle in the hay stack"), (1, "none", None)]
    patterns = [(0, "title", "Needle in the\nhay STACK" + " x" * 20)]
    for p, _, text in blocks[:48]:
        if len(text) > 70:
            at = rng.randrange(len(text) - 60)
            patterns += [(p, "title", text[at : at + rng.randint(38, 60)].upper()), (p, "header", text[at : at + rng.randint(8, 20)]), (p, "header", word() * 4)]
    patterns += [(0, "header", "needle in the hay"), (2, "title", None), (3, "header", "")]
    squeeze = lambda t: re.sub(r"\s+", "", re.sub(r"[*_`\\]", "", t.lower()))
    want = {}
    for p, b, text in blocks:
        for kind in ("header", "title"):
            few = 40 if kind == "title" else 12
            ps = {squeeze(t)[: 60 if kind == "title" else None] for q, k, t in patterns if q == p and k == kind and t and len(t) >= few}
            n = sum(len(x) >= 12 and x in squeeze(text or "") and (kind == "title" or len(squeeze(text)) > len(x)) for x in ps)
            if n:
                want.setdefault((p, b), {})[kind] = n
    got = {(r["paper_id"], r["block_id"]): {k: v for k, v in (("header", r["n_headers"]), ("title", r["n_titles"])) if v} for r in X.leaks(spark.createDataFrame(blocks, "paper_id long, block_id string, text string"), spark.createDataFrame(patterns, "paper_id long, kind string, text string")).collect()}
    assert got == want and len(got) > 20


def test_table_match_with_frequent_cells_equals_all_pairs(spark):
    """However few tables make a cell frequent, the match is that of all pairs, ties and tables with frequent cells only too."""
    import random

    from assayloom.operators import evaluation as E

    rng = random.Random(4)
    table = lambda: "\n".join(f"| {rng.choice('ab')} | {rng.choice('abcd')} | {rng.randrange(60)} |" for _ in range(rng.randrange(1, 5)))
    make = lambda x: spark.createDataFrame([(p, f"{x}{i:03d}", table()) for p in range(2) for i in range(40)] + [(0, f"{x}900", "| a | a |"), (0, f"{x}901", "| d | c |"), (1, f"{x}902", "| zz |")], "paper_id int, table_id string, text string").coalesce(2)
    a, b = make("A").cache(), make("B").cache()
    cells = lambda df: {(r[0], r[1]): {} for r in df.collect()}
    x, y = cells(a), cells(b)
    for df, of in ((a, x), (b, y)):
        for r in E.table_cells(df).collect():
            of[r["paper_id"], r["table_id"]][r["cell"]] = r["n"]
    want = {}
    for (p, t), c in x.items():
        k = [(-sum(n for cell, n in c.items() if cell in d), u) for (q, u), d in y.items() if p == q]
        top = min(v for v in k if v[0] < 0) if any(v[0] < 0 for v in k) else (0, None)
        want[p, t] = (sum(c.values()), top[1], round(-top[0] / sum(c.values()), 6))
    for frequent in (0, 3, 1000):
        got = {(r["paper_id"], r["table_id"]): (r["n_cells"], r["match_id"], r["share"]) for r in E.table_match(a, b, frequent).collect()}
        assert got == want, frequent
    assert "CartesianProduct" not in E.table_match(a, b)._jdf.queryExecution().executedPlan().toString()


def test_token_recall_counts_a_repeated_candidate_once(spark):
    """A candidate that stands twice under a key doubled its shared tokens, so shares went above 1."""
    from assayloom.operators import sets as C

    kind = "key string, text string"
    gold = spark.createDataFrame([("a", "one two three four"), ("a", "one two three four"), ("b", "x y"), ("c", "?!"), ("d", None)], kind)
    got = spark.createDataFrame([("a", "ONE two"), ("a", "ONE two"), ("a", "three five"), ("d", "x")], kind)
    assert {tuple(r) for r in C.token_recall(got, gold, 0.5).collect()} == {("a", "one two three four", 0.5, True), ("b", "x y", 0.0, False)}


def test_highest_value_of_a_study_needs_no_window(spark):
    """A study's rows stay where they are: its highest value is joined. Studies without a name count as one."""
    from assayloom.operators import matrix as M

    m = spark.createDataFrame([("p", "f", "s", 80.0), ("p", "g", "s", 20.0), ("b", "f", "s", 0.5), (None, "f", "s", 90.0), (None, "g", "s", 10.0)], "study_id string, feature_id string, sample_id string, value double")
    for out, want in ((M.beta_to_m(m), {("p", "g"): 0.2, (None, "g"): 0.1, ("b", "f"): 0.5}), (M.log_if_linear(m), None)):
        assert "Window" not in out._jdf.queryExecution().optimizedPlan().toString()
        got = {(r["study_id"], r["feature_id"]): r["value"] for r in out.collect()}
        assert len(got) == 5
        for k, b in (want or {}).items():
            assert abs(2 ** got[k] - (b + 1e-3) / (1 - b + 1e-3)) < 1e-9


def test_tables_in_tiles_equal_all_pairs(spark):
    """Tables left with frequent cells only met all others of their paper in rows; now no pair is a row, whatever the tiles."""
    import random

    from assayloom.operators import evaluation as E

    rng = random.Random(11)
    text = lambda n: "\n".join(f"| {rng.choice('abcdefgh')} | {rng.randrange(30)} |" for _ in range(rng.randrange(1, n)))
    make = lambda x, k: [(p, f"{x}{i:03d}", text(6)) for p in range(2) for i in range(k)] + [(0, f"{x}000", "| a | a |\n| a | h |")]
    x, y = [*make("A", 50), (7, "A1", "| only here |")], make("B", 70)
    k = "paper_id int, table_id string, text string"
    a, b = spark.createDataFrame(x, k), spark.createDataFrame(y, k)
    held = []
    for rows, df in ((x, a), (y, b)):
        cells = {r[:2]: {} for r in rows}
        for r in E.table_cells(df).collect():
            cells[r["paper_id"], r["table_id"]][r["cell"]] = r["n"]
        held.append(cells)
    want = {}
    for (p, t), c in held[0].items():
        best = min([(-s, u) for (q, u), d in held[1].items() if p == q and (s := sum(n for v, n in c.items() if v in d))], default=(0, None))
        want[p, t] = (sum(c.values()), best[1], round(-best[0] / sum(c.values()), 6))
    for frequent, tile in ((3, 60), (0, 100), (10, 1 << 20)):
        out = E.table_match(a, b, frequent, tile)
        assert "CoGroup" in out._jdf.queryExecution().optimizedPlan().toString()
        assert {(r["paper_id"], r["table_id"]): (r["n_cells"], r["match_id"], r["share"]) for r in out.collect()} == want, (frequent, tile)


def test_most_held_places_equal_sums():
    import numpy as np

    from assayloom.operators import evaluation as E

    rng = np.random.default_rng(2)
    for k in (1, 3, 9):
        for share in (0.01, 0.3, 0.9):
            flags, w = rng.random((k, 640)) < share, rng.integers(1, 9, k)
            sums = (flags * w[:, None]).sum(axis=0)
            got = E.most_held([np.packbits(f).view(np.uint64) for f in flags], w.tolist())
            assert got == (sums.max(), sums.argmax() if sums.max() else 0)
