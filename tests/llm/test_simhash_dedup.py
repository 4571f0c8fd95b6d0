import random
import re

import pytest
import xxhash

from assayloom.llm.components import components
from assayloom.llm.simhash_dedup import fingerprint, most_bits, one_of_each, similar_groups, simhash_groups


def brute_print(text, size=3):
    w = re.findall("[^\x20\x09-\x0d]+", "".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))
    s = [" ".join(w[i : i + size]) for i in range(len(w) - size + 1)] if len(w) >= size else [" ".join(w)] if w else []
    h = [xxhash.xxh64_intdigest(x, 42) for x in s]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def classes(pairs, nodes):
    up = {n: n for n in nodes}

    def top(x):
        while up[x] != x:
            x = up[x]
        return x

    for a, b in pairs:
        x, y = top(a), top(b)
        up[max(x, y)] = min(x, y)
    return {n: top(n) for n in nodes}


def texts(words):
    rng = random.Random(9)
    out = [None, "", " ", "One", "one", "a b", "A  b\n"]
    for k in range(40):
        base = words(k, 400).split(" ")
        out.append(" ".join(base))
        for _ in range(k % 4):
            i = rng.randrange(len(base))
            base = [*base[:i], "neu", *base[i + 1 :]]
            out.append(" ".join(base))
    return out


@pytest.mark.parametrize("radius", [2, 3])
def test_groups_equal_brute_force(make_docs, words, radius):
    t = texts(words)
    fp = [brute_print(x) for x in t]
    assert [fingerprint(x) & (2**64 - 1) for x in t] == fp
    expected = classes([(i, j) for i in range(len(fp)) for j in range(i) if (fp[i] ^ fp[j]).bit_count() <= radius], range(len(fp)))
    got = {r["doc_id"]: r["component"] for r in simhash_groups(make_docs(t), radius).collect()}
    assert got == expected and len(set(got.values())) < len(got)


def test_odd_radius_verifies_all_that_meet(spark):
    from assayloom.llm.simhash_dedup import ball_links

    rng = random.Random(4)
    base = [rng.getrandbits(62) for _ in range(4)]
    fp = list({b ^ sum(1 << rng.randrange(62) for _ in range(k)) for b in base for k in (0, 1, 1, 1)})
    links = {(r["a"], r["b"]) for r in ball_links(spark.createDataFrame(list(enumerate(fp)), "rep long, fp long"), 1).collect()}
    near = {(i, j) for j in range(len(fp)) for i in range(j) if (fp[i] ^ fp[j]).bit_count() <= 1}
    assert links == near


def test_odd_rows(odd_docs, no_docs):
    rows = simhash_groups(odd_docs).collect()
    assert len(rows) == 11 and simhash_groups(no_docs).count() == 0
    by = {r["doc_id"]: r["component"] for r in rows if r["doc_id"] is not None}
    assert by[0] == by[1] == by[2] == 0 and by[3] == by[4] == 3
    kept = one_of_each(odd_docs, similar_groups(odd_docs))
    ids = sorted(r["doc_id"] for r in kept.select("doc_id").collect() if r["doc_id"] is not None)
    assert kept.columns == odd_docs.columns and ids == [0, 3, 6, 7, 8] and kept.where("doc_id is null").count() == 2


def test_near_copies_of_80_percent_are_grouped_and_others_left(make_docs, words):
    rng, t, group = random.Random(8), [], []
    for k in range(60):
        base = words(1000 + k, 300).split(" ")
        t.append(" ".join(base))
        group.append(k)
        for i in rng.sample(range(len(base)), 3):  # at most 15 of 296 shingles differ: similarity about 0.9
            base[i] = "anders"
        t.append(" ".join(base))
        group.append(k)
    got = {r["doc_id"]: r["component"] for r in similar_groups(make_docs(t)).collect()}
    caught = sum(got[2 * k] == got[2 * k + 1] for k in range(60))
    assert caught >= 54
    assert all(group[i] == group[c] for i, c in got.items())
    assert 30 < most_bits(0.8) < 45


def test_components(spark):
    chain = [(i, i + 1) for i in range(300)]
    star = [(1000, 1000 + i) for i in range(1, 200)]
    links = spark.createDataFrame([*chain, *star, *star[:50], (5000, 5000), (6001, 6000), (None, 3)], "a long, b long")
    got = {r["node"]: r["component"] for r in components(links).collect()}
    assert got == {**{i: 0 for i in range(301)}, **{1000 + i: 1000 for i in range(200)}, 6000: 6000, 6001: 6000}
    assert components(links.where("a < 0")).count() == 0


def shingles(text, size=5):
    w = text.lower().split()
    return {tuple(w[i : i + size]) for i in range(max(len(w) - size + 1, 1))}


def jaccard(x, y):
    return len(x & y) / len(x | y)


def edited(words, rng, n):
    out = list(words)
    for i in rng.sample(range(len(out)), n):
        out[i] = f"neu{rng.randrange(10**9)}"
    return out


def test_pairs_are_decided_by_the_similarity_of_their_sets(make_docs, words):
    rng, t = random.Random(11), []
    for k in range(150):
        base = words(5000 + k, 200).split(" ")
        t += [" ".join(base), " ".join(edited(base, rng, 3 + k % 6))]
    share = [jaccard(shingles(t[i]), shingles(t[i + 1])) for i in range(0, len(t), 2)]
    assert sum(0.8 <= s < 0.85 for s in share) >= 15 and sum(0.7 <= s < 0.8 for s in share) >= 30
    got = {r["doc_id"]: r["component"] for r in similar_groups(make_docs(t)).collect()}
    assert [got[2 * k + 1] == 2 * k for k in range(150)] == [s >= 0.8 for s in share]


def test_near_copies_are_found_in_a_crowd_of_half_similar_texts(make_docs, words):
    rng, common = random.Random(12), words(7000, 150).split(" ")
    crowd = [[*common, *words(7100 + k, 60 + 10 * (k % 3)).split(" ")] for k in range(60)]
    t = [" ".join(x) for x in crowd] + [" ".join(edited(x, rng, 1 + k % 6)) for k, x in enumerate(crowd)]
    base = words(7500, 300).split(" ")  # copies of copies, and near copies of each of them
    for _ in range(40):
        base = edited(base, rng, 2)
        t += [" ".join(base), " ".join(edited(base, rng, 4))]
    sets = [shingles(x) for x in t]
    expected = classes([(i, j) for i in range(len(t)) for j in range(i) if jaccard(sets[i], sets[j]) >= 0.8], range(len(t)))
    got = {r["doc_id"]: r["component"] for r in similar_groups(make_docs(t)).collect()}
    assert got == expected and len(set(got.values())) > 60


def test_repeated_ids_keep_unique_texts_and_lose_copies(spark, words):
    a, b, c, d = (words(800 + k, 80) for k in range(4))
    rows = [(3, a, 1), (3, b, 2), (2, c, 3), (5, c, 4), (5, d, 5), (5, d, 6), (7, None, 7), (8, "", 8), (None, a, 9), (3, a.replace(" ", "  "), 10)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, key int")
    kept = sorted(r["key"] for r in one_of_each(docs, similar_groups(docs)).collect())
    assert kept in ([1, 2, 3, 5, 7, 9], [2, 3, 5, 7, 9, 10])  # one of the two forms of a under id 3, and all else that is unique
    assert sorted((r["doc_id"], r["component"]) for r in similar_groups(docs).where("doc_id is not null").collect()) == [(2, 2), (3, 3), (3, 3), (3, 3), (5, 2), (5, 5), (5, 5), (7, 7), (8, 7)]


def test_repeated_ids_with_different_texts_link_by_their_own(make_docs, spark, words):
    rows = [(1, words(900, 60)), (1, words(901, 60)), (2, words(900, 60)), (3, words(901, 60)), (0, words(901, 60))]
    got = sorted((r["doc_id"], r["component"]) for r in simhash_groups(spark.createDataFrame(rows, "doc_id long, text string")).collect())
    assert got == [(0, 0), (1, 0), (1, 1), (2, 1), (3, 0)]


def test_what_goes_may_be_too_large_to_broadcast(make_docs, words, monkeypatch):
    from assayloom.llm import simhash_dedup

    docs = make_docs([words(k // 2, 50) for k in range(40)])
    monkeypatch.setattr(simhash_dedup, "MOST_BROADCAST", 0)
    assert sorted(r["doc_id"] for r in one_of_each(docs, similar_groups(docs)).collect()) == list(range(0, 40, 2))


@pytest.mark.parametrize("similarity", [0.8, 0.6])
def test_alike_sets_nearly_share_parts(similarity):
    """Whatever the sizes: sets of the similarity have PARTS parts with a common key, one of each as a whole."""
    import numpy as np

    from assayloom.llm.simhash_dedup import PARTS, part_keys

    rng = np.random.default_rng(3)
    for n in [*range(1, 30), 60, 200, 777, 3000]:
        for _ in range(6):
            x = np.unique(rng.integers(0, 2**63, n).astype(np.uint64))
            most = int(2 * len(x) * (1 - similarity) / (1 + similarity) + 1e-9)
            out = rng.integers(0, most // 2 + 1)  # as unlike as allowed, with sizes as different as that leaves
            y = np.unique(np.concatenate([x[out:], rng.integers(0, 2**63, int(rng.integers(0, max(most - 2 * out, 0) + 1)) + 0).astype(np.uint64)]))
            both = len(np.intersect1d(x, y))
            if both / max(len(x) + len(y) - both, 1) < similarity:
                continue
            found = set()
            a, b = ({}, {})
            for side, s in ((a, x), (b, y)):
                for key, part, whole, upper in zip(*(v.tolist() for v in part_keys(s, similarity)), strict=True):
                    side.setdefault(key, []).append((part, whole, upper))
            for key in a.keys() & b.keys():
                found |= {p for p, wa, ua in a[key] for q, wb, ub in b[key] if p == q and (wa or wb) and not (ua and ub)}
            assert len(found) >= PARTS, (n, len(x), len(y), both)


def test_crowds_met_by_parts_lose_no_link(make_docs, words, monkeypatch):
    """Texts of common paragraphs, none alike, and near copies of some: with and without parts the classes are those of brute force."""
    from assayloom.llm import simhash_dedup

    rng = random.Random(21)
    paragraphs = [words(9000 + k, 50).split(" ") for k in range(20)]
    crowd = [[w for p in rng.sample(paragraphs, 8) for w in p] for _ in range(90)]
    t = [" ".join(x) for x in crowd] + [" ".join(edited(x, rng, 1 + k)) for k, x in enumerate(crowd[:14])] + [" ".join(x[: len(x) - 20 * k]) for k, x in enumerate(crowd[20:28])]
    sets = [shingles(x) for x in t]
    expected = classes([(i, j) for i in range(len(t)) for j in range(i) if jaccard(sets[i], sets[j]) >= 0.8], range(len(t)))
    docs = make_docs(t)
    assert {r["doc_id"]: r["component"] for r in similar_groups(docs).collect()} == expected
    monkeypatch.setattr(simhash_dedup, "TILE", 1)
    monkeypatch.setattr(simhash_dedup, "NEIGHBOURS", 1)
    monkeypatch.setattr(simhash_dedup, "BUCKET", 16)
    assert {r["doc_id"]: r["component"] for r in similar_groups(docs).collect()} == expected
    assert len(set(expected.values())) > 90 and len(expected) - len(set(expected.values())) >= 10


def test_similar_groups_link_what_ball_hashing_meets(make_docs, words, monkeypatch):
    """Without the search by shingles near copies are still linked: by their fingerprints, and only if their sets are alike."""
    from pyspark.sql import functions as F

    from assayloom.llm import simhash_dedup

    nobody = lambda *_: F.lit(False)
    for step in ("has_partner", "may_be_alike", "comparable"):
        monkeypatch.setattr(simhash_dedup, step, nobody)
    rng, t = random.Random(31), []
    for k in range(30):
        base = words(12000 + k, 400).split(" ")
        t += [" ".join(base), " ".join(edited(base, rng, 1))]
    far = [(fingerprint(t[i], 5) ^ fingerprint(t[i + 1], 5)) & (2**64 - 1) for i in range(0, len(t), 2)]
    near = [x.bit_count() <= 2 for x in far]
    assert 5 <= sum(near) < 30
    got = {r["doc_id"]: r["component"] for r in similar_groups(make_docs(t)).collect()}
    assert [got[2 * k + 1] == 2 * k for k in range(30)] == near


def test_rounds_and_steps_share_their_compiled_code(spark):
    """What changes from round to round is no number in the plan, so the same code is compiled for all."""
    from assayloom.llm.mixing import score

    rows = spark.range(3).selectExpr("id", "id * 0.25d p0", "id * 0.5d p1", "1d p2")
    code = lambda y: rows.select(score(y).alias("s"))._jdf.queryExecution().debug().codegenToSeq().apply(0)._2()
    assert code([0.125, -2.0, 3.5]) == code([7.0, 11.0, -0.5])
    assert [r["s"] for r in rows.select(score([1.0, 2.0, 3.0]).alias("s")).collect()] == [3.0, 4.25, 5.5]


def test_the_middle_of_a_crowd_brings_most_of_it_together(spark, words):
    """Copies with up to four changed words: the unchanged one is found, and one pair for each that is like it; before, all of other components were paired."""
    from assayloom.llm.simhash_dedup import SKETCH, hub_pairs, parities, shingle_set

    rng, base = random.Random(41), words(15000, 150).split(" ")
    t = [" ".join(base)]
    for k in range(300):
        x = list(base)
        for at in rng.sample(range(5, 145), rng.choice([1, 2, 3, 3, 4])):
            x[at] = f"new{k}at{at}"
        t.append(" ".join(x))
    sets = [shingle_set(x) for x in t]
    rows = [(shingle, (k, len(h), len(h), k, parities(h, SKETCH).tolist()), len(t)) for shingle in (5, 6) for k, h in enumerate(sets)]
    crowded = spark.createDataFrame(rows, "shingle long, b struct<node: long, n: long, left: long, of: long, brief: array<bigint>>, many long")
    got = [tuple(r) for r in hub_pairs(crowded, 0.8).collect()]
    assert {a for a, _ in got} == {0} and len(got) <= 2 * len(t)
    assert {b for _, b in got} >= {k for k in range(1, len(t)) if jaccard(shingles(t[0]), shingles(t[k])) >= 0.8}
    assert len({b for _, b in got}) > 200
