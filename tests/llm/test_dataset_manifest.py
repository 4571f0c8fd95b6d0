import hashlib
import random
import zlib

import pytest

from assayloom.llm import dataset_manifest as M

KIND = "doc_id long, text string, lang string, source string, n_chars long, leaf string, tree string, level string, part string"


def h(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def leaf_of(r, text):
    doc, _, lang, source, n = r[:5]
    return h(*("-" if v is None else f"{len(str(v).encode())}:{v}" for v in (doc, source, lang, n, text)))


def climb(nodes):
    """The root of ``nodes`` and, for each, its (left, right) a level."""
    proofs, spots, layer = [[] for _ in nodes], list(range(len(nodes))), nodes
    while len(layer) > 1:
        for k, at in enumerate(spots):
            a = at // 8 * 8
            proofs[k].append(("".join(layer[a:at]), "".join(layer[at + 1 : a + 8])))
            spots[k] = at // 8
        layer = [h(*layer[i : i + 8]) for i in range(0, len(layer), 8)]
    return layer[0], proofs


def brute(rows):
    groups = {}
    for r in rows:
        groups.setdefault(r[2], []).append((r[0] is not None, r[0] or 0, leaf_of(r, r[1]), r))
    trees = {}
    for g in sorted(groups, key=lambda g: (g is not None, (g or "").encode())):
        groups[g].sort(key=lambda x: x[:3])
        trees[g] = climb([x[2] for x in groups[g]])
    root, tops = climb([t[0] for t in trees.values()])
    out = []
    for (g, (sub, proofs)), top in zip(trees.items(), tops, strict=True):
        for (_, _, leaf, r), proof in zip(groups[g], proofs, strict=True):
            spoilt = None if r[1] is None else "".join(c.lower() if "A" <= c <= "Z" else c for c in r[1])
            f = leaf_of(r, spoilt) if r[0] is not None and zlib.crc32(str(r[0]).encode()) % 3 == 0 else leaf
            for left, right in proof + top:
                f = h(left, f, right)
            out.append((-1 if r[0] is None else r[0], leaf, sub, root, h(*(x + y for x, y in proof + top)), f, f == root))
    return sorted(out)


def found(spark, rows, tmp_path, monkeypatch):
    at = str(tmp_path / "t")
    spark.createDataFrame([(*r, "a", "b", "c", "d") for r in rows], KIND).write.parquet(f"{at}/documents.parquet")
    return sorted((-1 if r.doc_id is None else r.doc_id, *r[1:]) for r in M.op12_dataset_manifest(spark, at).collect())


@pytest.mark.parametrize("sizes", [{"en": 1}, {"en": 8}, {"en": 9, None: 1}, {"en": 700, "de": 65, "": 64, None: 3, "é": 1}, {f"l{k}": 1 + k % 3 for k in range(70)}])
def test_proofs_equal_the_trees(spark, tmp_path, monkeypatch, sizes):
    rng = random.Random(3)
    rows = [(1000 * k + i, rng.choice(["Text É", "low", "", None]), g, rng.choice(["s", None]), rng.choice([None, 7])) for k, (g, n) in enumerate(sizes.items()) for i in range(n)]
    rng.shuffle(rows)
    assert found(spark, rows, tmp_path, monkeypatch) == brute(rows)


def test_null_and_repeated_ids_and_long_texts(spark, tmp_path, monkeypatch):
    rows = [(None, "A", "en", "s", 1), (None, None, None, None, None), (5, "A", "en", "s", 1), (5, "A", "en", "s", 1), (5, "B", "en", "s", 1), (6, "Q" * 1_000_000, "en", "s", 1)] + [(7, "Same", "en", "s", 1)] * 100
    got = found(spark, rows, tmp_path, monkeypatch)
    assert got == brute(rows)
    assert {r[0] for r in got if not r[-1]} == {i for i in (5, 6, 7) if zlib.crc32(str(i).encode()) % 3 == 0}


def test_no_rows(spark, tmp_path, monkeypatch):
    assert found(spark, [], tmp_path, monkeypatch) == []


def test_any_columns_and_fan_out(spark):
    rows = spark.range(50).selectExpr("id", "cast(id % 2 as string) as kind", "sha2(cast(id as string), 256) as d")
    out = M.manifest(rows, "kind", ["id"], "d", ["id"], fan_out=2)
    got = out.withColumn("f", M.folded(M.F.col("leaf"))).collect()
    assert len(got) == 50 and all(r.f == r.root for r in got)
    assert {len(r.steps) for r in got} <= {4, 5}
