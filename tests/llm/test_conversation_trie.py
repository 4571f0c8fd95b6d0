import hashlib
import random
import zlib

import pytest

from assayloom.llm import conversation_trie as C

KIND = "conv_id long, turn long, role string, text string, node string, codes string, n string"


def sha(ids):
    return hashlib.sha256(",".join(map(str, sorted(ids))).encode()).hexdigest()


def brute(rows):
    """The nodes, from all prefixes of all rebuilt conversations."""
    own = {}
    for c, turn, role, text, *_ in rows:
        if c is not None:
            own.setdefault(c, []).append((turn is not None, turn or 0, role or "", text or ""))
    code = lambda r, t: hashlib.sha256(f"{len(r.encode())}:{r}{t}".encode()).hexdigest()[:32]
    for c in own:
        own[c] = [x[2:] for x in sorted(own[c], key=lambda x: (x[0], x[1], code(*x[2:])))]
    whole = {}
    for c in own:
        h = zlib.crc32(str(c).encode()) % 9
        whole[c] = own.get(c - (c - c // 5 * 5), [])[:h] + own[c][h:]
    nodes = {}
    for c, turns in whole.items():
        for d in range(len(turns) + 1):
            nodes.setdefault(tuple(turns[:d]), []).append(c)
    below, leaves, saved = {}, {}, {}
    for path in nodes:
        if path:
            below.setdefault(path[:-1], []).append(path)
    for path in sorted(nodes, key=len, reverse=True):
        kids = below.get(path, [])
        leaves[path] = sum(leaves[k] for k in kids) if kids else 1
        saved[path] = sum(saved[k] for k in kids) + (len(nodes[path]) - 1) * (len(path[-1][1].encode()) if path else 0)
    return sorted(
        ((min(m), len(p), min(nodes[p[:-1]]) if p else -1, len(m), len(below.get(p, [])), leaves[p], saved[p], sha([c for c in m if len(whole[c]) == len(p)])) for p, m in nodes.items()),
    )


def found(spark, rows, tmp_path):
    at = str(tmp_path / "t")
    spark.createDataFrame([(*r, "a", "b", "c") for r in rows], KIND).write.parquet(f"{at}/conversations.parquet")
    out = C.op11_conversation_trie(spark, at).collect()
    return sorted((r.conv_id, r.depth, -1 if r.parent_conv_id is None else r.parent_conv_id, r.n_convs, r.n_children, r.n_leaves, r.saved_tokens, r.ends_sha256) for r in out)


def talk(rng, c, n, words=3):
    return [(c, t, "user" if t % 2 == 0 else "assistant", f"é{rng.randrange(words)}") for t in range(n)]


@pytest.mark.parametrize("seed", range(3))
def test_nodes_equal_all_prefixes(spark, tmp_path, seed):
    rng = random.Random(seed)
    rows = [r for c in range(400) for r in talk(rng, c, rng.randint(1, 12))]
    rows += [r for c in range(400, 700) for r in talk(random.Random(1), c, 11)]  # copies
    rows += [r for c in range(701, 730) for r in talk(rng, c, rng.randint(1, 3))]  # the first of a family may be missing
    rows += talk(rng, 1_000_000_007, 90)
    assert found(spark, rows, tmp_path) == brute(rows)


def test_many_partitions_share_nodes(spark, tmp_path):
    """Nodes that go on over task borders: common long starts, prefixes that end, one conversation a task."""
    rng = random.Random(4)
    start = talk(rng, 0, 30)
    rows = []
    for c in range(0, 600, 5):
        rows += [(c, *r[1:]) for r in start[: rng.randint(9, 30)]] + [(c, 50 + t, "user", f"{rng.randrange(2)}") for t in range(rng.randint(0, 4))]
    old = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", "37")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        assert found(spark, rows, tmp_path) == brute(rows)
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", old)
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "true")


def test_nulls_ties_and_repeats(spark, tmp_path):
    rows = [(0, None, "user", "first"), (0, 0, None, None), (0, 0, "user", "x"), (0, 0, "user", "x"), (None, 0, "user", "nobody"), (1, 5, "", ""), (2, 0, "user", "first"), (3, 0, "user", "b" * 100_000), (4, 0, "user", "first"), (4, 1, "", "")]
    assert found(spark, rows, tmp_path) == brute(rows)


def test_no_conversations(spark, tmp_path):
    assert found(spark, [], tmp_path) == []
    assert found(spark, [(None, 0, "user", "x")], tmp_path / "b") == []


def test_a_run_cut_anywhere_gives_the_same_nodes():
    """Tasks of any borders, peeled apart and joined, equal one task."""
    rng = random.Random(9)
    code = lambda w: hashlib.sha256(w.encode()).digest()[:16] + (7).to_bytes(4, "big")
    paths = sorted({b"".join(code(str(rng.randrange(2))) for _ in range(rng.randint(0, 9))) for _ in range(200)}, reverse=True)
    rows = [(p, rng.randint(1, 3), i) for i, p in enumerate(paths)]

    def run(cuts):
        done, chains = [], []
        for a, b in zip([0, *cuts], [*cuts, len(rows)], strict=True):
            peel = C.Peel(whole=False)
            for codes, n, least in rows[a:b]:
                node = peel.to(codes)
                node.add(n, least, 0, 0, 0)
                node.end(str(least))
            peel.close()
            done += [o for o in peel.out if not o[0]]
            chains += [o for o in peel.out if o[0]]
        last = C.Peel(whole=True)
        for o in sorted(chains, key=lambda o: o[10], reverse=True):
            last.to(o[10])
            for node, *sums, ends in zip(last.path, *o[11:16], o[16], strict=True):
                node.add(*sums)
                node.ends = ends or node.ends
        last.close()
        assert len(chains) <= 2 * (len(cuts) + 1)
        return sorted(done + last.out, key=str)

    whole = run([])
    assert len(whole) == len({p[: 20 * d] for p in paths for d in range(len(p) // 20 + 1)})
    for _ in range(60):
        assert run(sorted(rng.sample(range(1, len(rows)), rng.randint(1, 40)))) == whole
    assert run(list(range(1, len(rows)))) == whole
