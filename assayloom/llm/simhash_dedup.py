"""SimHash near-dedup: meet-in-the-middle ball hashing.

A document's fingerprint takes, bit by bit, the majority of the XXH64 hashes of its word shingles. Two fingerprints at
distance r or less have a common neighbour within half of r (rounded up) of both, so every distinct fingerprint emits all variants
within that half, the variants are shuffled, and fingerprints that meet are verified against r. A variant can't be met
by more fingerprints than there are masks (65 for r = 2), however many documents are alike, because equal fingerprints are
one before the expansion; so no group is unbounded and neighbours in a group suffice as links.

For similarity on longer shingles no fingerprint decides well: texts that share 80 % of their shingles differ in about 15 % of its
bits, give or take. ``similar_groups`` takes what meets by ball hashing first, decided by the Jaccard similarity of the sets, and goes on with
an exact set-similarity join for the pairs whose fingerprints are farther apart: candidates share a shingle of their prefixes (the rarest
fifth of the set, and one more, at 0.8), pass sound bounds from positions and parity sketches, and are decided by the Jaccard
similarity of the sets themselves. What meets in crowds that all share a passage is told apart by the parts of the sets instead.

Edge cases: a null or blank text has fingerprint zero and is linked like any other; fewer words than a shingle give one
shingle of all words; a row with a null id takes part in no link and has a null component unless its fingerprint (or set) has
other rows; rows that repeat an id are judged by their own texts, each; other columns are ignored or, in ``one_of_each``, kept.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from assayloom.llm._shared import map_texts, small_batches, table, written
from assayloom.llm.components import components

SEED, SHINGLE, RADIUS, BITS = 42, 3, 2, 64
SIMILARITY, WIDE_SHINGLE, WORDS = 0.8, 5, 4
#: Least bits of a parity sketch, which has two bits a shingle at least; neighbours compared in a random order at a crowded shingle.
SKETCH, NEIGHBOURS = 512, 4
#: Rows of a shingle that one task looks at in order; rows at a shingle that are compared pair by pair.
BUCKET, TILE = 4096, 512
#: Rows of a crowd that the others are measured by, about, to find the one in its middle.
MEASURES = 32
#: Parts that alike sets must nearly have in common, see ``part_keys``.
PARTS = 3
#: Rows of ids and keys that are broadcast at most, some 10 MB; beyond that both sides of a join are shuffled.
MOST_BROADCAST = 250_000
#: One document of SAMPLE is counted for the order of shingles; RECURS times there is common; at most MOST_COMMON are ordered by count.
SAMPLE, RECURS, MOST_COMMON = 16, 4, 200_000
BLOCK = 65_536  # hashes whose bits are counted at once


def shingle_hashes(words: list[bytes], size: int) -> list[int]:
    if not words:
        return []
    joined = b" ".join(words)
    ends, at = [], -1
    for w in words:
        at += len(w) + 1
        ends.append(at)
    starts = [0, *(e + 1 for e in ends[:-1])]
    last = max(len(words) - size + 1, 1)
    h = xxhash.xxh64_intdigest
    return [h(joined[a:b], SEED) for a, b in zip(starts[:last], ends[min(size, len(words)) - 1 :], strict=True)]


def text_hashes(text: str | None, size: int) -> list[int]:
    """Hashes of the text's shingles. Bytes are split at ASCII white space and only A-Z is lower-cased."""
    return shingle_hashes((text or "").encode().lower().split(), size)


def fingerprint(text: str | None, size: int = SHINGLE) -> int:
    """The fingerprint as a signed long."""
    return majority(text_hashes(text, size))


def majority(hashes: list[int]) -> int:
    """The bits that are set in over half of the hashes, as a signed long."""
    ones = np.zeros(BITS, dtype=np.int64)
    for i in range(0, len(hashes), BLOCK):
        block = np.array(hashes[i : i + BLOCK], dtype="<u8").view(np.uint8).reshape(-1, 8)
        ones += np.unpackbits(block, axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * ones > len(hashes), bitorder="little").view("<i8")[0])


def fingerprints(docs: DataFrame, size: int = SHINGLE, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, fp) for every row; one pass, no shuffle."""
    return map_texts(docs, id_col, text_col, lambda text: (fingerprint(text, size),), "fp bigint")


def masks(reach: int) -> list[int]:
    """All longs with at most ``reach`` bits set, as signed values."""
    values = [sum(1 << i for i in c) for n in range(reach + 1) for c in combinations(range(BITS), n)]
    return [v - (1 << BITS) if v >= 1 << (BITS - 1) else v for v in values]


def ball_links(prints: DataFrame, radius: int = RADIUS) -> DataFrame:
    """Links (a, b) that connect the ``rep`` of all distinct ``fp`` within ``radius`` bits of each other.

    ``prints`` has one row (rep, fp) for each distinct fp. Where radius is even every pair that meets at a variant is
    within it, and links between neighbours in the order of rep connect the group; odd radii need every pair that
    meets, of which a group has a bounded number.
    """
    reach = (radius + 1) // 2
    flips = F.array(*[F.lit(m).cast("long") for m in masks(reach)])
    met = prints.where("rep is not null").select("rep", "fp", F.explode(flips).alias("flip")).select(F.col("fp").bitwiseXOR(F.col("flip")).alias("variant"), "rep", "flip")
    w = Window.partitionBy("variant").orderBy("rep")
    gaps = 1 if radius % 2 == 0 else len(masks(reach)) - 1
    if gaps == 1:
        pairs = met.select(F.col("rep").alias("b"), "flip", F.lag("rep").over(w).alias("a"), F.lag("flip").over(w).alias("flip_a"))
    else:
        seen = F.collect_list(F.struct(F.col("rep").alias("a"), F.col("flip").alias("flip_a"))).over(w.rowsBetween(-gaps, -1))
        pairs = met.select(F.col("rep").alias("b"), "flip", seen.alias("seen")).select("b", "flip", F.inline("seen"))
    # both differ from the variant by their flips, so from each other by the two flips together
    near = F.bit_count(F.col("flip").bitwiseXOR(F.col("flip_a"))) <= radius
    return pairs.where(F.col("a").isNotNull() & near).select("a", "b").distinct()


def simhash_groups(docs: DataFrame, radius: int = RADIUS, size: int = SHINGLE, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, fp, component) for every row of ``docs``; component is the smallest id reachable over links."""
    seen = written(fingerprints(docs, size, id_col, text_col), "fingerprints")
    prints = written(seen.groupBy("fp").agg(F.min(id_col).alias("least")), "prints")
    found = components(ball_links(prints.where("least is not null").select(F.col("fp").alias("rep"), "fp"), radius))
    tops = written(prints.join(found, prints["fp"] == found["node"], "left").select("fp", "least", F.coalesce("component", "fp").alias("top")), "tops")
    named = written(tops.join(tops.groupBy("top").agg(F.min("least").alias("component")), "top").select("fp", "component"), "named")
    return seen.join(named, "fp").select(id_col, "fp", "component")


def mixed(h: np.ndarray, k: int) -> np.ndarray:
    """Hashes for the k-th word of a wide fingerprint, from the first ones (the finalizer of splitmix64)."""
    if k == 0:
        return h
    with np.errstate(over="ignore"):
        z = h + np.uint64(k) * np.uint64(0x9E3779B97F4A7C15)
        z = (z ^ (z >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        z = (z ^ (z >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        return z ^ (z >> np.uint64(31))


def wide_fingerprint(text: str | None, size: int = WIDE_SHINGLE) -> tuple[int, ...]:
    """WORDS signed longs, from the same words as ``fingerprint``: a yardstick for tests, nothing is decided by it."""
    hashes = np.array(shingle_hashes((text or "").encode().lower().split(), size), dtype=np.uint64)
    out = []
    for k in range(WORDS):
        ones = np.zeros(BITS, dtype=np.int64)
        for i in range(0, len(hashes), BLOCK):
            block = mixed(hashes[i : i + BLOCK], k).view(np.uint8).reshape(-1, 8)
            ones += np.unpackbits(block, axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
        out.append(int(np.packbits(2 * ones > len(hashes), bitorder="little").view("<i8")[0]))
    return tuple(out)


def most_bits(similarity: float) -> int:
    """The expected distance of wide fingerprints of two sets with this Jaccard similarity."""
    return math.floor(WORDS * BITS * math.acos(2 * similarity / (1 + similarity)) / math.pi)


def shingle_set(text: str | None, size: int = WIDE_SHINGLE) -> np.ndarray:
    """The distinct shingle hashes, ascending, from the same words as ``fingerprint``."""
    return np.unique(np.array(text_hashes(text, size), dtype="<u8"))


def row_key(text_col: str) -> Column:
    """Tells rows apart that repeat an id: equal for equal texts only, but for chance among the texts of one id."""
    return F.xxhash64(F.coalesce(text_col, F.lit("")))


def common_shingles(docs: DataFrame, size: int, id_col: str, text_col: str) -> tuple[np.ndarray, np.ndarray]:
    """Hashes (ascending) and counts of shingles that recur in a sample of the documents.

    They only decide which shingles a prefix starts with. Any order gives the same links, so what the sample misses costs time, not links.
    """
    sample = docs.where(F.pmod(F.xxhash64(id_col), F.lit(SAMPLE)) == 0)
    seen = map_texts(sample, id_col, text_col, lambda text: (shingle_set(text, size).view("<i8"),), "shingles array<bigint>")
    often = seen.select(F.explode("shingles").alias("shingle")).groupBy("shingle").count().where(F.col("count") >= RECURS)
    rows = often.orderBy(F.desc("count"), "shingle").limit(MOST_COMMON).toArrow()
    hashes, counts = rows["shingle"].to_numpy().view("<u8"), rows["count"].to_numpy()
    order = np.argsort(hashes)
    return hashes[order], counts[order]


def parities(h: np.ndarray, bits: int) -> np.ndarray:
    """A sketch of ``bits`` bits, a power of two, as longs: each shingle flips one."""
    odd = (np.bincount((h & np.uint64(bits - 1)).astype(np.int64), minlength=bits) & 1).astype(np.uint8)
    return np.packbits(odd, bitorder="little").view("<i8")


def set_columns(text: str | None, size: int, similarity: float, common: np.ndarray, counts: np.ndarray) -> tuple:
    """Digest (two longs), number, brief and full parity sketch, and prefix of the text's shingle set; at the end the text's fingerprint.

    Sets of this similarity share a shingle of their prefixes, if prefixes follow one order of all shingles: here rare ones first, then
    by hash. Each shingle flips one bit of a sketch, so sketches differ in at most as many bits as the sets differ in shingles.
    """
    hashes = text_hashes(text, size)
    h = np.unique(np.array(hashes, dtype="<u8"))
    d0, d1 = np.frombuffer(xxhash.xxh3_128_digest(h.tobytes(), SEED), dtype="<i8").tolist()
    often = np.zeros(len(h), dtype=np.int64)
    if len(common) and len(h):
        at = np.minimum(np.searchsorted(common, h), len(common) - 1)
        often = np.where(common[at] == h, counts[at], 0)
    first = h[np.lexsort((h, often))][: len(h) - math.ceil(similarity * len(h) - 1e-9) + 1]
    return d0, d1, len(h), parities(h, SKETCH), parities(h, max(SKETCH, 1 << (2 * len(h)).bit_length())), first.view("<i8"), majority(hashes)


def differing(x: Column, y: Column) -> Column:
    """Bits in which two sketches of the same length differ."""
    return F.aggregate(F.zip_with(x, y, lambda a, b: F.bit_count(a.bitwiseXOR(b))), F.lit(0), lambda n, a: n + a)


def folded(x: Column) -> Column:
    """The sketch of half as many bits."""
    half = (F.size(x) / 2).cast("int")
    return F.zip_with(F.slice(x, F.lit(1), half), F.slice(x, half + 1, half), lambda a, b: a.bitwiseXOR(b))


def apart(x: Column, y: Column) -> Column:
    """At least so many shingles are in one set only; sketches of sets whose sizes allow the similarity differ in length by one octave at most."""
    return F.when(F.size(x) == F.size(y), differing(x, y)).when(F.size(x) == 2 * F.size(y), differing(folded(x), y)).when(2 * F.size(x) == F.size(y), differing(x, folded(y))).otherwise(0)


def enough(overlap: Column, n_a: Column, n_b: Column, similarity: float) -> Column:
    """Whether sets of these sizes with this overlap have the similarity: o / (n_a + n_b - o) >= s."""
    return overlap * (1 + similarity) + 1e-9 >= (n_a + n_b) * similarity


def may_be_alike(x: str, y: str, similarity: float) -> Column:
    """Test of rows (n, left) that share a shingle of their prefixes, with ``left`` shingles from there on; sound if it is the first one that
    they share: then all that they share is from there on. Every two alike sets meet at their first one, so nothing is lost if they fail at others."""
    n_x, n_y, i, j = (F.col(f"{r}.{c}") for c in ("n", "left") for r in (x, y))
    return enough(F.least(i, j), n_x, n_y, similarity)


def has_partner(similarity: float) -> Column:
    """Whether a row may be alike one before it or after it, in the order of sizes.

    ``last_n``, ``first_n`` and ``next_n`` are the next smaller, the smallest and the next larger size, ``most_left`` the largest ``left`` before it.
    """
    n, left = F.col("n"), F.col("left")
    smaller = enough(F.col("last_n"), F.col("last_n"), n, similarity) & enough(F.least(left, "most_left"), n, F.col("first_n"), similarity)
    return F.coalesce(smaller, F.lit(False)) | F.coalesce(enough(left, n, F.col("next_n"), similarity), F.lit(False))


def overlap_within(n_x: Column, n_y: Column, d: Column, similarity: float) -> Column:
    """Whether sets that differ in ``d`` shingles at least may have the similarity: they overlap in (n_x + n_y - d) / 2 at most."""
    return enough((n_x + n_y - d) / 2, n_x, n_y, similarity)


def small(side: DataFrame) -> DataFrame:
    """A hint for the small side of a join: broadcast if its size is known to allow it."""
    return F.broadcast(side) if side.count() <= MOST_BROADCAST else side.hint("shuffle_hash")


def jaccard(x: np.ndarray, y: np.ndarray) -> float:
    both = len(np.intersect1d(x, y, assume_unique=True))
    return both / max(len(x) + len(y) - both, 1)


def texts_of(nodes: DataFrame, prints: DataFrame, docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(node, text) of ``nodes``: texts are lighter than sets, and only those that are wanted are moved."""
    wanted = written(nodes.join(prints.select("node", "rep", "key"), "node"), "wanted")
    named = docs.select(F.col(id_col).alias("rep"), row_key(text_col).alias("key"), F.col(text_col).alias("text"))
    return written(named.join(small(wanted), ["rep", "key"]).groupBy("node").agg(F.first("text").alias("text")), "texts")


def alike(pairs: DataFrame, prints: DataFrame, docs: DataFrame, similarity: float, size: int, id_col: str, text_col: str) -> DataFrame:
    """The distinct pairs (a, b) of nodes whose shingle sets have a Jaccard similarity of ``similarity`` or more.

    ``docs`` has one text at least for each (rep, key) of ``prints``.
    """
    of = lambda c: prints.select(F.col("node").alias(c), F.col("n").alias(f"n_{c}"), F.col("sketch").alias(f"s_{c}"))
    may = overlap_within(F.col("n_a"), F.col("n_b"), apart(F.col("s_a"), F.col("s_b")), similarity)
    left = written(pairs.distinct().join(of("a"), "a").join(of("b"), "b").where(may).select("a", "b"), "candidates")
    texts = texts_of(left.select(F.col("a").alias("node")).union(left.select("b")).distinct(), prints, docs, id_col, text_col)
    small_batches(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            # text by text, so that no more than two of them and their sets are held beside the batch
            keep = [jaccard(shingle_set(x.as_py(), size), shingle_set(y.as_py(), size)) >= similarity - 1e-9 for x, y in zip(batch["t_a"], batch["t_b"], strict=True)]
            yield batch.select(["a", "b"]).filter(pa.array(keep, pa.bool_()))

    t = lambda c: texts.select(F.col("node").alias(c), F.col("text").alias(f"t_{c}"))
    return left.join(t("a"), "a").join(t("b"), "b").select("a", "b", "t_a", "t_b").mapInArrow(run, "a bigint, b bigint").distinct()


def ball_pairs(reps: DataFrame, radius: int = RADIUS) -> DataFrame:
    """(a, b): pairs that connect the nodes of ``reps`` (node, fp) whose fingerprints are equal or meet by ball hashing."""
    prints = written(reps.groupBy("fp").agg(F.min("node").alias("rep")), "balls")
    equal = reps.select("fp", "node").join(prints, "fp").where("node <> rep").select(F.col("rep").alias("a"), F.col("node").alias("b"))
    return equal.union(ball_links(prints, radius))


def crowds(met: DataFrame, found: DataFrame, reps: DataFrame) -> DataFrame:
    """The rows of ``met`` (shingle, b) at shingles where more than one component of ``found`` meets; b gets its component and brief sketch.

    ``many`` is how many rows are left at the shingle.
    """
    held = met.select("shingle", "b", F.col("b.node").alias("node")).join(found, "node", "left").select("shingle", "node", "b", F.coalesce("component", "node").alias("of"))
    open_ = held.groupBy("shingle").agg(F.min("of").alias("least"), F.max("of").alias("most"), F.count(F.lit(1)).alias("many")).where("least <> most").select("shingle", "many")
    sketched = held.join(open_, "shingle").join(reps.select("node", "brief"), "node")
    return written(sketched.select("shingle", F.struct("b.node", "b.n", "b.left", "of", "brief").alias("b"), "many"), "held")


def bucket(node: str, salt: int) -> Column:
    """A part of a shingle's rows, so that no task has to look at all of a frequent one; about ``many`` rows are there."""
    return F.pmod(F.xxhash64(node, F.lit(salt)), F.ceil(F.col("many") / BUCKET)).alias("part")


def hub_pairs(crowded: DataFrame, similarity: float) -> DataFrame:
    """(a, b): the row in the middle of each shingle's crowd, with those rows of other components whose sketches allow it.

    Where a crowd is made of copies with a few changes each, most are like the one with the fewest, so one row for each brings them together. The middle
    row has the least sum of differences from a few at random; which one it is decides how many links are found, never whether a link is right.
    """
    drawn = crowded.where(F.pmod(F.xxhash64("b.node", "shingle"), F.greatest(F.lit(1), F.floor(F.col("many") / MEASURES))) == 0)
    measures = drawn.groupBy("shingle").agg(F.collect_list("b.brief").alias("measures"))
    away = F.aggregate("measures", F.lit(0), lambda n, x: n + differing(F.col("b.brief"), x))
    hubs = written(crowded.join(measures, "shingle").groupBy("shingle").agg(F.min_by("b", F.struct(away.alias("away"), "b.node")).alias("a")), "hubs")
    near = overlap_within(F.col("a.n"), F.col("b.n"), differing(F.col("a.brief"), F.col("b.brief")), similarity)
    return crowded.join(hubs, "shingle").where((F.col("a.of") != F.col("b.of")) & near).select("a.node", "b.node")


def size_classes(similarity: float, most: int) -> list[int]:
    """Least sizes of classes so wide that sets of this similarity are in one class or two classes side by side."""
    bounds = [1]
    while bounds[-1] <= most:
        bounds.append(max(bounds[-1] + 1, math.ceil(bounds[-1] / similarity - 1e-9)))
    return bounds


def part_keys(h: np.ndarray, similarity: float) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Keys of a set of hashes; for each the part it belongs to, whether it stands for the whole part, and whether it is one of the next class.

    In a class of sizes up to U, sets of this similarity differ in H = 2 U (1 - s) / (1 + s) elements at most. Of H // 2 + PARTS
    parts of all elements PARTS have then one difference at most each. A part's key is the sum of its elements' hashes, and each element left out
    gives another key, so two such parts share a key, one of them as a whole. A set has the keys of its own class and of the
    next one, where it may be the smaller of two.
    """
    bounds = size_classes(similarity, len(h))
    own = max(i for i, b in enumerate(bounds) if b <= max(len(h), 1))
    bounds, value, out = size_classes(similarity, bounds[-1] * 2), mixed(h, 1), []
    for k in (own, own + 1):
        most = bounds[k + 1] - 1
        n = math.floor(2 * most * (1 - similarity) / (1 + similarity) + 1e-9) // 2 + PARTS
        at = (mixed(h, 2 + k) % np.uint64(n)).astype(np.int64)
        total, place = np.zeros(n, dtype=np.uint64), mixed(np.arange(n, dtype=np.uint64), 1000 + k)
        np.add.at(total, at, value)
        keys = np.concatenate([mixed(total ^ place, 3), mixed((total[at] - value) ^ place[at], 3)])
        out.append((keys.view("<i8"), np.concatenate([np.arange(n), at]), np.arange(len(keys)) < n, np.full(len(keys), k > own)))
    return tuple(np.concatenate(x) for x in zip(*out, strict=True))


def by_parts(nodes: DataFrame, texts: DataFrame, similarity: float, size: int) -> DataFrame:
    """(a, b): pairs of ``nodes`` (node, of) of different components that may be alike: those with PARTS parts in which they share a key.

    Rows grow with the shingles of the nodes. Common passages make two texts meet at many shingles, but seldom leave one part of them
    nearly the same, and hardly ever several, so few pairs come out of a crowd of texts that aren't alike.
    """
    small_batches(nodes.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for node, of, text in zip(*(batch[c].to_pylist() for c in ("node", "of", "text")), strict=True):
                keys, part, whole, upper = part_keys(shingle_set(text, size), similarity)
                tags = 4 * part + 2 * whole + upper
                yield pa.RecordBatch.from_arrays([pa.array(keys), pa.array(tags), pa.array(np.full(len(keys), node)), pa.array(np.full(len(keys), of))], ["key", "tag", "node", "of"])

    rows = written(nodes.join(texts, "node").select("node", "of", "text").mapInArrow(run, "key bigint, tag bigint, node bigint, of bigint"), "parts")
    x, y = (rows.select("key", *(F.col(n).alias(f"{n}_{c}") for n in ("tag", "node", "of"))) for c in "xy")
    either, both = F.col("tag_x").bitwiseOR(F.col("tag_y")), F.col("tag_x").bitwiseAND(F.col("tag_y"))
    met = x.join(y, "key").where((F.col("node_x") < F.col("node_y")) & (F.col("of_x") != F.col("of_y")) & (either.bitwiseAND(F.lit(2)) != 0) & (both.bitwiseAND(F.lit(1)) == 0))
    pairs = met.select(F.col("node_x").alias("a"), F.col("node_y").alias("b"), F.shiftright("tag_x", 2).alias("part")).distinct()
    return pairs.groupBy("a", "b").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= PARTS).select("a", "b")


def comparable(x: str, y: str, similarity: float) -> Column:
    """Whether rows of crowds that share a shingle may be alike and aren't in one component yet."""
    near = overlap_within(F.col(f"{x}.n"), F.col(f"{y}.n"), differing(F.col(f"{x}.brief"), F.col(f"{y}.brief")), similarity)
    return (F.col(f"{x}.of") != F.col(f"{y}.of")) & may_be_alike(x, y, similarity) & near


def similar_groups(docs: DataFrame, similarity: float = SIMILARITY, size: int = WIDE_SHINGLE, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, key, component, kept) for every row of ``docs``, linking texts whose shingle sets have a Jaccard similarity of ``similarity`` or more.

    ``component`` is the smallest id reachable. ``kept`` rows are those with the smallest id, and of its texts the one with the smallest
    ``key``; rows with a null id are kept too. Equal sets are one. Ball hashing of the fingerprints gives the first candidates, decided like all
others by their sets; what it leaves apart is searched by shingles. What meets at a shingle of its prefix, and may be alike by sizes and places, is compared with the
    two next smaller ones there (in its part, where a sample says that the shingle is frequent), then with a few at random, and then with all that these links haven't brought to the same
    component and whose sketches allow it; so no pair is missed. Where more than TILE rows are left at a shingle, they aren't paired there: they
    are compared with the one in their middle (``hub_pairs``), and what that leaves in several components meets by parts of the whole sets (``by_parts``).
    """
    common, counts = common_shingles(docs, size, id_col, text_col)
    fields = "d0 bigint, d1 bigint, n bigint, brief array<bigint>, sketch array<bigint>, prefix array<bigint>, fp bigint"
    seen = written(map_texts(docs.withColumn("__key", row_key(text_col)), [id_col, "__key"], text_col, lambda text: set_columns(text, size, similarity, common, counts), fields).withColumnRenamed("__key", "key"), "sets")
    same, fp, least = F.first(F.struct("n", "brief", "sketch", "prefix")).alias("of"), F.min("fp").alias("fp"), F.min(F.when(F.col(id_col).isNotNull(), F.struct(F.col(id_col).alias("rep"), "key"))).alias("least")
    prints = written(seen.groupBy("d0", "d1").agg(least, same, fp).select("d0", "d1", "least.*", "of.*", "fp", F.monotonically_increasing_id().alias("node")), "prints")
    reps = prints.where("rep is not null")
    decided = lambda pairs: written(alike(pairs.toDF("a", "b"), reps, docs, similarity, size, id_col, text_col), "alike")
    rows = reps.select("node", "n", F.posexplode("prefix").alias("at", "shingle")).select("shingle", "node", "n", (F.col("n") - F.col("at")).alias("left"))
    often = docs.sparkSession.createDataFrame(pa.table({"shingle": common.view("<i8"), "many": counts * SAMPLE}).filter(counts * SAMPLE > BUCKET))
    # plain columns in the windows: expressions in them would be shuffled too
    parted = rows.join(F.broadcast(often), "shingle", "left").withColumn("part", F.when(F.col("many").isNotNull(), bucket("node", 0))).drop("many")
    w = Window.partitionBy("shingle", "part").orderBy("n", "node")
    before = w.rowsBetween(Window.unboundedPreceding, -1)
    lags = [F.lag(c, k).over(w).alias(f"{name}_{c}") for k, name in ((1, "last"), (2, "second")) for c in ("node", "n", "left")]
    met = parted.select("shingle", "node", "n", "left", "part", *lags, F.first("n").over(before).alias("first_n"), F.max("left").over(before).alias("most_left"), F.lead("n").over(w).alias("next_n"))
    # rows without a partner in their part stay, if there are other parts
    of = lambda name="": F.struct(*(F.col(f"{name}{c}").alias(c) for c in ("node", "n", "left")))
    met = met.where(has_partner(similarity) | F.col("part").isNotNull()).select("shingle", of().alias("b"), *(F.when(F.col(f"{k}_node").isNotNull(), of(f"{k}_")).alias(k) for k in ("last", "second")))
    met = written(met, "met")
    near = met.select("b", F.explode(F.array_compact(F.array("last", "second"))).alias("a")).where(may_be_alike("a", "b", similarity))
    links = decided(ball_pairs(reps).union(near.select("a.node", "b.node")))
    # then a few neighbours in a random order, and then all, where what meets isn't in one component yet
    held = crowds(met.select("shingle", "b"), components(links), reps)
    w = Window.partitionBy("shingle", "part").orderBy(F.xxhash64("b.node", "shingle"))
    beside = held.withColumn("part", bucket("b.node", 1)).select("b", F.array(*(F.lag("b", k).over(w) for k in range(1, NEIGHBOURS + 1))).alias("before"))
    some = beside.select("b", F.explode("before").alias("a")).where(comparable("a", "b", similarity))
    links = links.union(decided(some.select("a.node", "b.node")))
    held = crowds(held.select("shingle", "b"), components(links), reps)
    crowded = held.where(F.col("many") > TILE)
    if not crowded.isEmpty():
        links = links.union(decided(hub_pairs(crowded, similarity)))
        held = crowds(held.select("shingle", "b"), components(links), reps)
    few, crowded = held.where(F.col("many") <= TILE), held.where(F.col("many") > TILE)
    x, y = few.select("shingle", F.col("b").alias("x")), few.select("shingle", F.col("b").alias("y"))
    rest = x.join(y, "shingle").where(F.col("x.node") < F.col("y.node")).where(comparable("x", "y", similarity)).select(F.col("x.node").alias("a"), F.col("y.node").alias("b"))
    nodes = written(crowded.select("b.node", "b.of").distinct(), "crowd")
    if not nodes.isEmpty():
        rest = rest.union(by_parts(nodes, texts_of(nodes.select("node"), reps, docs, id_col, text_col), similarity, size))
    found = components(links.union(decided(rest)))
    tops = written(prints.join(found, "node", "left").select("d0", "d1", F.struct("rep", "key").alias("row"), F.coalesce("component", "node").alias("top")), "tops")
    named = written(tops.join(tops.where("row.rep is not null").groupBy("top").agg(F.min("row").alias("least")), "top", "left").select("d0", "d1", "least"), "named")
    kept = F.coalesce((F.col(id_col) == F.col("least.rep")) & (F.col("key") == F.col("least.key")), F.lit(True))
    return seen.select(id_col, "key", "d0", "d1").join(named, ["d0", "d1"]).select(id_col, "key", F.col("least.rep").alias("component"), kept.alias("kept"))


def one_of_each(docs: DataFrame, groups: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The ``kept`` rows of ``docs``, once each; rows with a null id stay.

    Of rows that repeat both id and text, the one whose columns come first as a string stays. What goes is the small side of an anti
    join, so texts are shuffled only where it is too large to broadcast, and never sorted.
    """
    held = written(groups.where(F.col(id_col).isNotNull()).groupBy(F.col(id_col).alias("__id"), F.col("key").alias("__key")).agg(F.min("kept").alias("kept"), F.count(F.lit(1)).alias("n")), "held")
    gone, again = held.where("not kept").select("__id", "__key"), held.where("kept and n > 1").select("__id", "__key")
    names, keyed = docs.columns, docs.withColumns({"__id": F.col(id_col), "__key": row_key(text_col)})

    left = keyed.join(small(gone), ["__id", "__key"], "left_anti")
    if again.isEmpty():
        return left.select(*names)
    once = left.join(small(again), ["__id", "__key"], "left_anti").select(*names)
    row = F.struct(*(F.col(c) for c in names))
    first = left.join(small(again), ["__id", "__key"], "left_semi").groupBy("__id", "__key").agg(F.min_by(row, row.cast("string")).alias("row")).select("row.*")
    return once.union(first)


def op2_simhash_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    g = simhash_groups(table(spark, sf_dir, "documents"))
    return g.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), F.col("component").alias("component_id"))
