"""Embedding near-dedup: randomly rotated binary codes with stored correction factors.

Equal vectors are one first, with their number. Unit vectors are filed in the cell of their nearest centre; the centres are
fitted on a bounded sample (SAMPLE vectors, or two a cell) and every vector is indexed. A vector's code holds the signs of its rotated
residual from the centre, one bit a dimension, and the factor <code, residual> that makes estimated inner products unbiased. Each
vector then visits its PROBES nearest cells as a query. For each pair in a cell the estimate and its confidence bound decide: pairs
whose upper bound is below the threshold are dropped, all others are recomputed exactly in double precision from the vectors,
so no link below the threshold is reported.

Pairs never leave a cell. A cell is cut into tiles of at most HOMES x VISITORS vectors whatever its size, and a tile returns one
count for each vector and a spanning forest of its links. A pair that both sides would find in the other's cell is counted
on each side once; one that only one side finds is counted for both.

Edge cases: vectors that are null, empty, zero, or hold null or non-finite components link with nothing, nor do vectors of
different lengths or rows with a null id; rows that repeat an id are vectors of their own. Other columns are ignored.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from assayloom.llm._shared import table, written
from assayloom.llm.components import components

THRESHOLD, SAMPLE, PER_CELL, MOST_CELLS, PROBES = 0.9, 16_384, 64, 32_768, 32
HOMES, VISITORS, PAIRS = 1_024, 4_096, 65_536
#: Width of the confidence bound in units of the estimate's deviation.
WIDTH = 3.0
SEED = 42


def unit(rows: list | np.ndarray) -> np.ndarray:
    """Rows scaled to length one in double precision; scaled by the largest component first, so squares don't overflow."""
    x = np.asarray(rows, dtype=np.float64)
    x = x / np.abs(x).max(axis=1, keepdims=True)
    return x / np.linalg.norm(x, axis=1, keepdims=True)


class Index:
    """Centres and rotation for one vector length."""

    def __init__(self, sample: np.ndarray, cells: int):
        rng = np.random.default_rng(SEED)
        d = sample.shape[1]
        self.rotation = np.linalg.qr(rng.standard_normal((d, d)))[0].astype(np.float32)
        x = sample.astype(np.float32)
        # far-apart seeds: a dense group of near copies gets one centre, not a share by its size
        far, seeds = np.full(len(x), 2.0, dtype=np.float64), []
        for _ in range(min(cells, len(x))):
            weight = far**4
            if weight.sum() <= 1e-12:
                break
            seeds.append(int(rng.choice(len(x), p=weight / weight.sum())))
            far = np.minimum(far, np.maximum(0, 2 - 2 * (x @ x[seeds[-1]])))
        c = x[seeds]
        for _ in range(2):
            near = np.argmax(x @ c.T, axis=1)
            sums = np.zeros_like(c)
            np.add.at(sums, near, x)
            size = np.linalg.norm(sums, axis=1, keepdims=True)
            c = np.where(size > 1e-6, sums / np.maximum(size, 1e-6), c)
        self.centres = c.astype(np.float32)

    def nearest(self, x: np.ndarray, probes: int) -> np.ndarray:
        """The nearest cells of each row, nearest first."""
        s = x.astype(np.float32) @ self.centres.T
        n = min(probes, s.shape[1])
        top = np.argpartition(-s, n - 1, axis=1)[:, :n]
        return np.take_along_axis(top, np.argsort(-np.take_along_axis(s, top, 1), axis=1, kind="stable"), 1)

    def residual(self, x: np.ndarray, centre: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Rotated residuals of length one, and their lengths before."""
        r = (x.astype(np.float32) - centre) @ self.rotation.T
        size = np.linalg.norm(r, axis=1)
        return r / np.maximum(size, 1e-12)[:, None], size

    def codes(self, x: np.ndarray, home: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Sign bits, correction factor and length of the residual from the home centre."""
        r, size = self.residual(x, self.centres[home])
        return np.packbits(r > 0, axis=1), np.abs(r).sum(axis=1) / np.sqrt(r.shape[1]), size


def upper_bounds(index: Index, cell: int, q: np.ndarray, y: np.ndarray, bits: np.ndarray, factor: np.ndarray, size: np.ndarray, width: float = WIDTH) -> tuple[np.ndarray, np.ndarray]:
    """Estimated cosines of queries q with the coded vectors y of a cell, and their upper confidence bounds."""
    c, d = index.centres[cell], q.shape[1]
    r, length = index.residual(q, c)
    signs = (np.unpackbits(bits, axis=1, count=d).astype(np.float32) * 2 - 1) / np.sqrt(d)
    f = np.maximum(factor, 1e-6)
    scale = length[:, None] * size[None, :]
    estimate = (r @ signs.T) / f * scale + (q.astype(np.float32) @ c)[:, None] + (y.astype(np.float32) @ c)[None, :] - c @ c
    off = np.sqrt(np.maximum(0, 1 - f * f)) / f / np.sqrt(max(d - 1, 1))
    return estimate, estimate + width * off * scale + 1e-4


def forest(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Links that connect what the pairs (a, b) connect: at most one for each node."""
    nodes, where = np.unique(np.concatenate([a, b]), return_inverse=True)
    i, j = where[: len(a)], where[len(a) :]
    label = np.arange(len(nodes))
    while True:
        before = label.copy()
        low = np.minimum(label[i], label[j])
        np.minimum.at(label, label[i], low)
        np.minimum.at(label, label[j], low)
        np.minimum.at(label, i, low)
        np.minimum.at(label, j, low)
        while not np.array_equal(label, label[label]):
            label = label[label]
        if np.array_equal(label, before):
            moved = label != np.arange(len(nodes))
            return nodes[moved], nodes[label[moved]]


def tile(index: Index, cell: int, homes: pd.DataFrame, visitors: pd.DataFrame, threshold: float) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(ids, counts) and links (a, b) of a tile."""
    kind = np.float32 if len(homes["vec"].iloc[0]) == 4 * index.centres.shape[1] else np.float64
    y, x = (unit(np.frombuffer(b"".join(t["vec"]), dtype=kind).reshape(len(t), -1)) for t in (homes, visitors))
    bits = np.frombuffer(b"".join(homes["code"]), dtype=np.uint8).reshape(len(homes), -1)
    _, upper = upper_bounds(index, cell, x, y, bits, homes["factor"].to_numpy(np.float32), homes["size"].to_numpy(np.float32))
    hid, vid = homes["rep"].to_numpy(), visitors["rep"].to_numpy()
    i, j = np.nonzero((upper >= threshold) & (vid[:, None] != hid[None, :]))
    exact = np.concatenate([np.einsum("ij,ij->i", x[i[k : k + PAIRS]], y[j[k : k + PAIRS]]) for k in range(0, len(i), PAIRS)] or [np.empty(0)])
    i, j = i[exact >= threshold], j[exact >= threshold]
    hn, vn = homes["n"].to_numpy(), visitors["n"].to_numpy()
    probes, vhome = np.stack(homes["probes"].to_list()) if len(i) else np.empty((0, 0)), visitors["home"].to_numpy()
    alone = np.concatenate([~(probes[j[k : k + PAIRS]] == vhome[i[k : k + PAIRS], None]).any(axis=1) for k in range(0, len(i), PAIRS)] or [np.empty(0, bool)])
    ids, at = np.unique(np.concatenate([vid[i], hid[j[alone]]]), return_inverse=True)
    counts = np.zeros(len(ids), dtype=np.int64)
    np.add.at(counts, at, np.concatenate([hn[j], vn[i[alone]]]))
    a, b = forest(vid[i], hid[j]) if len(i) else (vid[:0], vid[:0])
    return ids, counts, a, b


def is_vector(col: str):
    """Whether a vector can link at all."""
    bad = F.exists(col, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    return F.coalesce((F.size(col) > 0) & ~bad & F.exists(col, lambda x: x != 0), F.lit(False))


def embedding_groups(vectors: DataFrame, threshold: float = THRESHOLD, id_col: str = "vec_id", vec_col: str = "embedding") -> DataFrame:
    """(id, n_links, component) for every row of ``vectors``."""
    spark = vectors.sparkSession
    src = vectors.select(F.col(id_col).cast("long").alias("id"), F.col(vec_col).alias("vec"))
    fit = F.col("id").isNotNull() & is_vector("vec")
    good = src.where(fit)
    kind = "<f4" if "float" in src.schema["vec"].dataType.simpleString() else "<f8"
    good = good if kind == "<f4" else good.withColumn("vec", F.col("vec").cast("array<double>"))
    once = written(good.groupBy("vec").agg(F.min("id").alias("rep"), F.count(F.lit(1)).alias("n")), "vectors")

    cells = min(-(-once.count() // PER_CELL), MOST_CELLS)
    sample = once.orderBy(F.xxhash64("rep")).limit(max(SAMPLE, 2 * cells)).select("vec").toArrow().column("vec").to_pylist()
    by_size: dict[int, list] = {}
    for v in sample:
        by_size.setdefault(len(v), []).append(v)
    indexes = spark.sparkContext.broadcast({d: Index(unit(v), max(1, cells * len(v) // len(sample))) for d, v in by_size.items()})

    def filed(batches):
        for b in batches:
            t = b.to_pandas()
            for d, part in t.groupby(t["vec"].map(len)):
                d = int(d)
                index = indexes.value.get(d) or Index(np.eye(1, d), 1)
                for at in range(0, len(part), 1024):
                    p = part.iloc[at : at + 1024]
                    raw = np.stack(p["vec"].to_list()).astype(kind)
                    x = unit(raw)
                    near = index.nearest(x, PROBES)
                    bits, factor, size = index.codes(x, near[:, 0])
                    columns = [p["rep"].to_numpy(), p["n"].to_numpy(), np.full(len(p), d, np.int32), [v.tobytes() for v in raw], [v.tobytes() for v in bits], factor.astype(np.float32), size.astype(np.float32), near.astype(np.int32).tolist()]
                    kinds = [pa.int64(), pa.int64(), pa.int32(), pa.binary(), pa.binary(), pa.float32(), pa.float32(), pa.list_(pa.int32())]
                    yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], ["rep", "n", "d", "vec", "code", "factor", "size", "probes"])

    index_rows = written(once.mapInArrow(filed, "rep bigint, n bigint, d int, vec binary, code binary, factor float, size float, probes array<int>"), "index")
    # a row for each cell: bounded by the number of cells
    home, visit = F.col("probes")[0], F.explode("probes")
    sizes = index_rows.select("d", visit.alias("cell"), home.alias("home")).groupBy("d", "cell").agg(F.sum((F.col("cell") == F.col("home")).cast("long")).alias("h"), F.count(F.lit(1)).alias("v"))
    cuts = F.broadcast(sizes.where("h > 0").select("d", "cell", F.ceil(F.col("h") / HOMES).cast("int").alias("nh"), F.ceil(F.col("v") / VISITORS).cast("int").alias("nv")))
    none = F.lit(None)
    residents = index_rows.withColumn("cell", home).join(cuts, ["d", "cell"]).select(
        "d", "cell", F.pmod(F.xxhash64("rep"), "nh").cast("int").alias("hb"), F.explode(F.sequence(F.lit(0), F.col("nv") - 1)).alias("vb"), F.lit(True).alias("resident"), "rep", "n", "vec", "code", "factor", "size", "probes", home.alias("home")
    )
    guests = index_rows.select("d", visit.alias("cell"), "rep", "n", "vec", home.alias("home")).join(cuts, ["d", "cell"]).select(
        "d", "cell", F.explode(F.sequence(F.lit(0), F.col("nh") - 1)).alias("hb"), F.pmod(F.xxhash64("rep", F.lit(1)), "nv").cast("int").alias("vb"), F.lit(False).alias("resident"), "rep", "n", "vec",
        none.cast("binary").alias("code"), none.cast("float").alias("factor"), none.cast("float").alias("size"), none.cast("array<int>").alias("probes"), "home",
    )

    def one_tile(t: pa.Table) -> pa.Table:
        p = t.to_pandas()
        here = p["resident"].to_numpy(bool)
        d, cell = int(p["d"].iloc[0]), int(p["cell"].iloc[0])
        empty = np.empty(0, np.int64)
        ids, counts, a, b = tile(indexes.value.get(d) or Index(np.eye(1, d), 1), cell, p[here], p[~here], threshold) if here.any() and not here.all() else (empty,) * 4
        return pa.table({"link": np.repeat([False, True], [len(ids), len(a)]), "a": np.concatenate([ids, a]).astype(np.int64), "b": np.concatenate([counts, b]).astype(np.int64)})

    found = written(residents.union(guests).groupBy("d", "cell", "hb", "vb").applyInArrow(one_tile, "link boolean, a bigint, b bigint"), "tiles")
    counts = found.where("not link").groupBy("a").agg(F.sum("b").alias("links")).withColumnRenamed("a", "rep")
    groups = components(found.where("link").select("a", "b")).withColumnRenamed("node", "rep")
    named = written(
        once.join(counts, "rep", "left").join(groups, "rep", "left").select("vec", (F.coalesce("links", F.lit(0)) + F.col("n") - 1).cast("long").alias("n_links"), F.coalesce("component", "rep").alias("component")), "named"
    )
    linked = good.join(named, "vec").select(F.col("id").alias(id_col), "n_links", "component")
    return linked.union(src.where(~fit).select(F.col("id").alias(id_col), F.lit(0).cast("long").alias("n_links"), F.col("id").alias("component")))


def op4_embedding_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    g = embedding_groups(table(spark, sf_dir, "embeddings"))
    return g.select("vec_id", "n_links", F.col("component").alias("component_id"), F.coalesce(F.col("vec_id") == F.col("component"), F.lit(True)).alias("kept"))
