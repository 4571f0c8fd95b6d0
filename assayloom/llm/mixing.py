"""Mixing sources to target weights: soft membership.

A softmax classifier, fitted on at most SAMPLE labelled rows, gives every document posteriors over the domains good, poor and
toxic. A document belongs to all of them by its posteriors, and its tokens count for each. Rates in [0, MOST] are then fitted by
projected gradient least squares so that the expected token totals of the domains meet the targets, staying as near to rate 1 as
they can:

    least squares of totals and targets, in the metric of the second moments, + nearness * sum of tokens * (rate - 1)^2

A gradient step moves every rate along its document's posteriors, so the steps of all documents add up in one vector of a number a
domain, and the projection on [0, MOST] is taken where a rate is evaluated: rates are never stored or collected. Steps are scaled
by the moments of the documents whose rate is free and halved where they would not improve. The first steps run on a
histogram of the posteriors (at most GRID * GRID cells with exact sums, whatever the corpus); the last on all rows, until
the gradient vanishes.

Targets that no rates reach without giving up the corpus - where a domain's tokens are mostly small doubts about good documents -
are met as far as distinct tokens allow: the smallest nearness of NEARNESS that leaves LEAST_KEPT of the first domain's
distinct tokens is taken. ``fit_rates`` returns targets and totals reached; both are logged.

Tokens are white-space words here. Edge cases: a null or blank text has 0 tokens, the prior as posteriors and a rate like others;
without labels every document is good; a domain without documents keeps its total at 0; rows that repeat an id get
copies by the same draw; a null id is drawn like the id 0; labelled rows that repeat a text count each. Other columns are ignored
or, in ``mixed``, kept.
"""

from __future__ import annotations

import logging
import re
from collections.abc import Callable
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from assayloom.llm._shared import SLICE, map_texts, small_batches, table, written

DOMAINS = ("good", "poor", "toxic")
#: Token shares to reach. The total is set so that the first domain's tokens stay as many as they are.
WEIGHTS = (0.94, 0.05, 0.01)
SAMPLE, WORDS, LEAST_DOCS = 6_000, 20_000, 4
#: Least chi-square of a word's counts over the domains for it to be a feature.
CHI = 20.0
STEPS, CLOSE, SEED = 100, 1e-7, 42
#: Most copies of a document; bins of a posterior in the histogram.
MOST, GRID = 3.0, 128
#: Weights of staying near rate 1, in the order they are tried; share of the first domain's tokens to keep, not counting repeats.
NEARNESS, LEAST_KEPT = tuple(10.0**k for k in range(-6, 4)), 0.8
EDGES = " \t\n\x0b\x0c\r.,;:!?\"'()[]|*#$%&<>-"
UPPER_RUN = re.compile(r"[A-Z]{2,}")


def features(text: str | None) -> tuple[set[str], list[float], int]:
    """Distinct words, shape of the text, and tokens."""
    text = text or ""
    words = text.split()
    n, size = len(words), max(len(text), 1)
    bare = {w.strip(EDGES).lower() for w in words}
    bare.discard("")
    shape = [
        min(sum(map(text.count, "#*$%&|<>")) / max(n, 1), 2.0),
        1 - len(set(words)) / max(n, 1),
        len(UPPER_RUN.findall(text)) / max(n, 1),
        text.count("!") / max(n, 1),
        sum(map(text.count, "0123456789")) / size,
        min(np.log1p(n) / 10, 1.5),
        1.0 if n < 20 else 0.0,
        text.count("\n") / max(n, 1),
    ]
    return bare, shape, n


@dataclass
class Classifier:
    """Softmax regression over words of a vocabulary (there or not) and shape features."""

    vocabulary: dict[str, int] = field(default_factory=dict)
    weights: np.ndarray | None = None  # (vocabulary, domains)
    shape: np.ndarray | None = None  # (features + 1, domains)

    def posteriors(self, text: str | None) -> tuple[np.ndarray, int]:
        bare, shape, n = features(text)
        if self.weights is None:
            return np.eye(len(DOMAINS))[0], n
        find = self.vocabulary.get
        at = [i for w in bare if (i := find(w)) is not None]
        z = np.array([*shape, 1.0]) @ self.shape + (self.weights[at].sum(axis=0) if at else 0.0)
        e = np.exp(z - z.max())
        return e / e.sum(), n

    @staticmethod
    def fit(vocabulary: list[str], rows: list[tuple[list[int], list[float], int, int]], rounds: int = 200, rate: float = 0.05, decay: float = 2e-4) -> Classifier:
        """``rows``: word numbers, shape, domain, times. Full-batch Adam."""
        if not rows:
            return Classifier()
        k = len(DOMAINS)
        row = np.repeat(np.arange(len(rows)), [len(r[0]) for r in rows])
        word = np.concatenate([np.asarray(r[0], dtype=np.int64) for r in rows] or [np.empty(0, np.int64)])
        x = np.column_stack([np.array([r[1] for r in rows], dtype=float), np.ones(len(rows))])
        y = np.eye(k)[[r[2] for r in rows]]
        times = np.array([r[3] for r in rows], dtype=float)
        share = times[:, None] / times.sum()
        # only words whose share differs between the domains beyond chance: the rest is noise to learn by heart
        seen = np.array([np.bincount(word, times[row] * y[row, c], len(vocabulary)) for c in range(k)])
        expected = seen.sum(axis=0) * (share * y).sum(axis=0)[:, None]
        chi = np.where(expected > 0, (seen - expected) ** 2 / np.maximum(expected, 1e-9), 0).sum(axis=0)
        telling = np.flatnonzero(chi > CHI)
        place = np.full(len(vocabulary) + 1, -1)
        place[telling] = np.arange(len(telling))
        row, word = row[place[word] >= 0], place[word][place[word] >= 0]
        vocabulary, v = [vocabulary[i] for i in telling], max(len(telling), 1)
        params = [np.zeros((v, k)), np.zeros((x.shape[1], k))]
        first, second = ([np.zeros_like(p) for p in params] for _ in range(2))
        for t in range(1, rounds + 1):
            sums = np.column_stack([np.bincount(row, params[0][word, c], len(rows)) for c in range(k)])
            z = x @ params[1] + sums
            e = np.exp(z - z.max(axis=1, keepdims=True))
            off = (e / e.sum(axis=1, keepdims=True) - y) * share
            grads = [np.column_stack([np.bincount(word, off[row, c], v) for c in range(k)]) + decay * params[0], x.T @ off]
            for p, g, a, b in zip(params, grads, first, second, strict=True):
                a += 0.1 * (g - a)
                b += 0.001 * (g * g - b)
                p -= rate * (a / (1 - 0.9**t)) / (np.sqrt(b / (1 - 0.999**t)) + 1e-8)
        return Classifier({w: i for i, w in enumerate(vocabulary)}, params[0], params[1])


def domain_of() -> Column:
    """The number of a labelled row's domain."""
    return F.when(F.coalesce("toxic", F.lit(0)) == 1, 2).when(F.coalesce("quality", F.lit(1)) == 0, 1).otherwise(0)


def fitted(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE, id_col: str = "doc_id", text_col: str = "text") -> Classifier:
    """A classifier from at most ``sample`` labelled rows, chosen by a hash of the id."""
    some = labels.where("doc_id is not null and (quality is not null or toxic is not null)").groupBy("doc_id").agg(F.max(domain_of()).alias("domain")).orderBy(F.xxhash64("doc_id", F.lit(SEED)), "doc_id").limit(sample)
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text")).join(F.broadcast(some), "doc_id").select("text", "domain")

    def seen(batches):
        for b in batches:
            for i in range(0, b.num_rows, SLICE):
                part = b.slice(i, SLICE)
                f = [features(t) for t in part.column(0).to_pylist()]
                yield pa.RecordBatch.from_arrays([pa.array([sorted(x[0]) for x in f], pa.list_(pa.string())), pa.array([x[1] for x in f], pa.list_(pa.float64())), part.column(1)], ["words", "shape", "domain"])

    got = written(rows.mapInArrow(seen, "words array<string>, shape array<double>, domain int"), "labelled")
    common = got.select(F.explode("words").alias("word")).groupBy("word").count().where(F.col("count") >= LEAST_DOCS).orderBy(F.desc("count"), "word").limit(WORDS)
    vocabulary = [r["word"] for r in common.select("word").collect()]
    number = F.broadcast(common.sparkSession.createDataFrame([(w, i) for i, w in enumerate(vocabulary)], "word string, i int"))
    keyed = got.select(F.xxhash64("words", "shape").alias("row"), "words", "shape", "domain")
    numbered = keyed.select("row", "domain", "shape", F.explode_outer("words").alias("word")).join(number, "word", "left").groupBy("row", "domain", "shape").agg(F.sort_array(F.collect_set("i")).alias("at"))
    times = keyed.groupBy("row", "domain").count()
    data = sorted((r["row"], r["domain"], list(r["at"]), list(r["shape"]), r["count"]) for r in numbered.join(times, ["row", "domain"]).collect())
    return Classifier.fit(vocabulary, [(at, shape, d, n) for _, d, at, shape, n in data])


def memberships(docs: DataFrame, model: Classifier, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, n_tokens, p0, p1, p2) for every row."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def row(text: str | None) -> tuple:
        p, n = shared.value.posteriors(text)
        return (n, *map(float, p))

    return map_texts(docs, id_col, text_col, row, "n_tokens bigint, " + ", ".join(f"p{k} double" for k in range(len(DOMAINS))))


def score(y: np.ndarray) -> Column:
    """What the steps, added up in ``y``, add to the rate of a document with posteriors p0, p1, p2.

    ``y`` is one array: single numbers become part of the code that Spark compiles, and executors would gather classes for each step.
    """
    p = F.array(*(F.col(f"p{k}") for k in range(len(y))))
    return F.aggregate(F.zip_with(p, F.lit([float(v) for v in y]), lambda a, b: a * b), F.lit(0.0), lambda s, x: s + x)


def rate(y: np.ndarray) -> Column:
    """A document's rate, from its posteriors."""
    return F.least(F.lit(MOST), F.greatest(F.lit(0.0), 1.0 + score(y)))


@dataclass
class Sums:
    """What a step needs to know of all documents at one ``y``."""

    totals: np.ndarray  # expected tokens by domain
    moments: np.ndarray  # second moments of the documents whose rate is free
    energy: float  # the tokens' part of the objective (of its dual)
    kept: float  # distinct tokens of the first domain


def sums_of_rows(members: DataFrame, y: np.ndarray) -> Sums:
    """One aggregation over all rows."""
    ks, n, s, top = range(len(y)), F.col("n_tokens"), F.col("__s"), MOST - 1
    free = F.when((s > -1) & (s < top), n).otherwise(0)
    energy = F.when(s < -1, F.lit(-0.5)).when(s > top, MOST * s - top * top / 2).otherwise(s + s * s / 2)
    row = (
        members.withColumn("__s", score(y))
        .withColumn("__r", rate(y))
        .agg(
            *(F.sum(n * F.col(f"p{i}") * F.col("__r")).alias(f"t{i}") for i in ks),
            *(F.sum(free * F.col(f"p{i}") * F.col(f"p{j}")).alias(f"m{i}{j}") for i in ks for j in ks),
            F.sum(n * energy).alias("energy"),
            F.sum(n * F.col("p0") * F.least(F.lit(1.0), "__r")).alias("kept"),
        )
        .first()
    )
    return Sums(np.array([row[f"t{i}"] or 0.0 for i in ks]), np.array([[row[f"m{i}{j}"] or 0.0 for j in ks] for i in ks]), row["energy"] or 0.0, row["kept"] or 0.0)


def sums_of_cells(n: np.ndarray, p: np.ndarray, y: np.ndarray) -> Sums:
    """The same of cells with tokens ``n`` and mean posteriors ``p``."""
    s, top = p @ y, MOST - 1
    r = np.clip(1 + s, 0, MOST)
    energy = np.where(s < -1, -0.5, np.where(s > top, MOST * s - top * top / 2, s + s * s / 2))
    return Sums((n * r) @ p, (p * (n * ((s > -1) & (s < top)))[:, None]).T @ p, float(n @ energy), float((n * np.minimum(r, 1)) @ p[:, 0]))


def cells(members: DataFrame, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Tokens and mean posteriors of the histogram's cells; finer bins near 0, where doubts about good documents lie."""
    bins = [F.floor(F.sqrt(f"p{i}") * (GRID - 1)).cast("int").alias(f"b{i}") for i in range(1, k)]
    n = F.col("n_tokens")
    rows = members.where("n_tokens > 0").groupBy(*bins).agg(F.sum(n).cast("double").alias("n"), *(F.sum(n * F.col(f"p{i}")).alias(f"p{i}") for i in range(k))).drop(*(f"b{i}" for i in range(1, k))).collect()
    table = np.array([tuple(r) for r in rows], dtype=float).reshape(len(rows), k + 1)
    return table[:, 0], table[:, 1:] / table[:, :1]


def descend(sums: Callable[[np.ndarray], Sums], y: np.ndarray, goal: np.ndarray, whole: np.ndarray, nearness: float, most: int = STEPS) -> tuple[np.ndarray, Sums]:
    """Gradient steps from ``y`` until the gradient of the least squares with ``nearness`` vanishes; ``whole``: moments of all documents."""
    value = lambda y, s: s.energy + nearness / 2 * y @ whole @ y - y @ goal
    now = sums(y)
    for _ in range(most):
        gradient = goal - now.totals - nearness * whole @ y
        if np.abs(gradient).max() <= CLOSE * max(goal.sum(), 1.0):
            break
        step, least = np.linalg.pinv(now.moments + nearness * whole, rcond=1e-12) @ gradient, value(y, now)
        size = 1.0
        while (size := size / 2) > 1e-6:
            then = sums(y + 2 * size * step)
            if value(y + 2 * size * step, then) <= least + 1e-10 * abs(least):
                break
        else:
            break
        y, now = y + 2 * size * step, then
    return y, now


def fit_rates(members: DataFrame, weights=WEIGHTS, least_kept: float = LEAST_KEPT) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The sum of the steps, the targets, and the expected totals reached, of a written table of memberships."""
    k, zero = len(weights), np.zeros(len(weights))
    start = sums_of_rows(members, zero)
    goal = np.asarray(weights) / weights[0] * start.totals[0]
    goal[start.totals <= 0] = 0.0
    n, p = cells(members, k)
    y = zero
    for nearness in NEARNESS:
        y, there = descend(lambda y: sums_of_cells(n, p, y), zero, goal, start.moments, nearness)
        if there.kept >= least_kept * start.totals[0]:
            break
    y, there = descend(lambda y: sums_of_rows(members, y), y, goal, start.moments, nearness)
    logging.getLogger(__name__).info("mixing: targets %s, totals before %s, reached %s with nearness %g", goal.round(), start.totals.round(), there.totals.round(), nearness)
    return y, goal, there.totals


def copies(id_col: str) -> Column:
    """The rate rounded up or down at random, by a hash of the id, so that its mean is the rate."""
    u = F.pmod(F.xxhash64(F.coalesce(F.col(id_col), F.lit(0)), F.lit(SEED)), F.lit(1 << 53)) / float(1 << 53)
    return F.floor(F.col("rate") + u).cast("long")


def mixing(docs: DataFrame, labels: DataFrame, weights=WEIGHTS, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Posteriors, rate and number of copies of every row."""
    members = written(memberships(docs, fitted(docs, labels, id_col=id_col, text_col=text_col), id_col, text_col), "members")
    y, _, _ = fit_rates(members, weights)
    best = F.greatest(*(F.col(f"p{k}") for k in range(len(DOMAINS))))
    domain = F.when(F.col("p2") == best, DOMAINS[2]).when(F.col("p1") == best, DOMAINS[1]).otherwise(DOMAINS[0])
    out = members.select(id_col, "n_tokens", *(F.col(f"p{k}").alias(f"p_{d}") for k, d in enumerate(DOMAINS)), domain.alias("domain"), rate(y).alias("rate"))
    return out.withColumn("copies", copies(id_col))


def mixed(docs: DataFrame, labels: DataFrame, weights=WEIGHTS, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` with each row as often as its number of copies; columns as they are.

    Rows are written once with their memberships beside them: the fit reads only those, and texts are never shuffled.
    """
    model = docs.sparkSession.sparkContext.broadcast(fitted(docs, labels, id_col=id_col, text_col=text_col))
    names, at, ks = docs.columns, docs.columns.index(text_col), range(len(DOMAINS))
    clear = [f"__c{i}" for i in range(len(names))]  # whatever the columns are called
    extra = ["n_tokens", *(f"p{k}" for k in ks)]

    def run(batches):
        for whole in batches:
            for i in range(0, whole.num_rows, SLICE):
                b = whole.slice(i, SLICE)
                found = [model.value.posteriors(t) for t in b.column(at).to_pylist()]
                yield pa.RecordBatch.from_arrays([*b.columns, pa.array([n for _, n in found], pa.int64()), *(pa.array([float(p[k]) for p, _ in found], pa.float64()) for k in ks)], [*clear, *extra])

    schema = ", ".join(f"{c} {f.dataType.simpleString()}" for c, f in zip(clear, docs.schema, strict=True)) + ", n_tokens bigint, " + ", ".join(f"p{k} double" for k in ks)
    small_batches(docs.sparkSession)
    members = written(docs.toDF(*clear).mapInArrow(run, schema), "members")
    y, _, _ = fit_rates(members, weights)
    times = members.withColumn("rate", rate(y)).withColumn("n", copies(clear[names.index(id_col)])).where("n > 0")
    return times.select(*clear, F.explode(F.sequence(F.lit(1).cast("long"), "n")).alias("__copy")).select(*clear).toDF(*names)


def op6_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
