"""Quality classifier: a sparse ensemble of rules over statistics of the whole text.

Statistics are Spark columns. A forest of shallow trees is grown on labelled rows; every path from a root to a node is a rule, the
conjunction of its intervals. A logistic model with a lasso penalty gives most rules no weight; what is left is compiled
into one Spark column expression, which scores any number of texts with no Python.

Fitting reads at most MOST_LABELLED labelled rows, drawn evenly by hash where there are more; statistics and scores cover all
rows. The penalty is the one of PENALTIES with the least log loss on a fifth of the training rows (their id's crc32 mod 5 is 1), and
the model is then fitted on all of them.

Edge cases: a null text counts as empty; an empty text has statistics of zero and is scored like any other; ids that repeat in the
labels take the majority, and none where it is even; null labels are left out; rows that repeat id and statistics train once; with labels of one
kind only, or none, the score is their smoothed share, so 0.5 where there are none; rows without an id are scored, not trained on; an
empty table gives no rows. Other columns, language and source among them, play no part.
"""

from __future__ import annotations

import math
import re
from dataclasses import dataclass
from functools import reduce

from pyspark.ml.classification import LogisticRegression, RandomForestClassifier
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from assayloom.llm._shared import table, written

MOST_LABELLED, TREES, DEPTH, SEED = 50_000, 40, 3, 13
PENALTIES = (0.01, 0.002)
FOLDS, GOOD = 5, 0.3
#: Rules fewer or more rows meet than this share, or all but it, are left out.
RARE = 0.002
SPACE = r"[\x20\x09-\x0D]+"
STATS = ("log_words", "word_length", "longest_word", "distinct_words", "neighbours_alike", "short_words", "words_without_letters", "line_words", "repeated_lines", "repeated_sentences", "symbols", "brackets", "capitals", "digits", "exclamations", "stops")
Bounds = tuple[tuple[int, float, float], ...]


def share(part: Column, whole: Column) -> Column:
    return F.when(whole > 0, part / whole).otherwise(F.lit(0.0))


def statistics(docs: DataFrame, text_col: str = "text", keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """``keep`` and the columns STATS for every row: shares of words, lines, letters or characters, and logs of lengths.

    ``distinct_words`` is a ratio of logs, as the share itself falls with the length."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    some = lambda parts: F.filter(parts, lambda w: w != "")
    cut = docs.select(*keep, text.alias("_t"), some(F.split(text, SPACE)).alias("_w"), F.filter(F.split(text, "\n"), lambda x: F.trim(x) != "").alias("_l"), some(F.split(text, r"[.!?]+[\x20\x09-\x0D]*|\n")).alias("_s"))
    n = F.size("_w")
    of = lambda chars: F.length("_t") - F.length(F.translate("_t", chars, ""))
    kind = lambda pattern: F.length(F.regexp_replace("_t", pattern, ""))
    alike = F.size(F.filter(F.zip_with(F.slice("_w", 2, F.greatest(n - 1, F.lit(0))), F.slice("_w", 1, F.greatest(n - 1, F.lit(0))), lambda a, b: a == b), lambda x: x))
    lengths = F.transform("_w", F.length)
    counted = cut.select(*keep, n.alias("n"), F.aggregate(lengths, F.lit(0), lambda a, x: a + x).alias("chars"), F.coalesce(F.array_max(lengths), F.lit(0)).alias("longest"), F.size(F.array_distinct("_w")).alias("distinct"), F.when(n > 1, alike).otherwise(0).alias("alike"), F.size(F.filter("_w", lambda w: F.length(w) <= 3)).alias("short"), F.size(F.filter("_w", lambda w: ~w.rlike(r"[\p{L}\p{N}]"))).alias("bare"), F.size("_l").alias("lines"), F.size(F.array_distinct("_l")).alias("own_lines"), F.size("_s").alias("sentences"), F.size(F.array_distinct("_s")).alias("own_sentences"), of("#*$%&|<>").alias("symbols"), of("{}[]()\\=").alias("brackets"), kind(r"[^\p{L}]+").alias("letters"), kind(r"[^\p{Lu}]+").alias("capitals"), of("0123456789").alias("digits"), of("!?").alias("bangs"), of(".,;:").alias("stops"))
    c = F.col
    return counted.select(
        *keep,
        F.log1p("n").alias("log_words"),
        share(c("chars"), c("n")).alias("word_length"),
        F.log1p("longest").alias("longest_word"),
        share(F.log1p("distinct"), F.log1p("n")).alias("distinct_words"),
        share(c("alike"), c("n")).alias("neighbours_alike"),
        share(c("short"), c("n")).alias("short_words"),
        share(c("bare"), c("n")).alias("words_without_letters"),
        share(c("n"), c("lines")).alias("line_words"),
        share(c("lines") - c("own_lines"), c("lines")).alias("repeated_lines"),
        share(c("sentences") - c("own_sentences"), c("sentences")).alias("repeated_sentences"),
        share(c("symbols"), c("n")).alias("symbols"),
        share(c("brackets"), c("n")).alias("brackets"),
        share(c("capitals"), c("letters")).alias("capitals"),
        share(c("digits"), c("chars")).alias("digits"),
        share(c("bangs"), c("n")).alias("exclamations"),
        share(c("stops"), c("n")).alias("stops"),
    )


def paths(tree: str) -> set[Bounds]:
    """The rules of a printed tree: for each node but the root, the interval (above, up to) of each feature on its path."""
    found, stack = set(), []
    for line in tree.split("\n"):
        m = re.match(r"( +)(?:If|Else) \(feature (\d+) (<=|>) ([-\d.Ee]+)\)", line)
        if not m:
            continue
        stack = [s for s in stack if s[0] < len(m[1])] + [(len(m[1]), int(m[2]), m[3], float(m[4]))]
        bounds: dict[int, tuple[float, float]] = {}
        for _, feature, side, at in stack:
            low, high = bounds.get(feature, (float("-inf"), float("inf")))
            bounds[feature] = (low, min(high, at)) if side == "<=" else (max(low, at), high)
        found.add(tuple((f, *bounds[f]) for f in sorted(bounds)))
    return found


def condition(rule: Bounds) -> Column:
    tests = []
    for feature, low, high in rule:
        tests += [F.col(STATS[feature]) > low] if low > float("-inf") else []
        tests += [F.col(STATS[feature]) <= high] if high < float("inf") else []
    return reduce(lambda a, b: a & b, tests)


@dataclass(frozen=True)
class Ensemble:
    """Weighted rules."""

    rules: tuple[tuple[Bounds, float], ...]
    intercept: float

    def score(self) -> Column:
        """The chance of a good text, over the columns STATS."""
        terms = [F.when(condition(r), w).otherwise(0.0) for r, w in self.rules]
        while len(terms) > 1:  # a balanced sum: no deep expression
            terms = [reduce(lambda a, b: a + b, terms[i : i + 8]) for i in range(0, len(terms), 8)]
        total = F.lit(self.intercept) + (terms[0] if terms else F.lit(0.0))
        return 1 / (1 + F.exp(-total))

    def described(self) -> list[str]:
        """The rules in words, the heaviest first."""
        say = lambda r: " and ".join(f"{STATS[f]}" + (f" > {low:g}" if low > float("-inf") else "") + (f" <= {high:g}" if high < float("inf") else "") for f, low, high in r)
        return [f"{w:+.3f} if {say(r)}" for r, w in sorted(self.rules, key=lambda x: -abs(x[1]))]


def fold(id_col: str = "doc_id") -> Column:
    return F.crc32(F.col(id_col).cast("string")) % FOLDS


def fit(rows: DataFrame, most: int = MOST_LABELLED) -> Ensemble:
    """An ensemble for ``rows``: doc_id, label (0.0 or 1.0) and STATS; a written table."""
    rows = rows.dropDuplicates(["doc_id", *STATS])
    n = rows.count()
    if n > most:
        rows = rows.where(F.pmod(F.xxhash64("doc_id", *STATS), F.lit(1 << 20)) < F.lit(int((1 << 20) * most / n)))
    rows = written(rows.repartition(8, "doc_id").sortWithinPartitions("doc_id", *STATS), "labelled")
    n, good = rows.agg(F.count(F.lit(1)), F.coalesce(F.sum("label"), F.lit(0.0))).first()
    chance = (good + 1) / (n + 2)
    if not 0 < good < n:
        return Ensemble((), math.log(chance / (1 - chance)))
    vectors = rows.select("label", array_to_vector(F.array(*STATS)).alias("features"))
    forest = RandomForestClassifier(numTrees=TREES, maxDepth=DEPTH, featureSubsetStrategy="onethird", subsamplingRate=0.5, minInfoGain=1e-4, seed=SEED).fit(vectors)
    rules = sorted(set().union(*(paths(t.toDebugString) for t in forest.trees)))
    if rules:  # rules that hold nearly nowhere or everywhere
        met = rows.agg(F.array(*(F.avg(condition(r).cast("double")) for r in rules))).first()[0]
        rules = [r for r, m in zip(rules, met, strict=True) if RARE < m < 1 - RARE]
    if not rules:
        return Ensemble((), math.log(chance / (1 - chance)))
    marked = rows.select((fold() == 1).alias("held"), "label", array_to_vector(F.array(*(condition(r).cast("double") for r in rules))).alias("features"))
    marked = written(marked, "rules")
    model = lambda data, penalty: LogisticRegression(regParam=penalty, elasticNetParam=1.0, standardization=False, maxIter=30).fit(data)
    chance = F.least(F.greatest(vector_to_array("probability")[1], F.lit(1e-6)), F.lit(1 - 1e-6))
    loss = F.avg(-F.when(F.col("label") == 1, F.log(chance)).otherwise(F.log(1 - chance)))
    one, two = marked.where("not held"), marked.where("held")
    kinds = [x.agg(F.min("label"), F.max("label")).first() for x in (one, two)]
    best = PENALTIES[-1]
    if all(tuple(k) == (0.0, 1.0) for k in kinds):
        tried = [(model(one, p).transform(two).agg(loss).first()[0], p) for p in PENALTIES]
        best = min(tried)[1]
    last = model(marked, best)
    weights = last.coefficients.toArray()
    return Ensemble(tuple((r, float(w)) for r, w in zip(rules, weights, strict=True) if w), float(last.intercept))


def labelled(stats: DataFrame, labels: DataFrame, label_col: str = "quality") -> DataFrame:
    """The rows of ``stats`` to learn from: those with a label whose id isn't held out."""
    marks = labels.where(F.col("doc_id").isNotNull() & F.col(label_col).isNotNull() & (fold() != 0)).groupBy("doc_id").agg(F.avg(F.col(label_col).cast("double")).alias("mark"))
    marks = marks.where("mark != 0.5").select("doc_id", (F.col("mark") > 0.5).cast("double").alias("label"))
    return stats.join(marks, "doc_id")


def scored(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, held_out, score and predicted for every row of ``docs``."""
    stats = written(statistics(docs), "stats")
    ensemble = fit(labelled(stats, labels))
    out = stats.select("doc_id", F.coalesce(fold() == 0, F.lit(False)).alias("held_out"), ensemble.score().alias("score"))
    return out.withColumn("predicted", (F.col("score") >= GOOD).cast("int"))


def op13_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scored(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
