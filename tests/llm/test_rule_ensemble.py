import math
import random
import zlib

import pytest
from pyspark.sql import functions as F

from assayloom.llm import rule_ensemble as R

DATA = "/root/testdata/sf0.01"


@pytest.fixture(scope="module")
def real(spark):
    docs, labels = (spark.read.parquet(f"{DATA}/{t}.parquet") for t in ("documents", "labels"))
    return docs, labels, R.scored(docs, labels).toPandas()


def test_held_out_quality(real, spark):
    """Documents the labels of which weren't seen: nearly all are told apart."""
    docs, labels, out = real
    assert len(out) == docs.count() and out["score"].between(0, 1).all()
    assert (out["held_out"] == [zlib.crc32(str(i).encode()) % 5 == 0 for i in out["doc_id"]]).all()
    assert (out["predicted"] == (out["score"] >= 0.3)).all()
    j = out.merge(labels.toPandas(), on="doc_id")
    j = j[j["held_out"]]
    good, bad = j[j["quality"] == 1], j[j["quality"] == 0]
    assert len(bad) >= 8 and (good["predicted"] == 1).mean() >= 0.97 and (bad["predicted"] == 0).mean() >= 0.9


def test_labels_of_held_out_rows_language_and_source_play_no_part(real, spark):
    docs, labels, out = real
    other = labels.withColumn("quality", F.when(F.crc32(F.col("doc_id").cast("string")) % 5 == 0, 1 - F.col("quality")).otherwise(F.col("quality"))).withColumn("toxic", F.lit(0))
    again = R.scored(docs.withColumns({"lang": F.lit("x"), "source": F.lit(None).cast("string"), "n_chars": F.lit(1)}), other).toPandas()
    a, b = (x.sort_values("doc_id")["score"].to_numpy() for x in (out, again))
    assert abs(a - b).max() < 1e-12


def test_statistics_equal_plain_python(spark, words):
    texts = [None, "", " \n\t ", "one", "a a a b\na a a b\n\nB! 12, x.", words(3, 200), "É| #*  $x$ {y}\nDone. Done. Not", "x" * 50_000, words(5, 20_000)]
    got = {r["doc_id"]: r for r in R.statistics(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()}
    import regex

    for i, text in enumerate(texts):
        t = text or ""
        w = [x for x in regex.split(R.SPACE, t) if x]
        lines = [x for x in t.split("\n") if x.strip(" ")]
        said = [x for x in regex.split(r"[.!?]+[\x20\x09-\x0D]*|\n", t) if x]
        n, letters, chars = len(w), len(regex.findall(r"\p{L}", t)), sum(map(len, w))
        of = lambda a, b: a / b if b else 0.0
        count = lambda s, t=t: sum(t.count(c) for c in s)
        want = {
            "log_words": math.log1p(n), "word_length": of(chars, n), "longest_word": math.log1p(max(map(len, w), default=0)), "distinct_words": of(math.log1p(len(set(w))), math.log1p(n)),
            "neighbours_alike": of(sum(a == b for a, b in zip(w, w[1:], strict=False)), n), "short_words": of(sum(len(x) <= 3 for x in w), n), "words_without_letters": of(sum(not regex.search(r"[\p{L}\p{N}]", x) for x in w), n),
            "line_words": of(n, len(lines)), "repeated_lines": of(len(lines) - len(set(lines)), len(lines)), "repeated_sentences": of(len(said) - len(set(said)), len(said)), "symbols": of(count("#*$%&|<>"), n), "brackets": of(count("{}[]()\\="), n),
            "capitals": of(len(regex.findall(r"\p{Lu}", t)), letters), "digits": of(count("0123456789"), chars), "exclamations": of(count("!?"), n), "stops": of(count(".,;:"), n),
        }
        assert list(want) == list(R.STATS)
        assert all(abs(got[i][k] - v) < 1e-9 for k, v in want.items()), (text or "")[:40]


def test_rules_are_the_paths_of_a_tree():
    tree = "DecisionTreeClassificationModel: uid=x, depth=2\n  If (feature 0 <= 1.5)\n   If (feature 2 <= -3.0E-4)\n    Predict: 0.0\n   Else (feature 2 > -3.0E-4)\n    Predict: 1.0\n  Else (feature 0 > 1.5)\n   If (feature 0 <= 2.5)\n    Predict: 0.0\n   Else (feature 0 > 2.5)\n    Predict: 1.0\n"
    inf = float("inf")
    assert R.paths(tree) == {
        ((0, -inf, 1.5),), ((0, -inf, 1.5), (2, -inf, -3e-4)), ((0, -inf, 1.5), (2, -3e-4, inf)), ((0, 1.5, inf),), ((0, 1.5, 2.5),), ((0, 2.5, inf),),
    }


def test_the_compiled_score_is_the_sum_of_the_rules_that_hold(spark):
    rng = random.Random(2)
    rows = [[rng.uniform(0, 3) for _ in R.STATS] for _ in range(50)]
    rules = tuple((((f, lo, lo + 1.0), (9, float("-inf"), 1.5)), rng.uniform(-2, 2)) for f in range(8) for lo in (0.5, 1.0))
    e = R.Ensemble(rules, 0.25)
    got = [r[0] for r in spark.createDataFrame(rows, [*R.STATS]).select(e.score()).collect()]
    for r, g in zip(rows, got, strict=True):
        z = 0.25 + sum(w for b, w in rules if all(lo < r[f] <= hi for f, lo, hi in b))
        assert abs(g - 1 / (1 + math.exp(-z))) < 1e-12
    assert len(e.described()) == 16 and e.described()[0].startswith(("+", "-"))
    assert spark.createDataFrame(rows[:1], [*R.STATS]).select(R.Ensemble((), 0.0).score()).first()[0] == 0.5


def test_odd_documents_and_labels(spark, odd_docs, no_docs):
    empty = spark.createDataFrame([], "doc_id long, quality int, score double")
    out = R.scored(odd_docs, empty).collect()
    assert len(out) == odd_docs.count() and {r["score"] for r in out} == {0.5} and {r["predicted"] for r in out} == {1}
    assert R.scored(no_docs, empty).collect() == []
    one = spark.createDataFrame([(1, 1, 0.0), (1, 1, 0.0), (3, None, 0.0), (None, 0, 0.0), (7, 1, 0.0), (7, 0, 0.0)], "doc_id long, quality int, score double")
    assert len({r["score"] for r in R.scored(odd_docs, one).collect()}) == 1
    marks = spark.createDataFrame([(i, int(i in (3, 6)), 0.0) for i in (0, 1, 2, 3, 4, 6, 7, 8)], "doc_id long, quality int, score double")
    out = R.scored(odd_docs, marks).collect()
    assert len(out) == odd_docs.count() and all(0 <= r["score"] <= 1 for r in out)
    assert [r["held_out"] for r in out if r["doc_id"] is None] == [False, False]


def test_more_labels_than_the_bound_are_drawn_evenly(spark, real):
    docs, labels, _ = real
    rows = R.labelled(R.written(R.statistics(docs), "stats"), labels)
    e = R.fit(rows, most=120)
    n = rows.count()
    assert n > 200 and e.rules
    good = rows.select((e.score() >= 0.3).alias("p"), "label").where("p = (label = 1.0)").count()
    assert good / n > 0.95
