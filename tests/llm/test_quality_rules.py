import re
from collections import Counter

import zstandard
from pyspark.sql import functions as F

from assayloom.llm.quality_rules import band, keep_good, quality_rules, repeat_words


def brute(text):
    text = text or ""
    words = re.findall("[^\x20\x09-\x0d]+", text)
    windows = Counter(tuple(words[i : i + 8]) for i in range(len(words) - 7))
    inside = {i + k for i in range(len(words) - 7) if windows[tuple(words[i : i + 8])] > 1 for k in range(8)}
    lines, dup, seen = text.split("\n"), 0, set()
    for x in lines:
        if re.search("[^\x20\x09-\x0d]", x):
            dup += x in seen
            seen.add(x)
    failed = len(words) < 20 or 100 * len(inside) > 30 * len(words)
    return len(words), sum(map(len, words)), len(re.findall("[#*$%&|<>]", text)), dup, len(inside), failed


def test_base_measures_equal_brute_force(make_docs, words):
    texts = [words(1, 100), words(2, 30) * 3, "a\nb\na\n \n \nb", "# x $ | <y>" * 9, words(3, 25) + "\n" + words(3, 25), "a " * 100, "x y z  w", "", None, "one two three four five six seven eight " * 2]
    got = {r["doc_id"]: r for r in quality_rules(make_docs(texts)).collect()}
    for i, t in enumerate(texts):
        r = got[i]
        assert (r["n_words"], r["word_chars"], r["n_symbols"], r["n_dup_lines"], r["n_repeat_words"], r["base_failed"]) == brute(t), t


def test_repeat_words_is_exact():
    w = [b"%d" % (i % 11) for i in range(60)]
    assert repeat_words(w) == 60
    assert repeat_words([b"%d" % i for i in range(60)]) == 0


def test_verdicts(make_docs, words):
    import base64
    import random

    rng = random.Random(2)
    noise = " ".join(base64.b85encode(rng.randbytes(30)).decode() for _ in range(200))
    half = words(4, 2500) + " " + " ".join(f"row {i} of the table" for i in range(4000))
    good = [words(i, n) for i, n in enumerate((25, 60, 300, 3000, 20_000))]
    got = {r["doc_id"]: r for r in quality_rules(make_docs([*good, noise, half, " ".join(f"item {i % 50} is listed here" for i in range(3000))])).collect()}
    assert all(got[i]["kept"] for i in range(len(good)))
    assert (got[5]["kept"], got[5]["reason"]) == (False, "incompressible")
    assert not got[6]["kept"] and not got[7]["kept"]
    text = good[3].encode()
    assert abs(got[3]["whole_ratio"] - len(text) / len(zstandard.ZstdCompressor(level=3).compress(text))) < 1e-9
    assert band(100)[0] == 0


def test_odd_rows_and_filter(odd_docs, no_docs):
    assert quality_rules(odd_docs).count() == 11 and quality_rules(no_docs).count() == 0
    kept = keep_good(odd_docs)
    assert kept.columns == odd_docs.columns
    verdict = quality_rules(odd_docs.withColumn("doc_id", F.coalesce("doc_id", F.lit(-1)))).where("kept").count()
    assert kept.count() == verdict >= 4 and keep_good(no_docs).count() == 0
