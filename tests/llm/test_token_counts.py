import random

import public_tokenizers
import pytest
from tokenizers import Tokenizer

from assayloom.llm.token_counts import TokenCounter, token_counts, token_counts_of_chunks

PATH = public_tokenizers.path("word_bpe_49k.json")


@pytest.fixture(scope="module")
def library():
    t = Tokenizer.from_file(PATH)
    return lambda s: len(t.encode(s, add_special_tokens=False).ids)


def samples():
    rng = random.Random(5)
    alphabet = "aabcdeestrings'’ \t\n\x1c\x85  ΣσςİẞßÉé́ÅK0123٣½Ⅷ!!?.,<|>_-中文日本語한국어🙂ñÑ"
    for k in range(1500):
        s = "".join(rng.choice(alphabet) for _ in range(rng.randint(0, 40)))
        if k % 5 == 0:
            s += rng.choice(["<|endoftext|>", "<|startoftext|>", "<|endoftext|", "<|ENDOFTEXT|>"]) + "x"
        if k % 3 == 0:
            s = "".join(chr(rng.choice([rng.randint(0, 0x2FFF), rng.randint(0, 255), rng.randint(0x10000, 0x1FFFF)])) for _ in range(15))
        yield s


def test_counts_equal_the_library_and_do_not_depend_on_chunks(library):
    c = TokenCounter(PATH)
    for s in samples():
        n = library(s)
        assert c.count(s) == n, repr(s)
        assert c.count(s, 7) == n, repr(s)


def test_transducer_equals_plain_merging(library):
    c = TokenCounter(PATH)
    t = c.counts.transducer
    rng = random.Random(1)
    for _ in range(3000):
        w = "".join(rng.choice("etaoinshrdlucmfwypvbgkjqxz") for _ in range(rng.randint(1, 25))).encode()
        assert t.count(w) == len(t.merged([t.inner[b] for b in w[:-1]] + [t.last[w[-1]]]))


def test_composition_is_associative():
    c = TokenCounter(PATH)
    m = [c.state_map(x) for x in ("ab", "c d", "", "e", " f", "gh<|endof", "text|> x", "'s ok")]
    for i in range(len(m) - 2):
        a, b, d = m[i : i + 3]
        assert c.compose(c.compose(a, b), d) == c.compose(a, c.compose(b, d))
    assert c.total(c.scan(m)) == c.count("abc de fgh<|endoftext|> x's ok")


def test_bounded_tables_are_refilled(library, monkeypatch):
    from assayloom.llm import token_counts as t

    monkeypatch.setattr(t, "MOST_STATES", 50)
    monkeypatch.setattr(t, "MOST_WORDS", 5)
    c = TokenCounter(PATH)
    text = "some words that make the tables overflow again and again some words"
    assert c.count(text) == library(text)


def test_odd_rows(odd_docs, no_docs, library):
    got = token_counts(odd_docs, PATH).collect()
    texts = [r["text"] or "" for r in odd_docs.collect()]
    assert sorted((r["n_bytes"], r["n_tokens"], r["over_limit"]) for r in got) == sorted((len(t.encode()), library(t), library(t) > 2048) for t in texts)
    assert token_counts(no_docs, PATH).count() == 0


def test_documents_in_chunk_rows(spark, words, library):
    texts = {0: words(1, 900), 1: "x" * 300, 2: ""}
    rows = [(d, i // 50, t[i : i + 50]) for d, t in texts.items() for i in range(0, max(len(t), 1), 50)]
    random.Random(3).shuffle(rows)
    got = token_counts_of_chunks(spark.createDataFrame(rows, "doc_id long, seq int, text string"), PATH, fan_in=4).collect()
    assert {r["doc_id"]: r["n_tokens"] for r in got} == {d: library(t) for d, t in texts.items()}


def test_tables_stay_bounded_within_one_long_word(monkeypatch):
    import random

    from assayloom.llm import token_counts as T

    monkeypatch.setattr(T, "MOST_STATES", 500)
    rng = random.Random(3)
    word = "".join(rng.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(30_000))
    fresh = T.TokenCounter(public_tokenizers.path("word_bpe_49k.json"))
    library = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    assert fresh.count(word) == len(library.encode(word, add_special_tokens=False).ids)
    assert len(fresh.counts.transducer.states) <= 502


def test_vocabularies_beyond_the_packed_fields_are_refused():
    from assayloom.llm.token_counts import WordTransducer, byte_letters

    vocab = {c: i for i, c in enumerate([*byte_letters(), *(c + "</w>" for c in byte_letters())])}
    merges, word = [], "a"
    for _ in range(70):
        merges.append([word, "a"])
        word += "a"
        vocab[word] = len(vocab)
    with pytest.raises(ValueError):
        WordTransducer(vocab, merges, "</w>")


def test_workers_hold_little():
    """A worker keeps its tables for the stages that follow: states are packed, the library has no vocabulary of its own."""
    import assayloom.llm.token_counts as T

    c = TokenCounter(PATH)
    assert c.count("plain words <|endoftext|> stra\u00dfe") > 4
    assert len(c.counts.transducer.states) > 1 and all(isinstance(s, bytes) for s in c.counts.transducer.states)
    assert c.library.get_vocab_size() == 0 and T.MOST_WORDS <= 50_000


def test_words_of_the_language_stay_while_others_pass(monkeypatch):
    """Words met once don't push out the others: those run through the transducer a few times, and no table grows beyond its bound."""
    import assayloom.llm.token_counts as T

    monkeypatch.setattr(T, "MOST_WORDS", 100)
    c, seen = TokenCounter(PATH), []
    count = c.counts.transducer.count
    c.counts.transducer.count = lambda word: seen.append(word) or count(word)
    known = [f"{a}{b}" for a in "abcde" for b in "fghi"]
    for k in range(200):
        assert c.count(" ".join([*known, *(f"once{'xyzuvwabcd'[k % 10]}{'mnop'[i % 4]}{chr(97 + i)}{chr(97 + k // 10)}" for i in range(8))])) > 28
        assert len(c.counts) + len(c.counts.old) <= 101
    assert max(seen.count(w.encode()) for w in known) <= 3


def test_the_written_out_split_is_that_of_the_library(library):
    import unicodedata

    import assayloom.llm.token_counts as T

    settled = [c for c in map(chr, [*range(0xD800), *range(0xE000, 0x20000)]) if not T.UNSETTLED.match(c)]
    rng, c = random.Random(4), TokenCounter(PATH)
    for _ in range(300):
        text = "".join(rng.choice(settled if rng.random() < 0.5 else "ab'sstremd ve ll09.,-\x1ćΣ\n") for _ in range(60))
        lower = unicodedata.normalize("NFC", text).replace("Σ", "σ").lower()
        assert T.settled_words().findall(lower) == [w for w, _ in c.split(lower)]
        assert c.count(text) == library(text)
