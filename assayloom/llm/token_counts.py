"""Token counts: a tokenizer compiled to finite-state form.

Byte-pair encoding of a word is compiled to a deterministic transducer that reads bytes and emits how many tokens are certain.
The underlying automaton is unambiguous: it reads vocabulary entries along a trie and may close one only where the pair
(previous entry, this entry) is one that merging would leave alone. Its weighted subset construction is done lazily: a state is
the set of (trie node, previous entry, tokens beyond the smallest), a transition emits by how much that smallest count rises.
States reached by different prefixes but alike in what can follow are one state.

Long documents are read in chunks. A chunk's state map says what it does whatever state it is entered in: all that depends on
the entry is the text up to the first white space, after which the pre-tokenizer is in its start state. Maps are
(closed, head, tokens, tail) and compose associatively, so they are reduced as a balanced tree: within the task for a
document in one row, and with one shuffle of maps for each level for documents that are stored as rows of chunks.

Edge cases: a null text counts as empty, with 0 tokens; special strings in a text are one token each, as the library has it by
default; texts of any length work; repeated rows are counted again; other columns are ignored.
"""

from __future__ import annotations

import json
import re
import unicodedata
from array import array
from collections.abc import Iterable, Iterator

import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from assayloom.llm._shared import map_texts, table

CHUNK, LIMIT = 65_536, 2048
#: Memory bounds of a worker: beyond them the tables are emptied and filled anew.
MOST_STATES, MOST_WORDS, MOST_PAIRS = 250_000, 50_000, 400_000
#: Letters at the start of a word that are read at once where they are known.
START = 4
SPACES = r"\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"
WORDS = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"
SPACE = regex.compile(f"[{SPACES}]")
#: Characters whose class, case and composition are alike in every Unicode version; for others the library is asked.
SETTLED = "\0-\u052f\u05d0-\u05ea\u2000-\u206f\u20a0-\u20bf\u2100-\u214f\u2190-\u22ff\u3000-\u303f\u3041-\u3096\u30a0-\u30ff\u4e00-\u9fff\uac00-\ud7a3\ufe00-\ufe0f\uff01-\uff5e\U0001f300-\U0001f64f"
UNSETTLED = re.compile(f"[^{SETTLED}]")
ROOT = 0
#: An element of a state as one number: trie node, entry before (one more than its number; 0 for none), tokens beyond the smallest.
NODE, BEFORE = 1 << 23, 1 << 6


def byte_letters() -> list[str]:
    """The letter that byte-level vocabularies write for each byte: itself if printable, else the next from U+0100."""
    kept = [*range(33, 127), *range(161, 173), *range(174, 256)]
    letters, n = {b: chr(b) for b in kept}, 256
    for b in range(256):
        if b not in letters:
            letters[b], n = chr(n), n + 1
    return [letters[b] for b in range(256)]


def packed(elements: Iterable[int]) -> bytes:
    """A state: its elements, ascending, as eight bytes each, a third of what a tuple of numbers takes."""
    return array("q", sorted(elements)).tobytes()


class WordTransducer:
    """Counts the tokens of a word (bytes) for a BPE vocabulary whose last letter carries an end mark."""

    def __init__(self, vocab: dict[str, int], merges: list, end: str):
        letters = byte_letters()
        self.inner = [vocab[c] for c in letters]
        self.last = [vocab[c + end] for c in letters]
        self.parts: dict[int, tuple[int, int]] = {}
        self.joined: dict[tuple[int, int], int] = {}
        for m in merges:
            a, b = m if isinstance(m, list) else m.split(" ")
            x, y, z = vocab[a], vocab[b], vocab[a + b]
            if z in self.parts or z <= max(x, y):
                raise ValueError("entries must be numbered in the order of their merges")
            self.parts[z], self.joined[x, y] = (x, y), z
        self.symbols: dict[int, tuple[int, ...]] = {x: (x,) for x in (*self.inner, *self.last)}
        self.child: dict[int, int] = {}
        self.entry = [-1]
        for z in (*self.symbols, *self.parts):
            if z in self.parts:
                x, y = self.parts[z]
                self.symbols[z] = self.symbols[x] + self.symbols[y]
            node = ROOT
            for s in self.symbols[z]:
                if (after := self.child.get(node << 10 | s)) is None:
                    after = self.child[node << 10 | s] = len(self.entry)
                    self.entry.append(-1)
                node = after
            self.entry[node] = z
        if max(map(len, self.symbols.values())) >= BEFORE or max(*self.inner, *self.last) >= 1 << 10 or max(self.symbols) + 1 >= NODE // BEFORE:
            raise ValueError("entries are too long or their numbers too large for the packed fields")
        self.proper: dict[int, bool] = {}
        self.reset()

    def reset(self, *keep: bytes) -> None:
        """Empties the tables, but for the states of ``keep``, which are numbered from 1."""
        start = packed([ROOT * NODE])
        self.states = [start, *(k for k in keep if k != start)]
        self.number = {k: i for i, k in enumerate(self.states)}
        self.step: dict[int, int] = {}
        self.stop: dict[int, int] = {}
        self.pairs: dict[int, bool] = {}
        self.starts: dict[bytes, int] = {}

    def stands_alone(self, z: int) -> bool:
        """Whether merging the letters of entry z gives z itself."""
        if (known := self.proper.get(z)) is None:
            known = self.proper[z] = z not in self.parts or self.merged(list(self.symbols[z])) == [z]
        return known

    def merged(self, word: list[int]) -> list[int]:
        """Plain merging, for short inputs."""
        while len(word) > 1:
            best = min((self.joined.get(p, 1 << 30), i) for i, p in enumerate(zip(word, word[1:], strict=False)))
            if best[0] == 1 << 30:
                break
            x, y = word[best[1]], word[best[1] + 1]
            out, i = [], 0
            while i < len(word):
                if i + 1 < len(word) and word[i] == x and word[i + 1] == y:
                    out.append(best[0])
                    i += 2
                else:
                    out.append(word[i])
                    i += 1
            word = out
        return word

    def may_follow(self, left: int, right: int) -> bool:
        """Whether merging leaves the border between two entries standing.

        Undo merges on both sides of the border, latest first; the border falls if at some time the two entries that touch
        it had a merge earlier than the one undone next.
        """
        key = left << 20 | right
        if (known := self.pairs.get(key)) is not None:
            return known
        limit, answer = 1 << 60, None
        while answer is None:
            z = self.joined.get((left, right))
            if z is not None and z < limit:
                answer = False
            elif left > right and left in self.parts:
                limit, left = left, self.parts[left][1]
            elif right in self.parts:
                limit, right = right + 1, self.parts[right][0]
            elif left in self.parts:
                limit, left = left, self.parts[left][1]
            else:
                answer = True
        self.pairs[key] = answer
        return answer

    def closes(self, node: int, before: int) -> bool:
        z = self.entry[node]
        return z >= 0 and self.stands_alone(z) and (before < 0 or self.may_follow(before, z))

    def advance(self, state: int, symbol: int) -> int:
        """The transition, as next state * 64 + tokens emitted."""
        after, child, entry, proper = [], self.child, self.entry, self.proper
        for element in memoryview(self.states[state]).cast("q"):
            if (to := child.get(element // NODE << 10 | symbol)) is not None:
                after.append(to * NODE + element % NODE)
                # as ``closes`` has it, with what is known looked up here
                if (z := entry[to]) >= 0 and (proper.get(z) or z not in proper and self.stands_alone(z)):
                    before = element % NODE // BEFORE - 1
                    if before < 0 or self.may_follow(before, z):
                        after.append(ROOT * NODE + (z + 1) * BEFORE + element % BEFORE + 1)
        least = min(e % BEFORE for e in after)
        key = packed(e - least for e in after) if least else packed(after)
        if (to := self.number.get(key)) is None:
            to = self.number[key] = len(self.states)
            self.states.append(key)
        return to * 64 + least

    def finish(self, state: int, symbol: int) -> int:
        """The tokens emitted by the last letter."""
        for element in memoryview(self.states[state]).cast("q"):
            to = self.child.get(element // NODE << 10 | symbol)
            if to is not None and self.closes(to, element % NODE // BEFORE - 1):
                return element % BEFORE + 1
        raise AssertionError("every word has one reading")

    def begun(self, start: bytes) -> int:
        """What the first letters of a longer word lead to, as state * 1024 + tokens emitted."""
        state, total = 0, 0
        for b in start:
            key = state * 256 + b
            if (to := self.step.get(key)) is None:
                to = self.step[key] = self.advance(state, self.inner[b])
            state, total = to >> 6, total + (to & 63)
        return state << 10 | total

    def count(self, word: bytes) -> int:
        state, total, inner, step, rest = 0, 0, self.inner, self.step, word[:-1]
        if len(word) > START:
            start = word[:START]
            if (known := self.starts.get(start)) is None:
                known = self.starts[start] = self.begun(start)
            state, total, rest = known >> 10, known & 1023, word[START:-1]
        for b in rest:
            key = state * 256 + b
            if (to := step.get(key)) is None:
                if len(self.states) > MOST_STATES or len(self.pairs) > MOST_PAIRS:  # within a long word, too
                    now = self.states[state]
                    self.reset(now)
                    state, step = self.number[now], self.step
                    key = state * 256 + b
                to = step[key] = self.advance(state, inner[b])
            state, total = to >> 6, total + (to & 63)
        key = state * 256 + word[-1]
        if (more := self.stop.get(key)) is None:
            more = self.stop[key] = self.finish(state, self.last[word[-1]])
        return total + more


class WordCounts(dict):
    """Counts by word; a word that isn't known runs through the transducer.

    Words are dropped in the order they came, a fifth of MOST_WORDS at a time; those met again after they left that fifth stay, as long as they are
    three fifths at most. So the words of the language stay, and the many that are met once don't push them out.
    """

    def __init__(self, transducer: WordTransducer):
        super().__init__()
        self.transducer = transducer
        self.often: dict[str, int] = {}
        self.old: dict[str, int] = {}

    def __missing__(self, word: str) -> int:
        if (n := self.old.get(word)) is not None:
            if len(self.often) < MOST_WORDS * 3 // 5:
                self.often[word] = self[word] = n
                return n
        else:
            n = self.transducer.count(word.encode())
        if len(word) <= 64:
            if len(self) - len(self.often) >= max(1, MOST_WORDS // 5):
                self.old = {w: n for w, n in self.items() if w not in self.often}
                self.clear()
                self.update(self.often)
            self[word] = n
        return n


def settled_words() -> re.Pattern:
    """The split of the pre-tokenizer for lower-cased texts of settled characters.

    Letters and digits are written out as one table of the plane that such texts have them in, which takes half the time of looking up each character's class.
    """
    plane = "".join(map(chr, [*range(0xD800), *range(0xE000, 1 << 16)]))
    letters, digits = ("".join(f"{re.escape(m[0][0])}-{re.escape(m[0][-1])}" for m in regex.finditer(kind, plane)) for kind in (r"\p{L}+", r"\p{N}+"))
    return re.compile(f"[{letters}]+|'(?:s|t|re|ve|m|ll|d)|[{digits}]|[^{SPACES}{letters}{digits}]+")


class TokenCounter:
    """Pre-tokenizer and word transducer of a tokenizers .json file with NFC, lower case, a split pattern and BPE."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        kinds = [n["type"] for n in spec["normalizer"]["normalizers"]]
        if kinds != ["NFC", "Replace", "Lowercase"] or spec["model"]["type"] != "BPE":
            raise ValueError(f"this compiler doesn't know normalizers {kinds}")
        if spec["pre_tokenizer"]["pretokenizers"][0]["pattern"]["Regex"] != WORDS:
            raise ValueError("this compiler doesn't know the pattern of words")
        self.words = settled_words()
        from tokenizers import Tokenizer

        # the library only splits and normalizes here, so it gets no vocabulary; workers stay for later stages and keep what they hold
        self.library = library = Tokenizer.from_str(json.dumps(spec | {"added_tokens": [], "post_processor": None, "decoder": None, "model": {"type": "BPE", "vocab": {}, "merges": []}}))
        self.normalized, self.split = library.normalizer.normalize_str, library.pre_tokenizer[0].pre_tokenize_str
        special = [t["content"] for t in spec["added_tokens"]]
        self.special = regex.compile("|".join(map(regex.escape, special))) if special else None
        self.marks = [s for s in special]
        self.counts = WordCounts(WordTransducer(spec["model"]["vocab"], spec["model"]["merges"], spec["model"]["end_of_word_suffix"]))

    def plain(self, text: str) -> int:
        if not text.isascii():
            if UNSETTLED.search(text):
                return sum(self.counts[w] for w, _ in self.split(self.normalized(text)))
            # letter by letter, as the library does: no special form of sigma at the end of a word
            text = unicodedata.normalize("NFC", text).replace("Σ", "σ")
        return sum(map(self.counts.__getitem__, self.words.findall(text.lower())))

    def closed(self, text: str) -> int:
        """Tokens of a text that begins and ends in the start state."""
        if any(m in text for m in self.marks):
            parts = self.special.split(text)
            return len(parts) - 1 + sum(map(self.plain, parts))
        return self.plain(text)

    def state_map(self, chunk: str) -> tuple[bool, str, int, str]:
        """(closed, head, tokens, tail); without white space the whole chunk is the head and nothing is closed."""
        first = SPACE.search(chunk)
        if first is None:
            return False, chunk, 0, ""
        end = len(chunk)
        while not SPACE.match(chunk, end - 1):
            end -= 1
        return True, chunk[: first.start()], self.closed(chunk[first.start() : end]), chunk[end:]

    def compose(self, a: tuple, b: tuple) -> tuple:
        if not a[0]:
            return (b[0], a[1] + b[1], b[2], b[3])
        if not b[0]:
            return (True, a[1], a[2], a[3] + b[1])
        return (True, a[1], a[2] + self.closed(a[3] + b[1]) + b[2], b[3])

    def scan(self, maps: list[tuple]) -> tuple:
        """All maps in their order as one, pair by pair."""
        while len(maps) > 1:
            maps = [self.compose(*maps[i : i + 2]) if i + 1 < len(maps) else maps[i] for i in range(0, len(maps), 2)]
        return maps[0] if maps else (False, "", 0, "")

    def total(self, m: tuple) -> int:
        return self.closed(m[1]) + m[2] + (self.closed(m[3]) if m[0] else 0)

    def count(self, text: str, chunk: int = CHUNK) -> int:
        if len(text) <= chunk:
            return self.closed(text)
        return self.total(self.scan([self.state_map(text[i : i + chunk]) for i in range(0, len(text), chunk)]))


COUNTERS: dict[str, TokenCounter] = {}


def counter(path: str) -> TokenCounter:
    """The compiled tokenizer, once in each worker."""
    if path not in COUNTERS:
        COUNTERS[path] = TokenCounter(path)
    return COUNTERS[path]


def token_counts(docs: DataFrame, path: str, limit: int = LIMIT, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``id_col``, n_bytes, n_tokens and over_limit for each row of ``docs``; one pass, no shuffle."""

    def row(text: str | None) -> tuple:
        text = text or ""
        n = counter(path).count(text)
        return len(text.encode()), n, n > limit

    return map_texts(docs, id_col, text_col, row, "n_bytes bigint, n_tokens bigint, over_limit boolean")


def token_counts_of_chunks(chunks: DataFrame, path: str, id_col: str = "doc_id", seq_col: str = "seq", text_col: str = "text", fan_in: int = 256) -> DataFrame:
    """n_tokens of documents stored as chunk rows numbered from 0 without gaps.

    Only state maps are shuffled. Each level composes ``fan_in`` neighbours, so no group is larger than that; the number
    of levels is the logarithm of the longest document's chunks. Null texts are empty chunks; rows with a null id or number go.
    """
    kind = chunks.schema[id_col].dataType.simpleString()
    fields = f"`{id_col}` {kind}, seq bigint, closed boolean, head string, tokens bigint, tail string"

    def maps(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            m = [counter(path).state_map(t or "") for t in b.column(2).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), *(pa.array(c, t) for c, t in zip(zip(*m, strict=True), (pa.bool_(), pa.string(), pa.int64(), pa.string()), strict=True))], [id_col, "seq", "closed", "head", "tokens", "tail"]) if m else b

    def level(t: pa.Table) -> pa.Table:
        rows = sorted(t.to_pylist(), key=lambda r: r["seq"])
        m = counter(path).scan([(r["closed"], r["head"], r["tokens"], r["tail"]) for r in rows])
        return pa.table({id_col: t.column(id_col)[:1], "seq": [rows[0]["seq"] // fan_in], "closed": [m[0]], "head": [m[1]], "tokens": [m[2]], "tail": [m[3]]})

    src = chunks.where(F.col(id_col).isNotNull() & F.col(seq_col).isNotNull())
    most = src.agg(F.max(seq_col)).first()[0] or 0
    out = src.select(id_col, F.col(seq_col).cast("long").alias("seq"), text_col).mapInArrow(maps, fields)
    while True:
        out = out.groupBy(id_col, (F.col("seq") / fan_in).cast("long").alias("part")).applyInArrow(level, fields)
        if (most := most // fan_in) == 0:
            break

    def last(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            n = [counter(path).total((r["closed"], r["head"], r["tokens"], r["tail"])) for r in b.to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(n, pa.int64())], [id_col, "n_tokens"])

    return out.mapInArrow(last, f"`{id_col}` {kind}, n_tokens bigint")


def op1_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return token_counts(table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"))
