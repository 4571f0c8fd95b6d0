"""Quality rules: compression bands.

Natural text of a given length compresses by a narrow range of ratios. A text far above it repeats itself, one
far below it is noise. Both the whole document and fixed chunks are compressed with zstandard, so that a long document
with one repetitive half is seen too. Limits depend on the length, as short inputs pay for the frame and
long ones gain from the window.

Edge cases: a null text counts as empty; an empty text has no words, so ``base_failed`` holds and it isn't kept; rows
that occur twice are judged twice; ids may be null; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import zstandard
from pyspark.sql import DataFrame, SparkSession

from assayloom.llm._shared import map_texts, small_batches, table

LEVEL, CHUNK = 3, 8192
#: (up to this many bytes, least ratio, greatest ratio). Below 256 bytes the frame dominates, so nothing is too dense.
BANDS = ((256, 0.0, 4.0), (512, 1.05, 4.0), (1024, 1.15, 4.0), (4096, 1.25, 5.0), (16384, 1.3, 5.5), (65536, 1.35, 6.0), (float("inf"), 1.35, 7.0))
#: A document goes if chunks outside their bands hold more than this share of its bytes.
BAD_SHARE = 0.25
MIN_WORDS, MAX_REPEAT_PERCENT, WINDOW = 20, 30, 8
SYMBOLS = "#*$%&|<>"
SPACES = " \t\n\x0b\x0c\r"
FIELDS = (
    "n_words bigint, word_chars bigint, n_symbols bigint, n_dup_lines bigint, n_repeat_words bigint, base_failed boolean, kept boolean, "
    "whole_ratio double, densest_chunk double, loosest_chunk double, bad_share double, reason string"
)


def repeat_words(words: list[bytes], window: int = WINDOW) -> int:
    """Words inside windows of ``window`` (a power of two) words that occur at least twice.

    Word runs are numbered by doubling: equal numbers of length 2k are equal pairs of numbers of length k, so
    the comparison is exact and takes memory in proportion to the words.
    """
    n = len(words) - window + 1
    if n < 2:
        return 0
    seen: dict[bytes, int] = {}
    ids = np.array([seen.setdefault(w, len(seen)) for w in words], dtype=np.int64)
    if len(seen) == len(words):
        return 0
    size, counts = 1, None
    while size < window:
        pairs = ids[: len(ids) - size] * (int(ids.max()) + 1) + ids[size:]
        values, ids, counts = np.unique(pairs, return_inverse=True, return_counts=True)
        if len(values) == len(pairs):
            return 0
        size *= 2
    hit = np.flatnonzero(counts[ids] > 1)
    edge = np.zeros(len(words) + 1, dtype=np.int64)
    np.add.at(edge, hit, 1)
    np.add.at(edge, hit + window, -1)
    return int((np.cumsum(edge)[:-1] > 0).sum())


def duplicate_lines(text: str) -> int:
    """Lines with a word that equal an earlier line."""
    lines = [x for x in text.split("\n") if x.strip(SPACES)]
    return len(lines) - len(set(lines))


def ratio(data: bytes, packer: zstandard.ZstdCompressor) -> float:
    return len(data) / len(packer.compress(data)) if data else 0.0


def band(n: int) -> tuple[float, float]:
    return next((lo, hi) for most, lo, hi in BANDS if n <= most)


def judge(data: bytes, packer: zstandard.ZstdCompressor) -> tuple[float, float, float, float, str | None]:
    """Whole ratio, largest and smallest chunk ratio, share of bytes in chunks out of band, reason or None."""
    whole = ratio(data, packer)
    chunks = [(n := len(c := data[i : i + CHUNK]), ratio(c, packer), band(n)) for i in range(0, len(data), CHUNK)] if len(data) > CHUNK else [(len(data), whole, band(len(data)))]
    bad = sum(n for n, r, (lo, hi) in chunks if not lo <= r <= hi) / max(len(data), 1)
    lo, hi = band(len(data))
    reason = "repetitive" if whole > hi else "incompressible" if whole < lo else "chunks" if bad > BAD_SHARE else None
    return whole, max(r for _, r, _ in chunks), min(r for _, r, _ in chunks), bad, reason


def row_measurer() -> Callable[[str | None], tuple]:
    packers: list[zstandard.ZstdCompressor] = []  # made once in each worker

    def measure(text: str | None) -> tuple:
        packers or packers.append(zstandard.ZstdCompressor(level=LEVEL))
        text = text or ""
        data = text.encode()
        words = data.split()
        n, repeated = len(words), repeat_words(words)
        failed = n < MIN_WORDS or 100 * repeated > MAX_REPEAT_PERCENT * n
        whole, most, least, bad, reason = judge(data, packers[0])
        return (
            n,
            len(text) - sum(map(text.count, SPACES)),
            sum(map(text.count, SYMBOLS)),
            duplicate_lines(text),
            repeated,
            failed,
            not failed and reason is None,
            whole,
            most,
            least,
            bad,
            "base" if failed else reason,
        )

    return measure


def quality_rules(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row for each of ``docs`` with its measures and the verdict ``kept``; one pass, no shuffle."""
    return map_texts(docs, id_col, text_col, row_measurer(), FIELDS)


def keep_good(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` that pass, with their columns as they are.

    The verdict is computed beside the text in the same pass, so nothing is joined back.
    """
    import pyarrow as pa

    small_batches(docs.sparkSession)
    schema, at = docs.schema, docs.columns.index(text_col)
    measure = row_measurer()

    def run(batches):
        for whole in batches:
            for i in range(0, whole.num_rows, 256):
                b = whole.slice(i, 256)
                yield b.filter(pa.array([measure(t)[6] for t in b.column(at).to_pylist()], pa.bool_()))

    return docs.mapInArrow(run, schema)


def op9_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_rules(table(spark, sf_dir, "documents"))
