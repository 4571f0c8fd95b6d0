"""Comparisons of runs, arms and parses, gates over their outcomes, and labels and columns derived from metadata."""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from assayloom.functions.tables import once, stored


def set_run_stability(runs: DataFrame, alpha: float = 0.25) -> DataFrame:
    """Pairs of runs (run_id, set_id, nes, fdr_q): common sets, correlation of scores, sets significant in both and in either."""
    a, b = (runs.select(F.col("run_id").alias(f"run_{x}"), "set_id", F.col("nes").alias(f"nes_{x}"), (F.col("fdr_q") < alpha).alias(f"sig_{x}")) for x in "ab")
    j = a.join(b, "set_id").where("run_a < run_b")
    both, either = F.count_if(F.col("sig_a") & F.col("sig_b")), F.count_if(F.col("sig_a") | F.col("sig_b"))
    return j.groupBy("run_a", "run_b").agg(F.count(F.lit(1)).alias("n_common"), F.round(F.corr("nes_a", "nes_b"), 6).alias("r"), both.alias("sig_both"), either.alias("sig_any"))


def stability_gate(runs: DataFrame, alpha: float = 0.05, least_r: float = 0.99, least_jaccard: float = 0.95, expected: int = 3) -> DataFrame:
    """Whether all pairs of runs (run_id, feature_id, log2fc, padj) agree enough; one row.

    ``complete``: the ``expected`` runs are there, and each has every feature with an effect that any has. What isn't complete isn't stable.
    """
    a, b = (runs.select(F.col("run_id").alias(f"run_{x}"), "feature_id", F.col("log2fc").alias(f"fc_{x}"), (F.col("padj") < alpha).alias(f"sig_{x}")) for x in "ab")
    jaccard = F.try_divide(F.count_if(F.col("sig_a") & F.col("sig_b")), F.count_if(F.col("sig_a") | F.col("sig_b")))
    p = a.join(b, "feature_id").where("run_a < run_b").groupBy("run_a", "run_b").agg(F.corr("fc_a", "fc_b").alias("r"), jaccard.alias("j"))
    n = runs.where(F.col("log2fc").isNotNull()).groupBy("feature_id").agg(F.countDistinct("run_id").alias("k")).agg(F.min("k").alias("fewest"))
    there = runs.agg(F.countDistinct("run_id").alias("n_runs")).crossJoin(n)  # one row each
    complete = (F.col("n_runs") >= expected) & (F.col("fewest") == F.col("n_runs"))
    pairs = p.agg(F.count(F.lit(1)).alias("n_pairs"), F.min("r").alias("r"), F.min("j").alias("j")).crossJoin(there.select("n_runs", F.coalesce(complete, F.lit(False)).alias("complete")))
    return pairs.select("n_pairs", "n_runs", "complete", F.round("r", 6).alias("least_r"), F.round("j", 6).alias("least_jaccard"), (F.col("complete") & F.coalesce((F.col("r") >= least_r) & (F.col("j") >= least_jaccard), F.lit(False))).alias("stable"))


def arm_comparison(a: DataFrame, b: DataFrame, alpha: float = 0.05, close: float = 1e-3) -> DataFrame:
    """Two results (feature_id, log2fc, padj) of the same contrast: common features, close effects, significance in both or one; one row."""
    x, y = (d.select("feature_id", F.col("log2fc").alias(f"fc_{k}"), (F.col("padj") < alpha).alias(f"sig_{k}")) for k, d in (("a", a), ("b", b)))
    sig_a, sig_b = F.col("sig_a"), F.col("sig_b")
    return x.join(y, "feature_id").agg(F.count(F.lit(1)).alias("n_common"), F.count_if(F.abs(F.col("fc_a") - F.col("fc_b")) < close).alias("n_close"), F.count_if(sig_a & sig_b).alias("sig_both"), F.count_if(sig_a != sig_b).alias("sig_one"))


def route_decisions(decisions: DataFrame) -> DataFrame:
    """What happens to each decision, by its status and confidence."""
    blocked, sure = F.col("decision_status") == "blocked", F.col("confidence") == "high"
    return decisions.select("case_id", "stage", "seq", F.when(blocked & sure, "refuse").when(blocked, "override").when(sure, "confident").otherwise("confirm").alias("route"))


def production_gate(decisions: DataFrame, least: int = 2) -> DataFrame:
    """The checks of each case, and which of them block it."""
    o = decisions.groupBy("case_id").agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("decision_status") == "blocked").alias("b"))
    checks = {"enough_records": F.col("n") >= least, "unblocked": F.col("b") == 0}
    return o.select("case_id", *(c.alias(n) for n, c in checks.items()), F.array_join(F.array_compact(F.array(*(F.when(~c, n) for n, c in checks.items()))), ",").alias("blocking"))


def parse_comparison(a: DataFrame, b: DataFrame) -> DataFrame:
    """Blocks by paper and section class of two parses."""
    n = lambda blocks, c: blocks.groupBy("paper_id", "section_class").agg(F.count(F.lit(1)).alias(c))
    j = n(a, "n_first").join(n(b, "n_second"), ["paper_id", "section_class"], "full_outer")
    return j.select("paper_id", "section_class", F.coalesce("n_first", F.lit(0)).alias("n_first"), F.coalesce("n_second", F.lit(0)).alias("n_second")).withColumn("same", F.col("n_first") == F.col("n_second"))


def normal_cell(text: Column) -> Column:
    """A cell or text without emphasis and white space, in lower case, with plain signs."""
    bare = F.regexp_replace(F.lower(F.coalesce(text, F.lit(""))), r"[*_`\\]", "")
    for sign, by in (("\u2212", "-"), ("\u2013", "-"), ("\u00b1", "+-")):
        bare = F.replace(bare, F.lit(sign), F.lit(by))
    return F.regexp_replace(bare, r"\s+", "")


def cells_of(text: Column) -> Column:
    """The normal cells of a table of pipes; rules, empty cells and single dashes don't count."""
    lines = F.filter(F.split(text, "\n"), lambda x: x.startswith("|") & ~x.rlike(r"^\|[-:\s|]+$"))
    raw = F.flatten(F.transform(lines, lambda x: F.split(F.regexp_replace(F.trim(x), r"^\|+|\|+$", ""), r"\|")))
    return F.filter(F.transform(raw, normal_cell), lambda c: ~c.isin("", "-"))


def table_cells(tables: DataFrame) -> DataFrame:
    """(paper_id, table_id, cell, n): how often a cell stands in a table of pipes."""
    return tables.select("paper_id", "table_id", F.explode(cells_of(F.col("text"))).alias("cell")).groupBy("paper_id", "table_id", "cell").agg(F.count(F.lit(1)).alias("n"))


#: Tables of a tile beyond which a cell is frequent, and about how many cells of either parse meet in a task.
FREQUENT, TILE_CELLS = 64, 1 << 21


def table_match(first: DataFrame, second: DataFrame, frequent: int = FREQUENT, tile: int = TILE_CELLS) -> DataFrame:
    """(paper_id, table_id, n_cells, match_id, share): for each table of one parse the table of the other that holds most of its cells.

    A table is one row with its cells as a string. Both parses of a paper are cut into tiles of about ``tile`` cells, each pair of tiles is
    matched in a task (``matched``), and the best of a table's tiles counts, so pairs of tables are never written. The first by id wins a tie, and
    a table without any match has a share of 0. Tables without cells have no row.
    """
    kind, keys = first.schema["paper_id"].dataType.simpleString(), ["paper_id", "table_id"]
    whole = lambda df: stored(df.groupBy(*keys).agg(F.flatten(F.collect_list(cells_of(F.col("text")))).alias("c")).where(F.size("c") > 0).select(*keys, F.array_join("c", "|").alias("cells"), F.size("c").alias("size")))
    a, b = whole(first), whole(second.select(F.col("paper_id").cast(kind).alias("paper_id"), "table_id", "text"))
    parts = lambda df, name: df.groupBy("paper_id").agg(F.ceil(F.sum("size") / tile).cast("int").alias(name))
    counts = once(parts(a, "parts_a").join(parts(b, "parts_b"), "paper_id", "left").select("paper_id", "parts_a", F.coalesce("parts_b", F.lit(1)).alias("parts_b")))
    of = lambda n: F.pmod(F.xxhash64("table_id"), F.col(n)).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    a = a.join(F.broadcast(counts), "paper_id").select("paper_id", of("parts_a").alias("at"), every("parts_b").alias("tile"), "table_id", "cells")
    b = b.join(F.broadcast(counts), "paper_id").select("paper_id", every("parts_a").alias("at"), of("parts_b").alias("tile"), "table_id", "cells")
    pair = ["paper_id", "at", "tile"]

    def match(x: pa.Table, y: pa.Table) -> pa.Table:
        order = pc.sort_indices(y.column("table_id"))  # by bytes, as Spark compares
        ids = y.column("table_id").take(order)
        n, k, best = matched(split_cells(x.column("cells")), split_cells(y.column("cells").take(order)), frequent)
        return pa.table({"paper_id": x.column("paper_id"), "table_id": x.column("table_id"), "n_cells": pa.array(n), "k": pa.array(k), "match_id": ids.take(pa.array(best, mask=k == 0)) if len(ids) else pa.nulls(len(n), pa.string())})

    told = a.groupBy(*pair).cogroup(b.groupBy(*pair)).applyInArrow(match, f"paper_id {kind}, table_id string, n_cells bigint, k bigint, match_id string")
    best = told.groupBy(*keys).agg(F.max("n_cells").alias("n_cells"), F.min(F.when(F.col("k") > 0, F.struct((-F.col("k")).alias("k"), "match_id"))).alias("m"))
    return best.select(*keys, "n_cells", F.col("m.match_id").alias("match_id"), F.round(F.coalesce(-F.col("m.k"), F.lit(0)) / F.col("n_cells"), 6).alias("share"))


def split_cells(cells: pa.ChunkedArray) -> tuple[pa.Array, np.ndarray]:
    """All cells and the row of each."""
    lists = pc.split_pattern(cells.combine_chunks(), "|")
    return lists.flatten(), np.repeat(np.arange(len(lists)), pc.list_value_length(lists).to_numpy(zero_copy_only=False))


#: Rows of the first parse whose pairs are held at once.
ROWS_AT_ONCE = 1 << 15


def matched(first: tuple[pa.Array, np.ndarray], second: tuple[pa.Array, np.ndarray], frequent: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For each row of ``first`` its number of cells, the most of them that a row of ``second`` holds, and the earliest such row.

    Rows meet at cells that at most ``frequent`` rows of ``second`` hold; frequent cells are added for the pairs that met. A row that met none
    holds no more than the frequent cells, so a match with more is settled. For the rest, rows with the same frequent cells are one, and
    all rows of ``second`` are counted at once with a bit each (``most_held``).
    """
    (cells, row), (cells_b, row_b) = first, second
    n_rows, n_b = int(row[-1]) + 1 if len(row) else 0, int(row_b[-1]) + 1 if len(row_b) else 0
    size = np.bincount(row, minlength=n_rows)
    k, best = np.zeros(n_rows, dtype=np.int64), np.zeros(n_rows, dtype=np.int64)
    if not n_b:
        return size, k, best
    words = pc.unique(cells_b)
    code = pc.index_in(cells, value_set=words)
    known = code.is_valid().to_numpy(zero_copy_only=False)
    # a cell of a row once, with how often it stands there
    key, n = np.unique(row[known] * len(words) + code.drop_null().to_numpy(), return_counts=True)
    row, code = key // len(words), key % len(words)
    key_b = np.unique(pc.index_in(cells_b, value_set=words).to_numpy() * np.int64(n_b) + row_b)
    held = np.bincount(key_b // n_b, minlength=len(words))
    start, rows_b = np.concatenate([[0], np.cumsum(held)]), key_b % n_b
    often = held[code] > frequent
    common = np.bincount(row[often], n[often], minlength=n_rows).astype(np.int64)
    for low in range(0, n_rows, ROWS_AT_ONCE):
        at = slice(*np.searchsorted(row, (low, low + ROWS_AT_ONCE)))
        r, c, w, f = row[at] - low, code[at], n[at], often[at]
        times = held[c[~f]]
        place = np.arange(times.sum()) - np.repeat(np.cumsum(times) - times, times) + np.repeat(start[c[~f]], times)
        pairs, which = np.unique(np.repeat(r[~f], times) * n_b + rows_b[place], return_inverse=True)
        got = np.bincount(which, np.repeat(w[~f], times), minlength=len(pairs)).astype(np.int64)
        pr, pb = pairs // n_b, pairs % n_b
        # frequent cells of the pairs that met
        first_f, many = np.searchsorted(r[f], pr), np.bincount(r[f], minlength=ROWS_AT_ONCE)[pr]
        place = np.arange(many.sum()) - np.repeat(np.cumsum(many) - many, many) + np.repeat(first_f, many)
        wanted = c[f][place] * n_b + np.repeat(pb, many)
        there = key_b[np.minimum(np.searchsorted(key_b, wanted), len(key_b) - 1)] == wanted
        got += np.bincount(np.repeat(np.arange(len(pairs)), many), w[f][place] * there, minlength=len(pairs)).astype(np.int64)
        order = np.lexsort((pb, -got, pr))
        lead = order[np.flatnonzero(np.diff(pr[order], prepend=-1))]
        k[low + pr[lead]], best[low + pr[lead]] = got[lead], pb[lead]
    mine = often & ((common > 0) & (k <= common))[row]
    r, c, w = row[mine], code[mine], n[mine]
    begin = np.flatnonzero(np.diff(r, prepend=-1))
    asked: dict[bytes, tuple[int, int]] = {}
    kept: dict[int, np.ndarray] = {}

    def bits(c: int) -> np.ndarray:
        if c in kept:
            return kept[c]
        flags = np.zeros(-(-n_b // 64) * 64, dtype=bool)
        flags[rows_b[start[c] : start[c + 1]]] = True
        out = np.packbits(flags).view(np.uint64)
        if held[c] * 64 >= n_b:  # no larger than the cell's list of rows
            kept[c] = out
        return out

    for x, y in zip(begin, np.append(begin, len(r))[1:], strict=True):
        name = c[x:y].tobytes() + w[x:y].tobytes()
        if name not in asked:
            asked[name] = most_held([bits(v) for v in c[x:y].tolist()], w[x:y].tolist())
        (most, where), i = asked[name], r[x]
        if most > k[i] or (most == k[i] > 0 and where < best[i]):
            k[i], best[i] = most, where
    return size, k, best


def most_held(bits: list[np.ndarray], weights: list[int]) -> tuple[int, int]:
    """The largest sum of weights that a place has over the bitmaps in which it is set, and the first place that has it."""
    every = bits[0]
    for x in bits[1:]:
        every = every & x
    if every.any():
        return sum(weights), first_bit(every)
    planes: list[np.ndarray] = []  # sums of all places, a bit of them each
    for x, w in zip(bits, weights, strict=True):
        for shift in range(w.bit_length()):
            carry, i = x, shift
            while w >> shift & 1 and carry.any():
                while len(planes) <= i:
                    planes.append(np.zeros_like(x))
                planes[i], carry, i = planes[i] ^ carry, planes[i] & carry, i + 1
    most, top = 0, None
    for i in reversed(range(len(planes))):
        x = planes[i] if top is None else top & planes[i]
        if x.any():
            most, top = most | 1 << i, x
    return most, first_bit(top) if most else 0


def first_bit(bits: np.ndarray) -> int:
    at = int((bits != 0).argmax()) * 8
    each = bits.view(np.uint8)[at : at + 8]
    byte = int((each != 0).argmax())
    return (at + byte) * 8 + 8 - int(each[byte]).bit_length()


def accession_comparison(first: DataFrame, second: DataFrame) -> DataFrame:
    """(paper_id, accession, first_classes, second_classes, found, same_class): in which section classes two parses hold each accession.

    Both have paper_id, accession and section_class. ``same_class`` is NULL where the first parse lacks it.
    """
    of = lambda x, name: x.groupBy("paper_id", "accession").agg(F.array_sort(F.collect_set("section_class")).alias(name))
    j = of(first, "a").join(of(second, "b"), ["paper_id", "accession"], "full_outer")
    return j.select("paper_id", "accession", F.coalesce(F.array_join("a", ","), F.lit("")).alias("first_classes"), F.coalesce(F.array_join("b", ","), F.lit("")).alias("second_classes"), F.col("b").isNotNull().alias("found"), F.when(F.col("a").isNotNull(), F.coalesce(F.arrays_overlap("a", "b"), F.lit(False))).alias("same_class"))


def result_sanity(results: DataFrame, samples: DataFrame, alpha: float = 0.05, most: float = 0.5, least_arm: int = 3) -> DataFrame:
    """Share of significant features by study and method, the smallest arm, and flags for either."""
    s = samples.groupBy("study_id", "condition").agg(F.count(F.lit(1)).alias("n")).groupBy("study_id").agg(F.min("n").alias("arm"))
    d = results.groupBy("study_id", "method").agg(F.round(F.count_if(F.col("padj") < alpha) / F.count("padj"), 6).alias("share"))
    flags = F.array_compact(F.array(F.when(F.col("share") > most, "most features significant"), F.when(F.col("arm") < least_arm, "small arm")))
    return d.join(s, "study_id").select("study_id", "method", "share", "arm", F.array_join(flags, ";").alias("flags"))


def gold_dedupe(rows: DataFrame, key: str, order: str, labels: list[str]) -> DataFrame:
    """One row a sample: of every other column the distinct values in the order of ``order``, joined, how many rows it had, and whether labels contradict.

    A sample's rows are few; values that are NULL don't count.
    """
    values = lambda c: F.array_join(F.array_distinct(F.transform(F.array_sort(F.collect_list(F.struct(F.col(order).alias("o"), F.col(c).cast("string").alias("v")))), lambda x: x["v"])), ";")
    others = [c for c in rows.columns if c not in (key, order)]
    conflict = F.greatest(*(F.countDistinct(c) for c in [*labels, labels[0]])) > 1
    return rows.groupBy(key).agg(*(values(c).alias(c) for c in others), F.count(F.lit(1)).alias("n"), conflict.alias("conflict"))


def planted_recovery(results: DataFrame, planted, hit) -> DataFrame:
    """By study how many planted features are found, and the share of the others that are."""
    return results.groupBy("study_id").agg(
        F.count_if(planted).alias("n_planted"), F.count_if(planted & hit).alias("n_found"), F.round(F.try_divide(F.count_if(planted & hit), F.count_if(planted)), 6).alias("sensitivity"), F.round(F.try_divide(F.count_if(~planted & hit), F.count_if(~planted)), 6).alias("false_rate")
    )


def series_summary(samples: DataFrame, rest: str, exercise: str, stratum: str) -> DataFrame:
    """Arms and strata of each study, and whether subjects repeat."""
    design = F.when(F.countDistinct("subject") < F.count(F.lit(1)), "paired").otherwise("independent")
    arm = F.col("condition")
    return samples.groupBy("study_id").agg(F.count_if(arm == rest).alias("n_rest"), F.count_if(arm == exercise).alias("n_exercise"), F.countDistinct(stratum).alias("n_strata"), design.alias("design"))


def dataset_labels(attrs: DataFrame, many_attrs: int = 6, many_samples: int = 200) -> DataFrame:
    """Labels of each study by the size of its metadata."""
    n = attrs.groupBy("study_id").agg(F.countDistinct("attr").alias("k"), F.countDistinct("sample_id").alias("s"))
    said = F.array(F.when(F.col("k") >= many_attrs, "complex_metadata"), F.when(F.col("s") > many_samples, "large").otherwise("routine"))
    return n.select("study_id", F.array_join(F.array_compact(said), ";").alias("labels"))


#: Column names that speak of metadata; words of array platforms.
METADATA = ("age", "sex", "condition", "treatment", "title", "organism", "batch", "subject")
ARRAYS = r"affymetrix|microarray|hybridization|hybridisation|\.cel| cel |genechip|beadchip|agilent array"


def metadata_rejection(columns: DataFrame) -> DataFrame:
    """Tables (study_id, attr: a row a column) at least half of whose columns are named like metadata are no matrices."""
    c = columns.groupBy("study_id").agg(F.countDistinct("attr").alias("n_columns"), F.countDistinct(F.when(F.col("attr").isin(*METADATA), F.col("attr"))).alias("n_metadata"))
    return c.withColumn("rejected", F.col("n_metadata") * 2 >= F.col("n_columns"))


def assay_label(strategy: Column, text: Column) -> Column:
    """The library strategy as recorded, else array or sequencing by the words of the text."""
    array = F.lower(text).rlike(ARRAYS)
    return F.coalesce(strategy, F.when(array, "microarray gene expression profiling").otherwise("high-throughput sequencing"))


def derive_columns(
    samples: DataFrame,
    aliases: dict[str, str] | None = None,
    patterns: dict[str, tuple[str, str]] | None = None,
    combine: dict[str, list[str]] | None = None,
    recode: dict[str, dict[str, str]] | None = None,
    keys: tuple[str, ...] = ("study_id", "sample_id"),
) -> tuple[DataFrame, DataFrame]:
    """``samples`` with derived columns, and the errors (keys, column, value, reason); a caller goes on only where there are none.

    Copies, the first group of a pattern, recoded values, and values joined by ``_``, in this order; a joined column is recoded last.
    A pattern must match and a recoding must name the value of every row; nulls count as neither. Names must be fit for formulas.
    """
    aliases, patterns, combine, recode = aliases or {}, patterns or {}, combine or {}, recode or {}
    out, wrong = samples, []
    for name in (*aliases, *patterns, *combine):
        if not re.fullmatch(r"[A-Za-z_][A-Za-z0-9_]*", name):
            raise ValueError(f"{name!r} isn't a name for a formula")

    def known(*names: str) -> None:
        if lost := [n for n in names if n not in out.columns]:
            raise ValueError(f"no columns {lost}")

    def fail(column: str, value: str, bad: Column, reason: str) -> None:
        wrong.append(F.when(F.coalesce(bad, F.lit(True)), F.struct(F.lit(column).alias("column"), F.col(value).cast("string").alias("value"), F.lit(reason).alias("reason"))))

    def recoded(names: list[str]) -> None:
        nonlocal out
        for n in names:
            known(n)
            table = F.create_map(*(F.lit(x) for kv in recode[n].items() for x in kv))
            out = out.withColumn(f"__was_{n}", F.col(n)).withColumn(n, F.element_at(table, F.col(n).cast("string")))
            fail(n, f"__was_{n}", F.col(n).isNull(), "not mapped")

    for n, source in aliases.items():
        known(source)
        out = out.withColumn(n, F.col(source))
    for n, (source, pattern) in patterns.items():
        known(source)
        text = F.col(source).cast("string")
        out = out.withColumn(n, F.when(text.rlike(pattern), F.regexp_extract(text, pattern, 1)))
        fail(n, source, F.col(n).isNull(), "no match")
    recoded([n for n in recode if n not in combine])
    for n, sources in combine.items():
        known(*sources)
        out = out.withColumn(n, F.concat_ws("_", *sources))
    recoded([n for n in recode if n in combine])
    found = F.array_compact(F.array(*wrong)) if wrong else F.array().cast("array<struct<column:string,value:string,reason:string>>")
    errors = out.select(*keys, F.inline(found))
    return out.drop(*(f"__was_{n}" for n in recode)), errors
