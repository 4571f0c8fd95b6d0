"""License scans: exact set-similarity join of text blocks with license templates, in DataFrame operations only.

A block is a run of consecutive words of a text, whatever its lines: for a template of up to m words, repeats included, runs of
2m words or more (a power of two) that start every half run, so a notice that stands in a text lies whole in some run, however
it is wrapped and however long the text is. A block meets a template if it holds at least THRESHOLD of the template's
distinct words. Words are ordered by their frequency over the whole corpus, rarest first; a block that meets a template
shares a word of its prefix, is long enough (length filter), and can still reach the needed overlap from the positions of
the shared word (positional filter). All three are necessary conditions, so no block is missed. What holds for a block holds for
its text, so whole texts are joined first, by the words they share with any template, and only texts that pass are cut into blocks.

The corpus is scanned once for words, phrases and shared words, written as a small table; frequencies are counted in that, and the second
scan reads texts only where the first left candidates. The template side is a fixed list, a few kilobytes whatever the corpus, and is
broadcast; texts are never shuffled for it unless the candidates outgrow MOST_BROADCAST.

Edge cases: a null text counts as empty: no words, no label, score 0. Rows that repeat an id, and rows with a null id, are
judged by their own texts. Other columns are ignored.
"""

from __future__ import annotations

import math
import re

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from assayloom.llm._shared import table, written

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
SEPARATORS = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
THRESHOLD, LEAST_RUN = 0.9, 16
#: Candidate rows (an id and a key) that are broadcast at most, some 10 MB.
MOST_BROADCAST = 250_000
#: The phrases and their labels.
PHRASES = (("apache license", "apache"), ("general public license", "gpl"), ("mit license", "mit"))
#: Notices and license grants as their publishers word them, and the short forms that stand in for them.
TEMPLATES = (
    ("agpl", "licensed under the GNU Affero General Public License"),
    ("agpl", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU Affero General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version."),
    ("apache", "Licensed under the Apache License, Version 2.0"),
    ("apache", "you may not use this file except in compliance with the License. You may obtain a copy of the License at apache.org licenses LICENSE-2.0"),
    ("apache", "Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an \"AS IS\" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License."),
    ("boost", "Permission is hereby granted, free of charge, to any person or organization obtaining a copy of the software and accompanying documentation covered by this license (the \"Software\") to use, reproduce, display, distribute, execute, and transmit the Software, and to prepare derivative works of the Software"),
    ("bsd", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met"),
    ("bsd", "Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution."),
    ("bsd", "Released under the BSD 3-Clause License"),
    ("cc", "Licensed under CC BY 4.0"),
    ("cc", "Licensed under CC BY-NC 4.0"),
    ("cc", "Licensed under CC BY-SA 4.0"),
    ("cc", "This work is licensed under a Creative Commons Attribution 4.0 International License"),
    ("cc", "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License"),
    ("cc", "The person who associated a work with this deed has dedicated the work to the public domain by waiving all of his or her rights to the work worldwide under copyright law"),
    ("gpl", "licensed under the GNU General Public License, version 3"),
    ("gpl", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation"),
    ("gpl", "This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU General Public License for more details."),
    ("isc", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies."),
    ("isc", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted"),
    ("lgpl", "licensed under the GNU Lesser General Public License"),
    ("lgpl", "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation"),
    ("mit", "Released under the MIT License"),
    ("mit", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files, to deal in the Software without restriction"),
    ("mit", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions: The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software."),
    ("mpl", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0"),
    ("mpl", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at mozilla.org MPL 2.0"),
    ("unlicense", "This is free and unencumbered software released into the public domain"),
    ("zlib", "Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely, subject to the following restrictions"),
)


def word_list(text: str) -> list[str]:
    return [w for w in re.split(SEPARATORS, text.translate(str.maketrans(UPPER, LOWER))) if w]


def template_words(text: str) -> list[str]:
    return sorted(set(word_list(text)))


def run_of(text: str) -> int:
    """The length of the runs that a template is compared with."""
    return max(LEAST_RUN, 1 << (2 * len(word_list(text)) - 1).bit_length())


def words_of(text: Column) -> Column:
    """The words joined by single spaces, without spaces around them."""
    return F.trim(F.regexp_replace(F.translate(text, UPPER, LOWER), SEPARATORS, " "))


def spaces(text: Column) -> Column:
    return F.length(text) - F.length(F.replace(text, F.lit(" "), F.lit("")))


def base_columns(docs: DataFrame, id_col: str, text_col: str, vocabulary: list[str]) -> DataFrame:
    """Words, and the places of the phrases, of each row; ``own``: its distinct words that occur in templates; ``key`` tells rows of one id apart."""
    plain = docs.select(id_col, F.xxhash64(F.coalesce(text_col, F.lit(""))).alias("key"), words_of(F.coalesce(text_col, F.lit(""))).alias("plain"))
    n_words = F.when(F.length("plain") == 0, 0).otherwise(spaces(F.col("plain")) + 1).cast("long")
    padded = plain.select(id_col, "key", n_words.alias("n_words"), F.concat(F.lit(" "), "plain", F.lit(" ")).alias("padded"))
    counts, firsts, lasts, labels = [], [], [], []
    for phrase, label in PHRASES:
        mark = F.lit(f" {phrase} ")
        there = F.contains("padded", mark)
        counts.append(F.when(there, F.regexp_count("padded", F.lit(f" {phrase}(?= )"))).otherwise(0).cast("long"))
        firsts.append(F.when(there, spaces(F.substring_index("padded", f" {phrase} ", 1))).cast("long"))
        lasts.append(F.when(there, F.col("n_words") - spaces(F.substring_index("padded", f" {phrase} ", -1)) - len(phrase.split())).cast("long"))
        labels.append(F.when(there, label))
    return padded.select(
        id_col,
        "key",
        "n_words",
        sum(counts[1:], counts[0]).alias("n_base"),
        F.least(*firsts).alias("first_word"),
        F.greatest(*lasts).alias("last_word"),
        F.array_compact(F.array(*labels)).alias("base"),
        F.array_intersect(F.split("padded", " "), F.array(*map(F.lit, vocabulary))).alias("own"),
    )


def met(blocks: DataFrame, prefixes: DataFrame, ranks: Column, by_run: bool) -> DataFrame:
    """The columns of ``blocks`` (with ``own``, and ``run`` where ``by_run``) with each template they meet, its label and the containment."""
    size = F.size("own")
    each = blocks.withColumn("word", F.explode("own"))
    both = each.join(F.broadcast(prefixes), ["word", "run"] if by_run else "word").where(size >= F.col("need"))
    at_b = F.size(F.filter("own", lambda w: F.array_position(ranks, w) <= F.array_position(ranks, F.col("word"))))
    bound = F.least("at_t", at_b) + F.least(F.col("m") - F.col("at_t"), size - at_b)
    found = both.where(bound >= F.col("need")).withColumn("overlap", F.size(F.array_intersect("own", "words"))).where(F.col("overlap") >= F.col("need"))
    return found.withColumn("containment", F.col("overlap") / F.col("m"))


def template_hits(docs: DataFrame, base: DataFrame, id_col: str, text_col: str, templates=TEMPLATES, threshold: float = THRESHOLD) -> DataFrame:
    """(id, key, run, start, label, containment) for every run of words and template with at least ``threshold`` of its words in the run.

    ``base``: the written table of ``base_columns``.
    """
    spark = docs.sparkSession
    sets = [(i, label, run_of(text), words, math.ceil(threshold * len(words) - 1e-9)) for i, (label, text) in enumerate(templates) for words in [template_words(text)]]
    vocabulary = sorted({w for *_, words, _ in sets for w in words})
    shortest = min(need for *_, need in sets)

    # frequency by texts over the whole corpus, of the words that templates use: a bounded table
    often = {r["word"]: r["count"] for r in base.select(F.explode("own").alias("word")).groupBy("word").count().collect()}
    order = sorted(vocabulary, key=lambda w: (often.get(w, 0), w))
    place = {w: i for i, w in enumerate(order)}
    prefix = []
    for i, label, run, words, need in sets:
        ranked = sorted(words, key=place.__getitem__)
        prefix += [(w, i, label, run, at, len(ranked), need, ranked) for at, w in enumerate(ranked[: len(ranked) - need + 1], 1)]
    prefixes = spark.createDataFrame(prefix, "word string, template int, label string, run int, at_t int, m int, need int, words array<string>")
    ranks = F.array(*map(F.lit, order))

    texts = base.where(F.size("own") >= shortest)
    wanted = written(met(texts.select(F.col(id_col).alias("__id"), F.col("key").alias("__key"), "own"), prefixes, ranks, False).groupBy("__id", "__key").agg(F.array_sort(F.collect_set("run")).alias("runs")), "wanted")
    wanted = F.broadcast(wanted) if wanted.count() <= MOST_BROADCAST else wanted
    keyed = docs.select(F.col(id_col).alias(id_col), F.col(text_col).alias("text"), F.xxhash64(F.coalesce(text_col, F.lit(""))).alias("key"))
    some = keyed.join(wanted, (F.col("key") == F.col("__key")) & F.col(id_col).eqNullSafe(F.col("__id"))).select(id_col, "key", "runs", F.split(words_of(F.col("text")), " ").alias("all"))
    starts = some.select("*", F.explode("runs").alias("run")).select("*", F.explode(F.sequence(F.lit(0), F.size("all") - 1, (F.col("run") / 2).cast("int"))).alias("start"))
    # a word outside every template adds nothing to any overlap
    own = F.array_intersect(F.slice("all", F.col("start") + 1, F.col("run")), F.array(*map(F.lit, vocabulary)))
    blocks = starts.select(id_col, "key", "run", "start", own.alias("own")).where(F.size("own") >= shortest)
    return met(blocks, prefixes, ranks, True).select(id_col, "key", "run", "start", "label", "containment")


def license_scans(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row for each of ``docs``: phrase places, labels of phrases and templates, and the best containment."""
    base = written(base_columns(docs, id_col, text_col, sorted({w for _, t in TEMPLATES for w in template_words(t)})), "base")
    hits = template_hits(docs, base, id_col, text_col).groupBy(F.col(id_col).alias("__id"), F.col("key").alias("__key")).agg(F.collect_set("label").alias("found"), F.max("containment").alias("best"))
    hits = written(hits, "hits")
    every = F.array_sort(F.array_distinct(F.concat("base", F.coalesce("found", F.array().cast("array<string>")))))
    return base.join(hits, (F.col("key") == F.col("__key")) & F.col(id_col).eqNullSafe(F.col("__id")), "left").select(
        id_col, "n_words", "n_base", "first_word", "last_word", F.array_join("base", ",").alias("base_labels"), F.array_join(every, ",").alias("labels"), F.coalesce("best", F.lit(0.0)).alias("score")
    )


def op8_license_scans(spark: SparkSession, sf_dir: str) -> DataFrame:
    return license_scans(table(spark, sf_dir, "documents"))


def oracle() -> str:
    """The same result in DuckDB, from word lists and all runs against all templates."""
    rows = ", ".join(f"('{label}', {template_words(text)!r}, {run_of(text)})" for label, text in TEMPLATES)
    plain = f"trim(regexp_replace(translate({{}}, '{UPPER}', '{LOWER}'), '{SEPARATORS}', ' ', 'g'))"
    places = []
    for phrase, label in PHRASES:
        w = phrase.split()
        test = " and ".join(f"words[i + {k}] = '{x}'" for k, x in enumerate(w))
        places.append(f"list_filter(range(1, len(words) + 1), lambda i: {test}) as {label}")
    return f"""
with docs as (select doc_id, coalesce(text, '') as text from documents),
split as (select doc_id, case when {plain.format("text")} = '' then [] else string_split({plain.format("text")}, ' ') end as words from docs),
found as (select doc_id, len(words) as n_words, {", ".join(places)} from split),
base as (
  select doc_id, n_words, list_concat(apache, list_concat(gpl, mit)) as places,
    list_filter([case when len(apache) > 0 then 'apache' end, case when len(gpl) > 0 then 'gpl' end, case when len(mit) > 0 then 'mit' end], lambda x: x is not null) as base
  from found),
templates(label, words, run) as (values {rows}),
runs as (select doc_id, words, run, unnest(range(0, greatest(len(words), 1), run // 2)) as start from split cross join (select distinct run from templates)),
blocks as (select doc_id, run, list_distinct(words[start + 1 : start + run]) as words from runs),
hits as (select b.doc_id, t.label, len(list_intersect(b.words, t.words)) / len(t.words)::double as containment from blocks b join templates t using (run)),
method as (select doc_id, list(distinct label) as found, max(containment) as best from hits where containment >= {THRESHOLD} group by doc_id)
select doc_id, n_words::bigint as n_words, len(places)::bigint as n_base, (list_min(places) - 1)::bigint as first_word, (list_max(places) - 1)::bigint as last_word,
  array_to_string(base, ',') as base_labels, array_to_string(list_sort(list_distinct(list_concat(base, coalesce(found, [])))), ',') as labels, coalesce(best, 0.0)::double as score
from base left join method using (doc_id)
"""
