"""Text evidence over blocks (paper_id, ord, block_id, section_class, text) and documents."""

from __future__ import annotations

from functools import reduce
from operator import or_

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from assayloom.functions.tables import once

#: Accession formats by repository.
REPOSITORIES = (
    ("geo", r"\bGSE\d{3,}\b"),
    ("pride", r"\bPXD\d{6}\b"),
    ("arrayexpress", r"\bE-[A-Z]{4}-\d+\b"),
    ("sra", r"\b(?:PRJNA\d{3,}|PRJEB\d{3,}|SRP\d{4,})\b"),
    ("gsa", r"\b(?:CRA\d{6}|HRA\d{6}|PRJCA\d{6})\b"),
    ("dbgap", r"\bphs\d{6}\b"),
)
#: What every accession of a repository holds; texts without it needn't be searched letter by letter.
HELD = {"geo": ("GSE",), "pride": ("PXD",), "arrayexpress": ("E-",), "sra": ("PRJNA", "PRJEB", "SRP"), "gsa": ("CRA", "HRA", "PRJCA"), "dbgap": ("phs",)}
#: Words near an accession that make it the paper's own, or somebody else's.
OWN_WORDS = (
    r"(?i)(have been|has been|were|was|are|is|been) (deposited|submitted|uploaded)|\bdeposited (in|at|to|under|with)|"
    r"we (have )?(deposited|submitted|uploaded)|generated (in|for|during) (this|the present|the current) stud|"
    r"(produced|reported|sequenced) (in|for) (this|the present|the current) stud|"
    r"data (from|of|for) this (study|article|paper)|(this|the present|the current) study (are|is) available"
)
CITED_WORDS = (
    r"(?i)(downloaded|obtained|retrieved|accessed|acquired|extracted|compiled)\b|publicly (available|accessible)|"
    r"public (data ?sets?|data|repositor)|previously (published|reported|described|deposited|generated)|"
    r"re-?analy[sz]|meta-?analy[sz]|re-?used?\b|from (a|the|our) (previous|prior|earlier|published)|(previous|prior|earlier) stud|"
    r"(data ?sets?|data|profiles?) (were |was )?(from|of) (the )?(GEO|Gene Expression Omnibus)|"
    r"available (from|in|at|on) (the )?(GEO|Gene Expression Omnibus)|published data|"
    r"(data ?sets?|data|profiles?) (from|of|by|published by|reported by) (the )?[A-Z][\w'-]+ et al"
)
#: Accessions of a list, a citation right after one, a reference mark right before one.
LISTED = r"\b(?:GSE|PXD|E-[A-Z]{4}-|PRJNA|SRP)\w*"
LIST_GAP = r"[\s,;/()\[\]]*(?i:(?:and|or|&)[\s,;()]*)?"
CITE_AFTER = r"^\s*[(\[]\s*[A-Z][A-Za-z'’-]+(?:\s+et\s+al\.?|\s+(?:and|&)\s+[A-Z][A-Za-z'’-]+)?,?\s*\(?(?:19|20)\d{2}[a-z]?\s*\)?\s*[)\];]"
REF_BEFORE = r"(\^\d+(?:[,–-]\^?\d+)*|\[\d+(?:[,–-]\d+)*\]|\(\d+(?:[,–-]\d+)*\))\s*[(\[]?\s*$"
#: Section classes by title, first match wins.
TITLES = (
    ("data_availability", r"(?i)data\b.{0,30}\b(availab|access|deposit|sharing)|availability of (data|materials)|accession (number|code)|code availab|data and code|data access|^data statement"),
    ("supplementary", r"(?i)supplement|supporting information|additional (file|information)"),
    ("methods", r"(?i)method|materials?\b|experimental (design|procedure|section|model)|study design|patients|participants|subjects|animals?\b|statistic|sample collection|protocol"),
    ("results", r"(?i)result|findings"),
    ("discussion", r"(?i)discussion"),
    ("conclusion", r"(?i)conclu"),
    ("introduction", r"(?i)introduction|background"),
    ("abstract", r"(?i)^\s*(abstract|summary)\s*$"),
)
CITED_SECTIONS = ("introduction", "discussion")
#: Words that say nothing about a pathway.
STOP = ("hallmark", "of", "the", "and", "or", "to", "in", "a", "an", "via", "by", "with", "pathway", "pathways", "signaling", "signalling", "response", "regulation", "process", "processes", "system", "activity", "metabolism", "metabolic", "function", "related")


def accessions(blocks: DataFrame) -> DataFrame:
    """Every accession of every block once, with its repository."""
    found = F.concat(*(_hits(repo, pattern) for repo, pattern in REPOSITORIES))
    return blocks.select("paper_id", "ord", "block_id", "section_class", "text", F.inline(found)).select("paper_id", "ord", "block_id", "section_class", "repo", "accession", "text")


def _hits(repo: str, pattern: str) -> Column:
    held = reduce(or_, (F.contains("text", F.lit(h)) for h in HELD[repo]))
    every = F.when(held, F.regexp_extract_all("text", F.lit(pattern), F.lit(0))).otherwise(F.array().cast("array<string>"))
    return F.transform(F.array_distinct(every), lambda a: F.struct(F.lit(repo).alias("repo"), a.alias("accession")))


def accession_index(blocks: DataFrame) -> DataFrame:
    """Accession to the ids of its blocks in their order."""
    ids = F.transform(F.sort_array(F.collect_list(F.struct("ord", "block_id"))), lambda x: x["block_id"])
    return accessions(blocks).groupBy("paper_id", "accession").agg(F.array_join(ids, ";").alias("blocks"))


def mention_class(blocks: DataFrame, many: int = 8) -> DataFrame:
    """own or cited for each accession of a paper: the words around its mentions first, then the sections they are in.

    The words are those of the sentence before the mention, at most 300 characters and not beyond the accession before it, and 80
    characters from its start. What stands before a list of accessions counts for each of them. A citation right after the accession
    makes it cited, a reference mark right before it too unless own words are there. A paper with more than ``many`` series keeps only
    those with own words.
    """
    a = accessions(blocks).withColumn("i", F.instr("text", F.col("accession")))
    a = a.withColumn("before", F.expr("substring(text, greatest(1, i - 300), i - greatest(1, i - 300))"))
    a = a.withColumn("head", F.regexp_replace("before", f"(?:{LISTED}{LIST_GAP})+$", ""))
    cut = F.regexp_replace(F.substring_index("head", ". ", -1), f"(?s)^.*{LISTED}", "")
    window = F.concat(cut, F.expr("substring(before, length(head) + 1)"), F.expr("substring(text, i, 80)"))
    after, near = F.expr("substring(text, i + length(accession), 60)"), F.expr("right(before, 40)")
    phrase = F.when(after.rlike(CITE_AFTER), "cited").when(window.rlike(OWN_WORDS), "own").when(window.rlike(CITED_WORDS) | near.rlike(REF_BEFORE), "cited").otherwise("")
    p = a.withColumn("phrase", phrase).groupBy("paper_id", "repo", "accession").agg(
        F.bool_or(F.col("phrase") == "own").alias("said_own"), F.bool_or(F.col("phrase") == "cited").alias("said_cited"), F.bool_and(F.col("section_class").isin(*CITED_SECTIONS)).alias("only_cited_sections"), F.count(F.lit(1)).alias("n_mentions")
    )
    kind = F.when(F.col("said_own"), "own").when(F.col("said_cited") | F.col("only_cited_sections"), "cited").otherwise("own")
    n = F.count_if((F.col("kind") == "own") & (F.col("repo") == "geo")).over(Window.partitionBy("paper_id"))
    p = p.withColumn("kind", kind).withColumn("n_own", n)
    final = F.when((F.col("repo") == "geo") & (F.col("n_own") > many) & ~F.col("said_own"), "cited").otherwise(F.col("kind"))
    return p.select("paper_id", "repo", "accession", "n_mentions", final.alias("kind"))


def normal(c: Column) -> Column:
    """Small letters, plain quotes and dashes, single spaces."""
    return F.lower(F.trim(F.regexp_replace(F.translate(c, "‘’‛“”–—−", "'''\"\"---"), r"\s+", " ")))


def verify_quotes(quotes: DataFrame, docs: DataFrame) -> DataFrame:
    """Whether each quote (paper_id, quote_id, quote) stands in its paper: as a whole, or all of its two or more fragments around ellipses."""
    d = docs.select("paper_id", normal(F.col("text")).alias("body"))
    j = quotes.join(d, "paper_id").withColumn("q", normal(F.col("quote")))
    parts = F.filter(F.transform(F.split("quote", r"\.\s*\.\s*\.+|…+"), lambda x: normal(x)), lambda x: F.length(x) >= 8)
    whole = (F.col("q") == "") | F.contains("body", "q")
    ok = whole | ((F.size("parts") >= 2) & F.forall("parts", lambda x: F.contains(F.col("body"), x)))
    return j.withColumn("parts", parts).select("paper_id", "quote_id", ok.alias("verbatim"), F.when(whole & (F.length("q") >= 12), F.instr("body", F.col("q")) - 1).alias("offset"))


def provenance_rate(verified: DataFrame) -> DataFrame:
    return verified.groupBy("paper_id").agg(F.count(F.lit(1)).alias("n"), F.count_if("verbatim").alias("n_verified"), F.round(F.avg(F.col("verbatim").cast("double")), 6).alias("rate"))


def longest_core(words: list[str], body: str, least: int) -> str | None:
    """The longest run of two words or more, ``least`` characters or more, that stands in ``body``; the first of equals."""
    best, end = None, 0
    for start in range(len(words)):
        end = max(end, start + 1)
        if end == start + 1 and words[start] not in body:
            continue
        while end < len(words) and " ".join(words[start : end + 1]) in body:
            end += 1
        run = " ".join(words[start:end])
        if end - start >= 2 and len(run) >= least and len(run) > len(best or ""):
            best = run
    return best


def snap_quotes(quotes: DataFrame, docs: DataFrame, least: int = 24) -> DataFrame:
    """The longest run of words of each quote, of whatever length, that stands in its paper; quotes without one give no row."""
    import pandas as pd

    def core(quote, body):
        return pd.Series([longest_core(q.split(" "), b, least) for q, b in zip(quote, body, strict=True)], dtype=object)

    d = docs.where(F.col("text").isNotNull()).select("paper_id", normal(F.col("text")).alias("body"))
    j = quotes.where(F.col("quote").isNotNull()).select("paper_id", "quote_id", normal(F.col("quote")).alias("q")).join(d, "paper_id")
    found = j.select("paper_id", "quote_id", F.pandas_udf(core, "string", F.PandasUDFType.SCALAR)("q", "body").alias("core"))
    return found.where("core is not null").groupBy("paper_id", "quote_id").agg(F.max_by("core", F.struct(F.length("core"), "core")).alias("core"))


def find(blocks: DataFrame, terms: list[str], mode: str = "any", limit: int = 20, width: int = 160) -> DataFrame:
    """Blocks with any or all of the terms, at most ``limit`` a paper, with the text around the first term found."""
    low, at = F.lower("text"), [F.instr(F.lower("text"), t.lower()) for t in terms]
    hits = [(low.contains(t.lower())) for t in terms]
    keep = hits[0]
    for h in hits[1:]:
        keep = (keep & h) if mode == "all" else (keep | h)
    first = F.coalesce(*(F.when(a > 0, a) for a in at))
    start = F.greatest(F.lit(1), first - width // 2)
    snippet = F.expr(f"substring(text, start, {width})")
    w = Window.partitionBy("paper_id").orderBy("ord")
    return blocks.where(keep).withColumn("start", start).withColumn("place", F.row_number().over(w).cast("long")).where(F.col("place") <= limit).select("paper_id", "block_id", "place", snippet.alias("snippet"))


def section_class(title: Column) -> Column:
    out: Column = F.lit("other")
    for name, pattern in reversed(TITLES):
        out = F.when(title.rlike(pattern), name).otherwise(out)
    return out


def repeated_lines(docs: DataFrame) -> DataFrame:
    """Short lines of a document that repeat: three times, or twice if long enough and not a sentence."""
    lines = docs.select("paper_id", F.explode(F.transform(F.split("text", "\n"), lambda x: F.trim(x))).alias("line"))
    n = lines.where((F.length("line") > 0) & (F.length("line") <= 90) & ~F.col("line").startswith("|") & ~F.col("line").rlike(r"^#{1,6}\s") & ~F.col("line").rlike(r"^[-*_=\s]+$")).groupBy("paper_id", "line").agg(F.count(F.lit(1)).alias("n"))
    return n.where((F.col("n") >= 3) | ((F.col("n") == 2) & (F.length("line") >= 15) & ~F.col("line").rlike(r"[.!?]$")))


#: Fixed value: how a figure or table is named.
FLOAT = r"(?i)^\W*(table|figure|fig)\.?\s*(s?\d+[a-z]?)\b"


def float_label(text: Column) -> Column:
    """figure 2, table s1: the normal form of a float's name at the start of a text; NULL without."""
    kind = F.regexp_replace(F.lower(F.regexp_extract(text, FLOAT, 1)), "^fig$", "figure")
    return F.nullif(F.trim(F.concat_ws(" ", kind, F.lower(F.regexp_extract(text, FLOAT, 2)))), F.lit(""))


def resolve_locators(locators: DataFrame, blocks: DataFrame) -> DataFrame:
    """``locators`` (paper_id, locator) with the block they mean, if any: a block's id, else the first figure or table of that name. Case and spaces don't count."""
    ids = blocks.select("paper_id", F.lower("block_id").alias("key"), "block_id")
    floats = blocks.where(F.col("kind").isin("figure", "table")).select("paper_id", float_label(F.col("text")).alias("name"), "ord", "block_id").where("name is not null")
    floats = floats.groupBy("paper_id", "name").agg(F.min_by("block_id", "ord").alias("float_id"))
    l = locators.withColumn("key", F.lower(F.trim("locator"))).withColumn("name", float_label(F.col("locator")))  # noqa: E741
    j = l.join(ids, ["paper_id", "key"], "left").join(floats, ["paper_id", "name"], "left")
    return j.withColumn("block_id", F.coalesce("block_id", "float_id")).drop("key", "name", "float_id")


def resolve_rate(resolved: DataFrame) -> DataFrame:
    return resolved.groupBy("paper_id").agg(F.count(F.lit(1)).alias("n_locators"), F.count("block_id").alias("n_resolved"), F.round(F.count("block_id") / F.count(F.lit(1)), 6).alias("rate"))


def foreign_accessions(said: DataFrame, held: DataFrame) -> DataFrame:
    """Accessions of an output (paper_id, accession) that its paper's text doesn't hold; ``held`` are those that it does, as ``accessions`` finds them."""
    return said.join(held.select("paper_id", "accession").distinct(), ["paper_id", "accession"], "left_anti")


def outline(blocks: DataFrame) -> DataFrame:
    return blocks.groupBy("paper_id", "section_class").agg(F.count(F.lit(1)).alias("n_blocks"), F.sum(F.length("text")).alias("n_chars"), F.min("ord").alias("first_ord"))


def has_body(blocks: DataFrame, least: int = 5) -> DataFrame:
    return blocks.groupBy("paper_id").agg((F.count_if(F.col("section_class") != "abstract") >= least).alias("has_body"))


def select_sections(blocks: DataFrame, section: str, classes: list[str]) -> DataFrame:
    """Blocks of a section and those below it, or of some classes."""
    return blocks.where((F.col("section_id") == section) | F.col("section_id").startswith(f"{section}.") | F.col("section_class").isin(classes))


def pathway_named(sets: DataFrame, docs: DataFrame, least: float = 0.6) -> DataFrame:
    """Papers that name a set: enough of its distinctive words stand in the text, one with five letters or more."""
    words = F.array_distinct(F.filter(F.split(F.lower("set_id"), "[^a-z0-9]+"), lambda x: (F.length(x) >= 4) & ~x.isin(*STOP)))
    s = sets.select("set_id").distinct().select("set_id", words.alias("w")).where(F.size("w") > 0).select("set_id", F.size("w").alias("n"), F.explode("w").alias("word"))
    t = docs.select("paper_id", F.explode(F.array_distinct(F.split(F.lower("text"), "[^a-z0-9]+"))).alias("word"))
    hit = t.join(s, "word").groupBy("paper_id", "set_id", "n").agg(F.count(F.lit(1)).alias("k"), F.max(F.length("word")).alias("longest"))
    return hit.where((F.col("k") / F.col("n") >= least) & (F.col("longest") >= 5)).select("paper_id", "set_id", F.col("k").alias("n_words"))


def contrast_label(name: Column) -> Column:
    """The contrast in a result's file name."""
    for pattern in (r"\.csv$", r"_GSEA_.*$", r"(?i)__(deseq2|edger|limma[-_]voom|limma)$", r"^DEG_results_"):
        name = F.regexp_replace(name, pattern, "")
    return F.translate(F.regexp_replace(name, "_vs_", " vs "), "_", " ")


#: Length of a gram and grams of a window: two texts that share GRAM + WINDOW - 1 characters share the least gram of a window.
GRAM, WINDOW = 6, 7
#: Characters of a reference title that are looked for, and the fewest that count; the fewest of a running header.
TITLE_HEAD, LEAST_TITLE, LEAST_HEADER = 60, 40, 12
#: Patterns of a paper that are looked for in each of its blocks.
FEW = 64


def squeezed(text: Column) -> Column:
    """Text without white space, emphasis and case."""
    return F.regexp_replace(F.regexp_replace(F.lower(text), r"[*_`\\]", ""), r"\s+", "")


def ahead(items: str, k: int, f) -> Column:
    """``f`` of each item and the one ``k`` places on; the last ``k`` items have none."""
    n = F.greatest(F.size(items) - k, F.lit(0))
    return F.zip_with(F.slice(items, F.lit(1), n), F.slice(items, F.lit(k + 1), n), f)


def marked(rows: DataFrame, text: str) -> DataFrame:
    """``rows`` with ``__m``: the least hash of each WINDOW grams in a row, the same for the same stretch of text, wherever it stands.

    Grams of 6 and windows of 7 are put together from twos and fours, so the work is a few passes over the characters. Take the marks apart by
    explode_outer: a plain explode brings a filter on ``__m``, and pushing it down repeats the columns below many times over.
    """
    mix, least = lambda a, b: F.xxhash64(a, b), lambda a, b: F.least(a, b)
    rows = rows.withColumn("__1", F.transform(F.filter(F.split(text, ""), lambda c: c != ""), lambda c: F.xxhash64(c)))
    rows = rows.withColumn("__2", ahead("__1", 1, mix)).withColumn("__4", ahead("__2", 2, mix))
    n = F.greatest(F.size("__4") - 2, F.lit(0))
    rows = rows.withColumn("__g", F.zip_with(F.slice("__4", F.lit(1), n), F.slice("__2", F.lit(5), n), mix))
    rows = rows.withColumn("__2", ahead("__g", 1, least)).withColumn("__4", ahead("__2", 2, least))
    return rows.withColumn("__m", F.array_distinct(ahead("__4", 3, least))).drop("__1", "__2", "__4", "__g")


def met_by_marks(p: DataFrame, b: DataFrame) -> DataFrame:
    """(paper_id, kind, pattern, block_id): each pattern with the blocks (paper_id, block_id, body) of its paper that may hold it.

    It is looked up by the one of its marks that fewest blocks of its paper have, so texts and patterns meet by hash and a frequent word
    pairs nobody.
    """
    own = marked(p, "pattern").select("paper_id", "kind", "pattern", F.explode_outer("__m").alias("mark")).where("mark is not null")
    held = marked(b.join(p.select("paper_id").distinct(), "paper_id", "left_semi"), "body").select("paper_id", "block_id", F.explode_outer("__m").alias("mark")).where("mark is not null")
    held = once(held.join(own.select("paper_id", "mark").distinct(), ["paper_id", "mark"], "left_semi"))
    often = held.groupBy("paper_id", "mark").agg(F.count(F.lit(1)).alias("n"))
    # a mark that no block has: no block has the pattern
    rarest = own.join(often, ["paper_id", "mark"], "left").groupBy("paper_id", "kind", "pattern").agg(F.min_by("mark", F.struct(F.coalesce("n", F.lit(0)), F.col("mark"))).alias("mark"))
    return rarest.join(held, ["paper_id", "mark"]).select("paper_id", "kind", "pattern", "block_id")


def leaks(blocks: DataFrame, patterns: DataFrame) -> DataFrame:
    """(paper_id, block_id, n_headers, n_titles): blocks that hold a running header or the title of a reference of their own paper.

    ``patterns`` have paper_id, kind (header or title) and text. All are compared without white space, case and emphasis; a title by
    its first characters. Up to FEW patterns of a paper are looked for in each of its blocks, which reads a text FEW times at most and costs less than
    marks do. Where a paper has more, see ``met_by_marks``. Shorter patterns than GRAM + WINDOW - 1 characters don't count.
    """
    p = patterns.where(F.col("text").isNotNull()).select("paper_id", "kind", squeezed(F.col("text")).alias("pattern"), F.length("text").alias("size"))
    p = p.where(F.when(F.col("kind") == "title", F.col("size") >= LEAST_TITLE).otherwise(F.col("size") >= LEAST_HEADER))
    p = p.withColumn("pattern", F.when(F.col("kind") == "title", F.substring("pattern", 1, TITLE_HEAD)).otherwise(F.col("pattern"))).where(F.length("pattern") >= GRAM + WINDOW - 1)
    p = once(p.select("paper_id", "kind", "pattern").distinct())
    b = blocks.select("paper_id", "block_id", squeezed(F.col("text")).alias("body"))
    holds = F.contains("body", "pattern") & ((F.col("kind") == "title") | (F.length("body") > F.length("pattern")))
    many = once(p.groupBy("paper_id").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > FEW).select("paper_id"))
    sure = p.join(many, "paper_id", "left_anti").join(b, "paper_id").where(holds)
    if not many.isEmpty():
        some = p.join(many, "paper_id", "left_semi")
        sure = sure.unionByName(met_by_marks(some, b).join(b, ["paper_id", "block_id"]).where(holds))
    return sure.groupBy("paper_id", "block_id").agg(F.count_if(F.col("kind") == "header").alias("n_headers"), F.count_if(F.col("kind") == "title").alias("n_titles"))


def rank_chunks(docs: DataFrame, terms: list[str], size: int = 1400, step: int = 1200, k: int = 3) -> DataFrame:
    """The windows of each document with the most occurrences of the terms."""
    last = F.greatest(F.lit(0), F.ceil((F.length("text") - size) / step))
    w = docs.select("paper_id", "text", F.explode(F.sequence(F.lit(0).cast("long"), last)).alias("chunk")).withColumn("part", F.expr(f"substring(text, int(chunk * {step} + 1), {size})"))
    score = sum((F.regexp_count(F.lower("part"), F.lit(t)) for t in terms[1:]), F.regexp_count(F.lower("part"), F.lit(terms[0])))
    at = Window.partitionBy("paper_id").orderBy(F.desc("score"), "chunk")
    return w.select("paper_id", "chunk", score.cast("long").alias("score")).where("score > 0").withColumn("place", F.row_number().over(at).cast("long")).where(F.col("place") <= k)


def segments(docs: DataFrame, size: int = 1200) -> DataFrame:
    """Whole sentences packed in order: a block closes before the sentence that takes it beyond ``size`` characters; a longer one stands alone.

    A sentence ends at ``.``, ``!`` or ``?`` before white space and a capital or an opening bracket; the text has single spaces first.
    Lengths fold inside the row, which keeps where each block starts; nothing is shuffled. Texts without words give no block.
    """
    flat = F.trim(F.regexp_replace("text", r"\s+", " "))
    said = docs.select("paper_id", F.filter(F.split(flat, r"(?<=[.!?]) (?=[A-Z(\[])"), lambda x: x != "").alias("said")).where(F.size("said") > 0)

    def add(acc, x):
        full = (acc["n"] == 0) | (acc["n"] + F.length(x) > size)
        n = F.when(full, F.length(x)).otherwise(acc["n"] + 1 + F.length(x))
        return F.struct((acc["i"] + 1).alias("i"), n.alias("n"), F.when(full, F.concat(acc["starts"], F.array(acc["i"]))).otherwise(acc["starts"]).alias("starts"))

    zero = F.struct(F.lit(1).alias("i"), F.lit(0).alias("n"), F.array().cast("array<int>").alias("starts"))
    starts = said.withColumn("starts", F.aggregate("said", zero, add, lambda acc: acc["starts"]))
    each = starts.select("paper_id", "said", "starts", F.posexplode("starts").alias("block", "start"))
    n = F.coalesce(F.get("starts", F.col("block") + 1), F.size("said") + 1) - F.col("start")
    return each.select("paper_id", F.col("block").cast("long").alias("block"), n.cast("long").alias("n_sentences"), F.array_join(F.slice("said", F.col("start"), n), " ").alias("text"))


def choose_own(blocks: DataFrame, width: int = 170) -> DataFrame:
    """The series of each paper with the most own signals over cited ones around its mentions; a single one that isn't cited counts as own."""
    a = accessions(blocks).where("repo = 'geo'").withColumn("i", F.instr("text", F.col("accession")))
    around = F.expr(f"substring(text, greatest(1, i - {width}), 2 * {width})")
    s = a.select("paper_id", "accession", F.regexp_count(around, F.lit(OWN_WORDS)).alias("own"), F.regexp_count(around, F.lit(CITED_WORDS)).alias("cited")).groupBy("paper_id", "accession").agg(F.sum("own").alias("own"), F.sum("cited").alias("cited"))
    n = F.count(F.lit(1)).over(Window.partitionBy("paper_id"))
    at = F.row_number().over(Window.partitionBy("paper_id").orderBy(F.desc(F.col("own") - F.col("cited")), "accession"))
    best = s.withColumn("n", n).withColumn("at", at).where("at = 1")
    return best.where((F.col("own") > F.col("cited")) | ((F.col("n") == 1) & (F.col("cited") == 0))).select("paper_id", "accession", "own", "cited")


def relevance(docs: DataFrame, phrases: list[str]) -> DataFrame:
    """The first of the phrases, in their order, that a text holds."""
    out = F.lit(None).cast("string")
    for p in reversed(phrases):
        out = F.when(F.lower("text").contains(p), p).otherwise(out)
    return docs.select("paper_id", out.alias("phrase"))


def design_evidence(blocks: DataFrame, pattern: str, classes: list[str], most: int = 4) -> DataFrame:
    """The first hits of a pattern in design sections of each paper, with their blocks."""
    hits = blocks.where(F.col("section_class").isin(classes)).select("paper_id", "ord", "block_id", F.posexplode(F.regexp_extract_all("text", F.lit(pattern), F.lit(0))).alias("k", "hit"))
    w = Window.partitionBy("paper_id").orderBy("ord", "k")
    return hits.withColumn("place", F.row_number().over(w).cast("long")).where(F.col("place") <= most).select("paper_id", "block_id", "hit", "place")
