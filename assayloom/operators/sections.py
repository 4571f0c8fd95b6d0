"""Sections and blocks of papers, from the lines of their texts.

A line is classified on its own: heading, caption, table row, blank or body. What it belongs to depends on the lines before it, and
is settled by windows over the lines of a paper in order, all with one key and one order, so one shuffle and one sort:

* whether text counts: a heading of references stops it until a heading that journals print behind the references;
* how deep a heading is: the hashes or numbers before it, or, for a heading without a number that isn't a main section's name, one
  below the top section that is open. Which class that has is the class of the last heading that could open one, so
  no state is carried from line to line;
* its parent: the nearest heading before it that is less deep; its id: the parent's, a point and its number there.

Body lines between blank lines, headings and captions are islands; each becomes a paragraph, a figure's or table's caption, or a table.
A paragraph that a break split in the middle of a sentence is joined with the one before.

Edge cases: null texts are empty; a paper without lines has no blocks; text before the first heading is section S0; lines that repeat like running headers are
left out; ids that repeat among papers are one paper's lines in the order of their numbers.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from assayloom.operators.texts import section_class

#: Levels of sections; deeper numbers count as the last.
DEEPEST = 4
#: Names of main sections, the titles that end the text, those that resume it, those that are never below another, and captions.
MAIN = (
    r"(?i)^(abstract|summary|introduction|background|results?( and discussion)?|discussion|conclusions?|(materials? and )?methods?( and materials?)?|"
    r"experimental (procedures|section)|star\s*methods|data (and code )?availability( statement)?|data access|supplementary (material|information)|acknowledge?ments?|references|funding)$"
)
STOP = r"(?i)^(references?( and notes)?|notes and references|references cited|bibliography|literature cited|cited literature|works cited)$"
RESUME = (
    r"(?i)^((online |star\s*\+?\s*)?(materials? and )?methods?( and materials?)?( details)?|experimental (model|procedures).*|resource availability|lead contact|materials availability|"
    r"key resources table|quantification and statistical analysis|statistical analysis|(data|code|data and code|data and software)( and materials)? availability( statement)?|"
    r"accession (numbers?|codes?)|supplementary (information|materials?)|supplemental information)$"
)
BACK = r"(?i)^(acknowledge?ments?|funding|author contributions?|conflicts? of interest|competing interests?|declaration|ethics|abbreviations|keywords?|highlights|graphical abstract|footnotes?)"
HASHES, NUMBERED = r"^\s{0,3}(#{1,6})\s+(.*?)\s*#*\s*$", r"^((?:\d{1,2}\.)*\d{1,2})\.?\s+(\S.*)$"
TABLE_CAPTION, FIGURE_CAPTION = r"(?i)^[*_]*\s*(table\s*S?\d+[a-z]?)\b", r"(?i)^[*_]*\s*((figure|fig\.?)\s*S?\d+[a-z]?)\b"
RULE = r"^[-*_=\s]+$"
#: Lines of more words than a number, a main section's name and a colon, and signs of links, tags and emphasis.
SENTENCE, MARKED = r"^\s*(?:\S+\s+){8}\S", r"[\[<*_`]"


def plain(title: Column) -> Column:
    """A heading without emphasis, link targets, tags and a colon at its end."""
    for pattern, by in ((r"\[([^\]]*)\]\([^)]*\)", "$1"), (r"</?[A-Za-z][^>]*>", ""), (r"[*_`]", ""), (r"\s+", " ")):
        title = F.regexp_replace(title, pattern, by)
    return F.trim(F.regexp_replace(F.trim(title), r":+$", ""))


def classified(docs: DataFrame) -> DataFrame:
    """(paper_id, ord, line, kind, title, number): every line with its kind; ``title`` and ``number`` of headings.

    A heading has hashes, or is a whole line that names a main section, with a number or emphasis or without.
    """
    lines = docs.select("paper_id", F.posexplode(F.split(F.regexp_replace(F.coalesce("text", F.lit("")), r"\r\n?", "\n"), "\n")).alias("ord", "line"))
    lines = lines.withColumn("hashed", F.col("line").rlike(HASHES))
    said = plain(F.when(F.col("hashed"), F.regexp_extract("line", HASHES, 2)).otherwise(F.col("line")))
    # most lines are sentences: too many words for a heading, and nothing in them that ``plain`` takes away
    cut = lines.withColumn("said", F.when(F.col("hashed") | ~F.col("line").rlike(SENTENCE) | F.col("line").rlike(MARKED), said).otherwise(""))
    cut = cut.withColumn("number", F.when(~F.col("said").rlike(r"^\d{4}\b"), F.regexp_extract("said", NUMBERED, 1)).otherwise(""))
    cut = cut.withColumn("title", F.when(F.col("number") != "", F.regexp_extract("said", NUMBERED, 2)).otherwise(F.col("said")))
    heading = (F.col("title") != "") & (F.col("hashed") | F.col("title").rlike(MAIN))
    line = F.trim("line")
    kind = (
        F.when((line == "") | line.rlike(RULE), "blank")
        .when(F.col("hashed") & ((F.col("title") == "") | F.col("title").rlike(TABLE_CAPTION) | F.col("title").rlike(FIGURE_CAPTION)), F.when(F.col("title") == "", "blank").when(F.col("title").rlike(TABLE_CAPTION), "table").otherwise("figure"))
        .when(heading, "heading")
        .when(line.startswith("|"), "row")
        .when(line.rlike(FIGURE_CAPTION), "figure")
        .when(line.rlike(TABLE_CAPTION), "table")
        .otherwise("body")
    )
    text = F.when(F.col("hashed"), F.col("said")).otherwise(line)
    return cut.select("paper_id", F.col("ord").cast("long").alias("ord"), text.alias("line"), kind.alias("kind"), "title", "number")


def without_running_lines(lines: DataFrame) -> DataFrame:
    """Body lines that a paper repeats three times, or twice if long and no sentence, become blank."""
    w = Window.partitionBy("paper_id", "line")
    short = (F.col("kind") == "body") & (F.length("line") <= 90)
    n = F.count(F.when(short, 1)).over(w)
    again = short & ((n >= 3) | ((n == 2) & (F.length("line") >= 15) & ~F.col("line").rlike(r"[.!?]$")))
    return lines.withColumn("kind", F.when(again, "blank").otherwise(F.col("kind")))


def structured(docs: DataFrame) -> DataFrame:
    """(paper_id, ord, kind, line, section, and of the section: section_id, title, section_class, level, parent): lines that count, in order.

    ``section`` is the line number of the section's heading, -1 for the front matter.
    """
    lines = without_running_lines(classified(docs))
    w = Window.partitionBy("paper_id").orderBy("ord")
    upto, before = w.rowsBetween(Window.unboundedPreceding, 0), w.rowsBetween(Window.unboundedPreceding, -1)
    last = lambda value, span: F.last(value, ignorenulls=True).over(span)
    c, is_head = F.col, F.col("kind") == "heading"

    # stop and resume
    turn = F.when(is_head & c("title").rlike(STOP), F.lit(True)).when(is_head & c("title").rlike(RESUME), F.lit(False))
    lines = lines.withColumn("stopped", F.coalesce(last(turn, upto), F.lit(False))).where("not stopped").drop("stopped")

    # depth of headings
    own = F.when(is_head, section_class(c("title")))
    named = c("title").rlike(MAIN) | c("title").rlike(BACK)
    vague = (own == "methods") & ~c("title").rlike("(?i)method|material")  # names of subjects, not of methods
    numbered = c("number") != ""
    opens = is_head & F.when(numbered, ~c("number").contains(".")).otherwise(named | ((own != "other") & ~vague))
    lines = lines.withColumn("own", own).withColumn("open", F.coalesce(last(F.when(opens, own), before), F.lit("other")))
    nests = ~numbered & ~named & (c("open") != "other") & (c("own").isin("other") | (c("own") == c("open")) | vague)
    depth = F.when(numbered, F.least(F.size(F.split("number", r"\.")), F.lit(DEEPEST))).when(nests, F.lit(2)).otherwise(F.lit(1))
    lines = lines.withColumn("depth", F.when(is_head, depth))

    # parents: the nearest heading before that is less deep
    above = [last(F.when(c("depth") == k, c("ord")), before) for k in range(1, DEEPEST)]
    parent = F.coalesce(*(F.when(c("depth") == k, F.greatest(*above[: k - 1], F.lit(-1).cast("long"))) for k in range(2, DEEPEST + 1)), F.lit(-1).cast("long"))
    lines = lines.withColumn("up", F.when(is_head, parent))

    # ids and classes, level by level: the nearest heading before that has the level above is the parent
    first = lambda name: is_head & (c("up") == -1) & (c("own") == name)
    special = F.when(first("abstract") & (F.count(F.when(first("abstract"), 1)).over(upto) == 1), "ABS").when(first("data_availability") & (F.count(F.when(first("data_availability"), 1)).over(upto) == 1), "DA")
    lines = lines.withColumn("special", special)
    at_top = is_head & (c("up") == -1)
    number = F.count(F.when(at_top & c("special").isNull(), 1)).over(upto)
    sid = F.coalesce("special", F.concat(F.lit("S"), number.cast("string")))
    section = lambda sid, cls, level: F.struct(c("ord").alias("at"), sid.alias("section_id"), c("title"), cls.alias("section_class"), F.lit(level).alias("level"), c("up").alias("parent"))
    lines = lines.withColumn("s", F.when(at_top, section(sid, c("own"), 1)))
    among = Window.partitionBy("paper_id", "up").orderBy("ord").rowsBetween(Window.unboundedPreceding, 0)
    lines = lines.withColumn("nth", F.count(F.when(is_head, 1)).over(among))
    for level in range(2, DEEPEST + 1):
        lines = lines.withColumn("p", last(F.when(c("s")["level"] == level - 1, c("s")), before))
        sid = F.concat(c("p")["section_id"], F.lit("."), c("nth").cast("string"))
        cls = F.when(c("own").isin("data_availability", "supplementary"), c("own")).otherwise(c("p")["section_class"])
        lines = lines.withColumn("s", F.coalesce("s", F.when(is_head & (c("p")["at"] == c("up")), section(sid, cls, level))))
    front = F.struct(F.lit(-1).cast("long").alias("at"), F.lit("S0").alias("section_id"), F.lit("").alias("title"), F.lit("other").alias("section_class"), F.lit(1).alias("level"), F.lit(-1).cast("long").alias("parent"))
    lines = lines.withColumn("s", F.coalesce(last(c("s"), upto), front))
    return lines.select("paper_id", "ord", "kind", "line", c("s")["at"].alias("section"), *(c("s")[x].alias(x) for x in ("section_id", "title", "section_class", "level", "parent")))


def sections(docs: DataFrame) -> DataFrame:
    """A row a section with a heading: paper_id, section_id, title, section_class, level, parent_id and n_lines of text under it."""
    s = structured(docs)
    keys = ["paper_id", "section", "section_id", "title", "section_class", "level", "parent"]
    each = s.where("section >= 0").groupBy(*keys).agg(F.count_if(F.col("kind").isin("body", "row", "figure", "table")).alias("n_lines"))
    w = Window.partitionBy("paper_id").orderBy("section").rowsBetween(Window.unboundedPreceding, -1)
    # a parent is the last section before of the level above
    up = F.coalesce(*(F.when(F.col("level") == k, F.last(F.when(F.col("level") == k - 1, F.col("section_id")), ignorenulls=True).over(w)) for k in range(2, DEEPEST + 1)))
    return each.select("paper_id", F.col("section").alias("ord"), "section_id", "title", "section_class", "level", up.alias("parent_id"), "n_lines")


def section_blocks(docs: DataFrame) -> DataFrame:
    """(paper_id, ord, block_id, kind, section_class, section_id, text): paragraphs, captions and tables in order; ``ord`` is their first line.

    Lines of one paragraph are joined by spaces, rows of a table by line breaks.
    """
    s = structured(docs).where("kind <> 'heading' or section >= 0")
    w = Window.partitionBy("paper_id").orderBy("ord")
    group = F.when(F.col("kind").isin("figure", "table"), "caption").otherwise(F.col("kind"))
    s = s.withColumn("group", group).withColumn("before", F.lag("group").over(w))
    # body after a caption goes on with it; a caption always starts anew
    starts = F.col("before").isNull() | (F.col("group") == "caption") | ((F.col("group") != F.col("before")) & ~((F.col("group") == "body") & (F.col("before") == "caption")))
    s = s.withColumn("island", F.sum(F.when(starts, 1).otherwise(0)).over(w)).where(F.col("kind").isin("body", "row", "figure", "table"))
    parts = s.groupBy("paper_id", "section_id", "section_class", "island").agg(F.min("ord").alias("ord"), F.min_by("kind", "ord").alias("kind"), F.array_sort(F.collect_list(F.struct("ord", F.trim("line").alias("line")))).alias("l"))
    kind = F.when(F.col("kind") == "body", "paragraph").when(F.col("kind") == "row", "table").otherwise(F.col("kind"))
    text = F.when(F.col("kind") == "row", F.array_join("l.line", "\n")).otherwise(F.array_join("l.line", " "))
    parts = parts.select("paper_id", "ord", kind.alias("kind"), "section_class", "section_id", text.alias("text"))
    # a paragraph that begins in lower case goes on with an unfinished one of its section
    w = Window.partitionBy("paper_id").orderBy("ord")
    goes_on = (F.col("kind") == "paragraph") & (F.lag("kind").over(w) == "paragraph") & (F.lag("section_id").over(w) == F.col("section_id")) & F.col("text").rlike(r"^[a-z(]") & ~F.lag("ended").over(w)
    # an end is looked for in the last letters (with a line break that $ leaves out), not all through the text
    joined = parts.withColumn("ended", F.right("text", F.lit(3)).rlike(r"[.!?:]\)?$")).withColumn("run", F.sum(F.when(F.coalesce(goes_on, F.lit(False)), 0).otherwise(1)).over(w))
    out = joined.groupBy("paper_id", "run").agg(F.min("ord").alias("ord"), F.min_by("kind", "ord").alias("kind"), F.min_by("section_class", "ord").alias("section_class"), F.min_by("section_id", "ord").alias("section_id"), F.array_join(F.array_sort(F.collect_list(F.struct("ord", "text")))["text"], " ").alias("text"))
    return out.select("paper_id", "ord", F.concat(F.lit("B"), F.col("run") - 1).alias("block_id"), "kind", "section_class", "section_id", "text")
