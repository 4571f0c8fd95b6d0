"""Sections by windows against a plain state machine, line by line."""

import random
import re

from assayloom.operators import sections as Z
from assayloom.operators import texts as X

KIND = "paper_id long, text string, line string, title string"
TITLES = [(n, re.compile(p)) for n, p in X.TITLES]


def class_of(title):
    return next((n for n, p in TITLES if p.search(title)), "other")


def said(line):
    m = re.match(Z.HASHES, line)
    t = m[2] if m else line
    for a, b in ((r"\[([^\]]*)\]\([^)]*\)", r"\1"), (r"</?[A-Za-z][^>]*>", ""), (r"[*_`]", ""), (r"\s+", " ")):
        t = re.sub(a, b, t)
    return bool(m), re.sub(":+$", "", t.strip(" ")).strip(" ")


def machine(text):
    """(section ids by heading line, blocks) with a stack of open sections."""
    lines, found = text.split("\n"), []
    for line in lines:
        hashes, t = said(line)
        m = None if re.match(r"\d{4}\b", t) else re.match(Z.NUMBERED, t)
        number, title = (m[1], m[2]) if m else ("", t)
        s = line.strip(" ")
        if not s or re.match(Z.RULE, s) or (hashes and not title):
            kind = "blank"
        elif hashes and re.search(Z.TABLE_CAPTION, title):
            kind = "table"
        elif hashes and re.search(Z.FIGURE_CAPTION, title):
            kind = "figure"
        elif title and (hashes or re.search(Z.MAIN, title)):
            kind = "heading"
        elif s.startswith("|"):
            kind = "row"
        elif re.search(Z.FIGURE_CAPTION, s):
            kind = "figure"
        elif re.search(Z.TABLE_CAPTION, s):
            kind = "table"
        else:
            kind = "body"
        found.append([kind, t if hashes else s, title, number])
    for k in found:
        n = sum(o[0] == "body" and o[1] == k[1] for o in found)
        k.append(k[0] == "body" and len(k[1]) <= 90 and (n >= 3 or (n == 2 and len(k[1]) >= 15 and not re.search(r"[.!?]$", k[1]))))
    out, stack, counts, open_class, stopped = {}, [], {}, "other", False
    blocks, here, para, previous = [], ("S0", "other"), None, None
    for at, (kind, line, title, number, again) in enumerate(found):
        if kind == "heading":
            if re.search(Z.STOP, title):
                stopped = True
            elif re.search(Z.RESUME, title):
                stopped = False
        if stopped:
            continue
        if kind == "heading":
            own, named = class_of(title), bool(re.search(Z.MAIN, title) or re.search(Z.BACK, title))
            vague = own == "methods" and not re.search("(?i)method|material", title)
            if number:
                depth = min(number.count(".") + 1, Z.DEEPEST)
            else:
                depth = 2 if not named and open_class != "other" and (own in ("other", open_class) or vague) else 1
            while stack and stack[-1][1] >= depth:
                stack.pop()
            up = stack[-1] if stack else None
            if up is None:
                sid = "ABS" if own == "abstract" and "ABS" not in counts else "DA" if own == "data_availability" and "DA" not in counts else None
                if sid is None:
                    counts[None] = counts.get(None, 0) + 1
                    sid = f"S{counts[None]}"
                counts.setdefault(sid, 0)
                cls, level = own, 1
            else:
                counts[up[0]] = counts.get(up[0], 0) + 1
                sid = f"{up[0]}.{counts[up[0]]}"
                cls, level = (own if own in ("data_availability", "supplementary") else up[2]), up[3] + 1
            if (number and "." not in number) or (not number and (named or (own != "other" and not vague))):
                open_class = own
            stack.append((sid, depth, cls, level))
            out[at] = (sid, title, cls, level, up[0] if up else None)
            here, para, previous = (sid, cls), None, "heading"
            continue
        group = "blank" if kind == "blank" or again else "caption" if kind in ("figure", "table") else kind
        if group == "blank":
            para = None
        elif para is None or group == "caption" or (group != previous and not (group == "body" and previous == "caption")):
            para = [at, {"body": "paragraph", "row": "table"}.get(kind, kind), here, [line.strip(" ")], "\n" if kind == "row" else " "]
            blocks.append(para)
        else:
            para[3].append(line.strip(" "))
        previous = group
    joined = []
    for at, kind, where, parts, sep in blocks:
        text = sep.join(parts)
        p = joined[-1] if joined else None
        if p and kind == p[1] == "paragraph" and p[6] == where[0] and re.match(r"[a-z(]", text) and not re.search(r"[.!?:]\)?$", p[5]):
            p[4], p[5] = f"{p[4]} {text}", text
        else:
            joined.append([at, kind, where[0], where[1], text, text, where[0]])
    return out, [tuple(b[:5]) for b in joined]


LINES = (
    "# Abstract", "Introduction", "2. Materials and methods", "2.1 Cohort", "2.1.1 Sampling", "## Animals", "### Statistical analysis", "**Results**", "3.2.1. Deep one", "Fig. 2 A curve", "Table S1: values", "| a | b |", "| 1 | 2 |", "References", "1. Somebody 2001",
    "Data availability statement", "Acknowledgments", "Methods", "Discussion:", "# Characteristics of participants", "Supplementary information", "", "", "", "We measured counts.", "and more of it", "(as before)", "A line without an end", "Journal of Running Heads", "---", "  indented body. ", "#", "## Figure 3", "1998 was a year", "# [Linked](http://x) *title*:", "7.7.7.7.7 Results", "# Summary",
)


def test_windows_equal_the_state_machine(spark):
    rng = random.Random(1)
    texts = ["\n".join(rng.choice(LINES) for _ in range(rng.randint(1, 60))) for _ in range(250)]
    docs = spark.createDataFrame([(i, t, "x", "y") for i, t in enumerate(texts)], KIND)
    heads, blocks = {}, {}
    for r in Z.sections(docs).collect():
        heads.setdefault(r["paper_id"], {})[r["ord"]] = (r["section_id"], r["title"], r["section_class"], r["level"], r["parent_id"])
    for r in Z.section_blocks(docs).orderBy("paper_id", "ord").collect():
        blocks.setdefault(r["paper_id"], []).append((r["ord"], r["kind"], r["section_id"], r["section_class"], r["text"]))
    for i, t in enumerate(texts):
        want_heads, want_blocks = machine(t)
        assert heads.get(i, {}) == want_heads, t
        assert blocks.get(i, []) == want_blocks, t


def test_a_paper(spark):
    text = "Title line\n\n# Abstract\nShort.\n\n1. Introduction\nWhy we\nasked.\n\n2. Methods\n## 2.1 Cohort\nMice.\n## Animals\nTen.\nTable 1. Numbers\nof all\n| a | b |\n| 1 | 2 |\nResults\nGood.\nReferences\n1. Somebody.\nData availability\nGSE1."
    got = {r["title"]: (r["section_id"], r["section_class"], r["level"], r["parent_id"]) for r in Z.sections(spark.createDataFrame([(1, text, "", "")], KIND)).collect()}
    assert got == {
        "Abstract": ("ABS", "abstract", 1, None), "Introduction": ("S1", "introduction", 1, None), "Methods": ("S2", "methods", 1, None), "Cohort": ("S2.1", "methods", 2, "S2"),
        "Animals": ("S2.2", "methods", 2, "S2"), "Results": ("S3", "results", 1, None), "Data availability": ("DA", "data_availability", 1, None),
    }
    b = [(r["kind"], r["section_id"], r["text"]) for r in Z.section_blocks(spark.createDataFrame([(1, text, "", "")], KIND)).orderBy("ord").collect()]
    assert b == [("paragraph", "S0", "Title line"), ("paragraph", "ABS", "Short."), ("paragraph", "S1", "Why we asked."), ("paragraph", "S2.1", "Mice."), ("paragraph", "S2.2", "Ten."), ("table", "S2.2", "Table 1. Numbers of all"), ("table", "S2.2", "| a | b |\n| 1 | 2 |"), ("paragraph", "S3", "Good."), ("paragraph", "DA", "GSE1.")]


def test_papers_without_text(spark):
    docs = spark.createDataFrame([(1, None, "", ""), (2, "", "", ""), (3, " \n\n", "", ""), (None, "Methods\nx", "", "")], KIND)
    assert [tuple(r)[0] for r in Z.section_blocks(docs).collect()] == [None]
    assert Z.section_blocks(docs.limit(0)).collect() == [] and Z.sections(docs.limit(0)).collect() == []


def test_sentences_are_not_searched_for_headings(spark):
    """Long lines without marks aren't cleaned, headings with marks, numbers and colons still are; each line is cleaned once, each text searched only for accessions it may hold."""
    from assayloom.operators.sections import classified
    from assayloom.operators.texts import accessions

    heads = ["Methods", " 1.2  Materials   and methods and materials :", "**Data and code** availability [statement](a b c d e f g h i j k) :", "<b class='a b c d e f g h i'>Results</b>", "## one two three four five six seven eight nine ten"]
    others = ["one two three four five six seven eight methods", "2 mice were given more than nine words of food a day", "methods and results of one two three four five"]
    df = classified(spark.createDataFrame([(1, "\n".join(heads + others))], "paper_id long, text string"))
    kinds = [r["kind"] for r in df.orderBy("ord").collect()]
    assert kinds == ["heading"] * len(heads) + ["body"] * len(others)
    assert df._jdf.queryExecution().optimizedPlan().toString().count("regexp_replace(") <= 6
    texts = ["see GSE1234, PXD123456 and E-MTAB-12.", "PRJNA123 PRJEB456 SRP1234 CRA123456 HRA123456 PRJCA123456 phs123456", "gse1234 xGSE1234 none"]
    blocks = spark.createDataFrame([(1, i, f"B{i}", "other", t) for i, t in enumerate(texts)], "paper_id long, ord long, block_id string, section_class string, text string")
    found = accessions(blocks)
    assert sorted((r["block_id"], r["accession"]) for r in found.collect()) == sorted([("B0", a) for a in ("GSE1234", "PXD123456", "E-MTAB-12")] + [("B1", a) for a in texts[1].split()])
    assert "Contains(text" in found._jdf.queryExecution().optimizedPlan().toString()
