"""Queries on texts."""

from __future__ import annotations

from pyspark.sql import functions as F

from assayloom.operators import sections as Z
from assayloom.operators import texts as X
from assayloom.plans.registry import query

#: Lines that are planted as headings and captions, one before every third line.
HEADS = (
    "# Abstract", "1. Introduction", "2 Materials and methods", "2.1 Cohort", "2.1.1 Blood sampling", "## Statistical analysis", "**Results**", "Figure 1. Flow of samples",
    "Table 2 | Measures of [the cohort](x)", "Discussion:", "References", "Data availability", "3.2 Main findings", "Acknowledgements", "### Limits", "STAR Methods",
)
#: Texts with a sentence about data added, so that accessions occur, headings planted, and a blank line after every second line.
DOCS = f"""
select paper_id, array_to_string(list_transform(string_split(text, chr(10)), lambda x, i: case when i % 3 = 1 then [{", ".join(f"'{h}'" for h in HEADS)}][1 + ((paper_id + i // 3) % {len(HEADS)})::int] || chr(10) else '' end || x || case when i % 2 = 0 then chr(10) else '' end), chr(10)) as text
from (select doc_id as paper_id, coalesce(text, '') || chr(10) || case doc_id % 5 when 0 then 'The reads have been deposited in GEO under GSE' || (10000 + doc_id) || '.' when 1 then 'Counts were downloaded from GSE' || (20000 + doc_id % 50) || ' and PXD' || lpad((doc_id % 900000)::varchar, 6, '0') || '.'
  when 2 then 'Data access: PRJNA' || (3000 + doc_id) || ', GSE' || (40000 + doc_id) || '.' when 3 then 'See GSE' || (50000 + doc_id) || '. It is publicly available as E-MTAB-' || doc_id else 'No data.' end as text from documents)"""


def structure_sql(docs: str) -> str:
    """Common tables of ``docs`` (paper_id, text), down to ``st`` (its lines with their sections) and ``bl`` (its blocks)."""
    q = lambda p: "'" + p.replace("'", "''") + "'"
    m = lambda c, p: f"regexp_matches({c}, {q(p)})"
    said = "case when hashes <> '' then regexp_extract(line, {0}, 2) else line end".format(q(Z.HASHES))
    for pattern, by in ((r"\[([^\]]*)\]\([^)]*\)", "\\1"), (r"</?[A-Za-z][^>]*>", ""), (r"[*_`]", ""), (r"\s+", " ")):
        said = f"regexp_replace({said}, {q(pattern)}, {q(by)}, 'g')"
    w = "over (partition by paper_id order by ord rows between unbounded preceding and {})"
    last = lambda x, upto: f"last_value({x} ignore nulls) {w.format(upto)}"
    now, before = "current row", "1 preceding"
    title = "case " + " ".join(f"when regexp_matches(title, '{p}') then '{n}'" for n, p in X.TITLES) + " else 'other' end"
    named, vague = f"({m('title', Z.MAIN)} or {m('title', Z.BACK)})", "(own = 'methods' and not regexp_matches(title, '(?i)method|material'))"
    deep = Z.DEEPEST
    above = [f"coalesce({last(f'case when depth = {k} then ord end', before)}, -1)" for k in range(1, deep)]
    up = "case " + " ".join(f"when depth = {k} then greatest({', '.join(above[: k - 1])}, -1)" for k in range(2, deep + 1)) + " else -1 end"
    section = "{{'spot': ord, 'section_id': {0}, 'title': title, 'section_class': {1}, 'level': {2}, 'up': up}}"
    out = [
        f"d0 as ({docs})",
        "l0 as (select paper_id, i - 1 as ord, line from (select paper_id, unnest(x) as line, generate_subscripts(x, 1) as i from (select paper_id, string_split(coalesce(text, ''), chr(10)) as x from d0)))",
        f"l1 as (select *, regexp_extract(line, {q(Z.HASHES)}, 1) as hashes from l0)",
        f"l2 as (select *, trim(regexp_replace(trim({said}), ':+$', '')) as said from l1)",
        f"l3 as (select *, case when {m('said', '^[0-9]{4}' + chr(92) + 'b')} then '' else regexp_extract(said, {q(Z.NUMBERED)}, 1) end as number from l2)",
        f"l4 as (select *, case when number <> '' then regexp_extract(said, {q(Z.NUMBERED)}, 2) else said end as title from l3)",
        f"l5 as (select paper_id, ord, case when hashes <> '' then said else trim(line) end as text, title, number, case when trim(line) = '' or {m('trim(line)', Z.RULE)} then 'blank' when hashes <> '' and title = '' then 'blank' when hashes <> '' and {m('title', Z.TABLE_CAPTION)} then 'table' when hashes <> '' and {m('title', Z.FIGURE_CAPTION)} then 'figure' when title <> '' and (hashes <> '' or {m('title', Z.MAIN)}) then 'heading' when starts_with(trim(line), '|') then 'row' when {m('trim(line)', Z.FIGURE_CAPTION)} then 'figure' when {m('trim(line)', Z.TABLE_CAPTION)} then 'table' else 'body' end as kind from l4)",
        "l6 as (select *, count(case when kind = 'body' and length(text) <= 90 then 1 end) over (partition by paper_id, text) as n from l5)",
        "l7 as (select paper_id, ord, text, title, number, case when kind = 'body' and length(text) <= 90 and (n >= 3 or (n = 2 and length(text) >= 15 and not regexp_matches(text, '[.!?]$'))) then 'blank' else kind end as kind from l6)",
        f"l8 as (select *, {last(f'case when kind = {q("heading")} and {m("title", Z.STOP)} then true when kind = {q("heading")} and {m("title", Z.RESUME)} then false end', now)} as stopped from l7)",
        f"h1 as (select *, case when kind = 'heading' then {title} end as own from l8 where not coalesce(stopped, false))",
        f"h2 as (select *, kind = 'heading' and case when number <> '' then not contains(number, '.') else {named} or (own <> 'other' and not {vague}) end as opens from h1)",
        f"h3 as (select *, coalesce({last('case when opens then own end', before)}, 'other') as open from h2)",
        f"h4 as (select *, case when kind = 'heading' then case when number <> '' then least(len(string_split(number, '.')), {deep}) when not {named} and open <> 'other' and (own = 'other' or own = open or {vague}) then 2 else 1 end end as depth from h3)",
        f"h5 as (select *, case when kind = 'heading' then {up} end as up from h4)",
        f"h6 as (select *, case when up = -1 and own = 'abstract' and count(case when up = -1 and own = 'abstract' then 1 end) {w.format(now)} = 1 then 'ABS' when up = -1 and own = 'data_availability' and count(case when up = -1 and own = 'data_availability' then 1 end) {w.format(now)} = 1 then 'DA' end as special from h5)",
        f"h7 as (select *, count(case when up = -1 and special is null then 1 end) {w.format(now)} as nr, count(case when kind = 'heading' then 1 end) over (partition by paper_id, up order by ord rows between unbounded preceding and current row) as nth from h6)",
        "s1 as (select *, case when up = -1 then " + section.format("coalesce(special, 'S' || nr)", "own", "1") + " end as s from h7)",
    ]
    for level in range(2, deep + 1):
        p = last(f"case when s.level = {level - 1} then s end", before)
        here = section.format("p.section_id || '.' || nth", "case when own in ('data_availability', 'supplementary') then own else p.section_class end", str(level))
        out.append(f"s{level} as (select * exclude (s, p), coalesce(s, case when kind = 'heading' and p.spot = up then {here} end) as s from (select *, {p} as p from s{level - 1}))")
    none = "{'spot': -1, 'section_id': 'S0', 'title': '', 'section_class': 'other', 'level': 1, 'up': -1}"
    out += [
        f"st as (select paper_id, ord, kind, text, unnest(sec) from (select paper_id, ord, kind, text, coalesce({last('s', now)}, {none}) as sec from s{deep}))",
        "g1 as (select *, case when kind in ('figure', 'table') then 'caption' else kind end as grp from st)",
        "g2 as (select *, lag(grp) over (partition by paper_id order by ord) as prior from g1)",
        "g3 as (select *, sum(case when prior is null or grp = 'caption' or (grp <> prior and not (grp = 'body' and prior = 'caption')) then 1 else 0 end) over (partition by paper_id order by ord) as island from g2)",
        "g4 as (select paper_id, section_id, section_class, island, min(ord) as ord, arg_min(kind, ord) as kind, list(trim(text) order by ord) as l from g3 where kind in ('body', 'row', 'figure', 'table') group by all)",
        "g5 as (select paper_id, ord, case kind when 'body' then 'paragraph' when 'row' then 'table' else kind end as kind, section_class, section_id, case when kind = 'row' then array_to_string(l, chr(10)) else array_to_string(l, ' ') end as text from g4)",
        "g6 as (select *, lag(kind) over o as k, lag(section_id) over o as i, lag(text) over o as t from g5 window o as (partition by paper_id order by ord))",
        "g7 as (select *, sum(case when kind = 'paragraph' and k = 'paragraph' and i = section_id and regexp_matches(text, '^[a-z(]') and not regexp_matches(t, '[.!?:]\\)?$') then 0 else 1 end) over (partition by paper_id order by ord) as run from g6)",
        "bl as (select paper_id, min(ord) as ord, 'B' || (run - 1)::bigint as block_id, arg_min(kind, ord) as kind, arg_min(section_class, ord) as section_class, arg_min(section_id, ord) as section_id, string_agg(text, ' ' order by ord) as text from g7 group by paper_id, run)",
    ]
    return ", ".join(out)


BLOCKS = f"with {structure_sql(DOCS)} select paper_id, ord, block_id, section_class, section_id, text from bl"

#: The phrases as SQL strings.
OWN, CITED, CITE = (w.replace("'", "''") for w in (X.OWN_WORDS, X.CITED_WORDS, X.CITE_AFTER))


def docs(t):
    k = F.col("doc_id")
    said = (
        F.when(k % 5 == 0, F.concat(F.lit("The reads have been deposited in GEO under GSE"), k + 10000, F.lit(".")))
        .when(k % 5 == 1, F.concat(F.lit("Counts were downloaded from GSE"), k % 50 + 20000, F.lit(" and PXD"), F.lpad((k % 900000).cast("string"), 6, "0"), F.lit(".")))
        .when(k % 5 == 2, F.concat(F.lit("Data access: PRJNA"), k + 3000, F.lit(", GSE"), k + 40000, F.lit(".")))
        .when(k % 5 == 3, F.concat(F.lit("See GSE"), k + 50000, F.lit(". It is publicly available as E-MTAB-"), k))
        .otherwise("No data.")
    )
    whole = t.documents.select(k.alias("paper_id"), F.concat(F.coalesce("text", F.lit("")), F.lit("\n"), said).alias("text"))
    heads = F.array(*map(F.lit, HEADS))

    def planted(x, i):
        head = F.when(i % 3 == 0, F.concat(F.element_at(heads, ((F.col("paper_id") + F.floor(i / 3)) % len(HEADS) + 1).cast("int")), F.lit("\n"))).otherwise("")
        return F.concat(head, x, F.when(i % 2 == 1, "\n").otherwise(""))

    return whole.select("paper_id", F.array_join(F.transform(F.split("text", "\n"), planted), "\n").alias("text"))


def blocks(t):
    return Z.section_blocks(docs(t)).select("paper_id", "ord", "block_id", "section_class", "section_id", "text")


FOUND = "b as (" + BLOCKS + "), a as (" + " union all ".join(f"select paper_id, ord, block_id, section_class, '{r}' as repo, unnest(list_distinct(regexp_extract_all(text, '{p}'))) as accession, text from b" for r, p in X.REPOSITORIES) + ")"


@query("txt_01_accessions", f"with {FOUND} select paper_id, block_id, repo, accession from a")
def txt_01(t):
    return X.accessions(blocks(t)).select("paper_id", "block_id", "repo", "accession")


@query("agg_25_accession_index", f"with {FOUND} select paper_id, accession, array_to_string(list(block_id order by ord), ';') as blocks from a group by all")
def agg_25(t):
    return X.accession_index(blocks(t))


@query("txt_02_mention_class", f"""
with {FOUND}, w as (select *, instr(text, accession) as i from a),
c as (select *, substring(text, greatest(1, i - 300), i - greatest(1, i - 300)) as before from w),
h as (select *, regexp_replace(before, '(?:{X.LISTED}{X.LIST_GAP})+$', '') as head from c),
p as (select *, regexp_replace(list_extract(string_split(head, '. '), -1), '(?s)^.*{X.LISTED}', '') || substring(before, length(head) + 1) || substring(text, i, 80) as win from h),
q as (select *, case when regexp_matches(substring(text, i + length(accession), 60), '{CITE}') then 'cited' when regexp_matches(win, '{OWN}') then 'own' when regexp_matches(win, '{CITED}') or regexp_matches(right(before, 40), '{X.REF_BEFORE}') then 'cited' else '' end as phrase from p),
g as (select paper_id, repo, accession, bool_or(phrase = 'own') as said_own, bool_or(phrase = 'cited') as said_cited, bool_and(section_class in ('introduction', 'discussion')) as only_cited, count(*) as n_mentions from q group by all),
k as (select *, case when said_own then 'own' when said_cited or only_cited then 'cited' else 'own' end as kind from g)
select paper_id, repo, accession, n_mentions, case when repo = 'geo' and count(case when kind = 'own' and repo = 'geo' then 1 end) over (partition by paper_id) > 8 and not said_own then 'cited' else kind end as kind from k""")
def txt_02(t):
    return X.mention_class(blocks(t))


QUOTES = "select d.doc_id as paper_id, item_id as quote_id, case when item_id % 4 = 1 then left(b.text, 40) || ' ... ' || right(b.text, 30) when item_id % 4 = 2 then b.text || ' added' else b.text end as quote from documents d join benchmark b on d.doc_id % 40 = b.item_id % 40 or contains(d.text, b.text)"
NORMAL = "lower(trim(regexp_replace(translate({}, '‘’‛“”–—−', '''''''\"\"---'), '\\s+', ' ', 'g')))"


def quotes(t):
    i = F.col("item_id")
    text = F.when(i % 4 == 1, F.concat(F.substring("b_text", 1, 40), F.lit(" ... "), F.right("b_text", F.lit(30)))).when(i % 4 == 2, F.concat("b_text", F.lit(" added"))).otherwise(F.col("b_text"))
    b = t.benchmark.select("item_id", F.col("text").alias("b_text"))
    # what holds a whole text shares its second to sixth words (texts have more), which meet by hash before they are looked up
    def runs(words):
        return F.transform(F.arrays_zip(*(F.slice(words, k, F.greatest(F.size(words), F.lit(1))).alias(f"w{k}") for k in range(1, 6))), lambda x: F.xxhash64(x))

    windows = t.documents.select("doc_id", F.split("text", " ").alias("w")).select("doc_id", F.explode(F.array_distinct(runs(F.col("w")))).alias("h"))
    second = b.select("item_id", F.split("b_text", " ").alias("w")).select("item_id", F.get(runs(F.col("w")), F.lit(1)).alias("h"))
    meet = windows.join(second, "h").select("doc_id", "item_id").distinct()
    inside = meet.join(t.documents.select("doc_id", "text"), "doc_id").join(b, "item_id").where(F.contains("text", "b_text")).select("doc_id", "item_id")
    same = t.documents.select("doc_id", (F.col("doc_id") % 40).alias("k")).join(b.select("item_id", (i % 40).alias("k")), "k").select("doc_id", "item_id")
    j = same.union(inside).distinct().join(b, "item_id")
    return j.select(F.col("doc_id").alias("paper_id"), i.alias("quote_id"), text.alias("quote"))


VERIFIED = f"""
q as ({QUOTES}), d as (select doc_id as paper_id, {NORMAL.format("text")} as body from documents), j as (select q.*, body, {NORMAL.format("quote")} as nq, list_filter(list_transform(regexp_split_to_array(quote, '\\.\\s*\\.\\s*\\.+|…+'), lambda x: {NORMAL.format("x")}), lambda x: length(x) >= 8) as parts from q join d using (paper_id)),
v as (select paper_id, quote_id, nq = '' or contains(body, nq) or (len(parts) >= 2 and len(list_filter(parts, lambda x: contains(body, x))) = len(parts)) as verbatim, case when contains(body, nq) and length(nq) >= 12 then instr(body, nq) - 1 end as "offset" from j)"""


@query("txt_06_quote_verification", f"with {VERIFIED} select * from v")
def txt_06(t):
    return X.verify_quotes(quotes(t), t.documents.select(F.col("doc_id").alias("paper_id"), "text"))


@query("au_09_provenance_rate", f"with {VERIFIED} select paper_id, count(*) as n, count(case when verbatim then 1 end) as n_verified, round(avg(case when verbatim then 1.0 else 0 end), 6) as rate from v group by paper_id")
def au_09(t):
    return X.provenance_rate(X.verify_quotes(quotes(t), t.documents.select(F.col("doc_id").alias("paper_id"), "text")))


@query("txt_07_snapped_quotes")
def txt_07(t):
    return X.snap_quotes(quotes(t), t.documents.select(F.col("doc_id").alias("paper_id"), "text"))


@query("txt_08_keyword_search", f"""
with b as ({BLOCKS}), h as (select *, case when contains(lower(text), 'the ') then instr(lower(text), 'the ') when contains(lower(text), 'deposited') then instr(lower(text), 'deposited') end as first from b where contains(lower(text), 'the ') or contains(lower(text), 'deposited')),
p as (select *, row_number() over (partition by paper_id order by ord) as place from h)
select paper_id, block_id, place, substring(text, greatest(1, first - 80), 160) as snippet from p where place <= 20""")
def txt_08(t):
    return X.find(blocks(t), ["the ", "deposited"])


TITLE = "case " + " ".join(f"when regexp_matches(title, '{p}') then '{n}'" for n, p in X.TITLES) + " else 'other' end"


@query("txt_09_section_class", f"with t as (select doc_id, case doc_id % 7 when 0 then 'Materials and Methods' when 1 then 'Data Availability Statement' when 2 then 'Summary' when 3 then 'Main findings' when 4 then 'Background' when 5 then 'Supplementary data' else left(text, 20) end as title from documents) select doc_id, title, {TITLE} as section from t")
def txt_09(t):
    k = F.col("doc_id") % 7
    title = F.when(k == 0, "Materials and Methods").when(k == 1, "Data Availability Statement").when(k == 2, "Summary").when(k == 3, "Main findings").when(k == 4, "Background").when(k == 5, "Supplementary data").otherwise(F.substring("text", 1, 20))
    return t.documents.select("doc_id", title.alias("title")).withColumn("section", X.section_class(F.col("title")))


LINES = """
l as (select doc_id as paper_id, trim(unnest(string_split(text, chr(10)))) as line from documents), n as (select paper_id, line, count(*) as n from l where length(line) between 1 and 90 and not starts_with(line, '|') and not regexp_matches(line, '^#{1,6}\\s') and not regexp_matches(line, '^[-*_=\\s]+$') group by all),
r as (select * from n where n >= 3 or (n = 2 and length(line) >= 15 and not regexp_matches(line, '[.!?]$')))"""


@query("txt_11_repeated_lines", f"with {LINES} select * from r")
def txt_11(t):
    return X.repeated_lines(t.documents.select(F.col("doc_id").alias("paper_id"), "text"))


@query("txt_12_section_selection", f"select paper_id, block_id from ({BLOCKS}) where section_id = 'S2' or section_id like 'S2.%' or section_class = 'abstract'")
def txt_12(t):
    return X.select_sections(blocks(t), "S2", ["abstract"]).select("paper_id", "block_id")


LOCATED = rf"""
with {structure_sql(DOCS)}, l as (select doc_id as paper_id, unnest(['b' || (doc_id % 12), 'Fig. ' || (doc_id % 3), ' Table 2', 'elsewhere']) as locator from documents),
fl as (select paper_id, nm, arg_min(block_id, ord) as float_id from (select *, nullif(trim(replace(regexp_replace(lower(regexp_extract(text, '(?i)^\W*(table|figure|fig)\.?\s*(s?\d+[a-z]?)\b', 1)), '^fig$', 'figure'), '', '') || ' ' || lower(regexp_extract(text, '(?i)^\W*(table|figure|fig)\.?\s*(s?\d+[a-z]?)\b', 2))), '') as nm from bl where kind in ('figure', 'table')) where nm is not null group by all),
k as (select *, lower(trim(locator)) as key, nullif(trim(regexp_replace(lower(regexp_extract(locator, '(?i)^\W*(table|figure|fig)\.?\s*(s?\d+[a-z]?)\b', 1)), '^fig$', 'figure') || ' ' || lower(regexp_extract(locator, '(?i)^\W*(table|figure|fig)\.?\s*(s?\d+[a-z]?)\b', 2))), '') as nm from l),
rs as (select k.paper_id, locator, coalesce(b.block_id, float_id) as block_id from k left join bl b on b.paper_id = k.paper_id and lower(b.block_id) = key left join fl on fl.paper_id = k.paper_id and fl.nm = k.nm)"""


def located(t):
    k = F.col("doc_id")
    names = F.array(F.concat(F.lit("b"), k % 12), F.concat(F.lit("Fig. "), k % 3), F.lit(" Table 2"), F.lit("elsewhere"))
    return X.resolve_locators(t.documents.select(k.alias("paper_id"), F.explode(names).alias("locator")), Z.section_blocks(docs(t)))


@query("txt_13_locator_resolution", LOCATED + " select paper_id, locator, block_id from rs")
def txt_13(t):
    return located(t).select("paper_id", "locator", "block_id")


@query("txt_13b_resolve_rate", LOCATED + " select paper_id, count(*) as n_locators, count(block_id) as n_resolved, round(count(block_id) / count(*), 6) as rate from rs group by paper_id")
def txt_13b(t):
    return X.resolve_rate(located(t))


@query("txt_14_outline", f"select paper_id, section_class, count(*) as n_blocks, sum(length(text))::bigint as n_chars, min(ord) as first_ord from ({BLOCKS}) group by all")
def txt_14(t):
    return X.outline(blocks(t))


@query("txt_15_body_check", f"select paper_id, count(case when section_class <> 'abstract' then 1 end) >= 5 as has_body from ({BLOCKS}) group by paper_id")
def txt_15(t):
    return X.has_body(blocks(t))


NAMES = "select * from (values ('HALLMARK_DEPOSITED_READS'), ('THAT_THIS_RESPONSE'), ('COUNTS_DOWNLOADED_FROM_SPACE'), ('IS_OF')) s(set_id)"


def names(t):
    return t.spark.createDataFrame([("HALLMARK_DEPOSITED_READS",), ("THAT_THIS_RESPONSE",), ("COUNTS_DOWNLOADED_FROM_SPACE",), ("IS_OF",)], "set_id string")


@query("txt_16_pathway_names", f"""
with s as (select set_id, list_filter(list_distinct(regexp_split_to_array(lower(set_id), '[^a-z0-9]+')), lambda x: length(x) >= 4 and x not in {X.STOP}) as w from ({NAMES})),
t as (select paper_id, unnest(list_distinct(regexp_split_to_array(lower(text), '[^a-z0-9]+'))) as word from ({DOCS})), e as (select set_id, len(w) as n, unnest(w) as word from s),
h as (select paper_id, set_id, n, count(*) as k, max(length(word)) as longest from t join e using (word) group by all) select paper_id, set_id, k as n_words from h where k / n >= 0.6 and longest >= 5""")
def txt_16(t):
    return X.pathway_named(names(t), docs(t))


@query("txt_17_contrast_label", "select p_partkey, replace(case when p_partkey % 2 = 0 then p_type || ' vs ' || p_brand else p_brand || ' vs ' || p_type end, '_', ' ') as label from part")
def txt_17(t):
    k = F.col("p_partkey") % 2 == 0
    name = F.when(k, F.concat(F.lit("DEG_results_"), "p_type", F.lit("_vs_"), "p_brand", F.lit("__deseq2_GSEA_Hallmark.csv"))).otherwise(F.concat("p_brand", F.lit("_vs_"), "p_type", F.lit("__limma-voom.csv")))
    return t.part.select("p_partkey", X.contrast_label(name).alias("label"))


@query("txt_18_symbol_candidates", "select finding_id, case when contains(entity, ' ') then '' when regexp_matches(entity, '^[hmr][A-Z]') then entity || ';' || substr(entity, 2) else entity end as candidates from (select finding_id, case when finding_id % 3 = 0 then 'm' || entity else entity end as entity from {finding})")
def txt_18(t):
    from assayloom.operators.joins import symbol_candidates

    e = F.when(F.col("finding_id") % 3 == 0, F.concat(F.lit("m"), "entity")).otherwise(F.col("entity"))
    return t.finding.select("finding_id", F.array_join(symbol_candidates(e), ";").alias("candidates"))


@query("txt_19_leaks", f"""
with {LINES}, o as (select doc_id as paper_id, unnest(x) as line, generate_subscripts(x, 1) - 1 as i from (select doc_id, string_split(text, chr(10)) as x from documents)), b as (select paper_id, 'P' || (i // 3) as block_id, string_agg(line, ' ' order by i) as text from o group by all),
sq as (select paper_id, block_id, regexp_replace(regexp_replace(lower(text), '[*_`\\\\]', '', 'g'), '\\s+', '', 'g') as body from b),
t as (select paper_id, 'header' as kind, line as text from r where length(line) >= 12 union all select paper_id, 'title', quote from {{quote}} where length(quote) >= 40 union all select doc_id, 'title', substring(text, 5 + doc_id % 30, 90) from documents where length(substring(text, 5 + doc_id % 30, 90)) >= 40),
p as (select distinct paper_id, kind, case when kind = 'title' then left(q, 60) else q end as pattern from (select paper_id, kind, regexp_replace(regexp_replace(lower(text), '[*_`\\\\]', '', 'g'), '\\s+', '', 'g') as q from t) where length(q) >= 12)
select paper_id, block_id, count(case when kind = 'header' then 1 end) as n_headers, count(case when kind = 'title' then 1 end) as n_titles from sq join p using (paper_id) where contains(body, pattern) and (kind = 'title' or length(body) > length(pattern)) group by all""")
def txt_19(t):
    """Blocks of three lines; repeated lines are the headers, passages and a stretch of the text the titles of references."""
    d = t.documents.select(F.col("doc_id").alias("paper_id"), "text")
    lines = d.select("paper_id", F.posexplode(F.split("text", "\n")).alias("i", "line"))
    b = lines.groupBy("paper_id", F.concat(F.lit("P"), F.floor(F.col("i") / 3)).alias("block_id")).agg(F.array_join(F.array_sort(F.collect_list(F.struct("i", "line")))["line"], " ").alias("text"))
    title = lambda df, text: df.select("paper_id", F.lit("title").alias("kind"), text.alias("text"))
    headers = X.repeated_lines(d).select("paper_id", F.lit("header").alias("kind"), F.col("line").alias("text"))
    return X.leaks(b, headers.unionByName(title(t.quote, F.col("quote"))).unionByName(title(d, F.expr("substring(text, int(5 + paper_id % 30), 90)"))))


@query("txt_20_quote_offset", f'with {VERIFIED} select paper_id, quote_id, "offset" from v where "offset" is not null')
def txt_20(t):
    return X.verify_quotes(quotes(t), t.documents.select(F.col("doc_id").alias("paper_id"), "text")).where("offset is not null").select("paper_id", "quote_id", "offset")


@query("txt_10_segments", """
with recursive f as (select doc_id as paper_id, list_filter(string_split(regexp_replace(trim(regexp_replace(text, '\\s+', ' ', 'g')), '([.!?]) ([A-Z(\\[])', '\\1' || chr(1) || '\\2', 'g'), chr(1)), lambda x: x <> '') as said from documents),
s as (select paper_id, unnest(said) as x, generate_subscripts(said, 1) as i from f),
g as (select paper_id, i, x, 0::bigint as block, length(x) as n from s where i = 1 union all
select s.paper_id, s.i, s.x, case when g.n + length(s.x) > 1200 then block + 1 else block end, case when g.n + length(s.x) > 1200 then length(s.x) else g.n + 1 + length(s.x) end from g join s on s.paper_id = g.paper_id and s.i = g.i + 1)
select paper_id, block, count(*) as n_sentences, array_to_string(list(x order by i), ' ') as text from g group by all""")
def txt_10(t):
    return X.segments(t.documents.select(F.col("doc_id").alias("paper_id"), "text"))


@query("txt_10_sections", f"with {structure_sql(DOCS)}, e as (select paper_id, spot, section_id, title, section_class, level, up, count(case when kind in ('body', 'row', 'figure', 'table') then 1 end) as n_lines from st where spot >= 0 group by all) select e.paper_id, e.spot as ord, e.section_id, e.title, e.section_class, e.level, p.section_id as parent_id, e.n_lines from e left join e p on e.paper_id = p.paper_id and e.up = p.spot")
def txt_10_sections(t):
    return Z.sections(docs(t))


@query("txt_10_blocks", f"with {structure_sql(DOCS)} select paper_id, ord, block_id, kind, section_class, section_id, text from bl")
def txt_10_blocks(t):
    return Z.section_blocks(docs(t))


@query("win_11_chunk_ranking", """
with w as (select doc_id as paper_id, text, unnest(range(0, greatest(0, ceil((length(text) - 1400) / 1200))::bigint + 1)) as chunk from documents), p as (select paper_id, chunk, lower(substring(text, (chunk * 1200 + 1)::int, 1400)) as part from w),
s as (select paper_id, chunk, len(regexp_extract_all(part, 'the')) + len(regexp_extract_all(part, 'ing')) as score from p)
select paper_id, chunk, score, row_number() over (partition by paper_id order by score desc, chunk) as place from s where score > 0 qualify place <= 3""")
def win_11(t):
    return X.rank_chunks(t.documents.select(F.col("doc_id").alias("paper_id"), "text"), ["the", "ing"])
