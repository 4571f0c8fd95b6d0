"""WARC: Merkle fixity audit of replicas.

Pages become WARC response records, laid end to end by id in files of about FILE_BYTES. A leaf is the SHA-256 of a record's bytes. The
leaves of FAN_IN consecutive ids of a file, in the order of their offsets, make a range; a node is the SHA-256 of its children's
digests and offset ranges, counted from the start of the node, FAN_IN at a time, up to one root a file. Which branch a record belongs
to follows from its id alone, and offsets are relative, so a record that is lost, grown or inserted changes its own branch
and no other. Replicas are compared by roots; only below nodes that differ are the children compared, level by level,
down to records, and offsets in the files are added up on the way down.

Record bytes are hashed in the JVM where they are read and never shuffled. An id with more than CROWD records in the first replica is spread
over shards by digest, which have a tree of their own below their range, so no group holds more than FAN_IN nodes or a few
times CROWD leaves.

Records of one id lie in the order of their shards and digests. Edge cases: a null url or html is empty in its record; a null id counts as -1; records that repeat an id and bytes are one
leaf with a count; among records of one id, a single one that is only in the first replica and a single one that is only in the
other are one change, and otherwise each is lost or added; empty tables have no files and no findings. Ids should be dense,
as a file's tree has as many levels as its span of ids needs.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from assayloom.llm._shared import table, written

FILE_BYTES, FAN_IN, CROWD = 1 << 24, 16, 64
#: The query damages page ids with these remainders: (kind, divisor, remainder), the first that fits.
DAMAGE = (("flip", 97, 13), ("loss", 101, 17), ("growth", 103, 19), ("insertion", 107, 23))
SPOT = ("file", "r", "sub")


def record_bytes(page_id: Column, url: Column, html: Column) -> Column:
    """The bytes of a response record."""
    body = F.coalesce(html, F.lit(""))
    head = F.concat(
        F.lit("WARC/1.1\r\nWARC-Type: response\r\nWARC-Record-ID: <urn:page:"),
        page_id.cast("string"),
        F.lit(">\r\nWARC-Target-URI: "),
        F.coalesce(url, F.lit("")),
        F.lit("\r\nContent-Type: text/html\r\nContent-Length: "),
        F.octet_length(body).cast("string"),
        F.lit("\r\n\r\n"),
    )
    return F.encode(F.concat(head, body, F.lit("\r\n\r\n")), "UTF-8")


def records(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """(page_id, record) for every page."""
    page = F.coalesce(F.col(id_col).cast("long"), F.lit(-1).cast("long"))
    return pages.select(page.alias("page_id"), record_bytes(page, F.col(url_col), F.col(html_col)).alias("record"))


def hashed(recs: DataFrame) -> DataFrame:
    """(page_id, digest, size, times): the written table of distinct records."""
    rows = recs.select("page_id", F.sha2("record", 256).alias("digest"), F.octet_length("record").cast("long").alias("size"))
    return written(rows.groupBy("page_id", "digest", "size").agg(F.count(F.lit(1)).alias("times")), "hashed")


def levels_of(span: int, fan_in: int) -> int:
    n = 0
    while span > 1:
        span, n = -(-span // fan_in), n + 1
    return n


def trees(a: DataFrame, b: DataFrame, file_bytes: int = FILE_BYTES, fan_in: int = FAN_IN, crowd: int = CROWD) -> tuple[list[DataFrame], list[DataFrame]]:
    """The levels of both replicas' trees, from the leaves to the roots, for tables of ``hashed`` records. The first one gives the layout."""
    size = a.agg(F.sum(F.col("size") * F.col("times"))).first()[0] or 0
    files = max(1, -(-size // file_bytes))
    ends = a.union(b).agg(F.min("page_id").alias("least"), F.max("page_id").alias("most")).first()
    low, high = (ends["least"] or 0) // files, (ends["most"] or 0) // files
    wide = written(a.groupBy("page_id").count().where(F.col("count") > crowd).select("page_id", F.ceil(F.col("count") / crowd).alias("shards")), "wide")
    most = wide.agg(F.max("shards")).first()[0] or 1
    steps = [True] * levels_of(most, fan_in) + [False] * levels_of((high - low) // fan_in + 1, fan_in)

    def tree(recs: DataFrame) -> list[DataFrame]:
        shards = F.coalesce("shards", F.lit(1))
        spot = (F.pmod("page_id", F.lit(files)).cast("long").alias("file"), F.floor((F.floor(F.col("page_id") / files) - low) / fan_in).cast("long").alias("r"), F.pmod(F.xxhash64("digest"), shards).cast("long").alias("sub"))
        leaves = recs.join(wide, "page_id", "left").select(*spot, "page_id", "digest", "times", (F.col("size") * F.col("times")).alias("bytes"), F.col("times").alias("n"))
        out = [written(laid_out(leaves, SPOT, ("page_id", "digest")), "leaves")]
        out.append(written(placed(parents(out[0], SPOT), steps, 0, fan_in), "nodes"))
        for k in range(len(steps)):
            out.append(written(placed(parents(out[-1], ("file", "up_r", "up_sub")), steps, k + 1, fan_in), "nodes"))
        return out

    return tree(a), tree(b)


def laid_out(nodes: DataFrame, above: tuple[str, ...], order: tuple[str, ...]) -> DataFrame:
    """Nodes with the records and bytes before them in their parent."""
    w = Window.partitionBy(*above).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    return nodes.select("*", F.coalesce(F.sum("n").over(w), F.lit(0)).alias("n0"), F.coalesce(F.sum("bytes").over(w), F.lit(0)).alias("start"))


def placed(nodes: DataFrame, steps: list[bool], k: int, fan_in: int) -> DataFrame:
    """Nodes of level ``k`` with their parents: shards are merged first, then ranges of ids. Roots have none."""
    if k == len(steps):
        return nodes
    up = lambda c: F.floor(F.col(c) / fan_in).cast("long")
    above = nodes.select("*", *((F.col("r").alias("up_r"), up("sub").alias("up_sub")) if steps[k] else (up("r").alias("up_r"), F.col("sub").alias("up_sub"))))
    return laid_out(above, ("file", "up_r", "up_sub"), ("r", "sub"))


def parents(nodes: DataFrame, above: tuple[str, ...]) -> DataFrame:
    """One level up: digests of the children's digests and offset ranges in their order."""
    children = F.array_sort(F.collect_list(F.struct("start", (F.col("start") + F.col("bytes")).alias("end"), "digest")))
    said = F.transform(children, lambda c: F.concat_ws(":", c["start"], c["end"], c["digest"]))
    grouped = nodes.groupBy(*(F.col(c).alias(to) for c, to in zip(above, SPOT, strict=True)))
    return grouped.agg(F.sum("n").alias("n"), F.sum("bytes").alias("bytes"), F.sha2(F.array_join(said, ",").cast("binary"), 256).alias("digest"))


def audit(a: list[DataFrame], b: list[DataFrame]) -> DataFrame:
    """The records in which two trees of ``trees`` differ, found from the roots downward.

    ``kind`` is changed, lost or added; places and offsets count from the start of the file in either replica.
    """
    roots = [t[-1].withColumns({"at": F.lit(0).cast("long"), "no": F.lit(0).cast("long")}) for t in (a, b)]
    bad = differing(*roots)
    for k in range(len(a) - 2, 0, -1):
        bad = differing(*(below(t[k], bad, side, ("file", "up_r", "up_sub")) for t, side in ((a, "a"), (b, "b"))))
    x, y = (below(t[0], bad, side, SPOT).withColumn("end", F.col("at") + F.col("bytes")) for t, side in ((a, "a"), (b, "b")))
    keys = ("file", "page_id", "digest")
    only = lambda x, y, side: x.join(y.select(*keys, "times"), [*keys, "times"], "left_anti").select("file", "page_id", F.lit(side).alias("side"), "no", "at", "end", "digest", "times")
    odd = written(only(x, y, "a").union(only(y, x, "b")), "odd")
    of = lambda c, side, name: F.max(F.when(F.col("side") == side, F.col(c))).alias(name)
    fields = [of("no", "a", "record_no"), of("at", "a", "start"), of("end", "a", "end"), of("at", "b", "found_start"), of("end", "b", "found_end"), of("digest", "a", "expected"), of("digest", "b", "found"), of("times", "a", "times"), of("times", "b", "found_times")]
    sides = odd.groupBy("file", "page_id").agg(F.count_if(F.col("side") == "a").alias("n_a"), F.count_if(F.col("side") == "b").alias("n_b"), *fields)
    simple = (F.col("n_a") <= 1) & (F.col("n_b") <= 1)
    crowded = odd.join(sides.where(~simple).select("file", "page_id"), ["file", "page_id"], "left_semi").groupBy("file", "page_id", "digest").agg(*fields).drop("digest")
    kind = F.when(F.col("found").isNull(), "lost").when(F.col("expected").isNull(), "added").otherwise("changed")
    return sides.where(simple).drop("n_a", "n_b").union(crowded).withColumn("kind", kind)


def below(nodes: DataFrame, bad: DataFrame, side: str, above: tuple[str, ...]) -> DataFrame:
    """The children of bad nodes, with their places and offsets in the file."""
    up = bad.select(*(F.col(c).alias(f"__{c}") for c in SPOT), F.coalesce(f"at_{side}", F.lit(0)).alias("at0"), F.coalesce(f"no_{side}", F.lit(0)).alias("no0"))
    met = nodes.join(up, [nodes[c] == up[f"__{to}"] for c, to in zip(above, SPOT, strict=True)])
    return met.select(*nodes.columns, (F.col("at0") + F.col("start")).alias("at"), (F.col("no0") + F.col("n0")).alias("no"))


def differing(x: DataFrame, y: DataFrame) -> DataFrame:
    """The nodes whose digests differ, or that one side lacks."""
    both = x.select(*SPOT, F.col("digest").alias("d_a"), F.col("at").alias("at_a"), F.col("no").alias("no_a")).join(y.select(*SPOT, F.col("digest").alias("d_b"), F.col("at").alias("at_b"), F.col("no").alias("no_b")), list(SPOT), "full_outer")
    return written(both.where(~F.col("d_a").eqNullSafe(F.col("d_b"))).drop("d_a", "d_b"), "bad")


def damaged(pages: DataFrame) -> DataFrame:
    """A replica of ``pages`` with damage by DAMAGE: first characters overwritten, pages lost, grown by one byte, or followed by one inserted under their id."""
    kind = F.lit(None).cast("string")
    for name, n, k in reversed(DAMAGE):
        kind = F.when(F.pmod("page_id", F.lit(n)) == k, name).otherwise(kind)
    marked = pages.withColumn("__kind", F.when(F.length("html") > 0, kind))
    html = F.when(F.col("__kind") == "flip", F.concat(F.lit("~"), F.expr("substring(html, 2)"))).when(F.col("__kind") == "growth", F.concat("html", F.lit(" "))).otherwise(F.col("html"))
    kept = marked.where("__kind is null or __kind <> 'loss'").withColumn("html", html)
    return kept.union(marked.where("__kind = 'insertion'").withColumn("html", F.lit("inserted"))).drop("__kind")


def op3_warc_fixity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Audits a replica of ``pages`` with known damage against the original; a row for each damaged record."""
    pages = table(spark, sf_dir, "pages").select("page_id", "url", "html")
    found = audit(*trees(hashed(records(pages)), hashed(records(damaged(pages)))))
    return found.select("page_id", F.col("file").alias("warc_file"), "kind", "record_no", F.col("start").alias("start_offset"), F.col("end").alias("end_offset"), "found_start", "found_end", "expected", "found")


def oracle() -> str:
    """All records of both replicas laid out and compared one by one, in DuckDB."""
    record = (
        "'WARC/1.1' || chr(13) || chr(10) || 'WARC-Type: response' || chr(13) || chr(10) || 'WARC-Record-ID: <urn:page:' || page_id || '>' || chr(13) || chr(10) || 'WARC-Target-URI: ' || url || chr(13) || chr(10)"
        " || 'Content-Type: text/html' || chr(13) || chr(10) || 'Content-Length: ' || strlen(html) || chr(13) || chr(10) || chr(13) || chr(10) || html || chr(13) || chr(10) || chr(13) || chr(10)"
    )
    kind = " ".join(f"when page_id % {n} = {k} then '{name}'" for name, n, k in DAMAGE)
    laid = lambda t: f"""
  select page_id, page_id % files as warc_file, sha256({record}) as digest, strlen({record}) as size,
    (row_number() over w - 1)::bigint as no, (sum(size) over (w rows between unbounded preceding and current row))::bigint as upto
  from {t}, f window w as (partition by warc_file order by page_id, digest)"""  # noqa: E731
    return f"""
with p as (select coalesce(page_id, -1) as page_id, coalesce(url, '') as url, coalesce(html, '') as html from pages),
f as (select greatest(1, ceil(sum(strlen({record})) / {FILE_BYTES})::bigint) as files from p),
k as (select *, case when html = '' then null {kind} end as kind from p),
q as (
  select page_id, url, case kind when 'flip' then '~' || substring(html, 2) when 'growth' then html || ' ' else html end as html from k where kind is distinct from 'loss'
  union all select page_id, url, 'inserted' from k where kind = 'insertion'),
a as ({laid("p")}),
b as ({laid("q")}),
x as (select * from a where not exists (select 1 from b where a.page_id = b.page_id and a.digest = b.digest)),
y as (select * from b where not exists (select 1 from a where a.page_id = b.page_id and a.digest = b.digest))
select coalesce(x.page_id, y.page_id) as page_id, coalesce(x.warc_file, y.warc_file) as warc_file, case when y.digest is null then 'lost' when x.digest is null then 'added' else 'changed' end as kind,
  x.no as record_no, x.upto - x.size as start_offset, x.upto as end_offset, y.upto - y.size as found_start, y.upto as found_end, x.digest as expected, y.digest as found
from x full join y on x.page_id = y.page_id
"""
