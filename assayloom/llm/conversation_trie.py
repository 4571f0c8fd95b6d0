"""Conversation prefix trie by truncation peeling.

A node is a distinct sequence of first turns. The trie is never built and then counted: conversations are peeled from their last turn.
Those that end at the greatest depth become nodes; a finished node gives its sums to the node without its last turn, where it meets
what ended there and what else survived; and so on to the root. A node is known once everything below it is peeled, and its sums are
complete at that moment.

* A turn is a code of 20 bytes: 128 bits of the SHA-256 of role and text, and the text's length. A conversation is the string of its
  codes, so stripping the last turn is cutting 20 bytes, and byte order is the order of the trie. Texts stop where they are read.
* Conversations of the same codes are merged before they are sorted: a row for each 4,096 ids holds how many there are, the
  smallest, and the ids joined. A conversation that a third of all have is thus a few rows.
* Rows are dealt by range of their codes and peeled longest first, in falling byte order, as they stream by; what a task keeps is one
  path. A node that is a prefix of a task's first or last conversation may go on in the task beside it: these make two paths a
  task at most, whose sums and nothing else are peeled once more, in one task with two rows for each task before. So the number of
  passes doesn't grow with the depth, and no group has to fit anywhere.
* Hashes of the ids that end at a node are fed in order, piece by piece.

Edge cases: rows without a conv_id belong to no conversation; a null turn comes first; turns of one number lie by the bytes of their code; null roles and texts are
empty; a conversation may be left with no turn and ends at the root; rows that repeat are turns of their own; an empty table has no
nodes, not even a root. Other columns play no part. One conversation is one row of 20 bytes a turn (100 million turns at most).
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from assayloom.llm._shared import small_batches, table, written
from assayloom.llm.fixed_sql import crc32_sql

CODE = 20
#: Ids of one row while conversations of the same turns are merged: 2^12.
PIECE_BITS = 12
#: Nodes of an Arrow batch.
BATCH = 8192
SUMS = ("n", "least", "children", "leaves", "saved")
#: A finished node, or (``chain`` true) a path that may go on in another task, with the sums of each of its nodes.
FIELDS = (
    "chain boolean, node string, parent string, depth bigint, conv_id bigint, n_convs bigint, n_children bigint, n_leaves bigint, saved_tokens bigint, ends_sha256 string, "
    "codes binary, n array<bigint>, least array<bigint>, children array<bigint>, leaves array<bigint>, saved array<bigint>, ends array<string>"
)
ARROW = pa.schema(
    [("chain", pa.bool_()), ("node", pa.string()), ("parent", pa.string()), *((c, pa.int64()) for c in ("depth", "conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens")), ("ends_sha256", pa.string()), ("codes", pa.binary())]
    + [(c, pa.list_(pa.int64())) for c in SUMS]
    + [("ends", pa.list_(pa.string()))]
)


def turn_code(role: Column, text: Column) -> Column:
    """40 hex digits: 128 bits of the digest of role and text, and the text's bytes."""
    role, text = F.coalesce(role, F.lit("")), F.coalesce(text, F.lit(""))
    return F.concat(F.substring(F.sha2(F.concat(F.octet_length(role).cast("string"), F.lit(":"), role, text), 256), 1, 32), F.lpad(F.hex(F.octet_length(text)), 8, "0"))


def conversations(turns: DataFrame, family: Column | None = None) -> DataFrame:
    """(family, conv_id, codes): each conversation's turns in order, dealt by ``family``."""
    rows = turns.where(F.col("conv_id").isNotNull()).select("conv_id", "turn", turn_code(F.col("role"), F.col("text")).alias("code"))
    rows = rows.withColumn("family", F.col("conv_id") if family is None else family).repartition("family")
    # sorted structs: null turns first
    ordered = F.array_sort(F.collect_list(F.struct(F.col("turn").isNotNull().alias("known"), F.coalesce("turn", F.lit(0)).alias("turn"), "code")))
    return rows.groupBy("family", "conv_id").agg(F.unhex(F.array_join(F.transform(ordered, lambda t: t["code"]), "")).alias("codes"))


def rebranched(turns: DataFrame, of: int = 5, spread: int = 9) -> DataFrame:
    """(conv_id, codes): the first h turns of conversation c - c % of, then the own turns after the first h; h = crc32(c) % spread."""
    own = conversations(turns, F.col("conv_id") - F.col("conv_id") % of)
    head = F.max(F.when(F.col("conv_id") == F.col("family"), F.substring("codes", 1, CODE * (spread - 1)))).over(Window.partitionBy("family"))
    h = (F.crc32(F.col("conv_id").cast("string")) % spread * CODE).cast("int")
    first = F.coalesce(F.substring(head, F.lit(1), h), F.unhex(F.lit("")))
    return own.select("conv_id", F.concat(first, F.expr(f"substring(codes, cast(crc32(cast(conv_id as string)) % {spread} * {CODE} as int) + 1)")).alias("codes"))


def merged(convs: DataFrame) -> DataFrame:
    """(codes, piece, n, least, ids): conversations of the same codes, a row for each 2^PIECE_BITS ids."""
    ids = F.array_sort(F.collect_list("conv_id"))
    found = convs.groupBy("codes", F.shiftright("conv_id", PIECE_BITS).alias("piece")).agg(ids.alias("ids"))
    return found.select("codes", "piece", F.size("ids").cast("long").alias("n"), F.element_at("ids", 1).alias("least"), F.array_join(F.transform("ids", lambda i: i.cast("string")), ",").alias("ids"))


class Node:
    """Sums of a node while it is open."""

    __slots__ = ("children", "depth", "ends", "key", "least", "leaves", "n", "saved", "size", "state")

    def __init__(self, depth: int, state, size: int) -> None:
        self.depth, self.state, self.size = depth, state, size
        self.key = state.hexdigest()
        self.n = self.children = self.leaves = self.saved = 0
        self.least: int | None = None
        self.ends = None

    def add(self, n: int, least: int | None, children: int, leaves: int, saved: int) -> None:
        self.n += n
        self.children += children
        self.leaves += leaves
        self.saved += saved
        if least is not None and (self.least is None or least < self.least):
            self.least = least

    def end(self, ids: str) -> None:
        if self.ends is None:
            self.ends = hashlib.sha256(ids.encode())
        else:
            self.ends.update(f",{ids}".encode())

    def ended(self) -> str | None:
        return self.ends if isinstance(self.ends, str | None) else self.ends.hexdigest()


class Peel:
    """Peels conversations that come in falling order of their codes. ``whole``: nothing goes on elsewhere."""

    def __init__(self, whole: bool) -> None:
        self.whole = whole
        self.path = [Node(0, hashlib.blake2b(digest_size=16), 0)]
        self.codes = b""
        self.first: bytes | None = None
        #: Nodes of ``path`` down to this depth are prefixes of the first conversation.
        self.shared = 0
        self.left: list[Node] = []
        self.out: list[tuple] = []

    def to(self, codes: bytes) -> Node:
        """The node of ``codes``, after all that isn't a prefix of it has been peeled."""
        keep = 0
        if self.first is None:
            self.first, self.shared = codes, len(codes) // CODE
        else:
            most = min(len(codes), len(self.codes))
            while keep * CODE < most and codes[keep * CODE : (keep + 1) * CODE] == self.codes[keep * CODE : (keep + 1) * CODE]:
                keep += 1
            self.strip(keep)
            self.shared = min(self.shared, keep)
        for d in range(keep, len(codes) // CODE):
            code = codes[d * CODE : (d + 1) * CODE]
            state = self.path[-1].state.copy()
            state.update(code)
            self.path.append(Node(d + 1, state, int.from_bytes(code[16:], "big")))
        self.codes = codes
        return self.path[-1]

    def strip(self, keep: int) -> None:
        """Strip last turns until ``keep`` are left; each finished node adds its sums to the one above."""
        while len(self.path) > keep + 1:
            node = self.path.pop()
            if node.depth <= self.shared and not self.whole:
                self.left.append(node)
            else:
                self.finish(node, self.path[-1])

    def finish(self, node: Node, above: Node | None) -> None:
        leaves = node.leaves if node.children else 1
        saved = node.saved + (node.n - 1) * node.size
        ends = node.ended() or hashlib.sha256(b"").hexdigest()
        self.out.append((False, node.key, above.key if above else None, node.depth, node.least, node.n, node.children, leaves, saved, ends, *[None] * 7))
        if above:
            above.add(node.n, node.least, 1, leaves, saved)

    def close(self) -> None:
        """The end of the run: everything left is finished, or handed on as at most two paths."""
        if self.first is None:
            return
        if self.whole:
            self.strip(0)
            self.finish(self.path[0], None)
            return
        self.chain(self.codes, self.path)
        if self.left:
            # from the deepest of the first conversation up to where the last one leaves it
            top = min(n.depth for n in self.left)
            fill = [None] * top
            self.chain(self.first, [*fill, *sorted(self.left, key=lambda n: n.depth)])

    def chain(self, codes: bytes, nodes: list[Node | None]) -> None:
        sums = [[(getattr(n, c) if n else (None if c == "least" else 0)) for n in nodes] for c in SUMS]
        self.out.append((True, *[None] * 9, codes[: CODE * (len(nodes) - 1)], *sums, [n.ended() if n else None for n in nodes]))

    def taken(self) -> pa.RecordBatch:
        rows, self.out = self.out, []
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), ARROW.types, strict=True)], schema=ARROW)


def _peeled(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    peel = Peel(whole=False)
    for batch in batches:
        for codes, n, least, ids in zip(*(batch.column(c).to_pylist() for c in ("codes", "n", "least", "ids")), strict=True):
            node = peel.to(codes)
            node.add(n, least, 0, 0, 0)
            node.end(ids)
            if len(peel.out) >= BATCH:
                yield peel.taken()
    peel.close()
    if peel.out:
        yield peel.taken()


def _joined(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    peel = Peel(whole=True)
    for batch in batches:
        for row in batch.select(["codes", *SUMS, "ends"]).to_pylist():
            peel.to(row["codes"])
            for node, *sums, ends in zip(peel.path, *(row[c] for c in SUMS), row["ends"], strict=True):
                node.add(*sums)
                node.ends = ends or node.ends
            if len(peel.out) >= BATCH:
                yield peel.taken()
    peel.close()
    if peel.out:
        yield peel.taken()


def trie(convs: DataFrame) -> DataFrame:
    """Nodes of the conversations ``convs`` (conv_id, codes): node, parent (keys), and the columns of the query."""
    small_batches(convs.sparkSession)
    rows = written(merged(convs), "merged")  # sampled and read
    run = rows.repartitionByRange("codes").sortWithinPartitions(F.desc("codes"), "piece")
    parts = written(run.select("codes", "n", "least", "ids").mapInArrow(_peeled, FIELDS), "peeled")
    chains = parts.where("chain").select("codes", *SUMS, "ends").repartition(1).sortWithinPartitions(F.desc("codes"))
    last = chains.mapInArrow(_joined, FIELDS)
    nodes = [x.where("not chain").select("node", "parent", "depth", "conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256") for x in (parts, last)]
    nodes = written(nodes[0].unionByName(nodes[1]), "nodes")
    above = nodes.where("n_children > 0").select(F.col("node").alias("parent"), F.col("conv_id").alias("parent_conv_id"))
    return nodes.join(above, "parent", "left")


def op11_conversation_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    nodes = trie(rebranched(table(spark, sf_dir, "conversations")))
    return nodes.select("conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256")


def oracle() -> str:
    """DuckDB SQL: every prefix of every rebuilt conversation, grouped."""
    return f"""
with t as (select conv_id, turn, coalesce(role, '') as role, coalesce(text, '') as text from conversations where conv_id is not null),
o as (select conv_id, list(sha256(strlen(role) || ':' || role || text) order by turn nulls first) as k, list(strlen(text) order by turn nulls first) as s, {crc32_sql("conv_id::varchar")} % 9 as h from t group by conv_id),
r as (select o.conv_id, list_concat(coalesce(b.k[1:o.h], []), o.k[o.h + 1:]) as k, list_concat(coalesce(b.s[1:o.h], []), o.s[o.h + 1:]) as s from o left join o b on b.conv_id = o.conv_id - o.conv_id % 5),
e as (select conv_id, d, sha256(array_to_string(k[1:d], '')) as node, case when d > 0 then sha256(array_to_string(k[1:d - 1], '')) end as parent, case when d > 0 then s[d] else 0 end as size, d = len(k) as ends from (select *, unnest(range(0, len(k) + 1)) as d from r)),
n as (select node, any_value(parent) as parent, min(d) as depth, min(conv_id) as conv_id, count(*) as n_convs, any_value(size) as size, sha256(coalesce(string_agg(conv_id::varchar, ',' order by conv_id) filter (where ends), '')) as ends_sha256 from e group by node),
c as (select parent, count(*) as n_children from n where parent is not null group by parent),
u as (select distinct e.node as below, a.node as top from e join e a using (conv_id) where a.d <= e.d),
s as (select u.top, sum((n.n_convs - 1) * n.size)::bigint as saved_tokens, count(*) filter (where c.parent is null) as n_leaves from u join n on n.node = u.below left join c on c.parent = n.node group by u.top)
select n.conv_id, n.depth, p.conv_id as parent_conv_id, n.n_convs, coalesce(c.n_children, 0) as n_children, s.n_leaves, s.saved_tokens, n.ends_sha256
from n join s on s.top = n.node left join n p on p.node = n.parent left join c on c.parent = n.node
"""
