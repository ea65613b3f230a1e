"""Sharding by a k-d tree over document metadata.

Nodes are split at the weighted median of bytes along their widest dimension, all
nodes of a level at once, until the leaves have the target bytes: the total is divided
among as many leaves as it has targets, and a node of m leaves is cut at the share of
m // 2 of them. Medians come from histograms that are refined around the middle; the
driver sees one bin per node and pass, and rows find their node by a look-up per level,
so a tree may have many thousands of leaves. Rows that tie on the value are split by
content digest, then id digest: equal texts stay together unless the middle falls among
them, and a group of any size can be split.

* NULL text has 0 bytes (size 1), no lines, and sorts first by its letters.
* A text longer than the target has a leaf of its own or shares one; texts are not cut.
* Repeated rows get slots of their own; rows equal in id and text share a leaf. An empty
  table gives no rows and one leaf.
* Further columns are ignored by ``assign`` and kept by ``sharded``.
"""

from __future__ import annotations

import json
import math
from dataclasses import dataclass, replace

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from crawlsight.llm.common import running
from crawlsight.session import stage

#: Metadata dimensions in order of preference among equally wide ones. All are functions
#: of the text, so copies share a place; ``code`` makes a dimension of a label column.
DIMENSIONS = ("size", "lines", "letters", "text_crc32")
#: SQL: a row's value in the dimension of this number.
_AT = f"element_at(array({', '.join(DIMENSIONS)}), dimension)"

#: Tables by node (some 40 bytes a row) are broadcast up to this length, joined by a shuffle beyond it.
BROADCAST_NODES = 200_000


@dataclass(frozen=True)
class ShardOptions:
    target_bytes: int | None = None  # of a leaf; without it, the total's share of ``leaves``
    leaves: int = 16
    bins: int = 1024  # per node and pass
    tolerance: float = 0.0005  # share of a node's bytes that a cut may miss the median by
    slot_rows: int = 2_000  # rows that are numbered at a time
    slot_parts: int = 100_000  # at most, so that the totals of a shard's parts stay a small table


@dataclass(frozen=True)
class Cut:
    """Rows with a smaller value, or the same and at most this tie key, go left."""

    dimension: str
    value: int
    tie: int


def code(column: str) -> str:
    """SQL: a number in the order of the first seven bytes; -1 for NULL."""
    return f"coalesce(cast(conv(rpad(hex(substring(cast({column} as binary), 1, 7)), 14, '0'), 16, 10) as bigint), -1L)"


def _metadata() -> list:
    text = "cast(coalesce(text, '') as binary)"
    return [
        F.col("doc_id"),
        F.expr(f"cast(octet_length({text}) + 1 as bigint)").alias("size"),
        F.expr(f"crc32({text})").alias("text_crc32"),
        F.expr("cast(regexp_count(coalesce(text, ''), '\\n') as bigint)").alias("lines"),
        F.expr(code("substring(ltrim(text), 1, 7)")).alias("letters"),
        F.expr(f"crc32({text}) * 2147483648 + (xxhash64(doc_id) & 2147483647)").alias("tie"),
    ]


def _look_up(rows: DataFrame, columns: str, values: list[tuple], how: str = "inner") -> DataFrame:
    """``rows`` with the columns that ``values`` give their node. The table has at most a row per leaf."""
    names, types = zip(*(c.split() for c in columns.split(", ")))
    if [v[0] for v in values] == [1]:  # the root, where every row is as long as it is asked for
        return rows.select("*", *(F.lit(v).cast(t).alias(n) for n, t, v in zip(names[1:], types[1:], values[0][1:])))
    text = json.dumps([dict(zip(names, v)) for v in values])
    given = rows.sparkSession.sql(f"select inline(from_json(:given, 'array<struct<{columns}>>'))", args={"given": text})
    return rows.join(F.broadcast(given) if len(values) <= BROADCAST_NODES else given, "node", how)


@dataclass(frozen=True)
class Middle:
    """Where to look for a node's median: among keys from ``lo`` to ``hi``, above the weight ``below``.
    The keys are values of the dimension, or ties of the rows that have ``value`` in it."""

    dimension: int
    value: int | None
    lo: int
    hi: int
    goal: float
    slack: float
    below: float = 0.0
    weight: float = 0.0


def _medians(rows: DataFrame, asked: dict[int, Middle], bins: int) -> dict[int, Middle]:
    """Per node the range of keys in which the running weight passes its goal: one key, or
    several that together are lighter than ``slack``. A pass returns one bin per node."""
    found: dict[int, Middle] = {}
    while asked:
        given = [(n, m.dimension, m.value, m.lo, m.hi, (m.hi - m.lo) // bins + 1, m.goal - m.below) for n, m in asked.items()]
        near = _look_up(rows, "node bigint, dimension int, value bigint, first bigint, last bigint, width bigint, goal double", given)
        near = near.select("node", "size", "first", "last", "width", "goal", F.expr(f"if(value is null, {_AT}, if({_AT} = value, tie, null))").alias("key"))
        binned = near.filter("key between first and last").withColumn("bin", F.expr("(key - first) div width"))
        weights = binned.groupBy("node", "goal", "bin").agg(F.sum("size").alias("w"), F.min("key").alias("lo"), F.max("key").alias("hi"))
        node = Window.partitionBy("node")
        upto = weights.select("*", F.sum("w").over(node.orderBy("bin")).alias("upto"), F.sum("w").over(node).alias("total"))
        got = {r.node: r for r in upto.filter("upto - w < goal and (upto >= goal or upto = total)").collect()}
        ask = {}
        for n, m in asked.items():
            if r := got.get(n):
                m = replace(m, lo=r.lo, hi=r.hi, below=m.below + r.upto - r.w, weight=float(r.w))
            if r is None or m.lo == m.hi or m.weight <= m.slack:
                found[n] = m
            else:
                ask[n] = m
        asked = ask
    return found


@dataclass(frozen=True)
class Tree:
    """Cuts by node; node 1 is the root, node n has the children 2n and 2n + 1."""

    cuts: dict[int, Cut]
    leaf: dict[int, int]  # number of each leaf, left to right

    def nodes(self, rows: DataFrame) -> DataFrame:
        """``rows`` with the metadata, and their ``node``: one look-up per level."""
        rows = rows.withColumn("node", F.lit(1).cast("bigint"))
        for level in range(max(self.cuts, default=0).bit_length()):
            values = [(n, DIMENSIONS.index(c.dimension) + 1, c.value, c.tie) for n, c in self.cuts.items() if n.bit_length() == level + 1]
            at = _look_up(rows, "node bigint, dimension int, value bigint, last bigint", values, "left")
            below = F.expr(f"2 * node + if({_AT} < value or ({_AT} = value and tie <= last), 0, 1)")
            rows = at.select(*rows.columns[:-1], F.when(F.col("dimension").isNull(), F.col("node")).otherwise(below).alias("node"))
        return rows

    def shards(self, rows: DataFrame) -> DataFrame:
        """``rows`` with the metadata, and their ``shard``."""
        at = _look_up(self.nodes(rows), "node bigint, shard int", list(self.leaf.items()))
        return at.drop("node")


def leaf_count(meta: DataFrame, options: ShardOptions) -> int:
    """As many leaves as the total has targets."""
    if options.target_bytes is None:
        return options.leaves
    total = meta.agg(F.sum("size")).first()[0] or 0
    return max(1, -(-total // options.target_bytes))


def build(meta: DataFrame, options: ShardOptions = ShardOptions()) -> Tree:
    """The tree over staged metadata."""
    share = {1: leaf_count(meta, options)}
    cuts: dict[int, Cut] = {}
    root: dict[str, int] = {}
    while open_nodes := [n for n, m in share.items() if m > 1 and n not in cuts]:
        rows = _look_up(Tree(cuts, {}).nodes(meta), "node bigint", [(n,) for n in open_nodes])
        ends = [f(d).alias(f"{p}_{d}") for d in (*DIMENSIONS, "tie") for p, f in (("lo", F.min), ("hi", F.max))]
        extents = {r.node: r for r in rows.groupBy("node").agg(F.sum("size").alias("w"), *ends).collect()}
        if not extents:
            break
        asked, dims = {}, {}
        for n, e in extents.items():
            width = {d: e[f"hi_{d}"] - e[f"lo_{d}"] for d in DIMENSIONS}
            root = root or {d: max(1, w) for d, w in width.items()}
            d = dims[n] = max(DIMENSIONS, key=lambda d: width[d] / root[d])
            goal = e.w * (share[n] // 2) / share[n]
            asked[n] = Middle(DIMENSIONS.index(d) + 1, None, e[f"lo_{d}"], e[f"hi_{d}"], goal, e.w * options.tolerance)
        middle = _medians(rows, asked, options.bins)
        heavy = {
            n: replace(m, value=m.hi, lo=extents[n].lo_tie, hi=extents[n].hi_tie, goal=m.goal - m.below, below=0.0)
            for n, m in middle.items() if m.weight > m.slack
        }
        split = _medians(rows, heavy, options.bins)
        for n, m in middle.items():
            tie = 2**63 - 1
            if t := split.get(n):
                # Nearer to the goal with these rows, or without them.
                tie = t.hi if t.below + t.weight - t.goal <= t.goal - t.below else t.lo - 1
            cuts[n] = Cut(dims[n], m.hi, tie)
        for n in extents:
            share[2 * n], share[2 * n + 1] = share[n] // 2, share[n] - share[n] // 2
        for n in open_nodes:
            if n not in extents:  # an empty node stays a leaf
                share[n] = 1

    leaf: dict[int, int] = {}
    pending = [1]
    while pending:
        n = pending.pop()
        if n in cuts:
            pending += [2 * n + 1, 2 * n]
        else:
            leaf[n] = len(leaf)
    return Tree(cuts, leaf)


def assign(docs: DataFrame, options: ShardOptions = ShardOptions()) -> DataFrame:
    """doc_id, size, text_crc32, shard, slot (gapless from 0 in its shard)."""
    meta = stage(docs.select(*_metadata()), "shard_metadata")
    tree = build(meta, options)
    parts = min(options.slot_parts, max(1, math.ceil(meta.count() / len(tree.leaf) / options.slot_rows)))
    rows = tree.shards(meta).select(
        "doc_id", "size", "text_crc32", "shard",
        F.expr(f"cast(pmod(xxhash64(doc_id, text_crc32, size), {parts}L) as int)").alias("part"), F.lit(1).alias("one"),
    )
    numbered = running(rows, ["shard"], "part", ["doc_id", "text_crc32", "size"], {"upto": "one"})
    return numbered.select("doc_id", "size", "text_crc32", "shard", (F.col("upto") - 1).alias("slot"))


def sharded(docs: DataFrame, options: ShardOptions = ShardOptions()) -> DataFrame:
    """The documents with all their columns and ``shard``; they are not shuffled."""
    meta = stage(docs.select(*_metadata()), "shard_metadata")
    rows = docs.select(F.struct("*").alias("row"), *_metadata())
    return build(meta, options).shards(rows).select("row.*", "shard")
