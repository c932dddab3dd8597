"""Merkle manifest of a table: a subtree per language, a root over all, and a witness for every row.

Rows are numbered in order within their group and dealt into aligned blocks of ``2^levels``. A block is one streaming
append: every open subtree keeps the partial witnesses of the leaves below it, and each sibling that completes later
extends them. The roots of the blocks are appended in the same way, block by block, until one node is left of a group;
then the groups' roots are. A witness is the list of steps from a leaf upwards: ``L`` or ``R`` and the digest of the
sibling at that side, or ``-`` where the node was alone.

Only digests are shuffled; the texts are hashed where they are read. Blocks bound what a task holds: a group of any size
is many blocks, and equal rows are dealt out like others.

Nulls are hashed as ``-``; a null language is a group of its own, before the others; null ids come first. Empty and very
long texts are hashed whole. Rows with equal ids are ordered by their digests; equal rows are leaves of their own, and
which is which makes no difference. An empty table has no rows. Other columns are not read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tallyforge.llm.common import settle

#: A block holds 2^LEVELS nodes.
LEVELS = 10
FIELDS = ("doc_id", "source", "lang", "n_chars", "text")


def digest(text: str) -> str:
    return hashlib.sha256(text.encode()).hexdigest()


class Appender:
    """Streaming aligned append. Items are leaves or, with a height, roots of complete subtrees that lie on their left edge.

    ``witness[i]`` holds the steps of item i so far. ``close`` lifts the last nodes until one is left, of at least ``height``.
    """

    def __init__(self) -> None:
        self.witness: list[list[str]] = []
        #: Open subtrees from left to right: height, first item, digest.
        self.open: list[tuple[int, int, str]] = []

    def add(self, node: str, height: int = 0) -> None:
        if self.open and self.open[-1][0] < height:
            raise ValueError("a subtree can't follow a smaller one")
        self.open.append((height, len(self.witness), node))
        self.witness.append([])
        self._merge()

    def _extend(self, first: int, end: int, step: str) -> None:
        for i in range(first, end):
            self.witness[i].append(step)

    def _merge(self) -> None:
        while len(self.open) > 1 and self.open[-1][0] == self.open[-2][0]:
            (height, first, left), (_, middle, right) = self.open[-2:]
            self._extend(first, middle, "R" + right)
            self._extend(middle, len(self.witness), "L" + left)
            self.open[-2:] = [(height + 1, first, digest(left + right))]

    def close(self, height: int = 0) -> str:
        while len(self.open) > 1 or self.open[-1][0] < height:
            level, first, node = self.open[-1]
            self._extend(first, len(self.witness), "-")
            self.open[-1] = (level + 1, first, digest(node))
            self._merge()
        return self.open[0][2]


def field(value: Column) -> Column:
    """A value with its length in bytes in front; null is ``-``."""
    value = value.cast("string")
    return F.when(value.isNull(), F.lit("-")).otherwise(F.concat(F.octet_length(value).cast("string"), F.lit(":"), value))


def leaf(columns: list[Column]) -> Column:
    return F.sha2(F.concat(*map(field, columns)), 256)


def _count_off(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The rows of a sorted partition with their numbers within the partition's run of a group."""
    part, last, n = TaskContext.get().partitionId(), None, 0
    for batch in batches:
        numbers = []
        for group in batch.column("group").to_pylist():
            n = n + 1 if group == last else 0
            last = group
            numbers.append(n)
        columns = [*batch.columns, pa.array([part] * len(numbers), pa.int32()), pa.array(numbers, pa.int64())]
        yield pa.RecordBatch.from_arrays(columns, names=[*batch.schema.names, "part", "i"])


def numbered(rows: DataFrame, order: list[str]) -> DataFrame:
    """Rows of (group, ...) with ``pos``, their place in the group by ``order``, and ``n``, the group's rows.

    The rows are dealt out by ranges of group and order, so that a group spreads over many partitions; equal rows part by
    the place they were read from. A partition's rows are counted off, and the counts before it are added.
    """
    rows = rows.withColumn("tie", F.monotonically_increasing_id())
    keys = ["group", *order, "tie"]
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.drop("tie").schema.fields)
    ranged = rows.repartitionByRange(*keys).sortWithinPartitions(*keys).drop("tie")
    counted = settle(ranged.mapInArrow(_count_off, f"{schema}, part int, i bigint"), "counted-off")
    before = Window.partitionBy("group").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    starts = counted.groupBy("group", "part").agg(F.count("*").alias("c")).select(
        "group", "part",
        F.coalesce(F.sum("c").over(before), F.lit(0)).alias("start"),
        F.sum("c").over(Window.partitionBy("group")).alias("n"),
    )
    return counted.join(starts, ["group", "part"]).withColumn("pos", F.col("i") + F.col("start")).drop("i", "part", "start")


def _grow(levels: int, names: list[str]):
    def grow(nodes: pa.Table) -> pa.Table:
        nodes = nodes.sort_by("pos")
        tree = Appender()
        for node in nodes.column("node").to_pylist():
            tree.add(node)
        # a block among others is lifted to the height of all, a group's only block as far as it needs
        top = tree.close(levels if nodes.column("n")[0].as_py() > 1 << levels else 0)
        nodes = nodes.append_column("steps", pa.array(tree.witness, pa.list_(pa.string())))
        return nodes.append_column("top", pa.array([top] * len(tree.witness), pa.string())).select(names)

    return grow


def climb(nodes: DataFrame, levels: int = LEVELS) -> DataFrame:
    """Nodes of (group, pos, n, node, ...) with ``steps``, their whole witness in the group, and ``top``, the group's root."""
    nodes = nodes.withColumn("block", F.shiftright("pos", levels))
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in nodes.schema.fields) + ", steps array<string>, top string"
    grown = settle(nodes.groupBy("group", "block").applyInArrow(_grow(levels, [*nodes.columns, "steps", "top"]), schema), "grown")
    if not grown.agg(F.max("block")).first()[0]:
        return grown.drop("block")
    roots = grown.where(F.col("pos") == F.shiftleft("block", levels)).select(
        "group", F.col("block").alias("pos"), F.ceil(F.col("n") / (1 << levels)).alias("n"), F.col("top").alias("node")
    )
    above = climb(roots, levels).select("group", F.col("pos").alias("block"), F.col("steps").alias("more"), F.col("top").alias("peak"))
    joined = grown.join(above, ["group", "block"])
    return joined.withColumn("steps", F.concat("steps", "more")).withColumn("top", F.col("peak")).drop("block", "more", "peak")


def fold(node: Column, steps: Column) -> Column:
    """The root that a leaf and its witness give."""

    def up(below: Column, step: Column) -> Column:
        side, sibling = F.substring(step, 1, 1), F.substring(step, 2, 64)
        both = F.when(side == "L", F.concat(sibling, below)).when(side == "R", F.concat(below, sibling)).otherwise(below)
        return F.sha2(both, 256)

    return F.aggregate(steps, node, up)


def siblings(steps: Column) -> Column:
    """The digests of a witness, from the leaf upwards."""
    return F.transform(F.filter(steps, lambda s: s != "-"), lambda s: F.substring(s, 2, 64))


def witnesses(rows: DataFrame, levels: int = LEVELS) -> DataFrame:
    """Rows of (group string, leaf string, ...) ordered by ``doc_id`` and leaf, with subroot, root and steps.

    Groups are ordered bytewise. ``steps`` leads from the leaf over the group's root to the root of all.
    """
    leaves = climb(numbered(rows, ["doc_id", "leaf"]).withColumn("node", F.col("leaf")), levels)
    groups = leaves.where("pos = 0").select(F.lit("").alias("group"), F.col("group").alias("name"), F.col("top").alias("node"))
    tops = climb(numbered(groups, ["name"]), levels).select(
        F.col("name").alias("group"), F.col("steps").alias("more"), F.col("top").alias("root")
    )
    joined = leaves.join(tops, "group")
    return joined.withColumn("steps", F.concat("steps", "more")).withColumnRenamed("top", "subroot").drop("pos", "n", "node", "more")


def manifest(docs: DataFrame, levels: int = LEVELS) -> DataFrame:
    """A row per document: ids, digests and its witness; ``changed`` is the leaf with one added to n_chars, for tamper tests."""
    c = {name: F.col(name) for name in FIELDS}
    more = c | {"n_chars": c["n_chars"].cast("decimal(20,0)") + 1}
    rows = docs.select(
        "doc_id",
        # '' sorts before every name, and names keep their order
        F.when(c["lang"].isNull(), F.lit("")).otherwise(F.concat(F.lit("+"), c["lang"])).alias("group"),
        leaf([c[k] for k in FIELDS]).alias("leaf"),
        F.when(F.crc32(c["doc_id"].cast("string")) % 7 == 0, leaf([more[k] for k in FIELDS])).alias("changed"),
    )
    return witnesses(rows, levels)


def prove(docs: DataFrame, levels: int = LEVELS) -> DataFrame:
    """Digests and proofs of all documents; the proof is folded from the changed leaf where there is one."""
    out = manifest(docs, levels).withColumn("folded_root", fold(F.coalesce("changed", "leaf"), F.col("steps")))
    return out.select(
        "doc_id", "leaf", "subroot", "root",
        F.sha2(F.array_join(siblings(F.col("steps")), ""), 256).alias("proof_sha256"),
        "folded_root",
        (F.col("folded_root") == F.col("root")).alias("verified"),
    )
