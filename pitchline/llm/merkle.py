"""A Merkle manifest written as postorder append logs.

The leaves of a tree are numbered in order and cut into aligned blocks of
2^BITS.  A builder reads one block and appends its nodes in the order in which
they complete; the roots of the blocks are the leaves of the next tier, so a
tree of n leaves takes log(n) / BITS tiers, each one shuffle of small rows.

Whatever the shape of the right edge, the node over the leaves up to e at
level h is the (2e - popcount(e) + h)-th of its log: before leaf e stand e
leaves and the e - popcount(e) runs that they completed.  A block begins where
the same count of its number is all that stands before it, so the formula
holds inside a block, for its own leaves, as well.  Proofs address siblings by
it and search for nothing.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import reduce

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StringType, StructField, StructType

from pitchline.session import cut

#: Levels of a block: a task holds 2^BITS leaves of one block, and their proofs.
BITS = 10
HEX = 64


def leaf_digest(*fields: Column) -> Column:
    """Lower-case hex SHA-256 of the fields: ``-`` for null, else UTF-8 byte count, ``:`` and value."""
    told = (c.cast("string") for c in fields)
    return F.sha2(F.concat(*(F.coalesce(F.concat(F.octet_length(s).cast("string"), F.lit(":"), s), F.lit("-")) for s in told)), 256)


def _digest(told: str) -> str:
    return hashlib.sha256(told.encode()).hexdigest()


def position(last: int, level: int) -> int:
    """Where in its log the node stands whose last leaf is ``last``."""
    return 2 * last - last.bit_count() + level


def append_log(leaves: list[str], height: int) -> list[str]:
    """The nodes over ``leaves`` up to level ``height``, in completion order; a run of one is the digest of its only node."""
    log, waiting = [], {}
    for i, node in enumerate(leaves):
        log.append(node)
        level, last = 0, i == len(leaves) - 1
        while level < height and (i >> level & 1 or last):
            node = _digest(waiting[level] + node if i >> level & 1 else node)
            log.append(node)
            level += 1
        waiting[level] = node
    return log


def siblings(log: list[str], leaf: int, leaves: int, height: int) -> tuple[str, str]:
    """The siblings of a leaf of a log, level by level, and a letter for each level: the sibling stands
    left (L) or right (R), or there is none (-)."""
    told, sides = [], []
    for level in range(height):
        other = leaf >> level ^ 1
        if other << level < leaves:
            told.append(log[position(min((other + 1) << level, leaves) - 1, level)])
            sides.append("L" if leaf >> level & 1 else "R")
        else:
            sides.append("-")
    return "".join(told), "".join(sides)


def _height(n: int, bits: int) -> int:
    return min(bits, (int(n) - 1).bit_length())


def number(nodes: DataFrame, order: list[str]) -> DataFrame:
    """``nodes`` with ``_i``, their number within ``_tree`` in the order of ``order``, and ``_n``, the tree's size.

    Rows are dealt by range, so a tree with most of the rows is many tasks';
    what lies before a range comes from one count for each tree and range.
    Rows that tie keep any order, the same on every reading.
    """
    laid = cut(nodes.withColumn("_tie", F.monotonically_increasing_id()))
    by = ["_tree", *order, "_tie"]
    # a row's id is its range and its place in the range
    placed = cut(laid.repartitionByRange(*by).sortWithinPartitions(*by).withColumn("_at", F.monotonically_increasing_id()).drop("_tie"))
    part = F.shiftright("_at", 33)
    spans = placed.groupBy(part.alias("_p"), F.col("_tree").alias("_t")).agg(F.min("_at").alias("_first"), F.count("*").alias("_c"))
    tree = Window.partitionBy("_t")
    spans = spans.withColumn("_before", F.sum("_c").over(tree.orderBy("_p")) - F.col("_c")).withColumn("_n", F.sum("_c").over(tree))
    rows = placed.withColumn("_p", part).join(spans.withColumnRenamed("_p", "_q"), (F.col("_p") == F.col("_q")) & (F.col("_tree") == F.col("_t")))
    return rows.withColumn("_i", F.col("_at") - F.col("_first") + F.col("_before")).drop("_at", "_p", "_q", "_t", "_first", "_c", "_before")


def _build(key: tuple, nodes: pa.Table, bits: int) -> pa.Table:
    n = nodes["_n"][0].as_py()
    log = append_log(nodes.sort_by("_i")["_node"].to_pylist(), _height(n, bits))
    return pa.table({"_tree": [key[0].as_py()], "_block": [key[1].as_py()], "_n": [n], "_log": [log], "_root": [log[-1]]})


def _block(bits: int) -> Column:
    return F.shiftright("_i", bits)


def build(nodes: DataFrame, bits: int = BITS) -> list[DataFrame]:
    """The tiers of the logs over ``_tree, _i, _n, _node``: one row ``_tree, _block, _n, _log, _root`` for each block.

    The last tier has one block for each tree, whose ``_root`` is the tree's.
    """
    tiers, now = [], nodes.select("_tree", "_i", "_n", "_node")
    while True:
        made = cut(now.groupBy("_tree", _block(bits).alias("_block")).applyInArrow(lambda key, nodes: _build(key, nodes, bits), "_tree string, _block long, _n long, _log array<string>, _root string"))
        tiers.append(made)
        if (made.agg(F.max("_n")).first()[0] or 0) <= 1 << bits:
            return tiers
        now = made.select("_tree", F.col("_block").alias("_i"), F.ceil(F.col("_n") / (1 << bits)).alias("_n"), F.col("_root").alias("_node"))


def append_log_table(tiers: list[DataFrame], bits: int = BITS) -> DataFrame:
    """``tree, position, level, node``: every node of every tree at its place in the tree's postorder.

    The nodes of a block of the first tier stand side by side; a node of a
    later tier stands where the formula puts its last leaf.
    """

    @F.udf("array<struct<level:int,i:long>>")
    def places(tier: int, block: int, n: int) -> list[tuple[int, int]]:
        """Level and number of a block's nodes in completion order."""
        count, height = min(1 << bits, n - (block << bits)), _height(n, bits)
        every = sorted((position(min((i + 1) << h, count) - 1, h), h, (block << bits >> h) + i) for h in range(height + 1) for i in range(-(-count >> h)))
        return [(bits * tier + h, i) for _, h, i in every]

    sizes = tiers[0].groupBy("_tree").agg(F.max("_n").alias("_size"))
    rows = reduce(DataFrame.unionByName, (t.withColumn("_tier", F.lit(k)) for k, t in enumerate(tiers)))
    rows = rows.select("_tree", "_tier", F.explode(F.zip_with("_log", places("_tier", "_block", "_n"), lambda node, at: F.struct(node.alias("node"), at["level"].alias("level"), at["i"].alias("i")))).alias("x"))
    rows = rows.select("_tree", "_tier", "x.*").where((F.col("_tier") == 0) | (F.col("level") > bits * F.col("_tier")))  # a tier's leaves are the roots of the one below
    last = F.least(F.expr("shiftleft(i + 1, level)"), F.col("_size")) - 1
    return rows.join(sizes, "_tree").select(F.col("_tree").alias("tree"), (2 * last - F.bit_count(last) + F.col("level")).alias("position"), "level", "node")


def _proofs(log: pa.Table, leaves: list[int] | None, bits: int) -> tuple[list[str], list[str]]:
    """Siblings and sides of the numbered leaves (None: all) of a block, from its log and what follows its root."""
    x = log.slice(0, 1).to_pylist()[0]
    count, height = min(1 << bits, x["_n"] - (x["_block"] << bits)), _height(x["_n"], bits)
    found = [siblings(x["_log"], i & (1 << bits) - 1, count, height) for i in (range(count) if leaves is None else leaves)]
    return [a + x["_siblings"] for a, _ in found], [b + x["_sides"] for _, b in found]


def _prove(nodes: pa.Table, log: pa.Table, bits: int) -> pa.Table:
    told, sides = _proofs(log, nodes["_i"].to_pylist(), bits)
    return nodes.append_column("_siblings", pa.array(told, pa.string())).append_column("_sides", pa.array(sides, pa.string()))


def _prove_all(batches: Iterator[pa.RecordBatch], bits: int) -> Iterator[pa.RecordBatch]:
    for b in batches:
        for k in range(b.num_rows):
            log = pa.Table.from_batches([b.slice(k, 1)])
            told, sides = _proofs(log, None, bits)
            first = log["_block"][0].as_py() << bits
            yield pa.RecordBatch.from_pydict({"_tree": [log["_tree"][0].as_py()] * len(told), "_block": list(range(first, first + len(told))), "_siblings": told, "_sides": sides})


def prove(tiers: list[DataFrame], nodes: DataFrame, above: DataFrame | None = None, bits: int = BITS) -> DataFrame:
    """``nodes`` with ``_siblings``, the digests beside their way to the root one after the other, and ``_sides``.

    ``above`` continues them beyond the root of a tree: ``_tree, _siblings, _sides``.
    Siblings go down tier by tier: a block's log meets what follows the
    block's root, one row for each block, and gives what follows each of its nodes.
    """
    top = tiers[-1].join(above, "_tree") if above is not None else tiers[-1].withColumns({"_siblings": F.lit(""), "_sides": F.lit("")})
    for tier in reversed(tiers[:-1]):
        top = tier.join(top.mapInArrow(lambda rows: _prove_all(rows, bits), "_tree string, _block long, _siblings string, _sides string"), ["_tree", "_block"])
    schema = StructType([*nodes.schema, StructField("_block", LongType()), StructField("_siblings", StringType()), StructField("_sides", StringType())])
    nodes = nodes.withColumn("_block", _block(bits))
    return nodes.groupBy("_tree", "_block").cogroup(top.groupBy("_tree", "_block")).applyInArrow(lambda a, b: _prove(a, b, bits), schema).drop("_block")


def fold(leaf: Column, told: Column, sides: Column) -> Column:
    """The root that a leaf and its proof give."""
    start = F.struct(leaf.alias("d"), F.lit(1).alias("at"))

    def step(s: Column, side: Column) -> Column:
        other = F.substring(told, s["at"], F.lit(HEX))
        both = F.when(side == "L", F.concat(other, s["d"])).when(side == "R", F.concat(s["d"], other)).otherwise(s["d"])
        return F.struct(F.sha2(both, 256).alias("d"), (s["at"] + F.when(side == "-", 0).otherwise(HEX)).alias("at"))

    return F.aggregate(F.filter(F.split(sides, ""), lambda c: c != ""), start, step, lambda s: s["d"])


def manifest(leaves: DataFrame, tree: str, order: list[str], leaf: str = "leaf", bits: int = BITS) -> DataFrame:
    """``leaves`` with ``subroot``, ``root``, ``siblings`` and ``sides``, which replace columns of these names.

    One tree for each value of ``tree`` over its rows in the order of
    ``order``; rows that tie there are ordered by their digest.  The subroots,
    by that value, null first, then by its bytes in UTF-8, are the leaves of
    one more tree.  Every row gets a proof, 64 characters a level; repeated
    rows are leaves of their own, nulls in ``order`` come first, an empty table
    gives no rows.
    """
    given = [c for c in leaves.columns if c.lower() not in ("subroot", "root", "siblings", "sides")]
    held = {c: f"_c{k}" for k, c in enumerate(given)}
    named = F.coalesce(F.concat(F.lit("="), F.col(f"`{tree}`").cast("string")), F.lit(""))
    nodes = leaves.select(*(F.col(f"`{c}`").alias(h) for c, h in held.items()), named.alias("_tree"), F.col(f"`{leaf}`").alias("_node"))
    nodes = number(nodes, [*(held[c] for c in order), "_node"])
    tiers = build(nodes, bits)
    subroots = tiers[-1].select(F.col("_tree").alias("_name"), F.lit("").alias("_tree"), F.col("_root").alias("_node"))
    trees = number(subroots, ["_name"])
    over = build(trees, bits)
    root = over[-1].select(F.col("_root").alias("_whole"))
    # a row for each tree, beside the one root
    above = prove(over, trees, bits=bits).select(F.col("_name").alias("_tree"), F.col("_node").alias("_sub"), "_siblings", "_sides")
    above = cut(above.join(root, F.lit(True)))
    rows = prove(tiers, nodes, above.drop("_sub", "_whole"), bits).join(above.select("_tree", "_sub", "_whole"), "_tree")
    return rows.select(*(F.col(h).alias(c) for c, h in held.items()), F.col("_sub").alias("subroot"), F.col("_whole").alias("root"), F.col("_siblings").alias("siblings"), F.col("_sides").alias("sides"))
