"""Merkle manifest of a dataset: one hash tree per group of rows, one over the groups' roots, and inclusion proofs.

Only every ``span``-th level of a tree is kept.  A kept row is an aligned block: up to ``fanout ** span`` consecutive
nodes of one level and the node above them, so that reading the next kept level is a scan of three columns.  The levels
in between are computed again when proofs are taken: each block regenerates its interior nodes from its stored ones,
gives every node its siblings on these levels, and drops the interior.  A block joins its parent's proof, not each
leaf, so the join is ``fanout ** span`` times smaller than the table; a hot group is spread over its blocks.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from runlens.operators.ordering import positions
from runlens.session import materialize

FANOUT = 2
SPAN = 4
_SIBLINGS = "array<struct<left:string,right:string>>"


def leaf_hash(fields: Sequence[str | Column]) -> Column:
    """SHA-256 of the fields in order: ``-`` for null, else byte count, ``:`` and value."""
    parts = []
    for f in fields:
        value = (F.col(f) if isinstance(f, str) else f).cast("string")
        parts.append(F.when(value.isNull(), "-").otherwise(F.concat(F.octet_length(value).cast("string"), F.lit(":"), value)))
    return F.sha2(F.concat(*parts), 256)


@dataclass
class Tree:
    """The kept levels, bottom first: (grp, block, n, nodes, h), ``n`` nodes of the group on this level, ``h`` above the block."""

    levels: list[DataFrame]
    fanout: int
    span: int

    def tops(self) -> DataFrame:
        """(grp, h): the root of every group."""
        out = None
        for level in self.levels:
            top = level.where(_above(F.col("n"), self.fanout, self.span) == 1).select("grp", "h")
            out = top if out is None else out.unionByName(top)
        return out


@dataclass
class Manifest:
    """The groups' trees and the tree over their roots, whose leaves carry the group as ``of``."""

    groups: Tree
    over: Tree

    def root(self) -> DataFrame:
        """(root): one row, none for an empty dataset."""
        return self.over.tops().select(F.col("h").alias("root"))


def _above(n: Column, fanout: int, span: int) -> Column:
    """Nodes of a group on the next kept level."""
    return F.ceil(n / F.lit(fanout**span)).cast("long")


def _steps(n: Column, fanout: int, span: int) -> Column:
    """Levels between a block and the node above it: fewer than ``span`` where the tree ends."""
    return sum((F.when(n > fanout**i, 1).otherwise(0) for i in range(span)), F.lit(0))


def _parents(nodes: Column, fanout: int) -> Column:
    """Hashes of every ``fanout`` consecutive nodes, a shorter last run included."""
    starts = F.filter(F.sequence(F.lit(0), F.size(nodes) - 1), lambda i: i % fanout == 0)
    return F.transform(starts, lambda i: F.sha2(F.array_join(F.slice(nodes, i + 1, fanout), ""), 256))


def _interior(hashes: Column, steps: Column, fanout: int, span: int) -> Column:
    """The block's levels from its own nodes up to the one under its top (its own alone where it has no step)."""
    more = F.filter(F.array(*[F.lit(i) for i in range(1, span)]), lambda i: i < steps) if span > 1 else F.array().cast("array<int>")
    return F.aggregate(more, F.array(hashes), lambda levels, _: F.concat(levels, F.array(_parents(F.element_at(levels, -1), fanout))))


def _levels(nodes: DataFrame, fanout: int, span: int) -> list[DataFrame]:
    """Kept levels of the trees over ``nodes`` (grp, pos, n, h, carry)."""
    levels, width = [], fanout**span
    while True:
        block = F.floor(F.col("pos") / width).cast("long").alias("block")
        entry = F.struct("pos", "h", *[c for c in ("carry",) if c in nodes.columns])
        grouped = nodes.groupBy("grp", block).agg(F.max("n").alias("n"), F.array_sort(F.collect_list(entry)).alias("nodes"))
        one_by_one = F.filter(F.array(*[F.lit(i) for i in range(span)]), lambda i: i < _steps(F.col("n"), fanout, span))
        top = F.aggregate(one_by_one, F.col("nodes.h"), lambda hashes, _: _parents(hashes, fanout))
        level = materialize(grouped.withColumn("h", F.element_at(top, 1)), "merkle")
        levels.append(level)
        widest = level.agg(F.max("n")).first()[0] or 0  # one number: how tall the tallest tree is
        if widest <= width:
            return levels
        above = _above(F.col("n"), fanout, span)
        nodes = level.where(above > 1).select("grp", F.col("block").alias("pos"), above.alias("n"), "h")


def build(df: DataFrame, fields: Sequence[str], group: str, order: str, carry: Mapping[str, Column] | None = None,
          fanout: int = FANOUT, span: int = SPAN) -> Manifest:
    """Manifest of ``df``: a leaf per row, a tree per ``group`` over its leaves by ``order``, a tree over the groups' roots.

    Nodes are hashes of up to ``fanout`` consecutive nodes below, until one remains; groups ascend, null first.  ``carry``
    columns come back with the leaf's proof.  Null fields, groups and order values are values of their own (null
    first); rows of equal order are put by their leaf, so repeated rows are leaves beside each other; an empty table
    has no root.  Columns that are not named are ignored, whatever their names.  The text is read once, for its leaf.
    """
    carried = F.struct(F.col(order).alias("order"), *[c.alias(name) for name, c in (carry or {}).items()])
    leaves = materialize(df.select(F.col(group).alias("grp"), F.col(order).alias("by"), leaf_hash(fields).alias("h"), carried.alias("carry")), "leaves")
    placed = positions(leaves, ["by", "h"], ["grp"], out="pos", total_out="n")
    groups = Tree(_levels(placed.select("grp", (F.col("pos") - 1).alias("pos"), "n", "h", "carry"), fanout, span), fanout, span)
    ranked = positions(groups.tops(), ["grp"], out="pos", total_out="n")
    top_nodes = ranked.select(F.lit(0).alias("grp"), (F.col("pos") - 1).alias("pos"), "n", "h", F.struct(F.col("grp").alias("of")).alias("carry"))
    return Manifest(groups, Tree(_levels(top_nodes, fanout, span), fanout, span))


def _paths(tree: Tree, tops: DataFrame) -> DataFrame:
    """(top, pos, h, carry, siblings) of every leaf; ``tops`` (grp, top struct, up) holds what lies above each group's root."""
    fanout, span = tree.fanout, tree.span
    below = None
    for level in reversed(tree.levels):
        ends = level.where(_above(F.col("n"), fanout, span) == 1).select(F.col("grp").alias("of")).distinct()
        parent = ends.join(tops, F.col("of").eqNullSafe(F.col("grp"))).select("of", F.lit(0).cast("long").alias("at"), "top", "up")
        if below is not None:
            parent = parent.unionByName(below.select(F.col("grp").alias("of"), F.col("pos").alias("at"), "top", F.col("siblings").alias("up")))
        joined = level.drop("h").join(parent, F.col("grp").eqNullSafe(F.col("of")) & (F.col("block") == F.col("at")))
        steps = _steps(F.col("n"), fanout, span)

        def siblings(levels, i, steps=steps):
            def on(nodes, depth):
                at = F.floor(i / F.pow(F.lit(fanout), depth)).cast("int")
                start = (at - at % fanout).cast("int")
                left, right = F.slice(nodes, start + 1, at - start), F.slice(nodes, at + 2, fanout - 1 - (at - start))
                return F.struct(F.array_join(left, "").alias("left"), F.array_join(right, "").alias("right"))

            return F.when(steps > 0, F.transform(levels, on)).otherwise(F.array().cast(_SIBLINGS))

        # the regenerated levels are bound once per block, not once per node
        interior = F.array(_interior(F.col("nodes.h"), steps, fanout, span))
        proofs = F.transform(interior, lambda levels: F.transform("nodes", lambda node, i: F.struct(node.alias("node"), siblings(levels, i).alias("own"))))
        below = joined.select("grp", "top", "up", F.explode(F.element_at(proofs, 1)).alias("p"))
        below = below.select("grp", "top", "p.node.*", F.concat("p.own", "up").alias("siblings"))
    return below


def proofs(manifest: Manifest) -> DataFrame:
    """One row per leaf: grp, pos, leaf, subroot, root, siblings (by level, to the root), and ``carry`` (order, carried columns)."""
    none = F.array().cast(_SIBLINGS)
    root = manifest.over.tops().select("grp", F.struct(F.col("h").alias("root")).alias("top"), none.alias("up"))
    groups = _paths(manifest.over, root).select(
        F.col("carry.of").alias("grp"), F.struct(F.col("h").alias("subroot"), "top.root").alias("top"), F.col("siblings").alias("up")
    )
    out = _paths(manifest.groups, groups)
    return out.select("grp", "pos", F.col("h").alias("leaf"), "top.subroot", "top.root", "siblings", "carry")


def fold(leaf: Column, siblings: Column) -> Column:
    """The root that a leaf and its siblings give."""
    return F.aggregate(siblings, leaf, lambda h, s: F.sha2(F.concat(s["left"], h, s["right"]), 256))


def proof_text(siblings: Column) -> Column:
    """A proof's hashes in one string, level by level and left to right."""
    return F.array_join(F.transform(siblings, lambda s: F.concat(s["left"], s["right"])), "")
