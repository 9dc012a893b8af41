"""Parent-child links to full hierarchies (problem 6), by pointer doubling.

Each node holds a pointer to an ancestor and the number of steps to it; a round joins every open pointer to the state of
the node it points to, which doubles the jump. A node of depth d is finished after log2(d) rounds. A round that finishes
nothing proves that all open nodes lead into a loop: an open node of finite depth would have an ancestor whose depth is just
the current jump, and that one finishes in the round. The loops are then resolved by doubling the open rest alone, with the
smallest id passed on the way, until the jump is as long as the rest is large.

Nulls: rows without an id are ignored. A parent that is null, 0 or not among the ids ends the chain. Where an id comes with
several parents the smallest is taken. A node that is its own parent is a loop of one. Empty input gives empty results.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..plans import cut, skew_join

#: A pointer target with fewer rows than this isn't salted.
HOT = 10_000


def links(nodes: DataFrame, node: str = "id", parent: str = "parent_id") -> DataFrame:
    """id, parent: one row for each id; parent is null where there is none."""
    held = F.when(F.col(parent) != 0, F.col(parent))
    return nodes.where(F.col(node).isNotNull()).groupBy(F.col(node).alias("id")).agg(F.min(held).alias("parent"))


def hierarchy(nodes: DataFrame, node: str = "id", parent: str = "parent_id", with_path: bool = False) -> DataFrame:
    """id, parent, root_id, depth and, if asked for, path (ids from the root to the node) of every node.

    Nodes on a loop or below one get depth -1, the loop's smallest id as root and a null path."""
    edges = cut(links(nodes, node, parent))
    known = edges.select(F.col("id").alias("parent"), F.lit(True).alias("has_row"))
    start = skew_join(edges, known, ["parent"], "left").select("id", F.when(F.col("has_row"), F.col("parent")).alias("anc"))
    seg = [F.array("id").alias("seg")] if with_path else []
    start = cut(start.select("id", F.coalesce("anc", "id").alias("anc"), F.when(F.col("anc").isNull(), 0).otherwise(1).cast("bigint").alias("dist"), F.col("anc").alias("low"), F.col("anc").isNull().alias("fin"), *seg))
    done, open_ = start.where("fin"), start.where("not fin")
    left, jump = open_.count(), 1
    while left:
        state = done.unionByName(open_)
        step = cut(_jump(open_, state, with_path, left), afresh=True)
        fresh, open_ = step.where("fin"), step.where("not fin")
        jump *= 2
        now = open_.count()
        if now == left:
            break
        done, left = done.unionByName(fresh), now
    result = done.select("id", F.col("anc").alias("root_id"), F.col("dist").alias("depth"), *([F.col("seg").alias("path")] if with_path else []))
    if left:
        rest = _loops(open_.select("id", "anc", "low", "dist", "fin"), left, jump)
        result = result.unionByName(rest.select("id", "root_id", F.lit(-1).cast("bigint").alias("depth"), *([F.lit(None).cast("array<bigint>").alias("path")] if with_path else [])))
    return edges.join(result, "id")


def _jump(open_: DataFrame, state: DataFrame, with_path: bool, rows: int) -> DataFrame:
    """Every open pointer moved on by the pointer of the node it points to. Fewer rows than make a hot key need no salt."""
    to = state.select(F.col("id").alias("anc"), F.col("anc").alias("anc2"), F.col("dist").alias("dist2"), F.col("low").alias("low2"), F.col("fin").alias("fin2"), *([F.col("seg").alias("seg2")] if with_path else []))
    moved = skew_join(open_.drop("fin"), to, ["anc"]) if rows >= HOT else open_.drop("fin").join(to, "anc")
    seg = [F.concat("seg2", "seg").alias("seg")] if with_path else []
    return moved.select("id", F.col("anc2").alias("anc"), (F.col("dist") + F.col("dist2")).alias("dist"), F.least("low", "low2").alias("low"), F.col("fin2").alias("fin"), *seg)


def _loops(open_: DataFrame, count: int, jump: int) -> DataFrame:
    """id, root_id of nodes that lead into a loop; every pointer stays among them."""
    for _ in range(max(0, math.ceil(math.log2(max(count, 2) / jump)))):
        open_ = cut(_jump(open_, open_, False, count), afresh=True)
    low = open_.select(F.col("id").alias("anc"), F.col("low").alias("root_id"))
    ends = open_.select("id", "anc")
    return (skew_join(ends, low, ["anc"]) if count >= HOT else ends.join(low, "anc")).select("id", "root_id")


def found(posts: DataFrame) -> DataFrame:
    """post_id, root_id, depth of every post with a parent; ids as in TESTDATA."""
    return hierarchy(posts).where(F.col("parent").isNotNull()).select(F.col("id").alias("post_id"), "root_id", "depth")


def descendants(nodes: DataFrame, node: str = "id", parent: str = "parent_id") -> DataFrame:
    """ancestor_id, descendant_id, distance: every pair along a tree path (the size of the result is the sum of depths)."""
    paths = hierarchy(nodes, node, parent, with_path=True).where("depth > 0")
    return paths.select("id", "depth", F.posexplode("path").alias("at", "ancestor_id")).where("at < depth").select("ancestor_id", F.col("id").alias("descendant_id"), (F.col("depth") - F.col("at")).alias("distance"))


def below(nodes: DataFrame, node: str = "id", parent: str = "parent_id", value: Column | None = None, how: str = "sum") -> DataFrame:
    """id, below: the sum (or ``how="max"``, the maximum) of ``value`` over all nodes under each node that has any, the node itself
    left out; by default their number. ``value`` is read from ``nodes``; where an id comes more than once its largest value counts.

    Doubling again: what lies less than 2^k steps under a node, and under each node exactly 2^k steps below it, is all that lies
    less than 2^(k+1) steps below. So log2(depth) rounds of one join and one pre-aggregated sum do it, and no pair of ancestor and
    descendant is ever formed. Nodes on a loop or under one are left out."""
    worth = F.lit(1).cast("bigint") if value is None else value
    held = F.when(F.col(parent) != 0, F.col(parent))
    own = cut(nodes.where(F.col(node).isNotNull()).groupBy(F.col(node).alias("id")).agg(F.min(held).alias("parent"), F.max(worth).alias("v")))
    known = own.select(F.col("id").alias("parent"), F.lit(True).alias("has_row"))
    placed = cut(skew_join(own, known, ["parent"], "left").select("id", F.when(F.col("has_row"), F.col("parent")).alias("anc"), "v"))
    fold = F.sum if how == "sum" else F.max
    plus = (lambda a, b: F.coalesce(a + b, a, b)) if how == "sum" else F.greatest
    # whole: the value of the node and of what is known to lie under it; under: without the node itself; up: the ancestor 2^k steps above
    state, up = placed.select("id", F.col("v").alias("whole"), F.lit(None).cast(placed.schema["v"].dataType).alias("under")), placed.where("anc IS NOT NULL").select("id", "anc")
    left = up.count()
    while left:
        gained = up.join(state.select("id", "whole"), "id").groupBy(F.col("anc").alias("id")).agg(fold("whole").alias("more"))
        state = cut(state.join(gained, "id", "left").select("id", plus(F.col("whole"), F.col("more")).alias("whole"), plus(F.col("under"), F.col("more")).alias("under")))
        over = up.select(F.col("id").alias("anc"), F.col("anc").alias("anc2"))
        up = cut((skew_join(up, over, ["anc"]) if left >= HOT else up.join(over, "anc")).select("id", F.col("anc2").alias("anc")), afresh=True)
        now = up.count()
        if now == left:  # a round that ends no chain: all that are left lead into loops, and so do all that they counted for
            state = state.join(up.select("id"), "id", "left_anti")
            break
        left = now
    return state.where("under IS NOT NULL").select("id", F.col("under").alias("below"))


def trees(nodes: DataFrame, node: str = "id", parent: str = "parent_id") -> DataFrame:
    """id, root_id, depth, path (text, ids joined by '/'), n_descendants of every node; loops have an
    empty path and the count -1."""
    all_ = cut(hierarchy(nodes, node, parent, with_path=True))
    return all_.join(below(nodes, node, parent), "id", "left").select(
        "id", "root_id", "depth", F.coalesce(F.array_join(F.transform("path", lambda x: x.cast("string")), "/"), F.lit("")).alias("path"), F.when(F.col("depth") >= 0, F.coalesce("below", F.lit(0))).otherwise(-1).alias("n_descendants")
    )


def loops(nodes: DataFrame, node: str = "id", parent: str = "parent_id") -> DataFrame:
    """loop_id (the smallest id on a loop) and the number of nodes on it or below it."""
    return hierarchy(nodes, node, parent).where("depth = -1").groupBy(F.col("root_id").alias("loop_id")).agg(F.count(F.lit(1)).alias("n_nodes"))
