"""Connected components by contraction, with nothing but narrow joins and additive aggregates."""

from __future__ import annotations

import random

from pyspark.sql import DataFrame, functions as F

from gradeloom.llm.common import staged


def hooked(links: DataFrame) -> DataFrame:
    """node, root: each node hangs on its least neighbour of lower number, and all go up to the top of their tree."""
    tree = staged(links.groupBy(F.greatest("a", "b").alias("node")).agg(F.min(F.least("a", "b")).alias("root")), "tree")
    while True:
        above = tree.select(F.col("node").alias("root"), F.col("root").alias("higher"))
        raised = staged(tree.join(above, "root", "left").select("node", F.coalesce("higher", "root").alias("root"), F.col("higher").isNotNull().alias("moved")), "tree")
        tree = raised.drop("moved")
        if raised.where("moved").isEmpty():
            tops = links.select(F.least("a", "b").alias("node")).distinct().join(tree, "node", "left_anti")
            return staged(tree.unionByName(tops.select("node", F.col("node").alias("root"))), "tree")


def components(links: DataFrame) -> DataFrame:
    """node, root for every node of ``links`` (a, b: long); the nodes of a component share a root.

    A first pass hangs nodes on lower ones, which leaves few links of a dense group.  Then in each
    round every node moves to its least neighbour in an order that a fresh random mask defines,
    so the graph shrinks by a constant factor whatever its shape, long chains included.  Links of
    a node to itself are ignored.  Rounds write tables to the shared folder.
    """
    draw = random.Random(1)
    given = staged(links.where("a <> b").select("a", "b"), "links")
    known = hooked(given)
    first, second = known.toDF("a", "to_a"), known.toDF("b", "to_b")
    rest = given.join(first, "a", "left").join(second, "b", "left").select(F.coalesce("to_a", "a").alias("a"), F.coalesce("to_b", "b").alias("b"))
    both = F.explode(F.array(F.struct(F.col("a").alias("a"), F.col("b").alias("b")), F.struct(F.col("b").alias("a"), F.col("a").alias("b"))))
    edges = staged(rest.where("a <> b").distinct().select(both.alias("e")).select("e.*").distinct(), "edges")
    while not edges.isEmpty():
        mask = F.lit(draw.getrandbits(63))
        least = F.least(F.min(F.col("b").bitwiseXOR(mask)), F.col("a").bitwiseXOR(mask)).bitwiseXOR(mask)
        moves = staged(edges.groupBy("a").agg(least.alias("to")), "moves")
        first, second = moves.toDF("a", "to_a"), moves.toDF("b", "to_b")
        edges = staged(edges.join(first, "a").join(second, "b").where("to_a <> to_b").select(F.col("to_a").alias("a"), F.col("to_b").alias("b")).distinct(), "edges")
        step = moves.toDF("root", "to")
        known = staged(known.join(step, "root", "left").select("node", F.coalesce("to", "root").alias("root")), "roots")
    return known
