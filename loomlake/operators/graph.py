"""Connected components by repeated contraction of the smallest neighbour."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomlake.operators.skew import spread
from loomlake.scratch import Scratch


def connected(edges: DataFrame, scratch: Scratch) -> DataFrame:
    """(node, root) of every node that ``edges`` (a long, b long) name; nodes of one component share a root.

    Each round sends a node to the smallest of its neighbours and itself, and rewrites the edges; a star, the
    common case, is one round, a path halves. Tables are written between rounds; nothing is collected.
    """
    left = scratch.write(edges.where("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct(), "edges")
    roots, last = None, None
    while not left.isEmpty():
        both = left.union(left.select("b", "a"))
        step = scratch.write(both.groupBy("a").agg(F.least(F.min("b"), F.first("a")).alias("to")).withColumnRenamed("a", "node"), "step")
        if roots is None:
            roots = step.select("node", F.col("to").alias("root"))
        else:
            hop = step.select(F.col("node").alias("root"), "to")
            roots = scratch.write(roots.join(hop, "root", "left").select("node", F.coalesce("to", "root").alias("root")), "roots")
        a = step.select(F.col("node").alias("a"), F.col("to").alias("ta"))
        b = step.select(F.col("node").alias("b"), F.col("to").alias("tb"))
        moved = left.join(a, "a").join(b, "b").where("ta <> tb").select(F.least("ta", "tb").alias("a"), F.greatest("ta", "tb").alias("b")).distinct()
        done, left = left, scratch.write(moved, "edges")
        # the first step is read as the roots until the second round has written them
        scratch.drop(done, *([] if last is None else [step]))
        last = step
    return left.selectExpr("a as node", "b as root") if roots is None else roots


def spanning_forest(edges: DataFrame, scratch: Scratch) -> DataFrame:
    """(a, b, w): edges of a maximum spanning forest of (a long, b long, w); of equal weights the pair of lower ids goes first.

    In each round every component takes its heaviest edge to another one, and components that meet become one, so rounds grow with the logarithm of the
    nodes. Components at any bound on the weight are those of the forest's edges from that bound on: nodes at most, however many edges there were.
    """
    first, second = F.least("a", "b"), F.greatest("a", "b")
    once = edges.where("a <> b").groupBy(first.alias("a"), second.alias("b")).agg(F.max("w").alias("w"))
    best = lambda df, *by: df.groupBy(*by).agg(F.max(F.struct("w", (-F.col("a")).alias("a"), (-F.col("b")).alias("b"), "ra", "rb")).alias("e"))
    back = [F.col("e.w").alias("w"), (-F.col("e.a")).alias("a"), (-F.col("e.b")).alias("b"), F.col("e.ra").alias("ra"), F.col("e.rb").alias("rb")]
    left = scratch.write(once.select("a", "b", "w", F.col("a").alias("ra"), F.col("b").alias("rb")), "open")
    forest = [left.select("a", "b", "w").where("false")]
    while not left.isEmpty():
        both = left.withColumn("r", F.explode(F.array("ra", "rb")))
        chosen = scratch.write(best(both, "r").select(*back).distinct(), "chosen")
        forest.append(chosen.select("a", "b", "w"))
        roots = connected(chosen.select(F.col("ra").alias("a"), F.col("rb").alias("b")), scratch)
        moved = left
        for end in ("ra", "rb"):
            # a component takes in many: its edges are dealt over parts
            moved = spread(moved, roots.select(F.col("node").alias(end), F.col("root").alias(f"{end}_now")), end, "a").drop(end).withColumnRenamed(f"{end}_now", end)
        done = moved.where("ra <> rb").withColumns({"x": F.least("ra", "rb"), "y": F.greatest("ra", "rb")})
        before, left = left, scratch.write(best(done, "x", "y").select(*back).select("a", "b", "w", "ra", "rb"), "open")
        scratch.drop(before)
    return reduce(DataFrame.union, forest)


def merged(members: DataFrame, pairs: DataFrame, scratch: Scratch) -> DataFrame:
    """(id, cluster): given clusters, joined where a pair links two of them; a merged cluster has the smallest of their ids. members: (id, cluster)."""
    a, b = (members.select(F.col("id").alias(c), F.col("cluster").alias(f"c{c}")) for c in "ab")
    links = pairs.select("a", "b").join(a, "a").join(b, "b").select(F.col("ca").alias("a"), F.col("cb").alias("b"))
    roots = connected(links, scratch)
    least = roots.groupBy("root").agg(F.min("node").alias("least"))
    named = roots.join(least, "root").select(F.col("node").alias("cluster"), "least")
    return members.join(named, "cluster", "left").select("id", F.coalesce("least", "cluster").alias("cluster"))
