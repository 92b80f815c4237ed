"""Train, validation and test splits that keep components whole."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomlake.operators.ordering import placed
from loomlake.scratch import Scratch

SPLITS = (("train", 0.70), ("val", 0.15), ("test", 0.15))
#: Assignments that the driver holds before it writes them.
PART = 100_000


def assign(members: DataFrame, component: str = "component", label: str = "label", part: int = PART) -> DataFrame:
    """(component, split): components by falling size, then id, each to the split that lacks most of its classes.

    The score of a split is the sum over classes of n * (target - current) / max(target, 1); ties go to the first split. The fold is
    sequential over components of two or more members: they stream through the driver in their order, which keeps the classes' counts and writes
    ``part`` assignments at a time.
    Single members are dealt over the cluster: those of one class fill the splits in the order of the scores that each place would have, so
    the places of all splits are sorted and the members take them by id.
    """
    scratch = Scratch(members.sparkSession, "splits")
    counts = scratch.write(members.groupBy(component, label).agg(F.count("*").alias("n")), "counts")
    sizes = counts.groupBy(component).agg(F.sum("n").alias("size"))
    totals = {r[label]: r["n"] for r in counts.groupBy(label).agg(F.sum("n").alias("n")).collect()}
    own = counts.groupBy(component).agg(F.sum("n").alias("size"), F.collect_list(F.struct(F.col(label).alias("cls"), "n")).alias("own")).where("size > 1")
    current = {s: dict.fromkeys(totals, 0) for s, _ in SPLITS}
    spark, kind = members.sparkSession, f"{component} {members.schema[component].dataType.simpleString()}, split string"
    out, written = [], []
    for r in own.orderBy(F.desc("size"), component).toLocalIterator():
        score = lambda s, share: sum(n * (share * totals[cls] - current[s][cls]) / max(share * totals[cls], 1) for cls, n in sorted(r["own"], key=lambda x: str(x[0])))  # noqa: B023, E731
        scores = [score(s, share) for s, share in SPLITS]
        split = SPLITS[scores.index(max(scores))][0]
        for cls, n in r["own"]:
            current[split][cls] += n
        out.append((r[component], split))
        if len(out) == part:
            written.append(scratch.write(spark.createDataFrame(out, kind), "assigned"))
            out = []
    done = reduce(DataFrame.unionByName, written, spark.createDataFrame(out, kind))
    alone = counts.join(sizes.where("size = 1").select(component), component, "left_semi").select(component, label)
    by_class = alone.groupBy(label).agg(F.count("*").alias("m"))
    state = [(cls, i, s, share * n, current[s][cls]) for cls, n in totals.items() for i, (s, share) in enumerate(SPLITS)]
    kind = members.schema[label].dataType.simpleString()
    room = spark.createDataFrame(state, f"{label} {kind}, i int, split string, target double, held long").join(F.broadcast(by_class), label)  # a few rows a class
    places = room.select(label, "i", "split", F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("m") - 1)).alias("j"), "target", "held", "m")
    places = places.withColumn("score", (F.col("target") - (F.col("held") + F.col("j"))) / F.greatest("target", F.lit(1.0)))
    taken = _within(places, label, [F.desc("score"), "i", "j"]).where("place < m").select(label, "place", "split")
    dealt = _within(alone, label, [component]).join(taken, [label, "place"]).select(component, "split")
    return done.unionByName(dealt)


def _within(df: DataFrame, key: str, order: list) -> DataFrame:
    """0-based places within each key, from places in the whole table."""
    every = placed(df, [key, *order], "whole")
    first = every.groupBy(key).agg(F.min("whole").alias("first"))
    return every.join(F.broadcast(first), key).withColumn("place", F.col("whole") - F.col("first"))  # one row a class


def with_held_out(assigned: DataFrame, held: str, label: str = "label") -> DataFrame:
    """Rows with a split and a label; those of class ``held`` are in split 'heldout', whatever their component got."""
    return assigned.withColumn("split", F.when(F.col(label) == held, "heldout").otherwise(F.col("split")))


def require_separate(crossing: DataFrame) -> None:
    """Raises an error if pairs over the bound lie in different splits; takes the result of ``pairs.cross_splits``."""
    over = [f"{r['splits']}: {r['over']}" for r in crossing.where("over > 0").select("splits", "over").orderBy("splits").collect()]
    if over:
        raise ValueError("similar pairs across splits: " + ", ".join(over))
