"""Places and running sums in a total order over the whole table, without bringing it to one task."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from loomlake.scratch import Scratch


def running(df: DataFrame, order: Sequence[str | Column], sums: dict[str, str | Column], whole: dict[str, str] | None = None) -> DataFrame:
    """``df`` with the sum of each value over the rows before this one, named by the keys of ``sums``, and over all rows, named by those of ``whole``.

    Rows are dealt out by ranges of the order and written once; a sum within each range and one over the ranges' totals, one row a
    range, give every row's. Rows equal in the order share a range, and which of them is first is not told apart.
    """
    scratch = Scratch(df.sparkSession, "order")
    values = {f"__v{i}": F.col(v) if isinstance(v, str) else v for i, v in enumerate(sums.values())}
    ranged = scratch.write(df.withColumns(values).repartitionByRange(*order).withColumn("__range", F.spark_partition_id()), "ranges")
    earlier = lambda w: w.rowsBetween(Window.unboundedPreceding, -1)
    totals = ranged.groupBy("__range").agg(*(F.sum(v).alias(v) for v in values))
    offsets = [F.coalesce(F.sum(v).over(earlier(Window.orderBy("__range"))), F.lit(0)).alias(f"{v}b") for v in values]
    named = dict(zip(sums, values, strict=True))
    before = totals.select("__range", *offsets, *(F.sum(named[of]).over(Window.partitionBy()).alias(f"__t{i}") for i, of in enumerate((whole or {}).values())))
    inside = earlier(Window.partitionBy("__range").orderBy(*order))
    out = ranged.withColumns({f"{v}i": F.coalesce(F.sum(v).over(inside), F.lit(0)) for v in values}).join(before, "__range")
    return out.select(*df.columns, *((F.col(f"{v}i") + F.col(f"{v}b")).alias(name) for name, v in named.items()), *(F.col(f"__t{i}").alias(name) for i, name in enumerate(whole or {})))


def placed(df: DataFrame, order: Sequence[str | Column], name: str = "place") -> DataFrame:
    """``df`` with each row's 0-based place in the order."""
    return running(df, order, {name: F.lit(1).cast("bigint")})


def placed_within(df: DataFrame, by: Sequence[str], order: Sequence[str | Column], name: str = "place") -> DataFrame:
    """``df`` with each row's place, from 1, within its group: places in the whole table less the group's first, so a large group is no one task's."""
    every = Scratch(df.sparkSession, "within").write(placed(df, [*by, *order], "__whole"), "places")
    first = every.groupBy(*by).agg(F.min("__whole").alias("__first"))
    return every.join(first, [*by]).withColumn(name, F.col("__whole") - F.col("__first") + 1).drop("__whole", "__first")


def tiles(df: DataFrame, order: Sequence[str | Column], k: int, name: str = "ntile") -> DataFrame:
    """``df`` with the number, from 1, of the one of ``k`` parts of nearly equal size that a row's place falls in; larger parts come first."""
    rows = running(df, order, {"__place": F.lit(1).cast("bigint")}, {"__n": "__place"})
    base, more = F.expr(f"__n div {k}"), F.col("__n") % k
    long = more * (base + 1)
    tile = F.when(F.col("__place") < long, F.floor(F.col("__place") / (base + 1))).otherwise(more + F.floor((F.col("__place") - long) / F.greatest(base, F.lit(1))))
    return rows.withColumn(name, (tile + 1).cast("int")).select(*df.columns, name)
