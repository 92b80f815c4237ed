"""Samples and quotas that a rerun repeats: order is an md5 of seed and id."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def _order(seed: str, id_col: str) -> list[Column]:
    return [F.md5(F.concat(F.lit(f"{seed}|"), F.col(id_col).cast("string"))), F.col(id_col)]


def per_stratum(df: DataFrame, stratum: str, id_col: str, quota: int | Column, seed: str = "0") -> DataFrame:
    """At most ``quota`` rows of each stratum, in hash order."""
    rank = F.row_number().over(Window.partitionBy(stratum).orderBy(*_order(seed, id_col)))
    return df.withColumn("__rn", rank).where(F.col("__rn") <= quota).drop("__rn")


def quota_report(df: DataFrame, wants: DataFrame, stratum: str, id_col: str, want: str, seed: str = "0") -> DataFrame:
    """``wants`` (a row a stratum) with got, the rows that sampling by its quota gives, and short, whether that is under the quota."""
    taken = per_stratum(df.join(F.broadcast(wants), stratum), stratum, id_col, F.col(want), seed)
    counts = taken.groupBy(stratum).agg(F.count("*").alias("got"))
    out = wants.join(counts, stratum, "left").withColumn("got", F.coalesce("got", F.lit(0)))
    return out.withColumn("short", F.col("got") < F.col(want))


def simple(df: DataFrame, id_col: str, n: int, seed: str = "0") -> DataFrame:
    return df.orderBy(*_order(seed, id_col)).limit(n)


def scaled_quotas(counts: DataFrame, n: str, total: int) -> DataFrame:
    """``total`` shared by count, half to even, at least 1 each."""
    share = F.bround(F.lit(total).cast("double") * F.col(n) / F.sum(n).over(Window.partitionBy()))
    return counts.withColumn("quota", F.greatest(F.lit(1), share.cast("bigint")))


def top_per_group(df: DataFrame, group: str, order: list, k: int) -> DataFrame:
    return df.withColumn("place", F.row_number().over(Window.partitionBy(group).orderBy(*order))).where(F.col("place") <= k)
