"""Ranking metrics over (y, score) rows with optional weights, by group: running sums over distinct scores.

A distinct score is one row after the first aggregation, so ties are exact and the sums see the curve, not the data. Within groups
they are window sums; over a whole table they run over ranges of the scores, so no task holds the curve.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from loomlake.functions.sequences import f_score
from loomlake.operators.ordering import running


def curve(df: DataFrame, by: Sequence[str] = (), y: str = "y", score: str = "score", weight: str | None = None) -> DataFrame:
    """One row a distinct score: positives p, negatives n, and tp, fp at or above it, with totals all_p, all_n."""
    w = F.col(weight) if weight else F.lit(1)
    steps = df.groupBy(*by, score).agg(F.sum(F.when(F.col(y) == 1, w).otherwise(0)).alias("p"), F.sum(F.when(F.col(y) == 0, w).otherwise(0)).alias("n"))
    if not by:
        before = running(steps, [F.col(score).desc()], {"tp": "p", "fp": "n"}, {"all_p": "tp", "all_n": "fp"})
        return before.withColumns({"tp": F.col("tp") + F.col("p"), "fp": F.col("fp") + F.col("n")})
    down = Window.partitionBy(*by).orderBy(F.col(score).desc()).rowsBetween(Window.unboundedPreceding, 0)
    whole = Window.partitionBy(*by)
    return steps.withColumns({"tp": F.sum("p").over(down), "fp": F.sum("n").over(down), "all_p": F.sum("p").over(whole), "all_n": F.sum("n").over(whole)})


def ranking(df: DataFrame, by: Sequence[str] = (), y: str = "y", score: str = "score", weight: str | None = None) -> DataFrame:
    """auc (mid-ranks) and ap (step sum) by group; null where a class is missing."""
    c = curve(df, by, y, score, weight)
    # a positive beats the negatives below its score and ties with those at it
    wins = F.sum(F.col("p") * (2 * (F.col("all_n") - F.col("fp")) + F.col("n")))
    ap = F.sum(F.col("p") * F.col("tp").cast("double") / (F.col("tp") + F.col("fp")))
    one = c.groupBy(*by).agg(wins.alias("w"), ap.alias("a"), F.max("all_p").alias("all_p"), F.max("all_n").alias("all_n"))
    return one.select(*by, F.try_divide(F.col("w").cast("double"), 2 * F.col("all_p") * F.col("all_n")).alias("auc"), F.when(F.col("all_n") > 0, F.try_divide("a", F.col("all_p"))).alias("ap"), F.col("all_p").alias("n_pos"), F.col("all_n").alias("n_neg"))


def precision_recall(df: DataFrame, by: Sequence[str] = (), y: str = "y", score: str = "score", closed: bool = False) -> DataFrame:
    """threshold, precision, recall, f1 at every distinct score; ``closed`` adds the end point of precision 1 and recall 0, without a threshold."""
    c = curve(df, by, y, score)
    p, r = F.col("tp").cast("double") / (F.col("tp") + F.col("fp")), F.try_divide(F.col("tp").cast("double"), F.col("all_p"))
    out = c.select(*by, F.col(score).alias("threshold"), p.alias("precision"), r.alias("recall"), f_score(p, r).alias("f1"))
    if closed:
        end = out.select(*by).distinct() if by else out.limit(1)
        out = out.unionByName(end.select(*by, F.lit(None).cast("double").alias("threshold"), F.lit(1.0).alias("precision"), F.lit(0.0).alias("recall"), F.lit(0.0).alias("f1")))
    return out


def best_f1(df: DataFrame, by: Sequence[str] = (), y: str = "y", score: str = "score") -> DataFrame:
    """The threshold of the largest F1, the lowest on ties."""
    pr = precision_recall(df, by, y, score)
    return pr.groupBy(*by).agg(F.max("f1").alias("f1"), F.max_by("threshold", F.struct("f1", -F.col("threshold"))).alias("threshold"))


def confusion(df: DataFrame, threshold: float | Column, by: Sequence[str] = (), y: str = "y", score: str = "score") -> DataFrame:
    hit = F.col(score) >= threshold
    counts = df.groupBy(*by).agg(F.count_if(hit & (F.col(y) == 1)).alias("tp"), F.count_if(hit & (F.col(y) == 0)).alias("fp"), F.count_if(~hit & (F.col(y) == 1)).alias("fn"), F.count_if(~hit & (F.col(y) == 0)).alias("tn"))
    p = F.coalesce(F.try_divide(F.col("tp").cast("double"), F.col("tp") + F.col("fp")), F.lit(0.0))
    r = F.coalesce(F.try_divide(F.col("tp").cast("double"), F.col("tp") + F.col("fn")), F.lit(0.0))
    return counts.withColumns({"precision": p, "recall": r}).withColumn("f1", f_score(F.col("precision"), F.col("recall")))


def frozen(chosen: DataFrame, judged: DataFrame, y: str = "y", score: str = "score") -> DataFrame:
    """The threshold of the best F1 on ``chosen``, and what it gives on ``judged``: tp, fp, fn, tn, precision, recall, f1."""
    one = best_f1(chosen, (), y, score).select(F.col("threshold").alias("__t"))
    rows = judged.select(y, score).crossJoin(F.broadcast(one))  # one row
    return confusion(rows, F.col("__t"), ["__t"], y, score).withColumnRenamed("__t", "threshold")


def class_report(df: DataFrame, y: str = "y", predicted: str = "predicted") -> DataFrame:
    """For each true class cls: tp, support, precision, recall, f1; and over all macro_f1 (its mean) and accuracy."""
    cells = df.groupBy(F.col(y).alias("y"), F.col(predicted).alias("predicted")).agg(F.count("*").alias("n"))
    hit = F.when(F.col("y") == F.col("predicted"), F.col("n")).otherwise(0)
    actual = cells.groupBy(F.col("y").alias("cls")).agg(F.sum(hit).alias("tp"), F.sum("n").alias("support"))
    said = cells.groupBy(F.col("predicted").alias("cls")).agg(F.sum("n").alias("said"))
    share = lambda of: F.coalesce(F.try_divide(F.col("tp").cast("double"), of), F.lit(0.0))
    each = actual.join(said, "cls", "left").select("cls", "tp", "support", share(F.col("said")).alias("precision"), share(F.col("support")).alias("recall"))
    each = each.withColumn("f1", f_score(F.col("precision"), F.col("recall")))
    whole = each.agg(F.avg("f1").alias("macro_f1"), F.try_divide(F.sum("tp").cast("double"), F.sum("support")).alias("accuracy"))  # one row
    return each.crossJoin(F.broadcast(whole))


def by_tier(df: DataFrame, tier: str, least: int = 4, y: str = "y", score: str = "score") -> DataFrame:
    """(tier, auc, n_pos, n_neg): all positives against one tier of negatives at a time; tiers with too few rows are left out.

    What a negative loses to the positives depends on its score alone, so the positives are summed up once and never repeated for each tier.
    """
    over = curve(df, (), y, score).select(F.col(score).alias("__s"), (2 * F.col("tp") - F.col("p")).alias("__lost"), "all_p")
    held = df.where(F.col(y) == 0).groupBy(F.col(tier).alias("tier"), F.col(score).alias("__s")).agg(F.count("*").alias("n"))
    one = held.join(over, "__s").groupBy("tier").agg(F.sum(F.col("n") * F.col("__lost")).alias("lost"), F.max("all_p").alias("n_pos"), F.sum("n").alias("n_neg"))
    out = one.select("tier", F.try_divide(F.col("lost").cast("double"), 2 * F.col("n_pos") * F.col("n_neg")).alias("auc"), "n_pos", "n_neg")
    return out.where((F.col("n_pos") + F.col("n_neg") >= least) & F.col("auc").isNotNull())
