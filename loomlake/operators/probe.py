"""Linear probes: standardised features, L2 logistic regression, out-of-fold scores."""

from __future__ import annotations

from collections.abc import Callable
from concurrent.futures import ThreadPoolExecutor
from contextvars import copy_context
from functools import reduce

from pyspark import inheritable_thread_target
from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import LogisticRegression
from pyspark.ml.evaluation import BinaryClassificationEvaluator
from pyspark.ml.feature import StandardScaler
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomlake.operators import metrics
from loomlake.operators.ordering import placed
from loomlake.scratch import Scratch


def _fit(train: DataFrame, C: float, balanced: bool):
    counts = train.groupBy("y").agg(F.count("*").alias("n"))
    total = train.count()
    weight = F.lit(float(total)) / (2 * F.col("n")) if balanced else F.lit(1.0)
    weighted = train.join(F.broadcast(counts), "y").withColumn("w", weight)
    # features are scaled by the sample deviation; the strength makes up for its ratio to the population's, which gives the same model
    strength = (total - 1) / total / (C * total)
    scale = StandardScaler(inputCol="x", outputCol="z", withMean=True, withStd=True)
    model = LogisticRegression(featuresCol="z", labelCol="y", weightCol="w", regParam=strength, elasticNetParam=0.0, standardization=False, maxIter=100)
    return Pipeline(stages=[scale, model]).fit(weighted)


def _vectors(df: DataFrame, id_col: str, features: str, y: str) -> DataFrame:
    return df.select(F.col(id_col).alias("id"), array_to_vector(F.col(features).cast("array<double>")).alias("x"), F.col(y).alias("y"))


def _scored(model, rows: DataFrame, id_col: str) -> DataFrame:
    return model.transform(rows).select(F.col("id").alias(id_col), "y", vector_to_array("probability")[1].alias("score"))


def fit_scores(df: DataFrame, id_col: str, features: str, y: str, C: float = 0.01, balanced: bool = True) -> DataFrame:
    """Scores of all rows by a probe fitted on the rows whose id hash falls in the first 70 %."""
    rows = _vectors(df, id_col, features, y)
    return _scored(_fit(rows.where(F.pmod(F.xxhash64("id"), F.lit(10)) < 7), C, balanced), rows, id_col)


def fitted(df: DataFrame, id_col: str, features: str, y: str, C: float = 0.01, balanced: bool = True) -> PipelineModel:
    """The scaler and the probe fitted on all rows; ``write().overwrite().save(path)`` keeps them, ``PipelineModel.load(path)`` brings them back."""
    return _fit(_vectors(df, id_col, features, y), C, balanced)


def scored(model: PipelineModel, df: DataFrame, id_col: str, features: str, y: str) -> DataFrame:
    """(id, y, score) by a fitted or loaded probe."""
    return _scored(model, _vectors(df, id_col, features, y), id_col)


def out_of_fold(df: DataFrame, id_col: str, features: str, y: str, folds: int = 5, C: float = 0.01) -> DataFrame:
    """Each row scored by the probe of the folds it is not in; the rows of a class are dealt to the folds in turn, in hash order."""
    rows = placed(_vectors(df, id_col, features, y), ["y", F.xxhash64("id"), "id"]).withColumn("fold", F.col("place") % folds)
    parts = [_scored(_fit(rows.where(F.col("fold") != k), C, True), rows.where(F.col("fold") == k), id_col) for k in range(folds)]
    return reduce(DataFrame.unionByName, parts)


def within(df: DataFrame, subset: str, values: list, id_col: str, features: str, y: str, C: float = 0.01, least: int = 10, least_pos: int = 3) -> DataFrame:
    """(subset, id, y, score): a probe refitted on each subset alone; subsets of under ``least`` rows or ``least_pos`` positives, or of one class, are left out."""
    sizes = {r[subset]: (r["n"], r["p"]) for r in df.where(F.col(subset).isin(values)).groupBy(subset).agg(F.count("*").alias("n"), F.count_if(F.col(y) == 1).alias("p")).collect()}
    fit = [v for v in values if v in sizes and sizes[v][0] >= least and least_pos <= sizes[v][1] < sizes[v][0]]
    parts = [fit_scores(df.where(F.col(subset) == v), id_col, features, y, C).withColumn(subset, F.lit(v)) for v in fit]
    empty = df.select(F.col(id_col), F.col(y).alias("y"), F.lit(0.0).alias("score"), F.col(subset)).where("false")
    return reduce(DataFrame.unionByName, parts, empty)


def _defect(n: int, p: int) -> str | None:
    """Why no ranking can be scored on a part of n rows, p of them positive."""
    return "no rows" if not n else "no positives" if not p else "no negatives" if p == n else None


def _at_once(spark: SparkSession, f: Callable, items: list, threads: int = 8) -> list:
    """``f`` of each item, in order, some at a time: a fit is many short jobs, which leave most of a cluster idle one after the other."""
    calls = [(copy_context(), item) for item in items]
    with ThreadPoolExecutor(threads) as pool:
        return list(pool.map(inheritable_thread_target(spark)(lambda call: call[0].run(f, call[1])), calls))


def nested_groups(df: DataFrame, id_col: str, features: str, y: str, group: str, outer: int = 5, inner: int = 4, strengths: tuple[float, ...] = (0.01, 0.1), seed: str = "", max_iter: int = 50) -> DataFrame:
    """Nested validation by whole groups: the strength is chosen by inner folds, the metric is read once on the outer fold.

    A group's hash names its outer and its inner fold, so no group is ever on both sides of a fit. One row a cell: (outer_fold, inner_fold,
    n, n_pos, n_groups, strength, auc, ap, reason); inner_fold is null in the row of an outer fold. Outer rows have the chosen strength
    and both metrics, or a reason why there are none; inner rows have a reason where a cell cannot be scored. Such an inner cell is joined
    to the next that can be, so its rows still train; with fewer than two that can, no strength can be chosen. Rows with a null
    group, label or vector take no part.
    """
    fold = lambda name, k: F.pmod(F.conv(F.substring(F.md5(F.concat(F.lit(f"{seed}{name}|"), F.col("g"))), 1, 13), 16, 10).cast("bigint"), F.lit(k)).cast("int")
    given = df.where(F.col(group).isNotNull() & F.col(y).isNotNull() & F.col(features).isNotNull())
    rows = given.select(F.col(id_col).alias("id"), F.col(features).cast("array<double>").alias("v"), F.col(y).cast("int").alias("y"), F.col(group).cast("string").alias("g"))
    rows = Scratch(df.sparkSession, "nested").write(rows.withColumns({"o": fold("outer", outer), "i": fold("inner", inner)}), "rows")
    counts = {(r["o"], r["i"]): (r["n"], r["p"], r["g"]) for r in rows.groupBy("o", "i").agg(F.count("*").alias("n"), F.count_if(F.col("y") == 1).alias("p"), F.count_distinct("g").alias("g")).collect()}  # outer x inner cells
    add = lambda cells: tuple(map(sum, zip((0, 0, 0), *cells, strict=True)))
    ready = rows.withColumn("x", array_to_vector("v")).drop("v")
    scale = StandardScaler(inputCol="x", outputCol="z", withMean=True, withStd=True)
    judge = BinaryClassificationEvaluator(labelCol="y", metricName="areaUnderPR")
    model = lambda c, total: LogisticRegression(featuresCol="z", labelCol="y", weightCol="w", regParam=1 / (c * total), elasticNetParam=0.0, standardization=False, maxIter=max_iter)
    out: list[tuple] = []
    able, cuts = [], []
    for o in range(outer):
        n, p, g = add([c for (a, _), c in counts.items() if a == o])
        cells = {i: add([c for (a, b), c in counts.items() if a != o and b == i]) for i in range(inner)}
        defects = {i: _defect(c[0], c[1]) for i, c in cells.items()}
        whole = [i for i in range(inner) if defects[i] is None]
        out += [(o, i, *cells[i], None, None, None, defects[i]) for i in range(inner)]
        reason = _defect(n, p) or ("too few inner folds to choose by" if len(whole) < 2 else None)
        if reason:
            out.append((o, None, n, p, g, None, None, None, reason))
            continue
        joined = {i: next((k for k, w in enumerate(whole) if w >= i), 0) for i in range(inner)}
        able.append((o, n, p, g, *add(cells.values())[:2]))
        cuts += [(o, [i for i in range(inner) if joined[i] == k], *able[-1][-2:]) for k in range(len(whole))]

    def outside(o: int, total: int, positive: int) -> DataFrame:
        """The rows that are not in an outer fold, both classes of equal weight."""
        return ready.where(F.col("o") != o).withColumn("w", F.when(F.col("y") == 1, total / (2 * positive)).otherwise(total / (2 * (total - positive))))

    def judged(cut: tuple[int, list[int], int, int]) -> list[float]:
        """The metric of each strength on some inner folds of those outside an outer one; they share the scaler of the others."""
        o, held, total, positive = cut
        inside, rest = (outside(o, total, positive).where(which) for which in (F.col("i").isin(held), ~F.col("i").isin(held)))
        scaler = scale.fit(rest)
        train, test = (scaler.transform(part).select("z", "y", "w").persist() for part in (rest, inside))
        try:
            return [judge.evaluate(model(c, total).fit(train).transform(test)) for c in strengths]
        finally:
            train.unpersist()
            test.unpersist()

    def read(best: tuple[int, float, int, int]) -> tuple[float, float]:
        """Both metrics of a strength on the outer fold."""
        o, c, total, positive = best
        fit = Pipeline(stages=[scale, model(c, total)]).fit(outside(o, total, positive))
        held = fit.transform(ready.where(F.col("o") == o)).select("y", vector_to_array("probability")[1].alias("score"))
        m = metrics.ranking(held).first()
        return m["auc"], m["ap"]

    marks = _at_once(df.sparkSession, judged, cuts)
    means = {o: [sum(x) / len(x) for x in zip(*(m for cut, m in zip(cuts, marks, strict=True) if cut[0] == o), strict=True)] for o, *_ in able}
    chosen = {o: strengths[max(range(len(strengths)), key=lambda k: m[k])] for o, m in means.items()}
    found = _at_once(df.sparkSession, read, [(o, chosen[o], *last) for o, _, _, _, *last in able])
    out += [(o, None, n, p, g, chosen[o], *m, None) for (o, n, p, g, *_), m in zip(able, found, strict=True)]
    return df.sparkSession.createDataFrame(out, "outer_fold int, inner_fold int, n bigint, n_pos bigint, n_groups bigint, strength double, auc double, ap double, reason string")
