"""Mixing sources to target weights, in DataFrame operations only.

Each document gets a hash-random key. Within a source the keys are cut into ranges of equal width, so that ranges hold
about ``RANGE`` documents however large the source is; a prefix sum over the few range totals and one within each
range give the words before every document in key order. A source's budget is cut exactly there, after
as many whole epochs as it holds. Texts are read once, for their sizes, and never shuffled.

Documents of a source that very many have are dealt over all partitions before they meet its plan, and the totals of the ranges are summed by parts
of their order, so no source is one task's. Targets alone are found in one task: that sorts one row of six numbers a source.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from loomlake.llm.frames import NULL_ID, WORD, dealt
from loomlake.operators.ordering import running
from loomlake.scratch import Scratch

#: Documents that one range of keys holds on average.
RANGE = 4096
_KEYS = 2.0**52


def targets(sources: DataFrame, weights: tuple[int, ...], share: float, cap: float) -> DataFrame:
    """Adds target to (source, source_size, n): weights go round the sources in code point order, null last.

    ``share`` of all sizes is dealt by weight; no target exceeds ``cap`` times its source, and what a source cannot take
    is dealt again. That ends at one level L with target = min(L * weight, cap * size), found in one pass over
    sources by rising size per weight: the first whose cap reaches the level is not cut, nor are those after it.
    """
    place = F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())) - 1
    weighted = sources.withColumn("sid", place).withColumn("weight", F.element_at(F.array(*map(F.lit, weights)), (F.col("sid") % len(weights) + 1).cast("int")).cast("bigint"))
    rising = Window.orderBy(F.col("source_size") / F.col("weight"), "sid")
    before = rising.rowsBetween(Window.unboundedPreceding, -1)
    after = rising.rowsBetween(0, Window.unboundedFollowing)
    left = F.lit(share) * F.sum("source_size").over(Window.partitionBy()) - F.lit(cap) * F.coalesce(F.sum("source_size").over(before), F.lit(0))
    level = weighted.withColumn("level", left / F.sum("weight").over(after))
    free = F.when(F.lit(cap) * F.col("source_size") / F.col("weight") >= F.col("level"), F.struct(F.col("source_size") / F.col("weight"), "sid", "level"))
    level = level.withColumn("top", F.min(free).over(Window.partitionBy())["level"])
    limit = F.lit(cap) * F.col("source_size")
    return level.select("source", "source_size", "n", "sid", F.coalesce(F.least(F.col("top") * F.col("weight"), limit), limit).cast("double").alias("target"))


def mix(docs: DataFrame, id_col: str = "doc_id", source_col: str = "source", text_col: str = "text", weights: tuple[int, ...] = (5, 2, 1), share: float = 1.5, cap: float = 2.0, seed: str = "mix") -> DataFrame:
    """How many words of each document a mixture takes.

    Returns one row a document: ``id_col``, ``source_col``, size (words), source_size, target (the source's budget in
    words), taken (words of this document in the mixture, repeats counted), text_digest (of its text). A source's taken words sum to its target
    rounded down; the document at the cut is taken in part. Every run gives the same rows.

    Null text has size 0; a null source is a source of its own, last in order. A null id is kept and hashed as an
    empty string. Rows that repeat an id are ordered by size, then by the digest of their text; where that is equal too,
    which of them is cut is not told apart. A source without words takes none. Extra columns are ignored; an empty table gives an empty result.
    """
    scratch = Scratch(docs.sparkSession, "mix")
    k = F.coalesce(docs[id_col].cast("bigint"), F.lit(NULL_ID))
    digest = F.md5(F.concat(F.lit(f"{seed}|"), F.coalesce(docs[id_col].cast("bigint").cast("string"), F.lit(""))))
    sized = scratch.write(
        docs.select(
            k.alias("k"),
            docs[source_col].cast("string").alias("source"),
            F.coalesce(F.regexp_count(docs[text_col].cast("string"), F.lit(WORD)), F.lit(0)).cast("bigint").alias("size"),
            F.conv(F.substring(digest, 1, 13), 16, 10).cast("bigint").alias("key"),
            F.unhex(F.md5(docs[text_col].cast("string"))).alias("th"),
        ),
        "sizes",
    )
    sources = scratch.write(targets(sized.groupBy("source").agg(F.sum("size").alias("source_size"), F.count("*").alias("n")), weights, share, cap), "sources")
    budget = F.floor("target").cast("bigint")
    plan = sources.withColumn("budget", budget).withColumn("epochs", F.expr("if(source_size > 0, budget div source_size, 0)"))
    plan = plan.withColumn("rest", F.col("budget") - F.col("epochs") * F.col("source_size")).withColumn("ranges", F.ceil(F.col("n") / RANGE).cast("double"))
    # words of all sources before this one, to be taken off the sums over all ranges
    plan = plan.withColumn("base", F.coalesce(F.sum("source_size").over(Window.orderBy("sid").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    named = F.coalesce(F.concat(F.lit("="), "source"), F.lit("")).alias("name")
    met = dealt(sized.withColumn("name", named), scratch.write(plan.withColumn("name", named).drop("source"), "plan"), "name", "key", "n")
    placed = scratch.write(met.withColumn("range", F.floor(F.col("key") * (F.col("ranges") / _KEYS))), "placed")
    totals = placed.groupBy("sid", "range").agg(F.sum("size").alias("words"), F.min("base").alias("base"))
    offsets = running(totals, ["sid", "range"], {"sum": "words"}).select("sid", "range", (F.col("sum") - F.col("base")).alias("offset"))
    inside = Window.partitionBy("sid", "range").orderBy("key", "k", "size", "th").rowsBetween(Window.unboundedPreceding, -1)
    ordered = placed.withColumn("inside", F.coalesce(F.sum("size").over(inside), F.lit(0))).join(offsets, ["sid", "range"])
    part = F.greatest(F.lit(0), F.least(F.col("size"), F.col("rest") - F.col("offset") - F.col("inside")))
    return ordered.select(F.when(F.col("k") != NULL_ID, F.col("k")).alias(id_col), F.col("source").alias(source_col), "size", "source_size", "target", (F.col("epochs") * F.col("size") + part).cast("bigint").alias("taken"), F.col("th").alias("text_digest"))
