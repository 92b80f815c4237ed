"""Removal of repeated runs of lines by a distributed suffix array, in DataFrame operations only.

Every line with a word is a symbol. Prefix doubling ranks the suffixes of all documents by their first 1, 2, 4, ...
lines: the pair of a suffix's rank and that of the suffix half as far on is sorted by range over the cluster,
and its place in that order is the new rank. A suffix whose prefix is unique can start no longer repeat and leaves.

Suffixes that share their first m lines are an interval of the suffix array with a longest common prefix of m lines or more; the pair of
the ranks of its first and of its last 1, 2, 4, ... of these lines names it. A maximal repeated run of at least ``min_words`` words is the union of its
shortest windows of that many words, those that begin at each of its lines and those that end there, so the intervals of those
windows give exactly the lines of the maximal runs (a test extends every pair of places as far as it goes and compares); none is longer than ``min_words`` lines,
which bounds the doubling. In each interval the first window in (document, line) order stays and the lines of the later ones go.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from loomlake.llm.frames import NULL_ID, WORD, dealt, keyed, partitions
from loomlake.scratch import Scratch


def _shortest(min_words: int, forward: bool) -> Column:
    """Lines from this one on (or back) until ``min_words`` words are reached; null where a unique line or the end comes first."""
    by = Window.partitionBy("k", "th", "block").orderBy("pos")
    total, tries = F.col("words"), [F.when(F.col("words") >= min_words, 1)]
    for m in range(2, min_words + 1):
        total = total + (F.lead("words", m - 1) if forward else F.lag("words", m - 1)).over(by)
        tries.append(F.when(total >= min_words, m))
    return F.coalesce(*tries)


def _double(level: DataFrame, step: int, scratch: Scratch) -> DataFrame:
    """Ranks by twice as many lines, of the suffixes whose prefix of that length others share."""
    ahead = level.select("k", "th", (F.col("at") - step).alias("at"), F.col("rank").alias("next"))
    pairs = level.join(ahead, ["k", "th", "at"])
    shared = pairs.groupBy("rank", "next").agg(F.count("*").alias("n")).where("n > 1")
    names = scratch.write(_ranked(shared, "rank", "next"), "ranks")
    return scratch.write(_named(pairs, names, "rank", "next").select("k", "th", "at", F.col("new").alias("rank")), "suffixes")


def _ranked(distinct: DataFrame, *by: str) -> DataFrame:
    """Adds each row's place in the global order: range partitions in order, each sorted, numbered upwards."""
    return distinct.repartitionByRange(*by).sortWithinPartitions(*by).withColumn("new", F.monotonically_increasing_id())


def _named(rows: DataFrame, names: DataFrame, *by: str) -> DataFrame:
    """``rows`` whose pair ``by`` has a name, with that as new; rows of a pair that very many have are dealt over all partitions by document."""
    pair = F.struct(*by).alias("pair")
    return dealt(rows.withColumn("pair", pair), names.select(pair, "n", "new"), "pair", F.struct("k", "th"), "n").drop("pair")


def _later(windows: DataFrame, scratch: Scratch) -> DataFrame:
    """(k, th, at) of the lines of all windows but the first of each interval (m, rank, tail).

    An interval is dealt over parts by document. Whatever is not the first of its part is not the first of its interval; the firsts of the parts, no more than
    there are parts, then meet. So an interval that most documents are in is no one task's.
    """
    own, interval = F.struct("k", "th", "at"), ["m", "rank", "tail"]
    parted = windows.withColumn("part", F.pmod(F.xxhash64("k", "th"), F.lit(partitions(windows))).cast("int"))
    behind = own > F.min(own).over(Window.partitionBy(*interval, "part"))
    marked = scratch.write(parted.withColumn("behind", behind).drop("part"), "places")
    heads = marked.where("not behind")
    rest = heads.withColumn("behind", own > F.min(own).over(Window.partitionBy(*interval)))
    later = marked.where("behind").unionByName(rest.where("behind"))
    return later.select("k", "th", F.explode(F.sequence("at", F.col("at") + F.col("m") - 1)).alias("at"))


def repeated_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_words: int = 10) -> DataFrame:
    """(k, th, removed): line numbers, ascending, that are a later copy of a repeated run; documents without any are absent.

    ``k`` is the id (null: the largest), ``th`` a hash of the text. Rows that repeat both count once here, so the answer is that of the first of them.
    """
    scratch = Scratch(docs.sparkSession, "lines")
    base = keyed(docs, id_col, text_col).where("text is not null")
    split = base.select("k", F.xxhash64("text").alias("th"), F.posexplode(F.split("text", "\n")).alias("pos", "line"))
    lines = split.select("k", "th", "pos", F.xxhash64("line").alias("h"), F.xxhash64(F.lit(1), "line").alias("g"), F.regexp_count("line", F.lit(WORD)).alias("words")).where("words > 0")
    # rows that repeat an id and a text are one document; lines are numbered without those that have no word
    lines = scratch.write(lines.dropDuplicates(["k", "th", "pos"]).withColumn("at", F.row_number().over(Window.partitionBy("k", "th").orderBy("pos"))), "lines")
    names = scratch.write(_ranked(lines.groupBy("h", "g").agg(F.count("*").alias("n")).where("n > 1"), "h", "g"), "names")
    suffixes = _named(lines, names, "h", "g").select("k", "th", "at", "pos", "words", F.col("new").alias("rank"))
    # stretches of repeated lines without a unique one between
    suffixes = suffixes.withColumn("block", F.col("at") - F.row_number().over(Window.partitionBy("k", "th").orderBy("at")))
    suffixes = suffixes.withColumn("ahead", _shortest(min_words, True)).withColumn("back", _shortest(min_words, False))
    # a stretch of too few words holds no window, so its lines need no ranks
    held = F.sum("words").over(Window.partitionBy("k", "th", "block"))
    suffixes = scratch.write(suffixes.withColumn("held", held).where(F.col("held") >= min_words).drop("held"), "starts")

    ahead = suffixes.where("ahead is not null").select("k", "th", "at", F.col("ahead").alias("m"))
    back = suffixes.where("back is not null").select("k", "th", (F.col("at") - F.col("back") + 1).alias("at"), F.col("back").alias("m"))
    windows = scratch.write(ahead.union(back).distinct(), "windows")
    level, step, found = suffixes.select("k", "th", "at", "rank"), 1, []
    longest = windows.agg(F.max("m")).first()[0] or 0
    while step <= longest:
        mine = windows.where((F.col("m") >= step) & (F.col("m") < 2 * step))
        tail = level.select("k", "th", F.col("at").alias("end"), F.col("rank").alias("tail"))
        named = mine.join(level, ["k", "th", "at"]).withColumn("end", F.col("at") + F.col("m") - step).join(tail, ["k", "th", "end"])
        found.append(_later(named.select("m", "rank", "tail", "k", "th", "at"), scratch))
        if 2 * step <= longest:
            level = _double(level, step, scratch)
        step *= 2
    if not found:
        return suffixes.select("k", "th", F.array("pos").alias("removed")).where("false")
    gone = reduce(DataFrame.union, found).distinct().join(suffixes.select("k", "th", "at", "pos"), ["k", "th", "at"])
    return gone.groupBy("k", "th").agg(F.sort_array(F.collect_list("pos")).alias("removed"))


def _rest(lines: Column, removed: Column) -> Column:
    """The lines without those numbered in ``removed``: the stretches between them, in one pass."""
    stops = F.concat(removed, F.array(F.size(lines)))
    stretch = lambda stop, i: F.slice(lines, F.coalesce(F.get(removed, i - 1) + 2, F.lit(1)), stop - F.coalesce(F.get(removed, i - 1) + 1, F.lit(0)))
    return F.array_join(F.flatten(F.transform(stops, stretch)), "\n")


def dedup_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_words: int = 10) -> DataFrame:
    """``docs`` with later copies of repeated runs of lines deleted, and n_lines and n_removed added.

    A run is one or more whole lines, as they follow each other in a document (lines without a word are passed over, and
    stay), with ``min_words`` words or more. Of all places where a run occurs, the first in the order of id, text hash and line stays.
    n_lines counts lines with a word; n_removed those deleted.

    Null text stays null with no lines. A null id counts as the largest. Of rows that repeat an id and a text, one is the first and the others are copies of it:
    they lose all lines with a word, if these have ``min_words`` words together. Other columns stay as they are, whatever their names; where the
    caller has n_lines or n_removed, the new columns take their place. An empty table gives an empty result.
    """
    kept = [c for c in docs.columns if c not in ("n_lines", "n_removed")]
    names = [f"c{i}" for i in range(len(kept))]
    own = docs.select(*kept).toDF(*names)
    text = F.col(names[kept.index(text_col)]).cast("string")
    # a null text is a row by itself, so that many of them are no hot key
    th = F.when(text.isNull(), F.monotonically_increasing_id()).otherwise(F.xxhash64(text))
    whole = own.select(*names, F.coalesce(F.col(names[kept.index(id_col)]).cast("bigint"), F.lit(NULL_ID)).alias("k"), th.alias("th"))
    joined = whole.join(repeated_lines(docs, id_col, text_col, min_words), ["k", "th"], "left")
    joined = joined.withColumn("turn", F.row_number().over(Window.partitionBy("k", "th").orderBy("k"))).withColumn("lines", F.split(text, "\n"))
    has = lambda x: x.rlike(WORD)
    copy = (F.col("turn") > 1) & (F.regexp_count(text, F.lit(WORD)) >= min_words)
    n_lines = F.coalesce(F.size(F.filter("lines", has)), F.lit(0)).cast("bigint")
    n_removed = F.when(copy, n_lines).otherwise(F.coalesce(F.size("removed"), F.lit(0)).cast("bigint"))
    rest = F.when(copy, F.array_join(F.filter("lines", lambda x: ~has(x)), "\n")).when(F.col("removed").isNull(), text).otherwise(_rest(F.col("lines"), F.col("removed")))
    none = F.lit(0).cast("bigint")
    out = [rest.alias(c) if c == text_col else F.col(n).alias(c) for n, c in zip(names, kept, strict=True)]
    return joined.select(*out, F.when(text.isNull(), none).otherwise(n_lines).alias("n_lines"), F.when(text.isNull(), none).otherwise(n_removed).alias("n_removed"))
