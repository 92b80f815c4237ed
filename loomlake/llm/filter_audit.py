"""How five filters of a corpus interact, for every order in which they may run.

Four filters judge a row by itself. The fifth finds rows whose text an earlier row has, by refining a partition of the table: rows are split by the length of
their text and a hash of its first block, then by the hashes of further blocks, and what is alone in its class is dropped after each split. Rows that are
still together at the end are compared by their whole texts with the class's first row, so no verdict rests on a hash. Each row then is five
bits, and all orders follow from the number of rows of each source, bits and labels.
"""

from __future__ import annotations

from collections.abc import Callable
from itertools import permutations
from math import factorial

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loomlake.llm.frames import NULL_ID, WHITE, dealt, sifted, spread
from loomlake.scratch import Scratch

#: The filters, in the order of their bits.
FILTERS = "ABCDE"
#: Code points of the first block; the blocks end at this times the powers of ``GROWTH``, so that a text of any length is few blocks.
BLOCK, GROWTH = 256, 8
#: Bits of the bitmap, broadcast, that keeps texts which are alone in their class from being shuffled; beyond some ten million classes more bits keep more.
SIEVE = 2**25


def words_of(text: Column) -> Column:
    """Runs of anything but ASCII white space."""
    return F.array_remove(F.split(text, WHITE), "")


def row_bits(words: Column, text: Column) -> Column:
    """Bits 0 to 3: under 50 words; under 65 % of them distinct; over 5 % of the characters A-Z; holds one of ``#$%&*|``."""
    n, distinct, size = (c.cast("bigint") for c in (F.size(words), F.size(F.array_distinct(words)), F.length(text)))
    capitals = size - F.length(F.regexp_replace(text, "[A-Z]+", ""))
    flags = (n < 50, 100 * distinct < 65 * n, 100 * capitals > 5 * size, text.rlike("[#$%&*|]"))
    return sum((F.when(flag, 2**i).otherwise(0) for i, flag in enumerate(flags)), F.lit(0))


def _blocks(text: Column, named: Callable[..., Column], block: int) -> Column:
    """Names of the blocks behind the first, up to the end of the text."""
    n = F.length(text)
    # rounding may add a block, which is empty and has one name
    many = F.when(n > block, F.ceil(F.log2(n / F.lit(block)) / 3)).otherwise(0).cast("int")
    start = lambda j: (F.lit(block) * F.pow(F.lit(GROWTH), j - 1)).cast("bigint")
    size = lambda j: F.least(start(j) * (GROWTH - 1), F.lit(2**31 - 1))
    one = lambda j: named(F.substring(text, (start(j) + 1).cast("int"), size(j).cast("int")))
    return F.when(many > 0, F.transform(F.sequence(F.lit(1), F.greatest(many, F.lit(1))), one)).otherwise(F.array().cast("array<bigint>"))


def later_copies(
    rows: DataFrame, scratch: Scratch, named: Callable[..., Column] = F.xxhash64, block: int = BLOCK, judged: dict[str, Column] | None = None
) -> tuple[DataFrame, DataFrame]:
    """(alone, grouped): the columns of ``rows`` but the text, and whether a row with a smaller k has the same text.

    ``rows`` has k, text and whatever else; ``alone`` holds those that no other row shares length and first block with. Names only bring rows
    together; a name that different texts share costs a further round of comparing and changes no verdict.

    ``judged`` are further columns, made from those of ``rows``. Texts are read twice; the second time only rows that may share a class are judged.
    """
    judged = judged or {}
    others = [c for c in rows.columns if c != "text"] + list(judged)
    first = rows.select("*", named(F.length("text"), F.substring("text", 1, block)).alias("c"))
    sizes = scratch.write(first.withColumns(judged).groupBy("c").agg(F.count("*").alias("m"), *(F.min(c).alias(c) for c in others)), "classes")
    alone = sizes.where("m = 1").select(*others, F.lit(False).alias("copy"))
    shared = sizes.where("m > 1").select("c", "m")
    near = sifted(first, shared, "c", SIEVE).withColumns(judged)
    named_rows = near.withColumn("blocks", _blocks(F.col("text"), named, block)).withColumn("name", named("c", "blocks"))
    together = dealt(named_rows, shared, "c", "k", "m")
    kept = scratch.write(together.withColumn("row", F.monotonically_increasing_id()), "together")

    live, step = kept.select("row", "k", "name", "c", "blocks"), 0
    while not live.where(F.size("blocks") > step).isEmpty():
        live = live.withColumn("c", F.when(F.size("blocks") > step, named("c", F.get("blocks", F.lit(step)))).otherwise(F.col("c")))
        still = live.groupBy("c").agg(F.count("*").alias("m")).where("m > 1").select("c")
        live, step = scratch.write(spread(live, still, "c", "row").select("row", "k", "name", "c", "blocks"), "split"), step + 1

    left, copies = live.select("row", "k", "name"), []
    while not left.isEmpty():
        heads = left.groupBy("name").agg(F.min(F.struct("k", "row")).alias("head")).select("name", F.col("head.k").alias("head"), "head.row")
        texts = kept.select("row", F.col("text").alias("head_text")).join(heads, "row").drop("row")
        members = kept.select("row", "k", "name", "text")
        if copies:
            members = members.join(left.select("row"), "row", "left_semi")
        met = spread(members, texts, "name", "row")
        seen = scratch.write(met.select("row", "k", "name", F.when(F.col("text") == F.col("head_text"), F.col("k") > F.col("head")).alias("copy")), "compared")
        copies.append(seen.where("copy").select("row"))
        left = seen.where("copy is null").select("row", "k", "name")
    verdict = kept.select("row", *others)
    for n, found in enumerate(copies):
        verdict = verdict.join(found.withColumn(f"copy{n}", F.lit(True)), "row", "left")
    copy = F.coalesce(*(F.col(f"copy{n}") for n in range(len(copies))), F.lit(False))
    return alone, verdict.select(*others, copy.alias("copy"))


def bits(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", part_col: str = "source") -> DataFrame:
    """(part, mask, good, toxic, n): how many rows fail which filters, by their label."""
    scratch = Scratch(docs.sparkSession, "audit")
    rows = docs.select(
        F.coalesce(docs[id_col].cast("bigint"), F.lit(NULL_ID)).alias("k"), F.coalesce(docs[part_col].cast("string"), F.lit("")).alias("part"),
        F.coalesce(docs[text_col].cast("string"), F.lit("")).alias("text"),
    )
    alone, grouped = later_copies(rows, scratch, judged={"bits": row_bits(words_of(F.col("text")), F.col("text"))})
    every = alone.unionByName(grouped).select("k", "part", (F.col("bits") + F.when(F.col("copy"), 16).otherwise(0)).alias("mask"))
    flag = lambda c: F.coalesce(F.bool_or(labels[c] == 1), F.lit(False)).alias(f"is_{c}")
    marks = labels.groupBy(labels["doc_id"].cast("bigint").alias("k")).agg(flag("quality"), flag("toxic")).where("k is not null")
    known = every.where(F.col("k") != NULL_ID).join(marks, "k", "left")
    nameless = every.where(F.col("k") == NULL_ID).withColumns({"is_quality": F.lit(False), "is_toxic": F.lit(False)})
    both = known.unionByName(nameless).withColumns({"good": F.coalesce("is_quality", F.lit(False)), "toxic": F.coalesce("is_toxic", F.lit(False))})
    return scratch.write(both.groupBy("part", "mask", "good", "toxic").agg(F.count("*").alias("n")), "bits")


def audit(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", part_col: str = "source") -> DataFrame:
    """One row for each part, order of the filters and step: what the step's filter does there.

    Returns part, filter_order, step, kept, removed, redundant (fail it, removed earlier), unique_fails (fail it only), good_lost and toxic_lost
    (removed here, by label) and shapley (removed by it, summed over all orders). Rows of all steps are there, zeros included.

    Null text is empty, and fails for its few words; a null part is the empty one. A null id counts as the largest and has no label, so of equal texts
    without ids none is the later; rows that repeat an id are judged one by one and are no copies of each other. Labels that repeat an id count
    if any of them says so. Extra columns are ignored; an empty table gives an empty result.
    """
    spark, every = docs.sparkSession, range(len(FILTERS))
    masks = [(i, before) for i in every for before in range(2 ** len(FILTERS)) if not before >> i & 1]
    weight = lambda before: factorial(before.bit_count()) * factorial(len(FILTERS) - 1 - before.bit_count())
    pair = F.explode(F.array(*(F.struct(F.lit(i).alias("i"), F.lit(2**i).alias("own"), F.lit(before).alias("before"), F.lit(weight(before)).alias("w")) for i, before in masks)))
    cells = bits(docs, labels, id_col, text_col, part_col).select("*", pair.alias("p")).select("part", "mask", "good", "toxic", "n", "p.*")
    total = lambda when, name: F.sum(F.when(when, F.col("n")).otherwise(0)).cast("bigint").alias(name)
    earlier, fails = F.col("mask").bitwiseAND(F.col("before")) != 0, F.col("mask").bitwiseAND(F.col("own")) != 0
    here = fails & ~earlier
    sums = cells.groupBy("part", "i", "before", "w").agg(
        total(~fails & ~earlier, "kept"), total(here, "removed"), total(fails & earlier, "redundant"), total(F.col("mask") == F.col("own"), "unique_fails"),
        total(here & F.col("good"), "good_lost"), total(here & F.col("toxic"), "toxic_lost"),
    )
    shapley = sums.groupBy("part", "i").agg(F.sum(F.col("removed") * F.col("w")).cast("bigint").alias("shapley"))
    orders = [("".join(FILTERS[i] for i in o), s + 1, i, sum(2**j for j in o[:s])) for o in permutations(every) for s, i in enumerate(o)]
    # one row a step of each order: fixed by the number of filters
    steps = F.broadcast(spark.createDataFrame(orders, "filter_order string, step int, i int, before int"))
    out = sums.join(shapley, ["part", "i"]).join(steps, ["i", "before"])
    return out.select("part", "filter_order", "step", "kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley")
