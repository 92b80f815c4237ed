"""From raw documents to a mixed training corpus: five stages, each written as Parquet and read by the next.

A stage works on all rows that its predecessor kept and returns the columns of ``documents``; the last adds what the
mixture takes of each document.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from loomlake.llm import decontaminate, line_dedup, minhash_dedup, mixing, oracles, quality
from loomlake.llm.frames import NULL_ID, WORD
from loomlake.scratch import Scratch, swept
from loomlake.session import table

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def _shaped(docs: DataFrame) -> DataFrame:
    """The columns of documents, n_chars measured anew."""
    return docs.select("doc_id", "text", "lang", "source", F.length("text").cast("bigint").alias("n_chars"))


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Lines that fail a rule go; documents that the rules reject go.

    Rows are judged one by one, so ids may be null or repeat. Null and empty texts are rejected; an empty table stays empty.
    """
    judged = quality.judge(docs, carry=("lang", "source")).where("kept")
    return _shaped(judged.withColumnRenamed("clean_text", "text"))


def lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Later copies of repeated runs of lines go, and documents of which nothing is left.

    A null id counts as the largest; of rows with one id, the text of the least digest is the first. Rows that repeat an id and a text are one document and
    lose the same lines. A null text stays; an empty table stays empty.
    """
    out = line_dedup.dedup_lines(docs.select(*COLUMNS))
    return _shaped(out.where((F.col("n_removed") == 0) | (F.col("n_removed") < F.col("n_lines"))))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each component of near-duplicates one row stays, that with the smallest id; a null id counts as the largest.

    Rows are told apart by id and text, and of rows equal in both one stays. Rows without words are nobody's duplicate and stay; an empty table stays empty.
    """
    return minhash_dedup.one_of_each(docs.select(*COLUMNS))


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Occurrences of benchmark windows are cut out; documents of which nothing is left go.

    Rows are judged one by one. A null text, and one that had no words before, stays; an empty table or benchmark changes nothing.
    """
    had = docs.select(*COLUMNS, F.col("text").rlike(WORD).alias("had"))
    out = decontaminate.remove_contamination(had, table(spark, sf_dir, "benchmark"))
    return _shaped(out.where(~F.coalesce("had", F.lit(False)) | F.col("text").rlike(WORD)))


def mixture(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents that the mixture takes, with their size and the words taken, repeats counted.

    Rows are told apart by source, id and text. Rows equal in these follow each other in the mixture, so what it takes of them all is dealt out in turn: its
    words sum to the source's target, ties or not. A null source is a source, a null text has no words and is not taken; an empty table stays empty.
    """
    name = F.when(F.col("source").isNull(), "").otherwise(F.concat(F.lit("="), "source")).alias("s")
    key = [F.coalesce("doc_id", F.lit(NULL_ID)).alias("k"), name]
    by = ["k", "s", "th"]
    taken = mixing.mix(docs).select(*key, F.col("text_digest").alias("th"), "size", "taken").where("size > 0")
    groups = taken.groupBy(*by).agg(F.min("taken").alias("least"), (F.sum("taken") - F.count("*") * F.min("taken")).alias("more"), F.first("size").alias("size"))
    sized = docs.select(*COLUMNS, *key, F.unhex(F.md5("text")).alias("th"))
    turn = F.row_number().over(Window.partitionBy(*by).orderBy("lang", "n_chars")) - 1
    share = F.least(F.greatest(F.col("more") - F.col("turn") * F.col("size"), F.lit(0)), F.col("size"))
    out = sized.join(groups, by).withColumn("turn", turn).withColumn("taken", F.col("least") + share)
    return out.where("taken > 0").select(*COLUMNS, "size", "taken")


STAGES = [("quality rules", quality_rules), ("line dedup", lines), ("minhash near-dedup", near_duplicates), ("benchmark decontamination", decontamination), ("mixing", mixture)]

#: The same rows in SQL, for tables whose ids are distinct.
ORACLE_SQL = oracles.PIPELINE


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents of a directory; each but the last is written and read again.

    What a stage needed goes when its result is written; the tables that the last one reads stay.
    """
    docs, before, scratch = table(spark, sf_dir, "documents"), None, Scratch(spark, "pipeline")
    for name, stage in STAGES[:-1]:
        with swept(spark):
            after = scratch.write(stage(spark, docs, sf_dir), name.replace(" ", "-"))
        if before is not None:
            scratch.drop(before)
        docs = before = after
    return STAGES[-1][1](spark, docs, sf_dir)
