"""Incremental scoring: what is already written is not scored again."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomlake.scratch import shared_dir


def append_new(scored: Callable[[DataFrame], DataFrame], rows: DataFrame, target: str, id_col: str) -> int:
    """Scores the rows whose ids the target lacks and appends them; returns how many. A rerun after a failure adds the rest."""
    spark, had = rows.sparkSession, 0
    path = spark._jvm.org.apache.hadoop.fs.Path(target)
    if path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(path):
        had = spark.read.parquet(target).count()
        rows = rows.join(spark.read.parquet(target).select(id_col), id_col, "left_anti")
    scored(rows).write.mode("append").parquet(target)
    # counts come from the footers of the files, so nothing is scored twice
    return spark.read.parquet(target).count() - had


def _stream(spark: SparkSession, source: str, schema, files: int = 8) -> DataFrame:
    """A stream over the Parquet files of a folder, or over one file."""
    reader = spark.readStream.schema(schema).option("maxFilesPerTrigger", files)
    path = spark._jvm.org.apache.hadoop.fs.Path(source)
    if path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).getFileStatus(path).isFile():
        return reader.option("pathGlobFilter", path.getName()).parquet(path.getParent().toString())
    return reader.parquet(source)


def resume_scores(spark: SparkSession, source: str, target: str, scored: Callable[[DataFrame], DataFrame], id_col: str, files: int = 8, written: Callable[[int], None] | None = None) -> DataFrame:
    """Scores what ``source`` holds and ``target`` lacks, and returns the whole target; may be stopped anywhere and run again.

    The source is Parquet files, to which more may be added between runs. A micro-batch leaves out ids of earlier batches, scores the
    rest and replaces the folder of its own number; the stream's state lies in the target beside them. A batch that failed after its
    write and before its commit is run again with the same files and number, so its rows replace themselves. Of rows with one id
    the first batch's counts, within a batch the least row. ``id_col`` must come back from ``scored``; null ids are one id.
    ``written`` is told each batch's number after its write.
    """
    out, schema = f"{target.rstrip('/')}/rows", spark.read.parquet(source).schema

    def sink(batch: DataFrame, number: int) -> None:
        session = batch.sparkSession
        once = batch.groupBy(id_col).agg(F.min(F.struct(*[c for c in batch.columns if c != id_col])).alias("r")).select(id_col, "r.*").select(*batch.columns)
        if number:
            known = session.read.parquet(out).where(F.col("batch") < number).select(F.col(id_col).alias("__known"))
            once = once.join(known, F.col(id_col).eqNullSafe(F.col("__known")), "left_anti")
        scored(once).write.mode("overwrite").parquet(f"{out}/batch={number}")
        if written:
            written(number)

    run = _stream(spark, source, schema, files).writeStream.foreachBatch(sink).option("checkpointLocation", f"{target.rstrip('/')}/_state").trigger(availableNow=True).start()
    run.awaitTermination()
    return spark.read.parquet(out).drop("batch")


def totals_by_stream(spark: SparkSession, source: str) -> DataFrame:
    """Counts and sums by event type and user, computed by a checkpointed stream over the files of a folder or file.

    Each micro-batch writes its partial sums in a folder of its own number, so a batch that is retried replaces itself.
    """
    root = f"{shared_dir(spark)}/loomlake-stream-{uuid.uuid4().hex[:12]}"
    schema = spark.read.parquet(source).schema

    def sink(batch: DataFrame, number: int) -> None:
        batch.groupBy("event_type", "user_id").agg(F.count("*").alias("n"), F.sum("value").alias("total")).write.mode("overwrite").parquet(f"{root}/out/batch={number}")

    stream = _stream(spark, source, schema)
    run = stream.writeStream.foreachBatch(sink).option("checkpointLocation", f"{root}/state").trigger(availableNow=True).start()
    run.awaitTermination()
    parts = spark.read.parquet(f"{root}/out")
    return parts.groupBy("event_type", "user_id").agg(F.sum("n").alias("n"), F.round(F.sum("total"), 6).alias("total"))
