"""Written intermediate tables in the folder that the cluster shares.

Iterative and multi-pass operators cut lineage by writing Parquet below ``spark.checkpoint.dir``,
so that the loss of an executor never loses a finished step. Where that setting is absent (tests, a
laptop) a temporary folder takes its place.
"""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager
from contextvars import ContextVar

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """``spark.checkpoint.dir`` of the session, or a local folder where it is unset and Spark is local."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if folder:
        return folder.rstrip("/")
    known = spark.sparkContext._jsc.sc().getCheckpointDir()
    if known.isDefined():
        return known.get().rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
    folder = tempfile.mkdtemp(prefix="loomlake-")
    spark.sparkContext.setCheckpointDir(folder)
    return folder


_MADE: ContextVar[list[str] | None] = ContextVar("loomlake_scratch", default=None)


def _delete(spark: SparkSession, path: str) -> None:
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(at, True)


@contextmanager
def _tidy(spark: SparkSession) -> Iterator[None]:
    """Has Spark delete the shuffle files of a query when it ends, which nothing needs once its table is written.

    Else they stay until the driver's garbage collection finds that no plan refers to them, often after all rounds of an operator.
    """
    key = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before = spark.conf.get(key, None)
    spark.conf.set(key, "true")
    try:
        yield
    finally:
        if before is None:
            spark.conf.unset(key)
        else:
            spark.conf.set(key, before)


@contextmanager
def swept(spark: SparkSession) -> Iterator[None]:
    """Deletes, at its end, the tables of all operators called within it.

    A result is read from them, so it must be written before the end. Results used outside leave their tables in the shared folder.
    """
    made: list[str] = []
    token = _MADE.set(made)
    try:
        yield
    finally:
        _MADE.reset(token)
        for root in made:
            _delete(spark, root)


class Scratch:
    """Tables that one operator call writes and reads again; ``drop`` frees those no longer needed, ``swept`` all of them."""

    def __init__(self, spark: SparkSession, name: str):
        self.spark = spark
        self.root = f"{shared_dir(spark)}/loomlake-{name}-{uuid.uuid4().hex[:12]}"
        self.count = 0
        if (made := _MADE.get()) is not None:
            made.append(self.root)

    def write(self, df: DataFrame, label: str = "t") -> DataFrame:
        """Write ``df`` and return it as read from the written files."""
        self.count += 1
        path = f"{self.root}/{self.count:03d}-{label}"
        with _tidy(self.spark):
            df.write.option("compression", "zstd").parquet(path)
        out = self.spark.read.schema(df.schema).parquet(path)
        out._loomlake_path = path  # type: ignore[attr-defined]
        return out

    def drop(self, *frames: DataFrame) -> None:
        """Delete the files of tables that nothing reads any more."""
        for frame in frames:
            _delete(self.spark, frame._loomlake_path)
