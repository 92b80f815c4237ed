"""Small results as JSON and Markdown reports, tables kept between runs, and whole files through Spark's file systems."""

from __future__ import annotations

import json
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

#: Rows of a report, at most; a report is for reading.
MOST = 10_000


def _file(spark: SparkSession, path: str):
    jvm = spark._jvm
    at = jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), at


def write_bytes(spark: SparkSession, path: str, content: bytes) -> None:
    """One file in any store that Spark writes to."""
    system, at = _file(spark, path)
    out = system.create(at, True)
    try:
        out.write(bytearray(content))
    finally:
        out.close()


def _rows(df: DataFrame) -> list[dict]:
    rows = [r.asDict(recursive=True) for r in df.limit(MOST + 1).collect()]
    if len(rows) > MOST:
        raise ValueError(f"a report has {MOST} rows at most")
    return sorted(rows, key=lambda r: json.dumps(r, sort_keys=True, default=str))


def write_json(df: DataFrame, folder: str, title: str = "") -> None:
    """``report.json`` in a folder: an object with a title and the rows, indented."""
    body = json.dumps({"title": title, "rows": _rows(df)}, indent=2, default=str, ensure_ascii=False)
    write_bytes(df.sparkSession, f"{folder.rstrip('/')}/report.json", body.encode())


def read_json(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """Files of one JSON object each, over however many lines."""
    return spark.read.schema(schema).json(path, multiLine=True)


def markdown(df: DataFrame) -> str:
    """A table in Markdown, rows in a fixed order."""
    cell = lambda v: ("" if v is None else str(v)).replace("|", "\\|").replace("\n", " ")
    rows = [[cell(r[c]) for c in df.columns] for r in _rows(df)]
    return "\n".join("| " + " | ".join(r) + " |" for r in [df.columns, ["---"] * len(df.columns), *rows]) + "\n"


def write_markdown(df: DataFrame, path: str, title: str) -> None:
    write_bytes(df.sparkSession, path, f"# {title}\n\n{markdown(df)}".encode())


def cached(spark: SparkSession, path: str, compute: Callable[[], DataFrame], refresh: bool = False) -> DataFrame:
    """The table at ``path``; it is computed and written where it is absent, unfinished or to be refreshed."""
    system, done = _file(spark, f"{path.rstrip('/')}/_SUCCESS")
    if refresh or not system.exists(done):
        compute().write.mode("overwrite").parquet(path)
    return spark.read.parquet(path)
