"""FASTA, fixed-width structures, tab-separated tables and JSON lines as DataFrames, and the sinks for them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from loomlake.sources.ranged_files import register


def read_fasta(spark: SparkSession, path: str, until: str = " #") -> DataFrame:
    """(header, name, sequence) of each record. Gzip files are read too, one task a file; the result is dealt out again."""
    raw = spark.read.option("lineSep", "\n>").text(path)
    record = raw.select(F.regexp_replace("value", "^>", "").alias("v")).where("trim(v) <> ''")
    head = F.trim(F.split("v", "\n", 2)[0])
    body = F.coalesce(F.get(F.split("v", "\n", 2), F.lit(1)), F.lit(""))
    cut = F.instr(head, until)
    out = record.select(head.alias("header"), F.when(cut > 0, F.substr(head, F.lit(1), cut - 1)).otherwise(head).alias("name"), F.regexp_replace(body, r"\s", "").alias("sequence"))
    return out.repartition(max(2, spark.sparkContext.defaultParallelism))


def fasta_lines(header: Column, sequence: Column, width: int = 60) -> Column:
    return F.concat(F.lit(">"), header, F.lit("\n"), F.regexp_replace(sequence, f"(.{{{width}}})(?=.)", "$1\n"))


def write_fasta(df: DataFrame, path: str, header: str, sequence: str, order: list) -> None:
    """Files in a total order: rows are sorted by ranges, and the names of the files follow the order."""
    df.orderBy(*order).select(fasta_lines(F.col(header), F.col(sequence)).alias("value")).write.text(path)


def read_structure(spark: SparkSession, path: str, residues: dict[str, str], places: bool = False) -> DataFrame:
    """(file, chain, resseq, letter), with ``places`` x, y and z too: C-alpha atoms of fixed-width files, the first of each residue; unknown residues are left out.

    Files are cut at lines and read by many tasks. The first atom of a residue is the one nearest the file's start; if that is of an unknown
    kind, the residue is left out, whatever follows. Lines whose number of the residue is no integer are skipped; a coordinate that is
    no number is null.
    """
    place = F.struct(F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("line"))
    lines = spark.read.text(path).select(F.col("_metadata.file_path").alias("file"), place.alias("o"), "value")
    atoms = lines.where(F.col("value").startswith("ATOM") & (F.trim(F.substring("value", 13, 4)) == "CA"))
    table = F.create_map(*[F.lit(v) for kv in residues.items() for v in kv])
    cell = lambda at, n: F.trim(F.substring("value", at, n))
    letter = F.try_element_at(table, F.upper(cell(18, 3))).alias("letter")
    axes = [cell(at, 8).try_cast("double").alias(name) for name, at in (("x", 31), ("y", 39), ("z", 47))]
    rows = atoms.select("file", F.substring("value", 22, 1).alias("chain"), cell(23, 4).try_cast("int").alias("resseq"), F.struct("o", letter, *axes).alias("atom"))
    first = rows.where("resseq is not null").groupBy("file", "chain", "resseq").agg(F.min_by("atom", "atom.o").alias("atom"))
    return first.where("atom.letter is not null").select("file", "chain", "resseq", "atom.letter", *(["atom.x", "atom.y", "atom.z"] if places else []))


def structure_lines(chain: Column, resseq: Column, residue: Column, x: Column, y: Column, z: Column) -> Column:
    """The line of a C-alpha atom in the fixed-width form, coordinates to three places."""
    return F.format_string("ATOM  %5d  CA  %3s %1s%4d    %8.3f%8.3f%8.3f", resseq, residue, chain, resseq, x, y, z)


def read_table(spark: SparkSession, path: str, schema: str, sep: str = "\t", many_lines: bool = False) -> DataFrame:
    """A table with a header, all text, blanks kept as empty strings. ``many_lines`` is for values with line breaks; a file is then one task's."""
    options = {"quote": '"', "escape": '"', "emptyValue": "", "multiLine": many_lines, "maxCharsPerColumn": -1}
    return spark.read.options(**options).csv(path, header=True, sep=sep, schema=schema).na.fill("")


def write_table(df: DataFrame, path: str, columns: list[str], sep: str = "\t") -> None:
    df.select(*columns).write.csv(path, sep=sep, header=True, quote='"', escape='"', emptyValue="")


def read_json_lines(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """Rows of a JSON lines file; lines that do not parse are skipped."""
    return spark.read.schema(schema).json(path, mode="DROPMALFORMED")


def read_arrays(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """Rows of NumPy archives of parallel arrays: a column for each name of the schema, a row for each place; see ``ranged_files.Arrays``."""
    return register(spark).read.format("arrays").schema(schema).load(path)


def write_arrays(df: DataFrame, path: str) -> None:
    """The columns as parallel arrays, in archives of bounded size."""
    register(df.sparkSession)
    df.write.format("arrays").mode("append").save(path)


def read_substitutions(spark: SparkSession, path: str) -> dict[tuple[str, str], float]:
    """A substitution matrix in the usual text form (comments, a line of letters, a line of scores for each letter), for ``alignment.identity``."""
    lines = [r["value"].split() for r in spark.read.text(path, wholetext=False).collect() if r["value"].strip() and not r["value"].startswith("#")]  # some 25 lines
    head = next(cells for cells in lines if not any(c.lstrip("-").isdigit() for c in cells))
    return {(cells[0], letter): float(score) for cells in lines if cells is not head for letter, score in zip(head, cells[1:], strict=True)}


def manifest(spark: SparkSession, path: str) -> DataFrame:
    """(path, length, sha256) of files."""
    return spark.read.format("binaryFile").load(path).select("path", "length", F.sha2("content", 256).alias("sha256"))
