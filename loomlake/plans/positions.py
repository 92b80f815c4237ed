"""Registered queries on files read by ranges, places in structures, wide sparse codes, nested validation and resumed scoring.

Analogues on the fixture tables: an embedding is the vector of one position, its label the sequence it belongs to, and its first three
numbers a place in space; a document with its label is a classified sequence, documents of one text a group.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Window
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DoubleType, StructField, StructType

from loomlake.functions import sequences as sq
from loomlake.functions import vectors as vec
from loomlake.operators import sparse_coding, structures
from loomlake.operators.probe import nested_groups
from loomlake.plans import catalog as c
from loomlake.plans.catalog import query
from loomlake.scratch import Scratch
from loomlake.session import table
from loomlake.sources import sequence_files as files
from loomlake.sources.ranged_files import register


def _folder(spark) -> str:
    return Scratch(spark, "files").root


# --- files by ranges -------------------------------------------------------------------------------------------------------


@query(f"SELECT doc_id, length(seq) AS n, md5(seq) AS digest FROM (SELECT doc_id, {c.SEQ} AS seq FROM documents)")
def fasta_in_ranges(spark, d):
    """Sequences written as FASTA and read by byte ranges, many tasks a file."""
    path = _folder(spark)
    files.write_fasta(c.docs_(spark, d).select(F.col("doc_id").cast("string").alias("header"), "seq", "doc_id"), path, "header", "seq", ["doc_id"])
    read = register(spark).read.format("fasta").option("splitBytes", 1 << 20).load(path)
    return read.select(F.col("name").cast("bigint").alias("doc_id"), F.length("sequence").cast("bigint").alias("n"), F.md5("sequence").alias("digest"))


#: Residues of the made structures; the third kind is unknown and left out.
KINDS = ("ALA", "GLY", "UNK")
_ATOMS = "atoms AS (SELECT vec_id // 10000 AS part, chr(65 + label % 26) AS chain, (vec_id % 10000)::INT AS resseq, CASE vec_id % 3 WHEN 0 THEN 'A' ELSE 'G' END AS letter, round(100 * embedding[1]::DOUBLE, 3) AS x, round(100 * embedding[2]::DOUBLE, 3) AS y, round(100 * embedding[3]::DOUBLE, 3) AS z FROM embeddings WHERE vec_id % 3 < 2)"


def _atoms(spark, d):
    """The embeddings' places as structures of 10,000 residues, through files in the fixed-width form."""
    path, e = _folder(spark), table(spark, d, "embeddings")
    number, kind = (F.col("vec_id") % 10000).cast("int"), F.element_at(F.array(*map(F.lit, KINDS)), (F.col("vec_id") % 3 + 1).cast("int"))
    axes = [F.round(F.col("embedding")[i].cast("double") * 100, 3) for i in range(3)]
    line = files.structure_lines(F.char(F.col("label") % 26 + 65), number, kind, *axes)
    e.select(F.expr("vec_id div 10000").alias("part"), line.alias("value")).write.partitionBy("part").text(path)
    read = files.read_structure(spark, path, {"ALA": "A", "GLY": "G"}, places=True)
    return read.select(F.regexp_extract("file", r"/part=(\d+)/", 1).cast("bigint").alias("part"), "chain", "resseq", "letter", "x", "y", "z")


@query(f"WITH {_ATOMS} SELECT * FROM atoms")
def structure_round_trip(spark, d):
    """Residues with their coordinates, written as structures and read again."""
    return _atoms(spark, d)


@query(f"WITH {_ATOMS}, pairs AS (SELECT a.part, a.resseq, b.resseq AS site, sqrt((a.x - b.x) * (a.x - b.x) + (a.y - b.y) * (a.y - b.y) + (a.z - b.z) * (a.z - b.z)) AS d3 FROM atoms a JOIN atoms b ON a.part = b.part AND b.letter = 'G') SELECT part, resseq, site, round(d3, 9) AS d3, abs(resseq - site) AS dseq FROM pairs QUALIFY row_number() OVER (PARTITION BY part, resseq ORDER BY pairs.d3, site) = 1")
def nearest_residue(spark, d):
    """Of each residue the nearest one of a kind in space, and how far apart both are in space and along the sequence."""
    atoms = Scratch(spark, "atoms").write(_atoms(spark, d))
    near = structures.nearest_place(atoms, atoms.where("letter = 'G'"), "part", "resseq", size=8.0)
    return near.select("part", "resseq", "site", F.round("d3", 9).alias("d3"), F.abs(F.col("resseq") - F.col("site")).alias("dseq"))


# --- wide sparse codes -----------------------------------------------------------------------------------------------------

#: Latents of the dictionary: the vectors of least digest, in that order.
LATENTS = 256
BIAS = [(j % 5 - 2) / 100 for j in range(64)]
_CODES = f"""w AS (SELECT row_number() OVER (ORDER BY md5('latent|' || vec_id), vec_id) - 1 AS latent, embedding::DOUBLE[] AS w FROM embeddings QUALIFY latent < {LATENTS}),
x AS (SELECT vec_id, label, embedding::DOUBLE[] AS x, list_transform(range(1, 65), lambda j: embedding[j]::DOUBLE - ((j - 1) % 5 - 2) / 100) AS c FROM embeddings),
z AS (SELECT vec_id, label, latent, w, list_inner_product(c, w) AS z FROM x, w WHERE list_inner_product(c, w) > 0),
y AS (SELECT vec_id, j, sum(z * w[j]) AS y FROM z, range(1, 65) AS r(j) GROUP BY vec_id, j),
f AS (SELECT x.vec_id, label, sum(x[j] * (coalesce(y, 0) + ((j - 1) % 5 - 2) / 100)) / (sqrt(sum(x[j] * x[j])) * sqrt(sum((coalesce(y, 0) + ((j - 1) % 5 - 2) / 100) ** 2))) AS fidelity FROM x CROSS JOIN range(1, 65) AS r(j) LEFT JOIN y USING (vec_id, j) GROUP BY x.vec_id, label)"""


def _dictionary(spark, d):
    order = [F.md5(F.concat(F.lit("latent|"), F.col("vec_id").cast("string"))), "vec_id"]
    few = table(spark, d, "embeddings").orderBy(*order).limit(LATENTS)
    return Scratch(spark, "dictionary").write(few.select((F.row_number().over(Window.orderBy(*order)) - 1).alias("latent"), F.col("embedding").alias("weights")))


@query(f"WITH {_CODES}, n AS (SELECT vec_id, count(*) AS n, sum(z) AS total FROM z GROUP BY vec_id) SELECT vec_id, coalesce(n, 0) AS n_active, round(coalesce(total, 0), 6) AS total, round(fidelity, 6) AS fidelity FROM f LEFT JOIN n USING (vec_id)")
def wide_codes(spark, d):
    """Each vector's sparse code under a dictionary that is a table, and how well the code gives the vector back."""
    rows, weights = table(spark, d, "embeddings"), _dictionary(spark, d)
    codes = Scratch(spark, "codes").write(sparse_coding.encoded(rows, "vec_id", "embedding", weights, BIAS))
    back = sparse_coding.decoded(codes, "vec_id", weights, BIAS)
    total = F.aggregate("values", F.lit(0.0), lambda s, v: s + v)
    every = rows.select("vec_id", F.col("embedding").cast("array<double>").alias("x")).join(codes, "vec_id").join(back, "vec_id")
    return every.select("vec_id", F.size("latents").cast("bigint").alias("n_active"), F.round(total, 6).alias("total"), F.round(vec.cosine(F.col("x"), F.col("y")), 6).alias("fidelity"))


@query(f"WITH {_CODES}, a AS (SELECT label, count(DISTINCT latent) AS n_active, count(*) AS entries FROM z GROUP BY label), m AS (SELECT label, count(*) AS n, avg(fidelity) AS fidelity FROM f GROUP BY label) SELECT label, n, coalesce(n_active, 0) AS n_active, round(coalesce(entries, 0)::DOUBLE / (n * (SELECT count(*) FROM w)), 9) AS share, round(fidelity, 6) AS fidelity FROM m LEFT JOIN a USING (label)")
def sequence_codes(spark, d):
    """By sequence: latents active at any position, share of active entries, mean cosine of positions and their reconstruction."""
    whole, _ = sparse_coding.sequence_features(table(spark, d, "embeddings"), "label", "vec_id", "embedding", _dictionary(spark, d), BIAS)
    return whole.select("label", "n", "n_active", F.round("share", 9).alias("share"), F.round("fidelity", 6).alias("fidelity"))


@query(f"WITH {_CODES} SELECT label, latent, count(*) AS n, round(max(z), 6) AS top, round(sum(z) / (SELECT count(*) FROM x WHERE x.label = z.label), 6) AS mean FROM z GROUP BY label, latent")
def latent_profile(spark, d):
    """The largest and the mean value of each latent over a sequence's positions."""
    _, features = sparse_coding.sequence_features(table(spark, d, "embeddings"), "label", "vec_id", "embedding", _dictionary(spark, d), BIAS)
    return features.select("label", "latent", "n", F.round("top", 6).alias("top"), F.round("mean", 6).alias("mean"))


# --- validation and resuming -----------------------------------------------------------------------------------------------


def _letter_shares(batches: Iterable[pa.RecordBatch], letters: bytes = b"ACDEFGHIKLMNPQRSTVWY") -> Iterator[pa.RecordBatch]:
    """(doc_id, shares): what ``fraction`` gives for each of the letters on the ``normalise``d text, from one count of its bytes."""
    upper, wanted = np.arange(ord("A"), ord("Z") + 1), np.frombuffer(letters, np.uint8) - ord("A")
    for batch in batches:
        texts = batch.column(1).cast(pa.large_binary())
        counts = np.array([np.bincount(np.frombuffer(t.as_buffer(), np.uint8), minlength=256) for t in texts]).reshape(-1, 256)
        both = counts[:, upper] + counts[:, upper + 32]
        parts = both[:, wanted] / np.maximum(both.sum(axis=1), 1)[:, None]
        lists = pa.ListArray.from_arrays(pa.array(np.arange(len(parts) + 1) * len(wanted), pa.int32()), pa.array(parts.ravel()))
        yield pa.RecordBatch.from_arrays([batch.column(0), lists], ["doc_id", "shares"])


@query()
def nested_validation(spark, d):
    """Nested validation of a probe on letter shares, by groups of equal texts: a metric or a reason for each cell."""
    texts = table(spark, d, "documents").select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    shares = texts.mapInArrow(_letter_shares, StructType([texts.schema["doc_id"], StructField("shares", ArrayType(DoubleType()))]))
    rows = shares.join(c.hub(spark, d).select("doc_id", "y", "grp"), "doc_id")
    return nested_groups(rows, "doc_id", "shares", "y", "grp", seed="nested|")


@query("SELECT event_id, round(value / (1 + user_id % 7), 9) AS score FROM events")
def resumed_scores(spark, d):
    """Scores appended by a stream; a second run over the same files finds nothing to do."""
    from loomlake.streaming.incremental import resume_scores

    target, batches = _folder(spark), []
    scored = lambda rows: rows.select("event_id", F.round(F.col("value") / (1 + F.col("user_id") % 7), 9).alias("score"))
    resume_scores(spark, f"{d}/events.parquet", target, scored, "event_id")
    out = resume_scores(spark, f"{d}/events.parquet", target, scored, "event_id", written=batches.append)
    if batches:
        raise ValueError("rows were scored again")
    return out
