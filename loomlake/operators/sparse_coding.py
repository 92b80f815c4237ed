"""Sparse codes of vectors under a wide dictionary that is itself a table, and the reconstruction from them.

A dictionary is a table (latent int from 0, weights array of d numbers, one row a latent); the code of x is ReLU(W(x - b)), kept as the
positive entries only. The weights meet the vectors block by block: the driver reads one block of at most ``BLOCK`` bytes at a time and
broadcasts it. Up to ``PASS`` bytes of blocks serve one pass over the vectors; a larger dictionary takes more passes, whose parts are put
together by a shuffle on the row's id. So neither the driver's nor a task's memory grows with the dictionary or with the number of vectors.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DoubleType, IntegerType, StructType

from loomlake.functions import vectors as vec
from loomlake.scratch import Scratch

#: Bytes of weights (8 a number) in one broadcast block.
BLOCK = 16 << 20
#: Bytes of weights that one pass over the vectors uses.
PASS = 128 << 20
#: Numbers of a product that a task holds at a time.
CELLS = 1 << 21


def _passes(dictionary: DataFrame, d: int, block: int, most: int) -> Iterator[list]:
    """The broadcast blocks (first latent, weights) of each pass, in order."""
    spark = dictionary.sparkSession
    n = dictionary.agg(F.max("latent")).first()[0]
    n = 0 if n is None else n + 1
    step, held = max(1, block // (8 * d)), []
    for lo in range(0, n, step):
        part = dictionary.where(F.col("latent").between(lo, min(lo + step, n) - 1)).select("latent", "weights").toArrow()
        weights = np.zeros((min(step, n - lo), d))
        if any(len(w) != d for w in part["weights"]):
            raise ValueError(f"a latent has {d} weights")
        if len(part):
            weights[part["latent"].to_numpy() - lo] = part["weights"].combine_chunks().flatten().to_numpy().astype(np.float64).reshape(-1, d)
        held.append(spark.sparkContext.broadcast((lo, weights)))
        if (len(held) + 1) * step * 8 * d > most:
            yield held
            held = []
    if held:
        yield held


def _listed(values: list[np.ndarray], kind: pa.DataType) -> pa.Array:
    ends = np.concatenate([[0], np.cumsum([len(v) for v in values])]).astype(np.int32)
    return pa.ListArray.from_arrays(ends, pa.array(np.concatenate([np.zeros(0), *values]), kind))


def encoded(df: DataFrame, id_col: str, vector: str, dictionary: DataFrame, bias: Sequence[float], block: int = BLOCK, most: int = PASS) -> DataFrame:
    """(id, latents, values): the positive entries of each row's code, by latent. Ids must be unique where the dictionary takes more than one pass.

    A null vector, one of another length than the bias, or one with a null or non-finite entry has null in both; a row without a
    positive entry, or with an empty dictionary, has empty arrays.
    """
    d, b = len(bias), np.asarray(bias, dtype=np.float64)
    whole = (F.size(vector) == d) & F.forall(vector, lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < float("inf")))
    rows = df.select(id_col, F.when(whole, F.col(vector).cast("array<double>")).alias("x"))
    schema = StructType([rows.schema[id_col]]).add("latents", ArrayType(IntegerType())).add("values", ArrayType(DoubleType()))

    def run(blocks):
        def coded(batches):
            for batch in batches:
                good = np.flatnonzero(np.asarray(batch["x"].is_valid()))
                x = batch["x"].drop_null().flatten().to_numpy().reshape(-1, d) - b
                at = [np.zeros(0)] * batch.num_rows
                z = [np.zeros(0)] * batch.num_rows
                widest = max(len(held.value[1]) for held in blocks)
                for lo in range(0, len(x), max(1, CELLS // widest)):
                    part = x[lo : lo + max(1, CELLS // widest)]
                    for held in blocks:
                        first, weights = held.value
                        product = part @ weights.T
                        for i, row in enumerate(product):
                            on = np.flatnonzero(row > 0)
                            k = good[lo + i]
                            at[k], z[k] = np.concatenate([at[k], on + first]), np.concatenate([z[k], row[on]])
                bad = pa.array(np.asarray(batch["x"].is_null()))
                lists = [pa.ListArray.from_arrays(c.offsets, c.values, mask=bad) for c in (_listed(at, pa.int32()), _listed(z, pa.float64()))]
                yield pa.RecordBatch.from_arrays([batch[id_col], *lists], names=[id_col, "latents", "values"])

        return rows.mapInArrow(coded, schema)

    parts = [run(blocks).withColumn("__part", F.lit(i)) for i, blocks in enumerate(_passes(dictionary, d, block, most))]
    if not parts:
        none = lambda kind: F.when(F.col("x").isNotNull(), F.array().cast(kind))
        return rows.select(id_col, none("array<int>").alias("latents"), none("array<double>").alias("values"))
    if len(parts) == 1:
        return parts[0].drop("__part")
    # one row a pass and id, so a group is as small as the number of passes
    every = reduce(DataFrame.unionByName, parts).groupBy(id_col).agg(F.sort_array(F.collect_list(F.struct("__part", "latents", "values"))).alias("p"))
    return every.select(id_col, F.flatten(F.transform("p", lambda p: p["latents"])).alias("latents"), F.flatten(F.transform("p", lambda p: p["values"])).alias("values"))


def decoded(codes: DataFrame, id_col: str, dictionary: DataFrame, bias: Sequence[float], block: int = BLOCK, most: int = PASS) -> DataFrame:
    """(id, y): W'z + b of codes as ``encoded`` gives them; a null code has a null reconstruction, an empty one the bias."""
    d = len(bias)
    schema = StructType([codes.schema[id_col]]).add("y", ArrayType(DoubleType()))

    def run(blocks):
        def summed(batches):
            for batch in batches:
                y = np.zeros((batch.num_rows, d))
                for i, (at, z) in enumerate(zip(batch["latents"], batch["values"], strict=True)):
                    if not at.is_valid or not len(at):
                        continue
                    at, z = at.values.to_numpy(), z.values.to_numpy()
                    for held in blocks:
                        first, weights = held.value
                        lo, hi = np.searchsorted(at, [first, first + len(weights)])
                        y[i] += z[lo:hi] @ weights[at[lo:hi] - first]
                ends = pa.array(np.arange(batch.num_rows + 1, dtype=np.int32) * d, pa.int32())
                values = pa.ListArray.from_arrays(ends, pa.array(y.reshape(-1)), mask=pa.array(np.asarray(batch["latents"].is_null())))
                yield pa.RecordBatch.from_arrays([batch[id_col], values], names=[id_col, "y"])

        return codes.select(id_col, "latents", "values").mapInArrow(summed, schema)

    offset = F.array(*map(F.lit, map(float, bias)))
    parts = [run(blocks) for blocks in _passes(dictionary, d, block, most)]
    if not parts:
        return codes.select(id_col, F.when(F.col("latents").isNotNull(), offset).alias("y"))
    if len(parts) == 1:
        return parts[0].withColumn("y", F.zip_with("y", offset, lambda a, b: a + b))
    every = reduce(DataFrame.unionByName, parts).groupBy(id_col).agg(F.collect_list("y").alias("p"))
    total = F.aggregate("p", offset, lambda s, y: F.zip_with(s, y, lambda a, b: a + b))
    return every.select(id_col, F.when(F.size("p") > 0, total).alias("y"))


def sequence_features(df: DataFrame, seq: str, place: str, vector: str, dictionary: DataFrame, bias: Sequence[float], **sizes: int) -> tuple[DataFrame, DataFrame]:
    """Codes of all positions, by sequence: what a model's features say of each, and how well they give its vectors back.

    The first table has (seq, n, n_active, share, fidelity): positions, latents active at any, share of active entries, mean cosine of
    vector and reconstruction over the positions that have both. The second has (seq, latent, n, top, mean), the largest and the mean
    value of each active latent over the sequence's positions. A position without a code counts for nothing.
    """
    scratch = Scratch(df.sparkSession, "codes")
    rows = df.select(seq, F.struct(seq, place).alias("__id"), F.col(vector).cast("array<double>").alias("__x"))
    codes = scratch.write(encoded(rows, "__id", "__x", dictionary, bias, **sizes).where("latents is not null"), "codes")
    back = decoded(codes, "__id", dictionary, bias, **sizes)
    cosines = rows.join(back, "__id").groupBy(seq).agg(F.avg(vec.cosine(F.col("__x"), F.col("y"))).alias("fidelity"))
    width = dictionary.agg(F.max("latent") + 1).first()[0] or 0
    by_seq = codes.groupBy(F.col(f"__id.{seq}").alias(seq)).agg(F.count("*").alias("n"), F.sum(F.size("latents")).alias("on"))
    long = codes.select(F.col(f"__id.{seq}").alias(seq), F.explode(F.arrays_zip("latents", "values")).alias("e")).groupBy(seq, F.col("e.latents").alias("latent"))
    found = long.agg(F.count("*").alias("n"), F.max("e.values").alias("top"), F.sum("e.values").alias("total"))
    active = found.groupBy(seq).agg(F.count("*").alias("n_active"))
    features = found.join(by_seq.select(seq, F.col("n").alias("places")), seq).select(seq, "latent", "n", "top", (F.col("total") / F.col("places")).alias("mean"))
    share = F.try_divide(F.col("on").cast("double"), F.col("n") * F.lit(width))
    whole = by_seq.join(active, seq, "left").join(cosines, seq, "left")
    return whole.select(seq, "n", F.coalesce("n_active", F.lit(0)).alias("n_active"), share.alias("share"), "fidelity"), features
