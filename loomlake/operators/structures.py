"""Matching sequences to the chains of a structure."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from loomlake.operators.skew import spread
from loomlake.scratch import Scratch

#: Sites that a grid cell of the first width may hold, and how often the width is quartered to get there.
CROWD = 16
NARROWINGS = 16


def best_chain(rows: DataFrame, id_col: str, chain_col: str, index_col: str, number_col: str, match: Column) -> DataFrame:
    """For each id the chain with the most matches, of several the one that comes first by index.

    ``rows`` has one row an aligned residue: its index in the sequence and its number in the structure. Returns ``id_col``,
    ``chain_col``, n_matched, coverage (matches of the chain's residues) and numbers (index to number of the matches).
    A null match counts as none; an id without any keeps its first chain, with coverage 0 and an empty map. An index that
    repeats in a chain is one residue, matched if any of its rows is, and has the smallest number of those.
    """
    once = rows.groupBy(id_col, chain_col, index_col).agg(F.min(F.when(match, F.col(number_col))).alias("number"), F.coalesce(F.bool_or(match), F.lit(False)).alias("matched"))
    pair = F.when(F.col("matched"), F.struct(F.col(index_col).alias("key"), F.col("number").alias("value")))
    chains = once.groupBy(id_col, chain_col).agg(F.count_if("matched").alias("n_matched"), F.count("*").alias("length"), F.min(index_col).alias("first"), F.sort_array(F.collect_list(pair)).alias("pairs"))
    best = Window.partitionBy(id_col).orderBy(F.desc("n_matched"), "first", chain_col)
    chosen = chains.withColumn("place", F.row_number().over(best)).where("place = 1")
    return chosen.select(id_col, chain_col, "n_matched", (F.col("n_matched") / F.col("length")).alias("coverage"), F.map_from_entries("pairs").alias("numbers"))


def nearest_place(points: DataFrame, sites: DataFrame, by: str, id_col: str, size: float = 8.0) -> DataFrame:
    """(by, id, site, d3): for each point the nearest site of the same ``by`` (a structure) in space, of several as near the smallest id.

    Both tables have ``by``, ``id_col`` and x, y, z; a site's id comes back as ``site``. Points meet the sites of their grid cell and the 26
    around it by an equality join, so what lies within one cell's width is found; the rest go on with cells of twice the width, until
    every point has its site. Sites at one place are one, under their smallest id. A point with a null coordinate, or without a site
    in its structure, has null for both; points of one id at several places are told apart by their coordinates and equal rows stay.
    The first width is ``size``, narrowed until no cell holds more than ``CROWD`` sites, so crowded places are settled among few; each round
    costs the places that are left times the sites around them, and only lone places come to cells that hold many.
    """
    scratch, axes = Scratch(points.sparkSession, "nearest"), ("x", "y", "z")
    known_at = reduce(lambda a, b: a & b, (F.col(a).isNotNull() & ~F.isnan(a) & (F.abs(F.col(a)) < 1e12) for a in axes))
    cell = lambda width: [F.floor(F.col(a) / width) for a in axes]
    around = F.explode(F.array(*[F.struct(*[F.lit(v).alias(n) for n, v in zip("ijk", (i, j, k), strict=True)]) for i in (-1, 0, 1) for j in (-1, 0, 1) for k in (-1, 0, 1)]))
    once = scratch.write(sites.where(F.col(by).isNotNull() & known_at).groupBy(by, *axes).agg(F.min(id_col).alias("site")), "sites")
    whole = F.col(by).isNotNull() & known_at
    every = scratch.write(points.select(by, id_col, *axes).withColumns({"__row": F.monotonically_increasing_id(), "__at": F.when(whole, F.struct(by, *axes))}), "points")
    # points at one place have one answer, so each place asks once
    places = scratch.write(every.where("__at is not null").select("__at").distinct().withColumn("__place", F.monotonically_increasing_id()), "places")
    left = places.select("__place", "__at.*").join(once.select(by).distinct(), by, "left_semi")
    found, width = [], size
    for _ in range(NARROWINGS):
        if (once.groupBy(by, *cell(width)).count().agg(F.max("count")).first()[0] or 0) <= CROWD:
            break
        width /= 4
    while True:
        held = once.select(by, "site", *(F.col(a).alias(f"s{a}") for a in axes), F.struct(*cell(width)).alias("c"))
        keyed = held.select(F.struct(by, "c").alias("__key"), "site", "sx", "sy", "sz")
        asked = left.withColumn("o", around).withColumn("__key", F.struct(F.col(by), F.struct(*[v + F.col(f"o.{n}") for n, v in zip("ijk", cell(width), strict=True)]).alias("c")))
        pairs = spread(asked.select("__key", "__place", *axes), keyed, "__key", "__place")
        square = reduce(lambda a, b: a + b, ((F.col(a) - F.col(f"s{a}")) * (F.col(a) - F.col(f"s{a}")) for a in axes))
        best = pairs.withColumn("d3", F.sqrt(square)).where(F.col("d3") <= width).groupBy("__place").agg(F.min(F.struct("d3", "site")).alias("m"))
        found.append(scratch.write(best.select("__place", "m.site", "m.d3"), "found"))
        left = scratch.write(left.join(found[-1], "__place", "left_anti"), "left")
        if left.isEmpty():
            break
        width *= 2
    answers = places.join(reduce(DataFrame.unionByName, found), "__place", "left").select("__at", "site", "d3")
    told = spread(every.where("__at is not null"), answers, "__at", "__row").select(by, id_col, "site", "d3")
    return told.unionByName(every.where("__at is null").select(by, id_col), allowMissingColumns=True)
