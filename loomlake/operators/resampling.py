"""Bootstraps over groups and null distributions, with draws that any engine can repeat.

A draw is decided by md5 of (seed, draw, place), not by a generator's state, so results depend on no partitioning.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Sequence
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from loomlake.operators.metrics import ranking
from loomlake.operators.ordering import placed, placed_within
from loomlake.scratch import Scratch


def hash_number(*parts: Column | str) -> Column:
    """A 52-bit number from the md5 of parts joined by a bar."""
    return F.conv(F.substring(F.md5(F.concat_ws("|", *(F.col(p).cast("string") if isinstance(p, str) else p.cast("string") for p in parts))), 1, 13), 16, 10).cast("bigint")


#: Groups of a block, and places whose draws are decided at once: both only bound the memory of a task.
BLOCK, AT_ONCE = 2048, 256


def _numbered(groups: DataFrame, group: str, strata: str | None) -> DataFrame:
    """(group, stratum, place, first, n): groups numbered by ranges over the cluster, from 0 within ``strata``, with the stratum's first number and its size."""
    part = [strata] if strata else []
    rows = placed(groups.select(group, *part).distinct(), [*part, group], "__i")
    sizes = rows.groupBy(*part).agg(F.count("*").alias("n"), F.min("__i").alias("first"))
    rows = rows.join(sizes, part) if part else rows.crossJoin(F.broadcast(sizes))  # one row
    stratum = F.col(strata).cast("string") if strata else F.lit(None).cast("string")
    return rows.select(F.col(group).alias("group"), stratum.alias("stratum"), (F.col("__i") - F.col("first")).alias("place"), "first", "n")


def _drawn(numbered: DataFrame, draws: int, seed: str) -> DataFrame:
    """(block, codes): what each place draws, draw * BLOCK + the group's number in its block, as many numbers of 4 bytes in a row as a few places bring to a block."""

    def run(batches):
        for batch in batches:
            for at in range(0, len(batch), AT_ONCE):
                some = batch.iloc[at : at + AT_ONCE]
                for (stratum, first, n), rows in some.groupby(["stratum", "first", "n"], dropna=False):
                    places = [b"|%d" % p for p in rows["place"]]
                    head = seed if pd.isna(stratum) else f"{seed}|{stratum}"
                    raw = b"".join(hashlib.md5(h + p).digest() for h in (f"{head}|{draw}".encode() for draw in range(draws)) for p in places)
                    drawn = (np.frombuffer(raw, ">u8")[::2].astype(np.uint64) >> np.uint64(12)).astype(np.int64) % int(n) + int(first)
                    block = drawn // BLOCK
                    codes = (np.repeat(np.arange(draws), len(places)) * BLOCK + drawn % BLOCK).astype(np.int32)
                    order = np.argsort(block, kind="stable")
                    named, starts = np.unique(block[order], return_index=True)
                    yield pd.DataFrame({"block": named, "codes": [c.tobytes() for c in np.split(codes[order], starts[1:])]})

    # few bytes that are much work: dealt by rows, as sizes in bytes would bring them to one task
    dealt = numbered.select("stratum", "place", "first", "n").repartition(numbered.sparkSession.sparkContext.defaultParallelism * 4)
    return dealt.mapInPandas(run, "block long, codes binary")


def bootstraps(df: DataFrame, group: str, draws: int, seed: str, y: str, scores: Sequence[str], strata: str | None = None) -> DataFrame:
    """(draw, which, auc, ap, n_pos, n_neg): each draw of as many whole groups as there are, with replacement, within ``strata`` if given, for each of ``scores``; draws with one class only are left out.

    All scores share the draws. A place's draws go to the blocks of the groups that they name, four bytes each, and meet their rows there; what leaves a block are
    sums by draw, class and score. Rows of a group that agree in class and score are one, with their number; a block holds all rows of its groups.
    """
    numbered = Scratch(df.sparkSession, "draws").write(_numbered(df, group, strata), "numbered")
    here = numbered.select("group", F.expr(f"(first + place) div {BLOCK}").alias("block"), F.expr(f"(first + place) % {BLOCK}").cast("int").alias("own"))
    kind = F.when(F.col(y) == 1, 1).when(F.col(y) == 0, 0)
    rows = []
    for which, score in enumerate(scores):
        summed = df.groupBy(F.col(group).alias("group"), kind.alias("y"), F.col(score).alias("score")).agg(F.count("*").alias("w")).where("y is not null")
        levels = placed(summed.select("score").distinct(), ["score"], "level").withColumnRenamed("score", "__score")
        rows.append(summed.join(levels, F.col("score").eqNullSafe(F.col("__score"))).join(here, "group").select("block", "own", F.lit(which).alias("which"), "y", "level", "w"))

    def weigh(drawn: pd.DataFrame, rows: pd.DataFrame) -> pd.DataFrame:
        by = ["which", "y", "level"]
        rows = rows.sort_values(by)
        starts = np.flatnonzero(~rows.duplicated(by).to_numpy())
        out = []
        if len(rows) and len(drawn):
            times = np.zeros(draws * BLOCK, np.int32)
            for codes in drawn["codes"]:
                np.add.at(times, np.frombuffer(codes, np.int32), 1)
            times = times.reshape(draws, BLOCK)
            own, w, keys = rows["own"].to_numpy(), rows["w"].to_numpy(), rows[by].iloc[starts].reset_index(drop=True)
            for at in range(0, draws, AT_ONCE):
                sums = np.add.reduceat(times[at : at + AT_ONCE][:, own] * w, starts, axis=1)
                draw, key = np.nonzero(sums)
                out.append(keys.iloc[key].assign(draw=draw + at, w=sums[draw, key]))
        return pd.concat(out) if out else pd.DataFrame({c: [] for c in ("draw", *by, "w")})

    met = _drawn(numbered, draws, seed).groupBy("block").cogroup(reduce(DataFrame.union, rows).groupBy("block"))
    weighed = met.applyInPandas(weigh, "draw int, which int, y int, level long, w long")
    return ranking(weighed, ["draw", "which"], "y", "level", "w").where("auc is not null")


def bootstrap(df: DataFrame, group: str, draws: int, seed: str = "boot", y: str = "y", score: str = "score", strata: str | None = None) -> DataFrame:
    """auc and ap of each draw of whole groups; draws with one class only are left out."""
    return bootstraps(df, group, draws, seed, y, [score], strata).drop("which")


#: Values of a component that a task ranks at once, vectors that are packed at once, and draws that are counted at once.
RANKED, PACKED, COUNTED = 1 << 16, 4096, 32
#: The place of null, below all numbers.
_NULL = np.iinfo(np.int64).min


def _sortable(values: Sequence[float]) -> np.ndarray:
    """Whole numbers above ``_NULL`` in the order that Spark gives values: numbers, NaN; 0 and -0 are equal."""
    given = np.array(values, float) + 0.0
    raw = given.view(np.int64)
    out = np.where(raw < 0, _NULL - raw - 1, raw)
    out[np.isnan(given)] = np.iinfo(np.int64).max
    return out


def half_areas(df: DataFrame, id_col: str, vector: str, y: str, draws: int, seed: str = "half", ranked: int = RANKED) -> DataFrame:
    """(draw, latent, auc): the area of each component of the vectors over half of the rows, by the parity of ``hash_number(seed, draw, id)``, and as draw ``draws`` over all rows; areas without both classes are left out.

    A value travels once, with a bit for each draw, to a range of its component's values, and is ranked there; what leaves a range are counts and wins by draw.
    Bounds of the ranges come from some of the rows and decide the sizes of tasks only. Equal values share a range.
    """
    size = -(-(draws + 1) // 8)
    kind = F.when(F.col(y) == 1, 1).when(F.col(y) == 0, 0)
    rows = df.select(kind.alias("y"), F.col(id_col).cast("string").alias("id"), F.col(vector).cast("array<double>").alias("v")).where("y is not null and v is not null")
    # a task reads null components as NaN, so it is told which they are
    rows = rows.withColumn("gaps", F.when(F.exists("v", F.isnull), F.transform("v", F.isnull)))
    ranges, bounds = -(-rows.count() // ranked), {}
    if ranges > 1:
        some = rows.where(F.pmod(F.xxhash64("id"), F.lit(max(1, ranges * ranked // 50000))) == 0).select(F.posexplode("v").alias("latent", "x"))
        cuts = some.groupBy("latent").agg(F.percentile_approx("x", [i / ranges for i in range(1, ranges)], 10000).alias("cuts"))
        bounds = {r["latent"]: _sortable(r["cuts"]) for r in cuts.where("cuts is not null").collect()}  # one short list a component

    def pack(batches):
        for batch in batches:
            for at in range(0, len(batch), PACKED):
                some = batch.iloc[at : at + PACKED]
                raw = b"".join(hashlib.md5(f"{seed}|{draw}{'' if i is None else f'|{i}'}".encode()).digest()[6:7] for i in some["id"] for draw in range(draws))
                odd = np.frombuffer(raw, np.uint8).reshape(len(some), draws) >> 4 & 1
                bits = np.packbits(np.hstack([odd == 0, np.ones((len(some), 1), bool)]), axis=1)
                ys, vectors, gaps, out = some["y"].to_numpy(np.uint8), list(some["v"]), list(some["gaps"]), []
                for latent in range(max(map(len, vectors), default=0)):
                    have = np.array([i for i, v in enumerate(vectors) if len(v) > latent])
                    keys = _sortable([vectors[i][latent] for i in have])
                    keys[[gaps[i] is not None and gaps[i][latent] for i in have]] = _NULL
                    part = np.searchsorted(bounds[latent], keys, side="right") if latent in bounds else np.zeros(len(keys), int)
                    for p in np.unique(part):
                        own = part == p
                        out.append((latent, int(p), keys[own].tobytes(), ys[have[own]].tobytes(), bits[have[own]].tobytes()))
                yield pd.DataFrame(out, columns=["latent", "part", "keys", "ys", "bits"])

    def rank(group: pd.DataFrame) -> pd.DataFrame:
        keys, ys = np.frombuffer(b"".join(group["keys"]), np.int64), np.frombuffer(b"".join(group["ys"]), np.uint8)
        bits = np.frombuffer(b"".join(group["bits"]), np.uint8).reshape(len(keys), size)
        order = np.argsort(keys, kind="stable")
        keys, ys, bits, out = keys[order], ys[order], bits[order], []
        starts = np.flatnonzero(np.concatenate(([True], keys[1:] != keys[:-1])))
        for at in range(0, size * 8, COUNTED):
            taken = np.unpackbits(bits[:, at // 8 : (at + COUNTED) // 8], axis=1).astype(np.int64)
            p, n = (np.add.reduceat(taken * (ys == k)[:, None], starts, axis=0) for k in (1, 0))
            wins = (p * (2 * (np.cumsum(n, axis=0) - n) + n)).sum(axis=0)
            out.append(pd.DataFrame({"draw": at + np.arange(len(wins)), "p": p.sum(axis=0), "n": n.sum(axis=0), "w": wins}))
        every = pd.concat(out)
        every = every[every["draw"] <= draws]
        return every.assign(latent=int(group["latent"].iloc[0]), part=int(group["part"].iloc[0]))[["draw", "latent", "part", "p", "n", "w"]]

    packed = rows.mapInPandas(pack, "latent int, part int, keys binary, ys binary, bits binary")
    counted = packed.groupBy("latent", "part").applyInPandas(rank, "draw int, latent int, part int, p long, n long, w long")
    lower = Window.partitionBy("draw", "latent").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    wins = F.sum(F.col("w") + 2 * F.col("p") * F.col("lower"))
    one = counted.withColumn("lower", F.coalesce(F.sum("n").over(lower), F.lit(0))).groupBy("draw", "latent").agg(wins.alias("w"), F.sum("p").alias("p"), F.sum("n").alias("n"))
    return one.select("draw", "latent", F.try_divide(F.col("w").cast("double"), 2 * F.col("p") * F.col("n")).alias("auc")).where("auc is not null")


def interval(draws: DataFrame, value: str, level: float = 0.95) -> DataFrame:
    tail = (1 - level) / 2
    return draws.agg(F.count("*").alias("n"), F.percentile(value, tail).alias("low"), F.percentile(value, 0.5).alias("middle"), F.percentile(value, 1 - tail).alias("high"))


def permutation_floor(n_pos: int, n_neg: int, draws: DataFrame, seed: str = "null") -> DataFrame:
    """(draw, ap): average precision of random rankings, one row a draw. draws: (draw). Without positives or negatives no row.

    A ranking is decided by md5 of (seed, draw) alone, and a task holds one at a time.
    """

    def run(batches):
        for batch in batches:
            ap = []
            for draw in batch["draw"]:
                places = np.sort(generator(seed, draw).choice(n_pos + n_neg, n_pos, replace=False)) + 1
                ap.append(float(np.mean(np.arange(1, n_pos + 1) / places)))
            yield pd.DataFrame({"draw": batch["draw"], "ap": ap})

    some = draws.select(F.col("draw").cast("bigint").alias("draw"))
    return (some if n_pos and n_neg else some.where("false")).mapInPandas(run, "draw long, ap double")


def generator(*parts: object) -> np.random.Generator:
    """A generator that the md5 of parts joined by a bar decides."""
    return np.random.Generator(np.random.Philox(key=int(hashlib.md5("|".join(map(str, parts)).encode()).hexdigest(), 16)))


class Generators:
    """Gives what ``generator`` gives, by setting one generator's state, which costs less than a new one; each is used before the next is asked for."""

    def __init__(self) -> None:
        self.bits = np.random.Philox(key=0)
        self.state, self.one = self.bits.state, np.random.Generator(self.bits)

    def __call__(self, *parts: object) -> np.random.Generator:
        digest = hashlib.md5("|".join(map(str, parts)).encode()).digest()
        self.state["state"]["key"] = np.frombuffer(digest, ">u8")[::-1].astype(np.uint64)
        self.bits.state = self.state
        return self.one


def shuffled_hits(df: DataFrame, id_col: str, seq: str, motif: str, draws: int, carry: Sequence[str] = (), seed: str = "shuffle") -> DataFrame:
    """(carry, observed, hits, draws): whether each whole sequence has the motif, and in how many shuffles of its letters.

    Sequences are ASCII; each shuffle is decided by md5 of (seed, id, draw), and a task holds one at a time.
    """
    rule = re.compile(motif.encode())

    def run(batches):
        drawn = Generators()
        for batch in batches:
            hits, observed = [], []
            for key, text in zip(batch[id_col], batch[seq], strict=True):
                raw = text.encode()
                # numpy swaps words faster than bytes, and in the same order
                letters = np.frombuffer(raw, np.uint8).astype(np.intp)
                observed.append(rule.search(raw) is not None)
                hits.append(sum(rule.search(drawn(seed, key, draw).permutation(letters).astype(np.uint8).tobytes()) is not None for draw in range(draws)))
            yield batch[list(carry)].assign(observed=observed, hits=hits, draws=draws)

    rows = df.select(F.col(id_col), *carry, F.col(seq))
    kinds = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in df.select(*carry).schema)
    return rows.mapInPandas(run, f"{kinds}, observed boolean, hits long, draws long")


#: Numbers that a task sorts at once, on average, and sequences that meet what they are given at once.
SORTED, MET = 1 << 16, 512


def paired_hits(df: DataFrame, id_col: str, stratum: str, seq: str, at: str, off: int, letters: str, draws: int, seed: str, sorted_: int = SORTED, met: int = MET) -> DataFrame:
    """(draw, stratum, n, hits): sequences that have one of ``letters`` at ``off`` from the place that another row of the stratum has in ``at``, by random permutations.

    The row of place i by id gets what the row of place i by ``hash_number(seed, draw, id)`` has, ids on ties. Hashes are dealt by their first bits, so a task sorts a
    part of a stratum in one draw; a row's hash, place and ``at`` take 20 bytes for each draw, and 4 on their way to a few sequences. Sequences are ASCII and travel once.
    Rows without a stratum take no part.
    """
    scratch = Scratch(df.sparkSession, "pairing")
    rows = scratch.write(df.select(F.col(id_col).alias("id"), F.col(stratum).alias("lang"), F.col(seq).alias("seq"), F.col(at).cast("int").alias("peak")).where("lang is not null"), "rows")
    own = scratch.write(placed_within(rows.select("id", "lang", "peak"), ["lang"], ["id"], "i"), "own")
    sized = own.join(own.groupBy("lang").agg(F.count("*").alias("n")), "lang").select("lang", F.col("id").cast("string").alias("name"), "peak", "i", "n")

    def deal(batches):
        for batch in batches:
            for at in range(0, len(batch), PACKED):
                for (lang, n), some in batch.iloc[at : at + PACKED].groupby(["lang", "n"]):
                    names = [b"" if name is None else f"|{name}".encode() for name in some["name"]]
                    i, peak, bits = some["i"].to_numpy(np.int64), some["peak"].to_numpy(np.int32), (-(-int(n) // sorted_) - 1).bit_length()
                    out = []
                    for draw in range(draws):
                        head = f"{seed}|{draw}".encode()
                        h = (np.frombuffer(b"".join(hashlib.md5(head + name).digest() for name in names), ">u8")[::2].astype(np.uint64) >> np.uint64(12)).astype(np.int64)
                        part = h >> (52 - bits)
                        for p in np.unique(part):
                            own = part == p
                            out.append((lang, draw, int(p), h[own].tobytes(), i[own].tobytes(), peak[own].tobytes()))
                    yield pd.DataFrame(out, columns=["lang", "draw", "part", "h", "i", "peak"])

    def order(group: pd.DataFrame) -> pd.DataFrame:
        h, i, peak = (np.frombuffer(b"".join(group[c]), kind) for c, kind in (("h", np.int64), ("i", np.int64), ("peak", np.int32)))
        return group[["lang", "draw", "part"]].head(1).assign(n=len(h), peaks=[peak[np.lexsort((i, h))].tobytes()])

    def cut(batches):
        for batch in batches:
            out = []
            for lang, draw, first, peaks in zip(*(batch[c] for c in ("lang", "draw", "first", "peaks")), strict=True):
                every, stop = np.frombuffer(peaks, np.int32), first
                while stop < first + len(every):
                    start, stop = stop, min(first + len(every), (stop // met + 1) * met)
                    out.append((lang, start // met, draw, start % met, every[start - first : stop - first].tobytes()))
            yield pd.DataFrame(out, columns=["lang", "block", "draw", "start", "peaks"])

    wanted = np.isin(np.arange(256), list(letters.encode()))

    def meet(given: pd.DataFrame, rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values("i")
        raw = [s.encode() for s in rows["seq"]]
        size, text = np.array([len(s) for s in raw], np.int64), np.frombuffer(b"".join(raw), np.uint8)
        begin, hits, n = np.cumsum(size) - size, np.zeros(draws, np.int64), np.zeros(draws, np.int64)
        for draw, start, peaks in zip(given["draw"], given["start"], given["peaks"], strict=True):
            place = np.frombuffer(peaks, np.int32).astype(np.int64) + off
            here = slice(start, start + len(place))
            fits = (place >= 0) & (place < size[here])
            hits[draw] += wanted[text[(begin[here] + place)[fits]]].sum()
            n[draw] += len(place)
        return pd.DataFrame({"draw": np.arange(draws), "lang": rows["lang"].iloc[0], "n": n, "hits": hits})

    kind = rows.schema["lang"].dataType.simpleString()
    dealt = sized.repartition(df.sparkSession.sparkContext.defaultParallelism * 4).mapInPandas(deal, f"lang {kind}, draw int, part long, h binary, i binary, peak binary")
    ordered = scratch.write(dealt.groupBy("lang", "draw", "part").applyInPandas(order, f"lang {kind}, draw int, part long, n long, peaks binary"), "ordered")
    before = F.sum("n").over(Window.partitionBy("lang", "draw").orderBy("part").rowsBetween(Window.unboundedPreceding, -1))
    first = ordered.select("lang", "draw", "part", F.coalesce(before, F.lit(0)).alias("first"))
    blocks = ordered.join(first, ["lang", "draw", "part"]).select("lang", "draw", "first", "peaks").mapInPandas(cut, f"lang {kind}, block long, draw int, start long, peaks binary")
    texts = rows.join(own.select("id", "i"), "id").select("lang", F.expr(f"(i - 1) div {met}").alias("block"), "i", "seq")
    one = blocks.groupBy("lang", "block").cogroup(texts.groupBy("lang", "block")).applyInPandas(meet, f"draw int, lang {kind}, n long, hits long")
    return one.groupBy("draw", "lang").agg(F.sum("n").alias("n"), F.sum("hits").alias("hits")).withColumnRenamed("lang", stratum)
