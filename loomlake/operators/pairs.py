"""Similar pairs, their use for labels and splits, and best hits."""

from __future__ import annotations

import math
from collections.abc import Callable, Iterable, Iterator
from functools import reduce
from hashlib import blake2b

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, LongType, StructField, StructType

from loomlake.scratch import Scratch


def shingles(df: DataFrame, id_col: str, text: str, k: int = 5) -> DataFrame:
    """(id, s): distinct k-word shingles."""
    words = F.filter(F.split(F.lower(F.col(text)), r"[^a-z]+"), lambda w: w != "")
    many = F.transform(F.sequence(F.lit(1), F.size("w") - k + 1), lambda i: F.array_join(F.slice(F.col("w"), i, k), " "))
    grams = F.when(F.size("w") >= k, many).otherwise(F.array().cast("array<string>"))
    return df.select(F.col(id_col).alias("id"), words.alias("w")).select("id", F.explode(F.array_distinct(grams)).alias("s"))


def classes(items: DataFrame) -> DataFrame:
    """(id, representative): items of equal sets of shingles have the smallest of their ids."""
    prints = items.groupBy("id").agg(F.md5(F.array_join(F.sort_array(F.collect_list("s")), "\n")).alias("print"))
    return prints.join(prints.groupBy("print").agg(F.min("id").alias("representative")), "print").select("id", "representative")


def shingle_sets(df: DataFrame, id_col: str, text: str, k: int = 5) -> DataFrame:
    """(id, h): the distinct k-word shingles of each row as 64-bit hashes of their words, sorted, in one array; rows without any are left out."""
    rows = df.select(F.col(id_col).alias("id"), F.lower(F.col(text)).alias("t")).where("t is not null")
    return rows.mapInArrow(lambda batches: _hashed(batches, k), StructType([rows.schema["id"], StructField("h", ArrayType(LongType()))]))


def _mixed(x: np.ndarray) -> np.ndarray:
    """Numbers of 64 bits, mixed one to one."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _digest(data: bytes) -> int:
    return int.from_bytes(blake2b(data, digest_size=8).digest(), "little", signed=True)


def _hashed(batches: Iterable[pa.RecordBatch], k: int, rows: int = 256) -> Iterator[pa.RecordBatch]:
    """Shingles of lower-case texts, a few rows at a time. A word is a run of the bytes a to z, named by the hash of its letters."""
    for part in (batch.slice(i, rows) for batch in batches for i in range(0, batch.num_rows, rows)):
        texts = part.column(1).cast(pa.large_binary())
        at = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + len(texts) + 1]
        if at[-1] == at[0]:
            continue
        data, at = np.frombuffer(texts.buffers()[2], np.uint8)[at[0] : at[-1]], at - at[0]
        letter = data - np.uint8(97) < 26
        first = letter.copy()
        first[1:] &= ~letter[:-1]
        edges = at[:-1][at[:-1] < len(data)]
        first[edges] = letter[edges]
        start = np.flatnonzero(first)
        if len(start) < k:
            continue
        ends = np.append(np.cumsum(letter)[start] - 1, np.count_nonzero(letter))
        words = pa.Array.from_buffers(pa.large_binary(), len(start), [None, pa.py_buffer(ends.astype(np.int64)), pa.py_buffer(data[letter])]).dictionary_encode()
        names = np.array([_digest(w) for w in words.dictionary.to_pylist()], np.int64).view(np.uint64)[words.indices.to_numpy()]
        row, many = np.searchsorted(at, start, "right") - 1, len(start) - k + 1
        h = np.zeros(many, np.uint64)
        for j in range(k):
            h = _mixed(h ^ names[j : many + j])
        inside = row[:many] == row[k - 1 :]
        h, row = h[inside].view(np.int64), row[:many][inside]
        order = np.lexsort((h, row))
        h, row = h[order], row[order]
        new = np.ones(len(h), bool)
        new[1:] = (h[1:] != h[:-1]) | (row[1:] != row[:-1])
        h, sizes = h[new], np.bincount(row[new], minlength=len(texts))
        held = np.flatnonzero(sizes)
        lists = pa.ListArray.from_arrays(pa.array(np.append(0, np.cumsum(sizes[held])), pa.int32()), pa.array(h))
        yield pa.RecordBatch.from_arrays([part.column(0).take(pa.array(held)), lists], ["id", "h"])


def _sets(batches: Iterable[pa.RecordBatch]) -> Iterator[tuple[pa.RecordBatch, list[np.ndarray], list[int]]]:
    """Batches of (id, h) with each set sorted and its hash."""
    for batch in batches:
        h = batch.column(1)
        flat, at = h.flatten().to_numpy(zero_copy_only=False).astype(np.int64), np.append(0, np.cumsum(h.value_lengths().to_numpy(zero_copy_only=False)))
        sets = [np.sort(flat[i:j]) for i, j in zip(at[:-1], at[1:], strict=True)]
        yield batch, sets, [_digest(s.tobytes()) for s in sets]


def _keys(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(id, n, c): the size and the hash of each set."""
    for batch, sets, c in _sets(batches):
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([len(s) for s in sets], pa.int64()), pa.array(c, pa.int64())], ["id", "n", "c"])


def _slice(batches: Iterable[pa.RecordBatch], i: int, slices: int) -> Iterator[pa.RecordBatch]:
    """(c, s): the members of each different set of a task, of slice i of all hashes."""
    seen: set[int] = set()
    for _, sets, c in _sets(batches):
        fresh = [k for k, x in enumerate(c) if x not in seen and not seen.add(x)]
        some = [s[s.view(np.uint64) % np.uint64(slices) == i] for s in (sets[k] for k in fresh)]
        if some:
            keys = np.repeat(np.array([c[k] for k in fresh], np.int64), [len(s) for s in some])
            yield pa.RecordBatch.from_arrays([pa.array(keys), pa.array(np.concatenate(some))], ["c", "s"])


def similar_classes(
    sets: DataFrame, floor: float, scratch: Scratch, slices: int = 4, fold: Callable[[DataFrame, DataFrame], DataFrame] | None = None, meetings: float = 0.25, sent: float = 0.5
) -> tuple[DataFrame, DataFrame]:
    """(members, pairs): (id, representative) of every set, and (a, b, jaccard, common, na, nb), a < b, of representatives at ``floor`` or more; every such pair is found.

    sets: (id, h) of ``shingle_sets``; sets are told by these hashes. Equal ones are one class. Two sets of similarity t share one of the n - ceil(t n) + 1
    rarest shingles of each, so candidates meet on those alone, and are then compared whole. A shingle that one set only has comes before all others and
    meets nothing: it is counted, and ends where it is found to be the only one.

    To hold little on disk at once, sets are not written but read anew for each slice of the hashes, whose shuffle is gone before the next one's. Candidates
    are found for a part of the ids at a time, in as many turns as keep the meetings of a turn at ``meetings`` times the number of all sets' members; a
    turn's candidates are compared on their shared shingles, in as many rounds as keep what a round sends at ``sent`` times that number, and then deleted. So disk
    does not grow with the number of candidates, which may grow with the square of the input; what is kept of the pairs does, unless ``fold`` makes less of them:
    it gets members and the pairs of one round, and what it returns is held and returned in their place.
    """
    every = scratch.write(sets.mapInArrow(_keys, StructType([sets.schema["id"], StructField("n", LongType()), StructField("c", LongType())])), "keys")
    one = every.groupBy("c").agg(F.min("id").alias("id"), F.min("n").alias("n"))
    named = scratch.write(every.join(one.select("c", F.col("id").alias("representative")), "c").select("id", "representative"), "classes")
    parts = []
    for i in range(slices):
        members = sets.mapInArrow(lambda batches, i=i: _slice(batches, i, slices), "c long, s long").repartition("s").dropDuplicates(["s", "c"])
        parts.append(scratch.write(members.withColumn("df", F.count("*").over(Window.partitionBy("s"))).where("df > 1"), "shared"))
    shared, groups = reduce(DataFrame.union, parts), []
    for i in range(slices):
        ranked = shared.where(F.pmod("c", F.lit(slices)) == i).groupBy("c").agg(F.sort_array(F.collect_list(F.struct("df", "s"))).alias("e"))
        groups.append(scratch.write(ranked.join(one, "c").select("id", "n", F.col("e.s").alias("h")), "held"))
    held = reduce(DataFrame.union, groups)
    scratch.drop(*parts)
    place = F.size("h") - F.ceil(F.lit(floor) * F.col("n") - 1e-9) + 1
    rare = held.withColumn("m", F.size("h")).withColumn("p", place.cast("int")).where("p > 0").select("id", "n", "m", F.explode(F.slice("h", F.lit(1), F.col("p"))).alias("s"))
    met = rare.groupBy("s").agg(F.count("*").cast("double").alias("k")).agg(F.sum(F.col("k") * (F.col("k") - 1) / 2))
    met, total = scratch.write(met.toDF("met"), "met"), every.agg(F.sum("n")).first()[0] or 1
    turns = max(1, math.ceil((met.first()[0] or 0) / (meetings * total)))
    a, b = (rare.select(F.col("id").alias(c), F.col("n").alias(f"n{c}"), F.col("m").alias(f"m{c}"), "s") for c in "ab")
    # a set that is too small for another one is not as similar, whatever they share
    alike = (F.col("a") < F.col("b")) & (F.least("na", "nb") >= F.lit(floor) * F.greatest("na", "nb") - 1e-9)
    # of a pair, the set with fewer shared shingles is sent to the other one
    less = F.col("ma") <= F.col("mb")
    ends = [F.when(less, F.col("a")).otherwise(F.col("b")).alias("u"), F.when(less, F.col("b")).otherwise(F.col("a")).alias("v")]
    # both sides have the same columns, so one shuffle serves them
    x, y = (held.select(F.col("id").alias(c), F.col("h").alias(f"h{c}"), F.col("n").alias(f"n{c}")) for c in "uv")
    forth, found = F.col("u") < F.col("v"), []
    order = [F.least("u", "v").alias("a"), F.greatest("u", "v").alias("b"), "jaccard", "common", F.when(forth, F.col("nu")).otherwise(F.col("nv")).alias("na"), F.when(forth, F.col("nv")).otherwise(F.col("nu")).alias("nb")]
    for t in range(turns):
        some = a if turns == 1 else a.where(F.pmod(F.xxhash64("a"), F.lit(turns)) == t)
        likely = scratch.write(some.join(b, "s").where(alike).select(*ends, F.least("ma", "mb").alias("m")).distinct(), "likely")
        rounds = math.ceil((likely.agg(F.sum("m")).first()[0] or 0) / (sent * total))
        for i in range(rounds):
            both = likely.where(F.pmod(F.xxhash64("u", "v"), F.lit(rounds)) == i).select("u", "v").join(x, "u").join(y, "v")
            both = both.withColumn("common", F.size(F.array_intersect("hu", "hv")).cast("bigint"))
            scored = both.withColumn("jaccard", F.col("common").cast("double") / (F.col("nu") + F.col("nv") - F.col("common"))).where(F.col("jaccard") >= floor)
            out = scratch.write(scored.select(*order), "found")
            if fold:
                whole, out = out, scratch.write(fold(named, out), "folded")
                scratch.drop(whole)
            found.append(out)
        scratch.drop(likely)
    none = held.select(*(F.col(c).alias(d) for c, d in (("id", "a"), ("id", "b"), ("n", "common"), ("n", "na"), ("n", "nb")))).where("false")
    none = none.select("a", "b", F.lit(0.0).alias("jaccard"), "common", "na", "nb")
    out = scratch.write(reduce(DataFrame.union, found) if found else fold(named, none) if fold else none, "pairs")
    scratch.drop(every, met, *groups, *found)
    return named, out


def similar_pairs(items: DataFrame, floor: float = 0.15, expand: bool = True) -> DataFrame:
    """(a, b, jaccard) with a < b over (id, s) rows, at ``floor`` or more; every such pair is found.

    As ``similar_classes``, which compares classes of equal sets; without ``expand`` pairs are those of their representatives, whose number a family of
    copies does not raise.
    """
    scratch = Scratch(items.sparkSession, "pairs")
    sets = scratch.write(items.groupBy("id").agg(F.collect_set(F.xxhash64("s")).alias("h")), "sets")
    named, out = similar_classes(sets, floor, scratch)
    scratch.drop(sets)
    return expanded(named, out) if expand else out


def expanded(named: DataFrame, out: DataFrame) -> DataFrame:
    """(a, b, jaccard) of all members of paired classes, and of the members of one class with each other."""
    p, q = (named.select(F.col("representative").alias(c), F.col("id").alias(f"i{c}")) for c in "ab")
    between = out.join(p, "a").join(q, "b").select(F.least("ia", "ib").alias("a"), F.greatest("ia", "ib").alias("b"), "jaccard")
    within = p.join(q.withColumnRenamed("b", "a"), "a").where("ia < ib").select(F.col("ia").alias("a"), F.col("ib").alias("b"), F.lit(1.0).alias("jaccard"))
    return between.unionByName(within)


def by_value(pairs: DataFrame, items: DataFrame, id_col: str, value: str, scratch: Scratch) -> tuple[DataFrame, DataFrame]:
    """(a, b, va, vb) and its different (va, vb): pairs with the least id that has the value of each end, in the pair's order, for what depends on the values alone."""
    prints = items.select(F.col(id_col).alias("id"), F.sha2(value, 256).alias("print"))
    named = scratch.write(prints.join(prints.groupBy("print").agg(F.min("id").alias("v")), "print").select("id", "v"), "values")
    a, b = (named.select(F.col("id").alias(c), F.col("v").alias(f"v{c}")) for c in "ab")
    every = scratch.write(pairs.join(a, "a").join(b, "b").select("a", "b", "va", "vb"), "valued")
    return every, every.select("va", "vb").distinct()


def starred(named: DataFrame, out: DataFrame) -> DataFrame:
    """(a, b): the links that connect what ``expanded`` does: copies to their representative, and the representatives' pairs."""
    return out.select("a", "b").union(named.where("id <> representative").select("representative", "id"))


def _members(named: DataFrame, held: DataFrame) -> list[DataFrame]:
    """The kinds of the members of each class with their numbers, for both ends of a pair. held: (id, kind)."""
    kinds = held.join(named, "id").groupBy(F.col("representative").alias("c"), "kind").agg(F.count("*").alias("n"), F.min("id").alias("least"))
    return [kinds.select(F.col("c").alias(c), F.col("kind").alias(f"k{c}"), F.col("n").alias(f"m{c}"), F.col("least").alias(f"least_{c}")) for c in "ab"]


def _counted(met: DataFrame) -> DataFrame:
    first = F.struct(F.least("least_a", "least_b").alias("a"), F.greatest("least_a", "least_b").alias("b"))
    return _summed(met.select(F.least("ka", "kb").alias("x"), F.greatest("ka", "kb").alias("y"), "jaccard", "n", first.alias("least")))


def _between(named: DataFrame, out: DataFrame, held: DataFrame) -> DataFrame:
    """(x, y, jaccard, n, least) of members of paired classes."""
    a, b = _members(named, held)
    return _counted(out.select("a", "b", "jaccard").join(a, "a").join(b, "b").withColumn("n", F.col("ma") * F.col("mb")))


def _within(named: DataFrame, held: DataFrame) -> DataFrame:
    """(x, y, jaccard, n, least) of members of one class."""
    a, b = _members(named, held)
    own = a.withColumn("b", F.col("a")).withColumn("jaccard", F.lit(1.0)).join(b, "b").where("ka <= kb")
    return _counted(own.withColumn("n", F.when(F.col("ka") == F.col("kb"), F.expr("ma * (ma - 1) div 2")).otherwise(F.col("ma") * F.col("mb"))).where("n > 0"))


def _summed(counts: DataFrame) -> DataFrame:
    return counts.groupBy("x", "y", "jaccard").agg(F.sum("n").alias("n"), F.min("least").alias("least"))


def pair_kinds(named: DataFrame, out: DataFrame, held: DataFrame) -> DataFrame:
    """(x, y, jaccard, n, least): how many pairs of members have kinds x <= y at a similarity, from the numbers of each class, and the first pair of different kinds as struct(a, b). held: (id, kind)."""
    return _summed(_between(named, out, held).union(_within(named, held)))


def similar_kinds(sets: DataFrame, floor: float, scratch: Scratch, held: DataFrame, **limits: float) -> DataFrame:
    """``pair_kinds`` of ``similar_classes``: the pairs of a round are counted before the next one's are found, so all pairs are never on disk at once."""
    named, counts = similar_classes(sets, floor, scratch, fold=lambda named, out: _between(named, out, held), **limits)
    return _summed(counts.union(_within(named, held)))


def best_to_class(named: DataFrame, out: DataFrame, labels: DataFrame, held: object, against: object) -> DataFrame:
    """As ``max_to_class``, over classes: what a class comes near to is the same for all its members."""
    good = labels.where(F.col("label") == against).join(named, "id").select(F.col("representative").alias("b")).distinct()
    both = out.select("a", "b", "jaccard").union(out.select("b", "a", "jaccard")).union(good.select("b", "b", F.lit(1.0)))
    best = both.join(good, "b", "left_semi").groupBy(F.col("a").alias("representative")).agg(F.max("jaccard").alias("best"))
    return labels.where(F.col("label") == held).select("id").join(named.join(best, "representative"), "id", "left").select("id", F.coalesce("best", F.lit(0.0)).alias("best"))


def canonical(pairs: DataFrame, score: str, floor: float = 0.15) -> DataFrame:
    """(a, b, score) of rows given either way round: each pair once, the smaller first, with its best score if that is ``floor`` or more; an item with itself is none."""
    best = pairs.where("a <> b").groupBy(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).agg(F.max(score).alias(score))
    return best.where(F.col(score) >= floor)


def max_to_class(pairs: DataFrame, labels: DataFrame, score: str, held: str, against: str) -> DataFrame:
    """For each id labelled ``held`` its best score to an id labelled ``against``; 0 without one. labels: (id, label)."""
    both = pairs.select("a", "b", score).union(pairs.select("b", "a", score))
    good = labels.where(F.col("label") == against).select(F.col("id").alias("b"))
    best = both.join(good, "b", "left_semi").groupBy(F.col("a").alias("id")).agg(F.max(score).alias("best"))
    return labels.where(F.col("label") == held).select("id").join(best, "id", "left").select("id", F.coalesce("best", F.lit(0.0)).alias("best"))


def cross_splits(pairs: DataFrame, splits: DataFrame, score: str, bound: float) -> DataFrame:
    """Per pair of splits: pairs, largest, median, how many at or over the bound, the worst pair. splits: (id, split)."""
    sa, sb = (splits.select(F.col("id").alias(c), F.col("split").alias(f"s{c}")) for c in "ab")
    crossing = pairs.join(sa, "a").join(sb, "b").where("sa <> sb")
    key = F.concat_ws("|", F.least("sa", "sb"), F.greatest("sa", "sb"))
    worst = F.max_by(F.concat_ws("-", "a", "b"), F.struct(score, -F.col("a"), -F.col("b")))
    return crossing.groupBy(key.alias("splits")).agg(F.count("*").alias("n"), F.max(score).alias("largest"), F.percentile(score, 0.5).alias("middle"), F.count_if(F.col(score) >= bound).alias("over"), worst.alias("worst"))


def best_hits(queries: DataFrame, targets: DataFrame) -> DataFrame:
    """(id, hits, target, common): for each query the target sharing most shingles, smallest id on ties; both (id, s)."""
    counts = _common(queries, targets)
    return counts.groupBy("id").agg(F.count("*").alias("hits"), F.max_by("target", F.struct("common", -F.col("target"))).alias("target"), F.max("common").alias("common"))


def least_evalue(queries: DataFrame, targets: DataFrame) -> DataFrame:
    """(id, target, evalue): for each query the one target of the smallest expected number of chance hits, smallest id on ties; both (id, s).

    evalue is m n / 2 ** common for a query of m and a target of n shingles.
    """
    m, n = queries.groupBy("id").agg(F.count("*").alias("m")), targets.groupBy(F.col("id").alias("target")).agg(F.count("*").alias("n"))
    scored = _common(queries, targets).join(m, "id").join(n, "target").withColumn("evalue", F.col("m") * F.col("n") / F.pow(F.lit(2.0), "common"))
    return scored.groupBy("id").agg(F.min(F.struct("evalue", "target")).alias("best")).select("id", "best.target", "best.evalue")


def _common(queries: DataFrame, targets: DataFrame) -> DataFrame:
    return queries.join(targets.select(F.col("id").alias("target"), "s"), "s").groupBy("id", "target").agg(F.count("*").alias("common"))
