"""Near-duplicate documents by HyperMinHash.

A document is the set of its distinct 5-word shingles. Its sketch has 128 registers: the first 7 bits of a
shingle's hash choose a register, the least of the remaining bits stays, kept as the count of its leading
zeros (6 bits) and the 10 bits that follow. A set of under 1,024 shingles enters as several salted replicas,
which leaves the Jaccard similarity of two sets as it is and fills the registers; sets within the similarity's
size ratio of a change in the number of replicas are sketched with both numbers.

Four neighbouring registers are a band, 64 bits. Sets that share a band are candidates: at similarity 0.85 a
band agrees with probability 0.52, and no band of 32 does with probability 6e-11. A pair whose
collision-corrected estimate is over 0.2 (six standard deviations) below the threshold is dropped; the
others are compared by their full sets, word by word: hashes find candidates and never make a link.

Large groups do not list their pairs. Documents of equal words count once, under a cryptographic digest of these. A group of up to ``SMALL`` sets is compared
pairwise; in a larger one each set is compared with the group's first, which joins a family of copies in
one pass. Sets that stay outside the main component of a large group are then compared with the group's
members in a grid of blocks of bounded size, by matrix products over their shingles that give exact
intersections; a block reports one link for each set and component.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomlake.llm import textkit as tk
from loomlake.operators.graph import connected
from loomlake.llm.frames import NULL_ID, WORD, keyed, shown, spread
from loomlake.scratch import Scratch

U = np.uint64
REGISTERS, BAND, FILL = 128, 4, 1024
#: Groups up to this size are compared pairwise, 3.5 pairs a member at most.
SMALL = 8
#: Shingles of the outside sets of a grid block, of its other side four times as many; and rows of both sides, at most.
BLOCK, OUTSIDE, INSIDE = 100_000, 128, 512
#: Of the published approximation of the expected number of register collisions between unrelated sets.
COLLISION = 0.169919487159739093975315012348630288992889
_SALTS = tk.mix(np.arange(1, FILL + 1, dtype=U) * U(0x9E3779B97F4A7C15))
_EDGES = np.arange(REGISTERS, dtype=U) << U(57)


def shingle_sets(words: tk.Words, k: int = 5) -> list[np.ndarray]:
    """The sorted distinct shingle hashes of each document; of one with fewer than k words, its whole sequence."""
    all_k, out = tk.grams(words.names, k), []
    for lo, hi in zip(words.first[:-1], words.first[1:], strict=True):
        n = hi - lo
        if n >= k:
            out.append(np.unique(all_k[lo : hi - k + 1]))
        else:
            out.append(tk.mix(tk.grams(words.names[lo:hi], n) ^ U(n)) if n else np.empty(0, U))
    return out


def exact_sets(texts: pa.Array, k: int) -> tuple[np.ndarray, np.ndarray]:
    """(text, shingle): the distinct shingles of each text, in order, under numbers that two share only if their words are equal.

    A text of fewer than k words has none: its one shingle can be no other text's unless their words are equal.
    """
    data, offsets = tk.text_buffers(texts)
    data, offsets = tk.lowered(data[offsets[0] : offsets[-1]]), offsets - offsets[0]
    words = tk.words_of(data, offsets)
    ids, _ = tk.interned(words, data)
    at = np.flatnonzero(words.left >= k)
    shingles, firsts = tk.interned_grams(ids, k, at)
    of = np.unique(words.doc[at] * max(1, len(firsts)) + shingles)
    return of // max(1, len(firsts)), of % max(1, len(firsts))


def replica_class(n: int) -> int:
    """log2 of the number of replicas of a set of n shingles."""
    return max(0, int(np.ceil(np.log2(FILL / n)))) if n < FILL else 0


def registers(own: np.ndarray, level: int) -> np.ndarray:
    """128 registers of 16 bits of a sorted set, as 2**level replicas; 0xFFFF: empty."""
    h = own if not level else np.sort(tk.mix(own[:, None] ^ _SALTS[: 1 << level]).ravel())
    at = np.searchsorted(h, _EDGES)
    found = np.append(at[1:], len(h)) > at
    rest = h[np.minimum(at, len(h) - 1)] << U(7)
    zeros = np.minimum(64 - np.frexp(rest.astype(np.float64))[1], 57).astype(U)
    mantissa = (rest << np.minimum(zeros + U(1), U(63))) >> U(54)
    return np.where(found, (zeros << U(10)) | mantissa, U(0xFFFF)).astype(np.uint16)


def estimate(x: np.ndarray, y: np.ndarray, n: np.ndarray, m: np.ndarray) -> np.ndarray:
    """Collision-corrected Jaccard estimates of rows of registers of sets of sizes n and m."""
    full = (x != 0xFFFF) | (y != 0xFFFF)
    agree = ((x == y) & full).sum(1)
    ratio = np.minimum(n, m) / np.maximum(n, m)
    expected = COLLISION * REGISTERS / 2**10 * 4 * ratio / (1 + ratio) ** 2
    total = full.sum(1)
    return (agree - expected) / np.maximum(total - expected, 1)


def _sketch(pct: int, k: int):
    def run(batches):
        for batch in batches:
            keys, rows = [batch.column(c).to_pylist() for c in ("k", "th")], []
            for row, _, data, offsets in tk.chunks(batch.column("text")):
                data = tk.lowered(data)
                for i, own in enumerate(shingle_sets(tk.words_of(data, offsets), k)):
                    key, n = (keys[0][row + i], keys[1][row + i]), len(own)
                    if not n:
                        rows.append((*key, 0, None, None, None, None, None))
                        continue
                    print_ = hashlib.blake2b(b" ".join(data[offsets[i] : offsets[i + 1]].tobytes().split()), digest_size=16).digest()
                    c, d = replica_class(n), replica_class(n * 100 // pct + 1)
                    rows.append((*key, n, print_, c, registers(own, c).tobytes(), *((d, registers(own, d).tobytes()) if c != d else (None, None))))
            kinds = [pa.int64(), pa.binary(), pa.int64(), pa.binary(), pa.int32(), pa.binary(), pa.int32(), pa.binary()]
            for x in range(0, len(rows), 5000):
                yield pa.record_batch([pa.array(list(c), t) for c, t in zip(zip(*rows[x : x + 5000], strict=True), kinds, strict=True)], ["k", "th", "n", "print", "c0", "r0", "c1", "r1"])

    return tk.releasing(run)


def _bands(batches):
    """(key, nid, class) of every band of every sketch; the key names band, class and registers."""
    per = REGISTERS // BAND
    place = tk.mix(np.arange(per, dtype=U) + U(77))
    for batch in batches:
        nid = batch.column("nid").to_numpy(zero_copy_only=False)
        for cs, rs in (("c0", "r0"), ("c1", "r1")):
            has = np.flatnonzero(np.array(batch.column(cs).is_valid()))
            if not len(has):
                continue
            level = batch.column(cs).take(pa.array(has)).to_numpy(zero_copy_only=False)
            regs = np.frombuffer(b"".join(batch.column(rs).take(pa.array(has)).to_pylist()), U).reshape(len(has), per)
            keys = tk.mix(tk.mix(regs ^ place) + level.astype(U)[:, None])
            yield pa.record_batch([pa.array(keys.ravel().view(np.int64)), pa.array(np.repeat(nid[has], per)), pa.array(np.repeat(level.astype(np.int32), per))], ["key", "nid", "c"])


def _likely(pct: int):
    """Pairs whose estimate, in a class that both have, is not far below the threshold."""
    floor = pct / 100 - 0.2

    def run(batches):
        for batch in batches:
            get = lambda name: batch.column(name).to_pylist()
            a, b, na, nb = (batch.column(c).to_numpy(zero_copy_only=False) for c in ("a", "b", "na", "nb"))
            left, right = [], []
            for p0, q0, p1, q1, x0, y0, x1, y1 in zip(*(get(c) for c in ("ac0", "ar0", "ac1", "ar1", "bc0", "br0", "bc1", "br1")), strict=True):
                mine = {p0: q0} | ({p1: q1} if p1 is not None else {})
                theirs = {x0: y0} | ({x1: y1} if x1 is not None else {})
                both = [c for c in mine if c in theirs]
                left.append(mine[both[0]] if both else b"\0" * 256)
                right.append(theirs[both[0]] if both else b"\1" * 256)
            if not left:
                continue
            x, y = (np.frombuffer(b"".join(s), np.uint16).reshape(len(s), REGISTERS) for s in (left, right))
            keep = (estimate(x, y, na, nb) >= floor) & (100 * np.minimum(na, nb) >= pct * np.maximum(na, nb))
            yield pa.record_batch([pa.array(a[keep]), pa.array(b[keep])], ["a", "b"])

    return run


def _slices(x: pa.Array, y: pa.Array) -> list[tuple[int, int]]:
    """Runs of rows with about ``tk.CHUNK`` bytes in both columns."""
    size = np.cumsum(pc.add(pc.binary_length(x), pc.binary_length(y)).to_numpy(zero_copy_only=False).astype(np.int64))
    cuts = np.flatnonzero(np.diff(size // tk.CHUNK)) + 1
    return list(zip([0, *cuts.tolist()], [*cuts.tolist(), len(x)], strict=True)) if len(x) else []


def _linked(pct: int, k: int):
    """The pairs whose sets of shingles are similar enough."""

    def run(batches):
        for batch in batches:
            x, y, keep = batch.column("x"), batch.column("y"), []
            for row, end in _slices(x, y):
                n = end - row
                of, shingle = exact_sets(pa.concat_arrays([x.slice(row, n), y.slice(row, n)]), k)
                size = np.bincount(of, minlength=2 * n)
                both = np.sort(of % n * (shingle.max(initial=0) + 1) + shingle)
                common = np.bincount(both[1:][both[1:] == both[:-1]] // (shingle.max(initial=0) + 1), minlength=n)
                keep.append((common > 0) & (100 * common >= pct * (size[:n] + size[n:] - common)))
            keep = pa.array(np.concatenate(keep) if keep else [], pa.bool_())
            yield pa.record_batch([batch.column("a").filter(keep), batch.column("b").filter(keep)], ["a", "b"])

    return tk.releasing(run)


def _block(pct: int, k: int):
    """Links of a grid block: for each outside set one in every other component that it has a link to."""

    def run(table: pa.Table) -> pa.Table:
        isx = table.column("isx").to_numpy()
        nid, root = table.column("nid").to_numpy(), table.column("root").to_numpy()
        xs, ys = np.flatnonzero(isx), np.flatnonzero(~isx)
        a, b = [], []
        if len(xs) and len(ys):
            of, shingle = exact_sets(table.column("text").combine_chunks(), k)
            bounds, size = np.searchsorted(of, np.arange(len(nid) + 1)), np.bincount(of, minlength=len(nid))
            own = lambda i: shingle[bounds[i] : bounds[i + 1]]
            place = np.full(shingle.max(initial=0) + 1, -1)
            vocabulary = np.unique(np.concatenate([own(i) for i in xs]))
            place[vocabulary] = np.arange(len(vocabulary))
            left = np.zeros((len(xs), len(vocabulary)), np.float32)
            for row, i in enumerate(xs):
                left[row, place[own(i)]] = 1
            step = max(1, 4_000_000 // max(1, len(vocabulary)))
            for s in range(0, len(ys), step):
                part = ys[s : s + step]
                right = np.zeros((len(part), len(vocabulary)), np.float32)
                for row, i in enumerate(part):
                    at = place[own(i)]
                    right[row, at[at >= 0]] = 1
                common = (left @ right.T).astype(np.int64)
                link = (common > 0) & (100 * common >= pct * (size[xs][:, None] + size[part][None, :] - common))
                i, j = np.nonzero(link & (root[xs][:, None] != root[part][None, :]))
                _, first = np.unique(np.stack([nid[xs[i]], root[part[j]]]), axis=1, return_index=True)
                a.append(nid[xs[i]][first])
                b.append(nid[part[j]][first])
        a, b = (np.concatenate(v) if v else np.empty(0, np.int64) for v in (a, b))
        tk.release()
        return pa.table({"a": pa.array(a, pa.int64()), "b": pa.array(b, pa.int64())})

    return run


def _keyed(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(k, text, th): a row is named by its id and a digest of its text, as ids may be null or repeat."""
    return keyed(docs, id_col, text_col).withColumn("th", F.unhex(F.md5("text")))


def _components(base: DataFrame, pct: int, k: int) -> tuple[DataFrame, DataFrame]:
    """(rows, named): every row's (k, th, n, print), and for each print its component's least (k, th), as ``least``."""
    scratch = Scratch(base.sparkSession, "minhash")
    rows = scratch.write(base.select("k", "th", "text").mapInArrow(_sketch(pct, k), "k long, th binary, n long, print binary, c0 int, r0 binary, c1 int, r1 binary"), "sketches")
    firsts = [F.first(c).alias(c) for c in ("n", "c0", "r0", "c1", "r1")]
    nodes = scratch.write(rows.where("n > 0").groupBy("print").agg(F.min(F.struct("k", "th")).alias("label"), *firsts).withColumn("nid", F.monotonically_increasing_id()), "nodes")
    bands = nodes.select("nid", "c0", "r0", "c1", "r1").mapInArrow(_bands, "key long, nid long, c int")
    sizes = bands.groupBy("key").agg(F.count("*").alias("m"), F.min("nid").alias("hub")).where("m > 1")
    groups = scratch.write(bands.join(sizes, "key"), "groups")

    small = groups.where(F.col("m") <= SMALL).select("key", "nid")
    pairs = small.select("key", F.col("nid").alias("a")).join(small.select("key", F.col("nid").alias("b")), "key").where("a < b").select("a", "b")
    star = groups.where((F.col("m") > SMALL) & (F.col("nid") != F.col("hub"))).select(F.col("hub").alias("a"), F.col("nid").alias("b"))
    pairs = pairs.unionByName(star).distinct()

    def side(c: str) -> DataFrame:
        return nodes.select(F.col("nid").alias(c), F.col("n").alias(f"n{c}"), *(F.col(x).alias(f"{c}{x}") for x in ("c0", "r0", "c1", "r1")))

    def texts_of(need: DataFrame) -> DataFrame:
        """(nid, text): a text for each of the nodes."""
        want = need.join(nodes.select("nid", "label.k", "label.th"), "nid")
        return base.join(want, ["k", "th"]).groupBy("nid").agg(F.first("text").alias("text"))

    likely = scratch.write(pairs.join(side("a"), "a").join(side("b"), "b").mapInArrow(_likely(pct), "a long, b long"), "likely")
    texts = scratch.write(texts_of(likely.select(F.col("a").alias("nid")).union(likely.select("b")).distinct()), "texts")
    x, y = texts.select(F.col("nid").alias("a"), F.col("text").alias("x")), texts.select(F.col("nid").alias("b"), F.col("text").alias("y"))
    links = scratch.write(likely.join(y, "b").join(x, "a").select("a", "b", "x", "y").mapInArrow(_linked(pct, k), "a long, b long"), "links")
    scratch.drop(likely)
    roots = connected(links, scratch)

    large = groups.where(F.col("m") > SMALL).select("key", "nid").join(roots.withColumnRenamed("node", "nid"), "nid", "left").withColumn("root", F.coalesce("root", "nid"))
    shares = large.groupBy("key", "root").agg(F.count("*").alias("m")).groupBy("key").agg(F.count("*").alias("parts"), F.max_by("root", F.struct("m", -F.col("root"))).alias("main"))
    held = spread(large, shares.where("parts > 1").select("key", "main"), "key", "nid").select("main", "nid", "root").distinct()
    torn = scratch.write(held, "torn")
    if not torn.isEmpty():
        more = scratch.write(texts_of(torn.select("nid").distinct().join(texts.select("nid"), "nid", "left_anti")), "texts")
        placed = torn.join(nodes.select("nid", F.col("n").cast("double").alias("load")), "nid").withColumn("outside", F.col("root") != F.col("main"))
        plan = placed.groupBy("main").agg(
            F.greatest(F.ceil(F.sum(F.when(F.col("outside"), F.col("load"))) / BLOCK), F.ceil(F.count_if("outside") / OUTSIDE)).alias("bx"),
            F.greatest(F.ceil(F.sum("load") / (4 * BLOCK)), F.ceil(F.count("*") / INSIDE)).alias("by"),
        )
        placed = spread(placed, plan, "main", "nid")
        outside = placed.where("outside").select("main", F.pmod(F.xxhash64("nid"), "bx").alias("xb"), F.explode(F.sequence(F.lit(0), F.col("by") - 1)).alias("yb"), F.lit(True).alias("isx"), "nid", "root")
        inside = placed.select("main", F.explode(F.sequence(F.lit(0), F.col("bx") - 1)).alias("xb"), F.pmod(F.xxhash64("nid"), "by").alias("yb"), F.lit(False).alias("isx"), "nid", "root")
        found = outside.unionByName(inside).join(texts.unionByName(more), "nid").groupBy("main", "xb", "yb").applyInArrow(_block(pct, k), "a long, b long")
        roots = connected(links.unionByName(scratch.write(found, "links")), scratch)
        scratch.drop(more)

    whole = nodes.select("nid", "print", "label").join(roots.withColumnRenamed("node", "nid"), "nid", "left").withColumn("root", F.coalesce("root", "nid"))
    least = whole.groupBy("root").agg(F.min("label").alias("least"))
    named = scratch.write(spread(whole, least, "root", "nid").select("print", "least"), "named")
    scratch.drop(groups, texts, torn)
    return rows.select("k", "th", "n", "print"), named


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", pct: int = 85, k: int = 5) -> DataFrame:
    """Components of documents whose shingle sets have a Jaccard similarity of ``pct`` percent or more.

    Returns one row a document: ``id_col``, n_shingles (distinct), component_id (the smallest id that links
    reach, its own included), kept (the id is the component's).

    Words are lower-cased (A-Z). Null or empty texts have no shingles, link with nothing and stay. A null id counts
    as the largest. Rows that repeat a text are linked by their equal sets, and rows that repeat an id too are all
    kept or all dropped; ``one_of_each`` keeps one of them. Two texts under one id are separate sets whose components show that id. Extra
    columns are ignored; an empty table gives an empty result.
    """
    rows, named = _components(_keyed(docs, id_col, text_col), pct, k)
    full = spread(rows.where("n > 0"), named, "print", "k").select("k", "n", F.col("least.k").alias("least"))
    out = full.unionByName(rows.where("n = 0").select("k", "n", F.col("k").alias("least")))
    return out.select(shown().alias(id_col), F.col("n").alias("n_shingles"), shown("least").alias("component_id"), (F.col("k") == F.col("least")).alias("kept"))


def one_of_each(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", pct: int = 85, k: int = 5) -> DataFrame:
    """One row of each component of near-duplicates, with all its columns: the row with the smallest id, of equal ids the one of the least digest of its text.

    Of rows that share id and text the least in the other columns stays (columns without an order are not compared). A null id counts as the largest. Rows without
    words are linked with nothing and all stay. Columns may have any names; an empty table stays empty.
    """
    _, named = _components(_keyed(docs, id_col, text_col), pct, k)
    chosen = named.select("least.k", "least.th").distinct()
    columns = [f"c{i}" for i in range(len(docs.columns))]
    own = docs.toDF(*columns)
    at_id, at_text = (F.col(columns[docs.columns.index(c)]) for c in (id_col, text_col))
    has = F.coalesce(at_text.cast("string").rlike(WORD), F.lit(False))
    ordered = [f.name for f in own.schema.fields if not any(t in f.dataType.simpleString() for t in ("map<", "variant", "interval"))]
    wordy = own.where(has).select(F.coalesce(at_id.cast("bigint"), F.lit(NULL_ID)).alias("k"), F.unhex(F.md5(at_text.cast("string"))).alias("th"), F.struct(*columns).alias("all"), F.struct(*ordered).alias("by"))
    one = wordy.join(chosen, ["k", "th"], "left_semi").groupBy("k", "th").agg(F.min_by("all", "by").alias("all"))
    return one.select("all.*").unionByName(own.where(~has)).toDF(*docs.columns)
