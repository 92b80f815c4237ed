"""Cross-entropy difference of matched target and background n-gram models.

Both models are bigram models over one vocabulary, with one order and one smoothing, so that only their counts differ: the target's
from documents named as good, the background's from all documents. The vocabulary is every word of the corpus and the counts are of
every word and word pair, as whole numbers, under hashed names (48 bits within a shard, so that with n distinct pairs in a shard about
n * n / 2 ** 49 of them share a count); what is gathered grows with the corpus, and nothing of it is broadcast. A target document is scored by a
model that counted it too: its target loss is that of a training text.

Documents are packed in blocks of about ``BLOCK`` bytes, written once. Each block sends its distinct words and pairs with both
counts to shards of the names, one packed row a shard (sorted names as differences, in byte planes, compressed), so that the
commonest word costs a shard one entry a block. A shard sums and
answers each block in the order of its question; the answers meet the block's texts again, where the losses are taken.
A shard's task holds the entries of 1 in ``spark.sql.shuffle.partitions`` names.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomlake.llm import textkit as tk
from loomlake.llm.frames import keyed, partitions, shown
from loomlake.scratch import Scratch

U = np.uint64
#: Text of a block, in bytes; a longer document is a block of its own.
BLOCK = 4_000_000
#: Names of words are even, those of pairs odd. The start symbol is the context of a first word and counts as a word.
_EVEN, _ODD = U(2**64 - 2), U(1)
_START = U(0x2545F4914F6CDD1D) & _EVEN
#: A name's low bits are sent; its high bits choose the shard, of which there are at most so many.
_LOW, _SHARDS = U(2**48 - 1), 2**16


def _block(batches):
    """(ks, sizes, texts): ids, byte lengths and compressed texts of a block of documents."""
    kinds = (pa.list_(pa.int64()), pa.list_(pa.int64()), pa.binary())
    for batch in batches:
        ids = batch.column("k").to_pylist()
        for row, end, data, offsets in tk.chunks(batch.column("text"), BLOCK):
            one = (ids[row:end], np.diff(offsets).tolist(), pa.compress(data.tobytes(), codec="zstd", asbytes=True))
            yield pa.record_batch([pa.array([x], t) for x, t in zip(one, kinds, strict=True)], names=["ks", "sizes", "texts"])


class Items:
    """The words and pairs of a block's texts: distinct names by shard, and the place of each token's own among them."""

    def __init__(self, sizes: list[int], texts: bytes, shards: int):
        offsets = np.concatenate([[0], np.cumsum(sizes)]).astype(np.int64)
        data = np.frombuffer(pa.decompress(texts, int(offsets[-1]), codec="zstd", asbytes=True) if offsets[-1] else b"", np.uint8)
        parts, row = [], 0
        while row < len(sizes):
            end = max(row + 1, int(np.searchsorted(offsets, offsets[row] + tk.CHUNK, "right")) - 1)
            parts.append(tk.words_of(data[offsets[row] : offsets[end]], offsets[row : end + 1] - offsets[row], lower=True))
            row = end
        self.size = np.concatenate([np.diff(w.first) for w in parts])
        self.begins = (np.cumsum(self.size) - self.size)[self.size > 0]
        names = np.concatenate([w.names for w in parts]) & _EVEN
        n = len(names)
        before = np.empty_like(names)
        before[1:] = names[:-1]
        before[self.begins] = _START
        pairs = tk.mix(before * U(0x9E3779B97F4A7C15) + names) | _ODD
        full = np.concatenate([pairs, names, [_START]])
        full = (full >> U(48)) % U(shards) << U(48) | full & _LOW
        self.names, at = np.unique(full, return_inverse=True)
        self.bounds = np.searchsorted(self.names >> U(48), np.arange(shards + 1, dtype=U))
        self.pair, self.word, self.start = at[:n], at[n : 2 * n], at[-1]

    def counts(self, of: np.ndarray) -> np.ndarray:
        """How often each name occurs in the documents marked by ``of``."""
        token = np.repeat(of, self.size)
        out = np.bincount(self.pair[token], minlength=len(self.names)) + np.bincount(self.word[token], minlength=len(self.names))
        out[self.start] += int((of & (self.size > 0)).sum())
        return out

    def context(self) -> np.ndarray:
        out = np.empty_like(self.word)
        out[1:] = self.word[:-1]
        out[self.begins] = self.start
        return out


def _ask(shards: int):
    """(shard, block, n, names, n0, n1): a block's n distinct names in a shard with background and target counts."""

    def run(batches):
        for batch in batches:
            for block, sizes, texts, good in zip(*(batch.column(c).to_pylist() for c in ("block", "sizes", "texts", "good")), strict=True):
                items = Items(sizes, texts, shards)
                mine = np.zeros(len(sizes), bool)
                mine[good or []] = True
                counts = [items.counts(of).astype(np.uint32) for of in (np.ones(len(sizes), bool), mine)]
                rows = []
                for s in np.flatnonzero(np.diff(items.bounds)):
                    part = slice(items.bounds[s], items.bounds[s + 1])
                    steps = np.diff(items.names[part] & _LOW, prepend=U(0))
                    rows.append((int(s), block, len(steps), tk.shut(steps, 6), tk.shut(counts[0][part], 4), tk.shut(counts[1][part], 4)))
                yield pa.record_batch([pa.array([r[i] for r in rows], t) for i, t in enumerate((pa.int32(), pa.int64(), pa.int32(), *[pa.binary()] * 3))], names=["shard", "block", "n", "names", "n0", "n1"])

    return run


def _answer(batches):
    """(block, shard, n0, n1): corpus counts in the order asked; block -1 has the shard's number of words and both totals of tokens."""
    held: dict[int, list] = {}
    for batch in batches:
        for shard, *rest in zip(*(batch.column(i).to_pylist() for i in range(6)), strict=True):
            held.setdefault(shard, []).append(rest)
    for shard in list(held):
        asked = held.pop(shard)
        names, at = np.unique(np.concatenate([np.cumsum(tk.opened(r[2], r[1], 6, U), dtype=U) for r in asked]), return_inverse=True)
        total = [np.bincount(at, np.concatenate([tk.opened(r[i], r[1], 4, np.uint32) for r in asked]), len(names)) for i in (3, 4)]
        single = (names & _ODD) == 0
        rows = [(-1, shard, int(single.sum()), *(int(t[single].sum()) for t in total), None, None)]
        for (block, own, *_), x in zip(asked, np.split(at, np.cumsum([r[1] for r in asked])[:-1]), strict=True):
            rows.append((block, shard, None, None, None, *(tk.shut(t[x].astype(U), 6) for t in total)))
        kinds = (pa.int64(), pa.int32(), *[pa.int64()] * 3, *[pa.binary()] * 2)
        for i in range(0, len(rows), 1000):
            yield pa.record_batch([pa.array(list(c), t) for c, t in zip(zip(*rows[i : i + 1000], strict=True), kinds, strict=True)], names=["block", "shard", "words", "t0", "t1", "n0", "n1"])


def _score(shards: int, vocabulary: int, tokens: tuple[int, int], prior: float):
    """The losses of each document of a block: pair counts, smoothed by ``prior`` pseudo-counts of the word's own probability."""

    def run(batches):
        for batch in batches:
            for ks, sizes, texts, answers in zip(*(batch.column(c).to_pylist() for c in ("ks", "sizes", "texts", "answers")), strict=True):
                items = Items(sizes, texts, shards)
                loss, some, context = np.full((2, len(ks)), np.nan), np.flatnonzero(items.size), items.context()
                for m, name in enumerate(("n0", "n1")):
                    count = np.zeros(len(items.names))
                    for a in answers:
                        begin, end = items.bounds[a["shard"]], items.bounds[a["shard"] + 1]
                        count[begin:end] = tk.opened(a[name], end - begin, 6, U)
                    if len(some):
                        single = (count[items.word] + 1.0) / (tokens[m] + vocabulary)
                        each = -np.log((count[items.pair] + prior * single) / (count[context] + prior))
                        loss[m, some] = np.add.reduceat(each, items.begins) / items.size[some]
                columns = [pa.array(x, pa.float64(), mask=items.size == 0) for x in (loss[1], loss[0], loss[1] - loss[0])]
                yield pa.record_batch([pa.array(ks, pa.int64()), pa.array(items.size, pa.int64()), *columns], names=["k", "n_tokens", "target_loss", "background_loss", "score"])

    return run


def score(docs: DataFrame, targets: DataFrame, id_col: str = "doc_id", text_col: str = "text", prior: float = 50.0) -> DataFrame:
    """Cross-entropy difference of each document; the lower, the more it is like the target documents.

    ``targets`` has the ids of the target documents in ``id_col``. Returns ``id_col``, n_tokens, target_loss and background_loss (mean
    nats a token), score (their difference).

    Words are lower-cased (A-Z). Null and empty texts have no tokens and null losses. A null id is kept and is no target. Rows that repeat
    an id are scored, and counted, one by one; repeated or unknown target ids change nothing. Extra columns are ignored; an empty table
    gives an empty result, and without targets the target model is uniform.
    """
    n, scratch = min(partitions(docs), _SHARDS), Scratch(docs.sparkSession, "lm")
    packed = keyed(docs, id_col, text_col).mapInArrow(tk.releasing(_block), "ks array<long>, sizes array<long>, texts binary")
    blocks = scratch.write(packed.withColumn("block", F.monotonically_increasing_id()), "blocks")
    good = targets.select(targets[id_col].cast("bigint").alias("k")).where("k is not null").distinct()
    # always by shuffle: one plan for every size of the label table
    held = blocks.select("block", F.posexplode("ks").alias("pos", "k")).join(good.hint("merge"), "k", "left_semi")
    marks = held.groupBy("block").agg(F.collect_list("pos").alias("good"))
    marked = blocks.select("block", "sizes", "texts").join(marks.hint("shuffle_hash"), "block", "left")
    asked = marked.mapInArrow(tk.releasing(_ask(n)), "shard int, block long, n int, names binary, n0 binary, n1 binary").repartition(n, "shard")
    answered = scratch.write(asked.mapInArrow(tk.releasing(_answer), "block long, shard int, words long, t0 long, t1 long, n0 binary, n1 binary"), "answers")
    total = answered.where("block = -1").agg(*(F.coalesce(F.sum(c), F.lit(0)) for c in ("words", "t0", "t1"))).first()
    answers = answered.where("block >= 0").groupBy("block").agg(F.collect_list(F.struct("shard", "n0", "n1")).alias("answers"))
    joined = blocks.join(answers.hint("merge"), "block").select("ks", "sizes", "texts", "answers")
    out = joined.mapInArrow(tk.releasing(_score(n, total[0], (total[1], total[2]), prior)), "k long, n_tokens long, target_loss double, background_loss double, score double")
    return out.select(shown().alias(id_col), "n_tokens", "target_loss", "background_loss", "score")
