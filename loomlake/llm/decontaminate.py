"""Benchmark decontamination with an FM-index for each training shard.

A shard is one Arrow batch of documents. Its words are mapped to the vocabulary of the benchmark's items; only
stretches of vocabulary words that are long enough to hold a window enter the index, as nothing else can
take part in an occurrence. Every window of every item is then searched backwards through the wavelet
tree, occurrences are located from sampled suffix positions, and their word spans are merged.

The benchmark is a query set: it reaches the executors in blocks of bounded size, one at a time. With one block the documents are
read once and never shuffled. With more, each block is one pass over the documents that writes what it hits, and the driver lets
go of a block before it collects the next; the passes' hits meet by id and text. Words of documents and items are compared by
their bytes.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomlake.llm import textkit as tk
from loomlake.llm.fm_index import FMIndex
from loomlake.llm.frames import keyed, shown
from loomlake.scratch import Scratch

#: Benchmark text in one block, in bytes.
BLOCK_BYTES = 16_000_000


class Windows:
    """The windows of a block of items as rows of word ids, by length, and the items that hold each."""

    def __init__(self, items: list[tuple[str, str | None]], size: int):
        texts = [t or "" for _, t in items]
        data, offsets = tk.text_buffers(pa.array(texts, pa.string()))
        self.data = tk.lowered(data)
        words = tk.words_of(data, offsets, lower=True, alnum=True)
        self.items = [i for i, _ in items]
        exact, firsts = tk.interned(words, self.data)
        # ids in the order of names; several words may share a name
        order = np.argsort(words.names[firsts], kind="stable")
        self.vocabulary, self.starts, self.ends = words.names[firsts][order], words.starts[firsts][order], words.ends[firsts][order]
        place = np.empty(len(order), np.int64)
        place[order] = np.arange(len(order))
        ids = place[exact] if len(order) else exact
        self.maybe = np.zeros(1 << 20, bool)
        self.maybe[self.vocabulary >> np.uint64(44)] = True
        held: dict[int, list] = {}
        for item, (lo, hi) in enumerate(zip(words.first[:-1], words.first[1:], strict=True)):
            n = min(size, hi - lo)
            if n:
                rows = np.lib.stride_tricks.sliding_window_view(ids[lo:hi] + 1, n)
                held.setdefault(int(n), []).append((rows, np.full(len(rows), item)))
        self.groups = []
        for parts in held.values():
            rows, owner = np.concatenate([r for r, _ in parts]), np.concatenate([o for _, o in parts])
            patterns, which = np.unique(rows, axis=0, return_inverse=True)
            pairs = np.unique(np.stack([which.ravel(), owner]), axis=1)
            self.groups.append((patterns, np.searchsorted(pairs[0], np.arange(len(patterns) + 1)), pairs[1]))
        self.shortest = min(held, default=0)

    def ids(self, words: tk.Words, data: np.ndarray) -> np.ndarray:
        """1-based vocabulary ids of words of lower-cased ``data``; 0 for a word that no item has."""
        out = np.zeros(len(words.names), np.int32)
        left = np.flatnonzero(self.maybe[words.names >> np.uint64(44)])
        at = np.searchsorted(self.vocabulary, words.names[left])
        while len(left):
            near = at < len(self.vocabulary)
            left, at = left[near], at[near]
            near = self.vocabulary[at] == words.names[left]
            left, at = left[near], at[near]
            same = tk.same_bytes(data, words.starts, words.ends, at, left, (self.data, self.starts, self.ends))
            out[left[same]] = at[same] + 1
            left, at = left[~same], at[~same] + 1
        return out


def _expand(lo: np.ndarray, hi: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Every integer of the ranges [lo, hi), and the range each comes from."""
    size = hi - lo
    which = np.repeat(np.arange(len(lo)), size)
    return np.arange(size.sum()) - np.repeat(np.cumsum(size) - size, size) + lo[which], which


def scan(texts: pa.Array, windows: Windows) -> tuple[np.ndarray, list[tuple[int, np.ndarray, list[str]]]]:
    """Words of each text, and for texts with occurrences: row, merged spans of words, items."""
    symbols, places, firsts, total = [], [], [], 0
    counts = np.zeros(len(texts), np.int64)
    for row, end, data, offsets in tk.chunks(texts):
        words = tk.words_of(data, offsets, lower=True, alnum=True)
        counts[row:end] = np.diff(words.first)
        n = len(words.names)
        if n and windows.shortest:
            ids = windows.ids(words, tk.lowered(data))
            inside = ids > 0
            begins = inside.copy()
            edge = np.zeros(n + 1, bool)
            edge[words.first] = True
            begins[1:] &= ~inside[:-1] | edge[1:n]
            stops = inside.copy()
            stops[:-1] &= ~inside[1:] | edge[1:n]
            a, b = np.flatnonzero(begins), np.flatnonzero(stops) + 1
            long = b - a >= windows.shortest
            a, b = a[long], b[long]
            if len(a):
                at, part = _expand(a, b)
                out = np.zeros(len(at) + len(a), np.int32)
                slot = np.arange(len(at)) + part
                out[slot] = ids[at]
                where = np.full(len(out), -1, np.int64)
                where[slot] = at + total
                symbols.append(out)
                places.append(where)
        firsts.append(words.first[:-1] + total)
        total += n
    if not symbols:
        return counts, []
    first = np.append(np.concatenate(firsts), total)
    delta, pairs = np.zeros(total + 1, np.int32), []
    index, place = FMIndex(np.concatenate(symbols), len(windows.vocabulary)), np.concatenate(places)
    for patterns, owned, owner in windows.groups:
        who, lo, hi = index.search(patterns)
        rows, which = _expand(lo, hi)
        if not len(rows):
            continue
        at = place[index.locate(rows)]
        np.add.at(delta, at, 1)
        np.add.at(delta, at + patterns.shape[1], -1)
        doc = np.searchsorted(first, at, "right") - 1
        # several texts without words may share a first word; the last of them holds it
        hits = np.unique(np.stack([doc, which]), axis=1)
        size = (owned[who + 1] - owned[who])[hits[1]]
        item = owner[_expand(owned[who][hits[1]], owned[who + 1][hits[1]])[0]]
        pairs.append(np.unique(np.stack([np.repeat(hits[0], size), item]), axis=1))
    if not pairs:
        return counts, []
    hit = np.cumsum(delta[:total]) > 0
    rows, items = np.unique(np.concatenate(pairs, axis=1), axis=1)
    found = []
    for row, own in zip(*_grouped(rows, items), strict=True):
        found.append((int(row), _stretches(hit[first[row] : first[row + 1]]), sorted({windows.items[i] for i in own})))
    return counts, found


def _grouped(keys: np.ndarray, values: np.ndarray) -> tuple[np.ndarray, list[np.ndarray]]:
    """The distinct ones of sorted keys, and the values of each."""
    distinct, at = np.unique(keys, return_index=True)
    return distinct, np.split(values, at[1:])


def _stretches(hit: np.ndarray) -> np.ndarray:
    """(start, end) of the runs of hit words."""
    edge = np.diff(np.concatenate(([0], hit.astype(np.int8), [0])))
    return np.stack([np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)], axis=1)


def _united(spans: list[np.ndarray]) -> np.ndarray:
    """The union of several lists of spans; words that two of them hit side by side are one stretch."""
    if len(spans) == 1:
        return spans[0]
    delta = np.zeros(max(int(s[:, 1].max()) for s in spans) + 1, np.int64)
    for s in spans:
        np.add.at(delta, s[:, 0], 1)
        np.add.at(delta, s[:, 1], -1)
    return _stretches(np.cumsum(delta[:-1]) > 0)


def _bytes(raw: bytes, spans: np.ndarray) -> np.ndarray:
    """Byte spans of spans of words."""
    words = tk.words_of(np.frombuffer(raw, np.uint8), np.array([0, len(raw)]), lower=True, alnum=True)
    return np.stack([words.starts[spans[:, 0]], words.ends[spans[:, 1] - 1]], axis=1)


def _characters(raw: bytes, at: np.ndarray) -> np.ndarray:
    """Code points before byte positions."""
    lead = (np.frombuffer(raw, np.uint8) & 0xC0) != 0x80
    return np.concatenate(([0], np.cumsum(lead)))[at]


def without(text: str, spans: np.ndarray) -> str:
    """The text without spans of words, the rest joined by line breaks."""
    raw = text.encode()
    parts, at = [], 0
    for a, b in _bytes(raw, spans):
        parts.append(raw[at:a].strip())
        at = b
    return b"\n".join(p for p in [*parts, raw[at:].strip()] if p).decode()


def cleaned(texts: pa.Array, windows: Windows) -> dict[int, str]:
    """Texts that change: without any occurrence of a window, nor one that joining the rest would make."""
    fresh: dict[int, str] = {}
    rows = np.arange(len(texts))
    while len(rows):
        _, found = scan(texts, windows)
        new = [without(texts[i].as_py(), spans) for i, spans, _ in found]
        rows = rows[[i for i, *_ in found]]
        fresh.update(zip(rows.tolist(), new, strict=True))
        texts = pa.array(new, pa.string())
    return fresh


_HITS = "n_hit long, items array<string>, spans array<struct<start: long, end: long>>"
_SPANS = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))


def _described(texts: pa.Array, found: list[tuple[int, np.ndarray, list[str]]]) -> list[pa.Array]:
    """(n_hit, items, spans in code points) of each text."""
    n = len(texts)
    hits, items, spans = np.zeros(n, np.int64), [[]] * n, [[]] * n
    for row, words, own in found:
        raw = texts[row].as_py().encode()
        hits[row], items[row] = int((words[:, 1] - words[:, 0]).sum()), own
        spans[row] = [{"start": int(a), "end": int(b)} for a, b in _characters(raw, _bytes(raw, words))]
    return [pa.array(hits), pa.array(items, pa.list_(pa.string())), pa.array(spans, _SPANS)]


def _search(windows) -> Callable:
    """One pass with the only block of the benchmark."""

    def run(batches: Iterator) -> Iterator:
        for batch in batches:
            texts = batch.column("text")
            counts, found = scan(texts, windows.value)
            yield pa.record_batch([batch.column("k"), pa.array(counts), *_described(texts, found)], names=["k", "n_words", "n_hit", "items", "spans"])

    return tk.releasing(run)


def _hits(windows, key: list[str]) -> Callable:
    """(key, words, found): the texts that a block of the benchmark hits, their word spans and items."""

    def run(batches: Iterator) -> Iterator:
        for batch in batches:
            _, found = scan(batch.column("text"), windows.value)
            rows = pa.array([row for row, *_ in found], pa.int64())
            own = [pa.array([words.astype(np.int64).tobytes() for _, words, _ in found], pa.binary()), pa.array([items for *_, items in found], pa.list_(pa.string()))]
            yield pa.record_batch([*(batch.column(c).take(rows) for c in key), *own], names=[*key, "words", "found"])

    return tk.releasing(run)


def _together(hits: list | None) -> tuple[np.ndarray, list[str]] | None:
    """The word spans and items of all blocks' hits of a text."""
    if not hits:
        return None
    return _united([np.frombuffer(h["words"], np.int64).reshape(-1, 2) for h in hits]), sorted({i for h in hits for i in h["found"]})


def _total(batches: Iterator) -> Iterator:
    """What all blocks hit of each text."""
    for batch in batches:
        texts, counts = batch.column("text"), np.zeros(batch.num_rows, np.int64)
        for row, end, data, offsets in tk.chunks(texts):
            counts[row:end] = np.diff(tk.words_of(data, offsets, lower=True, alnum=True).first)
        all_hits = [_together(h) for h in batch.column("hits").to_pylist()]
        found = [(i, *h) for i, h in enumerate(all_hits) if h]
        yield pa.record_batch([batch.column("k"), pa.array(counts), *_described(texts, found)], names=["k", "n_words", "n_hit", "items", "spans"])


def _cut_hits(batches: Iterator) -> Iterator:
    for batch in batches:
        new = [without(t, _together(h)[0]) for t, h in zip(batch.column("text").to_pylist(), batch.column("hits").to_pylist(), strict=True)]
        yield pa.record_batch([batch.column("key"), pa.array(new, pa.string())], names=["key", "text"])


def _cut(windows, text_col: str) -> Callable:
    def run(batches: Iterator) -> Iterator:
        for batch in batches:
            at = batch.schema.get_field_index(text_col)
            texts = batch.column(at)
            new = cleaned(texts, windows.value)
            fresh = [new.get(i) for i in range(len(texts))]
            whole = pc.if_else(pa.array([f is None for f in fresh], pa.bool_()), texts, pa.array(fresh, texts.type))
            yield pa.record_batch([whole if i == at else batch.column(i) for i in range(batch.num_columns)], names=batch.schema.names)

    return tk.releasing(run)


def _blocks(benchmark: DataFrame, item_col: str, text_col: str, limit: int) -> list[DataFrame]:
    """The benchmark in parts of about ``limit`` bytes each, none of which is dropped."""
    items = benchmark.select(F.coalesce(benchmark[item_col].cast("string"), F.lit("")).alias("item"), benchmark[text_col].cast("string").alias("text")).where("text is not null")
    size = items.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).first()[0]
    n = max(1, -(-size // limit))
    return [items.where(F.pmod(F.xxhash64("item", "text"), F.lit(n)) == b) if n > 1 else items for b in range(n)]


def find_contamination(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text: str = "text", window: int = 10, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """Words of documents that lie in an occurrence of a benchmark window.

    Words are runs of lower-cased letters and digits (and everything beyond ASCII). A window is ``window`` consecutive
    words of an item; a shorter item is one window, one without words none. Returns one row a document: ``id_col``,
    n_words, n_hit, items (ids as strings, sorted), spans (merged, in code points, end exclusive).

    Null texts and items have no words. A null id is kept as null, a null item id reads as an empty string. Rows
    that repeat an id are judged one by one. Extra columns are ignored. Without items or documents nothing is hit.
    The result does not depend on ``block_bytes``, the size of a block of the benchmark.
    """
    base, blocks = keyed(docs, id_col, text_col), _blocks(benchmark, item_col, item_text, block_bytes)
    if len(blocks) == 1:
        out = base.mapInArrow(_search(_sent(blocks[0], window)), f"k long, n_words long, {_HITS}")
    else:
        key = ["k", "th"]
        texts = base.withColumn("th", F.sha2("text", 256))
        hits = _all_hits(texts, key, blocks, window, Scratch(docs.sparkSession, "leaks"))
        out = texts.join(hits, key, "left").select("k", "text", "hits").mapInArrow(_total, f"k long, n_words long, {_HITS}")
    return out.select(shown().alias(id_col), "n_words", "n_hit", "items", "spans")


def remove_contamination(docs: DataFrame, benchmark: DataFrame, text_col: str = "text", item_col: str = "item_id", item_text: str = "text", window: int = 10, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """``docs`` with every occurrence of a benchmark window cut out of the texts; the rest is joined by line breaks.

    A text that has none stays as it is, to the byte. Windows that joining the rest would form are cut as well: all windows of all
    blocks of the benchmark are judged on one text, which is then cut, until nothing is hit, so the result does not depend
    on ``block_bytes``. Columns and rows stay, whatever their names; a null text stays null, rows that repeat are cut alike, and an empty table or
    benchmark changes nothing.
    """
    blocks = _blocks(benchmark, item_col, item_text, block_bytes)
    if len(blocks) == 1:
        return docs.mapInArrow(_cut(_sent(blocks[0], window), text_col), docs.schema)
    scratch, key = Scratch(docs.sparkSession, "leaks"), F.sha2(docs[text_col].cast("string"), 256)
    left = docs.select(key.alias("key"), docs[text_col].cast("string").alias("text")).where("text is not null")
    changed = None
    while True:
        hits = _all_hits(left, ["key"], blocks, window, scratch)
        left = scratch.write(left.join(hits, "key").dropDuplicates(["key"]).select("key", "text", "hits").mapInArrow(_cut_hits, "key string, text string"), "cut")
        if left.isEmpty():
            break
        changed = left if changed is None else scratch.write(changed.join(left.select("key"), "key", "left_anti").unionByName(left), "changed")
    if changed is None:
        return docs
    # columns are named by place, so that none of the caller's can clash
    names = [f"c{i}" for i in range(len(docs.columns))]
    own, at = docs.toDF(*names), names[docs.columns.index(text_col)]
    fresh = changed.select(F.col("key").alias("fresh_key"), F.col("text").alias("fresh"))
    out = own.join(fresh, F.sha2(F.col(at).cast("string"), 256) == F.col("fresh_key"), "left")
    return out.select(*(F.coalesce("fresh", c).alias(n) if c == at else F.col(c).alias(n) for c, n in zip(names, docs.columns, strict=True)))


def _all_hits(texts: DataFrame, key: list[str], blocks: list[DataFrame], window: int, scratch: Scratch) -> DataFrame:
    """(key, hits): what each block of the benchmark hits of the texts, a pass a block; one block is in memory at a time."""
    passes = []
    for block in blocks:
        sent = _sent(block, window)
        kinds = ", ".join(f"{c} {texts.schema[c].dataType.simpleString()}" for c in key)
        found = texts.mapInArrow(_hits(sent, key), f"{kinds}, words binary, found array<string>")
        # rows that repeat an id and a text have the same hits
        passes.append(scratch.write(found.groupBy(*key).agg(F.first(F.struct("words", "found")).alias("hit")), "hits"))
        sent.destroy()
    return reduce(DataFrame.union, passes).groupBy(*key).agg(F.collect_list("hit").alias("hits"))


def _blocks(benchmark: DataFrame, item_col: str, text_col: str, limit: int) -> list[DataFrame]:
    """The benchmark in parts of about ``limit`` bytes each, none of which is dropped."""
    items = benchmark.select(F.coalesce(benchmark[item_col].cast("string"), F.lit("")).alias("item"), benchmark[text_col].cast("string").alias("text")).where("text is not null")
    size = items.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).first()[0]
    n = max(1, -(-size // limit))
    return [items.where(F.pmod(F.xxhash64("item", "text"), F.lit(n)) == b) if n > 1 else items for b in range(n)]


def _sent(block: DataFrame, window: int):
    """A block of items, collected (its size is bounded) and sent to the executors."""
    return block.sparkSession.sparkContext.broadcast(Windows([(r["item"], r["text"]) for r in block.collect()], window))
