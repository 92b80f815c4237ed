"""Exact substring deduplication by recompression.

The words of the corpus are parsed in rounds, and Spark names what each round makes: first every distinct word and every distinct
run of one word, then, round after round, every distinct pair of neighbours that become one symbol. A name is a number given
once in the corpus, by the words themselves or by the two names in a pair, so equal names mean equal words and nothing
rests on a hash. What occurs once in the corpus gets the name 0 and pairs no more.

A bit of a symbol's name says whether it is a left or a right one, and a left one pairs with a right one behind it. So every
decision depends on the neighbours alone, and two equal passages are parsed alike but for a zone at their ends: the first and the last run may go on
outside, and each round adds the length of one symbol, 2 ** rounds runs in all at either end. The symbols of a window
beyond these zones are its interior; they are the same wherever its words occur (tests compare equal windows in random texts).

So a window with an interior symbol of name 0 occurs once and is done. Of any other, the longest interior symbol (of these the first in a fixed
mixed order of names) is its anchor, and equal windows have equal anchors: the shared high-level symbol is where they meet. Each run of
neighbouring windows with one anchor is sent to the anchor's shard as the names of its words, where equal windows are found by comparing
these, one by one. A window without an interior, in the midst of long runs, is its own anchor. In each set of equal windows the
smallest (id, start) stays.

Documents travel in compressed blocks. A block asks each shard for the names of its own distinct items, so that the commonest item
costs a shard one entry a block, and settles windows that it holds twice itself: a passage that a third of all documents hold
is one window a block where it meets. There is a row for each block and shard that have items in common, never more rows than items. Every round's table is written
to the shared folder, and the last round's goes when the next is there.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomlake.llm import textkit as tk
from loomlake.llm.frames import keyed, partitions, shown
from loomlake.scratch import Scratch

U = np.uint64
#: Text of a block, in bytes; a longer document is a block of its own.
BLOCK = 8_000_000
#: Bytes of a name that is sent: room for 2 ** 48 names of what occurs twice.
WIDE = 6
_ASK = ("shard", "block", "n", "a", "b", "c", "d", "e")
_KINDS = (pa.int32(), pa.int64(), pa.int32(), *[pa.binary()] * 5)
_ASKED = "shard int, block long, n int, a binary, b binary, c binary, d binary, e binary"
_STATE = ("block", "ks", "sizes", "words", "runs", "pairs")
_STATED = "block long, ks binary, sizes binary, words binary, runs binary, pairs array<binary>"


def rounds(window: int) -> int:
    """Rounds of pairs after which a window without runs still has an interior symbol."""
    return max(1, int(np.log2((window + 1) / 4)))


class Symbols(NamedTuple):
    """The symbols of a block's documents after some rounds: names, first and end run of each, document."""

    names: np.ndarray
    first: np.ndarray
    end: np.ndarray
    doc: np.ndarray


def _run_heads(words: np.ndarray, doc: np.ndarray) -> np.ndarray:
    """Where runs of one word begin; a word of name 0 is no other's equal."""
    return np.flatnonzero(np.append(True, (words[1:] != words[:-1]) | (doc[1:] != doc[:-1]) | (words[1:] == 0))) if len(words) else np.empty(0, np.int64)


def first_symbols(words: np.ndarray, doc: np.ndarray, runs: np.ndarray) -> tuple[Symbols, np.ndarray]:
    """Symbols that are runs, named by their word or, if longer, by the next of ``runs``; and where each begins."""
    heads = _run_heads(words, doc)
    names = words[heads]
    names[np.diff(np.append(heads, len(words))) > 1] = runs
    n = np.arange(len(heads))
    return Symbols(names, n, n + 1, doc[heads]), heads


def pairs_of(s: Symbols) -> np.ndarray:
    """Where a left symbol is followed by a right one of the same document."""
    right = (tk.mix(s.names + U(0x5BD1E995)) & U(1)).astype(bool)
    known = s.names != 0
    return np.flatnonzero(~right[:-1] & right[1:] & known[:-1] & known[1:] & (s.doc[1:] == s.doc[:-1]))


def paired(s: Symbols, at: np.ndarray, names: np.ndarray) -> Symbols:
    """The symbols after those at ``at`` have taken up the next ones, under new names."""
    out, end = s.names.copy(), s.end.copy()
    out[at], end[at] = names, s.end[at + 1]
    keep = np.ones(len(out), bool)
    keep[at + 1] = False
    return Symbols(out[keep], s.first[keep], end[keep], s.doc[keep])


def anchors(words: np.ndarray, first: np.ndarray, s: Symbols, heads: np.ndarray, window: int, zone: int) -> tuple[np.ndarray, np.ndarray]:
    """(starts, symbols): the windows that may occur twice and the anchor of each, -1 for one that is its own."""
    n = len(words)
    size = np.diff(first)
    left = np.repeat(first[1:], size) - np.arange(n)
    zero = np.concatenate(([0], np.cumsum(words == 0)))
    at = np.flatnonzero(left >= window)
    at = at[zero[at + window] == zero[at]]
    run = np.zeros(n, np.int64)
    run[heads] = 1
    run = np.cumsum(run) - 1
    p = np.searchsorted(s.first, run[at] + zone)
    q = np.searchsorted(s.end, run[at + window - 1] + 1 - zone, "right")
    once = np.concatenate(([0], np.cumsum(s.names == 0)))
    live = (q <= p) | (once[np.maximum(p, q)] == once[p])
    at, p, q = at[live], p[live], q[live]
    ends = np.append(heads, n)
    length = np.minimum(ends[s.end] - ends[s.first], 63).astype(U)
    key = ((U(63) - length) << U(58)) | (tk.mix(s.names) >> U(6))
    best, which = np.full(len(at), U(2**64 - 1)), np.full(len(at), -1, np.int64)
    for j in range(int((q - p).max(initial=0))):
        has = np.flatnonzero(p + j < q)
        better = has[key[p[has] + j] < best[has]]
        best[better], which[better] = key[p[better] + j], p[better] + j
    return at, which


def same_windows(words: np.ndarray, starts: np.ndarray, window: int) -> tuple[np.ndarray, np.ndarray]:
    """(ids, hashes) of windows; ids are equal where all words are, compared one by one."""
    hashes = tk.grams(tk.mix(words), window)[starts]

    def same(x: np.ndarray, y: np.ndarray) -> np.ndarray:
        left, right = starts[x], starts[y]
        out = np.ones(len(x), bool)
        for j in range(window):
            out &= words[left + j] == words[right + j]
        return out

    return tk.told_apart(hashes, same)[0], hashes


def _heads_of(ids: np.ndarray, k: np.ndarray, at: np.ndarray) -> np.ndarray:
    """For each window an equal one with the smallest (id, start)."""
    order = np.lexsort((at, k, ids))
    new = np.append(True, ids[order][1:] != ids[order][:-1]) if len(ids) else np.empty(0, bool)
    out = np.empty(len(ids), np.int64)
    out[order] = order[np.flatnonzero(new)][np.cumsum(new) - 1]
    return out


def _rows(rows: list[tuple]) -> pa.RecordBatch:
    return pa.record_batch([pa.array([r[i] for r in rows], t) for i, t in enumerate(_KINDS)], names=_ASK)


def _by_shard(shard: np.ndarray) -> Iterator[tuple[int, np.ndarray]]:
    """(shard, places) of each shard, places in their order."""
    if not len(shard):
        return
    order = np.argsort(shard, kind="stable")
    cut = np.flatnonzero(np.append(True, np.diff(shard[order]) != 0))
    for x, y in zip(cut, [*cut[1:], len(order)], strict=True):
        yield int(shard[order[x]]), order[x:y]


# --- words and runs ------------------------------------------------------------------------------------------------------------


class Items(NamedTuple):
    """A block's words, and its distinct items by shard: its words, then its runs of two or more."""

    words: tk.Words
    data: np.ndarray
    word: np.ndarray  # of each word its item
    run: np.ndarray  # of each longer run its item
    starts: np.ndarray  # of each item a place of its word
    ends: np.ndarray
    length: np.ndarray
    shard: np.ndarray
    count: np.ndarray


def _items(sizes: np.ndarray, texts: bytes, shards: int) -> Items:
    offsets = np.concatenate([[0], np.cumsum(sizes)]).astype(np.int64)
    data = np.frombuffer(pa.decompress(texts, int(offsets[-1]), codec="zstd", asbytes=True) if offsets[-1] else b"", np.uint8)
    words = tk.words_of(data, offsets)
    ids, firsts = tk.interned(words, data)
    heads = _run_heads(ids.astype(U) + U(1), words.doc)
    size = np.diff(np.append(heads, len(ids)))
    heads, size = heads[size > 1], size[size > 1]
    _, where, run = np.unique(ids[heads] * (size.max(initial=0) + 1) + size, return_index=True, return_inverse=True)
    place = np.concatenate([firsts, heads[where]]).astype(np.int64)
    length = np.concatenate([np.ones(len(firsts), np.int64), size[where]])
    names = tk.mix(words.names[place] + length.astype(U) * U(0x9E3779B97F4A7C15))
    count = np.concatenate([np.bincount(ids, minlength=len(firsts)), np.bincount(run, minlength=len(where))])
    return Items(words, data, ids, run + len(firsts), words.starts[place], words.ends[place], length, (names % U(shards)).astype(np.int64), count)


def _pack(batches: Iterator) -> Iterator:
    """(ks, sizes, texts): ids, byte lengths and compressed texts of a block of documents."""
    for batch in batches:
        ids = batch.column("k").to_numpy(zero_copy_only=False).astype(np.int64)
        for row, end, data, offsets in tk.chunks(batch.column("text"), BLOCK):
            one = (ids[row:end].tobytes(), np.diff(offsets).astype(np.int64).tobytes(), pa.compress(data.tobytes(), codec="zstd", asbytes=True))
            yield pa.record_batch([pa.array([x], pa.binary()) for x in one], names=["ks", "sizes", "texts"])


def _ask_words(shards: int) -> Callable:
    """The distinct words and runs of each block, by shard: bytes, lengths of words and of runs, and which the block has twice."""

    def run(batches: Iterator) -> Iterator:
        for batch in batches:
            for block, sizes, texts in zip(*(batch.column(c).to_pylist() for c in ("block", "sizes", "texts")), strict=True):
                it, rows = _items(np.frombuffer(sizes, np.int64), texts, shards), []
                for s, own in _by_shard(it.shard):
                    size = it.ends[own] - it.starts[own]
                    raw = it.data[tk.expand(it.starts[own], it.ends[own])].tobytes()
                    rows.append((s, block, len(own), pa.compress(raw, codec="zstd", asbytes=True), tk.shut(size, 5), tk.shut(it.length[own], 5), tk.shut(it.count[own] > 1, 1), None))
                if rows:
                    yield _rows(rows)

    return tk.releasing(run)


class Naming(NamedTuple):
    """How names are dealt: no two shards and no two turns (words and runs, then each round of pairs) give the same."""

    shards: int
    turn: int
    turns: int

    def given(self, ids: np.ndarray, twice: np.ndarray, shard: int) -> np.ndarray:
        """Names from 1 for ids that occur twice, in one block or in two; 0 for others."""
        n = np.bincount(ids)
        n[ids[twice]] += 1
        serial = np.arange(len(n), dtype=U) * U(self.shards) + U(shard)
        return np.where(n > 1, U(1 + self.turn) + serial * U(self.turns), U(0))[ids]


def _gathered(batches: Iterator) -> Iterator[tuple[int, list[list]]]:
    """All that was sent to each shard of a task."""
    held: dict[int, list] = {}
    for batch in batches:
        for shard, *rest in zip(*(batch.column(c).to_pylist() for c in _ASK), strict=True):
            held.setdefault(shard, []).append(rest)
    for shard in sorted(held):
        yield shard, sorted(held.pop(shard), key=lambda r: r[0])


def _answers(shard: int, asked: list[list], names: np.ndarray) -> Iterator[pa.RecordBatch]:
    rows = [(r[0], shard, tk.shut(own, WIDE)) for r, own in zip(asked, np.split(names, np.cumsum([r[1] for r in asked])[:-1]), strict=True)]
    for x in range(0, len(rows), 1000):
        yield pa.record_batch([pa.array(list(c), t) for c, t in zip(zip(*rows[x : x + 1000], strict=True), (pa.int64(), pa.int32(), pa.binary()), strict=True)], names=["block", "shard", "names"])


def _name_words(naming: Naming) -> Callable:
    """Names of the words and runs that blocks ask for: equal ones have equal bytes and lengths."""

    def run(batches: Iterator) -> Iterator:
        for shard, asked in _gathered(batches):
            sizes = [tk.opened(r[3], r[1], 5, np.int64) for r in asked]
            raw = [pa.decompress(r[2], int(n.sum()), codec="zstd", asbytes=True) if n.sum() else b"" for r, n in zip(asked, sizes, strict=True)]
            data, size = np.frombuffer(b"".join(raw), np.uint8), np.concatenate(sizes)
            length, twice = (np.concatenate([tk.opened(r[i], r[1], w, kind) for r in asked]) for i, w, kind in ((4, 5, np.int64), (5, 1, np.bool_)))
            ends = np.cumsum(size)
            starts = ends - size
            names = tk.mix(tk.word_names(data, starts, ends) + length.astype(U) * U(0x9E3779B97F4A7C15))
            ids, _ = tk.told_apart(names, lambda x, y: (length[x] == length[y]) & tk.same_bytes(data, starts, ends, x, y))  # noqa: B023
            yield from _answers(shard, asked, naming.given(ids, twice, shard))

    return tk.releasing(run)


# --- pairs ---------------------------------------------------------------------------------------------------------------------


class Distinct(NamedTuple):
    """A block's distinct pairs, by shard, and of each place its own."""

    left: np.ndarray
    right: np.ndarray
    which: np.ndarray
    shard: np.ndarray
    twice: np.ndarray


def _distinct(s: Symbols, at: np.ndarray, shards: int) -> Distinct:
    a, b = s.names[at], s.names[at + 1]
    ids, firsts = tk.told_apart(tk.mix(tk.mix(a) + b), lambda x, y: (a[x] == a[y]) & (b[x] == b[y]))
    # by left name, so that differences are small
    order = np.lexsort((b[firsts], a[firsts]))
    place = np.empty(len(order), np.int64)
    place[order] = np.arange(len(order))
    a, b, count = a[firsts[order]], b[firsts[order]], np.bincount(ids, minlength=len(firsts))[order]
    return Distinct(a, b, place[ids] if len(ids) else ids, (tk.mix(tk.mix(a) + b) >> U(32)) % U(shards), count > 1)


def _pair_rows(block: int, d: Distinct) -> list[tuple]:
    return [(s, block, len(own), tk.shut(np.diff(d.left[own], prepend=U(0)), WIDE), tk.shut(d.right[own], WIDE), tk.shut(d.twice[own], 1), None, None) for s, own in _by_shard(d.shard)]


def _name_pairs(naming: Naming) -> Callable:
    """Names of the pairs that blocks ask for: equal ones have equal names on both sides."""

    def run(batches: Iterator) -> Iterator:
        for shard, asked in _gathered(batches):
            a = np.concatenate([np.cumsum(tk.opened(r[2], r[1], WIDE, U), dtype=U) for r in asked])
            b, twice = (np.concatenate([tk.opened(r[i], r[1], w, kind) for r in asked]) for i, w, kind in ((3, WIDE, U), (4, 1, np.bool_)))
            ids, _ = tk.told_apart(tk.mix(tk.mix(a) + b), lambda x, y: (a[x] == a[y]) & (b[x] == b[y]))  # noqa: B023
            yield from _answers(shard, asked, naming.given(ids, twice, shard))

    return tk.releasing(run)


def _answered(shard: np.ndarray, answers: list[dict] | None) -> np.ndarray:
    """The names that shards gave, in the order of a block's items."""
    out = np.zeros(len(shard), U)
    blobs = {a["shard"]: a["names"] for a in answers or []}
    for s, own in _by_shard(shard):
        out[own] = tk.opened(blobs[s], len(own), WIDE, U)
    return out


def _doc(first: np.ndarray) -> np.ndarray:
    return np.repeat(np.arange(len(first) - 1), np.diff(first))


def _parsed(sizes: bytes, words: bytes, runs: bytes, pairs: list[bytes]) -> tuple[np.ndarray, np.ndarray, Symbols, np.ndarray]:
    """(words, first word of each document, symbols, where runs begin) after as many rounds as there are answers."""
    first = np.concatenate([[0], np.cumsum(np.frombuffer(sizes, np.int64))])
    names = tk.opened(words, int(first[-1]), WIDE, U)
    heads = _run_heads(names, doc := _doc(first))
    s, heads = first_symbols(names, doc, tk.opened(runs, int((np.diff(np.append(heads, len(names))) > 1).sum()), WIDE, U))
    for blob in pairs:
        at = pairs_of(s)
        s = paired(s, at, tk.opened(blob, len(at), WIDE, U))
    return names, first, s, heads


def _stage(kind: int, state: tuple | None, asks: list[tuple]) -> pa.RecordBatch:
    """A block's state (kind 0) and what it asks (kind 1), as rows of one table."""
    rows = [(0, None, None, None, None, None, None, None, *state)] if state else []
    rows += [(kind, r[0], r[2], *r[3:], r[1], *[None] * 5) for r in asks]
    kinds = (pa.int32(), pa.int32(), pa.int32(), *[pa.binary()] * 5, pa.int64(), *[pa.binary()] * 4, pa.list_(pa.binary()))
    return pa.record_batch([pa.array([r[i] for r in rows], t) for i, t in enumerate(kinds)], names=["kind", "shard", "n", "a", "b", "c", "d", "e", *_STATE])


_STAGED = f"kind int, shard int, n int, a binary, b binary, c binary, d binary, e binary, {_STATED}"


def _first_round(shards: int) -> Callable:
    """Blocks with the names of their words and runs ask for their pairs."""

    def run(batches: Iterator) -> Iterator:
        for batch in batches:
            for block, ks, sizes, texts, answers in zip(*(batch.column(c).to_pylist() for c in ("block", "ks", "sizes", "texts", "answers")), strict=True):
                it = _items(np.frombuffer(sizes, np.int64), texts, shards)
                named = _answered(it.shard, answers)
                words, runs = named[it.word], named[it.run]
                s, _ = first_symbols(words, it.words.doc, runs)
                state = (block, ks, np.diff(it.words.first).astype(np.int64).tobytes(), tk.shut(words, WIDE), tk.shut(runs, WIDE), [])
                yield _stage(1, state, _pair_rows(block, _distinct(s, pairs_of(s), shards)))

    return tk.releasing(run)


def _next_round(shards: int) -> Callable:
    def run(batches: Iterator) -> Iterator:
        for batch in batches:
            for block, ks, sizes, words, runs, pairs, answers in zip(*(batch.column(c).to_pylist() for c in (*_STATE, "answers")), strict=True):
                _, _, s, _ = _parsed(sizes, words, runs, pairs)
                d = _distinct(s, at := pairs_of(s), shards)
                names = _answered(d.shard, answers)[d.which]
                pairs = [*pairs, tk.shut(names, WIDE)]
                s = paired(s, at, names)
                yield _stage(1, (block, ks, sizes, words, runs, pairs), _pair_rows(block, _distinct(s, pairs_of(s), shards)))

    return tk.releasing(run)


# --- windows -------------------------------------------------------------------------------------------------------------------


def _ask_windows(shards: int, window: int) -> Callable:
    """The windows that may occur twice, by the shard of their anchors; those that follow an equal one in their block are settled (kind 2)."""

    def run(batches: Iterator) -> Iterator:
        for batch in batches:
            for block, ks, sizes, words, runs, pairs, answers in zip(*(batch.column(c).to_pylist() for c in (*_STATE, "answers")), strict=True):
                names, first, s, heads = _parsed(sizes, words, runs, pairs)
                d = _distinct(s, at := pairs_of(s), shards)
                s = paired(s, at, _answered(d.shard, answers)[d.which])
                starts, anchor = anchors(names, first, s, heads, window, 2 ** (len(pairs) + 1))
                if not len(starts):
                    continue
                ids, hashes = same_windows(names, starts, window)
                doc = _doc(first)[starts]
                k, own = np.frombuffer(ks, np.int64)[doc], starts - first[doc]
                head = _heads_of(ids, k, own)
                later = (k != k[head]) | (own != own[head])
                rows = [(0, block, int(later.sum()), tk.shut(np.diff(starts[later], prepend=0), 5), None, None, None, None)] if later.any() else []
                yield _stage(2, None, rows)
                starts, anchor, doc, k, own, hashes = (x[~later] for x in (starts, anchor, doc, k, own, hashes))
                new = np.append(True, (np.diff(starts) != 1) | (np.diff(anchor) != 0) | (anchor[1:] < 0) | (np.diff(doc) != 0))
                begin = np.flatnonzero(new)
                many = np.diff(np.append(begin, len(starts)))
                to = np.where(anchor[begin] >= 0, tk.mix(s.names[anchor[begin]] + U(77)), tk.mix(hashes[begin] + U(99))) % U(shards)
                rows = []
                for shard, part in _by_shard(to.astype(np.int64)):
                    at = begin[part]
                    sent = names[tk.expand(starts[at], starts[at] + many[part] + window - 1)]
                    rows.append((shard, block, len(part), tk.shut(many[part], 5), tk.shut(k[at], 8), tk.shut(own[at], 5), tk.shut(starts[at], 5), tk.shut(sent, WIDE)))
                yield _stage(1, None, rows)

    return tk.releasing(run)


def _meet(window: int) -> Callable:
    """(block, n, later): of equal windows in a shard all but the smallest (id, start), as places in their blocks."""

    def run(batches: Iterator) -> Iterator:
        for _, asked in _gathered(batches):
            many = [tk.opened(r[2], r[1], 5, np.int64) for r in asked]
            words = np.concatenate([tk.opened(r[6], int(m.sum() + len(m) * (window - 1)), WIDE, U) for r, m in zip(asked, many, strict=True)])
            block = np.repeat(np.arange(len(asked)), [m.sum() for m in many])
            k, own, place = (np.concatenate([tk.opened(r[i], r[1], w, np.int64) for r in asked]) for i, w in ((3, 8), (4, 5), (5, 5)))
            many = np.concatenate(many)
            starts = tk.expand(end := np.cumsum(many + window - 1) - many - window + 1, end + many)
            step = tk.expand(np.zeros(len(many), np.int64), many)
            k, own, place = np.repeat(k, many), np.repeat(own, many) + step, np.repeat(place, many) + step
            head = _heads_of(same_windows(words, starts, window)[0], k, own)
            later = np.flatnonzero((k != k[head]) | (own != own[head]))
            rows = [(asked[b][0], len(at), tk.shut(np.diff(np.sort(place[later[at]]), prepend=0), 5)) for b, at in _by_shard(block[later])]
            for x in range(0, len(rows), 1000):
                yield pa.record_batch([pa.array(list(c), t) for c, t in zip(zip(*rows[x : x + 1000], strict=True), (pa.int64(), pa.int32(), pa.binary()), strict=True)], names=["block", "n", "later"])

    return tk.releasing(run)


def _finish(window: int) -> Callable:
    """Each document of a block without the words of its later windows."""

    def run(batches: Iterator) -> Iterator:
        for batch in batches:
            for ks, sizes, texts, later in zip(*(batch.column(c).to_pylist() for c in ("ks", "sizes", "texts", "later")), strict=True):
                offsets = np.concatenate([[0], np.cumsum(np.frombuffer(sizes, np.int64))])
                data = np.frombuffer(pa.decompress(texts, int(offsets[-1]), codec="zstd", asbytes=True) if offsets[-1] else b"", np.uint8)
                words = tk.words_of(data, offsets)
                n = len(words.names)
                starts = np.concatenate([np.cumsum(tk.opened(x["later"], x["n"], 5, np.int64)) for x in later or []] or [np.empty(0, np.int64)])
                drop = tk.spans_union(starts, window, n)
                keep = np.flatnonzero(~drop)
                # stretches of kept words within a document, cut out of the text at once
                doc = words.doc[keep]
                cut = np.flatnonzero(np.append(True, (np.diff(keep) != 1) | (np.diff(doc) != 0))[: len(keep)])
                last = np.append(cut[1:], len(keep))[: len(cut)] - 1
                parts: list[list[bytes]] = [[] for _ in sizes[::8]]
                for d, a, b in zip(doc[cut].tolist(), words.starts[keep[cut]].tolist(), words.ends[keep[last]].tolist(), strict=True):
                    parts[d] += data[a:b].tobytes().split()
                gone = np.add.reduceat(np.append(drop, False).astype(np.int64), words.first[:-1]) * (np.diff(words.first) > 0) if n else np.zeros(len(offsets) - 1, np.int64)
                out = [pa.array(np.frombuffer(ks, np.int64)), pa.array(np.diff(words.first).astype(np.int64)), pa.array(gone.astype(np.int64)), pa.array([b" ".join(p).decode() for p in parts], pa.string())]
                yield pa.record_batch(out, names=["k", "n_words", "n_removed", "kept_text"])

    return tk.releasing(run)


def remove_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", window: int = 20) -> DataFrame:
    """Remove each word that a window of ``window`` words covers whose words also start earlier.

    Earlier means a smaller id, or the same id and a smaller start. Windows are judged on the input.
    Returns one row a document: ``id_col``, n_words, n_removed, kept_text (kept words joined by one space).

    Null text has no words. A null id counts as the largest. Rows that repeat an id and a text are the same
    document and keep or lose the same words; of two texts under one id, windows at the same start are not
    earlier than each other. Ties cannot occur otherwise. Documents shorter than a window stay whole. Extra
    columns are ignored. An empty table gives an empty result.
    """
    if window < 1:
        raise ValueError("a window has one word at least")
    n, scratch = partitions(docs), Scratch(docs.sparkSession, "substring")
    packed = keyed(docs, id_col, text_col).mapInArrow(_pack, "ks binary, sizes binary, texts binary")
    blocks = scratch.write(packed.withColumn("block", F.monotonically_increasing_id()), "blocks")

    def home(rows: DataFrame, name: str, *columns: str) -> DataFrame:
        return rows.groupBy("block").agg(F.collect_list(F.struct(*columns)).alias(name))

    def named(asked: DataFrame, by: Callable) -> DataFrame:
        given = asked.select(*_ASK).repartition(n, "shard").mapInArrow(by, "block long, shard int, names binary")
        return home(given, "answers", "shard", "names")

    turns = rounds(window) + 1
    words = named(blocks.mapInArrow(_ask_words(n), _ASKED), _name_words(Naming(n, 0, turns)))
    staged = scratch.write(blocks.join(words.hint("merge"), "block", "left").select("block", "ks", "sizes", "texts", "answers").mapInArrow(_first_round(n), _STAGED), "round")
    for turn in range(1, turns):
        last = turn == turns - 1
        pairs = named(staged.where("kind = 1"), _name_pairs(Naming(n, turn, turns)))
        asked = staged.where("kind = 0").select(*_STATE).join(pairs.hint("merge"), "block", "left")
        done, staged = staged, scratch.write(asked.mapInArrow(_ask_windows(n, window) if last else _next_round(n), _STAGED), "round")
        scratch.drop(done)
    met = staged.where("kind = 1").select(*_ASK).repartition(n, "shard").mapInArrow(_meet(window), "block long, n int, later binary")
    settled = staged.where("kind = 2").select("block", "n", F.col("a").alias("later"))
    out = blocks.join(home(met.unionByName(settled), "later", "n", "later").hint("merge"), "block", "left")
    out = out.select("ks", "sizes", "texts", "later").mapInArrow(_finish(window), "k long, n_words long, n_removed long, kept_text string")
    return out.select(shown().alias(id_col), "n_words", "n_removed", "kept_text")
