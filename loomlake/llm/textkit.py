"""Word and n-gram hashing over whole Arrow batches of UTF-8 text.

Everything here works on the bytes of many documents at once with numpy, so that a Python worker
spends a few nanoseconds a byte and builds no Python strings. Words are byte runs between
separators; their 64-bit names mix eight bytes at a time, each step depending on all before it, and
are equal on every machine. Names find candidates; ``interned`` tells words apart by their bytes,
and ``interned_grams`` sequences of words by those, where a result rests on it.
"""

from __future__ import annotations

import ctypes
import functools
import hashlib
from collections.abc import Callable, Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa

U = np.uint64
_MIX_A, _MIX_B = U(0xFF51AFD7ED558CCD), U(0xC4CEB9FE1A85EC53)
_LANE_A, _LANE_B, _GRAM = U(0x9E3779B97F4A7C15), U(0xD6E8FEB86659FD93), U(0xA3B195354A39B70D)
#: Words of more bytes than this are named one by one, by a cryptographic digest.
_LONG = 64
#: Text handled at once, in bytes; one document may exceed it.
CHUNK = 2_000_000

_WHITE = np.zeros(256, bool)
_WHITE[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True
_NOT_ALNUM = np.ones(256, bool)
_NOT_ALNUM[list(range(0x30, 0x3A)) + list(range(0x41, 0x5B)) + list(range(0x61, 0x7B)) + list(range(0x80, 0x100))] = False
_LOWERED = np.arange(256, dtype=np.uint8)
_LOWERED[0x41:0x5B] += 0x20
#: The first n of eight bytes.
_FIRST = np.array([0, *(2 ** (8 * n) - 1 for n in range(1, 9))], U)


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit values that spreads every input bit."""
    x = x ^ (x >> U(33))
    x = x * _MIX_A
    x ^= x >> U(33)
    x *= _MIX_B
    x ^= x >> U(33)
    return x


def lowered(data: np.ndarray) -> np.ndarray:
    """The bytes with A-Z as a-z."""
    return _LOWERED[data]


def _eights(data: np.ndarray) -> np.ndarray:
    """The eight bytes from each place on, with zeros behind the end; the places overlap in memory."""
    return np.ndarray(len(data) + 1, U, np.concatenate([data, np.zeros(8, np.uint8)]), strides=(1,))


def word_names(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """64-bit names of byte runs: two states of 64 bits take up eight bytes a step and are mixed into one."""
    lanes, size = _eights(data), ends - starts
    x = lanes[starts] & _FIRST[np.minimum(size, 8)]
    a = mix(x + size.astype(U) * _LANE_A)
    at = np.flatnonzero(size > 8)
    if len(at):
        b = mix(x[at] * _LANE_B + U(1))
        more, top, left = a[at], int(min(size.max(), _LONG)), size[at]
        for j in range(8, top, 8):
            has = np.flatnonzero(left > j)
            y = lanes[starts[at[has]] + j] & _FIRST[np.minimum(left[has] - j, 8)]
            more[has], b[has] = mix(more[has] ^ y), mix(b[has] + y * _LANE_B)
        a[at] = mix(more + (b << U(29) | b >> U(35)))
        for i in at[left > _LONG]:
            a[i] = int.from_bytes(hashlib.blake2b(data[starts[i] : ends[i]].tobytes(), digest_size=8).digest(), "little")
    return a


class Words(NamedTuple):
    """Words of several documents: byte spans, 64-bit names, and the first word of each document."""

    starts: np.ndarray
    ends: np.ndarray
    names: np.ndarray
    first: np.ndarray  # len(docs) + 1

    @property
    def doc(self) -> np.ndarray:
        return np.repeat(np.arange(len(self.first) - 1), np.diff(self.first))

    @property
    def left(self) -> np.ndarray:
        """Words from each word to the end of its document, itself included."""
        return np.repeat(self.first[1:], np.diff(self.first)) - np.arange(len(self.names))


def words_of(data: np.ndarray, offsets: np.ndarray, lower: bool = False, alnum: bool = False) -> Words:
    """Words of the documents ``data[offsets[i]:offsets[i + 1]]``.

    Separators are ASCII white space, or with ``alnum`` every ASCII character but letters and digits.
    ``lower`` gives A-Z the names of a-z.
    """
    n = len(data)
    inside = ~(_NOT_ALNUM if alnum else _WHITE)[data]
    edge = np.zeros(n + 1, bool)
    edge[offsets] = True
    begins, stops = inside.copy(), inside.copy()
    begins[1:] &= ~inside[:-1] | edge[1:n]
    stops[:-1] &= ~inside[1:] | edge[1:n]
    starts, ends = np.flatnonzero(begins), np.flatnonzero(stops) + 1
    names = word_names(lowered(data) if lower else data, starts, ends)
    return Words(starts, ends, names, np.searchsorted(starts, offsets))


def grams(names: np.ndarray, k: int) -> np.ndarray:
    """The name of the k words from each position; the last k - 1 positions have none.

    Names of 1, 2, 4, ... words are made from two halves each, and put together to k.
    """
    n = len(names)
    if n < k or not k:
        return np.empty(0, U)
    part, size, out, have = names, 1, None, 0
    while True:
        if k & size:
            m = n - have - size + 1
            out = mix(part[:m] ^ U(k)) if out is None else mix(out[:m] * _GRAM + part[have : have + m])
            have += size
        if have == k:
            return out
        m = n - 2 * size + 1
        part = mix(part[:m] * _LANE_B + part[size : size + m])
        size *= 2


def told_apart(names: np.ndarray, same: Callable[[np.ndarray, np.ndarray], np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """(ids, firsts): dense ids of items, equal where ``same`` says so of items of one name, and a first item of each id.

    Items are compared with the first of their name; those that differ from it are compared among themselves, until none is left.
    """
    ids, firsts, left = np.empty(len(names), np.int64), [], np.arange(len(names))
    n = 0
    while len(left):
        _, first, which = np.unique(names[left], return_index=True, return_inverse=True)
        fits = same(left[first][which], left)
        ids[left[fits]] = which[fits] + n
        firsts.append(left[first])
        n += len(first)
        left = left[~fits]
    return ids, np.concatenate(firsts) if firsts else np.empty(0, np.int64)


def same_bytes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, x: np.ndarray, y: np.ndarray, other: tuple[np.ndarray, np.ndarray, np.ndarray] | None = None) -> np.ndarray:
    """Whether runs x (of ``other`` data, if given) and y have equal bytes."""
    odata, ostarts, oends = other or (data, starts, ends)
    size = ends[y] - starts[y]
    out = oends[x] - ostarts[x] == size
    lanes = _eights(data)
    olanes = lanes if other is None else _eights(odata)
    at, j = np.flatnonzero(out & (size > 0)), 0
    while len(at):
        keep = _FIRST[np.minimum(size[at] - j, 8)]
        out[at] = (olanes[ostarts[x[at]] + j] ^ lanes[starts[y[at]] + j]) & keep == 0
        j += 8
        at = at[out[at] & (size[at] > j)]
    return out


def interned(words: Words, data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(ids, firsts): dense ids that two words of ``data`` (as it was named) share if, and only if, their bytes are equal."""
    return told_apart(words.names, lambda x, y: same_bytes(data, words.starts, words.ends, x, y))


def interned_grams(ids: np.ndarray, k: int, at: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """(ids, firsts) of the k exact ids from each position of ``at`` on (by default from every one), equal only for equal sequences."""
    names = grams(mix(ids.astype(U)), k)
    at = np.arange(len(names)) if at is None else at

    def same(x: np.ndarray, y: np.ndarray) -> np.ndarray:
        out = np.ones(len(x), bool)
        for j in range(k):
            out &= ids[at[x] + j] == ids[at[y] + j]
        return out

    return told_apart(names[at], same)


@functools.cache
def _trim() -> Callable[[int], int]:
    try:
        return ctypes.CDLL("libc.so.6").malloc_trim
    except (OSError, AttributeError):  # another C library
        return lambda pad: 0


def release() -> None:
    """Gives freed memory back to the system, so that an idle Python worker holds none of its last task's."""
    pa.default_memory_pool().release_unused()
    _trim()(0)


def releasing(run: Callable[[Iterator], Iterator]) -> Callable[[Iterator], Iterator]:
    """``run`` over Arrow batches, releasing memory behind each batch and at the end."""

    def outer(batches: Iterator) -> Iterator:
        for batch in run(batches):
            yield batch
            del batch
            release()
        release()

    return outer


def text_buffers(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and offsets of an Arrow string column; a null has no bytes."""
    if column.null_count:
        column = column.fill_null("")
    wide = pa.types.is_large_string(column.type)
    _, at, data = column.buffers()
    offsets = np.frombuffer(at, np.int64 if wide else np.int32)[column.offset : column.offset + len(column) + 1]
    return (np.frombuffer(data, np.uint8) if data is not None else np.empty(0, np.uint8)), offsets.astype(np.int64)


def chunks(column: pa.Array, limit: int = CHUNK) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, end row, bytes, offsets) for runs of rows of about ``limit`` bytes."""
    if not len(column):
        return
    data, offsets = text_buffers(column)
    row, n = 0, len(column)
    while row < n:
        end = max(row + 1, int(np.searchsorted(offsets, offsets[row] + limit, "right")) - 1)
        yield row, end, data[offsets[row] : offsets[end]], offsets[row : end + 1] - offsets[row]
        row = end


def shut(values: np.ndarray, width: int) -> bytes:
    """Values by their ``width`` low bytes: all first bytes, all second bytes, and so on, compressed."""
    planes = np.ascontiguousarray(values.view(np.uint8).reshape(len(values), values.itemsize)[:, :width].T)
    return pa.compress(planes.tobytes(), codec="zstd", asbytes=True)


def opened(blob: bytes, n: int, width: int, kind: type) -> np.ndarray:
    """What ``shut`` made of n values."""
    out = np.zeros((n, np.dtype(kind).itemsize), np.uint8)
    if not n:
        return out.view(kind).ravel()
    out[:, :width] = np.frombuffer(pa.decompress(blob, n * width, codec="zstd", asbytes=True), np.uint8).reshape(width, n).T
    return out.view(kind).ravel()


def expand(lo: np.ndarray, hi: np.ndarray) -> np.ndarray:
    """Every integer of the ranges [lo, hi), one range after the other."""
    size = hi - lo
    return np.arange(size.sum()) + np.repeat(lo - np.cumsum(size) + size, size)


def spans_union(starts: np.ndarray, length: int, n: int) -> np.ndarray:
    """Which of n positions lie in [s, s + length) for some s of ``starts``."""
    delta = np.zeros(n + 1, np.int32)
    np.add.at(delta, starts, 1)
    np.add.at(delta, np.minimum(starts + length, n), -1)
    return np.cumsum(delta[:n]) > 0
