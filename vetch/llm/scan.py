"""Words of many texts at once, from the buffers of an Arrow column: byte classes by table, hashes by prefix sums.

A word's hash comes from a polynomial of its bytes modulo 2^64: sums over prefixes are taken once for a piece of text, and the difference
of two, times a power of the base's inverse, is the word's wherever it stands. A finishing mix spreads it over 64 bits.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash

SPACE, CAPITAL, SYMBOL, INNER = 1, 2, 4, 8
#: Bytes of text that are worked on at a time; a longer text is a piece of its own, and its words are hashed in pieces.
PIECE = 1 << 20
_BASE = 0x9E3779B97F4A7C15
_INVERSE = pow(_BASE, -1, 1 << 64)

CLASS = np.zeros(256, np.uint8)
CLASS[[0x20, *range(0x09, 0x0E)]] |= SPACE
CLASS[0x41:0x5B] |= CAPITAL
CLASS[list(b"#$%&*|")] |= SYMBOL
CLASS[0x80:0xC0] |= INNER  # bytes of a code point after its first
LOWER = np.arange(256, dtype=np.uint8)
LOWER[0x41:0x5B] += 32


def mixed(x: np.ndarray) -> np.ndarray:
    """A bijection of 64 bits that spreads every bit over all."""
    x = (x ^ (x >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    x = (x ^ (x >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    return x ^ (x >> np.uint64(32))


def _powers(base: int) -> np.ndarray:
    p = np.full(2 * PIECE + 1, base, np.uint64)
    p[0] = 1
    return np.cumprod(p, dtype=np.uint64)


_UP: list[np.ndarray] = []  # powers of the base and of its inverse, made once a worker


def texts(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of a column of strings without nulls, as they lie in its buffer, and where each text begins, with the end."""
    if not len(column):
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    wide = pa.types.is_large_string(column.type)
    at = np.frombuffer(column.buffers()[1], np.int64 if wide else np.int32)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    data = column.buffers()[2]
    return (np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)), at


def portions(at: np.ndarray, limit: int = PIECE, rows: int = 1 << 15) -> Iterator[tuple[int, int]]:
    """Runs [i, j) of texts with at most limit bytes together, or a single longer text."""
    i, n = 0, len(at) - 1
    while i < n:
        j = max(i + 1, min(i + rows, int(np.searchsorted(at, at[i] + limit, "right")) - 1))
        yield i, j
        i = j


def spans(kind: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Begin and end of each word by the bytes' classes, for texts that begin at ``at`` (with the end); a word ends with its text."""
    word = (kind & SPACE) == 0
    first, last = word.copy(), word.copy()
    first[1:] &= ~word[:-1]
    last[:-1] &= ~word[1:]
    cuts = at[(at > 0) & (at < len(kind))]
    first[cuts], last[cuts - 1] = word[cuts], word[cuts - 1]
    return np.flatnonzero(first), np.flatnonzero(last) + 1


def word_hashes(raw: np.ndarray, begin: np.ndarray, end: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each word; words longer than a piece are hashed one by one."""
    if not _UP:
        _UP.extend((_powers(_BASE), _powers(_INVERSE)))
    up, down = _UP
    out, size, k = np.zeros(len(begin), np.uint64), end - begin, 0
    while k < len(begin):
        if size[k] > PIECE:
            out[k] = xxhash.xxh64_intdigest(raw[begin[k] : end[k]].tobytes())
            k += 1
            continue
        n = int(np.searchsorted(end, begin[k] + 2 * PIECE, "right"))
        a, b = begin[k:n], end[k:n]
        sums = np.zeros(int(b[-1] - a[0]) + 1, np.uint64)
        np.cumsum((raw[a[0] : b[-1]].astype(np.uint64) + np.uint64(1)) * up[: len(sums) - 1], out=sums[1:])
        out[k:n] = (sums[b - a[0]] - sums[a - a[0]]) * down[a - a[0]]
        k = n
    return mixed(out ^ (size.astype(np.uint64) * np.uint64(0xA24BAED4963EE407)))


def heads(raw: np.ndarray, begin: np.ndarray, size: np.ndarray) -> np.ndarray:
    """The first eight bytes of each word as a number, zeros after its end."""
    padded = np.concatenate([raw, np.zeros(8, np.uint8)])
    eight = np.ndarray((len(raw) + 1,), "<u8", padded, strides=(1,))[begin]
    return eight & (np.uint64(0xFFFFFFFFFFFFFFFF) >> (np.uint64(8) * (8 - np.minimum(size, 8)).astype(np.uint64)))


def same_bytes(raw: np.ndarray, a: np.ndarray, b: np.ndarray, size: np.ndarray) -> np.ndarray:
    """Whether the words of ``size`` bytes that begin at a and at b are equal, a pair each, beyond their first eight bytes."""
    equal, k = np.ones(len(a), bool), 0
    long = np.flatnonzero(size > 8)
    while k < len(long):  # a piece at a time
        stop = k + max(1, int(np.searchsorted(np.cumsum(size[long[k : k + PIECE]]), PIECE, "right")))
        part = long[k:stop]
        rest = size[part] - 8
        begins = np.cumsum(rest) - rest
        step = np.arange(int(rest.sum())) - np.repeat(begins, rest)
        differ = raw[np.repeat(a[part] + 8, rest) + step] != raw[np.repeat(b[part] + 8, rest) + step]
        equal[part] = np.add.reduceat(differ, begins) == 0
        k = stop
    return equal


def distinct_words(raw: np.ndarray, text: np.ndarray, begin: np.ndarray, end: np.ndarray, n: int) -> np.ndarray:
    """How many different words each of n texts has; ``text`` numbers the text of each word, in order.

    Words are sorted by text and hash; neighbours with equal hashes are compared byte by byte. Where two differ after all, their
    text's words are counted as they are.
    """
    size = end - begin
    key = (text.astype(np.uint64) << np.uint64(48)) | (word_hashes(raw, begin, end) >> np.uint64(16))
    order = np.argsort(key, kind="stable")
    key = key[order]
    i, j = order[:-1], order[1:]
    met = np.flatnonzero(key[1:] == key[:-1])
    i, j = i[met], j[met]
    first = heads(raw, begin, size)
    equal = (size[i] == size[j]) & (first[i] == first[j])
    equal[equal] = same_bytes(raw, begin[i[equal]], begin[j[equal]], size[i[equal]])
    counts = np.bincount(text, minlength=n) - np.bincount(text[i[equal]], minlength=n)
    for t in np.unique(text[i[~equal]]):
        counts[t] = len({raw[a:b].tobytes() for a, b in zip(begin[text == t], end[text == t])})
    return counts
