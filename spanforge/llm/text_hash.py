"""Hashes of words and n-grams over whole batches of texts, without a Python object for each word.

A word's hash is a polynomial over its bytes (A-Z lower-cased) modulo 2**64, taken as a difference of prefix sums
and mixed; words are runs of bytes other than [\\x20\\x09-\\x0D].
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

from .common import mix64

CHUNK = 1 << 18  # bytes of text that are hashed together; arrays of some forty bytes for each
BASE = 0x9E3779B97F4A7C15 | 5
_INVERSE = pow(BASE, -1, 1 << 64)
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_VALUES = np.random.default_rng(7).integers(1, 2**64 - 1, 256, dtype=np.uint64)[_LOWER]
_SPACE = np.zeros(256, bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True
_powers: list[np.ndarray] = [np.ones(1, np.uint64), np.ones(1, np.uint64)]


def _power(n: int) -> tuple[np.ndarray, np.ndarray]:
    """BASE**i and BASE**-i for i < n at least."""
    if len(_powers[0]) < n:
        size = 1 << max(CHUNK, n - 1).bit_length()
        for k, b in enumerate((BASE, _INVERSE)):
            p, step = np.ones(1, np.uint64), b
            while len(p) < size:  # doubling
                p = np.concatenate([p, p * np.uint64(step)])
                step = step * step % (1 << 64)
            _powers[k] = p
    return _powers[0], _powers[1]


def texts_of(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """A string column's offsets and bytes; null texts are empty."""
    if column.null_count:
        column = column.fill_null("")
    wide = pa.types.is_large_string(column.type)
    at = np.frombuffer(column.buffers()[1], np.int64 if wide else np.int32)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    data = np.frombuffer(column.buffers()[2], np.uint8) if column.buffers()[2] is not None else np.zeros(0, np.uint8)
    return at, data


def chunks(at: np.ndarray, most: int = CHUNK) -> Iterator[tuple[int, int]]:
    """Ranges of rows of most bytes each (or one row)."""
    i = 0
    while i < len(at) - 1:
        j = max(i + 1, int(np.searchsorted(at, at[i] + most, side="right")) - 1)
        yield i, j
        i = j


_KIND = np.full(256, 2, np.uint8)  # 0 white space, 1 letters, digits and all beyond ASCII, 2 the rest
_KIND[_SPACE] = 0
_KIND[[*range(48, 58), *range(65, 91), *range(97, 123), *range(128, 256)]] = 1


def tokens(column: pa.Array) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """As words(), with words cut where letters and digits meet other signs."""
    return words(column, _KIND)


def _hashes(raw: np.ndarray, own: np.ndarray, kind: np.ndarray | None) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the words of texts that lie behind each other, and where each text's begin and the last one's end."""
    n = len(raw)
    power, inverse = _power(n)
    black = ~_SPACE[raw]
    change = np.zeros(n + 1, bool)
    if kind is not None:
        k = kind[raw]
        change[1:-1] = k[1:] != k[:-1]
    edge = np.zeros(n + 1, bool)
    edge[own] = True
    begins = np.flatnonzero(black & (edge[:-1] | change[:-1] | ~np.concatenate([[False], black[:-1]])))
    ends = np.flatnonzero(black & (edge[1:] | change[1:] | ~np.concatenate([black[1:], [False]]))) + 1
    sums = np.zeros(n + 1, np.uint64)
    np.cumsum(_VALUES[raw] * power[:n], out=sums[1:])
    return mix64((sums[ends] - sums[begins]) * inverse[begins]), np.searchsorted(begins, own)


def _pieces(raw: np.ndarray, most: int) -> Iterator[np.ndarray]:
    """A long text in pieces of about most bytes, cut in white space."""
    at = 0
    while len(raw) - at > most:
        stop = at + most
        while stop < len(raw) and not len(white := np.flatnonzero(_SPACE[raw[stop : stop + most]])):
            stop += most
        stop = min(len(raw), stop + int(white[0])) if stop < len(raw) else len(raw)
        yield raw[at:stop]
        at = stop
    yield raw[at:]


def words(column: pa.Array, kind: np.ndarray | None = None, most: int = CHUNK) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(first row, hashes of words, where each row's words begin and the last ones' end) of each chunk of rows.

    A text of more than `most` bytes is a chunk of its own and hashed piece by piece, so memory doesn't grow with it
    but for eight bytes a word.
    """
    at, data = texts_of(column)
    for i, j in chunks(at, most):
        raw = data[at[i] : at[j]]
        if not len(raw):
            yield i, np.zeros(0, np.uint64), np.zeros(j - i + 1, np.int64)
        elif len(raw) > most:  # one row
            h = np.concatenate([_hashes(x, np.array([0, len(x)]), kind)[0] for x in _pieces(raw, most) if len(x)])
            yield i, h, np.array([0, len(h)])
        else:
            yield i, *_hashes(raw, at[i : j + 1] - at[i], kind)


_ODD = np.random.default_rng(11).integers(1, 2**63, 64, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def ngrams(h: np.ndarray, at: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the n-grams of each row's words and where each row's begin; a row of fewer words is one n-gram."""
    size = np.diff(at)
    full = len(h) - n + 1
    if full > 0:
        g = h[:full] * _ODD[0]
        for k in range(1, n):
            g += h[k : k + full] * _ODD[k]
        g = mix64(g, n)
    else:
        g = np.zeros(0, np.uint64)
    count = np.where(size >= n, size - n + 1, np.minimum(size, 1))
    starts = np.concatenate([[0], np.cumsum(count)])
    keep = np.zeros(max(len(h), 1) + 1, np.int64)  # the n-grams that don't run over a row's end
    long = size >= n
    np.add.at(keep, at[:-1][long], 1)
    np.add.at(keep, at[:-1][long] + size[long] - n + 1, -1)
    mask = np.cumsum(keep)[: max(full, 0)] > 0
    out = np.zeros(starts[-1], np.uint64)
    short = np.flatnonzero((size < n) & (size > 0))
    into = np.ones(starts[-1], bool)
    into[starts[short]] = False
    out[into] = g[mask]
    for r in short.tolist():
        own = h[at[r] : at[r + 1]]
        out[starts[r]] = mix64(np.array([sum(int(x) * int(c) for x, c in zip(own, _ODD, strict=False)) & (2**64 - 1)], np.uint64), int(size[r]))[0]
    return out, starts


def sets(column: pa.Array, n: int) -> Iterator[np.ndarray]:
    """Each row's distinct n-grams as sorted hashes."""
    for _, h, at in words(column):
        g, starts = ngrams(h, at, n)
        for a, b in zip(starts[:-1].tolist(), starts[1:].tolist(), strict=True):
            s = np.sort(g[a:b])
            yield s[np.concatenate([[True], s[1:] != s[:-1]])] if len(s) > 1 else s
