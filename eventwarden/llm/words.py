"""Vectorised words, word codes and word windows over Arrow text columns.

Texts are never turned into Python strings here: a batch is cut into slices of whole documents, and numpy works on
the UTF-8 bytes of a slice. Every separator class used by the operators is ASCII, and every byte of a multi-byte
character is 0x80 or more, so splitting bytes and splitting characters give the same words.

Word codes are 64-bit polynomial hashes of the word's bytes under a table of random values; window codes combine the
codes of consecutive words. Both depend on the words alone, so they agree between tasks, machines and runs.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

SLICE_BYTES = 1 << 20
SLICE_ROWS = 1024
U64 = np.uint64
MASK = (1 << 64) - 1
BASE = 0x9E3779B97F4A7C15


def mixed(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit values that spreads every input bit over the word."""
    x = x ^ (x >> U64(32))
    x = x * U64(0xD6E8FEB86659FD93)
    x = x ^ (x >> U64(32))
    x = x * U64(0xD6E8FEB86659FD93)
    return x ^ (x >> U64(32))


def class_table(excluded: list[tuple[int, int]]) -> np.ndarray:
    """True for the bytes that belong to words: all but the given inclusive ranges."""
    table = np.ones(256, dtype=bool)
    for lo, hi in excluded:
        table[lo:hi + 1] = False
    return table


# [^\x20\x09-\x0D]+ and [^\x00-\x2F\x3A-\x60\x7B-\x7F]+ (the latter after lower-casing A-Z)
SPACED = class_table([(0x20, 0x20), (0x09, 0x0D)])
ALNUM = class_table([(0x00, 0x2F), (0x3A, 0x40), (0x5B, 0x60), (0x7B, 0x7F)])

_values = mixed(np.arange(1, 257, dtype=U64) * U64(BASE))
PLAIN_VALUES = _values
_folded = _values.copy()
_folded[65:91] = _values[97:123]
FOLDED_VALUES = _folded

_powers: dict[str, np.ndarray] = {}


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """BASE**i and its inverse modulo 2**64, for i below n at least."""
    if not _powers or len(_powers["up"]) < n:
        size = max(n, SLICE_BYTES + 1024)
        for name, base in (("up", BASE), ("down", pow(BASE, -1, 1 << 64))):
            table = np.full(size, base, dtype=U64)
            table[0] = 1
            _powers[name] = np.cumprod(table)
    return _powers["up"][:n], _powers["down"]


class Slice(NamedTuple):
    """Whole documents: rows ``first`` to ``last`` of the batch, their bytes, and where each of them starts."""

    first: int
    last: int
    data: np.ndarray
    offsets: np.ndarray


def slices(column: pa.Array, limit: int = SLICE_BYTES, rows: int = SLICE_ROWS) -> Iterator[Slice]:
    """Cut a text column into runs of whole documents of at most ``rows`` rows and about ``limit`` bytes; null counts as empty."""
    column = pc.fill_null(column, "")
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    kind = np.int64 if pa.types.is_large_string(column.type) else np.int32
    n = len(column)
    if not n:
        return
    _, starts, data = column.buffers()
    offsets = np.frombuffer(starts, dtype=kind)[column.offset:column.offset + n + 1].astype(np.int64)
    whole = np.frombuffer(data, dtype=np.uint8) if data is not None else np.zeros(0, dtype=np.uint8)
    first = 0
    while first < n:
        last = int(np.searchsorted(offsets, offsets[first] + limit, side="right")) - 1
        last = min(max(last, first + 1), first + rows, n)
        yield Slice(first, last, whole[offsets[first]:offsets[last]], offsets[first:last + 1] - offsets[first])
        first = last


class Words(NamedTuple):
    """Start and end byte, document and code of every word of a slice, in text order."""

    start: np.ndarray
    end: np.ndarray
    doc: np.ndarray
    code: np.ndarray


def prefix_codes(data: np.ndarray, values: np.ndarray) -> np.ndarray:
    """Running polynomial sums: the code of bytes [s, e) is (sums[e] - sums[s]) * BASE**-s."""
    sums = np.zeros(len(data) + 1, dtype=U64)
    up, _ = powers(len(data))
    np.cumsum(values[data] * up, out=sums[1:])
    return sums


def span_codes(sums: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    _, down = powers(len(sums))
    return mixed((sums[end] - sums[start]) * down[start])


def words_of(part: Slice, table: np.ndarray, values: np.ndarray) -> Words:
    data, offsets = part.data, part.offsets
    n = len(data)
    inside = table[data]
    before = np.zeros(n + 1, dtype=bool)
    before[1:] = inside
    before[offsets[:-1]] = False
    after = np.zeros(n + 1, dtype=bool)
    after[:n] = inside
    after[offsets[1:]] = False
    start = np.flatnonzero(inside & ~before[:n])
    end = np.flatnonzero(inside & ~after[1:]) + 1
    doc = np.searchsorted(offsets, start, side="right") - 1
    return Words(start, end, doc, span_codes(prefix_codes(data, values), start, end))


def per_doc(doc: np.ndarray, n_docs: int, weights: np.ndarray | None = None) -> np.ndarray:
    return np.bincount(doc, weights=weights, minlength=n_docs)


def word_bounds(words: Words, n_docs: int) -> np.ndarray:
    """Index of each document's first word, and the total at the end."""
    return np.searchsorted(words.doc, np.arange(n_docs + 1))


_SCALES = np.cumprod(np.full(64, 0xC2B2AE3D27D4EB4F, dtype=U64))


def window_codes(code: np.ndarray, doc: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Codes of all k consecutive words inside one document, and the index of each window's first word."""
    n = len(code) - k + 1
    if n <= 0:
        return np.zeros(0, dtype=U64), np.zeros(0, dtype=np.int64)
    total = np.zeros(n, dtype=U64)
    for j in range(k):
        total += code[j:j + n] * _SCALES[j]
    first = np.flatnonzero(doc[:n] == doc[k - 1:])
    return mixed(total[first] + U64(k)), first


def short_codes(code: np.ndarray, bounds: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """For documents of 1 to k - 1 words: the code of the whole sequence, and the document."""
    lengths = np.diff(bounds)
    docs = np.flatnonzero((lengths > 0) & (lengths < k))
    total = np.zeros(len(docs), dtype=U64)
    for j in range(k - 1):
        has = lengths[docs] > j
        total[has] += code[bounds[docs[has]] + j] * _SCALES[j]
    return mixed(total + lengths[docs].astype(U64)), docs


def shingle_sets(words: Words, n_docs: int, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Distinct k-word shingles of each document as (document, code), ordered by both."""
    code, first = window_codes(words.code, words.doc, k)
    short, short_doc = short_codes(words.code, word_bounds(words, n_docs), k)
    doc = np.concatenate([words.doc[first], short_doc])
    code = np.concatenate([code, short])
    order = by_doc(doc, np.argsort(code))
    doc, code = doc[order], code[order]
    fresh = np.ones(len(code), dtype=bool)
    fresh[1:] = (doc[1:] != doc[:-1]) | (code[1:] != code[:-1])
    return doc[fresh], code[fresh]


def by_doc(doc: np.ndarray, order: np.ndarray) -> np.ndarray:
    """``order`` with the entries of each document together; a slice has fewer documents than two bytes can count."""
    return order[np.argsort(doc[order].astype(np.uint16), kind="stable")]


def signed(code: np.ndarray) -> np.ndarray:
    """The same 64 bits as Spark's signed long."""
    return code.view(np.int64)
