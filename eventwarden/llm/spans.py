"""Spans of kinds inside texts: order, digest, merged cuts; bytes against code points."""

from __future__ import annotations

import hashlib
from collections.abc import Iterable

import numpy as np
import pyarrow as pa

from eventwarden.llm.words import Slice

Span = tuple[str, int, int]

CODE_POINT_START = np.ones(256, dtype=bool)
CODE_POINT_START[0x80:0xC0] = False


def code_points_before(data: np.ndarray) -> np.ndarray:
    """Code points that begin before each byte position of a slice."""
    sums = np.zeros(len(data) + 1, dtype=np.int64)
    np.cumsum(CODE_POINT_START[data], out=sums[1:])
    return sums


def ordered(spans: Iterable[Span], kinds: list[str]) -> list[Span]:
    rank = {k: i for i, k in enumerate(kinds)}
    return sorted(set(spans), key=lambda s: (s[1], rank[s[0]], s[2]))


def joined(spans: Iterable[Span]) -> str:
    return ",".join(f"{k}:{s}:{e}" for k, s, e in spans)


def digest(text: str) -> str:
    return hashlib.sha256(text.encode()).hexdigest()


def merged(spans: Iterable[Span]) -> list[tuple[int, int, str]]:
    """Disjoint cuts that cover all spans; touching spans stay apart, a cut takes the kind of its first span."""
    cuts: list[tuple[int, int, str]] = []
    for kind, start, end in sorted(spans, key=lambda s: (s[1], -s[2])):
        if cuts and start < cuts[-1][1]:
            cuts[-1] = (cuts[-1][0], max(end, cuts[-1][1]), cuts[-1][2])
        else:
            cuts.append((start, end, kind))
    return cuts


def replaced(text: str, spans: Iterable[Span], mark) -> str:
    """The text with every merged cut replaced by ``mark(kind, old)``."""
    parts, at = [], 0
    for start, end, kind in merged(spans):
        parts += [text[at:start], mark(kind, text[start:end])]
        at = end
    return "".join([*parts, text[at:]])


def docs_at(part: Slice, positions: np.ndarray) -> np.ndarray:
    return np.unique(np.searchsorted(part.offsets, positions, side="right") - 1)


def docs_with(part: Slice, raw: bytes, needles: Iterable[bytes]) -> set[int]:
    """Documents whose bytes hold one of the literals; one may be named for a literal across its border."""
    found: set[int] = set()
    for needle in needles:
        at = raw.find(needle)
        while at >= 0:
            doc = int(np.searchsorted(part.offsets, at, side="right")) - 1
            found.add(doc)
            at = raw.find(needle, max(int(part.offsets[doc + 1]), at + 1))
    return found


def docs_with_runs(part: Slice, inside: np.ndarray, least: int) -> set[int]:
    """Documents that touch a run of ``least`` or more marked bytes."""
    edge = np.diff(inside.astype(np.int8), prepend=0, append=0)
    start, end = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
    long = end - start >= least
    found: set[int] = set()
    for s, e in zip(start[long], end[long]):
        lo = int(np.searchsorted(part.offsets, s, side="right")) - 1
        hi = int(np.searchsorted(part.offsets, e - 1, side="right")) - 1
        found.update(range(lo, hi + 1))
    return found


def text_of(column: pa.Array, doc: int) -> str:
    return column[doc].as_py() or ""
