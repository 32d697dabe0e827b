"""Hashes of many byte spans at once, and the words and lines of whole texts."""

from __future__ import annotations

import numpy as np

from .common import mix64, random_words
from .simhash import word_spans

_BASE = np.uint64(0x9E3779B97F4A7C15)
_INVERSE = np.uint64(pow(int(_BASE), -1, 1 << 64))
_BYTES = random_words(256, 11)
_POWERS: dict[str, np.ndarray] = {}


def powers(base: np.uint64, n: int) -> np.ndarray:
    have = _POWERS.get(str(base))
    if have is None or len(have) < n:
        have = np.full(max(n, 1 << 16), base, np.uint64)
        have[0] = 1
        have = _POWERS[str(base)] = np.cumprod(have)
    return have[:n]


class SpanHasher:
    """Hashes spans of a sequence of 64-bit values: equal spans, equal hashes, wherever they are."""

    def __init__(self, values: np.ndarray):
        self.sums = np.concatenate([[np.uint64(0)], np.cumsum(values * powers(_BASE, len(values)), dtype=np.uint64)])

    def of(self, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        back = powers(_INVERSE, len(self.sums))
        return mix64((self.sums[ends] - self.sums[starts]) * back[starts] + (ends - starts).astype(np.uint64))


def byte_hasher(raw: np.ndarray) -> SpanHasher:
    return SpanHasher(_BYTES[raw])


def line_spans(raw: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    r"""(start, end, document) of every ``\n``-split line; an empty text is one empty line."""
    breaks = np.flatnonzero(raw == 0x0A)
    starts = np.sort(np.concatenate([offsets[:-1], breaks + 1]))
    doc = np.sort(np.concatenate([np.arange(len(offsets) - 1), np.searchsorted(offsets, breaks, side="right") - 1]))
    last = np.append(doc[1:] != doc[:-1], True) if len(doc) else np.zeros(0, bool)
    ends = np.where(last, offsets[doc + 1], np.append(starts[1:], 0) - 1) if len(doc) else starts
    return starts, ends, doc


def repeated(group: np.ndarray, key: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(is one of several equal keys of its group, is not the first of them)."""
    both = mix64(key + group.astype(np.uint64) * _BASE)
    order = np.argsort(both, kind="stable")
    same = np.zeros(len(both) + 1, bool)
    same[1:-1] = both[order][1:] == both[order][:-1]
    several, later = np.zeros(len(both), bool), np.zeros(len(both), bool)
    several[order] = same[1:] | same[:-1]
    later[order] = same[:-1]
    return several, later


__all__ = ["SpanHasher", "byte_hasher", "line_spans", "repeated", "word_spans"]
