"""Word shingles of whole texts as sets of 64-bit hashes, made from the bytes of an Arrow column."""

from __future__ import annotations

import functools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa

from . import textscan

_SPACE = np.zeros(256, bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_SEED = np.uint64(0xD6E8FEB86659FD93)
_LENGTHS = np.arange(64, dtype=np.uint64) * _SEED  # tells short sequences from others


@functools.cache
def _factors(n: int) -> np.ndarray:
    return textscan.finalised(np.arange(1, n + 1, dtype=np.uint64) * _SEED) | np.uint64(1)


def text_bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of a string column and where each row begins in them; a null row is empty."""
    if column.null_count:
        column = column.fill_null("")
    wide = pa.types.is_large_string(column.type)
    offsets = np.frombuffer(column.buffers()[1], np.int64 if wide else np.int32)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    data = np.frombuffer(column.buffers()[2], np.uint8) if column.buffers()[2] else np.zeros(0, np.uint8)
    return data[offsets[0] : offsets[-1]], offsets - offsets[0]


def word_hashes(data: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all words (A-Z lower-cased, cut at ASCII white space) and where each row's words begin.

    A long array is worked on in pieces that end with white space, so what is held beside it are its words' hashes.
    """
    if len(data) > 2 * PIECE and len(bounds) == 2:
        found, at = [], 0
        while at < len(data):
            to = at + PIECE
            while to < len(data):
                gap = np.flatnonzero(_SPACE[data[to : to + PIECE]])
                if len(gap):
                    to += int(gap[0])
                    break
                to += PIECE
            to = min(to, len(data))
            found.append(word_hashes_of(data[at:to], np.array([0, to - at]))[0])
            at = to
        words = np.concatenate(found)
        return words, np.array([0, len(words)])
    return word_hashes_of(data, bounds)


def word_hashes_of(data: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """:func:`word_hashes` of an array that is worked on as a whole."""
    n = len(data)
    if not n:
        return np.zeros(0, np.uint64), np.zeros(len(bounds), np.int64)
    space = _SPACE[data]
    edge = np.zeros(n + 1, bool)
    edge[bounds] = True
    before = np.ones(n, bool)
    before[1:] = space[:-1]
    after = np.ones(n, bool)
    after[:-1] = space[1:]
    starts = np.flatnonzero(~space & (before | edge[:n]))
    ends = np.flatnonzero(~space & (after | edge[1:])) + 1
    return textscan.span_hashes(_LOWER[data], starts, ends), np.searchsorted(starts, bounds)


#: Bytes of a long row that are worked on at once.
PIECE = 1 << 20


def shingle_sets(column: pa.Array, size: int = 5, at_once: int = 1 << 18) -> Iterator[np.ndarray]:
    """For each row of a string column the sorted distinct hashes of its shingles.

    A row with fewer words than ``size`` has its whole sequence as its one shingle; one without words has none.
    Rows are worked on in groups of some ``at_once`` bytes; a longer row is a group of its own.
    """
    data, bounds = text_bytes(column)
    row = 0
    while row < len(bounds) - 1:
        to = max(row + 1, int(np.searchsorted(bounds, bounds[row] + at_once, "right")) - 1)
        part = bounds[row : to + 1]
        words, first = word_hashes(data[part[0] : part[-1]], part - part[0])
        factor = _factors(size)
        if len(words) >= size:
            mixed = words[: len(words) - size + 1] * factor[0]
            for k in range(1, size):
                mixed += words[k : len(words) - size + 1 + k] * factor[k]
            mixed = textscan.finalised(mixed)
        else:
            mixed = np.zeros(0, np.uint64)
        for a, b in zip(first[:-1].tolist(), first[1:].tolist(), strict=True):
            if b - a >= size:
                found = np.sort(mixed[a : b - size + 1])
                yield found if len(found) < 2 else found[np.concatenate([[True], found[1:] != found[:-1]])]
            elif b > a:
                short = (words[a:b] * factor[: b - a]).sum(dtype=np.uint64, keepdims=True)
                yield textscan.finalised(short + _LENGTHS[b - a])
            else:
                yield np.zeros(0, np.uint64)
        row = to


def set_names(hashes: np.ndarray, seed: int = 0) -> tuple[int, int]:
    """Two 63-bit names for a set of hashes, independent of each other; equal sets have equal names.

    Sets are told apart by the first; the second shows where it is the same for different sets, and another ``seed`` gives others.
    """
    first = textscan.finalised(hashes ^ (_SEED + np.uint64(seed)))
    second = textscan.finalised(hashes * _SEED + np.uint64(2 * seed + 1))
    both = np.array([first.sum(dtype=np.uint64), second.sum(dtype=np.uint64)])
    name, check = (textscan.finalised(both) >> np.uint64(1)).tolist()
    return name, check
