"""Cutting whole texts into pre-tokens with array operations, and looking the pre-tokens up in hash tables.

Texts are handled as arrays of code points, many texts at a time. The boundaries that a tokenizer's regular
expression finds follow from where the class of characters changes, so a few passes over the array find all of them.
Every pre-token gets a 64-bit hash from prefix sums; equal hashes count as equal pre-tokens (among a million of them,
more than a worker's tables hold, two differ with equal hashes with a probability of 3e-8).
"""

from __future__ import annotations

import functools
import json
import unicodedata
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np

SPACE, LETTER, NUMBER, OTHER = 0, 1, 2, 3
#: The code points of Unicode's White_Space property.
WHITE_SPACE = [*range(0x09, 0x0E), 0x20, 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000]
#: Code points that are worked on at once; a longer text is cut between two pre-tokens.
AT_ONCE = 1 << 18
#: Powers of the hash's base that a process keeps.
POWERS = 1 << 20
#: The characters that stand for the bytes 0 to 255 in byte-level vocabularies: itself if printable, else the next from 256 on.
_PLAIN = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
BYTE_CHARS = {b: chr(b) for b in _PLAIN} | {b: chr(256 + i) for i, b in enumerate(b for b in range(256) if b not in _PLAIN)}
_BASE, _MIX1, _MIX2 = 0x9E3779B97F4A7C15, 0xBF58476D1CE4E5B9, 0x94D049BB133111EB
_WRAP = (1 << 64) - 1


@functools.cache
def classes() -> np.ndarray:
    out = np.full(0x110000, OTHER, np.uint8)
    for cp in range(0x110000):
        kind = unicodedata.category(chr(cp))[0]
        if kind == "L":
            out[cp] = LETTER
        elif kind == "N":
            out[cp] = NUMBER
    out[WHITE_SPACE] = SPACE
    return out


_held_powers = [np.ones(1, np.uint64), np.ones(1, np.uint64)]


def _powers(n: int) -> list[np.ndarray]:
    """At least ``n`` powers of an odd base and of its inverse modulo 2**64; a process keeps the longest it needed."""
    if len(_held_powers[0]) < n:
        for k, base in enumerate((_BASE, pow(_BASE, -1, 1 << 64))):
            p = np.full(1 << (n - 1).bit_length(), base, np.uint64)
            p[0] = 1
            _held_powers[k] = np.multiply.accumulate(p)
    return _held_powers


def finalised(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(30))) * np.uint64(_MIX1)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(_MIX2)
    return h ^ (h >> np.uint64(31))


def span_hashes(units: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """64-bit hashes of the spans of an array of code points or bytes, in ascending order, by prefix sums over the array.

    The array is worked on POWERS units at a time, so a long one needs no more memory than its spans do.
    """
    if not len(starts):
        return np.zeros(0, np.uint64)
    power, inverse = _powers(min(max(1 << 12, len(units) + 1), POWERS))
    at_start, at_end = np.zeros(len(starts), np.uint64), np.zeros(len(starts), np.uint64)
    factors = np.zeros(len(units) // POWERS + 1, np.uint64)  # of the inverse, for each block
    carry, scale, back = 0, 1, 1
    for k in range(len(factors)):
        block = units[k * POWERS : (k + 1) * POWERS]
        terms = finalised(block.astype(np.uint64) + np.uint64(_BASE))
        terms *= power[: len(block)]
        sums = np.zeros(len(block) + 1, np.uint64)
        np.cumsum(terms, out=sums[1:])
        sums *= np.uint64(scale)
        sums += np.uint64(carry)
        for places, out in ((starts, at_start), (ends, at_end)):
            some = slice(*np.searchsorted(places, [k * POWERS, (k + 1) * POWERS + (k + 1 == len(factors))]))
            out[some] = sums[places[some] - k * POWERS]
        factors[k] = back
        carry, scale, back = int(sums[-1]), scale * pow(_BASE, POWERS, 1 << 64) & _WRAP, back * pow(_BASE, -POWERS, 1 << 64) & _WRAP
    h = (at_end - at_start) * inverse[starts % POWERS] * factors[starts // POWERS]
    out = finalised(h + (ends - starts).astype(np.uint64) * np.uint64(_MIX2))
    out[out == 0] = 1  # 0 marks an empty slot
    return out


@dataclass
class Tokens:
    """Pre-tokens of several texts: their places in ``whole``, hashes, and where each text's pre-tokens begin (one more entry than texts)."""

    whole: str
    starts: np.ndarray
    ends: np.ndarray
    hashes: np.ndarray
    first: np.ndarray

    def word(self, i: int) -> str:
        return self.whole[self.starts[i] : self.ends[i]]


class Scheme:
    """The parts of a tokenizers file that decide on pre-tokens: byte-level with its usual expression, or words.

    Other files are refused rather than read approximately.
    """

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as file:
            spec = json.load(file)
        pre = spec["pre_tokenizer"]
        plain = all(not (t["lstrip"] or t["rstrip"] or t["single_word"] or t["normalized"]) for t in spec["added_tokens"])
        if spec["model"]["type"] != "BPE" or not plain:
            raise ValueError(f"{path}: only BPE with plain added tokens is supported")
        if pre["type"] == "ByteLevel" and pre["use_regex"] and not pre["add_prefix_space"] and not spec["normalizer"]:
            self.lower = False
        elif pre["type"] == "Sequence" and [n["type"] for n in spec["normalizer"]["normalizers"]] == ["NFC", "Replace", "Lowercase"]:
            self.lower = True
        else:
            raise ValueError(f"{path}: this normalizer and pre-tokenizer aren't supported")
        self.specials = [t["content"] for t in spec["added_tokens"]]

    def has_special(self, text: str) -> bool:
        return any(s in text for s in self.specials)

    def normalised(self, text: str) -> str:
        if not self.lower:
            return text
        if not text.isascii():
            if not unicodedata.is_normalized("NFC", text):
                text = unicodedata.normalize("NFC", text)
            text = text.replace("Σ", "σ")  # lower case by character: no final sigma
        return text.lower()

    def tokens(self, texts: list[str]) -> Tokens:
        """Pre-tokens of texts that are normalised and hold no special string."""
        whole = "".join(texts)
        cps = np.frombuffer(whole.encode("utf-32-le", "surrogatepass"), np.uint32)
        bounds = np.zeros(len(texts) + 1, np.int64)
        np.cumsum([len(t) for t in texts], out=bounds[1:])
        n = len(cps)
        if n == 0:
            none = np.zeros(0, np.int64)
            return Tokens(whole, none, none, np.zeros(0, np.uint64), np.zeros(len(texts) + 1, np.int64))
        kind = classes()[cps]
        opens = np.zeros(n + 1, bool)  # a text begins here
        opens[bounds] = True
        run = opens[:n].copy()  # a run of one class begins here
        run[1:] |= kind[1:] != kind[:-1]
        run[0] = True
        space = kind == SPACE
        if self.lower:
            edge = run | (kind == NUMBER)
            start = edge & ~space
        else:
            blank_before = np.zeros(n, bool)
            blank_before[1:] = (cps[:-1] == 32) & ~opens[1:n]
            last_space = space.copy()
            last_space[:-1] &= ~space[1:] & ~opens[1:n]
            last_space[-1] = False
            start = np.where(space, run | last_space, run & ~blank_before)
            edge = start
        for i, k in self._contractions(cps, kind, run, opens):
            start[i + 1] = edge[i + 1] = False
            if i + 1 + k < n and not opens[i + 1 + k]:
                edge[i + 1 + k] = True
                if kind[i + 1 + k] == LETTER or not self.lower:
                    start[i + 1 + k] |= kind[i + 1 + k] == LETTER
        starts = np.flatnonzero(start)
        edges = np.append(np.flatnonzero(edge), n)
        ends = edges[np.searchsorted(edges, starts, "right")] if self.lower else np.append(starts[1:], n)
        return Tokens(whole, starts, ends, span_hashes(cps, starts, ends), np.searchsorted(starts, bounds))

    def _contractions(self, cps: np.ndarray, kind: np.ndarray, run: np.ndarray, opens: np.ndarray) -> Iterator[tuple[int, int]]:
        """Places of an apostrophe that 's, 't, 're, 've, 'm, 'll or 'd begins with, and the letters after it."""
        for i in np.flatnonzero((cps == 39) & run).tolist():
            if i + 1 >= len(cps) or opens[i + 1] or kind[i + 1] != LETTER:
                continue
            if not self.lower and i > 0 and cps[i - 1] == 32 and not opens[i]:
                continue
            one = chr(cps[i + 1])
            two = one + chr(cps[i + 2]) if i + 2 < len(cps) and not opens[i + 2] else one
            if one in "stmd":
                yield i, 1
            elif two in ("re", "ve", "ll"):
                yield i, 2


def cut(text: str, size: int = AT_ONCE) -> list[str]:
    """The text in pieces of about ``size``, cut where a pre-token ends whatever stands around: before white space that follows
    something else, and where a run of letters or numbers ends.

    A piece is longer only where a single pre-token is.
    """
    out, at = [], 0
    while len(text) - at > 2 * size:
        to, look = at + size, 256
        while to < len(text):
            kind = classes()[np.frombuffer(text[to - 1 : to + look].encode("utf-32-le", "surrogatepass"), np.uint32)]
            before, after = kind[:-1], kind[1:]
            ends = np.flatnonzero((before != after) & ((after == SPACE) | (before == LETTER) | (before == NUMBER)))
            if len(ends):
                to += int(ends[0])
                break
            to += look
            look *= 2
        if to >= len(text):
            break
        out.append(text[at:to])
        at = to
    out.append(text[at:])
    return out


def grouped(texts: Iterable[str], size: int = AT_ONCE) -> Iterator[tuple[list[str], list[bool]]]:
    """Groups of pieces of about ``size`` code points; a flag tells whether the piece ends its text."""
    pieces: list[str] = []
    ends: list[bool] = []
    held = 0
    for text in texts:
        parts = cut(text, size)
        for k, part in enumerate(parts):
            pieces.append(part)
            ends.append(k + 1 == len(parts))
            held += len(part)
            if held >= size:
                yield pieces, ends
                pieces, ends, held = [], [], 0
    if pieces:
        yield pieces, ends


class Table:
    """An open-addressing hash table from non-zero 64-bit keys to 32-bit numbers, filled and asked by arrays."""

    def __init__(self, bits: int = 16):
        self.bits, self.used = bits, 0
        self.keys, self.values = np.zeros(1 << bits, np.uint64), np.zeros(1 << bits, np.int32)

    @classmethod
    def of(cls, keys: np.ndarray, values: np.ndarray) -> Table:
        out = cls(max(4, int(2 * len(keys)).bit_length()))
        out.insert(keys, values)
        return out

    def find(self, keys: np.ndarray) -> np.ndarray:
        """The numbers, -1 for keys that aren't there."""
        mask = (1 << self.bits) - 1
        slot = (keys >> np.uint64(64 - self.bits)).astype(np.int64)
        held = self.keys[slot]
        out = np.where(held == keys, self.values[slot], np.int32(-1))
        open_ = np.flatnonzero((held != keys) & (held != 0))
        while len(open_):
            at = (slot[open_] + 1) & mask
            slot[open_] = at
            held, asked = self.keys[at], keys[open_]
            hit = held == asked
            out[open_[hit]] = self.values[at[hit]]
            open_ = open_[~hit & (held != 0)]
        return out

    def insert(self, keys: np.ndarray, values: np.ndarray) -> None:
        """Keys must be distinct and new."""
        while 2 * (self.used + len(keys)) > len(self.keys):
            full = self.keys != 0
            old = self.keys[full], self.values[full]
            self.bits += 1
            self.keys, self.values = np.zeros(1 << self.bits, np.uint64), np.zeros(1 << self.bits, np.int32)
            self._place(*old)
        self._place(keys, values.astype(np.int32))
        self.used += len(keys)

    def _place(self, keys: np.ndarray, values: np.ndarray) -> None:
        mask = (1 << self.bits) - 1
        slot = (keys >> np.uint64(64 - self.bits)).astype(np.int64)
        left = np.arange(len(keys))
        while len(left):
            at = slot[left]
            free = self.keys[at] == 0
            self.keys[at[free]] = keys[left[free]]
            won = self.keys[at] == keys[left]
            self.values[at[won]] = values[left[won]]
            left = left[~won]
            slot[left] = (slot[left] + 1) & mask


class WordStore:
    """A worker's cache of pre-tokens with their ids; it starts anew when it holds ``most`` of them."""

    def __init__(self, tokenizer, most: int = 1 << 19):
        self.tokenizer, self.most = tokenizer, most
        self._clear()

    def _clear(self) -> None:
        self.table = Table()
        self.n = self.n_ids = 0
        self.offsets, self.lengths = np.zeros(1 << 12, np.int64), np.zeros(1 << 12, np.int32)
        self.ids = np.zeros(1 << 14, np.int32)

    def find(self, tokens: Tokens, which: np.ndarray | None = None) -> np.ndarray:
        """Word numbers of the pre-tokens (or of those at ``which``); unknown ones are merged by the library first.

        Numbers hold until the next call.
        """
        if self.n > self.most:
            self._clear()
        hashes = tokens.hashes if which is None else tokens.hashes[which]
        out = self.table.find(hashes)
        unknown = np.flatnonzero(out < 0)
        if len(unknown):
            keys, at = np.unique(hashes[unknown], return_index=True)
            places = unknown[at] if which is None else which[unknown[at]]
            self._add(keys, [tokens.word(i) for i in places.tolist()])
            out[unknown] = self.table.find(hashes[unknown])
        return out

    def _add(self, keys: np.ndarray, words: list[str]) -> None:
        merged = self.tokenizer.model.tokenize  # the words are pre-tokens already: only their bytes are left to merge
        found = [[t.id for t in merged(w.encode("utf-8", "surrogatepass").decode("latin-1").translate(BYTE_CHARS))] for w in words]
        lengths = np.fromiter(map(len, found), np.int32, len(found))
        total = int(lengths.sum())
        flat = np.fromiter((i for ids in found for i in ids), np.int32, total)
        self.offsets, self.lengths = (_room(a, self.n + len(found)) for a in (self.offsets, self.lengths))
        self.ids = _room(self.ids, self.n_ids + total)
        self.offsets[self.n : self.n + len(found)] = self.n_ids + np.cumsum(lengths) - lengths
        self.lengths[self.n : self.n + len(found)] = lengths
        self.ids[self.n_ids : self.n_ids + total] = flat
        self.table.insert(keys, np.arange(self.n, self.n + len(found)))
        self.n += len(found)
        self.n_ids += total


def _room(a: np.ndarray, size: int) -> np.ndarray:
    if size <= len(a):
        return a
    out = np.zeros(max(size, 2 * len(a)), a.dtype)
    out[: len(a)] = a
    return out


def gathered(flat: np.ndarray, offsets: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """The slices of ``flat`` one after another."""
    total = int(lengths.sum())
    if not total:
        return flat[:0]
    begins = np.cumsum(lengths) - lengths
    return flat[np.repeat(offsets - begins, lengths) + np.arange(total)]


@functools.cache
def loaded(path: str):
    """The tokenizer of a file, truncation and padding switched off, once in each worker."""
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(path)
    tokenizer.no_truncation()
    tokenizer.no_padding()
    return tokenizer


@functools.cache
def store(path: str) -> WordStore:
    """The process's cache for a file: a worker that runs several tasks merges a pre-token once."""
    return WordStore(loaded(path))


@functools.cache
def scheme(path: str) -> Scheme:
    return Scheme(path)
