"""Language identification with hyperdimensional profiles.

Every letter of any script has a random vector of +1 and -1. The vector of a letter trigram binds the letters' vectors, the first two
permuted (rotated by two places and by one) so that their order counts, by multiplication. A text is the bundle, the
sum, of its trigrams' vectors; a language's prototype is the bundle of its texts' unit vectors. A text gets the
language whose prototype has the greatest cosine with it.
"""

from __future__ import annotations

import functools
import unicodedata
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import textscan
from .common import small_batches
from .workers import tidy

#: Of the vectors; a multiple of 64.
DIMENSIONS = 1024
UNKNOWN = "und"
#: Unit vectors are summed as integers, so sums don't depend on their order.
UNIT = 1 << 20
#: Bits of a code point; a trigram's code is three of them.
CP_BITS = 21
#: Trigrams whose vectors a worker keeps; it starts anew beyond.
KEPT = 1 << 15
#: Trigrams that are multiplied with their vectors at once.
AT_ONCE = 1 << 12
#: Trigrams of a group's letters up to which they are counted in a table instead of sorted.
DENSE_CODES = 1 << 21
#: Languages that are learned at most, the ones with most documents.
MOST_LANGUAGES = 1024


@functools.cache
def symbols() -> np.ndarray:
    """For each code point its lower case if it is a letter or a mark, else 0, the boundary."""
    out = np.zeros(0x110000, np.int32)
    for cp in range(0x110000):
        kind = unicodedata.category(chr(cp))
        if kind[0] in "LM":
            out[cp] = ord(chr(cp).lower()[0]) if kind[0] == "L" else cp
    return out


@functools.cache
def letters() -> np.ndarray:
    return textscan.classes() == textscan.LETTER


class Space:
    """The vectors of letters, and of trigrams as they come to be needed.

    A letter's vector comes from a hash of its code point and ``seed``, so every code point has one of its own and all
    workers agree on it.
    """

    def __init__(self, dimensions: int, seed: int):
        self.dimensions, self.seed = dimensions, seed
        self._clear()

    def _clear(self) -> None:
        self.codes = np.zeros(0, np.int64)
        self.rows = np.zeros(0, np.int64)
        self.vectors = np.zeros((0, self.dimensions), np.int8)

    def letter_vectors(self, cps: np.ndarray) -> np.ndarray:
        words = np.arange((self.dimensions + 63) // 64, dtype=np.uint64)[None, :]
        mixed = textscan.finalised(cps.astype(np.uint64)[:, None] * np.uint64(0x9E3779B97F4A7C15) + np.uint64(self.seed))
        bits = textscan.finalised(mixed + (words + np.uint64(1)) * np.uint64(0xBF58476D1CE4E5B9))
        return np.unpackbits(bits.astype("<u8").view(np.uint8), axis=1, count=self.dimensions).astype(np.int8) * 2 - 1

    def bound(self, codes: np.ndarray) -> np.ndarray:
        """The vectors of trigrams: the first letter's rotated by two places, the second's by one, times the third's."""
        out = np.ones((len(codes), self.dimensions), np.int8)
        for place in range(3):
            cps, at = np.unique(codes >> (CP_BITS * (2 - place)) & ((1 << CP_BITS) - 1), return_inverse=True)
            out *= np.roll(self.letter_vectors(cps), 2 - place, axis=1)[at]
        return out

    def of(self, codes: np.ndarray) -> np.ndarray:
        """The vectors of sorted distinct trigrams, from the cache where it has them."""
        at = np.searchsorted(self.codes, codes)
        known = np.zeros(len(codes), bool)
        inside = at < len(self.codes)
        known[inside] = self.codes[at[inside]] == codes[inside]
        if not known.all():
            if len(self.codes) + int((~known).sum()) > KEPT:
                self._clear()
                known[:] = False
                if len(codes) > KEPT:
                    return self.bound(codes)
            new = codes[~known]
            self.vectors = np.concatenate([self.vectors, self.bound(new)])
            order = np.argsort(np.concatenate([self.codes, new]), kind="stable")
            self.rows = np.concatenate([self.rows, np.arange(len(self.vectors) - len(new), len(self.vectors))])[order]
            self.codes = np.concatenate([self.codes, new])[order]
            at = np.searchsorted(self.codes, codes)
        return self.vectors[self.rows[at]]

    def bundles(self, text: np.ndarray, column: np.ndarray, codes: np.ndarray, n: int) -> np.ndarray:
        """The sums of trigrams' vectors by ``text`` (numbers below ``n``): whole numbers, so the way of adding them doesn't show.

        ``codes`` are the sorted distinct trigrams, ``column`` says which one stands at each place. Frequent trigrams are multiplied
        as a matrix of counts, the others are added one by one.
        """
        out = np.zeros((n, self.dimensions), np.float32)
        times = np.bincount(column, minlength=len(codes))
        frequent = times * 24 >= n
        place = np.zeros(len(codes), np.int64)
        place[frequent] = np.arange(int(frequent.sum()))
        place[~frequent] = np.arange(len(codes) - int(frequent.sum()))
        at = frequent[column]
        many, wide = codes[frequent], place[column[at]]
        counts = np.bincount(wide * n + text[at], minlength=n * len(many)).reshape(len(many), n) if len(many) * n < 1 << 24 else None
        order = np.argsort(wide, kind="stable") if counts is None else None
        for begin in range(0, len(many), AT_ONCE):
            end = min(begin + AT_ONCE, len(many))
            if counts is None:
                some = order[slice(*np.searchsorted(wide[order], [begin, end]))]
                part = np.bincount((wide[some] - begin) * n + text[at][some], minlength=n * (end - begin)).reshape(end - begin, n)
            else:
                part = counts[begin:end]
            out += part.T.astype(np.float32) @ self.of(many[begin:end]).astype(np.float32)
        few, rare, text = codes[~frequent], place[column[~at]], text[~at]
        order = np.argsort(rare, kind="stable")
        rare, text = rare[order], text[order]
        for begin in range(0, len(few), AT_ONCE):
            vectors = self.of(few[begin : begin + AT_ONCE])
            some = slice(*np.searchsorted(rare, [begin, begin + AT_ONCE]))
            by_text = np.argsort(text[some], kind="stable")
            t, c = text[some][by_text], rare[some][by_text] - begin
            for a in range(0, len(t), AT_ONCE):
                part = slice(a, a + AT_ONCE)
                starts = np.flatnonzero(np.concatenate([[True], t[part][1:] != t[part][:-1]]))
                out[t[part][starts]] += np.add.reduceat(vectors[c[part]], starts, dtype=np.int32)
        return out


def _runs(cps: np.ndarray, text: np.ndarray, before: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The symbols of code points with one boundary for each run of them; ``before`` are symbols that go before."""
    kind = np.concatenate([before, symbols()[cps]])
    text = np.concatenate([np.full(len(before), text[0] if len(text) else 0), text])
    keep = np.ones(len(kind), bool)
    keep[1:] = (kind[1:] != 0) | (kind[:-1] != 0) | (text[1:] != text[:-1])
    return kind[keep].astype(np.int64), text[keep]


def _trigrams(kind: np.ndarray, text: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(text, column, codes) of all trigrams that lie in one text: the sorted distinct codes, and which of them each is."""
    inside = text[:-2] == text[2:]
    present = np.flatnonzero(np.bincount(kind))
    size = len(present)
    if size**3 > DENSE_CODES:
        code = kind[:-2] << (2 * CP_BITS) | kind[1:-1] << CP_BITS | kind[2:]
        codes, column = np.unique(code[inside], return_inverse=True)
        return text[:-2][inside], column, codes
    number = np.zeros(int(present[-1]) + 1, np.int32)
    number[present] = np.arange(size)
    small = number[kind]
    code = ((small[:-2] * size + small[1:-1]) * size + small[2:])[inside]
    found = np.flatnonzero(np.bincount(code))
    column = np.zeros(size**3, np.int32)
    column[found] = np.arange(len(found))
    codes = present[found // size**2] << (2 * CP_BITS) | present[found // size % size] << CP_BITS | present[found % size]
    return text[:-2][inside], column[code], codes


def _code_points(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)


def text_vectors(space: Space, texts: list[str], size: int = 1 << 18) -> tuple[np.ndarray, np.ndarray]:
    """The bundles of whole texts, and whether each has a letter.

    Short texts are worked on together, some ``size`` code points at a time. A longer one goes in pieces; the last two symbols
    of a piece go before the next, so each trigram counts once wherever the text is cut.
    """
    vectors, has = np.zeros((len(texts), space.dimensions), np.float64), np.zeros(len(texts), bool)
    group: list[int] = []
    held = 0

    def work() -> None:
        cps = _code_points("".join(f" {texts[i]} " for i in group))
        number = np.repeat(np.arange(len(group)), [len(texts[i]) + 2 for i in group])
        has[group] = np.bincount(number[letters()[cps]], minlength=len(group)) > 0
        kind, number = _runs(cps, number, np.zeros(0, np.int32))
        if len(kind) > 2:
            vectors[group] = space.bundles(*_trigrams(kind, number), len(group))

    for i, text in enumerate(texts):
        if len(text) <= size:
            group.append(i)
            held += len(text) + 2
        else:
            before = np.zeros(1, np.int32)
            for a in range(0, len(text), size):
                cps = _code_points(text[a : a + size] + (" " if a + size >= len(text) else ""))
                has[i] |= letters()[cps].any()
                kind, number = _runs(cps, np.zeros(len(cps), np.int64), before)
                if len(kind) > 2:
                    vectors[i] += space.bundles(*_trigrams(kind, number), 1)[0]
                before = kind[-2:].astype(np.int32)
        if held >= size:
            work()
            group, held = [], 0
    if group:
        work()
    return vectors, has


def _slices(batches: Iterator[pa.RecordBatch], rows: int = 1024) -> Iterator[pa.RecordBatch]:
    """Parts of the batches whose documents' vectors are held at once."""
    return (batch.slice(i, rows) for batch in batches for i in range(0, batch.num_rows, rows))


@dataclass
class Profiles:
    languages: list[str]
    prototypes: np.ndarray
    dimensions: int
    seed: int


def fit(docs: DataFrame, text_col: str = "text", lang_col: str = "lang", dimensions: int = DIMENSIONS, seed: int = 7, most: int = MOST_LANGUAGES) -> Profiles:
    """Prototypes of the languages of ``docs``, from all its texts with a language and a letter.

    Each part of the input adds up its own bundles; what is gathered is one vector for each language. ``most`` bounds the model:
    if there are more languages, as with labels that hold errors, those with most documents are learned, ties by code point.

    * null texts, null languages, texts without a letter: not learned from; an empty table: no languages;
    * repeated rows: each counts; very long texts: whole; other columns are not read.
    """
    small_batches(docs.sparkSession)
    named = docs.select(F.col(lang_col).cast("string").alias("lang"), F.col(text_col).isNotNull().alias("t")).where("t AND lang IS NOT NULL")
    wanted = {r.lang for r in named.groupBy("lang").count().orderBy(F.desc("count"), "lang").limit(most).collect()}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        space, sums = Space(dimensions, seed), {}
        for batch in _slices(batches):
            langs = batch.column(1).to_pylist()
            vectors, has = text_vectors(space, batch.column(0).to_pylist())
            norms = np.linalg.norm(vectors, axis=1)
            units = np.rint(vectors / np.maximum(norms, 1e-9)[:, None] * UNIT).astype(np.int64)
            for lang in wanted.intersection(langs):
                mine = np.array([x == lang for x in langs]) & has
                sums[lang] = sums.get(lang, 0) + units[mine].sum(axis=0)
        if sums:
            yield pa.RecordBatch.from_arrays([pa.array(list(sums)), pa.array([v.tolist() for v in sums.values()], pa.list_(pa.int64()))], ["lang", "v"])

    rows = docs.select(F.col(text_col).cast("string").alias("text"), F.col(lang_col).cast("string").alias("lang")).where("text IS NOT NULL AND lang IS NOT NULL")
    sums = rows.mapInArrow(tidy(run), "lang string, v array<long>").select("lang", F.posexplode("v").alias("i", "x"))
    sums = sums.groupBy("lang", "i").agg(F.sum("x").alias("x")).groupBy("lang").agg(F.array_sort(F.collect_list(F.struct("i", "x"))).alias("v"))
    found = sorted((r.lang, [p.x for p in r.v]) for r in sums.collect())  # a row for each of the languages, at most ``most``
    found = [(lang, v) for lang, v in found if any(v)]
    prototypes = np.array([v for _, v in found], np.float64).reshape(len(found), dimensions)
    prototypes /= np.maximum(np.linalg.norm(prototypes, axis=1, keepdims=True), 1e-9)
    return Profiles([lang for lang, _ in found], prototypes, dimensions, seed)


def predict(docs: DataFrame, profiles: Profiles, text_col: str = "text", lang_out: str = "lang_pred", score_out: str = "score") -> DataFrame:
    """All columns of ``docs`` (replacing ones of the output's names) with the language of each whole text and its cosine, 0 if negative.

    * null, empty and letterless texts, and all texts if no language was learned: ``und`` with score 0;
    * ties: the language first in code point order; repeated rows: kept, with equal results;
    * very long texts: whole, in pieces; an empty table: an empty result.
    """
    rows = docs.drop(lang_out, score_out)
    at = rows.columns.index(text_col)
    names = [f"c{i}" for i in range(len(rows.columns))]  # columns can have clashing names

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        space = Space(profiles.dimensions, profiles.seed)
        for batch in _slices(batches):
            vectors, has = text_vectors(space, [t or "" for t in batch.column(at).to_pylist()])
            if profiles.languages:
                norms = np.maximum(np.linalg.norm(vectors, axis=1), 1e-9)
                cosine = vectors @ profiles.prototypes.T / norms[:, None]
                best = cosine.argmax(axis=1)
                score = np.where(has, np.clip(cosine[np.arange(len(best)), best], 0, 1), 0.0)
                lang = [profiles.languages[b] if h else UNKNOWN for b, h in zip(best.tolist(), has.tolist(), strict=True)]
            else:
                score, lang = np.zeros(len(has)), [UNKNOWN] * len(has)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(lang, pa.string()), pa.array(score)], [*names, "lang", "score"])

    kinds = ", ".join(f"{n} {f.dataType.simpleString()}" for n, f in zip(names, rows.schema, strict=True))
    return rows.toDF(*names).mapInArrow(tidy(run), f"{kinds}, lang string, score double").toDF(*rows.columns, lang_out, score_out)
