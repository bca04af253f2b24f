"""The most frequent pre-tokens of a whole corpus."""

from __future__ import annotations

import heapq
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import textscan
from .common import small_batches
from .workers import tidy

#: Distinct pre-tokens a worker counts before it forgets the rare ones, and those it reports for its part.
HELD, REPORTED = 1 << 20, 1 << 14
#: Pre-tokens of a merged summary, and tasks whose summaries the driver gets.
MERGED, GATHERED = 1 << 16, 4


class _Counter:
    def __init__(self) -> None:
        self.table = textscan.Table()
        self.words: list[str] = []
        self.counts = np.zeros(1 << 12, np.int64)

    def add(self, tokens: textscan.Tokens) -> None:
        at = self.table.find(tokens.hashes)
        new = np.flatnonzero(at < 0)
        if len(new):
            keys, first = np.unique(tokens.hashes[new], return_index=True)
            self.table.insert(keys, np.arange(len(self.words), len(self.words) + len(keys)))
            self.words += [tokens.word(i) for i in new[first].tolist()]
            at[new] = self.table.find(tokens.hashes[new])
        n = len(self.words)
        if n > len(self.counts):
            self.counts = np.concatenate([self.counts, np.zeros(max(n, len(self.counts)), np.int64)])
        self.counts[:n] += np.bincount(at, minlength=n)
        if n > HELD:
            self.keep(HELD // 4)

    def keep(self, most: int) -> None:
        n = len(self.words)
        if n <= most:
            return
        kept = np.sort(np.argpartition(-self.counts[:n], most)[:most])
        number = np.full(n, -1, np.int32)
        number[kept] = np.arange(most)
        full = self.table.keys != 0
        keys, values = self.table.keys[full], number[self.table.values[full]]
        self.table = textscan.Table.of(keys[values >= 0], values[values >= 0])
        self.words = [self.words[i] for i in kept.tolist()]
        self.counts = np.concatenate([self.counts[kept], np.zeros(most, np.int64)])


SUMMARY = "words array<string>, counts array<long>"


def _summary(words: list[str], counts: np.ndarray) -> pa.RecordBatch:
    lists = lambda values, kind: pa.ListArray.from_arrays(pa.array([0, len(values)], pa.int32()), pa.array(values, kind))
    return pa.RecordBatch.from_arrays([lists(words, pa.string()), lists(counts[: len(words)], pa.int64())], ["words", "counts"])


def _merged(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """One summary of those of a part, which are added up one after another."""
    sums: dict[str, int] = {}
    for batch in batches:
        for words, counts in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            for word, n in zip(words, counts, strict=True):
                sums[word] = sums.get(word, 0) + n
            if len(sums) > 4 * MERGED:
                sums = dict(_greatest(sums, MERGED))
    if sums:
        kept = _greatest(sums, MERGED)
        yield _summary([w for w, _ in kept], np.array([n for _, n in kept], np.int64))


def _greatest(sums: dict[str, int], most: int) -> list[tuple[str, int]]:
    return heapq.nsmallest(most, sums.items(), key=lambda x: (-x[1], x[0]))


def frequent_pretokens(docs: DataFrame, text_col: str, path: str, most: int) -> list[str]:
    """At most ``most`` pre-tokens of all texts with the greatest counts, the most frequent first, ties by code point.

    All texts are counted. A worker holds a bounded number of pre-tokens and makes one summary of its part, of bounded size. The
    summaries, one row each, are merged in a tree: by the session's shuffle partitions, then in GATHERED tasks, whose
    results are collected. No pre-token is ever a row, let alone a key, and the driver gets the same few summaries
    however many parts there are. A pre-token that is rare in every part can miss the list, which only costs its users a
    slower lookup. Texts with special strings and nulls are left out.
    """

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scheme, counter = textscan.scheme(path), _Counter()
        for batch in batches:
            texts = (scheme.normalised(t) for t in batch.column(0).to_pylist() if t and not scheme.has_special(t))
            for pieces, _ in textscan.grouped(texts):
                counter.add(scheme.tokens(pieces))
        counter.keep(REPORTED)
        if counter.words:
            yield _summary(counter.words, counter.counts)

    small_batches(docs.sparkSession)
    parts = docs.select(F.col(text_col).cast("string").alias("text")).mapInArrow(tidy(count), SUMMARY).withColumn("part", F.spark_partition_id())
    merged = parts.repartition("part").select("words", "counts").mapInArrow(tidy(_merged), SUMMARY)
    found = merged.repartition(GATHERED).mapInArrow(tidy(_merged), SUMMARY).collect()
    sums: dict[str, int] = {}
    for row in found:
        for word, n in zip(row.words, row.counts, strict=True):
            sums[word] = sums.get(word, 0) + n
    return [w for w, _ in _greatest(sums, most)]
