"""Token counts by a two-tier lookup on the map side.

A compact hash table with the token lengths of the most frequent pre-tokens (at most ``frequent`` of them, some 1.5 MB)
is broadcast; a worker encodes what misses it once and keeps the length in a cache of bounded size. Nothing is
shuffled but the bounded summaries from which the frequent pre-tokens are chosen.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import textscan
from .frequent import frequent_pretokens
from .workers import tidy

FREQUENT = 1 << 16


def length_table(words: list[str], path: str) -> textscan.Table:
    """Hashes of the pre-tokens with their numbers of tokens."""
    if not words:
        return textscan.Table()
    lengths = [len(e.ids) for e in textscan.loaded(path).encode_batch(words, add_special_tokens=False)]
    ends = np.cumsum([len(w) for w in words])
    units = np.frombuffer("".join(words).encode("utf-32-le"), np.uint32)
    keys = textscan.span_hashes(units, ends - np.array([len(w) for w in words]), ends)
    keys, at = np.unique(keys, return_index=True)
    return textscan.Table.of(keys, np.array(lengths, np.int32)[at])


def count_tokens(
    docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text", limit: int = 512, frequent: int = FREQUENT
) -> DataFrame:
    """One row for each row of ``docs``: the id, ``n_bytes`` (UTF-8), ``n_tokens``, ``over_limit`` (more than ``limit`` tokens).

    ``path`` is a tokenizers file; counts are the library's, without added tokens. Texts in which one of its special
    strings stands are given to the library whole.

    * null and empty texts: 0 bytes and tokens; very long texts: worked on in pieces cut between two pre-tokens;
    * null ids and repeated rows: kept, row for row; an empty table: an empty result;
    * other columns are not read, so their names can't clash.
    """
    spark = docs.sparkSession
    table = length_table(frequent_pretokens(docs, text_col, path, frequent), path)
    shared = spark.sparkContext.broadcast((table.bits, table.keys, table.values))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scheme, tokenizer = textscan.scheme(path), textscan.loaded(path)
        tier1 = textscan.Table()
        tier1.bits, tier1.keys, tier1.values = shared.value
        tier2 = textscan.store(path)
        for batch in batches:
            texts = [t or "" for t in batch.column(1).to_pylist()]
            special = {i: len(tokenizer.encode(t, add_special_tokens=False).ids) for i, t in enumerate(texts) if scheme.has_special(t)}
            out = np.zeros(len(texts), np.int64)
            at = 0
            for pieces, ends in textscan.grouped(scheme.normalised("" if i in special else t) for i, t in enumerate(texts)):
                tokens = scheme.tokens(pieces)
                lengths = tier1.find(tokens.hashes)
                missed = np.flatnonzero(lengths < 0)
                if len(missed):
                    words = tier2.find(tokens, missed)
                    lengths[missed] = tier2.lengths[words]
                sums = np.concatenate([[0], np.cumsum(lengths, dtype=np.int64)])
                mine = sums[tokens.first[1:]] - sums[tokens.first[:-1]]
                place = at + np.concatenate([[0], np.cumsum(ends)[:-1]]).astype(np.int64)
                np.add.at(out, place, mine)
                at += sum(ends)
            for i, n in special.items():
                out[i] = n
            sizes = [len(t.encode()) for t in texts]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(sizes, pa.int64()), pa.array(out, pa.int64()), pa.array(out > limit)], [id_col, "n_bytes", "n_tokens", "over_limit"]
            )

    rows = docs.select(F.col(id_col).alias(id_col), F.col(text_col).cast("string").alias("text"))
    kind = rows.schema[0].dataType.simpleString()
    return rows.mapInArrow(tidy(count), f"`{id_col}` {kind}, n_bytes long, n_tokens long, over_limit boolean")
