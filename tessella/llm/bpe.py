"""Byte-level BPE encoding and decoding with a lexicon that is a minimal acyclic transducer.

The corpus's most frequent pre-tokens are compiled into an automaton that shares prefixes and suffixes. Every
transition carries how many words lie before it, so the sum along a word's path is the word's number, and the
number leads to its ids. Workers map the compiled lexicon from a file. Pre-tokens that it doesn't hold are merged
exactly, once in each worker, and kept in a cache of bounded size.
"""

from __future__ import annotations

import json
import os
import struct
import tempfile
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import textscan
from .frequent import frequent_pretokens
from .workers import tidy

LEXICON_WORDS = 1 << 15
#: Ids in a record batch that a worker hands on.
BATCH_IDS = 1 << 20


def minimal_automaton(words: list[str]) -> tuple[list[dict[str, int]], list[bool]]:
    """States (transitions by character; state 0 is the root) and whether a word ends there, for sorted distinct words.

    Words are added one after another; when the next word leaves a branch for good, its states are replaced by equal
    ones that exist already, from the end of the branch to its beginning.
    """
    states: list[dict[str, int]] = [{}]
    final = [False]
    known: dict[tuple, int] = {}
    path: list[tuple[int, str, int]] = []  # the branch that isn't settled yet

    def settle(depth: int) -> None:
        while len(path) > depth:
            parent, char, state = path.pop()
            same = known.setdefault((final[state], *sorted(states[state].items())), state)
            if same != state:
                states[parent][char] = same
                free.append(state)

    free: list[int] = []
    previous = ""
    for word in words:
        shared = 0
        while shared < min(len(word), len(previous)) and word[shared] == previous[shared]:
            shared += 1
        settle(shared)
        at = path[-1][2] if path else 0
        for char in word[shared:]:
            if free:
                new = free.pop()
                states[new], final[new] = {}, False
            else:
                new = len(states)
                states.append({})
                final.append(False)
            states[at][char] = new
            path.append((at, char, new))
            at = new
        final[at] = True
        previous = word
    settle(0)
    return states, final


class Lexicon:
    """The compiled transducer: arrays that can be written to a file and mapped from it."""

    FIELDS = (("keys", "<u8"), ("values", "<i4"), ("target", "<i4"), ("skip", "<i4"), ("final", "|b1"), ("offsets", "<i8"), ("lengths", "<i4"), ("ids", "<i4"))

    def __init__(self, arrays: dict[str, np.ndarray]):
        self.arrays = arrays
        self.table = textscan.Table(4)
        self.table.bits = len(arrays["keys"]).bit_length() - 1
        self.table.keys, self.table.values = arrays["keys"], arrays["values"]
        self.target, self.skip, self.final = arrays["target"], arrays["skip"], arrays["final"]
        self.offsets, self.lengths, self.ids = arrays["offsets"], arrays["lengths"], arrays["ids"]

    @classmethod
    def compile(cls, words: list[str], ids: list[list[int]]) -> Lexicon:
        order = sorted(range(len(words)), key=words.__getitem__)
        states, final = minimal_automaton([words[i] for i in order])
        below = {}

        def count(root: int) -> int:
            stack = [root]
            while stack:
                state = stack[-1]
                waiting = [t for t in states[state].values() if t not in below]
                if waiting:
                    stack += waiting
                else:
                    below[state] = final[state] + sum(below[t] for t in states[state].values())
                    stack.pop()
            return below[root]

        count(0)
        source, char, target, skip = [], [], [], []
        for state in below:
            passed = int(final[state])
            for c, t in sorted(states[state].items()):
                source.append(state)
                char.append(ord(c))
                target.append(t)
                skip.append(passed)
                passed += below[t]
        keys = cls._keys(np.array(source, np.int64), np.array(char, np.int64))
        table = textscan.Table.of(keys, np.arange(len(keys)))
        lengths = np.array([len(ids[i]) for i in order], np.int32)
        flat = np.array([x for i in order for x in ids[i]], np.int32)
        found = (table.keys, table.values, target, skip, final, np.cumsum(lengths) - lengths, lengths, flat)
        return cls({name: np.asarray(a, kind) for (name, kind), a in zip(cls.FIELDS, found, strict=True)})

    @staticmethod
    def _keys(state: np.ndarray, char: np.ndarray) -> np.ndarray:
        return textscan.finalised((state.astype(np.uint64) << np.uint64(21)) | char.astype(np.uint64) | np.uint64(1 << 60))  # one to one

    def to_bytes(self) -> bytes:
        sizes = struct.pack(f"<{len(self.FIELDS)}Q", *(self.arrays[name].nbytes for name, _ in self.FIELDS))
        body = b"".join(self.arrays[name].tobytes() + bytes(-self.arrays[name].nbytes % 8) for name, _ in self.FIELDS)
        return sizes + body

    @classmethod
    def mapped(cls, data: bytes) -> Lexicon:
        """The lexicon mapped from a file in this process's temporary folder; the file's name is removed at once."""
        handle, path = tempfile.mkstemp(suffix=".lexicon")
        with os.fdopen(handle, "wb") as file:
            file.write(data)
        whole = np.memmap(path, np.uint8, "r")
        os.unlink(path)
        sizes = struct.unpack_from(f"<{len(cls.FIELDS)}Q", data)
        at, arrays = 8 * len(sizes), {}
        for (name, kind), size in zip(cls.FIELDS, sizes, strict=True):
            arrays[name] = whole[at : at + size].view(kind)
            at += size + -size % 8
        return cls(arrays)

    def find(self, cps: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        """Numbers of the words in these spans of code points, -1 where a span isn't in the lexicon; all spans step together."""
        out = np.full(len(starts), -1, np.int64)
        alive, at = np.arange(len(starts)), starts.astype(np.int64)
        state, number, last = np.zeros(len(starts), np.int64), np.zeros(len(starts), np.int64), ends.astype(np.int64)
        while len(alive):
            step = self.table.find(self._keys(state, cps[at]))
            go = step >= 0
            step = step[go]
            alive, at, last = alive[go], at[go] + 1, last[go]
            state, number = self.target[step].astype(np.int64), number[go] + self.skip[step]
            done = at == last
            ended = done & self.final[state]
            out[alive[ended]] = number[ended]
            more = ~done
            alive, at, last, state, number = alive[more], at[more], last[more], state[more], number[more]
        return out


def compiled(words: list[str], path: str) -> Lexicon:
    found = textscan.loaded(path).encode_batch(words, add_special_tokens=False) if words else []
    return Lexicon.compile(words, [e.ids for e in found])


def encode(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text", lexicon_words: int = LEXICON_WORDS, decoded_col: str | None = None) -> DataFrame:
    """One row for each row of ``docs``: the id and ``ids``, as the library encodes the whole text without added tokens.

    With ``decoded_col`` also the text that the ids stand for, as :func:`decode` makes it, in the same workers.

    * null and empty texts: no ids; very long texts: worked on in pieces cut between two pre-tokens;
    * texts with the tokenizer's special strings are given to the library whole;
    * null ids and repeated rows: kept, row for row; an empty table: an empty result; other columns are not read.
    """
    spark = docs.sparkSession
    shared = spark.sparkContext.broadcast(compiled(frequent_pretokens(docs, text_col, path, lexicon_words), path).to_bytes())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scheme, library = textscan.scheme(path), textscan.loaded(path)
        lexicon, store = Lexicon.mapped(shared.value), textscan.store(path)
        meaning = token_bytes(path) if decoded_col else None

        def ids_of(tokens: textscan.Tokens) -> tuple[np.ndarray, np.ndarray]:
            cps = np.frombuffer(tokens.whole.encode("utf-32-le", "surrogatepass"), np.uint32)
            words = lexicon.find(cps, tokens.starts, tokens.ends)
            unseen = np.flatnonzero(words < 0)
            others = store.find(tokens, unseen)
            offsets, lengths = lexicon.offsets[words], lexicon.lengths[words].copy()
            base = len(lexicon.ids)
            offsets[unseen], lengths[unseen] = base + store.offsets[others], store.lengths[others]
            flat = np.concatenate([lexicon.ids, store.ids[: store.n_ids]])
            return textscan.gathered(flat, offsets, lengths), np.concatenate([[0], np.cumsum(lengths, dtype=np.int64)])[tokens.first]

        for batch in batches:
            texts = [t or "" for t in batch.column(1).to_pylist()]
            special = {i: np.array(library.encode(t, add_special_tokens=False).ids, np.int32) for i, t in enumerate(texts) if scheme.has_special(t)}
            held: list[np.ndarray] = []
            sizes: list[int] = []
            begin = done = open_ = 0

            def made() -> pa.RecordBatch:
                values = np.concatenate(held) if held else np.zeros(0, np.int32)
                offsets = np.concatenate([[0], np.cumsum(sizes)]).astype(np.int32)
                columns = [batch.column(0).slice(begin, done - begin), pa.ListArray.from_arrays(pa.array(offsets), pa.array(values, pa.int32()))]
                if meaning:
                    columns.append(pa.array(decoded(values, sizes, *meaning), pa.string()))
                return pa.RecordBatch.from_arrays(columns, names)

            for pieces, ends in textscan.grouped(scheme.normalised("" if i in special else t) for i, t in enumerate(texts)):
                flat, sums = ids_of(scheme.tokens(pieces))
                at = sums.tolist()
                for k, last in enumerate(ends):
                    held.append(flat[at[k] : at[k + 1]])
                    open_ += at[k + 1] - at[k]
                    if last:
                        if done in special:
                            held.append(special[done])
                            open_ += len(special[done])
                        sizes.append(open_)
                        done, open_ = done + 1, 0
                if sum(sizes) >= BATCH_IDS and ends[-1]:
                    yield made()
                    begin, held, sizes = done, [], []
            if done > begin:
                yield made()

    rows = docs.select(F.col(id_col).alias(id_col), F.col(text_col).cast("string").alias("text"))
    kinds = [rows.schema[0], T.StructField("ids", T.ArrayType(T.IntegerType()))]
    kinds += [T.StructField(decoded_col, T.StringType())] if decoded_col else []
    names = [k.name for k in kinds]
    return rows.mapInArrow(tidy(run), T.StructType(kinds))


def token_bytes(path: str) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The bytes of all tokens one after another, and each id's offset and length."""
    with open(path, encoding="utf-8") as file:
        spec = json.load(file)
    byte = {c: b for b, c in textscan.BYTE_CHARS.items()}
    table = {i: bytes(byte[c] for c in token) for token, i in spec["model"]["vocab"].items()}
    table |= {t["id"]: t["content"].encode() for t in spec["added_tokens"]}
    parts = [table.get(i, b"") for i in range(max(table) + 1)]
    lengths = np.array([len(p) for p in parts], np.int64)
    return np.frombuffer(b"".join(parts), np.uint8), np.cumsum(lengths) - lengths, lengths


def decoded(ids: np.ndarray, counts: list[int], flat: np.ndarray, offsets: np.ndarray, lengths: np.ndarray) -> list[str]:
    """The texts of documents whose ids follow one another, ``counts`` of them each; unknown ids stand for nothing."""
    out, at = [], 0
    upto = np.concatenate([[0], np.cumsum(counts)]).astype(np.int64)
    while at < len(counts):
        to = max(at + 1, int(np.searchsorted(upto, upto[at] + (1 << 18), "right")) - 1)
        values = ids[upto[at] : upto[to]].astype(np.int64)
        known = (values >= 0) & (values < len(lengths))
        values = np.where(known, values, 0)
        size = np.where(known, lengths[values], 0)
        data = textscan.gathered(flat, offsets[values], size).tobytes()
        cuts = np.concatenate([[0], np.cumsum(size)])[upto[at : to + 1] - upto[at]].tolist()
        out += [data[a:b].decode("utf-8", "replace") for a, b in zip(cuts, cuts[1:], strict=False)]
        at = to
    return out


def decode(encoded: DataFrame, path: str, ids_col: str = "ids", out_col: str = "decoded") -> DataFrame:
    """All columns of ``encoded`` and the text its ids stand for, special tokens included; bytes that aren't UTF-8 become U+FFFD.

    Null ids give a null text, empty ones an empty text; ids that the tokenizer doesn't have stand for nothing.
    """
    at = encoded.columns.index(ids_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        meaning = token_bytes(path)
        for batch in batches:
            for part in (batch.slice(i, 256) for i in range(0, batch.num_rows, 256)):
                column = part.column(at)
                counts = [n or 0 for n in column.value_lengths().to_pylist()]
                texts = decoded(column.flatten().to_numpy(zero_copy_only=False), counts, *meaning)
                texts = [t if ok else None for t, ok in zip(texts, column.is_valid().to_pylist(), strict=True)]
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(texts, pa.string())], [*part.schema.names, out_col])

    return encoded.mapInArrow(tidy(run), T.StructType([*encoded.schema.fields, T.StructField(out_col, T.StringType())]))
