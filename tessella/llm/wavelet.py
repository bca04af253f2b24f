"""Token ids of documents in wavelet-matrix files.

A file holds the ids of a run of documents as bit-planes, the highest bit first; each plane is sorted by the bits
before it (zeros, then ones). With running counts of ones for every 512 bits, the id at a place, the occurrences of
an id up to a place and the place of its k-th occurrence are all found from the planes, a step for each of them,
without decoding the rest.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from . import scratch, textscan
from .common import small_batches
from .workers import tidy

MAGIC, HEAD = b"WMX1", struct.Struct("<4sIQQ")
BLOCK = 512
#: A file is closed after the document with which it has so many tokens.
FILE_TOKENS = 1 << 21
#: Ids that are sorted by a bit at once: their places stay in a core's own cache.
SPAN = 1 << 14
#: Arrays below so many bytes come from the worker's heap; a plane's ids mapped anew at each step would cost more than the step.
MAPPED = 1 << 23


class WaveletMatrix:
    def __init__(self, n: int, planes: list[np.ndarray], counts: list[np.ndarray], zeros: list[int]):
        self.n, self.planes, self.counts, self.zeros = n, planes, counts, zeros

    @classmethod
    def build(cls, ids: np.ndarray, bits: int) -> WaveletMatrix:
        values = np.asarray(ids)
        planes, counts, zeros = [], [], []
        for level in range(bits - 1, -1, -1):
            one = (values >> level & 1).astype(bool)
            plane = _padded(np.packbits(one, bitorder="little"))
            planes.append(plane)
            counts.append(_running(plane))
            zeros.append(len(values) - int(counts[-1][-1]))
            if level:
                values = _sorted(values, one, zeros[-1])
        return cls(len(values), planes, counts, zeros)

    def _bit(self, level: int, at: np.ndarray) -> np.ndarray:
        return (self.planes[level][at >> 3] >> (at & 7).astype(np.uint8)) & 1

    def _ones(self, level: int, upto: np.ndarray) -> np.ndarray:
        """Ones among the first ``upto`` bits of a plane."""
        upto = np.asarray(upto, np.int64)
        block = upto // BLOCK
        out = self.counts[level][block].astype(np.int64)
        words = self.planes[level].view("<u8")
        for k in range(BLOCK // 64):
            at = block * (BLOCK // 64) + k
            inside = np.clip(upto - at * 64, 0, 64)
            word = words[np.minimum(at, len(words) - 1)]
            keep = np.where(inside >= 64, np.uint64(0xFFFFFFFFFFFFFFFF), (np.uint64(1) << np.minimum(inside, 63).astype(np.uint64)) - np.uint64(1))
            out += np.bitwise_count(word & keep).astype(np.int64)
        return out

    def access(self, at) -> np.ndarray:
        """The ids at these places."""
        at = np.array(at, np.int64, ndmin=1)
        out = np.zeros(len(at), np.int64)
        for level in range(len(self.planes)):
            bit = self._bit(level, at).astype(np.int64)
            ones = self._ones(level, at)
            at = np.where(bit == 1, self.zeros[level] + ones, at - ones)
            out = out << 1 | bit
        return out

    def _descend(self, token: int, at: np.ndarray) -> np.ndarray:
        bits = len(self.planes)
        for level in range(bits):
            ones = self._ones(level, at)
            at = self.zeros[level] + ones if token >> (bits - 1 - level) & 1 else at - ones
        return at

    def rank(self, token: int, upto: int) -> int:
        """Occurrences of an id among the first ``upto`` places."""
        if not 0 <= token < 1 << len(self.planes):
            return 0
        begin, end = self._descend(token, np.array([0, min(max(upto, 0), self.n)], np.int64))
        return int(end - begin)

    def count(self, token: int) -> int:
        return self.rank(token, self.n)

    def select(self, token: int, k: int) -> int:
        """The place of the k-th occurrence (from 0) of an id; -1 if there are fewer."""
        if k < 0 or k >= self.count(token):
            return -1
        at = int(self._descend(token, np.array([0], np.int64))[0]) + k
        bits = len(self.planes)
        for level in range(bits - 1, -1, -1):
            one = token >> (bits - 1 - level) & 1
            at = self._nth(level, at - self.zeros[level] if one else at, one)
        return at

    def _nth(self, level: int, k: int, one: int) -> int:
        """The place of the k-th one or zero of a plane."""
        low, high = 0, self.n
        while low < high:  # the first place up to which there are more than k
            mid = (low + high) // 2
            ones = int(self._ones(level, np.array([mid + 1]))[0])
            if (ones if one else mid + 1 - ones) > k:
                high = mid
            else:
                low = mid + 1
        return low

    def occurrences(self, token: int) -> list[int]:
        return [self.select(token, k) for k in range(self.count(token))]

    def decode(self) -> np.ndarray:
        """All ids: the planes from the last to the first, each undoing its sort."""
        bits = len(self.planes)
        out = np.zeros(self.n, np.uint16 if bits <= 16 else np.uint32)
        for level in range(bits - 1, -1, -1):
            one = np.unpackbits(self.planes[level], count=self.n, bitorder="little").view(bool)
            out[self.zeros[level] :] |= out.dtype.type(1 << (bits - 1 - level))
            out = _unsorted(out, one, self.zeros[level])
        return out


def _places(one: np.ndarray, zeros: int) -> Iterator[tuple[slice, np.ndarray, slice]]:
    """For each span of a plane, its places with a zero and those with a one, and where they lie in the sorted order."""
    at = [0, zeros]
    for begin in range(0, len(one), SPAN):
        span = slice(begin, begin + SPAN)
        bit = one[span]
        for k, places in enumerate((np.flatnonzero(~bit), np.flatnonzero(bit))):
            yield span, places, slice(at[k], at[k] + len(places))
            at[k] += len(places)


def _sorted(values: np.ndarray, one: np.ndarray, zeros: int) -> np.ndarray:
    """The values with a zero, ``zeros`` of them, then those with a one, each in their order."""
    out = np.empty_like(values)
    for span, places, to in _places(one, zeros):
        values[span].take(places, out=out[to], mode="clip")  # no place is outside; other modes copy
    return out


def _unsorted(values: np.ndarray, one: np.ndarray, zeros: int) -> np.ndarray:
    """What :func:`_sorted` made these values of."""
    out = np.empty_like(values)
    for span, places, at in _places(one, zeros):
        out[span][places] = values[at]
    return out


def _padded(plane: np.ndarray) -> np.ndarray:
    return np.concatenate([plane, np.zeros(-len(plane) % (BLOCK // 8) + BLOCK // 8, np.uint8)])


def _running(plane: np.ndarray) -> np.ndarray:
    ones = np.bitwise_count(plane.view("<u8")).astype(np.int64).reshape(-1, BLOCK // 64).sum(1)
    return np.concatenate([[0], np.cumsum(ones)]).astype(np.uint32 if len(plane) < 1 << 28 else np.uint64)


def to_file(doc_ids: list[int | None], lengths: np.ndarray, ids: np.ndarray, bits: int) -> bytes:
    """One compressed file: head, then the table of documents and each plane with its counts, compressed by themselves."""
    matrix = WaveletMatrix.build(ids, bits)
    pack = zstandard.ZstdCompressor(level=1).compress
    known = np.array([d is not None for d in doc_ids], np.uint8)
    numbers = np.array([d or 0 for d in doc_ids], np.int64)
    sections = [pack(known.tobytes() + numbers.tobytes() + np.asarray(lengths, np.uint64).tobytes())]
    for plane, counts in zip(matrix.planes, matrix.counts, strict=True):
        sections.append(pack(plane.tobytes()))
        sections.append(pack(counts.astype(np.uint64).tobytes()))
    table = struct.pack(f"<{len(sections)}Q", *map(len, sections))
    return HEAD.pack(MAGIC, bits, matrix.n, len(doc_ids)) + table + b"".join(sections)


class TokenFile:
    """A file's documents and, through its planes, their tokens."""

    def __init__(self, data: bytes):
        magic, bits, n, n_docs = HEAD.unpack_from(data)
        if magic != MAGIC:
            raise ValueError("not a wavelet-matrix file")
        sizes = struct.unpack_from(f"<{1 + 2 * bits}Q", data, HEAD.size)
        at, sections = HEAD.size + 8 * len(sizes), []
        unpack = zstandard.ZstdDecompressor().decompress
        for size in sizes:
            sections.append(unpack(data[at : at + size]))
            at += size
        known = np.frombuffer(sections[0], np.uint8, n_docs)
        numbers = np.frombuffer(sections[0], np.int64, n_docs, n_docs)
        self.doc_ids = [int(d) if k else None for d, k in zip(numbers, known, strict=True)]
        self.lengths = np.frombuffer(sections[0], np.uint64, n_docs, 9 * n_docs).astype(np.int64)
        self.starts = np.cumsum(self.lengths) - self.lengths
        planes = [np.frombuffer(s, np.uint8) for s in sections[1::2]]
        counts = [np.frombuffer(s, np.uint64) for s in sections[2::2]]
        self.tokens = WaveletMatrix(n, planes, counts, [n - int(c[-1]) for c in counts])

    def document(self, i: int) -> np.ndarray:
        return self.tokens.access(np.arange(self.starts[i], self.starts[i] + self.lengths[i]))


def write_tokens(docs: DataFrame, path: str, tokenizer: str, id_col: str = "doc_id", text_col: str = "text", end_id: int = 2, file_tokens: int = FILE_TOKENS) -> DataFrame:
    """Encodes all documents and writes files of their ids, in ascending order of ids, to the folder ``path``; returns the table of files.

    The table has a row for each file, ordered by (part, seq): ``n_docs``, ``n_tokens`` and the file itself.
    Documents are dealt out by range, so every part writes its own run of the order.

    * null texts: empty, only the end id; null ids come first; equal ids: by a hash of the text, then by the text;
    * very long texts: whole, a file ends after the document that fills it; an empty table: no file;
    * texts with the tokenizer's special strings are given to the library whole; other columns are not read.
    """
    small_batches(docs.sparkSession)
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), text.alias("text"), F.xxhash64(text).alias("h"))
    rows = rows.repartitionByRange("doc_id", "h").sortWithinPartitions("doc_id", "h", "text").select("doc_id", "text")

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scheme, library = textscan.scheme(tokenizer), textscan.loaded(tokenizer)
        bits = max(library.get_vocab_size(with_added_tokens=True) - 1, end_id).bit_length()
        store = textscan.store(tokenizer)
        kind = np.uint16 if bits <= 16 else np.uint32
        part, seq = TaskContext.get().partitionId(), 0
        doc_ids: list[int | None] = []
        lengths: list[int] = []
        held: list[np.ndarray] = []
        n = 0

        def made() -> pa.RecordBatch:
            data = to_file(doc_ids, np.array(lengths), np.concatenate(held), bits)
            return pa.RecordBatch.from_arrays(
                [pa.array([part], pa.int32()), pa.array([seq], pa.int32()), pa.array([len(doc_ids)], pa.int64()), pa.array([n], pa.int64()), pa.array([data], pa.binary())],
                ["part", "seq", "n_docs", "n_tokens", "file"],
            )

        for batch in batches:
            ids_, texts = batch.column(0).to_pylist(), batch.column(1).to_pylist()
            special = {i: np.array(library.encode(t, add_special_tokens=False).ids, kind) for i, t in enumerate(texts) if scheme.has_special(t)}
            done, open_ = 0, 0
            for pieces, ends in textscan.grouped(scheme.normalised("" if i in special else t) for i, t in enumerate(texts)):
                tokens = scheme.tokens(pieces)
                words = store.find(tokens)
                sizes = store.lengths[words]
                flat = textscan.gathered(store.ids, store.offsets[words], sizes).astype(kind)
                sums = np.concatenate([[0], np.cumsum(sizes, dtype=np.int64)])[tokens.first].tolist()
                for k, last in enumerate(ends):
                    held.append(flat[sums[k] : sums[k + 1]])
                    open_ += sums[k + 1] - sums[k]
                    if not last:
                        continue
                    if done in special:
                        held.append(special[done])
                        open_ += len(special[done])
                    held.append(np.array([end_id], kind))
                    doc_ids.append(ids_[done])
                    lengths.append(open_ + 1)
                    n += open_ + 1
                    done, open_ = done + 1, 0
                    if n >= file_tokens:
                        yield made()
                        seq += 1
                        doc_ids, lengths, held, n = [], [], [], 0
        if doc_ids:
            yield made()

    files = rows.mapInArrow(tidy(encode, MAPPED), "part int, seq int, n_docs long, n_tokens long, file binary")
    files.write.option("compression", "uncompressed").option("maxRecordsPerFile", 1).parquet(path)  # the files are compressed
    return docs.sparkSession.read.schema(files.schema).parquet(path)


def read_documents(files: DataFrame) -> DataFrame:
    """For each document of the files: ``doc_id``, ``start`` (ids before it in all files), ``n_tokens`` and ``ids_crc32``, from the decoded planes.

    Documents with null ids are rows too; a document without tokens but its end has length 1; no file, no row.
    """

    def decode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, seq, data in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                file = TokenFile(data)
                ids = file.tokens.decode().astype("<u4")
                crc = [zlib.crc32(ids[s : s + k]) for s, k in zip(file.starts.tolist(), file.lengths.tolist(), strict=True)]
                m = len(crc)
                yield pa.RecordBatch.from_arrays(
                    [pa.array([part] * m, pa.int32()), pa.array([seq] * m, pa.int32()), pa.array(file.doc_ids, pa.int64()), pa.array(file.starts), pa.array(file.lengths), pa.array(crc, pa.int64())],
                    ["part", "seq", "doc_id", "inside", "n_tokens", "ids_crc32"],
                )

    rows = files.select("part", "seq", "file").mapInArrow(tidy(decode, MAPPED), "part int, seq int, doc_id long, inside long, n_tokens long, ids_crc32 long")
    sizes = files.select("part", "seq", "n_tokens")
    before = lambda w: F.coalesce(F.sum("n_tokens").over(w.rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    parts = sizes.groupBy("part").agg(F.sum("n_tokens").alias("n_tokens")).select("part", before(W.orderBy("part")).alias("_part"))  # a row for each part
    begins = sizes.select("part", "seq", before(W.partitionBy("part").orderBy("seq")).alias("_seq")).join(parts, "part")
    begins = begins.select("part", "seq", (F.col("_part") + F.col("_seq")).alias("_begin"))
    return rows.join(begins, ["part", "seq"]).select("doc_id", (F.col("_begin") + F.col("inside")).alias("start"), "n_tokens", "ids_crc32")
