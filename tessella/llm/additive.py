"""Nearest neighbours by inner product with additive quantisation.

A vector is the sum of one codeword from each of several codebooks, all of full dimension; the codebooks are learned one
after another on what the earlier ones leave. Codes are found by a beam search, which keeps the best few partial sums
at each codebook. An index row holds the codes, the ratio of the vector's norm to its approximation's, and how far the
approximation misses. A query makes a table of its inner products with all codewords, so a row's score is a sum of
looked-up numbers, scaled by the stored ratio. The best rows of every block are scored exactly on the original vectors;
so is every other row that could reach the last of them by as much as its approximation is likely to miss.

Equal vectors have equal neighbours. So the index keeps of each group of them the rows with the ``k + 1`` smallest ids, more than any
answer can name, and a vector that many queries have is searched once: a group of copies costs no more than its
share of the distinct vectors.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from . import scratch
from .workers import tidy

EPSILON = float(np.finfo(np.float32).eps)


@dataclass(frozen=True)
class Settings:
    """codebooks, codewords: of the quantiser (256 codewords at most, so a code is a byte); beam: its search's width.
    sample: vectors it is fitted on, at most, chosen by a hash of their ids; rounds: of k-means for each codebook.
    block_rows, block_queries: rows and queries that are scored against each other at a time.
    shortlist: rows of a block that are scored exactly for each query before it is known how good the others must be.
    spread: standard errors within which a looked-up score must reach that to be scored exactly too.
    """

    codebooks: int = 16
    codewords: int = 256
    beam: int = 4
    sample: int = 8192
    rounds: int = 4
    block_rows: int = 32768
    block_queries: int = 1024
    shortlist: int = 64
    spread: float = 1.0


class Beams:
    """For each vector the best few sums of codewords so far: their codes, what they leave, and their errors (less the vector's square)."""

    def __init__(self, vectors: np.ndarray):
        self.left = vectors.astype(np.float32)[:, None, :]
        self.error = np.zeros((len(vectors), 1), np.float32)
        self.codes = np.zeros((len(vectors), 1, 0), np.int64)

    def step(self, book: np.ndarray, width: int) -> None:
        k = len(book)
        flat = (self.error[:, :, None] + np.einsum("kd,kd->k", book, book) - 2 * (self.left @ book.T)).reshape(len(self.left), -1)
        best = np.argpartition(flat, min(width, flat.shape[1]) - 1, axis=1)[:, :width]
        parent, code = best // k, best % k
        self.error = np.take_along_axis(flat, best, 1)
        self.left = np.take_along_axis(self.left, parent[:, :, None], 1) - book[code]
        self.codes = np.concatenate([np.take_along_axis(self.codes, parent[:, :, None], 1), code[:, :, None]], 2)

    def best_left(self) -> np.ndarray:
        return self.left[np.arange(len(self.left)), self.error.argmin(axis=1)]

    def best_codes(self) -> np.ndarray:
        return self.codes[np.arange(len(self.left)), self.error.argmin(axis=1)]


class Quantiser:
    def __init__(self, codebooks: np.ndarray):
        self.books = codebooks  # codebook, codeword, dimension
        self.squares = np.einsum("mkd,mkd->mk", codebooks, codebooks)

    @classmethod
    def fit(cls, vectors: np.ndarray, settings: Settings) -> Quantiser:
        """Residual codebooks by k-means, each on what the beam search over the earlier ones leaves."""
        random = np.random.default_rng(11)
        books = np.zeros((settings.codebooks, settings.codewords, vectors.shape[1]), np.float32)
        beams = Beams(vectors)
        for m in range(settings.codebooks):
            left = beams.best_left()
            book = left[random.permutation(len(left))[: settings.codewords]]
            if len(book) < settings.codewords:
                book = np.concatenate([book, np.zeros((settings.codewords - len(book), vectors.shape[1]), np.float32)])
            for _ in range(settings.rounds):
                near = (left @ book.T - 0.5 * np.einsum("kd,kd->k", book, book)).argmax(axis=1)
                count = np.bincount(near, minlength=len(book))
                sums = np.zeros_like(book)
                np.add.at(sums, near, left)
                book = np.where(count[:, None] > 0, sums / np.maximum(count, 1)[:, None], book).astype(np.float32)
            books[m] = book
            beams.step(book, settings.beam)
        return cls(books)

    def encode(self, vectors: np.ndarray, beam: int) -> np.ndarray:
        """Codes of the best sums a beam search finds, which goes on from what each of its sums leaves."""
        out = np.zeros((len(vectors), len(self.books)), np.uint8)
        for a in range(0, len(vectors), 2048):
            beams = Beams(vectors[a : a + 2048])
            for book in self.books:
                beams.step(book, beam)
            out[a : a + 2048] = beams.best_codes()
        return out

    def decode(self, codes: np.ndarray) -> np.ndarray:
        return sum(self.books[m][codes[:, m]] for m in range(codes.shape[1]))

    def scores(self, queries: np.ndarray, codes: np.ndarray) -> np.ndarray:
        """Inner products of approximations and queries (row, query) from the queries' lookup tables."""
        out = np.zeros((len(codes), len(queries)), np.float32)
        for m, book in enumerate(self.books):
            out += (book @ queries.T)[codes[:, m]]
        return out


def usable(embedding: Column, dimensions: int) -> Column:
    """Whether a vector takes part: the right length, no null or non-finite component, not zero."""
    finite = F.forall(embedding, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return F.coalesce((F.size(embedding) == dimensions) & finite & F.exists(embedding, lambda x: x != 0), F.lit(False))


def _matrix(column: pa.Array | pa.ChunkedArray, dimensions: int) -> np.ndarray:
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    return column.flatten().to_numpy(zero_copy_only=False).reshape(-1, dimensions)


def build_index(vectors: DataFrame, id_col: str, vector_col: str, k: int = 20, settings: Settings = Settings()) -> tuple[DataFrame, DataFrame, Quantiser | None, int]:
    """The index, all usable vectors (vec_id, embedding, h1 and h2, two hashes that name the vector), the quantiser and the dimension.

    The index holds vec_id, embedding, codes, ``scale`` (norm over the approximation's norm) and ``miss``, the distance of vector and
    scaled approximation, the rounding of looked-up scores included. Of equal vectors it has those with the ``k + 1`` smallest
    ids, of repeated rows of an id ``k``: enough for ``k`` neighbours of any vector without those of its own id.

    The dimension is the most frequent length of a vector. The quantiser is fitted on ``sample`` vectors at most; all are indexed.
    """
    rows = vectors.select(F.col(id_col).cast("long").alias("vec_id"), F.col(vector_col).cast("array<float>").alias("embedding")).where("vec_id IS NOT NULL AND embedding IS NOT NULL")
    rows = rows.withColumns({"h1": F.xxhash64("embedding"), "h2": F.xxhash64("embedding", F.lit(1))})
    index = "vec_id long, embedding array<float>, codes binary, scale float, miss float"
    most = rows.groupBy(F.size("embedding").alias("d")).count().where("d > 0").orderBy(F.desc("count"), "d").first()
    none = vectors.sparkSession.createDataFrame([], index)
    if most is None:
        return none, rows.where("false"), None, 0
    rows = rows.where(usable(F.col("embedding"), most.d))
    sample = rows.select("vec_id", "embedding").orderBy(F.xxhash64("vec_id"), "vec_id").limit(settings.sample).toArrow()
    if not sample.num_rows:
        return none, rows, None, most.d
    quantiser = Quantiser.fit(_matrix(sample.column("embedding"), most.d).astype(np.float32), settings)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = _matrix(batch.column(1), most.d)
            codes = quantiser.encode(x, settings.beam)
            near = quantiser.decode(codes).astype(np.float64)
            scale = (np.linalg.norm(x.astype(np.float64), axis=1) / np.maximum(np.linalg.norm(near, axis=1), 1e-30)).astype(np.float32)
            parts = sum(np.sqrt(quantiser.squares[m])[codes[:, m]] for m in range(codes.shape[1]))
            rounding = (most.d + codes.shape[1] + 8) * EPSILON * (parts * scale + np.linalg.norm(x, axis=1))
            miss = np.linalg.norm(x - near * scale[:, None].astype(np.float64), axis=1) + rounding
            made = [pa.array([c.tobytes() for c in codes], pa.binary()), pa.array(scale), pa.array(miss.astype(np.float32))]
            yield pa.RecordBatch.from_arrays([*batch.columns, *made], ["vec_id", "embedding", "codes", "scale", "miss"])

    # rank limits go before the shuffle, so no group of copies is gathered
    copy = F.row_number().over(W.partitionBy("h1", "h2", "vec_id").orderBy("vec_id"))
    place = F.dense_rank().over(W.partitionBy("h1", "h2").orderBy("vec_id"))
    distinct = rows.withColumn("_c", copy).where(F.col("_c") <= k).withColumn("_p", place).where(F.col("_p") <= k + 1)
    return scratch.written(distinct.select("vec_id", "embedding").mapInArrow(tidy(run), index), "index"), rows, quantiser, most.d


def search(index: DataFrame, queries: DataFrame, quantiser: Quantiser | None, dimensions: int, k: int = 20, settings: Settings = Settings()) -> DataFrame:
    """(h1, h2, vec_id, score) of the nearest rows of the index for each of ``queries`` (h1, h2, embedding; distinct): score is the exact inner
    product in double precision, ties go to the smaller vec_id. There are rows of ``k + 1`` ids, so that one can be left out.

    In a block the exact score of the id that comes last in the shortlist's best ``k + 1`` is a floor. A row is scored exactly if
    its looked-up score can be expected to reach the floor. What the residual, of length ``miss``, adds to the score has two parts:
    along the row itself half the residual's square, in proportion to the score; across it a random part whose standard error is
    ``miss`` / sqrt(dimension) for each unit of the query's part that lies across the row. The first is added whole, the second
    ``spread`` times. All rows that come near in this way are scored, however many they are.

    Blocks of queries meet blocks of rows, each pair in a task of its own, which hands on rows of ``k + 1`` ids a query.
    """
    if quantiser is None:
        return index.sparkSession.createDataFrame([], "h1 long, h2 long, vec_id long, score double")
    row_blocks = max(1, math.ceil(index.count() / settings.block_rows))
    query_blocks = max(1, math.ceil(queries.count() / settings.block_queries))
    each = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    rows = index.select(F.pmod(F.xxhash64("vec_id"), F.lit(row_blocks)).cast("int").alias("rb"), "*").withColumn("qb", each(query_blocks))
    asked = queries.select(F.pmod("h1", F.lit(query_blocks)).cast("int").alias("qb"), "h1", "h2", "embedding").withColumn("rb", each(row_blocks))

    def run(q: pa.Table, r: pa.Table) -> pa.Table:
        found: list[list[np.ndarray]] = [[], [], []]
        h1, h2 = (q.column(c).to_numpy() for c in ("h1", "h2"))
        if q.num_rows and r.num_rows:
            order = np.argsort(r.column("vec_id").to_numpy(), kind="stable")
            ids = r.column("vec_id").to_numpy()[order]
            x = _matrix(r.column("embedding"), dimensions)[order]
            codes = np.frombuffer(b"".join(r.column("codes").to_pylist()), np.uint8).reshape(len(ids), -1)[order]
            scale, miss = r.column("scale").to_numpy()[order], r.column("miss").to_numpy()[order]
            norms = np.linalg.norm(x, axis=1)
            bias, error = miss**2 / (2 * norms**2), settings.spread * miss / np.sqrt(dimensions)
            asking = _matrix(q.column("embedding"), dimensions)

            def best(at: np.ndarray, v: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
                """Rows of the ``k + 1`` best ids among those at ``at``, in order, and their scores; rows come by id, so do ties."""
                exact = (x[at].astype(np.float64) * v).sum(axis=1)
                by = np.argsort(-exact, kind="stable")
                names = ids[at][by]
                place = np.cumsum(np.concatenate([[1], names[1:] != names[:-1]]))
                by = by[place <= k + 1]
                return at[by], exact[by]

            for a in range(0, len(asking), 128):
                part = asking[a : a + 128]
                rough = np.ascontiguousarray((quantiser.scores(part, codes) * scale[:, None]).T)
                short = min(settings.shortlist, len(ids))
                near = np.argpartition(-rough, short - 1, axis=1)[:, :short]
                for i, first in enumerate(near):
                    v = part[i].astype(np.float64)
                    at, exact = best(np.sort(first), v)
                    if len(set(ids[at].tolist())) > k:
                        length = np.linalg.norm(v)
                        cosine = np.clip(exact[-1] / (length * norms), 0, 1)
                        reach = rough[i] + max(exact[-1], 0) * bias + length * np.sqrt(1 - cosine**2) * error >= exact[-1]
                        reach[first] = True
                        at, exact = best(np.flatnonzero(reach), v)
                    else:
                        at, exact = best(np.arange(len(ids)), v)
                    found[0].append(np.full(len(at), a + i))
                    found[1].append(ids[at])
                    found[2].append(exact)
        which, names, scores = (np.concatenate(f) if f else np.zeros(0) for f in found)
        which = which.astype(np.int64)
        return pa.table({"h1": pa.array(h1[which]), "h2": pa.array(h2[which]), "vec_id": pa.array(names, pa.int64()), "score": pa.array(scores, pa.float64())})

    pairs = asked.groupBy("qb", "rb").cogroup(rows.groupBy("qb", "rb")).applyInArrow(run, "h1 long, h2 long, vec_id long, score double")
    place = F.dense_rank().over(W.partitionBy("h1", "h2").orderBy(F.desc("score"), "vec_id"))
    return pairs.withColumn("_p", place).where(F.col("_p") <= k + 1).drop("_p")


def nearest(vectors: DataFrame, every: int = 20, k: int = 20, id_col: str = "vec_id", vector_col: str = "embedding", settings: Settings = Settings()) -> DataFrame:
    """(query_id, rank, vec_id, score) of the ``k`` nearest of each vector whose id is divisible by ``every``, among all vectors but its own id's.

    * vectors that are null, zero, of another length than most, or hold null or non-finite components take no part, nor do null ids;
    * equal vectors: ranked by id; repeated rows of an id: candidates of others, never of themselves, each different vector a query;
    * very long vectors: any dimension; an empty table: an empty result; other columns are not read.
    """
    index, rows, quantiser, dimensions = build_index(vectors, id_col, vector_col, k, settings)
    asked = scratch.written(rows.where(F.col("vec_id") % every == 0), "queries")
    found = scratch.written(search(index, asked.select("h1", "h2", "embedding").dropDuplicates(["h1", "h2"]), quantiser, dimensions, k, settings), "found")
    named = asked.select(F.col("vec_id").alias("query_id"), "h1", "h2").distinct()
    both = named.join(found, ["h1", "h2"]).where("vec_id <> query_id")
    rank = F.row_number().over(W.partitionBy("query_id", "h1", "h2").orderBy(F.desc("score"), "vec_id"))
    return both.withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
