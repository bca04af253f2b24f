"""Jaccard join on word shingles by parity sketches.

Each set flips one bit of a sketch for every shingle. Where two sets share a shingle both sketches flip the same bit,
so the sketches differ in at most as many bits as the sets differ in elements: their Hamming distance is a lower
bound of the symmetric difference. Sets of sizes a and b with a similarity of t or more differ in at most
d = (1 - t) / (1 + t) * (a + b) elements. So if the sketch is cut into more than d blocks, at least one is equal in
both (pigeonhole), and it is found by an equality join.

Size bands fix the number of blocks: a set is entered in the band of its size (powers of two), and in the next one if a
partner could lie there. All sets rank their blocks alike, those with many bits first; as at most d blocks differ,
two partners agree on one of the d + 1 that each ranks first, and only those are entered. Equal sets are entered
once for each part of the input, and are one node from then on.

A node meets the others of a block in rounds, each only with what is still in another component: the partner with
which it shares most blocks; the smallest node of each block; the nearest by sketch; everything that the sketches
allow. Every candidate pair is verified on the exact sets, so no link between different components is lost, and a block
of n near copies costs about n verifications instead of n squared.
"""

from __future__ import annotations

import itertools
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import scratch, shingles, textscan
from .common import is_small, small_batches
from .components import components
from .workers import tidy

#: Bits of a block. Blocks are sparse, so their width costs nothing and makes equal blocks of different sets rare.
BLOCK_BITS = 1 << 16
#: Bits of the smallest sketch of a whole set, which is compared before exact sets are.
SKETCH_BITS = 1024
#: Members of a block in a row, and nodes of a block that one task compares with all of them.
MEMBERS, ASKING = 1 << 14, 1 << 12
#: Entries of blocks that a task groups, on average.
GROUPED = 1 << 21
#: Entries a worker holds before it hands them on.
HELD = 1 << 20


def most_different(a, b, percent: int):
    """The greatest symmetric difference of sets of sizes a and b that are ``percent`` similar."""
    return (100 - percent) * (a + b) // (100 + percent)


def blocks_of(band: np.ndarray, percent: int) -> np.ndarray:
    """Blocks of a band's sketches: half as many again as its largest sets need, so that poor blocks can rank last."""
    largest = (np.int64(2) << band) - 1
    return (3 * (most_different(largest, largest, percent) + 1) + 1) // 2 + 1


def signatures(sets: list[np.ndarray], percent: int) -> tuple[np.ndarray, np.ndarray]:
    """The entered blocks of these non-empty sets: positions in ``sets``, 64-bit names of band, block and its bits."""
    size = np.array([len(s) for s in sets], np.int64)
    band = np.array([n.bit_length() - 1 for n in size.tolist()], np.int64)
    partner = size * 100 // percent
    job_set = np.concatenate([np.arange(len(sets)), np.flatnonzero(partner >= (np.int64(2) << band))])
    job_band = np.concatenate([band, band[job_set[len(sets) :]] + 1])
    top = (np.int64(2) << job_band) - 1
    wanted = most_different(size[job_set], np.minimum(partner[job_set], top), percent) + 1
    blocks = blocks_of(job_band, percent)
    begin = np.cumsum(blocks) - blocks

    length = size[job_set]
    job = np.repeat(np.arange(len(job_set)), length)
    first = np.concatenate([[0], np.cumsum(size)[:-1]])
    h = textscan.gathered(np.concatenate(sets), first[job_set], length)
    block = ((h >> np.uint64(32)) * blocks[job].astype(np.uint64) >> np.uint64(32)).astype(np.int64)
    bit = (h & np.uint64(BLOCK_BITS - 1)).astype(np.int64)
    place = (begin[job] + block) * BLOCK_BITS + bit
    place.sort()
    fresh = np.concatenate([[True], place[1:] != place[:-1]])
    flips = np.diff(np.append(np.flatnonzero(fresh), len(place)))
    place = place[fresh][flips % 2 == 1]  # bits flipped twice are off again
    block = place // BLOCK_BITS
    fresh = np.concatenate([[True], block[1:] != block[:-1]]) if len(block) else np.zeros(0, bool)
    at = np.flatnonzero(fresh)
    block = block[at]
    bits = np.diff(np.append(at, len(place)))
    job = np.searchsorted(begin, block, "right") - 1
    inside = block - begin[job]
    within = (place - np.repeat(block, bits) * BLOCK_BITS).astype(np.uint64)
    pattern = textscan.finalised(within + np.uint64(1) << np.uint64(20))
    pattern = np.bitwise_xor.reduceat(pattern, at) if len(at) else pattern
    name = _names(job_band[job], inside, bits, pattern)
    order = np.lexsort((name, -bits, job))
    job, name = job[order], name[order]
    rank = np.arange(len(job)) - np.searchsorted(job, job)
    kept = rank < wanted[job]
    out_set, out_name = job_set[job[kept]], name[kept]
    # sets with too few blocks that have bits also enter empty ones, which rank last, by number
    have = np.bincount(job, minlength=len(job_set))
    for j in np.flatnonzero(have < wanted).tolist():
        full = set(inside[order][job == j].tolist())
        empty = [b for b in range(int(blocks[j])) if b not in full][: int(wanted[j] - have[j])]
        if empty:
            e = np.array(empty, np.int64)
            zero = np.zeros(len(e), np.int64)
            out_set = np.concatenate([out_set, np.full(len(e), job_set[j])])
            out_name = np.concatenate([out_name, _names(np.full(len(e), job_band[j]), e, zero, zero.astype(np.uint64))])
    return out_set, out_name


def _names(band: np.ndarray, block: np.ndarray, bits: np.ndarray, pattern: np.ndarray) -> np.ndarray:
    place = textscan.finalised((band.astype(np.uint64) << np.uint64(40)) + block.astype(np.uint64))
    return textscan.finalised(pattern + place * np.uint64(3) + bits.astype(np.uint64))


def sketch_of(hashes: np.ndarray) -> bytes:
    """A parity sketch of the whole set, with a bit or more for each element the largest set of its band has.

    The sketches of unrelated sets then differ in nearly half of these bits, more than linked sets may differ in, whatever the size.
    Halves of a sketch, one flipped by the other, are the sketch of half the bits.
    """
    bits = max(SKETCH_BITS, 1 << len(hashes).bit_length())
    bit = (hashes >> np.uint64(7)) % np.uint64(bits)
    odd = np.bincount(bit.astype(np.int64), minlength=bits) % 2
    return np.packbits(odd.astype(np.uint8), bitorder="little").tobytes()


def sketches(column: list[bytes], words: int | None = None) -> np.ndarray:
    """Sketches as rows of ``words`` 64-bit numbers, by default those of the smallest; longer ones are folded."""
    sizes = np.array([len(x) // 8 for x in column], np.int64)
    words = words or int(sizes.min())
    out = np.zeros((len(column), words), np.uint64)
    for size in np.unique(sizes).tolist():
        at = np.flatnonzero(sizes == size)
        rows = np.frombuffer(b"".join([column[i] for i in at.tolist()]), "<u8").reshape(len(at), size)
        while rows.shape[1] > words:
            half = rows.shape[1] // 2
            rows = rows[:, :half] ^ rows[:, half:]
        out[at] = rows
    return out


def linked(a: np.ndarray, b: np.ndarray, percent: int) -> bool:
    both = len(a) + len(b) - len(np.union1d(a, b)) if min(len(a), len(b)) else 0
    return 100 * both >= percent * (len(a) + len(b) - both)


def _routes(spark: SparkSession, n: int) -> list[int]:
    """For each of ``n`` shuffle partitions a key that hash partitioning sends there."""
    ids = spark.range(64 * n).groupBy(F.pmod(F.hash("id"), F.lit(n)).alias("p")).agg(F.min("id").alias("id"))
    found = {r.p: r.id for r in ids.collect()}
    return [found.get(p, p) for p in range(n)]


def sets_table(docs: DataFrame, id_col: str, text_col: str, percent: int, seed: int) -> DataFrame:
    """doc_id, n (shingles), node and check (the names of the set, null for an empty one) and ``blocks`` of each row.

    ``blocks`` are the names of the blocks that the set is entered in, given for the first of equal sets of a part and null for the others.
    """
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        entered: set[int] = set()
        for batch in (whole.slice(i, 1024) for whole in batches for i in range(0, whole.num_rows, 1024)):
            n, node, check = [], [], []
            blocks: list[bytes | None] = [None] * batch.num_rows
            sets: list[np.ndarray] = []
            places: list[int] = []
            waiting = 0

            def enter() -> None:
                which, name = signatures(sets, percent)
                order = np.argsort(which, kind="stable")
                name = name[order].astype("<u8")
                cuts = np.searchsorted(which[order], np.arange(len(sets) + 1)).tolist()
                for place, a, b in zip(places, cuts, cuts[1:], strict=False):
                    blocks[place] = name[a:b].tobytes()

            for i, found in enumerate(shingles.shingle_sets(batch.column(1))):
                n.append(len(found))
                if not len(found):
                    node.append(None)
                    check.append(None)
                    continue
                name, second = shingles.set_names(found, seed)
                node.append(name)
                check.append(second)
                if name in entered:
                    continue
                entered.add(name)
                sets.append(found)
                places.append(i)
                waiting += len(found)
                if waiting > 1 << 17:
                    enter()
                    sets, places, waiting = [], [], 0
            if sets:
                enter()
            columns = [batch.column(0), pa.array(n, pa.int64()), pa.array(node, pa.int64()), pa.array(check, pa.int64()), pa.array(blocks, pa.binary())]
            yield pa.RecordBatch.from_arrays(columns, ["doc_id", "n", "node", "check", "blocks"])

    return rows.mapInArrow(tidy(run), f"doc_id {rows.schema[0].dataType.simpleString()}, n long, node long, check long, blocks binary")


def _entries(table: DataFrame, tasks: int) -> DataFrame:
    """Packed entries (48 bits of a block's name, node) by shuffle partition, of which there are ``tasks``."""
    routes = np.array(_routes(table.sparkSession, tasks), np.int64)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names: list[bytes] = []
        nodes: list[int] = []

        def handed() -> pa.RecordBatch:
            name = np.frombuffer(b"".join(names), "<u8")
            node = np.repeat(np.array(nodes, np.int64), [len(x) // 8 for x in names])
            to = (name % np.uint64(len(routes))).astype(np.int64)
            order = np.argsort(to, kind="stable")
            name, node, to = name[order] >> np.uint64(16), node[order], to[order]
            cuts = np.flatnonzero(np.concatenate([[True], to[1:] != to[:-1]])).tolist() + [len(to)]
            spans = list(zip(cuts, cuts[1:], strict=False))
            low, high = (name & np.uint64(0xFFFFFFFF)).astype("<u4"), (name >> np.uint64(32)).astype("<u2")
            return pa.RecordBatch.from_arrays(
                [pa.array(routes[to[cuts[:-1]]]), *(pa.array([x[a:b].tobytes() for a, b in spans], pa.binary()) for x in (low, high, node.astype("<i8")))], ["route", "low", "high", "nodes"]
            )

        held = 0
        for batch in batches:
            for node, blocks in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                nodes.append(node)
                names.append(blocks)
                held += len(blocks) // 8
                if held > HELD:
                    yield handed()
                    names, nodes, held = [], [], 0
        if held:
            yield handed()

    return table.where("blocks IS NOT NULL").select("node", "blocks").mapInArrow(tidy(run), "route long, low binary, high binary, nodes binary")


def _groups(entries: DataFrame, tasks: int) -> DataFrame:
    """The blocks that two nodes or more have: ``g`` names the set of members, ``n`` says how many blocks have just these.

    A row holds the smallest node, ``leader``, and some ``members``, the others; blocks with many take several rows, of which one is the ``first``.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[list[np.ndarray]] = [[], [], []]
        for batch in batches:
            for k, kind in enumerate(("<u4", "<u2", "<i8")):
                held[k] += [np.frombuffer(x, kind) for x in batch.column(k + 1).to_pylist()]
        if not held[0]:
            return
        name = np.concatenate(held[0]).astype(np.uint64) | np.concatenate(held[1]).astype(np.uint64) << np.uint64(32)
        node = np.concatenate(held[2])
        held = []
        order = np.argsort(name, kind="stable")
        name, node = name[order], node[order]
        same = np.concatenate([[False], name[1:] == name[:-1]]) if len(name) else np.zeros(0, bool)
        shared = same.copy()
        shared[:-1] |= same[1:]
        name, node = name[shared], node[shared]
        order = np.lexsort((node, name))
        name, node = name[order], node[order]
        found: dict[bytes, int] = {}
        cuts = np.flatnonzero(np.concatenate([[True], name[1:] != name[:-1]])).tolist() + [len(name)] if len(name) else [0]
        for a, b in zip(cuts, cuts[1:], strict=False):
            members = node[a:b]
            members = members[np.concatenate([[True], members[1:] != members[:-1]])]
            if len(members) > 1:
                key = members.tobytes()
                found[key] = found.get(key, 0) + 1
        rows: list[tuple[int, int, np.ndarray, int, bool]] = []
        waiting = 0

        def made() -> pa.RecordBatch:
            offsets = np.concatenate([[0], np.cumsum([len(r[2]) for r in rows])])
            members = pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(np.concatenate([r[2] for r in rows])))
            columns = [pa.array([r[k] for r in rows], pa.int64()) for k in (0, 1)] + [members, pa.array([r[3] for r in rows], pa.int64()), pa.array([r[4] for r in rows], pa.bool_())]
            return pa.RecordBatch.from_arrays(columns, ["g", "leader", "members", "n", "first"])

        for key, n in found.items():
            members = np.frombuffer(key, "<i8")
            g = shingles.set_names(members.view(np.uint64))[0]
            for a in range(1, len(members), MEMBERS):
                rows.append((g, int(members[0]), members[a : a + MEMBERS], n, a == 1))
                waiting += len(rows[-1][2])
                if len(rows) >= 4096 or waiting >= 1 << 18:
                    yield made()
                    rows, waiting = [], 0
        if rows:
            yield made()

    return entries.repartition(tasks, "route").mapInArrow(tidy(run), "g long, leader long, members array<long>, n long, first boolean")


def _with_leader(groups: DataFrame) -> DataFrame:
    """(u, v, n) for the smallest node v of each group and every other one u, n blocks, summed within each part."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            sizes = batch.column(1).value_lengths().to_numpy(zero_copy_only=False).astype(np.int64)
            leader, n = (np.repeat(batch.column(k).to_numpy(zero_copy_only=False), sizes) for k in (0, 2))
            pairs = np.stack([batch.column(1).flatten().to_numpy(zero_copy_only=False), leader], 1)
            pairs, inverse = np.unique(pairs, axis=0, return_inverse=True)
            sums = np.bincount(inverse.ravel(), n).astype(np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(pairs[:, 0].copy()), pa.array(pairs[:, 1].copy()), pa.array(sums)], ["u", "v", "n"])

    return groups.select("leader", "members", "n").mapInArrow(tidy(run), "u long, v long, n long")


def _verified(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The pairs (u, v) that are linked: by size and sketch, whose distance is a lower bound, then on the sets."""

    def near(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in (whole.slice(i, 4096) for whole in batches for i in range(0, whole.num_rows, 4096)):
            a, b = batch.column(4).to_pylist(), batch.column(5).to_pylist()
            words = np.minimum([len(x) // 8 for x in a], [len(x) // 8 for x in b])
            most = most_different(batch.column(2).to_numpy(), batch.column(3).to_numpy(), percent)
            keep = np.zeros(batch.num_rows, bool)
            for size in np.unique(words).tolist():
                at = np.flatnonzero(words == size)
                one, other = (sketches([x[i] for i in at.tolist()], size) for x in (a, b))
                keep[at] = np.bitwise_count(one ^ other).sum(axis=1, dtype=np.int64) <= most[at]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1)], ["u", "v"]).filter(pa.array(keep))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = [linked(np.frombuffer(a, "<u8"), np.frombuffer(b, "<u8"), percent) for a, b in zip(batch.column(2).to_pylist(), batch.column(3).to_pylist(), strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1)], ["u", "v"]).filter(pa.array(keep, pa.bool_()))

    mine = lambda c, side: sets.select(F.col("node").alias(c), F.col("size").alias(f"size_{side}"), F.col("sketch").alias(f"sketch_{side}"))
    both = pairs.select("u", "v").join(mine("u", "a"), "u").join(mine("v", "b"), "v")
    alike = both.where(100 * F.least("size_a", "size_b") >= percent * F.greatest("size_a", "size_b"))
    found = alike.select("u", "v", "size_a", "size_b", "sketch_a", "sketch_b").mapInArrow(tidy(near), "u long, v long")
    whole = lambda c, out: sets.select(F.col("node").alias(c), F.col("hashes").alias(out))
    return found.join(whole("u", "a"), "u").join(whole("v", "b"), "v").select("u", "v", "a", "b").mapInArrow(tidy(run), "u long, v long")


def _sets_of(docs: DataFrame, chosen: DataFrame, text_col: str, id_col: str, seed: int) -> DataFrame:
    """The sets of the nodes in ``chosen`` (doc_id, node), a written table: size, sketch and hashes."""
    texts = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    named = F.broadcast(chosen) if is_small(chosen) else chosen
    wanted = texts.join(named, texts["doc_id"].eqNullSafe(chosen["doc_id"])).select("node", "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in (whole.slice(i, 512) for whole in batches for i in range(0, whole.num_rows, 512)):
            found = list(shingles.shingle_sets(batch.column(1)))
            names = np.array([shingles.set_names(s, seed)[0] if len(s) else -1 for s in found], np.int64)
            right = np.flatnonzero(names == batch.column(0).to_numpy(zero_copy_only=False))  # equal ids can have several texts
            found = [found[i] for i in right.tolist()]
            hashes = [s.astype("<u8").tobytes() for s in found]
            yield pa.RecordBatch.from_arrays(
                [pa.array(names[right]), pa.array([len(s) for s in found], pa.int64()), pa.array(list(map(sketch_of, found)), pa.binary()), pa.array(hashes, pa.binary())], ["node", "size", "sketch", "hashes"]
            )

    return wanted.mapInArrow(tidy(run), "node long, size long, sketch binary, hashes binary").dropDuplicates(["node"])


def _across(placed: DataFrame, percent: int, nearest: bool) -> DataFrame:
    """Pairs (u, v) of a block that are in different components and near enough by size and sketch.

    ``placed`` has g, slice, asks, node, root, size and sketch: in each slice of a block some of its nodes ask all others. With ``nearest``
    a node names only the nearest it could be linked to. Sketches are compared in memory, only pairs that pass become rows.
    """

    def pairs(block: pa.Table) -> tuple[np.ndarray, np.ndarray]:
        node, root, size, asks = (block.column(c).to_numpy() for c in ("node", "root", "size", "asks"))
        sketch = np.ascontiguousarray(sketches(block.column("sketch").to_pylist()).T)
        asking = np.flatnonzero(asks)
        found_u, found_v = [], []
        step = max(1, (1 << 21) // len(node))
        for a in range(0, len(asking), step):
            rows = asking[a : a + step]
            fits = root[rows, None] != root[None, :]
            fits &= 100 * np.minimum(size[rows, None], size[None, :]) >= percent * np.maximum(size[rows, None], size[None, :])
            if not fits.any():
                continue
            distance = np.zeros(fits.shape, np.int32)
            for word in sketch:
                distance += np.bitwise_count(word[rows, None] ^ word[None, :])
            fits &= distance <= most_different(size[rows, None], size[None, :], percent)
            if nearest:
                distance[~fits] = np.iinfo(np.int32).max
                some = np.flatnonzero(fits.any(axis=1))
                found_u.append(node[rows[some]])
                found_v.append(node[distance[some].argmin(axis=1)])
            else:
                i, j = np.nonzero(fits)
                found_u.append(node[rows[i]])
                found_v.append(node[j])
        if not found_u:
            return node[:0], node[:0]
        u, v = np.concatenate(found_u), np.concatenate(found_v)
        return np.maximum(u, v), np.minimum(u, v)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def found(ready: pa.Table) -> pa.RecordBatch:
            g, part = (ready.column(c).to_numpy() for c in ("g", "slice"))
            cuts = np.flatnonzero(np.concatenate([[True], (g[1:] != g[:-1]) | (part[1:] != part[:-1])])).tolist() + [len(g)]
            both = [pairs(ready.slice(a, b - a)) for a, b in zip(cuts, cuts[1:], strict=False)]
            u, v = (np.concatenate([x[k] for x in both]) for k in (0, 1))
            unique = np.unique(np.stack([u, v], 1), axis=0)
            return pa.RecordBatch.from_arrays([pa.array(unique[:, 0].copy()), pa.array(unique[:, 1].copy())], ["u", "v"])

        held: list[pa.RecordBatch] = []  # the slice that the next batch may go on with
        for batch in batches:
            if not batch.num_rows:
                continue
            key = lambda b, i: (b.column(0)[i].as_py(), b.column(1)[i].as_py())
            if held and key(batch, 0) != key(held[0], 0):
                yield found(pa.Table.from_batches(held).combine_chunks())
                held = []
            g, part = batch.column(0).to_numpy(), batch.column(1).to_numpy()
            last = np.flatnonzero((g == g[-1]) & (part == part[-1]))
            begin = int(last[0])
            if begin:
                yield found(pa.Table.from_batches([*held, batch.slice(0, begin)]).combine_chunks())
                held = []
            held.append(batch.slice(begin))
        if held:
            yield found(pa.Table.from_batches(held).combine_chunks())

    rows = placed.select("g", "slice", "asks", "node", "root", "size", "sketch").repartition("g", "slice").sortWithinPartitions("g", "slice", "node")
    return rows.mapInArrow(tidy(run), "u long, v long")


def _mixed(placed: DataFrame) -> DataFrame:
    """``placed`` (g, node, root) of the blocks with nodes of several components, with ``slice`` and ``asks``.

    The nodes of a block's largest component needn't ask, as every pair of components has one that does. The others are dealt over
    slices, each of which meets the whole block in a task of its own.
    """
    parts = placed.groupBy("g", "root").agg(F.count(F.lit(1)).alias("k"))
    blocks = parts.groupBy("g").agg(F.max_by("root", F.struct("k", "root")).alias("main"), (F.sum("k") - F.max("k")).alias("asking")).where("asking > 0")
    slices = F.ceil(F.col("asking") / ASKING).cast("int")
    rows = placed.join(blocks.select("g", "main", slices.alias("slices")), "g").withColumn("slice", F.explode(F.sequence(F.lit(0), F.col("slices") - 1)))
    mine = F.pmod(F.xxhash64("node"), F.col("slices")) == F.col("slice")
    return rows.select("g", "slice", "node", "root", (mine & (F.col("root") != F.col("main"))).alias("asks"))


def _relabelled(pairs: DataFrame, roots: DataFrame) -> DataFrame:
    """The pairs whose nodes are in different components, with their components cu and cv."""
    side = lambda c, out: roots.select(F.col("node").alias(c), F.col("root").alias(out))
    both = pairs.join(side("u", "cu"), "u", "left").join(side("v", "cv"), "v", "left")
    both = both.withColumns({"cu": F.coalesce("cu", "u"), "cv": F.coalesce("cv", "v")})
    return both.where("cu <> cv")


def _merged(links: DataFrame, roots: DataFrame) -> DataFrame:
    """The components when ``links`` (cu, cv) between components, a written table, are added."""
    if links.isEmpty():
        return roots
    above = components(links.select(F.col("cu").alias("u"), F.col("cv").alias("v")))
    moved = roots.join(above.select(F.col("node").alias("root"), F.col("root").alias("_r")), "root", "left").select("node", F.coalesce("_r", "root").alias("root"))
    new = above.join(roots, "node", "left_anti")
    return scratch.written(moved.unionByName(new).groupBy("node").agg(F.min("root").alias("root")), "roots")


def similar_components(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", percent: int = 80) -> DataFrame:
    """One row for each row of ``docs``: ``doc_id``, ``n_shingles``, ``node`` (a name of the set) and ``component_id``.

    Two rows are linked when 100 times the size of the intersection of their sets of five-word shingles is at least
    ``percent`` times that of the union; ``component_id`` is the smallest id that can be reached by links.

    * null, empty and blank texts: no shingles, linked with nothing, their own id;
    * texts of fewer than five words: one shingle, the whole sequence;
    * null ids: linked like others but never a component's id, unless it holds nothing else (then null);
    * repeated rows and equal texts: one node, kept row for row; an empty table: an empty result; very long texts: whole;
    * other columns are not read, so their names can't clash.
    """
    small_batches(docs.sparkSession)
    for seed in itertools.count():
        table = scratch.written(sets_table(docs, id_col, text_col, percent, seed), "sets")
        named = table.where("node IS NOT NULL").groupBy("node").agg(F.min("doc_id").alias("doc_id"), (F.min("check") != F.max("check")).alias("clash"))
        nodes = scratch.written(named, "nodes")
        if nodes.where("clash").isEmpty():  # different sets with one name: all get others
            break
    nodes = nodes.drop("clash")
    entries = table.agg(F.sum(F.octet_length("blocks"))).first()[0] or 0
    tasks = max(int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")), math.ceil(entries / 8 / GROUPED))
    groups = scratch.written(_groups(_entries(table, tasks), tasks), "groups")
    stars = scratch.written(_with_leader(groups).groupBy("u", "v").agg(F.sum("n").alias("n")), "stars")
    ends = stars.select(F.col("u").alias("node")).unionByName(stars.select(F.col("v").alias("node"))).distinct()
    chosen = scratch.written(nodes.join(ends, "node").select("doc_id", "node"), "chosen")
    sets = scratch.written(_sets_of(docs, chosen, text_col, id_col, seed), "hashes")

    best = stars.groupBy("u").agg(F.max_by("v", F.struct("n", "v")).alias("v"))
    links = scratch.written(_verified(best, sets, percent), "links")
    roots = scratch.written(components(links), "roots")
    tried = _relabelled(stars, roots).join(best, ["u", "v"], "left_anti")
    links = scratch.written(_relabelled(_verified(tried, sets, percent), roots), "links")
    roots = _merged(links, roots)

    # what is left: blocks whose nodes are still in different components; first the nearest of each node, then all
    members = F.when(F.col("first"), F.concat(F.array("leader"), F.col("members"))).otherwise(F.col("members"))
    exploded = groups.select("g", F.explode(members).alias("node")).distinct()
    brief = sets.select("node", "size", "sketch")
    for nearest in (True, False):
        placed = exploded.join(roots, "node", "left").select("g", "node", F.coalesce("root", "node").alias("root"))
        mixed = scratch.written(_mixed(placed), "mixed")
        if mixed.isEmpty():
            break
        across = _across(mixed.join(brief, "node"), percent, nearest).distinct()
        links = scratch.written(_relabelled(_verified(across.join(stars.select("u", "v"), ["u", "v"], "left_anti"), sets, percent), roots), "links")
        roots = _merged(links, roots)

    named = nodes.join(roots, "node", "left").select("node", "doc_id", F.coalesce("root", "node").alias("root"))
    least = named.groupBy("root").agg(F.min("doc_id").alias("component_id"))
    named = named.join(least, "root").select(F.col("node").alias("_n"), "component_id")
    joined = table.join(named, F.col("node") == F.col("_n"), "left")
    whose = F.when(F.col("node").isNull(), F.col("doc_id")).otherwise(F.col("component_id"))
    return joined.select("doc_id", F.col("n").alias("n_shingles"), "node", whose.alias("component_id"))


def one_of_each(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", percent: int = 80) -> DataFrame:
    """The rows of ``docs`` without those that a link, direct or not, joins to one with a smaller id; all its columns.

    Rows without shingles and rows with null ids stay. Of repeated rows of an id that stays, one does.
    """
    verdict = scratch.written(similar_components(docs, id_col, text_col, percent).select("doc_id", "component_id"), "verdicts")
    leave = verdict.where("doc_id <> component_id").select("doc_id").distinct()
    again = verdict.where("doc_id = component_id").groupBy("doc_id").count().where("count > 1").select("doc_id")

    def against(rows: DataFrame, ids: DataFrame, how: str) -> DataFrame:
        named = ids.select(F.col("doc_id").alias("_left"))
        return rows.join(F.broadcast(named) if is_small(ids) else named, rows[id_col] == F.col("_left"), how)

    stay = against(docs, leave, "left_anti")
    if again.isEmpty():
        return stay
    return against(stay, again, "left_anti").unionByName(against(stay, again, "left_semi").dropDuplicates([id_col]))
