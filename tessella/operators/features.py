"""Features of candidate pairs. Null on either side means unknown, never different."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tessella.functions import overlap, similarity
from tessella.functions.text import jaccard
from tessella.functions.workers import tidy
from tessella.operators import vectors

#: Inputs that each side of a pair brings, prefixed a_ and b_.
ENTITY = [
    "name_core", "name_nospace", "name_domain_stem", "name_script", "legal_families", "name_has_nonlatin",
    "addr_core", "addr_house_number", "addr_state_canon", "addr_numbers", "chain_n",
]
K1, K2, K4 = 50, 20, 10
#: What the worker of a pair hands on of each side, and the features that it measures itself.
BROUGHT = [
    "name_core", "name_nospace", "name_domain_stem", "name_script", "legal_families", "name_has_nonlatin", "addr_house_number", "addr_state_canon", "chain_n", "house_int", "num_set",
]
MEASURED = {
    "name_tsr": pa.float32(), "name_jw": pa.float32(), "name_3g_jac": pa.float32(), "name_tok_jac": pa.float32(), "name_tok_added": pa.int32(), "name_tok_dropped": pa.int32(),
    "a_name_ntok": pa.int32(), "b_name_ntok": pa.int32(), "addr_tok_jac": pa.float32(), "addr_3g_jac": pa.float32(), "a_addr_missing": pa.int8(), "b_addr_missing": pa.int8(),
    "s1_n_cands": pa.int32(), "p1_cos_rank_s1": pa.int32(), "p2_cos_rank_s1": pa.int32(), "p1_cos_gap_s1": pa.float32(),
}
#: Characters of the texts of a side whose sets a worker holds at once, about.
LETTERS = 1 << 21


def tokens(text: Column) -> Column:
    return F.array_distinct(F.filter(F.split(text, " "), lambda t: t != ""))


def grams(text: Column) -> Column:
    """Distinct character trigrams; a shorter text is its own only gram."""
    cut = F.transform(F.sequence(F.lit(1), F.length(text) - 2), lambda i: F.substring(text, i, 3))
    return F.array_distinct(F.when(F.length(text) >= 3, cut).when(F.length(text) > 0, F.array(text)).otherwise(F.array().cast("array<string>")))


def numbered(records: DataFrame) -> DataFrame:
    return records.withColumns({"house_int": F.expr("try_cast(regexp_extract(addr_house_number, '[0-9]+', 0) AS BIGINT)"), "num_set": F.array_distinct("addr_numbers")})


def prepared(records: DataFrame) -> DataFrame:
    """What many pairs of a record share, made once for each record."""
    return numbered(records).withColumns({
        "name_tok": tokens(F.col("name_core")), "name_3g": grams(F.col("name_core")), "addr_tok": tokens(F.col("addr_core")),
        "addr_3g": F.when(F.col("addr_core").isNotNull(), grams(F.col("addr_core"))),
    })


def attach(pairs: DataFrame, s1: DataFrame, pool: DataFrame) -> DataFrame:
    """``pairs`` with both sides' columns, prefixed a_ and b_; a pair whose record is missing fails the job."""
    side = lambda df, p, key: df.select(F.col("entity_id").alias(key), *[F.col(c).alias(f"{p}_{c}") for c in df.columns if c not in ("entity_id", "country")], F.lit(True).alias(f"_{p}"))
    out = pairs.join(side(prepared(s1), "a", "s1_id"), "s1_id", "left").join(side(prepared(pool), "b", "cand_id"), "cand_id", "left")
    known = F.coalesce(F.col("_a") & F.col("_b"), F.lit(False))
    checked = F.when(known, F.col("s1_id")).otherwise(F.raise_error(F.concat(F.lit("no record for pair "), "s1_id", F.lit(" "), "cand_id")))
    return out.withColumn("s1_id", checked).drop("_a", "_b")


def _both(name: str) -> Column:
    return F.col(f"a_{name}").isNotNull() & F.col(f"b_{name}").isNotNull()


def _flag(cond: Column) -> Column:
    return F.coalesce(cond, F.lit(False)).cast("byte")


def name_features() -> dict[str, Column]:
    a, b = F.col("a_name_core"), F.col("b_name_core")
    ta, tb = F.col("a_name_tok"), F.col("b_name_tok")
    stem = lambda x, y: F.coalesce(F.col(x) == F.col(y), F.lit(False))
    domain = stem("a_name_nospace", "b_name_domain_stem") | stem("a_name_domain_stem", "b_name_nospace") | stem("a_name_domain_stem", "b_name_domain_stem")
    overlap = F.coalesce(F.arrays_overlap("a_legal_families", "b_legal_families"), F.lit(False))
    stated = F.coalesce((F.size("a_legal_families") > 0) & (F.size("b_legal_families") > 0), F.lit(False))
    return {
        "name_3g_jac": jaccard(F.col("a_name_3g"), F.col("b_name_3g")).cast("float"), "name_tok_jac": jaccard(ta, tb).cast("float"),
        "name_core_eq": _flag(a == b), "name_domain_match": _flag(domain), "name_any_domain": _flag(F.col("a_name_domain_stem").isNotNull() | F.col("b_name_domain_stem").isNotNull()),
        "name_tok_added": F.size(F.array_except(tb, ta)), "name_tok_dropped": F.size(F.array_except(ta, tb)), "a_name_ntok": F.size(ta), "b_name_ntok": F.size(tb),
        "legal_agree": _flag(stated & overlap), "legal_conflict": _flag(stated & ~overlap), "legal_unknown": _flag(~stated),
    }


def address_features() -> dict[str, Column]:
    na, nb = F.col("a_num_set"), F.col("b_num_set")
    same_state = F.col("a_addr_state_canon") == F.col("b_addr_state_canon")
    return {
        "addr_tok_jac": jaccard(F.col("a_addr_tok"), F.col("b_addr_tok")).cast("float"), "addr_3g_jac": jaccard(F.col("a_addr_3g"), F.col("b_addr_3g")).cast("float"),
        "a_addr_missing": _flag(F.col("a_addr_core").isNull()), "b_addr_missing": _flag(F.col("b_addr_core").isNull()),
        "hn_exact": F.when(_both("addr_house_number"), (F.col("a_addr_house_number") == F.col("b_addr_house_number")).cast("byte")),
        "hn_gap": F.abs(F.col("a_house_int") - F.col("b_house_int")),
        "a_hn_missing": _flag(F.col("a_addr_house_number").isNull()), "b_hn_missing": _flag(F.col("b_addr_house_number").isNull()),
        "addr_num_overlap": F.size(F.array_intersect(na, nb)), "addr_num_jac": jaccard(na, nb).cast("float"),
        "state_agree": _flag(same_state), "state_disagree": _flag(~same_state), "state_unknown": _flag(~_both("addr_state_canon")),
        "a_nonlatin": _flag(F.col("a_name_has_nonlatin")), "b_nonlatin": _flag(F.col("b_name_has_nonlatin")), "script_same": _flag(F.col("a_name_script") == F.col("b_name_script")),
    }


def blocking_features() -> dict[str, Column]:
    per_query = W.partitionBy("s1_id")
    by = lambda c: F.when(F.col(c).isNotNull(), F.rank().over(per_query.orderBy(F.col(c).desc_nulls_last())))
    flags = ["in_p1", "in_p2", "in_p3", "in_p4"]
    return {
        **{f: _flag(F.col(f)) for f in flags}, "n_passes": sum((_flag(F.col(f)).cast("int") for f in flags), F.lit(0)),
        "p1_cos": F.col("p1_cos").cast("float"), "p2_cos": F.col("p2_cos").cast("float"),
        "p1_rank": F.coalesce("p1_rank", F.lit(K1 + 1)), "p2_rank": F.coalesce("p2_rank", F.lit(K2 + 1)), "p1_rank_rev": F.coalesce("p1_rank_rev", F.lit(K4 + 1)),
        "mutual_best": _flag((F.col("p1_rank") == 1) & (F.col("p1_rank_rev") == 1)),
        "s1_n_cands": F.count(F.lit(1)).over(per_query).cast("int"), "p1_cos_rank_s1": by("p1_cos"), "p2_cos_rank_s1": by("p2_cos"),
        "p1_cos_gap_s1": (F.max("p1_cos").over(per_query) - F.col("p1_cos")).cast("float"),
    }


# ------------------------------------------------------------------------------------------------ in workers


def _of_ids(ids: pa.Array, rows: pa.Table) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For each of ``ids`` where its rows begin and how many there are, in an order of the rows."""
    names = pc.unique(ids.drop_null())
    place = lambda x: pc.fill_null(pc.index_in(x, value_set=names), len(names)).to_numpy(zero_copy_only=False).astype(np.int64)
    mine, wanted = place(rows.column("entity_id").combine_chunks()), place(ids)
    order = np.argsort(mine, kind="stable")
    bounds = np.searchsorted(mine[order], np.arange(len(names) + 1))
    return order, np.append(bounds[:-1], 0)[wanted], np.append(np.diff(bounds), 0)[wanted]


def _joined(first: pa.Array, second: pa.Array, a: pa.Table, b: pa.Table) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Pair, row of ``a`` and row of ``b`` of each row of the join; a pair whose record is missing fails the job."""
    (in_a, from_a, n_a), (in_b, from_b, n_b) = _of_ids(first, a), _of_ids(second, b)
    lost = np.flatnonzero(n_a * n_b == 0)
    if len(lost):
        raise ValueError(f"no record for pair {first[lost[0]]} {second[lost[0]]}")
    pair = np.repeat(np.arange(len(first)), n_a * n_b)
    nth = overlap.ranges(np.zeros(len(first), np.int64), n_a * n_b)
    return pair, in_a[from_a[pair] + nth // n_b[pair]], in_b[from_b[pair] + nth % n_b[pair]]


def _set_measures(a: pa.Table, b: pa.Table, i: np.ndarray, j: np.ndarray) -> Iterator[tuple[str, np.ndarray, np.ndarray, np.ndarray]]:
    """For the sets of names and addresses how many items a pair shares and each side has."""
    kinds = {"name_tok": ("name_core", overlap.words), "name_3g": ("name_core", overlap.trigrams), "addr_tok": ("addr_core", overlap.words), "addr_3g": ("addr_core", overlap.trigrams)}
    block = lambda t: np.cumsum(sum(pc.fill_null(pc.utf8_length(t.column(c)), 0).to_numpy().astype(np.int64) for c in ("name_core", "addr_core"))) // LETTERS
    x, y = block(a)[i], block(b)[j]
    order = np.lexsort((i, y, x))
    x, y = x[order], y[order]
    cuts = np.flatnonzero(np.concatenate([[True], (x[1:] != x[:-1]) | (y[1:] != y[:-1])])[: len(x)])
    found = {k: tuple(np.zeros(len(i), np.int64) for _ in range(3)) for k in kinds}
    last, mine = None, {}
    for start, end in zip(cuts, [*cuts[1:], len(x)], strict=True):
        at = order[start:end]
        if x[start] != last:
            last, asked = x[start], np.unique(i[order[start : np.searchsorted(x, x[start], side="right")]])
            mine = {k: make(a.column(c).combine_chunks().take(pa.array(asked))) for k, (c, make) in kinds.items()}
        met, there = np.unique(j[at], return_inverse=True)
        here = np.searchsorted(asked, i[at])
        for k, (c, make) in kinds.items():
            theirs = make(b.column(c).combine_chunks().take(pa.array(met)))
            for into, value in zip(found[k], (overlap.shared(mine[k], theirs, here, there), mine[k].sizes[here], theirs.sizes[there]), strict=True):
                into[at] = value
    for k, counts in found.items():
        yield k, *counts


def _by_query(query: np.ndarray, value: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of each value whether it is null, its rank in its query, the largest first and equal ones alike, and the query's largest."""
    null, x = pc.is_null(value).to_numpy(zero_copy_only=False), pc.fill_null(value.cast(pa.float64()), 0.0).to_numpy(zero_copy_only=False)
    key = np.where(np.isnan(x), -np.inf, -x)  # NaN is the largest
    order = np.lexsort((key, null, query))
    q, k, z = query[order], key[order], null[order]
    one = np.ones(min(1, len(q)), bool)
    new = np.concatenate([one, q[1:] != q[:-1]])
    other = np.concatenate([one, (k[1:] != k[:-1]) | (z[1:] != z[:-1])]) | new
    begin = lambda at: np.maximum.accumulate(np.where(at, np.arange(len(q)), 0))
    rank, best = np.empty(len(q), np.int64), np.empty(len(q))
    rank[order], best[order] = begin(other) - begin(new) + 1, x[order][begin(new)]
    return null, rank, best


def _similarities(a: pa.Array, b: pa.Array, i: np.ndarray, j: np.ndarray) -> dict[str, pa.Array]:
    """Token set ratio and Jaro-Winkler of names; equal pairs are compared once."""
    left, right = pc.unique(a), pc.unique(b)
    place = lambda x, names, at: pc.index_in(x, value_set=names).to_numpy(zero_copy_only=False).astype(np.int64)[at]
    distinct, number = np.unique(place(a, left, i) * max(1, len(right)) + place(b, right, j), return_inverse=True)
    left, right = left.to_pylist(), right.to_pylist()
    names = [(left[k // len(right)], right[k % len(right)]) for k in distinct.tolist()]
    return {c: pa.array([f(x, y) for x, y in names], pa.float32()).take(pa.array(number)) for c, f in (("name_tsr", similarity.token_set_ratio), ("name_jw", similarity.jaro_winkler))}


def _measured(both: pa.Table, a: pa.Table, b: pa.Table) -> tuple[np.ndarray, np.ndarray, np.ndarray, dict[str, pa.Array]]:
    """The rows of the join, as from ``_joined``, and their features named in MEASURED."""
    first, second, rest = (both.column(c).combine_chunks() for c in ("entity_id", "met", "rest"))
    pair, i, j = _joined(first, second, a, b)
    made: dict[str, object] = _similarities(a.column("name_core").combine_chunks(), b.column("name_core").combine_chunks(), i, j)
    null = lambda c: pc.is_null(a.column(c)).to_numpy()[i] | pc.is_null(b.column(c)).to_numpy()[j]
    nameless = null("name_core")
    for k, common, n_a, n_b in _set_measures(a, b, i, j):
        union = n_a + n_b - common
        unknown = (union == 0) | (null("addr_core") if k.startswith("addr") else nameless & (k == "name_tok"))
        made[f"{k}_jac"] = pa.array((common / np.maximum(union, 1)).astype(np.float32), mask=unknown)
        if k == "name_tok":
            made |= {"name_tok_added": pa.array(n_b - common, mask=nameless), "name_tok_dropped": pa.array(n_a - common, mask=nameless)}
            made |= {f"{side}_name_ntok": pa.array(n, mask=pc.is_null(t.column("name_core")).to_numpy()[at]) for side, n, t, at in (("a", n_a, a, i), ("b", n_b, b, j))}
    made |= {"a_addr_missing": pc.is_null(a.column("addr_core")).to_numpy()[i].astype(np.int8), "b_addr_missing": pc.is_null(b.column("addr_core")).to_numpy()[j].astype(np.int8)}
    query = pc.index_in(first, value_set=pc.unique(first)).to_numpy(zero_copy_only=False).astype(np.int64)[pair]
    made["s1_n_cands"] = np.bincount(query)[query]
    for p in ("p1", "p2"):
        cosine = pc.struct_field(rest, f"{p}_cos").take(pa.array(pair))
        none, rank, best = _by_query(query, cosine)
        made[f"{p}_cos_rank_s1"] = pa.array(rank, mask=none)
        if p == "p1":
            made["p1_cos_gap_s1"] = pa.array((best - pc.fill_null(cosine.cast(pa.float64()), 0.0).to_numpy(zero_copy_only=False)).astype(np.float32), mask=none)
    return pair, i, j, {c: pa.array(made[c]).cast(kind) for c, kind in MEASURED.items()}


def _met(pairs: DataFrame, s1: DataFrame, pool: DataFrame) -> DataFrame:
    """``pairs`` with what the worker brings and measures, as :func:`attach` would join them.

    A task has the pairs of a group of queries, reads all records and keeps those of its pairs: neither a pair nor a record is moved.
    """
    told, sizes = vectors.told(pairs)
    rows = told.withColumn("kind", F.lit(1))
    for kind, records in ((2, s1), (3, pool)):
        side = numbered(records).select(F.lit(0).alias("low"), F.lit(len(sizes) - 1).alias("high"), "entity_id", F.struct(*BROUGHT, "addr_core").alias("side"), F.lit(kind).alias("kind"))
        rows = rows.unionByName(side, allowMissingColumns=True)
    kept = [[], ["entity_id", "met", "rest"], *[["entity_id", "side"]] * 2]
    fields = {f.name: f.dataType for f in rows.schema["side"].dataType.fields}
    sides = [(p, c) for p in "ab" for c in BROUGHT]
    plain = {pa.float32(): T.FloatType(), pa.int32(): T.IntegerType(), pa.int8(): T.ByteType()}
    kinds = {**dict.fromkeys(vectors.PAIR, T.StringType()), "rest": rows.schema["rest"].dataType, **{f"{p}_{c}": fields[c] for p, c in sides}, **{c: plain[kind] for c, kind in MEASURED.items()}}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found = vectors.gathered(batches, sizes, kept)
        if found is None:
            return
        both, (_, _, *records) = found
        empty = pa.table({"entity_id": pa.array([], pa.string()), **{f"side.{c}": pa.array([], pa.string()) for c in (*BROUGHT, "addr_core")}})
        a, b = ((pa.concat_tables(x).flatten() if x else empty).combine_chunks() for x in records)
        a, b = (t.rename_columns([c.removeprefix("side.") for c in t.column_names]) for t in (a, b))
        pair, i, j, made = _measured(both, a, b)
        whole = [(both.column(c).combine_chunks(), pair) for c in ("entity_id", "met", "rest")]
        whole += [({"a": a, "b": b}[p].column(c).combine_chunks(), {"a": i, "b": j}[p]) for p, c in sides]
        for start in range(0, len(pair), vectors.CHUNK):
            arrays = [x.take(pa.array(at[start : start + vectors.CHUNK])) for x, at in whole]
            yield pa.RecordBatch.from_arrays([*arrays, *[x[start : start + vectors.CHUNK] for x in made.values()]], list(kinds))

    return vectors.dealt(rows, len(sizes)).mapInArrow(tidy(run), T.StructType([T.StructField(c, kind) for c, kind in kinds.items()]))


def pair_features(pairs: DataFrame, s1: DataFrame, pool: DataFrame, keep: Sequence[str] = ()) -> DataFrame:
    """s1_id, cand_id, country, 48 features, and the columns ``keep`` of ``pairs``.

    Workers bring both sides to a pair, with the similarities of names, the sizes of what their sets share and the ranks in a query;
    everything else is column expressions. All three tables are read once for each group of queries, so they should be written ones.
    """
    both = _met(pairs, s1, pool).select("*", *[F.col("rest")[c].alias(c) for c in pairs.columns if c not in vectors.PAIR])
    made = {**name_features(), **address_features(), **blocking_features(), **{c: F.col(c) for c in MEASURED}}
    made |= {"b_is_s3": _flag(F.startswith("cand_id", F.lit("S3-"))), "a_chain_n": F.coalesce("a_chain_n", F.lit(0)), "b_chain_n": F.coalesce("b_chain_n", F.lit(0))}
    first = ["name_tsr", "name_jw"]
    return both.select("s1_id", "cand_id", "country", *first, *[c.alias(n) for n, c in made.items() if n not in first], *keep)
