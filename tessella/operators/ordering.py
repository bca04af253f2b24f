"""Order across a whole table: row numbers, chunks, first rows, samples and top lists, without a task that holds all rows."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tessella.sources.stored import written


def row_index(df: DataFrame, by: Sequence[str], out: str = "index") -> DataFrame:
    """``df`` with the place (from 0) of each row in the order of ``by``, which must tell rows apart.

    Rows are dealt by range and numbered within their part; a part's first number is the sum of the sizes of those before it.
    """
    dealt = written(df.repartitionByRange(*by).withColumn("_p", F.spark_partition_id()), "ranges")
    before = F.coalesce(F.sum("_n").over(W.orderBy("_p").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))  # a row for each part
    begins = dealt.groupBy("_p").agg(F.count(F.lit(1)).alias("_n")).select("_p", before.alias("_before"))
    placed = dealt.withColumn("_place", F.row_number().over(W.partitionBy("_p").orderBy(*by)))
    return placed.join(F.broadcast(begins), "_p").withColumn(out, F.col("_before") + F.col("_place") - 1).drop("_p", "_before", "_place")


def chunks(df: DataFrame, by: Sequence[str], size: int, out: str = "chunk") -> DataFrame:
    """``df`` with the number of the chunk of ``size`` rows that each row is in, in the order of ``by``."""
    return row_index(df, by, "_index").withColumn(out, F.floor(F.col("_index") / size)).drop("_index")


def keep_first(df: DataFrame, keys: Sequence[str], order: Sequence[str]) -> DataFrame:
    """The first row, in the order of ``order``, of those with equal ``keys``; combined before the shuffle."""
    rest = [c for c in df.columns if c not in keys]
    first = F.min_by(F.struct(*rest), F.struct(*order))
    return df.groupBy(*keys).agg(first.alias("_f")).select(*keys, "_f.*").select(df.columns)


def hashed(ids: Column, salt: str) -> Column:
    return F.md5(F.concat(F.lit(f"{salt}:"), ids.cast("string")).cast("binary"))


def sample_per_group(df: DataFrame, by: str, id_col: str, n: int, salt: str) -> DataFrame:
    """``n`` rows of each group in a random but repeatable order; the limit is applied before the shuffle too."""
    order = W.partitionBy(by).orderBy(hashed(F.col(id_col), salt), id_col)
    return df.withColumn("_r", F.row_number().over(order)).where(F.col("_r") <= n).drop("_r")


def merged_top(shards: Sequence[DataFrame], by: str, other: str, score: str, k: int) -> DataFrame:
    """The ``k`` best rows for each ``by`` over several shards, from each shard's ``k`` best; ties go to the smaller ``other``."""
    best = W.partitionBy(by).orderBy(F.desc(score), other)
    top = lambda df: df.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k)
    return top(reduce(DataFrame.unionByName, [top(s).drop("rank") for s in shards]))


def positions(lists: DataFrame, wanted: DataFrame) -> DataFrame:
    """``wanted`` (s1_id, cand_id) with the place (from 1) of the candidate in its query's list (s1_id, ids: array), null where it isn't."""
    both = wanted.join(lists, "s1_id", "left")
    return both.select("s1_id", "cand_id", F.nullif(F.array_position("ids", F.col("cand_id")).cast("int"), F.lit(0)).alias("position"))


def gathered(df: DataFrame, key: str, wanted: DataFrame) -> DataFrame:
    """The rows of ``df`` for the keys of ``wanted`` (place, key), one for each of its rows, nulls where ``df`` has none."""
    return wanted.join(df.withColumnRenamed(key, "_k"), wanted[key] == F.col("_k"), "left").drop("_k")
