"""Deterministic splits and samples by hashes of ids."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def md5_mod(text: Column, modulus: int) -> Column:
    """The md5 digest as one big number modulo ``modulus``, folded in chunks of eight hex digits."""
    digest = F.md5(text.cast("binary"))
    out = F.lit(0).cast("long")
    for k in range(4):
        chunk = F.conv(F.substring(digest, 8 * k + 1, 8), 16, 10).cast("long")
        out = (out * (2**32 % modulus) + chunk % modulus) % modulus
    return out


def is_validation(text: Column, percent: int = 20) -> Column:
    return md5_mod(text, 100) < percent


def hash_sample(df: DataFrame, id_col: str, n: int, salt: str) -> DataFrame:
    """The ``n`` rows with the smallest md5 of ``salt:id``; a top-n, not a global sort."""
    return df.orderBy(F.md5(F.concat(F.lit(f"{salt}:"), F.col(id_col)).cast("binary")), id_col).limit(n)


def hash_fraction(df: DataFrame, id_col: str, per_mille: int) -> DataFrame:
    """About ``per_mille`` thousandths of the rows, the same in every run."""
    return df.where(F.pmod(F.xxhash64(id_col), F.lit(1000)) < per_mille)


def split_stats(long_truth: DataFrame) -> DataFrame:
    """Entities, singleton share and mean matches of the training and validation split of a long ground truth (s1_id, match_id)."""
    n = long_truth.groupBy("s1_id").agg(F.count("match_id").alias("n"))
    g = n.groupBy(F.when(is_validation(F.col("s1_id")), "val").otherwise("train").alias("split"))
    return g.agg(F.count(F.lit(1)).alias("entities"), F.avg((F.col("n") == 0).cast("double")).alias("singleton_share"), F.avg("n").alias("mean_matches"))
