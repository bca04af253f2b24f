"""Small tables for reports: crosstabs, label spellings, transposition, text."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def crosstab(df: DataFrame, row: str, column: str) -> DataFrame:
    """(row, column, n, share): counts of value pairs and their shares of the row's total."""
    n = df.groupBy(row, column).agg(F.count(F.lit(1)).alias("n"))
    return n.withColumn("share", F.col("n") / F.sum("n").over(W.partitionBy(row)))


def spellings(df: DataFrame, by: str, label: Column) -> DataFrame:
    """How many spellings of labels a group has, as they stand and once case and outer blanks are left out."""
    return df.groupBy(by).agg(F.countDistinct(label).alias("raw"), F.countDistinct(F.lower(F.trim(label))).alias("normalised"))


def transposed(df: DataFrame, key: str, columns: Sequence[str]) -> DataFrame:
    """(key, measure, value): a row for each of the numeric ``columns`` of each row."""
    return df.select(key, F.explode(F.array(*[F.struct(F.lit(c).alias("measure"), F.col(c).cast("double").alias("value")) for c in columns])).alias("x")).select(key, "x.*")


def side_by_side(*rows: DataFrame) -> DataFrame:
    """Tables of one row each as one row."""
    out = rows[0]
    for r in rows[1:]:
        out = out.crossJoin(r)
    return out


def collisions(left: DataFrame, right: DataFrame) -> DataFrame:
    """(country, keys, pairs): keys (country, key) that both tables have, and the pairs that would be formed on them, which aren't."""
    a = left.groupBy("country", "key").agg(F.count(F.lit(1)).alias("na"))
    b = right.groupBy("country", "key").agg(F.count(F.lit(1)).alias("nb"))
    return a.join(b, ["country", "key"]).groupBy("country").agg(F.count(F.lit(1)).alias("keys"), F.sum(F.col("na") * F.col("nb")).alias("pairs"))


def slopes(df: DataFrame, by: str, x: str, y: str) -> DataFrame:
    """Least-squares slope of y on x for each group."""
    return df.groupBy(by).agg(F.regr_slope(F.col(y).cast("double"), F.col(x).cast("double")).alias("slope"), F.count(F.lit(1)).alias("n"))


def markdown(df: DataFrame, most: int = 100) -> str:
    """The first rows of a small result as a table in text."""
    rows = [list(df.columns), *[["" if v is None else f"{v:.4f}" if isinstance(v, float) else str(v) for v in r] for r in df.limit(most).collect()]]
    lines = ["| " + " | ".join(c.replace("|", "\\|") for c in r) + " |" for r in rows]
    return "\n".join([lines[0], "|" + "-|" * len(df.columns), *lines[1:]])
