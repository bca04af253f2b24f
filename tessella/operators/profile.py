"""Profiling queries: distributions, pivots, vocabularies, agreement, key rules."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tessella.functions import text as T


def top_tokens(df: DataFrame, by: str, tokens: Column, n: int) -> DataFrame:
    """The ``n`` most frequent tokens of each group, ties by token."""
    counts = df.select(by, F.explode(tokens).alias("token")).groupBy(by, "token").agg(F.count(F.lit(1)).alias("n"))
    return counts.withColumn("rank", F.row_number().over(W.partitionBy(by).orderBy(F.desc("n"), "token"))).where(F.col("rank") <= n)


def vocab_overlap(train: DataFrame, test: DataFrame) -> DataFrame:
    """Shares of the test's types and occurrences (column ``token``) that the training text has."""
    counts = test.groupBy("token").agg(F.count(F.lit(1)).alias("n"))
    seen = counts.join(train.select("token").distinct().withColumn("seen", F.lit(1)), "token", "left")
    return seen.agg(F.count(F.lit(1)).alias("types"), F.avg(F.coalesce("seen", F.lit(0))).alias("type_share"), F.try_divide(F.sum(F.when(F.col("seen") == 1, F.col("n")).otherwise(0)).cast("double"), F.sum("n")).alias("occurrence_share"))


def percentiles(df: DataFrame, by: str, value: Column, at: Sequence[float]) -> DataFrame:
    """Exact discrete percentiles, mean and maximum of a value for each group."""
    named = [F.expr(f"percentile_disc({q}) WITHIN GROUP (ORDER BY _v)").alias(f"p{round(q * 100)}") for q in at]
    return df.select(by, value.alias("_v")).groupBy(by).agg(*named, F.avg("_v").alias("mean"), F.max("_v").alias("max"))


def pivot_counts(df: DataFrame, row: str, column: str, values: Sequence[str]) -> DataFrame:
    """Counts of each row value by column value with the row's total and its share of all."""
    p = df.groupBy(row).pivot(column, list(values)).count().na.fill(0)
    total = sum((F.col(v) for v in values), F.lit(0))
    counted = df.groupBy(row).agg(F.count(F.lit(1)).alias("total"))
    share = F.col("total") / F.sum("total").over(W.partitionBy())  # a row for each row value
    return p.join(counted, row).select(row, *values, "total", share.alias("share"), (F.col("total") - total).alias("other"))


def signal_rates(pairs: DataFrame, by: Sequence[str], **signals: Column) -> DataFrame:
    """The mean of each signal for each group, nulls left out."""
    return pairs.groupBy(*by).agg(*[F.avg(c.cast("double")).alias(n) for n, c in signals.items()], F.count(F.lit(1)).alias("pairs"))


def rate_gaps(rates: DataFrame, by: str, label: str, signals: Sequence[str]) -> DataFrame:
    """For each signal the rate among true pairs less that among others."""
    side = lambda value, c: F.max(F.when(F.col(label) == value, F.col(c)))
    wide = rates.groupBy(by).agg(*[(side(True, s) - side(False, s)).alias(s) for s in signals])
    return wide.select(by, F.explode(F.array(*[F.struct(F.lit(s).alias("signal"), F.col(s).alias("gap")) for s in signals])).alias("x")).select(by, "x.*")


def match_histogram(long_truth: DataFrame, most: int = 10) -> DataFrame:
    """Entities by their number of matches; ``most`` stands for that many and more."""
    n = long_truth.groupBy("s1_id").agg(F.count("match_id").alias("n"))
    return n.groupBy(F.least("n", F.lit(most)).alias("matches")).agg(F.count(F.lit(1)).alias("entities"))


def match_summary(long_truth: DataFrame) -> DataFrame:
    """Entities, singletons, and the mean and greatest number of matches."""
    n = long_truth.groupBy("s1_id").agg(F.count("match_id").alias("n"))
    return n.agg(F.count(F.lit(1)).alias("entities"), F.count_if(F.col("n") == 0).alias("singletons"), F.avg(F.when(F.col("n") > 0, F.col("n"))).alias("mean_matched"), F.max("n").alias("most"))


def source_mix(long_truth: DataFrame) -> DataFrame:
    """Entities by whether their matches come from source 2, 3, both or none."""
    n = long_truth.groupBy("s1_id").agg(F.count_if(F.startswith("match_id", F.lit("S2-"))).alias("n2"), F.count_if(F.startswith("match_id", F.lit("S3-"))).alias("n3"))
    mix = F.when((F.col("n2") > 0) & (F.col("n3") > 0), "both").when(F.col("n2") > 0, "s2_only").when(F.col("n3") > 0, "s3_only").otherwise("none")
    return n.groupBy(mix.alias("mix")).agg(F.count(F.lit(1)).alias("entities"))


def shared_names(records: DataFrame) -> DataFrame:
    """By country: names, records, records whose name others have, and names with several addresses."""
    g = records.groupBy("country", "name").agg(F.count(F.lit(1)).alias("n"), F.countDistinct("address").alias("addresses"))
    return g.groupBy("country").agg(F.count(F.lit(1)).alias("names"), F.sum("n").alias("records"), F.sum(F.when(F.col("n") > 1, F.col("n")).otherwise(0)).alias("shared"), F.count_if(F.col("addresses") > 1).alias("chains"))


def key_rule(left: DataFrame, right: DataFrame, true_pairs: DataFrame) -> DataFrame:
    """Precision and recall of declaring all pairs with an equal key matches, without forming them.

    left and right: (id, country, key). The pairs of a key number n_left * n_right; only true pairs are joined out.
    """
    a = left.where("key <> ''").groupBy("country", "key").agg(F.count(F.lit(1)).alias("na"))
    b = right.where("key <> ''").groupBy("country", "key").agg(F.count(F.lit(1)).alias("nb"))
    declared = a.join(b, ["country", "key"]).groupBy("country").agg(F.sum(F.col("na") * F.col("nb")).alias("declared"))
    t = true_pairs.join(left.select(F.col("id").alias("s1_id"), "country", F.col("key").alias("ka")), "s1_id").join(right.select(F.col("id").alias("cand_id"), F.col("key").alias("kb")), "cand_id")
    hits = t.groupBy("country").agg(F.count(F.lit(1)).alias("true_pairs"), F.count_if((F.col("ka") == F.col("kb")) & (F.col("ka") != "")).alias("hits"))
    return hits.join(declared, "country", "left").select("country", "true_pairs", "hits", F.coalesce("declared", F.lit(0)).alias("declared"), F.try_divide(F.col("hits").cast("double"), F.col("declared")).alias("precision"), F.try_divide(F.col("hits").cast("double"), F.col("true_pairs")).alias("recall"))


def agreement_ladder(pairs: DataFrame, a: str, b: str) -> DataFrame:
    """Shares of pairs of names that agree, under ever looser comparisons."""
    x, y = F.col(a), F.col(b)
    nx, ny = T.norm_name(x), T.norm_name(y)
    tokens = lambda c: F.array_distinct(F.split(c, " "))
    steps = {"exact": x == y, "casefold": F.lower(x) == F.lower(y), "basic": T.basic_norm(x) == T.basic_norm(y), "norm": nx == ny, "sorted": T.sorted_tokens(nx) == T.sorted_tokens(ny),
             "subset": (F.size(F.array_except(tokens(nx), tokens(ny))) == 0) | (F.size(F.array_except(tokens(ny), tokens(nx))) == 0)}
    return pairs.agg(*[F.avg(c.cast("double")).alias(n) for n, c in steps.items()])
