"""From scored candidates to decisions, and the metrics of decisions."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

PAIR = ["s1_id", "cand_id"]
#: Thresholds in hundredths: 0.10, 0.12, ... 0.98.
GRID = range(10, 99, 2)


def one_to_one(preds: DataFrame) -> DataFrame:
    """Each candidate keeps only its most probable query; ties go to the smallest query id."""
    best = W.partitionBy("cand_id").orderBy(F.desc("prob"), "s1_id")
    return preds.withColumn("_r", F.row_number().over(best)).where("_r = 1").drop("_r")


def decide(preds: DataFrame, threshold: float) -> DataFrame:
    """One-to-one pairs of at least ``threshold``: the filter goes first, which commutes and shuffles less."""
    return one_to_one(preds.where(F.col("prob") >= threshold))


def f05(tp: Column, n_pred: Column, n_true: Column) -> Column:
    """F0.5 of one query. Without truth: 1 if nothing is predicted, else 0; without a hit: 0."""
    p, r = F.try_divide(tp.cast("double"), n_pred), F.try_divide(tp.cast("double"), n_true)
    return F.when(n_true == 0, (n_pred == 0).cast("double")).when(tp == 0, F.lit(0.0)).otherwise(1.25 * p * r / (0.25 * p + r))


def per_s1_f05(matches: DataFrame, queries: DataFrame, truth: DataFrame) -> DataFrame:
    """n_pred, n_true, tp and f05 of every query, also of those without pairs.

    Predictions and truth meet in one aggregation per query instead of three joined ones.
    """
    both = matches.select(*PAIR, F.lit(1).alias("p"), F.lit(0).alias("t")).unionByName(truth.select(*PAIR, F.lit(0).alias("p"), F.lit(1).alias("t")))
    pairs = both.groupBy(*PAIR).agg(F.max("p").alias("p"), F.max("t").alias("t"))
    counts = pairs.groupBy("s1_id").agg(F.sum("p").alias("n_pred"), F.sum("t").alias("n_true"), F.sum(F.col("p") * F.col("t")).alias("tp"))
    zero = {c: F.coalesce(c, F.lit(0)).cast("long") for c in ("n_pred", "n_true", "tp")}
    out = queries.join(counts, "s1_id", "left").withColumns(zero)
    return out.withColumn("f05", f05(F.col("tp"), F.col("n_pred"), F.col("n_true")))


def macro_f05(per_query: DataFrame, by: str | None = None) -> DataFrame:
    """Macro F0.5 with counts, singleton share and micro precision and recall; with ``by`` for each group and for all."""
    measures = [
        F.count(F.lit(1)).alias("entities"), F.avg("f05").alias("macro_f05"), F.avg((F.col("n_true") == 0).cast("double")).alias("singleton_share"),
        F.try_divide(F.sum("tp").cast("double"), F.sum("n_pred")).alias("pair_precision"), F.try_divide(F.sum("tp").cast("double"), F.sum("n_true")).alias("pair_recall"),
        F.avg("n_pred").alias("pred_per_s1"),
    ]
    return per_query.rollup(by).agg(*measures).withColumn(by, F.coalesce(by, F.lit("ALL"))) if by else per_query.agg(*measures)


def threshold_search(preds: DataFrame, queries: DataFrame, truth: DataFrame, grid: Sequence[int] = GRID) -> DataFrame:
    """Macro F0.5 at every threshold (in hundredths), from one pass over the one-to-one pairs.

    As the threshold falls, a query's F0.5 only changes where one of its pairs comes in. Each pair yields that change,
    the changes are summed by the greatest threshold that lets the pair in, and running sums over the grid's few rows
    give all scores; pairs are not multiplied by thresholds.
    """
    kept = one_to_one(preds)
    marked = kept.select(*PAIR, "prob").join(truth.select(*PAIR, F.lit(1).alias("hit")).distinct(), PAIR, "left").withColumn("hit", F.coalesce("hit", F.lit(0)))
    n_true = truth.select(*PAIR).distinct().groupBy("s1_id").agg(F.count(F.lit(1)).alias("n_true"))
    everyone = queries.select("s1_id").join(n_true, "s1_id", "left").select("s1_id", F.coalesce("n_true", F.lit(0)).alias("n_true"))
    start, step = grid[0], grid[1] - grid[0]
    level = F.floor((F.col("prob") * 100 - start) / step + 1e-9).cast("int")
    seen = W.partitionBy("s1_id").orderBy(F.desc("prob"), "cand_id").rowsBetween(W.unboundedPreceding, 0)
    steps = marked.join(everyone, "s1_id").select(F.least(level, F.lit(len(grid) - 1)).alias("level"), "n_true", "hit", F.count(F.lit(1)).over(seen).alias("n"), F.sum("hit").over(seen).alias("tp"))
    after = f05(F.col("tp"), F.col("n"), F.col("n_true"))
    before = f05(F.col("tp") - F.col("hit"), F.col("n") - 1, F.col("n_true"))
    changes = steps.where("level >= 0").groupBy("level").agg(F.sum(after - before).alias("change"))
    base = everyone.agg(F.sum(f05(F.lit(0), F.lit(0), F.col("n_true"))).alias("base"), F.count(F.lit(1)).alias("n")).first()
    spark = preds.sparkSession
    levels = spark.createDataFrame([(i, t) for i, t in enumerate(grid)], "level int, threshold_pct int").join(changes, "level", "left")
    down = W.orderBy(F.desc("level")).rowsBetween(W.unboundedPreceding, 0)  # as many rows as thresholds
    total = F.sum(F.coalesce("change", F.lit(0.0))).over(down)
    return levels.select("threshold_pct", ((total + F.lit(float(base.base or 0))) / F.lit(float(max(base.n, 1)))).alias("macro_f05"))


def best_threshold(scores: DataFrame) -> DataFrame:
    """The threshold with the best macro F0.5; ties go to the smallest."""
    return scores.orderBy(F.desc(F.round("macro_f05", 12)), "threshold_pct").limit(1)


def subset_check(predicted: DataFrame, candidates: DataFrame) -> DataFrame:
    """Predicted pairs that are no candidates."""
    return predicted.select(*PAIR).join(candidates.select(*PAIR), PAIR, "left_anti")
