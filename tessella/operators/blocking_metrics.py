"""What a set of candidates can still achieve, and what it costs."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce
from itertools import product
from operator import or_

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

PAIR = ["s1_id", "cand_id"]


def found_truth(cands: DataFrame, truth: DataFrame) -> DataFrame:
    """``truth`` with a flag ``found``; duplicate candidates don't count twice."""
    hits = cands.select(*PAIR).distinct().withColumn("found", F.lit(True))
    return truth.join(hits, PAIR, "left").withColumn("found", F.coalesce("found", F.lit(False)))


def blocking_recall(cands: DataFrame, truth: DataFrame, by: str | None = None) -> DataFrame:
    """Share of true pairs found, and of entities all of whose pairs are found; with ``by`` each group and all of them."""
    keys = [by, "s1_id"] if by else ["s1_id"]
    entities = found_truth(cands, truth).groupBy(*keys).agg(F.count(F.lit(1)).alias("n"), F.sum(F.col("found").cast("long")).alias("k"))
    measures = [
        F.sum("n").alias("true_pairs"), F.try_divide(F.sum("k").cast("double"), F.sum("n")).alias("pair_recall"),
        F.count(F.lit(1)).alias("entities"), F.avg((F.col("n") == F.col("k")).cast("double")).alias("all_found_recall"),
    ]
    return entities.rollup(by).agg(*measures).withColumn(by, F.coalesce(by, F.lit("ALL"))) if by else entities.agg(*measures)


def oracle_f05(cands: DataFrame, queries: DataFrame, truth: DataFrame, by: str) -> DataFrame:
    """Macro F0.5 of a matcher that never errs on these candidates: precision 1, recall limited by blocking."""
    counts = found_truth(cands, truth).groupBy("s1_id").agg(F.count(F.lit(1)).alias("n"), F.sum(F.col("found").cast("double")).alias("k"))
    r = F.col("k") / F.col("n")
    best = F.when(F.col("n").isNull(), 1.0).when(F.col("k") == 0, 0.0).otherwise(1.25 * r / (0.25 + r))
    each = queries.join(counts, "s1_id", "left").select(by, best.alias("f"))
    return each.rollup(by).agg(F.count(F.lit(1)).alias("entities"), F.avg("f").alias("oracle_f05")).withColumn(by, F.coalesce(by, F.lit("ALL")))


def cand_stats(cands: DataFrame, queries: DataFrame) -> DataFrame:
    """Candidates for each query, queries without any included."""
    n = cands.select(*PAIR).distinct().groupBy("s1_id").agg(F.count(F.lit(1)).alias("n"))
    each = queries.select("s1_id").join(n, "s1_id", "left").select(F.coalesce("n", F.lit(0)).alias("n"))
    middle = lambda q: F.expr(f"percentile_disc({q}) WITHIN GROUP (ORDER BY n)").cast("long")
    return each.agg(F.sum("n").alias("pairs"), F.avg("n").alias("mean"), middle(0.5).alias("p50"), middle(0.95).alias("p95"), F.max("n").alias("max"))


def recall_at_k(cands: DataFrame, ks: Sequence[int], rank: str = "p1_rank") -> DataFrame:
    """Share of the true pairs (``is_true``) that have a rank of at most k, for each k, in one aggregation."""
    true = F.col("is_true").cast("long")
    row = cands.agg(F.sum(true).alias("n"), *[F.sum(F.when(F.col(rank) <= k, true).otherwise(0)).alias(f"k{k}") for k in ks])
    each = F.explode(F.array(*[F.struct(F.lit(k).alias("k"), F.col(f"k{k}").alias("found")) for k in ks]))
    return row.select("n", each.alias("x")).select("x.k", "x.found", F.try_divide(F.col("x.found").cast("double"), F.col("n")).alias("recall"))


def selected(k1: int, k2: int, k4: int, p3: bool) -> Column:
    """Whether a candidate stays under a budget: by rank in the passes, or by a key if ``p3``; null ranks never do."""
    parts = [F.coalesce(F.col(c) <= k, F.lit(False)) for c, k in (("p1_rank", k1), ("p2_rank", k2), ("p1_rank_rev", k4)) if k]
    return reduce(or_, [*parts, F.col("in_p3")] if p3 else parts)


def budget_grid(cands: DataFrame, n_queries: int, k1s: Sequence[int], k2s: Sequence[int], k4s: Sequence[int], p3s: Sequence[bool]) -> DataFrame:
    """mean_cands and recall of every combination of budgets, counted side by side in one pass over the candidates."""
    combos = list(product(k1s, k2s, k4s, p3s))
    true = F.col("is_true")
    row = cands.agg(
        F.count_if(true).alias("n"),
        *[F.count_if(selected(*c)).alias(f"c{i}") for i, c in enumerate(combos)],
        *[F.count_if(selected(*c) & true).alias(f"t{i}") for i, c in enumerate(combos)],
    )
    each = F.explode(F.array(*[
        F.struct(F.lit(a).alias("k1"), F.lit(b).alias("k2"), F.lit(c).alias("k4"), F.lit(d).alias("p3"), F.col(f"c{i}").alias("c"), F.col(f"t{i}").alias("t"))
        for i, (a, b, c, d) in enumerate(combos)
    ]))
    return row.select("n", each.alias("x")).select("x.k1", "x.k2", "x.k4", "x.p3", (F.col("x.c") / F.lit(float(n_queries))).alias("mean_cands"), F.try_divide(F.col("x.t").cast("double"), F.col("n")).alias("recall"))


def pareto_frontier(grid: DataFrame) -> DataFrame:
    """The budgets that no cheaper or equally cheap one beats or equals in recall."""
    cheaper = W.orderBy("mean_cands", F.desc("recall"), "k1", "k2", "k4", "p3").rowsBetween(W.unboundedPreceding, -1)  # a row for each budget
    return grid.withColumn("_best", F.max("recall").over(cheaper)).where("_best IS NULL OR recall > _best").drop("_best")


def marginal_contribution(cands: DataFrame) -> DataFrame:
    """For each pass the true pairs it finds, and those that it alone finds."""
    flags = {"p1": F.col("p1_rank").isNotNull(), "p2": F.col("p2_rank").isNotNull(), "p3": F.col("in_p3"), "p4": F.col("p1_rank_rev").isNotNull()}
    total = sum((f.cast("int") for f in flags.values()), F.lit(0))
    true = cands.where("is_true").select(*[f.alias(p) for p, f in flags.items()], total.alias("passes"))
    row = true.agg(*[F.count_if(F.col(p)).alias(f"{p}_found") for p in flags], *[F.count_if(F.col(p) & (F.col("passes") == 1)).alias(f"{p}_only") for p in flags])
    each = F.explode(F.array(*[F.struct(F.lit(p).alias("pass"), F.col(f"{p}_found").alias("found"), F.col(f"{p}_only").alias("only")) for p in flags]))
    return row.select(each.alias("x")).select("x.*")


def missed_pairs(cands: DataFrame, truth: DataFrame) -> DataFrame:
    return truth.join(cands.select(*PAIR), PAIR, "left_anti")
