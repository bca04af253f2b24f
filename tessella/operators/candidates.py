"""Candidate pairs: keys, blocks, rare n-grams, exact cosine, and the union of passes."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

PAIR = ["s1_id", "cand_id"]


def chain_counts(records: DataFrame) -> DataFrame:
    """How many records of a country share a name."""
    return records.groupBy("country", "name").agg(F.count(F.lit(1)).alias("chain_n"))


def p3_keys(records: DataFrame, min_letters: int = 4) -> DataFrame:
    """Address keys: ``S|house|state`` and ``T|house|token`` for name tokens of letters only; distinct, without records lacking a house."""
    r = records.where("house IS NOT NULL AND house <> ''")
    state = F.when(F.col("state") != "", F.array(F.concat_ws("|", F.lit("S"), "house", "state")))
    long = F.filter(F.split("name", " "), lambda t: t.rlike(rf"^\p{{L}}{{{min_letters},}}$"))
    tokens = F.transform(long, lambda t: F.concat_ws("|", F.lit("T"), F.col("house"), t))
    none = F.array().cast("array<string>")
    keys = F.array_distinct(F.concat(F.coalesce(state, none), F.coalesce(tokens, none)))
    return r.select("entity_id", "country", F.explode(keys).alias("key"))


def block_stats(keys: DataFrame, max_block: int) -> DataFrame:
    """Blocks, those that are too large, and their rows."""
    sizes = keys.groupBy("country", "key").agg(F.count(F.lit(1)).alias("n"))
    large = F.col("n") > max_block
    return sizes.agg(F.count(F.lit(1)).alias("blocks"), F.count_if(large).alias("dropped_blocks"), F.sum(F.when(large, F.col("n")).otherwise(0)).alias("dropped_rows"), F.max("n").alias("largest"))


def p3_key_join(query_keys: DataFrame, pool_keys: DataFrame, max_block: int) -> DataFrame:
    """Distinct pairs of the same country and key, without blocks of more than ``max_block`` pool rows.

    The pool is first cut to keys that a query has, then to small blocks, so the join's output is bounded by max_block
    rows for each query key.
    """
    wanted = pool_keys.join(query_keys.select("country", "key").distinct(), ["country", "key"], "left_semi")
    sizes = wanted.groupBy("country", "key").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") <= max_block).select("country", "key")
    small = wanted.join(sizes, ["country", "key"]).select("country", "key", F.col("entity_id").alias("cand_id"))
    return query_keys.select("country", "key", F.col("entity_id").alias("s1_id")).join(small, ["country", "key"]).select("country", *PAIR).distinct()


def char_ngrams(records: DataFrame, text: Column, low: int = 3, high: int = 5) -> DataFrame:
    """(entity_id, country, gram, tf): substrings of low to high characters of each word padded with a blank on both sides."""
    padded = F.transform(F.filter(F.split(F.trim(text), r"\s+"), lambda w: w != ""), lambda w: F.concat(F.lit(" "), w, F.lit(" ")))
    grams = lambda w: F.flatten(F.transform(
        F.filter(F.array(*[F.lit(n) for n in range(low, high + 1)]), lambda n: n <= F.length(w)),
        lambda n: F.transform(F.sequence(F.lit(1), F.length(w) - n + 1), lambda i: F.substring(w, i, n)),
    ))
    return records.select("entity_id", "country", F.explode(F.flatten(F.transform(padded, grams))).alias("gram")).groupBy("entity_id", "country", "gram").agg(F.count(F.lit(1)).alias("tf"))


def name_text() -> Column:
    """The text of the name pass: the core name, its glued spelling where that differs, and the domain's stem."""
    glued = F.when(F.col("name_nospace") != F.col("name_core"), F.col("name_nospace"))
    return F.concat_ws(" ", "name_core", glued, "name_domain_stem")


def gram_df(postings: DataFrame) -> DataFrame:
    """How many records of a country hold a gram."""
    return postings.groupBy("country", "gram").agg(F.count(F.lit(1)).alias("df"))


def tfidf(postings: DataFrame, cap: float = 0.005, least: int = 20, idf_from: DataFrame | None = None) -> DataFrame:
    """Postings with ``w`` (L2-normalised tf * idf, idf = ln((1 + N) / (1 + df)) + 1) and ``rare`` (df within cap * N, or within ``least``).

    With ``idf_from`` the df and N of other postings are used; a gram they don't have has df 0. ``postings`` are read three times:
    give a written table where they are costly.
    """
    known = postings if idf_from is None else idf_from
    n = known.groupBy("country", "entity_id").agg(F.lit(1).alias("one")).groupBy("country").agg(F.count(F.lit(1)).alias("n_docs"))
    df = F.coalesce("df", F.lit(0))
    joined = postings.join(gram_df(known), ["country", "gram"], "inner" if idf_from is None else "left").join(F.broadcast(n), "country")  # a row for each country
    x = F.col("tf") * (F.log((1 + F.col("n_docs")) / (1 + df)) + 1)
    raw = joined.select("entity_id", "country", "gram", x.alias("x"), (df <= F.greatest(F.lit(cap) * F.col("n_docs"), F.lit(least))).alias("rare"))
    norm = F.sqrt(F.sum(F.col("x") * F.col("x")).over(W.partitionBy("entity_id")))
    return raw.select("entity_id", "country", "gram", (F.col("x") / F.when(norm > 0, norm).otherwise(1.0)).alias("w"), "rare")


def rare_gram_scores(queries: DataFrame, pool: DataFrame) -> DataFrame:
    """Scores of all pairs of a country that share a rare gram: an inverted-index join whose output the cap on df bounds."""
    q = queries.where("rare").select("country", "gram", F.col("entity_id").alias("s1_id"), F.col("w").alias("wq"))
    p = pool.where("rare").select("country", "gram", F.col("entity_id").alias("cand_id"), F.col("w").alias("wp"))
    return q.join(p, ["country", "gram"]).groupBy("country", *PAIR).agg(F.sum(F.col("wq") * F.col("wp")).alias("score"))


def top(scores: DataFrame, by: str, other: str, k: int, score: str = "score", rank: str = "rank") -> DataFrame:
    """The ``k`` best rows for each ``by``; scores equal to nine decimals are ranked by the other id."""
    order = W.partitionBy(by).orderBy(F.desc(F.round(score, 9)), other)
    return scores.withColumn(rank, F.row_number().over(order)).where(F.col(rank) <= k)


def exact_cosine(pairs: DataFrame, queries: DataFrame, pool: DataFrame) -> DataFrame:
    """Pairs with the cosine over all grams; 0 for pairs that share none."""
    q = queries.select(F.col("entity_id").alias("s1_id"), "gram", F.col("w").alias("wq"))
    p = pool.select(F.col("entity_id").alias("cand_id"), "gram", F.col("w").alias("wp"))
    shared = pairs.select(*PAIR).join(q, "s1_id").join(p, ["cand_id", "gram"]).groupBy(*PAIR).agg(F.sum(F.col("wq") * F.col("wp")).alias("cosine"))
    return pairs.join(shared, PAIR, "left").withColumn("cosine", F.coalesce("cosine", F.lit(0.0)))


def retrieve(queries: DataFrame, pool: DataFrame, m: int, k: int) -> DataFrame:
    """The ``m`` best by rare grams for each query, ranked again by exact cosine, of which ``k`` stay."""
    near = top(rare_gram_scores(queries, pool), "s1_id", "cand_id", m).drop("rank", "score")
    return top(exact_cosine(near, queries, pool), "s1_id", "cand_id", k, score="cosine")


def reverse_retrieve(queries: DataFrame, pool: DataFrame, m: int, k: int) -> DataFrame:
    """The same from the side of the pool: for each pool row the nearest queries."""
    near = top(rare_gram_scores(queries, pool), "cand_id", "s1_id", m).drop("rank", "score")
    return top(exact_cosine(near, queries, pool), "cand_id", "s1_id", k, score="cosine", rank="rank_rev")


def candidate_union(p1: DataFrame, p2: DataFrame, p3: DataFrame, p4: DataFrame, known: Sequence[str] = ()) -> DataFrame:
    """One row for each pair of any pass with its ranks and a flag for each pass: one union and one aggregation in place of three outer joins.

    ``known``: cosines that passes have computed, null where none of a pair's has.
    """
    kinds = {"p1_rank": "int", "p2_rank": "int", "p1_rank_rev": "int", "in_p3": "boolean", **dict.fromkeys(known, "double")}

    def part(df: DataFrame, *given: str) -> DataFrame:
        return df.select(*PAIR, *[(F.lit(True) if c == "in_p3" and c in given else F.col(c) if c in given or c in known and c in df.columns else F.lit(None)).cast(t).alias(c) for c, t in kinds.items()])

    every = [part(p1, "p1_rank"), part(p2, "p2_rank"), part(p3, "in_p3"), part(p4, "p1_rank_rev")]
    rows = every[0].unionByName(every[1]).unionByName(every[2]).unionByName(every[3])
    g = rows.groupBy(*PAIR).agg(*[F.max(c).alias(c) for c in kinds])
    return g.select(
        *PAIR, F.col("p1_rank").isNotNull().alias("in_p1"), F.col("p2_rank").isNotNull().alias("in_p2"), F.coalesce("in_p3", F.lit(False)).alias("in_p3"),
        F.col("p1_rank_rev").isNotNull().alias("in_p4"), "p1_rank", "p2_rank", "p1_rank_rev", *known,
    )


def p4_cap(cands: DataFrame, k4: int, cap: int) -> DataFrame:
    """Pairs of the reverse pass (rank within ``k4``), at most ``cap`` for each query by p1_cos; ties go to the smaller candidate id."""
    order = W.partitionBy("s1_id").orderBy(F.desc("p1_cos"), "cand_id")
    return cands.where(F.col("p1_rank_rev") <= k4).withColumn("p4_pos", F.row_number().over(order)).where(F.col("p4_pos") <= cap)


def select_k(cands: DataFrame, k1: int, k2: int, k4: int, cap: int, p3: bool = True) -> DataFrame:
    """Pairs within a forward rank, with a key, or within the capped reverse pass; one window, no join."""
    reverse = F.coalesce(F.col("p1_rank_rev") <= k4, F.lit(False))
    order = W.partitionBy("s1_id").orderBy(F.when(reverse, F.col("p1_cos")).desc_nulls_last(), "cand_id")
    kept = reverse & (F.row_number().over(order) <= cap)
    inside = [F.coalesce(F.col("p1_rank") <= k1, F.lit(False)), F.coalesce(F.col("p2_rank") <= k2, F.lit(False)), F.col("in_p3") & F.lit(p3)]
    marked = cands.withColumns({"_fwd": inside[0] | inside[1] | inside[2], "_rev": kept})
    return marked.where("_fwd OR _rev").drop("_fwd", "_rev")
