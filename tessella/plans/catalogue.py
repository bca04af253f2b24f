"""Registered queries of the record-linkage engine and DuckDB SQL that gives the same rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessella.functions import similarity
from tessella.functions import text as T
from tessella.functions.fold import unicode_fold
from tessella.operators import blocking_metrics as B
from tessella.operators import candidates as C
from tessella.operators import cleaning, evaluation, features, lookup, model, ordering, profile, quality, reports, sampling, vectors
from tessella.operators import decision as D
from tessella.sources import files, tables
from tessella.sources.stored import alone
from tessella.sources.stored import written as stored

from .views import duck, table, view

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}
THRESHOLD = 0.3
KS = [5, 10, 20, 50, 100, 200]
GRID = ([20, 30, 50, 100], [0, 5, 10, 20], [0, 3, 5, 10], [False, True])
RARE = (0.005, 20)
#: Of the reference: rows that the exact cosine may reorder, and those that stay, for each pass.
M1, M2, M4 = 300, 300, 100
K1, K2, K4 = features.K1, features.K2, features.K4
P4_CAP, P3_BLOCK = 100, 20
WORD_SQL = r"regexp_extract_all({}, '[^ \t\n\r]+')"


def query(name: str, sql: str | None = None):
    """Registers a query and, if given, its SQL."""

    def add(f: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
        QUERIES[name] = f
        if sql:
            ORACLE_SQL[name] = sql
        return f

    return add


def rounded(df: DataFrame, digits: int = 6) -> DataFrame:
    return df.select(*[F.round(c, digits).alias(c) if kind in ("double", "float") else F.col(c) for c, kind in df.dtypes])


# ------------------------------------------------------------------------------------------------ decisions

MATCHES = f"""matches AS (
    SELECT s1_id, cand_id, prob, country FROM (SELECT *, row_number() OVER (PARTITION BY cand_id ORDER BY prob DESC, s1_id) AS r FROM pairs WHERE prob >= {THRESHOLD}) WHERE r = 1
), per AS (
    SELECT q.s1_id, q.country, coalesce(p.n, 0) AS n_pred, coalesce(t.n, 0) AS n_true, coalesce(h.n, 0) AS tp FROM asked q
    LEFT JOIN (SELECT s1_id, count(*) AS n FROM matches GROUP BY 1) p USING (s1_id) LEFT JOIN (SELECT s1_id, count(*) AS n FROM truth GROUP BY 1) t USING (s1_id)
    LEFT JOIN (SELECT m.s1_id, count(*) AS n FROM matches m JOIN truth t ON m.s1_id = t.s1_id AND m.cand_id = t.cand_id GROUP BY 1) h USING (s1_id)
), scored AS (
    SELECT *, CASE WHEN n_true = 0 THEN CASE WHEN n_pred = 0 THEN 1.0 ELSE 0.0 END WHEN tp = 0 THEN 0.0
              ELSE 1.25 * (tp / n_pred) * (tp / n_true) / (0.25 * (tp / n_pred) + tp / n_true) END AS f05 FROM per
)"""


def _per_s1(spark: SparkSession, sf: str) -> DataFrame:
    preds = view(spark, sf, "pairs").select("s1_id", "cand_id", "prob")
    return D.per_s1_f05(D.decide(preds, THRESHOLD), view(spark, sf, "asked"), view(spark, sf, "truth"))


@query("one_to_one", duck("pairs") + "SELECT s1_id, cand_id, prob FROM (SELECT *, row_number() OVER (PARTITION BY cand_id ORDER BY prob DESC, s1_id) AS r FROM pairs) WHERE r = 1")
def one_to_one(spark: SparkSession, sf: str) -> DataFrame:
    return D.one_to_one(view(spark, sf, "pairs").select("s1_id", "cand_id", "prob"))


@query("decide", duck("pairs") + f"SELECT s1_id, cand_id, prob FROM (SELECT *, row_number() OVER (PARTITION BY cand_id ORDER BY prob DESC, s1_id) AS r FROM pairs WHERE prob >= {THRESHOLD}) WHERE r = 1")
def decide(spark: SparkSession, sf: str) -> DataFrame:
    return D.decide(view(spark, sf, "pairs").select("s1_id", "cand_id", "prob"), THRESHOLD)


@query("per_s1_f05", duck("pairs", "truth", "asked") + ", " + MATCHES + " SELECT s1_id, country, n_pred, n_true, tp, round(f05, 6) AS f05 FROM scored")
def per_s1_f05(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(_per_s1(spark, sf))


@query(
    "macro_f05",
    duck("pairs", "truth", "asked") + ", " + MATCHES
    + """ SELECT coalesce(country, 'ALL') AS country, count(*) AS entities, round(avg(f05), 6) AS macro_f05, round(avg(CASE WHEN n_true = 0 THEN 1.0 ELSE 0.0 END), 6) AS singleton_share,
    round(sum(tp) / sum(n_pred), 6) AS pair_precision, round(sum(tp) / sum(n_true), 6) AS pair_recall, round(avg(n_pred), 6) AS pred_per_s1 FROM scored GROUP BY ROLLUP (country)""",
)
def macro_f05(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(D.macro_f05(_per_s1(spark, sf), "country"))


SEARCH = """, kept AS (
    SELECT s1_id, cand_id, prob FROM (SELECT *, row_number() OVER (PARTITION BY cand_id ORDER BY prob DESC, s1_id) AS r FROM pairs) WHERE r = 1
), grid AS (SELECT unnest(range(10, 99, 2)) AS t), n AS (SELECT s1_id, count(*) AS n_true FROM truth GROUP BY 1),
hits AS (SELECT k.s1_id, k.prob, CASE WHEN t.cand_id IS NULL THEN 0 ELSE 1 END AS hit FROM kept k LEFT JOIN truth t ON k.s1_id = t.s1_id AND k.cand_id = t.cand_id),
c AS (SELECT t, s1_id, count(*) AS n_pred, sum(hit) AS tp FROM grid JOIN hits ON prob * 100 >= t - 1e-7 GROUP BY 1, 2),
s AS (SELECT g.t, q.s1_id, coalesce(n_pred, 0) AS n_pred, coalesce(tp, 0) AS tp, coalesce(n_true, 0) AS n_true FROM grid g CROSS JOIN asked q LEFT JOIN c ON c.t = g.t AND c.s1_id = q.s1_id LEFT JOIN n ON n.s1_id = q.s1_id),
f AS (SELECT t, avg(CASE WHEN n_true = 0 THEN CASE WHEN n_pred = 0 THEN 1.0 ELSE 0.0 END WHEN tp = 0 THEN 0.0
              ELSE 1.25 * (tp / n_pred) * (tp / n_true) / (0.25 * (tp / n_pred) + tp / n_true) END) AS macro_f05 FROM s GROUP BY t)
"""


def _search(spark: SparkSession, sf: str) -> DataFrame:
    return D.threshold_search(view(spark, sf, "pairs").select("s1_id", "cand_id", "prob"), view(spark, sf, "asked"), view(spark, sf, "truth"))


@query("threshold_search", duck("pairs", "truth", "asked") + SEARCH + "SELECT CAST(t AS INTEGER) AS threshold_pct, round(macro_f05, 6) AS macro_f05 FROM f")
def threshold_search(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(_search(spark, sf))


@query("best_threshold", duck("pairs", "truth", "asked") + SEARCH + "SELECT CAST(t AS INTEGER) AS threshold_pct, round(macro_f05, 6) AS macro_f05 FROM f ORDER BY round(f.macro_f05, 12) DESC, t LIMIT 1")
def best_threshold(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(D.best_threshold(_search(spark, sf)))


@query("subset_check", duck("pairs") + "SELECT s1_id, cand_id FROM pairs WHERE prob >= 0.5 AND NOT (p1_rank IS NOT NULL)")
def subset_check(spark: SparkSession, sf: str) -> DataFrame:
    p = view(spark, sf, "pairs")
    return D.subset_check(p.where("prob >= 0.5"), p.where("p1_rank IS NOT NULL"))


# ------------------------------------------------------------------------------------------------ candidates and recall

SELECTED = f"""sel AS (
    SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY s1_id ORDER BY CASE WHEN p1_rank_rev <= {K4} THEN p1_cos END DESC NULLS LAST, cand_id) AS r FROM pairs)
    WHERE coalesce(p1_rank <= {K1}, false) OR coalesce(p2_rank <= {K2}, false) OR in_p3 OR (coalesce(p1_rank_rev <= {K4}, false) AND r <= {P4_CAP})
)"""


def _selected(spark: SparkSession, sf: str) -> DataFrame:
    return C.select_k(view(spark, sf, "pairs"), K1, K2, K4, P4_CAP)


@query("candidate_union", duck("pairs") + """SELECT s1_id, cand_id, p1_rank IS NOT NULL AS in_p1, p2_rank IS NOT NULL AS in_p2, in_p3, p1_rank_rev IS NOT NULL AS in_p4, coalesce(p1_rank, 0) AS p1_rank, coalesce(p2_rank, 0) AS p2_rank, coalesce(p1_rank_rev, 0) AS p1_rank_rev
    FROM pairs WHERE p1_rank IS NOT NULL OR p2_rank IS NOT NULL OR in_p3 OR p1_rank_rev IS NOT NULL""")
def candidate_union(spark: SparkSession, sf: str) -> DataFrame:
    p = view(spark, sf, "pairs")
    found = C.candidate_union(*[p.where(c) for c in ("p1_rank IS NOT NULL", "p2_rank IS NOT NULL", "in_p3", "p1_rank_rev IS NOT NULL")])
    return found.na.fill(0, ["p1_rank", "p2_rank", "p1_rank_rev"])


@query("select_k", duck("pairs") + ", " + SELECTED + " SELECT s1_id, cand_id, coalesce(p1_rank, 0) AS p1_rank, coalesce(p2_rank, 0) AS p2_rank, coalesce(p1_rank_rev, 0) AS p1_rank_rev, in_p3 FROM sel")
def select_k(spark: SparkSession, sf: str) -> DataFrame:
    return _selected(spark, sf).select("s1_id", "cand_id", "p1_rank", "p2_rank", "p1_rank_rev", "in_p3").na.fill(0)


@query("p4_cap", duck("pairs") + f"""SELECT s1_id, cand_id, CAST(p AS INTEGER) AS p4_pos FROM (
    SELECT *, row_number() OVER (PARTITION BY s1_id ORDER BY p1_cos DESC, cand_id) AS p FROM pairs WHERE p1_rank_rev <= {K4}) WHERE p <= {P4_CAP}""")
def p4_cap(spark: SparkSession, sf: str) -> DataFrame:
    return C.p4_cap(view(spark, sf, "pairs"), K4, P4_CAP).select("s1_id", "cand_id", "p4_pos")


@query("cand_stats", duck("pairs", "asked") + ", " + SELECTED + """, n AS (SELECT q.s1_id, count(s.cand_id) AS n FROM asked q LEFT JOIN sel s USING (s1_id) GROUP BY 1)
    SELECT CAST(sum(n) AS BIGINT) AS pairs, round(avg(n), 6) AS mean, CAST(quantile_disc(n, 0.5) AS BIGINT) AS p50, CAST(quantile_disc(n, 0.95) AS BIGINT) AS p95, max(n) AS max FROM n""")
def cand_stats(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(B.cand_stats(_selected(spark, sf), view(spark, sf, "asked")))


RECALL = ", " + SELECTED + """, e AS (SELECT t.country, t.s1_id, count(*) AS n, count(s.cand_id) AS k FROM truth t LEFT JOIN sel s ON s.s1_id = t.s1_id AND s.cand_id = t.cand_id GROUP BY 1, 2)
    SELECT {} CAST(sum(n) AS BIGINT) AS true_pairs, round(sum(k) / sum(n), 6) AS pair_recall, count(*) AS entities, round(avg(CASE WHEN n = k THEN 1.0 ELSE 0.0 END), 6) AS all_found_recall FROM e {}"""


@query("blocking_recall", duck("pairs", "truth") + RECALL.format("", ""))
def blocking_recall(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(B.blocking_recall(_selected(spark, sf), view(spark, sf, "truth")))


@query("recall_by_country_rollup", duck("pairs", "truth") + RECALL.format("coalesce(country, 'ALL') AS country,", "GROUP BY ROLLUP (country)"))
def recall_by_country_rollup(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(B.blocking_recall(_selected(spark, sf), view(spark, sf, "truth"), "country"))


@query("recall_at_k", duck("pairs") + f"""SELECT CAST(k AS INTEGER) AS k, CAST(sum(CASE WHEN p1_rank <= k THEN 1 ELSE 0 END) AS BIGINT) AS found, round(sum(CASE WHEN p1_rank <= k THEN 1 ELSE 0 END) / count(*), 6) AS recall
    FROM pairs CROSS JOIN (SELECT unnest({KS}) AS k) WHERE is_true GROUP BY k""")
def recall_at_k(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(B.recall_at_k(view(spark, sf, "pairs"), KS))


@query("oracle_f05", duck("pairs", "truth", "asked") + ", " + SELECTED + """, e AS (SELECT t.s1_id, count(*) AS n, count(s.cand_id) AS k FROM truth t LEFT JOIN sel s ON s.s1_id = t.s1_id AND s.cand_id = t.cand_id GROUP BY 1)
    SELECT coalesce(q.country, 'ALL') AS country, count(*) AS entities, round(avg(CASE WHEN n IS NULL THEN 1.0 WHEN k = 0 THEN 0.0 ELSE 1.25 * (k / n) / (0.25 + k / n) END), 6) AS oracle_f05
    FROM asked q LEFT JOIN e USING (s1_id) GROUP BY ROLLUP (q.country)""")
def oracle_f05(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(B.oracle_f05(_selected(spark, sf), view(spark, sf, "asked"), view(spark, sf, "truth"), "country"))


BUDGETS = f""", combos AS (SELECT * FROM (SELECT unnest({GRID[0]}) AS k1), (SELECT unnest({GRID[1]}) AS k2), (SELECT unnest({GRID[2]}) AS k4), (SELECT unnest([false, true]) AS p3)),
chosen AS (SELECT k1, k2, k4, p3, is_true, coalesce(p1_rank <= k1, false) OR coalesce(p2_rank <= k2, false) OR coalesce(p1_rank_rev <= k4, false) OR (p3 AND in_p3) AS c FROM combos CROSS JOIN pairs),
g AS (SELECT CAST(k1 AS INTEGER) AS k1, CAST(k2 AS INTEGER) AS k2, CAST(k4 AS INTEGER) AS k4, p3, sum(CASE WHEN c THEN 1 ELSE 0 END) / (SELECT count(*) FROM asked) AS mean_cands,
      sum(CASE WHEN c AND is_true THEN 1 ELSE 0 END) / sum(CASE WHEN is_true THEN 1 ELSE 0 END) AS recall FROM chosen GROUP BY 1, 2, 3, 4)
"""


def _budgets(spark: SparkSession, sf: str) -> DataFrame:
    return B.budget_grid(view(spark, sf, "pairs"), view(spark, sf, "asked").count(), *GRID)


@query("budget_grid", duck("pairs", "asked") + BUDGETS + "SELECT k1, k2, k4, p3, round(mean_cands, 6) AS mean_cands, round(recall, 6) AS recall FROM g")
def budget_grid(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(_budgets(spark, sf))


@query("pareto_frontier", duck("pairs", "asked") + BUDGETS + """SELECT k1, k2, k4, p3, round(mean_cands, 6) AS mean_cands, round(recall, 6) AS recall FROM (
    SELECT *, max(recall) OVER (ORDER BY mean_cands, recall DESC, k1, k2, k4, p3 ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS b FROM g) WHERE b IS NULL OR recall > b""")
def pareto_frontier(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(B.pareto_frontier(_budgets(spark, sf)))


@query("marginal_contribution", duck("pairs") + """, f AS (SELECT p1_rank IS NOT NULL AS p1, p2_rank IS NOT NULL AS p2, in_p3 AS p3, p1_rank_rev IS NOT NULL AS p4 FROM pairs WHERE is_true),
    c AS (SELECT *, CAST(p1 AS INT) + CAST(p2 AS INT) + CAST(p3 AS INT) + CAST(p4 AS INT) AS n FROM f), u AS (SELECT 'p1' AS pass, p1 AS x, n FROM c UNION ALL SELECT 'p2', p2, n FROM c UNION ALL SELECT 'p3', p3, n FROM c UNION ALL SELECT 'p4', p4, n FROM c)
    SELECT pass, count(*) FILTER (x) AS found, count(*) FILTER (x AND n = 1) AS only FROM u GROUP BY pass""".replace("AS only", 'AS "only"'))
def marginal_contribution(spark: SparkSession, sf: str) -> DataFrame:
    return B.marginal_contribution(view(spark, sf, "pairs"))


@query("missed_pairs", duck("pairs", "truth").replace("pairs AS (", "pairs AS MATERIALIZED (") + ", " + SELECTED.replace("sel AS (", "sel AS MATERIALIZED (") + " SELECT t.s1_id, t.cand_id, t.country FROM truth t ANTI JOIN sel s ON s.s1_id = t.s1_id AND s.cand_id = t.cand_id")
def missed_pairs(spark: SparkSession, sf: str) -> DataFrame:
    return B.missed_pairs(_selected(spark, sf), view(spark, sf, "truth")).select("s1_id", "cand_id", "country")


# ------------------------------------------------------------------------------------------------ blocks

KEYS = """, keys AS (
    SELECT DISTINCT entity_id, country, key FROM (
        SELECT entity_id, country, 'S|' || house || '|' || state AS key FROM chain WHERE state <> ''
        UNION ALL SELECT entity_id, country, 'T|' || house || '|' || tok FROM (SELECT *, unnest(string_split(name, ' ')) AS tok FROM chain) WHERE regexp_matches(tok, '^\\p{L}{4,}$'))
    )"""


def _sides(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame]:
    """Every third part asks, the others are the pool."""
    keys = C.p3_keys(view(spark, sf, "chain"))
    asks = F.col("entity_id").cast("long") % 3 == 0
    return keys.where(asks), keys.where(~asks)


@query("chain_counts", duck("chain") + "SELECT country, name, count(*) AS chain_n FROM chain GROUP BY 1, 2")
def chain_counts(spark: SparkSession, sf: str) -> DataFrame:
    return C.chain_counts(view(spark, sf, "chain"))


@query("p3_keys", duck("chain") + KEYS + " SELECT entity_id, country, key FROM keys")
def p3_keys(spark: SparkSession, sf: str) -> DataFrame:
    return C.p3_keys(view(spark, sf, "chain"))


@query("block_stats", duck("chain") + KEYS + f""", b AS (SELECT country, key, count(*) AS n FROM keys GROUP BY 1, 2)
    SELECT count(*) AS blocks, count(*) FILTER (n > {P3_BLOCK}) AS dropped_blocks, CAST(sum(CASE WHEN n > {P3_BLOCK} THEN n ELSE 0 END) AS BIGINT) AS dropped_rows, max(n) AS largest FROM b""")
def block_stats(spark: SparkSession, sf: str) -> DataFrame:
    return C.block_stats(C.p3_keys(view(spark, sf, "chain")), P3_BLOCK)


@query("p3_key_join", duck("chain") + KEYS + f""", q AS (SELECT * FROM keys WHERE CAST(entity_id AS BIGINT) % 3 = 0), p AS (SELECT *, count(*) OVER (PARTITION BY country, key) AS n FROM keys WHERE CAST(entity_id AS BIGINT) % 3 <> 0)
    SELECT DISTINCT q.country, q.entity_id AS s1_id, p.entity_id AS cand_id FROM q JOIN p ON q.country = p.country AND q.key = p.key WHERE n <= {P3_BLOCK}""")
def p3_key_join(spark: SparkSession, sf: str) -> DataFrame:
    return C.p3_key_join(*_sides(spark, sf), P3_BLOCK)


# ------------------------------------------------------------------------------------------------ n-grams

POSTINGS = """, words AS (SELECT entity_id, country, ' ' || unnest(regexp_extract_all(name || ' ' || address, '[^ \\t\\n\\r]+')) || ' ' AS w FROM rec),
post AS (SELECT entity_id, country, gram, count(*) AS tf FROM (SELECT entity_id, country, substr(w, i, n) AS gram FROM (
    SELECT entity_id, country, w, n, unnest(range(1, length(w) - n + 2)) AS i FROM words CROSS JOIN (SELECT unnest([3, 4, 5]) AS n) WHERE n <= length(w))) GROUP BY 1, 2, 3)"""
WEIGHTS = POSTINGS + f""", nd AS (SELECT country, count(DISTINCT entity_id) AS n FROM post GROUP BY 1), df AS (SELECT country, gram, count(*) AS df FROM post GROUP BY 1, 2),
x AS (SELECT p.entity_id, p.country, p.gram, tf * (ln((1 + n) / (1 + df)) + 1) AS x, df <= greatest({RARE[0]} * n, {RARE[1]}) AS rare FROM post p JOIN df USING (country, gram) JOIN nd USING (country)),
tw AS (SELECT entity_id, country, gram, x / sqrt(sum(x * x) OVER (PARTITION BY entity_id)) AS w, rare FROM x),
sc AS (SELECT q.country, q.entity_id AS s1_id, p.entity_id AS cand_id, sum(q.w * p.w) AS score FROM tw q JOIN tw p ON q.country = p.country AND q.gram = p.gram
       WHERE q.rare AND p.rare AND q.entity_id LIKE 'S1-%' AND p.entity_id NOT LIKE 'S1-%' GROUP BY 1, 2, 3),
"""
COSINES = "ex AS (SELECT n.s1_id, n.cand_id, sum(q.w * p.w) AS cosine FROM near n JOIN tw q ON q.entity_id = n.s1_id JOIN tw p ON p.entity_id = n.cand_id AND p.gram = q.gram GROUP BY 1, 2)"


def _postings(spark: SparkSession, sf: str) -> DataFrame:
    return C.char_ngrams(view(spark, sf, "rec"), F.concat_ws(" ", "name", "address"))


def _grams(spark: SparkSession, sf: str) -> vectors.Grams:
    return vectors.weigh(view(spark, sf, "rec"), F.concat_ws(" ", "name", "address"), *RARE)


def _weighted(spark: SparkSession, sf: str) -> tuple[vectors.Grams, DataFrame, DataFrame]:
    grams = _grams(spark, sf)
    return grams, *grams.sides()


@query("char_ngrams", duck("rec") + POSTINGS + " SELECT entity_id, country, gram, tf FROM post")
def char_ngrams(spark: SparkSession, sf: str) -> DataFrame:
    return _postings(spark, sf)


@query("gram_df", duck("rec") + POSTINGS + " SELECT country, gram, count(*) AS df FROM post GROUP BY 1, 2")
def gram_df(spark: SparkSession, sf: str) -> DataFrame:
    return C.gram_df(_postings(spark, sf))


@query("tfidf_idf", duck("rec") + WEIGHTS[:-2] + " SELECT entity_id, country, gram, round(w, 6) AS w, rare FROM tw")
def tfidf_idf(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(C.tfidf(_postings(spark, sf), *RARE))


@query("rare_gram_retrieval", duck("rec") + WEIGHTS + f"""near AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY s1_id ORDER BY round(score, 9) DESC, cand_id) AS r FROM sc) WHERE r <= {M1}),
    """ + COSINES + f""" SELECT s1_id, cand_id, CAST(r AS INTEGER) AS rank, round(cosine, 6) AS cosine FROM (SELECT *, row_number() OVER (PARTITION BY s1_id ORDER BY round(cosine, 9) DESC, cand_id) AS r FROM ex) WHERE r <= {K1}""")
def rare_gram_retrieval(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(vectors.retrieve(*_weighted(spark, sf), M1, K1).select("s1_id", "cand_id", "rank", "cosine"))


@query("reverse_topk", duck("rec") + WEIGHTS + f"""near AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY cand_id ORDER BY round(score, 9) DESC, s1_id) AS r FROM sc) WHERE r <= {M4}),
    """ + COSINES + f""" SELECT s1_id, cand_id, CAST(r AS INTEGER) AS rank_rev, round(cosine, 6) AS cosine FROM (SELECT *, row_number() OVER (PARTITION BY cand_id ORDER BY round(cosine, 9) DESC, s1_id) AS r FROM ex) WHERE r <= {K4}""")
def reverse_topk(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(vectors.reverse_retrieve(*_weighted(spark, sf), M4, K4).select("s1_id", "cand_id", "rank_rev", "cosine"))


@query("exact_cosine_pairs", duck("rec") + WEIGHTS + """near AS (SELECT a.entity_id AS s1_id, b.entity_id AS cand_id FROM rec a JOIN rec b ON b.doc_id = a.doc_id + 1),
    """ + COSINES + " SELECT n.s1_id, n.cand_id, round(coalesce(cosine, 0.0), 6) AS cosine FROM near n LEFT JOIN ex USING (s1_id, cand_id)")
def exact_cosine_pairs(spark: SparkSession, sf: str) -> DataFrame:
    e = view(spark, sf, "rec").select("entity_id", "doc_id")
    pairs = e.select(F.col("entity_id").alias("s1_id"), (F.col("doc_id") + 1).alias("doc_id")).join(e.withColumnRenamed("entity_id", "cand_id"), "doc_id").select("s1_id", "cand_id")
    grams = _grams(spark, sf)
    return rounded(vectors.exact_cosine(grams, stored(pairs, "pairs"), grams.texts, grams.texts))


def flagship(spark: SparkSession, sf: str) -> DataFrame:
    """Candidate lists by rare n-grams and exact cosine: one row for each query record."""
    found = vectors.retrieve(*_weighted(spark, sf), M1, K1)
    asks = view(spark, sf, "rec").where(F.startswith("entity_id", F.lit("S1-"))).select(F.col("entity_id").alias("s1_id"))
    return tables.list_output(found, asks)


# ------------------------------------------------------------------------------------------------ lookup and splits

ALIGNED = """, al AS (SELECT o_orderpriority AS country, o_orderstatus AS canonical, l_linestatus || l_returnflag AS variant FROM orders JOIN lineitem ON l_orderkey = o_orderkey),
cn AS (SELECT country, variant, canonical, count(*) AS n FROM al GROUP BY 1, 2, 3),
bs AS (SELECT *, n / sum(n) OVER (PARTITION BY country, variant) AS share, row_number() OVER (PARTITION BY country, variant ORDER BY n DESC, canonical) AS r FROM cn),
own AS (SELECT country, canonical AS variant, canonical, count(*) AS n, 1.0 AS share FROM al GROUP BY 1, 2 HAVING count(*) >= 20),
mp AS (SELECT * FROM own UNION ALL SELECT country, variant, canonical, n, share FROM bs WHERE r = 1 AND n >= 20 AND share >= 0.3 AND (country, variant) NOT IN (SELECT (country, variant) FROM own))"""


def _mapping(spark: SparkSession, sf: str) -> DataFrame:
    joined = table(spark, sf, "orders").join(table(spark, sf, "lineitem"), F.col("l_orderkey") == F.col("o_orderkey"))
    aligned = joined.select(F.col("o_orderpriority").alias("country"), F.col("o_orderstatus").alias("canonical"), F.concat("l_linestatus", "l_returnflag").alias("variant"))
    return lookup.learn_mapping(aligned, 20, 0.3)


MD5_SQL = "(({0} * 0 + list_reduce([CAST(('0x' || substr(md5({1}), 8 * k + 1, 8)) AS BIGINT) for k in [0, 1, 2, 3]], lambda a, b: (a % 100 * 4294967296 + b) % 100)) % 100)"


def _md5(c: str) -> str:
    return MD5_SQL.format(0, c)


@query("training_pairs", duck("gt_long") + f"SELECT s1_id, match_id FROM gt_long WHERE match_id IS NOT NULL AND {_md5('s1_id')} >= 20")
def training_pairs(spark: SparkSession, sf: str) -> DataFrame:
    gt = view(spark, sf, "gt_long")
    return lookup.training_pairs(gt, gt.select("s1_id").distinct().where(sampling.is_validation(F.col("s1_id")))).select("s1_id", "match_id")


@query("learn_mapping", "WITH one AS (SELECT 1)" + ALIGNED + " SELECT country, variant, canonical, n, round(share, 6) AS share FROM mp")
def learn_mapping(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(_mapping(spark, sf))


@query("apply_mapping", "WITH one AS (SELECT 1)" + ALIGNED + """ SELECT v.country, v.variant, mp.canonical AS state_canon, count(*) AS n FROM al v LEFT JOIN mp ON mp.country = v.country AND mp.variant = v.variant GROUP BY 1, 2, 3""")
def apply_mapping(spark: SparkSession, sf: str) -> DataFrame:
    joined = table(spark, sf, "orders").join(table(spark, sf, "lineitem"), F.col("l_orderkey") == F.col("o_orderkey"))
    records = joined.select(F.col("o_orderpriority").alias("country"), F.concat("l_linestatus", "l_returnflag").alias("variant"))
    return lookup.apply_mapping(records, _mapping(spark, sf), "variant", "state_canon").groupBy("country", "variant", "state_canon").agg(F.count(F.lit(1)).alias("n"))


@query("md5_split", f"SELECT 'S1-' || c_custkey AS id, CAST({_md5("'S1-' || c_custkey")} AS BIGINT) AS bucket, {_md5("'S1-' || c_custkey")} < 20 AS is_val FROM customer")
def md5_split(spark: SparkSession, sf: str) -> DataFrame:
    ids = table(spark, sf, "customer").select(F.concat(F.lit("S1-"), F.col("c_custkey").cast("string")).alias("id"))
    return ids.select("id", sampling.md5_mod(F.col("id"), 100).alias("bucket"), sampling.is_validation(F.col("id")).alias("is_val"))


@query("hash_sample", "SELECT 'S1-' || c_custkey AS id FROM customer ORDER BY md5('cand_train:S1-' || c_custkey), 1 LIMIT 100")
def hash_sample(spark: SparkSession, sf: str) -> DataFrame:
    return sampling.hash_sample(table(spark, sf, "customer").select(F.concat(F.lit("S1-"), F.col("c_custkey").cast("string")).alias("id")), "id", 100, "cand_train")


@query("split_stats", duck("gt_long") + f""", n AS (SELECT s1_id, count(match_id) AS n FROM gt_long GROUP BY 1) SELECT CASE WHEN {_md5('s1_id')} < 20 THEN 'val' ELSE 'train' END AS split, count(*) AS entities,
    round(avg(CASE WHEN n = 0 THEN 1.0 ELSE 0.0 END), 6) AS singleton_share, round(avg(n), 6) AS mean_matches FROM n GROUP BY 1""")
def split_stats(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(sampling.split_stats(view(spark, sf, "gt_long")))


# ------------------------------------------------------------------------------------------------ files and checks

WIDE = ", wide AS (SELECT s1_id, coalesce(string_agg(match_id, ',' ORDER BY match_id), '') AS ids FROM gt_long GROUP BY 1)"


def _lists(spark: SparkSession, sf: str) -> DataFrame:
    gt = view(spark, sf, "gt_long")
    return tables.list_output(gt.where("match_id IS NOT NULL").withColumnRenamed("match_id", "cand_id"), gt.select("s1_id").distinct())


@query("id_source", duck("ent") + "SELECT entity_id, CAST(substr(entity_id, 2, 1) AS INTEGER) AS source FROM ent")
def id_source(spark: SparkSession, sf: str) -> DataFrame:
    return view(spark, sf, "ent").select("entity_id", quality.id_source(F.col("entity_id")).alias("source"))


@query("list_output", duck("gt_long") + WIDE + " SELECT s1_id, ids FROM wide")
def list_output(spark: SparkSession, sf: str) -> DataFrame:
    return _lists(spark, sf)


@query("gt_explode", duck("gt_long") + "SELECT s1_id, match_id FROM gt_long")
def gt_explode(spark: SparkSession, sf: str) -> DataFrame:
    return tables.truth_long(_lists(spark, sf))


@query("referential_checks", duck("gt_long") + """, p AS (SELECT * FROM gt_long WHERE match_id IS NOT NULL), s AS (SELECT 'S1-' || c_custkey AS s1_id FROM customer), m AS (SELECT 'S' || (2 + o_orderkey % 2) || '-' || o_orderkey AS match_id FROM orders)
    SELECT 'unknown_s1' AS finding, count(*) AS n FROM (SELECT DISTINCT s1_id FROM gt_long) WHERE s1_id NOT IN (SELECT s1_id FROM s) UNION ALL SELECT 'missing_s1', count(*) FROM s WHERE s1_id NOT IN (SELECT s1_id FROM gt_long)
    UNION ALL SELECT 'unknown_match', count(*) FROM p WHERE match_id NOT IN (SELECT match_id FROM m) UNION ALL SELECT 'duplicate_pairs', count(*) FROM (SELECT 1 FROM p GROUP BY s1_id, match_id HAVING count(*) > 1)
    UNION ALL SELECT 'match_in_several', count(*) FROM (SELECT match_id FROM p GROUP BY 1 HAVING count(DISTINCT s1_id) > 1) UNION ALL SELECT 'malformed', count(*) FROM gt_long WHERE NOT regexp_matches(s1_id, '^S[123]-\\d+$') OR NOT regexp_matches(coalesce(match_id, 'S1-1'), '^S[123]-\\d+$')
    UNION ALL SELECT 'matches_s1', count(*) FROM p WHERE match_id LIKE 'S1-%'""")
def referential_checks(spark: SparkSession, sf: str) -> DataFrame:
    s1 = table(spark, sf, "customer").selectExpr("concat('S1-', c_custkey) AS s1_id")
    pool = table(spark, sf, "orders").selectExpr("concat('S', 2 + o_orderkey % 2, '-', o_orderkey) AS match_id")
    return quality.referential_checks(view(spark, sf, "gt_long"), s1, pool)


@query("validate_list_file", """WITH l AS (SELECT 'S' || (1 + p_size % 2) || '-' || p_partkey AS s1_id, 'S2-' || p_size || ',S3-' || (p_partkey % 50) || ',S2-' || p_size || CASE WHEN p_size = 7 THEN ',X9,S1-3' ELSE '' END AS ids FROM part),
    s AS (SELECT 'S1-' || p_partkey AS s1_id FROM part), m AS (SELECT DISTINCT 'S2-' || p_size AS match_id FROM part UNION SELECT DISTINCT 'S3-' || p_size FROM part), e AS (SELECT s1_id, unnest(string_split(ids, ',')) AS match_id FROM l)
    SELECT 'repeated_rows' AS finding, count(*) AS n FROM (SELECT 1 FROM l GROUP BY s1_id HAVING count(*) > 1) UNION ALL SELECT 'missing_s1', count(*) FROM s WHERE s1_id NOT IN (SELECT s1_id FROM l) UNION ALL SELECT 'extra_s1', count(*) FROM l WHERE s1_id NOT IN (SELECT s1_id FROM s)
    UNION ALL SELECT 'malformed_id', count(*) FROM e WHERE NOT regexp_matches(match_id, '^S[123]-\\d+$') UNION ALL SELECT 'wrong_source', count(*) FROM e WHERE match_id LIKE 'S1-%' UNION ALL SELECT 'self_match', count(*) FROM e WHERE match_id = s1_id
    UNION ALL SELECT 'repeated_in_list', count(*) FROM (SELECT 1 FROM e GROUP BY s1_id, match_id HAVING count(*) > 1) UNION ALL SELECT 'unknown_id', count(*) FROM e WHERE regexp_matches(match_id, '^S[123]-\\d+$') AND match_id NOT IN (SELECT match_id FROM m)""")
def validate_list_file(spark: SparkSession, sf: str) -> DataFrame:
    part = table(spark, sf, "part")
    lists = part.selectExpr("concat('S', 1 + p_size % 2, '-', p_partkey) AS s1_id", "concat('S2-', p_size, ',S3-', p_partkey % 50, ',S2-', p_size, CASE WHEN p_size = 7 THEN ',X9,S1-3' ELSE '' END) AS ids")
    pool = part.selectExpr("concat('S2-', p_size) AS match_id").union(part.selectExpr("concat('S3-', p_size) AS match_id")).distinct()
    return quality.validate_lists(lists, part.selectExpr("concat('S1-', p_partkey) AS s1_id"), pool)


@query("duplicate_content", duck("ent") + ", g AS (SELECT name, address, country, count(*) AS n FROM ent GROUP BY 1, 2, 3) SELECT count(*) FILTER (n > 1) AS groups, CAST(coalesce(sum(CASE WHEN n > 1 THEN n END), 0) AS BIGINT) AS rows, max(n) AS largest FROM g".replace("AS groups", 'AS "groups"').replace("AS rows", 'AS "rows"'))
def duplicate_content(spark: SparkSession, sf: str) -> DataFrame:
    return quality.duplicate_content(view(spark, sf, "ent"), ["name", "address", "country"])


@query("integrity_counts", """WITH t AS (SELECT coalesce(text, '') AS c FROM documents) SELECT unnest(['rows', 'empty', 'edge_space', 'double_space', 'literal_null', 'nbsp', 'zero_width', 'control', 'non_ascii', 'mojibake']) AS finding,
    unnest([count(*), count(*) FILTER (c = ''), count(*) FILTER (c <> trim(c)), count(*) FILTER (contains(c, '  ')), count(*) FILTER (lower(trim(c)) IN ('null', 'n/a', 'none', 'nan')), count(*) FILTER (contains(c, chr(160))),
    count(*) FILTER (regexp_matches(c, '[\\x{200b}-\\x{200d}\\x{feff}]')), count(*) FILTER (regexp_matches(c, '[\\x00-\\x08\\x0b\\x0c\\x0e-\\x1f\\x7f]')), count(*) FILTER (regexp_matches(c, '[^\\x00-\\x7F]')), count(*) FILTER (regexp_matches(c, '[Ââ][\\x{80}-\\x{9f}]'))]) AS n FROM t""")
def integrity_counts(spark: SparkSession, sf: str) -> DataFrame:
    return quality.integrity(table(spark, sf, "documents"), "text")


@query("raw_line_checks", """WITH l AS (SELECT unnest(string_split(coalesce(text, ''), chr(10))) AS value FROM documents) SELECT unnest(['lines', 'carriage_return', 'quotes', 'bom', 'replacement', 'wrong_fields']) AS finding,
    unnest([count(*), count(*) FILTER (value LIKE '%' || chr(13)), count(*) FILTER (contains(value, '"')), count(*) FILTER (value LIKE chr(65279) || '%'), count(*) FILTER (contains(value, chr(65533))), count(*) FILTER (len(string_split(value, ' ')) <> 8)]) AS n FROM l""")
def raw_line_checks(spark: SparkSession, sf: str) -> DataFrame:
    lines = table(spark, sf, "documents").select(F.explode(F.split(F.coalesce("text", F.lit("")), "\n", -1)).alias("value"))
    return quality.raw_lines(lines, " ", 8)


# ------------------------------------------------------------------------------------------------ text and profiles

BASIC = r"trim(regexp_replace(lower({}), '[^\p{{L}}\p{{N}}]+', ' ', 'g'))"
NORM = "array_to_string(list_filter(string_split(" + BASIC.replace("lower({})", "replace(lower({}), '&', ' and ')") + f", ' '), lambda t: t NOT IN {tuple(T.LEGAL_TOKENS)}), ' ')"


@query("basic_norm", duck("ent") + f"SELECT entity_id, {BASIC.format('name')} AS basic FROM ent")
def basic_norm(spark: SparkSession, sf: str) -> DataFrame:
    return view(spark, sf, "ent").select("entity_id", T.basic_norm(F.col("name")).alias("basic"))


@query("norm_name", duck("ent") + f"SELECT entity_id, {NORM.format('name')} AS norm FROM ent")
def norm_name(spark: SparkSession, sf: str) -> DataFrame:
    return view(spark, sf, "ent").select("entity_id", T.norm_name(F.col("name")).alias("norm"))


@query("casing_and_script", duck("ent") + """SELECT country, CASE WHEN l = '' THEN 'no-ascii' WHEN l = upper(l) THEN 'UPPER' WHEN l = lower(l) THEN 'lower' WHEN regexp_matches(regexp_replace(name, '[^A-Za-z ]', '', 'g'), '^ *([A-Z][a-z]*)( +[A-Z][a-z]*)* *$') THEN 'Title' ELSE 'Mixed' END AS casing,
    CASE WHEN regexp_full_match(name, '[\\x00-\\x7F]*') THEN 'ascii' WHEN regexp_matches(name, '[^\\x{0}-\\x{24f}]') THEN 'non-latin' ELSE 'latin-ext' END AS script, count(*) AS n FROM (SELECT *, regexp_replace(name, '[^A-Za-z]', '', 'g') AS l FROM ent) GROUP BY 1, 2, 3""")
def casing_and_script(spark: SparkSession, sf: str) -> DataFrame:
    return view(spark, sf, "ent").groupBy("country", T.casing(F.col("name")).alias("casing"), T.script_bucket(F.col("name")).alias("script")).agg(F.count(F.lit(1)).alias("n"))


PARTNERS = ", pr AS (SELECT a.entity_id AS s1_id, b.entity_id AS cand_id, a.name AS a, b.name AS b, a.country AS ca, b.country AS cb FROM ent a JOIN ent b ON b.doc_id = a.doc_id + 1)"


def _partners(spark: SparkSession, sf: str) -> DataFrame:
    e = view(spark, sf, "ent")
    a = e.select(F.col("entity_id").alias("s1_id"), F.col("name").alias("a"), F.col("country").alias("ca"), (F.col("doc_id") + 1).alias("doc_id"))
    return a.join(e.select("doc_id", F.col("entity_id").alias("cand_id"), F.col("name").alias("b"), F.col("country").alias("cb")), "doc_id").drop("doc_id")


@query("agreement_category", duck("ent") + PARTNERS + " SELECT s1_id, cand_id, CASE WHEN coalesce(ca, '') = '' AND coalesce(cb, '') = '' THEN 'both_missing' WHEN coalesce(ca, '') = '' OR coalesce(cb, '') = '' THEN 'one_missing' WHEN ca = cb THEN 'match' ELSE 'conflict' END AS agreement FROM pr")
def agreement_category(spark: SparkSession, sf: str) -> DataFrame:
    return _partners(spark, sf).select("s1_id", "cand_id", T.agreement(F.col("ca"), F.col("cb")).alias("agreement"))


TRI = "list_distinct([substr('  ' || {0} || ' ', i, 3) for i in range(1, length({0}) + 2)])"


@query("trigram_jaccard", duck("ent") + PARTNERS + f", g AS (SELECT s1_id, cand_id, {TRI.format('a')} AS x, {TRI.format('b')} AS y FROM pr) SELECT s1_id, cand_id, round(len(list_intersect(x, y)) / len(list_distinct(list_concat(x, y))), 6) AS jac FROM g")
def trigram_jaccard(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(_partners(spark, sf).select("s1_id", "cand_id", T.jaccard(T.trigrams(F.col("a")), T.trigrams(F.col("b"))).alias("jac")))


LADDER = f"""SELECT round(avg(CAST(a = b AS INT)), 6) AS exact, round(avg(CAST(lower(a) = lower(b) AS INT)), 6) AS casefold, round(avg(CAST({BASIC.format('a')} = {BASIC.format('b')} AS INT)), 6) AS basic, round(avg(CAST(x = y AS INT)), 6) AS norm,
    round(avg(CAST(list_sort(string_split(x, ' ')) = list_sort(string_split(y, ' ')) AS INT)), 6) AS sorted, round(avg(CAST(list_has_all(string_split(x, ' '), string_split(y, ' ')) OR list_has_all(string_split(y, ' '), string_split(x, ' ')) AS INT)), 6) AS subset
    FROM (SELECT a, b, {NORM.format('a')} AS x, {NORM.format('b')} AS y FROM tp)"""


@query("agreement_ladder", duck("ent") + PARTNERS + ", tp AS (SELECT a, b FROM pr) " + LADDER)
def agreement_ladder(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(profile.agreement_ladder(_partners(spark, sf), "a", "b"))


@query("numbers_and_postal", """WITH t AS (SELECT doc_id, text, CASE lang WHEN 'en' THEN 'US' WHEN 'fr' THEN 'France' ELSE 'India' END AS country FROM documents)
    SELECT doc_id, nullif(regexp_replace(regexp_extract(text, '\\d+'), '^0+(\\d)', '\\1'), '') AS number, CASE country WHEN 'US' THEN left(regexp_extract_all(text, '\\b\\d{5}(?:-\\d{4})?\\b')[-1], 5) WHEN 'India' THEN regexp_extract_all(text, '\\b[1-9]\\d{5}\\b')[-1] ELSE regexp_extract_all(text, '\\b\\d{5}\\b')[-1] END AS postal FROM t""")
def numbers_and_postal(spark: SparkSession, sf: str) -> DataFrame:
    d = table(spark, sf, "documents").select("doc_id", "text", F.when(F.col("lang") == "en", "US").when(F.col("lang") == "fr", "France").otherwise("India").alias("country"))
    return d.select("doc_id", T.first_number(F.col("text")).alias("number"), T.postal_code(F.col("text"), F.col("country")).alias("postal"))


@query("house_bucket", """SELECT l_orderkey, l_linenumber, CASE WHEN l_linenumber = 3 THEN 'missing' WHEN CAST(l_quantity AS INT) = l_suppkey % 50 THEN 'exact' WHEN abs(CAST(l_quantity AS INT) - l_suppkey % 50) <= 10 THEN 'small_gap' ELSE 'big_gap' END AS bucket FROM lineitem""")
def house_bucket(spark: SparkSession, sf: str) -> DataFrame:
    a, b = F.when(F.col("l_linenumber") != 3, F.col("l_quantity").cast("int").cast("string")), (F.col("l_suppkey") % 50).cast("string")
    return table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", T.house_bucket(a, b).alias("bucket"))


RATES = ", rt AS (SELECT country, is_true, avg(CAST(p1_cos >= 0.5 AS INT)) AS high_p1, avg(CAST(in_p3 AS INT)) AS in_p3, avg(CAST(p1_rank = 1 AS INT)) AS top1, count(*) AS pairs FROM pairs GROUP BY 1, 2)"


def _rates(spark: SparkSession, sf: str) -> DataFrame:
    return profile.signal_rates(view(spark, sf, "pairs"), ["country", "is_true"], high_p1=F.col("p1_cos") >= 0.5, in_p3=F.col("in_p3"), top1=F.col("p1_rank") == 1)


@query("signal_rates", duck("pairs") + RATES + " SELECT country, is_true, round(high_p1, 6) AS high_p1, round(in_p3, 6) AS in_p3, round(top1, 6) AS top1, pairs FROM rt")
def signal_rates(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(_rates(spark, sf))


@query("rate_gaps", duck("pairs") + RATES + """, w AS (SELECT t.country, t.high_p1 - f.high_p1 AS high_p1, t.in_p3 - f.in_p3 AS in_p3, t.top1 - f.top1 AS top1 FROM rt t JOIN rt f ON f.country = t.country WHERE t.is_true AND NOT f.is_true)
    SELECT country, 'high_p1' AS signal, round(high_p1, 6) AS gap FROM w UNION ALL SELECT country, 'in_p3', round(in_p3, 6) FROM w UNION ALL SELECT country, 'top1', round(top1, 6) FROM w""")
def rate_gaps(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(profile.rate_gaps(_rates(spark, sf), "country", "is_true", ["high_p1", "in_p3", "top1"]))


@query("top_tokens", duck("ent") + ", c AS (SELECT country, token, count(*) AS n FROM (SELECT country, unnest(string_split(name || ' ' || address, ' ')) AS token FROM ent) WHERE token <> '' GROUP BY 1, 2) SELECT country, token, n, CAST(r AS INTEGER) AS rank FROM (SELECT *, row_number() OVER (PARTITION BY country ORDER BY n DESC, token) AS r FROM c) WHERE r <= 10")
def top_tokens(spark: SparkSession, sf: str) -> DataFrame:
    return profile.top_tokens(view(spark, sf, "ent"), "country", F.filter(F.split(F.concat_ws(" ", "name", "address"), " "), lambda t: t != ""), 10)


@query("vocab_overlap", duck("ent") + """, t AS (SELECT * FROM (SELECT doc_id, unnest(string_split(name || ' ' || address, ' ')) AS token FROM ent) WHERE token <> ''), c AS (SELECT token, count(*) AS n FROM t WHERE doc_id % 2 = 1 GROUP BY 1), s AS (SELECT n, token IN (SELECT token FROM t WHERE doc_id % 2 = 0) AS seen FROM c)
    SELECT count(*) AS types, round(avg(CAST(seen AS INT)), 6) AS type_share, round(sum(CASE WHEN seen THEN n ELSE 0 END) / sum(n), 6) AS occurrence_share FROM s""")
def vocab_overlap(spark: SparkSession, sf: str) -> DataFrame:
    t = view(spark, sf, "ent").select("doc_id", F.explode(F.split(F.concat_ws(" ", "name", "address"), " ")).alias("token")).where("token <> ''")
    return rounded(profile.vocab_overlap(t.where("doc_id % 2 = 0"), t.where("doc_id % 2 = 1")))


@query("length_percentiles", "SELECT lang, quantile_disc(length(text), 0.5) AS p50, quantile_disc(length(text), 0.9) AS p90, quantile_disc(length(text), 0.99) AS p99, round(avg(length(text)), 6) AS mean, max(length(text)) AS max FROM documents GROUP BY 1")
def length_percentiles(spark: SparkSession, sf: str) -> DataFrame:
    out = profile.percentiles(table(spark, sf, "documents"), "lang", F.length("text").cast("long"), [0.5, 0.9, 0.99])
    return rounded(out.withColumns({c: F.col(c).cast("long") for c in ("p50", "p90", "p99")}))


@query("country_pivot", """SELECT lang, count(*) FILTER (s = 'S1') AS "S1", count(*) FILTER (s = 'S2') AS "S2", count(*) FILTER (s = 'S3') AS "S3", count(*) AS total, round(count(*) / sum(count(*)) OVER (), 6) AS share, CAST(0 AS BIGINT) AS other FROM (SELECT lang, 'S' || (1 + doc_id % 3) AS s FROM documents) GROUP BY lang""")
def country_pivot(spark: SparkSession, sf: str) -> DataFrame:
    d = table(spark, sf, "documents").selectExpr("lang", "concat('S', 1 + doc_id % 3) AS s")
    return rounded(profile.pivot_counts(d, "lang", "s", ["S1", "S2", "S3"]))


COUNTS = ", n AS (SELECT s1_id, count(match_id) AS n, count(*) FILTER (match_id LIKE 'S2-%') AS n2, count(*) FILTER (match_id LIKE 'S3-%') AS n3 FROM gt_long GROUP BY 1)"


@query("match_histogram", duck("gt_long") + COUNTS + " SELECT least(n, 10) AS matches, count(*) AS entities FROM n GROUP BY 1")
def match_histogram(spark: SparkSession, sf: str) -> DataFrame:
    return profile.match_histogram(view(spark, sf, "gt_long"))


@query("match_summary", duck("gt_long") + COUNTS + " SELECT count(*) AS entities, count(*) FILTER (n = 0) AS singletons, round(avg(CASE WHEN n > 0 THEN n END), 6) AS mean_matched, max(n) AS most FROM n")
def match_summary(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(profile.match_summary(view(spark, sf, "gt_long")))


@query("source_mix", duck("gt_long") + COUNTS + " SELECT CASE WHEN n2 > 0 AND n3 > 0 THEN 'both' WHEN n2 > 0 THEN 's2_only' WHEN n3 > 0 THEN 's3_only' ELSE 'none' END AS mix, count(*) AS entities FROM n GROUP BY 1")
def source_mix(spark: SparkSession, sf: str) -> DataFrame:
    return profile.source_mix(view(spark, sf, "gt_long"))


@query("shared_names", duck("ent") + ", g AS (SELECT country, name, count(*) AS n, count(DISTINCT address) AS a FROM ent GROUP BY 1, 2) SELECT country, count(*) AS names, CAST(sum(n) AS BIGINT) AS records, CAST(sum(CASE WHEN n > 1 THEN n ELSE 0 END) AS BIGINT) AS shared, count(*) FILTER (a > 1) AS chains FROM g GROUP BY 1")
def shared_names(spark: SparkSession, sf: str) -> DataFrame:
    return profile.shared_names(view(spark, sf, "ent"))


@query("key_rule", """WITH l AS (SELECT CAST(o_orderkey AS VARCHAR) AS id, o_orderstatus AS country, o_orderpriority AS key FROM orders), r AS (SELECT CAST(c_custkey AS VARCHAR) AS id, c_mktsegment AS seg, 'P' || (c_custkey % 3) AS k3 FROM customer),
    rr AS (SELECT id, c AS country, CASE k3 WHEN 'P0' THEN '1-URGENT' WHEN 'P1' THEN '2-HIGH' ELSE '5-LOW' END AS key FROM r CROSS JOIN (SELECT unnest(['F', 'O', 'P']) AS c)),
    de AS (SELECT country, CAST(sum(n1 * n2) AS BIGINT) AS declared FROM (SELECT country, key, count(*) AS n1 FROM l GROUP BY 1, 2) JOIN (SELECT country, key, count(*) AS n2 FROM rr GROUP BY 1, 2) USING (country, key) GROUP BY 1),
    tp AS (SELECT l.country, l.key AS ka, b.key AS kb FROM orders o JOIN l ON l.id = CAST(o.o_orderkey AS VARCHAR) JOIN rr b ON b.id = CAST(o.o_custkey AS VARCHAR) AND b.country = l.country),
    h AS (SELECT country, count(*) AS true_pairs, count(*) FILTER (ka = kb) AS hits FROM tp GROUP BY 1)
    SELECT country, true_pairs, hits, coalesce(declared, 0) AS declared, round(hits / declared, 6) AS precision, round(hits / true_pairs, 6) AS recall FROM h LEFT JOIN de USING (country)""")
def key_rule(spark: SparkSession, sf: str) -> DataFrame:
    orders = table(spark, sf, "orders")
    left = orders.selectExpr("CAST(o_orderkey AS STRING) AS id", "o_orderstatus AS country", "o_orderpriority AS key")
    key = "CASE c_custkey % 3 WHEN 0 THEN '1-URGENT' WHEN 1 THEN '2-HIGH' ELSE '5-LOW' END"
    right = table(spark, sf, "customer").selectExpr("c_custkey", f"{key} AS key", "explode(array('F', 'O', 'P')) AS country").selectExpr("concat(c_custkey, '|', country) AS id", "country", "key")
    true = orders.selectExpr("CAST(o_orderkey AS STRING) AS s1_id", "concat(o_custkey, '|', o_orderstatus) AS cand_id")
    return rounded(profile.key_rule(left, right, true))


# ------------------------------------------------------------------------------------------------ cleaning, features, model


def _raw(spark: SparkSession, sf: str, name: str = "ent") -> DataFrame:
    return view(spark, sf, name).select("entity_id", "doc_id", "country", F.col("name").alias("business_name"), F.col("address").alias("business_address"))


def _cleaned(spark: SparkSession, sf: str) -> DataFrame:
    return cleaning.clean_addresses(cleaning.clean_names(_raw(spark, sf, "rec")))


def _doc_truth(spark: SparkSession, sf: str) -> DataFrame:
    """Stands for known matches of records: queries and the record of the next number, of the same country."""
    e = view(spark, sf, "rec").select("entity_id", "doc_id", "country")
    mine = e.where(F.startswith("entity_id", F.lit("S1-"))).select(F.col("entity_id").alias("s1_id"), (F.col("doc_id") + 1).alias("doc_id"), "country")
    return mine.join(e.withColumnRenamed("entity_id", "cand_id"), ["doc_id", "country"]).select("s1_id", "cand_id", "country")


def _entities(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame]:
    """Cleaned records with how many of their country's queries share their name: queries and pool."""
    needed = ["entity_id", "country", "addr_state_raw", *(c for c in features.ENTITY if c not in ("addr_state_canon", "chain_n"))]
    clean = evaluation.learned_states(stored(_cleaned(spark, sf).select(*needed), "cleaned", compression="zstd"), _doc_truth(spark, sf), 20, 0.5)
    s1, pool = clean.where(F.startswith("entity_id", F.lit("S1-"))), clean.where(~F.startswith("entity_id", F.lit("S1-")))
    chains = s1.groupBy("country", "name_core").agg(F.count(F.lit(1)).alias("chain_n"))
    columns = ["entity_id", "country", *features.ENTITY]
    return s1.join(chains, ["country", "name_core"], "left").select(*columns), pool.join(chains, ["country", "name_core"], "left").select(*columns)


def _records(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame]:
    """Queries and pool, written."""
    s1, pool = _entities(spark, sf)
    return stored(s1, "records", compression="zstd"), stored(pool, "records", compression="zstd")


def _blocked(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """The candidate table of all four passes, queries and pool."""
    s1, pool = _records(spark, sf)
    return evaluation.block(s1, pool), s1, pool


def _featured(spark: SparkSession, sf: str, truth: DataFrame | None = None) -> DataFrame:
    """Candidates of all four passes with their features, and with ``truth`` their label, which is joined to the narrow candidates."""
    s1, pool = _records(spark, sf)
    block = lambda: evaluation.block(s1, pool)
    pairs = alone(block if truth is None else lambda: model.labelled(block(), truth), "candidates", compression="zstd")
    return features.pair_features(pairs, s1, pool, [] if truth is None else ["label"])


@query("unicode_fold")
def unicode_fold_query(spark: SparkSession, sf: str) -> DataFrame:
    return _raw(spark, sf).select("entity_id", unicode_fold(F.col("business_name")).alias("folded"))


@query("clean_names")
def clean_names(spark: SparkSession, sf: str) -> DataFrame:
    out = cleaning.clean_names(_raw(spark, sf))
    return out.select("entity_id", "name_clean", "name_core", "legal_suffix_class", "name_script", "name_nospace", F.array_join("legal_families", ",").alias("legal_families"))


@query("clean_addresses")
def clean_addresses(spark: SparkSession, sf: str) -> DataFrame:
    out = cleaning.clean_addresses(_raw(spark, sf))
    return out.select("entity_id", "addr_clean", "addr_std", "addr_core", "addr_house_number", "addr_unit", "addr_landmark", "addr_state_raw", F.array_join("addr_numbers", ",").alias("addr_numbers"))


@query("jaro_winkler")
def jaro_winkler(spark: SparkSession, sf: str) -> DataFrame:
    """No SQL: DuckDB's function compares bytes, not characters."""
    sims = similarity.name_similarities(T.basic_norm(F.col("a")), T.basic_norm(F.col("b")))
    return _partners(spark, sf).withColumn("x", sims).select("s1_id", "cand_id", F.round(F.col("x.jw").cast("double"), 4).alias("jw"))


@query("token_set_ratio")
def token_set_ratio(spark: SparkSession, sf: str) -> DataFrame:
    return _partners(spark, sf).withColumn("x", similarity.name_similarities(T.basic_norm(F.col("a")), T.basic_norm(F.col("b")))).select("s1_id", "cand_id", F.round(F.col("x.tsr").cast("double"), 4).alias("tsr"))


TOKENS = "list_distinct(list_filter(string_split({}, ' '), lambda t: t <> ''))"


@query("pair_set_features", duck("ent") + PARTNERS + f""", x AS (SELECT s1_id, cand_id, {TOKENS.format(BASIC.format('a'))} AS ta, {TOKENS.format(BASIC.format('b'))} AS tb, {BASIC.format('a')} = {BASIC.format('b')} AS eq FROM pr)
    SELECT s1_id, cand_id, round(len(list_intersect(ta, tb)) / len(list_distinct(list_concat(ta, tb))), 4) AS name_tok_jac, CAST(len(tb) - len(list_intersect(ta, tb)) AS INTEGER) AS name_tok_added,
    CAST(len(ta) - len(list_intersect(ta, tb)) AS INTEGER) AS name_tok_dropped, CAST(len(ta) AS INTEGER) AS a_name_ntok, CAST(len(tb) AS INTEGER) AS b_name_ntok, CAST(eq AS INTEGER) AS name_core_eq FROM x""")
def pair_set_features(spark: SparkSession, sf: str) -> DataFrame:
    e = view(spark, sf, "ent").select("entity_id", "country", T.basic_norm(F.col("name")).alias("name_core"))
    missing = {c: F.lit(None).cast("string") for c in ("name_nospace", "name_domain_stem", "name_script", "addr_core", "addr_house_number", "addr_state_canon")}
    lists = {c: F.lit(None).cast("array<string>") for c in ("legal_families", "addr_numbers")}
    e = e.withColumns({**missing, **lists, "name_has_nonlatin": F.lit(False), "chain_n": F.lit(0)})
    both = features.attach(_partners(spark, sf).select("s1_id", "cand_id"), e, e)
    made = features.name_features()
    return both.select(
        "s1_id", "cand_id", F.round(made["name_tok_jac"].cast("double"), 4).alias("name_tok_jac"),
        *[made[c].cast("int").alias(c) for c in ("name_tok_added", "name_tok_dropped", "a_name_ntok", "b_name_ntok", "name_core_eq")],
    )


@query("pair_window_features", duck("pairs") + """SELECT s1_id, cand_id, CAST(count(*) OVER w AS INTEGER) AS s1_n_cands, CAST(rank() OVER (PARTITION BY s1_id ORDER BY p1_cos DESC) AS INTEGER) AS p1_cos_rank_s1, round(max(p1_cos) OVER w - p1_cos, 4) AS p1_cos_gap_s1,
    coalesce(p1_rank, 51) AS p1_rank, coalesce(p2_rank, 21) AS p2_rank, coalesce(p1_rank_rev, 11) AS p1_rank_rev, CAST(coalesce(p1_rank = 1, false) AND coalesce(p1_rank_rev = 1, false) AS INTEGER) AS mutual_best FROM pairs WINDOW w AS (PARTITION BY s1_id)""")
def pair_window_features(spark: SparkSession, sf: str) -> DataFrame:
    p = view(spark, sf, "pairs").withColumns({"in_p1": F.col("p1_rank").isNotNull(), "in_p2": F.col("p2_rank").isNotNull(), "in_p4": F.col("p1_rank_rev").isNotNull()})
    made = features.blocking_features()
    wanted = ["s1_n_cands", "p1_cos_rank_s1", "p1_rank", "p2_rank", "p1_rank_rev", "mutual_best"]
    return p.select("s1_id", "cand_id", *[made[c].cast("int").alias(c) for c in wanted], F.round(made["p1_cos_gap_s1"].cast("double"), 4).alias("p1_cos_gap_s1"))


@query("pair_features")
def pair_features(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(_featured(spark, sf))


@query("gbdt_scores")
def gbdt_scores(spark: SparkSession, sf: str) -> DataFrame:
    """A booster learned from the labels table: which of all documents are of quality, from a few measures of their text."""
    d = table(spark, sf, "documents").join(table(spark, sf, "labels"), "doc_id", "left")
    text = F.coalesce("text", F.lit(""))
    rows = d.select(F.col("doc_id").cast("string").alias("s1_id"), F.lit("").alias("cand_id"), F.col("quality").alias("label"), F.length(text).alias("chars"), F.size(F.split(text, " ")).alias("words"),
                    F.size(F.array_distinct(F.split(text, " "))).alias("types"), F.regexp_count(text, F.lit("[#*$%&|<>]")).alias("symbols"), F.size(F.split(text, "\n")).alias("lines"))
    columns = ["chars", "words", "types", "symbols", "lines"]
    held = sampling.is_validation(F.col("s1_id"))
    fitted = model.train(rows.where(~held & F.col("label").isNotNull()), columns)
    return rounded(model.score(fitted, rows, columns, ["s1_id"]))


# ------------------------------------------------------------------------------------------------ order, reports, files


@query("row_chunks", "SELECT c_custkey, CAST(floor((row_number() OVER (ORDER BY c_custkey) - 1) / 64) AS BIGINT) AS chunk FROM customer")
def row_chunks(spark: SparkSession, sf: str) -> DataFrame:
    return ordering.chunks(table(spark, sf, "customer").select("c_custkey"), ["c_custkey"], 64)


@query("keep_first", "SELECT o_custkey, arg_min(o_orderkey, (o_orderdate, o_orderkey)) AS o_orderkey, min(o_orderdate) AS o_orderdate FROM orders GROUP BY 1")
def keep_first(spark: SparkSession, sf: str) -> DataFrame:
    return ordering.keep_first(table(spark, sf, "orders").select("o_custkey", "o_orderkey", "o_orderdate"), ["o_custkey"], ["o_orderdate", "o_orderkey"])


@query("sample_per_group", "SELECT c_mktsegment, c_custkey FROM (SELECT *, row_number() OVER (PARTITION BY c_mktsegment ORDER BY md5('hard:' || c_custkey), c_custkey) AS r FROM customer) WHERE r <= 5")
def sample_per_group(spark: SparkSession, sf: str) -> DataFrame:
    return ordering.sample_per_group(table(spark, sf, "customer").select("c_mktsegment", "c_custkey"), "c_mktsegment", "c_custkey", 5, "hard")


@query("merged_top", duck("pairs") + "SELECT s1_id, cand_id, p1_cos, CAST(r AS INTEGER) AS rank FROM (SELECT *, row_number() OVER (PARTITION BY s1_id ORDER BY p1_cos DESC, cand_id) AS r FROM pairs) WHERE r <= 3")
def merged_top(spark: SparkSession, sf: str) -> DataFrame:
    p = stored(view(spark, sf, "pairs").select("s1_id", "cand_id", "p1_cos"), "pairs")
    return ordering.merged_top([p.where(F.pmod(F.crc32("cand_id"), F.lit(4)) == i) for i in range(4)], "s1_id", "cand_id", "p1_cos", 3)


@query("match_positions", duck("pairs", "truth") + """SELECT t.s1_id, t.cand_id, CAST(r AS INTEGER) AS position FROM truth t
    LEFT JOIN (SELECT s1_id, cand_id, row_number() OVER (PARTITION BY s1_id ORDER BY prob DESC, cand_id) AS r FROM pairs) p ON p.s1_id = t.s1_id AND p.cand_id = t.cand_id""")
def match_positions(spark: SparkSession, sf: str) -> DataFrame:
    ranked = F.array_sort(F.collect_list(F.struct((-F.col("prob")).alias("p"), F.col("cand_id").alias("c"))))
    lists = view(spark, sf, "pairs").groupBy("s1_id").agg(ranked.alias("l")).select("s1_id", F.col("l.c").alias("ids"))
    return ordering.positions(lists, view(spark, sf, "truth").select("s1_id", "cand_id"))


@query("example_rows", "SELECT o_orderkey AS place, c_custkey, c_name FROM orders LEFT JOIN customer ON c_custkey = o_custkey")
def example_rows(spark: SparkSession, sf: str) -> DataFrame:
    wanted = table(spark, sf, "orders").select(F.col("o_orderkey").alias("place"), F.col("o_custkey").alias("c_custkey"))
    return ordering.gathered(table(spark, sf, "customer").select("c_custkey", "c_name"), "c_custkey", wanted)


@query("crosstab_share", "SELECT o_orderstatus, o_orderpriority, count(*) AS n, round(count(*) / sum(count(*)) OVER (PARTITION BY o_orderstatus), 6) AS share FROM orders GROUP BY 1, 2")
def crosstab_share(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(reports.crosstab(table(spark, sf, "orders"), "o_orderstatus", "o_orderpriority"))


@query("label_spellings", "SELECT source, count(DISTINCT lang) AS raw, count(DISTINCT lower(trim(lang))) AS normalised FROM documents GROUP BY 1")
def label_spellings(spark: SparkSession, sf: str) -> DataFrame:
    return reports.spellings(table(spark, sf, "documents"), "source", F.col("lang"))


@query("transposed", duck("pairs") + RATES + """ SELECT country, 'high_p1' AS measure, round(high_p1, 6) AS "value" FROM rt WHERE is_true UNION ALL SELECT country, 'in_p3', round(in_p3, 6) FROM rt WHERE is_true UNION ALL SELECT country, 'top1', round(top1, 6) FROM rt WHERE is_true""")
def transposed(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(reports.transposed(_rates(spark, sf).where("is_true"), "country", ["high_p1", "in_p3", "top1"]))


@query("blocking_report", duck("pairs", "truth", "asked") + ", " + SELECTED + """, e AS (SELECT t.s1_id, count(*) AS n, count(s.cand_id) AS k FROM truth t LEFT JOIN sel s ON s.s1_id = t.s1_id AND s.cand_id = t.cand_id GROUP BY 1),
    q AS (SELECT q.s1_id, count(s.cand_id) AS n FROM asked q LEFT JOIN sel s USING (s1_id) GROUP BY 1)
    SELECT * FROM (SELECT CAST(sum(n) AS BIGINT) AS true_pairs, round(sum(k) / sum(n), 6) AS pair_recall, count(*) AS entities, round(avg(CASE WHEN n = k THEN 1.0 ELSE 0.0 END), 6) AS all_found_recall FROM e),
    (SELECT CAST(sum(n) AS BIGINT) AS pairs, round(avg(n), 6) AS mean, CAST(quantile_disc(n, 0.5) AS BIGINT) AS p50, CAST(quantile_disc(n, 0.95) AS BIGINT) AS p95, max(n) AS max FROM q)""")
def blocking_report(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(evaluation.blocking_report(_selected(spark, sf), view(spark, sf, "asked"), view(spark, sf, "truth")))


@query("key_collisions", "WITH l AS (SELECT o_orderstatus AS country, o_orderpriority AS key, count(*) AS a FROM orders WHERE o_orderkey % 2 = 0 GROUP BY 1, 2), r AS (SELECT o_orderstatus AS country, o_orderpriority AS key, count(*) AS b FROM orders WHERE o_orderkey % 2 = 1 GROUP BY 1, 2) SELECT country, count(*) AS keys, CAST(sum(a * b) AS BIGINT) AS pairs FROM l JOIN r USING (country, key) GROUP BY 1")
def key_collisions(spark: SparkSession, sf: str) -> DataFrame:
    """Even orders against odd ones, as two sources."""
    o = table(spark, sf, "orders").select(F.col("o_orderstatus").alias("country"), F.col("o_orderpriority").alias("key"), (F.col("o_orderkey") % 2 == 0).alias("even"))
    return reports.collisions(o.where("even"), o.where("NOT even"))


@query("group_slopes", "SELECT event_type, round(regr_slope(value, user_id), 6) AS slope, count(*) AS n FROM events GROUP BY 1")
def group_slopes(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(reports.slopes(table(spark, sf, "events"), "event_type", "user_id", "value"))


@query("id_range", "SELECT o_orderkey, o_custkey FROM orders WHERE o_custkey BETWEEN 10 AND 99 AND o_totalprice >= 1000 AND o_totalprice < 100000")
def id_range(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "orders").where(F.col("o_custkey").between(10, 99) & (F.col("o_totalprice") >= 1000) & (F.col("o_totalprice") < 100000)).select("o_orderkey", "o_custkey")


@query("replaced_text", "SELECT doc_id, replace(replace(replace(coalesce(text, ''), 'th', 'ss'), 'en', 'e'), '.', '') AS many, regexp_replace(coalesce(text, ''), '[aeiou]+', '_') AS \"first\" FROM documents")
def replaced_text(spark: SparkSession, sf: str) -> DataFrame:
    text = F.coalesce("text", F.lit(""))
    return table(spark, sf, "documents").select("doc_id", T.replace_many(text, {"th": "ss", "en": "e", ".": ""}).alias("many"), T.replace_first(text, "[aeiou]+", "_").alias("first"))


@query("saturated_grams", duck("rec") + POSTINGS + " SELECT entity_id, country, CAST(sum(least(tf, 3)) AS BIGINT) AS capped, CAST(sum(tf) AS BIGINT) AS total FROM post GROUP BY 1, 2")
def saturated_grams(spark: SparkSession, sf: str) -> DataFrame:
    return _postings(spark, sf).groupBy("entity_id", "country").agg(F.sum(F.least("tf", F.lit(3))).alias("capped"), F.sum("tf").alias("total"))


@query("pair_hash", duck("truth") + "SELECT country, bit_xor(xor(('0x' || substr(md5(s1_id), 1, 15))::BIGINT, ('0x' || substr(md5(cand_id), 1, 15))::BIGINT)) AS h FROM truth GROUP BY 1")
def pair_hash(spark: SparkSession, sf: str) -> DataFrame:
    number = lambda c: F.conv(F.substring(F.md5(F.col(c).cast("binary")), 1, 15), 16, 10).cast("long")
    return view(spark, sf, "truth").groupBy("country").agg(F.bit_xor(number("s1_id").bitwiseXOR(number("cand_id"))).alias("h"))


@query("row_counts", " UNION ALL ".join(f"SELECT '{t}' AS name, count(*) AS \"rows\" FROM {t}" for t in ("customer", "documents", "lineitem", "orders")))
def row_counts(spark: SparkSession, sf: str) -> DataFrame:
    return files.row_counts(spark, {t: f"{sf}/{t}.parquet" for t in ("customer", "documents", "lineitem", "orders")})


@query("rows_with_ids", "SELECT o_orderkey, o_totalprice FROM orders WHERE o_custkey IN (SELECT c_custkey FROM customer WHERE c_mktsegment = 'BUILDING')")
def rows_with_ids(spark: SparkSession, sf: str) -> DataFrame:
    ids = table(spark, sf, "customer").where("c_mktsegment = 'BUILDING'").select("c_custkey")
    return files.rows_with(spark, f"{sf}/orders.parquet", "o_custkey", ids).select("o_orderkey", "o_totalprice")


# ------------------------------------------------------------------------------------------------ runs


@query("blocking_run")
def blocking_run(spark: SparkSession, sf: str) -> DataFrame:
    """All four passes on cleaned records: every candidate with its ranks, flags and both cosines."""
    return rounded(_blocked(spark, sf)[0])


@query("exact_recall")
def exact_recall(spark: SparkSession, sf: str) -> DataFrame:
    """What the cap on a gram's frequency loses: recall of the nearest 50 by rare grams against those by all grams, for all queries."""
    return rounded(evaluation.exact_check(*_weighted(spark, sf), M1, K1))


@query("pool_experiment")
def pool_experiment(spark: SparkSession, sf: str) -> DataFrame:
    e = view(spark, sf, "rec")
    return rounded(evaluation.pool_experiment(e, F.concat_ws(" ", "name", "address"), _doc_truth(spark, sf), [500, 810, 1000], M1, K1))


@query("state_alignment")
def state_alignment(spark: SparkSession, sf: str) -> DataFrame:
    return lookup.learn_mapping(evaluation.aligned_states(_doc_truth(spark, sf), stored(_cleaned(spark, sf), "cleaned")), 1, 0.5)


@query("cleaning_evaluation")
def cleaning_evaluation(spark: SparkSession, sf: str) -> DataFrame:
    """Records without a name are one chain, and so negatives of one another; every query meets five at most."""
    clean = stored(_cleaned(spark, sf), "cleaned")
    s1, pool = evaluation.sides(clean)
    truth = _doc_truth(spark, sf)
    return rounded(evaluation.cleaning_evaluation(truth, evaluation.hard_negatives(s1, pool, truth), clean))


@query("cleaning_ablations")
def cleaning_ablations(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(evaluation.ablations(cleaning_evaluation(spark, sf)))


@query("matcher_scores")
def matcher_scores(spark: SparkSession, sf: str) -> DataFrame:
    """A booster learned on the features of the training queries' candidates scores all candidates."""
    rows = alone(lambda: _featured(spark, sf, _doc_truth(spark, sf)), "features", compression="zstd")
    columns = [c for c, kind in rows.dtypes if c not in ("s1_id", "cand_id", "country", "label")]
    fitted = model.train(rows.where(~sampling.is_validation(F.col("s1_id"))), columns, trees=10, depth=4)
    return rounded(model.score(fitted, rows, columns, ["s1_id", "cand_id"]))


@query("cross_country")
def cross_country(spark: SparkSession, sf: str) -> DataFrame:
    """On the scored pairs of the star schema: learned where orders have one priority, applied to another."""
    p = view(spark, sf, "pairs").select("s1_id", "cand_id", "country", "p1_cos", "p2_cos", "prob", F.col("is_true").cast("int").alias("label"))
    return rounded(evaluation.cross_country(stored(p, "pairs"), ["p1_cos", "p2_cos", "prob"], ["1-URGENT", "5-LOW"], view(spark, sf, "asked"), view(spark, sf, "truth"), trees=5, depth=3))


#: Queries that are runs of many operators.
RUNS = ["gbdt_scores", "exact_recall", "pool_experiment", "state_alignment", "cleaning_evaluation", "cleaning_ablations", "blocking_run", "pair_features", "cross_country", "matcher_scores"]
