"""Record-linkage views over the driver's star schema, in SQL that Spark and DuckDB both read.

ent: documents as business records, the first six words as the name and all others as the address. rec: turns of conversations,
which have the length of business records, in the same way, for the queries that compare records. pairs: lineitem as scored candidates with ranks and pass flags. truth and asked: true
pairs and queries. gt: orders as comma lists of matches. chain: part as names with house number and state.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

#: Ranks beyond these are null, as beyond a pass's k.
K1, K2, K4 = 50, 20, 10

ENT = r"""
SELECT concat('S', CAST(1 + doc_id % 3 AS STRING), '-', CAST(doc_id AS STRING)) AS entity_id, doc_id,
       array_join(slice(ws, 1, 6), ' ') AS name, array_join(slice(ws, 7, greatest(size(ws) - 6, 0)), ' ') AS address, lang AS country
FROM (SELECT doc_id, lang, regexp_extract_all(coalesce(text, ''), '[^ \\t\\n\\r]+', 0) AS ws FROM documents)
"""
REC = r"""
SELECT concat('S', CAST(1 + (conv_id + turn) % 3 AS STRING), '-', CAST(conv_id * 1000 + turn AS STRING)) AS entity_id, conv_id * 1000 + turn AS doc_id,
       array_join(slice(ws, 1, 6), ' ') AS name, array_join(slice(ws, 7, greatest(size(ws) - 6, 0)), ' ') AS address,
       CASE CAST(floor(conv_id / 3) AS BIGINT) % 3 WHEN 0 THEN 'US' WHEN 1 THEN 'India' ELSE 'France' END AS country
FROM (SELECT conv_id, turn, regexp_extract_all(coalesce(text, ''), '[^ \\t\\n\\r]+', 0) AS ws FROM conversations)
"""
PAIRS = f"""
SELECT s1_id, cand_id, prob, p1_cos, p2_cos, is_true, country,
       CASE WHEN r1 <= {K1} THEN CAST(r1 AS INT) END AS p1_rank, CASE WHEN r2 <= {K2} THEN CAST(r2 AS INT) END AS p2_rank,
       CASE WHEN r4 <= {K4} THEN CAST(r4 AS INT) END AS p1_rank_rev, in_p3
FROM (
    SELECT s1_id, cand_id, prob, p1_cos, p2_cos, is_true, country, in_p3,
           row_number() OVER (PARTITION BY s1_id ORDER BY p1_cos DESC, cand_id) AS r1,
           row_number() OVER (PARTITION BY s1_id ORDER BY p2_cos DESC, cand_id) AS r2,
           row_number() OVER (PARTITION BY cand_id ORDER BY p1_cos DESC, s1_id) AS r4
    FROM (
        SELECT CAST(l_orderkey AS STRING) AS s1_id, CAST(l_partkey AS STRING) AS cand_id, max(l_extendedprice) / 120000 AS prob,
               max(l_quantity) / 50 AS p1_cos, max(l_discount) * 10 AS p2_cos, max(l_returnflag) = 'R' AS is_true, max(l_tax) >= 0.06 AS in_p3,
               min(o_orderpriority) AS country
        FROM lineitem JOIN orders ON l_orderkey = o_orderkey GROUP BY l_orderkey, l_partkey
    ) base
) ranked
"""
TRUTH = "SELECT s1_id, cand_id, country FROM pairs WHERE is_true"
ASKED = "SELECT CAST(o_orderkey AS STRING) AS s1_id, o_orderpriority AS country FROM orders"
CHAIN = "SELECT CAST(p_partkey AS STRING) AS entity_id, p_name AS name, p_type AS country, CAST(p_size AS STRING) AS house, p_brand AS state FROM part"
GT_LONG = """
SELECT concat('S1-', CAST(c_custkey AS STRING)) AS s1_id,
       CASE WHEN o_orderkey IS NOT NULL THEN concat('S', CAST(2 + o_orderkey % 2 AS STRING), '-', CAST(o_orderkey AS STRING)) END AS match_id
FROM customer LEFT JOIN orders ON c_custkey = o_custkey
"""
ALL = {"ent": ENT, "rec": REC, "pairs": PAIRS, "truth": TRUTH, "asked": ASKED, "chain": CHAIN, "gt_long": GT_LONG}
TABLES = "region nation customer supplier part orders lineitem events documents labels benchmark conversations".split()


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def view(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One of the views over the tables of ``sf_dir``; nothing is registered in the catalog."""
    needed = {n: sql for n, sql in ALL.items()}
    text = needed[name]
    sources: dict[str, DataFrame] = {}
    for other in [*ALL, *TABLES]:
        if other != name and f" {other}" in f" {text.replace(chr(10), ' ')}" and (f"FROM {other}" in text or f"JOIN {other}" in text):
            sources[other] = view(spark, sf_dir, other) if other in ALL else table(spark, sf_dir, other)
            text = text.replace(f"FROM {other}", f"FROM {{{other}}}").replace(f"JOIN {other}", f"JOIN {{{other}}}")
    return spark.sql(text, **sources)


def _duck(sql: str) -> str:
    return (
        sql.replace("AS STRING", "AS VARCHAR").replace("'[^ \\\\t\\\\n\\\\r]+', 0", "'[^ \\t\\n\\r]+'")
        .replace("array_join(slice(ws, 1, 6), ' ')", "array_to_string(ws[1:6], ' ')").replace("array_join(slice(ws, 7, greatest(size(ws) - 6, 0)), ' ')", "array_to_string(ws[7:], ' ')")
    )


def duck(*names: str) -> str:
    """A WITH clause that defines the views for DuckDB (and those they need), to put before a SELECT."""
    wanted: list[str] = []

    def need(name: str) -> None:
        for other in ALL:
            if other != name and (f"FROM {other}" in ALL[name] or f"JOIN {other}" in ALL[name]):
                need(other)
        if name not in wanted:
            wanted.append(name)

    for name in names:
        need(name)
    return "WITH " + ", ".join(f"{n} AS ({_duck(ALL[n])})" for n in wanted) + " "
