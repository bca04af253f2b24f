"""Data-quality checks that report counts of findings, and the validator of list files."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

ID_PATTERN = r"^S([123])-\d+$"


def id_source(ids: Column) -> Column:
    """The source number of an id like S2-17; null if it is malformed."""
    return F.nullif(F.regexp_extract(ids, ID_PATTERN, 1), F.lit("")).cast("int")


def findings(df: DataFrame, **checks: Column) -> DataFrame:
    """(finding, n): how many rows meet each condition, in one pass."""
    row = df.agg(*[F.count_if(c).alias(name) for name, c in checks.items()])
    return row.select(F.explode(F.array(*[F.struct(F.lit(n).alias("finding"), F.col(n).alias("n")) for n in checks])).alias("x")).select("x.*")


def integrity(df: DataFrame, column: str) -> DataFrame:
    """Usual defects of a text column."""
    c = F.col(column)
    return findings(
        df, rows=F.lit(True), empty=F.coalesce(c == "", F.lit(True)), edge_space=c != F.trim(c), double_space=c.contains("  "), literal_null=F.lower(F.trim(c)).isin("null", "n/a", "none", "nan"),
        nbsp=c.contains(" "), zero_width=c.rlike("[​-‍﻿]"), control=c.rlike(r"[\x00-\x08\x0b\x0c\x0e-\x1f\x7f]"), non_ascii=c.rlike(r"[^\x00-\x7F]"), mojibake=c.rlike("[Ââ][\u0080-\u009f]"),
    )


def raw_lines(lines: DataFrame, separator: str = "\t", fields: int | None = None) -> DataFrame:
    """Findings on raw lines (column ``value``): wrong field counts, carriage returns, quotes, byte order marks."""
    n = F.size(F.split("value", separator, -1))
    wrong = {"wrong_fields": n != fields} if fields else {}
    return findings(lines, lines=F.lit(True), carriage_return=F.endswith("value", F.lit("\r")), quotes=F.contains("value", F.lit('"')), bom=F.startswith("value", F.lit("﻿")), replacement=F.contains("value", F.lit("�")), **wrong)


def duplicate_content(df: DataFrame, columns: list[str]) -> DataFrame:
    """Rows and groups that agree in all ``columns``."""
    g = df.groupBy(*columns).agg(F.count(F.lit(1)).alias("n"))
    return g.agg(F.count_if(F.col("n") > 1).alias("groups"), F.coalesce(F.sum(F.when(F.col("n") > 1, F.col("n"))), F.lit(0)).alias("rows"), F.max("n").alias("largest"))


def referential_checks(long_truth: DataFrame, s1_ids: DataFrame, pool_ids: DataFrame) -> DataFrame:
    """(finding, n) for a long ground truth (s1_id, match_id): unknown ids, missing queries, ids in several lists, duplicate pairs, malformed ids."""
    pairs = long_truth.where("match_id IS NOT NULL")
    count = lambda df, name: df.agg(F.count(F.lit(1)).alias("n")).select(F.lit(name).alias("finding"), "n")
    parts = [
        count(long_truth.select("s1_id").distinct().join(s1_ids.select("s1_id"), "s1_id", "left_anti"), "unknown_s1"),
        count(s1_ids.select("s1_id").join(long_truth.select("s1_id"), "s1_id", "left_anti"), "missing_s1"),
        count(pairs.join(pool_ids.select("match_id"), "match_id", "left_anti"), "unknown_match"),
        count(pairs.groupBy("s1_id", "match_id").count().where("count > 1"), "duplicate_pairs"),
        count(pairs.select("s1_id", "match_id").distinct().groupBy("match_id").count().where("count > 1"), "match_in_several"),
        count(long_truth.where(id_source(F.col("s1_id")).isNull() | (F.col("match_id").isNotNull() & id_source(F.col("match_id")).isNull())), "malformed"),
        count(pairs.where(id_source(F.col("match_id")) == 1), "matches_s1"),
    ]
    return reduce(DataFrame.unionByName, parts)


def validate_lists(lists: DataFrame, s1_ids: DataFrame, pool_ids: DataFrame, candidates: DataFrame | None = None) -> DataFrame:
    """(finding, n) for a result file (s1_id, ids: comma list): repeated rows, missing and extra queries, and by list entry
    malformed, wrong-source, repeated, own and unknown ids, and entries that aren't candidates."""
    entries = lists.select("s1_id", F.explode(F.split("ids", ",")).alias("match_id")).where("match_id <> ''")
    count = lambda df, name: df.agg(F.count(F.lit(1)).alias("n")).select(F.lit(name).alias("finding"), "n")
    source = id_source(F.col("match_id"))
    parts = [
        count(lists.groupBy("s1_id").count().where("count > 1"), "repeated_rows"),
        count(s1_ids.select("s1_id").join(lists.select("s1_id"), "s1_id", "left_anti"), "missing_s1"),
        count(lists.select("s1_id").join(s1_ids.select("s1_id"), "s1_id", "left_anti"), "extra_s1"),
        count(entries.where(source.isNull()), "malformed_id"), count(entries.where(source == 1), "wrong_source"),
        count(entries.where("match_id = s1_id"), "self_match"),
        count(entries.groupBy("s1_id", "match_id").count().where("count > 1"), "repeated_in_list"),
        count(entries.where(source.isNotNull()).join(pool_ids.select("match_id"), "match_id", "left_anti"), "unknown_id"),
    ]
    if candidates is not None:
        parts.append(count(entries.join(candidates.select("s1_id", "match_id"), ["s1_id", "match_id"], "left_anti"), "not_a_candidate"))
    return reduce(DataFrame.unionByName, parts)
