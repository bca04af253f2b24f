"""A corpus pipeline over ``documents``: rules, language, near-duplicates, mixture, tokens.

Each stage takes (spark, docs, sf_dir), works on all that its predecessor kept, and returns a table that is written
as Parquet and read again as the next one's ``docs``. All but the last return the columns of ``docs``.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessella.llm import bpe, langid, mixing, paritysketch, quality, scratch

#: Texts whose best cosine is lower, far below any real text of fifty words, are rejected like those without letters.
LEAST_SCORE = 0.1


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that pass the base rules and whose source isn't rejected.

    Null, empty and blank texts fail; a null source is a source of its own; repeated rows are judged alike and kept each;
    an empty table gives an empty one; all columns are carried in one structure, so their names can't clash.
    """
    judged = quality.host_quality(docs, keep=docs.columns)
    return judged.where("kept").select("row.*")


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in which a language is recognised; profiles are learned from those whose language is given.

    Null, empty and letterless texts go; ties go to the language first in code point order, repeated rows are kept each; without
    any known language, as on an empty table, nothing is recognised. A column named _lang or _score would be replaced.
    """
    found = langid.predict(docs, langid.fit(docs), lang_out="_lang", score_out="_score")
    return found.where((F.col("_lang") != langid.UNKNOWN) & (F.col("_score") >= LEAST_SCORE)).select(*docs.columns)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group that links of five-word shingles at a similarity of 0.8 join.

    The one with the smallest id stays; of repeated rows of that id, one. Documents without words and with null ids are in no group
    and stay; an empty table gives an empty one.
    """
    return paritysketch.one_of_each(docs)


def mixture(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as the mixture of sources takes it.

    Null and blank texts have size 0 and go with their source's epochs; a null source is the last one; repeated rows are documents
    of their own; an empty table gives an empty one; all columns are carried in one structure.
    """
    mixed = mixing.mix(docs, keep=docs.columns).where("copies > 0")
    return mixed.select("row", F.explode(F.sequence(F.lit(1), F.col("copies").cast("int")))).select("row.*")


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The token ids of each document, with a digest of what they decode to.

    Null and empty texts have no ids; null ids and repeated rows are kept, row for row; an empty table gives an empty one.
    """
    path = public_tokenizers.path("byte_bpe_50k.json")
    done = bpe.encode(docs, path, decoded_col="decoded")
    return done.select("doc_id", F.size("ids").cast("long").alias("n_tokens"), "ids", F.sha2(F.col("decoded").cast("binary"), 256).alias("decoded_sha256"))


STAGES = [
    ("quality_rules", quality_rules),
    ("language_id", language_id),
    ("near_duplicates", near_duplicates),
    ("mixture", mixture),
    ("tokens", tokens),
]

#: No SQL expresses the tokenizer; tests/llm holds the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages on ``documents``."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = scratch.written(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
