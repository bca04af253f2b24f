"""Pieces that several operators of this subpackage share."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: White space between words, as a character class and as the set of its characters.
SPACE_CLASS = "[\\x20\\x09-\\x0D]+"
SPACES = " \t\n\x0b\f\r"


#: Rows up to which a table of a few narrow columns is broadcast (some tens of MB); beyond, both sides of its join are shuffled.
SMALL_ROWS = 200_000


#: Rows that a Python worker gets at once: texts of some kB make batches of some MB, where Spark's own number makes tens of them.
BATCH_ROWS = 1024
BATCH_SETTING, _SPARKS_OWN = "spark.sql.execution.arrow.maxRecordsPerBatch", "10000"


def small_batches(spark: SparkSession) -> None:
    """Bounds what a batch of texts takes in the buffers of executors and workers, unless the session names a number itself."""
    if spark.conf.get(BATCH_SETTING) == _SPARKS_OWN:
        spark.conf.set(BATCH_SETTING, str(BATCH_ROWS))


def is_small(df: DataFrame, rows: int = SMALL_ROWS) -> bool:
    """Whether ``df``, a written table, has at most so many rows; one count of them."""
    return df.count() <= rows


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def spaced(text: Column) -> Column:
    """The text (null: empty) with blanks for white space and none at its ends; see :func:`single_spaced`.

    Plain replacements by character, so that the later split at single blanks needs no regular expression.
    """
    out = F.coalesce(text.cast("string"), F.lit(""))
    for space in SPACES[1:]:
        out = F.replace(out, F.lit(space), F.lit(" "))
    return F.btrim(out)


def single_spaced(blanks: Column) -> Column:
    """One blank for each run of them; texts without such runs, nearly all, aren't copied."""
    return F.when(F.contains(blanks, F.lit("  ")), F.regexp_replace(blanks, " +", " ")).otherwise(blanks)


def words(one_spaced: Column) -> Column:
    """The words of a text that went through :func:`spaced` and :func:`single_spaced`: an empty array for null and blank texts."""
    return F.when(one_spaced == "", F.array().cast("array<string>")).otherwise(F.split(one_spaced, " "))


def count_words(text: Column) -> Column:
    """The number of maximal runs of characters that aren't white space (null: 0), without making an array."""
    inner = single_spaced(spaced(text))
    return F.when(inner == "", F.lit(0)).otherwise(F.octet_length(inner) - F.octet_length(F.replace(inner, F.lit(" "))) + 1).cast("long")
