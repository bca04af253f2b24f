"""Host-level quality rules, in DataFrame functions only.

Each document is judged by rules of its own. Their failures are counted by host; each host's failure rate is
shrunk towards a beta prior that is fitted to the rates of all hosts (method of moments), so that a host with two
bad pages is not condemned like one with two thousand. The verdict on a host is joined back to its documents.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import scratch
from .common import SPACES, is_small, single_spaced, spaced, words

SYMBOLS = "#*$%&|<>"
#: Positions of words are packed in the low bits beside a hash of the window that starts there.
POSITION_BITS = 24
#: Keys over which a host's rows are dealt where its verdict isn't broadcast.
SPREAD = 16


@dataclass(frozen=True)
class HostRules:
    """min_words, max_repeat_percent: the rules a document must pass by itself.
    max_symbol_percent, max_dup_line_percent: rules that only count towards its host.
    max_host_rate: a host whose shrunk failure rate lies above is rejected with all its documents.
    """

    min_words: int = 50
    max_repeat_percent: int = 50
    max_symbol_percent: int = 10
    max_dup_line_percent: int = 50
    max_host_rate: float = 0.75


#: What :func:`_neighbours` says of two windows that follow one another in sorted order.
OTHER, EQUAL, COLLIDING = 0, 1, 2


def _neighbours(found: str, window: str) -> Column:
    """For each of the sorted windows but the last: OTHER, EQUAL or COLLIDING, by its hash and words against the next one's.

    ``window`` names a column of windows packed as (hash, position) and sorted, ``found`` one of the words, on which
    equality is decided. Windows with one hash stand together; if no two neighbours among them are COLLIDING all are equal.
    """
    low = (1 << POSITION_BITS) - 1
    same = " AND ".join(f"get({found}, CAST(x & {low} AS INT) + {k}) = get({found}, CAST(y & {low} AS INT) + {k})" for k in range(3))
    return F.expr(f"""
        zip_with(slice({window}, 1, greatest(size({window}) - 1, 0)), slice({window}, 2, greatest(size({window}) - 1, 0)),
                 (x, y) -> CASE WHEN shiftright(x, {POSITION_BITS}) <> shiftright(y, {POSITION_BITS}) THEN {OTHER} WHEN {same} THEN {EQUAL} ELSE {COLLIDING} END)""")


def with_measures(docs: DataFrame, keep: list[str], text: str = "text") -> DataFrame:
    """``keep`` columns of ``docs`` and the measures of each whole text (null: empty), one narrow pass.

    n_words; word_chars (code points in words); n_symbols (characters of SYMBOLS); n_lines (lines that hold a word);
    n_dup_lines (those equal to an earlier one); n_repeat_words (words in three-word windows that occur twice or more).

    Windows are sorted as numbers, a part of their hash above their position, and compared with their neighbours word by
    word. Texts in which that part of the hash is the same for different windows, and texts whose positions don't fit
    beside it, have their windows sorted by their words instead; the result is the same and exact either way.
    """
    whole = F.coalesce(F.col(text).cast("string"), F.lit(""))
    low = (1 << POSITION_BITS) - 1
    lines = F.filter(F.split(whole, "\n", -1), lambda x: F.btrim(x, F.lit(SPACES)) != "")
    counted = ["n_words", "word_chars", "n_symbols", "n_lines", "n_dup_lines"]
    step0 = docs.select(
        *keep,
        spaced(F.col(text)).alias("_b"),
        F.regexp_count(whole, F.lit(f"[{SYMBOLS}]")).cast("long").alias("n_symbols"),
        lines.alias("_l"),
    )
    step0 = step0.select(*keep, "n_symbols", "_l", single_spaced(F.col("_b")).alias("_t"))
    step1 = step0.select(
        *keep, "n_symbols", "_l",
        words(F.col("_t")).alias("_w"),
        F.length(F.replace("_t", F.lit(" "))).cast("long").alias("word_chars"),
    )
    step2 = step1.select(
        *keep, "_w", "word_chars", "n_symbols",
        F.size("_w").cast("long").alias("n_words"),
        F.size("_l").cast("long").alias("n_lines"),
        (F.size("_l") - F.size(F.array_distinct("_l"))).cast("long").alias("n_dup_lines"),
        F.expr(f"""
            CASE WHEN size(_w) < 4 OR size(_w) > {low} THEN CAST(array() AS ARRAY<BIGINT>)
                 ELSE sort_array(transform(sequence(0, size(_w) - 3),
                     i -> shiftleft(xxhash64(get(_w, i), get(_w, i + 1), get(_w, i + 2)), {POSITION_BITS}) | CAST(i AS BIGINT))) END""").alias("_s"),
    )
    step3 = step2.select(*keep, *counted, "_w", "_s", _neighbours("_w", "_s").alias("_e"))
    step4 = step3.select(
        *keep, *counted, "_s", "_e",
        F.expr(f"""
            CASE WHEN size(_w) > {low} OR exists(_e, x -> x = {COLLIDING}) THEN sort_array(transform(sequence(0, size(_w) - 3),
                     i -> struct(get(_w, i) AS a, get(_w, i + 1) AS b, get(_w, i + 2) AS c, CAST(i AS BIGINT) AS i))) END""").alias("_g"),
    )
    # a window repeats if it equals the one before or the one after it in sorted order
    alike = "(x.a = get(_g, {0}).a AND x.b = get(_g, {0}).b AND x.c = get(_g, {0}).c)"
    step5 = step4.select(
        *keep, *counted,
        F.expr(f"""
            CASE WHEN _g IS NOT NULL THEN sort_array(transform(filter(_g, (x, j) ->
                     (j + 1 < size(_g) AND {alike.format('j + 1')}) OR (j > 0 AND {alike.format('j - 1')})), x -> x.i))
                 WHEN exists(_e, x -> x = {EQUAL}) THEN sort_array(transform(filter(_s, (x, j) -> get(_e, j) = {EQUAL} OR (j > 0 AND get(_e, j - 1) = {EQUAL})), x -> x & {low}))
                 ELSE CAST(array() AS ARRAY<BIGINT>) END""").alias("_r"),
    )
    covered = F.expr("""
        CASE WHEN size(_r) = 0 THEN 0L
             ELSE 3L + aggregate(zip_with(slice(_r, 1, size(_r) - 1), slice(_r, 2, size(_r) - 1), (a, b) -> least(b - a, 3L)), 0L, (s, x) -> s + x) END""")
    return step5.select(*keep, *counted, covered.alias("n_repeat_words"))


def host_quality(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", host_col: str = "source", rules: HostRules = HostRules(), keep: Sequence[str] = ()) -> DataFrame:
    """One row for each row of ``docs``: the measures, ``base_failed``, the host's counts and rates, ``kept``.

    Output columns: the id, ``host``, the measures of :func:`with_measures`, ``base_failed``, ``rule_failed`` (any rule,
    the host-level ones included), ``host_docs``, ``host_failed``, ``host_rate`` (shrunk), ``kept``, and ``row``, a structure of the columns named in ``keep``.

    * null, empty and blank texts: no words, so they fail by themselves;
    * null hosts: one host of their own; null ids and repeated rows: kept as they are, row for row;
    * an empty table: an empty result; other columns are not read, so their names can't clash.
    """
    source = docs.select(F.col(id_col).alias("_id"), F.col(host_col).alias("_host"), F.col(text_col).alias("_text"), *([F.struct(*keep).alias("row")] if keep else []))
    carried = ["row"] if keep else []
    base = with_measures(source, ["_id", "_host", *carried], "_text")
    failed = (F.col("n_words") < rules.min_words) | (100 * F.col("n_repeat_words") > rules.max_repeat_percent * F.col("n_words"))
    extra = (100 * F.col("n_symbols") > rules.max_symbol_percent * F.col("word_chars")) | (100 * F.col("n_dup_lines") > rules.max_dup_line_percent * F.col("n_lines"))
    # the texts are measured once; what follows reads a few numbers a document
    judged = scratch.written(base.withColumn("base_failed", failed).withColumn("rule_failed", failed | extra), "measures")

    hosts = judged.groupBy("_host").agg(F.count(F.lit(1)).alias("host_docs"), F.sum(F.col("rule_failed").cast("long")).alias("host_failed"))
    rate = F.col("host_failed") / F.col("host_docs")
    known = hosts.agg(F.avg(rate).alias("mean"), F.var_pop(rate).alias("variance")).first()  # two numbers for all hosts
    alpha, beta = beta_prior(known.mean, known.variance)
    verdicts = hosts.select(
        F.col("_host").alias("_h2"), "host_docs", "host_failed",
        ((F.col("host_failed") + F.lit(alpha)) / (F.col("host_docs") + F.lit(alpha + beta))).alias("host_rate"),
    )
    joined = with_verdicts(judged, scratch.written(verdicts, "hosts"))
    return joined.select(
        F.col("_id").alias(id_col), F.col("_host").alias("host"),
        "n_words", "word_chars", "n_symbols", "n_lines", "n_dup_lines", "n_repeat_words", "base_failed", "rule_failed",
        "host_docs", "host_failed", "host_rate",
        (~F.col("base_failed") & (F.col("host_rate") <= rules.max_host_rate)).alias("kept"), *carried,
    )


def with_verdicts(judged: DataFrame, verdicts: DataFrame) -> DataFrame:
    """``judged`` (_host) with the columns of ``verdicts`` (_h2), by host; nulls are one host.

    The verdicts on up to SMALL_ROWS hosts are broadcast, so no text is shuffled. Beyond that both sides are, with each host's rows
    dealt over SPREAD keys, so that a host with a third of all rows is no single task's.
    """
    same = F.col("_host").eqNullSafe(F.col("_h2"))
    if is_small(verdicts):
        return judged.join(F.broadcast(verdicts), same, "left").drop("_h2")
    dealt = judged.withColumn("_deal", F.pmod(F.xxhash64("_id", "n_words", "word_chars"), F.lit(SPREAD)))
    copies = verdicts.withColumn("_deal2", F.explode(F.sequence(F.lit(0), F.lit(SPREAD - 1))))
    return dealt.join(copies, same & (F.col("_deal") == F.col("_deal2")), "left").drop("_h2", "_deal", "_deal2")


def beta_prior(mean: float | None, variance: float | None) -> tuple[float, float]:
    """alpha and beta of the prior from the mean and variance of the hosts' rates.

    Where the variance tells nothing (one host, equal rates) the prior is one document at the mean rate.
    """
    mean = min(max(0.5 if mean is None else mean, 1e-3), 1 - 1e-3)
    strength = mean * (1 - mean) / variance - 1 if variance else 1.0
    strength = min(max(strength, 1.0), 1e6)
    return mean * strength, (1 - mean) * strength
