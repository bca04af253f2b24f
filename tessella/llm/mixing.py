"""Mixing sources to target weights by Efraimidis-Spirakis sampling.

Every document gets the key -ln(u) / w from a hash u of the document and its quality weight w; the documents of a
source are taken in the order of their keys, so better documents come earlier with greater probability. A source
first gives complete epochs; the rest of its budget is filled by a prefix of that order.

Only the point where the prefix ends has to be found. The keys are whole numbers, and equal keys are told apart by a
number of the row. A search narrows down the end of each source's budget: the range of keys in which it lies is cut
into slices, sums by (source, slice) show which slice holds it, and so on until few enough rows are left to sort.
Every round is one aggregation over narrow rows, whatever the distribution of the keys and however many of them are
equal, so neither a large source nor a group of copies is ever sorted or gathered in one task, and the documents
themselves are never shuffled: a row for each source decides on them.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from . import scratch
from .common import count_words, is_small

SYMBOLS = "#*$%&|<>"
#: Bits of a key, of them those of a row's hash, and those that a round of the search settles.
KEY_BITS, TIE_BITS, SLICE_BITS = 63, 22, 12
#: Rows of a source that are few enough to be sorted at the end of the search.
LEAF = 1 << 16


def quality_weight(text: Column) -> Column:
    """Between 0.1 and 1: one less five times the share of symbol characters in the text's bytes."""
    whole = F.coalesce(text.cast("string"), F.lit(""))
    symbols = sum((F.octet_length(whole) - F.octet_length(F.replace(whole, F.lit(c))) for c in SYMBOLS), F.lit(0))
    return F.greatest(F.lit(0.1), 1 - 5 * symbols / F.greatest(F.octet_length(whole), F.lit(1)))


def sampling_key(identity: Sequence[Column], weight: Column, seed: int, row: Column) -> Column:
    """The Efraimidis-Spirakis key -ln(u) / weight in steps of 2**-32, above 22 bits of a hash of ``row`` that tell equal keys apart.

    Weights of 0.1 or more give non-negative 63-bit numbers.
    """
    u = (F.shiftrightunsigned(F.xxhash64(*identity, F.lit(seed)), 11).cast("double") + 0.5) / F.lit(float(1 << 53))
    steps = F.floor(-F.ln(u) / weight * F.lit(float(1 << 32)))
    return F.shiftleft(steps, TIE_BITS).bitwiseOR(F.pmod(F.xxhash64(row), F.lit(1 << TIE_BITS)))


def numbered(sizes: DataFrame) -> DataFrame:
    """``sizes`` with ``turn``, the place (from 0) of each source in code point order, null last; no task holds them all."""
    dealt = sizes.withColumn("_last", F.col("source").isNull()).repartitionByRange("_last", "source").withColumn("_p", F.spark_partition_id())
    dealt = scratch.written(dealt, "sources")
    before = F.coalesce(F.sum("_n").over(W.orderBy("_p").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))  # a row for each part
    begins = dealt.groupBy("_p").agg(F.count(F.lit(1)).alias("_n")).select("_p", before.alias("_before"))
    place = F.row_number().over(W.partitionBy("_p").orderBy(F.col("source").asc_nulls_last()))
    return dealt.withColumn("_place", place).join(F.broadcast(begins), "_p").select("source", "source_size", (F.col("_before") + F.col("_place") - 1).alias("turn"))


def targets(sizes: DataFrame, weights: Sequence[float] = (3, 1, 2), share: float = 1.5, most: float = 2.0) -> DataFrame:
    """``sizes`` (source, source_size) with ``target``: ``share`` of all sizes split by weight, at most ``most`` times a source.

    The sources in code point order, null last, get the weights in turn. What a source can't take is shared by weight
    among the others until none is above its limit: the share of a unit of weight rises from round to round as more
    sources are full, and each round is one aggregation over the sources.
    """
    s = numbered(sizes)
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (F.pmod("turn", F.lit(len(weights))) + 1).cast("int"))
    s = scratch.written(s.select("source", "source_size", weight.alias("_w"), (F.col("source_size") * F.lit(float(most))).alias("_cap")), "limits")
    total = s.agg(F.sum("source_size")).first()[0]
    level, full = -1.0, F.lit(False)
    while total is not None:
        full = F.col("_cap") <= F.col("_w") * F.lit(level)
        left = s.agg(F.sum(F.when(full, F.col("_cap")).otherwise(0.0)).alias("taken"), F.sum(F.when(full, 0.0).otherwise(F.col("_w"))).alias("weight")).first()
        if not left.weight:
            break
        now = (float(total) * share - left.taken) / left.weight
        if now <= level:
            break
        level = now
    return s.select("source", "source_size", F.when(full, F.col("_cap")).otherwise(F.least(F.col("_cap"), F.col("_w") * F.lit(level))).alias("target"))


def _cuts(slim: DataFrame, sources: DataFrame) -> DataFrame:
    """For each source (_id): its target, complete epochs, and the (key, row) at which the documents that are taken once more end.

    ``slim`` has _id, size, _key and _row. A document is taken once more if the middle of its words lies within the rest of the budget.
    """
    epochs = F.coalesce(F.floor(F.try_divide(F.col("target"), F.col("source_size"))), F.lit(0)).cast("long")
    s = sources.select(F.coalesce(F.concat(F.lit("s"), F.col("source")), F.lit("")).alias("_id"), "source_size", "target", epochs.alias("_epochs"))
    s = scratch.written(s.withColumn("_rest", F.col("target") - F.col("_epochs") * F.col("source_size")), "budgets")
    few = is_small(s)
    # where the cut lies: keys from _low on, 2 ** _bits of them, with _before words in front
    state = s.select("_id", "_rest", F.lit(0).cast("long").alias("_low"), F.lit(0).cast("long").alias("_before"))
    bits, inside = KEY_BITS, slim.select("_id", "size", "_key", "_row")
    while True:
        now = F.broadcast(state) if few else state
        mine = (F.col("_key") >= F.col("_low")) & (F.shiftright(F.col("_key") - F.col("_low"), bits) == 0)
        inside = slim.select("_id", "size", "_key", "_row").join(now, "_id").where(mine)
        bits = max(bits - SLICE_BITS, 0)
        sums = inside.groupBy("_id", F.shiftright(F.col("_key") - F.col("_low"), bits).alias("_slice")).agg(F.sum("size").alias("_n"), F.count(F.lit(1)).alias("_rows"), F.first("_rest").alias("_rest"), F.first("_low").alias("_low"), F.first("_before").alias("_before"))
        upto = F.col("_before") + F.sum("_n").over(W.partitionBy("_id").orderBy("_slice"))
        found = sums.withColumn("_upto", upto).where(F.col("_upto") > F.col("_rest"))
        first = F.min_by(F.struct("_slice", "_rest", "_low", (F.col("_upto") - F.col("_n")).alias("_before"), "_rows"), "_slice")
        found = found.groupBy("_id").agg(first.alias("_f")).select("_id", "_f.*")
        low = F.col("_low") + F.shiftleft(F.col("_slice"), bits)
        state = scratch.written(found.select("_id", "_rest", low.alias("_low"), "_before", "_rows"), "search")
        most = state.agg(F.max("_rows")).first()[0]
        state = state.drop("_rows")
        if not most or most <= LEAF or not bits:
            break
    now = F.broadcast(state) if few else state
    inside = slim.select("_id", "size", "_key", "_row").join(now, "_id").where((F.col("_key") >= F.col("_low")) & (F.shiftright(F.col("_key") - F.col("_low"), bits) == 0))
    so_far = F.sum("size").over(W.partitionBy("_id").orderBy("_key", "_row").rowsBetween(W.unboundedPreceding, -1))
    middle = F.col("_before") + F.coalesce(so_far, F.lit(0)) + F.col("size") / 2
    left = inside.withColumn("_at", middle).where(F.col("_at") > F.col("_rest")).groupBy("_id").agg(F.min(F.struct("_key", "_row")).alias("_first"))
    # a source whose last slice is taken whole ends behind that slice, one without a slice takes all
    behind = F.when(F.col("_low").isNotNull(), F.col("_low") + F.lit((1 << bits) - 1)).otherwise(F.lit((1 << 63) - 1))
    return s.join(state.select("_id", "_low"), "_id", "left").join(left, "_id", "left").select(
        "_id", "source_size", "target", "_epochs",
        F.coalesce("_first._key", behind).alias("_cut_key"), F.coalesce("_first._row", F.lit((1 << 63) - 1)).alias("_cut_row"),
    )


def mix(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source",
    weights: Sequence[float] = (3, 1, 2), share: float = 1.5, most: float = 2.0, seed: int = 20240229, keep: Sequence[str] = (),
) -> DataFrame:
    """One row for each row of ``docs``: the id, ``size`` (words), ``source_size``, ``target``, ``copies``, ``taken``, and ``row``, a structure of the columns named in ``keep``.

    ``copies`` says how often the mix holds the document, ``taken`` = ``copies`` * ``size``. ``most`` limits a source to
    that many times its size; no document is taken more often than that, rounded up.

    * null and blank texts: size 0, they go with their source's epochs; a source without words has target 0;
    * null sources: one source of their own, the last; null ids: hashed like any other value;
    * repeated rows: each is a document of its own; which of them are taken once more is decided by their numbers;
    * an empty table: an empty result; very long texts: whole, they only count with their size;
    * the rows of the result depend on ids, texts, sources and ``seed`` alone, so reruns agree, up to which of several equal rows
      is the one that is taken.
    """
    text = F.col(text_col)
    identity = F.coalesce(F.concat(F.lit("s"), F.col(source_col).cast("string")), F.lit(""))
    row = [F.struct(*keep).alias("row")] if keep else []
    facts = docs.select(F.col(id_col).alias("_doc"), *row, identity.alias("_id"), F.col(source_col).cast("string").alias("_source"), text.alias("_text"), F.monotonically_increasing_id().alias("_row"))
    weighed = sampling_key([F.col("_doc"), F.col("_text")], quality_weight(F.col("_text")), seed, F.col("_row"))
    facts = facts.select("_doc", *(["row"] if keep else []), "_id", "_source", count_words(F.col("_text")).alias("size"), weighed.alias("_key"), "_row")
    facts = scratch.written(facts, "sizes")
    slim = facts.drop("row", "_doc")
    sizes = slim.groupBy(F.col("_source").alias("source")).agg(F.sum("size").alias("source_size"))
    cuts = scratch.written(_cuts(slim, targets(sizes, weights, share, most)), "cuts")
    out = facts.join(F.broadcast(cuts) if is_small(cuts) else cuts, "_id")
    again = (F.col("_key") < F.col("_cut_key")) | ((F.col("_key") == F.col("_cut_key")) & (F.col("_row") < F.col("_cut_row")))
    copies = F.least(F.col("_epochs") + again.cast("long"), F.lit(math.ceil(most)).cast("long"))
    return out.select(F.col("_doc").alias(id_col), "size", "source_size", "target", copies.alias("copies"), (copies * F.col("size")).alias("taken"), *(["row"] if keep else []))
