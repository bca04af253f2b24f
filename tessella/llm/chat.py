"""Chat formatting in budgeted windows, in DataFrame functions only.

A conversation becomes windows of at most a given number of tokens. Each holds the system turn, some history repeated
from before, then the longest run of new turns that fits what these two leave; prefix sums of the turns' tokens tell how
far that run goes and how much history there is. Only assistant turns of the run are targets, so what a later window
repeats is masked there, and each target counts once over all windows.

Template: ``<|im_start|>role\\ntext<|im_end|>\\n`` for each turn. In roles and texts ``&`` becomes ``&amp;`` and
``<|`` becomes ``&lt;|`` (and a line feed in a role ``&#10;``), so control strings only stand where the template puts them and
texts are got back exactly.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from . import scratch

START, END = "<|im_start|>", "<|im_end|>\n"


@dataclass(frozen=True)
class Windows:
    """window_tokens: of a window at most, unless the system turn and one new turn alone have more.
    history_tokens: of turns that are repeated before the new ones, at most; none are where the first new turn would not fit then.
    turn_overhead: tokens that the template adds to each turn.
    """

    window_tokens: int = 512
    history_tokens: int = 128
    turn_overhead: int = 4


def escaped(text: Column) -> Column:
    return F.replace(F.replace(text, F.lit("&"), F.lit("&amp;")), F.lit("<|"), F.lit("&lt;|"))


def unescaped(text: Column) -> Column:
    return F.replace(F.replace(text, F.lit("&lt;|"), F.lit("<|")), F.lit("&amp;"), F.lit("&"))


def escaped_role(role: Column) -> Column:
    return F.replace(escaped(role), F.lit("\n"), F.lit("&#10;"))


def unescaped_role(role: Column) -> Column:
    return unescaped(F.replace(role, F.lit("&#10;"), F.lit("\n")))


def turn_tokens(text: Column, overhead: int) -> Column:
    """An estimate without a tokenizer: a token for each four bytes, and the template's."""
    return (F.ceil(F.octet_length(text) / 4) + overhead).cast("long")


def format_windows(
    turns: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text", settings: Windows = Windows()
) -> DataFrame:
    """One row for each window: conversation, ``window`` (from 0), ``text``, ``n_repeated`` (leading turns that earlier windows had), ``n_turns``,
    ``n_tokens`` (by :func:`turn_tokens`, an estimate), ``targets`` (array of start and length, in code points of ``text``).

    ``n_tokens`` is at most ``window_tokens``, but for windows with a single new turn that doesn't fit beside the system turn.

    * null roles and texts: empty; empty texts: turns like any other, an empty target has length 0;
    * null conversation ids: one conversation; null turns come first;
    * ties and repeated rows: all kept, ordered by turn, role and text;
    * very long texts: a turn is never cut, it has a window with no other new turn;
    * an empty table: an empty result; other columns are not read.

    The windows of a conversation follow one another, so their beginnings are found in one pass over its turns' numbers; texts
    only meet them by (conversation, turn).
    """
    role, text = (F.coalesce(F.col(c).cast("string"), F.lit("")) for c in (role_col, text_col))
    key = F.coalesce(F.concat(F.lit("c"), F.col(conv_col).cast("string")), F.lit(""))  # joins nulls too
    t = turns.select(key.alias("_key"), F.col(conv_col).alias("_conv"), F.col(turn_col).alias("_turn"), role.alias("_role"), text.alias("_text"))
    ordered = W.partitionBy("_key").orderBy(F.col("_turn").asc_nulls_first(), "_role", "_text")
    t = t.withColumn("_tokens", turn_tokens(F.col("_text"), settings.turn_overhead)).withColumns(
        {"_ord": F.row_number().over(ordered), "_begin": F.coalesce(F.sum("_tokens").over(ordered.rowsBetween(W.unboundedPreceding, -1)), F.lit(0))}
    )
    t = t.withColumn("_system", (F.col("_ord") == 1) & (F.col("_role") == "system"))
    # what a window that begins with this turn would repeat: the turns before it, but the system one, that lie within the history budget
    near = W.partitionBy("_key").orderBy("_begin").rangeBetween(-settings.history_tokens, 0)
    t = t.withColumns({
        "_from": F.min(F.when(~F.col("_system"), F.col("_begin"))).over(near), "_head": F.sum(F.when(F.col("_system"), F.col("_tokens")).otherwise(0)).over(ordered),
    })
    fits = F.col("_begin") - F.col("_from") + F.col("_tokens") + F.col("_head") <= settings.window_tokens
    t = scratch.written(t.withColumn("_from", F.when(~F.col("_system") & fits, F.col("_from")).otherwise(F.col("_begin"))), "turns")

    # the first turns of windows: the one whose end lies beyond what the window before has room for
    room = lambda x: f"{x}._begin + {settings.window_tokens} - CASE WHEN {x}._ord = 1 THEN 0 ELSE {x}._head + {x}._begin - {x}._from END"
    numbers = F.array_sort(F.collect_list(F.struct("_ord", "_begin", "_tokens", "_from", "_head"))).alias("_t")
    first = F.expr(f"""aggregate(_t, struct(CAST(-1 AS BIGINT) AS upto, CAST(array() AS ARRAY<STRUCT<_ord: INT, _begin: BIGINT, _from: BIGINT>>) AS found),
        (s, x) -> CASE WHEN s.upto >= x._begin + x._tokens THEN s
                       ELSE struct(CAST({room('x')} AS BIGINT) AS upto, concat(s.found, array(struct(x._ord AS _ord, x._begin AS _begin, x._from AS _from))) AS found) END, s -> s.found)""")
    firsts = t.groupBy("_key").agg(numbers).select("_key", F.posexplode(first).alias("window", "_f")).select("_key", "window", F.col("_f._ord").alias("_ord"), F.col("_f._from").alias("_from"))
    firsts = scratch.written(firsts, "firsts")

    # a turn stands in its own window, as history in those that reach back to it, and the system turn in all
    own = t.drop("_from", "_head", "_tokens").join(firsts.select("_key", "_ord", "window"), ["_key", "_ord"], "left")
    own = own.withColumn("window", F.count("window").over(W.partitionBy("_key").orderBy("_ord")).cast("int") - 1)
    back = t.select("_key", "_ord", "_begin", "_from").join(firsts.select("_key", "_ord", "window"), ["_key", "_ord"])
    reach = _earlier(t.select("_key", "_ord", "_begin", "_system"), back)
    again = t.drop("_from", "_head", "_tokens").join(reach, ["_key", "_ord"])
    columns = ["_key", "_conv", "_ord", "_role", "_text", "window"]
    placed = own.select(*columns, F.lit(True).alias("_new")).unionByName(again.select(*columns, F.lit(False).alias("_new")))
    piece = F.concat(F.lit(START), escaped_role(F.col("_role")), F.lit("\n"), escaped(F.col("_text")), F.lit(END))
    placed = placed.select(
        "_key", "_conv", "_ord", "window", "_new", piece.alias("_piece"), turn_tokens(F.col("_text"), settings.turn_overhead).alias("_tokens"),
        (F.length(F.lit(START)) + F.length(escaped_role(F.col("_role"))) + 1).alias("_lead"), F.length(escaped(F.col("_text"))).alias("_body"),
        (F.col("_role") == "assistant").alias("_says"),
    )
    start = F.coalesce(F.sum(F.length("_piece")).over(W.partitionBy("_key", "window").orderBy("_ord").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    placed = placed.withColumn("_target", F.when(F.col("_new") & F.col("_says"), F.struct((start + F.col("_lead")).cast("long").alias("start"), F.col("_body").cast("long").alias("length"))))
    pieces = F.array_sort(F.collect_list(F.struct("_ord", "_piece", "_target")))
    made = placed.groupBy("_key", "window").agg(
        F.first("_conv").alias("_conv"), pieces.alias("_p"), F.sum((~F.col("_new")).cast("int")).alias("n_repeated"), F.count(F.lit(1)).alias("n_turns"), F.sum("_tokens").alias("n_tokens"),
    )
    return made.select(
        F.col("_conv").alias(conv_col), "window",
        F.array_join("_p._piece", "").alias("text"), "n_repeated", "n_turns", "n_tokens",
        F.array_compact("_p._target").alias("targets"),
    )


def _earlier(turns: DataFrame, back: DataFrame) -> DataFrame:
    """(_key, _ord, window) of the turns that windows repeat: ``back`` has the first turn of each window and the beginning of its history."""
    starts = turns.where("NOT _system").groupBy("_key", "_begin").agg(F.min("_ord").alias("_since"))
    history = back.where("_from < _begin").select("_key", "window", F.col("_ord").alias("_until"), F.col("_from").alias("_begin")).join(starts, ["_key", "_begin"])
    history = history.select("_key", "window", F.explode(F.sequence("_since", F.col("_until") - 1)).alias("_ord"))
    systems = turns.where("_system").select("_key").join(back.where("window > 0").select("_key", "window"), "_key")
    return history.unionByName(systems.select("_key", "window", F.lit(1).alias("_ord")))


def read_turns(windows: DataFrame, conv_col: str = "conv_id") -> DataFrame:
    """A row for each window with what its text holds: ``said`` (role, line feed, text, line feed of each turn that earlier windows
    didn't have), ``n_new``, ``loss`` (all its targets' texts), ``chars``.

    An empty table gives an empty result; windows without targets have an empty ``loss``; other columns are not read.
    """
    parts = F.filter(F.split(F.col("text"), F.lit("<\\|im_end\\|>\n")), lambda x: x != "")
    fresh = F.expr("slice(_parts, n_repeated + 1, greatest(size(_parts) - n_repeated, 0))")

    def turn(x: Column) -> Column:
        # the role's end is the first line feed: roles hold none
        head = F.substring_index(x, "\n", 1)
        body = F.substring(x, F.length(head) + 2, F.length(x))
        return F.concat(unescaped_role(F.substring(head, len(START) + 1, F.length(head))), F.lit("\n"), unescaped(body), F.lit("\n"))

    w = windows.withColumn("_parts", parts).withColumn("_fresh", fresh)
    loss = F.array_join(F.transform("targets", lambda s: unescaped(F.substring(F.col("text"), (s.start + 1).cast("int"), s.length.cast("int")))), "")
    return w.select(
        conv_col, "window",
        F.array_join(F.transform("_fresh", turn), "").alias("said"), F.size("_fresh").cast("long").alias("n_new"),
        loss.alias("loss"), F.length("text").cast("long").alias("chars"),
    )


def digests(read: DataFrame, conv_col: str = "conv_id") -> DataFrame:
    """Per conversation: n_turns, turns_sha256, loss_chars, loss_sha256, formatted_chars, over its windows in order.

    Null conversation ids are one conversation; an empty table gives an empty result. A digest is that of a conversation's whole text,
    which is therefore put together in one row.
    """
    g = read.groupBy(conv_col).agg(F.array_sort(F.collect_list(F.struct("window", "said", "loss"))).alias("_w"), F.sum("n_new").alias("n_turns"), F.sum("chars").alias("formatted_chars"))
    loss = F.array_join("_w.loss", "")
    return g.select(
        conv_col, "n_turns", F.sha2(F.array_join("_w.said", "").cast("binary"), 256).alias("turns_sha256"),
        F.length(loss).cast("long").alias("loss_chars"), F.sha2(loss.cast("binary"), 256).alias("loss_sha256"), "formatted_chars",
    )
