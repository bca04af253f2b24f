"""URL filters by a path-template tree, in DataFrame functions only.

Rules decide first. Their verdicts are also the labels from which the tree learns: level by level, the segments
below a node either stay branches of their own or are generalised to a wildcard, because they vary (many of them,
each rare) or because their labels don't differ significantly from their siblings'. A template is rejected by its
share of blocked labels, smoothed towards its host's share, which is smoothed towards the share of all.

The tree grows on the distinct paths of a host and their counts, to whatever depth they have; pages are read once to count
them and once to get their path's template. A node leaves the work as soon as nothing below it depends on counts: one path
alone keeps its segments, and without labels no siblings differ, so each further level is the one segment that all
paths have there, or a wildcard.
"""

from __future__ import annotations

import itertools
from collections.abc import Sequence
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import scratch
from .common import is_small

#: Distinct paths up to which their verdicts are broadcast to the pages.
SMALL_PATHS = 50_000


@dataclass(frozen=True)
class Rule:
    """``pattern`` is a host and the beginning of a path, like ``example.org/es/``; it fits subdomains too."""

    pattern: str
    allow: bool


@dataclass(frozen=True)
class TreeSettings:
    """min_children, max_child_share: a segment is variable if it has more siblings and a smaller share of their rows.
    z: branches whose blocked share lies within so many standard errors of all siblings' are merged.
    strength: labels that the smoothing prior counts as. reject: smoothed blocked share from which a template is rejected.
    """

    min_children: int = 20
    max_child_share: float = 0.05
    z: float = 1.96
    strength: float = 4.0
    reject: float = 0.8


def host_and_path(url: Column) -> tuple[Column, Column]:
    """Host (A-Z lower-cased) and path; both empty for null and for texts without ``://``."""
    url = F.coalesce(url.cast("string"), F.lit(""))
    at = F.locate("://", url)
    rest = F.when(at > 0, F.substring(url, at + 3, F.length(url))).otherwise(F.lit(""))
    raw = F.regexp_extract(rest, "^[^/?#]*", 0)
    path = F.regexp_extract(F.substring(rest, F.length(raw) + 1, F.length(rest)), "^[^?#]*", 0)
    return F.translate(raw, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"), path


def matched_rule(host: Column, path: Column, rules: Sequence[Rule]) -> Column:
    """The longest pattern that fits, else null. The rules are a list of the caller's, so one expression holds them."""
    found = F.lit(None).cast("string")
    for rule in sorted(rules, key=lambda r: (len(r.pattern), r.pattern)):
        name, slash, rest = rule.pattern.partition("/")
        fits = (host == name) | F.endswith(host, F.lit(f".{name}"))
        found = F.when(fits & F.startswith(path, F.lit(slash + rest)), F.lit(rule.pattern)).otherwise(found)
    return found


def judge_urls(pages: DataFrame, rules: Sequence[Rule], id_col: str = "page_id", url_col: str = "url", settings: TreeSettings = TreeSettings()) -> DataFrame:
    """One row for each row of ``pages``: the id, ``host``, ``path``, ``rule``, ``template``, ``blocked_share``, ``verdict``.

    ``verdict`` is the rule's, else ``block`` for pages of a rejected template, else ``allow``.

    * null urls and urls without ``://``: empty host and path, an empty template, judged like any other;
    * null ids and repeated rows: kept, row for row, and counted each; an empty table: an empty result;
    * very long urls: whole, every segment is a level of the tree;
    * without labels on a host its templates have the share of all labels, without any label 0; a template that holds
      no label itself is never rejected;
    * other columns are not read, so their names can't clash.
    """
    host, path = host_and_path(F.col(url_col))
    parsed = pages.select(F.col(id_col).alias("_page"), host.alias("host"), path.alias("path"))
    parsed = scratch.written(parsed.withColumn("rule", matched_rule(F.col("host"), F.col("path"), rules)), "urls")
    blocking = [r.pattern for r in rules if not r.allow]
    label = F.when(F.col("rule").isNotNull(), F.col("rule").isin(blocking).cast("int") if blocking else F.lit(0))
    paths = parsed.groupBy("host", "path").agg(F.count(F.lit(1)).alias("_n"), F.sum(label).alias("_k"), F.count(label).alias("_m"))
    level = scratch.written(path_templates(paths, settings), "templates")

    counts = level.groupBy("host", "template").agg(F.sum("_k").alias("_k"), F.sum("_m").alias("_m"))
    hosts = counts.groupBy(F.col("host").alias("_h")).agg(F.sum("_k").alias("_hk"), F.sum("_m").alias("_hm"))
    known = hosts.agg(F.sum("_hk").alias("k"), F.sum("_hm").alias("m")).first()  # two numbers for all hosts
    overall = F.lit(known.k / known.m if known.m else 0.0)
    smooth = lambda k, m, prior: (F.coalesce(k, F.lit(0)) + prior * settings.strength) / (m + settings.strength)
    hosts = hosts.select("_h", smooth(F.col("_hk"), F.col("_hm"), overall).alias("_prior"))
    shares = counts.join(hosts, F.col("host") == F.col("_h")).select(
        F.col("host").alias("_h"), F.col("template").alias("_t"), smooth(F.col("_k"), F.col("_m"), F.col("_prior")).alias("blocked_share"), (F.col("_m") > 0).alias("_seen")
    )
    judged = level.join(shares, (F.col("host") == F.col("_h")) & (F.col("template") == F.col("_t")))
    judged = scratch.written(judged.select(F.col("host").alias("_h"), F.col("path").alias("_t"), "template", "blocked_share", "_seen"), "judged")
    rows = parsed.join(F.broadcast(judged) if is_small(judged, SMALL_PATHS) else judged, (F.col("host") == F.col("_h")) & (F.col("path") == F.col("_t")), "left")
    by_rule = F.when(F.col("rule").isNotNull(), F.when(F.col("rule").isin(blocking), "block").otherwise("allow") if blocking else F.lit("allow"))
    by_tree = F.when((F.col("blocked_share") >= settings.reject) & F.col("_seen"), "block").otherwise("allow")
    return rows.select(F.col("_page").alias(id_col), "host", "path", "rule", "template", "blocked_share", F.coalesce(by_rule, by_tree).alias("verdict"))


def path_templates(paths: DataFrame, settings: TreeSettings = TreeSettings()) -> DataFrame:
    """``paths`` (host, path, _n: pages, _m: those with a label, _k: those whose label is 1; host and path distinct) with ``template``."""
    whole = F.split(F.replace(F.regexp_replace("path", "^/", ""), F.lit("*"), F.lit("%2A")), "/", -1)
    segments = F.when(F.col("path") != "", whole).otherwise(F.array().cast("array<string>"))
    columns = ["host", "path", "_n", "_k", "_m", "template"]
    left = scratch.written(paths.withColumns({"_segs": segments, "template": F.lit("")}), "level")
    done: list[DataFrame] = []
    for depth in itertools.count():
        done.append(left.where(F.size("_segs") <= depth).select(columns))
        left = left.where(F.size("_segs") > depth)
        nodes = left.groupBy("host", "template").agg(F.count(F.lit(1)).alias("_paths"), F.sum("_m").alias("_labels"))
        nodes = scratch.written(nodes, "nodes")
        if nodes.isEmpty():
            break
        placed = scratch.written(left.join(_offered(nodes), ["host", "template"]), "placed")
        rest = F.slice("_segs", depth + 1, F.size("_segs") - depth)
        single = placed.where("_paths = 1").withColumn("template", F.concat("template", F.lit("/"), F.array_join(rest, "/")))
        done.append(single.select(columns))
        done.append(_unlabelled(placed.where("_paths > 1 AND _labels = 0"), depth).select(columns))
        left = scratch.written(_generalised(placed.where("_paths > 1 AND _labels > 0").drop("_paths", "_labels"), depth, settings), "level")
    return reduce(DataFrame.unionByName, done)


def _offered(nodes: DataFrame) -> DataFrame:
    """A written table of nodes or branches, to be broadcast if it is small: then the paths of a host needn't meet in one task."""
    return F.broadcast(nodes) if is_small(nodes) else nodes


def _unlabelled(left: DataFrame, depth: int) -> DataFrame:
    """``template`` extended by all segments from ``depth`` on, for nodes without labels: the segment that all their paths have there, or the wildcard."""
    at = left.select(F.col("host").alias("_h"), F.col("template").alias("_t"), F.posexplode(F.slice("_segs", depth + 1, F.size("_segs") - depth)).alias("_i", "_seg"))
    steps = at.groupBy("_h", "_t", "_i").agg(F.min("_seg").alias("_least"), F.max("_seg").alias("_most"))
    step = F.when(F.col("_least") == F.col("_most"), F.col("_least")).otherwise(F.lit("*"))
    # as many steps as the longest path below the node has segments
    lists = steps.groupBy("_h", "_t").agg(F.transform(F.array_sort(F.collect_list(F.struct("_i", step.alias("_s")))), lambda x: x["_s"]).alias("_steps"))
    joined = left.join(lists, (F.col("host") == F.col("_h")) & (F.col("template") == F.col("_t")))
    return joined.withColumn("template", F.concat("template", F.lit("/"), F.array_join(F.slice("_steps", 1, F.size("_segs") - depth), "/")))


def _generalised(left: DataFrame, depth: int, settings: TreeSettings) -> DataFrame:
    """``template`` extended by the segment at ``depth``: itself if it stays a branch, else the wildcard."""
    at = left.withColumn("_seg", F.get("_segs", F.lit(depth)))
    kids = scratch.written(at.groupBy("host", "template", "_seg").agg(F.sum("_n").alias("_n"), F.sum("_k").alias("_k"), F.sum("_m").alias("_m")), "kids")
    parents = kids.groupBy("host", "template").agg(F.count(F.lit(1)).alias("_kids"), F.sum("_n").alias("_pn"), F.sum("_k").alias("_pk"), F.sum("_m").alias("_pm"))
    share = (F.coalesce(F.col("_pk"), F.lit(0)) + 1) / (F.col("_pm") + 2)
    variable = (F.col("_kids") > settings.min_children) & (F.col("_n") < settings.max_child_share * F.col("_pn"))
    error = F.sqrt(share * (1 - share) / F.greatest(F.col("_m"), F.lit(1)))
    alike = (F.col("_m") == 0) | (F.abs(F.try_divide(F.col("_k").cast("double"), F.col("_m")) - share) <= settings.z * error)
    branches = kids.join(_offered(scratch.written(parents, "parents")), ["host", "template"]).where(~variable & (~alike | (F.col("_kids") == 1)))
    # at most max(min_children, 1 / max_child_share) branches a node
    branches = scratch.written(branches.select("host", "template", "_seg", F.col("_seg").alias("_s")), "branches")
    joined = at.join(_offered(branches), ["host", "template", "_seg"], "left")
    return joined.withColumn("template", F.concat("template", F.lit("/"), F.coalesce("_s", F.lit("*")))).drop("_seg", "_s")
