"""Runs over several operators: the whole blocking run, its checks, state alignment, the evaluation of cleaning and of the matcher."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessella.functions import text as T
from tessella.operators import blocking_metrics, decision, features, lookup, model, ordering, profile, vectors
from tessella.operators import candidates as C
from tessella.sources.stored import written

PAIR = ["s1_id", "cand_id"]


@dataclass(frozen=True)
class Blocking:
    """m: rows by rare n-grams that the exact cosine orders, k: those that stay, for the record, name and reverse pass.
    rare, least: a gram is rare within that share of a country's records, or that many. max_block, reverse_cap: of the key and reverse pass.
    """

    m: tuple[int, int, int] = (300, 300, 100)
    k: tuple[int, int, int] = (features.K1, features.K2, features.K4)
    rare: float = 0.005
    least: int = 20
    max_block: int = 20
    reverse_cap: int = 100


def record_text() -> Column:
    return F.concat_ws(" ", "name_core", "addr_core")


def sides(table: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Queries and pool of a table with entity_id."""
    asks = F.startswith("entity_id", F.lit("S1-"))
    return table.where(asks), table.where(~asks)


def block(s1: DataFrame, pool: DataFrame, how: Blocking = Blocking()) -> DataFrame:
    """The candidate table of cleaned records: the pairs of all four passes with ranks, flags and both cosines.

    Record and name pass look for the nearest pool records of a query, the reverse pass for the nearest queries of a pool record, the
    key pass joins on address keys; all stay within a country. Cosines that a pass didn't compute are filled. The table
    is the selection of the final depths, with the reverse pass capped for each query. ``s1`` and ``pool`` are read several times.
    """
    needed = ["entity_id", "country", "name_core", "name_nospace", "name_domain_stem", "addr_core", "addr_house_number", "addr_state_canon"]
    both = s1.select(*needed).unionByName(pool.select(*needed))
    whole = vectors.weigh(both, record_text(), how.rare, how.least)
    names = vectors.weigh(both, C.name_text(), how.rare, how.least)
    keyed = C.p3_keys(both.select("entity_id", "country", F.col("addr_core").alias("name"), F.col("addr_house_number").alias("house"), F.col("addr_state_canon").alias("state")))
    keys_q, keys_p = sides(keyed)
    pairs = C.candidate_union(
        vectors.retrieve(whole, *whole.sides(), how.m[0], how.k[0]).withColumnsRenamed({"rank": "p1_rank", "cosine": "p1_cos"}),
        vectors.retrieve(names, *names.sides(), how.m[1], how.k[1]).withColumnsRenamed({"rank": "p2_rank", "cosine": "p2_cos"}), C.p3_key_join(keys_q, keys_p, how.max_block),
        vectors.reverse_retrieve(whole, *whole.sides(), how.m[2], how.k[2]).withColumnsRenamed({"rank_rev": "p1_rank_rev", "cosine": "p1_cos"}), ["p1_cos", "p2_cos"],
    )
    countries = sides(both)[0].select(F.col("entity_id").alias("s1_id"), "country")
    n = countries.agg(F.count(F.lit(1)).alias("rows"), F.countDistinct("s1_id").alias("ids")).first()
    located = lambda df: df.join(F.broadcast(countries) if n.rows <= vectors.FEW else countries, "s1_id")
    if n.rows > n.ids or whole.several or names.several:  # pairs of such ids take their rows last, and the reverse pass's cap their whole cosines
        pairs = vectors.filled(whole, written(pairs, "pairs", compression="zstd"), "p1_cos", *whole.sides())
        chosen = written(C.select_k(pairs, *how.k, how.reverse_cap), "chosen", compression="zstd")
        return located(vectors.filled(names, chosen, "p2_cos", *names.sides()))
    # the cap on the reverse pass goes by cosines that the pass brings
    chosen = written(located(C.select_k(pairs, *how.k, how.reverse_cap)), "chosen", compression="zstd")
    chosen = written(vectors.filled(whole, chosen, "p1_cos", *whole.sides()), "filled", compression="zstd")
    return vectors.filled(names, chosen, "p2_cos", *names.sides())


def exact_check(grams: vectors.Grams, queries: DataFrame, pool: DataFrame, m: int, k: int) -> DataFrame:
    """(k, queries, exact, found, recall): of the pairs that belong to the ``k`` nearest by cosine over all grams, those that rare grams retrieve.

    ``queries`` and ``pool`` are rows of the texts of ``grams``; the exact side scores every query against all of its country's pool.
    """
    exact = vectors.nearest_by_all(grams, queries, pool, k)
    found = vectors.retrieve(grams, queries, pool, m, k).select(*PAIR, F.lit(1).alias("hit"))
    both = exact.select(*PAIR).join(found, PAIR, "left")
    return both.agg(
        F.lit(k).alias("k"), F.countDistinct("s1_id").alias("queries"), F.count(F.lit(1)).alias("exact"), F.count("hit").alias("found"), F.avg(F.coalesce("hit", F.lit(0)).cast("double")).alias("recall")
    )


def pool_experiment(records: DataFrame, text: Column, truth: DataFrame, shares: Sequence[int], m: int, k: int, how: Blocking = Blocking()) -> DataFrame:
    """(pool_share, true_pairs, found, recall) when only ``shares`` thousandths of the pool are searched, weighed by the whole pool's grams."""
    whole = vectors.weigh(records, text, how.rare, how.least)
    q, p = whole.sides()
    out = None
    for share in shares:
        there = F.pmod(F.xxhash64("entity_id"), F.lit(1000)) < share
        found = vectors.retrieve(whole, q, p.where(there), m, k).select(*PAIR, F.lit(1).alias("hit"))
        asked = truth.where(F.pmod(F.xxhash64("cand_id"), F.lit(1000)) < share).select(*PAIR)
        row = asked.join(found, PAIR, "left").agg(F.lit(share).alias("pool_share"), F.count(F.lit(1)).alias("true_pairs"), F.count("hit").alias("found"), F.avg(F.coalesce("hit", F.lit(0)).cast("double")).alias("recall"))
        out = row if out is None else out.unionByName(row)
    return out


def aligned_states(pairs: DataFrame, records: DataFrame) -> DataFrame:
    """(country, canonical, variant): the states that both records of true pairs (s1_id, cand_id) name, of queries and of their matches."""
    state = records.where("addr_state_raw IS NOT NULL AND NOT contains(addr_state_raw, ',')")
    mine = state.select(F.col("entity_id").alias("s1_id"), "country", F.col("addr_state_raw").alias("canonical"))
    other = state.select(F.col("entity_id").alias("cand_id"), F.col("addr_state_raw").alias("variant"))
    return pairs.select(*PAIR).join(mine, "s1_id").join(other, "cand_id").select("country", "canonical", "variant")


def learning_facts(aligned: DataFrame, train_ids: DataFrame, **more: str) -> dict[str, str]:
    """Where a learned table comes from, for its manifest: the number of pairs and a digest of the training ids that no order changes."""
    digest = train_ids.select(F.bit_xor(F.xxhash64(train_ids.columns[0])).alias("x"), F.count(F.lit(1)).alias("n")).first()
    return {"n_training_pairs": str(aligned.count()), "train_ids": str(digest.n), "train_ids_xor": f"{(digest.x or 0) & (1 << 64) - 1:016x}", **more}


def hard_negatives(s1: DataFrame, pool: DataFrame, truth: DataFrame, per_key: int = 5, salt: str = "hard") -> DataFrame:
    """Pairs (s1_id, cand_id, country) of equal country and core name that aren't true, with at most ``per_key`` pool records for each name."""
    keyed = pool.withColumn("_key", F.concat_ws("|", "country", "name_core"))
    few = ordering.sample_per_group(keyed.select("entity_id", "country", "name_core", "_key"), "_key", "entity_id", per_key, salt)
    pairs = s1.select(F.col("entity_id").alias("s1_id"), "country", "name_core").join(few.select(F.col("entity_id").alias("cand_id"), "country", "name_core"), ["country", "name_core"])
    return pairs.join(truth.select(*PAIR), PAIR, "left_anti").select(*PAIR, "country")


def house(address: Column) -> Column:
    return F.nullif(F.regexp_extract(address, r"(\d+)", 1), F.lit(""))


def cleaning_signals() -> dict[str, Column]:
    """23 signals of a pair with both sides' raw and cleaned columns (a_, b_): equal names, legal conflicts, house numbers, address overlaps."""
    a, b = (lambda c: F.col(f"a_{c}")), (lambda c: F.col(f"b_{c}"))
    basic = T.basic_norm
    both_forms = (F.size(a("legal_families")) > 0) & (F.size(b("legal_families")) > 0)
    both_classes = (a("legal_suffix_class") != "NONE") & (b("legal_suffix_class") != "NONE")
    first = lambda x: F.nullif(F.regexp_extract(basic(x), r"(?:^| )(\d\S*)", 1), F.lit(""))
    houses = {
        "raw": T.house_bucket(house(a("business_address")), house(b("business_address"))), "basic": T.house_bucket(first(a("business_address")), first(b("business_address"))),
        "clean": T.house_bucket(a("addr_house_number"), b("addr_house_number")),
    }
    addressed = a("addr_core").isNotNull() & b("addr_core").isNotNull()
    overlap = lambda x, y: F.when(addressed, T.jaccard(features.tokens(x), features.tokens(y)))
    return {
        "name_eq_raw": a("business_name") == b("business_name"), "name_eq_basic": basic(a("business_name")) == basic(b("business_name")),
        "name_eq_core": a("name_core") == b("name_core"), "name_eq_nospace": a("name_nospace") == b("name_nospace"),
        "legal_conflict_families": both_forms & ~F.arrays_overlap(a("legal_families"), b("legal_families")),
        "legal_conflict_class": both_classes & (a("legal_suffix_class") != b("legal_suffix_class")),
        **{f"house_{version}_{bucket}": found == bucket for bucket in ("exact", "small_gap", "big_gap", "missing") for version, found in houses.items()},
        "jacc_raw": overlap(a("business_address"), b("business_address")), "jacc_basic": overlap(basic(a("business_address")), basic(b("business_address"))),
        **{f"jacc_{c}": overlap(a(c), b(c)) for c in ("addr_clean", "addr_std", "addr_core")},
    }


#: Pairs of signals: with a cleaning rule and without it.
ABLATIONS = {
    "state slot": ("jacc_addr_core", "jacc_addr_std"), "standard words": ("jacc_addr_std", "jacc_addr_clean"), "legal forms anywhere": ("legal_conflict_families", "legal_conflict_class"),
    "core name": ("name_eq_core", "name_eq_basic"), "house number": ("house_clean_exact", "house_basic_exact"), "core address": ("jacc_addr_core", "jacc_basic"),
}


def cleaning_evaluation(true_pairs: DataFrame, negatives: DataFrame, records: DataFrame) -> DataFrame:
    """(country, signal, gap): how much more often each signal holds for true pairs than for hard negatives."""
    labelled = true_pairs.select(*PAIR, "country", F.lit(True).alias("is_true")).unionByName(negatives.select(*PAIR, "country", F.lit(False).alias("is_true")))
    side = lambda p, key: records.drop("country").select(*[F.col(c).alias(key if c == "entity_id" else f"{p}_{c}") for c in records.columns if c != "country"])
    signals = cleaning_signals()
    rates = profile.signal_rates(labelled.join(side("a", "s1_id"), "s1_id").join(side("b", "cand_id"), "cand_id"), ["country", "is_true"], **signals)
    return profile.rate_gaps(rates, "country", "is_true", list(signals))


def ablations(gaps: DataFrame) -> DataFrame:
    """(country, rule, gap_on, gap_off, narrows) for each cleaning rule: whether the signals say less with it than without."""
    value = lambda c: F.max(F.when(F.col("signal") == c, F.col("gap")))
    wide = gaps.groupBy("country").agg(*[value(c).alias(f"{k}|{side}") for k, pair in ABLATIONS.items() for side, c in zip(("on", "off"), pair, strict=True)])
    rows = F.array(*[F.struct(F.lit(k).alias("rule"), F.col(f"{k}|on").alias("gap_on"), F.col(f"{k}|off").alias("gap_off")) for k in ABLATIONS])
    long = wide.select("country", F.explode(rows).alias("x")).select("country", "x.*")
    return long.withColumn("narrows", F.abs("gap_on") < F.abs("gap_off") - 1e-4)


def cross_country(rows: DataFrame, columns: Sequence[str], countries: Sequence[str], queries: DataFrame, truth: DataFrame, **how: int) -> DataFrame:
    """(trained_on, tested_on, threshold_pct, macro_f05): a matcher learned on one country's pairs, its threshold chosen there, applied to another's."""
    out = None
    for home in countries:
        mine = rows.where(F.col("country") == home)
        fitted = model.train(mine, columns, **how)
        scored = written(model.score(fitted, rows, columns, ["s1_id", "cand_id", "country"]), "scored")
        of = lambda df, country: df.where(F.col("country") == country)  # noqa: B023, E731
        best = decision.best_threshold(decision.threshold_search(of(scored, home).drop("country"), of(queries, home), of(truth, home))).first()
        for away in countries:
            matches = decision.decide(of(scored, away).drop("country"), best.threshold_pct / 100)
            macro = decision.macro_f05(decision.per_s1_f05(matches, of(queries, away).select("s1_id"), of(truth, away)))
            row = macro.select(F.lit(home).alias("trained_on"), F.lit(away).alias("tested_on"), F.lit(best.threshold_pct).alias("threshold_pct"), "macro_f05")
            out = row if out is None else out.unionByName(row)
    return out


def blocking_report(cands: DataFrame, queries: DataFrame, truth: DataFrame) -> DataFrame:
    """Recall and size of a candidate table in one row."""
    from tessella.operators.reports import side_by_side

    return side_by_side(blocking_metrics.blocking_recall(cands, truth), blocking_metrics.cand_stats(cands, queries))


def learned_states(records: DataFrame, truth: DataFrame, min_n: int = 100, min_share: float = 0.9, countries: Sequence[str] | None = None) -> DataFrame:
    """``records`` with addr_state_canon by a mapping learned from the true pairs; a row stays a row."""
    mapping = lookup.learn_mapping(aligned_states(truth, records), min_n, min_share, countries)
    return lookup.apply_mapping(records, written(mapping, "states"), "addr_state_raw", "addr_state_canon")
