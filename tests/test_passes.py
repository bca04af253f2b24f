"""All four passes reach the pair features."""

from collections import Counter

import pytest

from pyspark.sql import functions as F

from tessella.functions import similarity
from tessella.operators import candidates as C
from tessella.operators import features, model, vectors
from tessella.plans import catalogue
from tessella.sources import stored
from test_linkage import brute_cosines
from test_vectors import SF, shuffled


def test_name_text(spark):
    df = spark.createDataFrame([("blue moon", "bluemoon", "bm"), ("red", "red", None)], "name_core string, name_nospace string, name_domain_stem string")
    assert [r.t for r in df.select(C.name_text().alias("t")).collect()] == ["blue moon bluemoon bm", "red"]


def test_pair_features_runs_all_passes(spark, tmp_path):
    """25 records of a street share all their address grams, so names decide there; a house number gives keys."""
    name = lambda i: " ".join(f"{c}{'abcdefghijklmnopqrstuvwxyz'[i % 26] * 3}{'qrstuvwxyz'[i // 26] * 2}" for c in "kmnprt")
    rows = [(9 * i, 0, f"{name(i)} {i % 3 + 1} maple street") for i in range(12)] + [(9 * i + 1, 0, f"{name(i)} {i + 40} maple street") for i in range(30)]
    rows += [(9 * i + 2, 0, f"{name(i + 60)} {i % 3 + 1} maple street") for i in range(6)]
    spark.createDataFrame(rows, "conv_id long, turn long, text string").coalesce(1).write.parquet(f"{tmp_path}/conversations.parquet")
    s1, pool = catalogue._entities(spark, str(tmp_path))
    records = {r.entity_id: r for r in s1.unionByName(pool).withColumn("t", C.name_text()).collect()}
    cosine = brute_cosines({e: r.t for e, r in records.items()})
    keyed = {e: {(r.addr_house_number, w) for w in (r.addr_core or "").split() if w.isalpha() and len(w) >= 4} for e, r in records.items() if r.addr_house_number}
    blocks = Counter(k for e, ks in keyed.items() if not e.startswith("S1-") for k in ks)
    want = {(a, b) for a in keyed for b in keyed if a.startswith("S1-") and not b.startswith("S1-") and any(blocks[k] <= 20 for k in keyed[a] & keyed[b])}
    got = {(r.s1_id, r.cand_id): r for r in catalogue._featured(spark, str(tmp_path)).collect()}
    assert want and {k for k, r in got.items() if r.in_p3} == want
    assert any(r.in_p2 and r.p2_rank == 1 for r in got.values())
    for k, r in got.items():
        assert r.p2_cos == pytest.approx(cosine(*k), abs=1e-5), k
        assert r.in_p2 == (r.p2_rank <= 20) and r.n_passes == r.in_p1 + r.in_p2 + r.in_p3 + r.in_p4 > 0


SMALL = "/root/testdata/sf0.001"
RECORD = "entity_id string, country string, name_core string, name_nospace string, name_domain_stem string, name_script string, legal_families array<string>, name_has_nonlatin boolean, addr_core string, addr_house_number string, addr_state_canon string, addr_numbers array<string>, chain_n long"
CANDIDATE = "s1_id string, cand_id string, country string, in_p1 boolean, in_p2 boolean, in_p3 boolean, in_p4 boolean, p1_cos double, p2_cos double, p1_rank int, p2_rank int, p1_rank_rev int"


def plain_features(pairs, s1, pool):
    """By joins, column expressions and a function of two names."""
    both = features.attach(pairs, s1, pool)
    named = {c: F.udf(f, "float")("a_name_core", "b_name_core") for c, f in (("name_tsr", similarity.token_set_ratio), ("name_jw", similarity.jaro_winkler))}
    made = {**named, **features.name_features(), **features.address_features(), **features.blocking_features()}
    return both.select("s1_id", "cand_id", *[c.alias(n) for n, c in made.items()])


def test_features_from_workers(spark, monkeypatch):
    """Null, empty, short, repeated and wide texts, ids with several rows, ties and missing cosines, sets in many blocks."""
    names = ["blue moon", "", None, "a", "ab", "abab abab", "été 東京都", "\U0001f600\U0001f601\U0001f600\U0001f601", "moon  blue ", "blue"]
    streets = ["12 main street", None, "", " ", "x", "main main 12", "東京都庁 12", "12 main street 12 main street"]
    record = lambda e, i: (e, "X", names[i % 10], "bluemoon" if i % 3 else None, "bluemoon" if i % 2 else None, "Latin" if i % 4 else None, [["SARL"], [], None, ["SAS", "SARL"]][i % 4], bool(i % 2), streets[i % 8], [None, "12", "1-2", "x"][i % 4], [None, "tx", "ca"][i % 3], [None, [], ["12", "12", "3"], ["3"]][i % 4], i % 3 or None)
    s1 = spark.createDataFrame([record(f"S1-{i % 20}", i) for i in range(23)], RECORD)
    pool = spark.createDataFrame([record(f"S{2 + i % 2}-{i % 38}", i * 7) for i in range(40)], RECORD)
    found = {(f"S1-{i % 20}", f"S{2 + j % 2}-{j}") for i in range(20) for j in range(38) if (i * j) % 3}
    cosine = lambda i: [None, 0.5, 0.25, 0.5, float("nan"), -0.0, 0.0, 0.75][i % 8]
    pairs = spark.createDataFrame([(a, b, "X", bool(i % 2), bool(i % 3), None, True, cosine(i), cosine(i * 5 + 1), i % 4 or None, None, 1) for i, (a, b) in enumerate(sorted(found))], CANDIDATE)
    monkeypatch.setattr(vectors, "TOLD", 50)
    monkeypatch.setattr(features, "LETTERS", 40)
    columns = plain_features(pairs, s1, pool).columns
    rows = lambda df: sorted(map(repr, df.select(columns).collect()))
    want = rows(plain_features(pairs, s1, pool))
    assert len(want) > len(found) and rows(features.pair_features(pairs, s1, pool)) == want
    kept = features.pair_features(pairs.withColumn("label", F.lit(3)), s1, pool, ["label"])
    assert len(kept.columns) == 3 + 48 + 1 and kept.where("label = 3").count() == len(want)
    none = features.pair_features(pairs.limit(0), s1, pool)
    assert none.count() == 0 and none.columns == features.pair_features(pairs, s1, pool).columns
    with pytest.raises(Exception, match="no record for pair"):
        features.pair_features(pairs, s1.limit(0), pool).collect()


def test_features_move_no_pairs(spark):
    """Only counts are shuffled, where joins and windows took every pair with the sets of both sides."""
    pairs, s1, pool = catalogue._blocked(spark, SF)
    pairs = vectors.written(pairs, "pairs")
    before = shuffled(spark)
    assert len(features.pair_features(pairs, s1, pool).collect()) == pairs.count() > 10_000
    assert shuffled(spark) - before < 100_000


@pytest.mark.parametrize("few", [200_000, 0])
def test_labels_move_no_rows(spark, monkeypatch, few):
    """Whatever Spark broadcasts by itself; with more true pairs than are broadcast the labels are the same."""
    monkeypatch.setattr(model, "FEW", few)
    rows = vectors.written(spark.range(5000).select(F.format_string("S1-%s", F.col("id") % 50).alias("s1_id"), F.format_string("S2-%s", "id").alias("cand_id"), F.sha2(F.col("id").cast("string"), 512).alias("x")), "rows")
    truth = rows.where("cand_id LIKE '%7'").select("s1_id", "cand_id").unionByName(spark.createDataFrame([("S1-1", "S2-7777"), ("S1-7", "S2-7")], "s1_id string, cand_id string"))
    held = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        before = shuffled(spark)
        got = model.labelled(rows, truth).collect()
        assert not few or shuffled(spark) - before < 50_000
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", held)
    assert len(got) == 5000 and all(r.label == (r.cand_id[-1] == "7") for r in got)


def test_tables_on_the_way_go(spark):
    """Those of an inner call that still hold its result stay until the outer one is done."""
    count = lambda: len(stored._written)
    begun, seen = count(), []

    def inner():
        return stored.written(stored.written(spark.range(5), "a").where("id > 0"), "b").where("id > 1")

    def outer():
        df = stored.alone(inner, "c")
        seen.extend([count() - begun, df.count()])
        return df.where("id > 2")

    df = stored.alone(outer, "d")
    assert seen == [1, 3] and count() - begun == 1 and sorted(r.id for r in df.collect()) == [3, 4]
    assert all(stored.remove(spark, path) is None for _, path in stored._written[begun:])


def test_matcher_scores_every_candidate(spark):
    pairs = sorted(tuple(r) for r in catalogue.blocking_run(spark, SMALL).select("s1_id", "cand_id").collect())
    scores = catalogue.matcher_scores(spark, SMALL).collect()
    assert pairs and sorted((r.s1_id, r.cand_id) for r in scores) == pairs and all(0 <= r.prob <= 1 for r in scores)
