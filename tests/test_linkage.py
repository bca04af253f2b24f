"""Small cases with known answers."""

import pytest
from pyspark.sql import functions as F

from tessella.functions import similarity
from tessella.operators import blocking_metrics as B
from tessella.operators import candidates as C
from tessella.operators import decision as D
from tessella.operators import features, lookup, quality, sampling
from tessella.sources import tables


def test_f05_examples(spark):
    preds = spark.createDataFrame([("q1", "a", 0.9), ("q1", "b", 0.8), ("q1", "c", 0.7), ("q2", "a", 0.6), ("q3", "d", 0.5)], "s1_id string, cand_id string, prob double")
    truth = spark.createDataFrame([("q1", "a"), ("q1", "b"), ("q4", "x")], "s1_id string, cand_id string")
    asked = spark.createDataFrame([(f"q{i}", "X") for i in range(1, 6)], "s1_id string, country string")
    got = {r.s1_id: r for r in D.per_s1_f05(D.one_to_one(preds), asked, truth).collect()}
    assert got["q1"].f05 == pytest.approx(1.25 * (2 / 3) / (0.25 * (2 / 3) + 1))
    assert [got[f"q{i}"].f05 for i in (2, 3, 4, 5)] == [1.0, 0.0, 0.0, 1.0]
    both = D.decide(preds, 0.65).collect(), D.one_to_one(preds).where("prob >= 0.65").collect()
    assert sorted(both[0]) == sorted(both[1])
    scores = {r.threshold_pct: r.macro_f05 for r in D.threshold_search(preds, asked, truth).collect()}
    for t in (10, 50, 52, 72, 98):
        m = D.macro_f05(D.per_s1_f05(D.decide(preds, t / 100), asked, truth)).first().macro_f05
        assert scores[t] == pytest.approx(m), t
    assert D.best_threshold(D.threshold_search(preds, asked, truth)).first().threshold_pct == 72


def test_ties_go_to_the_smallest_query(spark):
    preds = spark.createDataFrame([("b", "x", 0.5), ("a", "x", 0.5)], "s1_id string, cand_id string, prob double")
    assert [r.s1_id for r in D.one_to_one(preds).collect()] == ["a"]


def test_recall_ignores_duplicates(spark):
    truth = spark.createDataFrame([("q1", "a", "X"), ("q1", "b", "X"), ("q2", "c", "Y"), ("q3", "d", "Y")], "s1_id string, cand_id string, country string")
    cands = spark.createDataFrame([("q1", "a"), ("q1", "a"), ("q1", "b"), ("q2", "c"), ("q3", "z")], "s1_id string, cand_id string")
    r = B.blocking_recall(cands, truth).first()
    assert (r.pair_recall, r.all_found_recall) == (0.75, pytest.approx(2 / 3))


def brute_cosines(texts):
    from collections import Counter
    from math import log, sqrt

    grams = {}
    for name, text in texts.items():
        grams[name] = Counter(f" {w} "[i : i + n] for w in text.split() for n in (3, 4, 5) for i in range(len(w) + 3 - n) if n <= len(w) + 2)
    df = Counter(g for c in grams.values() for g in c)
    weigh = {k: {g: t * (log((1 + len(texts)) / (1 + df[g])) + 1) for g, t in c.items()} for k, c in grams.items()}
    norm = {k: sqrt(sum(x * x for x in v.values())) for k, v in weigh.items()}
    return lambda a, b: sum(x * weigh[b].get(g, 0) for g, x in weigh[a].items()) / norm[a] / norm[b]


def test_retrieval_is_exact_without_a_cap(spark):
    texts = {"S1-1": "star coffee", "S1-2": "river bank", "S2-1": "star coffees", "S2-2": "rivers bank", "S3-1": "coffee star house", "S3-2": "mill"}
    records = spark.createDataFrame([(k, "X", v) for k, v in texts.items()] + [("S2-9", "Y", "star coffee")], "entity_id string, country string, t string")
    w = C.tfidf(C.char_ngrams(records.where("country = 'X'"), F.col("t")), cap=1.0)
    q, p = w.where("entity_id LIKE 'S1-%'"), w.where("entity_id NOT LIKE 'S1-%'")
    cosine = brute_cosines(texts)
    for r in C.retrieve(q, p, 10, 10).collect():
        assert r.cosine == pytest.approx(cosine(r.s1_id, r.cand_id))
    assert [r.cand_id for r in C.retrieve(q, p, 10, 1).orderBy("s1_id").collect()] == ["S2-1", "S2-2"]
    everything = C.tfidf(C.char_ngrams(records, F.col("t")), cap=1.0)
    crossed = C.retrieve(everything.where("entity_id LIKE 'S1-%'"), everything.where("entity_id NOT LIKE 'S1-%'"), 10, 10)
    assert crossed.where("cand_id = 'S2-9'").count() == 0


def test_p3_blocks(spark):
    keys = lambda rows: C.p3_keys(spark.createDataFrame(rows, "entity_id string, country string, name string, house string, state string"))
    q, pool = keys([("S1-1", "X", "blue moon cafe", "12", "tx"), ("S1-2", "X", "red", None, "tx")]), keys([(f"S2-{i}", "X", "moon", "12", "") for i in range(3)] + [("S2-9", "Y", "moon", "12", "tx"), ("S3-1", "X", "zz", "12", "tx")])
    assert sorted(r.key for r in q.collect()) == ["S|12|tx", "T|12|blue", "T|12|cafe", "T|12|moon"]
    assert C.p3_key_join(q, pool, 20).count() == 4 and [r.cand_id for r in C.p3_key_join(q, pool, 2).collect()] == ["S3-1"]


def test_mapping(spark):
    aligned = spark.createDataFrame([("US", "tx", "texas")] * 150 + [("US", "tx", "tx")] * 20 + [("US", "ca", "texas")] * 5 + [("US", "ny", "rare")] * 9, "country string, canonical string, variant string")
    m = lookup.learn_mapping(aligned)
    got = {(r.country, r.variant): r.canonical for r in m.collect()}
    assert got == {("US", "texas"): "tx", ("US", "tx"): "tx"}  # ca and ny are too rare even for themselves
    out = lookup.apply_mapping(spark.createDataFrame([(1, "US", "texas"), (2, "France", "texas"), (3, "US", None)], "id int, country string, s string"), m, "s", "canon")
    assert {r.id: r.canon for r in out.collect()} == {1: "tx", 2: None, 3: None}


def test_md5(spark):
    import hashlib

    ids = [f"S1-{i}" for i in range(50)]
    got = [r.x for r in spark.createDataFrame([(i,) for i in ids], "id string").coalesce(1).select(sampling.md5_mod(F.col("id"), 100).alias("x")).collect()]
    assert got == [int(hashlib.md5(i.encode()).hexdigest(), 16) % 100 for i in ids]


def test_similarities():
    assert similarity.token_set_ratio("starbucks", "starbucks coffee") == 1.0 and similarity.token_set_ratio("", "a") == 0.0 and similarity.token_set_ratio(None, "a") is None
    assert similarity.token_set_ratio("ab cd", "ab ce") == pytest.approx(0.8) and similarity.common_subsequence("abcbdab", "bdcaba") == 4
    assert similarity.jaro_winkler("martha", "marhta") == pytest.approx(0.9611, abs=1e-4) and similarity.jaro_winkler("abcd", "abxy") == pytest.approx(0.6667, abs=1e-4) and similarity.jaro_winkler("a", "") == 0.0


def test_pair_features(spark):
    kinds = "entity_id string, country string, name_core string, name_nospace string, name_domain_stem string, name_script string, legal_families array<string>, name_has_nonlatin boolean, addr_core string, addr_house_number string, addr_state_canon string, addr_numbers array<string>, chain_n int"
    s1 = spark.createDataFrame([("S1-1", "US", "starbucks", "starbucks", None, "Latin", ["SARL"], False, "12 main street", "12", "tx", ["12"], 2)], kinds)
    pool = spark.createDataFrame([("S2-1", "US", "starbucks coffee", "starbuckscoffee", "starbucks", "Latin", ["SAS"], False, "15 main street", "15", None, ["15"], None), ("S3-1", "US", "starbucks", "starbucks", None, "Latin", [], False, None, None, "tx", None, 1)], kinds)
    pairs = spark.createDataFrame([("S1-1", "S2-1", "US", True, False, True, False, 0.9, 0.4, 1, None, 1), ("S1-1", "S3-1", "US", True, True, True, True, 0.5, 0.6, None, 2, None)], "s1_id string, cand_id string, country string, in_p1 boolean, in_p2 boolean, in_p3 boolean, in_p4 boolean, p1_cos double, p2_cos double, p1_rank int, p2_rank int, p1_rank_rev int")
    out = features.pair_features(pairs, s1, pool)
    assert len(out.columns) == 3 + 48
    a, b = (r.asDict() for r in out.orderBy("cand_id").collect())
    assert (a["name_tok_added"], a["name_tok_dropped"], a["name_tsr"], a["name_domain_match"], a["hn_gap"], a["legal_conflict"], a["state_unknown"], a["b_is_s3"], a["b_chain_n"]) == (1, 0, 1.0, 1, 3, 1, 1, 0, 0)
    assert a["addr_tok_jac"] == pytest.approx(0.5) and (a["hn_exact"], a["mutual_best"], a["n_passes"], a["p2_rank"], a["p1_rank_rev"]) == (0, 1, 2, 21, 1)
    assert (b["name_core_eq"], b["addr_tok_jac"], b["hn_exact"], b["hn_gap"], b["num"] if "num" in b else None, b["addr_num_overlap"], b["state_agree"], b["b_addr_missing"], b["n_passes"], b["p1_rank"]) == (1, None, None, None, None, None, 1, 1, 4, 51)
    assert (a["p1_cos_rank_s1"], b["p1_cos_rank_s1"], a["s1_n_cands"]) == (1, 2, 2) and b["p1_cos_gap_s1"] == pytest.approx(0.4)
    with pytest.raises(Exception, match="no record for pair"):
        features.pair_features(pairs.withColumn("cand_id", F.lit("S2-7")), s1, pool).collect()


def test_files(spark, tmp_path):
    (tmp_path / "a.tsv").write_text('entity_id\tbusiness_name\tbusiness_address\tcountry\nS1-1\t"""x\t\tUS\n')
    r = tables.read_tsv(spark, str(tmp_path / "a.tsv")).first()
    assert tuple(r) == ("S1-1", '"""x', "", "US")
    pairs = spark.createDataFrame([("S1-1", "S3-2"), ("S1-1", "S2-9"), ("S1-1", "S2-9")], "s1_id string, cand_id string")
    lists = tables.list_output(pairs, spark.createDataFrame([("S1-1",), ("S1-2",)], "s1_id string"))
    assert sorted(map(tuple, lists.collect())) == [("S1-1", "S2-9,S3-2"), ("S1-2", "")]
    tables.write_lists(lists.coalesce(1), str(tmp_path / "out"), "source1_entity_id", "ids")
    text = next((tmp_path / "out").glob("*.csv")).read_text().splitlines()
    assert text[0] == "source1_entity_id\tids" and "S1-1\tS2-9,S3-2" in text
    assert tables.truth_long(lists).where("match_id IS NULL").count() == 1
    tables.write_manifest(spark, str(tmp_path / "m.json"), {"version": "1"})
    tables.check_manifest(spark, str(tmp_path / "m.json"), version="1")
    with pytest.raises(ValueError, match="fit"):
        tables.check_manifest(spark, str(tmp_path / "m.json"), version="2")
    sums = tables.checksums(spark, str(tmp_path / "m.json"))
    assert tables.compare_checksums(sums, sums.withColumn("sha256", F.lit("x"))).first().status == "DIFFER"
    assert tables.write_parquet(lists, str(tmp_path / "p")) == 2
    ids = spark.createDataFrame([("S1-2",), ("S1-1",), ("S1-2",)], "s1_id string")
    tables.write_ids(ids, str(tmp_path / "ids"))
    assert sorted(r.s1_id for r in tables.read_ids(spark, str(tmp_path / "ids")).collect()) == ["S1-1", "S1-2"]


def test_validator(spark):
    lists = spark.createDataFrame([("S1-1", "S2-1,S2-1,X,S1-1"), ("S1-1", ""), ("S1-9", "S3-7")], "s1_id string, ids string")
    pool, s1 = spark.createDataFrame([("S2-1",)], "match_id string"), spark.createDataFrame([("S1-1",), ("S1-2",)], "s1_id string")
    got = {r.finding: r.n for r in quality.validate_lists(lists, s1, pool, spark.createDataFrame([("S1-1", "S2-1")], "s1_id string, match_id string")).collect()}
    assert got == {"repeated_rows": 1, "missing_s1": 1, "extra_s1": 1, "malformed_id": 1, "wrong_source": 1, "self_match": 1, "repeated_in_list": 1, "unknown_id": 2, "not_a_candidate": 3}
