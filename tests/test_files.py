"""Raw files and datasets."""

import pytest
from pyspark.sql import functions as F

from tessella.operators import ordering, reports
from tessella.sources import files, tables


def test_byte_checks_and_diff(spark, tmp_path):
    (tmp_path / "a.tsv").write_bytes(b"\xef\xbb\xbfid\tname\n1\t\xff\xfe\n2\t\"x\"\r\n3\n")
    (tmp_path / "b.tsv").write_bytes(b"\xef\xbb\xbfid\tname\n1\tok\n2\t\"x\"\r\n3\n4\n")
    got = {r.path.rsplit("/", 1)[1]: r for r in files.byte_checks(files.raw_lines(spark, str(tmp_path)), fields=2).collect()}
    a = got["a.tsv"]
    assert (a.lines, a.invalid_utf8, a.carriage_return, a.quotes, a.wrong_fields) == (4, 1, 1, 1, 1)
    assert got["b.tsv"].invalid_utf8 == 0
    (tmp_path / "c").mkdir()
    (tmp_path / "c" / "d").write_bytes(b"id")
    assert list(files.byte_order_marks(spark, [str(tmp_path / "a.tsv"), str(tmp_path / "c" / "d")]).values()) == [True, False]
    diff = {r.line: (r.a, r.b) for r in files.line_diff(spark, str(tmp_path / "a.tsv"), str(tmp_path / "b.tsv")).collect()}
    assert sorted(diff) == [2, 5] and diff[5] == (None, "4")


def test_sources(spark, tmp_path):
    where = str(tmp_path)
    spark.range(3).write.parquet(f"{where}/train-1")
    spark.range(2).withColumn("x", F.lit(1)).write.parquet(f"{where}/train-2")
    assert files.load_source(spark, where + "/{split}-{source}", "train", 1, ["id"]).count() == 3
    with pytest.raises(ValueError, match="split must be"):
        files.load_source(spark, where + "/{split}-{source}", "dev", 1)
    both = files.read_all(spark, f"{where}/train-1", f"{where}/train-2")
    assert both.count() == 5 and both.where("x IS NULL").count() == 3
    assert files.read_all(spark, f"{where}/train-*", columns=["id"]).columns == ["id"]
    assert files.rows_with(spark, f"{where}/train-1", "id", spark.range(1, 20).withColumnRenamed("id", "k")).count() == 2
    made = []
    for _ in range(2):
        assert files.cached(spark, f"{where}/cache", lambda: made.append(1) or spark.range(4)).count() == 4
    assert made == [1]


def test_merge_and_runs(spark, tmp_path):
    parts = [str(tmp_path / f"p{i}") for i in range(2)]
    for p in parts:
        spark.range(5).write.parquet(p)
    with pytest.raises(ValueError, match="10 rows"):
        files.merge_parts(spark, parts, 11, str(tmp_path / "out"))
    assert files.merge_parts(spark, parts, 10, str(tmp_path / "out")) == 10 and not (tmp_path / "p0").exists()
    with pytest.raises(ValueError, match="complete"):
        files.merge_parts(spark, parts, 10, str(tmp_path / "out"))
    runs = []
    for k in (1, 1, 2):
        files.run_once(spark, str(tmp_path / "run"), {"k": k}, lambda: runs.append(1) or spark.range(3))
    assert len(runs) == 2


def test_shards_samples_and_packs(spark, tmp_path):
    where = str(tmp_path)
    postings = spark.createDataFrame([("S1-1", "X", "ab", 1), ("S2-1", "X", "ab", 2), ("S2-2", "Y", "ab", 1)], "entity_id string, country string, gram string, tf int")
    files.write_shards(postings, f"{where}/shards", version="1")
    assert files.read_shard(spark, f"{where}/shards", "X").count() == 2 and tables.read_manifest(spark, f"{where}/shards/manifest.json")["rows"] == 3
    assert files.read_shard(spark, f"{where}/shards", "X", spark.createDataFrame([("S2-1",)], "entity_id string")).count() == 1
    for n in (1, 2):
        spark.createDataFrame([(f"S{n}-{i}",) for i in range(50)], "entity_id string").write.parquet(f"{where}/s{n}")
    truth = spark.createDataFrame([("S1-1", "S2-9"), ("S1-2", None), ("S1-3", "S2-4")], "s1_id string, match_id string")
    files.dev_sample(spark, {1: f"{where}/s1", 2: f"{where}/s2"}, truth, spark.createDataFrame([("S1-1",), ("S1-2",)], "s1_id string"), f"{where}/dev", 0)
    assert [r.entity_id for r in spark.read.parquet(f"{where}/dev/s2").collect()] == ["S2-9"] and spark.read.parquet(f"{where}/dev/s1").count() == 2
    files.packed(spark, f"{where}/dev", f"{where}/pack.json")
    assert {r.status for r in files.verified(spark, f"{where}/dev", f"{where}/pack.json").collect()} == {"MATCH"}
    ids = spark.createDataFrame([("S1-2",), ("S1-1",)], "s1_id string")
    assert files.write_ids(ids, f"{where}/ids/train") and files.named_ids(spark, f"{where}/ids", "train").count() == 2
    with pytest.raises(ValueError, match="train"):
        files.named_ids(spark, f"{where}/ids", "val")
    assert files.newest_model(spark, where, "manifest.json").endswith("/shards")
    files.write_csv(ids, f"{where}/csv")
    assert spark.read.option("header", True).csv(f"{where}/csv").count() == 2


def test_order(spark):
    df = spark.range(1000).select((F.col("id") * 7919 % 1000).alias("k")).repartition(5)
    assert [(r.k, r["index"]) for r in ordering.row_index(df, ["k"]).collect() if r.k != r["index"]] == []
    assert ordering.row_index(df.limit(0), ["k"]).count() == 0
    assert reports.markdown(spark.createDataFrame([(1, None, 0.5)], "a int, b string, c double")) == "| a | b | c |\n|-|-|-|\n| 1 |  | 0.5000 |"


def test_checksums_of_large_files(spark, tmp_path, monkeypatch):
    for k in range(3):
        (tmp_path / f"f{k}").write_bytes(b"x" * (10 + k))
    whole = sorted(map(tuple, tables.checksums(spark, str(tmp_path)).collect()))
    monkeypatch.setattr(tables, "ONE_VALUE", 10)
    assert sorted(map(tuple, tables.checksums(spark, str(tmp_path)).collect())) == whole and len(whole) == 3
