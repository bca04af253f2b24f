"""The pipeline's stages one after another, each held against brute force on what its predecessor kept."""

import hashlib
import random

import public_tokenizers
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from tests_llm_brute import components_of, measures

random.seed(8)
WORDS = {"en": ["the", "house", "and", "river", "with", "walking", "thing", "shore"], "de": ["der", "haus", "und", "fluss", "mit", "gehen", "ding", "ufer", "straße"]}


def text(lang, n):
    return " ".join(f"{random.choice(WORDS[lang])}{random.choice(['', 'er', 'en', 's'])}{random.choice('abcdefgh')}" for _ in range(n))


def made():
    out = [(i, text("en" if i % 3 else "de", random.randint(55, 120)), "en" if i % 3 else "de", f"s{i % 4}", 1) for i in range(60)]
    copies = [(100 + i, out[i][1], out[i][2], "s1", 1) for i in range(8)]
    near = [(200 + i, out[i][1] + " one more word", out[i][2], "s2", 1) for i in range(10, 16)]
    bad = [(300, None, "en", "s0", 1), (301, "too short", "en", "s0", 1), (302, "again " * 90, "en", None, 1), (303, " ".join(str(k) for k in range(80)), "en", "s3", 1), (None, text("de", 70), None, None, None)]
    return out + copies + near + bad


@pytest.fixture(scope="module")
def given(spark):
    return spark.createDataFrame(made(), "doc_id long, text string, lang string, source string, n_chars long").withColumn("target", F.lit("x"))


def test_stages(spark, given, tmp_path):
    docs, columns = given.repartition(3), given.columns
    results = []
    for i, (name, stage) in enumerate(corpus_pipeline.STAGES):
        stage(spark, docs, "").write.parquet(str(tmp_path / f"{i}"))
        docs = spark.read.parquet(str(tmp_path / f"{i}"))
        if i < 4:
            assert docs.columns == columns, name
        results.append([r.asDict() for r in docs.collect()])
    ids = lambda rows: sorted((r["doc_id"] for r in rows), key=str)

    whole = [dict(zip(["doc_id", "text"], r[:2], strict=True)) for r in made()]
    good = [r for r in whole if not measures(r["text"])["base_failed"]]
    assert ids(results[0]) == ids(good)
    assert ids(results[1]) == ids([r for r in good if r["doc_id"] != 303])  # digits only: no letter
    data = [(r["doc_id"], r["text"]) for r in results[1]]
    component = components_of(data)
    assert ids(results[2]) == sorted((d for (d, _), c in zip(data, component, strict=True) if d is None or d == c), key=str)
    copies = {}
    for r in results[3]:
        copies[r["doc_id"]] = copies.get(r["doc_id"], 0) + 1
    size = {r["doc_id"]: len(r["text"].split()) for r in results[2]}
    assert set(copies) <= set(size) and max(copies.values()) <= 2
    assert sum(n * size[d] for d, n in copies.items()) == pytest.approx(1.5 * sum(size.values()), rel=0.1)

    from tokenizers import Tokenizer

    library = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    texts = {r["doc_id"]: r["text"] for r in results[3]}
    assert len(results[4]) == len(results[3])
    for r in results[4]:
        assert list(r["ids"]) == library.encode(texts[r["doc_id"]], add_special_tokens=False).ids and r["n_tokens"] == len(r["ids"])
        assert r["decoded_sha256"] == hashlib.sha256(texts[r["doc_id"]].encode()).hexdigest()


def test_run_reads_documents(spark, given, tmp_path):
    given.drop("target").write.parquet(str(tmp_path / "documents.parquet"))
    assert corpus_pipeline.run(spark, str(tmp_path)).count() > 60


def test_empty(spark, given):
    docs = given.limit(0)
    for name, stage in corpus_pipeline.STAGES:
        assert stage(spark, docs, "").count() == 0, name
