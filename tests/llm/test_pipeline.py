"""The pipeline's stages against plain versions of what they decide."""

import hashlib

import pytest
from pyspark.sql import functions as F

import corpus_pipeline as pipeline
from textloom.llm import bpe, mixing, ngram_join


@pytest.fixture(scope="module")
def results(spark, data):
    from textloom.llm.common import Workspace

    space = Workspace(spark, "pipeline-test")
    docs = [spark.read.parquet(f"{data}/documents.parquet")]
    for name, stage in pipeline.STAGES:
        docs.append(space.write(stage(spark, docs[-1], data), name))
    return docs


def test_stages_keep_the_columns(results):
    assert [n for n, _ in pipeline.STAGES] == ["language_id", "ngram_near_duplicates", "source_mixing", "bpe_encoding"]
    for df in results[:-1]:
        assert set(df.columns) == set(pipeline.COLUMNS)


def test_language_stage_keeps_clean_documents(results, spark, data):
    lost = results[0].join(results[1], "doc_id", "left_anti")
    assert lost.count() <= 0.02 * results[0].count()
    junk = spark.createDataFrame([(1, "123 !!", "en", "s", 6), (2, None, None, None, None), (3, "the of and the", "en", "s", 14), (4, "the of to", "en", "s", 9)], results[0].schema)
    assert {r["doc_id"] for r in pipeline.language_stage(spark, junk, data).collect()} <= {3, 4}


def test_one_document_of_each_group_stays(results):
    classes = ngram_join.join(results[1])
    want = {r[0] for r in classes.select("class_id").distinct().collect()}
    assert sorted(r["doc_id"] for r in results[2].select("doc_id").collect()) == sorted(want)


def test_mixing_stage_repeats_and_drops(results):
    want = {r["doc_id"]: r["passes"] for r in mixing.mix(results[2]).collect() if r["passes"]}
    assert {r["doc_id"]: r["n"] for r in results[3].groupBy("doc_id").agg(F.count("*").alias("n")).collect()} == want


def test_encoding_decodes(results):
    texts = {r["doc_id"]: hashlib.sha256(r["text"].encode()).hexdigest() for r in results[3].collect()}
    rows = results[4].collect()
    assert len(rows) == results[3].count()
    flat, start, length = bpe.token_bytes(bpe.vocabulary_path())
    for r in rows:
        raw = b"".join(flat[start[i] : start[i] + length[i]].tobytes() for i in r["ids"])
        assert r["decoded_sha256"] == texts[r["doc_id"]] == hashlib.sha256(raw).hexdigest() and r["n_tokens"] == len(r["ids"])


def test_run_gives_the_last_stage(results, spark, data):
    pick = lambda df: sorted((r["doc_id"], r["n_tokens"], r["decoded_sha256"]) for r in df.collect())
    assert pick(pipeline.run(spark, data)) == pick(results[4])


def test_empty_and_odd_tables(spark, results, data):
    empty = results[0].limit(0)
    for _, stage in pipeline.STAGES:
        assert stage(spark, empty, data).isEmpty()
    odd = spark.createDataFrame([(1, None, None, None, None), (None, "a b c", "en", None, 5), (2, "a b c", "en", "s", 5), (2, "a b c", "en", "s", 5)], results[0].schema).withColumn("passes", F.lit("clash"))
    for _, stage in pipeline.STAGES:
        stage(spark, odd, data).collect()
