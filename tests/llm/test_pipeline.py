"""Queries and the pipeline over the smallest tables."""

import re

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from deltagrid.llm import queries, rules

DIR = "/root/testdata/sf0.001"
DOCUMENTS = ["doc_id", "text", "lang", "source", "n_chars"]


def test_each_stage_does_its_work(spark):
    docs = spark.read.parquet(f"{DIR}/documents.parquet")
    kept = corpus_pipeline.quality(spark, docs, DIR).cache()
    assert kept.columns == DOCUMENTS and 0 < kept.count() < docs.count()
    single = corpus_pipeline.near_duplicates(spark, kept, DIR).cache()
    assert single.columns == DOCUMENTS and 0 < single.count() < kept.count() and single.count() == single.select("doc_id").distinct().count()
    safe = corpus_pipeline.private(spark, single, DIR).cache()
    email = r"[\w.]+@[\w.]+\.com"
    before, after = (set(re.findall(email, " ".join(r["text"] for r in d.collect()))) for d in (single, safe))
    assert safe.count() == single.count() and before and not before & after
    mix = corpus_pipeline.mixed(spark, safe, DIR).cache()
    assert mix.columns == DOCUMENTS and mix.groupBy("doc_id").count().agg(F.max("count")).first()[0] <= 3
    coded = corpus_pipeline.tokens(spark, mix, DIR)
    assert coded.count() == mix.count() and coded.where("n_tokens <> size(ids)").count() == 0


SCHEMA = "doc_id bigint, text string, lang string, source string, n_chars bigint"


def test_stages_take_nulls_and_empty_tables(spark):
    text = "x y " * 60 + "end."
    rows = [(1, None, None, None, None), (None, text, "en", "a", 5), (None, text, "en", "a", 5), (2, "", "en", None, 0), (3, "q r s t u", "en", "a", 1), (3, "v w x y z", "en", "a", 1), (3, "v w x y z", "en", "a", 1)]
    for d in (spark.createDataFrame(rows, SCHEMA), spark.createDataFrame([], SCHEMA)):
        for _, stage in corpus_pipeline.STAGES:
            stage(spark, d.withColumn("_Row", F.lit(1)).withColumn("KEPT", F.lit(1)), DIR).count()
    left = corpus_pipeline.near_duplicates(spark, spark.createDataFrame(rows, SCHEMA), DIR).collect()
    assert sorted((r["doc_id"] or 0, r["text"] or "") for r in left) == [(0, text), (1, ""), (2, ""), (3, "q r s t u"), (3, "v w x y z")]


def test_quality_keeps_what_the_operator_keeps(spark):
    docs = spark.read.parquet(f"{DIR}/documents.parquet")
    want = {r["doc_id"] for r in rules.apply_rules(docs).where("kept").collect()}
    assert {r["doc_id"] for r in corpus_pipeline.quality(spark, docs.union(docs.limit(0)), DIR).collect()} == want


def test_stages_keep_columns_named_like_outputs_of_operators(spark):
    """Each stage but the last gives back its input's columns, with their types and values."""
    names = ["n_pii", "PII_kinds", "size", "source_size", "target", "copies", "kept", "n_words", "p_good", "packed", "n", "row", "component", "class_id", "n_shingles", "_row"]
    docs = spark.read.parquet(f"{DIR}/documents.parquet").select("*", *(F.concat(F.lit(f"{c} "), "doc_id").alias(c) for c in names))
    want = {r["doc_id"]: tuple(r[c] for c in names) for r in docs.collect()}
    for _, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, DIR)
        assert out.dtypes == docs.dtypes
        assert all(tuple(r[c] for c in names) == want[r["doc_id"]] for r in out.collect())


@pytest.mark.parametrize("name", sorted(set(queries.QUERIES) - {"op13_variants"}))
def test_every_query_returns_a_row_a_document(spark, name):
    assert queries.QUERIES[name](spark, DIR).select("doc_id").distinct().count() == 200
