"""Queries that take whole texts, all chunks and all queries, on whole tables."""

import os

import oracle
import pytest
from pyspark.sql import functions as F

from sonmai.functions import text as T
from sonmai.plans import catalogue
from sonmai.session import table

D = f"{oracle.DATA}/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(D), reason="no test data")


def test_composed_and_training_texts_hold_the_whole_text(spark):
    labels = table(spark, D, "bench_labels").select("label_id", T.text(F.col("full_text")).alias("t"))
    assert labels.where("length(t) > 500").count() > 0
    composed = catalogue.QUERIES["composed_documents"](spark, D).where("variant = 'clean'")
    assert composed.join(labels, "label_id").where("NOT contains(text, t)").count() == 0
    rows = catalogue.QUERIES["training_text"](spark, D)
    assert rows.join(labels, "label_id").where("NOT contains(row_text, t)").count() == 0


def test_every_chunk_is_annotated(spark):
    chunks = catalogue.QUERIES["chunk_paragraphs"](spark, D)
    rows = catalogue.QUERIES["annotated_chunks_whole"](spark, D)
    assert rows.count() == chunks.count() and rows.where("chunk_index > 0").count() > 0
    mark = F.concat(F.col("text"), F.lit("\n[Đoạn "), (F.col("chunk_index") + 1).cast("string"), F.lit("/"), F.col("total_chunks").cast("string"), F.lit("]"))
    both = rows.drop("doc_id", "chunk_index").join(chunks, "chunk_id")
    assert both.count() == chunks.count() and both.where(F.col("marked") != mark).count() == 0


def test_every_twentieth_vector_is_a_query(spark):
    ids = {r.vec_id for r in table(spark, D, "embeddings").where("vec_id % 20 = 0").collect()}
    assert len(ids) > 1
    for name, k in (("cosine_topk_all", 10), ("cosine_topk_filtered_all", 5)):
        got = [r.query_id for r in catalogue.QUERIES[name](spark, D).collect()]
        assert set(got) == ids and all(got.count(i) == k for i in ids)
    assert {r.query_id for r in catalogue.QUERIES["context_listagg_all"](spark, D).collect()} == ids
