import corpus_pipeline
from pyspark.sql import functions as F

from faultline.llm import workload

FOLDER = "/root/testdata/sf0.001"


def test_every_operator_has_a_query():
    assert {n.split("_")[0] for n in workload.QUERIES} == {f"op{i}" for i in range(1, 14)}
    assert set(workload.SQL) <= set(workload.QUERIES)


def test_pipeline_keeps_columns_and_packs_what_is_left(spark):
    assert [n for n, _ in corpus_pipeline.STAGES] == [
        "quality_classifier", "exact_dedup", "ngram_jaccard_join", "benchmark_decontamination", "packing"]
    docs = spark.read.parquet(f"{FOLDER}/documents.parquet").withColumn("id", F.lit(1))
    left = docs
    for _, stage in corpus_pipeline.STAGES[:-1]:
        before = {r.doc_id for r in left.select("doc_id").collect()}
        left = stage(spark, left, FOLDER)
        assert left.columns == docs.columns and {r.doc_id for r in left.select("doc_id").collect()} <= before
    packed = corpus_pipeline.STAGES[-1][1](spark, left, FOLDER)
    assert {r.doc_id for r in packed.collect()} == {r.doc_id for r in left.collect()}


def test_pipeline_runs_on_an_empty_table(spark):
    docs = spark.read.parquet(f"{FOLDER}/documents.parquet").limit(0)
    for _, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, FOLDER)
    assert docs.count() == 0
