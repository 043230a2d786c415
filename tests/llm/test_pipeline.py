"""The stages end to end on the smallest tables, each against what it was given."""

import corpus_pipeline
from pyspark.sql import functions as F

DIR = "/root/testdata/sf0.001"


def test_stages_keep_columns_and_take_effect(spark):
    docs = spark.read.parquet(f"{DIR}/documents.parquet").withColumn("pii", F.lit(1)).withColumn("kept", F.lit(False))
    columns, counts = docs.columns, [docs.count()]
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = corpus_pipeline.materialise(stage(spark, docs, DIR), name)
        assert docs.columns == columns
        counts.append(docs.count())
    assert counts[0] > counts[1] > counts[2] >= counts[3] == counts[4] > 0.5 * counts[0]
    pieces = corpus_pipeline.STAGES[-1][1](spark, docs, DIR)
    assert pieces.select("doc_id").distinct().count() == docs.count()


def test_an_empty_table_passes_all_stages(spark):
    docs = spark.read.parquet(f"{DIR}/documents.parquet").limit(0)
    for _, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, DIR)
    assert docs.count() == 0
