"""From raw documents to packed training windows, in five stages.

Each stage takes (spark, docs, sf_dir) and works on all that the stage before kept; run() writes what a stage returns to
the shared folder and reads it again. All stages but the last return the columns of their input.

Edge cases: null and empty texts pass every filter (they are not toxic, duplicates or leaks) and are packed as the end id
alone; rows with a null id pass the filters that go by id; an empty table gives no pieces.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyloom.llm import decontamination, minhash, packing, pii, toxicity
from tallyloom.session import materialise, scratch

#: The stages train, link and tokenise; no SQL gives their rows. tests/llm tests them against brute force.
ORACLE_SQL = None


def reject_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    return toxicity.reject(docs, toxicity.fit(toxicity.labelled(docs, labels, F.lit(True))))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return minhash.deduplicate(docs, k=5, threshold=80)


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return decontamination.remove(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def redact(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    out = pii.redact(pii.detect(docs, out="__pii"), spans="__pii")
    return out.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType)) if "n_chars" in docs.columns else out


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return packing.pack(docs, public_tokenizers.path("byte_bpe_50k.json"))


STAGES = [
    ("toxicity", reject_toxic),
    ("minhash_near_dedup", near_duplicates),
    ("decontamination", decontaminate),
    ("pii", redact),
    ("packing", pack),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages; what a stage wrote on the way, and what it read, is deleted as soon as its result is written."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    with scratch(spark) as whole:
        for name, stage in STAGES:
            before = docs
            with scratch(spark) as own:
                docs = own.keep(materialise(stage(spark, before, sf_dir), name))
            whole.drop(before)
        return whole.keep(docs)
