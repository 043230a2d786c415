"""What the training-data operators share."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: A word, wherever a contract speaks of words: everything but the six ASCII white-space characters.
WORD = r"[^\x20\x09-\x0D]+"
SPACE = r"[\x20\x09-\x0D]+"


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def words(text: Column) -> Column:
    """The words of a text, in order; null and empty texts have none."""
    return F.filter(F.split(F.coalesce(text, F.lit("")), SPACE), lambda w: w != "")


def crc_mod(doc_id: Column, n: int) -> Column:
    """The fold of a document: CRC-32 of its id as text, modulo n."""
    return F.pmod(F.crc32(doc_id.cast("string").cast("binary")), F.lit(n))


def put_back(docs: DataFrame, found: DataFrame, columns: list[str], key: str = "doc_id") -> DataFrame:
    """docs with some columns of found (one row for each key), null-safe, names of docs untouched."""
    right = found.select(F.col(key).alias("__key"), *[F.col(c).alias(f"__{c}") for c in columns])
    return docs.join(right, docs[key].eqNullSafe(right["__key"]), "left").drop("__key")
