"""Phrases in texts by a positional inverted index in Parquet.

A posting is a term in a document: the numbers of the words where it stands, and the characters where they begin, each as the step from the one
before. Postings lie in folders by a hash of the term, so a search opens the folders of its terms alone. A phrase is found where all its terms' positions,
each less its place in the phrase, meet; documents that lack a term are dropped before any position is looked at. Snippets are cut from the texts at
the hits, by the characters that the index knows: no text is scanned for words again.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tallyloom.session import bounded_batches, spread

FOLDERS = 64
_WORD = r"[\p{L}\p{N}]+"


def words(text: Column) -> Column:
    """The words of a text, lower case."""
    return F.regexp_extract_all(F.lower(text), F.lit(_WORD), F.lit(0))


def _folder(term: Column) -> Column:
    return F.pmod(F.xxhash64(term), F.lit(FOLDERS)).cast("int")


@F.pandas_udf(T.ArrayType(T.IntegerType()))
def _summed(steps: pd.Series) -> pd.Series:
    return steps.map(lambda s: np.cumsum(s).astype(np.int32))


_POSTINGS = "term string, n int, at array<int>, begin array<int>"


def _postings(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """id, term, n, at and begin (as steps) from id, words, their sizes and the gaps before them: a document lies in one row, so that nothing is shuffled."""
    for b in batches:
        counts = pc.list_value_length(b.column(1)).to_numpy(zero_copy_only=False).astype(np.int64)
        doc, base = np.repeat(np.arange(len(counts)), counts), np.concatenate([[0], np.cumsum(counts)])
        terms = b.column(1).flatten().dictionary_encode()
        code = terms.indices.to_numpy(zero_copy_only=False)
        size, gap = (b.column(i).flatten().to_numpy(zero_copy_only=False).astype(np.int64) for i in (2, 3))
        reach = np.concatenate([[0], np.cumsum(size + gap)])
        at, begin = np.arange(len(doc)) - base[doc], reach[1:] - reach[base[doc]] - size
        order = np.lexsort((at, code, doc))
        doc, code, at, begin = doc[order], code[order], at[order], begin[order]
        first = np.ones(len(doc), bool)
        first[1:] = (doc[1:] != doc[:-1]) | (code[1:] != code[:-1])
        starts = np.flatnonzero(first)
        offsets = pa.array(np.append(starts, len(doc)), "int32")
        steps = lambda x: pa.ListArray.from_arrays(offsets, pa.array(np.where(first, x, x - np.concatenate([x[:1], x[:-1]])), "int32"))  # noqa: E731, B023
        columns = [b.column(0).take(pa.array(doc[starts])), terms.dictionary.take(pa.array(code[starts])), pa.array(np.diff(np.append(starts, len(doc))), "int32"), steps(at), steps(begin)]
        yield pa.RecordBatch.from_arrays(columns, names=["id", "term", "n", "at", "begin"])


def write(docs: DataFrame, id_: str, text: str, path: str) -> None:
    """Index a table of texts; ids are unique. Null and empty texts have no postings. Whole texts are dealt out once, postings once, to a few files for each folder."""
    bounded_batches(docs.sparkSession)
    rows = docs.count()
    told = spread(docs.select(F.col(id_).alias("id"), F.coalesce(F.col(text), F.lit("")).alias("t")), "id", most=20_000, rows=rows)
    told = told.select("id", words(F.col("t")).alias("w"), F.split("t", _WORD).alias("g")).where(F.size("w") > 0)  # g: what stands before each word, and behind the last
    gaps = F.transform("w", lambda x, i: F.coalesce(F.length(F.get("g", i)), -F.length(x)))
    told = told.select("id", "w", F.transform("w", lambda x: F.length(x)).alias("size"), gaps.alias("gap"))
    listed = told.mapInArrow(_postings, T.StructType([told.schema["id"], *T.StructType.fromDDL(_POSTINGS)]))
    out = listed.withColumn("folder", _folder(F.col("term")))
    files = -(-rows // 100_000)
    out.repartition(FOLDERS * max(files, 1), "folder", F.pmod(F.xxhash64("id"), F.lit(max(files, 1)))).write.mode("overwrite").partitionBy("folder").parquet(path)


def search(spark: SparkSession, path: str, phrases: DataFrame, phrase: str) -> DataFrame:
    """The columns of phrases with id, n_hits, at (the word number of the first hit) and begin (its character), for each document that has the
    phrase. phrases: a few thousand rows at most, which are asked all at once, each wording once; a phrase without words is in no document.
    A posting is the answer to a phrase of one word; the positions of others are looked at where a document has all their terms."""
    told = F.array_join(words(F.col(phrase)), " ").alias("__phrase")
    asked = phrases.select(told).distinct().select("__phrase", F.split("__phrase", " ").alias("__w")).where("__phrase <> ''")
    asked = asked.select("__phrase", F.size("__w").alias("__m"), F.posexplode("__w").alias("__i", "term")).withColumn("folder", _folder(F.col("term")))
    folders = [r.folder for r in asked.select("folder").distinct().collect()]  # at most FOLDERS
    index = spark.read.parquet(path).where(F.col("folder").isin(folders))
    met = index.join(F.broadcast(asked), ["folder", "term"])
    single = met.where("__m = 1").select("__phrase", "id", F.col("n").cast("long").alias("n_hits"), F.get("at", F.lit(0)).alias("at"), F.get("begin", F.lit(0)).alias("begin"))
    several = met.where("__m > 1").select("__phrase", "id", "__m", "__i", F.col("at").alias("__at"), F.col("begin").alias("__begin"))
    # documents with all terms of the phrase
    full = several.groupBy("__phrase", "id").agg(F.count("*").alias("__n"), F.max("__m").alias("__m")).where("__n = __m").select("__phrase", "id")
    here = several.join(full, ["__phrase", "id"], "left_semi")
    spots = here.select("__phrase", "id", "__m", "__i", F.explode(F.arrays_zip(_summed("__at").alias("at"), _summed("__begin").alias("begin"))).alias("x"))
    spots = spots.select("__phrase", "id", "__m", (F.col("x.at") - F.col("__i")).alias("at"), "x.begin")
    hits = spots.groupBy("__phrase", "id", "at").agg(F.count("*").alias("__n"), F.max("__m").alias("__m"), F.min("begin").alias("begin")).where("__n = __m")
    hits = hits.groupBy("__phrase", "id").agg(F.count("*").alias("n_hits"), F.min(F.struct("at", "begin")).alias("f")).select("__phrase", "id", "n_hits", "f.at", "f.begin")
    return single.unionByName(hits).join(F.broadcast(phrases.withColumn("__phrase", told)), "__phrase").select(*phrases.columns, "id", "n_hits", "at", "begin")


def snippets(found: DataFrame, docs: DataFrame, id_: str, text: str, before: int = 40, size: int = 120) -> DataFrame:
    """found with a snippet of its document's text around the first hit, and whether something is left out on either side."""
    at = F.greatest(F.col("begin") - before, F.lit(0))
    texts = docs.select(F.col(id_).alias("__id"), F.col(text).alias("__text"))
    cut = found.join(texts, F.col("id") == F.col("__id"))
    return cut.select(*found.columns, F.substr("__text", at + 1, F.lit(size)).alias("snippet"), (at > 0).alias("cut_before"), (F.length("__text") > at + size).alias("cut_after"))
