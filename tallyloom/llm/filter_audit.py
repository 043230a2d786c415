"""How filters interact: what each removes alone, after others, and in every order.

The words of every text are a relation: exploded, aggregated by (document, word) and then by document for totals and distinct words. The flags
that go by the text itself, repeated texts and labels are outer-joined to that, and 32 conditional counts by part - one for every set of filters
that a document can fail - hold all that any order of filters can ask. Orders and steps are sums over those 32 numbers.

Edge cases: null and empty texts have no words, fail A (too short) and, among each other, E (repeated), but not B, C or D. A null lang is the part ''. Rows
that repeat id and text are rows of their own in every count, and not E to each other, as no id is smaller; rows with a null id count, have no
labels and are never E. Several labels of one document: the largest of each column holds. An empty table has no parts and so no rows. Columns other than
doc_id, text and lang are not looked at.
"""

from __future__ import annotations

from itertools import permutations
from math import factorial

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyloom.llm.common import SPACE
from tallyloom.session import materialise, scratch

FILTERS = "ABCDE"
SETS = 1 << len(FILTERS)


def word_counts(docs: DataFrame) -> DataFrame:
    """(doc_id, text_hash, n_words, n_distinct) of every id and text with words. Texts are dealt out once, by document; both aggregations of
    their words then find them in place. Repeated rows are one before their words are taken, on the side that reads them, so that no id is hot."""
    one = docs.groupBy("doc_id", "text_hash").agg(F.first("text").alias("text"))
    word = one.select("doc_id", "text_hash", F.explode(F.split("text", SPACE)).alias("word")).where("word != ''")
    each = word.groupBy("doc_id", "text_hash", "word").agg(F.count("*").alias("n"))
    return each.groupBy("doc_id", "text_hash").agg(F.sum("n").alias("n_words"), F.count("*").alias("n_distinct"))


def failures(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """(doc_id, part, failed, good, toxic) for every row of docs; failed has the bit 1 << i for the i-th filter that it fails."""
    text = F.coalesce("text", F.lit(""))
    docs = docs.select("doc_id", F.coalesce("lang", F.lit("")).alias("part"), text.alias("text"), F.xxhash64(text).alias("text_hash"))
    flags = docs.select(
        "doc_id",
        "part",
        "text_hash",
        F.unhex(F.sha2("text", 256)).alias("digest"),
        (100 * F.regexp_count("text", F.lit("[A-Z]")).cast("long") > 10 * F.length("text").cast("long")).alias("C"),
        F.col("text").rlike(r"[#$%&*|]").alias("D"),
    )
    flags = materialise(flags, "filter-flags")  # narrow rows, read twice below; the texts are not read again for them
    again = flags.groupBy("digest").agg(F.min("doc_id").alias("first"), F.count("*").alias("copies")).where("copies > 1").drop("copies")
    again = materialise(again, "filter-repeated")  # so that the join below has plain shuffles on both sides, and a hot text is split over tasks
    marks = labels.groupBy("doc_id").agg(F.max("quality").alias("quality"), F.max("toxic").alias("toxic"))
    counts = word_counts(docs).withColumnsRenamed({"doc_id": "of", "text_hash": "of_hash"})
    found = flags.join(again, "digest", "left")
    found = found.join(counts, F.col("doc_id").eqNullSafe(F.col("of")) & (F.col("text_hash") == F.col("of_hash")), "left").join(marks, "doc_id", "left")
    n_words, n_distinct = (F.coalesce(c, F.lit(0)) for c in ("n_words", "n_distinct"))
    fails = [n_words < 100, 100 * n_distinct < 80 * n_words, F.col("C"), F.col("D"), F.coalesce(F.col("doc_id") > F.col("first"), F.lit(False))]
    failed = sum(F.when(f, F.lit(1 << i)).otherwise(0) for i, f in enumerate(fails))
    return found.select("doc_id", "part", failed.alias("failed"), F.coalesce(F.col("quality") == 1, F.lit(False)).alias("good"), F.coalesce(F.col("toxic") == 1, F.lit(False)).alias("toxic"))


def _total(counts: str, keep) -> Column:
    """The sum of counts (an array by set of filters) over the sets that keep holds of."""
    numbered = F.transform(counts, lambda n, i: F.when(keep(i), n).otherwise(0))
    return F.aggregate(numbered, F.lit(0).cast("long"), lambda a, n: a + n)


def audit(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """One row for each part, order of the filters and step in it; see the module."""
    per_set = lambda what, alias: F.array(*[F.count_if((F.col("failed") == m) & what) for m in range(SETS)]).alias(alias)
    with scratch(docs.sparkSession) as own:
        failed = own.keep(materialise(failures(docs, labels), "filter-failures"))
    parts = failed.groupBy("part").agg(per_set(F.lit(True), "docs"), per_set(F.col("good"), "good"), per_set(F.col("toxic"), "toxic"))
    orders = F.lit(["".join(p) for p in permutations(FILTERS)])
    steps = parts.withColumn("filter_order", F.explode(orders)).withColumn("step", F.explode(F.sequence(F.lit(1), F.lit(len(FILTERS)))))
    at = F.instr(F.lit(FILTERS), F.col("filter_order").substr(F.col("step"), F.lit(1)))
    before = sum(F.when(F.instr("filter_order", f) < F.col("step"), F.lit(1 << i)).otherwise(0) for i, f in enumerate(FILTERS))
    steps = steps.select("*", F.pow(F.lit(2), at - 1).cast("int").alias("bit"), before.alias("before"))
    has = lambda m, bits: m.bitwiseAND(F.col(bits)) != 0
    here = lambda m: has(m, "bit") & ~has(m, "before")
    # of the orders of all filters, the one of a set of k comes first among the set in one of k
    weighed = F.transform("docs", lambda n, m: n * (F.lit(factorial(len(FILTERS))) / F.greatest(F.bit_count(m), F.lit(1))).cast("long"))
    steps = steps.withColumn("weighed", weighed)
    return steps.select(
        "part",
        "filter_order",
        "step",
        _total("docs", lambda m: ~has(m, "bit") & ~has(m, "before")).alias("kept"),
        _total("docs", here).alias("removed"),
        _total("docs", lambda m: has(m, "bit") & has(m, "before")).alias("redundant"),
        F.element_at("docs", F.col("bit") + 1).alias("unique_fails"),
        _total("good", here).alias("good_lost"),
        _total("toxic", here).alias("toxic_lost"),
        _total("weighed", lambda m: has(m, "bit")).alias("shapley"),
    )
