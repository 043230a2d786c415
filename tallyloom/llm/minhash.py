"""Near duplicates: MinHash bands propose, odd sketches sift, full sets confirm.

A document is the set of its word shingles. Documents with the same set collapse into one class before anything else. For
the representatives, `BANDS` x `ROWS` MinHash values make the band keys (a pair at similarity 0.8 shares none of 40 bands of
5 with probability 1e-7). The values are also folded into an odd sketch, a bitmap in which each value flips one
bit; the population count of the XOR of two sketches estimates a high similarity closely, and pairs estimated `MARGIN`
(over six standard errors) below the threshold are dropped. The others are confirmed on the full sets.

All pairs within a bucket are never made. First every member of a bucket is compared with its most central one, the
document that meets the most others in all bands; linked documents become one component. What is left are mostly buckets
of documents that share a passage but are not alike; an exact way finds any link among them: prefix, length and position
filters on the shingles, rarest first, and pairs are made only across components, never within a token's largest one. Links inside a component
can't change it, so the components are those of the full graph.

Edge cases: null and empty texts have no shingles and are linked with nothing; a text with fewer words than a shingle is
one shingle; rows with a null id are linked with nothing (component null, kept); repeated rows belong to one class and
are reported each.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyloom.llm.hashing import Words, mix, runs
from tallyloom.operators.entities import connected
from tallyloom.session import bounded_batches, materialise, scratch

BANDS, ROWS, SKETCH_BITS, MARGIN = 40, 5, 1024, 0.2
#: Rows of a common shingle that one task takes.
TASK = 1000
_SEED = np.random.default_rng(20).integers(1, 2**63, (2, BANDS * ROWS), dtype=np.uint64)
_A, _B = _SEED[0] * np.uint64(2) + np.uint64(1), _SEED[1]


def shingles(text: str | None, k: int, words: Words) -> np.ndarray:
    """Sorted distinct shingle hashes of a text; A-Z in lower case."""
    w = (text or "").encode().lower().split()
    if not w:
        return np.zeros(0, np.uint64)
    h = words(w)
    return np.unique(runs(h, min(k, len(w))))


def signature(s: np.ndarray) -> np.ndarray:
    low = np.full(len(_A), np.iinfo(np.uint64).max, np.uint64)
    for at in range(0, len(s), 2048):
        low = np.minimum(low, (s[at : at + 2048, None] * _A + _B).min(0))
    return low >> np.uint64(24)


def band_keys(sig: np.ndarray) -> np.ndarray:
    rows = sig.reshape(BANDS, ROWS)
    key = np.arange(1, BANDS + 1, dtype=np.uint64)
    for j in range(ROWS):
        key = mix(key * np.uint64(0x9E3779B97F4A7C15) + rows[:, j])
    return key.view(np.int64)


def odd_sketch(sig: np.ndarray) -> np.ndarray:
    at = mix(sig + np.arange(len(sig), dtype=np.uint64) * np.uint64(0xD6E8FEB86659FD93)) % np.uint64(SKETCH_BITS)
    return np.packbits((np.bincount(at.astype(np.int64), minlength=SKETCH_BITS) & 1).astype(np.uint8)).view(np.int64)


def described(docs: DataFrame, k: int) -> DataFrame:
    """doc_id, n_shingles, class fingerprint, band keys and odd sketch of every document."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        words = Words()
        for b in batches:
            rows = []
            for doc_id, text in zip(b["doc_id"], b["text"], strict=True):
                s = shingles(text, k, words)
                if len(s):
                    sig = signature(s)
                    rows.append((doc_id, len(s), xxhash.xxh3_128_hexdigest(s.tobytes()), band_keys(sig), odd_sketch(sig)))
                else:
                    rows.append((doc_id, 0, None, None, None))
            yield pd.DataFrame(rows, columns=["doc_id", "n_shingles", "same", "bands", "odd"]).astype({"doc_id": "Int64"})

    return docs.select("doc_id", "text").mapInPandas(run, "doc_id long, n_shingles long, same string, bands array<long>, odd array<long>")


def estimate(a: Column, b: Column) -> Column:
    """Similarity that two odd sketches tell of."""
    z = F.aggregate(F.zip_with(a, b, lambda x, y: F.bit_count(x.bitwiseXOR(y))), F.lit(0), lambda t, x: t + x)
    inside = F.greatest(1 - 2 * z / SKETCH_BITS, F.lit(1e-9))
    return 1 + SKETCH_BITS / (4 * BANDS * ROWS) * F.log(inside)


def confirmed(pairs: DataFrame, odd: DataFrame, sets: DataFrame, threshold: int) -> DataFrame:
    """The pairs (a, b) whose sets meet 100 * |intersection| >= threshold * |union|."""
    side = lambda df, c, k: df.select(F.col("doc").alias(k), F.col(c).alias(f"{c}_{k}"))
    likely = pairs.join(side(odd, "odd", "a"), "a").join(side(odd, "odd", "b"), "b")
    likely = likely.where(estimate(F.col("odd_a"), F.col("odd_b")) >= threshold / 100 - MARGIN).select("a", "b")

    full = likely.join(side(sets, "set", "a"), "a").join(side(sets, "set", "b"), "b")
    both = F.size(F.array_intersect("set_a", "set_b"))
    return full.where(100 * both >= threshold * (F.size("set_a") + F.size("set_b") - both)).select("a", "b")


def crossing(rows: DataFrame, key: str, threshold: int, *apart: Column) -> DataFrame:
    """Pairs (a, b) of documents in rows (key, doc, component, n, more) that share a key but no component; extra conditions are on x and y.

    Sets that meet the threshold are of like size, so a key is split into bands of size: a row is in its own band and visits the next
    one, where only a row at home can meet it. Within a key and band, pairs need a row outside the largest component; those rows are
    dealt by `TASK` rows to a share, and what they meet is given to each share, so that no task takes a common key alone.
    """
    step = max(math.log(100 / threshold), 0.05) * (1 + 1e-9)
    both = rows.withColumn("at", F.explode(F.array(F.struct(F.lit(False).alias("visits"), F.lit(0).alias("up")), F.struct(F.lit(True).alias("visits"), F.lit(1).alias("up")))))
    both = both.withColumns({"band": (F.floor(F.log("n") / step) + F.col("at.up")).cast("int"), "visits": F.col("at.visits")}).drop("at")
    on = [key, "band"]
    sizes = both.groupBy(*on, "component").agg(F.count("*").alias("c")).groupBy(*on).agg(F.count("*").alias("parts"), F.max_by("component", "c").alias("most"), F.sum("c").alias("rows")).where("parts > 1")
    here = both.join(sizes.select(*on, "most", F.ceil(F.col("rows") / TASK).cast("int").alias("shares")), on)
    told = [c for c in both.columns if c not in on]
    a = here.where("component <> most").select(*on, F.pmod(F.xxhash64("doc"), F.col("shares")).cast("int").alias("share"), F.struct(*told).alias("x"))
    b = here.select(*on, F.explode(F.sequence(F.lit(0), F.col("shares") - 1)).alias("share"), F.struct(*told).alias("y"))
    pairs = a.join(b, [*on, "share"]).where((F.col("x.component") != F.col("y.component")) & ~(F.col("x.visits") & F.col("y.visits")))
    for condition in apart:
        pairs = pairs.where(condition)
    return pairs.select(F.greatest("x.doc", "y.doc").alias("a"), F.least("x.doc", "y.doc").alias("b")).distinct()


def by_prefix(left: DataFrame, sets: DataFrame, threshold: int) -> DataFrame:
    """Pairs of documents of different components (doc, component) that prefix, length and position of their shingles can't rule out.

    Rarest shingles first, the first shingle that two linked documents share is among the first n - threshold * n + 1 of the
    larger and, since they share at least 2 * threshold / (1 + threshold) of the smaller, among fewer of the smaller; what follows it
    in either must still hold as many shingles as the two have to share.
    """
    mine = sets.join(left, "doc").select("doc", "component", F.size("set").alias("n"), F.explode("set").alias("token"))
    common = mine.groupBy("token").agg(F.count("*").alias("df"))
    ranked = mine.join(common, "token").groupBy("doc", "component", "n").agg(F.sort_array(F.collect_list(F.struct("df", "token"))).alias("t"))
    length = (F.col("n") - F.floor((F.col("n") * threshold + 99) / 100) + 1).cast("int")
    short = F.col("n") - F.ceil(2 * threshold * F.col("n") / (100 + threshold)) + 1
    rows = ranked.select("doc", "component", "n", short.alias("short"), F.posexplode(F.slice("t", F.lit(1), length)).alias("pos", "t"))
    rows = rows.where("t.df > 1").select("doc", "component", "n", "short", "pos", F.col("t.token").alias("token"))
    alike = 100 * F.least("x.n", "y.n") >= threshold * F.greatest("x.n", "y.n")
    x_less = (F.col("x.n") < F.col("y.n")) | ((F.col("x.n") == F.col("y.n")) & (F.col("x.doc") < F.col("y.doc")))
    early = F.when(x_less, F.col("x.pos") < F.col("x.short")).otherwise(F.col("y.pos") < F.col("y.short"))
    enough = (100 + threshold) * F.least(F.col("x.n") - F.col("x.pos"), F.col("y.n") - F.col("y.pos")) >= threshold * (F.col("x.n") + F.col("y.n"))
    return crossing(rows, "token", threshold, alike, early, enough)


def link(docs: DataFrame, k: int = 5, threshold: int = 80) -> DataFrame:
    """doc_id, n_shingles, component_id, kept for every row of docs."""
    bounded_batches(docs.sparkSession)
    with scratch(docs.sparkSession) as own:
        return own.keep(materialise(_linked(docs, k, threshold), "linked"))


def _linked(docs: DataFrame, k: int, threshold: int) -> DataFrame:
    all_ = materialise(described(docs, k), "described")
    some = all_.where(F.col("same").isNotNull() & F.col("doc_id").isNotNull())
    classes = some.groupBy("same").agg(F.min("doc_id").alias("rep"))
    reps = some.select("same", F.col("doc_id").alias("doc"), "bands", "odd").join(classes.withColumnRenamed("rep", "doc"), ["same", "doc"], "left_semi").dropDuplicates(["doc"])
    reps = materialise(reps.select("doc", "bands", "odd"), "representatives")
    rows = reps.select("doc", F.explode("bands").alias("key"))
    shared = rows.groupBy("key").agg(F.count("*").alias("n")).where("n > 1")
    met = rows.join(shared, "key")
    central = met.groupBy("doc").agg(F.sum("n").alias("near"))
    buckets = materialise(met.join(central, "doc").select("key", "doc", "near"), "buckets")
    wanted = buckets.select("doc").distinct()
    odd = materialise(reps.select("doc", "odd").join(wanted, "doc"), "sketches")

    def full(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        words = Words()
        for b in batches:
            yield pd.DataFrame({"doc": b["doc"], "set": [shingles(t, k, words).view(np.int64) for t in b["text"]]})

    texts = docs.select(F.col("doc_id").alias("doc"), "text").where(F.col("text").isNotNull())
    # The same plan at every size: texts meet ids by a sorted merge, whether the ids are few or many.
    sets = materialise(texts.join(wanted.hint("merge"), "doc").mapInPandas(full, "doc long, set array<long>").dropDuplicates(["doc"]), "sets")

    # Every member of a bucket against its most central one.
    pivot = buckets.groupBy("key").agg(F.min_by("doc", F.struct(-F.col("near"), "doc")).alias("pivot"))
    pairs = buckets.join(pivot, "key").where("doc <> pivot").select(F.greatest("doc", "pivot").alias("a"), F.least("doc", "pivot").alias("b")).distinct()
    links = materialise(confirmed(pairs, odd, sets, threshold), "links")
    found = connected(links).withColumnRenamed("id", "doc")
    # A bucket of two has been compared; one of a single component can't change anything.
    now = buckets.join(found, "doc", "left").select("key", "doc", F.coalesce("component", "doc").alias("component"))
    open_ = now.groupBy("key").agg(F.count("*").alias("n"), F.min("component").alias("lo"), F.max("component").alias("hi")).where("n > 2 and lo < hi")
    left = materialise(now.join(open_.select("key"), "key", "left_semi").select("doc", "component").distinct(), "left")
    more = materialise(confirmed(by_prefix(left, sets, threshold), odd, sets, threshold), "links")
    if not more.isEmpty():
        found = connected(links.unionByName(more)).withColumnRenamed("id", "doc")
    named = some.select("doc_id", "same").join(classes, "same").select("doc_id", "same", "rep")
    named = named.join(found.withColumnRenamed("doc", "rep"), "rep", "left").select("doc_id", "same", F.coalesce("component", "rep").alias("component_id")).distinct()
    alone = all_.where(F.col("same").isNull() | F.col("doc_id").isNull()).select("doc_id", "n_shingles", F.col("doc_id").alias("component_id"))
    out = some.select("doc_id", "same", "n_shingles").join(named, ["doc_id", "same"]).select("doc_id", "n_shingles", "component_id").unionByName(alone)
    return out.withColumn("kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True)))


def deduplicate(docs: DataFrame, k: int = 5, threshold: int = 80) -> DataFrame:
    """docs without the documents that another of their group stands for; all rows of the smallest id of a group stay."""
    gone = link(docs, k, threshold).where(~F.col("kept")).select(F.col("doc_id").alias("__gone")).distinct()
    return docs.join(gone.hint("merge"), docs["doc_id"] == F.col("__gone"), "left_anti")
