"""Quality rules with risk-controlled cutoffs.

Each rule is a statistic of a text, larger being worse, with a cutoff for each of `LEVELS` levels from lenient to strict; a level
applies the cutoffs of all rules together. On labelled documents that pass the base rule, the good ones that a level would reject are counted in each
stratum (language). A level is certified when the exact binomial tail says that at most ALPHA of the good documents of the
stratum are rejected, with error DELTA shared out over the strata (Bonferroni); within a stratum the levels are one path, tested in order,
and the first that fails ends it, which needs no further correction. With probability 1 - DELTA, no stratum's verdict rejects more
than ALPHA of its good documents. A stratum with too few labels (under 90, even without a rejection) certifies nothing and rejects nothing.

DataFrame functions only; what comes to the driver is a count for each stratum and level (at most five rows).

Edge cases: null and empty texts have no words and count 0 everywhere, so they fail the base rule; languages that are null
or not listed form the stratum "other"; without labels nothing is certified; repeated rows are judged each; columns of the input
with the names of the counts are replaced by the counts.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyloom.llm.common import words
from tallyloom.session import materialise

ALPHA, DELTA = 0.05, 0.05
STRATA = ("en", "de", "fr", "es")
LEVELS = 6
#: Statistic and the cutoff of each level, lenient first.
RULES = {
    "symbols": (lambda c: c("n_symbols") / F.greatest(c("n_words"), F.lit(1)), (2.0, 1.0, 0.7, 0.5, 0.3, 0.15)),
    "capitals": (lambda c: c("n_upper") / F.greatest(c("word_chars"), F.lit(1)), (0.9, 0.8, 0.7, 0.6, 0.5, 0.4)),
    "exclaimed": (lambda c: c("n_exclaimed") / F.greatest(c("n_words"), F.lit(1)), (1.0, 0.8, 0.6, 0.5, 0.4, 0.3)),
    "stuttered": (lambda c: c("n_stutter") / F.greatest(c("n_words"), F.lit(1)), (0.45, 0.4, 0.35, 0.3, 0.25, 0.2)),
    "repeated": (lambda c: c("n_repeat_words") / F.greatest(c("n_words"), F.lit(1)), (0.49, 0.48, 0.46, 0.44, 0.42, 0.4)),
    "lines": (lambda c: c("n_dup_lines") / F.greatest(c("n_lines"), F.lit(1)), (0.8, 0.7, 0.6, 0.5, 0.45, 0.4)),
}


def measure(docs: DataFrame, text: str = "text") -> DataFrame:
    """docs with the counts that the rules use; nothing is shuffled."""
    t = F.coalesce(F.col(text), F.lit(""))
    lines = F.filter(F.split(t, "\n", -1), lambda x: F.rlike(x, F.lit(r"[^\x20\x09-\x0D]")))
    # Each step is its own projection, and each column is used more than once, so that no array is made again for each element.
    one = docs.withColumns({"__w": words(F.col(text)), "__l": lines})
    n = F.size("__w")
    w = F.col("__w")
    window = lambda i: F.xxhash64(F.get(w, i), F.get(w, i + 1), F.get(w, i + 2))
    count = lambda pattern: F.regexp_count(t, F.lit(pattern)).cast("long")
    two = one.withColumns({
        "n_words": n.cast("long"),
        "n_lines": F.size("__l").cast("long"),
        "n_dup_lines": (F.size("__l") - F.size(F.array_distinct("__l"))).cast("long"),
        "word_chars": F.length(t) - count(r"[\x20\x09-\x0D]"),
        "n_symbols": count(r"[#*$%&|<>]"),
        "n_exclaimed": count("!"),
        "n_upper": count(r"\p{Lu}"),
        "n_stutter": F.size(F.filter(w, lambda x, i: x == F.get(w, i + 1))).cast("long"),
        "__h": F.when(n >= 3, F.transform(F.sequence(F.lit(0), n - 3), window)),
    }).drop("__w", "__l")
    sorted_ = two.withColumn("__s", F.sort_array("__h"))
    # Most texts repeat no window: only the others sort their windows once more, now with positions.
    s = F.col("__s")
    some = sorted_.withColumn("__some", F.exists(F.transform(s, lambda x, j: x == F.get(s, j + 1)), lambda same: F.coalesce(same, F.lit(False)))).drop("__s")
    keyed = F.sort_array(F.transform("__h", lambda h, i: F.struct(h.alias("h"), i.alias("i"))))
    three = some.withColumn("__k", F.when(F.col("__some"), keyed)).drop("__h", "__some")
    k = F.col("__k")
    twice = F.filter(k, lambda x, j: (F.get(k, j + 1)["h"] == x["h"]) | F.coalesce(F.get(k, j - 1)["h"] == x["h"], F.lit(False)))
    covered = F.array_distinct(F.flatten(F.transform(twice, lambda x: F.array(x["i"], x["i"] + 1, x["i"] + 2))))
    return three.withColumn("n_repeat_words", F.coalesce(F.size(covered), F.lit(0)).cast("long")).drop("__k")


def stratum(lang: Column) -> Column:
    return F.when(lang.isin(*STRATA), lang).otherwise("other")


def tail(k: int, n: int, p: float) -> float:
    """P(Bin(n, p) <= k), exactly summed in logarithms."""
    terms = [math.lgamma(n + 1) - math.lgamma(i + 1) - math.lgamma(n - i + 1) + i * math.log(p) + (n - i) * math.log1p(-p) for i in range(min(k, n) + 1)]
    top = max(terms)
    return min(1.0, math.exp(top) * sum(math.exp(t - top) for t in terms))


def rejects(level: int) -> Column:
    """Whether some rule's cutoff of a level rejects a measured document."""
    hit = F.lit(False)
    for stat, cuts in RULES.values():
        hit = hit | (stat(F.col) > cuts[level])
    return hit


def calibrate(measured: DataFrame, labels: DataFrame, alpha: float = ALPHA, delta: float = DELTA) -> dict[str, int]:
    """The strictest certified level of each stratum. measured: doc_id, lang and counts; labels: doc_id, quality."""
    good = labels.where(F.col("quality") == 1).select("doc_id").distinct()
    held = measured.where(~base_failed()).join(good, "doc_id", "left_semi")
    counts = [F.count_if(rejects(i)).alias(f"level{i}") for i in range(LEVELS)]
    chosen = {}
    for row in held.groupBy(stratum(F.col("lang")).alias("stratum")).agg(F.count("*").alias("n"), *counts).collect():
        for i in range(LEVELS):
            if tail(row[f"level{i}"], row["n"], alpha) > delta / (len(STRATA) + 1):
                break
            chosen[row["stratum"]] = i
    return chosen


def verdict(chosen: dict[str, int]) -> Column:
    """Whether the level of its stratum rejects a measured document."""
    hit = F.lit(False)
    for s, level in sorted(chosen.items()):
        hit = hit | ((stratum(F.col("lang")) == s) & rejects(level))
    return hit


def base_failed() -> Column:
    return (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))


def judge(docs: DataFrame, labels: DataFrame, alpha: float = ALPHA, delta: float = DELTA) -> DataFrame:
    """One row for each document: doc_id, n_words, the base counts, base_failed, kept, and the rules' statistics."""
    measured = materialise(measure(docs.select("doc_id", "lang", "text")).drop("text"), "measured")
    chosen = calibrate(measured, labels, alpha, delta)
    return measured.withColumn("base_failed", base_failed()).withColumn("kept", ~(F.col("base_failed") | verdict(chosen)))
