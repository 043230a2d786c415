"""Legal texts: sections, comparison, word diff and reading health."""

from __future__ import annotations

import re

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tallyloom.functions import text as X

#: A heading opens a section: an article, chapter or title with its number.
HEADING = r"(?i)^\s*(art(?:icolul)?\.?|cap(?:itolul)?\.?|titlul)\s*([0-9]+|[ivxlc]+)\b"
_LEGAL = r"(?i)\b(lege|proiect|guvern|parlament|articol|art\.|alin\.|rom[aâ]niei)"
_ORDINARY = r"[\p{L}\p{N}\s.,;:!?'\"()/\-\[\]{}%+*=<>]"


def sections(docs: DataFrame, key: str = "doc_id", text: str = "text", heading: str = HEADING) -> DataFrame:
    """key, section (0: before the first heading), heading, body: a running count of headings numbers the lines of a text."""
    lines = docs.select(key, F.posexplode(F.split(text, "\n")).alias("line", "body"))
    w = W.partitionBy(key).orderBy("line").rowsBetween(W.unboundedPreceding, 0)
    own = F.rlike("body", F.lit(heading)).cast("int")
    numbered = lines.withColumns({"section": F.sum(own).over(w), "heading": F.when(own == 1, F.lower(F.btrim(F.regexp_extract("body", heading, 0))))})
    body = F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("line", "body"))), lambda x: x["body"]), "\n")
    return numbered.groupBy(key, "section").agg(F.coalesce(F.max("heading"), F.lit("")).alias("heading"), body.alias("body"))


# The headings of a bill's parts (a line of its own, any case) with the kind of part that each opens, and the wording of amendments.
_NUMBER = "[0-9IVXLCDM]+"
PART_HEADINGS = (
    ("unique_article", r"Articol\s+unic", None),
    ("article", rf"Art\.?\s+({_NUMBER})[¹²³]?[.)]?|Articolul\s+({_NUMBER})[¹²³]?[.)]?", 2),
    ("amendment", rf"La\s+articolul\s+({_NUMBER})[¹²³]?.*", 1),
    ("point", rf"Punctul\s+({_NUMBER})[.)]?.*", 1),
    ("paragraph", rf"Alineatul\s+\(?({_NUMBER})\)?.*", 1),
    ("annex", rf"Anexa(?:\s+nr\.?\s*({_NUMBER}))?.*", 1),
)
_AMENDS = r"(?i)\b(se\s+modific[ăa]|se\s+completeaz[ăa]|se\s+abrog[ăa]|va\s+avea\s+urm[ăa]torul\s+cuprins|dup[ăa]\s+.*se\s+introduce)"
#: Lengths from which a part is huge or short, and a text without headings is suspect.
HUGE, SHORT, LONG_TEXT = 8000, 80, 700


def bill_parts(bills: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """The parts of bills in order: key, place, id, heading, part (its kind), number, body, starts, ends (offsets in code points).

    Lines before the first heading are the preamble; blank lines belong to no part. A running count of headings numbers the parts, and a running sum of
    lengths gives the offsets.
    """
    whole = F.replace(F.coalesce(F.col(text), F.lit("")), F.lit("\r"), F.lit("\n"))
    lines = bills.select(key, F.length(whole).alias("size"), F.posexplode(F.split(whole, "\n", -1)).alias("line", "raw"))
    w = W.partitionBy(key).orderBy("line")
    lines = lines.withColumns({"at": F.coalesce(F.sum(F.length("raw") + 1).over(w.rowsBetween(W.unboundedPreceding, -1)), F.lit(0)), "body": F.regexp_replace("raw", r"^\s+|\s+$", "")})
    kind, number = F.lit(None).cast("string"), F.lit(None).cast("string")
    for name, pattern, groups in reversed(PART_HEADINGS):
        hit = F.rlike("body", F.lit(rf"(?i)^(?:{pattern})$"))
        found = [F.nullif(F.regexp_extract("body", rf"(?i)^(?:{pattern})$", i + 1), F.lit("")) for i in range(groups or 0)]
        kind, number = F.when(hit, name).otherwise(kind), F.when(hit, F.coalesce(*found) if found else F.lit(None)).otherwise(number)
    told = lines.withColumns({"kind": kind, "number": number}).where("body <> ''")
    section = told.withColumn("section", F.sum(F.col("kind").isNotNull().cast("int")).over(w.rowsBetween(W.unboundedPreceding, 0)))
    body = F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("line", "body"))), lambda x: x["body"]), "\n")
    part = section.groupBy(key, "section").agg(F.max("kind").alias("kind"), F.max("number").alias("number"), F.max(F.when(F.col("kind").isNotNull(), F.col("body"))).alias("heading"), body.alias("body"), F.min("at").alias("starts"), F.max("size").alias("size"))
    order = W.partitionBy(key).orderBy("section")
    heading = F.coalesce("heading", F.lit("Document"))
    slug = F.coalesce(F.nullif(X.slug(heading), F.lit("")), F.lit("document"))
    out = part.withColumns({"place": F.row_number().over(order), "ends": F.coalesce(F.lead("starts").over(order), F.col("size"))})
    return out.select(key, "place", F.concat(slug, F.lit("-"), F.col("place")).alias("id"), heading.alias("heading"), slug.alias("slug"), F.coalesce("kind", F.lit("preamble")).alias("part"), "number", "body", "starts", "ends")


def bill_reading(bills: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """How well bills read: key, parts, quality (good, partial, weak) and the warnings in order."""
    parts = bill_parts(bills, key, text)
    kept = F.col("part") != "preamble"
    by = parts.groupBy(key).agg(
        F.count_if(kept).alias("n"), F.count_if(kept & ~F.col("part").isin("amendment", "point", "paragraph")).alias("others"), F.max(F.length("body")).alias("longest"),
        F.count_if(kept & (F.length("body") < SHORT)).alias("short"), F.size(F.collect_set(F.when(kept, F.col("slug")))).alias("slugs"), F.count("*").alias("parts"),
    )
    t = F.coalesce(F.col(text), F.lit(""))
    rows = bills.select(key, t.alias("__t")).join(by, key, "left").fillna(0, ["n", "others", "longest", "short", "slugs", "parts"])
    blank = F.btrim(F.regexp_replace("__t", r"\s+", " ")) == ""
    n, amending = F.col("n"), (F.col("n") == 0) & F.rlike("__t", F.lit(_AMENDS))
    warnings = [
        F.when((n == 0) & (F.length("__t") > LONG_TEXT), "no_structural_headings"),
        F.when((n > 0) & (F.col("others") == 0), "amendment_only_document"),
        F.when(F.col("longest") > HUGE, "huge_section"),
        F.when(F.col("slugs") < n, "duplicate_section_heading"),
        F.when((n >= 8) & (F.col("short") / n > 0.5), "too_many_short_sections"),
        F.when(amending, "amendment_only_document"),
    ]
    told = F.when(blank, F.array(F.lit("empty_text"))).otherwise(F.filter(F.array(*warnings), lambda x: x.isNotNull()))
    out = rows.withColumn("warnings", told)
    few = (F.size("warnings") <= 2) & (n > 0) & ~blank
    return out.select(key, F.col("parts").cast("int").alias("parts"), F.when(F.size("warnings") == 0, "good").when(few, "partial").otherwise("weak").alias("quality"), "warnings")


def compare(old: DataFrame, new: DataFrame, keys: list[str]) -> DataFrame:
    """Sections of two versions by heading (the last of equal ones wins): added, removed, changed or unchanged."""
    last = lambda df, name: df.groupBy(*keys, "heading").agg(F.max_by("body", "section").alias(name))
    both = last(old, "before").join(last(new, "after"), [*keys, "heading"], "full_outer")
    status = F.when(F.col("before").isNull(), "added").when(F.col("after").isNull(), "removed").when(F.col("before") != F.col("after"), "changed").otherwise("unchanged")
    return both.select(*keys, "heading", status.alias("status"))


def longest_common(a: list[str], b: list[str]) -> list[tuple[int, int]]:
    """The places of a longest common subsequence; where both ways are as long, a's word is left out first."""
    code = {w: i for i, w in enumerate(dict.fromkeys(a + b))}
    x, y = np.array([code[w] for w in a], int), np.array([code[w] for w in b], int)
    best = np.zeros((len(a) + 1, len(b) + 1), int)
    for i in range(len(a) - 1, -1, -1):
        here = np.where(y == x[i], best[i + 1, 1:] + 1, best[i + 1, :-1])
        # The best of leaving out words of b is a running maximum from the right.
        best[i, :-1] = np.maximum.accumulate(here[::-1])[::-1]
    out, i, j = [], 0, 0
    while i < len(a) and j < len(b):
        if x[i] == y[j]:
            out.append((i, j))
            i, j = i + 1, j + 1
        elif best[i + 1, j] >= best[i, j + 1]:
            i += 1
        else:
            j += 1
    return out


def word_diff(before: str | None, after: str | None, longest: int = 4000, most: int = 240) -> list[dict] | None:
    """Equal, removed and added stretches of words along a longest common subsequence; null for texts too long to show."""
    if before is None or after is None or max(len(before), len(after)) > longest:
        return None
    a, b = re.findall(r"\s+|\S+", before)[:most], re.findall(r"\s+|\S+", after)[:most]
    out: list[dict] = []

    def add(kind: str, text: str) -> None:
        if text and out and out[-1]["kind"] == kind:
            out[-1]["text"] += text
        elif text:
            out.append({"kind": kind, "text": text})

    i = j = 0
    for m, n in [*longest_common(a, b), (len(a), len(b))]:
        add("removed", "".join(a[i:m]))
        add("added", "".join(b[j:n]))
        add("same", "".join(a[m : m + 1]) if m < len(a) and n < len(b) else "")
        i, j = m + 1, n + 1
    return out


@F.pandas_udf(T.ArrayType(T.StructType([T.StructField("kind", T.StringType()), T.StructField("text", T.StringType())])))
def diffed(before: pd.Series, after: pd.Series) -> pd.Series:
    return pd.Series([word_diff(a, b) for a, b in zip(before, after, strict=True)])


def health(text: Column, chunk_count: Column) -> Column:
    """Reasons to distrust a read text, in order."""
    t = F.coalesce(text, F.lit(""))
    lines = F.filter(F.transform(F.split(t, r"\n+"), lambda x: F.lower(F.btrim(x))), lambda x: x != "")
    weird = F.when(F.length(t) == 0, 1.0).otherwise(F.length(F.regexp_replace(t, _ORDINARY, "")) / F.length(t))
    again = F.when(F.size(lines) == 0, 0.0).otherwise((F.size(lines) - F.size(F.array_distinct(lines))) / F.size(lines))
    reasons = [
        F.when(F.coalesce(chunk_count, F.lit(0)) == 0, "missing_text_chunks"),
        F.when((F.length(t) > 0) & (F.length(t) < 500), "very_short_text"),
        F.when((F.length(t) >= 500) & (F.regexp_count(t, F.lit(_LEGAL)) < 3), "low_legal_vocabulary"),
        F.when(F.round(weird, 3) > 0.08, "high_noise_ratio"),
        F.when((F.round(again, 3) > 0.35) & (F.size(lines) >= 12), "high_repeated_line_ratio"),
    ]
    return F.filter(F.array(*reasons), lambda r: r.isNotNull())
