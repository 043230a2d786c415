"""Sanctions of members as a chamber's page lists them (J13): entries between rules, each a headline with links to its documents."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tallyloom.functions.text import fold_ro, ro_date, squash

# Numbers in words, and the wording of a headline.
COUNTS = {"o": 1, "un": 1, "una": 1, "doua": 2, "trei": 3, "patru": 4, "cinci": 5, "sase": 6, "sapte": 7, "opt": 8, "noua": 9, "zece": 10}
_KINDS = (
    ("warning", "atentionarea"),
    ("call_to_order", "chemarea la ordine"),
    ("floor_withdrawn", "retragerea cuvantului"),
    ("written_warning", r"avertisment\w* scris"),
    ("speaking_time_reduced", r"reducerii duratei luarii de cuvant la (\d+) secunde(?:/interventie)?(?: pe o perioada de (\w+) lun)?"),
    ("allowance_reduced", r"diminuar\w+ (?:a )?indemniz\S* cu (\d+)%\s*(?:pe o perioada de (\w+) lun)?"),
)
_DATE = r"^\d{1,2}\s+[a-z]+\s+\d{4}\s*-\s*"
_PERSON = r"(?i)(?:domnului|doamnei)\s+deputat(?:ă)?\s+([^,.]+?)(?=\s+(?:pentru|cu aplicarea|de diminuare|membr[uă]|în conformitate|în cadrul)\b|\s*[,.]|\s*$)"
_GROUP = r"(?i)membr[uă]\s+al?\s+Grupului\s+parlamentar\s+(?:al\s+)?([^.,]+)"
_GROUP_ALONE = r"(?i)membr[uă]\s+al\s+([^.,]+)"
_ARTICLE = r"(?i)(art\.\s*\d+[^;]*?)\s+din\s+Regulament"
_DECISION = r"(?i)Nr\.?\s*(\d+)\s*/\s*(\d{2})-(\d{2})-(\d{4})"
_BOLD = r"(?is)<b\b[^>]*>(.*?)</b>"
_LINK = r"(?is)<a\b[^>]*?\bhref\s*=\s*[\"']([^\"']*)[\"'][^>]*>(.*?)</a>"


def _text(html: Column) -> Column:
    """Marks off, the common character references written out, single spaces."""
    out = F.regexp_replace(html, r"(?s)<[^>]*>", "")
    for ref, c in (("&nbsp;", " "), ("&quot;", '"'), ("&lt;", "<"), ("&gt;", ">"), ("&amp;", "&")):
        out = F.replace(out, F.lit(ref), F.lit(c))
    return squash(F.replace(out, F.lit(" "), F.lit(" ")))


def _count(word: Column) -> Column:
    table = F.create_map(*[F.lit(x) for pair in COUNTS.items() for x in pair])
    return F.coalesce(word.try_cast("int"), table[word])


def parts(text: Column) -> Column:
    """What the words of a folded headline say plainly: array<struct<kind, percent, months, seconds>>."""
    rows = []
    for kind, pattern in _KINDS:
        number = F.regexp_extract(text, pattern, 1).try_cast("int") if "(" in pattern else F.lit(None)
        months = _count(F.nullif(F.regexp_extract(text, pattern, 2), F.lit(""))) if "(" in pattern else F.lit(None)
        told = F.struct(
            F.lit(kind).alias("kind"),
            (number if kind == "allowance_reduced" else F.lit(None)).cast("int").alias("percent"),
            months.cast("int").alias("months"),
            (number if kind == "speaking_time_reduced" else F.lit(None)).cast("int").alias("seconds"),
        )
        rows.append(F.when(F.rlike(text, F.lit(pattern)), told))
    return F.filter(F.array(*rows), lambda p: p.isNotNull())


def headline_facts(rows: DataFrame, headline: str) -> DataFrame:
    """rows with held_on, headline (without the date), name, group, parts, kind and article. Each fact is a column before the next one is told by
    it: written into one another they would be worked out once for every use."""
    out = rows.withColumn("__plain", F.regexp_extract(fold_ro(F.col(headline)), _DATE, 0))
    out = out.withColumn("__day", F.regexp_extract("__plain", r"^\d{1,2}\s+[a-z]+\s+\d{4}", 0))
    out = out.withColumn("held_on", F.when(F.col("__plain") != "", ro_date(F.col("__day"))))
    out = out.withColumn("headline", F.when(F.col("held_on").isNotNull(), F.btrim(F.regexp_replace(headline, r"^.*?\s-\s", ""))).otherwise(F.col(headline)))
    out = out.withColumn("__folded", fold_ro(F.col("headline"))).withColumn("parts", parts(F.col("__folded")))
    part = lambda p: F.nullif(squash(F.regexp_extract("headline", p, 1)), F.lit(""))
    kind = F.when(F.size("parts") == 1, F.get("parts", F.lit(0))["kind"]).when(F.size("parts") > 1, "combined")
    kind = kind.when(F.rlike("headline", F.lit("(?i)Deciziile? Biroului permanent")), "bureau_decision").otherwise("other")
    return out.withColumns({"name": part(_PERSON), "group": F.coalesce(part(_GROUP), part(_GROUP_ALONE)), "kind": kind, "article": part(_ARTICLE)}).drop("__plain", "__day", "__folded")


def sanctions(pages: DataFrame, legislature: str = "legislature", html: str = "html") -> DataFrame:
    """One row for each entry of the pages: id, legislature, at (its place), informational, the facts of its headline, the decision
    (number, day, address), the contestation with its outcome, and the stenogram.

    An entry about several members at once, or one that only announces decisions, is informational. Two entries of the same words on one day
    differ by their stenogram, or by their place.
    """
    entry = pages.select(legislature, F.posexplode(F.split(html, r"(?i)<hr\b[^>]*>")).alias("at", "block")).where(F.rlike("block", F.lit(r"(?i)<b\b")))
    bold = F.filter(F.transform(F.regexp_extract_all("block", F.lit(_BOLD), F.lit(1)), _text), lambda b: b != "")
    links = F.arrays_zip(F.regexp_extract_all("block", F.lit(_LINK), F.lit(1)).alias("href"), F.transform(F.regexp_extract_all("block", F.lit(_LINK), F.lit(2)), _text).alias("label"))
    entry = entry.select(legislature, "at", bold.alias("bold"), links.alias("links")).withColumn("first", F.get("bold", F.lit(0)))
    link = lambda p: F.get(F.filter("links", lambda x: F.rlike(x["label"], F.lit(p))), F.lit(0))
    ruling = F.get(F.filter(F.slice("bold", 2, 1000), lambda b: F.rlike(b, F.lit(r"(?i)^HCD\b"))), F.lit(0))
    entry = headline_facts(entry, "first").withColumns({"decision": link("(?i)vezi decizia"), "ruling": ruling})
    number = lambda i: F.nullif(F.regexp_extract(F.col("decision.label"), _DECISION, i), F.lit(""))
    rest = F.col("headline")
    told = entry.select(
        legislature, "at", "first", "held_on", "headline", "name", "group", "parts", "kind", "article",
        (F.rlike(rest, F.lit("(?i)^Informare privind adoptarea")) | (F.rlike(rest, F.lit("(?i)Hot[ăa]r[âa]rilor")) & ~F.rlike(rest, F.lit("(?i)deputat")))).alias("informational"),
        number(1).alias("decision_number"), F.concat_ws("-", number(4), number(3), number(2)).try_cast("date").alias("decision_on"), F.col("decision.href").alias("decision_url"),
        link("(?i)vezi contesta")["href"].alias("filed_url"),
        F.when(F.rlike("ruling", F.lit("(?i)admiterea")), "upheld").when(F.rlike("ruling", F.lit("(?i)respingerea")), "rejected").alias("outcome"),
        link("(?i)stenogram")["href"].alias("stenogram_url"),
    ).withColumn("words", F.concat_ws("|", F.coalesce(F.col("held_on").cast("string"), F.lit("")), "first"))
    # An entry that says nothing has no first: it shares its words with none that does, and goes after the window, below which its test would work all out twice.
    told = told.withColumn("first_at", F.min("at").over(W.partitionBy(legislature, "words"))).where(F.col("first").isNotNull())
    digest = lambda c: F.concat(F.lit("sanction-"), F.col(legislature).cast("string"), F.lit("-"), F.left(F.sha2(c, 256), F.lit(12)))
    again = F.concat_ws("|", "words", F.coalesce("stenogram_url", F.col("at").cast("string")))
    return told.withColumn("id", F.when(F.col("at") == F.col("first_at"), digest(F.col("words"))).otherwise(digest(again))).drop("words", "first", "first_at")
