"""Scalar text functions as columns; Python only where Spark has no built-in."""

from __future__ import annotations

import re
import unicodedata

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Romanian letters and what they fold to.
RO_FROM, RO_TO = "ăâîșşțţĂÂÎȘŞȚŢ", "aaissttAAISSTT"
MONTHS = ("ianuarie", "februarie", "martie", "aprilie", "mai", "iunie", "iulie", "august", "septembrie", "octombrie", "noiembrie", "decembrie")


def display(c: Column) -> Column:
    """Old cedilla and tilde letters as the ones in use."""
    return F.translate(c, "şţãŞŢÃ", "șțăȘȚĂ")


def fold_ro(c: Column) -> Column:
    return F.lower(F.translate(c, RO_FROM, RO_TO))


@F.pandas_udf(T.StringType())
def fold_any(texts: pd.Series) -> pd.Series:
    """Accents off, lower case, trimmed, for any script: Spark has no Unicode normalisation."""
    return texts.map(lambda t: None if t is None else "".join(x for x in unicodedata.normalize("NFD", t) if not unicodedata.combining(x)).lower().strip())


def alnum_key(c: Column) -> Column:
    return F.regexp_replace(fold_ro(c), "[^a-z0-9]", "")


def slug(c: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(fold_ro(c), "[^a-z0-9]+", "-"), "^-+|-+$", "")


def squash(c: Column) -> Column:
    return F.btrim(F.regexp_replace(c, r"\s+", " "))


def url_key(c: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(F.lower(c), r"^https?://(www\.)?", ""), r"\?nocache=true$", "")


def lei(c: Column) -> Column:
    """1.234,56 as a number; dots are always thousands."""
    return F.replace(F.replace(F.btrim(c), F.lit("."), F.lit("")), F.lit(","), F.lit(".")).try_cast("decimal(16,2)")


def ro_date(c: Column) -> Column:
    """`5 mai 2024` or `05.05.2024` as a date; null when neither."""
    named, month = r"(\d{1,2})\s+([a-z]+)\s+(\d{4})", F.regexp_extract(fold_ro(c), r"(\d{1,2})\s+([a-z]+)\s+(\d{4})", 2)
    part = lambda p, i: F.regexp_extract(fold_ro(c), p, i).try_cast("int")
    number = F.nullif(F.array_position(F.array(*map(F.lit, MONTHS)), month), F.lit(0)).cast("int")
    dotted = r"(\d{1,2})[.](\d{1,2})[.](\d{4})"
    text = lambda y, m, d: F.format_string("%04d-%02d-%02d", y, m, d).try_cast("date")
    return F.coalesce(text(part(named, 3), number, part(named, 1)), text(part(dotted, 3), part(dotted, 2), part(dotted, 1)))


def identifier(c: Column) -> Column:
    """`PL-x nr. 12/2026`, `L3 / 2025` in one form: kind, number/year."""
    p = r"(?i)\b(PL-?x|L|BP|b)\s*(?:nr\.?)?\s*(\d+)\s*/\s*(\d{4})"
    kind = F.upper(F.replace(F.regexp_extract(c, p, 1), F.lit("-"), F.lit("")))
    return F.when(kind != "", F.concat(F.when(kind == "PLX", "PL-x").otherwise(kind), F.lit(" "), F.regexp_extract(c, p, 2), F.lit("/"), F.regexp_extract(c, p, 3)))


def chunks(c: Column, size: int = 1800) -> Column:
    """Slices of a fixed length, trimmed, blank ones dropped."""
    at = F.sequence(F.lit(1), F.greatest(F.length(c), F.lit(1)), F.lit(size))
    return F.filter(F.transform(at, lambda i: F.btrim(F.substring(c, i, F.lit(size)))), lambda x: x != "")


def all_terms(text: Column, search: Column) -> Column:
    """Every folded term of a search occurs in the folded text."""
    return F.forall(F.filter(F.split(fold_ro(search), r"\s+"), lambda t: t != ""), lambda t: F.contains(fold_ro(text), t))


def name_tokens(c: Column) -> Column:
    return F.array_distinct(F.filter(F.split(F.regexp_replace(fold_ro(c), "[^a-z]+", " "), " "), lambda t: t != ""))


def names_match(a: Column, b: Column) -> Column:
    """The tokens of one name are among those of the other, at least two, in any order."""
    x, y = name_tokens(a), name_tokens(b)
    return (F.least(F.size(x), F.size(y)) >= 2) & ((F.size(F.array_except(x, y)) == 0) | (F.size(F.array_except(y, x)) == 0))


def constituency_key(c: Column) -> Column:
    """A constituency in one spelling: old and new letters of one sound alike, what follows the date off, all places abroad as one."""
    told = F.coalesce(c, F.lit(""))
    abroad = F.rlike(fold_ro(told), F.lit(r"\bdiaspora\b|\bafara (romaniei|tarii)\b|strainatate"))
    plain = F.regexp_replace(fold_ro(F.translate(told, "âîÂÎ", "iiii")), r"\s+in data de.*$", "")
    return F.when(abroad, "diaspora").otherwise(F.btrim(F.regexp_replace(plain, "[^a-z]+", " ")))


def one_letter_apart(a: Column, b: Column, least: int = 6) -> Column:
    return (F.least(F.length(a), F.length(b)) >= least) & (F.levenshtein(a, b) <= 1)


def snippets(text: str, term: str, most: int = 5, before: int = 120, after: int = 160) -> list[str]:
    """Surroundings of the first hits, with ellipses where they are cut."""
    out, at, low, t = [], 0, text.lower(), term.lower()
    while t and len(out) < most and (at := low.find(t, at)) >= 0:
        a, b = max(0, at - before), min(len(text), at + len(t) + after)
        out.append(("…" if a else "") + re.sub(r"\s+", " ", text[a:b]).strip() + ("…" if b < len(text) else ""))
        at += len(t)
    return out


def found_snippets(text: Column, term: str) -> Column:
    run = F.pandas_udf(lambda s: s.map(lambda x: snippets(x or "", term)), T.ArrayType(T.StringType()))
    return run(text)
