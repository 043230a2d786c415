"""Saved originals: pages kept byte for byte with a manifest (A10), spreadsheets (A07), XML lists (A09), and reports for readers."""

from __future__ import annotations

import io
import re
import xml.etree.ElementTree as ET
import zipfile
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

# What the official vote list of a day has in each row, and its chambers.
DAY_ROW = "VOTID string, TIME_VOT string, DESCRIERE string, CAMERA string, PREZENTI string, NU_AU_VOTAT string, AU_VOTAT_DA string, AU_VOTAT_NU string, AU_VOTAT_AB string"
CHAMBERS = {"0": "joint", "1": "senate", "2": "deputies"}
#: Rows of the longest report.
MOST_LINES = 10_000
_SHEET = "{http://schemas.openxmlformats.org/spreadsheetml/2006/main}"


def keep_pages(pages: DataFrame, path: str) -> None:
    """Append pages (kind, key, url, status, body binary, fetched_at) to an archive: one folder for each kind, bodies byte for byte, with size and digest."""
    bad = ~F.rlike("key", F.lit(r"^[A-Za-z0-9._-]+$"))
    checked = pages.withColumn("key", F.when(bad, F.raise_error(F.concat(F.lit("unsafe key: "), "key"))).otherwise(F.col("key")))
    checked.withColumns({"bytes": F.octet_length("body").cast("long"), "sha256": F.sha2("body", 256)}).write.mode("append").partitionBy("kind").parquet(path)


def kept_pages(spark: SparkSession, path: str, kind: str | None = None) -> DataFrame:
    """The latest body of each kind and key; a kind reads its own folder only."""
    rows = spark.read.parquet(path)
    if kind is not None:
        rows = rows.where(F.col("kind") == kind)
    told = [c for c in rows.columns if c not in ("kind", "key")]
    return rows.groupBy("kind", "key").agg(F.max_by(F.struct(*told), F.struct("fetched_at", "sha256")).alias("p")).select("kind", "key", "p.*")


def official_text(body: Column, content_type: Column | None = None) -> Column:
    """Bytes as text: UTF-8 where they are that, else the encoding that the XML head or the content type declares."""
    head = F.decode(F.substring(body, 1, 200), "ISO-8859-1")
    declared = F.nullif(F.lower(F.regexp_extract(head, r"(?i)encoding\s*=\s*[\"']([A-Za-z0-9._-]+)[\"']", 1)), F.lit(""))
    if content_type is not None:
        declared = F.coalesce(declared, F.nullif(F.lower(F.regexp_extract(content_type, r"(?i)charset\s*=\s*([A-Za-z0-9._-]+)", 1)), F.lit("")))
    return _decoded(body, F.coalesce(declared, F.lit("utf-8")))


@F.pandas_udf(T.StringType())
def _decoded(bodies: pd.Series, declared: pd.Series) -> pd.Series:
    def one(data, label):
        if data is None:
            return None
        try:
            return bytes(data).decode("utf-8")
        except UnicodeDecodeError:
            pass
        try:
            return bytes(data).decode(label, errors="replace")
        except LookupError:
            return bytes(data).decode("utf-8", errors="replace")

    return pd.Series([one(d, e) for d, e in zip(bodies, declared, strict=True)])


def sheet_rows(data: bytes) -> list[list[str]]:
    """The cells of the first sheet of a workbook; empty cells are empty strings, whole numbers lose their decimal point."""
    with zipfile.ZipFile(io.BytesIO(data)) as z:
        names = z.namelist()
        shared = [] if "xl/sharedStrings.xml" not in names else ["".join(t.text or "" for t in s.iter(f"{_SHEET}t")) for s in ET.fromstring(z.read("xl/sharedStrings.xml")).iter(f"{_SHEET}si")]
        first = min((n for n in names if re.fullmatch(r"xl/worksheets/sheet\d+\.xml", n)), key=lambda n: int(re.sub(r"\D", "", n)))
        root = ET.fromstring(z.read(first))
    out = []
    for row in root.iter(f"{_SHEET}row"):
        cells: list[str] = []
        for c in row.iter(f"{_SHEET}c"):
            letters = re.match(r"[A-Z]+", c.get("r", "")) or re.match(r"[A-Z]+", "A")
            at = 0
            for letter in letters[0]:
                at = at * 26 + ord(letter) - 64
            cells += [""] * (at - 1 - len(cells) if c.get("r") else 0)
            value = c.find(f"{_SHEET}v")
            told = "" if value is None else value.text or ""
            if c.get("t") == "s":
                told = shared[int(told)]
            elif c.get("t") == "inlineStr":
                told = "".join(t.text or "" for t in c.iter(f"{_SHEET}t"))
            elif re.fullmatch(r"-?\d+\.0+", told):
                told = told.split(".")[0]
            cells.append(told)
        out.append(cells)
    return out


def workbooks(files: DataFrame, key: str = "path", content: str = "content") -> DataFrame:
    """file, row, cells of the first sheets of workbooks (binaryFile rows); each is read whole, files spread over tasks."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for name, data in zip(b[key], b[content], strict=True):
                rows = sheet_rows(bytes(data))
                yield pd.DataFrame({"file": name, "row": range(len(rows)), "cells": rows})

    return files.select(key, content).mapInPandas(run, "file string, row int, cells array<string>")


def day_votes(lists: DataFrame, key: str, xml: str) -> DataFrame:
    """The votes of official day lists (ROWSET of ROW): key, id, held_on, time, chamber, description, the five counts, test and consistent.

    An empty list is a day without votes. A row whose id, time or counts are not what they should be keeps nulls there, so that it can be reported.
    """
    blank = F.btrim(F.col(xml)) == ""
    rows = lists.where(~blank).select(key, F.explode(F.from_xml(F.col(xml), f"ROW array<struct<{DAY_ROW.replace(' string', ':string')}>>")["ROW"]).alias("r"))
    when = r"^(\d{2})\.(\d{2})\.(\d{4})\s+(\d{2}:\d{2})"
    part = lambda i: F.nullif(F.regexp_extract("r.TIME_VOT", when, i), F.lit(""))
    number = lambda c: F.when(F.rlike(F.btrim(f"r.{c}"), F.lit(r"^\d+$")), F.btrim(f"r.{c}").cast("long"))
    chamber = F.create_map(*[F.lit(x) for pair in CHAMBERS.items() for x in pair])[F.btrim("r.CAMERA")]
    out = rows.select(
        key, number("VOTID").alias("id"), F.concat_ws("-", part(3), part(2), part(1)).try_cast("date").alias("held_on"), part(4).alias("time"),
        F.coalesce(chamber, F.lit("unknown")).alias("chamber"), F.btrim(F.coalesce("r.DESCRIERE", F.lit(""))).alias("description"),
        number("PREZENTI").alias("present"), number("AU_VOTAT_DA").alias("for"), number("AU_VOTAT_NU").alias("against"), number("AU_VOTAT_AB").alias("abstained"), number("NU_AU_VOTAT").alias("not_voting"),
    )
    added = F.col("for") + F.col("against") + F.col("abstained") + F.col("not_voting")
    return out.withColumns({"test": F.rlike("description", F.lit(r"(?i)^vot\s+test\b")), "consistent": F.col("present") == added})


def acts(answers: DataFrame, key: str, xml: str) -> DataFrame:
    """The acts in a portal's answer: key, type, issuer, title, link, text."""
    block = F.explode(F.regexp_extract_all(xml, F.lit(r"(?s)<a:Legi>(.*?)</a:Legi>"), F.lit(1)))
    rows = answers.select(key, block.alias("b"))

    def tag(name: str) -> Column:
        out = F.regexp_extract("b", f"<a:{name}>([^<]*)</a:{name}>", 1)
        for ref, c in (("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&apos;", "'"), ("&amp;", "&")):
            out = F.replace(out, F.lit(ref), F.lit(c))
        return out

    tidy = lambda c: F.btrim(F.regexp_replace(c, r"\s+", " "))
    return rows.select(key, tag("TipAct").alias("type"), tag("Emitent").alias("issuer"), tidy(tag("Titlu")).alias("title"), tag("LinkHtml").alias("link"), tidy(tag("Text")).alias("text"))


def markdown(df: DataFrame, headings: dict[str, str], order: list[Column | str]) -> DataFrame:
    """A table as the lines of a Markdown table (at, line), in a total order; numbers are set right. A report is for readers: one of more than
    `MOST_LINES` rows is an error, and no more than that are ever in one place."""
    right = {c for c, t in df.dtypes if t in ("int", "bigint", "double", "float") or t.startswith("decimal")}
    head = "| " + " | ".join(headings.values()) + " |"
    rule = "| " + " | ".join("---:" if c in right else "---" for c in headings) + " |"
    cells = [F.coalesce(F.replace(F.col(c).cast("string"), F.lit("|"), F.lit("\\|")), F.lit("")) for c in headings]
    line = F.concat(F.lit("| "), F.concat_ws(" | ", *cells), F.lit(" |"))
    keyed = df.select(F.struct(*[o if isinstance(o, Column) else F.col(o) for o in order]).alias("__o"), line.alias("line"))
    rows = keyed.limit(MOST_LINES + 1).agg(F.sort_array(F.collect_list(F.struct("__o", "line"))).alias("all"))
    rows = rows.withColumn("all", F.when(F.size("all") > MOST_LINES, F.raise_error(F.lit(f"a report of more than {MOST_LINES} rows is not one for readers"))).otherwise(F.col("all"))).select(F.concat(F.array(F.lit(head), F.lit(rule)), F.transform("all", lambda x: x["line"])).alias("all"))
    return rows.select(F.posexplode("all").alias("at", "line"))


def write_report(df: DataFrame, path: str, headings: dict[str, str], order: list[Column | str]) -> None:
    """A report as JSON lines under `json` and as one Markdown file under `markdown`."""
    df.write.mode("overwrite").json(f"{path}/json")
    markdown(df, headings, order).orderBy("at").select("line").coalesce(1).write.mode("overwrite").text(f"{path}/markdown")
