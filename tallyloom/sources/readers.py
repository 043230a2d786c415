"""Sources: optional tables, delimited files of unknown kind, saved pages, XML lists; and sinks that replace a folder."""

from __future__ import annotations

import csv
import io
import re
import uuid
from collections.abc import Iterator
from html import unescape
from html.parser import HTMLParser

import pandas as pd
from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T


def optional_table(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    """A table, or no rows of its schema while it does not exist yet."""
    try:
        return spark.read.schema(schema).parquet(path)
    except AnalysisException as e:
        if "PATH_NOT_FOUND" not in str(e):
            raise
        return spark.createDataFrame([], schema)


def decode(data: bytes) -> str:
    """UTF-16 or UTF-8 by their marks, else UTF-8, else windows-1250."""
    if data[:2] in (b"\xff\xfe", b"\xfe\xff"):
        return data.decode("utf-16")
    try:
        return data.decode("utf-8-sig")
    except UnicodeDecodeError:
        return data.decode("cp1250", errors="replace")


def parse_delimited(text: str) -> list[list[str]]:
    """Rows of cells; `;` or `,` by the first line (a tie is `;`), quotes doubled inside quotes, blank rows dropped."""
    first = text.split("\n", 1)[0]
    rows = csv.reader(io.StringIO(text, newline=""), delimiter=";" if first.count(";") >= first.count(",") else ",")
    return [[c.strip() for c in r] for r in rows if any(c.strip() for c in r)]


def delimited(spark: SparkSession, path: str) -> DataFrame:
    """file, row, cells of delimited files in any of the encodings; each file is read whole, files spread over tasks."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for name, data in zip(b["path"], b["content"], strict=True):
                rows = parse_delimited(decode(bytes(data)))
                yield pd.DataFrame({"file": name, "row": range(len(rows)), "cells": rows})

    files = spark.read.format("binaryFile").load(path).select("path", "content")
    return files.mapInPandas(run, "file string, row int, cells array<string>")


def unpivot_lists(rows: DataFrame, keys: list[str], after: str) -> DataFrame:
    """Wide results to long: the columns that follow the last statistics column are lists; empty and zero cells go."""
    columns = rows.columns
    lists = [c for c in columns[columns.index(after) + 1 :] if c not in keys]
    long = rows.unpivot(keys, lists, "list", "votes").withColumn("votes", F.col("votes").try_cast("long"))
    return long.where("votes > 0")


class _Outline(HTMLParser):
    """Text of the table cells, links and title of a page; scripts and styles are skipped."""

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.rows: list[list[str]] = []
        self.links: list[str] = []
        self.title = ""
        self.stack: list[str] = []

    def handle_starttag(self, tag, attrs):
        if tag == "tr":
            self.rows.append([])
        elif tag in ("td", "th") and self.rows:
            self.rows[-1].append("")
        elif tag == "a":
            self.links += [v for k, v in attrs if k == "href" and v]
        if tag in ("script", "style", "title", "td", "th"):
            self.stack.append(tag)

    def handle_endtag(self, tag):
        if tag in self.stack:
            del self.stack[len(self.stack) - 1 - self.stack[::-1].index(tag) :]

    def handle_data(self, data):
        inside = self.stack[-1] if self.stack else ""
        if inside == "title":
            self.title += data
        elif inside in ("td", "th") and self.rows and self.rows[-1]:
            self.rows[-1][-1] += data


#: A whole character reference: where a text was cut inside one, what is left of it stays as it stands.
_REFERENCE = re.compile(r"&(?:[a-zA-Z][a-zA-Z0-9]*|#[0-9]+|#[xX][0-9a-fA-F]+);")


def _address(text: str) -> str:
    return _REFERENCE.sub(lambda m: unescape(m[0]), text)


def _written_out(text: str) -> str:
    return " ".join(_address(text).split())


def _outline(html: str | None) -> _Outline:
    p = _Outline()
    p.feed((html or "").replace("&", "&amp;"))  # references come through as they are printed
    p.close()
    return p


def outline(html: str | None) -> tuple[str, list[str], list[list[str]]]:
    p = _outline(html)
    return _written_out(p.title), [_address(x) for x in p.links], [[_written_out(c) for c in r] for r in p.rows if r]


def pages(df: DataFrame, key: str = "page_id", html: str = "html") -> DataFrame:
    """key, title, links, rows of saved pages, and printed_title, in which no character reference is written out."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            read = [_outline(h) for h in b[html]]
            cells = [[[_written_out(c) for c in r] for r in p.rows if r] for p in read]
            links = [[_address(x) for x in p.links] for p in read]
            yield pd.DataFrame({key: b[key], "title": [_written_out(p.title) for p in read], "links": links, "rows": cells, "printed_title": [" ".join(p.title.split()) for p in read]})

    return df.select(key, html).mapInPandas(run, f"{key} long, title string, links array<string>, rows array<array<string>>, printed_title string")


def xml_records(df: DataFrame, column: str, schema: str) -> DataFrame:
    """Records of XML texts by a declared schema."""
    return df.withColumn("record", F.from_xml(F.col(column), schema))


def replace_folder(df: DataFrame, path: str) -> None:
    """Full rebuild: write beside the old folder, then swap names, so that readers never see half of it."""
    spark = df.sparkSession
    staged, old = f"{path}.new-{uuid.uuid4().hex}", f"{path}.old-{uuid.uuid4().hex}"
    df.write.parquet(staged)
    P = spark._jvm.org.apache.hadoop.fs.Path
    fs = P(path).getFileSystem(spark._jsc.hadoopConfiguration())
    had = fs.exists(P(path))
    if had:
        fs.rename(P(path), P(old))
    fs.rename(P(staged), P(path))
    if had:
        fs.delete(P(old), True)


def replace_partitions(df: DataFrame, path: str, by: str) -> None:
    """Only the partitions that df holds are replaced."""
    df.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(by).parquet(path)
