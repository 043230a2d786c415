"""Files of results as a data source: delimited texts of any encoding and all sheets of workbooks, streamed row by row.

    spark.dataSource.register(ResultFiles)
    spark.read.format("result_files").load(folder)        # file, sheet, row, cells

A partition is one text or one sheet. Rows go out in Arrow batches as they are read: a sheet is never held as a whole, neither unpacked nor as a tree, and
the strings that a workbook shares are one block of bytes with offsets. Files are reached through Arrow's file systems (local, HDFS, S3, GCS).

Edge cases: an empty folder or file has no rows; a text without a mark is UTF-8 where it is all that, else windows-1250; blank rows of a text go, and
those of a sheet that are not written keep their numbers; a missing cell is an empty string; whole numbers lose their decimal point; dates stay serial numbers.
"""

from __future__ import annotations

import codecs
import csv
import io
import re
import xml.etree.ElementTree as ET
import zipfile
from array import array
from collections.abc import Iterator
from dataclasses import dataclass
from urllib.parse import quote

import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

SCHEMA = "file string, sheet string, row int, cells array<string>"
_ARROW = pa.schema([("file", pa.string()), ("sheet", pa.string()), ("row", pa.int32()), ("cells", pa.list_(pa.string()))])
BATCH = 2048
_MAIN = "{http://schemas.openxmlformats.org/spreadsheetml/2006/main}"
_LINK = "{http://schemas.openxmlformats.org/officeDocument/2006/relationships}id"


class Strings:
    """Many short strings in two arrays."""

    def __init__(self) -> None:
        self.text, self.ends = bytearray(), array("Q", [0])

    def append(self, s: str) -> None:
        self.text += s.encode()
        self.ends.append(len(self.text))

    def __getitem__(self, i: int) -> str:
        return self.text[self.ends[i] : self.ends[i + 1]].decode()


def _elements(data: io.IOBase, tag: str) -> Iterator[ET.Element]:
    """Elements of one tag as they end; what has been seen is let go of."""
    path: list[ET.Element] = []
    for event, e in ET.iterparse(data, ("start", "end")):
        if event == "start":
            path.append(e)
            continue
        path.pop()
        if e.tag == tag:
            yield e
            if path:
                path[-1].clear()


def shared_strings(z: zipfile.ZipFile) -> Strings:
    out = Strings()
    if "xl/sharedStrings.xml" in z.namelist():
        with z.open("xl/sharedStrings.xml") as data:
            for e in _elements(data, f"{_MAIN}si"):
                out.append("".join(t.text or "" for t in e.iter(f"{_MAIN}t")))
    return out


def sheets(z: zipfile.ZipFile) -> list[tuple[str, str]]:
    """(name, member) of the sheets, in the workbook's order; without a workbook part, by the numbers of the members."""
    members = z.namelist()
    if "xl/workbook.xml" in members and "xl/_rels/workbook.xml.rels" in members:
        target = {r.get("Id"): r.get("Target", "") for r in ET.fromstring(z.read("xl/_rels/workbook.xml.rels"))}
        told = [(s.get("name"), target.get(s.get(_LINK), "")) for s in ET.fromstring(z.read("xl/workbook.xml")).iter(f"{_MAIN}sheet")]
        found = [(name, t.lstrip("/") if t.startswith("/") else f"xl/{t}") for name, t in told]
        return [(name, m) for name, m in found if m in members and "worksheets/" in m]
    numbered = [m for m in members if re.fullmatch(r"xl/worksheets/sheet\d+\.xml", m)]
    return [(m.rsplit("/", 1)[1].removesuffix(".xml"), m) for m in sorted(numbered, key=lambda m: int(re.sub(r"\D", "", m)))]


def column(reference: str) -> int:
    """The number of a cell's column, from its letters."""
    at = 0
    for letter in reference:
        if not letter.isalpha():
            break
        at = at * 26 + ord(letter.upper()) - 64
    return at - 1


def sheet_rows(z: zipfile.ZipFile, member: str, strings: Strings) -> Iterator[tuple[int, list[str]]]:
    """(row, cells) of a sheet."""
    n = -1
    with z.open(member) as data:
        for row in _elements(data, f"{_MAIN}row"):
            n = int(row.get("r")) - 1 if row.get("r") else n + 1
            cells: list[str] = []
            for c in row.iter(f"{_MAIN}c"):
                if c.get("r"):
                    cells += [""] * (column(c.get("r")) - len(cells))
                kind, v = c.get("t"), c.find(f"{_MAIN}v")
                told = "" if v is None else v.text or ""
                if kind == "s":
                    told = strings[int(told)] if told else ""
                elif kind == "inlineStr":
                    told = "".join(t.text or "" for t in c.iter(f"{_MAIN}t"))
                elif re.fullmatch(r"-?\d+\.0+", told):
                    told = told.split(".")[0]
                cells.append(told)
            yield n, cells


def encoding(data: io.IOBase) -> str:
    """Of a text: by its mark, else UTF-8 where all of it is that, else windows-1250. The text is read in pieces."""
    head = data.read(3)
    data.seek(0)
    if head[:2] in (b"\xff\xfe", b"\xfe\xff"):
        return "utf-16"
    decoder = codecs.getincrementaldecoder("utf-8")()
    try:
        while piece := data.read(1 << 20):
            decoder.decode(piece)
        decoder.decode(b"", final=True)
    except UnicodeDecodeError:
        return "cp1250"
    finally:
        data.seek(0)
    return "utf-8-sig"


def text_rows(data: io.IOBase) -> Iterator[tuple[int, list[str]]]:
    """(row, cells) of a delimited text: `;` or `,` by the first line (a tie is `;`), quotes doubled inside quotes, blank rows dropped."""
    kind = encoding(data)
    lines = io.TextIOWrapper(data, kind, errors="replace" if kind == "cp1250" else "strict", newline="")
    first = lines.readline()
    csv.field_size_limit(1 << 30)

    def all_lines() -> Iterator[str]:
        yield first
        yield from lines

    rows = csv.reader(all_lines(), delimiter=";" if first.count(";") >= first.count(",") else ",")
    tidy = ([c.strip() for c in r] for r in rows)
    yield from enumerate(r for r in tidy if any(r))


@dataclass
class Part(InputPartition):
    path: str
    sheet: str | None = None
    member: str | None = None


def located(path: str) -> tuple[pafs.FileSystem, str]:
    """The file system of a path or URI, and the path on it."""
    if path.startswith("file:"):
        return pafs.LocalFileSystem(), "/" + path.removeprefix("file:").lstrip("/")
    return pafs.FileSystem.from_uri(quote(path, safe=":/%@?=&")) if "://" in path else (pafs.LocalFileSystem(), path)


class ResultReader(DataSourceReader):
    def __init__(self, folder: str):
        self.folder = folder

    def partitions(self) -> list[Part]:
        fs, at = located(self.folder)
        info = fs.get_file_info(at)
        files = [info] if info.is_file else [f for f in fs.get_file_info(pafs.FileSelector(at, recursive=True)) if f.is_file]
        out: list[Part] = []
        for f in sorted(files, key=lambda f: f.path):
            name = f.path.rsplit("/", 1)[-1].lower()
            if name.startswith((".", "_")):
                continue
            if name.endswith((".xlsx", ".xlsm")):
                with fs.open_input_file(f.path) as data, zipfile.ZipFile(data) as z:
                    out += [Part(f.path, *s) for s in sheets(z)]
            elif name.endswith((".csv", ".txt", ".tsv")):
                out.append(Part(f.path))
        return out

    def read(self, part: Part) -> Iterator[pa.RecordBatch]:
        if part is None:  # a folder without files
            return
        fs, _ = located(self.folder)
        with fs.open_input_file(part.path) as data:
            if part.member is None:
                yield from _batches(part, text_rows(data))
            else:
                with zipfile.ZipFile(data) as z:
                    yield from _batches(part, sheet_rows(z, part.member, shared_strings(z)))


def _batches(part: Part, rows: Iterator[tuple[int, list[str]]]) -> Iterator[pa.RecordBatch]:
    numbers, cells = [], []
    name = part.path.rsplit("/", 1)[-1]

    def out() -> pa.RecordBatch:
        n = len(numbers)
        return pa.RecordBatch.from_arrays([pa.array([name] * n, pa.string()), pa.array([part.sheet] * n, pa.string()), pa.array(numbers, pa.int32()), pa.array(cells, pa.list_(pa.string()))], schema=_ARROW)

    for number, row in rows:
        numbers.append(number)
        cells.append(row)
        if len(numbers) == BATCH:
            yield out()
            numbers, cells = [], []
    if numbers:
        yield out()


class ResultFiles(DataSource):
    """The format `result_files`; its path is a folder or a file."""

    @classmethod
    def name(cls) -> str:
        return "result_files"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> ResultReader:
        return ResultReader(self.options["path"])
