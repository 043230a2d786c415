"""Bill texts as table functions of SQL: `bill_text(text, kind[, heading])`, whose columns go by the kind that is asked for.

    register(spark)
    select d.id, s.* from documents d, lateral bill_text(d.text, 'sections', '^The ') s
    select b.id, p.* from bills b, lateral bill_text(b.text, 'parts') p

What a section and a part are stands at operators.documents; both ways give the same rows. A null text is an empty one. A text is one row's work, and rows
go out one by one.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

from pyspark.sql import SparkSession
from pyspark.sql import types as T
from pyspark.sql.functions import udtf
from pyspark.sql.udtf import AnalyzeArgument, AnalyzeResult

from tallyloom.functions.text import RO_FROM, RO_TO
from tallyloom.operators.documents import HEADING, PART_HEADINGS

_KINDS = {"long": T.LongType(), "int": T.IntegerType(), "string": T.StringType()}
#: As types, since there is no session where a call is analysed.
SCHEMAS = {
    kind: T.StructType([T.StructField(name, _KINDS[t]) for name, t in (c.split() for c in columns.split(", "))])
    for kind, columns in {
        "sections": "section long, heading string, body string",
        "parts": "place int, id string, heading string, part string, number string, body string, starts int, ends int",
    }.items()
}
_FOLD = str.maketrans(RO_FROM, RO_TO)
_PARTS = [(name, re.compile(rf"(?:{pattern})", re.I | re.A)) for name, pattern, _ in PART_HEADINGS]


def slug(text: str) -> str:
    return re.sub("[^a-z0-9]+", "-", text.translate(_FOLD).lower()).strip("-")


def sections(text: str, heading: str = HEADING) -> Iterator[tuple]:
    """(section, heading, body): what comes before the first heading is section 0."""
    opens, n, title, lines = re.compile(heading, re.A), 0, "", []
    for line in text.split("\n"):
        m = opens.search(line)
        if m:
            if lines:
                yield n, title, "\n".join(lines)
            n, title, lines = n + 1, m[0].strip(" ").lower(), []
        lines.append(line)
    yield n, title, "\n".join(lines)


def _opened(line: str) -> tuple[str, str | None] | None:
    for name, pattern in _PARTS:
        if m := pattern.fullmatch(line):
            return name, next((g for g in m.groups() if g), None)
    return None


def parts(text: str) -> Iterator[tuple]:
    """(place, id, heading, part, number, body, starts, ends) of a bill."""
    whole, at, place, held = text.replace("\r", "\n"), 0, 0, None

    def done(ends: int) -> tuple:
        starts, heading, kind, number, lines = held
        return place, f"{slug(heading) or 'document'}-{place}", heading, kind, number, "\n".join(lines), starts, ends

    for raw in whole.split("\n"):
        line = raw.strip(" \t\n\x0b\f\r")
        if line:
            new = _opened(line)
            if new or held is None:
                if held:
                    yield done(at)
                place += 1
                held = (at, line if new else "Document", *(new or ("preamble", None)), [])
            held[-1].append(line)
        at += len(raw) + 1
    if held:
        yield done(len(whole))


@udtf
class BillText:
    @staticmethod
    def analyze(text: AnalyzeArgument, kind: AnalyzeArgument, heading: AnalyzeArgument | None = None) -> AnalyzeResult:
        """The columns, from the kind; it and a heading's pattern must be known before any row is."""
        if not isinstance(text.dataType, (T.StringType, T.NullType)):
            raise ValueError(f"bill_text reads a string, not {text.dataType.simpleString()}")
        if not kind.isConstantExpression or kind.value not in SCHEMAS:
            raise ValueError(f"the kind of bill_text is one of {', '.join(SCHEMAS)}")
        if heading is not None and (kind.value != "sections" or not heading.isConstantExpression):
            raise ValueError("a heading is a constant pattern, of sections")
        return AnalyzeResult(schema=SCHEMAS[kind.value])

    def eval(self, text: str, kind: str, heading: str = HEADING) -> Iterator[tuple]:
        yield from sections(text or "", heading) if kind == "sections" else parts(text or "")


def register(spark: SparkSession) -> None:
    spark.udtf.register("bill_text", BillText)
