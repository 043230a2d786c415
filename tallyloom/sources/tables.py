"""Tables of saved pages: a grid of cells with spans and nesting, records by header, and the ballots of nominal vote pages.

A page is read once, in Python: `cells` gives what stands where, `lines` the rows of its grids, `page_records` its records. A page lies in one row, so that none of them,
nor ballots, shuffles anything; `records` and `ballots` do the same from a relation of cells. A cell takes the first free column of its row, and with its spans it occupies a
rectangle: cells of later rows move to the right of it. Spans end with the group of rows (head, body, foot) that they began in. A table inside a cell is a table of its own,
numbered after the one around it, and its text is not the outer cell's.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator
from html import unescape
from html.parser import HTMLParser

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from tallyloom.functions.text import fold_ro
from tallyloom.session import bounded_batches

CELLS = "table int, parent int, row int, column int, row_span int, col_span int, header boolean, text string, links array<string>"
#: Limits of HTML for spans.
MOST_COLUMNS, MOST_ROWS = 1000, 65534
#: A tag as nearly all are written, without its brackets, and an attribute of it. A page with anything else after a `<`, or with an element whose text is no markup, is the parser's.
_TAG = re.compile(r"""(/?)([a-zA-Z][a-zA-Z0-9]*)((?:\s+[a-zA-Z-]+(?:=(?:"[^"<>]*"|'[^'<>]*'|[^\s"'=<>`/]+))?)*)""", re.ASCII)
_ATTRIBUTE = re.compile(r"""([a-zA-Z-]+)(?:=(?:"([^"]*)"|'([^']*)'|([^\s"']+)))?""", re.ASCII)
_RAW = frozenset("script style textarea title xmp iframe noembed noframes noscript plaintext".split())
#: What a tag is to a grid; any other is nothing to it.
_CELL, _HEAD, _CELL_END, _ROW, _LINK, _BREAK, _BOLD, _BOLD_END, _SILENT, _SILENT_END, _GROUP, _GROUP_HEAD, _TABLE, _TABLE_END = range(1, 15)
_MATTERS = {
    "td": _CELL, "th": _HEAD, "/td": _CELL_END, "/th": _CELL_END, "tr": _ROW, "a": _LINK, "br": _BREAK, "b": _BOLD, "strong": _BOLD, "/b": _BOLD_END, "/strong": _BOLD_END,
    "script": _SILENT, "style": _SILENT, "/script": _SILENT_END, "/style": _SILENT_END, "thead": _GROUP_HEAD, "tbody": _GROUP, "tfoot": _GROUP,
    "/thead": _GROUP, "/tbody": _GROUP, "/tfoot": _GROUP, "table": _TABLE, "/table": _TABLE_END,
}
#: What counts outside tables too.
_ANYWHERE = frozenset((_BOLD, _BOLD_END, _SILENT, _SILENT_END, _TABLE))


def _span(attributes: dict, name: str, most: int) -> int:
    value = (attributes.get(name) or "").strip()
    return min(int(value), most) if value.isdigit() else 1


class _Table:
    __slots__ = ("number", "parent", "row", "column", "taken", "group", "cell", "head")

    def __init__(self, number: int, parent: int | None):
        self.number, self.parent = number, parent
        self.row, self.column = -1, 0
        self.taken: dict[int, int] = {}  # column -> first row that is free again
        self.group: list[dict] = []  # cells of the group of rows that is open
        self.cell: dict | None = None
        self.head = False

    def end_group(self) -> list[dict]:
        """Spans end here; the first row of a table without any header cell is one where all it says is bold."""
        group, after = self.group, self.row + 1
        for c in group:
            if c["row_span"] > 1:
                c["row_span"] = min(c["row_span"], after - c["row"])
        if group and group[0]["row"] == 0 and not any(c["header"] for c in group):
            first = [c for c in group if c["row"] == 0]
            if len(group) > len(first) and all(c["parts"] and not c["plain"] for c in first):
                for c in first:
                    c["header"] = True
        self.group, self.taken, self.cell = [], {}, None
        return group


class _Odd(Exception):
    """Something in a page that only the parser can tell."""


class _Grid(HTMLParser):
    """The events of a page that is not plainly written, and its cells."""

    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.found: list[tuple] = []
        self.done: list[dict] = []

    def close(self):
        super().close()
        self.done = _fold(self.found)

    def handle_starttag(self, tag, attrs):
        self.found.append((_MATTERS.get(tag, 0), dict(attrs), ""))

    def handle_endtag(self, tag):
        self.found.append((_MATTERS.get(f"/{tag}", 0), None, ""))

    def handle_data(self, data):
        self.found.append((0, None, data))


def _attributes(told: str | dict) -> dict:
    """Attributes as the parser gives them, or as they are written."""
    return told if isinstance(told, dict) else {n.lower(): unescape(a or b or c) if a or b or c else None for n, a, b, c in _ATTRIBUTE.findall(told)}


#: Short tags that have been read before, as written between `<` and `>`.
_KNOWN: dict[str, tuple[int, str | dict | None]] = {}


def _tag(head: str) -> tuple[int, str | dict | None]:
    """What a tag is to a grid, and a cell's attributes, or a link's as they are written."""
    m = _TAG.fullmatch(head)
    if m is None or m[2].lower() in _RAW:
        raise _Odd
    what = _MATTERS.get(f"{m[1]}{m[2].lower()}", 0)
    told = what, m[3] if what == _LINK else _attributes(m[3]) if m[3] and what in (_CELL, _HEAD) else None
    if len(head) < 32 and len(_KNOWN) < 4096:
        _KNOWN[head] = told
    return told


def _events(html: str) -> list[tuple]:
    """What a tag is, its attributes and the text behind it, in order: of a plain page straight from its tags, of any other from the parser."""
    first, *pieces = html.split("<")
    found, known = [(0, None, unescape(first))], _KNOWN.get
    try:
        for piece in pieces:
            head, closed, text = piece.partition(">")
            if not closed:
                raise _Odd
            what, at = known(head) or _tag(head)
            found.append((what, at, unescape(text) if "&" in text else text))
    except _Odd:
        parser = _Grid()
        parser.feed(html)
        HTMLParser.close(parser)
        return parser.found
    return found


def _fold(events: list[tuple], links: bool = True) -> list[dict]:
    """The cells of all tables of a page, as their groups of rows end; without links where nobody asks for them."""
    opened: list[_Table] = []
    done: list[dict] = []
    t: _Table | None = None
    n = silent = bold = 0
    for what, at, text in events:
        if t is None and what not in _ANYWHERE:
            continue
        if what == _CELL or what == _HEAD:
            row, column, taken = max(t.row, 0), t.column, t.taken
            t.row = row
            while taken and taken.get(column, 0) > row:
                column += 1
            wide, high = (max(1, _span(at, "colspan", MOST_COLUMNS)), _span(at, "rowspan", MOST_ROWS) or MOST_ROWS) if at else (1, 1)
            t.cell = {"table": t.number, "parent": t.parent, "row": row, "column": column, "row_span": high, "col_span": wide, "header": what == _HEAD or t.head, "plain": False, "parts": [], "links": []}
            t.column = column + wide
            if high > 1:  # a row's own cells move on by themselves
                for c in range(column, t.column):
                    taken[c] = max(taken.get(c, 0), row + high)
            t.group.append(t.cell)
        elif what == _CELL_END:
            t.cell = None
        elif what == _ROW:
            t.cell, t.row, t.column = None, t.row + 1, 0
        elif what == _LINK:
            if links and t.cell is not None and at and (href := _attributes(at).get("href")):
                t.cell["links"].append(href)
        elif what == _BREAK:
            if t.cell is not None:
                t.cell["parts"].append(" ")
        elif what == _BOLD:
            bold += 1
        elif what == _BOLD_END:
            bold = max(0, bold - 1)
        elif what == _SILENT:
            silent += 1
        elif what == _SILENT_END:
            silent = max(0, silent - 1)
        elif what == _GROUP or what == _GROUP_HEAD:
            done += t.end_group()
            t.head = what == _GROUP_HEAD
        elif what == _TABLE:
            t = _Table(n, t.number if t is not None else None)
            opened.append(t)
            n += 1
        elif what == _TABLE_END and t is not None:
            done += t.end_group()
            opened.pop()
            t = opened[-1] if opened else None
        if text and t is not None and (cell := t.cell) is not None and not silent:
            cell["parts"].append(text)
            if not bold and not cell["plain"]:
                cell["plain"] = not text.isspace()
    for t in reversed(opened):
        done += t.end_group()
    return done


def _said(c: dict) -> str:
    return " ".join("".join(c["parts"]).split())


def grid(html: str | None) -> list[dict]:
    """The cells of a page, table by table, each with the place it has on the grid."""
    done = _fold(_events(html or ""))
    for c in done:
        c["text"] = _said(c)
        del c["parts"]
    return sorted(done, key=lambda c: (c["table"], c["row"], c["column"]))


def _each_page(df: DataFrame, keep: list[str], html: str, told: Callable[[str | None], list[tuple]], schema: str) -> DataFrame:
    """keep, and a row of schema for each tuple that is told of a page."""
    bounded_batches(df.sparkSession)
    out = StructType([*df.select(keep).schema, *StructType.fromDDL(schema)])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        types = to_arrow_schema(out)
        for b in batches:
            at, columns = [], [[] for _ in range(len(out) - len(keep))]
            for i, page in enumerate(b.column(len(keep)).to_pylist()):
                rows = told(page)
                if rows:
                    at += [i] * len(rows)
                    for column, values in zip(columns, zip(*rows, strict=True), strict=True):
                        column += values
            kept = [b.column(i).take(pa.array(at, "int64")) for i in range(len(keep))]
            made = [pa.array(c, f.type) for c, f in zip(columns, list(types)[len(keep) :], strict=True)]
            yield pa.RecordBatch.from_arrays([*kept, *made], names=out.names)

    return df.select(*keep, html).mapInArrow(run, out)


def cells(df: DataFrame, key: str = "page_id", html: str = "html") -> DataFrame:
    """key and CELLS of every cell of every table of saved pages; a page without tables has no rows."""
    names = [c.split()[0] for c in CELLS.split(", ")]
    return _each_page(df, [key], html, lambda page: [tuple(c[n] for n in names) for c in grid(page)], CELLS)


def places(df: DataFrame, key: str = "page_id", html: str = "html") -> DataFrame:
    """key, table, row, column and text at every place of the grids of saved pages: `filled` straight from the pages, without what else a cell tells."""

    def told(page: str | None) -> list[tuple]:
        out = []
        for c in _fold(_events(page or ""), links=False):
            table, row, column, text = c["table"], c["row"], c["column"], _said(c)
            if c["row_span"] == 1 and c["col_span"] == 1:
                out.append((table, row, column, text))
            else:
                out += [(table, r, x, text) for r in range(row, row + c["row_span"]) for x in range(column, column + c["col_span"])]
        return out

    return _each_page(df, [key], html, told, "table int, row int, column int, text string")


def _rows(found: list[dict]) -> dict[tuple[int, int], list[dict]]:
    """The cells that cover each row of the grids of a page, by column, by (table, row)."""
    rows: dict[tuple[int, int], list[dict]] = {}
    for c in found:
        for r in range(c["row"], c["row"] + c["row_span"]):
            rows.setdefault((c["table"], r), []).append(c)
    for row in rows.values():
        row.sort(key=lambda c: c["column"])
    return rows


def _texts(row: list[dict]) -> list[str | None]:
    """What stands in each column of a row, of two cells in one place the first."""
    out: list[str | None] = []
    for c in row:
        out += [None] * (c["column"] - len(out))
        out += [c["text"]] * (c["column"] + c["col_span"] - len(out))
    return out


def lines(df: DataFrame, key: str = "page_id", html: str = "html", says: tuple[str, ...] = (), keep: tuple[str, ...] = (), outer: bool = False) -> DataFrame:
    """key, keep, table, row, texts (by column), links and says of every row of the grids of saved pages, spans filled; says is whether some cell of the
    page holds each of the given patterns. With outer a page without tables has one row."""
    wanted = [re.compile(p) for p in says]

    def told(page: str | None) -> list[tuple]:
        found = grid(page)
        text = "\n".join(c["text"] for c in found)
        said = [p.search(text) is not None for p in wanted]
        rows = [(*at, _texts(row), [link for c in row for link in c["links"]], said) for at, row in _rows(found).items()]
        return rows or ([(None, None, [], [], said)] if outer else [])

    return _each_page(df, [key, *keep], html, told, "table int, row int, texts array<string>, links array<string>, says array<boolean>")


def _recorded(page: str | None) -> list[tuple]:
    """table, row and record of a page's rows below headers, as `records` tells them."""
    rows = _rows(grid(page))
    names: dict[tuple[int, int], list[str]] = {}
    for (table, _), row in sorted(rows.items()):
        if all(c["header"] for c in row):
            for at, text in sorted((x, c["text"]) for c in row for x in range(c["column"], c["column"] + c["col_span"])):
                names.setdefault((table, at), []).append(text)
    named = {at: " ".join(dict.fromkeys(texts)) for at, texts in names.items()}
    out = []
    for (table, r), row in rows.items():
        if not all(c["header"] for c in row):
            record: dict[str, str] = {}
            for c in row:
                for x in range(c["column"], c["column"] + c["col_span"]):
                    if (table, x) in named:
                        record.setdefault(named[table, x], c["text"])
            if record:
                out.append((table, r, list(record.items())))
    return out


def page_records(df: DataFrame, key: str = "page_id", html: str = "html") -> DataFrame:
    """`records` straight from saved pages."""
    return _each_page(df, [key], html, _recorded, "table int, row int, record map<string,string>")


def filled(found: DataFrame) -> DataFrame:
    """cells with a row for each place of the grid that a cell covers."""
    down, right = F.sequence(F.col("row"), F.col("row") + F.col("row_span") - 1), F.sequence(F.col("column"), F.col("column") + F.col("col_span") - 1)
    return found.withColumn("row", F.explode(down)).withColumn("column", F.explode(right)).drop("row_span", "col_span")


def records(found: DataFrame, key: str = "page_id") -> DataFrame:
    """key, table, row and record, a map from header to text: the rows of tables with a header, that of a column being its header cells from above."""
    places, at = filled(found), [key, "table", "column"]
    rows = [key, "table", "row"]
    heads = places.groupBy(*rows).agg(F.min("header").alias("head"))
    placed = places.join(heads, rows)
    name = F.concat_ws(" ", F.array_distinct(F.transform(F.sort_array(F.collect_list(F.struct("row", "text"))), lambda x: x["text"])))
    names = placed.where("head").groupBy(*at).agg(name.alias("name"))
    told = placed.where("not head").join(names, at).groupBy(*rows, "name").agg(F.min_by("text", "column").alias("text"))
    return told.groupBy(*rows).agg(F.map_from_entries(F.collect_list(F.struct("name", "text"))).alias("record"))


# How ballots are printed, on folded text.
CHOICES = [("for", r"\bpentru\b|\bda\b"), ("against", r"\bcontra\b|\bnu\b"), ("abstention", r"abtin|\bab\b"), ("present_not_voting", r"nu a votat|nevotat")]
#: Columns of a ballot's name, group and choice by kind of page; the upper house marks one of four columns with an X.
SHAPES = {"deputies": (1, 2, 3), "joint": (1, 3, 4)}
MARKS = {3: "for", 4: "against", 5: "abstention", 6: "present_not_voting"}
TOTALS = {"for": r"Pentru\s*\(DA\)", "against": r"Contra\s*\(NU\)", "abstention": r"Abtineri\s*\(AB\)", "present_not_voting": r"Nu au votat\s*\(-\)"}


def choice(text: Column) -> Column:
    told = F.when(F.trim(text) == "-", "present_not_voting")
    for name, pattern in CHOICES:
        told = told.when(fold_ro(text).rlike(pattern), name)
    return told


def _marked(line: DataFrame) -> Column:
    """The ballots of a row of texts, links and joint: an array of member_id, name, group and choice."""
    cell = lambda n: F.get("texts", F.lit(n))
    profile = F.get(F.filter("links", lambda x: x.rlike(r"structura(2015)?\.mp")), F.lit(0))
    idm, cam = F.regexp_extract(profile, r"[?&]idm=(\d+)", 1), F.regexp_extract(profile, r"[?&]cam=(\d)", 1)
    numbered = cell(0).rlike(r"^\d+\.$") & (idm != "") & (cell(1) != "")
    role = F.lower(cell(2))
    house = F.when(~F.col("joint"), "deputies").when((role == "senator") | (cam == "1"), "senate").when((role == "deputat") | (cam == "2"), "deputies")
    pick = lambda k: F.when(F.col("joint"), cell(SHAPES["joint"][k])).otherwise(cell(SHAPES["deputies"][k]))
    told = lambda member, name, group, said: F.struct(member.alias("member_id"), name.alias("name"), group.alias("group"), said.alias("choice"))
    lower = told(F.concat(F.lit("member-"), house, F.lit("-"), idm), cell(1), F.trim(F.regexp_replace(pick(1), r"(?i)\(afiliat\)", "")), choice(pick(2)))
    senator = F.regexp_extract(F.get(F.filter("links", lambda x: x.contains("ParlamentarID=")), F.lit(0)), r"ParlamentarID=([^&']+)", 1)
    marked = F.coalesce(*[F.when(F.upper(cell(k)) == "X", v) for k, v in MARKS.items()])
    upper = told(F.concat(F.lit("member-senate-"), senator), F.concat_ws(" ", cell(1), cell(0)), cell(2), marked)
    return F.filter(F.array(F.when(numbered, lower), F.when(senator != "", upper)), lambda b: b["member_id"].isNotNull() & b["choice"].isNotNull())


#: What some cell of a joint sitting's page says, each.
JOINT = (r"(?i)\bParlamentar\b", "(?i)Camera Deputat", r"(?i)\bSenat\b")


def ballots(found: DataFrame, key: str = "page_id") -> DataFrame:
    """key, member_id, name, group, choice from the cells of nominal vote pages of either house or both: rows that are numbered, link to a
    profile and have a choice, or, on the upper house's pages, name a member and mark one column. Rows of other tables are no ballots."""
    rows = [key, "table", "row"]
    says = lambda pattern: F.bool_or(F.col("text").rlike(pattern))
    line = filled(found).groupBy(*rows).agg(F.collect_list(F.struct("column", "text")).alias("c"), F.flatten(F.collect_list("links")).alias("links"))
    line = line.withColumn("texts", F.transform(F.sequence(F.lit(0), F.array_max("c.column")), lambda i: F.get(F.filter("c", lambda x: x["column"] == i), F.lit(0))["text"]))
    line = line.join(found.groupBy(key).agg((says(JOINT[0]) & says(JOINT[1]) & says(JOINT[2])).alias("joint")), key)
    return line.select(key, F.inline(_marked(line)))


def page_ballots(df: DataFrame, key: str = "page_id", html: str = "html") -> DataFrame:
    """`ballots` straight from saved pages."""
    line = lines(df, key, html, JOINT).withColumn("joint", F.forall("says", lambda x: x))
    return line.select(key, F.inline(_marked(line)))


def announced(df: DataFrame, key: str = "page_id", html: str = "html") -> DataFrame:
    """key and the totals that a page prints of itself, null where it prints none."""
    return df.select(key, *_totals(html))


def _totals(html: str) -> list[Column]:
    text = F.regexp_replace(F.col(html), "<[^>]*>", " ")
    return [F.regexp_extract(text, rf"(?i){p}:\D*?(\d+)\b", 1).try_cast("long").alias(name) for name, p in TOTALS.items()]


def gaps(found: DataFrame, totals: DataFrame, key: str = "page_id") -> DataFrame:
    """Pages whose ballots do not add up to what they announce: key, choice, read, announced."""
    read = found.groupBy(key, "choice").agg(F.count("*").alias("read"))
    told = totals.unpivot([key], list(TOTALS), "choice", "announced").where("announced is not null")
    both = told.join(read, [key, "choice"], "left").fillna(0, ["read"])
    return both.where("read <> announced").select(key, "choice", "read", "announced")


def page_gaps(df: DataFrame, key: str = "page_id", html: str = "html") -> DataFrame:
    """`gaps` straight from saved pages: the totals of a page go with its rows, and its ballots are counted beside them."""
    line = lines(df.select(key, html, *_totals(html)), key, html, JOINT, tuple(TOTALS), outer=True).withColumn("joint", F.forall("says", lambda x: x))
    count = lambda name: F.sum(F.size(F.filter("b", lambda b: b["choice"] == name))).alias(f"read_{name}")
    page = line.select(key, *TOTALS, _marked(line).alias("b")).groupBy(key, *TOTALS).agg(*map(count, TOTALS))
    each = F.array(*[F.struct(F.lit(name).alias("choice"), F.col(f"read_{name}").alias("read"), F.col(name).alias("announced")) for name in TOTALS])
    return page.select(key, F.inline(each)).where("read <> announced")
