"""Table grids against a brute-force grid, and ballots of hand-written pages of both houses."""

import random

from tallyloom.sources import tables


def drawn(rng, depth=0):
    """A random table as HTML, and its grid by brute force: (row, column) of the first cell to claim a place, by what it says."""
    rows, taken, out, say = rng.randint(1, 5), {}, [], 0
    for r in range(rows):
        parts, c = [], 0
        for _ in range(rng.randint(1, 4)):
            while (r, c) in taken:
                c += 1
            high, wide = rng.choice([1, 1, 2, 3]), rng.choice([1, 1, 2])
            say += 1
            name = f"t{depth}c{say}"
            for y in range(r, min(rows, r + high)):
                for x in range(c, c + wide):
                    taken.setdefault((y, x), name)
            parts.append(f"<{'th' if r == 0 else 'td'} rowspan={high} colspan='{wide}'> {name} " + ("" if rng.random() < 0.5 else "</td>"))
            c += wide
        out.append("<tr>" + "".join(parts) + ("</tr>" if rng.random() < 0.5 else ""))
    return "<TABLE>" + "".join(out) + "</TABLE>", taken


def test_grids_match_brute_force(spark):
    rng, pages, want = random.Random(9), [], {}
    for i in range(60):
        a, grid_a = drawn(rng)
        b, grid_b = drawn(rng, 1)
        c, grid_c = drawn(rng, 2)
        pages.append((i, f"<p>x</p>{a}<script>'<td>'</script><table><tr><td>out{b}er<td>last</table>{c}"))
        want |= {(i, 0, *k): v for k, v in grid_a.items()} | {(i, 1, 0, 0): "outer", (i, 1, 0, 1): "last"} | {(i, 2, *k): v for k, v in grid_b.items()} | {(i, 3, *k): v for k, v in grid_c.items()}
    pages += [(100, None), (101, ""), (102, "<p>no table</p>"), (103, "<table><tr><td>open")]
    want[103, 0, 0, 0] = "open"
    got = {}
    for r in tables.filled(tables.cells(spark.createDataFrame(pages, "page_id long, html string"))).collect():
        got.setdefault((r.page_id, r.table, r.row, r.column), set()).add(r.text)
    assert set(got) == set(want) and all(v in got[k] for k, v in want.items())
    nested = [c for c in tables.grid(pages[0][1]) if c["table"] == 2]
    assert nested and all(c["parent"] == 1 for c in nested)


def test_spans_end_with_their_group_and_bold_rows_are_headers():
    page = "<table><thead><tr><th rowspan=9>a<th>b<tbody><tr><td rowspan=0>1<td>2<tr><td>3</table><table><tr><td><b>x</b><td><strong>y</strong><tr><td>1<td>2</table>"
    found = [(c["table"], c["row"], c["column"], c["row_span"], c["header"], c["text"]) for c in tables.grid(page)]
    assert found == [(0, 0, 0, 1, True, "a"), (0, 0, 1, 1, True, "b"), (0, 1, 0, 2, False, "1"), (0, 1, 1, 1, False, "2"), (0, 2, 1, 1, False, "3"), (1, 0, 0, 1, True, "x"), (1, 0, 1, 1, True, "y"), (1, 1, 0, 1, False, "1"), (1, 1, 1, 1, False, "2")]


JOINT = """<table><tr><td>Nr.<td>Nume<td>Parlamentar<td>Grup<td>Vot</tr><tr><td>x<td>Camera Deputatilor<td>Senat<td>3<td>4
<tr><td>1.<td><a href="structura2015.mp?idm=7&cam=1">VARGA Ilie</a><td>Senator<td>AAA (afiliat)<td>DA
<tr><td>2.<td><a href="structura2015.mp?idm=8&cam=2">MOLDOVAN Ana</a><td>Deputat<td>BBB<td>-
<tr><td>3.<td>NO LINK<td>Deputat<td>BBB<td>DA<tr><td>4.<td><a href="structura2015.mp?idm=9&cam=2">DOBRE Emil</a><td>Deputat<td>BBB<td>?</table>"""
UPPER = """<table><tbody><tr><td>CCC<td>1<td>0<td>0<td>0</table><table><thead><tr><th>Nume<th>Prenume<th>Grup<th>P<th>C<th>A<th>N<tbody>
<tr><td><a href="FisaSenator.aspx?ParlamentarID=ab-1">LUNGU</a><td>Ion<td>CCC<td>X<td><td><td><tr><td><a href="FisaSenator.aspx?ParlamentarID=cd-2">TOMA</a><td>Eva<td>CCC<td><td><td>x<td></table>"""


def test_ballots_of_both_houses(spark):
    df = spark.createDataFrame([(1, JOINT), (2, UPPER), (3, "<table><tr><td>1.<td>a<td>b<td>DA</table>"), (4, None)], "page_id long, html string")
    got = sorted(tuple(r) for r in tables.ballots(tables.cells(df)).select("page_id", "member_id", "name", "group", "choice").collect())
    assert got == [
        (1, "member-deputies-8", "MOLDOVAN Ana", "BBB", "present_not_voting"),
        (1, "member-senate-7", "VARGA Ilie", "AAA", "for"),
        (2, "member-senate-ab-1", "Ion LUNGU", "CCC", "for"),
        (2, "member-senate-cd-2", "Eva TOMA", "CCC", "abstention"),
    ]


def test_plain_pages_read_as_the_parser_reads_them():
    """tags straight from the text, with the parser's events."""
    bits = ["<table>", "</table>", "<tr>", "</tr>", "<td>", "<td rowspan=2 colspan='2'>", '<TH rowspan="2">', "</td>", "<b>", "</b>", "<br>", '<a href="x?a=1&amp;b=2&copy=3">', "<a href=y>", "<a href>", "</a>", "<tbody>", "</thead>", "<thead>", "<nav class='q' hidden>"]
    bits += ["a &amp; b", "&lt;c&gt;", "&am", "\n", "  d", "ț &nbsp;", "1 > 0", "'\"", "<br/>", "<!-- <td> -->", "<script>'<td>'</script>", "< x", "<td", "</ td>", "<a title='>'>", "<title>&lt;</title>", "<td colspan=x>"]
    rng = random.Random(4)
    for _ in range(3000):
        page = "".join(rng.choice(bits[: rng.choice([26, 26, len(bits)])]) for _ in range(rng.randint(1, 25)))
        parser = tables._Grid()
        parser.feed(page)
        parser.close()
        for c in parser.done:
            c["text"] = " ".join("".join(c.pop("parts")).split())
        assert tables.grid(page) == sorted(parser.done, key=lambda c: (c["table"], c["row"], c["column"])), page


def test_pages_in_one_pass_tell_what_their_cells_tell(spark):
    """each page is parsed once, nothing is joined with itself."""
    rng = random.Random(6)
    totals = "<p>Pentru (DA): 1 Contra (NU): 2 Nu au votat (-): 0</p>"
    pages = [(1, JOINT + totals), (2, UPPER), (3, totals), (4, None), (5, "<table><tr><th>x<th>x<th colspan=2>y<tr><td>1<td>2<td>3<td>4<tr><td rowspan=3>5<tr></table>")]
    pages += [(10 + i, drawn(rng)[0] + totals) for i in range(30)]
    df = spark.createDataFrame(pages, "page_id long, html string")
    rows = lambda d, *c: sorted(map(repr, (r.asDict(True) for r in d.select(*c).collect())))
    ballot = ["page_id", "member_id", "name", "group", "choice"]
    found = tables.cells(df)
    assert rows(tables.page_ballots(df), *ballot) == rows(tables.ballots(found), *ballot)
    record = ["page_id", "table", "row", "array_sort(map_entries(record)) as record"]
    assert rows(tables.page_records(df).selectExpr(*record), "*") == rows(tables.records(found).selectExpr(*record), "*")
    gap = ["page_id", "choice", "read", "announced"]
    assert rows(tables.page_gaps(df), *gap) == rows(tables.gaps(tables.ballots(found), tables.announced(df)), *gap)
    assert "Join" not in tables.page_ballots(df)._jdf.queryExecution().executedPlan().toString()


def test_places_of_pages_equal_filled_cells(spark):
    """Straight from the pages: odd and plain ones, spans that overlap, links that nobody asks for, groups, nesting."""
    rng = random.Random(11)
    bits = "<tr> <td> </td> <th> </TH> <td\trowspan=\"2\"> <td\tcolspan=3> <thead> </thead> <tbody> <table> </table> <b> </b> <br> <br/> <a\thref='x?a&amp;b'> </a> x &lt; <p> <script> </script> <title> </title>".split(" ")
    pages = [(i, "<table>" + "".join(rng.choice(bits).replace("\t", " ") for _ in range(rng.randint(1, 30)))) for i in range(400)]
    pages += [(900, None), (901, ""), (902, "no < table")]
    df = spark.createDataFrame(pages, "page_id long, html string")
    want = tables.filled(tables.cells(df)).select("page_id", "table", "row", "column", "text")
    got = tables.places(df)
    assert got.columns == want.columns and sorted(got.collect()) == sorted(want.collect())
    assert got.count() > 500


def test_plain_pages_are_read_without_the_parser():
    html = "<table><tr><td>a<td><a href='q?x&amp;y'>b</a></table>"
    assert [(what, text) for what, _, text in tables._events(html)][-3:] == [(tables._LINK, "b"), (0, ""), (tables._TABLE_END, "")]
    assert tables.grid(html)[1]["links"] == ["q?x&y"]
    assert not tables._fold(tables._events(html), links=False)[1]["links"]
