"""The data source of result files: encodings, several sheets, gaps, and the memory that a large sheet takes."""

import subprocess
import sys
import zipfile

from tallyloom.plans.acts import _book
from tallyloom.sources.result_files import ResultFiles

MAIN = 'xmlns="http://schemas.openxmlformats.org/spreadsheetml/2006/main"'


def test_sheets_and_texts(spark, tmp_path):
    spark.dataSource.register(ResultFiles)
    _book(f"file://{tmp_path}/a.xlsx", [("Zeta", [["x", None, 3.0], ["y & z"]]), ("Alfa", [[1.5, "x"]]), ("Gol", [])])
    with zipfile.ZipFile(tmp_path / "bare.xlsx", "w") as z:  # no workbook part, rows and cells that are not written
        z.writestr("xl/worksheets/sheet2.xml", f'<worksheet {MAIN}><sheetData><row r="5"><c r="AB5" t="inlineStr"><is><t>far</t></is></c></row></sheetData></worksheet>')
        z.writestr("xl/worksheets/sheet1.xml", f"<worksheet {MAIN}><sheetData><row><c><v>7</v></c></row><row/><row><c><v>-2.0</v></c></row></sheetData></worksheet>")
    (tmp_path / "w.csv").write_bytes("a,b\r\n\"x \"\"y\"\"\nz\",ţ\r\n,\r\n".encode("cp1250"))
    (tmp_path / "u.txt").write_bytes("﻿a;b\n1;ț".encode())
    (tmp_path / "v.csv").write_bytes("a;b;c\n1;2;ș".encode("utf-16"))
    (tmp_path / "empty.csv").write_bytes(b"")
    (tmp_path / "_SUCCESS").write_bytes(b"")
    got = sorted((r.file, r.sheet or "", r.row, list(r.cells)) for r in spark.read.format("result_files").load(str(tmp_path)).collect())
    assert got == sorted([
        ("a.xlsx", "Zeta", 0, ["x", "", "3"]), ("a.xlsx", "Zeta", 1, ["y & z"]), ("a.xlsx", "Alfa", 0, ["1.5", "x"]),
        ("bare.xlsx", "sheet1", 0, ["7"]), ("bare.xlsx", "sheet1", 1, []), ("bare.xlsx", "sheet1", 2, ["-2"]), ("bare.xlsx", "sheet2", 4, [""] * 27 + ["far"]),
        ("w.csv", "", 0, ["a", "b"]), ("w.csv", "", 1, ['x "y"\nz', "ţ"]), ("u.txt", "", 0, ["a", "b"]), ("u.txt", "", 1, ["1", "ț"]), ("v.csv", "", 0, ["a", "b", "c"]), ("v.csv", "", 1, ["1", "2", "ș"]),
    ])
    assert spark.read.format("result_files").load(f"file://{tmp_path}").rdd.getNumPartitions() == 9


def test_an_empty_folder(spark, tmp_path):
    spark.dataSource.register(ResultFiles)
    assert spark.read.format("result_files").load(str(tmp_path)).count() == 0


def test_a_million_rows_stay_small(tmp_path):
    n = 1_000_000
    with zipfile.ZipFile(tmp_path / "big.xlsx", "w", zipfile.ZIP_DEFLATED, compresslevel=1) as z:
        with z.open("xl/worksheets/sheet1.xml", "w") as out:
            out.write(f"<worksheet {MAIN}><sheetData>".encode())
            for a in range(0, n, 10_000):
                out.write("".join(f'<row r="{i + 1}"><c r="A{i + 1}" t="s"><v>{i % 200_000}</v></c><c r="B{i + 1}"><v>{i}</v></c></row>' for i in range(a, a + 10_000)).encode())
            out.write(b"</sheetData></worksheet>")
        z.writestr("xl/sharedStrings.xml", f"<sst {MAIN}>" + "".join(f"<si><t>polling station {i}</t></si>" for i in range(200_000)) + "</sst>")
    code = (
        "import re, sys; from tallyloom.sources.result_files import ResultReader\n"
        "peak = lambda: int(re.search(r'VmHWM:\\s+(\\d+)', open('/proc/self/status').read())[1]) // 1024\n"
        "base, r = peak(), ResultReader(sys.argv[1]); rows = sum(b.num_rows for p in r.partitions() for b in r.read(p)); print(rows, peak() - base, peak())"
    )
    rows, more, peak = map(int, subprocess.run([sys.executable, "-c", code, str(tmp_path)], capture_output=True, text=True, check=True).stdout.split())
    assert rows == n and more < 100 and peak < 300, (more, peak)  # most of the peak is what the libraries take
