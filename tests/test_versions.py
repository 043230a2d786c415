"""Versions behind a pointer: shared parts, a run killed before the switch, a run that comes too late, ways back, and cleaning up."""

import pytest
from pyspark.sql import functions as F

from tallyloom.operators import read_models as M
from tallyloom.session import scratch_folder
from tallyloom.sources import versions

MODEL = M.Model(("k",), lambda: {"n": M.count("row"), "low": M.least("v", "long"), "kinds": M.distinct("v")})


def facts(spark, rows):
    df = spark.createDataFrame(rows, "k long, v long, sign int")
    return [M.fact(df, {"k": "k"}, "row", sign=F.col("sign")), M.fact(df, {"k": "k"}, "v", "v", F.col("sign"))]


def seen(spark, at):
    return {r.k: (r.n, r.low, r.kinds) for r in M.rows(versions.current(spark, at).read(spark, "m"), MODEL).collect()}


def test_only_touched_parts_are_read_and_written(spark):
    at = scratch_folder(spark, "parts")
    first = [(k, k + d, 1) for k in range(300) for d in (0, 1)]
    assert M.refresh(spark, at, "a", MODEL, "m", facts(spark, first)) == "published"
    before = versions.current(spark, at)
    assert len(before.tables["m"]) == M.PARTS
    build = M.changed(MODEL.keys, "m", facts(spark, [(7, 7, -1), (7, 9, 1), (1000, 5, 1)]))
    read = build(before)["m"]
    assert 0 < len(read.touched) <= 2
    assert {f.split("/part=")[1].split("/")[0] for f in read.rows.inputFiles() if "/part=" in f} <= set(read.touched)
    assert M.refresh(spark, at, "b", MODEL, "m", facts(spark, [(7, 7, -1), (7, 9, 1), (1000, 5, 1)])) == "published"
    after = versions.current(spark, at)
    assert {p for p, run in after.tables["m"].items() if run == "b"} == set(read.touched) == set(after.own("m"))
    assert seen(spark, at) == {k: (2, k, 2) for k in range(300)} | {7: (2, 8, 2), 1000: (1, 5, 1)}
    # all rows of a key, and of a part, go; and what was never there can't be taken away
    assert M.refresh(spark, at, "c", MODEL, "m", facts(spark, [(k, v, -1) for k, v, _ in first if k != 7] + [(7, 8, -1), (7, 9, -1)])) == "published"
    assert seen(spark, at) == {1000: (1, 5, 1)}
    assert M.refresh(spark, at, "d", MODEL, "m", facts(spark, [(5, 5, -1)])) == "held" and versions.held(spark, at, "d")[0]["gate"] == "negative"
    assert seen(spark, at) == {1000: (1, 5, 1)}


def test_killed_late_and_old_runs(spark, monkeypatch):
    at = scratch_folder(spark, "runs")
    put = lambda n: lambda before: {"t": spark.range(n)}
    count = lambda: versions.current(spark, at).read(spark, "t").count()
    assert versions.current(spark, at).number == 0 and versions.current(spark, at).read(spark, "t") is None
    versions.publish(spark, at, "a", put(3), {})
    with monkeypatch.context() as m:  # killed after the files are written, before the switch
        m.setattr(versions, "_switch", lambda *a: (_ for _ in ()).throw(KeyboardInterrupt))
        with pytest.raises(KeyboardInterrupt):
            versions.publish(spark, at, "b", put(5), {})
    assert count() == 3
    assert versions.publish(spark, at, "b", put(5), {}) == "published" and versions.publish(spark, at, "b", put(9), {}) == "repeated" and count() == 5

    def overtaken(before):
        versions.publish(spark, at, "c", put(6), {})
        return {"t": spark.range(7)}

    with pytest.raises(RuntimeError, match="another run"):
        versions.publish(spark, at, "late", overtaken, {})
    assert count() == 6
    versions.roll_back(spark, at, 1)
    assert count() == 3 and versions.version(spark, at, 2).read(spark, "t").count() == 5
    assert sorted(versions.clean(spark, at, keep=1)) == ["b", "c", "late"] and count() == 3
