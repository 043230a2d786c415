"""Histories replayed on a stream: equal to the batch fold, with late rows, a restart, silence that ends a period, and rows behind the watermark."""

import datetime as dt

from pyspark.sql import Row
from pyspark.sql import functions as F

from tallyloom.operators import identity
from tallyloom.plans import registry
from tallyloom.session import scratch_folder
from tallyloom.streaming import replay

DIR = "/root/testdata/sf0.001"
ROW = "place string, ts timestamp, day date, seq long, kind string, holder string"


def rows(df):
    return sorted(repr([str(v) for v in r]) for r in df.select(*sorted(df.columns)).collect())


def test_stream_of_decrees_equals_the_batch_fold(spark):
    assert rows(registry.queries()["l08_stateful_replay"](spark, DIR)) == rows(registry.queries()["i11_replay"](spark, DIR))


def test_silence_late_rows_and_a_restart(spark):
    day = lambda s: dt.date.fromisoformat(s)
    told = [("a", "2001-03-01", "appointed", "x"), ("a", "2012-01-01", "appointed", "y"), ("b", "2003-01-01", "appointed", "x"), ("b", "2003-05-01", "recalled", "z"), ("c", "2015-01-01", "appointed", "x"), ("c", "2015-01-01", "recalled", "x"), ("d", "2002-01-01", "recalled", "q")]
    history = [(p, dt.datetime.fromisoformat(d), day(d), i, k, h) for i, (p, d, k, h) in enumerate(told)]
    late = ("b", dt.datetime(2003, 4, 1), day("2003-04-01"), 100, "appointed", "z")  # comes after the row of May, within the delay
    at = scratch_folder(spark, "test-stream")
    put = lambda found, name: spark.createDataFrame(found, ROW).coalesce(1).write.parquet(f"{at}/in/{name}")
    feed = lambda: replay.holders(replay.stream_of(spark, f"{at}/in", spark.createDataFrame([], ROW).schema, files=1), "90 days")
    put([r for r in history if r[2] < day("2003-02-01")], "0")
    replay.follow(feed(), at)
    put([r for r in history if r[2].year == 2003 and r[2].month > 1], "1")
    replay.follow(feed(), at)
    put([late], "2")
    replay.follow(feed(), at)  # another run of the same stream: all it knows comes from the checkpoint
    put([("m", dt.datetime(2010, 6, 1), day("2010-06-01"), 200, replay.MARK, None)], "3")
    replay.follow(feed(), at)
    lapsed = {(r.place, r.holder): (r.started_on, r.ended_on, r.ended) for r in replay.told(spark, at, replay.HOLDERS, "place").collect()}
    assert lapsed["a", "x"] == (day("2001-03-01"), None, "lapsed")  # nobody has been named for eight years, and nothing else came
    put([("a", dt.datetime(2001, 5, 1), day("2001-05-01"), 300, "recalled", "x")], "4")  # nine years behind: too late to count
    put([r for r in history if r[2].year > 2003], "5")
    put([("m", dt.datetime(2016, 6, 1), day("2016-06-01"), 201, replay.MARK, None)], "6")
    replay.follow(feed(), at)
    got = replay.told(spark, at, replay.HOLDERS, "place").drop("number")
    batch = spark.createDataFrame([*history, late], ROW)
    assert rows(got) == rows(identity.timelines(batch.withColumn("seq", F.col("seq")), "2016-03-03"))
    assert {(r.place, r.ended) for r in got.collect()} == {("a", "replaced"), ("a", "open"), ("b", "replaced"), ("b", "recalled"), ("c", "recalled"), ("c", "open"), ("d", "recalled")}


def test_state_is_asked_by_bucket_and_not_by_row():
    """many rows of many keys cost one append and one timer, their fold one value, whatever days they are of."""
    calls = []

    class State:
        def __init__(self):
            self.rows = []

        def appendValue(self, v):
            calls.append("append")
            self.rows.append(v)

        def get(self):
            return self.rows[0] if self.single and self.rows else None if self.single else iter(self.rows)

        def put(self, v):
            calls.append("put")
            self.rows = v

        def clear(self):
            calls.append("clear")
            self.rows = []

        def update(self, v):
            calls.append("update")
            self.rows = [v]

    class Handle:
        def getListState(self, *_):
            s = State()
            s.single = False
            return s

        def getValueState(self, *_):
            s = State()
            s.single = True
            return s

        def registerTimer(self, at):
            calls.append("timer")

    class Now:
        def getCurrentWatermarkInMs(self):
            return replay._ms(dt.date(2003, 1, 20)) + 1000

    p = replay.Holders()
    p.init(Handle())
    row = Row("place", "ts", "day", "seq", "kind", "holder", "bucket")
    day = lambda i: dt.date(2003, 1, 1 + i % 30)
    rows = [row(f"p{i % 7}", dt.datetime.combine(day(i), dt.time()), day(i), i, "appointed", str(i), 1) for i in range(210)]
    assert not list(p.handleInputRows((1,), iter(rows), Now())) and calls == ["append", "timer"]
    calls.clear()
    told = list(p.handleExpiredTimer((1,), Now(), None))
    assert sorted(calls) == ["put", "timer", "update"] and {r.place for r in told} == {f"p{i}" for i in range(7)}
    assert max(r.started_on for r in told) == dt.date(2003, 1, 19)
