"""Ordered histories on a stream: rows wait in state until the watermark has passed their day, then are folded in order, by timers.

Rows may come in any order within the watermark. Keys are dealt into buckets: a bucket keeps the rows of its keys that wait, a piece of state for each
batch, and what each of its keys' folds needs to go on; its timer, at the end of the earliest day of waiting rows, or where silence itself means something (a post
that nobody was named to for eight years), wakes the folds that it concerns. State is asked a few times for a bucket and batch, however many keys and rows there are. What has changed
is emitted as rows with a number and a version: the row of a number with the greatest version holds, so that a repeated batch changes nothing.
Rows behind the watermark are dropped by Spark. The last days of a feed wait for a row that is later by the allowed delay; `MARK` rows are that alone.
"""

from __future__ import annotations

import datetime as dt
import json
from collections.abc import Iterator
from typing import Any

from pyspark.sql import DataFrame, Row
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from tallyloom.operators.entities import NO_PERIOD, Cabinets
from tallyloom.operators.identity import LAPSE_YEARS

#: The kind of a row that carries nothing but its time.
MARK = "mark"
DAY_MS = 86_400_000
#: Buckets that keys are dealt into; a checkpoint is good for one number only.
BUCKETS = 4096
#: Days after which datediff / 365.25 exceeds LAPSE_YEARS.
LAPSE_DAYS = int(LAPSE_YEARS * 365.25) + 1


def _ms(day: dt.date) -> int:
    return (day - dt.date(1970, 1, 1)).days * DAY_MS


class Ordered(StatefulProcessor):
    """Folds the rows of each key of a bucket in order of day once no row can come before them. State is kept as JSON: one value for the bucket's folds,
    as key -> fold and the next day to look at it again, and a list of pieces of waiting rows."""

    #: The column of the keys.
    of: str
    #: What is the same in all rows of a key, and long: told once for each key of a piece.
    once: tuple[str, ...] = ()

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.waiting = handle.getListState("waiting", "rows string")
        self.kept = handle.getValueState("kept", "folds string")

    def handleInputRows(self, key: Any, rows: Iterator[Row], timerValues: Any) -> Iterator[Row]:
        came: dict[Any, list[dict]] = {}
        for r in rows:
            told = r.asDict(recursive=True)
            if told["kind"] != MARK:
                mine = came.setdefault(told[self.of], [])
                mine.append({c: v for c, v in told.items() if not (c in ("bucket", "ts") or (mine and c in self.once))})
        if came:
            self.waiting.appendValue((json.dumps(list(came.values()), default=str),))
            self.handle.registerTimer(_ms(min(r["day"] for mine in came.values() for r in mine)) + DAY_MS)
        yield from ()

    def handleExpiredTimer(self, key: Any, timerValues: Any, expiredTimerInfo: Any) -> Iterator[Row]:
        now = timerValues.getCurrentWatermarkInMs()
        today = dt.date(1970, 1, 1) + dt.timedelta(milliseconds=now)
        done = (today - dt.timedelta(days=1)).isoformat()  # the last day that is over
        waits: dict[Any, list[dict]] = {}
        for (piece,) in self.waiting.get():
            for mine in json.loads(piece):
                waits.setdefault(mine[0][self.of], []).extend(mine)
        ready = {k: r for k, mine in waits.items() if (r := [x for x in mine if x["day"] <= done])}
        folds = {k: (fold, wake) for k, fold, wake in json.loads(told[0])} if (told := self.kept.get()) else {}
        due = {k for k, (_, wake) in folds.items() if wake and wake <= today.isoformat()}
        for k in ready.keys() | due:
            mine = waits.get(k, [])
            about = {c: mine[0][c] for c in self.once} if mine else {}
            fold, changed, wake = self.advance(k, folds.get(k, (None,))[0], [about | x for x in sorted(ready.get(k, []), key=self.order)], today)
            folds[k] = fold, min((d.isoformat() for d in wake), default=None)
            yield from changed
        if ready:
            later = [left for mine in waits.values() if (left := self._later(mine, done))]
            if later:
                self.waiting.put([(json.dumps(later),)])
            else:
                self.waiting.clear()
        else:
            later = list(waits.values())
        if ready or due:
            self.kept.update((json.dumps([[k, *f] for k, f in folds.items()]),))
        # one timer, for the first day that has something to say; one that is there already is not set twice
        days = [_ms(dt.date.fromisoformat(d)) + DAY_MS for d in {x["day"] for mine in later for x in mine}] + [_ms(dt.date.fromisoformat(w)) for _, w in folds.values() if w]
        if days := [d for d in days if d > now]:
            self.handle.registerTimer(min(days))

    def _later(self, mine: list[dict], done: str) -> list[dict]:
        left = [x for x in mine if x["day"] > done]
        return [{c: mine[0][c] for c in self.once} | left[0], *left[1:]] if left else left

    def close(self) -> None:
        pass

    def order(self, row: dict) -> tuple:
        raise NotImplementedError

    def advance(self, key: Any, fold: dict | None, rows: list[dict], today: dt.date) -> tuple[dict, list[Row], list[dt.date]]:
        """The fold after rows, what has changed, and days on which to look again."""
        raise NotImplementedError


HOLDERS = "place string, number long, version long, holder string, started_on date, ended_on date, ended string"


class Holders(Ordered):
    """Holder periods of a post from appointments and recalls; what a period is stands at operators.identity.timelines."""

    of = "place"

    def order(self, row: dict) -> tuple:
        return row["day"], row["kind"] == "appointed", row["seq"]

    def advance(self, key, fold, rows, today):
        fold = fold or {"number": 0, "version": 0, "held": None}
        changed: dict[int, tuple] = {}

        def tell(number: int, holder, started, ended_on, ended) -> None:
            fold["version"] += 1
            changed[number] = (fold["version"], holder, started, ended_on, ended)

        for r in rows:
            held, holder, day = fold["held"], r["holder"], r["day"]
            same = held is not None and holder is not None and held["holder"] == holder
            if r["kind"] == "appointed":
                if not same or held["over"]:
                    if held and not held["over"]:
                        tell(held["number"], held["holder"], held["started"], day, "replaced")
                    fold["number"] += 1
                    fold["held"] = {"number": fold["number"], "holder": holder, "started": day, "over": None, "lapsed": False}
                    tell(fold["number"], holder, day, None, "open")
            elif same and not held["over"]:
                held["over"] = day
                tell(held["number"], holder, held["started"], day, "recalled")
            else:
                fold["number"] += 1
                tell(fold["number"], holder, None, day, "recalled")
        held, wake = fold["held"], []
        if held and not held["over"] and not held["lapsed"]:
            lapse = dt.date.fromisoformat(held["started"]) + dt.timedelta(days=LAPSE_DAYS)
            if lapse <= today:
                held["lapsed"] = True
                tell(held["number"], held["holder"], held["started"], None, "lapsed")
            else:
                wake = [lapse]
        date = lambda d: d and dt.date.fromisoformat(d)
        out = [Row(place=key, number=n, version=v, holder=h, started_on=date(s), ended_on=date(e), ended=x) for n, (v, h, s, e, x) in changed.items()]
        return fold, out, wake


ROLES = "block string, number long, version long, government string, person string, post string, interim boolean, starts_on date, ends_on date, reason string, carried boolean, kind string"


class Roles(Ordered):
    """Who held which post of which government; the rules stand at operators.entities.replay. Of past roles only those that are open stay in state."""

    of, once = "block", ("governments",)

    def order(self, row: dict) -> tuple:
        return row["day"], row["seq"]

    def advance(self, key, fold, rows, today):
        fold = fold or {"version": 0, "governments": json.loads(rows[0]["governments"]) if rows else [], "saved": None}
        cabinets = Cabinets.restored(key, fold["governments"], fold["saved"])
        for r in rows:
            event = {"day": dt.date.fromisoformat(r["day"]), "type": r["kind"], "person": r["person"], "post": r["post"], "members": r["members"]}
            cabinets.advance(event["day"])
            cabinets.apply(event)
        out = []
        for kind, role in cabinets.told():
            fold["version"] += 1
            hidden = role["starts_on"] == role["ends_on"] and role["reason"] in NO_PERIOD
            out.append(Row(block=key, number=role["number"], version=fold["version"], government=role["government"], person=role["person"], post=role["post"], interim=role["interim"], starts_on=role["starts_on"], ends_on=role["ends_on"], reason=role["reason"], carried=role["carried"], kind="none" if hidden or role["gone"] else kind))
        fold["saved"] = cabinets.saved()
        return fold, out, []


def _run(rows: DataFrame, processor: Ordered, schema: str, late: str) -> DataFrame:
    bucket = F.pmod(F.xxhash64(processor.of), F.lit(BUCKETS)).cast("int")
    return rows.withColumn("bucket", bucket).withWatermark("ts", late).groupBy("bucket").transformWithState(processor, schema, "Update", "EventTime")


def holders(rows: DataFrame, late: str) -> DataFrame:
    """rows: a stream of place, ts, day, seq, kind (appointed, recalled, or mark), holder; versions of periods as they become known."""
    return _run(rows.select("place", "ts", "day", "seq", "kind", "holder"), Holders(), HOLDERS, late)


def roles(rows: DataFrame, governments: DataFrame, late: str) -> DataFrame:
    """rows: a stream of block, ts, day, seq, kind (a type of event of operators.entities.replay, or mark), person, post, members;
    governments as there: versions of roles and notes as they become known."""
    known = governments.groupBy("block").agg(F.to_json(F.collect_list(F.struct(*[c for c in governments.columns if c != "block"])), {"ignoreNullFields": "false"}).alias("governments"))
    told = rows.join(known, "block", "left").withColumn("governments", F.coalesce("governments", F.lit("[]")))
    return _run(told.select("block", "ts", "day", "seq", "kind", "person", "post", "members", "governments"), Roles(), ROLES, late)


def latest(versions: DataFrame, key: str) -> DataFrame:
    """Of the versions of a number the last, whatever batch it came in."""
    rest = [c for c in versions.columns if c not in (key, "number", "version", "batch")]
    return versions.groupBy(key, "number").agg(F.max_by(F.struct(*rest), "version").alias("x")).select(key, "number", "x.*")


def stream_of(spark, folder: str, schema, files: int = 16) -> DataFrame:
    """Rows of the Parquet files below a folder, in the order in which they came to be there."""
    return spark.readStream.schema(schema).option("recursiveFileLookup", "true").option("maxFilesPerTrigger", files).parquet(folder)


def follow(versions: DataFrame, folder: str) -> None:
    """Work off what is there: each batch writes its rows under its number, the checkpoint lies beside them, and a later call goes on from it."""
    spark = versions.sparkSession
    provider = "spark.sql.streaming.stateStore.providerClass"
    before = spark.conf.get(provider)
    spark.conf.set(provider, "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")  # what keyed state variables and timers need
    try:
        step = lambda batch, number: batch.write.mode("overwrite").parquet(f"{folder}/rows/batch={number}")
        q = versions.writeStream.outputMode("update").trigger(availableNow=True).option("checkpointLocation", f"{folder}/log").foreachBatch(step).start()
    finally:
        spark.conf.set(provider, before)
    q.awaitTermination()


def told(spark, folder: str, schema: str, key: str) -> DataFrame:
    """What follow has written so far, the last version of each number."""
    return latest(spark.read.schema(schema).parquet(f"{folder}/rows"), key)
