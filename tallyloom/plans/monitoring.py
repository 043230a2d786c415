"""Text comparisons and places (J), coverage and audits (K), streams (L)."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import functions as F

from tallyloom.operators import areas
from tallyloom.operators import documents as D
from tallyloom.operators import relational as R
from tallyloom.operators.duplicates import classes, duplicates
from tallyloom.plans.people import I12_SQL, cases, given
from tallyloom.plans.records import decrees
from tallyloom.plans.registry import query
from tallyloom.session import scratch_folder, table
from tallyloom.streaming import engagement, replay


@query("j08_word_diff")
def j08(spark, sf):
    """Word differences of each benchmark item and a changed copy of it."""
    b = table(spark, sf, "benchmark")
    changed = F.regexp_replace("text", r"^(\S+)\s", "$1 also ")
    return b.select("item_id", F.to_json(D.diffed(F.col("text"), changed)).alias("diff"))


@query("j14_sittings", "select cast(o_orderdate as date) as day, count(*) as votes, count(*) filter (where regexp_matches(o_orderpriority, '(?i)urgent|high')) as joint from orders group by 1")
def j14(spark, sf):
    """Votes of each sitting day, those on a joint matter apart."""
    return table(spark, sf, "orders").groupBy(F.to_date("o_orderdate").alias("day")).agg(F.count("*").alias("votes"), F.count_if(F.col("o_orderpriority").rlike("(?i)urgent|high")).alias("joint"))


#: Stations as the minutes print them: constituency, code, place, and the key of the area that they belong to.
STATIONS = (
    (10, "1017", "Alba Iulia", "1017"), (42, "179132", "Bucureşti Sectorul 3", "179169"), (45, "179132", "MUNICIPIUL BUCUREŞTI SECTORUL 2", "179150"), (42, "179196", "Sectorul 6", "179196"),
    (43, "0", "Republica Moldova", "abroad:republica-moldova"), (43, None, "", "abroad:unknown"), (14, "63171", "Băneasa", "61069"), (15, "63171", "Băneasa", "63171"), (7, "0", "?", "unknown:7"), (7, "", "", "unknown:7"), (0, "1", "Nicăieri", None),
)


@query(
    "j16_area_totals",
    f"""with s as (select o_orderkey, key, c, coalesce(code, '') as code, o_orderkey // 50 as station, o_custkey % 3 as version, o_orderkey % 7 as present, o_orderkey % 5 as valid
      from orders join {cases([(i, *r[:2], r[3]) for i, r in enumerate(STATIONS)], 'i', 'c', 'code', 'key')} on i = o_orderkey % {len(STATIONS)} where c <> 0),
    l as (select * from s qualify row_number() over (partition by c, code, station order by version desc, o_orderkey desc) = 1)
    select key, count(*) as sections, cast(sum(present) as bigint) as present, cast(sum(valid) as bigint) as valid from l group by 1""",
)
def j16(spark, sf):
    """Results by commune: the latest report of each station; the capital by sector, places abroad by country, codes of an old register as in the new."""
    rows = given(spark, sf, [r[:3] for r in STATIONS], ["number", "code", "name"]).join(table(spark, sf, "orders").select("o_orderkey", "o_custkey"), "o_orderkey")
    k = F.col("o_orderkey")
    stations = rows.select("number", F.coalesce("code", F.lit("")).alias("code"), "name", F.floor(k / 50).alias("station"), F.lit(1).alias("kind"), (F.col("o_custkey") % 3).alias("version"), k.alias("row"), (k % 7).alias("present"), (k % 5).alias("valid"))
    return areas.area_totals(stations, ["present", "valid"]).drop("number")


#: Where somebody is sent, in words, and the places (by spelling) that the words name.
SPELLINGS = (("franța", "FR"), ("franta", "FR"), ("bosnia și herțegovina", "BA"), ("republica moldova", "MD"), ("italia", "IT"), ("malta", "MT"), ("san marino", "SM"), ("trinidad și tobago", "TT"))
SENT = (
    ("Republica Franța", ("FR",)), ("Bosnia și Herțegovina", ("BA",)), ("Italia, Malta și San Marino", ("IT", "MT", "SM")), ("Republica Moldova", ("MD",)), ("Republica Italia și în Republica Malta", ("IT", "MT")),
    ("Regatul Atlantida", (None,)), ("Franța și Atlantida", ("FR", None)), ("", (None,)),
)


@query("j18_gazetteer", f"select o_orderkey, place from orders join {cases([(i, p) for i, s in enumerate(SENT) for p in s[1]], 'i', 'place')} on i = o_orderkey % {len(SENT)}")
def j18(spark, sf):
    """Phrases to places through spellings, whole or in parts; what no spelling knows stays, without a place."""
    phrases = given(spark, sf, [(s[0],) for s in SENT], ["phrase"])
    return areas.placed(phrases, "phrase", spark.createDataFrame(SPELLINGS, "spelling string, place string")).select("o_orderkey", "place")


@query(
    "j19_reports_asked_and_given",
    """with s as (select l_orderkey as bill, case l_linenumber % 4 when 0 then 'ask' when 1 then 'give' when 2 then 'ask2' else 'other' end as t, 'com ' || l_suppkey % 2 as who, cast(l_shipdate as date) as day from lineitem),
    a as (select bill, t, who, min(day) as asked_on from s where t in ('ask', 'ask2') group by all), g as (select bill, who, min(day) as answered_on from s where t = 'give' group by all)
    select a.bill, case t when 'ask' then 'committee_opinion' else 'body_opinion' end as kind, a.who as issuer, asked_on, case when t = 'ask' then answered_on end as answered_on from a left join g on g.bill = a.bill and g.who = a.who""",
)
def j19(spark, sf):
    """Opinions that a bill's steps asked for: when, of whom, and when the answer came, if it did."""
    n = F.col("l_linenumber") % 4
    kind = F.when(n == 0, "committee_opinion_requested").when(n == 1, "committee_opinion_received").when(n == 2, "opinion_requested").otherwise("registered")
    steps = table(spark, sf, "lineitem").select(F.col("l_orderkey").alias("bill"), kind.alias("type"), F.concat(F.lit("com "), (F.col("l_suppkey") % 2).cast("string")).alias("issuer"), F.to_date("l_shipdate").alias("day"))
    asks = {"committee_opinion_requested": "committee_opinion", "opinion_requested": "body_opinion", "government_view_requested": "government_view"}
    gives = {"committee_opinion_received": "committee_opinion", "committee_report_received": "committee_opinion", "opinion_received": "body_opinion", "government_view_received": "government_view"}
    return areas.asked_and_given(steps, asks, gives)


def _both(spark, sf):
    base = table(spark, sf, "orders").select(F.col("o_orderkey").alias("k"), F.to_date("o_orderdate").alias("d"))
    official = base.where("k % 7 <> 0").withColumn("total", F.col("k") % 5)
    held = base.where("k % 9 <> 0").select("k", "d", (F.col("k") % 6).alias("total"))
    return official, held


_BOTH = """o as (select o_orderkey as k, cast(o_orderdate as date) as d, o_orderkey % 5 as total from orders where o_orderkey % 7 <> 0),
    h as (select o_orderkey as k, cast(o_orderdate as date) as d, o_orderkey % 6 as total from orders where o_orderkey % 9 <> 0)"""


@query(
    "k32_backfill_plan",
    f"with {_BOTH} select o.k, case when h.k is null then 'missing' else 'differs' end as reason from o left join h on h.k = o.k where h.k is null or h.total <> o.total order by o.d desc, o.k desc limit 40",
)
def k32(spark, sf):
    """What to fetch next: missing or differing votes, newest first, up to a limit that the caller sets."""
    official, held = _both(spark, sf)
    found = R.reconcile(official, held, ["k"], ["d", "total"]).where(F.col("status").isin("missing", "differs"))
    return official.join(found.select("k", F.col("status").alias("reason")), "k").orderBy(F.desc("d"), F.desc("k")).limit(40).select("k", "reason")


@query(
    "k33_coverage_by_month",
    f"""with {_BOTH} select cast(date_trunc('month', o.d) as date) as month, count(*) as official, count(h.k) as held, round(count(h.k) * 10000.0 / count(*)) / 100 as percent
    from o left join h on h.k = o.k group by 1""",
)
def k33(spark, sf):
    official, held = _both(spark, sf)
    both = official.join(held.select("k", F.lit(1).alias("held")), "k", "left")
    by = both.groupBy(F.trunc("d", "month").alias("month")).agg(F.count("*").alias("official"), F.count("held").alias("held"))
    return by.withColumn("percent", F.round(F.col("held") * 10000 / F.col("official")) / 100)


@query(
    "k34_shared_identifiers",
    "with i as (select p_partkey, unnest([p_brand || p_size, p_name || p_type]) as id from part) select id, count(distinct p_partkey) as records, min(p_partkey) as first from i group by 1 having count(distinct p_partkey) > 1",
)
def k34(spark, sf):
    """Identifiers that more than one record carries."""
    ids = F.explode(F.array(F.concat("p_brand", F.col("p_size").cast("string")), F.concat("p_name", "p_type")))
    by = table(spark, sf, "part").select("p_partkey", ids.alias("id")).groupBy("id")
    return by.agg(F.count_distinct("p_partkey").alias("records"), F.min("p_partkey").alias("first")).where("records > 1")


_PRINTS = """[p_brand || '/' || p_size, p_type || '/' || p_name, 'price ' || cast(floor(p_retailprice) as int) || ' ' || p_brand, p_name || p_size]"""


def _fingerprinted(spark, sf):
    """Parts with four identifiers each, as several sources would tell them."""
    text = lambda *c: F.concat(*[x if not isinstance(x, str) else F.col(x).cast("string") for x in c])
    price = text(F.lit("price "), F.floor("p_retailprice").cast("int").cast("string"), F.lit(" "), "p_brand")
    return table(spark, sf, "part"), F.array(text("p_brand", F.lit("/"), "p_size"), text("p_type", F.lit("/"), "p_name"), price, text("p_name", "p_size"))


@query(
    "k34_duplicate_fingerprints",
    f"""with p as (select p_partkey as id, list_sort(list_distinct({_PRINTS})) as keys from part), c as (select keys, min(id) as rep from p group by 1),
    e as (select rep, unnest(keys) as key from c)
    select x.rep as a, y.rep as b, cast(count(*) as int) as shared from e x join e y on x.key = y.key and x.rep < y.rep group by 1, 2 having count(*) >= 2""",
)
def k34_pairs(spark, sf):
    """Parts that share two fingerprints or more, each pair met once."""
    parts, keys = _fingerprinted(spark, sf)
    return duplicates(parts, "p_partkey", keys)[0]


@query("k34_duplicate_classes", f"with p as (select p_partkey as id, list_sort(list_distinct({_PRINTS})) as keys from part) select id, min(id) over (partition by keys) as rep from p")
def k34_classes(spark, sf):
    """Parts whose fingerprints are all alike, by the smallest of them."""
    parts, keys = _fingerprinted(spark, sf)
    return classes(parts, "p_partkey", keys)


@query("l01_append_events", "select event_type, count(*) as n from events group by 1")
def l01(spark, sf):
    """Events as they arrive, appended to a table."""
    at = scratch_folder(spark, "append")
    q = engagement.stream(spark, sf).select("event_id", "event_type").writeStream.trigger(availableNow=True).option("checkpointLocation", f"{at}/log").format("parquet").start(f"{at}/rows")
    q.awaitTermination()
    return spark.read.parquet(f"{at}/rows").groupBy("event_type").agg(F.count("*").alias("n"))


@query(
    "l04_flood_guard",
    """with w as (select date_trunc('hour', ts) - to_hours(i) as start, user_id, count(*) as n from events, lateral (select unnest(range(0, 24)) as i) group by 1, 2)
    select cast(start as timestamp) as start, user_id, n from w where n > 3""",
)
def l04(spark, sf):
    """Visitors with more than three events in a day, by hourly sliding windows over the hours that a stream counts."""
    hours = engagement.collected(engagement.hourly(engagement.stream(spark, sf).select("ts", "user_id")), ["start", "user_id"], "flood")
    return engagement.flooding_days(hours, 3).select(F.col("start").cast("timestamp_ntz").alias("start"), "user_id", "n")


#: Last success, today, days held back, and the window that must come out: three days back, or to a held day, at most sixty days.
_RUNS = (("2024-01-09", "2024-01-12", (), "2024-01-06"), (None, "2024-01-12", (), "2023-11-13"), ("2024-01-09", "2024-01-12", ("2024-01-02",), "2024-01-02"), ("2023-06-01", "2024-01-20", (), "2023-11-21"), ("2024-01-09", "2024-01-12", ("2024-01-11",), "2024-01-06"))


@query(
    "l05_late_lookback",
    "select run, day, count(*) as n from (values " + ", ".join(f"({i}, date '{r[3]}', date '{r[1]}')" for i, r in enumerate(_RUNS)) + ") w(run, lo, hi) join (select cast(ts as date) as day from events) on day between lo and hi group by 1, 2",
)
def l05(spark, sf):
    """What each of several runs reads: the days from before its last success, and those that were held back."""
    day = dt.date.fromisoformat
    windows = [(i, *engagement.catch_up_window(r[0] and day(r[0]), day(r[1]), list(map(day, r[2])))) for i, r in enumerate(_RUNS)]
    w = spark.createDataFrame(windows, "run int, lo date, hi date")
    by = table(spark, sf, "events").groupBy(F.to_date("ts").alias("day")).agg(F.count("*").alias("n"))
    return by.join(F.broadcast(w), F.col("day").between(F.col("lo"), F.col("hi"))).select("run", "day", "n")


@query("l06_catch_up", "select user_id, count(*) as n from events group by 1")
def l06(spark, sf):
    """All that is there in one run of batches; each batch writes the folder of its number, so a repeated batch replaces itself."""
    at = scratch_folder(spark, "catch-up")

    def step(batch, number):
        batch.groupBy("user_id").agg(F.count("*").alias("n")).write.mode("overwrite").parquet(f"{at}/batch={number}")

    engagement.catch_up(engagement.stream(spark, sf).select("event_id", "user_id"), step, f"{at}-log")
    return spark.read.parquet(at).groupBy("user_id").agg(F.sum("n").alias("n"))


#: The allowed delay of the feeds below; a tenth of the rows comes one delivery late.
LATE, DELIVERIES = "14 days", 5


def _delivered(rows, mark, name: str, build, schema: str, key: str):
    """rows (event_id, ts, day, ...) delivered in parts, some late, read as a stream; then a last row that moves time on, read by a second run of the
    same stream from its checkpoint."""
    spark, at = rows.sparkSession, scratch_folder(rows.sparkSession, name)
    late = F.when(F.col("event_id") % 10 == 0, 1).otherwise(0)
    dealt = rows.withColumn("delivery", F.floor(F.dayofmonth("day") / 7) + late)
    for k in range(DELIVERIES + 1):
        dealt.where(F.col("delivery") == k).drop("delivery").write.parquet(f"{at}/in/{k}")
    feed = build(replay.stream_of(spark, f"{at}/in", rows.schema))
    replay.follow(feed, at)
    rows.limit(1).select(*[F.lit(mark).cast("timestamp").alias(c) if c == "ts" else F.lit(replay.MARK).alias(c) if c == "kind" else F.col(c) for c in rows.columns]).write.parquet(f"{at}/in/mark")
    replay.follow(feed, at)
    return replay.told(spark, at, schema, key)


@query("l08_stateful_timelines", I12_SQL)
def l08_timelines(spark, sf):
    """Holders of posts from appointments and recalls that come as a stream, some of them late."""
    e = table(spark, sf, "events").where(F.col("event_type").isin("view", "purchase"))
    kind = F.when(F.col("event_type") == "view", "appointed").otherwise("recalled")
    rows = e.select("event_id", F.col("ts").cast("timestamp").alias("ts"), F.to_date("ts").alias("day"), F.col("user_id").cast("string").alias("place"), F.col("event_id").alias("seq"), kind.alias("kind"), (F.col("event_id") % 5).cast("string").alias("holder"))
    out = _delivered(rows, "2024-02-15", "timelines", lambda s: replay.holders(s, LATE), replay.HOLDERS, "place")
    return out.select("place", "holder", "started_on", "ended_on", "ended")


@query("l08_stateful_replay")
def l08_replay(spark, sf):
    """Cabinets from decrees that come as a stream, some of them late; the same rows as i11_replay."""
    events, governments = decrees(spark, sf)
    rows = events.select(F.col("seq").alias("event_id"), F.col("day").cast("timestamp").alias("ts"), "day", "block", "seq", F.col("type").alias("kind"), "person", "post", "members")
    out = _delivered(rows, "2024-02-15", "replay", lambda s: replay.roles(s, governments, LATE), replay.ROLES, "block")
    return out.where("kind <> 'none'").drop("number")
