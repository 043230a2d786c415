"""Read models kept up to date from changes (A18, D18 to D21), and runs that are published or held."""

from __future__ import annotations

from pyspark.sql import functions as F

from tallyloom.operators import quality as Q
from tallyloom.operators import read_models as M
from tallyloom.operators import temporal as T
from tallyloom.plans import tallies  # noqa: F401  its queries are what the incremental ones must equal
from tallyloom.plans.joins import DEALT, legislatures
from tallyloom.plans.registry import query, sql_of
from tallyloom.session import materialise, scratch_folder, spread, table
from tallyloom.sources import versions


def _day(c: str):
    return F.to_date(c).cast("string")


def history(df, key: str, **old):
    """A table as it was once and what has changed since, as signed rows: a tenth is new, a tenth was told otherwise (old), and copies of a tenth,
    told otherwise, have been deleted."""
    k, sign = F.col(key) % 10, lambda d, n: d.withColumn("sign", F.lit(n))
    was, gone = df.where(k == 1).withColumns(old), df.where(k == 2).withColumns(old)
    before = sign(df.where(~k.isin(0, 1)).unionByName(was).unionByName(gone), 1)
    since = sign(df.where(k == 0), 1).unionByName(sign(was, -1)).unionByName(sign(df.where(k == 1), 1)).unionByName(sign(gone, -1))
    return before, since


def _rows(spark, sf: str, *names: str) -> int:
    """Rows of tables, as their files tell without being read through."""
    return sum(table(spark, sf, name).count() for name in names)


def _kept(spark, name: str, model: M.Model, steps: list, n: int):
    """The model after a full load of about n facts and the changes since, which are fewer; the last run is asked for twice, as after a crash."""
    at = scratch_folder(spark, name)
    for run, facts in enumerate(steps, 1):
        told = M.refresh(spark, at, f"run-{run}", model, name, facts, n=n)
        if told != "published":
            raise ValueError(f"{name}: run {run} was {told}: {versions.held(spark, at, f'run-{run}')}")
    if M.refresh(spark, at, f"run-{len(steps)}", model, name, steps[-1], n=n) != "repeated":
        raise ValueError(f"{name}: a run took effect twice")
    return M.rows(versions.current(spark, at).read(spark, name), model)


BILLS = M.Model(("bill",), lambda: {"submitted_on": M.least("day", "date"), "latest_event_on": M.greatest("day", "date"), "vote_count": M.distinct("vote"), "source_status": F.when(M.count("error") > 0, "failed").otherwise("parsed"), "base": M.count("base")})


@query("d18_incremental", sql_of("d18_bill_vote_summaries"))
def d18(spark, sf):
    sign, who = F.col("sign"), {"bill": "user_id"}
    customers = history(table(spark, sf, "customer").select("c_custkey"), "c_custkey")
    events = history(table(spark, sf, "events").select("event_id", "user_id", "ts", "event_type"), "event_id", ts=F.col("ts") - F.expr("interval 400 days"), event_type=F.lit("error"))
    orders = history(table(spark, sf, "orders").select("o_orderkey", "o_custkey"), "o_orderkey", o_custkey=F.col("o_custkey") + 1)
    facts = lambda c, e, o: [M.fact(c, {"bill": "c_custkey"}, "base", sign=sign), M.fact(e, who, "day", _day("ts"), sign), M.fact(e.where("event_type = 'error'"), who, "error", sign=sign), M.fact(o, {"bill": "o_custkey"}, "vote", "o_orderkey", sign)]
    return _kept(spark, "bills", BILLS, [facts(c, e, o) for c, e, o in zip(customers, events, orders, strict=True)], _rows(spark, sf, "customer", "events", "orders")).where("base > 0").drop("base")


def _level():
    return F.when(M.count("flag") > 3, "nominal").when(M.distinct("flag") > 0, "group_totals").when(M.greatest("price", "double") > 100000, "result_only").otherwise("source_only")


VOTES = M.Model(("o_orderkey",), lambda: {"coverage_level": _level(), "nominal_votes": M.count("flag"), "group_totals": M.distinct("flag"), "base": M.distinct("price")})


@query("d19_incremental", sql_of("d19_vote_coverage_summaries"))
def d19(spark, sf):
    """A line is one fact, of its flag: lines are counted by facts, whatever the flag, and flags by their values."""
    sign, key = F.col("sign"), {"o_orderkey": "l_orderkey"}
    orders = history(table(spark, sf, "orders").select("o_orderkey", "o_totalprice"), "o_orderkey", o_totalprice=F.lit(-1.0))
    lines = history(table(spark, sf, "lineitem").select("l_orderkey", "l_partkey", "l_returnflag"), "l_partkey", l_returnflag=F.lit("X"))
    facts = lambda o, x: [M.fact(o, {"o_orderkey": "o_orderkey"}, "price", "o_totalprice", sign), M.fact(x, key, "flag", "l_returnflag", sign)]
    return _kept(spark, "votes", VOTES, [facts(o, x) for o, x in zip(orders, lines, strict=True)], _rows(spark, sf, "orders", "lineitem")).where("base > 0").drop("base")


def _activity():
    first, last = [M.least(m, "date") for m in ("voted", "told")], [M.greatest(m, "date") for m in ("voted", "told")]
    return {"votes": M.count("voted"), "final_votes": M.count("final"), "proposals": M.count("told"), "first_on": F.least(*first), "last_on": F.greatest(*last)}


MEMBERS = M.Model(("id", "o_custkey", "o_orderstatus"), _activity)


@query("d20_incremental", sql_of("d20_member_activity"))
def d20(spark, sf):
    """Lines have their member from their order, so a change of either counts: changed lines with orders as they are, and lines as they were with changed orders.
    Votes and proposals are facts of their days, and counted by them."""
    leg, keys = F.broadcast(legislatures(spark)), {k: k for k in MEMBERS.keys}
    orders = table(spark, sf, "orders").select("o_orderkey", "o_custkey", "o_orderstatus", "o_orderdate", "o_orderpriority")
    now, orders = orders.withColumn("sign", F.lit(1)), history(orders, "o_orderkey", o_custkey=F.col("o_custkey") + 1)
    lines = history(table(spark, sf, "lineitem").select("l_orderkey", "l_partkey", "l_shipdate"), "l_partkey", l_shipdate=F.col("l_shipdate") - F.expr("interval 900 days"))
    dated = lambda df, c: df.withColumn("d", F.to_date(c)).join(leg, T.within_half_open(F.col("ls"), F.col("le"), F.col("d")))
    n, n_orders = _rows(spark, sf, "lineitem"), _rows(spark, sf, "orders")

    def voted(o):
        o = dated(o, "o_orderdate")
        return [M.fact(o.where("o_orderpriority like '1%'"), keys, "final", sign=F.col("sign")), M.fact(o, keys, "voted", "d", F.col("sign"))]

    def told(x, o):
        x = spread(dated(x, "l_shipdate").select("id", "d", "l_orderkey", F.col("sign").alias("x")), "l_orderkey", most=DEALT, rows=n)
        both = x.join(o.select("o_orderkey", "o_custkey", "o_orderstatus", F.col("sign").alias("y")).hint("shuffle_hash"), F.col("l_orderkey") == F.col("o_orderkey"))
        return [M.fact(both, keys, "told", "d", F.col("x") * F.col("y"))]

    return _kept(spark, "members", MEMBERS, [voted(orders[0]) + told(lines[0], orders[0]), voted(orders[1]) + told(lines[1], now) + told(lines[0], orders[1])], n + n_orders)


ENTITIES = M.Model(("id",), lambda: {"kind": M.greatest("kind", "string"), "label": M.greatest("label", "string"), "on_date": M.greatest("day", "date")})


@query("d21_incremental", sql_of("d21_entity_search_index"))
def d21(spark, sf):
    sign = F.col("sign")
    orders = history(table(spark, sf, "orders").select("o_orderkey", "o_custkey", "o_orderdate"), "o_orderkey", o_orderdate=F.col("o_orderdate") + F.expr("interval 4000 days"))
    named = [("customer", "c", "c_custkey", "member", "c_name"), ("supplier", "s", "s_suppkey", "group", "s_name"), ("nation", "n", "n_nationkey", "party", "n_name"), ("part", "p", "p_partkey", "bill", "p_name")]
    held = [(p, key, kind, label, history(table(spark, sf, t).select(key, label), key, **{label: F.lit("~ once called otherwise")})) for t, p, key, kind, label in named]
    at = lambda p, key: {"id": F.concat(F.lit(p), F.col(key).cast("string"))}
    facts = lambda i: [M.fact(orders[i], at("c", "o_custkey"), "day", _day("o_orderdate"), sign), *[M.fact(h[i], at(p, key), "label", label, sign) for p, key, _, label, h in held], *[M.fact(h[i], at(p, key), "kind", F.lit(kind), sign) for p, key, kind, _, h in held]]
    return _kept(spark, "entities", ENTITIES, [facts(0), facts(1)], _rows(spark, sf, "orders", *[t for t, *_ in named for _ in ("label", "kind")])).where("label is not null")


def _integrity(spark, before, after):
    """K30 as a gate: counts of broken rules before and after, by rule; an error that has grown is a reason."""
    def counts(snapshot):
        rows = snapshot.read(spark, "votes")
        rules = F.explode(F.array(F.when(F.col("o_totalprice") <= 0, "total"), F.when(F.col("o_orderdate").isNull(), "date")))
        found = spark.createDataFrame([], "check string") if rows is None else rows.select(rules.alias("check")).where("check is not null")
        return found.groupBy("check").agg(F.count("*").alias("n")).withColumn("severity", F.lit("error"))

    return Q.verdict(counts(before), counts(after), []).where("verdict = 'worse'").select(F.concat_ws(" ", "check", F.lit("from"), "was", F.lit("to"), "n").alias("reason"))


def _totals(spark, before, after):
    """K31 as a gate: the read model must say what the rows say."""
    rows, model = after.read(spark, "votes"), after.read(spark, "totals")
    told = rows.groupBy("o_orderstatus").agg(F.count("*").alias("counted")).join(model, "o_orderstatus", "full_outer").where("not counted <=> n")
    return told.select(F.concat_ws(" ", "o_orderstatus", "counted", F.lit("against"), "n").alias("reason"))


@query(
    "l06_publish_or_hold",
    """with b as (select count(*) filter (where o_orderkey % 7 = 0 and o_orderkey % 2 = 0 and o_totalprice > 0) as bad from orders),
    t as (select o_orderstatus, count(*) as n, count(*) filter (where o_orderkey % 2 = 0) as even from orders group by 1)
    select 1 as step, 'published' as told, o_orderstatus, even as n, null as reason from t where even > 0
    union all select 2, 'held', o_orderstatus, even, 'total from 0 to ' || bad from t, b where even > 0
    union all select 3, 'held', o_orderstatus, even, (select min(o_orderstatus || ' ' || n || ' against ' || (n + 1)) from t) from t where even > 0
    union all select 4, 'published', o_orderstatus, n, null from t
    union all select 5, 'repeated', o_orderstatus, n, null from t
    union all select 6, 'back', o_orderstatus, even, null from t where even > 0""",
)
def l06_hold(spark, sf):
    """What readers see after each of six runs: one published, one held by the integrity counts, one by totals that don't add up, the same put right, once
    more the same, and the way back to the first."""
    at = scratch_folder(spark, "published")
    orders = table(spark, sf, "orders").select("o_orderkey", "o_orderstatus", "o_orderdate", "o_totalprice").withColumn("o_totalprice", F.greatest("o_totalprice", F.lit(0.01)))
    even = orders.where("o_orderkey % 2 = 0")
    broken = even.withColumn("o_totalprice", F.when(F.col("o_orderkey") % 7 == 0, -F.col("o_totalprice")).otherwise(F.col("o_totalprice")))

    def tables(rows, off: int = 0):
        return lambda before: {"votes": rows, "totals": rows.groupBy("o_orderstatus").agg((F.count("*") + off).alias("n"))}

    seen = None
    for step, (run, build) in enumerate([("a", tables(even)), ("b", tables(broken)), ("c", tables(orders, 1)), ("d", tables(orders)), ("d", tables(even)), (None, None)], 1):
        if run is None:
            versions.roll_back(spark, at, 1)
            told = "back"
        else:
            told = versions.publish(spark, at, run, build, {"integrity": _integrity, "totals": _totals})
        reason = min((r for h in versions.held(spark, at, run) for r in h["reasons"]), default=None) if told == "held" else None
        now = versions.current(spark, at).read(spark, "totals").select(F.lit(step).alias("step"), F.lit(told).alias("told"), "o_orderstatus", "n", F.lit(reason).cast("string").alias("reason"))
        seen = now if seen is None else seen.unionByName(now)
    return materialise(seen, "seen")
