"""Aggregations and read models (D)."""

from __future__ import annotations

from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tallyloom.operators import aggregates as A
from tallyloom.operators import relational as R
from tallyloom.operators import temporal as T
from tallyloom.plans.joins import LEG_SQL, legislatures
from tallyloom.plans.registry import query
from tallyloom.session import table

MONEY = "cast(sum(cast({} as decimal(18,2))) as double)"


def money(c):
    return F.sum(F.col(c).cast("decimal(18,2)")).cast("double")


@query("d01_group_by", f"select l_returnflag, l_linestatus, count(*) as n, {MONEY.format('l_extendedprice')} as total, min(l_shipdate) as first, max(l_shipdate) as last from lineitem group by 1, 2")
def d01(spark, sf):
    return table(spark, sf, "lineitem").groupBy("l_returnflag", "l_linestatus").agg(F.count("*").alias("n"), money("l_extendedprice").alias("total"), F.min("l_shipdate").alias("first"), F.max("l_shipdate").alias("last"))


@query("d02_filtered_aggregate", "select o_orderstatus, count(*) filter (where o_orderpriority like '1%') as urgent, count(*) filter (where o_totalprice > 100000) as large from orders group by 1")
def d02(spark, sf):
    return table(spark, sf, "orders").groupBy("o_orderstatus").agg(F.count_if(F.col("o_orderpriority").like("1%")).alias("urgent"), F.count_if(F.col("o_totalprice") > 100000).alias("large"))


@query("d03_count_distinct", "select l_returnflag, count(distinct l_orderkey) as ballots, count(distinct l_suppkey) as members from lineitem group by 1")
def d03(spark, sf):
    return table(spark, sf, "lineitem").groupBy("l_returnflag").agg(F.count_distinct("l_orderkey").alias("ballots"), F.count_distinct("l_suppkey").alias("members"))


@query("d04_status_precedence", "select l_orderkey, case when bool_or(l_returnflag = 'R') then 'failed' when bool_or(l_returnflag = 'A') then 'partial' else 'parsed' end as status from lineitem group by 1")
def d04(spark, sf):
    some = lambda v: F.bool_or(F.col("l_returnflag") == v)
    return table(spark, sf, "lineitem").groupBy("l_orderkey").agg(F.when(some("R"), "failed").when(some("A"), "partial").otherwise("parsed").alias("status"))


@query("d05_distinct_ordered_array", "select c_nationkey, array_to_string(list_sort(list(distinct c_mktsegment)), ',') as segments from customer group by 1")
def d05(spark, sf):
    return table(spark, sf, "customer").groupBy("c_nationkey").agg(F.array_join(F.sort_array(F.collect_set("c_mktsegment")), ",").alias("segments"))


@query("d06_ordered_concat", "select conv_id, string_agg(text, ' ' order by turn) as whole from conversations group by 1")
def d06(spark, sf):
    parts = F.sort_array(F.collect_list(F.struct("turn", "text")))
    return table(spark, sf, "conversations").groupBy("conv_id").agg(F.array_join(F.transform(parts, lambda p: p["text"]), " ").alias("whole"))


@query("d07_ordered_objects", "select o_orderstatus, string_agg(o_orderpriority || ':' || n, ',' order by n desc, o_orderpriority) as by_priority from (select o_orderstatus, o_orderpriority, count(*) as n from orders group by 1, 2) group by 1")
def d07(spark, sf):
    n = table(spark, sf, "orders").groupBy("o_orderstatus", "o_orderpriority").agg(F.count("*").alias("n"))
    ranked = F.sort_array(F.collect_list(F.struct((-F.col("n")).alias("rank"), "o_orderpriority", "n")))
    return n.groupBy("o_orderstatus").agg(F.array_join(F.transform(ranked, lambda x: F.concat(x["o_orderpriority"], F.lit(":"), x["n"].cast("string"))), ",").alias("by_priority"))


@query("d08_map_merge", "select user_id, cast(coalesce(max(case when event_type = 'view' then event_id end), -1) as bigint) as view, cast(coalesce(max(case when event_type = 'click' then event_id end), -1) as bigint) as click from events group by 1")
def d08(spark, sf):
    """Merge the maps of one key; where both have an entry, the later one wins."""
    last = table(spark, sf, "events").groupBy("user_id", "event_type").agg(F.max("event_id").alias("e"))
    merged = last.groupBy("user_id").agg(F.map_from_entries(F.collect_list(F.struct("event_type", "e"))).alias("m"))
    return merged.select("user_id", *[F.coalesce(F.col("m")[k], F.lit(-1)).cast("long").alias(k) for k in ("view", "click")])


@query("d09_having", "select l_orderkey, l_linenumber, count(*) as n from lineitem group by 1, 2 having count(*) > 1")
def d09(spark, sf):
    return table(spark, sf, "lineitem").groupBy("l_orderkey", "l_linenumber").agg(F.count("*").alias("n")).where("n > 1")


@query("d10_first_n_per_group", "select c_nationkey, c_custkey from (select c_nationkey, c_custkey, row_number() over (partition by c_nationkey order by c_name, c_custkey) as rn from customer) where rn <= 12")
def d10(spark, sf):
    return R.first_n(table(spark, sf, "customer"), ["c_nationkey"], 12, F.col("c_name"), F.col("c_custkey")).select("c_nationkey", "c_custkey")


@query("d11_mode", "select c_nationkey, c_mktsegment, n from (select c_nationkey, c_mktsegment, count(*) as n, row_number() over (partition by c_nationkey order by count(*) desc, c_mktsegment) as rn from customer group by 1, 2) where rn = 1")
def d11(spark, sf):
    return A.mode(table(spark, sf, "customer"), ["c_nationkey"], "c_mktsegment")


@query("d12_share_of_total", "select l_returnflag, l_suppkey, round(n / sum(n) over (partition by l_returnflag), 9) as share from (select l_returnflag, l_suppkey, count(*) as n from lineitem group by 1, 2)")
def d12(spark, sf):
    n = table(spark, sf, "lineitem").groupBy("l_returnflag", "l_suppkey").agg(F.count("*").alias("n"))
    return n.select("l_returnflag", "l_suppkey", F.round(A.share(F.col("n"), F.sum("n").over(W.partitionBy("l_returnflag"))), 9).alias("share"))


@query("d13_rounded_percentages", "select l_suppkey, round(a * 10000.0 / n) / 100 as two, floor(a * 1000.0 / n) / 10 as one from (select l_suppkey, count(*) filter (where l_returnflag = 'A') as a, count(*) as n from lineitem group by 1)")
def d13(spark, sf):
    """Coverage is rounded to two decimals; progress is floored to one, so that 100 means all."""
    n = table(spark, sf, "lineitem").groupBy("l_suppkey").agg(F.count_if(F.col("l_returnflag") == "A").alias("a"), F.count("*").alias("n"))
    return n.select("l_suppkey", (F.round(F.col("a") * 10000.0 / F.col("n")) / 100).alias("two"), (F.floor(F.col("a") * 1000.0 / F.col("n")) / 10).cast("double").alias("one"))


@query("d14_array_pair_sum", "select o_orderstatus, code, votes, place from (select *, row_number() over (partition by o_orderstatus order by votes desc, code) as place from (select o_orderstatus, l_linenumber as code, cast(sum(cast(l_quantity as bigint)) as bigint) as votes from orders join lineitem on o_orderkey = l_orderkey group by 1, 2))")
def d14(spark, sf):
    """Results packed as parallel arrays of list codes and votes, summed by any key."""
    line, orders = table(spark, sf, "lineitem"), table(spark, sf, "orders")
    packed = line.groupBy("l_orderkey").agg(F.collect_list(F.struct("l_linenumber", F.col("l_quantity").cast("long").alias("q"))).alias("p"))
    areas = packed.select("l_orderkey", F.col("p.l_linenumber").alias("codes"), F.col("p.q").alias("list_votes")).join(orders.select(F.col("o_orderkey").alias("l_orderkey"), "o_orderstatus"), "l_orderkey")
    return A.sum_pairs(areas, ["o_orderstatus"], "codes", "list_votes")


@query("d15_count_grid", "select cast(year(o_orderdate) as integer) as y, o_orderstatus, count(*) as n from orders group by 1, 2")
def d15(spark, sf):
    return table(spark, sf, "orders").groupBy(F.year("o_orderdate").alias("y"), "o_orderstatus").agg(F.count("*").alias("n"))


@query("d16_latest_version_then_sum", f"select l_suppkey, {MONEY.format('l_extendedprice')} as total from (select *, row_number() over (partition by l_suppkey, l_linenumber order by l_quantity desc, l_orderkey desc, l_extendedprice desc) as rn from lineitem) where rn = 1 group by 1")
def d16(spark, sf):
    last = table(spark, sf, "lineitem").withColumn("n", F.row_number().over(W.partitionBy("l_suppkey", "l_linenumber").orderBy(F.desc("l_quantity"), F.desc("l_orderkey"), F.desc("l_extendedprice")))).where("n = 1")
    return last.groupBy("l_suppkey").agg(money("l_extendedprice").alias("total"))


@query("d17_guarded_partial_sums", "select l_orderkey, case when a + b = t then a else 0 end as a, case when a + b = t then b else 0 end as b from (select l_orderkey, cast(sum(case when l_linestatus = 'F' then l_quantity else 0 end) as bigint) as a, cast(sum(case when l_linestatus = 'O' then l_quantity else 0 end) as bigint) as b, cast(sum(l_quantity) as bigint) as t from lineitem group by 1)")
def d17(spark, sf):
    part = lambda v: F.sum(F.when(F.col("l_linestatus") == v, F.col("l_quantity")).otherwise(0)).cast("long")
    s = table(spark, sf, "lineitem").groupBy("l_orderkey").agg(part("F").alias("a"), part("O").alias("b"), F.sum("l_quantity").cast("long").alias("t"))
    ok = F.col("a") + F.col("b") == F.col("t")
    return s.select("l_orderkey", *[F.when(ok, F.col(c)).otherwise(0).alias(c) for c in "ab"])


@query(
    "d18_bill_vote_summaries",
    """select c_custkey as bill, min(cast(ts as date)) as submitted_on, max(cast(ts as date)) as latest_event_on, count(distinct o_orderkey) as vote_count,
    case when bool_or(event_type = 'error') then 'failed' else 'parsed' end as source_status
    from customer left join events on user_id = c_custkey left join orders on o_custkey = c_custkey group by 1""",
)
def d18(spark, sf):
    """Both children are summed up before the join, so that they don't multiply each other."""
    events = table(spark, sf, "events").groupBy(F.col("user_id").alias("c_custkey")).agg(F.min(F.to_date("ts")).alias("submitted_on"), F.max(F.to_date("ts")).alias("latest_event_on"), F.bool_or(F.col("event_type") == "error").alias("bad"))
    votes = table(spark, sf, "orders").groupBy(F.col("o_custkey").alias("c_custkey")).agg(F.count_distinct("o_orderkey").alias("n"))
    all_ = table(spark, sf, "customer").select("c_custkey").join(events, "c_custkey", "left").join(votes, "c_custkey", "left")
    return all_.select(F.col("c_custkey").alias("bill"), "submitted_on", "latest_event_on", F.coalesce("n", F.lit(0)).alias("vote_count"), F.when(F.col("bad"), "failed").otherwise("parsed").alias("source_status"))


@query(
    "d19_vote_coverage_summaries",
    """with n as (select l_orderkey, count(*) as nominal, count(distinct l_returnflag) as totals from lineitem group by 1)
    select o_orderkey, case when coalesce(nominal, 0) > 3 then 'nominal' when coalesce(totals, 0) > 0 then 'group_totals' when o_totalprice > 100000 then 'result_only' else 'source_only' end as coverage_level,
    coalesce(nominal, 0) as nominal_votes, coalesce(totals, 0) as group_totals from orders left join n on l_orderkey = o_orderkey""",
)
def d19(spark, sf):
    n = table(spark, sf, "lineitem").groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(F.count("*").alias("nominal"), F.count_distinct("l_returnflag").alias("totals"))
    all_ = table(spark, sf, "orders").join(n, "o_orderkey", "left").fillna(0, ["nominal", "totals"])
    level = F.when(F.col("nominal") > 3, "nominal").when(F.col("totals") > 0, "group_totals").when(F.col("o_totalprice") > 100000, "result_only").otherwise("source_only")
    return all_.select("o_orderkey", level.alias("coverage_level"), F.col("nominal").alias("nominal_votes"), F.col("totals").alias("group_totals"))


@query(
    "d20_member_activity",
    f"""with {LEG_SQL}, v as (select id, o_custkey, o_orderstatus, count(*) as votes, count(*) filter (where o_orderpriority like '1%') as final_votes, min(cast(o_orderdate as date)) as v_first, max(cast(o_orderdate as date)) as v_last
      from orders join leg on cast(o_orderdate as date) >= ls and cast(o_orderdate as date) < le group by 1, 2, 3),
    l as (select id, o_custkey, o_orderstatus, count(*) as proposals, min(cast(l_shipdate as date)) as l_first, max(cast(l_shipdate as date)) as l_last
      from lineitem join orders on l_orderkey = o_orderkey join leg on cast(l_shipdate as date) >= ls and cast(l_shipdate as date) < le group by 1, 2, 3),
    base as (select id, o_custkey, o_orderstatus from v union select id, o_custkey, o_orderstatus from l)
    select id, o_custkey, o_orderstatus, coalesce(votes, 0) as votes, coalesce(final_votes, 0) as final_votes, coalesce(proposals, 0) as proposals, least(v_first, l_first) as first_on, greatest(v_last, l_last) as last_on
    from base left join v using (id, o_custkey, o_orderstatus) left join l using (id, o_custkey, o_orderstatus)""",
)
def d20(spark, sf):
    """One row for each member, legislature and chamber; every activity is summed up on its own, then joined on the key."""
    keys = ["id", "o_custkey", "o_orderstatus"]
    leg, orders = F.broadcast(legislatures(spark)), table(spark, sf, "orders")
    dated = lambda df, c: df.withColumn("d", F.to_date(c)).join(leg, T.within_half_open(F.col("ls"), F.col("le"), F.col("d"))).groupBy(*keys)
    v = dated(orders, "o_orderdate").agg(F.count("*").alias("votes"), F.count_if(F.col("o_orderpriority").like("1%")).alias("final_votes"), F.min("d").alias("v_first"), F.max("d").alias("v_last"))
    lines = table(spark, sf, "lineitem").join(orders, F.col("l_orderkey") == F.col("o_orderkey"))
    p = dated(lines, "l_shipdate").agg(F.count("*").alias("proposals"), F.min("d").alias("l_first"), F.max("d").alias("l_last"))
    both = v.join(p, keys, "full_outer").fillna(0, ["votes", "final_votes", "proposals"])
    return both.select(*keys, "votes", "final_votes", "proposals", F.least("v_first", "l_first").alias("first_on"), F.greatest("v_last", "l_last").alias("last_on"))


@query(
    "d21_entity_search_index",
    """select id, kind, label, on_date from (select *, row_number() over (partition by id order by on_date desc nulls last, label) as rn from (
      select 'c' || c_custkey as id, 'member' as kind, c_name as label, cast(o_orderdate as date) as on_date from customer left join orders on o_custkey = c_custkey
      union all select 's' || s_suppkey, 'group', s_name, null from supplier
      union all select 'n' || n_nationkey, 'party', n_name, null from nation
      union all select 'p' || p_partkey, 'bill', p_name, null from part)) where rn = 1""",
)
def d21(spark, sf):
    """The branches with one row for each id skip the choice; only members have several dates."""
    latest = table(spark, sf, "orders").groupBy(F.col("o_custkey").alias("c_custkey")).agg(F.max(F.to_date("o_orderdate")).alias("on_date"))
    people = table(spark, sf, "customer").join(latest, "c_custkey", "left")
    row = lambda df, p, key, kind, label, day=F.lit(None): df.select(F.concat(F.lit(p), F.col(key).cast("string")).alias("id"), F.lit(kind).alias("kind"), F.col(label).alias("label"), day.cast("date").alias("on_date"))
    out = row(people, "c", "c_custkey", "member", "c_name", F.col("on_date"))
    for name, p, key, kind, label in (("supplier", "s", "s_suppkey", "group", "s_name"), ("nation", "n", "n_nationkey", "party", "n_name"), ("part", "p", "p_partkey", "bill", "p_name")):
        out = out.unionByName(row(table(spark, sf, name), p, key, kind, label))
    return out


@query("d22_derived_group_totals", "select l_orderkey, l_suppkey, count(*) filter (where l_returnflag = 'A') as n_for, count(*) filter (where l_returnflag = 'R') as against, count(*) filter (where l_returnflag = 'N') as abstained, count(*) as present from lineitem where l_suppkey is not null group by 1, 2")
def d22(spark, sf):
    return A.group_totals(table(spark, sf, "lineitem"), ["l_orderkey", "l_suppkey"], "l_returnflag", {"n_for": "A", "against": "R", "abstained": "N"})


@query(
    "d23_agreement_with_group",
    """with v as (select l_orderkey, l_linenumber % 2 as grp, l_suppkey, l_returnflag as c from lineitem),
    t as (select l_orderkey, grp, count(*) filter (where c = 'A') as f, count(*) filter (where c = 'R') as a, count(*) filter (where c = 'N') as s from v group by 1, 2),
    r as (select l_suppkey, c, f - cast(c = 'A' as integer) as f, a - cast(c = 'R' as integer) as a, s - cast(c = 'N' as integer) as s from v join t using (l_orderkey, grp)),
    d as (select *, case when f > a and f > s then 'A' when a > f and a > s then 'R' when s > f and s > a then 'N' end as line from r where f + a + s >= 4)
    select l_suppkey, count(*) as compared, count(*) filter (where c = line) as agreed from d where line is not null group by 1""",
)
def d23(spark, sf):
    votes = table(spark, sf, "lineitem").withColumn("grp", F.col("l_linenumber") % 2)
    return A.agreement(votes, "l_orderkey", "grp", "l_suppkey", "l_returnflag", "A", "R", "N")


@query("d25_seats_at_start", f"with {LEG_SQL} select id, n_regionkey, count(distinct o_custkey) as seats from leg join orders on cast(o_orderdate as date) <= ls and date_add(cast(o_orderdate as date), interval 400 day) >= ls join customer on o_custkey = c_custkey join nation on c_nationkey = n_nationkey group by 1, 2")
def d25(spark, sf):
    day = F.to_date("o_orderdate")
    held = table(spark, sf, "orders").select("o_custkey", day.alias("s"), F.date_add(day, 400).alias("e"))
    sitting = held.join(F.broadcast(legislatures(spark)), T.active_on(F.col("s"), F.col("e"), F.col("ls")))
    people = table(spark, sf, "customer").join(table(spark, sf, "nation"), F.col("c_nationkey") == F.col("n_nationkey")).select(F.col("c_custkey").alias("o_custkey"), "n_regionkey")
    return sitting.join(people, "o_custkey").groupBy("id", "n_regionkey").agg(F.count_distinct("o_custkey").alias("seats"))


@query("d26_group_switches", "select o_custkey, greatest(count(distinct o_orderpriority) - 1, 0) as switches from orders group by 1")
def d26(spark, sf):
    return table(spark, sf, "orders").groupBy("o_custkey").agg(F.greatest(F.count_distinct("o_orderpriority") - 1, F.lit(0)).alias("switches"))


@query("d27_seniority_days", "select l_suppkey, cast(sum(greatest(least(greatest(cast(o_orderdate as date), cast(l_shipdate as date)), date '1999-12-31') - least(cast(o_orderdate as date), cast(l_shipdate as date)), 0)) as bigint) as days from lineitem join orders on l_orderkey = o_orderkey group by 1")
def d27(spark, sf):
    from tallyloom.plans.joins import periods

    today = F.lit("1999-12-31").cast("date")
    return periods(spark, sf).groupBy("l_suppkey").agg(F.sum(F.greatest(F.datediff(F.least("e", today), "s"), F.lit(0))).cast("long").alias("days"))


@query("d28_engagement_top", "select user_id, count(*) as views from events where event_type = 'view' and ts >= timestamp '2024-01-01' and ts < timestamp '2024-02-01' group by 1 order by 2 desc, 1 limit 5")
def d28(spark, sf):
    e = table(spark, sf, "events").where((F.col("event_type") == "view") & (F.date_trunc("month", "ts") == F.lit("2024-01-01").cast("timestamp_ntz")))
    return e.groupBy("user_id").agg(F.count("*").alias("views")).orderBy(F.desc("views"), "user_id").limit(5)


@query("d33_classes_by_pattern", "select case when regexp_matches(p_type, '(?i)brass|copper') then 'metal' when regexp_matches(p_type, '(?i)^standard') then 'standard' else 'other' end as class, count(*) as n from part group by 1")
def d33(spark, sf):
    c = F.when(F.col("p_type").rlike("(?i)brass|copper"), "metal").when(F.col("p_type").rlike("(?i)^standard"), "standard").otherwise("other")
    return table(spark, sf, "part").groupBy(c.alias("class")).agg(F.count("*").alias("n"))


@query("d34_coverage_status", "with n as (select o_orderstatus, count(*) as held, count(*) filter (where exists (select 1 from lineitem where l_orderkey = o_orderkey)) as nominal from orders group by 1) select *, case when nominal >= 0.99 * held then 'complete' else 'partial' end as status from n")
def d34(spark, sf):
    listed = table(spark, sf, "lineitem").select(F.col("l_orderkey").alias("o_orderkey")).distinct().withColumn("listed", F.lit(True))
    n = table(spark, sf, "orders").join(listed, "o_orderkey", "left").groupBy("o_orderstatus").agg(F.count("*").alias("held"), F.count("listed").alias("nominal"))
    return n.withColumn("status", F.when(F.col("nominal") >= 0.99 * F.col("held"), "complete").otherwise("partial"))


@query("d35_sequence_gap", "select o_orderstatus, max(o_orderkey) as highest, count(distinct o_orderkey) as held, max(o_orderkey) - count(distinct o_orderkey) as missing from orders group by 1")
def d35(spark, sf):
    return A.sequence_gap(table(spark, sf, "orders"), ["o_orderstatus"], "o_orderkey")


@query(
    "d37_vote_anomalies",
    """with n as (select l_orderkey, count(*) filter (where l_returnflag = 'A') as a, count(*) filter (where l_returnflag = 'R') as r from lineitem group by 1)
    select o_orderkey, choice, announced, named from (select o_orderkey, 'for' as choice, o_orderkey % 4 as announced, coalesce(a, 0) as named from orders left join n on l_orderkey = o_orderkey
    union all select o_orderkey, 'against', o_orderkey % 3, coalesce(r, 0) from orders left join n on l_orderkey = o_orderkey) where announced <> named""",
)
def d37(spark, sf):
    n = table(spark, sf, "lineitem").groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(F.count_if(F.col("l_returnflag") == "A").alias("a"), F.count_if(F.col("l_returnflag") == "R").alias("r"))
    all_ = table(spark, sf, "orders").select("o_orderkey").join(n, "o_orderkey", "left").fillna(0)
    long = all_.select("o_orderkey", F.expr("stack(2, 'for', o_orderkey % 4, a, 'against', o_orderkey % 3, r) as (choice, announced, named)"))
    return long.where("announced <> named")


@query("d38_conflict_preserving", "select l_orderkey, l_suppkey, case when count(distinct l_returnflag) = 1 then max(l_returnflag) else 'unknown' end as l_returnflag, case when count(distinct l_linestatus) = 1 then max(l_linestatus) end as l_linestatus, count(*) as rows from lineitem group by 1, 2")
def d38(spark, sf):
    return A.without_conflicts(table(spark, sf, "lineitem"), ["l_orderkey", "l_suppkey"], "l_returnflag", "l_linestatus")


@query("d39_mixed_grain", "with s as (select distinct l_suppkey, l_orderkey, l_orderkey % 100 as station from lineitem), a as (select l_suppkey, cast(sum(station) as bigint) as stations from s group by 1), b as (select l_suppkey, cast(sum(cast(l_quantity as bigint)) as bigint) as votes from lineitem group by 1) select * from a join b using (l_suppkey)")
def d39(spark, sf):
    line = table(spark, sf, "lineitem")
    per = line.groupBy("l_suppkey", "l_orderkey").agg(F.sum(F.col("l_quantity").cast("long")).alias("v"))
    return per.groupBy("l_suppkey").agg(F.sum(F.col("l_orderkey") % 100).alias("stations"), F.sum("v").alias("votes"))
