"""Joins (C): equi, as-of, overlap, clipping, theta, semi and anti, matching."""

from __future__ import annotations

from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tallyloom.operators import relational as R
from tallyloom.operators import sweep as S
from tallyloom.operators import temporal as T
from tallyloom.plans.registry import query
from tallyloom.session import spread, table

DAY = "cast({} as date)"
#: A line is a period between its order's date and its shipping date.
#: Rows of a task that sorts or groups lines: their bytes are few, so that adaptive execution would give it millions.
DEALT = 500_000
PERIODS = """periods as (
  select l_suppkey, l_orderkey, l_linenumber, o_orderstatus,
         least(cast(o_orderdate as date), cast(l_shipdate as date)) as s, greatest(cast(o_orderdate as date), cast(l_shipdate as date)) as e
  from lineitem join orders on l_orderkey = o_orderkey)"""


def periods(spark, sf):
    line = spread(table(spark, sf, "lineitem").select("l_orderkey", "l_suppkey", "l_linenumber", "l_shipdate"), "l_orderkey", most=DEALT)
    orders = table(spark, sf, "orders")
    o, s = F.to_date("o_orderdate"), F.to_date("l_shipdate")
    return line.join(orders, F.col("l_orderkey") == F.col("o_orderkey")).select("l_suppkey", "l_orderkey", "l_linenumber", "o_orderstatus", F.least(o, s).alias("s"), F.greatest(o, s).alias("e"))


@query("c01_inner_equi", "select r_name, n_name, count(*) as suppliers from supplier join nation on s_nationkey = n_nationkey join region on n_regionkey = r_regionkey group by 1, 2")
def c01(spark, sf):
    s, n, r = (table(spark, sf, t) for t in ("supplier", "nation", "region"))
    return s.join(n, s.s_nationkey == n.n_nationkey).join(r, n.n_regionkey == r.r_regionkey).groupBy("r_name", "n_name").agg(F.count("*").alias("suppliers"))


@query("c02_left_outer", "select c_custkey, count(o_orderkey) as ballots from customer left join orders on c_custkey = o_custkey group by 1")
def c02(spark, sf):
    mine = table(spark, sf, "orders").groupBy(F.col("o_custkey").alias("c_custkey")).agg(F.count("*").alias("n"))
    return table(spark, sf, "customer").select("c_custkey").join(mine, "c_custkey", "left").select("c_custkey", F.coalesce("n", F.lit(0)).alias("ballots"))


@query(
    "c03_asof_latest",
    f"""with {PERIODS}, facts as (select distinct l_suppkey, date '1997-06-01' + cast(l_suppkey % 400 as integer) as d from lineitem)
    select f.l_suppkey, f.d, p.l_orderkey, p.s from facts f left join lateral (
      select l_orderkey, s from periods p where p.l_suppkey = f.l_suppkey and p.s <= f.d and p.e >= f.d order by s desc, l_orderkey desc limit 1) p on true""",
)
def c03(spark, sf):
    """Which period of its owner held on a date: the latest one that covers it."""
    facts = table(spark, sf, "lineitem").select("l_suppkey").distinct().withColumn("d", F.date_add(F.lit("1997-06-01").cast("date"), (F.col("l_suppkey") % 400).cast("int")))
    mine = periods(spark, sf).select("l_suppkey", "l_orderkey", "s", "e")
    return T.asof_latest(facts, mine, "l_suppkey", "d", "s", "e", "l_orderkey", ["l_suppkey", "d"]).drop("e")


@query(
    "c03_asof_in_stream",
    """select event_id, user_id, last_value(case when event_type = 'purchase' then value end ignore nulls) over (partition by user_id order by ts, event_id rows between unbounded preceding and current row) as last_purchase from events""",
)
def c03_stream(spark, sf):
    events = table(spark, sf, "events")
    return T.asof_in_stream(events, "user_id", ["ts", "event_id"], F.when(F.col("event_type") == "purchase", F.col("value")), "last_purchase").select("event_id", "user_id", "last_purchase")


@query(
    "c04_latest_overlapping",
    f"""with {PERIODS}, m as (select l_suppkey, o_orderstatus, min(s) as ms, min(e) as me from periods group by 1, 2)
    select l_suppkey, o_orderstatus, l_orderkey, s from (
      select m.l_suppkey, m.o_orderstatus, p.l_orderkey, p.s, row_number() over (partition by m.l_suppkey, m.o_orderstatus order by p.s desc, p.l_orderkey desc, p.l_linenumber desc) as rn
      from m join periods p on p.l_suppkey = m.l_suppkey and p.o_orderstatus = m.o_orderstatus and p.s <= m.me and p.e >= m.ms) where rn = 1""",
)
def c04(spark, sf):
    p = periods(spark, sf)
    keys = ["l_suppkey", "o_orderstatus"]
    m = p.groupBy(*keys).agg(F.min("s").alias("ms"), F.min("e").alias("me"))
    hit = p.join(m, keys).where(T.overlaps(F.col("s"), F.col("e"), F.col("ms"), F.col("me")))
    return hit.groupBy(*keys).agg(F.max_by(F.struct("l_orderkey", "s"), F.struct("s", "l_orderkey", "l_linenumber")).alias("p")).select(*keys, "p.*")


@query("c05_latest_per_owner", "select o_custkey, o_orderkey from (select o_custkey, o_orderkey, row_number() over (partition by o_custkey order by o_orderdate desc, o_orderkey desc) as rn from orders) where rn = 1")
def c05(spark, sf):
    return table(spark, sf, "orders").groupBy("o_custkey").agg(F.max_by("o_orderkey", F.struct("o_orderdate", "o_orderkey")).alias("o_orderkey"))


LEGISLATURES = [(1, "1994-01-01", "1996-01-01"), (2, "1996-01-01", "1999-01-01"), (3, "1999-01-01", "2003-01-01")]
LEG_SQL = "leg(id, ls, le) as (values " + ", ".join(f"({i}, date '{a}', date '{b}')" for i, a, b in LEGISLATURES) + ")"


def legislatures(spark):
    return spark.createDataFrame(LEGISLATURES, "id int, ls string, le string").select("id", F.to_date("ls").alias("ls"), F.to_date("le").alias("le"))


@query("c06_asof_floor", f"with {LEG_SQL} select o_orderkey, (select max(id) from leg where ls <= cast(o_orderdate as date)) as id from orders")
def c06(spark, sf):
    orders = table(spark, sf, "orders").select("o_orderkey", F.to_date("o_orderdate").alias("d"))
    # The calendar of legislatures is a fixed list of three rows.
    hit = orders.join(F.broadcast(legislatures(spark)), F.col("ls") <= F.col("d"), "left")
    return hit.groupBy("o_orderkey").agg(F.max("id").alias("id"))


@query(
    "c07_overlap_inclusive",
    f"with {PERIODS}, m as (select l_suppkey, min(s) as ms, min(e) as me from periods group by 1) select l_suppkey, count(*) as n from m join periods p using (l_suppkey) where s <= me and e >= ms group by 1",
)
def c07(spark, sf):
    p = periods(spark, sf)
    m = p.groupBy("l_suppkey").agg(F.min("s").alias("ms"), F.min("e").alias("me"))
    return p.join(m, "l_suppkey").where(T.overlaps(F.col("s"), F.col("e"), F.col("ms"), F.col("me"))).groupBy("l_suppkey").agg(F.count("*").alias("n"))


SELF = "select a.l_suppkey, count(*) as pairs from p a join p b on a.l_suppkey = b.l_suppkey and a.id < b.id and {} group by 1"
EACH = f"with {PERIODS}, p as (select l_suppkey, l_orderkey * 100 + l_linenumber as id, min(s) as s, max(e) as e from periods group by 1, 2) "


def _pairs(spark, sf, condition):
    """Pairs of periods of one owner that share a day, met by buckets of time, and of these the ones that a condition holds for."""
    p = periods(spark, sf).groupBy("l_suppkey", (F.col("l_orderkey") * 100 + F.col("l_linenumber")).alias("id")).agg(F.unix_date(F.min("s")).alias("s"), F.unix_date(F.max("e")).alias("e"))
    met = S.overlapping_selves(p, "id", "s", "e", 256, ["l_suppkey"])
    return met.where(condition(*[F.col(c) for c in ("s", "e", "other_s", "other_e")])).groupBy("l_suppkey").agg(F.count("*").alias("pairs"))


@query("c08_overlap_strict_pairs", EACH + SELF.format("a.s < b.e and b.s < a.e"))
def c08(spark, sf):
    return _pairs(spark, sf, lambda s1, e1, s2, e2: (s1 < e2) & (s2 < e1))


@query("c09_overlap_over_31_days", EACH + SELF.format("least(a.e, b.e) - greatest(a.s, b.s) > 31"))
def c09(spark, sf):
    return _pairs(spark, sf, lambda s1, e1, s2, e2: F.least(e1, e2) - F.greatest(s1, s2) > 31)


@query(
    "c07_overlap_without_owner",
    """with w as (select event_id, user_id, event_type as kind, epoch(date_trunc('second', ts))::bigint as s, epoch(date_trunc('second', ts))::bigint + cast(floor(value * 60) as bigint) as e from events)
    select a.user_id, b.kind, count(*) as n, cast(sum(least(a.e, b.e) - greatest(a.s, b.s)) as bigint) as seconds from w a join w b
    on a.kind = 'purchase' and b.kind in ('error', 'signup') and a.s <= b.e and b.s <= a.e group by 1, 2""",
)
def c07_unkeyed(spark, sf):
    """Spans of purchases against all spans of errors and sign-ups, whoever's they are: nothing but time joins them."""
    second = F.unix_timestamp(F.col("ts").cast("timestamp"))
    w = table(spark, sf, "events").select("user_id", F.col("event_type").alias("kind"), second.alias("s"), (second + F.floor(F.col("value") * 60)).alias("e"))
    a = w.where("kind = 'purchase'").select("user_id", "s", "e")
    b = w.where("kind in ('error', 'signup')").select("kind", F.col("s").alias("bs"), F.col("e").alias("be"))
    return S.overlap_totals(a, b, ("s", "e"), ("bs", "be"), 3600, "kind").groupBy("user_id", "kind").agg(F.sum("n").alias("n"), F.sum("shared").alias("seconds"))


@query("c10_point_half_open", f"with {LEG_SQL} select id, o_orderstatus, count(*) as n from orders join leg on cast(o_orderdate as date) >= ls and cast(o_orderdate as date) < le group by 1, 2")
def c10(spark, sf):
    orders = table(spark, sf, "orders").select("o_orderstatus", F.to_date("o_orderdate").alias("d"))
    return orders.join(F.broadcast(legislatures(spark)), T.within_half_open(F.col("ls"), F.col("le"), F.col("d"))).groupBy("id", "o_orderstatus").agg(F.count("*").alias("n"))


@query(
    "c11_clip_three_ways",
    f"""with {LEG_SQL}, {PERIODS}, c as (select id, l_suppkey, greatest(s, ls, date '1996-06-01') as f, least(e, le, date '2000-06-01') as t from periods join leg on s < le and e >= ls)
    select id, l_suppkey, count(*) as n, cast(sum(t - f + 1) as bigint) as days from c where f <= t group by 1, 2""",
)
def c11(spark, sf):
    p = periods(spark, sf).join(F.broadcast(legislatures(spark)), (F.col("s") < F.col("le")) & (F.col("e") >= F.col("ls")))
    p = p.withColumns({"gs": F.lit("1996-06-01").cast("date"), "ge": F.lit("2000-06-01").cast("date")})
    return T.clip(p, ["s", "ls", "gs"], ["e", "le", "ge"]).groupBy("id", "l_suppkey").agg(F.count("*").alias("n"), F.sum(F.datediff("to", "from") + 1).alias("days"))


@query("c12_theta_joint", "with c(chamber) as (values ('F'), ('O')) select chamber, count(*) as n from orders join c on o_orderstatus = chamber or o_orderstatus = 'P' group by 1")
def c12(spark, sf):
    return R.explode_joint(table(spark, sf, "orders"), "o_orderstatus", "P", ["F", "O"]).groupBy(F.col("o_orderstatus").alias("chamber")).agg(F.count("*").alias("n"))


@query("c13_semi", "select count(*) as n from orders where exists (select 1 from lineitem where l_orderkey = o_orderkey and l_returnflag = 'R')")
def c13s(spark, sf):
    line = table(spark, sf, "lineitem").where("l_returnflag = 'R'").select(F.col("l_orderkey").alias("o_orderkey"))
    return table(spark, sf, "orders").join(line, "o_orderkey", "left_semi").agg(F.count("*").alias("n"))


@query("c13_anti", "select c_custkey from customer where not exists (select 1 from orders where o_custkey = c_custkey and o_orderstatus = 'P')")
def c13a(spark, sf):
    return table(spark, sf, "customer").select("c_custkey").join(table(spark, sf, "orders").where("o_orderstatus = 'P'").select(F.col("o_custkey").alias("c_custkey")), "c_custkey", "left_anti")


@query(
    "c14_best_source_wins",
    "select s_suppkey from supplier a where exists (select 1 from supplier b where a.s_nationkey % 5 = b.s_nationkey % 5 and b.s_suppkey <> a.s_suppkey and b.s_acctbal > a.s_acctbal)",
)
def c14(spark, sf):
    """Copies that a better-ranked row of the same key replaces; the rank of the key's best row spares the self-join."""
    s = table(spark, sf, "supplier")
    return s.withColumn("best", F.max("s_acctbal").over(W.partitionBy(F.col("s_nationkey") % 5))).where("s_acctbal < best").select("s_suppkey")


@query("c15_scalar_subquery", "select n_name, (select count(*) from customer where c_nationkey = n_nationkey) as people, (select s_name from supplier where s_nationkey = n_nationkey order by s_name limit 1) as first_name from nation")
def c15(spark, sf):
    people = table(spark, sf, "customer").groupBy(F.col("c_nationkey").alias("n_nationkey")).agg(F.count("*").alias("people"))
    first = table(spark, sf, "supplier").groupBy(F.col("s_nationkey").alias("n_nationkey")).agg(F.min("s_name").alias("first_name"))
    return table(spark, sf, "nation").join(people, "n_nationkey", "left").join(first, "n_nationkey", "left").select("n_name", F.coalesce("people", F.lit(0)).alias("people"), "first_name")


@query("c16_lateral_unnest", "with a as (select o_custkey, unnest(array_agg(o_orderkey)) as k from orders group by 1) select o_custkey, count(*) as n, count(l_orderkey) as with_lines from a left join (select distinct l_orderkey from lineitem) on k = l_orderkey group by 1")
def c16(spark, sf):
    packed = table(spark, sf, "orders").groupBy("o_custkey").agg(F.collect_list("o_orderkey").alias("ids"))
    line = table(spark, sf, "lineitem").select("l_orderkey").distinct()
    long = packed.select("o_custkey", F.explode_outer("ids").alias("k")).join(line, F.col("k") == F.col("l_orderkey"), "left")
    return long.groupBy("o_custkey").agg(F.count("*").alias("n"), F.count("l_orderkey").alias("with_lines"))


@query("c18_eligible_minus_present", "with e as (select o_custkey, count(*) as eligible from orders group by 1), p as (select o_custkey, count(*) as present from orders where o_orderstatus = 'F' group by 1) select o_custkey, greatest(0, eligible - coalesce(present, 0)) as absent from e left join p using (o_custkey)")
def c18(spark, sf):
    by = table(spark, sf, "orders").groupBy("o_custkey").agg(F.count("*").alias("e"), F.count_if(F.col("o_orderstatus") == "F").alias("p"))
    return by.select("o_custkey", F.greatest(F.lit(0), F.col("e") - F.col("p")).alias("absent"))


@query("c20_nested_children", "select n_name, count(s_suppkey) as n, string_agg(s_name, ',' order by s_name) as names from nation left join supplier on s_nationkey = n_nationkey group by 1")
def c20(spark, sf):
    kids = table(spark, sf, "supplier").groupBy(F.col("s_nationkey").alias("n_nationkey")).agg(F.count("*").alias("n"), F.array_join(F.sort_array(F.collect_list("s_name")), ",").alias("names"))
    return table(spark, sf, "nation").join(kids, "n_nationkey", "left").select("n_name", F.coalesce("n", F.lit(0)).alias("n"), "names")


@query("c21_unique_match", "select n_nationkey, case when count(distinct s_suppkey) = 1 then min(s_suppkey) end as s_suppkey from nation left join supplier on s_nationkey = n_nationkey group by 1")
def c21(spark, sf):
    probe = table(spark, sf, "nation").select("n_nationkey")
    return R.unique_match(probe, table(spark, sf, "supplier").withColumnRenamed("s_nationkey", "n_nationkey"), ["n_nationkey"], "s_suppkey")


@query("c22_alias_resolution", "select coalesce(c_custkey, -1) as c_custkey, count(*) as n from (select case when user_id % 10 = 3 then user_id - 3 else user_id end as id from events) left join customer on id = c_custkey group by 1")
def c22(spark, sf):
    """Retired ids lead to the row that took their place."""
    aliases = table(spark, sf, "events").select("user_id").distinct().where("user_id % 10 = 3").select("user_id", (F.col("user_id") - 3).alias("current"))
    events = table(spark, sf, "events").select("user_id").join(aliases, "user_id", "left").select(F.coalesce("current", "user_id").alias("c_custkey"))
    known = table(spark, sf, "customer").select("c_custkey", F.lit(True).alias("known"))
    return events.join(known, "c_custkey", "left").groupBy(F.when(F.col("known"), F.col("c_custkey")).otherwise(-1).alias("c_custkey")).agg(F.count("*").alias("n"))


@query("c23_contains_first_hit", "select doc_id, min(n_name) as n_name from documents, (select distinct lower(p_brand) as n_name from part union select lang from (values ('que'), ('the'), ('und')) t(lang)) where contains(lower(text), n_name) group by 1")
def c23(spark, sf):
    names = table(spark, sf, "part").select(F.lower("p_brand").alias("n_name")).distinct().unionByName(spark.createDataFrame([("que",), ("the",), ("und",)], "n_name string"))
    docs = table(spark, sf, "documents").select("doc_id", F.lower("text").alias("t"))
    return R.holding(docs, names, "t", "n_name").groupBy("doc_id").agg(F.min("n_name").alias("n_name"))


@query("c24_repoint_children", "with m as (select s_suppkey, min(s_suppkey) over (partition by s_nationkey) as keep from supplier) select coalesce(keep, l_suppkey) as l_suppkey, count(*) as n from lineitem left join m on l_suppkey = s_suppkey group by 1")
def c24(spark, sf):
    m = table(spark, sf, "supplier").select(F.col("s_suppkey").alias("l_suppkey"), F.min("s_suppkey").over(W.partitionBy("s_nationkey")).alias("keep"))
    return table(spark, sf, "lineitem").select("l_suppkey").join(m, "l_suppkey", "left").groupBy(F.coalesce("keep", "l_suppkey").alias("l_suppkey")).agg(F.count("*").alias("n"))


@query(
    "c25_misattribution_repair",
    f"""with {PERIODS}, seat as (select l_suppkey, min(s) as s, min(e) as e from periods group by 1), f as (select o_orderkey, o_orderkey % 10 as who, cast(o_orderdate as date) as d from orders)
    select o_orderkey from f where not exists (select 1 from seat where l_suppkey = who and s <= d and e >= d) and exists (select 1 from seat where l_suppkey = who + 1 and s <= d and e >= d)""",
)
def c25(spark, sf):
    seat = periods(spark, sf).groupBy("l_suppkey").agg(F.min("s").alias("s"), F.min("e").alias("e"))
    f = table(spark, sf, "orders").select("o_orderkey", (F.col("o_orderkey") % 10).alias("who"), F.to_date("o_orderdate").alias("d"))
    sits = lambda who: (F.col("l_suppkey") == who) & T.active_on(F.col("s"), F.col("e"), F.col("d"))
    return f.join(seat, sits(F.col("who")), "left_anti").join(seat, sits(F.col("who") + 1), "left_semi").select("o_orderkey")


@query(
    "c26_cascaded_place_match",
    """with p as (select c_custkey, c_nationkey, c_mktsegment from customer),
    a as (select s_nationkey, min(s_suppkey) as t from supplier group by 1 having count(*) = 1),
    b as (select s_nationkey % 5 as k, min(s_suppkey) as t from supplier group by 1 having count(*) = 1)
    select c_custkey, coalesce(a.t, b.t) as s_suppkey, case when a.t is not null then 'exact' when b.t is not null then 'loose' end as matched_by
    from p left join a on c_nationkey = s_nationkey left join b on c_nationkey % 5 = k""",
)
def c26(spark, sf):
    probe = table(spark, sf, "customer").select("c_custkey", F.col("c_nationkey").alias("exact"), (F.col("c_nationkey") % 5).alias("loose"))
    s = table(spark, sf, "supplier")
    stages = [("exact", s.select(F.col("s_nationkey").alias("exact"), "s_suppkey"), ["exact"]), ("loose", s.select((F.col("s_nationkey") % 5).alias("loose"), "s_suppkey"), ["loose"])]
    named = [(f"by_{n}", c, on) for n, c, on in stages]
    out = R.cascade(probe, named, "s_suppkey")
    return out.select("c_custkey", "s_suppkey", F.regexp_replace("matched_by", "^by_", "").alias("matched_by"))
