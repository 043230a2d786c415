"""Filters and paging (B), windows (E), sorts and limits (F), sets (G)."""

from __future__ import annotations

from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tallyloom.operators import aggregates as A
from tallyloom.operators import relational as R
from tallyloom.operators import temporal as T
from tallyloom.plans.joins import PERIODS, periods
from tallyloom.plans.registry import query
from tallyloom.session import table


@query("b01_dynamic_where", "select o_orderkey from orders where o_orderstatus = 'F' and o_totalprice > 1000 and cast(o_orderdate as date) >= date '1997-01-01' and cast(o_orderdate as date) < date '1998-01-01'")
def b01(spark, sf):
    day = F.to_date("o_orderdate")
    asked = {"status": "F", "least": 1000, "text": None}
    conditions = [F.col("o_orderstatus") == asked["status"], F.col("o_totalprice") > asked["least"], F.col("o_orderpriority").contains(asked["text"]) if asked["text"] else None, R.in_period(day, 1997, None)]
    return table(spark, sf, "orders").where(R.all_of(*conditions)).select("o_orderkey")


@query("b02_or_groups", "select s_suppkey from supplier where s_nationkey in (1, 7) or s_name like '%3'")
def b02(spark, sf):
    return table(spark, sf, "supplier").where(R.any_of(F.col("s_nationkey").isin(1, 7), F.col("s_name").like("%3"))).select("s_suppkey")


@query("b03_month_filter", "select count(*) as n from orders where cast(o_orderdate as date) >= date '1996-12-01' and cast(o_orderdate as date) < date '1997-01-01'")
def b03(spark, sf):
    return table(spark, sf, "orders").where(R.in_period(F.to_date("o_orderdate"), 1996, 12)).agg(F.count("*").alias("n"))


@query("b05_keyset_cursor", "select o_orderkey, cast(o_orderdate as date) as d from orders where cast(o_orderdate as date) < date '1998-06-01' or (cast(o_orderdate as date) = date '1998-06-01' and o_orderkey < 500) order by 2 desc, 1 desc limit 31")
def b05(spark, sf):
    df = table(spark, sf, "orders").select("o_orderkey", F.to_date("o_orderdate").alias("d"))
    return R.keyset_page(df, "d", "o_orderkey", 30, R.decode_cursor(R.encode_cursor("1998-06-01", 500)))


@query("b06_offset_page", "select o_orderkey from orders order by o_orderdate desc, o_orderkey limit 30 offset 60")
def b06(spark, sf):
    return table(spark, sf, "orders").orderBy(F.desc("o_orderdate"), "o_orderkey").offset(60).limit(30).select("o_orderkey")


@query("b07_exists_inequality", "select count(*) as n from orders o where exists (select 1 from lineitem where l_orderkey = o_orderkey and l_shipdate < o_orderdate)")
def b07(spark, sf):
    o, line = table(spark, sf, "orders"), table(spark, sf, "lineitem")
    return o.join(line, (o.o_orderkey == line.l_orderkey) & (line.l_shipdate < o.o_orderdate), "left_semi").agg(F.count("*").alias("n"))


@query("b10_ilike_json", "select count(*) as n from events where event_type ilike '%CLI%' and cast(props as varchar) ilike '%\"k\": 8%'")
def b10(spark, sf):
    return table(spark, sf, "events").where(F.col("event_type").ilike("%CLI%") & F.col("props").ilike('%"k": 8%')).agg(F.count("*").alias("n"))


@query("b12_json_key", "select cast(json_extract_string(props, '$.k') as integer) as k, count(*) as n from events where json_extract_string(props, '$.k') is not null group by 1")
def b12(spark, sf):
    k = F.from_json("props", "struct<k:int>")["k"]
    return table(spark, sf, "events").where(k.isNotNull()).groupBy(k.alias("k")).agg(F.count("*").alias("n"))


@query("b13_null_safe", "select c_custkey, nullif(c_mktsegment, 'BUILDING') as seg, c_mktsegment is distinct from 'BUILDING' as other from customer")
def b13(spark, sf):
    seg = F.nullif(F.col("c_mktsegment"), F.lit("BUILDING"))
    return table(spark, sf, "customer").select("c_custkey", seg.alias("seg"), (~F.col("c_mktsegment").eqNullSafe("BUILDING")).alias("other"))


@query("b14_all_terms", "select doc_id from documents where contains(lower(translate(text, 'ăâîșşțţĂÂÎȘŞȚŢ', 'aaissttAAISSTT')), 'the') and contains(lower(translate(text, 'ăâîșşțţĂÂÎȘŞȚŢ', 'aaissttAAISSTT')), 'tion')")
def b14(spark, sf):
    from tallyloom.functions.text import all_terms

    return table(spark, sf, "documents").where(all_terms(F.col("text"), F.lit("  The TION "))).select("doc_id")


@query("b15_enum_fallback", "select case when o_orderstatus in ('F', 'O') then o_orderstatus else 'unknown' end as status, count(*) as n from orders group by 1")
def b15(spark, sf):
    known = F.when(F.col("o_orderstatus").isin("F", "O"), F.col("o_orderstatus")).otherwise("unknown")
    return table(spark, sf, "orders").groupBy(known.alias("status")).agg(F.count("*").alias("n"))


@query("e01_latest_per_person", "select l_suppkey, l_orderkey from (select l_suppkey, l_orderkey, row_number() over (partition by l_suppkey order by l_shipdate desc, l_orderkey desc, l_linenumber desc) as rn from lineitem) where rn = 1")
def e01(spark, sf):
    return R.distinct_on(table(spark, sf, "lineitem"), ["l_suppkey"], F.desc("l_shipdate"), F.desc("l_orderkey"), F.desc("l_linenumber")).select("l_suppkey", "l_orderkey")


@query("e02_survivor_map", "select p_partkey as old, first_value(p_partkey) over (partition by p_brand, p_size order by (p_type like 'STANDARD%') desc, p_partkey) as survivor from part")
def e02(spark, sf):
    w = W.partitionBy("p_brand", "p_size").orderBy(F.col("p_type").like("STANDARD%").desc(), "p_partkey")
    return table(spark, sf, "part").select(F.col("p_partkey").alias("old"), F.first("p_partkey").over(w).alias("survivor"))


@query(
    "e03_runs",
    """with a as (select user_id, event_type, event_id, ts, case when lag(event_type) over w is distinct from event_type then 1 else 0 end as n from events window w as (partition by user_id order by ts, event_id)),
    b as (select *, sum(n) over (partition by user_id order by ts, event_id rows unbounded preceding) as run from a)
    select user_id, cast(run as bigint) as run, event_type, min(ts) as first, max(ts) as last, count(*) as n from b group by 1, 2, 3""",
)
def e03(spark, sf):
    return A.islands(table(spark, sf, "events"), ["user_id"], ["ts", "event_id"], "event_type")


@query("e04_rank_winner", "select l_suppkey, l_orderkey, l_quantity from (select *, rank() over (partition by l_suppkey order by l_quantity desc) as rk from lineitem) where rk = 1")
def e04(spark, sf):
    top = F.rank().over(W.partitionBy("l_suppkey").orderBy(F.desc("l_quantity")))
    return table(spark, sf, "lineitem").withColumn("rk", top).where("rk = 1").select("l_suppkey", "l_orderkey", "l_quantity")


@query(
    "e05_neighbour_fill",
    """with v as (select event_id, user_id, ts, case when event_id % 3 <> 0 then event_type end as s from events),
    a as (select *, last_value(s ignore nulls) over (partition by user_id order by ts, event_id rows between unbounded preceding and 1 preceding) as p,
      first_value(s ignore nulls) over (partition by user_id order by ts, event_id rows between 1 following and unbounded following) as q from v)
    select event_id, coalesce(s, case when p = q then p end) as signer from a""",
)
def e05(spark, sf):
    v = table(spark, sf, "events").withColumn("s", F.when(F.col("event_id") % 3 != 0, F.col("event_type")))
    return A.neighbour_fill(v, ["user_id"], ["ts", "event_id"], "s", "signer").select("event_id", "signer")


@query(
    "e06_coalesce_touching",
    f"""with {PERIODS}, p as (select l_suppkey, s, least(e, s + cast(l_orderkey % 20 as integer)) as e, row_number() over () as r from periods),
    a as (select *, max(e) over (partition by l_suppkey order by s, e, r rows between unbounded preceding and 1 preceding) as seen from p),
    b as (select *, sum(case when seen is null or s - seen > 1 then 1 else 0 end) over (partition by l_suppkey order by s, e, r rows unbounded preceding) as i from a)
    select l_suppkey, min(s) as s, max(e) as e, count(*) as merged from b group by l_suppkey, i""",
)
def e06(spark, sf):
    p = periods(spark, sf).select("l_suppkey", "s", F.least("e", F.date_add("s", (F.col("l_orderkey") % 20).cast("int"))).alias("e"))
    return T.coalesce_touching(p, ["l_suppkey"], "s", "e")


@query(
    "e08_boundary_from_neighbour",
    """select event_id, coalesce(case when event_id % 4 <> 0 then cast(ts as date) end, least(lead(cast(ts as date)) over w, date '2024-01-25')) as ends_on from events window w as (partition by user_id order by ts, event_id)""",
)
def e08(spark, sf):
    """A missing end is the start of the next row, no later than the mandate's end."""
    w = W.partitionBy("user_id").orderBy("ts", "event_id")
    own, after = F.when(F.col("event_id") % 4 != 0, F.to_date("ts")), F.lead(F.to_date("ts")).over(w)
    return table(spark, sf, "events").select("event_id", F.coalesce(own, F.least(after, F.lit("2024-01-25").cast("date"))).alias("ends_on"))


@query("e09_leader_and_lead", "with n as (select l_suppkey, l_returnflag, count(*) as n from lineitem group by 1, 2), r as (select *, row_number() over (partition by l_suppkey order by n desc, l_returnflag) as rn from n) select a.l_suppkey, a.l_returnflag as leader, a.n - coalesce(b.n, 0) as lead from (select * from r where rn = 1) a left join (select * from r where rn = 2) b on a.l_suppkey = b.l_suppkey")
def e09(spark, sf):
    n = table(spark, sf, "lineitem").groupBy("l_suppkey", "l_returnflag").agg(F.count("*").alias("n"))
    ranked = F.sort_array(F.collect_list(F.struct((-F.col("n")).alias("m"), "l_returnflag")))
    by = n.groupBy("l_suppkey").agg(ranked.alias("r"))
    return by.select("l_suppkey", F.get("r", F.lit(0))["l_returnflag"].alias("leader"), (F.coalesce(F.get("r", F.lit(1))["m"], F.lit(0)) - F.get("r", F.lit(0))["m"]).alias("lead"))


@query("f02_nulls_last", "select c_custkey from customer left join (select o_custkey, max(o_orderdate) as d from orders where o_orderstatus = 'P' group by 1) on o_custkey = c_custkey order by d desc nulls last, c_custkey limit 20")
def f02(spark, sf):
    d = table(spark, sf, "orders").where("o_orderstatus = 'P'").groupBy(F.col("o_custkey").alias("c_custkey")).agg(F.max("o_orderdate").alias("d"))
    return table(spark, sf, "customer").select("c_custkey").join(d, "c_custkey", "left").orderBy(F.desc_nulls_last("d"), "c_custkey").limit(20).select("c_custkey")


@query("f03_distinct", "select distinct l_suppkey, l_returnflag from lineitem")
def f03(spark, sf):
    return table(spark, sf, "lineitem").select("l_suppkey", "l_returnflag").distinct()


@query("f04_distinct_on", "select distinct on (c_nationkey) c_nationkey, c_custkey from customer order by c_nationkey, c_acctbal desc, c_custkey")
def f04(spark, sf):
    return table(spark, sf, "customer").groupBy("c_nationkey").agg(F.min_by("c_custkey", F.struct(-F.col("c_acctbal"), "c_custkey")).alias("c_custkey"))


@query("f05_weighted_sort", "select o_orderkey from orders order by case o_orderstatus when 'P' then 0 when 'O' then 1 else 2 end, o_totalprice desc, o_orderkey limit 25")
def f05(spark, sf):
    weight = F.when(F.col("o_orderstatus") == "P", 0).when(F.col("o_orderstatus") == "O", 1).otherwise(2)
    return table(spark, sf, "orders").orderBy(weight, F.desc("o_totalprice"), "o_orderkey").limit(25).select("o_orderkey")


@query("f06_seeded_sample", "select o_orderkey from orders order by md5(cast(o_orderkey as varchar) || 'seed'), o_orderkey limit 7")
def f06(spark, sf):
    return table(spark, sf, "orders").orderBy(F.md5(F.concat(F.col("o_orderkey").cast("string"), F.lit("seed"))), "o_orderkey").limit(7).select("o_orderkey")


@query("f08_first_wins", "select l_orderkey, l_suppkey, min(l_linenumber) as l_linenumber from lineitem group by 1, 2")
def f08(spark, sf):
    return table(spark, sf, "lineitem").groupBy("l_orderkey", "l_suppkey").agg(F.min("l_linenumber").alias("l_linenumber"))


@query("f09_priority_pick", "select k, min(p) as priority from (select c_custkey as k, 0 as p from customer where c_acctbal > 9000 union all select o_custkey, 1 from orders where o_totalprice > 300000 union all select c_custkey, 2 from customer) group by 1 order by 2, 1 limit 40")
def f09(spark, sf):
    c, o = table(spark, sf, "customer"), table(spark, sf, "orders")
    return R.priority_pick([c.where("c_acctbal > 9000").select(F.col("c_custkey").alias("k")), o.where("o_totalprice > 300000").select(F.col("o_custkey").alias("k")), c.select(F.col("c_custkey").alias("k"))], "k", 40)


@query("g01_union_all", "select 'group' as kind, s_nationkey as k, count(*) as n from supplier group by 2 union all select 'person', c_nationkey, count(*) from customer group by 2")
def g01(spark, sf):
    part = lambda t, k, kind: table(spark, sf, t).groupBy(F.col(k).alias("k")).agg(F.count("*").alias("n")).select(F.lit(kind).alias("kind"), "k", "n")
    return part("supplier", "s_nationkey", "group").unionByName(part("customer", "c_nationkey", "person"))


@query("g02_missing", "select o_orderkey from orders where o_orderkey not in (select l_orderkey from lineitem where l_returnflag = 'A')")
def g02(spark, sf):
    held = table(spark, sf, "lineitem").where("l_returnflag = 'A'").select(F.col("l_orderkey").alias("o_orderkey"))
    return table(spark, sf, "orders").select("o_orderkey").join(held, "o_orderkey", "left_anti")


@query(
    "g04_reconciliation",
    """with o as (select o_orderkey as k, cast(o_orderdate as date) as d, o_orderkey % 5 as total from orders where o_orderkey % 7 <> 0),
    h as (select o_orderkey as k, cast(o_orderdate as date) + case when o_orderkey % 11 = 0 then 1 else 0 end as d, o_orderkey % 6 as total from orders where o_orderkey % 9 <> 0)
    select coalesce(o.k, h.k) as k, case when h.k is null then 'missing' when o.k is null then 'not_listed' when o.d <> h.d or o.total <> h.total then 'differs' else 'held' end as status,
    case when o.k is null or h.k is null then '' when o.d <> h.d and o.total <> h.total then 'd,total' when o.d <> h.d then 'd' when o.total <> h.total then 'total' else '' end as differs
    from o full join h on o.k = h.k""",
)
def g04(spark, sf):
    base = table(spark, sf, "orders").select(F.col("o_orderkey").alias("k"), F.to_date("o_orderdate").alias("d"))
    official = base.where("k % 7 <> 0").withColumn("total", F.col("k") % 5)
    held = base.where("k % 9 <> 0").select("k", F.date_add("d", F.when(F.col("k") % 11 == 0, 1).otherwise(0)).alias("d"), (F.col("k") % 6).alias("total"))
    return R.reconcile(official, held, ["k"], ["d", "total"])
