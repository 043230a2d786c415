"""Scans, lookups and sinks (A), further filters (B), joins (C), tallies (D), runs (E), paging (F), sets (G) and scalars (H)."""

from __future__ import annotations


from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tallyloom.functions import text as X
from tallyloom.operators import aggregates as A
from tallyloom.operators import quality as Q
from tallyloom.operators import relational as R
from tallyloom.operators import temporal as T
from tallyloom.plans.joins import DEALT, PERIODS, periods
from tallyloom.plans.registry import query
from tallyloom.session import scratch_folder, spread, table
from tallyloom.sources import readers


def _folder(spark, name: str) -> str:
    return scratch_folder(spark, name)


@query("a01_table_scan", "select r_regionkey, r_name from region")
def a01(spark, sf):
    return spark.read.schema("r_regionkey int, r_name string").parquet(f"{sf}/region.parquet")


@query("a02_point_lookup", "select c_custkey, c_name from customer where c_custkey = 7 or c_name = '7' limit 1")
def a02(spark, sf):
    return table(spark, sf, "customer").where((F.col("c_custkey") == 7) | (F.col("c_name") == "7")).select("c_custkey", "c_name").limit(1)


@query("a03_in_list", "select c_custkey, c_name from customer where c_custkey in (1, 5, 9, 700)")
def a03(spark, sf):
    return R.by_ids(table(spark, sf, "customer"), "c_custkey", [1, 5, 9, 700]).select("c_custkey", "c_name")


@query("a04_named_view", "select 'iv-' || l_orderkey || '-' || l_linenumber as id, o_orderstatus as vote, s_name as member from lineitem left join orders on o_orderkey = l_orderkey left join supplier on s_suppkey = l_suppkey")
def a04(spark, sf):
    """Compact rows of integer keys, read through a view that gives the public text ids back."""
    for name in ("lineitem", "orders", "supplier"):
        table(spark, sf, name).createOrReplaceTempView(f"stored_{name}")
    spark.sql("""create or replace temporary view named_votes as
        select concat('iv-', l_orderkey, '-', l_linenumber) as id, o_orderstatus as vote, s_name as member
        from stored_lineitem left join stored_orders on o_orderkey = l_orderkey left join stored_supplier on s_suppkey = l_suppkey""")
    return spark.table("named_votes")


@query("a05_delimited", "select n_nationkey, n_name, n_regionkey from nation")
def a05(spark, sf):
    """Nations written as `;`-separated lines with quoted names, and read back."""
    at = _folder(spark, "delimited")
    quoted = F.concat(F.lit('"'), F.replace("n_name", F.lit('"'), F.lit('""')), F.lit('"'))
    table(spark, sf, "nation").select(F.concat_ws(";", F.col("n_nationkey").cast("string"), quoted, F.col("n_regionkey").cast("string")).alias("value")).write.text(at)
    cell = lambda i: F.get("cells", F.lit(i))
    return readers.delimited(spark, at).select(cell(0).cast("int").alias("n_nationkey"), cell(1).alias("n_name"), cell(2).cast("int").alias("n_regionkey"))


@query("a18_full_rebuild", "select n_regionkey, count(*) as n from nation group by 1")
def a18(spark, sf):
    """A read model that is rebuilt over an older one; readers see one or the other."""
    at, nations = _folder(spark, "read-model"), table(spark, sf, "nation")
    readers.replace_folder(nations.groupBy("n_regionkey").agg(F.lit(0).cast("long").alias("n")), at)
    readers.replace_folder(nations.groupBy("n_regionkey").agg(F.count("*").alias("n")), at)
    return spark.read.parquet(at)


@query("a23_stale_delete", "select o_orderkey, o_orderstatus from orders where o_orderstatus <> 'F' or o_orderkey % 3 = 0")
def a23(spark, sf):
    held = table(spark, sf, "orders").select("o_orderkey", "o_orderstatus")
    return R.sync_partitions(held, held.where("o_orderstatus = 'F' and o_orderkey % 3 = 0"), "o_orderstatus")


@query("b08_not_exists", "select c_custkey from customer where not exists (select 1 from orders where o_custkey = c_custkey and o_orderkey % 10 = 0)")
def b08(spark, sf):
    large = table(spark, sf, "orders").where("o_orderkey % 10 = 0").select(F.col("o_custkey").alias("c_custkey"))
    return table(spark, sf, "customer").select("c_custkey").join(large, "c_custkey", "left_anti")


@query("b09_not_in", "select c_custkey from customer where c_nationkey not in (1, 2, 3)")
def b09(spark, sf):
    return table(spark, sf, "customer").where(~F.col("c_nationkey").isin(1, 2, 3)).select("c_custkey")


@query("b11_regex", "select p_partkey from part where regexp_matches(p_type, '(?i)(promo|small)$') and not regexp_matches(p_type, '^STANDARD')")
def b11(spark, sf):
    kind = F.col("p_type")
    return table(spark, sf, "part").where(kind.rlike("(?i)(promo|small)$") & ~kind.rlike("^STANDARD")).select("p_partkey")


@query(
    "b16_confidence",
    """select o_orderkey, case when o_orderkey % 7 = 0 then 'open_issue' when o_orderkey % 5 = 0 then 'missing' when o_orderkey % 11 = 0 then 'unsupported'
    when o_orderkey % 3 = 0 then 'accepted' when o_orderkey % 2 = 0 then 'stored' else 'parsed' end as label from orders""",
)
def b16(spark, sf):
    at = lambda n: F.col("o_orderkey") % n == 0
    return table(spark, sf, "orders").select("o_orderkey", Q.confidence(at(7), at(5), at(11), at(3), at(2)).alias("label"))


@query("c17_using", "select l_orderkey, o.total, count(*) as n from lineitem l join (select o_orderkey as l_orderkey, o_totalprice as total from orders) o using (l_orderkey) group by 1, 2")
def c17(spark, sf):
    totals = table(spark, sf, "orders").select(F.col("o_orderkey").alias("l_orderkey"), F.col("o_totalprice").alias("total"))
    counted = table(spark, sf, "lineitem").groupBy("l_orderkey").agg(F.count("*").alias("n"))
    return counted.join(totals, "l_orderkey").select("l_orderkey", "total", "n")


@query("c19_lookup", "select c_custkey, n_name from customer left join nation on n_nationkey = c_nationkey")
def c19(spark, sf):
    """A dimension looked up by id; Spark broadcasts it by its size."""
    names = table(spark, sf, "nation").select(F.col("n_nationkey").alias("c_nationkey"), "n_name")
    return table(spark, sf, "customer").join(names, "c_nationkey", "left").select("c_custkey", "n_name")


@query(
    "d24_absent",
    """with m as (select o_custkey as member, min(cast(o_orderdate as date)) as starts, min(cast(o_orderdate as date)) + 200 as ends from orders group by 1),
    e as (select member, count(o_orderkey) as eligible from m left join orders on cast(o_orderdate as date) between starts and ends group by 1),
    p as (select member, count(*) as present from m join orders on o_custkey = member and cast(o_orderdate as date) between starts and ends group by 1)
    select member, eligible, greatest(0, eligible - coalesce(present, 0)) as absent from e left join p using (member)""",
)
def d24(spark, sf):
    votes = table(spark, sf, "orders").select(F.col("o_custkey").alias("member"), F.to_date("o_orderdate").alias("day"))
    mandates = votes.groupBy("member").agg(F.min("day").alias("starts")).withColumn("ends", F.date_add("starts", 200))
    present = votes.join(mandates, "member").where(T.active_on(F.col("starts"), F.col("ends"), F.col("day"))).groupBy("member").agg(F.count("*").alias("present"))
    eligible = A.counted_between(mandates, votes, "day", "starts", "ends", "eligible")
    return eligible.join(present, "member", "left").select("member", "eligible", F.greatest(F.lit(0), F.col("eligible") - F.coalesce("present", F.lit(0))).alias("absent"))


@query(
    "d29_party_directory",
    """select r_name, string_agg(n_name, ', ' order by n_name) as labels, cast(sum(coalesce(seats, 0)) as bigint) as seats from region join nation on n_regionkey = r_regionkey
    left join (select s_nationkey, count(*) as seats from supplier group by 1) on s_nationkey = n_nationkey group by 1""",
)
def d29(spark, sf):
    seats = table(spark, sf, "supplier").groupBy(F.col("s_nationkey").alias("n_nationkey")).agg(F.count("*").alias("seats"))
    nations = table(spark, sf, "nation").join(seats, "n_nationkey", "left").withColumnRenamed("n_regionkey", "r_regionkey")
    by = nations.groupBy("r_regionkey").agg(F.array_join(F.sort_array(F.collect_list("n_name")), ", ").alias("labels"), F.sum(F.coalesce("seats", F.lit(0))).alias("seats"))
    return table(spark, sf, "region").join(by, "r_regionkey").select("r_name", "labels", "seats")


@query(
    "d30_government_index",
    f"""with {PERIODS} select s_nationkey, count(distinct l_suppkey) as people, count(distinct l_suppkey) filter (where o_orderstatus = 'F' and exists (
      select 1 from periods q where q.l_suppkey = p.l_suppkey and q.o_orderstatus = 'P' and q.s <= p.e and q.e >= p.s)) as with_seat
    from periods p join supplier on s_suppkey = l_suppkey group by 1""",
)
def d30(spark, sf):
    """People of each government, and those who held a seat while their role ran. Seats are merged first, so that the overlap join stays small."""
    p = periods(spark, sf).select("l_suppkey", "o_orderstatus", "s", "e")
    seats = T.coalesce_touching(p.where("o_orderstatus = 'P'"), ["l_suppkey"], "s", "e").select(F.col("l_suppkey").alias("who"), F.col("s").alias("s2"), F.col("e").alias("e2"))
    held = p.where("o_orderstatus = 'F'").join(seats, (F.col("l_suppkey") == F.col("who")) & T.overlaps(F.col("s"), F.col("e"), F.col("s2"), F.col("e2")), "left_semi").select("l_suppkey").distinct().withColumn("seat", F.lit(1))
    people = p.select("l_suppkey").distinct().join(held, "l_suppkey", "left").join(table(spark, sf, "supplier"), F.col("l_suppkey") == F.col("s_suppkey"))
    return people.groupBy("s_nationkey").agg(F.count("*").alias("people"), F.count("seat").alias("with_seat"))


@query("d31_county_options", "select c_mktsegment, count(*) as seats from customer group by 1 order by (c_mktsegment = 'MACHINERY'), c_mktsegment")
def d31(spark, sf):
    """Seats of each constituency, the special one last."""
    return table(spark, sf, "customer").groupBy("c_mktsegment").agg(F.count("*").alias("seats")).orderBy(F.col("c_mktsegment") == "MACHINERY", "c_mktsegment")


@query("d32_office_counts", "select user_id, count(*) filter (where event_type in ('view', 'click')) as appointed, count(*) filter (where event_type = 'purchase') as released, count(distinct event_type) as kinds from events group by 1")
def d32(spark, sf):
    kind = F.col("event_type")
    return table(spark, sf, "events").groupBy("user_id").agg(F.count_if(kind.isin("view", "click")).alias("appointed"), F.count_if(kind == "purchase").alias("released"), F.count_distinct("event_type").alias("kinds"))


@query(
    "d36_reading_stats",
    "select lang, count(*) as n, count(*) filter (where n_chars < 500) as short, count(*) filter (where exists (select 1 from labels l where l.doc_id = d.doc_id and quality = 1)) as good from documents d group by 1",
)
def d36(spark, sf):
    good = table(spark, sf, "labels").where("quality = 1").select("doc_id").distinct().withColumn("good", F.lit(1))
    docs = table(spark, sf, "documents").select("doc_id", "lang", "n_chars").join(good, "doc_id", "left")
    return docs.groupBy("lang").agg(F.count("*").alias("n"), F.count_if(F.col("n_chars") < 500).alias("short"), F.count("good").alias("good"))


@query(
    "e07_continuations",
    f"""with {PERIODS}, p as (select l_suppkey, o_orderstatus, s, least(e, s + 4) as e, row_number() over () as r from periods),
    a as (select *, max(e) over (partition by l_suppkey, o_orderstatus order by s, e, r rows between unbounded preceding and 1 preceding) as seen from p),
    b as (select *, sum(case when seen is null or s - seen > 0 then 1 else 0 end) over (partition by l_suppkey, o_orderstatus order by s, e, r rows unbounded preceding) as i from a)
    select l_suppkey, o_orderstatus, min(s) as s, max(e) as e, count(*) as merged from b group by l_suppkey, o_orderstatus, i""",
)
def e07(spark, sf):
    """Terms of one person in one capacity that follow one another without a day between."""
    p = periods(spark, sf).select("l_suppkey", "o_orderstatus", "s", F.least("e", F.date_add("s", 4)).alias("e"))
    p = spread(p, "l_suppkey", "o_orderstatus", most=DEALT, rows=table(spark, sf, "lineitem").count())
    return T.coalesce_touching(p, ["l_suppkey", "o_orderstatus"], "s", "e", gap_days=0)


@query("f01_keyset_top", "select o_orderkey, cast(o_orderdate as date) as d from orders order by 2 desc, 1 desc limit 11")
def f01(spark, sf):
    return R.keyset_page(table(spark, sf, "orders").select("o_orderkey", F.to_date("o_orderdate").alias("d")), "d", "o_orderkey", 10)


@query("f07_switchable_sort", "select c_custkey from customer left join (select o_custkey, count(*) as n from orders group by 1) on o_custkey = c_custkey order by n desc nulls last, c_name, c_custkey limit 50")
def f07(spark, sf):
    n = table(spark, sf, "orders").groupBy(F.col("o_custkey").alias("c_custkey")).agg(F.count("*").alias("n"))
    return R.sorted_by(table(spark, sf, "customer").join(n, "c_custkey", "left"), "n", True, ["c_name", "c_custkey"]).limit(50).select("c_custkey")


@query("g03_held", "select o_orderkey from orders where o_orderkey in (select l_orderkey from lineitem where l_returnflag = 'A')")
def g03(spark, sf):
    listed = table(spark, sf, "lineitem").where("l_returnflag = 'A'").select(F.col("l_orderkey").alias("o_orderkey"))
    return table(spark, sf, "orders").select("o_orderkey").join(listed, "o_orderkey", "left_semi")


@query("h01_fold_any", "select p_partkey, lower(trim(p_name)) as folded from part")
def h01(spark, sf):
    """Accents are put on and folded off again."""
    accented = F.translate(F.concat(F.lit(" "), "p_name"), "aeiou", "áèîöũ")
    return table(spark, sf, "part").select("p_partkey", X.fold_any(accented).alias("folded"))


@query("h13_inclusive_days", "select o_orderkey, cast(least(cast(o_orderdate as date) + 90, date '1998-01-01') - greatest(cast(o_orderdate as date), date '1995-01-01') + 1 as integer) as days from orders")
def h13(spark, sf):
    d = F.to_date("o_orderdate")
    at = lambda s: F.lit(s).cast("date")
    return table(spark, sf, "orders").select("o_orderkey", (F.datediff(F.least(F.date_add(d, 90), at("1998-01-01")), F.greatest(d, at("1995-01-01"))) + 1).alias("days"))


@query("h18_json", "select r_regionkey, to_json({'name': r_name, 'nations': list_sort(list(n_nationkey))}) as doc from region join nation on n_regionkey = r_regionkey group by r_regionkey, r_name")
def h18(spark, sf):
    n = table(spark, sf, "nation").groupBy(F.col("n_regionkey").alias("r_regionkey")).agg(F.sort_array(F.collect_list("n_nationkey")).alias("nations"))
    return table(spark, sf, "region").join(n, "r_regionkey").select("r_regionkey", F.to_json(F.struct(F.col("r_name").alias("name"), "nations")).alias("doc"))


@query(
    "h19_snippets",
    r"""with d as (select doc_id, text, string_split(lower(text), 'the') as p from documents where contains(lower(text), 'the')),
    h as (select doc_id, text, p, unnest(range(1, least(len(p), 6))) as k from d),
    a as (select doc_id, text, k, cast(list_sum([length(x) for x in p[1:k]]) as bigint) + (k - 1) * 3 as pos from h),
    s as (select doc_id, k, case when pos > 120 then '…' else '' end || trim(regexp_replace(substring(text, greatest(pos - 120, 0) + 1, least(pos + 163, length(text)) - greatest(pos - 120, 0)), '\s+', ' ', 'g'))
      || case when pos + 163 < length(text) then '…' else '' end as part from a)
    select doc_id, string_agg(part, ' || ' order by k) as snippets from s group by doc_id""",
)
def h19(spark, sf):
    """Up to five surroundings of a term in every text that holds it."""
    found = table(spark, sf, "documents").where(F.contains(F.lower("text"), F.lit("the"))).select("doc_id", X.found_snippets(F.col("text"), "the").alias("snippets"))
    return found.withColumn("snippets", F.array_join("snippets", " || "))


@query(
    "h20_map_metrics",
    """with v as (select l_suppkey, cast(year(l_shipdate) as integer) as y, sum(cast(l_quantity as bigint)) as votes, sum(cast(l_quantity as bigint)) filter (where l_returnflag = 'R') as invalid from lineitem group by 1, 2)
    select l_suppkey, y, coalesce(invalid, 0) / nullif(votes, 0) as invalid_share, votes - lag(votes) over (partition by l_suppkey order by y) as change from v""",
)
def h20(spark, sf):
    n = F.col("l_quantity").cast("long")
    v = table(spark, sf, "lineitem").groupBy("l_suppkey", F.year("l_shipdate").alias("y")).agg(F.sum(n).alias("votes"), F.sum(F.when(F.col("l_returnflag") == "R", n)).alias("invalid"))
    before = F.lag("votes").over(W.partitionBy("l_suppkey").orderBy("y"))
    return v.select("l_suppkey", "y", (F.coalesce("invalid", F.lit(0)) / F.nullif(F.col("votes"), F.lit(0))).alias("invalid_share"), (F.col("votes") - before).alias("change"))
