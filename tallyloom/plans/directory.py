"""Vote and record directories: filters, keyset paging and a per-group breakdown."""

from __future__ import annotations

from pyspark.sql import functions as F

from tallyloom.plans.registry import query
from tallyloom.session import table


@query(
    "vote_directory",
    """
    with page as (
      select o_orderkey, o_orderstatus, cast(o_orderdate as date) as held_on from orders
      where o_orderdate >= timestamp '1996-01-01' and o_orderdate < timestamp '1997-01-01'
      order by 3 desc, 1 desc limit 11
    ), groups as (
      select l_orderkey, n_name, count(*) as total,
             count(*) filter (where l_returnflag = 'A') as n_for
      from lineitem join supplier on l_suppkey = s_suppkey join nation on s_nationkey = n_nationkey
      where l_orderkey in (select o_orderkey from page)
      group by 1, 2
    )
    select o_orderkey, o_orderstatus, held_on, n_name as group_name, total, n_for
    from page left join groups on o_orderkey = l_orderkey
    """,
)
def vote_directory(spark, sf_dir):
    """One page of ballots (newest first, one extra row to tell that more follow) with the tally of each group."""
    orders = table(spark, sf_dir, "orders")
    page = (
        orders.where((F.col("o_orderdate") >= F.lit("1996-01-01").cast("timestamp_ntz")) & (F.col("o_orderdate") < F.lit("1997-01-01").cast("timestamp_ntz")))
        .select("o_orderkey", "o_orderstatus", F.to_date("o_orderdate").alias("held_on"))
        .orderBy(F.desc("held_on"), F.desc("o_orderkey"))
        .limit(11)
    )
    groups = (
        table(spark, sf_dir, "lineitem")
        .join(F.broadcast(page.select(F.col("o_orderkey").alias("l_orderkey"))), "l_orderkey", "left_semi")
        .join(table(spark, sf_dir, "supplier"), F.col("l_suppkey") == F.col("s_suppkey"))
        .join(table(spark, sf_dir, "nation"), F.col("s_nationkey") == F.col("n_nationkey"))
        .groupBy("l_orderkey", F.col("n_name").alias("group_name"))
        .agg(F.count("*").alias("total"), F.count_if(F.col("l_returnflag") == "A").alias("n_for"))
    )
    return page.join(groups, F.col("o_orderkey") == F.col("l_orderkey"), "left").drop("l_orderkey")
