"""Saved pages as tables (A08): cells on the grid, records by header, ballots of nominal votes."""

from __future__ import annotations

from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tallyloom.plans.registry import query
from tallyloom.session import table
from tallyloom.sources import tables

LINES = """l as (select l_orderkey as page_id, l_suppkey, s_name as name, n_name as grp, l_returnflag, l_linenumber,
      row_number() over (partition by l_orderkey order by n_name, l_suppkey, l_linenumber, l_partkey, l_extendedprice) as number
    from lineitem join supplier on s_suppkey = l_suppkey join nation on n_nationkey = s_nationkey),
  b as (select *, case when l_returnflag = 'A' then 'DA' when l_returnflag = 'N' then 'NU' when l_linenumber % 2 = 0 then '-' else 'Abținere' end as vote,
      case when l_returnflag = 'A' then 'for' when l_returnflag = 'N' then 'against' when l_linenumber % 2 = 0 then 'present_not_voting' else 'abstention' end as choice from l)"""


def vote_pages(spark, sf):
    """A nominal vote page of each order, as an official site prints it: a layout table, totals, and a table of numbered rows whose group
    stands once for all rows that it has. Every fiftieth page announces one vote in favour too many."""
    key = ["l_orderkey"]
    line = table(spark, sf, "lineitem").join(table(spark, sf, "supplier"), F.col("s_suppkey") == F.col("l_suppkey")).join(table(spark, sf, "nation"), F.col("n_nationkey") == F.col("s_nationkey"))
    number = F.row_number().over(W.partitionBy(*key).orderBy("n_name", "l_suppkey", "l_linenumber", "l_partkey", "l_extendedprice"))
    vote = F.when(F.col("l_returnflag") == "A", "DA").when(F.col("l_returnflag") == "N", "NU").when(F.col("l_linenumber") % 2 == 0, "-").otherwise("Abținere")
    line = line.select("l_orderkey", "l_suppkey", "s_name", "n_name", number.alias("number"), vote.alias("vote"))
    mine = W.partitionBy("l_orderkey", "n_name")
    group = F.when(F.col("number") == F.min("number").over(mine), F.concat(F.lit('<td rowspan="'), F.count("*").over(mine), F.lit('">'), "n_name", F.lit("</td>"))).otherwise("")
    link = F.concat(F.lit('<a href="/pls/parlam/structura2015.mp?idm='), "l_suppkey", F.lit('&amp;cam=2&amp;leg=2024">'), "s_name", F.lit("</a>"))
    row = F.concat(F.lit("<tr><td>"), "number", F.lit(".</td><td>"), link, F.lit("</td>"), group, F.lit("<td>"), "vote", F.lit("</td></tr>"))
    count = lambda v: F.count_if(F.col("vote") == v).cast("long")
    page = line.withColumn("html", row).groupBy("l_orderkey").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("number", "html"))), lambda x: x["html"]), "").alias("rows"), count("DA").alias("yes"), count("NU").alias("no"), count("Abținere").alias("held"), count("-").alias("silent"))
    yes = F.col("yes") + F.when(F.col("l_orderkey") % 50 == 0, 1).otherwise(0)
    totals = F.concat(F.lit("Pentru (DA): "), yes, F.lit(" Contra (NU): "), "no", F.lit(" Abtineri (AB): "), "held", F.lit(" Nu au votat (-): "), "silent")
    head = "<table><thead><tr><th>Nr.</th><th>Nume si prenume</th><th>Grup</th><th>Vot</th></tr></thead><tbody>"
    html = F.concat(F.lit("<html><body><table><tr><td>Meniu</td><td><p>"), totals, F.lit("</p>" + head), "rows", F.lit("</tbody></table></td></tr></table></body></html>"))
    return page.select(F.col("l_orderkey").alias("page_id"), html.alias("html"))


TOTALS_SQL = """t as (select page_id, count(*) filter (where choice = 'for') + case when page_id % 50 = 0 then 1 else 0 end as yes, count(*) filter (where choice = 'against') as no,
      count(*) filter (where choice = 'abstention') as held, count(*) filter (where choice = 'present_not_voting') as silent from b group by 1)"""


@query(
    "a08_table_cells",
    f"""with {LINES}, {TOTALS_SQL}
    select page_id, 0 as "table", 0 as "row", unnest([0, 1]) as "column", unnest(['Meniu', 'Pentru (DA): ' || yes || ' Contra (NU): ' || no || ' Abtineri (AB): ' || held || ' Nu au votat (-): ' || silent]) as text from t
    union all select page_id, 1, 0, unnest([0, 1, 2, 3]), unnest(['Nr.', 'Nume si prenume', 'Grup', 'Vot']) from t
    union all select page_id, 1, cast(number as int), unnest([0, 1, 2, 3]), unnest([number || '.', name, grp, vote]) from b""",
)
def a08_cells(spark, sf):
    """What stands at every place of the grids of all written vote pages, spans filled."""
    return tables.places(vote_pages(spark, sf))


@query("a08_ballots", f"""with {LINES} select page_id, 'member-deputies-' || l_suppkey as member_id, name, grp as "group", choice from b""")
def a08_ballots(spark, sf):
    """Ballots read back from the written vote pages."""
    return tables.page_ballots(vote_pages(spark, sf))


@query("a08_records", f"""with {LINES} select page_id, cast(number as int) as "row", name, grp as "group", vote from b""")
def a08_records(spark, sf):
    """The rows of the ballots' tables by their headers."""
    found = tables.page_records(vote_pages(spark, sf))
    return found.select("page_id", "row", F.col("record")["Nume si prenume"].alias("name"), F.col("record")["Grup"].alias("group"), F.col("record")["Vot"].alias("vote"))


@query("a08_ballot_gaps", f"""with {LINES}, {TOTALS_SQL} select page_id, 'for' as choice, yes - 1 as read, yes as announced from t where page_id % 50 = 0""")
def a08_gaps(spark, sf):
    """Pages whose ballots do not add up to what they announce."""
    return tables.page_gaps(vote_pages(spark, sf))
