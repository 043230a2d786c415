"""Pages of the site as queries over all their subjects at once (N): votes, bills, members, parties, ministries, missions, questions, leadership, motions.

Stand-ins: an order is a vote or a bill's step, a line a ballot (supplier: member, nation: group, return flag: choice), a customer a bill, an event a decree or a question.
"""

from __future__ import annotations

from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tallyloom.operators import aggregates as A
from tallyloom.operators import government as G
from tallyloom.operators import identity as I
from tallyloom.operators import relational as R
from tallyloom.operators import temporal as T
from tallyloom.operators import text_index as X
from tallyloom.plans.joins import DEALT, LEG_SQL, PERIODS, legislatures, periods
from tallyloom.plans.people import I12_SQL
from tallyloom.plans.registry import query
from tallyloom.session import scratch_folder, spread, table

CHOICES = {"n_for": "A", "n_against": "R", "n_other": "N"}
BALLOTS = """ballots as (select l_orderkey as vote, l_suppkey as member, s_nationkey as grp, case when min(l_returnflag) = max(l_returnflag) then min(l_returnflag) else 'X' end as choice
  from lineitem join supplier on s_suppkey = l_suppkey group by 1, 2, 3)"""


def ballots(spark, sf):
    """One ballot for each vote and member; choices that conflict count as unknown (X)."""
    line = spread(table(spark, sf, "lineitem").select("l_orderkey", "l_suppkey", "l_returnflag"), "l_orderkey", most=DEALT)  # all that goes by vote stays there
    line = A.without_conflicts(line.withColumn("none", F.lit("")), ["l_orderkey", "l_suppkey"], "l_returnflag", "none", "X")
    seats = table(spark, sf, "supplier").select(F.col("s_suppkey").alias("l_suppkey"), F.col("s_nationkey").alias("grp"))
    return line.join(seats, "l_suppkey").select(F.col("l_orderkey").alias("vote"), F.col("l_suppkey").alias("member"), "grp", F.col("l_returnflag").alias("choice"))


@query(
    "n_vote_page",
    f"""with {BALLOTS}, g as (select vote, grp, count(*) filter (where choice = 'A') as f, count(*) filter (where choice = 'R') as a, count(*) as n from ballots group by 1, 2),
    t as (select vote, cast(sum(f) as bigint) as n_for, cast(sum(a) as bigint) as n_against, cast(sum(n) as bigint) as present, count(*) as groups,
      string_agg(grp || ':' || f || '-' || a || '/' || n, ' ' order by n desc, grp) as by_group from g group by 1)
    select o_orderkey as vote, cast(o_orderdate as date) as held_on, coalesce(n_for, 0) as n_for, coalesce(n_against, 0) as n_against, coalesce(present, 0) as present, coalesce(groups, 0) as groups, by_group,
      case when coalesce(n_for, 0) > coalesce(n_against, 0) then 'for' when coalesce(n_for, 0) < coalesce(n_against, 0) then 'against' else 'tie' end as leading,
      coalesce(present, 0) <> o_orderkey % 5 as differs from orders left join t on vote = o_orderkey""",
)
def vote_page(spark, sf):
    """Each vote with its tally, its groups (largest first) and whether the announced total differs."""
    g = A.group_totals(ballots(spark, sf), ["vote", "grp"], "choice", CHOICES)
    told = F.array_sort(F.collect_list(F.struct((-F.col("present")).alias("m"), "grp", F.concat(F.col("grp").cast("string"), F.lit(":"), F.col("n_for").cast("string"), F.lit("-"), F.col("n_against").cast("string"), F.lit("/"), F.col("present").cast("string")).alias("t"))))
    by = g.groupBy("vote").agg(*[F.sum(c).alias(c) for c in ("n_for", "n_against", "present")], F.count("*").alias("groups"), F.array_join(F.transform(told, lambda x: x["t"]), " ").alias("by_group"))
    votes = table(spark, sf, "orders").select(F.col("o_orderkey").alias("vote"), F.to_date("o_orderdate").alias("held_on")).join(by, "vote", "left").fillna(0, ["n_for", "n_against", "present", "groups"])
    leading = F.when(F.col("n_for") > F.col("n_against"), "for").when(F.col("n_for") < F.col("n_against"), "against").otherwise("tie")
    return votes.withColumns({"leading": leading, "differs": F.col("present") != F.col("vote") % 5})


@query(
    "n_bill_page",
    """with s as (select o_custkey as bill, o_orderkey as step, cast(o_orderdate as date) as d, o_orderstatus as kind, o_orderpriority as body from orders),
    b as (select bill, count(*) as steps, min(d) as first_on, max(d) as last_on, arg_max(kind, (d, step)) as last_kind, count(distinct body) as bodies, count(*) filter (where kind = 'F') as decisions,
      string_agg(kind, '' order by d, step) as course, count(*) filter (where d >= date '1999-01-01') as recent from s group by 1)
    select c_custkey as bill, c_name as title, coalesce(steps, 0) as steps, first_on, last_on, last_kind, coalesce(bodies, 0) as bodies, coalesce(decisions, 0) as decisions, course, coalesce(recent, 0) as recent from customer left join b on bill = c_custkey""",
)
def bill_page(spark, sf):
    """Each bill with the course of its steps, the bodies they name and what came last."""
    s = table(spark, sf, "orders").select(F.col("o_custkey").alias("bill"), F.col("o_orderkey").alias("step"), F.to_date("o_orderdate").alias("d"), F.col("o_orderstatus").alias("kind"), F.col("o_orderpriority").alias("body"))
    at = F.struct("d", "step")
    course = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("d", "step", "kind"))), lambda x: x["kind"]), "")
    by = s.groupBy("bill").agg(
        F.count("*").alias("steps"), F.min("d").alias("first_on"), F.max("d").alias("last_on"), F.max_by("kind", at).alias("last_kind"), F.size(F.collect_set("body")).cast("long").alias("bodies"),
        F.count_if(F.col("kind") == "F").alias("decisions"), course.alias("course"), F.count_if(F.col("d") >= F.lit("1999-01-01").cast("date")).alias("recent"),
    )
    return table(spark, sf, "customer").select(F.col("c_custkey").alias("bill"), F.col("c_name").alias("title")).join(by, "bill", "left").fillna(0, ["steps", "bodies", "decisions", "recent"])


@query(
    "n_member_page",
    f"""with {BALLOTS}, {PERIODS}, {LEG_SQL}, g as (select vote, grp, count(*) filter (where choice = 'A') as f, count(*) filter (where choice = 'R') as a, count(*) filter (where choice = 'N') as s from ballots group by 1, 2),
    v as (select member, choice, f - (choice = 'A')::int as f, a - (choice = 'R')::int as a, s - (choice = 'N')::int as s from ballots join g using (vote, grp)),
    l as (select member, choice, case when f > a and f > s then 'A' when a > f and a > s then 'R' when s > f and s > a then 'N' end as line from v where f + a + s >= 1),
    q as (select member, count(*) filter (where line is not null) as compared, count(*) filter (where choice = line) as agreed from l group by 1),
    n as (select member, count(*) as votes, count(*) filter (where choice = 'A') as n_for from ballots group by 1),
    d as (select l_suppkey as member, cast(sum(case when s < le and e >= ls then 1 else 0 end) as bigint) as terms, min(s) as since, max(e) as until from periods cross join leg where id = 2 group by 1)
    select s_suppkey as member, s_name as name, s_nationkey as grp, votes, n_for, coalesce(compared, 0) as compared, coalesce(agreed, 0) as agreed, terms, since, until from supplier join n on n.member = s_suppkey left join q on q.member = s_suppkey join d on d.member = s_suppkey""",
)
def member_page(spark, sf):
    """Each member with votes, how often the vote was that of the other members of the group, and the periods that touch a legislature."""
    b = ballots(spark, sf)
    n = b.groupBy("member").agg(F.count("*").alias("votes"), F.count_if(F.col("choice") == "A").alias("n_for"))
    q = A.agreement(b, "vote", "grp", "member", "choice", "A", "R", "N", least=1)
    leg = legislatures(spark).where("id = 2")
    touched = (F.col("s") < F.col("le")) & (F.col("e") >= F.col("ls"))
    d = periods(spark, sf).join(F.broadcast(leg)).groupBy(F.col("l_suppkey").alias("member")).agg(F.count_if(touched).alias("terms"), F.min("s").alias("since"), F.max("e").alias("until"))
    who = table(spark, sf, "supplier").select(F.col("s_suppkey").alias("member"), F.col("s_name").alias("name"), F.col("s_nationkey").alias("grp"))
    return who.join(n, "member").join(q, "member", "left").join(d, "member").fillna(0, ["compared", "agreed"])


@query(
    "n_party_page",
    f"""with {BALLOTS}, {PERIODS}, {LEG_SQL}, v as (select grp, count(*) as votes, count(*) filter (where choice = 'A') as n_for, count(*) filter (where choice = 'R') as n_against from ballots group by 1),
    m as (select s_nationkey as grp, count(*) as members, string_agg(s_name, '; ' order by s_acctbal desc, s_suppkey) filter (where rn <= 3) as leaders from (select *, row_number() over (partition by s_nationkey order by s_acctbal desc, s_suppkey) as rn from supplier) group by 1),
    h as (select distinct id, l_suppkey from periods join leg on s <= ls and e >= ls), a as (select s_nationkey as grp, id, count(*) as seats from h join supplier on s_suppkey = l_suppkey group by 1, 2),
    p as (select grp, string_agg(id || ':' || seats, ' ' order by id) as at_start from a group by 1)
    select n_nationkey as grp, n_name as name, coalesce(members, 0) as members, leaders, coalesce(votes, 0) as votes, coalesce(n_for, 0) as n_for, coalesce(n_against, 0) as n_against, at_start
    from nation left join v on v.grp = n_nationkey left join m on m.grp = n_nationkey left join p on p.grp = n_nationkey""",
)
def party_page(spark, sf):
    """Each party with its members, the first three of them, its ballots, and its seats at the start of each legislature."""
    v = ballots(spark, sf).groupBy("grp").agg(F.count("*").alias("votes"), F.count_if(F.col("choice") == "A").alias("n_for"), F.count_if(F.col("choice") == "R").alias("n_against"))
    s = table(spark, sf, "supplier")
    top = R.first_n(s, ["s_nationkey"], 3, F.desc("s_acctbal"), F.col("s_suppkey"))
    names = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct((-F.col("s_acctbal")).alias("b"), "s_suppkey", "s_name"))), lambda x: x["s_name"]), "; ")
    m = s.groupBy(F.col("s_nationkey").alias("grp")).agg(F.count("*").alias("members")).join(top.groupBy(F.col("s_nationkey").alias("grp")).agg(names.alias("leaders")), "grp", "left")
    held = periods(spark, sf).join(F.broadcast(legislatures(spark)), (F.col("s") <= F.col("ls")) & (F.col("e") >= F.col("ls"))).select("id", F.col("l_suppkey").alias("s_suppkey")).distinct()
    seats = held.join(s.select("s_suppkey", F.col("s_nationkey").alias("grp")), "s_suppkey").groupBy("grp", "id").agg(F.count("*").alias("seats"))
    at = seats.groupBy("grp").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("id", "seats"))), lambda x: F.concat(x["id"].cast("string"), F.lit(":"), x["seats"].cast("string"))), " ").alias("at_start"))
    n = table(spark, sf, "nation").select(F.col("n_nationkey").alias("grp"), F.col("n_name").alias("name"))
    return n.join(m, "grp", "left").join(v, "grp", "left").join(at, "grp", "left").fillna(0, ["members", "votes", "n_for", "n_against"])


@query(
    "n_member_votes",
    f"""with {BALLOTS}, g as (select vote, grp, case when f > a then 'A' when a > f then 'R' end as line from (select vote, grp, count(*) filter (where choice = 'A') as f, count(*) filter (where choice = 'R') as a from ballots group by 1, 2)),
    v as (select member, vote, cast(o_orderdate as date) as held_on, choice, line, row_number() over (partition by member order by cast(o_orderdate as date) desc, vote desc) as rn from ballots join orders on o_orderkey = vote join g using (vote, grp))
    select member, vote, held_on, choice, choice is not distinct from line as with_group from v where rn <= 21""",
)
def member_votes(spark, sf):
    """The latest page of each member's votes, with one more to tell that there are more, and whether it was the group's line."""
    b = ballots(spark, sf)
    g = A.group_totals(b, ["vote", "grp"], "choice", CHOICES)
    line = g.select("vote", "grp", F.when(F.col("n_for") > F.col("n_against"), "A").when(F.col("n_against") > F.col("n_for"), "R").alias("line"))
    days = table(spark, sf, "orders").select(F.col("o_orderkey").alias("vote"), F.to_date("o_orderdate").alias("held_on"))
    rows = b.join(line, ["vote", "grp"]).join(days, "vote")
    return R.first_n(rows, ["member"], 21, F.desc("held_on"), F.desc("vote")).select("member", "vote", "held_on", "choice", F.col("choice").eqNullSafe(F.col("line")).alias("with_group"))


@query(
    "n_member_bills",
    "select o_custkey as member, o_orderpriority as kind, count(*) as bills, count(*) filter (where o_orderstatus = 'F') as adopted, max(cast(o_orderdate as date)) as last_on, max_by(o_orderkey, (o_orderdate, o_orderkey)) as last_bill from orders group by 1, 2",
)
def member_bills(spark, sf):
    """What each member sponsored, by kind, with how much of it was adopted and the latest."""
    o = table(spark, sf, "orders")
    return o.groupBy(F.col("o_custkey").alias("member"), F.col("o_orderpriority").alias("kind")).agg(
        F.count("*").alias("bills"), F.count_if(F.col("o_orderstatus") == "F").alias("adopted"), F.max(F.to_date("o_orderdate")).alias("last_on"), F.max_by("o_orderkey", F.struct("o_orderdate", "o_orderkey")).alias("last_bill")
    )


@query(
    "n_member_activity",
    """with e as (select user_id as member, cast(date_trunc('month', ts) as date) as month, event_type as kind from events union all select o_custkey, cast(date_trunc('month', o_orderdate) as date), 'order' from orders)
    select member, month, count(*) as items, count(distinct kind) as kinds, string_agg(distinct kind, ',' order by kind) as what from e group by 1, 2""",
)
def member_activity(spark, sf):
    """Each member's months: how many items of what kinds, from two sources."""
    e = table(spark, sf, "events").select(F.col("user_id").alias("member"), F.trunc(F.to_date("ts"), "month").alias("month"), F.col("event_type").alias("kind"))
    o = table(spark, sf, "orders").select(F.col("o_custkey").alias("member"), F.trunc(F.to_date("o_orderdate"), "month").alias("month"), F.lit("order").alias("kind"))
    by = e.unionByName(o).groupBy("member", "month", "kind").agg(F.count("*").alias("n")).groupBy("member", "month")
    return by.agg(F.sum("n").alias("items"), F.count("*").alias("kinds"), F.array_join(F.sort_array(F.collect_set("kind")), ",").alias("what"))


@query(
    "n_filter_options",
    """select 'year' as filter, cast(year(o_orderdate) as varchar) as value, count(*) as n from orders group by 2 union all select 'month', cast(month(o_orderdate) as varchar), count(*) from orders group by 2
    union all select 'status', o_orderstatus, count(*) from orders group by 2 union all select 'group', n_name, count(*) from orders join customer on c_custkey = o_custkey join nation on n_nationkey = c_nationkey group by 2""",
)
def filter_options(spark, sf):
    """What there is to choose from in each filter, with how many it would give; one pass over the votes."""
    who = table(spark, sf, "customer").join(table(spark, sf, "nation"), F.col("n_nationkey") == F.col("c_nationkey")).select(F.col("c_custkey").alias("o_custkey"), "n_name")
    rows = table(spark, sf, "orders").join(who, "o_custkey")
    told = F.array(*[F.struct(F.lit(k).alias("filter"), v.cast("string").alias("value")) for k, v in (("year", F.year("o_orderdate")), ("month", F.month("o_orderdate")), ("status", F.col("o_orderstatus")), ("group", F.col("n_name")))])
    return rows.select(F.explode(told).alias("f")).groupBy("f.filter", "f.value").agg(F.count("*").alias("n"))


@query(
    "n_vote_explorer",
    """with v as (select o_orderkey, cast(o_orderdate as date) as held_on, o_orderstatus, o_orderpriority from orders where year(o_orderdate) = 1997 and month(o_orderdate) = 5 and o_orderstatus in ('F', 'O') and lower(o_orderpriority) like '%medium%')
    select * from v where (held_on, o_orderkey) < (date '1997-05-20', 1000000) order by held_on desc, o_orderkey desc limit 11""",
)
def vote_explorer(spark, sf):
    """Filters from a request and the page after a cursor, in one scan."""
    asked = R.parse_filters({"year": "1997", "month": "05", "q": " Medium "}, {})
    day = F.to_date("o_orderdate")
    conditions = R.all_of(R.in_period(day, int(asked["year"]), int(asked["month"])), F.contains(F.lower("o_orderpriority"), F.lit(asked["q"].lower())), F.col("o_orderstatus").isin("F", "O"))
    cursor = R.decode_cursor(R.encode_cursor("1997-05-20", 1_000_000))
    rows = table(spark, sf, "orders").where(conditions).select("o_orderkey", day.alias("held_on"), "o_orderstatus", "o_orderpriority")
    return R.keyset_page(rows, "held_on", "o_orderkey", R.clamp_limit("10"), cursor)


@query(
    "n_ministries",
    f"""with {PERIODS}, p as (select n_name as ministry, l_suppkey as person, s, e, l_orderkey, l_linenumber from periods join supplier on s_suppkey = l_suppkey join nation on n_nationkey = s_nationkey),
    c as (select *, row_number() over (partition by ministry order by s desc, person, l_orderkey desc, l_linenumber desc) as rn from p where s <= date '1998-01-01' and e >= date '1998-01-01')
    select ministry, count(distinct person) as holders, min(s) as first_on, max(e) as last_on, (select max(person) from c where c.ministry = p.ministry and rn = 1) as holder, (select max(s) from c where c.ministry = p.ministry and rn = 1) as since from p group by 1""",
)
def ministries(spark, sf):
    """Each ministry with its holders over time and who held it on a day: the latest to begin."""
    who = table(spark, sf, "supplier").join(table(spark, sf, "nation"), F.col("n_nationkey") == F.col("s_nationkey")).select(F.col("s_suppkey").alias("l_suppkey"), F.col("n_name").alias("ministry"))
    p = periods(spark, sf).join(who, "l_suppkey").select("ministry", F.col("l_suppkey").alias("person"), "s", "e")
    on = T.active_on(F.col("s"), F.col("e"), F.lit("1998-01-01").cast("date"))
    now = F.max(F.when(on, F.struct("s", (-F.col("person")).alias("p"))))
    by = p.groupBy("ministry").agg(F.count_distinct("person").alias("holders"), F.min("s").alias("first_on"), F.max("e").alias("last_on"), now.alias("now"))
    return by.select("ministry", "holders", "first_on", "last_on", (-F.col("now.p")).alias("holder"), F.col("now.s").alias("since"))


@query(
    "n_missions",
    f"""with t as ({I12_SQL}), n as (select place, max(struct_pack(s := started_on, h := holder)) filter (where ended in ('open', 'lapsed')) as now,
      max(struct_pack(e := ended_on, s := started_on, h := holder)) filter (where ended_on is not null) as gone, count(distinct holder) as holders from t where started_on is not null group by 1)
    select place, now.h as holder, now.s as since, gone.h as before, cast(holders as int) as holders from n""",
)
def missions(spark, sf):
    """Posts with one seat (each user's, from views and purchases as appointments and recalls): who holds it, since when, who before, and how many did."""
    e = table(spark, sf, "events").where(F.col("event_type").isin("view", "purchase"))
    kind = F.when(F.col("event_type") == "view", "appointed").otherwise("recalled")
    events = e.select(F.col("user_id").cast("string").alias("place"), F.to_date("ts").alias("day"), F.col("event_id").alias("seq"), kind.alias("kind"), (F.col("event_id") % 5).cast("string").alias("holder"))
    held = I.timelines(events, "2024-02-01").where("started_on is not null")
    now = F.when(F.col("ended").isin("open", "lapsed"), F.struct("started_on", "holder"))
    before = F.when(F.col("ended_on").isNotNull(), F.struct("ended_on", "started_on", "holder"))
    by = held.groupBy("place").agg(F.max(now).alias("now"), F.max(before).alias("before"), F.size(F.collect_set("holder")).alias("holders"))
    return by.select("place", F.col("now.holder").alias("holder"), F.col("now.started_on").alias("since"), F.col("before.holder").alias("before"), "holders")


@query(
    "n_questions",
    """with q as (select l_orderkey as question, l_suppkey as asker, cast(o_orderdate as date) as asked_on, case when l_shipdate >= o_orderdate then cast(l_shipdate as date) end as answered_on from lineitem join orders on o_orderkey = l_orderkey)
    select asker, year(asked_on) as year, count(*) as asked, count(answered_on) as answered, count(*) filter (where answered_on - asked_on <= 30) as in_time, cast(max(answered_on - asked_on) as integer) as longest from q group by 1, 2""",
)
def questions(spark, sf):
    """Questions of each asker and year: asked, answered, answered within thirty days, and the longest wait."""
    o = table(spark, sf, "orders").select(F.col("o_orderkey").alias("l_orderkey"), F.to_date("o_orderdate").alias("asked_on"))
    q = table(spark, sf, "lineitem").select("l_orderkey", F.col("l_suppkey").alias("asker"), F.to_date("l_shipdate").alias("d")).join(o, "l_orderkey")
    wait = F.when(F.col("d") >= F.col("asked_on"), F.datediff("d", "asked_on"))
    return q.withColumn("wait", wait).groupBy("asker", F.year("asked_on").alias("year")).agg(F.count("*").alias("asked"), F.count("wait").alias("answered"), F.count_if(F.col("wait") <= 30).alias("in_time"), F.max("wait").alias("longest"))


@query(
    "n_leadership",
    f"""with {PERIODS}, p as (select o_orderstatus as body, s_nationkey as post, l_suppkey as person, s, e from periods join supplier on s_suppkey = l_suppkey),
    d as (select distinct body, post, person, s, e from p), r as (select *, row_number() over (partition by body, post order by s desc, e desc, person) as rn from d where s <= date '1998-01-01')
    select a.body, a.post, a.person as leader, a.s as since, b.person as predecessor from r a left join r b on b.body = a.body and b.post = a.post and b.rn = 2 where a.rn = 1""",
)
def leadership(spark, sf):
    """Each post's leader on a day, the latest named, and who was named before."""
    s = table(spark, sf, "supplier").select(F.col("s_suppkey").alias("l_suppkey"), F.col("s_nationkey").alias("post"))
    d = periods(spark, sf).where(F.col("s") <= F.lit("1998-01-01").cast("date")).join(s, "l_suppkey").select(F.col("o_orderstatus").alias("body"), "post", F.col("l_suppkey").alias("person"), "s", "e").distinct()
    two = R.first_n(d, ["body", "post"], 2, F.desc("s"), F.desc("e"), F.col("person"))
    rows = F.array_sort(F.collect_list(F.struct((-F.datediff("s", F.lit("1970-01-01").cast("date"))).alias("a"), (-F.datediff("e", F.lit("1970-01-01").cast("date"))).alias("b"), "person", "s")))
    by = two.groupBy("body", "post").agg(rows.alias("r"))
    at = lambda i: F.get("r", F.lit(i))
    return by.select("body", "post", at(0)["person"].alias("leader"), at(0)["s"].alias("since"), at(1)["person"].alias("predecessor"))


@query(
    "n_motions",
    f"""with {BALLOTS}, {LEG_SQL}, m as (select o_orderkey as motion, cast(o_orderdate as date) as held_on, case when o_orderpriority like '1-%' then 'no_confidence' else 'simple' end as kind from orders where o_orderpriority like '1-%' or o_orderpriority like '2-%'),
    t as (select vote, count(*) filter (where choice = 'A') as n_for, count(*) as present from ballots group by 1)
    select motion, held_on, kind, id as legislature, coalesce(n_for, 0) as n_for, case when n_for is null then 'unknown' when kind = 'no_confidence' and n_for >= 3 then 'passed' when kind = 'simple' and 2 * n_for > present then 'passed' else 'failed' end as outcome
    from m left join t on vote = motion left join leg on held_on >= ls and held_on < le""",
)
def motions(spark, sf):
    """Motions with the legislature of their day and their outcome: of all members for no confidence (five here), of those present else."""
    o = table(spark, sf, "orders")
    kind = F.when(F.startswith("o_orderpriority", F.lit("1-")), "no_confidence").when(F.startswith("o_orderpriority", F.lit("2-")), "simple")
    m = o.select(F.col("o_orderkey").alias("motion"), F.to_date("o_orderdate").alias("held_on"), kind.alias("kind")).where("kind is not null")
    t = ballots(spark, sf).groupBy(F.col("vote").alias("motion")).agg(F.count_if(F.col("choice") == "A").alias("n_for"), F.count("*").alias("present"))
    rows = m.join(t, "motion", "left").join(F.broadcast(legislatures(spark)), T.within_half_open(F.col("ls"), F.col("le"), F.col("held_on")), "left")
    passed = F.when(F.col("kind") == "no_confidence", F.col("n_for") >= 3).otherwise(2 * F.col("n_for") > F.col("present"))
    return rows.select("motion", "held_on", "kind", F.col("id").alias("legislature"), F.coalesce("n_for", F.lit(0)).alias("n_for"), F.when(F.col("n_for").isNull(), "unknown").when(passed, "passed").otherwise("failed").alias("outcome"))


_TOKENS = r"'[\p{L}\p{N}]+'"


@query(
    "n_text_search",
    rf"""with p as (select item_id, array_to_string(list_slice(regexp_extract_all(lower(text), {_TOKENS}), 1, 1 + item_id % 3), ' ') as phrase, 1 + item_id % 3 as m from benchmark),
    d as (select doc_id, text, regexp_extract_all(lower(text), {_TOKENS}) as w, regexp_split_to_array(text, {_TOKENS}) as g from documents),
    s as (select doc_id, m, unnest(range(len(w) - m + 1)) as i, unnest([array_to_string(w[j + 1:j + m], ' ') for j in range(len(w) - m + 1)]) as run from d, (values (1), (2), (3)) v(m) where len(w) >= m),
    h as (select item_id, phrase, doc_id, count(*) as n_hits, cast(min(i) as int) as at_word from s join p on p.m = s.m and p.phrase = s.run group by 1, 2, 3),
    b as (select h.*, text, cast(coalesce(list_sum(list_transform(g[1:at_word + 1], lambda x: length(x))), 0) + coalesce(list_sum(list_transform(w[1:at_word], lambda x: length(x))), 0) as int) as begin from h join d using (doc_id))
    select item_id, phrase, doc_id, n_hits, at_word, begin, substr(text, greatest(begin - 40, 0) + 1, 120) as snippet, begin > 40 as cut_before, length(text) > greatest(begin - 40, 0) + 120 as cut_after from b""",
)
def text_search(spark, sf):
    """Phrases of one to three words, all at once, in all documents: hits, the first of them, and the text around it."""
    at = scratch_folder(spark, "text-index")
    docs = table(spark, sf, "documents").select("doc_id", "text")
    X.write(docs, "doc_id", "text", at)
    phrase = F.array_join(F.slice(X.words(F.col("text")), F.lit(1), F.lit(1) + (F.col("item_id") % 3).cast("int")), " ")
    found = X.search(spark, at, table(spark, sf, "benchmark").select("item_id", phrase.alias("phrase")), "phrase")
    return X.snippets(found, docs, "doc_id", "text").withColumnsRenamed({"id": "doc_id", "at": "at_word"})


_GOVERNMENTS = """g as (select r_regionkey as government, date '1995-06-01' + cast(r_regionkey as int) * 400 as g_from, case when r_regionkey < 4 then date '1995-06-01' + cast(r_regionkey as int) * 400 + 399 end as g_to from region),
    a as (select government, n_nationkey as party, g_from + cast(n_nationkey as int) * 3 - 10 as a_from, case when n_nationkey % 4 = 0 then g_from + 200 end as a_to from g, nation where (n_nationkey + government) % 3 < 2)"""


@query(
    "n_government_support",
    f"""with {PERIODS}, {_GOVERNMENTS},
    m as (select l_suppkey, s_nationkey as party, case o_orderstatus when 'F' then 'deputies' else 'senate' end as chamber, s, e from periods join supplier on s_suppkey = l_suppkey where o_orderstatus in ('F', 'O')),
    o as (select l_suppkey, chamber, min(s) + 30 as o_from, max(e) - 30 as o_to from m group by 1, 2),
    h as (select government, party, chamber, l_suppkey, g_from, greatest(a_from, g_from, s, o_from) as f, least(coalesce(a_to, date '9999-12-31'), coalesce(g_to, date '9999-12-31'), e, o_to) as t
      from a join g using (government) join m using (party) join o using (l_suppkey, chamber)),
    p as (select government, party, chamber, l_suppkey, bool_or(f <= g_from and t >= g_from) as at_start from h where f <= t group by 1, 2, 3, 4)
    select government, party, count(*) filter (where at_start and chamber = 'deputies') as deputies, count(*) filter (where at_start and chamber = 'senate') as senators, count(*) as total, count(*) filter (where not at_start) as joined_later from p group by 1, 2""",
)
def government_support(spark, sf):
    """Governments of each region, nations as parties that stand with some of them, suppliers as members of their groups in two chambers."""
    start = F.date_add(F.lit("1995-06-01").cast("date"), F.col("r_regionkey") * 400)
    g = table(spark, sf, "region").select(F.col("r_regionkey").alias("government"), start.alias("starts_on"), F.when(F.col("r_regionkey") < 4, F.date_add(start, 399)).alias("ends_on"))
    party = table(spark, sf, "nation").select(F.col("n_nationkey").alias("party"))
    kind = F.get(F.array(F.lit("government"), F.lit("governing_support"), F.lit("opposition")), (F.col("party") + F.col("government")) % 3)
    aligned = g.join(F.broadcast(party)).select("government", "party", kind.alias("alignment"), F.date_add("starts_on", F.col("party") * 3 - 10).alias("starts_on"), F.when(F.col("party") % 4 == 0, F.date_add("starts_on", 200)).alias("ends_on"))
    chambers = F.explode(F.array(F.lit("deputies"), F.lit("senate"))).alias("chamber")
    groups = party.select("party", chambers).withColumn("group", F.concat_ws("-", "party", "chamber"))
    sits = periods(spark, sf).where(F.col("o_orderstatus").isin("F", "O")).join(table(spark, sf, "supplier"), F.col("s_suppkey") == F.col("l_suppkey"))
    sits = sits.withColumn("chamber", F.when(F.col("o_orderstatus") == "F", "deputies").otherwise("senate"))
    sits = sits.select(F.concat_ws("-", "l_suppkey", "chamber").alias("member"), "l_suppkey", "s_nationkey", "chamber", "s", "e")
    sits, member = spread(sits, "member", most=DEALT, rows=table(spark, sf, "lineitem").count()), F.col("member")
    memberships = sits.select(member, F.col("l_suppkey").alias("person"), F.concat_ws("-", "s_nationkey", "chamber").alias("group"), F.col("s").alias("starts_on"), F.col("e").alias("ends_on"))
    mandates = sits.groupBy(member).agg(F.date_add(F.min("s"), 30).alias("starts_on"), F.date_sub(F.max("e"), 30).alias("ends_on"))
    return G.support(G.supporters(g, aligned, groups, memberships, mandates))


@query(
    "n_abroad_by_country",
    """with v as (select o_orderstatus as election, c_nationkey as place, cast(floor(o_totalprice / 1000) as bigint) as votes from orders join customer on c_custkey = o_custkey),
    w as (select election, case when place % 20 = 7 or (election = 'P' and place % 4 = 0) then 'place ' || place else 'country ' || place end as place, votes from v),
    s as (select election, case when place like 'country%' then upper(place) end as country, cast(sum(votes) as bigint) as votes from w group by 1, 2),
    t as (select election, coalesce(sum(votes) filter (where country is not null), 0) / sum(votes) as covered from s group by 1)
    select election, country, votes, covered, covered >= 0.9 as drawn from s join t using (election)""",
)
def abroad_by_country(spark, sf):
    """Votes cast abroad: of one election too many stand under places that are in no country of the list, so it has no map of countries."""
    v = table(spark, sf, "orders").join(table(spark, sf, "customer"), F.col("c_custkey") == F.col("o_custkey")).select(F.col("o_orderstatus").alias("election"), F.col("c_nationkey").alias("n"), F.floor(F.col("o_totalprice") / 1000).cast("long").alias("votes"))
    odd = (F.col("n") % 20 == 7) | ((F.col("election") == "P") & (F.col("n") % 4 == 0))
    v = v.select("election", F.concat(F.when(odd, "place ").otherwise("country "), F.col("n").cast("string")).alias("place"), "votes")
    known = table(spark, sf, "nation").select(F.concat(F.lit("country "), F.col("n_nationkey").cast("string")).alias("place"))
    return G.by_country(v, "election", "place", "votes", known.select("place", F.upper("place").alias("country")))


@query(
    "n_bill_explorer",
    """with b as (select c_custkey as bill, c_name as title, c_mktsegment as status, max(cast(o_orderdate as date)) as latest_on, count(o_orderkey) as votes from customer left join orders on o_custkey = c_custkey group by 1, 2, 3),
    f as (select *, coalesce(latest_on, date '1000-01-01') as moved_on from b where status in ('BUILDING', 'MACHINERY') and contains(lower(title), '1') and votes >= 1)
    select bill, title, status, latest_on, votes from f where (moved_on, bill) < (date '2001-01-01', 100) order by moved_on desc, bill desc limit 11""",
)
def bill_explorer(spark, sf):
    """Bills by words, status and whether they were voted on, the last to move first, from a cursor on; one row more tells of a next page."""
    asked = R.parse_filters({"q": " 1 ", "group": "BUILDING"}, {})
    votes = table(spark, sf, "orders").groupBy(F.col("o_custkey").alias("c_custkey")).agg(F.max(F.to_date("o_orderdate")).alias("latest_on"), F.count("*").alias("votes"))
    bills = table(spark, sf, "customer").where(F.contains(F.lower("c_name"), F.lit(asked["q"])) & F.col("c_mktsegment").isin(asked["group"], "MACHINERY")).join(votes, "c_custkey")
    rows = bills.select(F.col("c_custkey").alias("bill"), F.col("c_name").alias("title"), F.col("c_mktsegment").alias("status"), "latest_on", "votes")
    return R.keyset_page(rows, "latest_on", "bill", R.clamp_limit("10"), R.decode_cursor(R.encode_cursor("2001-01-01", 100)))
