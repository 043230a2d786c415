"""Identity, alignment and career operators (I) and integrity checks (K) on the test tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from tallyloom.functions import text as X
from tallyloom.operators import entities as E
from tallyloom.operators import identity as I
from tallyloom.operators import quality as Q
from tallyloom.operators import relational as R
from tallyloom.operators import rules
from tallyloom.plans.registry import query
from tallyloom.session import spread, table


def _day(text: str):
    return F.lit(text).cast("date")


def cases(rows, *columns) -> str:
    """Rows of constants as SQL."""
    told = lambda v: "null" if v is None else str(v).lower() if isinstance(v, bool) else str(v) if isinstance(v, int) else "'" + v.replace("'", "''") + "'"
    return f"(values {', '.join('(' + ', '.join(map(told, r)) + ')' for r in rows)}) as t({', '.join(columns)})"


def given(spark, sf, rows, columns, table_="orders", key="o_orderkey", also=()):
    """Every row of a table, as its key and other columns, with the constants of its number modulo their count. Rows are dealt out before they carry texts."""
    at = F.pmod(F.col(key), F.lit(len(rows))).cast("int")
    types = ", ".join(f"{c}:{'boolean' if isinstance(rows[0][i], bool) else 'int' if isinstance(rows[0][i], int) else 'string'}" for i, c in enumerate(columns))
    constants = F.array(*[F.struct(*[F.lit(v).alias(c) for c, v in zip(columns, r, strict=False)]).cast(f"struct<{types}>") for r in rows])
    return spread(table(spark, sf, table_).select(key, *also), key).select(key, *also, F.get(constants, at).alias("c")).select(key, *also, "c.*")


@query(
    "i02_names_match",
    """with p as (select p_partkey, p_name, p_type, case p_partkey % 5 when 0 then lower(p_type) || '-' || p_name when 1 then p_name || ' ' || p_name || ' ' || p_type when 2 then split_part(p_name, ' ', 1)
      when 3 then upper(split_part(p_name, ' ', 2)) || ', ' || split_part(p_name, ' ', 1) else p_type || ' nimeni ' || p_name end as other from part),
    t as (select p_partkey, list_distinct(string_split(lower(p_name || ' ' || p_type), ' ')) as a, list_distinct(list_filter(string_split(regexp_replace(lower(other), '[^a-z]+', ' ', 'g'), ' '), lambda x: x <> '')) as b from p)
    select p_partkey, least(len(a), len(b)) >= 2 and (list_has_all(a, b) or list_has_all(b, a)) as same from t""",
)
def i02(spark, sf):
    """A name against one turned round, longer, too short, with accents and signs, or with a word of its own."""
    k, name, kind = F.col("p_partkey") % 5, F.col("p_name"), F.col("p_type")
    word = lambda n: F.split_part(name, F.lit(" "), F.lit(n))
    other = (
        F.when(k == 0, F.concat(F.translate(F.lower(kind), "ai", "ăî"), F.lit("-"), name)).when(k == 1, F.concat_ws(" ", name, name, kind)).when(k == 2, word(1))
        .when(k == 3, F.concat(F.upper(word(2)), F.lit(", "), word(1))).otherwise(F.concat(kind, F.lit(" nimeni "), name))
    )
    return table(spark, sf, "part").select("p_partkey", X.names_match(F.concat_ws(" ", name, kind), other).alias("same"))


@query("i03_constituency_key", "select n_nationkey, case when n_nationkey % 5 = 0 then 'diaspora' else 'dimbovita nation' end as k from nation")
def i03(spark, sf):
    raw = F.when(F.col("n_nationkey") % 5 == 0, "În afara României").otherwise(F.concat(F.lit("DÂMBOVIȚA "), "n_name", F.lit(" în data de 01.12.2024")))
    return table(spark, sf, "nation").select("n_nationkey", X.constituency_key(raw).alias("k"))


@query(
    "i04_seats_at_once",
    """with m as (select o_custkey as member, o_orderstatus as chamber, min(cast(o_orderdate as date)) as s, max(cast(o_orderdate as date)) as e from orders group by 1, 2),
    p as (select c_custkey as a, c_custkey + 1 as b from customer)
    select distinct p.a, p.b from p join m x on x.member = a join m y on y.member = b
    where least(x.e, y.e) - greatest(x.s, y.s) > 31 and not (x.chamber = y.chamber and x.member % 2 = y.member % 2 - 1)""",
)
def i04(spark, sf):
    """Neighbours by id; an even member and the next sit for the same place."""
    d = F.to_date("o_orderdate")
    m = table(spark, sf, "orders").groupBy(F.col("o_custkey").alias("member"), F.col("o_orderstatus").alias("chamber")).agg(F.min(d).alias("starts_on"), F.max(d).alias("ends_on"))
    place = F.concat(F.lit("loc "), F.translate(F.floor(F.col("member") / 2).cast("string"), "0123456789", "abcdefghij"))
    m = m.withColumns({"legislature": F.lit(1), "constituency": place})
    pairs = table(spark, sf, "customer").select(F.col("c_custkey").alias("a"), (F.col("c_custkey") + 1).alias("b"))
    return I.seats_at_once(pairs, m)


@query(
    "i08_match_by_name",
    "with k as (select p_name, count(*) as n, min(p_partkey) as p from part group by 1) select p_partkey, case when n = 1 then p end as member, n > 1 as ambiguous from part join k using (p_name)",
)
def i08(spark, sf):
    """Every part's name against those of all parts."""
    p = table(spark, sf, "part").select("p_partkey", "p_name")
    return I.match_by_name(p, p.withColumnRenamed("p_partkey", "member"), "p_name", "member").select("p_partkey", "member", "ambiguous")


#: Names as a page prints them, a day, who they are, and whether several fit; and the members that there are, with their time in the chamber.
MEMBERS = (
    ("m1", "Radu-Matei Cern@iță", "2020-12-21", "2024-12-20"), ("m2", "Matei-Radu Cern@iță", "2020-12-21", None), ("m3", "Ilinca Vr@âncu", "2016-12-21", None),
    ("m4", "Sanda-Ilona Pâr@ău", "2016-12-21", None), ("m5", "Camelia Os@oianu", "2020-12-21", None), ("m6", "Doru Fel@ecan", "2004-12-13", "2008-12-14"), ("m7", "Doru Fel@ecan", "2020-12-21", None),
    ("m8", "Zoe Mara Gru@ia", "2020-12-21", None), ("m9", "Zoe Irina Gru@ia", "2020-12-21", None),
)
PRINTED = (
    ("Cern@iță Radu-Matei", "2022-01-01", "m1", False), ("Cern@iță Matei-Radu", "2022-01-01", "m2", False), ("Cern@iță Matei-Radu", "2025-01-01", "m2", False), ("Radu Cern@iță Matei", "2022-01-01", "m2", False),
    ("VR@ÂNCU Ilinca", "2022-01-01", "m3", False), ("Albu (Pâr@ău) Sanda-Ilona", "2022-01-01", "m4", False), ("Os@oianu Camellia", "2022-01-01", "m5", False), ("Doru Fel@ecan", "2022-01-01", "m7", False),
    ("Doru Fel@ecan", "2006-01-01", "m6", False), ("Doru Fel@ecan", None, None, True), ("Zoe Gru@ia", "2022-01-01", None, True), ("Fel@ecan", "2022-01-01", None, False), ("Doru Nimeni", "2022-01-01", None, False),
    ("Doru Fel@eca", "2022-01-01", "m7", False), ("", "2022-01-01", None, False),
)


@query(
    "i08_match_by_name_in_steps",
    f"""select s_suppkey, place, case when member is not null then member || '-' || s_suppkey end as member, ambiguous from supplier
    cross join {cases([(i, *p[2:]) for i, p in enumerate(PRINTED)], 'place', 'member', 'ambiguous')}""",
)
def i08_steps(spark, sf):
    """Each of the four ways to know a name, on the day that it was printed, for a house of each supplier: its letters stand inside the names of its members."""
    letters = F.regexp_replace(F.translate(F.col("s_suppkey").cast("string"), "0123456789", "abcdefghij"), "(.)", "$1$1$1")  # no house is one letter from another
    house = table(spark, sf, "supplier").select("s_suppkey", letters.alias("k"))
    own = lambda df: df.withColumn("name", F.replace("name", F.lit("@"), F.when(F.upper("name") == F.col("name"), F.upper("k")).otherwise(F.col("k"))))
    several = lambda rows, schema: F.inline(F.array(*[F.struct(*[F.lit(v).alias(c) for c, v in zip(schema, r, strict=True)]) for r in rows]))
    probe = own(house.select("s_suppkey", "k", several([(i, *p[:2]) for i, p in enumerate(PRINTED)], ["place", "name", "day"]))).withColumn("day", F.col("day").cast("date"))
    members = own(house.select("s_suppkey", "k", several(MEMBERS, ["member", "name", "starts_on", "ends_on"]))).withColumns({c: F.col(c).cast("date") for c in ("starts_on", "ends_on")})
    members = members.select(F.concat_ws("-", "member", "s_suppkey").alias("member"), "name", "starts_on", "ends_on")
    return I.match_by_name(probe.drop("k"), members, "name", "member", on="day").select("s_suppkey", "place", "member", "ambiguous")



@query(
    "i09_merge_evidence",
    """with r as (select o_custkey % 20 as org, o_custkey as member, case when o_custkey % 7 = 0 then o_custkey % 3 else o_custkey % 20 end as party from orders),
    a as (select org, party, count(distinct member) as agree from r group by 1, 2), m as (select org, count(distinct member) as members from r group by 1)
    select org, party, members, agree from a join m using (org) where members >= 5 and agree >= 0.8 * members""",
)
def i09(spark, sf):
    k = F.col("o_custkey")
    rows = table(spark, sf, "orders").select((k % 20).alias("org"), k.alias("member"), F.when(k % 7 == 0, k % 3).otherwise(k % 20).alias("party"))
    return I.merge_evidence(rows, "org", "member", "party", share=0.8)


I12_SQL = """with e as (select cast(user_id as varchar) as place, cast(ts as date) as day, event_id as seq, case when event_type = 'view' then 1 else 0 end as named, cast(event_id % 5 as varchar) as holder
  from events where event_type in ('view', 'purchase')),
a as (select *, sum(named) over w as g, last_value(case when named = 1 then holder end ignore nulls) over w as who from e window w as (partition by place order by day, named, seq rows unbounded preceding)),
b as (select *, named = 0 and holder is not distinct from who as own from a),
c as (select *, own and sum(case when own then 1 else 0 end) over (partition by place, g order by day, named, seq rows unbounded preceding) = 1 as final from b),
s as (select place, g, max(who) as who, min(case when named = 1 then day end) as day, min(case when final then day end) as over_on from c where g > 0 group by 1, 2),
f as (select *, case when lag(who) over w is not distinct from who and lag(over_on) over w is null and lag(g) over w is not null then 0 else 1 end as fresh from s window w as (partition by place order by g)),
p as (select *, sum(fresh) over (partition by place order by g rows unbounded preceding) as p from f),
h as (select place, p, max(who) as holder, min(day) as started_on, max_by(coalesce(over_on, date '1000-01-01'), g) as over_on from p group by 1, 2),
n as (select *, lead(started_on) over (partition by place order by p) as after from h)
select place, holder, started_on, case when over_on > date '1000-01-01' then over_on else after end as ended_on,
  case when over_on > date '1000-01-01' then 'recalled' when after is not null then 'replaced' when date '2024-02-01' - started_on > 8 * 365.25 then 'lapsed' else 'open' end as ended from n
union all select place, holder, null, day, 'recalled' from c where named = 0 and not final"""


@query("i12_timelines", I12_SQL)
def i12(spark, sf):
    """Holders of posts, from the first kinds of events as appointments and recalls."""
    e = table(spark, sf, "events").where(F.col("event_type").isin("view", "purchase"))
    kind = F.when(F.col("event_type") == "view", "appointed").otherwise("recalled")
    return I.timelines(e.select(F.col("user_id").cast("string").alias("place"), F.to_date("ts").alias("day"), F.col("event_id").alias("seq"), kind.alias("kind"), (F.col("event_id") % 5).cast("string").alias("holder")), "2024-02-01")


@query(
    "i13_merger_history",
    """with r as (select o_orderkey as person, o_orderstatus as party, cast(o_orderdate as date) as s, cast(o_orderdate as date) + 300 as e from orders)
    select person, party, s as starts_on, case when party = 'P' and e >= date '1996-06-01' then date '1996-05-31' else e end as ends_on from r where party <> 'P' or s < date '1996-06-01'
    union all select person, 'O', greatest(s, date '1996-06-01'), e from r where party = 'P' and e >= date '1996-06-01'""",
)
def i13(spark, sf):
    d = F.to_date("o_orderdate")
    rows = table(spark, sf, "orders").select(F.col("o_orderkey").alias("person"), F.col("o_orderstatus").alias("party"), d.alias("starts_on"), F.date_add(d, 300).alias("ends_on"))
    mergers = spark.createDataFrame([("P", "O")], "party string, absorber string").withColumn("merged_on", _day("1996-06-01"))
    return I.clip_at_merger(rows, mergers)


@query(
    "i14_governance_gaps",
    """with c as (select o_orderkey as id, cast(o_orderdate as date) as s, cast(o_orderdate as date) + 400 as e from orders),
    g as (select date '1995-03-01' as gs, date '1996-02-10' as ge union all select date '1996-07-01', date '1997-01-31'),
    d as (select id, unnest(generate_series(s, e, interval 1 day))::date as d from c), f as (select id, d, exists (select 1 from g where d between gs and ge) as inside from d)
    select id, cast(count(*) filter (where inside) as bigint) as governing, cast(count(*) filter (where not inside) as bigint) as opposing from f group by 1""",
)
def i14(spark, sf):
    """Days of each career on either side."""
    d = F.to_date("o_orderdate")
    careers = table(spark, sf, "orders").select(F.col("o_orderkey").alias("id"), F.lit("x").alias("party"), d.alias("starts_on"), F.date_add(d, 400).alias("ends_on"))
    governments = spark.sql("select 'x' as party, date '1995-03-01' as starts_on, date '1996-02-10' as ends_on union all select 'x', date '1996-07-01', date '1997-01-31'")
    days = F.datediff("ends_on", "starts_on") + 1
    on = lambda side: F.coalesce(F.sum(F.when(F.col("side") == side, days)), F.lit(0)).cast("long")
    return I.opposition_gaps(careers, governments).groupBy("id").agg(on("government").alias("governing"), on("opposition").alias("opposing"))


@query(
    "i15_alignment",
    """select o_orderkey, case when o_orderkey % 13 = 0 then 'unaffiliated' when o_orderkey % 3 = 0 then 'group' when o_orderkey % 5 = 0 and (o_orderkey % 7 <> 0 or o_orderkey % 4 >= 2) then 'member'
    when o_orderkey % 7 = 0 then 'party' when o_orderkey % 2 = 0 then 'opposition' else 'unknown' end as side from orders""",
)
def i15(spark, sf):
    k = F.col("o_orderkey")
    given = lambda n, what: F.when(k % n == 0, F.lit(what))
    side = I.alignment(F.when(k % 13 == 0, "grup-neafiliați").otherwise("g1"), given(3, "group"), given(5, "member"), k % 4, given(7, "party"), F.lit(2), k % 2 == 0)
    return table(spark, sf, "orders").select("o_orderkey", side.alias("side"))


@query(
    "i16_party_alignment",
    "select o_orderkey, case when o_orderkey % 3 = 0 then case when o_orderkey % 2 = 0 then 'unaffiliated' else 'unknown' end when o_orderkey % 5 = 0 then 'government' when o_orderkey % 7 <> 0 then 'opposition' else 'unknown' end as side from orders",
)
def i16(spark, sf):
    k = F.col("o_orderkey")
    side = I.party_alignment(F.when(k % 3 != 0, "p"), F.when(k % 5 == 0, "government"), k % 7 != 0, F.when(k % 2 == 0, "Deputați neafiliați"))
    return table(spark, sf, "orders").select("o_orderkey", side.alias("side"))


@query(
    "i17_seat_rows",
    """with s as (select distinct l_suppkey % 10 as member, l_orderkey as vote from lineitem), n as (select vote, member, 'for' as choice from s where (vote + member) % 3 <> 0)
    select * from n union all select vote, member, 'unknown' from s where (vote, member) not in (select vote, member from n)""",
)
def i17(spark, sf):
    sitting = table(spark, sf, "lineitem").select((F.col("l_suppkey") % 10).alias("member"), F.col("l_orderkey").alias("vote")).distinct()
    return I.seat_rows(sitting.where("(vote + member) % 3 <> 0").withColumn("choice", F.lit("for")), sitting, ["vote", "member"], "choice")


@query(
    "i21_richer_source",
    """with a as (select l_orderkey as k, l_linenumber as n, 0 as source from lineitem where l_returnflag = 'A'), b as (select l_orderkey as k, l_linenumber as n, 1 as source from lineitem where l_returnflag = 'R'),
    u as (select * from a union all select * from b), c as (select k, count(*) filter (where source = 0) as x, count(*) filter (where source = 1) as y from u group by 1)
    select u.* from u join c using (k) where source = case when x >= y then 0 else 1 end""",
)
def i21(spark, sf):
    part = lambda flag: table(spark, sf, "lineitem").where(F.col("l_returnflag") == flag).select(F.col("l_orderkey").alias("k"), F.col("l_linenumber").alias("n"))
    return I.richer_source(part("A"), part("R"), ["k"])


@query("i23_stale_mandates", "with g as (select c_custkey as member from customer where c_custkey % 40 = 0) select member, (select count(*) from g) <= greatest(3, ceil(0.05 * (select count(*) from customer where c_custkey % 40 <> 0))) as allowed from g")
def i23(spark, sf):
    seats = table(spark, sf, "customer").select(F.col("c_custkey").alias("member"))
    return I.stale_mandates(seats, seats.where("member % 40 <> 0"), "member")


@query(
    "i24_merge_veto",
    """with m as (select c_custkey as old, c_custkey + 1 as survivor from customer where c_custkey % 5 = 1), v as (select distinct o_orderkey % 50 as vote, o_custkey as member from orders)
    select old, survivor from m where not exists (select 1 from v x join v y using (vote) where x.member = old and y.member = survivor)""",
)
def i24(spark, sf):
    mapping = table(spark, sf, "customer").where("c_custkey % 5 = 1").select(F.col("c_custkey").alias("old"), (F.col("c_custkey") + 1).alias("survivor"))
    votes = table(spark, sf, "orders").select((F.col("o_orderkey") % 50).alias("vote"), F.col("o_custkey").alias("member"))
    return E.veto_shared(mapping, votes, "vote", "member").select("old", "survivor")


@query("i25_ordered_assignment")
def i25(spark, sf):
    s = table(spark, sf, "supplier")
    unit = lambda n: F.concat(F.lit("u"), (F.floor(F.col("s_suppkey") / n)).cast("string"))
    units = F.when(F.col("s_suppkey") % 3 == 0, F.array(unit(4), unit(7))).otherwise(F.array(unit(4)))
    return I.ordered_assignment(s.select((F.floor(F.col("s_suppkey") / 100) * 2 + F.col("s_suppkey") % 2).alias("block"), F.col("s_suppkey").alias("item"), "s_name", units.alias("units")).withColumnRenamed("s_name", "key"))


@query(
    "i26_fill_from_roster",
    """with m as (select c_custkey as member from customer where c_custkey % 4 = 0), g as (select n_name as label, n_nationkey as group_id from nation where n_nationkey % 6 <> 0)
    select member, group_id, case when group_id is not null then 'filled' when label is null then 'not on the roster' else 'no single group' end as status
    from (select member, n_name as lab from m left join customer on c_custkey = member and c_custkey % 3 = 0 left join nation on n_nationkey = c_nationkey) r left join g on g.label = r.lab
    cross join (select 1) where true""".replace("label is null", "lab is null"),
)
def i26(spark, sf):
    c, n = table(spark, sf, "customer"), table(spark, sf, "nation")
    rows = c.select(F.col("c_custkey").alias("member"), F.when(F.col("c_custkey") % 4 != 0, F.lit(1)).alias("group_id"))
    roster = c.where("c_custkey % 3 = 0").join(n, F.col("c_nationkey") == F.col("n_nationkey")).select(F.col("c_custkey").alias("member"), F.col("n_name").alias("label"))
    groups = n.where("n_nationkey % 6 <> 0").select(F.col("n_name").alias("label"), F.col("n_nationkey").alias("group_id"))
    return I.fill_from_roster(rows, roster, groups, "member")


@query("i27_single_candidate", "with k as (select p_name, p_brand, min(p_partkey) as person from part group by 1, 2 having count(distinct p_partkey) = 1) select p_partkey, person from part left join k using (p_name, p_brand)")
def i27(spark, sf):
    p = table(spark, sf, "part").select("p_partkey", "p_name", "p_brand")
    return R.unique_match(p, p.withColumnRenamed("p_partkey", "person"), ["p_name", "p_brand"], "person").select("p_partkey", "person")


#: A name of a part in letters alone, of attributes that tell most parts apart.
_LONG_NAME = "concat_ws(' ', p_name, lower(p_type), translate(concat(p_brand, 'x', p_size), '0123456789#', 'abcdefghijk'))"


@query(
    "i08_match_by_name_whole",
    f"""with k as (select p_partkey, lower({_LONG_NAME}) as name from part), s as (select *, list_aggregate(list_sort(string_split(name, ' ')), 'string_agg', ' ') as k from k),
    q as (select p_partkey, k, case when p_partkey % 2 = 1 then list_aggregate(list_reverse(string_split(name, ' ')), 'string_agg', ' ') else name end as name from s),
    j as (select q.p_partkey, o.p_partkey as p, contains(' ' || o.name || ' ' || o.name || ' ', ' ' || q.name || ' ') as turned from q join s o using (k)),
    c as (select p_partkey, count(distinct p) as n, min(p) as p, count(distinct p) filter (where turned) as m, min(p) filter (where turned) as t from j group by 1)
    select p_partkey, case when n = 1 then p when m = 1 then t end as member from c""",
)
def i08_whole(spark, sf):
    """All parts against all parts; odd ones have their names turned round."""
    p = table(spark, sf, "part").select("p_partkey", F.expr(_LONG_NAME).alias("name"))
    turned = F.array_join(F.reverse(F.split("name", " ")), " ")
    probe = p.withColumn("name", F.when(F.col("p_partkey") % 2 == 1, turned).otherwise(F.col("name")))
    return I.match_by_name(probe, p.withColumnRenamed("p_partkey", "member"), "name", "member").select("p_partkey", "member")


@query(
    "i27_single_candidate_whole",
    "with k as (select p_name, p_type, p_brand, min(p_partkey) as person from part group by all having count(distinct p_partkey) = 1) select p_partkey, person from part left join k using (p_name, p_type, p_brand)",
)
def i27_whole(spark, sf):
    on = ["p_name", "p_type", "p_brand"]
    p = table(spark, sf, "part").select("p_partkey", *on)
    return R.unique_match(p, p.withColumnRenamed("p_partkey", "person"), on, "person").select("p_partkey", "person")


#: Votes as the official lists word them (title, type, linked to a bill), with kind, prominence, meaning and confidence.
VOTES = (
    ("Verificarea prezenței", None, False, "quorum_or_presence", "routine", "confirms_presence", "high"),
    ("Comisiile de specialitate să lucreze în paralel cu plenul", None, False, "agenda_or_schedule", "routine", "supports_procedure", "high"),
    ("PL-x 196/2026 - Timp dezbatere", None, True, "procedural_timing", "routine", "supports_procedure", "high"),
    ("Prelungirea termenului constituțional de dezbatere și vot final - PL-x 298/2026", None, True, "procedural_timing", "routine", "supports_procedure", "high"),
    ("Verificare prezenta", None, False, "quorum_or_presence", "routine", "confirms_presence", "high"),
    ("Amendamentul nr. 3 la PL-x 12/2026", None, True, "amendment", "standard", "supports_amendment", "high"),
    ("Retrimitere la comisie PL-x 14/2026", None, True, "committee_referral", "standard", "supports_referral", "high"),
    ("L339/2026 — raport de respingere", None, True, "rejection_report", "major", "supports_rejection", "high"),
    ("Vot final - PL-x 159/2026 - Vot final adoptare - Adoptare", None, True, "final_adoption", "major", "supports_adoption", "high"),
    ("Moțiune de cenzură împotriva Guvernului", None, False, "no_confidence", "major", "supports_no_confidence", "high"),
    ("Vot final - PH CD 53/2026 - Vot final adoptare", None, False, "institutional_resolution", "standard", "supports_resolution", "high"),
    ("Senate vote", "raport de activitate", False, "institutional_resolution", "standard", "supports_resolution", "high"),
    ("PL 530/2026 - AMA.87", None, True, "amendment", "standard", "supports_amendment", "high"),
    ("PL 529/2026 - amr.2", None, True, "amendment", "standard", "supports_amendment", "high"),
    ("Modificare ordine de zi", None, False, "agenda_or_schedule", "routine", "supports_procedure", "high"),
    ("vot test", None, False, "internal_procedure", "routine", "supports_procedure", "high"),
    ("L289/2026 — vf", "vf", True, "final_adoption", "major", "supports_adoption", "medium"),
    ("PL 532/2026 - vot final", None, False, "final_adoption", "major", "supports_adoption", "medium"),
    ("Senate vote", "PH - COM (2026) 113 final", False, "institutional_resolution", "standard", "supports_resolution", "high"),
    ("L495/2025 — proiect de lege de aprobare", "proiect de lege de aprobare", True, "final_adoption", "major", "supports_adoption", "high"),
    ("Încuviințarea Comisiei pentru apărare să își desfășoare activitatea în paralel cu plenul", None, False, "agenda_or_schedule", "routine", "supports_procedure", "high"),
    ("Vot final", None, False, "unknown", "unclassified", "unknown", "low"),
    ("Vot final", None, True, "final_adoption", "major", "supports_adoption", "medium"),
    ("Raport de respingere L1/2026", "", True, "rejection_report", "major", "supports_rejection", "high"),
    ("Vot final asupra legii: respingere", None, False, "final_rejection", "major", "supports_rejection", "high"),
    ("Vot de încredere", None, False, "confidence", "major", "supports_confidence", "high"),
    ("Reexaminarea legii, la cererea Președintelui", None, True, "reconsideration", "standard", "supports_reconsideration", "high"),
    ("Alegerea vicepreședinților", None, False, "institutional_resolution", "standard", "supports_resolution", "high"),
    ("Declarația Senatului", None, False, "institutional_resolution", "standard", "supports_resolution", "high"),
    ("Cu totul altceva", None, True, "unknown", "unclassified", "unknown", "low"),
)


@query(
    "j01_classify_vote",
    f"select o_orderkey, kind, prominence, meaning, confidence from orders join {cases([(i, *v[3:]) for i, v in enumerate(VOTES)], 'i', 'kind', 'prominence', 'meaning', 'confidence')} on i = o_orderkey % {len(VOTES)}",
)
def j01(spark, sf):
    votes = given(spark, sf, [v[:3] for v in VOTES], ["title", "vote_type", "linked"])
    facts = rules.vote_facts(F.col("title"), F.col("linked"), F.col("vote_type"))
    return votes.select("o_orderkey", *[c.alias(k) for k, c in facts.items()])


@query(
    "k30_verdict",
    """with n as (select o_orderstatus as "check", case when o_orderstatus = 'P' then 'warning' else 'error' end as severity, count(*) as n, count(*) filter (where o_orderkey % 2 = 0) as was from orders group by 1)
    select "check", was, n, case when severity = 'error' and "check" <> 'F' then 'worse' when severity = 'error' then 'tolerated' else 'grew' end as verdict from n where n > was""",
)
def k30(spark, sf):
    o = table(spark, sf, "orders")
    severity = F.when(F.col("check") == "P", "warning").otherwise("error")
    count = lambda df: df.groupBy(F.col("o_orderstatus").alias("check")).agg(F.count("*").alias("n")).withColumn("severity", severity)
    return Q.verdict(count(o.where("o_orderkey % 2 = 0")), count(o), ["F"])


#: Who a registry of two sources knows: record, person held, name, profile, profiles of other terms, legislature, chamber, constituency, from, to; and what must come out.
RECORDS = (
    ("a1", "p-szabo-reka", "Szabó Réka", "L:1", (), "2024", "senate", "HARGHITA", "2024-12-21", None, "p-reka-szabo"),
    ("a2", "p-reka-szabo", "Réka Szabó", None, (), "2024", "senate", "Harghita în data de 01.12.2024", "2024-12-21", None, "p-reka-szabo"),
    ("b1", "p-toma-iosif", "Toma-Iosif Vrabie", "L:2", (), "2024", "senate", "ALBA", "2024-12-21", None, "p-toma"),
    ("b2", "p-toma", "Toma Vrabie", None, (), "2024", "senate", "Alba", "2024-12-21", None, "p-toma"),
    ("c1", "p-radu", "Radu-Matei Cerniță", "L:3", (), "2024", "deputies", "BUCUREŞTI", "2024-12-21", None, "p-radu"),
    ("c2", "p-matei", "Matei-Radu Cerniță", "L:4", (), "2024", "deputies", "la nivel national", "2024-12-21", None, "p-matei"),
    ("d1", "p-ramona", "Ramona Şoimu", "K:5", (), "2020", "deputies", "VÂLCEA", "2020-12-21", "2024-12-20", "p-ramona"),
    ("d2", "p-ramona-vp", "Ramona Şoimu, Vicepreşedinte", "L:6", ("K:5",), "2024", "deputies", "VÂLCEA", "2024-12-21", None, "p-ramona"),
    ("e1", "p-filip", "Filip Ardel", "G:7", ("H:8",), "1990", "deputies", "?", "1990-06-18", "1992-10-15", "p-filip"),
    ("e2", "p-filip", "Filip Ardel", "H:8", (), "2000", "senate", "BUCUREŞTI", "2000-12-11", "2004-12-12", "p-filip"),
    ("e3", "p-filip", "Filip Ardel", "I:9", (), "1996", "senate", "BUCUREŞTI", "1996-11-22", "2000-11-30", "p-filip"),
    ("f1", "p-two", "Vlad Sorel", "L:10", (), "2024", "deputies", "IAȘI", "2024-12-21", None, "p-two"),
    ("f2", "p-two", "Vlad Sorel", "L:11", (), "2024", "deputies", "CLUJ", "2024-12-21", None, "person-vlad-sorel"),
    ("g1", None, "Ema Lung", "L:12", (), "2024", "deputies", "DOLJ", "2024-12-21", None, "person-ema-lung"),
    ("h1", "p-h1", "Emil Corbu", "M:13", (), "2016", "senate", "SIBIU", "2016-12-21", "2020-12-20", "p-h"),
    ("h2", "p-h2", "Emil Corbu", "L:14", (), "2024", "senate", "SIBIU", "2024-12-21", None, "p-h"),
)
#: What the two decisions of an owner are, and whom other records refer to.
SAME, DIFFERENT, PROTECTED = (("x", "h1", "p-h"), ("x", "h2", "p-h")), (("e2", "g1"),), ("p-toma",)


def _registries(spark, sf):
    """The registry once for each supplier, its ids, names and profiles with the supplier's letters."""
    letters = F.translate(F.col("s_suppkey").cast("string"), "0123456789", "abcdefghij")
    k = table(spark, sf, "supplier").select(letters.alias("k"))
    rows = spark.createDataFrame([r[:10] for r in RECORDS], "member string, person string, name string, profile string, careers array<string>, legislature string, chamber string, constituency string, starts_on string, ends_on string")
    own = lambda c: F.concat(c, F.lit("-"), F.col("k"))
    all_ = k.join(F.broadcast(rows)).withColumns({"member": own(F.col("member")), "person": own(F.col("person")), "name": F.concat_ws(" ", "name", F.concat(F.lit("Z"), "k")), "profile": own(F.col("profile")), "careers": F.transform("careers", own)})
    members = all_.select("member", "person", "name", "profile", "careers")
    mandates = all_.select("member", "legislature", "chamber", "constituency", F.col("starts_on").cast("date").alias("starts_on"), F.col("ends_on").cast("date").alias("ends_on"))
    of = lambda rows, schema: k.join(F.broadcast(spark.createDataFrame(rows, schema))).select(*[own(F.col(c.split()[0])).alias(c.split()[0]) for c in schema.split(", ")])
    return members, mandates, of(SAME, "decision string, member string, person string"), of(DIFFERENT, "a string, b string"), of([(p,) for p in PROTECTED], "person string")


_LETTERS = "translate(cast(s_suppkey as varchar), '0123456789', 'abcdefghij')"


@query(
    "i01_resolve_people",
    f"""select member || '-' || {_LETTERS} as member, case when person like 'person-%' then person || '-z' || {_LETTERS} else person || '-' || {_LETTERS} end as person,
    case when was is null then 'unassigned' when was = person then null when person like 'person-%' then 'split' else 'merged' end as reason
    from supplier cross join {cases([(r[0], r[1], r[10]) for r in RECORDS], 'member', 'was', 'person')}""",
)
def i01_people(spark, sf):
    return I.resolve_people(*_registries(spark, sf))[0].select("member", "person", "reason")


@query(
    "i01_review_list",
    f"select 'unlinked_careers_one_person' as kind, 'p-filip-' || {_LETTERS} as subject from supplier",
)
def i01_review(spark, sf):
    """Careers that one person holds and that are kept together without evidence."""
    return I.resolve_people(*_registries(spark, sf))[1].where("kind = 'unlinked_careers_one_person'")


@query(
    "i07_group_pages",
    """select p.o_orderkey as page, case when p.o_orderkey % 3 = 0 then p.o_orderkey when p.o_orderkey % 3 = 1 and (p.o_orderkey // 3) % 5 = 0 then p.o_orderkey
    when p.o_orderkey % 3 = 2 and (p.o_orderkey // 3) % 2 = 1 then p.o_orderkey else p.o_orderkey // 3 * 3 end as "group" from orders p""",
)
def i07(spark, sf):
    """Three pages share a key: the second names another law in every fifth dossier, the third is a main page beside the first in every other."""
    k, block = F.col("o_orderkey"), F.floor(F.col("o_orderkey") / 3)
    main = (k % 3 == 0) | ((k % 3 == 2) & (block % 2 == 1))
    law = F.when(k % 3 == 0, "law 1").when((k % 3 == 1) & (block % 5 == 0), "law 2")
    return I.grouped_pages(table(spark, sf, "orders").select(k.alias("page"), main.alias("main"), law.alias("law"), F.array(F.concat(F.lit("key "), block.cast("string")), F.concat(F.lit("own "), k.cast("string"))).alias("keys")))


@query(
    "i24_merge_plan",
    """with v as (select o_custkey as member, o_orderkey as vote, cast(o_orderdate as date) as day from orders),
    g as (select c_custkey as ghost, c_custkey // 10 * 10 as target from customer where c_custkey % 10 in (1, 2)),
    s as (select c_custkey as member, case when c_custkey % 20 = 0 then date '1990-01-01' else date '1997-01-01' end as s, case when c_custkey % 30 = 0 then date '1998-06-01' else date '9999-01-01' end as e from customer where c_custkey % 10 = 0),
    d as (select ghost, target, day, exists (select 1 from s where member = target and s <= day and e >= day) as sat, vote from g join v on member = ghost)
    select ghost as old, target as survivor, count(distinct vote) as votes from d group by 1, 2 having bool_and(sat)""",
)
def i24_plan(spark, sf):
    """Voters without a seat that bear the name of a member: merged if the member sat on every day of their votes."""
    k = F.col("c_custkey")
    c = table(spark, sf, "customer")
    word = lambda n: F.translate(F.lpad(n.cast("string"), 9, "0"), "0123456789", "abcdefghij")
    name = lambda n: F.concat_ws(" ", F.concat(F.lit("x"), word(n)), F.concat(F.lit("y"), word(n)))
    ten = F.floor(k / 10) * 10
    ghosts = c.where(k % 10 <= 2).where(k % 10 > 0).select(k.alias("ghost"), name(ten).alias("name"))
    sitting = c.where(k % 10 == 0).select(k.alias("member"), F.concat_ws(" ", name(k), F.lit("Maria")).alias("name"), F.when(k % 20 == 0, _day("1990-01-01")).otherwise(_day("1997-01-01")).alias("starts_on"), F.when(k % 30 == 0, _day("1998-06-01")).alias("ends_on"))
    votes = table(spark, sf, "orders").select(F.col("o_orderkey").alias("vote"), F.to_date("o_orderdate").alias("day"), F.col("o_custkey").alias("member"))
    return E.merge_plan(ghosts, votes, sitting)
