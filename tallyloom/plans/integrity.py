"""The integrity checks (K01 to K23), each as a query over a civic record made of the driver's tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from tallyloom.operators import quality as Q
from tallyloom.plans.registry import query
from tallyloom.session import table

_DAY = "cast(o_orderdate as date)"
_PERIOD = f"{_DAY} as starts_on, case when o_orderkey % 7 = 0 then null else {_DAY} + cast(o_orderkey % 90 as int) end as ends_on"

#: Tables of the record: the table that each is made of, and its columns in the words that Spark and DuckDB share.
RECORD = {
    "legislatures": ("region", "'L' || cast(r_regionkey as string) as id, make_date(1993 + 2 * r_regionkey, 1, 1) as starts_on, make_date(1995 + 2 * r_regionkey, 1, 1) as ends_on"),
    "mandates": (
        "orders",
        f"""o_orderkey as id, o_custkey as member_id, case when o_custkey % 2 = 0 then 'senate' else 'deputies' end as chamber, {_DAY} as starts_on,
        'L' || cast(cast(least(floor((year(o_orderdate) - 1993 + case when o_orderkey % 11 = 0 then 2 else 0 end) / 2), 4) as int) as string) as legislature_id,
        case when o_orderkey % 3 = 0 then null when o_orderkey % 5 = 1 then make_date(2001, 12, 31) else {_DAY} + cast(o_orderkey % 200 as int) end as ends_on""",
    ),
    "members": (
        "customer",
        """c_custkey as id, case when c_custkey % 13 = 0 then null else cast(floor(c_custkey / 4) as bigint) end as person_id,
        case when c_custkey % 17 = 0 then c_name || ', Secretar' else c_name end as name""",
    ),
    "people": ("customer", "c_custkey as id, case when c_custkey % 19 = 0 then c_name || ',președinte' else c_name end as name"),
    "offices": ("supplier", "s_suppkey * 9 as person_id"),
    "memberships": ("orders", f"o_orderkey as id, o_custkey as member_id, o_orderpriority as group_id, {_PERIOD}"),
    "affiliations": ("orders", f"o_orderkey as id, o_custkey as member_id, case when o_orderkey % 2 = 0 then 'p-independent' else 'p-' || o_orderstatus end as party_id, {_PERIOD}"),
    "committees": ("orders", f"o_orderkey as id, o_custkey as member_id, o_orderpriority as committee_id, {_PERIOD}"),
    "roles": (
        "orders",
        f"""o_orderkey as id, o_custkey as group_id, o_custkey + 1 as chamber, case when o_orderkey % 2 = 0 then 'group' else 'bureau' end as kind,
        case when o_orderkey % 6 = 0 then 'Vicelider' when o_orderkey % 2 = 0 then 'Lider de grup' else 'Președinte al Senatului' end as title, {_PERIOD}""",
    ),
    "votes": (
        "orders",
        f"""o_orderkey as id, {_DAY} as held_on, case when o_orderkey % 10 = 0 then 'joint' when o_orderkey % 2 = 0 then 'senate' else 'deputies' end as chamber,
        case when o_orderkey % 50 = 0 then 'Vot Senat' when o_orderkey % 7 = 0 then 'O moțiune simplă' else 'Lege ' || o_orderpriority end as title,
        case when o_orderkey % 3 = 0 then 'final_adoption' when o_orderkey % 3 = 1 then 'rejection_report' else 'amendment' end as kind,
        case when o_orderkey % 4 = 0 then null else o_orderkey % 100 end as bill_id, case when o_orderkey % 9 = 0 then null else o_orderkey % 3 end as for_count,
        o_orderkey % 2 as against, 1 as abstention""",
    ),
    "individual_votes": ("lineitem", "l_orderkey as vote_id, l_suppkey as member_id, case l_returnflag when 'A' then 'for' when 'N' then 'against' else 'abstention' end as choice"),
    "bills": (
        "part",
        """p_partkey as id, case when p_partkey % 3 = 0 then null when p_partkey % 2 = 0 then 'L ' || cast(p_partkey % 700 as string) || '/2024' else 'l' || cast(p_partkey % 700 as string) || '/2024' end as senate,
        case when p_partkey % 5 = 0 then 'none' else 'PL-x ' || cast(p_partkey % 900 as string) || '/2023' end as deputies,
        case when p_partkey % 10 = 1 then 'promulgated' else 'in_progress' end as status,
        case when p_partkey % 3 = 0 then null else p_partkey end as law_number, case when p_partkey % 7 = 0 then null else p_partkey end as gazette""",
    ),
    "steps": ("lineitem", "l_orderkey * 100 + l_linenumber as id, l_partkey % 100 as bill_id, l_orderkey as vote_id"),
}


def record(spark, sf) -> Q.Tables:
    """The record as DataFrames; nothing is read until a check asks for it."""
    return {name: spark.sql(f"select {columns} from {{src}}", src=table(spark, sf, source)) for name, (source, columns) in RECORD.items()}


_END = "coalesce({}.ends_on, date '9999-12-31')"
_SQL = "with " + ", ".join(f"{name} as (select {columns} from {source})" for name, (source, columns) in RECORD.items())
_SQL += """, seated as (select m.id, m.member_id, m.legislature_id, m.chamber, m.starts_on, coalesce(m.ends_on, l.ends_on) as ends_on, l.starts_on as opens_on, p.person_id
    from mandates m join legislatures l on l.id = m.legislature_id left join members p on p.id = m.member_id),
    newest as (select * from mandates where legislature_id = (select id from legislatures order by starts_on desc limit 1))"""


def _pairs(source: str, owner: str, more: str = "") -> str:
    a, b = _END.format("a"), _END.format("b")
    return f"select a.id, b.id as other from {source} a join {source} b on a.{owner} = b.{owner} and a.id < b.id and a.starts_on < {b} and b.starts_on < {a} where true {more}"


_LED = "and a.kind = '{0}' and b.kind = '{0}' and starts_with(a.title, '{1}') and starts_with(b.title, '{1}')"

#: id and other of the rows that break each check, in the order of the declared checks.
BROKEN = (
    _pairs("memberships", "member_id"),
    _pairs("affiliations", "member_id", "and not (a.party_id = 'p-independent' and b.party_id = 'p-independent')"),
    "select g.id, null as other from memberships g where not exists (select 1 from seated s where s.member_id = g.member_id and g.starts_on between s.starts_on and s.ends_on)",
    "select a.id, b.id as other from seated a join seated b on a.person_id = b.person_id and a.id < b.id where least(a.ends_on, b.ends_on) - greatest(a.starts_on, b.starts_on) > 31",
    """select a.member_id as id, b.member_id as other from seated a join seated b on a.person_id = b.person_id and a.legislature_id = b.legislature_id and a.chamber = b.chamber
    and a.member_id < b.member_id where a.starts_on < b.ends_on and b.starts_on < a.ends_on""",
    "select id, null as other from members m where person_id is null and exists (select 1 from mandates where member_id = m.id)",
    """select i.vote_id as id, i.member_id as other from individual_votes i join votes v on v.id = i.vote_id where not exists
    (select 1 from seated s where s.member_id = i.member_id and (v.chamber = 'joint' or v.chamber = s.chamber) and v.held_on between s.starts_on and s.ends_on)""",
    "select chamber || ' ' || ends_on as id, count(*) as other from newest where ends_on is not null group by chamber, ends_on having count(*) > 10",
    """select chamber as id, count(*) as other from newest where ends_on is null group by chamber
    having (chamber = 'senate' and count(*) not between 125 and 140) or (chamber = 'deputies' and count(*) not between 315 and 335)""",
    "select id, 'members' as other from members where ends_with(name, ', Secretar') union all select id, 'people' from people where ends_with(name, ',președinte')",
    "select id, null as other from votes where title = 'Vot Senat'",
    _pairs("committees", "member_id", "and a.committee_id = b.committee_id"),
    """select key as id, count(distinct id) as other from (select id, 'senate:' || upper(replace(senate, ' ', '')) as key from bills where senate is not null
    union all select id, 'deputies:' || lower(replace(deputies, ' ', '')) from bills where deputies <> 'none') group by 1 having count(distinct id) > 1""",
    "select id, null as other from votes where bill_id is null and kind in ('final_adoption', 'rejection_report') and title not like '%moțiun%'",
    """select v.id, null as other from votes v join (select vote_id, count(*) filter (where choice = 'for') as f, count(*) filter (where choice = 'against') as a,
    count(*) filter (where choice = 'abstention') as n from individual_votes group by 1) on vote_id = v.id where f <> coalesce(for_count, -1) or a <> against or n <> abstention""",
    _pairs("roles", "group_id", _LED.format("group", "Lider de grup")),
    _pairs("roles", "chamber", _LED.format("bureau", "Președinte al ")),
    "select id, null as other from bills where status = 'promulgated' and law_number is null",
    "select id, null as other from bills where status = 'promulgated' and gazette is null",
    "select s.id, null as other from steps s join votes v on v.id = s.vote_id where v.bill_id <> s.bill_id",
    "select id, null as other from people where id not in (select person_id from members where person_id is not null union all select person_id from offices)",
    "select id, null as other from members where id not in (select member_id from mandates)",
    "select id, null as other from seated where starts_on < opens_on - 31",
)


def _oracle(n: int) -> str:
    return f"""{_SQL}, broken as ({BROKEN[n]}) select '{Q.CHECKS[n].name}' as "check", '{Q.CHECKS[n].severity}' as severity, cast(id as varchar) as id, cast(other as varchar) as other from broken"""


def _register(n: int) -> None:
    @query(f"k{n + 1:02d}_{Q.CHECKS[n].name}", _oracle(n))
    def check(spark, sf):
        return Q.run_checks(record(spark, sf), (Q.CHECKS[n],), cap=None)


for _n in range(len(Q.CHECKS)):
    _register(_n)


@query(
    "k01_integrity_checks",
    f"""{_SQL}, broken as ({" union all ".join(f"select '{c.name}' as check_name, '{c.severity}' as severity, count(*) as n from ({sql})" for c, sql in zip(Q.CHECKS, BROKEN, strict=True))})
    select check_name as "check", severity, n from broken where n > 0""",
)
def k01(spark, sf):
    """How many rows break each of the declared checks."""
    return Q.run_checks(record(spark, sf), cap=None).groupBy("check", "severity").agg(F.count("*").alias("n"))
