"""Steps and fates of dossiers (J03, J04), report readings (J10), logos (I10) and progress bars."""

from __future__ import annotations

from pyspark.sql import functions as F

from tallyloom.operators import logos, steps
from tallyloom.operators import quality as Q
from tallyloom.plans.registry import query
from tallyloom.session import table

#: A wording of each kind, with what has to be read from it: text, type, chamber, verdict, votes for, deadline, document number.
WORDINGS = (
    ("Înregistrat la Senat pentru dezbatere", "registered", "senate", None, None, None, None),
    ("Trimis pentru raport la: Comisia juridică (termen: 6/09/2025)", "sent_to_committee", None, None, None, "2025-09-06", None),
    ("Trimis pentru aviz la Consiliul Legislativ", "opinion_requested", None, None, None, None, None),
    ("Primire aviz de la Comisia pentru buget - cu nr. 12 (nefavorabil)", "committee_opinion_received", None, "unfavorable", None, None, "12"),
    ("Primire raport favorabil (3 amend. admise) de la:", "committee_report_received", None, "favorable_with_amendments", None, None, None),
    ("Adoptat de Camera Deputaţilor pentru=284, contra=1", "adopted", "deputies", None, 284, None, None),
    ("Respinsă de Senat  pentru = 7", "rejected", "senate", None, 7, None, None),
    ("Promulgat prin Decret nr. 1150/12.12.2025", "promulgation", None, None, None, None, None),
    ("Devine Legea nr. 238/12.12.2025", "promulgation", None, None, None, None, None),
    ("Publicată în Monitorul Oficial nr. 1171/17.12.2025", "published", None, None, None, None, None),
    ("Retras de către inițiator", "withdrawn", None, None, None, None, None),
    ("Încetarea procedurii legislative", "procedure_ended", None, None, None, None, None),
    ("Cu totul altceva", "other", None, None, None, None, None),
)
_TEXT = "case cast(o_orderkey % 13 as int) " + " ".join(f"when {i} then '{w[0]}'" for i, w in enumerate(WORDINGS)) + " end"


def _steps(spark, sf):
    rows = table(spark, sf, "orders").select((F.col("o_custkey")).alias("bill_id"), F.to_date("o_orderdate").alias("occurred_on"), F.col("o_orderkey").alias("ord"), F.expr(_TEXT).alias("text"))
    return steps.typed(rows)


def _literal(v: object) -> str:
    return "null" if v is None else str(v) if isinstance(v, int) else f"'{v}'"


@query(
    "j03_step_kinds",
    f"""with w(n, type, chamber, verdict, votes_for, deadline_on, document_number) as (values {", ".join(f"({i}, {', '.join(map(_literal, w[1:]))})" for i, w in enumerate(WORDINGS))})
    select o_orderkey as ord, type, n <> 12 as recognised, chamber, verdict, votes_for, deadline_on, document_number from orders join w on n = o_orderkey % 13""",
)
def j03(spark, sf):
    return _steps(spark, sf).select("ord", "type", "recognised", "chamber", "verdict", "votes_for", "deadline_on", "document_number")


@query(
    "j04_fates",
    """with s as (select o_custkey as c, cast(o_orderdate as date) as d, o_orderkey % 13 as k from orders),
    a as (select c, max(d) as last_on, min(d) filter (where k = 8) as law, min(d) filter (where k in (7, 8)) as prom, max(d) filter (where k = 10) as gone,
        max(d) filter (where k = 6) as rej, max(d) filter (where k = 11) as done, bool_or(k = 7) as decree, bool_or(k = 9) as gazette from s group by 1),
    b as (select c_custkey as bill_id, c_custkey % 11 = 0 as stated, c_custkey % 2 = 0 as senate, a.* from customer left join a on c = c_custkey),
    o as (select *, case when stated or prom is not null then 'promulgated' when gone is not null then 'withdrawn' when senate and rej is not null then 'rejected' when done >= last_on then 'ended' else 'in_progress' end as outcome from b)
    select bill_id, outcome, case outcome when 'promulgated' then case when law is not null then date '2025-12-12' else prom end when 'withdrawn' then gone when 'rejected' then rej when 'ended' then done end as outcome_on,
    case when law is not null then '238' when stated then '53' end as law_number, case when law is not null then 2025 when stated then 2026 end as law_year,
    case when decree then '1150' end as decree_number, case when gazette then '1171' end as gazette_number from o""",
)
def j04(spark, sf):
    k = F.col("c_custkey")
    bills = table(spark, sf, "customer").select(k.alias("bill_id"), F.when(k % 11 == 0, "Lege 53/2026").alias("stage"), F.when(k % 2 == 0, "senate").otherwise("deputies").alias("decision_chamber"))
    return steps.fates(_steps(spark, sf), bills)


@query(
    "j10_report_readings",
    r"""with p as (select doc_id % 50 as report_id, length(regexp_replace(coalesce(text, ''), '[ \t-\r]', '', 'g')) as chars, regexp_extract_all(coalesce(text, ''), '[^ \t-\r]+') as w from documents),
    q as (select report_id, count(*) as pages, sum(chars) as chars, sum(len(w)) as words, sum(len(list_filter(w, lambda x: regexp_matches(x, '[~^|`{}<>]|[A-Za-z][0-9][A-Za-z]')))) as bad from p group by 1)
    select report_id, pages, round(100 * bad / words, 1) as garbled_percent, case when chars < 40 * pages then 'none' when 100 * bad / words > 2 then 'poor' else 'clean' end as quality,
    null::bigint as admitted_page, null::bigint as rejected_page from q""",
)
def j10(spark, sf):
    pages = table(spark, sf, "documents").select((F.col("doc_id") % 50).alias("report_id"), F.col("doc_id").alias("page"), "text")
    return steps.report_readings(pages)


@query(
    "i10_logos",
    """with e as (select year(l_shipdate) as leg, (l_partkey % 40) * 100 + l_suppkey % 40 + l_linenumber % 3 // 2 as h, case when l_orderkey % 50 = 0 then null when l_orderkey % 15 = 1 then 99 else l_suppkey % 40 end as p from lineitem),
    t as (select leg, h, p, count(*) as n from e where p is not null group by 1, 2, 3), x as (select h, count(distinct p) = 1 as ex from t group by 1),
    l as (select leg, h, arg_min(p, (-n, p)) as p, max(n) as n, sum(n) as total, count(*) as parties from t group by 1, 2),
    c as (select l.*, n / total as share, case when total >= 3 and n / total >= 0.9 then 'confident'
        when total < 3 and parties = 1 and ex and leg = (select max(leg) from e) then 'weak' end as confidence from l join x using (h))
    select p as party_id, leg as legislature_id, h as content_hash, n as profiles, share, confidence from c where confidence is not null qualify row_number() over (partition by p order by leg desc, n desc, h) = 1""",
)
def i10(spark, sf):
    image = (F.col("l_partkey") % 40) * 100 + F.col("l_suppkey") % 40 + F.floor(F.col("l_linenumber") % 3 / 2)
    party = F.when(F.col("l_orderkey") % 50 == 0, None).when(F.col("l_orderkey") % 15 == 1, F.lit(99)).otherwise(F.col("l_suppkey") % 40)
    return logos.picked(table(spark, sf, "lineitem").select(F.year("l_shipdate").alias("legislature_id"), image.alias("content_hash"), party.alias("party_id")))


@query(
    "k37_progress",
    """with c as (select o_orderstatus as area, o_orderpriority as item, count(*) filter (where o_orderkey % 7 <> 0) as have, count(*) filter (where o_orderkey % 3 <> 0) as total from orders group by 1, 2)
    select area, item, have, total, cast(floor(least(have, total) * 100 / total) as int) as percent, greatest(total - have, 0) as missing from c where total > 0""",
)
def k37(spark, sf):
    k = F.col("o_orderkey")
    by = table(spark, sf, "orders").groupBy(F.col("o_orderstatus").alias("area"), F.col("o_orderpriority").alias("item"))
    return Q.progress(by.agg(F.count_if(k % 7 != 0).alias("have"), F.count_if(k % 3 != 0).alias("total")))
