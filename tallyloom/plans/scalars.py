"""Scalar functions (H), rules and texts (J), merging sinks."""

from __future__ import annotations

from pyspark.sql import functions as F

from tallyloom.functions import tabular
from tallyloom.functions import text as X
from tallyloom.operators import areas
from tallyloom.operators import documents as D
from tallyloom.operators import relational as R
from tallyloom.operators import rules
from tallyloom.operators import temporal as T
from tallyloom.plans.registry import query, sql_of
from tallyloom.session import spread, table
from tallyloom.sources import readers

FOLD = "lower(translate({}, 'ăâîșşțţĂÂÎȘŞȚŢ', 'aaissttAAISSTT'))"


@query("h02_fold", f"select doc_id, md5({FOLD.format('text')}) as folded from documents")
def h02(spark, sf):
    return table(spark, sf, "documents").select("doc_id", F.md5(X.fold_ro(F.col("text"))).alias("folded"))


@query("h03_alnum_key", f"select p_partkey, regexp_replace({FOLD.format('p_name')}, '[^a-z0-9]', '', 'g') as k from part")
def h03(spark, sf):
    return table(spark, sf, "part").select("p_partkey", X.alnum_key(F.col("p_name")).alias("k"))


@query("h04_slug", f"select p_partkey, regexp_replace(regexp_replace({FOLD.format('p_type')}, '[^a-z0-9]+', '-', 'g'), '^-+|-+$', '', 'g') as slug from part")
def h04(spark, sf):
    return table(spark, sf, "part").select("p_partkey", X.slug(F.col("p_type")).alias("slug"))


@query("h05_squash", "with s as (select page_id, trim(regexp_replace(html, '\\s+', ' ', 'g')) as t from pages) select page_id, length(t) as chars, left(t, 200) as head, right(t, 200) as tail from s")
def h05(spark, sf):
    """Whole pages with single spaces: how long they are, and how they begin and end."""
    t = X.squash(F.col("html"))
    return table(spark, sf, "pages").select("page_id", F.length(t).cast("long").alias("chars"), F.left(t, F.lit(200)).alias("head"), F.right(t, F.lit(200)).alias("tail"))


@query("h05_squash_whole", "select page_id, md5(trim(regexp_replace(html, '\\s+', ' ', 'g'))) as squashed from pages")
def h05_whole(spark, sf):
    return table(spark, sf, "pages").select("page_id", F.md5(X.squash(F.col("html"))).alias("squashed"))


@query("h06_substring_by_regex", "select page_id, regexp_extract(url, 'page=([0-9]+)', 1) as page from pages")
def h06(spark, sf):
    return table(spark, sf, "pages").select("page_id", F.regexp_extract("url", "page=([0-9]+)", 1).alias("page"))


@query("h07_url_key", "select page_id, regexp_replace(regexp_replace(lower(url), '^https?://(www\\.)?', ''), '\\?nocache=true$', '') as k from pages")
def h07(spark, sf):
    return table(spark, sf, "pages").select("page_id", X.url_key(F.col("url")).alias("k"))


@query("h08_digests", "select doc_id, md5(text) as m, sha1(text) as s, sha256(text) as l from documents")
def h08(spark, sf):
    return table(spark, sf, "documents").select("doc_id", F.md5("text").alias("m"), F.sha1("text").alias("s"), F.sha2("text", 256).alias("l"))


@query("h09_one_letter_apart", "select a.n_name as x, b.n_name as y from nation a, nation b where a.n_nationkey < b.n_nationkey and a.n_regionkey = b.n_regionkey and least(length(a.n_name), length(b.n_name)) >= 6 and levenshtein(a.n_name, b.n_name) <= 1")
def h09(spark, sf):
    n = table(spark, sf, "nation")
    a, b = n.alias("a"), n.alias("b")
    on = (F.col("a.n_regionkey") == F.col("b.n_regionkey")) & (F.col("a.n_nationkey") < F.col("b.n_nationkey")) & X.one_letter_apart(F.col("a.n_name"), F.col("b.n_name"))
    return a.join(b, on).select(F.col("a.n_name").alias("x"), F.col("b.n_name").alias("y"))


@query("h10_date_parts", "select o_orderkey, cast(date_trunc('month', o_orderdate) as date) as month, cast(year(o_orderdate) as integer) as y, cast(o_orderdate as date) + 30 as later from orders")
def h10(spark, sf):
    return table(spark, sf, "orders").select("o_orderkey", F.to_date(F.date_trunc("month", "o_orderdate")).alias("month"), F.year("o_orderdate").alias("y"), F.date_add(F.to_date("o_orderdate"), 30).alias("later"))


@query("h11_whole_years", "select o_orderkey, cast(2003 - year(o_orderdate) - case when month(o_orderdate) > 3 or (month(o_orderdate) = 3 and day(o_orderdate) > 15) then 1 else 0 end as integer) as years from orders")
def h11(spark, sf):
    return table(spark, sf, "orders").select("o_orderkey", T.whole_years(F.to_date("o_orderdate"), F.lit("2003-03-15").cast("date")).alias("years"))


@query("h12_date_window", "select o_orderkey, cast(date_trunc('month', o_orderdate) as date) as first, last_day(cast(o_orderdate as date)) as last from orders")
def h12(spark, sf):
    d = F.to_date("o_orderdate")
    return table(spark, sf, "orders").select("o_orderkey", F.trunc(d, "month").alias("first"), F.last_day(d).alias("last"))


@query("h14_lei", "select p_partkey, cast(p_retailprice as decimal(16,2)) as amount from part")
def h14(spark, sf):
    printed = F.translate(F.format_number(F.col("p_retailprice").cast("decimal(16,2)"), 2), ",.", ".,")
    return table(spark, sf, "part").select("p_partkey", X.lei(printed).alias("amount"))


@query("h15_ro_date", "select o_orderkey, cast(o_orderdate as date) as d from orders")
def h15(spark, sf):
    d = F.to_date("o_orderdate")
    spoken = F.concat_ws(" ", F.dayofmonth(d).cast("string"), F.element_at(F.array(*map(F.lit, X.MONTHS)), F.month(d)), F.year(d).cast("string"))
    printed = F.when(F.col("o_orderkey") % 2 == 0, spoken).otherwise(F.date_format(d, "dd.MM.yyyy"))
    return table(spark, sf, "orders").select("o_orderkey", X.ro_date(printed).alias("d"))


@query("h16_identifier", "select o_orderkey, 'PL-x ' || o_orderkey || '/' || year(o_orderdate) as id from orders")
def h16(spark, sf):
    raw = F.concat(F.lit("pl-X nr. "), F.col("o_orderkey").cast("string"), F.lit(" / "), F.year("o_orderdate").cast("string"))
    return table(spark, sf, "orders").select("o_orderkey", X.identifier(raw).alias("id"))


@query("h17_array_position", "select o_custkey, cast(list_position(list_sort(list(o_orderkey)), max(o_orderkey)) as bigint) as at, list_sort(list(o_orderkey))[1] as first from orders group by 1")
def h17(spark, sf):
    packed = table(spark, sf, "orders").groupBy("o_custkey").agg(F.sort_array(F.collect_list("o_orderkey")).alias("a"))
    return packed.select("o_custkey", F.array_position("a", F.array_max("a")).alias("at"), F.get("a", F.lit(0)).alias("first"))


@query("h21_percentile_ramp", "select l_suppkey, a[1 + cast(floor(0.02 * (len(a) - 1)) as integer)] as low, a[1 + cast(floor(0.98 * (len(a) - 1)) as integer)] as high from (select l_suppkey, list_sort(list(l_quantity)) as a from lineitem group by 1)")
def h21(spark, sf):
    packed = table(spark, sf, "lineitem").groupBy("l_suppkey").agg(F.sort_array(F.collect_list("l_quantity")).alias("a"))
    at = lambda p: F.get("a", F.floor(p * (F.size("a") - 1)).cast("int"))
    return packed.select("l_suppkey", at(0.02).alias("low"), at(0.98).alias("high"))


@query("a12_text_chunks", "with c as (select doc_id, i, trim(substr(text, 1 + (i - 1) * 1800, 1800), ' ') as chunk from documents, lateral (select unnest(range(1, 2 + (greatest(length(text), 1) - 1) // 1800)) as i)) select doc_id, count(*) as n, cast(sum(length(chunk)) as bigint) as chars from c where chunk <> '' group by 1")
def a12(spark, sf):
    long = table(spark, sf, "documents").select("doc_id", F.explode(X.chunks(F.col("text"))).alias("c"))
    return long.groupBy("doc_id").agg(F.count("*").alias("n"), F.sum(F.length("c")).alias("chars"))


@query("a13_recordset", "select event_id, cast(json_extract_string(props, '$.k') as bigint) as k, c_name from events join customer on user_id = c_custkey")
def a13(spark, sf):
    rows = table(spark, sf, "events").select("event_id", F.col("user_id").alias("c_custkey"), F.from_json("props", "struct<k:bigint>")["k"].alias("k"))
    return rows.join(table(spark, sf, "customer").select("c_custkey", "c_name"), "c_custkey").select("event_id", "k", "c_name")


OLD = "old as (select c_custkey as k, c_acctbal as v, c_nationkey as o from customer where c_custkey % 3 <> 0)"
NEW = "new as (select c_custkey as k, -c_acctbal as v, c_nationkey as o from customer where c_custkey % 2 = 0)"


def _old_new(spark, sf):
    c = table(spark, sf, "customer").select(F.col("c_custkey").alias("k"), F.col("c_acctbal").alias("v"), F.col("c_nationkey").alias("o"))
    return c.where("k % 3 <> 0"), c.where("k % 2 = 0").withColumn("v", -F.col("v"))


@query("a14_upsert", f"with {OLD}, {NEW} select * from old where k not in (select k from new) union all select * from new")
def a14(spark, sf):
    return R.upsert(*_old_new(spark, sf), ["k"])


@query("a15_protected_upsert", f"with {OLD}, {NEW} select * from old where o = 5 or k not in (select k from new) union all select * from new where k not in (select k from old where o = 5)")
def a15(spark, sf):
    return R.upsert(*_old_new(spark, sf), ["k"], F.col("o") == 5)


@query("a16_insert_ignore", f"with {OLD}, {NEW} select * from old union all select * from new where k not in (select k from old)")
def a16(spark, sf):
    return R.insert_ignore(*_old_new(spark, sf), ["k"])


@query(
    "a17_replace_by_owner",
    """with c as (select c_custkey as k, c_acctbal as v, c_custkey // 4 as o, c_mktsegment as s from customer), new as (select k, -v as v, o from c where s = 'BUILDING')
    select k, v, o from c where o not in (select o from new) union all select * from new""",
)
def a17(spark, sf):
    """Every owner with new rows is replaced; the others keep theirs."""
    c = table(spark, sf, "customer").select(F.col("c_custkey").alias("k"), F.col("c_acctbal").alias("v"), F.floor(F.col("c_custkey") / 4).alias("o"), "c_mktsegment")
    return R.replace_by_owner(c.drop("c_mktsegment"), c.where("c_mktsegment = 'BUILDING'").select("k", (-F.col("v")).alias("v"), "o"), "o")


@query("a22_reading_interval", "with r as (select user_id, cast(ts as date) as d, event_id % 2 as age, case when event_id % 5 = 0 then event_type end as p, event_id from events) select user_id, min(d) as first_seen, max(d) as last_seen from r group by 1")
def a22(spark, sf):
    e = table(spark, sf, "events").select("user_id", F.to_date("ts").alias("first_seen"), F.to_date("ts").alias("last_seen"), F.col("event_id") % 2 == 0)
    e = e.toDF("user_id", "first_seen", "last_seen", "even")
    once = lambda df: df.groupBy("user_id").agg(F.min("first_seen").alias("first_seen"), F.max("last_seen").alias("last_seen"))
    return R.reading_interval(once(e.where("even")), once(e.where("not even")), ["user_id"], "first_seen", "last_seen", [])


@query("k35_changes", f"with {OLD}, {NEW} select new.k, 'created' as field, null as old, null as new from new left join old using (k) where old.k is null union all select new.k, 'o', cast(old.o as varchar), cast(new.o as varchar) from new join old using (k) where old.o is distinct from new.o")
def k35(spark, sf):
    old, new = _old_new(spark, sf)
    return R.changes(old, new, "k", ["o"])


@query("j02_vote_outcome", """select o_orderkey, case when o_orderkey % 6 = 0 then 'not_a_decision:attendance_check' when p * 2 <= m then 'undetermined:below_quorum'
    when o_orderkey % 6 = 1 then case when f >= p // 2 + 1 then 'passed:majority_of_present' else 'failed:majority_of_present' end
    when o_orderkey % 6 = 2 then case when f >= m // 2 + 1 then 'passed:majority_of_members' else 'failed:majority_of_members' end
    when o_orderkey % 6 = 3 then case when f >= ceil(2 * m / 3.0) then 'passed:two_thirds_of_members' else 'failed:two_thirds_of_members' end
    when f >= m // 2 + 1 then 'passed:passes_under_any_rule' when f < p // 2 + 1 then 'failed:fails_under_any_rule' else 'undetermined:depends_on_law_type' end as outcome
    from (select o_orderkey, 100 + o_orderkey % 37 as m, 40 + o_orderkey % 61 as p, o_orderkey % 83 as f from orders)""")
def j02(spark, sf):
    k = F.col("o_orderkey")
    kind = F.when(k % 6 == 0, "quorum_or_presence").when(k % 6 == 1, "amendment").otherwise("final_adoption")
    law = F.when(k % 6 == 2, "organic").when(k % 6 == 3, "constitutional")
    return table(spark, sf, "orders").select("o_orderkey", rules.vote_outcome(kind, k % 83, 40 + k % 61, 100 + k % 37, law).alias("outcome"))


@query("j05_document_class", "select page_id, case when regexp_matches(url, '#') then 'anchor' when regexp_matches(url, '[?]page=') then 'listing' else 'page' end as class from pages")
def j05(spark, sf):
    chain = (rules.Rule("anchor", "#"), rules.Rule("listing", "[?]page="))
    return table(spark, sf, "pages").select("page_id", rules.first_match(F.col("url"), chain, "page").alias("class"))


@query("j06_sections", "with l as (select doc_id, unnest(string_split(text, chr(10))) as body, generate_subscripts(string_split(text, chr(10)), 1) as i from documents), s as (select doc_id, sum(case when body like 'The %' then 1 else 0 end) over (partition by doc_id order by i rows unbounded preceding) as section, body from l) select doc_id, cast(section as bigint) as section, cast(sum(length(body)) + count(*) - 1 as bigint) as chars from s group by 1, 2")
def j06(spark, sf):
    s = D.sections(table(spark, sf, "documents"), heading="^The ")
    return s.select("doc_id", "section", F.length("body").cast("long").alias("chars"))


_BILL = """concat('Proiect de lege ', o_orderkey, chr(10), chr(10), '  Expunere', chr(13), 'Art. ', o_orderkey % 9 + 1, '.', chr(10), repeat('Cuvânt nou. ', cast(o_orderkey % 9 as int)), chr(10),
    'Punctul ', o_orderkey % 4 + 1, ') se modifică', chr(10), 'text', chr(10), case when o_orderkey % 3 = 0 then 'ANEXA nr. 2 la lege' else 'fără anexă' end)"""


@query(
    "j06_bill_parts",
    f"""with b as (select o_orderkey, {_BILL} as t, 'Proiect de lege ' || o_orderkey || chr(10) || 'Expunere' as a, 'Art. ' || (o_orderkey % 9 + 1) || '.' as h1, 'Punctul ' || (o_orderkey % 4 + 1) || ') se modifică' as h2 from orders),
    c as (select *, instr(t, h1) - 1 as s1, instr(t, h2) - 1 as s2, instr(t, 'ANEXA') - 1 as s3, trim(repeat('Cuvânt nou. ', cast(o_orderkey % 9 as int))) as w from b)
    select o_orderkey, 1 as place, 'document-1' as id, 'preamble' as part, null as number, a as body, 0 as starts, s1 as ends from c
    union all select o_orderkey, 2, 'art-' || (o_orderkey % 9 + 1) || '-2', 'article', cast(o_orderkey % 9 + 1 as varchar), h1 || case when w = '' then '' else chr(10) || w end, s1, s2 from c
    union all select o_orderkey, 3, 'punctul-' || (o_orderkey % 4 + 1) || '-se-modifica-3', 'point', cast(o_orderkey % 4 + 1 as varchar), h2 || chr(10) || 'text' || case when o_orderkey % 3 = 0 then '' else chr(10) || 'fără anexă' end, s2,
      case when s3 >= 0 then s3 else length(t) end from c
    union all select o_orderkey, 4, 'anexa-nr-2-la-lege-4', 'annex', '2', 'ANEXA nr. 2 la lege', s3, length(t) from c where s3 >= 0""",
)
def j06_parts(spark, sf):
    """A bill for each order: preamble, article, point and some annexes, with blank lines, carriage returns and spaces before lines."""
    parts = D.bill_parts(spread(table(spark, sf, "orders").select("o_orderkey"), "o_orderkey", most=50_000).select("o_orderkey", F.expr(_BILL.replace("chr(13)", "char(13)").replace("chr(10)", "char(10)")).alias("text")), "o_orderkey")
    return parts.select("o_orderkey", "place", "id", "part", "number", "body", F.col("starts").cast("int").alias("starts"), F.col("ends").cast("int").alias("ends"))


@query("j06_sections_in_sql", sql_of("j06_sections"))
def j06_sections_sql(spark, sf):
    """The same sections by a table function of SQL, once for each row of another table."""
    tabular.register(spark)
    docs = table(spark, sf, "documents").select("doc_id", "text")
    return spark.sql("select d.doc_id, s.section, cast(length(s.body) as bigint) as chars from {docs} d, lateral bill_text(d.text, 'sections', '^The ') s", docs=docs)


@query("j06_bill_parts_in_sql", sql_of("j06_bill_parts"))
def j06_parts_sql(spark, sf):
    tabular.register(spark)
    bills = spread(table(spark, sf, "orders").select("o_orderkey"), "o_orderkey", most=50_000).select("o_orderkey", F.expr(_BILL.replace("chr(13)", "char(13)").replace("chr(10)", "char(10)")).alias("text"))
    return spark.sql("select b.o_orderkey, p.place, p.id, p.part, p.number, p.body, p.starts, p.ends from {bills} b, lateral bill_text(b.text, 'parts') p", bills=bills)


_READ = """case o_orderkey % 7 when 0 then '  ' when 1 then repeat('cuvânt ', 120) when 2 then concat('Punctul 1', char(10), 'se modifică') when 3 then concat('Art. 1', char(10), repeat('x', 8001))
    when 4 then concat('Art. 1', char(10), 'a', char(10), 'art. 1', char(10), 'b') when 5 then repeat(concat('Articolul 2)', char(10), 'scurt', char(10)), 9) else 'Legea se completează astfel' end"""


@query(
    "j06_reading_quality",
    """select o_orderkey, case o_orderkey % 7 when 0 then 0 when 1 then 1 when 2 then 1 when 3 then 1 when 4 then 2 when 5 then 9 else 1 end as parts,
    case when o_orderkey % 7 in (0, 1, 6) then 'weak' else 'partial' end as quality,
    case o_orderkey % 7 when 0 then 'empty_text' when 1 then 'no_structural_headings' when 2 then 'amendment_only_document' when 3 then 'huge_section' when 4 then 'duplicate_section_heading'
      when 5 then 'duplicate_section_heading,too_many_short_sections' else 'amendment_only_document' end as warnings from orders""",
)
def j06_quality(spark, sf):
    return D.bill_reading(spread(table(spark, sf, "orders").select("o_orderkey"), "o_orderkey", most=50_000).select("o_orderkey", F.expr(_READ).alias("text")), "o_orderkey").withColumn("warnings", F.array_join("warnings", ","))


@query("j07_compare_versions", "with o as (select conv_id, role as h, max_by(text, turn) as b from conversations where turn < 2 group by 1, 2), n as (select conv_id, role as h, max_by(text, turn) as a from conversations where turn >= 1 group by 1, 2) select coalesce(o.conv_id, n.conv_id) as conv_id, coalesce(o.h, n.h) as heading, case when b is null then 'added' when a is null then 'removed' when a <> b then 'changed' else 'unchanged' end as status from o full join n on o.conv_id = n.conv_id and o.h = n.h")
def j07(spark, sf):
    c = table(spark, sf, "conversations").select("conv_id", F.col("turn").alias("section"), F.col("role").alias("heading"), F.col("text").alias("body"))
    return D.compare(c.where("section < 2"), c.where("section >= 1"), ["conv_id"])


@query("j09_reading_health", "select doc_id, case when length(text) > 0 and length(text) < 500 then true else false end as short from documents")
def j09(spark, sf):
    reasons = D.health(F.col("text"), F.lit(1))
    return table(spark, sf, "documents").select("doc_id", F.array_contains(reasons, "very_short_text").alias("short"))


@query(
    "j15_unpivot",
    """select s_suppkey, list, votes from (select s_suppkey, 'Lista A' as list, s_suppkey % 4 as votes from supplier union all select s_suppkey, 'Lista B', s_nationkey from supplier
    union all select s_suppkey, 'Lista C', cast(floor(s_acctbal) as bigint) from supplier) where votes > 0""",
)
def j15(spark, sf):
    """The lists are the columns after the last statistics; cells that are empty, zero or no number go."""
    k, text = F.col("s_suppkey"), lambda c: c.cast("long").cast("string")
    wide = table(spark, sf, "supplier").select(k, text(k * 7).alias("present"), F.lit("9").alias("f"), text(k % 4).alias("Lista A"), text(F.col("s_nationkey")).alias("Lista B"), text(F.floor("s_acctbal")).alias("Lista C"), F.lit("-").alias("Lista D"), F.lit("").alias("Lista E"))
    return readers.unpivot_lists(wide, ["s_suppkey"], "f")


@query(
    "j17_list_codes",
    """with n as (select case when p_size % 7 = 0 then '' else p_brand end as list, count(*) as votes from lineitem join part on p_partkey = l_partkey group by 1)
    select list, votes, cast(case when list = '' then 0 else row_number() over (partition by list = '' order by votes desc, list) end as integer) as code from n""",
)
def j17(spark, sf):
    """Brands are lists; some parts stand alone."""
    name = F.when(F.col("p_size") % 7 == 0, F.concat(F.lit("Candidat Independent "), "p_name")).otherwise(F.col("p_brand"))
    lists = table(spark, sf, "part").select(F.col("p_partkey").alias("l_partkey"), name.alias("list"))
    return areas.coded_lists(table(spark, sf, "lineitem").select("l_partkey").join(lists, "l_partkey").groupBy("list").agg(F.count("*").alias("votes")))
