"""Reports on party money (J12): what a control report says of income, expenses, breaches and sanctions, and of a campaign.

Figures are read from the sentences that give them and never estimated; a text of another shape gives nothing.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tallyloom.functions.text import fold_ro, lei, squash
from tallyloom.operators.rules import Rule, first_match

# Where money came from, by the words of a line, in order of precedence.
INCOME_KINDS = (
    Rule("refund", "rambursare"),
    Rule("subsidy", "subven|bugetul de stat"),
    Rule("dues", "cotiza"),
    Rule("donations", "donat"),
    Rule("loans", "imprumut"),
    Rule("other", "fara scop patrimonial"),
    Rule("interest", "dobanz"),
)
# Which election a campaign report is about, by the words of its title, in order of precedence.
ELECTION_KINDS = (
    Rule("european", "parlamentul european|membrilor din romania"),
    Rule("presidential", "presedintele|presedintelui|prezidentiale"),
    Rule("parliamentary", "senat"),
    Rule("local_partial", "partiale"),
    Rule("local", "locale|administratiei publice"),
)
# Wording of the reports.
_AMOUNT = r"([\d.]+,\d{2})"
_TOTAL = rf"(?is)venituri(?:\s+aferente\s+activității\s+curente)?\s+în\s+sumă\s+totală\s+de\s+{_AMOUNT}\s+lei(?:\s*,?\s*astfel\s*:)?(.*?)(?:Cheltuielile\b|$)"
_LINE = rf"(?s){_AMOUNT}\s+lei\s*(?:reprezentând|-|–)\s*(.*?)(?=,?\s*(?:și\s+)?[\d.]+,\d{{2}}\s+lei|\.\s*$|$)"
_EXPENSES = rf"(?i)Cheltuielile[^.]*?\s+au\s+fost\s+în\s+sumă\s+totală\s+de\s+{_AMOUNT}\s+lei"
_HEAD = r"(?i)veniturile\s+(?:și|si)\s+cheltuielile\s+(.+?)\s+în\s+anul\s+(\d{4})"
_NAMED = r"(?:înregistrate\s+(?:în\s+activitatea\s+curentă\s+)?de|constatat\s+că)\s+((?:Partidul|Alianța|Uniunea|Organizația|Forumul|Asociația|Federația|Comunitatea)\s+.{3,120}?)(?:\s+în\s+(?:anul|anii|perioada)|\s+a\s+obținut)"
_YEAR = rf"(?s)În\s+anul\s+(\d{{4}}),\s+veniturile\s+obținute\s+de\s+(.+?)\s+au\s+fost\s+în\s+valoare\s+totală\s+de\s+{_AMOUNT}\s+lei,?\s*după\s+cum\s+urmează\s*:(.*?)(?=În\s+anul\s+\d{{4}},\s+veniturile|Cheltuielile\s+efectuate|II\.\s*Sancțiuni|$)"
_SPENT = rf"Cheltuielile\s+efectuate\s+în\s+anul\s+(\d{{4}})\s+de\s+.+?\s+sunt\s+în\s+cuantum\s+de\s+{_AMOUNT}\s+lei"
_BROKEN = r"(?i)(?:au\s+fost\s+încălcate\s+prevederile|pentru\s+nerespectarea\s+prevederilor)\s+(.+?)\s+din\s+Legea\s+nr\.\s*334/2006"
_CLEAN = r"(?i)nu\s+s-au\s+constatat\s+încălcări|II\.\s*Sancțiuni\s+aplicate\s+Nu\s+a\s+fost\s+cazul"
_FINE = r"(?i)sancționat[ăa]?\s+cu\s+amendă\s+în\s+(?:cuantum|sumă)\s+de\s+([\d.]+(?:,\d{2})?)\s+(?:de\s+)?lei"
_TAKEN = rf"(?i)confiscarea\s+sumei\s+de\s+{_AMOUNT}\s+lei"
_CAMPAIGN = r"(?is)veniturilor\s+și\s+cheltuielilor\s+electorale\s+(?:ale|efectuate\s+de)\s+(.+?),?\s+(?:efectuate\s+)?(?:cu\s+ocazia|aferente\s+campaniei\s+electorale(?:\s+desfășurate)?\s+pentru)\s+(.+?\d{4})(?!\d)"
# Wording of reports that tell in sentences.
_SUM = r"([\d.]+(?:,\d{1,2})?)"
_TITLES = (
    r"(?i)veniturile\s+și\s+cheltuielile\s+(?:înregistrate\s+(?:în\s+activitatea\s+curentă\s+)?de\s+)?(.+?)\s+în\s+(?:anul|anii|perioada)",
    r"(?i)veniturilor\s+și\s+cheltuielilor\s+(?!electorale\b)(?:înregistrate\s+(?:în\s+activitatea\s+curentă\s+)?de\s+|ale\s+)?(.+?)\s+în\s+(?:anul|anii|perioada)",
)
_RANGES = (r"perioada(?:\s+controlată,?\s+respectiv|\s+verificată\s+fiind)?\s+\d{1,2}\.\d{1,2}\.(\d{4})\s*-\s*\d{1,2}\.\d{1,2}\.(\d{4})", r"anii\s+(\d{4})\s*-\s*(\d{4})")
_YEARS = r"(?:anul|anii|anului)\s+(\d{4})(?:\s*(?:și|şi)\s*(?:în\s+anul\s+)?(\d{4}))?"
_HAD = rf"(?i)a\s+avut\s+venituri\s+în\s+cuantum\s+de\s+{_SUM}\s+lei(\s+și\s+nu\s+a\s+avut\s+cheltuieli)?"
_INCOME = rf"(?is)veniturile.*?(?:au\s+totalizat|în\s+cuantum\s+total\s+de|în\s+valoare\s+totală\s+de)\s+{_SUM}\s+lei(.*)$"
_ITEM = rf"(?s)(.*?)în\s+sumă\s+de\s+{_SUM}\s+lei"
_LEADS = r"(?i)^[\s,]*(?:și\s+au\s+fost\s+obținute\s+din\s+|și\s+|fiind\s+obținute\s+din\s+|din\s+care\s*:\s*|obținute\s+din\s+)*"
_PAID = rf"(?i)^\s*Cheltuielile(?:\s+totale)?(?:\s+în\s+anul\s+(\d{{4}}))?\s+(?:au\s+fost\s+în\s+sumă\s+de|au\s+totalizat)\s+{_SUM}\s+lei"
_NONE = r"(?is)nu\s+a\s+(?:avut|înregistrat|obținut)\s+venituri|nu\s+a\s+avut\s+activitate\s+financiar|s-a\s+înființat.*?nu\s+a\s+avut\s+venituri"
_SPENT_IN = rf"(?i)efectuat\s+cheltuieli\s+în\s+sumă\s+de\s+{_SUM}\s+lei"
_WITHHELD = r"(?is)nu\s+a\s+(?:transmis|depus)\b(?:(?!raportul\s+detaliat).){0,200}?documente|nu\s+a\s+pus\s+la\s+dispoziția\s+echipei\s+de\s+control(?!\s+toate\b)|nu\s+au\s+fost\s+puse\s+la\s+dispoziția\s+echipei\s+de\s+control"
_UNDECLARED = r"(?i)nu\s+a\s+declarat\s+venituri"
GENITIVES = {"Partidului": "Partidul", "Uniunii": "Uniunea", "Alianței": "Alianța", "Organizației": "Organizația", "Forumului": "Forumul", "Asociației": "Asociația", "Federației": "Federația", "Comunității": "Comunitatea"}
LINES = "array<struct<label:string,kind:string,lei:decimal(16,2)>>"


def income_kind(label: Column) -> Column:
    return first_match(fold_ro(label), INCOME_KINDS, "other")


def _part(text: Column, pattern: str, i: int) -> Column:
    return F.nullif(F.regexp_extract(text, pattern, i), F.lit(""))


def party_name(c: Column) -> Column:
    """A party as it is called: what follows the name off, the genitive of a title turned back."""
    out = squash(F.regexp_replace(F.regexp_replace(c, r"(?i)\s*-?\s*extras\b.*$|\s+efectuate\b.*$|\s+în\s+(?:anul|anii|perioada)\b.*$", ""), r"[\s,.;:-]+$", ""))
    for genitive, name in GENITIVES.items():
        out = F.regexp_replace(out, rf"(?i)^{genitive}(?:\s+politic)?\b", name)
    return out


def _lines(body: Column) -> Column:
    """Lines of a list in running text: an amount and what it represents."""
    amounts, labels = F.regexp_extract_all(body, F.lit(_LINE), F.lit(1)), F.regexp_extract_all(body, F.lit(_LINE), F.lit(2))
    each = F.transform(F.arrays_zip(amounts.alias("a"), labels.alias("l")), lambda x: F.struct(F.regexp_replace(squash(x["l"]), r"[.,;\s]+$", "").alias("label"), x["a"].alias("a")))
    told = F.filter(each, lambda x: x["label"] != "")
    return F.transform(told, lambda x: F.struct(x["label"].alias("label"), income_kind(x["label"]).alias("kind"), lei(x["a"]).alias("lei"))).cast(LINES)


def _bullets(body: Column) -> Column:
    """Lines after dashes; what follows `din care:` is part of that line, which isn't counted itself."""
    pieces = F.slice(F.split(F.regexp_replace(body, r"\s*\.\.\.\s*", " "), r"\s*–\s*(?=\d[\d.]*,\d{2}\s+lei)"), 2, 10_000)
    pattern = rf"^{_AMOUNT}\s+lei\s*[-–]\s*(.*?)\s*[;:.]*\s*$"
    read = F.filter(F.transform(pieces, lambda p: F.struct(lei(F.regexp_extract(F.btrim(p), pattern, 1)).alias("lei"), squash(F.regexp_extract(F.btrim(p), pattern, 2)).alias("label"))), lambda x: x["lei"].isNotNull())

    def step(acc: Column, x: Column) -> Column:
        line = F.struct(x["label"].alias("label"), income_kind(x["label"]).alias("kind"), x["lei"].alias("lei"))
        child, parent = acc["left"] > 0.05, F.rlike(x["label"], F.lit(r"(?i)din care\s*:?$"))
        left = F.when(child, acc["left"] - x["lei"].cast("double")).when(parent, x["lei"].cast("double")).otherwise(0.0)
        return F.struct(left.alias("left"), F.when(child | ~parent, F.concat(acc["out"], F.array(line))).otherwise(acc["out"]).alias("out"))

    return F.aggregate(read, F.struct(F.lit(0.0).alias("left"), F.array().cast(LINES).alias("out")), step, lambda acc: acc["out"])


def _sum(lines: Column) -> Column:
    return F.aggregate(lines, F.lit(0).cast("decimal(18,2)"), lambda n, x: (n + x["lei"]).cast("decimal(18,2)"))


def sanctions(text: Column) -> dict[str, Column]:
    """violations (articles), clean, fine and confiscated."""
    listed = F.split(_part(text, _BROKEN, 1), r",\s*(?=(?:ale\s+)?art\.)|\s+și\s+(?:ale\s+)?(?=art\.)")
    articles = F.filter(F.transform(listed, lambda p: F.btrim(F.regexp_replace(squash(p), "^ale ", ""))), lambda p: p != "")
    return {"violations": F.coalesce(articles, F.array().cast("array<string>")), "clean": F.rlike(text, F.lit(_CLEAN)), "fine": lei(_part(text, _FINE, 1)), "confiscated": lei(_part(text, _TAKEN, 1))}


def annual(text: Column) -> Column:
    """Years of a control report: array<struct<party, year, income, lines, expenses, adds_up>>, empty for a text of no known shape.

    One year in a sentence with its list, or a paragraph with dashes for each year.
    """
    year_type = f"struct<party:string,year:int,income:decimal(16,2),lines:{LINES},expenses:decimal(16,2),adds_up:boolean>"

    def year(party: Column, y: Column, income: Column, lines: Column, expenses: Column) -> Column:
        near = (F.size(lines) > 0) & (F.abs(_sum(lines) - income) < 0.05)
        return F.struct(party.alias("party"), y.cast("int").alias("year"), income.alias("income"), lines.alias("lines"), expenses.alias("expenses"), F.coalesce(near, F.lit(False)).alias("adds_up")).cast(year_type)

    party = party_name(F.coalesce(_part(text, _NAMED, 1), F.regexp_extract(text, _HEAD, 1)))
    single = year(party, F.regexp_extract(text, _HEAD, 2).try_cast("int"), lei(_part(text, _TOTAL, 1)), _lines(F.regexp_extract(text, _TOTAL, 2)), lei(_part(text, _EXPENSES, 1)))
    part = lambda i: F.regexp_extract_all(text, F.lit(_YEAR), F.lit(i))
    spent = F.map_from_entries(F.arrays_zip(F.array_distinct(F.regexp_extract_all(text, F.lit(_SPENT), F.lit(1))).alias("k"), F.regexp_extract_all(text, F.lit(_SPENT), F.lit(2)).alias("v")))
    rows = F.arrays_zip(part(1).alias("y"), part(2).alias("p"), part(3).alias("a"), part(4).alias("b"))
    paragraphs = F.transform(rows, lambda r: year(squash(r["p"]), r["y"], lei(r["a"]), _bullets(r["b"]), lei(F.element_at(spent, r["y"]))))
    known = (F.rlike(text, F.lit(_HEAD)) | F.rlike(text, F.lit(_NAMED))) & F.rlike(text, F.lit(_TOTAL))
    return F.when(known, F.array(single)).otherwise(paragraphs)


def years_of(text: Column) -> Column:
    """The years that a title or a sentence names, a range spelt out."""
    number = lambda p, i: F.regexp_extract(text, p, i).try_cast("int")
    one, two = (F.regexp_extract_all(text, F.lit(_YEARS), F.lit(i)) for i in (1, 2))
    listed = F.flatten(F.transform(F.arrays_zip(one.alias("a"), two.alias("b")), lambda x: F.array(x["a"].try_cast("int"), x["b"].try_cast("int"))))
    out = F.array_distinct(F.array_compact(listed))
    for p in reversed(_RANGES):
        # a range that goes backwards is none
        out = F.when(number(p, 1).isNotNull(), F.when(number(p, 1) <= number(p, 2), F.sequence(number(p, 1), number(p, 2))).otherwise(F.array().cast("array<int>"))).otherwise(out)
    return out


def sentence_reports(reports: DataFrame, key: str, text: str) -> DataFrame:
    """Years of control reports that tell in sentences: key, party, year, income, lines, expenses, adds_up, note (not_submitted, not_declared, none).

    The findings follow the last word "Constatări". A sentence gives what it says to the year that it names, or else to the one that the sentences before it
    speak of, which is carried along the report; what a later sentence says of a year holds. Reports without a title or findings give nothing.
    """
    t = F.col(text)
    party = F.coalesce(*[F.nullif(F.regexp_extract(t, p, 1), F.lit("")) for p in _TITLES])
    heading = F.regexp_extract(t, r"(?s)RAPORT.*?(?:în\s+(?:anul|anii|perioada).*?)(?=EMITENT)", 0)
    findings = F.regexp_replace(F.regexp_extract(t, r"(?s).*(Constat[aă]ri\s*:?.*)$", 1), r"(?s)(?:În\s+urma\s+controlului\s+efectuat|II\.\s*Sancțiuni|București,\s+\d).*$", "")
    told = reports.select(key, party_name(party).alias("party"), years_of(heading).alias("years"), F.posexplode(F.split(findings, r"\.\s+(?=[A-ZĂÂÎȘȚ])")).alias("at", "s")).where("party is not null and s <> ''")
    s = F.col("s")
    named = years_of(F.regexp_replace(s, r"^.*?(?=\bpentru\s+anul)", ""))
    had, income, paid = s.rlike(_HAD), s.rlike(_INCOME), s.rlike(_PAID)
    kind = F.when(had, "had").when(income, "income").when(paid, "paid").otherwise("note")
    w = W.partitionBy(key).orderBy("at").rowsBetween(W.unboundedPreceding, W.currentRow)
    told = told.withColumns({"named": named, "of": kind})
    speaks = F.col("of").isin("had", "income")
    told = told.withColumns({"carried": F.last(F.when(speaks, F.get("named", F.lit(0))), ignorenulls=True).over(w), "spoken": F.max(speaks).over(w)})
    title, single = F.get("years", F.lit(0)), F.when(F.size("years") == 1, F.get("years", F.lit(0)))
    current = F.coalesce("carried", single, F.when(F.col("spoken"), title))
    explicit = F.regexp_extract(s, _PAID, 1).try_cast("int")
    year = F.when(speaks, F.array(F.coalesce(F.col("carried"), single, title))).when(F.col("of") == "paid", F.array(F.coalesce(explicit, current))).otherwise(F.when(F.size("named") > 0, F.col("named")).otherwise(F.col("years")))
    # what the sentence says
    none = s.rlike(_NONE)
    note = F.when(s.rlike(_WITHHELD), "not_submitted").when(s.rlike(_UNDECLARED), "not_declared").when(none, "none")
    amount = F.when(had, lei(F.regexp_extract(s, _HAD, 1))).when(income, lei(F.regexp_extract(s, _INCOME, 1))).when((F.col("of") == "note") & none, F.lit(0).cast("decimal(16,2)"))
    tail = F.when(F.col("of") == "income", F.regexp_extract(s, _INCOME, 2))
    items = F.arrays_zip(F.regexp_extract_all(tail, F.lit(_ITEM), F.lit(1)).alias("l"), F.regexp_extract_all(tail, F.lit(_ITEM), F.lit(2)).alias("a"))
    label = lambda x: F.btrim(F.regexp_replace(F.regexp_replace(x["l"], _LEADS, ""), r"[\s,]+$", ""))
    lines = F.transform(F.filter(items, lambda x: label(x) != ""), lambda x: F.struct(label(x).alias("label"), income_kind(label(x)).alias("kind"), lei(x["a"]).alias("lei"))).cast(LINES)
    spent = F.when(had & (F.regexp_extract(s, _HAD, 2) != ""), F.lit(0).cast("decimal(16,2)")).when(F.col("of") == "paid", lei(F.regexp_extract(s, _PAID, 2)))
    spent = spent.when((F.col("of") == "note") & none, F.coalesce(lei(F.nullif(F.regexp_extract(s, _SPENT_IN, 1), F.lit(""))), F.lit(0).cast("decimal(16,2)")))
    said = told.select(key, "party", "at", F.explode(F.array_compact(year)).alias("year"), amount.alias("income"), F.coalesce(lines, F.array().cast(LINES)).alias("lines"), spent.alias("expenses"), F.when(F.col("of") == "note", note).alias("note"), "of")
    said = said.where((F.col("of") != "note") | F.col("note").isNotNull())
    last = lambda c: F.max_by(c, F.when(F.col(c).isNotNull(), F.col("at")))
    by = said.groupBy(key, "party", "year").agg(last("income").alias("income"), F.flatten(F.transform(F.sort_array(F.collect_list(F.struct("at", "lines"))), lambda x: x["lines"])).alias("lines"), last("expenses").alias("expenses"), last("note").alias("note"), F.bool_or((F.col("of") == "note") & (F.col("income") == 0)).alias("__none"))
    adds_up = (F.size("lines") > 0) & (F.abs(_sum(F.col("lines")) - F.col("income")) < 0.05)
    return by.select(key, "party", "year", "income", "lines", "expenses", (F.coalesce(adds_up, F.lit(False)) | F.coalesce("__none", F.lit(False))).alias("adds_up"), "note")


def campaign(text: Column) -> Column:
    """A campaign report: struct<party, kind, year, contributions, expenses, requested, invalidated, warned>; null where the title is not one."""
    amount = r"([\d.]+(?:,\d{1,2})?)(?:\s*\([^)]*\))?"
    none = F.rlike(text, F.lit(r"(?i)nu\s+(?:au\s+fost|a)\s+înregistrat(?:e)?\s+venituri\s+și\s+cheltuieli\s+electorale|nu\s+a\s+înregistrat\s+venituri\s+și\s+nu\s+a\s+(?:angajat|efectuat)\s+cheltuieli"))
    zero = F.when(none, F.lit(0).cast("decimal(16,2)"))
    of = lambda p: lei(_part(text, p, 1))
    election = _part(text, _CAMPAIGN, 2)
    kind = first_match(fold_ro(election), ELECTION_KINDS, "other")
    told = F.struct(
        party_name(F.regexp_extract(text, _CAMPAIGN, 1)).alias("party"),
        kind.alias("kind"),
        F.regexp_extract(election, r"(\d{4})", 1).try_cast("int").alias("year"),
        F.coalesce(of(rf"(?i)(?:contribuțiile|veniturile)\s+electorale\s+au\s+fost\s+în\s+cuantum(?:\s+total)?\s+de\s+{amount}\s+lei"), zero).alias("contributions"),
        F.coalesce(of(rf"(?i)cheltuielile\s+electorale\s+au\s+fost\s+în\s+cuantum(?:\s+total)?\s+de\s+{amount}\s+lei"), zero).alias("expenses"),
        of(rf"(?is)solicitate\s+în\s+vederea\s+rambursării.{{0,200}}?(?:este|a\s+fost)\s+de\s+{amount}\s+lei").alias("requested"),
        of(rf"(?i)a\s+invalidat\s+suma\s+de\s+{amount}\s+lei").alias("invalidated"),
        F.rlike(text, F.lit(r"(?i)sancționat[ăa]?\s+cu\s+avertisment")).alias("warned"),
    )
    return F.when(election.isNotNull(), told)
