"""Official acts and originals: decrees (J11), money (J12), sanctions (J13), names in steps (J03), authors (J10), archives and reports (A07, A09, A10, A19), filters from requests."""

from __future__ import annotations

from pyspark.sql import functions as F

from tallyloom.functions.text import MONTHS
from tallyloom.operators import decrees, finance, sanctions, steps
from tallyloom.operators import relational as R
from tallyloom.plans.people import cases, given
from tallyloom.plans.registry import query
from tallyloom.session import scratch_folder, table
from tallyloom.sources import archive
from tallyloom.sources.result_files import ResultFiles, located

#: Titles of decrees, with the kind and what the title says of somebody's coming or going.
TITLES = (
    ("pentru promulgarea Legii privind abilitarea Guvernului", "promulgation", None), ("privind desemnarea candidatului la funcția de prim-ministru", "pm_designation", None),
    ("pentru modificarea Decretului nr. 5/2020", "correction", None), ("privind grațierea unor persoane", "pardon", None), ("privind conferirea Ordinului Steaua României", "decoration", None),
    ("privind instituirea stării de urgență", "state_of_exception", None), ("privind convocarea Parlamentului", "parliament_and_referendum", None),
    ("pentru numirea unui judecător la Curtea Constituțională", "constitutional_court", "appointment"), ("privind încetarea mandatului unui judecător al Curții Constituționale", "constitutional_court", "release"),
    ("privind eliberarea din funcție a unui consilier prezidențial", "presidential_staff", "release"), ("privind Administrația Prezidențială: structura Administrației Prezidențiale", "presidential_staff", "other"),
    ("privind numirea unui membru în Consiliul Național al Audiovizualului", "state_bodies", "appointment"), ("pentru revocarea unui membru al Consiliului de Administrație", "state_bodies", "release"),
    ("pentru numirea unui membru al Guvernului", "government", "appointment"), ("privind unele măsuri de remaniere: miniștri", "government", "other"), ("privind numirea procurorului general", "judiciary_leadership", "appointment"),
    ("privind eliberarea din funcție a unui judecător", "magistrates", "release"), ("privind rechemarea unui ambasador", "diplomacy", "release"), ("privind acreditarea unui ambasador", "diplomacy", "appointment"),
    ("privind înaintarea în gradul de general", "military", "appointment"), ("privind trecerea în rezervă a unor ofițeri", "military", "release"), ("privind altceva", "other", None),
)


@query("j11_decree_kinds", f"select o_orderkey, kind, action from orders join {cases([(i, *t[1:]) for i, t in enumerate(TITLES)], 'i', 'kind', 'action')} on i = o_orderkey % {len(TITLES)}")
def j11_kinds(spark, sf):
    rows = given(spark, sf, [(t[0],) for t in TITLES], ["subject"])
    rows = rows.withColumn("kind", decrees.decree_kind(F.col("subject")))
    return rows.select("o_orderkey", "kind", decrees.title_action(F.col("kind"), F.col("subject")).alias("action"))


#: What stands in braces in the texts below, by columns of orders: people, a country, a body, a number, a year, and amounts as printed and as numbers.
_LETTERS = "translate(cast({} as {}), '0123456789', 'abcdefghij')"
_AMOUNT = "lpad(cast(o_custkey % 1000 as {}), 3, '0')", "lpad(cast(o_orderkey % 100 as {}), 2, '0')"


def _slots(text: str) -> dict[str, str]:
    """The values of the braces in the SQL of either engine; text is what it calls a string."""
    letters = lambda c: _LETTERS.format(c, text)
    number = lambda n: f"cast(o_orderkey % 7 + {n} as {text})"
    h, c = (x.format(text) for x in _AMOUNT)
    return {
        "a": f"concat('Mira T', {letters('o_custkey')})", "b": f"concat('Horia-Dan V', {letters('o_orderkey')})", "c": f"concat('Zoe P', {letters('o_custkey % 97')})", "land": f"concat('Insula M', {letters('o_custkey % 50')})",
        "body": f"concat('pentru t', {letters('o_custkey % 30')})", "grp": f"concat('G', upper({letters('o_custkey % 20')}))", "n": f"cast(o_orderkey % 900 + 100 as {text})", "y": f"cast(extract(year from o_orderdate) as {text})",
        "m": f"concat({number(1)}, '.', {h}, ',', {c})", "m2": f"concat({number(3)}, '.', {h}, ',', {c})", "M": f"concat({number(1)}, {h}, '.', {c})", "M2": f"concat({number(3)}, {h}, '.', {c})",
    }


def _fill_sql(column: str) -> str:
    for k, v in _slots("varchar").items():
        column = f"replace({column}, '{{{k}}}', {v})"
    return column


def _filled(spark, sf, rows, columns):
    """Every order with the texts of its number modulo their count, their braces filled from its columns. What fills one holds no brace, so those that no text has are passed over."""
    out = given(spark, sf, rows, columns, also=("o_custkey", "o_orderdate"))
    for k, v in _slots("string").items():
        if has := [c for i, c in enumerate(columns) if any(f"{{{k}}}" in str(r[i]) for r in rows)]:
            out = out.withColumns({c: F.replace(c, F.lit(f"{{{k}}}"), F.expr(v)) for c in has})
    return out


_TAIL = " PREȘEDINTELE ROMÂNIEI NUME PRENUME București, 1 ianuarie 2000. Nr. 1."
#: Kind of decree, its text, and the people that it names: name, action, office, title.
TEXTS = (
    ("government", "PREȘEDINTELE ROMÂNIEI În temeiul art. 85, Președintele României decretează: + ARTICOL UNIC Doamna {a} se numește în funcția de ministru al apelor." + _TAIL, (("{a}", "appointment", "minister", "ministru al apelor"),)),
    ("government", "d e c r e t e a z ă : Articolul 1 Se revocă din funcția de ministru al energiei, la cerere, domnul dr. {b}. Articolul 2 Doamna {a} se desemnează ca ministru interimar al energiei." + _TAIL, (("{b}", "dismissal", "minister", "ministru al energiei"), ("{a}", "interim", "minister", None))),
    ("diplomacy", "decretează: + ARTICOL UNIC Doamna {c} se recheamă din calitatea de ambasador extraordinar și plenipotențiar al României în {land}." + _TAIL, (("{c}", "recall", "ambassador", "ambasador extraordinar și plenipotențiar al României în {land}"),)),
    ("diplomacy", "decretează: Domnul {b} își va încheia misiunea în termen de cel mult {n} de zile." + _TAIL, (("{b}", "release", "ambassador", None),)),
    ("judiciary_leadership", "decretează: + Articolul 1 Domnul {b} se numește în funcția de procuror-șef al Direcției Naționale Anticorupție, pe o perioadă de 3 ani. Articolul 2 Doamna {c}, în locul domnului {b}, se numește în funcția de vicepreședinte al Înaltei Curți." + _TAIL, (("{b}", "appointment", "dna-chief", "procuror-șef al Direcției Naționale Anticorupție"), ("{c}", "appointment", "iccj-vice-president", "vicepreședinte al Înaltei Curți"))),
    ("constitutional_court", "decretează: Doamna profesor universitar dr. {a} se numește judecător la Curtea Constituțională." + _TAIL, (("{a}", "appointment", "ccr-judge", None),)),
    ("presidential_staff", "decretează: Se ia act de demisia domnului {b} din funcția de consilier prezidențial." + _TAIL, (("{b}", "resignation", "presidential-adviser", "consilier prezidențial"),)),
    ("decoration", "decretează: Domnul {b} se decorează." + _TAIL, ()),
    ("government", "Domnul {b} se numește." + _TAIL, ()),
)


@query("j11_named_people", f"select o_orderkey, {_fill_sql('name')} as name, action, office, {_fill_sql('title')} as title from orders join {cases([(i, *p) for i, t in enumerate(TEXTS) for p in t[2]], 'i', 'name', 'action', 'office', 'title')} on i = o_orderkey % {len(TEXTS)}")
def j11_people(spark, sf):
    rows = _filled(spark, sf, [t[:2] for t in TEXTS], ["kind", "text"])
    return decrees.named_people(rows, "o_orderkey", "kind", "text").select("o_orderkey", "name", "action", "office", "title")


@query(
    "j11_decree_heads",
    f"""with h as (select *, 1000 + o_orderkey % 900 as number, cast(o_orderdate as date) as d, 'privind numirea unui ' || lower(o_orderpriority) as subject, o_custkey % 999 + 1 as gazette, {_slots("varchar")["b"]} as b from orders)
    select o_orderkey, case when o_orderkey % 2 = 0 then number end as number, case when o_orderkey % 2 = 0 then d end as issued_on, case when o_orderkey % 2 = 0 then subject end as subject,
    case when o_orderkey % 2 = 0 then gazette::varchar end as gazette_number, case when o_orderkey % 2 = 0 then d + 1 end as gazette_on,
    case when o_orderkey % 3 < 2 then upper(b) end as signer, case when o_orderkey % 3 = 0 then false when o_orderkey % 3 = 1 then true end as interim from h""",
)
def j11_heads(spark, sf):
    """Heads of decrees numbered and dated by orders, of laws beside them, and signatures of presidents, acting ones and nobody."""
    k, d = F.col("o_orderkey"), F.to_date("o_orderdate")
    months = F.array(*[F.lit(m) for m in MONTHS])
    on = lambda day: F.concat(F.dayofmonth(day).cast("string"), F.lit(" "), F.get(months, F.month(day) - 1), F.lit(" "), F.year(day).cast("string"))
    head = F.concat(
        F.lit("DECRET nr. 1."), F.lpad((k % 900).cast("string"), 3, "0"), F.lit(" din "), on(d), F.lit(" privind numirea unui "), F.lower("o_orderpriority"),
        F.lit(" EMITENT Președintele României PUBLICAT ÎN Monitorul Oficial nr. "), (F.col("o_custkey") % 999 + 1).cast("string"), F.lit(" din "), on(F.date_add(d, 1)),
    )
    title = F.when(k % 2 == 0, head).otherwise("LEGE nr. 4 din 1 mai 2020 EMITENT Parlamentul")
    name = F.upper(F.expr(_slots("string")["b"]))
    signed = F.when(k % 3 == 0, F.concat(F.lit("x PREȘEDINTELE ROMÂNIEI "), name, F.lit(" București, 22"))).when(k % 3 == 1, F.concat(F.lit("x PREŞEDINTELE ROMÂNIEI - interimar - "), name, F.lit(" În temeiul art. 100 alin. (2)"))).otherwise("fără semnătură")
    return decrees.read_heads(table(spark, sf, "orders").select(k, title.alias("title"), signed.alias("text"))).drop("title", "text")


#: Control reports of each shape and what they say: party, year, income, number of lines, lines of dues, expenses, whether the lines add up, articles, fine.
REPORTS = (
    ("RAPORT privind veniturile și cheltuielile Partidului Râului {land} în anul {y} EMITENT. Partidul Râului {land} a obținut în anul {y} venituri aferente activității curente în sumă totală de {m2} lei, astfel: {m} lei reprezentând venituri din cotizații, 1.900,00 lei reprezentând donații și 100,00 lei reprezentând dobânzi. Cheltuielile aferente activității curente au fost în sumă totală de {m} lei. În urma controlului au fost încălcate prevederile art. 3 alin. (2), art. 5 și ale art. 7 din Legea nr. 334/2006.",
     (("Partidul Râului {land}", "{y}", "{M2}", 3, "{M}", "{M}", True, 3, None),)),
    ("RAPORT. În anul 2001, veniturile obținute de Uniunea Câmpiei {land} au fost în valoare totală de {m2} lei, după cum urmează: – 2.000,00 lei - venituri din subvenții, din care: – 1.200,00 lei - subvenții de la bugetul de stat; – 800,00 lei - rambursare; – {m} lei - venituri din cotizații; În anul 2002, veniturile obținute de Uniunea Câmpiei {land} au fost în valoare totală de {m} lei, după cum urmează: – 7,00 lei - împrumuturi. Cheltuielile efectuate în anul 2001 de Uniunea Câmpiei {land} sunt în cuantum de {m2} lei. II. Sancțiuni: a fost sancționat cu amendă în cuantum de {n} lei.",
     (("Uniunea Câmpiei {land}", "2001", "{M2}", 3, "{M}", "{M2}", True, 0, "{n}"), ("Uniunea Câmpiei {land}", "2002", "{M}", 1, None, None, False, 0, "{n}"))),
    ("RAPORT despre altceva", ()),
)


@query(
    "j12_control_reports",
    f"""select o_orderkey, {_fill_sql('party')} as party, cast({_fill_sql('year')} as int) as year, cast({_fill_sql('income')} as decimal(16,2)) as income, lines, cast({_fill_sql('dues')} as decimal(16,2)) as dues, cast({_fill_sql('expenses')} as decimal(16,2)) as expenses, adds_up, violations, cast({_fill_sql('fine')} as decimal(16,2)) as fine
    from orders join {cases([(i, *y) for i, r in enumerate(REPORTS) for y in r[1]], 'i', 'party', 'year', 'income', 'lines', 'dues', 'expenses', 'adds_up', 'violations', 'fine')} on i = o_orderkey % {len(REPORTS)}""",
)
def j12(spark, sf):
    rows = _filled(spark, sf, [(r[0],) for r in REPORTS], ["text"])
    told = finance.sanctions(F.col("text"))
    years = rows.select("o_orderkey", F.size(told["violations"]).alias("violations"), told["fine"].alias("fine"), F.explode(finance.annual(F.col("text"))).alias("y"))
    dues = F.get(F.filter("y.lines", lambda x: x["kind"] == "dues"), F.lit(0))["lei"]
    return years.select("o_orderkey", "y.party", "y.year", "y.income", F.size("y.lines").alias("lines"), dues.alias("dues"), "y.expenses", "y.adds_up", "violations", "fine")


#: Reports that tell in sentences, and of each year what they say: party, year, income, lines, the first line's kind and amount, expenses, whether it adds up, and the note.
SENTENCES = (
    ("RAPORT privind veniturile și cheltuielile Uniunii Câmpiei {land} în anii 2001 și 2002 EMITENT. Cuprins: Constatări. Constatări: Pentru anul 2001 veniturile Uniunii Câmpiei {land} au totalizat {m2} lei, fiind obținute din cotizații în sumă de {m} lei, donații în sumă de 2.000,00 lei. Cheltuielile au fost în sumă de {m} lei. Formațiunea politică nu a declarat venituri și cheltuieli pentru anul 2002. În urma controlului efectuat nu s-au aplicat sancțiuni.",
     (("Uniunea Câmpiei {land}", "2001", "{M2}", 2, "dues", "{M}", "{M}", True, None), ("Uniunea Câmpiei {land}", "2002", None, 0, None, None, None, False, "not_declared"))),
    ("RAPORT privind veniturile și cheltuielile Partidului Râului {land} în anul {y} EMITENT. Constatări: Partidul a avut venituri în cuantum de {m} lei și nu a avut cheltuieli. II. Sancțiuni aplicate.",
     (("Partidul Râului {land}", "{y}", "{M}", 0, None, None, "0", False, None),)),
    ("RAPORT privind veniturile și cheltuielile Partidului Râului {land} în anii 2003-2004 EMITENT. Constatări: Partidul nu a obținut venituri în anul 2003 și a efectuat cheltuieli în sumă de {n},50 lei. Veniturile în anul 2004 au fost în valoare totală de {m} lei. Cheltuielile totale au totalizat {m2} lei. Partidul nu a depus pentru anul 2004 toate acele documente. București, 1.",
     (("Partidul Râului {land}", "2003", "0", 0, None, None, "{n}.50", True, "none"), ("Partidul Râului {land}", "2004", "{M}", 0, None, None, "{M2}", False, "not_submitted"))),
    ("RAPORT despre altceva. Constatări: Nimic.", ()),
)


@query(
    "j12_sentence_reports",
    f"""select o_orderkey, {_fill_sql('party')} as party, cast({_fill_sql('year')} as int) as year, cast({_fill_sql('income')} as decimal(16,2)) as income, lines, kind, cast({_fill_sql('amount')} as decimal(16,2)) as amount,
    cast({_fill_sql('expenses')} as decimal(16,2)) as expenses, adds_up, note from orders
    join {cases([(i, *y) for i, r in enumerate(SENTENCES) for y in r[1]], 'i', 'party', 'year', 'income', 'lines', 'kind', 'amount', 'expenses', 'adds_up', 'note')} on i = o_orderkey % {len(SENTENCES)}""",
)
def j12_sentences(spark, sf):
    rows = finance.sentence_reports(_filled(spark, sf, [(r[0],) for r in SENTENCES], ["text"]), "o_orderkey", "text")
    first = F.get("lines", F.lit(0))
    return rows.select("o_orderkey", "party", "year", "income", F.size("lines").alias("lines"), first["kind"].alias("kind"), first["lei"].alias("amount"), "expenses", "adds_up", "note")


#: Campaign reports: party, kind of election, year, contributions, expenses, asked for, invalidated, warned.
CAMPAIGNS = (
    ("privind verificarea legalității veniturilor și cheltuielilor electorale ale Partidului Râului {land}, cu ocazia alegerilor pentru Senat și Camera Deputaților din anul {y}. Constatări: – contribuțiile electorale au fost în cuantum de {m2} lei; – cheltuielile electorale au fost în cuantum de {m} lei. Suma cheltuielilor solicitate în vederea rambursării este de {m} lei. Comisia a invalidat suma de {n},50 lei.", "Partidul Râului {land}", "parliamentary", "{y}", "{M2}", "{M}", "{M}", "{n}.50", False),
    ("veniturilor și cheltuielilor electorale ale Uniunii Câmpiei {land}, aferente campaniei electorale pentru alegerea autorităților administrației publice locale din anul {y}: nu au fost înregistrate venituri și cheltuieli electorale. A fost sancționat cu avertisment.", "Uniunea Câmpiei {land}", "local", "{y}", "0.00", "0.00", None, None, True),
    ("un alt raport", None, None, None, None, None, None, None, None),
)


@query(
    "j12_campaign_reports",
    f"""select o_orderkey, {_fill_sql('party')} as party, kind, cast({_fill_sql('year')} as int) as year, cast({_fill_sql('contributions')} as decimal(16,2)) as contributions, cast({_fill_sql('expenses')} as decimal(16,2)) as expenses, cast({_fill_sql('requested')} as decimal(16,2)) as requested, cast({_fill_sql('invalidated')} as decimal(16,2)) as invalidated, warned
    from orders join {cases([(i, *c[1:]) for i, c in enumerate(CAMPAIGNS)], 'i', 'party', 'kind', 'year', 'contributions', 'expenses', 'requested', 'invalidated', 'warned')} on i = o_orderkey % {len(CAMPAIGNS)}""",
)
def j12_campaign(spark, sf):
    rows = _filled(spark, sf, [(c[0],) for c in CAMPAIGNS], ["text"])
    return rows.select("o_orderkey", finance.campaign(F.col("text")).alias("c")).select("o_orderkey", "c.*")


_PAGE = """<div><p><b>12 iunie 2023 - Atenționarea domnului deputat {b}, membru al Grupului parlamentar al {land}, în conformitate cu art. {n} alin. (1) din Regulamentul Camerei</b>
<a href="/d/{n}.pdf">vezi decizia Nr.{n}/23-03-2023</a> <a href='/c.pdf'>vezi contestația</a> <b>HCD 12/2023 privind respingerea contestației</b> <a href="/s{n}.htm">vezi stenograma</a><hr>
<b>3 mai 2022 - Aplicarea sancțiunii diminuării indemnizației cu 50% pe o perioadă de trei luni și retragerea cuvântului doamnei deputat {a} pentru abateri</b><hr/>
<b>1 mai 2022 - Informare privind adoptarea unor Hotărârilor</b><hr><b>Deciziile Biroului permanent privind sancționarea doamnei deputat {c}</b><hr><i>nimic</i></div>"""
#: The entries of the page above.
ENTRIES = (
    (0, "2023-06-12", "{b}", "{land}", "warning", None, None, "art. {n} alin. (1)", False, "{n}", "2023-03-23", "/d/{n}.pdf", "rejected", "/s{n}.htm"),
    (1, "2022-05-03", "{a}", None, "combined", 50, 3, None, False, None, None, None, None, None),
    (2, "2022-05-01", None, None, "other", None, None, None, True, None, None, None, None, None),
    (3, None, "{c}", None, "bureau_decision", None, None, None, False, None, None, None, None, None),
)


@query(
    "j13_sanctions",
    f"""select o_orderkey as legislature, "at", cast(held_on as date) as held_on, {_fill_sql('name')} as name, {_fill_sql('"group"')} as "group", kind, percent, months, {_fill_sql('article')} as article, informational, {_fill_sql('decision_number')} as decision_number,
    cast(decision_on as date) as decision_on, {_fill_sql('decision_url')} as decision_url, outcome, {_fill_sql('stenogram_url')} as stenogram_url, true as well_named
    from orders cross join {cases(ENTRIES, '"at"', 'held_on', 'name', '"group"', 'kind', 'percent', 'months', 'article', 'informational', 'decision_number', 'decision_on', 'decision_url', 'outcome', 'stenogram_url')}""",
)
def j13(spark, sf):
    """A page of sanctions for each order, its people, groups, articles and decisions by the order's columns."""
    rows = sanctions.sanctions(_filled(spark, sf, [(_PAGE,)], ["html"]).withColumnRenamed("o_orderkey", "legislature"))
    cut = F.get(F.filter("parts", lambda p: p["kind"] == "allowance_reduced"), F.lit(0))
    named = F.rlike("id", F.lit("^sanction-[0-9]+-[0-9a-f]{12}$"))
    return rows.select("legislature", "at", "held_on", "name", "group", "kind", cut["percent"].alias("percent"), cut["months"].alias("months"), "article", "informational", "decision_number", "decision_on", "decision_url", "outcome", "stenogram_url", named.alias("well_named"))


#: Steps as printed, with the committee and the body that they name.
STEPS = (
    ("Trimis pentru raport la Comisia {body}, de disciplină (termen: 10.05.2024)", "Comisia {body}, de disciplină", None), ("trimis pentru aviz la: Consiliul {body}", None, "Consiliul {body}"),
    ("Solicitare punct de vedere de la Guvern", None, "Guvernul României"), ("Solicitare punct de vedere de la Banca {body}", None, "Banca {body}"), ("Solicitare aviz de la Consiliul Legislativ", None, "Consiliul Legislativ"),
    ("primire aviz de la Consiliul Legislativ - cu nr. {n}/2024 (favorabil)", None, "Consiliul Legislativ"), ("primire aviz de la Comisia {body}", "Comisia {body}", None), ("Comisia {body} transmite avizul cu nr. {n}-favorabil", "Comisia {body}", None),
    ("Comisiile reunite depune raportul cu nr. {n}", "Comisiile reunite", None), ("Curtea {body} transmite avizul", None, "Curtea {body}"), ("trimis pentru raport privind legea, la Comisia {body}", "Comisia {body}", None),
    ("solicitarea Comisiei: stabilirii competentei, Comisia {body} nr.{n}/2024", "Comisia {body}", None), ("înregistrat la Senat", None, None),
)


@query("j03_step_names", f"select o_orderkey, {_fill_sql('committee')} as committee, {_fill_sql('institution')} as institution from orders join {cases([(i, *s[1:]) for i, s in enumerate(STEPS)], 'i', 'committee', 'institution')} on i = o_orderkey % {len(STEPS)}")
def j03_names(spark, sf):
    return steps.typed(_filled(spark, sf, [(s[0],) for s in STEPS], ["text"])).select("o_orderkey", "committee", "institution")


_ANNEX = "AMENDAMENTE ADMISE\nAutori: {b}, deputat {grp}, {a}, deputat MUNTE\n(Amendament propus de doamna deputat {c} – deputat DEAL) și Ilie VAD, senator neafiliat "
#: The authors that the annex above names, in order.
AUTHORS = (("{b}", "deputy", "{grp}"), ("{a}", "deputy", "MUNTE"), ("{c}", "deputy", "DEAL"), ("Ilie VAD", "senator", "neafiliat"))


@query(
    "j10_report_authors",
    f"select o_orderkey as report_id, {_fill_sql('name')} as name, role, {_fill_sql('party')} as party from orders cross join {cases(AUTHORS, 'name', 'role', 'party')} where o_orderkey % 3 <> 0",
)
def j10_authors(spark, sf):
    """Reports of three pages: the authors stand in an annex, and are named again on its last page."""
    body = F.lit("Raport asupra proiectului, Ioan NIMENI, deputat XYZ " * 3)
    rows = _filled(spark, sf, [(_ANNEX,)], ["annex"]).where("o_orderkey % 3 <> 0")
    pages = F.array(*[F.struct(F.lit(i + 1).alias("page"), t.alias("text")) for i, t in enumerate((body, F.concat("annex", F.lit("cuvinte obișnuite " * 5)), F.lit("Ilie VAD, senator MUNTE " + "și altele " * 10)))])
    rows = rows.select(F.col("o_orderkey").alias("report_id"), F.explode(pages).alias("p")).select("report_id", "p.*")
    return steps.report_authors(rows).select("report_id", "name", "role", "party")


_CELL = "<c r=\"{c}{r}\" t=\"inlineStr\"><is><t>{v}</t></is></c>"


def _workbook(rows: list[list]) -> bytes:
    """A workbook of one sheet, as small as one can be."""
    import io
    import zipfile

    cells = lambda r, row: "".join(f'<c r="{chr(65 + i)}{r}"><v>{v}</v></c>' if isinstance(v, (int, float)) else _CELL.format(c=chr(65 + i), r=r, v=v) for i, v in enumerate(row) if v is not None)
    sheet = "".join(f'<row r="{r}">{cells(r, row)}</row>' for r, row in enumerate(rows, 1))
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        z.writestr("xl/worksheets/sheet1.xml", f'<worksheet xmlns="http://schemas.openxmlformats.org/spreadsheetml/2006/main"><sheetData>{sheet}</sheetData></worksheet>')
    return out.getvalue()


@query("a07_workbooks", "select s_nationkey as file, s_suppkey as key, s_name as name, cast(floor(s_acctbal) as bigint) as votes from supplier")
def a07(spark, sf):
    """A workbook for each nation's suppliers, read back."""
    import pandas as pd

    def made(part: pd.DataFrame) -> pd.DataFrame:
        rows = [["key", "name", None, "votes"], *([int(k), n, None, float(v)] for k, n, v in zip(part["s_suppkey"], part["s_name"], part["v"], strict=True))]
        return pd.DataFrame({"path": part["s_nationkey"].iloc[:1].astype(str), "content": [_workbook(rows)]})

    s = table(spark, sf, "supplier").select("s_nationkey", "s_suppkey", "s_name", F.floor("s_acctbal").cast("double").alias("v"))
    cells = archive.workbooks(s.groupBy("s_nationkey").applyInPandas(made, "path string, content binary")).where("row > 0")
    at = lambda i: F.get("cells", F.lit(i))
    return cells.select(F.col("file").cast("int").alias("file"), at(0).cast("long").alias("key"), at(1).alias("name"), at(3).cast("double").cast("long").alias("votes"))


def _book(path: str, books) -> None:
    """A workbook with a sheet for each of books (name, rows), texts among the shared strings."""
    import zipfile
    from xml.sax.saxutils import escape

    known: dict[str, int] = {}
    word = lambda v: known.setdefault(str(v), len(known))
    cell = lambda i, r, v: f'<c r="{chr(65 + i)}{r}"><v>{v}</v></c>' if isinstance(v, (int, float)) else f'<c r="{chr(65 + i)}{r}" t="s"><v>{word(v)}</v></c>'
    main, rel = 'xmlns="http://schemas.openxmlformats.org/spreadsheetml/2006/main"', "http://schemas.openxmlformats.org/officeDocument/2006/relationships"
    fs, at = located(path)
    fs.create_dir(at.rsplit("/", 1)[0], recursive=True)
    with fs.open_output_stream(at) as out, zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as z:
        for k, (_, rows) in enumerate(books, 1):
            body = "".join(f'<row r="{r}">{"".join(cell(i, r, v) for i, v in enumerate(row) if v is not None)}</row>' for r, row in enumerate(rows, 1))
            z.writestr(f"xl/worksheets/sheet{k}.xml", f"<worksheet {main}><sheetData>{body}</sheetData></worksheet>")
        z.writestr("xl/workbook.xml", f'<workbook {main} xmlns:r="{rel}"><sheets>{"".join(f"""<sheet name="{escape(n)}" sheetId="{k}" r:id="rId{k}"/>""" for k, (n, _) in enumerate(books, 1))}</sheets></workbook>')
        z.writestr("xl/_rels/workbook.xml.rels", f'<Relationships xmlns="http://schemas.openxmlformats.org/package/2006/relationships">{"".join(f"""<Relationship Id="rId{k}" Type="{rel}/worksheet" Target="worksheets/sheet{k}.xml"/>""" for k in range(1, len(books) + 1))}</Relationships>')
        z.writestr("xl/sharedStrings.xml", f"<sst {main}>{''.join(f'<si><t>{escape(w)}</t></si>' for w in known)}</sst>")


@query(
    "a07_result_files",
    """select 'books' as kind, r_name || '.xlsx' as file, n_name as sheet, s_suppkey as key, s_name as name, cast(floor(s_acctbal) as bigint) as votes from supplier join nation on n_nationkey = s_nationkey join region on r_regionkey = n_regionkey
    union all select 'texts', n_name || '.csv', null, c_custkey, c_name || '; "ț"', cast(floor(c_acctbal) as bigint) from customer join nation on n_nationkey = c_nationkey""",
)
def a07_files(spark, sf):
    """A workbook for each region with a sheet for each nation's suppliers, and texts of customers in three encodings, all read back by one format."""
    import codecs

    import pandas as pd

    at = scratch_folder(spark, "result-files")

    def books(part: pd.DataFrame) -> pd.DataFrame:
        made = [(n, [["key", "name", None, "votes"], *([int(k), s, None, float(v)] for k, s, v in zip(x["s_suppkey"], x["s_name"], x["v"], strict=True))]) for n, x in part.groupby("n_name")]
        _book(f"{at}/books/{part['r_name'].iloc[0]}.xlsx", made)
        return pd.DataFrame({"file": part["r_name"].iloc[:1]})

    def texts(part: pd.DataFrame) -> pd.DataFrame:
        nation, kind = part["n_name"].iloc[0], int(part["c_nationkey"].iloc[0]) % 3
        rows = ["key;name;;votes", *(f'{k};"{n}; ""ț""";;{v}' for k, n, v in zip(part["c_custkey"], part["c_name"], part["v"], strict=True)), "", ";;;"]
        data = "\r\n".join(rows)
        fs, folder = located(f"{at}/texts")
        fs.create_dir(folder, recursive=True)
        with fs.open_output_stream(f"{folder}/{nation}.csv") as out:
            out.write([data.encode("utf-8-sig"), codecs.BOM_UTF16_LE + data.encode("utf-16-le"), data.replace("ț", "ţ").encode("cp1250")][kind])
        return pd.DataFrame({"file": [nation]})

    nation = table(spark, sf, "nation")
    s = table(spark, sf, "supplier").join(nation, F.col("n_nationkey") == F.col("s_nationkey")).join(table(spark, sf, "region"), F.col("r_regionkey") == F.col("n_regionkey"))
    s.select("r_name", "n_name", "s_suppkey", "s_name", F.floor("s_acctbal").cast("double").alias("v")).groupBy("r_name").applyInPandas(books, "file string").write.format("noop").mode("overwrite").save()
    c = table(spark, sf, "customer").join(nation, F.col("n_nationkey") == F.col("c_nationkey"))
    c.select("n_name", "c_nationkey", "c_custkey", "c_name", F.floor("c_acctbal").cast("long").alias("v")).groupBy("n_name").applyInPandas(texts, "file string").write.format("noop").mode("overwrite").save()
    spark.dataSource.register(ResultFiles)
    cell = lambda i: F.get("cells", F.lit(i))
    read = lambda kind: spark.read.format("result_files").load(f"{at}/{kind}").where("row > 0").select(F.lit(kind).alias("kind"), "file", "sheet", cell(0).cast("long").alias("key"), F.replace(cell(1), F.lit("ţ"), F.lit("ț")).alias("name"), cell(3).cast("long").alias("votes"))
    return read("books").unionByName(read("texts"))


@query(
    "a09_day_lists",
    """with r as (select cast(o_orderdate as date) as day, o_orderkey, o_orderkey % 4 as c, o_orderkey % 7 as f, o_orderkey % 5 as g, o_orderkey % 3 as a, o_orderkey % 2 as n from orders)
    select day, o_orderkey as id, day as held_on, '10:30' as time, case c when 0 then 'joint' when 1 then 'senate' when 2 then 'deputies' else 'unknown' end as chamber, case when o_orderkey % 6 = 0 then null else f + g + a + n end as present,
    f as "for", g as against, o_orderkey % 10 = 0 as test, case when o_orderkey % 6 = 0 then null else true end as consistent from r""",
)
def a09(spark, sf):
    """Official lists of each day's votes as XML: some rows lack a count, some are test ballots; days without votes are empty."""
    k = F.col("o_orderkey")
    tag = lambda name, c: F.concat(F.lit(f"<{name}>"), c, F.lit(f"</{name}>"))
    n = lambda m: (k % m).cast("string")
    present = F.when(k % 6 == 0, "?").otherwise((k % 7 + k % 5 + k % 3 + k % 2).cast("string"))
    day = F.to_date("o_orderdate")
    row = tag("ROW", F.concat(
        tag("VOTID", k.cast("string")), tag("TIME_VOT", F.concat(F.date_format(day, "dd.MM.yyyy"), F.lit(" 10:30"))), tag("DESCRIERE", F.when(k % 10 == 0, "Vot test").otherwise("Lege &amp; altele")), tag("CAMERA", n(4)),
        tag("PREZENTI", present), tag("NU_AU_VOTAT", n(2)), tag("AU_VOTAT_DA", n(7)), tag("AU_VOTAT_NU", n(5)), tag("AU_VOTAT_AB", n(3)),
    ))
    days = table(spark, sf, "orders").select(day.alias("day"), row.alias("row")).groupBy("day").agg(tag("ROWSET", F.array_join(F.collect_list("row"), "")).alias("xml"))
    empty = spark.sql("select date '2030-01-01' as day, ' ' as xml")
    return archive.day_votes(days.unionByName(empty), "day", "xml").select("day", "id", "held_on", "time", "chamber", "present", "for", "against", "test", "consistent")


@query(
    "a09_portal_acts",
    """select o_custkey as answer, case o_orderkey % 3 when 0 then 'DECRET' when 1 then 'LEGE' else '' end as type, case when o_orderkey % 4 = 0 then 'Președintele & "alții"' else 'Parlamentul <României>' end as issuer,
    'privind ' || lower(o_orderpriority) || ' nr. ' || o_orderkey as title, case when o_orderkey % 5 = 0 then '' else 'http://portal/' || o_orderkey || '?a=1&b=2' end as link, 'Art. 1 ' || o_orderstatus as text from orders""",
)
def a09_acts(spark, sf):
    """The acts in a portal's answers, one answer for each customer's orders; between them stand other elements."""
    k = F.col("o_orderkey")
    text = lambda c: F.replace(F.replace(F.replace(F.replace(c, F.lit("&"), F.lit("&amp;")), F.lit("<"), F.lit("&lt;")), F.lit(">"), F.lit("&gt;")), F.lit('"'), F.lit("&quot;"))
    tag = lambda name, c: F.concat(F.lit(f"<a:{name}>"), text(c), F.lit(f"</a:{name}>"))
    act = F.concat(
        F.lit("<a:Legi>\n"), tag("TipAct", F.when(k % 3 == 0, "DECRET").when(k % 3 == 1, "LEGE").otherwise("")), tag("Emitent", F.when(k % 4 == 0, 'Președintele & "alții"').otherwise("Parlamentul <României>")),
        tag("Titlu", F.concat(F.lit("  privind\n "), F.lower("o_orderpriority"), F.lit(" nr.\t"), k.cast("string"), F.lit(" "))), tag("LinkHtml", F.when(k % 5 == 0, "").otherwise(F.concat(F.lit("http://portal/"), k.cast("string"), F.lit("?a=1&b=2")))),
        tag("Text", F.concat(F.lit("Art. 1\n\n"), "o_orderstatus")), F.lit("</a:Legi>"),
    )
    answers = table(spark, sf, "orders").groupBy(F.col("o_custkey").alias("answer")).agg(F.concat(F.lit("<s:Envelope><Pagina>1</Pagina>"), F.array_join(F.collect_list(act), "<b/>"), F.lit("</s:Envelope>")).alias("xml"))
    return archive.acts(answers, "answer", "xml")


@query(
    "a10_raw_pages",
    """select case when page_id % 3 = 0 then 'list' else 'page' end as kind, 'k' || page_id as key, case when page_id % 4 = 0 then 2 else 1 end as version, strlen(coalesce(html, '')) as bytes, sha256(coalesce(html, '')) as sha256 from pages""",
)
def a10(spark, sf):
    """Pages into the archive twice, some of them fetched again; the latest of each is read back byte for byte."""
    at = scratch_folder(spark, "raw")
    k = F.col("page_id")
    p = table(spark, sf, "pages").select(F.when(k % 3 == 0, "list").otherwise("page").alias("kind"), F.concat(F.lit("k"), k.cast("string")).alias("key"), "url", F.coalesce("html", F.lit("")).cast("binary").alias("body"), k.alias("n"))
    archive.keep_pages(p.withColumns({"fetched_at": F.lit("2024-01-01").cast("timestamp"), "version": F.lit(1)}).drop("n"), at)
    archive.keep_pages(p.where("n % 4 = 0").withColumns({"fetched_at": F.lit("2024-02-01").cast("timestamp"), "version": F.lit(2)}).drop("n"), at)
    again = archive.kept_pages(spark, at)
    return again.select("kind", "key", "version", F.octet_length("body").cast("long").alias("bytes"), F.sha2("body", 256).alias("sha256"))


@query(
    "a19_report",
    """with t as (select o_orderstatus as chamber, count(*) as official, count(*) filter (where o_orderkey % 7 <> 0) as held from orders group by 1),
    l as (select chamber, '| ' || chamber || ' | ' || official || ' | ' || held || ' |' as line from t)
    select cast(row_number() over (order by chamber) + 1 as integer) as at, line from l union all select 0, '| Chamber | Official | Held |' union all select 1, '| --- | ---: | ---: |'""",
)
def a19(spark, sf):
    """A coverage report written as JSON and Markdown; the Markdown is read back."""
    at = scratch_folder(spark, "report")
    by = table(spark, sf, "orders").groupBy(F.col("o_orderstatus").alias("chamber")).agg(F.count("*").alias("official"), F.count_if(F.col("o_orderkey") % 7 != 0).alias("held"))
    headings = {"chamber": "Chamber", "official": "Official", "held": "Held"}
    archive.write_report(by, at, headings, ["chamber"])
    told = spark.read.text(f"{at}/markdown").select(F.col("value").alias("line"))
    assert spark.read.json(f"{at}/json").count() == told.count() - 2
    return archive.markdown(by, headings, ["chamber"]).join(told, "line", "left_semi").select("at", "line")


@query(
    "b04_request_filters",
    """with r as (select o_orderkey as request, o_orderkey % 5 as k, year(o_orderdate) as y, month(o_orderdate) as m, o_orderstatus as s, lower(o_orderpriority) as w, o_custkey % 60 - 10 as n from orders)
    select request, case when k in (0, 3) then y::varchar end as year, case when k in (0, 1, 4) then m::varchar when k = 2 and m <= 2 then (m + 10)::varchar end as month, case when k < 3 then s end as chamber, case when k <> 4 then w end as q,
    case when k = 1 then 10 else least(30, greatest(1, n)) end as "limit" from r""",
)
def b04(spark, sf):
    """A request of each order: years and months as people write them, some not valid, a chamber, words between spaces, and a limit."""
    k, o = F.col("o_orderkey") % 5, table(spark, sf, "orders")
    y, m = F.year("o_orderdate").cast("string"), F.month("o_orderdate").cast("string")
    raw = {
        "year": F.when(k.isin(0, 3), y).when(k == 1, F.right(y, F.lit(2))).when(k == 2, F.concat(y, F.lit("x"))),
        "month": F.when(k == 0, m).when(k == 1, F.lpad(m, 2, "0")).when(k == 2, (F.month("o_orderdate") + 10).cast("string")).when(k == 3, F.concat(m, F.lit(".5"))).otherwise(F.concat(F.lit("00"), m)),
        "chamber": F.when(k < 3, F.col("o_orderstatus")).when(k == 3, F.lower("o_orderstatus")),
        "q": F.when(k == 4, F.lit("  ")).otherwise(F.concat(F.lit(" "), F.lower("o_orderpriority"), F.lit("  "))),
    }
    limit = F.when(k == 1, F.lit("many")).otherwise((F.col("o_custkey") % 60 - 10).cast("string"))
    found = R.request_columns(raw, {"chamber": ("F", "O", "P")})
    return o.select(F.col("o_orderkey").alias("request"), *[c.alias(n) for n, c in found.items()], R.clamped(limit).alias("limit"))
