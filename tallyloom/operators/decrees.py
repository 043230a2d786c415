"""Presidential decrees (J11): their kind by the title, the people they name, what is done to them and the office it concerns."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyloom.functions.text import display, fold_ro, ro_date, squash
from tallyloom.operators.rules import Rule, first_match

# The kind that a decree's title tells, in order of precedence. Titles are folded.
DECREE_KINDS = (
    Rule("promulgation", r"\bpromulgarea\b"),
    Rule("pm_designation", r"desemnarea candidatului la functia de prim-?ministru"),
    Rule("correction", r"\b(rectificarea|modificarea decretului|abrogarea decretului|revocarea decretului|completarea decretului)\b"),
    Rule("pardon", r"\bgrati(e|er|ind)|\bgratiat|comutarea pedepsei|\bcereri de gratiere"),
    Rule("decoration", r"\bconferirea\b|\bdecorarea\b|\bacordarea (ordinului|medaliei|titlului|decoratiei|crucii)|\bretragerea (ordinului|medaliei|decoratiei|unei decoratii|titlului)"),
    Rule("state_of_exception", r"starii de (urgenta|asediu|alerta)|\bmobilizarii\b|\bmobilizare partiala\b|\brazboi|participarea (fortelor|unor forte|armatei)|\btrimiterea (de|unor) (trupe|militari|forte)"),
    Rule("parliament_and_referendum", r"\b(referendum|supunerea spre (ratificare|adoptare)|convocarea parlamentului|dizolvarea parlamentului|sesiune extraordinara|solicitarea (incuviintarii|avizului))"),
    Rule("constitutional_court", r"(?=.*(\bcurtii constitutionale\b|\bcurtea constitutionala\b)).*\b(numirea|eliberarea|incetarea|prelungirea|revocarea)\b"),
    Rule("presidential_staff", r"\bconsilier(i|ului|ilor)? (prezidential|prezidentiali|de stat)|\bconsilier de stat|\bsef(ul)? (al )?cancelariei|\bcabinetului presedintelui|\badministratiei prezidentiale"),
    Rule("state_bodies", r"\b(numirea|eliberarea|incetarea|revocarea)\b.*\b(membru|membri|presedinte|presedintelui|vicepresedinte|vicepresedintelui|director|directorului)\b.*\b(consiliul|consiliului|autoritatii|agentiei|comisiei|curtii de conturi|bancii|institutului|fondului|casei|serviciului|oficiului|inspectoratului|academiei)\b"),
    Rule("government", r"\bministr|\bguvernului\b|\bviceprim|\bprim-?ministru|\bsecretar(ul)? de stat"),
    Rule("judiciary_leadership", r"\b(procuror(ului)? general|procurorului[ -]sef|procuror-sef|procurorului-sef|inaltei curti|consiliului superior al magistraturii|directorul directiei nationale anticoruptie|presedintelui inaltei curti|presedintelui curtii|presedintelui curtii de conturi)\b"),
    Rule("magistrates", r"\b(judecator|judecatori|procuror|procurori|magistrat|magistrati)\b"),
    Rule("diplomacy", r"\b(ambasador|ambasadori|consul|consuli|misiune diplomatica|misiunii diplomatice|reprezentant permanent|reprezentantului permanent|acreditarea|rechemarea|agrementul|scrisori de acreditare|sef de misiune|sefului misiunii)\b"),
    Rule("military", r"\b(inaintarea in gradul|inaintarea in grad|trecerea in rezerva|trecerea in retragere|statului major|armatei|armata|drapelului de lupta|acordarea gradului|gradului de|contraamiral|comandor|colonel|general|generalilor|amiral|maresal|ofiteri|ofiterilor|militar|militarilor|comandant|chestor)\b"),
)

# For the kinds whose title tells whether somebody comes or goes, the wording of either and what any other wording is.
TITLE_ACTIONS = {
    "constitutional_court": (r"\bnumirea\b", r".", None),
    "presidential_staff": (r"\b(numirea|desemnarea)\b", r"\b(eliberarea|incetarea)\b", "other"),
    "state_bodies": (r"\bnumirea\b", r".", None),
    "government": (r"\bnumirea\b|\bdesemnarea\b", r"\b(eliberarea|revocarea|incetarea|acceptarea demisiei|demisiei)\b", "other"),
    "judiciary_leadership": (r"\bnumirea\b", r"\b(eliberarea|revocarea|incetarea)\b", "other"),
    "magistrates": (r"\b(numirea|promovarea|reincadrarea|investirea)\b", r"\b(eliberarea|incetarea|revocarea|destituirea)\b", "other"),
    "diplomacy": (r"\b(numirea|acreditarea|desemnarea)\b", r"\b(rechemarea|eliberarea|incetarea)\b", "other"),
    "military": (r"\b(numirea|inaintarea)\b", r"\b(trecerea in rezerva|trecerea in retragere|eliberarea)\b", "other"),
}

# What the sentence that names somebody does, in order of precedence.
ACTIONS = (
    Rule("recall", r"\bse recheama\b"),
    Rule("rank", r"\bse acorda gradul diplomatic\b"),
    Rule("dismissal", r"\bse revoca\b"),
    Rule("resignation", r"\bse ia act de demisia\b|\bca urmare a demisiei\b|\bdemisia\b"),
    Rule("reappointment", r"\bse reinvesteste\b|\breinvestirea\b|\bse prelungeste\b"),
    Rule("release", r"\bse elibereaza\b|\beste eliberat|\beste eliberata\b|\bse incheie\b|\binceteaza\b"),
    Rule("interim", r"(?=.*\binterimar\b).*\bse desemneaza\b"),
    Rule("designation", r"\bse desemneaza\b"),
    Rule("appointment", r"\bse numeste\b|\bse numesc\b|\beste numit|\beste numita\b|\bse acrediteaza\b|\bse invesm?este\b"),
    Rule("release", r"\bincheia misiunea\b|\bincetarea misiunii\b"),
)

_DNA, _DIICOT = "directiei nationale anticoruptie", "directiei de investigare a infractiunilor de criminalitate organizata"
# The office by kind of decree, read from the office as worded (`title`) or from the whole sentence.
OFFICES = {
    "constitutional_court": (("title", Rule("ccr-judge", "")),),
    "pm_designation": (("title", Rule("pm-candidate", "")),),
    "presidential_staff": (("either", Rule("presidential-adviser", "consilier prezidential")), ("either", Rule("state-counsellor", "consilier de stat"))),
    "judiciary_leadership": (
        ("title", Rule("iccj-president", r"^(?!.*\bvicepresedinte).*\bpresedinte(le)? al inaltei curti")),
        ("title", Rule("iccj-vice-president", r"\bvicepresedinte")),
        ("title", Rule("iccj-section-president", r"presedinte(le)? de sectie|presedinte(le)? al sectiei")),
        ("title", Rule("prosecutor-general-deputy", r"^(prim-?adjunct|adjunct)\b.*procurorului[ -]general")),
        ("title", Rule("prosecutor-general", r"^procuror(ul)? general\b")),
        ("title", Rule("dna-deputy", rf"(?=.*{_DNA}).*(adjunct al procurorului[- ]sef|procuror[- ]sef adjunct) al")),
        ("title", Rule("diicot-deputy", rf"(?=.*{_DIICOT}).*(adjunct al procurorului[- ]sef|procuror[- ]sef adjunct) al")),
        ("title", Rule("prosecutor-section-chief", r"(adjunct al procurorului[- ]sef|procuror[- ]sef adjunct) al|\bprocuror[- ]?sef\b.* al sectiei|\bprocuror[- ]?sef\b.* al sectiilor")),
        ("title", Rule("dna-chief", rf"^procuror[- ]?sef\b.*{_DNA}")),
        ("title", Rule("diicot-chief", rf"^procuror[- ]?sef\b.*{_DIICOT}")),
        ("title", Rule("prosecutor-section-chief", r"^procuror[- ]?sef\b")),
    ),
    "government": (
        ("title", Rule("deputy-prime-minister", r"^(?!.*\bministrul\b).*viceprim-?ministru")),
        ("title", Rule("prime-minister", r"^prim-?ministru\b")),
        ("title", Rule("minister", r"\bministru|\bministrul\b")),
    ),
    "diplomacy": (
        ("sentence", Rule("diplomatic-rank", "gradul diplomatic")),
        ("sentence", Rule("ambassador", "misiunea")),
        ("either", Rule("ambassador", r"\bambasador")),
        ("either", Rule("consul", r"\bconsul")),
        ("either", Rule("permanent-representative", "reprezentant permanent")),
    ),
}
#: Only these kinds name holders of public offices; no name is read from the others.
REGISTER_KINDS = ("government", "pm_designation", "diplomacy", "constitutional_court", "judiciary_leadership", "presidential_staff")

# How a decree opens, closes and names people.
_OPENING = r"(?i)d\s*e\s*c\s*r\s*e\s*t\s*e\s*a\s*z\s*[ăa]\s*:"
_CLOSING = r"PRE[SȘŞ]EDINTELE ROM[AÂ]NIEI"
_SIGNED = r"PRE[SȘŞ]EDINTELE ROM[AÂ]NIEI\s*(-\s*interimar\s*-)?\s*([A-ZĂÂÎȘŞȚŢ][A-ZĂÂÎȘŞȚŢ.\- ]{3,50}?)\s+(?:Bucure[sșş]ti,|[ÎI]n temeiul art\. 100|-{4,})"
_ARTICLE = r"(?i)^\s*\+?\s*(ARTICOL UNIC|Articolul\s*(?:UNIC|\d+))\s*"
_SENTENCE = r"(?<=[.;])(?<!\b(?:dr|ing|prof|conf|lect|gen|col|av|nr|art|alin|lit|pct)\.)\s+(?=(?:\+\s*)?[A-ZĂÂÎȘŞȚŢ])"
_NAME = r"\b(?:[Dd]omnul|[Dd]omnului|[Dd]oamna|[Dd]oamnei)\s+(?:[a-zăâîșşțţ][\p{L}.]*\s+){0,4}?([A-ZĂÂÎȘŞȚŢ][\p{L}'’-]*(?:\s+[A-ZĂÂÎȘŞȚŢ][\p{L}'’.-]*){1,4})"
_BEFORE = r"(?i)(?:mandatului|mandatul|în locul|in locul|locul)\s*$"
_OFFICE = (
    r"(?i)(?:[iî]n|din)\s+(?:func[tțţ]ia|calitate(?:a)?)\s+(?:de\s+)?(.+?)"
    r"(?:\s*:|\s*,?\s*(?:pe|pentru)\s+o\s+perioad[aă]|\s*,?\s*ca\s+urmare|\s*,\s*la\s+cerere|\s+[sşș]i\s+se\s+constat[aă]|\s*,\s*[iî]ncep[aâ]nd|\.\s*$|$)"
)


def folded(c: Column) -> Column:
    return fold_ro(display(F.coalesce(c, F.lit(""))))


def decree_kind(subject: Column) -> Column:
    return first_match(folded(subject), DECREE_KINDS, "other")


def title_action(kind: Column, subject: Column) -> Column:
    """appointment, release or other where the title of a decree of this kind tells; null for kinds whose title tells nothing of the sort."""
    text = folded(subject)
    out = F.lit(None).cast("string")
    for k, (comes, goes, else_) in TITLE_ACTIONS.items():
        told = F.when(F.rlike(text, F.lit(comes)), "appointment").when(F.rlike(text, F.lit(goes)), "release").otherwise(F.lit(else_).cast("string"))
        out = F.when(kind == k, told).otherwise(out)
    return out


def action(sentence: Column) -> Column:
    return first_match(folded(sentence), ACTIONS, "other")


def _cut(c: Column, most: int) -> Column:
    return F.when(F.length(c) > most, F.concat(F.left(c, F.lit(most - 3)), F.lit("…"))).otherwise(c)


def office_title(sentence: Column) -> Column:
    """The office as the sentence words it, cut at 200 characters; null where none is named."""
    found = F.regexp_extract(squash(sentence), _OFFICE, 1)
    return _cut(F.nullif(F.regexp_replace(F.btrim(found), "[.,;]+$", ""), F.lit("")), 200)


def office(kind: Column, sentence: Column, title: Column) -> Column:
    """The office by the kind of decree, from the office as worded, or from the sentence where none is; pass columns, each is read by many rules."""
    s, t = sentence, title
    out = F.lit("other")
    for k, rules in OFFICES.items():
        told = F.lit("other")
        for where, rule in reversed(rules):
            hit = {"title": [t], "sentence": [s], "either": [t, s]}[where]
            match = F.rlike(hit[0], F.lit(rule.pattern))
            for other in hit[1:]:
                match = match | F.rlike(other, F.lit(rule.pattern))
            told = F.when(match, rule.value).otherwise(told)
        out = F.when(kind == k, told).otherwise(out)
    return out


def signature(text: Column) -> tuple[Column, Column]:
    """Who signed and whether in the interim; null without a signature."""
    name = F.nullif(squash(F.regexp_extract(text, _SIGNED, 2)), F.lit(""))
    return name, F.when(name.isNotNull(), F.regexp_extract(text, _SIGNED, 1) != "")


def read_heads(decrees: DataFrame, title: str = "title", text: str = "text") -> DataFrame:
    """Titles of the portal's records as number, issued_on, subject, gazette and signature; rows without a head keep nulls."""
    head = r"(?s)DECRET\s+nr\.\s*([\d.]+)\s*\*{0,2}\)?\s+din\s+(\d{1,2}\s+[A-Za-zăâîșşțţĂÂÎȘŞȚŢ]+\s+\d{4})\s*(.*?)\s*EMITENT"
    published = r"(?i)PUBLICAT\s+[ÎI]N\s+Monitorul\s+Oficial\s+nr\.\s*(\d+)\s+din\s+(\d{1,2}\s+[A-Za-zăâîșşțţ]+\s+\d{4})"
    part = lambda p, i: F.nullif(F.regexp_extract(F.col(title), p, i), F.lit(""))
    name, interim = signature(F.col(text))
    return decrees.withColumns({
        "number": F.replace(part(head, 1), F.lit("."), F.lit("")).try_cast("int"),
        "issued_on": ro_date(part(head, 2)),
        "subject": squash(part(head, 3)),
        "gazette_number": part(published, 1),
        "gazette_on": ro_date(part(published, 2)),
        "signer": name,
        "interim": interim,
    })


def named_people(decrees: DataFrame, key: str, kind: str, text: str) -> DataFrame:
    """The people whom decrees of office-holding kinds name: key, place (order in the decree), name, sentence, action, office, title.

    The operative part lies between the opening and the signature; of somebody named twice the first sentence counts, and who held the
    office before is not who is named.
    """
    start = F.regexp_instr(F.col(text), F.lit(_OPENING))
    rest = F.regexp_replace(F.substr(F.col(text), start), f"^{_OPENING}", "")
    body = F.regexp_replace(F.get(F.split(rest, _CLOSING, 2), F.lit(0)), _ARTICLE, "")
    rows = decrees.where(F.col(kind).isin(*REGISTER_KINDS) & (start > 0)).select(key, kind, F.posexplode(F.split(body, _SENTENCE)).alias("at", "sentence"))
    rows = rows.withColumn("sentence", F.btrim(F.regexp_replace("sentence", _ARTICLE, ""))).where("sentence <> ''")
    gaps = F.split("sentence", _NAME, -1)
    named = F.transform(F.regexp_extract_all("sentence", F.lit(_NAME), F.lit(1)), lambda n, i: F.struct(i.alias("i"), squash(F.regexp_replace(n, r"\.$", "")).alias("name"), F.right(F.get(gaps, i), F.lit(40)).alias("before")))
    people = rows.select(key, kind, "at", "sentence", F.explode(named).alias("p")).where(~F.rlike("p.before", F.lit(_BEFORE)) & (F.size(F.split("p.name", " ")) > 1))
    first = people.groupBy(key, kind, folded(F.col("p.name")).alias("who")).agg(F.min(F.struct("at", F.col("p.i").alias("i"), F.col("p.name").alias("name"), "sentence")).alias("f"))
    out = first.select(key, kind, (F.col("f.at") * 1000 + F.col("f.i")).alias("place"), "f.name", "f.sentence")
    out = out.withColumns({"title": office_title(F.col("sentence")), "__s": folded(F.col("sentence"))}).withColumn("__t", F.when(F.col("title").isNull(), F.col("__s")).otherwise(folded(F.col("title"))))
    return out.select(key, "place", "name", _cut(F.col("sentence"), 300).alias("role"), first_match(F.col("__s"), ACTIONS, "other").alias("action"), office(F.col(kind), F.col("__s"), F.col("__t")).alias("office"), "title")
