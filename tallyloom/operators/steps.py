"""What the steps of a bill's dossier say (J03), the fate that follows from them (J04), and how a scanned report reads."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyloom.functions.text import RO_FROM, RO_TO, display
from tallyloom.operators.rules import Rule, first_match

# The wording of procedure steps and the kind that each tells, in order of precedence. Texts are folded and have single spaces.
STEP_KINDS = (
    Rule("deadline_extended", r"prelungire(a)? termen(ului)? de adoptare tacita|modificarea termenului de adoptare|prelungirea termenului (constitutional )?de (dezbatere|depunere)|complexitate deosebita"),
    Rule("archived", r"^clasat\b"),
    Rule("initiators_changed", r"list(a|ei) de initiatori|^retragerea semnaturii"),
    Rule("reexamination_requested", r"presedintele romaniei (cere|solicita) reexaminarea|cererea de reexaminare este inaintata"),
    Rule("government_responsibility", r"^guvernul isi angajeaza raspunderea"),
    Rule("promulgation", r"devine legea nr|promulgat(a)? prin decret"),
    Rule("published", r"publicat(a)? in monitorul oficial"),
    Rule("sent_to_president", r"trimis(a)? la promulgare|trimitere la presedintele romaniei pentru promulgare"),
    Rule("other", r"^adresa administratiei prezidentiale$"),
    Rule("constitutional_window", r"(depunere|depus|depusa) la secretarul general.*(constitutionalitat)"),
    Rule("withdrawn", r"retras de catre initiator|retragerea initiativei|solicita retragerea|retras(a)? de|solicitarea initiatorilor de retragere|de retragere a (propunerii|proiectului)"),
    Rule("procedure_ended", r"incetarea procedurii legislative"),
    Rule("rejected", r"^respins in sedinta comuna"),
    Rule("adopted", r"^adoptat in sedinta comuna"),
    Rule("final_vote", r"^vot final (adoptare|respingere)"),
    Rule("rejected", r"^respins(a)? (de|de catre) |^(legea|proiectul|propunerea)\b.*\brespins(a)? de catre "),
    Rule("adopted", r"^(legea|proiectul|propunerea)\b.*(adoptat|adoptata) (de|ca urmare)|^adoptat(a)? de (catre )?(camera deputatilor|senat)"),
    Rule("plenary_debate", r"^dezbatere(a)? "),
    Rule("agenda_scheduled", r"inscris pe ordinea de zi"),
    Rule("government_view_requested", r"^(solicitare|trimis pentru) (punct de vedere|informare|fisa financiara)( de la| la) guvern|trimis pentru punct de vedere la guvern"),
    Rule("government_view_received", r"^primire punct de vedere de la guvern"),
    Rule("opinion_requested", r"^(solicitare punct de vedere de la|trimis pentru punct de vedere la) ."),
    Rule("opinion_received", r"^primire punct de vedere de la ."),
    Rule("competence_decision", r"stabilirii competentei|avizarea competentei|trimiterea (initiativei|propunerii) legislative la camera deputatilor, ca prima|competentei privind|solicitarea comisiei .* de transmitere|^primit de la senat.*prima camera"),
    Rule("sent_to_committee", r"^trimis pentru raport( suplimentar)? privind .*?,? la comisia |^-?\s*trimis pentru raport( suplimentar)? la"),
    Rule("committee_opinion_requested", r"^trimis pentru aviz privind .*?,? la comisia |^-?\s*trimis pentru aviz la:?\s*(comisia\b.*|\(termen:[^)]*\)\s*)?$"),
    Rule("opinion_requested", r"^-?\s*trimis pentru aviz la|^solicitare aviz de la "),
    Rule("committee_opinion_received", r"^primire (aviz|opinie|hotarare) de la comisia\b.*[^:]$"),
    Rule("opinion_received", r"^primire (aviz|opinie|hotarare) de la .*[^:]$"),
    Rule("committee_opinion_received", r"^primire aviz de la\s*:?"),
    Rule("committee_report_received", r"^primire raport|^((?! transmite avizul).)+ depune raportul"),
    Rule("committee_opinion_received", r"^comisia\b.* transmite avizul"),
    Rule("opinion_received", r". transmite avizul"),
    Rule("constitutional_review", r"sesizare de neconstitutionalitate|curt(ea|ii) constitutional"),
    Rule("urgency_decided", r"^(?!prezentare)(?=.*procedur(a|ii) de urgenta).*(aprobarea|aprobat)"),
    Rule("urgency_requested", r"^(?!prezentare).*procedur(a|ii) de urgenta"),
    Rule("registered", r"^(- )?(inregistrat la senat|inregistrat la camera deputatilor)|^prezentare in birou|^cu nr\.l\d+ prezentare in biroul permanent|^biroul permanent aproba|^primit de la senat"),
    Rule("sent_to_senate", r"^inaintat la senat|^trimis la senat"),
    Rule("sent_to_deputies", r"^inaintat la camera|^trimis la camera"),
)
UNKNOWN = "unrecognised"


def _plain(text: Column) -> Column:
    """Accents off, old letters' too, and lower case; null counts as empty. What is ASCII has none."""
    t = F.coalesce(text, F.lit(""))
    return F.lower(F.when(F.octet_length(t) == F.length(t), t).otherwise(F.translate(t, RO_FROM + "ãÃ", RO_TO + "aA")))


def folded(text: Column) -> Column:
    """Accents off, lower case, single spaces, trimmed; null counts as empty."""
    return F.btrim(F.regexp_replace(_plain(text), r"\s+", " "))


def _part(text: Column, pattern: str, group: int = 1) -> Column:
    return F.nullif(F.regexp_extract(text, pattern, group), F.lit(""))


def _number(text: Column, pattern: str) -> Column:
    return _part(text, pattern).cast("int")


# Where the wording of a step names a committee or a body.
_TOPIC = r"^trimis pentru (?:raport suplimentar|raport|aviz) privind .*?,? la (comisia .*)$"
_SENT = r"^-?\s*trimis pentru (?:raport suplimentar|raport|aviz) la:?\s*(.*)$"
_VIEW_ASKED = r"^(?:solicitare punct de vedere de la|trimis pentru punct de vedere la) (.+)$"
_ASKED = r"^solicitare aviz de la (.+)$"
_VIEW_GIVEN = r"^primire punct de vedere de la (.+?)(?:\s+-\s+cu nr\.?\s*.+?)?\s*$"
_GIVEN = r"^primire (?:aviz|opinie|hotarare) de la (.+?[^:])(?:\s+-\s+cu nr\.?\s*\S+)?(?:\s*\((?:favorabil|negativ|nefavorabil)\))?\s*$"
_GIVES = r"^(.+?)\s+(?:transmite avizul|depune raportul)"
_COMMITTEE = r"(Comisia\s+[^()]{6,200}?)(?:\s+nr\.|\s+a solicitat|\s*\(|\s*,|\s*$)"
#: Kinds of steps whose wording names somebody.
NAMING = ("sent_to_committee", "committee_opinion_requested", "opinion_requested", "opinion_received", "committee_opinion_received", "committee_report_received")


def _name(kind: Column, f: Column, printed: Column) -> Column:
    """Whom a step names, as printed. The folded text is as long as the printed one, so places carry over."""

    def found(pattern: str) -> Column:
        part = F.regexp_extract(f, pattern, 1)
        return F.nullif(F.btrim(F.substr(printed, F.position(part, f), F.length(part))), F.lit(""))

    name = F.coalesce(*[found(p) for p in (_TOPIC, _SENT, _VIEW_ASKED, _ASKED, _VIEW_GIVEN, _GIVEN, _GIVES)])
    name = F.nullif(F.btrim(F.regexp_replace(name, r"(?i)\s*\(termen:[^)]*\)\s*$", "")), F.lit(""))
    return F.when(kind.isin(*NAMING), name)


def _named_bodies(kind: Column, f: Column, printed: Column, name: Column) -> tuple[Column, Column]:
    """The committee and the body that a step names."""
    committee = F.rlike(folded(name), F.lit(r"^comisia\b")) | ((kind == "committee_report_received") & F.rlike(f, F.lit(_GIVES)))
    decided = F.when(kind == "competence_decision", F.nullif(F.btrim(F.regexp_extract(printed, _COMMITTEE, 1)), F.lit("")))
    body = F.when(kind.isin("government_view_requested", "government_view_received"), "Guvernul României").when(~committee, name)
    return F.coalesce(decided, F.when(committee, name)), body


def _chamber(text: Column) -> Column:
    return F.when(F.rlike(text, F.lit("camer(a|ei) deputat")), "deputies").when(F.contains(text, F.lit("senat")), "senate")


def _iso(text: Column, before: str) -> Column:
    d = before + r"(\d{1,2})[./-](\d{1,2})[./-](\d{4})"
    two = lambda i: F.lpad(F.regexp_extract(text, d, i), 2, "0")
    return F.when(F.rlike(text, F.lit(d)), F.concat(F.regexp_extract(text, d, 3), F.lit("-"), two(2), F.lit("-"), two(1)))


def typed(steps: DataFrame, text: str = "text") -> DataFrame:
    """The rows with type, recognised, chamber, committee, institution, verdict, deadline_on, document_number and the counts that the wording states.

    The first rule that matches decides; wording that no rule knows is `other` and not recognised. All in one projection.
    """
    f = F.col("__f")
    kind = F.col("__kind")
    printed = F.col("__printed")
    out = steps.withColumn("__f", folded(F.col(text))).withColumn("__kind", first_match(f, STEP_KINDS, UNKNOWN))
    out = out.withColumn("__printed", F.btrim(F.regexp_replace(display(F.coalesce(F.col(text), F.lit(""))), r"\s+", " "))).withColumn("__name", _name(kind, f, printed))
    decided = kind.isin("adopted", "rejected")
    after = F.when(kind == "rejected", F.regexp_replace(f, r"^.*?respinsa? (de catre|de) ", "")).otherwise(F.regexp_replace(f, r"^.*?adoptata? de (catre )?", ""))
    chamber = (
        F.when(decided & F.rlike(f, F.lit("^(respins|adoptat) in sedinta comuna")), "joint").when(decided, _chamber(after))
        .when(kind.isin("plenary_debate", "agenda_scheduled") | F.rlike(f, F.lit("^(- )?inregistrat la")), _chamber(f))
    )
    told = (
        F.when(F.contains(f, F.lit("respingere")), "rejection")
        .when(F.rlike(f, F.lit(r"favorabil.*cu amendamente|favorabil\s*\(.*amend\. admise|raport(ul)? (suplimentar )?favorabil \(\d+ amend")), "favorable_with_amendments")
        .when(F.contains(f, F.lit("negativ")) | F.contains(f, F.lit("nefavorabil")), "unfavorable").when(F.contains(f, F.lit("favorabil")), "favorable")
    )
    with_number = r"(?:transmite avizul|depune raportul) cu nr\.?\s*([^\s-]+)(?:-(\w+))?(\s+cu amendamente)?"
    word, amended = F.coalesce(_part(f, with_number, 2), _part(f, r"^primire .*\((favorabil|negativ|nefavorabil)\)$")), F.regexp_extract(f, with_number, 3) != ""
    worded = F.when(word.isin("negativ", "nefavorabil"), "unfavorable").when((word == "favorabil") & amended, "favorable_with_amendments").when(word == "favorabil", "favorable")
    verdict = (
        F.when(kind == "government_view_received", told).when((kind == "committee_report_received") & F.startswith(f, F.lit("primire raport")), F.coalesce(told, F.lit("favorable")))
        .when(kind.isin("committee_report_received", "committee_opinion_received", "opinion_received"), worded)
    )
    committee, institution = _named_bodies(kind, f, printed, F.col("__name"))
    votes = lambda word: F.when(decided | (kind == "final_vote"), _number(f, rf"{word}\s*=\s*(\d+)"))
    return out.withColumns(
        {
            "type": F.when(kind == UNKNOWN, "other").otherwise(kind), "recognised": kind != UNKNOWN, "chamber": chamber, "committee": committee, "institution": institution, "verdict": verdict,
            "deadline_on": _iso(f, r"\(?termen:?\s*"),
            "document_number": F.when(kind.isin("government_view_received", "opinion_received", "committee_opinion_received", "committee_report_received"), _part(f, r"cu nr\.?\s*([^\s(-]+)")),
            "amendments_admitted": _number(f, r"\((\d+) amend\. admise\)"), "amendments_rejected": _number(f, r"\((\d+) amend\. respinse\)"),
            "votes_for": votes("pentru"), "votes_against": votes("contra"), "abstentions": votes("abtineri"), "not_voting": votes("nu au votat"),
        }
    ).drop("__f", "__kind", "__printed", "__name")


def fates(steps: DataFrame, bills: DataFrame) -> DataFrame:
    """bill_id, outcome, outcome_on, law_number, law_year, decree_number, gazette_number: the fate of each bill from its typed steps and its stage line.

    steps (bill_id, occurred_on, ord, type, chamber, text), bills (bill_id, stage, decision_chamber). Each answer is an
    aggregate that combines before the shuffle, so a bill of any number of steps is never gathered. Only a page that prints
    a law number makes one; a rejection counts where the deciding chamber made it; an ending counts if nothing came later.
    """
    law, decree = (label + r"\s*nr\.?\s*(\d+)\s*[/.]\s*(?:(\d{2})[/.](\d{2})[/.])?(\d{4})" for label in ("legea", "decret"))
    gazette = r"(?:monitorul oficial|m\.o\.)\s*(?:partea i\s*)?nr\.?\s*(\d+)\s*/\s*\d{2}[./]\d{2}[./]\d{4}"
    f = F.col("__f")
    rows = steps.join(bills.select("bill_id", "decision_chamber"), "bill_id").withColumn("__f", folded(F.col("text"))).withColumn("__at", F.struct("occurred_on", "ord"))
    is_type = lambda kind: F.col("type") == kind
    last = lambda cond: F.max(F.when(cond, F.col("occurred_on")))
    first = lambda kind, pattern, value: F.min_by(value, F.when(is_type(kind) & F.rlike(f, F.lit(pattern)), F.col("__at")))
    dated = lambda c: F.try_to_date(F.concat_ws("-", _part(c, law, 4), _part(c, law, 3), _part(c, law, 2)), "yyyy-MM-dd")
    by = rows.groupBy("bill_id").agg(
        first("promulgation", law, _part(f, law, 1)).alias("law_number"), first("promulgation", law, _part(f, law, 4)).alias("law_year"),
        first("promulgation", law, F.coalesce(dated(f), F.col("occurred_on"))).alias("law_on"), first("promulgation", decree, _part(f, decree, 1)).alias("decree_number"),
        first("published", gazette, _part(f, gazette, 1)).alias("gazette_number"),
        F.min(F.when(is_type("promulgation"), F.col("occurred_on"))).alias("promulgated_on"), last(is_type("withdrawn")).alias("withdrawn_on"), last(is_type("archived")).alias("archived_on"),
        last(is_type("rejected") & (F.col("chamber") == F.col("decision_chamber"))).alias("rejected_on"),
        last(is_type("procedure_ended") & ~F.rlike(f, F.lit("inaintare la (senat|camera)"))).alias("ended_on"), F.max("occurred_on").alias("last_on"),
    )
    out = bills.join(by, "bill_id", "left").withColumn("__f", folded(F.col("stage")))
    plain = r"^lege (\d+)/(\d{4})"
    stated = F.coalesce("law_number", _part(f, law, 1), _part(f, plain, 1))
    year = F.when(F.col("law_number").isNotNull(), F.col("law_year")).otherwise(F.coalesce(_part(f, law, 4), _part(f, plain, 2)))
    outcome = (
        F.when(stated.isNotNull() | F.col("promulgated_on").isNotNull(), "promulgated").when(F.col("withdrawn_on").isNotNull() | F.startswith(f, F.lit("retras")), "withdrawn")
        .when(F.col("archived_on").isNotNull(), "archived").when(F.col("rejected_on").isNotNull(), "rejected").when(F.col("ended_on") >= F.col("last_on"), "ended").otherwise("in_progress")
    )
    on = F.when(F.col("outcome") == "promulgated", F.coalesce("law_on", "promulgated_on", dated(f)))
    for kind in ("withdrawn", "archived", "rejected", "ended"):
        on = on.when(F.col("outcome") == kind, F.col(f"{kind}_on"))
    out = out.withColumn("outcome", outcome)
    return out.select(
        "bill_id", "outcome", on.alias("outcome_on"), stated.alias("law_number"), year.cast("int").alias("law_year"), "decree_number",
        F.coalesce("gazette_number", _part(f, gazette)).alias("gazette_number"),
    )


# What a Romanian word doesn't hold (a sign, or a digit between letters), the heading of an annex, and what of it every such heading has before it is folded.
GARBLED = r"[~^|`{}<>0123456789](?:(?<!\d)|(?<=[A-Za-z]\d)(?=[A-Za-z]))"
ANNEX = r"^(?:anexa\s*(?:nr\.?\s*\d+)?\s*[-–:.]?\s*)?amendament(?:e|ul)?\s+(admis[ae]?|respins[ae]?)\b"
_ANNEX_WORD = "[mM][eE][nN][dD][aAăĂâÂãÃ][mM][eE][nN]"

# How an annex names an author of an amendment, and what may stand before the name. Only the first of capitals in a row can begin a name, unless
# the last author ends before it: each word ends where its letters do, so what fails from one of them fails from the next. The commonest other letters are told off first.
_CAPITAL = "A-ZĂÂÎȘȚŞŢ"
_WORD, _BETWEEN = r"[\p{L}'’.]*+", r"(?:\s++(?:[–-]\s*+)?|[–-]\s*+)"
AUTHOR = (
    rf"((?![a-z ,])[{_CAPITAL}](?:(?<![{_CAPITAL}].)|(?<=\G.)){_WORD}{_BETWEEN}(?:[{_CAPITAL}]{_WORD}{_BETWEEN}){{0,4}}[{_CAPITAL}][\p{{L}}'’.]*)\s*[,–-]?\s*(deputat|senator)\s+"
    rf"((?:[{_CAPITAL}][A-Za-zĂÂÎȘȚăâîșțşţ]*|neafiliat|minorit[a-zăț]+)(?:\s*\([^)]{{1,40}}\))?)"
)
_BEFORE_AUTHOR = r"(?i)^(?:(?:domnul|doamna|domnii|doamnele|dl\.?|d-na|senator|deputat|autori|autor|amendament\s+propus\s+de)\s*:?\s*)+"


def _spaced(text: Column) -> Column:
    """Single spaces for white space; null counts as empty. What is a single space already is passed over."""
    return F.regexp_replace(F.coalesce(text, F.lit("")), r"\s(?:\s+|(?<! ))", " ")


def authors(text: Column) -> Column:
    """Authors that a text names, in order: array<struct<name, role, party>>; one of each name.

    The pattern goes over the text once and sets each author off as a line of three fields: with single spaces there is no other line end or tab.
    """
    lines = F.filter(F.split(F.regexp_replace(_spaced(text), AUTHOR, "\n$1\t$2\t$3\n"), "\n"), lambda x: F.contains(x, F.lit("\t")))
    clean = lambda n: F.regexp_replace(n, _BEFORE_AUTHOR, "")
    rows = F.transform(F.transform(lines, lambda x: F.split(x, "\t")), lambda p: F.struct(clean(p[0]).alias("name"), F.when(p[1] == "deputat", "deputy").otherwise("senator").alias("role"), p[2].alias("party")))
    return F.filter(rows, lambda x: (F.length(x["name"]) >= 5) & F.contains(x["name"], F.lit(" ")))


def report_authors(pages: DataFrame) -> DataFrame:
    """report_id, place, name, role, party: the authors that the annexes of cleanly read reports name, from the first annex's page on; each once."""
    read = report_readings(pages).where("quality = 'clean'").select("report_id", F.least("admitted_page", "rejected_page").alias("from")).where(F.col("from").isNotNull())
    rows = pages.join(read, "report_id").where("page >= from").select("report_id", "page", F.posexplode(authors(F.col("text"))).alias("at", "a"))
    key = F.btrim(F.regexp_replace(_plain(F.col("a.name")), r"[\s–-]+", " "))
    first = rows.groupBy("report_id", key.alias("key")).agg(F.min(F.struct("page", "at", "a")).alias("f"))
    return first.select("report_id", (F.col("f.page") * 1000 + F.col("f.at")).alias("place"), "f.a.name", "f.a.role", "f.a.party")


def report_readings(pages: DataFrame) -> DataFrame:
    """report_id, pages, garbled_percent, quality, admitted_page, rejected_page: of reports read by page (report_id, page, text).

    Counts are made by page and added up, so no report is gathered. Under 40 characters a page there is no text; over two
    per cent of garbled words the scan is poor; a report without words is garbled throughout. An annex starts where its
    capitalised heading is first seen. Null texts count as empty. Words and lines are only parted where one can be garbled or a heading.
    """
    text, spaced, chars = F.coalesce("text", F.lit("")), F.btrim(_spaced(F.col("text"))), F.col("chars")
    bad = F.when(F.rlike(text, F.lit(GARBLED)), F.size(F.filter(F.split("spaced", " "), lambda w: F.rlike(w, F.lit(GARBLED))))).otherwise(0)
    lines = F.filter(F.split(text, "\n"), lambda x: F.rlike(x, F.lit(rf"^\s*[{_CAPITAL}]")) & F.rlike(x, F.lit(_ANNEX_WORD)))
    heads = F.transform(lines, lambda x: F.regexp_extract(folded(x), ANNEX, 1))
    page = lambda kind: F.when(F.exists("heads", lambda h: F.startswith(h, F.lit(kind))), F.col("page"))
    told = pages.select("report_id", "page", text.alias("text"), spaced.alias("spaced"), F.when(F.rlike(text, F.lit(_ANNEX_WORD)), heads).alias("heads"))
    told = told.select("report_id", F.length(F.replace("spaced", F.lit(" "))).alias("chars"), F.length("spaced").alias("size"), bad.alias("bad"), page("admis").alias("admitted"), page("respins").alias("rejected"))
    words = F.when(chars == 0, 0).otherwise(F.col("size") - chars + 1)
    by = told.groupBy("report_id").agg(
        F.count("*").alias("pages"), F.sum("chars").alias("chars"), F.sum(words).alias("words"), F.sum("bad").alias("bad"),
        F.min("admitted").alias("admitted_page"), F.min("rejected").alias("rejected_page"),
    )
    share = F.when(F.col("words") == 0, 100.0).otherwise(100 * F.col("bad") / F.col("words"))
    quality = F.when(F.col("chars") < 40 * F.col("pages"), "none").when(share > 2, "poor").otherwise("clean")
    return by.select("report_id", "pages", F.round(share, 1).alias("garbled_percent"), quality.alias("quality"), "admitted_page", "rejected_page")
