"""Ordered rules as one `when` chain: the first that matches decides."""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from tallyloom.functions.text import fold_ro


@dataclass(frozen=True)
class Rule:
    value: str
    pattern: str
    needs_bill: bool = False
    sure: str = "high"


def first_match(text: Column, rules: tuple[Rule, ...], default: str, has_bill: Column | None = None, give: str = "value") -> Column:
    """Compile rules to a column: the value (or another field) of the first that matches. The text is folded once by the caller, so
    that patterns are plain ASCII."""
    bill = F.lit(True) if has_bill is None else has_bill
    conditions = [(F.rlike(text, F.lit(r.pattern)) & bill if r.needs_bill else F.rlike(text, F.lit(r.pattern)), getattr(r, give)) for r in rules]
    first, *rest = conditions
    return reduce(lambda acc, c: acc.when(*c), rest, F.when(*first)).otherwise(default)


# The kinds of votes and the wording that tells them, in order of precedence: procedural wording comes before
# anything that looks like a final vote. Some rules count only for votes that are linked to a bill; `medium` ones are less sure.
VOTE_KINDS = (
    Rule("quorum_or_presence", r"\b(verificare(?:a)? prezent(?:ei|a)|prezenta electronica|apel nominal|intrunirea cvorumului|cvorum)\b"),
    Rule("agenda_or_schedule", r"\b(ordinea? de zi|program(?:ul)? de lucru|lucreze (?:in )?paralel|in paralel cu plenul|prelungirea programului|modificare(?:a)? (?:programului|ordinii? de zi)|suspendarea sedintei)\b"),
    Rule("procedural_timing", r"\b(timp(?:i|ul)? (?:de )?dezbater(?:e|i)|prelungirea termenului|termen(?:ul)? constitutional|limitarea timpului|durata dezbaterilor)\b"),
    Rule("internal_procedure", r"\b(procedura de vot|modalitatea de vot|reluarea votului|vot (?:secret|prin bile|test|control)|regulament(?:ul)? (?:camerei|senatului))\b"),
    Rule("amendment", r"\b(amendament(?:ul|e|ele)?|articol(?:ul)? amendat|am[ar]\.?\s*\d+|titlul legii)\b"),
    Rule("committee_referral", r"\b(retrimitere(?:a)? la comisi\w*|trimitere(?:a)? la comisi\w*|sesizarea comisi\w*)\b"),
    Rule("reconsideration", r"\b(reexaminare(?:a)?|repunere(?:a)? pe ordinea de zi|reconsiderare(?:a)?)\b"),
    Rule("institutional_resolution", r"\b(ph\s*(?:(?:cd|s)\s*\d+|-\s*(?:com|ancheta)\b)|proiect(?:ul)? de hotarare|raport de activitate|declaratia (?:senatului|parlamentului))\b"),
    Rule("no_confidence", r"\b(motiune(?:a)? de cenzura|motiunii de cenzura)\b"),
    Rule("confidence", r"\b(angajarea raspunderii|vot de incredere|investirea guvernului|acordarea increderii)\b"),
    Rule("rejection_report", r"\b(raport(?:ul)? de respingere|propunere(?:a)? de respingere)\b"),
    Rule("final_adoption", r"\bproiect de lege (?:privind|pentru|de) aprobare(?:a)?\b", True),
    Rule("final_rejection", r"\bvot final\b.*\b(respingere|respins)\b|\b(respingere|respins)\b.*\bvot final\b"),
    Rule("final_adoption", r"\bvot final\b.*\b(adoptare|adoptat)\b|\b(adoptare|adoptat)\b.*\bvot final\b"),
    Rule("final_adoption", r"\bvot final\b", True, "medium"),
    Rule("final_adoption", r"\b(?:pl-?x?|l)\s*\d+\/\d{4}\b.*\bvot final\b", False, "medium"),
    Rule("final_adoption", r"\bvf\b", True, "medium"),
    Rule("institutional_resolution", r"\b(hotarare(?:a)? (?:camerei|senatului|parlamentului)|numire(?:a)?|revocare(?:a)?|validare(?:a)?|alegerea vicepresedintilor|biroul permanent)\b"),
)

# How prominent a kind of vote is, and what a vote for it supports.
KIND_FACTS = {
    "quorum_or_presence": ("routine", "confirms_presence"),
    "agenda_or_schedule": ("routine", "supports_procedure"),
    "procedural_timing": ("routine", "supports_procedure"),
    "internal_procedure": ("routine", "supports_procedure"),
    "amendment": ("standard", "supports_amendment"),
    "committee_referral": ("standard", "supports_referral"),
    "reconsideration": ("standard", "supports_reconsideration"),
    "institutional_resolution": ("standard", "supports_resolution"),
    "no_confidence": ("major", "supports_no_confidence"),
    "confidence": ("major", "supports_confidence"),
    "rejection_report": ("major", "supports_rejection"),
    "final_adoption": ("major", "supports_adoption"),
    "final_rejection": ("major", "supports_rejection"),
    "unknown": ("unclassified", "unknown"),
}


def wording(title: Column, vote_type: Column | None = None) -> Column:
    """What the rules read: title and type of a vote, folded. The bill's own title says nothing of the question put."""
    parts = [F.nullif(c, F.lit("")) for c in ([title] if vote_type is None else [title, vote_type])]
    return fold_ro(F.concat_ws(" | ", *parts))


def vote_kind(title: Column, has_bill: Column, vote_type: Column | None = None) -> Column:
    return first_match(wording(title, vote_type), VOTE_KINDS, "unknown", has_bill)


def vote_facts(title: Column, has_bill: Column, vote_type: Column | None = None) -> dict[str, Column]:
    """kind, prominence, meaning (of a yes) and confidence."""
    kind = vote_kind(title, has_bill, vote_type)
    fact = lambda i: F.create_map(*[F.lit(x) for k, v in KIND_FACTS.items() for x in (k, v[i])])[kind]
    sure = first_match(wording(title, vote_type), VOTE_KINDS, "low", has_bill, "sure")
    return {"kind": kind, "prominence": fact(0), "meaning": fact(1), "confidence": sure}


def law_type(title: Column) -> Column:
    t = fold_ro(F.coalesce(title, F.lit("")))
    own_rules = F.when(F.rlike(t, F.lit(r"\bregulament")), "organic").otherwise("ordinary")
    return (
        F.when(F.rlike(t, F.lit(r"revizuir\w*\s+(a\s+)?constitut")), "constitutional")
        .when(F.rlike(t, F.lit(r"\blege(a)?\s+organic")), "organic")
        .when(F.rlike(t, F.lit(r"\blege(a)?\s+ordinar")), "ordinary")
        .when(F.rlike(t, F.lit(r"\bproiect(ul)?\s+de\s+hotarare\b|\bph\s+cd\b")), own_rules)
    )


def vote_outcome(kind: Column, n_for: Column, present: Column, members: Column, law: Column) -> Column:
    """status:rule. A majority of those present, of all members or of two thirds, by what was voted; between them it stays open."""
    procedural = kind.isin("amendment", "procedural_timing", "agenda_or_schedule", "committee_referral", "internal_procedure")
    here, all_, most = F.floor(present / 2) + 1, F.floor(members / 2) + 1, F.ceil(2 * members / 3)
    decided = lambda least, rule: F.when(n_for >= least, f"passed:{rule}").otherwise(f"failed:{rule}")
    return (
        F.when(kind == "quorum_or_presence", "not_a_decision:attendance_check")
        .when(n_for.isNull() | present.isNull() | F.coalesce(members == 0, F.lit(True)), "undetermined:missing_counts")
        .when(present * 2 <= members, "undetermined:below_quorum")
        .when(procedural | (law == "ordinary"), decided(here, "majority_of_present"))
        .when(law == "constitutional", decided(most, "two_thirds_of_members"))
        .when(law == "organic", decided(all_, "majority_of_members"))
        .when(n_for >= all_, "passed:passes_under_any_rule")
        .when(n_for < here, "failed:fails_under_any_rule")
        .otherwise("undetermined:depends_on_law_type")
    )
