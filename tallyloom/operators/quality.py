"""Integrity checks as a declared list, verdicts and publish gates."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyloom.operators import temporal as T

CAP = 1000
Tables = dict[str, DataFrame]


@dataclass(frozen=True)
class Check:
    """Rows that break a rule; none means that it holds."""

    name: str
    severity: str
    rows: Callable[[Tables], DataFrame]


def overlapping(df: DataFrame, owner: str, key: str = "id", starts: str = "starts_on", ends: str = "ends_on", days: int | None = None, same: str | None = None) -> DataFrame:
    """Pairs of periods of one owner (and, with `same`, one further column) that overlap strictly, or by more than some days.

    Pairs are of different keys, the smaller first.
    """
    cols = dict.fromkeys([owner, key, starts, ends, *([same] if same else [])])
    a, b = df.select(*cols).alias("a"), df.select(*cols).alias("b")
    on = (F.col(f"a.{owner}") == F.col(f"b.{owner}")) & (F.col(f"a.{key}") < F.col(f"b.{key}"))
    if same:
        on = on & (F.col(f"a.{same}") == F.col(f"b.{same}"))
    spans = [F.col(f"{x}.{c}") for x in "ab" for c in (starts, ends)]
    hit = T.overlaps_strictly(*spans) if days is None else T.overlap_days(*spans) > days
    return a.join(b, on & hit).select(F.col(f"a.{key}").alias("id"), F.col(f"b.{key}").alias("other"))


def outside(df: DataFrame, periods: DataFrame, owner: str, day: str) -> DataFrame:
    """Rows whose owner has no period on their day."""
    p = periods.select(F.col(owner).alias("__o"), F.col("starts_on").alias("__s"), F.col("ends_on").alias("__e"))
    return df.join(p, (F.col(owner) == F.col("__o")) & T.active_on(F.col("__s"), F.col("__e"), F.col(day)), "left_anti")


def _ids(df: DataFrame, key: str = "id") -> DataFrame:
    return df.select(F.col(key).alias("id"), F.lit(None).cast("string").alias("other"))


def _counted(df: DataFrame, label: str, having: str) -> DataFrame:
    return df.groupBy(F.col(label).cast("string").alias("id")).agg(F.count("*").alias("n")).where(having).select("id", F.col("n").cast("string").alias("other"))


def seated(t: Tables) -> DataFrame:
    """Mandates with their person; one without an end lasts as long as its legislature."""
    legislatures = t["legislatures"].select(F.col("id").alias("legislature_id"), F.col("starts_on").alias("opens_on"), F.col("ends_on").alias("closes_on"))
    people = t["members"].select(F.col("id").alias("member_id"), "person_id")
    out = t["mandates"].join(legislatures, "legislature_id").join(people, "member_id", "left")
    return out.withColumn("ends_on", F.coalesce("ends_on", "closes_on")).withColumn("seat", F.concat_ws("/", "person_id", "legislature_id", "chamber"))


def current(t: Tables) -> DataFrame:
    """Mandates of the legislature that began last."""
    newest = t["legislatures"].orderBy(F.desc("starts_on")).limit(1).select(F.col("id").alias("legislature_id"))
    return t["mandates"].join(newest, "legislature_id", "left_semi")


def _overlapping_parties(t: Tables) -> DataFrame:
    party = t["affiliations"].withColumn("none", F.rlike("party_id", F.lit(NO_PARTY)))
    pairs = overlapping(party, "member_id")
    of = lambda name: party.select(F.col("id").alias(name), F.col("none").alias(f"{name}_none"))
    return pairs.join(of("id"), "id").join(of("other"), "other").where("not (id_none and other_none)").select("id", "other")


def _not_sitting(t: Tables) -> DataFrame:
    """Nominal votes of members without a mandate in the vote's chamber on its day; joint votes take either chamber."""
    votes = t["votes"].select(F.col("id").alias("vote_id"), F.col("chamber").alias("vote_chamber"), "held_on")
    m = seated(t).select(F.col("member_id").alias("m"), F.col("chamber").alias("seat_chamber"), F.col("starts_on").alias("s"), F.col("ends_on").alias("e"))
    on = (F.col("member_id") == F.col("m")) & ((F.col("vote_chamber") == "joint") | (F.col("vote_chamber") == F.col("seat_chamber"))) & T.active_on(F.col("s"), F.col("e"), F.col("held_on"))
    return t["individual_votes"].join(votes, "vote_id").join(m, on, "left_anti").select(F.col("vote_id").alias("id"), F.col("member_id").alias("other"))


def _shared_numbers(t: Tables) -> DataFrame:
    """Dossier numbers that several bills carry, spelled alike first."""
    senate = F.when(F.rlike("senate", F.lit(SENATE_NUMBER)), F.concat(F.lit("senate:"), F.upper(F.replace("senate", F.lit(" "), F.lit("")))))
    deputies = F.when(F.rlike("deputies", F.lit(DEPUTIES_NUMBER)), F.concat(F.lit("deputies:"), F.lower(F.regexp_replace("deputies", r"\s+", ""))))
    keys = t["bills"].select(F.col("id").alias("bill"), F.explode(F.array(senate, deputies)).alias("id")).where("id is not null")
    return keys.groupBy("id").agg(F.count_distinct("bill").alias("n")).where("n > 1").select("id", F.col("n").cast("string").alias("other"))


def _nominal_differs(t: Tables) -> DataFrame:
    named = t["individual_votes"].groupBy(F.col("vote_id").alias("id")).agg(*[F.count_if(F.col("choice") == c).alias(f"named_{c}") for c in ("for", "against", "abstention")])
    v = t["votes"].join(named, "id")
    totals = {"for": "for_count", "against": "against", "abstention": "abstention"}
    return _ids(v.where(" or ".join(f"named_{c} <> coalesce({total}, -1)" for c, total in totals.items())))


def _office_titles(t: Tables) -> DataFrame:
    named = lambda name: t[name].where(F.rlike("name", F.lit(OFFICE_IN_NAME))).select("id", F.lit(name).alias("other"))
    return named("members").unionByName(named("people"))


def _orphans(t: Tables) -> DataFrame:
    known = t["members"].select("person_id").unionByName(t["offices"].select("person_id")).select(F.col("person_id").alias("id"))
    return _ids(t["people"].join(known, "id", "left_anti"))


# Spellings that the checks go by, and the seats that a chamber can have.
NO_PARTY = r"-(independent|fara-adeziune[a-z-]*)$"
OFFICE_IN_NAME = r"(?i),\s*(pre[sşș]edinte|vicepre[sşș]edinte|chestor|secretar)"
SENATE_NUMBER, DEPUTIES_NUMBER = r"(?i)^L\s*\d+/\d{4}$", r"(?i)^PL-?x\s*\d+/\d{4}$"
PLACEHOLDER_TITLES = ("Senate vote", "Chamber vote", "Vot Senat", "Vot Camera")
BILL_MOTIONS = ("final_adoption", "final_rejection", "rejection_report")
SEATS = "(id = 'senate' and n not between 125 and 140) or (id = 'deputies' and n not between 315 and 335)"
LEADER, PRESIDENT = "kind = 'group' and title like 'Lider de grup%'", "kind = 'bureau' and title like 'Președinte al %'"


CHECKS = (
    Check("overlapping_group_periods", "error", lambda t: overlapping(t["memberships"], "member_id")),
    Check("overlapping_party_periods", "error", _overlapping_parties),
    Check("membership_outside_mandates", "error", lambda t: _ids(outside(t["memberships"].withColumnRenamed("starts_on", "from"), seated(t), "member_id", "from"))),
    Check("two_seats_at_once", "error", lambda t: overlapping(seated(t), "person_id", days=31)),
    Check("same_seat_twice", "error", lambda t: overlapping(seated(t).where("person_id is not null"), "seat", "member_id")),
    Check("mandate_without_person", "error", lambda t: _ids(t["members"].where("person_id is null").join(t["mandates"].select(F.col("member_id").alias("id")), "id", "left_semi"))),
    Check("vote_by_non_sitting_member", "error", _not_sitting),
    Check("mass_mandate_end", "error", lambda t: _counted(current(t).where("ends_on is not null").withColumn("on", F.concat_ws(" ", "chamber", "ends_on")), "on", "n > 10")),
    Check("seat_count_out_of_range", "error", lambda t: _counted(current(t).where("ends_on is null"), "chamber", SEATS)),
    Check("office_title_in_name", "error", _office_titles),
    Check("placeholder_vote_title", "error", lambda t: _ids(t["votes"].where(F.col("title").isin(*PLACEHOLDER_TITLES)))),
    Check("duplicate_committee_row", "error", lambda t: overlapping(t["committees"], "member_id", same="committee_id")),
    Check("bills_share_a_number", "error", _shared_numbers),
    Check("final_vote_without_bill", "warning", lambda t: _ids(t["votes"].where(F.col("bill_id").isNull() & F.col("kind").isin(*BILL_MOTIONS) & ~F.rlike("title", F.lit("(?i)mo[tţț]iun"))))),
    Check("nominal_differs_from_totals", "warning", _nominal_differs),
    Check("two_leaders_at_once", "warning", lambda t: overlapping(t["roles"].where(LEADER), "group_id")),
    Check("two_presidents_at_once", "warning", lambda t: overlapping(t["roles"].where(PRESIDENT), "chamber")),
    Check("promulgated_without_law_number", "error", lambda t: _ids(t["bills"].where("status = 'promulgated' and law_number is null"))),
    Check("promulgated_without_gazette", "warning", lambda t: _ids(t["bills"].where("status = 'promulgated' and gazette is null"))),
    Check("step_vote_of_another_bill", "warning", lambda t: _ids(t["steps"].join(t["votes"].select(F.col("id").alias("vote_id"), F.col("bill_id").alias("vote_bill")), "vote_id").where("bill_id <> vote_bill"))),
    Check("orphan_people", "warning", _orphans),
    Check("member_without_mandate", "warning", lambda t: _ids(t["members"].join(t["mandates"].select(F.col("member_id").alias("id")), "id", "left_anti"))),
    Check("mandate_before_legislature", "warning", lambda t: _ids(seated(t).where("starts_on < date_sub(opens_on, 31)"))),
)


def run_checks(tables: Tables, checks: tuple[Check, ...] = CHECKS, cap: int | None = CAP) -> DataFrame:
    """check, severity, id, other: the first offending rows of every check, up to a cap (null: all)."""
    parts = []
    for c in checks:
        rows = c.rows(tables)
        rows = rows.select(F.col("id").cast("string").alias("id"), F.col("other").cast("string").alias("other"))
        rows = rows if cap is None else rows.orderBy("id", "other").limit(cap)
        parts.append(rows.select(F.lit(c.name).alias("check"), F.lit(c.severity).alias("severity"), "id", "other"))
    return reduce(DataFrame.unionByName, parts)


def verdict(before: DataFrame, after: DataFrame, tolerated: list[str]) -> DataFrame:
    """Counts (check, severity, n) before and after a run: an error count may not grow unless tolerated; warnings are told."""
    both = after.join(before.select("check", F.col("n").alias("was")), "check", "left").fillna(0, ["was"]).where("n > was")
    blocked = (F.col("severity") == "error") & ~F.col("check").isin(*tolerated)
    return both.select("check", "was", "n", F.when(blocked, "worse").when(F.col("severity") == "error", "tolerated").otherwise("grew").alias("verdict"))


def gate(differences: dict[str, tuple[Column, Column]], *more: Column) -> Column:
    """Reasons to hold a row back: each named pair that differs, null-safe, and further reasons (null: none)."""
    named = [F.when(~a.eqNullSafe(b), F.concat(F.lit(f"{name}: "), F.coalesce(a.cast("string"), F.lit("none")), F.lit(" vs "), F.coalesce(b.cast("string"), F.lit("none")))) for name, (a, b) in differences.items()]
    return F.filter(F.array(*named, *more), lambda r: r.isNotNull())


def triage(rows: DataFrame, first: int) -> Column:
    """What a pending discovery is, by ordered rules over flags held, test, attendance, summarised, listed."""
    return (
        F.when(F.col("official_id") < first, "older_legislature").when(F.col("held"), "already_imported").when(F.col("test"), "test_ballot")
        .when(F.col("attendance"), "attendance_check").when(F.col("summarised"), "joint_amendment_summarised").when(F.col("listed"), "still_to_import").otherwise("not_on_official_lists")
    )


def confidence(open_issue: Column, missing: Column, unsupported: Column, accepted: Column, stored: Column) -> Column:
    """How far a record can be trusted; the first flag that holds decides."""
    return (
        F.when(open_issue, "open_issue").when(missing, "missing").when(unsupported, "unsupported")
        .when(accepted, "accepted").when(stored, "stored").otherwise("parsed")
    )


def progress(counts: DataFrame) -> DataFrame:
    """Bars of (area, item, have, total): the share done, rounded down so that only a whole is 100, and what is missing. Without a real total there is no bar."""
    done = F.floor(F.least(F.col("have"), F.col("total")) * 100 / F.col("total"))
    return counts.where("total > 0").select("area", "item", "have", "total", done.cast("int").alias("percent"), F.greatest(F.col("total") - F.col("have"), F.lit(0)).alias("missing"))
