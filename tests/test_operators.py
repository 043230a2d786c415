"""Operators on small civic fixtures: the cases that synthetic tables don't hold."""

import datetime as dt
import random

import pytest
from pyspark.sql import functions as F

from tallyloom.functions import text as X
from tallyloom.operators import documents as D
from tallyloom.operators import entities as E
from tallyloom.operators import quality as Q
from tallyloom.operators import relational as R
from tallyloom.operators import rules
from tallyloom.operators import temporal as T
from tallyloom.sources import readers
from tallyloom.streaming import engagement

day = dt.date.fromisoformat


def periods(spark, rows):
    return spark.createDataFrame([(o, k, day(s), e and day(e)) for o, k, s, e in rows], "owner string, id long, s date, e date")


def test_four_interval_conventions(spark):
    df = spark.sql("select date '2020-12-21' as s, date '2024-12-21' as e, date '2024-12-21' as d")
    s, e, d = F.col("s"), F.col("e"), F.col("d")
    got = df.select(T.active_on(s, e, d).alias("a"), T.within_half_open(s, e, d).alias("b"), T.overlaps(s, e, d, d).alias("c"), T.overlaps_strictly(s, e, d, d).alias("x")).first()
    assert tuple(got) == (True, False, True, False)


def test_asof_ties_open_ends_and_misses(spark):
    p = periods(spark, [("a", 1, "2020-01-01", None), ("a", 2, "2021-01-01", "2021-06-30"), ("a", 3, "2021-01-01", None), ("b", 4, "2021-01-01", "2021-01-01")])
    facts = spark.createDataFrame([("a", day("2019-12-31")), ("a", day("2020-01-01")), ("a", day("2021-06-30")), ("b", day("2021-01-02")), ("c", day("2021-01-01"))], "owner string, on date")
    got = {(r.owner, str(r.on)): r.id for r in T.asof_latest(facts, p, "owner", "on", "s", "e", "id", ["owner", "on"]).collect()}
    assert got == {("a", "2019-12-31"): None, ("a", "2020-01-01"): 1, ("a", "2021-06-30"): 3, ("b", "2021-01-02"): None, ("c", "2021-01-01"): None}


def test_asof_matches_brute_force(spark):
    """Nested, closed and open periods, ties, and facts before, in and after them."""
    rng = random.Random(3)
    start = day("2020-01-01")
    at = lambda n: start + dt.timedelta(n)
    rows = [(str(rng.randrange(4)), i, at(a := rng.randrange(200)), None if rng.random() < 0.05 else at(a + rng.choice([0, 3, 20, 120]))) for i in range(150)]
    p = spark.createDataFrame(rows, "owner string, id long, s date, e date")
    asked = {(str(rng.randrange(6)), at(rng.randrange(-10, 260))) for _ in range(300)}
    facts = spark.createDataFrame([(o, d) for o, d in asked], "owner string, on date")
    want = {(o, d): max(((s, i) for oo, i, s, e in rows if oo == o and s <= d and (e is None or e >= d)), default=(None, None))[1] for o, d in asked}
    got = {(r.owner, r.on): r.id for r in T.asof_latest(facts, p, "owner", "on", "s", "e", "id", ["owner", "on"]).collect()}
    assert got == want and None in want.values()
    inner = T.asof_latest(facts, p, "owner", "on", "s", "e", "id", ["owner", "on"], "inner")
    assert inner.count() == sum(v is not None for v in want.values())


def test_merging_gaps_and_coverage(spark):
    p = periods(spark, [("a", 1, "2020-01-01", "2020-01-10"), ("a", 2, "2020-01-11", "2020-01-20"), ("a", 3, "2020-01-05", "2020-01-06"), ("a", 4, "2020-02-01", None)])
    got = [(str(r.s), r.e and str(r.e), r.merged) for r in T.coalesce_touching(p, ["owner"], "s", "e").orderBy("s").collect()]
    assert got == [("2020-01-01", "2020-01-20", 3), ("2020-02-01", None, 1)]
    assert [(str(r.gap_from), str(r.gap_to)) for r in T.gaps(p, ["owner"], "s", "e").collect()] == [("2020-01-21", "2020-01-31")]
    claims = spark.createDataFrame([("a", "x", day("2020-01-15"), day("2020-02-05")), ("b", "y", day("2020-01-01"), day("2020-01-03"))], "owner string, claim string, starts date, ends date")
    spans = p.select("owner", F.col("s").alias("starts"), F.col("e").alias("ends"))
    assert {r.claim: r.uncovered for r in T.uncovered_days(claims, spans, "owner", "claim").collect()} == {"x": 11, "y": 3}


def test_random_intervals_add_up(spark):
    """Covered days and gaps of a span make its length; merging twice changes nothing."""
    rng = random.Random(1)
    start = day("2020-01-01")
    rows = [(str(rng.randrange(5)), i, start + dt.timedelta(a := rng.randrange(300)), start + dt.timedelta(a + rng.randrange(20))) for i in range(120)]
    p = spark.createDataFrame(rows, "owner string, id long, s date, e date")
    once = T.coalesce_touching(p, ["owner"], "s", "e").drop("merged")
    twice = T.coalesce_touching(once.withColumn("id", F.lit(1)), ["owner"], "s", "e").drop("merged")
    assert sorted(map(tuple, once.collect())) == sorted(map(tuple, twice.collect()))
    held = {o: {s + dt.timedelta(k) for oo, _, s, e in rows if oo == o for k in range((e - s).days + 1)} for o in {r[0] for r in rows}}
    for r in once.groupBy("owner").agg(F.sum(F.datediff("e", "s") + 1).alias("n")).collect():
        assert r.n == len(held[r.owner])
    for r in T.gaps(p, ["owner"], "s", "e").collect():
        assert not held[r.owner] & {r.gap_from + dt.timedelta(k) for k in range((r.gap_to - r.gap_from).days + 1)}


def test_paging_and_parameters():
    assert R.clamp_limit("99") == 30 and R.clamp_limit("x") == 10 and R.clamp_limit("-3") == 1
    assert R.decode_cursor(R.encode_cursor("2024-05-01", "v1")) == ("2024-05-01", "v1") and R.decode_cursor("???") is None


def test_ambiguous_matches_stay_null(spark):
    probe = spark.createDataFrame([("x",), ("y",), ("z",)], "k string")
    cand = spark.createDataFrame([("x", 1), ("x", 2), ("y", 3), ("y", 3)], "k string, t long")
    assert {r.k: r.t for r in R.unique_match(probe, cand, ["k"], "t").collect()} == {"x": None, "y": 3, "z": None}


def test_reading_interval_keeps_newest_person(spark):
    schema = "id string, first date, last date, person string"
    old = spark.createDataFrame([("a", day("2024-01-05"), day("2024-01-05"), "p1"), ("b", day("2024-01-01"), day("2024-01-01"), "p2")], schema)
    new = spark.createDataFrame([("a", day("2024-01-03"), day("2024-01-09"), "p9"), ("b", day("2024-02-01"), day("2024-02-01"), None)], schema)
    got = {r.id: (str(r.first), str(r["last"]), r.person) for r in R.reading_interval(old, new, ["id"], "first", "last", ["person"]).collect()}
    assert got == {"a": ("2024-01-03", "2024-01-09", "p9"), "b": ("2024-01-01", "2024-02-01", "p2")}


TITLES = [
    ("Verificare prezență", None, "quorum_or_presence"), ("Ordinea de zi", None, "agenda_or_schedule"), ("Amendamentul 5 vot final", "b", "amendment"),
    ("Vot final - adoptare", None, "final_adoption"), ("Vot final: respingere", None, "final_rejection"), ("VF", "b", "final_adoption"), ("VF", None, "unknown"),
    ("Moţiunea de cenzură", None, "no_confidence"), ("PL-x 12/2025 vot final", None, "final_adoption"), ("Numirea unui membru", None, "institutional_resolution"), ("altceva", "b", "unknown"),
]


def test_vote_kinds_by_precedence(spark):
    df = spark.createDataFrame([(i, t, b, k) for i, (t, b, k) in enumerate(TITLES)], "id int, title string, bill string, kind string")
    got = df.withColumn("got", rules.vote_kind(F.col("title"), F.col("bill").isNotNull())).collect()
    assert [(r.title, r.got) for r in got] == [(r.title, r.kind) for r in got]


def test_vote_outcomes(spark):
    rows = [("quorum_or_presence", 1, 2, 3, None), ("x", None, 200, 330, None), ("x", 100, 150, 330, None), ("amendment", 100, 190, 330, None), ("x", 219, 300, 330, "constitutional"), ("x", 220, 300, 330, "constitutional"), ("x", 165, 300, 330, "organic"), ("x", 160, 300, 330, None), ("x", 150, 300, 330, None)]
    df = spark.createDataFrame(rows, "k string, f int, p int, m int, law string")
    got = [r[0] for r in df.select(rules.vote_outcome(*[F.col(c) for c in ("k", "f", "p", "m", "law")])).collect()]
    assert got == ["not_a_decision:attendance_check", "undetermined:missing_counts", "undetermined:below_quorum", "passed:majority_of_present", "failed:two_thirds_of_members", "passed:two_thirds_of_members", "failed:majority_of_members", "undetermined:depends_on_law_type", "failed:fails_under_any_rule"]
    laws = spark.createDataFrame([("Lege organică",), ("revizuirea Constituției",), ("PH CD 3 regulament",), ("ceva",), (None,)], "t string")
    assert [r[0] for r in laws.select(rules.law_type(F.col("t"))).collect()] == ["organic", "constitutional", "organic", None, None]


def test_romanian_text(spark):
    df = spark.createDataFrame([(1, "Ștefan ŢĂRAN-Îonescu")], "i int, t string")
    r = df.select(X.fold_ro(F.col("t")).alias("f"), X.fold_any(F.col("t")).alias("g"), X.alnum_key(F.col("t")).alias("k"), X.slug(F.col("t")).alias("s"), X.display(F.col("t")).alias("d")).first()
    assert (r.f, r.g, r.k, r.s, r.d) == ("stefan taran-ionescu", "stefan taran-ionescu", "stefantaranionescu", "stefan-taran-ionescu", "Ștefan ȚĂRAN-Îonescu")
    names = spark.createDataFrame([("Ion Popescu", "POPESCU Ion Vasile"), ("Ion", "Ion"), ("Ion Pop", "Ion Popa")], "a string, b string")
    assert [x[0] for x in names.select(X.names_match(F.col("a"), F.col("b"))).collect()] == [True, False, False]
    other = spark.createDataFrame([("PL-x nr. 12/2026", "1.234,56", "5 mai 2024"), ("l 3 / 2025", "1.5", "31.02.2024"), ("none", "x", "05.12.2023")], "i string, l string, d string")
    got = [tuple(r) for r in other.select(X.identifier(F.col("i")), X.lei(F.col("l")).cast("string"), X.ro_date(F.col("d")).cast("string")).collect()]
    assert got == [("PL-x 12/2026", "1234.56", "2024-05-05"), ("L 3/2025", "15.00", None), (None, None, "2023-12-05")]
    assert X.snippets("a" * 200 + " legea " + "b" * 200, "Legea")[0].startswith("…a") and X.snippets("x", "") == []


def test_sections_diff_and_health(spark):
    docs = spark.createDataFrame([(1, "preamble\nArt. 1 one\nbody\nArt. 2 two"), (2, "")], "doc_id long, text string")
    got = [tuple(r) for r in D.sections(docs).orderBy("doc_id", "section").collect()]
    assert got == [(1, 0, "", "preamble"), (1, 1, "art. 1", "Art. 1 one\nbody"), (1, 2, "art. 2", "Art. 2 two"), (2, 0, "", "")]
    pairs = spark.createDataFrame([("a b c", "a x c"), ("same", "same"), ("z" * 5000, "z")], "x string, y string")
    diff = [r[0] for r in pairs.select(D.diffed("x", "y")).collect()]
    assert [(d.kind, d.text) for d in diff[0]] == [("same", "a "), ("removed", "b"), ("added", "x"), ("same", " c")] and len(diff[1]) == 1 and diff[2] is None
    texts = spark.createDataFrame([(None, 0), ("short", 1), ("lege art. 1 guvern parlament " * 30, 2), ("same line\n" * 80, 1), ("§¤" * 400, 1)], "t string, n int")
    reasons = [r[0] for r in texts.select(D.health(F.col("t"), F.col("n"))).collect()]
    assert reasons[0] == ["missing_text_chunks", "high_noise_ratio"] and reasons[1] == ["very_short_text"] and reasons[2] == [] and "high_repeated_line_ratio" in reasons[3] and "high_noise_ratio" in reasons[4]


def test_voters_by_falling_evidence(spark):
    voters = spark.createDataFrame([("old", None, "A B"), ("m2", None, "X Y"), ("v3", "o3", "Q R"), ("v4", None, "POPA Ion Dan"), ("v5", None, "Same Name"), ("v6", None, None)], "voter_id string, official_id string, name string")
    sitting = spark.createDataFrame([("m1", "o1", "A B"), ("m2", "o2", "C D"), ("m3", "o3", "E F"), ("m4", None, "Ion Popa"), ("m5", None, "Same Name"), ("m6", None, "Same Name")], "member_id string, official_id string, name string")
    aliases = spark.createDataFrame([("old", "m1"), ("v6", "gone")], "alias_id string, canonical_id string")
    got = {r.voter_id: (r.member_id, r.evidence) for r in E.resolve_voters(voters, sitting, aliases).collect()}
    assert got == {"old": ("m1", "alias"), "m2": ("m2", "id"), "v3": ("m3", "official"), "v4": ("m4", "name"), "v5": (None, None), "v6": (None, None)}


def test_components_and_vetoed_merges(spark):
    chain = spark.createDataFrame([(i, i + 1) for i in range(30)] + [(100, 101)], "a long, b long")
    assert {r.id: r.component for r in E.connected(chain).collect()} == {i: 0 for i in range(31)} | {100: 100, 101: 100}
    mapping = spark.createDataFrame([("g1", "m1"), ("g2", "m2")], "old string, survivor string")
    votes = spark.createDataFrame([(1, "g1"), (1, "m1"), (2, "g2"), (3, "m2")], "vote long, member string")
    assert [r.old for r in E.veto_shared(mapping, votes, "vote", "member").collect()] == ["g2"]


EVENTS = "block string, day date, seq int, type string, person string, post string, members array<struct<person:string,post:string>>"
GOVERNMENTS = "block string, government string, starts_on date, ends_on date, acting boolean, skip boolean, carry_over boolean"


def test_replay_over_governments(spark):
    """A roster, a carried cabinet, an acting government between two, what nobody can place, and a second roster."""
    rows = [
        ("2020-01-02", 1, "roster", None, None, [("A", "x"), ("B", "y"), ("C", "z")]),
        ("2020-03-01", 2, "resign", "A", "x", None),
        ("2020-03-01", 3, "interim", "B", "x", None),
        ("2020-04-01", 4, "appoint", "D", "x", None),  # ends the interim
        ("2020-05-01", 5, "suspend", "B", None, None),
        ("2020-05-02", 6, "dismiss", "Q", "y", None),  # nobody's post
        ("2021-03-01", 7, "roster", None, None, [("Q", "y")]),  # inside the acting government
        ("2021-06-01", 8, "dismiss", "B", "y", None),  # the day that the cabinet was carried over: the first period ends
        ("2022-01-10", 9, "roster", None, None, [("D", "x"), ("E", "y")]),
        ("2023-01-01", 10, "appoint", "F", "y", None),  # curated
    ]
    events = spark.createDataFrame([("ro", day(d), s, t, p, o, m) for d, s, t, p, o, m in rows], EVENTS)
    g = lambda name, a, b, acting=False, skip=False, carry=False: ("ro", name, day(a), b and day(b), acting, skip, carry)
    governments = spark.createDataFrame([g("G1", "2020-01-01", "2021-01-01"), g("G2", "2021-01-01", "2021-06-01", acting=True), g("G3", "2021-06-01", "2022-12-01", carry=True), g("G4", "2022-12-01", None, skip=True)], GOVERNMENTS)
    got = E.replay(events, governments).collect()
    roles = sorted((r.government, r.person, r.post, r.interim, str(r.starts_on), r.ends_on and str(r.ends_on), r.reason, r.carried) for r in got if r.kind == "role")
    assert roles == [
        ("G1", "A", "x", False, "2020-01-02", "2020-03-01", "resigned", False),
        ("G1", "B", "x", True, "2020-03-01", "2020-04-01", "interim_ended", False),
        ("G1", "B", "y", False, "2020-01-02", "2021-06-01", "dismissed", False),
        ("G1", "C", "z", False, "2020-01-02", "2021-06-01", "government_ended", False),
        ("G1", "D", "x", False, "2020-04-01", "2021-06-01", "government_ended", False),
        ("G3", "C", "z", False, "2021-06-01", "2022-01-10", "new_cabinet", True),
        ("G3", "D", "x", False, "2021-06-01", "2022-12-01", "government_ended", True),
        ("G3", "E", "y", False, "2022-01-10", "2022-12-01", "government_ended", False),
    ]
    assert sorted((r.kind, r.reason) for r in got if r.kind != "role") == [("outside", "appoint"), ("outside", "roster"), ("suspension", "suspend"), ("without_open_role", "dismiss")]


def test_replay_of_a_cabinet(spark):
    rows = [("g", "2019-01-01", 0, "appoint", "Z", "x"), ("g", "2020-01-01", 1, "appoint", "A", "x"), ("g", "2020-02-01", 2, "interim", "B", "x"), ("g", "2020-03-01", 3, "appoint", "C", "x"), ("g", "2020-04-01", 4, "dismiss", "C", None), ("g", "2020-05-01", 5, "appoint", "D", "y"), ("g", "2020-05-01", 6, "appoint", "E", "y")]
    events = spark.createDataFrame([(b, day(d), s, t, p, o, None) for b, d, s, t, p, o in rows], EVENTS)
    one = spark.createDataFrame([("g", "G", day("2020-01-01"), None, False, False, False)], GOVERNMENTS)
    rows = E.replay(events, one).collect()
    assert [(r.kind, r.person, str(r.starts_on)) for r in rows if r.kind != "role"] == [("outside", "Z", "2019-01-01")]
    got = sorted((r.person, str(r.starts_on), r.ends_on and str(r.ends_on), r.reason, r.interim) for r in rows if r.kind == "role")
    assert got == [("A", "2020-01-01", "2020-03-01", "replaced", False), ("B", "2020-02-01", "2020-03-01", "interim_ended", True), ("C", "2020-03-01", "2020-04-01", "dismissed", False), ("E", "2020-05-01", None, None, False)]


def civic(spark):
    d = lambda x: x and day(x)
    period = "starts_on date, ends_on date"
    t = {
        "legislatures": ([("L1", d("2016-12-20"), d("2020-01-01")), ("L2", d("2020-01-01"), d("2024-12-01"))], f"id string, {period}"),
        "people": ([("p1", "A"), ("p2", "B"), ("p8", "C"), ("p9", "Q, Chestor")], "id string, name string"),
        "members": ([("m1", "p1", "Ion Pop"), ("m2", "p1", "Ion, Secretar"), ("m3", None, "X, Y"), ("m4", "p2", "Secretar Z")], "id string, person_id string, name string"),
        "offices": ([("p8",)], "person_id string"),
        "mandates": (
            [("a1", "m1", "L2", "senate", d("2020-01-01"), None), ("a2", "m2", "L2", "senate", d("2020-06-01"), None), ("a3", "m3", "L2", "deputies", d("2019-11-30"), d("2020-02-01")), ("a4", "m1", "L1", "senate", d("2016-12-20"), None)],
            f"id string, member_id string, legislature_id string, chamber string, {period}",
        ),
        "memberships": ([("g1", "m1", d("2020-01-01"), d("2020-05-01")), ("g2", "m1", d("2020-04-01"), None), ("g3", "m3", d("2020-03-01"), None), ("g4", "m2", d("2024-12-02"), None)], f"id string, member_id string, {period}"),
        "affiliations": (
            [("f1", "m1", "p", d("2020-01-01"), d("2020-02-01")), ("f2", "m1", "x-independent", d("2020-02-01"), None), ("f3", "m1", "x-fara-adeziune-q", d("2020-03-01"), None), ("f4", "m4", "p", d("2020-01-01"), None), ("f5", "m4", "q", d("2021-01-01"), None)],
            f"id string, member_id string, party_id string, {period}",
        ),
        "votes": (
            [("v1", d("2020-03-01"), "senate", "Vot Senat", "final_adoption", None, 2, 0, 0), ("v2", d("2020-03-02"), "deputies", "Legea x", "amendment", "b1", 0, 1, 0), ("v3", d("2020-03-02"), "joint", "Moțiune", "final_rejection", None, None, 1, 0)],
            "id string, held_on date, chamber string, title string, kind string, bill_id string, for_count int, against int, abstention int",
        ),
        "individual_votes": ([("v1", "m1", "for"), ("v1", "m3", "for"), ("v2", "m1", "against"), ("v3", "m1", "against")], "vote_id string, member_id string, choice string"),
        "committees": ([("c1", "m1", "k1", d("2020-01-01"), None), ("c2", "m1", "k1", d("2020-02-01"), None), ("c3", "m1", "k2", d("2020-02-01"), None)], f"id string, member_id string, committee_id string, {period}"),
        "bills": ([("b1", "L 7/2020", "PL-x 1/2020", "promulgated", None, "MO 1"), ("b2", "l7/2020", "plx 1/2020", "promulgated", "5", None), ("b3", None, "pl-x1/2020", "rejected", None, None)], "id string, senate string, deputies string, status string, law_number string, gazette string"),
        "roles": (
            [("r1", "group", "Lider de grup", "g", None, d("2020-01-01"), None), ("r2", "group", "Lider de grupă", "g", None, d("2020-02-01"), None), ("r3", "bureau", "Președinte al Senatului", None, "senate", d("2020-01-01"), d("2020-02-01")), ("r4", "bureau", "Președinte al Senatului", None, "senate", d("2020-02-01"), None)],
            f"id string, kind string, title string, group_id string, chamber string, {period}",
        ),
        "steps": ([("t1", "b2", "v2"), ("t2", "b1", "v2"), ("t3", "b1", "v1")], "id string, bill_id string, vote_id string"),
    }
    return {k: spark.createDataFrame(rows, schema) for k, (rows, schema) in t.items()}


def test_integrity_checks_find_what_is_broken(spark):
    found = {}
    for r in Q.run_checks(civic(spark)).collect():
        found.setdefault(r.check, set()).add(r.id)
    assert found == {
        "overlapping_group_periods": {"g1"}, "overlapping_party_periods": {"f4"}, "membership_outside_mandates": {"g3", "g4"}, "two_seats_at_once": {"a1"}, "same_seat_twice": {"m1"},
        "mandate_without_person": {"m3"}, "vote_by_non_sitting_member": {"v1", "v2"}, "seat_count_out_of_range": {"senate"}, "office_title_in_name": {"m2", "p9"}, "placeholder_vote_title": {"v1"},
        "duplicate_committee_row": {"c1"}, "bills_share_a_number": {"senate:L7/2020", "deputies:pl-x1/2020"}, "final_vote_without_bill": {"v1"}, "nominal_differs_from_totals": {"v3"}, "two_leaders_at_once": {"r1"},
        "promulgated_without_law_number": {"b1"}, "promulgated_without_gazette": {"b2"}, "step_vote_of_another_bill": {"t1"}, "orphan_people": {"p9"}, "member_without_mandate": {"m4"}, "mandate_before_legislature": {"a3"},
    }
    assert len(Q.CHECKS) == 23
    counts = "check string, severity string, n long"
    before = spark.createDataFrame([("a", "error", 1), ("b", "error", 5), ("w", "warning", 0)], counts)
    after = spark.createDataFrame([("a", "error", 2), ("b", "error", 5), ("c", "error", 1), ("w", "warning", 3)], counts)
    assert {(r.check, r.verdict) for r in Q.verdict(before, after, ["c"]).collect()} == {("a", "worse"), ("c", "tolerated"), ("w", "grew")}


@pytest.mark.parametrize("encoding", ["utf-8", "utf-8-sig", "utf-16", "cp1250"])
def test_delimited_files_of_any_kind(spark, tmp_path, encoding):
    (tmp_path / "a.csv").write_bytes('Județ;"Secț; ie";a;PSD\n\nCluj;1;"say ""x""";5\n'.replace("ț", "ţ").encode(encoding))
    got = [r.cells for r in readers.delimited(spark, str(tmp_path)).orderBy("row").collect()]
    assert got == [["Judeţ", "Secţ; ie", "a", "PSD"], ["Cluj", "1", 'say "x"', "5"]]
    wide = spark.createDataFrame([("c", "1", "7", "0", "x")], "county string, station string, g string, PSD string, PNL string").withColumn("USR", F.lit("4"))
    assert [tuple(r) for r in readers.unpivot_lists(wide, ["county", "station"], "g").collect()] == [("c", "1", "USR", 4)]


def test_sinks_and_optional_tables(spark, tmp_path):
    path = f"file://{tmp_path}/t"
    one = spark.createDataFrame([(1, "a")], "k long, p string")
    assert readers.optional_table(spark, path, one.schema).count() == 0
    for k in (1, 2):
        readers.replace_folder(one.withColumn("k", F.lit(k).cast("long")), path)
        assert [r.k for r in spark.read.parquet(path).collect()] == [k]
    parts = f"file://{tmp_path}/p"
    readers.replace_partitions(spark.createDataFrame([(1, "a"), (2, "b")], "k long, p string"), parts, "p")
    readers.replace_partitions(spark.createDataFrame([(9, "b")], "k long, p string"), parts, "p")
    assert sorted(r.k for r in spark.read.parquet(parts).collect()) == [1, 9]
    xml = spark.createDataFrame([("<v><id>7</id><d>x</d></v>",)], "x string")
    assert readers.xml_records(xml, "x", "id int, d string").first().record.id == 7


def test_late_events_and_catch_up(spark, tmp_path):
    folder = tmp_path / "in"
    folder.mkdir()
    base = spark.read.parquet("/root/testdata/sf0.001/events.parquet")
    base.write.parquet(f"file://{folder}/events.parquet")
    seen = []
    stream = engagement.stream(spark, f"file://{folder}/events.parquet", "*.parquet")
    engagement.catch_up(stream, lambda df, i: seen.append(df.count()), f"file://{tmp_path}/cp")
    engagement.catch_up(stream, lambda df, i: seen.append(df.count()), f"file://{tmp_path}/cp")
    assert sum(seen) == base.count()
    a, b = engagement.flooding(stream, 0, 0)
    short, long = engagement.collected(a, ["start", "user_id"], "flood_short"), engagement.collected(b, ["start", "user_id"], "flood_long")
    assert short.columns == long.columns and long.count() > short.count() > 0
    assert engagement.catch_up_window(day("2024-05-10"), day("2024-05-20")) == (day("2024-05-07"), day("2024-05-20"))
    assert engagement.catch_up_window(day("2024-05-10"), day("2024-05-20"), [day("2024-01-01")]) == (day("2024-03-21"), day("2024-05-20"))
