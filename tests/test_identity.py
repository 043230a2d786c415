"""Order-dependent identity operators on hand-written cases."""

import datetime as dt
import itertools
import random

from tallyloom.operators import aggregates as A
from tallyloom.operators import documents, entities
from tallyloom.operators import identity as I

day = dt.date.fromisoformat


def test_timelines_replace_recall_and_lapse(spark):
    rows = [
        ("a", day("2020-01-01"), 1, "appointed", "x"),
        ("a", day("2021-01-01"), 2, "appointed", "x"),  # goes on
        ("a", day("2022-01-01"), 3, "appointed", "y"),
        ("a", day("2023-01-01"), 5, "appointed", "z"),  # the same day, but the recall comes first
        ("a", day("2023-01-01"), 6, "recalled", "y"),
        ("b", day("2001-01-01"), 7, "recalled", "u"),
        ("b", day("2002-01-01"), 8, "appointed", "v"),
    ]
    events = spark.createDataFrame(rows, "place string, day date, seq long, kind string, holder string")
    got = {tuple(str(v) if v is not None else None for v in r) for r in I.timelines(events, "2024-01-01").collect()}
    assert got == {
        ("a", "x", "2020-01-01", "2022-01-01", "replaced"),
        ("a", "y", "2022-01-01", "2023-01-01", "recalled"),
        ("a", "z", "2023-01-01", None, "open"),
        ("b", "u", None, "2001-01-01", "recalled"),
        ("b", "v", "2002-01-01", None, "lapsed"),
    }


def test_pages_share_keys_unless_vetoed(spark):
    rows = [
        (1, True, "l1", ["a"]),
        (2, False, None, ["a", "b"]),
        (3, True, None, ["b"]),  # a second main page stays apart
        (4, False, "l2", ["a"]),  # another law stays apart
        (5, False, None, ["z"]),
    ]
    pages = spark.createDataFrame(rows, "page long, main boolean, law string, keys array<string>")
    assert {r.page: r.group for r in I.grouped_pages(pages).collect()} == {1: 1, 2: 1, 3: 3, 4: 4, 5: 5}


def test_assignment_only_where_the_cheapest_way_is_unique(spark):
    rows = [(1, 1, "b", ["u"]), (1, 2, "c", ["u", "w"]), (1, 3, "d", ["u"]), (1, 4, "a", ["v", "w"]), (1, 5, "e", [])]
    items = spark.createDataFrame(rows, "block long, item long, key string, units array<string>")
    assert [tuple(r) for r in I.ordered_assignment(items).collect()] == [(1, 2, "u")]


def test_counts_between_days(spark):
    spans = spark.createDataFrame([(1, day("2020-01-02"), day("2020-01-03")), (2, day("2019-01-01"), None), (3, day("2021-01-01"), None), (4, day("2020-01-05"), day("2020-01-04"))], "id long, s date, e date")
    rows = spark.createDataFrame([(day(d),) for d in ("2020-01-01", "2020-01-02", "2020-01-02", "2020-01-04")], "d date")
    assert {r.id: r.n for r in A.counted_between(spans, rows, "d", "s", "e", "n").collect()} == {1: 2, 2: 4, 3: 0, 4: 0}
    assert {r.id: r.n for r in A.counted_between(spans, rows.limit(0), "d", "s", "e", "n").collect()} == {1: 0, 2: 0, 3: 0, 4: 0}


def test_components_of_chains_stars_and_grids(spark):
    rng = random.Random(4)
    n = 400
    chain = [(i + 1, i) for i in range(300)]
    star = [(1000 + i, 1500) for i in range(200)]
    loose = [(2000 + rng.randrange(n), 2000 + rng.randrange(n)) for _ in range(250)]
    edges = chain + star + loose + [(7, 7), (9999, 9999)]
    rng.shuffle(edges)
    up = {x: x for e in edges for x in e}

    def top(x):
        while up[x] != x:
            x = up[x]
        return x

    for a, b in edges:
        a, b = top(a), top(b)
        up[max(a, b)] = min(a, b)
    linked = {x for a, b in edges if a != b for x in (a, b)}
    got = {r.id: r.component for r in entities.connected(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {x: top(x) for x in linked}
    assert entities.connected(spark.createDataFrame([(1, 1)], "a long, b long")).count() == 0


def test_assignment_matches_all_ways(spark):
    """Every reading of short lists: an item is settled where its unit is the same on all cheapest ways."""
    rng = random.Random(5)
    rows = [(b, i, rng.choice("abcd"), rng.sample(["u", "v", "w"], rng.randint(1, 3))) for b in range(25) for i in range(rng.randint(1, 6))]
    want = set()
    for b, items in itertools.groupby(rows, key=lambda r: r[0]):
        items = list(items)
        ways = {w: sum((0 if y[2] >= x[2] else 3) if p == q else 1 for (x, p), (y, q) in itertools.pairwise(zip(items, w, strict=True))) for w in itertools.product(*[r[3] for r in items])}
        best = [w for w, c in ways.items() if c == min(ways.values())]
        want |= {(b, r[1], best[0][k]) for k, r in enumerate(items) if len(r[3]) > 1 and len({w[k] for w in best}) == 1}
    got = {tuple(r) for r in I.ordered_assignment(spark.createDataFrame(rows, "block long, item long, key string, units array<string>")).collect()}
    assert got == want and want


def test_word_diff_is_a_longest_common_subsequence():
    rng = random.Random(6)

    def longest(a, b):
        if not a or not b:
            return 0
        return 1 + longest(a[1:], b[1:]) if a[0] == b[0] else max(longest(a[1:], b), longest(a, b[1:]))

    for _ in range(200):
        a, b = ([rng.choice("abc") for _ in range(rng.randint(0, 8))] for _ in range(2))
        pairs = documents.longest_common(a, b)
        assert len(pairs) == longest(a, b) and all(a[i] == b[j] for i, j in pairs) and pairs == sorted(pairs) and len({j for _, j in pairs}) == len(pairs)
        before, after = " ".join(a), " ".join(b)
        diff = documents.word_diff(before, after)
        assert "".join(d["text"] for d in diff if d["kind"] != "added") == before and "".join(d["text"] for d in diff if d["kind"] != "removed") == after
    assert documents.word_diff(None, "x") is None and documents.word_diff("x" * 5000, "x") is None


def test_people_are_joined_by_evidence_and_decisions_alone(spark):
    members = [("m1", "p1", "Ana Pop", "K:1", []), ("m2", None, "Pop Ana", None, []), ("m3", None, "Ana Pop", None, []), ("m4", "p4", "Ion Rus", "K:4", []), ("m5", "p5", "Rus Ion", "K:5", []), ("m6", "p4", "Ion Rus", None, [])]
    seats = [("m1", "L", "s", "Iași", "2024-01-01", None), ("m2", "L", "s", "IASI", "2024-01-01", None), ("m3", "L", "d", "Cluj", "2024-01-01", None), ("m4", "L", "s", "Dolj", "2020-01-01", "2021-01-01"), ("m5", "L", "d", "Olt", "2022-01-01", None), ("m6", "L", "d", "Arad", "2020-01-01", "2021-01-01")]
    m = spark.createDataFrame(members, "member string, person string, name string, profile string, careers array<string>")
    s = spark.createDataFrame([(a, b, c, d, day(e), f and day(f)) for a, b, c, d, e, f in seats], "member string, legislature string, chamber string, constituency string, starts_on date, ends_on date")
    none = lambda schema: spark.createDataFrame([], schema)
    people, review = I.resolve_people(m, s, none("decision string, member string, person string"), none("a string, b string"), none("person string"))
    got = {r.member: (r.person, r.reason) for r in people.collect()}
    # m2 sat in m1's seat; m3 bears the name but nothing joins it; m4 and m6 held two seats at once, so the larger id splits off.
    assert got == {"m1": ("p1", None), "m2": ("p1", "unassigned"), "m3": ("person-ana-pop", "unassigned"), "m4": ("p4", None), "m5": ("p5", None), "m6": ("person-ion-rus", "split")}
    assert {(r.kind, r.subject) for r in review.collect()} == {("possible_same_person", "ion rus")}
    different = spark.createDataFrame([("m1", "m2")], "a string, b string")
    _, review = I.resolve_people(m, s, none("decision string, member string, person string"), different, none("person string"))
    assert ("conflict", "m1,m2") in {(r.kind, r.subject) for r in review.collect()}
