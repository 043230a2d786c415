"""Queries over whole tables, where the query of the same number has a part of one."""

import hashlib
import re
from collections import defaultdict

from tallyloom.plans import registry
from tallyloom.session import table

DIR = "/root/testdata/sf0.001"


def got(spark, name):
    return registry.queries()[name](spark, DIR).collect()


def test_components_of_all_rows_match_union_find(spark):
    line = [(r.l_orderkey, (r.l_partkey % 97, r.l_suppkey)) for r in table(spark, DIR, "lineitem").select("l_orderkey", "l_partkey", "l_suppkey").collect()]
    groups, up = defaultdict(set), {k: k for k, _ in line}
    for k, g in line:
        groups[g].add(k)

    def top(k):
        while up[k] != k:
            up[k] = up[up[k]]
            k = up[k]
        return k

    for g in groups.values():
        for k in g:
            a, b = top(k), top(min(g))
            up[max(a, b)] = min(a, b)
    linked = {k for g in groups.values() if len(g) > 1 for k in g}
    assert {r.id: r.component for r in got(spark, "i01_components_whole")} == {k: top(k) for k in linked}


def test_single_values_are_of_all_events(spark):
    want = defaultdict(set)
    for r in table(spark, DIR, "events").collect():
        want[r.user_id, r.ts.date()].add(r.event_type)
    found = {(r.user_id, r.day): r.only_type for r in got(spark, "i22_single_value_veto_whole")}
    assert found == {k: min(v) if len(v) == 1 else None for k, v in want.items()}
    assert None in found.values() and any(found.values())


def test_every_part_is_a_candidate(spark):
    for name, target in (("i08_match_by_name_whole", "member"), ("i27_single_candidate_whole", "person")):
        rows = got(spark, name)
        found = {r.p_partkey: r[target] for r in rows}
        assert len(rows) == len(found) == table(spark, DIR, "part").count()
        assert all(v in (None, k) for k, v in found.items()) and max(v for v in found.values() if v is not None) > 100


def test_whole_pages_are_squashed(spark):
    pages = {r.page_id: r.html for r in table(spark, DIR, "pages").collect()}
    assert max(len(h) for h in pages.values() if h) > 200
    squash = lambda h: h if h is None else hashlib.md5(re.sub(r"[ \t\n\x0b\f\r]+", " ", h).strip(" ").encode()).hexdigest()
    assert {r.page_id: r.squashed for r in got(spark, "h05_squash_whole")} == {k: squash(h) for k, h in pages.items()}


def test_ordered_lists_get_what_lies_on_every_cheapest_way(spark):
    """Every choice of units for every list, by brute force."""
    at = DIR.replace("0.001", "0.01")
    rows = sorted((r.s_suppkey, r.s_name) for r in table(spark, at, "supplier").select("s_suppkey", "s_name").collect())
    blocks, want = defaultdict(list), set()
    for k, name in rows:
        blocks[k // 100 * 2 + k % 2].append((k, name, [f"u{k // 4}", f"u{k // 7}"] if k % 3 == 0 else [f"u{k // 4}"]))

    def cost(a, b):
        return 1 if a[2] != b[2] else 0 if b[1] >= a[1] else 3

    for block, items in blocks.items():
        # a way's last unit and what it has chosen at each item with two -> its cost; of those that end alike only the cheapest go on
        states = {(u, ()): 0 for u in items[0][2]} if len(items[0][2]) == 1 else {(u, (u,)): 0 for u in items[0][2]}
        for a, b in zip(items, items[1:]):
            new = {}
            for (u, told), c in states.items():
                for v in b[2]:
                    key = (v, told + (v,) if len(b[2]) > 1 else told)
                    new[key] = min(new.get(key, 10**9), c + cost((*a[:2], u), (*b[:2], v)))
            least = {}
            for (v, told), c in new.items():
                least[v] = min(least.get(v, 10**9), c)
            states = {k: c for k, c in new.items() if c == least[k[0]]}
        best = min(states.values())
        chosen = [told for (_, told), c in states.items() if c == best]
        for i, (k, _, units) in enumerate([x for x in items if len(x[2]) > 1]):
            if len({t[i] for t in chosen}) == 1 and len(set(units)) > 1:
                want.add((block, k, chosen[0][i]))
    got = {(r.block, r.item, r.unit) for r in registry.queries()["i25_ordered_assignment"](spark, at).collect()}
    assert got == want and want


def test_word_differences_are_shortest(spark):
    """Each side reads back, and what is the same is a longest common subsequence."""
    import json

    texts = {r.item_id: r.text for r in table(spark, DIR, "benchmark").collect()}
    got = {r.item_id: r.diff for r in registry.queries()["j08_word_diff"](spark, DIR).collect()}
    assert set(got) == set(texts)
    for k, text in texts.items():
        if text is None or max(len(text), len(text) + 5) > 4000:
            assert got[k] is None
            continue
        before, after = (re.findall(r"\s+|\S+", t)[:240] for t in (text, re.sub(r"^(\S+)\s", r"\1 also ", text)))
        parts = json.loads(got[k])
        read = lambda kinds: "".join(p["text"] for p in parts if p["kind"] in kinds)
        assert read(("same", "removed")) == "".join(before) and read(("same", "added")) == "".join(after)
        row = [0] * (len(after) + 1)
        for a in before:
            last = 0
            for j, b in enumerate(after, 1):
                last, row[j] = row[j], last + 1 if a == b else max(row[j], row[j - 1])
        assert sum(len(re.findall(r"\s+|\S+", p["text"])) for p in parts if p["kind"] == "same") == row[-1]


def told_roles(events, governments):
    """Who held what, told from the rules anew: a list of facts about roles, each closed once, looked through from the start at every decree."""
    from datetime import date

    govs = sorted(governments, key=lambda g: g.starts_on)
    never = date(9999, 1, 1)

    def lasts(g):
        if g.ends_on is None or g.acting:
            return g.ends_on
        after = [x for x in govs if x.starts_on >= g.ends_on]
        nxt = next((x for x in after if not x.acting), None)
        return nxt.starts_on if nxt and [x for x in after if x.acting and x.starts_on < nxt.starts_on] else g.ends_on

    by = {g.government: g for g in govs}
    roles, notes, begun = [], [], set()  # a role: [government, person, post, interim, start, end, reason, carried, origin, dropped]

    def close(r, day, why):
        if r[8] is not None and day == r[4]:
            r[8][6], r[5], r[9] = why, day, True
        else:
            r[5], r[6] = day, why

    live = lambda test=lambda r: True: [r for r in roles if r[5] is None and not r[9] and test(r)]
    for e in sorted(events, key=lambda e: (e.day, e.seq)):
        for g in govs:
            if g.starts_on <= e.day and g.government not in begun:
                begun.add(g.government)
                before = [x for x in govs if not x.acting and x.starts_on < g.starts_on][-1:]
                if g.carry_over and not g.acting and not g.skip and before and not before[0].skip:
                    for r in live(lambda r, b=before[0].government: r[0] == b):
                        close(r, g.starts_on, "government_ended")
                        roles.append([g.government, r[1], r[2], r[3], g.starts_on, None, None, True, r, False])
        for r in live():
            if (lasts(by[r[0]]) or never) < e.day:
                close(r, lasts(by[r[0]]), "government_ended")
        now = [g for g in govs if g.starts_on <= e.day][-1:]
        if not now or now[0].skip or (e.type == "roster" and now[0].acting):
            notes.append((None, e.person, e.post, None, e.day, None, e.type, None, "outside"))
            continue
        g = now[0].government
        begin = lambda person, post, interim, e=e, g=g: roles.append([g, person, post, interim, max(e.day, by[g].starts_on), None, None, False, None, False])
        if e.type == "roster":
            named = [(m.person, m.post) for m in e.members]
            for r in live(lambda r, g=g: r[0] == g):
                if r[3] and r[2] in {p for _, p in named}:
                    close(r, e.day, "interim_ended")
                elif not r[3] and (r[1], r[2]) not in named:
                    close(r, e.day, "new_cabinet")
            for person, post in named:
                if not live(lambda r, g=g, who=(person, post): r[0] == g and not r[3] and (r[1], r[2]) == who):
                    begin(person, post, False)
        elif e.type in ("appoint", "interim"):
            for r in live(lambda r, e=e: r[2] == e.post and (r[3] or e.type == "appoint")):
                close(r, e.day, "interim_ended" if r[3] else "replaced")
            begin(e.person, e.post, e.type == "interim")
        elif e.type == "suspend":
            notes.append((None, e.person, e.post, None, e.day, None, e.type, None, "suspension"))
        else:
            found = live(lambda r, e=e: r[1] == e.person and e.post in (None, r[2]) and (r[3] or e.type != "interim_end"))
            found = found or ([] if e.type == "interim_end" else live(lambda r, e=e: r[1] == e.person))
            if not found:
                notes.append((None, e.person, e.post, None, e.day, None, e.type, None, "without_open_role"))
            for r in found:
                close(r, e.day, {"interim_end": "interim_ended", "dismiss": "dismissed", "resign": "resigned"}[e.type])
    for r in live():
        if lasts(by[r[0]]) is not None:
            close(r, lasts(by[r[0]]), "government_ended")
    kept = [r for r in roles if not r[9] and not (r[4] == r[5] and r[6] in ("replaced", "interim_ended", "new_cabinet"))]
    return [(*r[:8], "role") for r in kept] + notes


def test_cabinets_are_what_the_rules_tell(spark):
    from tallyloom.plans.records import decrees

    events, governments = (df.collect() for df in decrees(spark, DIR))
    want = []
    for block in {e.block for e in events}:
        want += [(block, *r) for r in told_roles([e for e in events if e.block == block], [g for g in governments if g.block == block])]
    columns = ["block", "government", "person", "post", "interim", "starts_on", "ends_on", "reason", "carried", "kind"]
    assert sorted(map(repr, want)) == sorted(repr(tuple(r[c] for c in columns)) for r in got(spark, "i11_replay"))
    assert len({r[-1] for r in want}) == 4
