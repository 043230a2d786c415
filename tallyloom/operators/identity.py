"""Evidence that two records are one, what may be merged or ended, and who held which post."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tallyloom.functions import text as X
from tallyloom.operators import entities as E
from tallyloom.operators import relational as R
from tallyloom.operators import temporal as T
from tallyloom.session import materialise

#: Days that two seats may overlap at a hand-over; years after which a post without news counts as lapsed.
HAND_OVER, LAPSE_YEARS = 31, 8


def seats_at_once(pairs: DataFrame, mandates: DataFrame) -> DataFrame:
    """Pairs (a, b) of members that held different seats at the same time for longer than a hand-over, so cannot be one person.

    mandates: member, legislature, chamber, constituency, starts_on, ends_on.
    """
    side = lambda k: mandates.select(F.col("member").alias(k), *[F.col(c).alias(f"{c}_{k}") for c in mandates.columns if c != "member"])
    both = pairs.join(side("a"), "a").join(side("b"), "b")
    col = lambda c, k: F.col(f"{c}_{k}")
    days = T.overlap_days(col("starts_on", "a"), col("ends_on", "a"), col("starts_on", "b"), col("ends_on", "b"))
    place = lambda k: X.constituency_key(col("constituency", k))
    same = (col("legislature", "a") == col("legislature", "b")) & (col("chamber", "a") == col("chamber", "b")) & (place("a") == place("b")) & (place("a") != "")
    return both.where((days > HAND_OVER) & ~F.coalesce(same, F.lit(False))).select("a", "b").distinct()


def _words(c: Column) -> Column:
    """The words of a name as printed: folded, of more than one letter, in order."""
    return F.filter(F.split(F.regexp_replace(X.fold_ro(F.coalesce(c, F.lit(""))), "[()]", " "), r"[\s\-.,]+"), lambda t: F.length(t) > 1)


def _near_keys(words: Column) -> Column:
    """Each word, and each long word short of one letter: two words within one letter of each other have one of these in common."""
    cut = lambda t: F.transform(F.sequence(F.lit(1), F.length(t)), lambda i: F.concat(F.substring(t, F.lit(1), i - 1), F.substring(t, i + 1, F.length(t))))
    return F.array_distinct(F.flatten(F.transform(words, lambda t: F.when(F.length(t) >= 6, F.concat(F.array(t), cut(t))).otherwise(F.array(t)))))


def match_by_name(probe: DataFrame, members: DataFrame, name: str, target: str, on: str | None = None) -> DataFrame:
    """probe with the only member that fits its name, and `ambiguous` where several do; of two words at least.

    In turn: the same words in any order (of several, the one whose words are the printed ones turned round); every word of the shorter name among the
    longer's; the same number of words, each at most one letter off in a long word. Several at a step settle it: nobody is chosen. With `on`, a day of the
    probe, only members sitting then (starts_on, ends_on) count.
    """
    words, day = _words(F.col(name)), [on] if on else []
    known = ["starts_on", "ends_on"] if on else []
    # Records of one name and day ask the same question, and members of one name and time give the same answer: each is asked and kept once.
    p = probe.withColumn("__w", words)
    q = p.select("__w", *[F.col(c).alias("__on") for c in day]).where(F.size(F.array_distinct("__w")) >= 2).distinct()
    q = q.withColumns({"__id": F.sha2(F.to_json(F.struct(*q.columns), {"ignoreNullFields": "false"}), 256), "__s": F.array_sort(F.array_distinct("__w"))})
    long = materialise(q, "names")
    m = members.select(F.col(target).alias("__t"), words.alias("__mw"), *known).groupBy("__mw", *known).agg(F.min("__t").alias("__t"), F.max("__t").alias("__u"))
    m = materialise(m.withColumn("__ms", F.array_sort(F.array_distinct("__mw"))), "members")
    sits = T.active_on(F.col("starts_on"), F.col("ends_on"), F.col("__on")) | F.col("__on").isNull() if on else F.lit(True)
    # Files of long names look small to the planner; met by shuffles, nothing of them goes through the driver.
    meet = lambda x, y, key: x.hint("merge").join(y.hint("merge"), key)
    pick = lambda pairs, step: pairs.groupBy("__id").agg(F.min("__t").alias("t"), F.max("__u").alias("u")).select("__id", "t", (F.col("t") != F.col("u")).alias("several"), F.lit(step).alias("step"))

    joined = lambda c: F.concat(F.lit(" "), F.array_join(c, " "), F.lit(" "))
    turned = (F.size("__w") == F.size("__mw")) & F.contains(F.concat(joined("__mw"), F.array_join("__mw", " "), F.lit(" ")), joined("__w"))
    same = meet(long, m, F.col("__s") == F.col("__ms")).where(sits).withColumn("__turned", turned)
    of_turned = lambda f, c: f(F.when(F.col("__turned"), F.col(c)))
    same = same.groupBy("__id").agg(F.min("__t").alias("t"), F.max("__u").alias("u"), of_turned(F.min, "__t").alias("tt"), of_turned(F.max, "__u").alias("tu"))
    by_turn = (F.col("t") != F.col("u")) & (F.col("tt") == F.col("tu"))
    exact = materialise(same.select("__id", F.when(F.coalesce(by_turn, F.lit(False)), F.col("tt")).otherwise(F.col("t")).alias("t"), (F.col("t") != F.col("u")) & ~F.coalesce(by_turn, F.lit(False)), F.lit(1).alias("step")).toDF("__id", "t", "several", "step"), "exact")

    # Of two names one of which holds the other, the longer has the word of the shorter that the fewest members bear.
    rest = long.join(exact.select("__id").hint("merge"), "__id", "left_anti")
    each = m.select("__ms").distinct().select(F.explode("__ms").alias("__k")).groupBy("__k").agg(F.count("*").alias("__n"))
    rest_words = rest.select("__id", F.explode("__s").alias("__k"))
    rest_rare = meet(rest_words, each, "__k").groupBy("__id").agg(F.min(F.struct("__n", "__k")).alias("r"), F.count("*").alias("__known"))
    rest_rare = rest_rare.select("__id", F.col("r.__k").alias("__k"), "__known")
    names = m.select("__ms").distinct().where(F.size("__ms") >= 2)
    names_rare = meet(names.withColumn("__k", F.explode("__ms")), each, "__k").groupBy("__ms").agg(F.min(F.struct("__n", "__k"))["__k"].alias("__k"))
    asked = rest.select("__id", "__s")
    longer = meet(meet(asked, rest_words, "__id"), names_rare, "__k").where((F.size("__ms") <= F.size("__s")) & (F.size(F.array_except("__ms", "__s")) == 0))
    whole = meet(asked, rest_rare, "__id").where(F.col("__known") == F.size("__s"))  # a word that no member has: no name holds this one
    shorter = meet(whole, names.withColumn("__k", F.explode("__ms")), "__k").where((F.size("__s") <= F.size("__ms")) & (F.size(F.array_except("__s", "__ms")) == 0))
    held = longer.select("__id", "__ms").unionByName(shorter.select("__id", "__ms")).distinct()
    timed = lambda pairs: meet(meet(pairs, m, "__ms"), rest.select("__id", "__on"), "__id").where(sits) if on else meet(pairs, m, "__ms")
    part = materialise(pick(timed(held), 2), "part")

    last = rest.join(part.select("__id").hint("merge"), "__id", "left_anti")
    longest = F.array_max(F.transform("__s", lambda t: F.struct(F.length(t).alias("n"), t.alias("t"))))["t"]
    fits = F.forall("__s", lambda a: F.exists("__ms", lambda b: (a == b) | ((F.least(F.length(a), F.length(b)) >= 6) & (F.levenshtein(a, b) <= 1))))
    close = meet(last.select("__id", "__s", F.explode(_near_keys(F.array(longest))).alias("__k")), m.select("__ms").distinct().withColumn("__k", F.explode(_near_keys(F.col("__ms")))), "__k")
    near = pick(timed(close.where((F.size("__s") == F.size("__ms")) & fits).select("__id", "__ms").distinct()), 3)

    told = exact.unionByName(part).unionByName(near).select("__id", F.when(~F.col("several"), F.col("t")).alias(target), F.col("several").alias("ambiguous"))
    found = materialise(meet(long.drop("__s"), told, "__id").drop("__id"), "matched")
    back = F.col("__w") == F.col("__fw")
    if on:
        back &= F.col(on).eqNullSafe(F.col("__on"))
    return p.join(found.withColumnRenamed("__w", "__fw").hint("merge"), back, "left").select(*probe.columns, target, F.coalesce("ambiguous", F.lit(False)).alias("ambiguous"))


def _overlapping(pairs: DataFrame, members: DataFrame, mandates: DataFrame) -> DataFrame:
    """Pairs of members that sat in different seats at once; a seat that two sources print (one with a profile, one without, of matching names) is one seat."""
    seats = mandates.join(members.select("member", "name", F.col("profile").isNotNull().alias("own")), "member")
    side = lambda k: seats.select(F.col("member").alias(k), *[F.col(c).alias(f"{c}_{k}") for c in seats.columns if c != "member"])
    both = pairs.select("a", "b").distinct().join(side("a"), "a").join(side("b"), "b")
    col = lambda c, k: F.col(f"{c}_{k}")
    days = T.overlap_days(col("starts_on", "a"), col("ends_on", "a"), col("starts_on", "b"), col("ends_on", "b"))
    place = lambda k: X.constituency_key(col("constituency", k))
    across = (col("own", "a") != col("own", "b")) & X.names_match(col("name", "a"), col("name", "b"))
    same = (col("legislature", "a") == col("legislature", "b")) & (col("chamber", "a") == col("chamber", "b")) & (((place("a") == place("b")) & (place("a") != "")) | across)
    return both.where((days > HAND_OVER) & ~F.coalesce(same, F.lit(False))).select("a", "b").distinct()


def _names_held(left: DataFrame, right: DataFrame, on: list[str]) -> DataFrame:
    """Pairs (a, b) of left (a, wa, on) and right (b, wb, on) where the words of one name are all among the other's.

    They meet by the word of the shorter name that is rarest within `on`: words that many bear, and places that many hold, pair nobody.
    """
    left, right = materialise(left.distinct(), "left-names"), materialise(right.distinct(), "right-names")
    words = lambda df, w: df.withColumn("word", F.explode(w))
    count = words(left, "wa").select(*on, "word").unionByName(words(right, "wb").select(*on, "word")).groupBy(*on, "word").agg(F.count("*").alias("n"))

    def rarest(df: DataFrame, k: str) -> DataFrame:
        best = words(df, f"w{k}").join(count.hint("merge"), [*on, "word"]).groupBy(*on, k, f"w{k}").agg(F.min(F.struct("n", "word"))["word"].alias("word"))
        return best.hint("merge")

    of_b = F.size(F.array_except("wa", "wb")) == 0
    of_a = F.size(F.array_except("wb", "wa")) == 0
    return rarest(left, "a").join(words(right, "wb").hint("merge"), [*on, "word"]).where(of_b).select("a", "b").unionByName(rarest(right, "b").join(words(left, "wa").hint("merge"), [*on, "word"]).where(of_a).select("a", "b")).distinct()


def _folded(rows: DataFrame, key: str, fold, schema: str) -> DataFrame:
    """fold(key, rows as mappings) gives tuples of schema, for each key; its rows are few. A key is a row for Python, as one group each costs more than most
    folds, and keys are dealt over all partitions: their bytes are few, their work is not."""
    n = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    packed = rows.repartition(n, key).groupBy(key).agg(F.collect_list(F.struct(*[c for c in rows.columns if c != key])).alias("rows"))
    names = [c.split()[0] for c in schema.split(", ")]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            yield pd.DataFrame([t for k, mine in zip(b[key], b["rows"], strict=True) for t in fold(k, mine)], columns=names)

    return packed.mapInPandas(run, schema)


def _joined_groups(person, rows) -> list[tuple]:
    """The groups of one person in order, each joined to the first that nothing separates it from: pairs (a, b) of members to link, undecided: kept together or
    parted without a decision on every pair."""
    apart = {frozenset(p) for r in rows if r["apart"] is not None for p in r["apart"]}
    decided = {frozenset(p) for r in rows if r["decided"] is not None for p in r["decided"]}
    by: dict = {}
    for r in sorted(rows, key=lambda r: r["member"]):
        by.setdefault(r["component"], []).append(r["member"])
    groups = list(by.values())
    between = lambda x, y, known: any(frozenset((m, n)) in known for m in x for n in y)
    joined: list[list] = []
    out = []
    for group in groups:
        target = next((t for t in joined if not between(t, group, apart)), None)
        if target is None:
            joined.append(list(group))
        else:
            out.append((target[0], group[0]))
            target += group
    open_ = len(joined) < len(groups) and not all(between(x, y, decided) for i, x in enumerate(groups) for y in groups[i + 1 :])
    out.append((None, None)) if open_ else None
    return [(person, a, b, a is None) for a, b in out]


def resolve_people(members: DataFrame, mandates: DataFrame, same: DataFrame, different: DataFrame, protected: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Which member records are one person, by official evidence and decisions alone, and what a human should look at.

    members: member, person (null: none), name, profile (null: the other source), careers array<string> (profiles of other terms); mandates: member, legislature,
    chamber, constituency, starts_on, ends_on; same: decision, member, person (pinned, or null); different: a, b; protected: person (referred to elsewhere).

    Joined: linked careers; one seat seen by two sources under matching names, if only one fits; decisions. Kept together: records that share a person already,
    unless seats at once or a decision part them. Names alone never join. Returns (member, person_was, person, reason: null, unassigned, split or merged) and
    the review list (kind, subject): unlinked_careers_one_person, possible_same_person, ambiguous_same_seat, conflict.
    """
    own = members.where("profile is not null").select("profile", F.col("member").alias("b"))
    careers = members.select(F.col("member").alias("a"), F.explode("careers").alias("profile")).join(own, "profile").select("a", "b")

    seat = mandates.select("member", "legislature", "chamber", X.constituency_key(F.col("constituency")).alias("place")).where("place <> ''")
    named = lambda df, k: df.join(seat, "member").select(F.col("member").alias(k), X.name_tokens(F.col("name")).alias(f"w{k}"), "legislature", "chamber", "place").where(F.size(f"w{k}") >= 2)
    fits = _names_held(named(members.where("profile is null"), "a"), named(members.where("profile is not null"), "b"), ["legislature", "chamber", "place"])
    one = fits.groupBy("a").agg(F.min("b").alias("b"), F.count_distinct("b").alias("n"))

    held = same.join(members.select("member"), "member", "left_semi")
    lead = held.groupBy("decision").agg(F.min("member").alias("a"))
    decided = held.join(lead, "decision").select("a", F.col("member").alias("b"))
    evidence = materialise(careers.unionByName(one.where("n = 1").select("a", "b")).unionByName(decided), "evidence")
    label = E.connected(evidence)
    known = materialise(members.join(label.withColumnRenamed("id", "member"), "member", "left").withColumn("component", F.coalesce("component", "member")), "known")

    both_ways = different.select("a", "b").unionByName(different.select(F.col("b").alias("a"), F.col("a").alias("b")))
    comp = known.select("member", "component")
    against = different.join(comp.select(F.col("member").alias("a"), F.col("component").alias("ca")), "a").join(comp.select(F.col("member").alias("b"), F.col("component").alias("cb")), "b").where("ca = cb")

    # Records of one person in several groups: a person has few, so they are settled person by person.
    shared = known.where("person is not null").groupBy("person").agg(F.count_distinct("component").alias("n")).where("n > 1").select("person")
    some = known.join(shared, "person")
    pair = some.select("person", F.col("member").alias("a"), F.col("component").alias("ca")).join(some.select("person", F.col("member").alias("b"), F.col("component").alias("cb")), "person").where("a < b and ca <> cb")
    apart = _overlapping(pair, members, mandates).unionByName(both_ways.join(pair.select("a", "b"), ["a", "b"], "left_semi")).distinct()
    mates = held.select("decision", F.col("member").alias("a")).join(held.select("decision", F.col("member").alias("b")), "decision").select("a", "b")
    settled = both_ways.unionByName(mates).distinct()
    of = lambda pairs, name: pairs.groupBy("a").agg(F.collect_set(F.array("a", "b")).alias(name)).withColumnRenamed("a", "member")
    rows = some.select("person", "member", "component").join(of(apart, "apart"), "member", "left").join(of(settled, "decided"), "member", "left")
    kept = materialise(_folded(rows, "person", _joined_groups, "person string, a string, b string, review boolean"), "kept")

    final = E.connected(evidence.unionByName(kept.where("not review").select("a", "b")))
    grouped = members.join(final.withColumnRenamed("id", "member"), "member", "left").withColumn("group", F.coalesce("component", "member")).drop("component")
    pinned = same.where("person is not null").select("member", F.col("person").alias("pinned"))
    grouped = materialise(grouped.join(pinned, "member", "left"), "grouped")

    # A group and the persons that it may keep: what hangs together by shared persons is settled in order of pins, size and id.
    latest = mandates.groupBy("member").agg(F.max("starts_on").alias("latest"))
    best = grouped.join(latest, "member", "left").groupBy("group").agg(
        F.max(F.struct(F.col("profile").isNotNull().alias("own"), F.coalesce(F.col("latest").cast("string"), F.lit("")).alias("day"), F.col("name").alias("name")))["name"].alias("name"),
        F.count("*").alias("size"), F.min("member").alias("first"), F.max("pinned").alias("pinned"),
    )
    votes = grouped.where("person is not null").groupBy("group", "person").agg(F.count("*").alias("n")).join(protected.select("person", F.lit(1).alias("kept")).distinct(), "person", "left")
    wishes = best.join(votes.groupBy("group").agg(F.collect_list(F.struct("person", "n", F.coalesce("kept", F.lit(0)).alias("kept"))).alias("wishes")), "group", "left")
    ties = votes.select("group", "person").unionByName(best.where("pinned is not null").select("group", F.col("pinned").alias("person")))
    links = ties.select(F.concat(F.lit("g:"), "group").alias("a"), F.concat(F.lit("p:"), "person").alias("b"))
    blocks = E.connected(links).where("id like 'g:%'").select(F.substring("id", 3, 1 << 20).alias("group"), F.col("component").alias("block"))

    def choose(block, part) -> list[tuple]:
        taken, out = set(), []
        for g in sorted(part, key=lambda g: (g["pinned"] is None, -g["size"], g["first"])):
            mine = sorted((w for w in (g["wishes"] if g["wishes"] is not None else [])), key=lambda w: (-w["kept"], -w["n"], w["person"]))
            free = [w["person"] for w in mine if w["person"] not in taken]
            person = g["pinned"] if g["pinned"] is not None and g["pinned"] not in taken else free[0] if free else None
            taken.add(person)
            out.append((g["group"], person, g["name"]))
        return out

    placed = wishes.join(blocks, "group", "left").withColumn("block", F.coalesce("block", F.concat(F.lit("g:"), "group")))
    placed = materialise(placed.withColumn("groups", F.count("*").over(W.partitionBy("block"))), "placed")
    first = F.get(F.array_sort(F.transform("wishes", lambda w: F.struct((-w["kept"]).alias("kept"), (-w["n"]).alias("n"), w["person"].alias("person")))), F.lit(0))["person"]
    alone = placed.where("groups = 1").select("group", F.coalesce("pinned", first).alias("person"), "name")  # nobody else asks for its persons
    chosen = materialise(alone.unionByName(_folded(placed.where("groups > 1"), "block", choose, "group string, person string, name string")), "chosen")
    # New people get a name of their own: the slug, numbered from 2 where it is taken already.
    fresh = chosen.where("person is null").withColumn("base", F.concat(F.lit("person-"), X.slug(F.col("name"))))
    used = members.where("person is not null").select("person").unionByName(chosen.where("person is not null").select("person")).distinct()
    used = used.withColumn("base", F.regexp_replace("person", r"-\d+$", "")).unionByName(used.withColumn("base", F.col("person"))).groupBy("base").agg(F.collect_set("person").alias("used"))

    def number(base, part) -> list[tuple]:
        taken, out = set(part[0]["used"] if part[0]["used"] is not None else ()), []
        for group in sorted(r["group"] for r in part):
            name, n = base, 1
            while name in taken:
                n += 1
                name = f"{base}-{n}"
            taken.add(name)
            out.append((group, name))
        return out

    fresh = materialise(fresh.join(used, "base", "left").withColumn("groups", F.count("*").over(W.partitionBy("base"))), "fresh")
    free = (F.col("groups") == 1) & ~F.coalesce(F.array_contains("used", F.col("base")), F.lit(False))
    new = fresh.where(free).select("group", F.col("base").alias("person")).unionByName(_folded(fresh.where(~free).select("base", "group", "used"), "base", number, "group string, person string"))
    people = materialise(chosen.where("person is not null").select("group", "person", F.lit(False).alias("new")).unionByName(new.withColumn("new", F.lit(True))), "people")
    moved = F.when(F.col("was").isNull(), "unassigned").when(F.col("new"), "split").otherwise("merged")
    result = grouped.select("member", F.col("person").alias("was"), "group").join(people, "group").select("member", F.col("was").alias("person_was"), "person", F.when(~F.col("was").eqNullSafe(F.col("person")), moved).alias("reason"))

    # Groups under one name key that nothing parts: listed, never merged.
    key = F.array_join(F.array_sort(X.name_tokens(F.col("name"))), " ")
    firsts = grouped.groupBy("group").agg(F.min_by("name", "member").alias("name")).select("group", key.alias("key"))
    alike = firsts.select("key", F.col("group").alias("ga")).join(firsts.select("key", F.col("group").alias("gb")), "key").where("ga < gb")
    side = lambda k: grouped.select(F.col("group").alias(f"g{k}"), F.col("member").alias(k))
    across = alike.join(side("a"), "ga").join(side("b"), "gb")
    clash = across.join(_overlapping(across, members, mandates), ["a", "b"], "left_semi").select("ga", "gb").distinct().withColumn("clash", F.lit(True))
    told = across.join(both_ways, ["a", "b"], "left_semi").select("ga", "gb").distinct().withColumn("told", F.lit(True))
    possible = alike.join(clash, ["ga", "gb"], "left").join(told, ["ga", "gb"], "left").groupBy("key").agg(F.max(F.col("clash").isNull()).alias("free"), F.min(F.col("told").isNotNull()).alias("all"))
    review = [
        kept.where("review").select(F.lit("unlinked_careers_one_person").alias("kind"), F.col("person").alias("subject")),
        possible.where(F.col("free") & ~F.col("all")).select(F.lit("possible_same_person").alias("kind"), F.col("key").alias("subject")),
        one.where("n > 1").select(F.lit("ambiguous_same_seat").alias("kind"), F.col("a").alias("subject")),
        against.select(F.lit("conflict").alias("kind"), F.concat_ws(",", F.least("a", "b"), F.greatest("a", "b")).alias("subject")),
    ]
    listed = review[0]
    for more in review[1:]:
        listed = listed.unionByName(more)
    return result, listed


def merge_evidence(rows: DataFrame, organisation: str, member: str, party: str, least: int = 5, share: float = 0.9) -> DataFrame:
    """Organisations most of whose members first belonged to one party: organisation, party, members, agree."""
    by = rows.groupBy(organisation, party).agg(F.count_distinct(member).alias("agree"))
    members = rows.groupBy(organisation).agg(F.count_distinct(member).alias("members"))
    return by.join(members, organisation).where((F.col("members") >= least) & (F.col("agree") >= share * F.col("members"))).select(organisation, party, "members", "agree")


def alignment(group_id: Column, group: Column, member: Column, member_from: Column, party: Column, party_from: Column, curated: Column) -> Column:
    """With the government or against it: unaffiliated by the group's name, else the group's own word, else the newer of member and party
    (the member on a tie), else opposition where others are known to govern."""
    newer = F.when(member.isNotNull() & (party.isNull() | (member_from >= party_from)), member).otherwise(party)
    named = F.rlike(X.fold_ro(F.coalesce(group_id, F.lit(""))), F.lit("unaffiliated|neafiliat"))
    return F.when(named, "unaffiliated").otherwise(F.coalesce(group, newer, F.when(curated, "opposition"), F.lit("unknown")))


def party_alignment(party: Column, explicit: Column, curated: Column, label: Column) -> Column:
    """A party's own entry; opposition where any coalition is curated; members without a party are unaffiliated if their label says so."""
    alone = F.when(F.contains(X.fold_ro(F.coalesce(label, F.lit(""))), F.lit("neafiliat")), "unaffiliated").otherwise("unknown")
    return F.when(party.isNull(), alone).otherwise(F.coalesce(explicit, F.when(curated, "opposition").otherwise("unknown")))


def stale_mandates(open_: DataFrame, roster: DataFrame, member: str) -> DataFrame:
    """Open mandates of members that a complete roster no longer lists. allowed: false for all when more than max(3, 5 %) would end,
    which tells of ids that differ rather than of departures."""
    gone = open_.join(roster.select(member).distinct(), member, "left_anti")
    n = gone.agg(F.count("*").alias("__gone")).join(roster.agg(F.count_distinct(member).alias("__listed")))
    allowed = F.col("__gone") <= F.greatest(F.lit(3), F.ceil(F.col("__listed") * 0.05))
    return gone.join(n.select(allowed.alias("allowed")))


def seat_rows(named: DataFrame, sitting: DataFrame, keys: list[str], choice: str) -> DataFrame:
    """Ballots by name and, for those who sat without one, the choice `unknown`."""
    absent = sitting.select(*keys).distinct().join(named.select(*keys), keys, "left_anti").withColumn(choice, F.lit("unknown"))
    return named.select(*keys, choice).unionByName(absent)


def clip_at_merger(rows: DataFrame, mergers: DataFrame) -> DataFrame:
    """Party rows around a merger: those of the absorbed end the day before, what they had left goes on under the absorber.

    rows: person, party, starts_on, ends_on; mergers: party, absorber, merged_on (one for each party).
    """
    both = rows.join(mergers, "party", "left")
    after = F.col("merged_on").isNotNull() & (T.end(F.col("ends_on")) >= F.col("merged_on"))
    kept = both.where(F.col("merged_on").isNull() | (F.col("starts_on") < F.col("merged_on")))
    own = kept.select("person", "party", "starts_on", F.when(after, F.date_sub("merged_on", 1)).otherwise(F.col("ends_on")).alias("ends_on"))
    on = both.where(after).select("person", F.col("absorber").alias("party"), F.greatest("starts_on", "merged_on").alias("starts_on"), "ends_on")
    return own.unionByName(on)


def opposition_gaps(careers: DataFrame, governments: DataFrame) -> DataFrame:
    """Each career row (id, party, starts_on, ends_on) cut by the governments its party belonged to; the days between are opposition.

    governments: party, starts_on, ends_on. Returns id, starts_on, ends_on, side.
    """
    g = governments.select("party", F.col("starts_on").alias("__s"), F.col("ends_on").alias("__e"))
    hit = careers.join(g, "party").where(T.overlaps(F.col("starts_on"), F.col("ends_on"), F.col("__s"), F.col("__e")))
    inside = hit.select("id", F.greatest("starts_on", "__s").alias("starts_on"), F.least(T.end(F.col("ends_on")), T.end(F.col("__e"))).alias("ends_on"))
    merged = T.coalesce_touching(inside, ["id"], "starts_on", "ends_on").select("id", "starts_on", T.end(F.col("ends_on")).alias("ends_on"))
    held = merged.withColumn("side", F.lit("government"))
    # Edges of the career count as periods of no length, so that gaps before and after look like gaps between.
    edges = careers.select("id", F.date_sub("starts_on", 1).alias("starts_on"), F.date_sub("starts_on", 1).alias("ends_on"))
    last = careers.where("ends_on is not null").select("id", F.date_add("ends_on", 1).alias("starts_on"), F.date_add("ends_on", 1).alias("ends_on"))
    open_ = careers.where("ends_on is null").select("id", F.lit("9999-12-31").cast("date").alias("starts_on")).withColumn("ends_on", F.col("starts_on"))
    all_ = merged.unionByName(edges).unionByName(last).unionByName(open_)
    after = F.lead("starts_on").over(W.partitionBy("id").orderBy("starts_on", "ends_on"))
    gaps = all_.select("id", F.date_add("ends_on", 1).alias("a"), F.date_sub(after, 1).alias("b"))
    out = held.unionByName(gaps.where("a <= b").select("id", F.col("a").alias("starts_on"), F.col("b").alias("ends_on"), F.lit("opposition").alias("side")))
    return out.withColumn("ends_on", F.when(F.col("ends_on") < F.lit("9999-12-30").cast("date"), F.col("ends_on")))


def richer_source(a: DataFrame, b: DataFrame, keys: list[str]) -> DataFrame:
    """For each key the rows of the source that has more of them; the first on a tie. Adds `source`, 0 or 1."""
    both = a.withColumn("source", F.lit(0)).unionByName(b.withColumn("source", F.lit(1)))
    n = both.groupBy(*keys).agg(F.count_if(F.col("source") == 0).alias("__a"), F.count_if(F.col("source") == 1).alias("__b"))
    chosen = n.select(*keys, F.when(F.col("__a") >= F.col("__b"), 0).otherwise(1).alias("source"))
    return both.join(chosen, [*keys, "source"], "left_semi")


def fill_from_roster(rows: DataFrame, roster: DataFrame, groups: DataFrame, member: str) -> DataFrame:
    """Members without an open link get the group that their roster label names alone; the rest are told apart as skipped.

    rows: member, group_id (null: none); roster: member, label; groups: label, group_id. Returns member, group_id, status.
    """
    missing = rows.groupBy(member).agg(F.count("group_id").alias("__n")).where("__n = 0").select(member)
    labelled = missing.join(roster.groupBy(member).agg(F.max("label").alias("label")), member, "left")
    found = R.unique_match(labelled, groups, ["label"], "group_id")
    status = F.when(F.col("group_id").isNotNull(), "filled").when(F.col("label").isNull(), "not on the roster").otherwise("no single group")
    return found.select(member, "group_id", status.alias("status"))


def timelines(events: DataFrame, today: str) -> DataFrame:
    """Holder periods of posts with one seat from appointments and recalls (place, day, seq, kind, holder): place, holder, started_on, ended_on, ended.

    On one day recalls come first. A second appointment of the holder goes on; another's replaces the holder; a recall of somebody else is a
    period without a start. A post whose last period began over `LAPSE_YEARS` ago is lapsed. Appointments number the stretches between them, and
    stretches of one holder that no recall has ended are one period: a window of each post, no fold.
    """
    named = F.col("kind") == "appointed"
    order = [F.col("day"), named.cast("int"), F.col("seq")]
    w = W.partitionBy("place").orderBy(*order)
    upto = w.rowsBetween(W.unboundedPreceding, 0)
    rows = events.where(F.col("kind").isin("appointed", "recalled")).withColumns({"g": F.sum(named.cast("int")).over(upto), "now": F.last(F.when(named, F.col("holder")), ignorenulls=True).over(upto)})
    # Within a stretch the first recall of its holder ends it; every other recall is of somebody who did not hold the post.
    own = (~named & (F.col("holder") == F.col("now"))).cast("int")
    rows = rows.withColumn("n", F.sum(F.coalesce(own, F.lit(0))).over(W.partitionBy("place", "g").orderBy(*order).rowsBetween(W.unboundedPreceding, 0)))
    ends = F.coalesce(own, F.lit(0)) * (F.col("n") == 1).cast("int") == 1
    strangers = rows.where(~named & ~ends).select("place", "holder", F.lit(None).cast("date").alias("started_on"), F.col("day").alias("ended_on"), F.lit("recalled").alias("ended"))
    stretch = rows.where("g > 0").groupBy("place", "g").agg(F.max("now").alias("holder"), F.min(F.when(named, F.col("day"))).alias("day"), F.min(F.when(ends, F.col("day"))).alias("over"))
    by = W.partitionBy("place").orderBy("g")
    goes_on = (F.lag("holder").over(by) == F.col("holder")) & F.lag("over").over(by).isNull()
    period = stretch.withColumn("fresh", (~F.coalesce(goes_on, F.lit(False))).cast("int")).withColumn("p", F.sum("fresh").over(by.rowsBetween(W.unboundedPreceding, 0)))
    held = period.groupBy("place", "p").agg(F.max("holder").alias("holder"), F.min("day").alias("started_on"), F.max_by("over", "g").alias("over"))
    after = F.lead("started_on").over(W.partitionBy("place").orderBy("p"))
    lapsed = F.datediff(F.lit(today).cast("date"), "started_on") / 365.25 > LAPSE_YEARS
    ended = F.when(F.col("over").isNotNull(), "recalled").when(F.col("after").isNotNull(), "replaced").when(lapsed, "lapsed").otherwise("open")
    told = held.withColumn("after", after).select("place", "holder", "started_on", F.coalesce("over", "after").alias("ended_on"), ended.alias("ended"))
    return told.unionByName(strangers)


def grouped_pages(pages: DataFrame) -> DataFrame:
    """Pages (page, main boolean, law, keys array<string>) in groups that share keys: page, group (its least page).

    A group holds at most one main page, and pages that name different laws do not meet. Which of several conflicting links counts
    depends on the order of pages, so each connected block (the few pages of one dossier) is settled on its own, in page order.
    """
    keyed = pages.select("page", F.explode("keys").alias("key"))
    edges = keyed.join(keyed.groupBy("key").agg(F.min("page").alias("first")), "key").where("page <> first").select(F.col("first").alias("a"), F.col("page").alias("b"))
    blocks = materialise(pages.select("page", "main", "law", "keys").join(E.connected(edges).select(F.col("id").alias("page"), F.col("component").alias("block")), "page", "left"), "blocks")

    def settle(block, rows) -> list[tuple]:
        group, owner = {}, {}
        members: dict[int, list] = {}
        mains, laws = {}, {}
        for r in sorted(rows, key=lambda r: r["page"]):
            page = r["page"]
            group[page], members[page], mains[page], laws[page] = page, [page], int(r["main"]), {r["law"]} if r["law"] else set()
            for key in sorted(r["keys"]):
                other = owner.setdefault(key, page)
                a, b = group[other], group[page]
                if a == b or mains[a] + mains[b] > 1 or len(laws[a] | laws[b]) > 1:
                    continue
                low, high = min(a, b), max(a, b)
                moved = members.pop(high)
                members[low] += moved
                mains[low] += mains.pop(high)
                laws[low] |= laws.pop(high)
                group |= {x: low for x in moved}
        return sorted(group.items())

    alone = blocks.where("block is null").select("page", F.col("page").alias("group"))
    return alone.unionByName(_folded(blocks.where("block is not null"), "block", settle, "page long, group long"))


def ordered_assignment(items: DataFrame) -> DataFrame:
    """A unit for every item of an ordered list whose best reading is unique (block, item, key, units array<string>).

    Staying in a unit is free while keys rise and costs 3 where they fall; changing the unit costs 1. An item with several units gets the one
    that lies on every cheapest way through the list. A block is a county's list of places.
    """

    def solve(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows[rows["units"].map(len) > 0].sort_values("item")
        items, keys, units = rows["item"].tolist(), rows["key"].tolist(), [list(u) for u in rows["units"]]
        cost = [np.where(np.equal.outer(np.array(u, object), np.array(v, object)), 0 if b >= a else 3, 1) for u, v, a, b in zip(units, units[1:], keys, keys[1:], strict=False)]
        before = [np.zeros(len(u)) for u in units]
        after = [np.zeros(len(u)) for u in units]
        for i, c in enumerate(cost):
            before[i + 1] = (before[i][:, None] + c).min(0)
        for i in range(len(cost) - 1, -1, -1):
            after[i] = (cost[i] + after[i + 1][None, :]).min(1)
        out = []
        for item, u, total in zip(items, units, map(np.add, before, after), strict=True):
            best = np.flatnonzero(total == total.min())
            if len(u) > 1 and len(best) == 1:
                out.append((rows["block"].iloc[0], item, u[best[0]]))
        return pd.DataFrame(out, columns=["block", "item", "unit"])

    return items.groupBy("block").applyInPandas(solve, "block long, item long, unit string")
