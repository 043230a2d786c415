"""Who is who: components of links, voters by falling evidence, merges, and replays of ordered events."""

from __future__ import annotations

import datetime as dt

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyloom.functions.text import names_match
from tallyloom.session import materialise, scratch


def connected(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(id, component), the smallest id that an id is linked with, for the ends of edges between different ids.

    Contraction: each id is replaced by one of its closed neighbourhood, in turn the smallest and one that a hash of the round picks, until no edge
    is left; the hash keeps long chains from shrinking by one end at a time. An id goes straight on to what its own replacement is replaced by: ranks fall along
    the way, so it has no circle, and links, of which there are more than ids, are fewer in each round. The replacements are then followed back. Files cut the
    lineage, and go when read. The first links need not be distinct, as the least of a neighbourhood is the same.
    """
    with scratch(edges.sparkSession) as own:
        now = materialise(edges.select(F.col(a).alias("u"), F.col(b).alias("v")).where("u <> v"), "links")
        levels: list[DataFrame] = []
        while not now.isEmpty():
            both = now.unionByName(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
            if len(levels) % 2:
                rank = lambda c, turn: F.struct(F.xxhash64(F.col(c), F.lit(turn)).alias("h"), F.col(c).alias("x"))
                to = F.least(F.min(rank("v", len(levels))), F.min(rank("u", len(levels))))["x"]
            else:
                to = F.least(F.min("v"), F.min("u"))
            near = materialise(both.groupBy("u").agg(to.alias("to")), "near")
            level = materialise(near.join(near.select(F.col("u").alias("to"), F.col("to").alias("far")), "to").select("u", F.col("far").alias("to")), "level")
            levels.append(level)
            moved = now.join(level, "u").select(F.col("to").alias("u"), "v").join(level.select(F.col("u").alias("v"), F.col("to").alias("w")), "v").select("u", F.col("w").alias("v"))
            last = now
            now = materialise(moved.where("u <> v").select(F.least("u", "v").alias("u"), F.greatest("u", "v").alias("v")).distinct(), "links")
            own.drop(last, near)
        if not levels:
            return edges.sparkSession.createDataFrame([], f"id {edges.schema[a].dataType.simpleString()}, component {edges.schema[a].dataType.simpleString()}")
        root = levels[-1]
        for level in reversed(levels[:-1]):
            root = level.join(root.select(F.col("u").alias("to"), F.col("to").alias("far")), "to", "left").select("u", F.coalesce("far", "to").alias("to"))
        root = materialise(root, "roots")
        least = root.groupBy("to").agg(F.least(F.min("u"), F.min("to")).alias("component"))
        return own.keep(materialise(root.join(least, "to").select(F.col("u").alias("id"), "component"), "components"))


def resolve_voters(voters: DataFrame, sitting: DataFrame, aliases: DataFrame) -> DataFrame:
    """voter_id, member_id, evidence: an alias of a sitting member, the id itself, the official id, a unique name; else null."""
    ids = sitting.select("member_id").distinct()
    by_alias = voters.join(aliases.withColumnRenamed("alias_id", "voter_id"), "voter_id").join(ids.withColumnRenamed("member_id", "canonical_id"), "canonical_id", "left_semi").select("voter_id", F.col("canonical_id").alias("by_alias"))
    by_id = voters.join(ids.withColumnRenamed("member_id", "voter_id"), "voter_id", "left_semi").select("voter_id", F.col("voter_id").alias("by_id"))
    one = lambda df, name: df.groupBy("voter_id").agg(F.min("member_id").alias(name), F.count_distinct("member_id").alias("k")).where("k = 1").drop("k")
    official = one(voters.where("official_id is not null").join(sitting, "official_id").select("voter_id", "member_id"), "by_official")
    # Names meet on any shared token, so that the comparison is an equi-join.
    token = lambda df, name: df.withColumn("token", F.explode(F.array_distinct(F.split(F.lower("name"), "[^\\p{L}]+")))).withColumnRenamed("name", name)
    near = token(voters.select("voter_id", "name"), "x").join(token(sitting.select("member_id", "name"), "y"), "token").where(names_match(F.col("x"), F.col("y")))
    named = one(near.select("voter_id", "member_id"), "by_name")
    out = voters.select("voter_id").distinct()
    for df in (by_alias, by_id, official, named):
        out = out.join(df, "voter_id", "left")
    kinds = ("by_alias", "by_id", "by_official", "by_name")
    evidence = F.coalesce(*[F.when(F.col(k).isNotNull(), F.lit(k[3:])) for k in kinds])
    return out.select("voter_id", F.coalesce(*kinds).alias("member_id"), evidence.alias("evidence"))


def merge_children(child: DataFrame, fk: str, mapping: DataFrame) -> DataFrame:
    """Children of merged rows hang on the survivor. mapping: old, survivor."""
    return child.join(mapping.withColumnRenamed("old", fk), fk, "left").withColumn(fk, F.coalesce("survivor", fk)).drop("survivor")


def veto_shared(mapping: DataFrame, votes: DataFrame, vote: str, member: str) -> DataFrame:
    """Merges survive only if both ids never voted in the same vote."""
    mine = votes.select(vote, member).distinct()
    old = mapping.join(mine.withColumnRenamed(member, "old"), "old")
    clash = old.join(mine.withColumnRenamed(member, "survivor"), [vote, "survivor"], "left_semi").select("old").distinct()
    return mapping.join(clash, "old", "left_anti")


def merge_plan(ghosts: DataFrame, votes: DataFrame, sitting: DataFrame) -> DataFrame:
    """Which voters without a seat are which sitting members: old, survivor, votes.

    ghosts: ghost, name; votes: vote, day, member; sitting: member, name, starts_on, ends_on. On each day of a ghost's votes the members who sat and bear the
    name are looked up; a ghost is merged only if every day has one and all agree, and not if both ids voted in one vote.
    """
    token = lambda df, name: df.withColumn("token", F.explode(F.array_distinct(F.split(F.lower("name"), "[^\\p{L}]+")))).withColumnRenamed("name", name)
    named = token(ghosts.select("ghost", "name"), "x").join(token(sitting, "y"), "token").where(names_match(F.col("x"), F.col("y"))).select("ghost", "member", "starts_on", "ends_on").distinct()
    days = ghosts.select("ghost").join(votes.select(F.col("member").alias("ghost"), "day", "vote"), "ghost")
    sat = (F.col("starts_on") <= F.col("day")) & (F.coalesce("ends_on", F.lit("9999-12-31").cast("date")) >= F.col("day"))
    on_day = days.select("ghost", "day").distinct().join(named, "ghost", "left").groupBy("ghost", "day").agg(F.min(F.when(sat, F.col("member"))).alias("lo"), F.max(F.when(sat, F.col("member"))).alias("hi"))
    agreed = on_day.groupBy("ghost").agg(F.min("lo").alias("survivor"), F.max("hi").alias("most"), F.count_if(F.col("lo").isNull() | (F.col("lo") != F.col("hi"))).alias("open")).where("open = 0 and survivor = most and survivor <> ghost")
    n = days.groupBy("ghost").agg(F.count_distinct("vote").alias("votes"))
    plan = agreed.join(n, "ghost").select(F.col("ghost").alias("old"), "survivor", "votes")
    return veto_shared(plan, votes, "vote", "member").select("old", "survivor", "votes")


_ROLES = "block string, government string, person string, post string, interim boolean, starts_on date, ends_on date, reason string, carried boolean, kind string"
#: Endings on the day of the beginning that tell of no period at all.
NO_PERIOD = ("replaced", "interim_ended", "new_cabinet")


class Cabinets:
    """The fold of one block: its governments and its decrees' events, in order."""

    def __init__(self, block, governments: list[dict]):
        self.block, self.governments = block, sorted(governments, key=lambda g: g["starts_on"])
        self.open: list[dict] = []
        self.roles: list[dict] = []
        self.notes: list[tuple] = []
        self.started: set = set()
        self.number = 0

    @classmethod
    def restored(cls, block, governments: list[dict], saved: dict | None) -> Cabinets:
        """A fold that goes on from what saved() has kept; governments and roles as JSON gives them, with dates as text."""
        date = lambda d: d and dt.date.fromisoformat(d)
        out = cls(block, [{**g, "starts_on": date(g["starts_on"]), "ends_on": date(g["ends_on"])} for g in governments])
        if saved is not None:
            read = lambda r: r and {**r, "starts_on": date(r["starts_on"]), "ends_on": date(r["ends_on"]), "origin": read(r["origin"])}
            out.open = [read(r) for r in saved["open"]]
            out.roles, out.started, out.number = list(out.open), set(saved["started"]), saved["number"]
        return out

    def saved(self) -> dict:
        """What a later fold needs: open roles, each with the one that it was carried over from, and the governments begun."""
        write = lambda r: r and {**r, "starts_on": str(r["starts_on"]), "ends_on": r["ends_on"] and str(r["ends_on"]), "origin": write(r["origin"] and {**r["origin"], "origin": None})}
        return {"open": [write(r) for r in self.open], "started": sorted(self.started), "number": self.number}

    def told(self) -> list[tuple[str, dict]]:
        """Roles and notes of this fold as they stand now: an open role ends with its government where that has an end."""
        ends = {g["government"]: self.end_of(g) for g in self.governments}
        out = []
        for role in self.roles + [r["origin"] for r in self.roles if r["origin"] is not None]:
            end = ends[role["government"]] if role["ends_on"] is None else None
            if end is not None and role["origin"] is not None and end == role["starts_on"]:
                out += [("role", role | {"gone": True}), ("role", role["origin"] | {"reason": "government_ended"})]
            else:
                out.append(("role", role if end is None else role | {"ends_on": end, "reason": "government_ended"}))
        for n in self.notes:
            self.number += 1
            out.append((n[-1], {"number": self.number, "government": None, "person": n[2], "post": n[3], "interim": None, "starts_on": n[5], "ends_on": None, "reason": n[7], "carried": None, "gone": False}))
        return out

    def at(self, day):
        held = [g for g in self.governments if g["starts_on"] <= day]
        return held[-1] if held else None

    def end_of(self, g: dict):
        """A cabinet stays until the next real government where an acting one stood in between."""
        if g["ends_on"] is None or g["acting"]:
            return g["ends_on"]
        later = [x for x in self.governments if x["starts_on"] >= g["ends_on"]]
        real = [x["starts_on"] for x in later if not x["acting"]]
        return real[0] if real and any(x["acting"] and x["starts_on"] < real[0] for x in later) else g["ends_on"]

    def begin(self, g: dict, person, post, day, interim: bool, carried_from: dict | None = None) -> None:
        self.number += 1
        role = {"number": self.number, "gone": False, "government": g["government"], "person": person, "post": post, "interim": interim, "starts_on": max(day, g["starts_on"]), "ends_on": None, "reason": None, "carried": carried_from is not None, "origin": carried_from}
        self.roles.append(role)
        self.open.append(role)

    def close(self, role: dict, day, reason: str) -> None:
        self.open = [r for r in self.open if r is not role]
        if role["origin"] is not None and day == role["starts_on"]:  # carried over and gone the same day: the first period is the one that ended
            role["gone"] = True
            role["origin"]["reason"] = reason
        else:
            role |= {"ends_on": day, "reason": reason}

    def advance(self, day) -> None:
        """Governments that have begun by a day, with the cabinets that they carry over, and cabinets that have ended before it."""
        for g in self.governments:
            if g["starts_on"] > day or g["government"] in self.started:
                continue
            self.started.add(g["government"])
            earlier = [x for x in self.governments if not x["acting"] and x["starts_on"] < g["starts_on"]]
            if g["carry_over"] and not g["acting"] and not g["skip"] and earlier and not earlier[-1]["skip"]:
                for role in [r for r in self.open if r["government"] == earlier[-1]["government"]]:
                    self.close(role, g["starts_on"], "government_ended")
                    self.begin(g, role["person"], role["post"], g["starts_on"], role["interim"], role)
        ends = {g["government"]: self.end_of(g) for g in self.governments}
        for role in list(self.open):
            if ends[role["government"]] is not None and ends[role["government"]] < day:
                self.close(role, ends[role["government"]], "government_ended")

    def apply(self, e: dict) -> None:
        day, kind, post = e["day"], e["type"], e["post"]
        g = self.at(day)
        if g is None or g["skip"] or (kind == "roster" and g["acting"]):
            return self.note(e, "outside")
        seat = lambda r: post is None or r["post"] == post
        mine = [r for r in self.open if r["person"] == e["person"]]
        if kind == "roster":
            named = [(m["person"], m["post"]) for m in e["members"]]
            for r in [r for r in self.open if r["government"] == g["government"]]:
                if not r["interim"] and (r["person"], r["post"]) not in named:
                    self.close(r, day, "new_cabinet")
                elif r["interim"] and r["post"] in [p for _, p in named]:
                    self.close(r, day, "interim_ended")
            for person, seat_ in named:
                if not any(r["government"] == g["government"] and not r["interim"] and (r["person"], r["post"]) == (person, seat_) for r in self.open):
                    self.begin(g, person, seat_, day, False)
        elif kind == "appoint":
            for r in [r for r in self.open if r["post"] == post]:
                self.close(r, day, "interim_ended" if r["interim"] else "replaced")
            self.begin(g, e["person"], post, day, False)
        elif kind == "interim":
            for r in [r for r in self.open if r["interim"] and r["post"] == post]:
                self.close(r, day, "interim_ended")
            self.begin(g, e["person"], post, day, True)
        elif kind == "suspend":
            self.note(e, "suspension")
        else:
            found = [r for r in mine if r["interim"] and seat(r)] if kind == "interim_end" else [r for r in mine if seat(r)] or mine
            if not found:
                self.note(e, "without_open_role")
            for r in found:
                self.close(r, day, {"interim_end": "interim_ended", "dismiss": "dismissed", "resign": "resigned"}[kind])

    def note(self, e: dict, kind: str) -> None:
        self.notes.append((self.block, None, e["person"], e["post"], None, e["day"], None, e["type"], None, kind))

    def result(self) -> list[tuple]:
        for role in list(self.open):
            end = next(self.end_of(g) for g in self.governments if g["government"] == role["government"])
            if end is not None:
                self.close(role, end, "government_ended")
        lasted = [r for r in self.roles if not r["gone"] and not (r["starts_on"] == r["ends_on"] and r["reason"] in NO_PERIOD)]
        return [(self.block, r["government"], r["person"], r["post"], r["interim"], r["starts_on"], r["ends_on"], r["reason"], r["carried"], "role") for r in lasted] + self.notes


def replay(events: DataFrame, governments: DataFrame) -> DataFrame:
    """Who held which post of which government from when to when, from decrees in order; what can't be placed is a row of another kind.

    events: block, day, seq, type (roster, appoint, interim, interim_end, dismiss, resign, suspend), person, post, members array<struct<person, post>> (of a roster);
    governments: block, government, starts_on, ends_on, acting, skip, carry_over. A seat has one holder: who is named replaces who sat there, and an acting
    holder leaves when a holder is named. A roster ends the old cabinet's other members. A government's end closes what its decrees left open, and
    a government formed anew by the same head carries its cabinet over.

    The fold depends on the order of decrees, so a block (one country's) is folded as a whole: some thousand decrees in all its years.
    """
    g = governments.groupBy("block").agg(F.collect_list(F.struct(*[c for c in governments.columns if c != "block"])).alias("governments"))
    rows = events.join(g, "block", "left").select("block", "day", "seq", "type", "person", "post", "members", "governments")

    def fold(part: pd.DataFrame) -> pd.DataFrame:
        known = part["governments"].iloc[0]
        cabinets = Cabinets(part["block"].iloc[0], [] if known is None else [dict(x) for x in known])
        for e in part.drop(columns="governments").sort_values(["day", "seq"]).astype(object).to_dict("records"):
            e = {k: None if not isinstance(v, (list, tuple)) and not hasattr(v, "__len__") and pd.isna(v) else v for k, v in e.items()}
            cabinets.advance(e["day"])
            cabinets.apply(e)
        return pd.DataFrame(cabinets.result(), columns=[c.split()[0] for c in _ROLES.split(", ")])

    return rows.groupBy("block").applyInPandas(fold, _ROLES)
