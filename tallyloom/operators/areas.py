"""Election areas and places: communes by their code (J16), numbered lists (J17), places of missions (J18), reports asked for and given."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tallyloom.functions.text import fold_ro

# The codes of the capital's sectors, codes that a later register numbers anew (in one constituency), and the numbers of
# constituencies: the capital, whose sectors the minutes count apart, and abroad.
SECTORS = {"1": "179141", "2": "179150", "3": "179169", "4": "179178", "5": "179187", "6": "179196"}
RENUMBERED = {("63171", 14): "61069"}
CAPITAL, ABROAD, SECTOR_NUMBERS = 42, 43, (44, 49)
_TITLES = r"^(republica|regatul|statul|principatul|sultanatul) "


def plain(c: Column) -> Column:
    return F.btrim(F.regexp_replace(fold_ro(F.coalesce(c, F.lit(""))), "[^a-z0-9]+", " "))


def area_key(number: Column, code: Column, name: Column) -> Column:
    """The key of a station's area: its commune's code; abroad by country; the capital's sector by the name; `unknown` with the constituency."""
    sector = F.create_map(*[F.lit(x) for pair in SECTORS.items() for x in pair])[F.nullif(F.regexp_extract(plain(name), r"sectorul\s*(\d)", 1), F.lit(""))]
    own = F.when((number == CAPITAL) & sector.isNotNull(), sector).otherwise(F.btrim(F.coalesce(code, F.lit(""))))
    for (old, at), new in RENUMBERED.items():
        own = F.when((own == old) & (number == at), new).otherwise(own)
    country = F.coalesce(F.nullif(F.replace(plain(name), F.lit(" "), F.lit("-")), F.lit("")), F.lit("unknown"))
    known = F.when(own.isin("", "0"), F.concat(F.lit("unknown:"), number.cast("string"))).otherwise(own)
    return F.when(number == ABROAD, F.concat(F.lit("abroad:"), country)).otherwise(known)


def area_totals(stations: DataFrame, figures: list[str], minutes: bool = True) -> DataFrame:
    """Stations (number, code, name, station, kind, version and figures) added up by area: key, number, sections, figures.

    Of the reports of one station the highest version counts. Rows without a constituency go.
    """
    kept = stations.where("number <> 0")
    if minutes:
        rank = W.partitionBy("number", "code", "station", "kind").orderBy(F.desc("version"), F.desc("row"))
        kept = kept.withColumn("__n", F.row_number().over(rank)).where("__n = 1").drop("__n")
        kept = kept.withColumn("number", F.when(F.col("number").between(*SECTOR_NUMBERS), CAPITAL).otherwise(F.col("number")))
    keyed = kept.withColumn("key", area_key(F.col("number"), F.col("code"), F.col("name")))
    return keyed.groupBy("key").agg(F.min("number").alias("number"), F.count("*").alias("sections"), *[F.sum(c).alias(c) for c in figures])


def coded_lists(votes: DataFrame, name: str = "list", count: str = "votes") -> DataFrame:
    """Lists with their number: 0 for all independents together, the others by their votes, the most first; name, votes, code.

    Lists are ballots' columns, so their totals are few; only these are ranked, in one sort of one row for each list.
    """
    alone = F.rlike(plain(F.col(name)), F.lit("independent"))
    total = votes.groupBy(F.when(alone, "").otherwise(F.col(name)).alias(name)).agg(F.sum(count).alias(count))
    ranked = total.where(F.col(name) != "").orderBy(F.desc(count), name).select(F.collect_list(F.struct(name, count)).alias("all"))
    numbered = ranked.select(F.posexplode("all").alias("at", "l")).select(f"l.{name}", f"l.{count}", (F.col("at") + 1).alias("code"))
    return numbered.unionByName(total.where(F.col(name) == "").select(name, count, F.lit(0).alias("code")))


def normal_place(c: Column) -> Column:
    return F.btrim(F.regexp_replace(fold_ro(F.coalesce(c, F.lit(""))), r"[^a-z]+", " "))


def placed(df: DataFrame, phrase: str, gazetteer: DataFrame, into: str = "place") -> DataFrame:
    """The place that a phrase names, by a spelling of the gazetteer (spelling, place); a title before the name is tried off; else null.

    A phrase in no list is looked up in parts (A, B și C), and a row is given for each part; parts in no list stay, without a place.
    """
    known = gazetteer.select(normal_place(F.col("spelling")).alias("__key"), F.col("place").alias(into)).dropDuplicates(["__key"])
    whole = df.withColumn("__all", normal_place(F.col(phrase)))

    def looked_up(rows: DataFrame, key: str) -> DataFrame:
        by_title = known.select(F.col("__key").alias("__bare"), F.col(into).alias("__second"))
        out = rows.withColumn("__key", F.col(key)).join(known, "__key", "left").withColumn("__bare", F.regexp_replace(F.col(key), _TITLES, ""))
        return out.join(by_title, "__bare", "left").withColumn(into, F.coalesce(into, "__second")).drop("__key", "__bare", "__second")

    first = looked_up(whole, "__all")
    parts = F.filter(F.split(fold_ro(F.col(phrase)), r"\s*,\s*(?:in\s+|pe langa\s+)?|\s+si\s+(?:in\s+|pe langa\s+)?"), lambda p: F.btrim(p) != "")
    rest = first.where(F.col(into).isNull()).drop(into).withColumn("__part", F.explode_outer(F.when(F.size(parts) > 1, F.transform(parts, normal_place))))
    second = looked_up(rest.withColumn("__part", F.coalesce("__part", "__all")), "__part")
    return first.where(F.col(into).isNotNull()).select(*df.columns, into).unionByName(second.select(*df.columns, into))


def asked_and_given(steps: DataFrame, asks: dict[str, str], gives: dict[str, str]) -> DataFrame:
    """What a bill's steps asked for and what has no answer: bill, kind, issuer, asked_on, answered_on (null: open).

    steps: bill, type, issuer, day. asks and gives name the kind of each type of step; an answer of the same kind and issuer counts, whenever it came,
    and of several requests the first stands.
    """
    kind = lambda types: F.create_map(*[F.lit(x) for pair in types.items() for x in pair])[F.col("type")]
    who = plain(F.col("issuer"))
    asked = steps.where(F.col("type").isin(*asks) & (who != "")).groupBy("bill", kind(asks).alias("kind"), who.alias("who")).agg(F.min(F.struct("day", "issuer")).alias("a"))
    given = steps.where(F.col("type").isin(*gives)).groupBy("bill", kind(gives).alias("kind"), who.alias("who")).agg(F.min("day").alias("answered_on"))
    return asked.join(given, ["bill", "kind", "who"], "left").select("bill", "kind", "a.issuer", F.col("a.day").alias("asked_on"), "answered_on")
