"""Who supports a government: members of the groups of its parties, over the days on which all of it holds at once."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyloom.operators.temporal import clip, end

SUPPORTING = ("government", "governing_support")


def supporters(governments: DataFrame, alignments: DataFrame, groups: DataFrame, memberships: DataFrame, mandates: DataFrame) -> DataFrame:
    """government, party, chamber, person, from_on, to_on, at_start: one row for each person, widest span first to last.

    governments: government, starts_on, ends_on (null: open); alignments: government, party, alignment, starts_on, ends_on; groups: group, party, chamber;
    memberships: member, person, group, starts_on, ends_on; mandates: member, starts_on, ends_on. A day counts if the party is aligned with the
    government, the member in one of its groups and in office; a person with several memberships or mandates has one row for each chamber.
    """
    span = lambda df, p: df.withColumnsRenamed({"starts_on": f"{p}_from", "ends_on": f"{p}_to"})
    aligned = span(alignments.where(F.col("alignment").isin(*SUPPORTING)), "a").drop("alignment").join(span(governments, "g"), "government")
    # members in office first: only days that are left of them meet the governments of their group
    seated = clip(span(memberships, "m").join(span(mandates, "o"), "member"), ["m_from", "o_from"], ["m_to", "o_to"], ("s_from", "s_to"))
    hit = clip(seated.join(aligned.join(groups, "party"), "group"), ["a_from", "g_from", "s_from"], ["a_to", "g_to", "s_to"], ("from_on", "to_on"))
    at_start = (F.col("from_on") <= F.col("g_from")) & (F.col("to_on") >= F.col("g_from"))
    return hit.groupBy("government", "party", "chamber", "person").agg(F.min("from_on").alias("from_on"), F.max("to_on").alias("to_on"), F.bool_or(at_start).alias("at_start"))


def support(found: DataFrame) -> DataFrame:
    """government, party: how many of each chamber supported it at its start, how many at any time, and how many joined or left on the way."""
    at = lambda chamber: F.count_if(F.col("at_start") & (F.col("chamber") == chamber))
    return found.groupBy("government", "party").agg(at("deputies").alias("deputies"), at("senate").alias("senators"), F.count("*").alias("total"), F.count_if(~F.col("at_start")).alias("joined_later"))


def by_country(votes: DataFrame, election: str, place: str, count: str, countries: DataFrame, least: float = 0.9) -> DataFrame:
    """Votes abroad by country: election, country (null: places that no country of the list has), votes, covered (the share of the election's votes
    that have a country) and drawn: whether that share is large enough for a map of countries. countries: place, country; places are never guessed."""
    by = votes.join(countries.withColumnRenamed("place", place), place, "left").groupBy(election, "country").agg(F.sum(count).alias("votes"))
    share = by.groupBy(election).agg(F.sum("votes").alias("__all"), F.coalesce(F.sum(F.when(F.col("country").isNotNull(), F.col("votes"))), F.lit(0)).alias("__known"))
    covered = F.when(F.col("__all") > 0, F.col("__known") / F.col("__all")).otherwise(0.0)
    return by.join(share, election).select(election, "country", "votes", covered.alias("covered"), (covered >= least).alias("drawn"))


def open_end(df: DataFrame, column: str = "to_on") -> DataFrame:
    """An end beyond all days is none."""
    return df.withColumn(column, F.when(F.col(column) < end(F.lit(None).cast("date")), F.col(column)))
