"""Which image stands for a party, told from the profiles that show it."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

SURE_SHARE, SURE_PROFILES = 0.9, 3


def weighed(evidence: DataFrame) -> DataFrame:
    """legislature_id, content_hash, party_id, profiles, total, share, parties, confidence: each image of a legislature with its leading party.

    evidence (legislature_id, content_hash, party_id) has a row for each profile; those without a party say nothing. Ties go
    to the smaller party id. An image is `confident` from three profiles of which nine in ten are of one party, `weak` if its
    few profiles are all of one party, in the newest legislature, and no other party ever used it, else `mixed`.
    """
    told = evidence.where("party_id is not null").groupBy("legislature_id", "content_hash", "party_id").agg(F.count("*").alias("profiles"))
    users = told.groupBy("content_hash").agg((F.min("party_id") == F.max("party_id")).alias("exclusive"))
    lead = told.groupBy("legislature_id", "content_hash").agg(
        F.min(F.struct((-F.col("profiles")).alias("n"), "party_id")).alias("lead"), F.sum("profiles").alias("total"), F.count("*").alias("parties")
    )
    newest = evidence.agg(F.max("legislature_id").alias("legislature_id")).withColumn("newest", F.lit(True))  # one row
    out = lead.join(users, "content_hash").join(F.broadcast(newest), "legislature_id", "left")
    out = out.select("legislature_id", "content_hash", F.col("lead.party_id").alias("party_id"), (-F.col("lead.n")).alias("profiles"), "total", "parties", "exclusive", "newest")
    out = out.withColumn("share", F.col("profiles") / F.col("total"))
    sure = (F.col("total") >= SURE_PROFILES) & (F.col("share") >= SURE_SHARE)
    weak = (F.col("total") < SURE_PROFILES) & (F.col("parties") == 1) & F.col("exclusive") & F.coalesce("newest", F.lit(False))
    return out.withColumn("confidence", F.when(sure, "confident").when(weak, "weak").otherwise("mixed")).drop("exclusive", "newest")


def picked(evidence: DataFrame) -> DataFrame:
    """One image for each party: of the newest legislature that has one, the image with the most profiles (ties: smallest hash)."""
    order = W.partitionBy("party_id").orderBy(F.desc("legislature_id"), F.desc("profiles"), "content_hash")
    best = weighed(evidence).where("confidence <> 'mixed'").withColumn("__n", F.row_number().over(order)).where("__n = 1")
    return best.select("party_id", "legislature_id", "content_hash", "profiles", "share", "confidence")
