"""Tallies, shares and summaries."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def group_totals(votes: DataFrame, by: list[str], choice: str, kinds: dict[str, str]) -> DataFrame:
    """Tallies of each choice for each group; rows without a group are skipped."""
    counts = [F.count_if(F.col(choice) == value).alias(name) for name, value in kinds.items()]
    return votes.where(F.col(by[-1]).isNotNull()).groupBy(*by).agg(*counts, F.count("*").alias("present"))


def agreement(votes: DataFrame, vote: str, group: str, member: str, choice: str, yes: str, no: str, other: str, least: int = 4) -> DataFrame:
    """How often a member votes as the strict plurality of the others of the group, where at least so many others voted."""
    # the others' totals stand beside each ballot in one exchange
    together = W.partitionBy(vote, group)
    others = lambda v: F.count_if(F.col(choice) == v).over(together) - F.coalesce((F.col(choice) == v).cast("int"), F.lit(0))
    rest = votes.where(F.col(vote).isNotNull() & F.col(group).isNotNull()).withColumns({"f": others(yes), "a": others(no), "s": others(other)})
    f, a, s = F.col("f"), F.col("a"), F.col("s")
    line = F.when((f > a) & (f > s), yes).when((a > f) & (a > s), no).when((s > f) & (s > a), other)
    told = rest.where(f + a + s >= least).withColumn("line", line).where("line is not null")
    return told.groupBy(member).agg(F.count("*").alias("compared"), F.count_if(F.col(choice) == F.col("line")).alias("agreed"))


def without_conflicts(votes: DataFrame, keys: list[str], choice: str, group: str, unknown: str = "unknown") -> DataFrame:
    """One row for each key; differing choices become unknown, differing groups null."""
    # One value: no null among others, and the least is the greatest; the empty string is a value like others. One exchange, and it combines before it.
    one = lambda c: F.when((F.count(c) == F.count("*")) & (F.min(c) == F.max(c)), F.max(c))
    return votes.groupBy(*keys).agg(F.coalesce(one(F.col(choice)), F.lit(unknown)).alias(choice), one(F.col(group)).alias(group), F.count("*").alias("rows"))


def sum_pairs(df: DataFrame, keys: list[str], codes: str, votes: str) -> DataFrame:
    """Sum parallel arrays of codes and votes; one row for each key and code, with the rank by votes."""
    long = df.select(*keys, F.inline(F.arrays_zip(F.col(codes).alias("code"), F.col(votes).alias("votes"))))
    total = long.groupBy(*keys, "code").agg(F.sum("votes").alias("votes"))
    return total.withColumn("place", F.row_number().over(W.partitionBy(*keys).orderBy(F.desc("votes"), "code")))


def share(part: Column, total: Column) -> Column:
    return F.when(total == 0, 0.0).otherwise(part / total)


def mode(df: DataFrame, keys: list[str], value: str) -> DataFrame:
    """The most frequent value of each key; ties go to the smallest."""
    n = df.groupBy(*keys, value).agg(F.count("*").alias("n"))
    return n.groupBy(*keys).agg(F.min_by(F.struct(value, "n"), F.struct(-F.col("n"), value)).alias("m")).select(*keys, f"m.{value}", "m.n")


def latest_version(df: DataFrame, keys: list[str], version: Column, tie: Column) -> DataFrame:
    return df.withColumn("__n", F.row_number().over(W.partitionBy(*keys).orderBy(version.desc(), tie.desc()))).where("__n = 1").drop("__n")


def islands(df: DataFrame, keys: list[str], order: list[str], value: str) -> DataFrame:
    """Runs of one value in a row: value, first and last of the order, length."""
    w = W.partitionBy(*keys).orderBy(*order)
    new = df.withColumn("__new", (~F.lag(value).over(w).eqNullSafe(F.col(value))).cast("int"))
    run = new.withColumn("run", F.sum("__new").over(w.rowsBetween(W.unboundedPreceding, 0)))
    return run.groupBy(*keys, "run", value).agg(F.min(order[0]).alias("first"), F.max(order[0]).alias("last"), F.count("*").alias("n"))


def neighbour_fill(df: DataFrame, keys: list[str], order: list[str], value: str, into: str) -> DataFrame:
    """Fill a null only where the last known and the next known value agree."""
    w = W.partitionBy(*keys).orderBy(*order)
    before = F.last(value, ignorenulls=True).over(w.rowsBetween(W.unboundedPreceding, -1))
    after = F.first(value, ignorenulls=True).over(w.rowsBetween(1, W.unboundedFollowing))
    return df.withColumn(into, F.coalesce(F.col(value), F.when(before == after, before)))


def sequence_gap(df: DataFrame, keys: list[str], number: str) -> DataFrame:
    """How many numbers of a running series are not held."""
    return df.groupBy(*keys).agg(F.max(number).alias("highest"), F.count_distinct(number).alias("held")).withColumn("missing", F.col("highest") - F.col("held"))


def counted_between(spans: DataFrame, rows: DataFrame, day: str, starts: str, ends: str, into: str) -> DataFrame:
    """spans with the number of rows dated within each, both ends included.

    A running count over the calendar answers both ends by equality, so no span meets every row: the calendar has one line for each day
    from the first to the last row.
    """
    edge = rows.agg(F.min(day).alias("lo"), F.max(day).alias("hi"))
    calendar = edge.select(F.explode(F.sequence("lo", "hi")).alias(day))
    by_day = calendar.join(rows.groupBy(day).agg(F.count("*").alias("__n")), day, "left")
    upto = by_day.select(F.col(day).alias("__day"), F.sum(F.coalesce("__n", F.lit(0))).over(W.orderBy(day)).alias("__upto"))
    clamped = spans.join(edge).withColumns({"__first": F.date_sub(starts, 1), "__last": F.least(F.coalesce(ends, F.col("hi")), F.col("hi"))}).drop("lo", "hi")
    at = lambda c: upto.select(F.col("__day").alias(c), F.col("__upto").alias(f"{c}_n"))
    out = clamped.join(at("__first"), "__first", "left").join(at("__last"), "__last", "left")
    n = F.greatest(F.coalesce("__last_n", F.lit(0)) - F.coalesce(F.when(F.col("__first") <= F.col("__last"), F.col("__first_n")), F.lit(0)), F.lit(0))
    return out.select(*spans.columns, F.when(F.col(starts) <= F.col("__last"), n).otherwise(0).cast("long").alias(into))
