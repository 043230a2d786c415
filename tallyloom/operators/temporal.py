"""Closed intervals [starts, ends] with an open end, and the ways of asking who was where when.

Four predicates exist side by side and are not interchangeable: a period is inclusive at both ends, a legislature excludes
its last day, a few counts include it, and integrity checks let touching periods pass.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T



def end(ends: Column) -> Column:
    return F.coalesce(ends, F.lit("9999-12-31").cast("date"))


def active_on(starts: Column, ends: Column, day: Column) -> Column:
    """Inclusive at both ends; a null end is open."""
    return (starts <= day) & (end(ends) >= day)


def within_half_open(starts: Column, ends: Column, day: Column) -> Column:
    """The last day belongs to the next period."""
    return (starts <= day) & (day < end(ends))


def overlaps(s1: Column, e1: Column, s2: Column, e2: Column) -> Column:
    """At least one day in common."""
    return (s1 <= end(e2)) & (end(e1) >= s2)


def overlaps_strictly(s1: Column, e1: Column, s2: Column, e2: Column) -> Column:
    """More than a shared boundary."""
    return (s1 < end(e2)) & (s2 < end(e1))


def overlap_days(s1: Column, e1: Column, s2: Column, e2: Column) -> Column:
    return F.datediff(F.least(end(e1), end(e2)), F.greatest(s1, s2))


def clip(df: DataFrame, starts: list[str], ends: list[str], into: tuple[str, str] = ("from", "to")) -> DataFrame:
    """The part that several intervals of one row have in common; rows without one go."""
    out = df.withColumn(into[0], F.greatest(*starts)).withColumn(into[1], F.least(*[end(F.col(e)) for e in ends]))
    return out.where(F.col(into[0]) <= F.col(into[1]))


def asof_latest(facts: DataFrame, periods: DataFrame, owner: str, day: str, starts: str, ends: str, tie: str, key: list[str], how: str = "left") -> DataFrame:
    """To each fact (one row for each key) the latest period of its owner that covers its day (ties: greatest `tie`), or nulls.

    Facts and periods lie in one sorted stream of their owner: the last period to start before a fact answers it where it is still open, and
    where no earlier period reaches the day nothing does. Only facts whose last period has closed while an earlier one goes on are left for a
    join, so a busy owner doesn't pair all facts with all periods.
    """
    theirs = [c for c in periods.columns if c != owner]
    period = F.struct(*theirs)
    none = F.lit(None)
    left = periods.select(F.col(owner).alias("__o"), F.col(starts).alias("__d"), F.lit(0).alias("__k"), F.col(tie).alias("__t"), period.alias("__p"), none.cast(T.StructType(facts.schema.fields)).alias("__f"))
    right = facts.select(F.col(owner).alias("__o"), F.col(day).alias("__d"), F.lit(1).alias("__k"), none.cast(periods.schema[tie].dataType).alias("__t"), none.cast(periods.select(period.alias("p")).schema["p"].dataType).alias("__p"), F.struct(*facts.columns).alias("__f"))
    w = W.partitionBy("__o").orderBy("__d", "__k", "__t").rowsBetween(W.unboundedPreceding, 0)
    seen = left.unionByName(right).withColumns({"__last": F.last("__p", ignorenulls=True).over(w), "__reach": F.max(F.when(F.col("__k") == 0, end(F.col("__p")[ends]))).over(w)})
    told = seen.where("__k = 1").select("__f", "__last", (F.col("__reach") >= F.col("__d")).alias("__any"), (F.col("__last").isNotNull() & (end(F.col("__last")[ends]) >= F.col("__d"))).alias("__open"))
    answer = lambda df, p: df.select(*[F.col("__f")[c].alias(c) for c in facts.columns], *[p[c].alias(c) for c in theirs])
    settled = F.coalesce("__open", F.lit(False)) | ~F.coalesce("__any", F.lit(False))
    done = answer(told.where(settled), F.when(F.col("__open"), F.col("__last")))
    rest = told.where(~settled).select("__f", F.col("__f")[owner].alias("__o"), F.col("__f")[day].alias("__d"))
    hit = rest.join(periods.select(F.col(owner).alias("__o"), F.col(starts).alias("__s"), F.col(tie).alias("__t"), F.col(ends).alias("__e"), period.alias("__p")), "__o").where(active_on(F.col("__s"), F.col("__e"), F.col("__d")))
    late = answer(hit.groupBy("__f").agg(F.max_by("__p", F.struct("__s", "__t")).alias("__p")), F.col("__p"))
    out = done.unionByName(late)
    return out if how == "left" else out.where(F.col(starts).isNotNull())


def asof_in_stream(events: DataFrame, owner: str, order: list[str], value: Column, into: str) -> DataFrame:
    """The last known value before or at each row, where facts and values share one table: one sort, no join."""
    w = W.partitionBy(owner).orderBy(*order).rowsBetween(W.unboundedPreceding, 0)
    return events.withColumn(into, F.last(value, ignorenulls=True).over(w))


def coalesce_touching(periods: DataFrame, keys: list[str], starts: str, ends: str, gap_days: int = 1) -> DataFrame:
    """Merge periods that overlap, touch or follow one another within gap_days."""
    w = W.partitionBy(*keys).orderBy(starts, ends)
    seen = F.max(end(F.col(ends))).over(w.rowsBetween(W.unboundedPreceding, -1))
    fresh = periods.withColumn("__new", F.coalesce((F.datediff(starts, seen) > gap_days).cast("int"), F.lit(1)))
    island = fresh.withColumn("__i", F.sum("__new").over(w.rowsBetween(W.unboundedPreceding, 0)))
    out = island.groupBy(*keys, "__i").agg(F.min(starts).alias(starts), F.max(end(F.col(ends))).alias(ends), F.count("*").alias("merged"))
    return out.withColumn(ends, F.when(F.col(ends) < F.lit("9999-12-31").cast("date"), F.col(ends))).drop("__i")


def gaps(periods: DataFrame, keys: list[str], starts: str, ends: str) -> DataFrame:
    """The days between merged periods that none covers."""
    merged = coalesce_touching(periods, keys, starts, ends)
    after = F.lead(starts).over(W.partitionBy(*keys).orderBy(starts))
    out = merged.select(*keys, F.date_add(ends, 1).alias("gap_from"), F.date_sub(after, 1).alias("gap_to"))
    return out.where(F.col("gap_from") <= F.col("gap_to"))


def uncovered_days(claims: DataFrame, spans: DataFrame, owner: str, claim: str, tolerance: int = 0) -> DataFrame:
    """Days of each claim (owner, claim, starts, ends) that spans (owner, starts, ends) leave open, zero within the tolerance."""
    merged = coalesce_touching(spans, [owner], "starts", "ends").select(owner, F.col("starts").alias("s"), F.col("ends").alias("e"))
    # greatest and least skip nulls, so an owner without spans is told apart first.
    shared = F.greatest(F.datediff(F.least("ends", end(F.col("e"))), F.greatest("starts", "s")) + 1, F.lit(0))
    joined = claims.join(merged, owner, "left").withColumn("held", F.when(F.col("s").isNull(), 0).otherwise(shared))
    out = joined.groupBy(owner, claim).agg((F.datediff(F.first("ends"), F.first("starts")) + 1 - F.sum("held")).alias("open"))
    return out.select(owner, claim, F.when(F.col("open") > tolerance, F.col("open")).otherwise(0).cast("long").alias("uncovered"))


def whole_years(born: Column, day: Column) -> Column:
    """Completed years, counting a birthday only once its month and day are reached."""
    before = (F.month(day) < F.month(born)) | ((F.month(day) == F.month(born)) & (F.dayofmonth(day) < F.dayofmonth(born)))
    return F.year(day) - F.year(born) - F.when(before, 1).otherwise(0)
