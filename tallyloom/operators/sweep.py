"""Intervals without pairing all with all: joins by buckets of time, and counts along a sweep line."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tallyloom.operators import temporal as T
from tallyloom.session import materialise

#: Days of one block of a running total.
BLOCK = 128
#: Periods of one block that are looked through for one that is still open.
RUN = 32


def starts_within(points: DataFrame, spans: DataFrame, at: str, starts: str, ends: str, width: int, on: list[str] | None = None) -> DataFrame:
    """Rows of points and spans (whole numbers, ends inclusive) where starts <= at <= ends, and on is equal.

    A span lies in every bucket of `width` that it touches, a point in its own: they meet by (on, bucket), so that neither a key nor the whole table is
    paired with itself. A width near the usual length of a span makes few buckets and few misses.
    """
    bucket = lambda c: F.floor(F.col(c) / width)
    cut = spans.where(F.col(starts) <= F.col(ends)).withColumn("__bucket", F.explode(F.sequence(bucket(starts), bucket(ends))))
    met = points.withColumn("__bucket", bucket(at)).join(cut, ["__bucket", *(on or [])])
    return met.where((F.col(starts) <= F.col(at)) & (F.col(at) <= F.col(ends))).drop("__bucket")


def overlapping(a: DataFrame, b: DataFrame, a_span: tuple[str, str], b_span: tuple[str, str], width: int, on: list[str] | None = None) -> DataFrame:
    """Pairs of rows of a and b whose spans have a number in common; the two have no column of one name but those of on. The later start of
    two overlapping spans lies in the other: each pair is found once, in the bucket of its later start, whichever side that is on. A span
    that ends before it starts has no number."""
    a, b = a.where(F.col(a_span[0]) <= F.col(a_span[1])), b.where(F.col(b_span[0]) <= F.col(b_span[1]))
    in_a = starts_within(b, a, b_span[0], *a_span, width, on)
    in_b = starts_within(a, b, a_span[0], *b_span, width, on).where(F.col(a_span[0]) > F.col(b_span[0]))
    return in_a.unionByName(in_b)


def overlapping_selves(spans: DataFrame, id_: str, starts: str, ends: str, width: int, on: list[str] | None = None) -> DataFrame:
    """Pairs of rows of one table with a number in common, as (on, id, starts, ends and the same with `other_` before)."""
    keep = [*(on or []), id_, starts, ends]
    spans = spans.where(F.col(starts) <= F.col(ends))
    other = {c: f"other_{c}" for c in (id_, starts, ends)}
    met = starts_within(spans.select(keep).withColumnsRenamed(other), spans.select(keep), other[starts], starts, ends, width, on)
    return met.where((F.col(starts) < F.col(other[starts])) | (F.col(id_) < F.col(other[id_])))


def overlap_totals(a: DataFrame, b: DataFrame, a_span: tuple[str, str], b_span: tuple[str, str], width: int, kind: str) -> DataFrame:
    """The rows of a, for each kind of b that has spans in common with it, with n, how many, and shared, the sum of what they share (least end less
    greatest start), in whole numbers, ends inclusive; a span that ends before it starts has no number.

    No pair is made. Up to a moment so many spans have begun and so many are over, and what they cover of all time until then follows from these
    counts and the sums of their ends: a span's figures are differences between its end and its start. Totals are summed within blocks of `width`, on top of sums of blocks.
    """
    a, b = a.where(F.col(a_span[0]) <= F.col(a_span[1])), b.where(F.col(b_span[0]) <= F.col(b_span[1]))
    sums = ["begun", "begun_at", "over", "over_at"]
    zero = F.lit(0).cast("long")
    row = lambda at, *v: F.struct(at.cast("long").alias("at"), *[x.cast("long").alias(c) for c, x in zip(sums, v, strict=True)])
    s, e = F.col(b_span[0]), F.col(b_span[1])
    moves = b.select(F.col(kind).alias("__kind"), F.inline(F.array(row(s, F.lit(1), s, zero, zero), row(e + 1, zero, zero, F.lit(1), e)))).groupBy("__kind", "at").agg(*[F.sum(c).alias(c) for c in sums])
    asked = a.select(F.explode(F.array(*[F.col(c).cast("long") for c in a_span])).alias("at")).distinct().crossJoin(F.broadcast(b.select(F.col(kind).alias("__kind")).distinct()))
    each = moves.unionByName(asked.select("__kind", "at", *[zero.alias(c) for c in sums])).groupBy("__kind", "at").agg(*[F.sum(c).alias(c) for c in sums]).withColumn("__block", F.floor(F.col("at") / width))
    earlier = W.partitionBy("__kind").orderBy("__block").rowsBetween(W.unboundedPreceding, -1)
    blocks = each.groupBy("__kind", "__block").agg(*[F.sum(c).alias(f"block_{c}") for c in sums])
    blocks = blocks.select(F.col("__kind").alias("__of"), F.col("__block").alias("__in"), *[F.coalesce(F.sum(f"block_{c}").over(earlier), zero).alias(f"before_{c}") for c in sums])
    inner = W.partitionBy("__kind", "__block").orderBy("at")
    known = each.select("__kind", "__block", "at", *[F.sum(c).over(inner).alias(c) for c in sums]).join(blocks, (F.col("__block") == F.col("__in")) & F.col("__kind").eqNullSafe(F.col("__of")))
    known = known.select("__kind", "at", *[(F.col(c) + F.col(f"before_{c}")).alias(c) for c in sums])
    covered = F.col("at") * (F.col("begun") - F.col("over")) - F.col("begun_at") + F.col("over_at")
    told = lambda at, *c: known.select(F.col("at").alias(f"__{at}"), F.col("__kind").alias(f"__kind_{at}"), covered.alias(f"__covered_{at}"), *[F.col(x).alias(f"__{x}") for x in c])
    out = a.join(told("s", "over"), F.col(a_span[0]) == F.col("__s")).join(told("e", "begun"), (F.col(a_span[1]) == F.col("__e")) & F.col("__kind_s").eqNullSafe(F.col("__kind_e")))
    out = out.select(*a.columns, F.col("__kind_e").alias(kind), (F.col("__begun") - F.col("__over")).alias("n"), (F.col("__covered_e") - F.col("__covered_s")).alias("shared"))
    return out.where("n > 0")


def winners(periods: DataFrame, owner: str, starts: str, ends: str, tie: str) -> DataFrame:
    """The stretches (from, to) of each owner's time in which one period holds: of those that are open on a day the last to have begun (ties:
    greatest tie). Which one holds can only change where a period begins, or on the day after one ends.

    Beginnings and ends lie in one sorted stream of their owner, where the last to have begun holds if it is open. Where it is over and an earlier one goes on,
    periods are looked through by blocks of RUN in the order of their beginning, which know their latest end: its own block, and the last block before that reaches the day.
    """
    theirs = [c for c in periods.columns if c != owner]
    period = F.struct(*theirs)
    turn = lambda at, p: F.struct(at.alias("at"), p.alias("p"))
    moves = periods.select(F.col(owner).alias("__o"), F.inline(F.array(turn(F.col(starts), period), turn(F.date_add(T.end(F.col(ends)), 1), F.lit(None).cast(periods.select(period.alias("p")).schema["p"].dataType)))))
    w = W.partitionBy("__o").orderBy("at", F.col(f"p.{tie}").asc_nulls_first())
    upto = w.rowsBetween(W.unboundedPreceding, 0)
    far = T.end(F.col("p")[ends])
    seen = moves.where("at is not null").select("__o", "at", "p", F.last("p", ignorenulls=True).over(upto).alias("last"), F.count("p").over(upto).alias("nth"), F.max(F.when(F.col("p").isNotNull(), far)).over(upto).alias("reach"), F.lead("at").over(w).alias("next"))
    block = F.floor((F.col("nth") - 1) / RUN).alias("block")
    is_open, is_turn = T.end(F.col("last")[ends]) >= F.col("at"), F.col("next") > F.col("at")
    last = F.when(is_turn & F.col("last").isNotNull() & is_open, F.col("last")).alias("last")
    late = (is_turn & F.col("last").isNotNull() & ~is_open & (F.col("reach") >= F.col("at"))).alias("late")
    seen = materialise(seen.select("__o", "at", "p", "nth", block, F.date_sub("next", 1).alias("to"), last, late), "turns")
    answer = lambda df, p: df.select(F.col("__o").alias(owner), F.col("at").alias("from"), "to", *[F.col(p)[c].alias(c) for c in theirs])
    asked = seen.where("late").select("__o", "at", "to", "nth", "block")
    begun = seen.where("p is not null").select(F.col("__o").alias("__p"), F.col("block").alias("in"), F.col("nth").alias("n"), far.alias("far"), "p")
    same = F.col("__o").eqNullSafe(F.col("__p"))
    before = asked.join(begun.groupBy("__p", "in").agg(F.max("far").alias("far")), same & (F.col("in") < F.col("block")) & (F.col("far") >= F.col("at")))
    before = before.groupBy("__o", "at", "to", "nth").agg(F.max("in").alias("block"))
    found = asked.unionByName(before).join(begun, same & (F.col("in") == F.col("block")) & (F.col("n") < F.col("nth")) & (F.col("far") >= F.col("at")))
    return answer(seen.where("last is not null"), "last").unionByName(answer(found.groupBy("__o", "at", "to").agg(F.max_by("p", "n").alias("p")), "p"))


def running_total(changes: DataFrame, keys: list[str], day: str, change: Column) -> DataFrame:
    """keys, day, change and total, the sum of changes up to each day of a change: sums within blocks of days, on top of the sum of the blocks
    before. A key with changes on many days is many blocks, in as many tasks; only blocks are counted through in order."""
    by_day = materialise(changes.groupBy(*keys, day).agg(F.sum(change).alias("change")), "days").withColumn("__block", F.floor(F.unix_date(day) / BLOCK))
    before = F.sum("block_change").over(W.partitionBy(*keys).orderBy("__block").rowsBetween(W.unboundedPreceding, -1))
    blocks = by_day.groupBy(*keys, "__block").agg(F.sum("change").alias("block_change")).withColumn("before", F.coalesce(before, F.lit(0))).drop("block_change")
    inner = F.sum("change").over(W.partitionBy(*keys, "__block").orderBy(day))
    return by_day.withColumn("inner", inner).join(blocks, [*keys, "__block"]).select(*keys, day, "change", (F.col("before") + F.col("inner")).alias("total"))


def seats_over_time(held: DataFrame, keys: list[str], starts: str, ends: str) -> DataFrame:
    """keys, day and seats: how many of held (starts, ends inclusive) are open from each day on which that changes."""
    leaves = F.when(F.col(ends) < F.lit("9999-12-31").cast("date"), F.date_add(F.col(ends), 1))  # an open end never leaves
    edge = F.explode(F.array(F.struct(F.col(starts).alias("day"), F.lit(1).alias("n")), F.struct(leaves.alias("day"), F.lit(-1).alias("n"))))
    moved = held.select(*keys, edge.alias("e")).select(*keys, "e.day", "e.n").where("day is not null")
    return running_total(moved, keys, "day", F.col("n")).where("change <> 0").select(*keys, "day", F.col("total").alias("seats"))
