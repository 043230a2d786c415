"""Interval joins by buckets, and sweep lines, against pairing everything."""

import datetime as dt
import random
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from tallyloom.operators import sweep


@pytest.mark.parametrize("width", [1, 7, 1000])
def test_overlaps_match_all_pairs(spark, width):
    rng = random.Random(width)
    span = lambda: (lambda s: (s, s + rng.choice([0, 1, 5, 40, -1])))(rng.randint(-30, 60))
    a, b = ([(i, rng.choice("xyz"), *span()) for i in range(60)] for _ in range(2))
    left, right = spark.createDataFrame(a, "a long, k string, s long, e long"), spark.createDataFrame(b, "b long, k string, bs long, be long")
    share = lambda x, y: x[2] <= x[3] and y[2] <= y[3] and x[2] <= y[3] and y[2] <= x[3]
    got = sweep.overlapping(left, right, ("s", "e"), ("bs", "be"), width, ["k"]).collect()
    assert sorted((r.a, r.b) for r in got) == sorted((x[0], y[0]) for x in a for y in b if x[1] == y[1] and share(x, y))
    unkeyed = sweep.overlapping(left.drop("k"), right.drop("k"), ("s", "e"), ("bs", "be"), width).collect()
    assert sorted((r.a, r.b) for r in unkeyed) == sorted((x[0], y[0]) for x in a for y in b if share(x, y))
    own = sweep.overlapping_selves(left, "a", "s", "e", width, ["k"]).collect()
    assert sorted(tuple(sorted((r.a, r.other_a))) for r in own) == sorted((x[0], y[0]) for x in a for y in a if x[0] < y[0] and x[1] == y[1] and share(x, y))


def test_one_owner_with_many_periods(spark):
    """100,000 periods of one owner, a few days each: the pairs that overlap, not ten thousand million."""
    n = 100_000
    p = spark.range(n).select(F.lit(1).alias("k"), "id", (F.col("id") * 2).alias("s"), (F.col("id") * 2 + 3).alias("e"))
    assert sweep.overlapping_selves(p, "id", "s", "e", 8, ["k"]).count() == n - 1


def test_seats_over_time_match_counting_each_day(spark):
    rng, day0 = random.Random(2), dt.date(2000, 1, 1)
    on = lambda n: day0 + dt.timedelta(days=n)
    periods = []
    for i in range(120):
        s = rng.randint(0, 900)
        periods.append((f"m{rng.randint(0, 9)}", i, rng.choice("AB"), on(s), None if rng.random() < 0.03 else on(s + rng.choice([0, 3, 200, 500]))))
    df = spark.createDataFrame(periods, "owner string, id long, group string, s date, e date")
    got = sweep.seats_over_time(sweep.winners(df, "owner", "s", "e", "id"), ["group"], "from", "to").collect()
    known = defaultdict(dict)
    for r in got:
        known[r.group][r.day] = r.seats
    seats = {"A": 0, "B": 0}
    for n in range(1600):
        today, count = on(n), defaultdict(int)
        for owner in {p[0] for p in periods}:
            held = [p for p in periods if p[0] == owner and p[3] <= today and (p[4] is None or p[4] >= today)]
            if held:
                count[max(held, key=lambda p: (p[3], p[1]))[2]] += 1
        for g in "AB":
            assert (today in known[g]) == (count[g] != seats[g])
            seats[g] = known[g].get(today, seats[g])
            assert seats[g] == count[g]
    assert sum(map(len, known.values())) == len(got)


def test_flood_windows_come_from_hours(spark):
    """windows of a day from counts of hours, equal to counting every event in every window."""
    import random

    from pyspark.sql import functions as F

    from tallyloom.streaming import engagement

    rng = random.Random(3)
    hours = [(u, h) for u in range(6) for h in rng.sample(range(480000, 480300), 40)]
    told = [(u, h, rng.choice([1, 1, 1, 2, 5])) for u, h in hours]
    df = spark.createDataFrame(told, "user_id long, h long, n long").select(F.timestamp_seconds(F.col("h") * 3600).alias("start"), "user_id", "n")
    want: dict = {}
    for u, h, n in told:
        for i in range(24):
            want[u, h - i] = want.get((u, h - i), 0) + n
    got = engagement.flooding_days(df, 7).select("user_id", (F.unix_seconds("start") / 3600).cast("long").alias("h"), "n").collect()
    assert {(r.user_id, r.h): r.n for r in got} == {k: n for k, n in want.items() if n > 7} and len(got) > 20
