"""Engagement events as a stream: windowed counts with late data, idempotent reactions, a flood guard and catch-up runs."""

from __future__ import annotations

import datetime as dt
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tallyloom.session import scratch_folder

EVENTS = "event_id long, ts timestamp_ntz, user_id long, event_type string, value double, props string"
LATE = "3 days"


def stream(spark: SparkSession, folder: str, glob: str = "events*.parquet", files: int = 10) -> DataFrame:
    raw = spark.readStream.schema(EVENTS).option("pathGlobFilter", glob).option("maxFilesPerTrigger", files).parquet(folder)
    return raw.withColumn("ts", F.col("ts").cast("timestamp"))


def windowed_counts(events: DataFrame, size: str = "1 day", slide: str | None = None, late: str = LATE) -> DataFrame:
    """Events of each kind in tumbling or sliding windows; rows later than the watermark are dropped."""
    w = F.window("ts", size, slide) if slide else F.window("ts", size)
    counted = events.withWatermark("ts", late).groupBy(w.alias("w"), "event_type").agg(F.count("*").alias("n"))
    return counted.select(F.col("w.start").alias("start"), "event_type", "n")


def once(events: DataFrame, keys: list[str], late: str = LATE) -> DataFrame:
    """The first reaction of a visitor to an entity within the watermark; repeats count for nothing."""
    return events.withWatermark("ts", late).dropDuplicatesWithinWatermark(keys)


def flooding(events: DataFrame, short: int, long: int, late: str = LATE) -> tuple[DataFrame, DataFrame]:
    """Visitors over a limit in sliding windows of ten minutes and of a day."""
    marked = events.withWatermark("ts", late)

    def over(size: str, slide: str, most: int) -> DataFrame:
        n = marked.groupBy(F.window("ts", size, slide).alias("w"), "user_id").agg(F.count("*").alias("n"))
        return n.where(F.col("n") > most).select(F.col("w.start").alias("start"), "user_id", "n")

    return over("10 minutes", "5 minutes", short), over("1 day", "1 hour", long)


def hourly(events: DataFrame, late: str = LATE) -> DataFrame:
    """Events of each visitor and hour: the state of a visitor's days, an entry for each hour instead of one for each window that it lies in. An hour stays
    open until the last day that it is part of is over."""
    return events.withWatermark("ts", f"{late} 23 hours").groupBy(F.window("ts", "1 hour").alias("w"), "user_id").agg(F.count("*").alias("n")).select(F.col("w.start").alias("start"), "user_id", "n")


def flooding_days(hours: DataFrame, most: int, size: int = 24) -> DataFrame:
    """start, user_id and n of the windows of `size` hours, sliding by one, with more than `most` events, from what `hourly` has counted. Only hours with
    more than that around them are in such a window; no other is dealt out to its windows."""
    hour = hours.select((F.unix_seconds("start") / 3600).cast("long").alias("h"), "user_id", "n")
    near = F.sum("n").over(W.partitionBy("user_id").orderBy("h").rangeBetween(1 - size, size - 1))
    dealt = hour.withColumn("near", near).where(F.col("near") > most).select(F.explode(F.sequence(F.col("h") - (size - 1), F.col("h"))).alias("h"), "user_id", "n")
    n = dealt.groupBy("h", "user_id").agg(F.sum("n").alias("n")).where(F.col("n") > most)
    return n.select(F.timestamp_seconds(F.col("h") * 3600).alias("start"), "user_id", "n")


def catch_up_window(last_success: dt.date | None, today: dt.date, held: list[dt.date] = (), back: int = 3, most: int = 60) -> tuple[dt.date, dt.date]:
    """From a few days before the last success, or the earliest held day, but no more than `most` days, to today."""
    start = min([(last_success or today - dt.timedelta(days=most)) - dt.timedelta(days=back), *held])
    return max(start, today - dt.timedelta(days=most)), today


def catch_up(df: DataFrame, step: Callable[[DataFrame, int], None], checkpoint: str) -> None:
    """Work off all that is there in batches, exactly once for each batch, then stop."""
    q = df.writeStream.trigger(availableNow=True).option("checkpointLocation", checkpoint).foreachBatch(step).start()
    q.awaitTermination()


def collected(df: DataFrame, keys: list[str], name: str) -> DataFrame:
    """Run a stream of changing rows over what is there: each batch writes its changed rows under its number in the shared folder, and of a key
    the latest batch counts. A repeated batch replaces itself; nothing passes through the driver."""
    at = scratch_folder(df.sparkSession, name)
    step = lambda batch, number: batch.write.mode("overwrite").parquet(f"{at}/rows/batch={number}")
    q = df.writeStream.outputMode("update").trigger(availableNow=True).option("checkpointLocation", f"{at}/log").foreachBatch(step).start()
    q.awaitTermination()
    told = [c for c in df.columns if c not in keys]
    rows = df.sparkSession.read.schema(T.StructType([*df.schema.fields, T.StructField("batch", T.IntegerType())])).parquet(f"{at}/rows")
    return rows.groupBy(*keys).agg(*[F.max_by(c, "batch").alias(c) for c in told])


def appended(df: DataFrame, name: str) -> DataFrame:
    """Run a stream of rows that never change over what is there, appended to a folder of files."""
    at = scratch_folder(df.sparkSession, name)
    q = df.writeStream.trigger(availableNow=True).option("checkpointLocation", f"{at}/log").format("parquet").start(f"{at}/rows")
    q.awaitTermination()
    return df.sparkSession.read.schema(df.schema).parquet(f"{at}/rows")
