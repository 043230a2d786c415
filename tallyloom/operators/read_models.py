"""Read models kept up to date from changes: what is stored is counts, so that a deleted row can be taken back.

A model is described by facts: for a row of its sources, rows of (key, measure, value). Stored is how often each fact holds. Sums of signed
facts then keep every measure right under inserts, changes and deletes: a count is that of its facts, and the least, the greatest and the distinct
values are those whose count is not zero. State is divided by a hash of the key; changes read and write the parts that their keys fall in.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyloom.session import materialise
from tallyloom.sources import versions

PARTS = 16
#: Facts of a task that sums them up: their bytes are few, so that adaptive execution would give it millions.
DEALT = 300_000


@dataclass(frozen=True)
class Model:
    """keys, and what gives the columns of a model's row, from its key's facts."""

    keys: tuple[str, ...]
    columns: Callable[[], dict[str, Column]]


def fact(df: DataFrame, keys: dict[str, Column | str], measure: str, value: Column | str | None = None, sign: int | Column = 1) -> DataFrame:
    """A fact for each row: keys, measure, value (as a string; null for a mere count) and n, which is negative where the row is taken away."""
    told = F.lit(None) if value is None else F.col(value) if isinstance(value, str) else value
    named = [(F.col(c) if isinstance(c, str) else c).alias(k) for k, c in keys.items()]
    return df.select(*named, F.lit(measure).alias("measure"), told.cast("string").alias("value"), (F.lit(sign) if isinstance(sign, int) else sign).cast("long").alias("n"))


def count(measure: str) -> Column:
    return F.coalesce(F.sum(F.when(F.col("measure") == measure, F.col("n"))), F.lit(0))


def distinct(measure: str) -> Column:
    return F.count_if((F.col("measure") == measure) & F.col("value").isNotNull())


def least(measure: str, kind: str) -> Column:
    return F.min(F.when(F.col("measure") == measure, F.col("value").cast(kind)))


def greatest(measure: str, kind: str) -> Column:
    return F.max(F.when(F.col("measure") == measure, F.col("value").cast(kind)))


def _part(keys: tuple[str, ...]) -> Column:
    return F.pmod(F.xxhash64(*keys), F.lit(PARTS)).cast("int")


def _name(part: Column) -> Column:
    return F.lpad(part.cast("string"), 3, "0")


def _summed(facts: DataFrame, keys: tuple[str, ...], n: int) -> DataFrame:
    """Facts with their sums and their part, from about n facts that are dealt out to tasks by their number. A task has facts of one part
    only, so that it writes one file; the facts of a busy key go to all tasks of its part."""
    each = -(-max(n // DEALT + 1, facts.sparkSession.sparkContext.defaultParallelism) // PARTS)
    task = _part(keys) * each + F.pmod(F.xxhash64("value", "measure", *keys), F.lit(each)).cast("int")
    dealt = facts.withColumn("__task", task).repartitionById(PARTS * each, F.col("__task"))
    summed = dealt.groupBy("__task", *keys, "measure", "value").agg(F.sum("n").alias("n")).where("n <> 0")
    return summed.withColumn("part", _name(F.floor(F.col("__task") / each))).drop("__task")


def changed(keys: tuple[str, ...], table: str, facts: list[DataFrame], n: int | None = None) -> Callable[[versions.Snapshot], dict[str, versions.Parts]]:
    """What versions.publish builds from signed facts: new state of the parts that the facts' keys fall in. n: about how many facts a first load has; they
    are counted where it is not given. Later facts are written down, which counts them and tells their parts, and summed together with the state."""

    def build(before: versions.Snapshot) -> dict[str, versions.Parts]:
        delta = reduce(DataFrame.unionByName, facts)
        if table not in before.tables:
            return {table: versions.Parts(_summed(delta, keys, delta.count() if n is None else n), [])}
        delta = materialise(delta, "delta")
        touched = sorted(r.part for r in delta.select(_name(_part(keys)).alias("part")).distinct().collect())  # at most PARTS
        both = delta.unionByName(before.read(delta.sparkSession, table, touched))
        return {table: versions.Parts(_summed(both, keys, both.count()), touched)}

    return build


def rows(state: DataFrame, model: Model) -> DataFrame:
    """The model's rows from its state."""
    return state.groupBy(*model.keys).agg(*[c.alias(k) for k, c in model.columns().items()])


def negative(table: str) -> versions.Gate:
    """Facts taken away that were never there: changes that do not fit the version before them."""
    return lambda spark, before, after: after.read(spark, table, after.own(table)).where("n < 0").select(F.concat_ws(": ", F.lit("taken away too often"), F.to_json(F.struct("*"))).alias("reason"))


def refresh(spark: SparkSession, root: str, run: str, model: Model, table: str, facts: list[DataFrame], gates: dict[str, versions.Gate] | None = None, n: int | None = None) -> str:
    """Publish a model's state after about n signed facts; see versions.publish for what comes back."""
    return versions.publish(spark, root, run, changed(model.keys, table, facts, n), {"negative": negative(table), **(gates or {})})
