"""Filters, paging, matching, set reconciliation and merging of tables."""

from __future__ import annotations

import base64
import json
import re
from functools import reduce
from operator import and_, or_

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tallyloom.session import materialise


def all_of(*conditions: Column | None) -> Column:
    """AND of the conditions that are given; none gives true."""
    return reduce(and_, [c for c in conditions if c is not None], F.lit(True))


def any_of(*conditions: Column | None) -> Column:
    given = [c for c in conditions if c is not None]
    return reduce(or_, given) if given else F.lit(True)


def in_period(day: Column, year: int | None, month: int | None) -> Column | None:
    """A year or a month of it, half-open; a month without a year counts for nothing."""
    if not year:
        return None
    if not month:
        return (day >= F.lit(f"{year}-01-01").cast("date")) & (day < F.lit(f"{year + 1}-01-01").cast("date"))
    after = f"{year + month // 12}-{month % 12 + 1:02d}-01"
    return (day >= F.lit(f"{year}-{month:02d}-01").cast("date")) & (day < F.lit(after).cast("date"))


def clamp_limit(raw: str | None, default: int = 10, most: int = 30) -> int:
    try:
        return max(1, min(most, int(raw)))
    except (TypeError, ValueError):
        return default


def parse_filters(given: dict[str, str | list[str] | None], allowed: dict[str, tuple[str, ...]], free: tuple[str, ...] = ("q", "group", "legislature")) -> dict[str, str]:
    """Filters from a request, as far as they are valid: a year of four digits, a month from 1 to 12, values of a list, free text that isn't blank."""
    one = {k: v[0] if isinstance(v, list) and v else v for k, v in given.items() if v}
    out = {}
    if re.fullmatch(r"[0-9]{4}", one.get("year") or ""):
        out["year"] = one["year"]
    if re.fullmatch(r"0*([1-9]|1[0-2])", one.get("month") or ""):
        out["month"] = str(int(one["month"]))
    out |= {k: one[k] for k, values in allowed.items() if one.get(k) in values}
    return out | {k: one[k].strip() for k in free if (one.get(k) or "").strip()}


def request_columns(raw: dict[str, Column], allowed: dict[str, tuple[str, ...]], free: tuple[str, ...] = ("q", "group", "legislature")) -> dict[str, Column]:
    """What parse_filters keeps of a request, for requests in columns: null where a filter is not valid."""
    blank = lambda c: F.nullif(F.btrim(c), F.lit(""))
    out = {}
    if "year" in raw:
        out["year"] = F.when(raw["year"].rlike("^[0-9]{4}$"), raw["year"])
    if "month" in raw:
        out["month"] = F.when(raw["month"].rlike("^0*([1-9]|1[0-2])$"), raw["month"].try_cast("int").cast("string"))
    out |= {k: F.when(raw[k].isin(*values), raw[k]) for k, values in allowed.items() if k in raw}
    return out | {k: blank(raw[k]) for k in free if k in raw}


def clamped(raw: Column, default: int = 10, most: int = 30) -> Column:
    """clamp_limit of a column."""
    number = F.btrim(raw).try_cast("int")
    return F.when(number.isNull(), default).otherwise(F.least(F.lit(most), F.greatest(F.lit(1), number)))  # least and greatest skip nulls


def encode_cursor(day: str, key: str | int) -> str:
    return base64.urlsafe_b64encode(json.dumps([day, key]).encode()).decode().rstrip("=")


def decode_cursor(raw: str | None) -> tuple | None:
    try:
        day, key = json.loads(base64.urlsafe_b64decode(raw + "=" * (-len(raw) % 4)))
        return day, key
    except (TypeError, ValueError):
        return None


def after_cursor(day: str, key: str, cursor: tuple | None) -> Column | None:
    """Rows that come after a cursor in (day desc, key desc) order."""
    if cursor is None:
        return None
    d = F.lit(cursor[0]).cast("date")
    return (F.col(day) < d) | ((F.col(day) == d) & (F.col(key) < F.lit(cursor[1])))


def keyset_page(df: DataFrame, day: str, key: str, limit: int, cursor: tuple | None = None) -> DataFrame:
    """limit + 1 rows, newest first: the extra one tells that there are more."""
    return df.where(all_of(after_cursor(day, key, cursor))).orderBy(F.desc(day), F.desc(key)).limit(limit + 1)


def by_ids(df: DataFrame, key: str, ids: list) -> DataFrame:
    """Rows of a list of ids that a caller holds; an empty list asks for nothing."""
    return df.where(F.col(key).isin(*ids)) if ids else df.limit(0)


def sorted_by(df: DataFrame, column: str, descending: bool, ties: list[str]) -> DataFrame:
    """One column either way, unknown values last both ways, ties by the other columns upwards."""
    return df.orderBy(F.desc_nulls_last(column) if descending else F.asc_nulls_last(column), *ties)


def distinct_on(df: DataFrame, keys: list[str], *order: Column) -> DataFrame:
    """The first row of each key in an order that must be total."""
    return df.withColumn("__n", F.row_number().over(W.partitionBy(*keys).orderBy(*order))).where("__n = 1").drop("__n")


def first_n(df: DataFrame, keys: list[str], n: int, *order: Column) -> DataFrame:
    return df.withColumn("__n", F.row_number().over(W.partitionBy(*keys).orderBy(*order))).where(F.col("__n") <= n).drop("__n")


def unique_match(probe: DataFrame, candidates: DataFrame, on: list[str], target: str) -> DataFrame:
    """Each probe row with the only candidate of its key; null when there is none or more than one."""
    one = candidates.groupBy(*on).agg(F.min(target).alias(target), F.count_distinct(target).alias("__n")).where("__n = 1").drop("__n")
    return probe.join(one, on, "left")


def cascade(probe: DataFrame, stages: list[tuple[str, DataFrame, list[str]]], target: str) -> DataFrame:
    """Unique matches by falling strength of evidence: the first stage that matches decides and is named in `matched_by`."""
    out = probe
    for name, candidates, on in stages:
        out = unique_match(out, candidates.withColumnRenamed(target, f"__{name}"), on, f"__{name}")
    by = reduce(lambda acc, s: acc.when(F.col(f"__{s[0]}").isNotNull(), s[0]), stages[1:], F.when(F.col(f"__{stages[0][0]}").isNotNull(), stages[0][0]))
    return out.withColumns({target: F.coalesce(*[F.col(f"__{s[0]}") for s in stages]), "matched_by": by}).drop(*[f"__{s[0]}" for s in stages])


def explode_joint(df: DataFrame, chamber: str, joint: str, both: list[str]) -> DataFrame:
    """Turn `chamber = c or chamber = joint` into an equi-join: a joint row counts for every chamber."""
    return df.withColumn(chamber, F.explode(F.when(F.col(chamber) == joint, F.array(*map(F.lit, both))).otherwise(F.array(chamber))))


def upsert(old: DataFrame, new: DataFrame, keys: list[str], protect: Column | None = None) -> DataFrame:
    """New rows replace old ones of the same key; where `protect` holds for the old row, it stays."""
    kept = old.join(new.select(*keys), keys, "left_anti")
    if protect is None:
        return kept.unionByName(new.select(*old.columns))
    held = old.where(protect)
    return old.where(~F.coalesce(protect, F.lit(False))).join(new.select(*keys), keys, "left_anti").unionByName(held).unionByName(new.select(*old.columns).join(held.select(*keys), keys, "left_anti"))


def insert_ignore(old: DataFrame, new: DataFrame, keys: list[str]) -> DataFrame:
    return old.unionByName(new.select(*old.columns).join(old.select(*keys), keys, "left_anti"))


def replace_by_owner(old: DataFrame, new: DataFrame, owner: str) -> DataFrame:
    """All rows of the owners that appear in new are replaced."""
    return old.join(new.select(owner).distinct(), owner, "left_anti").unionByName(new.select(*old.columns))


def reading_interval(old: DataFrame, new: DataFrame, keys: list[str], first: str, last: str, carry: list[str]) -> DataFrame:
    """Widen [first, last] by what was read; carried columns take the newest value that is not null."""
    both = old.withColumn("__age", F.lit(0)).unionByName(new.withColumn("__age", F.lit(1)))
    latest = [F.max_by(c, F.when(F.col(c).isNotNull(), F.col("__age"))).alias(c) for c in carry]
    return both.groupBy(*keys).agg(F.min(first).alias(first), F.max(last).alias(last), *latest)


def sync_partitions(old: DataFrame, new: DataFrame, partition: str) -> DataFrame:
    """Rows of the loaded partitions that were not read again go; other partitions stay as they are."""
    return replace_by_owner(old, new, partition)


def reconcile(official: DataFrame, held: DataFrame, keys: list[str], compare: list[str]) -> DataFrame:
    """One row for each key of either side: missing, not listed, differs (with the columns) or held."""
    o = official.select(*keys, F.struct(*compare).alias("__o"))
    h = held.select(*keys, F.struct(*compare).alias("__h"))
    differs = F.filter(F.array(*[F.when(~F.col("__o")[c].eqNullSafe(F.col("__h")[c]), F.lit(c)) for c in compare]), lambda c: c.isNotNull())
    both = o.join(h, keys, "full_outer").withColumn("differs", F.when(F.col("__o").isNotNull() & F.col("__h").isNotNull(), F.array_join(differs, ",")))
    status = F.when(F.col("__h").isNull(), "missing").when(F.col("__o").isNull(), "not_listed").when(F.col("differs") != "", "differs").otherwise("held")
    return both.select(*keys, status.alias("status"), F.coalesce("differs", F.lit("")).alias("differs"))


def changes(before: DataFrame, after: DataFrame, key: str, columns: list[str]) -> DataFrame:
    """Change data: one row for each key and column whose value differs; `created` for a new key."""
    b = before.select(key, F.array(*[F.col(c).cast("string") for c in columns]).alias("__b"))
    a = after.select(key, F.array(*[F.col(c).cast("string") for c in columns]).alias("__a"))
    joined = a.join(b, key, "left")
    created = joined.where("__b is null").select(key, F.lit("created").alias("field"), F.lit(None).cast("string").alias("old"), F.lit(None).cast("string").alias("new"))
    each = F.explode(F.arrays_zip(F.array(*map(F.lit, columns)).alias("field"), F.col("__b").alias("old"), F.col("__a").alias("new"))).alias("x")
    diff = joined.where("__b is not null").select(key, each).select(key, "x.field", "x.old", "x.new").where("not (old <=> new)")
    return created.unionByName(diff)


def priority_pick(sources: list[DataFrame], key: str, most: int) -> DataFrame:
    """Keys from sources of falling priority, each once, up to a number."""
    ranked = reduce(DataFrame.unionByName, [s.select(key, F.lit(i).alias("priority")) for i, s in enumerate(sources)])
    return ranked.groupBy(key).agg(F.min("priority").alias("priority")).orderBy("priority", key).limit(most)


def holding(texts: DataFrame, names: DataFrame, text: str, name: str, gram: int = 3) -> DataFrame:
    """Pairs of texts and the names that they contain, anywhere in a word too.

    They meet by a run of `gram` characters, the first of the name and any of the text's, or by all of a shorter name, and the rest is compared only there:
    one plan, whatever the names are and how many. Runs carry a digest of the text, not the text, and each text is cut into runs once over in time with
    its length, only at lengths that some name begins with. Null and empty names are in no text.
    """
    start = F.left(F.col(name), F.lit(gram))
    named = materialise(names.where(F.length(name) > 0).withColumn("__run", start), "named")  # from files its size is known: few names go to the texts
    lengths = named.select(F.length("__run").alias("__n")).distinct()
    tasks = int(texts.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    digested = texts.where(F.col(text).isNotNull()).withColumn("__text", F.sha2(F.col(text), 256)).repartition(tasks, "__text")
    cut = lambda n: F.regexp_extract_all(text, F.lit(f"(?s)(?=(.{{{n}}}))"), F.lit(1))
    by_length = F.coalesce(*[F.when(F.col("__n") == n, cut(n)) for n in range(1, gram + 1)])
    runs = digested.join(F.broadcast(lengths)).select("__text", F.explode(F.array_distinct(by_length)).alias("__run"))
    met = runs.join(named, "__run").drop("__run").distinct()
    return digested.join(met, "__text").where(F.contains(text, name)).drop("__text")
