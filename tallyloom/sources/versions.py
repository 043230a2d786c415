"""Tables in versions behind a pointer: written aside, checked by gates, then switched to, or held and left as they were.

A version is what one run has written. A manifest names, for each part of each table, the run whose files hold it, so that a run writes the parts
it touches and shares the others. Manifests are numbered and never change: the greatest number is what readers see, and writing the next one - a rename that
fails where the number is taken - is the switch. A run that is killed before leaves files that nobody reads; run again, it starts over. A run that
is already in a manifest does nothing. Going back is a new manifest with an older one's parts.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Reasons that a held run writes down; more are counted.
REASONS = 100
#: The part of a table that is not divided.
WHOLE = "all"


@dataclass(frozen=True)
class Snapshot:
    """What one manifest names: tables -> part -> run, and each table's schema."""

    root: str
    number: int = 0
    run: str | None = None
    runs: tuple[str, ...] = ()
    tables: dict[str, dict[str, str]] = field(default_factory=dict)
    schemas: dict[str, str] = field(default_factory=dict)

    def read(self, spark: SparkSession, table: str, parts: list[str] | None = None) -> DataFrame | None:
        """A table, or only some parts of it: the files of the others are not opened. None where the version has no such table."""
        if table not in self.tables:
            return None
        schema = T.StructType.fromJson(json.loads(self.schemas[table]))
        paths = [f"{self.root}/runs/{run}/{table}/part={p}" for p, run in sorted(self.tables[table].items()) if parts is None or p in parts]
        return spark.read.schema(schema).parquet(*paths) if paths else spark.createDataFrame([], schema)


    def own(self, table: str) -> list[str]:
        """The parts of a table that this version's run has written."""
        return [p for p, run in self.tables.get(table, {}).items() if run == self.run]


@dataclass(frozen=True)
class Parts:
    """New contents (with a string column `part`) of the parts named; one without rows is empty from now on."""

    rows: DataFrame
    touched: list[str]


#: A gate sees the version before and the one that is about to be switched to, and returns rows with a column `reason`; none lets the run pass.
Gate = Callable[[SparkSession, Snapshot, Snapshot], DataFrame]


def _fs(spark: SparkSession, path: str):
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsc.hadoopConfiguration()), p


def _listed(spark: SparkSession, folder: str) -> list[str]:
    fs, p = _fs(spark, folder)
    return sorted(s.getPath().getName() for s in fs.listStatus(p)) if fs.exists(p) else []


def _text(spark: SparkSession, path: str) -> dict:
    fs, p = _fs(spark, path)
    stream = fs.open(p)
    try:
        return json.loads(spark._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8"))
    finally:
        stream.close()


def _put(spark: SparkSession, path: str, told: dict) -> bool:
    """Write a small file that is there whole or not at all; False where the name is taken."""
    fs, p = _fs(spark, path)
    aside = spark._jvm.org.apache.hadoop.fs.Path(f"{path}.{uuid.uuid4().hex}.aside")
    stream = fs.create(aside)
    stream.write(bytearray(json.dumps(told).encode()))
    stream.close()
    done = not fs.exists(p) and fs.rename(aside, p)
    if not done:
        fs.delete(aside, False)
    return done


def current(spark: SparkSession, root: str) -> Snapshot:
    """The version that readers see; an empty one before the first."""
    names = [n for n in _listed(spark, f"{root}/manifests") if n.endswith(".json")]
    return _snapshot(root, _text(spark, f"{root}/manifests/{names[-1]}")) if names else Snapshot(root)


def version(spark: SparkSession, root: str, number: int) -> Snapshot:
    return _snapshot(root, _text(spark, f"{root}/manifests/{number:012d}.json"))


def _snapshot(root: str, m: dict) -> Snapshot:
    return Snapshot(root, m["number"], m["run"], tuple(m["runs"]), m["tables"], m["schemas"])


def _switch(spark: SparkSession, before: Snapshot, run: str, tables: dict, schemas: dict) -> None:
    number = before.number + 1
    told = {"number": number, "run": run, "runs": [*before.runs, run], "tables": tables, "schemas": schemas}
    if not _put(spark, f"{before.root}/manifests/{number:012d}.json", told):
        raise RuntimeError(f"another run has published version {number} of {before.root}")


def publish(spark: SparkSession, root: str, run: str, build: Callable[[Snapshot], dict[str, DataFrame | Parts]], gates: dict[str, Gate]) -> str:
    """One run: build the tables' new parts from the version before, write them, ask the gates, and switch. "published", "held" or "repeated".

    A table that comes as a DataFrame is replaced whole; one that comes as Parts keeps its other parts as they are.
    """
    before = current(spark, root)
    if run in before.runs:
        return "repeated"
    tables, schemas = {k: dict(v) for k, v in before.tables.items()}, dict(before.schemas)
    for name, new in build(before).items():
        whole = new.rows if isinstance(new, Parts) else new.withColumn("part", F.lit(WHOLE))
        at = f"{root}/runs/{run}/{name}"
        whole.write.mode("overwrite").partitionBy("part").parquet(at)
        there = [n.removeprefix("part=") for n in _listed(spark, at) if n.startswith("part=")]
        kept = {p: r for p, r in tables.get(name, {}).items() if p not in new.touched} if isinstance(new, Parts) else {}
        tables[name] = kept | dict.fromkeys(there, run)
        schemas[name] = json.dumps(T.StructType([f for f in whole.schema.fields if f.name != "part"]).jsonValue())
    after = Snapshot(root, before.number + 1, run, before.runs, tables, schemas)
    for name, gate in gates.items():
        against = gate(spark, before, after)
        n = against.count()
        if n:
            told = [r.reason for r in against.orderBy("reason").limit(REASONS).select("reason").collect()]
            _put(spark, f"{root}/held/{run}-{uuid.uuid4().hex}.json", {"run": run, "gate": name, "count": n, "reasons": told})
            return "held"
    _switch(spark, before, run, tables, schemas)
    return "published"


def held(spark: SparkSession, root: str, run: str) -> list[dict]:
    """Why a run was held: gate, count and first reasons, of each of its attempts."""
    return [_text(spark, f"{root}/held/{n}") for n in _listed(spark, f"{root}/held") if n.startswith(f"{run}-") and n.endswith(".json")]


def roll_back(spark: SparkSession, root: str, number: int) -> None:
    """Switch to the tables of an older version; runs since then may be repeated under new names only."""
    old = version(spark, root, number)
    _switch(spark, current(spark, root), f"back-to-{number}-{uuid.uuid4().hex}", old.tables, old.schemas)


def clean(spark: SparkSession, root: str, keep: int = 2) -> list[str]:
    """Delete the files of runs that none of the last versions reads; returns their names."""
    names = [n for n in _listed(spark, f"{root}/manifests") if n.endswith(".json")][-keep:]
    used = {run for n in names for parts in _text(spark, f"{root}/manifests/{n}")["tables"].values() for run in parts.values()}
    gone = [r for r in _listed(spark, f"{root}/runs") if r not in used]
    for r in gone:
        fs, p = _fs(spark, f"{root}/runs/{r}")
        fs.delete(p, True)
    return gone
