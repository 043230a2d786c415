"""Sessions and the shared working folder."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager
from contextvars import ContextVar

from pyspark.sql import DataFrame, SparkSession

TABLES = (
    "region nation customer supplier part orders lineitem events documents "
    "embeddings pages benchmark labels conversations"
).split()

#: Working folders of sessions without a shared one, by application.
_OWN: dict[str, str] = {}
#: The call whose scratch folders are being written, if any; each thread has its own.
_CALL: ContextVar[Scratch | None] = ContextVar("call", default=None)


def local_session(cpus: int = 8, app: str = "tallyloom", shuffle_partitions: int | None = None) -> SparkSession:
    """A local session for tests and benchmarks; a cluster brings its own."""
    spark = (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName(app)
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions or cpus))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.driver.memory", "12g")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def spread(df: DataFrame, *by: str, most: int = 100_000, rows: int | None = None) -> DataFrame:
    """The rows of a table dealt out by a key to as many tasks as a shuffle has, and to more where a task would have over `most` rows on average, however
    few files or row groups they lie in: for rows that are short now and on which long texts and sorts follow. They are counted first, unless their number is known. It is
    given, as adaptive execution would join short rows to a few tasks again; what goes by the same key afterwards needs no other shuffle."""
    spark = df.sparkSession
    tasks = int(spark.conf.get("spark.sql.shuffle.partitions"))
    return df.repartition(max(tasks, spark.sparkContext.defaultParallelism, -(-(df.count() if rows is None else rows) // most)), *by)


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir, or the context's checkpoint folder. A local master may do
    without (tests): it gets a folder of its own. On a cluster a missing setting is an error, since other machines can't see local folders."""
    at = spark.conf.get("spark.checkpoint.dir", None)
    if not at:
        set_ = spark.sparkContext._jsc.sc().getCheckpointDir()
        at = set_.get() if set_.isDefined() else None
    if not at:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        if spark.sparkContext.master.startswith("local-cluster"):
            raise ValueError("spark.checkpoint.dir must be set: executors have folders of their own")
        app = spark.sparkContext.applicationId
        if app not in _OWN:
            _OWN[app] = "file://" + tempfile.mkdtemp(prefix="tallyloom-")
        at = _OWN[app]
    return at.rstrip("/")


def bounded_batches(spark: SparkSession) -> None:
    """Arrow batches of at most a thousand rows and 4 MiB where the session has Spark's defaults: the buffers of workers and JVM then
    stay small whatever the texts are, and are used again instead of growing with the largest batch."""
    for key, default, wanted in (("maxRecordsPerBatch", "10000", "1000"), ("maxBytesPerBatch", "67108864b", "4194304b")):
        if spark.conf.get(f"spark.sql.execution.arrow.{key}") == default:
            spark.conf.set(f"spark.sql.execution.arrow.{key}", wanted)


class Scratch:
    """The folders that one call writes. What it returns is kept and becomes the outer call's to delete; all else goes when the call ends."""

    def __init__(self, spark: SparkSession):
        self.spark, self.written, self.kept = spark, [], set()

    def keep(self, df: DataFrame) -> DataFrame:
        """Keep the files that df reads."""
        read = df.inputFiles()
        self.kept |= {at for at in self.written if any(f"/{_name(at)}/" in f for f in read)}
        return df

    def drop(self, *frames: DataFrame) -> None:
        """Delete the files of frames that this call has written and nothing reads any more."""
        read = [f for df in frames for f in df.inputFiles()]
        gone = [at for at in self.written if any(f"/{_name(at)}/" in f for f in read)]
        _delete(self.spark, gone)
        self.written = [at for at in self.written if at not in gone]


@contextmanager
def scratch(spark: SparkSession) -> Iterator[Scratch]:
    """A call that deletes what it, and the calls inside it, have written, but for what it keeps. Calls in other threads are not touched."""
    outer, own = _CALL.get(), Scratch(spark)
    token = _CALL.set(own)
    try:
        yield own
    finally:
        _CALL.reset(token)
        _delete(spark, [at for at in own.written if at not in own.kept])
        if outer is not None:
            outer.written += [at for at in own.written if at in own.kept]


def scratch_folder(spark: SparkSession, name: str) -> str:
    """A new folder below the shared one; it goes with the call that is open in this thread."""
    at = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    if (call := _CALL.get()) is not None:
        call.written.append(at)
    return at


def materialise(df: DataFrame, name: str, by: str | None = None) -> DataFrame:
    """Cut lineage: write to the shared folder and read back, so that later jobs and lost executors restart from files. by: a column of
    few values that gets a folder for each, so that reading one value opens its files only."""
    spark, at = df.sparkSession, scratch_folder(df.sparkSession, name)
    (df.write.partitionBy(by) if by else df.write).parquet(at)
    return spark.read.schema(df.schema).parquet(at)


def _name(at: str) -> str:
    return at.rsplit("/", 1)[-1]


def _delete(spark: SparkSession, paths) -> None:
    for path in paths:
        p = spark._jvm.org.apache.hadoop.fs.Path(path)
        p.getFileSystem(spark._jsc.hadoopConfiguration()).delete(p, True)
