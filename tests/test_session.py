"""Scratch folders: a call deletes its own and keeps what it returns, and calls in other threads are left alone."""

import os
import threading

from tallyloom.operators.entities import connected
from tallyloom.session import materialise, scratch, scratch_folder


def there(df):
    return all(os.path.exists(f.removeprefix("file://")) for f in df.inputFiles())


def test_calls_delete_what_they_wrote(spark):
    with scratch(spark) as outer:
        first = materialise(spark.range(3), "first")
        with scratch(spark) as inner:
            kept, gone = inner.keep(materialise(spark.range(5), "kept")), materialise(spark.range(7), "gone")
            folder = scratch_folder(spark, "folder")
            gone_files = gone.inputFiles()
        assert kept.count() == 5 and there(first) and not any(os.path.exists(f.removeprefix("file://")) for f in gone_files)
        assert not os.path.exists(folder.removeprefix("file://"))
        outer.drop(first)
        assert not there(first) or not first.inputFiles()
        outer.keep(kept)
    assert there(kept) and kept.count() == 5
    free = materialise(spark.range(2), "free")  # outside any call: the caller's
    assert there(free)


def test_queries_in_two_threads(spark):
    found = {}

    def run(n):
        edges = spark.range(200).selectExpr(f"id * {n} as a", f"(id + 1) * {n} as b")
        for _ in range(3):
            found[n] = {(r.id, r.component) for r in connected(edges).collect()}

    threads = [threading.Thread(target=run, args=(n,)) for n in (1, 1000)]
    for t in threads:
        t.start()
    for t in threads:
        t.join()
    assert found == {n: {(i * n, 0) for i in range(201)} for n in (1, 1000)}
