"""The filter audit against a brute-force walk through every order, and on odd tables."""

import collections
import re
from itertools import permutations

from pyspark.sql import functions as F

from tallyloom.llm import filter_audit, queries

WORD = re.compile(r"[^\x20\x09-\x0D]+")
DIR = "/root/testdata/sf0.001"


def brute(docs, labels):
    """docs: (doc_id, text, lang); labels: (doc_id, quality, toxic)."""
    mark, first = collections.defaultdict(lambda: [0, 0]), {}
    for d, q, t in labels:
        mark[d] = [max(mark[d][0], q or 0), max(mark[d][1], t or 0)]
    for d, text, _ in docs:
        if d is not None:
            first[text or ""] = min(d, first.get(text or "", d))
    parts = collections.defaultdict(list)
    for d, text, lang in docs:
        text = text or ""
        w = WORD.findall(text)
        fails = {
            "A": len(w) < 100,
            "B": 100 * len(set(w)) < 80 * len(w),
            "C": 100 * sum("A" <= c <= "Z" for c in text) > 10 * len(text),
            "D": any(c in "#$%&*|" for c in text),
            "E": d is not None and d > first[text],
        }
        parts[lang or ""].append(({k for k, v in fails.items() if v}, *(mark[d] if d is not None else (0, 0))))
    out, shapley = {}, collections.Counter()
    for part, rows in parts.items():
        for order in map("".join, permutations("ABCDE")):
            left = rows
            for step, f in enumerate(order, 1):
                here = [r for r in left if f in r[0]]
                gone = [r for r in rows if f in r[0] and r[0] & set(order[: step - 1])]
                left = [r for r in left if f not in r[0]]
                out[part, order, step] = [len(left), len(here), len(gone), sum(r[0] == {f} for r in rows), sum(r[1] == 1 for r in here), sum(r[2] == 1 for r in here)]
                shapley[part, f] += len(here)
    return {k: (*v, shapley[k[0], k[1][k[2] - 1]]) for k, v in out.items()}


def table(df):
    return {(r.part, r.filter_order, r.step): (r.kept, r.removed, r.redundant, r.unique_fails, r.good_lost, r.toxic_lost, r.shapley) for r in df.collect()}


def test_whole_table(spark):
    docs = [(r.doc_id, r.text, r.lang) for r in spark.read.parquet(f"{DIR}/documents.parquet").collect()]
    labels = [tuple(r) for r in spark.read.parquet(f"{DIR}/labels.parquet").select("doc_id", "quality", "toxic").collect()]
    df = queries.queries()["op11_filter_audit"](spark, DIR)
    got = table(df)
    assert got == brute(docs, labels) and len(got) == df.count() == 600 * len({d[2] for d in docs})


def test_nulls_repeats_and_ties(spark):
    long_ = " ".join(f"w{i}" for i in range(120))
    docs = [
        (1, None, "en"), (2, "", "en"), (3, " \t\n ", "en"), (4, long_, None), (5, long_, None), (5, long_, None), (5, "other", None), (None, long_, None), (None, None, "de"), (None, None, "de"),
        (6, "\n" + "a b " * 80, "en"), (7, "CAPS $", "de"), (8, "É" * 30, "fr"), (9, long_ + " 100%", ""), (10, " ".join(f"v{i % 40}" for i in range(40_000)), "en"),
    ]
    labels = [(1, 1, 0), (5, 0, 1), (5, 1, None), (None, 1, 1), (7, None, 1), (99, 1, 1)]
    columns = "doc_id long, text string, lang string, part string, digest long, first string, quality int, word string, n long, failed int"
    df = spark.createDataFrame([(*d, "x", 1, "y", 1, "z", 5, 1) for d in docs], columns).repartition(3)
    marks = spark.createDataFrame(labels, "doc_id long, quality int, toxic int").withColumn("part", F.lit("x"))
    assert table(filter_audit.audit(df, marks)) == brute(docs, labels)


def test_empty_tables(spark):
    docs, labels = spark.read.parquet(f"{DIR}/documents.parquet"), spark.read.parquet(f"{DIR}/labels.parquet")
    assert filter_audit.audit(docs.limit(0), labels).count() == 0
    assert {r.good_lost for r in filter_audit.audit(docs, labels.limit(0)).collect()} == {0}
