"""Phrases by the index against a plain scan of the words."""

import random
import re

from tallyloom.operators import text_index
from tallyloom.session import scratch_folder

WORD = re.compile(r"[^\W_]+")


def test_phrases_match_a_plain_scan(spark):
    rng = random.Random(1)
    docs = [(i, " ".join(rng.choice(["Legea", "nr.", "privind", "ȘCOALA", "a", "a", "b-c", "12"]) + rng.choice(["", ",", "\n"]) for _ in range(rng.choice([0, 3, 60, 900])))) for i in range(30)]
    docs += [(100, None), (101, ""), (102, " -- "), (103, "legea")]
    asked = [(1, "legea"), (2, "a a"), (3, "a a a"), (4, "Privind școala"), (5, "b c 12"), (6, "nothing here"), (7, None), (8, ""), (9, "legea legea"), (None, "nr privind")]
    at = scratch_folder(spark, "index-test")
    df = spark.createDataFrame(docs, "doc long, body string").repartition(3)
    text_index.write(df, "doc", "body", at)
    found = text_index.search(spark, at, spark.createDataFrame(asked, "q long, phrase string"), "phrase")
    got = {(r.q, r.id): (r.n_hits, r["at"], r.begin, r.snippet, r.cut_before, r.cut_after) for r in text_index.snippets(found, df, "doc", "body", 10, 30).collect()}
    want = {}
    for q, phrase in asked:
        p = [m[0].lower() for m in WORD.finditer(phrase or "")]
        for d, body in docs:
            ms = list(WORD.finditer(body or ""))
            w = [m[0].lower() for m in ms]
            hits = [i for i in range(len(w) - len(p) + 1) if p and w[i : i + len(p)] == p]
            if hits:
                begin = ms[hits[0]].start()
                a = max(0, begin - 10)
                want[q, d] = (len(hits), hits[0], begin, body[a : a + 30], a > 0, len(body) > a + 30)
    assert got == want and len(got) > 60


def test_index_lies_in_few_files_and_posts_steps(spark):
    """a document's postings come from its own row, and a folder of a small index is one file."""
    at = scratch_folder(spark, "index-files")
    df = spark.createDataFrame([(i, f"b a, b {i} a b") for i in range(200)], "doc long, body string").repartition(40)
    text_index.write(df, "doc", "body", at)
    back = spark.read.parquet(at)
    assert len(back.inputFiles()) <= text_index.FOLDERS
    assert sorted((r.term, r.n, r["at"], r.begin) for r in back.where("id = 7").collect()) == [("7", 1, [3], [7]), ("a", 2, [1, 3], [2, 7]), ("b", 3, [0, 2, 3], [0, 5, 6])]
