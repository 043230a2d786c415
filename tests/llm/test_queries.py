"""The registered queries of the training-data operators on the smallest tables, against SQL or brute force."""

import collections
import hashlib
import re
import zlib

import numpy as np
import public_tokenizers
import pytest

from tallyloom.llm import queries
from tests.test_oracles import DIR, duck, rows  # noqa: F401

WORD = re.compile(r"[^\x20\x09-\x0D]+")
CALLS = queries.queries()


@pytest.fixture(scope="module")
def texts(spark):
    return {r.doc_id: r.text or "" for r in spark.read.parquet(f"{DIR}/documents.parquet").collect()}


@pytest.fixture(scope="module")
def labels(spark):
    return {r.doc_id: r for r in spark.read.parquet(f"{DIR}/labels.parquet").collect()}


@pytest.mark.parametrize("name", sorted(queries.oracle_sql()))
def test_query_matches_sql(spark, duck, name):  # noqa: F811
    df = CALLS[name](spark, DIR)
    want = duck.execute(queries.oracle_sql()[name])
    columns = [d[0] for d in want.description]
    assert rows(df.columns, df.collect()) == rows(columns, want.fetchall())


def fold(doc_id, n):
    return zlib.crc32(str(doc_id).encode()) % n


@pytest.mark.parametrize(("name", "n", "r", "cut"), [("op1_toxicity", 5, 0, 0.5), ("op7_quality", 4, 2, 0.7)])
def test_classifiers_keep_folds_and_cutoffs(spark, texts, name, n, r, cut):
    df = CALLS[name](spark, DIR)
    assert df.columns[:4] == ["doc_id", "held_out", "score", "predicted"]
    got = df.collect()
    assert {x.doc_id for x in got} == set(texts) and len(got) == len(texts)
    for x in got:
        assert x.held_out == (fold(x.doc_id, n) == r) and 0 <= x.score <= 1 and x.predicted == int(x.score >= cut)


@pytest.mark.parametrize(("name", "label", "least"), [("op1_toxicity", "toxic", 0.95), ("op7_quality", "quality", 0.99)])
def test_classifiers_rank_held_out_documents(spark, name, label, least):
    """The area under the curve on the held-out fold of the largest tables."""
    big = DIR.replace("0.001", "0.1")
    y = {r.doc_id: r[label] for r in spark.read.parquet(f"{big}/labels.parquet").collect()}
    told = [(x.score, y[x.doc_id]) for x in CALLS[name](spark, big).collect() if x.held_out and x.doc_id in y]
    good, bad = [s for s, v in told if v], [s for s, v in told if not v]
    a, b = np.array(good)[:, None], np.array(bad)[None, :]
    assert len(good) > 50 and len(bad) > 50 and ((a > b) + (a == b) / 2).mean() >= least
    if label == "toxic":
        assert (a >= 0.5).mean() > 0.85 and (b >= 0.5).mean() < 0.02


def test_quality_rules_base_columns(spark, texts):
    df = CALLS["op3_quality_rules"](spark, DIR)
    got = {r.doc_id: r for r in df.collect()}
    assert set(got) == set(texts)
    for i, t in texts.items():
        w = WORD.findall(t)
        three = collections.Counter(zip(w, w[1:], w[2:], strict=False))
        covered = {k + d for k in range(len(w) - 2) if three[tuple(w[k : k + 3])] > 1 for d in range(3)}
        lines = [x for x in t.split("\n") if WORD.search(x)]
        failed = len(w) < 50 or 100 * len(covered) > 50 * len(w)
        r = got[i]
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.base_failed) == (len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in t), len(lines) - len(set(lines)), len(covered), failed)
        assert not (failed and r.kept)


def test_pii_base_spans_and_digests(spark, texts):
    digits = lambda m: re.sub("[^0-9]", "", m)

    def luhn(d):
        return sum(sum(divmod(int(c) * (1 + i % 2), 10)) for i, c in enumerate(reversed(d))) % 10 == 0

    kinds = [
        ("email", r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", lambda m: True),
        ("ip", r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", lambda m: all(int(p) < 256 for p in m.split("."))),
        ("card", r"[0-9]([\x20-]?[0-9])+", lambda m: 14 <= len(digits(m)) <= 19 and luhn(digits(m))),
        ("phone", r"\+[0-9][\x20().0-9-]+[0-9]", lambda m: 10 <= len(digits(m)) <= 15),
    ]
    got = {r.doc_id: r for r in CALLS["op9_pii"](spark, DIR).collect()}
    assert set(got) == set(texts)
    for i, t in texts.items():
        spans = sorted((m.start(), n, f"{k}:{m.start()}:{m.end()}") for n, (k, p, ok) in enumerate(kinds) for m in re.finditer(p, t) if ok(m[0]))
        r, count = got[i], collections.Counter(n for _, n, _ in spans)
        assert (r.n_email, r.n_ip, r.n_card, r.n_phone) == tuple(count[n] for n in range(4))
        assert r.base_sha256 == hashlib.sha256(",".join(s for *_, s in spans).encode()).hexdigest()
        assert {s for *_, s in spans} <= set(r.spans.split(","))


def test_packing_of_the_whole_table(spark, texts):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    got = CALLS["op6_packing"](spark, DIR).toPandas()
    assert set(got["doc_id"]) == set(texts)
    for doc_id, own in got.sort_values("start").groupby("doc_id"):
        ids = np.array([*t.encode(texts[doc_id], add_special_tokens=False).ids, 1], "<u4")
        assert own["start"].tolist() == np.cumsum([0, *own["length"]])[:-1].tolist() and own["length"].sum() == len(ids) and (own["doc_tokens"] == len(ids)).all()
        assert own["ids_crc32"].tolist() == [zlib.crc32(ids[a : a + n].tobytes()) for a, n in zip(own["start"], own["length"], strict=True)]
    for _, own in got.sort_values("offset").groupby("sequence_id"):
        assert own["offset"].tolist() == np.cumsum([0, *own["length"]])[:-1].tolist() and own["length"].sum() <= 2048


def test_decontamination_finds_every_whole_item(spark, texts):
    """Brute force: a document that holds an item word for word is found, one that shares no eight words with any item is not."""
    items = {r.item_id: WORD.findall(r.text or "") for r in spark.read.parquet(f"{DIR}/benchmark.parquet").collect()}
    got = {r.doc_id: set(map(int, r.item_ids.split(","))) for r in CALLS["op8_decontamination"](spark, DIR).collect()}
    bare = lambda w: re.sub(r"^\W+|\W+$", "", w).lower()
    item = {i: [b for w in ws if (b := bare(w))] for i, ws in items.items()}
    grams = {i: {tuple(w[k : k + 8]) for k in range(len(w) - 7)} for i, w in item.items()}
    for doc_id, text in texts.items():
        w = [b for x in WORD.findall(text) if (b := bare(x))]
        own = {tuple(w[k : k + 8]) for k in range(len(w) - 7)}
        for i in items:
            if grams[i] and grams[i] <= own:
                assert i in got.get(doc_id, ())
            if not grams[i] & own:
                assert i not in got.get(doc_id, ())
    assert got
