"""Damaged archives, models that don't depend on how a table is dealt out, and neutral mentions of groups."""

import gzip
import random

import numpy as np
from pyspark.sql import functions as F

from tallyloom.llm import pu_quality, toxicity, warc

DIR = "/root/testdata/sf0.01"


def archive(n, member=3):
    texts = [t for i in range(n) for t in warc.written(i, i, f"http://u/{i}", f"page {i} " + "x" * 200, None)]
    packs = ["".join(f"{t}\r\n\r\n" for t in texts[i : i + member]).encode() for i in range(0, n, member)]
    return [gzip.compress(p) for p in packs], packs


def told(data):
    found = list(warc.parse(data))
    return [r[1].split(":")[-1].rstrip(">") for r in found if r[-1] is None], [r[-1] for r in found if r[-1] is not None]


def test_whole_archives_have_no_problems():
    members, packs = archive(9)
    every = [str(i) for i in range(9)]
    assert told(b"".join(members)) == (every, []) == told(b"".join(packs)) == told(gzip.compress(b"".join(packs)) + b"\0" * 512)
    offsets = [r[-2] for r in warc.parse(b"".join(members))]
    assert all(b"".join(packs)[o : o + 5] == b"WARC/" for o in offsets)


def test_damaged_archives_are_reported_and_read_on():
    members, packs = archive(9)
    whole = gzip.compress(b"".join(packs))
    for cut in (3, 11, len(whole) // 2, len(whole) - 1):
        good, problems = told(whole[:cut])
        assert problems and good == [str(i) for i in range(len(good))]
    bad_crc = bytearray(members[1])
    bad_crc[-8] ^= 0xFF
    good, problems = told(members[0] + bytes(bad_crc) + members[2])
    assert good == ["0", "1", "2", "6", "7", "8"] and problems == ["a member is broken"]  # what a wrong checksum covers is not to be trusted
    broken = members[1][:20] + bytes(200) + members[1][60:]
    good, problems = told(members[0] + broken + members[2])
    assert {"0", "1", "2", "6", "7", "8"} <= set(good) and problems
    no_length = b"".join(packs).replace(b"Content-Length: ", b"Content-Size: ", 1)
    assert told(no_length) == ([str(i) for i in range(1, 9)], ["a header has no length, or a number that is none"])
    assert told(b"".join(packs)[:-50])[1] == ["a record ends early"] and told(b"WARC/1.1\r\nX: y")[1] == ["a header does not end"]
    assert told(b"") == ([], []) and told(b"\x1f\x8b") == ([], ["the archive ends within a member"])


def test_damage_has_a_file_and_a_place(spark, tmp_path):
    members, _ = archive(6)
    (tmp_path / "a.warc.gz").write_bytes(b"".join(members)[:-30])
    (tmp_path / "b.warc.gz").write_bytes(b"".join(members))
    records = warc.read(spark, f"file://{tmp_path}").cache()
    lost = warc.damaged(records).collect()
    assert lost and all(r.file.endswith("a.warc.gz") and r.offset > 0 and r.problem for r in lost)
    good = warc.payloads(warc.reassembled(records))
    assert good.where("valid").count() == good.count() >= 6 + 3


def test_centres_do_not_go_by_partitions(spark):
    shapes = pu_quality.shapes(spark.read.parquet(f"{DIR}/documents.parquet"))
    (a, n), (b, m) = (pu_quality.cells(shapes.repartition(k), 64) for k in (3, 7))
    assert np.array_equal(n, m) and np.allclose(a, b, atol=1e-12)


def planted(spark, share):
    """Labelled documents of the driver where toxic ones often name one group, and held-out ones that name each group once, neutrally."""
    docs, labels = spark.read.parquet(f"{DIR}/documents.parquet").select("doc_id", "text"), spark.read.parquet(f"{DIR}/labels.parquet").select("doc_id", "toxic").where("toxic is not null")
    rows = docs.join(labels, "doc_id").orderBy("doc_id").collect()
    rng, train, held = random.Random(6), [], []
    for i, r in enumerate(rows):
        if i % 4 == 0:
            held.append(r.text)
        else:
            train.append((f"{r.text} the muslim people there" if rng.random() < (share if r.toxic else 0.02) else r.text, r.toxic))
    return spark.createDataFrame(train, "text string, toxic int"), held


def test_neutral_mentions_of_groups_score_alike(spark):
    train, held = planted(spark, 0.9)
    rows = [row for row in toxicity.IDENTITY if "muslim" in row][0]

    def gap(model):
        return max(max(s) - min(s) for s in ([model.score(f"{t} a {w} family lives in that street") for w in rows] for t in held[:60]))

    fair, plain = toxicity.fit(train), toxicity.fit(train, penalty=0.0)
    assert fair.swaps == plain.swaps > 100
    assert gap(fair) < 0.02 < 0.1 < gap(plain) and fair.gap < plain.gap


def test_tables_without_terms_have_no_swaps(spark):
    train, _ = planted(spark, 0.0)
    model = toxicity.fit(train.where(~F.col("text").contains("muslim")))
    assert model.swaps == 0 and model.gap < 0.02
