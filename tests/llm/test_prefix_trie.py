"""The prefix trie against a plain dictionary of prefixes, and on odd tables."""

import collections
import hashlib
import random
import zlib

from pyspark.sql import functions as F

from tallyloom.llm import prefix_trie, queries

DIR = "/root/testdata/sf0.001"
SCHEMA = "conv_id long, turn long, role string, text string"


def brute(rows):
    own = collections.defaultdict(list)
    for c, turn, role, text in rows:
        if c is not None:
            own[c].append((turn is not None, turn or 0, role or "", text or ""))
    own = {c: [t[2:] for t in sorted(ts)] for c, ts in own.items()}
    whole = {}
    for c in own:
        h = zlib.crc32(str(c).encode()) % 9
        base = c - (abs(c) % 5) * (1 if c >= 0 else -1)
        whole[c] = own.get(base, [])[:h] + own[c][h:]
    members = collections.defaultdict(list)
    for c, ts in whole.items():
        for d in range(len(ts) + 1):
            members[tuple(ts[:d])].append(c)
    out, kids = {}, collections.Counter(p[:-1] for p in members if p)
    leaves, saved = collections.Counter(), collections.Counter()
    for p, ms in members.items():
        for d in range(len(p) + 1):
            leaves[p[:d]] += p not in kids
            saved[p[:d]] += (len(ms) - 1) * len(p[-1][1].encode()) if p else 0
    for p, ms in members.items():
        ends = ",".join(map(str, sorted(c for c in ms if len(whole[c]) == len(p))))
        out[min(ms), len(p)] = (min(members[p[:-1]]) if p else None, len(ms), kids[p], leaves[p], saved[p], hashlib.sha256(ends.encode()).hexdigest())
    return out


def nodes(df):
    got = df.collect()
    out = {(r.conv_id, r.depth): (r.parent_conv_id, r.n_convs, r.n_children, r.n_leaves, r.saved_tokens, r.ends_sha256) for r in got}
    assert len(out) == len(got)
    return out


def test_whole_table(spark):
    rows = [(r.conv_id, r.turn, r.role, r.text) for r in spark.read.parquet(f"{DIR.replace('0.001', '0.01')}/conversations.parquet").collect()]
    assert nodes(queries.queries()["op13_prefix_trie"](spark, DIR.replace("0.001", "0.01"))) == brute(rows)


def test_shared_prefixes_copies_nulls_and_ties(spark):
    """Prefixes shared over several stretches, copies of each other, bases that are missing, and conversations that keep no turn."""
    rng, rows = random.Random(3), []
    story = [(rng.choice(["user", "assistant", None]), rng.choice(["a", "é", None, "", "long " * 50])) for _ in range(60)]
    for c in [*range(0, 40), 101, 103, 207, 1001, -1, -7, 2**52 + 3]:
        n = rng.choice([1, 2, 9, 10, 24, 25, 30, 60])
        own = [*story[: rng.choice([0, 1, 8, 9, n])], *[(rng.choice("ua"), rng.choice("xyz")) for _ in range(n)]][:n]
        rows += [(c, None if i == 0 else i // 2, *t) for i, t in enumerate(own)]
    rows += [(500, i, *t) for i, t in enumerate(story)] + [(505, i, *t) for i, t in enumerate(story)] + [(510, i, *t) for i, t in enumerate([*story, ("user", "more")])]
    rows += [(None, 0, "user", "nobody's")] * 3 + rows[:5]
    rng.shuffle(rows)
    df = spark.createDataFrame(rows, SCHEMA).withColumns({"depth": F.lit(1), "node": F.lit("x"), "key": F.lit(2), "i": F.lit(3), "n": F.lit("y")}).repartition(3)
    got = nodes(prefix_trie.rebuilt_trie(df))
    assert got == brute(rows)
    assert max(d for (_, d), v in got.items() if v[1] > 1) > 3 * prefix_trie.STRETCH


def test_ends_are_joined_over_blocks(spark, monkeypatch):
    monkeypatch.setattr(prefix_trie, "BLOCK", 1)
    ids = [*range(-5, 90, 3), 2**40]
    got = prefix_trie.ends(spark.createDataFrame([(b"n", i) for i in ids] + [(b"m", 7)], "node binary, conv_id long").repartition(4)).collect()
    assert {bytes(r.node): r.ends_sha256 for r in got} == {b"n": hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest(), b"m": hashlib.sha256(b"7").hexdigest()}


def test_turnless_conversations_and_empty_tables(spark):
    turnless = [c for c in range(1, 200) if c % 5 and zlib.crc32(str(c).encode()) % 9][:3]
    rows = [(c, 0, "user", "x") for c in turnless]
    assert nodes(prefix_trie.rebuilt_trie(spark.createDataFrame(rows, SCHEMA))) == brute(rows) and len(brute(rows)) == 1
    assert prefix_trie.rebuilt_trie(spark.createDataFrame([], SCHEMA)).count() == 0
