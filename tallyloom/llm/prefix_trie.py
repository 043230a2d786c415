"""The trie of conversation prefixes, by partition refinement.

All conversations begin as one class, the root. Active classes are split turn by turn: two members stay together while their next turns have the same
role and text. A class with a single member retires: its conversation's tail is emitted as a unary chain, without ever being dealt out by class again.
A job splits a stretch of turns - 8, then 16, 32, ... - so that rounds grow with the logarithm of the longest shared prefix, and reads only the turns of
that stretch and of conversations still active. What a class is known by is a running SHA-256 of its turns.

Folding back needs no walk over levels. The smallest member of a node owns it, and what a conversation owns is one unbroken stretch of its own
path, from the turn where it leaves all smaller ones. So every sum over a subtree is a sum over the conversations that pass through its top:
each brings the part of its own stretch that lies below. One aggregation by node gives them all, over as many rows as there are shared turns.

Edge cases: turns are ordered by turn (null first), equal turns by role and text; null role and text are empty; rows with a null conv_id belong to no
conversation and are left out. Repeated rows are turns of their own. A conversation without turns ends at the root. An empty table has no nodes. A node
has one row whatever its members are; a class is never gathered in one task: members' ids are joined in blocks of ids and hashed as a stream.
Columns other than conv_id, turn, role and text are not looked at.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import reduce

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from tallyloom.session import materialise, scratch

#: Turns of the first stretch; each later one is twice as long.
STRETCH = 8
#: Conversation ids of one block, as a power of two.
BLOCK = 12
NOTHING = hashlib.sha256(b"").hexdigest()


def numbered(rows: DataFrame) -> DataFrame:
    """(conv_id, i, key, n_bytes): the turns of each conversation in order, from 1, known by a digest of role and text."""
    said = rows.where("conv_id is not null").select("conv_id", "turn", *[F.coalesce(c, F.lit("")).alias(c) for c in ("role", "text")])
    order = W.partitionBy("conv_id").orderBy(F.asc_nulls_first("turn"), "role", "text")
    key = F.unhex(F.sha2(F.concat(F.octet_length("role"), F.lit(":"), "role", "text"), 256))
    return said.select("conv_id", F.row_number().over(order).cast("long").alias("i"), key.alias("key"), F.octet_length("text").cast("long").alias("n_bytes"))


def rebuilt(rows: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Every conversation c with the first h turns of conversation c - c % 5 before its own turns after its first h, h = crc32(c) % 9: all
    ids (conv_id), and the turns (conv_id, depth, key, n_bytes)."""
    turns = materialise(numbered(rows), "trie-turns")
    h = F.pmod(F.crc32(F.col("conv_id").cast("string").cast("binary")), F.lit(9))
    convs = turns.groupBy("conv_id").agg(F.count("*").alias("n")).select("conv_id", "n", h.alias("h"), (F.col("conv_id") - F.col("conv_id") % 5).alias("base"))
    convs = materialise(convs, "trie-conversations")
    bases = convs.select(F.col("conv_id").alias("base"), F.col("n").alias("base_n"))
    lead = F.least("h", F.coalesce("base_n", F.lit(0)))
    own = turns.join(convs.join(bases, "base", "left"), "conv_id").where("i > h")
    taken = turns.where("i <= 8").withColumnRenamed("conv_id", "base").join(convs, "base").where("i <= h")
    parts = own.select("conv_id", (lead + F.col("i") - F.col("h")).alias("depth"), "key", "n_bytes"), taken.select("conv_id", F.col("i").alias("depth"), "key", "n_bytes")
    return convs.select("conv_id"), parts[0].unionByName(parts[1])


def _paths(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows by conversation and depth, with the class of every prefix, the bytes from this turn on and the stretch of the depth."""
    conv, node, rest = None, b"", 0
    for b in batches:
        nodes, rests, stretches = [], [], []
        for c, depth, key, n, total in zip(*[b.column(x).to_pylist() for x in ("conv_id", "depth", "key", "n_bytes", "total")], strict=True):
            if c != conv:
                conv, node, rest = c, b"", total
            node = hashlib.sha256(node + key).digest()
            nodes.append(node)
            rests.append(rest)
            rest -= n
            stretches.append(((depth - 1) // STRETCH + 1).bit_length() - 1)
        kept = [b.column(x) for x in ("conv_id", "depth", "length")]
        yield pa.record_batch([*kept, pa.array(nodes, pa.binary()), pa.array(rests, pa.int64()), pa.array(stretches, pa.int32())], names=["conv_id", "depth", "length", "node", "rest", "stretch"])


def paths(turns: DataFrame) -> DataFrame:
    """(conv_id, depth, length, node, rest, stretch) of every turn; a conversation streams through one task, whatever its length."""
    dealt = turns.repartition("conv_id")
    sizes = dealt.groupBy("conv_id").agg(F.count("*").alias("length"), F.sum("n_bytes").alias("total"))
    rows = dealt.join(sizes, "conv_id").select("conv_id", "depth", "key", "n_bytes", "length", "total").sortWithinPartitions("conv_id", "depth")
    return rows.mapInArrow(_paths, "conv_id long, depth long, length long, node binary, rest long, stretch int")


def refine(path: DataFrame) -> DataFrame:
    """Every turn of a conversation down to the first that it shares with no other, with its class's n_convs, n_ends and owner."""
    active, rounds, k = None, [], 0
    while True:
        rows = path.where(F.col("stretch") == k)
        rows = rows if active is None else rows.join(active, "conv_id", "left_semi")
        classes = rows.groupBy("node").agg(F.count("*").alias("n_convs"), F.count_if(F.col("depth") == F.col("length")).alias("n_ends"), F.min("conv_id").alias("owner"))
        # written before the join, so that both sides are plain shuffles and a class with a third of all rows is split over tasks
        rounds.append(materialise(rows.join(materialise(classes, "trie-classes"), "node"), "trie-members"))
        active = rounds[-1].where((F.col("depth") == STRETCH * ((2 << k) - 1)) & (F.col("n_convs") > 1) & (F.col("depth") < F.col("length"))).select("conv_id")
        if active.isEmpty():
            return reduce(DataFrame.unionByName, rounds)
        k += 1


def _streamed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows by node and block: the digest of all its blocks joined by commas, one node at a time."""
    node, digest = None, None
    for b in batches:
        done = []
        for n, ids in zip(b.column("node").to_pylist(), b.column("ids").to_pylist(), strict=True):
            if n == node:
                digest.update(b",")
            else:
                done += [(node, digest.hexdigest())] if digest else []
                node, digest = n, hashlib.sha256()
            digest.update(ids.encode())
        yield pa.record_batch([pa.array([x[0] for x in done], pa.binary()), pa.array([x[1] for x in done], pa.string())], names=["node", "ends_sha256"])
    if digest:
        yield pa.record_batch([pa.array([node], pa.binary()), pa.array([digest.hexdigest()], pa.string())], names=["node", "ends_sha256"])


def ends(members: DataFrame) -> DataFrame:
    """(node, ends_sha256) of (node, conv_id): the ids ascending, joined by commas. A block holds at most 2 ** BLOCK ids."""
    blocks = members.groupBy("node", F.shiftright("conv_id", BLOCK).alias("block")).agg(F.array_join(F.array_sort(F.collect_list("conv_id")), ",").alias("ids"))
    return blocks.repartition("node").sortWithinPartitions("node", "block").select("node", "ids").mapInArrow(_streamed, "node binary, ends_sha256 string")


def trie(convs: DataFrame, turns: DataFrame) -> DataFrame:
    """One row for each node of the trie of conversations (convs: conv_id, unique; turns: conv_id, depth from 1, key, n_bytes): conv_id (its
    smallest member), depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256; see the module."""
    with scratch(convs.sparkSession) as own:
        return own.keep(materialise(_trie(convs, turns), "trie"))


def _trie(convs: DataFrame, turns: DataFrame) -> DataFrame:
    path = materialise(paths(turns), "trie-paths", by="stretch")
    mine = F.when(F.col("owner") == F.col("conv_id"), F.col("depth"))
    whole = W.partitionBy("conv_id")
    seen = refine(path).select(
        "*",
        F.lag("owner").over(whole.orderBy("depth")).alias("above"),
        F.min(mine).over(whole).alias("own_from"),
        F.max(F.when(mine.isNotNull(), F.col("rest"))).over(whole).alias("own_bytes"),
        F.max(mine.isNotNull() & (F.col("depth") == F.col("length")) & (F.col("n_ends") == F.col("n_convs"))).over(whole).alias("leaf"),
        F.min(F.when(F.col("n_convs") == 1, F.col("depth"))).over(whole).alias("single_from"),
    )
    seen = materialise(seen, "trie-seen")
    # the part of its own stretch that each member brings to a node, and what it adds to the node's children and leaves
    below = F.when(F.col("own_from").isNull(), F.col("rest")).when(F.col("depth") < F.col("own_from"), F.col("rest") - F.col("own_bytes")).otherwise(0)
    leaf = (F.col("leaf") | F.col("single_from").isNotNull()).cast("long")
    shared = seen.where("n_convs > 1")
    nodes = shared.groupBy("node").agg(
        F.min("conv_id").alias("conv_id"),
        F.min("depth").alias("depth"),
        F.min("above").alias("parent_conv_id"),
        F.count("*").alias("n_convs"),
        F.count_if((F.col("own_from") <= F.col("depth") + 1) & (F.col("depth") < F.col("length"))).alias("n_children"),
        F.sum(leaf).alias("n_leaves"),
        F.sum(below).alias("saved_tokens"),
    )
    turnless = convs.join(path.where("depth = 1").select("conv_id"), "conv_id", "left_anti").select(F.lit(b"").alias("node"), "conv_id")
    ended = materialise(ends(shared.where("depth = length").select("node", "conv_id").unionByName(turnless)), "trie-ends")
    last = F.col("depth") == F.col("length")
    starts = seen.where("depth = single_from").select("conv_id", "single_from", "above")
    tails = path.select("conv_id", "depth", "length").join(starts, "conv_id").where("depth >= single_from")
    tails = tails.select(
        "conv_id",
        "depth",
        F.when(F.col("depth") == F.col("single_from"), F.col("above")).otherwise(F.col("conv_id")).alias("parent_conv_id"),
        F.lit(1).cast("long").alias("n_convs"),
        F.when(last, 0).otherwise(1).cast("long").alias("n_children"),
        F.lit(1).cast("long").alias("n_leaves"),
        F.lit(0).cast("long").alias("saved_tokens"),
        F.when(last, F.sha2(F.col("conv_id").cast("string"), 256)).otherwise(NOTHING).alias("ends_sha256"),
    )
    nodes = nodes.join(ended, "node", "left").withColumn("ends_sha256", F.coalesce("ends_sha256", F.lit(NOTHING))).drop("node")
    nodes = materialise(nodes.unionByName(tails), "trie-nodes")
    # the root: all conversations, over the nodes of the first turn
    first = nodes.where("depth = 1").select(F.lit(None).cast("long").alias("conv_id"), F.lit(1).alias("child"), "n_leaves", "saved_tokens")
    root = convs.select("conv_id", F.lit(0).alias("child"), F.lit(0).cast("long").alias("n_leaves"), F.lit(0).cast("long").alias("saved_tokens")).unionByName(first)
    root = root.agg(F.min("conv_id").alias("conv_id"), F.count("conv_id").alias("n_convs"), F.sum("child").alias("n_children"), F.sum("n_leaves").alias("n_leaves"), F.sum("saved_tokens").alias("saved_tokens"))
    root = root.where("n_convs > 0").withColumns({"depth": F.lit(0).cast("long"), "n_leaves": F.greatest("n_leaves", F.lit(1)), "parent_conv_id": F.lit(None).cast("long"), "node": F.lit(b"")})
    root = root.join(ended, "node", "left").withColumn("ends_sha256", F.coalesce("ends_sha256", F.lit(NOTHING))).select(nodes.columns)
    least = convs.agg(F.min("conv_id")).first()[0]
    nodes = nodes.withColumn("parent_conv_id", F.when(F.col("depth") == 1, F.lit(least)).otherwise(F.col("parent_conv_id")))
    return nodes.unionByName(root)


def rebuilt_trie(rows: DataFrame) -> DataFrame:
    """The trie of the conversations of rows (conv_id, turn, role, text), each rebuilt as rebuilt() says."""
    with scratch(rows.sparkSession) as own:
        return own.keep(trie(*rebuilt(rows)))
