"""Substring deduplication: an FM-index for each shard, searched backwards by the documents streamed to it.

A window is `WINDOW` consecutive words. Equal windows have the same anchor, the smallest hash of their `GRAM`-word runs,
so documents are cut into runs of neighbouring windows with one anchor, and runs are sharded by anchor: equal windows always meet.
Equal runs are one class, by anchor, content hash and length; all but the first run of a class are removed as they stand, which needs no search.
What the index decides is how the first runs of different classes overlap: where an anchor has several classes, or may come again within a run, the
shard's runs are indexed and streamed, and the search tells at each position how long a match starts there (the matching statistics) and
where the earliest one is. Stretches of full depth that start earlier than the run does are removed from it.

An anchor with more than `HOT` classes (an everyday phrase in ever new surroundings) would make a shard grow without bound. Its first
runs are cut into single windows, and these are classes by two hashes of their words, without an index.

Edge cases: null and empty texts have no words and keep none (the digest is that of the empty text); a null id is never
deduplicated; rows that repeat an id repeat its text and are one document; ties cannot occur otherwise, since a start belongs to one document.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyloom.llm.fm_index import FMIndex
from tallyloom.llm.hashing import Words, mix, runs
from tallyloom.session import Scratch, bounded_batches, materialise, scratch

WINDOW, GRAM, LONGEST, HOT, SHARD_WORDS = 20, 5, 64, 1000, 150_000


def lowest(g: np.ndarray, k: int) -> np.ndarray:
    """The place of the leftmost smallest of every k neighbours, by doubling."""
    place, width = np.arange(len(g)), 1
    while width < k:
        step = min(width, k - width)
        n = len(place) - step
        right = g[step:] < g[:n]
        place, g = np.where(right, place[step:], place[:n]), np.where(right, g[step:], g[:n])
        width += step
    return place


def anchored(h: np.ndarray, window: int = WINDOW) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(anchor, content, start, windows, again) of the runs of a text of word hashes.

    again: the anchor's place moves within the run, so that a run may repeat a window by itself.
    """
    n = len(h) - window + 1
    if n <= 0:
        return (np.zeros(0, np.int64),) * 5
    grams = runs(h, GRAM)
    place = lowest(grams, window - GRAM + 1)
    anchor = grams[place]
    fresh = np.flatnonzero(np.concatenate([[True], anchor[1:] != anchor[:-1]]))
    ends = np.concatenate([fresh[1:], [n]])
    if (ends - fresh).max() > LONGEST:  # a text that repeats itself: cut what would be one endless run
        fresh = np.concatenate([np.arange(a, b, LONGEST) for a, b in zip(fresh, ends, strict=True)])
        ends = np.concatenate([fresh[1:], [n]])
    size = ends - fresh
    at = np.arange(n + window - 1, dtype=np.uint64)
    # Content: the sum of the words times powers of an odd number, shifted to the run's start by its inverse power.
    powers = np.cumprod(np.full(len(at), 0x9E3779B97F4A7C15, np.uint64)) if len(at) else at
    inverse = np.cumprod(np.full(len(at), pow(0x9E3779B97F4A7C15, -1, 1 << 64), np.uint64)) if len(at) else at
    total = np.concatenate([np.zeros(1, np.uint64), np.cumsum(mix(h) * powers)])
    content = mix((total[ends + window - 1] - total[fresh]) * inverse[fresh] + size.astype(np.uint64))
    return anchor[fresh].view(np.int64), content.view(np.int64), fresh, size, place[fresh] != place[ends - 1]


def _runs(docs: DataFrame) -> DataFrame:
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        words = Words()
        for b in batches:
            parts = [anchored(words((t or "").encode().split())) for t in b["text"]]
            ids = np.repeat(b["doc_id"].to_numpy(), [len(p[0]) for p in parts])
            cols = [np.concatenate([p[k] for p in parts]) if parts else np.zeros(0, np.int64) for k in range(5)]
            yield pd.DataFrame(dict(zip(("anchor", "content", "start", "n", "again"), cols, strict=True)) | {"doc_id": ids})

    return docs.mapInPandas(run, "anchor long, content long, start int, n int, again boolean, doc_id long")


PIECES = "doc_id long, start int, shard int, words binary"
REPORT = "doc_id long, at int, to int"


def _cut(docs: DataFrame, wanted: DataFrame) -> DataFrame:
    """Wanted runs (doc_id, start, n, shard) as PIECES with their word hashes, fetched from the texts."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        words = Words()
        for b in batches:
            rows = []
            for doc_id, text, parts in zip(b["doc_id"], b["text"], b["parts"], strict=True):
                h = words(text.encode().split())
                rows += [(doc_id, p["start"], p["shard"], h[p["start"] : p["start"] + p["n"] + WINDOW - 1].tobytes()) for p in parts]
            yield pd.DataFrame(rows, columns=[c.split()[0] for c in PIECES.split(", ")])

    by = wanted.groupBy("doc_id").agg(F.collect_list(F.struct("start", "n", "shard")).alias("parts"))
    return docs.join(by.hint("merge"), "doc_id").mapInPandas(run, PIECES)


def _stretches(hit: np.ndarray, part: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """First and last place of each stretch of neighbouring hits that lie in one part; part numbers the places."""
    at = np.flatnonzero(hit)
    if not len(at):
        return at, at
    new = np.concatenate([[True], (np.diff(at) > 1) | (np.diff(part[at]) != 0)])
    return at[new], at[np.append(new[1:], True)]


def _searched(rows: pd.DataFrame) -> pd.DataFrame:
    """One shard: build the index of its runs, stream them, and report the stretches of each that also start earlier."""
    rows = rows.assign(size=rows["words"].map(len)).sort_values(["doc_id", "start", "size"], ignore_index=True)
    parts = [np.frombuffer(w, np.uint64) for w in rows["words"]]
    flat, ids = np.unique(np.concatenate(parts), return_inverse=True)
    size = np.array([len(p) for p in parts])
    edges = np.concatenate([[0], np.cumsum(size)])
    symbols = [ids[a:b] + 1 for a, b in zip(edges, edges[1:], strict=False)]
    document = pd.factorize(rows["doc_id"], sort=True)[0].astype(np.int64)
    base = (document << 32) + rows["start"].to_numpy()
    order = np.concatenate([x + np.arange(n + 1) for x, n in zip(base, size, strict=True)])
    index = FMIndex(np.concatenate([np.append(s, 0) for s in symbols]), order, WINDOW)
    first = np.concatenate(index.stream(symbols))
    # All places of the shard at once: the piece that each lies in, and its order.
    piece = np.repeat(np.arange(len(parts)), size)
    own = base[piece] + np.arange(len(first)) - edges[piece]
    a, z = _stretches((first >= 0) & (first < own), piece)
    return pd.DataFrame({"doc_id": rows["doc_id"].to_numpy()[piece[a]], "at": own[a] & 0xFFFFFFFF, "to": (own[z] & 0xFFFFFFFF) + WINDOW})


def _windows(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """The single windows of runs, known by two hashes of their words."""
    for b in batches:
        words = [np.frombuffer(w, np.uint64) for w in b["words"]]
        size = [max(0, len(w) - WINDOW + 1) for w in words]
        at = np.repeat(b["start"].to_numpy(), size) + np.concatenate([np.arange(n) for n in size] or [np.zeros(0, np.int64)])
        both = [np.concatenate([runs(f(w), WINDOW) for w in words] or [np.zeros(0, np.uint64)]).view(np.int64) for f in (lambda w: w, mix)]
        yield pd.DataFrame({"a": both[0], "b": both[1], "doc_id": np.repeat(b["doc_id"].to_numpy(), size), "start": at})


def repeated(docs: DataFrame, own: Scratch) -> DataFrame:
    """(doc_id, at, to): stretches of words, end exclusive, that windows which also start earlier cover. They may overlap."""
    bounded_batches(docs.sparkSession)
    docs = docs.select("doc_id", "text").where("doc_id is not null and text is not null")
    all_ = materialise(_runs(docs), "runs")
    live = all_.groupBy("anchor").agg(F.count("*").alias("k"), F.bool_or("again").alias("again")).where("k > 1 or again")
    some = materialise(all_.join(materialise(live.select("anchor"), "anchors"), "anchor"), "live")
    own.drop(all_)
    text = ["anchor", "content", "n"]
    first = materialise(some.groupBy(*text).agg(F.min(F.struct("doc_id", "start")).alias("f"), F.count("*").alias("c"), F.bool_or("again").alias("again")), "classes")
    kinds = materialise(first.groupBy("anchor").agg(F.count("*").alias("k"), F.bool_or("again").alias("may")).where("k > 1 or may"), "kinds")

    # The runs that can meet another class, or themselves. Shards hold whole anchors.
    known = first.join(kinds, "anchor").select("anchor", "n", "f.doc_id", "f.start", (F.col("k") > HOT).alias("hot"))
    total = known.where("not hot").agg(F.coalesce(F.sum(F.col("n") + WINDOW), F.lit(0))).first()[0]
    shard = F.pmod(F.xxhash64("anchor"), F.lit(max(1, -(-total // SHARD_WORDS)))).cast("int")
    cut = materialise(_cut(docs, known.select("doc_id", "start", "n", F.when(F.col("hot"), -1).otherwise(shard).alias("shard"))), "cut")
    searched = cut.where("shard >= 0").groupBy("shard").applyInPandas(_searched, REPORT)

    single = materialise(cut.where("shard < 0").mapInPandas(_windows, "a long, b long, doc_id long, start int"), "windows")
    early = materialise(single.groupBy("a", "b").agg(F.min(F.struct("doc_id", "start")).alias("f"), F.count("*").alias("c")).where("c > 1"), "windows-again")
    later = lambda rows, classes, on, n: rows.join(classes.where("c > 1").select(*on, "f"), on).where("not (doc_id = f.doc_id and start = f.start)").select("doc_id", F.col("start").alias("at"), (F.col("start") + n).alias("to"))
    # Of a class all runs but the first go, whole.
    return searched.unionByName(later(single, early, ["a", "b"], F.lit(WINDOW))).unionByName(later(some, first, text, F.col("n") + WINDOW - 1))


def deduplicate(docs: DataFrame) -> DataFrame:
    """docs (doc_id, text) with n_words, n_removed, kept_sha256 and kept, the words that stay joined by spaces."""
    with scratch(docs.sparkSession) as own:
        spans = own.keep(materialise(repeated(docs, own).groupBy("doc_id").agg(F.collect_list(F.struct("at", "to")).alias("spans")), "spans"))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            rows = []
            for doc_id, text, found in zip(b["doc_id"], b["text"], b["spans"], strict=True):
                words = (text or "").encode().split()
                kept = words
                if found is not None and len(found):
                    gone = np.zeros(len(words) + 1, np.int64)
                    np.add.at(gone, [s["at"] for s in found], 1)
                    np.add.at(gone, [s["to"] for s in found], -1)
                    kept = [w for w, g in zip(words, np.cumsum(gone).tolist(), strict=False) if not g]
                text = b" ".join(kept)
                rows.append((doc_id, len(words), len(words) - len(kept), hashlib.sha256(text).hexdigest(), text.decode()))
            yield pd.DataFrame(rows, columns=["doc_id", "n_words", "n_removed", "kept_sha256", "kept"]).astype({"doc_id": "Int64"})

    return docs.select("doc_id", "text").join(spans.hint("merge"), "doc_id", "left").select("doc_id", "text", "spans").mapInPandas(run, "doc_id long, n_words long, n_removed long, kept_sha256 string, kept string")
