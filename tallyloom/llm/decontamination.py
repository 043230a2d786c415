"""Benchmark decontamination by template windows.

Words become templates: numbers, units and names give way to typed placeholders, everything else is lower-cased and
stripped of punctuation. Windows of `WIDTH` template words of benchmark items are hash-joined with those of documents. A
bitmap of the benchmark's window hashes, at most `BITS` bits, keeps windows that cannot match out of the join. On each
diagonal (a document, an item and the distance between their positions) the placeholders should be filled consistently: a value of
the item stands for one value of the document. Consistent diagonals count as contamination from `LEAST` windows on, or three
fifths of the windows of a shorter item. Where a value of the item stands for several, the windows that are verbatim or go by the
most frequent one count too, and all together settle it from `MIXED` on; a shorter item with two values for a slot is another item.

Edge cases: null and empty texts match nothing; items of fewer than `SHORTEST` words can't be told from chance inside a
text and match texts that are nothing else, word for word; items shorter than a window are one window of their own width; windows with fewer than `PLAIN` plain words match
with the same slot values only, so the threshold of a reworded item goes by its other windows, a third of all at least; repeated rows of an id are one document; an empty table gives no rows.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tallyloom.llm.hashing import runs
from tallyloom.session import bounded_batches, materialise

WIDTH, LEAST, SHORTEST, PLAIN, BITS, RANGE = 8, 6, 5, 4, 1 << 26, 8192
#: Keeps hashes of windows with their slot values apart from those of templates.
EXACT = np.uint64(0x9E3779B97F4A7C15)
#: Windows that settle it where a slot has two values: a text of 23 words or more.
MIXED = 2 * WIDTH
#: Units that a number may carry.
UNITS = frozenset(
    "mm cm m km in ft yd mi mg g kg t lb oz ml l s sec min h hr hrs hours minutes seconds days weeks years miles meters metres "
    "kilometers kilometres grams kilograms pounds dollars euros cents percent % $ € £ °c °f kmh mph w kw v".split()
)
_EDGE = re.compile(r"^\W+|\W+$")
_NUMBER = re.compile(r"\d")


def template(word: str) -> tuple[str, str] | None:
    """(template, slot value or ''); None for bare punctuation other than a unit sign."""
    if word in UNITS:
        return "<unit>", word
    w = word
    if not word.isalpha():  # letters alone have no edges to strip and no digits
        w = _EDGE.sub("", word)
        if not w:
            return None
        if _NUMBER.search(w):
            return "<number>", w
    low = w.lower()
    if low in UNITS and len(low) > 1:
        return "<unit>", low
    if w[0].isupper() and w[1:].islower():
        return "<name>", low
    return low, ""


class Templates(dict):
    """Numbers of words (-1: none), learnt when first asked for; hashes and slot values lie in arrays by number. Forgotten beyond a bound."""

    def __init__(self, most: int = 1 << 18):
        super().__init__()
        self.most = most
        self.forget()

    def forget(self) -> None:
        self.clear()
        self.slots: list[str] = []
        self.hashes, self.exact, self.filled = np.zeros(1 << 14, np.uint64), np.zeros(1 << 14, np.uint64), np.zeros(1 << 14, np.int64)

    def __missing__(self, word: bytes) -> int:
        found = template(word.decode())
        if not found:
            self[word] = -1
            return -1
        k = self[word] = len(self.slots)
        if k == len(self.hashes):
            self.hashes, self.exact, self.filled = (np.concatenate([x, np.zeros_like(x)]) for x in (self.hashes, self.exact, self.filled))
        what, value = found
        self.slots.append(value)
        self.hashes[k] = xxhash.xxh64_intdigest(what)
        self.exact[k] = xxhash.xxh64_intdigest(f"{what}\0{value}") if value else self.hashes[k]
        self.filled[k] = bool(value)
        return k

    def __call__(self, text: str | None) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Template hash, whether it is a slot, exact hash and number of each word of a text; slots has the value of a number."""
        if len(self) > self.most:
            self.forget()
        words = (text or "").encode().split()  # bytes split at the six ASCII white-space characters alone
        at = np.fromiter(map(self.__getitem__, words), np.int64, len(words))
        at = at[at >= 0]
        return self.hashes[at], self.filled[at], self.exact[at], at


def windows(h: np.ndarray, slot: np.ndarray, exact: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Hash of each window of a width, and whether it has enough plain words; without these the hash is of templates and slot values."""
    got = runs(h, width)
    if not len(got):
        return got, np.zeros(0, bool)
    total = np.concatenate([[0], np.cumsum(slot)])
    plain = (width - (total[width:] - total[:-width]) >= min(PLAIN, width - 1)) & (width >= SHORTEST)
    few = np.flatnonzero(~plain)
    if len(few):
        got[few] = runs(exact[few[:, None] + np.arange(width)], width, 1)[:, 0] ^ EXACT
    return got, plain


def _emit(key: str, widths: list[int] | None, bits: np.ndarray | None):
    """Rows (key, pos, width, hash, slots) of windows; of items all, of documents those that the bitmap lets through."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        templates = Templates()
        for b in batches:
            rows = []
            for i, text in zip(b[key], b["text"], strict=True):
                h, slot, exact, word = templates(text)
                for width in [min(WIDTH, len(h))] if widths is None else widths:
                    if not width or (widths is not None and width < SHORTEST and len(h) != width):
                        continue
                    got, plain = windows(h, slot, exact, width)
                    kept = np.ones(len(got), bool)
                    if bits is not None and len(got):
                        at = got % np.uint64(len(bits) * 8)
                        kept = ((bits[at >> np.uint64(3)] >> (at & np.uint64(7)).astype(np.uint8)) & 1).astype(bool)
                    n, n_plain = len(got), int(plain.sum())
                    rows += [(i, int(p), width, int(got[p].view(np.int64)), [templates.slots[x] for x in word[p : p + width]], bool(plain[p]), n, n_plain) for p in np.flatnonzero(kept)]
            yield pd.DataFrame(rows, columns=[key, "pos", "width", "h", "slots", "plain", "n", "n_plain"])

    return run


def bitmap(items: DataFrame) -> np.ndarray:
    """The bits of all window hashes of the benchmark; its size is bounded by BITS, and Spark packs `RANGE` bytes of it into one binary."""
    size = int(min(BITS, max(1 << 16, 1 << int(np.ceil(np.log2(64 * max(1, items.count())))))))
    bits = np.zeros(size // 8, np.uint8)

    def packed(rows: pd.DataFrame) -> pd.DataFrame:
        part = np.zeros(RANGE, np.uint8)
        part[rows["byte"].to_numpy() % RANGE] = rows["bit"].to_numpy()
        return pd.DataFrame({"range": rows["range"].iloc[:1], "bytes": [part.tobytes()]})

    # The size is a power of two: signed hashes give the same remainders.
    at = items.select(F.pmod(F.col("h"), F.lit(size)).alias("at")).select(F.expr("int(at div 8)").alias("byte"), F.expr("shiftleft(1, int(at % 8))").alias("bit"))
    by = at.groupBy("byte").agg(F.bit_or("bit").alias("bit")).withColumn("range", F.expr(f"int(byte div {RANGE})"))
    for range_, part in by.groupBy("range").applyInPandas(packed, "range int, bytes binary").toLocalIterator():
        bits[range_ * RANGE : (range_ + 1) * RANGE] = np.frombuffer(part, np.uint8)
    return bits


@F.pandas_udf(T.LongType())
def contradicting(w: pd.Series) -> pd.Series:
    """How many windows of a diagonal, given as (at, pairs of slots), are neither verbatim nor as the most frequent value of each slot has it."""

    def count(found) -> int:
        if found is None:
            return 0
        places = {(p["i"], p["x"], p["y"]) for one in found for p in one["p"]}
        seen = Counter((x, y) for _, x, y in places)
        bound: dict[str, str] = {}
        for x, y in sorted(seen, key=lambda k: (seen[k], k[0] == k[1], k[1])):
            bound[x] = y
        fits = {one["at"] for one in found if all(p["x"] == p["y"] for p in one["p"]) or all(bound[p["x"]] == p["y"] for p in one["p"])}
        return len({one["at"] for one in found}) - len(fits)

    return w.map(count, na_action=None).astype("int64")


def contaminated(docs: DataFrame, benchmark: DataFrame, least: int = LEAST) -> DataFrame:
    """The documents with leaked items: doc_id, contaminated, n_items, item_ids (text), n_windows, reworded."""
    bounded_batches(docs.sparkSession)
    schema = "pos int, width int, h long, slots array<string>, plain boolean, n int, n_plain int"
    items = materialise(benchmark.select("item_id", "text").mapInPandas(_emit("item_id", None, None), f"item_id long, {schema}"), "items")
    widths = sorted(r[0] for r in items.select("width").distinct().collect())
    bits = docs.sparkSession.sparkContext.broadcast(bitmap(items))

    def found(batches):
        yield from _emit("doc_id", widths, bits.value)(batches)

    here = docs.where(F.col("doc_id").isNotNull()).select("doc_id", "text").mapInPandas(found, f"doc_id long, {schema}").drop("plain", "n", "n_plain")
    there = items.select("item_id", F.col("pos").alias("at"), "width", "h", F.col("slots").alias("filled"), "plain", "n", "n_plain")
    hits = here.join(there, ["h", "width"])
    # One row for each filled slot of a hit, so that consistency is a matter of distinct counts.
    pairs = F.filter(F.transform("filled", lambda x, i: F.struct((F.col("at") + i).alias("i"), x.alias("x"), F.get("slots", i).alias("y"))), lambda p: p["x"] != "")
    diagonal = hits.select("doc_id", "item_id", (F.col("pos") - F.col("at")).alias("shift"), "at", "plain", "n", "n_plain", pairs.alias("p"))
    filled = F.when(F.size("p") > 0, F.struct("at", "p"))
    by = diagonal.groupBy("doc_id", "item_id", "shift").agg(F.count_distinct("at").alias("windows"), F.count_distinct(F.when(F.col("plain"), F.col("at"))).alias("plain"), F.max("n").alias("n"), F.max("n_plain").alias("n_plain"), F.collect_set(filled).alias("w"))
    by = by.withColumn("p", F.array_distinct(F.flatten(F.transform("w", lambda w: F.transform(w["p"], lambda p: F.struct(p["x"], p["y"]))))))
    clash = F.size(F.array_distinct(F.transform("p", lambda p: p["x"]))) < F.size("p")
    good = by.select("doc_id", "item_id", "n", "n_plain", "windows", "plain", clash.alias("clash"), F.exists("p", lambda p: p["x"] != p["y"]).alias("changed"), contradicting(F.when(clash, F.col("w"))).alias("against"))
    pair = good.groupBy("doc_id", "item_id").agg(
        F.sum(F.when(F.col("clash"), 0).otherwise(F.col("windows"))).alias("agreed"),
        F.sum(F.when(F.col("clash"), 0).otherwise(F.col("plain"))).alias("plain"),
        F.sum(F.col("windows") - F.col("against")).alias("windows"),
        F.max("n").alias("n"),
        F.max("n_plain").alias("n_plain"),
        F.max("changed").alias("changed"),
    )
    share = lambda n: F.floor(F.col(n) * 0.6)
    # Of a reworded item only plain windows can match; they must still be a third of it.
    whole, reworded = F.least(F.lit(least), F.greatest(F.lit(1), share("n"))), F.least(F.lit(least), F.greatest(F.lit(1), share("n_plain"), F.ceil(F.col("n") / 3)))
    leaked = pair.where((F.col("agreed") >= whole) | (F.col("plain") >= reworded) | (F.col("windows") >= MIXED))
    return leaked.groupBy("doc_id").agg(
        F.lit(True).alias("contaminated"),
        F.count("*").alias("n_items"),
        F.array_join(F.transform(F.sort_array(F.collect_set("item_id")), lambda i: i.cast("string")), ",").alias("item_ids"),
        F.sum("windows").alias("n_windows"),
        F.bool_or("changed").alias("reworded"),
    )


def remove(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """docs without the contaminated documents."""
    bad = contaminated(docs, benchmark).select(F.col("doc_id").alias("__bad"))
    return docs.join(bad, docs["doc_id"] == F.col("__bad"), "left_anti")
