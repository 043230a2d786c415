"""Packing by multiway differencing.

Documents become token ids in one pass; each is cut into full windows, which need no packing, and a rest of at most
`PIECE` ids at a time. The rests are dealt by a hash of the document into groups of bounded size, so that no task ever holds more than a
group; in each group Karmarkar-Karp differencing merges partial partitions, largest imbalance first, the heaviest part of
one with the lightest of the other, and the number of windows rises by one whenever a window exceeds the capacity.

Edge cases: a null text counts as empty, whose one token is the end id; repeated rows are packed each on their own;
an empty table gives no pieces.
"""

from __future__ import annotations

import heapq
import json
import re
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyloom.session import bounded_batches, materialise

WINDOW, PIECE, END = 2048, 512, 1
#: Pieces in a group, on average: enough for the sums to meet closely, few enough for a task.
GROUP = 256
#: Distinct words whose ids a worker remembers, the first that it meets: some 25 MB at most.
REMEMBERED = 1 << 17
_AFTER = re.compile(r" (?:\s|\Z)")
_ALONE = re.compile(r"\s \s|\s \Z|\A \s|\A \Z")

PIECES = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long"


class Encoder:
    """Texts to little-endian 32-bit ids, as `tokenizers` encodes them, remembering words.

    The vocabulary's pattern never joins text across a space that follows or precedes a character other than white
    space, so a text is the sum of its space-separated words, each with the space before it; texts with other runs of white
    space around spaces, or with the text of a special token, are encoded whole.
    """

    def __init__(self, vocabulary: str, remembered: int = REMEMBERED):
        with open(vocabulary, encoding="utf-8") as f:
            told = json.load(f)
        self.vocabulary, self.remembered = vocabulary, remembered
        self.special = [t["content"] for t in told.get("added_tokens", [])]
        self.words: dict[str, bytes] = {}
        self.fast = self._merges(told["model"]["vocab"])
        self.tokenizer = None

    def _merges(self, vocab: dict[str, int]):
        """The vocabulary's merges in tiktoken's faster encoder. A byte is written as a visible character, hidden ones from 256 on."""
        import public_tokenizers
        import tiktoken

        visible = [*range(33, 127), *range(161, 173), *range(174, 256)]
        hidden = [b for b in range(256) if b not in visible]
        byte = {chr(b): b for b in visible} | {chr(256 + i): b for i, b in enumerate(hidden)}
        ranks = {bytes(byte[c] for c in token): i for token, i in vocab.items() if token not in self.special}
        return tiktoken.Encoding("words", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={}).encode_ordinary

    def whole(self, text: str) -> bytes:
        """By the library itself, which is loaded for the first text that needs it."""
        if self.tokenizer is None:
            from tokenizers import Tokenizer

            self.tokenizer = Tokenizer.from_file(self.vocabulary)
        return _bytes(self.tokenizer.encode(text, add_special_tokens=False).ids)

    def __call__(self, text: str) -> bytes:
        if any(s in text for s in self.special):
            return self.whole(text)
        if _AFTER.search(text) and _ALONE.search(text):
            return _bytes(self.fast(text))
        known, parts = self.words, text.split(" ")
        out = list(map(known.get, parts))
        out[0] = _bytes(self.fast(parts[0]))
        if None in out:
            for i, w in enumerate(parts):
                if out[i] is None:
                    out[i] = _bytes(self.fast(" " + w))
                    if len(known) < self.remembered and len(w) < 40:
                        known[w] = out[i]
        return b"".join(out)


def _bytes(ids: list[int]) -> bytes:
    return np.asarray(ids, "<u4").tobytes()


def cuts(n: int, window: int, piece: int) -> list[tuple[int, int]]:
    """(start, length): full windows first, then the rest in pieces of nearly equal length, none over `piece`."""
    full = [(i, window) for i in range(0, n - window + 1, window)]
    at = len(full) * window
    k = -(-(n - at) // piece)
    edges = [at + (n - at) * i // k for i in range(k + 1)] if k else []
    return full + [(a, b - a) for a, b in zip(edges, edges[1:], strict=False)]


def tokenise(docs: DataFrame, vocabulary: str, window: int = WINDOW, piece: int = PIECE, end: int = END) -> DataFrame:
    """The pieces of all documents, with the CRC-32 of their ids."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        encode, last = Encoder(vocabulary), _bytes([end])
        for batch in batches:
            rows = []
            for doc_id, text in zip(batch["doc_id"], batch["text"], strict=True):
                ids = encode(text or "") + last
                n = len(ids) // 4
                rows += [(doc_id, at, k, zlib.crc32(ids[4 * at : 4 * (at + k)]), n) for at, k in cuts(n, window, piece)]
            yield pd.DataFrame(rows, columns=["doc_id", "start", "length", "ids_crc32", "doc_tokens"]).astype({"doc_id": "Int64"})

    return docs.select("doc_id", "text").mapInPandas(run, PIECES)


def differencing(sizes: list[int], m: int) -> list[list[int]]:
    """Indices in m parts of nearly equal sums, by the largest differencing method."""
    if not sizes:
        return [[] for _ in range(m)]
    heap, count = [], len(sizes)
    for i, size in enumerate(sizes):
        heap.append((-size, i, [(0, ())] * (m - 1) + [(size, (i,))]))
    heapq.heapify(heap)
    while len(heap) > 1:
        a, b = heapq.heappop(heap)[2], heapq.heappop(heap)[2]
        merged = sorted(((x[0] + y[0], (x[1], y[1])) for x, y in zip(a, reversed(b), strict=True)), key=lambda p: p[0])
        low = merged[0][0]
        heapq.heappush(heap, (-(merged[-1][0] - low), count, [(s - low, t) for s, t in merged]))
        count += 1
    return [_leaves(t) for _, t in heap[0][2]]


def _leaves(tree: tuple) -> list[int]:
    out, stack = [], [tree]
    while stack:
        t = stack.pop()
        for x in t if isinstance(t, tuple) else (t,):
            stack.append(x) if isinstance(x, tuple) else out.append(x)
    return out


def partition(sizes: list[int], capacity: int) -> list[list[int]]:
    """Near-equal parts, none over capacity; the count starts at the least possible and rises while one is exceeded."""
    m = max(1, -(-sum(sizes) // capacity))
    while True:
        parts = differencing(sizes, m)
        if max(sum(sizes[i] for i in p) for p in parts) <= capacity:
            return [p for p in parts if p]
        m += 1


def pack(docs: DataFrame, vocabulary: str, window: int = WINDOW, piece: int = PIECE, group: int = GROUP, end: int = END) -> DataFrame:
    """PIECES with sequence_id and offset. Sequence ids are unique, not dense: group number * 2^32 + number in the group."""
    bounded_batches(docs.sparkSession)
    # The row number is written with the pieces, so that equal rows are dealt over all groups and a repeated task deals them alike.
    pieces = materialise(tokenise(docs, vocabulary, window, piece, end).withColumn("row", F.monotonically_increasing_id()), "pieces")
    rests = pieces.where(F.col("length") < window)
    groups = max(1, -(-rests.count() // group))

    def place(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values(["length", "doc_id", "start"], ascending=[False, True, True], ignore_index=True)
        sequence, offset = [0] * len(rows), [0] * len(rows)
        sizes = rows["length"].tolist()
        for k, part in enumerate(partition(sizes, window)):
            at = 0
            for i in sorted(part):
                sequence[i], offset[i] = (int(key[0]) << 32) + k, at
                at += sizes[i]
        return rows.drop(columns="group").assign(sequence_id=sequence, offset=offset).astype({"doc_id": "Int64"})

    out = f"{PIECES}, sequence_id long, offset long"
    number = F.pmod(F.xxhash64("row"), F.lit(groups))
    placed = rests.withColumn("group", number).drop("row").groupBy("group").applyInPandas(place, out)
    full = pieces.where(F.col("length") == window).drop("row").withColumns({"sequence_id": F.monotonically_increasing_id() + (F.lit(groups).cast("long") * (1 << 32)), "offset": F.lit(0).cast("long")})
    return full.unionByName(placed)
