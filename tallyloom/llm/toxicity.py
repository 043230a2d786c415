"""Toxicity: a word classifier fitted with a counterfactual penalty.

A logistic regression over words and their beginnings, hashed into a fixed width, so no word is left out for its rank. Where a
labelled text holds identity terms, each is swapped for every other of its row, and the squared change of the logit is
penalised, so that a neutral mention of a group cannot carry a score. A table may hold no term at all while its words share stems and
hash places with some: so every pair of neighbours in a row is also swapped in a sentence of its own. The model tells how many swaps
of texts there were, and the largest change of a score by any. The classes weigh the same in the fit, however rare
toxic texts are, so 0.5 is where the evidence turns.

The fit takes at most `SAMPLE` labelled documents (a bounded, documented sample: the first by hash of the id), whose ids
alone are broadcast, so no text is shuffled. Spark counts their words; the model is fitted on the driver from sparse counts of the
hash places that tell the classes apart.

Edge cases: null and empty texts get the score of a text without any known word; labels that are null are no labels; if
only one class is labelled the score is that class's smoothed share; repeated rows are scored each.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tallyloom.session import bounded_batches, materialise

SAMPLE, WIDTH, PENALTY, RIDGE, STEPS = 20_000, 1 << 18, 5.0, 1e-3, 300
#: A hash place takes part if the documents that have it differ from the classes' shares by so many standard errors.
SIGNIFICANT = 4.0
#: Beginnings of so many letters count as words of their own: a stem tells what its inflected and compounded forms do not.
STEMS = (4, 6)
#: Words whose places a worker remembers.
REMEMBERED = 1 << 17
_WORD = re.compile(r"[^\W\d_]+")

# Identity terms as families. A family's stems with one ending are a row, and words of one row may stand for each other; a word that
# several families have belongs to the first.
FAMILIES = (
    ("woman man girl boy person", ""),
    ("women men girls boys people", ""),
    ("mother father", "|s"),
    ("wife husband", ""),
    ("muslim christian jew hindu buddhist atheist sikh", "|s"),
    ("jewish islamic catholic protestant orthodox", ""),
    ("black white brown", "|s"),
    ("asian african european american indian arab latino", "|s"),
    ("turkish polish german french spanish romanian mexican chinese", ""),
    ("gay straight lesbian bisexual transgender queer", ""),
    ("immigrant refugee citizen foreigner migrant", "|s"),
    ("disabled blind deaf autistic", ""),
    ("frau mann", ""),
    ("frauen männer mädchen jungen", ""),
    ("muslim christ jude hindu", ""),
    ("muslime christen juden hindus", ""),
    ("muslimin christin jüdin", "|nen"),
    ("muslimisch christlich jüdisch hinduistisch buddhistisch", "|e|er|es|en|em"),
    ("türkisch polnisch deutsch französisch spanisch arabisch afrikanisch europäisch", "|e|er|es|en|em"),
    ("schwarz weiß", "|e|er|es|en|em"),
    ("homosexuell heterosexuell bisexuell transsexuell", "|e|er|es|en|em"),
    ("ausländer bürger", "|n"),
    ("migranten flüchtlinge", ""),
    ("femme homme fille garçon", "|s"),
    ("musulman africain américain mexicain allemand", "|e|s|es"),
    ("chrétien indien italien européen", "|ne|s|nes"),
    ("juif musulman chrétien", "|s"),
    ("juive musulmane chrétienne", "|s"),
    ("étranger réfugié immigré", "|s"),
    ("étrangère réfugiée immigrée", "|s"),
    ("noir blanc", "|s"),
    ("noire blanche", "|s"),
    ("mujer hombre", ""),
    ("mujeres hombres", ""),
    ("niñ", "o|a|os|as"),
    ("judí cristian african american mexican", "o|a|os|as"),
    ("musulmán cristiano judío", ""),
    ("musulmana cristiana judía", "|s"),
    ("musulmanes cristianos judíos", ""),
    ("negr blanc", "o|a|os|as"),
    ("extranjer refugiad", "o|a|os|as"),
)


def _rows() -> list[tuple[str, ...]]:
    """The rows of all families; what differs by gender alone in one family is one row too."""
    out = [tuple(s + e for s in stems.split()) for stems, endings in FAMILIES for e in endings.split("|")]
    out += [tuple(f"niñ{e}{n}" for e in "oa") for n in ("", "s")]
    return [row for row in out if len(row) > 1]


IDENTITY = _rows()
ROW: dict[str, tuple[str, ...]] = {}
for _row in IDENTITY:
    for _w in _row:
        ROW.setdefault(_w, _row)
#: Where a text holds identity terms, as many swapped copies as the longest row has other terms.
SWAPS = max(map(len, IDENTITY)) - 1


def tokens(text: str | None) -> list[str]:
    return _WORD.findall((text or "").lower())


def places(word: str) -> list[int]:
    """The hash places of a word and its stems."""
    return [xxhash.xxh64_intdigest(x) % WIDTH for x in (word, *(f"{word[:k]}*" for k in STEMS if len(word) > k))]


def counted(words: Counter[str]) -> Counter[int]:
    out: Counter[int] = Counter()
    for w, c in words.items():
        for p in places(w):
            out[p] += c
    return out


def swapped(words: Counter[str], by: int) -> Counter[str] | None:
    """The words with every identity term replaced by the term that many places on in its row; None where nothing changes."""
    out, changed = Counter(words), False
    for w in [w for w in words if w in ROW]:
        row = ROW[w]
        other = row[(row.index(w) + by) % len(row)]
        if other != w:
            out[w] -= words[w]
            out[other] += words[w]
            changed = True
    return out if changed else None


@dataclass
class Model:
    """A bias and the weights of hash places; how many swapped copies of texts the fit had, and the largest change of a score by a swap."""

    bias: float
    weights: dict[int, float] = field(default_factory=dict)
    swaps: int = 0
    gap: float = 0.0
    known: dict[str, list[int]] = field(default_factory=dict, repr=False)

    def __getstate__(self) -> tuple:
        return self.bias, self.weights, self.swaps, self.gap

    def __setstate__(self, state: tuple) -> None:
        self.bias, self.weights, self.swaps, self.gap = state
        self.known = {}

    def score(self, text: str | None) -> float:
        known, weights = self.known, self.weights
        if len(known) > REMEMBERED:
            known.clear()
        found: Counter[int] = Counter()
        for w, c in Counter(tokens(text)).items():
            at = known.get(w)
            if at is None:
                at = known[w] = [p for p in places(w) if p in weights] or _NONE
            for p in at:
                found[p] += c
        z = self.bias + sum(weights[p] * np.log1p(c) for p, c in found.items())
        return float(1 / (1 + np.exp(-np.clip(z, -30, 30))))


_NONE: list[int] = []
_COUNTS = "y int, at array<int>, n array<int>, swaps array<struct<at:array<int>,d:array<double>>>"


def counts(labelled: DataFrame) -> DataFrame:
    """The hash places of labelled texts with their counts, and what each swap of identity terms changes (in log counts)."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            rows = []
            for text, y in zip(b["text"], b["toxic"], strict=True):
                words = Counter(tokens(text))
                own, swaps = counted(words), []
                for by in range(1, SWAPS + 1) if any(w in ROW for w in words) else ():
                    other = swapped(words, by)
                    if other is not None:
                        new = counted(other)
                        change = {p: np.log1p(max(0, new[p])) - np.log1p(own[p]) for p in set(own) | set(new) if new[p] != own[p]}
                        swaps.append({"at": list(change), "d": list(change.values())})
                rows.append((int(y), list(own), list(own.values()), swaps))
            yield pd.DataFrame(rows, columns=["y", "at", "n", "swaps"])

    return labelled.select("text", "toxic").mapInPandas(run, _COUNTS)


def telling(rows: DataFrame, n: int, toxic: int) -> list[int]:
    """The hash places whose documents differ most from the classes' shares, and those that swaps change; at most WIDTH."""
    at = rows.select("y", F.explode("at").alias("p")).groupBy("p").agg(F.sum("y").alias("a"), F.count("*").alias("k"))
    share, p = F.col("k") / n, toxic / n
    z = (F.col("a") - F.col("k") * p) / F.sqrt(F.col("k") * p * (1 - p) * F.greatest(1 - share, F.lit(1e-6)))
    swaps = rows.select(F.explode("swaps").alias("s")).select(F.explode("s.at").alias("p")).distinct()
    return sorted(r[0] for r in at.where(F.abs(z) >= SIGNIFICANT).select("p").unionByName(swaps).distinct().collect())


def bare_swaps(index: dict[int, int]) -> list[tuple[list[int], list[float]]]:
    """What it changes to put a term for its neighbour in a row, where no other word stands: places of the index and changes of log counts."""
    out = []
    for row in IDENTITY:
        for a, b in zip(row, row[1:] + row[:1], strict=True):
            own, new = counted(Counter([a])), counted(Counter([b]))
            change = {index[p]: np.log1p(new[p]) - np.log1p(own[p]) for p in set(own) | set(new) if new[p] != own[p] and p in index}
            if change:
                out.append((list(change), list(change.values())))
    return out


def fit(labelled: DataFrame, penalty: float = PENALTY, ridge: float = RIDGE) -> Model:
    """labelled: text, toxic (0 or 1)."""
    bounded_batches(labelled.sparkSession)
    rows = materialise(counts(labelled), "toxic-counts")
    n, toxic = rows.agg(F.count("*"), F.coalesce(F.sum("y"), F.lit(0))).first()
    places_ = telling(rows, n, toxic) if 0 < toxic < n else []
    if not places_:
        return Model(float(np.log((toxic + 1) / (n - toxic + 1))))
    index = {p: i for i, p in enumerate(places_)}

    def kept(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            out = []
            for y, at, n, swaps in zip(b["y"], b["at"], b["n"], b["swaps"], strict=True):
                own = [(index[p], np.log1p(c)) for p, c in zip(at, n, strict=True) if p in index]
                other = [(k, index[p], d) for k, s in enumerate(swaps) for p, d in zip(s["at"], s["d"], strict=True)]
                out.append((y, _packed(own, 0), _packed(own, 1), len(swaps), _packed(other, 0), _packed(other, 1), _packed(other, 2)))
            yield pd.DataFrame(out, columns=["y", "i", "x", "m", "k", "j", "d"])

    found = rows.mapInPandas(kept, "y int, i binary, x binary, m int, k binary, j binary, d binary").collect()
    join = lambda c: np.concatenate([np.frombuffer(r[c], float) for r in found])
    size = lambda c: [len(r[c]) // 8 for r in found]
    y = np.array([r["y"] for r in found], float)
    doc, at, x = np.repeat(np.arange(n), size("i")), join("i").astype(int), join("x")
    # Each swapped copy is a row of changes; the copies of a document share its weight.
    m = np.array([r["m"] for r in found])
    first = np.concatenate([[0], np.cumsum(m)])
    copy = np.repeat(first[:-1], size("k")) + join("k").astype(int)
    to, change, share = join("j").astype(int), join("d"), np.repeat(1 / np.maximum(m, 1), m)
    bare = bare_swaps(index)
    copy = np.concatenate([copy, first[-1] + np.repeat(np.arange(len(bare)), [len(i) for i, _ in bare])]).astype(int)
    to = np.concatenate([to, *[i for i, _ in bare]]).astype(int)
    change = np.concatenate([change, *[d for _, d in bare]])
    share = np.concatenate([share, np.full(len(bare), n / max(1, len(bare)))])  # all of them together weigh as much as all texts
    copies = int(first[-1]) + len(bare)
    weight = np.where(y == 1, n / (2 * toxic), n / (2 * (n - toxic))) / n
    w, bias = np.zeros(len(places_)), 0.0
    mw, vw, mb, vb = np.zeros_like(w), np.zeros_like(w), 0.0, 0.0
    for t in range(1, STEPS + 1):  # Adam on the whole sample
        z = np.bincount(doc, x * w[at], n) + bias
        g = weight * (1 / (1 + np.exp(-np.clip(z, -30, 30))) - y)
        gap = 2 * penalty / n * share * np.bincount(copy, change * w[to], copies) if copies else np.zeros(0)
        gw, gb = np.bincount(at, x * g[doc], len(w)) + ridge * w, g.sum()
        if copies:
            gw += np.bincount(to, change * gap[copy], len(w))
        mw, vw = 0.9 * mw + 0.1 * gw, 0.999 * vw + 0.001 * gw**2
        mb, vb = 0.9 * mb + 0.1 * gb, 0.999 * vb + 0.001 * gb**2
        step = 0.1 * np.sqrt(1 - 0.999**t) / (1 - 0.9**t)
        w, bias = w - step * mw / (np.sqrt(vw) + 1e-8), bias - step * mb / (np.sqrt(vb) + 1e-8)
    z = np.concatenate([np.repeat(np.bincount(doc, x * w[at], n), m), np.zeros(len(bare))]) + bias
    score = lambda z: 1 / (1 + np.exp(-np.clip(z, -30, 30)))
    moved = np.abs(score(z + np.bincount(copy, change * w[to], copies)) - score(z)) if copies else np.zeros(1)
    return Model(float(bias), {p: float(v) for p, v in zip(places_, w, strict=True) if v}, int(first[-1]), float(moved.max(initial=0)))


def _packed(rows: list[tuple], c: int) -> bytes:
    """One column of rows as doubles."""
    return np.array([r[c] for r in rows], float).tobytes()


def scored(model: Model, text: Column) -> Column:
    @F.pandas_udf(T.DoubleType())
    def run(texts: pd.Series) -> pd.Series:
        return texts.map(model.score, na_action=None)

    return run(text)


def labelled(docs: DataFrame, labels: DataFrame, train: Column, sample: int = SAMPLE) -> DataFrame:
    """text and label of at most `sample` labelled documents whose id meets a condition."""
    y = labels.where(F.col("toxic").isin(0, 1) & F.col("doc_id").isNotNull() & train).groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    few = y.orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample)
    return docs.select("doc_id", "text").join(F.broadcast(few), "doc_id").select("text", "toxic")


def reject(docs: DataFrame, model: Model, threshold: float = 0.5) -> DataFrame:
    """docs without those that score at least the threshold."""
    return docs.where(scored(model, F.col("text")) < threshold)
