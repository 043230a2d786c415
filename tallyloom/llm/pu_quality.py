"""Quality classifier from positive and unlabelled documents.

Trusted positives (documents labelled good in the training folds) and unlabelled web text are described by shape
statistics; a first classifier of positives against unlabelled text ranks them, the class prior is estimated from that
ranking (best-bin estimate: the smallest ratio of unlabelled to positive mass above a cutoff, with a confidence term), and
a small network then minimises the non-negative unbiased risk. Negatives are never used.

The fit takes at most `POSITIVES` labelled documents, by hash of the id: a bounded, documented sample. Unlabelled text is all of
it: every document is described once and counted in the cell of the nearest of at most `CELLS` centres, and the cells, with
their counts and means, stand for all documents in the risk. Every document is scored over its whole text.

Edge cases: null and empty texts are described by zeros and scored like any other; no positives give the score 0.5 to all;
repeated rows are scored each.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tallyloom.session import bounded_batches, materialise

POSITIVES, CELLS = 8_000, 2048
HIDDEN, STEPS, RIDGE, SEED = 24, 600, 1e-4, 7
_SYMBOLS = b"#*$%&<>@^~=+_\\/"
_KEEP_UPPER = bytes(b for b in range(256) if not 65 <= b <= 90)
FEATURES = 14


def describe(text: str | None) -> list[float]:
    """Shape of a text, each number of order one. Ratios to the words, or to the bytes."""
    raw = (text or "").encode()
    w = raw.split()
    n, size = len(w), len(raw)
    if not n:
        return [0.0] * FEATURES
    lines = [x for x in raw.split(b"\n") if x.strip()]
    count = lambda chars: size - len(raw.translate(None, chars))
    words = Counter(w)
    three = Counter(zip(w, w[1:], w[2:], strict=False))
    again = sum(c for c in three.values() if c > 1)
    stutter = sum(map(bytes.__eq__, w, w[1:]))
    return [
        min(4.0, np.log1p(n) / 2),
        min(3.0, (size - count(b" \t\n\r\x0b\x0c")) / n / 6),
        min(2.0, count(_SYMBOLS) / n),
        min(2.0, count(b"|") / n),
        min(2.0, count(b"!?") / n),
        min(2.0, 3 * len(raw.translate(None, _KEEP_UPPER)) / size),
        min(2.0, 5 * count(b"0123456789") / size),
        min(2.0, 3 * count(b".,;:") / n),
        stutter / n,
        again / n,
        len(words) / n,
        1 - len(set(lines)) / max(1, len(lines)),
        min(2.0, len(lines) / n * 5),
        words.most_common(1)[0][1] / n,
    ]


@dataclass
class Net:
    """One hidden layer; mean and scale standardise the description."""

    mean: np.ndarray
    scale: np.ndarray
    w1: np.ndarray
    b1: np.ndarray
    w2: np.ndarray
    b2: float

    def logit(self, x: np.ndarray) -> np.ndarray:
        return np.tanh(((x - self.mean) / self.scale) @ self.w1 + self.b1) @ self.w2 + self.b2

    def score(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.logit(x), -30, 30)))


def _sigmoid(z: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(z, -30, 30)))


def train(p: np.ndarray, u: np.ndarray, weight: np.ndarray, prior: float | None, steps: int = STEPS) -> Net:
    """Adam on positives and on weighted rows of unlabelled text (weights sum to 1). With a prior: non-negative PU risk of the logistic loss; without: positives against unlabelled."""
    rng = np.random.default_rng(SEED)
    mean = weight @ u
    scale = np.sqrt(weight @ (u - mean) ** 2) + 1e-3
    net = Net(mean, scale, rng.normal(0, 0.4, (p.shape[1], HIDDEN)), np.zeros(HIDDEN), rng.normal(0, 0.2, HIDDEN), 0.0)
    xp, xu = (p - mean) / scale, (u - mean) / scale
    moments = [[0.0, 0.0] for _ in range(4)]
    for t in range(1, steps + 1):
        hp, hu = np.tanh(xp @ net.w1 + net.b1), np.tanh(xu @ net.w1 + net.b1)
        sp, su = _sigmoid(hp @ net.w2 + net.b2), _sigmoid(hu @ net.w2 + net.b2)
        if prior is None:
            gp, gu = (sp - 1) / len(sp), su * weight
        else:
            # Risk: prior * E_p[l(+)] + max(0, E_u[l(-)] - prior * E_p[l(-)]); when the second part is negative, climb out of it.
            negative = -(np.log1p(-su + 1e-12) @ weight) + prior * np.log1p(-sp + 1e-12).mean()
            if negative >= 0:
                gp, gu = prior * (sp - 1) / len(sp) - prior * sp / len(sp), su * weight
            else:
                gp, gu = prior * sp / len(sp), -su * weight
        dp, du = np.outer(gp, net.w2) * (1 - hp**2), np.outer(gu, net.w2) * (1 - hu**2)
        grads = [xp.T @ dp + xu.T @ du + RIDGE * net.w1, dp.sum(0) + du.sum(0), hp.T @ gp + hu.T @ gu + RIDGE * net.w2, gp.sum() + gu.sum()]
        step = 0.02 * np.sqrt(1 - 0.999**t) / (1 - 0.9**t)
        new = []
        for m, g, x in zip(moments, grads, (net.w1, net.b1, net.w2, net.b2), strict=True):
            m[0], m[1] = 0.9 * m[0] + 0.1 * g, 0.999 * m[1] + 0.001 * g**2
            new.append(x - step * m[0] / (np.sqrt(m[1]) + 1e-8))
        net.w1, net.b1, net.w2, net.b2 = new
    return net


def cutoffs(p: np.ndarray) -> np.ndarray:
    return np.unique(np.quantile(p, np.linspace(0, 0.95, 96)))


def class_prior(p: np.ndarray, above: np.ndarray, n: int, delta: float = 0.1) -> float:
    """Share of positives among n unlabelled texts, from the scores of held-back positives and from how many of the texts reach each of
    the cutoffs: the best bin of the ranking."""
    qp, qu = np.array([(p >= c).mean() for c in cutoffs(p)]), above / n
    slack = np.sqrt(np.log(4 / delta) / 2) * (1 / np.sqrt(len(p)) + 1 / np.sqrt(n))
    best = np.argmin((qu + slack) / np.maximum(qp, 1e-9))
    return float(np.clip(qu[best] / max(qp[best], 1e-9), 0.05, 0.99))


def reaching(shapes: DataFrame, net: Net, cuts: np.ndarray) -> np.ndarray:
    """How many of all descriptions have at least the logit of each cutoff."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            z = np.sort(net.logit(np.stack(b["shape"].to_list()))) if len(b) else np.zeros(0)
            yield pd.DataFrame({"cut": range(len(cuts)), "n": len(z) - np.searchsorted(z, cuts)})

    rows = shapes.select("shape").mapInPandas(run, "cut long, n long").groupBy("cut").agg(F.sum("n").alias("n")).orderBy("cut").collect()
    return np.array([r["n"] for r in rows], float)


def cells(shapes: DataFrame, most: int = CELLS) -> tuple[np.ndarray, np.ndarray]:
    """All descriptions (shape) in at most so many cells: mean and number of documents of each. The centres are the
    distinct descriptions of least hash, however the table is dealt out."""
    centres = np.array([r[0] for r in shapes.select("shape").distinct().orderBy(F.xxhash64("shape"), "shape").limit(most).collect()]).reshape(-1, FEATURES)
    if not len(centres):
        return centres, np.zeros(0)
    scale = centres.std(0) + 1e-3
    to = centres / scale

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            x = np.stack(b["shape"].to_list()) if len(b) else np.zeros((0, FEATURES))
            near = ((to**2).sum(1) - 2 * (x / scale) @ to.T).argmin(1)
            kinds, which = np.unique(near, return_inverse=True)
            total = np.zeros((len(kinds), FEATURES))
            np.add.at(total, which, x)
            yield pd.DataFrame({"cell": kinds, "n": np.bincount(which, minlength=len(kinds)), "total": list(total)})

    sums = [F.sum(F.get("total", i)).alias(f"f{i}") for i in range(FEATURES)]
    rows = shapes.select("shape").mapInPandas(run, "cell long, n long, total array<double>").groupBy("cell").agg(F.sum("n").alias("n"), *sums).orderBy("cell").collect()
    n = np.array([r["n"] for r in rows], float)
    return np.array([[r[f"f{i}"] for i in range(FEATURES)] for r in rows]) / n[:, None], n


def fit(shapes: DataFrame, labels: DataFrame, fold: Column, positives: int = POSITIVES) -> Net | None:
    """shapes: doc_id and shape of all documents. fold: whether labels of a doc_id may be learnt; they only ever tell the trusted positives."""
    good = labels.where(fold & (F.col("quality") == 1)).select("doc_id").distinct()
    few = good.orderBy(F.xxhash64("doc_id"), "doc_id").limit(positives)  # at most so many ids, so they can be broadcast
    p = np.array([r[0] for r in shapes.join(F.broadcast(few), "doc_id", "left_semi").orderBy("doc_id").select("shape").collect()]).reshape(-1, FEATURES)
    u, n = cells(shapes)
    if not len(p) or not len(u):
        return None
    weight = n / n.sum()
    half = np.arange(len(p)) % 2 == 0
    some = half if half.sum() < len(p) else np.ones(len(p), bool)
    first = train(p[some], u, weight, None, STEPS // 2)
    held = first.logit(p[~half] if half.sum() < len(p) else p)
    prior = class_prior(held, reaching(shapes, first, cutoffs(held)), int(n.sum()))
    return train(p, u, weight, prior)


def shapes(docs: DataFrame) -> DataFrame:
    """doc_id and shape of every whole text, written once: the fit and the scores both read it."""
    bounded_batches(docs.sparkSession)
    return materialise(docs.select("doc_id", described(F.col("text")).alias("shape")), "shapes")


@F.pandas_udf(T.ArrayType(T.DoubleType()))
def described(texts: pd.Series) -> pd.Series:
    return texts.map(describe)


def scored(net: Net | None, shape: Column) -> Column:
    """The score of each description, between 0 and 1."""
    if net is None:
        return F.lit(0.5)

    @F.pandas_udf(T.DoubleType())
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for found in batches:
            yield pd.Series(net.score(np.stack(found.to_list()) if len(found) else np.zeros((0, FEATURES))))

    return run(shape)
