"""Operator 2, document quality by Bradley-Terry pairwise ranking.

Each document is a vector of text statistics, spread over thresholds so that a linear model can
bend. Preference pairs set each document labelled 1 over each labelled 0; weights are fitted by the
logistic loss on differences of their vectors, over all pairs of the sample. The threshold is the
quantile of training scores that leaves the share of labelled bad documents below it, and a score is
the logistic function of the distance from it. The training sample is bounded by `SAMPLE`.
"""

from __future__ import annotations

import math
import re
import zlib

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import map_batches, remainder, table, texts_of
from .toxicity import sample

#: Labelled rows in the training sample at most, thresholds a statistic, and gradient steps.
SAMPLE = 6000
STEPS = 12
DESCENT = 150
MODULUS, HELD_OUT = 3, 1
THRESHOLD = 0.5

_NOT_WORD = re.compile(r"[^\w\s]")
_RUN = re.compile(r"([^\w\s])\1")
_UPPER = re.compile(r"[A-ZÀ-ÖØ-Þ]")
_DIGIT = re.compile(r"[0-9]")


def statistics(text: str) -> list[float]:
    """What a document looks like; defined for the empty text too."""
    words = text.split()
    lines = text.split("\n")
    n, c = len(words) or 1, len(text) or 1
    kinds = set(words)
    low = {w.lower().strip(".,;:!?") for w in kinds}
    pairs = set(zip(words, words[1:], strict=False))
    marks = len(_NOT_WORD.findall(text))
    same = sum(map(str.__eq__, words, words[1:]))
    return [
        math.log1p(len(words)), math.log1p(len(text)), len(text) / n, len(kinds) / n, len(low) / n, len(pairs) / n, same / n,
        marks / c, marks / n, len(_RUN.findall(text)) / n, len(_UPPER.findall(text)) / c, len(_DIGIT.findall(text)) / c,
        text.count("|") / n, text.count(".") / n, text.count(",") / n, len(lines) / n, len(set(lines)) / len(lines),
        sum(w.isalpha() for w in kinds) / (len(kinds) or 1), len(zlib.compress(text.encode("utf-8", "surrogatepass"), 1)) / c if text else 0.0,
        sum(text.count(x) for x in ("http", "www", "©", "{", "}", "<", ">")) / n,
    ]


class BradleyTerry:
    """Scores of vectors, learned from preference pairs."""

    def __init__(self, x: np.ndarray, y: np.ndarray, steps: int = STEPS):
        x = np.asarray(x, np.float64) if len(y) else np.zeros((0, len(statistics(""))))
        self.mean = x.mean(0) if len(x) else np.zeros(x.shape[1])
        self.scale = (x.std(0) if len(x) else np.ones_like(self.mean)) + 1e-9
        at = np.arange(1, steps + 1) / (steps + 1)
        self.cuts = np.quantile(x, at, axis=0).T if len(x) else np.zeros((len(self.mean), steps))
        z = self.spread(x) if len(x) else np.zeros((0, len(self.mean) * (steps + 1)))
        self.weights, self.threshold = np.zeros(z.shape[1]), 0.0
        good, bad = np.flatnonzero(y == 1), np.flatnonzero(y == 0)
        if len(good) and len(bad):
            # The gradient over all pairs needs the sums of each document's doubts alone; a difference is at most twice as long as a vector.
            w, v, rate = self.weights, self.weights.copy(), 1.0 / np.square(z - z.mean(0)).sum(1).mean()
            zg, zb = z[good], z[bad]
            for k in range(DESCENT):
                s = (z @ v).astype(np.float32)
                doubt = np.subtract.outer(s[good], s[bad])
                np.exp(np.clip(doubt, -30, 30, out=doubt), out=doubt)
                doubt += 1
                np.reciprocal(doubt, out=doubt)
                pull = (doubt.sum(1) @ zg - doubt.sum(0) @ zb) / doubt.size
                new = (v + rate * pull) / (1 + rate * 1e-4)
                v = new + k / (k + 3) * (new - w)
                w = new
            self.weights = w
            self.threshold = float(np.quantile(z @ w, len(bad) / (len(bad) + len(good))))

    def spread(self, x: np.ndarray) -> np.ndarray:
        """The standardised vector, clipped, and whether each statistic is above each cut."""
        x = np.asarray(x, np.float64)
        over = (x[:, :, None] > self.cuts[None]).reshape(len(x), -1)
        return np.concatenate([np.clip((x - self.mean) / self.scale, -4, 4), over], axis=1)

    def score(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.spread(x) @ self.weights - self.threshold, -30, 30)))


def fitted(docs: DataFrame, labels: DataFrame, rows: int = SAMPLE) -> BradleyTerry:
    got = sample(docs, labels, "quality", MODULUS, HELD_OUT, rows, each=False)
    return BradleyTerry(np.array([statistics(t) for t, _ in got]), np.array([y for _, y in got]))


def scored(docs: DataFrame, model: BradleyTerry) -> DataFrame:
    """doc_id, held_out, score, predicted. Null texts are scored as empty; repeated rows each return
    a row; an empty table returns none; extra columns are left out."""
    kind = dict(docs.dtypes)["doc_id"]
    only = docs.select("doc_id", "text", (remainder(F.col("doc_id"), MODULUS) == HELD_OUT).alias("held_out"))

    def make():
        return lambda b: {"doc_id": b.column("doc_id"), "held_out": b.column("held_out"), "score": model.score(np.array([statistics(t) for t in texts_of(b)]))}

    rows = map_batches(only, f"doc_id {kind}, held_out boolean, score double", "text", make)
    return rows.withColumn("predicted", (F.col("score") >= THRESHOLD).cast("int"))


def op2_bradley_terry_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return scored(docs, fitted(docs, table(spark, sf_dir, "labels")))
