"""Quality scores by positive-unlabelled learning.

Trusted positives are rows of the training folds labelled as of high quality. The unlabelled set are rows of the
same folds, drawn without a look at their labels, so good and bad alike; both sets are bounded samples of at most
MOST_TRAINING / 2 rows (lowest id hashes). The class prior p, the share of good documents, is estimated from all
training labels. The bad documents' risk is R_u(-) - p R_p(-); where that estimate falls below zero the fit has begun
to memorise positives, and the step goes the other way (non-negative risk). The classifier is linear over the shares
of hashed word shapes and of a few measures of a text, each cut into steps at fixed points.

Null or empty text: the score of no words. Null labels are ignored; several label rows of a doc_id: the largest
counts. Without a usable positive every score is 0.5. Repeated rows are scored one by one; extra columns are ignored.
"""

from __future__ import annotations

import re

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lixora.llm.common import WordHashes, fold_of
from lixora.llm.labelled import MOST_TRAINING, features, sampled, split_text_scores

SHAPES, STEPS, ROUNDS, RATE, DECAY = 256, np.array([0.02, 0.05, 0.1, 0.2, 0.35, 0.5, 0.65, 0.8, 0.9]), 600, 0.05, 1e-4
THRESHOLD, FOLDS, HELD = 0.7, 4, 2
MEASURES = 8
WIDTH = SHAPES + MEASURES * (len(STEPS) + 1)


def shape(word: str) -> str:
    """Letters by case, digits as 9, other characters as they are; runs of one kind count as one."""
    kinds = "".join("X" if c.isupper() else "x" if c.isalpha() else "9" if c.isdigit() else c for c in word)
    return re.sub(r"(.)\1+", r"\1", kinds)[:12]


class Shapes(dict):
    def __init__(self):
        self.hashes = WordHashes()

    def __missing__(self, word):
        if len(self) > 200_000:
            self.clear()
        self[word] = out = self.hashes[shape(word)] % SHAPES
        return out


def measures(text: str, words: list[str], distinct: int) -> list[float]:
    n, m = max(1, len(text)), max(1, len(words))
    lines = text.split("\n")
    letters = max(1, sum(map(len, words)))
    return [
        len(re.findall(r"[A-ZÀ-ÖØ-Þ]", text)) / n,
        len(re.findall(r"[^\w\s.,;:'\"()-]", text)) / n,
        distinct / m,
        sum(a == b for a, b in zip(words, words[1:])) / m,
        1 - len(set(lines)) / len(lines),
        min(1.0, letters / m / 20),
        min(1.0, m / 2000),
        len(re.findall(r"[0-9]", text)) / n,
    ]


def vector(text: str, shapes: Shapes) -> np.ndarray:
    words = text.split()
    out = np.zeros(WIDTH, np.float32)
    if not words:
        return out
    counts = np.bincount(np.fromiter(map(shapes.__getitem__, words), np.int64, len(words)), minlength=SHAPES)
    out[:SHAPES] = np.sqrt(counts / len(words))
    for k, x in enumerate(measures(text, words, len(set(words)))):
        at = SHAPES + k * (len(STEPS) + 1)
        out[at] = x
        out[at + 1 : at + 1 + len(STEPS)] = x >= STEPS
    return out


def sigmoid(z: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(z, -30, 30)))


def risk(w: np.ndarray, b: float, good: np.ndarray, any_: np.ndarray, prior: float) -> tuple[float, float, np.ndarray]:
    """The good documents' risk, that of the bad ones (estimated, it can fall below zero), and the gradient to follow:
    of their sum, or away from the second while that is negative."""
    zp, zu = good @ w + b, any_ @ w + b
    of_good = prior * np.logaddexp(0, -zp).mean()
    of_bad = np.logaddexp(0, zu).mean() - prior * np.logaddexp(0, zp).mean()
    dp_bad, du_bad = -prior * sigmoid(zp) / len(zp), sigmoid(zu) / len(zu)
    if of_bad >= 0:
        dp, du = prior * (sigmoid(zp) - 1) / len(zp) + dp_bad, du_bad
    else:
        dp, du = -dp_bad, -du_bad
    return of_good, of_bad, np.append(good.T @ dp + any_.T @ du, dp.sum() + du.sum())


def fit(good: np.ndarray, any_: np.ndarray, prior: float) -> tuple[np.ndarray, float]:
    """Weights and bias that minimise the non-negative risk of log loss, by Adam on all rows at once."""
    w, b, m, v = np.zeros(WIDTH), 0.0, np.zeros(WIDTH + 1), np.zeros(WIDTH + 1)
    for t in range(1, ROUNDS + 1):
        g = risk(w, b, good, any_, prior)[2]
        g[:-1] += DECAY * w
        m, v = 0.9 * m + 0.1 * g, 0.999 * v + 0.001 * g * g
        step = RATE * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.999**t)) + 1e-8)
        w, b = w - step[:-1], b - step[-1]
    return w, float(b)


def train(docs: DataFrame, labels: DataFrame, most: int = MOST_TRAINING) -> tuple[np.ndarray, float] | None:
    training = lambda c: fold_of(F.col(c), FOLDS) != HELD
    known = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("quality").cast("int").alias("label")).dropna()
    known = known.where(training("doc_id")).groupBy("doc_id").agg(F.max("label").alias("label"))
    prior = known.agg(F.avg("label")).first()[0]
    if not prior:
        return None
    trusted = sampled(known.where("label = 1").select("doc_id"), most // 2).withColumn("trusted", F.lit(1))
    others = sampled(known.select("doc_id"), most // 2).withColumn("hidden", F.lit(1))
    chosen = trusted.join(others, "doc_id", "full").select("doc_id", F.coalesce("trusted", F.lit(0)).alias("trusted"), F.coalesce("hidden", F.lit(0)).alias("hidden"))
    shapes = Shapes()
    of_text = lambda t: vector(t, shapes)
    got, rows = features(docs, chosen, of_text, ["trusted", "hidden"])
    if not rows or not got["trusted"].any() or not got["hidden"].any():
        return None
    x = np.stack(rows)
    return fit(x[got["trusted"] == 1], x[got["hidden"] == 1], min(prior, 0.98))


def scorer(model: tuple[np.ndarray, float] | None):
    shapes = Shapes()
    w, b = model or (np.zeros(WIDTH), 0.0)

    def scores(texts: list[str]) -> np.ndarray:
        z = np.array([vector(t, shapes) @ w + b for t in texts])
        return sigmoid(z)

    return scores


def quality(docs: DataFrame, labels: DataFrame, most: int = MOST_TRAINING, threshold: float = THRESHOLD) -> DataFrame:
    """(doc_id, held_out, score, predicted) of every document."""
    model = train(docs, labels, most)
    return split_text_scores(docs, lambda: scorer(model), fold_of(F.col("doc_id"), FOLDS) == HELD, threshold)
