"""Toxicity scores by a factorization machine over hashed terms.

A text's terms are its distinct lower-case words and their first four and five letters (so that insults are
met in their inflected forms), each hashed to 32 bits. The model is
score = sigmoid(b + sum w_i + sum_{i<j} <v_i, v_j> / n) over the n terms present that it knows: the linear part weighs words by
themselves, the factors pairs that occur together (an insult with the mention of a group). Fitted by
proximal AdaGrad on log loss; the L1 pull takes words that say nothing to exactly nothing, so a long clean
text gathers no score. The pull also shrinks what it keeps, most where labels are few. So a second model, fitted
without every fifth training row, scores these rows, and the line through its scores that fits their labels best
(toxic rows weigh more here, as in the fit) stretches and shifts the scores of the first.

Labels are learnt from training rows only, at most MOST_TRAINING of them (lowest id hashes). Null or empty
text: the score of no words. Label rows that are null or lack a document are ignored; several label rows of
one doc_id: the largest counts. Without any usable label every score is 0.5 and nothing is rejected.
Repeated rows are scored one by one; extra columns are ignored.
"""

from __future__ import annotations

import re

import numpy as np
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lixora.llm.common import WORDS_KEPT, filtered, fold_of
from lixora.llm.labelled import MOST_TRAINING, features, sampled, split_text_scores

FACTORS, EPOCHS, BATCH, PREFIXES = 4, 8, 128, (4, 5)
RATE, PULL_W, PULL_V, LEAST_DOCS, WEIGHT = 0.5, 1e-3, 3e-4, 4, 4.0
#: One row in so many calibrates, and so many such rows are needed; the line is held to the identity by RIDGE.
APART, LEAST_APART, RIDGE = 5, 20, 1.0
THRESHOLD, FOLDS, HELD = 0.7, 3, 1
WORDS = re.compile(r"\w+")


class Terms(dict):
    """What ``of`` makes of the term hashes of each word met so far; bounded."""

    def __init__(self, of=tuple):
        self.of = of

    def __missing__(self, word):
        if len(self) >= WORDS_KEPT:
            self.clear()
        terms = {word, *(f"^{word[:n]}" for n in PREFIXES if len(word) >= n)}
        self[word] = out = self.of(xxhash.xxh32_intdigest(t) for t in terms)
        return out


def terms_of(text: str, terms: Terms) -> np.ndarray:
    """Sorted distinct term hashes of a text."""
    found: set[int] = set()
    for word in set(WORDS.findall(text.lower())):
        found.update(terms[word])
    return np.sort(np.fromiter(found, np.uint32, len(found)))


def _places(keep: np.ndarray, d: np.ndarray) -> np.ndarray:
    at = np.minimum(np.searchsorted(keep, d), max(0, len(keep) - 1))
    return at[keep[at] == d] if len(keep) else at[:0]


def fit(labels: np.ndarray, docs: list[np.ndarray], seed: int = 7) -> dict[str, np.ndarray]:
    """Bias, and weights and factors of the terms that matter."""
    every, df = np.unique(np.concatenate(docs), return_counts=True)
    keep = every[df >= LEAST_DOCS]
    docs = [_places(keep, d) for d in docs]
    random = np.random.default_rng(seed)
    w, v = np.zeros(len(keep)), random.normal(0, 0.02, (len(keep), FACTORS))
    gw, gv = np.full(len(keep), 1e-2), np.full((len(keep), FACTORS), 1e-2)
    share = min(max(labels.mean(), 1e-3), 1 - 1e-3) if len(labels) else 0.5
    bias, gb = float(np.log(share / (1 - share))), 1.0
    for _ in range(EPOCHS if 0 < labels.sum() < len(labels) else 0):
        order = random.permutation(len(docs))
        for at in range(0, len(order), BATCH):
            rows = [r for r in order[at : at + BATCH] if len(docs[r])]
            if not rows:
                continue
            flat = np.concatenate([docs[r] for r in rows])
            lens = np.array([len(docs[r]) for r in rows])
            starts = np.concatenate([[0], np.cumsum(lens)[:-1]])
            fv = v[flat]
            s = np.add.reduceat(fv, starts)
            y = bias + np.add.reduceat(w[flat], starts) + 0.5 * ((s**2).sum(1) - np.add.reduceat((fv**2).sum(1), starts)) / lens
            g = (1 / (1 + np.exp(-np.clip(y, -30, 30))) - labels[rows]) * np.where(labels[rows] > 0, WEIGHT, 1.0) / len(rows)
            bias -= RATE * g.sum() / np.sqrt(gb := gb + g.sum() ** 2)
            each = np.repeat(g, lens)
            seen, back = np.unique(flat, return_inverse=True)
            dw = np.bincount(back, each, len(seen))
            part = each / np.repeat(lens, lens)
            dv = np.stack([np.bincount(back, part * (np.repeat(s[:, f], lens) - fv[:, f]), len(seen)) for f in range(FACTORS)], 1)
            gw[seen] += dw**2
            gv[seen] += dv**2
            for a, d, acc, pull in ((w, dw, gw, PULL_W), (v, dv, gv, PULL_V)):
                step = RATE / np.sqrt(acc[seen])
                new = a[seen] - step * d
                a[seen] = np.sign(new) * np.maximum(np.abs(new) - step * pull, 0)
    used = (w != 0) | (v != 0).any(1)
    return {"bias": np.float64(bias), "terms": keep[used], "w": w[used], "v": v[used]}


def logits(model: dict[str, np.ndarray]):
    """texts -> scores before the sigmoid."""
    place = {int(t): i for i, t in enumerate(model["terms"])}
    terms = Terms(lambda hashes: tuple(i for h in hashes if (i := place.get(h)) is not None))
    bias, w, v = float(model["bias"]), model["w"], model["v"]
    scale, shift = model.get("line", (1.0, 0.0))

    def scores(texts: list[str]) -> np.ndarray:
        out = np.full(len(texts), bias)
        for i, text in enumerate(texts):
            x: set[int] = set()
            for word in set(WORDS.findall(text.lower())):
                if got := terms[word]:
                    x.update(got)
            if x:
                x = sorted(x)
                out[i] += w[x].sum() + 0.5 * ((v[x].sum(0) ** 2).sum() - (v[x] ** 2).sum()) / len(x)
        return scale * out + shift

    return scores


def scorer(model: dict[str, np.ndarray]):
    """texts -> scores."""
    of = logits(model)
    return lambda texts: 1 / (1 + np.exp(-np.clip(of(texts), -30, 30)))


def line(z: np.ndarray, labels: np.ndarray) -> tuple[float, float]:
    """Scale and shift of scores z that fit the labels best, by Newton's method."""
    x, b, held = np.stack([z, np.ones_like(z)], 1), np.array([1.0, 0.0]), np.array([1.0, 0.0])
    weight = np.where(labels > 0, WEIGHT, 1.0)
    for _ in range(30):
        p = 1 / (1 + np.exp(-np.clip(x @ b, -30, 30)))
        slope = x.T @ (weight * (p - labels)) + RIDGE * (b - held)
        bend = (x * (weight * p * (1 - p))[:, None]).T @ x + RIDGE * np.eye(2)
        b = b - np.linalg.solve(bend, slope)
    return (float(b[0]), float(b[1])) if b[0] > 0 else (1.0, 0.0)


def known_score(model: dict[str, np.ndarray], docs: list[np.ndarray]) -> np.ndarray:
    """Scores before the sigmoid of documents given by their terms."""
    out = np.full(len(docs), float(model["bias"]))
    for i, d in enumerate(docs):
        x = _places(model["terms"], d)
        if len(x):
            v = model["v"][x]
            out[i] += model["w"][x].sum() + 0.5 * ((v.sum(0) ** 2).sum() - (v**2).sum()) / len(x)
    return out


def calibrated(labels: np.ndarray, docs: list[np.ndarray]) -> dict[str, np.ndarray]:
    """The model of all rows, and the line that rows apart from those of a second model give."""
    model = fit(labels, docs)
    apart = np.arange(len(docs)) % APART == 0
    if min(labels[apart].sum(), (1 - labels[apart]).sum()) < LEAST_APART:
        return model
    second = fit(labels[~apart], [d for d, a in zip(docs, apart) if not a])
    return model | {"line": line(known_score(second, [d for d, a in zip(docs, apart) if a]), labels[apart])}


def train(docs: DataFrame, labels: DataFrame, most: int = MOST_TRAINING) -> dict[str, np.ndarray]:
    """The model of the labelled rows outside the held-out fold."""
    known = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("toxic").cast("int").alias("label")).dropna()
    known = known.where(fold_of(F.col("doc_id"), FOLDS) != HELD).groupBy("doc_id").agg(F.max("label").alias("label"))
    terms = Terms()
    got, rows = features(docs, sampled(known, most), lambda t: terms_of(t, terms), ["label"])
    return calibrated(got["label"].astype(float), rows) if rows else {"bias": np.float64(0), "terms": np.empty(0, np.uint32), "w": np.empty(0), "v": np.empty((0, FACTORS))}


def toxicity(docs: DataFrame, labels: DataFrame, most: int = MOST_TRAINING, threshold: float = THRESHOLD) -> DataFrame:
    """(doc_id, held_out, score, predicted) of every document."""
    model = train(docs, labels, most)
    return split_text_scores(docs, lambda: scorer(model), fold_of(F.col("doc_id"), FOLDS) == HELD, threshold)


def reject_toxic(docs: DataFrame, labels: DataFrame, most: int = MOST_TRAINING, threshold: float = THRESHOLD) -> DataFrame:
    """docs without those that score at least ``threshold``; columns and types stay."""
    model = train(docs, labels, most)

    def keep():
        scores = scorer(model)
        return lambda texts: scores(texts) < threshold

    return filtered(docs, "text", keep)
