"""Toxicity by multiple-instance learning: a document is toxic if at least one of its sentences is.

A sentence's logit is a bias plus the weights of its words and of their first four and five letters; the probabilities of
a document's sentences are combined by noisy-or, 1 - prod(1 - p). Weights are learned from document labels only, by
gradient descent on the noisy-or likelihood: a pass with a strong L1 penalty chooses features, a second one weighs those
freely, so that a long clean document doesn't add up to a toxic one. Both use a bounded sample of labelled rows (TRAIN_EACH rows of each label, of at
most TRAIN_CHARS characters each; the only bounds, and for fitting alone). Every document is scored on its whole text;
lang, source and doc_id are no inputs of a score.

Null and empty texts have no sentence and score the small constant `EMPTY`; without labels of both kinds all weights are
zero and every document gets the bias alone, of a score below 0.5. Repeated rows get equal scores. Rows of labels with a
null doc_id or label teach nothing; of several labels of a document the highest holds. Extra columns are dropped.
"""

from __future__ import annotations

import re
import zlib

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tracklight.llm.common import map_rows

TRAIN_EACH, TRAIN_CHARS = 2500, 20_000
BITS = 18
EMPTY = 1e-6
#: Sentences end at these.
SENTENCE = re.compile(r"[^.!?\n]+")
WORD = re.compile(r"\w+")
RATE = 0.1
#: Steps, bias at the start, its rate and the L1 penalty: first to choose the features, then to weigh those of at least CHOSEN.
CHOOSE, WEIGH, CHOSEN = (120, -5.0, 0.05, 1e-3), (150, -10.0, 0.02, 1e-5), 0.3


def features(word: str) -> list[int]:
    """Hashed features of a lower-case word."""
    own = [word] + [f"{word[:n]}*" for n in (4, 5) if len(word) >= n]
    return [zlib.crc32(x.encode()) & ((1 << BITS) - 1) for x in own]


class Scorer:
    def __init__(self, weights: np.ndarray, bias: float) -> None:
        self.weights, self.bias, self.memo = weights, bias, {}

    def word(self, word: str) -> float:
        if len(self.memo) > 200_000:
            self.memo.clear()
        self.memo[word] = out = float(self.weights[features(word)].sum())
        return out

    def sentences(self, text: str) -> list[tuple[int, int, float]]:
        """Start, end and probability of each sentence that has words."""
        out, memo = [], self.memo
        low = text.lower()
        if len(low) != len(text):  # some letters change their length
            low = "".join(c if len(d := c.lower()) != 1 else d for c in text)
        for m in SENTENCE.finditer(low):
            words = WORD.findall(m[0])
            if words:
                z = self.bias + sum(memo[w] if w in memo else self.word(w) for w in words)
                out.append((m.start(), m.end(), 1 / (1 + np.exp(-min(30.0, max(-30.0, z))))))
        return out

    def score(self, text: str) -> tuple[float, list[dict]]:
        """The noisy-or of all sentences, and those of at least 0.5."""
        found = self.sentences(text)
        if not found:
            return EMPTY, []
        p = np.array([x[2] for x in found])
        return float(-np.expm1(np.log1p(-p).sum())), [{"start": a, "end": b, "score": float(s)} for a, b, s in found if s >= 0.5]


def training_rows(docs: DataFrame, labels: DataFrame, each: int = TRAIN_EACH, chars: int = TRAIN_CHARS) -> DataFrame:
    """The bounded sample: for each label the `each` rows of smallest hash. The broadcast holds at most 2 * each ids."""
    known = labels.where("doc_id is not null and toxic is not null").groupBy("doc_id").agg(F.max("toxic").alias("toxic")).where("pmod(crc32(cast(doc_id as string)), 5) != 0")
    part = lambda y: known.where((F.col("toxic") > 0) == F.lit(y)).select("doc_id", F.lit(int(y)).alias("y")).orderBy(F.xxhash64("doc_id"), "doc_id").limit(each)
    ids = part(True).unionByName(part(False))
    return docs.where(F.length("text") <= chars).select("doc_id", "text").join(F.broadcast(ids), "doc_id")


def train(docs: DataFrame, labels: DataFrame) -> Scorer:
    rows = map_rows(training_rows(docs, labels).select("y", "text"), "y int, ids binary, ends binary", lambda: _bags).collect()
    weights = np.zeros(1 << BITS)
    y = np.array([r.y for r in rows], float)
    if not len(rows) or y.min() == y.max():
        return Scorer(weights, WEIGH[1])
    bags = [(np.frombuffer(r.ids, np.int32), np.frombuffer(r.ends, np.int32)) for r in rows]
    kept = [k for k, b in enumerate(bags) if len(b[0])]
    y, bags = y[kept], [bags[k] for k in kept]
    if not bags:
        return Scorer(weights, WEIGH[1])
    chosen, _ = _descend(weights, np.ones(len(weights)), y, bags, *CHOOSE)
    mask = (chosen > CHOSEN).astype(float)
    return Scorer(*_descend(chosen * mask, mask, y, bags, *WEIGH))


def _descend(weights: np.ndarray, mask: np.ndarray, y: np.ndarray, bags: list, steps: int, bias: float, bias_rate: float, penalty: float) -> tuple[np.ndarray, float]:
    """Adam steps on the noisy-or likelihood, both labels weighing the same; the penalty pulls weights to zero."""
    ids = np.concatenate([b[0] for b in bags])
    n_sent = np.array([len(b[1]) for b in bags])
    per = np.concatenate([np.diff(b[1], prepend=0) for b in bags])
    sent_of = np.repeat(np.arange(len(per)), per)
    doc_of = np.repeat(np.arange(len(bags)), n_sent)
    balance = np.where(y > 0, 0.5 / max(1, y.sum()), 0.5 / max(1, (1 - y).sum())) * len(y)
    first, second, bias_first, bias_second = np.zeros_like(weights), np.zeros_like(weights), 0.0, 0.0
    for step in range(1, steps + 1):
        z = bias + np.bincount(sent_of, weights[ids], len(per))
        p = 1 / (1 + np.exp(-np.clip(z, -30, 30)))
        none = np.exp(np.bincount(doc_of, np.log1p(-np.minimum(p, 1 - 1e-12)), len(y)))
        slope = np.where(y > 0, -none / np.maximum(1 - none, 1e-9), 1.0) * balance
        dz = slope[doc_of] * p / len(y)
        g, b = np.bincount(ids, dz[sent_of], len(weights)), dz.sum()
        first, second = 0.9 * first + 0.1 * g, 0.99 * second + 0.01 * g * g
        bias_first, bias_second = 0.9 * bias_first + 0.1 * b, 0.99 * bias_second + 0.01 * b * b
        new, old = 1 - 0.9**step, 1 - 0.99**step
        reach = RATE / (np.sqrt(second / old) + 1e-4)
        weights = weights - reach * first / new
        weights = np.sign(weights) * np.maximum(np.abs(weights) - reach * penalty, 0) * mask
        bias -= bias_rate * (bias_first / new) / (np.sqrt(bias_second / old) + 1e-8)
    return weights, float(bias)


def _bags(cols: dict[str, list]) -> dict[str, list]:
    ids, ends = [], []
    for text in cols["text"]:
        own, stops = [], []
        for s in SENTENCE.findall(text.lower()):
            before = len(own)
            for w in WORD.findall(s):
                own += features(w)
            if len(own) > before:
                stops.append(len(own))
        ids.append(np.array(own, np.int32).tobytes())
        ends.append(np.array(stops, np.int32).tobytes())
    return {"y": cols["y"], "ids": ids, "ends": ends}


def score(docs: DataFrame, model: Scorer) -> DataFrame:
    """doc_id, score, predicted and offending (array of start, end, score of sentences)."""
    at = docs.sparkSession.sparkContext.broadcast((model.weights.astype(np.float32), model.bias))

    def make():
        own = Scorer(*at.value)

        def one(cols):
            found = [own.score(t or "") for t in cols["text"]]
            return {"doc_id": cols["doc_id"], "score": [f[0] for f in found], "predicted": [int(f[0] >= 0.5) for f in found], "offending": [f[1] for f in found]}

        return one

    kind = docs.schema["doc_id"].dataType.simpleString()
    return map_rows(docs.select("doc_id", "text"), f"doc_id {kind}, score double, predicted int, offending array<struct<start: int, end: int, score: double>>", make)


def detect(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """Trains on labels outside the held-out fifth (crc32 of doc_id as text, modulo 5, is 0) and scores all of docs."""
    held = F.expr("coalesce(pmod(crc32(cast(doc_id as string)), 5) = 0, false)")
    return score(docs, train(docs, labels)).withColumn("held_out", held)
