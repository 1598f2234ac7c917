"""Toxicity by multiple-instance learning.

A document is a bag of sentences; its probability of being toxic is the noisy-or of the
sentences' probabilities. Only documents are labelled: the gradient of the document's
likelihood tells each sentence its share, so the model also locates the sentences.
Features are hashed words and word beginnings.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from readtrace.llm.common import BYTES, DOUBLE, LONG, STRING, map_rows, sampled, struct

BUCKETS = 1 << 18
#: Labelled documents that the model is fitted on, at most about.
SAMPLE = 8_000
#: Features kept: those met in at least so many toxic documents and so much more often there.
LEAST, LIFT, KEPT = 4, 3.0, 4096
BEGINNINGS = (4, 6, 8)

_SENTENCE = re.compile(r"[^.!?\n]+")
_WORD = re.compile(r"[^\W\d_]+")


class _Buckets(dict):
    """Feature buckets of a word: the word itself and its beginnings."""

    def __missing__(self, word: str) -> tuple[int, ...]:
        parts = [f"{word}$", *(word[:k] for k in BEGINNINGS if k <= len(word))]
        value = tuple(xxhash.xxh3_64_intdigest(p) % BUCKETS for p in parts)
        if len(self) < 300_000:
            self[word] = value
        return value


def sentences(text: str | None) -> Iterator[tuple[int, int, list[str]]]:
    """(start, end, words in lower case) of the sentences that have a word; places count in the text as it is."""
    for m in _SENTENCE.finditer(text or ""):
        words = _WORD.findall(m.group().lower())
        if words:
            yield *m.span(), words


def bag(text: str | None, buckets: _Buckets) -> tuple[np.ndarray, np.ndarray]:
    """How many distinct features each sentence has, and their buckets."""
    sizes, found = [], []
    for *_, words in sentences(text):
        features = {b for w in words for b in buckets[w]}
        sizes.append(len(features))
        found += sorted(features)
    return np.array(sizes, np.int32), np.array(found, np.int32)


@dataclass
class Bags:
    """Weights of the kept features, bias of a sentence, and a last logistic on the document's log odds."""

    weights: np.ndarray
    bias: float
    gain: tuple[float, float]

    def __post_init__(self):
        self.known: dict[str, float] = {}
        self.buckets = _Buckets()
        self.active = self.weights != 0

    def sentence_scores(self, text: str | None) -> np.ndarray:
        """One probability per sentence, each feature counted once."""
        out = []
        for *_, words in sentences(text):
            features: set[int] = set()
            for w in words:
                hit = self.known.get(w)
                if hit is None:
                    hit = tuple(b for b in self.buckets[w] if self.active[b])
                    if len(self.known) < 1_000_000:
                        self.known[w] = hit
                if hit:
                    features.update(hit)
            out.append(self.bias + float(sum(self.weights[b] for b in sorted(features))))
        return _sigmoid(np.array(out, float))

    def document_score(self, p: np.ndarray) -> float:
        if not len(p):
            return 0.0
        return float(_sigmoid(self.gain[0] + self.gain[1] * _log_odds(float(np.log1p(-np.minimum(p, 1 - 1e-12)).sum()))))


def _sigmoid(z):
    return 1 / (1 + np.exp(-np.clip(z, -40, 40)))


def _log_odds(log_clean):
    """Log odds of noisy-or, given the log probability that no sentence is toxic."""
    clean = np.minimum(log_clean, -1e-12)
    return np.clip(np.log(-np.expm1(clean)) - clean, -20, 20)


def learn(docs: DataFrame, labels: DataFrame, learning: Column, label: str = "toxic", sample: int = SAMPLE,
          rounds: int = 300, id_col: str = "doc_id", text_col: str = "text") -> Bags:
    """Fit on about ``sample`` labelled documents at most, picked by a hash of the id.

    ``learning`` is a condition on ``doc_id``. Null labels are left out; several labels of
    one document count as toxic if one is. Without toxic labels every score is near 0.
    """
    known = (labels.select("doc_id", F.col(label).alias("y")).where(F.col("y").isNotNull() & F.col("doc_id").isNotNull() & learning)
             .groupBy("doc_id").agg(F.max("y").alias("y")))
    known = F.broadcast(sampled(known, "doc_id", sample))  # SAMPLE rows of two numbers
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text")).join(known, "doc_id")

    def features(batches: Iterator[dict]) -> Iterator[tuple]:
        buckets = _Buckets()
        for batch in batches:
            bags = [bag(t, buckets) for t in batch["text"]]
            yield batch["doc_id"], batch["y"], [b[0].tobytes() for b in bags], [b[1].tobytes() for b in bags]

    schema = struct(("doc_id", rows.schema["doc_id"].dataType), ("y", LONG), ("sizes", BYTES), ("found", BYTES))
    # Bounded by SAMPLE; in the order of the ids, so that reruns add up alike.
    got = sorted(map_rows(rows.withColumn("y", F.col("y").cast("long")), features, schema).toLocalIterator(), key=lambda r: (r.doc_id, r.found))
    y = np.array([r.y for r in got], float)
    bags = [(np.frombuffer(r.sizes, np.int32), np.frombuffer(r.found, np.int32)) for r in got]
    return fit(y, bags, rounds)


def fit(y: np.ndarray, bags: list[tuple[np.ndarray, np.ndarray]], rounds: int = 300) -> Bags:
    weights = np.zeros(BUCKETS)
    if not len(y) or y.sum() == 0:
        return Bags(weights, -12.0, (0.0, 1.0))
    docs_with = np.zeros((2, BUCKETS))
    for label, (_, found) in zip(y, bags, strict=True):
        docs_with[int(label > 0), np.unique(found)] += 1
    n = np.array([(y == 0).sum(), (y > 0).sum()])
    lift = ((docs_with[1] + 0.5) / (n[1] + 1)) / ((docs_with[0] + 0.5) / (n[0] + 1))
    able = np.flatnonzero((docs_with[1] >= LEAST) & (lift >= LIFT))
    kept = able[np.argsort(-lift[able] * np.sqrt(docs_with[1][able]), kind="stable")][:KEPT]
    column = np.full(BUCKETS, -1, np.int64)
    column[kept] = np.arange(len(kept))
    # Sentences without a kept feature share the bias and are only counted.
    sent, feat, of_doc, plain, m = [], [], [], np.zeros(len(y)), 0
    for d, (sizes, found) in enumerate(bags):
        c, own = column[found], np.repeat(np.arange(len(sizes)), sizes)
        o, c = own[c >= 0], c[c >= 0]
        distinct, inverse = np.unique(o, return_inverse=True)
        plain[d] = len(sizes) - len(distinct)
        sent.append(inverse + m)
        feat.append(c)
        of_doc += [d] * len(distinct)
        m += len(distinct)
    sent, feat, of_doc = np.concatenate(sent), np.concatenate(feat), np.array(of_doc, np.int64)
    w, b = np.zeros(len(kept)), -5.0
    g1, g2 = np.zeros(len(kept) + 1), np.zeros(len(kept) + 1)
    for step in range(1, rounds + 1):
        p = _sigmoid(b + np.bincount(sent, w[feat], m))
        base = float(_sigmoid(b))
        log_clean = np.bincount(of_doc, np.log1p(-np.minimum(p, 1 - 1e-12)), len(y)) + plain * np.log1p(-base)
        toxic = -np.expm1(np.minimum(log_clean, -1e-9))
        # d loss / d log_clean, by document; d log_clean / d z = -p by sentence
        pull = np.where(y > 0, np.exp(log_clean) / toxic, -1.0)
        gz = -pull[of_doc] * p
        grad = np.append(np.bincount(feat, gz[sent], len(kept)), (gz.sum() - (pull * plain).sum() * base)) / len(y)
        grad[:-1] += 2e-5 * w + 1e-5 * np.sign(w)
        g1, g2 = 0.9 * g1 + 0.1 * grad, 0.999 * g2 + 0.001 * grad * grad
        move = 0.1 * (g1 / (1 - 0.9 ** step)) / (np.sqrt(g2 / (1 - 0.999 ** step)) + 1e-9)
        w, b = w - move[:-1], min(b - move[-1], -1.0)
    w[np.abs(w) < 1e-3] = 0
    weights[kept] = w
    p = _sigmoid(b + np.bincount(sent, w[feat], m))
    odds = _log_odds(np.bincount(of_doc, np.log1p(-np.minimum(p, 1 - 1e-12)), len(y)) + plain * np.log1p(-float(_sigmoid(b))))
    a0, a1 = 0.0, 1.0
    for _ in range(500):  # a last logistic, kept close to the identity
        e = _sigmoid(a0 + a1 * odds) - y
        a0, a1 = a0 - 0.3 * (e.mean() + 0.001 * a0), max(0.2, a1 - 0.02 * ((e * odds).mean() + 0.01 * (a1 - 1)))
    return Bags(weights, b, (float(a0), float(a1)))


_PLACES = T.ArrayType(struct(("start", LONG), ("end", LONG), ("score", DOUBLE), ("sentence", STRING)))


def scored(docs: DataFrame, model: Bags, threshold: float = 0.3, id_col: str = "doc_id", text_col: str = "text",
           places: bool = True) -> DataFrame:
    """Toxicity of every whole text, and the sentences at or above the threshold with their places in it.

    Null texts and texts without a word have no sentence and score 0. Equal texts score
    alike; an empty table gives an empty result.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)  # BUCKETS weights
    schema = struct(("doc_id", docs.schema[id_col].dataType), ("score", DOUBLE), ("places", _PLACES))

    def run(batches: Iterator[dict]) -> Iterator[tuple]:
        m = shared.value
        for batch in batches:
            scores, found = [], []
            for text in batch["text"]:
                p = m.sentence_scores(text)
                scores.append(m.document_score(p))
                hit = np.flatnonzero(p >= threshold) if places else ()
                spans = [(a, b) for a, b, _ in sentences(text)] if len(hit) else ()
                found.append([{"start": spans[i][0], "end": spans[i][1], "score": float(p[i]),
                               "sentence": text[slice(*spans[i])]} for i in hit])
            yield batch["doc_id"], scores, found

    return map_rows(docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text")), run, schema)
