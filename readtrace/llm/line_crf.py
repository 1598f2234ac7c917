"""Document quality from a linear-chain conditional random field over lines.

Every line is good or bad, given features of the line and its neighbours and the state
of the line before. Only documents are labelled, so lines start with their document's
label and the lines of bad documents are relabelled by the model between fits. The
marginals of forward-backward, weighted by the length of the lines, give the share of
good text, which a logistic turns into the document's score.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from readtrace.llm.common import BYTES, DOUBLE, LONG, map_rows, sampled, struct

#: Labelled documents that the model is fitted on, at most about.
SAMPLE = 4_000

#: Upper ends of the bins of each measure; a line falls into one bin of each.
BINS = {
    "words": (1, 3, 8, 20, 60),
    "word_size": (2, 3, 4.5, 6, 8, 11),
    "symbols": (0.0, 0.02, 0.1, 0.5, 1.5),
    "marks": (0.05, 0.15, 0.4, 0.8, 1.5),
    "capitals": (0.05, 0.2, 0.5, 0.8),
    "repeats": (0.1, 0.3, 0.5, 0.7, 0.9),
    "digits": (0.02, 0.1, 0.3),
    "closed": (0.5,),
}
_SIZES = [len(b) + 1 for b in BINS.values()]
_OFFSETS = np.concatenate(([0], np.cumsum(_SIZES)))
FEATURES = int(_OFFSETS[-1])
_SYMBOLS = b"#*$%&|<>@^~=+_\\{}[]"
_MARKS = b".,;:!?\"'()-"


def line_bins(line: str) -> list[int]:
    """The feature numbers that are on for one line, one per measure."""
    raw = line.encode()
    words = raw.split()
    n = max(1, len(words))
    bare = raw.translate(None, b" \t\r\x0b\x0c")
    values = (
        len(words), len(bare) / n,
        (len(raw) - len(raw.translate(None, _SYMBOLS))) / n,
        (len(raw) - len(raw.translate(None, _MARKS))) / n,
        sum(w.isupper() for w in words) / n,
        1 - len(set(words)) / n,
        (len(raw) - len(raw.translate(None, b"0123456789"))) / max(1, len(bare)),
        float(raw.rstrip()[-1:] in (b".", b"!", b"?", b":", b'"')),
    )
    return [int(_OFFSETS[i]) + sum(v > e for e in ends) for i, (v, ends) in enumerate(zip(values, BINS.values(), strict=True))]


def lines_of(text: str | None) -> tuple[np.ndarray, np.ndarray]:
    """Feature numbers (lines x measures) and lengths of the lines that are not blank."""
    rows, sizes = [], []
    for line in (text or "").split("\n"):
        if line.strip():
            rows.append(line_bins(line))
            sizes.append(len(line))
    return np.array(rows, np.int16).reshape(len(rows), len(BINS)), np.array(sizes, np.int32)


@dataclass
class Chain:
    """Weights for a bad line (own, previous, next line's features; bias), transitions, and the last logistic."""

    weights: np.ndarray  # 3 x (FEATURES + 1): the last column stands for a missing neighbour
    bias: float
    stay: tuple[float, float]  # log potentials of good-good and bad-bad over a change
    gain: tuple[float, float, float]

    def odds(self, rows: np.ndarray) -> np.ndarray:
        """Log potential of bad over good for each line, before transitions."""
        w = self.weights
        own = w[0][rows].sum(1)
        before, after = w[1][rows].sum(1), w[2][rows].sum(1)
        z = own + self.bias
        z[1:] += before[:-1]
        z[:-1] += after[1:]
        z[0] += w[1][FEATURES]
        z[-1] += w[2][FEATURES]
        return z

    def marginals(self, rows: np.ndarray) -> np.ndarray:
        """P(bad) of each line by forward-backward on log odds."""
        z = self.odds(rows).tolist()
        n, (g, b) = len(z), self.stay
        ahead, back = [0.0] * n, [0.0] * n
        for i in range(1, n):
            ahead[i] = _pass(z[i - 1] + ahead[i - 1], g, b)
            back[n - 1 - i] = _pass(z[n - i] + back[n - i], g, b)
        return 1 / (1 + np.exp(-np.clip(np.array(z) + ahead + back, -40, 40)))

    def measures(self, rows: np.ndarray, sizes: np.ndarray) -> tuple[float, float]:
        """Length-weighted share of bad text, and log length."""
        if not len(rows):
            return 0.5, 0.0
        return float((self.marginals(rows) * sizes).sum() / sizes.sum()), float(np.log1p(sizes.sum()) - 6)

    def score(self, bad: float, size: float) -> float:
        """Quality of a document from its ``measures``."""
        return 1 / (1 + math.exp(-max(-40.0, min(40.0, self.gain[0] + self.gain[1] * _logit(bad) + self.gain[2] * size))))


def _pass(z: float, g: float, b: float) -> float:
    """Message over one transition: log of (e^z e^b + 1) / (e^z + e^g)."""
    z = max(-40.0, min(40.0, z))
    return math.log(math.exp(z + b) + 1) - math.log(math.exp(z) + math.exp(g))


def _logit(p):
    p = np.clip(p, 1e-6, 1 - 1e-6)
    return np.log(p / (1 - p))


def learn(docs: DataFrame, labels: DataFrame, learning: Column, label: str = "quality", sample: int = SAMPLE,
          id_col: str = "doc_id", text_col: str = "text") -> Chain:
    """Fit on about ``sample`` labelled documents at most, picked by a hash of the id.

    ``learning`` is a condition on ``doc_id``. Null labels are left out; of several labels
    of one document the lowest counts. Without labels every score is one half.
    """
    known = (labels.select("doc_id", F.col(label).alias("y")).where(F.col("y").isNotNull() & F.col("doc_id").isNotNull() & learning)
             .groupBy("doc_id").agg(F.min("y").alias("y")))
    known = F.broadcast(sampled(known, "doc_id", sample))  # SAMPLE rows of two numbers
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text")).join(known, "doc_id")

    def features(batches: Iterator[dict]) -> Iterator[tuple]:
        for batch in batches:
            found = [lines_of(t) for t in batch["text"]]
            yield batch["doc_id"], batch["y"], [f[0].tobytes() for f in found], [f[1].tobytes() for f in found]

    schema = struct(("doc_id", rows.schema["doc_id"].dataType), ("y", LONG), ("rows", BYTES), ("sizes", BYTES))
    # Bounded by SAMPLE; in the order of the ids, so that reruns add up alike.
    got = sorted(map_rows(rows.withColumn("y", F.col("y").cast("long")), features, schema).toLocalIterator(), key=lambda r: (r.doc_id, r.rows))
    texts = [(np.frombuffer(r.rows, np.int16).reshape(-1, len(BINS)), np.frombuffer(r.sizes, np.int32)) for r in got]
    return fit(np.array([r.y for r in got], float), texts)


def fit(y: np.ndarray, texts: list[tuple[np.ndarray, np.ndarray]], rounds: int = 3, steps: int = 80) -> Chain:
    model = Chain(np.zeros((3, FEATURES + 1)), 0.0, (0.5, 0.5), (0.0, 0.0, 0.0))
    full = [i for i, (rows, _) in enumerate(texts) if len(rows)]
    if not full or len({*y[full]}) < 2:
        return model
    order = sorted(full, key=lambda i: -len(texts[i][0]))  # longest first: at each place the chains still running are a prefix
    sizes = np.array([len(texts[i][0]) for i in order])
    starts = np.concatenate(([0], np.cumsum(sizes)[:-1]))
    flat = np.concatenate([texts[i][0] for i in order]).astype(np.int64)
    first, last = np.zeros(len(flat), bool), np.zeros(len(flat), bool)
    first[starts], last[starts + sizes - 1] = True, True
    running = [int((sizes > t).sum()) for t in range(sizes[0])]
    bad_doc = np.repeat(y[order] == 0, sizes)
    states = bad_doc.copy()
    # A line tells no more for standing in a long document.
    weight = np.repeat(1 / np.sqrt(sizes), sizes)
    params = np.zeros(3 * (FEATURES + 1) + 3)
    params[-2:] = 0.5
    m1, m2, step = np.zeros_like(params), np.zeros_like(params), 0
    for _ in range(rounds):
        for _ in range(steps):
            step += 1
            grad = _gradient(params, flat, first, last, starts, running, states, weight) + 2e-3 * params
            m1, m2 = 0.9 * m1 + 0.1 * grad, 0.999 * m2 + 0.001 * grad * grad
            params = params - 0.1 * (m1 / (1 - 0.9 ** step)) / (np.sqrt(m2 / (1 - 0.999 ** step)) + 1e-9)
        model = Chain(params[:-3].reshape(3, -1), float(params[-3]), (float(params[-2]), float(params[-1])), (0.0, -1.0, 0.0))
        p = np.concatenate([model.marginals(texts[i][0]) for i in order])
        # Lines of bad documents that look good become good, but for the worst line.
        worst = np.repeat(np.maximum.reduceat(p, starts), sizes)
        states = bad_doc & ((p > 0.3) | (p >= worst))
    found = np.array([model.measures(*texts[i]) for i in full])
    x = np.column_stack([np.ones(len(full)), _logit(found[:, 0]), found[:, 1]])
    target, gain = y[full], np.zeros(3)
    for _ in range(50):  # Newton steps of a small ridge logistic
        p = 1 / (1 + np.exp(-np.clip(x @ gain, -30, 30)))
        hess = (x * (p * (1 - p))[:, None]).T @ x + 0.1 * np.eye(3)
        gain = gain - np.linalg.solve(hess, x.T @ (p - target) + 0.1 * gain)
    model.gain = tuple(float(g) for g in gain)
    return model


def _gradient(params, flat, first, last, starts, running, states, weight):
    """Gradient of the mean negative log likelihood of the states, over all chains at once."""
    w, bias, stay = params[:-3].reshape(3, -1), params[-3], params[-2:]
    z = w[0][flat].sum(1) + bias
    before, after = w[1][flat].sum(1), w[2][flat].sum(1)
    z[1:] += np.where(first[1:], 0, before[:-1])
    z[:-1] += np.where(last[:-1], 0, after[1:])
    z[first] += w[1][FEATURES]
    z[last] += w[2][FEATURES]
    ahead, back = np.zeros(len(flat)), np.zeros(len(flat))

    def pass_on(v):
        v = np.clip(v, -40, 40)
        return np.log1p(np.exp(v + stay[1])) - np.logaddexp(v, stay[0])

    for t in range(1, len(running)):
        at = starts[:running[t]] + t
        ahead[at] = pass_on(z[at - 1] + ahead[at - 1])
    for t in range(len(running) - 2, -1, -1):
        at = starts[:running[t + 1]] + t
        back[at] = pass_on(z[at + 1] + back[at + 1])
    p = 1 / (1 + np.exp(-np.clip(z + ahead + back, -40, 40)))
    miss = (p - states) * weight
    grad = np.zeros((3, FEATURES + 1))
    for k, shift in ((0, miss), (1, np.append(np.where(first[1:], 0, miss[1:]), 0)), (2, np.append(0, np.where(last[:-1], 0, miss[:-1])))):
        for j in range(flat.shape[1]):
            grad[k] += np.bincount(flat[:, j], shift, FEATURES + 1)
    grad[1, FEATURES], grad[2, FEATURES] = miss[first].sum(), miss[last].sum()
    # Expected and seen good-good and bad-bad neighbours.
    i = np.flatnonzero(~first)
    left, right = np.clip(z[i - 1] + ahead[i - 1], -40, 40), np.clip(z[i] + back[i], -40, 40)
    bb, gg = np.exp(left + right + stay[1]), np.full(len(i), np.exp(stay[0]))
    all_ = bb + gg + np.exp(left) + np.exp(right)
    wi = weight[i]
    gstay = np.array([((gg / all_ - (~states[i] & ~states[i - 1])) * wi).sum(), ((bb / all_ - (states[i] & states[i - 1])) * wi).sum()])
    return np.concatenate([grad.ravel(), [miss.sum()], gstay]) / weight.sum()


def scored(docs: DataFrame, model: Chain, threshold: float = 0.7, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Quality score, verdict and number of bad lines of every whole text.

    Null, empty and blank texts have no line and score as an evenly doubtful text; equal
    texts score alike; an empty table gives an empty result.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)
    schema = struct(("doc_id", docs.schema[id_col].dataType), ("score", DOUBLE), ("n_lines", LONG), ("bad_share", DOUBLE))

    def run(batches: Iterator[dict]) -> Iterator[tuple]:
        m = shared.value
        for batch in batches:
            out: tuple[list, ...] = ([], [], [])
            for text in batch["text"]:
                rows, sizes = lines_of(text)
                found = m.measures(rows, sizes)
                for column, v in zip(out, (m.score(*found), len(rows), found[0]), strict=True):
                    column.append(v)
            yield batch["doc_id"], *out

    return (map_rows(docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text")), run, schema)
            .withColumn("predicted", (F.col("score") >= threshold).cast("int")))
