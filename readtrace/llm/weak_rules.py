"""Quality rules combined by weak supervision.

Every rule votes good (1), bad (-1) or abstains (0). Expectation-maximisation over
the counts of vote patterns (at most 3 to the number of rules, whatever the corpus
holds) estimates how each rule votes on good documents and on each kind of bad ones;
the posterior probability of "good" replaces an all-must-pass filter.

Bad documents are bad in different ways, and the rules that tell one way vote together.
So "bad" is several latent kinds, each with a rate of bad votes per rule: within a kind
the rules are independent, and their dependence over all bad documents comes from the
kinds. A bad vote that no other rule of its kind shares is mostly a rule's own error.
"""

from __future__ import annotations

import operator
import string
from collections.abc import Iterator
from itertools import islice

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from readtrace.llm.common import DOUBLE, LONG, STRING, filter_rows, map_rows, stash, struct

SYMBOLS = "#*$%&|<>"
WINDOW = 8
RULES = ("length", "line_words", "endings", "word_size", "symbols", "marks", "letters",
         "repeats", "variety", "stutter", "lines", "capitals", "exclaims")
#: The kinds of bad documents, and the rules that are expected to speak against each.
KINDS = {
    "fragments": ("length", "line_words", "endings"),
    "symbols": ("symbols", "marks", "letters"),
    "repetition": ("repeats", "variety", "stutter", "lines"),
    "shouting": ("capitals", "exclaims", "marks"),
}
#: Where the estimation starts: rates of bad votes on good documents, of a kind's own rules, of other
#: rules on bad documents; and the share of good documents.
START_GOOD, START_OWN, START_OTHER, START_SHARE = 0.02, 0.7, 0.05, 0.8
#: Weight of these as prior, in pseudo observations; it vanishes against a corpus.
STRENGTH = 10.0

_ASCII_SPACE = " \t\n\r\x0b\x0c"
_MARKS = "".join(c for c in string.punctuation if c not in ".,'\"-?").encode()
_ENDS = frozenset(".!?:;\"'\u2026\u201d\u2019\u00bb\u3002\uff01\uff1f")
_MEASURES = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines", "n_capital", "n_lettered",
             "n_distinct", "n_stutter", "n_marks", "n_exclaims", "n_ended")


def repeated_words(words: list[bytes], size: int = WINDOW) -> int:
    """Words inside windows of ``size`` words that occur twice or more; ``size`` a power of two."""
    n = len(words) - size + 1
    if n < 2:
        return 0
    index: dict[bytes, int] = {}
    ids = np.fromiter((index.setdefault(w, len(index)) for w in words), np.int64, len(words))
    if len(index) == len(words):
        return 0
    step = 1
    while step < size:  # ids of windows of 2, 4, 8 words: equal ids exactly for equal words
        pairs = ids[:-step] * len(words) + ids[step:]
        _, ids, times = np.unique(pairs, return_inverse=True, return_counts=True)
        step *= 2
    starts = np.flatnonzero(times[ids] > 1)
    edges = np.zeros(len(words) + 1, np.int64)
    edges[starts] += 1
    np.subtract.at(edges, starts + size, 1)
    return int((np.cumsum(edges) > 0).sum())


def measure(text: str | None) -> tuple[int, ...]:
    """The measures of one text, in the order of ``_MEASURES``."""
    if not text:
        return (0,) * len(_MEASURES)
    raw = text.encode()
    words = raw.split()
    seen: set[str] = set()
    dup = lines = ended = 0
    for line in text.split("\n"):
        end = line.rstrip(_ASCII_SPACE)
        if end:
            lines += 1
            dup += line in seen
            seen.add(line)
            ended += end[-1] in _ENDS
    spaces = sum(map(text.count, _ASCII_SPACE))
    capital = lettered = 0
    for w in words:
        if w.isupper() and len(w) > 1:
            capital += 1
        if w.upper() != w or w.lower() != w or max(w) > 127:
            lettered += 1
    return (len(words), len(text) - spaces, sum(map(text.count, SYMBOLS)), dup, repeated_words(words),
            lines, capital, lettered, len(set(words)), sum(map(operator.eq, words, islice(words, 1, None))),
            len(raw) - len(raw.translate(None, _MARKS)), text.count("!"), ended)


def votes(n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, n_lines, n_capital, n_lettered,
          n_distinct, n_stutter, n_marks, n_exclaims, n_ended) -> str:
    """One character per rule: + good, - bad, 0 no opinion. Without words only the length has one."""
    if not n_words:
        return "-" + "0" * (len(RULES) - 1)

    def by(value: float, good: float, bad: float) -> str:
        return "+" if value <= good else "-" if value > bad else "0"

    size = word_chars / n_words
    return "".join((
        "+" if n_words >= 60 else "-" if n_words < 30 else "0",
        "+" if n_words >= 8 * n_lines else "-" if n_words < 4 * n_lines else "0",
        by(1 - n_ended / n_lines, 0.2, 0.5) if n_lines else "0",
        "+" if 3 <= size <= 9 else "-" if size < 2 or size > 14 else "0",
        by(n_symbols / n_words, 0.02, 0.1),
        by(n_marks / word_chars, 0.02, 0.08),
        by(1 - n_lettered / n_words, 0.1, 0.3),
        by(n_repeat_words / n_words, 0.05, 0.2),
        "0" if n_words < 20 else by(1 - float(np.log(n_distinct) / np.log(n_words)), 0.1, 0.2),
        by(n_stutter / n_words, 0.03, 0.15),
        "0" if n_lines < 3 else by(n_dup_lines / n_lines, 0.1, 0.3),
        by(n_capital / n_words, 0.15, 0.4),
        by(n_exclaims / n_words, 0.05, 0.2),
    ))


def start() -> tuple[np.ndarray, np.ndarray]:
    """Shares of good documents and of each kind of bad ones, and P(bad vote, good vote | class, rule votes)."""
    bad = np.full((1 + len(KINDS), len(RULES)), START_OTHER)
    bad[0] = START_GOOD
    for k, names in enumerate(KINDS.values(), 1):
        for name in names:
            bad[k, RULES.index(name)] = START_OWN
    share = np.array([START_SHARE, *[(1 - START_SHARE) / len(KINDS)] * len(KINDS)])
    return share, np.stack([bad, 1 - bad], axis=2)


def fit(patterns: dict[str, int], rounds: int = 500) -> tuple[np.ndarray, np.ndarray]:
    """What ``start`` gives, estimated from pattern counts; class 0 is good, then the kinds in order.

    To abstain says nothing about the class. Without patterns the start is returned.
    """
    share, rates = start()
    before, prior = share * STRENGTH, rates * STRENGTH
    if not patterns:
        return share, rates
    keys = sorted(patterns)
    hot = np.stack([_one_hot(k) for k in keys])
    times = np.array([patterns[k] for k in keys], float)
    for _ in range(rounds):
        p = _posterior(hot, share, rates)
        old, share = share, (times @ p + before) / (times.sum() + STRENGTH)
        seen = np.einsum("nc,nrv->crv", times[:, None] * p, hot) + prior
        rates = seen / seen.sum(2, keepdims=True)
        if np.abs(old - share).max() < 1e-10:
            break
    return share, rates


def _one_hot(pattern: str) -> np.ndarray:
    """Rules by (bad, good); all zero where a rule abstains."""
    return np.array([[c == "-", c == "+"] for c in pattern], float)


def _posterior(hot: np.ndarray, share: np.ndarray, rates: np.ndarray) -> np.ndarray:
    logs = np.einsum("nrv,crv->nc", hot, np.log(rates)) + np.log(share)
    odds = np.exp(logs - logs.max(1, keepdims=True))
    return odds / odds.sum(1, keepdims=True)


def posterior(pattern: str, model: tuple[np.ndarray, np.ndarray]) -> float:
    """Probability that a document with this vote pattern is good."""
    return float(_posterior(_one_hot(pattern)[None], *model)[0, 0])


def measures(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document with its measures and vote pattern."""
    schema = struct(("doc_id", docs.schema[id_col].dataType), *[(m, LONG) for m in _MEASURES], ("pattern", STRING))

    def run(batches: Iterator[dict]) -> Iterator[tuple]:
        for batch in batches:
            rows = [measure(t) for t in batch["text"]]
            yield batch["doc_id"], *(list(c) for c in zip(*rows, strict=True)), [votes(*r) for r in rows]

    return map_rows(docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text")), run, schema)


def posteriors(rows: DataFrame) -> dict[str, float]:
    """P(good) of every vote pattern that occurs, fitted over all rows with a ``pattern``."""
    patterns = {r.pattern: r.n for r in rows.groupBy("pattern").agg(F.count("*").alias("n")).collect()}
    model = fit(patterns)
    return {k: posterior(k, model) for k in patterns}


def judged(docs: DataFrame, threshold: float = 0.5, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Measures, base rules, posterior and verdict of every document.

    Null and empty texts have no words, so they fail the base rules; an empty table
    gives an empty result; equal texts get equal verdicts. Other columns are ignored.
    The rules' behaviour is estimated over all documents.
    """
    rows = stash(measures(docs, id_col, text_col), "quality-rules")
    # One row per vote pattern: at most 3 ** len(RULES).
    scores = docs.sparkSession.createDataFrame(list(posteriors(rows).items()), struct(("pattern", STRING), ("quality", DOUBLE)))
    failed = (F.col("n_words") < 20) | (100 * F.col("n_repeat_words") > 30 * F.col("n_words"))
    return (rows.join(F.broadcast(scores), "pattern")
            .withColumn("base_failed", failed)
            .withColumn("kept", ~F.col("base_failed") & (F.col("quality") >= threshold))
            .select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words",
                    "base_failed", "kept", "quality", "pattern"))


def kept(docs: DataFrame, threshold: float = 0.5, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The documents that ``judged`` keeps, with all their columns, row by row and without a join.

    Null and empty texts go; repeated rows and equal texts are judged alike, each row for itself.
    """
    quality = posteriors(measures(docs, id_col, text_col))

    def keep():
        def judge(texts: list) -> list[bool]:
            rows = [measure(t) for t in texts]
            return [r[0] >= 20 and 100 * r[4] <= 30 * r[0] and quality[votes(*r)] >= threshold for r in rows]
        return judge

    return filter_rows(docs, text_col, keep)


__all__ = ["KINDS", "RULES", "fit", "judged", "kept", "measure", "measures", "posterior", "repeated_words", "votes"]
