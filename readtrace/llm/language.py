"""Language identification by error-correcting output codes.

Each language has a codeword; one binary n-gram classifier per code bit tells the
languages with that bit from those without. Loss-weighted decoding picks the
codeword with the smallest loss, where a bit counts for a language as much as its
classifier is worth on that language. The statistics of the classifiers, counts of
hashed byte trigrams per language, are taken over all learning documents.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from readtrace.llm.common import BOOL, DOUBLE, LONG, STRING, filter_rows, map_rows, struct

BUCKETS = 1 << 14
#: Steepness of the bit losses, and of turning losses into a score.
SLOPE, SHARPNESS = 8.0, 6.0
#: Below this lead of the nearest over the second codeword a decision is ambiguous.
LEAD = 0.15

_FOLD = np.full(256, 32, np.uint32)
_FOLD[97:123] = np.arange(97, 123)
_FOLD[128:] = np.arange(128, 256)


def grams(text: str) -> np.ndarray:
    """Buckets of the byte trigrams of a lower-cased text; runs of non-letters count once."""
    b = _FOLD[np.frombuffer(f" {text.lower()} ".encode(), np.uint8)]
    b = b[np.concatenate(([True], (b[1:] != 32) | (b[:-1] != 32)))]
    if len(b) < 3:
        return np.empty(0, np.int64)
    h = (b[:-2] << 16) | (b[1:-1] << 8) | b[2:]
    return ((h * np.uint32(2654435761)) >> np.uint32(18)).astype(np.int64)


def has_letter(text: str | None) -> bool:
    """Whether a character of the Unicode categories L* occurs; numerals such as \u00bd or \u2460 are none."""
    return bool(text) and any(map(str.isalpha, text))


def codewords(n: int) -> np.ndarray:
    """n rows of +1 / -1: every split of up to 7 languages, else a spread random code."""
    if n <= 1:
        return np.ones((n, 1))
    if n <= 7:
        bits = (np.arange(1, 1 << (n - 1))[None, :] >> np.arange(n)[:, None]) & 1
        return np.where(bits == 1, 1.0, -1.0)
    rng, best, kept = np.random.default_rng(11), -1, None
    size = int(np.ceil(10 * np.log2(n)))
    for _ in range(200):
        code = rng.choice([-1.0, 1.0], (n, size))
        agree = code @ code.T
        apart = (size - agree[~np.eye(n, dtype=bool)]).min() / 2
        if apart > best and (np.abs(code.sum(0)) < n).all():
            best, kept = apart, code
    return kept


@dataclass
class Coder:
    """Languages, their codewords, classifier weights per bucket and bit, worth per language and bit."""

    languages: list[str]
    code: np.ndarray
    weights: np.ndarray
    worth: np.ndarray

    def decode(self, text: str | None) -> tuple[str, float, bool]:
        """Language, score from 0 to 1, and whether two codewords are about as near."""
        if not self.languages or not has_letter(text):
            return "und", 0.0, True
        if len(self.languages) == 1:
            return self.languages[0], 1.0, False
        found = grams(text)
        margin = self.weights[found].mean(0) if len(found) else np.zeros(self.code.shape[1])
        loss = (self.worth * np.log1p(np.exp(-SLOPE * margin * self.code))).sum(1)
        order = np.argsort(loss, kind="stable")
        near = np.exp(-SHARPNESS * (loss - loss[order[0]]))
        lead = loss[order[1]] - loss[order[0]]
        return self.languages[order[0]], float(1 / near.sum()), bool(lead < LEAD)


def learn(docs: DataFrame, learning: Column, lang_col: str = "lang", text_col: str = "text") -> Coder:
    """Fit the classifiers on the rows where ``learning`` holds and the language is known."""
    rows = (docs.where(learning & F.col(lang_col).isNotNull() & F.col(text_col).isNotNull())
            .select(F.col(lang_col).alias("lang"), F.col(text_col).alias("text")))

    def count(batches: Iterator[dict]) -> Iterator[tuple]:
        sums: dict[str, np.ndarray] = {}
        for batch in batches:
            for lang, text in zip(batch["lang"], batch["text"], strict=True):
                if has_letter(text):
                    sums.setdefault(lang, np.zeros(BUCKETS, np.int64))[:] += np.bincount(grams(text), minlength=BUCKETS)
        for lang, n in sums.items():
            at = np.flatnonzero(n)
            yield [lang] * len(at), at, n[at]

    counted = (map_rows(rows, count, struct(("lang", STRING), ("bucket", LONG), ("n", LONG)))
               .groupBy("lang", "bucket").agg(F.sum("n").alias("n")).toPandas())  # languages x BUCKETS rows
    languages = sorted(counted["lang"].unique())
    n = np.zeros((len(languages), BUCKETS))
    for i, lang in enumerate(languages):
        part = counted[counted["lang"] == lang]
        n[i, part["bucket"].to_numpy()] = part["n"].to_numpy(float)
    code = codewords(len(languages))
    p = (n + 0.5) / (n + 0.5).sum(1, keepdims=True) if languages else n
    weights = np.zeros((BUCKETS, code.shape[1]), np.float32)
    for b in range(code.shape[1] if len(languages) > 1 else 0):
        on = code[:, b] > 0
        weights[:, b] = np.log(p[on].mean(0)) - np.log(p[~on].mean(0))
    # What a bit tells about a language: the mean signed margin on that language's own trigrams.
    worth = np.clip((p @ weights) * code, 1e-3, None) if languages else np.zeros((0, 1))
    worth = worth / worth.sum(1, keepdims=True) if languages else worth
    return Coder(languages, code, weights, worth)


def identified(docs: DataFrame, coder: Coder, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Language, score and ambiguity of every whole text.

    Null texts and texts without a letter are ``und`` with score 0. Without any learning
    rows every text is ``und``; with one language only, that language. Ties go to the
    language first by code point. An empty table gives an empty result.
    """
    shared = docs.sparkSession.sparkContext.broadcast(coder)  # BUCKETS x code bits floats
    schema = struct(("doc_id", docs.schema[id_col].dataType), ("lang_pred", STRING), ("score", DOUBLE), ("ambiguous", BOOL))

    def run(batches: Iterator[dict]) -> Iterator[tuple]:
        decode = shared.value.decode
        for batch in batches:
            rows = [decode(t) for t in batch["text"]]
            yield batch["doc_id"], *(list(c) for c in zip(*rows, strict=True))

    return map_rows(docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text")), run, schema)


def decided(docs: DataFrame, coder: Coder, least: float = 0.5, text_col: str = "text") -> DataFrame:
    """The documents whose language is told, with all their columns: not those that are ``und``,
    nor those between two codewords with a score below ``least``.

    Null and empty texts and texts without a letter go; repeated rows are told alike, each for itself."""
    shared = docs.sparkSession.sparkContext.broadcast(coder)

    def keep():
        def judge(texts: list) -> list[bool]:
            found = map(shared.value.decode, texts)
            return [lang != "und" and not (ambiguous and score < least) for lang, score, ambiguous in found]
        return judge

    return filter_rows(docs, text_col, keep)
