"""License scans: exact phrases, and fuzzy search for short notices.

A notice allowed k edits is cut into k + 1 seeds; any text within k edits holds one
seed unchanged (pigeonhole). Places of seeds become candidate stretches, in which the
regex library's bounded-error matching verifies the edits and gives the span.
"""

from __future__ import annotations

import bisect
from collections.abc import Iterator

import ahocorasick
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from readtrace.llm.common import DOUBLE, LONG, STRING, map_rows, struct

#: Phrases of the base rule, in words, with their labels.
PHRASES = {"under the mit license": "mit", "apache license version 2": "apache-2", "cc by nc": "cc-by-nc"}

#: Short notices as normalised words, with their label and the edits allowed.
NOTICES = (
    ("released under the mit license", "mit", 3),
    ("licensed under the mit license", "mit", 3),
    ("permission is hereby granted free of charge to any person obtaining a copy", "mit", 7),
    ("licensed under the apache license version 2", "apache-2", 4),
    ("licensed under cc by nc 4 0", "cc-by-nc", 2),
    ("creative commons attribution noncommercial", "cc-by-nc", 4),
    ("licensed under the gnu general public license version 3", "gpl-3", 5),
    ("licensed under the gnu general public license version 2", "gpl-2", 5),
    ("gnu lesser general public license", "lgpl", 3),
    ("mozilla public license version 2", "mpl-2", 3),
    ("redistribution and use in source and binary forms with or without modification", "bsd", 7),
    ("permission to use copy modify and or distribute this software for any purpose with or without fee", "isc", 7),
    ("this is free and unencumbered software released into the public domain", "unlicense", 5),
    ("licensed under the eclipse public license", "epl", 4),
    ("licensed under the zlib license", "zlib", 3),
    ("creative commons attribution sharealike", "cc-by-sa", 4),
    ("licensed under cc by sa 4 0", "cc-by-sa", 2),
    ("spdx license identifier mit", "mit", 2),
    ("spdx license identifier apache 2 0", "apache-2", 2),
    ("all rights reserved", "proprietary", 1),
)

_TO_SPACE = bytes(b if b >= 128 or 48 <= b <= 57 or 97 <= b <= 122 else 32 for b in range(256))


def words_of(text: str | None) -> list[bytes]:
    """Words of letters, digits and characters beyond ASCII, in lower case (A-Z only)."""
    return (text or "").encode().lower().translate(_TO_SPACE).split()


def _near(places: list[int], k: int) -> Iterator[tuple[int, int]]:
    """First and last of runs of places that reach over at most k, so that no stretch grows with the text."""
    first = last = None
    for p in places:
        if first is not None and p - first > k:
            yield first, last
            first = None
        first, last = p if first is None else first, p
    if first is not None:
        yield first, last


class Scanner:
    """Automaton of seeds and compiled patterns; built once in each worker."""

    def __init__(self, notices=NOTICES, phrases=None):
        self.phrases = [(f" {p} ".encode(), label) for p, label in (phrases or PHRASES).items()]
        self.notices = [(n, label, k, regex.compile(rf"(?b)(?<!\S)(?:{regex.escape(n)}){{e<={k}}}(?!\S)"))
                        for n, label, k in notices]
        self.seeds = ahocorasick.Automaton()
        owners: dict[str, list[tuple[int, int]]] = {}
        for i, (n, _, k, _) in enumerate(self.notices):
            cuts = [len(n) * j // (k + 1) for j in range(k + 2)]
            for a, b in zip(cuts, cuts[1:], strict=False):
                owners.setdefault(n[a:b], []).append((i, a))
        for seed, own in owners.items():
            self.seeds.add_word(seed, (len(seed), own))
        self.seeds.make_automaton()

    def base(self, joined: bytes) -> list[tuple[int, str]]:
        """First word and label of every place of a phrase; joined has one space around every word."""
        found = []
        for phrase, label in self.phrases:
            word, before, at = 0, 0, joined.find(phrase)
            while at >= 0:
                word += joined.count(b" ", before, at)
                found.append((word, label))
                before, at = at, joined.find(phrase, at + 1)
        return sorted(found)

    def fuzzy(self, line: str) -> list[tuple[int, int, str, int, float]]:
        """(start, end, label, edits, similarity) of notices in text of words and single spaces."""
        starts: dict[int, set[int]] = {}
        for end, (size, own) in self.seeds.iter(line):
            for i, offset in own:
                starts.setdefault(i, set()).add(end + 1 - size - offset)
        found = set()
        for i, places in starts.items():
            n, label, k, pattern = self.notices[i]
            for first, last in _near(sorted(places), k):
                # k edits move a seed by k at most, so a match lies within; one that touches the end was cut.
                a, b = max(0, first - k - 1), min(len(line), last + len(n) + k + 1)
                for m in pattern.finditer(line, a, b):
                    if m.end() == len(line) or line[m.end()] == " ":
                        edits = sum(m.fuzzy_counts)
                        found.add((m.start(), m.end(), label, edits, 1 - edits / len(n)))
        # Of notices that overlap, the most similar one stands.
        kept: list[tuple] = []
        for m in sorted(found, key=lambda m: (-m[4], m[0] - m[1], m)):
            at = bisect.bisect(kept, m)
            if (at == 0 or kept[at - 1][1] <= m[0]) and (at == len(kept) or m[1] <= kept[at][0]):
                kept.insert(at, m)
        return kept

    def scan(self, text: str | None) -> tuple:
        words = words_of(text)
        joined = b" " + b" ".join(words) + b" "
        base = self.base(joined) if words else []
        line = joined[1:-1].decode()
        near = self.fuzzy(line) if words else []
        starts = [i for i, c in enumerate(line) if c == " "] if near else []
        spans = [(bisect.bisect_left(starts, a), bisect.bisect_left(starts, b - 1), label, edits)
                 for a, b, label, edits, _ in near]
        first = {label for _, label in base}
        score = 1.0 if base else max((s for *_, s in near), default=0.0)
        return (len(words), len(base), base[0][0] if base else None, base[-1][0] if base else None,
                ",".join(sorted(first)), ",".join(sorted(first | {s[2] for s in spans})), score,
                [dict(zip(("first_word", "last_word", "label", "edits"), s, strict=True)) for s in spans])


_SPAN = T.ArrayType(struct(("first_word", LONG), ("last_word", LONG), ("label", STRING), ("edits", LONG)))


def scanned(docs: DataFrame, notices=NOTICES, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Counts, labels, score and fuzzy spans of every whole text.

    Null and empty texts have no words, no labels and score 0. Of overlapping notices the
    most similar is reported. An empty table gives an empty result; rows are judged one by one, so repeated
    rows agree. Score is 1 with an exact phrase, else the best similarity of a notice.
    """
    schema = struct(("doc_id", docs.schema[id_col].dataType), ("n_words", LONG), ("n_base", LONG), ("first_word", LONG),
                    ("last_word", LONG), ("base_labels", STRING), ("labels", STRING), ("score", DOUBLE), ("spans", _SPAN))

    def run(batches: Iterator[dict]) -> Iterator[tuple]:
        scanner = Scanner(notices)
        for batch in batches:
            rows = [scanner.scan(t) for t in batch["text"]]
            yield batch["doc_id"], *(list(c) for c in zip(*rows, strict=True))

    return map_rows(docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text")), run, schema)
