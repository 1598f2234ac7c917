"""Token counts of whole documents; huge ones by overlapping chunks.

A huge text is encoded in overlapping chunks with offsets. Two neighbours are spliced
where both have a token boundary that is proven stable: no piece of the vocabulary
holds the two characters around it, so no merge can cross it whatever stands beside.
Where the overlap has no such place it is widened, in the end to the whole text. A chunk
starts before the last splice, so that the prefix which the library puts before every
text stands beside no token that counts.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import sentencepiece
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from readtrace.llm.common import BOOL, LONG, map_rows, struct

CHUNK, OVERLAP = 20_000, 400
LIMIT = 4096


class Counter:
    """Counts tokens with one sentencepiece model."""

    def __init__(self, model_file: str, chunk: int = CHUNK, overlap: int = OVERLAP):
        self.model = sentencepiece.SentencePieceProcessor(model_file=model_file)
        self.chunk, self.overlap, self.widened = chunk, overlap, 0
        pieces = [self.model.id_to_piece(i) for i in range(self.model.get_piece_size())
                  if not (self.model.is_byte(i) or self.model.is_control(i) or self.model.is_unknown(i))]
        self.inside = {p[i:i + 2] for p in pieces for i in range(len(p) - 1)}
        # The proof speaks about characters of the text, so the model must not rewrite them.
        self.plain = all(self.model.normalize(t).lstrip("▁") == t for t in ("ﬁ", "Ａ", "é", "a​b"))

    def stable(self, left: str, right: str) -> bool:
        return f"{left}{right}".replace(" ", "▁") not in self.inside and "▁" not in (left, right)

    def counts(self, texts: list[str]) -> list[int]:
        short = [t for t in texts if len(t) <= 2 * self.chunk]
        sizes = iter([len(ids) for ids in self.model.encode(short, num_threads=1)] if short else ())
        return [next(sizes) if len(t) <= 2 * self.chunk else self.spliced(t) for t in texts]

    def boundaries(self, text: str, start: int, end: int) -> list[int]:
        """Begin offset of every token of a chunk, as places in the whole text."""
        part = text[start:end]
        begins = [p.begin for p in self.model.encode(part, return_type="proto").pieces]  # in bytes
        first = (np.frombuffer(part.encode(), np.uint8) & 0xC0) != 0x80
        places = np.concatenate(([0], np.cumsum(first)))
        return (places[begins] + start).tolist() if begins else []

    def spliced(self, text: str) -> int:
        if not self.plain:
            return len(self.model.encode(text))
        total, cut, end = 0, 0, min(self.chunk, len(text))
        tokens = self.boundaries(text, 0, end)
        while end < len(text):
            overlap = self.overlap
            while True:
                first, after = max(cut, end - overlap), min(len(text), max(end - overlap, cut) + overlap + self.chunk)
                begin = first - (first == cut > 0)  # the splice at cut is stable, so one character before it is enough
                following = [t for t in self.boundaries(text, begin, after) if t >= first]
                common = set(following).intersection(t for t in tokens if first < t < end)
                at = max((p for p in common if self.stable(text[p - 1], text[p])), default=None)
                if at is not None or after == len(text) and first == cut:
                    break
                if first == cut:  # nothing stable in the whole chunk: a longer chunk takes its place
                    end, tokens = after, following
                self.widened += 1
                overlap *= 2
            if at is None:
                tokens, end = following, after
                break
            total += sum(cut <= t < at for t in tokens)
            cut, tokens, end = at, [t for t in following if t >= at], after
        return total + sum(t >= cut for t in tokens)


@lru_cache(maxsize=4)
def counter(model_file: str, chunk: int, overlap: int) -> Counter:
    """One model for each Python worker."""
    return Counter(model_file, chunk, overlap)


def counted(docs: DataFrame, model_file: str, chunk: int = CHUNK, overlap: int = OVERLAP, limit: int = LIMIT,
            id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """UTF-8 bytes and tokens of every whole text, as the library gives them for the whole text.

    A null text counts as empty: no bytes, no tokens. An empty table gives an empty
    result; repeated rows repeat. ``model_file`` is a path that every executor can open.
    """
    schema = struct(("doc_id", docs.schema[id_col].dataType), ("n_bytes", LONG), ("n_tokens", LONG), ("over_limit", BOOL))

    def run(batches: Iterator[dict]) -> Iterator[tuple]:
        count = counter(model_file, chunk, overlap).counts
        for batch in batches:
            texts = [t or "" for t in batch["text"]]
            n = [k for i in range(0, len(texts), 64) for k in count(texts[i:i + 64])]
            yield batch["doc_id"], [len(t.encode()) for t in texts], n, [k > limit for k in n]

    return map_rows(docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text")), run, schema)
